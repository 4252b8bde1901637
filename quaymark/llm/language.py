"""Language identification by a small convolutional network over bytes, trained in numpy.

Texts are read as UTF-8 bytes in windows of ``WINDOW``. Every byte has an embedding; filters of several widths
slide over a window, each filter's largest response feeds one softmax layer. A document's score is the softmax of
the mean logits of all its windows, weighted by their bytes, so whole texts count.

Training uses at most ``TRAIN_ROWS`` rows of each language, drawn by a hash of doc_id, one window from a hashed
place in each. Applying the network needs no matrix product per byte: two table lookups by byte pair add up to all
filter responses at a place.

Defined results: ``und`` with score 0 where the text is null, empty or without a letter, or where nothing could
be learned; rows with a null doc_id or language are never learned from; repeated rows get equal results; an empty
table gives no rows; other columns are ignored.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm import common

UNKNOWN = "und"
WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
#: Rows learned from, for each language.
TRAIN_ROWS = 1500
#: Updates of the training, however few rows there are.
STEPS = 700
BATCH = 64
RATE = 0.004
#: Windows computed at once in a task.
AT_ONCE = 256
#: The pipeline rejects documents whose language is less certain than this.
CERTAIN = 0.3

_LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING; byte 0 also pads and stays 0
    filters: list[np.ndarray]  # for each width: width x EMBEDDING x FILTERS
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses to the first two and to the last two bytes of a place, by byte pair."""
        first = np.zeros((256, 256, len(self.bias)), np.float32)
        last = np.zeros_like(first)
        for k, weights in enumerate(self.filters):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            for j in range(len(weights)):
                response = (self.embedding @ weights[j]).astype(np.float32)
                into = first if j < 2 else last
                into[:, :, own] += response[:, None, :] if j % 2 == 0 else response[None, :, :]
        first += self.bias.astype(np.float32)
        return first.reshape(65536, -1), last.reshape(65536, -1)


def train(texts: list[bytes], languages: list[str], seed: int = 1) -> Network:
    """Adam on single windows; window lengths vary so that short texts are known too."""
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    label = np.array([names.index(x) for x in languages])
    n_maps = FILTERS * len(WIDTHS)
    net = Network(
        names,
        rng.normal(0, 0.5, (256, EMBEDDING)),
        [rng.normal(0, (1 / (w * EMBEDDING)) ** 0.5, (w, EMBEDDING, FILTERS)) for w in WIDTHS],
        np.zeros(n_maps),
        rng.normal(0, 0.2, (n_maps, len(names))),
        np.zeros(len(names)),
    )
    net.embedding[0] = 0
    if len(names) < 2:
        return net
    size = np.bincount(label, minlength=len(names))
    weight = (len(label) / len(names) / size)[label]
    values = [net.embedding, *net.filters, net.bias, net.dense, net.dense_bias]
    mean = [np.zeros_like(v) for v in values]
    square = [np.zeros_like(v) for v in values]
    step, places = 0, WINDOW - max(WIDTHS) + 1
    while step < STEPS:
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            data = np.zeros((len(rows), WINDOW), np.uint8)
            for r, k in enumerate(rows):
                length = int(rng.integers(8, WINDOW + 1)) if rng.random() < 0.5 else WINDOW
                piece = np.frombuffer(texts[k][:length], np.uint8)
                data[r, : len(piece)] = piece
            x = net.embedding[data]
            pooled, best = [], []
            for w, weights in zip(WIDTHS, net.filters):
                response = sum(x[:, j : j + places] @ weights[j] for j in range(w))
                at = response.argmax(axis=1)
                best.append(at)
                pooled.append(np.take_along_axis(response, at[:, None, :], 1)[:, 0])
            raw = np.concatenate(pooled, 1) + net.bias
            hidden = np.maximum(raw, 0)
            logits = hidden @ net.dense + net.dense_bias
            share = np.exp(logits - logits.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            share[np.arange(len(rows)), label[rows]] -= 1
            error = share * weight[rows][:, None] / len(rows)
            back = (error @ net.dense.T) * (raw > 0)
            slopes = [np.zeros_like(v) for v in values]
            slopes[-3], slopes[-2], slopes[-1] = back.sum(0), hidden.T @ error, error.sum(0)
            who = np.arange(len(rows))[:, None]
            for k, (w, weights) in enumerate(zip(WIDTHS, net.filters)):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    slopes[1 + k][j] = np.einsum("rfe,rf->ef", x[who, best[k] + j], part)
                    np.add.at(slopes[0], data[who, best[k] + j], part[:, :, None] * weights[j].T[None])
            slopes[0][0] = 0
            step += 1
            for v, g, m, s in zip(values, slopes, mean, square):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def _logits(net: Network, first: np.ndarray, last: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Logits of windows, ``n x WINDOW`` bytes."""
    wide = windows.astype(np.intp)
    pairs = (wide[:, :-1] << 8) | wide[:, 1:]
    places = WINDOW - max(WIDTHS) + 1
    response = np.take(first, pairs[:, :places], axis=0)
    response += np.take(last, pairs[:, 2 : 2 + places], axis=0)
    return np.maximum(response.max(axis=1), 0) @ net.dense + net.dense_bias


def classify(net: Network, tables: tuple[np.ndarray, np.ndarray], texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of whole texts."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
    if not net.languages or not known:
        return names, scores
    total = np.zeros((len(texts), len(net.languages)))
    owners, parts, held = [], [], 0
    weights: list[int] = []

    def settle() -> None:
        block = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WINDOW)
        for i in range(0, len(block), AT_ONCE):
            got = _logits(net, *tables, block[i : i + AT_ONCE])
            np.add.at(total, owners[i : i + AT_ONCE], got * np.array(weights[i : i + AT_ONCE])[:, None])

    for i in known:
        data = texts[i].encode("utf-8", "replace")
        for at in range(0, len(data), WINDOW * 4096):
            piece = data[at : at + WINDOW * 4096]
            n = -(-len(piece) // WINDOW)
            parts.append(piece.ljust(n * WINDOW, b"\0"))
            owners += [i] * n
            weights += [WINDOW] * (n - 1) + [len(piece) - WINDOW * (n - 1)]
            held += n
            if held >= 16 * AT_ONCE:
                settle()
                owners, parts, weights, held = [], [], [], 0
    if held:
        settle()
    for i in known:
        mean = total[i] / max(1, len(texts[i].encode("utf-8", "replace")))
        share = np.exp(mean - mean.max())
        share /= share.sum()
        names[i], scores[i] = net.languages[int(share.argmax())], float(share.max())
    return names, scores


def fit(docs: DataFrame, allowed, rows: int = TRAIN_ROWS) -> Network:
    """Learns ``lang`` from ``text`` on a bounded sample of the rows that ``allowed`` admits."""
    usable = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    top = 16**7
    draw = common.ticket("language:", F.col("doc_id"), 7)
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(top, top * rows // n))]) if counts else None
    if limit is None:
        return train([], [])
    place = F.pmod(F.crc32(F.concat(F.lit("at"), F.col("doc_id").cast("string"))), F.greatest(F.length("text") - WINDOW, F.lit(1)))
    taken = usable.where(draw < limit[F.col("lang")]).select(
        "lang", F.substring(F.col("text"), place.cast("int") + 1, F.lit(WINDOW)).alias("piece"), "doc_id"
    )
    got = sorted(taken.collect(), key=lambda r: (r["doc_id"], r["piece"]))
    return train([r["piece"].encode("utf-8", "replace") for r in got], [r["lang"] for r in got])


def _apply(net: Network):
    def predict(batches):
        tables = net.tables()
        for batch in batches:
            names, scores = classify(net, tables, batch.column(1).to_pylist())
            columns = [batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    return predict


def held_out():
    return common.id_crc() % 3 == 1


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every whole text; neither lang nor source is read."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return rows.mapInArrow(_apply(net), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs, ~held_out() & F.col("doc_id").isNotNull()))


def _accept(net: Network, columns: list[str]):
    at = columns.index("text")

    def keep(batches):
        tables = net.tables()
        for batch in batches:
            names, scores = classify(net, tables, batch.column(at).to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and s >= CERTAIN for n, s in zip(names, scores)], pa.bool_()))

    return keep


def accepted(docs: DataFrame) -> DataFrame:
    """The rows whose language is known with some certainty, with all their columns, in one pass over the texts."""
    net = fit(docs, ~held_out() & F.col("doc_id").isNotNull())
    return docs.mapInArrow(_accept(net, docs.columns), docs.schema)
