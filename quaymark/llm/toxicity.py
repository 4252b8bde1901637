"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learned from document labels.

A document is a bag of sentences. A sentence's score is the logistic of a bias and the weights of its words; a
word's weight is the sum over its own and its character n-grams' weights, so unseen forms of known stems count.
The document's score is the chance that at least one sentence is toxic, ``1 - prod(1 - s)``. Only document labels
are learned from; afterwards the sentence scores locate what is offensive.

Training takes at most ``TRAIN_TOXIC`` and ``TRAIN_CLEAN`` labelled rows, drawn by a hash of doc_id, with their whole
texts. Features that are no more frequent in toxic documents than in clean ones get no weight.

Defined results: a null or empty text counts as one sentence without words; labels other than 0 and 1, null labels
and null doc_ids are not learned from; with no usable labels every score is 0; a doc_id that is labelled twice counts
as toxic if any label says so; repeated rows get equal results; an empty table gives no rows.
"""

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm import common

TRAIN_TOXIC = 2000
TRAIN_CLEAN = 4000
GRAMS = (4, 5, 6)
#: Features are known by so many bits of their hash, which bounds what is counted.
HASH_BITS = 22
#: A feature needs this many times its share among clean documents, and that much evidence (likelihood ratio, 2 ln L).
LEAST_LIFT = 4.0
LEAST_EVIDENCE = 12.5
STEPS = 400
SHRINK = 0.002
#: Words whose weight a Python worker remembers.
REMEMBERED = 500_000

_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
_WORD = re.compile(r"\w+")


def features(word: str) -> set[int]:
    """Hashes of a word with its ends marked and of its character n-grams."""
    marked = f"<{word}>"
    parts = {marked, *(marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1))}
    return {zlib.crc32(x.encode("utf-8", "replace")) >> (32 - HASH_BITS) for x in parts}


@dataclass
class Model:
    bias: float
    weights: dict[int, float]
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, word: str) -> float:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > REMEMBERED:
                self.memo.clear()
            got = self.memo[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return got

    def document(self, text: str | None) -> float:
        """The noisy-or over all sentences of a whole text."""
        text = (text or "").lower()
        plain = np.log1p(-_logistic(self.bias))
        if not any(self.word(w) for w in set(_WORD.findall(text))):
            count = max(1, sum(1 for _ in _SENTENCE.finditer(text)))
            return float(-np.expm1(count * plain))
        total = 0.0
        for sentence in _SENTENCE.findall(text):
            score = sum(map(self.word, _WORD.findall(sentence)))
            total += plain if not score else -np.logaddexp(0.0, self.bias + score)
        return float(-np.expm1(total))

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """Start, end and score of every sentence."""
        found = []
        for m in _SENTENCE.finditer(text or ""):
            score = sum(map(self.word, _WORD.findall(m.group().lower())))
            found.append((m.start(), m.end(), float(_logistic(self.bias + score))))
        return found


def _logistic(x):
    return 1 / (1 + np.exp(-x))


def _gathered(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin and last as given, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)]


def _telling(toxic: int, clean: int, n: tuple[int, int]) -> bool:
    """Whether a feature of so many toxic and clean documents speaks for toxicity."""
    if (toxic + 0.5) / (n[1] + 1) < LEAST_LIFT * (clean + 0.5) / (n[0] + 1):
        return False
    both, share = toxic + clean, n[1] / sum(n)
    evidence = toxic * np.log(toxic / (both * share))
    if clean:
        evidence += clean * np.log(clean / (both * (1 - share)))
    return 2 * evidence >= LEAST_EVIDENCE


def train(texts: list[str], toxic: list[int], weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Noisy-or likelihood by Adam with shrinkage; ``weights`` restore the classes' shares in the population."""
    pairs = list(dict.fromkeys(zip(texts, map(bool, toxic))))  # copies of one text are no further evidence
    texts, label = [t for t, _ in pairs], np.array([y for _, y in pairs], bool)
    if not label.any() or label.all():
        return Model(-745.0, {})
    numbers: dict[str, int] = {}
    spoken = [
        np.array(sorted({numbers.setdefault(w, len(numbers)) for w in _WORD.findall(t.lower())}), np.int64) for t in texts
    ]
    parts = [np.array(sorted(features(w)), np.int32) for w in numbers]
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    begin = np.cumsum(sizes) - sizes
    del parts
    within = np.zeros((2, 1 << HASH_BITS), np.int32)
    for words, y in zip(spoken, label):
        seen = np.unique(_gathered(flat, begin[words], sizes[words]))
        within[int(y), seen] += 1
    n = (int((~label).sum()), int(label.sum()))
    chosen = [int(f) for f in np.flatnonzero(within[1]) if _telling(int(within[1, f]), int(within[0, f]), n)]
    place = {f: i for i, f in enumerate(chosen)}
    used = {}
    for w, k in numbers.items():
        at = [place[f] for f in flat[begin[k] : begin[k] + sizes[k]].tolist() if f in place]
        if at:
            used[w] = at
    del spoken, flat, numbers
    sentence_doc, entry_sentence, entry_feature = [], [], []
    plain = np.zeros(len(texts))
    for d, text in enumerate(texts):
        for sentence in _SENTENCE.findall(text.lower()) or [""]:
            at = [i for w in _WORD.findall(sentence) if w in used for i in used[w]]
            if not at:
                plain[d] += 1
                continue
            entry_sentence += [len(sentence_doc)] * len(at)
            entry_feature += at
            sentence_doc.append(d)
    owner = np.array(sentence_doc, np.int64)
    rows, cols = np.array(entry_sentence, np.int64), np.array(entry_feature, np.int64)
    cost = np.where(label, weights[1], weights[0]) / len(texts)
    values = np.zeros(len(chosen) + 1)
    values[-1] = -6.0
    mean, square = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, STEPS + 1):
        score = np.bincount(rows, values[cols], len(owner)) + values[-1]
        s, s0 = _logistic(score), _logistic(values[-1])
        clear = np.bincount(owner, -np.logaddexp(0, score), len(texts)) + plain * np.log1p(-s0)
        p = np.clip(-np.expm1(clear), 1e-12, 1)
        pull = cost * np.where(label, -(1 - p) / p, 1.0)  # slope of the loss along sum(-log(1 - s))
        by_sentence = pull[owner] * s
        slope = np.append(np.bincount(cols, by_sentence[rows], len(chosen)), by_sentence.sum() + (pull * plain).sum() * s0)
        slope[:-1] += SHRINK * values[:-1] / max(1, len(chosen)) ** 0.5
        mean += 0.1 * (slope - mean)
        square += 0.001 * (slope * slope - square)
        values -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        values[:-1] = np.maximum(values[:-1], 0)
    return Model(float(values[-1]), {f: float(w) for f, w in zip(chosen, values) if w > 1e-3})


def held_out():
    return common.id_crc() % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = (TRAIN_CLEAN, TRAIN_TOXIC)) -> Model:
    """Learns from labels outside the held-out fold."""
    usable = common.settle(
        labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    counts = {int(r["toxic"]): r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return train([], [])
    top = 16**7
    bound = [min(top, top * most // counts[k]) for k, most in enumerate(rows)]
    draw = common.ticket("toxicity:", F.col("doc_id"), 7)
    taken = usable.where(draw < F.when(F.col("toxic") == 1, bound[1]).otherwise(bound[0]))
    got = sorted(
        # The ids are as few as the training takes, so they go to the texts and not the texts to them.
        docs.select("doc_id", common.whole_text().alias("text")).join(F.broadcast(taken), "doc_id").collect(),
        key=lambda r: (r["doc_id"], r["text"]),
    )
    drawn = Counter(int(r["toxic"]) for r in got)
    share = tuple(counts[k] / max(1, drawn[k]) for k in (0, 1))
    scale = len(got) / sum(share[k] * drawn[k] for k in (0, 1)) if got else 1.0
    return train([r["text"] for r in got], [r["toxic"] for r in got], (share[0] * scale, share[1] * scale))


def _apply(model: Model):
    def predict(batches):
        for batch in batches:
            scores = np.array([model.document(t) for t in batch.column(1).to_pylist()], np.float64)
            columns = [batch.column(0), batch.column(2), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return predict


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return rows.mapInArrow(_apply(model), f"doc_id {kind}, held_out boolean, score double, predicted int")


def _locate(model: Model, least: float):
    def locate(batches):
        for batch in batches:
            ids, rows = [], []
            for doc_id, text in zip(batch.column(0), batch.column(1).to_pylist()):
                for start, end, value in model.sentences(text):
                    if value >= least:
                        ids.append(doc_id)
                        rows.append((start, end, value, text[start:end]))
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.string())
            parts = list(zip(*rows)) or [[], [], [], []]
            columns = [pa.array([i.as_py() for i in ids], batch.column(0).type)]
            columns += [pa.array(list(part), kind) for part, kind in zip(parts, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "stop", "score", "sentence"])

    return locate


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The offending sentences: ``doc_id, start, stop, score, sentence``, places in code points."""
    kind = dict(docs.dtypes)["doc_id"]
    form = f"doc_id {kind}, start int, stop int, score double, sentence string"
    return docs.select("doc_id", "text").mapInArrow(_locate(model, least), form)
