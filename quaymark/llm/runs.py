"""Periodic runs of words, found in tiles that grow with the period and stitched over tile edges.

A run is a stretch of words with smallest period q that no neighbouring word extends, of at least ``LEAST`` words and
``FOLD`` periods. The periods from 2^k to 2^(k+1) - 1 are an octave. For every octave a document is covered by tiles of
``BOUNDARIES`` boundaries, a step of about 0.75 * 2^k words apart, so each run of the octave holds several of them.
Tiles are solved on their own: at a boundary the Z function of the text that follows tells for each period of the
octave how long it agrees with itself one period later, and the Z function of the reversed text how far back; a value
counts up to one step, which is the overlap of a tile with its neighbours. Values that reach a whole step are told by
names of blocks (64-bit, from the names of their halves), the others by comparing words. A period whose block is a power of a
shorter one is left to the shorter one's octave. What a tile finds are fragments: places, one after another, whose
words return one period later. Fragments that a tile's edge cuts are kept however short they are.

Spark then shuffles the fragments by document and period, joins those that touch, and keeps what is long enough.
Only documents with a fragment send their words along to meet their runs; all others are finished where they are read.
A task holds the tiles of one slice of documents, and of a single document if that is longer, at about 60 bytes a word.

Defined results: words are what ASCII white space separates; null and empty texts have no words and no run; null
and repeated doc_ids are documents like any other, each row of its own; an empty table gives no rows; other columns
are ignored.
"""

import functools
import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quaymark.llm import common
from quaymark.llm.shingles import mixed
from quaymark.llm.token_store import _Codes

LEAST = 6
FOLD = 4
BOUNDARIES = 64
#: Bytes of text whose tiles are solved together.
_SLICE = 2_000_000
_CELLS = 1 << 20


def least_length(period):
    return np.maximum(LEAST, FOLD * period)


def _step(octave: int) -> int:
    """The distance of boundaries: a quarter of the words that return in the shortest run of the octave."""
    low = 1 << octave
    return int(min(least_length(p) - p for p in range(low, min(2 * low, low + 8)))) // 4


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of blocks from the names of their parts, in order."""
    return mixed(a ^ mixed(b * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x2545F4914F6CDD1D)))


@functools.lru_cache(1)
def _least_primes(n: int) -> np.ndarray:
    """The least prime factor of every number up to n."""
    least = np.arange(n + 1)
    root = int(n**0.5) + 1
    for i in range(root, 1, -1):
        if all(i % r for r in range(2, int(i**0.5) + 1)):
            least[i * i :: i] = i
    return least


def _agreeing(names: np.ndarray, octave: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries (by number) and periods whose Z value reaches a whole step."""
    low, n = 1 << octave, len(names)
    boundary, period = [], []
    count = (n - 1 - low) // step + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if count >= low:
        for p in range(low, min(2 * low, n)):
            last = (n - 1 - p) // step * step
            found = np.flatnonzero(names[: last + 1 : step] == names[p : p + last + 1 : step])
            boundary.append(found)
            period.append(np.full(len(found), p))
    else:
        for j in range(count):
            found = np.flatnonzero(names[j * step + low : j * step + 2 * low] == names[j * step])
            boundary.append(np.full(len(found), j))
            period.append(found + low)
    return np.concatenate(boundary).astype(np.int64), np.concatenate(period).astype(np.int64)


def _primitive(half: np.ndarray, width: int, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which blocks of one period are no power of a shorter block; ``half`` names blocks of ``width`` words."""
    least = _least_primes(4 * width)
    keep = np.flatnonzero(period > 1)
    rest, alone = period[keep], np.flatnonzero(period == 1)
    prime, done = np.zeros(len(keep), np.int64), []
    while len(keep):
        last, prime = prime, least[rest]
        rest = rest // prime
        again = prime != last
        m, shift = at[keep[again]], period[keep[again]] // prime[again]
        over = period[keep[again]] - shift - width  # a block of the first period, less a shift, is four halves at most
        same = np.ones(len(m), bool)
        for k in range(4):
            i = m + np.minimum(k * width, over)
            same &= half[i] == half[i + shift]
        power = np.zeros(len(keep), bool)
        power[again] = same
        done.append(keep[~power & (rest == 1)])
        going = ~power & (rest > 1)
        keep, rest, prime = keep[going], rest[going], prime[going]
    found = np.zeros(len(at), bool)
    found[np.concatenate([alone, *done])] = True
    return found


def _reach(words: np.ndarray, at: np.ndarray, period: np.ndarray, step: int, forward: bool) -> np.ndarray:
    """Z values from ``at`` on (or back from it), up to one step."""
    out = np.zeros(len(at), np.int64)
    rows = max(1, _CELLS // step)
    for a in range(0, len(at), rows):
        i = at[a : a + rows, None] + (np.arange(step) if forward else -1 - np.arange(step))[None, :]
        j = i + period[a : a + rows, None]
        inside = (i >= 0) & (j < len(words))
        same = inside & (words[np.where(inside, i, 0)] == words[np.where(inside, j, 0)])
        out[a : a + rows] = np.where(same.all(1), step, same.argmin(1))
    return out


def _octave(words, names, half, octave: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``period, start, end`` of the fragments in all tiles of an octave.

    ``names`` are those of blocks of half the octave's least period, ``half`` those of blocks half as long.
    """
    step = _step(octave)
    width = max(1, 1 << octave >> 1)
    blocks = names if step == 1 else _joined(names[: len(names) - step + width], half[width:][: len(names) - step + width])
    boundary, period = _agreeing(blocks, octave, step)
    order = np.lexsort((boundary, period))
    boundary, period = boundary[order], period[order]
    # A run holds three values of a whole step one after another; a tile sees two boundaries of its neighbours for that.
    new = (np.diff(period) != 0) | (np.diff(boundary) != 1)
    chain = np.cumsum(np.concatenate([[0], new])) if len(boundary) else boundary
    keep = np.bincount(chain)[chain] >= 3
    boundary, period, chain = boundary[keep], period[keep], chain[keep]
    if not len(boundary):
        return (np.zeros(0, np.int64),) * 3
    new = (np.diff(chain) != 0) | (np.diff(boundary // BOUNDARIES) != 0)
    first, last = np.concatenate([[True], new]), np.concatenate([new, [True]])
    period, a, b = period[first], boundary[first] * step, boundary[last] * step + step
    own = _primitive(names, width, a, period)
    period, a, b = period[own], a[own], b[own]
    back, on = _reach(words, a, period, step, False), _reach(words, b, period, step, True)
    start, end = a - back, b + on
    keep = (back == step) | (on == step) | (end - start + period >= least_length(period))
    return period[keep], start[keep], end[keep]


def fragments(documents: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each document of word codes its fragments ``(period, start, end)``: words from start to end - 1 return."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    sizes = np.array([len(d) for d in documents], np.int64)
    order = [int(i) for i in np.argsort(sizes, kind="stable") if sizes[i] >= LEAST]
    if not order:
        return found
    # Short documents first: a longer octave works on the rest of the line. Between documents stands a code of its own.
    line = np.concatenate([np.append(documents[i], -1 - k) for k, i in enumerate(order)]).astype(np.int64)
    starts = np.cumsum([0] + [int(sizes[i]) + 1 for i in order])
    lengths = sizes[order]
    names, half, base, octave = mixed(line.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)), None, 0, 0
    while True:
        skip = int(starts[np.searchsorted(lengths, max(LEAST, FOLD << octave))])
        cut, base = skip - base, skip
        line, names, half = line[cut:], names[cut:], None if half is None else half[cut:]
        if not len(line):
            return found
        period, start, end = _octave(line, names, half, octave)
        document = np.searchsorted(starts, start + base, "right") - 1
        begin = starts[document] - base
        for d, p, s, e in zip(document, period, start - begin, end - begin):
            if e + p <= lengths[d]:
                found[order[d]].append((int(p), int(s), int(e)))
        if octave:
            width = 1 << octave >> 1
            names, half = _joined(names[:-width], names[width:]), names
        octave += 1


_FOUND = "doc_id long, n_words long, words binary, collapsed_sha256 string, fragments array<struct<period: long, start: long, end: long>>"
_FRAGMENT = pa.struct([("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _solve(order: Callable | None, with_text: bool):
    def solved(doc_ids: list, texts: list[bytes]) -> pa.RecordBatch:
        code = _Codes()
        words, codes = [], []
        for doc_id, text in zip(doc_ids, texts):
            own = text.split()
            numbers = np.fromiter(map(code.__getitem__, own), np.int64, len(own))
            places = order(doc_id, len(own)) if order else None
            if places is not None:
                own, numbers = [own[i] for i in places.tolist()], numbers[places]
            words.append(own)
            codes.append(numbers)
        found = fragments(codes)
        joined = [b" ".join(own) for own in words]
        columns = [
            pa.array(doc_ids, pa.int64()),
            pa.array([len(own) for own in words], pa.int64()),
            pa.array([j if f or with_text else None for j, f in zip(joined, found)], pa.binary()),
            pa.array([None if f else hashlib.sha256(j).hexdigest() for j, f in zip(joined, found)], pa.string()),
            pa.array([[{"period": p, "start": s, "end": e} for p, s, e in f] for f in found], pa.list_(_FRAGMENT)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "words", "collapsed_sha256", "fragments"])

    def run(batches):
        for batch in batches:
            doc_ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= _SLICE:
                    yield solved(doc_ids, texts)
                    doc_ids, texts, size = [], [], 0
            if texts:
                yield solved(doc_ids, texts)

    return run


_RUNS = "array<struct<start: long, period: long, length: long>>"


def _collapse(with_text: bool):
    def run(batches):
        for batch in batches:
            kept = []
            for words, runs in zip(batch.column("words"), batch.column("runs").to_pylist()):
                own = words.as_py().split()
                depth = np.zeros(len(own) + 1, np.int64)
                for r in runs:
                    depth[r["start"] + r["period"]] += 1
                    depth[r["start"] + r["length"]] -= 1
                kept.append(b" ".join([own[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]))
            columns = [batch.column(c) for c in ("doc_id", "n_words", "runs")]
            columns.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))
            names = ["doc_id", "n_words", "runs", "collapsed_sha256"]
            if with_text:
                columns.append(pa.array(kept, pa.binary()))
                names.append("collapsed")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def stitched(pieces: DataFrame) -> DataFrame:
    """``key, period, start, end`` of fragments -> ``key, start, length, period`` of the runs they make up."""
    within = W.partitionBy("key", "period").orderBy("start", "end")
    reached = F.max("end").over(within.rowsBetween(W.unboundedPreceding, -1))
    chained = pieces.withColumn("opens", F.when(F.col("start") <= reached, 0).otherwise(1))
    numbered = chained.withColumn("run", F.sum("opens").over(within.rowsBetween(W.unboundedPreceding, 0)))
    whole = numbered.groupBy("key", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start") + F.col("period")
    enough = F.col("length") >= F.greatest(F.lit(LEAST), F.lit(FOLD) * F.col("period"))
    return whole.withColumn("length", length).where(enough).select("key", "start", "length", "period")


def find(docs: DataFrame, order: Callable | None = None, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, runs, collapsed_sha256`` of every document; ``runs`` are ``start, period, length``, sorted.

    Collapsed words are those that no run holds after its first period, joined by one space; with ``with_text`` they come
    along as ``collapsed`` (binary). ``order(doc_id, n_words)`` may give the places that a document's words are taken from.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().cast("binary").alias("text"))
    found = texts.mapInArrow(_solve(order, with_text), _FOUND)
    found = common.settle(found.withColumn("key", F.monotonically_increasing_id()))
    pieces = found.select("key", F.explode("fragments").alias("f")).select("key", "f.*")
    listed = F.sort_array(F.collect_list(F.struct("start", "period", "length")))
    runs = stitched(pieces).groupBy("key").agg(listed.alias("runs"))
    none = F.array().cast(_RUNS)
    met = found.where("size(fragments) > 0").select("key", "doc_id", "n_words", "words").join(runs, "key", "left")
    text = ", collapsed binary" * with_text
    collapsed = met.select("doc_id", "n_words", "words", F.coalesce("runs", none).alias("runs")).mapInArrow(
        _collapse(with_text), f"doc_id long, n_words long, runs {_RUNS}, collapsed_sha256 string{text}"
    )
    whole = [F.col("words").alias("collapsed")] * with_text
    untouched = found.where("size(fragments) = 0")
    return untouched.select("doc_id", "n_words", none.alias("runs"), "collapsed_sha256", *whole).unionByName(collapsed)


def best() -> Column:
    """Of ``runs`` the one with the greatest exact length / period; ties go to the smallest start, then period."""
    longer = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.reduce("runs", F.element_at("runs", 1), lambda top, r: F.when(longer(r, top), r).otherwise(top))


def summary(found: DataFrame) -> DataFrame:
    """The digest of :func:`find`: counts, the most repetitive run and SHA-256 sums."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""))
    top = F.when(F.size("runs") > 0, best()).alias("top")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top, lines.alias("lines"), "collapsed_sha256").select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period",
        F.expr("top.length * 1000 div top.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), "collapsed_sha256",
    )


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Every tenth document by crc32 of its id (null: of no digits) repeats its words from some place on."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places
