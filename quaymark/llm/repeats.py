"""Removal of repeated byte strings across documents by distributed prefix doubling over sampled positions.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier (in a smaller doc_id, or earlier in the
same document) goes. Ranks are fingerprints: equal strings, equal rank.

1. Scan. Inside a task, ranks double from 8 to 16 to 32 bytes at every position. Of the places a 100-byte string
   offers a 32-byte one, the least rank is its anchor, so equal strings have equal anchors, and only anchors
   (3 positions in 100) leave the task.
2. Sort. Spark sorts (rank of 32 bytes, rank of the whole neighbourhood the anchor's strings lie in, position), a
   range sort whose keys are unique, so no group is too large for a task. Positions with a unique rank are done.
   A neighbourhood that appeared before makes all of its strings repeats; equal ones are reranked no further.
3. Rerank past the threshold. What is left, the first of each different neighbourhood of one anchor, is ranked at
   all 69 offsets over 100 bytes; a rank that has an earlier position is a repeat. Anchors with more than ``HOT``
   different neighbourhoods are ranked by Spark's aggregation, the rest inside tasks that hold whole groups.
4. Cut. A document's repeated starts become byte spans.

Defined results: null text is empty; texts shorter than 100 bytes, and rows without a doc_id, lose nothing; rows that
repeat doc_id and text are one document and all get its result; an empty table gives no rows; other columns are
ignored. Removed spans are judged on the input, not on what is left.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm import common
from quaymark.llm.fingerprints import GRAM, LENGTH, PLACES, Stretch, anchors, grams, mixed

BEFORE = PLACES - 1
#: Different neighbourhoods of one anchor that a single task compares; a task holds their bytes and ranks them a few
#: offsets at a time.
HOT = 200_000
_SLICE = 1 << 18
_PIECE = 1 << 20
_GROUPS_AT_ONCE = 2000
_RANKS_AT_ONCE = 200_000


def _pieces(docs: list[tuple[int, bytes]]):
    """Stretches of whole documents, and overlapping pieces of very long ones: ids, bytes, offsets, text lengths."""
    held, size = [], 0
    for doc, data in docs:
        if len(data) < LENGTH:
            continue
        if len(data) > _PIECE:
            for at in range(0, len(data), _PIECE):
                lo = max(0, at - 2 * LENGTH)
                yield [(doc, data[lo : at + _PIECE + 2 * LENGTH], lo, len(data), at, at + _PIECE)]
            continue
        held.append((doc, data, 0, len(data), 0, len(data)))
        size += len(data)
        if size >= _SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def anchor_rows(docs: list[tuple[int, bytes]]):
    """``rank, around, doc, pos`` arrays of the anchors of some documents."""
    for part in _pieces(docs):
        lengths = np.array([len(p[1]) for p in part])
        stretch = Stretch(np.frombuffer(b"".join(p[1] for p in part), np.uint8))
        begin = np.cumsum(lengths) - lengths
        offset, total, lo, hi = (np.array([p[k] for p in part]) for k in (2, 3, 4, 5))
        owner = np.repeat(np.arange(len(part)), lengths)
        place = np.arange(len(stretch.data)) - begin[owner] + offset[owner]
        names = grams(stretch.data)
        inside = np.arange(len(stretch.data)) + LENGTH <= (begin + lengths)[owner]
        at = anchors(names, inside)
        own = owner[at]
        pos = place[at]
        mine = (pos >= lo[own]) & (pos < hi[own])
        at, own, pos = at[mine], own[mine], pos[mine]
        left, right = np.minimum(BEFORE, pos), np.minimum(LENGTH, total[own] - pos)
        around = stretch.name(at - left, at + right) ^ mixed((left * 128 + right).astype(np.uint64))
        yield names[at], around, np.array([p[0] for p in part], np.int64)[own], pos


def _batch(names, *columns):
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)


def _scan(batches):
    for batch in batches:
        texts = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for rank, around, doc, pos in anchor_rows([(d, t.encode("utf-8", "replace")) for d, t in texts]):
            yield _batch(["rank", "around", "doc", "pos"], rank.view(np.int64), around.view(np.int64), doc, pos)


SEEN, FIRST, EDGE = 0, 1, 2


def _rerank(batches):
    """One sorted range: what was seen before, what is first of several, and the ranks at the range's two ends."""
    whole = [b for b in batches if len(b)]
    if not whole:
        return
    rank, around, doc, pos = (np.concatenate([b.column(k).to_numpy() for b in whole]) for k in range(4))
    new = lambda *cs: np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in cs])])
    distinct = new(rank, around, doc, pos)  # repeated rows of one document
    rank, around, doc, pos = rank[distinct], around[distinct], doc[distinct], pos[distinct]
    group = np.cumsum(new(rank)) - 1
    first = new(rank, around)
    classes = np.bincount(group, first)[group]
    # A rank at an end may go on in the next range. Only the first row of each of its neighbourhoods has to wait for
    # that; the others were seen before whatever lies elsewhere.
    edge = first & ((group == 0) | (group == group[-1]))
    kind = np.full(len(rank), -1)
    kind[~first] = SEEN
    kind[first & (classes > 1)] = FIRST
    kind[edge] = EDGE
    keep = kind >= 0
    bare = np.where(kind == EDGE, around, 0)[keep]
    named = np.where(kind == SEEN, 0, rank)[keep]
    yield _batch(["kind", "rank", "around", "doc", "pos"], kind[keep].astype(np.int32), named, bare, doc[keep], pos[keep])


def _neighbourhoods(batches):
    for batch in batches:
        rows = []
        for doc, text, spots in zip(*(batch.column(k).to_pylist() for k in range(3))):
            data = text.encode("utf-8", "replace")
            for spot in spots:
                pos, left = spot["pos"], min(BEFORE, spot["pos"])
                rows.append((spot["rank"], doc, pos, left, data[pos - left : pos + LENGTH]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        columns = list(zip(*rows)) or [[]] * 5
        names = ["rank", "doc", "pos", "before", "bytes"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def offset_ranks(
    rank: np.ndarray, left: np.ndarray, data: list[bytes], at_once: int = PLACES
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, offsets before the anchor and ranks of all 100-byte strings around some anchors, some offsets at a time.

    The rank joins the ranks of both halves, the anchor's and the offset, so only like strings share it.
    """
    lengths = np.array([len(d) for d in data])
    stretch = Stretch(np.frombuffer(b"".join(data), np.uint8))
    anchor = np.cumsum(lengths) - lengths + left
    end = np.cumsum(lengths)
    half = LENGTH // 2
    for lowest in range(0, PLACES, at_once):
        d = np.arange(lowest, min(lowest + at_once, PLACES))
        start = anchor[:, None] - d[None, :]
        valid = (d[None, :] <= left[:, None]) & (start + LENGTH <= end[:, None])
        row, k = np.nonzero(valid)
        s, offset = start[row, k], d[k]
        pair = mixed(stretch.name(s, s + half)) + np.uint64(3) * stretch.name(s + half, s + LENGTH)
        yield row, offset, mixed(pair + mixed(rank.view(np.uint64)[row] + offset.astype(np.uint64)))


def _starts(pos: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and first and last starts of the runs of repeated offsets (rows x PLACES)."""
    edge = np.diff(np.pad(repeated.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    return row, pos[row] - b + 1, pos[row] - a


_SPAN = "doc long, low long, high long"


def _compare(batches):
    """Rows sorted by rank, doc, pos: the repeated starts of whole groups."""
    held = None

    def settle(rank, doc, pos, left, data):
        new = np.ones(len(rank), bool)  # repeated rows of one document come twice
        new[1:] = (rank[1:] != rank[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
        rank, doc, pos, left, data = rank[new], doc[new], pos[new], left[new], [x for x, n in zip(data, new.tolist()) if n]
        for cut in _portions(rank):
            repeated = np.zeros((len(rank[cut]), PLACES), bool)
            at_once = max(1, min(PLACES, _RANKS_AT_ONCE // len(repeated)))
            for row, offset, name in offset_ranks(rank[cut], left[cut], data[cut], at_once):
                _, at, back = np.unique(name, return_index=True, return_inverse=True)
                again = at[back.ravel()] != np.arange(len(name))
                repeated[row[again], offset[again]] = True
            which, low, high = _starts(pos[cut], repeated)
            yield _batch(["doc", "low", "high"], doc[cut][which], low, high)

    def _portions(rank):
        ends = np.append(np.flatnonzero(np.diff(rank)) + 1, len(rank))
        at = 0
        while at < len(rank):
            stop = ends[min(np.searchsorted(ends, at + _GROUPS_AT_ONCE), len(ends) - 1)]
            yield slice(at, stop)
            at = stop

    for batch in batches:
        if not len(batch):
            continue
        now = [batch.column(k).to_numpy() for k in range(4)] + [batch.column(4).to_pylist()]
        if held is not None:
            now = [np.concatenate([h, x]) if k < 4 else h + x for k, (h, x) in enumerate(zip(held, now))]
        last = int(np.searchsorted(now[0], now[0][-1]))
        held = [x[last:] for x in now]
        yield from settle(*(x[:last] for x in now))
    if held is not None and len(held[0]) > 1:
        yield from settle(*held)


def _ranked(batches):
    """The strings around anchors with very many neighbourhoods, a row for each."""
    for whole in batches:
        for i in range(0, len(whole), 500):
            batch = whole.slice(i, 500)
            rank, doc, pos, left = (batch.column(k).to_numpy() for k in range(4))
            for row, offset, name in offset_ranks(rank, left, batch.column(4).to_pylist()):
                yield _batch(["rank", "name", "doc", "start"], rank[row], name.view(np.int64), doc[row], pos[row] - offset)


def _hot_starts(rows: DataFrame) -> DataFrame:
    names = common.settle(rows.mapInArrow(_ranked, "rank long, name long, doc long, start long"))
    first = names.groupBy("rank", "name").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n"))
    again = names.join(common.settle(first.where("n > 1")), ["rank", "name"])
    later = F.struct("doc", "start") != F.col("first")
    return again.where(later).select("doc", F.col("start").alias("low"), F.col("start").alias("high"))


def repeated_starts(docs: DataFrame) -> DataFrame:
    """``doc, low, high``: ranges of starts of strings that also start earlier; ranges may overlap."""
    named = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc"), common.whole_text().alias("text")
    )
    order = ["rank", "around", "doc", "pos"]
    points = named.mapInArrow(_scan, "rank long, around long, doc long, pos long")
    ranged = points.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = common.settle(ranged.mapInArrow(_rerank, "kind int, rank long, around long, doc long, pos long"))
    common.release(docs.sparkSession)

    edges = ranked.where(F.col("kind") == EDGE)
    classes = common.settle(edges.groupBy("rank", "around").agg(F.min(F.struct("doc", "pos")).alias("first")))
    several = classes.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1")
    firsts = ranked.where(F.col("kind") == FIRST).select("rank", "doc", "pos").unionByName(
        classes.join(several, "rank", "left_semi").select("rank", "first.doc", "first.pos")
    )
    firsts = common.settle(firsts)
    seen = ranked.where(F.col("kind") == SEEN).select("doc", "pos").unionByName(
        edges.join(classes, ["rank", "around"]).where(F.struct("doc", "pos") != F.col("first")).select("doc", "pos")
    )
    spans = seen.select("doc", (F.col("pos") - BEFORE).alias("low"), F.col("pos").alias("high"))

    spots = firsts.groupBy("doc").agg(F.collect_list(F.struct("pos", "rank")).alias("spots"))
    around = named.join(spots.hint("merge"), "doc").select("doc", "text", "spots")
    around = around.mapInArrow(_neighbourhoods, "rank long, doc long, pos long, before int, bytes binary")
    hot = common.settle(firsts.groupBy("rank").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("rank"))
    some_hot = not hot.isEmpty()
    if some_hot:
        around = common.settle(around)
    cool = around.join(hot, "rank", "left_anti") if some_hot else around
    sorted_ = cool.repartition("rank").sortWithinPartitions("rank", "doc", "pos")
    spans = spans.unionByName(common.settle(sorted_.mapInArrow(_compare, _SPAN)))
    if some_hot:
        spans = spans.unionByName(_hot_starts(around.join(hot, "rank", "left_semi")))
    common.release(docs.sparkSession)
    return spans


def _cut(batches):
    for batch in batches:
        rows = []
        for doc_id, text, low, high in zip(*(batch.column(k).to_pylist() for k in range(4))):
            data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
            if not low or len(data) < LENGTH:
                rows.append((doc_id, len(data), 0, [], data.tobytes()))
                continue
            a, b = np.maximum(np.array(low), 0), np.minimum(np.array(high), len(data) - LENGTH)
            a, b = a[a <= b], b[a <= b]
            depth = np.zeros(len(data) + 1, np.int64)
            np.add.at(depth, a, 1)
            np.add.at(depth, b + LENGTH, -1)
            gone = np.cumsum(depth[:-1]) > 0
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            runs = zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())
            rows.append((doc_id, len(data), int(gone.sum()), [{"start": s, "stop": e} for s, e in runs], data[~gone].tobytes()))
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = (batch.column(0).type, pa.int64(), pa.int64(), span, pa.binary())
        columns = list(zip(*rows)) or [[]] * 5
        names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` of every row; ``kept`` are the bytes that remain."""
    starts = repeated_starts(docs)
    runs = starts.groupBy("doc").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text").join(runs.hint("merge"), F.col("doc_id").cast("long") == F.col("doc"), "left")
    form = f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept binary"
    return rows.select("doc_id", "text", "low", "high").mapInArrow(_cut, form)
