"""Documents into as few fixed-size sequences as possible: large-item matching, then best fit of the smaller ones.

Every document becomes its token ids and an end id. Documents above the capacity are cut from their end into pieces of
the full capacity, so only the first piece may be shorter; all others are one piece. Pieces above a third of the
capacity meet at most twice in a sequence: the longest takes the longest one that still fits beside it. Smaller pieces
follow from long to short, each into the tightest gap that holds it; a new sequence is opened where none does.

Pieces of one length are interchangeable, so the packing is computed on the histogram of lengths (at most
``capacity`` rows) for whole groups of equal sequences at once, and written down as steps: so many pieces of a length,
from this rank on, into these sequences at this offset. A step uses up a length or a group of sequences, so their
number depends on the capacity and not on the rows. Tasks then rank the pieces of each length in buckets of
``BUCKET`` rows and look their places up; texts and ids never leave the task that encodes them unless asked for.

Defined results: null text is empty and becomes its end id alone; null and repeated doc_ids are documents like any
other, each row of its own; documents of exactly the capacity are not cut; an empty table gives no rows; other columns
are ignored.
"""

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quaymark.llm import common
from quaymark.llm.token_store import END_ID, encoder

CAPACITY = 2048
#: Pieces of one length that are ranked together.
BUCKET = 100_000
_BATCH = 5_000
_FORM = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(length: int, capacity: int) -> list[int]:
    """Where the pieces of a document begin."""
    if length <= capacity:
        return [0]
    rest = length % capacity
    return ([0] if rest else []) + list(range(rest, length, capacity))


def _encode(tokenizer: str, capacity: int, with_ids: bool):
    names = [c.split()[0] for c in _FORM.split(", ")] + ["ids"] * with_ids

    def run(batches):
        rows: list[tuple] = []

        def flush():
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, tokens in zip(doc_ids, encoder(tokenizer).encode(texts)):
                ids = np.append(tokens, END_ID).astype("<u4")
                starts = cut(len(ids), capacity)
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    data = ids[a:b].tobytes()
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(data)) + ((data,) if with_ids else ()))
                    if len(rows) >= _BATCH:
                        yield flush()
        if rows:
            yield flush()

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece; with ``ids`` (binary, little-endian 32 bits) if asked."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text"))
    return texts.mapInArrow(_encode(tokenizer, capacity, with_ids), _FORM + ", ids binary" * with_ids)


class _Sequences:
    """Groups of sequences with equal gaps, found by the tightest gap."""

    def __init__(self, capacity: int):
        self.capacity, self.n = capacity, 0
        self.gaps: list[int] = []
        self.groups: dict[int, list[tuple[int, int]]] = {}

    def opened(self, n: int) -> int:
        self.n += n
        return self.n - n

    def put(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in self.groups:
                insort(self.gaps, gap)
                self.groups[gap] = []
            self.groups[gap].append((first, n))

    def tightest(self, length: int) -> tuple[int, int, int] | None:
        """Takes out a group with the least gap that holds the length."""
        at = bisect_left(self.gaps, length)
        if at == len(self.gaps):
            return None
        gap = self.gaps[at]
        first, n = self.groups[gap].pop()
        if not self.groups[gap]:
            del self.groups[gap], self.gaps[at]
        return gap, first, n


def _match(counts: dict[int, int], sequences: _Sequences, place) -> None:
    """Pairs pieces above a third of the capacity; what finds no partner stays alone."""
    capacity = sequences.capacity
    left = {length: n for length, n in counts.items() if 3 * length > capacity}
    order = sorted(left)
    while order:
        a = order[-1]
        at = bisect_left(order, capacity - a + 1) - 1
        if at == len(order) - 1 and left[a] == 1:
            at -= 1
        b = order[at] if at >= 0 else None
        n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
        first = sequences.opened(n)
        place(a, n, first, 1, 0)
        left[a] -= n
        if b is not None:
            place(b, n, first, 1, a)
            left[b] -= n
        sequences.put(capacity - a - (b or 0), first, n)
        for length in {a, b} - {None}:
            if not left[length]:
                order.remove(length)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Steps ``(length, first rank, pieces, first sequence, pieces a sequence, offset)`` and the number of sequences."""
    steps, ranks, sequences = [], dict.fromkeys(counts, 0), _Sequences(capacity)

    def place(length: int, n: int, first: int, each: int, offset: int) -> None:
        steps.append((length, ranks[length], n, first, each, offset))
        ranks[length] += n

    _match(counts, sequences, place)
    for length in sorted((c for c in counts if 3 * c <= capacity), reverse=True):
        left = counts[length]
        while left:
            found = sequences.tightest(length)
            if found is None:
                n = -(-left // (capacity // length))
                found = capacity, sequences.opened(n), n
            gap, first, n = found
            each = gap // length
            full, more = min(n, left // each), 0
            if full:
                place(length, full * each, first, each, capacity - gap)
                sequences.put(gap - each * length, first, full)
                left -= full * each
            if full < n and left:
                more = left
                place(length, more, first + full, more, capacity - gap)
                sequences.put(gap - more * length, first + full, 1)
                left = 0
            sequences.put(gap, first + full + bool(more), n - full - bool(more))
    return steps, sequences.n


def _look_up(steps: list[tuple[int, int, int, int, int, int]]):
    by_length: dict[int, np.ndarray] = {}
    for length in {s[0] for s in steps}:
        by_length[length] = np.array(sorted(s[1:] for s in steps if s[0] == length), np.int64)

    def run(batches):
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                table = by_length[int(length)]
                first, _, bins, each, base = table[np.searchsorted(table[:, 0], ranks[own], "right") - 1].T
                nth = ranks[own] - first
                sequence[own] = bins + nth // each
                offset[own] = base + nth % each * length
            kept = batch.drop_columns(["rank"])
            columns = [*kept.columns, pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*kept.schema.names, "sequence_id", "offset"])

    return run


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The columns of :func:`pieces` with ``sequence_id`` and ``offset``; sequences are numbered from 0."""
    spark, names = found.sparkSession, found.columns
    rows = common.settle(found.withColumn("row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps, _ = plan(counts, capacity)
    if not steps:
        return rows.drop("row").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    buckets = spark.createDataFrame([(c, -(-n // BUCKET)) for c, n in counts.items()], "length long, buckets long")
    # a row for each length, at most ``capacity``
    dealt = rows.join(F.broadcast(buckets), "length").withColumn("bucket", F.expr("pmod(xxhash64(row), buckets)"))
    sizes = common.settle(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")))  # a row for each bucket
    earlier = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    nth = F.row_number().over(W.partitionBy("length", "bucket").orderBy("row")) - 1
    ranked = dealt.withColumn("nth", nth).join(before, ["length", "bucket"])
    form = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields)
    return ranked.select(*names, (F.col("before") + F.col("nth")).alias("rank")).mapInArrow(
        _look_up(steps), form + ", sequence_id long, offset long"
    )


def sequences(rows: DataFrame) -> DataFrame:
    """``sequence_id, length, ids`` from packed pieces that carry their ids; a sequence holds ``capacity`` pieces at most."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("inside", F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return rows.groupBy("sequence_id").agg(F.sum("length").alias("length"), inside.alias("inside")).select(
        "sequence_id", "length", joined.alias("ids")
    )
