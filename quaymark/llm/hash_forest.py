"""Approximate nearest neighbours by inner product: a forest of sorted hash strings.

Each tree gives a vector a long string of ``SYMBOLS`` symbols: a symbol names the closest of 2 * ``DIRECTIONS``
random directions. A tree is the sorted array of these strings. A query descends to its longest prefix matches by
binary search and ascends, in all trees at once and one symbol at a time, until the trees together hold enough
candidates; what the prefixes select is scored exactly, in double precision on the vectors as given. A query also walks
the strings that start with its next closest directions, ``PROBES`` of them, so that few trees suffice.

Vectors are lifted by one dimension (``x / max norm`` and what is missing to length 1), so that the largest inner
product is the closest direction. Equal vectors are one leaf; only the ``k + 1`` smallest ids of a leaf can ever
be named. On Spark, all strings with one head (their first symbols) lie in one bucket of bounded size: small heads
share a bucket, large ones are dealt over several and their queries visit all of them. The head's length is the
longest at which ``CALIBRATION`` sampled queries, held against all vectors in blocks, reach ``RECALL``;
structureless data thus get short heads and more candidates, and where one symbol is still too much, more probes. Every
query ascends to the head at least; it stops below only at a level where sampled queries with as many candidates there
reach ``RECALL`` too. Queries that find fewer than ``k`` ascend further, at last to the root and all leaves; no other
query does, at any size of the table.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or whose length is not
the table's most common one, take no part; ties go to the smaller id; rows that repeat an id and its vector count
once; fewer than k candidates give fewer rows; an empty table gives none; other columns are ignored.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quaymark.llm import common

TREES = 20
SYMBOLS = 8
DIRECTIONS = 64
BITS = 7
#: First symbols a query walks in each tree: the least number that reaches ``RECALL``; the last one is all of them.
PROBES = (4, 5, 6, 8, 12, 16, 32, 2 * DIRECTIONS)
#: Queries may stop below the head where the trees hold so many candidates each, on average.
EFFORT = 400
#: Strings of a bucket, on average and for the parts of a large head.
BUCKET = 4096
CALIBRATION = 64
RECALL = 0.94
SEED = 20


def rotations(dimension: int, trees: int = TREES, seed: int = SEED) -> np.ndarray:
    """trees x symbols x (dimension + 1) x directions; orthogonal where the dimension allows it."""
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(trees, SYMBOLS, dimension + 1, DIRECTIONS))
    if dimension + 1 >= DIRECTIONS:
        out = np.linalg.qr(out)[0]
    return out.astype(np.float32)


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    scaled = vectors / longest
    rest = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))
    return np.concatenate([scaled, rest[:, None]], 1).astype(np.float32)


def strings(points: np.ndarray, turns: np.ndarray, probes: int = 1) -> np.ndarray:
    """Hash strings as integers, points x probes; probe 0 follows the closest first direction, 1 the next."""
    keys = np.zeros((len(points), probes), np.int64)
    for k in range(SYMBOLS):
        near = points @ turns[k]
        both = np.concatenate([near, -near], 1)
        if k == 0 and probes > 1:
            keys = np.argsort(-both, axis=1, kind="stable")[:, :probes].astype(np.int64)
        else:
            keys = (keys << BITS) | both.argmax(1)[:, None]
    return keys


def _unpacked(column: pd.Series, kind: type) -> np.ndarray:
    flat = np.frombuffer(b"".join(column), kind)
    return flat.reshape(len(column), -1).astype(np.float64)


def _matrix(array: pa.Array) -> np.ndarray:
    return np.asarray(array.flatten(), np.float64).reshape(len(array), -1)


def _hashed(turns: np.ndarray, longest: float, probes: int, query: bool, kind: type):
    """Rows of ``id, vector`` -> ``id, tree, key, packed``, a row for each tree and probe; vectors packed as ``kind``."""

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                if not len(batch):
                    continue
                vectors = _matrix(batch.column(1))
                if query:
                    points = np.pad(vectors / np.linalg.norm(vectors, axis=1)[:, None], ((0, 0), (0, 1)))
                else:
                    points = lifted(vectors, longest)
                points = points.astype(np.float32)
                packed = pa.array([v.tobytes() for v in vectors.astype(kind)], pa.binary())
                for tree in range(len(turns)):
                    keys = strings(points, turns[tree], probes)
                    for p in range(probes):
                        tree_no = pa.array(np.full(len(vectors), tree, np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0), tree_no, pa.array(keys[:, p].copy()), packed], ["id", "tree", "key", "packed"]
                        )

    return run


def _bounds(forest: np.ndarray, strings_: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings that share ``level`` symbols lie in a sorted array of (tree, string)."""
    shift = np.int64(BITS * (SYMBOLS - level))
    prefix = (strings_ >> shift) << shift
    return np.searchsorted(forest, prefix), np.searchsorted(forest, prefix + (np.int64(1) << shift))


def _joined(rows: pd.DataFrame) -> np.ndarray:
    return (rows["tree"].to_numpy(np.int64) << np.int64(BITS * SYMBOLS)) | rows["key"].to_numpy(np.int64)


_LEVELS = [f"n{i}" for i in range(SYMBOLS + 1)]


def _count(head: int):
    def run(leaves: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(queries):
            return pd.DataFrame({"id": [], **{c: [] for c in _LEVELS}}).astype("int64")
        forest, wanted = np.sort(_joined(leaves)) if len(leaves) else np.zeros(0, np.int64), _joined(queries)
        found = {"id": queries["id"].to_numpy(np.int64)}
        for level in range(SYMBOLS + 1):
            lo, hi = _bounds(forest, wanted, max(level, head))
            found[_LEVELS[level]] = hi - lo
        return pd.DataFrame(found).groupby("id", as_index=False).sum()

    return run


def _score(keep: int, kind: type):
    def run(leaves: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        ids, others, scores = [], [], []
        if len(leaves) and len(queries):
            order = np.argsort(_joined(leaves), kind="stable")
            forest = _joined(leaves)[order]
            names = leaves["id"].to_numpy(np.int64)[order]
            points = _unpacked(leaves["packed"], kind)[order]
            wanted, level = _joined(queries), queries["level"].to_numpy(np.int64)
            lo, hi = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
            for one in np.unique(level):
                of = level == one
                lo[of], hi[of] = _bounds(forest, wanted[of], int(one))
            asking = queries["id"].to_numpy(np.int64)
            places = _unpacked(queries["packed"], kind)
            spans, which = np.unique(np.stack([lo, hi], 1), axis=0, return_inverse=True)
            for s, (a, b) in enumerate(spans):
                if a == b:
                    continue
                mine = np.flatnonzero(which.ravel() == s)
                for i in range(0, len(mine), 256):
                    some = mine[i : i + 256]
                    near = places[some] @ points[a:b].T
                    if b - a > keep:
                        floor = np.partition(near, b - a - keep, axis=1)[:, b - a - keep]
                        row, col = np.nonzero(near >= floor[:, None])
                    else:
                        row, col = (x.ravel() for x in np.indices(near.shape))
                    ids.append(asking[some[row]])
                    others.append(names[a + col])
                    scores.append(near[row, col])
        joined = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((ids, "i8"), (others, "i8"), (scores, "f8"))]
        return pd.DataFrame(dict(zip(("id", "other", "score"), joined)))

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` (doubles) of the rows that take part."""
    v = F.col("vector")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & sound & F.exists(v, lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size(v) == (sizes["d"] if sizes else 0))


def _reached(leaves: DataFrame, sample: list, turns: np.ndarray, longest: float, k: int, probes: int) -> np.ndarray:
    """For each number of probes and true neighbour of the sampled queries: the most symbols it shares with a probe."""
    points = np.array([r["vector"] for r in sample])

    def nearest(batches):
        for batch in batches:
            if not len(batch):
                continue
            near = points @ _matrix(batch.column(1)).T
            best = np.argsort(-near, axis=1)[:, : k + 1]
            rows = np.repeat(np.arange(len(points)), best.shape[1])
            flat = best.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(near[rows, flat]), batch.column(1).take(pa.array(flat)), batch.column(0).take(pa.array(flat))],
                ["q", "score", "vector", "id"],
            )

    best = leaves.select("id", "vector").mapInArrow(nearest, "q long, score double, vector array<double>, id long")
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
    true = [r for r in best.withColumn("r", place).where(F.col("r") <= k + 1).collect() if r["id"] != sample[r["q"]]["id"]]
    items = lifted(np.array([r["vector"] for r in true]), longest)
    q = np.array([r["q"] for r in true])
    asking = np.pad(points / np.linalg.norm(points, axis=1)[:, None], ((0, 0), (0, 1))).astype(np.float32)
    level = np.zeros((probes, len(true)), np.int64)
    for turn in turns:
        own, walked = strings(items, turn)[:, 0], strings(asking, turn, probes)[q]
        for p in range(probes):
            differ = own ^ walked[:, p]
            bits = np.where(differ == 0, 0, np.floor(np.log2(np.maximum(differ, 1))) + 1)
            level[p] = np.maximum(level[p], (SYMBOLS * BITS - bits).astype(np.int64) // BITS)
    return np.maximum.accumulate(level, axis=0)


def _sampled(asked: DataFrame) -> list:
    return asked.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION).collect()


def _calibrated(leaves: DataFrame, asked: DataFrame, turns: np.ndarray, longest: float, n: int, k: int) -> tuple[int, int]:
    """The longest head, then the fewest probes, at which sampled queries find enough of their true neighbours."""
    head = 1
    while head < SYMBOLS - 1 and n > BUCKET * (2 * DIRECTIONS) ** head:
        head += 1
    sample = _sampled(asked)
    if not sample:
        return head, PROBES[0]
    level = _reached(leaves, sample, turns, longest, k, PROBES[-1])
    if not level.shape[1]:
        return head, PROBES[0]
    while head > 1 and (level[PROBES[0] - 1] >= head).mean() < RECALL:
        head -= 1
    return head, next(p for p in PROBES if (level[p - 1] >= head).mean() >= RECALL)


def _deeper(
    leaves: DataFrame, asked: DataFrame, counts: DataFrame, turns: np.ndarray, longest: float, head: int, k: int, probes: int
) -> list[int]:
    """The levels below the head at which sampled queries with enough candidates there find enough of their neighbours."""
    deeper = []
    for one in range(head + 1, SYMBOLS + 1):
        crowded = counts.where(F.col(_LEVELS[one]) >= len(turns) * EFFORT).select("id")
        sample = _sampled(asked.join(crowded, "id", "left_semi"))
        if not sample or (_reached(leaves, sample, turns, longest, k, probes)[-1] >= one).mean() < RECALL:
            break
        deeper.append(one)
    return deeper


def _searched(
    leaves: DataFrame, asked: DataFrame, hashed: DataFrame, probing: DataFrame, turns: np.ndarray, longest: float, n: int,
    head: int, k: int, probes: int, kind: type,
) -> DataFrame:
    """``id, other, score``: the best leaves that share the head, or a longer prefix, with a probe of the query."""
    trees = len(turns)
    shift = BITS * (SYMBOLS - head)
    headed = F.shiftright("key", shift).alias("head") if head else F.lit(0).cast("long").alias("head")
    if not head:  # the root: one tree holds everything, and one string a query
        hashed, probing = hashed.where("tree = 0"), probing.where("tree = 0").dropDuplicates(["id"])
    parts = F.ceil(F.col("n") / BUCKET).cast("int")
    sizes = common.settle(
        hashed.groupBy("tree", headed).agg(F.count("*").alias("n")).withColumn("parts", parts).drop("n")
    )
    buckets = max(1, trees * n // BUCKET)
    bucket = F.pmod(F.xxhash64("tree", "head", "part"), F.lit(buckets)).cast("int").alias("bucket")
    at = ["id", "tree", "key", "packed", "head"]
    stored = hashed.select("*", headed).join(sizes, ["tree", "head"]).select(
        *at, F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    ).select("*", bucket)
    visits = common.settle(
        probing.select("*", headed)
        .join(sizes, ["tree", "head"])
        .select(*at, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        .select("*", bucket)
    )
    lean = ["bucket", "tree", "key", "id"]
    asking = visits.withColumn("level", F.lit(head))
    if head:
        counted = (
            stored.select(*lean).groupBy("bucket").cogroup(visits.select(*lean).groupBy("bucket"))
            .applyInPandas(_count(head), "id long, " + ", ".join(f"{c} long" for c in _LEVELS))
        )
        counts = common.settle(counted.groupBy("id").agg(*[F.sum(c).alias(c) for c in _LEVELS]))
        level = F.lit(head)
        for one in _deeper(leaves, asked, counts, turns, longest, head, k, probes):  # the last that holds is the deepest
            level = F.when(F.col(_LEVELS[one]) >= trees * EFFORT, one).otherwise(level)
        asking = visits.join(counts.select("id", level.alias("level")), "id")
    found = (
        stored.select(*lean, "packed").groupBy("bucket")
        .cogroup(asking.select(*lean, "packed", "level").groupBy("bucket"))
        .applyInPandas(_score(k + 1, kind), "id long, other long, score double")
    )
    distinct = found.groupBy("id", "other").agg(F.max("score").alias("score"))
    near = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "other"))
    return common.settle(distinct.withColumn("near", near).where(F.col("near") <= k + 1).select("id", "other", "score"))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, trees: int = TREES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of every row whose vec_id divides by ``every``."""
    rows = common.settle(usable(vectors).dropDuplicates(["vec_id", "vector"]))
    place = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    named = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    first = F.first("vec_id").over(W.partitionBy("vector").orderBy("vec_id"))
    members = common.settle(named.withColumn("id", first))
    leaves = common.settle(members.where("place = 1").select("id", "vector"))
    queries = common.settle(
        rows.where(F.col("vec_id") % every == 0).join(leaves, "vector").select(F.col("vec_id").alias("query_id"), "id")
    )
    asked = common.settle(leaves.join(queries.select("id").distinct(), "id", "left_semi"))
    shape = leaves.agg(
        F.count("*").alias("n"), F.max(F.size("vector")).alias("d"),
        F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("square"),
    ).first()
    n, longest = shape["n"], float(shape["square"] or 1.0) ** 0.5
    turns = rotations(shape["d"] or 1, trees)
    head, probes = _calibrated(leaves, asked, turns, longest, n, k) if n else (1, PROBES[0])
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64

    form = "id long, tree int, key long, packed binary"
    hashed = common.settle(leaves.mapInArrow(_hashed(turns, longest, 1, False, kind), form))
    probing = common.settle(asked.mapInArrow(_hashed(turns, longest, probes, True, kind), form))
    best = _searched(leaves, asked, hashed, probing, turns, longest, n, head, k, probes, kind)
    held = members.groupBy(F.col("id").alias("other")).agg(F.count("*").alias("held"))
    others = F.sum("held") - F.max((F.col("other") == F.col("id")).cast("int"))
    while head:
        full = best.join(held, "other").groupBy("id").agg(others.alias("others")).where(F.col("others") >= k)
        short = common.settle(asked.join(full, "id", "left_anti"))
        if short.isEmpty():
            break
        head -= 1
        again = probing.join(short.select("id"), "id", "left_semi")
        more = _searched(leaves, short, hashed, again, turns, longest, n, head, k, probes, kind)
        best = common.settle(best.join(more.select("id").distinct(), "id", "left_anti").unionByName(more))
    named = best.join(members.select(F.col("id").alias("other"), "vec_id"), "other").select("id", "vec_id", "score")
    answers = queries.join(named, "id").where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
