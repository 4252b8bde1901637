"""Similarity self-join of documents on word shingles: Jaccard at least ``SIMILARITY``, by chosen paths.

Sets of five-word shingles are embedded as ``TOKENS`` tokens (coordinate, least hash under it), so that two sets
share tokens in proportion to their similarity. A set stays in the search only if enough of its tokens occur in other
sets for a pair to pass. A run splits all sets on a few sampled tokens: at every node the
same coordinates are drawn for all its sets, each with probability ``1 / (SIMILARITY * TOKENS)``, and sets that
share the token go on together. Earlier runs leave groups; a bucket is small if at most ``SMALL`` of its sets are outside
the group that has most there, and then those are compared with all of it by brute force on the embedded sets. Others are
split further, up to ``DEPTH`` times, and what then is still together stays one candidate group. Runs repeat until
a pair at the threshold is met with probability ``TARGET``, averaged over the tokens such a pair shares (all runs use
the same embedding). The ``FIRST`` runs only make groups. Two sets that share a large bucket after the first split of a
later run may need all ``DEPTH``, where a run keeps fewer pairs: every set that was in one takes part in further runs.

Candidate pairs are kept as connections, not as all pairs. Connected candidates form groups, and inside a group
every pair is verified on the exact shingle sets, in blocks of ``BLOCK`` documents, so no link found by chance only
once is lost and no link is counted twice. Documents with equal shingle sets are joined once, as a class with a
count. A group's work grows with the pairs it holds and its rows with its size times its number of blocks; a task holds two
blocks at once. A bucket whose sets earlier runs put into one candidate group connects nothing more and is split no further.

Result: one row per document, ``doc_id, class_id`` (least doc_id among all documents connected by links),
``n_links`` (other documents at or above the threshold), ``n_shingles``.
Defined results: words are what ASCII white space separates; a text of fewer than five words is one shingle of all
of them; a text without words has no links and is its own class; rows without a doc_id are left out; rows that repeat
a doc_id and its text are copies of each other (with another text, a doc_id stands for one of its texts); an empty
table gives no rows; other columns are ignored.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm import common
from quaymark.llm.components import components
from quaymark.llm.shingles import mixed, shingle_sets

SIMILARITY = 0.8
TOKENS = 40
TARGET = 0.999
DEPTH = 6
SMALL = 256
#: Runs that only make groups, before those that the target is computed for.
FIRST = 3
#: Sets of a bucket's main group that a task holds at once.
PART = 4096
#: Brute force on embedded sets lets pairs pass from this share of equal tokens on: four deviations below.
PASSES = 0.54
BLOCK = 256
_COLUMNS = 4096

_SEEDS = mixed(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _shared() -> list[tuple[int, float]]:
    """How many equal tokens a pair at the threshold has, with the chance of each number."""
    chance = lambda m: math.comb(TOKENS, m) * SIMILARITY**m * (1 - SIMILARITY) ** (TOKENS - m)
    return [(m, chance(m)) for m in range(TOKENS + 1)]


def missed(n_runs: int, depth: int) -> float:
    """The chance that no run keeps a pair at the threshold through ``depth`` splits or its tokens don't pass then."""
    lost = 0.0
    for m, chance in _shared():
        kept = 1.0
        for _ in range(depth):
            kept = 1 - (1 - kept / (SIMILARITY * TOKENS)) ** m
        lost += chance * ((1 - kept) ** n_runs if m >= PASSES * TOKENS else 1.0)
    return lost


def runs(target: float = TARGET) -> tuple[int, int]:
    """Runs over all sets, and how many there are in all for sets from large buckets.

    A pair is missed if its tokens don't pass, if no run over all sets after the ``FIRST`` ones keeps it through the first split (at most a
    twentieth of the misses allowed), or if every run loses it on the way to ``DEPTH``.
    """
    apart = sum(chance for m, chance in _shared() if m < PASSES * TOKENS)
    if 1 - target <= apart:
        raise ValueError(f"a target above {1 - apart} needs more tokens")
    spare = 1 - target - apart
    second = next(n for n in range(1, 10_000) if missed(n, 1) - apart <= spare / 20)
    every = FIRST + second
    crowded = next(n for n in range(every, 10_000) if missed(n, DEPTH) - apart + missed(second, 1) - apart <= spare)
    return every, crowded


def embedded(shingles: np.ndarray) -> np.ndarray:
    """The least hash of a set under each coordinate."""
    out = np.empty(TOKENS, np.uint64)
    for i in range(TOKENS):
        x = (shingles ^ _SEEDS[i]) * np.uint64(0x9FB21C651E98DF25)
        out[i] = (x ^ (x >> np.uint64(32))).min()
    return mixed(out)


def _embed(batches):
    for batch in batches:
        sets = shingle_sets(batch.column(1).to_pylist())
        sizes = [len(s) for s in sets]
        sums = [mixed(s * np.uint64(3) + np.uint64(1)).sum(dtype=np.uint64) if len(s) else np.uint64(0) for s in sets]
        tokens = np.array([embedded(s) if len(s) else np.zeros(TOKENS, np.uint64) for s in sets], np.uint64)
        tokens = tokens.reshape(-1, TOKENS)
        mark = np.array(sums, np.uint64).view(np.int64)
        first = np.array([s[0] if len(s) else 0 for s in sets], np.uint64).view(np.int64)
        flat = pa.array(tokens.view(np.int64).ravel())
        offsets = pa.array(np.arange(0, (len(sets) + 1) * TOKENS, TOKENS, dtype=np.int32))
        listed = pa.ListArray.from_arrays(offsets, flat)
        columns = [batch.column(0), pa.array(sizes, pa.int32()), pa.array(mark), pa.array(first), listed]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "mark", "first", "tokens"])


def _chosen(path, seed: int):
    """The coordinates a node splits on: the same for all of its sets."""
    limit = int(2**31 / (SIMILARITY * TOKENS))
    draw = lambda i: F.pmod(F.xxhash64(path, i, F.lit(seed)), F.lit(2**31)) < limit
    return F.filter(F.sequence(F.lit(0), F.lit(TOKENS - 1)), draw)


def _split(rows: DataFrame, seed: int) -> DataFrame:
    """``path, rep, root, sketch, tokens`` -> the children of every row's node."""
    step = F.explode(_chosen(F.col("path"), seed)).alias("i")
    child = F.xxhash64("path", "i", F.element_at("tokens", F.col("i") + 1))
    return rows.select("path", "rep", "root", "sketch", "tokens", step).select(child.alias("path"), "rep", "root", "sketch")


def _connected(near: np.ndarray) -> np.ndarray:
    """The least index each row of a symmetric adjacency is connected to."""
    label = np.arange(len(near))
    while True:
        least = np.where(near, label[None, :], len(near)).min(1)
        least = np.minimum(label, least)
        least = least[least]
        if np.array_equal(least, label):
            return label
        label = least


def _compare(batches):
    """Rows sorted by path and part: connections between the groups that have sets there which pass on their tokens.

    The sets of the bucket's main group are one node: only sets of other groups are held against all.
    """
    held: list = []

    def parts(key, root, main, sketch):
        cut = np.flatnonzero((np.diff(key[0]) != 0) | (np.diff(key[1]) != 0)) + 1
        for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(root)]])):
            rest, whole = np.flatnonzero(~main[a:b]), sketch[a:b]
            if not len(rest) or b - a < 2:
                continue
            same = np.zeros((len(rest), b - a), np.int16)
            for c in range(TOKENS):
                same += whole[rest, c][:, None] == whole[:, c][None, :]
            passes = same >= PASSES * TOKENS
            near = np.zeros((len(rest) + 1, len(rest) + 1), bool)
            near[1:, 1:] = passes[:, rest]
            near[0, 1:] = near[1:, 0] = passes[:, main[a:b]].any(1)
            first = root[a:b][main[a:b]][:1] if main[a:b].any() else root[a:b][rest[:1]]
            ids, label = np.concatenate([first, root[a:b][rest]]), _connected(near)
            far = ids != ids[label]
            yield ids[far], ids[label[far]]

    def flush(*columns):
        found = list(parts(columns[:2], *columns[2:]))
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    for batch in batches:
        if not len(batch):
            continue
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        rows.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, TOKENS))
        if held:
            rows = [np.concatenate([h, x]) for h, x in zip(held, rows)]
        path, part = rows[:2]
        done = int(np.flatnonzero((path != path[-1]) | (part != part[-1]))[-1]) + 1 if (path[0], part[0]) != (path[-1], part[-1]) else 0
        held = [x[done:] for x in rows]
        yield flush(*(x[:done] for x in rows))
    if held:
        yield flush(*held)


def _met(reps: DataFrame, first: int, last: int) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """The runs from ``first`` to ``last``: small buckets, connections of large ones, sets in large ones after a split.

    ``reps`` carry the ``root`` of the group that earlier runs put them in. A bucket's main group is the one with most
    sets in it; the bucket is small if at most ``SMALL`` sets are of other groups, and ends there if none is. So a crowd
    of near copies goes through a few runs and not through all.
    """
    roots = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("path")
    level = reps.select(roots, "rep", "root", "sketch", "tokens")
    leaves, connected = [], []
    for depth in range(1, DEPTH + 1):
        rows = _split(level, depth)
        if depth > 1:  # a node that splits on nothing ends here
            rows = rows.distinct()
        rows = common.settle(rows)
        held = rows.groupBy("path", "root").agg(F.count("*").alias("n")).groupBy("path")
        sizes = held.agg(F.count("*").alias("_groups"), F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("most"))
        sizes = sizes.where("_groups > 1").select(
            "path", F.col("most.root").alias("main"), F.col("most.n").alias("n_main"), (F.col("size") - F.col("most.n")).alias("n_rest")
        )
        met = common.settle(rows.join(common.settle(sizes), "path"))
        leaves.append(met.where(F.col("n_rest") <= SMALL).select("path", "rep", "root", "sketch", "main", "n_main"))
        large = met.where(F.col("n_rest") > SMALL)
        if depth == 1:
            crowded = large.select("rep").distinct()
        if depth == DEPTH:
            connected.append(large.select(F.col("root").alias("a"), F.col("main").alias("b")))
        elif large.isEmpty():
            break
        else:
            level = large.select("path", "rep", "root", "sketch").join(reps.select("rep", "tokens"), "rep")
    small = leaves[0]
    for more in leaves[1:]:
        small = small.unionByName(more)
    return small, connected, crowded


def _compared(small: DataFrame, connected: list[DataFrame]) -> DataFrame:
    """``a, b``: connections between groups, by sets that pass in small buckets or are still together in large ones.

    A large main group is dealt to parts of ``PART`` sets; the few sets of other groups go to every part.
    """
    parts, is_main = F.ceil(F.col("n_main") / PART).cast("int"), F.col("root") == F.col("main")
    own = F.pmod(F.xxhash64("rep"), parts).cast("int")
    part = F.explode(F.when(is_main, F.array(own)).otherwise(F.sequence(F.lit(0), parts - 1))).alias("part")
    dealt = small.select("path", part, "root", is_main.alias("is_main"), "sketch")
    dealt = dealt.repartition("path", "part").sortWithinPartitions("path", "part")
    compared = dealt.mapInArrow(_compare, "a long, b long")
    for more in connected:
        compared = compared.unionByName(more)
    return compared.where("a <> b").distinct()


def _grouped(reps: DataFrame, edges: DataFrame) -> DataFrame:
    """``reps`` with the roots of their groups after ``edges`` between the roots they had."""
    found = components(edges).withColumnRenamed("root", "_further")
    joined = reps.join(found, F.col("root") == F.col("node"), "left")
    return common.settle(joined.withColumn("root", F.coalesce("_further", "root")).select(*reps.columns))


def _sketch():
    """The last byte of every token."""
    return F.expr("unhex(array_join(transform(tokens, t -> lpad(hex(t & 255), 2, '0')), ''))")


def _in_company(reps: DataFrame) -> DataFrame:
    """The sets that hold enough tokens which other sets hold too; without them no pair with a set passes."""
    named = F.explode(F.expr("transform(tokens, (t, i) -> xxhash64(i, t))")).alias("token")
    held = common.settle(reps.select("rep", named))
    shared = held.groupBy("token").count().where("count > 1").select("token")
    enough = held.join(shared, "token").groupBy("rep").count().where(F.col("count") >= PASSES * TOKENS)
    return common.settle(reps.join(enough.select("rep"), "rep", "left_semi").withColumn("sketch", _sketch()))


def _candidates(reps: DataFrame, n_runs: tuple[int, int]) -> DataFrame:
    """``node, root``: groups of two and more, such that every pair met by a run is in one group.

    Runs come in three parts; after each, later buckets and connections are between groups and no longer between sets.
    """
    every, most = n_runs
    now = reps.withColumn("root", F.col("rep"))
    for first, last in [(1, FIRST), (FIRST + 1, every), (every + 1, most)]:
        taking = now
        if first > every:
            taking = common.settle(now.join(crowded, "rep", "left_semi"))
            if taking.isEmpty():
                break
        small, connected, crowded = _met(taking, first, last)
        now = _grouped(now, common.settle(_compared(small, connected)))
    groups = now.select(F.col("rep").alias("node"), "root")
    return groups.join(groups.groupBy("root").count().where("count > 1").select("root"), "root")


def _shingled(batches):
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["rep", "shingles"])


def links_within(sets: list[np.ndarray], split: int | None = None) -> np.ndarray:
    """Which pairs are similar enough; with ``split``, only pairs of one before it and one from it on."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    tokens, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[place] > 1
    ids = np.cumsum(seen > 1) - 1
    owner, place = owner[shared], ids[place[shared]]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    width = int((seen > 1).sum())
    for at in range(0, width, _COLUMNS):
        a, b = np.searchsorted(place, [at, at + _COLUMNS])
        part = np.zeros((n, min(_COLUMNS, width - at)), np.float32)
        part[owner[a:b], place[a:b] - at] = 1
        both += part @ part.T
    near = both >= SIMILARITY * (sizes[:, None] + sizes[None, :] - both) - 1e-3
    np.fill_diagonal(near, False)
    if split is not None:
        near[:split, :split] = near[split:, split:] = False
    return near


def _verify(batches):
    """Rows sorted by group and block pair: exact links of every pair, as counts and connections."""
    held: list = []

    def settle(rows):
        rows.sort(key=lambda r: (r[1], r[2]))
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        split = sum(r[1] == rows[0][1] for r in rows) if rows[0][5] else None
        near = links_within(sets, split)
        copies = np.array([r[3] for r in rows], np.int64)
        label = _connected(near)
        return [(r[2], rows[k][2], int(n)) for r, k, n in zip(rows, label, near @ copies) if n]

    def emit(found):
        columns = list(zip(*found)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "links"])

    for batch in batches:
        found, names = [], ["key", "block", "rep", "copies", "shingles", "mixed"]
        for row in zip(*(batch.column(n).to_pylist() for n in names)):
            if held and held[0][0] != row[0]:
                if len(held) > 1:
                    found += settle(held)
                held = []
            held.append(row)
        yield emit(found)
    if len(held) > 1:
        yield emit(settle(held))


def _verified(docs: DataFrame, reps: DataFrame, groups: DataFrame) -> DataFrame:
    """``a, b, links`` of the representatives in candidate groups."""
    sizes = common.settle(groups.groupBy("root").agg(F.count("*").alias("size")))
    member = common.settle(
        groups.join(sizes, "root")
        .join(reps.select("rep", "copies", "mark", "first"), F.col("node") == F.col("rep"))
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .select("root", "rep", "copies", "blocks", "block")
    )
    texts = docs.select(F.col("doc_id").alias("rep"), common.whole_text().alias("text"))
    wanted = member.select("rep").hint("merge")  # the same plan at every size
    sets = common.settle(
        texts.join(wanted, "rep", "left_semi").mapInArrow(_shingled, "rep long, shingles binary").dropDuplicates(["rep"])
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = member.withColumn("other", other).select(
        F.xxhash64("root", low, high).alias("key"), "block", "rep", "copies", (F.col("block") != F.col("other")).alias("mixed")
    )
    ready = dealt.join(sets, "rep").select("key", "block", "rep", "copies", "shingles", "mixed")
    ready = ready.repartition("key").sortWithinPartitions("key")
    return common.settle(ready.mapInArrow(_verify, "a long, b long, links long"))


def join(docs: DataFrame, target: float = TARGET) -> DataFrame:
    """``doc_id, class_id, n_links, n_shingles`` of every document."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    form = "doc_id long, n int, mark long, first long, tokens array<long>"
    rows = common.settle(named.select("doc_id", common.whole_text().alias("text")).mapInArrow(_embed, form))
    same = ["n", "mark", "first"]
    grouped = common.settle(
        rows.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    )
    tokens = rows.select(F.col("doc_id").alias("rep"), *[F.col(c).alias(f"_{c}") for c in same], "tokens")
    is_rep = (F.col("rep") == F.col("_rep")) & F.expr(" AND ".join(f"{c} = _{c}" for c in same))
    reps = common.settle(
        grouped.withColumnRenamed("rep", "_rep").join(tokens, is_rep).select("rep", "copies", *same, "tokens")
        .dropDuplicates(["rep"])
    )
    groups = _candidates(_in_company(reps), runs(target))
    found = _verified(named, reps, common.settle(groups))
    linked = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    classes = components(found.select("a", "b")).withColumnRenamed("node", "rep")
    verdict = common.settle(
        grouped.join(linked, "rep", "left").join(classes, "rep", "left").select(
            *same, F.coalesce("root", "rep").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    return rows.select("doc_id", *same).join(verdict, same, "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("n").alias("n_shingles"),
    )


def representatives(docs: DataFrame) -> DataFrame:
    """The rows that stay when one document of each class does, with their columns: the least doc_id, null last.

    Rows that repeat a doc_id or have none are judged one by one.
    """
    if not common.told_apart(docs):
        return common.one_of_each(docs, lambda rows: join(rows).select("doc_id", F.col("class_id").alias("class")))
    dropped = common.settle(join(docs).where("doc_id <> class_id").select("doc_id"))
    return docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
