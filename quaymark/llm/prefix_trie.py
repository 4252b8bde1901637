"""Conversation prefix trie: ternary search trees over dictionary-encoded turns, one for each range of conversations.

A turn is its role and text. Turns are told apart by SHA-256 and numbered by a dictionary table, so a conversation is
an array of numbers and no text is shuffled. Equal conversations become one sequence with a count. Sequences are sorted and
dealt out by range; a task inserts its range into a ternary search tree, medians first, so that the turns which
follow a common prefix form a balanced search tree. An iterative traversal then accumulates, for every node, its
members, smallest member, children, leaves and saved tokens.

Only the prefixes of a range's first and last sequence can go on in other ranges. These boundary nodes leave the task
unfinished, as one chain of numbers for either end. One pass over the sorted chains (two rows for each range) with
a stack as deep as the trie merges them; the nodes right below take their parent's smallest member from the result by
range.

Which conversations end at a node is a hash over all their ids. Ids are sorted by range too, so those of one sequence
may lie in many tasks; each writes them out in pieces of ``PIECE`` ids, and one task streams the pieces through SHA-256.

Held in one task: the sequences of one range, one conversation's numbers (8 bytes a turn), two chains for each range.

Defined results: a null role or text is empty; turns are ordered by turn, null first, and then by the digest of role and text;
rows that repeat a turn are turns of their own; rows without a conv_id are left out; an empty table gives no rows, not even a
root; other columns are ignored.
"""

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quaymark.llm import common

#: Turns that a range should hold.
RANGE = 200_000
#: Conversation ids that are written out together.
PIECE = 4_096
#: A turn with more than this share of all rows is looked up apart from the rest: at most its inverse many.
OFTEN = 0.001
FAMILY, HEAD = 5, 9
_BATCH = 10_000
_NO_IDS = hashlib.sha256(b"").hexdigest()


def encoded(conversations: DataFrame) -> DataFrame:
    """``conv_id, path, sizes``: every conversation's turns as numbers, and the UTF-8 bytes of their texts."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = common.settle(
        conversations.where("conv_id IS NOT NULL").select(
            F.col("conv_id").cast("long").alias("conv_id"), "turn",
            F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
            F.octet_length(text).cast("long").alias("size"),
        )
    )
    counted = turns.groupBy("digest").agg(F.count("*").alias("uses"))
    numbers = common.settle(counted.withColumn("number", F.monotonically_increasing_id()))
    limit = turns.count() * OFTEN
    often = F.broadcast(numbers.where(F.col("uses") > limit).select("digest", "number"))  # 1 / OFTEN rows at most
    seldom = numbers.where(F.col("uses") <= limit).select("digest", "number").hint("merge")
    numbered = turns.join(often, "digest").unionByName(turns.join(often, "digest", "left_anti").join(seldom, "digest"))
    inside = F.sort_array(F.collect_list(F.struct("turn", "digest", "number", "size")))
    return numbered.groupBy("conv_id").agg(inside.alias("turns")).select(
        "conv_id", F.col("turns.number").alias("path"), F.col("turns.size").alias("sizes")
    )


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Every conversation with its first turns (crc32 of its id, modulo ``HEAD``) taken from the first one of its family of five."""
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEAD)).cast("int")
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = common.settle(sequences.withColumns({"first": first, "head": head}))
    begun = own.select(
        F.col("conv_id").alias("first"), F.slice("path", 1, HEAD).alias("begun"), F.slice("sizes", 1, HEAD).alias("begun_sizes")
    )
    none = F.array().cast("array<long>")

    def spliced(begin: str, rest: str) -> Column:
        return F.concat(F.slice(F.coalesce(begin, none), F.lit(1), F.col("head")), F.slice(rest, F.col("head") + 1, F.size(rest)))

    return own.join(begun, "first", "left").select(
        "conv_id", spliced("begun", "path").alias("path"), spliced("begun_sizes", "sizes").alias("sizes")
    )


_ENDS = "path array<long>, sizes array<long>, n long, least long, ids string"


def _pieces(batches):
    """Rows sorted by path and conv_id: the ids of each path, in pieces."""
    types = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
    names = ["path", "sizes", "n", "least", "ids"]
    path, sizes, ids, out = None, None, [], []

    def close():
        if ids:
            out.append((path, sizes, len(ids), ids[0], ",".join(map(str, ids))))
            ids.clear()

    def flush():
        columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        for conv_id, own, own_sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "sizes"))):
            if own != path or len(ids) >= PIECE:
                close()
                path, sizes = own, own_sizes
            ids.append(conv_id)
        if len(out) >= _BATCH:
            yield flush()
    close()
    if out:
        yield flush()


_SEQUENCE = "path array<long>, sizes array<long>, n long, least long, ends_sha256 string"


def _hashed(batches):
    """Pieces sorted by path and first id: one row for each path, its ids streamed through SHA-256."""
    types = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
    names = ["path", "sizes", "n", "least", "ends_sha256"]
    held, digest = None, None
    for batch in batches:
        out = []
        for path, sizes, n, least, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "sizes", "n", "least", "ids"))):
            if held and held[0] == path:
                held[2] += n
                digest.update(b"," + ids.encode())
                continue
            if held:
                out.append((*held, digest.hexdigest()))
            held, digest = [path, sizes, n, least], hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*held, digest.hexdigest()), types)], names)


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """``path, sizes, n, least, ends_sha256``: equal conversations as one row."""
    order = ["path", "conv_id"]
    pieces = sequences.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, _ENDS)
    joined = pieces.repartition("path").sortWithinPartitions("path", "least")
    return joined.mapInArrow(_hashed, _SEQUENCE)


class TernaryTree:
    """A trie of number sequences; the turns that may follow a prefix are a binary search tree of nodes.

    Node 0 is the textless root. ``after[v]`` is the search tree of the turns below v, ``below`` and ``above`` are the
    two sides of a search node.
    """

    def __init__(self):
        self.symbol, self.after, self.below, self.above = [0], [0], [0], [0]
        self.size, self.n, self.least, self.ends = [0], [0], [None], [None]

    def _new(self, symbol: int, size: int) -> int:
        for column, value in (
            (self.symbol, symbol), (self.after, 0), (self.below, 0), (self.above, 0),
            (self.size, size), (self.n, 0), (self.least, None), (self.ends, None),
        ):
            column.append(value)
        return len(self.symbol) - 1

    def insert(self, path, sizes, n: int, least: int, ends: str) -> None:
        symbols, below, above = self.symbol, self.below, self.above
        at = 0
        for symbol, size in zip(path, sizes):
            side, up, v = self.after, at, self.after[at]
            while v and symbols[v] != symbol:
                side, up = (below, v) if symbol < symbols[v] else (above, v)
                v = side[v]
            if not v:
                v = self._new(symbol, size)
                side[up] = v
            at = v
        self.n[at], self.least[at], self.ends[at] = n, least, ends

    def insert_sorted(self, rows: list) -> None:
        """Medians first, so that every search tree stays about as deep as the logarithm of its turns."""
        waiting = [(0, len(rows))]
        for a, b in waiting:
            if a < b:
                self.insert(*rows[(a + b) // 2])
                waiting += [(a, (a + b) // 2), ((a + b) // 2 + 1, b)]

    def preorder(self) -> tuple[list[int], list[int]]:
        """Nodes before all that follow them, and the parent of every node."""
        order, parent, stack = [], [-1] * len(self.symbol), [(0, -1)]
        while stack:
            v, up = stack.pop()
            parent[v] = up
            order.append(v)
            search = [self.after[v]] if self.after[v] else []
            for w in search:
                search += [x for x in (self.below[w], self.above[w]) if x]
            stack += [(w, v) for w in search]
        return order, parent


_NODES = (
    "shard int, conv_id long, depth long, parent_conv_id long, up int, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, side int, chain struct<path: array<long>, n: array<long>, least: array<long>, "
    "children: array<long>, leaves: array<long>, saved: array<long>, sizes: array<long>, ends: array<string>>"
)
_LONGS = pa.list_(pa.int64())
_CHAIN = pa.struct(
    [(c, _LONGS) for c in ("path", "n", "least", "children", "leaves", "saved", "sizes")] + [("ends", pa.list_(pa.string()))]
)
_NODE_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.int32(), _CHAIN]
_NODE_NAMES = [
    "shard", "conv_id", "depth", "parent_conv_id", "up", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    "side", "chain",
]


def _common(a: list, b: list) -> int:
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def _solved(shard: int, rows: list):
    """The finished nodes of a range, then the chains of its first and last sequence.

    A finished node whose parent lies on a chain names it by ``up``: the parent's depth on the first chain, or on the last
    one where that is less than 0 (-1 - depth). Nodes of both chains belong to the first.
    """
    tree = TernaryTree()
    tree.insert_sorted(rows)
    order, parent = tree.preorder()
    first, last = rows[0][0], rows[-1][0]
    chains, on_chain = [], {}
    for side, path in enumerate((first, last)):
        v, chain = 0, [0]
        for symbol in path:
            v = tree.after[v]
            while tree.symbol[v] != symbol:
                v = tree.below[v] if symbol < tree.symbol[v] else tree.above[v]
            chain.append(v)
        chains.append(chain)
        for depth, v in enumerate(chain):
            on_chain.setdefault(v, (side, depth))
    count = len(order)
    members, least = list(tree.n), list(tree.least)
    children, leaves, saved, depths = [0] * count, [0] * count, [0] * count, [0] * count
    for v in order[1:]:
        depths[v] = depths[parent[v]] + 1
    for v in reversed(order):
        if v not in on_chain:  # a chain's own share is known after merging
            saved[v] += (members[v] - 1) * tree.size[v]
            leaves[v] += not children[v]
        up = parent[v]
        if up >= 0:
            members[up] += members[v]
            if least[up] is None or least[v] < least[up]:
                least[up] = least[v]
            if v not in on_chain:  # shares below a chain's node are summed up when chains are merged
                leaves[up] += leaves[v]
                saved[up] += saved[v]
                children[up] += 1
    for v in order:
        if v in on_chain:
            continue
        at = on_chain.get(parent[v])
        up = None if at is None else at[1] if at[0] == 0 else -1 - at[1]
        yield (
            shard, least[v], depths[v], least[parent[v]] if at is None else None, up, members[v], children[v], leaves[v], saved[v],
            tree.ends[v] or _NO_IDS, None, None,
        )
    for side, (path, chain) in enumerate(zip((first, last), chains)):
        mine = [on_chain[v][0] == side for v in chain]
        told = lambda values: [x if m else 0 for x, m in zip(values, mine)]
        yield (shard, *[None] * 9, side, {
            "path": path, "n": told([members[v] for v in chain]),
            "least": [least[v] for v in chain], "children": told([children[v] for v in chain]),
            "leaves": told([leaves[v] for v in chain]), "saved": told([saved[v] for v in chain]),
            "sizes": [tree.size[v] for v in chain], "ends": [tree.ends[v] for v in chain],
        })


def _grow(batches):
    rows = []
    for batch in batches:
        rows += zip(*(batch.column(c).to_pylist() for c in ("path", "sizes", "n", "least", "ends_sha256")))
    if not rows:
        return
    out = []
    for row in _solved(TaskContext.get().partitionId(), rows):
        out.append(row)
        if len(out) >= _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _NODE_TYPES)], _NODE_NAMES)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _NODE_TYPES)], _NODE_NAMES)


_MERGED = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, chain long, at long"
_MERGED_NAMES = [c.split()[0] for c in _MERGED.split(", ")]
_MERGED_TYPES = [*[pa.int64()] * 7, pa.string(), *[pa.int64()] * 2]


def merge_chains(chains):
    """Sorted ``(chain number, chain)`` -> nodes on them, and for every depth of every chain the node's smallest member.

    The stack holds the nodes of the current chain; a node is finished when the next chain leaves it. A node waits
    for its parent's smallest member, which is known when that is finished: rows go out then. What waits are the nodes of open
    parents, so the children on chains of one node at most.
    """
    stack: list[dict] = []

    def finish(node):
        leaf = not node["children"]
        node["leaves"] += leaf
        node["saved"] += (node["n"] - 1) * node["size"]
        for child in node["waiting"]:
            child["parent"] = node["least"]
            yield child
        if stack:
            up = stack[-1]
            up["children"] += 1
            up["leaves"] += node["leaves"]
            up["saved"] += node["saved"]
            up["waiting"].append({k: node[k] for k in ("least", "depth", "n", "children", "leaves", "saved", "ends", "seen")})
        else:
            yield {**node, "parent": None}

    path: list = []
    for number, chain in chains:
        shared = _common(path, chain["path"]) if stack else -1
        while len(stack) > shared + 1:
            yield from finish(stack.pop())
        for depth in range(len(chain["path"]) + 1):
            if depth == len(stack):
                stack.append({
                    "depth": depth, "size": chain["sizes"][depth], "least": chain["least"][depth], "ends": None, "n": 0,
                    "children": 0, "leaves": 0, "saved": 0, "seen": [], "waiting": [],
                })
            node = stack[depth]
            for key in ("n", "children", "leaves", "saved"):
                node[key] += chain[key][depth]
            node["least"] = min(node["least"], chain["least"][depth])
            node["ends"] = node["ends"] or chain["ends"][depth]
            node["seen"].append(number)
        path = chain["path"]
    while stack:
        yield from finish(stack.pop())


def _merge(batches):
    def chains():
        for batch in batches:
            for shard, side, chain in zip(*(batch.column(c).to_pylist() for c in ("shard", "side", "chain"))):
                yield 2 * shard + side, chain

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _MERGED_TYPES)], _MERGED_NAMES)

    out = []
    for node in merge_chains(chains()):
        cells = [node[k] for k in ("least", "depth", "parent", "n", "children", "leaves", "saved")]
        out.append((*cells, node["ends"] or _NO_IDS, None, None))
        # where ranges look up the smallest member of this node
        out += [(node["least"], node["depth"], *[None] * 6, number, node["depth"]) for number in node["seen"]]
        if len(out) >= _BATCH:
            yield batch_of(out)
            out = []
    if out:
        yield batch_of(out)


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """``conv_id, path, sizes`` -> one row for every distinct prefix.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``.
    """
    spark = sequences.sparkSession
    different = common.settle(distinct_sequences(sequences))
    turns = different.agg(F.sum(F.size("path") + 1)).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // RANGE))
    dealt = different.repartitionByRange(ranges, "path").sortWithinPartitions("path")
    grown = common.settle(dealt.mapInArrow(_grow, _NODES))
    chains = grown.where("side IS NOT NULL").select("shard", "side", "chain")  # two rows for each range
    sorted_chains = chains.repartition(1).sortWithinPartitions("chain.path", "shard", "side")
    merged = common.settle(sorted_chains.mapInArrow(_merge, _MERGED))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = grown.where("side IS NULL")
    # Found by range and depth: no key has more rows than a range has nodes.
    tops = merged.where("chain IS NOT NULL").select("chain", "at", F.col("conv_id").alias("top"))
    below = nodes.where("up IS NOT NULL").withColumns({
        "chain": F.col("shard").cast("long") * 2 + F.when(F.col("up") < 0, 1).otherwise(0),
        "at": F.when(F.col("up") < 0, -1 - F.col("up")).otherwise(F.col("up")).cast("long"),
    })
    found = below.join(tops, ["chain", "at"]).withColumn("parent_conv_id", F.col("top"))
    inner = nodes.where("up IS NULL").select(*names).unionByName(found.select(*names))
    return inner.unionByName(merged.where("chain IS NULL").select(*names))
