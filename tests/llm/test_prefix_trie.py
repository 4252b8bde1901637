"""The conversation trie against a plain dictionary of prefixes, and the query against its SQL."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaymark.llm import prefix_trie as trie
from quaymark.llm import queries
from tests.compare import connect, difference

FORM = "conv_id long, turn int, role string, text string"


def conversations(rows):
    """Turns of every conversation in order; ties by digest."""
    found = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            found.setdefault(conv_id, []).append((turn is not None, turn, digest, (role, text)))
    return {c: [t[3] for t in sorted(turns, key=lambda t: (t[0], t[1] or 0, t[2]))] for c, turns in found.items()}


def rebuilt(talks):
    out = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = talks.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(talks):
    members = {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for prefix, convs in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(q[:-1] == p and q for q in members)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in convs if len(talks[c]) == len(prefix))))
        parent = min(members[prefix[:-1]]) if prefix else None
        rows.append((min(convs), len(prefix), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def nodes(frame):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=str)


def in_ranges(paths, cuts):
    """The same trie from ranges solved apart and merged, without Spark."""
    members = {}
    for c, path in enumerate(paths):
        members.setdefault(tuple(path), []).append(c)
    rows = [
        (list(p), [s % 7 for s in p], len(c), c[0], hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for p, c in sorted(members.items())
    ]
    cuts = sorted({0, len(rows), *[k % (len(rows) + 1) for k in cuts]})
    out, below, chains, tops = [], [], [], {}
    for shard, (a, b) in enumerate(zip(cuts, cuts[1:])):
        for row in trie._solved(shard, rows[a:b]):
            if row[10] is not None:
                chains.append((row[11]["path"], 2 * shard + row[10], row[11]))
            elif row[4] is None:
                out.append((*row[1:4], *row[5:10]))
            else:
                below.append(row)
    for node in trie.merge_chains((n, c) for _, n, c in sorted(chains, key=lambda x: x[:2])):
        cells = [node[k] for k in ("least", "depth", "parent", "n", "children", "leaves", "saved")]
        out.append((*cells, node["ends"] or trie._NO_IDS))
        tops.update({(number, node["depth"]): node["least"] for number in node["seen"]})
    for row in below:
        up = row[4]
        top = tops[2 * row[0] + (up < 0), up if up >= 0 else -1 - up]
        out.append((row[1], row[2], top, *row[5:10]))
    return sorted(out, key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=6), min_size=1, max_size=30), st.lists(st.integers(0, 60), max_size=8))
def test_ranges_merge_to_the_whole(paths, cuts):
    talks = {c: [(str(s), "x" * (s % 7)) for s in path] for c, path in enumerate(paths)}
    assert in_ranges(paths, cuts) == brute(talks)


def test_medians_first_stay_shallow():
    tree = trie.TernaryTree()
    tree.insert_sorted([([k], [1], 1, k, "") for k in range(4_095)])
    depth, level = 0, [tree.after[0]]
    while level:
        depth, level = depth + 1, [x for v in level for x in (tree.below[v], tree.above[v]) if x]
    assert depth == 12


def talk_rows():
    rows = [(c, t, "user" if t % 2 else "system", f"text {(c % 3) * t}") for c in range(40) for t in range(c % 8)]
    rows += [(c, t, None, None) for c in (41, 45, 46) for t in (None, 2, 2, 1)]
    rows += [(50, 1, "a", "bc"), (51, 1, "ab", "c"), (52, 1, "", "é"), (53, 1, None, "é"), (53, 1, None, "é"), (None, 1, "x", "y"), (-3, 1, "n", "m"), (-7, 0, "n", "m")]
    return rows + [(60 + k, t, "user", "the same") for k in range(60) for t in range(9)]


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_rows_against_brute_force(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = talk_rows()
        frame = spark.createDataFrame(rows, FORM).selectExpr("*", "'x' AS n", "'y' AS path", "'z' AS number", "'d' AS digest")
        talks = conversations([r for r in rows if r[0] is None or r[0] >= 0])
        known = frame.where("conv_id IS NULL OR conv_id >= 0")
        assert nodes(trie.prefix_trie(trie.encoded(known))) == brute(talks)
        assert nodes(trie.prefix_trie(trie.rebuilt(trie.encoded(known)))) == brute(rebuilt(talks))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pieces_of_a_large_group(spark, monkeypatch):
    rows = [(c, t, "user", "same") for c in range(9_000) for t in range(2)]
    found = nodes(trie.prefix_trie(trie.encoded(spark.createDataFrame(rows, FORM))))
    ends = hashlib.sha256(",".join(map(str, range(9_000))).encode()).hexdigest()
    assert found == sorted([(0, 0, None, 9_000, 1, 1, 2 * 8_999 * 4, trie._NO_IDS), (0, 1, 0, 9_000, 1, 1, 2 * 8_999 * 4, trie._NO_IDS), (0, 2, 0, 9_000, 0, 1, 8_999 * 4, ends)], key=str)


def test_one_long_conversation_and_no_rows(spark):
    rows = [(7, t, "user", f"t{t}") for t in range(3_000)] + [(8, t, "user", f"t{t}") for t in range(2_000)]
    found = {(r["conv_id"], r["depth"]): r for r in trie.prefix_trie(trie.encoded(spark.createDataFrame(rows, FORM))).collect()}
    assert len(found) == 3_001 and found[7, 2_000]["n_convs"] == 2 and found[7, 2_001]["n_convs"] == 1
    assert found[7, 0]["saved_tokens"] == sum(len(f"t{t}") for t in range(2_000))
    assert trie.prefix_trie(trie.rebuilt(trie.encoded(spark.createDataFrame([], FORM)))).collect() == []


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    run, sql = queries.op11_prefix_trie, queries.ORACLES["op11_prefix_trie"]
    assert difference(spark, connect(folder), "op11", run, sql, folder) is None
