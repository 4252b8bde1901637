"""Periodic runs against brute force, and the query against its SQL."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaymark.llm import queries, runs
from tests.compare import connect, difference
from tests.llm.fixtures import documents, no_rows, odd_rows


def brute(words):
    """Every run as start, period, length: intervals of each period, the smallest period of equal stretches."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i - s + p >= max(6, 4 * p):
                found.setdefault((s, i + p), p)
    return sorted((s, p, e - s) for (s, e), p in found.items())


def from_fragments(codes):
    out = []
    for pieces in runs.fragments(codes):
        found, by_period = [], {}
        for p, s, e in pieces:
            by_period.setdefault(p, []).append((s, e))
        for p, parts in by_period.items():
            chains = []
            for s, e in sorted(parts):
                if chains and s <= chains[-1][1]:
                    chains[-1][1] = max(e, chains[-1][1])
                else:
                    chains.append([s, e])
            found += [(s, p, e - s + p) for s, e in chains if e - s + p >= max(6, 4 * p)]
        out.append(sorted(found))
    return out


def collapsed(words, found):
    drop = {i for s, p, length in found for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def noisy(rng, n):
    """Repeated blocks of blocks with a few changed words."""
    words = []
    while len(words) < n:
        block = rng.integers(0, 3, rng.integers(1, 40)).tolist()
        words += block * int(rng.integers(1, 12))
        if rng.random() < 0.3:
            words = words * 2
    words = words[:n]
    for i in rng.integers(0, n, int(rng.integers(0, 3))):
        words[i] = 7
    return words


blocks = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 15)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(blocks, max_size=5), st.sampled_from([1, 2, 64]))
def test_fragments_make_up_all_runs(texts, boundaries):
    runs.BOUNDARIES, before = boundaries, runs.BOUNDARIES
    try:
        docs = [[w for block, n in text for w in block * n] for text in texts]
        assert from_fragments([np.array(d, np.int64) for d in docs]) == [brute(d) for d in docs]
    finally:
        runs.BOUNDARIES = before


def test_long_noisy_documents():
    rng = np.random.default_rng(5)
    docs = [noisy(rng, int(n)) for n in rng.integers(1, 4_000, 25)] + [[1] * 3_000, [1, 2, 3] * 900, [], [1], [1] * 5, [1] * 6]
    assert from_fragments([np.array(d, np.int64) for d in docs]) == [brute(d) for d in docs]


def test_one_word_a_million_times():
    words = np.zeros(1_000_000, np.int64)
    words[700_000] = 1
    (found,) = from_fragments([words])
    assert found == [(0, 1, 700_000), (700_001, 1, 299_999)]


def test_planted_places():
    doc_id = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    g, n = zlib.crc32(str(doc_id).encode()) // 10, 1_000
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    assert runs.planted(doc_id, n).tolist() == [i if i < a else a + (i - a) % p for i in range(n)]
    assert runs.planted(doc_id, 0) is None and runs.planted(None, 10).tolist() == [0, 1, 2, 3] * 2 + [0, 1]


def expected(doc_id, text, order=runs.planted):
    words = (text or "").encode().split()
    places = order(doc_id, len(words)) if order else None
    words = [w.decode() for w in (words if places is None else [words[i] for i in places])]
    found = brute(words)
    top = min(found, key=lambda r: (-r[2] / r[1], r[0], r[1]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{length},{p}\n" for s, p, length in found)
    cells = (top[0], top[2], top[1], 1000 * top[2] // top[1]) if top else (None,) * 4
    return (doc_id, len(found), *cells, sha(lines), sha(collapsed(words, found)))


@pytest.mark.parametrize("boundaries", [2, 64])
def test_rows_against_brute_force(spark, monkeypatch, boundaries):
    monkeypatch.setattr(runs, "_SLICE", 5_000)
    texts = [None, "", "a a a a a", "a a a a a a", "x " + "a b c " * 20 + "y", "é ü " * 9, "one " * 5_000 + "two " * 5]
    texts += [" ".join(map(str, noisy(np.random.default_rng(i), 300))) for i in range(20)]
    docs = documents(spark, texts, clashes=True)
    want = sorted(expected(i, t) for i, t in enumerate(texts))
    assert sorted(tuple(r) for r in runs.summary(runs.find(docs, runs.planted)).collect()) == want
    plain = {r["doc_id"]: r for r in runs.find(docs, with_text=True).collect()}
    for i, t in enumerate(texts):
        words = (t or "").split()
        assert [tuple(r) for r in plain[i]["runs"]] == brute(words)
        assert bytes(plain[i]["collapsed"]).decode() == collapsed(words, brute(words)) and plain[i]["n_words"] == len(words)


def test_odd_rows(spark):
    rows = odd_rows(spark)
    found = runs.summary(runs.find(rows, runs.planted)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted([expected(r["doc_id"], r["text"]) for r in rows.collect()], key=key)
    assert runs.summary(runs.find(no_rows(spark))).collect() == []


def test_query_equals_sql_with_null_ids(spark):
    folder = "/root/testdata/sf0.001"
    run, sql = queries.op13_periodic_runs, queries.ORACLES["op13_periodic_runs"]
    assert difference(spark, connect(folder), "op13", run, sql, folder) is None
