"""Packing against a plain best-fit run, lower bounds and the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaymark.llm import packing, queries
from tests.llm.fixtures import documents, no_rows, odd_rows

BPE = public_tokenizers.path("byte_bpe_50k.json")


def opened(steps, capacity):
    """Every sequence with its pieces, checked to be gapless."""
    found = {}
    for length, _, n, first, each, offset in steps:
        for k in range(n):
            found.setdefault(first + k // each, []).append((offset + k % each * length, length))
    for inside in found.values():
        inside.sort()
        assert [o for o, _ in inside] == [0, *np.cumsum([c for _, c in inside])[:-1]]
        assert sum(c for _, c in inside) <= capacity
    return found


def one_by_one(lengths, capacity):
    """The same method item by item: pairs of large items, then best fit from long to short."""
    large = sorted((c for c in lengths if 3 * c > capacity), reverse=True)
    gaps = []
    while large:
        a = large.pop(0)
        fits = [b for b in large if a + b <= capacity]
        if fits:
            large.remove(max(fits))
        gaps.append(capacity - a - max(fits, default=0))
    for c in sorted((c for c in lengths if 3 * c <= capacity), reverse=True):
        fits = [g for g in gaps if g >= c]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - c)
        else:
            gaps.append(capacity - c)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 50), st.sampled_from([1, 16, 17, 25, 50])), max_size=60))
def test_plan_equals_the_method_item_by_item(lengths):
    counts = {c: lengths.count(c) for c in lengths}
    steps, n = packing.plan(counts, 50)
    found = opened(steps, 50)
    assert n == len(found) == one_by_one(lengths, 50)
    assert sorted(c for inside in found.values() for _, c in inside) == sorted(lengths)
    assert all(sum(3 * c > 50 for _, c in inside) <= 2 for inside in found.values())
    for c, count in counts.items():
        ranks = sorted((s[1], s[1] + s[2]) for s in steps if s[0] == c)
        assert [a for a, _ in ranks] == [0, *[b for _, b in ranks][:-1]] and ranks[-1][1] == count


def test_steps_depend_on_the_capacity_only():
    rng = np.random.default_rng(1)
    small = {c: int(n) for c, n in enumerate(rng.integers(1, 1_000, 2048), 1)}
    steps, n = packing.plan({c: k * 1_000_003 for c, k in small.items()})
    assert len(steps) < 8 * 2048
    assert n == pytest.approx(sum(c * k * 1_000_003 for c, k in small.items()) / 2048, rel=0.02)


def test_cuts():
    assert packing.cut(2048, 2048) == [0] and packing.cut(4096, 2048) == [0, 2048] and packing.cut(4100, 2048) == [0, 4, 2052]


def check(rows, texts, capacity):
    """Packed rows against the library, whole documents and gapless sequences."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    want = []
    for doc_id, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % capacity if len(ids) > capacity else len(ids)
        cuts = sorted({0, *range(first, len(ids), capacity)})
        want += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)]))]
    key = lambda r: (r[0] is None, *[x or 0 for x in r])
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(want, key=key)
    inside = {}
    for r in rows:
        inside.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in inside.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([c for _, c in parts])[:-1]]
        assert sum(c for _, c in parts) <= capacity
    return len(inside)


def test_odd_rows_and_long_texts(spark):
    rows = odd_rows(spark)
    texts = [(r["doc_id"], r["text"]) for r in rows.collect()]
    assert check(packing.packed(packing.pieces(rows, BPE, 16), 16).collect(), texts, 16)
    assert packing.packed(packing.pieces(no_rows(spark), BPE)).collect() == []
    long = [None, "", "a <|endoftext|> b", "one two three " * 40_000, *["same text"] * 30]
    docs = documents(spark, long, clashes=True)
    check(packing.packed(packing.pieces(docs, BPE)).collect(), list(enumerate(long)), 2048)


def test_small_buckets_rank_alike(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 7)
    texts = [f"text {'word ' * (i % 5)}" for i in range(300)]
    n = check(packing.packed(packing.pieces(documents(spark, texts), BPE, 32), 32).collect(), list(enumerate(texts)), 32)
    assert n == one_by_one([len(packing.encoder(BPE).encode([t])[0]) + 1 for t in texts], 32)


def test_sequences_hold_the_ids(spark):
    texts = ["some words here", "", "x " * 50, "more"]
    rows = packing.packed(packing.pieces(documents(spark, texts), BPE, 24, with_ids=True), 24)
    found = {r["sequence_id"]: (r["length"], bytes(r["ids"])) for r in packing.sequences(rows).collect()}
    for r in rows.collect():
        length, ids = found[r["sequence_id"]]
        assert len(ids) == 4 * length
        assert zlib.crc32(ids[4 * r["offset"] : 4 * (r["offset"] + r["length"])]) == r["ids_crc32"]


def test_query_against_the_library(spark):
    folder = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = queries.op12_bestfit_packing(spark, folder).collect()
    n, ids = check(rows, texts, 2048), sum(r["length"] for r in rows)
    assert n <= 1.02 * -(-ids // 2048) + 1
