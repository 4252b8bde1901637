"""Mixing and exact deduplication against plain Python and DuckDB."""

import hashlib
import re

import numpy as np
import pytest

from quaymark.llm import exact_dedup, mixing, queries
from tests.compare import connect, difference
from tests.llm.fixtures import documents, no_rows, odd_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_duckdb(spark, name):
    assert difference(spark, connect(FOLDER), name, queries.QUERIES[name], queries.ORACLES[name], FOLDER) is None


def _poured(sizes, weights, most):
    """Targets by repeated clamping."""
    held, total = {}, sum(sizes)
    while True:
        rest = total - sum(held.values())
        share = sum(w for i, w in enumerate(weights) if i not in held)
        above = {i: most * s for i, s in enumerate(sizes) if i not in held and rest * weights[i] > most * s * share}
        if not above:
            return [held.get(i, rest * w / share if share else 0) for i, w in enumerate(weights)]
        held |= above


def test_targets_are_clamped_and_reshared(spark):
    sizes = {"a": 10, "b": 3000, "c": 400, "d": 20, "e": 0, None: 900}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    want = _poured(list(sizes.values()), [5, 2, 1, 5, 2, 1], 3)
    assert [got[s] for s in sizes] == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_comes_near_its_targets_and_repeats(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(1, 60, 900)]
    sources = [["a", "b", "c", None][k] for k in rng.choice(4, 900, p=[0.05, 0.6, 0.15, 0.2])]
    docs = documents(spark, texts, sources=sources, clashes=True)
    rows = mixing.mix(docs).select("doc_id", "source", "size", "target", "copies", "taken").collect()
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(7)).select("doc_id", "source", "size", "target", "copies", "taken").collect())
    for source in ("a", "b", "c", None):
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 30
        assert all(r["taken"] == r["size"] * r["copies"] and r["copies"] <= 3 for r in own)
    whole = mixing.mixed(docs)
    assert whole.columns == docs.columns and whole.count() == sum(r["copies"] for r in rows)
    assert {r["size"] for r in whole.select("size").distinct().collect()} == {"other"}


def test_mix_of_odd_rows(spark):
    rows = mixing.mix(odd_rows(spark)).collect()
    assert len(rows) == 10 and {r["size"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert len({r["taken"] for r in rows if r["doc_id"] == 6}) == 1
    assert mixing.mix(no_rows(spark)).count() == 0 and mixing.mixed(no_rows(spark)).count() == 0


def test_mix_runs_no_python(spark):
    plan = mixing.mix(documents(spark, ["a b", "c"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("n", [0, 1, 2, 10, 1000, 60_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
    made = exact_dedup.build_filter(np.concatenate([keys, keys[: n // 2]]))
    assert exact_dedup.may_contain(keys, *made).all()
    others = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    assert exact_dedup.may_contain(others, *made).mean() < 0.001
    assert len(made[3]) <= 1.5 * n + 4096


def _groups(rows):
    plain = {}
    for doc_id, text in rows:
        plain.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    return plain


def test_exact_groups(spark):
    rng = np.random.default_rng(5)
    texts = [f"text {k}" + "  \n" * int(rng.integers(0, 3)) for k in rng.integers(0, 150, 400)] + [None, "", " ", "\t"]
    docs = documents(spark, texts, clashes=True)
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs, bucket_keys=40).collect()}
    assert len(got) == len(texts)
    for text, ids in _groups(enumerate(texts)).items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(ids), len(ids), i == min(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    stay = exact_dedup.deduplicated(docs)
    assert stay.columns == docs.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(min(ids) for ids in _groups(enumerate(texts)).values())


def test_rows_of_one_id_are_judged_one_by_one(spark):
    rows = [(9, "a  b", 1), (9, "of its own", 2), (3, "a b", 3), (None, "a b", 4), (None, "alone", 5), (None, "alone", 6), (9, "a b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number int")
    stay = exact_dedup.deduplicated(docs)
    assert stay.columns == docs.columns
    got = {r["number"] for r in stay.collect()}
    assert got in ({3, 2, 5}, {3, 2, 6})
    stay = exact_dedup.deduplicated(odd_rows(spark))
    assert sorted(r["doc_id"] for r in stay.collect()) == [1, 3, 4, 6, 7, 8]
    assert exact_dedup.deduplicated(no_rows(spark)).count() == 0


def test_exact_groups_of_odd_rows(spark):
    rows = exact_dedup.exact_groups(odd_rows(spark)).collect()
    assert len(rows) == 10
    assert {r["keep_id"] for r in rows if r["doc_id"] in (4, 5, None)} == {4}
    assert [r["kept"] for r in rows if r["doc_id"] == 6] == [True, True]
    assert {r["keep_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert exact_dedup.exact_groups(no_rows(spark)).count() == 0
