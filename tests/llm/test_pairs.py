"""Near copies and repeated strings against brute force."""

import hashlib

import numpy as np
import pytest

from quaymark.llm import jaccard_join, repeats
from quaymark.llm.components import components
from quaymark.llm.shingles import shingle_sets
from tests.llm.fixtures import documents, no_rows, odd_rows


def _sets(texts):
    out = []
    for text in texts:
        words = (text or "").encode().split()
        out.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    return out


def _brute(texts):
    sets = _sets(texts)
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and both >= 0.8 * len(a | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], links


def _varied(rng, words, share):
    return " ".join(w if rng.random() > share else f"new{rng.integers(1 << 30)}" for w in words)


def test_shingles_are_the_sets_of_words():
    texts = ["a b c d e f", "a  b\tc\nd e f", "a b c d e", "a b", "", None, "x", "é b c d é é", "a b c d e f a b c d e f"]
    sizes = [len(s) for s in shingle_sets(texts)]
    assert sizes == [len(s) for s in _sets(texts)]
    got = shingle_sets(texts)
    assert np.array_equal(got[0], got[1]) and not set(got[2]) - set(got[0]) and len(set(got[3]) & set(got[0])) == 0


@pytest.mark.parametrize("small,block", [(64, 256), (6, 16)])
def test_join_finds_every_link(spark, monkeypatch, small, block):
    """Also with splits below the first level and with groups of several blocks."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = np.random.default_rng(11)
    line = "this very common line opens a third of all texts here"
    texts = []
    for k in range(60):
        words = [f"w{rng.integers(4000)}" for _ in range(int(rng.integers(3, 150)))]
        texts += [_varied(rng, words, s) for s in (0, 0, 0.01, 0.02, 0.03)[: int(rng.integers(1, 6))]]
    hot = [f"h{rng.integers(4000)}" for _ in range(120)]
    texts += [_varied(rng, hot, 0.008) for _ in range(60)] + [f"{line} {i} {i + 1}" for i in range(60)] + [hot[0]] * 3
    root, links = _brute(texts)
    rows = {r["doc_id"]: r for r in jaccard_join.join(documents(spark, texts, clashes=True)).collect()}
    assert [rows[k]["class_id"] for k in range(len(texts))] == root
    assert [rows[k]["n_links"] for k in range(len(texts))] == links


def test_runs_meet_the_target_through_all_splits():
    """Simulated: pairs at the threshold, their equal tokens fixed over the runs, each run split down to the depth."""
    rng = np.random.default_rng(3)
    every, crowded = jaccard_join.runs()
    shared = rng.binomial(jaccard_join.TOKENS, jaccard_join.SIMILARITY, 100_000)
    draw = 1 / (jaccard_join.SIMILARITY * jaccard_join.TOKENS)

    def lost(n_runs, depth):
        left = np.arange(len(shared))
        for _ in range(n_runs):
            together = np.ones(len(left), np.int64)
            for _ in range(depth):
                together = rng.binomial(shared[left] * together, draw)
            left = left[together == 0]
        return left

    allowed = 1 - jaccard_join.TARGET
    passes = shared >= jaccard_join.PASSES * jaccard_join.TOKENS
    missed = (~passes).sum() + passes[lost(crowded, jaccard_join.DEPTH)].sum()
    missed += passes[lost(every - jaccard_join.FIRST, 1)].sum()
    assert missed / len(shared) <= 1.3 * allowed


def test_join_of_odd_rows(spark):
    rows = {r["doc_id"]: r for r in jaccard_join.join(odd_rows(spark)).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert [rows[k]["class_id"] for k in (1, 2, 3, 4, 5, 6, 7, 8)] == [1, 2, 3, 4, 4, 6, 7, 4]
    assert [rows[k]["n_links"] for k in (1, 2, 3, 4, 5, 6, 7, 8)] == [0, 0, 0, 2, 2, 1, 0, 2]
    stay = jaccard_join.representatives(odd_rows(spark))
    assert stay.columns == odd_rows(spark).columns
    assert sorted(r["doc_id"] for r in stay.collect()) == [1, 2, 3, 4, 6, 7]  # copies without an id or under one id go too
    assert jaccard_join.join(no_rows(spark)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def _cut(texts):
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(data[s : s + 100])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.append((len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def _pasted(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), int(rng.integers(1, 9))))
    passages = [" ".join(word() for _ in range(int(rng.integers(8, 80)))) for _ in range(6)]
    texts = []
    for k in range(80):
        parts = [" ".join(word() for _ in range(int(rng.integers(0, 40))))]
        for _ in range(int(rng.integers(0, 4))):
            passage = passages[int(rng.integers(6))]
            a = int(rng.integers(0, len(passage) // 2))
            parts += [passage[a : a + int(rng.integers(60, 400))], word()]
        texts.append(" ".join(parts))
    return texts + ["-" * 700, "=" * 99, "=" * 100, "=" * 101, "ab" * 300, texts[3], texts[3] + "x", None, "", passages[0] * 3]


@pytest.mark.parametrize("hot", [4096, 8])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = _pasted(hot)
    rows = {r["doc_id"]: r for r in repeats.without_repeats(documents(spark, texts, clashes=True).repartition(6)).collect()}
    got = [
        (r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())
        for r in (rows[k] for k in range(len(texts)))
    ]
    assert got == _cut(texts)
    assert all(sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in rows.values())


def test_repeats_in_odd_rows(spark):
    rows = repeats.without_repeats(odd_rows(spark)).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 10 and by_id[1]["n_bytes"] == 0 and by_id[4]["n_removed"] == 0
    assert by_id[8]["n_removed"] >= 400 and by_id[None]["n_removed"] == 0
    again = documents(spark, ["x" + "yz" * 90, "pq " * 5]).unionByName(documents(spark, ["x" + "yz" * 90]))
    assert {r["n_removed"] for r in repeats.without_repeats(again).where("doc_id = 0").collect()} == {178}
    assert repeats.without_repeats(no_rows(spark)).count() == 0


def test_anchors_of_long_documents_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    data = bytes(rng.integers(97, 110, 5000).astype(np.uint8))
    whole = [np.concatenate(x) for x in zip(*repeats.anchor_rows([(7, data), (8, data[:300])]))]
    monkeypatch.setattr(repeats, "_PIECE", 700)
    parts = [np.concatenate(x) for x in zip(*repeats.anchor_rows([(7, data), (8, data[:300])]))]
    key = lambda x: sorted(zip(*(c.tolist() for c in x)))
    assert key(whole) == key(parts)


@pytest.mark.parametrize("size", [300, 1_200])
def test_a_crowd_in_one_group_is_not_split_again(spark, monkeypatch, size):
    """Near copies that earlier runs put into one group leave a run after its first split, however many they are."""
    monkeypatch.setattr(jaccard_join, "SMALL", 64)
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(150)]
    texts = [_varied(rng, words, 0.01) for _ in range(size)]
    docs = documents(spark, texts).select("doc_id", "text")
    form = "rep long, n int, mark long, first long, tokens array<long>"
    reps = docs.mapInArrow(jaccard_join._embed, form.replace("rep", "doc_id")).withColumnRenamed("doc_id", "rep")
    reps = reps.dropDuplicates(["mark"]).cache()
    reps = reps.selectExpr("*", "rep AS root").withColumn("sketch", jaccard_join._sketch())
    small, connected, crowded = jaccard_join._met(reps, 1, 3)
    assert crowded.count() > 0
    grouped = jaccard_join._grouped(reps, jaccard_join._compared(small, connected))
    assert grouped.groupBy("root").count().selectExpr("max(count)").first()[0] > 0.5 * size
    one = grouped.join(grouped.groupBy("root").count().where("count > 64"), "root", "left_semi").drop("count")
    small, connected, crowded = jaccard_join._met(one, 4, 11)
    assert small.count() == 0 and crowded.count() == 0 and sum(c.count() for c in connected) == 0


def _embedded_sets(spark, texts):
    form = "doc_id long, n int, mark long, first long, tokens array<long>"
    docs = documents(spark, texts).select("doc_id", "text")
    reps = docs.mapInArrow(jaccard_join._embed, form).withColumnRenamed("doc_id", "rep")
    return reps.withColumn("sketch", jaccard_join._sketch()).cache()


def test_sets_without_company_leave_and_no_passing_pair_does(spark):
    rng = np.random.default_rng(5)
    passage = [f"p{k}" for k in range(30)]
    texts = []
    for k in range(80):
        words = [f"w{rng.integers(10**6)}" for _ in range(100)]
        texts += [" ".join(words + passage), _varied(rng, words, (0.0, 0.01, 0.02, 0.5)[k % 4])]
    reps = _embedded_sets(spark, texts)
    kept = {r["rep"] for r in jaccard_join._in_company(reps.drop("sketch")).collect()}
    tokens = {r["rep"]: np.array(r["tokens"]) for r in reps.collect()}
    least = jaccard_join.PASSES * jaccard_join.TOKENS
    pairs = [(a, b) for a in tokens for b in tokens if a < b and (tokens[a] == tokens[b]).sum() >= least]
    assert pairs and {k for pair in pairs for k in pair} <= kept
    assert len(kept) < 0.9 * len(texts)


@pytest.mark.parametrize("part", [4096, 16])
def test_sets_outside_the_main_group_meet_all_of_it(spark, monkeypatch, part):
    """Few sets of other groups are found beside a main group far above the brute-force size, dealt to parts."""
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    monkeypatch.setattr(jaccard_join, "PART", part)
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(200)]
    texts = [_varied(rng, words, 0.005) for _ in range(150)] + [" ".join(f"x{i}" for i in range(k, k + 90)) for k in range(3)]
    reps = _embedded_sets(spark, texts).selectExpr("*", "IF(rep < 146 OR rep >= 150, 0, rep) AS root")
    small, connected, crowded = jaccard_join._met(reps, 1, 8)
    assert crowded.count() == 0 and small.groupBy("path").count().selectExpr("max(count)").first()[0] > 8
    found = {(r["a"], r["b"]) for r in jaccard_join._compared(small, connected).collect()}
    assert {max(pair) for pair in found} == {146, 147, 148, 149}
