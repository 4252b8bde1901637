"""Nearest neighbours, the two classifiers, page text and the pipeline."""

import html
import re
import time
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quaymark.llm import common, hash_forest, html_text, language, queries, toxicity
from tests.llm.fixtures import documents, no_rows, odd_rows

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def _nearest(ids, vectors, k=20):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -score)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), score[i]) for i in order]
    return out


def test_forest_recall_and_scores(spark):
    """Structureless vectors of differing lengths, some of them equal, in two calls for a short and a longer head."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(6000, 24)).astype(np.float32) * rng.uniform(0.5, 2, (6000, 1)).astype(np.float32)
    vectors[100:160] = vectors[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in hash_forest.nearest(frame).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = _nearest(np.arange(6000), vectors.astype(np.float64))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    found = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert found >= 0.9 * 20 * len(want)
    for q, pairs in got.items():
        assert all(abs(s - vectors[q].astype(np.float64) @ vectors[v].astype(np.float64)) < 1e-9 for v, s in pairs)
        assert pairs == sorted(pairs, key=lambda p: (-p[1], p[0]))


@pytest.mark.parametrize("bucket", [4096, 16])
def test_forest_of_crowded_prefixes(spark, monkeypatch, bucket):
    """Enough candidates below the head do not end a search there: recall is measured at every head."""
    monkeypatch.setattr(hash_forest, "EFFORT", 1)
    monkeypatch.setattr(hash_forest, "BUCKET", bucket)
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(3000, 12)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {}
    for r in hash_forest.nearest(frame).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = _nearest(np.arange(3000), vectors.astype(np.float64))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len(got[q] & {a for a, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_forest_goes_on_where_too_few_are_found(spark, monkeypatch):
    """Queries without company in their cells go to shorter prefixes until they have k."""
    monkeypatch.setattr(hash_forest, "_calibrated", lambda *_: (2, 4))
    vectors = np.random.default_rng(9).normal(size=(600, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = hash_forest.nearest(frame).groupBy("query_id").count().collect()
    assert len(got) == 30 and {r["count"] for r in got} == {20}


@pytest.mark.parametrize("n,clusters", [(400, 0), (3000, 0), (3000, 60)])
def test_no_size_searches_all_leaves(spark, monkeypatch, n, clusters):
    """Small tables go through the forest too: no search at the root, recall of 0.9 and more."""
    heads, searched = [], hash_forest._searched

    def spied(*given):
        heads.append(given[7])
        return searched(*given)

    monkeypatch.setattr(hash_forest, "_searched", spied)
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(n, 32))
    if clusters:
        vectors = rng.normal(size=(clusters, 32))[rng.integers(0, clusters, n)] + 0.2 * vectors
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in hash_forest.nearest(frame).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = _nearest(np.arange(n), vectors)
    assert heads and min(heads) >= 1 and set(got) == set(want)
    assert sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
    for q, pairs in got.items():  # doubles are scored as doubles
        assert all(abs(s - vectors[q] @ vectors[v]) < 1e-12 * max(1, abs(s)) for v, s in pairs)


def test_forest_of_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, None, 1), (3, [], 1), (4, [0.0, 0.0], 1),
        (5, [None, 1.0], 1), (40, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 2.0, 3.0], 1),
        (None, [1.0, 1.0], 1), (1, [0.5, 0.5], 1), (8, [-1.0, 0.0], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in hash_forest.nearest(frame).collect()]
    assert sorted(got) == [
        (0, 1, 20, 1.0), (0, 2, 1, 0.5), (0, 3, 8, -1.0), (20, 1, 0, 1.0), (20, 2, 1, 0.5), (20, 3, 8, -1.0),
    ]
    assert hash_forest.nearest(frame.limit(0)).count() == 0


def test_forest_on_the_table(spark):
    con = duckdb.connect()
    rows = con.execute(f"SELECT vec_id, embedding FROM '{SMALL}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    want = _nearest(ids, vectors)
    got = {}
    for r in queries.QUERIES["op1_hash_forest"](spark, SMALL).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(got[q] & {a for a, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_language_on_held_out_rows(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{MEDIUM}/documents.parquet'").fetchall())
    rows = queries.QUERIES["op6_language_id"](spark, MEDIUM).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in {*truth.values(), "und"} for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]) > 0.95


def test_language_of_odd_rows(spark):
    rows = language.identify(odd_rows(spark)).collect()
    assert len(rows) == 10
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows if r["doc_id"] in (1, 2, 3, 7)} == {
        k: ("und", 0.0) for k in (1, 2, 3, 7)
    }
    stay = language.accepted(odd_rows(spark))
    assert stay.columns == odd_rows(spark).columns
    assert {r["doc_id"] for r in stay.collect()} <= {None, 4, 5, 6, 8}
    assert language.identify(no_rows(spark)).count() == 0 and language.accepted(no_rows(spark)).count() == 0


def test_long_texts_count_whole(spark):
    net = language.fit(common.table(spark, MEDIUM, "documents"), ~language.held_out())
    de = "Die Verträge und die Berichte der Behörde sind noch nicht fertig geschrieben. "
    en = "The reports and the other papers of the office were not written in time. "
    names, scores = language.classify(net, net.tables(), [de + en * 3000, en + de * 3000, en, "", None, "é"])
    assert names[3:5] == ["und", "und"] and names[0] == names[2] != names[1] and (scores <= 1).all()


def test_toxicity_learns_sentences_from_documents():
    rng = np.random.default_rng(0)
    plain = lambda: " ".join(f"w{rng.integers(300)}" for _ in range(8)).capitalize() + "."
    texts, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        parts = [plain() for _ in range(int(rng.integers(1, 25)))]
        if toxic:
            parts.insert(int(rng.integers(len(parts) + 1)), f"You {rng.choice(['scumbag', 'lowlife', 'scumface'])} there!")
        texts.append(" ".join(parts))
        labels.append(int(toxic))
    model = toxicity.train(texts, labels)
    scores = np.array([model.document(t) for t in texts])
    assert ((scores >= 0.5) == np.array(labels, bool)).mean() > 0.98
    found = model.sentences("Fine words here. You scumhead there! More w1 w2.")
    assert [s >= 0.5 for _, _, s in found] == [False, True, False]
    assert 0 <= model.document("") < 0.5 and model.document(None) == model.document("")


def test_toxicity_on_the_table(spark):
    rows = queries.QUERIES["op7_toxicity"](spark, MEDIUM).collect()
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{MEDIUM}/labels.parquet'").fetchall())
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.9


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame(
        [(4, 1, 0), (4, 1, 1), (5, None, 0), (None, 1, 1), (8, 1, None), (6, 1, 7)], "doc_id long, quality int, toxic int"
    )
    model = toxicity.fit(odd_rows(spark), labels)
    rows = toxicity.score(odd_rows(spark), model).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(no_rows(spark), toxicity.fit(no_rows(spark), labels.limit(0))).count() == 0
    spans = toxicity.locate(documents(spark, ["Good. You scum! Fine.", None]), toxicity.Model(-5.0, {f: 3.0 for f in toxicity.features("scum")}))
    assert [(r["doc_id"], r["sentence"]) for r in spans.collect()] == [(0, " You scum!")]


PAGES = {
    "<article><h1>A &amp; B</h1><p>One<br>two\n  three.<p><b>Four</article><footer>no</footer>": "A & B\n\nOne two three.\n\nFour",
    "<body><nav>Menu</nav><div class='ad'>Buy<article><p>Text &eacute;&#33;</p></article>": "Text é!",
    "<header>Site</header><main><header><h1>T</h1><span>by x</span></header><p>P</p><aside>s</aside></main>": "T\n\nP",
    "<article><p>Body</p><section class='comments'><article>me too</article></section></article>": "Body",
    "<article>Body</article><div id='comments'><article>first comment that is long enough</article></div>": "Body",
    "<div id=wrap><p>A long enough paragraph of text that is content.</p><p>Short.</p></div><ul><li><a href=x>link</a></ul>": (
        "A long enough paragraph of text that is content.\n\nShort."
    ),
    "<p>x<script>var a='</p><p>no';</script><style>p{}</style><form>f <input></form>": "x",
    "<article><div role='alert'>n</div><div hidden>h</div><p>k</p><div class='cookie-notice'>c</div></article>": "k",
    "<article><p>A <svg><title>icon</title></svg> B</p><p>C</p></article>": "A B\n\nC",
    "<p>Text <button>Share</button> more</p>": "Text more",
    "<p>a <video>x<p>y</p></video>b <textarea>t</textarea>c <object>o</object>d<template><div>q</div></template></p>": "a b c d",
    "<p>a</p><form>f</form><label>l</label>": "a", "<p>x <button>unclosed</p><p>y</p>": "x",
    "<article><h2 id='share-prices'>H</h2><div class='notice-of-appeal'>N</div><h3 id='comments'>O</h3></article>": "H\n\nN\n\nO",
    "<div class='page has-sidebar'><p>One.</p></div>": "One.", "<div class='widget-container'><p>One.</p></div>": "One.",
    "<div class='no-comments'>One.</div>": "One.", "<div class='layout-with-nav'>One.</div>": "One.",
    "<div class='widget'><p>All there is.</p></div>": "All there is.", "<div id='comments'>only readers</div>": "",
    "<article>The first and longer article of two.</article><article>Short.</article>": (
        "The first and longer article of two.\n\nShort."
    ),
    "<article>k<div class='site-header'>h</div><div class='post-comments'>c</div><p class='ad-slot'>a</p></article>": "k\n\nh",
    "<nav>only menu</nav>": "", "": "", "plain text": "plain text", "<!-- c -->": "", "<p>a<p>b</i></div>c": "a\n\nb\n\nc",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html_text.main_text(page) == PAGES[page]


def test_pages(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<p>a", "x"), (2, "u", "<p>" + "long " * 90000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["n_chars"], r["text"][:5]) for r in html_text.extract(pages).collect())
    assert got == [(0, ""), (0, ""), (1, "a"), (449999, "long ")]
    assert html_text.extract(pages.limit(0)).count() == 0
    on_table = html_text.extract(common.table(spark, SMALL, "pages")).collect()
    assert len(on_table) == 50 and all(r["n_chars"] == len(r["text"]) > 0 for r in on_table)


def _plain(page):
    """The article element by patterns: blocks end at block tags, adverts and scripts go."""
    inner = re.search(r"<article[^>]*>(.*?)</article>", page, re.S).group(1)
    inner = re.sub(r"<(script|style|aside|nav|form|footer)\b.*?</\1>|<div class=.?ad\b.*?</div>|<!--.*?-->", "", inner, flags=re.S)
    blocks = re.split(r"</?(?:p|div|h1|h2|h3|ul|li|hr|section|blockquote)\b[^>]*>", inner)
    plain = (" ".join(html.unescape(re.sub(r"<[^>]*>", lambda t: " " if t[0].startswith("<br") else "", b)).split()) for b in blocks)
    return "\n\n".join(b for b in plain if b)


def test_pages_of_a_table_against_patterns(spark):
    pages = {r["page_id"]: r["html"] for r in common.table(spark, MEDIUM, "pages").collect()}
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op10_html_text"](spark, MEDIUM).collect()}
    assert len(got) >= 50 and got == {k: _plain(h) for k, h in pages.items()}


@pytest.mark.parametrize("page", ["<div>x", "<button>", "<article>", "</section><section><article><div>", "<div><p>t</p>"])
def test_deep_nests_take_linear_time(page):
    took = []
    for levels in (5_000, 40_000):
        start = time.process_time()
        html_text.main_text(page * levels + "end" + "</section>" * levels)
        took.append(time.process_time() - start)
    assert took[1] < 24 * took[0] + 0.5


def test_smoothing_keeps_a_constant():
    assert np.allclose(html_text.smoothed(np.full(7, 3.0)), 3.0) and len(html_text.smoothed(np.ones(1))) == 1


def test_pipeline_stage_by_stage(spark):
    """Every stage against plain Python on its own input; the whole equals its stages."""
    from quaymark.llm import mixing, sentencepiece_codec
    from tests.llm.test_mixing_dedup import _groups
    from tests.llm.test_pairs import _brute

    docs = common.table(spark, SMALL, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.settle(stage(spark, before, SMALL))
        assert docs.columns == columns
        kept[name] = ([tuple(r) for r in before.orderBy("doc_id").collect()], [tuple(r) for r in docs.orderBy("doc_id").collect()])
    before, after = kept["language identification"]
    assert {r[0] for r in before} - {r[0] for r in after} == {r[0] for r in before if not any(c.isalpha() for c in r[1] or "")}
    before, after = kept["exact deduplication"]
    assert sorted(r[0] for r in after) == sorted(min(g) for g in _groups([r[:2] for r in before]).values())
    before, after = kept["n-gram Jaccard join"]
    root, _ = _brute([r[1] for r in before])
    assert [r[0] for r in after] == [r[0] for k, r in enumerate(before) if root[k] == k]
    before, after = kept["source mixing"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(before, common.table(spark, SMALL, "documents").schema)).collect()}
    assert sorted(r[0] for r in after) == sorted(k for k, n in copies.items() for _ in range(n))
    codec = sentencepiece_codec.codec(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    want = sorted((r[0], codec.encode([r[1]])[0].tolist()) for r in after)
    rows = queries.QUERIES["pipeline"](spark, SMALL).collect()
    assert sorted((r["doc_id"], r["token_ids"]) for r in rows) == want and all(r["decodes"] for r in rows)


def test_lines_of_links_stay_inside_the_chosen_root():
    prose = "".join(f"<p>{'plain words of a long paragraph ' * 8}{i}</p>" for i in range(6))
    cited = '<p><a href="/r">a reference whose whole line is a link</a></p>'
    page = f"<html><body><div><a href='/'>front page link</a></div><div><div>{prose}{cited}{prose}</div></div></body></html>"
    text = html_text.main_text(page)
    assert "a reference whose whole line is a link" in text and "front page link" not in text


def test_pipeline_of_odd_and_empty_rows(spark):
    """Every stage takes nulls, repeats, clashing columns and empty tables; each document of its own comes out."""
    for start, least in ((odd_rows(spark), {4, 6}), (no_rows(spark), set())):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.settle(stage(spark, docs, SMALL))
            assert docs.columns == start.columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
        assert least <= {r["doc_id"] for r in out} and all(r["decodes"] for r in out)
