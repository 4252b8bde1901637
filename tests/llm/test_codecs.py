"""Token ids: against the tokenizer libraries, and exact round trips."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaymark.llm import sentencepiece_codec, token_store
from tests.llm.fixtures import documents, no_rows, odd_rows

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "a", "  a  b ", "\n\n x", "x   y     z", "a\xa0b  c", "it's  we'll", "tab\t\tb \x1c x \x85 y", "日本語 中文",
    "é ü ß ñ 😀 🎉🎉", "a" * 300, "\x00\t\r\n", "   ", "<|endoftext|> x <|endoftext|>y", "----====####....,,,,", "½ ²³ Ünï",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)


texts = st.text(st.one_of(st.sampled_from("ab \n\t.,'1é▁"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_encoders_agree_with_their_libraries(text):
    from tokenizers import Tokenizer

    global _known
    _known = globals().get("_known") or (Tokenizer.from_file(BPE), __import__("sentencepiece").SentencePieceProcessor(model_file=PIECES))
    assert token_store.encoder(BPE).encode([text])[0].tolist() == _known[0].encode(text, add_special_tokens=False).ids
    assert sentencepiece_codec.codec(PIECES).encode([text])[0].tolist() == _known[1].encode(text)


def test_odd_texts_in_one_batch(libraries):
    bpe, pieces = libraries
    for text, ids in zip(ODD, token_store.encoder(BPE).encode(ODD)):
        assert ids.tolist() == bpe.encode(text, add_special_tokens=False).ids
    both = sentencepiece_codec.codec(PIECES)
    ids = both.encode(ODD)
    assert [x.tolist() for x in ids] == [pieces.encode(t) for t in ODD]
    assert both.decode(ids) == ODD


def test_occurrences_are_all_occurrences():
    codec = sentencepiece_codec.codec(PIECES)
    text = "▁the▁then▁banana▁another"
    piece, start = codec.occurrences(codec.symbol[[ord(c) for c in text]])
    want = {(p, i) for p in codec.edges for i in range(len(text)) if text.startswith(p, i)}
    assert {(codec.edges[p], int(i)) for p, i in zip(piece, start)} == want and len(piece) == len(want)


@pytest.mark.parametrize("plane", ["byte", "bit"])
@pytest.mark.parametrize("n,most", [(0, 1), (1, 1), (65536, 50257), (1000, 2**31), (77, 255)])
def test_planes(plane, n, most):
    ids = np.random.default_rng(n).integers(0, most, n).astype(np.uint32)
    assert np.array_equal(token_store.unpack_block(token_store.pack_block(ids, plane), n, plane), ids)


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_file_and_ranges(tmp_path, plane):
    rng = np.random.default_rng(1)
    docs = [(None if k == 0 else k, rng.integers(0, 50257, int(rng.integers(0, 90)))) for k in range(50)]
    with open(tmp_path / "x.qmt", "wb") as sink:
        writer = token_store.TokenFileWriter(sink, plane, block=128)
        for k, ids in docs:
            writer.add(k, ids)
        writer.close()
    file = token_store.TokenFile(str(tmp_path / "x.qmt"))
    flat = np.concatenate([ids for _, ids in docs])
    assert file.doc_ids == [k for k, _ in docs] and file.counts.tolist() == [len(x) for _, x in docs]
    for a, b in ((0, len(flat)), (5, 6), (127, 129), (300, 300), (128, 256)):
        assert file.read(a, b).tolist() == flat[a:b].tolist()
    file.close()


def test_written_tokens(spark, libraries):
    texts = [" ".join(f"word{i * k % 97}" for i in range(k)) for k in range(120)] + ODD + [None]
    docs = documents(spark, texts, clashes=True).repartition(5)
    rows = token_store.read_tokens(token_store.write_tokens(docs, BPE)).orderBy("doc_id").collect()
    start = 0
    for k, (text, row) in enumerate(zip(texts, rows, strict=True)):
        ids = libraries[0].encode(text or "", add_special_tokens=False).ids + [0]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (k, start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_tokens_of_odd_rows(spark):
    rows = token_store.read_tokens(token_store.write_tokens(odd_rows(spark), BPE)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8]
    assert token_store.read_tokens(token_store.write_tokens(no_rows(spark), BPE)).count() == 0


def test_sentencepiece_on_spark(spark, libraries):
    docs = documents(spark, ODD + [None], clashes=True)
    tokens = sentencepiece_codec.encode(docs, PIECES)
    got = {r["doc_id"]: r["token_ids"] for r in tokens.collect()}
    assert [got[k] for k in range(len(ODD) + 1)] == [libraries[1].encode(t) for t in ODD] + [[]]
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(tokens, PIECES).collect()}
    assert [back[k] for k in range(len(ODD) + 1)] == ODD + [""]
    rows = sentencepiece_codec.encoded(odd_rows(spark), PIECES).collect()
    assert len(rows) == 10 and all(r["decodes"] and r["n_tokens"] == len(r["token_ids"]) for r in rows)
    assert sentencepiece_codec.encoded(no_rows(spark), PIECES).count() == 0
