"""The piece codec against the public library, and its defined results on odd input."""

import hashlib

import numpy as np
import pytest
import sentencepiece

from tessera.llm import piece_codec as codec
from tessera.llm import queries as Q
from tessera.llm.common import table, vocabulary

MODEL = vocabulary("piece_bpe_32k.model")
ODD = ["", " ", "  ", "▁", "▁ ▁a", "a", " a", "a ", "\n", "\x00\x00a \x00b", "  a▁b \n x　①é é � 🙂</s><s> <0x41>",
       "a  b   c ", "日本語テキスト", "é" * 60, "\t\t x", "🙂🙂 🙂", "x" * 500, "=-" * 300, "ab" * 2000, "Ḁ\U00013000a"]


@pytest.fixture(scope="module")
def model():
    return codec.PieceModel(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def check(model, library, texts):
    for text, (ids, starts, stops) in zip(texts, model.encode(texts)):
        pieces = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in pieces], text
        assert list(zip(starts.tolist(), stops.tolist())) == [(p.begin, p.end) for p in pieces], text
        assert model.decode(ids.tolist()) == library.decode(ids.tolist()), text


def test_codec_equals_the_library(model, library, spark, sf_dir):
    check(model, library, ODD)
    rng = np.random.default_rng(1)
    letters = [*" \n\tabcdefghijABC0123.,;:-_/éüñß▁ 　🙂日本\x00\"'()", *" " * 8]
    check(model, library, ["".join(rng.choice(letters, rng.integers(0, 120))) for _ in range(800)])
    check(model, library, [r["text"] for r in table(spark, sf_dir, "documents").collect()])


def test_long_words_and_small_caches_give_the_same_ids(model, library, monkeypatch):
    text = "the quick brown fox jumps over the lazy dog 0123456789 " * 30 + "thequickbrownfox" * 40
    monkeypatch.setattr(codec, "CACHE", 2000)
    monkeypatch.setattr(codec, "ROWS", 3)
    small = codec.PieceModel(MODEL)
    monkeypatch.setattr(codec, "WIDE", 6)
    for n in range(4):
        check(small, library, [text[n:], text[:50 + n], *ODD])


def test_decode_of_any_ids(model, library):
    rng = np.random.default_rng(2)
    for _ in range(300):
        ids = np.where(rng.random(12) < 0.5, rng.integers(0, 270, 12), rng.integers(0, model.size, 12)).tolist()
        assert model.decode(ids) == library.decode(ids), ids


def test_rewriting_by_a_character_map(library):
    """A compiled map of the library: longest prefixes, offsets in the source."""
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    own = codec.Normalizer(dict(codec.fields(normalizer.serialized_normalizer_spec()))[2])
    rng = np.random.default_rng(3)
    keys = sorted(own.entries)
    texts = ["  ①é é ｱﾞ x", "ﷺ  x​ y\n", "", "   ", "ạ́ ㎏ ", " a b  c  "]
    texts += ["".join(rng.choice(["a", "e", " ", "́", "̣", *rng.choice(keys, 4)], 12)) for _ in range(400)]
    for text in texts:
        want, places = normalizer.normalize(text, with_offsets=True)
        got, place = own(text)
        assert got.decode() == want, text
        ends = np.cumsum([0, *(len(c.encode()) for c in want)])
        source = np.cumsum([0, *(len(c.encode()) for c in text)])
        assert place[ends].tolist() == source[places].tolist(), text


def test_documents_and_their_digests(spark, odd, none, library):
    rows = codec.encode_documents(odd, MODEL, keep=["doc_id", "size", "text"]).collect()
    digests = codec.round_trips(odd, MODEL, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(digests) == odd.count()
    for r in rows:
        text = r["text"] or ""
        assert r["ids"] == library.encode(text, add_eos=True)
        data = text.encode()
        assert b"".join(data[a:b] for a, b in zip(r["starts"], r["stops"])) == data
        assert r["starts"][-1] == r["stops"][-1] == len(data)
    for r in digests:
        ids = library.encode(r["text"] or "", add_eos=True)
        assert r["n_tokens"] == len(ids) and r["n_source_bytes"] == len((r["text"] or "").encode())
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert codec.encode_documents(none, MODEL, keep=["doc_id"]).count() == 0
    assert codec.round_trips(none, MODEL, keep=[]).count() == 0


def test_query_equals_the_library_on_its_table(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    got = Q.op11_piece_codec(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        want = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), want)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
