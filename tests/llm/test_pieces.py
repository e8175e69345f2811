"""Piece encoding and decoding against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from quillgraph.llm import piece_codec
from quillgraph.llm.pieces import piece_model

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "the", " ", "  ", "    ", "\n", "\t", "é", "中", "国", "😀", "12", "!", "▁", "<s>", "<0x0A>", "ing", "in", "g", "xxxxx", "\x00", "aa", "ab", "of", "tion", "--", "==", "=", "\r\n"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(seed, n, most):
    rng = random.Random(seed)
    some = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(n)]
    return some + ["".join(rng.choice("abtheion") for _ in range(rng.randint(0, 2 * most))) for _ in range(n)]


def test_rounds(library):
    model = piece_model(PATH)
    some = texts(1, 4000, 30) + [" " * k for k in range(70)] + ["x" + " " * k + "y" for k in range(40)] + ["a" * k for k in range(60)] + ["=-" * k for k in range(40)]
    ids, at = model.encode_words([f" {t}" if t else "" for t in some])
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(some))] == library.encode(some)


def test_long_texts(library):
    rng = random.Random(2)
    known = piece_codec.KnownWords(piece_model(PATH))
    for text in [" " * 20_000, "a" * 50_000, "".join(rng.choice("abcdefgh") for _ in range(50_000)), "".join(chr(rng.randrange(0x4E00, 0x6000)) for _ in range(20_000)), "ab " * 30_000]:
        assert piece_codec.encode_texts(known, [text])[0].tolist() == library.encode(text)


@pytest.mark.parametrize("kept", [3, 300_000])
def test_words_that_are_known(library, monkeypatch, kept):
    monkeypatch.setattr(piece_codec, "KEPT_WORDS", kept)
    known = piece_codec.KnownWords(piece_model(PATH))
    for seed in range(4):
        some = texts(seed, 50, 20)
        ids, at = piece_codec.encode_texts(known, some)
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(some))] == library.encode(some)


def test_decode(library):
    model, rng = piece_model(PATH), random.Random(4)
    for _ in range(6000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32000), rng.randrange(3, 259)]) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)


def rows(spark):
    data = [(1, "Hello there, it's 2024"), (2, None), (3, ""), (4, "  中 x\n" * 40), (4, "again"), (None, "no key"), (7, "same"), (7, "same"), (8, "▁ a▁b")]
    return spark.createDataFrame([(k, t, "q", 1) for k, t in data], "doc_id long, text string, ids string, number int")


def want(library, text):
    ids = library.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("chars", [10, 1 << 20])
def test_encode_frame(spark, library, monkeypatch, chars):
    monkeypatch.setattr(piece_codec, "SLICE_CHARS", chars)
    got = piece_codec.encode(rows(spark), PATH).collect()
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=repr) == sorted(((r.doc_id, library.encode(r.text or ""), library.decode(library.encode(r.text or ""))) for r in rows(spark).collect()), key=repr)
    assert piece_codec.encode(rows(spark).limit(0), PATH).count() == 0


def test_decode_frame(spark, library):
    df = spark.createDataFrame([(1, [1, 15043, 3186, 2], "x"), (2, [], None), (3, None, "y")], "k int, ids array<int>, decoded string")
    assert {r.k: r.decoded for r in piece_codec.decode(df, PATH).collect()} == {1: library.decode([1, 15043, 3186, 2]), 2: "", 3: None}


def test_whole_table(spark, library, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = piece_codec.op12_piece_codec(spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {k: want(library, t) for k, t in docs.items()} and len(got) == len(docs)
