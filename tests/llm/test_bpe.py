"""Token counts, prefixes, encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillgraph.llm import bpe_codec, token_counts
from quillgraph.llm.bpe import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "the", "'", "re", "'re", "'ll", "  ", " ", "\n", "\n\n", "\t", "é", "中", "😀", "12", "!", "<|endoftext|>", "<|", "endo", "|>", " ", "\x1c", "xxxxx", "\r\n", "ing"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def texts(seed, n, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_every_prefix(library):
    bpe = byte_bpe(PATH)
    for text in texts(1, 200, 12):
        want = [len(ids(library, text[:k])) for k in range(len(text) + 1)]
        assert bpe.prefixes(text).tolist() == want
        for budget in (0, 1, 3, 7):
            assert bpe.longest_fit(text, budget) == max(k for k, c in enumerate(want) if c <= budget)


def test_every_budget_in_white_space(library):
    bpe = byte_bpe(PATH)
    rng = random.Random(11)
    parts = [" ", "\xa0", "\u3000", "\n", "\t", "x", "'ll", "'re", "'", " \xa0", "ab"]
    some = [" \xa0 \xa0x"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    known = {}
    for text in some:
        want = []
        for k in range(len(text) + 1):
            if text[:k] not in known:
                known[text[:k]] = len(ids(library, text[:k]))
            want.append(known[text[:k]])
        for budget in range(want[-1] + 1):
            assert bpe.measured(text, budget) == (want[-1], max(k for k, c in enumerate(want) if c <= budget)), (text, budget)


def test_every_byte_and_long_pieces(library):
    bpe = byte_bpe(PATH)
    rng = random.Random(3)
    for text in ["".join(chr(c) for c in range(0x500)), "ab" * 700, "".join(rng.choice("etaoin") for _ in range(3000)), "é" * 900, " " * 500 + "x", "x" + "\n" * 300]:
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == ids(library, text)


@pytest.mark.parametrize("long_piece", [4, 256])
def test_tree_of_parts_cut_anywhere(library, monkeypatch, long_piece):
    monkeypatch.setattr(bpe_codec, "LONG_PIECE", long_piece)
    monkeypatch.setattr(bpe_codec, "FIRST_WINDOW", 1)
    bpe = byte_bpe(PATH)
    rng = random.Random(5)
    some = [t.replace("<|endoftext|>", "") for t in texts(7, 300, 30)] + ["".join(rng.choice("etaoin") for _ in range(400)), "a" * 300, "😀" * 90, " " * 100 + "y", "'r" + "'re" * 60]
    for text in some:
        if not text:
            continue
        for size in (1, 3, 17):
            parts = [bpe_codec.Part.of(bpe, p) for p in bpe_codec.cut(text, size)]
            assert np.frombuffer(b"".join(bpe_codec.tree(bpe, parts).ids), "<u4").tolist() == ids(library, text), (text, size)


def rows(spark):
    data = [(1, "Hello there, it's 2024"), (2, None), (3, ""), (4, " x" * 40 + "<|endoftext|>" + "y'll " * 30), (4, "again"), (None, "no key")]
    return spark.createDataFrame([(k, t, "q", 1) for k, t in data], "doc_id long, text string, n_tokens string, part int")


@pytest.mark.parametrize("size", [10, 100_000])
def test_encode_frame(spark, library, size):
    got = bpe_codec.digests(bpe_codec.encode(rows(spark), PATH, part_chars=size)).collect()
    want = []
    for r in rows(spark).collect():
        own = ids(library, r.text or "")
        decoded = library.decode(own, skip_special_tokens=False)
        want.append((r.doc_id, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_counts_frame(spark, library):
    got = {(r.doc_id, r.n_bytes): r for r in token_counts.token_counts(rows(spark), PATH, limit=5).collect()}
    for r in rows(spark).collect():
        row = got[r.doc_id, len((r.text or "").encode())]
        n = len(ids(library, r.text or ""))
        assert (row.n_tokens, row.over_limit) == (n, n > 5)
        assert row.fit_chars == max(k for k in range(len(r.text or "") + 1) if len(ids(library, (r.text or "")[:k])) <= 5)
    assert token_counts.token_counts(rows(spark).limit(0), PATH).count() == 0


def test_prefix_store_and_truncation(spark, library):
    stored = token_counts.prefix_counts(rows(spark), PATH)
    for r in token_counts.with_counts_under(stored, 3).collect():
        assert r.fit_chars == max(k for k, c in enumerate(r.prefix_tokens) if c <= 3)
    for r in token_counts.truncate(rows(spark), PATH, 4).collect():
        assert r.text is None or len(ids(library, r.text)) <= 4


def test_whole_table(spark, library, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n = {k: len(ids(library, t)) for k, t in docs.items()}
    assert {r.doc_id: r.n_tokens for r in token_counts.op1_token_counts(spark, sf).collect()} == n
    got = bpe_codec.op7_bpe_codec(spark, sf).collect()
    assert len(got) == len(docs) and all(r.n_tokens == n[r.doc_id] for r in got)
    assert all(r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest() for r in got)
