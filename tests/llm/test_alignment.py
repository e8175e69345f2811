"""Alignment of two tokenizers against the libraries and plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillgraph.llm import alignment

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "the", ",", ".", "?", "1.", "d.5", "½", "e\u0301", " ", "  ", "\n", "\t", " \n", "é", "中", "国", "😀", "1234", "!", "<|endoftext|>", "<s>", "ing", "unhappi", "ness", "  x", "\xa0", "　", "--------", "'ll", "x" * 30, "\x1c", "\x85", "\r\n"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def brute(libraries, rows):
    a_lib, b_lib = libraries
    letters = {c: b for b, c in zip([*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)], map(chr, [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]), strict=True)}
    rest = [b for b in range(256) if b not in letters.values()]
    letters |= {chr(256 + k): b for k, b in enumerate(rest)}
    docs, holders = [], defaultdict(set)
    for n, (key, text) in enumerate(rows):
        whole = (" " + (text or "")).encode()
        a = [(i, bytes(letters[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()) for i in b_lib.encode(text)] if text else []
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a = b = []
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, raw in side:
                own.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(own)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        said, at = [], 0
        for cut in cuts:
            said.append("|".join(",".join(str(i) for i, s, e in side if at <= s and e <= cut) for side in spans))
            at = cut
        links, k = [], 0
        for i, s, e in spans[0]:
            while k and spans[1][k][1] > s:
                k -= 1
            while k < len(spans[1]) and spans[1][k][1] < e:
                if spans[1][k][2] > s:
                    links.append((i, spans[1][k][0]))
                k += 1
            k = max(0, k - 1)
        for pair in links:
            holders[pair].add(n)
        docs.append((key, len(a), len(b), len(cuts), links, ";".join(said)))
    most = Counter()
    for (i, _), d in holders.items():
        most[i] = max(most[i], len(d))
    return [(k, a, b, g, len(links), sum(len(holders[p]) == most[p[0]] for p in links), sum(len(holders[p]) for p in links), s) for k, a, b, g, links, s in docs]


def data(seed, n):
    rng = random.Random(seed)
    rows = [(k, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))) for k in range(n)]
    return rows + [(n, None), (n, ""), (None, " "), (None, "a▁b c"), (n + 1, "same same"), (n + 1, "same same"), (n + 2, "-" * 3000), (n + 3, " " * 500), (n + 4, "中" * 300), (n + 5, "hello " * 900)]


@pytest.mark.parametrize(("chars", "kept"), [(2 << 20, 150_000), (300, 150_000), (300, 20)])
def test_against_libraries(spark, libraries, monkeypatch, chars, kept):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", chars)
    monkeypatch.setattr(alignment, "KEPT_CHUNKS", kept)
    rows = data(chars + kept, 200)
    df = spark.createDataFrame([(t, k, 5, "g") for k, t in rows], "text string, doc_id long, n_a int, groups string").repartition(3)
    got = [tuple(r) for r in alignment.align(df, BYTES, PIECES).collect()]
    assert sorted(got, key=repr) == sorted(brute(libraries, rows), key=repr)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert alignment.align(empty, BYTES, PIECES).collect() == []
    null = spark.createDataFrame([("k", None)], "key string, text string")
    assert [tuple(r) for r in alignment.align(null, BYTES, PIECES, key="key").collect()] == [("k", 0, 0, 0, 0, 0, 0, "")]


def test_key_named_as_a_result(spark):
    df = spark.createDataFrame([(1, "a b")], "n_links int, text string")
    with pytest.raises(ValueError, match="n_links"):
        alignment.align(df, BYTES, PIECES, key="n_links")


def test_whole_table(spark, libraries, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in brute(libraries, rows)]
    assert sorted(map(tuple, alignment.op11_alignment(spark, sf).collect())) == sorted(want)
