"""Fingerprints and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from quillgraph.llm import simhash
from quillgraph.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, k=4):
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, nodes):
    top = {n: n for n in nodes}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def plain(rows):
    fps = {k: plain_fingerprint(t) for k, t in rows}
    keys = sorted(fps)
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4]
    own = plain_components(pairs, keys)
    return {(k, f"{fps[k]:016x}", own[k]) for k in keys}


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {tuple(r) for r in simhash.op10_simhash(spark, sf).collect()} == plain(rows)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one\vTWO"), (6, "word " * 3000), (7, "É é"), (8, "é é")]
    df = spark.createDataFrame([(k, t, "x", 0) for k, t in rows], "doc_id long, text string, fp string, component string")
    assert {tuple(r) for r in simhash.near_duplicates(df).collect()} == plain(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    twice = simhash.near_duplicates(df.unionAll(df.where("doc_id = 4"))).where("doc_id = 4").collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    no_key = spark.createDataFrame([(None, "a b c d"), (9, "a b c d"), (None, "q r s t u v")], "doc_id long, text string")
    assert sorted(str((r.doc_id, r.component_id)) for r in simhash.near_duplicates(no_key).collect()) == ["(9, 9)", "(None, 9)", "(None, None)"]
    assert sorted(r.doc_id for r in simhash.deduplicated(df).collect()) == [1, 4, 6, 7, 8]


def cloud(seed, centres, n, flips):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(centres)]
    return sorted({rng.choice(base) ^ sum(1 << b for b in set(rng.randrange(64) for _ in range(rng.randint(0, flips)))) for _ in range(n)})


@pytest.mark.parametrize(("list_size", "flips"), [(2_000, 9), (5, 7), (2, 12)])
def test_links_of_dense_groups(spark, list_size, flips):
    """Long lists go to finer keys and nothing is lost."""
    fps = cloud(list_size, 4, 700, flips)
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 4]
    want = plain_components(pairs, fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), 4, list_size).collect()
    assert all((int(np.int64(r.a).view(np.uint64)) ^ int(np.int64(r.b).view(np.uint64))).bit_count() <= 4 for r in links)
    got = plain_components([(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in links], fps)
    assert got == want


def test_spanning_links():
    fps = np.array(cloud(8, 3, 900, 10), np.uint64)
    near = lambda x, y: simhash.linked(x, y, 4)
    links, pivots = simhash.spanning_links(fps, near, lambda x, y: np.bitwise_count(x ^ y) <= 12)
    assert len(links) < len(fps) and len(pivots) < len(fps)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 4]
    assert plain_components(links, range(len(fps))) == plain_components(pairs, range(len(fps)))
    starts, ends = np.array([3, 100, 500]), np.array([40, 101, 620])
    found = simhash.pair_links(starts, ends, fps, near)
    inside = [(i, j) for i, j in pairs if any(s <= i and j < e for s, e in zip(starts, ends, strict=True))]
    assert plain_components(found, range(len(fps))) == plain_components(inside, range(len(fps)))


def test_tally():
    """Linked fingerprints share the guaranteed number of positional bytes, and two of the rarest by any ranks."""
    rng = random.Random(11)
    ranks = np.array(rng.sample(range(2048), 2048)).reshape(8, 256)
    for _ in range(2000):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6)))
        shared = [p for p in range(8) if (x ^ y) >> 8 * p & 0xFF == 0]
        assert simhash.tallies(np.array([x ^ y], np.uint64))[0] == len(shared)
        assert simhash.linked(np.array([x], np.uint64), np.array([y], np.uint64), 4)[0] == ((x ^ y).bit_count() <= 4)
        if (x ^ y).bit_count() <= 4:
            rarest = [set(sorted(((p, v >> 8 * p & 0xFF) for p in range(8)), key=lambda t: ranks[t])[:6]) for v in (x, y)]
            assert len(shared) >= 4 and len(rarest[0] & rarest[1]) >= 2


def test_components(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(40)] + [(100, 100), (200, 150), (150, 170)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)]
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    assert got == plain_components([p for p in pairs if p[0] != p[1]], nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
