"""Tokens of two tokenizers aligned by the bytes that they stand for, through a dictionary of groups.

A text is cut where tokens of both end; between two cuts lies a group of A-tokens and B-tokens, mostly one of each. Groups
repeat, so they are interned: a block of texts holds each of its groups once and its texts as numbers of groups. An A-token
and a B-token are linked where their bytes overlap; which tokens of a group are follows from the group alone, so its links
are expanded once a block for the documents that hold a pair, and once for each distinct group of the corpus. What the
corpus knows of a group (its links, those that are their A-id's most frequent, the sum of their counts) is joined back by the
group to the dictionaries of the blocks, where a frequent group is one row a block, not one for each place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBPE, byte_bpe
from .common import table, written
from .piece_codec import gathered
from .pieces import BITS, Merges, PieceModel, piece_model

#: Code points of texts in a block (a longer text is a block of its own).
BLOCK_CHARS = 2 << 20
#: Blocks in a row group of their table, and blocks that a task joins with what the corpus knows, on average.
GROUP, JOINED = 4, 8
#: Chunks of texts, and their code points, that a worker keeps before it starts anew.
KEPT_CHUNKS, KEPT_CHARS = 250_000, 4_000_000


def chunk_pattern(model: PieceModel) -> re.Pattern:
    """Cuts a text where no token of either tokenizer reaches over: in front of a single space between two characters that
    are none, around such a line feed, and between a letter and a mark that stand side by side in no piece."""
    beside = [(chr(k >> BITS), chr(k & ((1 << BITS) - 1))) for k in model.beside[:-1].tolist()]
    held = {y for x, y in beside if re.fullmatch(r"[^\W\d_]", x)} | {c for pair in beside for c in pair if c == "\n"}
    line = r"\n(?=\S)|" * ("\n" not in held)
    mark = "".join(c for c in ".,;:!?" if c not in held)
    word = rf" ?[^\W\d_]++(?=[{mark}])|" if mark else ""
    return re.compile(rf"{line}{word} ?(?:\S++|\s{{2,}}+|[^\S {'\\n' * bool(line)}]|\s\Z)++")


class Chunks:
    """chunk -> number; for each its tokens, its groups and whether both tokenizers give back its bytes."""

    def __init__(self, a: ByteBPE, b: PieceModel):
        self.a, self.b = a, b
        self.a_size = np.array([len(t) for t in a.token_bytes], np.int64)
        self.b_size = np.array([len(t) for t in b.surface], np.int64)
        self.a_merges = Merges(a.merges)
        self.a_bytes = np.array([a.ids[bytes([k])] for k in range(256)], np.int64)
        self.chunks_of = chunk_pattern(b).findall
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.group_numbers: dict[tuple[bytes, bytes], int] = {}
        self.tokens: list[tuple[bytes, bytes]] = []
        self.chars = 0
        self.kept = [(*(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(1, np.int64))]

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.numbers]
        if len(self.numbers) + len(new) > KEPT_CHUNKS or self.chars + sum(map(len, new)) > KEPT_CHARS:
            self.clear()
            new = list(chunks)
        if not new:
            return
        a, a_at = self._bytes(new)
        b, b_at = self.b.encode_words(new)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        good = self._equal(new, b, b_at)
        groups, at = self._cut(a, a_at, a_end, b, b_at, b_end, good)
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
        self.chars += sum(map(len, new))
        self.kept.append((np.diff(a_at), np.diff(b_at), np.array(good), np.array(groups, np.int64), at[1:] + sum(len(k[3]) for k in self.kept)))

    def _bytes(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(A-ids, where each chunk's begin and the end of the last), by the same rounds over bytes."""
        pieces = [[len(p.encode()) for p in self.a.split(c)] for c in chunks]
        raw = np.frombuffer("".join(chunks).encode(), np.uint8)
        sizes = [n for own in pieces for n in own]
        out = self.a_merges.merged(self.a_bytes[raw], np.repeat(np.arange(len(sizes)), sizes))
        left = np.flatnonzero(out >= 0)
        return out[left].astype(np.int32), np.concatenate(([0], np.searchsorted(left, np.cumsum(list(map(sum, pieces))))))

    def _equal(self, chunks: list[str], b: np.ndarray, b_at: np.ndarray) -> list[bool]:
        """Whether B's tokens have the chunk's own bytes; A's always have."""
        odd = {k for k, c in enumerate(chunks) if "▁" in c}
        surface, ends = self.b.surface, b_at.tolist()
        return [k not in odd or b"".join(surface[i] for i in b[ends[k] : ends[k + 1]].tolist()) == c.encode() for k, c in enumerate(chunks)]

    def _cut(self, a, a_at, a_end, b, b_at, b_end, good) -> tuple[list[int], np.ndarray]:
        """(numbers of the chunks' groups, where each chunk's begin); chunks that are not good have none."""
        if not all(good):
            keep = np.array(good)
            on_a, on_b = np.repeat(keep, np.diff(a_at)), np.repeat(keep, np.diff(b_at))
            a, b = a[on_a], b[on_b]
            a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
            sizes = np.where(keep, np.diff(a_at), 0)
            a_at = np.concatenate(([0], np.cumsum(sizes)))
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        to_a, to_b = np.searchsorted(a_end, both) + 1, np.searchsorted(b_end, both) + 1
        first = np.searchsorted(to_a, a_at, side="right")
        raw_a, raw_b = a.astype("<i4").tobytes(), b.astype("<i4").tobytes()
        to_a, to_b = (4 * to_a).tolist(), (4 * to_b).tolist()
        known, tokens, out = self.group_numbers, self.tokens, []
        fa = fb = 0
        for ta, tb in zip(to_a, to_b, strict=True):
            key = raw_a[fa:ta], raw_b[fb:tb]
            n = known.get(key)
            if n is None:
                n = known[key] = len(tokens)
                tokens.append(key)
            out.append(n)
            fa, fb = ta, tb
        first[0] = 0
        return out, first

    def of(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """For known chunks, one after the other: (A-tokens, B-tokens, whether good, numbers of groups, groups of each)."""
        self.kept = [tuple(map(np.concatenate, zip(*self.kept, strict=True)))]
        n_a, n_b, good, groups, at = self.kept[0]
        number = np.fromiter(map(self.numbers.__getitem__, chunks), np.int64, len(chunks))
        sizes = at[number + 1] - at[number]
        return n_a[number], n_b[number], good[number], groups[gathered(at[number], sizes)], sizes


@lru_cache(maxsize=2)
def known_chunks(byte_tokenizer: str, piece_tokenizer: str) -> Chunks:
    """One for each pair of files and Python worker."""
    return Chunks(byte_bpe(byte_tokenizer), piece_model(piece_tokenizer))


def expanded(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of groups given as flat ids: (A-id, B-id, where each group's links begin and the end of the last). Each stretch
    between two ends of tokens of either kind is the overlap of just one A-token and one B-token."""
    a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    ends = np.union1d(a_end, b_end)
    bounds = np.concatenate(([0], a_end))[a_at]
    return a[np.searchsorted(a_end, ends)], b[np.searchsorted(b_end, ends)], np.searchsorted(ends, bounds, side="right")


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), "<i4"), np.array([0, *accumulate(len(p) // 4 for p in parts)], np.int64)


def blocks(df: DataFrame, byte_tokenizer: str, piece_tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per block of texts: block, docs (key, n_a, n_b, groups: places in the dictionary), dictionary (A-ids and B-ids of
    each group, packed), pairs (A-id, B-id, documents of the block that hold it linked)."""
    k, kind = F.col(key), df.schema[key].dataType
    columns = f"block long, docs array<struct<key:{kind.simpleString()},n_a:long,n_b:long,groups:array<int>>>, dictionary array<struct<a:binary,b:binary>>, pairs array<struct<a:int,b:int,docs:long>>"

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = known_chunks(byte_tokenizer, piece_tokenizer)
        block = TaskContext.get().partitionId() << 33
        keys, texts, size = [], [], 0
        for batch in batches:
            for own, t in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(own)
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= BLOCK_CHARS:
                    yield _block(chunks, block, keys, texts)
                    block, keys, texts, size = block + 1, [], [], 0
        if keys:
            yield _block(chunks, block, keys, texts)

    return df.select(k.alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(built, columns)


def _block(chunks: Chunks, block: int, keys: list[pa.Scalar], texts: list[str]) -> pa.RecordBatch:
    own, count = [], []
    for t in texts:
        of_text = chunks.chunks_of(" " + t) if t else []
        own += of_text
        count.append(len(of_text))
    chunks.learn(set(own))
    n_a, n_b, good, groups, sizes = chunks.of(own)
    at = np.concatenate(([0], np.cumsum(np.array(count, np.int64))))
    doc = np.repeat(np.arange(len(texts)), count)
    bad = np.zeros(len(texts), bool)
    bad[doc[~good]] = True
    if bad.any():
        groups, sizes = groups[np.repeat(~bad[doc], sizes)], np.where(bad[doc], 0, sizes)
        n_a, n_b = np.where(bad[doc], 0, n_a), np.where(bad[doc], 0, n_b)
    total = lambda x: np.concatenate(([0], np.cumsum(x)))[at]
    used, local = np.unique(groups, return_inverse=True)
    tokens = [chunks.tokens[k] for k in used.tolist()]
    (a, a_at), (b, b_at) = _flat([t[0] for t in tokens]), _flat([t[1] for t in tokens])
    ends = total(sizes)
    # documents that hold a pair: distinct groups of each document, their links, distinct again
    of_doc = np.unique(np.repeat(np.arange(len(texts)), np.diff(ends)) * (len(used) + 1) + local)
    a_of, b_of, links = expanded(a, a_at, b, b_at, chunks.a_size, chunks.b_size)
    pairs, pair = np.unique(a_of.astype(np.int64) << 32 | b_of, return_inverse=True)
    of_doc, group = of_doc // (len(used) + 1), of_doc % (len(used) + 1)
    width = np.diff(links)[group]
    held = np.unique(np.repeat(of_doc, width) * (len(pairs) + 1) + pair[gathered(links[group], width)])
    docs_of = np.bincount(held % (len(pairs) + 1), minlength=len(pairs))
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    struct = lambda **c: pa.StructArray.from_arrays(list(c.values()), names=list(c))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(local, pa.int32()))
    docs = struct(key=pa.array([x.as_py() for x in keys], keys[0].type), n_a=pa.array(np.diff(total(n_a))), n_b=pa.array(np.diff(total(n_b))), groups=lists)
    dictionary = struct(a=pa.array([t[0] for t in tokens], pa.binary()), b=pa.array([t[1] for t in tokens], pa.binary()))
    held_by = struct(a=pa.array(pairs >> 32, pa.int32()), b=pa.array(pairs & 0xFFFFFFFF, pa.int32()), docs=pa.array(docs_of, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([block]), one(docs), one(dictionary), one(held_by)], names=["block", "docs", "dictionary", "pairs"])


def pair_counts(made: DataFrame) -> DataFrame:
    """a, b, docs: documents of the corpus that hold the pair of ids linked."""
    return made.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("docs").alias("docs"))


def group_links(made: DataFrame, byte_tokenizer: str, piece_tokenizer: str) -> DataFrame:
    """group_a, group_b, a, b: links of each distinct group, in order; packed ids name the group."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_size = np.array([len(t) for t in byte_bpe(byte_tokenizer).token_bytes], np.int64)
        b_size = np.array([len(t) for t in piece_model(piece_tokenizer).surface], np.int64)
        for batch in batches:
            (a, a_at), (b, b_at) = (_flat(c.to_pylist()) for c in batch.columns)
            a_of, b_of, at = expanded(a, a_at, b, b_at, a_size, b_size)
            group = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(at)))
            yield pa.RecordBatch.from_arrays([*(c.take(group) for c in batch.columns), pa.array(a_of, pa.int32()), pa.array(b_of, pa.int32())], names=["group_a", "group_b", "a", "b"])

    distinct = made.select(F.inline("dictionary")).groupBy("a", "b").agg(F.count("*").alias("blocks")).select("a", "b")
    return distinct.mapInArrow(links, "group_a binary, group_b binary, a int, b int")


def align(df: DataFrame, byte_tokenizer: str, piece_tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    groups is ``a1,a2|b1;a3|b2,b3``: the ids of a space and the text by the byte-level tokenizer and of the text by the piece
    tokenizer, cut where both end. n_links counts pairs of tokens whose bytes overlap; a pair of ids counts as many documents
    of the whole corpus as hold it linked; n_best are the links whose count is the highest of their A-id, count_sum is the sum
    of the counts over links. Strings of special tokens are plain text. Null and empty texts, and those whose tokens do not
    give their bytes back (U+2581 reads as a space), have zeros and "". Null and repeated keys pass through, a row each;
    other columns are not read.

    Nothing is keyed by document or by place: shuffles carry a group once a block, a pair once a block, and each block once.
    Blocks are joined a few in a task, however many there are. The highest counts of A-ids are broadcast, a row for each id of the
    vocabulary at most."""
    if key in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"):
        raise ValueError(f"a key named {key} would clash with a column of the result")
    made = written(blocks(df, byte_tokenizer, piece_tokenizer, key, text), "token-blocks", rows=GROUP)
    parts = max(-(-made.count() // JOINED), df.sparkSession.sparkContext.defaultParallelism)
    counts = written(pair_counts(made), "token-pairs")
    best = counts.groupBy("a").agg(F.max("docs").alias("most"))
    links = group_links(made, byte_tokenizer, piece_tokenizer).join(counts, ["a", "b"]).join(F.broadcast(best), "a")
    known = links.groupBy("group_a", "group_b").agg(
        F.count("*").alias("links"), F.sum((F.col("docs") == F.col("most")).cast("long")).alias("best"), F.sum("docs").alias("sum")
    )
    entries = made.select("block", F.posexplode("dictionary").alias("place", "g")).select("block", "place", F.col("g.a").alias("group_a"), F.col("g.b").alias("group_b"))
    found = entries.join(known, ["group_a", "group_b"]).repartition(parts, "block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "links", "best", "sum"))).alias("known"))  # as many as a block has groups
    out = df.select(F.col(key)).schema
    for name in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"):
        out = out.add(name, "long")
    out = out.add("groups", "string")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _documents(batch.column(0)[k].values, batch.column(1)[k].values, batch.column(2)[k], out.names)

    rows = made.select("block", "docs", "dictionary").repartition(parts, "block").join(found, "block", "left").select("docs", "dictionary", "known")
    return rows.mapInArrow(summed, out)


def _documents(docs: pa.StructArray, dictionary: pa.StructArray, known: pa.ListScalar, names: list[str]) -> pa.RecordBatch:
    lists = docs.field("groups")
    at = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))))
    places = np.asarray(lists.flatten())
    columns = [docs.field("key"), docs.field("n_a"), docs.field("n_b"), pa.array(np.diff(at))]
    for name in ("links", "best", "sum"):
        of_group = np.asarray(known.values.field(name)) if known.is_valid else np.zeros(0, np.int64)
        columns.append(pa.array(np.diff(np.concatenate(([0], np.cumsum(of_group[places])))[at]) if len(places) else np.zeros(len(docs), np.int64)))
    ids = lambda raw: ",".join(map(str, np.frombuffer(raw, "<i4").tolist()))
    said = [f"{ids(a)}|{ids(b)}" for a, b in zip(dictionary.field("a").to_pylist(), dictionary.field("b").to_pylist(), strict=True)]
    places, at = places.tolist(), at.tolist()
    columns.append(pa.array([";".join(map(said.__getitem__, places[a:b])) for a, b in zip(at, at[1:], strict=False)], pa.string()))
    return pa.RecordBatch.from_arrays(columns, names=names)


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    aligned = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
