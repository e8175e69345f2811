"""Exact deduplication by Patricia tries, each of which owns the texts of some lengths and content hashes.

Two rounds keep copies from meeting in one task. First each task inserts the texts of its own input into a trie and keeps
of each different text one row, with the smallest identifier and the number of copies, besides a short row for each
document. Then only those texts are shuffled, by length and content hash, to the tries that own them; a text of which a
third of all documents are copies arrives at its owner once for each task. An owner's decisions go back by the identifier
that a text got in the first round, of which no more documents hang on one than the task had that gave it.

Texts are told apart by their bytes on the way through a trie, never by a hash. A terminal node stores the smallest
identifier seen and the number of copies. A trie that outgrows its memory writes its largest subtree to a file and keeps a
stub there; what comes to a stub later goes to its file, and at the end each file is worked off as a trie of its own.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import table, written

#: Bytes of labels that a trie holds before it spills a subtree.
TRIE_BYTES = 64 << 20
#: Bytes that a node, and a representative's name, count for besides.
NODE_BYTES, NAME_BYTES = 300, 80
#: Texts that a batch of Arrow rows holds at most on the way to owners.
OUT_ROWS = 256


class Node:
    """An edge label and what hangs below it. A node with ``entry`` ends a text; one with ``file`` was spilled."""

    __slots__ = ("children", "entry", "file", "label")

    def __init__(self, label: bytes, entry=None):
        self.label, self.entry, self.children, self.file = label, entry, {}, None


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Patricia:
    """text -> (smallest identifier, copies, representative's other fields) for any number of texts in bounded memory."""

    def __init__(self, most: int = TRIE_BYTES):
        self.root, self.held, self.most = Node(b""), 0, most

    def insert(self, text: bytes, entry: list, absorb: bool = False) -> list:
        """Returns the terminal's entry: ``entry`` itself where the text is new or its place was spilled, else the known one
        after the merge. absorb: the known entry's representatives stand for the new one."""
        node, at = self.root, 0
        while True:
            if node.file is not None:
                pickle.dump((text[at:], entry), node.file)
                return entry
            if at == len(text):
                known = node.entry
                if known is None:
                    node.entry = known = entry
                else:
                    _merge(known, entry, absorb)
                if known is entry or not absorb:
                    self._grown(NAME_BYTES * len(entry[2]))
                return known
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = Node(text[at:], entry)
                self._grown(len(text) - at + NODE_BYTES + NAME_BYTES * len(entry[2]))
                return entry
            rest = text[at : at + len(child.label)]
            same = _common(child.label, rest)
            if same < len(child.label):  # the edge parts here
                upper = Node(child.label[:same])
                child.label = child.label[same:]
                upper.children[child.label[0]] = child
                node.children[text[at]] = child = upper
                self.held += NODE_BYTES
            node, at = child, at + same

    def _grown(self, n: int) -> None:
        self.held += n
        while self.held > self.most and self._spill():
            pass

    def _spill(self) -> bool:
        """Writes the largest subtree under the first fork to a file."""
        node = self.root
        while len(node.children) == 1 and node.entry is None:
            node = next(iter(node.children.values()))
        whole = {k: _weight(c) for k, c in node.children.items() if c.file is None}
        if not whole:
            return False
        child = node.children[max(whole, key=whole.get)]
        stub = tempfile.TemporaryFile(buffering=1 << 16)
        for tail, entry in _entries(child, b""):
            pickle.dump((tail[len(child.label) :], entry), stub)
        child.children, child.entry, child.file = {}, None, stub
        self.held -= max(whole.values()) - len(child.label) - NODE_BYTES
        return True

    def entries(self) -> Iterator[tuple[bytes, list]]:
        """Each text once with its entry; spilled subtrees one after the other, each in as much memory as this one."""
        stubs: list[tuple[bytes, object]] = []
        yield from _entries(self.root, b"", stubs)
        self.root = Node(b"")
        while stubs:
            prefix, file = stubs.pop()
            own = Patricia(self.most)
            size = file.seek(0, os.SEEK_END)
            file.seek(0)
            while file.tell() < size:
                own.insert(*pickle.load(file))
            file.close()
            yield from _entries(own.root, prefix, stubs)


def _merge(known: list, new: list, absorb: bool) -> None:
    """Entry: [smallest identifier or None, copies, representatives]."""
    if new[0] is not None and (known[0] is None or new[0] < known[0]):
        known[0] = new[0]
    known[1] += new[1]
    if not absorb:
        known[2].extend(new[2])


def _weight(node: Node) -> int:
    total, todo = 0, [node]
    while todo:
        n = todo.pop()
        total += len(n.label) + NODE_BYTES + (NAME_BYTES * len(n.entry[2]) if n.entry else 0)
        todo += n.children.values()
    return total


def _entries(node: Node, before: bytes, stubs: list | None = None) -> Iterator[tuple[bytes, list]]:
    todo = [(node, before)]
    while todo:
        n, prefix = todo.pop()
        prefix += n.label
        if n.file is not None:
            if stubs is None:  # a stub inside a subtree that is spilled: its texts move along
                size = n.file.seek(0, os.SEEK_END)
                n.file.seek(0)
                while n.file.tell() < size:
                    tail, entry = pickle.load(n.file)
                    yield prefix + tail, entry
                n.file.close()
            else:
                stubs.append((prefix, n.file))
        if n.entry is not None:
            yield prefix, n.entry
        todo += ((c, prefix) for c in n.children.values())


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after white-space runs became single spaces; null counts as empty. keep_id is the smallest
    key of the group (null if it has none), kept whether the row's key is it. Of rows that repeat the smallest key all are
    kept; a row with a null key is kept only where its whole group has none. A column whose name the key has gets a ``_`` behind
    its own. An empty table gives none."""
    df = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out, key, text = key, "key", "text"
    first = StructType([df.schema[key]]).add("rep", "string").add("size", "long").add("body", "binary").add("sha", "string").add("of", "string")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document with its representative, a row with body per different text of the task, and a row without for
        each further representative that a text got because its place was spilled: it stands for the first one.

        Representatives differ from those of all other tasks."""
        task, n = TaskContext.get().partitionId(), 0
        trie = Patricia(most)
        for batch in batches:
            reps = []
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n += 1
                reps.append(trie.insert(body, [k, 1, [f"{task}-{n}"]], absorb=True)[2][0])
            columns = [batch.column(0), pa.array(reps, pa.string()), pa.nulls(len(reps), pa.int64()), pa.nulls(len(reps), pa.binary()), batch.column(2), pa.nulls(len(reps), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=first.names)
        for rows in _in_batches(trie.entries()):
            k, rep, size, body = zip(*((e[0], e[2][0], e[1], text) for text, e in rows), strict=True)
            columns = [pa.array(k, kind), pa.array(rep), pa.array(size, pa.int64()), pa.array(body, pa.binary()), *(pa.nulls(len(k), pa.string()) for _ in range(2))]
            yield pa.RecordBatch.from_arrays(columns, names=first.names)
            more = [(rep, e[2][0]) for _, e in rows for rep in e[2][1:]]
            for a in range(0, len(more), 10_000):
                rep, of = zip(*more[a : a + 10_000], strict=True)
                columns = [pa.nulls(len(rep), kind), pa.array(rep), pa.nulls(len(rep), pa.int64()), pa.nulls(len(rep), pa.binary()), pa.nulls(len(rep), pa.string()), pa.array(of)]
                yield pa.RecordBatch.from_arrays(columns, names=first.names)

    owned = StructType([first["rep"], df.schema[key]]).add("size", "long")

    def owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia(most)
        for batch in batches:
            for k, rep, size, body in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                trie.insert(body, [k, size, [rep]])
        for rows in _in_batches(trie.entries()):
            rep, k, size = zip(*((rep, e[0], e[1]) for _, e in rows for rep in e[2]), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(k, kind), pa.array(size, pa.int64())], names=owned.names)

    kind = to_arrow_type(df.schema[key].dataType)
    body = normalised(F.col(text)).cast("binary")
    once = written(df.select(F.col(key), body.alias("body")).select(key, "body", F.sha2("body", 256).alias("sha")).mapInArrow(local, first), "texts")

    texts = once.where("body is not null").select(key, "rep", "size", "body")
    decided = texts.repartition(F.octet_length("body"), F.xxhash64("body")).mapInArrow(owner, owned)
    decided = decided.select("rep", F.col(key).alias("keep_id"), F.col("size").alias("group_size"))
    rows = once.where("sha is not null").select(F.col(key).alias("own"), "rep", F.col("sha").alias("text_sha256"))
    again = once.where("of is not null").select("rep", "of")
    if not again.isEmpty():
        rows = rows.join(again, "rep", "left").select("own", F.coalesce("of", "rep").alias("rep"), "text_sha256")
    kept = F.coalesce(F.col("own") == F.col("keep_id"), F.col("keep_id").isNull())
    given = {"keep_id": F.col("keep_id"), "group_size": F.col("group_size"), "kept": kept, "text_sha256": F.col("text_sha256")}
    return rows.join(decided, "rep").select(F.col("own").alias(out), *(c.alias(f"{n}_" if n == out.lower() else n) for n, c in given.items()))


def _in_batches(entries: Iterator[tuple[bytes, list]]) -> Iterator[list[tuple[bytes, list]]]:
    rows, n = [], 0
    for row in entries:
        rows.append(row)
        n += len(row[0])
        if len(rows) >= OUT_ROWS or n > 4 << 20:
            yield rows
            rows, n = [], 0
    if rows:
        yield rows


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
     g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, keep_id IS NULL) AS kept, sha256(body) AS text_sha256
FROM t JOIN g USING (body)
"""
