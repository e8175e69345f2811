"""Many keywords searched for in one pass: goto, fail and output arrays over the bytes of UTF-8.

The trie is built level by level, all words at once. Each node's row of ``step`` is its fail node's row with its own children
written over it, so that reading a byte is one look-up. Texts are read in lanes side by side: a lane begins so far before its
piece that no keyword over its edge is lost, and all lanes move on by a byte at a time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Bytes of a text that one lane reads, besides those before it; texts times words up to which hits are marked in a table.
LANE, MARKS = 512, 1 << 24


@dataclass
class Automaton:
    """column: of each byte, 0 for bytes of no word; step: next node of node and column; word: of each node its own word or
    -1; output: the nearest node that ends a word, itself or by fail links, or 0; shorter: the next such node after it."""

    column: np.ndarray
    step: np.ndarray
    word: np.ndarray
    output: np.ndarray
    shorter: np.ndarray
    longest: int


def build(words: Sequence[str]) -> Automaton:
    """Of different words, none empty; a word's number is its place in the list."""
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(w) for w in raw], np.int64)
    start = np.cumsum(size) - size
    column = np.zeros(256, np.int64)
    used = np.unique(data)
    column[used] = np.arange(1, len(used) + 1)
    width, longest = len(used) + 1, int(size.max(initial=0))
    at, nodes, levels = np.zeros(len(raw), np.int64), 1, []
    for depth in range(longest):
        alive = np.flatnonzero(size > depth)
        edges, place = np.unique(at[alive] * width + column[data[start[alive] + depth]], return_inverse=True)
        at[alive] = nodes + place
        levels.append((nodes + np.arange(len(edges)), edges // width, edges % width))
        nodes += len(edges)
    word = np.full(nodes, -1, np.int64)
    word[at] = np.arange(len(raw))
    step = np.zeros((nodes, width), np.int32)
    fail, output, shorter = (np.zeros(nodes, np.int32) for _ in range(3))
    for own, parent, byte in levels:
        fail[own] = np.where(parent == 0, 0, step[fail[parent], byte])
        step[parent, byte] = own
        step[own] = step[fail[own]]
        shorter[own] = output[fail[own]]
        output[own] = np.where(word[own] >= 0, own, shorter[own])
    return Automaton(column, step, word, output, shorter, longest)


def found(of: Automaton, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, word) of all words that stand in the texts, each once for a row; ``ends``: where each text ends in data, and
    before them where the first begins."""
    begin, size = ends[:-1], np.diff(ends)
    lanes = -(-size // LANE)
    row = np.repeat(np.arange(len(size)), lanes)
    offset = (np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
    first = begin[row] + np.maximum(0, offset - of.longest + 1)
    length = np.minimum(begin[row] + offset + LANE, ends[1:][row]) - first
    order = np.argsort(-length, kind="stable")  # so that the lanes that go on are the first ones
    row, first, length = row[order], first[order], length[order]
    node, hits = np.zeros(len(row), np.int32), [np.zeros(0, np.int64)]
    nodes, ended = len(of.word), np.flatnonzero(of.word >= 0)
    few = len(size) * len(ended) <= MARKS  # else they are sorted out at each step
    number, marks = np.cumsum(of.word >= 0) - 1, np.zeros((len(size), len(ended)) if few else (0, 0), bool)
    going = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left").tolist()
    for k, n in enumerate(going):
        node = of.step[node[:n], of.column[data[first[:n] + k]]]
        out = of.output[node]
        hit = np.flatnonzero(out)
        if len(hit) and few:
            marks[row[hit], number[out[hit]]] = True
        elif len(hit):
            hits.append(np.unique(row[hit] * nodes + out[hit]))
    if few:
        text, place = np.nonzero(marks)
        hits.append(text * nodes + ended[place])
    seen = np.unique(np.concatenate(hits))
    every = [seen]
    while len(seen):  # words that end where a longer one does
        out = of.shorter[seen % nodes]
        seen = np.unique((seen // nodes * nodes + out)[out > 0])
        every.append(seen)
    seen = np.unique(np.concatenate(every))
    return seen // nodes, of.word[seen % nodes]
