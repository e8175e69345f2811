"""Tables of derivatives in running text: the one extractor that needs a line-by-line reading."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions import valid

_GAP = re.compile(r"\s{2,}|\t")
_MODEL = re.compile(r"[A-Za-z0-9\-]")
_PROSE = re.compile(r"[一-龥]{3}")
_NAMED = re.compile(r"[A-Za-z0-9一-鿿]")


#: Bytes of texts, or lines of lists, that are read at once.
BYTES = 1 << 20
#: What ``text.stripped`` takes off, and what Python's patterns hold for white space.
_WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _is_model(line: str) -> bool:
    return len(line) <= 30 and bool(_MODEL.search(line)) and not _PROSE.match(line)


def table_rows(rows: list[str]) -> list[tuple[str, str]]:
    """(name, description) of the stripped lines of a section.

    Heads are skipped. If one of the first three lines has columns, each line with columns is a row; else names and
    descriptions alternate, a description being what follows a name and is neither a name nor noise."""
    name_head, note_head = v.TABLE_HEADS
    at = 0
    while at < len(rows) and (rows[at] in (v.SECTION, note_head) or rows[at] == name_head and rows[at + 1 : at + 2] == [note_head]):
        at += 1
    rows = rows[at:]
    noisy = lambda line: any(w in line for w in v.TABLE_NOISE)
    page_number = lambda name: name.isdigit() and len(name) <= 4
    if any(len(_GAP.split(line)) > 1 for line in rows[:3]):
        split = [(p[0].strip(), " ".join(p[1:]).strip()) for line in rows if not noisy(line) and len(p := _GAP.split(line)) > 1]
        return [(n, d) for n, d in split if _NAMED.search(n) and not page_number(n) and len(n) <= 50]
    out, lines = [], iter(range(len(rows)))
    for k in lines:
        if noisy(rows[k]) or not _is_model(rows[k]):
            continue
        after = rows[k + 1] if k + 1 < len(rows) else None
        described = after is not None and not _is_model(after) and not any(w in after for w in v.NOT_DESCRIPTIONS)
        if described:
            next(lines)
        if not page_number(rows[k]):
            out.append((rows[k], after if described else ""))
    return out


def sliced(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose second column has about ``most`` elements of lists, or bytes of texts; a row stays whole."""
    length = pc.list_value_length if pa.types.is_list(batch.column(1).type) else pc.binary_length
    sizes = pc.fill_null(length(batch.column(1)), 0).to_pylist()
    first = held = 0
    for k, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += n
    yield batch.slice(first)


def section(text: str | None, least: int = 10) -> str | None:
    """What ``text.section`` cuts out."""
    first = -1 if text is None else text.find(v.SECTION)
    if first < 0:
        return None
    return text[first : min((p for e in v.SECTION_ENDS if (p := text.find(e, first + least)) >= 0), default=None)]


def _any(words: list[str]) -> str:
    return "|".join(map(re.escape, words))


def tables(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """(place of the text, number in it, name, description) of what ``table_rows`` gives for the section of each text. All lines are
    judged at once; only texts whose table has columns are read line by line."""
    lists = pc.split_pattern(pa.array(map(section, texts), pa.large_string()), "\n")
    lines, own = pc.utf8_trim(pc.list_flatten(lists), characters=_WHITE), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = np.asarray(pc.not_equal(lines, ""))
    lines, own = lines.filter(pa.array(full)), own[full]
    says = lambda pattern, x=lines: pc.match_substring_regex(x, pattern).to_numpy(zero_copy_only=False)
    is_ = lambda word: pc.equal(lines, word).to_numpy(zero_copy_only=False)
    followed = np.append(own[1:] == own[:-1], False)[: len(own)]  # by a line of the same text
    after = lambda flag: np.append(flag[1:], False)[: len(flag)]  # noqa: E731  # of the next line
    name_head, note_head = v.TABLE_HEADS
    head = is_(v.SECTION) | is_(note_head) | is_(name_head) & followed & after(is_(note_head))
    body = np.flatnonzero(~head)
    begin, end = (np.searchsorted(own, np.arange(len(texts)), side=side) for side in ("left", "right"))
    begin = np.minimum(np.append(body, len(own))[np.searchsorted(body, begin)], end)  # behind the heads
    early = np.unique(np.concatenate([np.minimum(begin + k, end)[begin + k < end] for k in range(3)]))
    with_columns = np.zeros(len(texts), bool)
    with_columns[own[early[says(f"[{_SPACE}]{{2,}}|\t", lines.take(pa.array(early)))]]] = True

    model = pc.less_equal(pc.utf8_length(lines), 30).to_numpy(zero_copy_only=False) & says(r"[A-Za-z0-9\-]") & ~says(r"^[一-龥]{3}")
    named = np.flatnonzero(model & ~says(_any(v.TABLE_NOISE)) & (np.arange(len(own)) >= begin[own]) & ~with_columns[own])
    names = lines.take(pa.array(named))
    digits = np.flatnonzero(pc.less_equal(pc.utf8_length(names), 4).to_numpy(zero_copy_only=False) & ~says(r"[A-Za-z\-]", names))
    pages = digits[[x.isdigit() for x in names.take(pa.array(digits)).to_pylist()]] if len(digits) else digits
    named = np.delete(named, pages)
    # a line behind a name is its description unless it is a name itself, so it begins no row
    described = (followed & ~after(model | says(_any(v.NOT_DESCRIPTIONS))))[named]
    notes = lines.take(pa.array(np.where(described, named + 1, named)))
    place = own[named].astype(np.int64)
    at, name, note = [place], [lines.take(pa.array(named))], [pc.if_else(pa.array(described), notes, "")]
    ord_ = [np.arange(len(place)) - np.searchsorted(place, place)]
    for k in np.flatnonzero(with_columns).tolist():
        rows = table_rows(lines.slice(begin[k], end[k] - begin[k]).to_pylist())
        at.append(np.full(len(rows), k))
        ord_.append(np.arange(len(rows)))
        name.append(pa.array([r[0] for r in rows], pa.large_string()))
        note.append(pa.array([r[1] for r in rows], pa.large_string()))
    return np.concatenate(at), np.concatenate(ord_), pa.concat_arrays(name).cast(pa.string()), pa.concat_arrays(note).cast(pa.string())


def derivatives(docs: DataFrame, key: str = "name", body: str = "text") -> DataFrame:
    """key, ord, derivative, description: rows of the derivative table of each text that has one; null text has none. Texts go to the
    workers as they are: a plan that cuts and splits them does so again for each place that reads the lines."""
    source = docs.select(F.col(key).alias("key"), F.col(body).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, BYTES):
                at, n, name, note = tables(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(n, pa.int32()), name, note], names=["key", "ord", "derivative", "description"])

    found = source.mapInArrow(read, f"key {kind}, ord int, derivative string, description string")
    return found.where(valid.derivative_row(F.col("derivative"))).withColumnRenamed("key", key)
