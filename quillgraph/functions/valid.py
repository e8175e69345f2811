"""Which names, nodes and edges count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as v


def _has(x: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def _derivative(x: Column, words: list[str]) -> Column:
    fits = (F.length(x) <= 24) & ~_has(x, words) & ~x.rlike(r"(?U)^\d{4,}$") & (F.regexp_count(x, F.lit("[一-龥]")) <= 6) & x.rlike("[A-Za-z0-9]")
    return F.coalesce((x != "") & fits, F.lit(False))


def derivative_in_clean(x: Column) -> Column:
    """A derivative's name, as cleaning judges it."""
    return _derivative(x, v.NOT_DERIVATIVES_CLEAN)


def derivative_in_view(x: Column) -> Column:
    """A derivative's name, as the shown graph judges it: other words, and no long names with spaces."""
    return _derivative(x, v.NOT_DERIVATIVES_SHOWN) & F.coalesce(~(F.contains(x, F.lit(" ")) & (F.length(x) > 16)), F.lit(False))


def derivative_row(x: Column) -> Column:
    """A name that a derivative table may yield."""
    many = (F.length(x) > 10) & (F.regexp_count(x, F.lit("[一-鿿]")) > F.length(x) * 0.5)
    return F.coalesce(x.rlike("[A-Za-z0-9]") & ~x.rlike(r"(?U)^\d{1,4}$") & (F.length(x) <= 40) & ~many, F.lit(False))


def chassis(x: Column) -> Column:
    return F.coalesce((x != "") & (_has(x, v.CHASSIS_WORDS) | ~x.isin(v.NOT_CHASSIS)), F.lit(False))


def node(label: Column, name: Column, view: str = "trusted", labels: list[str] | None = None) -> Column:
    named = F.coalesce(name != "", F.lit(False))
    if view == "full":
        return named
    return named & F.coalesce(label.isin(labels or v.LABELS), F.lit(False)) & ((label != "Derivative") | derivative_in_view(name))


def edge(view: str = "trusted", relations: list[str] | None = None, labels: list[str] | None = None) -> Column:
    """Of columns source, source_type, relation, target, target_type."""
    s, t, r = F.col("source"), F.col("target"), F.col("relation")
    fits = node(F.col("source_type"), s, view, labels) & node(F.col("target_type"), t, view, labels)
    fits = fits & ~((r == "EQUIPPED_BY") & (s == t)) & ~((r == "DERIVED_FROM") & F.contains(t, s))
    return fits if view == "full" else fits & F.coalesce(r.isin(relations or list(v.RELATIONS)), F.lit(False))
