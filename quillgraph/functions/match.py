"""Matching titles and texts against ordered patterns and dictionaries.

A dictionary is a literal in the plan, so a match is a projection and never a join. Keywords are data: pass your own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as v
from .text import stripped

Dictionary = list[tuple[str, list[str]]]
#: Keywords up to which a dictionary is a literal; ``operators.dictionaries`` takes longer ones, as a table.
LITERAL_KEYWORDS = 500


def literal(entries: Dictionary) -> Column:
    return F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, words)).alias("words")) for name, words in entries))


def matches(entries: Dictionary, *texts: Column) -> Column:
    """Names of which a keyword stands in one of the texts, each once, in the dictionary's order."""
    hit = lambda w: F.greatest(*(F.coalesce(F.contains(t, w), F.lit(False)) for t in texts)) if len(texts) > 1 else F.coalesce(F.contains(texts[0], w), F.lit(False))
    return F.transform(F.filter(literal(entries), lambda d: F.exists(d["words"], hit)), lambda d: d["name"])


def prefix_match(title: Column, prefixes: Dictionary = v.COUNTRY_PREFIXES) -> Column:
    """(names, rest) of the first prefix that the title starts with; null if none."""
    fits = F.get(F.filter(literal(prefixes), lambda p: F.startswith(title, p["name"])), 0)
    return F.when(fits.isNotNull(), F.struct(fits["words"].alias("names"), title.substr(F.length(fits["name"]) + 1, F.length(title)).alias("rest")))


def first_contained(x: Column, words: list[str] = v.MODIFIERS) -> Column:
    """The first of the words, in their order, that x contains; empty if none."""
    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(x, w)), 0), F.lit(""))


def without(x: Column, words: list[str] = v.MODIFIERS) -> Column:
    """x without the words, taken out one after the other, stripped."""
    for w in words:
        x = F.replace(x, F.lit(w))
    return stripped(x)


def cleaned_title(x: Column, quotes: str = v.QUOTES) -> Column:
    return stripped(F.translate(x, quotes, ""))


def title_parts(rest: Column, suffixes: list[str] = v.SUFFIXES, unit: str = v.UNIT) -> Column:
    """(caliber, model, kind) of what follows the country in a title; null if it ends in no known suffix."""
    ends = "(" + "|".join(suffixes) + ")"
    sized, plain = rf"(?U)^(\d+){unit}(.+?){ends}$", rf"(?U)^(.+?){ends}$"
    has_size = rest.rlike(sized)
    part = lambda with_size, without_size: F.when(has_size, F.regexp_extract(rest, sized, with_size)).otherwise(F.regexp_extract(rest, plain, without_size))
    caliber = F.when(has_size, F.concat(F.regexp_extract(rest, sized, 1), F.lit(unit))).otherwise(F.lit(""))
    return F.when(rest.rlike(plain), F.struct(caliber.alias("caliber"), stripped(part(2, 1)).alias("model"), part(3, 2).alias("kind")))
