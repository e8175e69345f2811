"""Text and number columns. White space and digits are Unicode's, as ``(?U)`` makes Java's patterns take them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as v

NUMBER = v.NUMBER
CJK = "[一-龥]"


def stripped(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalised_name(x: Column) -> Column:
    """Without any white space, in lower case."""
    return F.lower(F.regexp_replace(x, r"(?U)\s+", ""))


def number(x: Column, kilometres: bool = False) -> Column:
    """The double that a measured value means, null if it is none. Commas and 米 go; with ``kilometres``, 千米 counts 1000."""
    bare = F.replace(F.replace(x.cast("string"), F.lit(",")), F.lit("千米"), F.lit("000")) if kilometres else F.replace(x.cast("string"), F.lit(","))
    bare = stripped(F.replace(bare, F.lit("米")))
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def general(x: Column) -> Column:
    """A double as %g writes it: six significant digits, no zeros at the end, an exponent below 1e-4 and from 1e6 on."""
    short = F.format_string("%.5e", x)  # rounded to six digits before the form is chosen
    power = F.regexp_extract(short, r"e([+-]\d+)$", 1).cast("int")
    bare = lambda s: F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    plain = F.when(power == 5, F.format_string("%.0f", x)).when(power == 4, F.format_string("%.1f", x)).when(power == 3, F.format_string("%.2f", x)).when(power == 2, F.format_string("%.3f", x))
    plain = plain.when(power == 1, F.format_string("%.4f", x)).when(power == 0, F.format_string("%.5f", x)).when(power == -1, F.format_string("%.6f", x))
    plain = plain.when(power == -2, F.format_string("%.7f", x)).when(power == -3, F.format_string("%.8f", x)).otherwise(F.format_string("%.9f", x))
    exponent = F.concat(bare(F.regexp_extract(short, r"^(.*)e", 1)), F.lit("e"), F.regexp_extract(short, r"e(.*)$", 1))
    return F.when(x == 0, "0").when(power.between(-4, 5), bare(plain)).otherwise(exponent)


def tokens(x: Column, stop_words: list[str] = v.STOP_WORDS) -> Column:
    """Latin words and runs of two and more Chinese characters, in order, without stop words."""
    found = F.regexp_extract_all(x, F.lit(v.TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(stop_words)) if stop_words else found


def parameters(x: Column, patterns: dict[str, str] = v.PARAMETERS) -> Column:
    """Map of what the patterns' first groups catch, without commas; keys that catch nothing are absent."""
    pairs = [F.struct(F.lit(k).alias("k"), F.nullif(F.replace(F.regexp_extract(x, f"(?U){p}", 1), F.lit(",")), F.lit("")).alias("v")) for k, p in patterns.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["v"].isNotNull()))


def parameter(x: Column, pattern: str) -> Column:
    return F.nullif(F.replace(F.regexp_extract(x, f"(?U){pattern}", 1), F.lit(",")), F.lit(""))


def section(x: Column, head: str = v.SECTION, ends: list[str] = v.SECTION_ENDS, least: int = 10) -> Column:
    """From ``head`` to the nearest of ``ends`` that starts ``least`` characters on or later; null without a head."""
    from_head = F.when(F.locate(head, x) > 0, x.substr(F.locate(head, x), F.length(x)))
    found = F.filter(F.array(*(F.position(F.lit(e), from_head, F.lit(least + 1)) for e in ends)), lambda p: p > 0)
    end = F.coalesce(F.array_min(found) - 1, F.length(from_head))
    return from_head.substr(F.lit(1), end)


def slice_after(x: Column, head: str, n: int) -> Column:
    """``n`` characters from ``head`` on; null without it."""
    return F.when(F.locate(head, x) > 0, x.substr(F.locate(head, x), F.lit(n)))


def lines(x: Column) -> Column:
    """Stripped lines that are not empty."""
    return F.filter(F.transform(F.split(x, "\n"), stripped), lambda t: t != "")


def columns_of(line: Column) -> Column:
    """(name, rest) of a line whose parts are two or more spaces or a tab apart."""
    parts = F.split(line, r"(?U)\s{2,}|\t")
    return F.struct(stripped(F.get(parts, 0)).alias("name"), stripped(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " ")).alias("rest"), F.size(parts).alias("n"))


def hashed_name(x: Column, n: int = 12) -> Column:
    """File name of a picture: the start of the name's MD5."""
    return F.substring(F.md5(x.cast("binary")), 1, n)


def canonical_path(x: Column, root: str) -> Column:
    """Forward slashes, under ``root``; a leading ../ before data goes, and so do . and .. inside."""
    path = F.replace(x, F.lit("\\"), F.lit("/"))
    path = F.when(path.startswith("../data"), F.substring(path, 4, 1 << 30)).otherwise(path)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.when(F.coalesce(x, F.lit("")) == "", "").otherwise(F.concat(F.lit("/"), F.array_join(walked, "/")))


def relations_in_reply(x: Column) -> Column:
    """Array of relation structs in a model's reply: the text from its first brace to its last, as JSON; null if it is none."""
    schema = "relations array<struct<source string, source_type string, relation string, target string, target_type string>>"
    return F.from_json(F.regexp_extract(x, r"(?s)\{.*\}", 0), schema)["relations"]


def joined_or(items: Column, empty: str, by: str = "；") -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, by)).otherwise(F.lit(empty))
