"""From raw edges to trusted ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions import valid
from ..sources.held import written
from .edges import first_wins


def clean_edges(base: DataFrame, deep: DataFrame, known: DataFrame, homes: DataFrame, relations: list[str] | None = None, wars: list[str] = v.VALID_WARS) -> DataFrame:
    """Base edges as they are and the deep ones that pass, the first of each (source, relation, target).

    known: column name, of the entities; a DERIVED_FROM edge must end at one. homes: columns seq, name, home; an EQUIPPED_BY edge
    must not end at its source's home. Other rules: ``relations`` only, valid derivatives that are no part of the entity's
    name, ``wars`` only, valid chassis. base and deep share their columns and one numbering seq."""
    rows = deep.where(F.col("relation").isin(relations or list(v.RELATIONS)) & (F.col("source") != "") & (F.col("target") != ""))
    derived, fought, rides = (F.col("relation") == r for r in ("DERIVED_FROM", "PARTICIPATED_IN", "USES_CHASSIS"))
    rows = rows.where(~derived | (valid.derivative_in_clean(F.col("source")) & ~F.contains("target", F.col("source"))))
    rows = rows.where((~fought | F.col("target").isin(wars)) & (~rides | valid.chassis(F.col("target"))))
    rows = written(rows, "deep-edges")  # two relations are looked at apart below; what made the edges must not run for each
    names = known.select(F.col("name").alias("target")).distinct()
    rows = rows.where(~derived).unionByName(rows.where(derived).join(names, "target", "left_semi"))
    home = homes.groupBy(F.col("name").alias("source")).agg(F.max_by("home", "seq").alias("home"))  # the last one holds
    equipped = F.col("relation") == "EQUIPPED_BY"
    rows = rows.where(~equipped).unionByName(rows.where(equipped).join(home, "source", "left").where("home is null or target <> home").drop("home"))
    return first_wins(base.unionByName(rows, allowMissingColumns=True))


def clean_entities(kept_deep: DataFrame) -> DataFrame:
    """label, name of the ends of kept deep edges: no Artillery and no Category, and a Country only as target."""
    ends = [F.struct(F.lit(e).alias("end"), F.col(f"{e}_type").alias("label"), F.col(e).alias("name")) for e in ("source", "target")]
    found = kept_deep.select(F.inline(F.array(*ends))).where("end = 'target' or label <> 'Country'").select("label", "name")  # one pass
    return found.where(~F.col("label").isin("Artillery", "Category") & (F.col("name") != "")).distinct()
