"""Tests of indicators by what is done to their evidence: values masked at levels of missingness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = (0.0, 0.10, 0.25, 0.50)


def share_of(*keys: Column | str) -> Column:
    """A row's place between 0 and 1 by the first 32 bits of its keys' SHA-256, the same at any partitioning. Null keys count as
    empty."""
    text = F.concat_ws(":", *(F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / 0xFFFFFFFF


def masked(rows: DataFrame, column: str, keys: list[str | Column], levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """The rows once for each level, with column null where the row's share is below it: what a level masks, higher ones do."""
    out = rows.withColumn("_share", share_of(*keys)).withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    return out.withColumn(column, F.when(F.col("_share") >= F.col("level"), F.col(column))).drop("_share")


def missingness(daily: DataFrame, truth: DataFrame, keys: list[str | Column], levels: tuple[float, ...] = LEVELS, least: int = 3) -> DataFrame:
    """Silent critical assets (NS-01) at each level of masked activity, against planted truth.

    daily: (entity_id, asset_id, criticality, activity) by day; truth: entity_id of those with a planted silence. A masked day is
    no silent day. An entity with fewer than least known days is not assessable: neither right nor wrong. It is detected if an
    asset of criticality 3 or more (its highest on a known day) that is active at times is silent on half of its known days and on three at least. precision is
    null where nothing is detected, recall where no planted entity is assessable.
    """
    known = F.col("activity").isNotNull()
    silent = F.count(F.when(F.col("activity") == 0, 1))
    per_asset = masked(daily, "activity", keys, levels).groupBy("level", "entity_id", "asset_id").agg(
        F.count(F.when(known, 1)).alias("days"), silent.alias("silent"), F.sum("activity").alias("total"), F.max(F.when(known, F.col("criticality"))).alias("criticality")
    )
    hit = (F.col("criticality") >= 3) & (F.col("silent") >= F.greatest(F.lit(3), F.floor(F.col("days") / 2))) & (F.col("total") > 0)
    rows = per_asset.groupBy("level", "entity_id").agg(F.sum("days").alias("days"), F.max(F.coalesce(hit, F.lit(False))).alias("found"))
    rows = rows.join(truth.select("entity_id").distinct().withColumn("planted", F.lit(True)), "entity_id", "left")
    seen, planted = F.col("days") >= least, F.coalesce("planted", F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    found = seen & F.col("found")
    out = rows.groupBy("level").agg(n(F.lit(True)).alias("n_entities"), n(~seen).alias("n_not_assessable"), n(found & planted).alias("tp"), n(found & ~planted).alias("fp"), n(seen & ~F.col("found") & planted).alias("fn"))
    return out.select(
        "*", (1 - F.col("n_not_assessable") / F.col("n_entities")).alias("assessable_rate"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall")
    )
