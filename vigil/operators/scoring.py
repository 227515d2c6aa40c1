"""From indicator values to signals, families, dimensions and ranked entities."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.policy import DEFAULT, Policy


def ramp(effect, policy: Policy = DEFAULT):
    """Adverse effect between z0 and z1 as 0 to 1; favourable effects give 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (effect - policy.ramp_z0) / (policy.ramp_z1 - policy.ramp_z0)))


def false_discovery(rows: DataFrame, most: int = 32, policy: Policy = DEFAULT) -> DataFrame:
    """Benjamini-Hochberg per entity without p values: the i-th largest |z| of n is compared with the normal
    quantile of 1 - q i / 2n. n is at most the number of indicators, so the quantiles are a small literal table."""
    q = policy.fdr_q
    quantile = F.create_map(*(x for n in range(1, most + 1) for i in range(1, n + 1) for x in (F.lit(n * 100 + i), F.lit(NormalDist().inv_cdf(1 - q * i / (2 * n))))))
    w = Window.partitionBy("entity_id")
    ranked = rows.withColumn("i", F.row_number().over(w.orderBy(F.abs("effect").desc(), "indicator"))).withColumn("n_tests", F.count("*").over(w))
    ranked = ranked.withColumn("limit", F.when(F.abs("effect") >= quantile[F.col("n_tests") * 100 + F.col("i")], F.col("i")))
    return ranked.withColumn("survives", F.coalesce(F.col("i") <= F.max("limit").over(w), F.lit(False))).drop("limit")


def entity_scores(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """(entity_id, indicator, family, effect, confidence, survives) -> capped noisy-or per entity, rank and tier."""
    signal = F.when(F.col("survives"), ramp(F.col("effect"), policy) * F.col("confidence")).otherwise(0.0)
    family = rows.groupBy("entity_id", "family").agg(F.max(signal).alias("score"))
    # a product over few families: sum of logarithms, each factor at least 1 - cap
    index = family.groupBy("entity_id").agg(F.round(1 - F.exp(F.sum(F.log(1 - 0.5 * F.least("score", F.lit(policy.family_cap))))), 4).alias("index"), F.count("*").alias("n_families"))
    w = Window.orderBy(F.desc("index"))
    high, mid, low = policy.tiers
    tier = F.when(F.col("index") >= high, "T1").when(F.col("index") >= mid, "T2").when(F.col("index") >= low, "T3").otherwise("T4")
    counts = index.groupBy("index").agg(F.count("*").alias("k"))  # ranks over distinct scores: at most 10,001 rows
    place = counts.withColumn("rank", (F.coalesce(F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).cast("long")).drop("k")
    return index.join(place, "index").withColumn("tier", tier)
