"""Reproducible audit samples: probability proportional to risk, stratified controls, and their estimate."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.sequences import Ordered


def uniform(seed: str, *key: str):
    """A number in [0, 1) that depends on seed and key only, not on partitioning."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), *key), 256), 1, 12), 16, 10).cast("double") / float(16**12)


def seeded_start(seed: str) -> float:
    """Where in the first step a systematic sample begins: the number that uniform(seed) gives."""
    return int(hashlib.sha256(seed.encode()).hexdigest()[:12], 16) / 16**12


def proportional(cases: DataFrame, n: int, seed: str = "sample") -> DataFrame:
    """Ordered systematic sample with probability proportional to risk, begun at random by the seed; cases without risk are
    never drawn. The cumulative risk is a running sum over range partitions, so neither the whole nor cases of one risk
    stand in one task; risk is an integer, so sums do not depend on their order."""
    rows = cases.filter("risk > 0")
    whole = rows.agg(F.sum("risk").alias("whole"))
    placed = Ordered(rows, [], [F.desc("risk"), "entity_id", "case_id"]).running(high=("risk", "sum"))
    placed = placed.crossJoin(F.broadcast(whole)).withColumn("low", F.col("high") - F.col("risk"))  # one row
    step, start = F.col("whole") / n, seeded_start(seed)
    hits = F.ceil((F.col("high") - start * step) / step) - F.ceil((F.col("low") - start * step) / step)
    return placed.filter(hits > 0).select("entity_id", "case_id", "analyst", "risk", F.least(F.lit(1.0), n * F.col("risk") / F.col("whole")).alias("pi"))


def capped(sample: DataFrame, most: int) -> DataFrame:
    """At most so many cases of each analyst, those of highest risk; unknown analysts are not capped."""
    w = Window.partitionBy("analyst").orderBy(F.desc("risk"), "entity_id", "case_id")
    return sample.withColumn("_r", F.row_number().over(w)).filter(F.col("analyst").isNull() | (F.col("_r") <= most)).drop("_r")


def allocation(strata: DataFrame, n: int) -> DataFrame:
    """Largest remainders: (stratum, size) -> how many of n each stratum gets, at most its size."""
    whole = F.sum("size").over(Window.partitionBy(F.lit(0)))
    rows = strata.withColumn("exact", F.lit(n) * F.col("size") / whole).withColumn("base", F.floor("exact"))
    rest = F.lit(n) - F.sum("base").over(Window.partitionBy(F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), "size", F.desc("stratum")))
    return rows.withColumn("take", F.least("size", F.col("base") + (rank <= rest).cast("long"))).select("stratum", "size", "take")


def controls(frame: DataFrame, take: DataFrame, seed: str) -> DataFrame:
    """Simple random samples within strata, by hash order; pi = n / N. Places are numbered over range partitions, so a stratum
    with most of the cases is no single task."""
    ticket = F.sha2(F.concat_ws("|", F.lit(seed), "entity_id", "case_id"), 256)
    rows = frame.join(F.broadcast(take.withColumnRenamed("size", "n_stratum")), "stratum").withColumn("_t", ticket)
    rows = Ordered(rows, ["stratum"], ["_t", "case_id"]).numbered("_r").filter("_r <= take").drop("_t")
    return rows.withColumn("pi", F.col("take") / F.col("n_stratum")).drop("_r")


def complement(population: DataFrame, targeted: DataFrame, strata: list[str]) -> DataFrame:
    """The control frame: cases that are not targeted, by severity; other and unknown severities form one stratum more."""
    rest = population.join(targeted.select("entity_id", "case_id").distinct(), ["entity_id", "case_id"], "left_anti")
    return rest.withColumn("stratum", F.when(F.col("severity").isin(strata), F.col("severity")).otherwise("UNKNOWN"))


def estimate(targeted: DataFrame, chosen: DataFrame, population: DataFrame) -> DataFrame:
    """Horvitz-Thompson prevalence of y over targeted cases (pi, y) and controls (stratum, take, n_stratum, pi, y).

    The variance of targeted cases is that of independent draws; each stratum has that of simple random sampling,
    or of independent draws if it gave one case. The 95 percent interval and the estimate stay within 0 and 1.
    """
    apart = (1 - F.col("pi")) / (F.col("pi") * F.col("pi")) * F.col("y")
    drawn = targeted.agg(F.sum(F.col("y") / F.col("pi")).alias("total"), F.sum(apart).alias("variance"), F.count("*").alias("k"))
    n, big = F.first("take"), F.first("n_stratum")
    simple = F.when(n == 1, F.sum(apart)).otherwise(big * big * (1 - n / big) * F.var_samp("y") / n)
    by_stratum = chosen.groupBy("stratum").agg(F.sum(F.col("y") / F.col("pi")).alias("total"), simple.alias("variance"), F.count("*").alias("k")).drop("stratum")
    both = drawn.unionByName(by_stratum).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "variance", "k")))
    rows = both.crossJoin(F.broadcast(population.agg(F.count("*").alias("n_population"))))  # one row each
    inside = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("total") / F.col("n_population")))
    half = 1.959964 * F.sqrt("variance") / F.col("n_population")
    return rows.filter("k > 0").select(F.col("k").alias("n_sampled"), "n_population", inside(p).alias("prevalence"), inside(p - half).alias("low"), inside(p + half).alias("high"))
