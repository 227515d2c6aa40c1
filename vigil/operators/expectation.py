"""What to expect of an entity: a covariate model of its peers, and negative-binomial laws for silence.

Both work on sufficient statistics: sums by cohort or asset class, from which an entity's own part is taken away. No rows
reach the driver, and no entity is paired with another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.functions import tails
from vigil.operators.sequences import Ordered, less_own


def covariate_model(values: DataFrame, covariates: list[str], by: list[str] | None = None, least: int = 3) -> DataFrame:
    """(entity_id, columns by, value, covariates) -> expected and residual of each value by least squares on the covariates,
    fitted to the group's other rows.

    X'X and X'y are summed by group, around the group's means for accuracy, and each row's own products subtracted, which
    equals refitting without it. expected is null where a value or covariate is missing, where fewer than least peers more
    than covariates are left, or where the peers' covariates do not tell apart (singular).
    """
    by = by or []
    width = len(covariates) + 1
    names = [f"_x{i}" for i in range(1, width)]
    double = [F.col(c).cast("double").alias(n) for c, n in zip([*covariates, "value"], [*names, "_y"])]
    usable = F.lit(True)
    for n in [*names, "_y"]:
        usable = usable & F.col(n).isNotNull() & ~F.isnan(n)
    rows = values.select("*", *double)
    group = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"_g{i}") for i, c in enumerate(by)] or [F.lit(0).alias("_g0")]
    keys = [f"_g{i}" for i in range(len(group))]
    rows = rows.select("*", *group).withColumn("_in", usable)
    fitted = rows.filter("_in")
    means = fitted.groupBy(*keys).agg(*(F.avg(n).alias(f"_m{n}") for n in [*names, "_y"]))
    x = [F.lit(1.0), *(F.col(n) - F.col(f"_m{n}") for n in names)]
    y = F.col("_y") - F.col("_m_y")
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    sums = fitted.join(means, keys).groupBy(*keys).agg(
        F.array(*(F.sum(x[i] * x[j]) for i, j in pairs)).alias("_xx"), F.array(*(F.sum(x[i] * y) for i in range(width))).alias("_xy")
    )
    full = rows.join(means, keys, "left").join(sums, keys, "left")
    full = full.withColumns({"_row": F.array(*x), "_own": y}).withColumns({"expected": F.lit(None).cast("double"), "n_peers": F.lit(None).cast("long")})
    columns = [*values.columns, "expected", "n_peers"]
    schema = full.select(*columns).schema

    def solve(batches):
        for batch in batches:
            inside = np.asarray(batch.column("_in").to_numpy(zero_copy_only=False), bool)
            at = np.flatnonzero(inside)
            expected, peers = np.full(len(inside), np.nan), np.zeros(len(inside), np.int64)
            if len(at):
                part = batch.take(pa.array(at))
                flat = lambda c: np.asarray(part.column(c).flatten(), float).reshape(len(at), -1)  # noqa: B023, E731
                own, z, xy, packed = flat("_row"), np.asarray(part.column("_own"), float), flat("_xy"), flat("_xx")
                xx = np.zeros((len(at), width, width))
                for k, (i, j) in enumerate(pairs):
                    xx[:, i, j] = xx[:, j, i] = packed[:, k]
                rest = xx - own[:, :, None] * own[:, None, :]
                left = xy - own * z[:, None]
                n = np.rint(rest[:, 0, 0]).astype(np.int64)
                scale = np.sqrt(np.maximum(np.einsum("nii->ni", rest), 1e-300))
                even = rest / scale[:, :, None] / scale[:, None, :]
                fine = (n >= width + least) & (np.einsum("nii->ni", rest) > 1e-9 * np.maximum(np.einsum("nii->ni", xx), 1e-300)).all(axis=1)
                fine[fine] = np.linalg.cond(even[fine]) < 1e10
                beta = np.linalg.solve(even[fine], (left / scale)[fine][:, :, None])[:, :, 0] / scale[fine]
                expected[at[fine]] = (own[fine] * beta).sum(axis=1) + np.asarray(part.column("_m_y"), float)[fine]
                peers[at] = n
            made = {"expected": pa.array(expected, pa.float64(), from_pandas=True), "n_peers": pa.array(peers, mask=~inside)}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in columns], columns)

    return full.mapInArrow(solve, schema).withColumn("residual", F.col("value") - F.col("expected"))


def rate_laws(totals: DataFrame, klass: str = "asset_class") -> DataFrame:
    """(entity_id, asset_id, klass, days, total): adds the mean rate a day of the class's other assets, and the size of its
    gamma law (mean squared by variance) by moments: what the totals vary more than Poisson counts would. Null size: they
    do not. Classes with fewer than two other assets have no rate."""
    t, d, m = F.col("total").cast("double"), F.col("days").cast("double"), F.col("rate")
    rows = less_own(totals, [klass], _k=F.lit(1.0), _t=t, _d=d, _tt=t * t, _td=t * d, _dd=d * d)
    rows = rows.withColumn("rate", F.when(F.col("_k") >= 2, F.try_divide("_t", "_d")))
    # sum (total - rate * days)^2 has the mean rate * days + variance * days^2 for each asset
    variance = F.try_divide(F.col("_tt") - 2 * m * F.col("_td") + m * m * F.col("_dd") - m * F.col("_d"), F.col("_dd"))
    rows = rows.withColumn("_v", variance).withColumn("size", F.when(F.col("_v") > 0, m * m / F.col("_v")))
    return rows.drop("_k", "_t", "_d", "_tt", "_td", "_dd", "_v")


def silent_assets(daily: DataFrame, klass: str = "asset_class", q: float = 0.05) -> DataFrame:
    """NS-01 by expectation. (entity_id, asset_id, klass, criticality, day, activity), one row a day from the asset's first to its last due
    day -> for each asset: days, total, silent_since (first day of its last run of zeros, null if it is active), run (that
    run's days), chance and raised.

    An asset's rate has the gamma law of its class (other assets' moments), made sharper by what it did before the run;
    the chance of a run of zeros is then a negative-binomial zero: ((b + before) / (b + before + run)) ^ (k + total), so an
    asset that was quiet all along is not called out. The chance is multiplied by the criticality's weight (5 - criticality, at
    least 1) and held against Benjamini-Hochberg's limits within the entity, in place of p alone.
    """
    last = F.max(F.when(F.col("activity") > 0, F.col("day")))
    keys = ["entity_id", "asset_id", klass]
    per = daily.groupBy(*keys).agg(F.max("criticality").alias("criticality"), F.count("*").alias("days"), F.sum("activity").alias("total"), F.min("day").alias("_first"), F.max("day").alias("_end"), last.alias("_last"))
    since = F.when(F.col("_last").isNull(), F.col("_first")).when(F.col("_last") < F.col("_end"), F.date_add("_last", 1))
    per = per.withColumn("silent_since", since).withColumn("run", F.coalesce(F.datediff("_end", "silent_since") + 1, F.lit(0)))
    rows = rate_laws(per.drop("_first", "_end", "_last"), klass)
    before = F.col("days") - F.col("run")
    b = F.try_divide("size", "rate")
    gamma = F.pow((b + before) / (b + before + F.col("run")), F.col("size") + F.col("total"))
    poisson = F.exp(-F.col("rate") * F.col("run"))
    chance = F.when(F.col("run") > 0, F.when(F.col("rate") > 0, F.coalesce(gamma, poisson)))
    rows = rows.withColumn("chance", chance).withColumn("weighted", F.least(F.lit(1.0), F.col("chance") * F.greatest(5 - F.col("criticality"), F.lit(1))))
    return surviving(rows, ["entity_id"], "weighted", ["asset_id"], q).withColumn("raised", F.col("survives")).drop("survives")


def surviving(rows: DataFrame, keys: list[str], p: str, tie: list[str], q: float) -> DataFrame:
    """Adds whether p survives Benjamini-Hochberg at q among the rows of its keys that have one: ranks do not gather a hot
    key in one task, and the limit is the largest p that is at most its share of q."""
    tested = Ordered(rows.filter(F.col(p).isNotNull()), keys, [p, *tie]).numbered("_i")
    sizes = tested.groupBy(*keys).agg(F.count("*").alias("_m"))
    limit = tested.join(sizes, keys).filter(F.col(p) <= q * F.col("_i") / F.col("_m")).groupBy(*keys).agg(F.max(p).alias("_limit"))
    return rows.join(limit, keys, "left").withColumn("survives", F.coalesce(F.col(p) <= F.col("_limit"), F.lit(False))).drop("_limit")


def silent_categories(counts: DataFrame, chance: float = 0.05, months: int = 2) -> DataFrame:
    """NS-02 by expectation. (entity_id, cohort, category, period, activity) with zeros -> for each entity and category: how many of the
    latest periods in a row are improbably low, and whether that makes months or more (raised).

    The expected count is the entity's activity in the period times the peers' share of the category; peers' excess of
    variance over Poisson, by moments around their own expectations, gives the size of the negative-binomial law. The
    chance is that of so few or fewer.
    """
    rows = counts.withColumn("_all", F.sum("activity").over(W.partitionBy("entity_id", "period")))  # a row for each category
    x, e = F.col("activity").cast("double"), F.col("_all").cast("double")
    rows = less_own(rows, ["cohort", "category", "period"], _x=x, _e=e, _xx=x * x, _xe=x * e, _ee=e * e)
    share = F.when(F.col("_e") > 0, F.col("_x") / F.col("_e"))
    rows = rows.withColumn("_s", share).withColumn("expected", F.col("_s") * F.col("_all"))
    s = F.col("_s")
    variance = F.try_divide(F.col("_xx") - 2 * s * F.col("_xe") + s * s * F.col("_ee") - s * F.col("_e"), s * s * F.col("_ee"))
    rows = rows.withColumn("_v", variance).withColumn("size", F.when(F.col("_v") > 0, 1 / F.col("_v")).otherwise(F.lit(float("inf"))))
    rows = rows.withColumn("chance", F.when(F.col("expected") > 0, tails.negative_binomial_lower_of("activity", "expected", "size")))
    low = F.coalesce(F.col("chance") <= chance, F.lit(False))
    after = F.max(F.when(~low, F.col("period"))).over(W.partitionBy("entity_id", "category"))
    late = rows.withColumn("_low", low).withColumn("_after", after)
    out = late.groupBy("entity_id", "cohort", "category").agg(
        F.count("*").alias("n"), F.sum(F.col("_low").cast("int")).alias("n_low"), F.count(F.when(F.col("_after").isNull() | (F.col("period") > F.col("_after")), 1)).alias("run"),
        F.max_by("chance", "period").alias("latest_chance"), F.max_by("expected", "period").alias("latest_expected"),
    )
    return out.withColumn("raised", F.col("run") >= months)
