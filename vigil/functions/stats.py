"""Robust statistics against peers, as grouped aggregates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.policy import DEFAULT, Policy


def peer_baseline(values: DataFrame, policy: Policy = DEFAULT, by: list[str] | None = None) -> DataFrame:
    """(entity_id, cohort, value, n, sign), and columns by that keep measures apart -> leave-one-out peer statistics and
    effect size.

    Entities are never paired: leaving one out of a ranked cohort moves any rank by at most one, so the values at a few
    ranks give the peers' median and Tukey hinges, and sums less the entity's own give their mean and deviation.
    """
    by = ["cohort", *(by or [])]
    own = ["entity_id", *by[1:]]
    rows = values.filter("value is not null").withColumn("value", F.col("value").cast("double"))
    group = Window.partitionBy(*by)
    first = _without_own(rows, by, "value", {"median": _middle(F.col("_k") - 1), "_low": _hinge(0), "_high": _hinge(1)}, keep=True)
    first = first.withColumn("_m", F.avg("value").over(group)).withColumn("_d", F.col("value") - F.col("_m"))
    p, s1, s2 = F.col("_k") - 1, F.sum("_d").over(group) - F.col("_d"), F.sum(F.col("_d") * F.col("_d")).over(group) - F.col("_d") * F.col("_d")
    same = group.orderBy("value").rangeBetween(Window.currentRow, Window.currentRow)
    first = first.withColumns({
        "n_peers": F.when(p > 0, p), "mean": F.when(p > 0, F.col("_m") + s1 / p), "sd": F.when(p > 1, F.sqrt(F.greatest(F.lit(0.0), (s2 - s1 * s1 / p) / (p - 1)))),
        "below": F.min("_r").over(same) - 1 + (F.count("*").over(same) - 1) / 2,
    }).drop("_r", "_k", "_m", "_d")
    out = _spread(first, by).unionByName(values.filter("value is null"), allowMissingColumns=True)
    zero = lambda c: F.when(c > 0, c)
    scale = F.coalesce(zero(F.when(F.col("n_peers") >= policy.min_peers, 1.4826 * F.col("mad"))), zero((F.col("_high") - F.col("_low")) / 1.349), zero(F.col("sd")))
    shrunk = (F.col("n") * F.col("value") + policy.shrink_k * F.col("mean")) / (F.col("n") + policy.shrink_k)
    out = out.withColumns({"scale": scale, "shrunk": shrunk, "percentile": F.col("below") / F.col("n_peers") * 100, "thin": F.coalesce(F.col("n_peers"), F.lit(0)) < policy.min_peers})
    return out.withColumn("effect", F.round(F.col("sign") * (F.col("shrunk") - F.col("median")) / F.col("scale"), 6)).drop("_low", "_high")


def peer_deviations(values: DataFrame, by: list[str]) -> DataFrame:
    """(entity_id, value, columns by) -> each row with the median of its peers without itself and the median of their
    distances to it.

    No pairs: leaving one row out of a ranked group moves the middle by at most one rank, so the three values around
    the middle are enough. The peers' median takes at most three values in a group; distances are ranked for each.
    """
    rows = values.filter(F.col("value").isNotNull() & ~F.isnan("value")).dropna(subset=by)
    return _spread(_without_own(rows, by, "value", {"median": _middle(F.col("_k") - 1)}), by).filter("median is not null")


def _spread(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds mad, the median of the other rows' distances to the row's own median. Medians take at most three values in
    a group, so each row's distances are ranked for these; the grouping stays, so nothing is shuffled again."""
    centres = F.collect_set("median").over(Window.partitionBy(*by))
    each = rows.withColumn("_cs", centres).withColumn("_c", F.explode_outer("_cs")).drop("_cs").withColumn("_away", F.abs(F.col("value") - F.col("_c")))
    found = _without_own(each, [*by, "_c"], "_away", {"mad": _middle(F.col("_k") - 1)})
    return found.filter(F.col("_c").eqNullSafe(F.col("median"))).drop("_c", "_away")


def _middle(n) -> tuple:
    """The two ranks whose values give the median of n."""
    return F.floor((n + 1) / 2), F.floor(n / 2) + 1


def _hinge(upper: int) -> tuple:
    """The two ranks among k - 1 peers whose values give a Tukey hinge: the median of the lower or upper half."""
    p = F.col("_k") - 1
    half = F.floor(p / 2)
    return tuple(r + (p - half if upper else 0) for r in _middle(half))


def _without_own(rows: DataFrame, by: list[str], value: str, wanted: dict[str, tuple], keep: bool = False) -> DataFrame:
    """Adds means of two order statistics of the other rows' value in each group; null where there are none."""
    group = Window.partitionBy(*by)
    ranked = rows.withColumn("_r", F.row_number().over(group.orderBy(value, "entity_id"))).withColumn("_k", F.count("*").over(group))
    at = lambda k: F.max(F.when(F.col("_r") == k, F.col(value))).over(group)
    pick = lambda r: F.when(F.col("_r") <= r, at(r + 1)).otherwise(at(r))
    out = ranked.withColumns({name: F.when((F.col("_k") > 1) & (pair[0] > 0), (pick(pair[0]) + pick(pair[1])) / 2) for name, pair in wanted.items()})
    return out if keep else out.drop("_r", "_k")
