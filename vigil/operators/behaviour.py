"""Execution-gap indicators over event histories: process conformance, recurrence, throughput, timestamps, id gaps.

Each gives one row per entity with value and n, from grouped aggregates; where order within a key matters the rows go
through sequences, so that neither a hot case, rule, actor nor id range lands in one task. Times are whole seconds, and
rows without one are left out where order needs it. A null entity is an entity of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.functions import tails
from vigil.operators.sequences import Ordered, less_own, trailing

# The case states, and the states that may follow each.
STATE_MACHINE = {
    "NEW": ["OPEN", "CLOSED"],
    "OPEN": ["IN_PROGRESS", "ESCALATED", "CLOSED"],
    "IN_PROGRESS": ["ESCALATED", "RESOLVED", "CLOSED"],
    "ESCALATED": ["RESOLVED", "CLOSED"],
    "RESOLVED": ["CLOSED", "REOPENED"],
    "CLOSED": ["REOPENED"],
    "REOPENED": ["IN_PROGRESS"],
}
START = "START"


@dataclass(frozen=True)
class Limits:
    #: EG-13: a step belongs to the peers' consensus if they take it so often from its state.
    consensus: float = 0.05
    #: EG-05: so many alerts of a signature within so many days.
    repeats: int = 5
    repeat_days: int = 14
    #: EG-12: closures of one person within an hour.
    closures_per_hour: int = 6
    #: EG-04: a note up to so long before a change documents it.
    note_s: int = 86_400
    #: EG-07, EG-16: chance below which a value is called out.
    chance: float = 0.01
    #: EG-16: below this expected count of a cell, the largest cell is tested exactly instead of by chi-squared.
    least_expected: float = 5.0
    #: EG-16: so many records of one entity with the very same second are a batch.
    batch: int = 5
    #: EG-15: minutes of a bin, of the window to each side of a boundary and of the surroundings to each side; degree.
    bin_min: int = 15
    window_min: int = 30
    around_min: int = 240
    degree: int = 2


def steps(events: DataFrame) -> DataFrame:
    """(entity_id, case_id, event_no, ts, state) -> each stated event with the state before it in its case, START in the
    first. Events without a state do not move the case; equal times are ordered by event_no."""
    stated = events.filter("state is not null and ts is not null")
    rows = Ordered(stated, ["entity_id", "case_id"], ["ts", "event_no"]).previous(before="state")
    return rows.withColumn("before", F.coalesce("before", F.lit(START)))


def conformance(events: DataFrame, cohorts: DataFrame, machine: dict[str, list[str]] | None = None, limits: Limits = Limits()) -> DataFrame:
    """EG-13. value: share of an entity's cases with a step that the declared automaton does not know (staying in a state
    is no step; cases begin in NEW); off_path: share of steps outside the consensus of the cohort's other entities, null
    where these never leave the step's state; n_unstated: events without a state.

    cohorts: (entity_id, cohort). The consensus comes from counts by state pair, less the entity's own.
    """
    pairs = [(START, "NEW"), *((a, b) for a, after in (machine or STATE_MACHINE).items() for b in after)]
    known = F.array(*(F.lit(f"{a}>{b}") for a, b in pairs))
    moved = steps(events).filter("before <> state")
    wrong = (~F.array_contains(known, F.concat_ws(">", "before", "state"))).cast("int")
    by_case = moved.groupBy("entity_id", "case_id").agg(F.count("*").alias("k"), F.sum(wrong).alias("wrong"))
    cases = by_case.groupBy("entity_id").agg(
        F.avg((F.col("wrong") > 0).cast("int")).alias("value"), F.count("*").alias("n"), F.sum("k").alias("n_steps"), F.sum("wrong").alias("n_wrong")
    )
    own = moved.groupBy("entity_id", "before", "state").agg(F.count("*").alias("own")).join(cohorts.select("entity_id", "cohort"), "entity_id")
    own = own.withColumn("own_from", F.sum("own").over(W.partitionBy("entity_id", "before")))  # a row for each state
    step = own.groupBy("cohort", "before", "state").agg(F.sum("own").alias("all"))
    step = step.withColumn("all_from", F.sum("all").over(W.partitionBy("cohort", "before")))  # a row for each state
    others, others_from = F.col("all") - F.col("own"), F.col("all_from") - F.col("own_from")
    off = F.when(others_from > 0, (others < limits.consensus * others_from).cast("int"))
    paths = own.join(step, ["cohort", "before", "state"]).groupBy("entity_id").agg((F.sum(off * F.col("own")) / F.sum(F.when(off.isNotNull(), F.col("own")))).alias("off_path"))
    unstated = events.groupBy("entity_id").agg(F.count(F.when(F.col("state").isNull(), 1)).alias("n_unstated"))
    return cases.join(paths, "entity_id", "left").join(unstated, "entity_id", "left")


def recurrence(alerts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """EG-05. (entity_id, rule, asset, ts, remedied): value is the share of an entity's signatures (rule and asset) that at
    some time had so many alerts within the days before, none of them remedied; n_bursts counts the times at which it was so."""
    rows = alerts.select("entity_id", "rule", "asset", "ts", F.lit(1).alias("one"), F.coalesce(F.col("remedied").cast("int"), F.lit(0)).alias("cause"))
    keys = ["entity_id", "rule", "asset"]
    inside = trailing(rows, keys, "ts", limits.repeat_days * 86_400, repeats="one", remedies="cause")
    burst = ((F.col("repeats") >= limits.repeats) & (F.col("remedies") == 0)).cast("int")
    by_signature = inside.groupBy(*keys).agg(F.sum(burst).alias("bursts"), F.max("repeats").alias("most"))
    return by_signature.groupBy("entity_id").agg(
        F.avg((F.col("bursts") > 0).cast("int")).alias("value"), F.count("*").alias("n"), F.sum("bursts").alias("n_bursts"), F.max("most").alias("most")
    )


def throughput(closures: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """EG-12. (entity_id, actor, actor_type, ts): value is the share of an entity's people with more closures than the limit
    within some hour (any 3,600 seconds on end); most is the densest. Automation and unknown actors are left out."""
    rows = closures.filter((F.col("actor_type") == "human") & F.col("actor").isNotNull()).select("entity_id", "actor", "ts", F.lit(1).alias("one"))
    dense = trailing(rows, ["entity_id", "actor"], "ts", 3599, closed="one").groupBy("entity_id", "actor").agg(F.max("closed").alias("most"))
    over = (F.col("most") > limits.closures_per_hour).cast("int")
    return dense.groupBy("entity_id").agg(F.avg(over).alias("value"), F.count("*").alias("n"), F.max("most").alias("most"))


def undocumented_changes(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """EG-04. (entity_id, case_id, event_no, ts, event_type, from_rank, to_rank): value is the share of an entity's severity
    downgrades (to_rank below from_rank) without a note of the same case in the time before; a note at the same second
    counts. With n, and n_bare, the downgrades that no earlier note of the case precedes at all."""
    note, change = F.col("event_type") == "note_added", F.col("event_type") == "severity_changed"
    rows = events.filter((note | (change & (F.col("to_rank") < F.col("from_rank")))) & F.col("ts").isNotNull())
    rows = rows.select("entity_id", "case_id", "event_no", "ts", F.when(note, 0).otherwise(1).alias("kind"), F.when(note, F.col("ts")).alias("note_ts"))
    known = Ordered(rows, ["entity_id", "case_id"], ["ts", "kind", "event_no"]).running(noted=("note_ts", "max"))
    bare = F.col("noted").isNull()
    return known.filter("kind = 1").groupBy("entity_id").agg(
        F.avg((bare | (F.col("ts") - F.col("noted") > limits.note_s)).cast("int")).alias("value"), F.count("*").alias("n"), F.sum(bare.cast("int")).alias("n_bare")
    )


def escalation_limits(counts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """EG-07. (entity_id, cohort, n, escalated) -> rate, the peers' mean rate and spread, and the chance of so few
    escalations or fewer: a funnel whose limits widen for small entities.

    The chance of an escalation has a beta law among peers; its mean and variance come from the peers' sums (the cohort's
    less the entity's own), with the binomial part of the variance taken out. Where nothing is left, or too few peers
    are, the law is binomial. value is the share that is missing from the peers' rate, for entities beyond the limit.
    """
    n, x = F.col("n").cast("double"), F.col("escalated").cast("double")
    rows = less_own(counts.filter("n > 0"), ["cohort"], _n=n, _x=x, _nn=n * n, _k=F.lit(1.0), _xx=x * x / n)
    mean = F.col("_x") / F.col("_n")
    # sum n (p_i - mean)^2 of the peers, against what binomial draws alone would give
    between = F.col("_xx") - F.col("_n") * F.col("mean") * F.col("mean")
    scale = F.col("_n") - F.col("_nn") / F.col("_n") - (F.col("_k") - 1)
    spread = F.try_divide(between - (F.col("_k") - 1) * F.col("mean") * (1 - F.col("mean")), scale)
    rows = rows.filter("_n > 0").withColumn("mean", mean)
    rows = rows.withColumn("spread", F.when((F.col("_k") >= 2) & (spread > 0) & (spread < F.col("mean") * (1 - F.col("mean"))), spread))
    size = F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1
    rows = rows.withColumns({"_a": F.col("mean") * size, "_b": (1 - F.col("mean")) * size, "_no": F.col("n") - F.col("escalated"), "_q": 1 - F.col("mean")})
    rows = rows.withColumn("chance", F.coalesce(tails.beta_binomial_lower_of("escalated", "n", "_a", "_b"), tails.binomial_upper_of("_no", "n", "_q")))
    short = F.when(F.col("chance") <= limits.chance, 1 - F.try_divide(F.col("escalated") / F.col("n"), F.col("mean"))).otherwise(0.0)
    return rows.select("entity_id", "cohort", short.alias("value"), "n", (F.col("escalated") / F.col("n")).alias("rate"), "mean", "spread", "chance")


def boundary_weights(limits: Limits = Limits()) -> tuple[list[int], list[float]]:
    """Bins around a boundary, and the weight of each bin's count in the count to be expected inside the window: the
    polynomial of least squares through the bins outside, summed over those inside. The bins are the same for all, so the fit is
    one weighted sum."""
    edge, inner = limits.around_min // limits.bin_min, limits.window_min // limits.bin_min
    bins = np.arange(-edge, edge)
    middle = (bins + 0.5) / edge
    design = np.vander(middle, limits.degree + 1, increasing=True)
    inside = (bins >= -inner) & (bins < inner)
    weights = np.zeros(len(bins))
    weights[~inside] = (np.linalg.pinv(design[~inside]).T @ design[inside].T).sum(axis=1)
    return bins.tolist(), [round(float(w), 12) for w in weights]


def boundary_bunching(events: DataFrame, boundaries: list[int], limits: Limits = Limits()) -> DataFrame:
    """EG-15. (entity_id, ts) and the minutes of the day at which shifts change: value is the excess of events near a
    boundary over what the times around it, without the window itself, lead to expect; as a share of that (null where
    nothing is expected). With n events around, inside, expected and excess in units of its Poisson deviation."""
    minute = F.floor(F.pmod(F.col("ts"), F.lit(86_400)) / 60)
    near = F.array(*(F.pmod(minute - b + 720, F.lit(1440)) - 720 for b in boundaries))  # minutes to each boundary, -720..719
    away = F.array_min(F.transform(near, lambda d: F.struct(F.abs(d + 0.5).alias("far"), d.alias("d"))))["d"]
    bin_ = F.floor(away / limits.bin_min)
    bins, weights = boundary_weights(limits)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("bin") - bins[0] + 1).cast("int"))
    inside = F.abs(F.col("bin") + 0.5) < limits.window_min / limits.bin_min
    counts = events.filter("ts is not null").withColumn("bin", bin_).filter((F.col("bin") >= bins[0]) & (F.col("bin") <= bins[-1])).groupBy("entity_id", "bin").agg(F.count("*").alias("k"))
    sums = counts.groupBy("entity_id").agg(
        F.sum("k").alias("n"), F.coalesce(F.sum(F.when(inside, F.col("k"))), F.lit(0)).alias("inside"), F.greatest(F.sum(F.col("k") * weight), F.lit(0.0)).alias("expected")
    )
    over = F.col("inside") - F.col("expected")
    some = F.col("expected") > 0
    return sums.select("entity_id", F.when(some, over / F.col("expected")).alias("value"), "n", "inside", "expected", F.when(some, over / F.sqrt("expected")).alias("z"))


def timestamp_forensics(records: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """EG-16. (entity_id, created_s, closed_s): how the seconds and minutes of closures stand against a uniform spread, closures
    before their creation, and records stamped in batches.

    seconds_chi2 and minutes_chi2 are over 60 cells; the chance is that of chi-squared by the cube root of Wilson and
    Hilferty, or, where a cell expects fewer than five, 60 times the exact binomial chance of the fullest cell. value is the
    largest of: 1 where a chance is below the limit, the share of impossible orders, the share stamped in batches.
    """
    closed = records.filter("closed_s is not null")
    cells = closed.groupBy("entity_id", F.pmod("closed_s", F.lit(60)).alias("second"), F.pmod(F.floor(F.col("closed_s") / 60), F.lit(60)).alias("minute")).agg(F.count("*").alias("k"))

    def fit(unit: str) -> DataFrame:
        own = cells.groupBy("entity_id", unit).agg(F.sum("k").alias("k")).groupBy("entity_id").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.max("k").alias("most"))
        chi2 = F.col("kk") * 60 / F.col("n") - F.col("n")
        z = (F.pow(chi2 / 59, F.lit(1 / 3)) - (1 - 2 / (9 * 59))) / float(np.sqrt(2 / (9 * 59)))
        return own.select("entity_id", "n", chi2.alias(f"{unit}s_chi2"), "most", z.alias("_z"), F.lit(1 / 60).alias("_p"))

    def chance(own: DataFrame, unit: str) -> DataFrame:
        exact = F.least(F.lit(1.0), 60 * tails.binomial_upper_of("most", "n", "_p"))
        # logistic form of the normal tail, within 1.5e-4 of it
        smooth = 1 / (1 + F.exp(0.07056 * F.pow("_z", F.lit(3)) + 1.5976 * F.col("_z")))
        few = F.col("n") / 60 < limits.least_expected
        return own.select("entity_id", "n", f"{unit}s_chi2", F.when(few, exact).otherwise(smooth).alias(f"{unit}s_chance"))

    out = chance(fit("second"), "second").join(chance(fit("minute"), "minute").drop("n"), "entity_id")
    stamps = closed.groupBy("entity_id", "closed_s").agg(F.count("*").alias("k"), F.count(F.when(F.col("closed_s") < F.col("created_s"), 1)).alias("early"))
    orders = stamps.groupBy("entity_id").agg(F.sum("early").alias("n_impossible"), F.coalesce(F.sum(F.when(F.col("k") >= limits.batch, F.col("k"))), F.lit(0)).alias("n_batched"))
    out = out.join(orders, "entity_id")
    odd = ((F.col("seconds_chance") < limits.chance) | (F.col("minutes_chance") < limits.chance)).cast("double")
    return out.withColumn("value", F.greatest(odd, F.col("n_impossible") / F.col("n"), F.col("n_batched") / F.col("n")))


def id_gaps(ids: DataFrame) -> DataFrame:
    """EG-17. (entity_id, id) -> the runs of whole numbers that are missing between an entity's ids: from_id, to_id, n_missing.
    Repeated ids count once; what lies outside the smallest and largest id is not known to be missing."""
    once = ids.filter("id is not null").select("entity_id", "id").distinct()
    rows = Ordered(once, ["entity_id"], ["id"]).previous(before="id").filter(F.col("id") - F.col("before") > 1)
    return rows.select("entity_id", (F.col("before") + 1).alias("from_id"), (F.col("id") - 1).alias("to_id"), (F.col("id") - F.col("before") - 1).alias("n_missing"))


def id_completeness(first: DataFrame, second: DataFrame) -> DataFrame:
    """EG-17 as an indicator: value is the share of an entity's id range in its second submission that is missing; with
    n_runs, n_missing and n_deleted, ids of the first submission that the second no longer has (null: not in both)."""
    span = second.filter("id is not null").groupBy("entity_id").agg((F.max("id") - F.min("id") + 1).alias("n"))
    gaps = id_gaps(second).groupBy("entity_id").agg(F.count("*").alias("n_runs"), F.sum("n_missing").alias("n_missing"))
    had, has = (d.filter("id is not null").select("entity_id", "id").distinct() for d in (first, second))
    gone = had.groupBy("entity_id").agg(F.count("*").alias("_had")).join(had.join(has, ["entity_id", "id"], "left_anti").groupBy("entity_id").agg(F.count("*").alias("n_deleted")), "entity_id", "left")
    out = span.join(gaps, "entity_id", "left").join(gone, "entity_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("entity_id", (zero("n_missing") / F.col("n")).alias("value"), "n", zero("n_runs").alias("n_runs"), zero("n_missing").alias("n_missing"), F.when(F.col("_had").isNotNull(), zero("n_deleted")).alias("n_deleted"))


