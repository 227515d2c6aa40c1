"""Execution-gap and negative-space indicators: each is one grouped aggregate for all entities."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.policy import DEFAULT, Policy

SEVERE = ("HIGH", "CRITICAL")


def duration() -> Column:
    """Declared duration if it is not negative, else the difference of times if that is not; else null."""
    between = F.col("closed_s") - F.col("created_s")
    return F.coalesce(F.when(F.col("declared_s") >= 0, F.col("declared_s")), F.when(between >= 0, between))


def in_period(cases: DataFrame, start: str, end: str) -> DataFrame:
    """Half-open period: from start up to the day after end."""
    first, last = F.unix_timestamp(F.lit(f"{start} 00:00:00")), F.unix_timestamp(F.lit(f"{end} 00:00:00")) + 86400
    return cases.filter((F.col("created_s") >= first) & (F.col("created_s") < last))


def _measured(rows: DataFrame, value: Column, *more: Column) -> DataFrame:
    return rows.groupBy("entity_id").agg(value.alias("value"), F.count("*").alias("n"), *more)


def eg01(cases: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Median closure seconds of severe closed cases; low is adverse. n_evidence, here and below: the rows behind the value."""
    rows = cases.filter(F.col("severity").isin(*SEVERE) & F.col("closed_s").isNotNull()).withColumn("d", duration()).filter("d is not null")
    return _measured(rows, F.expr("median(d)"), F.count(F.when(F.col("d") < policy.rapid_closure_s, 1)).alias("n_rapid"), F.count("*").alias("n_evidence"))


def eg02(cases: DataFrame, notes: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Share of dismissed severe cases whose note is thin or absent."""
    rows = cases.filter(F.col("severity").isin(*SEVERE) & F.col("disposition").isin("FALSE_POSITIVE", "SUPPRESSED")).join(notes, "note_ref", "left")
    thin = F.coalesce(F.col("note_chars"), F.lit(0)) < policy.thin_note_chars
    return _measured(rows, F.avg(thin.cast("int")), F.count(F.when(thin, 1)).alias("n_thin"), F.count(F.when(thin, 1)).alias("n_evidence"))


def eg06(cases: DataFrame, escalations: DataFrame) -> DataFrame:
    """Share of closed critical cases with neither an escalation nor a level."""
    rows = cases.filter((F.col("severity") == "CRITICAL") & F.col("closed_s").isNotNull()).join(escalations.select("entity_id", "case_id").distinct().withColumn("hit", F.lit(True)), ["entity_id", "case_id"], "left")
    silent = F.col("hit").isNull() & F.col("escalation_level").isNull()
    return _measured(rows, F.avg(silent.cast("int")), F.count(F.when(silent, 1)).alias("n_evidence"))


def eg08(cases: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Share of closures just within the agreed time of their severity."""
    sla = F.create_map(*(F.lit(x) for kv in policy.sla_s.items() for x in kv))[F.col("severity")]
    rows = cases.filter("closed_s is not null").withColumn("d", duration()).filter("d is not null")
    within = F.col("d").between(policy.sla_band * sla, sla)
    return _measured(rows, F.avg(within.cast("int")), F.count(F.when(within, 1)).alias("n_evidence"))


def eg09(cases: DataFrame, boundaries: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Share of closures in the last hours before the entity's reporting boundary, over that window's share of the period."""
    rows = cases.filter("closed_s is not null").join(boundaries, "entity_id")
    hours = policy.boundary_hours * 3600
    near = (F.col("closed_s") > F.col("boundary_s") - hours) & (F.col("closed_s") <= F.col("boundary_s"))
    expected = F.least(F.lit(1.0), hours / F.first(F.col("boundary_s") - F.col("start_s")))
    return _measured(rows, F.avg(near.cast("int")) / expected, F.count(F.when(F.col("closed_s") > F.col("boundary_s"), 1)).alias("n_late"), F.count(F.when(near, 1)).alias("n_evidence"))


def eg11(versions: DataFrame) -> DataFrame:
    """Share of record keys whose content differs between submissions; needs two."""
    # two 64-bit marks stand for a hash: they have a fixed width, so keys are aggregated without a sort and shuffled in fewer bytes
    marks = {f"_m{i}": F.when(F.col("record_hash").isNotNull(), F.xxhash64(*[F.lit("other")] * i, "record_hash")) for i in range(2)}
    rows = versions.select("entity_id", "record_key", "submission", *(v.alias(k) for k, v in marks.items())).repartition("entity_id", "record_key")
    each = rows.groupBy("entity_id", "record_key", "submission").agg(*(f(m).alias(f"{n}{m}") for m in marks for n, f in (("l", F.min), ("h", F.max))))
    differ = lambda m: F.coalesce(F.min(f"l{m}") != F.max(f"h{m}"), F.lit(False))
    per_key = each.groupBy("entity_id", "record_key").agg(reduce(or_, map(differ, marks)).alias("changed"), F.count("submission").alias("n_sub"))
    return _measured(per_key, F.avg(F.col("changed").cast("int")), F.max("n_sub").alias("n_submissions"), F.count(F.when(F.col("changed"), 1)).alias("n_changed"), F.count(F.when(F.col("changed"), 1)).alias("n_evidence")).filter("n_submissions >= 2")


def daily_grid(alerts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by key and day, with zeros for days without any: absence shows only on a full grid."""
    span = alerts.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    grid = alerts.select(*keys).distinct().crossJoin(F.broadcast(span))  # the calendar: one row per day
    counts = alerts.groupBy(*keys, "day").agg(F.count("*").alias("activity"))
    return grid.join(counts, [*keys, "day"], "left").withColumn("activity", F.coalesce("activity", F.lit(0)))


def ns01(daily: DataFrame) -> DataFrame:
    """Mean silent fraction of critical assets that are active at times."""
    per_asset = daily.groupBy("entity_id", "asset_id").agg(F.count("*").alias("days"), F.count(F.when(F.col("activity") == 0, 1)).alias("silent"), F.avg("activity").alias("mean"), F.max("criticality").alias("criticality"))
    rows = per_asset.filter((F.col("days") >= 3) & (F.col("criticality") >= 3) & (F.col("silent") >= F.greatest(F.lit(3), F.floor(F.col("days") / 2))) & (F.col("mean") > 0))
    return _measured(rows, F.avg(F.col("silent") / F.col("days")))


def ns02(daily: DataFrame) -> DataFrame:
    """Categories silent in their last two periods after a median above zero."""
    listed = daily.groupBy("entity_id", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "activity"))), lambda x: x["activity"]).alias("a"))
    rows = listed.filter(F.size("a") >= 3).withColumn("early", F.array_sort(F.slice("a", 1, F.size("a") - 2)))
    k = F.size("early")
    middle = (F.element_at("early", F.floor((k + 1) / 2).cast("int")) + F.element_at("early", F.floor(k / 2).cast("int") + 1)) / 2
    gone = (F.element_at("a", -1) == 0) & (F.element_at("a", -2) == 0) & (middle > 0)
    return _measured(rows, F.avg(gone.cast("int")), F.count(F.when(gone, 1)).alias("n_absent"))


def ns04(alerts: DataFrame, case_numbers: DataFrame) -> DataFrame:
    """Share of records whose case is not there."""
    counts = alerts.filter("case_no is not null").groupBy("entity_id", "case_no").agg(F.count("*").alias("k"))  # alerts meet their case once
    rows = counts.join(case_numbers.select("case_no").distinct().withColumn("hit", F.lit(True)), "case_no", "left")
    lost = F.sum(F.when(F.col("hit").isNull(), F.col("k")).otherwise(0))
    return rows.groupBy("entity_id").agg((lost / F.sum("k")).alias("value"), F.sum("k").alias("n"))


def ns05(daily: DataFrame, share: float = 0.25) -> DataFrame:
    """Latest activity relative to the entity's own median, where it is below a share of it."""
    per = daily.groupBy("entity_id", "day").agg(F.sum("activity").alias("activity"))
    out = per.groupBy("entity_id").agg(F.max_by("activity", "day").alias("latest"), F.expr("median(activity)").alias("median"), F.count("*").alias("n"))
    return out.filter(F.col("latest") < share * F.col("median")).select("entity_id", (F.col("latest") / F.col("median")).alias("value"), "n")


def ns06(daily: DataFrame, min_peers: int = 3, surge: float = 1.5) -> DataFrame:
    """Mean gap to peers on days when peers surge and the entity does not. Peers by subtraction from day totals."""
    per = daily.groupBy("entity_id", "day").agg(F.sum("activity").alias("activity"))
    totals = per.groupBy("day").agg(F.sum("activity").alias("total"), F.count("*").alias("n_all"), F.expr("median(activity)").alias("middle"))
    rows = per.join(totals, "day").withColumn("peer_mean", (F.col("total") - F.col("activity")) / (F.col("n_all") - 1)).filter(F.col("n_all") > min_peers)
    shocked = rows.filter((F.col("peer_mean") >= F.greatest(F.lit(1.0), surge * F.col("middle"))) & (F.col("activity") <= 0.5 * F.col("middle")))
    return _measured(shocked, F.avg(F.col("peer_mean") - F.col("activity")))


def ns06_prior(daily: DataFrame, min_peers: int = 3, surge: float = 1.5) -> DataFrame:
    """Mean gap, as a share of the peer mean, on days when peers surge above the median of all earlier peer values (on
    the first day, of that day's) and the entity stays at or below half of it.

    Medians without the entity's own values come from day-level counts of values, summed over earlier days, less the
    entity's own: entities are never paired.
    """
    per = daily.groupBy("entity_id", "day").agg(F.sum("activity").alias("activity"))
    totals = per.groupBy("day").agg(F.sum("activity").alias("total"), F.count("*").alias("n_all"))
    first = per.agg(F.min("day").alias("first"))
    days = per.select("day").distinct().crossJoin(F.broadcast(first))  # one row
    counts = per.groupBy(F.col("day").alias("before"), F.col("activity").alias("v")).agg(F.count("*").alias("c"))
    earlier = (F.col("before") < F.col("day")) | ((F.col("day") == F.col("first")) & (F.col("before") == F.col("day")))
    upto = days.join(F.broadcast(counts), earlier).groupBy("day", "first", "v").agg(F.sum("c").alias("c"))
    summed = upto.withColumn("c", F.sum("c").over(Window.partitionBy("day").orderBy("v")))
    known = summed.groupBy("day", "first").agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("known"), F.max("c").alias("n_known"))
    past = Window.partitionBy("entity_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    rows = per.withColumn("own", F.collect_list("activity").over(past)).join(F.broadcast(known), "day").join(F.broadcast(totals), "day")
    rows = rows.withColumn("own", F.when(F.col("day") == F.col("first"), F.array("activity")).otherwise(F.col("own"))).withColumn("k", F.col("n_known") - F.size("own"))
    ranked = lambda k: f"filter(known, x -> x.c - size(filter(own, o -> o <= x.v)) >= {k})[0].v"
    rows = rows.filter(F.col("n_all") > min_peers).withColumn("base", (F.expr(ranked("floor((k + 1) / 2)")) + F.expr(ranked("floor(k / 2) + 1"))) / 2)
    rows = rows.withColumn("peer_mean", (F.col("total") - F.col("activity")) / (F.col("n_all") - 1))
    shocked = rows.filter((F.col("peer_mean") >= F.greatest(F.lit(1.0), surge * F.col("base"))) & (F.col("activity") <= F.greatest(F.lit(0.0), 0.5 * F.col("base"))))
    return _measured(shocked, F.avg((F.col("peer_mean") - F.col("activity")) / F.greatest("peer_mean", F.lit(1.0))))


def ns03(slots: DataFrame, hours: DataFrame, holidays: DataFrame) -> DataFrame:
    """(entity_id, slot, activity, maintenance) and declared (entity_id, open_hour, close_hour): share of slots inside the
    declared hours of working days without activity or maintenance. Hours may run over midnight; entities that declared
    none are not assessable and have no row."""
    at, first, last = F.hour("slot"), F.col("open_hour"), F.col("close_hour")
    inside = F.when(first < last, (at >= first) & (at < last)).otherwise((at >= first) | (at < last))
    rows = slots.join(F.broadcast(hours.filter("open_hour is not null and close_hour is not null")), "entity_id").filter(inside & (F.weekday("slot") < 5))
    rows = rows.withColumn("date", F.to_date("slot")).join(F.broadcast(holidays.select("date")), "date", "left_anti")
    quiet = (F.col("activity") <= 0) & ~F.coalesce("maintenance", F.lit(False))
    return _measured(rows, F.avg(quiet.cast("int")))


def sparse_confidence(n):
    """Confidence of a negative-space value: full from five observations on."""
    return F.least(F.lit(1.0), n / 5)
