"""Indicators against what entities declare - hours of coverage, figures of their own - and the sameness of their notes.

Each gives one row per entity from grouped aggregates: closures are first counted by minute, so that the work with
calendars is bounded by days and not by rows. What cannot be compared has no value, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: EG-14: a declared figure may be off by this share.
TOLERANCE = 0.05
#: EG-10: a cluster of notes with this share of an entity's notes is raised.
CONCENTRATION = 0.5


def declared_hours(hours: DataFrame) -> DataFrame:
    """(entity_id, weekday 0 = Monday, from_min, to_min) -> the same within single days: a window that ends at or before its
    start runs into the next day (equal: a whole day). Rows with nulls declare nothing."""
    wraps = F.col("to_min") <= F.col("from_min")
    today = F.struct("weekday", "from_min", F.when(wraps, 1440).otherwise(F.col("to_min")).alias("to_min"))
    tomorrow = F.when(wraps & (F.col("to_min") > 0), F.struct(F.pmod(F.col("weekday") + 1, F.lit(7)).alias("weekday"), F.lit(0).alias("from_min"), F.col("to_min")))
    cast = [F.col(c).cast("int").alias(c) for c in ("weekday", "from_min", "to_min")]
    return hours.dropna(subset=["entity_id", "weekday", "from_min", "to_min"]).select("entity_id", *cast).select("entity_id", F.inline(F.array_compact(F.array(today, tomorrow))))


def off_coverage(closures: DataFrame, hours: DataFrame, holidays: DataFrame, offset_min: int = 0) -> DataFrame:
    """EG-03. (entity_id, closed_s), declared (entity_id, weekday, from_min, to_min) and holidays (date) -> value: share of an
    entity's closures outside its declared hours; all of a holiday is outside.

    n_holiday counts those on holidays; band is the hour of the day with most closures outside (the earlier of equals); density
    is closures per minute outside over those inside, the minutes being those of the days from the first to the
    last closure, overlapping windows counted once (null where either side has no minute or the inside no closure). Entities that declare no
    hours are not assessable: value and counts but n are null. Times are shifted by offset_min to local time; closures without a
    time are left out, and a null entity declares nothing.
    """
    local = F.col("closed_s") + offset_min * 60
    counts = closures.filter("closed_s is not null").select("entity_id", F.floor(local / 86_400).cast("int").alias("day"), F.floor(F.pmod(local, F.lit(86_400)) / 60).cast("int").alias("minute"))
    counts = counts.groupBy("entity_id", "day", "minute").agg(F.count("*").alias("k"))
    windows = declared_hours(hours).groupBy("entity_id", "weekday").agg(F.collect_set(F.struct("from_min", "to_min")).alias("windows"))  # some a day
    declares = windows.select("entity_id").distinct().withColumn("declares", F.lit(True))
    free = holidays.filter("date is not null").select(F.datediff("date", F.lit("1970-01-01").cast("date")).alias("day"), F.lit(True).alias("free")).distinct()
    weekday = F.pmod(F.col("day") + 3, F.lit(7)).cast("int").alias("weekday")  # day 0 was a Thursday
    covers = lambda minute: F.exists("windows", lambda w: (w["from_min"] <= minute) & (minute < w["to_min"]))

    rows = counts.select("*", weekday).join(free, "day", "left").join(windows, ["entity_id", "weekday"], "left")
    inside = F.col("free").isNull() & F.coalesce(covers(F.col("minute")), F.lit(False))
    hourly = rows.groupBy("entity_id", F.floor(F.col("minute") / 60).alias("hour")).agg(
        F.sum("k").alias("n"), F.coalesce(F.sum(F.when(~inside, F.col("k"))), F.lit(0)).alias("off"), F.coalesce(F.sum(F.when(F.col("free"), F.col("k"))), F.lit(0)).alias("holiday"), F.min("day").alias("first"), F.max("day").alias("last")
    )
    own = hourly.groupBy("entity_id").agg(
        F.sum("n").alias("n"), F.sum("off").alias("n_off"), F.sum("holiday").alias("n_holiday"), F.max_by("hour", F.struct("off", -F.col("hour"))).alias("band"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    minutes = windows.select("entity_id", "weekday", F.size(F.filter(F.sequence(F.lit(0), F.lit(1439)), covers)).alias("minutes"))
    days = own.select("entity_id", F.explode(F.sequence("first", "last")).alias("day")).select("*", weekday)
    spans = days.join(free, "day", "left").join(minutes, ["entity_id", "weekday"], "left").groupBy("entity_id").agg(
        F.sum(F.when(F.col("free").isNull(), F.coalesce("minutes", F.lit(0))).otherwise(0)).alias("in_min"), F.count("*").alias("n_days")
    )
    own = own.join(declares, "entity_id", "left").join(spans.withColumnRenamed("entity_id", "_e"), F.col("entity_id").eqNullSafe(F.col("_e")), "left")
    out_min = F.col("n_days") * 1440 - F.col("in_min")
    density = F.try_divide(F.col("n_off") * F.col("in_min"), out_min * (F.col("n") - F.col("n_off")))
    known = lambda c: F.when(F.col("declares"), c)
    return own.select(
        "entity_id", known(F.col("n_off") / F.col("n")).alias("value"), "n", known(F.col("n_off")).alias("n_off"), known(F.col("n_holiday")).alias("n_holiday"),
        known(F.when(F.col("n_off") > 0, F.col("band"))).alias("band"), known(F.when(F.col("in_min") > 0, density)).alias("density"),
    )


def case_kpis(cases: DataFrame) -> DataFrame:
    """(entity_id, kpi, value) from (entity_id, created_s, closed_s, severity, disposition, escalation_level), in one aggregate.
    Means are over closed cases that do not end before they begin; a share of nothing is null."""
    took = F.col("closed_s") - F.col("created_s")
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    kpis = {
        "n_cases": F.count("*").cast("double"), "n_severe": F.sum(one(F.col("severity").isin("CRITICAL", "HIGH"))), "closed_share": F.avg(one(F.col("closed_s").isNotNull())),
        "escalation_share": F.avg(one(F.col("escalation_level").isNotNull())), "false_positive_share": F.avg(F.when(F.col("closed_s").isNotNull(), one(F.col("disposition") == "FALSE_POSITIVE"))), "mean_duration_s": F.avg(F.when(took >= 0, took)),
    }
    return cases.groupBy("entity_id").agg(*(v.alias(k) for k, v in kpis.items())).unpivot("entity_id", list(kpis), "kpi", "value")


def declared_kpis(declared: DataFrame, recomputed: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """EG-14. (entity_id, kpi, declared) against (entity_id, kpi, value) -> value: share of an entity's comparable declarations that
    differ from the recomputed figure by more than tolerance of it; n compared, n_beyond, n_unmatched (nothing to
    compare with: not assessable, never a match), and the worst figure (the first by name of equals) with its deviation.

    The deviation is signed, declared less recomputed over recomputed; where that is zero, 0 or 1 as the two agree or not. A figure that
    is declared twice counts twice. Entities without a comparable figure have no value.
    """
    d, v = F.col("declared").cast("double"), F.col("value").cast("double")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in ("entity_id", "kpi")]
    rows = declared.select("entity_id", "kpi", d.alias("d")).join(recomputed.select(F.col("entity_id").alias("_entity_id"), F.col("kpi").alias("_kpi"), v.alias("v")), same[0] & same[1], "left")
    both = F.col("d").isNotNull() & F.col("v").isNotNull() & ~F.isnan("d") & ~F.isnan("v")
    deviation = F.when(both, F.when(F.col("v") == 0, F.when(F.col("d") == 0, 0.0).otherwise(1.0)).otherwise((F.col("d") - F.col("v")) / F.abs("v")))
    rows = rows.withColumn("deviation", deviation).withColumn("beyond", (F.abs("deviation") > tolerance).cast("int"))
    worst = F.when(F.col("deviation").isNotNull(), F.struct((-F.abs("deviation")).alias("far"), F.col("kpi"), F.col("deviation")))
    out = rows.groupBy("entity_id").agg(
        F.avg("beyond").alias("value"), F.count("beyond").alias("n"), F.coalesce(F.sum("beyond"), F.lit(0)).alias("n_beyond"), F.count(F.when(F.col("beyond").isNull(), 1)).alias("n_unmatched"), F.min(worst).alias("w")
    )
    return out.select("entity_id", "value", "n", "n_beyond", "n_unmatched", F.col("w.kpi").alias("worst"), F.col("w.deviation").alias("deviation"))


def template_key(text: Column) -> Column:
    """What is left of a note when its figures are masked: lower case, each run of digits one mark, blanks once."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "#"), r"\s+", " "))


def monoculture(notes: DataFrame, concentration: float = CONCENTRATION) -> DataFrame:
    """EG-10. (entity_id, cluster, analyst, severity, legitimate), one row a note -> value: share of an entity's notes in its
    largest cluster of two or more (the first by name of equals); 0.0 where all notes differ.

    index is the chance that two notes drawn with replacement come from one cluster, notes without a cluster standing for
    themselves. A cluster whose notes are all legitimate templates does not count as the largest, but its notes do among n. With
    the largest cluster's analysts and share of high and critical cases. Clusters are counted before they meet, so a
    template with a third of all notes is one row by task and analyst.
    """
    severe = F.coalesce(F.col("severity").isin("HIGH", "CRITICAL"), F.lit(False)).cast("long")
    fair = F.coalesce(F.col("legitimate"), F.lit(False)).cast("long")
    by_analyst = notes.groupBy("entity_id", "cluster", "analyst").agg(F.count("*").alias("k"), F.sum(severe).alias("severe"), F.sum(fair).alias("fair"))
    clusters = by_analyst.groupBy("entity_id", "cluster").agg(F.sum("k").alias("k"), F.count("analyst").alias("analysts"), F.sum("severe").alias("severe"), F.sum("fair").alias("fair"))
    known = F.col("cluster").isNotNull()
    largest = F.when(known & (F.col("k") > 1) & (F.col("fair") < F.col("k")), F.struct((-F.col("k")).alias("size"), "cluster", "analysts", (F.col("severe") / F.col("k")).alias("severe")))
    squares = F.when(known, F.col("k").cast("double") * F.col("k")).otherwise(F.col("k").cast("double"))
    out = clusters.groupBy("entity_id").agg(F.sum("k").alias("n"), F.sum(squares).alias("kk"), F.min(largest).alias("top"))
    value = F.coalesce(-F.col("top.size") / F.col("n"), F.lit(0.0))
    return out.select(
        "entity_id", value.alias("value"), "n", (F.col("kk") / F.col("n") / F.col("n")).alias("index"), F.col("top.cluster").alias("cluster"),
        F.col("top.analysts").alias("n_analysts"), F.col("top.severe").alias("severe_share"), (value >= concentration).alias("raised"),
    )
