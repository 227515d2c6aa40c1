"""Queries against what entities declare, of notes' sameness, of masked evidence, exports of an assessment, and jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import declared as d
from vigil.operators import indicators as ind
from vigil.operators import injection, privacy
from vigil.plans import adapters as a
from vigil.plans import assembly, catalogue, review, shared
from vigil.plans.catalogue import query
from vigil.sources import files

KINDS = ("csv", "json", "ndjson", "parquet")

#: Declared coverage by entity_id % 3: weekdays, start, end; every eleventh entity declares none.
SHIFTS = {0: (range(5), 540, 1080), 1: (range(7), 0, 0), 2: (range(6), 1200, 480)}


def declared_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Office hours, all day, or nights that run into the next day."""
    rows = a.entities(spark, sf_dir).filter("entity_id % 11 <> 0")
    windows = [F.when(F.col("entity_id") % 3 == k, F.array(*(F.struct(F.lit(w).alias("weekday"), F.lit(x).alias("from_min"), F.lit(y).alias("to_min")) for w in days))) for k, (days, x, y) in SHIFTS.items()]
    return rows.select("entity_id", F.inline(F.coalesce(*windows)))


def holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return a.table(spark, sf_dir, "orders").select(day.alias("date")).filter(F.date_format("date", "MM-dd").isin("01-01", "08-15", "12-25")).distinct()


@query(f"""WITH {a.CASES}, c AS (SELECT entity_id, closed_s // 86400 AS day, (closed_s % 86400) // 60 AS minute, count(*) AS k FROM cases WHERE closed_s IS NOT NULL GROUP BY ALL),
 e AS (SELECT s_suppkey AS entity_id FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 11 <> 0),
 h AS (SELECT entity_id, unnest(range(5)) AS wd, 540 AS x, 1080 AS y FROM e WHERE entity_id % 3 = 0 UNION ALL SELECT entity_id, unnest(range(7)), 0, 1440 FROM e WHERE entity_id % 3 = 1
  UNION ALL SELECT entity_id, unnest(range(6)), 1200, 1440 FROM e WHERE entity_id % 3 = 2 UNION ALL SELECT entity_id, unnest(range(6)) + 1, 0, 480 FROM e WHERE entity_id % 3 = 2),
 free AS (SELECT DISTINCT date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders WHERE strftime(o_orderdate, '%m-%d') IN ('01-01', '08-15', '12-25')),
 r AS (SELECT c.*, f.day IS NOT NULL AS free, f.day IS NULL AND EXISTS (SELECT 1 FROM h WHERE h.entity_id = c.entity_id AND wd = (c.day + 3) % 7 AND c.minute >= x AND c.minute < y) AS inside FROM c LEFT JOIN free f ON f.day = c.day),
 o AS (SELECT entity_id, sum(k) AS n, coalesce(sum(k) FILTER (NOT inside), 0) AS n_off, coalesce(sum(k) FILTER (free), 0) AS n_holiday, min(day) AS first, max(day) AS last FROM r GROUP BY entity_id),
 b AS (SELECT entity_id, minute // 60 AS hour, sum(k) AS k FROM r WHERE NOT inside GROUP BY ALL), top AS (SELECT entity_id, hour AS band FROM b QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY k DESC, hour) = 1),
 days AS (SELECT entity_id, unnest(range(first, last + 1)) AS day FROM o), hm AS (SELECT entity_id, wd, sum(y - x) AS m FROM h GROUP BY ALL),
 z AS (SELECT days.entity_id, count(*) AS n_days, coalesce(sum(m) FILTER (f.day IS NULL), 0) AS in_min FROM days LEFT JOIN free f ON f.day = days.day LEFT JOIN hm ON hm.entity_id = days.entity_id AND wd = (days.day + 3) % 7 GROUP BY days.entity_id)
 SELECT o.entity_id, round(CASE WHEN e.entity_id IS NOT NULL THEN n_off / n END, 6) AS value, CAST(n AS BIGINT) AS n, CAST(CASE WHEN e.entity_id IS NOT NULL THEN n_off END AS BIGINT) AS n_off, CAST(CASE WHEN e.entity_id IS NOT NULL THEN n_holiday END AS BIGINT) AS n_holiday,
  CASE WHEN e.entity_id IS NOT NULL THEN band END AS band, round(CASE WHEN e.entity_id IS NOT NULL AND in_min > 0 THEN n_off * in_min / nullif((n_days * 1440 - in_min) * (n - n_off), 0) END, 6) AS density
 FROM o JOIN z USING (entity_id) LEFT JOIN top USING (entity_id) LEFT JOIN e ON e.entity_id = o.entity_id""")  # fmt: skip
def eg03_off_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EG-03: closures outside the declared hours or on holidays, how dense they are there, and the hour they mass in."""
    closures = a.cases(spark, sf_dir).select("entity_id", "closed_s")
    out = d.off_coverage(closures, declared_hours(spark, sf_dir), holidays(spark, sf_dir))
    return out.select("entity_id", F.round("value", 6).alias("value"), "n", "n_off", "n_holiday", "band", F.round("density", 6).alias("density"))


#: Every fifth entity closes with one template; others write by customer, priority or both.
_NOTE = """CASE WHEN o_custkey % 40 % 5 = 0 AND o_orderkey % 4 <> 1 THEN concat('Closed  as DUPLICATE of ', o_orderkey, ' at step ', o_orderkey % 9) WHEN o_orderkey % 50 = 7 THEN NULL
 WHEN o_custkey % 3 = 0 THEN concat('Checked with ', o_orderpriority, ' team of ', chr(97 + CAST(o_custkey % 26 AS INT)), ', order ', o_orderkey) ELSE concat(o_orderstatus, ' after review by ', chr(97 + CAST(o_orderkey % 26 AS INT)), chr(97 + CAST(o_orderkey // 26 % 26 AS INT))) END"""


@query(f"""WITH s AS (SELECT o_custkey % 40 AS entity_id, o_orderkey % 12 AS analyst, substr(o_orderpriority, 1, 1) IN ('1', '2') AS severe, o_custkey % 40 = 15 AS legitimate, {_NOTE} AS text FROM orders),
 n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) AS cluster FROM s),
 c AS (SELECT entity_id, cluster, count(*) AS k, count(DISTINCT analyst) AS analysts, count(*) FILTER (severe) AS severe, count(*) FILTER (legitimate) AS fair FROM n GROUP BY ALL),
 t AS (SELECT * FROM c WHERE cluster IS NOT NULL AND k > 1 AND fair < k QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY k DESC, cluster) = 1),
 o AS (SELECT entity_id, sum(k) AS n, sum(CASE WHEN cluster IS NULL THEN k ELSE CAST(k AS DOUBLE) * k END) AS kk FROM c GROUP BY entity_id)
 SELECT entity_id, round(coalesce(k / n, 0), 6) AS value, CAST(n AS BIGINT) AS n, round(kk / n / n, 6) AS "index", cluster, analysts AS n_analysts, round(severe / k, 6) AS severe_share, coalesce(k / n, 0) >= {d.CONCENTRATION} AS raised FROM o LEFT JOIN t USING (entity_id)""")  # fmt: skip
def eg10_monoculture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EG-10: how much of an entity's notes is one template, and whose cases it closes."""
    note = _NOTE.replace("chr(", "char(").replace("o_orderkey // 26", "o_orderkey div 26")
    priority = F.substring("o_orderpriority", 1, 1)
    notes = a.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 40).alias("entity_id"), (F.col("o_orderkey") % 12).alias("analyst"), F.when(priority == "1", "CRITICAL").when(priority == "2", "HIGH").otherwise("LOW").alias("severity"),
        (F.col("o_custkey") % 40 == 15).alias("legitimate"), d.template_key(F.expr(note)).alias("cluster"),
    )
    out = d.monoculture(notes)
    return out.select("entity_id", *(F.round(c, 6).alias(c) for c in ("value", "index", "severe_share")), "n", "cluster", "n_analysts", "raised")


def declarations(cases: DataFrame) -> DataFrame:
    """Figures as entities give them: some leave out low cases, call suppressed cases false positives, or round up to all closed;
    durations are those declared with the cases; the backlog is a figure that nothing recomputes."""
    e, n = F.col("entity_id"), lambda c: F.count(F.when(c, 1)).cast("double")
    closed = F.col("closed_s").isNotNull()
    benign = (F.col("disposition") == "FALSE_POSITIVE") | ((e % 7 == 0) & (F.col("disposition") == "SUPPRESSED"))
    kpis = {
        "n_cases": n(~((e % 10 == 4) & (F.col("severity") == "LOW"))), "closed_share": F.avg(F.when(e % 5 == 0, 1.0).when(e % 5 == 1, F.lit(None)).otherwise(closed.cast("double"))),
        "false_positive_share": F.avg(F.when(closed, benign.cast("double"))), "mean_duration_s": F.avg("declared_s"), "backlog": n(~closed),
    }
    return cases.groupBy("entity_id").agg(*(v.alias(k) for k, v in kpis.items())).unpivot("entity_id", list(kpis), "kpi", "declared")


@query(f"""WITH {a.CASES}, y AS (SELECT * FROM cases WHERE year = 1996), q AS (SELECT entity_id,
  CAST(count(*) FILTER (NOT (entity_id % 10 = 4 AND severity = 'LOW')) AS DOUBLE) AS d1, CAST(count(*) AS DOUBLE) AS v1,
  avg(CASE WHEN entity_id % 5 = 0 THEN 1.0 WHEN entity_id % 5 = 1 THEN NULL WHEN closed_s IS NOT NULL THEN 1.0 ELSE 0.0 END) AS d2, avg(CASE WHEN closed_s IS NOT NULL THEN 1.0 ELSE 0.0 END) AS v2,
  avg(CASE WHEN closed_s IS NOT NULL THEN CASE WHEN disposition = 'FALSE_POSITIVE' OR entity_id % 7 = 0 AND disposition = 'SUPPRESSED' THEN 1.0 ELSE 0.0 END END) AS d3, avg(CASE WHEN closed_s IS NOT NULL THEN CASE WHEN disposition = 'FALSE_POSITIVE' THEN 1.0 ELSE 0.0 END END) AS v3,
  avg(declared_s) AS d4, avg(CASE WHEN closed_s >= created_s THEN closed_s - created_s END) AS v4, CAST(count(*) - count(closed_s) AS DOUBLE) AS d5 FROM y GROUP BY entity_id),
 k AS (SELECT entity_id, 'n_cases' AS kpi, d1 AS d, v1 AS v FROM q UNION ALL SELECT entity_id, 'closed_share', d2, v2 FROM q UNION ALL SELECT entity_id, 'false_positive_share', d3, v3 FROM q UNION ALL SELECT entity_id, 'mean_duration_s', d4, v4 FROM q UNION ALL SELECT entity_id, 'backlog', d5, NULL FROM q),
 x AS (SELECT *, CASE WHEN v = 0 THEN CASE WHEN d = 0 THEN 0 WHEN d IS NOT NULL THEN 1 END ELSE (d - v) / abs(v) END AS deviation FROM k),
 w AS (SELECT entity_id, kpi AS worst, deviation FROM x WHERE deviation IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY abs(deviation) DESC, kpi) = 1),
 o AS (SELECT entity_id, count(deviation) AS n, count(*) FILTER (abs(deviation) > {d.TOLERANCE}) AS n_beyond, count(*) - count(deviation) AS n_unmatched FROM x GROUP BY entity_id)
 SELECT entity_id, round(n_beyond / nullif(n, 0), 6) AS value, n, n_beyond, n_unmatched, worst, round(deviation, 6) AS deviation FROM o LEFT JOIN w USING (entity_id)""")  # fmt: skip
def eg14_declared_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EG-14: declared figures of a year against the same figures from its cases."""
    cases = shared.kept(catalogue.year_cases(spark, sf_dir).select("entity_id", "created_s", "closed_s", "declared_s", "severity", "disposition", "escalation_level"))
    out = d.declared_kpis(declarations(cases), d.case_kpis(cases))
    return out.select("entity_id", F.round("value", 6).alias("value"), "n", "n_beyond", "n_unmatched", "worst", F.round("deviation", 6).alias("deviation"))


# --- masked evidence ---

_SEEN = "NOT (user_id % 36 IN (22, 31) AND day(ts) >= 11)"


@query(f"""WITH r AS (SELECT user_id % 36 AS entity_id, user_id AS asset_id, 1 + user_id % 4 AS criticality, CAST(ts AS DATE) AS day, {_SEEN} AS seen FROM events),
 days AS (SELECT unnest(generate_series((SELECT min(day) FROM r), (SELECT max(day) FROM r), INTERVAL 1 DAY))::DATE AS day),
 g AS (SELECT e.*, day, coalesce(k, 0) AS activity FROM (SELECT DISTINCT entity_id, asset_id, criticality FROM r) e CROSS JOIN days LEFT JOIN (SELECT asset_id, day, count(*) AS k FROM r WHERE seen GROUP BY ALL) USING (asset_id, day)),
 m AS (SELECT level, entity_id, asset_id, criticality, CASE WHEN CAST('0x' || substr(sha256(entity_id || ':' || asset_id || ':' || strftime(day, '%Y-%m-%d')), 1, 8) AS BIGINT) / 4294967295 >= level THEN activity END AS activity FROM g CROSS JOIN (SELECT unnest([{", ".join(f"CAST({x} AS DOUBLE)" for x in injection.LEVELS)}]) AS level)),
 p AS (SELECT level, entity_id, asset_id, count(activity) AS days, count(*) FILTER (activity = 0) AS silent, sum(activity) AS total, max(criticality) FILTER (activity IS NOT NULL) AS criticality FROM m GROUP BY ALL),
 e AS (SELECT level, entity_id, sum(days) >= 3 AS seen, bool_or(coalesce(criticality >= 3 AND silent >= greatest(3, days // 2) AND total > 0, FALSE)) AS found, entity_id IN (22, 31) AS planted FROM p GROUP BY level, entity_id),
 o AS (SELECT level, count(*) AS n_entities, count(*) FILTER (NOT seen) AS n_not_assessable, count(*) FILTER (seen AND found AND planted) AS tp, count(*) FILTER (seen AND found AND NOT planted) AS fp, count(*) FILTER (seen AND NOT found AND planted) AS fn FROM e GROUP BY level)
 SELECT *, round(1 - n_not_assessable / n_entities, 6) AS assessable_rate, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM o""")  # fmt: skip
def missingness_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What masking more and more of the activity does to the detection of planted silences: lost days are no silent days."""
    rows = a.table(spark, sf_dir, "events").select((F.col("user_id") % 36).alias("entity_id"), F.col("user_id").alias("asset_id"), (1 + F.col("user_id") % 4).alias("criticality"), F.to_date("ts").alias("day"), F.expr(_SEEN).alias("seen"))
    grid = ind.daily_grid(rows, ["entity_id", "asset_id", "criticality"]).drop("activity")
    counts = rows.filter("seen").groupBy("asset_id", "day").agg(F.count("*").alias("activity"))
    daily = grid.join(counts, ["asset_id", "day"], "left").withColumn("activity", F.coalesce("activity", F.lit(0)))
    truth = rows.select("entity_id").distinct().filter("entity_id IN (22, 31)")
    out = injection.missingness(daily, truth, ["entity_id", "asset_id", F.date_format("day", "yyyy-MM-dd")])
    return out.select("level", "n_entities", "n_not_assessable", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("assessable_rate", "precision", "recall")))


# --- exports and jobs ---


def _exported(name: str, sql: str, value: str) -> str:
    return f"SELECT '{name}' AS tbl, kind, count(*) AS n, count(*) - count({value}) AS n_absent, round(sum({value}), 3) AS total FROM ({sql}) CROSS JOIN (SELECT unnest([{', '.join(repr(k) for k in KINDS)}]) AS kind) GROUP BY kind"


@query(" UNION ALL ".join(_exported(n, catalogue.ORACLE_SQL[q], v) for n, q, v in (("findings", "findings", "effect"), ("evidence", "evidence_rows", "ordinal"), ("dimension_scores", "dimension_results", "score"))))
def assessment_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings, evidence rows and dimension scores as flat files of each kind, read again: what could not be assessed is absent
    from the files, not zero."""
    cases = catalogue.kept_cases(spark, sf_dir)
    tables = {"findings": (catalogue.raised(spark, sf_dir, cases), "effect"), "evidence": (review.numbered_evidence(spark, sf_dir, cases), "ordinal"), "dimension_scores": (assembly.spread_scores(spark, sf_dir, cases), "score")}
    out = []
    for name, (rows, value) in tables.items():
        safe = shared.kept(privacy.export_safe(rows))
        for kind in KINDS:
            path = shared.folder(spark)
            files.export(safe, path, kind)
            back = spark.read.csv(path, header=True) if kind == "csv" else spark.read.parquet(path) if kind == "parquet" else spark.read.schema(safe.schema).json(path)
            number = F.col(value).cast("double")
            out.append(back.agg(F.count("*").alias("n"), (F.count("*") - F.count(number)).alias("n_absent"), F.round(F.sum(number), 3).alias("total")).select(F.lit(name).alias("tbl"), F.lit(kind).alias("kind"), "n", "n_absent", "total"))
    return reduce(DataFrame.unionByName, out)


@query("SELECT o_orderkey AS job_id, 'running' AS status, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 2")
def job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of one status, newest first, one page; the limit is the feature."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "running").otherwise("queued")
    jobs = a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), "o_orderdate").filter("status = 'running'")
    return jobs.orderBy(F.desc("o_orderdate"), "job_id").offset(2).limit(20).select("job_id", "status", F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"))
