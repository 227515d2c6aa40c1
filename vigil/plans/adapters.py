"""The given tables seen as supervisory evidence, and the same views as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.plans import shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as supervised entities in two sectors, their cohorts; there are peers at every size of the tables."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.col("n_name").alias("nation"), F.when(F.col("s_suppkey") % 2 == 0, "BANK").otherwise("ENERGY").alias("cohort"))


ENTITIES = "entities AS (SELECT s_suppkey AS entity_id, s_name AS name, n_name AS nation, CASE WHEN s_suppkey % 2 = 0 THEN 'BANK' ELSE 'ENERGY' END AS cohort FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


#: From some year on, every fifth entity dismisses half of its cases: a regime shift.
LATE_DISMISSALS = "l_suppkey % 10 IN (2, 8) AND year(o_orderdate) >= 1998 AND l_linenumber % 2 = 0"


def _duration() -> Column:
    fast = F.when(F.col("l_suppkey") % 10 == 3, 5).otherwise(75 + 5 * (F.col("l_suppkey") % 11))
    return F.floor(((F.col("l_partkey") * 7919 + F.col("l_orderkey") * 131) % 50000) * fast / 100).cast("long")


def orders_of(spark: SparkSession, sf_dir: str, start: str, end: str) -> DataFrame:
    """The orders of a half-open period of days."""
    o = table(spark, sf_dir, "orders")
    kind = o.schema["o_orderdate"].dataType.simpleString()
    return o.filter((F.col("o_orderdate") >= F.lit(start).cast(kind)) & (F.col("o_orderdate") < F.date_add(F.lit(end), 1).cast(kind)))


def cases(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Order lines as investigation cases. The key is not unique, as in real submissions. start and end are days of a
    half-open period; the filter stands on the stored column, so that files and row groups outside it are not read.

    Weaknesses are planted by entity: every tenth closes fast and escalates nothing, another escalates nothing, a third
    keeps no notes; so indicators have what to find at every size."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    if start and end:
        o = orders_of(spark, sf_dir, start, end)
        li = shared.among(li, "l_orderkey", o, "o_orderkey")
    priority = F.substring("o_orderpriority", 1, 1)
    # what a line says by itself is worked out before the join, so that the shuffle carries one column of flags in place of wide
    # ones, and a ship date only for the lines that are judged by it; an unknown discount stays unknown
    deep = F.coalesce((F.col("l_discount") >= 0.08).cast("int"), F.lit(2))
    yes = lambda cond: F.when(cond, 1).otherwise(0)
    returned = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0)
    flags = yes((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")) + 2 * yes(F.col("l_quantity") > 45) + 4 * returned + 16 * deep
    li = li.select("l_orderkey", "l_linenumber", "l_suppkey", F.when(F.col("l_linenumber") == 1, F.col("l_shipdate")).alias("l_shipdate"), _duration().alias("d"), flags.alias("flags"))
    out = li.join(o.select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 50).alias("analyst"), priority.alias("priority")), li.l_orderkey == F.col("o_orderkey"))
    bits = lambda at, mask: F.shiftright("flags", at).bitwiseAND(mask)
    deep = F.when(bits(4, 3) < 2, bits(4, 3) == 1)
    out = out.select("*", (bits(0, 1) == 1).alias("unfinished"), (bits(1, 1) == 1).alias("many"), bits(2, 3).alias("flag"), deep.alias("deep"))
    priority = F.col("priority")
    created, supplier = F.col("o_orderdate").cast("timestamp"), F.col("l_suppkey") % 10
    escalates, keeps_notes = ~supplier.isin(3, 4), supplier != 6
    closed = F.when(F.col("unfinished"), F.lit(None)).when((F.col("l_shipdate") < F.col("o_orderdate")) & (F.col("l_linenumber") == 1), F.unix_timestamp(created) - 3600).otherwise(F.unix_timestamp(created) + F.col("d"))
    return out.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("case_id"), F.col("l_suppkey").alias("entity_id"), F.unix_timestamp(created).alias("created_s"), closed.alias("closed_s"),
        F.when(F.col("l_linenumber") % 2 == 1, F.col("d")).alias("declared_s"),
        F.when(priority == "1", "CRITICAL").when(priority == "2", "HIGH").when(priority == "3", "MEDIUM").otherwise("LOW").alias("severity"),
        F.when(F.expr(LATE_DISMISSALS), "FALSE_POSITIVE").when(F.col("flag") == 1, "TRUE_POSITIVE").when(F.col("flag") == 2, "FALSE_POSITIVE").otherwise("SUPPRESSED").alias("disposition"),
        "analyst", F.when(F.col("many") & escalates, 2).alias("escalation_level"), F.year("o_orderdate").alias("year"),
        (F.col("deep") & escalates).alias("escalated"), F.when(keeps_notes, (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 1000).otherwise(-1).alias("note_ref"),
    )


CASES = f"""cases AS (SELECT l_orderkey || '-' || l_linenumber AS case_id, l_suppkey AS entity_id, CAST(epoch(o_orderdate) AS BIGINT) AS created_s,
 CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN NULL WHEN l_shipdate < o_orderdate AND l_linenumber = 1 THEN CAST(epoch(o_orderdate) AS BIGINT) - 3600 ELSE CAST(epoch(o_orderdate) AS BIGINT) + d END AS closed_s,
 CASE WHEN l_linenumber % 2 = 1 THEN d END AS declared_s,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 CASE WHEN {LATE_DISMISSALS} THEN 'FALSE_POSITIVE' WHEN l_returnflag = 'A' THEN 'TRUE_POSITIVE' WHEN l_returnflag = 'R' THEN 'FALSE_POSITIVE' ELSE 'SUPPRESSED' END AS disposition,
 o_custkey % 50 AS analyst, CASE WHEN l_quantity > 45 AND l_suppkey % 10 NOT IN (3, 4) THEN 2 END AS escalation_level, year(o_orderdate) AS year,
 l_discount >= 0.08 AND l_suppkey % 10 NOT IN (3, 4) AS escalated, CASE WHEN l_suppkey % 10 <> 6 THEN (l_orderkey * 7 + l_linenumber) % 1000 ELSE -1 END AS note_ref
 FROM (SELECT *, CAST(floor(((l_partkey * 7919 + l_orderkey * 131) % 50000) * (CASE WHEN l_suppkey % 10 = 3 THEN 5 ELSE 75 + 5 * (l_suppkey % 11) END) / 100) AS BIGINT) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""


# What is planted: a sixth of the assets, all severe, fall silent; peers surge on one day while a third of the assets stays quiet.
_HEARD = "NOT (user_id % 4 >= 2 AND user_id % 3 = 0 AND day(ts) >= 13) AND NOT (user_id % 3 = 1 AND day(ts) BETWEEN 25 AND 28)"
_DAY = "CASE WHEN day(ts) BETWEEN 26 AND 28 THEN CAST('2024-01-25' AS DATE) ELSE CAST(ts AS DATE) END"


def all_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an alert; their case ids dangle for every seventh event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("alert_id"), (F.col("user_id") % 100).alias("entity_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("event_s"), F.expr(_DAY).alias("day"),
        F.col("event_type").alias("category"), F.col("user_id").alias("asset_id"), (1 + F.col("user_id") % 4).alias("criticality"),
        F.when(F.col("event_id") % 7 == 0, F.lit(-1)).otherwise(F.col("event_id") % 1000).alias("case_no"), F.col("value"), F.expr(_HEARD).alias("heard"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts without those of the planted silences."""
    return all_alerts(spark, sf_dir).filter("heard").drop("heard")


ALL_ALERTS = f"""alerts AS (SELECT event_id AS alert_id, user_id % 100 AS entity_id, CAST(floor(epoch(ts)) AS BIGINT) AS event_s, {_DAY} AS day, event_type AS category, user_id AS asset_id,
 1 + user_id % 4 AS criticality, CASE WHEN event_id % 7 = 0 THEN -1 ELSE event_id % 1000 END AS case_no, value FROM events)"""
ALERTS = f"{ALL_ALERTS[:-1]} WHERE {_HEARD})"


def raw_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases as submitted text, with dirt at places that the order number fixes."""
    o = table(spark, sf_dir, "orders")
    k, date = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    severity = F.when(k % 13 == 1, " sev1 ").when(k % 13 == 2, "P2").when(k % 13 == 3, "Informational").when(k % 13 == 4, "urgent").otherwise(F.upper(F.substring_index("o_orderpriority", "-", -1)))
    stamp = F.when(k % 19 == 1, F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string")).when(k % 19 == 2, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k % 19 == 3, F.concat(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")), F.lit("000"))).when(k % 19 == 4, F.lit("not a date")).when(k % 19 == 5, F.concat(date, F.lit("T10:00:00Z"))).otherwise(date)
    note = F.when(k % 17 == 1, "N/A").when(k % 17 == 2, "-").when(k % 17 == 3, F.concat(F.lit("=SUM("), k, F.lit(")"))).when(k % 17 == 4, F.concat(F.lit("mail a.b@corp"), k, F.lit(".example.com from 10.0.0."), k % 256)).otherwise(F.concat(F.lit(" closed "), k))
    flag = F.when(k % 5 == 0, "Yes").when(k % 5 == 1, "off").when(k % 5 == 2, "maybe").otherwise("1")
    amount = F.when(k % 11 == 0, "1,234").when(k % 11 == 1, "NaN").when(k % 11 == 2, "12.7").otherwise(F.col("o_custkey").cast("string"))
    return o.select((k % 5000).cast("string").alias("case_ref"), k.alias("source_row"), severity.alias("severity_raw"), stamp.alias("opened_raw"), note.alias("note_raw"), flag.alias("flag_raw"), amount.alias("amount_raw"), F.concat(F.lit("user"), F.col("o_custkey") % 50).alias("analyst_raw"))


RAW = """raw AS (SELECT CAST(o_orderkey % 5000 AS VARCHAR) AS case_ref, o_orderkey AS source_row,
 CASE o_orderkey % 13 WHEN 1 THEN ' sev1 ' WHEN 2 THEN 'P2' WHEN 3 THEN 'Informational' WHEN 4 THEN 'urgent' ELSE upper(split_part(o_orderpriority, '-', -1)) END AS severity_raw,
 CASE o_orderkey % 19 WHEN 1 THEN CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 3 THEN CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) || '000' WHEN 4 THEN 'not a date' WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00Z' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS opened_raw,
 CASE o_orderkey % 17 WHEN 1 THEN 'N/A' WHEN 2 THEN '-' WHEN 3 THEN '=SUM(' || o_orderkey || ')' WHEN 4 THEN 'mail a.b@corp' || o_orderkey || '.example.com from 10.0.0.' || (o_orderkey % 256) ELSE ' closed ' || o_orderkey END AS note_raw,
 CASE o_orderkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'off' WHEN 2 THEN 'maybe' ELSE '1' END AS flag_raw,
 CASE o_orderkey % 11 WHEN 0 THEN '1,234' WHEN 1 THEN 'NaN' WHEN 2 THEN '12.7' ELSE CAST(o_custkey AS VARCHAR) END AS amount_raw,
 'user' || (o_custkey % 50) AS analyst_raw FROM orders)"""
