"""Queries from evidence presence to scorecards: what can be assessed, gated results, trust, indexes and priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions import stats
from vigil.operators import assess, scoring
from vigil.operators import indicators as ind
from vigil.plans import adapters as a
from vigil.plans import catalogue as c
from vigil.plans import shared
from vigil.plans.catalogue import query

# What each dimension needs, its least tier and weight; what each indicator needs.
NEEDS = [
    ("TD", "B", "required", "alert_record", "event_ts"), ("TD", "B", "required", "alert_record", "mitre_tactic"), ("TD", "B", "optional", "alert_record", "mitre_technique_id"),
    ("TD", "B", "optional", "telemetry_daily", "*"), ("TD", "B", "optional", "asset", "*"),
    ("INV", "A", "required", "case_record", "disposition"), ("INV", "A", "required", "note_store", "length"), ("INV", "A", "optional", "case_record", "closed_at"), ("INV", "A", "optional", "note_store", "redacted_text"),
    ("ESC", "A", "required", "case_record", "severity_norm"), ("ESC", "A", "required", "escalation", "case_id"), ("ESC", "A", "optional", "escalation", "acknowledged_ts"), ("ESC", "A", "optional", "case_event", "event_type"),
    ("IR", "A", "required", "case_record", "closed_at"), ("IR", "A", "optional", "case_record", "root_cause_action"), ("IR", "A", "optional", "alert_case", "*"),
    ("SO", "B", "required", "case_event", "ts"), ("SO", "B", "optional", "case_event", "event_type"), ("SO", "B", "optional", "entity", "roster_ref"),
    ("GOV", "B", "required", "submission", "*"), ("GOV", "B", "required", "record_version", "*"), ("GOV", "B", "optional", "submission", "declared_kpis"), ("GOV", "B", "soft", "submission", "second"),
    ("OD", "A", "required", "case_event", "ts"), ("OD", "A", "optional", "case_record", "created_at"),
    ("CR", "B", "required", "asset", "*"), ("CR", "B", "optional", "telemetry_daily", "*"), ("CR", "B", "optional", "alert_record", "destination_asset_id"), ("CR", "B", "optional", "alert_case", "*"),
]
WEIGHTS = {"TD": 0.14, "INV": 0.16, "ESC": 0.16, "IR": 0.14, "SO": 0.12, "GOV": 0.12, "OD": 0.10, "CR": 0.06}
SPECS = [
    ("eg01", "rapid_thin_closure", "INV", "A"), ("eg02", "rapid_thin_closure", "INV", "A"), ("eg06", "escalation_integrity", "ESC", "A"),
    ("eg08", "metric_gaming", "OD", "A"), ("eg09", "metric_gaming", "OD", "A"), ("eg11", "governance_records", "GOV", "B"), ("ns04", "record_integrity", "GOV", "B"),
]
FAMILIES = [("rapid_thin_closure", 0.5, "egi"), ("escalation_integrity", 0.6, "egi"), ("metric_gaming", 0.5, "egi"), ("governance_records", 0.5, "egi"), ("record_integrity", 0.5, "nsi")]
INDICATOR_NEEDS = [
    ("eg01", "case_record", "created_at", False), ("eg01", "case_record", "closed_at", False), ("eg01", "case_record", "severity_norm", False),
    ("eg02", "case_record", "disposition", False), ("eg02", "case_record", "severity_norm", False), ("eg02", "note_store", "length", True),
    ("eg06", "case_record", "severity_norm", False), ("eg06", "case_record", "closed_at", False), ("eg06", "escalation", "case_id", True),
    ("eg08", "case_record", "investigation_duration_sec", False), ("eg08", "case_record", "severity_norm", False),
    ("eg09", "case_record", "closed_at", False), ("eg09", "submission", "*", False), ("eg11", "submission", "*", False), ("eg11", "record_version", "*", False),
]

#: The evidence of each table as SQL over the year's cases c and the alerts; gaps lie at fixed entity numbers.
TABLES_SQL = {
    "case_record": ("SELECT entity_id, created_s AS created_at, CASE WHEN entity_id % 10 <> 4 THEN closed_s END AS closed_at, severity AS severity_norm, CASE WHEN entity_id % 10 <> 5 THEN disposition END AS disposition, CASE WHEN entity_id % 2 = 0 AND disposition = 'TRUE_POSITIVE' THEN 'fixed' END AS root_cause_action, CASE WHEN entity_id % 10 <> 4 THEN declared_s END AS investigation_duration_sec FROM c WHERE entity_id % 10 <> 3", "entity_id % 10 <> 3"),
    "escalation": ("SELECT entity_id, case_id, CASE WHEN entity_id % 4 <> 1 THEN closed_s END AS acknowledged_ts FROM c WHERE escalated AND entity_id % 10 NOT IN (3, 6)", "entity_id % 10 <> 3"),
    "case_event": ("SELECT entity_id, closed_s AS ts, 'closed' AS event_type FROM c WHERE closed_s IS NOT NULL AND entity_id % 9 <> 4", "entity_id % 9 <> 4"),
    "alert_record": ("SELECT entity_id, event_s AS event_ts, CASE WHEN entity_id % 7 <> 2 THEN category END AS mitre_tactic, CASE WHEN entity_id % 7 <> 3 THEN category END AS mitre_technique_id, asset_id AS destination_asset_id FROM alerts", "TRUE"),
    "telemetry_daily": ("SELECT entity_id FROM alerts WHERE category = 'view' AND entity_id % 8 <> 1", "entity_id % 8 <> 1"),
    "asset": ("SELECT entity_id, asset_id FROM alerts WHERE entity_id % 12 <> 5", "TRUE"),
    "note_store": ("SELECT entity_id, length(text) AS length, text AS redacted_text FROM c JOIN documents ON note_ref = doc_id WHERE entity_id % 11 <> 2", "TRUE"),
    "submission": ("SELECT entity_id, CASE WHEN entity_id % 6 <> 0 THEN 1 END AS declared_kpis, CASE WHEN entity_id % 15 <> 7 THEN 1 END AS second FROM c", "TRUE"),
    "record_version": ("SELECT o_custkey % 100 AS entity_id FROM orders", "TRUE"),
    "alert_case": ("SELECT l_suppkey AS entity_id FROM lineitem SEMI JOIN c ON c.entity_id = l_suppkey AND c.case_id = l_orderkey || '-' || l_linenumber WHERE l_linenumber = 2", "TRUE"),
    "entity": ("SELECT entity_id, CASE WHEN entity_id % 3 <> 0 THEN 1 END AS roster_ref FROM entities", "TRUE"),
}
COLUMNS = {
    "case_record": ["created_at", "closed_at", "severity_norm", "disposition", "root_cause_action", "investigation_duration_sec"], "escalation": ["case_id", "acknowledged_ts"], "case_event": ["ts", "event_type"],
    "alert_record": ["event_ts", "mitre_tactic", "mitre_technique_id", "destination_asset_id"], "telemetry_daily": [], "asset": [], "note_store": ["length", "redacted_text"],
    "submission": ["declared_kpis", "second"], "record_version": [], "alert_case": [], "entity": ["roster_ref"],
}


def _fields_sql() -> str:
    parts = []
    for t, (rows, declared) in TABLES_SQL.items():
        for col in ["*", *COLUMNS[t]]:
            parts.append(f"SELECT e.entity_id, '{t}' AS tbl, '{col}' AS col, count(x.entity_id) AS n_rows, count({'x.entity_id' if col == '*' else 'x.' + col}) AS n_present, any_value(e.{declared if declared != 'TRUE' else 'entity_id IS NOT NULL'}) AS declared FROM entities e LEFT JOIN ({rows}) x ON x.entity_id = e.entity_id GROUP BY e.entity_id")
    states = "CASE WHEN NOT declared THEN 'never_submitted' WHEN n_rows = 0 THEN 'no_rows' WHEN n_present = 0 THEN 'empty_column' ELSE 'present' END"
    return f"{a.ENTITIES}, {c.YEAR}, {a.ALERTS}, fl AS ({' UNION ALL '.join(parts)}), fs AS (SELECT *, {states} AS state FROM fl), ti AS (SELECT entity_id, CASE WHEN max(CASE WHEN tbl = 'case_record' THEN n_rows ELSE 0 END) > 0 AND max(CASE WHEN tbl = 'alert_record' THEN n_rows ELSE 0 END) > 0 THEN 'A' WHEN max(CASE WHEN tbl IN ('case_record', 'case_event', 'escalation') THEN n_rows ELSE 0 END) > 0 THEN 'B' ELSE 'C' END AS tier FROM fl GROUP BY entity_id)"


FIELDS = _fields_sql()


def evidence_tables(spark: SparkSession, sf_dir: str, cases: DataFrame) -> dict[str, tuple]:
    al, e = a.alerts(spark, sf_dir), F.col("entity_id")
    unless = lambda bad, x: F.when(~bad, x)
    li = shared.among(a.table(spark, sf_dir, "lineitem"), "l_orderkey", a.orders_of(spark, sf_dir, *c.YEAR_DAYS), "o_orderkey")  # other links lead to no case of the year
    li = li.filter("l_linenumber = 2").select(F.col("l_suppkey").alias("entity_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("case_id"))
    length = F.col("note_chars")  # a note is there where it has a length; its text stays where it lies
    stored = c.notes(spark, sf_dir).select("note_ref", length.alias("length"), length.alias("redacted_text"))
    rows = {
        "case_record": cases.filter(e % 10 != 3).select("entity_id", F.col("created_s").alias("created_at"), unless(e % 10 == 4, F.col("closed_s")).alias("closed_at"), F.col("severity").alias("severity_norm"), unless(e % 10 == 5, F.col("disposition")).alias("disposition"), F.when((e % 2 == 0) & (F.col("disposition") == "TRUE_POSITIVE"), "fixed").alias("root_cause_action"), unless(e % 10 == 4, F.col("declared_s")).alias("investigation_duration_sec")),
        "escalation": cases.filter(F.col("escalated") & ~(e % 10).isin(3, 6)).select("entity_id", "case_id", unless(e % 4 == 1, F.col("closed_s")).alias("acknowledged_ts")),
        "case_event": cases.filter(F.col("closed_s").isNotNull() & (e % 9 != 4)).select("entity_id", F.col("closed_s").alias("ts"), F.lit("closed").alias("event_type")),
        "alert_record": al.select("entity_id", F.col("event_s").alias("event_ts"), unless(e % 7 == 2, F.col("category")).alias("mitre_tactic"), unless(e % 7 == 3, F.col("category")).alias("mitre_technique_id"), F.col("asset_id").alias("destination_asset_id")),
        "telemetry_daily": al.filter((F.col("category") == "view") & (e % 8 != 1)).select("entity_id"),
        "asset": al.filter(e % 12 != 5).select("entity_id"),
        "note_store": cases.filter(e % 11 != 2).select("entity_id", "note_ref").join(stored, "note_ref").drop("note_ref"),
        "submission": cases.select("entity_id", F.when(e % 6 != 0, 1).alias("declared_kpis"), F.when(e % 15 != 7, 1).alias("second")),
        "record_version": a.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("entity_id")),
        "alert_case": li.join(cases.filter(F.col("case_id").endswith("-2")).select("entity_id", "case_id"), ["entity_id", "case_id"], "left_semi").select("entity_id"),
        "entity": a.entities(spark, sf_dir).select("entity_id", F.when(e % 3 != 0, 1).alias("roster_ref")),
    }
    declared = {"case_record": e % 10 != 3, "escalation": e % 10 != 3, "case_event": e % 9 != 4, "telemetry_daily": e % 8 != 1}
    return {t: (r, COLUMNS[t], declared.get(t, F.lit(True))) for t, r in rows.items()}


def fields(spark: SparkSession, sf_dir: str, cases: DataFrame | None = None) -> DataFrame:
    cases = cases if cases is not None else c.kept_cases(spark, sf_dir)
    return shared.kept(assess.presence(a.entities(spark, sf_dir), evidence_tables(spark, sf_dir, cases)))


@query(f"WITH {FIELDS} SELECT entity_id, tbl, col, n_rows, n_present, state FROM fs")
def field_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every entity, table and column: present, empty, without rows, or never submitted."""
    return fields(spark, sf_dir).select("entity_id", "tbl", "col", "n_rows", "n_present", assess.field_state().alias("state"))


@query(f"WITH {FIELDS} SELECT entity_id, tier FROM ti")
def achieved_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.achieved_tier(fields(spark, sf_dir))


@query(f"WITH {FIELDS} SELECT entity_id, n_rows AS n_links FROM fl WHERE tbl = 'alert_case'")
def bridge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the bridge table whose case of the same entity lies in the period."""
    return fields(spark, sf_dir).filter("tbl = 'alert_case'").select("entity_id", F.col("n_rows").alias("n_links"))


@query(f"WITH {FIELDS} SELECT entity_id, max(CASE WHEN tbl = 'asset' THEN n_rows END) AS assets, max(CASE WHEN tbl = 'note_store' AND col = '*' THEN n_rows END) AS notes, max(CASE WHEN tbl = 'record_version' THEN n_rows END) AS versions, max(CASE WHEN col = 'roster_ref' THEN n_present END) = 1 AS has_roster, max(CASE WHEN col = 'declared_kpis' THEN n_present END) > 0 AS has_kpis, count(DISTINCT CASE WHEN declared THEN tbl END) AS n_declared FROM fl GROUP BY entity_id")
def state_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is on record about each entity beside its evidence rows."""
    most = lambda cond, x: F.max(F.when(cond, F.col(x)))
    t, col = F.col("tbl"), F.col("col")
    return fields(spark, sf_dir).groupBy("entity_id").agg(most(t == "asset", "n_rows").alias("assets"), most((t == "note_store") & (col == "*"), "n_rows").alias("notes"), most(t == "record_version", "n_rows").alias("versions"), (most(col == "roster_ref", "n_present") == 1).alias("has_roster"), (most(col == "declared_kpis", "n_present") > 0).alias("has_kpis"), F.countDistinct(F.when(F.col("declared"), t)).alias("n_declared"))


_RQ = "rq AS (SELECT * FROM (VALUES " + ", ".join(map(str, NEEDS)) + ") AS t(dimension, min_tier, kind, tbl, col))"
DIMS = f"{FIELDS}, {_RQ}, dg AS (SELECT entity_id, dimension, min_tier, bool_or(state <> 'present' AND kind = 'required') AS blocked, bool_or(state <> 'present' AND kind <> 'required') AS lowered, array_to_string(list_sort(list_distinct(list(CASE WHEN state <> 'present' THEN CASE WHEN col = '*' THEN tbl ELSE tbl || '.' || col END END))), ',') AS missing, list_sort(list_distinct(list(CASE WHEN state <> 'present' THEN tbl END))) AS tables FROM fs JOIN rq USING (tbl, col) GROUP BY ALL), dd AS (SELECT entity_id, dimension, CASE WHEN blocked THEN 'NOT_ASSESSABLE' WHEN lowered OR tier > min_tier THEN 'PARTIAL' ELSE 'ASSESSABLE' END AS state, missing, tier, CASE WHEN len(tables) > 0 THEN tables ELSE ['submission'] END AS tables FROM dg JOIN ti USING (entity_id))"


def dimension_rows(spark: SparkSession, found: DataFrame) -> DataFrame:
    requirements = spark.createDataFrame(NEEDS, "dimension string, min_tier string, kind string, tbl string, col string")
    return assess.resolved(found, requirements, assess.achieved_tier(found))


@query(f"WITH {DIMS} SELECT entity_id, dimension, state, missing, tier FROM dd")
def dimension_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each entity's evidence can support, by dimension, from the table of requirements."""
    return dimension_rows(spark, fields(spark, sf_dir)).drop("tables")


@query(f"WITH {DIMS}, n AS (SELECT entity_id, count(*) FILTER (state = 'ASSESSABLE') AS f, count(*) FILTER (state = 'PARTIAL') AS p, count(*) FILTER (state = 'NOT_ASSESSABLE') AS z FROM dd GROUP BY entity_id) SELECT entity_id, f AS n_full, p AS n_partial, z AS n_none, CASE WHEN p = 0 AND z = 0 THEN 'ASSESSABLE' WHEN f = 0 AND p = 0 THEN 'NOT_ASSESSABLE' WHEN p >= f THEN 'PARTIAL' ELSE 'ASSESSABLE' END AS overall FROM n")
def overall_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("state") == s, 1))
    rows = dimension_rows(spark, fields(spark, sf_dir)).groupBy("entity_id").agg(n("ASSESSABLE").alias("n_full"), n("PARTIAL").alias("n_partial"), n("NOT_ASSESSABLE").alias("n_none"))
    full, part, none = F.col("n_full"), F.col("n_partial"), F.col("n_none")
    return rows.withColumn("overall", F.when((part == 0) & (none == 0), "ASSESSABLE").when((full == 0) & (part == 0), "NOT_ASSESSABLE").when(part >= full, "PARTIAL").otherwise("ASSESSABLE"))


@query(f"WITH {DIMS}, g AS (SELECT entity_id, array_to_string(tables, ',') AS provide, array_to_string(list_sort(list(dimension)), ',') AS enables, count(*) AS impact FROM dd WHERE state <> 'ASSESSABLE' GROUP BY entity_id, tables) SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY impact DESC, provide) AS place FROM g")
def upgrade_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which exports an entity should add, by the dimensions that they enable."""
    g = dimension_rows(spark, fields(spark, sf_dir)).filter("state <> 'ASSESSABLE'").groupBy("entity_id", F.array_join("tables", ",").alias("provide")).agg(F.array_join(F.sort_array(F.collect_list("dimension")), ",").alias("enables"), F.count("*").alias("impact"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("impact"), "provide")))


# --- gated results ---

_NS04 = "SELECT entity_id, avg(CASE WHEN o.k IS NULL THEN 1 ELSE 0 END) AS value, count(*) AS n FROM alerts LEFT JOIN (SELECT o_orderkey AS k FROM orders) o ON case_no = o.k GROUP BY entity_id"
_EG11 = "SELECT o_custkey % 100 AS entity_id, avg(CASE WHEN o_orderkey % 10 = 0 AND o_orderpriority <> 'X' THEN 1 ELSE 0 END) AS value, count(*) AS n FROM orders GROUP BY 1"
_ALL_VALUES = {**c.VALUES, "eg11": _EG11, "ns04": _NS04}
SIGNS = {**c.SIGNS, "eg11": 1, "ns04": 1}
_EVIDENCE = c.ORACLE_SQL["evidence_hashes"]
_EVIDENCE_R = _EVIDENCE[_EVIDENCE.index("e AS (SELECT DISTINCT") : _EVIDENCE.rindex("SELECT indicator, entity_id, count(*)")].strip().replace("e AS (SELECT DISTINCT", "esc AS (SELECT DISTINCT", 1).replace("ANTI JOIN e USING", "ANTI JOIN esc USING").replace(" r AS (", " er AS (", 1)


def _results_sql() -> str:
    parts, rows = [], []
    for name, sign in SIGNS.items():
        sql = c.peer_sql(_ALL_VALUES[name], sign)
        for t in "vpmdse":
            sql = sql.replace(f"{t} AS (", f"{t}_{name} AS (", 1)
        for old, new in (("FROM v a JOIN v b", f"FROM v_{name} a JOIN v_{name} b"), ("FROM p GROUP", f"FROM p_{name} GROUP"), ("FROM p JOIN m", f"FROM p_{name} JOIN m_{name}"), ("FROM m JOIN d", f"FROM m_{name} JOIN d_{name}"), ("FROM s)", f"FROM s_{name})")):
            sql = sql.replace(old, new)
        parts.append(sql)
        rows.append(f"SELECT v.entity_id, '{name}' AS indicator, v.value, v.n, floor(x.effect * 10000 + 0.5) / 10000 AS effect FROM v_{name} v LEFT JOIN e_{name} x USING (entity_id)")
    specs = "sp AS (SELECT * FROM (VALUES " + ", ".join(map(str, SPECS)) + ") AS t(indicator, family, dimension, min_tier))"
    needs = "nd AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{t}', '{col}', {str(d).upper()})" for i, t, col, d in INDICATOR_NEEDS) + ") AS t(indicator, tbl, col, bad))"
    gates = "ga AS (SELECT entity_id, indicator, CASE WHEN count(*) FILTER (state <> 'present') = 0 THEN 'ASSESSABLE' WHEN count(*) FILTER (state <> 'present') = count(*) OR bool_or(bad AND state <> 'present') THEN 'NOT_ASSESSABLE' ELSE 'PARTIAL' END AS presence, array_to_string(list_sort(list(CASE WHEN state <> 'present' THEN tbl || '.' || col END) FILTER (state <> 'present')), ',') AS missing FROM fs JOIN nd USING (tbl, col) GROUP BY ALL)"
    trust = "tr AS (SELECT entity_id, CASE WHEN entity_id % 13 <> 0 THEN round((5 + entity_id % 95) / 100, 2) END AS dq FROM entities)"
    joined = "rj AS (SELECT ti.entity_id, sp.*, coalesce(missing, CASE WHEN ga.presence IS NOT NULL THEN '' END) AS missing, dq, w.value, coalesce(w.n, 0) AS n, w.effect, coalesce(q.k, 0) AS k, CASE WHEN tier > min_tier THEN 'NOT_ASSESSABLE' ELSE coalesce(presence, 'ASSESSABLE') END AS state FROM ti CROSS JOIN sp LEFT JOIN ga USING (entity_id, indicator) LEFT JOIN tr USING (entity_id) LEFT JOIN wv w USING (entity_id, indicator) LEFT JOIN (SELECT entity_id, indicator, count(*) AS k FROM er GROUP BY ALL) q USING (entity_id, indicator))"
    out = "rs AS (SELECT entity_id, indicator, family, dimension, state, CASE WHEN state <> 'NOT_ASSESSABLE' THEN coalesce(value, 0) END AS value, CASE WHEN state <> 'NOT_ASSESSABLE' THEN n END AS n, CASE WHEN state <> 'NOT_ASSESSABLE' THEN effect END AS effect, CASE WHEN state <> 'NOT_ASSESSABLE' THEN round(least(1.0, n / 30) * CASE WHEN state = 'ASSESSABLE' AND dq IS NOT NULL THEN 1.0 ELSE 0.5 END * coalesce(dq, 0.5), 6) END AS confidence, CASE WHEN state <> 'NOT_ASSESSABLE' THEN k = 0 END AS lead, missing, dq FROM rj)"
    return f"{DIMS}, {', '.join(parts)}, wv AS ({' UNION ALL '.join(rows)}), {_EVIDENCE_R}, {specs}, {needs}, {gates}, {trust}, {joined}, {out}"


RESULTS = _results_sql()


def gates(spark: SparkSession, found: DataFrame) -> DataFrame:
    return assess.gated(found, spark.createDataFrame(INDICATOR_NEEDS, "indicator string, tbl string, col string, disqualifies boolean"))


def results(spark: SparkSession, sf_dir: str, found: DataFrame | None = None, cases: DataFrame | None = None) -> DataFrame:
    """Results from the fields and the year's cases, where these are at hand; cases are joined once for all parts."""
    cases = cases if cases is not None else c.kept_cases(spark, sf_dir)
    found = found if found is not None else fields(spark, sf_dir, cases)
    small = {"lengths": c.notes(spark, sf_dir), "periods": c.boundaries(spark, sf_dir)}
    values = c.indicator_values(spark, sf_dir, cases=cases, **small)
    al = a.alerts(spark, sf_dir)
    known = shared.among(a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_no")), "case_no", al, "case_no", small=0)  # orders that some alert names
    values |= {"eg11": ind.eg11(c.versions(spark, sf_dir)), "ns04": ind.ns04(al, known)}
    long = reduce(DataFrame.unionByName, (values[k].select("entity_id", "value", "n", F.lit(k).alias("indicator"), F.lit(s).alias("sign"), F.col("n_evidence") if "n_evidence" in values[k].columns else F.lit(None).cast("long").alias("n_evidence")) for k, s in SIGNS.items()))
    entities = a.entities(spark, sf_dir)
    based = stats.peer_baseline(shared.kept(long.join(entities.select("entity_id", "cohort"), "entity_id")), by=["indicator"])
    measured = based.select("entity_id", "indicator", "value", "n", "n_evidence", c.four_digits("effect").alias("effect"))  # each value has counted the rows behind it
    trust = entities.select("entity_id", F.when(F.col("entity_id") % 13 != 0, F.round((5 + F.col("entity_id") % 95) / 100, 2)).alias("dq_score"))
    specs = spark.createDataFrame(SPECS, "indicator string, family string, dimension string, min_tier string")
    return shared.kept(assess.assembled(entities, measured, gates(spark, found), assess.achieved_tier(found), trust, specs))


@query(f"WITH {RESULTS} SELECT entity_id, indicator, presence, coalesce(missing, '') AS missing FROM ga")
def indicator_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each entity's evidence lets an indicator be measured, and what is missing."""
    return gates(spark, fields(spark, sf_dir))


@query(f"WITH {RESULTS} SELECT entity_id, indicator, state, round(value, 5) AS value, n, effect, confidence, lead, missing FROM rs")
def assembled_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every indicator of every entity: not assessable without a value, zero where the population is empty."""
    return results(spark, sf_dir).select("entity_id", "indicator", "state", F.round("value", 5).alias("value"), "n", "effect", "confidence", "lead", "missing")


TRUST = f"{RESULTS}, dt AS (SELECT entity_id, round(0.5 * any_value(dq) + 0.5 * avg(CASE WHEN value IS NULL THEN 0 ELSE 1 END), 6) AS dts FROM rs GROUP BY entity_id), rd AS (SELECT rs.* EXCLUDE (confidence), dts, CASE WHEN dts < 0.2 THEN confidence * dts / 0.2 ELSE confidence END AS confidence FROM rs JOIN dt USING (entity_id)), ad AS (SELECT * FROM rd WHERE value IS NOT NULL AND effect IS NOT NULL)"


@query(f"WITH {TRUST} SELECT entity_id, dts FROM dt")
def data_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.data_trust(results(spark, sf_dir))


def admitted(found: DataFrame) -> DataFrame:
    """Signals that can be scored: with a value and an effect, after damping."""
    return assess.damped(found, assess.data_trust(found)).filter("value is not null and effect is not null")


@query(f"WITH {TRUST} SELECT entity_id, indicator, effect, round(confidence, 6) AS confidence FROM ad")
def admitted_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admitted(results(spark, sf_dir)).select("entity_id", "indicator", "effect", F.round("confidence", 6).alias("confidence"))


def _bh_quantiles(most: int) -> str:
    from statistics import NormalDist

    return " UNION ALL ".join(f"SELECT {n} AS nt, {i} AS i, {NormalDist().inv_cdf(1 - 0.05 * i / (2 * n))!r} AS z" for n in range(1, most + 1) for i in range(1, n + 1))


_RAMP = "greatest(0.0, least(1.0, (effect - 2.0) / 3.0))"
SCORES = f"""{TRUST}, qq AS ({_bh_quantiles(7)}), r1 AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY abs(effect) DESC, indicator) AS i, count(*) OVER (PARTITION BY entity_id) AS nt FROM ad),
 sg AS (SELECT r1.*, coalesce(r1.i <= max(CASE WHEN abs(effect) >= z THEN r1.i END) OVER (PARTITION BY entity_id), FALSE) AS survives FROM r1 JOIN qq ON r1.nt = qq.nt AND r1.i = qq.i),
 fw AS (SELECT * FROM (VALUES {', '.join(map(str, FAMILIES))}) AS t(family, w, part)), dw AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in WEIGHTS.items())}) AS t(dimension, w)),
 fm AS (SELECT entity_id, dimension, family, max(CASE WHEN survives THEN {_RAMP} * confidence ELSE 0.0 END) AS s FROM sg GROUP BY ALL), fo AS (SELECT fm.*, w, part FROM fm JOIN fw USING (family) JOIN dd USING (entity_id, dimension) WHERE dd.state <> 'NOT_ASSESSABLE'),
 sc AS (SELECT entity_id, dimension, round(1 - exp(sum(ln(1 - w * least(s, 0.6)))), 6) AS score FROM fo GROUP BY ALL), sn AS (SELECT entity_id, least(0.25, 0.05 * coalesce(max(CASE WHEN survives AND effect <> 0 THEN abs(effect) / sqrt(greatest(1.0, confidence * 30)) END), 0)) AS span FROM sg GROUP BY entity_id),
 ds AS (SELECT dd.entity_id, dd.dimension, dd.state, score, round(greatest(0, score - coalesce(span, 0)), 6) AS low, round(least(1, score + coalesce(span, 0)), 6) AS high FROM dd LEFT JOIN sc USING (entity_id, dimension) LEFT JOIN sn USING (entity_id)),
 pt AS (SELECT entity_id, family, part, w, max(s) AS s FROM fo GROUP BY ALL), ix AS (SELECT entity_id, round(1 - exp(sum(ln(1 - w * least(s, 0.6))) FILTER (part = 'egi')), 6) AS egi, round(1 - exp(sum(ln(1 - w * least(s, 0.6))) FILTER (part = 'nsi')), 6) AS nsi FROM pt GROUP BY entity_id),
 wh AS (SELECT entity_id, round(sum(w * h * score) / sum(CASE WHEN score IS NOT NULL THEN w * h END), 6) AS sap, round(coalesce(sum(CASE WHEN score IS NOT NULL THEN w END), 0) / sum(w), 6) AS measurable, count(score) AS nm, count(*) AS na, count(*) FILTER (state = 'ASSESSABLE') AS nf, coalesce(array_to_string(list_sort(list(dimension) FILTER (score IS NULL)), ','), '') AS unscored FROM (SELECT *, CASE WHEN state = 'PARTIAL' THEN 0.5 ELSE 1.0 END AS h FROM ds JOIN dw USING (dimension)) GROUP BY entity_id),
 cd AS (SELECT entity_id, sap, measurable, egi, nsi, dts, CASE WHEN nm = 0 THEN 'NOT_ASSESSABLE' WHEN nm = na AND nf = na THEN 'ASSESSABLE' ELSE 'PARTIAL' END AS overall, CASE WHEN sap IS NULL OR measurable < 0.5 THEN 'not_assessable' WHEN sap >= 0.75 THEN 'T1' WHEN sap >= 0.5 THEN 'T2' WHEN sap >= 0.25 THEN 'T3' ELSE 'T4' END AS tier, array_to_string(list_filter([CASE WHEN dts IS NULL THEN 'no data quality on record' END, CASE WHEN dts < 0.2 THEN 'data trust below the floor' END, CASE WHEN unscored <> '' THEN 'not scored: ' || unscored END], lambda x: x IS NOT NULL), '; ') AS caveats FROM wh LEFT JOIN ix USING (entity_id) LEFT JOIN dt USING (entity_id))"""


def assessed(spark: SparkSession, sf_dir: str, cases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fields, results) of the year's cases, joined once."""
    cases = cases if cases is not None else c.kept_cases(spark, sf_dir)
    found = fields(spark, sf_dir, cases)
    return found, results(spark, sf_dir, found, cases)


def scored(spark: SparkSession, sf_dir: str, found: DataFrame | None = None, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signals, dimension scores, scorecards), from fields and results where both are at hand."""
    if found is None or rows is None:
        found, rows = assessed(spark, sf_dir)
    signals = shared.kept(scoring.false_discovery(admitted(rows)))
    families = spark.createDataFrame(FAMILIES, "family string, w double, part string")
    weights = spark.createDataFrame(list(WEIGHTS.items()), "dimension string, w double")
    dims, cards = assess.scorecards(signals, shared.kept(dimension_rows(spark, found)), assess.data_trust(rows), families, weights)
    return signals, dims, cards


@query(f"WITH {SCORES} SELECT entity_id, dimension, state, round(score, 5) AS score, round(low, 4) AS low, round(high, 4) AS high FROM ds")
def dimension_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension scores with their spread; what cannot be assessed has none."""
    return spread_scores(spark, sf_dir)


def spread_scores(spark: SparkSession, sf_dir: str, cases: DataFrame | None = None) -> DataFrame:
    return scored(spark, sf_dir, *assessed(spark, sf_dir, cases))[1].select("entity_id", "dimension", "state", F.round("score", 5).alias("score"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


def ranked(cards: DataFrame) -> DataFrame:
    """Competition ranks by priority; entities without one are not ranked. Ranks come from counts by distinct value."""
    counts = cards.filter("sap is not null").groupBy("sap").agg(F.count("*").alias("k"))
    place = counts.withColumn("rank", (F.coalesce(F.sum("k").over(Window.orderBy(F.desc("sap")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).cast("long")).drop("k")
    return cards.join(place, "sap", "left")


@query(f"WITH {SCORES} SELECT entity_id, round(egi, 5) AS egi, round(nsi, 5) AS nsi, dts, round(sap, 5) AS sap, measurable, overall, tier, CASE WHEN sap IS NOT NULL THEN rank() OVER (ORDER BY sap DESC NULLS LAST) END AS rank, caveats FROM cd")
def scorecards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both indexes, trust, priority, tier and rank of every entity, and what could not be seen."""
    r5 = lambda x: F.round(x, 5).alias(x)
    return ranked(scored(spark, sf_dir)[2]).select("entity_id", r5("egi"), r5("nsi"), "dts", r5("sap"), "measurable", "overall", "tier", "rank", "caveats")


@query(f"WITH {SCORES}, u AS (SELECT DISTINCT entity_id FROM c WHERE entity_id % 5 <> 0) SELECT entity_id, CASE WHEN sap IS NOT NULL THEN rank() OVER (ORDER BY sap DESC NULLS LAST) END AS rank, tier FROM cd SEMI JOIN u USING (entity_id) QUALIFY entity_id % 4 = 1")
def ranked_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose submissions overlap the period are ranked together; the answer is filtered after ranking."""
    cases = c.kept_cases(spark, sf_dir)
    universe = cases.filter("entity_id % 5 <> 0").select("entity_id").distinct()
    return ranked(scored(spark, sf_dir, *assessed(spark, sf_dir, cases))[2].join(universe, "entity_id", "left_semi")).filter("entity_id % 4 = 1").select("entity_id", "rank", "tier")


def statuses(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """One row per entity and indicator: its value, whether it raised a finding, and if not, why."""
    rows = rows if rows is not None else results(spark, sf_dir)
    s = scoring.false_discovery(admitted(rows)).select("entity_id", "indicator", "survives", F.col("confidence").alias("c"))
    j = rows.join(s, ["entity_id", "indicator"], "left")
    adverse = F.coalesce(scoring.ramp(F.col("effect")) > 0, F.lit(False))
    raised = adverse & F.coalesce("survives", F.lit(False))
    why = F.when(F.col("value").isNull(), "not computable").when(F.col("effect").isNull(), "not comparable").when(raised, "raised").when(adverse, "suppressed").otherwise("quiet")
    return j.select("entity_id", "indicator", "family", "dimension", "state", "value", "effect", "n", F.coalesce("c", "confidence").alias("confidence"), raised.alias("raised"), why.alias("status"), "lead", "missing")


STATUS = f"{SCORES}, st AS (SELECT rs.entity_id, rs.indicator, rs.family, rs.dimension, rs.state, rs.value, rs.effect, rs.n, coalesce(sg.confidence, rs.confidence) AS confidence, coalesce(survives AND rs.effect > 2, FALSE) AS raised, CASE WHEN rs.value IS NULL THEN 'not computable' WHEN rs.effect IS NULL THEN 'not comparable' WHEN survives AND rs.effect > 2 THEN 'raised' WHEN rs.effect > 2 THEN 'suppressed' ELSE 'quiet' END AS status, rs.lead, rs.missing FROM rs LEFT JOIN sg USING (entity_id, indicator))"


@query(f"WITH {STATUS} SELECT entity_id, indicator, state, effect, raised, status FROM st")
def indicator_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of every indicator of every entity, findings or not."""
    return statuses(spark, sf_dir).select("entity_id", "indicator", "state", "effect", "raised", "status")


@query(f"WITH {STATUS}, f AS (SELECT * FROM st WHERE raised) SELECT f.entity_id, f.indicator, count(*) FILTER (st.status = 'raised') AS n_raised, count(*) FILTER (st.status = 'quiet') AS n_quiet, count(*) FILTER (st.status = 'suppressed') AS n_suppressed, count(*) FILTER (st.status = 'not comparable') AS n_not_comparable, count(*) FILTER (st.status = 'not computable') AS n_not_computable FROM f JOIN st ON st.entity_id = f.entity_id AND st.indicator <> f.indicator GROUP BY ALL")
def why_not_flagged_by_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each finding, what became of the entity's other indicators."""
    st = shared.kept(statuses(spark, sf_dir))
    f = st.filter("raised").select("entity_id", F.col("indicator").alias("_i"))
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias("n_" + s.replace(" ", "_"))
    rows = f.join(st, "entity_id").filter(F.col("indicator") != F.col("_i")).groupBy("entity_id", F.col("_i").alias("indicator"))
    return rows.agg(n("raised"), n("quiet"), n("suppressed"), n("not comparable"), n("not computable"))


@query(f"WITH {STATUS} SELECT entity_id, indicator, effect, round(confidence, 5) AS confidence, row_number() OVER (ORDER BY effect DESC NULLS LAST, entity_id, indicator) AS place, round(sap, 5) AS sap FROM st LEFT JOIN cd USING (entity_id) WHERE raised AND NOT lead")
def findings_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that are no mere leads, strongest first, with the entity's priority."""
    found, base = assessed(spark, sf_dir)
    cards = scored(spark, sf_dir, found, base)[2].select("entity_id", F.round("sap", 5).alias("sap"))
    rows = statuses(spark, sf_dir, base).filter("raised and not lead").select("entity_id", "indicator", "effect", F.round("confidence", 5).alias("confidence")).join(cards, "entity_id", "left")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("effect"), "entity_id", "indicator")))  # findings only


@query(f"WITH {STATUS} SELECT cd.entity_id, tier, round(sap, 5) AS sap, count(st.indicator) FILTER (raised) AS n_findings, count(st.indicator) FILTER (status = 'not computable') AS n_unmeasured, (SELECT count(*) FROM ds WHERE ds.entity_id = cd.entity_id AND score IS NOT NULL) AS n_dimensions FROM cd JOIN st USING (entity_id) GROUP BY ALL")
def entity_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, dimensions and finding counts of each entity in one row."""
    found, base = assessed(spark, sf_dir)
    _, dims, cards = scored(spark, sf_dir, found, base)
    counts = statuses(spark, sf_dir, base).groupBy("entity_id").agg(F.count(F.when(F.col("raised"), 1)).alias("n_findings"), F.count(F.when(F.col("status") == "not computable", 1)).alias("n_unmeasured"))
    per = dims.groupBy("entity_id").agg(F.count("score").alias("n_dimensions"))
    return cards.select("entity_id", "tier", F.round("sap", 5).alias("sap")).join(counts, "entity_id").join(per, "entity_id")


@query(f"WITH {STATUS} SELECT entity_id, metric, round(value, 5) AS value FROM (SELECT entity_id, unnest(['egi', 'nsi', 'dts', 'sap']) AS metric, unnest([egi, nsi, dts, sap]) AS value FROM cd) WHERE value IS NOT NULL")
def metric_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's metrics in long form; those that could not be computed are left out."""
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.round(m, 5).alias("value")) for m in ("egi", "nsi", "dts", "sap")))
    return scored(spark, sf_dir)[2].select("entity_id", F.inline(rows)).filter("value is not null")
