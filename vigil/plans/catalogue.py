"""All registered queries of the supervisory engine, with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions import scalars, stats
from vigil.operators import indicators as ind
from vigil.operators import anomaly, intake, privacy, sampling, scoring, text, trends
from vigil.operators.sequences import Ordered
from vigil.plans import adapters as a
from vigil.plans import shared
from vigil.policy import DEFAULT
from vigil.sources import files
from vigil.streaming import incremental

QUERIES: dict = {}
ORACLE_SQL: dict = {}
KEY, KEY_REF = b"example-key", "k1"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


YEAR_DAYS = ("1996-01-01", "1996-12-31")


def year_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.cases(spark, sf_dir, *YEAR_DAYS)


def kept_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year's cases, joined once and written: a query hands them to all parts that read cases."""
    return shared.kept(year_cases(spark, sf_dir))


YEAR = a.CASES + ", c AS (SELECT *, CASE WHEN declared_s >= 0 THEN declared_s WHEN closed_s - created_s >= 0 THEN closed_s - created_s END AS d FROM cases WHERE created_s >= epoch(TIMESTAMP '1996-01-01') AND created_s < epoch(TIMESTAMP '1997-01-01'))"
VALUES = {
    "eg01": "SELECT entity_id, median(d) AS value, count(*) AS n FROM c WHERE severity IN ('HIGH', 'CRITICAL') AND closed_s IS NOT NULL AND d IS NOT NULL GROUP BY entity_id",
    "eg02": "SELECT entity_id, avg(CASE WHEN coalesce(length(text), 0) < 20 THEN 1 ELSE 0 END) AS value, count(*) AS n FROM c LEFT JOIN documents ON note_ref = doc_id WHERE severity IN ('HIGH', 'CRITICAL') AND disposition IN ('FALSE_POSITIVE', 'SUPPRESSED') GROUP BY entity_id",
    "eg06": "SELECT entity_id, avg(CASE WHEN e.case_id IS NULL AND escalation_level IS NULL THEN 1 ELSE 0 END) AS value, count(*) AS n FROM c LEFT JOIN (SELECT DISTINCT entity_id, case_id FROM c WHERE escalated) e USING (entity_id, case_id) WHERE severity = 'CRITICAL' AND closed_s IS NOT NULL GROUP BY entity_id",
    "eg08": "SELECT entity_id, avg(CASE WHEN d BETWEEN 0.9 * sla AND sla THEN 1 ELSE 0 END) AS value, count(*) AS n FROM (SELECT *, CASE severity WHEN 'CRITICAL' THEN 900 WHEN 'HIGH' THEN 3600 WHEN 'MEDIUM' THEN 14400 ELSE 43200 END AS sla FROM c) WHERE closed_s IS NOT NULL AND d IS NOT NULL GROUP BY entity_id",
    "eg09": "SELECT entity_id, avg(CASE WHEN closed_s > b - 172800 AND closed_s <= b THEN 1 ELSE 0 END) / least(1.0, 172800.0 / 31622400) AS value, count(*) AS n FROM (SELECT *, epoch(TIMESTAMP '1997-01-01') AS b FROM c) WHERE closed_s IS NOT NULL GROUP BY entity_id",
}


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of notes, written: joins then plan by the size of the lengths, not of the texts, and no text is read again."""
    return shared.kept(a.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_ref"), F.char_length("text").alias("note_chars")))


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's period, written: a join of tables is planned as their product, so that cases would be shuffled to meet it."""
    stamp = lambda t: F.unix_timestamp(F.lit(t))
    return shared.kept(a.entities(spark, sf_dir).select("entity_id", stamp("1996-01-01 00:00:00").alias("start_s"), stamp("1997-01-01 00:00:00").alias("boundary_s")))


def indicator_values(spark: SparkSession, sf_dir: str, *names: str, cases: DataFrame | None = None, lengths: DataFrame | None = None, periods: DataFrame | None = None) -> dict[str, DataFrame]:
    """Execution-gap indicators (all, or those named; a name that is none of them is an error). Where several are asked for,
    the year's cases are written once and read by each, so evidence is joined and scanned once."""
    unknown = [n for n in names if n not in VALUES]
    if unknown:
        raise ValueError(f"unknown indicators: {', '.join(unknown)}; known: {', '.join(VALUES)}")
    c = cases if cases is not None else year_cases(spark, sf_dir) if len(names) == 1 else kept_cases(spark, sf_dir)
    made = {
        "eg01": lambda: ind.eg01(c), "eg02": lambda: ind.eg02(c, lengths if lengths is not None else notes(spark, sf_dir)), "eg06": lambda: ind.eg06(c, c.filter("escalated")),
        "eg08": lambda: ind.eg08(c), "eg09": lambda: ind.eg09(c, periods if periods is not None else boundaries(spark, sf_dir)),
    }
    return {k: f() for k, f in made.items() if not names or k in names}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("entity_id", F.round("value", 6).alias("value"), "n")


def _value_query(name: str):
    def f(spark, sf_dir):
        return _rounded(indicator_values(spark, sf_dir, name)[name])

    f.__name__ = f"{name}_value"
    query(f"WITH {YEAR} SELECT entity_id, round(value, 6) AS value, n FROM ({VALUES[name]})")(f)


for _name in VALUES:
    _value_query(_name)


def baselined(spark: SparkSession, sf_dir: str, name: str, sign: int) -> DataFrame:
    values = indicator_values(spark, sf_dir, name)[name].join(a.entities(spark, sf_dir), "entity_id").withColumn("sign", F.lit(sign))
    return stats.peer_baseline(shared.kept(values))


def peer_sql(values: str, sign: int) -> str:
    """The leave-one-out baseline by definition."""
    return f"""v AS (SELECT x.*, cohort FROM ({values}) x JOIN entities USING (entity_id)),
 p AS (SELECT a.entity_id, a.value, a.n, a.cohort, b.value AS peer FROM v a JOIN v b ON a.cohort = b.cohort AND a.entity_id <> b.entity_id AND b.value IS NOT NULL),
 m AS (SELECT entity_id, any_value(value) AS value, any_value(n) AS n, any_value(cohort) AS cohort, median(peer) AS med, avg(peer) AS mean, stddev_samp(peer) AS sd, list_aggregate(list_sort(list(peer))[(count(*) + 1) // 2 + 1:], 'median') - list_aggregate(list_sort(list(peer))[1:count(*) // 2], 'median') AS iqr, count(*) AS n_peers, sum(CASE WHEN peer < value THEN 1.0 WHEN peer = value THEN 0.5 ELSE 0 END) AS below FROM p GROUP BY entity_id),
 d AS (SELECT entity_id, median(abs(peer - med)) AS mad FROM p JOIN m USING (entity_id) GROUP BY entity_id),
 s AS (SELECT *, coalesce(CASE WHEN n_peers >= 8 AND mad > 0 THEN 1.4826 * mad END, CASE WHEN iqr > 0 THEN iqr / 1.349 END, CASE WHEN sd > 0 THEN sd END) AS scale FROM m JOIN d USING (entity_id)),
 e AS (SELECT *, round({sign} * ((n * value + 10.0 * mean) / (n + 10.0) - med) / scale, 6) AS effect FROM s)"""


@query(f"WITH {a.ENTITIES}, {YEAR}, {peer_sql(VALUES['eg01'], -1)} SELECT entity_id, cohort, round(value, 4) AS value, n, round(med, 4) AS peer_median, round(mad, 4) AS peer_mad, round(100 * below / n_peers, 4) AS percentile, n_peers, floor(effect * 10000 + 0.5) / 10000 AS effect FROM e")
def eg01_rapid_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by how far their median closure time lies below that of their peers."""
    e = baselined(spark, sf_dir, "eg01", -1).filter("n_peers is not null")
    return e.select("entity_id", "cohort", F.round("value", 4).alias("value"), "n", F.round("median", 4).alias("peer_median"), F.round("mad", 4).alias("peer_mad"), F.round("percentile", 4).alias("percentile"), "n_peers", four_digits("effect").alias("effect"))


SIGNS = {"eg01": -1, "eg02": 1, "eg06": 1, "eg08": 1, "eg09": 1}
FAMILIES = {"eg01": "closure_quality", "eg02": "closure_quality", "eg06": "escalation", "eg08": "timing", "eg09": "timing"}


def baselines(spark: SparkSession, sf_dir: str, cases: DataFrame | None = None) -> DataFrame:
    """All indicators in long form against their peers: value, n, median, mad, percentile, n_peers and effect."""
    values = indicator_values(spark, sf_dir, cases=cases)
    named = [values[k].select("entity_id", "value", "n", F.lit(k).alias("indicator"), F.lit(FAMILIES[k]).alias("family"), F.lit(sign).alias("sign")) for k, sign in SIGNS.items()]
    rows = reduce(DataFrame.unionByName, named).join(a.entities(spark, sf_dir), "entity_id")
    return stats.peer_baseline(shared.kept(rows), by=["indicator"]).filter("effect is not null")


def four_digits(column: str):
    """Rounded by arithmetic: engines round halves of doubles differently, and effects are rounded once before."""
    return F.floor(F.col(column) * 10000 + 0.5) / 10000


def effects(spark: SparkSession, sf_dir: str, cases: DataFrame | None = None) -> DataFrame:
    """All effects with their confidence."""
    out = baselines(spark, sf_dir, cases)
    out = out.select("entity_id", "indicator", "family", four_digits("effect").alias("effect"), F.least(F.lit(1.0), F.col("n") / DEFAULT.full_confidence_n).alias("confidence"))
    return out


def _effects_sql() -> str:
    parts, unions = [], []
    for name, sign in SIGNS.items():
        sql = peer_sql(VALUES[name], sign)
        for t in "vpmdse":
            sql = sql.replace(f"{t} AS (", f"{t}_{name} AS (", 1)
        for pattern, table in (("FROM v a JOIN v b", f"FROM v_{name} a JOIN v_{name} b"), ("FROM p GROUP", f"FROM p_{name} GROUP"), ("FROM p JOIN m", f"FROM p_{name} JOIN m_{name}"), ("FROM m JOIN d", f"FROM m_{name} JOIN d_{name}"), ("FROM s)", f"FROM s_{name})")):
            sql = sql.replace(pattern, table)
        parts.append(sql)
        unions.append(f"SELECT entity_id, '{name}' AS indicator, '{FAMILIES[name]}' AS family, floor(effect * 10000 + 0.5) / 10000 AS effect, least(1.0, n / 30.0) AS confidence FROM e_{name} WHERE effect IS NOT NULL")
    return f"WITH {a.ENTITIES}, {YEAR}, {', '.join(parts)}, l AS ({' UNION ALL '.join(unions)})"


EFFECTS = _effects_sql()


@query(f"{EFFECTS} SELECT entity_id, indicator, family, effect, round(confidence, 4) AS confidence FROM l")
def indicator_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects(spark, sf_dir).withColumn("confidence", F.round("confidence", 4))


def _quantiles() -> str:
    from statistics import NormalDist

    return " UNION ALL ".join(f"SELECT {n} AS nt, {i} AS i, {NormalDist().inv_cdf(1 - DEFAULT.fdr_q * i / (2 * n))!r} AS z" for n in range(1, 6) for i in range(1, n + 1))


FDR = f"{EFFECTS}, q AS ({_quantiles()}), r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY abs(effect) DESC, indicator) AS i, count(*) OVER (PARTITION BY entity_id) AS nt FROM l), f AS (SELECT r.*, coalesce(r.i <= max(CASE WHEN abs(effect) >= z THEN r.i END) OVER (PARTITION BY entity_id), FALSE) AS survives FROM r JOIN q ON r.nt = q.nt AND r.i = q.i)"


@query(f"{FDR} SELECT entity_id, indicator, i, survives FROM f")
def false_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which effects survive Benjamini-Hochberg control per entity."""
    return scoring.false_discovery(effects(spark, sf_dir)).select("entity_id", "indicator", F.col("i").cast("long").alias("i"), "survives")


@query(f"""{FDR}, fam AS (SELECT entity_id, family, max(CASE WHEN survives THEN greatest(0.0, least(1.0, (effect - 2.0) / 3.0)) * confidence ELSE 0.0 END) AS score FROM f GROUP BY ALL),
 idx AS (SELECT entity_id, round(1 - exp(sum(ln(1 - 0.5 * least(score, 0.6)))), 4) AS index, count(*) AS n_families FROM fam GROUP BY entity_id)
 SELECT entity_id, index, n_families, rank() OVER (ORDER BY index DESC) AS rank, CASE WHEN index >= 0.75 THEN 'T1' WHEN index >= 0.5 THEN 'T2' WHEN index >= 0.25 THEN 'T3' ELSE 'T4' END AS tier FROM idx""")
def entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution-gap index of each entity, its rank and tier."""
    return scoring.entity_scores(scoring.false_discovery(effects(spark, sf_dir)))


@query(f"{FDR} SELECT 'F-' || substr(sha256('run1|' || entity_id || '|' || indicator), 1, 24) AS finding_id, entity_id, indicator, effect FROM f WHERE survives AND effect > 2")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with deterministic ids."""
    return raised(spark, sf_dir)


def raised(spark: SparkSession, sf_dir: str, cases: DataFrame | None = None) -> DataFrame:
    rows = scoring.false_discovery(effects(spark, sf_dir, cases)).filter(F.col("survives") & (scoring.ramp(F.col("effect")) > 0))
    return rows.select(F.concat(F.lit("F-"), F.substring(F.sha2(F.concat_ws("|", F.lit("run1"), "entity_id", "indicator"), 256), 1, 24)).alias("finding_id"), "entity_id", "indicator", "effect")


@query(f"WITH {YEAR}, e AS (SELECT DISTINCT entity_id, case_id FROM c WHERE escalated) SELECT entity_id, count(*) AS n_rows, sha256(string_agg(case_id, ',' ORDER BY case_id)) AS ids_hash FROM c ANTI JOIN e USING (entity_id, case_id) WHERE severity = 'CRITICAL' AND closed_s IS NOT NULL AND escalation_level IS NULL GROUP BY entity_id")
def eg06_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows behind EG-06 of each entity, as a count and a hash of their sorted ids."""
    c = year_cases(spark, sf_dir)
    rows = c.filter((F.col("severity") == "CRITICAL") & F.col("closed_s").isNotNull() & F.col("escalation_level").isNull()).join(c.filter("escalated").select("entity_id", "case_id").distinct(), ["entity_id", "case_id"], "left_anti")
    return rows.groupBy("entity_id").agg(F.count("*").alias("n_rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("case_id")), ","), 256).alias("ids_hash"))


@query("WITH v AS (SELECT o_custkey % 100 AS entity_id, o_orderkey AS k, 1 AS s, sha256(o_orderpriority || '|' || o_orderstatus) AS h FROM orders UNION ALL SELECT o_custkey % 100, o_orderkey, 2, sha256((CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderpriority END) || '|' || o_orderstatus) FROM orders), g AS (SELECT entity_id, k, count(DISTINCT h) AS nh, count(DISTINCT s) AS ns FROM v GROUP BY ALL) SELECT entity_id, round(avg(CASE WHEN nh > 1 THEN 1 ELSE 0 END), 6) AS value, count(*) AS n FROM g GROUP BY entity_id HAVING max(ns) >= 2")
def eg11_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of records whose hash changed between two submissions."""
    return _rounded(ind.eg11(versions(spark, sf_dir)))


def grid(spark: SparkSession, sf_dir: str, *keys: str, category: str | None = None) -> DataFrame:
    rows = a.alerts(spark, sf_dir)
    return ind.daily_grid(rows.filter(F.col("category") == category) if category else rows, list(keys))


def grid_sql(keys: str, category: str | None = None) -> str:
    chosen = f" AND event_type = '{category}')" if category else ")"
    return f"{a.ALERTS[:-1]}{chosen}, days AS (SELECT unnest(generate_series((SELECT min(day) FROM alerts), (SELECT max(day) FROM alerts), INTERVAL 1 DAY))::DATE AS day), g AS (SELECT {keys}, day, coalesce(n, 0) AS activity FROM (SELECT DISTINCT {keys} FROM alerts) CROSS JOIN days LEFT JOIN (SELECT {keys}, day, count(*) AS n FROM alerts GROUP BY ALL) USING ({keys}, day))"


@query(f"WITH {grid_sql('entity_id, asset_id, criticality', 'error')}, x AS (SELECT entity_id, asset_id, count(*) AS days, count(*) FILTER (activity = 0) AS silent, avg(activity) AS m, max(criticality) AS c FROM g GROUP BY ALL) SELECT entity_id, round(avg(silent / days), 6) AS value, count(*) AS n FROM x WHERE days >= 3 AND c >= 3 AND silent >= greatest(3, days // 2) AND m > 0 GROUP BY entity_id")
def ns01_silent_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ind.ns01(grid(spark, sf_dir, "entity_id", "asset_id", "criticality", category="error")))


@query(f"WITH {grid_sql('entity_id, category')}, x AS (SELECT *, row_number() OVER (PARTITION BY entity_id, category ORDER BY day DESC) AS back, count(*) OVER (PARTITION BY entity_id, category) AS k FROM g), y AS (SELECT entity_id, category, max(CASE WHEN back <= 2 THEN activity END) = 0 AND median(activity) FILTER (back > 2) > 0 AS gone FROM x WHERE k >= 3 GROUP BY ALL) SELECT entity_id, round(avg(CASE WHEN gone THEN 1 ELSE 0 END), 6) AS value, count(*) AS n FROM y GROUP BY entity_id")
def ns02_absent_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ind.ns02(grid(spark, sf_dir, "entity_id", "category")))


@query(f"WITH {a.ALERTS} SELECT entity_id, round(avg(CASE WHEN o.k IS NULL THEN 1 ELSE 0 END), 6) AS value, count(*) AS n FROM alerts LEFT JOIN (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey < 900) o ON case_no = o.k GROUP BY entity_id")
def ns04_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = a.table(spark, sf_dir, "orders").filter("o_orderkey < 900").select(F.col("o_orderkey").alias("case_no"))
    return _rounded(ind.ns04(a.alerts(spark, sf_dir), known))


@query(f"WITH {grid_sql('entity_id')}, x AS (SELECT entity_id, max_by(activity, day) AS latest, median(activity) AS m, count(*) AS n FROM g GROUP BY entity_id) SELECT entity_id, round(latest / m, 6) AS value, n FROM x WHERE latest < 0.25 * m")
def ns05_low_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ind.ns05(grid(spark, sf_dir, "entity_id")))


@query(f"WITH {grid_sql('entity_id')}, t AS (SELECT day, sum(activity) AS s, count(*) AS k, median(activity) AS m FROM g GROUP BY day), x AS (SELECT entity_id, activity, (s - activity) / (k - 1) AS pm, m FROM g JOIN t USING (day) WHERE k > 3) SELECT entity_id, round(avg(pm - activity), 6) AS value, count(*) AS n FROM x WHERE pm >= greatest(1.0, 1.0 * m) AND activity <= 0.5 * m GROUP BY entity_id")
def ns06_shock_nonresponse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ind.ns06(grid(spark, sf_dir, "entity_id"), surge=1.0))


@query(f"WITH {grid_sql('entity_id, asset_id, criticality')}, x AS (SELECT entity_id, asset_id, count(*) AS days, count(*) FILTER (activity = 0) AS silent, avg(activity) AS m, max(criticality) AS c FROM g GROUP BY ALL) SELECT entity_id, round(avg(silent / days), 6) AS value, count(*) AS n FROM x WHERE days >= 3 AND c >= 3 AND silent >= greatest(3, days // 2) AND m > 0 GROUP BY entity_id")
def ns01_silent_all_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NS-01 over the alerts of all categories."""
    return _rounded(ind.ns01(grid(spark, sf_dir, "entity_id", "asset_id", "criticality")))


@query(f"WITH {grid_sql('entity_id')}, t AS (SELECT day, sum(activity) AS s, count(*) AS k FROM g GROUP BY day), p AS (SELECT x.entity_id, x.day, median(y.activity) AS base FROM g x JOIN g y ON y.entity_id <> x.entity_id AND (y.day < x.day OR (y.day = x.day AND x.day = (SELECT min(day) FROM g))) GROUP BY ALL), x AS (SELECT entity_id, activity, (s - activity) / (k - 1) AS pm, base FROM g JOIN t USING (day) JOIN p USING (entity_id, day) WHERE k > 3) SELECT entity_id, round(avg((pm - activity) / greatest(pm, 1.0)), 6) AS value, count(*) AS n FROM x WHERE pm >= greatest(1.0, 1.5 * base) AND activity <= greatest(0.0, 0.5 * base) GROUP BY entity_id")
def ns06_prior_shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NS-06 against the peers' earlier days."""
    return _rounded(ind.ns06_prior(grid(spark, sf_dir, "entity_id")))


# fixed values of the vocabularies, as SQL
_MISSING = ", ".join(f"'{x}'" for x in scalars.MISSING)
_SEVERITY = """CASE WHEN lower(trim(severity_raw)) IN ('critical', 'crit', 'sev1', 'p1') THEN 'CRITICAL' WHEN lower(trim(severity_raw)) IN ('high', 'major', 'sev2', 'p2') THEN 'HIGH'
 WHEN lower(trim(severity_raw)) IN ('medium', 'moderate', 'warning', 'sev3', 'p3') THEN 'MEDIUM' WHEN lower(trim(severity_raw)) IN ('low', 'minor', 'info', 'informational', 'sev4', 'p4') THEN 'LOW' END"""
_AMOUNT = "CASE WHEN lower(trim(amount_raw)) IN (" + _MISSING + ") THEN NULL ELSE try_cast(replace(trim(amount_raw), ',', '') AS DOUBLE) END"
_NOTE = f"CASE WHEN lower(trim(note_raw)) IN ({_MISSING}) THEN NULL WHEN regexp_matches(trim(note_raw), '^[=+\\-@]') THEN chr(39) || trim(note_raw) ELSE trim(note_raw) END"
_FLAG = "CASE WHEN lower(trim(flag_raw)) IN ('true', 't', 'yes', 'y', '1', 'on') THEN TRUE WHEN lower(trim(flag_raw)) IN ('false', 'f', 'no', 'n', '0', 'off') THEN FALSE END"
_OPENED = "CASE WHEN regexp_matches(opened_raw, '^[0-9]{9,10}$') THEN make_timestamp(CAST(opened_raw AS BIGINT) * 1000000) WHEN regexp_matches(opened_raw, '^[0-9]{12,13}$') THEN make_timestamp(CAST(opened_raw AS BIGINT) * 1000) WHEN opened_raw LIKE '%T%Z' THEN strptime(opened_raw, '%Y-%m-%dT%H:%M:%SZ') WHEN opened_raw LIKE '%/%' THEN strptime(opened_raw, '%d/%m/%Y') ELSE try_strptime(opened_raw, '%Y-%m-%d') END"
NORMAL = f"{a.RAW}, x AS (SELECT source_row, case_ref AS case_id, {_SEVERITY} AS severity, {_OPENED} AS opened, {_NOTE} AS note, {_FLAG} AS flag, CAST(trunc({_AMOUNT}) AS BIGINT) AS amount, analyst_raw AS analyst, severity_raw, flag_raw, opened_raw, {_AMOUNT} AS amount_real FROM raw)"


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.normalised(a.raw_submission(spark, sf_dir))


@query(f"WITH {NORMAL.replace('CAST(trunc(' + _AMOUNT + ') AS BIGINT) AS amount', 'CASE WHEN isnan(' + _AMOUNT + ') THEN NULL ELSE CAST(trunc(' + _AMOUNT + ') AS BIGINT) END AS amount')} SELECT source_row, case_id, severity, strftime(opened, '%Y-%m-%d %H:%M:%S') AS opened, note, flag, amount FROM x WHERE severity IS NOT NULL")
def normalised_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows of the submission that were accepted."""
    rows = intake.accepted(normal(spark, sf_dir))
    return rows.select("source_row", "case_id", "severity", F.date_format("opened", "yyyy-MM-dd HH:mm:ss").alias("opened"), "note", "flag", "amount")


@query(f"WITH {a.RAW} SELECT source_row, 'NORMALISE' AS stage, 'unmapped severity' AS reasons FROM raw WHERE {_SEVERITY} IS NULL")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.quarantined(normal(spark, sf_dir))


@query(f"WITH {a.RAW} SELECT 'NORMALISE' AS stage, 'unmapped severity' AS reasons, count(*) AS n FROM raw WHERE {_SEVERITY} IS NULL")
def quarantine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.quarantined(normal(spark, sf_dir)).groupBy("stage", "reasons").agg(F.count("*").alias("n"))


@query(f"WITH {a.RAW} SELECT case_ref AS case_id, source_row FROM (SELECT *, row_number() OVER (PARTITION BY case_ref ORDER BY source_row) AS r FROM raw WHERE {_SEVERITY} IS NOT NULL) WHERE r = 1")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.first_wins(intake.accepted(normal(spark, sf_dir)), ["case_id"], ["source_row"]).select("case_id", "source_row")


@query("SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_duplicates FROM lineitem")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.duplicate_keys(a.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"WITH {a.ALERTS} SELECT category, count(*) AS n_dangling FROM alerts WHERE case_no IS NOT NULL AND case_no NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey < 900) GROUP BY category")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = a.table(spark, sf_dir, "orders").filter("o_orderkey < 900")
    return intake.dangling(a.alerts(spark, sf_dir), "case_no", known, "o_orderkey").groupBy("category").agg(F.count("*").alias("n_dangling"))


def tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return intake.cell_tallies(a.raw_submission(spark, sf_dir), {"severity": (c("severity_raw"), scalars.severity(c("severity_raw"))), "opened": (c("opened_raw"), scalars.timestamp_utc(c("opened_raw"))), "flag": (c("flag_raw"), scalars.boolean(c("flag_raw"))), "amount": (c("amount_raw"), scalars.real(c("amount_raw"))), "note": (c("note_raw"), scalars.safe_text(c("note_raw")))})


TALLIES = f"""WITH {a.RAW}, t AS (
 SELECT 'severity' AS column_name, count(*) AS seen, 0 AS missing, count(*) FILTER ({_SEVERITY} IS NULL) AS failed FROM raw
 UNION ALL SELECT 'opened', count(*), 0, count(*) FILTER (opened_raw = 'not a date') FROM raw
 UNION ALL SELECT 'flag', count(*), 0, count(*) FILTER (flag_raw = 'maybe') FROM raw
 UNION ALL SELECT 'amount', count(*), count(*) FILTER (amount_raw = 'NaN'), 0 FROM raw
 UNION ALL SELECT 'note', count(*), count(*) FILTER (note_raw IN ('N/A', '-')), 0 FROM raw)"""


@query(f"{TALLIES} SELECT * FROM t")
def cell_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies(spark, sf_dir)


@query(f"{TALLIES} SELECT round(avg(1 - missing / seen), 6) AS completeness, round(1 - sum(failed) / sum(seen) / 2, 6) AS validity, round(0.25 * avg(1 - missing / seen) + 0.2 * (1 - sum(failed) / sum(seen) / 2), 6) AS part_score FROM t")
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness and validity from cell tallies, and their share of the weighted score."""
    w = DEFAULT.dq_weights
    complete, valid = F.avg(1 - F.col("missing") / F.col("seen")), 1 - F.sum("failed") / F.sum("seen") / 2
    return tallies(spark, sf_dir).agg(F.round(complete, 6).alias("completeness"), F.round(valid, 6).alias("validity"), F.round(w["completeness"] * complete + w["validity"] * valid, 6).alias("part_score"))


@query(f"WITH {a.RAW}, r AS (SELECT source_row, regexp_replace(note_raw, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b', '[EMAIL]', 'g') AS t, CASE WHEN note_raw LIKE '%@%.example.com%' THEN 1 ELSE 0 END AS e, CASE WHEN note_raw LIKE '%10.0.0.%' THEN 1 ELSE 0 END AS i FROM raw) SELECT source_row, regexp_replace(t, '\\b([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}\\b', '[IPV4]', 'g') AS redacted, e + i AS n_redacted, CASE WHEN e + i = 2 THEN 'EMAIL,IPV4' ELSE '' END AS categories FROM r")
def redacted_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.redact(a.raw_submission(spark, sf_dir), "note_raw").select("source_row", "redacted", "n_redacted", "categories")


@query()
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed pseudonyms of analysts; tests compare them with the standard library's HMAC."""
    raw = a.raw_submission(spark, sf_dir)
    return raw.select("source_row", privacy.pseudonym(KEY, KEY_REF, F.lit("e1"), "analyst", F.col("analyst_raw")).alias("pseudonym"))


_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


_SIGNED = f"""w AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[^ \\t\\n\\x0b\\f\\r]+') AS w FROM documents),
 s AS (SELECT doc_id, source, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [array_to_string(w, ' ')] END AS s FROM w),
 signed AS (SELECT doc_id, source, substr(sha256(array_to_string(list_sort(s), '|')), 1, 32) AS signature FROM s)"""


@query(f"WITH {_SIGNED} SELECT doc_id, signature FROM signed")
def note_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of whole notes: equal for notes of the same words, whatever the blanks between them."""
    docs = shared.spread(a.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", privacy.shingle_signature(F.col("text")).alias("signature"))


@query(f"WITH {_SIGNED} SELECT source AS entity, signature, count(*) AS n_notes FROM signed GROUP BY ALL HAVING count(*) > 1")
def template_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with equal signatures within an entity."""
    rows = a.table(spark, sf_dir, "documents").select(F.col("source").alias("entity"), privacy.shingle_signature(F.col("text")).alias("signature"))
    return rows.groupBy("entity", "signature").agg(F.count("*").alias("n_notes")).filter("n_notes > 1")


@query(f"WITH {YEAR}, r AS (SELECT entity_id, case_id, analyst, CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 20 ELSE 0 END + CASE WHEN escalated THEN 5 ELSE 0 END AS risk, created_s FROM c), u AS (SELECT entity_id, case_id, any_value(analyst ORDER BY created_s) AS analyst, max(risk) AS risk FROM r GROUP BY ALL), p AS (SELECT *, sum(risk) OVER (ORDER BY risk DESC, entity_id, case_id ROWS UNBOUNDED PRECEDING) AS high, sum(risk) OVER () AS whole FROM u WHERE risk > 0) SELECT entity_id, case_id, risk, round(least(1.0, 100 * risk / whole), 8) AS pi FROM p WHERE ceil((high - {sampling.seeded_start('sample')!r} * (whole / 100)) / (whole / 100)) - ceil((high - risk - {sampling.seeded_start('sample')!r} * (whole / 100)) / (whole / 100)) > 0")
def targeted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 cases with probability proportional to risk."""
    return sampling.proportional(risks(spark, sf_dir), 100).select("entity_id", "case_id", "risk", F.round("pi", 8).alias("pi"))


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = F.when(F.col("severity") == "CRITICAL", 40).when(F.col("severity") == "HIGH", 20).otherwise(0) + F.when(F.col("escalated"), 5).otherwise(0)
    return year_cases(spark, sf_dir).groupBy("entity_id", "case_id").agg(F.min("analyst").alias("analyst"), F.max(risk).alias("risk"), F.max("severity").alias("severity"))


@query(f"WITH {YEAR}, u AS (SELECT entity_id, case_id, max(severity) AS stratum FROM c GROUP BY ALL), z AS (SELECT stratum, count(*) AS size FROM u GROUP BY stratum), x AS (SELECT *, 60 * size / sum(size) OVER () AS exact FROM z), b AS (SELECT *, floor(exact) AS base FROM x), k AS (SELECT *, row_number() OVER (ORDER BY round(exact - base, 9) DESC, size, stratum DESC) AS r, 60 - sum(base) OVER () AS rest FROM b) SELECT stratum, size, CAST(least(size, base + CASE WHEN r <= rest THEN 1 ELSE 0 END) AS BIGINT) AS take FROM k")
def control_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    strata = risks(spark, sf_dir).groupBy(F.col("severity").alias("stratum")).agg(F.count("*").alias("size"))
    return sampling.allocation(strata, 60)


YEARLY = f"WITH {a.CASES}, y AS (SELECT entity_id, year, round(avg(CASE WHEN disposition = 'FALSE_POSITIVE' THEN 1.0 ELSE 0 END), 6) AS score FROM cases GROUP BY ALL)"


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.cases(spark, sf_dir).groupBy("entity_id", "year").agg(F.round(F.avg((F.col("disposition") == "FALSE_POSITIVE").cast("double")), 6).alias("score"))


@query(f"{YEARLY} SELECT year, round(median(score), 6) AS median, count(*) AS n FROM y GROUP BY year HAVING count(*) >= 3")
def cohort_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yearly(spark, sf_dir).groupBy("year").agg(F.round(F.expr("median(score)"), 6).alias("median"), F.count("*").alias("n")).filter("n >= 3")


@query(f"{YEARLY}, axis AS (SELECT DISTINCT year FROM y), s AS (SELECT entity_id, min(year) AS a, max(year) AS b FROM y GROUP BY entity_id) SELECT s.entity_id, axis.year, score, score IS NULL AS gap FROM s JOIN axis ON axis.year BETWEEN a AND b LEFT JOIN y ON y.entity_id = s.entity_id AND y.year = axis.year")
def entity_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores on the cohort's period axis within each entity's own span; gaps are marked, not filled."""
    y = yearly(spark, sf_dir)
    span = y.groupBy("entity_id").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    axis = F.broadcast(y.select("year").distinct())  # one row per period
    return span.join(axis, F.col("year").between(F.col("a"), F.col("b"))).join(y, ["entity_id", "year"], "left").select("entity_id", "year", "score", F.col("score").isNull().alias("gap"))


@query(f"{EFFECTS}, o AS (SELECT entity_id, indicator, effect FROM l WHERE effect >= 2), n AS (SELECT entity_id, indicator, effect FROM l WHERE effect >= 3) SELECT entity_id, indicator, CASE WHEN n.effect IS NULL THEN 'removed' WHEN o.effect IS NULL THEN 'added' ELSE 'same' END AS change FROM o FULL JOIN n USING (entity_id, indicator)")
def policy_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings under two ramps: what a stricter policy removes."""
    e = effects(spark, sf_dir).select("entity_id", "indicator", "effect")
    old, new = e.filter("effect >= 2").withColumnRenamed("effect", "o"), e.filter("effect >= 3").withColumnRenamed("effect", "n")
    change = F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull(), "added").otherwise("same")
    return old.join(new, ["entity_id", "indicator"], "full_outer").select("entity_id", "indicator", change.alias("change"))


@query(f"WITH {a.ALL_ALERTS} SELECT entity_id, count(*) AS n_alerts, count(*) FILTER (category = 'error') AS n_errors, round(sum(value), 2) AS total FROM alerts GROUP BY entity_id")
def chunked_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-entity activity over all events, planted silences or not; the streaming form of the same aggregate is in vigil.streaming."""
    al = a.all_alerts(spark, sf_dir)
    return al.groupBy("entity_id").agg(F.count("*").alias("n_alerts"), F.count(F.when(F.col("category") == "error", 1)).alias("n_errors"), F.round(F.sum("value"), 2).alias("total"))


@query(f"WITH {a.ALERTS} SELECT entity_id, count(*) AS n_rows, count(case_no) AS n_case, count(value) AS n_value, CASE WHEN count(*) = 0 THEN 'no_rows' WHEN count(value) = 0 THEN 'empty_column' ELSE 'present' END AS value_state FROM alerts GROUP BY entity_id")
def presence_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and non-null cells per entity in one pass."""
    state = F.when(F.count("*") == 0, "no_rows").when(F.count("value") == 0, "empty_column").otherwise("present")
    return a.alerts(spark, sf_dir).groupBy("entity_id").agg(F.count("*").alias("n_rows"), F.count("case_no").alias("n_case"), F.count("value").alias("n_value"), state.alias("value_state"))


@query(f"WITH {a.ENTITIES}, {YEAR} SELECT entities.entity_id, name, cohort, coalesce(n_cases, 0) AS n_cases, n_critical FROM entities LEFT JOIN (SELECT entity_id, count(*) AS n_cases, count(*) FILTER (severity = 'CRITICAL') AS n_critical FROM c GROUP BY entity_id) USING (entity_id)")
def entity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities, with counts where there are cases; missing stays missing."""
    counts = year_cases(spark, sf_dir).groupBy("entity_id").agg(F.count("*").alias("n_cases"), F.count(F.when(F.col("severity") == "CRITICAL", 1)).alias("n_critical"))
    return a.entities(spark, sf_dir).join(counts, "entity_id", "left").select("entity_id", "name", "cohort", F.coalesce("n_cases", F.lit(0)).alias("n_cases"), "n_critical")


@query(f"{EFFECTS} SELECT x.entity_id, x.indicator, y.indicator AS other, CASE WHEN x.family = y.family THEN 'same_family' ELSE 'independent' END AS relation FROM l x JOIN l y ON x.entity_id = y.entity_id AND x.indicator <> y.indicator AND sign(x.effect) = sign(y.effect) WHERE abs(x.effect) >= 2 AND abs(y.effect) >= 2")
def corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other strong effects of the same entity and direction."""
    e = effects(spark, sf_dir).filter(F.abs("effect") >= 2)
    o = e.select("entity_id", F.col("indicator").alias("other"), F.col("family").alias("f2"), F.col("effect").alias("e2"))
    rows = e.join(o, "entity_id").filter((F.col("indicator") != F.col("other")) & (F.signum("effect") == F.signum("e2")))
    return rows.select("entity_id", "indicator", "other", F.when(F.col("family") == F.col("f2"), "same_family").otherwise("independent").alias("relation"))


# --- cohorts, self baselines, bands, evaluation, audit, paging ---


@query(f"WITH {a.ENTITIES}, {YEAR}, v AS ({VALUES['eg08']}), b AS (SELECT cohort, median(value) AS m, count(*) AS k FROM v JOIN entities USING (entity_id) GROUP BY cohort) SELECT cohort, k AS n, round(m, 6) AS median, round((SELECT median(abs(value - b.m)) FROM v JOIN entities e USING (entity_id) WHERE e.cohort = b.cohort), 6) AS mad, k < 8 AS thin FROM b")
def cohort_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and spread of a measure in each cohort."""
    v = ind.eg08(year_cases(spark, sf_dir)).join(a.entities(spark, sf_dir), "entity_id")
    m = v.groupBy("cohort").agg(F.expr("median(value)").alias("m"))
    out = v.join(m, "cohort").groupBy("cohort").agg(F.count("*").alias("n"), F.round(F.first("m"), 6).alias("median"), F.round(F.expr("median(abs(value - m))"), 6).alias("mad"))
    return out.withColumn("thin", F.col("n") < DEFAULT.min_peers)


@query(f"{YEARLY}, x AS (SELECT * FROM y WHERE year < 1997), m AS (SELECT entity_id, median(score) AS m, count(*) AS periods FROM x GROUP BY entity_id) SELECT m.entity_id, round(any_value(m), 5) AS median, round(median(abs(score - m)), 5) AS mad, any_value(periods) AS periods FROM m JOIN x USING (entity_id) GROUP BY m.entity_id")
def self_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's own earlier periods: median, spread and count."""
    x = yearly(spark, sf_dir).filter("year < 1997")
    m = x.groupBy("entity_id").agg(F.expr("median(score)").alias("m"), F.count("*").alias("periods"))
    return x.join(m, "entity_id").groupBy("entity_id").agg(F.round(F.first("m"), 5).alias("median"), F.round(F.expr("median(abs(score - m))"), 5).alias("mad"), F.first("periods").alias("periods"))


@query(f"{YEARLY} SELECT year, entity_id, score, rank() OVER (PARTITION BY year ORDER BY score DESC) AS rank FROM y")
def yearly_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competition ranks per period."""
    placed = Ordered(yearly(spark, sf_dir), ["year"], [F.desc("score"), "entity_id"]).numbered("i")
    first = placed.groupBy("year", "score").agg(F.min("i").alias("rank"))  # equal scores have the place of the first
    return placed.join(first, ["year", "score"]).select("year", "entity_id", "score", "rank")


@query(f"{YEARLY}, p AS (SELECT *, count(*) OVER w AS nl, sum(score) OVER w AS sl, sum(score * score) OVER w AS ql, count(*) OVER t AS nt, sum(score) OVER t AS st, sum(score * score) OVER t AS qt FROM y WINDOW w AS (PARTITION BY entity_id ORDER BY year ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY entity_id)), c AS (SELECT *, round((qt - st * st / nt) - (ql - sl * sl / nl) - ((qt - ql) - (st - sl) * (st - sl) / (nt - nl)), 6) AS gain FROM p WHERE nl >= 3 AND nt - nl >= 3) SELECT entity_id, year + 1 AS change_year, gain FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY gain DESC, year) AS r FROM c) WHERE r = 1")
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best first split of each entity's series: the largest drop of squared error, from prefix sums."""
    w = Window.partitionBy("entity_id").orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = Window.partitionBy("entity_id")
    s, q = F.col("score"), F.col("score") * F.col("score")
    p = yearly(spark, sf_dir).select("entity_id", "year", F.count("*").over(w).alias("nl"), F.sum(s).over(w).alias("sl"), F.sum(q).over(w).alias("ql"), F.count("*").over(t).alias("nt"), F.sum(s).over(t).alias("st"), F.sum(q).over(t).alias("qt"))
    rest = F.col("nt") - F.col("nl")
    gain = (F.col("qt") - F.col("st") * F.col("st") / F.col("nt")) - (F.col("ql") - F.col("sl") * F.col("sl") / F.col("nl")) - ((F.col("qt") - F.col("ql")) - (F.col("st") - F.col("sl")) * (F.col("st") - F.col("sl")) / rest)
    c = p.filter((F.col("nl") >= 3) & (rest >= 3)).withColumn("gain", F.round(gain, 6))
    best = Window.partitionBy("entity_id").orderBy(F.desc("gain"), "year")
    return c.withColumn("r", F.row_number().over(best)).filter("r = 1").select("entity_id", (F.col("year") + 1).alias("change_year"), "gain")


@query("WITH s AS (SELECT o_custkey AS entity, max(o_totalprice) AS score, max(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS hit FROM orders GROUP BY o_custkey), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, entity) AS i FROM s) SELECT round(sum(CASE WHEN i <= 50 THEN hit END) / 50, 6) AS precision, round(sum(CASE WHEN i <= 50 THEN hit END) / sum(hit), 6) AS recall, round(sum(hit / log2(i + 1)), 4) AS dcg FROM r")
def ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall at 50 and discounted gain of a ranking against labels."""
    o = a.table(spark, sf_dir, "orders")
    s = o.groupBy(F.col("o_custkey").alias("entity")).agg(F.max("o_totalprice").alias("score"), F.max(F.col("o_orderpriority").startswith("1").cast("int")).alias("hit"))
    r = Ordered(s, [], [F.desc("score"), "entity"]).numbered("i")
    top = F.sum(F.when(F.col("i") <= 50, F.col("hit")))
    return r.agg(F.round(top / 50, 6).alias("precision"), F.round(top / F.sum("hit"), 6).alias("recall"), F.round(F.sum(F.col("hit") / F.log2(F.col("i") + 1)), 4).alias("dcg"))


@query("SELECT o_orderkey, CASE WHEN CAST('0x' || substr(sha256('s1|' || o_orderkey), 1, 8) AS UBIGINT) % 100 < 25 THEN o_totalprice * 2 ELSE o_totalprice END AS price, CAST('0x' || substr(sha256('s1|' || o_orderkey), 1, 8) AS UBIGINT) % 100 < 25 AS injected FROM orders")
def dose_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows chosen by hash at a dose of 25 percent are changed; the same rows at any partitioning."""
    bucket = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit("s1"), "o_orderkey"), 256), 1, 8), 16, 10).cast("long") % 100
    return a.table(spark, sf_dir, "orders").select("o_orderkey", F.when(bucket < 25, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")).alias("price"), (bucket < 25).alias("injected"))


CHAIN = "WITH e AS (SELECT event_id AS seq, user_id % 20 AS chain, sha256(CAST(event_id AS VARCHAR) || event_type) AS hash FROM events), l AS (SELECT *, lag(hash) OVER (PARTITION BY chain ORDER BY seq) AS prev FROM e), t AS (SELECT *, CASE WHEN seq % 997 = 5 THEN 'tampered' ELSE prev END AS stated FROM l)"


@query(f"{CHAIN} SELECT chain, min(seq) AS first_break, count(*) AS n_breaks FROM t WHERE prev IS NOT NULL AND stated <> prev GROUP BY chain")
def ledger_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First entry of each chain whose stated predecessor is not the one before it."""
    e = a.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 20).alias("chain"), F.sha2(F.concat(F.col("event_id").cast("string"), "event_type"), 256).alias("hash"))
    linked = e.withColumn("prev", F.lag("hash").over(Window.partitionBy("chain").orderBy("seq")))
    stated = F.when(F.col("seq") % 997 == 5, F.lit("tampered")).otherwise(F.col("prev"))
    return linked.filter(F.col("prev").isNotNull() & (stated != F.col("prev"))).groupBy("chain").agg(F.min("seq").alias("first_break"), F.count("*").alias("n_breaks"))


@query("SELECT o_custkey % 100 AS entity_id, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END), 0) + 1 AS next_version FROM orders GROUP BY 1")
def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next submission version of each entity."""
    o = a.table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") % 100).alias("entity_id")).agg((F.coalesce(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))), F.lit(0)) + 1).alias("next_version"))


@query("SELECT o_orderkey, sha256('{\"o_orderpriority\":\"' || o_orderpriority || '\",\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS record_hash FROM orders")
def record_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each record's content columns as sorted JSON."""
    content = F.to_json(F.struct("o_orderpriority", "o_orderstatus"), {"ignoreNullFields": "false"})
    return a.table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(content, 256).alias("record_hash"))


@query(f"WITH {a.ALERTS} SELECT alert_id, entity_id, category FROM alerts ORDER BY event_s DESC, alert_id LIMIT 50 OFFSET 100")
def alert_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third page of the newest alerts; the limit is the feature."""
    return a.alerts(spark, sf_dir).orderBy(F.desc("event_s"), "alert_id").offset(100).limit(50).select("alert_id", "entity_id", "category")


@query(f"WITH {a.ENTITIES}, {YEAR}, x AS (SELECT entity_id, max(closed_s) AS latest FROM c GROUP BY entity_id), l AS (SELECT entity_id, (epoch(TIMESTAMP '1997-01-01') - latest) / 86400.0 AS days FROM entities LEFT JOIN x USING (entity_id)) SELECT entity_id, CASE WHEN days IS NULL THEN 1.0 WHEN days <= 0 THEN 0.0 WHEN days <= 7 THEN 0.15 WHEN days <= 30 THEN 0.5 ELSE 1.0 END AS lag_penalty FROM l")
def timeliness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalty for how long before the period's end an entity's newest evidence lies."""
    latest = year_cases(spark, sf_dir).groupBy("entity_id").agg(F.max("closed_s").alias("latest"))
    days = (F.unix_timestamp(F.lit("1997-01-01 00:00:00")) - F.col("latest")) / 86400.0
    ladder = F.when(days.isNull(), 1.0).when(days <= 0, 0.0).when(days <= 7, 0.15).when(days <= 30, 0.5).otherwise(1.0)
    return a.entities(spark, sf_dir).join(latest, "entity_id", "left").select("entity_id", ladder.alias("lag_penalty"))


# --- files, streams, note similarity, evidence traces ---

_TEXT_COLUMNS = ["case_ref", "source_row", "severity_raw", "opened_raw", "note_raw", "flag_raw", "amount_raw", "analyst_raw"]
_BACK = f"WITH {a.RAW} SELECT severity_raw, count(*) AS n, count(DISTINCT note_raw) AS n_notes, sum(source_row) AS row_sum FROM raw GROUP BY severity_raw"


def _summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("severity_raw").agg(F.count("*").alias("n"), F.countDistinct("note_raw").alias("n_notes"), F.sum(F.col("source_row").cast("long")).alias("row_sum"))


@query(_BACK)
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submission written as CSV and scanned back as text."""
    path = shared.folder(spark)
    a.raw_submission(spark, sf_dir).write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return _summary(files.good(files.read_csv(spark, path, _TEXT_COLUMNS)))


@query(_BACK)
def ndjson_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submission written as JSON lines and scanned back as text."""
    path = shared.folder(spark)
    a.raw_submission(spark, sf_dir).write.json(path)
    return _summary(files.good(files.read_ndjson(spark, path, _TEXT_COLUMNS)))


_KIND = "CASE WHEN event_type = 'signup' THEN 'case' ELSE 'alert' END"
_BAND = "CASE event_id % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' END"


@query(f"""WITH e AS (SELECT user_id % 100 AS entity_id, event_type, value, {_KIND} AS kind, {_BAND} AS severity FROM events)
 SELECT entity_id, count(*) FILTER (kind = 'alert') AS n_alerts, count(*) FILTER (event_type = 'error') AS n_errors, count(*) FILTER (kind = 'case') AS n_cases,
  count(*) FILTER (kind = 'alert' AND severity = 'CRITICAL') AS n_critical, count(*) FILTER (kind = 'alert' AND severity = 'HIGH') AS n_high,
  count(*) FILTER (kind = 'alert' AND severity = 'MEDIUM') AS n_medium, count(*) FILTER (kind = 'alert' AND severity = 'LOW') AS n_low,
  count(*) FILTER (kind = 'alert' AND severity IS NULL) AS n_unknown, round(sum(value) FILTER (kind = 'alert'), 2) AS total FROM e GROUP BY 1""")
def streamed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-entity counts, severities and activity kept up by a stream over the events, in four files and four batches."""
    path = shared.folder(spark)
    a.table(spark, sf_dir, "events").repartition(4, "event_id").write.parquet(path)
    prepare = lambda rows: rows.select((F.col("user_id") % 100).alias("entity_id"), F.expr(_KIND).alias("kind"), F.col("event_type").alias("category"), F.expr(_BAND).alias("severity"), "value")
    return incremental.maintained(spark, path, shared.folder(spark), prepare).withColumn("total", F.round("total", 2))


_SHINGLED = f"WITH w AS (SELECT source, doc_id, {_WORDS} AS w FROM documents), sh AS (SELECT source, doc_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS sh FROM w WHERE len(w) >= 3), mh AS (SELECT source, doc_id, k, min(substr(sha256(k || ':' || s), 1, 16)) AS m FROM (SELECT source, doc_id, unnest(sh) AS s FROM sh) CROSS JOIN (SELECT unnest(range(0, 32)) AS k) GROUP BY ALL), bd AS (SELECT source, doc_id, k // 4 AS band, string_agg(m, '|' ORDER BY k) AS signature FROM mh GROUP BY ALL)"


@query(f"{_SHINGLED}, b AS (SELECT source AS entity, band, signature, count(*) AS n_notes, min(doc_id) AS anchor FROM bd GROUP BY ALL HAVING count(*) > 1) SELECT entity, anchor, count(*) AS n_bands, max(n_notes) AS n_notes FROM b GROUP BY ALL")
def note_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of similar notes within an entity, by anchor note."""
    docs = a.table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    found = text.templates(trends.shared_bands(docs, "source", "doc_id", "text", tasks=shared.blocks(docs), kept=shared.kept), "entity", "note")
    return found.groupBy("entity", "anchor").agg(F.count("*").alias("n_bands"), F.max("n_notes").alias("n_notes"))


@query(f"{FDR}, top AS (SELECT entity_id FROM f WHERE indicator = 'eg06' AND effect > 1) SELECT entity_id, count(*) AS n_evidence, count(*) FILTER (o.o_orderkey IS NULL) AS n_unresolved FROM top JOIN c USING (entity_id) LEFT JOIN orders o ON CAST(split_part(case_id, '-', 1) AS BIGINT) = o.o_orderkey WHERE severity = 'CRITICAL' AND closed_s IS NOT NULL AND escalation_level IS NULL GROUP BY entity_id")
def evidence_traceability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every evidence id of the raised entities leads to a record."""
    top = effects(spark, sf_dir).filter("indicator = 'eg06' and effect > 1").select("entity_id")
    rows = year_cases(spark, sf_dir).filter("severity = 'CRITICAL' and closed_s is not null and escalation_level is null").join(top, "entity_id")
    known = a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(True).alias("hit"))
    traced = rows.withColumn("k", F.substring_index("case_id", "-", 1).cast("long")).join(known, "k", "left")
    return traced.groupBy("entity_id").agg(F.count("*").alias("n_evidence"), F.count(F.when(F.col("hit").isNull(), 1)).alias("n_unresolved"))


# --- drill-down, assessability, estimates, outliers ---


def _targeted_sql() -> str:
    sql = ORACLE_SQL["targeted_sample"]
    cut = sql.rindex(" SELECT entity_id, case_id, risk")
    return f"{sql[:cut]}, s AS ({sql[cut:].strip()})"


@query(f"{_targeted_sql()}, y AS (SELECT s.*, CASE WHEN bool_or(disposition = 'TRUE_POSITIVE') THEN 1 ELSE 0 END AS y FROM s JOIN c USING (entity_id, case_id) GROUP BY ALL), n AS (SELECT count(*) AS big FROM p) SELECT count(*) AS n_sample, any_value(big) AS n_population, round(sum(y / pi) / any_value(big), 5) AS prevalence, round(sqrt(sum((1 - pi) / (pi * pi) * y)) / any_value(big), 5) AS standard_error FROM y, n")
def ht_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horvitz-Thompson prevalence of true positives among cases with risk, from the targeted sample."""
    pool = risks(spark, sf_dir)
    sample = sampling.proportional(pool, 100)
    verdicts = year_cases(spark, sf_dir).groupBy("entity_id", "case_id").agg(F.max((F.col("disposition") == "TRUE_POSITIVE").cast("int")).alias("y"))
    size = pool.filter("risk > 0").agg(F.count("*").alias("big"))
    rows = sample.withColumn("pi", F.round("pi", 8)).join(verdicts, ["entity_id", "case_id"]).crossJoin(F.broadcast(size))  # one row
    big = F.first("big")
    return rows.agg(F.count("*").alias("n_sample"), big.alias("n_population"), F.round(F.sum(F.col("y") / F.col("pi")) / big, 5).alias("prevalence"), F.round(F.sqrt(F.sum((1 - F.col("pi")) / (F.col("pi") * F.col("pi")) * F.col("y"))) / big, 5).alias("standard_error"))


@query(f"WITH {YEAR}, u AS (SELECT entity_id, case_id, max(severity) AS stratum FROM c GROUP BY ALL) SELECT entity_id, case_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('s|' || entity_id || '|' || case_id), case_id) AS r FROM u) WHERE r <= 15")
def control_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15 control cases of each stratum by hash order."""
    frame = risks(spark, sf_dir).withColumnRenamed("severity", "stratum")
    take = frame.groupBy("stratum").agg(F.count("*").alias("size")).withColumn("take", F.lit(15))
    return sampling.controls(frame, take, "s").select("entity_id", "case_id", "stratum")


@query(f"WITH {a.ENTITIES}, {YEAR}, n AS (SELECT entities.entity_id, count(case_id) AS n_cases, count(closed_s) AS n_closed, count(escalation_level) AS n_levels FROM entities LEFT JOIN c USING (entity_id) GROUP BY entities.entity_id) SELECT entity_id, d.dimension, CASE WHEN n_cases = 0 OR need = 0 THEN 'NOT_ASSESSABLE' WHEN want = 0 THEN 'PARTIAL' ELSE 'ASSESSABLE' END AS state FROM (SELECT entity_id, n_cases, unnest([{{'dimension': 'closure', 'need': n_closed, 'want': n_closed}}, {{'dimension': 'escalation', 'need': n_cases, 'want': n_levels}}]) AS d FROM n), LATERAL (SELECT d.need AS need, d.want AS want)")
def assessability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each entity's evidence can support: required fields decide, optional ones only lower."""
    n = a.entities(spark, sf_dir).select("entity_id").join(year_cases(spark, sf_dir), "entity_id", "left").groupBy("entity_id").agg(F.count("case_id").alias("n_cases"), F.count("closed_s").alias("n_closed"), F.count("escalation_level").alias("n_levels"))
    need = F.array(F.struct(F.lit("closure").alias("dimension"), F.col("n_closed").alias("need"), F.col("n_closed").alias("want")), F.struct(F.lit("escalation").alias("dimension"), F.col("n_cases").alias("need"), F.col("n_levels").alias("want")))
    state = F.when((F.col("n_cases") == 0) | (F.col("need") == 0), "NOT_ASSESSABLE").when(F.col("want") == 0, "PARTIAL").otherwise("ASSESSABLE")
    return n.select("entity_id", "n_cases", F.inline(need)).select("entity_id", "dimension", state.alias("state"))


@query(f"WITH {a.RAW} SELECT 'opened' AS column_name, round(avg(CASE WHEN regexp_matches(opened_raw, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 1 ELSE 0 END), 6) AS timestamp_share, round(avg(CASE WHEN regexp_matches(opened_raw, '^[0-9]+$') THEN 1 ELSE 0 END), 6) AS number_share FROM raw UNION ALL SELECT 'amount', round(avg(CASE WHEN regexp_matches(amount_raw, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 1 ELSE 0 END), 6), round(avg(CASE WHEN regexp_matches(amount_raw, '^[0-9]+$') THEN 1 ELSE 0 END), 6) FROM raw")
def value_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each column's values by shape, over whole columns in one pass."""
    raw = a.raw_submission(spark, sf_dir)
    share = lambda c, p: F.round(F.avg(F.col(c).rlike(p).cast("int")), 6)
    rows = [F.struct(F.lit(n).alias("column_name"), share(c, r"^\d{4}-\d{2}-\d{2}").alias("timestamp_share"), share(c, r"^\d+$").alias("number_share")) for n, c in (("opened", "opened_raw"), ("amount", "amount_raw"))]
    return raw.agg(F.array(*rows).alias("r")).select(F.inline("r"))


@query(f"WITH {a.ENTITIES}, {YEAR}, {peer_sql(VALUES['eg01'], -1)} SELECT entity_id, round(med - 2 * 1.4826 * mad, 4) AS clear_value, round(med + 2 * (value - med), 4) AS doubled_value FROM e WHERE n_peers >= 8 AND mad > 0")
def counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure time at which an entity would no longer stand out, and a deviation twice its own."""
    e = baselined(spark, sf_dir, "eg01", -1).filter((F.col("n_peers") >= DEFAULT.min_peers) & (F.col("mad") > 0))
    return e.select("entity_id", F.round(F.col("median") - DEFAULT.ramp_z0 * 1.4826 * F.col("mad"), 4).alias("clear_value"), F.round(F.col("median") + 2 * (F.col("value") - F.col("median")), 4).alias("doubled_value"))


@query(f"{FDR} SELECT entity_id, count(*) FILTER (survives AND effect > 2) AS n_raised, count(*) FILTER (NOT survives AND effect > 2) AS n_suppressed, count(*) FILTER (effect <= 2) AS n_quiet FROM f GROUP BY entity_id")
def why_not_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's indicators by why they raised nothing."""
    f = scoring.false_discovery(effects(spark, sf_dir))
    adverse = F.col("effect") > DEFAULT.ramp_z0
    n = lambda c: F.count(F.when(c, 1))
    return f.groupBy("entity_id").agg(n(F.col("survives") & adverse).alias("n_raised"), n(~F.col("survives") & adverse).alias("n_suppressed"), n(~adverse).alias("n_quiet"))


def _feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "embeddings")
    rows = F.array(*(F.struct(F.lit(f"f{i}").alias("feature"), F.col("embedding")[i].cast("double").alias("value")) for i in range(4)))
    return e.select(F.col("vec_id").alias("entity_id"), F.col("label").alias("cohort"), F.lit(1).alias("n"), F.lit(1).alias("sign"), F.inline(rows))


@query("""WITH x AS (SELECT vec_id AS entity_id, label AS cohort, 'f' || i AS feature, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings CROSS JOIN (SELECT unnest(range(0, 4)) AS i)),
 p AS (SELECT a.entity_id, a.feature, a.value, b.value AS peer FROM x a JOIN x b ON a.cohort = b.cohort AND a.feature = b.feature AND a.entity_id <> b.entity_id),
 m AS (SELECT entity_id, feature, any_value(value) AS value, median(peer) AS med FROM p GROUP BY ALL),
 d AS (SELECT p.entity_id, p.feature, median(abs(peer - med)) AS mad FROM p JOIN m USING (entity_id, feature) GROUP BY ALL),
 e AS (SELECT *, round((value - med) / CASE WHEN mad > 0 THEN 1.4826 * mad ELSE greatest(0.1 * abs(med), 1.0) END, 5) AS effect FROM m JOIN d USING (entity_id, feature))
 SELECT entity_id, feature, effect FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY abs(effect) DESC, feature) AS r FROM e) WHERE r <= 2""")
def feature_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two features in which each vector differs most from its peers, in robust units."""
    e = stats.peer_baseline(_feature_rows(spark, sf_dir), by=["feature"]).filter("median is not null")
    unit = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(F.greatest(0.1 * F.abs("median"), F.lit(1.0)))
    e = e.withColumn("effect", F.round((F.col("value") - F.col("median")) / unit, 5))
    w = Window.partitionBy("entity_id").orderBy(F.abs("effect").desc(), "feature")
    return e.withColumn("r", F.row_number().over(w)).filter("r <= 2").select("entity_id", "feature", "effect")


@query("""WITH x AS (SELECT vec_id AS entity_id, label AS cohort, 'f' || i AS feature, CAST(embedding[i + 1] AS DOUBLE) AS value FROM (SELECT *, unnest(range(0, len(embedding))) AS i FROM embeddings)),
 p AS (SELECT a.entity_id, a.feature, a.value, b.value AS peer FROM x a JOIN x b ON a.cohort = b.cohort AND a.feature = b.feature AND a.entity_id <> b.entity_id),
 m AS (SELECT entity_id, feature, any_value(value) AS value, median(peer) AS med FROM p GROUP BY ALL),
 d AS (SELECT p.entity_id, p.feature, median(abs(peer - med)) AS mad FROM p JOIN m USING (entity_id, feature) GROUP BY ALL),
 e AS (SELECT *, round((value - med) / CASE WHEN mad > 0 THEN 1.4826 * mad ELSE greatest(0.1 * abs(med), 1.0) END, 5) AS effect FROM m JOIN d USING (entity_id, feature))
 SELECT entity_id, feature, effect FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY abs(effect) DESC, feature) AS r FROM e) WHERE r <= 5""")
def all_feature_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five features, of all, in which each vector differs most from its peers, in robust units."""
    rows = a.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity_id"), F.col("label").alias("cohort"), F.posexplode("embedding").alias("i", "x"))
    e = stats.peer_deviations(rows.select("entity_id", "cohort", F.concat(F.lit("f"), "i").alias("feature"), F.col("x").cast("double").alias("value")), ["cohort", "feature"])
    unit = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(F.greatest(0.1 * F.abs("median"), F.lit(1.0)))
    e = e.withColumn("effect", F.round((F.col("value") - F.col("median")) / unit, 5))
    w = Window.partitionBy("entity_id").orderBy(F.abs("effect").desc(), "feature")
    return e.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("entity_id", "feature", "effect")


def evidence(spark: SparkSession, sf_dir: str, cases: DataFrame | None = None, lengths: DataFrame | None = None, periods: DataFrame | None = None) -> DataFrame:
    """(indicator, entity_id, row_id): the rows behind each value; for EG-02 those whose note is thin."""
    c = cases if cases is not None else kept_cases(spark, sf_dir)
    lengths = lengths if lengths is not None else notes(spark, sf_dir)
    periods = periods if periods is not None else boundaries(spark, sf_dir)
    severe, closed, d = F.col("severity").isin(*ind.SEVERE), F.col("closed_s").isNotNull(), ind.duration()
    sla = F.create_map(*(F.lit(x) for kv in DEFAULT.sla_s.items() for x in kv))[F.col("severity")]
    dismissed = c.filter(severe & F.col("disposition").isin("FALSE_POSITIVE", "SUPPRESSED")).join(lengths, "note_ref", "left")
    near = (F.col("closed_s") > F.col("boundary_s") - DEFAULT.boundary_hours * 3600) & (F.col("closed_s") <= F.col("boundary_s"))
    rows = {
        "eg01": c.filter(severe & closed & d.isNotNull()),
        "eg02": dismissed.filter(F.coalesce(F.col("note_chars"), F.lit(0)) < DEFAULT.thin_note_chars),
        "eg06": c.filter((F.col("severity") == "CRITICAL") & closed & F.col("escalation_level").isNull()).join(c.filter("escalated").select("entity_id", "case_id").distinct(), ["entity_id", "case_id"], "left_anti"),
        "eg08": c.filter(closed & d.between(DEFAULT.sla_band * sla, sla)),
        "eg09": c.filter(closed).join(periods, "entity_id").filter(near),
    }
    return reduce(DataFrame.unionByName, (x.select(F.lit(k).alias("indicator"), "entity_id", F.col("case_id").alias("row_id")) for k, x in rows.items()))


@query(f"""WITH {a.ENTITIES}, {YEAR}, e AS (SELECT DISTINCT entity_id, case_id FROM c WHERE escalated),
 r AS (SELECT 'eg01' AS indicator, entity_id, case_id AS row_id FROM c WHERE severity IN ('HIGH', 'CRITICAL') AND closed_s IS NOT NULL AND d IS NOT NULL
 UNION ALL SELECT 'eg02', entity_id, case_id FROM c LEFT JOIN documents ON note_ref = doc_id WHERE severity IN ('HIGH', 'CRITICAL') AND disposition IN ('FALSE_POSITIVE', 'SUPPRESSED') AND coalesce(length(text), 0) < 20
 UNION ALL SELECT 'eg06', entity_id, case_id FROM c ANTI JOIN e USING (entity_id, case_id) WHERE severity = 'CRITICAL' AND closed_s IS NOT NULL AND escalation_level IS NULL
 UNION ALL SELECT 'eg08', entity_id, case_id FROM c WHERE closed_s IS NOT NULL AND d BETWEEN 0.9 * CASE severity WHEN 'CRITICAL' THEN 900 WHEN 'HIGH' THEN 3600 WHEN 'MEDIUM' THEN 14400 ELSE 43200 END AND CASE severity WHEN 'CRITICAL' THEN 900 WHEN 'HIGH' THEN 3600 WHEN 'MEDIUM' THEN 14400 ELSE 43200 END
 UNION ALL SELECT 'eg09', entity_id, case_id FROM c JOIN entities USING (entity_id) WHERE closed_s > epoch(TIMESTAMP '1997-01-01') - 172800 AND closed_s <= epoch(TIMESTAMP '1997-01-01')
 UNION ALL SELECT 'eg11', o_custkey % 100, CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 10 = 0 AND o_orderpriority <> 'X')
 SELECT indicator, entity_id, count(*) AS n_rows, sha256(string_agg(row_id, ',' ORDER BY row_id)) AS ids_hash FROM r GROUP BY ALL""")
def evidence_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows behind each of the six indicators' values, as a count and a hash of their sorted ids."""
    changed = versions(spark, sf_dir).groupBy("entity_id", "record_key").agg(F.countDistinct("record_hash").alias("h")).filter("h > 1")
    rows = evidence(spark, sf_dir).unionByName(changed.select(F.lit("eg11").alias("indicator"), "entity_id", F.col("record_key").cast("string").alias("row_id")))
    return rows.groupBy("indicator", "entity_id").agg(F.count("*").alias("n_rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("row_id")), ","), 256).alias("ids_hash"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = a.table(spark, sf_dir, "orders")
    changed = F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderpriority"))
    content = lambda p, s: F.struct(F.lit(s).alias("submission"), F.sha2(F.concat_ws("|", p, "o_orderstatus"), 256).alias("record_hash"))
    both = F.array(content(F.col("o_orderpriority"), 1), content(changed, 2))  # side by side, so that they meet before the shuffle
    return o.select((F.col("o_custkey") % 100).alias("entity_id"), F.col("o_orderkey").alias("record_key"), F.inline(both))


def finding_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with the sum of confidence times adverse effect over the findings whose evidence they are, in millionths."""
    found = scoring.false_discovery(effects(spark, sf_dir)).filter(F.col("survives") & (scoring.ramp(F.col("effect")) > 0))
    weight = found.select("entity_id", "indicator", (F.col("confidence") * F.greatest(F.lit(0.0), F.col("effect"))).alias("w"))
    risk = evidence(spark, sf_dir).distinct().join(weight, ["entity_id", "indicator"]).groupBy("entity_id", F.col("row_id").alias("case_id")).agg(F.round(F.sum("w") * 1_000_000).cast("long").alias("risk"))
    cases = year_cases(spark, sf_dir).groupBy("entity_id", "case_id").agg(F.min("analyst").alias("analyst"), F.max("severity").alias("severity"))
    return shared.kept(cases.join(risk, ["entity_id", "case_id"], "left").withColumn("risk", F.coalesce("risk", F.lit(0).cast("long"))))


def samples(spark: SparkSession, sf_dir: str, n: int = 100, n_controls: int = 60, per_analyst: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Population, targeted cases and controls."""
    population = finding_risks(spark, sf_dir)
    targeted = shared.kept(sampling.capped(sampling.proportional(population, n), per_analyst))
    frame = sampling.complement(population, targeted, list(DEFAULT.sla_s))
    take = sampling.allocation(frame.groupBy("stratum").agg(F.count("*").alias("size")), n_controls)
    return population, targeted, sampling.controls(frame, take, "s")


@query()
def capped_targeted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases drawn in proportion to the risk of their findings, at most three of an analyst."""
    return samples(spark, sf_dir)[1].select("entity_id", "case_id", "analyst", "risk", F.round("pi", 8).alias("pi"))


@query()
def complement_control_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls of each severity among the cases that were not targeted, in largest-remainder numbers."""
    return samples(spark, sf_dir)[2].select("entity_id", "case_id", "stratum", "take", "n_stratum", F.round("pi", 8).alias("pi"))


@query()
def stratified_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prevalence of cases with findings from both samples, with an interval."""
    population, targeted, controls = samples(spark, sf_dir)
    y = (F.col("risk") > 0).cast("double")
    return sampling.estimate(targeted.withColumn("y", y), controls.withColumn("y", y), population)


@query()
def outlier_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out isolation scores of entities from their closure time and thin-note share."""
    v = indicator_values(spark, sf_dir, "eg01", "eg02")
    rows = v["eg01"].select("entity_id", F.col("value").alias("closure")).join(v["eg02"].select("entity_id", F.col("value").alias("thin")), "entity_id", "full_outer").join(a.entities(spark, sf_dir).select("entity_id", "cohort"), "entity_id")
    return anomaly.isolation(rows, ["closure", "thin"])


@query()
def rank_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far entity ranks move when scores vary."""
    scores = yearly(spark, sf_dir).filter("year = 1996").select("entity_id", "score")
    return anomaly.rank_intervals(scores)


@query("WITH r AS (SELECT o_orderkey % 40 AS run_id, min(o_orderdate) AS a, max(o_orderdate) AS b, count(*) FILTER (o_orderpriority LIKE '1%') AS n_findings FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT run_id, n_findings FROM r WHERE a <= TIMESTAMP '1996-01-01' AND b >= TIMESTAMP '1996-12-31'")
def runs_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose window holds the asked period, with their finding counts."""
    o = a.table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    r = o.groupBy((F.col("o_orderkey") % 40).alias("run_id")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.count(F.when(F.col("o_orderpriority").startswith("1"), 1)).alias("n_findings"))
    return r.filter((F.col("a") <= F.lit("1996-01-01").cast("timestamp")) & (F.col("b") >= F.lit("1996-12-31").cast("timestamp"))).select("run_id", "n_findings")


# --- projections and checks over submissions ---


@query(f"WITH {a.RAW}, h AS (SELECT ['case_ref', 'severity_raw', 'note_raw'] AS headers), p AS (SELECT * FROM (VALUES ('cases', ['case_ref', 'severity_raw', 'opened_raw']), ('notes', ['note_raw', 'author']), ('assets', ['asset_id'])) AS t(block, sources)) SELECT block, round(len(list_intersect(headers, sources)) / len(sources), 6) AS share, len(list_intersect(headers, sources)) / len(sources) >= 0.5 AS matched, (SELECT count(*) FROM raw) AS n_rows FROM h CROSS JOIN p")
def profile_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the submission's filled columns fit each vendor profile; a half is the floor."""
    raw = a.raw_submission(spark, sf_dir)
    profiles = {"cases": ["case_ref", "severity_raw", "opened_raw"], "notes": ["note_raw", "author"], "assets": ["asset_id"]}
    columns = ["case_ref", "severity_raw", "note_raw"]
    filled = raw.agg(F.count("*").alias("n_rows"), F.array_compact(F.array(*(F.when(F.count(c) > 0, c) for c in columns))).alias("headers"))
    blocks = F.array(*(F.struct(F.lit(k).alias("block"), F.array(*map(F.lit, v)).alias("sources")) for k, v in profiles.items()))
    share = F.size(F.array_intersect("headers", "sources")) / F.size("sources")
    return filled.select("n_rows", "headers", F.inline(blocks)).select("block", F.round(share, 6).alias("share"), (share >= 0.5).alias("matched"), "n_rows")


@query(f"WITH {a.CASES}, s AS (SELECT entity_id, year, min(created_s) AS ps, max(created_s) AS pe, count(*) AS version FROM cases GROUP BY ALL) SELECT entity_id, max_by(year, (version, year)) AS year, max(version) AS version FROM s WHERE ps <= epoch(TIMESTAMP '1997-06-30') AND pe >= epoch(TIMESTAMP '1996-01-01') GROUP BY entity_id")
def covering_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submission of the highest version among those that overlap a period."""
    s = a.cases(spark, sf_dir).groupBy("entity_id", "year").agg(F.min("created_s").alias("ps"), F.max("created_s").alias("pe"), F.count("*").alias("version"))
    hit = s.filter((F.col("ps") <= F.unix_timestamp(F.lit("1997-06-30 00:00:00"))) & (F.col("pe") >= F.unix_timestamp(F.lit("1996-01-01 00:00:00"))))
    return hit.groupBy("entity_id").agg(F.max_by("year", F.struct("version", "year")).alias("year"), F.max("version").alias("version"))


@query(f"WITH {a.ENTITIES}, {YEAR}, v AS ({VALUES['eg02']} UNION ALL {VALUES['eg08']}) SELECT entity_id, round(sum(value * n) / sum(n), 6) AS weighted, sum(n) AS n FROM v GROUP BY entity_id")
def weighted_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures weighted by their populations."""
    v = indicator_values(spark, sf_dir, "eg02", "eg08")
    rows = v["eg02"].select("entity_id", "value", "n").unionByName(v["eg08"].select("entity_id", "value", "n"))
    return rows.groupBy("entity_id").agg(F.round(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 6).alias("weighted"), F.sum("n").alias("n"))


@query("SELECT l_suppkey AS entity_id, l_linenumber AS slot, count(*) AS n, count(DISTINCT l_orderkey) AS n_records, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY ALL")
def evidence_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distinct records and means by entity and slot."""
    return a.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity_id"), F.col("l_linenumber").alias("slot")).agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_records"), F.round(F.avg("l_quantity"), 4).alias("mean"))


@query(f"WITH {a.RAW} SELECT analyst_raw, CASE WHEN lower(analyst_raw) LIKE 'user%' THEN 'human' WHEN lower(analyst_raw) IN ('soar', 'bot') THEN 'automation' ELSE 'unknown' END AS actor_type, count(*) AS n FROM raw GROUP BY ALL")
def actor_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether analysts look like people or automation; always inferred."""
    c = F.lower("analyst_raw")
    kind = F.when(c.startswith("user"), "human").when(c.isin("soar", "bot"), "automation").otherwise("unknown")
    return a.raw_submission(spark, sf_dir).groupBy("analyst_raw", kind.alias("actor_type")).agg(F.count("*").alias("n"))


DIMENSIONS = {"eg01": "investigation", "eg02": "investigation", "eg06": "escalation", "eg08": "timeliness", "eg09": "timeliness"}
_DIM = "CASE indicator " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DIMENSIONS.items()) + " END"
_DIMENSION_SQL = f"{FDR}, dm AS (SELECT entity_id, {_DIM} AS dimension, family, max(CASE WHEN survives THEN greatest(0.0, least(1.0, (effect - 2.0) / 3.0)) * confidence ELSE 0.0 END) AS score FROM f GROUP BY ALL), ds AS (SELECT entity_id, dimension, round(1 - exp(sum(ln(1 - 0.6 * least(score, 0.6)))), 4) AS score FROM dm GROUP BY ALL)"


def _dimension_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scoring.false_discovery(effects(spark, sf_dir))
    dimension = F.create_map(*(F.lit(x) for kv in DIMENSIONS.items() for x in kv))[F.col("indicator")]
    signal = F.when(F.col("survives"), scoring.ramp(F.col("effect")) * F.col("confidence")).otherwise(0.0)
    family = f.groupBy("entity_id", dimension.alias("dimension"), "family").agg(F.max(signal).alias("s"))
    return family.groupBy("entity_id", "dimension").agg(F.round(1 - F.exp(F.sum(F.log(1 - 0.6 * F.least("s", F.lit(DEFAULT.family_cap))))), 4).alias("score"))


@query(f"{_DIMENSION_SQL} SELECT * FROM ds")
def dimension_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped noisy-or over families in each dimension."""
    return _dimension_scores(spark, sf_dir)


@query(f"{_DIMENSION_SQL}, w AS (SELECT *, CASE dimension WHEN 'investigation' THEN 0.5 WHEN 'escalation' THEN 0.3 ELSE 0.2 END AS w FROM ds) SELECT entity_id, round(sum(w * score) / sum(w), 4) AS priority, round(count(*) / 3.0, 4) AS measurable_share, count(*) / 3.0 >= 0.5 AS published FROM w GROUP BY entity_id")
def audit_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean over scored dimensions; withheld where too few can be measured."""
    w = F.when(F.col("dimension") == "investigation", 0.5).when(F.col("dimension") == "escalation", 0.3).otherwise(0.2)
    rows = _dimension_scores(spark, sf_dir).withColumn("w", w)
    share = F.count("*") / 3.0
    return rows.groupBy("entity_id").agg(F.round(F.sum(F.col("w") * F.col("score")) / F.sum("w"), 4).alias("priority"), F.round(share, 4).alias("measurable_share"), (share >= 0.5).alias("published"))
