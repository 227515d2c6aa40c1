"""Queries of review and follow-up: evidence, findings, packs, verdicts, trends, policies, notes, quality and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions import scalars
from vigil.operators import indicators as ind
from vigil.operators import scoring, trends
from vigil.operators.sequences import Ordered
from vigil.plans import adapters as a
from vigil.plans import assembly
from vigil.plans import catalogue as c
from vigil.plans import shared, submissions
from vigil.plans.catalogue import query
from vigil.sources import files

# --- trends and policies ---


@query(f"""{c.YEARLY}, l AS (SELECT entity_id, list(score ORDER BY year) AS s, list(year ORDER BY year) AS y FROM y GROUP BY entity_id HAVING count(*) >= 6),
 m AS (SELECT *, unnest(range(3, len(s) - 2)) AS k FROM l), q AS (SELECT entity_id, y[k + 1] AS period, list_aggregate(s[1:k], 'median') AS b, list_aggregate(s[k + 1:], 'median') AS f, k, len(s) - k AS r, list_aggregate(s, 'var_pop') * len(s) AS whole, list_aggregate(s[1:k], 'var_pop') * k + list_aggregate(s[k + 1:], 'var_pop') * (len(s) - k) AS parts FROM m),
 x AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY round((whole - parts) / whole, 9) DESC, period) AS p FROM q WHERE whole > 0 AND abs(f - b) >= 0.1 AND (whole - parts) / whole >= 0.2)
 SELECT entity_id AS series, period, CASE WHEN f > b THEN 'up' ELSE 'down' END AS direction, round(b, 6) AS before, round(f, 6) AS after, k AS n_before, r AS n_after FROM x WHERE p = 1""")
def regime_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of each entity's yearly scores; with seven years no part is long enough for a second one."""
    rows = c.yearly(spark, sf_dir).select(F.col("entity_id").cast("string").alias("series"), F.col("year").alias("period"), F.col("score").alias("value"))
    return trends.segments(rows).withColumn("series", F.col("series").cast("long"))


@query()
def monthly_regime_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of each entity's monthly scores, each part split again; recursion is beyond SQL, tests compare by hand."""
    li, o = (a.table(spark, sf_dir, t) for t in ("lineitem", "orders"))
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("l_suppkey").cast("string").alias("series"), month.alias("period"))
    return trends.segments(rows.agg(F.avg(((F.col("l_returnflag") == "R") | F.expr(a.LATE_DISMISSALS)).cast("double")).alias("value")))


def _two_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = c.effects(spark, sf_dir).select("entity_id", "indicator", "effect", "confidence")
    raised = F.when(F.col("indicator") == "eg08", F.col("effect") + 0.5).otherwise(F.col("effect"))
    new = e.withColumn("effect", raised).withColumn("confidence", F.col("confidence") * 0.75).filter("effect >= 2.1")
    return trends.finding_changes(e.filter("effect >= 2"), new)


_CHANGES = f"{c.EFFECTS}, o AS (SELECT entity_id, indicator, effect, confidence FROM l WHERE effect >= 2), n AS (SELECT * FROM (SELECT entity_id, indicator, CASE WHEN indicator = 'eg08' THEN effect + 0.5 ELSE effect END AS effect, confidence * 0.75 AS confidence FROM l) WHERE effect >= 2.1), ch AS (SELECT entity_id, indicator, o.effect AS eb, n.effect AS ea, CASE WHEN o.effect IS NULL THEN 'added' WHEN n.effect IS NULL THEN 'removed' WHEN abs(n.effect - o.effect) > 1e-9 OR abs(n.confidence - o.confidence) > 1e-9 THEN 'changed' ELSE 'same' END AS change, coalesce(o.effect IS NOT NULL AND n.effect - o.effect > 1e-9 OR abs(n.effect - o.effect) <= 1e-9 AND n.confidence - o.confidence > 1e-9, FALSE) AS worse FROM o FULL JOIN n USING (entity_id, indicator))"


@query(f"{_CHANGES} SELECT entity_id, indicator, change, worse FROM ch")
def policy_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that another policy adds, removes or changes, and whether for the worse."""
    return _two_policies(spark, sf_dir).select("entity_id", "indicator", "change", F.coalesce("worse", F.lit(False)).alias("worse"))


@query(f"{_CHANGES} SELECT count(*) FILTER (change = 'added') AS n_added, count(*) FILTER (change = 'removed') AS n_removed, count(*) FILTER (change = 'changed') AS n_changed, count(*) FILTER (worse) AS n_worse, CASE WHEN count(*) FILTER (change = 'added' OR worse) > 0 THEN 'hold' ELSE 'promote' END AS verdict FROM ch")
def policy_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the other policy may be promoted."""
    return trends.recommendation(_two_policies(spark, sf_dir)).drop("worst")


@query()
def effect_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided p of each effect, for display; there is no error function in SQL."""
    return c.effects(spark, sf_dir).select("entity_id", "indicator", F.round(trends.normal_p("effect"), 8).alias("p"))


@query(f"WITH {c.YEAR}, v AS (SELECT 'eg01' AS indicator, * FROM ({c.VALUES['eg01']}) UNION ALL SELECT 'eg08', * FROM ({c.VALUES['eg08']})) SELECT indicator, entity_id, round(value, 5) AS value, n FROM v")
def restricted_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the named indicators; their branches alone are planned."""
    values = c.indicator_values(spark, sf_dir, "eg01", "eg08")
    return reduce(DataFrame.unionByName, (v.select(F.lit(k).alias("indicator"), "entity_id", F.round("value", 5).alias("value"), "n") for k, v in values.items()))


@query(f"WITH {c.YEAR}, h AS (SELECT entity_id, sha256(count(*) || '|' || sum(created_s)) AS h FROM c GROUP BY entity_id) SELECT sha256(string_agg(h, ',' ORDER BY h)) AS inputs_hash, sha256('q=0.05;z0=2.0;z1=5.0') AS policy_hash, count(*) AS n_entities FROM h")
def run_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run was made of: the sorted hashes of its submissions (one per entity) and of its policy."""
    h = c.year_cases(spark, sf_dir).groupBy("entity_id").agg(F.sha2(F.concat_ws("|", F.count("*"), F.sum("created_s")), 256).alias("h"))
    p = c.DEFAULT
    return h.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("inputs_hash"), F.sha2(F.lit(f"q={p.fdr_q};z0={p.ramp_z0};z1={p.ramp_z1}"), 256).alias("policy_hash"), F.count("*").alias("n_entities"))


# --- evidence, packs, verdicts ---


@query(f"WITH {assembly.RESULTS[assembly.RESULTS.index('entities AS'):]}, s AS (SELECT DISTINCT indicator, entity_id, row_id FROM er WHERE indicator <> 'eg11'), t AS (SELECT * FROM s WHERE NOT (indicator = 'eg01' AND CAST(split_part(row_id, '-', 1) AS BIGINT) % 97 = 0)) SELECT indicator, entity_id, count(*) AS n_now, count(t.row_id) AS n_stored, count(*) = count(t.row_id) AS reproduced FROM s LEFT JOIN t USING (indicator, entity_id, row_id) GROUP BY ALL")
def reproduced_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored evidence ids against those that the evidence gives now, per finding; some stored ids of EG-01 are gone."""
    now = shared.kept(c.evidence(spark, sf_dir).distinct())
    stored = now.filter(~((F.col("indicator") == "eg01") & (F.substring_index("row_id", "-", 1).cast("long") % 97 == 0))).withColumn("kept", F.lit(1))
    both = now.join(stored, ["indicator", "entity_id", "row_id"], "full_outer")
    return both.groupBy("indicator", "entity_id").agg(F.count("*").alias("n_now"), F.count("kept").alias("n_stored"), (F.count("*") == F.count("kept")).alias("reproduced"))


@query(f"WITH {assembly.RESULTS[assembly.RESULTS.index('entities AS'):]}, s AS (SELECT DISTINCT indicator, entity_id, row_id FROM er WHERE indicator <> 'eg11') SELECT indicator, entity_id, row_id, row_number() OVER (PARTITION BY indicator, entity_id ORDER BY row_id) AS ordinal FROM s QUALIFY ordinal <= 20")
def evidence_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows behind each value, with their place; the limit is that of the display."""
    w = Window.partitionBy("indicator", "entity_id").orderBy("row_id")
    return c.evidence(spark, sf_dir).distinct().withColumn("ordinal", F.row_number().over(w)).filter("ordinal <= 20")


@query(f"WITH {assembly.STATUS} SELECT entity_id, indicator, round(least(1.0, n / 30), 4) AS n_term, CASE WHEN state = 'ASSESSABLE' AND entity_id % 13 <> 0 THEN 1.0 ELSE 0.5 END AS assessability_term, coalesce(CASE WHEN entity_id % 13 <> 0 THEN round((5 + entity_id % 95) / 100, 2) END, 0.5) AS trust_term, upper(indicator) || ': ' || n || ' observations, ' || lower(state) AS summary FROM st WHERE raised")
def finding_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding with the three terms of its confidence and a summary in words."""
    rows = assembly.results(spark, sf_dir)
    st = assembly.statuses(spark, sf_dir, rows).filter("raised").join(rows.select("entity_id", "indicator", "dq_score"), ["entity_id", "indicator"])
    full = F.when((F.col("state") == "ASSESSABLE") & F.col("dq_score").isNotNull(), 1.0).otherwise(0.5)
    summary = F.concat(F.upper("indicator"), F.lit(": "), F.col("n").cast("string"), F.lit(" observations, "), F.lower("state"))
    return st.select("entity_id", "indicator", F.round(F.least(F.lit(1.0), F.col("n") / 30), 4).alias("n_term"), full.alias("assessability_term"), F.coalesce("dq_score", F.lit(0.5)).alias("trust_term"), summary.alias("summary"))


@query(f"WITH {assembly.RESULTS[assembly.RESULTS.index('entities AS'):]}, s AS (SELECT DISTINCT indicator, entity_id, row_id FROM er WHERE indicator <> 'eg11') SELECT indicator, entity_id, row_id, row_number() OVER (PARTITION BY indicator, entity_id ORDER BY row_id) AS ordinal FROM s")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows behind each value, with their place; an entity with most of the rows is no single task."""
    return numbered_evidence(spark, sf_dir)


def numbered_evidence(spark: SparkSession, sf_dir: str, cases: DataFrame | None = None) -> DataFrame:
    return Ordered(c.evidence(spark, sf_dir, cases).distinct(), ["indicator", "entity_id"], ["row_id"]).numbered("ordinal")


# What an examiner does first about a finding of each family.
ACTIONS = {"closure_quality": "read the notes of the fastest closures", "escalation": "ask for the escalation records", "timing": "compare closure times with the log"}
_EVERY = " UNION ALL ".join(f"SELECT '{k}' AS indicator, entity_id, value, n, med, mad, n_peers, below, effect FROM e_{k}" for k in c.SIGNS)
_ACTIONS_SQL = "CASE family " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items()) + " END"
_EVIDENCE_SQL = c.ORACLE_SQL["evidence_hashes"]
_ROWS_SQL = _EVIDENCE_SQL[_EVIDENCE_SQL.index("e AS (SELECT DISTINCT") : _EVIDENCE_SQL.rindex("SELECT indicator, entity_id, count(*)")].strip()
_ROWS_SQL = _ROWS_SQL.replace("e AS (SELECT DISTINCT", "esc AS (SELECT DISTINCT", 1).replace("ANTI JOIN e USING", "ANTI JOIN esc USING").replace(" r AS (", " er AS (", 1)


@query(f"""{c.FDR}, {_ROWS_SQL}, b AS ({_EVERY}), fi AS (SELECT * FROM f WHERE survives AND effect > 2),
 er2 AS (SELECT indicator, entity_id, count(DISTINCT row_id) AS n_rows FROM er GROUP BY ALL),
 t AS (SELECT fi.entity_id, fi.indicator, fi.family, b.value, b.n, b.med, b.mad, b.n_peers, 100 * b.below / b.n_peers AS percentile, fi.effect, fi.confidence, least(1.0, b.n / 30) AS n_term, least(1.0, b.n_peers / 8) AS peer_term, coalesce(n_rows, 0) AS n_rows,
   (SELECT count(*) FROM fi o WHERE o.entity_id = fi.entity_id AND o.family <> fi.family) AS n_independent, (SELECT count(*) FROM fi o WHERE o.entity_id = fi.entity_id AND o.family = fi.family AND o.indicator <> fi.indicator) AS n_same_family
  FROM fi JOIN b USING (entity_id, indicator) LEFT JOIN er2 USING (entity_id, indicator))
 SELECT entity_id, indicator, round(value, 5) AS value, n, round(med, 5) AS peer_median, round(mad, 5) AS peer_mad, round(percentile, 4) AS percentile, n_peers, effect, round(confidence, 4) AS confidence,
  CASE WHEN n_term >= 1 AND peer_term >= 1 THEN 'none' WHEN n_term <= peer_term THEN 'observations' ELSE 'peers' END AS limiting_term,
  array_to_string(list_filter([CASE WHEN n < 30 THEN 'few observations' END, CASE WHEN n_peers < 8 THEN 'thin cohort' END, CASE WHEN mad = 0 THEN 'peers do not vary' END], lambda x: x IS NOT NULL), '; ') AS caveats,
  n_rows AS n_evidence, n_independent, n_same_family, {_ACTIONS_SQL} AS action, sha256('run1|' || entity_id || '|' || indicator || '|q=0.05;z0=2.0;z1=5.0') AS lineage FROM t""")
def full_finding_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding with its baseline, the term that limits its confidence, caveats, evidence, what corroborates it, the first action
    and its lineage."""
    cases = c.kept_cases(spark, sf_dir)
    base = shared.kept(c.baselines(spark, sf_dir, cases))
    effects = base.select("entity_id", "indicator", "family", c.four_digits("effect").alias("effect"), F.least(F.lit(1.0), F.col("n") / c.DEFAULT.full_confidence_n).alias("confidence"))
    found = scoring.false_discovery(effects).filter(F.col("survives") & (scoring.ramp(F.col("effect")) > 0)).select("entity_id", "indicator", "effect", "confidence")
    card = found.join(base.drop("effect"), ["entity_id", "indicator"])
    rows = c.evidence(spark, sf_dir, cases).join(found.select("entity_id", "indicator"), ["entity_id", "indicator"], "left_semi").distinct().groupBy("indicator", "entity_id").agg(F.count("*").alias("n_rows"))
    other = card.groupBy("entity_id", F.col("family").alias("f")).agg(F.count("*").alias("k"))
    sums = card.select("entity_id", "indicator", "family").join(other, "entity_id").groupBy("entity_id", "indicator").agg(
        F.coalesce(F.sum(F.when(F.col("f") != F.col("family"), F.col("k"))), F.lit(0)).alias("n_independent"), (F.sum(F.when(F.col("f") == F.col("family"), F.col("k"))) - 1).alias("n_same_family")
    )
    n_term, peer_term = F.least(F.lit(1.0), F.col("n") / c.DEFAULT.full_confidence_n), F.least(F.lit(1.0), F.col("n_peers") / c.DEFAULT.min_peers)
    limit = F.when((n_term >= 1) & (peer_term >= 1), "none").when(n_term <= peer_term, "observations").otherwise("peers")
    caveats = F.array_compact(F.array(F.when(F.col("n") < c.DEFAULT.full_confidence_n, "few observations"), F.when(F.col("n_peers") < c.DEFAULT.min_peers, "thin cohort"), F.when(F.col("mad") == 0, "peers do not vary")))
    action = F.create_map(*(F.lit(v) for kv in ACTIONS.items() for v in kv))[F.col("family")]
    p = c.DEFAULT
    lineage = F.sha2(F.concat_ws("|", F.lit("run1"), "entity_id", "indicator", F.lit(f"q={p.fdr_q};z0={p.ramp_z0};z1={p.ramp_z1}")), 256)
    out = card.join(rows, ["indicator", "entity_id"], "left").join(sums, ["entity_id", "indicator"])
    return out.select(
        "entity_id", "indicator", F.round("value", 5).alias("value"), "n", F.round("median", 5).alias("peer_median"), F.round("mad", 5).alias("peer_mad"), F.round("percentile", 4).alias("percentile"), "n_peers", "effect",
        F.round("confidence", 4).alias("confidence"), limit.alias("limiting_term"), F.array_join(caveats, "; ").alias("caveats"), F.coalesce("n_rows", F.lit(0)).alias("n_evidence"), "n_independent", "n_same_family", action.alias("action"), lineage.alias("lineage"),
    )


@query("WITH r AS (SELECT o_custkey % 100 AS entity_id, o_orderkey AS run_id, o_orderdate AS created FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1998-01-01'), n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created DESC, run_id DESC) AS p FROM r) SELECT entity_id, run_id, count(l_orderkey) AS n_findings FROM n LEFT JOIN lineitem ON l_orderkey = run_id AND l_linenumber > 1 WHERE p = 1 GROUP BY ALL")
def newest_run_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each entity's newest completed run in the window, without leads."""
    runs = a.table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")))
    newest = runs.groupBy((F.col("o_custkey") % 100).alias("entity_id")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("run_id"))
    found = a.table(spark, sf_dir, "lineitem").filter("l_linenumber > 1").select(F.col("l_orderkey").alias("run_id"), F.lit(1).alias("f"))
    return newest.join(found, "run_id", "left").groupBy("entity_id", "run_id").agg(F.count("f").alias("n_findings"))


_FOUND = f"{c.FDR}, {c.ORACLE_SQL['evidence_hashes'][c.ORACLE_SQL['evidence_hashes'].index('e AS (SELECT DISTINCT'):c.ORACLE_SQL['evidence_hashes'].rindex('SELECT indicator, entity_id, count(*)')].strip().replace('e AS (SELECT DISTINCT', 'esc AS (SELECT DISTINCT', 1).replace('ANTI JOIN e USING', 'ANTI JOIN esc USING').replace(' r AS (', ' er AS (', 1)}, fi AS (SELECT entity_id, indicator, effect, confidence FROM f WHERE survives AND effect > 2), att AS (SELECT DISTINCT entity_id, indicator, row_id FROM er WHERE indicator <> 'eg11'), rk AS (SELECT entity_id, row_id AS case_id, array_to_string(list_sort(list(indicator)), ',') AS indicators, CAST(round(sum(confidence * effect) * 1000000) AS BIGINT) AS risk FROM att JOIN fi USING (entity_id, indicator) GROUP BY ALL)"


def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = c.kept_cases(spark, sf_dir)
    found = scoring.false_discovery(c.effects(spark, sf_dir, cases)).filter(F.col("survives") & (scoring.ramp(F.col("effect")) > 0)).select("entity_id", "indicator", (F.col("confidence") * F.col("effect")).alias("w"))
    rows = c.evidence(spark, sf_dir, cases).join(F.broadcast(found), ["entity_id", "indicator"]).distinct()  # findings: a few per entity
    return rows.groupBy("entity_id", F.col("row_id").alias("case_id")).agg(F.array_join(F.sort_array(F.collect_list("indicator")), ",").alias("indicators"), F.round(F.sum("w") * 1_000_000).cast("long").alias("risk"))


@query(f"{_FOUND} SELECT entity_id, case_id, indicators, round(risk / 1000000, 3) AS risk FROM rk")
def attached_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with the findings whose evidence they are."""
    return _attached(spark, sf_dir).withColumn("risk", F.round(F.col("risk") / 1_000_000, 3))


_ITEMS = f"{_FOUND}, it AS (SELECT entity_id, case_id, indicators, round(risk / 1000000, 3) AS risk, row_number() OVER (ORDER BY round(risk / 1000000, 3) DESC, entity_id, case_id) AS place FROM rk QUALIFY place <= 50)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty cases of most risk; the number is that of the pack."""
    top = shared.kept(attached_findings(spark, sf_dir).orderBy(F.desc("risk"), "entity_id", "case_id").limit(50))
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("risk"), "entity_id", "case_id")))


@query(f"{_ITEMS} SELECT place, entity_id, case_id, 'case ' || case_id || ' of entity ' || entity_id || ' stands behind ' || indicators AS reason FROM it")
def pack_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.concat(F.lit("case "), "case_id", F.lit(" of entity "), F.col("entity_id").cast("string"), F.lit(" stands behind "), "indicators")
    return _items(spark, sf_dir).select("place", "entity_id", "case_id", reason.alias("reason"))


@query(f"{_ITEMS} SELECT count(*) AS n_items, sha256(coalesce(string_agg(entity_id || '|' || case_id || '|' || indicators, ',' ORDER BY place), '')) AS content_hash FROM it")
def pack_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of a pack's items in their order."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat_ws("|", "entity_id", "case_id", "indicators").alias("t")))), lambda x: x["t"])
    return _items(spark, sf_dir).agg(F.count("*").alias("n_items"), F.sha2(F.array_join(rows, ","), 256).alias("content_hash"))


_VERDICTS = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'confirmed' WHEN '2' THEN 'benign' ELSE 'insufficient_information' END"


@query(f"SELECT o_custkey AS case_id, max_by({_VERDICTS}, (o_orderdate, o_orderkey)) AS verdict, count(*) AS n_verdicts FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY o_custkey")
def latest_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest verdict on each selected case; verdicts on others are not accepted."""
    chosen = a.table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("case_id"))
    p = F.substring("o_orderpriority", 1, 1)
    verdict = F.when(p == "1", "confirmed").when(p == "2", "benign").otherwise("insufficient_information")
    rows = a.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), verdict.alias("verdict"), "o_orderdate", "o_orderkey")
    return rows.join(chosen, "case_id", "left_semi").groupBy("case_id").agg(F.max_by("verdict", F.struct("o_orderdate", "o_orderkey")).alias("verdict"), F.count("*").alias("n_verdicts"))


@query(f"{_ITEMS}, vd AS (SELECT l_suppkey AS entity_id, l_orderkey || '-' || l_linenumber AS case_id, max({_VERDICTS}) AS verdict FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 25 GROUP BY ALL) SELECT entity_id, count(*) AS n_items, count(verdict) AS n_judged, string_agg(case_id || ':' || coalesce(verdict, 'open'), ';' ORDER BY place) AS items FROM it LEFT JOIN vd USING (entity_id, case_id) GROUP BY entity_id")
def review_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pack's items of each entity with their verdicts, as one record."""
    items, key = _items(spark, sf_dir), F.concat_ws("-", "l_orderkey", "l_linenumber")
    li = a.table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select("l_orderkey", F.col("l_suppkey").alias("entity_id"), key.alias("case_id"))
    li = li.join(F.broadcast(items.select("entity_id", "case_id")), ["entity_id", "case_id"], "left_semi")  # lines of the pack's fifty items
    o = a.table(spark, sf_dir, "orders")
    p = F.substring("o_orderpriority", 1, 1)
    verdict = F.when(p == "1", "confirmed").when(p == "2", "benign").otherwise("insufficient_information")
    vd = F.broadcast(shared.kept(li)).join(o, F.col("l_orderkey") == o.o_orderkey).groupBy("entity_id", "case_id").agg(F.max(verdict).alias("verdict"))
    rows = items.join(vd, ["entity_id", "case_id"], "left").withColumn("t", F.concat(F.col("case_id"), F.lit(":"), F.coalesce("verdict", F.lit("open"))))
    return rows.groupBy("entity_id").agg(F.count("*").alias("n_items"), F.count("verdict").alias("n_judged"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "t"))), lambda x: x["t"]), ";").alias("items"))


@query(f"WITH {a.ENTITIES} SELECT o_orderkey AS submission_id, name, strftime(o_orderdate, '%Y-%m-%d') AS received FROM orders JOIN entities ON entity_id = o_custkey % 100 WHERE entity_id IN (3, 5) ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 5")
def submission_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions of chosen entities, newest first, one page; the limit is the feature."""
    o = a.table(spark, sf_dir, "orders").withColumn("entity_id", F.col("o_custkey") % 100).filter(F.col("entity_id").isin(3, 5))
    rows = o.join(a.entities(spark, sf_dir).select("entity_id", "name"), "entity_id").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(5).limit(20)
    return rows.select(F.col("o_orderkey").alias("submission_id"), "name", F.date_format("o_orderdate", "yyyy-MM-dd").alias("received"))


@query("WITH r AS (SELECT o_orderkey % 40 AS run_id, min(o_orderdate) AS a, max(o_orderdate) AS b, max(o_orderkey) AS created FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT run_id FROM r WHERE a <= TIMESTAMP '1996-01-01' AND b >= TIMESTAMP '1996-12-31' ORDER BY created DESC, run_id LIMIT 1")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest completed run whose window holds the asked period."""
    o = a.table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    r = o.groupBy((F.col("o_orderkey") % 40).alias("run_id")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.max("o_orderkey").alias("created"))
    hit = r.filter((F.col("a") <= F.lit("1996-01-01").cast("timestamp")) & (F.col("b") >= F.lit("1996-12-31").cast("timestamp")))
    return hit.agg(F.max_by("run_id", F.struct("created", (-F.col("run_id")).alias("m"))).alias("run_id"))


_PAYLOAD = "WITH e AS (SELECT event_id AS seq, user_id % 20 AS chain, event_type, sha256(event_type || '|' || event_id) AS payload_hash FROM events), h AS (SELECT *, sha256(seq || '|' || payload_hash) AS entry FROM e), s AS (SELECT *, lag(entry) OVER (PARTITION BY chain ORDER BY seq) AS prev FROM h), t AS (SELECT *, CASE WHEN seq % 997 = 5 THEN 'x' ELSE prev END AS sp, CASE WHEN seq % 991 = 7 THEN 'x' ELSE payload_hash END AS sh, CASE WHEN seq % 983 = 11 THEN 'x' ELSE entry END AS se FROM s)"


@query(f"{_PAYLOAD}, b AS (SELECT chain, seq, CASE WHEN sh <> payload_hash THEN 'payload' WHEN se <> sha256(seq || '|' || sh) THEN 'entry' WHEN prev IS NOT NULL AND sp <> prev THEN 'link' END AS kind FROM t) SELECT chain, min(seq) AS first_break, count(*) FILTER (kind = 'payload') AS n_payload, count(*) FILTER (kind = 'entry') AS n_entry, count(*) FILTER (kind = 'link') AS n_link FROM b WHERE kind IS NOT NULL GROUP BY chain")
def ledger_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks of each chain: payloads that do not match their hash, entries that do not match theirs, and wrong links."""
    e = a.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 20).alias("chain"), F.sha2(F.concat_ws("|", "event_type", "event_id"), 256).alias("payload_hash"))
    h = e.withColumn("entry", F.sha2(F.concat_ws("|", "seq", "payload_hash"), 256)).withColumn("prev", F.lag("entry").over(Window.partitionBy("chain").orderBy("seq")))
    stated = lambda k, r, x: F.when(F.col("seq") % k == r, F.lit("x")).otherwise(F.col(x))
    t = h.withColumns({"sp": stated(997, 5, "prev"), "sh": stated(991, 7, "payload_hash"), "se": stated(983, 11, "entry")})
    kind = F.when(F.col("sh") != F.col("payload_hash"), "payload").when(F.col("se") != F.sha2(F.concat_ws("|", "seq", "sh"), 256), "entry").when(F.col("prev").isNotNull() & (F.col("sp") != F.col("prev")), "link")
    n = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}")
    return t.withColumn("kind", kind).filter("kind is not null").groupBy("chain").agg(F.min("seq").alias("first_break"), n("payload"), n("entry"), n("link"))


# --- notes ---

_COSINE = f"""{c._SHINGLED}, bk AS (SELECT source, band, signature, min(doc_id) AS anchor, count(*) AS n FROM bd GROUP BY ALL HAVING count(*) > 1),
 mb AS (SELECT bd.source, bd.band, bk.anchor, bk.n, bd.doc_id FROM bd JOIN bk USING (source, band, signature)),
 tk AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}')) AS term FROM documents) GROUP BY ALL),
 hr AS (SELECT mb.*, term, tf FROM mb JOIN tk USING (doc_id)), dfq AS (SELECT source, band, anchor, term, count(*) AS df FROM hr GROUP BY ALL),
 wq AS (SELECT hr.*, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM hr JOIN dfq USING (source, band, anchor, term)), w0 AS (SELECT source, band, anchor, term, w AS w0 FROM wq WHERE doc_id = anchor),
 cs AS (SELECT source, band, anchor, doc_id, sum(w * w0) AS dot, sum(w * w) AS q FROM wq LEFT JOIN w0 USING (source, band, anchor, term) GROUP BY ALL), q0 AS (SELECT source, band, anchor, sum(w0 * w0) AS q0 FROM w0 GROUP BY ALL),
 na AS (SELECT source AS entity, anchor, doc_id AS note, max(round(dot / sqrt(q * q0), 6)) AS cosine FROM cs JOIN q0 USING (source, band, anchor) WHERE round(dot / sqrt(q * q0), 6) >= 0.82 GROUP BY ALL)"""


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = a.table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    bands = shared.kept(trends.shared_bands(docs, "source", "doc_id", "text", tasks=shared.blocks(docs), kept=shared.kept))
    return trends.near_anchor(bands, docs, "source", "doc_id", "text", c.DEFAULT.similarity, shared.kept)


@query(f"{_COSINE} SELECT entity, anchor, note, round(cosine, 4) AS cosine FROM na")
def template_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that are close in weighted terms to the first note of a bucket they share."""
    return _near(spark, sf_dir).withColumn("cosine", F.round("cosine", 4))


@query(f"{_COSINE}, ow AS (SELECT entity, note, min(anchor) AS anchor FROM na GROUP BY ALL), nt AS (SELECT source AS entity, doc_id AS note, doc_id % 3 = 0 AS severe, lang AS analyst, doc_id % 50 = 0 AS template FROM documents), tt AS (SELECT entity, count(*) AS total FROM nt GROUP BY entity), cl AS (SELECT entity, anchor, count(*) AS n, avg(CASE WHEN severe THEN 1 ELSE 0 END) AS sv, bool_and(template) AS t, count(DISTINCT analyst) AS n_analysts, substr(sha256(string_agg(CAST(note AS VARCHAR), '|' ORDER BY note)), 1, 12) AS cluster_id FROM ow JOIN nt USING (entity, note) GROUP BY ALL) SELECT entity, cluster_id, n, round(n / total, 6) AS share, round(sv, 6) AS severe_share, n_analysts FROM cl JOIN tt USING (entity) WHERE n > 1 AND NOT t AND n / total >= 0.01")
def template_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of templated notes from one per cent of an entity's notes on (the given notes have small clusters)."""
    notes = a.table(spark, sf_dir, "documents").select(F.col("source").alias("entity"), F.col("doc_id").alias("note"), (F.col("doc_id") % 3 == 0).alias("severe"), F.col("lang").alias("analyst"), (F.col("doc_id") % 50 == 0).alias("template"))
    return trends.clusters(_near(spark, sf_dir), notes, share=0.01)


_ATTRIBUTED = c.ORACLE_SQL["all_feature_attributions"]


@query(f"WITH z AS ({_ATTRIBUTED}) SELECT entity_id, CASE WHEN sum(effect) > 0 THEN 'increases_risk' WHEN sum(effect) < 0 THEN 'decreases_risk' ELSE 'neutral' END AS direction, count(*) > 0 AS explainable FROM z GROUP BY entity_id")
def attribution_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the features that stand out push an entity's risk up or down."""
    total = F.sum("effect")
    return c.all_feature_attributions(spark, sf_dir).groupBy("entity_id").agg(F.when(total > 0, "increases_risk").when(total < 0, "decreases_risk").otherwise("neutral").alias("direction"), (F.count("*") > 0).alias("explainable"))


# --- data quality ---

_DQ = f"""WITH {submissions.MESSY}, {submissions._FATAL_SQL}, q AS (SELECT f.entity_id, count(*) AS n,
 (3 - avg(CASE WHEN {submissions._ABSENT.format('status_raw')} THEN 1 ELSE 0 END) - avg(CASE WHEN {submissions._ABSENT.format('link_raw')} THEN 1 ELSE 0 END) - avg(CASE WHEN {submissions._ABSENT.format('day_raw')} THEN 1 ELSE 0 END)) / 3 AS completeness,
 1 - (avg(CASE WHEN len(fatal) > 0 THEN 1 ELSE 0 END) + avg(CASE WHEN day_raw = 'x' THEN 1 ELSE 0 END) + avg(CASE WHEN status_raw = 'weird' THEN 1 ELSE 0 END)) / 2 AS validity,
 1 - count(*) FILTER (o_custkey % 17 = 0) / (count(*) FILTER (o_custkey % 17 = 0) + count(*)) AS consistency, 1 - (count(*) - count(DISTINCT o_custkey)) / count(*) AS uniqueness, max(o_orderdate) AS latest
 FROM f JOIN orders ON source_row = o_orderkey GROUP BY f.entity_id),
 t AS (SELECT *, (epoch(TIMESTAMP '1998-08-03') - epoch(latest)) / 86400 AS lag, entity_id * 5 AS sublag, (5 + entity_id % 4) / 8 AS mapping FROM q),
 u AS (SELECT *, 1 - ((CASE WHEN lag <= 0 THEN 0 WHEN lag <= 7 THEN 0.15 WHEN lag <= 30 THEN 0.5 ELSE 1 END) + (CASE WHEN sublag <= 0 THEN 0 WHEN sublag <= 45 THEN 0.2 ELSE 0.6 END)) / 2 AS timeliness FROM t)"""


@query(f"{_DQ} SELECT entity_id, round(completeness, 5) AS completeness, round(validity, 5) AS validity, round(timeliness, 5) AS timeliness, round(consistency, 5) AS consistency, round(uniqueness, 5) AS uniqueness, round(mapping, 5) AS mapping, round(greatest(0, least(1, 0.25 * completeness + 0.2 * validity + 0.15 * timeliness + 0.15 * consistency + 0.15 * uniqueness + 0.1 * mapping)), 4) AS dq_score FROM u")
def quality_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six components of each entity's submission quality, and their weighted score."""
    rows = submissions._judged(spark, sf_dir).join(a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_row"), "o_custkey", "o_orderdate"), "source_row")
    share = lambda cond: F.avg(F.when(cond, 1).otherwise(0))
    absent = lambda x: share(scalars.clean(F.col(x)).isNull())
    failed = lambda x, f: share(scalars.clean(F.col(x)).isNotNull() & f(F.col(x)).isNull())
    dangling = F.count(F.when(F.col("o_custkey") % 17 == 0, 1))
    q = rows.groupBy("entity_id").agg(
        ((3 - absent("status_raw") - absent("link_raw") - absent("day_raw")) / 3).alias("completeness"),
        (1 - (share(F.size("fatal") > 0) + failed("day_raw", scalars.day) + failed("status_raw", scalars.status)) / 2).alias("validity"),
        (1 - dangling / (dangling + F.count("*"))).alias("consistency"), (1 - (F.count("*") - F.countDistinct("o_custkey")) / F.count("*")).alias("uniqueness"), F.max("o_orderdate").alias("latest"),
    )
    lag = (F.unix_timestamp(F.lit("1998-08-03 00:00:00")) - F.unix_timestamp(F.col("latest").cast("timestamp"))) / 86400
    late = F.when(lag <= 0, 0.0).when(lag <= 7, 0.15).when(lag <= 30, 0.5).otherwise(1.0)
    sent = F.when(F.col("entity_id") * 5 <= 0, 0.0).when(F.col("entity_id") * 5 <= 45, 0.2).otherwise(0.6)
    q = q.withColumns({"timeliness": 1 - (late + sent) / 2, "mapping": (5 + F.col("entity_id") % 4) / 8})
    total = reduce(lambda x, y: x + y, (F.lit(w) * F.col(k) for k, w in c.DEFAULT.dq_weights.items()))
    names = ("completeness", "validity", "timeliness", "consistency", "uniqueness", "mapping")
    return q.select("entity_id", *(F.round(n, 5).alias(n) for n in names), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4).alias("dq_score"))


@query(f"WITH {assembly.FIELDS}, n AS (SELECT entity_id, max(CASE WHEN tbl = 'alert_record' AND declared THEN n_rows ELSE 0 END) AS a, max(CASE WHEN tbl = 'case_record' AND declared THEN n_rows ELSE 0 END) AS k, max(CASE WHEN tbl = 'case_event' AND declared THEN n_rows ELSE 0 END) AS e, max(CASE WHEN tbl = 'escalation' AND declared THEN n_rows ELSE 0 END) AS s, (entity_id % 100) / 100 AS dq FROM fl GROUP BY entity_id) SELECT entity_id, CASE WHEN a > 0 AND k > 0 THEN 'A' WHEN e > 0 AND s > 0 THEN 'B' ELSE 'C' END AS tier, CASE WHEN dq >= 0.85 THEN 'largely complete' WHEN dq >= 0.6 THEN 'subset' WHEN dq >= 0.35 THEN 'provisional' ELSE 'too incomplete' END AS reading FROM n")
def data_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest tier whose tables all have rows, and how far a quality score carries."""
    n = lambda t: F.max(F.when((F.col("tbl") == t) & F.col("declared"), F.col("n_rows")).otherwise(0)) > 0
    tier = F.when(n("alert_record") & n("case_record"), "A").when(n("case_event") & n("escalation"), "B").otherwise("C")
    dq = (F.col("entity_id") % 100) / 100
    reading = F.when(dq >= 0.85, "largely complete").when(dq >= 0.6, "subset").when(dq >= 0.35, "provisional").otherwise("too incomplete")
    return assembly.fields(spark, sf_dir).groupBy("entity_id").agg(tier.alias("tier")).withColumn("reading", reading)


# --- negative space, cohorts, evaluation ---

HOLIDAYS = ["2024-01-01", "2024-01-15", "2024-01-26"]
_SLOTS = f"{a.ALERTS}, hs AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS slot), sl AS (SELECT entity_id, slot, coalesce(n, 0) AS activity, entity_id % 10 = day(slot) % 10 AS maintenance FROM (SELECT DISTINCT entity_id FROM alerts) CROSS JOIN hs LEFT JOIN (SELECT user_id % 100 AS entity_id, date_trunc('hour', ts) AS slot, count(*) AS n FROM events GROUP BY ALL) USING (entity_id, slot))"


@query(f"WITH {_SLOTS}, j AS (SELECT *, CASE WHEN entity_id % 5 <> 4 THEN 8 + entity_id % 14 END AS o, (18 + entity_id % 14) % 24 AS z FROM sl) SELECT entity_id, round(avg(CASE WHEN activity <= 0 AND NOT maintenance THEN 1 ELSE 0 END), 6) AS value, count(*) AS n FROM j WHERE o IS NOT NULL AND (CASE WHEN o < z THEN hour(slot) >= o AND hour(slot) < z ELSE hour(slot) >= o OR hour(slot) < z END) AND isodow(slot) <= 5 AND CAST(slot AS DATE) NOT IN ({', '.join(f"DATE '{d}'" for d in HOLIDAYS)}) GROUP BY entity_id")
def ns03_quiet_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of declared working hours without activity; holidays come from a reference file with comments."""
    path = shared.folder(spark)
    spark.createDataFrame([("# days off,,",), ("date,name,scope",), *((f"{d},day,all",) for d in HOLIDAYS)], "value string").coalesce(1).write.text(path)
    al = a.table(spark, sf_dir, "events").select((F.col("user_id") % 100).alias("entity_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("slot"))
    hours = spark.sql("select explode(sequence(timestamp'2024-01-01 00:00:00', timestamp'2024-01-30 23:00:00', interval 1 hour)) as slot")
    grid = al.select("entity_id").distinct().crossJoin(F.broadcast(hours)).join(al.groupBy("entity_id", "slot").agg(F.count("*").alias("n")), ["entity_id", "slot"], "left")  # the calendar
    e = F.col("entity_id")
    slots = grid.select("entity_id", "slot", F.coalesce("n", F.lit(0)).alias("activity"), (e % 10 == F.dayofmonth("slot") % 10).alias("maintenance"))
    declared = al.select("entity_id").distinct().select("entity_id", F.when(e % 5 != 4, 8 + e % 14).alias("open_hour"), ((18 + e % 14) % 24).alias("close_hour"))
    return c._rounded(ind.ns03(slots, declared, files.read_days(spark, path)))


@query(f"WITH n2 AS ({c.ORACLE_SQL['ns02_absent_categories']}), n4 AS ({c.ORACLE_SQL['ns04_orphans']}) SELECT 'ns02' AS indicator, entity_id, value, round(least(1.0, n / 5), 4) AS confidence FROM n2 UNION ALL SELECT 'ns04', entity_id, value, round(least(1.0, n / 5), 4) FROM n4")
def ns_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative-space values with the confidence that their few observations allow."""
    rows = {"ns02": c.ns02_absent_categories(spark, sf_dir), "ns04": c.ns04_orphans(spark, sf_dir)}
    return reduce(DataFrame.unionByName, (r.select(F.lit(k).alias("indicator"), "entity_id", "value", F.round(ind.sparse_confidence(F.col("n")), 4).alias("confidence")) for k, r in rows.items()))


@query(f"WITH {a.ENTITIES}, k AS (SELECT entity_id, cohort || '|' || CASE WHEN entity_id % 3 = 0 THEN 'large' ELSE 'small' END || '|in_house|' || CASE WHEN entity_id % 2 = 0 THEN 'full' ELSE 'office' END AS key FROM entities) SELECT entity_id, key, count(*) OVER (PARTITION BY key) - 1 AS n_peers FROM k")
def composite_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts by sector, size, model and coverage together; peers are the others of the same key."""
    e = F.col("entity_id")
    key = F.concat_ws("|", "cohort", F.when(e % 3 == 0, "large").otherwise("small"), F.lit("in_house"), F.when(e % 2 == 0, "full").otherwise("office"))
    rows = a.entities(spark, sf_dir).select("entity_id", key.alias("key"))
    return rows.join(rows.groupBy("key").agg((F.count("*") - 1).alias("n_peers")), "key")


@query("WITH s AS (SELECT o_custkey AS entity, max(o_totalprice) AS score, max(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS hit FROM orders GROUP BY o_custkey), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, entity) AS i, sum(hit) OVER () AS p FROM s), m AS (SELECT sum(CASE WHEN i <= 50 THEN hit END) / 50 AS pr, sum(CASE WHEN i <= 50 THEN hit END) / max(p) AS re, sum(hit / log2(i + 1)) AS g, sum(CASE WHEN i <= p THEN 1 / log2(i + 1) END) AS best FROM r) SELECT round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1, round(g / best, 5) AS ndcg FROM m")
def ranking_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 at 50 and normalised gain, from ranks in two levels."""
    o = a.table(spark, sf_dir, "orders")
    s = o.groupBy(F.col("o_custkey").alias("entity")).agg(F.max("o_totalprice").alias("score"), F.max(F.col("o_orderpriority").startswith("1").cast("int")).alias("hit"))
    return trends.ranked_at(s, 50)


@query("WITH x AS (SELECT o_custkey % 14 AS family, (o_orderkey % 5) * 25 AS dose, o_totalprice > 400000 - 2500 * ((o_orderkey % 5) * 25) AS detected, o_custkey % 9 = 0 AS hard_negative FROM orders) SELECT family, dose, count(*) AS n, round(avg(CASE WHEN detected AND NOT hard_negative THEN 1.0 WHEN NOT hard_negative THEN 0.0 END), 6) AS detected, round(avg(CASE WHEN hard_negative THEN CASE WHEN detected THEN 1.0 ELSE 0.0 END END), 6) AS false_positives FROM x GROUP BY ALL")
def dose_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected share by family and dose, and false positives among hard negatives."""
    dose = (F.col("o_orderkey") % 5) * 25
    x = a.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 14).alias("family"), dose.alias("dose"), (F.col("o_totalprice") > 400000 - 2500 * dose).cast("double").alias("hit"), (F.col("o_custkey") % 9 == 0).alias("hard"))
    return x.groupBy("family", "dose").agg(F.count("*").alias("n"), F.round(F.avg(F.when(~F.col("hard"), F.col("hit"))), 6).alias("detected"), F.round(F.avg(F.when(F.col("hard"), F.col("hit"))), 6).alias("false_positives"))


@query(f"WITH {a.CASES} SELECT case_id, entity_id, 'lines' AS source_tool, CASE WHEN closed_s - created_s >= 0 THEN closed_s - created_s END AS duration, count(*) AS n FROM cases GROUP BY ALL")
def derived_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injected and derived fields: the tool, and a duration that is null where it would be negative or a time is missing."""
    d = F.col("closed_s") - F.col("created_s")
    return a.cases(spark, sf_dir).groupBy("case_id", "entity_id", F.lit("lines").alias("source_tool"), F.when(d >= 0, d).alias("duration")).agg(F.count("*").alias("n"))
