"""Queries of the indicators over event histories and of expectations, with their SQL.

The given tables are seen as histories: orders as cases, their line items as closures, events as alerts of assets. Where
the tables are too even for an indicator, the views plant what it looks for at places that keys fix; expressions of the
views are text that Spark and SQL read alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import scalars
from vigil.operators import behaviour as b
from vigil.operators import expectation as x
from vigil.operators import indicators as ind
from vigil.operators import intake
from vigil.operators import submission_quality as sq
from vigil.plans import adapters as a
from vigil.plans import catalogue, shared
from vigil.plans.catalogue import query

LIMITS = b.Limits()
N_ENTITIES = 40

#: Case steps: number, state, seconds after the start, condition; k is the order, e the entity.
STEPS = [
    (0, "'NEW'", "0", "k % 31 <> 0"),
    (1, "CASE WHEN k % 17 = 0 THEN NULL ELSE 'OPEN' END", "300 + k % 600", "e % 10 <> 3 OR k % 2 = 1"),
    (2, "'IN_PROGRESS'", "CASE WHEN k % 97 = 0 THEN NULL ELSE 1800 + k % 900 END", "k % 7 <> 0 AND (e % 10 <> 3 OR k % 2 = 1)"),
    (3, "'ESCALATED'", "3600", "k % 5 = 0"),
    (4, "'RESOLVED'", "CASE WHEN k % 11 = 0 THEN 20000 WHEN k % 29 = 0 THEN 14400 + k % 1800 ELSE 7200 + k % 3600 END", "k % 13 <> 0"),
    (5, "'CLOSED'", "14400 + k % 1800", "TRUE"),
    (6, "'REOPENED'", "18000", "k % 23 = 0"),
]

#: Notes and severity changes: number, type, seconds, rank before, rank after, condition.
CHANGES = [
    (0, "note_added", "1000", "NULL", "NULL", "k % 3 <> 0"),
    (1, "severity_changed", "1000", "4", "3", "k % 8 = 1"),
    (2, "severity_changed", "50000 + k % 60000", "3", "1", "k % 4 = 0"),
    (3, "note_added", "90000", "NULL", "NULL", "k % 5 = 0"),
    (4, "severity_changed", "200000", "4", "2", "k % 6 = 0"),
    (5, "severity_changed", "150000", "1", "4", "k % 9 = 0"),
    (6, "severity_changed", "NULL", "4", "1", "k % 50 = 0"),
]

_KEYS = f"o_orderkey AS k, o_custkey % {N_ENTITIES} AS e"


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return a.table(spark, sf_dir, "orders").selectExpr(*_KEYS.split(", "), "o_orderdate").withColumn("t0", seconds + (F.col("k") * 7919) % 86400)


_STARTS = f"starts AS (SELECT {_KEYS}, CAST(epoch(o_orderdate) AS BIGINT) + (o_orderkey * 7919) % 86400 AS t0 FROM orders)"


def case_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [F.expr(f"CASE WHEN {cond} THEN struct({no} AS event_no, t0 + ({at}) AS ts, {state} AS state) END") for no, state, at, cond in STEPS]
    rows = _starts(spark, sf_dir).select("k", "e", F.explode(F.array_compact(F.array(*made))).alias("s"))
    return rows.select(F.col("e").alias("entity_id"), F.col("k").alias("case_id"), "s.event_no", "s.ts", "s.state")


_EVENTS = (
    _STARTS
    + ", ev AS ("
    + " UNION ALL ".join(f"SELECT e AS entity_id, k AS case_id, {no} AS event_no, t0 + ({at}) AS ts, {state} AS state FROM starts WHERE {cond}" for no, state, at, cond in STEPS)
    + ")"
)


def cohorts(rows: DataFrame) -> DataFrame:
    return rows.select("entity_id").distinct().withColumn("cohort", F.col("entity_id") % 4)


def _pairs() -> str:
    pairs = [(b.START, "NEW"), *((p, q) for p, after in b.STATE_MACHINE.items() for q in after)]
    return ", ".join(f"('{p}', '{q}')" for p, q in pairs)


@query(f"""WITH {_EVENTS}, allowed(p, q) AS (VALUES {_pairs()}),
 s AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY entity_id, case_id ORDER BY ts, event_no), '{b.START}') AS before
  FROM ev WHERE state IS NOT NULL AND ts IS NOT NULL),
 m AS (SELECT s.*, CASE WHEN p IS NULL THEN 1 ELSE 0 END AS wrong FROM s LEFT JOIN allowed ON p = before AND q = state WHERE before <> state),
 c AS (SELECT entity_id, case_id, count(*) AS k, sum(wrong) AS w FROM m GROUP BY ALL),
 v AS (SELECT entity_id, avg(CASE WHEN w > 0 THEN 1 ELSE 0 END) AS value, count(*) AS n, sum(k) AS n_steps, sum(w) AS n_wrong FROM c GROUP BY entity_id),
 o AS (SELECT entity_id, before, state, count(*) AS own FROM m GROUP BY ALL),
 peers AS (SELECT o.entity_id, o.before, o.state, o.own,
   (SELECT coalesce(sum(y.own), 0) FROM o y WHERE y.entity_id % 4 = o.entity_id % 4 AND y.entity_id <> o.entity_id AND y.before = o.before AND y.state = o.state) AS t,
   (SELECT sum(y.own) FROM o y WHERE y.entity_id % 4 = o.entity_id % 4 AND y.entity_id <> o.entity_id AND y.before = o.before) AS f FROM o),
 off AS (SELECT entity_id, sum(CASE WHEN f > 0 AND t < {LIMITS.consensus} * f THEN own ELSE 0 END) / sum(CASE WHEN f > 0 THEN own END) AS off_path FROM peers GROUP BY entity_id),
 u AS (SELECT entity_id, count(*) FILTER (state IS NULL) AS n_unstated FROM ev GROUP BY entity_id)
 SELECT entity_id, round(value, 6) AS value, n, CAST(n_steps AS BIGINT) AS n_steps, CAST(n_wrong AS BIGINT) AS n_wrong, round(off_path, 6) AS off_path, n_unstated
 FROM v LEFT JOIN off USING (entity_id) LEFT JOIN u USING (entity_id)""")  # fmt: skip
def eg13_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EG-13: cases off the declared automaton, and steps off the peers' consensus."""
    events = case_events(spark, sf_dir)
    out = b.conformance(events, cohorts(events))
    return out.select("entity_id", F.round("value", 6).alias("value"), "n", "n_steps", "n_wrong", F.round("off_path", 6).alias("off_path"), "n_unstated")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [F.expr(f"CASE WHEN {cond} THEN struct({no} AS event_no, t0 + ({at}) AS ts, '{kind}' AS event_type, CAST({low} AS INT) AS from_rank, CAST({high} AS INT) AS to_rank) END") for no, kind, at, low, high, cond in CHANGES]
    rows = _starts(spark, sf_dir).select("k", "e", F.explode(F.array_compact(F.array(*made))).alias("s"))
    return rows.select(F.col("e").alias("entity_id"), F.col("k").alias("case_id"), "s.*")


_CHANGES = (
    _STARTS
    + ", ch AS ("
    + " UNION ALL ".join(f"SELECT e AS entity_id, k AS case_id, t0 + ({at}) AS ts, '{kind}' AS event_type, CAST({low} AS INT) AS from_rank, CAST({high} AS INT) AS to_rank FROM starts WHERE {cond}" for _, kind, at, low, high, cond in CHANGES)
    + ")"
)


@query(f"""WITH {_CHANGES}, down AS (SELECT * FROM ch WHERE event_type = 'severity_changed' AND to_rank < from_rank AND ts IS NOT NULL),
 notes AS (SELECT entity_id, case_id, ts AS note_ts FROM ch WHERE event_type = 'note_added' AND ts IS NOT NULL),
 j AS (SELECT d.*, n.note_ts FROM down d ASOF LEFT JOIN notes n ON d.entity_id = n.entity_id AND d.case_id = n.case_id AND d.ts >= n.note_ts)
 SELECT entity_id, round(avg(CASE WHEN note_ts IS NULL OR ts - note_ts > {LIMITS.note_s} THEN 1 ELSE 0 END), 6) AS value, count(*) AS n,
  count(*) FILTER (note_ts IS NULL) AS n_bare FROM j GROUP BY entity_id""")  # fmt: skip
def eg04_undocumented_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EG-04: downgrades without a note in the day before."""
    out = b.undocumented_changes(changes(spark, sf_dir))
    return out.select("entity_id", F.round("value", 6).alias("value"), "n", "n_bare")


@query(f"""WITH {a.ALERTS}, w AS (SELECT DISTINCT entity_id, category, asset_id, event_s,
   count(*) OVER f AS k, sum(CASE WHEN alert_id % 6 = 0 THEN 1 ELSE 0 END) OVER f AS c FROM alerts
   WINDOW f AS (PARTITION BY entity_id, category, asset_id ORDER BY event_s RANGE BETWEEN {LIMITS.repeat_days * 86400} PRECEDING AND CURRENT ROW)),
 g AS (SELECT entity_id, category, asset_id, count(*) FILTER (k >= {LIMITS.repeats} AND c = 0) AS bursts, max(k) AS most FROM w GROUP BY ALL)
 SELECT entity_id, round(avg(CASE WHEN bursts > 0 THEN 1 ELSE 0 END), 6) AS value, count(*) AS n, CAST(sum(bursts) AS BIGINT) AS n_bursts, max(most) AS most FROM g GROUP BY entity_id""")  # fmt: skip
def eg05_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EG-05: signatures that come back five times in 14 days without a remedy."""
    rows = a.alerts(spark, sf_dir).select("entity_id", F.col("category").alias("rule"), F.col("asset_id").alias("asset"), F.col("event_s").alias("ts"), (F.col("alert_id") % 6 == 0).alias("remedied"))
    out = b.recurrence(rows)
    return out.select("entity_id", F.round("value", 6).alias("value"), "n", "n_bursts", "most")


#: Closures of people and machines: times are planted for some entities (a busy hour, shift ends, whole minutes, batches).
_CLOSURE = "l_suppkey % 40 AS entity_id, l_partkey % 5 AS actor, CASE WHEN l_partkey % 5 = 4 THEN 'automation' ELSE 'human' END AS actor_type"
_TIME = """CASE WHEN l_suppkey % 10 = 7 THEN {year} + l_orderkey % 3600 WHEN l_suppkey % 10 = 6 THEN {month} + 43205
 WHEN l_suppkey % 10 = 5 AND l_linenumber % 2 = 0 THEN {day} + 48600 + (l_orderkey * 131) % 1800
 WHEN l_suppkey % 10 = 3 THEN {day} + 60 * ((l_orderkey * 131) % 1440) ELSE {day} + (l_orderkey * 131) % 86400 END"""
_CREATED = "closed_s - l_orderkey % 5000 + CASE WHEN l_orderkey % 41 = 0 THEN 6000 ELSE 0 END"


def closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = lambda u: f"unix_timestamp(CAST(date_trunc('{u}', l_shipdate) AS TIMESTAMP))"
    rows = a.table(spark, sf_dir, "lineitem").withColumn("closed_s", F.expr(_TIME.format(year=unit("year"), month=unit("month"), day=unit("day"))))
    fields = [F.expr(c) for c in _CLOSURE.split(", ")[:2]] + [F.expr(_CLOSURE.split(", ", 2)[2])]
    return rows.select(*fields, F.col("closed_s").alias("ts"), "closed_s", F.expr(_CREATED).alias("created_s"))


_UNIT = {u: f"CAST(epoch(date_trunc('{u}', l_shipdate)) AS BIGINT)" for u in ("year", "month", "day")}
_CLOSURES = f"cl AS (SELECT {_CLOSURE}, closed_s AS ts, closed_s, {_CREATED} AS created_s FROM (SELECT *, {_TIME.format(**_UNIT)} AS closed_s FROM lineitem))"


@query(f"""WITH {_CLOSURES}, w AS (SELECT entity_id, actor, count(*) OVER (PARTITION BY entity_id, actor ORDER BY ts RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS k
  FROM cl WHERE actor_type = 'human'), g AS (SELECT entity_id, actor, max(k) AS most FROM w GROUP BY ALL)
 SELECT entity_id, round(avg(CASE WHEN most > {LIMITS.closures_per_hour} THEN 1 ELSE 0 END), 6) AS value, count(*) AS n, max(most) AS most FROM g GROUP BY entity_id""")  # fmt: skip
def eg12_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EG-12: people who close more than six cases within an hour."""
    out = b.throughput(closures(spark, sf_dir))
    return out.select("entity_id", F.round("value", 6).alias("value"), "n", "most")


BOUNDARIES = [360, 840, 1320]
_BINS = ", ".join(f"({i}, {w!r})" for i, w in zip(*b.boundary_weights(LIMITS)))
_NEAREST = ", ".join(f"((minute - {m} + 720) % 1440 + 1440) % 1440 - 720" for m in BOUNDARIES)


@query(f"""WITH {_CLOSURES}, weights(bin, w) AS (VALUES {_BINS}),
 m AS (SELECT entity_id, (ts % 86400) // 60 AS minute FROM cl),
 d AS (SELECT entity_id, list_sort(list_transform([{_NEAREST}], lambda d: {{'far': abs(d + 0.5), 'd': d}}))[1].d AS d FROM m),
 k AS (SELECT entity_id, CAST(floor(d / {LIMITS.bin_min}.0) AS BIGINT) AS bin, count(*) AS k FROM d GROUP BY ALL),
 s AS (SELECT entity_id, CAST(sum(k) AS BIGINT) AS n, CAST(coalesce(sum(k) FILTER (abs(bin + 0.5) < {LIMITS.window_min / LIMITS.bin_min}), 0) AS BIGINT) AS inside, greatest(sum(k * w), 0.0) AS expected
  FROM k JOIN weights USING (bin) GROUP BY entity_id)
 SELECT entity_id, round(CASE WHEN expected > 0 THEN inside / expected - 1 END, 6) AS value, n, inside, round(expected, 6) AS expected,
  round(CASE WHEN expected > 0 THEN (inside - expected) / sqrt(expected) END, 6) AS z FROM s""")  # fmt: skip
def eg15_shift_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EG-15: closures around three handovers, against a density fitted without half an hour to each side."""
    out = b.boundary_bunching(closures(spark, sf_dir), BOUNDARIES)
    rounded = {c: F.round(c, 6) for c in ("value", "expected", "z")}
    return out.withColumns(rounded)


def _fit_sql(unit: str) -> str:
    z = "(pow(chi2 / 59, 1.0 / 3) - (1 - 2.0 / (9 * 59))) / sqrt(2.0 / (9 * 59))"
    exact = f"least(1.0, 60 * list_sum(list_transform(range(most, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - i * ln(60.0) + (n - i) * ln(59.0 / 60)))))"
    return f"""f_{unit} AS (SELECT entity_id, n, chi2, CASE WHEN n / 60.0 < {LIMITS.least_expected} THEN {exact}
   ELSE 1 / (1 + exp(0.07056 * pow({z}, 3) + 1.5976 * {z})) END AS p FROM (
   SELECT entity_id, CAST(sum(k) AS BIGINT) AS n, sum(k * k) * 60 / sum(k) - sum(k) AS chi2, max(k) AS most FROM (SELECT entity_id, {unit} AS u, count(*) AS k FROM cells GROUP BY ALL) GROUP BY entity_id))"""


@query(f"""WITH {_CLOSURES}, cells AS (SELECT entity_id, closed_s % 60 AS second, (closed_s // 60) % 60 AS minute FROM cl), {_fit_sql('second')}, {_fit_sql('minute')},
 t AS (SELECT entity_id, closed_s, count(*) AS k, count(*) FILTER (closed_s < created_s) AS early FROM cl GROUP BY ALL),
 o AS (SELECT entity_id, CAST(sum(early) AS BIGINT) AS n_impossible, CAST(coalesce(sum(k) FILTER (k >= {LIMITS.batch}), 0) AS BIGINT) AS n_batched FROM t GROUP BY entity_id)
 SELECT entity_id, n, round(s.chi2, 4) AS seconds_chi2, round(s.p, 5) AS seconds_chance, round(m.chi2, 4) AS minutes_chi2, round(m.p, 5) AS minutes_chance, n_impossible, n_batched,
  round(greatest(CASE WHEN s.p < {LIMITS.chance} OR m.p < {LIMITS.chance} THEN 1.0 ELSE 0.0 END, n_impossible / n, n_batched / n), 6) AS value
 FROM f_second s JOIN (SELECT entity_id, chi2, p FROM f_minute) m USING (entity_id) JOIN o USING (entity_id)""")  # fmt: skip
def eg16_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EG-16: seconds and minutes against a uniform spread, impossible orders, batches."""
    out = b.timestamp_forensics(closures(spark, sf_dir))
    rounded = {"seconds_chi2": 4, "minutes_chi2": 4, "seconds_chance": 5, "minutes_chance": 5, "value": 6}
    return out.select("entity_id", "n", "n_impossible", "n_batched", *(F.round(c, n).alias(c) for c, n in rounded.items()))


_ESCALATED = "CASE WHEN e % 10 = 9 THEN k % 50 = 0 ELSE k % 5 = 0 END"
_LOG_B = "lgamma({0}) + lgamma({1}) - lgamma(({0}) + ({1}))"
_BB = f"list_sum(list_transform(range(0, x + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + {_LOG_B.format('i + al', 'n - i + be')} - ({_LOG_B.format('al', 'be')}))))"
_BINOMIAL = "list_sum(list_transform(range(0, x + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(mean) + (n - i) * ln(1 - mean))))"


@query(f"""WITH {_STARTS}, c AS (SELECT e AS entity_id, e % 4 AS cohort, count(*) AS n, count(*) FILTER ({_ESCALATED}) AS x FROM starts GROUP BY ALL),
 p AS (SELECT c.entity_id, c.cohort, c.n, c.x, count(*) AS k, sum(q.n) AS pn, sum(q.x) / sum(q.n) AS mean, sum(q.n * q.n) AS nn, sum(q.x * q.x / q.n) AS xx
  FROM c JOIN c q ON q.cohort = c.cohort AND q.entity_id <> c.entity_id GROUP BY ALL),
 s AS (SELECT *, (xx - pn * mean * mean - (k - 1) * mean * (1 - mean)) / (pn - nn / pn - (k - 1)) AS raw FROM p),
 t AS (SELECT *, CASE WHEN k >= 2 AND raw > 0 AND raw < mean * (1 - mean) THEN raw END AS spread FROM s),
 u AS (SELECT *, mean * (mean * (1 - mean) / spread - 1) AS al, (1 - mean) * (mean * (1 - mean) / spread - 1) AS be FROM t),
 v AS (SELECT *, CASE WHEN spread IS NULL THEN {_BINOMIAL} ELSE {_BB} END AS chance FROM u)
 SELECT entity_id, cohort, n, round(x / n, 6) AS rate, round(mean, 6) AS mean, round(spread, 6) AS spread, round(chance, 6) AS chance,
  round(CASE WHEN chance <= {LIMITS.chance} THEN 1 - x / n / mean ELSE 0 END, 6) AS value FROM v""")  # fmt: skip
def eg07_escalation_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EG-07: escalation rates below the funnel of their peers."""
    rows = _starts(spark, sf_dir).withColumn("hit", F.expr(_ESCALATED))
    counts = rows.groupBy(F.col("e").alias("entity_id"), (F.col("e") % 4).alias("cohort")).agg(F.count("*").alias("n"), F.count(F.when(F.col("hit"), 1)).alias("escalated"))
    out = b.escalation_limits(counts)
    return out.select("entity_id", "cohort", "n", *(F.round(c, 6).alias(c) for c in ("value", "rate", "mean", "spread", "chance")))


_FIRST, _SECOND = "(event_id * 7919) % 101 >= 4", "(event_id * 7919) % 101 >= 4 AND event_id % 89 NOT IN (5, 6)"


def submitted_ids(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    return a.table(spark, sf_dir, "events").filter(condition).selectExpr("event_id % 7 AS entity_id", "CAST(floor(event_id / 7) AS BIGINT) AS id")


_IDS = f"one AS (SELECT event_id % 7 AS entity_id, event_id // 7 AS id FROM events WHERE {_FIRST}), two AS (SELECT event_id % 7 AS entity_id, event_id // 7 AS id FROM events WHERE {_SECOND})"
_GAPS = "gaps AS (SELECT entity_id, before + 1 AS from_id, id - 1 AS to_id, id - before - 1 AS n_missing FROM (SELECT *, lag(id) OVER (PARTITION BY entity_id ORDER BY id) AS before FROM (SELECT DISTINCT entity_id, id FROM two)) WHERE id - before > 1)"


@query(f"WITH {_IDS}, {_GAPS} SELECT * FROM gaps")
def eg17_id_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EG-17: the runs of ids that are missing in a submission."""
    return b.id_gaps(submitted_ids(spark, sf_dir, _SECOND))


@query(f"""WITH {_IDS}, {_GAPS}, s AS (SELECT entity_id, max(id) - min(id) + 1 AS n FROM two GROUP BY entity_id),
 g AS (SELECT entity_id, count(*) AS n_runs, CAST(sum(n_missing) AS BIGINT) AS n_missing FROM gaps GROUP BY entity_id),
 d AS (SELECT entity_id, count(*) AS n_deleted FROM (SELECT * FROM one EXCEPT SELECT * FROM two) GROUP BY entity_id)
 SELECT entity_id, round(coalesce(n_missing, 0) / n, 6) AS value, n, coalesce(n_runs, 0) AS n_runs, coalesce(n_missing, 0) AS n_missing, coalesce(n_deleted, 0) AS n_deleted
 FROM s LEFT JOIN g USING (entity_id) LEFT JOIN d USING (entity_id)""")  # fmt: skip
def eg17_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EG-17: missing share of the id range, and ids that a later submission no longer has."""
    out = b.id_completeness(submitted_ids(spark, sf_dir, _FIRST), submitted_ids(spark, sf_dir, _SECOND))
    return out.withColumn("value", F.round("value", 6))


def customer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = a.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("value"), F.count("*").alias("n_orders"))
    c = a.table(spark, sf_dir, "customer")
    return c.join(per, c.c_custkey == per.o_custkey, "left").select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("cohort"), "value", F.col("c_acctbal").alias("balance"), "n_orders")


@query("""WITH v AS (SELECT c_custkey AS entity_id, c_mktsegment AS cohort, value, c_acctbal AS x FROM customer LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS value FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey),
 p AS (SELECT a.entity_id, any_value(a.x) AS x, count(*) AS n_peers, regr_slope(b.value, b.x) AS slope, regr_intercept(b.value, b.x) AS base
  FROM v a JOIN v b ON a.cohort = b.cohort AND a.entity_id <> b.entity_id AND b.value IS NOT NULL AND b.x IS NOT NULL WHERE a.value IS NOT NULL AND a.x IS NOT NULL GROUP BY a.entity_id)
 SELECT entity_id, cohort, round(value, 6) AS value, n_peers, round(base + slope * p.x, 2) AS expected, round(value - base - slope * p.x, 2) AS residual FROM v LEFT JOIN p USING (entity_id)""")  # fmt: skip
def covariate_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected value of each entity by its peers' regression on a covariate, and what is left."""
    out = x.covariate_model(customer_values(spark, sf_dir), ["balance"], ["cohort"])
    return out.select("entity_id", "cohort", "n_peers", F.round("value", 6).alias("value"), *(F.round(c, 2).alias(c) for c in ("expected", "residual")))


_DUE = "NOT (user_id % 9 = 4 AND day >= DATE '2024-01-21')"


def asset_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of assets, every ninth silent from the 21st; the rarest kind of event only, so that silences are not trivial."""
    rows = a.table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    rows = rows.select((F.col("user_id") % 10).alias("entity_id"), F.col("user_id").alias("asset_id"), (F.col("user_id") % 3).alias("asset_class"), (1 + F.col("user_id") % 4).alias("criticality"), "day", F.expr(_DUE).alias("due"))
    grid = ind.daily_grid(rows, ["entity_id", "asset_id", "asset_class", "criticality"]).drop("activity")
    seen = rows.filter("due").groupBy("asset_id", "day").agg(F.count("*").alias("activity"))
    return grid.join(seen, ["asset_id", "day"], "left").withColumn("activity", F.coalesce("activity", F.lit(0)))


@query(f"""WITH r AS (SELECT user_id % 10 AS entity_id, user_id AS asset_id, user_id % 3 AS asset_class, 1 + user_id % 4 AS criticality, CAST(ts AS DATE) AS day, user_id FROM events),
 days AS (SELECT unnest(generate_series((SELECT min(day) FROM r), (SELECT max(day) FROM r), INTERVAL 1 DAY))::DATE AS day),
 g AS (SELECT e.*, day, coalesce(k, 0) AS activity FROM (SELECT DISTINCT entity_id, asset_id, asset_class, criticality FROM r) e CROSS JOIN days LEFT JOIN (SELECT asset_id, day, count(*) AS k FROM r WHERE {_DUE} GROUP BY ALL) USING (asset_id, day)),
 q AS (SELECT entity_id, asset_id, asset_class, criticality, count(*) AS days, CAST(sum(activity) AS BIGINT) AS total, min(day) AS first, max(day) AS last, max(day) FILTER (activity > 0) AS active FROM g GROUP BY ALL),
 z AS (SELECT *, CASE WHEN active IS NULL THEN first WHEN active < last THEN active + 1 END AS since FROM q),
 y AS (SELECT *, coalesce(last - since + 1, 0) AS run FROM z),
 m AS (SELECT a.asset_id, sum(b.total) / sum(b.days) AS rate FROM y a JOIN y b ON a.asset_class = b.asset_class AND a.asset_id <> b.asset_id GROUP BY a.asset_id HAVING count(*) >= 2),
 s AS (SELECT a.asset_id, any_value(rate) AS rate, (sum((b.total - rate * b.days) ** 2) - any_value(rate) * sum(b.days)) / sum(b.days * b.days) AS v
  FROM y a JOIN m USING (asset_id) JOIN y b ON a.asset_class = b.asset_class AND a.asset_id <> b.asset_id GROUP BY a.asset_id),
 c AS (SELECT y.*, s.rate, CASE WHEN v > 0 THEN rate * rate / v END AS size FROM y LEFT JOIN s USING (asset_id)),
 d AS (SELECT *, CASE WHEN run > 0 AND rate > 0 THEN coalesce(pow((size / rate + days - run) / (size / rate + days), size + total), exp(-rate * run)) END AS chance FROM c),
 w AS (SELECT *, least(1.0, chance * greatest(5 - criticality, 1)) AS weighted FROM d),
 i AS (SELECT *, CASE WHEN weighted IS NOT NULL THEN row_number() OVER (PARTITION BY entity_id, weighted IS NULL ORDER BY weighted, asset_id) END AS i, count(weighted) OVER (PARTITION BY entity_id) AS m FROM w),
 b AS (SELECT *, max(weighted) FILTER (weighted <= 0.05 * i / m) OVER (PARTITION BY entity_id) AS bound FROM i)
 SELECT entity_id, asset_id, days, total, strftime(since, '%Y-%m-%d') AS silent_since, run, round(rate, 6) AS rate, round(size, 3) AS size, round(chance, 6) AS chance, coalesce(weighted <= bound, FALSE) AS raised FROM b""")  # fmt: skip
def ns01_expected_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NS-01 by a negative-binomial expectation: since when an asset is silent, and how likely that is."""
    out = x.silent_assets(asset_days(spark, sf_dir))
    since = F.date_format("silent_since", "yyyy-MM-dd").alias("silent_since")
    return out.select("entity_id", "asset_id", "days", "total", since, F.col("run").cast("long").alias("run"), F.round("rate", 6).alias("rate"), F.round("size", 3).alias("size"), F.round("chance", 6).alias("chance"), "raised")


_PLANTED = "NOT (user_id % 20 % 6 = 2 AND event_type = 'error' AND period >= 4)"
_NB = "list_sum(list_transform(range(0, activity + 1), lambda i: exp(lgamma(i + size) - lgamma(size) - lgamma(i + 1) + size * ln(size / (size + expected)) + i * ln(expected / (size + expected)))))"
_POISSON = "list_sum(list_transform(range(0, activity + 1), lambda i: exp(i * ln(expected) - expected - lgamma(i + 1))))"


def category_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by entity, category and five-day period, with zeros; some entities lose a category in the last two."""
    rows = a.table(spark, sf_dir, "events").withColumn("period", F.floor((F.dayofmonth("ts") - 1) / 5))
    rows = rows.select((F.col("user_id") % 20).alias("entity_id"), F.col("event_type").alias("category"), "period", F.expr(_PLANTED).alias("due"))
    grid = rows.select("entity_id", "category").distinct().crossJoin(F.broadcast(rows.select("period").distinct()))  # the periods
    seen = rows.filter("due").groupBy("entity_id", "category", "period").agg(F.count("*").alias("activity"))
    out = grid.join(seen, ["entity_id", "category", "period"], "left").withColumn("activity", F.coalesce("activity", F.lit(0)))
    return out.withColumn("cohort", F.col("entity_id") % 2)


@query(f"""WITH r AS (SELECT user_id % 20 AS entity_id, event_type AS category, (day(ts) - 1) // 5 AS period, user_id, event_type FROM events),
 g AS (SELECT e.*, period, coalesce(k, 0) AS activity, entity_id % 2 AS cohort FROM (SELECT DISTINCT entity_id, category FROM r) e CROSS JOIN (SELECT DISTINCT period FROM r) LEFT JOIN (SELECT entity_id, category, period, count(*) AS k FROM r WHERE {_PLANTED} GROUP BY ALL) USING (entity_id, category, period)),
 t AS (SELECT *, sum(activity) OVER (PARTITION BY entity_id, period) AS whole FROM g),
 p AS (SELECT a.entity_id, a.category, a.period, sum(b.activity) / nullif(sum(b.whole), 0) AS s FROM t a JOIN t b ON a.cohort = b.cohort AND a.category = b.category AND a.period = b.period AND a.entity_id <> b.entity_id GROUP BY ALL),
 v AS (SELECT a.entity_id, a.category, a.period, any_value(s) AS s, (sum((b.activity - s * b.whole) ** 2) - any_value(s) * sum(b.whole)) / (any_value(s) * any_value(s) * sum(b.whole * b.whole)) AS v
  FROM t a JOIN p USING (entity_id, category, period) JOIN t b ON a.cohort = b.cohort AND a.category = b.category AND a.period = b.period AND a.entity_id <> b.entity_id GROUP BY ALL),
 x AS (SELECT t.*, s * whole AS expected, CASE WHEN v > 0 THEN 1 / v END AS size FROM t LEFT JOIN v USING (entity_id, category, period)),
 c AS (SELECT *, CASE WHEN expected > 0 THEN CASE WHEN size IS NULL THEN {_POISSON} ELSE {_NB} END END AS chance FROM x),
 l AS (SELECT *, coalesce(chance <= 0.05, FALSE) AS low, max(period) FILTER (NOT coalesce(chance <= 0.05, FALSE)) OVER (PARTITION BY entity_id, category) AS after FROM c)
 SELECT entity_id, cohort, category, count(*) AS n, count(*) FILTER (low) AS n_low, count(*) FILTER (after IS NULL OR period > after) AS run,
  round(max_by(expected, period), 4) AS latest_expected, round(arg_max_null(chance, period), 6) AS latest_chance, count(*) FILTER (after IS NULL OR period > after) >= 2 AS raised FROM l GROUP BY entity_id, cohort, category""")  # fmt: skip
def ns02_expected_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NS-02 by a negative-binomial expectation that must fail in two periods running."""
    out = x.silent_categories(category_periods(spark, sf_dir))
    rounded = [F.round("latest_expected", 4).alias("latest_expected"), F.round("latest_chance", 6).alias("latest_chance")]
    return out.select("entity_id", "cohort", "category", "n", "n_low", "run", *rounded, "raised")


# --- quality of submissions from counts ---

REQUIRED = [("case", "severity"), ("case", "opened"), ("case", "note"), ("case", "owner"), ("alert", "case_no"), ("escalation", "target")]
MAPPING = {"case_id": "case_ref", "severity": "severity_raw", "opened": "opened_raw", "note": "note_raw", "owner": "owner_field"}
_SUBMITTED = f"""{a.RAW}, {a.ALERTS}, s AS (SELECT *, source_row % 7 AS submission_id, {catalogue._SEVERITY} AS severity FROM raw), al AS (SELECT *, alert_id % 7 AS submission_id FROM alerts),
 t AS (SELECT submission_id, 'case' AS tbl, 'severity' AS col, count(*) AS seen, 0 AS missing, 0 AS malformed, count(*) FILTER (severity IS NULL) AS unmapped, 0 AS sanitised FROM s GROUP BY ALL
  UNION ALL SELECT submission_id, 'case', 'opened', count(*), 0, count(*) FILTER (opened_raw = 'not a date'), 0, 0 FROM s GROUP BY ALL
  UNION ALL SELECT submission_id, 'case', 'flag', count(*), 0, count(*) FILTER (flag_raw = 'maybe'), 0, 0 FROM s GROUP BY ALL
  UNION ALL SELECT submission_id, 'case', 'note', count(*), count(*) FILTER (note_raw IN ('N/A', '-')), 0, 0, count(*) FILTER (note_raw LIKE '=%') FROM s GROUP BY ALL
  UNION ALL SELECT submission_id, 'alert', 'case_no', count(*), count(*) FILTER (case_no = -1), 0, 0, 0 FROM al GROUP BY ALL)"""


def submitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cases as submitted text and alerts that refer to them, each in seven submissions."""
    cases = a.raw_submission(spark, sf_dir).withColumn("submission_id", F.col("source_row") % 7)
    alerts = a.alerts(spark, sf_dir).withColumn("submission_id", F.col("alert_id") % 7).withColumn("case_raw", F.when(F.col("case_no") >= 0, F.col("case_no").cast("string")))
    return cases, alerts


def submission_tallies(cases: DataFrame, alerts: DataFrame) -> DataFrame:
    c = F.col
    cells = {
        "severity": sq.Cell(c("severity_raw"), scalars.severity(c("severity_raw")), "unmapped"), "opened": sq.Cell(c("opened_raw"), scalars.timestamp_utc(c("opened_raw"))),
        "flag": sq.Cell(c("flag_raw"), scalars.boolean(c("flag_raw"))), "note": sq.Cell(c("note_raw"), scalars.safe_text(c("note_raw")), sanitised=c("note_raw").startswith("=")),
    }
    return sq.tallies(cases, ["submission_id"], "case", cells).unionByName(sq.tallies(alerts, ["submission_id"], "alert", {"case_no": sq.Cell(c("case_raw"), scalars.integer(c("case_raw")))}))


@query(f"WITH {_SUBMITTED} SELECT submission_id, tbl AS table_name, col AS column_name, seen, CAST(missing AS BIGINT) AS missing, CAST(malformed AS BIGINT) AS malformed, CAST(unmapped AS BIGINT) AS unmapped, CAST(sanitised AS BIGINT) AS sanitised FROM t")
def tallies_by_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each submission's columns held: cells seen, missing, malformed, unmapped and sanitised, apart."""
    return submission_tallies(*submitted(spark, sf_dir))


_REQUIRED_SQL = " UNION ALL ".join(f"SELECT '{t}' AS tbl, '{k}' AS col" for t, k in REQUIRED)


@query(f"""WITH {_SUBMITTED}, due AS ({_REQUIRED_SQL}),
 l AS (SELECT submission_id, 'case' AS tbl, count(severity) AS n, count(*) - count(severity) AS q FROM s GROUP BY ALL UNION ALL SELECT submission_id, 'alert', count(*), 0 FROM al GROUP BY ALL),
 f1 AS (SELECT l.submission_id, avg(coalesce(1 - missing / seen, 0)) AS completeness FROM l JOIN due USING (tbl) LEFT JOIN t ON t.submission_id = l.submission_id AND t.tbl = l.tbl AND t.col = due.col GROUP BY ALL),
 f2 AS (SELECT submission_id, sum(n) AS n, sum(q) AS q FROM l GROUP BY ALL), f2b AS (SELECT submission_id, sum(malformed) + sum(unmapped) AS failed, sum(seen) AS cells FROM t GROUP BY ALL),
 f4 AS (SELECT submission_id, count(*) AS d FROM al WHERE case_no >= 0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.submission_id = al.submission_id AND s.case_ref = CAST(al.case_no AS VARCHAR)) GROUP BY ALL)
 SELECT submission_id, round(completeness, 6) AS completeness, round(1 - (q / (n + q) + failed / cells) / 2, 6) AS validity, round(1 - coalesce(d, 0) / (coalesce(d, 0) + n), 6) AS consistency, round(4 / 9, 6) AS mapping
 FROM f1 JOIN f2 USING (submission_id) JOIN f2b USING (submission_id) LEFT JOIN f4 USING (submission_id)""")  # fmt: skip
def quality_from_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2, F4 and F6 of each submission from its own tallies, quarantine, dangling references and mapping."""
    cases, alerts = submitted(spark, sf_dir)
    counts = shared.kept(submission_tallies(cases, alerts))
    known = scalars.severity(F.col("severity_raw")).isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    loaded = cases.groupBy("submission_id").agg(n(known).alias("n_rows"), n(~known).alias("n_quarantined")).withColumn("table_name", F.lit("case"))
    loaded = loaded.unionByName(alerts.groupBy("submission_id").agg(F.count("*").alias("n_rows"), F.lit(0).cast("long").alias("n_quarantined")).withColumn("table_name", F.lit("alert")))
    required = spark.createDataFrame(REQUIRED, "table_name string, column_name string")
    reference = F.when(F.col("case_raw").isNotNull(), F.concat_ws("/", "submission_id", "case_raw"))
    targets = cases.select(F.concat_ws("/", "submission_id", "case_ref").alias("k"))
    lost = intake.dangling(alerts.withColumn("ref", reference), "ref", targets, "k")
    _, warnings = intake.apply_mapping(cases, MAPPING, list(MAPPING), ["case_id"])
    approved = [v for k, v in MAPPING.items() if not any(w.startswith(f"{k}:") for w in warnings)]
    headers = spark.createDataFrame([(c, c in approved) for c in cases.columns], "header string, approved boolean")
    columns = cases.select("submission_id").distinct().crossJoin(F.broadcast(headers))  # the submitted columns
    parts = [sq.completeness(counts, loaded, required), sq.validity(counts, loaded), sq.consistency(lost, loaded, ["case", "alert"]), sq.mapping_confidence(columns)]
    out = reduce(lambda x, y: x.join(y, "submission_id", "left"), parts)
    return out.select("submission_id", *(F.round(c, 6).alias(c) for c in ("completeness", "validity", "consistency", "mapping")))
