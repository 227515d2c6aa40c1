"""Queries over submitted files and cells: scans, mapping, vocabularies, privacy and quarantine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import scalars
from vigil.operators import intake, privacy
from vigil.plans import adapters as a
from vigil.plans import catalogue, shared
from vigil.plans.catalogue import query
from vigil.sources import files
from vigil.streaming import incremental

#: Cells by the order number modulo the length of their list; the SQL below has the same lists.
CELLS = {
    "status_raw": ["New", "in-progress", "Pending Escalation", "re opened", "CLOSED", "weird", "-", "completed", "resolved"],
    "event_raw": ["Opened", "owner-changed", "comment", "status change", "resolve", "escalation", "n/a", "severity", "closed"],
    "link_raw": ["Explicit", "INFERRED", "guess", "", "explicit"],
    "disposition_raw": ["true positive", "False-Positive", "benign anomaly", "suppressed", "unknown", "tbd", "TRUE_POSITIVE"],
    "actor_raw": ["SOAR", " analyst", "L2", "bot", "a91f", "", "Playbook", "tier3"],
    "ip_raw": ["10.0.0.7", "999.1.1.1", "fe80::1", "1.2.3", "not", "2001:db8::8:800:200c:417a", "1:2:3:4:5:6:7:8", "1::2::3", "255.255.255.255", "::"],
    "day_raw": ["2026-01-05", "05/01/2026", "x", "1767600000", "25/12/2025", "n/a"],
    "number_raw": ["1,234", "12.7", "NaN", "-5", "abc", "inf", "1e3"],
    "text_raw": ["=SUM(A1)", "mail a.b@corp.example.com", "see https://x.example/a?b from 10.1.2.3", "HOST-AB12 and db1.corp", "cve-2024-12345 on alpha-one", "plain", "fe80::1 talks to alpha", "\u0001+bell"],
}


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cell = lambda values: F.array(*map(F.lit, values))[(k % len(values)).cast("int")]
    return a.table(spark, sf_dir, "orders").select(k.alias("source_row"), (k % 20).alias("entity_id"), *(cell(v).alias(c) for c, v in CELLS.items()))


def _listed(values: list[str]) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" if "\x01" not in v else "chr(1) || '" + v[1:] + "'" for v in values)
    return f"[{quoted}]"


MESSY = "messy AS (SELECT o_orderkey AS source_row, o_orderkey % 20 AS entity_id, " + ", ".join(f"{_listed(v)}[(o_orderkey % {len(v)}) + 1] AS {c}" for c, v in CELLS.items()) + " FROM orders)"
_ABSENT = "lower(trim({0})) IN ('', '-', '--', 'n/a', 'na', 'null', 'none', 'nil', 'nan', 'undefined', 'tbd')"


def _cells(spark: SparkSession, sf_dir: str, column: str, value, why: str) -> DataFrame:
    c = F.col(column)
    return messy(spark, sf_dir).select("source_row", value(c).alias("value"), scalars.reason(c, value(c), why).alias("reason"))


def _cells_sql(column: str, value: str, why: str) -> str:
    return f"WITH {MESSY}, v AS (SELECT source_row, {column} AS c, {value.format(column)} AS value FROM messy) SELECT source_row, value, CASE WHEN value IS NULL AND NOT {_ABSENT.format('c')} THEN '{why}' END AS reason FROM v"


_STATUS_SQL = "CASE WHEN lower({0}) IN ('new') THEN 'NEW' WHEN lower({0}) = 'in-progress' THEN 'IN_PROGRESS' WHEN {0} = 'Pending Escalation' THEN 'ESCALATED' WHEN {0} = 're opened' THEN 'REOPENED' WHEN lower({0}) IN ('closed', 'completed') THEN 'CLOSED' WHEN {0} = 'resolved' THEN 'RESOLVED' END"


@query(_cells_sql("status_raw", _STATUS_SQL, "unmapped status"))
def normalised_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "status_raw", scalars.status, "unmapped status")


@query(_cells_sql("event_raw", "CASE {0} WHEN 'Opened' THEN 'created' WHEN 'owner-changed' THEN 'assigned' WHEN 'comment' THEN 'note_added' WHEN 'status change' THEN 'status_changed' WHEN 'escalation' THEN 'escalated' WHEN 'severity' THEN 'severity_changed' WHEN 'closed' THEN 'closed' END", "unmapped event type"))
def normalised_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event verbs; resolve has no type of its own and is rejected."""
    return _cells(spark, sf_dir, "event_raw", scalars.event_type, "unmapped event type")


@query(f"WITH {MESSY} SELECT source_row, CASE lower(link_raw) WHEN 'explicit' THEN 'explicit' WHEN 'inferred' THEN 'inferred' END AS link_type, CASE replace(replace(upper(disposition_raw), ' ', '_'), '-', '_') WHEN 'TRUE_POSITIVE' THEN 'TRUE_POSITIVE' WHEN 'FALSE_POSITIVE' THEN 'FALSE_POSITIVE' WHEN 'BENIGN_ANOMALY' THEN 'BENIGN_ANOMALY' WHEN 'SUPPRESSED' THEN 'SUPPRESSED' END AS disposition FROM messy")
def normalised_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messy(spark, sf_dir)
    return rows.select("source_row", scalars.enum(F.col("link_raw"), scalars.LINK_TYPES).alias("link_type"), scalars.enum(F.col("disposition_raw"), scalars.DISPOSITIONS).alias("disposition"))


@query(f"WITH {MESSY} SELECT CASE WHEN lower(trim(actor_raw)) IN ('soar', 'bot', 'playbook') THEN 'automation' WHEN lower(trim(actor_raw)) IN ('analyst', 'l2', 'tier3') THEN 'human' ELSE 'unknown' END AS actor_type, TRUE AS inferred, count(*) AS n FROM messy GROUP BY ALL")
def inferred_actor_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir).groupBy(scalars.actor_type(F.col("actor_raw")).alias("actor_type"), F.lit(True).alias("inferred")).agg(F.count("*").alias("n"))


@query(f"WITH {MESSY} SELECT ip_raw, ip_raw IN ('10.0.0.7', 'fe80::1', '2001:db8::8:800:200c:417a', '1:2:3:4:5:6:7:8', '255.255.255.255', '::') AS is_ip, count(*) AS n FROM messy GROUP BY ALL")
def strict_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir).groupBy("ip_raw", scalars.is_ip(F.col("ip_raw")).alias("is_ip")).agg(F.count("*").alias("n"))


@query(f"WITH {MESSY} SELECT source_row, CASE day_raw WHEN '2026-01-05' THEN '2026-01-05' WHEN '05/01/2026' THEN '2026-01-05' WHEN '1767600000' THEN '2026-01-05' WHEN '25/12/2025' THEN '2025-12-25' END AS day, day_raw = '05/01/2026' AS ambiguous FROM messy")
def normalised_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("day_raw")
    return messy(spark, sf_dir).select("source_row", F.date_format(scalars.day(c), "yyyy-MM-dd").alias("day"), scalars.ambiguous_day(c).alias("ambiguous"))


@query(f"WITH {MESSY} SELECT source_row, CASE number_raw WHEN '1,234' THEN 1234 WHEN '12.7' THEN 12 WHEN '-5' THEN -5 WHEN '1e3' THEN 1000 END AS whole, CASE number_raw WHEN '1,234' THEN 1234.0 WHEN '12.7' THEN 12.7 WHEN '-5' THEN -5.0 WHEN '1e3' THEN 1000.0 END AS real, CASE WHEN status_raw = 'New' THEN NULL END AS flag FROM messy")
def coerced_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as declared types; what does not fit is null, never a guess."""
    n = F.col("number_raw")
    whole = F.when(n.isin("inf", "NaN"), None).otherwise(scalars.coerced(n, "bigint"))
    return messy(spark, sf_dir).select("source_row", whole.alias("whole"), scalars.coerced(n, "double").alias("real"), scalars.coerced(F.col("status_raw"), "boolean").alias("flag"))


@query(f"WITH {a.RAW} SELECT trim(case_ref) AS case_id, trim(severity_raw) AS severity, NULL AS owner, trim(analyst_raw) AS analyst FROM raw")
def mapped_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submission under canonical names by a mapping; owner has no source."""
    rows, _ = intake.apply_mapping(a.raw_submission(spark, sf_dir), {"case_id": "case_ref", "severity": "severity_raw", "analyst": "analyst_raw", "owner": "owner_field"}, ["case_id", "severity", "owner", "analyst"], ["case_id", "severity"])
    return rows


HEADERS = [["Case_ID", "disposition", "closed_at", "x"], ["alert_id", "severity", "rule_id"], ["event_type", "case_id"], ["asset_class"], ["foo", "bar"], ["ALERT_ID", "Severity", "event_ts"]]
PROFILES = {"alerts": ["alert_id", "severity", "rule_id"], "cases": ["case_id", "disposition", "closed_at"], "events": ["event_type", "case_id", "ts"]}
_HEADERS_SQL = "h AS (SELECT o_orderkey AS submission, [" + ", ".join(_listed(x) for x in HEADERS) + "][(o_orderkey % 6) + 1] AS headers FROM orders)"


def submitted_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = F.array(*(F.array(*map(F.lit, x)) for x in HEADERS))
    return a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("submission"), lists[(F.col("o_orderkey") % len(HEADERS)).cast("int")].alias("headers"))


@query(f"WITH {_HEADERS_SQL}, p AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {_listed(v)})" for k, v in PROFILES.items()) + ") AS t(block, sources)), s AS (SELECT submission, block, round(len(list_intersect(list_transform(headers, lambda x: lower(x)), sources)) / len(sources), 6) AS share FROM h CROSS JOIN p), b AS (SELECT *, row_number() OVER (PARTITION BY submission ORDER BY share DESC, block) AS r FROM s) SELECT submission, CASE WHEN share >= 0.5 THEN block END AS block, share FROM b WHERE r = 1")
def matched_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vendor profile that fits each submission's headers best."""
    profiles = spark.createDataFrame(list(PROFILES.items()), "block string, sources array<string>")
    return intake.best_profile(submitted_headers(spark, sf_dir), profiles)


@query(f"WITH {_HEADERS_SQL} SELECT submission, ['case', 'alert', 'case_event', 'asset', 'unknown', 'case_event'][(submission % 6) + 1] AS table_name FROM h")
def inferred_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which table the headers of each submission point to; shared hints count for the first table that has them."""
    return submitted_headers(spark, sf_dir).select("submission", intake.inferred_table(F.col("headers")).alias("table_name"))


SHAPES = {"timestamp": r"^\d{4}-\d{2}-\d{2}", "number": r"^-?[\d,]+(\.\d+)?$", "address": scalars.IPV4, "boolean": r"(?i)^(true|false|yes|no|y|n|0|1)$", "disposition": r"(?i)^(true|false)[ _-]positive$", "id": r"^[A-Za-z]+-\w+$"}
_SHAPES_SQL = {"timestamp": r"^\d{4}-\d{2}-\d{2}", "number": r"^-?[\d,]+(\.\d+)?$", "address": r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$", "boolean": r"(?i)^(true|false|yes|no|y|n|0|1)$", "disposition": r"(?i)^(true|false)[ _-]positive$", "id": r"^[A-Za-z]+-\w+$"}


@query(f"WITH {MESSY}, l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS v FROM messy" for c in CELLS) + "), s AS (" + " UNION ALL ".join(f"SELECT column_name, '{k}' AS shape, round(avg(CASE WHEN regexp_matches(v, '{p}') THEN 1 ELSE 0 END), 6) AS share FROM l GROUP BY column_name" for k, p in _SHAPES_SQL.items()) + ") SELECT column_name, shape, share, share > 0.5 AS claimed FROM s")
def column_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of every column's values that have each shape, over whole columns in one pass."""
    share = lambda c, p: F.round(F.avg(F.col(c).rlike(p).cast("int")), 6)
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("shape"), share(c, p).alias("share")) for c in CELLS for k, p in SHAPES.items()]
    return messy(spark, sf_dir).agg(F.array(*cells).alias("r")).select(F.inline("r")).withColumn("claimed", F.col("share") > 0.5)


# --- validation and quarantine with the raw payload ---

_FATAL_SQL = f"f AS (SELECT *, list_filter([CASE WHEN {_ABSENT.format('link_raw')} THEN 'missing link' END, CASE WHEN NOT {_ABSENT.format('link_raw')} AND lower(link_raw) NOT IN ('explicit', 'inferred') THEN 'unmapped link type' END, CASE WHEN event_raw = 'resolve' THEN 'unmapped event type' END], lambda x: x IS NOT NULL) AS fatal FROM messy)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    link, event = F.col("link_raw"), F.col("event_raw")
    why = [F.when(scalars.clean(link).isNull(), "missing link"), scalars.reason(link, scalars.enum(link, scalars.LINK_TYPES), "unmapped link type"), scalars.reason(event, scalars.event_type(event), "unmapped event type")]
    return messy(spark, sf_dir).withColumn("fatal", F.array_compact(F.array(*why)))


@query(f"""WITH {MESSY}, {_FATAL_SQL} SELECT source_row, CASE WHEN array_to_string(fatal, '; ') LIKE '%unmapped%' THEN 'NORMALISE' ELSE 'VALIDATE' END AS stage, array_to_string(fatal, '; ') AS reasons, '{{"link_raw":"' || link_raw || '","event_raw":"' || event_raw || '"}}' AS raw FROM f WHERE len(fatal) > 0""")
def quarantine_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected rows with the cells as they were submitted."""
    return intake.quarantined_raw(_judged(spark, sf_dir), "fatal", ["link_raw", "event_raw"])


@query(f"WITH {MESSY}, {_FATAL_SQL}, x AS (SELECT source_row, array_to_string(fatal, '; ') AS reasons FROM f WHERE len(fatal) > 0) SELECT reasons, count(*) AS n, array_to_string(list_sort(list(source_row))[1:5], ',') AS samples FROM x GROUP BY reasons")
def quarantine_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected rows by reason, with the five smallest row numbers; each task keeps five a reason before they meet."""
    rows = intake.quarantined_raw(_judged(spark, sf_dir), "fatal", []).select("reasons", "source_row")
    part = rows.withColumn("_p", F.spark_partition_id())
    few = part.groupBy("reasons", "_p").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set("source_row")), 1, 5).alias("s"))
    all_ = few.groupBy("reasons").agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list("s"))), 1, 5).alias("s"))
    return all_.select("reasons", "n", F.array_join(F.col("s").cast("array<string>"), ",").alias("samples"))


@query(f"WITH {a.ALERTS}, x AS (SELECT 'alert' AS relation, count(*) AS n FROM alerts WHERE case_no NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'line', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'order', count(*) FROM orders WHERE o_custkey + 100 NOT IN (SELECT c_custkey FROM customer)) SELECT relation, n FROM x")
def dangling_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a target in each of three relations; a relation whose target table is empty is not judged."""
    t = lambda n: a.table(spark, sf_dir, n)
    relations = [("alert", a.alerts(spark, sf_dir), "case_no", t("orders"), "o_orderkey"), ("line", t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"), ("order", t("orders").withColumn("ref", F.col("o_custkey") + 100), "ref", t("customer"), "c_custkey")]
    counted = [intake.dangling(rows, ref, targets, key).agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n") for name, rows, ref, targets, key in relations]
    return reduce(DataFrame.unionByName, counted)


# --- privacy ---

_SAFE = {"=SUM(A1)": "'=SUM(A1)", "mail a.b@corp.example.com": "mail [EMAIL]", "see https://x.example/a?b from 10.1.2.3": "see [URL] from [IPV4]", "HOST-AB12 and db1.corp": "[HOSTNAME] and [FQDN]", "cve-2024-12345 on alpha-one": "[CVE] on alpha-one", "plain": "plain", "fe80::1 talks to alpha": "[IPV6] talks to alpha"}
_SAFE_SQL = "CASE text_raw " + " ".join("WHEN '" + k.replace("'", "''") + "' THEN '" + v.replace("'", "''") + "'" for k, v in _SAFE.items()) + " ELSE '''+bell' END"


@query(f"WITH {MESSY} SELECT source_row, {_SAFE_SQL} AS text_raw FROM messy")
def export_safe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.export_safe(messy(spark, sf_dir).select("source_row", "text_raw"))


@query(f"WITH {MESSY} SELECT source_row, CASE WHEN entity_id % 2 = 0 THEN replace(replace(text_raw, 'alpha-one', '[ASSET]'), 'alpha', '[ASSET]') ELSE replace(text_raw, 'plain', '[ASSET]') END AS redacted FROM messy")
def redacted_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared asset names of each entity leave its notes, longest first."""
    names = spark.createDataFrame([(i, ["alpha", "alpha-one", ""] if i % 2 == 0 else ["plain"]) for i in range(20)], "entity_id long, names array<string>")
    rows = messy(spark, sf_dir).join(F.broadcast(names), "entity_id", "left")
    return rows.select("source_row", privacy.redact_names(F.col("text_raw"), F.coalesce("names", F.array().cast("array<string>"))).alias("redacted"))


_NOTES_SQL = f"{MESSY}, s AS (SELECT entity_id, source_row, text_raw, substr(sha256(entity_id || '|' || source_row || '|' || text_raw), 1, 32) AS note_ref FROM messy)"


@query(f"WITH {_NOTES_SQL} SELECT note_ref, {_SAFE_SQL.replace(chr(39) * 3 + '=SUM', chr(39) + '=SUM').replace(chr(39) * 3 + '+bell' + chr(39), 'chr(1) || ' + chr(39) + '+bell' + chr(39))} AS redacted_text, length(text_raw) AS n_chars, len(string_split_regex(trim(text_raw), '\\s+')) AS n_words FROM s")
def stored_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes leave their rows for a store of redacted texts, by a reference that follows from the text."""
    return privacy.note_store(messy(spark, sf_dir).select("entity_id", "source_row", "text_raw"), "entity_id", "source_row", "text_raw")[1].select("note_ref", "redacted_text", "n_chars", "n_words")


@query(f"WITH {_NOTES_SQL} SELECT s.source_row, sha256('{{\"digest\":\"' || sha256({_SAFE_SQL.replace(chr(39) * 3 + '=SUM', chr(39) + '=SUM').replace(chr(39) * 3 + '+bell' + chr(39), 'chr(1) || ' + chr(39) + '+bell' + chr(39))}) || '\",\"status_raw\":\"' || status_raw || '\"}}') AS record_hash FROM s JOIN messy USING (source_row, text_raw)")
def note_digest_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record hashes that hold the digest of the redacted note instead of its reference."""
    held, notes = privacy.note_store(messy(spark, sf_dir).select("entity_id", "source_row", "text_raw", "status_raw"), "entity_id", "source_row", "text_raw")
    rows = held.join(notes.select("note_ref", F.sha2("redacted_text", 256).alias("digest")), "note_ref", "left")
    return rows.select("source_row", F.sha2(F.to_json(F.struct("digest", "status_raw"), {"ignoreNullFields": "false"}), 256).alias("record_hash"))


# --- files ---

_COLUMNS = catalogue._TEXT_COLUMNS
_BACK = catalogue._BACK


@query(_BACK)
def tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.folder(spark)
    a.raw_submission(spark, sf_dir).write.csv(path, header=True, sep="\t", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return catalogue._summary(files.good(files.read_csv(spark, path, _COLUMNS, sep="\t")))


@query(_BACK)
def wrapped_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with their records under a usual name or in their largest list, one object a line."""
    path, raw = shared.folder(spark), a.raw_submission(spark, sf_dir)
    lists = raw.groupBy((F.col("source_row") / 100).cast("long").alias("g"), (F.col("source_row") % 2).alias("odd")).agg(F.collect_list(F.struct(*_COLUMNS)).alias("r"))
    none = F.array().cast(lists.schema["r"].dataType)
    lists.select(F.to_json(F.struct(F.when(F.col("odd") == 0, F.col("r")).alias("alerts"), F.when(F.col("odd") == 1, F.col("r")).alias("things"), F.when(F.col("odd") == 1, none).alias("few")))).write.text(path)
    return catalogue._summary(files.read_wrapped(spark, path, _COLUMNS, multi_line=False))


@query(f"WITH {a.RAW} SELECT severity_raw, count(*) FILTER (source_row % 10 <> 3) AS n, count(*) FILTER (source_row % 10 = 3) AS n_corrupt FROM raw GROUP BY severity_raw")
def sql_dump_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT statements read as rows: two tuples each, over lines, with separators and line breaks in quotes, beside other SQL;
    one tuple in ten has a value too many and goes to quarantine."""
    path, raw = shared.folder(spark), a.raw_submission(spark, sf_dir)
    quote = lambda c: F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'"))
    note = F.concat(F.lit("'a; (b),\n"), F.replace(F.col("note_raw"), F.lit("'"), F.lit("''")), F.lit("'"))
    extra = F.when(F.col("source_row") % 10 == 3, F.concat(F.lit(", "), quote("severity_raw"))).otherwise("")
    cells = F.concat(F.lit("("), quote("case_ref"), F.lit(", "), quote("severity_raw"), F.lit(",\n "), note, extra, F.lit(")"))
    pairs = raw.groupBy(F.floor(F.col("source_row") / 2).alias("g")).agg(F.array_join(F.collect_list(cells), ",\n").alias("tuples"))
    head = F.lit("INSERT INTO `cases` (case_ref, severity_raw, note_raw)\nVALUES ")
    pairs.select(F.concat(F.lit("-- a row; or two\nSET x = 1;\n"), head, F.col("tuples"), F.lit(";"))).write.text(path)
    rows = files.read_sql_dump(spark, path, "cases", ["case_ref", "severity_raw", "note_raw"])
    known = F.coalesce("severity_raw", F.regexp_extract(files.CORRUPT, r"^\('\d+', '([^']*)'", 1))
    return rows.groupBy(known.alias("severity_raw")).agg(F.count(F.when(F.col(files.CORRUPT).isNull(), 1)).alias("n"), F.count(files.CORRUPT).alias("n_corrupt"))


@query("SELECT 4 AS n_files, count(*) AS n_rows, CASE WHEN count(*) FILTER (o_orderkey % 4 = 0) > 200 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (o_orderkey % 4 = 1) > 200 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (o_orderkey % 4 = 2) > 200 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (o_orderkey % 4 = 3) > 200 THEN 1 ELSE 0 END AS n_over FROM orders")
def file_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with more rows or columns than allowed; a cell with separators and a line break is one cell of one row."""
    path = shared.folder(spark)
    cell = F.concat(F.lit("a,b,c,d,e,f\n"), F.col("o_custkey")).alias("cell")
    a.table(spark, sf_dir, "orders").select("o_orderkey", cell, (F.col("o_orderkey") % 4).alias("part")).repartition("part").write.partitionBy("part").csv(path, header=True)
    found = files.over_limits(spark, path, 200, 5).withColumn("part", F.regexp_extract("file", r"part=(\d+)", 1))
    per = found.groupBy("part").agg(F.sum("n_rows").alias("n_rows"), F.max(F.col("over").cast("int")).alias("over"))
    return per.agg(F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows"), F.sum("over").alias("n_over"))


@query("""WITH f AS (SELECT 'part=' || (o_orderkey % 3) AS name, sha256(string_agg(o_orderkey || ',' || o_custkey, chr(10) ORDER BY o_orderkey) || chr(10)) AS h FROM orders GROUP BY o_orderkey % 3)
 SELECT sha256(sha256(string_agg(name || ':' || h, chr(10) ORDER BY name || ':' || h))) AS manifest, count(*) AS n_files FROM f""")
def manifest_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash over the files of a submission, from the hashes of their bytes; the writer's random file names are left out."""
    path, rows = shared.folder(spark), a.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 3).alias("part"))
    for part in range(3):
        rows.filter(f"part = {part}").drop("part").orderBy("o_orderkey").coalesce(1).write.csv(f"{path}/part={part}")
    hashes = files.file_hashes(spark, path).filter("name like '%.csv'").withColumn("name", F.substring_index("name", "/", 1))
    return files.manifest(hashes, buckets=1)


@query("SELECT o_custkey % 10 AS entity_id, 2 * count(*) AS n, round(2 * sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def appended_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches appended to one evidence table, compressed and partitioned by entity."""
    path, rows = shared.folder(spark), a.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("entity_id"), "o_orderkey", "o_totalprice")
    for _ in range(2):
        files.append_evidence(rows, path)
    return spark.read.parquet(path).groupBy(F.col("entity_id").cast("long").alias("entity_id")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F'" for k in ("csv", "json", "ndjson", "parquet")))
def flat_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows written as flat files of each kind, and read again."""
    rows, out = privacy.export_safe(a.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority", "o_totalprice")), []
    for kind in ("csv", "json", "ndjson", "parquet"):
        path = shared.folder(spark)
        files.export(rows, path, kind)
        back = spark.read.csv(path, header=True) if kind == "csv" else spark.read.parquet(path) if kind == "parquet" else spark.read.json(path)
        out.append(back.agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total")).select(F.lit(kind).alias("kind"), "n", "total"))
    return reduce(DataFrame.unionByName, out)


@query(f"WITH {a.RAW} SELECT severity, count(*) AS n FROM (SELECT {catalogue._SEVERITY} AS severity FROM raw) WHERE severity IS NOT NULL GROUP BY severity")
def streamed_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions that land as files are normalised and appended by a stream; each of three is cut into many files that come
    over several batches, and one lands twice: every row counts once."""
    landing, raw = shared.folder(spark), a.raw_submission(spark, sf_dir).withColumn("submission_id", F.concat(F.lit("s"), F.col("source_row") % 3))
    raw.repartition(5, "source_row").write.parquet(landing)
    raw.filter("submission_id = 's1'").write.mode("append").parquet(landing)
    prepare = lambda rows: intake.accepted(intake.normalised(rows, keep=("submission_id",))).select("submission_id", "source_row", "severity")
    rows = incremental.intake_stream(spark, landing, shared.folder(spark), prepare)
    return rows.groupBy("severity").agg(F.count("*").alias("n"))
