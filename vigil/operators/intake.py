"""Mapping, validation, quarantine, deduplication and references of submitted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions import scalars


def normalised(raw: DataFrame, zone: str = "UTC", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every submitted cell as a typed value beside the reasons for which cells failed; one pass, no UDF. Columns of keep are
    passed on."""
    c = F.col
    out = raw.select(
        *keep, "source_row", scalars.clean(c("case_ref")).alias("case_id"), scalars.severity(c("severity_raw")).alias("severity"), scalars.timestamp_utc(c("opened_raw"), zone).alias("opened"),
        scalars.safe_text(c("note_raw")).alias("note"), scalars.boolean(c("flag_raw")).alias("flag"), scalars.integer(c("amount_raw")).alias("amount"), scalars.real(c("amount_raw")).alias("amount_real"), c("analyst_raw").alias("analyst"),
        F.array_compact(F.array(
            F.when(scalars.clean(c("case_ref")).isNull(), "missing case_id"),
            scalars.reason(c("severity_raw"), scalars.severity(c("severity_raw")), "unmapped severity"),
        )).alias("fatal"),
        F.array_compact(F.array(
            scalars.reason(c("opened_raw"), scalars.timestamp_utc(c("opened_raw"), zone), "malformed opened"),
            scalars.reason(c("flag_raw"), scalars.boolean(c("flag_raw")), "malformed flag"),
            scalars.reason(c("amount_raw"), scalars.real(c("amount_raw")), "non-finite amount"),
        )).alias("counted"),
    )
    return out


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("fatal") == 0)


def quarantined(rows: DataFrame) -> DataFrame:
    """Rejected rows with their stage and joined reasons."""
    text = F.substring(F.array_join("fatal", "; "), 1, 500)
    stage = F.when(text.rlike("unmapped|malformed|non-finite|ambiguous"), "NORMALISE").otherwise("VALIDATE")
    return rows.filter(F.size("fatal") > 0).select("source_row", stage.alias("stage"), text.alias("reasons"))


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in a total order, so the winner does not depend on partitioning."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows beyond the first of their key, counted without a distinct over whole rows."""
    per_key = rows.groupBy(*key).agg(F.count("*").alias("n"))
    return per_key.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), (F.sum("n") - F.count("*")).alias("n_duplicates"))


def dangling(rows: DataFrame, ref: str, targets: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is not null and has no target. Where the target table is empty nothing is judged: it was not
    submitted, which says nothing about the references."""
    known = targets.select(F.col(key).alias(ref)).filter(F.col(ref).isNotNull())
    some = known.limit(1).select(F.lit(True).alias("_judged"))  # one row, or none
    return rows.filter(F.col(ref).isNotNull()).join(known.distinct(), ref, "left_anti").crossJoin(F.broadcast(some)).drop("_judged")


def cell_tallies(raw: DataFrame, columns: dict[str, tuple]) -> DataFrame:
    """Per column: cells seen, missing and failed. columns: name -> (raw column, value column)."""
    counts = []
    for name, (source, value) in columns.items():
        present = scalars.clean(source).isNotNull()
        counts.append(F.struct(F.lit(name).alias("column_name"), F.count("*").alias("seen"), F.count(F.when(~present, 1)).alias("missing"), F.count(F.when(present & value.isNull(), 1)).alias("failed")))
    return raw.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def apply_mapping(raw: DataFrame, mapping: dict[str, str], columns: list[str], required: list[str]) -> tuple[DataFrame, list[str]]:
    """Submitted columns under their canonical names (mapping: canonical -> submitted) and warnings. Canonical columns
    without a source are null; a source that was not submitted is dropped with a warning; a required column without a
    source stops the load."""
    usable = {k: v for k, v in mapping.items() if k in columns and v in raw.columns}
    warnings = [f"{k}: no column {v}" for k, v in mapping.items() if v not in raw.columns] + [f"{k}: not a column of the table" for k in mapping if k not in columns]
    missing = [c for c in required if c not in usable]
    if missing:
        raise ValueError(f"required columns without a source: {', '.join(missing)}")
    return raw.select(*(F.trim(F.col(usable[c]).cast("string")).alias(c) if c in usable else F.lit(None).cast("string").alias(c) for c in columns)), warnings


def best_profile(headers: DataFrame, profiles: DataFrame, floor: float = 0.5) -> DataFrame:
    """(submission, headers) and a small table (block, sources) -> the block whose sources are best covered, if at least
    by the floor; of equals the first by name."""
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    share = F.size(F.array_intersect(low(F.col("headers")), low(F.col("sources")))) / F.size("sources")
    pairs = headers.crossJoin(F.broadcast(profiles)).withColumn("share", F.round(share, 6))  # a row for each profile
    best = pairs.groupBy("submission").agg(F.min(F.struct((-F.col("share")).alias("minus"), "block")).alias("b"))
    return best.select("submission", F.when(-F.col("b.minus") >= floor, F.col("b.block")).alias("block"), (-F.col("b.minus")).alias("share"))


# Headers that point to a table, in the order in which they count.
HINTS = {
    "case_event": ["event_type", "from_state", "to_state", "event_ts"],
    "escalation": ["escalation_id", "acknowledged_ts", "reason_code"],
    "telemetry_daily": ["event_count", "last_seen_ts", "source_type"],
    "asset": ["asset_class", "criticality", "expected_log_sources"],
    "case": ["case_id", "disposition", "closed_at", "root_cause_action"],
    "alert": ["alert_id", "severity", "rule_id", "event_ts"],
}


def inferred_table(headers):
    """The table that a list of headers points to: the first with a hint among them."""
    low = F.transform(headers, lambda x: F.lower(x))
    return F.coalesce(*(F.when(F.arrays_overlap(low, F.array(*map(F.lit, v))), F.lit(k)) for k, v in HINTS.items()), F.lit("unknown"))


def quarantined_raw(rows: DataFrame, fatal: str, payload: list[str]) -> DataFrame:
    """Rejected rows with stage, reasons and the submitted cells, each cut to 300 characters, as JSON."""
    text = F.substring(F.array_join(fatal, "; "), 1, 500)
    stage = F.when(text.rlike("unmapped|malformed|non-finite|ambiguous"), "NORMALISE").otherwise("VALIDATE")
    cells = F.struct(*(F.substring(F.col(c).cast("string"), 1, 300).alias(c) for c in payload))
    return rows.filter(F.size(fatal) > 0).select("source_row", stage.alias("stage"), text.alias("reasons"), F.to_json(cells, {"ignoreNullFields": "false"}).alias("raw"))
