"""Normalising one text cell to a value and a reason; column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that stand for a missing cell, booleans and vendor severities.
MISSING = ["", "-", "--", "n/a", "na", "null", "none", "nil", "nan", "undefined", "tbd"]
TRUE_TOKENS = ["true", "t", "yes", "y", "1", "on"]
FALSE_TOKENS = ["false", "f", "no", "n", "0", "off"]
SEVERITIES = {
    "critical": "CRITICAL", "crit": "CRITICAL", "sev1": "CRITICAL", "p1": "CRITICAL",
    "high": "HIGH", "major": "HIGH", "sev2": "HIGH", "p2": "HIGH",
    "medium": "MEDIUM", "moderate": "MEDIUM", "warning": "MEDIUM", "sev3": "MEDIUM", "p3": "MEDIUM",
    "low": "LOW", "minor": "LOW", "info": "LOW", "informational": "LOW", "sev4": "LOW", "p4": "LOW",
}
IPV4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def clean(c: Column) -> Column:
    """Trimmed text; tokens for missing become null."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin(MISSING), t)


def timestamp_utc(c: Column, zone: str = "UTC") -> Column:
    """Epoch seconds or milliseconds, ISO with or without offset, d/m/yyyy and d-Mon-yyyy; else null."""
    t = F.regexp_replace(clean(c), r"(\.\d{6})\d+", "$1")
    naive = F.coalesce(F.try_to_timestamp(t, F.lit("d/M/yyyy")), F.try_to_timestamp(t, F.lit("d-MMM-yyyy")), F.to_utc_timestamp(t.try_cast("timestamp"), zone))
    return (
        F.when(t.rlike(r"^\d{9,10}$"), F.timestamp_seconds(t.try_cast("long")))
        .when(t.rlike(r"^\d{12,13}$"), F.timestamp_millis(t.try_cast("long")))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}.*(Z|[+-]\d{2}:?\d{2})$"), t.try_cast("timestamp"))
        .when(t.rlike(r"^\d"), naive)
    )


def boolean(c: Column) -> Column:
    t = F.lower(clean(c))
    return F.when(t.isin(TRUE_TOKENS), True).when(t.isin(FALSE_TOKENS), False)


def integer(c: Column) -> Column:
    return F.regexp_replace(clean(c), ",", "").try_cast("double").try_cast("long")


def real(c: Column) -> Column:
    x = F.regexp_replace(clean(c), ",", "").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_text(c: Column) -> Column:
    """Text that a spreadsheet does not take for a formula; control characters go."""
    t = F.regexp_replace(clean(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.when(t.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), t)).otherwise(t)


def severity(c: Column) -> Column:
    vocabulary = F.create_map(*(F.lit(x) for pair in SEVERITIES.items() for x in pair))
    return vocabulary[F.lower(clean(c))]


def reason(raw: Column, value: Column, why: str) -> Column:
    """Why a cell that was not missing gave no value."""
    return F.when(clean(raw).isNotNull() & value.isNull(), F.lit(why))


# Status vocabulary, closed enums, event types with their aliases, actor tokens.
STATUSES = {
    "new": "NEW", "created": "NEW", "open": "OPEN", "assigned": "IN_PROGRESS", "investigating": "IN_PROGRESS", "in_progress": "IN_PROGRESS",
    "escalated": "ESCALATED", "pending_escalation": "ESCALATED", "resolved": "RESOLVED", "closed": "CLOSED", "complete": "CLOSED",
    "completed": "CLOSED", "reopened": "REOPENED", "re_opened": "REOPENED",
}
DISPOSITIONS = ["TRUE_POSITIVE", "FALSE_POSITIVE", "BENIGN_ANOMALY", "SUPPRESSED"]
LINK_TYPES = ["explicit", "inferred"]
EVENT_TYPES = ["created", "assigned", "note_added", "status_changed", "severity_changed", "escalated", "closed", "reopened"]
EVENT_ALIASES = {
    "new": "created", "opened": "created", "open": "created", "create": "created", "reopen": "reopened", "re_open": "reopened",
    "comment": "note_added", "note": "note_added", "note_added_to_case": "note_added", "add_note": "note_added",
    "assigned_to": "assigned", "assign": "assigned", "owner_changed": "assigned", "state_changed": "status_changed",
    "status_change": "status_changed", "changed_status": "status_changed", "severity": "severity_changed",
    "changed_severity": "severity_changed", "escalation": "escalated", "close": "closed",
}
AUTOMATION = ["automation", "auto", "automated", "bot", "system", "svc", "service", "script", "engine", "playbook", "soar", "correlation"]
HUMAN = ["human", "user", "analyst", "analyst_pseudo", "manual", "person", "operator", "engineer", "l1", "l2", "l3", "tier1", "tier2", "tier3"]
IPV6 = r"(?i)^(?=[^:]*:[^:]*:)(?!.*:::)(?!.*::.*::)(?!:[^:])(?!.*[^:]:$)(([0-9a-f]{1,4}(:|$)){8}|(?=.*::)([0-9a-f]{0,4}(:|$)){3,8})$"


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def _folded(c: Column) -> Column:
    return F.regexp_replace(F.lower(clean(c)), "[ -]", "_")


def day(c: Column, zone: str = "UTC") -> Column:
    return F.to_date(timestamp_utc(c, zone))


def ambiguous_day(c: Column) -> Column:
    """Whether day and month of d/m/yyyy could be exchanged; the day is read first."""
    t = clean(c)
    low = lambda i: F.regexp_extract(t, r"^(\d{1,2})/(\d{1,2})/\d{4}", i).try_cast("int") <= 12
    return F.coalesce(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}") & low(1) & low(2), F.lit(False))


def status(c: Column) -> Column:
    return _looked_up(_folded(c), STATUSES)


def enum(c: Column, allowed: list[str]) -> Column:
    """A member of a closed list, whatever its case and separators."""
    return _looked_up(F.upper(_folded(c)), {x.upper(): x for x in allowed})


def event_type(c: Column) -> Column:
    return _looked_up(_folded(c), {**{t: t for t in EVENT_TYPES}, **EVENT_ALIASES})


def actor_type(c: Column) -> Column:
    """automation, human or unknown; always an inference."""
    t = F.lower(F.trim(c))
    return F.when(t.isin(AUTOMATION), "automation").when(t.isin(HUMAN), "human").otherwise("unknown")


def is_ip(c: Column) -> Column:
    return F.coalesce(c.rlike(IPV4) | c.rlike(IPV6), F.lit(False))


def coerced(c: Column, kind: str) -> Column:
    """The cell as a type; what does not fit is null."""
    return boolean(c) if kind == "boolean" else integer(c) if kind in ("int", "bigint") else real(c) if kind == "double" else clean(c).try_cast(kind)
