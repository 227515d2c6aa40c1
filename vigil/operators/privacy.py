"""Pseudonyms, redaction and text signatures, as column expressions."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of what notes must not carry, in the order of replacement.
REDACTIONS = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("IPV6", r"\b(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}\b"),
    ("IPV4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("FQDN", r"(?i)\b(?:[A-Za-z0-9-]+\.)+(?:com|net|org|io|co\.in|gov\.in|local|lan|corp|int)\b"),
    ("HOSTNAME", r"\b(?:HOST|SERVER|SRVR|DC|DB|WEB)-[A-Za-z0-9-]{2,}\b"),
    ("URL", r"(?i)\b(?:https?|ftp)://[^\s]+"),
    ("CVE", r"(?i)\bCVE-\d{4}-\d{4,7}\b"),
]

#: What a text must hold for a pattern to match anywhere: most notes hold none, and are then read once, not seven times.
_HINTS = {"EMAIL": "@", "IPV6": ":", "IPV4": ".", "FQDN": ".", "HOSTNAME": "-", "URL": "://", "CVE": "-"}


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC by its definition on built-in hashes, as lower-case hex."""
    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def pseudonym(key: bytes, key_ref: str, entity: Column, kind: str, raw: Column) -> Column:
    """kind_ and 32 hex digits; blank cells have none."""
    text = F.trim(raw)
    return F.when(text != "", F.concat(F.lit(f"{kind}_"), F.substring(hmac_sha256(key, F.concat_ws("|", entity.cast("string"), F.lit(kind), text, F.lit(key_ref))), 1, 32)))


def redact(rows: DataFrame, text: str) -> DataFrame:
    """rows with redacted, n_redacted and the sorted categories found."""
    out, found = rows.withColumn("redacted", F.col(text)), []
    total = F.lit(0)
    for name, pattern in REDACTIONS:
        n = f"_n_{name}"
        may = F.contains("redacted", F.lit(_HINTS[name]))
        out = out.withColumn(n, F.coalesce(F.when(may, F.regexp_count("redacted", F.lit(pattern))), F.lit(0)))
        out = out.withColumn("redacted", F.when(F.col(n) > 0, F.regexp_replace("redacted", pattern, f"[{name}]")).otherwise(F.col("redacted")))
        found.append(F.when(F.col(n) > 0, name))
        total = total + F.col(n)
    return out.withColumn("n_redacted", total.cast("long")).withColumn("categories", F.array_join(F.array_sort(F.array_compact(F.array(*found))), ",")).drop(*(f"_n_{n}" for n, _ in REDACTIONS))


_WORD = re.compile("[^ \t\n\x0b\x0c\r]+")


def shingle_signature(text: Column, n: int = 5) -> Column:
    """First 32 hex digits of SHA-256 over the sorted n-word shingles of the lower-case text, repeats included; words lie between
    blanks, short texts are one shingle. In Arrow batches: the built-in functions on arrays are interpreted, and slower."""

    @F.pandas_udf("string")
    def signed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            w = _WORD.findall(t.lower())
            shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
            out.append(hashlib.sha256(b"|".join(sorted(s.encode() for s in shingles))).hexdigest()[:32])
        return pd.Series(out, dtype="object")

    return signed(text)


def redact_names(text: Column, names: Column) -> Column:
    """Replaces declared names, longest first, wherever they stand."""
    ordered = F.sort_array(F.transform(F.filter(names, lambda n: n != ""), lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n"))))
    return F.aggregate(ordered, text, lambda t, x: F.replace(t, x["n"], F.lit("[ASSET]")))


def redacted(text: Column) -> Column:
    for name, pattern in REDACTIONS:
        text = F.regexp_replace(text, pattern, f"[{name}]")
    return text


def export_safe(rows: DataFrame) -> DataFrame:
    """Every text column without control characters, redacted, and not readable as a formula."""

    def safe(c: Column) -> Column:
        t = redacted(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
        return F.when(t.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), t)).otherwise(t)

    return rows.select(*(safe(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else f.name for f in rows.schema))


def note_store(cases: DataFrame, entity: str, key: str, note: str) -> tuple[DataFrame, DataFrame]:
    """(cases with note_ref instead of the text, notes by note_ref: redacted text, lengths and signature). The reference
    follows from entity, key and text, so loading the same row twice gives the same note."""
    ref = F.when(F.col(note).isNotNull(), F.substring(F.sha2(F.concat_ws("|", entity, key, note), 256), 1, 32))
    held = cases.withColumn("note_ref", ref)
    words = F.size(F.filter(F.split(F.trim(note), r"\s+"), lambda w: w != ""))
    notes = held.filter("note_ref is not null").select("note_ref", redacted(F.col(note)).alias("redacted_text"), F.char_length(note).alias("n_chars"), words.alias("n_words"), shingle_signature(F.col(note)).alias("signature"))
    return held.drop(note), notes.dropDuplicates(["note_ref"])
