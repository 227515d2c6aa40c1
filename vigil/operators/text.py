"""Templated notes: exact signatures, MinHash bands and term-weighted cosine to a bucket's first note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once: a lambda variable is not copied into every place that uses it."""
    return F.transform(F.array(value), f)[0]


def _shingled(text: str, n: int) -> Column:
    def made(w: Column) -> Column:
        out = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(out)).otherwise(F.array().cast("array<string>"))

    return _bound(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), made)


def bands(rows: DataFrame, text: str, n: int = 3, seeds: int = 32, per_band: int = 4) -> DataFrame:
    """(band, signature) rows of each note, without its text: MinHash of the n-word shingles of lower-case
    [a-z0-9]+ words by the smallest SHA-256 under each seed. Notes without a shingle have none."""
    hashed = lambda seed: lambda s: F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), s), 256), 1, 16)
    signed = lambda sh: F.array(*(F.array_min(F.transform(sh, hashed(k))) for k in range(seeds)))
    grouped = lambda sig: F.transform(F.sequence(F.lit(0), F.lit(seeds // per_band - 1)), lambda b: F.array_join(F.slice(sig, b * per_band + 1, per_band), "|"))
    made = _bound(_shingled(text, n), lambda sh: F.when(F.size(sh) > 0, _bound(signed(sh), grouped)))
    return rows.select(*(c for c in rows.columns if c != text), F.posexplode(made).alias("band", "signature"))


def templates(notes: DataFrame, entity: str, note: str) -> DataFrame:
    """Buckets that hold two notes or more, with their anchor (smallest id) and size."""
    return notes.groupBy(entity, "band", "signature").agg(F.count("*").alias("n_notes"), F.min(note).alias("anchor")).filter("n_notes > 1")
