"""Quality of submissions from what normalisation, validation and references counted: no score is asserted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import scalars


@dataclass(frozen=True)
class Cell:
    """A submitted column, its value after normalisation, and what a value that failed is: malformed or unmapped (a word
    that the vocabulary does not hold). sanitised says where the value was changed to be safe."""

    raw: Column
    value: Column
    fails_as: str = "malformed"
    sanitised: Column | None = None


def tallies(rows: DataFrame, keys: list[str], table: str, cells: dict[str, Cell]) -> DataFrame:
    """(keys, table_name, column_name, seen, missing, malformed, unmapped, sanitised), in one aggregate over the rows."""
    n = lambda c: F.count(F.when(c, 1))
    counts = []
    for name, cell in cells.items():
        present = scalars.clean(cell.raw).isNotNull()
        failed = present & cell.value.isNull()
        zero = F.lit(0).cast("long")
        counts.append(F.struct(
            F.lit(name).alias("column_name"), F.count("*").alias("seen"), n(~present).alias("missing"),
            (n(failed) if cell.fails_as == "malformed" else zero).alias("malformed"), (n(failed) if cell.fails_as == "unmapped" else zero).alias("unmapped"),
            (n(cell.sanitised) if cell.sanitised is not None else zero).alias("sanitised"),
        ))
    return rows.groupBy(*keys).agg(F.array(*counts).alias("c")).select(*keys, F.lit(table).alias("table_name"), F.inline("c"))


def completeness(counts: DataFrame, loaded: DataFrame, required: DataFrame, key: str = "submission_id") -> DataFrame:
    """F1. (key, completeness): mean share of filled cells over the required columns (table_name, column_name; a contract's few
    rows) of the tables that a submission loaded. A column never seen counts 0; nothing required counts 1."""
    tables = loaded.select(key, "table_name").distinct()
    due = tables.join(F.broadcast(required), "table_name").join(counts, [key, "table_name", "column_name"], "left")
    share = F.coalesce(1 - F.try_divide("missing", "seen"), F.lit(0.0))
    scored = due.groupBy(key).agg(F.avg(share).alias("completeness"))
    return tables.select(key).distinct().join(scored, key, "left").withColumn("completeness", F.coalesce("completeness", F.lit(1.0)))


def validity(counts: DataFrame, loaded: DataFrame, key: str = "submission_id") -> DataFrame:
    """F2. (key, validity): 1 less half the sum of the shares of quarantined rows, malformed cells and unmapped cells; 0 where no
    row was loaded. loaded: (key, table_name, n_rows, n_quarantined)."""
    rows = loaded.groupBy(key).agg(F.sum("n_rows").alias("n"), F.sum("n_quarantined").alias("q"))
    cells = counts.groupBy(key).agg(F.sum("seen").alias("cells"), (F.sum("malformed") + F.sum("unmapped")).alias("failed"))
    lost = F.col("q") / (F.col("n") + F.col("q")) + F.coalesce(F.try_divide("failed", "cells"), F.lit(0.0))
    score = F.when(F.col("n") > 0, F.greatest(F.lit(0.0), 1 - lost / 2)).otherwise(0.0)
    return rows.join(cells, key, "left").select(key, score.alias("validity"))


def consistency(dangling: DataFrame, loaded: DataFrame, referring: list[str], key: str = "submission_id") -> DataFrame:
    """F4. (key, consistency): 1 less the share of dangling references among them and the rows of the referring tables; 1 where
    there are none. dangling: the rows that intake.dangling() found, with their key."""
    rows = loaded.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("table_name").isin(referring), F.col("n_rows"))), F.lit(0)).alias("n"))
    lost = dangling.groupBy(key).agg(F.count("*").alias("d"))
    d = F.coalesce(F.col("d"), F.lit(0))
    return rows.join(lost, key, "left").select(key, (1 - F.coalesce(F.try_divide(d, d + F.col("n")), F.lit(0.0))).alias("consistency"))


def mapping_confidence(columns: DataFrame, key: str = "submission_id") -> DataFrame:
    """F6. (key, header, approved) of each submitted column -> (key, mapping): the share that an approved mapping resolves."""
    return columns.groupBy(key).agg(F.avg(F.col("approved").cast("int")).alias("mapping"))
