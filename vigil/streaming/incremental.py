"""Evidence and per-entity features kept up by streams; both go on after a restart where they stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def features(rows: DataFrame) -> DataFrame:
    """The same aggregate for batches and streams. rows: (entity_id, kind, category, severity, value), kind alert or case;
    severities outside the four, and none, count as unknown."""
    alert, severity = F.col("kind") == "alert", F.coalesce(F.col("severity"), F.lit(""))
    n = lambda c: F.count(F.when(c, 1))
    by_severity = [n(alert & (severity == s)).alias(f"n_{s.lower()}") for s in SEVERITIES]
    return rows.groupBy("entity_id").agg(
        n(alert).alias("n_alerts"), n(alert & (F.col("category") == "error")).alias("n_errors"), n(F.col("kind") == "case").alias("n_cases"),
        *by_severity, n(alert & ~severity.isin(*SEVERITIES)).alias("n_unknown"), F.sum(F.when(alert, F.col("value"))).alias("total"),
    )


def maintain(spark: SparkSession, source: str, folder: str, prepare: Callable[[DataFrame], DataFrame], files_per_batch: int = 1) -> StreamingQuery:
    """Starts the stream of Parquet files below source until all that are there are read. State is one row per entity. Each
    batch writes only the entities it changed, under its number, so a repeated batch overwrites itself; folder holds the
    table and the stream's progress, and the next start with it goes on from there."""
    schema = spark.read.parquet(source).schema
    stream = prepare(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/features/batch={number}")

    return features(stream).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").foreachBatch(keep).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of each entity of a maintained table."""
    rows = spark.read.parquet(f"{folder}/features")
    names = [c for c in rows.columns if c not in ("entity_id", "batch")]
    return rows.groupBy("entity_id").agg(F.max_by(F.struct(*names), "batch").alias("r")).select("entity_id", "r.*")


def maintained(spark: SparkSession, source: str, folder: str, prepare: Callable[[DataFrame], DataFrame], files_per_batch: int = 1) -> DataFrame:
    maintain(spark, source, folder, prepare, files_per_batch).awaitTermination()
    return latest(spark, folder)


def take_in(
    spark: SparkSession,
    landing: str,
    folder: str,
    prepare: Callable[[DataFrame], DataFrame],
    keys: tuple[str, ...] = ("submission_id", "source_row"),
    received: tuple[str, str] | None = None,
    files_per_batch: int = 2,
) -> StreamingQuery:
    """Starts the intake of landed Parquet files until all that are there are read.

    Every row of a submission is taken exactly once by its keys, however the submission is cut into files and batches, if
    files are delivered again, and over restarts and killed batches: the keys taken are the stream's state, the sink's log says
    which files count. prepare turns rows into evidence, row for row, and keeps the keys. received names a time column and
    how late the same row may come again; keys older than that leave the state, which otherwise grows by one entry a row.
    """
    stream = spark.readStream.schema(spark.read.parquet(landing).schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    once = stream.withWatermark(*received).dropDuplicatesWithinWatermark(list(keys)) if received else stream.dropDuplicates(list(keys))
    sink = prepare(once).writeStream.format("parquet").option("path", f"{folder}/evidence").option("checkpointLocation", f"{folder}/progress")
    return sink.outputMode("append").trigger(availableNow=True).start()


def intake_stream(spark: SparkSession, landing: str, folder: str, prepare: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    """take_in() to its end, and the evidence it keeps."""
    take_in(spark, landing, folder, prepare, **options).awaitTermination()
    return spark.read.parquet(f"{folder}/evidence")
