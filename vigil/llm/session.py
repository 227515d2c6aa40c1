"""Tables that Spark writes and reads again, to cut lineage; and reading the given tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset: on a cluster a folder of the warehouse, which all machines
    share; in local mode, as in tests, one folder of this machine for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/written"
    return _local_folder()


def _local_folder(kept: list[str] = []) -> str:  # noqa: B006
    if not kept:
        kept.append(tempfile.mkdtemp(prefix="vigil-"))
    return kept[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Deletes what written() has written so far, once its readers have ended; says how many tables."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    done = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        done += int(path.getFileSystem(conf).delete(path, True))
    return done


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_ids(df: DataFrame, column: str) -> None:
    """Ids that an operator keys its work by must be whole numbers; says so before any work starts."""
    kind = df.schema[column].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{column} must be a whole number, not {kind}")
