"""Where derived files go, and small results that several parts of a plan use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, of the warehouse on a cluster, of this machine in
    local mode, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local")
        base = tempfile.mkdtemp(prefix="vigil-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/written"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written once and read again: what follows uses rows per entity many times and must not rescan evidence."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def planned(rows: DataFrame) -> int:
    """Bytes of rows as planned from their files; nothing is read."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def among(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, small: int = 10 << 20, most: int = 1 << 22) -> DataFrame:
    """The rows whose key, a whole number, is one of wanted's, found before any shuffle. The keys go to all tasks as bits, 64
    neighbours to a row. A wanted table of at most small bytes is joined without a shuffle anyway; where the keys lie so far apart
    that they take more than most rows of bits, all rows go on to the join as well. Neither changes what a join with wanted gives."""
    if planned(wanted.select(wanted_key)) <= small:
        return rows
    word = lambda c: F.shiftright(F.col(c).cast("long"), 6)
    bit = lambda c: F.col(c).cast("long").bitwiseAND(63).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(wanted_key))
    words = kept(wanted.groupBy(word(wanted_key).alias("_word")).agg(F.bit_or(one).alias("_bits")))
    if words.count() > most:
        return rows
    return rows.join(F.broadcast(words), (word(key) == F.col("_word")) & (F.getbit("_bits", bit(key)) == 1), "left_semi")


def spread(rows: DataFrame) -> DataFrame:
    """rows over as many tasks as there are cores, where the table is so small that its files give fewer: for work that takes
    long for each row. Tables of a usual file for each core or more stay as they are, and are not shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if planned(rows) < cores * (128 << 20) else rows


def blocks(rows: DataFrame, size: int = 16 << 20) -> int:
    """In how many blocks of about size bytes of files rows are, for work that holds a block at a time."""
    return 1 + planned(rows) // size
