"""Reading submitted files as text columns, and writing evidence; unreadable rows go to quarantine, not away."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators.sequences import Ordered

CORRUPT = "_corrupt"


def _text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])


def read_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """Every cell as text; a row of the wrong width keeps its raw line in _corrupt. sep="\\t" reads TSV."""
    return spark.read.schema(_text_schema(columns)).csv(path, header=True, sep=sep, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, escape='"')


def read_ndjson(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One record per line; lines that are not JSON keep their text in _corrupt."""
    return spark.read.schema(_text_schema(columns)).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, primitivesAsString=True)


def read_json(spark: SparkSession, path: str, columns: list[str], wrapper: str | None = None) -> DataFrame:
    """A bare list, or an object that holds the list under wrapper: every record becomes a row."""
    row = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if wrapper is None:
        return spark.read.schema(row).json(path, multiLine=True)
    whole = spark.read.schema(T.StructType([T.StructField(wrapper, T.ArrayType(row))])).json(path, multiLine=True)
    return whole.select(F.inline(wrapper))


def good(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def corrupt(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(name, n_bytes, sha256) of the files below a path; the name holds the folders below it, so equal names differ."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = F.regexp_replace("path", "^.*?" + re.escape(path.rstrip("/").split("://")[-1].lstrip("/")) + "/", "")
    return files.select(below.alias("name"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(hashes: DataFrame, buckets: int = 256) -> DataFrame:
    """(manifest, n_files): one hash over (name, sha256) of files, whatever their order: a hash of the hashes of buckets of names, so no
    row holds all of them."""
    h = F.concat_ws(":", "name", "sha256")
    bucket = F.pmod(F.xxhash64("name"), F.lit(buckets)).alias("b")
    some = hashes.groupBy(bucket).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(h)), "\n"), 256).alias("h"), F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("b", "h")))
    return some.agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["h"]), "\n"), 256).alias("manifest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"))


def manifest_hash(spark: SparkSession, path: str, buckets: int = 256) -> DataFrame:
    """The manifest of all files below a path."""
    return manifest(file_hashes(spark, path), buckets)


def append_evidence(df: DataFrame, path: str, partition: str = "entity_id") -> None:
    """Appends to the evidence table, clustered by its partition column so that each task writes few files."""
    df.repartition(partition).write.mode("append").option("compression", "zstd").partitionBy(partition).parquet(path)


# Names under which objects hold their records.
WRAPPERS = ["alerts", "cases", "rows", "data", "records"]


def read_wrapped(spark: SparkSession, path: str, columns: list[str], multi_line: bool = True) -> DataFrame:
    """Objects that hold their records in one of the usual lists, else in their largest list: every record is a row."""
    whole = spark.read.json(path, multiLine=multi_line, primitivesAsString=True)
    lists = [f.name for f in whole.schema if f.dataType.simpleString().startswith("array<struct")]
    if not lists:
        return whole.select(*(F.col(c) if c in whole.columns else F.lit(None).cast("string").alias(c) for c in columns))
    named = [x for x in WRAPPERS if x in lists]
    sizes = F.sort_array(F.array(*(F.struct(F.coalesce(F.size(x), F.lit(-1)).alias("n"), F.lit(x).alias("x")) for x in lists)), asc=False)[0]["x"]
    chosen = F.coalesce(*(F.when(F.size(x) >= 0, x) for x in named), sizes)
    parts = []
    for x in lists:
        row = whole.filter(chosen == x).select(F.explode(x).alias("r"))
        known = {f.name for f in whole.schema[x].dataType.elementType}
        parts.append(row.select(*(F.col(f"r.{c}").cast("string").alias(c) if c in known else F.lit(None).cast("string").alias(c) for c in columns)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def logical_lines(spark: SparkSession, path: str, quote: str, end: str = "\n", comment: str | None = None) -> DataFrame:
    """(file, line): the texts of files cut at end (a line break, or another character besides), but not inside quotes: line
    breaks and separators in quotes stay. comment matches the beginnings of lines that are comments; outside quotes they are left
    out, and their own quotes never count.

    Files are cut everywhere first, then pieces with an open quote are put together again: whether a quote is open at a piece
    follows from the number of quotes before it, a running sum that no file, however large, gathers in one task. What an
    open quote at the end of a file leaves is a line of its own.
    """
    rows = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    rows = rows.select(F.col("file_path").alias("file"), F.col("file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    said = F.regexp_extract("value", comment, 0) if comment else F.lit("")
    rows = rows.withColumn("comment", said).withColumn("value", F.expr("substring(value, length(comment) + 1)"))
    cut = F.array(F.col("value")) if end == "\n" else F.split("value", re.escape(end))
    pieces = rows.select("file", "block", "at", "comment", F.posexplode(cut).alias("i", "value"), (F.size(cut) - 1).alias("last"))
    pieces = pieces.withColumn("quotes", F.length("value") - F.length(F.translate("value", quote, "")))
    order = ["block", "at", "i"]
    known = Ordered(pieces, ["file"], order).running(upto=("quotes", "sum"))
    outside = (F.col("upto") - F.col("quotes")) % 2 == 0  # no quote is open where the piece begins
    begins = outside & ((F.col("i") > 0) if end != "\n" else F.lit(True))
    kept_comment = F.when((F.col("i") == 0) & ~outside, F.col("comment")).otherwise("")
    text = F.concat(kept_comment, "value", F.when(F.col("i") == F.col("last"), "\n").otherwise(end))
    marked = known.select("file", *order, begins.cast("long").alias("begins"), text.alias("text"))
    lines = Ordered(marked, ["file"], order).running(line=("begins", "sum"))
    whole = lines.groupBy("file", "line").agg(F.sort_array(F.collect_list(F.struct(*order, "text"))).alias("parts"))
    joined = F.array_join(F.col("parts.text"), "")
    return whole.select("file", joined.alias("line")).withColumn("line", F.expr("substring(line, 1, length(line) - 1)"))


_NAME = r"[`\"\[]?(?:\w+[`\"\]]?\.[`\"\[]?)?(\w+)[`\"\]]?"
_INSERT = rf"(?is)^insert\s+(?:ignore\s+)?into\s+{_NAME}\s*(?:\(([^)]*)\))?\s*values\s*(.*)$"
_TUPLE = r"\((?:[^()']++|'[^']*+')*+\)"
_CELL = r"'[^']*+(?:''[^']*+)*+'|[^,'\s][^,']*+|(?<=,)(?=\s*,)|(?<=,)(?=\s*$)|^(?=\s*,)"


def sql_statements(spark: SparkSession, path: str) -> DataFrame:
    """(file, statement, table_name, names, tuples) of a dump; nothing is executed. Statements may run over lines and hold several
    tuples; lines that begin with -- or # and comments in /* */ at the beginning of a line are left out, statements other than
    INSERT ... VALUES have no table."""
    lines = logical_lines(spark, path, "'", ";", r"^\s*(?:--.*|#.*|/\*.*?\*/)")
    text = F.trim("line", F.lit(" \t\r\n"))
    part = lambda i: F.regexp_extract("statement", _INSERT, i)
    rows = lines.select("file", text.alias("statement")).filter("statement <> ''")
    names = F.filter(F.transform(F.split(part(2), ","), lambda c: F.regexp_replace(F.trim(c, F.lit(" \t\r\n")), '[`"\\[\\]]', "")), lambda c: c != "")
    return rows.select("file", "statement", F.lower(F.nullif(part(1), F.lit(""))).alias("table_name"), names.alias("names"), F.regexp_extract_all(part(3), F.lit(_TUPLE), F.lit(0)).alias("tuples"))


def dump_table(spark: SparkSession, path: str) -> str | None:
    """The table of a dump to read where none is named: the first by name whose columns point to a known table, else the one of
    most rows."""
    from vigil.operators.intake import inferred_table

    rows = sql_statements(spark, path).filter("table_name is not null")
    known = F.max((inferred_table(F.col("names")) != "unknown").cast("int"))
    best = rows.groupBy("table_name").agg(known.alias("known"), F.sum(F.size("tuples")).alias("n")).orderBy(F.desc("known"), F.when(F.col("known") == 0, -F.col("n")), "table_name").first()
    return best.table_name if best else None


def read_sql_dump(spark: SparkSession, path: str, table: str | None, columns: list[str]) -> DataFrame:
    """Rows of a table's INSERT statements, of dump_table() where table is None. Values go by the statement's column list,
    or by columns where it has none. A tuple with another number of values keeps its text in _corrupt, as does every statement into the
    table, or into none, that has no tuple to read; SQL other than INSERT (DDL, SET ...) is no row and left out."""
    table = table or dump_table(spark, path) or ""
    statements = sql_statements(spark, path)
    mine = statements.filter((F.col("table_name") == table.lower()) | (F.col("table_name").isNull() & F.col("statement").rlike(r"(?i)\binsert\s+(?:ignore\s+)?into\b")))
    listed = F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(*map(F.lit, columns)))
    rows = mine.select("statement", listed.alias("names"), F.explode_outer("tuples").alias("tuple"))
    inner = F.expr("substring(tuple, 2, length(tuple) - 2)")
    cells = F.transform(F.regexp_extract_all(inner, F.lit(_CELL), F.lit(0)), lambda c: F.trim(c, F.lit(" \t\r\n")))
    plain = F.transform(cells, lambda c: F.when((F.upper(c) == "NULL") | (c == ""), None).when(c.startswith("'"), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit("''"), F.lit("'"))).otherwise(c))
    rows = rows.withColumn("cells", plain).withColumn("fits", F.coalesce(F.size("cells") == F.size("names"), F.lit(False)))
    has = lambda c: F.array_contains("names", F.lit(c))
    values = [F.when(has(c) & F.col("fits"), F.expr(f"cells[array_position(names, '{c}') - 1]")).alias(c) for c in columns]
    return rows.select(*values, F.when(~F.col("fits"), F.coalesce("tuple", "statement")).alias(CORRUPT))


def over_limits(spark: SparkSession, path: str, max_rows: int, max_columns: int, header: bool = True, sep: str = ",") -> DataFrame:
    """Files below a path with more rows or columns than allowed: separators and line breaks inside quotes are neither, rows are
    counted by file, no file is held. Empty lines are no rows."""
    lines = logical_lines(spark, path, '"').filter(F.trim("line", F.lit("\r \t")) != "")
    bare = F.regexp_replace("line", '"[^"]*"', "")
    counted = lines.groupBy("file").agg((F.count("*") - int(header)).alias("n_rows"), F.max(F.length(bare) - F.length(F.translate(bare, sep, "")) + 1).alias("n_columns"))
    return counted.withColumn("over", (F.col("n_rows") > max_rows) | (F.col("n_columns") > max_columns))


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """A small reference table of days (date, name); lines that begin with # are comments."""
    rows = spark.read.schema("date string, name string, scope string").csv(path, header=True, comment="#")
    return F.broadcast(rows.select(F.to_date("date").alias("date"), "name"))


def export(rows: DataFrame, path: str, kind: str) -> None:
    """Flat files of one of the four kinds."""
    {"csv": lambda w: w.csv(path, header=True, escape='"'), "json": lambda w: w.json(path), "ndjson": lambda w: w.json(path), "parquet": lambda w: w.option("compression", "zstd").parquet(path)}[kind](rows.write)
