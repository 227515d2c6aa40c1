"""Ordered work within keys - numbers, running totals, the row before, trailing time windows - that no hot key gathers in
one task.

Rows are range-partitioned by key and order together, so a key with a third of all rows spans many partitions, and
written once: the partition is then a column that a lost executor cannot change. Within a partition and key an ordinary
window does the work; what earlier partitions of the same key add comes from one summary row for each partition and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.plans.shared import kept


class Ordered:
    """rows in order within keys. The order must tell rows apart: equal rows stay together in one partition.

    Without keys the whole table is one order. Null keys are a key of their own. Names that begin with _ are for the work in between.
    """

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str | Column], parts: int | None = None):
        if not keys:  # the whole table is one key
            rows, keys = rows.withColumn("_whole", F.lit(0)), ["_whole"]
        n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.keys, self.order = keys, order
        self.placed = kept(rows.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
        self.inner = W.partitionBy("_part", *keys).orderBy(*order)

    def _with_before(self, rows: DataFrame, summary: list[Column], before: dict[str, Column]) -> DataFrame:
        """Adds to rows what the summaries of the key's earlier partitions give; null in its first."""
        earlier = W.partitionBy(*self.keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        per_part = rows.groupBy("_part", *self.keys).agg(*summary)
        added = per_part.select("_part", *self.keys, *(c.over(earlier).alias(name) for name, c in before.items()))
        added = added.filter(" or ".join(f"{name} is not null" for name in before)).withColumnsRenamed({c: f"_k_{c}" for c in ("_part", *self.keys)})
        same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in ("_part", *self.keys)]
        joined = rows.join(added, same[0] if len(same) == 1 else _all(same), "left")
        return joined.drop(*(f"_k_{c}" for c in ("_part", *self.keys)))

    def running(self, **columns: tuple[str, str]) -> DataFrame:
        """name=(column, "sum" or "max"): totals of the key's rows up to and with each row."""
        how = {"sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "max": (F.max, F.greatest)}
        upto = self.inner.rowsBetween(W.unboundedPreceding, W.currentRow)
        rows = self.placed.withColumns({f"_r_{name}": how[f][0](c).over(upto) for name, (c, f) in columns.items()})
        summary = [how[f][0](c).alias(f"_s_{name}") for name, (c, f) in columns.items()]
        before = {f"_b_{name}": how[f][0](f"_s_{name}") for name, (_, f) in columns.items()}
        rows = self._with_before(rows, summary, before)
        rows = rows.withColumns({name: how[f][1](F.col(f"_r_{name}"), F.col(f"_b_{name}")) for name, (_, f) in columns.items()})
        return rows.drop("_part", "_whole", *before, *(f"_r_{name}" for name in columns))

    def numbered(self, name: str = "seq") -> DataFrame:
        """Adds each row's place within its key, from 1."""
        rows = self.placed.withColumn(name, F.row_number().over(self.inner).cast("long"))
        rows = self._with_before(rows, [F.count("*").alias("_n")], {"_b": F.sum("_n")})
        return rows.withColumn(name, F.col(name) + F.coalesce("_b", F.lit(0))).drop("_part", "_whole", "_b")

    def previous(self, **columns: str) -> DataFrame:
        """name=column: the value of the key's row before; null in its first."""
        rows = self.placed.withColumn("_place", F.row_number().over(self.inner))
        rows = rows.withColumns({f"_r_{name}": F.lag(c).over(self.inner) for name, c in columns.items()})
        ends = F.max_by(F.struct(*(F.col(c).alias(name) for name, c in columns.items())), "_place").alias("_end")
        rows = self._with_before(rows, [ends], {"_b": F.last("_end")})
        first = F.col("_place") == 1
        rows = rows.withColumns({name: F.when(first, F.col(f"_b.{name}")).otherwise(F.col(f"_r_{name}")) for name in columns})
        return rows.drop("_part", "_whole", "_place", "_b", *(f"_r_{name}" for name in columns))


def less_own(rows: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """Adds the sums of values over the other rows of each row's keys. The sums are aggregated by key and joined back, so
    a large key is added up where its rows are; a null key is a key of its own."""
    rows = rows.withColumns({f"_o_{name}": v for name, v in values.items()})
    sums = rows.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(*(F.sum(f"_o_{name}").alias(f"_a_{name}") for name in values))
    joined = rows.join(sums, _all([F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]))
    out = joined.withColumns({name: F.col(f"_a_{name}") - F.col(f"_o_{name}") for name in values})
    return out.drop(*(f"_k_{k}" for k in keys), *(f"{x}{name}" for name in values for x in ("_o_", "_a_")))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def trailing(rows: DataFrame, keys: list[str], time_s: str, width_s: int, parts: int | None = None, **columns: str) -> DataFrame:
    """(keys, time, name...): for each time at which a key has rows, the sums of each column over the rows of the last
    width_s seconds, both ends included. Times are whole seconds; rows without one are left out.

    Each row enters at its time and leaves a second after the window; rows of equal times are added up first, so a key
    that is hot at one moment sends one row. A running total over entries and exits is the window's content.
    """
    known = rows.filter(F.col(time_s).isNotNull())
    sums = {name: F.sum(c).alias(name) for name, c in columns.items()}
    enter = known.groupBy(*keys, time_s).agg(*sums.values(), F.lit(True).alias("_here"))
    leave = enter.withColumns({time_s: F.col(time_s) + width_s + 1, "_here": F.lit(False)} | {name: -F.col(name) for name in columns})
    both = enter.unionByName(leave).groupBy(*keys, time_s).agg(*(F.sum(name).alias(name) for name in columns), F.max("_here").alias("_here"))
    out = Ordered(both, keys, [time_s], parts).running(**{name: (name, "sum") for name in columns})
    return out.filter("_here").drop("_here")
