"""Near duplicates among embeddings: an exact range join in the metric of directions.

Unit vectors whose cosine is at least c lie at most r = sqrt(2 - 2c) apart. Pivots cut a set of vectors into cells by
nearest pivot. By the triangle inequality a vector can only reach into another cell if it lies within r of the plane
between the two pivots, and within r of the cell's radius around its pivot; it is copied to those cells as a guest.
A pair of home vectors of two cells is looked at in the cell of the smaller number only, so every pair is seen at
most once. Cells that are still large are cut again by pivots of their own, and their guests are copied to all parts
that they can reach. What is left joins independently, in blocks. Equal vectors count as one with a weight.

Vectors are compared with vectors of their own length only: each length begins as a cell of its own. Null and zero
vectors and those with null or non-finite components link with nothing. vec_id may have any type that can be ordered;
it need not be unique: each row is a vector of its own, and rows that repeat an id are linked by their own vectors.
Null ids link with nothing. Empty tables give no rows, and other columns are not read. In data without structure
most vectors lie near many planes; then copying, not a cap, is the price of exactness.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import graphs
from vigil.llm.session import written


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.95
    #: Home vectors for each pivot; a cell of twice as many or more is cut again.
    per_pivot: int = 4096
    #: Pivots of one cell at most, all pivots of one level at most (they pass through the driver), and levels.
    fan: int = 256
    pivots: int = 32_768
    levels: int = 3
    block: int = 2048


@dataclass(frozen=True)
class Cut:
    """How one cell is cut: pivots, distances between them, and (once known) radii of the parts' home vectors."""

    pivots: np.ndarray
    between: np.ndarray
    radius: np.ndarray


def _normed(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component goes first, so no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unit(column: pa.Array) -> np.ndarray:
    return _normed(np.asarray(column.flatten().cast(pa.float64())).reshape(len(column), -1))


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def _visits(x: np.ndarray, guest: np.ndarray, cut: Cut, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each vector, and the parts that it must be copied to: those of smaller number for home
    vectors, all for guests."""
    d = _distance(x, cut.pivots)
    home = d.argmin(axis=1)
    own, slack = d[np.arange(len(x)), home][:, None], r + 1e-6
    near = (d**2 - own**2 <= 2 * slack * cut.between[home]) & (d <= cut.radius[None, :] + slack)
    return home, near & (guest[:, None] | (np.arange(d.shape[1])[None, :] < home[:, None]))


def _join(cosine: float):
    """Links among the rows of one pair of blocks: per row, the weight of its links and a root to connect with."""

    def rows(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        key, weight = np.asarray(group["key"]), np.asarray(group["weight"])
        x, own, guest = _unit(group["vec"].combine_chunks()), np.asarray(group["own"]), np.asarray(group["guest"])
        first, second, visited = (group[c][0].as_py() for c in ("first", "second", "visited"))
        left = np.flatnonzero(~guest & (own == first)) if visited else np.flatnonzero(own == first)
        right = np.flatnonzero(guest) if visited else np.flatnonzero(own == second)
        i, j = np.nonzero(x[left] @ x[right].T >= cosine)
        i, j = left[i], right[j]
        use = i < j if not visited and first == second else slice(None)
        i, j = i[use], j[use]
        n = (np.bincount(i, weight[j], len(key)) + np.bincount(j, weight[i], len(key))).astype(np.int64)
        some = n > 0
        return pa.table({"key": key[some], "n": n[some], "root": graphs.local_roots(key, i, j)[some]})

    return rows


def _by_cell(batches, cuts: dict[int, Cut]):
    """(cell's cut, rows of the cell in a batch); rows of other cells with None."""
    for batch in batches:
        cell = np.asarray(batch.column("cell"))
        for one in np.unique(cell):
            rows = batch.filter(pa.array(cell == one))
            for at in range(0, rows.num_rows, 512) if one in cuts else [0]:
                yield cuts.get(one), rows.slice(at, 512) if one in cuts else rows


def _cut_cells(rows: DataFrame, big: dict[int, int], first_cell: int, r: float, s: Settings) -> tuple[DataFrame, int]:
    """rows with the cells of big (cell -> home vectors) cut into parts, whose numbers begin at first_cell."""
    spark = rows.sparkSession
    fan = {c: min(s.fan, n // s.per_pivot, s.pivots // len(big)) for c, n in big.items()}
    part = lambda c: min(1.0, 4 * fan[c] / big[c])
    ticket = F.pmod(F.xxhash64("key", F.lit("pivot")), F.lit(1 << 30))
    shares = spark.createDataFrame([(c, int(part(c) * (1 << 30))) for c in big], "cell long, share long")
    drawn = rows.filter(~F.col("guest")).join(F.broadcast(shares), "cell").filter(ticket < F.col("share"))
    vectors: dict[int, list] = {c: [] for c in big}
    for row in drawn.select("cell", "vec", ticket.alias("t"), "key").orderBy("cell", "t", "key").toLocalIterator():  # some 4 x pivots
        if len(vectors[row.cell]) < max(fan[row.cell], 1):
            vectors[row.cell].append(row.vec)
    cuts, start = {}, {}
    for c, v in vectors.items():
        if len(v) > 1:
            x = _normed(np.array(v, float))
            cuts[c], start[c] = Cut(x, _distance(x, x), np.full(len(x), np.inf)), first_cell
            first_cell += len(x)
    sent = spark.sparkContext.broadcast(cuts)

    def radii(batches):
        most = {c: np.full(len(cut.pivots), -np.inf) for c, cut in sent.value.items()}
        for cut, part_ in _by_cell(batches, sent.value):
            if cut is not None and part_.num_rows:
                d = _distance(_unit(part_.column("vec")), cut.pivots)
                home = d.argmin(axis=1)
                np.maximum.at(most[part_.column("cell")[0].as_py()], home, d[np.arange(len(d)), home])
        for c, x in most.items():
            keep = np.flatnonzero(np.isfinite(x))
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(keep), pa.int64()), pa.array(keep), pa.array(x[keep])], ["cell", "part", "radius"])

    found = rows.filter(~F.col("guest")).filter(F.col("cell").isin(list(cuts)) if len(cuts) < 500 else F.lit(True)).select("cell", "vec").mapInArrow(radii, "cell long, part long, radius double").groupBy("cell", "part").agg(F.max("radius").alias("radius"))
    for cut in cuts.values():
        cut.radius[:] = -np.inf
    for row in found.toLocalIterator():  # a number for each pivot
        cuts[row.cell].radius[row.part] = row.radius
    known = spark.sparkContext.broadcast((cuts, start))

    names = ["cell", "key", "weight", "vec", "guest"]

    def moved(batches):
        cuts_, start_ = known.value
        for cut, rows_ in _by_cell(batches, cuts_):
            if cut is None or not rows_.num_rows:
                yield pa.RecordBatch.from_arrays(rows_.columns, names)
                continue
            guest = np.asarray(rows_.column("guest").to_numpy(zero_copy_only=False))
            home, copies = _visits(_unit(rows_.column("vec")), guest, cut, r)
            base = start_[rows_.column("cell")[0].as_py()]
            row, cell = np.nonzero(copies)
            stay = np.flatnonzero(~guest)
            for at, to, is_guest in ((stay, home[stay], False), (row, cell, True)):
                yield pa.RecordBatch.from_arrays([pa.array(base + to, pa.int64()), *(rows_.column(c).take(pa.array(at)) for c in ("key", "weight", "vec")), pa.array(np.full(len(at), is_guest))], names)

    return written(rows.mapInArrow(moved, rows.schema), "cells"), first_cell


def _homes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cell").agg(F.count(F.when(~F.col("guest"), 1)).alias("n_home"), F.count(F.when(F.col("guest"), 1)).alias("n_guest"))


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows dealt so that home vectors of a cell meet each other once, and each meets every guest once."""
    sizes = _homes(rows).filter("n_home > 0")
    n = lambda c: F.greatest(F.ceil(F.col(c) / block), F.lit(1)).cast("int")
    base = rows.join(sizes, "cell")
    deal = lambda k: F.pmod(F.xxhash64("key"), k).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    home, guest = base.filter(~F.col("guest")), base.filter("guest")
    inner = graphs.block_pairs(home.filter("n_home > 1"), "n_home", "key", block).withColumn("visited", F.lit(False))
    hosts = home.filter("n_guest > 0").withColumn("own", deal(n("n_home"))).withColumn("first", F.col("own")).withColumn("second", each(n("n_guest"))).withColumn("visited", F.lit(True))
    guests = guest.withColumn("own", deal(n("n_guest"))).withColumn("second", F.col("own")).withColumn("first", each(n("n_home"))).withColumn("visited", F.lit(True))
    return inner.unionByName(hosts).unionByName(guests).drop("n_home", "n_guest")


def near_duplicates(vectors: DataFrame, settings: Settings = Settings(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    s, r = settings, float(np.sqrt(2 - 2 * settings.cosine))
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    every = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("vec"))
    finite = ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = every.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda v: v != 0))
    alike = usable.groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    alike = written(alike.withColumn("key", F.monotonically_increasing_id()), "vectors")
    rows = alike.select(F.size("vec").cast("long").alias("cell"), "key", "weight", "vec", F.lit(False).alias("guest"))
    first_cell = 1 << 32
    for _ in range(s.levels):
        big = {c.cell: c.n_home for c in _homes(rows).filter(F.col("n_home") >= 2 * s.per_pivot).orderBy(F.desc("n_home"), "cell").limit(s.pivots // 2).collect()}
        if not big:
            break
        rows, cells = _cut_cells(rows, big, first_cell, r, s)
        if cells == first_cell:
            break
        first_cell = cells
    found = _in_blocks(rows, s.block).groupBy("cell", "first", "second", "visited").applyInArrow(_join(s.cosine), "key long, n long, root long")
    found = written(found, "links")
    links = found.groupBy("key").agg(F.sum("n").alias("n"))
    parts = graphs.components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("key"), F.col("component_id").alias("top"))
    linked = alike.select("key", "id").join(parts, "key")
    least = linked.groupBy("top").agg(F.min("id").alias("component_id"))
    linked = linked.join(least, "top").select("key", "component_id")
    rep = alike.join(links, "key", "left").join(linked, "key", "left")
    rep = rep.select("vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    named = every.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).join(rep, "vec", "left")
    bare = every.filter(F.col("vec_id").isNull() | F.col("vec").isNull()).select("vec_id", "vec", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = named.unionByName(bare)
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
