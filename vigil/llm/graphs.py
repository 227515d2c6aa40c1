"""Pairwise work in blocks, and connected components: shared by the similarity joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.session import written


def block_pairs(df: DataFrame, size: str, by: str, block: int) -> DataFrame:
    """Rows dealt so that any two rows of a group meet in exactly one (first, second) pair of blocks.

    A group of up to block rows is one block; a larger one has several, and each row goes once to every pair that
    its block is in. So no task holds more than about two blocks, however large the group.
    """
    n = F.ceil(F.col(size) / block).cast("int")
    out = df.withColumn("own", F.pmod(F.xxhash64(by), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other")).drop("other")


def local_roots(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each row, the smallest id that the pairs (left, right) of row numbers lead to."""
    rank = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[rank] = np.arange(len(ids))
    parent = np.arange(len(ids))
    a, b = place[left], place[right]
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return ids[rank[parent]][place]
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id): the smallest id that each end of the edges (a, b) reaches.

    In each round every node moves to the neighbour, or itself, whose hash is smallest, and edges move along; the
    random order of hashes shrinks any graph, long chains too, by a constant factor. Tables are written between
    rounds. Only the number of edges left reaches the driver.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    links = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    moved = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a")).toDF("a", "b")
        step = both.groupBy("a").agg(F.least(F.min(order("b")), F.first(order("a")))["id"].alias("to"))
        step = written(step, "moves")
        if moved is None:
            moved = step.select(F.col("a").alias("id"), F.col("to"))
        else:
            later = step.select(F.col("a").alias("to"), F.col("to").alias("next"))
            moved = moved.join(later, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
        moved = written(moved, "moved")
        a, b = (step.select(F.col("a").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        links = written(links.join(a, "a").join(b, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).filter("a <> b").distinct(), "edges")
    if moved is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    least = moved.groupBy("to").agg(F.least(F.min("id"), F.first("to")).alias("component_id"))
    return moved.join(least, "to").select("id", "component_id")
