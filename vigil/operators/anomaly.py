"""Outlying entities: a leave-one-out isolation forest per target, and rank intervals under uncertain scores."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _depths(train: np.ndarray, x: np.ndarray, rng: np.random.Generator, limit: int, whole: bool) -> np.ndarray:
    """Depth at which random cuts of the peers isolate each row of x, with the usual correction for what is left. whole draws
    the cuts of the whole tree, so that they do not depend on x; else only those on the way of x."""
    out, todo = np.zeros(len(x)), [(train, np.arange(len(x)), 0)]
    while todo:
        peers, inside, depth = todo.pop()
        if not (whole or len(inside)):
            continue
        low, high = (peers.min(axis=0), peers.max(axis=0)) if len(peers) else (0, 0)
        wide = np.flatnonzero(high > low)
        if depth == limit or not len(wide):  # one peer is never wide
            out[inside] = depth + _rest(len(peers))
            continue
        k = rng.choice(wide)
        cut = rng.uniform(low[k], high[k])
        left, below = peers[:, k] < cut, x[inside, k] < cut
        todo += [(peers[left], inside[below], depth + 1), (peers[~left], inside[~below], depth + 1)]
    return out


def _rest(n: int) -> float:
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(max(n - 1, 0))


def isolation(rows: DataFrame, features: list[str], trees: int = 100, sample: int = 256, seed: int = 42, block: int = 1024) -> DataFrame:
    """(cohort, entity_id, features) -> score of each target against its peers without itself, and confidence.

    A tree's peers are the rows of the cohort with the smallest hashes; for a target among them the next one moves up, which
    is a draw without repeats from the target's peers. So sample + 1 rows by cohort and tree serve all targets: no target
    meets its whole cohort, and targets outside a tree's rows share its cuts. Targets are scored in blocks, to each of which
    the cohort's drawn rows are sent. Fewer than two peers, no cohort or missing or non-finite features give score 0 with confidence 0.
    Of rows with the same id the smallest counts. Randomness depends on seed, cohort and target only, not on blocks.
    """
    fine = F.col("cohort").isNotNull() & F.col("entity_id").isNotNull()
    for f in features:
        fine = fine & F.col(f).isNotNull() & (F.abs(F.col(f).cast("double")) < float("inf"))
    once = rows.groupBy("entity_id").agg(F.min(F.struct("cohort", *features)).alias("_f")).select("entity_id", "_f.*").withColumn("_fine", fine)
    sizes = once.filter("_fine").groupBy("cohort").agg((F.count("*") - 1).alias("_peers"))
    once = once.join(sizes, "cohort", "left")
    scored = F.col("_fine") & (F.col("_peers") >= 2)
    x = F.array(*(F.col(f).cast("double") for f in features)).alias("x")
    targets = once.filter(scored).select("cohort", F.col("entity_id").cast("long").alias("entity_id"), x, "_peers")
    targets = targets.withColumn("block", F.pmod(F.xxhash64("entity_id"), F.ceil((F.col("_peers") + 1) / block)))
    draws = targets.select("cohort", "entity_id", "x", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    draws = draws.withColumn("_h", F.xxhash64(F.lit(seed), "tree", "entity_id"))
    first = Window.partitionBy("cohort", "tree").orderBy("_h", "entity_id")  # the limit is applied in each task before the shuffle
    drawn = draws.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= sample + 1).drop("_h")
    sent = drawn.join(targets.select("cohort", "block").distinct(), "cohort")
    sent = sent.select(*(F.col(c).alias(f"of_{c}") for c in ("cohort", "block")), "tree", "place", F.col("entity_id").alias("peer_id"), F.col("x").alias("peer"))

    def score(key: tuple, ours: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        ids, at = ours["entity_id"].to_numpy(), np.stack(ours["x"].to_numpy())
        name, total = zlib.crc32(str(key[0]).encode()), np.zeros(len(ids))
        n = int(min(sample, ours["_peers"].iloc[0]))
        limit = int(np.ceil(np.log2(n))) + 1
        for tree, part in drawn.sort_values(["tree", "place"]).groupby("tree"):
            peer_ids, peers = part["peer_id"].to_numpy(), np.stack(part["peer"].to_numpy())
            own = np.isin(ids, peer_ids)
            if not own.all():
                total[~own] += _depths(peers[:n], at[~own], np.random.default_rng([seed, name, tree]), limit, whole=True)
            for i in np.flatnonzero(own):
                others = peers[peer_ids != ids[i]][:n]
                total[i] += _depths(others, at[i : i + 1], np.random.default_rng([seed, name, tree, ids[i] & (2**63 - 1)]), limit, whole=False)[0]
        found = 2 ** (-total / trees / max(_rest(n), 1e-9))
        return pd.DataFrame({"entity_id": ids, "score": found.round(6), "confidence": np.minimum(1.0, ours["_peers"].to_numpy() / 10)})

    out = "entity_id long, score double, confidence double"
    known = targets.groupBy("cohort", "block").cogroup(sent.groupBy("of_cohort", "of_block")).applyInPandas(score, out)
    rest = once.filter(~F.coalesce(scored, F.lit(False))).select(F.col("entity_id").cast("long").alias("entity_id"), F.lit(0.0).alias("score"), F.lit(0.0).alias("confidence"))
    return known.unionByName(rest)


def rank_intervals(scores: DataFrame, draws: int = 400, spread: float = 0.15, seed: str = "r") -> DataFrame:
    """Fifth and ninety-fifth percentile of each entity's rank when scores vary, widened to hold the rank of its score;
    normals come from hashes."""
    n = scores.sparkSession.range(draws).select(F.col("id").alias("draw"))
    u = lambda k: (F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(f"{seed}{k}"), "entity_id", "draw"), 256), 1, 12), 16, 10).cast("double") + 1) / (16.0**12 + 1)
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * np.pi * u(2))
    drawn = scores.crossJoin(F.broadcast(n)).withColumn("drawn", F.col("score") * F.greatest(1 + spread * normal, F.lit(0.05)))
    ranked = drawn.withColumn("r", F.rank().over(Window.partitionBy("draw").orderBy(F.desc("drawn"))))
    spans = ranked.groupBy("entity_id").agg(F.expr("percentile_disc(0.05) within group (order by r)").cast("long").alias("low"), F.expr("percentile_disc(0.95) within group (order by r)").cast("long").alias("high"))
    above = scores.groupBy("score").agg(F.count("*").alias("k")).withColumn("point", 1 + F.coalesce(F.sum("k").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each score
    own = scores.join(above.select("score", "point"), "score").select("entity_id", "point")
    return spans.join(own, "entity_id", "left").select("entity_id", F.least("low", "point").alias("low"), F.greatest("high", "point").alias("high"))
