"""Regime shifts of series, differences between two policies, and clusters of templated notes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from statistics import median

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators import shingles
from vigil.operators.sequences import Ordered


def segments(series: DataFrame, least: int = 3, shift: float = 0.10, gain: float = 0.20) -> DataFrame:
    """(series, period, value) -> splits into regimes: both sides hold so many periods, their medians differ by shift, and
    the squared error falls by the share gain; the best split first, then both sides again. Series are short and
    independent: each is one group."""

    def error(x: list[float]) -> float:
        mean = sum(x) / len(x)
        return sum((v - mean) ** 2 for v in x)

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["value"]).sort_values("period")
        value, period, out, todo = pdf["value"].tolist(), pdf["period"].tolist(), [], [(0, len(pdf))]
        while todo:
            low, high = todo.pop()
            whole = error(value[low:high]) if high - low >= 2 * least else 0.0
            best = None
            for mid in range(low + least, high - least + 1) if whole > 0 else ():
                a, b = value[low:mid], value[mid:high]
                better = (whole - error(a) - error(b)) / whole
                if abs(median(b) - median(a)) >= shift and better >= gain and (best is None or better > best[0] + 1e-12):
                    best = (better, mid, median(a), median(b))
            if best:
                out.append((pdf["series"].iloc[0], period[best[1]], "up" if best[3] > best[2] else "down", round(best[2], 6), round(best[3], 6), best[1] - low, high - best[1]))
                todo += [(low, best[1]), (best[1], high)]
        return pd.DataFrame(out, columns=["series", "period", "direction", "before", "after", "n_before", "n_after"])

    return series.groupBy("series").applyInPandas(split, "series string, period int, direction string, before double, after double, n_before int, n_after int")


def finding_changes(old: DataFrame, new: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(entity_id, indicator, effect, confidence) under two policies: added, removed, changed or same, and whether a change
    makes the finding worse: more effect, or the same with more confidence."""
    o = old.select("entity_id", "indicator", F.col("effect").alias("effect_before"), F.col("confidence").alias("confidence_before"))
    n = new.select("entity_id", "indicator", F.col("effect").alias("effect_after"), F.col("confidence").alias("confidence_after"))
    up, more = F.col("effect_after") - F.col("effect_before"), F.col("confidence_after") - F.col("confidence_before")
    change = F.when(F.col("effect_before").isNull(), "added").when(F.col("effect_after").isNull(), "removed").when((F.abs(up) > tolerance) | (F.abs(more) > tolerance), "changed").otherwise("same")
    worse = (change == "changed") & ((up > tolerance) | ((F.abs(up) <= tolerance) & (more > tolerance)))
    return o.join(n, ["entity_id", "indicator"], "full_outer").withColumn("change", change).withColumn("worse", worse)


def recommendation(changes: DataFrame) -> DataFrame:
    """promote, or hold where any finding is added or made worse; with the worst of them."""
    n = lambda c: F.count(F.when(c, 1))
    added, worse = F.col("change") == "added", F.col("worse")
    key = F.concat_ws("/", "entity_id", "indicator")
    first = F.max_by(F.when(added, key), F.when(added, F.struct("effect_after", key)))
    second = F.max_by(F.when(worse, key), F.when(worse, F.struct((F.col("effect_after") - F.col("effect_before")).alias("d"), key)))
    out = changes.agg(n(added).alias("n_added"), n(F.col("change") == "removed").alias("n_removed"), n(F.col("change") == "changed").alias("n_changed"), n(worse).alias("n_worse"), first.alias("_a"), second.alias("_w"))
    return out.select("n_added", "n_removed", "n_changed", "n_worse", F.when((F.col("n_added") > 0) | (F.col("n_worse") > 0), "hold").otherwise("promote").alias("verdict"), F.coalesce("_a", "_w").alias("worst"))


def minhash_bands(notes: DataFrame, entity: str, note: str, text: str, n: int = 3, seeds: int = 32, per_band: int = 4, held: int = 100_000) -> DataFrame:
    """(entity, note, band, signature): MinHash of the n-word shingles by the smallest SHA-256 under each seed. Notes without a
    shingle have no bands.

    Equal texts go to one task and are hashed once, and so is a shingle that many notes share, as long as a task remembers it:
    two generations of at most held shingles, of which the frequent ones move on. The least of a note's hashes is
    taken over all its shingles at once.
    """
    word = re.compile("[a-z0-9]+")
    prefixes = [b"%d:" % k for k in range(seeds)]

    def hashes(shingle: bytes) -> bytes:
        return b"".join([hashlib.sha256(p + shingle).digest()[:8] for p in prefixes])

    def rows(batches):
        new: dict[bytes, bytes] = {}
        old: dict[bytes, bytes] = {}
        last, bands = None, None
        for batch in batches:
            out = {"entity": [], "note": [], "band": [], "signature": []}
            for e, i, t in zip(*(batch.column(c).to_pylist() for c in ("entity", "note", "text"))):
                if t is None:
                    continue
                if t != last:
                    w = word.findall(t.lower())
                    rows = []
                    for s in {" ".join(w[j : j + n]).encode() for j in range(len(w) - n + 1)}:
                        h = new.get(s)
                        if h is None:
                            h = new[s] = old.pop(s, None) or hashes(s)
                            if len(new) >= held:
                                new, old = {}, new
                        rows.append(h)
                    least = np.frombuffer(b"".join(rows), ">u8").reshape(-1, seeds).min(axis=0) if rows else []
                    parts = [f"{int(x):016x}" for x in least]
                    last, bands = t, ["|".join(parts[b : b + per_band]) for b in range(0, len(parts), per_band)]
                for b, signature in enumerate(bands):
                    for c, v in zip(out, (e, i, b, signature)):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["entity"], pa.string()), pa.array(out["note"], pa.int64()), pa.array(out["band"], pa.int32()), pa.array(out["signature"], pa.string())], list(out))

    view = notes.select(F.col(entity).cast("string").alias("entity"), F.col(note).cast("long").alias("note"), F.col(text).alias("text"))
    tasks = max(notes.sparkSession.sparkContext.defaultParallelism, int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    together = view.repartition(tasks, F.xxhash64("text")).sortWithinPartitions(F.xxhash64("text"), "text")
    return together.mapInArrow(rows, "entity string, note long, band int, signature string")


def shared_bands(notes: DataFrame, entity: str, note: str, text: str, n: int = 3, seeds: int = 32, per_band: int = 4, held: int = 100_000, tasks: int | None = None, kept: Callable | None = None) -> DataFrame:
    """The rows of minhash_bands, but of those whose bucket holds one note it need not give any.

    Notes of one bucket agree in their smallest shingles, so another note of the entity holds these too. Each shingle that several
    notes of an entity hold is hashed once for all of them. A note's other shingles are hashed only in bands where its smallest
    hashes are those of another note of the entity, until one is smaller, which ends the band. Nothing is left out. Notes lie in
    tasks blocks, or more; kept, where given, writes a table between steps and reads it again; held is no longer used.
    """
    view = notes.select(F.col(entity).cast("string").alias("entity"), F.col(note).cast("long").alias("note"), F.col(text).alias("text"))
    spark = notes.sparkSession
    most = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), tasks or 1)
    return shingles.shared_bands(view, n, seeds, per_band, most, kept)


def near_anchor(bands: DataFrame, notes: DataFrame, entity: str, note: str, text: str, least: float = 0.82, kept: Callable | None = None) -> DataFrame:
    """(entity, anchor, note, cosine): the notes of each bucket whose term-weighted cosine to the bucket's first note
    reaches least. Weights are fitted in each bucket: tf * (ln((1 + n) / (1 + df)) + 1). Cosines are to the anchor only,
    so a bucket costs in proportion to its size; equal buckets of several bands are taken once."""
    keys = ["entity", "band", "signature"]
    buckets = bands.groupBy(*keys).agg(F.min("note").alias("anchor"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("note")).alias("mark")).filter("n > 1")
    once = buckets.groupBy("entity", "anchor", "n", "mark").agg(F.min(F.struct("band", "signature")).alias("b")).select("entity", "anchor", "n", F.col("b.band").alias("band"), F.col("b.signature").alias("signature"))
    members = bands.join(once, keys).select("entity", "anchor", "n", "band", "note")
    texts = notes.select(F.col(entity).cast("string").alias("entity"), F.col(note).cast("long").alias("note"), F.col(text).alias("text"))
    texts = shingles.those_of(texts, members, ["entity", "note"], kept)  # few notes share a bucket: the terms of the others are not taken up
    terms = texts.select("entity", "note", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{2,}"), F.lit(0))).alias("term"))
    tf = terms.groupBy("entity", "note", "term").agg(F.count("*").alias("tf"))
    bucket = ["entity", "anchor", "band"]
    of_anchor = lambda c: F.max(F.when(F.col("note") == F.col("anchor"), F.col(c)))
    by_term = Window.partitionBy(*bucket, "term")
    here = members.join(tf, ["entity", "note"]).withColumn("df", F.count("*").over(by_term))
    weighted = here.withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).withColumn("w0", of_anchor("w").over(by_term))
    both = weighted.groupBy(*bucket, "note").agg(F.sum(F.col("w") * F.col("w0")).alias("dot"), F.sum(F.col("w") * F.col("w")).alias("q"))
    both = both.withColumn("q0", of_anchor("q").over(Window.partitionBy(*bucket)))
    cosine = F.round(F.col("dot") / F.sqrt(F.col("q") * F.col("q0")), 6)
    return both.withColumn("cosine", cosine).filter(F.col("cosine") >= least).groupBy("entity", "anchor", "note").agg(F.max("cosine").alias("cosine"))


def clusters(near: DataFrame, notes: DataFrame, share: float = 0.5) -> DataFrame:
    """Clusters of templated notes that make up a share of their entity's notes. Each note goes to its smallest anchor.
    notes: (entity, note, severe, analyst, template); a cluster whose notes all carry a declared template is no finding."""
    own = near.groupBy("entity", "note").agg(F.min("anchor").alias("anchor"))
    totals = notes.groupBy("entity").agg(F.count("*").alias("total"))
    rows = own.join(notes, ["entity", "note"]).groupBy("entity", "anchor").agg(F.count("*").alias("n"), F.avg(F.col("severe").cast("int")).alias("severe_share"), F.min(F.col("template").cast("int")).alias("t"), F.countDistinct("analyst").alias("n_analysts"), F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list("note")).cast("array<string>"), "|"), 256), 1, 12).alias("cluster_id"))
    out = rows.filter("n > 1 and t = 0").join(totals, "entity").withColumn("share", F.col("n") / F.col("total")).filter(F.col("share") >= share)
    return out.select("entity", "cluster_id", "n", F.round("share", 6).alias("share"), F.round("severe_share", 6).alias("severe_share"), "n_analysts")


def normal_p(z: str):
    """Two-sided p of a standard normal, vectorised; for display only."""
    from math import erfc, sqrt

    @F.pandas_udf("double")
    def p(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or np.isnan(v) else erfc(abs(v) / sqrt(2)))

    return p(F.col(z))


def ranked_at(scores: DataFrame, k: int) -> DataFrame:
    """(entity, score, hit) -> precision, recall, F1 at k and normalised gain. Ranks come from range partitions, so no task holds
    all rows, however the scores lie."""
    r = Ordered(scores, [], [F.desc("score"), "entity"]).numbered("i")
    positives = scores.agg(F.sum("hit").alias("p"))
    r = r.crossJoin(F.broadcast(positives))  # one row
    discount = 1 / F.log2(F.col("i") + 1)
    total = r.agg(F.sum(F.when(F.col("i") <= k, F.col("hit"))).alias("h"), F.first("p").alias("p"), F.sum(F.col("hit") * discount).alias("g"), F.sum(F.when(F.col("i") <= F.col("p"), discount)).alias("best"))
    precision, recall = F.col("h") / k, F.col("h") / F.col("p")
    return total.select(F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(2 * precision * recall / (precision + recall), 6).alias("f1"), F.round(F.when(F.col("p") > 0, F.col("g") / F.col("best")), 5).alias("ndcg"))
