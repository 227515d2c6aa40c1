"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of their five-word shingles (a shorter text is one shingle). Documents with equal sets form a
class with one representative; only representatives are joined.

Candidates share a band of MinHash values: 32 bands of 4 values, so a pair at the threshold of 0.8 is missed with
probability (1 - 0.8**4)**32 < 1e-7. A pair belongs to the bucket of the first band that it shares; wherever else it
meets it goes as soon as an earlier band turns out equal. Within its bucket it compares its 128 values in steps. After
each step the posterior of the Jaccard similarity (uniform prior, the values seen so far) gives the probability of
reaching the threshold; a pair goes once that is below the tolerance. The step at which a count of equal values is too
low is tabled beforehand. Documents with a surviving pair take their sets to that pair's bucket, and there all pairs
whose values survive are verified exactly. So work follows the buckets, not the groups that candidates connect.
Buckets of any size are cut into blocks; tasks give counts and roots per document, never rows per pair.

Null and empty texts have no shingles and link with nothing. doc_id is a whole number (any other type is refused) and
names a document: of rows that repeat an id with other texts, one text stands for all (that of the smallest hash, so
the choice does not depend on partitioning); null ids link with nothing. Pairs exactly at the threshold are links.
Very long texts are held whole, a block of documents at a time. Empty tables give no rows, and other columns may have
any names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import graphs
from vigil.llm import words as wd
from vigil.llm.session import whole_ids, written


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 4
    #: Values compared at a time; a pair goes when reaching the threshold is less likely than the tolerance.
    step: int = 16
    tolerance: float = 1e-6
    block: int = 256

    @property
    def values(self) -> int:
        return self.bands * self.rows


_SPACE = wd.is_space()


def _shingles(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text and their text's index, by text."""
    data, at = wd.text_bytes(part.column("text"))
    seg = wd.segments(data, at, _SPACE)
    word = wd.span_hashes(data, seg.start, seg.end, wd.byte_codes())
    key, first = wd.window_hashes(word, seg.doc, k)
    doc = seg.doc[first]
    begin = seg.per_doc(len(at) - 1)
    for i in np.flatnonzero((np.diff(begin) > 0) & (np.diff(begin) < k)):  # short texts: all words as one
        whole = np.zeros(1, np.uint64)
        for w in range(begin[i], begin[i + 1]):
            whole = whole * wd._STEP + word[w : w + 1]
        key, doc = np.append(key, wd.mix(whole + np.uint64(begin[i + 1] - begin[i]))), np.append(doc, i)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], doc[new]


@lru_cache(maxsize=2)
def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _minhash(key: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The n MinHash values (upper 32 bits) of each set; sets are consecutive and begin at first."""
    flips, factors = _seeds(n)
    out = np.empty((len(first), n), np.uint32)
    for j in range(n):
        out[:, j] = np.minimum.reduceat((key ^ flips[j]) * factors[j], first) >> np.uint64(32)
    return out


@lru_cache(maxsize=4)
def least_matches(threshold: float, values: int, step: int, tolerance: float) -> np.ndarray:
    """For each number of values compared, the least count of equal ones with which a pair may go on.

    The posterior after m of n equal values is Beta(m + 1, n - m + 1); its tail above the threshold is the
    probability that a Binomial(n + 1, threshold) is at most m.
    """
    out = []
    for n in range(step, values + 1, step):
        log_term = np.zeros(n + 2)
        for m in range(1, n + 2):
            log_term[m] = log_term[m - 1] + np.log((n + 2 - m) / m)
        m = np.arange(n + 2)
        tail = np.cumsum(np.exp(log_term + m * np.log(threshold) + (n + 1 - m) * np.log(1 - threshold)))
        out.append(int(np.argmax(tail >= tolerance)))
    return np.array(out)


def _survivors(a: np.ndarray, b: np.ndarray, band: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the rows of a and b whose values are equal often enough at every step, and whose first equal
    band is this one."""
    least = least_matches(s.threshold, s.values, s.step, s.tolerance)
    left, right = np.arange(len(a)).repeat(len(b)), np.tile(np.arange(len(b)), len(a))
    same = np.zeros(len(left), np.int32)
    for k, bound in enumerate(least):
        cols = slice(k * s.step, (k + 1) * s.step)
        equal = a[left, cols] == b[right, cols]
        same += equal.sum(axis=1, dtype=np.int32)
        go = same >= bound
        earlier = min(max(band * s.rows - k * s.step, 0), s.step)
        if earlier:
            go &= ~equal[:, :earlier].reshape(len(equal), earlier // s.rows, s.rows).all(axis=2).any(axis=1)
        left, right, same = left[go], right[go], same[go]
    return left, right


def _signatures(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.stack([np.frombuffer(x, np.uint32) for x in column.to_pylist()]) if len(column) else np.zeros((0, 1), np.uint32)


def _in_blocks(group: pa.Table):
    """Row numbers of the two sides, and whether they are the same block."""
    own, first, second = np.asarray(group["own"]), group["first"][0].as_py(), group["second"][0].as_py()
    return np.flatnonzero(own == first), np.flatnonzero(own == second), first == second


def _bucket(s: Settings):
    """Documents of one pair of blocks of a bucket that have a candidate there."""

    def rows(group: pa.Table) -> pa.Table:
        ids, sig, band = np.asarray(group["id"]), _signatures(group["sig"]), group["band"][0].as_py()
        left, right, same = _in_blocks(group)
        some = np.zeros(len(ids), bool)
        for start in range(0, len(left), 64):
            rows_ = left[start : start + 64]
            i, j = _survivors(sig[rows_], sig[right], band, s)
            i, j = rows_[i], right[j]
            use = ids[i] < ids[j] if same else ids[i] != ids[j]
            some[i[use]] = some[j[use]] = True
        n = int(some.sum())
        return pa.table({"bucket": pa.array([group["bucket"][0].as_py()] * n, pa.int64()), "band": pa.array([band] * n, pa.int32()), "id": ids[some]})

    return rows


def _verify(s: Settings):
    """Exact links among one pair of blocks of a bucket: weights of links, and a root, per document."""

    def rows(group: pa.Table) -> pa.Table:
        ids, weight, sig = np.asarray(group["id"]), np.asarray(group["weight"]), _signatures(group["sig"])
        sets, band = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()], group["band"][0].as_py()
        size = np.array([len(x) for x in sets])
        left, right, same = _in_blocks(group)
        every, code = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(size)])
        link_i, link_j = [], []
        mark = np.zeros(len(every), bool)
        right_size = size[right]
        right_code = np.concatenate([code[begin[r] : begin[r + 1]] for r in right]) if len(right) else np.zeros(0, int)
        right_begin = np.concatenate([[0], np.cumsum(right_size)])
        for r in left:
            i, j = _survivors(sig[r : r + 1], sig[right], band, s)
            if not len(j):
                continue
            own = code[begin[r] : begin[r + 1]]
            mark[own] = True
            if len(j) * 4 > len(right):
                common = wd.sums_per_doc(mark[right_code], right_begin)[j]
            else:
                common = np.array([mark[right_code[right_begin[x] : right_begin[x + 1]]].sum() for x in j])
            mark[own] = False
            near = common >= s.threshold * (size[r] + right_size[j] - common) - 1e-9
            j = right[j[near]]
            j = j[ids[j] > ids[r]] if same else j[ids[j] != ids[r]]
            link_i.append(np.full(len(j), r))
            link_j.append(j)
        i, j = (np.concatenate(x) if x else np.zeros(0, int) for x in (link_i, link_j))
        n = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
        root, some = graphs.local_roots(ids, i, j), n > 0
        return pa.table({"id": ids[some], "n": n[some].astype(np.int64), "root": root[some]})

    return rows


def joined(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, copy_of (smallest id with an equal set), n_links (other documents
    at the threshold or above, copies included) and class_id (smallest id reachable by links)."""
    s = settings
    whole_ids(docs, doc_id)
    view = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter(F.col("doc_id").isNotNull())

    def signed(batches):
        for batch in batches:
            for part in wd.slices(batch, "text", 1 << 20):
                key, doc = _shingles(part, s.words)
                row, first = np.unique(doc, return_index=True)
                if not len(row):
                    continue
                one, two = np.add.reduceat(wd.mix(key), first), np.add.reduceat(wd.mix(key ^ wd._STEP), first)
                sig = _minhash(key, first, s.values)
                n = np.diff(np.append(first, len(key)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(n.astype(np.int32)), pa.array([x.tobytes() for x in sig], pa.binary())], ["id", "one", "two", "n", "sig"])

    sets = written(view.mapInArrow(signed, "id long, one long, two long, n int, sig binary").groupBy("id").agg(F.min(F.struct("one", "two", "n", "sig")).alias("s")).select("id", "s.*"), "sets")
    alike = ["one", "two", "n"]
    reps = written(sets.groupBy(*alike).agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("sig").alias("sig")), "representatives")

    def banded(batches):
        for batch in batches:
            sig = _signatures(batch.column("sig"))
            band = np.zeros((len(sig), s.bands), np.uint64)
            for j in range(s.rows):
                band = wd.mix(band * wd._STEP + sig[:, j :: s.rows].astype(np.uint64) + np.arange(s.bands, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("id")), s.bands)), pa.array(band.ravel().view(np.int64)), pa.array(np.tile(np.arange(s.bands, dtype=np.int32), len(sig)))], ["id", "bucket", "band"])

    bands = written(reps.select("id", "sig").mapInArrow(banded, "id long, bucket long, band int"), "bands")
    shared = bands.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = bands.join(shared, "bucket").join(reps.select("id", "sig"), "id")
    pairs = graphs.block_pairs(members, "size", "id", s.block)
    met = pairs.groupBy("bucket", "first", "second").applyInArrow(_bucket(s), "bucket long, band int, id long")
    taking = written(met.distinct(), "candidates")

    def with_sets(batches):
        for batch in batches:
            for part in wd.slices(batch, "text", 1 << 20):
                key, doc = _shingles(part, s.words)
                begin = np.searchsorted(doc, np.arange(part.num_rows + 1))
                one = np.array([wd.mix(key[begin[i] : begin[i + 1]]).sum(dtype=np.uint64) for i in range(part.num_rows)], np.uint64)
                made = pa.array([key[begin[i] : begin[i + 1]].tobytes() for i in range(part.num_rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(one.view(np.int64)), made], ["id", "one", "shingles"])

    chosen = view.withColumnRenamed("doc_id", "id").join(taking.select("id").distinct(), "id")
    held = chosen.mapInArrow(with_sets, "id long, one long, shingles binary").join(reps.select("id", "one", "weight", "sig"), ["id", "one"]).dropDuplicates(["id"]).drop("one")
    sizes = taking.groupBy("bucket").agg(F.count("*").alias("size"))
    held = taking.join(held, "id").join(sizes, "bucket")
    checked = graphs.block_pairs(held, "size", "id", s.block).groupBy("bucket", "first", "second").applyInArrow(_verify(s), "id long, n long, root long")
    links = written(checked, "links")
    parts = graphs.components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    n_links = links.groupBy("id").agg(F.sum("n").alias("n_linked"))
    found = reps.select(*alike, F.col("id").alias("copy_of"), "weight").join(n_links.withColumnRenamed("id", "copy_of"), "copy_of", "left").join(parts.withColumnRenamed("id", "copy_of"), "copy_of", "left")
    by_doc = sets.select(*alike, "id").join(found, alike).select(F.col("id").alias("_id"), "n", "copy_of", (F.coalesce("n_linked", F.lit(0)) + F.col("weight") - 1).alias("_n_links"), F.coalesce("component_id", "copy_of").alias("_class"))
    every = docs.select(F.col(doc_id).alias("doc_id"))
    out = every.join(by_doc, F.col("doc_id") == F.col("_id"), "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("_n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_class", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents whose class has a smaller id; all columns stay. Rows with a null id stay."""
    gone = joined(docs, settings, doc_id, text).filter("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(written(gone, "gone"), docs[doc_id] == F.col("_gone"), "left_anti")
