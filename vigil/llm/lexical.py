"""Ranked lexical search over document FP-trees.

All documents are scored for every item of a query table. Documents are reduced to the items' terms: a vector of term
counts. The vectors of a slice of a task, their terms ordered from the most to the least frequent, are put into a
prefix tree, where documents share the path of the terms they have in common (unary stretches are one edge). Every
node knows, for its subtree, the largest count of each term and the smallest length norm m; a score grows with the
counts and falls with m, so both give a bound. For each item the tree is searched depth first, best bound first, and a
subtree is left out when its bound is below the item's tenth best score so far, which a task carries from tree to tree.
Each task then sends at most ten rows an item, and these are ranked together.

The bound on memory: an item block holds at most block_bytes of query text (more items make more blocks, each against
all documents), and a tree at most cells of its table of maxima, or one document.

Null texts have no terms; texts without terms are never found and do not count in N. Rows that repeat a doc_id are
ranked as documents of their own, and equal rows are interchangeable; a null id comes after all others on ties. Rows
that repeat an item_id are one item with the terms of all of them. Very long texts are read whole, one at a time. Empty
tables give no rows; other columns may have any names.
"""

from __future__ import annotations

import math
import re
from bisect import insort
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.llm import words as wd
from vigil.llm.session import written

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER_TEXT = {c: c + 32 for c in range(65, 91)}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass(frozen=True)
class Settings:
    best: int = 10
    block_bytes: int = 4 << 20
    cells: int = 6_000_000
    docs_in_tree: int = 4096


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(_LOWER_TEXT))


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Length, first 8 and last 8 bytes of each span: for spans of up to 16 bytes, all there is to compare."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[8:-8] = data
    eight = np.ndarray(len(data) + 9, "<u8", padded, 0, (1,))
    size = end - start
    short = np.minimum(size, 8).astype(np.uint64)
    mask = np.where(short < 8, (np.uint64(1) << (short * np.uint64(8) % np.uint64(64))) - np.uint64(1), np.uint64(2**64 - 1))
    return np.stack([size.astype(np.uint64), eight[start + 8] & mask, np.where(size >= 8, eight[end], 0)])


class Terms:
    """The terms of a block of items, found in texts by hash and then by their bytes."""

    def __init__(self, names: list[str]):
        raw = [n.encode() for n in names]
        data = np.frombuffer(b"\0".join(raw), np.uint8)
        end = np.cumsum([len(r) + 1 for r in raw]) - 1
        start = end - np.array([len(r) for r in raw])
        for self.seed in range(1, 99):
            key = wd.span_hashes(data, start, end, wd.byte_codes(False, self.seed))
            if len(np.unique(key)) == len(key):
                break
        self.order = np.argsort(key)
        self.key, self.span = key[self.order], _spans(data, start, end)[:, self.order]

    def found(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which spans are terms, and which term each is."""
        key = wd.span_hashes(data, start, end, wd.byte_codes(False, self.seed))
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = np.flatnonzero(self.key[at] == key)
        same = (_spans(data, start[hit], end[hit]) == self.span[:, at[hit]]).all(axis=0)
        return hit[same], self.order[at[hit[same]]]


def vectors(docs: DataFrame, terms: Terms, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (terms of the text with repeats), and the items' terms in it with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    kind = docs.schema[doc_id].dataType.simpleString()

    def rows(batches):
        terms = sent.value
        for batch in batches:
            for part in wd.slices(batch, "text", 1 << 22):
                data, at = wd.text_bytes(part.column("text"))
                data = _LOWER[data]
                seg = wd.segments(data, at, _APART)
                hit, term = terms.found(data, seg.start, seg.end)
                pair, tf = np.unique(seg.doc[hit] * len(terms.key) + term, return_counts=True)
                offsets = np.searchsorted(pair, np.arange(part.num_rows + 1) * len(terms.key)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pair % len(terms.key), tf)]
                n = np.diff(seg.per_doc(part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "term", "tf"])

    view = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return view.mapInArrow(rows, f"doc_id {kind}, n long, term array<int>, tf array<int>")


class Tree:
    """A prefix tree of documents, given as (id, m, term ranks ascending, counts). Row 0 of the tables is the root; each
    row is a document or a node with the rows below it."""

    def __init__(self, docs: list[tuple]):
        docs = sorted(docs, key=lambda d: d[2].tolist())
        self.ids = [d[0] for d in docs]
        self.columns, place = np.unique(np.concatenate([d[2] for d in docs]), return_inverse=True)
        shared = np.array([self._shared(a[2], b[2]) for a, b in zip(docs, docs[1:])], np.int64)
        self.below: list[np.ndarray | None] = []
        self.doc: list[int] = []
        self._branch(shared, len(docs))
        self.most = np.zeros((len(self.below), len(self.columns)), np.uint32)
        self.least = np.full(len(self.below), np.iinfo(np.int64).max)
        row = np.empty(len(docs), np.int64)
        row[[d for d in self.doc if d >= 0]] = [r for r, d in enumerate(self.doc) if d >= 0]
        sizes = [len(d[2]) for d in docs]
        self.most[np.repeat(row, sizes), place] = np.concatenate([d[3] for d in docs])
        self.least[row] = [d[1] for d in docs]
        for r in range(len(self.below) - 1, -1, -1):  # rows below come later, so they are ready
            if self.below[r] is not None:
                self.most[r] = self.most[self.below[r]].max(axis=0)
                self.least[r] = self.least[self.below[r]].min()

    @staticmethod
    def _shared(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        apart = np.flatnonzero(a[:n] != b[:n])
        return int(apart[0]) if len(apart) else n

    def _branch(self, shared: np.ndarray, n: int) -> None:
        """Splits ranges of sorted documents where they share least; equal documents hang under one node."""
        todo = [(0, n, None, 0)]
        while todo:
            low, high, parent, slot = todo.pop()
            row = len(self.below)
            if parent is not None:
                self.below[parent][slot] = row
            leaf = high - low == 1 and parent is not None
            self.doc.append(low if leaf else -1)
            self.below.append(None)
            if leaf:
                continue
            inner = shared[low : high - 1]
            cuts = low + 1 + np.flatnonzero(inner == inner.min()) if len(inner) else np.zeros(0, np.int64)
            ends = [low, *cuts.tolist(), high]
            self.below[row] = np.zeros(len(ends) - 1, np.int64)
            todo += [(a, b, row, i) for i, (a, b) in enumerate(zip(ends, ends[1:]))]

    def search(self, ranks: np.ndarray, weights: np.ndarray, best: list, k: int) -> None:
        """Puts what belongs to the k best of an item, as (-score, id is null, id), into best."""
        at = np.minimum(np.searchsorted(self.columns, ranks), len(self.columns) - 1)
        here = self.columns[at] == ranks
        columns, weights = at[here], weights[here]
        todo = [(None, 0)] if len(columns) else []
        while todo:
            bound, row = todo.pop()
            if len(best) == k and bound is not None and bound < -best[-1][0]:
                continue
            rows = self.below[row]
            tf = self.most[rows[:, None], columns].astype(np.int64)
            scores = ((1_000_000_000 * tf) // (1000 * tf + 8 * self.least[rows][:, None])) @ weights
            floor = -best[-1][0] if len(best) == k else 1
            keep = np.flatnonzero(scores >= max(floor, 1))
            for i in keep[np.argsort(scores[keep], kind="stable")].tolist():
                doc = self.doc[rows[i]]
                if doc < 0:
                    todo.append((int(scores[i]), int(rows[i])))
                    continue
                own = self.ids[doc]
                insort(best, (-int(scores[i]), own is None, own))
                del best[k:]


def ranked(
    docs: DataFrame,
    items: DataFrame,
    settings: Settings = Settings(),
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id and score of each item's best documents."""
    s = settings
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / s.block_bytes))
    kinds = docs.schema[doc_id].dataType.simpleString(), asked.schema["item_id"].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"item_id {kinds[1]}, rank int, doc_id {kinds[0]}, score long")
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        wanted: dict = {}
        for row in part.collect():  # a block's items, bounded above
            wanted.setdefault(row.item_id, Counter()).update(terms_of(row.text))
        wanted = {i: c for i, c in wanted.items() if c}
        if wanted:
            out = out.unionByName(_ranked_block(docs, wanted, kinds, s, doc_id, text))
    return out


def _ranked_block(docs: DataFrame, wanted: dict, kinds: tuple[str, str], s: Settings, doc_id: str, text: str) -> DataFrame:
    names = sorted({t for c in wanted.values() for t in c})
    number = {t: i for i, t in enumerate(names)}
    found = written(vectors(docs, Terms(names), doc_id, text), "vectors")
    n_docs, n_terms = found.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(names), np.int64)
    for row in found.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # at most a block's terms
        holding[row.term] = row["count"]
    order = np.lexsort((np.arange(len(names)), -holding))
    rank = np.empty(len(names), np.int32)
    rank[order] = np.arange(len(names))
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in holding]
    queries = []
    for item, counts in wanted.items():
        mine = sorted((int(rank[number[t]]), weight[number[t]] * n) for t, n in counts.items())
        queries.append((item, np.array([r for r, _ in mine]), np.array([w for _, w in mine], np.int64)))
    sent = docs.sparkSession.sparkContext.broadcast((rank, queries))
    m = F.expr(f"25 + (75 * cast(n as decimal(19,0)) * cast({n_docs} as decimal(18,0))) div {max(n_terms, 1)}")
    view = found.filter("size(term) > 0").select("doc_id", m.cast("long").alias("m"), "term", "tf")

    def trees(batches, rank):
        held, cells = [], 0
        for batch in batches:
            lists = batch.column("term")
            offsets = np.asarray(lists.offsets)
            term, tf = rank[np.asarray(lists.values)], np.asarray(batch.column("tf").values)
            for i, (own, m) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("m").to_pylist())):
                a, b = offsets[i], offsets[i + 1]
                by = np.argsort(term[a:b])
                cells += b - a
                held.append((own, m, term[a:b][by], tf[a:b][by]))
                if len(held) >= s.docs_in_tree or 2 * len(held) * min(cells, len(rank)) > s.cells:
                    yield Tree(held)
                    held, cells = [], 0
        if held:
            yield Tree(held)

    def rows(batches):
        rank, queries = sent.value
        best: list[list] = [[] for _ in queries]
        for tree in trees(batches, rank):
            for (_, ranks, weights), mine in zip(queries, best):
                tree.search(ranks, weights, mine, s.best)
        flat = [(q[0], own, -score) for q, mine in zip(queries, best) for score, _, own in mine]
        columns = list(zip(*flat)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, arrow)], ["item_id", "doc_id", "score"])

    schema = f"item_id {kinds[1]}, doc_id {kinds[0]}, score long"
    empty = docs.sparkSession.createDataFrame([], schema).toArrow().schema
    arrow = [f.type for f in empty]
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    top = view.mapInArrow(rows, schema).withColumn("rank", place).filter(F.col("rank") <= s.best)
    return top.select("item_id", "rank", "doc_id", "score")
