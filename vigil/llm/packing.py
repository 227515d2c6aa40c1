"""Mixture-controlled packing of token streams into sequences of one length.

Each source is a queue of documents. A round-robin with deficits serves the queues: in every window each queue
earns its share of the window's tokens, gives whole tokens, and carries the rest (its deficit) on. What a queue
has given by the end of window w is then the whole part of share * w * window, so windows need not be played one
after the other: a document's place follows from its place in its queue, on any partition. When a queue runs
dry, the shares of the others grow from the next window on. Documents are cut where a window's share or a
sequence ends. Only the last sequence has padding.

Null and empty texts are the end token alone. Null sources count as the empty name. Repeated rows and ids are packed each, null ids too; among
equal rows the order is that of their files. Very long texts are cut over as many sequences as they need; their tokens are
held by one task. Empty tables give no rows; other columns may have any names and are dropped.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm import words as wd
from vigil.llm.session import written

#: A join side of at most so many rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 100_000
#: Sources with a queue of their own at the top; each of the groups that share the last queue holds some so many.
TOP, IN_GROUP = 255, 64


@dataclass
class Schedule:
    """When which token of a queue is due. epochs: first window, tokens given so far, weights; integers only."""

    totals: list[int]
    weights: list[int]
    window: int
    epochs: list[tuple[int, list[int], list[int]]] = field(default_factory=list)
    ends: dict[int, tuple[list[int], int]] = field(default_factory=dict)

    def __post_init__(self):
        given, first = [0] * len(self.totals), 0
        while any(g < t for g, t in zip(given, self.totals)):
            weights = [w if g < t else 0 for w, g, t in zip(self.weights, given, self.totals)]
            if not sum(weights):  # only queues of weight 0 are left: they follow in equal shares
                weights = [int(g < t) for g, t in zip(given, self.totals)]
            self.epochs.append((first, given, weights))
            whole = sum(weights)
            dry = min(-(-(t - g) * whole // (w * self.window)) for w, g, t in zip(weights, given, self.totals) if w)
            first += max(1, dry)
            given = self.given(first)

    def given(self, w: int) -> list[int]:
        """Tokens that each queue has given before window w."""
        first, base, weights = self.epochs[bisect_right(self.epochs, w, key=lambda e: e[0]) - 1]
        whole = sum(weights)
        return [min(t, b + a * (w - first) * self.window // whole) for t, b, a in zip(self.totals, base, weights)]

    def _at(self, w: int) -> tuple[list[int], int]:
        if (known := self.ends.get(w)) is None:
            if len(self.ends) * len(self.totals) > 4_000_000:
                self.ends.clear()
            given = self.given(w)
            known = self.ends[w] = (given, sum(given))
        return known

    def spans(self, queue: int, start: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(offset in the document, length, place in the whole stream) of each stretch of a document that has
        length tokens from place start of its queue on."""
        stop, x, w = start + length, start, 0
        step = 1
        while self._at(step)[0][queue] <= x:  # the window of x: double, then halve
            w, step = step, step * 2
        low, high = w, step
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self._at(mid)[0][queue] <= x else (low, mid)
        w = low
        while x < stop:
            (now, before), (then, _) = self._at(w), self._at(w + 1)
            end = min(stop, then[queue])
            if end > x:
                place = before + sum(b - a for a, b in zip(now[:queue], then[:queue])) + x - now[queue]
                yield x - start, end - x, place
                x = end
            w += 1


def tokenised(docs: DataFrame, encode: Callable[[], Callable[[str], np.ndarray]], doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The ids of each document once, as little-endian 32-bit or 16-bit numbers, with its place in its source's
    queue within the partition. Written and read again, so that places never change afterwards."""

    def rows(batches):
        to_ids, part, seen = encode(), TaskContext.get().partitionId(), {}
        for batch in batches:
            for piece in wd.slices(batch, "text"):
                out = {"source": [], "before": [], "n": [], "wide": [], "ids": []}
                for name, t in zip(piece.column("source").to_pylist(), piece.column("text").to_pylist()):
                    ids, name = to_ids(t or ""), name or ""
                    wide = bool(len(ids)) and int(ids.max()) > 65535
                    before = seen.get(name, 0)
                    seen[name] = before + len(ids)
                    for k, v in zip(out, (name, before, len(ids), wide, ids.astype("<u4" if wide else "<u2").tobytes())):
                        out[k].append(v)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([part] * piece.num_rows, pa.int64()), *map(pa.array, out.values(), kinds)], ["doc_id", "part", *out])

    kind = docs.schema[doc_id].dataType.simpleString()
    view = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    return written(view.mapInArrow(rows, f"doc_id {kind}, part long, source string, before long, n long, wide boolean, ids binary"), "packing-tokens")


def packed(tokens: DataFrame, weights: dict[str, int] | None = None, length: int = 2048, window_sequences: int = 64, temper: float | None = None, top: int = TOP, in_group: int = IN_GROUP) -> DataFrame:
    """Pieces of the documents of tokenised().

    weights: target tokens of each source in proportion (others get none until these have run dry); without them the
    sources' sizes, or, with temper, their sizes to that power. The top largest sources (those with weights first)
    have queues of their own. All others share one queue more, which is filled by the same round-robin over groups of
    sources, and each group by the same over its sources; a queue's weight is the sum of its sources' weights. So there
    is no limit on the number of sources. The driver holds a number for each queue of the two upper levels.

    Null sources count as the empty name; repeated rows are documents of their own; an empty table gives no pieces.
    """
    window = length * window_sequences
    sums = written(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "packing-sums")
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n"))
    if weights is None:
        own = F.col("n") if temper is None else F.greatest(F.lit(1), F.round(1000 * F.pow(F.col("n"), F.lit(temper)))).cast("long")
    else:
        own = F.coalesce(F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(int(v)))))[F.col("source")], F.lit(0)) if weights else F.lit(0)
    named = F.col("source").isin(list(weights or {}))
    by_source = by_source.withColumn("weight", own.cast("long"))
    largest = by_source.orderBy(named.desc(), F.desc("n"), "source").limit(top).collect()
    queues = {r.source: i for i, r in enumerate(largest)}
    rest = by_source.filter(~F.col("source").isin(list(queues))) if queues else by_source
    n_groups = max(1, -(-rest.count() // in_group))
    rest = rest.withColumn("group", F.pmod(F.xxhash64("source"), F.lit(n_groups)).cast("int"))
    shared = {r.group: r for r in rest.groupBy("group").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).collect()}
    groups = [shared[g] for g in sorted(shared)]
    upper = Schedule([r.n for r in largest] + [sum(r.n for r in groups)], [r.weight for r in largest] + [sum(r.weight for r in groups)], window)
    middle = Schedule([r.n for r in groups], [r.weight for r in groups], window)
    place_of_group = {g: i for i, g in enumerate(sorted(shared))}
    leaf = Window.partitionBy("group")
    listed = lambda c: F.array_sort(F.collect_list(F.struct("source", c)).over(leaf))[c].alias(f"{c}s")
    within = rest.select("source", "group", (F.row_number().over(leaf.orderBy("source")) - 1).alias("at"), listed("n"), listed("weight"))
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    number = F.create_map(*(x for name, i in queues.items() for x in (F.lit(name), F.lit(i)))) if queues else F.create_map(F.lit(""), F.lit(None).cast("int"))
    bases = sums.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n").withColumn("queue", number[F.col("source")]).join(within, "source", "left")
    if sums.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)

    def rows(batches):
        leaves: dict[int, Schedule] = {}

        def places(queue, group, at, ns, ws, start, n):
            """(offset in the document, length, place in the whole stream), through the levels."""
            if queue is not None:
                yield from upper.spans(queue, start, n)
                return
            if group not in leaves:
                if len(leaves) > 64:
                    leaves.clear()
                leaves[group] = Schedule(ns, ws, window)
            for a, m, x in leaves[group].spans(at, start, n):
                for b, k, y in middle.spans(place_of_group[group], x, m):
                    for c, j, z in upper.spans(len(upper.totals) - 1, y, k):
                        yield a + b + c, j, z

        for batch in batches:
            out = []
            names = ("doc_id", "base", "before", "n", "queue", "group", "at", "ns", "weights", "wide", "ids")
            for doc, base, before, n, queue, group, at, ns, ws, wide, ids in zip(*(batch.column(c).to_pylist() for c in names)):
                raw = np.frombuffer(ids, "<u4" if wide else "<u2").astype("<u4")
                for start, size, place in places(queue, group, at, ns, ws, base + before, n):
                    while size:
                        used = min(size, length - place % length)
                        out.append((doc, start, used, zlib.crc32(raw[start : start + used].tobytes()), n, place // length, place % length))
                        start, size, place = start + used, size - used, place + used
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 7, [batch.schema.field("doc_id").type, *[pa.int64()] * 6])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.join(bases, ["part", "source"]).mapInArrow(rows, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
