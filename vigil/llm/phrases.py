"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are runs of words, edges are grams of one word more; an edge's weight is how often it occurs. Only the longest
grams are aggregated: every word of a piece starts one gram of up to five words, shorter where the piece ends. What
flows out of a node gives the shorter counts: a phrase occurs as often as the grams that begin with it, which are the
longer edges out of it and the grams that a piece's end cut at it. Unary paths are compacted: a node whose whole flow
passes through one edge, ahead or behind, is no phrase of its own, the longer one stands for it.

Before that, pairs of words are counted by slots of a table (some pairs share one): where a slot's total stays below
the least count, no frequent phrase spans that pair and the gram ends there as at a piece's end. So rare edges are
never sent. Slots grow with the text up to most_slots and only save work: when they are full, or shared, more grams are
sent and the counts stay the same. Grams are sent as text, equal ones of a slice and of a task as one row.

Null and empty texts have no words; a null lang counts as und. Repeated rows count each time. Very long texts are read
whole, one at a time. Empty tables give no rows. Ids are not read, and other columns may have any names. Ties are
ordered by score, count and phrase.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.llm import words as wd
from vigil.llm.session import written
from vigil.operators.sequences import Ordered

BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"


@dataclass(frozen=True)
class Settings:
    longest: int = 5
    min_count: int = 100
    best: int = 2000
    #: Text bytes per slot of the pair table for each unit of min_count, and slots at most (2**27: 128 MB in a task).
    bytes_per_slot: float = 1.25
    most_slots: int = 1 << 27
    #: Rows of a part that many candidates share are spread over so many keys.
    salts: int = 8
    deals: int = 64


def _marks(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_BREAK, _APART = _marks(BREAKS), _marks(BREAKS + BLANKS)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(part: pa.RecordBatch):
    """Bytes, words, two hashes of each word (its language in them) and whether the next word is of the same piece."""
    data, at = wd.text_bytes(part.column("text"))
    seg = wd.segments(data, at, _APART)
    lang = part.column("lang").dictionary_encode()
    own = np.array([zlib.crc32(x.encode()) for x in lang.dictionary.to_pylist()], np.uint64)
    salt = own[np.asarray(lang.indices)[seg.doc]] if len(own) else np.zeros(len(seg.doc), np.uint64)
    one, two = (wd.mix(wd.span_hashes(data, seg.start, seg.end, wd.byte_codes(True, s)) + salt) for s in (1, 2))
    piece = np.cumsum(_BREAK[data])[seg.start] if len(data) else np.zeros(0, np.int64)
    linked = np.zeros(len(one), bool)
    linked[:-1] = (piece[1:] == piece[:-1]) & (seg.doc[1:] == seg.doc[:-1])
    return data, seg, one, two, linked


def _slots(one: np.ndarray, linked: np.ndarray, slots: int) -> np.ndarray:
    """The slot of each linked word and its next."""
    at = np.flatnonzero(linked)
    return (wd.mix(one[at] * wd._STEP + one[at + 1]) & np.uint64(slots - 1)).astype(np.int64)


def _pair_slots(view: DataFrame, slots: int, s: Settings) -> np.ndarray:
    """One bit a slot: whether its pairs occur min_count times or more together. Each task adds up one table, sent in
    chunks; chunks of the same place meet in two steps, of 64 tasks each and then of those."""
    chunk = min(slots, 1 << 16)
    kind = np.uint8 if s.min_count <= 255 else np.uint32
    most = min(s.min_count, 2**32 - 1)

    def packed(chunks, parts, values):
        return pa.RecordBatch.from_arrays(
            [pa.array(chunks, pa.int64()), pa.array(parts, pa.int64()), pa.array(values, pa.binary())], ["chunk", "part", "counts"]
        )

    def tables(batches):
        from pyspark import TaskContext

        part_id = TaskContext.get().partitionId() // 64
        table = np.zeros(slots, kind)
        for batch in batches:
            for part in wd.slices(batch, "text"):
                _, _, one, _, linked = _words(part)
                slot, n = np.unique(_slots(one, linked, slots), return_counts=True)
                table[slot] = np.minimum(table[slot].astype(np.int64) + n, most).astype(kind)
        for i in range(0, slots, chunk):
            own = table[i : i + chunk]
            if own.any():
                yield packed([i // chunk], [part_id], [zlib.compress(own.tobytes(), 1)])

    def total(table: pa.Table) -> np.ndarray:
        out = np.zeros(chunk, np.int64)
        for value in table.column("counts"):
            out += np.frombuffer(zlib.decompress(value.as_py()), kind)
        return np.minimum(out, most).astype(kind)

    def added(key, table):
        return pa.Table.from_batches([packed([key[0].as_py()], [key[1].as_py()], [zlib.compress(total(table).tobytes(), 1)])])

    def bits(key, table):
        return pa.Table.from_batches([packed([key[0].as_py()], [0], [np.packbits(total(table) >= s.min_count).tobytes()])])

    schema = "chunk long, part long, counts binary"
    sums = view.mapInArrow(tables, schema).groupBy("chunk", "part").applyInArrow(added, schema)
    out = np.zeros(slots // 8, np.uint8)
    for row in sums.groupBy("chunk").applyInArrow(bits, schema).toLocalIterator():  # at most most_slots / 8 bytes, 16 MB
        out[row.chunk * chunk // 8 : (row.chunk + 1) * chunk // 8] = np.frombuffer(row.counts, np.uint8)
    return out


def _grams(data, seg, one, two, linked, frequent, slots: int, longest: int):
    """The longest gram from each word: text span in the joined words, and two hashes."""
    goes_on = linked.copy()
    at = np.flatnonzero(linked)
    slot = _slots(one, linked, slots)
    goes_on[at] = (frequent[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
    length = np.ones(len(one), np.int64)
    first, second = one.copy(), two.copy()
    live = np.arange(len(one))
    for k in range(1, longest):
        live = live[goes_on[live + k - 1]]
        length[live] += 1
        first[live] = wd.mix(first[live] * wd._STEP + one[live + k])
        second[live] = wd.mix(second[live] * wd._STEP + two[live + k])
    sizes = seg.end - seg.start
    starts = np.cumsum(sizes + 1) - sizes - 1
    joined = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    joined[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = _LOWER[data[~_APART[data]]]
    last = np.arange(len(one)) + length - 1
    return joined, starts, starts[last] + sizes[last], first, second


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A member and the size of each group of equal pairs of hashes."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


def edges(docs: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): how often words are followed by just the words of gram, up to its end or to where no frequent
    phrase goes on."""
    s = settings
    view = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    size = view.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slots = 1 << 16
    while slots < min(size / (s.bytes_per_slot * s.min_count), s.most_slots):
        slots *= 2
    sent = docs.sparkSession.sparkContext.broadcast(_pair_slots(view, slots, s))

    def rows(batches):
        for batch in batches:
            for part in wd.slices(batch, "text", 1 << 22):
                data, seg, one, two, linked = _words(part)
                if not len(one):
                    continue
                joined, start, end, first, second = _grams(data, seg, one, two, linked, sent.value, slots, s.longest)
                member, n = _distinct(first, second)
                start, end = start[member], end[member]
                offsets = np.zeros(len(member) + 1, np.int64)
                np.cumsum(end - start, out=offsets[1:])
                taken = joined[np.repeat(start - offsets[:-1], end - start) + np.arange(offsets[-1])]
                gram = pa.LargeStringArray.from_buffers(len(member), pa.py_buffer(offsets), pa.py_buffer(taken)).cast(pa.string())
                langs = part.column("lang").take(pa.array(seg.doc[member]))
                yield pa.RecordBatch.from_arrays([langs, gram, pa.array(n)], ["lang", "gram", "n"])

    return view.mapInArrow(rows, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def flows(edges: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, words, f): counts of all phrases that begin a gram, from the flow through their nodes."""
    words = F.length("gram") - F.length(F.translate("gram", " ", "")) + 1
    nodes = edges.withColumn("words", F.explode(F.sequence(F.lit(1), words.cast("int"))))
    nodes = nodes.select("lang", F.expr("substring_index(gram, ' ', words)").alias("phrase"), "words", "n")
    return nodes.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.sum("n").alias("f")).filter(F.col("f") >= min_count)


def compacted(phrases: DataFrame) -> DataFrame:
    """Phrases of two words or more that no phrase of one word more holds with the same count: what is left of each
    unary path is its longest phrase. Longer ones add nothing, as counts never grow along a path."""
    head = F.expr("substring_index(phrase, ' ', words - 1)")
    tail = F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)")
    inner = phrases.filter("words > 2").select("lang", F.explode(F.array(head, tail)).alias("phrase"), F.col("f").alias("outer"))
    own = phrases.filter("words > 1").select("lang", "phrase", "words", "f", F.lit(None).cast("long").alias("outer"))
    both = own.unionByName(inner.select("lang", "phrase", F.lit(None).cast("int").alias("words"), F.lit(None).cast("long").alias("f"), "outer"))
    out = both.groupBy("lang", "phrase").agg(F.max("words").alias("words"), F.max("f").alias("f"), F.max("outer").alias("outer"))
    return out.filter("f is not null and (outer is null or outer < f)").drop("outer")


def collocations(docs: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases."""
    s = settings
    graph = written(edges(docs, s, text, lang), "edges")
    phrases = written(flows(graph, s.min_count), "phrases")
    # joined by language and phrase's deal: by language alone each would be one task, here and in what is grouped next
    totals = graph.groupBy("lang").agg(F.sum("n").alias("n")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(s.deals - 1))))
    cuts = compacted(phrases).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    cuts = cuts.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(s.salts))).withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(s.deals)))
    parts = phrases.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1))))
    left = parts.select("lang", "salt", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = parts.select("lang", "salt", F.col("phrase").alias("right"), F.col("f").alias("r"))
    found = cuts.join(left, ["lang", "salt", "left"]).join(right, ["lang", "salt", "right"]).join(totals, ["lang", "deal"])
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    found = found.withColumn("up", F.lit(1000).cast("decimal(4,0)") * whole("f") * whole("n")).withColumn("down", whole("l") * whole("r"))
    lowest = F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("cut")
    scored = found.groupBy("lang", "phrase").agg(lowest, F.first("f").alias("a"), F.first("n").alias("n"))
    scored = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = F.row_number().over(W.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(s.deals))).orderBy(*order))
    few = scored.withColumn("rank", first).filter(F.col("rank") <= s.best)
    out = Ordered(few.drop("rank"), ["lang"], order).numbered("rank").filter(F.col("rank") <= s.best)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
