"""Removal of repeated passages, found through difference-cover anchors.

Of the word positions of a document, only those in a difference cover modulo 13 ({0, 1, 3, 9}) carry an anchor:
the hash of the 8 words from there. Whatever two positions begin the same 20 words, some shift below 13 takes
both into the cover, so the two windows share an aligned anchor (13 - 1 + 8 = 20). Anchors are counted over all
documents. Only windows that hold an anchor seen twice are extended to their 20 words and compared with each
other; a window whose words start earlier somewhere is a repeat, and its words go.

The repeated anchors are passed around as a Bloom filter of bounded size. False positives, more of them when the
filter is small for the corpus, only cost extra windows; they never change the result. Of equal windows in one
slice of a task, only the earliest is sent on, so a passage that a third of all documents share sends a few rows.

Hashes of windows have 96 bits. Null and empty texts have no words. doc_id may have any type that can be ordered and
names the document: rows that repeat an id count as the same document, so what stands at the same place in them is not
a repeat. A row without an id has no place in the order: it keeps all its words and takes none from others. Very long
texts are held one at a time; an empty table gives no rows, and other columns may have any names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import words as wd
from vigil.llm.session import written


@dataclass(frozen=True)
class Settings:
    window: int = 20
    period: int = 13
    cover: tuple[int, ...] = (0, 1, 3, 9)
    #: Bits of the filter for each repeated anchor, and bits at most (2**28 bits are 32 MB).
    bits_per_anchor: int = 12
    most_bits: int = 1 << 28

    @property
    def anchor(self) -> int:
        return self.window - self.period + 1


_SPACE = wd.is_space()


def _words(part: pa.RecordBatch):
    data, at = wd.text_bytes(part.column("text"))
    seg = wd.segments(data, at, _SPACE)
    first = seg.per_doc(len(at) - 1)
    return data, seg, first, wd.span_hashes(data, seg.start, seg.end, wd.byte_codes())


def _anchors(word, doc, first, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each anchor."""
    key, at = wd.window_hashes(word, doc, s.anchor)
    chosen = np.isin((at - first[doc[at]]) % s.period, s.cover)
    return key[chosen], at[chosen]


def _bit_places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    second = wd.mix(key ^ np.uint64(0xA5A5A5A55A5A5A5A)) | np.uint64(1)
    return tuple(((key + np.uint64(i) * second) & np.uint64(bits - 1)).astype(np.int64) for i in range(3))


def _seen(key: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    out = np.ones(len(key), bool)
    for place in _bit_places(key, len(filter_) * 8):
        out &= (filter_[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return out


def _candidates(word, doc, first, filter_, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes and the first word of each window that holds a repeated anchor."""
    key, at = _anchors(word, doc, first, s)
    at = at[_seen(key, filter_)]
    n = len(word) - s.window + 1
    if n <= 0 or not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = np.maximum(at - (s.period - 1), first[doc[at]])
    mark = np.bincount(low, minlength=len(word) + 1) - np.bincount(at + 1, minlength=len(word) + 1)
    start = np.flatnonzero((np.cumsum(mark)[:n] > 0) & (doc[:n] == doc[s.window - 1 :]))
    one, two = word[start].copy(), wd.mix(word[start])
    for i in range(1, s.window):
        w = word[start + i]
        one = one * wd._STEP + w
        two = (two ^ w) * np.uint64(0xD6E8FEB86659FD93)
        two ^= two >> np.uint64(32)
    return wd.mix(one), wd.mix(two), start


def _filter(docs: DataFrame, s: Settings) -> np.ndarray:
    """The Bloom filter of all anchors that occur twice or more."""

    def counts(batches):
        for batch in batches:
            for part in wd.slices(batch, "text", 1 << 20):
                _, seg, first, word = _words(part)
                key, n = np.unique(_anchors(word, seg.doc, first, s)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["key", "n"])

    repeated = written(docs.mapInArrow(counts, "key long, n int").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"), "anchors")
    bits = 1 << 20
    most = repeated.count() * s.bits_per_anchor
    while bits < min(most, s.most_bits):
        bits *= 2

    def places(batches):
        for batch in batches:
            for place in _bit_places(np.asarray(batch.column("key")).view(np.uint64), bits):
                yield pa.RecordBatch.from_arrays([pa.array(place >> 16), pa.array((place & 0xFFFF).astype(np.int32))], ["chunk", "bit"])

    def chunks(key, table):
        own = np.zeros(1 << 16, bool)
        own[np.asarray(table["bit"])] = True
        return pa.table({"chunk": [key[0].as_py()], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    made = repeated.mapInArrow(places, "chunk long, bit int").distinct().groupBy("chunk").applyInArrow(chunks, "chunk long, bits binary")
    for row in made.toLocalIterator():  # at most most_bits / 2**16 rows of 8 KB
        out[row.chunk << 13 : (row.chunk + 1) << 13] = np.frombuffer(row.bits, np.uint8)
    return out


def without_repeats(docs: DataFrame, finish, schema: str, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs joined with what to remove. finish(batch, removed words per row) makes the rows of the result."""
    s, id_kind = settings, docs.schema[doc_id].dataType.simpleString()
    view = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).filter(F.col("doc_id").isNotNull())
    sent = docs.sparkSession.sparkContext.broadcast(_filter(view, s))

    def windows(batches):
        filter_ = sent.value
        for batch in batches:
            for part in wd.slices(batch, "text", 1 << 20):
                _, seg, first, word = _words(part)
                one, two, start = _candidates(word, seg.doc, first, filter_, s)
                row = seg.doc[start]
                rank = np.asarray(pc.rank(part.column("doc_id"), tiebreaker="dense")).astype(np.int64)
                order = np.lexsort((start - first[row], rank[row], two, one))
                one, two, start, row = one[order], two[order], start[order], row[order]
                lead = np.ones(len(one), bool)
                lead[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                row, start = row[lead], start[lead]
                yield pa.RecordBatch.from_arrays([pa.array(one[lead].view(np.int64)), pa.array((two[lead] >> np.uint64(32)).astype(np.uint32).view(np.int32)), part.column("doc_id").take(pa.array(row)), pa.array((start - first[row]).astype(np.int32))], ["one", "two", "doc_id", "at"])

    firsts = view.mapInArrow(windows, f"one long, two int, doc_id {id_kind}, at int").groupBy("one", "two").agg(F.min(F.struct("doc_id", "at")).alias("f")).groupBy(F.col("f.doc_id").alias("\1first_id")).agg(F.collect_list("f.at").alias("\1first_at"))

    def marked(batches):
        filter_ = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            at_text = pa.RecordBatch.from_arrays([batch.column(text).cast(pa.string())], ["text"])
            done = 0
            for view_part in wd.slices(at_text, "text", 1 << 20):
                part = batch.slice(done, view_part.num_rows)
                done += view_part.num_rows
                data, seg, first, word = _words(view_part)
                start = _candidates(word, seg.doc, first, filter_, s)[2]
                lists = part.column("\1first_at")
                row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)) if not lists.null_count else [len(x) if x is not None else 0 for x in lists.to_pylist()])
                keep = first[row] + np.asarray(lists.flatten()).astype(np.int64)
                gone = np.setdiff1d(start, keep)
                ids = part.column(doc_id)
                if ids.null_count:
                    gone = gone[np.asarray(pc.is_valid(ids).to_numpy(zero_copy_only=False))[seg.doc[gone]]]
                removed = wd.covered(gone, s.window, len(word))
                yield finish(part, data, seg, first, removed)

    named, bare = docs.filter(F.col(doc_id).isNotNull()), docs.filter(F.col(doc_id).isNull())
    joined = named.join(firsts, F.col(doc_id) == F.col("\1first_id"), "left").drop("\1first_id")
    joined = joined.unionByName(bare.withColumn("\1first_at", F.lit(None).cast("array<int>")))
    return joined.mapInArrow(marked, schema)


def _kept_words(data, seg, first, removed, i: int) -> bytes:
    span = range(first[i], first[i + 1])
    return b" ".join(data[seg.start[w] : seg.end[w]].tobytes() for w in span if not removed[w])


def digests(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed and the SHA-256 of the kept words joined by spaces."""

    def finish(part, data, seg, first, removed):
        n_removed = wd.sums_per_doc(removed, first)
        sha = []
        for i, t in enumerate(part.column(text).cast(pa.string()).to_pylist()):
            kept = b" ".join((t or "").encode().split()) if not n_removed[i] else _kept_words(data, seg, first, removed, i)
            sha.append(hashlib.sha256(kept).hexdigest())
        return pa.RecordBatch.from_arrays([part.column(doc_id), pa.array(np.diff(first)), pa.array(n_removed), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return without_repeats(docs.select(doc_id, text), finish, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string", settings, doc_id, text)


def removed_from(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None) -> DataFrame:
    """docs with repeated passages taken out of the text: where words go, the rest is joined by single spaces; other
    texts stay as they are. n_chars names a column that holds the text's length, to be kept right."""
    names = docs.columns

    def finish(part, data, seg, first, removed):
        n_removed = wd.sums_per_doc(removed, first)
        texts = [t if not n_removed[i] else _kept_words(data, seg, first, removed, i).decode() for i, t in enumerate(part.column(text).cast(pa.string()).to_pylist())]
        columns = {n: part.column(n) for n in names} | {text: pa.array(texts, pa.string())}
        if n_chars:
            kind = part.schema.field(n_chars).type
            columns[n_chars] = pa.array([old if not k else len(t) for old, k, t in zip(part.column(n_chars).to_pylist(), n_removed, texts)], kind)
        return pa.RecordBatch.from_arrays(list(columns.values()), names)

    return without_repeats(docs, finish, docs.schema, settings, doc_id, text)
