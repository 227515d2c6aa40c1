"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words, each ended by a blank, and one line feed as its end. Every byte is eight binary
decisions. The context of a byte are the bytes before it in its word (with the blank before the word), up to a
depth. For every decision a context tree holds Krichevsky-Trofimov estimates at each depth; a node's weighted
probability is half its own estimate and half the product over its children. The coding distribution is what
these weights give after all training texts: at each depth the node's own estimate with its posterior weight, the
rest passed on to the deeper node. Where a context was never seen, the deepest seen node's estimate stands.

The counts come from all training words and grow with the corpus; no task or driver holds the model. Words are
counted by bucket of documents, then over all; grams of context and byte form the trees, which are cut at depth
two into independent groups; the two upper levels (at most 257 contexts) pass through the driver. Scores travel
back the same way: from grams to blocks of words, from words to buckets of documents.

Null and empty texts have no words, only an end. Null ids are never held out. Repeated rows are texts of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import words as wd
from vigil.llm.session import written

END = "\n"


@dataclass(frozen=True)
class Settings:
    folds: int = 5
    held_out: int = 1
    #: Bytes of context.
    depth: int = 5
    #: Bytes of text in a bucket of documents, and words in a block of the vocabulary.
    bucket_bytes: int = 16 << 20
    block_words: int = 200_000


_SPACE = wd.is_space()


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma of x >= 0.5 by Stirling's series, after four steps up."""
    y = x + 4
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(x * (x + 1) * (x + 2) * (x + 3))


#: log gamma at whole numbers and a half, and at whole numbers from 1: most counts are small.
_HALVES, _WHOLES = _lgamma(np.arange(1 << 14) + 0.5), _lgamma(np.arange(1 << 14) + 1.0)


def _of_count(n: np.ndarray, known: np.ndarray, plus: float) -> np.ndarray:
    """_lgamma(n + plus) of whole numbers n, from a table as far as it goes."""
    at = n.astype(np.int64)
    out = known.take(at, mode="clip")
    large = np.flatnonzero(at >= len(known))
    out[large] = _lgamma(n[large] + plus)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the KT probability of a zeros and b ones."""
    return _of_count(a, _HALVES, 0.5) + _of_count(b, _HALVES, 0.5) - _of_count(a + b, _WHOLES, 1.0) - 2 * lgamma(0.5)


def grams(words: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and byte, as one number, of every byte of each word and its closing blank; and the word's index.
    The nearest byte of the context stands lowest; before a word stands one blank, then zeros."""
    data, at = wd.text_bytes(words)
    size = np.diff(at)
    is_end = (size == 1) & (np.append(data, 0)[np.minimum(at[:-1], len(data))] == 10)
    full = size + 1 - is_end
    begin = np.concatenate([[0], np.cumsum(full)])
    row = np.repeat(np.arange(len(size)), full)
    place = np.arange(begin[-1]) - begin[row]
    symbol = np.full(begin[-1], 32, np.uint64)
    inside = place < size[row]
    symbol[inside] = data[at[row[inside]] + place[inside]]
    code = symbol.copy()
    for j in range(1, depth + 1):
        back = np.zeros(len(code), np.uint64)
        back[place == j - 1] = 32
        deep = np.flatnonzero(place >= j)
        back[deep] = symbol[deep - j]
        code |= back << np.uint64(8 * j)
    return code, row


@dataclass
class Level:
    """Nodes of one depth, sorted by key (context, then the decision's place in the byte)."""

    key: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray

    def estimates(self) -> tuple[np.ndarray, np.ndarray]:
        """Posterior weight of the node's own estimate, and its probability of a one."""
        own = np.exp(np.minimum(np.log(0.5) + log_kt(self.zeros, self.ones) - self.weighted, 0))
        return own, (self.ones + 0.5) / (self.zeros + self.ones + 1)


def _decisions(code: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the eight decisions of each gram at a depth, and the bits: arrays of shape (8, grams)."""
    symbol = code & np.uint64(255)
    context = (code >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
    k = np.arange(8, dtype=np.uint64)[:, None]
    prefix = (np.uint64(1) << k) | (symbol[None, :] >> (np.uint64(8) - k))
    return (context[None, :] << np.uint64(8)) | prefix, (symbol[None, :] >> (np.uint64(7) - k)) & np.uint64(1)


def levels(code: np.ndarray, count: np.ndarray, top: int, depth: int) -> dict[int, Level]:
    """The trees of some grams, from the deepest level up to depth top."""
    seen = count > 0
    code, count = code[seen], count[seen].astype(float)
    out: dict[int, Level] = {}
    for d in range(depth, top - 1, -1):
        keys, bits = _decisions(code, d)
        key, inverse = np.unique(keys.ravel(), return_inverse=True)
        ones = np.bincount(inverse, (bits * count).ravel(), len(key))
        zeros = np.bincount(inverse, ((1 - bits.astype(np.int64)) * count).ravel(), len(key))
        zeros, ones = zeros.astype(float), ones.astype(float)  # without grams the counts are whole numbers
        level = Level(key, zeros, ones, log_kt(zeros, ones))
        if d < depth:
            below = out[d + 1]
            context = (below.key >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)
            parent = np.searchsorted(key, (context << np.uint64(8)) | (below.key & np.uint64(255)))
            children = np.bincount(parent, below.weighted, len(key))
            level.weighted = np.logaddexp(level.weighted, children) + np.log(0.5)
        out[d] = level
    return out


def log2_of(code: np.ndarray, trees: dict[int, Level]) -> np.ndarray:
    """log2 probability of each gram's byte in its context."""
    total = np.zeros(len(code))
    mixed, left, last = np.zeros((8, len(code))), np.ones((8, len(code))), np.full((8, len(code)), 0.5)
    for d in sorted(trees):
        level = trees[d]
        keys, bits = _decisions(code, d)
        if not len(level.key):
            break
        at = np.minimum(np.searchsorted(level.key, keys), len(level.key) - 1)
        found = level.key[at] == keys
        own, one = level.estimates()
        p = np.where(bits == 1, one[at], 1 - one[at])
        weight = np.where(found, own[at], 0.0)
        mixed += left * weight * p
        left *= 1 - weight
        last = np.where(found, p, last)
    total += np.log2(mixed + left * last).sum(axis=0)
    return total


def _upper(rows, depth: int) -> dict[int, Level]:
    """Levels 0 and 1 from the sums over level 2: per first context byte and decision, counts and log weights."""
    key = np.array([r.context << 8 | r.node for r in rows], np.uint64)
    order = np.argsort(key)
    zeros, ones, below = (np.array([float(getattr(r, c)) for r in rows])[order] for c in ("zeros", "ones", "weighted"))
    key = key[order]
    one = Level(key, zeros, ones, np.logaddexp(log_kt(zeros, ones), below) + np.log(0.5)) if len(key) else Level(key, zeros, ones, zeros)
    node, inverse = np.unique(key & np.uint64(255), return_inverse=True)
    z, o, w = (np.bincount(inverse, x, len(node)) for x in (zeros, ones, one.weighted))
    return {0: Level(node, z, o, np.logaddexp(log_kt(z, o), w) + np.log(0.5) if len(node) else z), 1: one}


def scored(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and
    bits_per_byte. base_score is that of smoothed word counts; both scores are log10 probabilities."""
    s, kind = settings, docs.schema[doc_id].dataType.simpleString()
    view = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % s.folds == s.held_out, F.lit(False))
    view = view.withColumn("held_out", held)
    size, train_docs = view.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.when(~F.col("held_out"), 1))).first()
    buckets = max(1, -(-size // s.bucket_bytes))
    view = view.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))

    def vocabulary(batches):
        """Per bucket: its distinct words and their counts in training texts."""
        bucket, seen = None, {}

        def out():
            keys = list(seen)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(part), pa.int32()), pa.array(part, pa.string()), pa.array([seen[k] for k in part], pa.int64())], ["bucket", "word", "n"])

        for batch in batches:
            for b, t, h in zip(batch.column("bucket").to_pylist(), batch.column("text").to_pylist(), batch.column("held_out").to_pylist()):
                if b != bucket:
                    yield from out()
                    bucket, seen = b, {}
                one = 0 if h else 1
                for w in t.encode().lower().split():
                    seen[w] = seen.get(w, 0) + one
        yield from out()

    dealt = view.repartition("bucket").sortWithinPartitions("bucket")
    by_bucket = written(dealt.select("bucket", "text", "held_out").mapInArrow(vocabulary, "bucket int, word string, n long"), "bucket-words")
    counted = written(by_bucket.groupBy("word").agg(F.sum("n").alias("n")), "words")
    n_words, tokens, distinct = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    tokens, distinct = tokens + train_docs, distinct + (train_docs > 0)
    blocks = max(1, -(-(n_words + 1) // s.block_words))
    ends = docs.sparkSession.range(1).select(F.lit(END).alias("word"), F.lit(train_docs).cast("long").alias("n"))
    words = counted.unionByName(ends).withColumn("block", F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int"))

    def block_grams(key, table):
        table = table.combine_chunks()
        code, row = grams(_one(table["word"]), s.depth)
        gram, inverse = np.unique(code, return_inverse=True)
        n = np.bincount(inverse, np.asarray(table["n"])[row], len(gram)).astype(np.int64)
        return pa.table({"block": pa.array(np.full(len(gram), key[0].as_py(), np.int32)), "gram": gram.view(np.int64), "n": n})

    needed = written(words.groupBy("block").applyInArrow(block_grams, "block int, gram long, n long"), "grams")
    tree = F.shiftright("gram", 8).bitwiseAND(0xFFFF).cast("int")
    all_grams = written(needed.groupBy("gram").agg(F.sum("n").alias("n")).withColumn("tree", tree), "all-grams")

    def roots(key, table):
        level = levels(_codes(table["gram"]), np.asarray(table["n"]), 2, s.depth)[2]
        context = ((level.key >> np.uint64(8)) & np.uint64(255)).astype(np.int32)
        return pa.table({"context": context, "node": (level.key & np.uint64(255)).astype(np.int32), "zeros": level.zeros, "ones": level.ones, "weighted": level.weighted})

    second = all_grams.groupBy("tree").applyInArrow(roots, "context int, node int, zeros double, ones double, weighted double")
    upper = _upper(second.groupBy("context", "node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "weighted"))).collect(), s.depth)

    def priced(key, table):
        code = _codes(table["gram"])
        trees = upper | levels(code, np.asarray(table["n"]), 2, s.depth)
        return pa.table({"gram": code.view(np.int64), "log2": log2_of(code, trees)})

    prices = written(all_grams.groupBy("tree").applyInArrow(priced, "gram long, log2 double"), "prices")
    by_block = needed.select("block", "gram").join(prices, "gram")

    def word_prices(key, words_, grams_):
        code, row = grams(_one(words_["word"]), s.depth)
        known, price = _codes(grams_["gram"]), np.asarray(grams_["log2"])
        order = np.argsort(known)
        each = price[order][np.searchsorted(known[order], code)]
        return pa.table({"word": words_["word"], "n": words_["n"], "log2": np.bincount(row, each, words_.num_rows)})

    per_word = written(words.groupBy("block").cogroup(by_block.groupBy("block")).applyInArrow(word_prices, "word string, n long, log2 double"), "word-prices")
    end = per_word.filter(F.col("word") == END).first()
    by_bucket = by_bucket.select("bucket", "word").join(per_word, "word")
    base = lambda n: np.log10((n + 0.5) / (tokens + 0.5 * (distinct + 1)))

    def document_scores(key, texts, prices_):
        data, at = wd.text_bytes(_one(prices_["word"]))
        known = wd.span_hashes(data, at[:-1], at[1:], wd.byte_codes(lower=True))
        order = np.argsort(known)
        known, n, log2 = known[order], np.asarray(prices_["n"])[order], np.asarray(prices_["log2"])[order]
        out = []
        for batch in texts.combine_chunks().to_batches():
            for part in wd.slices(batch, "text", 1 << 20):
                data, at = wd.text_bytes(part.column("text"))
                seg = wd.segments(data, at, _SPACE)
                first = seg.per_doc(part.num_rows)
                spot = np.searchsorted(known, wd.span_hashes(data, seg.start, seg.end, wd.byte_codes(lower=True)))
                total = lambda x: np.bincount(seg.doc, x, part.num_rows)  # noqa: B023, E731
                count, n_bytes = np.diff(first), total(seg.end - seg.start + 1) + 1
                bits = total(log2[spot]) + end.log2
                made = {"held_out": part.column("held_out"), "n_tokens": count + 1, "n_known": (total(n[spot] > 0) + (end.n > 0)).astype(np.int64), "train_tokens": np.full(len(count), tokens), "base_score": total(base(n[spot])) + base(end.n), "score": bits * np.log10(2), "n_bytes": n_bytes.astype(np.int64), "bits_per_byte": -bits / n_bytes}
                out.append(pa.table({"doc_id": part.column("doc_id")} | made))
        return pa.concat_tables(out)

    result = view.groupBy("bucket").cogroup(by_bucket.groupBy("bucket")).applyInArrow(document_scores, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")
    return result


def _one(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def _codes(column) -> np.ndarray:
    return np.asarray(column).view(np.uint64)
