"""Context-tree weighting over whole texts: contexts run over the preceding bytes, through blanks into earlier words.

The texts, their normal form and the weighting are those of ctw; only the context differs. A gram (context and byte)
is one number with the nearest byte of the context highest, so that the nodes of any depth are runs of sorted grams.
Grams are counted by bucket of documents. Each bucket deals them out, packed, by their three nearest context bytes;
they are written once, a row for each part, and each part builds its trees from the sums over all buckets and sends the prices back to the buckets in the order of
their grams. The three upper levels pass through the driver; their number of contexts does not grow with the corpus.
Word counts travel the same way, by 64-bit hash. Below a context that all its occurrences reach by the same bytes, all
nodes have the same counts and estimates, so the tree ends there and the prices stay the same.

Null and empty texts are the one end token. Null ids are never held out and their texts train. Repeated rows train and are
scored each. Very long texts are scored whole, each held by one task. Empty tables give no rows; a table without training
rows scores by the estimates without counts. Other columns may have any names and are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import words as wd
from vigil.llm.ctw import _SPACE, Settings, log_kt
from vigil.llm.session import written

#: Bytes of context that lead to one tree; the levels above pass through the driver.
CUT = 3
U64 = np.uint64


def pack(x: np.ndarray) -> bytes:
    """Byte planes of whole numbers or floats, compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(raw: bytes, kind) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=U64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, U64), dtype=U64)


def grams(texts: list, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram of every byte of each text in normal form, and the text's index; before a text stand a blank and zeros."""
    normal = [b" ".join([*(t or "").encode().lower().split(), b"\n"]) for t in texts]
    before = b"\0" * (depth - 1) + b" "
    data = np.frombuffer(b"".join(x for t in normal for x in (before, t)), np.uint8)
    size = np.array([len(t) for t in normal], np.int64)
    inside = np.repeat(np.tile([False, True], len(size)), np.stack([np.full(len(size), depth), size], 1).ravel())[depth:]
    code = data[depth:].astype(U64)
    for j in range(1, depth + 1):
        code |= data[depth - j : len(data) - j].astype(U64) << U64(64 - 8 * j)
    return code[inside], np.repeat(np.arange(len(size)), size)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(_starts(keys))
    return keys[first], np.diff(np.append(first, len(keys)))


def _summed(keys: list, counts: list, placed: bool = True) -> tuple[np.ndarray, np.ndarray, list]:
    """Sorted keys and sums of some runs of distinct sorted keys; and, if asked for, each run's places in them."""
    every = _distinct(np.concatenate(keys))[0]
    places, total = [], np.zeros(len(every), np.int64)
    for k, n in zip(keys, counts):
        at = np.searchsorted(every, k)
        total[at] += n
        if placed:
            places.append(at)
    return every, total, places


def _starts(x: np.ndarray) -> np.ndarray:
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return new


def at_depth(gram: np.ndarray, d: int) -> np.ndarray:
    """Context of d bytes and the symbol, from grams."""
    symbol = gram & U64(255)
    return (gram >> U64(64 - 8 * d)) << U64(8) | symbol if d else symbol


def _nodes(key: np.ndarray, k: int) -> np.ndarray:
    """Context and node: the decision after k bits of the symbol."""
    return (key >> U64(8)) << U64(8) | U64(1 << k) | (key & U64(255)) >> U64(8 - k)


@dataclass
class Layer:
    """One depth: its sorted rows (context and symbol), the row above each, the grams whose tree ends here and their
    rows; and, for each of the eight decisions, each row's node, the nodes' first rows, counts and log weights."""

    key: np.ndarray
    up: np.ndarray | None
    ended: np.ndarray
    at: np.ndarray
    node: list[np.ndarray]
    first: list[np.ndarray]
    zeros: list[np.ndarray]
    ones: list[np.ndarray]
    weighted: list[np.ndarray]

    def estimates(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Posterior weight of each node's own estimate, and its probability of a one."""
        own = np.exp(np.minimum(np.log(0.5) + log_kt(self.zeros[k], self.ones[k]) - self.weighted[k], 0))
        return own, (self.ones[k] + 0.5) / (self.zeros[k] + self.ones[k] + 1)


def layers(gram: np.ndarray, count: np.ndarray, top: int, depth: int) -> list[Layer]:
    """The trees of some sorted grams from depth top down."""
    out, open_ = [], []
    live, index = gram, np.arange(len(gram))
    for d in range(top, depth + 1):
        if d > top:
            if not split.any():
                break
            live, count, index = live[split], count[split], index[split]
            before = row[split]
        key, row = np.unique(at_depth(live, d), return_inverse=True)
        n = np.bincount(row, count, len(key))
        layer = Layer(key, None, index, row, [], [], [], [], [])
        differs = key[1:] ^ key[:-1]
        for k in range(8):
            new = np.ones(len(key), bool)
            new[1:] = differs >= U64(1 << (8 - k))  # another context or another beginning of the symbol
            first = np.flatnonzero(new)
            ones = np.add.reduceat(n * ((key >> U64(7 - k)) & U64(1)), first)
            layer.node.append(np.cumsum(new, dtype=np.int32) - np.int32(1))
            layer.first.append(first)
            layer.ones.append(ones)
            layer.zeros.append(np.add.reduceat(n, first) - ones)
        if d > top:
            layer.up = np.empty(len(key), np.int32)
            layer.up[row] = before
        # contexts that more than one full context reaches go on
        start = np.flatnonzero(_starts(live >> U64(64 - 8 * d))) if d else np.zeros(1, np.int64)
        ends = np.append(start[1:], len(live)) - 1
        split = np.repeat((live[start] >> U64(8)) != (live[ends] >> U64(8)), ends - start + 1) if d < depth else np.zeros(len(live), bool)
        more = np.zeros(len(key), bool)
        more[row] = split
        open_.append(more)
        layer.ended, layer.at = index[~split], row[~split].astype(np.int32)
        out.append(layer)
    for i in range(len(out) - 1, -1, -1):
        layer = out[i]
        for k in range(8):
            own = log_kt(layer.zeros[k], layer.ones[k])
            if i + 1 < len(out):
                below = out[i + 1]
                parent = layer.node[k][below.up[below.first[k]]]
                children = np.bincount(parent, below.weighted[k], len(own))
                own = np.where(open_[i][layer.first[k]], np.logaddexp(own, children) + np.log(0.5), own)
            layer.weighted.append(own)
    return out


def _mix(state: list, found, own: np.ndarray, p: np.ndarray) -> None:
    """One more depth; state: probability so far, weight left for what lies deeper, the deepest estimate found."""
    mixed, left, last = state
    weight = np.where(found, own, 0.0)
    state[:] = mixed + left * weight * p, left * (1 - weight), np.where(found, p, last)


def _above(short: np.ndarray, upper: list) -> list[list]:
    """States of the eight decisions after the levels above the trees, for contexts of their depth and symbols."""
    states = [[np.zeros(len(short)), np.ones(len(short)), np.full(len(short), 0.5)] for _ in range(8)]
    for d, (nodes, own, one) in enumerate(upper):
        key = (short >> U64(8 * (len(upper) - d))) << U64(8) | short & U64(255) if d else short & U64(255)
        for k in range(8 if len(nodes) else 0):
            want = _nodes(key, k)
            at = np.minimum(np.searchsorted(nodes, want), len(nodes) - 1)
            _mix(states[k], nodes[at] == want, own[at], np.where((key >> U64(7 - k)) & U64(1) == 1, one[at], 1 - one[at]))
    return states


def log2_learnt(size: int, upper: list, trees: list[Layer]) -> np.ndarray:
    """log2 probability in its context of each of the grams that the trees were built from: down from row to row."""
    out = np.zeros(size)
    key = trees[0].key
    above = _above((key >> U64(16)) << U64(8) | key & U64(255), upper)
    for k in range(8):
        state = above[k]
        for layer in trees:
            if layer.up is not None:
                state = [x[layer.up] for x in state]
            own, one = layer.estimates(k)
            node = layer.node[k]
            p = one[node]
            _mix(state, True, own[node], np.where((layer.key >> U64(7 - k)) & U64(1) == 1, p, 1 - p))
            mixed, left, last = (x[layer.at] for x in state)
            out[layer.ended] += np.log2(mixed + left * last)
    return out


def log2_of(gram: np.ndarray, upper: list, trees: list[Layer], top: int) -> np.ndarray:
    """log2 probability of any grams' bytes in their contexts, in slices that bound memory."""
    tables = [[layer.estimates(k) for k in range(8)] for layer in trees]
    return np.concatenate([_log2_of(gram[i : i + 200_000], upper, trees, tables, top) for i in range(0, len(gram), 200_000)] or [np.zeros(0)])


def _log2_of(gram: np.ndarray, upper: list, trees: list[Layer], tables: list, top: int) -> np.ndarray:
    short, back = np.unique(at_depth(gram, top - 1), return_inverse=True)
    mixed, left, last = (np.stack(x)[:, back] for x in zip(*_above(short, upper)))
    out, rows = np.zeros(len(gram)), np.arange(len(gram))
    for d, (layer, table) in enumerate(zip(trees, tables), top):
        key = at_depth(gram[rows], d)
        right = np.searchsorted(layer.key, key)
        here, there = np.minimum(right, len(layer.key) - 1), np.maximum(right - 1, 0)
        off_here, off_there = key ^ layer.key[here], key ^ layer.key[there]
        known = np.minimum(off_here, off_there) < U64(256)
        if not known.all():  # contexts that end above
            out[rows[~known]] = np.log2(mixed[:, ~known] + left[:, ~known] * last[:, ~known]).sum(axis=0)
            rows, mixed, left, last = rows[known], mixed[:, known], left[:, known], last[:, known]
            key, here, there, off_here, off_there = (x[known] for x in (key, here, there, off_here, off_there))
        if not len(rows):
            break
        for k in range(8):
            bound = U64(1 << (8 - k))  # equal contexts, and equal first k bits of the symbol
            a = off_here < bound
            at = layer.node[k][np.where(a, here, there)]
            own, one = table[k]
            state = [mixed[k], left[k], last[k]]
            _mix(state, a | (off_there < bound), own[at], np.where((key >> U64(7 - k)) & U64(1) == 1, one[at], 1 - one[at]))
            mixed[k], left[k], last[k] = state
    out[rows] = np.log2(mixed + left * last).sum(axis=0)
    return out


def _union(sets: list) -> np.ndarray:
    return sets[0] if len(sets) == 1 else _distinct(np.concatenate(sets))[0]


def _add(sets: list, more: np.ndarray) -> None:
    """Adds a set of keys to a list of such sets, of which those that are no larger than what comes are joined first: what many
    pieces share is held once or a few times, not by each piece."""
    while sets and len(sets[-1]) <= 2 * len(more):
        more = _union([sets.pop(), more])
    sets.append(more)


def _upper(rows) -> list:
    """(nodes, weight of the own estimate, probability of a one) of levels 0 to 2, from the sums under level 2."""
    context, node = (np.array([getattr(r, c) for r in rows], np.int64) for c in ("context", "node"))
    zeros, ones, below = (np.array([getattr(r, c) for r in rows], float) for c in ("zeros", "ones", "weighted"))
    out = []
    for d in range(CUT - 1, -1, -1):
        key, inverse = np.unique((context << 8 | node).astype(U64), return_inverse=True)
        zeros, ones, below = (np.bincount(inverse, x, len(key)) for x in (zeros, ones, below))
        kt = log_kt(zeros, ones)
        below = np.logaddexp(kt, below) + np.log(0.5)
        out.insert(0, (key, np.exp(np.minimum(np.log(0.5) + kt - below, 0)), (ones + 0.5) / (zeros + ones + 1)))
        context, node = (key >> U64(16)).astype(np.int64), (key & U64(255)).astype(np.int64)
    return out


def scored(docs: DataFrame, settings: Settings = Settings(depth=7, bucket_bytes=12 << 20), part_bytes: int = 4 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ctw.scored, with contexts of up to 7 bytes (at least 3) across words."""
    s, kind = settings, docs.schema[doc_id].dataType.simpleString()
    if not CUT <= s.depth <= 7:
        raise ValueError("depth must be from 3 to 7")
    view = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % s.folds == s.held_out, F.lit(False))
    view = view.withColumn("held_out", held)
    size, train_docs = view.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.when(~F.col("held_out"), 1))).first()
    buckets, parts = max(1, -(-size // s.bucket_bytes)), max(1, -(-size // part_bytes))
    view = view.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))
    deal = lambda key: (wd.mix(key) % U64(parts)).astype(np.int64)

    def pieces(table):
        for batch in table.combine_chunks().to_batches():
            for part in wd.slices(batch, "text", 1 << 20):
                data, at = wd.text_bytes(part.column("text"))
                seg = wd.segments(data, at, _SPACE)
                yield part, *grams(part.column("text").to_pylist(), s.depth), wd.span_hashes(data, seg.start, seg.end, wd.byte_codes(lower=True)), seg

    def dealt(key, by):
        """Order of sorted keys by part, and where each part begins."""
        part = deal(by).astype(np.int32)
        ends = np.cumsum(np.bincount(part, minlength=parts))
        return np.argsort(part, kind="stable").astype(np.uint32 if len(part) < 1 << 32 else np.int64), np.concatenate([[0], ends])

    def counted(key, table):
        code, n, word, m = [], [], [], []
        for part, gram, row, hashes, seg in pieces(table):
            train = ~np.asarray(part.column("held_out").to_numpy(zero_copy_only=False))
            for keys, owner, to, sums in ((gram, row, code, n), (hashes, seg.doc, word, m)):
                learns = train[owner]
                (seen, times), (others, never) = _distinct(keys[learns]), _distinct(keys[~learns])
                to += seen, others
                sums += times, 0 * never
        (code, n, _), (word, m, _) = _summed(code, n, placed=False), _summed(word, m, placed=False)
        (go, ga), (wo, wa) = dealt(code, code >> U64(64 - 8 * CUT)), dealt(word, word)
        out = {"part": [], "grams": [], "n": [], "words": [], "m": []}
        for p in range(parts):
            g, w = go[ga[p] : ga[p + 1]], wo[wa[p] : wa[p + 1]]
            if len(g) or len(w):
                for c, x in zip(out, (p, pack_sorted(code[g]), pack(n[g].astype(np.uint32)), pack_sorted(word[w]), pack(m[w].astype(np.uint32)))):
                    out[c].append(x)
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(out["part"]), pa.int32()), "part": pa.array(out["part"], pa.int32())} | {c: pa.array(out[c], pa.binary()) for c in ("grams", "n", "words", "m")})

    packed = view.groupBy("bucket").applyInArrow(counted, "bucket int, part int, grams binary, n binary, words binary, m binary")
    # one row for each part: both passes over the parts read it as it lies, without another shuffle
    packed = packed.repartition(max(1, -(-parts // 4)), "part").groupBy("part").agg(F.collect_list(F.struct("bucket", "grams", "n", "words", "m")).alias("of"))
    packed = written(packed, "packed-grams")

    def merged(of, keys, counts):
        return _summed([unpack_sorted(x[keys]) for x in of], [unpack(x[counts], np.uint32) for x in of])

    def parts_of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.column("part")[i].as_py(), batch.column("of")[i].as_py()

    def roots(batches):
        """Sums for the parents of the trees' roots; and, without a context, the words' total and number."""
        for _, of in parts_of(batches):
            gram, n, _ = merged(of, "grams", "n")
            m = merged(of, "words", "m")[1]
            out = [(np.array([-1]), np.array([0]), np.array([float(m.sum())]), np.array([float((m > 0).sum())]), np.array([0.0]))]
            if (n > 0).any():
                layer = layers(gram[n > 0], n[n > 0], CUT, s.depth)[0]
                for k in range(8):
                    node = _nodes(layer.key[layer.first[k]], k)
                    up, inverse = np.unique((node >> U64(16)) << U64(8) | node & U64(255), return_inverse=True)
                    out.append(((up >> U64(8)).astype(np.int64), (up & U64(255)).astype(np.int64), *(np.bincount(inverse, x[k], len(up)) for x in (layer.zeros, layer.ones, layer.weighted))))
            columns = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), *[pa.float64()] * 3))], ["context", "node", "zeros", "ones", "weighted"])

    sums = packed.mapInArrow(roots, "context int, node int, zeros double, ones double, weighted double")
    found = sums.groupBy("context", "node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "weighted"))).collect()
    upper = _upper([r for r in found if r.context >= 0])
    tokens = sum(int(r.zeros) for r in found if r.context < 0) + train_docs
    distinct = sum(int(r.ones) for r in found if r.context < 0) + (train_docs > 0)

    def priced(batches):
        for part, of in parts_of(batches):
            gram, n, places = merged(of, "grams", "n")
            learnt, price = n > 0, np.zeros(len(gram), np.float32)
            trees = layers(gram[learnt], n[learnt], CUT, s.depth) if learnt.any() else []
            if trees:
                price[learnt] = log2_learnt(learnt.sum(), upper, trees)
            price[~learnt] = log2_of(gram[~learnt], upper, trees, CUT)
            _, m, words = merged(of, "words", "m")
            for x, at, w in zip(of, places, words):
                yield pa.RecordBatch.from_arrays([pa.array([x["bucket"]], pa.int32()), pa.array([part], pa.int32()), pa.array([pack(price[at])], pa.binary()), pa.array([pack(m[w].astype(np.uint64))], pa.binary())], ["bucket", "part", "log2", "m"])

    prices = packed.mapInArrow(priced, "bucket int, part int, log2 binary, m binary")
    base = lambda n: np.log10((n + 0.5) / (tokens + 0.5 * (distinct + 1)))

    def document_scores(key, texts, prices_):
        code, word = [], []
        for _, gram, _, hashes, _ in pieces(texts):
            _add(code, _distinct(gram)[0])
            _add(word, _distinct(hashes)[0])
        code, word = _union(code), _union(word)
        (go, ga), (wo, wa) = dealt(code, code >> U64(64 - 8 * CUT)), dealt(word, word)
        log2, known = np.zeros(len(code), np.float32), np.zeros(len(word), np.int64)  # prices come as such floats
        for p, x, m in ((prices_[c][i].as_py() for c in ("part", "log2", "m")) for i in range(prices_.num_rows)):
            log2[go[ga[p] : ga[p + 1]]] = unpack(x, np.float32)
            known[wo[wa[p] : wa[p + 1]]] = unpack(m, U64)
        out = []
        for part, gram, row, hashes, seg in pieces(texts):  # once more, so that no piece's grams are kept
            rows = part.num_rows
            g, place = np.unique(gram, return_inverse=True)
            total = lambda owner, x: np.bincount(owner, x, rows)  # noqa: B023, E731
            n = known[np.searchsorted(word, hashes)]
            price = log2[np.searchsorted(code, g)][place]
            bits, n_bytes = total(row, price), np.bincount(row, minlength=rows)
            made = {"held_out": part.column("held_out"), "n_tokens": np.bincount(seg.doc, minlength=rows) + 1, "n_known": (total(seg.doc, n > 0) + (train_docs > 0)).astype(np.int64), "train_tokens": np.full(rows, tokens), "base_score": total(seg.doc, base(n)) + base(train_docs), "score": bits * np.log10(2), "n_bytes": n_bytes, "bits_per_byte": -bits / n_bytes}
            out.append(pa.table({"doc_id": part.column("doc_id")} | made))
        return pa.concat_tables(out)

    return view.groupBy("bucket").cogroup(prices.groupBy("bucket")).applyInArrow(document_scores, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")
