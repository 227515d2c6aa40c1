"""Shingles that several notes of an entity hold, found before any costly hash, and their smallest hashes by note.

Notes of one MinHash bucket have the same smallest shingle under each seed, so that shingle lies in both: what only one note of
the entity holds can never be it. A cheap fingerprint of every shingle says which ones several notes hold. Each of those is hashed
once, wherever it occurs, and its hashes go back to the notes as four bits a seed; a note then hashes only what looks smallest.
Fingerprints that agree by chance add work and change no result.

Notes lie in blocks by their text and fingerprints in parts, so a task holds one block or one part at a time.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package on their path

#: Bits of a fingerprint's part, of its number there and of the unit that holds it while a task sorts them: 64 together.
_PART, _VALUE, _UNIT = 10, 32, 22
#: Characters of text that a task works on at once, and shingles whose fingerprints it sorts at once.
_PIECE, _SORTED = 1 << 20, 1 << 22

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
_ODD = np.frombuffer(hashlib.shake_256(b"words").digest(64 * 8), "<u8") | np.uint64(1)
_A, _B, _C = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


@dataclass
class Shingles:
    """The n-word shingles of several texts in order, repeats included: a cheap code of each, its first word, and the index of its
    text; letters and lengths are those of all words."""

    n: int
    letters: np.ndarray
    length: np.ndarray
    first: np.ndarray
    text: np.ndarray
    code: np.ndarray

    def bounds(self, n: int) -> np.ndarray:
        """Where the shingles of each of n texts begin, and the last ends."""
        return np.searchsorted(self.text, np.arange(n + 1))

    def bytes_at(self, at: np.ndarray) -> list[bytes]:
        """The shingles themselves, their words joined by one space."""
        ends = np.cumsum(self.length)
        if not hasattr(self, "joined"):
            data = np.full(len(self.letters) + len(ends), 32, np.uint8)
            data[np.arange(len(self.letters)) + np.repeat(np.arange(len(ends)), self.length)] = self.letters
            self.joined, self.end = data.tobytes(), ends + np.arange(len(ends))
        w = self.first[at]
        return [self.joined[a:b] for a, b in zip((self.end[w] - self.length[w]).tolist(), self.end[w + self.n - 1].tolist())]


def shingles(texts: list[str], n: int) -> Shingles:
    """All n-word shingles of lower-case [a-z0-9]+ words, worked out for all texts at once."""
    low = [t.lower().encode() for t in texts]
    begins = np.cumsum([0, *(len(b) + 1 for b in low)])
    raw = np.frombuffer(b" ".join([b"", *low, b""]), np.uint8)
    inside = _IS_WORD[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, length = edges[0::2], edges[1::2] - edges[0::2]
    if len(starts) < n:
        none = np.zeros(0, np.int64)
        return Shingles(n, raw[:0], none, none, none, none.astype(np.uint64))
    letters = raw[inside]
    packed = np.cumsum(length) - length  # where each word begins among the letters alone
    within = np.arange(len(letters), dtype=np.int32) - np.repeat(packed.astype(np.int32), length)
    within &= 63
    word = _mixed(np.add.reduceat(letters * _ODD[within], packed))
    text = np.searchsorted(begins, starts, "right") - 1
    last = len(starts) - n + 1
    first = np.flatnonzero(text[:last] == text[n - 1 :])
    code = np.zeros(last, np.uint64)
    for k in range(n):
        code = code * _C + word[k : last + k]
    return Shingles(n, letters, length, first, text[first], _mixed(code[first]))


def salt(entity: str | None) -> int:
    return int.from_bytes(hashlib.blake2b(b"" if entity is None else b"=" + entity.encode(), digest_size=8).digest(), "little")


def _numbered(code: np.ndarray, salts: np.ndarray, parts: int) -> np.ndarray:
    """An entity's fingerprints: the part, then 32 bits."""
    code = _mixed(code ^ salts)
    part = ((code >> np.uint64(64 - _PART)) * np.uint64(parts)) >> np.uint64(_PART)
    return (part << np.uint64(_VALUE)) | ((code >> np.uint64(_UNIT)) & np.uint64((1 << _VALUE) - 1))


def _spans(bounds: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the shingles of the texts `of`, one after the other, and how many each has."""
    lengths = bounds[of + 1] - bounds[of]
    return np.arange(lengths.sum()) + np.repeat(bounds[of] - (np.cumsum(lengths) - lengths), lengths), lengths


def _by_part(sorted_numbers: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    at = np.searchsorted(sorted_numbers, np.arange(parts + 1, dtype=np.uint64) << np.uint64(_VALUE))
    for p in np.flatnonzero(np.diff(at)).tolist():
        yield p, (sorted_numbers[at[p] : at[p + 1]] & np.uint64((1 << _VALUE) - 1)).astype(np.uint32)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Among:
    """Which numbers are in a table of distinct sorted ones, and where; a bit for each spares most others the search."""

    def __init__(self, ordered: np.ndarray):
        self.ordered = ordered
        self.mask = (1 << max(10, (16 * len(ordered)).bit_length())) - 1
        marks = np.zeros(self.mask + 1, bool)
        marks[self._slot(ordered)] = True
        self.marks = np.packbits(marks, bitorder="little")

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.uint64) & np.uint64(self.mask)).astype(np.int64)

    def found(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of those of wanted that are there, and where each is."""
        slot = self._slot(wanted)
        hit = np.flatnonzero((self.marks[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
        at = np.searchsorted(self.ordered, wanted[hit])
        at[at == len(self.ordered)] = 0
        same = self.ordered[at] == wanted[hit] if len(self.ordered) else np.zeros(len(hit), bool)
        return hit[same], at[same]


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _batches(schema: pa.Schema, rows: Iterator[tuple], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows that hold bytes, in batches of some megabytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, bytes))
        if size >= most or len(held) >= 10_000:
            yield _batch(schema, held)
            held, size = [], 0
    if held:
        yield _batch(schema, held)


@dataclass
class Run:
    """Rows of one text: how many each entity has."""

    key: int
    mark: int
    text: str
    entities: dict[str | None, int]


@dataclass
class Gathered:
    """Some runs of a block, with what was sent to the block and stands before its texts."""

    block: int
    lists: list[dict]
    runs: list[Run]


def _gathered(batches) -> Iterator[Gathered]:
    """Blocks in pieces of bounded size, from rows sorted by block, kind (lists first) and text."""
    block, lists, runs, size = None, [], [], 0
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("block", "kind", "key", "mark", "entity", "text")]
        for i, (b, kind, key, mark, e, t) in enumerate(zip(*cols)):
            if b != block or size >= _PIECE:
                if runs:
                    yield Gathered(block, lists, runs)
                runs, size = [], 0
                if b != block:
                    block, lists = b, []
            if kind == 0:
                lists.append({c: batch.column(c)[i].as_py() for c in ("part", "codes", "content")})
                continue
            if not runs or runs[-1].text != t:
                runs.append(Run(key, mark, t, {}))
            k = runs[-1].entities.get(e, 0)
            size += len(t) + 64 if k < 2 else 0
            runs[-1].entities[e] = k + 1
    if runs:
        yield Gathered(block, lists, runs)


def _units(runs: list[Run], at_most: int) -> tuple[np.ndarray, np.ndarray]:
    """Text index and salt of each entity of each run, as often as it has the text, but not more than at_most times."""
    of, salts, known = [], [], {}
    for i, r in enumerate(runs):
        for e, k in r.entities.items():
            s = known.get(e)
            if s is None:
                s = known[e] = salt(e)
            of += repeat(i, min(k, at_most))
            salts += repeat(s, min(k, at_most))
    return np.array(of, np.int64), np.array(salts, np.uint64)


# --- the four steps: fingerprints by block, what several notes hold by part, hashes by part, smallest hashes by block ---

_SENT = "block int, part int, codes binary"


def _fingerprints(n: int, parts: int):
    schema = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("codes", pa.binary())])

    def sent(block, pieces):
        both = np.concatenate(pieces)
        both.sort()
        numbers = both >> np.uint64(_UNIT)
        again = numbers[1:] == numbers[:-1]
        for p, codes in _by_part(numbers[np.concatenate([[True], ~again])], parts):
            yield block, p, codes.tobytes()
        twice = _distinct(numbers[1:][again & (both[1:] != both[:-1])])  # in two notes here: they count as two wherever they meet
        for p, codes in _by_part(twice, parts):
            yield None, p, codes.tobytes()

    def rows(batches):
        block, pieces, size, units = None, [], 0, 0
        for g in _gathered(batches):
            if pieces and (g.block != block or size >= _SORTED or units + 2 * _PIECE // 64 >= 1 << _UNIT):
                yield from sent(block, pieces)
                pieces, size, units = [], 0, 0
            block = g.block
            s = shingles([r.text for r in g.runs], n)
            of, salts = _units(g.runs, 2)
            at, lengths = _spans(s.bounds(len(g.runs)), of)
            if len(at):
                numbers = _numbered(s.code[at], np.repeat(salts, lengths), parts)
                pieces.append((numbers << np.uint64(_UNIT)) | np.repeat(np.arange(units, units + len(of), dtype=np.uint64), lengths))
            size, units = size + len(at), units + len(of)
        if pieces:
            yield from sent(block, pieces)

    return lambda batches: _batches(schema, rows(batches))


def _several(batches):
    """Of each list of fingerprints of a part, sorted by part, those that another list has too."""
    schema = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("codes", pa.binary())])

    def ended(part, lists):
        every = np.sort(np.concatenate([np.frombuffer(c, np.uint32) for _, c in lists]))
        twice = Among(_distinct(every[1:][every[1:] == every[:-1]]))
        for block, c in lists:
            codes = np.frombuffer(c, np.uint32)
            if block is not None and len(keep := codes[twice.found(codes)[0]]):
                yield block, part, keep.tobytes()

    def rows():
        last, lists = None, []
        for batch in batches:
            for b, p, c in zip(*(batch.column(x).to_pylist() for x in ("block", "part", "codes"))):
                if p != last and lists:
                    yield from ended(last, lists)
                    lists = []
                last = p
                lists.append((b, c))
        if lists:
            yield from ended(last, lists)

    return _batches(schema, rows())


def _numbers(lists: list[dict]) -> Among:
    """The fingerprints that were sent to a block."""
    return Among(_distinct(np.concatenate([np.zeros(0, np.uint64), *((np.uint64(x["part"]) << np.uint64(_VALUE)) | np.frombuffer(x["codes"], np.uint32).astype(np.uint64) for x in lists)])))


def _asked(n: int, parts: int, most: int = 500_000):
    """The shingles of a block that several notes hold, each once, by the part of its code."""
    schema = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("codes", pa.binary()), ("content", pa.binary())])

    def sent(block, asks):
        codes = np.fromiter(asks.values(), np.uint64, len(asks))
        part = ((codes >> np.uint64(64 - _PART)) * np.uint64(parts)) >> np.uint64(_PART)
        order, texts = np.argsort(part, kind="stable"), list(asks)
        at = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        for p in np.flatnonzero(np.diff(at)).tolist():
            here = order[at[p] : at[p + 1]]
            yield block, p, codes[here].tobytes(), b"\n".join([texts[i] for i in here.tolist()])

    def rows(batches):
        block, shared, asks = None, None, {}
        for g in _gathered(batches):
            if g.block != block:
                if asks:
                    yield from sent(block, asks)
                block, asks = g.block, {}
                shared = _numbers(g.lists)
            s = shingles([r.text for r in g.runs], n)
            of, salts = _units(g.runs, 1)
            at, lengths = _spans(s.bounds(len(g.runs)), of)
            hit = at[shared.found(_numbered(s.code[at], np.repeat(salts, lengths), parts))[0]]
            asks.update(zip(s.bytes_at(hit), s.code[hit].tolist()))
            if len(asks) >= most:
                yield from sent(block, asks)
                asks = {}
        if asks:
            yield from sent(block, asks)

    return lambda batches: _batches(schema, rows(batches))


def _rough(hashes: np.ndarray) -> np.ndarray:
    """How often each 64-bit hash can be halved from the largest, up to 15: larger for smaller hashes."""
    return np.clip(1087 - (hashes.astype(np.float64).view(np.int64) >> 52), 0, 15).astype(np.uint8)


def hashes_of(found: list[bytes], prefixes: list[bytes]) -> np.ndarray:
    """The first 64 bits of SHA-256 of each found under each prefix."""
    out = []
    for p in prefixes:
        begun = hashlib.sha256(p).copy  # cheaper than to begin anew
        for s in found:
            h = begun()
            h.update(s)
            out.append(h.digest())
    return np.frombuffer(b"".join(out), ">u8")[::4].astype(np.uint64).reshape(len(prefixes), len(found)).T


def _answered(prefixes: list[bytes]):
    """Each shingle of a part is hashed once; every block that asked gets four bits a seed. Shingles whose codes agree get the
    largest, so that their notes see that it is not theirs."""
    schema = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("codes", pa.binary()), ("content", pa.binary())])

    def ended(part, asked):
        known, clash = {}, set()
        for _, codes, texts in asked:
            for c, t in zip(np.frombuffer(codes, np.uint64).tolist(), texts.split(b"\n")):
                if known.setdefault(c, t) != t:
                    clash.add(c)
        codes = np.fromiter(known, np.uint64, len(known))
        rough, found = np.empty((len(known), len(prefixes)), np.uint8), list(known.values())
        for at in range(0, len(found), 10_000):
            rough[at : at + 10_000] = _rough(hashes_of(found[at : at + 10_000], prefixes))
        order = np.argsort(codes)
        codes, rough = codes[order], rough[order]
        rough[np.isin(codes, np.array(list(clash), np.uint64))] = 15
        rough = rough[:, 0::2] << 4 | rough[:, 1::2]
        for block, c, _ in asked:
            yield block, part, c, rough[np.searchsorted(codes, np.frombuffer(c, np.uint64))].tobytes()

    def rows(batches):
        last, asked = None, []
        for batch in batches:
            for b, p, c, t in zip(*(batch.column(x).to_pylist() for x in ("block", "part", "codes", "content"))):
                if p != last and asked:
                    yield from ended(last, asked)
                    asked = []
                last = p
                asked.append((b, c, t))
        if asked:
            yield from ended(last, asked)

    return lambda batches: _batches(schema, rows(batches))


def _smallest(n: int, prefixes: list[bytes]):
    """(entity, key and mark of the text, its rows, the smallest hash under each prefix) over the shingles that were answered: all
    that another note of the entity holds, and perhaps more of the text's own."""
    schema = pa.schema([("entity", pa.string()), ("key", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("least", pa.list_(pa.int64()))])
    seeds = len(prefixes)

    def least(s, at, rough, starts):
        """For each text, whose shingles begin at starts among at: the smallest hash under each prefix."""
        lengths = np.diff([*starts, len(at)])
        k, some = np.nonzero((rough == np.repeat(np.maximum.reduceat(rough, starts), lengths, axis=0)).T)
        ends, found = np.searchsorted(k, np.arange(seeds + 1)).tolist(), s.bytes_at(at[some])
        h = np.concatenate([hashes_of(found[ends[j] : ends[j + 1]], [p])[:, 0] for j, p in enumerate(prefixes)])
        text = np.repeat(np.arange(len(starts)), lengths)[some]
        out = np.full((len(starts), seeds), np.uint64((1 << 64) - 1))
        np.minimum.at(out.reshape(-1), text * seeds + k, h)
        wrong = _rough(h) != rough[some, k]  # what was told is of another shingle with this code
        for i, j in set(zip(text[wrong].tolist(), k[wrong].tolist())):
            out[i, j] = hashes_of(s.bytes_at(at[starts[i] : starts[i] + lengths[i]]), [prefixes[j]]).min()
        return (out ^ np.uint64(1 << 63)).view(np.int64).tolist()

    def rows(batches):
        block, known, rough = None, None, None
        for g in _gathered(batches):
            if g.block != block:
                block = g.block
                codes, first = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x["codes"], np.uint64) for x in g.lists)]), return_index=True)
                known = Among(codes)
                rough = np.frombuffer(b"".join([x["content"] for x in g.lists]), np.uint8).reshape(-1, seeds // 2)[first]
            s = shingles([r.text for r in g.runs], n)
            at, where = known.found(s.code)
            runs, starts = np.unique(s.text[at], return_index=True)
            told = rough[where]
            told = np.stack([told >> 4, told & 15], axis=2).reshape(-1, seeds)
            for i, found in zip(runs.tolist(), least(s, at, told, starts) if len(at) else []):
                r = g.runs[i]
                for e, k in r.entities.items():
                    yield e, r.key, r.mark, k, found

    return lambda batches: _batches(schema, rows(batches))


def _signed(n: int, prefixes: list[list[bytes]], parts: int):
    """The signatures of the bands that a text may share. Its smallest hashes over what several notes hold are known; a band ends
    where one of the others is smaller, so that most end soon."""
    schema = pa.schema([("entity", pa.string()), ("note", pa.int64()), ("band", pa.int32()), ("signature", pa.string())])

    def signature(own, band, least):
        least = [(x + (1 << 63)).to_bytes(8, "big") for x in least]
        for p, floor in zip(prefixes[band], least):
            begun = hashlib.sha256(p).copy
            for x in own:
                h = begun()
                h.update(x)
                if h.digest() < floor:  # equal ones are longer, so not below
                    return None
        return "|".join([x.hex() for x in least])

    def rows(batches):
        block, lists, shared, last, made = None, [], None, None, {}
        for batch in batches:
            for i, (b, kind, e, note, t, bands) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "entity", "note", "text", "bands")))):
                if b != block:
                    block, lists, shared, last = b, [], None, None
                if kind == 0:
                    lists.append({c: batch.column(c)[i].as_py() for c in ("part", "codes")})
                    continue
                shared = shared or _numbers(lists)
                if t != last:
                    s, last, made = shingles([t], n), t, {}
                if e not in made:
                    own = np.ones(len(s.code), bool)
                    own[shared.found(_numbered(s.code, np.uint64(salt(e)), parts))[0]] = False
                    found = s.bytes_at(np.flatnonzero(own))
                    signed = [(x["band"], signature(found, x["band"], x["least"])) for x in bands]
                    made = {e: [x for x in signed if x[1]]}
                for band, x in made[e]:
                    yield e, note, band, x

    return lambda batches: _batches(schema, rows(batches))


def those_of(rows: DataFrame, wanted: DataFrame, keys: list[str], kept: Callable | None, most: int = 1 << 20) -> DataFrame:
    """The rows whose keys are among those of wanted, no row twice. Where wanted can be written first and has at most so many rows, it
    goes to all tasks, so that the other rows are not shuffled; the result is the same."""
    wanted = wanted.select(keys).distinct()
    if kept:
        wanted = kept(wanted)
        wanted = F.broadcast(wanted) if wanted.count() <= most else wanted
    return rows.join(wanted, keys, "left_semi")


def shared_bands(notes: DataFrame, n: int, seeds: int, per_band: int, tasks: int, kept: Callable | None = None) -> DataFrame:
    """(entity, note, text) -> (entity, note, band, signature), see trends.shared_bands. kept writes a table and reads it again; with it
    the fingerprints are counted once, and only the texts that may share a bucket are shuffled for the last step."""
    each = [b"%d:" % k for k in range(seeds + seeds % 2)]  # in pairs of four bits
    prefixes = [each[b : min(b + per_band, seeds)] for b in range(0, seeds, per_band)]
    parts = min(tasks, 1 << _PART)
    view = notes.filter("text is not null").withColumns({"key": F.xxhash64("text"), "mark": F.xxhash64(F.lit(1), "text")})
    texts = view.withColumns({"block": F.pmod("key", F.lit(tasks)).cast("int"), "kind": F.lit(1)})

    def by_block(rows: DataFrame, sent: DataFrame | None = None) -> DataFrame:
        """What was sent to a block, then its texts, equal ones side by side."""
        if sent is not None:
            rows = sent.withColumn("kind", F.lit(0)).unionByName(rows, allowMissingColumns=True)
        return rows.repartitionById(tasks, "block").sortWithinPartitions("block", "kind", "key", "text")

    def by_part(sent: DataFrame) -> DataFrame:
        return sent.repartitionById(parts, "part").sortWithinPartitions("part")

    plain = texts.drop("note")
    several = by_part(by_block(plain).mapInArrow(_fingerprints(n, parts), _SENT)).mapInArrow(_several, _SENT)
    several = kept(several) if kept else several
    asked = by_block(plain, several.withColumn("content", F.lit(None).cast("binary"))).mapInArrow(_asked(n, parts), f"{_SENT}, content binary")
    answered = by_part(asked).mapInArrow(_answered(each), f"{_SENT}, content binary")
    least = by_block(plain, answered).mapInArrow(_smallest(n, each), "entity string, key long, mark long, n long, least array<long>")

    bands = F.array(*(F.struct(F.lit(b).alias("band"), F.slice("least", b * per_band + 1, len(p)).alias("least")) for b, p in enumerate(prefixes)))
    some = least.select("entity", "key", "mark", "n", F.inline(bands))
    agree = some.withColumn("n", F.sum("n").over(Window.partitionBy("entity", "band", "least"))).filter("n > 1")
    wanted = agree.groupBy("entity", "key", "mark").agg(F.sort_array(F.collect_set(F.struct("band", "least"))).alias("bands"))
    wanted = kept(wanted) if kept else wanted
    texts = those_of(texts, wanted, ["key", "mark"], kept) if kept else texts
    wanted = wanted.withColumnsRenamed({"entity": "_e", "key": "_k", "mark": "_m"})
    candidates = texts.join(wanted, (F.col("key") == F.col("_k")) & (F.col("mark") == F.col("_m")) & F.col("entity").eqNullSafe(F.col("_e"))).drop("_e", "_k", "_m")
    return by_block(candidates, several).mapInArrow(_signed(n, prefixes, parts), "entity string, note long, band int, signature string")
