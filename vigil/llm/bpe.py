"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

A chain of tokens is the BPE encoding of its bytes exactly if BPE leaves every two neighbours as they are. So
an encoder may read left to right, nondeterministically: an open reading is a token path that ends at some
earlier byte, and the trie node that the bytes since then have reached. A reading that completes a token whose
neighbour allows it yields the path of the next position; at each position there is one. The transducer below
determinises this: a state is the set of open readings without their common first tokens, which are emitted.
Its lookahead is bounded by the longest token. States and arcs are made when a text first needs them.

The pieces that the pattern finds are encoded separately, so results are kept by piece, up to a bound.

Null and empty texts have no tokens. Ids are passed on, null ones too, and never keyed by, so repeated rows and ids are encoded each.
Very long texts are encoded whole, one at a time. Empty tables give no rows. Other columns may have any names: encoded() passes
them on beside its own, digests() drops them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import words as wd

_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Cuts a text where the pattern of byte-level BPE always cuts it too, and keeps what lies between together.
_COARSE = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


def read_ranks(text: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in text.splitlines() if line)}


class Transducer:
    """Encodes one piece. An arc, found by (state, byte), is (next state, tokens emitted)."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 300_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}  # node * 256 + byte
        self.token_at, self.inner = [-1], [False]
        for token, i in ranks.items():
            node = 0
            for b in token:
                self.inner[node] = True
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                node = nxt
            self.token_at[node] = i
        self.allowed: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        start = ((0, -1, ()),)
        self.state_of, self.readings, self.arcs = {start: 0}, [start], {}

    def merge(self, piece: bytes) -> list[int]:
        """BPE as defined: joins the neighbours of least rank, the leftmost first, until none can join."""
        rank = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while pairs and (least := min(pairs)) < 1 << 60:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], 1 << 60)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], 1 << 60)
        return [self.ranks[p] for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        """Whether BPE keeps the two tokens apart; with left -1, whether it builds right at all."""
        if len(self.allowed) > 1_000_000:
            self.allowed.clear()
        tokens = [right] if left < 0 else [left, right]
        found = self.allowed[left << 20 | right] = self.merge(b"".join([self.bytes_of[t] for t in tokens])) == tokens
        return found

    def _arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """A reading is (trie node, last token before it, tokens not yet emitted up to its start)."""
        moved, done, child, token_at, inner, allowed = [], None, self.child, self.token_at, self.inner, self.allowed
        for node, last, path in self.readings[state]:
            nxt = child.get(node << 8 | byte)
            if nxt is None:
                continue
            if inner[nxt]:
                moved.append((nxt, last, path))
            if done is None and (token := token_at[nxt]) >= 0:
                fits = allowed.get(last << 20 | token)
                if fits if fits is not None else self._fits(last, token):
                    done = (*path, token)
        if done is None:
            raise ValueError("the vocabulary lacks a byte")
        common = len(done)
        for _, _, path in moved:
            n = 0
            for x, y in zip(path, done[:common]):
                if x != y:
                    break
                n += 1
            common = n
            if not n:
                break
        if common:
            moved = [(node, last, path[common:]) for node, last, path in moved]
        key = (*moved, (0, done[-1], done[common:]))
        to = self.state_of.get(key)
        if to is None:
            to = self.state_of[key] = len(self.readings)
            self.readings.append(key)
        arc = self.arcs[state << 8 | byte] = (to, done[:common])
        return arc

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.readings) > self.max_states:
            self._clear()
        out: list[int] = []
        state, known = 0, self.arcs.get
        for byte in piece:
            state, tokens = known(state << 8 | byte) or self._arc(state, byte)
            if tokens:
                out += tokens
        if piece:
            out += self.readings[state][-1][2]  # the reading that ends at the last byte
        return out


class _Kept(dict):
    """What a function gave for short texts. When full, what was not asked for since it was last full goes."""

    def __init__(self, function, most: int):
        self.function, self.most, self.before = function, most // 2, {}

    def __missing__(self, text: str) -> tuple[int, ...]:
        found = self.before.get(text)
        if found is None:
            found = self.function(text)
        if len(text) < 64:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[text] = found
        return found


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = 700_000):
        self.transducer, self.pattern = Transducer(ranks), regex.compile(pattern)
        self.kept = _Kept(self._stretch, kept)

    def _stretch(self, text: str) -> tuple[int, ...]:
        pieces = self.pattern.findall(text)
        if len(pieces) == 1:
            return tuple(self.transducer.encode(text.encode()))
        return tuple(chain.from_iterable(map(self.kept.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.kept.__getitem__, _COARSE.findall(text))))


def _utf8_step() -> list[list[int]]:
    """States of UTF-8 decoding: 0 between characters, 1-3 bytes missing, 4-7 after E0, ED, F0, F4; -1 is an error."""
    step = [[-1] * 256 for _ in range(8)]
    put = lambda state, low, high, to: step[state].__setitem__(slice(low, high + 1), [to] * (high - low + 1))
    put(0, 0, 0x7F, 0), put(0, 0xC2, 0xDF, 1), put(0, 0xE1, 0xEF, 2), put(0, 0xF1, 0xF3, 3)
    step[0][0xE0], step[0][0xED], step[0][0xF0], step[0][0xF4] = 4, 5, 6, 7
    put(1, 0x80, 0xBF, 0), put(2, 0x80, 0xBF, 1), put(3, 0x80, 0xBF, 2)
    put(4, 0xA0, 0xBF, 1), put(5, 0x80, 0x9F, 1), put(6, 0x90, 0xBF, 2), put(7, 0x80, 0x8F, 2)
    return step


_STEP = _utf8_step()


class Decoder:
    """Turns ids into text as they come. The automaton runs over whole tokens: how a token changes the state, and
    where its last complete character ends, is worked out once. Bytes that are not UTF-8 become U+FFFD."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.known: dict[tuple[int, int], tuple[int, int, bool]] = {}
        self.state, self.open = 0, b""
        self.tokens = self.closed = None

    def _token(self, state: int, token: int) -> tuple[int, int, bool]:
        whole, bad = 0, False
        for n, b in enumerate(self.bytes_of[token], 1):
            state = _STEP[state][b]
            if state < 0:
                bad, state = True, max(_STEP[0][b], 0)
            if state == 0:
                whole = n
        return state, whole, bad

    def feed(self, ids: Iterable[int]) -> Iterator[bytes]:
        """The bytes that are complete characters after each token; what is open waits for the next."""
        for token in ids:
            key = (self.state, token)
            found = self.known.get(key)
            if found is None:
                found = self.known[key] = self._token(*key)
            self.state, whole, _ = found
            data = self.bytes_of[token]
            if whole:
                yield self.open + data[:whole]
                self.open = data[whole:]
            else:
                self.open += data

    def finish(self) -> bytes:
        """What was still open at the end."""
        rest, self.open, self.state = self.open, b"", 0
        return rest

    def decode(self, ids: list[int]) -> bytes:
        """All at once: stretches of tokens that begin and end between characters need no look at their bytes."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        if self.tokens is None:
            self.tokens = np.empty(max(self.bytes_of) + 1, object)
            self.closed = np.zeros(len(self.tokens), bool)
            for i, data in self.bytes_of.items():
                self.tokens[i] = data
                self.closed[i] = self._token(0, i) == (0, len(data), False)
        if self.closed[ids].all():
            return b"".join(self.tokens[ids])
        out, n, i = [], len(ids), 0
        stops = np.append(np.flatnonzero(~self.closed[ids]), n)
        for stop in stops:
            if stop < i:
                continue
            out.extend(self.tokens[ids[i:stop]])
            i = int(stop)
            while i < n:  # the automaton, until it is between characters again
                out.extend(self.feed((int(ids[i]),)))
                i += 1
                if not self.state:
                    break
        return b"".join(out) + self.finish()


@lru_cache(maxsize=4)
def _worker(ranks_text: bytes, pattern: str) -> tuple[Encoder, Decoder, list[str]]:
    """One encoder for each Python worker."""
    ranks = read_ranks(ranks_text)
    return Encoder(ranks, pattern), Decoder(ranks), [str(i) for i in range(max(ranks.values()) + 1)]


def encoded(docs: DataFrame, ranks_text: bytes, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of each text in a new column (replaced if it is there); null counts as empty."""

    def rows(batches):
        encoder = _worker(ranks_text, pattern)[0]
        for batch in batches:
            for part in wd.slices(batch, "\1text"):
                ids = [encoder.encode(t or "") for t in part.column("\1text").to_pylist()]
                keep = [i for i, n in enumerate(part.schema.names) if n != "\1text"]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(ids, pa.list_(pa.int32()))], [*(part.schema.names[i] for i in keep), out])

    rest = docs.drop(out)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), f"`{out}` array<int>"])
    return rest.withColumn("\1text", F.col(text).cast("string")).mapInArrow(rows, schema)


def decoded(docs: DataFrame, ranks_text: bytes, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the text of each id list in a new column; a null list gives null, an empty one the empty text."""

    def rows(batches):
        decoder = _worker(ranks_text, pattern)[1]
        for batch in batches:
            made = [None if x is None else decoder.decode(x).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, out])

    rest = docs.drop(out)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), f"`{out}` string"])
    return rest.mapInArrow(rows, schema)


def digests(docs: DataFrame, ranks_text: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes each text, decodes the ids again and returns digests of both: one row per row of docs.

    Null and empty texts give no ids. Texts of any length run in linear time and are held one slice at a time.
    """

    def rows(batches):
        encoder, decoder, name = _worker(ranks_text, pattern)
        for batch in batches:
            for part in wd.slices(batch, "text"):
                n, a, b = [], [], []
                for t in part.column("text").to_pylist():
                    ids = encoder.encode(t or "")
                    n.append(len(ids))
                    a.append(hashlib.sha256(",".join(map(name.__getitem__, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(decoder.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(rows, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
