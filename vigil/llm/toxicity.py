"""Toxicity by a weighted finite-state pattern grammar.

Each part of the grammar is a transducer over the words of a clause: negation (in scope for three words), reported speech
(from a verb of saying on, or inside quotes), a target just before, a stated intent, and, read from the right, a target
just behind. They are composed lazily: a state of the composition is a tuple of their states, made and numbered when a
clause first reaches it, and says what holds at the next word. Insults and threats are emitted with these marks. An
insult's arc weighs the log odds of its lexicon entry; a threat is a pattern: its verb alone weighs 0.5, a stated intent and a
target 1 each, both together 3. A clause's weight is the sum along its path, so several weak matches in one clause speak
together, and all clauses count.

Weights come from labelled documents: the insult lexicon holds words and word beginnings by their share in toxic
documents, shrunk towards the base rate. What a kind of match (its marks) is worth, and what a text's length takes away, as
chance matches grow with it, is a ridge logistic regression over the logarithms of the kinds' sums, pulled towards given
values. For a labelled document its own label is taken out of the lexicon's counts first. The lexicon has no limit of
its own; the bound on labelled rows bounds it.

Null and empty texts score as texts without a match. Null ids never train and are not held out. Null labels are
left out; where a document has several, the highest counts. Repeated rows score alike. Very long texts are read
whole, a few at a time. Empty tables give no rows; without labels nothing is rejected. Other columns may have any
names and are passed on or dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import words as wd

# Small word classes of the four languages.
TARGETS = "you your yours yourself he him his she her they them their these those du dich dir dein deine ihr euch sie er tu te toi ton ta tes vous votre vos il elle ils elles usted ustedes ti tus su sus ellos ellas él ella".split()
NEGATIONS = "not no never none neither nor without isn aren wasn don doesn didn nicht kein keine nie niemals ohne pas jamais aucun sans nunca jamás ningún sin".split()
REPORTS = "said says say wrote writes called calls quoted told claimed reported sagt sagte schrieb nannte behauptete dit disait écrit appelé dice dijo escribió llamó".split()
THREATS = "kill hurt destroy beat shoot stab burn murder töten umbringen schlagen verletzen vernichten tuer frapper détruire brûler mourir matar golpear destruir quemar morir".split()
INTENTS = "will ll gonna going shall must should want werde werden wollen muss sollte vais veux dois devrait voy quiero debe debería".split()

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;|\n]|[\"“”«»]")
BREAK, OTHER, TARGET, NEGATE, REPORT, QUOTE, INTENT = range(7)
_CLASS = {**dict.fromkeys(".!?;|\n", BREAK), **dict.fromkeys("\"“”«»", QUOTE), **dict.fromkeys(INTENTS, INTENT), **dict.fromkeys(TARGETS, TARGET), **dict.fromkeys(NEGATIONS, NEGATE), **dict.fromkeys(REPORTS, REPORT)}
KINDS = ("insult", "insult at a target", "insult negated", "insult reported", "threat", "threat at a target", "threat negated", "threat reported")
#: Intercept, kinds, and the logarithm of the text's words.
PRIOR = np.array([-1.5, 3.0, 3.2, 2.4, 2.4, 2.0, 2.6, 0.5, 0.5, -0.7])
THREAT = {(False, False): 0.5, (True, False): 1.5, (False, True): 1.5, (True, True): 3.0}


@dataclass(frozen=True)
class Settings:
    #: Labelled rows that train at most; those of the smallest hashes are taken.
    labelled_rows: int = 40_000
    min_toxic: int = 3
    prefixes: tuple[int, ...] = (4, 5, 6, 7, 8)
    shrink: float = 2.0
    ridge: float = 0.5
    reject: float = 0.7


@dataclass(frozen=True)
class Transducer:
    """A state and how a class of word moves it; what the state says of the next word."""

    start: Hashable
    step: Callable[[Hashable, int], Hashable]
    says: Callable[[Hashable], bool]


def _within(kind: int, words: int) -> Transducer:
    """Says whether a word of that class was among the last so many."""
    return Transducer(0, lambda left, c: words if c == kind else max(0, left - 1), lambda left: left > 0)


NEGATION = _within(NEGATE, 3)
TARGET_BEFORE = _within(TARGET, 4)
TARGET_BEHIND = _within(TARGET, 3)
INTENTION = _within(INTENT, 4)
SAYING = Transducer(False, lambda on, c: on or c == REPORT, bool)
QUOTATION = Transducer(False, lambda on, c: on != (c == QUOTE), bool)


class Composition:
    """Transducers run side by side, determinised as clauses come: states are numbered tuples of theirs."""

    def __init__(self, *parts: Transducer):
        self.parts, self.number, self.states, self.arcs, self.said = parts, {}, [], {}, []
        self._state(tuple(p.start for p in parts))

    def _state(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.said.append(tuple(p.says(s) for p, s in zip(self.parts, state)))
        return self.number[state]

    def run(self, classes: Iterable[int]) -> list[tuple[bool, ...]]:
        """What each transducer says at each word."""
        state, out = 0, []
        for c in classes:
            out.append(self.said[state])
            to = self.arcs.get((state, c))
            if to is None:
                to = self.arcs[state, c] = self._state(tuple(p.step(s, c) for p, s in zip(self.parts, self.states[state])))
            state = to
        return out


_LEFT, _RIGHT = Composition(NEGATION, SAYING, QUOTATION, TARGET_BEFORE, INTENTION), Composition(TARGET_BEHIND)


def features_of(word: str, prefixes: tuple[int, ...]) -> list[str]:
    return [word, *(word[:k] + "*" for k in prefixes if len(word) > k)]


class Grammar:
    def __init__(self, lexicon: dict[str, tuple[int, int]], base_rate: float, settings: Settings):
        self.lexicon, self.rate, self.settings = lexicon, base_rate, settings
        self.kept: dict[str, tuple[int, int] | None] = {}
        self.before: dict[str, tuple[int, int] | None] = {}

    def _counts(self, word: str) -> tuple[int, int] | None:
        """Toxic and all labelled documents of the entry that speaks most clearly for this word."""
        found = [self.lexicon[f] for f in features_of(word, self.settings.prefixes) if f in self.lexicon]
        return max(found, key=lambda c: (self.weight(c), c)) if found else None

    def weight(self, counts: tuple[int, int], toxic: int | None = None) -> float:
        """Log odds of an entry, at least 0; with a label, as if that document had not been counted."""
        pos, n = counts if toxic is None else (counts[0] - toxic, counts[1] - 1)
        p = (pos + self.settings.shrink * self.rate) / (max(n, 0) + self.settings.shrink)
        return float(np.log(p / (1 - p))) if 0.5 < p < 1 else 0.0

    def hits(self, words: set[str]) -> dict[str, tuple[int, int]]:
        """Entries of the words that have one. Two generations of remembered words: frequent ones move on, rare ones go."""
        out = {}
        for w in words:
            found = self.kept.get(w, self)
            if found is self:
                found = self.before.pop(w, self)
                if found is self:
                    found = self._counts(w)
                if len(self.kept) >= 40_000:
                    self.before, self.kept = self.kept, {}
                self.kept[w] = found
            if found is not None:
                out[w] = found
        return out

    def sums(self, text: str, toxic: int | None = None) -> tuple[np.ndarray, int]:
        """For each of KINDS, the weights along the paths of all clauses, added up; and the words of the text."""
        text, out = text.lower(), np.zeros(len(KINDS))
        words = _WORD.findall(text)
        known = set(words)
        hits = self.hits(known)
        if hits or known & _THREATS:
            clause: list[str] = []
            for token in [*_TOKEN.findall(text), "."]:
                if token not in _BREAKS:
                    clause.append(token)
                    continue
                self._clause(clause, hits, toxic, out)
                clause = []
        return out, len(words)

    def vector(self, text: str, toxic: int | None = None) -> np.ndarray:
        """What the regression reads: logarithms of the sums and of the length."""
        sums, words = self.sums(text, toxic)
        return np.log1p(np.append(sums, words))

    def _clause(self, clause: list[str], hits: dict, toxic: int | None, out: np.ndarray) -> None:
        if not any(t in hits or t in _THREATS for t in clause):
            return
        classes = [_CLASS.get(t, OTHER) for t in clause]
        behind = _RIGHT.run(reversed(classes))[::-1]
        for token, (negated, said, quoted, before, intent), (after,) in zip(clause, _LEFT.run(classes), behind):
            target = before or after
            if token in hits:
                kind, weight = 0, self.weight(hits[token], toxic)
            elif token in _THREATS:
                kind, weight = 4, THREAT[intent, target]
            else:
                continue
            out[kind + (3 if said or quoted else 2 if negated else 1 if target else 0)] += weight


_THREATS, _BREAKS = set(THREATS), set(".!?;|\n")


@dataclass(frozen=True)
class Model:
    grammar: Grammar
    weights: np.ndarray

    def score(self, text: str) -> float:
        z = self.weights[0] + float(self.grammar.vector(text) @ self.weights[1:])
        return float(1 / (1 + np.exp(-z)))


def _feature_rows(settings: Settings):
    def rows(batches):
        pos, n = Counter(), Counter()

        def out():
            keys = list(n)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([n[k] for k in keys], pa.int64())], ["feature", "pos", "n"])

        parts = (part for batch in batches for part in wd.slices(batch, "text", 1 << 20))
        for part in parts:
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                found = {f for w in set(_WORD.findall((text or "").lower())) for f in features_of(w, settings.prefixes)}
                n.update(found)
                if toxic:
                    pos.update(found)
                if len(n) > 100_000:
                    yield out()
                    pos.clear(), n.clear()
        if n:
            yield out()

    return rows


def fit(docs: DataFrame, labels: DataFrame, fold: int = 1, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learns from at most settings.labelled_rows labelled documents outside the held-out fold."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(held_out("doc_id") == F.lit(False)) if fold is not None else known
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.labelled_rows)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic")
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rate = min(max(toxic / n, 0.01), 0.3) if n else 0.1
    counted = rows.mapInArrow(_feature_rows(settings), "feature string, pos long, n long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    entries = counted.filter((F.col("pos") >= settings.min_toxic) & (F.col("pos") * 2 > F.col("n"))).collect()  # a bounded sample's entries
    grammar = Grammar({r.feature: (r.pos, r.n) for r in entries}, rate, settings)

    def vectors(batches):
        parts = (part for batch in batches for part in wd.slices(batch, "text", 1 << 20))
        for batch in parts:
            found = [(grammar.vector(t or "", y), y) for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist() for x, _ in found], pa.list_(pa.float64())), pa.array([y for _, y in found], pa.int32())], ["x", "y"])

    # one row for each labelled row, so at most settings.labelled_rows; in an order that partitions do not change
    seen = sorted(rows.mapInArrow(vectors, "x array<double>, y int").groupBy("x", "y").agg(F.count("*").alias("n")).collect(), key=lambda r: (r.x, r.y))
    x = np.array([[1.0, *r.x] for r in seen]).reshape(-1, len(PRIOR))
    return Model(grammar, _logistic(x, np.array([r.y for r in seen], float), np.array([r.n for r in seen], float), settings.ridge))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float) -> np.ndarray:
    """Newton steps, halved until they improve the fit; weights of marks that the labels say little about stay near PRIOR.
    No kind of match lowers a score, and no length raises it."""

    def fit(w):
        z = x @ w
        return -(n * (np.logaddexp(0, z) - y * z)).sum() - ridge / 2 * ((w - PRIOR) ** 2).sum()

    w = PRIOR.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - ridge * (w - PRIOR)
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        while fit(w + move) < fit(w) and np.abs(move).max() > 1e-9:
            move = move / 2
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    w[1:-1], w[-1] = np.maximum(w[1:-1], 0), min(w[-1], 0)
    return w


def held_out(doc_id: str, folds: int = 3, fold: int = 1):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score and predicted."""

    def rows(batches):
        for batch in batches:
            for part in wd.slices(batch, "text", 1 << 20):
                score = [model.score(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= model.grammar.settings.reject) for s in score], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    view = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))
    return view.mapInArrow(rows, f"doc_id {kind}, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""

    def rows(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for view in wd.slices(pa.RecordBatch.from_arrays([batch.column(at).cast(pa.string())], ["text"]), "text", 1 << 20):
                keep = [model.score(t or "") < model.grammar.settings.reject for t in view.column("text").to_pylist()]
                yield batch.slice(0, len(keep)).filter(pa.array(keep, pa.bool_()))
                batch = batch.slice(len(keep))

    return docs.mapInArrow(rows, docs.schema)
