"""Counting the pieces of a unigram tokenizer without building them.

An Aho-Corasick automaton lists all vocabulary matches; dynamic programming over character positions carries the
best score and its number of pieces. Ties go as in the tokenizer: at each end the candidates come in order of
their start, and only a better score replaces an earlier one. A character that is no piece by itself may be read
as unknown, 10 below the worst score, and counts one piece for each of its bytes.

Where no piece of the vocabulary has a space mark after another character, the best path passes every such
boundary; the text falls into independent stretches there, and counts are kept by stretch.

Null and empty texts have no pieces. Ids are passed on, null ones too; repeated rows are counted each, ties always go the
same way. Very long texts are counted whole, one at a time. Empty tables give no rows; other columns may have any names and are
dropped.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import words as wd

MARK = "▁"


class Counter:
    def __init__(self, pieces: tuple[tuple[str, float], ...], kept: int = 1_000_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - 10.0
        crossing = any(MARK in p.lstrip(MARK) for p, _ in pieces)
        self.stretch = re.compile(".+" if crossing else f"{MARK}*[^{MARK}]+|{MARK}+", re.S)
        self.kept, self.most = {}, kept

    def _best(self, text: str) -> tuple[int, float]:
        score, pieces = [float("-inf")] * (len(text) + 1), [0] * (len(text) + 1)
        score[0] = 0.0
        single, unknown = self.single, self.unknown
        matches = self.automaton.iter(text)
        found = next(matches, None)
        for i, char in enumerate(text):
            end, best, n = i + 1, float("-inf"), 0
            while found is not None and found[0] == i:
                length, gain = found[1]
                if score[end - length] + gain > best:
                    best, n = score[end - length] + gain, pieces[end - length] + 1
                found = next(matches, None)
            if char not in single and score[i] + unknown > best:
                best, n = score[i] + unknown, pieces[i] + len(char.encode())
            score[end], pieces[end] = best, n
        return pieces[-1], score[-1]

    def count(self, text: str) -> tuple[int, float]:
        """Number of pieces and best score; blanks become marks, and one mark stands before the text."""
        if not text:
            return 0, 0.0
        n, total, kept = 0, 0.0, self.kept
        for stretch in self.stretch.findall(MARK + text.replace(" ", MARK)):
            found = kept.get(stretch)
            if found is None:
                found = self._best(stretch)
                if len(stretch) < 64:
                    if len(kept) >= self.most:
                        kept.clear()
                    kept[stretch] = found
            n += found[0]
            total += found[1]
        return n, total


@lru_cache(maxsize=2)
def _counter(pieces) -> Counter:
    return Counter(pieces)


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: its id, n_tokens and the best path's score. Null and empty texts have no pieces."""
    pieces = tuple(pieces)

    def rows(batches):
        counter = _counter(pieces)
        for batch in batches:
            for part in wd.slices(batch, "text"):
                found = [counter.count(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "n_tokens", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(rows, f"doc_id {kind}, n_tokens long, score double")
