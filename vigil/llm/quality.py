"""Quality rules by distribution divergence.

Each text gives two histograms: classes of its characters, and its common words (the most frequent words of
each language, all others in one bin). They are compared with the histograms of whole languages, measured on
all documents, by Jensen-Shannon distance; the closest language counts, so a wrong language tag does no harm.
Short texts scatter widely around their language. So a distance counts only from a least length on, and the
threshold is raised by what chance adds at the text's length.

Tags name the references and nothing else: a verdict depends on the text alone. Common words are compared only with
languages whose letters the text has, by the same distance over letters. A text in a language without a reference
(too little of it in the corpus) is far from all by its letters; its characters are judged, its words are not, as foreign
references would say nothing about them. With no reference at all the base rules alone decide.

Null and empty texts: no words; they fail the length rule. Null languages are left out of the references. Of equally
common words the one of smaller hash is taken. Repeated rows are judged alike. Very long texts are judged whole, one
at a time. Columns of the input are passed on or dropped, never renamed; judging needs no language column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm import words as wd
from vigil.llm.session import written

SYMBOLS = b"#*$%&|<>"
#: Classes of characters: letters, digits, blanks, line feeds, full stops, commas, other marks, other ASCII,
#: wide characters, and each symbol by itself (table bars and noise marks differ).
N_CLASSES = 9 + len(SYMBOLS)


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    common_words: int = 60
    #: A language needs so many words in the corpus to serve as a reference.
    reference_words: int = 500
    class_min_chars: int = 300
    class_distance: float = 0.185
    word_min_words: int = 60
    word_distance: float = 0.45
    #: Words are judged against languages whose letters are as near as this.
    letter_distance: float = 0.16
    #: What chance adds to a distance: this times the square root of (bins in use / sample size).
    slack: float = 0.2


def _class_of_byte() -> np.ndarray:
    """Class of each byte; bytes inside a character belong to its first byte and count for nothing."""
    table = np.full(256, 7, np.int64)
    table[97:123] = table[65:91] = 0
    table[48:58] = 1
    table[list(wd.SPACES)] = 2
    table[10], table[ord(".")], table[ord(",")] = 3, 4, 5
    table[list(b";:!?'\"()-")] = 6
    table[0x80:0xC0] = N_CLASSES
    table[0xC0:] = 8
    for i, c in enumerate(SYMBOLS):
        table[c] = 9 + i
    return table


def _no_letter() -> np.ndarray:
    table = np.ones(256, bool)
    table[97:123] = table[65:91] = table[128:] = False
    return table


#: Letters: a to z without case, and the bytes of wide characters.
N_LETTERS = 26 + 128
_LETTER = np.full(256, N_LETTERS, np.int64)
_LETTER[97:123] = _LETTER[65:91] = np.arange(26)
_LETTER[128:] = 26 + np.arange(128)

_CLASS, _NO_LETTER, _SPACE = _class_of_byte(), _no_letter(), wd.is_space()


def _histograms(data, at, bin_of: np.ndarray, bins: int) -> np.ndarray:
    """Counts by text and bin of its bytes; the bin after the last is left out."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    return np.bincount(doc * (bins + 1) + bin_of[data], minlength=n * (bins + 1)).reshape(n, bins + 1)[:, :bins]


def _classes(data, at) -> np.ndarray:
    return _histograms(data, at, _CLASS, N_CLASSES)


def _letter_words(data, at) -> tuple[np.ndarray, np.ndarray]:
    seg = wd.segments(data, at, _NO_LETTER)
    return wd.span_hashes(data, seg.start, seg.end, wd.byte_codes(lower=True)).view(np.int64), seg.doc


def _count_rows(batches):
    """Per slice and language: classes (kind 0), words (kind 1) and letters (kind 2) with their counts."""
    for batch in batches:
        for part in wd.slices(batch, "text", 1 << 20):
            data, at = wd.text_bytes(part.column("text"))
            lang, code = np.unique(np.asarray(part.column("lang").fill_null("")), return_inverse=True)
            classes, letters = np.zeros((len(lang), N_CLASSES), np.int64), np.zeros((len(lang), N_LETTERS), np.int64)
            np.add.at(classes, code, _classes(data, at))
            np.add.at(letters, code, _histograms(data, at, _LETTER, N_LETTERS))
            word, doc = _letter_words(data, at)
            for i, name in enumerate(lang):
                if name == "":
                    continue
                key, n = np.unique(word[code[doc] == i], return_counts=True)
                kind = np.repeat(np.array([0, 1, 2], np.int32), [N_CLASSES, len(key), N_LETTERS])
                keys, counts = np.concatenate([np.arange(N_CLASSES), key, np.arange(N_LETTERS)]), np.concatenate([classes[i], n, letters[i]])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(kind), pa.string()), pa.array(kind), pa.array(keys), pa.array(counts)], ["lang", "kind", "key", "n"])


@dataclass(frozen=True)
class References:
    """Histograms of languages: chars (languages x classes), words (languages x (vocabulary + 1 for the rest))."""

    vocabulary: np.ndarray
    chars: np.ndarray
    words: np.ndarray
    letters: np.ndarray


def references(docs: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> References:
    """Language references counted over all documents. Only the common words of each language reach the driver."""
    counts = (
        docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
        .mapInArrow(_count_rows, "lang string, kind int, key long, n long")
        .groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    )
    counts = written(counts, "word-counts")  # one row per language and distinct word; ranked and added up below
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "key")  # each task ranks its own and sends so many a language
    top = counts.filter("kind = 1").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= rules.common_words).drop("rank")
    rows = top.unionByName(counts.filter("kind <> 1")).collect()
    totals = {}
    for r in counts.filter("kind = 1").groupBy("lang").agg(F.sum("n").alias("n")).collect():
        totals[r.lang] = r.n
    names = sorted(k for k, n in totals.items() if n >= rules.reference_words)
    vocabulary = np.array(sorted({r.key for r in rows if r.kind == 1 and r.lang in names}), np.int64)
    chars, words, letters = np.zeros((len(names), N_CLASSES)), np.zeros((len(names), len(vocabulary) + 1)), np.zeros((len(names), N_LETTERS))
    for r in rows:
        if r.lang in names:
            i = names.index(r.lang)
            if r.kind != 1:
                (letters if r.kind else chars)[i, r.key] = r.n
            else:
                words[i, np.searchsorted(vocabulary, r.key)] = r.n
    for i, name in enumerate(names):
        words[i, -1] = totals[name] - words[i].sum()
    scale = lambda m: m / np.maximum(m.sum(axis=1, keepdims=True), 1)
    return References(vocabulary, scale(chars), scale(words), scale(letters))


def _entropy(p: np.ndarray) -> np.ndarray:
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=-1)


def distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (0 to 1) of each row of counts to each reference; 1 for empty rows."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    out = np.empty((len(counts), len(reference)))
    for j, q in enumerate(reference):
        out[:, j] = _entropy((p + q) / 2) - (_entropy(p) + _entropy(q)) / 2
    return np.where(total > 0, np.sqrt(np.clip(out, 0, 1)), 1.0)


def _measures(part: pa.RecordBatch, refs: References, rules: Rules) -> dict[str, np.ndarray]:
    """Measures of the rows of part (text)."""
    data, at = wd.text_bytes(part.column("text"))
    n = len(at) - 1
    seg = wd.segments(data, at, _SPACE)
    first = seg.per_doc(n)
    inside = ~_SPACE[data] & (_CLASS[data] != N_CLASSES)
    word = wd.span_hashes(data, seg.start, seg.end, wd.byte_codes())
    window, at_word = wd.window_hashes(word, seg.doc, 5)
    again = wd.repeated(wd.mix(window + seg.doc[at_word].astype(np.uint64) * wd._STEP)) if len(window) else np.zeros(0, bool)
    in_repeat = wd.covered(at_word[again], 5, len(word))
    breaks = np.zeros(256, bool)
    breaks[10] = True
    line = wd.segments(data, at, breaks)
    has_word = np.searchsorted(seg.start, line.end) > np.searchsorted(seg.start, line.start)
    key = wd.mix(wd.span_hashes(data, line.start, line.end, wd.byte_codes()) + line.doc.astype(np.uint64) * wd._STEP)[has_word]
    _, kept_line = np.unique(key, return_index=True)
    line_doc = line.doc[has_word]
    classes = _classes(data, at)
    lw, lw_doc = _letter_words(data, at)
    size = len(refs.vocabulary)
    spot = np.searchsorted(refs.vocabulary, lw)
    if size:
        spot = np.where(refs.vocabulary[np.minimum(spot, size - 1)] == lw, spot, size)
    common = np.bincount(lw_doc * (size + 1) + spot, minlength=n * (size + 1)).reshape(n, size + 1)
    n_words = np.diff(first)
    n_repeat = wd.sums_per_doc(in_repeat, first)
    base = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)
    n_chars, n_letter_words = classes.sum(axis=1), common.sum(axis=1)
    by_chars, by_words = np.zeros(n), np.zeros(n)
    chance = lambda bins, size: rules.slack * np.sqrt(bins / np.maximum(size, 1))
    if len(refs.chars):
        by_chars = distances(classes, refs.chars).min(axis=1)
        letters = _histograms(data, at, _LETTER, N_LETTERS)
        near = distances(letters, refs.letters) <= (rules.letter_distance + chance(N_LETTERS / 4, letters.sum(axis=1)))[:, None]
        by_words = np.where(near, distances(common, refs.words), 2.0).min(axis=1)
        by_words = np.where(near.any(axis=1), by_words, 0.0)
    odd_chars = (n_chars >= rules.class_min_chars) & (by_chars > rules.class_distance + chance(N_CLASSES / 2, n_chars))
    odd_words = (n_letter_words >= rules.word_min_words) & (by_words > rules.word_distance + chance(rules.common_words / 4, n_letter_words))
    return {
        "n_words": n_words, "word_chars": wd.sums_per_doc(inside, at),
        "n_symbols": classes[:, 9:].sum(axis=1), "n_dup_lines": np.bincount(line_doc, minlength=n) - np.bincount(line_doc[kept_line], minlength=n),
        "n_repeat_words": n_repeat, "base_failed": base, "kept": ~(base | odd_chars | odd_words), "char_distance": by_chars, "word_distance": by_words,
    }


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def measured(docs: DataFrame, refs: References, text: str = "text", doc_id: str = "doc_id", rules: Rules = Rules()) -> DataFrame:
    """One row per row of docs: its id and the measures."""

    def rows(batches):
        for batch in batches:
            for part in wd.slices(batch, "text", 1 << 20):
                m = _measures(part, refs, rules)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, m.values())], ["doc_id", *m])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(rows, f"doc_id {kind}, {MEASURES}")


def kept(docs: DataFrame, refs: References, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that pass, with all their columns; no join, so any column may be null or repeat."""
    place = docs.columns.index(text)

    def rows(batches):
        for batch in batches:
            view, done = pa.RecordBatch.from_arrays([batch.column(place).cast(pa.string())], ["text"]), 0
            for part in wd.slices(view, "text", 1 << 20):
                yield batch.slice(done, part.num_rows).filter(pa.array(_measures(part, refs, rules)["kept"]))
                done += part.num_rows

    return docs.mapInArrow(rows, docs.schema)
