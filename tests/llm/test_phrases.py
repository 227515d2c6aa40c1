"""Phrases against a count of every gram of every piece."""

import random
import re
from collections import Counter

import pytest

from vigil.llm import phrases

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, s):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(w)
            counts.update((lang or "und", tuple(w[i : i + k])) for k in range(1, s.longest + 1) for i in range(len(w) - k + 1))
    often = {x: n for x, n in counts.items() if n >= s.min_count}
    out = {}
    for (lang, p), a in often.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if len(p) > 1 and not any(m == lang and len(q) > len(p) and n >= a and inside(q) for (m, q), n in often.items()):
            cuts = [(1000 * a * total[lang] // (often[lang, p[:k]] * often[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), often[lang, p[:k]], often[lang, p[k:]], total[lang]))
    return {(lang, i + 1, x[2].decode(), -x[1], *x[3:], -x[0]) for lang, found in out.items() for i, x in enumerate(sorted(found)[: s.best])}


def check(df, s):
    got = [tuple(r) for r in phrases.collocations(df, s).collect()]
    assert len(got) == len(set(got)) and set(got) == plain([(r.text, r.lang) for r in df.select("text", "lang").collect()], s)
    return got


@pytest.mark.parametrize("slots", [1 << 16, 8, 1])
def test_equals_brute_force(spark, slots, monkeypatch):
    rng = random.Random(slots)
    words = ["a", "B", "b", "é", "the", "The", "of", "x\x85y", "漢字", "😀"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "! ", "\r\n"]
    texts = ["".join(rng.choice(words[: rng.randint(2, 10)]) + rng.choice(ends) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    df = spark.createDataFrame([(t, rng.choice(["en", "de", None, "und"])) for t in texts], "text string, lang string").repartition(3)
    if slots < 1 << 16:  # a table that pairs share changes only what is sent
        whole = phrases._pair_slots
        monkeypatch.setattr(phrases, "_pair_slots", lambda view, n, s: whole(view, n, s) | 255 if slots == 1 else whole(view, n, s))
    for least, best in ((3, 2000), (8, 5), (1, 7)):
        assert check(df, phrases.Settings(min_count=least, best=best))


def test_few_slots_give_the_same(spark, docs):
    small = docs.limit(40)
    s = phrases.Settings(min_count=4, most_slots=1 << 16, bytes_per_slot=1e9)
    assert sorted(map(tuple, phrases.collocations(small, s).collect())) == sorted(check(small, phrases.Settings(min_count=4)))


def test_odd_and_empty(spark, odd_docs, no_docs):
    assert {r[0] for r in check(odd_docs, phrases.Settings(min_count=2))} >= {"en", "de"}
    assert check(odd_docs, phrases.Settings(min_count=10**9)) == []
    assert phrases.collocations(no_docs).count() == 0
    bare = spark.createDataFrame([(None, None), ("", "en"), (" ,.\n", "en")], "text string, lang string")
    assert phrases.collocations(bare, phrases.Settings(min_count=1)).count() == 0


def test_counts_past_64_bits(spark):
    df = spark.createDataFrame([("a b " * 200_000, "en")], "text string, lang string")
    check(df, phrases.Settings(min_count=100))
