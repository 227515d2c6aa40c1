"""Ranked search against scoring every document for every item."""

import math
import random
from collections import Counter

import pytest

from vigil.llm import lexical


def plain(docs, items, k=10):
    held = [(i, Counter(lexical.terms_of(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(lexical.terms_of(t))
    out = []
    for item, terms in asked.items():
        found = []
        for own, c, size in held:
            m = 25 + (75 * size * n) // total
            w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms if t in c}
            score = sum(q * w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in terms.items() if t in c)
            if score > 0:
                found.append((-score, own is None, own))
        out += [(item, r + 1, x[2], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return out


def check(docs, items, settings=lexical.Settings()):
    got = [tuple(r) for r in lexical.ranked(docs, items, settings).collect()]
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], settings.best)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


@pytest.mark.parametrize("cells, trees, block", [(6_000_000, 4096, 1 << 22), (300, 7, 40), (1, 1, 1 << 22)])
def test_equals_brute_force(spark, cells, trees, block):
    rng = random.Random(cells)
    names = ["a", "B", "b", "the", "é1", "漢", "averyverylongtermofmorethansixteenbytes", "averyverylongtermofmorethansixteenbytez", "x2", "X", "0"]

    def text(n):
        return "".join(rng.choice(names[: rng.randint(1, len(names))]) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))

    docs = [(i, text(rng.choice([0, 1, 3, 8, 50]))) for i in range(150)] + [(i, "the b x2 x2") for i in range(200, 230)] + [(999, None)]
    items = [(i, text(rng.randint(0, 6))) for i in range(12)] + [(3, "the the a"), (50, None), (51, ""), (52, "unknown"), (None, "b x")]
    rows = check(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"),
        lexical.Settings(cells=cells, docs_in_tree=trees, block_bytes=block),
    )
    assert len(rows) > 80


def test_words_of_equal_ends_are_told_apart():
    import numpy as np

    terms = lexical.Terms(["abc", "abcdefgh", "abcdefghi"])
    data = np.frombuffer(b"abc abd abcdefgh abcdefghi ab", np.uint8)
    start, end = np.array([0, 4, 8, 17, 27]), np.array([3, 7, 16, 26, 29])
    assert [x.tolist() for x in terms.found(data, start, end)] == [[0, 2, 3], [0, 1, 2]]


def test_odd_and_empty(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "word1x1 one two"), (2, "x ééé 漢字"), (3, "a" * 50_000), (4, None)], "item_id long, text string")
    assert check(odd_docs, items)
    assert lexical.ranked(no_docs, items).count() == 0
    assert lexical.ranked(odd_docs, items.limit(0)).count() == 0
    named = odd_docs.select("doc_id", "text").withColumn("doc_id", odd_docs.doc_id.cast("string"))
    assert lexical.ranked(named, items.withColumn("item_id", items.item_id.cast("string"))).count()


def test_given_tables(spark, docs):
    check(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
