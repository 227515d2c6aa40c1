"""Context-tree weighting across words against a plain version."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from vigil.llm import ctw, ctw_text, queries


def normal(text):
    return b" ".join([*(text or "").encode().lower().split(), b"\n"])


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def plain(texts, depth):
    trees = defaultdict(lambda: [0, 0])

    def walk(data):
        padded = b"\0" * (depth - 1) + b" " + data
        for i, b in enumerate(data):
            for k in range(8):
                yield padded[i : i + depth], (1 << k) | (b >> (8 - k)), (b >> (7 - k)) & 1

    for t in texts:
        for context, node, bit in walk(t):
            for d in range(depth + 1):
                trees[context[depth - d :], node][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)
    weighted, children = {}, defaultdict(float)
    for (context, node), (a, b) in sorted(trees.items(), key=lambda x: -len(x[0][0])):
        w = kt(a, b) if len(context) == depth else np.logaddexp(kt(a, b), children[context, node]) + math.log(0.5)
        weighted[context, node] = w
        if context:
            children[context[1:], node] += w

    def price(data):
        total = 0.0
        for context, node, bit in walk(data):
            p, left, last = 0.0, 1.0, 0.5
            for d in range(depth + 1):
                if (key := (context[depth - d :], node)) in trees:
                    a, b = trees[key]
                    own = math.exp(min(math.log(0.5) + kt(a, b) - weighted[key], 0))
                    last = (b + 0.5) / (a + b + 1) if bit else (a + 0.5) / (a + b + 1)
                    p, left = p + left * own * last, left * (1 - own)
            total += math.log2(p + left * last)
        return total

    return price


def check(df, depth):
    rows = df.collect()
    got = ctw_text.scored(df, ctw.Settings(depth=depth, bucket_bytes=20_000), part_bytes=10_000).collect()
    old = {(r.doc_id, r.n_bytes, round(r.base_score, 6)): r for r in ctw.scored(df).collect()}
    price = plain([normal(r.text) for r in rows if not held(r.doc_id)], depth)
    wanted = defaultdict(list)
    for r in rows:
        wanted[r.doc_id].append((len(normal(r.text)), price(normal(r.text)) * math.log10(2)))
    assert len(got) == len(rows)
    for r in got:
        assert any(r.n_bytes == n and r.score == pytest.approx(x, rel=1e-5) for n, x in wanted[r.doc_id])
        same = old[r.doc_id, r.n_bytes, round(r.base_score, 6)]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (same.held_out, same.n_tokens, same.n_known, same.train_tokens)


def test_contexts_cross_words(docs):
    check(docs.limit(12), 7)


def test_odd_and_empty(odd_docs, no_docs):
    check(odd_docs.filter("doc_id is null or doc_id not in (9, 11)"), 4)
    assert ctw_text.scored(no_docs).count() == 0


def test_registered_query_depends_on_word_order(spark, tmp_path):
    words = "the quick brown fox jumps over a lazy dog".split()
    rows = [(i, " ".join(words)) for i in range(2, 40)] + [(100, " ".join(words)), (101, " ".join(reversed(words)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    score = {r.doc_id: r.score for r in queries.op2_ctw(spark, str(tmp_path)).collect()}
    assert score[100] > score[101] + 1


def test_sets_are_joined_as_they_come():
    """The distinct keys of many pieces, without holding each piece's keys until the end."""
    rng, sets, whole = np.random.default_rng(7), [], []
    for _ in range(64):
        keys = np.unique(rng.integers(0, 1000, 900).astype(np.uint64))
        whole.append(keys)
        ctw_text._add(sets, keys)
        assert sum(map(len, sets)) <= 3000
    assert np.array_equal(ctw_text._union(sets), np.unique(np.concatenate(whole)))
