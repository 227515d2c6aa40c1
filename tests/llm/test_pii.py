"""Base spans against the patterns as written, the field against sums over all label sequences."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from vigil.llm import pii

KINDS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    out = []
    for k, pattern in enumerate(KINDS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            fine = (
                True,
                k != 1 or all(int(p) <= 255 for p in m[0].split(".")),
                12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0,
                9 <= len(d) <= 15,
            )[k]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    hits = 0
    for _ in range(30_000):
        alphabet = rng.choice(["a1@.- ", "0123456789.", "12 -", "+1 ().-5", "ab@c.é9_%", "1.@+ -()\n²٣"])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain(text), text
        hits += len(plain(text))
    assert hits > 1_000


def test_base_spans_take_linear_time():
    for text in ("1" * 400_000, "a" * 400_000, "a@" * 200_000, "+1" * 200_000, "1 " * 200_000, "1.1." * 100_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(pii.labelled_table(spark))


def test_decoding_equals_the_best_of_all_sequences(field):
    rng = np.random.default_rng(1)
    some = pii.Field(field.names, rng.normal(size=field.weights.shape), rng.normal(size=field.pairs.shape) + pii._allowed())
    chains = [rng.integers(0, len(field.names), (n, pii.FEATURES)) for n in (1, 2, 3, 4, 3, 1)]
    for got, c in zip(some.decode(chains, 7), chains):
        own = some.weights[c].sum(axis=1)

        def value(y):
            return sum(own[i, b] + some.pairs[a, b] for i, (a, b) in enumerate(zip((0, *y), y))) + some.pairs[y[-1], 0]

        assert tuple(got) == max(itertools.product(range(len(pii.LABELS)), repeat=len(c)), key=value)


def test_fit_is_where_the_likelihood_is_greatest(monkeypatch):
    """Few labels, so that the sum over all sequences can be written out; the slope vanishes at the fitted weights."""
    monkeypatch.setattr(pii, "LABELS", ("O", "B-email", "I-email"))
    monkeypatch.setattr(pii, "FEATURES", 2)
    rng = np.random.default_rng(2)
    chains = [rng.integers(0, 5, (n, 2)) for n in (1, 3, 4, 2)]
    truth = [[1], [0, 1, 2], [1, 2, 0, 0], [0, 0]]
    f = pii.Field({str(i): i for i in range(5)}, np.zeros((6, 3)), pii._allowed())
    s = pii.Settings(ridge=0.5, steps=4000)
    pii._maximise(f, chains, truth, s)

    def loss(weights, pairs):
        total = -s.ridge / 2 * ((weights**2).sum() + (pairs**2).sum())
        for c, y in zip(chains, truth):
            own = weights[c].sum(axis=1)
            value = lambda z: sum(own[i, b] + pairs[a, b] for i, (a, b) in enumerate(zip((0, *z), z))) + pairs[z[-1], 0]  # noqa: B023, E731
            legal = [z for z in itertools.product(range(3), repeat=len(c)) if all(b != 2 or a in (1, 2) for a, b in zip((0, *z), z))]
            total += value(y) - np.logaddexp.reduce([value(z) for z in legal])
        return total

    pairs = np.where(np.isfinite(f.pairs), f.pairs, 0)
    best = loss(f.weights, pairs)
    for _ in range(40):
        assert loss(f.weights + rng.normal(size=f.weights.shape) * 0.05 * (np.arange(6) < 5)[:, None], pairs) <= best
        assert loss(f.weights, pairs + rng.normal(size=pairs.shape) * 0.05 * np.isfinite(f.pairs)) <= best


def test_held_out_sentences(spark, field):
    """Other digits than those it learnt from."""
    rows = pii.labelled_table(spark, 3, seed=99).collect()
    right = 0
    for r in rows:
        base = pii.base_spans(r.text)
        got = sorted(base + field.added([r.text], [base], 64)[0])
        right += ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in got) == r.spans
    assert right >= 0.95 * len(rows)
    clean = "In 2024 we had 35 cases, version 2.0.1 at 10:30, it costs 1,200.50; see page 12 of 300. The point is at the end."
    assert field.added([clean], [[]], 64) == [[]]
    said = "Please write to hans.meier (at) beispiel (punkt) de or call (030) 555-0199 today."
    assert [said[a:b] for a, _, b in field.added([said], [[]], 64)[0]] == ["hans.meier (at) beispiel (punkt) de", "(030) 555-0199"]


def test_odd_and_empty(spark, field, odd_docs, no_docs):
    rows = pii.found(odd_docs, field).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(rows) == odd_docs.count() and all(r.base_sha256 == nothing for r in rows if r.doc_id in (4, 5, 6, 11))
    assert pii.found(no_docs, field).count() == 0
    more = [(1, "a@b.c " * 20_000), (1, "a@b.c " * 20_000), (2, "é +49 30 1234567 x"), (None, "1 " * 30_000), (3, "7" * 100_000)]
    df = spark.createDataFrame(more, "doc_id long, text string").withColumnsRenamed({})
    got = {r.doc_id: r for r in pii.found(df, field).collect()}
    assert got[1].n_email == 20_000 and got[2].spans == "phone:2:16" and got[2].n_phone == 1 and got[3].spans == ""
    bare = {r.doc_id: r for r in pii.found(df, None).collect()}
    assert bare[2].spans == "phone:2:16" and pii.fit(spark.createDataFrame([], "text string, spans string")) is None
