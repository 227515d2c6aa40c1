"""The indicators over histories, and expectations, against plain versions and planted cases."""

import random
from collections import Counter, defaultdict
from fractions import Fraction
from math import comb, exp, inf, lgamma, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.functions import tails
from vigil.operators import behaviour as b
from vigil.operators import expectation as x


def by_entity(df):
    return {r.entity_id: r for r in df.collect()}


# --- tails ---


def test_tails_equal_sums():
    for n, p in ((1, 0.5), (10, 0.3), (50, 1 / 60), (200, 0.9)):
        for k in range(0, n + 2, 3):
            want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
            assert tails.binomial_upper(k, n, p) == pytest.approx(want, abs=1e-12)
    for mean, size in ((3.0, 2.0), (10.0, 0.5), (0.1, 9.0)):
        total = 0.0
        for k in range(60):
            total += exp(lgamma(k + size) - lgamma(size) - lgamma(k + 1) + size * log(size / (size + mean)) + k * log(mean / (size + mean)))
            assert tails.negative_binomial_lower(k, mean, size) == pytest.approx(total, abs=1e-12)
    assert tails.negative_binomial_lower(2, 1.5, inf) == pytest.approx(exp(-1.5) * (1 + 1.5 + 1.125)) and tails.negative_binomial_lower(0, 0.0, 1.0) == 1


def test_beta_binomial_limits_are_exact():
    """With whole parameters the law is a ratio of binomials (Polya's urn): exact fractions."""
    for n, a, c in ((5, 1, 1), (12, 2, 7), (40, 3, 5)):
        total = Fraction(0)
        for k in range(n + 1):
            total += Fraction(comb(a + k - 1, k) * comb(c + n - k - 1, n - k), comb(a + c + n - 1, n))
            assert tails.beta_binomial_lower(k, n, float(a), float(c)) == pytest.approx(float(total), abs=1e-12)


# --- EG-13 ---


def plain_conformance(rows, cohort, limit=0.05):
    pairs = {(b.START, "NEW"), *((p, q) for p, after in b.STATE_MACHINE.items() for q in after)}
    moves, unstated = defaultdict(list), Counter()
    last = {}
    for e, c, _, _, state in sorted(rows, key=lambda r: (r[3] is None, r[3] or 0, r[2])):
        unstated[e] += state is None
    for e, c, no, ts, state in sorted((r for r in rows if r[3] is not None and r[4] is not None), key=lambda r: (r[3], r[2])):
        before = last.get((e, c), b.START)
        last[e, c] = state
        if before != state:
            moves[e, c].append((before, state))
    out = {}
    for e in {k[0] for k in moves}:
        mine = [m for (f, _), m in moves.items() if f == e]
        peers = Counter(s for (f, _), m in moves.items() if f != e and cohort[f] == cohort[e] for s in m)
        left = Counter()
        for (p, _), n in peers.items():
            left[p] += n
        judged = [s for m in mine for s in m if left[s[0]]]
        off = sum(peers[s] < limit * left[s[0]] for s in judged) / len(judged) if judged else None
        wrong = [sum(s not in pairs for s in m) for m in mine]
        out[e] = (sum(w > 0 for w in wrong) / len(wrong), len(wrong), sum(map(len, mine)), sum(wrong), off, unstated[e])
    return out


def test_conformance_with_a_hot_case(spark):
    """One case has a third of all events, which span partitions; out of order, repeated and missing states."""
    rng = random.Random(3)
    path = ["NEW", "OPEN", "IN_PROGRESS", "ESCALATED", "RESOLVED", "CLOSED", "REOPENED"]
    rows = []
    for case in range(120):
        states = [s for s in path if rng.random() < 0.85]
        if rng.random() < 0.2:
            rng.shuffle(states)
        rows += [(case % 8, case, i, rng.choice([i, i, 7 - i, None]), rng.choice([s, s, s, None])) for i, s in enumerate(states)]
    rows += [(9, 1000, i, i // 3, rng.choice(path)) for i in range(350)]
    df = spark.createDataFrame(rows, "entity_id long, case_id long, event_no long, ts long, state string")
    cohort = {e: e % 2 for e in range(10)}
    got = by_entity(b.conformance(df, spark.createDataFrame(list(cohort.items()), "entity_id long, cohort long")))
    want = plain_conformance(rows, cohort)
    assert set(got) == set(want)
    for e, w in want.items():
        r = got[e]
        assert (r.value, r.n, r.n_steps, r.n_wrong, r.off_path, r.n_unstated) == pytest.approx(w)
    assert b.conformance(df.limit(0), df.limit(0).select("entity_id", F.lit(1).alias("cohort"))).count() == 0


# --- EG-05, EG-12, EG-04 ---


def test_recurrence_with_a_hot_rule(spark):
    rng = random.Random(8)
    day = 86_400
    rows = [(1, rng.choice("abc"), rng.randint(0, 3), rng.randint(0, 60 * day), rng.random() < 0.1) for _ in range(300)]
    rows += [(2, "hot", 0, rng.randint(0, 90) * day, rng.random() < 0.02) for _ in range(900)] + [(2, None, 0, 5, None), (2, "x", 1, None, True)]
    df = spark.createDataFrame(rows, "entity_id long, rule string, asset long, ts long, remedied boolean").repartition(4)
    want = defaultdict(lambda: [0, 0, 0, 0])
    groups = defaultdict(list)
    for e, rule, asset, ts, fixed in rows:
        if ts is not None:
            groups[e, rule, asset].append((ts, bool(fixed)))
    for (e, _, _), found in groups.items():
        bursts = most = 0
        for t in {t for t, _ in found}:
            inside = [f for s, f in found if t - 14 * day <= s <= t]
            most, bursts = max(most, len(inside)), bursts + (len(inside) >= 5 and not any(inside))
        w = want[e]
        want[e] = [w[0] + (bursts > 0), w[1] + 1, w[2] + bursts, max(w[3], most)]
    got = by_entity(b.recurrence(df))
    assert {e: (r.value, r.n, r.n_bursts, r.most) for e, r in got.items()} == {e: (w[0] / w[1], *w[1:]) for e, w in want.items()}


def test_throughput_is_the_densest_hour(spark):
    rng = random.Random(9)
    rows = [(e, rng.choice([1, 2, None]), rng.choice(["human", "human", "automation", "unknown", None]), rng.randint(0, 40_000)) for e in (1, 2) for _ in range(150)]
    rows += [(3, 7, "automation", i) for i in range(50)] + [(4, 7, "human", 10 * i) for i in range(7)] + [(5, 7, "human", 3600 * i) for i in range(9)]
    got = by_entity(b.throughput(spark.createDataFrame(rows, "entity_id long, actor long, actor_type string, ts long")))
    people = defaultdict(list)
    for e, actor, kind, ts in rows:
        if kind == "human" and actor is not None:
            people[e, actor].append(ts)
    most = {k: max(sum(t - 3600 < s <= t for s in v) for t in v) for k, v in people.items()}
    for e in {e for e, _ in most}:
        own = [m for (f, _), m in most.items() if f == e]
        assert (got[e].value, got[e].n, got[e].most) == (sum(m > 6 for m in own) / len(own), len(own), max(own))
    assert 3 not in got and got[4].value == 1 and got[5].most == 1


def test_changes_are_documented_by_the_note_before(spark):
    rows = [
        (1, 1, 1, 100, "note_added", None, None), (1, 1, 2, 100, "severity_changed", 3, 1),  # same second: documented
        (1, 2, 1, 100, "severity_changed", 3, 1), (1, 2, 2, 101, "note_added", None, None),  # note too late
        (1, 3, 1, 0, "note_added", None, None), (1, 3, 2, 86_401, "severity_changed", 2, 1),  # note too old
        (1, 3, 3, 86_402, "severity_changed", 1, 3), (1, 4, 1, None, "severity_changed", 3, 1), (1, 5, 1, 5, "severity_changed", None, 1),
        (2, None, 1, 7, "note_added", None, None), (2, None, 2, 9, "severity_changed", 2, 1),
    ]
    got = by_entity(b.undocumented_changes(spark.createDataFrame(rows, "entity_id long, case_id long, event_no long, ts long, event_type string, from_rank int, to_rank int")))
    assert (got[1].value, got[1].n, got[1].n_bare) == (pytest.approx(2 / 3), 3, 1) and (got[2].value, got[2].n) == (0, 1)


# --- EG-07 ---


def test_funnel_widens_for_small_entities(spark):
    """A large entity far below its peers is beyond the limit, a small one at the same rate is not."""
    rng = np.random.default_rng(1)
    rates = rng.beta(20, 80, 40)
    rows = [(i, "c", int(n), int(rng.binomial(n, p))) for i, (n, p) in enumerate(zip(rng.integers(20, 400, 40), rates))]
    rows += [(100, "c", 600, 18), (101, "c", 10, 0), (102, "alone", 50, 0), (103, "c", 0, 0), (104, "two", 9, 9), (105, "two", 9, 9)]
    got = by_entity(b.escalation_limits(spark.createDataFrame(rows, "entity_id long, cohort string, n long, escalated long")))
    assert got[100].value > 0.5 and got[101].value == 0 and 102 not in got and 103 not in got and got[104].value == 0
    peers = [(n, k) for i, c, n, k in rows if c == "c" and i != 100 and n]
    big, mean = sum(n for n, _ in peers), sum(k for _, k in peers) / sum(n for n, _ in peers)
    between = sum(n * (k / n - mean) ** 2 for n, k in peers)
    spread = (between - (len(peers) - 1) * mean * (1 - mean)) / (big - sum(n * n for n, _ in peers) / big - (len(peers) - 1))
    assert got[100].mean == pytest.approx(mean) and got[100].spread == pytest.approx(spread) and 0.0005 < spread < 0.003
    size = mean * (1 - mean) / spread - 1
    assert got[100].chance == pytest.approx(tails.beta_binomial_lower(18, 600, mean * size, (1 - mean) * size))


# --- EG-15, EG-16, EG-17 ---


def test_bunching_is_found_and_flat_days_are_quiet(spark):
    rng = random.Random(2)
    flat = [(1, rng.randrange(86_400 * 30)) for _ in range(8000)]
    sloped = [(2, 86_400 * rng.randrange(30) + int(86_400 * rng.random() ** 0.7)) for _ in range(8000)]
    bunched = [(3, rng.randrange(86_400 * 30)) for _ in range(8000)] + [(3, 50_400 - rng.randrange(1800)) for _ in range(400)]
    got = by_entity(b.boundary_bunching(spark.createDataFrame(flat + sloped + bunched + [(4, None), (5, 3600 * 10)], "entity_id long, ts long"), [360, 840, 1320]))
    assert abs(got[1].value) < 0.15 and abs(got[1].z) < 4 and abs(got[2].value) < 0.2 and got[3].value > 0.3 and got[3].z > 8 and 4 not in got
    bins, weights = b.boundary_weights()
    for shape in (lambda t: 1.0, lambda t: 3 - t, lambda t: 2 + t * t):  # a polynomial of the fitted degree is met exactly
        inside = [i for i in bins if -2 <= i < 2]
        assert sum(w * shape(i + 0.5) for i, w in zip(bins, weights)) == pytest.approx(sum(shape(i + 0.5) for i in inside))
        assert all(w == 0 for i, w in zip(bins, weights) if i in inside)


def test_fabricated_times_are_found(spark):
    rng = random.Random(6)
    real = [(1, 0, rng.randrange(10**7)) for _ in range(3000)]
    whole_minutes = [(2, 0, 60 * rng.randrange(10**5)) for _ in range(3000)]
    few_real, few_made = [(3, 0, rng.randrange(10**7)) for _ in range(20)], [(4, 0, 60 * rng.randrange(10**5)) for _ in range(12)]
    early = [(5, t + (10 if i % 4 == 0 else -10), t) for i, t in enumerate(rng.sample(range(10**7), 400))]
    batch = [(6, 0, 77_777)] * 30 + [(6, 0, rng.randrange(10**7)) for _ in range(70)] + [(6, None, None)]
    got = by_entity(b.timestamp_forensics(spark.createDataFrame(real + whole_minutes + few_real + few_made + early + batch, "entity_id long, created_s long, closed_s long")))
    assert got[1].value == 0 and got[2].value == 1 and got[2].seconds_chance < 1e-6 and got[2].minutes_chance > 0.01
    assert got[3].value == 0 and got[4].value == 1
    most = max(Counter(t % 60 for _, _, t in few_real).values())
    assert got[3].seconds_chance == pytest.approx(min(1, 60 * tails.binomial_upper(most, 20, 1 / 60)))
    assert got[5].n_impossible == 100 and got[5].value >= 0.25 and got[6].n_batched == 30 and got[6].value >= 0.3


def test_missing_ids(spark):
    rng = random.Random(1)
    have = sorted(rng.sample(range(-50, 400), 300))
    first = [(1, i) for i in have] + [(2, 5), (2, 5), (2, None), (None, 1), (None, 4)]
    second = [(1, i) for i in have if i % 7] + [(2, 5), (3, 9)]
    frame = lambda rows: spark.createDataFrame(rows, "entity_id long, id long").repartition(3)
    runs = [tuple(r) for r in b.id_gaps(frame(first)).collect()]
    missing = sorted(i for e, a, z, n in runs if e == 1 for i in range(a, z + 1))
    assert missing == sorted(set(range(have[0], have[-1] + 1)) - set(have)) and all(n == z - a + 1 for _, a, z, n in runs)
    assert [r for r in runs if r[0] is None] == [(None, 2, 3, 2)]
    got = by_entity(b.id_completeness(frame(first), frame(second)))
    assert got[1].n_deleted == sum(i % 7 == 0 for i in have) and got[2].value == 0 and got[2].n_deleted == 0 and got[3].n_deleted is None


# --- expectations ---


def test_covariates_equal_refitting_without_the_entity(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(140):
        a, c = rng.normal(50, 9), rng.normal(1e6, 3)
        rows.append((i, "big" if i < 120 else "small" if i < 124 else None, float(3 + 2 * a - 0.5 * c + rng.normal()), float(a), float(c)))
    rows += [(200, "big", None, 1.0, 2.0), (201, "big", 5.0, None, 2.0), (202, "big", float("nan"), 1.0, 1.0), (203, "flat", 1.0, 2.0, 3.0)]
    rows += [(300 + i, "flat", float(i), 2.0, float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "entity_id long, cohort string, value double, a double, c double")
    got = by_entity(x.covariate_model(df, ["a", "c"], ["cohort"]))
    assert len(got) == len(rows) and got[130].n_peers == 15
    for i, g, y, a, c in rows[:120] + rows[124:140]:
        peers = [(r[3], r[4], r[2]) for r in rows[:140] if r[1] == g and r[0] != i]
        design = np.array([[1, p - 50, q - 1e6] for p, q, _ in peers])
        beta = np.linalg.lstsq(design, np.array([v for _, _, v in peers]), rcond=None)[0]
        assert got[i].expected == pytest.approx(float(beta @ [1, a - 50, c - 1e6]), rel=1e-6)
        assert got[i].residual == pytest.approx(y - got[i].expected)
    assert all(got[i].expected is None for i in (120, 200, 201, 202, 203, 305))
    whole = by_entity(x.covariate_model(df.filter("entity_id < 140"), ["a", "c"]))
    assert whole[0].n_peers == 139 and x.covariate_model(df.limit(0), ["a"], ["cohort"]).count() == 0


def test_planted_silence_is_found_and_quiet_assets_are_not(spark):
    """Rates differ fivefold within a class; one busy asset falls silent, one quiet asset is just quiet."""
    rng = np.random.default_rng(11)
    rows = []
    for asset in range(60):
        rate = rng.gamma(1.5, 2.0)
        rate = 6.0 if asset == 7 else 0.05 if asset == 8 else rate
        for day in range(60):
            n = int(rng.poisson(rate))
            rows.append((asset % 3, asset, "server", 4, day, 0 if asset == 7 and day >= 52 else n))
    rows += [(0, 99, "lonely", 4, d, 0) for d in range(60)] + [(1, 77, "server", 4, d, 0) for d in range(60)]
    df = spark.createDataFrame(rows, "entity_id long, asset_id long, asset_class string, criticality int, d int, activity long").withColumn("day", F.expr("date_add(date'2024-01-01', d)")).drop("d")
    got = {r.asset_id: r for r in x.silent_assets(df).collect()}
    assert got[7].raised and str(got[7].silent_since) == "2024-02-22" and got[7].run == 8 and got[7].chance < 1e-6
    assert not got[8].raised and got[8].chance > 0.02 and got[99].chance is None and not got[99].raised
    assert [a for a, r in got.items() if r.raised] in ([7], [7, 77])  # an asset that was never heard is judged by its class
    others = {a: sum(r[5] for r in rows if r[1] == a) for a in {r[1] for r in rows if r[2] == "server"} - {7}}
    rate = sum(others.values()) / (60 * len(others))
    v = sum((t - 60 * rate) ** 2 for t in others.values())
    v = (v - rate * 60 * len(others)) / (3600 * len(others))
    k, total = rate * rate / v, sum(r[5] for r in rows if r[1] == 7)
    assert got[7].rate == pytest.approx(rate) and got[7].size == pytest.approx(k)
    assert got[7].chance == pytest.approx(((k / rate + 52) / (k / rate + 60)) ** (k + total))


def test_survivors_equal_benjamini_hochberg(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, rng.random() ** 4, 0.01])) for i in range(200)]
    got = {r.i for r in x.surviving(spark.createDataFrame(rows, "k long, i long, p double"), ["k"], "p", ["i"], 0.1).collect() if r.survives}
    want = set()
    for key in (1, 2):
        mine = sorted((p, i) for k, i, p in rows if k == key and p is not None)
        last = max((j for j, (p, _) in enumerate(mine, 1) if p <= 0.1 * j / len(mine)), default=0)
        want |= {i for p, i in mine if last and p <= mine[last - 1][0]}
    assert {i for i in got if rows[i][0] is not None} == want and want


def test_absent_categories_must_last(spark):
    rng = np.random.default_rng(4)
    rows = []
    for e in range(12):
        for c in "abc":
            for t in range(6):
                n = int(rng.negative_binomial(8, 8 / (8 + 20)))
                rows.append((e, 0, c, t, 0 if (e == 3 and c == "b" and t >= 3) or (e == 4 and c == "c" and t == 5) or (e == 5 and c == "a" and t == 2) else n))
    got = {(r.entity_id, r.category): r for r in x.silent_categories(spark.createDataFrame(rows, "entity_id long, cohort long, category string, period int, activity long")).collect()}
    assert got[3, "b"].raised and got[3, "b"].run == 3 and not got[4, "c"].raised and got[4, "c"].run == 1 and not got[5, "a"].raised and got[5, "a"].n_low >= 1
    assert sum(r.raised for r in got.values()) <= 2
