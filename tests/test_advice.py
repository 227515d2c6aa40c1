"""Whole definitions of indicators, attributions, samples and intervals, against plain versions."""

import inspect
import random
import statistics
from collections import Counter, defaultdict

import pytest

from vigil.functions import stats
from vigil.operators import indicators as ind
from vigil.operators import anomaly, sampling
from vigil.plans import catalogue


def plain_ns06(rows, surge=1.5):
    by_day = defaultdict(dict)
    for e, d, x in rows:
        by_day[d][e] = x
    out = {}
    for e in {r[0] for r in rows}:
        gaps = []
        for d, values in by_day.items():
            peers = [x for k, x in values.items() if k != e]
            prior = [x for p, v in by_day.items() if p < d for k, x in v.items() if k != e]
            base, mean = statistics.median(prior or peers), sum(peers) / len(peers)
            if len(peers) >= 3 and mean >= max(1.0, surge * base) and values[e] <= max(0.0, 0.5 * base):
                gaps.append((mean - values[e]) / max(mean, 1.0))
        if gaps:
            out[e] = (round(sum(gaps) / len(gaps), 9), len(gaps))
    return out


def daily(spark, rows):
    return spark.createDataFrame(rows, "entity_id long, day long, activity long")


def test_ns06_finds_a_surge_of_all_peers(spark):
    rows = [(e, d, 30 if d == 5 else 10) for e in range(30) for d in range(6)] + [(99, d, 5 if d == 5 else 10) for d in range(6)]
    got = {r.entity_id: (r.value, r.n) for r in ind.ns06_prior(daily(spark, rows)).collect()}
    assert got == {99: (25 / 30, 1)}


def test_ns06_equals_plain(spark):
    rnd = random.Random(3)
    rows = [(e, d, rnd.choice([0, 1, 2, 3, 8, 20]) * (3 if d % 4 == 3 and e % 5 else 1)) for e in range(12) for d in range(14)]
    got = {r.entity_id: (round(r.value, 9), r.n) for r in ind.ns06_prior(daily(spark, rows)).collect()}
    assert got and got == plain_ns06(rows)


def test_peer_deviations_equal_pairs(spark):
    rnd = random.Random(5)
    rows = [(g * 100 + i, g, float(rnd.randrange(6))) for g, n in enumerate((1, 2, 3, 8, 9, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "entity_id long, cohort long, value double")
    got = {r.entity_id: (r.median, r.mad) for r in stats.peer_deviations(df, ["cohort"]).collect()}
    want = {}
    for e, g, _ in rows:
        peers = [x for k, h, x in rows if h == g and k != e]
        if peers:
            m = statistics.median(peers)
            want[e] = (m, statistics.median(abs(x - m) for x in peers))
    assert got == want


def test_attributions_see_the_last_component(spark, tmp_path):
    rows = [(i, i % 2, [float((i * 7 + j * 3) % 5) + (500.0 if i == 4 and j == 63 else 0.0) for j in range(64)]) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [r.feature for r in catalogue.QUERIES["all_feature_attributions"](spark, str(tmp_path)).filter("entity_id = 4").collect()]
    assert len(got) == 5 and "f63" in got


SF = "/root/testdata/sf0.001"


def test_samples_are_capped_and_disjoint(spark):
    population, targeted, controls = catalogue.samples(spark, SF, n=80, n_controls=40, per_analyst=2)
    t, c = targeted.collect(), controls.collect()
    assert t and max(Counter(r.analyst for r in t if r.analyst is not None).values()) <= 2 and all(r.risk > 0 for r in t)
    assert not {(r.entity_id, r.case_id) for r in t} & {(r.entity_id, r.case_id) for r in c}
    assert len(c) == 40 and sum(1 / r.pi for r in c) == pytest.approx(population.count() - len(t))
    assert all(n == take for (_, take), n in Counter((r.stratum, r["take"]) for r in c).items())


def test_unknown_severities_stay_in_the_frame(spark):
    cases = spark.createDataFrame([("e", str(i), s) for i, s in enumerate(["HIGH", None, "ODD", "LOW"])], "entity_id string, case_id string, severity string")
    got = {(r.case_id, r.stratum) for r in sampling.complement(cases, cases.filter("case_id = '3'"), ["HIGH", "LOW"]).collect()}
    assert got == {("0", "HIGH"), ("1", "UNKNOWN"), ("2", "UNKNOWN")}


def test_estimate_by_hand(spark):
    targeted = spark.createDataFrame([(0.5, 1.0), (1.0, 1.0)], "pi double, y double")
    chosen = spark.createDataFrame([("A", 2, 10, 0.2, 1.0), ("A", 2, 10, 0.2, 0.0), ("B", 1, 4, 0.25, 1.0)], "stratum string, take long, n_stratum long, pi double, y double")
    r = sampling.estimate(targeted, chosen, spark.range(100)).first()
    half = 1.959964 * (2 + 100 * 0.8 * 0.5 / 2 + 12) ** 0.5 / 100
    assert (r.n_sampled, r.n_population, r.prevalence) == (5, 100, 0.12)
    assert (r.low, r.high) == (pytest.approx(max(0, 0.12 - half), abs=1e-6), pytest.approx(0.12 + half, abs=1e-6))


def test_evidence_counts_lead_back_to_the_values(spark):
    n = {(r.indicator, r.entity_id): r.n_rows for r in catalogue.QUERIES["evidence_hashes"](spark, SF).collect()}
    assert {k for k, _ in n} == {"eg01", "eg02", "eg06", "eg08", "eg09", "eg11"}
    values = catalogue.indicator_values(spark, SF)
    assert all(n[("eg01", r.entity_id)] == r.n for r in values["eg01"].collect())
    for k in ("eg02", "eg06", "eg08"):
        assert all(n.get((k, r.entity_id), 0) == pytest.approx(r.value * r.n) for r in values[k].collect())


def test_intervals_hold_the_point_rank(spark):
    # equal scores all have rank 1, but their draws spread
    df = spark.createDataFrame([(i, 1.0) for i in range(40)], "entity_id long, score double")
    assert all(r.low == 1 and r.high >= 1 for r in anomaly.rank_intervals(df).collect())


def test_defaults_are_those_of_the_survey():
    signature = lambda f: {k: p.default for k, p in inspect.signature(f).parameters.items()}
    assert (signature(anomaly.isolation)["trees"], signature(anomaly.isolation)["sample"]) == (100, 256)
    assert signature(anomaly.rank_intervals)["draws"] == 400
