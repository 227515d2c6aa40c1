"""Isolation scores without the target: against a plain version with other draws, planted outliers, blocks, odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from vigil.operators import anomaly

SCHEMA = "cohort string, entity_id long, a double, b double"


def plain_score(target, peers, rng, trees=300, sample=256):
    """The definition: random cuts of peers drawn anew for each tree until the target is alone."""
    n = min(sample, len(peers))
    c = lambda k: 2 * (np.log(k - 1) + 0.5772156649) - 2 * (k - 1) / k if k > 2 else max(k - 1, 0)
    depths = []
    for _ in range(trees):
        inside, depth = rng.sample(peers, n), 0
        while depth < int(np.ceil(np.log2(n))) + 1:
            spans = [(k, min(p[k] for p in inside), max(p[k] for p in inside)) for k in range(2)] if inside else []
            spans = [s for s in spans if s[2] > s[1]]
            if not spans:
                break
            k, low, high = rng.choice(spans)
            cut = rng.uniform(low, high)
            inside = [p for p in inside if (p[k] < cut) == (target[k] < cut)]
            depth += 1
        depths.append(depth + c(len(inside)))
    return 2 ** (-np.mean(depths) / c(n))


def cohort(name, n, seed, first=0):
    rng = random.Random(seed)
    return [(name, first + i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(n)]


def scores(df):
    return {r.entity_id: r for r in df.collect()}


def test_scores_agree_with_the_definition(spark):
    rows = [*cohort("small", 40, 1), ("small", 900, 8.0, -8.0), *cohort("large", 700, 2, 1000), ("large", 1900, 9.0, 9.0)]
    got = scores(anomaly.isolation(spark.createDataFrame(rows, SCHEMA).repartition(3), ["a", "b"], trees=60))
    assert len(got) == len(rows)
    rng = random.Random(5)
    for name, some in (("small", [900, 0, 1, 2, 3]), ("large", [1900, 1000, 1001, 1002, 1003])):
        at = {r[1]: r[2:] for r in rows if r[0] == name}
        for i in some:
            want = plain_score(at[i], [p for k, p in at.items() if k != i], rng)
            assert abs(got[i].score - want) < 0.06, (name, i)
        assert max(at, key=lambda k: got[k].score) == some[0] and got[some[0]].score > 0.6
        assert all(got[i].confidence == 1 for i in at)


def test_blocks_and_partitions_do_not_change_scores(spark):
    rows = spark.createDataFrame(cohort("x", 400, 3), SCHEMA)
    one = scores(anomaly.isolation(rows.repartition(1), ["a", "b"], trees=5))
    assert scores(anomaly.isolation(rows.repartition(6), ["a", "b"], trees=5, block=50)) == one
    assert scores(anomaly.isolation(rows, ["a", "b"], trees=5, seed=7)) != one


def test_a_target_does_not_see_itself(spark):
    """A lone outlier's score is the same whether its own coordinates lie at 10 or at 1,000: no cut knows them."""
    base = cohort("x", 60, 4)
    far = [scores(anomaly.isolation(spark.createDataFrame([*base, ("x", 77, v, v)], SCHEMA), ["a", "b"], trees=20))[77].score for v in (10.0, 1000.0)]
    assert far[0] == far[1]


def test_odd_rows(spark):
    """Equal, repeated and missing rows, thin cohorts, infinite features; an empty table."""
    rows = [("x", i, 1.0, 2.0) for i in range(4)] + [("x", 3, 1.0, 2.0), ("x", 8, None, 1.0), ("x", 9, float("nan"), 1.0), ("x", 10, float("inf"), 1.0), (None, 11, 1.0, 1.0)]
    rows += [("thin", 20, 1.0, 1.0), ("thin", 21, 2.0, 1.0), ("three", -1, 1.0, 1.0), ("three", -2, 2.0, 1.0), ("three", -3, 9.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = scores(anomaly.isolation(df.withColumn("block", F.lit("x")).withColumn("tree", F.lit(1)), ["a", "b"], trees=10))
    assert sorted(got) == sorted({r[1] for r in rows})
    assert all((got[i].score, got[i].confidence) == (0, 0) for i in (8, 9, 10, 11, 20, 21))
    assert all(0 < got[i].score < 1 and got[i].confidence == 0.3 for i in range(4)) and all(got[i].confidence == 0.2 for i in (-1, -2, -3))
    assert anomaly.isolation(df.limit(0), ["a", "b"]).count() == 0
