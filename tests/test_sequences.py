"""Ordered work within keys against plain loops, with keys that span partitions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vigil.operators.sequences import Ordered, less_own, trailing


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data, n = [], 0
    for key, size in (("hot", 700), ("b", 3), (None, 90), ("c", 1), ("", 40)):
        for _ in range(size):
            n += 1
            data.append((key, rng.randint(0, 60), n, rng.choice([None, rng.randint(-5, 9)])))
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, t long, id long, v long").repartition(3)


def grouped(data):
    out = defaultdict(list)
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        out[r[0]].append(r)
    return out


def check(got, want):
    assert len(got) == len(want) and {r.id: r for r in got} and all(want[r.id] == tuple(r)[4:] for r in got)


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_running_numbers_and_previous(rows, parts):
    data, df = rows
    ordered = Ordered(df, ["k"], ["t", "id"], parts)
    want = {}
    for found in grouped(data).values():
        total = most = None
        for i, (_, _, own, v) in enumerate(found):
            total, most = (v if total is None else total + v, v if most is None else max(most, v)) if v is not None else (total, most)
            want[own] = (total, most)
    check(ordered.running(total=("v", "sum"), most=("v", "max")).collect(), want)
    check(ordered.numbered().collect(), {r[2]: (i + 1,) for found in grouped(data).values() for i, r in enumerate(found)})
    before = {r[2]: ((found[i - 1][3], found[i - 1][2]) if i else (None, None)) for found in grouped(data).values() for i, r in enumerate(found)}
    check(ordered.previous(last="v", last_id="id").collect(), before)


@pytest.mark.parametrize("parts", [1, 7])
def test_trailing_windows_hold_both_ends(rows, parts):
    data, df = rows
    got = {(r.k, r.t): (r.n, r.s) for r in trailing(df.withColumn("one", F.lit(1)).fillna(0, ["v"]), ["k"], "t", 5, parts, n="one", s="v").collect()}
    want = {}
    for key, found in grouped(data).items():
        for _, t, _, _ in found:
            inside = [r for r in found if t - 5 <= r[1] <= t]
            want[key, t] = (len(inside), sum(r[3] or 0 for r in inside))
    assert got == want


def test_hot_key_does_not_land_in_one_task(spark):
    """A third of a million events under one rule: no task of the ordered work holds more than a fair share."""
    df = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).alias("k"), F.col("id").alias("t"), F.lit(1).alias("one"))
    ordered = Ordered(df, ["k"], ["t"], 16)
    sizes = [r["count"] for r in ordered.placed.groupBy("_part", "k").count().filter("k = 0").collect()]
    assert max(sizes) < 2 * 300_000 / 16 and sum(sizes) == 100_000 + 200
    assert ordered.numbered().filter("k = 0").agg(F.max("seq"), F.countDistinct("seq")).first()[:] == (100_200, 100_200)


def test_less_own_and_empty_tables(spark, rows):
    data, df = rows
    got = {r.id: r.rest for r in less_own(df, ["k"], rest=F.coalesce("v", F.lit(0))).collect()}
    for found in grouped(data).values():
        whole = sum(r[3] or 0 for r in found)
        assert all(got[r[2]] == whole - (r[3] or 0) for r in found)
    none = df.limit(0)
    assert trailing(none.withColumn("one", F.lit(1)), ["k"], "t", 5, n="one").count() == 0
    assert Ordered(none, ["k"], ["t", "id"]).previous(p="v").count() == 0
