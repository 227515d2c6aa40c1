"""Indicators against declarations, and masked evidence, against plain versions with odd rows."""

import hashlib
import random
from collections import Counter, defaultdict
from datetime import date, timedelta

import pytest

from vigil.operators import declared as d
from vigil.operators import injection

DAY0 = date(1970, 1, 1)


def by_entity(df):
    return {r.entity_id: r for r in df.collect()}


# --- EG-03 ---

HOURS = [(1, 0, 540, 1080), (1, 0, 600, 1200), (1, 4, 1320, 360), (1, 6, 0, 0), (2, 3, 0, 1440), (2, None, 0, 60), (3, 1, 480, 480)]


def open_minutes(hours, entity):
    """All minutes of a week that are declared, one by one."""
    out = set()
    for e, wd, a, b in hours:
        if e == entity and wd is not None:
            length = b - a if b > a else b - a + 1440
            out |= {(wd * 1440 + a + i) % 10_080 for i in range(length)}
    return out


def test_off_coverage_equals_minutes(spark):
    rng = random.Random(3)
    closures = [(e, rng.randrange(20_000 * 86_400, 20_040 * 86_400)) for e in (1, 2, 3, 4, None) for _ in range(120)] + [(1, None), (1, 20_001 * 86_400)] * 2
    free = [DAY0 + timedelta(days=20_003), DAY0 + timedelta(days=20_010), DAY0 + timedelta(days=20_010), None]
    for offset in (0, 330):
        out = d.off_coverage(
            spark.createDataFrame(closures, "entity_id long, closed_s long").repartition(3), spark.createDataFrame(HOURS, "entity_id long, weekday int, from_min int, to_min int"),
            spark.createDataFrame([(x,) for x in free], "date date"), offset,
        )
        got = by_entity(out)
        assert set(got) == {1, 2, 3, 4, None}
        for e in (1, 2, 3):
            opened = open_minutes(HOURS, e)
            local = [(s + offset * 60) for x, s in closures if x == e and s is not None]
            inside = lambda day, minute, opened=opened: DAY0 + timedelta(days=day) not in free and (DAY0 + timedelta(days=day)).weekday() * 1440 + minute in opened
            off = [s for s in local if not inside(s // 86_400, s % 86_400 // 60)]
            span = range(min(local) // 86_400, max(local) // 86_400 + 1)
            in_min = sum(inside(day, m) for day in span for m in range(1440))
            hours = Counter(s % 86_400 // 3600 for s in off)
            r = got[e]
            assert (r.n, r.n_off, r.n_holiday) == (len(local), len(off), sum(DAY0 + timedelta(days=s // 86_400) in free for s in local))
            assert r.value == pytest.approx(len(off) / len(local)) and r.band == (min(hours, key=lambda h: (-hours[h], h)) if off else None)
            n_in, out_min = len(local) - len(off), len(span) * 1440 - in_min
            assert r.density is None if n_in * out_min == 0 else r.density == pytest.approx(len(off) / out_min / (n_in / in_min))
        assert all(got[e].value is None and got[e].n == 120 for e in (4, None))
    empty = d.off_coverage(spark.createDataFrame([], "entity_id long, closed_s long"), spark.createDataFrame([], "entity_id long, weekday int, from_min int, to_min int"), spark.createDataFrame([], "date date"))
    assert empty.count() == 0


# --- EG-14 ---


def test_declared_figures_equal_a_plain_comparison(spark):
    declared = [(1, "a", 100.0), (1, "b", 94.0), (1, "c", 5.0), (1, "d", None), (2, "a", 0.0), (2, "b", 3.0), (2, "z", 1.0), (3, "z", 1.0), (None, "a", 2.0), (4, "a", float("nan")), (5, "a", 105.0), (5, "a", 106.0), (6, "a", -110.0)]
    real = [(1, "a", 104.0), (1, "b", 100.0), (1, "c", 5.0), (1, "d", 1.0), (2, "a", 0.0), (2, "b", 0.0), (None, "a", 2.0), (4, "a", 1.0), (5, "a", 100.0), (6, "a", -100.0), (7, "a", 1.0)]
    got = by_entity(d.declared_kpis(spark.createDataFrame(declared, "entity_id long, kpi string, declared double"), spark.createDataFrame(real, "entity_id long, kpi string, value double")))
    want = {1: (3, 1, 1, "b", -0.06), 2: (2, 1, 1, "b", 1.0), 3: (0, 0, 1, None, None), None: (1, 0, 0, "a", 0.0), 4: (0, 0, 1, None, None), 5: (2, 1, 0, "a", 0.06), 6: (1, 1, 0, "a", -0.1)}
    assert set(got) == set(want)  # the seventh declares nothing
    for e, (n, over, lost, worst, far) in want.items():
        r = got[e]
        assert (r.n, r.n_beyond, r.n_unmatched, r.worst) == (n, over, lost, worst) and r.value == (over / n if n else None)
        assert r.deviation is None if far is None else r.deviation == pytest.approx(far)


def test_case_figures(spark):
    schema = "entity_id long, created_s long, closed_s long, severity string, disposition string, escalation_level int"
    rows = [(1, 0, 10, "HIGH", "FALSE_POSITIVE", 2), (1, 5, 2, "LOW", None, None), (1, 0, None, None, "FALSE_POSITIVE", None), (2, 0, None, "CRITICAL", None, None)]
    got = {(r.entity_id, r.kpi): r.value for r in d.case_kpis(spark.createDataFrame(rows, schema)).collect()}
    assert [got[1, k] for k in ("n_cases", "n_severe", "closed_share", "escalation_share", "false_positive_share", "mean_duration_s")] == pytest.approx([3, 1, 2 / 3, 1 / 3, 0.5, 10])
    assert (got[2, "n_severe"], got[2, "false_positive_share"], got[2, "mean_duration_s"]) == (1, None, None)


# --- EG-10 ---


def test_monoculture_equals_counting(spark):
    rng = random.Random(8)
    rows = []
    for e in range(8):
        for _ in range(50):
            cluster = "t0" if rng.random() < e / 8 else rng.choice(["t1", "t2", None, f"own{rng.random()}"])
            rows.append((e, cluster, rng.choice([1, 2, 3, None]), rng.choice(["HIGH", "CRITICAL", "LOW", None]), e == 7 and cluster == "t0"))
    rows += [(20, None, None, None, None), (21, "x", 1, "LOW", True), (21, "x", 1, "LOW", None), (22, "b", 1, "LOW", False), (22, "b", 2, "HIGH", False), (22, "a", 1, "LOW", False), (22, "a", 1, "LOW", False)]
    got = by_entity(d.monoculture(spark.createDataFrame(rows, "entity_id long, cluster string, analyst long, severity string, legitimate boolean").repartition(4)))
    for e in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == e]
        groups = defaultdict(list)
        for r in mine:
            groups[r[1]].append(r)
        real = {k: v for k, v in groups.items() if k is not None and len(v) > 1 and not all(r[4] for r in v)}
        r = got[e]
        squares = sum(len(v) ** 2 if k is not None else len(v) for k, v in groups.items())
        assert r.n == len(mine) and r["index"] == pytest.approx(squares / len(mine) ** 2)
        if not real:
            assert (r.value, r.cluster, r.raised) == (0, None, False)
            continue
        top = min(real, key=lambda k: (-len(real[k]), k))
        assert r.cluster == top and r.value == pytest.approx(len(real[top]) / len(mine)) and r.raised == (2 * len(real[top]) >= len(mine))
        assert r.n_analysts == len({x[2] for x in real[top]} - {None}) and r.severe_share == pytest.approx(sum(x[3] in ("HIGH", "CRITICAL") for x in real[top]) / len(real[top]))
    assert any(got[e].raised for e in range(8)) and not all(got[e].raised for e in range(8))


def test_template_key_masks_figures(spark):
    rows = spark.createDataFrame([("Closed  INC-12 at 10:30 ",), ("closed inc-7 at 9:05",), (None,), ("",)], "text string")
    assert [r.k for r in rows.select(d.template_key(rows.text).alias("k")).collect()] == ["closed inc-# at #:#", "closed inc-# at #:#", None, ""]


# --- masked evidence ---


def test_missingness_equals_a_plain_run(spark):
    rng = random.Random(4)
    daily = [(e, 10 * e + k, rng.choice([1, 3, 4]), day, 0 if e % 5 == 0 and k == 1 and day > 8 else rng.choice([0, 0, 1, 5])) for e in range(20) for k in range(3) for day in range(20)]
    daily += [(50, 500, 4, day, None) for day in range(20)] + [(51, 510, 4, 1, 0)]
    truth = {0, 5, 10, 15, 50}
    df = spark.createDataFrame(daily, "entity_id long, asset_id long, criticality int, day int, activity long")
    planted = spark.createDataFrame([(e,) for e in truth], "entity_id long")
    levels = (0.0, 0.1, 0.5, 0.95)
    got = {r.level: r for r in injection.missingness(df.repartition(3), planted, ["entity_id", "asset_id", "day"], levels).collect()}
    for level in levels:
        known = defaultdict(lambda: defaultdict(list))
        for e, asset, critical, day, n in daily:
            share = int(hashlib.sha256(f"{e}:{asset}:{day}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
            known[e][asset] += [(n, critical)] if n is not None and share >= level else []
        counts = Counter()
        for e, assets in known.items():
            if sum(map(len, assets.values())) < 3:
                counts["na"] += 1
                continue
            found = any(v and max(c for _, c in v) >= 3 and sum(n == 0 for n, _ in v) >= max(3, len(v) // 2) and sum(n for n, _ in v) > 0 for v in assets.values())
            counts[{(True, True): "tp", (True, False): "fp", (False, True): "fn", (False, False): "tn"}[found, e in truth]] += 1
        r = got[level]
        assert (r.n_entities, r.n_not_assessable, r.tp, r.fp, r.fn) == (22, counts["na"], counts["tp"], counts["fp"], counts["fn"])
        assert r.assessable_rate == pytest.approx(1 - counts["na"] / 22)
        assert (r.precision, r.recall) == (counts["tp"] / (counts["tp"] + counts["fp"]) if counts["tp"] + counts["fp"] else None, counts["tp"] / (counts["tp"] + counts["fn"]) if counts["tp"] + counts["fn"] else None)
    assert got[0.0].tp > 0 and got[0.95].n_not_assessable > got[0.0].n_not_assessable
    masked = injection.masked(df, "activity", ["entity_id", "asset_id", "day"], levels).groupBy("level").count().collect()
    assert {r["count"] for r in masked} == {len(daily)}  # masking drops no row
