"""Scalar normalisation, privacy, sources, sampling and statistics on literal cases."""

import hashlib
import hmac
import statistics

from pyspark.sql import functions as F

from vigil.functions import scalars, stats
from vigil.operators import intake, privacy, sampling, scoring
from vigil.sources import files


def cells(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.v for r in df.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


def test_missing_tokens(spark):
    assert cells(spark, ["-", "N/A", "tbd", " x ", None, ""], scalars.clean) == [None, None, None, "x", None, None]


def test_timestamps(spark):
    values = ["2026-01-05T10:00:00Z", "2026-01-05 10:00:00", "2026-01-05", "1767600000", "1767600000000", "05/01/2026", "5-Jan-2026", "2026-01-01T00:00:00.1234567", "not a date", None]
    f = lambda c: F.date_format(scalars.timestamp_utc(c), "yyyy-MM-dd HH:mm:ss")
    assert cells(spark, values, f) == ["2026-01-05 10:00:00", "2026-01-05 10:00:00", "2026-01-05 00:00:00", "2026-01-05 08:00:00", "2026-01-05 08:00:00", "2026-01-05 00:00:00", "2026-01-05 00:00:00", "2026-01-01 00:00:00", None, None]
    zone = lambda c: F.date_format(scalars.timestamp_utc(c, "Asia/Kolkata"), "yyyy-MM-dd HH:mm")
    assert cells(spark, ["2026-01-05 10:00:00", "2026-01-05T10:00:00Z"], zone) == ["2026-01-05 04:30", "2026-01-05 10:00"]


def test_numbers_booleans_text(spark):
    assert cells(spark, ["1,234", "12.7", "NaN", "inf", "x"], scalars.integer)[:2] == [1234, 12]
    assert cells(spark, ["1,234", "12.7", "NaN", "inf", "x"], scalars.real) == [1234.0, 12.7, None, None, None]
    assert cells(spark, ["Y", "off", "maybe"], scalars.boolean) == [True, False, None]
    assert cells(spark, ["=SUM(A1)", "@x", "a=b"], scalars.safe_text) == ["'=SUM(A1)", "'@x", "a=b"]
    assert cells(spark, ["sev1", "P2", "Informational", "urgent"], scalars.severity) == ["CRITICAL", "HIGH", "LOW", None]


def test_hmac_equals_library(spark):
    key = b"k" * 70
    wanted = "analyst_" + hmac.new(key, b"e1|analyst|bob|r1", hashlib.sha256).hexdigest()[:32]
    assert cells(spark, [" bob ", " ", None], lambda c: privacy.pseudonym(key, "r1", F.lit("e1"), "analyst", c)) == [wanted, None, None]


def test_redaction(spark):
    df = spark.createDataFrame([("mail a@b.com from 10.0.0.1 on db.corp CVE-2024-12345",), (None,)], "t string")
    one, none = privacy.redact(df, "t").collect()
    assert one.redacted == "mail [EMAIL] from [IPV4] on [FQDN] [CVE]" and one.n_redacted == 4 and one.categories == "CVE,EMAIL,FQDN,IPV4"
    assert none.redacted is None and none.n_redacted == 0


def test_good_and_quarantined_make_all(spark):
    from vigil.plans import adapters, catalogue

    rows = catalogue.normal(spark, "/root/testdata/sf0.001")
    assert intake.accepted(rows).count() + intake.quarantined(rows).count() == adapters.table(spark, "/root/testdata/sf0.001", "orders").count()


def test_corrupt_lines_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3\n4,5,6\n")
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), ["a", "b"])
    assert [(r.a, r.b) for r in files.good(rows).collect()] == [("1", "2")] and files.corrupt(rows.cache()).count() == 2
    (tmp_path / "b.json").write_text('{"a": 1, "b": "x"}\nnot json\n')
    lines = files.read_ndjson(spark, str(tmp_path / "b.json"), ["a", "b"]).cache()
    assert files.good(lines).count() == 1 and files.corrupt(lines).count() == 1
    (tmp_path / "c.json").write_text('{"alerts": [{"a": "1", "b": "2"}, {"a": "3", "b": null}]}')
    assert files.read_json(spark, str(tmp_path / "c.json"), ["a", "b"], "alerts").count() == 2


def test_peer_baseline_leaves_one_out(spark):
    values = [7.0 * i * i % 211 + 400 for i in range(11)] + [20.0]
    df = spark.createDataFrame([(i, "c", float(v), 60, -1) for i, v in enumerate(values)], "entity_id int, cohort string, value double, n long, sign int")
    got = {r.entity_id: r for r in stats.peer_baseline(df).collect()}
    for i, v in enumerate(values):
        peers = [x for j, x in enumerate(values) if j != i]
        median = statistics.median(peers)
        assert got[i].median == median and got[i].mad == statistics.median(abs(x - median) for x in peers)
    assert max(got.values(), key=lambda r: r.effect).entity_id == 11


def test_thin_cohort_keeps_an_effect(spark):
    df = spark.createDataFrame([(i, "c", float(i), 60, 1) for i in range(4)], "entity_id int, cohort string, value double, n long, sign int")
    assert all(r.thin and r.effect is not None for r in stats.peer_baseline(df).collect())


def test_false_discovery_by_hand(spark):
    df = spark.createDataFrame([(1, "a", 3.5), (1, "b", 2.5), (1, "c", 0.1), (2, "a", 1.0)], "entity_id int, indicator string, effect double")
    got = {(r.entity_id, r.indicator): r.survives for r in scoring.false_discovery(df).collect()}
    assert got == {(1, "a"): True, (1, "b"): True, (1, "c"): False, (2, "a"): False}


def test_proportional_sampling(spark):
    """Against the plain walk along cumulated risk, for several sizes."""
    risk = {f"k{i}": (i * 37) % 23 for i in range(40)}
    df = spark.createDataFrame([("e", k, f"a{int(k[1:]) % 4}", r) for k, r in risk.items()], "entity_id string, case_id string, analyst string, risk long")
    order, whole = sorted((k for k in risk if risk[k]), key=lambda k: (-risk[k], k)), sum(risk.values())
    for n, seed in ((3, "a"), (9, "b"), (9, "c")):
        wanted, at, start = set(), 0, sampling.seeded_start(seed)
        for k in order:
            if any(at <= (j + start) * whole / n < at + risk[k] for j in range(n)):
                wanted.add(k)
            at += risk[k]
        for parts in (1, 7):
            rows = sampling.proportional(df.repartition(parts), n, seed).collect()
            assert {r.case_id for r in rows} == wanted and all(abs(r.pi - min(1, n * r.risk / whole)) < 1e-12 for r in rows)
    assert sampling.capped(df, 2).count() == 8


def test_controls_follow_the_allocation(spark):
    df = spark.createDataFrame([("e", f"c{i}", "HIGH" if i % 3 else "LOW") for i in range(30)], "entity_id string, case_id string, stratum string")
    take = sampling.allocation(df.groupBy("stratum").agg(F.count("*").alias("size")), 7)
    rows = sampling.controls(df, take, "s").collect()
    assert len(rows) == 7 and sum(1 / r.pi for r in rows) == 30.0


def test_vocabularies_and_addresses(spark):
    import ipaddress

    assert cells(spark, ["re-opened", "Pending escalation", "odd", "-"], scalars.status) == ["REOPENED", "ESCALATED", None, None]
    assert cells(spark, ["Explicit", "INFERRED", "guess"], lambda c: scalars.enum(c, scalars.LINK_TYPES)) == ["explicit", "inferred", None]
    assert cells(spark, ["resolve", "re-open", "Owner changed"], scalars.event_type) == [None, "reopened", "assigned"]
    texts = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "::", "::1", "1::", "1::2::3", "fe80::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", ":::", "g::1", "2001:db8::8:800:200c:417a", ":1", "1:", "abc", ""]

    def valid(t):
        try:
            ipaddress.ip_address(t)
            return True
        except ValueError:
            return False

    assert cells(spark, texts, scalars.is_ip) == [valid(t) for t in texts]


def test_mapping_stops_without_required_columns(spark):
    import pytest

    df = spark.createDataFrame([("1", " HIGH ")], "ref string, sev string")
    rows, warnings = intake.apply_mapping(df, {"case_id": "ref", "severity": "sev", "owner": "gone"}, ["case_id", "severity", "owner"], ["case_id"])
    assert rows.collect() == [("1", "HIGH", None)] and warnings == ["owner: no column gone"]
    with pytest.raises(ValueError, match="owner"):
        intake.apply_mapping(df, {"case_id": "ref"}, ["case_id", "owner"], ["owner"])


def test_segments_split_again(spark):
    from vigil.operators import trends

    values = [0.2, 0.21, 0.2, 0.22] + [0.6, 0.61, 0.6, 0.59] + [0.9, 0.91, 0.9, 0.92]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)] + [("flat", i, 0.5) for i in range(9)] + [("short", i, float(i)) for i in range(5)], "series string, period int, value double")
    got = sorted((r.series, r.period, r.direction) for r in trends.segments(df).collect())
    assert got == [("s", 4, "up"), ("s", 8, "up")]


def test_normal_p(spark):
    from vigil.operators import trends

    df = spark.createDataFrame([(0.0,), (1.959964,), (-3.0,)], "z double")
    assert [round(r.p, 4) for r in df.select(trends.normal_p("z").alias("p")).collect()] == [1.0, 0.05, 0.0027]
