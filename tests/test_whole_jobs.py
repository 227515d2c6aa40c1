"""Queries that read all of their rows, and evidence that is joined and shuffled once."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.operators import indicators as ind
from vigil.operators import shingles, trends
from vigil.plans import adapters, assembly, behaviour, catalogue, declared, review, shared, submissions  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_chunked_features_counts_every_event(spark):
    rows = catalogue.chunked_features(spark, SF).agg(F.sum("n_alerts")).first()[0]
    assert rows == spark.read.parquet(f"{SF}/events.parquet").count()
    assert "WHERE" not in catalogue.ORACLE_SQL["chunked_features"].split("FROM events")[1].split(")")[0]


def joins_of_lines(spark, name):
    """How often a query's written tables and its result read the lines of all orders."""
    read, plain = [], adapters.table

    def counting(spark, sf_dir, table):
        read.append(table)
        return plain(spark, sf_dir, table)

    adapters.table = counting
    try:
        catalogue.QUERIES[name](spark, SF)
    finally:
        adapters.table = plain
    return read.count("lineitem")


@pytest.mark.parametrize("name, most", [("reproduced_evidence", 1), ("attached_findings", 1)])
def test_cases_are_joined_once(spark, name, most):
    """Values, evidence and findings read the year's cases as they were written."""
    assert joins_of_lines(spark, name) <= most


def test_changed_records_by_plain_count(spark):
    rows = [(1, "a", 1, "x"), (1, "a", 2, "y"), (1, "b", 1, "x"), (1, "b", 2, "x"), (1, "c", 1, None), (1, "c", 2, "x"), (2, "a", 1, "x"), (2, "a", 1, "y")]
    got = ind.eg11(spark.createDataFrame(rows, "entity_id int, record_key string, submission int, record_hash string")).collect()
    assert [(r.entity_id, round(r.value, 6), r.n, r.n_submissions, r.n_changed) for r in got] == [(1, 0.333333, 3, 2, 1)]


def test_orphans_weigh_by_alert(spark):
    alerts = spark.createDataFrame([(1, 5), (1, 5), (1, 7), (1, None), (2, 7)], "entity_id int, case_no int")
    got = ind.ns04(alerts, spark.createDataFrame([(7,), (7,)], "case_no int")).orderBy("entity_id").collect()
    assert [(r.entity_id, round(r.value, 6), r.n) for r in got] == [(1, 0.666667, 3), (2, 0.0, 1)]


def test_keys_among_are_exact(spark):
    """Bits of 64 neighbours keep just the wanted keys: far apart, negative and null ones too, and all rows past the limit."""
    keys = [0, 1, 63, 64, 65, -1, -64, -65, 2**40, 2**62, None]
    rows = spark.createDataFrame([(k, i) for k in [*keys, 2, 66, -2, 2**40 + 1] for i in range(2)], "k long, i int")
    wanted = spark.createDataFrame([(k,) for k in [*keys, 0, 64]], "w long")
    got = shared.among(rows, "k", wanted, "w", small=-1)
    assert sorted((r.k, r.i) for r in got.collect()) == sorted((k, i) for k in keys if k is not None for i in range(2))
    assert shared.among(rows, "k", wanted, "w", small=-1, most=2).count() == rows.count()
    assert shared.among(rows, "k", adapters.table(spark, SF, "orders"), "o_orderkey") is rows  # few bytes: joined without a shuffle


def test_lines_of_other_years_are_not_shuffled(spark, monkeypatch):
    """Lines meet the year's orders before the join; the cases stay the same."""
    plain = catalogue.year_cases(spark, SF)
    seen, among = [], shared.among

    def counted(rows, key, wanted, wanted_key):
        out = among(rows, key, wanted, wanted_key, small=-1)
        seen.append((rows.count(), out.count(), rows.join(wanted, rows[key] == wanted[wanted_key]).count()))
        return out

    monkeypatch.setattr(shared, "among", counted)
    cases = catalogue.year_cases(spark, SF)
    before, after, joined = seen[0]
    assert after == joined < before
    assert cases.exceptAll(plain).count() == plain.exceptAll(cases).count() == 0


def test_versions_need_one_narrow_shuffle(spark):
    """Both submissions of an order come from one scan, and only numbers are shuffled and grouped: no sort of hashes as text."""
    v = catalogue.versions(spark, SF)
    plan = ind.eg11(v)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    rows = v.groupBy("submission").count().collect()
    n = adapters.table(spark, SF, "orders").count()
    assert {(r.submission, r["count"]) for r in rows} == {(1, n), (2, n)}


def test_lines_carry_few_columns_and_keep_what_is_unknown(spark, tmp_path):
    """Lines are shuffled with six columns; lines with gaps give the cases that the plain definition gives."""
    day = lambda d: F.to_timestamp(F.lit(f"1996-{d}"))
    lines = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string, ship int"
    some = [(k, 7 * i, i % 11, n, q, d, r, s, g) for i, (k, n, q, d, r, s, g) in enumerate((k, n, q, d, r, s, g) for k in (1, 2, None) for n in (1, 2, None) for q in (None, 50.0) for d in (None, 0.08, 0.01) for r in (None, "A", "R", "N") for s in (None, "O") for g in (None, 1, 20))]
    li = spark.createDataFrame(some, lines).withColumn("l_shipdate", F.date_add(day("03-05"), F.col("ship")).cast("timestamp")).drop("ship")
    o = spark.createDataFrame([(1, 60, "1-URGENT"), (2, None, None), (2, 3, "3-MEDIUM")], "o_orderkey long, o_custkey long, o_orderpriority string").withColumn("o_orderdate", day("03-12"))
    for name, rows in (("lineitem", li), ("orders", o)):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = adapters.cases(spark, str(tmp_path), "1996-01-01", "1996-12-31")
    j = li.join(o, li.l_orderkey == o.o_orderkey).withColumn("at", F.unix_timestamp("o_orderdate"))
    early = (F.col("l_shipdate") < F.col("o_orderdate")) & (F.col("l_linenumber") == 1)
    plain = j.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("case_id"), F.col("l_suppkey").alias("entity_id"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), None).when(early, F.col("at") - 3600).otherwise(F.col("at") + adapters._duration()).alias("closed_s"),
        (F.col("o_custkey") % 50).alias("analyst"), F.when((F.col("l_quantity") > 45) & ~(F.col("l_suppkey") % 10).isin(3, 4), 2).alias("escalation_level"),
        F.when(F.expr(adapters.LATE_DISMISSALS), "FALSE_POSITIVE").when(F.col("l_returnflag") == "A", "TRUE_POSITIVE").when(F.col("l_returnflag") == "R", "FALSE_POSITIVE").otherwise("SUPPRESSED").alias("disposition"),
        ((F.col("l_discount") >= 0.08) & ~(F.col("l_suppkey") % 10).isin(3, 4)).alias("escalated"),
    )
    got_same = got.select(*plain.columns)
    assert got_same.count() == plain.count() > 0
    assert got_same.exceptAll(plain).count() == plain.exceptAll(got_same).count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = adapters.cases(spark, SF, "1996-01-01", "1996-12-31")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    carried = [line for line in plan.split("Join Inner")[1].splitlines() if "Project" in line and "l_orderkey" in line]
    assert carried and len(carried[0].split("[", 1)[1].split(", ")) <= 12 and "l_returnflag" not in carried[0].split("AS flags")[-1]


def test_small_tables_are_planned_by_their_own_size(spark):
    """Periods and lengths of notes are written, so that Spark sees how small they are and cases are not shuffled to meet them."""
    assert shared.planned(catalogue.boundaries(spark, SF)) < 1 << 20
    lengths = catalogue.notes(spark, SF)
    assert not any("documents" in f for f in lengths.inputFiles())
    assert lengths.count() == adapters.table(spark, SF, "documents").count()


def test_only_orders_that_alerts_name_are_made_distinct(spark, monkeypatch):
    seen, plain = [], ind.ns04

    def counted(alerts, known):
        seen.append((known.count(), alerts.select("case_no").distinct().count()))
        return plain(alerts, known)

    monkeypatch.setattr(ind, "ns04", counted)
    got = assembly.results(spark, SF).filter("indicator = 'ns04'").select("entity_id", "value")
    monkeypatch.undo()
    (known, named), orders = seen[0], adapters.table(spark, SF, "orders")
    assert known <= named < orders.count()
    want = plain(adapters.alerts(spark, SF), orders.select(F.col("o_orderkey").alias("case_no"))).select("entity_id", F.col("value").alias("w"))
    assert got.filter("value is not null").join(want, "entity_id").filter("value <> w").count() == 0


@pytest.mark.parametrize("name", ["why_not_flagged_by_finding", "admitted_signals", "assembled_results", "data_trust", "indicator_statuses", "scorecards", "entity_summaries"])
def test_evidence_is_counted_with_its_value(spark, monkeypatch, name):
    """Results take the number of rows behind a value from the value's own aggregate: cases are not read, joined and shuffled again for it."""

    def refused(*args, **kwargs):
        raise AssertionError("evidence rows were built again")

    monkeypatch.setattr(catalogue, "evidence", refused)
    assert catalogue.QUERIES[name](spark, SF).columns


def test_counted_evidence_is_that_of_the_rows(spark):
    """Each value's n_evidence is the number of its evidence rows: gaps, repeated keys, unknown notes and severities too."""
    some = [(f"{i % 37}-1" if i % 29 else None, i % 4 if i % 41 else None, 100, None if i % 5 == 0 else 100 + 300 * (i % 13), None if i % 3 else 60 * (i % 17) - 60, ["CRITICAL", "HIGH", "LOW", "OTHER", None][i % 5 if i % 2 else 0], ["FALSE_POSITIVE", "TRUE_POSITIVE", "SUPPRESSED", None][i % 4 if i % 3 else 0], 2 if i % 6 == 0 else None, None if i % 31 == 0 else i % 7 == 0, i % 9 - 1) for i in range(600)]
    cases = spark.createDataFrame(some, "case_id string, entity_id int, created_s long, closed_s long, declared_s long, severity string, disposition string, escalation_level int, escalated boolean, note_ref int")
    lengths = spark.createDataFrame([(0, None), (1, 3), (2, 19), (3, 20), (4, 500)], "note_ref int, note_chars int")
    periods = spark.createDataFrame([(e, 0, 2000 + 172800 * (e % 2)) for e in range(3)], "entity_id int, start_s long, boundary_s long")
    given = {"cases": cases, "lengths": lengths, "periods": periods}
    want = {(r.indicator, r.entity_id): r["count"] for r in catalogue.evidence(spark, SF, **given).groupBy("indicator", "entity_id").count().collect()}
    got = {(k, r.entity_id): r.n_evidence for k, v in catalogue.indicator_values(spark, SF, **given).items() for r in v.collect()}
    assert set(want) <= set(got) and {k for k, _ in want} == set(catalogue.VALUES)
    assert all(n == want.get(k, 0) for k, n in got.items())


def test_shared_bands_are_those_of_all_seeds(spark):
    """Every bucket of two notes or more is there with all its notes: equal and near texts, one entity or several, none, short ones."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base), " ".join(base[:-1]), " ".join(base[5:]), " ".join(base[:30] + ["x"] + base[30:]), "a b", "", None, "one two three", "One, two; three!", " ".join(reversed(base))]
    notes = spark.createDataFrame([(e, 100 * k + i, t) for k, e in enumerate(["p", "q", None]) for i, t in enumerate(texts)], "entity string, id long, text string").union(spark.createDataFrame([("solo", 1000, texts[0])], "entity string, id long, text string"))
    several = lambda b: sorted((str(r.entity), r.note, r.band, r.signature) for r in b.withColumn("n", F.count("*").over(Window.partitionBy("entity", "band", "signature"))).filter("n > 1").collect())
    every = trends.minhash_bands(notes, "entity", "id", "text")
    got = trends.shared_bands(notes, "entity", "id", "text", held=16)
    assert several(got) == several(every) != []
    assert got.count() < every.count()


def near_copies():
    """(entity, id, text): random notes, copies with a word changed, and one text many times."""
    draw = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(60):
        t = [draw.choice(words) for _ in range(draw.randint(1, 80))]
        out += [(draw.choice("pq"), " ".join(t)) for _ in range(draw.choice([1, 1, 2]))]
        if i % 3 == 0:
            t[draw.randrange(len(t))] = "X"
            out.append((draw.choice("pq"), ", ".join(t)))
    out += [(e, "one text, found many times over") for e in "pqr" for _ in range(40)]
    return [(e, i, t) for i, (e, t) in enumerate(out)]


@pytest.mark.parametrize("given", [{}, {"kept": shared.kept}, {"seeds": 7, "n": 2, "tasks": 9}, {"piece": 300}, {"mask": 0xE0E0 << 48}, {"mask": 0xFFF0 << 48}])
def test_bands_from_shared_shingles_are_whole(spark, monkeypatch, given):
    """In small pieces, with a last band of fewer seeds, and where the cheap codes of most shingles agree with others."""
    monkeypatch.setattr(shingles, "_PIECE", given.pop("piece", shingles._PIECE))
    mixed, mask = shingles._mixed, given.pop("mask", None)
    if mask:
        monkeypatch.setattr(shingles, "_mixed", lambda x: mixed(x) & np.uint64(mask))
    notes = spark.createDataFrame(near_copies(), "entity string, id long, text string")
    several = lambda b: sorted((r.entity, r.note, r.band, r.signature) for r in b.withColumn("c", F.count("*").over(Window.partitionBy("entity", "band", "signature"))).filter("c > 1").collect())
    want = several(trends.minhash_bands(notes, "entity", "id", "text", **{k: v for k, v in given.items() if k not in ("tasks", "kept")}))
    assert several(trends.shared_bands(notes, "entity", "id", "text", **given)) == want != []


def test_only_shared_shingles_are_asked():
    """SHA-256 is for what two notes of an entity hold; another entity's note does not count."""
    rows = sorted((t, e) for e, _, t in near_copies())
    batch = lambda r: pa.RecordBatch.from_pylist(r, pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("key", pa.int64()), ("mark", pa.int64()), ("entity", pa.string()), ("text", pa.string()), ("part", pa.int32()), ("codes", pa.binary()), ("content", pa.binary())]))
    texts = [{"block": 0, "kind": 1, "key": 0, "mark": 0, "entity": e, "text": t} for t, e in rows]
    sent = sorted((r for b in shingles._fingerprints(3, 4)(iter([batch(texts)])) for r in b.to_pylist()), key=lambda r: r["part"])
    lists = [r | {"kind": 0} for b in shingles._several([pa.RecordBatch.from_pylist(sent)]) for r in b.to_pylist()]
    asked = {x for b in shingles._asked(3, 4)(iter([batch(lists + texts)])) for r in b.to_pylist() for x in r["content"].split(b"\n")}
    held = {}
    for t, e in rows:
        w = re.findall("[a-z0-9]+", t.lower())
        for s in {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}:
            held[e, s] = held.get((e, s), 0) + 1
    assert asked == {s.encode() for (_, s), k in held.items() if k > 1}
    assert len(asked) < len({s for _, s in held})


def test_terms_are_those_of_shared_buckets(spark):
    """Cosines as worked out by hand; only notes of a bucket have their terms taken up, and once."""
    texts = {1: "alpha beta gamma delta", 2: "alpha beta gamma gamma", 3: "Alpha, beta epsilon", 4: "zeta " * 50, 5: "a ? b"}
    notes = spark.createDataFrame([("e", i, t) for i, t in texts.items()], "entity string, id long, text string")
    bands = spark.createDataFrame([("e", n, b, s) for b, s, ns in [(0, "x", [1, 2, 3]), (1, "y", [2, 1]), (2, "z", [3, 2, 1]), (3, "u", [4]), (4, "v", [5, 3])] for n in ns], "entity string, note long, band int, signature string")
    near = trends.near_anchor(bands, notes, "entity", "id", "text", 0.1)
    written = trends.near_anchor(bands, notes, "entity", "id", "text", 0.1, shared.kept)
    assert sorted(near.collect()) == sorted(written.collect())

    def cosine(bucket, note):
        terms = {i: re.findall("[a-z0-9_]{2,}", texts[i].lower()) for i in bucket}
        df = {w: sum(w in t for t in terms.values()) for t in terms.values() for w in t}
        w = {i: {x: t.count(x) * (np.log((1 + len(bucket)) / (1 + df[x])) + 1) for x in t} for i, t in terms.items()}
        norm = lambda i: np.sqrt(sum(x * x for x in w[i].values()))
        return sum(x * w[min(bucket)].get(k, 0) for k, x in w[note].items()) / norm(note) / norm(min(bucket))

    want = {(1, n): max(cosine(b, n) for b in ([1, 2, 3], [1, 2]) if n in b) for n in (1, 2, 3)} | {(3, 3): 1.0}
    got = {(r.anchor, r.note): r.cosine for r in near.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "LeftSemi" in plan.split("Generate explode")[1]
