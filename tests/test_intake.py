"""Whatever is submitted is a row or in quarantine: streams, dumps, limits, references, manifests."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import intake
from vigil.plans import catalogue
from vigil.sources import files
from vigil.streaming import incremental


def landed(spark, path, rows, n_files):
    spark.createDataFrame(rows, "submission_id string, source_row long, v long").repartition(n_files, "source_row").write.mode("append").parquet(path)


def taken(df):
    rows = [(r.submission_id, r.source_row) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_a_submission_in_many_files_is_whole(spark, tmp_path):
    """One submission of 40 rows in 8 files and several batches, delivered again in other files, and after a restart."""
    rows = [("s1", i, i) for i in range(40)]
    land, work = f"{tmp_path}/land", f"{tmp_path}/work"
    landed(spark, land, rows, 8)
    landed(spark, land, rows[10:30], 3)
    prepare = lambda d: d.select("submission_id", "source_row", (F.col("v") * 2).alias("v"))
    assert len(taken(incremental.intake_stream(spark, land, work, prepare))) == 40
    landed(spark, land, rows[:7] + [("s2", i, i) for i in range(5)] + [("s1", 40, 1)], 4)
    assert len(taken(incremental.intake_stream(spark, land, work, prepare))) == 46


def test_a_killed_batch_is_taken_once(spark, tmp_path):
    rows = [("s1", i, i) for i in range(60)]
    land, work = f"{tmp_path}/land", f"{tmp_path}/work"
    landed(spark, land, rows, 8)
    broken = lambda d: d.select("submission_id", "source_row", F.when(F.col("v") == 59, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("long").alias("v"))
    with pytest.raises(Exception, match="lost"):
        incremental.intake_stream(spark, land, work, broken, files_per_batch=1)
    fine = lambda d: d.select("submission_id", "source_row", "v")
    assert taken(incremental.intake_stream(spark, land, work, fine, files_per_batch=1)) == {("s1", i) for i in range(60)}


def test_features_go_on_after_a_restart(spark, tmp_path):
    rng = random.Random(1)
    made = lambda n: [(rng.randint(0, 5), rng.choice(["alert", "case"]), rng.choice(["error", "view"]), rng.choice([*incremental.SEVERITIES, None, "odd"]), float(rng.randint(0, 9))) for _ in range(n)]
    schema, all_rows = "entity_id long, kind string, category string, severity string, value double", []
    for n in (200, 1, 40):
        rows = made(n)
        all_rows += rows
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(f"{tmp_path}/src")
        got = incremental.maintained(spark, f"{tmp_path}/src", f"{tmp_path}/work", lambda d: d)
        want = incremental.features(spark.createDataFrame(all_rows, schema))
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


DUMP = """-- dump; it's made by hand
# isn't it
CREATE TABLE cases (a text, b text);
INSERT INTO cases (a, b) VALUES ('1','x, y'), ('2','z');
INSERT INTO `cases` (`b`, a)
-- a comment; inside
VALUES ('it''s; (so)
two lines', 3),
  (NULL, '4');
insert into cases values ('5', 'no list'), ('6', 'a', 'too many'), (7, -1.5e3);
INSERT INTO other (alert_id) VALUES ('q');
INSERT INTO cases (a, b) SELECT a, b FROM others;
/* block; comment */ INSERT INTO public.cases (a, b) VALUES ('', '--'), (8,);
UPDATE cases SET a = 'x;y';
INSERT INTO cases (a, b) VALUES ('9', 'open"""


@pytest.mark.parametrize("split", [1, 60, 1 << 20])
def test_every_statement_is_a_row_or_in_quarantine(spark, tmp_path, split):
    (tmp_path / "d.sql").write_text(DUMP)
    spark.conf.set("spark.sql.files.maxPartitionBytes", max(split, 16))
    try:
        rows = files.read_sql_dump(spark, str(tmp_path), "cases", ["a", "b"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    good = sorted(((r.a, r.b) for r in rows if r[files.CORRUPT] is None), key=repr)
    assert good == sorted([("1", "x, y"), ("2", "z"), ("3", "it's; (so)\ntwo lines"), ("4", None), ("5", "no list"), ("7", "-1.5e3"), ("", "--"), ("8", None)], key=repr)
    bad = sorted(r[files.CORRUPT] for r in rows if r[files.CORRUPT] is not None)
    assert len(bad) == 3 and bad[0] == "('6', 'a', 'too many')" and "SELECT" in bad[1] and bad[2].endswith("'open")


def test_a_table_is_chosen(spark, tmp_path):
    (tmp_path / "d.sql").write_text("INSERT INTO zz (x) VALUES (1), (2), (3);\nINSERT INTO mine (alert_id, rule_id) VALUES ('a', 'r');")
    assert files.dump_table(spark, str(tmp_path)) == "mine"
    assert [tuple(r)[:2] for r in files.read_sql_dump(spark, str(tmp_path), None, ["alert_id", "rule_id"]).collect()] == [("a", "r")]
    (tmp_path / "d.sql").write_text("INSERT INTO zz (x) VALUES (1), (2);\nINSERT INTO aa (y) VALUES (1);")
    assert files.dump_table(spark, str(tmp_path)) == "zz"


def test_quoted_separators_are_no_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"1,2,3,4,5,6"\n2,"two\nlines, and ""quotes"", here"\n\n')
    (tmp_path / "b.csv").write_text("x,y,z\n" + "1,2,3\n" * 5)
    got = {r.file.rsplit("/", 1)[1]: (r.n_rows, r.n_columns, r.over) for r in files.over_limits(spark, str(tmp_path), 4, 2).collect()}
    assert got == {"a.csv": (2, 2, False), "b.csv": (5, 3, True)}


def test_an_empty_target_judges_nothing(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 6)], "id long, ref long")
    target = spark.createDataFrame([(5,), (None,)], "k long")
    assert [r.id for r in intake.dangling(rows, "ref", target, "k").collect()] == [3]
    assert intake.dangling(rows, "ref", target.limit(0), "k").count() == 0


def test_manifests_see_names_and_bytes_only(spark, tmp_path):
    for folder, names in (("a", "xy"), ("b", "yx"), ("c", "xy"), ("d", "xz")):
        for i, n in enumerate(names):
            sub = tmp_path / folder / n
            sub.mkdir(parents=True)
            (sub / "same.bin").write_bytes(b"1" if n == "x" else b"3" if folder == "c" else b"2")
    h = {f: files.manifest_hash(spark, f"{tmp_path}/{f}").first() for f in "abcd"}
    assert h["a"] == h["b"] and len({x.manifest for x in h.values()}) == 3 and h["a"].n_files == 2


def test_unknown_indicators_are_an_error(spark):
    with pytest.raises(ValueError, match="nope"):
        catalogue.indicator_values(spark, "/root/testdata/sf0.001", "eg01", "nope")


def test_quality_scores_by_hand(spark):
    from vigil.operators import submission_quality as sq

    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    counts = made([("s", "case", "a", 10, 2, 1, 0, 0), ("s", "case", "b", 10, 0, 0, 3, 1), ("t", "case", "a", 0, 0, 0, 0, 0)], "submission_id string, table_name string, column_name string, seen long, missing long, malformed long, unmapped long, sanitised long")
    loaded = made([("s", "case", 8, 2), ("s", "alert", 2, 0), ("t", "case", 0, 3), ("u", "other", 5, 0)], "submission_id string, table_name string, n_rows long, n_quarantined long")
    required = made([("case", "a"), ("case", "b"), ("case", "never")], "table_name string, column_name string")
    by = lambda df, c: {r.submission_id: r[c] for r in df.collect()}
    assert by(sq.completeness(counts, loaded, required), "completeness") == pytest.approx({"s": (0.8 + 1 + 0) / 3, "t": 0.0, "u": 1.0})
    assert by(sq.validity(counts, loaded), "validity") == pytest.approx({"s": 1 - (2 / 12 + 4 / 20) / 2, "t": 0.0, "u": 1.0})
    lost = made([("s", 1), ("s", 2)], "submission_id string, id long")
    assert by(sq.consistency(lost, loaded, ["case"]), "consistency") == pytest.approx({"s": 0.8, "t": 1.0, "u": 1.0})
    assert by(sq.mapping_confidence(made([("s", "x", True), ("s", "y", False)], "submission_id string, header string, approved boolean")), "mapping") == {"s": 0.5}
