"""Properties of the keyed look-ups, file sources and sinks."""

import pytest
from pyspark.sql import functions as F

from obsload.functions.geometry import centroid, map_vertices, parse_wkt, to_wkt, within_convex
from obsload.operators.issues import ISSUES, Check, with_issues
from obsload.operators.keyed import fetch, flag_duplicates, flag_unknown
from obsload.sinks.tables import Step, reset_loads
from obsload.sources.delimited import header_of, numbered, read_delimited, refuse_surplus
from obsload.sources.profile import file_issues, profile_files, read_files


def skewed(spark):
    """A third of the rows share a key, a third have none, the rest are unique or pairs."""
    i = F.col("id")
    key = (
        F.when(i % 3 == 0, "hot").when(i % 3 == 1, None).when(i % 2 == 0, F.concat(F.lit("u"), i.cast("string")))
        .otherwise(F.concat(F.lit("p"), F.floor(i / 12).cast("string")))
    )
    return spark.range(6000).select(i.alias("line_no"), key.alias("k"))


@pytest.mark.parametrize("settle", [False, True])
def test_duplicates_agree_with_counting(spark, settle):
    rows = skewed(spark)
    flagged = flag_duplicates(rows, ["k"], "dup", F.col("line_no"), settle)
    counts = rows.groupBy("k").count().withColumnRenamed("k", "k2")
    both = flagged.join(counts, F.col("k") == F.col("k2"), "left")
    wrong = both.where(F.col("dup") != F.coalesce(F.col("count") > 1, F.lit(False)))
    assert flagged.count() == 6000 and wrong.count() == 0
    assert flagged.where("k is null and dup").count() == 0


@pytest.mark.parametrize("settle", [False, True])
def test_unknown_keys(spark, settle):
    rows = skewed(spark)
    known = spark.createDataFrame([("hot",)], "ref string")
    flagged = flag_unknown(rows, "k", known, "ref", "missing", F.col("line_no"), settle)
    assert flagged.where("missing").count() == rows.where("k is not null and k <> 'hot'").count()


def test_look_up_keeps_every_row(spark):
    rows = skewed(spark)
    dimension = spark.createDataFrame([("hot", 1), ("u8", 2)], "k string, v int")
    got = fetch(rows, dimension, ["k"], ["v"], F.col("line_no"))
    assert got.count() == 6000
    assert {(r["v"], r["n"]) for r in got.groupBy("v").agg(F.count("*").alias("n")).collect()} == {
        (1, 2000), (2, 1), (None, 3999),
    }


def test_numbering_over_splits_and_files(spark, tmp_path):
    for name, first in (("a.csv", 0), ("b.csv", 3000)):
        lines = ["id;note"] + [f"{first + i};{'x' * 50}" for i in range(3000)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = read_delimited(spark, str(tmp_path), ["id", "note"], multiline=False)
        assert raw.select("_file", "_block").distinct().count() > 4
        got = numbered(raw, 1)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got.where(F.col("id").cast("long") + 1 != F.col("line_no")).count() == 0
    assert got.count() == 6000


def test_blank_lines_do_not_count_and_surplus_is_named(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("a;b\n1;2\n\n;\n3;4\n5;6;7\n8\n")
    assert header_of(spark, str(path), ";") == ["a", "b"]
    got = numbered(read_delimited(spark, str(path), ["a", "b"]), 1)
    assert {r["a"]: r["line_no"] for r in got.collect() if r["a"]} == {"1": 1, "3": 3, "5": 4, "8": 5}
    with pytest.raises(ValueError, match="line 4"):
        refuse_surplus(got, ["a", "b"], ";")


def test_file_faults(spark, tmp_path):
    files = {
        "good.csv": b"a;b\n1;2\n", "empty.csv": b"", "latin.csv": "a;b\né;2\n".encode("latin-1"),
        "blank.csv": b"\na;b\n", "twice.csv": b"a;b;a\n1;2;3\n", "bare.csv": b"a;b\n", "123.txt": b"a,b\n1,2\n",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    profile = profile_files(read_files(spark, str(tmp_path)))
    found = {(r["path"].rsplit("/", 1)[1], r["code"]) for r in file_issues(profile).collect()}
    assert found == {
        ("empty.csv", "EMPTY_FILE"), ("latin.csv", "ENCODING_ERROR"), ("blank.csv", "FILE_FORMAT_ERROR"),
        ("twice.csv", "HEADER_SAME_COLUMN_NAME"), ("bare.csv", "FILE_WITH_NO_DATA"),
        ("123.txt", "FILE_EXTENSION_ERROR"), ("123.txt", "FILE_NAME_ERROR"),
    }
    latin = profile_files(read_files(spark, str(tmp_path / "latin.csv"), "iso-8859-1")).first()
    assert latin["decodes"] and latin["separator"] == ";"


def test_faults_of_the_files_of_a_load(spark, tmp_path):
    from obsload.model.loads import Load
    from obsload.plans.load import load_files
    from obsload.sources.profile import list_files, load_file_issues

    folder = tmp_path / "with space+plus"
    folder.mkdir()
    files = {
        "good.csv": "﻿a;b\r\n1;2\r\n".encode(), "other.csv": b"b;a\n1;2\n", "bare.csv": b"a;b\n\n  \n", "none.csv": b"",
        "bad.csv": b"a;b\n\xe9;2\n\xe9;3\n", "long.csv": b"a;b\n" + b"1;2\n" * 500,
    }
    for name, content in files.items():
        (folder / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        issues = load_file_issues(spark, str(folder), ["a", "b"], "UTF-8", 1500).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["path"].rsplit("/", 1)[1], r["code"]) for r in issues) == [
        ("bad.csv", "ENCODING_ERROR"), ("bare.csv", "FILE_WITH_NO_DATA"), ("long.csv", "FILE_OVERSIZE"),
        ("none.csv", "EMPTY_FILE"), ("other.csv", "FILE_FORMAT_ERROR"),
    ]
    assert {r["length"] for r in list_files(spark, str(folder)).collect()} == {len(c) for c in files.values()}
    load = Load(1, ("a", "b"), {"nom_cite": "a"}, {}, id_dataset=1, id_source=1)
    with pytest.raises(ValueError, match="long.csv has 2004 bytes"):
        load_files(spark, str(folder), load, max_size=1500)
    assert load_files(spark, str(folder / "good.csv"), load).files.count() == 0


def test_reset_clears_later_steps_only(spark):
    loads = spark.createDataFrame(
        [(1, ["a"], 5, True, True, 3)],
        "id_load int, columns array<string>, source_count int, loaded boolean, processed boolean, import_count int",
    )
    row = reset_loads(loads, Step.PREPARE).first()
    assert (row["columns"], row["source_count"], row["loaded"]) == (["a"], 5, True)
    assert (row["processed"], row["import_count"]) == (False, None)


def test_partitions_are_replaced_and_dropped(spark, tmp_path):
    import datetime as dt

    from obsload.model.loads import Load, Settings
    from obsload.plans.load import commit
    from obsload.sinks.tables import Tables, replace_partition, reset_tables

    places = Tables(*[str(tmp_path / n) for n in ("staging", "issues", "target")])
    rows = spark.range(10).select(
        F.col("id").cast("int").alias("cd_nom"), (F.col("id") % 2 == 0).alias("valid")
    )
    settings = Settings(as_of=dt.date(2024, 1, 1))
    loads = [Load(n, ("a",), {"cd_nom": "a"}, id_source=n, id_dataset=1) for n in (1, 2)]
    for load in (loads[0], loads[1], loads[0]):  # the first is committed again
        commit(rows, load, settings, places.target)
    assert spark.read.parquet(places.target).count() == 10
    for path in (places.staging, places.issues):
        replace_partition(rows.select("cd_nom", (F.col("cd_nom") % 2 + 1).alias("id_load")), path, "id_load")
    reset_tables(spark, places, loads[0], Step.PREPARE)
    assert spark.read.parquet(places.staging).count() == 10
    assert spark.read.parquet(places.issues).select("id_load").distinct().count() == 1
    left = spark.read.parquet(places.target)
    assert left.count() == 5 and left.select("id_source").distinct().first()[0] == 2


def test_slices_cover_the_load(spark):
    from obsload.sources.staging import batch_slice

    rows = spark.range(1000).where("id % 7 <> 0").select(
        F.lit(1).alias("id_load"), (F.col("id") + 1).alias("line_no")
    )
    total = rows.count()
    parts = [batch_slice(rows, k, 250, span=100) for k in range(0, total, 250)]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    assert united.count() == total and united.exceptAll(rows).count() == 0


def test_another_header_or_encoding_is_refused(spark, tmp_path):
    good, other = tmp_path / "good.csv", tmp_path / "other"
    good.write_text("a;b\n1;2\n")
    other.mkdir()
    (other / "x.csv").write_text("a;b\n1;2\n")
    (other / "y.csv").write_text("b;a\n2;1\n")
    (tmp_path / "latin.csv").write_bytes("a;b\né;2\n".encode("latin-1"))
    assert numbered(read_delimited(spark, str(good), ["a", "b"]), 1).count() == 1
    for path in (other, str(good)):
        names = ["a", "b"] if path is other else ["a", "c"]
        with pytest.raises(Exception, match="(?i)header"):
            numbered(read_delimited(spark, str(path), names), 1)
    with pytest.raises(ValueError, match="1 lines of .*latin.csv"):
        read_delimited(spark, str(tmp_path / "latin.csv"), ["a", "b"])
    read = read_delimited(spark, str(tmp_path / "latin.csv"), ["a", "b"], encoding="ISO-8859-1")
    assert [r["a"] for r in numbered(read, 1).collect()] == ["é"]
    with pytest.raises(ValueError, match="utf-7"):
        read_delimited(spark, str(good), ["a", "b"], encoding="utf-7")


def test_ragged_records_are_invalid_after_the_check(spark, dims, tmp_path):
    import datetime as dt

    from obsload.model.loads import Load, Settings
    from obsload.plans.check import check_load
    from obsload.plans.load import load_files

    names = ("date_min", "nom_cite", "cd_nom", "WKT")
    good = "2018-07-19;x;45013;POINT(3.75 45.95)"
    path = tmp_path / "f.csv"
    path.write_text("\n".join([";".join(names), good, good + ";more", good.rsplit(";", 1)[0]]) + "\n")
    load = Load(5, names, {n: n for n in names}, id_source=1)
    staged = load_files(spark, str(path), load, strict=False, staging_path=str(tmp_path / "staging"))
    checked = check_load(staged.rows, load, dims, Settings(as_of=dt.date(2024, 6, 1)))
    found = {(r["line_no"], r["code"]) for r in checked.issues.collect()}
    assert {(2, "ROW_HAVE_TOO_MUCH_COLUMN"), (3, "ROW_HAVE_LESS_COLUMN")} <= found
    assert [r["line_no"] for r in checked.rows.where("valid").collect()] == [1]
    assert spark.read.parquet(str(tmp_path / "staging")).where("id_load = 5").count() == 3


def test_a_dimension_with_repeated_keys_does_not_multiply_rows(spark):
    rows = skewed(spark)
    dimension = spark.createDataFrame([("hot", 4), ("hot", 1), ("u8", 2), ("u8", 2)], "k string, v int")
    for settle in (False, True):
        got = fetch(rows, dimension, ["k"], ["v"], F.col("line_no"), settle)
        assert {(r["v"], r["n"]) for r in got.groupBy("v").agg(F.count("*").alias("n")).collect()} == {
            (1, 2000), (2, 1), (None, 3999),
        }


def test_checks_of_the_caller_and_whole_records(spark, dims, tmp_path):
    import datetime as dt

    from obsload.model.error_types import error_table
    from obsload.model.loads import Load, Settings
    from obsload.operators.issues import Check, report_rows
    from obsload.plans.check import check_load
    from obsload.plans.load import load_files

    names = ("date_min", "nom_cite", "cd_nom", "WKT")
    lines = [f"2018-07-0{d};{said};45013;POINT(3.75 45.95)" for d, said in ((1, "x"), (2, "y"), (1, "x"), (3, "z"))]
    path = tmp_path / "f.csv"
    path.write_text("\n".join([";".join(names), *lines]) + "\n")
    load = Load(6, names, {n: n for n in names}, id_source=1)
    own = [
        Check("NAME_TOO_SHORT", "nom_cite", F.col("nom_cite") == "y", F.col("nom_cite"), level="ERROR"),
        Check("NAME_ODD", "nom_cite", F.col("nom_cite") == "z", level="WARNING"),
    ]
    staged = load_files(spark, str(path), load)
    settings = Settings(as_of=dt.date(2024, 6, 1))
    checked = check_load(staged.rows, load, dims, settings, extra_checks=own, report_duplicate_rows=True)
    found = {(r["line_no"], r["code"]) for r in checked.issues.collect()}
    assert found == {(1, "DUPLICATE_ROWS"), (2, "NAME_TOO_SHORT"), (3, "DUPLICATE_ROWS"), (4, "NAME_ODD")}
    assert [r["line_no"] for r in checked.rows.where("valid").collect()] == [4]
    kinds = error_table(spark, [("NAME_TOO_SHORT", "own", "The name is too short", "ERROR"), ("NAME_ODD", "own", "Odd", "WARNING")])
    shown = {r["code"]: (r["category"], r["level"]) for r in report_rows(checked.issues, kinds).collect()}
    assert shown["NAME_TOO_SHORT"] == ("own", "ERROR") and shown["DUPLICATE_ROWS"][1] == "ERROR"
    with pytest.raises(ValueError, match="NAME_ODD"):
        Check("NAME_ODD", "x", F.lit(True)).issue()


def test_line_sets_stay_small_and_comments_are_cut(spark):
    from obsload.operators import issues as ops

    lines = [1, 2, 32768, 32769, 65536, 65537, 100000, 100001, 5_000_000_000]
    rows = [(1, n, "INVALID_DATE", "d", f"v{n}") for n in lines] + [(1, 2, "MISSING_VALUE", "d", None), (2, 7, "INVALID_DATE", "e", None)]
    issues = spark.createDataFrame(rows, "id_load int, line_no long, code string, column string, value string")
    found = {(r["id_load"], r["code"], r["run"]): r for r in ops.issue_runs(issues).collect()}
    assert found[1, "INVALID_DATE", 0]["lines"] == lines[:7] and found[1, "INVALID_DATE", 49999]["lines"] == lines[8:]
    assert found[1, "INVALID_DATE", 1]["comment"].endswith(": v100001") and found[1, "MISSING_VALUE", 0]["comment"] is None
    assert found[2, "INVALID_DATE", 0]["lines"] == [7] and len(found) == 5
    halves = [ops.issue_sets(issues.where(F.col("line_no") % 2 == k)) for k in (0, 1)]
    merged = ops.merge_sets(*halves, halves[0])
    got = {(r["id_load"], r["code"], r["run"]): r["lines"] for r in ops.set_runs(merged, ops.REPORT).collect()}
    assert got == {k: r["lines"] for k, r in found.items()}
    first = merged.where("code = 'INVALID_DATE' AND id_load = 1 AND part = 1").first()
    assert len(first["bits"]) == 4096 and first["comment"].endswith(": v2, v32768")
    every = spark.range(1, 200_001).select(F.lit(1).alias("id_load"), F.col("id").alias("line_no"), F.lit("INVALID_DATE").alias("code"),
        F.lit("d").alias("column"), F.repeat(F.lit("x"), 1000).alias("value"))
    runs = ops.issue_runs(every).collect()
    assert sorted(len(r["lines"]) for r in runs) == [100_000, 100_000]
    assert all(ops.COMMENT_BYTES <= len(r["comment"]) < ops.COMMENT_BYTES + 1100 for r in runs)


def test_written_tables_are_removed_when_released(spark):
    from pathlib import Path

    from obsload import workspace

    workspace._MADE.clear()
    kept = workspace.written(spark.range(5), "some")
    path = Path(workspace._MADE[0].removeprefix("file:"))
    assert kept.count() == 5 and path.exists()
    assert workspace.release(spark) == 1 and not path.exists() and workspace.release(spark) == 0


def test_conditions_of_checks_are_compiled(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n int, s string")
    checks = [Check("MISSING_VALUE", "s", F.col("s").isNull()), Check("INVALID_INTEGER", "s", F.col("s") == "a", F.col("s"))]
    out = with_issues(with_issues(rows, checks), checks[1:])
    got = {r["n"]: [(i["code"], i["column"], i["value"]) for i in r["issues"]] for r in out.collect()}
    assert got == {1: [("INVALID_INTEGER", "s", "a")] * 2, 2: [("MISSING_VALUE", "s", None)], 3: []}
    # a filter of an array would interpret the conditions of all checks
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.schema["issues"].dataType.simpleString() == ISSUES


def test_rows_without_a_shape(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "POINT(1 x)"), (4, "POINT(1 2)"), (5, "LINESTRING(1 2, 3 4)")], "n int, s string")
    g = rows.select("n", parse_wkt(F.col("s")).alias("g"))
    moved = map_vertices(F.col("g"), lambda x, y: (x + 1, y))
    inside = within_convex(F.col("g"), [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)])
    got = {r["n"]: (r["m"], r["c"], r["i"]) for r in g.select("n", to_wkt(moved).alias("m"), to_wkt(centroid(F.col("g"))).alias("c"), inside.alias("i")).collect()}
    none = (None, None, None)
    assert got == {1: none, 2: none, 3: none, 4: ("POINT (2 2)", "POINT (1 2)", True), 5: ("LINESTRING (2 2, 4 4)", "POINT (2 3)", True)}
