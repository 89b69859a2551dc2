"""Questions about many keys at once give the answers of one look-up each, whichever way these come back."""

import pytest
from pyspark.sql import functions as F

from obsload.operators import keyed
from obsload.operators.keyed import ABSENT, PRESENT, REPEATED, Question, possible, with_answers

ROW = ["id_load", "line_no"]


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    return spark.range(3000).select(
        F.lit(1).alias("id_load"),
        n.alias("line_no"),
        F.when(n % 3 == 0, "hot").when(n % 7 == 0, None).otherwise(F.concat(F.lit("u"), n)).alias("name"),
        (n % 50).cast("int").alias("code"),
        F.when(n % 2 == 0, n).alias("part"),
        F.lit("kept").alias("_bits"),
    ).repartition(5)


def questions(spark):
    codes = spark.createDataFrame([(c,) for c in [*range(40), 3, 2**40, None]], "c long")
    names = spark.createDataFrame([("hot",), ("u8",), ("U10",), (None,), ("u8",)], "k string")
    return [
        Question("same_name", ("name",), REPEATED),
        Question("known_name", ("name",), PRESENT, names),
        Question("no_code", ("code",), ABSENT, codes),
        Question("same_pair", ("code", "part"), REPEATED),
        Question("same_load", ("id_load", "name"), REPEATED),
    ]


@pytest.mark.parametrize("few", [0, 200, keyed.BROADCAST_KEYS])
def test_answers(spark, rows, few):
    got = with_answers(rows, questions(spark), ROW, broadcast_keys=few).collect()
    assert len(got) == 3000
    for r in got:
        n = r["line_no"]
        assert r["same_name"] == r["same_load"] == (r["name"] == "hot") and r["_bits"] == "kept"
        assert r["known_name"] == (r["name"] in ("hot", "u8"))
        assert r["no_code"] == (n % 50 >= 40) and not r["same_pair"]


def test_keys_are_counted_in_one_pass_over_the_source(spark, rows, tmp_path):
    path = str(tmp_path / "rows")
    rows.write.parquet(path)
    base = spark.read.parquet(path)
    scans = []
    old = keyed.written

    def counted(df, label):
        scans.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        return old(df, label)

    keyed.written = counted
    try:
        out = with_answers(base.withColumn("more", F.lit(1)), questions(spark), ROW, base)
    finally:
        keyed.written = old
    assert [label for label, _ in scans] == ["counts", "answers"]
    read = "line_no#"  # a column of the source and of nothing else that is written
    assert "Join" not in scans[0][1] and read not in scans[1][1]
    last = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in last and out.count() == 3000


def test_possible_keeps_every_match(spark):
    keys = spark.range(0, 9000, 3).select(F.col("id").cast("string").alias("key"))
    rows = spark.range(90_000).select(F.col("id").cast("string").alias("k"), "id")
    kept = possible(rows, "k", keys, 3000)
    assert kept.join(keys, kept["k"] == keys["key"]).count() == 3000
    assert kept.count() < 3000 + 0.1 * 90_000
    assert possible(rows, "k", keys.limit(0), 0).count() == 0
    assert possible(rows, "k", keys, 10**12).count() == 90_000


def test_no_rows_and_no_questions(spark, rows):
    none = with_answers(rows.limit(0), questions(spark), ROW)
    assert none.count() == 0 and none.columns[-5:] == [q.flag for q in questions(spark)]
    assert with_answers(rows, [], ROW) is rows
