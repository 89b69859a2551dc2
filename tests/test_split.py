"""Files cut into byte blocks give the records and numbers of a reader that goes through them in one piece."""

import csv
import io
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from obsload.sources.delimited import numbered, ragged_issues, read_delimited
from obsload.sources.split import Lines, Quotes, read_records

COLUMNS = ["id", "note", "more"]


@pytest.fixture()
def small_blocks(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def made_rows(seed, n):
    rng = random.Random(seed)
    cells = ["", "plain", 'say "so"', "a;b", "first\nsecond", "\n\n", "é€ and 日", '"', "x" * 90, 'one;"two"\n;three;', " "]
    return [[f"r{seed}-{i}", rng.choice(cells), rng.choice(cells) * rng.randint(1, 30)] for i in range(n)]


def written_file(path, rows, end="\n", encoding="utf-8"):
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=";", lineterminator=end).writerows([COLUMNS, *rows])
    path.write_bytes(out.getvalue().encode(encoding))


def cells(df):
    return {(r["id_load"], r["line_no"]): tuple(r[c] or "" for c in COLUMNS) for r in df.collect()}


def test_blocks_that_cut_cells(spark, tmp_path, small_blocks):
    rows = {name: made_rows(i, n) for i, (name, n) in enumerate((("a.csv", 150), ("b.csv", 1), ("c.csv", 80)))}
    for name, some in rows.items():
        written_file(tmp_path / name, some)
    got = read_records(spark, str(tmp_path), COLUMNS)
    assert got.columns == [*COLUMNS, "_corrupt", "_file", "_block", "id_load", "line_no"]
    expected = [tuple(r) for some in rows.values() for r in some]
    assert cells(got) == {(1, i + 1): r for i, r in enumerate(expected)} and got.count() == len(expected)
    assert got.select("_file", "_block").distinct().count() > 20
    assert got.where(F.col("_corrupt").isNotNull()).count() == 0
    each = read_records(spark, str(tmp_path), COLUMNS, id_load=F.ascii(F.regexp_extract("_file", r"(\w)\.csv", 1)))
    assert cells(each) == {(ord(name[0]), i + 1): tuple(r) for name, some in rows.items() for i, r in enumerate(some)}


def test_same_records_as_the_reader_of_whole_files(spark, tmp_path, small_blocks):
    text = "﻿id;note;more\n1;a;b\n\n;;\n2;x;y;z\n3;half\n4;5\" pipe;\"q \"\"r\"\" \n s\"\n\n\n\"5\";\"\";  \n"
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text(text * 1)
    whole = numbered(read_delimited(spark, str(tmp_path), COLUMNS), 1)
    split = read_records(spark, str(tmp_path), COLUMNS)
    assert cells(split) == cells(whole) and len(cells(whole)) == 12
    issues = [sorted(map(tuple, ragged_issues(x, COLUMNS, ";").collect())) for x in (whole, split)]
    assert issues[0] == issues[1] and len(issues[0]) == 4


@pytest.mark.parametrize("encoding", ["ISO-8859-1", "ISO-8859-15"])
def test_latin_files_and_carriage_returns(spark, tmp_path, small_blocks, encoding):
    rows = [[str(i), f"é{'€' if encoding.endswith('15') else '¤'}\n{'ü' * 200}", "ß"] for i in range(40)]
    written_file(tmp_path / "a.csv", rows, "\r\n", encoding)
    got = cells(read_records(spark, str(tmp_path), COLUMNS, encoding=encoding))
    assert got == {(1, i + 1): tuple(r) for i, r in enumerate(rows)}


def test_faults_abort(spark, tmp_path, small_blocks):
    written_file(tmp_path / "good.csv", made_rows(1, 30))
    assert read_records(spark, str(tmp_path / "good.csv"), ["ID", "Note", "more"]).count() == 30
    for names in (["id", "more", "note"], ["id", "note"], [*COLUMNS, "x"]):
        with pytest.raises(ValueError, match="header of .*good.csv"):
            read_records(spark, str(tmp_path), names)
    with pytest.raises(ValueError, match="utf-7"):
        read_records(spark, str(tmp_path), COLUMNS, encoding="utf-7")
    (tmp_path / "latin.csv").write_bytes("id;note;more\n1;é;b\n2;ü;c\n3;a;b\n".encode("latin-1"))
    with pytest.raises(ValueError, match="2 lines of .*latin.csv"):
        read_records(spark, str(tmp_path), COLUMNS)


def test_bare_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;note;more\n")
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text("\n\nid;note;more\n1;2;3")
    (tmp_path / "d.csv").write_text('id;note;more\n1;2;"never closed\n3;4;5\n')
    got = cells(read_records(spark, str(tmp_path), COLUMNS))
    assert got[1, 1] == ("1", "2", "3") and got[1, 2][:2] == ("1", "2") and len(got) == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='"; a', max_size=9), min_size=1, max_size=8), st.booleans())
def test_states_of_lines_follow_the_automaton(texts, inside):
    lines = Lines(pa.array([t.encode() for t in ["skipped", *texts]], pa.binary()).slice(1), quotes := Quotes(";"))
    regular = [t for t in texts if t.count('"') % 2 == 0 and not lines.turns]
    begun, after = lines.begun_inside(inside)
    state = inside
    for i, t in enumerate(texts):
        assert bool(begun[i]) == state
        turned = [k for k, _ in lines.turns]
        state = quotes.ends_inside(t.encode(), state) if i in turned else state
    assert after == state and len(regular) <= len(texts)


def test_small_blocks_share_tasks(spark, tmp_path):
    path = tmp_path / "blocks.csv"
    path.write_text("k;v\n" + "".join(f'{i};"a\n""b;{i}"\n' for i in range(5000)))
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, (512, 1), strict=True):
            spark.conf.set(n, v)
        records = read_records(spark, str(path), ["k", "v"])
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert records.select("_block").distinct().count() > 100
    assert len(records.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
    rows = records.select("k", "v", "line_no").collect()
    assert {(r["line_no"], r["k"], r["v"]) for r in rows} == {(i + 1, str(i), f'a\n"b;{i}') for i in range(5000)}
