"""Many small files: written into one folder, listed and read once."""

import shutil

from pyspark.sql import functions as F

from obsload.samples.files import file_number, written_texts
from obsload.sources.profile import file_issues, profile_files, read_files


def test_texts_lie_in_one_folder_whatever_their_bytes(spark):
    rows = spark.createDataFrame([(1, b"a;b\n\xe9"), (2, None), (3, b"x"), (3, b"x")], "file_id long, content binary")
    path = written_texts(rows.select("file_id", F.col("content").cast("string").alias("content")), "texts")
    found = spark.read.format("binaryFile").load(path).select(file_number("path").alias("n"), "content").collect()
    assert {r["n"]: bytes(r["content"]) for r in found} == {1: b"a;b\n\xe9\n", 2: b"\n", 3: b"x\nx\n"}


def test_no_texts_make_an_empty_folder(spark):
    path = written_texts(spark.createDataFrame([], "file_id long, content string"), "none")
    assert read_files(spark, path).count() == 0


def test_files_are_read_once(spark, tmp_path):
    folder = tmp_path / "once"
    folder.mkdir()
    for name, content in {"a.csv": b"k;v\n1;2\n", "b.csv": b"", "c+ d.csv": b"k\n\xe9\n"}.items():
        (folder / name).write_bytes(content)
    profile = profile_files(read_files(spark, str(folder)))
    shutil.rmtree(folder)
    facts = {r["path"].rsplit("/", 1)[-1]: (r["length"], r["bad_lines"], r["has_data"]) for r in profile.collect()}
    assert facts == {"a.csv": (8, 0, True), "b.csv": (0, 0, False), "c+ d.csv": (4, 1, True)}
    assert {r["code"] for r in file_issues(profile).collect()} == {"EMPTY_FILE", "ENCODING_ERROR"}
