"""File sources and sinks, on files written from the tables, and the whole pipeline over them."""

from __future__ import annotations

import datetime as dt
import re
from contextlib import contextmanager

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import functions as F

from obsload.functions.geometry import parse_wkt
from obsload.model.error_types import error_table
from obsload.model.loads import Dimensions, Load, Settings
from obsload.operators.issues import Check, report_rows
from obsload.plans.check import check_load
from obsload.plans.load import load_files, stage
from obsload.samples.registry import query, table, text
from obsload.samples.spatial import square_wkt
from obsload.sinks.tables import replace_partition, write_delimited
from obsload.sources.delimited import numbered, ragged_issues, read_delimited, without_blank_records
from obsload.sources.geojson import read_geojson
from obsload.sources.profile import file_issues, header_differs, profile_files, read_files
from obsload.sources.split import read_records
from obsload.sources.staging import read_staging
from obsload.workspace import work_path

LINES_PER_FILE = 5000
TEXTS_AT_ONCE = 64  # a text may have some megabytes


@contextmanager
def setting(spark, values):
    """Session settings that hold inside only."""
    before = {n: spark.conf.get(n, None) for n in values}
    try:
        for n, v in values.items():
            spark.conf.set(n, v)
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def file_blocks(spark, size):
    """Files are cut into blocks of so many bytes, as large files are anyway."""
    return setting(spark, {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": 1024})


def written_csv(df, label):
    path = work_path(df.sparkSession, label)
    write_delimited(df, path, ";")
    return path


def written_texts(df, label):
    """One text file per row ``(file_id, content)``; rows of one number share a file, line by line.

    Tasks write the files, all into one folder: a partitioned write makes a folder for each, which a local file
    system starts processes for, its driver moves them one by one, and a reader lists them by a task each.
    """
    spark, path = df.sparkSession, work_path(df.sparkSession, label)
    system, folder = _place(path)
    system.create_dir(folder, recursive=True)
    rows = df.select("file_id", F.col("content").cast("binary").alias("content"))
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file_id").sortWithinPartitions("file_id")
    with setting(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": TEXTS_AT_ONCE}):
        dealt.mapInArrow(_files_written(path), "files long").agg(F.sum("files")).collect()
    return path


def _place(path):
    """File system and folder of an address."""
    local = re.sub("^file:/+", "/", path)
    return (LocalFileSystem(), local) if local.startswith("/") else FileSystem.from_uri(path)


def _files_written(path):
    """Writes the rows of a task, which come in the order of their numbers; a repeated task writes the same again."""

    def write(batches):
        system, folder = _place(path)
        number, out, n = None, None, 0
        for batch in batches:
            for key, content in zip(batch["file_id"].to_pylist(), batch["content"].to_pylist(), strict=True):
                if out is None or key != number:
                    if out is not None:
                        out.close()
                    number, n = key, n + 1
                    out = system.open_output_stream(f"{folder}/file_id={'none' if key is None else key}.txt")
                out.write((content or b"") + b"\n")
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    return write


def file_number(column="_file"):
    return F.regexp_extract(column, r"file_id=(\d+)", 1).cast("long")


_CELLS_SQL = """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL
  ELSE o_orderpriority END AS priority, 'first; "quoted"' || chr(10) || 'second ' || o_custkey AS note FROM orders"""


def noted_orders(spark, folder):
    note = F.concat(F.lit('first; "quoted"\nsecond '), text("o_custkey"))
    return table(spark, folder, "orders").select(
        text("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("priority"),
        note.alias("note"),
    )


@query("delimited_source", _CELLS_SQL)
def delimited_source(spark, folder):
    """Quoted cells with separators, quotes and line breaks come back unchanged."""
    path = written_csv(noted_orders(spark, folder), "noted")
    return read_delimited(spark, path, ["id", "priority", "note"]).select("id", "priority", "note")


@query(
    "record_numbering",
    """SELECT o_orderkey, o_orderkey // 5000 AS id_load,
  row_number() OVER (PARTITION BY o_orderkey // 5000 ORDER BY o_orderkey) AS line_no
FROM orders WHERE o_orderkey % 10 <> 4""",
)
def record_numbering(spark, folder):
    """Records count from 1 in each file; empty records are counted, then dropped."""
    key = F.col("o_orderkey")
    line = F.when(key % 10 != 4, F.concat_ws(";", key, "o_orderstatus")).otherwise(F.lit(";"))
    listed = table(spark, folder, "orders").groupBy(F.floor(key / LINES_PER_FILE).alias("file_id")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(key, line.alias("line")))), lambda s: s["line"]),
            "\n",
        ).alias("lines")
    )
    path = written_texts(
        listed.select("file_id", F.concat(F.lit("id;status\n"), F.col("lines")).alias("content")), "numbered"
    )
    columns = ["id", "status"]
    raw = read_delimited(spark, path, columns).withColumn("id_load", file_number())
    kept = without_blank_records(numbered(raw), columns)
    # numbers of kept records, closed up where empty ones were dropped
    return kept.select(
        F.col("id").cast("long").alias("o_orderkey"),
        "id_load",
        (F.col("line_no") - F.floor((F.col("line_no") + 5) / 10)).alias("line_no"),
    )


@query(
    "delimited_split_multiline",
    """SELECT o_orderkey, o_orderkey // 5000 AS id_load,
  row_number() OVER (PARTITION BY o_orderkey // 5000 ORDER BY o_orderkey) AS line_no,
  'one; "' || o_custkey || '"' || chr(10) || chr(10) || 'two;' || repeat('x', CAST(o_orderkey % 300 AS INTEGER)) AS note
FROM orders""",
)
def delimited_split_multiline(spark, folder):
    """Files whose cells hold line breaks, quotes and separators, read in blocks that cut cells anywhere."""
    key = F.col("o_orderkey")
    filler = F.repeat(F.lit("x"), (key % 300).cast("int"))
    note = F.concat(F.lit('"one; ""'), F.col("o_custkey"), F.lit('""\n\ntwo;'), filler, F.lit('"'))
    listed = table(spark, folder, "orders").groupBy(F.floor(key / LINES_PER_FILE).alias("file_id")).agg(
        F.array_sort(F.collect_list(F.struct(key, F.concat_ws(";", key, note).alias("line")))).alias("lines")
    )
    lines = F.array_join(F.transform("lines", lambda s: s["line"]), "\n")
    path = written_texts(listed.select("file_id", F.concat(F.lit("id;note\n"), lines).alias("content")), "split")
    with file_blocks(spark, 256 * 1024):
        records = read_records(spark, path, ["id", "note"], id_load=file_number())
    return records.select(F.col("id").cast("long").alias("o_orderkey"), F.col("id_load").cast("long"), "line_no", "note")


@query(
    "ragged_records",
    """SELECT o_orderkey // 5000 AS id_load, o_orderkey % 5000 + 1 AS line_no,
  CASE WHEN o_orderkey % 11 = 0 THEN 'ROW_HAVE_TOO_MUCH_COLUMN' ELSE 'ROW_HAVE_LESS_COLUMN' END AS code
FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0""",
)
def ragged_records(spark, folder):
    key = F.col("o_orderkey")
    line = (
        F.when(key % 11 == 0, F.concat(text(key), F.lit(';"a;b";c;d')))
        .when(key % 13 == 0, F.concat(text(key), F.lit(";x")))
        .otherwise(F.concat(text(key), F.lit(';"a;b";c')))
    )
    listed = table(spark, folder, "orders").groupBy(F.floor(key / LINES_PER_FILE).alias("file_id")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(key, line.alias("line")))), lambda s: s["line"]),
            "\n",
        ).alias("lines")
    )
    path = written_texts(
        listed.select("file_id", F.concat(F.lit("k;a;b\n"), F.col("lines")).alias("content")), "ragged"
    )
    columns = ["k", "a", "b"]
    records = numbered(read_delimited(spark, path, columns).withColumn("id_load", file_number()))
    return ragged_issues(records, columns, ";").select("id_load", "line_no", "code")


@query(
    "file_profile",
    """SELECT s_suppkey AS file_id, CASE s_suppkey % 8 WHEN 1 THEN ',' WHEN 2 THEN NULL WHEN 6 THEN NULL
    ELSE ';' END AS separator,
  CASE s_suppkey % 8 WHEN 2 THEN 1 WHEN 6 THEN 1 WHEN 3 THEN 3 ELSE 2 END AS n_columns,
  CASE s_suppkey % 8 WHEN 2 THEN 'FILE_FORMAT_ERROR' WHEN 3 THEN 'HEADER_SAME_COLUMN_NAME'
    WHEN 4 THEN 'FILE_WITH_NO_DATA' WHEN 5 THEN 'HEADER_COLUMN_EMPTY' END AS code FROM supplier""",
)
def file_profile(spark, folder):
    key = F.col("s_suppkey")
    heads = ["a;b", "a,b", "", "a;b;a", "a;b", "a;", "a", 'a;"b,c,d"']
    header = F.element_at(F.array(*[F.lit(h) for h in heads]), (key % 8 + 1).cast("int"))
    body = F.when(key % 8 != 4, F.concat(F.lit("\n"), F.col("s_name"), F.lit(";x"))).otherwise("")
    path = written_texts(
        table(spark, folder, "supplier").select(key.alias("file_id"), F.concat(header, body).alias("content")),
        "profiled",
    )
    profile = profile_files(read_files(spark, path))
    faults = file_issues(profile).where("code <> 'FILE_EXTENSION_ERROR'")
    return profile.join(faults, "path", "left").select(
        file_number("path").alias("file_id"), "separator", F.size("columns").alias("n_columns"), "code"
    )


@query(
    "geojson_source",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0
  THEN 'LINESTRING (' || c_custkey % 90 || ' 1, 2 3.5)' WHEN c_custkey % 3 = 1
  THEN 'POLYGON ((0 0, ' || c_custkey % 90 + 1 || ' 0, 0 1, 0 0))'
  ELSE 'POINT (' || c_custkey % 90 || ' 7.25)' END AS wkt FROM customer""",
)
def geojson_source(spark, folder):
    key = F.col("c_custkey")

    def shape(kind, coordinates):
        return F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), coordinates, F.lit("}"))

    geometry = (
        F.when(
            key % 3 == 0,
            shape("LineString", F.concat(F.lit("[["), text(key % 90), F.lit(",1],[2,3.5]]"))),
        )
        .when(
            key % 3 == 1,
            shape("Polygon", F.concat(F.lit("[[[0,0],["), text(key % 90 + 1), F.lit(",0],[0,1],[0,0]]]"))),
        )
        .otherwise(shape("Point", F.concat(F.lit("["), text(key % 90), F.lit(",7.25]"))))
    )
    feature = F.concat(
        F.lit('{"type":"Feature","properties":'),
        F.to_json(F.struct(key.alias("id"), F.col("c_name").alias("name"))),
        F.lit(',"geometry":'),
        geometry,
        F.lit("}"),
    )
    collections = table(spark, folder, "customer").groupBy(F.floor(key / LINES_PER_FILE).alias("file_id")).agg(
        F.concat(
            F.lit('{"type":"FeatureCollection","features":['),
            F.array_join(F.collect_list(feature), ","),
            F.lit("]}"),
        ).alias("content")
    )
    path = written_texts(collections, "features")
    return read_geojson(spark, path, ["id", "name"], "wkt")


@query(
    "staging_roundtrip",
    """SELECT o_custkey % 4 AS id_load, o_orderkey + 1 AS line_no, o_orderstatus FROM orders WHERE o_custkey % 4 = 2""",
)
def staging_roundtrip(spark, folder):
    """Staging the same loads twice leaves one copy of each."""
    rows = table(spark, folder, "orders").select(
        (F.col("o_custkey") % 4).alias("id_load"),
        (F.col("o_orderkey") + 1).alias("line_no"),
        "o_orderstatus",
        "o_orderpriority",
    )
    path = work_path(spark, "staging")
    replace_partition(rows, path, "id_load")
    replace_partition(rows.where("id_load = 2"), path, "id_load")
    return read_staging(spark, path, 2, ["o_orderstatus"]).select(
        F.col("id_load").cast("long").alias("id_load"), "line_no", "o_orderstatus"
    )


# --- the whole pipeline -------------------------------------------------------------------------

AS_OF = dt.date(2001, 1, 1)
MAPPING = {
    "entity_source_pk_value": "ident",
    "date_min": "debut",
    "date_max": "fin",
    "cd_nom": "taxon",
    "nom_cite": "nom",
    "WKT": "position",
    "codecommune": "commune",
    "count_min": "nb_min",
    "count_max": "nb_max",
    "id_nomenclature_life_stage": "stade",
    "comment_description": "remarque",
}

OBSERVED_SQL = """o AS (SELECT o_orderkey AS k, o_custkey, o_orderdate AS d0,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate ELSE o_orderdate + to_days(CAST(o_orderkey % 7 - 1 AS INTEGER)) END AS d1,
  CASE WHEN o_orderkey % 50 = 0 THEN 'dup' || o_orderkey // 100 WHEN o_orderkey % 51 = 0 THEN NULL
    ELSE 'k' || o_orderkey END AS pk, o_orderstatus AS st FROM orders),
rc AS (SELECT k, 'MISSING_VALUE' AS code, 'debut' AS col FROM o WHERE k % 20 = 0
  UNION ALL SELECT k, 'INVALID_DATE', 'debut' FROM o WHERE k % 20 <> 0 AND k % 21 = 0
  UNION ALL SELECT k, 'INVALID_DATE', 'fin' FROM o WHERE k % 20 <> 0 AND k % 21 = 0 AND k % 4 = 0
  UNION ALL SELECT k, 'INVALID_INTEGER', 'taxon' FROM o WHERE k % 33 = 0
  UNION ALL SELECT k, 'INVALID_WKT', 'position' FROM o WHERE k % 5 <> 0 AND k % 17 = 0
  UNION ALL SELECT k, 'GEOMETRY_OUT_OF_BOX', 'position' FROM o WHERE k % 5 <> 0 AND k % 17 <> 0 AND k % 29 = 0
  UNION ALL SELECT k, 'COUNT_MIN_SUP_COUNT_MAX', 'nb_min' FROM o WHERE k % 6 <> 0 AND k % 3 = 0),
ok AS (SELECT * FROM o WHERE k NOT IN (SELECT k FROM rc)),
found AS (SELECT * FROM rc
  UNION ALL SELECT k, 'INVALID_ATTACHMENT_CODE', 'commune' FROM ok WHERE k % 5 = 0 AND k % 30 >= 25
  UNION ALL SELECT k, 'CD_NOM_NOT_FOUND', 'taxon' FROM ok WHERE o_custkey NOT IN
    (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)
  UNION ALL SELECT k, 'DUPLICATE_ENTITY_SOURCE_PK', 'ident' FROM o WHERE pk IN
    (SELECT pk FROM o GROUP BY pk HAVING count(*) > 1)
  UNION ALL SELECT k, 'INVALID_NOMENCLATURE', 'stade' FROM o WHERE st = 'P'
  UNION ALL SELECT k, 'DATE_MIN_TOO_HIGH', 'debut' FROM ok WHERE d0 > TIMESTAMP '2001-01-01'
  UNION ALL SELECT k, 'DATE_MAX_TOO_HIGH', 'fin' FROM ok WHERE d1 > TIMESTAMP '2001-01-01'
    AND d0 <= TIMESTAMP '2001-01-01'
  UNION ALL SELECT k, 'DATE_MIN_SUP_DATE_MAX', 'debut' FROM ok WHERE d0 > d1)"""


def observed(spark, folder):
    """Orders as an observation file with faults of every family."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    later = F.date_format(
        F.col("o_orderdate") + F.make_dt_interval((k % 7 - 1).cast("int")), "yyyy-MM-dd"
    )
    place = F.concat(F.lit("POINT("), text(k % 100 - 5), F.lit(".5 "), text(k % 9 + 41), F.lit(".25)"))
    return table(spark, folder, "orders").select(
        F.when(k % 50 == 0, F.concat(F.lit("dup"), text(F.floor(k / 100))))
        .when(k % 51 == 0, None)
        .otherwise(F.concat(F.lit("k"), text(k)))
        .alias("ident"),
        F.when(k % 20 == 0, None).when(k % 21 == 0, "n/a").otherwise(day).alias("debut"),
        F.when(k % 4 != 0, later).alias("fin"),
        F.when(k % 33 == 0, "abc").otherwise(text(c)).alias("taxon"),
        F.col("o_orderpriority").alias("nom"),
        F.when(k % 5 == 0, None)
        .when(k % 17 == 0, "POINT(x y)")
        .when(k % 29 == 0, "POINT(200.5 10)")
        .otherwise(place)
        .alias("position"),
        F.when(k % 5 == 0, F.concat(F.lit("NATION_"), text(k % 30))).alias("commune"),
        text(c % 9).alias("nb_min"),
        F.when(k % 6 != 0, text(c % 9 + k % 3 - 1)).alias("nb_max"),
        F.col("o_orderstatus").alias("stade"),
        text(k).alias("remarque"),
    )


def dimensions(spark, folder):
    """Customers as taxa, order states as a vocabulary, nations as municipalities."""
    taxa = table(spark, folder, "customer").where("c_custkey % 10 <> 0").select(
        F.col("c_custkey").cast("int").alias("cd_nom"), F.col("c_mktsegment").alias("regne")
    )
    states = table(spark, folder, "orders").select("o_orderstatus").distinct()
    vocabulary = states.where("o_orderstatus <> 'P'").select(
        F.lit("STADE_VIE").alias("vocab"),
        F.col("o_orderstatus").alias("code"),
        F.col("o_orderstatus").alias("label"),
        F.ascii("o_orderstatus").alias("id"),
        F.lit(False).alias("is_default"),
    )
    n = F.col("n_nationkey")
    areas = table(spark, folder, "nation").select(
        n.alias("id_area"),
        F.lit("COM").alias("type"),
        F.col("n_name").alias("code"),
        parse_wkt(square_wkt(n * 1000 + 700000, n * 1000 + 6600000, 1000)).alias("geom"),
    )
    return Dimensions(taxa=taxa, vocabulary=vocabulary, areas=areas)


def checked_observations(spark, folder):
    source = observed(spark, folder)
    path = written_csv(source, "observed")
    load = Load(
        1,
        tuple(source.columns),
        MAPPING,
        {"STADE_VIE": {"F": "F", "O": "O", "P": "P"}},
        id_dataset=1,
        id_source=1,
    )
    settings = Settings(as_of=AS_OF, check_literature_reference=False)
    # the file has no line breaks in cells, so a large one may be split
    staged = load_files(spark, path, load, multiline=False)
    return check_load(staged.rows, load, dimensions(spark, folder), settings)


@query(
    "observation_report",
    f"""WITH {OBSERVED_SQL} SELECT code, col AS "column", 'ERROR' AS level, count(*) AS n_lines
FROM found GROUP BY ALL""",
)
def observation_report(spark, folder):
    """File to report: read, number, stage, check everything, aggregate the issues."""
    checked = checked_observations(spark, folder)
    return report_rows(checked.issues, error_table(spark)).select("code", "column", "level", "n_lines")


@query(
    "observation_validity",
    f"""WITH {OBSERVED_SQL} SELECT k, k NOT IN (SELECT k FROM found) AS valid,
  CASE WHEN k NOT IN (SELECT k FROM rc) THEN strftime(d0, '%Y-%m-%d') END AS start,
  CASE WHEN k NOT IN (SELECT k FROM rc) THEN CAST(o_custkey AS VARCHAR) END AS taxon,
  CASE WHEN k NOT IN (SELECT k FROM rc) AND k % 5 = 0 AND k % 30 < 25 THEN CAST(k % 30 AS VARCHAR) END AS area
FROM o""",
)
def observation_validity(spark, folder):
    rows = checked_observations(spark, folder).rows
    return rows.select(
        F.col("comment_description").cast("long").alias("k"),
        "valid",
        F.date_format("datetime_min", "yyyy-MM-dd").alias("start"),
        text("cd_nom").alias("taxon"),
        text("id_area_attachment").alias("area"),
    )


def supplier_files(spark, folder, content, label):
    """One file for each supplier; its bytes may be anything."""
    rows = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("file_id"), content.alias("content"))
    return written_texts(rows, label)


@query(
    "header_mismatch",
    """SELECT s_suppkey AS file_id, CASE s_suppkey % 4 WHEN 1 THEN 'name;key' WHEN 2 THEN 'key;name;more' ELSE 'Key;name' END AS header
FROM supplier WHERE s_suppkey % 4 <> 0""",
)
def header_mismatch(spark, folder):
    """Files whose first record is not the declared list of columns, in its order."""
    k = F.col("s_suppkey")
    header = F.when(k % 4 == 0, 'key;"name"').when(k % 4 == 1, "name;key").when(k % 4 == 2, "key;name;more").otherwise("Key;name")
    path = supplier_files(spark, folder, F.concat(header, F.lit("\r\n"), text(k), F.lit(";"), F.col("s_name")), "headers")
    other = header_differs(profile_files(read_files(spark, path)), ["key", "name"])
    return other.select(file_number("path").alias("file_id"), F.array_join("columns", ";").alias("header"))


@query(
    "encoding_faults",
    """SELECT s_suppkey AS file_id, s_suppkey % 3 AS bad_lines, CASE WHEN s_suppkey % 3 > 0 THEN 'ENCODING_ERROR' END AS code
FROM supplier""",
)
def encoding_faults(spark, folder):
    """Lines whose bytes are not UTF-8, counted by file."""
    k = F.col("s_suppkey")
    odd = F.concat(F.unhex(F.lit("E9")).cast("string"), F.lit(";x"))
    body = F.concat(F.lit("a;b\né;1\n"), F.when(k % 3 > 0, F.concat(odd, F.lit("\n"))).otherwise(""), F.when(k % 3 > 1, odd).otherwise(""))
    profile = profile_files(read_files(spark, supplier_files(spark, folder, body, "encoded")))
    faults = file_issues(profile).where("code = 'ENCODING_ERROR'")
    return profile.join(faults, "path", "left").select(file_number("path").alias("file_id"), "bad_lines", "code")


@query(
    "oversize_files",
    """SELECT s_suppkey AS file_id, 6 + s_suppkey % 50 AS length, CASE WHEN s_suppkey % 50 > 34 THEN 'FILE_OVERSIZE' END AS code
FROM supplier""",
)
def oversize_files(spark, folder):
    """Sizes come from the listing; files over the limit are told without being read."""
    content = F.concat(F.lit("a;b\n1"), F.repeat(F.lit("2"), (F.col("s_suppkey") % 50).cast("int")))
    profile = profile_files(read_files(spark, supplier_files(spark, folder, content, "sized")))
    faults = file_issues(profile, max_size=41).where("code = 'FILE_OVERSIZE'")
    return profile.join(faults, "path", "left").select(file_number("path").alias("file_id"), "length", "code")


_KEYED_SQL = """r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN c_custkey // 14 * 14 ELSE c_custkey END AS n,
  CASE WHEN c_custkey % 10 = 0 THEN 'same' || (c_custkey // 20) WHEN c_custkey % 11 <> 0 THEN 'k' || c_custkey END AS pk,
  c_name FROM customer)"""


@query(
    "load_key_checks",
    f"""WITH {_KEYED_SQL}, f AS (
  SELECT k, 'DUPLICATE_ENTITY_SOURCE_PK' AS code, 'cle' AS col FROM r WHERE pk IN (SELECT pk FROM r GROUP BY pk HAVING count(*) > 1)
  UNION ALL SELECT k, 'DUPLICATE_UUID', 'ident' FROM r WHERE n IN (SELECT n FROM r GROUP BY n HAVING count(*) > 1)
  UNION ALL SELECT k, 'EXISTING_UUID', 'ident' FROM r WHERE n IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0)
  UNION ALL SELECT k, 'INVALID_NOMENCLATURE', 'flou' FROM r WHERE k % 4 >= 2
  UNION ALL SELECT k, 'CONDITIONAL_MANDATORY_FIELD_ERROR', 'flou' FROM r WHERE k % 4 >= 2
  UNION ALL SELECT k, 'OWN_NAME', 'nom' FROM r WHERE c_name LIKE '%7')
SELECT k + 1 AS line_no, code, col AS "column" FROM f""",
)
def load_key_checks(spark, folder):
    """Keys of the source, identifiers, blurring of private data and a check of the caller, through the whole check."""
    k = F.col("c_custkey")
    number = F.when(k % 7 == 0, F.floor(k / 14) * 14).otherwise(k)

    def identifier(n):
        return F.format_string("%08x-0000-4000-8000-000000000000", n.cast("long"))

    records = table(spark, folder, "customer").select(
        F.lit(1).alias("id_load"),
        (k + 1).cast("long").alias("line_no"),
        F.when(k % 10 == 0, F.concat(F.lit("same"), text(F.floor(k / 20))))
        .when(k % 11 != 0, F.concat(F.lit("k"), text(k)))
        .alias("cle"),
        identifier(number).alias("ident"),
        F.lit("2000-01-01").alias("debut"),
        F.col("c_name").alias("nom"),
        F.lit("POINT(3.5 46.25)").alias("place"),
        F.when(k % 4 == 0, "oui").when(k % 4 == 1, "non").when(k % 4 == 2, "si").alias("flou"),
    )
    mapping = {
        "entity_source_pk_value": "cle", "unique_id_sinp": "ident", "date_min": "debut", "nom_cite": "nom",
        "WKT": "place", "id_nomenclature_blurring": "flou",
    }
    columns = tuple(c for c in records.columns if c not in ("id_load", "line_no"))
    content = {"DEE_FLOU": {"oui": "OUI", "non": "NON"}}
    load = Load(1, columns, mapping, content, id_dataset=1, id_source=1, private_dataset=True)
    terms = spark.createDataFrame(
        [("DEE_FLOU", "OUI", "Oui", 1, False), ("DEE_FLOU", "NON", "Non", 2, False)],
        "vocab string, code string, label string, id int, is_default boolean",
    )
    target = table(spark, folder, "orders").where("o_custkey % 3 = 0").select(
        identifier(F.col("o_custkey")).alias("unique_id_sinp"), F.lit(1).alias("id_dataset"), F.lit(9).alias("id_source")
    )
    settings = Settings(
        as_of=AS_OF, check_literature_reference=False, check_existing_uuid=True, check_private_blurring=True,
        check_exist_proof=False, fill_missing_vocabulary=False,
    )
    own = Check("OWN_NAME", "nom", F.endswith("nom_cite", F.lit("7")), level="WARNING")
    dims = Dimensions(vocabulary=terms, target=target)
    return check_load(stage(records, load), load, dims, settings, extra_checks=[own]).issues.select("line_no", "code", "column")
