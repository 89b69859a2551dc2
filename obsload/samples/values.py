"""Lenient casts, text checks and defaults on dirtied columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsload.functions import dates, scalars
from obsload.operators.issues import Check, long_issues, with_issues
from obsload.operators.mapping import extra_map
from obsload.operators.rows import count_columns, counts_disordered
from obsload.operators.sets import range_checks, url_check
from obsload.samples.registry import case, query, table, text

_DIRTY_DATES_SQL = """
SELECT o_orderkey, CASE o_orderkey % 8
  WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
  WHEN 2 THEN '  ' || strftime(o_orderdate, '%Y.%m.%d') || '   9:05 '
  WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 13h05m'
  WHEN 4 THEN strftime(o_orderdate, '%d-%m-%Y') || ' 7'
  WHEN 5 THEN 'n/a'
  WHEN 6 THEN '2020-02-30'
  ELSE strftime(o_orderdate, '%Y/%m/%d') || ' 10:11:12.500000' END AS txt
FROM orders"""

# the formats the dirtied texts use, tried in turn on the tidied text
_PARSED_SQL = """coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%d-%m-%Y'),
  try_strptime(v, '%Y-%m-%d %H-%M'), try_strptime(v, '%Y-%m-%d %Hh%Mm'),
  try_strptime(v, '%d-%m-%Y %H'), try_strptime(v, '%Y-%m-%d %H-%M-%S-%f'))"""


def dirty_dates(spark, folder):
    orders = table(spark, folder, "orders")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    french = F.date_format("o_orderdate", "dd/MM/yyyy")
    return orders.select(
        "o_orderkey",
        case(
            F.col("o_orderkey"),
            8,
            iso,
            french,
            F.concat(F.lit("  "), F.date_format("o_orderdate", "yyyy.MM.dd"), F.lit("   9:05 ")),
            F.concat(iso, F.lit(" 13h05m")),
            F.concat(F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit(" 7")),
            "n/a",
            "2020-02-30",
            F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" 10:11:12.500000")),
        ).alias("txt"),
    )


@query(
    "lenient_dates",
    f"""WITH d AS ({_DIRTY_DATES_SQL}),
c AS (SELECT o_orderkey, txt,
  regexp_replace(regexp_replace(trim(txt), ' +', ' ', 'g'), '[/.:]', '-', 'g') AS v FROM d),
p AS (SELECT o_orderkey, txt, {_PARSED_SQL} AS t FROM c)
SELECT o_orderkey, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS parsed,
  CASE WHEN t IS NULL THEN 'INVALID_DATE' END AS code FROM p""",
)
def lenient_dates(spark, folder):
    parsed = dirty_dates(spark, folder).withColumn("t", dates.lenient_timestamp(F.col("txt")))
    return parsed.select(
        "o_orderkey",
        F.date_format("t", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"),
        F.when(F.col("t").isNull() & F.col("txt").isNotNull(), "INVALID_DATE").alias("code"),
    )


@query(
    "date_assembly",
    """WITH e AS (SELECT event_id,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS date_min,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE strftime(ts, '%H:%M:%S') END AS hour_min,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN strftime(ts, '%Y-%m-%d')
    ELSE strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') END AS date_max,
  CASE WHEN event_id % 5 < 2 THEN NULL ELSE '23:00:00' END AS hour_max FROM events)
SELECT event_id,
  date_min || ' ' || coalesce(hour_min, '00:00:00') AS start_text,
  coalesce(date_max, date_min) || ' ' || coalesce(hour_max,
    CASE WHEN date_min = coalesce(date_max, date_min) THEN coalesce(hour_min, '00:00:00') END,
    '00:00:00') AS end_text,
  coalesce(date_max, date_min) || ' ' || coalesce(hour_min, '00:00:00') AS end_no_hour_max,
  coalesce(date_max, date_min) || ' ' || coalesce(hour_max, '00:00:00') AS end_no_hour_min,
  date_min || ' ' || coalesce(hour_max, hour_min, '00:00:00') AS end_no_date_max FROM e""",
)
def date_assembly(spark, folder):
    key = F.col("event_id")
    day = F.date_format("ts", "yyyy-MM-dd")
    next_day = F.date_format(F.col("ts") + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd")
    cells = table(spark, folder, "events").select(
        "event_id",
        F.when(key % 13 != 0, day).alias("date_min"),
        F.when(key % 3 != 0, F.date_format("ts", "HH:mm:ss")).alias("hour_min"),
        case(key, 4, None, day, next_day).alias("date_max"),
        F.when(key % 5 >= 2, F.lit("23:00:00")).alias("hour_max"),
    )
    d0, d1, h0, h1 = (F.col(c) for c in ("date_min", "date_max", "hour_min", "hour_max"))
    return cells.select(
        "event_id",
        dates.start_text(d0, h0).alias("start_text"),
        dates.end_text(d0, d1, h0, h1).alias("end_text"),
        dates.end_text(d0, d1, h0, None).alias("end_no_hour_max"),
        dates.end_text(d0, d1, None, h1).alias("end_no_hour_min"),
        dates.end_text(d0, None, h0, h1).alias("end_no_date_max"),
    )


@query(
    "int_parse",
    """WITH p AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS VARCHAR)
  WHEN 1 THEN ' ' || p_size || ' ' WHEN 2 THEN p_size || '.5' WHEN 3 THEN p_name
  WHEN 4 THEN '-' || p_size ELSE '99999999999' END AS txt FROM part),
v AS (SELECT p_partkey, CASE WHEN regexp_matches(trim(txt), '^[+-]?[0-9]+$')
  THEN TRY_CAST(trim(txt) AS INTEGER) END AS n FROM p)
SELECT p_partkey, CAST(n AS VARCHAR) AS value,
  CASE WHEN n IS NULL THEN 'INVALID_INTEGER' END AS code FROM v""",
)
def int_parse(spark, folder):
    size = text("p_size")
    cells = table(spark, folder, "part").select(
        "p_partkey",
        case(
            F.col("p_partkey"),
            6,
            size,
            F.concat(F.lit(" "), size, F.lit(" ")),
            F.concat(size, F.lit(".5")),
            F.col("p_name"),
            F.concat(F.lit("-"), size),
            "99999999999",
        ).alias("txt"),
    )
    value = scalars.lenient_int(F.col("txt"))
    return cells.select(
        "p_partkey",
        text(value).alias("value"),
        F.when(value.isNull() & F.col("txt").isNotNull(), "INVALID_INTEGER").alias("code"),
    )


@query(
    "text_length",
    """SELECT doc_id, CASE WHEN length(text) > 1000 THEN 'INVALID_CHAR_LENGTH' END AS code
FROM documents""",
)
def text_length(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        F.when(scalars.too_long(F.col("text"), 1000), "INVALID_CHAR_LENGTH").alias("code"),
    )


_UUID_TEXT_SQL = """SELECT c_custkey, h, CASE c_custkey % 6 WHEN 0 THEN h WHEN 1 THEN d
  WHEN 2 THEN '{' || upper(d) || '}' WHEN 3 THEN 'urn:uuid:' || d WHEN 4 THEN substr(h, 1, 31)
  ELSE c_name END AS txt FROM (SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' ||
  substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS d
  FROM (SELECT c_custkey, c_name, md5(CAST(c_custkey AS VARCHAR)) AS h FROM customer))"""


@query(
    "uuid_normalise",
    f"""WITH t AS ({_UUID_TEXT_SQL})
SELECT c_custkey, CASE WHEN c_custkey % 6 < 4 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) ||
  '-4' || substr(h, 14, 3) || '-' ||
  substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) ||
  substr(h, 18, 3) || '-' || substr(h, 21) END AS id,
  CASE WHEN c_custkey % 6 >= 4 THEN 'INVALID_UUID' END AS code FROM t""",
)
def uuid_normalise(spark, folder):
    digest = F.md5(text("c_custkey"))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    dashed = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts])
    cells = table(spark, folder, "customer").select(
        "c_custkey",
        case(
            F.col("c_custkey"),
            6,
            digest,
            dashed,
            F.concat(F.lit("{"), F.upper(dashed), F.lit("}")),
            F.concat(F.lit("urn:uuid:"), dashed),
            F.substring(digest, 1, 31),
            F.col("c_name"),
        ).alias("txt"),
    )
    found = scalars.normal_uuid(F.col("txt"))
    return cells.select(
        "c_custkey", found.alias("id"), F.when(found.isNull(), "INVALID_UUID").alias("code")
    )


@query(
    "uuid_generation",
    """WITH d AS (SELECT c_custkey, sha256('salt|1|' || c_custkey) AS h FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'given-' || c_custkey ELSE
  substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' ||
  substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) ||
  substr(h, 18, 3) || '-' || substr(h, 21, 12) END AS id FROM d""",
)
def uuid_generation(spark, folder):
    own = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("given-"), text("c_custkey")))
    made = scalars.row_uuid("salt", F.lit(1), F.col("c_custkey"))
    return table(spark, folder, "customer").select("c_custkey", F.coalesce(own, made).alias("id"))


@query(
    "count_defaults",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_quantity AS INTEGER) END AS lo,
  CASE WHEN l_orderkey % 4 = 0 THEN NULL
    ELSE CAST(l_quantity AS INTEGER) + CAST(l_orderkey % 5 AS INTEGER) - 1 END AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey,
  coalesce(lo, 1) AS count_min, coalesce(hi, lo, 1) AS count_max,
  coalesce(coalesce(lo, 1) > hi, false) AS disordered,
  coalesce(lo, 1) AS only_min, coalesce(hi, 1) AS only_max, 1 AS neither FROM l""",
)
def count_defaults(spark, folder):
    quantity = F.col("l_quantity").cast("int")
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(F.col("l_linenumber") % 3 != 0, quantity).alias("lo"),
        F.when(
            F.col("l_orderkey") % 4 != 0, quantity + (F.col("l_orderkey") % 5).cast("int") - 1
        ).alias("hi"),
    )
    lo, hi = F.col("lo"), F.col("hi")
    count_min, count_max = count_columns(lo, hi, 1)
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        count_min.alias("count_min"),
        count_max.alias("count_max"),
        F.coalesce(counts_disordered(lo, hi, 1), F.lit(False)).alias("disordered"),
        count_columns(lo, None, 1)[1].alias("only_min"),
        count_columns(None, hi, 1)[0].alias("only_max"),
        count_columns(None, None, 1)[0].alias("neither"),
    )


@query(
    "min_max_checks",
    """WITH p AS (SELECT p_partkey + 1 AS line_no, p_size - 3 AS a0,
  20 - CAST(p_partkey % 30 AS INTEGER) AS a1, CAST(p_partkey % 9 AS INTEGER) - 1 AS d0,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size % 5 END AS d1 FROM part),
i AS (SELECT line_no, 'INVALID_INTEGER' AS code, 'altitude_min' AS "column" FROM p WHERE a0 < 0
UNION ALL SELECT line_no, 'INVALID_INTEGER', 'altitude_max' FROM p WHERE a1 < 0
UNION ALL SELECT line_no, 'ALTI_MIN_SUP_ALTI_MAX', 'altitude_min' FROM p WHERE a0 > a1
UNION ALL SELECT line_no, 'INVALID_INTEGER', 'depth_min' FROM p WHERE d0 < 0
UNION ALL SELECT line_no, 'INVALID_INTEGER', 'depth_max' FROM p WHERE d1 < 0
UNION ALL SELECT line_no, 'DEPTH_MIN_SUP_ALTI_MAX', 'depth_min' FROM p WHERE d0 > d1)
SELECT * FROM i""",
)
def min_max_checks(spark, folder):
    key = F.col("p_partkey")
    rows = table(spark, folder, "part").select(
        F.lit(1).alias("id_load"),
        (key + 1).alias("line_no"),
        (F.col("p_size") - 3).alias("altitude_min"),
        (20 - key % 30).cast("int").alias("altitude_max"),
        (key % 9 - 1).cast("int").alias("depth_min"),
        F.when(key % 4 != 0, F.col("p_size") % 5).alias("depth_max"),
    )
    checks = range_checks("altitude_min", "altitude_max", "ALTI_MIN_SUP_ALTI_MAX", str)
    checks += range_checks("depth_min", "depth_max", "DEPTH_MIN_SUP_ALTI_MAX", str)
    return long_issues(with_issues(rows, checks)).select("line_no", "code", "column")


@query(
    "missing_required",
    """SELECT c_custkey + 1 AS line_no, 'MISSING_VALUE' AS code, 'nom_cite' AS "column"
FROM customer WHERE nullif(CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN NULL
  ELSE c_name END, '') IS NULL""",
)
def missing_required(spark, folder):
    key = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(
        F.lit(1).alias("id_load"),
        (key + 1).alias("line_no"),
        F.when(key % 7 == 0, "").when(key % 11 == 0, None).otherwise(F.col("c_name")).alias("nom_cite"),
    )
    check = Check("MISSING_VALUE", "nom_cite", scalars.cell("nom_cite").isNull())
    return long_issues(with_issues(rows, [check])).select("line_no", "code", "column")


_URL_SQL = scalars.URL_PATTERN.replace("'", "''")


@query(
    "url_check",
    f"""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url
  WHEN 1 THEN replace(url, '://', ':/') WHEN 2 THEN 'http://host' WHEN 3 THEN ''
  WHEN 4 THEN NULL ELSE regexp_replace(url, '^[a-z]+://', '') END AS link FROM pages)
SELECT page_id, link, CASE WHEN link <> '' AND NOT regexp_matches(link, '{_URL_SQL}')
  THEN 'INVALID_URL_PROOF' END AS code FROM p""",
)
def url_checks(spark, folder):
    url = F.col("url")
    rows = table(spark, folder, "pages").select(
        "page_id",
        case(
            F.col("page_id"),
            6,
            url,
            F.replace(url, F.lit("://"), F.lit(":/")),
            "http://host",
            "",
            None,
            F.regexp_replace(url, "^[a-z]+://", ""),
        ).alias("link"),
    )
    check = url_check("link", "digital_proof")
    return rows.select("page_id", "link", F.when(check.condition, check.code).alias("code"))


@query(
    "extra_fields_map",
    """SELECT event_id, 'event_type=' || event_type || ';props=' || props || ';user_id=' || user_id
  AS pairs FROM events""",
)
def extra_fields_map(spark, folder):
    rows = table(spark, folder, "events").withColumn("extra", extra_map(["event_type", "user_id", "props"]))
    entries = F.array_sort(F.map_entries("extra"))
    joined = F.array_join(
        F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";"
    )
    return rows.select("event_id", joined.alias("pairs"))


@query(
    "multi_to_json",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, event_type,
  CAST(user_id AS VARCHAR) AS user_id FROM events""",
)
def multi_to_json(spark, folder):
    rows = table(spark, folder, "events").withColumn("user_id", text("user_id"))
    merged = rows.select(
        "event_id", scalars.merged_attributes(["props", "event_type", "user_id"]).alias("j")
    )
    return merged.select(
        "event_id",
        F.get_json_object("j", "$.k").alias("k"),
        F.get_json_object("j", "$.event_type").alias("event_type"),
        F.get_json_object("j", "$.user_id").alias("user_id"),
    )
