"""Duplicates, referentials, existing keys and issue reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from obsload.model.error_types import error_table
from obsload.operators import issues as issue_ops
from obsload.operators.issues import long_issues, with_issues
from obsload.operators.keyed import flag_duplicate_records, flag_duplicates, flag_existing, flag_unknown
from obsload.operators.sets import date_checks
from obsload.samples.registry import query, table, text
from obsload.sources.staging import batch_slice

AS_OF = dt.date(2000, 1, 1)


def lineitem_rows(spark, folder):
    """Line items with a row identity; (order, line number) repeats in the data."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"
    )


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS duplicated FROM lineitem""",
)
def duplicate_keys(spark, folder):
    rows = lineitem_rows(spark, folder)
    spread = F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    flagged = flag_duplicates(rows, ["l_orderkey", "l_linenumber"], "duplicated", spread)
    return flagged.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "duplicated")


@query(
    "duplicate_hot_key",
    """SELECT event_id, k, k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 AS duplicated
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'hot' WHEN event_id % 3 = 1 THEN NULL
  WHEN event_id % 2 = 0 THEN 'e' || event_id ELSE 'u' || user_id END AS k FROM events)""",
)
def duplicate_hot_key(spark, folder):
    """One key on a third of the rows and no key on another third."""
    key = F.col("event_id")
    made = (
        F.when(key % 3 == 0, "hot")
        .when(key % 3 == 1, None)
        .when(key % 2 == 0, F.concat(F.lit("e"), text("event_id")))
        .otherwise(F.concat(F.lit("u"), text("user_id")))
    )
    rows = table(spark, folder, "events").select("event_id", made.alias("k"))
    return flag_duplicates(rows, ["k"], "duplicated", key)


@query(
    "duplicate_rows",
    """SELECT doc_id, count(*) OVER (PARTITION BY text, lang, source) > 1 AS duplicated
FROM documents""",
)
def duplicate_rows(spark, folder):
    """Whole-record duplicates: records meet on a 256-bit digest of all their cells."""
    rows = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    flagged = flag_duplicate_records(rows, ["text", "lang", "source"], "duplicated", F.col("doc_id"))
    return flagged.select("doc_id", "duplicated")


@query(
    "referential_check",
    """SELECT l_orderkey, l_linenumber, l_partkey, 'CD_NOM_NOT_FOUND' AS code FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5)""",
)
def referential_check(spark, folder):
    known = table(spark, folder, "part").where("p_size > 5").select("p_partkey")
    rows = lineitem_rows(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey")
    spread = F.struct("l_orderkey", "l_linenumber")
    flagged = flag_unknown(rows, "l_partkey", known, "p_partkey", "missing", spread)
    return flagged.where("missing").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.lit("CD_NOM_NOT_FOUND").alias("code")
    )


@query(
    "referential_list",
    """WITH members AS (SELECT DISTINCT l_partkey % 7 AS id_list, p_partkey AS cd
  FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_brand LIKE 'Brand#1%')
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (
  SELECT 1 FROM part p JOIN members m ON m.cd = p.p_partkey
  WHERE p.p_partkey = l_partkey AND m.id_list = 3)""",
)
def referential_list(spark, folder):
    """Referential restricted to the members of one list, built before the rows meet it."""
    part = table(spark, folder, "part")
    ordered = table(spark, folder, "lineitem").select("l_partkey").distinct()
    members = (
        part.where(F.col("p_brand").startswith("Brand#1"))
        .join(ordered, F.col("p_partkey") == F.col("l_partkey"))
        .select((F.col("l_partkey") % 7).alias("id_list"), F.col("p_partkey").alias("cd"))
    )
    listed = members.where("id_list = 3").select("cd")
    known = part.select(F.col("p_partkey").alias("cd")).join(listed, "cd", "left_semi")
    rows = lineitem_rows(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey")
    flagged = flag_unknown(
        rows, "l_partkey", known, "cd", "missing", F.struct("l_orderkey", "l_linenumber")
    )
    return flagged.where("missing").drop("missing")


@query(
    "existing_keys",
    """WITH t AS (SELECT o_orderkey AS k, o_custkey % 3 AS id_dataset,
  CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderkey % 4 END AS id_source FROM orders),
r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey
  ELSE o_orderkey + 1000000000 END AS k FROM orders)
SELECT o_orderkey, EXISTS (SELECT 1 FROM t WHERE t.k = r.k AND id_dataset = 1
  AND id_source IS DISTINCT FROM 2) AS "exists" FROM r""",
)
def existing_keys(spark, folder):
    orders = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    target = orders.select(
        key.alias("k"),
        (F.col("o_custkey") % 3).alias("id_dataset"),
        F.when(key % 4 != 3, key % 4).alias("id_source"),
    )
    rows = orders.select(key, F.when(key % 5 < 3, key).otherwise(key + 1000000000).alias("uid"))
    scope = (F.col("id_dataset") == 1) & ~F.col("id_source").eqNullSafe(F.lit(2))
    flagged = flag_existing(rows, "uid", target, "k", scope, "exists", key)
    return flagged.select("o_orderkey", "exists")


# --- issue reports ------------------------------------------------------------------------------

DATED_SQL = """SELECT o_orderkey + 1 AS line_no, o_custkey % 4 AS id_load,
  CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate - INTERVAL 100 YEAR ELSE o_orderdate END AS s,
  o_orderdate + to_days(CAST(o_orderkey % 7 - 2 AS INTEGER)) AS e FROM orders"""

ISSUES_SQL = f"""SELECT * FROM (
  SELECT id_load, line_no, 'DATE_MIN_TOO_HIGH' AS code, 'date_min' AS "column"
    FROM d WHERE s > TIMESTAMP '2000-01-01'
  UNION ALL SELECT id_load, line_no, 'DATE_MAX_TOO_HIGH', 'date_max'
    FROM d WHERE e > TIMESTAMP '2000-01-01' AND s <= TIMESTAMP '2000-01-01'
  UNION ALL SELECT id_load, line_no, 'DATE_MIN_SUP_DATE_MAX', 'date_min' FROM d WHERE s > e
  UNION ALL SELECT id_load, line_no, 'DATE_MIN_TOO_LOW', 'date_min'
    FROM d WHERE s < TIMESTAMP '1900-01-01'
  UNION ALL SELECT id_load, line_no, 'DATE_MAX_TOO_LOW', 'date_max'
    FROM d WHERE e < TIMESTAMP '1900-01-01')"""
WITH_ISSUES = f"WITH d AS ({DATED_SQL}), i AS ({ISSUES_SQL})"


def dated_rows(spark, folder):
    """Orders as observations of four loads, some too old, too late or ending before they start."""
    key = F.col("o_orderkey")
    shift = F.make_dt_interval((key % 7 - 2).cast("int"))
    old = F.col("o_orderdate") - F.expr("INTERVAL 100 YEAR")
    rows = table(spark, folder, "orders").select(
        (F.col("o_custkey") % 4).alias("id_load"),
        (key + 1).alias("line_no"),
        F.when(key % 11 == 0, old).otherwise(F.col("o_orderdate")).alias("s"),
        (F.col("o_orderdate") + shift).alias("e"),
    )
    checks = date_checks(F.col("s"), F.col("e"), AS_OF, "date_min", "date_max")
    flagged = with_issues(rows, checks)
    return flagged.withColumn("valid", ~issue_ops.has_error(F.col("issues")))


def joined_lines(column):
    return F.array_join(F.transform(column, lambda n: n.cast("string")), ",")


@query(
    "date_checks_report",
    f"""{WITH_ISSUES} SELECT id_load, code, "column", (line_no - 1) // 1000 AS run,
  string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS lines
FROM i GROUP BY ALL""",
)
def date_checks_report(spark, folder):
    runs = issue_ops.issue_runs(long_issues(dated_rows(spark, folder)), span=1000)
    return runs.select("id_load", "code", "column", "run", joined_lines("lines").alias("lines"))


@query(
    "batch_merge",
    f"""{WITH_ISSUES} SELECT id_load, code, "column", (line_no - 1) // 100000 AS run,
  string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS lines
FROM i GROUP BY ALL""",
)
def batch_merge(spark, folder):
    """Three batches reported apart and merged give the report of the whole."""
    rows = dated_rows(spark, folder)
    parts = [issue_ops.issue_sets(long_issues(rows.where(F.col("line_no") % 3 == k))) for k in range(3)]
    sets = issue_ops.merge_sets(issue_ops.merge_sets(parts[0], parts[1]), parts[2])
    merged = issue_ops.set_runs(sets, issue_ops.REPORT)
    return merged.select("id_load", "code", "column", "run", joined_lines("lines").alias("lines"))


@query(
    "failed_cells_comment",
    """WITH p AS (SELECT p_partkey + 1 AS line_no, CASE WHEN p_partkey % 4 = 0 THEN p_name
  ELSE CAST(p_size AS VARCHAR) END AS txt FROM part)
SELECT 'INVALID_INTEGER' AS code, (line_no - 1) // 500 AS run,
  'Les valeurs suivantes ne sont pas des nombres : ' ||
  string_agg(txt, ', ' ORDER BY line_no) AS comment
FROM p WHERE TRY_CAST(txt AS INTEGER) IS NULL GROUP BY ALL""",
)
def failed_cells_comment(spark, folder):
    from obsload.functions.scalars import lenient_int

    key = F.col("p_partkey")
    rows = table(spark, folder, "part").select(
        F.lit(1).alias("id_load"),
        (key + 1).alias("line_no"),
        F.when(key % 4 == 0, F.col("p_name")).otherwise(text("p_size")).alias("txt"),
    )
    failed = lenient_int(F.col("txt")).isNull() & F.col("txt").isNotNull()
    check = issue_ops.Check("INVALID_INTEGER", "count_min", failed, F.col("txt"))
    runs = issue_ops.issue_runs(long_issues(with_issues(rows, [check])), span=500)
    return runs.select("code", "run", "comment")


@query(
    "report_rows",
    f"""{WITH_ISSUES}, r AS (SELECT *, row_number() OVER (PARTITION BY id_load, code, "column"
  ORDER BY line_no) AS rn FROM i)
SELECT id_load, code, "column", count(*) AS n_lines,
  string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (rn <= 30) AS first_lines,
  CASE WHEN code LIKE '%TOO_LOW' THEN 'WARNING' ELSE 'ERROR' END AS level
FROM r GROUP BY id_load, code, "column" """,
)
def report_rows(spark, folder):
    rows = issue_ops.report_rows(long_issues(dated_rows(spark, folder)), error_table(spark))
    return rows.select(
        "id_load", "code", "column", "n_lines", joined_lines("first_lines").alias("first_lines"), "level"
    )


@query(
    "error_summary",
    f"""{WITH_ISSUES} SELECT id_load, count(DISTINCT line_no) AS n_lines,
  count(DISTINCT CASE WHEN code NOT LIKE '%TOO_LOW' THEN line_no END) AS errors_count
FROM i GROUP BY id_load""",
)
def error_summary(spark, folder):
    rows = dated_rows(spark, folder)
    lines = issue_ops.distinct_lines(long_issues(rows))
    return lines.join(issue_ops.error_counts(rows), "id_load").select(
        "id_load", "n_lines", "errors_count"
    )


@query(
    "level_counts",
    f"""{WITH_ISSUES} SELECT id_load, CASE WHEN code LIKE '%TOO_LOW' THEN 'WARNING'
  ELSE 'ERROR' END AS level, count(*) AS n
FROM (SELECT DISTINCT id_load, code, "column" FROM i) GROUP BY ALL""",
)
def level_counts(spark, folder):
    return issue_ops.level_counts(long_issues(dated_rows(spark, folder)), error_table(spark))


@query(
    "erroneous_lines",
    f"""{WITH_ISSUES}, bad AS (SELECT DISTINCT id_load, line_no FROM i WHERE code NOT LIKE '%TOO_LOW')
SELECT id_load, (line_no - 1) // 2000 AS run,
  string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS lines FROM bad GROUP BY ALL""",
)
def erroneous_lines(spark, folder):
    runs = issue_ops.erroneous_lines(dated_rows(spark, folder), span=2000)
    return runs.select("id_load", "run", joined_lines("lines").alias("lines"))


@query(
    "whole_load_issue",
    """WITH c AS (SELECT o_custkey % 4 AS id_load, count(*) AS n FROM orders GROUP BY 1)
SELECT id_load, run, CAST(run * 1000 + 1 AS BIGINT) AS first_line,
  least(n, (run + 1) * 1000) AS last_line, least(n, (run + 1) * 1000) - run * 1000 AS n_lines
FROM c, LATERAL (SELECT unnest(range(0, (n - 1) // 1000 + 1)) AS run)""",
)
def whole_load_issue(spark, folder):
    loads = (
        table(spark, folder, "orders")
        .groupBy((F.col("o_custkey") % 4).alias("id_load"))
        .agg(F.count(F.lit(1)).alias("source_count"))
    )
    runs = issue_ops.whole_load_issue(loads, "ERROR_WHILE_LOADING_FILE", "", span=1000)
    return runs.select(
        "id_load",
        "run",
        F.array_min("lines").alias("first_line"),
        F.array_max("lines").alias("last_line"),
        F.size("lines").cast("long").alias("n_lines"),
    )


@query(
    "batch_slice",
    """WITH r AS (SELECT o_custkey % 4 AS id_load, o_orderkey + 1 AS line_no, o_orderstatus,
  row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderkey) AS rn FROM orders)
SELECT id_load, line_no, o_orderstatus FROM r WHERE rn BETWEEN 101 AND 600""",
)
def slice_of_batch(spark, folder):
    rows = table(spark, folder, "orders").select(
        (F.col("o_custkey") % 4).alias("id_load"),
        (F.col("o_orderkey") + 1).alias("line_no"),
        "o_orderstatus",
    )
    return batch_slice(rows, 100, 500, span=1000)
