"""Issues: attached to rows as an array, listed one per line, aggregated into reports.

The long form ``(id_load, line_no, code, column, value)`` is the primary artefact. Reports hold the line numbers
of a group as bitmaps and list them in runs of ``SPAN`` consecutive lines, so a code raised by every row of a huge
load becomes many bounded arrays and never a single one; nothing is left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsload.model.error_types import COMMENTS, ERROR, LEVELS, WARNING, level_of

ISSUE = "struct<code:string,column:string,value:string>"
ISSUES = f"array<{ISSUE}>"
SPAN = 100_000
COMMENT_BYTES = 64 * 1024
REPORT = ["id_load", "code", "column"]


@dataclass(frozen=True)
class Check:
    """A row is reported under ``code`` and ``column`` where ``condition`` is true.

    Users extend the catalogue by adding checks; ``value`` is the offending cell, if any. A code that
    the catalogue does not have needs a ``level``, ERROR or WARNING.
    """

    code: str
    column: str
    condition: Column
    value: Column | None = None
    level: str | None = None

    def issue(self) -> Column:
        """Array of the one issue, empty where the condition does not hold."""
        if self.level not in (ERROR, WARNING):
            level_of(self.code)
        value = F.lit(None) if self.value is None else self.value
        made = F.struct(
            F.lit(self.code).alias("code"),
            F.lit(self.column).alias("column"),
            value.cast("string").alias("value"),
        ).cast(ISSUE)
        return F.when(self.condition, F.array(made)).otherwise(F.array().cast(ISSUES))


def collected(checks: Sequence[Check]) -> Column:
    """Array of the issues raised by ``checks`` on one row; no condition yields no element.

    Arrays are joined and not filtered: under a filter all conditions would be interpreted, not compiled.
    """
    if not checks:
        return F.array().cast(ISSUES)
    return F.concat(*[c.issue() for c in checks]).cast(ISSUES)


def has_error(issues: Column, own: Sequence[Check] = ()) -> Column:
    """True when an issue of ERROR level is present; ``own`` are checks with levels of their own."""
    levels = LEVELS | {c.code: c.level for c in own if c.level is not None}
    warnings = [code for code, level in levels.items() if level != ERROR]
    return F.exists(issues, lambda i: ~i["code"].isin(*warnings))


def with_issues(df: DataFrame, checks: Sequence[Check], into: str = "issues") -> DataFrame:
    """Appends the issues of ``checks`` to the row's array."""
    found = collected(checks)
    if into in df.columns:
        found = F.concat(F.col(into), found)
    return df.withColumn(into, found)


def long_issues(rows: DataFrame) -> DataFrame:
    """One line per row and issue."""
    return rows.select("id_load", "line_no", F.explode("issues").alias("i")).select(
        "id_load", "line_no", "i.code", "i.column", "i.value"
    )


def line_sets(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Line numbers of each group as bitmaps ``(keys…, part, bits)``, 4 KB for 32 768 lines, however many are raised."""
    part = F.bitmap_bucket_number("line_no").alias("part")
    return lines.groupBy(*keys, part).agg(F.bitmap_construct_agg(F.bitmap_bit_position("line_no")).alias("bits"))


def issue_sets(issues: DataFrame) -> DataFrame:
    """Partial report of some rows: the lines of each load, code and column as bitmaps, with their comment."""
    sets = line_sets(issues, REPORT)
    texts = _comments(issues, F.bitmap_bucket_number("line_no"), "part")
    return sets.join(texts, [*REPORT, "part"], "left")


def merge_sets(*parts: DataFrame) -> DataFrame:
    """Partial reports of the same loads as one: bitmaps united, the first comment kept."""
    numbered = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, numbered).groupBy(*REPORT, "part").agg(
        F.bitmap_or_agg("bits").alias("bits"),
        F.min_by("comment", F.when(F.col("comment").isNotNull(), F.col("_part"))).alias("comment"),
    )


def set_runs(sets: DataFrame, keys: Sequence[str], span: int = SPAN) -> DataFrame:
    """Ordered line numbers ``(keys…, run, lines)`` of bitmaps; run ``k`` holds lines ``k * span + 1`` to ``(k + 1) * span``."""

    def unpacked(parts: pa.Array, bitmaps: pa.Array) -> pa.Array:
        out = []
        for part, bits in zip(parts.to_pylist(), bitmaps.to_pylist(), strict=True):
            lines = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")) + (part - 1) * len(bits) * 8 + 1
            runs = (lines - 1) // span
            cuts = np.flatnonzero(np.diff(runs)) + 1
            starts = np.r_[0, cuts][: len(lines)]
            out.append([{"run": int(runs[a]), "lines": x.tolist()} for a, x in zip(starts, np.split(lines, cuts), strict=False)])
        return pa.array(out, pa.list_(pa.struct([("run", pa.int64()), ("lines", pa.list_(pa.int64()))])))

    runs = F.arrow_udf(unpacked, "array<struct<run:bigint,lines:array<bigint>>>")("part", "bits")
    listed = sets.select(*keys, F.explode(runs).alias("r")).select(*keys, "r.run", "r.lines")
    return listed.groupBy(*keys, "run").agg(F.array_sort(F.flatten(F.collect_list("lines"))).alias("lines"))


def _comments(issues: DataFrame, place: Column, name: str) -> DataFrame:
    """Failing cells ``(load, code, column, name, comment)`` in line order, the first ``COMMENT_BYTES`` of each group.

    The cut is made while the cells stream by in order, so a group of huge cells is never held; all cells are in
    the long table.
    """
    failed = issues.where(F.col("code").isin(*COMMENTS) & F.col("value").isNotNull())
    cells = failed.groupBy(*REPORT, "line_no", place.alias(name)).agg(F.min("value").alias("value"))
    before = Window.partitionBy(*REPORT, name).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    sized = cells.withColumn("_before", F.coalesce(F.sum(F.octet_length("value") + 2).over(before), F.lit(0)))
    kept = sized.where(F.col("_before") < COMMENT_BYTES).groupBy(*REPORT, name).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda h: h["value"]).alias("values")
    )
    comment = F.lit(None).cast("string")
    for code, lead in COMMENTS.items():
        comment = F.when(F.col("code") == code, F.concat(F.lit(lead), F.array_join("values", ", "))).otherwise(comment)
    return kept.select(*REPORT, name, comment.alias("comment"))


def issue_runs(issues: DataFrame, span: int = SPAN) -> DataFrame:
    """Issue aggregation: ordered line numbers per load, code, column and run of lines.

    A load shorter than ``span`` has one run per group. The comment lists the failing cells of the run in line
    order.
    """
    runs = set_runs(line_sets(issues, REPORT), REPORT, span)
    texts = _comments(issues, F.floor((F.col("line_no") - 1) / span), "run")
    return runs.join(texts, [*REPORT, "run"], "left")


def with_type(report: DataFrame, error_types: DataFrame) -> DataFrame:
    """Report lines with category, description and level. The catalogue is fixed and tiny."""
    return report.join(F.broadcast(error_types), "code")


def report_rows(issues: DataFrame, error_types: DataFrame, first: int = 30) -> DataFrame:
    """One line per load, code and column: number of lines and the first few of them.

    The listing shows the head of each group by design; the complete lines are in
    :func:`issue_runs`.
    """
    keys = ["id_load", "code", "column"]
    lines = issues.select(*keys, "line_no").distinct()
    order = Window.partitionBy(*keys).orderBy("line_no")
    # the rank limit is applied per task before the shuffle, so a huge group sends few rows
    head = (
        lines.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= first)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("line_no")).alias("first_lines"))
    )
    sizes = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"))
    return with_type(sizes.join(head, keys), error_types)


def erroneous_lines(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """Ordered numbers of the invalid lines of each load, in runs."""
    return set_runs(line_sets(rows.where(~F.col("valid")), ["id_load"]), ["id_load"], span)


def error_counts(rows: DataFrame) -> DataFrame:
    """Number of invalid lines per load."""
    return rows.groupBy("id_load").agg(F.count_if(~F.col("valid")).alias("errors_count"))


def distinct_lines(issues: DataFrame) -> DataFrame:
    """Distinct offending lines per load over all issues."""
    return (
        issues.select("id_load", "line_no")
        .distinct()
        .groupBy("id_load")
        .agg(F.count(F.lit(1)).alias("n_lines"))
    )


def level_counts(report: DataFrame, error_types: DataFrame) -> DataFrame:
    """Number of report lines per load and level."""
    kinds = report.select("id_load", "code", "column").distinct()
    return (
        with_type(kinds, error_types)
        .groupBy("id_load", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def whole_load_issue(loads: DataFrame, code: str, column: str, span: int = SPAN) -> DataFrame:
    """Issue concerning every line 1..n of a load (``loads`` has id_load and source_count)."""
    level_of(code)
    runs = loads.select(
        "id_load", "source_count",
        F.explode(
            F.sequence(F.lit(0).cast("long"), F.floor((F.col("source_count") - 1) / span))
        ).alias("run"),
    ).where(F.col("source_count") > 0)
    low = F.col("run") * span + 1
    high = F.least(F.col("source_count").cast("long"), (F.col("run") + 1) * span)
    return runs.select(
        "id_load",
        F.lit(code).alias("code"),
        F.lit(column).alias("column"),
        "run",
        F.sequence(low, high).alias("lines"),
        F.lit(None).cast("string").alias("comment"),
    )
