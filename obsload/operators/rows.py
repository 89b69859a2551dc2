"""Row checks: typed columns and their issues, from the staged text of one load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsload.functions import dates, scalars
from obsload.functions.crs import area_of_use
from obsload.functions.geometry import GEOMETRY, parse_wkt, point, within_convex
from obsload.model.dictionary import DICTIONARY, Dictionary, Field
from obsload.model.error_types import GEOMETRY_FIELDS
from obsload.model.loads import Load, Settings
from obsload.operators.issues import Check, with_issues

PARSERS = {
    "integer": (scalars.lenient_int, "INVALID_INTEGER"),
    "timestamp": (dates.lenient_timestamp, "INVALID_DATE"),
    "uuid": (scalars.normal_uuid, "INVALID_UUID"),
}
AREA_CODES = ("codecommune", "codemaille", "codedepartement")


def null_cleaned(df: DataFrame, fields: list[Field]) -> DataFrame:
    """Empty text to null in the staged ``src_`` columns of ``fields``."""
    names = [f.source_column for f in fields if f.twin and f.source_column in df.columns]
    return df.withColumns({n: scalars.cell(n) for n in names})


def checked_fields(load: Load, settings: Settings, dictionary: Dictionary = DICTIONARY) -> list[Field]:
    """Mapped, uncoded fields that take part in the row checks."""
    mapped = [f for f in load.mapped(dictionary).values() if not f.vocab]
    return [f for f in mapped if f.twin] if settings.strict_reference else mapped


def required_checks(fields: list[Field], label) -> list[Check]:
    """Mandatory mapped fields must not be empty."""
    return [
        Check("MISSING_VALUE", label(f.name), scalars.cell(f.source_column).isNull())
        for f in fields
        if f.mandatory
    ]


def assembled_dates(df: DataFrame, fields: dict[str, Field]) -> DataFrame:
    """Adds the start and end texts, ``_text_min`` and ``_text_max``."""

    def source(name: str) -> Column | None:
        return F.col(fields[name].source_column) if name in fields else None

    start = source("date_min")
    return df.withColumns(
        {
            "_text_min": dates.start_text(start, source("hour_min")),
            "_text_max": dates.end_text(
                start, source("date_max"), source("hour_min"), source("hour_max")
            ),
        }
    )


def typed_columns(df: DataFrame, fields: list[Field], label) -> tuple[DataFrame, list[Check]]:
    """Parses the staged texts into ``_typed_<target>`` columns and states the format checks."""
    parsed: dict[str, Column] = {}
    checks: list[Check] = []
    pairs = [("_text_min", "datetime_min", "timestamp"), ("_text_max", "datetime_max", "timestamp")]
    pairs = [p for p in pairs if p[0] in df.columns]
    pairs += [(f.source_column, f.name, f.kind) for f in fields if f.target and f.kind in PARSERS]
    for source, target, kind in pairs:
        parse, code = PARSERS[kind]
        column = f"_typed_{target}"
        parsed[column] = parse(F.col(source))
        failed = F.col(column).isNull() & F.col(source).isNotNull()
        checks.append(Check(code, label(target), failed, F.col(source)))
    for f in fields:
        if f.kind == "text" and f.limit and f.target:
            over = scalars.too_long(F.col(f.source_column), f.limit)
            checks.append(Check("INVALID_CHAR_LENGTH", label(f.name), over))
    return df.withColumns(parsed), checks


def count_columns(
    count_min: Column | None, count_max: Column | None, default: int
) -> tuple[Column, Column]:
    """Both counts with their defaults; an absent column follows the other one."""
    one = F.lit(default)
    if count_min is not None:
        low = F.coalesce(count_min, one)
        return low, low if count_max is None else F.coalesce(count_max, low)
    if count_max is not None:
        high = F.coalesce(count_max, one)
        return high, high
    return one, one


def counts_disordered(count_min: Column, count_max: Column, default: int) -> Column:
    """Start count, defaulted, above a given end count."""
    return F.coalesce(count_min, F.lit(default)) > count_max


def read_position(df: DataFrame, fields: dict[str, Field], srid: int) -> DataFrame:
    """Adds ``_wkt`` and ``_xy``, the geometries read from the two kinds of position cells."""
    nothing = F.lit(None).cast(GEOMETRY)
    wkt = parse_wkt(F.col(fields["WKT"].source_column)) if "WKT" in fields else nothing
    xy = nothing
    if {"longitude", "latitude"} <= fields.keys():
        xy = point(
            scalars.lenient_double(F.col(fields["longitude"].source_column)),
            scalars.lenient_double(F.col(fields["latitude"].source_column)),
        )
    # parsed first, tested in a following projection: the parse must run once per row
    return df.withColumns({"_wkt": wkt, "_xy": xy}).withColumns(
        {
            "_wkt_in": within_convex(F.col("_wkt"), area_of_use(srid)),
            "_xy_in": within_convex(F.col("_xy"), area_of_use(srid)),
        }
    )


def position_checks(fields: dict[str, Field]) -> tuple[list[Check], Column]:
    """Georeference rules on the columns of :func:`read_position`, and the accepted geometry."""

    def given(name: str) -> Column:
        return F.col(fields[name].source_column).isNotNull() if name in fields else F.lit(False)

    wkt = given("WKT")
    both_axes = {"longitude", "latitude"} <= fields.keys()
    xy = (given("longitude") & given("latitude")) if both_axes else F.lit(False)
    codes = [given(name) for name in AREA_CODES]
    n_codes = sum((c.cast("int") for c in codes[1:]), codes[0].cast("int"))
    unplaced = ~wkt & ~xy
    wkt_out = wkt & ~xy & F.col("_wkt").isNotNull() & ~F.col("_wkt_in")
    xy_out = xy & ~wkt & F.col("_xy").isNotNull() & ~F.col("_xy_in")
    checks = [
        Check("INVALID_WKT", "WKT", wkt & F.col("_wkt").isNull()),
        Check("INVALID_GEOMETRY", "longitude", xy & F.col("_xy").isNull()),
        Check("MULTIPLE_ATTACHMENT_TYPE_CODE", GEOMETRY_FIELDS, wkt & xy),
        Check("GEOMETRY_OUT_OF_BOX", "WKT", wkt_out),
        Check("GEOMETRY_OUT_OF_BOX", "longitude", xy_out),
        Check("MULTIPLE_CODE_ATTACHMENT", GEOMETRY_FIELDS, unplaced & (n_codes >= 2)),
        Check("NO-GEOM", GEOMETRY_FIELDS, unplaced & (n_codes == 0)),
    ]
    accepted = F.when(wkt & ~xy & F.col("_wkt_in"), F.col("_wkt")).when(
        xy & ~wkt & F.col("_xy_in"), F.col("_xy")
    )
    return checks, accepted


def ragged_checks(df: DataFrame) -> list[Check]:
    """Issues of records whose cells do not fit the header, where staging has marked them."""
    if "_ragged" not in df.columns:
        return []
    return [Check(c, "", F.col("_ragged").eqNullSafe(c)) for c in ("ROW_HAVE_TOO_MUCH_COLUMN", "ROW_HAVE_LESS_COLUMN")]


def row_checks(
    df: DataFrame, load: Load, settings: Settings, dictionary: Dictionary = DICTIONARY
) -> DataFrame:
    """All row checks of a load in successive projections, without any shuffle.

    Adds ``issues``, ``row_ok``, the typed target columns and ``geom`` in the file's system. Typed
    values of a row with any issue are null, so later checks on them stay silent; free text and
    vocabulary columns are left alone.
    """
    fields = load.mapped(dictionary)
    checked = checked_fields(load, settings, dictionary)
    by_name = {f.name: f for f in checked}

    def label(name: str) -> str:
        from_source = {"datetime_min": "date_min", "datetime_max": "date_max"}.get(name, name)
        return load.column_label(from_source)

    clean = null_cleaned(df, list(fields.values()))
    if "date_min" in by_name:
        clean = assembled_dates(clean, by_name)
    typed, format_checks = typed_columns(clean, checked, label)
    placed = read_position(typed, by_name, load.srid)
    position, accepted = position_checks(by_name)
    position = [Check(c.code, label(c.column), c.condition) for c in position]

    def typed_or_none(name: str) -> Column | None:
        return F.col(f"_typed_{name}") if name in by_name else None

    low, high = typed_or_none("count_min"), typed_or_none("count_max")
    checks = [*ragged_checks(df), *required_checks(checked, label), *format_checks, *position]
    if low is not None and high is not None:
        disordered = counts_disordered(low, high, settings.default_count)
        checks.append(Check("COUNT_MIN_SUP_COUNT_MAX", label("count_min"), disordered))
    found = with_issues(placed, checks).withColumn("row_ok", F.size("issues") == 0)

    count_min, count_max = count_columns(low, high, settings.default_count)
    results = {
        name.removeprefix("_typed_"): F.col(name) for name in placed.columns if name.startswith("_typed_")
    }
    results.update({"count_min": count_min, "count_max": count_max, "geom": accepted})
    ok = F.col("row_ok")
    gated = found.withColumns({name: F.when(ok, value) for name, value in results.items()})
    temporary = [c for c in gated.columns if c.startswith(("_typed_", "_text_"))]
    return gated.drop(*temporary, "_wkt", "_xy", "_wkt_in", "_xy_in", "_ragged")
