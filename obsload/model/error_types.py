"""Catalogue of issue codes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

ERROR, WARNING = "ERROR", "WARNING"

# Issue codes by category; the codes of LOW_DATES are warnings.
CODES = {
    "file": [
        "NO_FILE_DETECTED", "FILE_NAME_ERROR", "FILE_WITH_NO_DATA", "FILE_EXTENSION_ERROR",
        "FILE_NAME_TOO_LONG", "FILE_OVERSIZE", "FILE_FORMAT_ERROR", "ENCODING_ERROR",
        "HEADER_COLUMN_EMPTY", "HEADER_SAME_COLUMN_NAME", "ERROR_WHILE_LOADING_FILE",
        "NO_FILE_SENDED", "EMPTY_FILE",
    ],
    "record": ["ROW_HAVE_LESS_COLUMN", "ROW_HAVE_TOO_MUCH_COLUMN", "EMPTY_ROW"],
    "format": [
        "INVALID_INTEGER", "INVALID_DATE", "INVALID_UUID", "INVALID_CHAR_LENGTH", "INVALID_REAL",
        "INVALID_URL_PROOF",
    ],
    "required": ["MISSING_VALUE", "CONDITIONAL_MANDATORY_FIELD_ERROR"],
    "consistency": [
        "DATE_MIN_SUP_DATE_MAX", "DATE_MIN_TOO_HIGH", "DATE_MAX_TOO_HIGH", "DATE_MIN_TOO_LOW",
        "DATE_MAX_TOO_LOW", "COUNT_MIN_SUP_COUNT_MAX", "ALTI_MIN_SUP_ALTI_MAX",
        "DEPTH_MIN_SUP_ALTI_MAX", "INVALID_EXISTING_PROOF_VALUE", "INVALID_STATUT_SOURCE_VALUE",
        "CONDITIONAL_INVALID_DATA",
    ],
    "reference": [
        "CD_NOM_NOT_FOUND", "CD_HAB_NOT_FOUND", "ID_DIGITISER_NOT_EXISITING",
        "INVALID_NOMENCLATURE", "INVALID_NOMENCLATURE_WARNING",
    ],
    "duplicate": [
        "DUPLICATE_ENTITY_SOURCE_PK", "DUPLICATE_ROWS", "DUPLICATE_UUID", "EXISTING_UUID",
    ],
    "geometry": [
        "GEOMETRY_OUT_OF_BOX", "PROJECTION_ERROR", "INVALID_GEOM_CODE", "MULTIPLE_CODE_ATTACHMENT",
        "INVALID_WKT", "MISSING_GEOM", "INVALID_ATTACHMENT_CODE", "INVALID_GEOMETRY", "NO-GEOM",
        "GEOMETRY_OUTSIDE", "MULTIPLE_ATTACHMENT_TYPE_CODE",
    ],
    "other": ["UNKNOWN_ERROR"],
}
LOW_DATES = ("DATE_MIN_TOO_LOW", "DATE_MAX_TOO_LOW")
_WARNINGS = {*LOW_DATES, "INVALID_NOMENCLATURE_WARNING"}

# Column labels of geometry issues that concern several columns.
GEOMETRY_FIELDS = "Champs géométriques"
GEOMETRY_COLUMNS = "Colonnes géométriques"

# Lead-in of the comment listing the cells that failed to parse.
COMMENTS = {
    "INVALID_DATE": "Les dates suivantes ne sont pas au bon format: ",
    "INVALID_UUID": "Les UUID suivantes ne sont pas au bon format: ",
    "INVALID_INTEGER": "Les valeurs suivantes ne sont pas des nombres : ",
}

LEVELS = {
    code: WARNING if code in _WARNINGS else ERROR for codes in CODES.values() for code in codes
}


def level_of(code: str) -> str:
    if code not in LEVELS:
        raise ValueError(f"unknown issue code {code!r}")
    return LEVELS[code]


def describe(code: str) -> str:
    """Readable form of a code, for reports."""
    return code.replace("_", " ").replace("-", " ").lower()


def error_table(spark: SparkSession, own: Iterable[tuple[str, str, str, str]] = ()) -> DataFrame:
    """The catalogue as a dimension table; some sixty rows, so it may be broadcast.

    ``own`` are lines ``(code, category, description, level)`` of the caller: they replace the lines
    of their codes, or add to them.
    """
    lines = {
        code: (code, category, describe(code), LEVELS[code])
        for category, codes in CODES.items()
        for code in codes
    }
    rows = list((lines | {line[0]: tuple(line) for line in own}).values())
    return spark.createDataFrame(rows, "code string, category string, description string, level string")
