"""Lenient casts of text cells: integers, coordinates, identifiers, JSON attributes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTEGER = r"^\s*([+-]?[0-9]+)\s*$"
_NUMBER = (
    r"(?i)^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:E[+-]?\d+)?|[+-]?(?:nan|inf|infinity))\s*$"
)
_UUID = (
    r"(?i)^[{}]*([0-9a-f]{8})([0-9a-f]{4})[0-9a-f]([0-9a-f]{3})([0-9a-f])([0-9a-f]{3})"
    r"([0-9a-f]{12})[{}]*$"
)
_MARK = "\u0001"


def cell(name: str) -> Column:
    """A source cell, empty text being null."""
    return F.nullif(F.col(name), F.lit(""))


def lenient_int(text: Column) -> Column:
    """32-bit integer with optional sign and surrounding blanks; null otherwise."""
    return F.regexp_extract(text, _INTEGER, 1).try_cast("int")


def lenient_double(text: Column) -> Column:
    """Coordinate text to double; a decimal comma counts as a point."""
    return F.regexp_extract(F.translate(text, ",", "."), _NUMBER, 1).try_cast("double")


def _dashed(hex32: Column) -> Column:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(hex32, start, size) for start, size in cuts])


def _variant(digit: Column) -> Column:
    """Hexadecimal digit with its two high bits set to binary 10."""
    return F.translate(digit, "0123456789abcdef", "89ab89ab89ab89ab")


def _as_version_4(hex32: Column) -> Column:
    """Version nibble set to 4 and the two variant bits to binary 10."""
    return F.concat(
        F.substring(hex32, 1, 12),
        F.lit("4"),
        F.substring(hex32, 14, 3),
        _variant(F.substring(hex32, 17, 1)),
        F.substring(hex32, 18, 15),
    )


def normal_uuid(text: Column) -> Column:
    """Canonical 36-character identifier, forced to version 4; null when it is not one.

    One rewrite sets dashes and version; only the variant digit is patched afterwards.
    """
    bare = F.translate(F.lower(F.regexp_replace(text, r"urn:|uuid:", "")), "-" + _MARK, "")
    dashed = F.regexp_replace(bare, _UUID, _MARK + "$1-$2-4$3-$4$5-$6")
    found = F.regexp_extract(dashed, f"^{_MARK}(.*)$", 1)
    patched = F.concat(
        F.substring(found, 1, 19), _variant(F.substring(found, 20, 1)), F.substring(found, 21, 16)
    )
    return F.nullif(patched, F.lit(""))


def row_uuid(salt: str, *keys: Column) -> Column:
    """Identifier derived from the row's own key, so a retried task makes the same one."""
    digest = F.sha2(F.concat_ws("|", F.lit(salt), *[k.cast("string") for k in keys]), 256)
    return _dashed(_as_version_4(F.substring(digest, 1, 32)))


def too_long(text: Column, limit: int) -> Column:
    return F.char_length(text) > limit


def overlay(base: Column, top: Column) -> Column:
    """Map concatenation in which ``top`` wins, whatever the session's duplicate-key policy."""
    kept = F.map_filter(base, lambda key, _: ~F.array_contains(F.map_keys(top), key))
    return F.map_concat(kept, top)


def merged_attributes(columns: list[str]) -> Column:
    """One JSON object out of several cells.

    A cell holding a JSON object contributes its members; any other cell is stored as text under
    its column name. Later columns win.
    """
    maps = []
    for name in columns:
        members = F.from_json(F.col(name), "map<string,variant>")
        plain = F.create_map(F.lit(name), F.col(name).cast("variant"))
        looks_object = F.ltrim(F.col(name)).startswith("{")
        maps.append(F.coalesce(F.when(looks_object, members), plain))
    return F.to_json(reduce(overlay, maps))


# Fixed value: the pattern a proof address must match (scheme optional, at least one dot).
URL_PATTERN = (
    r"^(?:(?:https?|ftp)://)?[\w.-]+(?:\.[\w.-]+)+"
    r"[\w\-._~:/?#\[\]@!$&'()*+,;=.]+$"
)


def bad_url(text: Column) -> Column:
    return (F.coalesce(text, F.lit("")) != "") & ~text.rlike(URL_PATTERN)
