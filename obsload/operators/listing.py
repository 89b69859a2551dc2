"""Listings of loads and mapping templates: visibility, search, order, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 15
NONE, OWN, ORGANISATION, ALL = 0, 1, 2, 3


def _mine(people: DataFrame, user: int, organisation: int | None, scope: int) -> DataFrame:
    own = F.col("id_role") == user
    if scope == ORGANISATION and organisation is not None:
        own = own | (F.col("id_organisation") == organisation)
    return people.where(own)


def visible_loads(
    loads: DataFrame, authors: DataFrame, user: int, organisation: int | None, scope: int
) -> DataFrame:
    """Loads a user may see.

    ``authors(id_load, id_role, id_organisation)``. Scope 0 shows none, 1 the user's own, 2 also
    those of their organisation, 3 all.
    """
    if scope == NONE:
        return loads.where(F.lit(False))
    if scope == ALL:
        return loads
    if scope not in (OWN, ORGANISATION):
        raise ValueError(f"unexpected scope {scope}")
    return loads.join(_mine(authors, user, organisation, scope), "id_load", "left_semi")


def visible_mappings(
    mappings: DataFrame, owners: DataFrame, user: int, organisation: int | None, scope: int, kind: str
) -> DataFrame:
    """Active templates of one type: public ones and those owned, by the same scopes."""
    active = mappings.where(F.col("active") & (F.col("type") == kind))
    if scope == NONE:
        return active.where(F.lit(False))
    if scope == ALL:
        return active
    if scope not in (OWN, ORGANISATION):
        raise ValueError(f"unexpected scope {scope}")
    owned = _mine(owners, user, organisation, scope).select("id_mapping").distinct()
    flagged = active.join(owned.withColumn("_owned", F.lit(True)), "id_mapping", "left")
    return flagged.where(F.col("public") | F.col("_owned")).drop("_owned")


def with_authors(loads: DataFrame, datasets: DataFrame, authors: DataFrame) -> DataFrame:
    """Loads with their dataset name and the names of their authors joined by ``"; "``.

    A load has a handful of authors, so their names fit one cell.
    """
    names = authors.groupBy("id_load").agg(
        F.array_join(F.array_sort(F.collect_set("full_name")), "; ").alias("authors_name")
    )
    return loads.join(datasets, "id_dataset", "left").join(names, "id_load", "left")


def _contains(column: str, text: str) -> Column:
    return F.contains(F.lower(F.col(column)), F.lit(text.lower()))


def search(loads: DataFrame, authors: DataFrame, text: str) -> DataFrame:
    """Loads whose file name, dataset name or an author's name contains ``text``, any case.

    ``loads`` already carries ``full_file_name`` and ``dataset_name``.
    """
    by_author = (
        authors.where(_contains("full_name", text)).select("id_load").distinct().withColumn("_hit", F.lit(True))
    )
    flagged = loads.join(by_author, "id_load", "left")
    own = F.coalesce(_contains("full_file_name", text), F.lit(False))
    dataset = F.coalesce(_contains("dataset_name", text), F.lit(False))
    return flagged.where(own | dataset | F.coalesce("_hit", F.lit(False))).drop("_hit")


def page(listing: DataFrame, sort: str, descending: bool, number: int = 1, size: int = PAGE) -> DataFrame:
    """One page of a listing, ties ordered by load; a top-k up to the end of the page."""
    if sort not in listing.columns:
        raise ValueError(f"cannot sort by {sort!r}")
    key = F.col(sort).desc_nulls_first() if descending else F.col(sort).asc_nulls_last()
    return listing.orderBy(key, F.col("id_load").asc()).offset((number - 1) * size).limit(size)


def total(listing: DataFrame) -> DataFrame:
    return listing.agg(F.count(F.lit(1)).alias("count"))


def orphans(mappings: DataFrame, children: DataFrame) -> DataFrame:
    """Mappings no child row refers to."""
    return mappings.join(children.select("id_mapping"), "id_mapping", "left_anti")
