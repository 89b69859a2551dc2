"""Per-load configuration, held on the driver while a plan is built."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from obsload.model.dictionary import DICTIONARY, Dictionary, Field


@dataclass(frozen=True)
class Settings:
    """Instance options. Dates and identifier salt are arguments, so a re-run gives equal rows."""

    as_of: dt.date
    uuid_salt: str = "obsload"
    default_count: int = 1
    fill_missing_vocabulary: bool = True
    check_exist_proof: bool = True
    check_private_blurring: bool = True
    check_literature_reference: bool = True
    check_existing_uuid: bool = True
    generate_missing_uuid: bool = True
    local_srid: int = 2154
    restrict_to_area: int | None = None
    restrict_to_taxa_list: int | None = None
    # also reproduce two accidents: unstaged text fields skip the row checks, and mapping no proof
    # field skips the blurring and literature checks
    strict_reference: bool = False


@dataclass(frozen=True)
class Load:
    """One file set brought in together."""

    id_load: int
    columns: tuple[str, ...]
    field_mapping: dict
    content_mapping: dict = field(default_factory=dict)
    srid: int = 4326
    separator: str = ";"
    encoding: str = "UTF-8"
    id_dataset: int = 0
    id_source: int | None = None
    id_module: int | None = None
    private_dataset: bool = False

    def mapped(self, dictionary: Dictionary = DICTIONARY) -> dict[str, Field]:
        """Single-column fields whose mapped source column is in the file."""
        return {
            f.name: f
            for f in dictionary
            if not f.generated
            and not f.multi
            and isinstance(self.field_mapping.get(f.name), str)
            and self.field_mapping[f.name] in self.columns
        }

    def mapped_lists(self, dictionary: Dictionary = DICTIONARY) -> dict[str, list[str]]:
        """Multi-column fields with those of their columns that are in the file."""
        lists = {}
        for f in dictionary:
            wanted = self.field_mapping.get(f.name)
            if f.multi and isinstance(wanted, (list, tuple)):
                present = [c for c in wanted if c in self.columns]
                if present:
                    lists[f.name] = present
        return lists

    def wants(self, flag: str, default: bool) -> bool:
        """Value of a generation flag of the mapping, with the instance default."""
        return bool(self.field_mapping.get(flag, default))

    def column_label(self, name: str) -> str:
        """Name an issue is reported under: the user's own column when the field is mapped."""
        label = self.field_mapping.get(name, name)
        return label if isinstance(label, str) and label else name


@dataclass(frozen=True)
class Dimensions:
    """Referentials a load is checked against; any may be absent.

    * ``taxa(cd_nom, …)``, ``taxa_list(id_list, cd_nom)``, ``habitats(cd_hab)``
    * ``vocabulary(vocab, code, label, id, is_default)``
    * ``areas(id_area, type, code, geom)`` in the local system, ``geom`` as in functions.geometry
    * ``elevation(cx, cy, alt)`` on square cells of ``elevation_cell`` local units
    * ``target`` with at least ``unique_id_sinp, id_dataset, id_source``
    """

    taxa: DataFrame | None = None
    taxa_list: DataFrame | None = None
    habitats: DataFrame | None = None
    vocabulary: DataFrame | None = None
    areas: DataFrame | None = None
    elevation: DataFrame | None = None
    elevation_cell: float = 25.0
    target: DataFrame | None = None
