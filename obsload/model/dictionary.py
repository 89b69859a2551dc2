"""Field dictionary: what a file column may be mapped to and how it is checked."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Field:
    """One dictionary entry.

    ``kind`` is integer, timestamp, uuid, text, json, geometry, hour, coordinate, code or flag.
    ``vocab`` names the vocabulary of a coded field. ``target`` tells whether the field is a column
    of the target table; ``twin`` whether its text is staged apart, as ``src_<name>``.
    """

    name: str
    theme: str
    order: int
    kind: str
    limit: int | None = None
    vocab: str | None = None
    mandatory: bool = False
    generated: bool = False
    multi: bool = False
    display: bool = True
    target: bool = True

    @property
    def twin(self) -> bool:
        if self.generated or self.kind == "geometry":
            return False
        return self.vocab is not None or not self.target or self.kind not in ("text", "json")

    @property
    def source_column(self) -> str:
        return f"src_{self.name}" if self.twin else self.name

    @property
    def target_column(self) -> str | None:
        return self.name if self.target else None


# Themes in display order.
THEMES = [
    "general_info",
    "statement_info",
    "occurrence_sensitivity",
    "enumeration",
    "validation",
    "additional_data",
]


def _coded(name: str, theme: str, order: int, vocab: str) -> Field:
    return Field(name, theme, order, "integer", vocab=vocab)


# Field names, themes, order, types, limits and vocabularies of the dictionary.
FIELDS = [
    Field("entity_source_pk_value", "general_info", 1, "text"),
    Field("unique_id_sinp", "general_info", 2, "uuid"),
    Field("unique_id_sinp_generate", "general_info", 3, "flag", generated=True, target=False),
    Field("meta_create_date", "general_info", 4, "timestamp"),
    Field("meta_v_taxref", "general_info", 5, "text", limit=50, display=False),
    Field("meta_update_date", "general_info", 6, "timestamp"),
    _coded("id_nomenclature_grp_typ", "statement_info", 1, "TYP_GRP"),
    Field("unique_id_sinp_grp", "statement_info", 2, "uuid"),
    Field("date_min", "statement_info", 3, "timestamp", mandatory=True, target=False),
    Field("date_max", "statement_info", 4, "timestamp", target=False),
    Field("hour_min", "statement_info", 5, "hour", target=False),
    Field("hour_max", "statement_info", 6, "hour", target=False),
    Field("altitude_min", "statement_info", 7, "integer"),
    Field("altitudes_generate", "statement_info", 7, "flag", generated=True, target=False),
    Field("altitude_max", "statement_info", 8, "integer"),
    Field("depth_min", "statement_info", 9, "integer"),
    Field("depth_max", "statement_info", 10, "integer"),
    Field("observers", "statement_info", 11, "text", limit=1000),
    Field("comment_context", "statement_info", 12, "text"),
    Field("longitude", "statement_info", 14, "coordinate", target=False),
    Field("latitude", "statement_info", 15, "coordinate", target=False),
    Field("WKT", "statement_info", 16, "geometry_text", target=False),
    Field("codecommune", "statement_info", 17, "code", target=False),
    Field("codemaille", "statement_info", 18, "code", target=False),
    Field("codedepartement", "statement_info", 19, "code", target=False),
    _coded("id_nomenclature_geo_object_nature", "statement_info", 20, "NAT_OBJ_GEO"),
    Field("the_geom_point", "statement_info", 21, "geometry", display=False),
    Field("the_geom_local", "statement_info", 22, "geometry", display=False),
    Field("the_geom_4326", "statement_info", 23, "geometry", display=False),
    Field("place_name", "statement_info", 24, "text", limit=500),
    Field("precision", "statement_info", 25, "integer"),
    Field("cd_hab", "statement_info", 26, "integer"),
    Field("grp_method", "statement_info", 27, "text", limit=255),
    Field("nom_cite", "occurrence_sensitivity", 1, "text", limit=1000, mandatory=True),
    Field("cd_nom", "occurrence_sensitivity", 2, "integer", mandatory=True),
    _coded("id_nomenclature_obs_technique", "occurrence_sensitivity", 3, "METH_OBS"),
    _coded("id_nomenclature_bio_status", "occurrence_sensitivity", 4, "STATUT_BIO"),
    _coded("id_nomenclature_bio_condition", "occurrence_sensitivity", 5, "ETA_BIO"),
    _coded("id_nomenclature_biogeo_status", "occurrence_sensitivity", 6, "STAT_BIOGEO"),
    _coded("id_nomenclature_naturalness", "occurrence_sensitivity", 7, "NATURALITE"),
    Field("comment_description", "occurrence_sensitivity", 8, "text"),
    _coded("id_nomenclature_sensitivity", "occurrence_sensitivity", 9, "SENSIBILITE"),
    _coded("id_nomenclature_diffusion_level", "occurrence_sensitivity", 10, "NIV_PRECIS"),
    _coded("id_nomenclature_blurring", "occurrence_sensitivity", 11, "DEE_FLOU"),
    _coded("id_nomenclature_observation_status", "occurrence_sensitivity", 11, "STATUT_OBS"),
    _coded("id_nomenclature_source_status", "occurrence_sensitivity", 12, "STATUT_SOURCE"),
    Field("reference_biblio", "occurrence_sensitivity", 13, "text", limit=5000),
    _coded("id_nomenclature_behaviour", "occurrence_sensitivity", 14, "OCC_COMPORTEMENT"),
    _coded("id_nomenclature_life_stage", "enumeration", 1, "STADE_VIE"),
    _coded("id_nomenclature_sex", "enumeration", 2, "SEXE"),
    _coded("id_nomenclature_type_count", "enumeration", 3, "TYP_DENBR"),
    _coded("id_nomenclature_obj_count", "enumeration", 4, "OBJ_DENBR"),
    Field("count_min", "enumeration", 5, "integer"),
    Field("count_max", "enumeration", 6, "integer"),
    _coded("id_nomenclature_determination_method", "validation", 1, "METH_DETERMIN"),
    Field("determiner", "validation", 2, "text", limit=1000),
    Field("id_digitiser", "validation", 3, "integer", display=False),
    _coded("id_nomenclature_exist_proof", "validation", 4, "PREUVE_EXIST"),
    Field("digital_proof", "validation", 5, "text"),
    Field("non_digital_proof", "validation", 6, "text"),
    _coded("id_nomenclature_valid_status", "validation", 7, "STATUT_VALID"),
    Field("validator", "validation", 8, "text", limit=1000),
    Field("meta_validation_date", "validation", 9, "timestamp"),
    Field("validation_comment", "validation", 10, "text"),
    Field("additional_data", "additional_data", 1, "json", multi=True),
]

# Target columns made from others; a report names them by their source field.
DERIVED = {"datetime_min": "date_min", "datetime_max": "date_max"}
ALWAYS_APPENDED = [
    "datetime_min",
    "datetime_max",
    "the_geom_4326",
    "the_geom_local",
    "the_geom_point",
    "id_area_attachment",
]


@dataclass(frozen=True)
class Dictionary:
    """Field entries by name; callers may pass their own list."""

    fields: tuple[Field, ...] = field(default_factory=lambda: tuple(FIELDS))

    def __getitem__(self, name: str) -> Field:
        for entry in self.fields:
            if entry.name == name:
                return entry
        raise KeyError(name)

    def __iter__(self):
        return iter(self.fields)

    def named(self, names: Iterable[str]) -> list[Field]:
        wanted = set(names)
        return [entry for entry in self.fields if entry.name in wanted]

    def coded(self) -> list[Field]:
        return [entry for entry in self.fields if entry.vocab]


DICTIONARY = Dictionary()


def field_table(spark: SparkSession, dictionary: Dictionary = DICTIONARY) -> DataFrame:
    """The dictionary as a dimension table."""
    rows = [
        (
            f.name, f.theme, f.order, f.kind, f.limit, f.vocab, f.mandatory, f.generated,
            f.multi, f.display, f.source_column, f.target_column,
        )
        for f in dictionary
    ]
    schema = (
        "field string, theme string, order_field int, kind string, max_length int, vocab string, "
        "mandatory boolean, generated boolean, multi boolean, display boolean, "
        "source_column string, target_column string"
    )
    return spark.createDataFrame(rows, schema)


def theme_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(name, i + 1) for i, name in enumerate(THEMES)], "theme string, order_theme int"
    )
