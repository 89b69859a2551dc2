"""Checking one staged load: row checks, completion, set checks, final validity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsload.functions.geometry import centroid, first_vertex, point
from obsload.functions.scalars import row_uuid
from obsload.model.dictionary import DICTIONARY, Dictionary
from obsload.model.error_types import GEOMETRY_FIELDS
from obsload.model.loads import Dimensions, Load, Settings
from obsload.operators import vocabulary as vocab_ops
from obsload.operators.elevation import AREA_KEY, filled_altitudes, with_altitudes
from obsload.operators.georef import attach_areas, attachment_checks, both_systems
from obsload.operators.issues import Check, has_error, long_issues, with_issues
from obsload.operators.keyed import ABSENT, PRESENT, REPEATED, Question, fetch, flag_lines, record_digest, with_answers
from obsload.operators.rows import row_checks
from obsload.operators.sets import date_checks, range_checks, url_check
from obsload.operators.topology import Outline, invalid_shapes, shapes_meeting
from obsload.workspace import written


ROW = ["id_load", "line_no"]


@dataclass(frozen=True)
class Checked:
    """Rows with their ``valid`` flag, issues and target columns, and the long issue table."""

    rows: DataFrame
    issues: DataFrame


def check_load(
    staged: DataFrame,
    load: Load,
    dims: Dimensions,
    settings: Settings,
    dictionary: Dictionary = DICTIONARY,
    extra_checks: Sequence[Check] = (),
    report_duplicate_rows: bool = False,
) -> Checked:
    """Runs the whole catalogue on one load, then ``extra_checks`` of the caller.

    Extra checks may name staged and target columns; a code of their own needs a level.
    ``report_duplicate_rows`` adds the comparison of whole records, one more shuffle of digests.

    The row stage is written once. All keys that are looked up are counted in one narrow scan of it, shapes
    are judged in another; no look-up reads what an earlier one has joined. The final pass joins the answers
    to the rows. Its result is written too, so reports, previews and the append read it instead of
    recomputing it. Rows attached to an area name it; its shape is joined when they are appended.
    """
    fields = load.mapped(dictionary)
    spread = F.col("line_no")
    label = _labels(load)

    base = written(row_checks(staged, load, settings, dictionary), "row-checks")
    rows = _missing_targets(base, dictionary)
    rows = both_systems(rows, load.srid, settings.local_srid)
    rows = attach_areas(rows, dims.areas, fields, settings.local_srid, spread, settle=True)
    rows = with_issues(rows, attachment_checks(fields, label))

    rows = _vocabulary_stage(rows, load, dims, settings, dictionary, label)
    staged_cells = [c for c in staged.columns if c not in ("line_no", "_ragged")] if report_duplicate_rows else []
    rows, reference_checks = _reference_stage(rows, base, load, dims, settings, label, fields, staged_cells)
    rows, altitude_checks = _altitude_stage(rows, load, dims, settings, label, fields)
    if load.wants("unique_id_sinp_generate", settings.generate_missing_uuid):
        rows = _generated_uuid(rows, fields, settings)

    checks = [*reference_checks, *altitude_checks]
    checks += date_checks(
        F.col("datetime_min"), F.col("datetime_max"), settings.as_of, label("date_min"), label("date_max")
    )
    depths = [n if n in fields else None for n in ("depth_min", "depth_max")]
    checks += range_checks(*depths, "DEPTH_MIN_SUP_ALTI_MAX", label)
    if "digital_proof" in fields:
        checks.append(url_check("digital_proof", label("digital_proof")))
    if "WKT" in fields:
        shapes = base.where(F.col("geom.kind") != "POINT").select(*ROW, "geom")
        rows = flag_lines(rows, invalid_shapes(shapes, ROW), "_unsound")
        given = F.col(fields["WKT"].source_column).isNotNull()
        checks.append(Check("INVALID_GEOMETRY", label("WKT"), given & F.col("_unsound")))
    rows = with_issues(rows, [*checks, *extra_checks])
    if settings.restrict_to_area is not None and dims.areas is not None:
        rows = _restriction_stage(rows, base, load, dims, settings)
    valid = ~has_error(F.col("issues"), extra_checks)
    # the centre only matters for rows that reach the target
    of_area = F.when(F.col("area_x").isNotNull(), point(F.col("area_x"), F.col("area_y")))
    located = F.when(valid, F.coalesce(of_area, centroid(F.col("the_geom_4326"))))
    rows = rows.withColumns({"valid": valid, "the_geom_point": located})
    made = ("row_ok", "geom", "has_position", "area_x", "area_y")
    rows = rows.drop(*made, *[c for c in rows.columns if c.startswith("_")])
    done = written(rows, "checked")
    return Checked(done, long_issues(done))


def _labels(load: Load):
    derived = {"datetime_min": "date_min", "datetime_max": "date_max"}
    return lambda name: load.column_label(derived.get(name, name))


def _missing_targets(rows: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Null columns for targets the file does not feed, so later stages may name them."""
    kinds = {"integer": "int", "timestamp": "timestamp_ntz"}
    wanted = {
        f.name: kinds.get(f.kind, "string")
        for f in dictionary
        if f.target and f.kind != "geometry" and not f.vocab
    }
    wanted |= {"datetime_min": "timestamp_ntz", "datetime_max": "timestamp_ntz"}
    missing = {n: F.lit(None).cast(t) for n, t in wanted.items() if n not in rows.columns}
    return rows.withColumns(missing) if missing else rows


def _vocabulary_stage(rows, load, dims, settings, dictionary, label):
    coded = dictionary.coded()
    mapped = [f for f in coded if f.name in load.mapped(dictionary)]
    if dims.vocabulary is None:
        return rows.withColumns({f.name: F.lit(None).cast("int") for f in coded})
    rows = vocab_ops.map_values(rows, mapped, load.content_mapping, dims.vocabulary, F.col("line_no"))
    defaults = vocab_ops.default_terms(dims.vocabulary, [f.vocab for f in coded])
    names = {f.name for f in mapped}
    rows = vocab_ops.fill_defaults(rows, coded, names, defaults, settings.fill_missing_vocabulary)
    checks = vocab_ops.unknown_value_checks(mapped, label)

    fields = load.mapped(dictionary)
    proofs = [p for p in ("digital_proof", "non_digital_proof") if p in fields]
    if settings.check_exist_proof and proofs:
        yes = vocab_ops.term_id(dims.vocabulary, vocab_ops.PROOF_VOCABULARY, "label", vocab_ops.PROOF_YES)
        name = "id_nomenclature_exist_proof"
        wrong = vocab_ops.proof_disagrees(F.col(name), yes, proofs)
        checks.append(Check("INVALID_EXISTING_PROOF_VALUE", label(name), wrong))
    stop = settings.strict_reference and settings.check_exist_proof and not proofs
    blurred = settings.check_private_blurring and load.private_dataset
    if not stop and blurred and not settings.fill_missing_vocabulary:
        name = "id_nomenclature_blurring"
        checks.append(Check("CONDITIONAL_MANDATORY_FIELD_ERROR", label(name), F.col(name).isNull()))
    if not stop and settings.check_literature_reference:
        name = "id_nomenclature_source_status"
        literature = vocab_ops.term_id(
            dims.vocabulary, vocab_ops.SOURCE_VOCABULARY, "code", vocab_ops.SOURCE_LITERATURE
        )
        bare = vocab_ops.unreferenced_literature(F.col(name), literature, F.col("reference_biblio"))
        checks.append(Check("CONDITIONAL_MANDATORY_FIELD_ERROR", label(name), bare))
    return with_issues(rows, checks)


def importable_taxa(dims: Dimensions, id_list: int | None) -> DataFrame:
    """Taxa a load may name: the referential, or its part on one list."""
    taxa = dims.taxa.select("cd_nom")
    if id_list is None:
        return taxa
    listed = dims.taxa_list.where(F.col("id_list") == id_list).select("cd_nom")
    return taxa.join(listed, "cd_nom", "left_semi")


def _reference_stage(rows, base, load, dims, settings, label, fields, staged_cells):
    """Every question about a key of the rows, answered together; ``base`` is the written row stage."""
    asked: list[tuple[Question, str, str]] = []
    derived = {}
    if "cd_nom" in fields and dims.taxa is not None:
        known = importable_taxa(dims, settings.restrict_to_taxa_list)
        asked.append((Question("_no_taxon", ("cd_nom",), ABSENT, known), "CD_NOM_NOT_FOUND", "cd_nom"))
    if "cd_hab" in fields and dims.habitats is not None:
        known = dims.habitats.select("cd_hab")
        asked.append((Question("_no_habitat", ("cd_hab",), ABSENT, known), "CD_HAB_NOT_FOUND", "cd_hab"))
    if "entity_source_pk_value" in fields:
        derived["_pk"] = F.nullif(F.col("entity_source_pk_value"), F.lit(""))
        same = Question("_same_pk", ("id_load", "_pk"), REPEATED)
        asked.append((same, "DUPLICATE_ENTITY_SOURCE_PK", "entity_source_pk_value"))
    if "unique_id_sinp" in fields:
        same = Question("_same_id", ("id_load", "unique_id_sinp"), REPEATED)
        asked.append((same, "DUPLICATE_UUID", "unique_id_sinp"))
        if settings.check_existing_uuid and dims.target is not None:
            other = (F.col("id_dataset") == load.id_dataset) & ~F.col("id_source").eqNullSafe(
                F.lit(load.id_source)
            )
            there = dims.target.where(other).select("unique_id_sinp")
            asked.append((Question("_exists", ("unique_id_sinp",), PRESENT, there), "EXISTING_UUID", "unique_id_sinp"))
    if staged_cells:
        derived["_record"] = record_digest(staged_cells)
        asked.append((Question("_same_row", ("_record",), REPEATED), "DUPLICATE_ROWS", ""))
    questions = [q for q, _, _ in asked]
    source = base.withColumns(derived) if derived else base
    rows = with_answers(rows.withColumns(derived) if derived else rows, questions, ROW, source)
    checks = [
        Check(code, label(name) if name else "", F.col(q.flag), F.col(name) if name else None) for q, code, name in asked
    ]
    return rows, checks


def _altitude_stage(rows, load, dims, settings, label, fields):
    given = [n if n in fields else None for n in ("altitude_min", "altitude_max")]
    if load.wants("altitudes_generate", False):
        given = ["altitude_min", "altitude_max"]
        if dims.elevation is not None:
            sources = {n: fields[n].source_column if n in fields else None for n in given}
            position = F.col("the_geom_local").isNotNull() | F.col("id_area_attachment").isNotNull()
            empty = [F.lit(True) if s is None else F.col(s).isNull() for s in sources.values()]
            rows = rows.withColumn("has_position", position)
            areas = area = None
            if dims.areas is not None:
                once = dims.areas.groupBy("id_area").agg(F.min_by("geom", F.xxhash64("code")).alias("geom"))
                areas = once.select(F.concat(F.lit(AREA_KEY), "id_area").alias("geo_key"), "geom")
                area = F.concat(F.lit(AREA_KEY), "id_area_attachment")
            rows = with_altitudes(
                rows, "the_geom_local", dims.elevation, dims.elevation_cell,
                position & (empty[0] | empty[1]), F.col("line_no"), settle=True, areas=areas, area=area,
            )
            rows = filled_altitudes(rows, sources).drop("alt_low", "alt_high")
    return rows, range_checks(*given, "ALTI_MIN_SUP_ALTI_MAX", label)


def _generated_uuid(rows, fields, settings):
    empty = F.lit(True)
    if "unique_id_sinp" in fields:
        empty = F.col(fields["unique_id_sinp"].source_column).isNull()
    made = row_uuid(settings.uuid_salt, F.col("id_load"), F.col("line_no"))
    own = F.col("unique_id_sinp")
    return rows.withColumn("unique_id_sinp", F.when(empty & own.isNull(), made).otherwise(own))


def _restriction_stage(rows, base, load, dims, settings):
    """Rows outside the area the instance is restricted to: positions, shapes, and areas rows are attached to."""
    id_area, geom = settings.restrict_to_area, F.col("the_geom_local")
    area = dims.areas.where((F.col("id_area") == id_area) & F.col("geom").isNotNull()).select("id_area", "geom").limit(1)
    outline = Outline.of(area)
    if outline is None:
        raise ValueError(f"area {id_area} is not in the referential")
    head, is_point = first_vertex(geom), geom["kind"] == "POINT"
    placed = rows.withColumns({"_x": F.when(is_point, head["x"]), "_y": F.when(is_point, head["y"])})
    rows = outline.holding(placed, "_x", "_y", F.col("line_no"))

    moved = both_systems(base.where(F.col("geom.kind") != "POINT").select(*ROW, "geom"), load.srid, settings.local_srid)
    shapes = moved.select(*ROW, F.col("the_geom_local").alias("geom"))
    rows = flag_lines(rows, shapes_meeting(shapes, ROW, outline), "_shape_in")
    # an attached area is judged once, not once per row
    own = dims.areas.select(F.col("id_area").alias("id_area_attachment"), "geom")
    near = shapes_meeting(own, ["id_area_attachment"], outline).withColumn("_area_in", F.lit(True))
    rows = fetch(rows, near, ["id_area_attachment"], ["_area_in"], F.col("line_no"), settle=True, unique=True)

    attached = F.col("id_area_attachment").isNotNull()
    inside = (
        F.when(attached, F.coalesce("_area_in", F.lit(False)))
        .when(is_point, F.size("id_areas") > 0)
        .otherwise(F.col("_shape_in"))
    )
    outside = ~has_error(F.col("issues")) & (geom.isNotNull() | attached) & ~inside
    return with_issues(rows, [Check("GEOMETRY_OUTSIDE", GEOMETRY_FIELDS, outside)]).drop("id_areas")
