"""Whole loads: for each family of checks a small file made from the rules, and the issues it must raise.

Cases come as a table of cells with the codes expected of each line, so that what a line tests stands
beside it.
"""

import csv
import glob
import json
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import issue_sets, label_mapping
from obsload.model.error_types import GEOMETRY_FIELDS, LEVELS
from obsload.plans.load import commit
from obsload.sinks.tables import invalid_records, write_delimited


def held(checked, lines):
    """``lines``: for each line of the file the pairs of code and column it raises."""
    wanted = {}
    for number, raised in enumerate(lines, 1):
        for issue in raised:
            wanted.setdefault(issue, set()).add(number)
    assert issue_sets(checked) == wanted
    wrong = {n for n, raised in enumerate(lines, 1) if any(LEVELS[code] == "ERROR" for code, _ in raised)}
    assert {r["line_no"] for r in checked.rows.where(~F.col("valid")).collect()} == wrong


def table(names, *lines):
    """Cells by name, and the issues that end each line."""
    return [dict(zip(names, line[:-1], strict=True)) for line in lines], [line[-1] for line in lines]


def test_moments_against_each_other_and_the_calendar(run):
    late, low = ("DATE_MIN_TOO_HIGH", "date_min"), ("DATE_MIN_TOO_LOW", "date_min")
    swapped = ("DATE_MIN_SUP_DATE_MAX", "date_min")
    rows, issues = table(
        ["date_min", "date_max", "hour_min", "hour_max"],
        ("2024-06-01", "2024-06-01", "", "", []),  # the day of the check itself
        ("03/05/2023", "04.05.2023", "22:15", "1:05", []),  # over midnight
        ("2023-05-03", "2023-05-03", "22:15", "1:05", [swapped]),
        ("2023-05-03", "2023-05-02", "", "", [swapped]),
        ("2023-05-03", "", "9h30", "", []),
        ("2023-05-03", "2023-05-03", "", "6", []),
        ("2024-06-02", "2024-06-02", "", "", [late]),
        ("2024-05-31", "2031-01-01", "", "", [("DATE_MAX_TOO_HIGH", "date_max")]),
        ("1899-12-31", "2001-07-14", "", "", [low]),
        ("1899-12-31", "1899-12-31", "", "", [low, ("DATE_MAX_TOO_LOW", "date_max")]),
        ("", "", "", "", [("MISSING_VALUE", "date_min")]),
        ("spring", "2001-07-14", "", "", [("INVALID_DATE", "date_min")]),
    )
    rows.append({"meta_validation_date": "2001-02-29"})
    issues.append([("INVALID_DATE", "meta_validation_date")])
    _, checked, _, _ = run(rows)
    held(checked, issues)


def test_one_way_to_place_a_row(run):
    town, square = "29314", "G10-091-625"
    marseille = {"longitude": "5,37", "latitude": "43.3"}
    none = {"WKT": ""}
    outside = [("GEOMETRY_OUTSIDE", GEOMETRY_FIELDS)]
    twice = [("MULTIPLE_ATTACHMENT_TYPE_CODE", GEOMETRY_FIELDS)]
    cases = [
        ({**none, "codemaille": square}, []),
        ({**none, "codecommune": town}, []),
        ({**none, "codecommune": "99999"}, [("INVALID_ATTACHMENT_CODE", "codecommune")]),
        ({**none, "codedepartement": "99"}, [("INVALID_ATTACHMENT_CODE", "codedepartement")]),
        ({**none, "codecommune": town, "codemaille": square}, [("MULTIPLE_CODE_ATTACHMENT", GEOMETRY_FIELDS)]),
        ({**none, **marseille}, []),
        ({**none, **marseille, "codecommune": town}, []),  # a position wins over a code
        ({"WKT": "POINT(5.37 43.3)", **marseille}, twice),
        ({"WKT": "LINESTRING(5.37 43.3, 5.38 43.31)"}, []),
        ({"WKT": "POINT(2.35 48.85)"}, outside),
        ({**none, "longitude": "2.35", "latitude": "48.85"}, outside),
        (none, [("NO-GEOM", GEOMETRY_FIELDS)]),
        ({"WKT": "POLYGON((5 43, 6 44, 6 43, 5 44, 5 43))"}, [("INVALID_GEOMETRY", "WKT")]),
        ({"WKT": "somewhere"}, [("INVALID_WKT", "WKT")]),
    ]
    _, checked, _, _ = run([c for c, _ in cases], generate=False, settings={"restrict_to_area": 2})
    held(checked, [i for _, i in cases])
    area = {r["line_no"]: r["id_area_attachment"] for r in checked.rows.collect()}
    assert (area[1], area[2], area[7]) == (3, 1, None)
    placed = {r["line_no"]: r["the_geom_point"] for r in checked.rows.where("valid").collect()}
    assert {placed[n]["kind"] for n in (1, 6, 9)} == {"POINT"}


def test_referentials(run):
    gone = ("CD_NOM_NOT_FOUND", "cd_nom")
    rows, issues = table(
        ["cd_nom", "cd_hab"],
        ("45013", "214", []),
        (" 45013", "", []),
        ("45399", "", [gone]),  # known, but not on the list
        ("1", "2", [gone, ("CD_HAB_NOT_FOUND", "cd_hab")]),
        ("45013", "215", [("CD_HAB_NOT_FOUND", "cd_hab")]),
        ("4501l", "214", [("INVALID_INTEGER", "cd_nom")]),
        ("45013", "2.14", [("INVALID_INTEGER", "cd_hab")]),
        ("", "214", [("MISSING_VALUE", "cd_nom")]),
    )
    _, checked, _, _ = run(rows, settings={"restrict_to_taxa_list": 1})
    held(checked, issues)


def test_keys_of_the_source(run):
    same = [("DUPLICATE_ENTITY_SOURCE_PK", "entity_source_pk_value")]
    rows, issues = table(["entity_source_pk_value"], ("k-1", same), ("", []), ("k-2", []), ("K-1", []), ("", []), ("k-1", same))
    _, checked, _, _ = run(rows)
    held(checked, issues)


def test_altitudes_are_read_off_the_grid_where_a_cell_is_empty(run):
    above = [("ALTI_MIN_SUP_ALTI_MAX", "altitude_min")]
    no = lambda name: ("INVALID_INTEGER", name)
    rows, issues = table(
        ["altitude_min", "altitude_max"],
        ("", "", []),
        ("412", "", []),
        ("413", "", above),  # one above the ground
        ("", "411", above),
        ("4", "40", []),
        ("300", "299", above),
        ("high", "", [no("altitude_min")]),
        ("1m", "2m", [no("altitude_min"), no("altitude_max")]),
    )
    _, checked, _, _ = run(rows)
    held(checked, issues)
    got = [tuple(r) for r in checked.rows.orderBy("line_no").select("altitude_min", "altitude_max").collect()]
    ground = 412
    assert got == [(ground, ground), (412, ground), (413, ground), (ground, 411), (4, 40), (300, 299), (None, None), (None, None)]


def test_identifiers(run):
    one, two = (str(uuid.UUID(int=n << 90 | 7, version=4)) for n in (1, 2))
    same = [("DUPLICATE_UUID", "unique_id_sinp")]
    rows, issues = table(
        ["unique_id_sinp"],
        (one, same),
        (two, []),
        (one.upper(), same),  # the same in another spelling
        ("", []),
        (one[:-1], [("INVALID_UUID", "unique_id_sinp")]),
        ("7d1c0a52-93be-4f06-8c1d-52b7e0c4a917", [("EXISTING_UUID", "unique_id_sinp")]),  # in the target
    )
    _, checked, _, _ = run(rows)
    held(checked, issues)
    made = checked.rows.where("line_no = 4").first()["unique_id_sinp"]
    assert uuid.UUID(made).version == 4


def test_proofs_and_their_addresses(run):
    status, address = ("INVALID_EXISTING_PROOF_VALUE", "id_nomenclature_exist_proof"), ("INVALID_URL_PROOF", "digital_proof")
    rows, issues = table(
        ["id_nomenclature_exist_proof", "digital_proof", "non_digital_proof"],
        ("Oui", "https://photos.example.org/7", "", []),
        ("Oui", "", "box 12", []),
        ("Oui", "", "", [status]),
        ("Oui", "https//photos.example.org", "", [address]),
        ("Non", "", "", []),
        ("Non", "https://photos.example.org/7", "", [status]),
        ("Inconnu", "", "box 12", [status]),
        ("Non acquise", "", "", []),
        ("", "", "", []),
        ("perhaps", "", "", [("INVALID_NOMENCLATURE", "id_nomenclature_exist_proof")]),
    )
    _, checked, _, _ = run(rows)
    held(checked, issues)


def test_depths(run):
    rows, issues = table(
        ["depth_min", "depth_max"],
        ("3", "3", []), ("4", "3", [("DEPTH_MIN_SUP_ALTI_MAX", "depth_min")]), ("4", "", []), ("", "3", []),
    )
    _, checked, _, _ = run(rows)
    held(checked, issues)


def test_literature_needs_its_reference(run):
    bare = [("CONDITIONAL_MANDATORY_FIELD_ERROR", "id_nomenclature_source_status")]
    rows, issues = table(
        ["id_nomenclature_source_status", "reference_biblio"],
        ("Littérature", "", bare), ("Littérature", "Flora, vol. 2", []), ("Terrain", "", []), ("", "", []),
    )
    _, checked, _, _ = run(rows)
    held(checked, issues)


def test_blurring_of_private_data(run):
    bare = [("CONDITIONAL_MANDATORY_FIELD_ERROR", "id_nomenclature_blurring")]
    unknown = [("INVALID_NOMENCLATURE", "id_nomenclature_blurring")]
    rows = [{"id_nomenclature_blurring": v} for v in ("Oui", "Non", "")]
    strict = {"fill_missing_vocabulary": False}
    held(run(rows, private=True, settings=strict)[1], [[], [], bare + unknown])
    held(run(rows, private=False, settings=strict)[1], [[], [], unknown])


def test_defaults_of_vocabularies(run):
    """An empty cell takes what the mapping says of the empty value, then the default."""
    content = label_mapping()
    content["STADE_VIE"][""] = "2"
    rows, nothing = table(
        ["id_nomenclature_naturalness", "id_nomenclature_life_stage"],
        ("Sauvage", "Alevin", []), ("", "Alevin", []), ("Sauvage", "", []),
    )
    _, filled, _, _ = run(rows, content=content)
    held(filled, nothing)
    by_line = {r["line_no"]: r for r in filled.rows.collect()}
    assert [by_line[n]["id_nomenclature_naturalness"] for n in (1, 2, 3)] == [182, 181, 182]
    assert [by_line[n]["id_nomenclature_life_stage"] for n in (1, 2, 3)] == [18, 18, 3]
    assert by_line[1]["id_nomenclature_determination_method"] == 379  # not in the file at all
    _, bare, _, _ = run(rows, content=content, settings={"fill_missing_vocabulary": False})
    held(bare, [[], [("INVALID_NOMENCLATURE", "id_nomenclature_naturalness")], []])


def test_json_cells_merge_with_plain_ones(run, spark, tmp_path):
    site = {"site": {"name": "Étang", "visits": [1, 2, {"by": "boat"}]}}
    _, checked, load, options = run([{"additional_data": json.dumps(site, ensure_ascii=False, indent=2)}])
    held(checked, [[]])
    commit(checked.rows, load, options, str(tmp_path / "target"))
    stored = spark.read.parquet(str(tmp_path / "target")).first()
    assert json.loads(stored["additional_data"]) == site | {"cd_nom": "45013"}
    assert (stored["id_source"], stored["id_dataset"], stored["last_action"]) == (50, 7, "I")


def test_breaks_and_quotes_come_back_in_the_export(run, spark, tmp_path):
    notes = ['two\nlines; one "quoted"', "plain", "a;b"]
    names = ["cd_nom", "comment_description"]
    rows = [dict(zip(names, cells, strict=True)) for cells in zip(["", "45013", "0"], notes, strict=True)]
    staged, checked, load, options = run(rows)
    held(checked, [[("MISSING_VALUE", "cd_nom")], [], [("CD_NOM_NOT_FOUND", "cd_nom")]])
    commit(checked.rows, load, options, str(tmp_path / "target"))
    assert [r["comment_description"] for r in spark.read.parquet(str(tmp_path / "target")).collect()] == [notes[1]]
    write_delimited(invalid_records(staged.records, checked.rows, load.columns).coalesce(1), str(tmp_path / "bad"), ";")
    with open(glob.glob(str(tmp_path / "bad" / "*.csv"))[0], newline="") as f:
        back = list(csv.DictReader(f, delimiter=";"))
    assert [r["comment_description"] for r in back] == [notes[0], notes[2]] and list(back[0]) == list(load.columns)


def test_issues_bear_the_names_of_the_file(run):
    """Columns of the file's own names, mapped; the columns in the issues are the file's."""
    mapping = {
        "entity_source_pk_value": "no", "date_min": "seen", "cd_nom": "taxon", "nom_cite": "said", "WKT": "where",
        "count_min": "from", "count_max": "to",
    }
    base = {"seen": "2023-05-03", "said": "x", "where": "POINT(3.75 45.95)", "taxon": "45013", "no": "", "from": "", "to": ""}
    rows, issues = table(
        ["no", "from", "to", "taxon"],
        ("a", "2", "2", "45013", []),
        ("a-", "", "4", "45207", []),
        ("b", "9", "8", "45399", [("COUNT_MIN_SUP_COUNT_MAX", "from")]),
        ("c", "", "", "45871", [("DUPLICATE_ENTITY_SOURCE_PK", "no")]),
        ("c", "1", "", "45871", [("DUPLICATE_ENTITY_SOURCE_PK", "no")]),
        ("d", "", "", "none", [("INVALID_INTEGER", "taxon")]),
    )
    _, checked, _, _ = run(rows, mapping=mapping, base=base)
    held(checked, issues)
    assert {r["cd_nom"] for r in checked.rows.where("valid").collect()} == {45013, 45207}


def test_shapes_of_areas_are_joined_when_rows_are_appended(run, spark, dims, tmp_path):
    none = {"WKT": ""}
    codes = [{"codecommune": "29314"}, {"codemaille": "G10-091-625"}, {}]
    _, checked, load, options = run([{**none, **c} if c else c for c in codes], generate=True)
    held = {r["line_no"]: r for r in checked.rows.collect()}
    assert all(held[n]["valid"] and held[n]["the_geom_local"] is None for n in (1, 2)) and held[3]["the_geom_local"]
    # altitudes of attached rows come from the shape of their area
    assert held[1]["altitude_min"] is None and held[3]["altitude_min"] == 412
    with pytest.raises(ValueError, match="attached to areas"):
        commit(checked.rows, load, options, str(tmp_path / "bare"))
    commit(checked.rows, load, options, str(tmp_path / "target"), areas=dims.areas)
    rows = spark.read.parquet(str(tmp_path / "target")).orderBy("id_area_attachment").collect()
    assert [r["id_area_attachment"] for r in rows] == [None, 1, 3]
    corner = rows[1]["the_geom_local"]["parts"][0][0][0]
    assert (corner["x"], corner["y"]) == (895000, 6245000) and rows[2]["the_geom_4326"]["kind"] == "POLYGON"
    assert rows[0]["the_geom_4326"]["kind"] == "POINT" and all(r["the_geom_point"]["kind"] == "POINT" for r in rows)


def test_no_shape_of_an_area_travels_with_rows(run, spark, dims, monkeypatch):
    from obsload import workspace
    from obsload.operators import areas, keyed
    from obsload.plans import check

    plans = []

    def noted(df, label):
        plans.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        return workspace.written(df, label)

    for module in (areas, keyed, check):
        monkeypatch.setattr(module, "written", noted)
    run([{"WKT": "", "codecommune": "29314", "unique_id_sinp": "", "entity_source_pk_value": "7"}] * 3)
    labels = [label for label, _ in plans]
    assert labels.count("counts") == 1 and labels[0] == "row-checks" and labels[-1] == "checked"
    counted = dict(plans)["counts"]
    assert "Join" not in counted and "the_geom" not in counted
    # what joins the rows: answers of the look-ups, none of which holds a shape
    joined = [line for line in plans[-1][1].splitlines() if "Relation" in line]
    assert joined and sum("geom" in line and "src_" not in line for line in joined) == 0
