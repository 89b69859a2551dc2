import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from obsload.functions.geometry import parse_wkt  # noqa: E402
from obsload.model.dictionary import DICTIONARY  # noqa: E402
from obsload.model.loads import Dimensions, Load, Settings  # noqa: E402
from obsload.plans.check import check_load  # noqa: E402
from obsload.plans.load import load_files  # noqa: E402
from obsload.session import build_session  # noqa: E402

AS_OF = dt.date(2024, 6, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("work")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


VOCABULARY = [
    ("PREUVE_EXIST", "0", "Inconnu", 81, True),
    ("PREUVE_EXIST", "1", "Oui", 82, False),
    ("PREUVE_EXIST", "2", "Non", 83, False),
    ("PREUVE_EXIST", "3", "Non acquise", 84, False),
    ("STATUT_SOURCE", "Li", "Littérature", 73, False),
    ("STATUT_SOURCE", "Te", "Terrain", 75, False),
    ("STATUT_SOURCE", "NSP", "Ne sait pas", 72, True),
    ("STADE_VIE", "2", "Adulte", 3, False),
    ("STADE_VIE", "17", "Alevin", 18, False),
    ("NATURALITE", "0", "Inconnu", 181, True),
    ("NATURALITE", "1", "Sauvage", 182, False),
    ("DEE_FLOU", "NON", "Non", 174, False),
    ("DEE_FLOU", "OUI", "Oui", 175, False),
    ("NAT_OBJ_GEO", "In", "Inventoriel", 177, False),
    ("NAT_OBJ_GEO", "NSP", "Ne sait pas", 176, True),
    ("METH_DETERMIN", "1", "Non renseigné", 379, True),
]


@pytest.fixture(scope="session")
def dims(spark):
    square = "POLYGON(({0} {1}, {2} {1}, {2} {3}, {0} {3}, {0} {1}))"
    areas = spark.createDataFrame(
        [
            (1, "COM", "29314", square.format(895000, 6245000, 905000, 6252000)),
            (2, "DEP", "58", square.format(800000, 6230000, 950000, 6320000)),
            (3, "M10", "G10-091-625", square.format(910000, 6250000, 920000, 6260000)),
        ],
        "id_area int, type string, code string, wkt string",
    ).select("id_area", "type", "code", parse_wkt(F.col("wkt")).alias("geom"))
    # one cell of the grid holds the position used throughout, 3.75 E 45.95 N
    elevation = spark.createDataFrame([(30323, 261567, 412)], "cx int, cy int, alt int")
    ranks = "regne string, phylum string, classe string, ordre string"
    taxa = spark.createDataFrame(
        [
            (45013, "Animalia", "Chordata", "Actinopterygii", "Cypriniformes"),
            (45207, "Animalia", "Chordata", "Mammalia", "Carnivora"),
            (45399, "Animalia", "Chordata", "Amphibia", "Anura"),
            (45871, "Animalia", "Annelida", "Clitellata", "Haplotaxida"),
        ],
        f"cd_nom int, {ranks}",
    )
    target = spark.createDataFrame(
        [("7d1c0a52-93be-4f06-8c1d-52b7e0c4a917", 7, 1), ("00000000-0000-4000-8000-000000000001", 8, 1)],
        "unique_id_sinp string, id_dataset int, id_source int",
    )
    return Dimensions(
        taxa=taxa,
        taxa_list=spark.createDataFrame([(1, 45013)], "id_list int, cd_nom int"),
        habitats=spark.createDataFrame([(214,)], "cd_hab int"),
        vocabulary=spark.createDataFrame(
            VOCABULARY, "vocab string, code string, label string, id int, is_default boolean"
        ),
        areas=areas,
        elevation=elevation,
        target=target,
    )


def label_mapping():
    out = {}
    for vocab, code, label, _, _ in VOCABULARY:
        out.setdefault(vocab, {})[label] = code
    return out


BASE = {
    "date_min": "2018-07-19",
    "nom_cite": "Petit gravelot",
    "observateurs": "Odile Perec",
    "WKT": "POINT(3.75 45.95)",
    "cd_nom": "45013",
}


def identity_mapping(generate):
    mapping = {}
    for f in DICTIONARY:
        if f.display:
            mapping[f.name] = generate if f.generated else ([f.name, "cd_nom"] if f.multi else f.name)
    return mapping


@pytest.fixture()
def run(spark, dims, tmp_path):
    """Writes rows as a delimited file, loads and checks it."""

    def go(rows, generate=True, content=None, settings=None, mapping=None, private=False, base=BASE):
        columns = list(dict.fromkeys([*base, *[c for r in rows for c in r]]))
        path = tmp_path / "file.csv"
        cells = [columns] + [[{**base, **r}.get(c, "") for c in columns] for r in rows]
        quote = lambda v: '"' + v.replace('"', '""') + '"' if any(x in v for x in ';"\n') else v
        path.write_text("\n".join(";".join(quote(v) for v in line) for line in cells) + "\n")
        load = Load(
            1,
            tuple(columns),
            mapping or identity_mapping(generate),
            content or label_mapping(),
            id_dataset=7,
            id_source=50,
            id_module=3,
            private_dataset=private,
        )
        options = Settings(as_of=AS_OF, **(settings or {}))
        staged = load_files(spark, str(path), load)
        checked = check_load(staged.rows, load, dims, options)
        return staged, checked, load, options

    return go


def issue_sets(checked):
    found = {}
    for r in checked.issues.collect():
        found.setdefault((r["code"], r["column"]), set()).add(r["line_no"])
    return found
