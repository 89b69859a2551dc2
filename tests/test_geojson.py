"""One collection read in blocks gives the features that a JSON reader finds in the whole file."""

import json
import random

import pytest

from obsload.sources.geojson import property_names, read_features, read_geojson


def made(seed, n):
    rng = random.Random(seed)
    odd = ['a"b', "{", "}", "]}", "[{", "\\", 'end\\"', "é日", "x" * 120, "", "\n", '"features":[{']
    features = []
    for i in range(n):
        shape = rng.choice([
            {"type": "Point", "coordinates": [i, 1.5]},
            {"type": "Polygon", "coordinates": [[[0, 0], [i + 1, 0], [0, 1], [0, 0]]]},
            None,
        ])
        props = {"key": f"{seed}-{i}", "said": rng.choice(odd), "in": {"deep": [rng.choice(odd), {"er": {}}]}}
        features.append({"type": "Feature", "properties": props, "geometry": shape})
    return features


@pytest.mark.parametrize("size, indent", [(200, None), (333, 1), (10**6, None)])
def test_blocks_that_cut_features(spark, tmp_path, size, indent):
    crs = {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}
    whole = {}
    for name, n in (("a.geojson", 60), ("b.geojson", 0), ("c.geojson", 1), ("d.geojson", 25)):
        whole[name] = made(name, n)
        body = {"type": "FeatureCollection", "crs": crs, "features": whole[name], "bbox": [0, 1, 2, 3], "note": "{["}
        (tmp_path / name).write_text(json.dumps(body, indent=indent, ensure_ascii=len(name) % 2 == 0) + "\n")
    settings = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        texts = read_features(spark, str(tmp_path))
        rows = read_geojson(spark, str(tmp_path), ["key", "said", "in"])
        names = property_names(spark, str(tmp_path))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    expected = [f for features in whole.values() for f in features]
    found = [json.loads(r["feature"]) for r in texts.collect()]
    order = lambda f: json.dumps(f, sort_keys=True)
    # the properties of the named system are an object two levels deep too; they are no feature
    assert sorted((f for f in found if "type" in f), key=order) == sorted(expected, key=order)
    got = {r["key"]: r for r in rows.collect()}
    assert len(got) == rows.count() == len(expected) and names == ["in", "key", "said"]
    for f in expected:
        r, g = got[f["properties"]["key"]], f["geometry"]
        assert r["said"] == f["properties"]["said"] and json.loads(r["in"]) == f["properties"]["in"]
        assert (r["WKT"] is None) == (g is None) and (g is None or r["WKT"].startswith(g["type"].upper()))


def test_too_many_names_are_refused(spark, tmp_path):
    body = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {f"p{i}": i}, "geometry": None} for i in range(9)]}
    (tmp_path / "a.geojson").write_text(json.dumps(body))
    assert len(property_names(spark, str(tmp_path))) == 9
    with pytest.raises(ValueError, match="more than 5"):
        property_names(spark, str(tmp_path), 5)
