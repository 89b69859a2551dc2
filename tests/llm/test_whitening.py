"""Whitened vectors agree with the dense eigendecomposition of numpy."""

import math

import numpy as np
import pytest

from obsload.llm import whitening
from obsload.llm.queries import op11_whitening
from obsload.llm.registry import table

SCHEMA = "vec_id long, embedding array<float>"


def integers(rows):
    return np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in rows])


def expected(x, k):
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return deviation, centred @ axes / np.sqrt(values), values / np.trace(v)


def compare(found, ids, x, k):
    deviation, z, share = expected(x, k)
    at = {i: r for r, i in enumerate(ids)}
    got = np.full((len(ids), k), np.nan)
    for r in found:
        row = at[r["vec_id"]]
        got[row, r["component"] - 1] = r["whitened"]
        assert r["n"] == len(ids) and r["deviation"] == deviation[row]
        assert abs(r["explained"] - share[r["component"] - 1]) < 1e-10 and r["identity_error"] < 1e-8
    for c in range(k):
        sign = np.sign(got[:, c] @ z[:, c])
        np.testing.assert_allclose(got[:, c] * sign, z[:, c], atol=1e-8)


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = table(spark, folder, "embeddings").collect()
    rows = [r for r in rows if r["embedding"] and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    found = op11_whitening(spark, folder).collect()
    assert len(found) == 8 * len(rows)
    compare(found, [r["vec_id"] for r in rows], integers([r["embedding"] for r in rows]), 8)


@pytest.mark.parametrize("dims", [3, 28, 60])
def test_unlike_spectra(spark, dims):
    rng = np.random.default_rng(dims)
    rows = (rng.standard_normal((300, dims)) * np.geomspace(9, 0.01, dims)).astype(np.float32).tolist()
    docs = spark.createDataFrame(list(enumerate(rows)), SCHEMA).repartition(5)
    k = min(dims, 8)
    compare(whitening.whitened(docs).collect(), list(range(300)), integers(rows), k)


def test_rows_that_do_not_count(spark):
    good = np.random.default_rng(0).standard_normal((40, 4)).astype(np.float32).tolist()
    bad = [None, [], [1.0, None, 2.0, 3.0], [float("nan")] * 4, [1.0, float("inf"), 0.0, 0.0], [None] * 4]
    rows = [(i, v, "x") for i, v in enumerate(bad + good)] + [(None, good[0], None)]
    docs = spark.createDataFrame(rows, SCHEMA + ", whitened string")
    found = whitening.whitened(docs).collect()
    assert {r["vec_id"] for r in found} == {None, *range(6, 46)} and len(found) == 41 * 4
    assert {r["n"] for r in found} == {41}
    repeated = {r["component"]: r["whitened"] for r in found if r["vec_id"] is None}
    assert repeated == {r["component"]: r["whitened"] for r in found if r["vec_id"] == 6}


def test_ranks_below_the_components(spark):
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(10)]
    found = whitening.whitened(spark.createDataFrame(line, SCHEMA)).collect()
    assert {r["component"] for r in found} == {1} and len(found) == 10
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], [(1, None)]):
        assert whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_equal_eigenvalues(spark):
    rows = [(4 * j + s, [(1.0 if s % 2 else -1.0) * (j == i) for i in range(3)]) for j in range(3) for s in range(4)]
    found = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 36 and all(r["identity_error"] < 1e-8 and abs(r["explained"] - 1 / 3) < 1e-3 for r in found)


def test_refusals_and_exactness(spark):
    unlike = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA)
    with pytest.raises(Exception, match="differ in length"):
        whitening.whitened(unlike.repartition(2)).collect()
    with pytest.raises(ValueError, match="named like a result"):
        whitening.whitened(unlike.withColumnRenamed("vec_id", "n"), "n")
    x = np.array([[2**29, -(2**28)], [5, 7]])
    exact = [(3 * 2**29 - 5) ** 2 + (3 * 2**28 + 7) ** 2, 10**2 + 14**2]
    assert whitening.deviations(x, 3, [5, 7]).tolist() == exact
    with pytest.raises(OverflowError):
        whitening.deviations(x, 9, [0, 0])
