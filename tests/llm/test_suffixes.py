"""Suffix arrays, common prefixes and removed bytes against brute force."""

import hashlib
import random

import numpy as np
import pytest

from obsload.llm import suffixes
from obsload.llm.queries import op5_suffixes


def plain_removed(texts, length):
    """Marked bytes of each text: those under a string that starts at two places."""
    seen = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - length + 1):
            seen.setdefault(t[k : k + length], []).append((i, k))
    marks = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                marks[i][k : k + length] = True
    return marks


def plain_result(texts, length):
    out = []
    for t, m in zip(texts, plain_removed(texts, length), strict=True):
        edges = np.diff(np.r_[0, m.astype(int), 0])
        out.append((len(t), int(m.sum()), int((edges == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~m])))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_order_and_common_prefixes(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(0, 3, 200)
    s[100:160] = s[20:80]
    order = suffixes.suffix_array(s, 400)
    assert order.tolist() == sorted(range(200), key=lambda i: s[i:].tolist())
    shared = suffixes.common_prefixes(s, order)
    for r in range(1, 200):
        a, b = s[order[r - 1] :], s[order[r] :]
        k = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert shared[r] == k


def test_anchors_of_equal_strings_agree(monkeypatch):
    rng = np.random.default_rng(3)
    common = rng.integers(97, 123, 60).astype(np.uint8)
    for block in (1 << 20, 64):
        monkeypatch.setattr(suffixes, "_BLOCK", block)
        a, b = (np.r_[rng.integers(97, 123, n), common, rng.integers(97, 123, 90)].astype(np.uint8) for n in (130, 77))
        at_a, hash_a, _ = suffixes.anchors(a, 50, 10)
        at_b, hash_b, _ = suffixes.anchors(b, 50, 10)
        in_a = {(p - 130, h) for p, h in zip(at_a.tolist(), hash_a.tolist(), strict=True) if 130 <= p <= 130 + 50}
        in_b = {(p - 77, h) for p, h in zip(at_b.tolist(), hash_b.tolist(), strict=True) if 77 <= p <= 77 + 50}
        assert in_a & in_b


def documents(seed):
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [letters(rng.randrange(30, 90)) for _ in range(4)]
    texts = [letters(rng.randrange(0, 60)) + rng.choice(passages) + letters(rng.randrange(0, 60)) + rng.choice(passages) for _ in range(40)]
    return [*texts, texts[0], texts[0], "", None, "a" * 150, "ab" * 60, passages[0][:29], passages[1] * 3]


@pytest.mark.parametrize("shard, hot", [(1 << 20, 1000), (300, 1000), (1 << 20, 2)])
def test_removed_bytes_against_brute_force(spark, monkeypatch, shard, hot):
    """Shards of any size and groups taken apart or not leave the same bytes."""
    monkeypatch.setattr(suffixes, "SHARD", shard)
    monkeypatch.setattr(suffixes, "HOT", hot)
    texts = documents(shard)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = suffixes.without_repeats(docs, length=30, seed=8)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()}
    expected = plain_result([(t or "").encode() for t in texts], 30)
    assert [got[i] for i in range(len(texts))] == expected
    assert suffixes.without_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_shards_of_one_group_find_each_other(monkeypatch, seed):
    """The in-task search alone, with groups split over many shards."""
    import pyarrow as pa

    rng = random.Random(seed)
    monkeypatch.setattr(suffixes, "SHARD", 250)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(20, 60))) for _ in range(60)]
    texts[10] = texts[3][:25] + texts[10]
    rows = pa.RecordBatch.from_arrays(
        [pa.array([1] * 60), pa.array([b"%02d" % i for i in range(60)]), pa.array([0] * 60), pa.array(texts)],
        ["anchor", "owner", "begin", "around"],
    )
    marks = [np.zeros(len(t), bool) for t in texts]
    for batch in suffixes._search(iter([rows]), 12):
        for r in batch.to_pylist():
            marks[int(r["owner"])][r["begin"] : r["end"]] = True
    for found, plain in zip(marks, plain_removed(texts, 12), strict=True):
        assert found.tolist() == plain.tolist()


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    expected = plain_result([(r["text"] or "").encode() for r in rows], 200)
    got = {r["doc_id"]: r for r in op5_suffixes(spark, folder).collect()}
    assert len(got) == len(rows)
    for r, (n, removed, spans, kept) in zip(rows, expected, strict=True):
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["n_removed"], g["n_spans"]) == (n, removed, spans)
        assert g["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert sum(e[1] for e in expected) > 0
