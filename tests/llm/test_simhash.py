"""Fingerprints and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from obsload.llm import simhash
from obsload.llm.queries import op1_simhash


def plain_fingerprint(text, k=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=2):
    ids, found = sorted(fps), {}
    for start in ids:
        if start in found:
            continue
        todo = [start]
        found[start] = start
        while todo:
            a = todo.pop()
            for b in ids:
                if b not in found and (fps[a] ^ fps[b]).bit_count() <= radius:
                    found[b] = start
                    todo.append(b)
    return found


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aBcÉ \t\n\x0b .\x1c\x85"))))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_join_exactly_the_near(spark, radius):
    random.seed(radius)
    values = {0, 1, 2**63, 2**64 - 1}
    for _ in range(30):
        value = random.getrandbits(64)
        for _ in range(12):
            values.add(value)
            for _ in range(random.randint(1, 4)):
                value ^= 1 << random.randrange(64)
    fps = dict(enumerate(sorted(values)))
    signed = [(i, int(np.uint64(v).astype(np.int64))) for i, v in fps.items()]
    frame = spark.createDataFrame(signed, "id long, fp long")
    found = simhash.components(simhash.links(frame, radius))
    roots = {r["node"]: r["root"] for r in found.collect()}
    of = {i: int(simhash.mixed(np.array([v], np.int64))[0]) for i, v in signed}
    groups = {i: roots.get(of[i], of[i]) for i in fps}
    expected = plain_components(fps, radius)
    assert len({(groups[i], expected[i]) for i in fps}) == len(set(groups.values())) == len(set(expected.values()))


def test_large_shards_are_searched_whole():
    base = np.uint64(0x0123456789ABCDEF)
    rng = np.random.default_rng(1)
    fps = np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)))
    found = {tuple(sorted(p)) for a, b in simhash.close_pairs(fps, 2) for p in zip(a.tolist(), b.tolist(), strict=True)}
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    assert found == {(i, j) for i, j in zip(*np.nonzero(apart <= 2), strict=True) if i < j}


def test_rows_with_nulls_repeats_and_clashing_columns(spark):
    text = "one two three four five six seven"
    rows = [(5, text, 1), (3, text.upper(), 2), (3, text, 3), (None, text, 4), (9, None, 5), (8, " \t", 6), (7, "z", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    found = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert found == [(0, 3), (3, 3), (3, 3), (5, 3), (7, 7), (8, 8), (9, 8)]
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 7, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.one_of_each_group(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    expected = plain_components(fps)
    rows = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op1_simhash(spark, folder).collect()}
    assert rows == {i: (f"{fps[i]:016x}", expected[i]) for i in fps}
