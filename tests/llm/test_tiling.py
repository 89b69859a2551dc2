"""Tiles, covers and the query against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from obsload.llm import tiling
from obsload.llm.queries import op3_tiling

FOLDER = "/root/testdata/sf0.01"


def plain_tiles(item, text, least):
    """Longest unmarked common run first, found by trying all places."""
    free_p, free_t, tiles = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                k = 0
                while p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k] and free_p[p + k] and free_t[t + k]:
                    k += 1
                best = max(best, (k, -p, -t))
        k, p, t = best[0], -best[1], -best[2]
        if k < least:
            return tiles
        free_p[p : p + k] = free_t[t : t + k] = [False] * k
        tiles.append((k, p, t))


@pytest.mark.parametrize("seed", range(60))
def test_tiles_have_the_sizes_of_the_plain_ones(seed):
    rng = random.Random(seed)
    item = [rng.randrange(1, 40) for _ in range(60)]
    parts = [item[i : i + rng.randrange(3, 25)] for i in range(0, 60, 20)]
    rng.shuffle(parts)
    text = [x for part in parts for x in [*part, *[rng.randrange(50, 90) for _ in range(3)]]]
    found, plain = tiling.tile(item, text, 3), plain_tiles(item, text, 3)
    assert [k for k, *_ in found] == [k for k, *_ in plain]
    for k, p, t in found:
        assert item[p : p + k] == text[t : t + k]


def test_gaps_and_repeats_are_not_bridged():
    item = [1, 2, 3, 4, 5, 6]
    assert tiling.tile(item, [1, 2, 3, tiling._GAP, 4, 5, 6], 3) == [(3, 0, 0), (3, 3, 4)]
    assert sum(k for k, *_ in tiling.tile([7] * 12, [7] * 5, 5)) == 5


def test_leaks_in_another_order_and_near_misses(spark):
    item = " ".join(f"w{i}" for i in range(40))
    halves = item.split()[20:] + ["x", "y"] + item.split()[:20]
    rows = [
        (1, f"Before it. {item.upper()}! And after", 0),
        (2, " ".join(halves), 0),
        (3, " ".join(item.split()[:31]), 0),  # 31 of 40 words
        (4, " ".join(item.split()[:32]), 0),  # 32 of 40 words
        (5, " ".join(w for i in range(0, 40, 4) for w in [*item.split()[i : i + 4], "z"]), 0),  # runs of four
        (6, None, 0),
        (7, "", 0),
        (None, item, 0),
        (1, "clean words only here and there", 0),
        (1, f"Before it. {item.upper()}! And after", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words int")
    bench = spark.createDataFrame([(9, item, 1), (10, None, 1), (11, "a b c", 1), (12, "", 1)], "item_id long, text string, doc_id int")
    found = {(r["doc_id"], r["item_id"]): r["coverage"] for r in tiling.leaks(docs, bench).collect()}
    assert found == {(1, 9): 1.0, (2, 9): 1.0, (4, 9): 0.8, (None, 9): 1.0}
    kept = tiling.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7]
    assert tiling.leaks(docs.limit(0), bench).count() == 0
    assert tiling.without_leaks(docs, bench.limit(0)).count() == len(rows)


def test_query_against_plain_cover(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    words = lambda t: re.findall(r"\w+", t.lower())
    split = {i: words(t) for i, t in items.items()}
    runs = {}
    for i, w in split.items():
        for k in range(len(w) - 4):
            runs.setdefault(tuple(w[k : k + 5]), set()).add(i)
    expected = {}
    for d, text in docs.items():
        w = words(text)
        for i in set().union(*[runs.get(tuple(w[k : k + 5]), ()) for k in range(len(w) - 4)]):
            share = sum(k for k, *_ in plain_tiles(split[i], w, 5)) / len(split[i])
            if share >= 0.8:
                expected[d, i] = share
    rows = op3_tiling(spark, FOLDER)
    assert {(r["doc_id"], r["item_id"]): r["coverage"] for r in rows.collect()} == expected
    assert len(expected) > 10 and rows.where(F.col("coverage") > 1).count() == 0
