"""Benchmark decontamination by greedy string tiling.

A tile is a run of words that stands in a benchmark item and in a document, in any order and not
overlapping another tile. An item counts as leaked where tiles cover at least ``THRESHOLD`` of its words,
so a passage whose sentences were put in another order is caught as the verbatim one is.

Every tile has ``LEAST`` words or more, so it begins with a seed, a run of exactly that many words. The
documents are read once: seeds of a text are looked up in a bit table of the benchmark's seeds, whose size
is fixed whatever the benchmark's, and only the stretches around known seeds go on. Seeds then meet the
benchmark's seeds in a join; pairs whose shared seeds could cover enough of the item are tiled.

Words are runs of letters, digits and underscores of the lower-cased text. Odd input: null or empty texts
and items, and items of fewer than ``LEAST`` words, match nothing. Repeated rows of one document give one
result; rows that share an id and differ in text are tiled apart and the best cover is reported. A null id
is an id like others. Very long texts are read whole, though only stretches around known seeds travel; of tiles of
equal length the first in the item is marked first. Either table may be empty, and extra columns are left out of the
result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsload.llm.names import free
from obsload.workspace import written

LEAST = 5
THRESHOLD = 0.8
TABLE_BITS = 24
_WORDS = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PRIME = (1 << 61) - 1
_GAP = -1  # before, between and after the stretches of a document; equal to no word


def word_numbers(text: str | None) -> np.ndarray:
    """A 63-bit number for each word of a text."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in _WORDS.findall((text or "").lower())], dtype=np.uint64) >> np.uint64(1)


def seeds_of(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Hash of the ``least`` words from each place on."""
    n = max(0, len(words) - least + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(least):
        out = out * _BASE + words[k : k + n]
    return out ^ out >> np.uint64(31)


def longest_common(item: Sequence[int], text: Sequence[int], size: int, in_item, in_text) -> list[tuple[int, int, int]]:
    """Unmarked common runs ``(length, item place, text place)`` of at least ``size``, extended to the right.

    Windows of ``size`` words are compared by a rolling hash and confirmed word by word. A run longer than
    twice the size ends the search and is the only one returned.
    """
    top = pow(31, size - 1, _PRIME)

    def windows(values: Sequence[int], marked) -> Iterator[tuple[int, int]]:
        rolling = run = 0
        for i, x in enumerate(values):
            if marked[i] or x == _GAP:
                rolling = run = 0
                continue
            if run >= size:
                rolling = (rolling - values[i - size] * top) % _PRIME
            rolling = (rolling * 31 + x) % _PRIME
            run += 1
            if run >= size:
                yield i - size + 1, rolling

    places = defaultdict(list)
    for t, h in windows(text, in_text):
        places[h].append(t)
    found = []
    for p, h in windows(item, in_item):
        for t in places.get(h, ()):
            k = 0
            while p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k] != _GAP and not (in_item[p + k] or in_text[t + k]):
                k += 1
            if k > 2 * size:
                return [(k, p, t)]
            if k >= size:
                found.append((k, p, t))
    return found


def tile(item: Sequence[int], text: Sequence[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(length, item place, text place)``, longest first."""
    in_item, in_text = bytearray(len(item)), bytearray(len(text))
    size, tiles = max(least, 4 * least), []
    while True:
        found = longest_common(item, text, size, in_item, in_text)
        if found and found[0][0] > 2 * size:
            size = found[0][0]
            continue
        for k, p, t in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            # what an earlier tile took is cut off; the free part counts while it is long enough
            free = next((x for x in range(k) if in_item[p + x] or in_text[t + x]), k)
            if free >= size:
                in_item[p : p + free] = in_text[t : t + free] = b"\1" * free
                tiles.append((free, p, t))
        if found:
            continue  # parts that a tile has cut apart may still hold runs of this size
        if size == least:
            return tiles
        size = max(least, size // 2)


def _item_rows(items: DataFrame, item_id: str, text: str, least: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_numbers(t.as_py()) for t in batch.column(1)]
            rows = [w.astype(np.int64).tolist() for w in words]
            seeds = [seeds_of(w, least).view(np.int64).tolist() for w in words]
            kinds = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kinds), pa.array(seeds, kinds)], ["item_id", "words", "seeds"])

    kind = items.schema[item_id].dataType.simpleString()
    narrow = items.select(item_id, F.col(text).cast("string"))
    return narrow.mapInArrow(read, f"item_id {kind}, words array<bigint>, seeds array<bigint>")


def _bit_table(seeds: DataFrame) -> np.ndarray:
    """Bits set at two places for each seed, as 64-bit words: at most two to the ``TABLE_BITS`` minus six rows."""
    low = F.lit((1 << TABLE_BITS) - 1)
    at = F.explode(F.array(F.shiftrightunsigned("seed", 64 - TABLE_BITS), F.col("seed").bitwiseAND(low))).alias("at")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))
    words = seeds.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    table = np.zeros(1 << TABLE_BITS - 6, dtype=np.int64)
    for r in words.collect():
        table[r["word"]] = r["bits"]
    return table.view(np.uint64)


def _known(seeds: np.ndarray, table: np.ndarray) -> np.ndarray:
    def is_set(at):
        return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    first = is_set(seeds >> np.uint64(64 - TABLE_BITS))
    hit = np.flatnonzero(first)
    first[hit] = is_set(seeds[hit] & np.uint64((1 << TABLE_BITS) - 1))
    return first


def _stretches(docs: DataFrame, doc_id: str, text: str, table: np.ndarray, least: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(table)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, seeds = [], [], []
            for i, t in enumerate(batch.column(2)):
                words = word_numbers(t.as_py())
                own = seeds_of(words, least)
                hit = np.flatnonzero(_known(own, held.value)) if len(own) else own
                if not len(hit):
                    continue
                kept = np.zeros(len(words) + 1, dtype=bool)
                for k in range(least):
                    kept[hit + k] = True
                cut = np.flatnonzero(kept[1:] & ~kept[:-1]) + 1  # a gap before each stretch but the first
                values = np.insert(words.astype(np.int64), cut, _GAP)
                rows.append(values[np.insert(kept[:-1], cut, True)].tolist())
                seeds.append(np.unique(own[hit].view(np.int64)).tolist())
                at.append(i)
            kinds = pa.list_(pa.int64())
            place = pa.array(at, pa.int64())
            named = [batch.column(0).take(place), batch.column(1).take(place), pa.array(rows, kinds), pa.array(seeds, kinds)]
            yield pa.RecordBatch.from_arrays(named, ["doc_id", "text_hash", "stretches", "seeds"])

    kind = docs.schema[doc_id].dataType.simpleString()
    narrow = docs.select(doc_id, F.xxhash64(F.col(text).cast("string")), F.col(text).cast("string"))
    return narrow.mapInArrow(read, f"doc_id {kind}, text_hash bigint, stretches array<bigint>, seeds array<bigint>")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: int = LEAST,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``(doc_id, text_hash, item_id, coverage, item_words, n_tiles, longest)`` for each text and leaked item.

    ``text_hash`` is Spark's ``xxhash64`` of the text; it tells apart rows that share an id.
    """
    items = written(_item_rows(benchmark, item_id, item_text, least), "items")
    item_seeds = items.select("item_id", F.size("words").alias("n"), F.explode("seeds").alias("seed"))
    stretches = written(
        _stretches(docs, doc_id, text, _bit_table(item_seeds.select("seed")), least)
        .dropDuplicates(["doc_id", "text_hash"])
        .withColumn("key", F.monotonically_increasing_id()),
        "stretches",
    )
    shared = stretches.select("key", F.explode("seeds").alias("seed")).join(item_seeds, "seed")
    # each shared seed covers so many words of the item at most
    enough = F.count(F.lit(1)) * least >= F.lit(threshold) * F.first("n")
    pairs = shared.groupBy("key", "item_id").agg(enough.alias("enough")).where("enough").select("key", "item_id")
    met = pairs.join(stretches.drop("seeds"), "key").join(items.drop("seeds").withColumnRenamed("item_id", "_item"), F.col("item_id").eqNullSafe(F.col("_item")))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for words, stretch in zip(batch.column(3), batch.column(4), strict=True):
                item = words.as_py()
                tiles = tile(item, stretch.as_py(), least)
                rows.append((sum(k for k, *_ in tiles) / len(item), len(item), len(tiles), max((k for k, *_ in tiles), default=0)))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.float64(), pa.int32(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], _RESULT)

    kinds = [met.schema[c].dataType.simpleString() for c in _RESULT[:3]] + ["double", "int", "int", "int"]
    tiled = met.select(*_RESULT[:3], "words", "stretches").mapInArrow(cover, ", ".join(f"{c} {k}" for c, k in zip(_RESULT, kinds, strict=True)))
    return tiled.where(F.col("coverage") >= threshold)


_RESULT = ["doc_id", "text_hash", "item_id", "coverage", "item_words", "n_tiles", "longest"]


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text leaks no benchmark item."""
    leaking, hashed = free(docs, "_id", "_hash")
    found = leaks(docs, benchmark).select(F.col("doc_id").alias(leaking), F.col("text_hash").alias(hashed)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(leaking)) & (F.xxhash64(F.col("text").cast("string")) == F.col(hashed))
    return docs.join(found, same, "left_anti")
