"""GeoJSON collections: one row per feature, properties as text columns, geometry as WKT."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsload.sources.delimited import BROADCAST_BLOCKS
from obsload.sources.split import runs_of_blocks, same_splits
from obsload.workspace import written

# coordinates of any nesting are read as text and rewritten; their depth depends on the kind
FEATURE = "properties map<string,string>, geometry struct<type:string,coordinates:string>"

_PAIR = r"\[\s*([^\[\],]+)\s*,\s*([^\[\],]+)(?:\s*,[^\[\]]*)?\]"


def wkt_of(kind: Column, coordinates: Column) -> Column:
    """WKT text from a GeoJSON geometry type and its coordinate array."""
    pairs = F.regexp_replace(coordinates, _PAIR, "$1 $2")
    nested = F.translate(F.regexp_replace(pairs, r"\s*([\[\],])\s*", "$1"), "[]", "()")
    spaced = F.replace(nested, F.lit(","), F.lit(", "))
    body = F.when(kind == "Point", F.concat(F.lit("("), spaced, F.lit(")"))).otherwise(spaced)
    return F.when(kind.isNotNull(), F.concat(F.upper(kind), F.lit(" "), body))


class Fragments:
    """Consecutive pieces of one block, each up to a closing brace, which is not part of it."""

    def __init__(self, pieces: pa.BinaryArray):
        raw = np.frombuffer(pieces.buffers()[1], dtype=np.int32)
        offsets = raw[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        data = np.frombuffer(pieces.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        self.pieces, self.offsets = pieces, offsets - offsets[0]
        sizes = np.diff(self.offsets)
        owner_start = np.repeat(self.offsets[:-1], sizes)
        at = np.arange(len(data))
        # a quote after an odd number of backslashes is a letter of its string
        other = np.maximum(np.maximum.accumulate(np.where(data != 92, at, -1)), owner_start - 1) if len(data) else at
        slashes = np.r_[0, (at - other)[:-1]] if len(data) else at
        slashes[self.offsets[:-1][sizes > 0]] = 0
        self.quoted = np.r_[0, np.cumsum((data == 34) & (slashes % 2 == 0))]
        self.opening, self.brace = (data == 123) | (data == 91), data == 123
        self.step = self.opening.astype(np.int64) - (data == 93)

    def depths(self, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray, bool, int]:
        """Depth before each byte, depth after each piece with its brace, and both states at the end."""
        outside = (self.quoted + inside) % 2 == 0
        moved = np.r_[0, np.cumsum(self.step * outside[:-1])]
        closed = np.cumsum(outside[self.offsets[1:]])  # braces that end a piece
        before = np.repeat(np.r_[0, closed[:-1]], np.diff(self.offsets))
        after = depth + moved[self.offsets[1:]] - closed
        byte_depth = np.where(outside[:-1], depth + moved[:-1] - before, -1)
        end = bool((self.quoted[-1] + inside) % 2)
        return byte_depth, after, end, int(after[-1]) if len(after) else depth


_STATES = "_file string, _block long, turns boolean, depth_if_out long, depth_if_in long"


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block: whether it swaps inside and outside of strings, and by how much it goes deeper."""

    def row(key, found):
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        values = [*key, found[0][0], found[0][1], found[1][1]]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in _STATES.split(", ")])

    key, found = None, None
    for batch in batches:
        for file, block, part in runs_of_blocks(batch):
            if (file, block) != key:
                if key is not None:
                    yield row(key, found)
                key, found = (file, block), [(False, 0), (True, 0)]
            pieces = Fragments(part["line"])
            found = [pieces.depths(*state)[2:] for state in found]
    if key is not None:
        yield row(key, found)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects two levels deep of whole blocks; unfinished ones at either end of a block are told apart."""

    def rows(key, texts, parts):
        n = len(texts)
        columns = [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(texts, pa.binary()), pa.array(parts, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["_file", "_block", "text", "part"])

    key, open_, part_of = None, [], WHOLE
    inside = depth = None
    for batch in batches:
        for file, block, part in runs_of_blocks(batch):
            if (file, block) != key:
                if open_:
                    yield rows(key, [b"}".join(open_)], [BEGINS if part_of == WHOLE else GOES_ON])
                key, open_ = (file, block), []
                inside, depth = part["inside"][0].as_py(), part["depth"][0].as_py()
                # what comes first may belong to an object of an earlier block
                part_of, under_way = (GOES_ON, True) if depth > 2 else (WHOLE, False)
            pieces = Fragments(part["line"])
            at_depth, after, inside, depth = pieces.depths(inside, depth)
            begins = np.flatnonzero(pieces.brace & (at_depth == 2))
            first = dict(zip((np.searchsorted(pieces.offsets, begins, side="right") - 1).tolist(), begins.tolist(), strict=True))
            texts, parts = [], []
            for i, text in enumerate(pieces.pieces.to_pylist()):
                if i in first and not under_way:
                    open_, part_of, under_way = [text[first[i] - int(pieces.offsets[i]) :]], WHOLE, True
                elif under_way:
                    open_.append(text)
                if under_way and after[i] == 2:
                    texts.append(b"}".join(open_) + b"}")
                    parts.append(WHOLE if part_of == WHOLE else ENDS)
                    open_, part_of, under_way = [], WHOLE, False
            yield rows(key, texts, parts)
    if open_:
        yield rows(key, [b"}".join(open_)], [BEGINS if part_of == WHOLE else GOES_ON])


WHOLE, BEGINS, GOES_ON, ENDS = 0, 1, 2, 3


def read_features(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Features of GeoJSON files as text ``(_file, feature)``; one collection is read by many tasks.

    Files are cut into byte blocks at closing braces. A first pass notes whether a block has an odd number of quotes
    and how much deeper it leads; summed over the blocks of a file this tells where features begin and end. The second
    pass cuts them out, and the pieces of one that crosses the end of a block meet in a grouping.
    """
    with same_splits(spark):
        pieces = spark.read.option("lineSep", "}").text(list(paths) if not isinstance(paths, str) else paths).select(
            F.col("value").cast("binary").alias("line"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
        blocks = written(pieces.mapInArrow(_profiled, _STATES), "blocks")
        earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        turned = F.coalesce(F.sum(F.col("turns").cast("int")).over(earlier), F.lit(0)) % 2 == 1
        begun = blocks.withColumn("inside", turned)
        deeper = F.when(F.col("inside"), F.col("depth_if_in")).otherwise(F.col("depth_if_out"))
        depth = F.coalesce(F.sum(deeper).over(earlier), F.lit(0))
        states = written(begun.select("_file", "_block", "inside", depth.alias("depth")), "states")
        if states.count() <= BROADCAST_BLOCKS:
            placed = pieces.join(F.broadcast(states), ["_file", "_block"])
        else:
            dealt = pieces.withColumn("_pos", F.monotonically_increasing_id()).join(states, ["_file", "_block"])
            placed = dealt.repartition("_file", "_block").sortWithinPartitions("_file", "_block", "_pos")
        cut = placed.select("line", "_file", "_block", "inside", "depth").mapInArrow(
            _features, "_file string, _block long, text binary, part int"
        )
        found = written(cut, "features")
    # the end of one feature comes before the beginning of the next in a block
    order = F.struct("_block", (F.col("part") == BEGINS).alias("later"))
    broken = found.where(F.col("part") != WHOLE).withColumn("order", order)
    numbered = broken.withColumn("number", F.sum((F.col("part") == BEGINS).cast("int")).over(Window.partitionBy("_file").orderBy("order")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("order", "text"))), lambda p: F.decode(p["text"], "ISO-8859-1"))
    joined = numbered.groupBy("_file", "number").agg(F.encode(F.array_join(texts, "}"), "ISO-8859-1").alias("text"))
    both = found.where(F.col("part") == WHOLE).select("_file", "text").unionByName(joined.select("_file", "text"))
    return both.select("_file", F.col("text").cast("string").alias("feature"))


def _parsed(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    features = read_features(spark, paths).select(F.from_json("feature", FEATURE).alias("f"))
    # other objects two levels deep, such as the properties of a named system, have neither
    return features.where(F.col("f.properties").isNotNull() | F.col("f.geometry").isNotNull())


def read_geojson(
    spark: SparkSession, paths: str | Sequence[str], properties: Sequence[str], geometry: str = "WKT"
) -> DataFrame:
    """Features of GeoJSON files with the named properties."""
    return _parsed(spark, paths).select(
        *[F.col("f.properties").getItem(p).alias(p) for p in properties],
        wkt_of(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias(geometry),
    )


def property_names(spark: SparkSession, paths: str | Sequence[str], most: int = 10_000) -> list[str]:
    """Property names in use, sorted. They become columns; more than ``most`` raise instead of reaching the driver."""
    names = _parsed(spark, paths).select(F.explode(F.map_keys("f.properties")).alias("name")).distinct()
    found = [r["name"] for r in names.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} property names")
    return sorted(found)
