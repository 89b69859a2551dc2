"""SimHash near-duplicates found in vantage-point trees of 64-bit fingerprints.

One tree level measures the Hamming distance between a fingerprint and the vantage point on one range of
bits, and has a branch for each distance. The ranges of a path do not overlap, so the triangle bounds of
its levels add up: two fingerprints that differ in ``r`` bits lie in leaves whose distances differ by ``r``
in sum at most. A leaf is a shard. Every fingerprint is filed in its own shard and in each shard that the
ball of half the radius around it overlaps; of a pair within the radius, both then stand in a shard on the
way between their own. Shards hold distinct fingerprints only (a text repeated a million times counts
once) and are searched exactly by a tree of their own over whole distances.

A shard passes on a spanning forest of its links, not all pairs. Components come from contraction rounds:
every node joins its smallest neighbour, which counts and joins of distinct rows express, so that neither
the links nor the groups visit the driver.

Odd input: a null or empty text, or one without a word, has fingerprint zero and links as any other. Rows
that repeat a ``doc_id`` keep one result row each. A null ``doc_id`` keeps its row; it is not considered as
the smallest of its group, and a group of nulls only has a null component. Very long texts are hashed whole, and
ties of ids need no order, as equal ids name one component. An empty table gives an empty one. Extra columns are not
read by ``near_duplicates`` and pass ``one_of_each_group`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsload.llm.names import free
from obsload.operators.keyed import left_lookup
from obsload.workspace import written

SEED = 42
LEVELS = 16  # each measures four bits, so it has five branches
BITS = 64
_SPAN = BITS // LEVELS
_BRANCHES = _SPAN + 1
_BLOCK = 65_536
SEARCHED_WHOLE = 256  # shards up to this size are compared as one block


def fingerprint(text: str | None, words_each: int = 3) -> int:
    """Unsigned SimHash of a text's word shingles; zero without words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, white space 20 and 09-0D only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(words) - words_each + 1)
    last = ends.tolist()[min(words_each, len(words)) - 1 :]
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        cuts = zip(starts[at : min(n, at + _BLOCK)], last[at : at + _BLOCK], strict=False)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in cuts], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", words_each: int = 3, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit column."""

    def of(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint(t.as_py(), words_each) for t in texts], dtype=np.uint64)
        return pa.array(found.view(np.int64))

    return docs.withColumn(name, F.arrow_udf(of, "long")(F.col(text).cast("string")))


def mixed(fps: np.ndarray) -> np.ndarray:
    """One-to-one scrambling of 64-bit values: node numbers in an order unrelated to the distances."""
    x = fps.view(np.uint64).copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return (x ^ x >> np.uint64(31)).view(np.int64)


def shards_of(fps: np.ndarray, vantage: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard numbers and the places of the fingerprints filed there, within half the radius, rounded up."""
    apart = fps.view(np.uint64) ^ np.uint64(vantage)
    mask = np.uint64((1 << _SPAN) - 1)
    levels = [np.bitwise_count(apart >> np.uint64(_SPAN * k) & mask) for k in range(LEVELS)]
    paths, places = np.stack(levels, axis=1).astype(np.int64), np.arange(len(fps))
    weights = np.power(np.int64(_BRANCHES), np.arange(LEVELS, dtype=np.int64))
    for _ in range((radius + 1) // 2):
        near, at = [paths], [places]
        for k in range(LEVELS):
            for step in (-1, 1):
                open_ = (paths[:, k] + step >= 0) & (paths[:, k] + step < _BRANCHES)
                moved = paths[open_].copy()
                moved[:, k] += step
                near.append(moved)
                at.append(places[open_])
        paths, places = np.concatenate(near), np.concatenate(at)
        if radius > 2:
            _, first = np.unique(np.c_[paths @ weights, places], axis=0, return_index=True)
            paths, places = paths[first], places[first]
    return paths @ weights, places


def close_pairs(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of a shard within the radius, by a vantage-point tree over whole distances."""
    todo = [np.arange(len(fps))]
    while todo:
        at = todo.pop()
        values = fps[at]
        far = np.bitwise_count(values ^ values[0]).astype(np.int64)
        middle = int(np.median(far))
        inner = far <= middle
        if len(at) <= SEARCHED_WHOLE or inner.all():
            yield from _compared(at, at, fps, radius)
            continue
        todo += [at[inner], at[~inner]]
        # only what lies near the border can have a partner beyond it
        yield from _compared(at[inner & (far > middle - radius)], at[~inner & (far <= middle + radius)], fps, radius)


def _compared(left: np.ndarray, right: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for begin in range(0, len(left), 1024):
        some = left[begin : begin + 1024]
        for other in range(0, len(right), 1024):
            others = right[other : other + 1024]
            a, b = np.nonzero(np.bitwise_count(fps[some][:, None] ^ fps[others][None, :]) <= radius)
            kept = some[a] != others[b]
            yield some[a[kept]], others[b[kept]]


def roots_of(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest place of each place's component."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
            while not np.array_equal(root, up := root[root]):
                root = up
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
    return root


def links(fingerprints: DataFrame, radius: int = 2, fp: str = "fp") -> DataFrame:
    """A spanning forest of the links of every shard: distinct pairs ``(u, v)`` of scrambled fingerprints.

    Two fingerprints of the (distinct) input share a component of these pairs exactly if they share one of
    the graph of all pairs within ``radius`` bits.
    """
    vantage = fingerprints.agg(F.min_by(fp, F.xxhash64(fp))).first()[0]
    if vantage is None:
        return fingerprints.select(F.col(fp).alias("u"), F.col(fp).alias("v")).limit(0)
    vantage &= (1 << BITS) - 1

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(begin, 4096).to_numpy(zero_copy_only=False)
                shard, at = shards_of(fps, vantage, radius)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fps[at])], ["shard", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = fps = np.zeros(0, dtype=np.int64)
        for batch in _with_end(batches):
            if batch is not None:
                shards = np.r_[shards, batch.column(0).to_numpy(zero_copy_only=False)]
                fps = np.r_[fps, batch.column(1).to_numpy(zero_copy_only=False)]
                end = int(np.searchsorted(shards, shards[-1])) if len(shards) else 0  # the last shard may go on
            else:
                end = len(shards)
            starts = np.flatnonzero(np.r_[True, shards[1:end] != shards[: end - 1]]) if end else np.zeros(0, int)
            sizes = np.diff(np.r_[starts, end])
            us, vs = [], []
            for a, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                own = fps[a : a + n].view(np.uint64)
                root = roots_of(n, close_pairs(own, radius))
                linked = np.flatnonzero(root != np.arange(n))
                us.append(own[linked])
                vs.append(own[root[linked]])
            shards, fps = shards[end:], fps[end:]
            if us:
                ends = [pa.array(mixed(np.concatenate(x).view(np.int64))) for x in (us, vs)]
                yield pa.RecordBatch.from_arrays(ends, ["u", "v"])

    filed = fingerprints.select(fp).mapInArrow(file, "shard long, fp long")
    parted = filed.repartition("shard").sortWithinPartitions("shard")
    return parted.mapInArrow(search, "u long, v long").distinct()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``, by contraction until no edge is left.

    Each round a node joins its smallest neighbour; with node numbers in random order the graph shrinks
    by a constant factor. Rounds are written, so a lost executor costs one round.
    """
    left = written(edges.where("u != v"), "edges")
    labels = None
    while not left.isEmpty():
        both = left.union(left.select("v", "u"))
        step = written(
            both.groupBy("u").agg(F.least("u", F.min("v")).alias("to")).withColumnRenamed("u", "from"), "steps"
        )
        if labels is None:
            labels = step.select(F.col("from").alias("node"), F.col("to").alias("root"))
        else:
            moved = labels.join(step, labels["root"] == step["from"], "left")
            labels = written(moved.select("node", F.coalesce("to", "root").alias("root")), "labels")
        one = left.join(step, left["u"] == step["from"]).select(F.col("to").alias("u"), "v")
        two = one.join(step, one["v"] == step["from"]).select("u", F.col("to").alias("v"))
        ordered = two.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        left = written(ordered.distinct(), "edges")
    if labels is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels


def _least_of_groups(fps: DataFrame, row: Column, radius: int) -> DataFrame:
    """``(fp, n, least)`` for each distinct fingerprint: its rows, and the smallest ``row`` of its component."""
    number = F.arrow_udf(lambda x: pa.array(mixed(x.to_numpy(zero_copy_only=False))), "long")
    counted = fps.groupBy("fp").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("n"))
    distinct = written(counted.withColumn("node", number("fp")), "distinct")
    labels = components(links(distinct, radius))
    linked = distinct.join(labels, "node")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    grouped = linked.join(least, "root").select("fp", "least")
    named = distinct.select("fp", "n", "first").join(grouped, "fp", "left")
    return named.select("fp", "n", F.coalesce("least", "first").alias("least"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_each: int = 3, radius: int = 2
) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row: fingerprint and smallest id reachable over links."""
    fps = written(
        with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", words_each).select(
            "doc_id", "fp"
        ),
        "fingerprints",
    )
    named = _least_of_groups(fps, F.col("doc_id"), radius).withColumnRenamed("least", "component_id")
    # a fingerprint may own any share of the rows
    counts = named.select("fp", "n")
    return left_lookup(fps, named, ["fp"], ["component_id"], counts, F.col("doc_id"), settle=True)


def _row_hash(docs: DataFrame) -> Column:
    """Tells the rows of one id apart; maps have no hash and do not count."""
    hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*[x for c in hashed for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])


def one_of_each_group(docs: DataFrame, words_each: int = 3, radius: int = 2, all_without_id: bool = True) -> DataFrame:
    """One row of ``docs`` for each group: of its smallest ``doc_id``, of equal ids by a hash of the row.

    Groups are those of the texts, so rows of one id that differ in text are each judged by their own. Rows
    without a ``doc_id`` all stay; where ``all_without_id`` is false they come after all others of their group.
    """
    id_, row_ = free(docs, "_id", "_row")
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), row_: _row_hash(docs)})
    narrow = keyed.select("doc_id", "text", F.col(id_).alias("_id"), F.col(row_).alias("_row"))
    fps = written(with_fingerprint(narrow, "text", words_each, "fp").drop("text"), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_id", "_row")
    kept = _least_of_groups(fps, row, radius)
    kept = kept.select(F.col("least._id").alias(id_), F.col("least._row").alias(row_)).distinct()
    named = keyed.where(F.col("doc_id").isNotNull()) if all_without_id else keyed
    # equal rows go on the map side, before they can gather in one task
    out = named.dropDuplicates([id_, row_]).join(kept, [id_, row_], "left_semi").select(*[f"`{c}`" for c in docs.columns])
    return out.unionByName(docs.where(F.col("doc_id").isNull())) if all_without_id else out
