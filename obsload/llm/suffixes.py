"""Removal of long byte strings that occur more than once, by suffix arrays over shards.

A string of ``LENGTH`` bytes is repeated if it also starts anywhere else in the documents. Comparing all
suffixes of all documents needs every shard to meet every other. Instead, places are chosen by content:
of the hashes of all ``SEED`` bytes that a window of ``LENGTH`` bytes holds the smallest is an anchor, so
equal strings hold equal anchors at equal places. Anchors that occur once end there. An anchor whose whole
surroundings occur twice settles all strings around it by counting alone, combined before the shuffle; a
passage on a third of all documents costs a row a task. What is left, surroundings that differ somewhere,
goes to shards dealt by anchor: each builds a suffix array (doubling of sorted prefixes, where only groups
still tied are sorted again), takes the common prefixes of neighbours from Kasai's relation between
successive suffixes, and marks runs of suffixes that share ``LENGTH`` bytes and begin at two places. A
group larger than a shard is split over several, whose strings are then looked up in each other's sorted
string hashes by binary search and confirmed byte for byte. A group of more than ``HOT`` kinds of surroundings,
such as a passage of which each copy stands in another text, is first taken apart by counting.

Odd input: a null text is empty; texts shorter than ``LENGTH`` bytes keep all bytes. Rows repeated remove
each other's bytes as other copies do. Ids are not looked at. Extra columns pass untouched unless they bear
the name of a result. Very long texts are cut at anchors like others and never sorted whole; equal strings have no
order to settle. An empty table gives an empty one. What is left of a text can break a character apart, so it is
returned as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsload.workspace import written

LENGTH = 200
SEED = 40
SHARD = 1 << 19
HOT = 4096  # anchors with more kinds of surroundings are taken apart before they reach a shard
_BLOCK = 1 << 20
_WORD = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_WORD), -1, 1 << 64))
_PLACES = np.uint64((1 << 22) - 1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, b)]) for b in (_WORD, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def _sums(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any stretch follows, see :func:`_hash`."""
    up, _ = _powers(len(raw))
    return np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)]


def _hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _powers(len(sums))
    return (sums[end] - sums[begin]) * down[begin]


def anchors(raw: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a text's anchors, their hashes, and hashes of their surroundings."""
    found = []
    for at in range(0, max(1, len(raw) - length + 1), _BLOCK):  # strings that begin in the block
        low, high = max(0, at - length), min(len(raw), at + _BLOCK + 2 * length)
        block = raw[low:high]
        if len(block) < length:
            break
        sums = _sums(block)
        n = len(block) - seed + 1
        begin = np.arange(n)
        hashes = _mixed(_hash(sums, begin, begin + seed))
        # the smallest hash, and of equal ones the last
        least = hashes & ~_PLACES | _PLACES - np.arange(n, dtype=np.uint64)
        span, width = length - seed + 1, 1
        while width < span:
            step = min(width, span - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        first, last = at - low, min(at + _BLOCK - low, len(least))
        chosen = np.unique((_PLACES - (least[first:last] & _PLACES)).astype(np.int64))
        a, b = np.maximum(0, chosen - (length - seed)), np.minimum(len(block), chosen + length)
        shape = (chosen - a) * 1024 + (b - chosen)
        around = _mixed(_hash(sums, a, b) + shape.astype(np.uint64) * _INVERSE)
        found.append((chosen + low, hashes[chosen], around))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    places, hashes, around = (np.concatenate(x) for x in zip(*found, strict=True))
    places, once = np.unique(places, return_index=True)
    return places, hashes[once], around[once]


def _sorted_places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``keys`` of up to ``bits`` bits, and where a new key begins in it.

    The place is packed under the key where both fit: sorting numbers is several times faster than
    sorting places by numbers.
    """
    n = len(keys)
    low = max(1, n.bit_length())
    if bits + low <= 63:
        packed = np.sort(keys << low | np.arange(n))
        order, sorted_ = packed & ((1 << low) - 1), packed >> low
    else:
        order = np.argsort(keys)
        sorted_ = keys[order]
    return order, np.r_[True, sorted_[1:] != sorted_[:-1]] if n else np.zeros(0, bool)


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by their first ``depth`` symbols at least; ties beyond stand in any order."""
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length() + 1) if n else 1
    h = max(1, (62 - n.bit_length()) // bits)
    key = np.zeros(n, dtype=np.int64)
    padded = np.r_[symbols.astype(np.int64) + 1, np.zeros(h, dtype=np.int64)]
    for k in range(h):
        key = key << bits | padded[k : k + n]
    order, fresh = _sorted_places(key, bits * h)
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    width = max(1, n.bit_length())
    while h < depth:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        suffixes = order[at]
        # groups keep their places, so sorted by group they fill them again
        again, new = _sorted_places(rank[suffixes] << width | rank[np.minimum(suffixes + h, n)] + 1, 2 * width)
        suffixes = suffixes[again]
        order[at], fresh[at] = suffixes, new
        rank[suffixes] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        h *= 2
    return order


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the prefix that each suffix shares with the one before it in the order.

    By Kasai's relation a suffix shares at least one symbol less than the suffix one place to the left
    does; where the symbols before both agree it is exactly one less, so only the other suffixes are
    compared, all together.
    """
    n = len(symbols)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    inherits = np.zeros(n, dtype=bool)
    inner = np.flatnonzero((before > 0) & (np.arange(n) > 0))
    inherits[inner] = (symbols[inner - 1] == symbols[before[inner] - 1]) & (before[inner - 1] == before[inner] - 1)
    shared = np.zeros(n, dtype=np.int64)
    active = np.flatnonzero(~inherits & (before >= 0))
    k = 0
    while len(active):
        active = active[(active + k < n) & (before[active] + k < n)]
        active = active[symbols[active + k] == symbols[before[active] + k]]
        k += 1
        shared[active] = k
    origin = np.maximum.accumulate(np.where(inherits, 0, np.arange(n)))
    shared = np.where(inherits, shared[origin] - (np.arange(n) - origin), shared)
    return shared[order]


def _runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.r_[0, marked.astype(np.int8), 0]))
    return edges[::2], edges[1::2]


class Shard:
    """Surroundings of some anchors, their sorted suffixes, and which of their strings are repeated."""

    def __init__(self, texts: list[bytes], owners: np.ndarray, begins: np.ndarray, length: int):
        self.length = length
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(np.r_[0, sizes + 1])[:-1]
        symbols = np.empty(int((sizes + 1).sum()), dtype=np.int32)
        ends = starts + sizes
        inside = np.ones(len(symbols), dtype=bool)
        inside[ends] = False
        self.raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        symbols[inside] = self.raw
        symbols[ends] = 256 + np.arange(len(texts))  # equal to nothing: no string crosses two surroundings
        self.starts, self.sizes, self.owners, self.begins = starts, sizes, owners, begins
        order = suffix_array(symbols, length)
        same = common_prefixes(symbols, order) >= length
        self.text_of = np.repeat(np.arange(len(texts)), sizes + 1)
        at = np.arange(len(symbols)) - starts[self.text_of]
        self.at, self.whole = at, at + length <= sizes[self.text_of]
        # where a string begins in the documents: the same place can lie in the surroundings of two anchors
        self.place = owners[self.text_of] * np.int64(1 << 40) + begins[self.text_of] + at
        class_starts = np.flatnonzero(~same)
        spread = np.maximum.reduceat(self.place[order], class_starts) != np.minimum.reduceat(self.place[order], class_starts)
        self.repeated = np.zeros(len(symbols), dtype=bool)
        self.repeated[order] = np.repeat(spread, np.diff(np.r_[class_starts, len(order)]))
        self.repeated &= self.whole

    def strings(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the strings, sorted, and the places where they begin."""
        at = np.flatnonzero(self.whole)
        shifted = at - self.text_of[at]  # the raw bytes have no separators
        hashes = _mixed(_hash(_sums(self.raw), shifted, shifted + self.length))
        order = np.argsort(hashes, kind="stable")
        return hashes[order], at[order]

    def bytes_at(self, at: np.ndarray) -> np.ndarray:
        return self.raw[(at - self.text_of[at])[:, None] + np.arange(self.length)]

    def spans(self) -> Iterator[tuple[int, int, int]]:
        """``(text, begin, end)`` of the bytes that repeated strings cover."""
        first, last = _runs(self.repeated)  # no run goes on over a separator
        texts = self.text_of[first]
        begins, ends = self.begins[texts] + self.at[first], self.begins[texts] + self.at[last - 1] + self.length
        return zip(texts.tolist(), begins.tolist(), ends.tolist(), strict=True)


def merge(shards: list[Shard]) -> None:
    """Marks strings that two shards of one group have in common, by binary search."""
    sorted_ = [s.strings() for s in shards]
    for i, (hashes, at) in enumerate(sorted_):
        for j in range(i):
            others, other_at = sorted_[j]
            if not len(others) or not len(hashes):
                continue
            found = np.minimum(np.searchsorted(others, hashes), len(others) - 1)
            hit = np.flatnonzero(others[found] == hashes)
            for some in np.array_split(hit, max(1, len(hit) // 4096)):
                a, b = at[some], other_at[found[some]]
                equal = (shards[i].bytes_at(a) == shards[j].bytes_at(b)).all(1) & (shards[i].place[a] != shards[j].place[b])
                shards[i].repeated[a[equal]] = True
                # equal strings of the other shard all begin with this hash
                for h in np.unique(hashes[some[equal]]):
                    lo, hi = np.searchsorted(others, [h, h + np.uint64(1)] if h < np.uint64(2**64 - 1) else [h, h])
                    shards[j].repeated[other_at[lo:hi]] = True


def _search(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of repeated strings, from surroundings sorted by anchor."""

    def flush(groups: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        owners = {o: k for k, o in enumerate({r[1] for g in groups for r in g})}
        shards, size, rows = [], 0, []
        for r in (r for g in groups for r in g):
            rows.append(r)
            size += len(r[3])
            if size >= SHARD:
                shards.append(rows)
                rows, size = [], 0
        shards += [rows] if rows else []
        built = [
            Shard([r[3] for r in s], np.array([owners[r[1]] for r in s], np.int64), np.array([r[2] for r in s], np.int64), length)
            for s in shards
        ]
        if len(built) > 1:
            merge(built)
        out = [(s[i][1], a, b) for s, shard in zip(shards, built, strict=True) for i, a, b in shard.spans()]
        kinds = (pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(3)], ["owner", "begin", "end"])

    waiting: list[list[tuple]] = []
    size = 0
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if group and row[0] != group[0][0]:
                waiting.append(group)
                group = []
                if size >= SHARD:  # anchors do not share a shard with more than fits
                    yield from flush(waiting)
                    waiting, size = [], 0
            if not group or row[1:3] != group[-1][1:3]:  # copies of one text bring the same rows
                group.append(row)
                size += len(row[3])
    if group:
        yield from flush([*waiting, group])


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``(owner, spans)``: the MD5 of a text, as bytes, and the byte ranges that repeated strings cover.

    Texts without a repeated string have no row.
    """
    raw = F.encode(F.col(text).cast("string"), "utf-8")
    long_ = docs.select(raw.alias("raw")).where(F.octet_length("raw") >= length)
    owned = long_.select(F.unhex(F.md5("raw")).alias("owner"), "raw")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                rows = batch.slice(begin, 256)
                found = [anchors(np.frombuffer(x.as_buffer(), np.uint8), length, seed) for x in rows.column(1)]
                n = [len(f[0]) for f in found]
                owner = rows.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
                at, hashes, around = (np.concatenate([f[k] for f in found]) for k in range(3))
                columns = [owner, pa.array(at), pa.array(hashes.view(np.int64)), pa.array(around.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["owner", "at", "anchor", "around"])

    placed = written(owned.mapInArrow(choose, "owner binary, at long, anchor long, around long"), "anchors")
    counted = placed.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("around").alias("low"), F.max("around").alias("high")
    )
    shared = written(counted.where("n > 1").select("anchor", (F.col("low") == F.col("high")).alias("alike")), "shared")
    met = written(placed.join(shared, "anchor"), "met")
    unlike = met.where("not alike")
    kinds = written(
        unlike.groupBy("anchor", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("owner", "at")).alias("first")),
        "kinds",
    )
    twice = kinds.where("n > 1").select("anchor", "around")
    settled = met.where("alike").select("owner", "at").union(unlike.join(twice, ["anchor", "around"]).select("owner", "at"))
    spans = settled.select(
        "owner", F.greatest(F.lit(0), F.col("at") - (length - seed)).alias("begin"), (F.col("at") + length).alias("end")
    )

    # of surroundings that differ, one copy of each kind is compared
    def pieces(of: DataFrame) -> DataFrame:
        wanted = F.collect_list(F.struct("anchor", "at")).alias("wanted")
        needed = written(of.select("anchor", "first.owner", "first.at").groupBy("owner").agg(wanted), "wanted")
        met = owned.join(needed, "owner").select("owner", "raw", "wanted")
        return met.mapInArrow(cut, "anchor long, owner binary, begin long, left int, around binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, raw_, wanted in zip(*batch.columns, strict=True):
                whole, name, rows = raw_.as_py(), owner.as_py(), []
                for w in wanted.as_py():
                    begin = max(0, w["at"] - (length - seed))
                    rows.append((w["anchor"], name, begin, w["at"] - begin, whole[begin : w["at"] + length]))
                types = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "owner", "begin", "left", "around"])

    sizes = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    hot = written(sizes.where(F.col("n") > HOT).select("anchor"), "hot")
    both = spans
    if hot.isEmpty():
        compared = pieces(kinds)
    else:
        apart = pieces(kinds.join(hot, "anchor", "left_semi")).dropDuplicates(["anchor", "owner", "begin"])
        found, rest = _taken_apart(written(apart, "apart"), length, seed)
        both = both.union(found)
        compared = pieces(kinds.join(hot, "anchor", "left_anti")).unionByName(rest)
    dealt = compared.select("anchor", "owner", "begin", "around").repartition("anchor")
    searched = dealt.sortWithinPartitions("anchor", "owner", "begin").mapInArrow(
        lambda batches: _search(batches, length), "owner binary, begin long, end long"
    )
    return both.union(searched).groupBy("owner").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def _taken_apart(pieces: DataFrame, length: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Spans that counting settles among surroundings of hot anchors, and what is left for shards.

    The strings around an anchor are told by the bytes they hold before it. A range of these has a core
    that each of its strings holds, and a union that holds them all: surroundings without their core's
    equal have nothing to share in the range, those with their union's equal share all of it, and of the
    others one of each union goes on, either to a shard, as a group of its core, or while that group is
    still hot, to both halves of the range. A range of one string is its own core and union, so this ends.
    """
    rows = pieces.select(
        F.col("anchor").cast("string").alias("key"), "owner", "begin", "left", "around",
        F.lit(0).alias("low"), F.lit(length - seed).alias("high"),
    )
    found, rest = None, None
    # a text's first and last strings have fewer bytes around them
    least = F.greatest(F.col("low"), F.col("left") + length - F.octet_length("around"))
    most = F.least(F.col("high"), F.col("left"))
    while True:
        begin, end = F.col("left") - most, F.col("left") - least + length
        core = F.substr("around", F.col("left") - F.col("low") + 1, length - F.col("high") + F.col("low"))
        union = F.concat_ws(":", F.md5(F.substr("around", begin + 1, end - begin)), least, most)
        cut = rows.where(least <= most).withColumns({"core": F.md5(core), "union": union})
        by = ["key", "core", "union"]
        first = F.min(F.struct("owner", "begin", "left", "around")).alias("first")
        kinds = written(cut.groupBy(*by, "low", "high").agg(F.count(F.lit(1)).alias("n"), first), "unions")
        cores = kinds.groupBy("key", "core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        settled = cut.join(kinds.where("n > 1").select(*by), by)
        spans = settled.select("owner", (F.col("begin") + begin).alias("begin"), (F.col("begin") + end).alias("end"))
        more = written(kinds.join(cores, ["key", "core"]).select("key", "core", "kinds", "low", "high", "first.*"), "more")
        small = more.where(F.col("kinds") <= HOT)
        small = small.select(F.xxhash64("key", "core").alias("anchor"), "owner", "begin", "left", "around")
        found, rest = (spans, small) if found is None else (found.union(spans), rest.union(small))
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high")))
        large = more.where(F.col("kinds") > HOT).withColumn("half", F.explode(halves))
        name = F.md5(F.concat_ws(":", "key", "core", "half.low"))
        rows = written(large.select(name.alias("key"), "owner", "begin", "left", "around", "half.*"), "halves")
        if rows.isEmpty():
            return found, rest


_RESULT = "n_bytes long, n_removed long, n_spans long, kept binary"


def _cleared() -> Column:
    """What is left of the bytes in ``_raw`` without ``_spans``; digests stay beside it."""

    def clear(raws: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for raw, ranges in zip(raws, spans, strict=True):
            data = raw.as_py() or b""
            kept, last, runs, out = 0, 0, 0, []
            for r in sorted((r["begin"], min(r["end"], len(data))) for r in ranges.as_py() or []):
                if r[0] > last or not runs:
                    out.append(data[last : r[0]])
                    runs += 1
                last = max(last, r[1])
            out.append(data[last:])
            left = b"".join(out)
            rows.append((len(data), len(data) - len(left), runs, left))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ["n_bytes", "n_removed", "n_spans", "kept"]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], names)

    return F.arrow_udf(clear, _RESULT)(F.col("_raw"), F.col("_spans"))


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and the ``kept`` bytes."""
    spans = written(repeated_spans(docs, text, length, seed), "spans")
    spans = spans.select(F.col("owner").alias("_owner"), F.col("spans").alias("_spans"))
    plain = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    raw = F.coalesce(F.encode(F.col(text).cast("string"), "utf-8"), F.lit(b""))
    rows = docs.select(*plain, raw.alias("_raw"))
    joined = rows.join(spans, F.unhex(F.md5("_raw")) == F.col("_owner"), "left")
    return joined.withColumn("_r", _cleared()).select(*plain, "_r.*")


