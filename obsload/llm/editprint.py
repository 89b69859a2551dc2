"""Document fingerprints: random walks over characters map edit distance to Hamming distance.

A text is cut into blocks of ``BLOCK`` code points. A walk over a block stands on one letter at each step and
stays or moves on as a shared random bit of the step and the letter decides; over three steps a letter it
reaches the end of the block. Two walks over texts that differ by an edit meet again soon after it, so few steps
differ. All walks of a chunk of texts go in lockstep as numpy arrays, whatever the length of a text.

The fingerprint samples the walk: of the first steps all, then ``SAMPLES`` of each doubling of the number of
steps, the same ones for every text, so texts of any two lengths can be compared. A sample is four bits of a
hash of the ``GRAM`` letters from where the walk stands, one hex digit, or ``-`` where the walk has ended. The
length of the text stands in front.

Likeness takes two steps. Banding: ``BAND`` successive samples are a band; fingerprints without an equal band
are no candidates and have likeness 0. Verification: all samples are compared, each weighed by the steps it
stands for, and the agreement to be expected of unlike samples is taken off.

``with_next`` puts texts in order of id by a range shuffle, in which whole texts travel once; the last of a
partition meets the first of the next one in a join of one row for each partition.

Odd input: a null text is the empty one, with fingerprint ``0:``; likeness of two empty texts is 1, of an empty
and another one 0. Very long texts are walked whole, many blocks at once. Rows without id come first; rows of
one id are ordered by a hash of the text, equal rows are like each other in any order. A single row is its own
next one; an empty table gives no row. Extra columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsload.workspace import written

BLOCK = 4096  # code points of one walk
WALK = 3 * BLOCK
SAMPLES = 32
BAND = 4
GRAM = 4
CHUNK_CHARS = 2_000_000
ENDED = 16
_MIX = np.uint32(0x9E3779B1)
_DIGITS = "0123456789abcdef-"


def _scrambled(numbers: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values, the same on every machine."""
    x = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sampled_steps(steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps sampled of a text of so many, ascending, and the number of steps each one stands for."""
    at, weight, first = [], [], 0
    while first < steps:
        size = first + 1  # levels of 1, 2, 4 … steps
        if size <= SAMPLES:
            some = np.arange(first, first + size)
        else:
            part = size // SAMPLES  # one of each equal part, so none comes twice
            numbers = np.arange(SAMPLES)
            inside = _scrambled(numbers + np.uint64(size)) % np.uint64(part)
            some = first + numbers * part + inside.astype(np.int64)
        at.append(some)
        weight.append(np.full(len(some), size / len(some)))
        first += size
    if not at:
        return np.empty(0, np.int64), np.empty(0)
    at, weight = np.concatenate(at), np.concatenate(weight)
    return at[at < steps], weight[at < steps]


_MOVES: list[np.ndarray] = []


def moves() -> np.ndarray:
    """The shared random bits: for each step of a walk and each of 256 kinds of letters."""
    if not _MOVES:
        _MOVES.append((_scrambled(np.arange(WALK * 256)) >> np.uint64(63)).astype(np.int64).reshape(WALK, 256))
    return _MOVES[0]


def fingerprints(texts: Sequence[str]) -> list[str]:
    """Fingerprint of each text."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points], dtype=np.int64)
    pad = np.zeros(GRAM, dtype=np.uint32)
    flat = np.concatenate([x for p in points for x in (p, pad)] or [pad])
    starts = np.cumsum(np.r_[0, sizes[:-1] + GRAM]) if len(sizes) else sizes
    kinds = ((flat * _MIX) >> np.uint32(24)).astype(np.uint8)

    n_blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(texts)), n_blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    begin = starts[owner] + number * BLOCK
    end = np.minimum(begin + BLOCK, starts[owner] + sizes[owner])

    steps, _ = sampled_steps(int(3 * sizes.max())) if len(sizes) else (np.empty(0, np.int64), None)
    taken = np.searchsorted(steps, 3 * sizes)  # samples of each text
    text_of = np.repeat(np.arange(len(texts)), taken)
    offsets = np.cumsum(taken) - taken
    at = steps[np.arange(len(text_of)) - np.repeat(offsets, taken)]
    first_block = np.cumsum(n_blocks) - n_blocks
    block, step = first_block[text_of] + at // WALK, at % WALK

    order = np.argsort(begin - end, kind="stable")  # longest walks first, so those under way are a prefix
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    where, last = begin[order], end[order]
    walks = 3 * (last - where)
    by_step = np.argsort(step, kind="stable")
    cuts = np.searchsorted(step[by_step], np.arange(WALK + 1))
    rows = rank[block[by_step]]
    stood = np.empty(len(by_step), dtype=np.int64)
    bits = moves()
    under_way = np.searchsorted(-walks, -np.arange(WALK), side="left")  # walks of more steps than these
    for j in range(int(walks[0]) if len(walks) else 0):
        m = under_way[j]
        now = where[:m]
        if cuts[j] < cuts[j + 1]:
            stood[cuts[j] : cuts[j + 1]] = where[rows[cuts[j] : cuts[j + 1]]]
        now += bits[j].take(kinds.take(now))
        np.minimum(now, last[:m], out=now)

    gram = np.zeros(len(stood), dtype=np.uint64)
    for k in range(GRAM):
        gram = _scrambled(gram + flat[np.minimum(stood + k, len(flat) - 1)])
    digit = (gram >> np.uint64(60)).astype(np.uint8)
    digit[stood >= last[rows]] = ENDED
    made = np.empty(len(stood), dtype=np.uint8)
    made[by_step] = digit
    letters = np.frombuffer(_DIGITS.encode(), dtype=np.uint8)[made].tobytes().decode()
    return [f"{n:x}:{letters[a : a + k].rstrip('-')}" for n, a, k in zip(sizes.tolist(), offsets.tolist(), taken.tolist(), strict=True)]


def likeness(first: Sequence[str], second: Sequence[str]) -> np.ndarray:
    """Likeness of pairs of fingerprints, 0 to 1."""
    out = np.zeros(len(first))
    cut = [[f.partition(":") for f in side] for side in (first, second)]
    sizes = np.array([[int(n, 16) for n, _, _ in side] for side in cut], dtype=np.int64).reshape(2, -1)
    out[(sizes == 0).all(axis=0)] = 1.0
    some = np.flatnonzero((sizes > 0).all(axis=0))
    if not len(some):
        return out
    steps, weights = sampled_steps(int(3 * sizes.max()))
    k = np.searchsorted(steps, 3 * sizes[:, some])
    by_size = np.argsort(k.max(axis=0), kind="stable")
    for at in range(0, len(some), 1024):  # of like sizes, so that rows are padded little
        part = by_size[at : at + 1024]
        out[some[part]] = _agreement([[cut[s][i][2] for i in some[part]] for s in (0, 1)], k[:, part], weights)
    return out


def _agreement(digits: list[list[str]], k: np.ndarray, weights: np.ndarray) -> np.ndarray:
    width = int(k.max())
    one, two = (
        np.frombuffer("".join(d.ljust(n, "-").ljust(width, " ") for d, n in zip(side, sizes, strict=True)).encode(), np.uint8)
        .reshape(len(side), width)
        for side, sizes in zip(digits, k.tolist(), strict=True)
    )
    ended, beyond = ord("-"), ord(" ")
    walking = (one != two) | (one != ended) & (one != beyond)  # ended in both says nothing
    same = (one == two) & walking
    # a band of which both have ended at some samples counts by the others
    bands = np.arange(0, width, BAND)
    equal = np.logical_and.reduceat(one == two, bands, axis=1) & np.logical_or.reduceat(same, bands, axis=1)
    candidate = equal.any(axis=1)
    w = weights[:width]
    share = (same * w).sum(axis=1) / np.maximum((walking * w).sum(axis=1), 1e-300)
    unlike = 1 / ENDED
    share = np.where(share >= 1, 1.0, np.maximum(0.0, (share - unlike) / (1 - unlike)))
    return np.where(candidate, share, 0.0)


def _in_chunks(texts: list[str]) -> list[str]:
    out, at, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS:
            out += fingerprints(texts[at : i + 1])
            at, size = i + 1, 0
    return out + fingerprints(texts[at:])


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of a text column; a column already named so is replaced."""

    def make(column: pa.Array) -> pa.Array:
        return pa.array(_in_chunks([t or "" for t in column.to_pylist()]), pa.string())

    return docs.withColumn(into, F.arrow_udf(make, "string")(F.col(f"`{text}`").cast("string")))


def edited(text: str, following: str) -> str:
    """``text`` whose second half is replaced by as many letters of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULTS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def compared(ids: pa.Array, texts: list[str], prints: list[str]) -> pa.RecordBatch:
    """Results for all texts but the last one, each with the text that follows it."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    own, new = prints[:-1], _in_chunks(changed)
    columns = [
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
        pa.array(own, pa.string()),
        pa.array(new, pa.string()),
        pa.array(likeness(own, new)),
        pa.array(likeness(own, prints[1:])),
    ]
    return pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *RESULTS])


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` for each row.

    Texts are edited by, and compared with, the next one by ascending id; the first follows the last.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    results = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    narrow = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    )
    order = ["doc_id", F.xxhash64("text")]
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows but the last of a partition are done; its first and last texts wait for their neighbours."""
        part, head, held = TaskContext.get().partitionId(), None, None
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            if not texts:
                continue
            prints = _in_chunks(texts)
            if head is None:
                head = (texts[0], prints[0])
            if held is not None:
                ids, texts, prints = pa.concat_arrays([held[0], ids]), [held[1], *texts], [held[2], *prints]
            held = ids.slice(len(ids) - 1), texts[-1], prints[-1]
            if len(texts) > 1:
                yield _waiting(compared(ids.slice(0, len(ids) - 1), texts, prints), None, None, None)
        if held is not None:
            nothing = pa.RecordBatch.from_arrays(
                [held[0], *[pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]],
                ["doc_id", *RESULTS],
            )
            yield _waiting(nothing, part, head, held[1:])

    ends = "part int, head string, head_print string, tail string, tail_print string"
    done = written(ordered.mapInArrow(chain, f"doc_id {kind}, {results}, {ends}"), "chained")
    waiting = done.where(F.col("part").isNotNull())
    parts = sorted(r["part"] for r in waiting.select("part").collect())  # one number for each partition
    if not parts:
        return done.select("doc_id", *RESULTS)
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "at int, then int")
    heads = waiting.select(F.col("part").alias("then"), F.col("head").alias("next"), F.col("head_print").alias("next_print"))
    pairs = waiting.select("doc_id", F.col("part").alias("at"), "tail", "tail_print").join(follows, "at").join(heads, "then")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tail, tail_print, following, next_print = (batch.column(c)[i].as_py() for c in range(1, 5))
                yield compared(batch.column(0).slice(i, 1), [tail, following], [tail_print, next_print])

    closed = pairs.select("doc_id", "tail", "tail_print", "next", "next_print").mapInArrow(close, f"doc_id {kind}, {results}")
    return done.where(F.col("part").isNull()).select("doc_id", *RESULTS).unionByName(closed)


def _waiting(rows: pa.RecordBatch, part: int | None, head: tuple | None, tail: tuple | None) -> pa.RecordBatch:
    n = rows.num_rows
    values = [part, *(head or (None, None)), *(tail or (None, None))]
    kinds = [pa.int32(), *[pa.string()] * 4]
    more = [pa.array([v] * n, k) for v, k in zip(values, kinds, strict=True)]
    names = [*rows.schema.names, "part", "head", "head_print", "tail", "tail_print"]
    return pa.RecordBatch.from_arrays([*rows.columns, *more], names)
