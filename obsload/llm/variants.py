"""Spelling variants: words one edit apart, from squared distances of letter counts in blocked Gram matrices.

Words are counted over all documents, with map-side combining. Two words one edit apart are of equal or
adjacent length and agree in the first or in the second half of the shorter one, so words are dealt into
blocks of a length, the next length, and one half (four rows for each word). Within a block the product of the
matrix of letter counts with itself gives all squared distances; pairs at most two apart are kept, as one edit
moves the counts no further, and the edit itself is then verified on the letters. A pair counts in the block
of its first half if it agrees there and else in that of its second, so once. Blocks of more than ``TILE``
words are cut into tiles, each pair of tiles a task's group of its own; nothing larger gathers anywhere. A task
sends, for each of its words, the number of near words and the best one, never the pairs.

The form of a word is its near word of largest count, if that is ``FACTOR`` times its own or more. Counts rise
by that factor along a chain of forms, so chains are short; they are followed by joins of written tables,
doubling the stride.

Odd input: null and empty texts have no words; a null id enters the hash as the empty text. Very long runs of
letters are words like others, compared without a limit of length. Ties between forms go to the smallest in
code-point order; repeated rows count each. An empty table gives no row. Extra columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsload.operators.keyed import left_lookup
from obsload.workspace import written

# fixed values of the contract
LETTERS = r"A-Za-zÀ-ÿ"
SHORTEST = 7
LEAST = 2
DROPPED = 31  # of so many words, by hash, one loses a letter
FACTOR = 10

TILE = 2048  # words of one tile
CHUNK = 512  # words of small blocks multiplied together
LONG = 64  # longer pairs are verified one by one
_BUCKETS = 90

Rows = tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)`` of words of ``SHORTEST`` letters or more; one in ``DROPPED`` by hash has lost a letter."""
    run = F.explode(F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(f"([{LETTERS}]{{{SHORTEST},}})"), F.lit(1)))
    runs = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("doc"), run.alias("run"))
    low = runs.select("doc", F.translate("run", ascii_uppercase, ascii_lowercase).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % DROPPED == 0, short).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= LEAST)


def blocks(words: DataFrame) -> DataFrame:
    """``(key, i, j, tile, base, front, word, n)``: every word in its blocks, large ones cut into pairs of tiles.

    ``base`` is the smaller length of a block and ``front`` tells which half its words share.
    """
    length = F.length("word")
    based = words.select("word", "n", F.explode(F.array(length - 1, length)).alias("base"))
    based = based.where(F.col("base") >= SHORTEST)
    half = (F.col("base") / 2).cast("int")
    rest = F.col("base") - half
    halves = F.array(
        F.struct(F.lit(True).alias("front"), F.substring("word", F.lit(1), half).alias("part")),
        F.struct(F.lit(False).alias("front"), F.substring("word", F.length("word") - rest + 1, rest).alias("part")),
    )
    dealt = based.select("word", "n", "base", F.explode(halves).alias("half"))
    keyed = dealt.select("word", "n", "base", "half.front", F.xxhash64("base", "half.front", "half.part").alias("key"))
    keyed = written(keyed, "blocks")
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    large = counts.where(F.col("n") > TILE).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    sized = left_lookup(keyed, large, ["key"], ["tiles"], counts, F.col("word"), settle=True)
    tile = F.pmod(F.hash(F.lit(1), "word"), F.coalesce("tiles", F.lit(1))).alias("tile")
    tiled = sized.select("key", "base", "front", "word", "n", "tiles", tile)
    other = F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1))
    paired = tiled.select("*", other.alias("other"))
    return paired.select(
        "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "base", "front", "word", "n"
    )


def letter_counts(words: list[str]) -> np.ndarray:
    """A row for each word. Letters may share a column, which only lowers distances."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    column = np.where(points < 128, points - 97, points - 166) % _BUCKETS
    lengths = np.array([len(w) for w in words])
    owner = np.repeat(np.arange(len(words)), lengths)
    counts = np.bincount(owner * _BUCKETS + column, minlength=len(words) * _BUCKETS).reshape(-1, _BUCKETS)
    return counts.astype(np.float32 if lengths.max() < 4000 else np.float64)  # exact either way


def close(counts: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row of ``left`` and one of ``right`` whose counts are at most two apart, squared."""
    squares = np.einsum("ij,ij->i", counts, counts)
    found = []
    for at in range(0, len(left), CHUNK):
        rows = left[at : at + CHUNK]
        distance = squares[rows, None] + squares[right] - 2 * (counts[rows] @ counts[right].T)
        a, b = np.nonzero(distance <= 2)
        found.append((rows[a], right[b]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def one_edit(short: str, long: str) -> tuple[bool, int]:
    """Whether words of equal or adjacent length are one edit apart, and the length of their common start."""
    same = next((i for i, (a, b) in enumerate(zip(short, long, strict=False)) if a != b), len(short))
    return short != long and short[same + (len(short) == len(long)) :] == long[same + 1 :], same


def edits(words: list[str], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`one_edit` of many pairs; ``a`` is the shorter or of equal length."""
    lengths = np.array([len(w) for w in words])
    near, same = np.zeros(len(a), dtype=bool), np.zeros(len(a), dtype=np.int64)
    plain = lengths[b] <= LONG
    for i in np.flatnonzero(~plain).tolist():
        near[i], same[i] = one_edit(words[a[i]], words[b[i]])
    if plain.any():
        width = int(lengths[b[plain]].max())
        letters = np.array([w if len(w) <= width else "" for w in words], dtype=f"<U{width + 1}")
        letters = letters.view(np.uint32).reshape(len(words), width + 1)
        some = np.flatnonzero(plain)
        for at in range(0, len(some), 100_000):
            part = some[at : at + 100_000]
            u, v, size = letters[a[part]], letters[b[part]], lengths[a[part]]
            inside = np.arange(width) < size[:, None]
            straight = (u[:, :-1] != v[:, :-1]) & inside
            shifted = (u[:, :-1] != v[:, 1:]) & inside
            first = np.where(straight.any(axis=1), straight.argmax(axis=1), size)
            last = np.where(shifted.any(axis=1), width - 1 - shifted[:, ::-1].argmax(axis=1), -1)
            near[part] = np.where(lengths[b[part]] == size, straight.sum(axis=1) == 1, last < first)
            same[part] = first
    return near, same


def near_pairs(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words one edit apart within each block of some whole blocks."""
    words, group, tile, base, front, whole = rows
    lengths = np.array([len(w) for w in words])
    short = np.flatnonzero(lengths == base)
    if not len(short):
        return short, short
    a, b = close(letter_counts(words), short, np.arange(len(words)))
    fit = (group[a] == group[b]) & ((lengths[b] > lengths[a]) | (a < b) & (lengths[b] == lengths[a]))
    fit &= whole[a] | (tile[a] != tile[b])
    a, b = a[fit], b[fit]
    near, same = edits(words, a, b)
    near &= front[a] == (same >= base[a] // 2)
    return a[near], b[near]


def best(words: list[str], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """For each word with near ones: their number, and the one of largest count, smallest on ties."""
    one, two = np.r_[a, b], np.r_[b, a]
    place = np.empty(len(words), dtype=np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[two], -n[two], one))
    one, two = one[order], two[order]
    first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
    sizes = np.diff(np.r_[first, len(one)])
    picked = [pa.array([words[i] for i in x[first].tolist()], pa.string()) for x in (one, two)]
    return pa.RecordBatch.from_arrays([picked[0], pa.array(sizes), pa.array(-n[two[first]]), picked[1]], ["word", "near", "less", "form"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words within whole blocks of sorted rows; a block may go on in the next batch."""
    held: pa.Table | None = None
    for batch in _with_end(batches):
        table = pa.Table.from_batches([batch]) if batch is not None else None
        if held is not None:
            table = held if table is None else pa.concat_tables([held, table])
        if table is None or not table.num_rows:
            continue
        marks = [table[c].to_numpy() for c in ("key", "i", "j")]
        new = np.r_[True, np.any([m[1:] != m[:-1] for m in marks], axis=0)]
        starts = np.flatnonzero(new)
        upto = table.num_rows if batch is None else int(starts[-1])
        held = table.slice(upto)
        at = 0
        while at < upto:
            # as many whole blocks as fit a chunk, one at least
            inside = starts[(starts > at) & (starts <= at + CHUNK)]
            ends = np.append(starts[starts > at], table.num_rows)
            end = min(upto, int(inside[-1]) if len(inside) else int(ends[0]))
            if end - at > 1:
                part = table.slice(at, end - at)
                words = part["word"].to_pylist()
                columns = [part[c].to_numpy() for c in ("tile", "base", "front")]
                whole = part["i"].to_numpy() == part["j"].to_numpy()
                a, b = near_pairs((words, np.cumsum(new[at:end]), *columns, whole))
                if len(a):
                    yield best(words, part["n"].to_numpy(), a, b)
            at = end


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, best, best_n)`` of every word of ``words(word, n)`` that has a word one edit apart."""
    dealt = blocks(words).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = dealt.mapInArrow(_compared, "word string, near long, less long, form string")
    picked = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "form")).alias("top"))
    return picked.select("word", "n_near", F.col("top.form").alias("best"), (-F.col("top.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for the words of ``forms(word, form)``: the end of the chain of forms."""
    ends = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = ends.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = ends.join(ahead, ends["root"] == ahead["at"], "left")
        moved = written(moved.select("word", F.coalesce("next", "root").alias("root"), F.isnotnull("next").alias("went")), "roots")
        ends = moved.select("word", "root")
        if moved.where("went").isEmpty():
            return ends


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``docs``."""
    words = written(word_counts(docs, doc_id, text), "words")
    joined = words.join(near_words(words), "word", "left")
    takes = F.col("best_n") >= FACTOR * F.col("n")
    formed = written(
        joined.select(
            "word",
            F.when(takes, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(takes, F.col("best_n")).alias("form_n"),
        ),
        "formed",
    )
    ends = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
