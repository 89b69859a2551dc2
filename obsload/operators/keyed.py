"""Key look-ups that hold when one key owns a large share of the rows.

Every cross-row or referential operator has the same three steps: count rows per key (combined
before the shuffle, so a hot key costs one row per task), decide on the distinct keys, and bring
the decision back to the rows. Only the last step can skew. Keys owning more than one row in
``HEAVY_SHARE`` are at most ``HEAVY_SHARE`` in number, whatever the data: they are broadcast. The
other keys join by shuffle, where rows without a key or already answered are spread by a salt
instead of piling up in the partition of the null key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsload.workspace import small_enough, written

HEAVY_SHARE = 1000
SALTS = 256
BROADCAST_KEYS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def key_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct complete keys with their number of rows, in column ``n``."""
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    return rows.where(complete).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def left_lookup(
    rows: DataFrame,
    found: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    counts: DataFrame,
    spread: Column,
    settle: bool = False,
) -> DataFrame:
    """``rows`` with the ``values`` of the matching line of ``found``, null where there is none.

    ``counts`` are the rows per key (:func:`key_counts`) and ``found`` the lines of it that have an
    answer, still carrying ``n``; ``spread`` is any column that varies within a key, such as the
    line number. With ``settle`` the answers are written first: when they turn out to be few and
    small, as faulty keys mostly are, they are broadcast and the rows are not shuffled at all.
    """
    if settle:
        found = written(found.select(*keys, *values, "n"), "answers")
        if small_enough(found, BROADCAST_KEYS, BROADCAST_BYTES):
            return rows.join(F.broadcast(found.drop("n")), list(keys), "left").select(
                *rows.columns, *values
            )
        counts = written(counts, "counts")
    total = counts.agg(F.sum("n")).scalar()
    sized = found.select(*keys, *values, F.col("n").alias("_n"))
    is_heavy = F.col("_n") * HEAVY_SHARE > total
    heavy = sized.where(is_heavy).select(
        *[F.col(k).alias(f"_h_{k}") for k in keys], *[F.col(v).alias(f"_h_{v}") for v in values]
    )
    light = sized.where(~is_heavy).select(
        *[F.col(k).alias(f"_l_{k}") for k in keys],
        *[F.col(v).alias(f"_l_{v}") for v in values],
        F.lit(0).alias("_l_salt"),
    )
    on_heavy = [F.col(k) == F.col(f"_h_{k}") for k in keys]
    answered = rows.join(F.broadcast(heavy), on_heavy, "left")

    done = F.col(f"_h_{keys[0]}").isNotNull()
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    salt = F.when(done | missing, 1 + F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0))
    salted = answered.withColumn("_salt", salt.cast("int"))
    # salted rows hash on (null, salt): spread out, and never equal to a light key
    salted = salted.withColumns({f"_j_{k}": F.when(F.col("_salt") == 0, F.col(k)) for k in keys})
    on_light = [
        *[F.col(f"_j_{k}") == F.col(f"_l_{k}") for k in keys],
        F.col("_salt") == F.col("_l_salt"),
    ]
    joined = salted.join(light, on_light, "left")
    return joined.select(
        *[F.col(c) for c in rows.columns],
        *[F.coalesce(F.col(f"_h_{v}"), F.col(f"_l_{v}")).alias(v) for v in values],
    )


def flag_keys(
    rows: DataFrame,
    keys: Sequence[str],
    chosen: DataFrame,
    counts: DataFrame,
    flag: str,
    spread: Column,
    settle: bool = False,
) -> DataFrame:
    """``rows`` with boolean ``flag``: whether the row's key is among ``chosen`` (part of ``counts``)."""
    marked = chosen.select(*keys, "n").withColumn(flag, F.lit(True))
    looked = left_lookup(rows, marked, keys, [flag], counts, spread, settle)
    return looked.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def flag_lines(rows: DataFrame, lines: DataFrame, flag: str) -> DataFrame:
    """Marks the rows listed in ``lines(id_load, line_no)``; the pair is unique, so nothing skews.

    The list is written first and broadcast when it is small.
    """
    listed = written(lines.select("id_load", "line_no").withColumn(flag, F.lit(True)), "lines")
    if small_enough(listed, BROADCAST_KEYS, BROADCAST_BYTES):
        listed = F.broadcast(listed)
    joined = rows.join(listed, ["id_load", "line_no"], "left")
    return joined.select(*rows.columns, F.coalesce(F.col(flag), F.lit(False)).alias(flag))


def fetch(
    rows: DataFrame,
    dimension: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    spread: Column,
    settle: bool = False,
    unique: bool = False,
) -> DataFrame:
    """``values`` of a dimension, looked up once per distinct key of ``rows``.

    Rows never multiply: of several lines of the dimension with one key the smallest counts. ``unique`` says that
    the dimension holds each key once, so that its values, which may be whole shapes, are neither grouped nor compared.
    """
    counts = key_counts(rows, keys)
    found = counts.join(dimension.select(*keys, *values), list(keys))
    if not unique:
        found = found.groupBy(*keys, "n").agg(F.min(F.struct(*values)).alias("_found")).select(*keys, "n", "_found.*")
    return left_lookup(rows, found, keys, values, counts, spread, settle)


@dataclass(frozen=True)
class Question:
    """What is asked about the key of every row; column ``flag`` is true where the answer is yes.

    ``REPEATED``: other rows have the key too. ``ABSENT`` and ``PRESENT``: it is missing from, or found in, the one
    column of ``known``, which may hold a key many times. A key with a null part is not asked about.
    """

    flag: str
    keys: tuple[str, ...]
    asks: str
    known: DataFrame | None = None


REPEATED, ABSENT, PRESENT = "repeated", "absent", "present"

#: bits of a filter for each key it holds, of one hash: one key in 17 passes for nothing
FILTER_BITS = 16
_BITMAP_BITS = 32_768


def _key_text(keys: Sequence[str]) -> Column:
    """One text for each complete key, null for others; equal texts stand for equal keys."""
    if len(keys) == 1:
        return F.col(keys[0]).cast("string")
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    return F.when(complete, F.to_json(F.struct(*keys)))


def possible(rows: DataFrame, key: str, keys: DataFrame, n: int) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in the one column of ``keys``, which has ``n`` lines.

    The keys become a Bloom filter of bitmaps, broadcast; where it would outgrow ``BROADCAST_BYTES`` all rows stay.
    """
    size = max(_BITMAP_BITS, 1 << (max(1, n) * FILTER_BITS - 1).bit_length())
    if size // 8 > BROADCAST_BYTES:
        return rows

    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(size))

    held = keys.select(place(F.col(keys.columns[0])).alias("p"))
    bits = held.groupBy((F.col("p") / _BITMAP_BITS).cast("long").alias("_part")).agg(
        F.bitmap_construct_agg(F.col("p") % _BITMAP_BITS).alias("_map")
    )
    at = rows.withColumn("_p", place(F.col(key))).withColumn("_part", (F.col("_p") / _BITMAP_BITS).cast("long"))
    byte = F.substring("_map", (F.col("_p") % _BITMAP_BITS / 8).cast("int") + 1, F.lit(1))
    set_ = F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), (F.col("_p") % 8).cast("int")) == 1
    return at.join(F.broadcast(bits), "_part").where(set_).select(*rows.columns)


def answers(source: DataFrame, questions: Sequence[Question], row_id: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keys asked about by row, their counts, and those with an answer as ``(kind, key, n, bits)``.

    All keys of a row are counted in one pass over ``source``, with map-side combining, and all referentials meet
    the distinct keys in one join; only keys that may match come that far.
    """
    kinds = list(dict.fromkeys(q.keys for q in questions))
    entries = []
    for i, keys in enumerate(kinds):
        text = _key_text(keys)
        entries.append(F.when(text.isNotNull(), F.struct(F.lit(i).alias("kind"), text.alias("key"))))
    exploded = source.select(*row_id, F.explode(F.array_compact(F.array(*entries))).alias("_asked"))
    asked = exploded.select(*row_id, "_asked.kind", "_asked.key")
    counts = written(key_counts(asked, ["kind", "key"]), "counts")
    sizes = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}

    met, bits = counts.withColumn("there", F.lit(0)), F.lit(0)
    there = None
    for bit, q in enumerate(questions):
        kind = kinds.index(q.keys)
        of_kind = F.col("kind") == kind
        if q.asks == REPEATED:
            bits = bits + F.when(of_kind & (F.col("n") > 1), 1 << bit).otherwise(0)
            continue
        known = q.known.select(F.col(q.known.columns[0]).try_cast(source.schema[q.keys[0]].dataType).cast("string").alias("key"))
        near = possible(known, "key", counts.where(of_kind).select("key"), sizes.get(kind, 0))
        held = near.select(F.lit(kind).alias("kind"), "key", F.lit(1 << bit).alias("there"))
        there = held if there is None else there.unionByName(held)
        is_there = F.col("there").bitwiseAND(1 << bit) != 0
        bits = bits + F.when(of_kind & (is_there if q.asks == PRESENT else ~is_there), 1 << bit).otherwise(0)
    if there is not None:
        once = there.groupBy("kind", "key").agg(F.bit_or("there").alias("there"))
        met = counts.join(once, ["kind", "key"], "left").withColumn("there", F.coalesce("there", F.lit(0)))
    found = met.select("kind", "key", "n", bits.alias("bits")).where("bits <> 0")
    return asked, counts, written(found, "answers")


def with_answers(
    rows: DataFrame, questions: Sequence[Question], row_id: Sequence[str], source: DataFrame | None = None,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """``rows`` with the flag of every question.

    ``source`` holds the same rows with their keys, best as a written table; ``row_id`` names its columns that tell
    rows apart. Few answers are broadcast. Many come back as one bitmap a row: they meet the narrow keys first, hot
    ones by broadcast, and the rows join the bitmaps on their unique id.
    """
    if not questions:
        return rows
    kinds = list(dict.fromkeys(q.keys for q in questions))
    source = rows if source is None else source
    asked, counts, found = answers(source, questions, row_id)
    columns = rows.columns
    if small_enough(found, broadcast_keys, BROADCAST_BYTES):
        for i, keys in enumerate(kinds):
            own = found.where(F.col("kind") == i).select(F.col("key").alias(f"_asked{i}"), F.col("bits").alias(f"_answer{i}"))
            rows = rows.withColumn(f"_asked{i}", _key_text(keys)).join(F.broadcast(own), f"_asked{i}", "left")
        bits = {keys: F.col(f"_answer{i}") for i, keys in enumerate(kinds)}
    else:
        looked = left_lookup(asked, found, ["kind", "key"], ["bits"], counts, F.xxhash64(*row_id))
        marks = looked.where(F.col("bits").isNotNull()).groupBy(*row_id).agg(F.bit_or("bits").alias("_answer"))
        marks = written(marks, "marks")
        if small_enough(marks, broadcast_keys, BROADCAST_BYTES):
            marks = F.broadcast(marks)
        rows = rows.join(marks, list(row_id), "left")
        bits = {keys: F.col("_answer") for keys in kinds}
    flags = [
        F.coalesce(bits[q.keys].bitwiseAND(1 << i) != 0, F.lit(False)).alias(q.flag) for i, q in enumerate(questions)
    ]
    return rows.select(*columns, *flags)


def flag_duplicates(
    rows: DataFrame, keys: Sequence[str], flag: str, spread: Column, settle: bool = False
) -> DataFrame:
    """Marks every member of a group of rows sharing a complete key."""
    counts = key_counts(rows, keys)
    return flag_keys(rows, keys, counts.where(F.col("n") > 1), counts, flag, spread, settle)


def flag_duplicate_records(
    rows: DataFrame, columns: Sequence[str], flag: str, spread: Column, settle: bool = False
) -> DataFrame:
    """Marks records that agree with another one in all ``columns``; nulls agree with nulls.

    Digests of the records are compared, so wide records travel as 32 bytes.
    """
    marked = flag_duplicates(rows.withColumn("_record", record_digest(columns)), ["_record"], flag, spread, settle)
    return marked.drop("_record")


def record_digest(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}), 256)


def flag_unknown(
    rows: DataFrame,
    key: str,
    reference: DataFrame,
    reference_key: str,
    flag: str,
    spread: Column,
    settle: bool = False,
) -> DataFrame:
    """Marks rows whose key is absent from a referential; a null key is not marked."""
    counts = key_counts(rows, [key])
    absent = counts.join(reference, F.col(key) == reference[reference_key], "left_anti")
    return flag_keys(rows, [key], absent, counts, flag, spread, settle)


def flag_existing(
    rows: DataFrame,
    key: str,
    target: DataFrame,
    target_key: str,
    same_scope: Column,
    flag: str,
    spread: Column,
    settle: bool = False,
) -> DataFrame:
    """Marks rows whose key exists among the target rows kept by ``same_scope``."""
    counts = key_counts(rows, [key])
    scoped = target.where(same_scope)
    present = counts.join(scoped, F.col(key) == scoped[target_key], "left_semi")
    return flag_keys(rows, [key], present, counts, flag, spread, settle)
