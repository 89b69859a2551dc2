"""Delimited files read by many tasks each, line breaks inside quoted cells included.

Tasks read byte blocks of a file, cut at physical lines. Whether a line begins inside a quoted cell depends on
all quotes before it, so a first pass notes for every block how it ends if it begins outside of quotes, and how if
it begins inside, with the number of records it would start either way. Running these through the blocks of a
file, one small row for each block, tells how every block begins and which number its first record has. The
second pass then cuts records at true boundaries and numbers them without a shuffle of the data; only the pieces
of a record that crosses the end of a block, at most two for each block, meet in a grouping.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsload.sources.delimited import BROADCAST_BLOCKS, CORRUPT
from obsload.sources.profile import ENCODINGS
from obsload.workspace import written

# fixed values: where ISO-8859-15 differs from ISO-8859-1
LATIN_1 = "¤¦¨´¸¼½¾"
LATIN_9 = "€ŠšŽžŒœŸ"

TASK_BYTES = 128 * 1024 * 1024
_MINIMUM = "spark.sql.files.minPartitionNum"
_BLOCKS = (
    "_file string, _block long, ends_if_out boolean, ends_if_in boolean, starts_if_out long, starts_if_in long, "
    "bad long, head binary"
)
_RECORDS = "_file string, _block long, id_load int, line_no long, _record binary, _piece boolean"


@contextmanager
def same_splits(spark: SparkSession) -> Iterator[None]:
    """Files are cut alike in every scan inside, also when executors come or go."""
    before = spark.conf.get(_MINIMUM, None)
    spark.conf.set(_MINIMUM, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_MINIMUM)


def packed(lines: DataFrame) -> DataFrame:
    """``lines`` read by tasks of some ``TASK_BYTES`` each, however small the blocks are that files are cut into."""
    spark = lines.sparkSession
    block = lines.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    blocks = lines.rdd.getNumPartitions()
    tasks = max(-(-blocks * min(block, TASK_BYTES) // TASK_BYTES), 2 * spark.sparkContext.defaultParallelism)
    return lines.coalesce(tasks) if tasks < blocks else lines


class Quotes:
    """How quotes of a line move a reader into a cell and out of it."""

    def __init__(self, separator: str):
        sep = re.escape(separator.encode())
        self.separator = ord(separator)
        self.closing = re.compile(rb'(?:[^"]|"")*"(?!")', re.DOTALL)
        self.next_cell = re.compile(rb"[^" + sep + rb"]*" + sep)

    def ends_inside(self, line: bytes, inside: bool) -> bool:
        """Whether a quoted cell is open after the line; a quote within a bare cell opens none."""
        at = 0
        while True:
            if inside or line[at : at + 1] == b'"':
                close = self.closing.match(line, at if inside else at + 1)
                if close is None:
                    return True
                at, inside = close.end(), False
            cell = self.next_cell.match(line, at)
            if cell is None:
                return False
            at = cell.end()

    def turning(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Lines that may leave a reader elsewhere than it was: an odd number of quotes, or one amid other letters."""
        at = np.flatnonzero(data == 34)
        if not len(at):
            return at
        line = np.searchsorted(offsets, at, side="right") - 1
        odd = np.bincount(line, minlength=len(offsets) - 1) % 2 == 1
        edges = (34, self.separator, 13)
        before = np.isin(data[np.maximum(at - 1, 0)], edges) | (at == offsets[line])
        after = np.isin(data[np.minimum(at + 1, len(data) - 1)], edges) | (at + 1 == offsets[line + 1])
        odd[line[~before & ~after]] = True
        return np.flatnonzero(odd)


class Lines:
    """Consecutive lines of one block."""

    def __init__(self, lines: pa.BinaryArray, quotes: Quotes):
        raw = np.frombuffer(lines.buffers()[1], dtype=np.int32)
        offsets = raw[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
        data = np.frombuffer(lines.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        sizes = np.diff(offsets)
        last = np.zeros(len(sizes), dtype=np.uint8)
        last[sizes > 0] = data[offsets[1:][sizes > 0] - 1]
        self.blank = (sizes == 0) | (sizes == 1) & (last == 13)
        turning = quotes.turning(data, offsets)
        self.turns = [
            (i, [quotes.ends_inside(line, inside) for inside in (False, True)])
            for i, line in zip(turning.tolist(), lines.take(pa.array(turning)).to_pylist(), strict=True)
        ]
        self.lines = lines

    def begun_inside(self, inside: bool) -> tuple[np.ndarray, bool]:
        """For every line whether it begins inside a cell, and how the last one ends."""
        begun, at = np.empty(len(self.blank), dtype=bool), 0
        for i, ends in self.turns:
            begun[at : i + 1] = inside
            inside, at = ends[inside], i + 1
        begun[at:] = inside
        return begun, inside

    def undecodable(self) -> int:
        try:
            self.lines.cast(pa.string())
            return 0
        except pa.ArrowInvalid:
            return sum(not _is_utf8(line) for line in self.lines.to_pylist())


def _is_utf8(line: bytes) -> bool:
    try:
        line.decode()
        return True
    except UnicodeDecodeError:
        return False


def runs_of_blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Slices of a batch that come from one block of one file."""
    if not batch.num_rows:
        return
    files, blocks = pc.run_end_encode(batch["_file"]), pc.run_end_encode(batch["_block"])
    ends = np.union1d(files.run_ends.to_numpy(), blocks.run_ends.to_numpy())
    at = 0
    for end in ends.tolist():
        part = batch.slice(at, end - at)
        yield part["_file"][0].as_py(), part["_block"][0].as_py(), part
        at = end


def _profiled(separator: str, utf8: bool):
    """One row for each block: its effect on quotes, its records, its undecodable lines and the header."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, key, found = Quotes(separator), None, None
        for batch in batches:
            for file, block, part in runs_of_blocks(batch):
                if (file, block) != key:
                    if found is not None:
                        yield _block_row(found)
                    key, found = (file, block), [file, block, False, True, 0, 0, 0, b"" if block == 0 else None]
                    heading = block == 0
                lines = Lines(part["line"], quotes)
                begun, after = lines.begun_inside(found[2])
                starts = ~begun & ~lines.blank
                if heading:  # lines of the first record
                    kept = lines.lines.filter(pa.array(starts | begun)).to_pylist()
                    numbers = found[4] + np.cumsum(starts[starts | begun])
                    own = kept[: int(np.searchsorted(numbers, 1, side="right"))]
                    found[7] = b"\n".join([x for x in (found[7], *own) if x])
                    heading = len(own) == len(kept)
                found[4] += int(starts.sum())
                found[2] = after
                begun, found[3] = lines.begun_inside(found[3])
                found[5] += int((~begun & ~lines.blank).sum())
                found[6] += lines.undecodable() if utf8 else 0
        if found is not None:
            yield _block_row(found)

    return profile


def _block_row(found: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in _BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(found, kinds, strict=True)], names)


def block_states(blocks: DataFrame, id_load: Column) -> DataFrame:
    """``(_file, _block, id_load, inside, before)``: how each block begins and the records of its load before it."""
    order = Window.partitionBy("_file").orderBy("_block")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    # a block swaps the two ways, leaves them, or ends alike whichever way it began
    swaps = (F.col("ends_if_out") & ~F.col("ends_if_in")).cast("int")
    fixed = F.when(F.col("ends_if_out") == F.col("ends_if_in"), F.struct(F.col("ends_if_out").cast("int").alias("end"), "swaps"))
    swapped = blocks.withColumn("swaps", F.sum(swaps).over(upto)).withColumn("fixed", fixed)
    last = F.last("fixed", ignorenulls=True).over(earlier)
    ran = swapped.withColumn("last", last).withColumn("so_far", F.coalesce(F.lag("swaps").over(order), F.lit(0)))
    turned = F.coalesce("last.end", F.lit(0)) + F.col("so_far") - F.coalesce("last.swaps", F.lit(0))
    begun = ran.withColumn("inside", turned % 2 == 1).withColumn("id_load", id_load)
    starts = F.when(F.col("inside"), F.col("starts_if_in")).otherwise(F.col("starts_if_out"))
    # the header is no record
    records = starts - F.when((F.col("_block") == 0) & (starts > 0), 1).otherwise(0)
    of_load = Window.partitionBy("id_load").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    return begun.withColumn("before", F.coalesce(F.sum(records).over(of_load), F.lit(0))).select(
        "_file", "_block", "id_load", "inside", "before"
    )


class Cutter:
    """Puts the lines of one block together to records."""

    def __init__(self, block: int, inside: bool, before: int):
        self.inside, self.number = inside, before
        self.heading = block == 0  # no record of the file has begun yet
        # lines of the record under way, its number (none for the header), and whether an earlier block began it
        self.open: list[bytes] = []
        self.open_number: int | None = before
        self.piece = inside
        self.rows: tuple[list[int], list[bytes], list[bool]] = [], [], []

    def feed(self, lines: Lines) -> None:
        begun, self.inside = lines.begun_inside(self.inside)
        kept = begun | ~lines.blank
        texts = lines.lines.filter(pa.array(kept)).to_pylist()
        starts = np.flatnonzero(~begun[kept]).tolist()
        self.open += texts[: starts[0] if starts else len(texts)]
        if not starts:
            return
        self.close(False)
        ends = [*starts[1:], len(texts)]
        spans = [texts[a] if b == a + 1 else b"\n".join(texts[a:b]) for a, b in zip(starts, ends, strict=True)]
        if self.heading:
            self.open, self.open_number, self.heading = [spans.pop(0)], None, False
            if not spans:
                return
            self.close(False)
        first, self.number = self.number + 1, self.number + len(spans)
        self.open, self.open_number = [spans.pop()], self.number
        self.rows[0].extend(range(first, self.number))
        self.rows[1].extend(spans)
        self.rows[2].extend([False] * len(spans))

    def close(self, unfinished: bool) -> None:
        if self.open and self.open_number is not None:
            for column, value in zip(self.rows, (self.open_number, b"\n".join(self.open), self.piece or unfinished), strict=True):
                column.append(value)
        self.open, self.piece = [], False

    def taken(self) -> tuple[list[int], list[bytes], list[bool]]:
        rows, self.rows = self.rows, ([], [], [])
        return rows


def _cut(separator: str):
    """Numbered records of the lines of whole blocks; unfinished ones at either end of a block are pieces."""

    def row_batch(key: tuple[str, int, int], rows: tuple[list, list, list]) -> pa.RecordBatch:
        n = len(rows[0])
        columns = [
            pa.array([key[0]] * n, pa.string()),
            pa.array([key[1]] * n, pa.int64()),
            pa.array([key[2]] * n, pa.int32()),
            pa.array(rows[0], pa.int64()),
            pa.array(rows[1], pa.binary()),
            pa.array(rows[2], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["_file", "_block", "id_load", "line_no", "_record", "_piece"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, key, cutter = Quotes(separator), None, None
        for batch in batches:
            for file, block, part in runs_of_blocks(batch):
                now = (file, block, part["id_load"][0].as_py())
                if now != key:
                    if cutter is not None:
                        cutter.close(cutter.inside)
                        yield row_batch(key, cutter.taken())
                    key, cutter = now, Cutter(block, part["inside"][0].as_py(), part["before"][0].as_py())
                cutter.feed(Lines(part["line"], quotes))
                yield row_batch(key, cutter.taken())
        if cutter is not None:
            cutter.close(cutter.inside)
            yield row_batch(key, cutter.taken())

    return cut


def _decoded(record: Column, encoding: str) -> Column:
    if encoding == "utf-8":
        return record.cast("string")
    text = F.decode(record, "ISO-8859-1")
    return F.translate(text, LATIN_1, LATIN_9) if encoding == "iso-8859-15" else text


def _cells(record: Column, n: int, separator: str) -> Column:
    """Struct of the cells of a record, and its text where these are not ``n``."""
    names = ", ".join([*[f"c{i} string" for i in range(n)], f"{CORRUPT} string"])
    options = {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return F.from_csv(F.regexp_replace(record, "\r\\z", ""), names, {**options, "maxCharsPerColumn": "-1"})


def _refuse_faults(blocks: DataFrame, columns: Sequence[str], separator: str, encoding: str) -> None:
    """Aborts a load of which a file has another header than declared, or lines of another encoding."""
    bad = blocks.where("bad > 0").groupBy("_file").agg(F.sum("bad").alias("n")).orderBy("_file").first()
    if bad is not None:
        raise ValueError(f"{bad['n']} lines of {bad['_file']} are not {encoding}")
    text = F.regexp_replace(_decoded(F.col("head"), encoding.lower()), "^\ufeff", "")
    # one name more than declared, so that surplus ones show
    heads = blocks.where("head <> X''").select("_file", _cells(text, len(columns) + 1, separator).alias("h"))
    same = F.col(f"h.c{len(columns)}").isNull()
    for i, name in enumerate(columns):
        same = same & F.coalesce(F.lower(f"h.c{i}"), F.lit("")).eqNullSafe(F.lit(name.lower()))
    other = heads.where(~same).orderBy("_file").first()
    if other is not None:
        names = [x for x in list(other["h"])[:-1] if x is not None]
        raise ValueError(f"the header of {other['_file']} is {names}, not {list(columns)}")


def read_records(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str],
    separator: str = ";",
    encoding: str = "UTF-8",
    id_load: int | Column = 1,
) -> DataFrame:
    """Numbered records, written: ``columns…, _corrupt, _file, _block, id_load, line_no``.

    Numbers count from 1 within a load over its files in path order; ``id_load`` may depend on ``_file``. The
    header of every file is compared with ``columns`` and every line with the encoding, as
    :func:`obsload.sources.delimited.read_delimited` does, in the pass that notes the blocks.
    """
    if encoding.lower() not in ENCODINGS:
        raise ValueError(f"encoding {encoding!r} is not accepted")
    load = F.lit(id_load) if isinstance(id_load, int) else id_load
    listed = list(paths) if not isinstance(paths, str) else paths
    with same_splits(spark):
        lines = spark.read.option("lineSep", "\n").text(listed).select(
            F.col("value").cast("binary").alias("line"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
        lines = packed(lines)
        blocks = written(lines.mapInArrow(_profiled(separator, encoding.lower() == "utf-8"), _BLOCKS), "blocks")
        _refuse_faults(blocks, columns, separator, encoding)
        states = written(block_states(blocks, load.cast("int")), "states")
        if states.count() <= BROADCAST_BLOCKS:
            placed = lines.join(F.broadcast(states), ["_file", "_block"])
        else:
            at = lines.withColumn("_pos", F.monotonically_increasing_id())
            dealt = at.join(states, ["_file", "_block"]).repartition("_file", "_block")
            placed = dealt.sortWithinPartitions("_file", "_block", "_pos")
        placed = placed.select("line", "_file", "_block", "id_load", "inside", "before")
        cut = placed.mapInArrow(_cut(separator), _RECORDS)
        text = _decoded(F.col("_record"), encoding.lower())
        whole = F.when(~F.col("_piece"), _cells(text, len(columns), separator))
        records = written(
            cut.select("_file", "_block", "id_load", "line_no", whole.alias("_cells"), F.when(F.col("_piece"), F.col("_record")).alias("_piece")),
            "records",
        )
    place = ["_file", "_block", "id_load", "line_no"]
    pieces = records.where(F.col("_piece").isNotNull()).groupBy("id_load", "line_no").agg(
        F.min_by("_file", "_block").alias("_file"),
        F.min("_block").alias("_block"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_block", "_piece"))), lambda p: _latin(p["_piece"])), "\n"
        ).alias("text"),
    )
    joined = pieces.select(*place, _cells(_from_latin(F.col("text"), encoding.lower()), len(columns), separator).alias("_cells"))
    both = records.where(F.col("_piece").isNull()).select(*place, "_cells").unionByName(joined)
    cells = [F.col(f"_cells.c{i}").alias(c) for i, c in enumerate(columns)]
    return both.select(*cells, f"_cells.{CORRUPT}", *place)


def _latin(record: Column) -> Column:
    """Bytes as a text of as many letters, which may be joined."""
    return F.decode(record, "ISO-8859-1")


def _from_latin(text: Column, encoding: str) -> Column:
    return _decoded(F.encode(text, "ISO-8859-1"), encoding)
