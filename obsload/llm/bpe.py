"""Byte-level BPE: texts to token ids and back.

The vocabulary file is read once by the driver and its tables (bounded by the vocabulary) travel to the
tasks. A text is cut where a single space stands between two other characters; no token crosses such a
place, so every piece can be encoded alone and is kept in a bounded cache. Pieces not met before are
encoded together, in rounds over one flat array of symbols: keys of neighbouring symbols are found by
binary search among the sorted pair keys, each word merges all places of its lowest-ranked pair, and the
rounds end when no word holds a known pair.

Results for odd input: a null or empty text has no ids; the text of an added token inside a document
becomes that token, as in the tokenizers library; null ids decode to the empty text; an id outside the
vocabulary raises. Very long texts are encoded whole, in chunks of texts and never of one text. Of pairs of one
rank the first merges, as in the library. Repeated rows have equal ids; an empty table gives an empty one.
Extra columns pass untouched, but for one that bears the name of the result.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: how byte-level vocabularies cut a text into words
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CACHED_PIECES = 250_000  # in each of two generations
CACHED_LENGTH = 48
CHUNK_CHARS = 3_000_000
_SHIFT = 20
_NONE = np.int64(2**62)
_ENDS = (".", ",", "!", "?", ";", ":")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, others from 256 upward."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


@dataclass
class Vocabulary:
    """Tables of one vocabulary; pair keys are ``left << 20 | right``, sorted."""

    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    of_byte: np.ndarray
    pieces: list[bytes]
    added: dict[str, int]
    size: int = field(default=0)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        model, ids = stated["model"], stated["model"]["vocab"]
        letters = byte_letters()
        back = {letter: b for b, letter in enumerate(letters)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        keys = left << _SHIFT | right
        order = np.argsort(keys)
        added = {t["content"]: t["id"] for t in stated.get("added_tokens", [])}
        size = max([*ids.values(), *added.values()]) + 1
        pieces = [b""] * size
        for token, i in ids.items():
            pieces[i] = bytes(back[c] for c in token)
        for token, i in added.items():
            pieces[i] = token.encode()
        return cls(
            keys=keys[order],
            ranks=order.astype(np.int64),
            made=made[order],
            of_byte=np.array([ids[c] for c in letters], dtype=np.int64),
            pieces=pieces,
            added=added,
            size=size,
        )


def merge_words(words: list[bytes], v: Vocabulary) -> list[bytes]:
    """Token ids of each word, as little-endian 32-bit integers, by merge rounds over all words at once."""
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    lengths = np.array([len(w) for w in words])
    symbols, owner = v.of_byte[raw], np.repeat(np.arange(len(words)), lengths)
    rank, made = np.full(len(raw), _NONE), np.zeros(len(raw), dtype=np.int64)
    changed = np.arange(max(0, len(raw) - 1))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        rank[changed], made[changed] = _looked_up(symbols, owner, changed, v)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[starts, len(owner)])
        lowest = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        live = lowest < _NONE
        if not live.all():  # words without a known pair leave the flat array
            done.append((symbols[~live], owner[~live]))
        chosen = np.flatnonzero(live & (rank == lowest))
        if len(chosen):
            # "aaa" holds the pair twice, overlapping: every other place of such a run counts
            first = np.r_[True, np.diff(chosen) != 1]
            begin = np.maximum.accumulate(np.where(first, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - begin) % 2 == 0]
            symbols[chosen] = made[chosen]
            live[chosen + 1] = False
        moved = (np.cumsum(live) - 1)[chosen]
        symbols, owner, rank, made = symbols[live], owner[live], rank[live], made[live]
        if len(rank):
            rank[-1] = _NONE
        # only pairs that end or begin in a merged symbol are new
        stale = np.zeros(len(symbols) + 1, dtype=bool)  # the last place takes what precedes the first
        stale[moved] = stale[moved - 1] = True
        changed = np.flatnonzero(stale[: max(0, len(symbols) - 1)])
    if not done:
        return [b""] * len(words)
    ids, owner = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(owner, kind="stable")
    flat = ids[order].astype("<u4").tobytes()
    ends = np.cumsum(np.bincount(owner, minlength=len(words))) * 4
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _looked_up(
    symbols: np.ndarray, owner: np.ndarray, at: np.ndarray, v: Vocabulary
) -> tuple[np.ndarray, np.ndarray]:
    """Rank of the pairs that begin at the given places, and the symbol that each would become."""
    keys = symbols[at] << _SHIFT | symbols[at + 1]
    found = np.minimum(np.searchsorted(v.keys, keys), len(v.keys) - 1)
    known = (v.keys[found] == keys) & (owner[at] == owner[at + 1])
    return np.where(known, v.ranks[found], _NONE), v.made[found]


Segment = tuple[str, list[str]] | int


class Encoder:
    """Encodes texts in chunks; keeps the ids of short pieces met before, in two generations."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.words = regex.compile(WORDS)
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        self.special = regex.compile("|".join(map(regex.escape, sorted(v.added, key=len)[::-1]))) if v.added else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pieces(self, text: str) -> Segment:
        """The first piece, and those that follow a single space, without it."""
        blank = text.replace("\n", " ").split(" ")
        # without neighbouring or outer white space, and with spaces and line ends only, any space is a cut
        plain = "" not in blank and len(blank) == len(text.split())
        first, *rest = text.split(" ") if plain else self.cut.split(text)
        return first, rest

    def segments(self, text: str) -> list[Segment]:
        """Runs of pieces of a text, and the ids of added tokens that stand between them."""
        if self.special is None or not any(t in text for t in self.v.added):
            return [self.pieces(text)]
        out: list[Segment] = []
        at = 0
        for m in self.special.finditer(text):
            if m.start() > at:
                out.append(self.pieces(text[at : m.start()]))
            out.append(self.v.added[m[0]])
            at = m.end()
        return out + [self.pieces(text[at:])] if at < len(text) else out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.segments(t) if t else [] for t in texts]
        runs = [s for segments in cut for s in segments if not isinstance(s, int)]
        young, old = self.young, self.old
        unmet = set().union(*[rest for _, rest in runs]) - young.keys()
        young.update((p, old[p]) for p in unmet & old.keys())
        new = list(unmet - old.keys())
        first = list({f for f, _ in runs})
        ids = self._encode_pieces([*[" " + p for p in new], *first])
        young.update(zip(new, ids, strict=False))
        bare = dict(zip(first, ids[len(new) :], strict=True))
        of = young.__getitem__
        out = []
        for segments in cut:
            made = [
                s.to_bytes(4, "little") if isinstance(s, int) else bare[s[0]] + b"".join(map(of, s[1])) for s in segments
            ]
            out.append(made[0] if len(made) == 1 else b"".join(made))
        for p in new:
            if len(p) > CACHED_LENGTH:
                del young[p]
        if len(young) > CACHED_PIECES:
            self.young, self.old = {}, young
        return out

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        words = []
        for p in pieces:
            if p[1:].isalpha() and (p[0] == " " or p[0].isalpha()):
                words.append([p])
            elif p[-1:] in _ENDS and p[1:-1].isalpha() and (p[0] == " " or p[0].isalpha()):
                words.append([p[:-1], p[-1]])
            else:
                words.append(self.words.findall(p))
        distinct = set().union(*words)
        young = self.young
        ids = {w: young[w[1:]] for w in distinct if w[0] == " " and w[1:] in young}
        new = list(distinct - ids.keys())
        if new:
            ids.update(zip(new, merge_words([w.encode() for w in new], self.v), strict=True))
        return [ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for ws in words]


def decode_ids(ids: bytes, v: Vocabulary) -> str:
    """Text of little-endian 32-bit ids; bytes that are no UTF-8 become the replacement character."""
    numbers = np.frombuffer(ids, dtype="<u4")
    if len(numbers) and int(numbers.max()) >= v.size:
        raise ValueError("an id lies outside the vocabulary")
    return b"".join([v.pieces[i] for i in numbers.tolist()]).decode("utf-8", errors="replace")


_ENCODERS: dict[str, Encoder] = {}


def _encoder(mark: str, tables: Broadcast) -> Encoder:
    """The encoder of a worker process, which keeps its pieces from task to task of one vocabulary."""
    if mark not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[mark] = Encoder(tables.value)
    return _ENCODERS[mark]


def _chunks(column: pa.Array) -> Iterable[list[str]]:
    """Texts in runs of some million characters, so that one chunk's pieces fit in memory."""
    chunk, size = [], 0
    for value in column:
        text = value.as_py() or ""
        chunk.append(text)
        size += len(text)
        if size >= CHUNK_CHARS:
            yield chunk
            chunk, size = [], 0
    yield chunk


def _tables(docs: DataFrame, path: str) -> tuple[str, Broadcast]:
    """The vocabulary as a broadcast, and a digest by which workers know it again."""
    vocabulary = Vocabulary.read(path)
    mark = xxhash.xxh128_hexdigest(vocabulary.keys.tobytes() + vocabulary.made.tobytes())
    return mark, docs.sparkSession.sparkContext.broadcast(vocabulary)


def with_ids(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of a text column as binary: little-endian unsigned 32-bit integers.

    Other columns pass untouched; a column already named ``ids`` is replaced.
    """
    mark, tables = _tables(docs, path)

    def encode(column: pa.Array) -> pa.Array:
        encoder = _encoder(mark, tables)
        return pa.array([x for chunk in _chunks(column) for x in encoder.encode(chunk)], pa.binary())

    return docs.withColumn(ids, F.arrow_udf(encode, "binary")(F.col(f"`{text}`").cast("string")))


def coded(text: Column | str, path: str, like: DataFrame) -> Column:
    """Column ``struct<ids, decoded>`` of a text: its token ids as in :func:`with_ids`, and the text they stand for.

    Both come from one call, so a text is encoded once however often the fields are used. ``like`` names the
    session. Odd input is taken as the module states; very long texts are encoded whole, repeated rows alike.
    """
    mark, tables = _tables(like, path)

    def both(column: pa.Array) -> pa.Array:
        encoder, v = _encoder(mark, tables), tables.value
        ids = [x for chunk in _chunks(column) for x in encoder.encode(chunk)]
        texts = pa.array([decode_ids(x, v) for x in ids], pa.string())
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), texts], ["ids", "decoded"])

    given = F.col(f"`{text}`") if isinstance(text, str) else text
    return F.arrow_udf(both, "ids binary, decoded string")(given.cast("string"))


def decoded(ids: Column | str, path: str, like: DataFrame) -> Column:
    """Column of the texts that ``ids`` stand for; ``like`` names the session."""
    tables = _tables(like, path)[1]

    def decode(column: pa.Array) -> pa.Array:
        return pa.array([decode_ids(x.as_py() or b"", tables.value) for x in column], pa.string())

    return F.arrow_udf(decode, "string")(F.col(ids) if isinstance(ids, str) else ids)
