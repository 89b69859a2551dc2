"""Log-bilinear language model trained by noise-contrastive estimation.

The outputs of the model are the ``WORDS`` most frequent words, the end of a text, and classes of all other
words by their last letters; a word of a class is as likely within it as its corpus count says, with one
part left for words never seen. Counts are taken over all training documents.

The two words before a place predict it: their vectors, each weighed by a vector of its position, add up
to a prediction whose product with an output's vector, plus a bias, is that output's score. Every partition
of the training documents moves the parameters by noise-contrastive steps over batches, and the mean of the
partitions, weighed by their tokens, is the model (two rounds, the first over a part of the documents).
As a context is two of some hundred numbers, the normaliser of every possible context is computed by
batched matrix products, so scores are exact log-probabilities.

Frequent words (``HEAVY``) meet their counts inside the scoring task; occurrences of rarer words go to a
join with the counts, and their sums come back to the documents.

Odd input: a null or empty text is the end token alone. Rows repeated or without id are scored alike; rows
without id are neither held out nor learned from. Without training documents every token has the one part
of the unseen. Very long texts are scored whole; of words equally frequent the smaller has the vector. An empty table
gives an empty one. Extra columns are left out of the result, other than those named.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsload.workspace import written

WORDS = 1024
CLASSES = 255
HEAVY = 100_000
LEAST_SHARE = 3_000_000  # a frequent word is more than one token in so many, so there are fewer than that
SIZE = 16
NOISE = 32
BATCH = 8192
RATE = 0.08
FIRST_ROUND = 0.15
FLUSH = 400_000
_END = b""  # no word is empty


def tokens(text: str | None) -> list[bytes]:
    """Words of a text in ASCII lower case, and the end."""
    return [*(text or "").encode().lower().split(), _END]


def class_of(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[-3:]) % CLASSES


@dataclass
class Vocabulary:
    """Frequent words with their counts, outputs of the model, and what the base score needs."""

    index: dict[bytes, int]
    counts: np.ndarray
    output: np.ndarray  # of each frequent word
    total: int
    distinct: int
    share: np.ndarray  # log10 of one count within the class of an output; zero for outputs that are words
    noise: np.ndarray  # probability of each output

    @property
    def outputs(self) -> int:
        return len(self.noise)

    @property
    def end(self) -> int:
        return 0

    @property
    def words(self) -> int:
        """Outputs up to this one are the end and words, the others classes."""
        return len(self.noise) - CLASSES - 1

    def rows(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Place among the frequent words, -1 if absent, and output of each word."""
        get = self.index.get
        at = np.array([get(w, -1) for w in words], dtype=np.int64)
        out = self.output[at] if len(self.output) else np.zeros(len(at), np.int64)
        for i in np.flatnonzero(at < 0).tolist():
            out[i] = 0 if words[i] == _END else 1 + self.words + class_of(words[i])
        return at, out


def _stream(batch: Sequence[str | None], v: Vocabulary) -> tuple[np.ndarray, ...]:
    """Flat words of some texts: place, output, outputs of the two words before, and where texts begin."""
    cut = [tokens(t) for t in batch]
    words = [w for c in cut for w in c]
    starts = np.cumsum([0, *[len(c) for c in cut]])[:-1]
    at, out = v.rows(words)
    one, two = (np.r_[[v.end] * k, out][: len(out)].astype(np.int64) for k in (1, 2))
    two[starts] = v.end
    return words, at, out, one, two, starts


def _chunks(column: pa.Array, size: int = 1_000_000) -> Iterator[list[str | None]]:
    some, n = [], 0
    for x in column:
        text = x.as_py()
        some.append(text)
        n += len(text or "")
        if n >= size:
            yield some
            some, n = [], 0
    if some:
        yield some


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """``(word, class, n)`` over all texts; each task sends its distinct words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = list(seen)
            columns = [pa.array(words, pa.binary()), pa.array([class_of(w) for w in words], pa.int32()), pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "class", "n"])

        for batch in batches:
            for x in batch.column(0):
                seen.update(tokens(x.as_py()))
                if len(seen) > FLUSH:
                    yield flush()
        yield flush()

    found = docs.select(F.col(text).cast("string")).mapInArrow(count, "word binary, class int, n long")
    return found.groupBy("word", "class").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """``counts`` is written; the driver sees its ``HEAVY`` largest rows and a row for each class.

    Words too rare to be among these by their share alone are left out before any task sends its largest.
    """
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    words = counts.where(F.octet_length("word") > 0)
    frequent = words.where(F.col("n") * LEAST_SHARE > totals["n"])
    heavy = frequent.orderBy(F.desc("n"), "word").limit(HEAVY).collect()
    ends = counts.where(F.octet_length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = 1 + WORDS + CLASSES
    mass, kinds = np.zeros(size), np.zeros(size)
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        mass[1 + WORDS + r["class"]], kinds[1 + WORDS + r["class"]] = r["n"], r["v"]
    output = np.array([1 + i if i < WORDS else 1 + WORDS + r["class"] for i, r in enumerate(heavy)], dtype=np.int64)
    for i, r in enumerate(heavy[:WORDS]):
        mass[1 + i] = r["n"]
        mass[1 + WORDS + r["class"]] -= r["n"]
        kinds[1 + WORDS + r["class"]] -= 1
    mass[0] = ends
    share = np.where(np.arange(size) > WORDS, -np.log10(mass + kinds + 1), 0.0)
    noise = (mass + 1) / (mass + 1).sum()
    index = {bytes(r["word"]): i for i, r in enumerate(heavy)}
    index[_END] = len(heavy)
    return Vocabulary(
        index,
        np.array([*[r["n"] for r in heavy], ends], dtype=np.int64),
        np.r_[output, 0],
        int(totals["n"]),
        int(totals["v"]),
        share,
        noise,
    )


class Model:
    """Vectors of context words and outputs, weights of the two positions, and biases, as one flat array."""

    def __init__(self, v: Vocabulary, flat: np.ndarray | None = None):
        n, rng = v.outputs, np.random.default_rng(11)
        sizes = [n * SIZE, n * SIZE, 2 * SIZE, n]
        if flat is None:
            flat = np.concatenate(
                [rng.normal(0, 0.1, sizes[0]), rng.normal(0, 0.1, sizes[1]), np.ones(sizes[2]), np.log(v.noise)]
            )
        self.flat = flat.astype(np.float32)
        a, b, c, d = np.split(self.flat, np.cumsum(sizes)[:-1])
        self.context, self.out, self.position, self.bias = a.reshape(n, SIZE), b.reshape(n, SIZE), c.reshape(2, SIZE), d
        self.noise = v.noise
        self.squares = np.full_like(self.flat, 1e-3)

    def step(self, out: np.ndarray, one: np.ndarray, two: np.ndarray, rng: np.random.Generator) -> None:
        """One noise-contrastive step over a batch; all its places share the noise."""
        n = len(out)
        drawn = rng.choice(len(self.noise), NOISE, p=self.noise)
        a, b = self.context[one], self.context[two]
        r = a * self.position[0] + b * self.position[1]
        odds = np.log(NOISE * self.noise).astype(np.float32)
        real = (r * self.out[out]).sum(1) + self.bias[out] - odds[out]
        fake = r @ self.out[drawn].T + (self.bias - odds)[drawn]
        up = -1 / (1 + np.exp(np.clip(real, -30, 30)))  # slope of the loss by each score
        down = 1 / (1 + np.exp(-np.clip(fake, -30, 30)))
        slope_r = up[:, None] * self.out[out] + down @ self.out[drawn]
        g = np.zeros_like(self.flat)
        m = len(self.noise)
        parts = np.split(g, np.cumsum([m * SIZE, m * SIZE, 2 * SIZE])[:3])
        context, outs, position, bias = parts[0].reshape(m, SIZE), parts[1].reshape(m, SIZE), parts[2].reshape(2, SIZE), parts[3]
        _scatter(context, np.r_[one, two], np.concatenate([slope_r * self.position[0], slope_r * self.position[1]]))
        _scatter(outs, out, up[:, None] * r)
        np.add.at(outs, drawn, down.T @ r)
        position[0], position[1] = (slope_r * a).sum(0), (slope_r * b).sum(0)
        bias += np.bincount(out, up, m).astype(np.float32)
        np.add.at(bias, drawn, down.sum(0))
        g /= np.float32(np.sqrt(n))
        self.squares += g * g
        self.flat -= np.float32(RATE) * g / np.sqrt(self.squares)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of every output after each first and second word, and the normaliser of every context."""
        first = (self.context * self.position[0]) @ self.out.T + self.bias
        second = (self.context * self.position[1]) @ self.out.T
        norm = np.empty((len(first), len(second)), dtype=np.float32)
        # exp(a + b) of a pair of words is a product, so a matrix product sums over the outputs
        top_a, top_b = first.max(1), second.max(1)
        low = np.exp(second - top_b[:, None]).astype(np.float64)
        for i in range(0, len(first), 256):
            high = np.exp(first[i : i + 256] - top_a[i : i + 256, None]).astype(np.float64)
            norm[i : i + 256] = np.log(np.maximum(high @ low.T, 1e-300)) + top_a[i : i + 256, None] + top_b
        return first, second, norm


def _scatter(into: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """``into[at] += values``, summed by sorted place."""
    order = np.argsort(at, kind="stable")
    sorted_ = at[order]
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    into[sorted_[starts]] += np.add.reduceat(values[order], starts, axis=0)


def train(docs: DataFrame, v: Vocabulary, text: str, start: Model | None = None) -> Model:
    """The mean of what every partition makes of the parameters."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((v, (start or Model(v)).flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v_, flat = held.value
        model, rng, seen = Model(v_, flat), np.random.default_rng(TaskContext.get().partitionId()), 0
        for batch in batches:
            for some in _chunks(batch.column(0)):
                _, _, out, one, two, _ = _stream(some, v_)
                order = rng.permutation(len(out))
                for i in range(0, len(out), BATCH):
                    at = order[i : i + BATCH]
                    model.step(out[at], one[at], two[at], rng)
                seen += len(out)
        if seen:
            values = [pa.array(np.arange(len(flat))), pa.array(model.flat.astype(np.float64) * seen), pa.array(np.full(len(flat), seen))]
            yield pa.RecordBatch.from_arrays(values, ["i", "value", "n"])

    moved = docs.select(F.col(text).cast("string")).mapInArrow(run, "i long, value double, n long")
    mean = moved.groupBy("i").agg((F.sum("value") / F.sum("n")).alias("value")).toPandas()  # a row for each parameter
    if mean.empty:
        return start or Model(v)
    flat = np.empty(len(mean))
    flat[mean["i"].to_numpy()] = mean["value"].to_numpy()
    return Model(v, flat)


def scored(
    docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs``.

    ``learn`` is a condition on the id that picks the training documents.
    """
    training = docs.where(learn & F.col(doc_id).isNotNull())
    counts = written(word_counts(training, text), "counts")
    v = vocabulary(counts)
    rank = F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    model = train(training.where(rank < FIRST_ROUND), v, text)
    model = train(training, v, text, model)
    held = docs.sparkSession.sparkContext.broadcast((v, model.tables()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v_, (first, second, norm) = held.value
        logs = np.log10(v_.counts + 1.0)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            done = 0
            for some in _chunks(batch.column(1)):
                words, at, out, one, two, starts = _stream(some, v_)
                n = np.diff(np.r_[starts, len(words)])
                row = np.repeat(np.arange(len(some)), n)
                known = at >= 0
                log_count = np.where(known, logs[at], 0.0)
                model_log = (first[one, out].astype(np.float64) + second[two, out] - norm[one, two]) / np.log(10)
                model_log += v_.share[out] + np.where(out > v_.words, log_count, 0.0)
                sums = [np.add.reduceat(x, starts) for x in (log_count, known & (v_.counts[at] > 0), model_log)]
                at_row = number + np.arange(len(some))
                number += len(some)
                yield _rows(at_row, batch.column(0).slice(done, len(some)), n, sums, None, None)
                done += len(some)
                rare = Counter(zip(row[~known].tolist(), [words[i] for i in np.flatnonzero(~known).tolist()], strict=True))
                if rare:
                    uid = at_row[[r for r, _ in rare]]
                    yield _rows(uid, pa.nulls(len(rare), batch.column(0).type), None, None, [w for _, w in rare], list(rare.values()))

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"uid long, doc_id {kind}, n_tokens long, logs double, known long, model double, word binary, tf long"
    narrow = docs.select(doc_id, F.col(text).cast("string"))
    both = written(narrow.mapInArrow(score, schema), "scored")
    rare = both.where("word IS NOT NULL").select("uid", "word", "tf").join(counts.select("word", "n"), "word")
    more = rare.groupBy("uid").agg(
        F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("more"), F.sum("tf").alias("more_known")
    )
    rows = both.where("word IS NULL").join(more, "uid", "left")
    extra = F.coalesce("more", F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("logs") + extra - F.col("n_tokens") * F.lit(float(np.log10(v.total + v.distinct + 1)))).alias("base_score"),
        (F.col("model") + extra).alias("score"),
    )


def _rows(uid, ids, n, sums, words, tf) -> pa.RecordBatch:
    m = len(uid)
    none = lambda kind: pa.nulls(m, kind)
    columns = [
        pa.array(uid),
        ids,
        none(pa.int64()) if n is None else pa.array(n),
        none(pa.float64()) if sums is None else pa.array(sums[0]),
        none(pa.int64()) if sums is None else pa.array(sums[1].astype(np.int64)),
        none(pa.float64()) if sums is None else pa.array(sums[2]),
        none(pa.binary()) if words is None else pa.array(words, pa.binary()),
        none(pa.int64()) if tf is None else pa.array(tf, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "n_tokens", "logs", "known", "model", "word", "tf"])
