"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three code points of the lower-cased text are hashed into ``DIMS`` buckets. Document
frequencies are counted over all documents that may be learned from. The weights are fitted by
follow-the-regularised-leader with elastic-net penalties on a bounded sample (``FIT_ROWS`` documents, dealt
over the languages, chosen by a hash of the id), and a temperature is then fitted on a fifth of the sample
that the weights have not seen.

Odd input: a text that is null or has no letter gets ``und`` with score 0. Documents without language or
without id are not learned from. Where nothing can be learned every text gets ``und``; with one language
every text with a letter gets that one. Very long texts are counted whole; of languages equally likely the first
by name is taken, and repeated rows get equal predictions. An empty table gives an empty one. Extra columns pass
untouched, but for those that bear the names of the results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsload.llm.names import free

DIMS = 1 << 15
FIT_ROWS = 2000
_BLOCK = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur in a text and how often."""
    points = np.frombuffer(text.lower().encode("utf-32-le", errors="surrogatepass"), dtype=np.uint32)
    total = np.zeros(DIMS, dtype=np.int64)
    shift = np.uint64(64 - DIMS.bit_length() + 1)
    for at in range(0, len(points), _BLOCK):
        block = points[at : at + _BLOCK + 2].astype(np.uint64) + np.uint64(1)
        own = min(_BLOCK, len(points) - at)
        key = np.zeros(len(block), dtype=np.uint64)
        for n in range(3):
            key = key[: len(block) - n] if n else key
            if not len(key):
                break
            key = (key + block[n:]) * _ODD[n]
            total += np.bincount(((key ^ key >> np.uint64(29)) * _ODD[2] >> shift)[:own].astype(np.int64), minlength=DIMS)
    buckets = np.flatnonzero(total)
    return buckets, total[buckets]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets by languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def logits(self, buckets: np.ndarray, n: np.ndarray) -> np.ndarray:
        return vector(buckets, n, self.idf) @ self.weights[buckets] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0
        p = softmax(self.logits(*counts(text)) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def vector(buckets: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1 + np.log(n)) * idf[buckets]
    return values / max(1e-12, float(np.sqrt(values @ values)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    classes: int,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.02,
    passes: int = 3,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after proximal follow-the-leader passes over ``(buckets, values, class)``."""
    z, squares = np.zeros((DIMS + 1, classes)), np.zeros((DIMS + 1, classes))

    def leader(at):
        lead = np.sign(z[at]) * l1 - z[at]
        return np.where(np.abs(z[at]) > l1, lead / ((beta + np.sqrt(squares[at])) / alpha + l2), 0.0)

    for turn in range(passes):
        for i in np.random.default_rng(turn).permutation(len(rows)):
            buckets, values, is_class = rows[i]
            at, x = np.r_[buckets, DIMS], np.r_[values, 1.0]
            w = leader(at)
            error = softmax(x @ w)
            error[is_class] -= 1
            g = np.outer(x, error)
            grown = squares[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(squares[at])) / alpha * w
            squares[at] = grown
    w = leader(np.arange(DIMS + 1))
    return w[:DIMS].astype(np.float32), w[DIMS]


def fit_temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """Temperature of the smallest negative log-likelihood, by golden section over its logarithm."""
    if not len(classes):
        return 1.0

    def loss(t):
        p = softmax(logits / np.exp(t))[np.arange(len(classes)), classes]
        return -np.log(np.maximum(p, 1e-12)).mean()

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from the rows of ``docs`` where ``learn`` holds and text, language and id are not null."""
    usable = learn & F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(doc_id).isNotNull()
    rows = docs.where(usable).select(
        F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((DIMS, 0), np.float32), np.zeros(0), np.ones(DIMS), 1.0)
    each = max(1, FIT_ROWS // len(languages))
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col("lang") == name, min(1.0, each / sizes[name])).otherwise(share)
    features = rows.select("text", "lang", (rank < share).alias("chosen"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents per bucket of the whole partition, and the features of the chosen rows."""
        df, chosen = np.zeros(DIMS, dtype=np.int64), []
        for batch in batches:
            for value, name, kept in zip(*batch.columns, strict=True):
                buckets, n = counts(value.as_py())
                df[buckets] += 1
                if kept.as_py():
                    packed = buckets.astype("<u4").tobytes() + n.astype("<u4").tobytes()
                    chosen.append((name.as_py(), packed))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*seen.tolist(), *[None] * len(chosen)], pa.int64()),
                pa.array([*df[seen].tolist(), *[None] * len(chosen)], pa.int64()),
                pa.array([*[None] * len(seen), *[c[0] for c in chosen]], pa.string()),
                pa.array([*[None] * len(seen), *[c[1] for c in chosen]], pa.binary()),
            ],
            ["bucket", "n", "lang", "packed"],
        )

    counted = features.mapInArrow(count, "bucket long, n long, lang string, packed binary")
    # one pass for both: sample rows are their own group, buckets are summed before the shuffle
    found = counted.groupBy("bucket", "lang", "packed").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    df, sample = np.zeros(DIMS), []
    for r in found.collect():
        if r["packed"] is None:
            df[r["bucket"]] = r["n"]
        else:
            half = len(r["packed"]) // 8
            both = np.frombuffer(r["packed"], "<u4").astype(np.int64)
            sample += [(both[:half], both[half:], languages.index(r["lang"]))] * r["rows"]
    idf = np.log((1 + sum(sizes.values())) / (1 + df)) + 1
    sample.sort(key=lambda s: (s[2], s[0].tobytes(), s[1].tobytes()))
    order = np.random.default_rng(7).permutation(len(sample))
    rows_in = [(sample[i][0], vector(sample[i][0], sample[i][1], idf), sample[i][2]) for i in order]
    held = rows_in[: len(rows_in) // 5]
    weights, bias = fit_ftrl(rows_in[len(held) :], len(languages))
    logits = np.array([x @ weights[b] + bias for b, x, _ in held]).reshape(-1, len(languages))
    temperature = fit_temperature(logits, np.array([c for *_, c in held], dtype=int))
    return Model(languages, weights, bias, idf, temperature)


def with_language(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its calibrated probability."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> pa.Array:
        found: Iterable[tuple[str, float]] = [held.value.predict(t.as_py()) for t in texts]
        names, scores = zip(*found, strict=True) if len(texts) else ((), ())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["p", "s"])

    (both,) = free(docs, "_language")
    made = docs.withColumn(both, F.arrow_udf(predict, "p string, s double")(F.col(text).cast("string")))
    return made.withColumn(pred, F.col(f"{both}.p")).withColumn(score, F.col(f"{both}.s")).drop(both)


def remainder(doc_id: str, folds: int) -> Column:
    """Fold of a document: CRC-32 of its id as text, modulo ``folds``; null without an id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds
