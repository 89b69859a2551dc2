"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of the labelled documents, at most ``EXAMPLES`` of either label, chosen by a
hash of the id. Terms are words that occur unevenly often in the two labels (chi-square over the examples);
their document frequencies are counted over all documents. The index has a posting list for each term, cut
into blocks of examples with the largest weight of each block. A text looks at blocks in the order of the
bounds these give and stops where no block can hold a nearer example than those found, so its neighbours
are exactly the nearest.

Neighbours vote with their similarity; the vote is calibrated on the examples themselves, each without
itself, weighted back to the share that its label has among all labelled documents.

Odd input: a null or empty text, or one without a known term, gets the score of no evidence. Labels that
are null, without id or without document teach nothing; of repeated labels of one id the largest counts.
With one label only, its share is the score of every text. Very long texts are read whole; of examples equally
near the one of the smaller label and id comes first; repeated rows get equal scores, and an empty table gives an
empty one. Ids may be of any type. Extra columns pass untouched, but for those that bear the names of the results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, LongType

from obsload.llm.names import free
from obsload.workspace import written

EXAMPLES = 1500
TERMS = 5000
NEIGHBOURS = 15
BLOCK = 64
SMOOTHING = 0.5
_WORDS = re.compile(r"\w+")
#: chi-square of one degree of freedom that chance exceeds once in ten thousand terms
UNEVEN = 15.14


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


@dataclass
class Index:
    """Labelled examples by term; postings of a term stand in the order of the examples."""

    terms: dict[str, int]
    idf: np.ndarray
    labels: np.ndarray
    ids: list
    starts: np.ndarray  # of each term's postings
    example: np.ndarray
    weight: np.ndarray
    bounds: np.ndarray  # largest weight by term and block
    base: float
    slope: np.ndarray  # calibration: intercept, vote, similarity
    kind: DataType  # of the ids

    @classmethod
    def of(cls, terms: list[str], idf: np.ndarray, rows: list[tuple[object, int, np.ndarray, np.ndarray]], base: float, kind: DataType | None = None) -> Index:
        """``rows``: id, label, term numbers and counts of each example; ``kind`` is the type of the ids, else long."""
        n_blocks = max(1, -(-len(rows) // BLOCK))
        made = [(at, _normed(at, n, idf)) for _, _, at, n in rows]
        example = np.repeat(np.arange(len(rows)), [len(at) for at, _ in made])
        term = np.concatenate([at for at, _ in made] or [np.zeros(0, np.int64)])
        weight = np.concatenate([w for _, w in made] or [np.zeros(0)])
        order = np.lexsort((example, term))
        example, term, weight = example[order], term[order], weight[order]
        bounds = np.zeros((len(terms), n_blocks))
        np.maximum.at(bounds, (term, example // BLOCK), weight)
        starts = np.searchsorted(term, np.arange(len(terms) + 1))
        labels = np.array([r[1] for r in rows], dtype=np.int64)
        ids = [r[0] for r in rows]
        names = {t: i for i, t in enumerate(terms)}
        found = cls(names, idf, labels, ids, starts, example, weight, bounds, base, np.zeros(3), kind or LongType())
        found.slope = found._calibrated(made)
        return found

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        get = self.terms.get
        counts = Counter(t for w in words_of(text) if (t := get(w)) is not None)
        at = np.array(sorted(counts), dtype=np.int64)
        return at, _normed(at, np.array([counts[t] for t in at.tolist()], dtype=np.int64), self.idf)

    def nearest(self, at: np.ndarray, q: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of the largest positive cosine, nearest first; of equal ones the lower number."""
        if not len(at) or not len(self.labels):
            return np.zeros(0, np.int64), np.zeros(0)
        sizes = self.starts[at + 1] - self.starts[at]
        begin = np.repeat(self.starts[at] - np.cumsum(np.r_[0, sizes[:-1]]), sizes)
        postings = begin + np.arange(int(sizes.sum()))
        example, share = self.example[postings], self.weight[postings] * np.repeat(q, sizes)
        block = example // BLOCK
        bound = q @ self.bounds[at]
        order = np.argsort(-bound, kind="stable")
        scores, least, seen = np.zeros(len(self.labels)), 0.0, 0
        while seen < len(order) and bound[order[seen]] > 0 and bound[order[seen]] >= least - 1e-12:
            now = order[seen : seen + 4] if seen < 8 else order[seen:]
            now = now[(bound[now] > 0) & (bound[now] >= least - 1e-12)]
            chosen = np.zeros(len(bound), dtype=bool)
            chosen[now] = True
            kept = chosen[block]
            scores += np.bincount(example[kept], share[kept], minlength=len(scores))
            seen += max(1, len(now))
            if len(scores) > k:
                least = float(np.partition(scores, -k)[-k])
        best = np.lexsort((np.arange(len(scores)), -np.round(scores, 12)))[:k]
        best = best[scores[best] > 0]
        return best, scores[best]

    def _features(self, near: np.ndarray, sims: np.ndarray) -> np.ndarray:
        total = float(sims.sum())
        vote = (float(sims @ self.labels[near]) + SMOOTHING * self.base) / (total + SMOOTHING)
        return np.array([1.0, vote, float(sims[0]) * (2 * vote - 1) if len(sims) else 0.0])

    def _calibrated(self, made: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Weighted logistic regression of the labels on the votes of the others, by Newton steps."""
        if len(set(self.labels.tolist())) < 2:
            return np.zeros(3)
        rows = []
        for i, (at, q) in enumerate(made):
            near, sims = self.nearest(at, q, NEIGHBOURS + 1)
            others = near != i
            rows.append(self._features(near[others][:NEIGHBOURS], sims[others][:NEIGHBOURS]))
        x, y = np.array(rows), self.labels
        share = y.mean()
        weight = np.where(y == 1, self.base / share, (1 - self.base) / (1 - share))
        found = np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ found, -30, 30)))
            slope = x.T @ (weight * (p - y)) + 1e-2 * found
            bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
            found = found - np.linalg.solve(bend, slope)
        return found

    def score(self, text: str | None) -> tuple[float, list[int]]:
        """Calibrated score and the ids of the three nearest examples."""
        if len(set(self.labels.tolist())) < 2:
            return float(self.base), []
        near, sims = self.nearest(*self.vector(text))
        odds = float(np.clip(self._features(near, sims) @ self.slope, -30, 30))
        return 1 / (1 + float(np.exp(-odds))), [self.ids[i] for i in near[:3].tolist()]


def _normed(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1 + np.log(np.maximum(n, 1))) * idf[at]
    return values / max(1e-12, float(np.sqrt(values @ values)))


def build(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Index:
    """An index of ``docs`` with a label in ``labels`` where ``learn``, a condition on the id, holds."""
    known = labels.where(learn & F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = counts.get(1, 0) / max(1, sum(counts.values()))
    rank = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    share = F.when(F.col("label") == 1, min(1.0, EXAMPLES / max(1, counts.get(1, 0)))).otherwise(
        min(1.0, EXAMPLES / max(1, counts.get(0, 0)))
    )
    sample = known.where(rank < share)  # twice EXAMPLES rows or so, whatever the number of labels

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [Counter(words_of(t.as_py())) for t in batch.column(2)]
            kinds = (pa.list_(pa.string()), pa.list_(pa.int32()))
            columns = [pa.array([list(c) for c in counted], kinds[0]), pa.array([list(c.values()) for c in counted], kinds[1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["id", "label", "words", "counts"])

    said = docs.select(F.col(doc_id).alias("_doc"), F.col(text).cast("string").alias("text"))
    texts = said.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("_doc", "label", "text")
    kind = docs.schema[doc_id].dataType
    examples = written(
        texts.mapInArrow(split, f"id {kind.simpleString()}, label int, words array<string>, counts array<int>"), "examples"
    )
    examples = examples.dropDuplicates(["id"])
    sizes = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    seen = examples.select("label", F.explode("words").alias("word")).groupBy("word")
    seen = seen.agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).where("a + b >= 3")
    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), float(n0 + n1)
    uneven = n * F.pow(a * (n0 - b) - b * (n1 - a), F.lit(2.0)) / ((a + b) * (n - a - b) * max(1, n0) * max(1, n1))
    chosen = seen.where(a + b < n).withColumn("uneven", uneven).where(F.col("uneven") >= UNEVEN)
    terms = sorted(r["word"] for r in chosen.orderBy(F.desc("uneven"), "word").limit(TERMS).collect())
    idf = _idf(docs, terms, text)
    held = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for words, counts_ in zip(batch.column(2), batch.column(3), strict=True):
                rows.append(sorted((held.value[w], c) for w, c in zip(words.as_py(), counts_.as_py(), strict=True) if w in held.value))
            columns = [pa.array([[x[k] for x in r] for r in rows], pa.list_(pa.int32())) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["id", "label", "terms", "counts"])

    kept = examples.mapInArrow(keep, f"id {kind.simpleString()}, label int, terms array<int>, counts array<int>").collect()
    rows = [(r["id"], r["label"], np.array(r["terms"], np.int64), np.array(r["counts"], np.int64)) for r in kept]
    return Index.of(terms, idf, sorted(rows, key=lambda r: (r[1], r[0])), base, kind)


def _idf(docs: DataFrame, terms: list[str], text: str) -> np.ndarray:
    """Inverse document frequencies of the terms over all documents."""
    held = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(len(held.value), dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for t in batch.column(0):
                df[[held.value[w] for w in set(words_of(t.as_py())) & held.value.keys()]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[df[at], rows])], ["term", "n"])

    counted = docs.select(F.col(text).cast("string")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in counted.collect()}  # a row for each term at most
    df = np.array([found.get(i, 0) for i in range(len(terms))], dtype=float)
    return np.log((1 + found.get(-1, 0)) / (1 + df)) + 1


def with_toxicity(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``evidence``, the ids of the nearest examples."""
    held, kind = docs.sparkSession.sparkContext.broadcast(index), index.kind

    def rate(texts: pa.Array) -> pa.Array:
        rows = [held.value.score(t.as_py()) for t in texts]
        columns = [pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.list_(to_arrow_type(kind)))]
        return pa.StructArray.from_arrays(columns, ["score", "evidence"])

    (rated,) = free(docs, "_rated")
    made = docs.withColumn(rated, F.arrow_udf(rate, f"score double, evidence array<{kind.simpleString()}>")(F.col(text).cast("string")))
    made = made.withColumn("score", F.col(f"{rated}.score")).withColumn("evidence", F.col(f"{rated}.evidence")).drop(rated)
    return made.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
