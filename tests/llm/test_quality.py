"""Counts of the rules, estimation and verdict against plain Python."""

import math
import re
from collections import Counter

from obsload.llm import quality
from obsload.llm.queries import op2_quality

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def plain_estimate(patterns, rounds=quality.ROUNDS):
    k = len(quality.rules())
    belief = {v: 0.9 * 0.1 ** v.count(-1) for v in patterns}
    for _ in range(rounds):
        good = sum(n * belief[v] for v, n in patterns.items())
        bad = sum(n * (1 - belief[v]) for v, n in patterns.items())
        prior = (good + 1) / (good + bad + 2)
        on_good, on_bad = [], []
        for i in range(k):
            gy, gn, by, bn = (
                sum(n * (belief[v] if kind == "g" else 1 - belief[v]) for v, n in patterns.items() if v[i] == value)
                for kind, value in (("g", 1), ("g", -1), ("b", 1), ("b", -1))
            )
            on_good.append(max(1 - quality.FALSE_ALARMS, (gy + 1) / (gy + gn + 2)))
            on_bad.append((bn + 1) / (by + bn + 2))
        for v in patterns:
            odds = math.log(prior / (1 - prior))
            for x, g, b in zip(v, on_good, on_bad, strict=True):
                odds += math.log(g / (1 - b)) if x == 1 else math.log((1 - g) / b) if x == -1 else 0
            belief[v] = 1 / (1 + math.exp(-odds))
    return belief


def test_query_against_plain_counts_and_estimation(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = op2_quality(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    votes = {r["doc_id"]: tuple(r["votes"]) for r in quality.with_votes(quality.with_counts(docs)).collect()}
    belief = plain_estimate(Counter(votes.values()))
    for r in rows:
        counts = plain_counts(texts[r["doc_id"]])
        assert counts == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert r["base_failed"] == failed
        assert abs(r["posterior"] - belief[votes[r["doc_id"]]]) < 1e-9
        assert r["kept"] == (not failed and r["posterior"] >= 0.5)


def test_verdicts_agree_with_labels(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = op2_quality(spark, FOLDER).join(labels, "doc_id").where("not base_failed").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in rows)
    assert right / len(rows) > 0.97


def test_one_bad_vote_is_weighed_not_final(spark):
    k = len(quality.rules())
    clean, faulty, odd = (1,) * k, (1, -1, -1, -1) + (1,) * (k - 4), (-1,) + (1,) * (k - 1)
    frame = spark.createDataFrame([(list(clean), 900), (list(faulty), 80), (list(odd), 1)], "votes array<int>, n long")
    found = quality.estimate(frame)
    shown = {tuple(r["votes"]): r["p"] for r in frame.select("votes", found.posterior(frame.votes).alias("p")).collect()}
    assert shown[clean] > 0.99 and shown[faulty] < 0.01


def test_nulls_empty_texts_repeats_and_clashing_columns(spark):
    rows = [(1, None, 3), (2, "", 4), (3, " \t\n ", 5), (None, "a b c a b c a", 6), (4, "x\nx\n\n \nx y", 7), (4, "x\nx\n\n \nx y", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    out = quality.judged(docs)
    assert out.columns[:2] == ["doc_id", "n_words"]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_dup_lines"], r["n_repeat_words"], r["kept"]) for r in out.collect())
    assert got == [(0, 7, 0, 7, False), (1, 0, 0, 0, False), (2, 0, 0, 0, False), (3, 0, 0, 0, False), (4, 4, 1, 0, False), (4, 4, 1, 0, False)]
    assert quality.judged(docs.limit(0)).count() == 0
