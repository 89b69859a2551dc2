"""Quality of documents by weak supervision: rules vote, expectation-maximisation weighs them.

Eight rules look at counts of a document and vote good, bad or not at all. How often each rule is right on
good and on bad documents is unknown; it is estimated from the agreement between the rules. Documents are
first counted by their pattern of votes, at most three to the number of rules, so each round of estimation
is one aggregate over that small table whatever the number of documents. The posterior probability of
being good is then a column expression over the votes. Everything is DataFrame work.

Odd input: a null, empty or blank text has zero counts, no votes but that on its length, and fails the
base rules. Repeated rows are judged alike. Very long texts are counted whole; a posterior of exactly the threshold
keeps a document. Over an empty table nothing is estimated and the result is empty. Extra columns pass untouched
unless they bear the name of a result, or are named ``_w`` or ``_l``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsload.functions.binding import let
from obsload.workspace import written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
ROUNDS = 25
FALSE_ALARMS = 0.001  # rules are written so that a bad vote on a good document is an exception
GOOD, BAD, SILENT = 1, -1, 0


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(words: Column) -> Column:
    """Words of an array that lie in a three-word window found twice or more in it."""

    def of(words: Column) -> Column:
        windows = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(
            F.array().cast("array<int>")
        )
        hashes = F.transform(windows, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            again = lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])
            marked = F.transform(s, lambda x, k: F.when(again(x, k), x["i"]))
            return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

        def cover(p: Column) -> Column:
            return _total(F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))))

        return let(let(placed, places), cover)

    return let(words, of)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules look at, read off the whole text."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(whole, SPACE), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _total(F.transform(w, F.length)).alias("word_chars"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.size(F.filter(w, lambda x: x.endswith("."))).cast("long").alias("n_stops"),
            F.size(F.filter(w, lambda x: x.endswith("!"))).cast("long").alias("n_shouts"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )

    without = lambda pattern: F.length(F.regexp_replace(whole, pattern, ""))
    made = docs.withColumns(
        {
            "_w": let(words, of_words),
            "_l": let(lines, of_lines),
            "n_symbols": (F.length(whole) - without(SYMBOLS)).cast("long"),
            "n_capitals": (F.length(whole) - without(r"\p{Lu}+")).cast("long"),
        }
    )
    of = {c: F.col(f"_w.{c}") for c in ("n_words", "word_chars", "n_distinct", "n_stops", "n_shouts", "n_repeat_words")}
    of |= {c: F.col(f"_l.{c}") for c in ("n_lines", "n_dup_lines")}
    return made.withColumns(of).drop("_w", "_l")


def rules() -> dict[str, tuple[Column, Column]]:
    """For each rule when it votes bad and, otherwise, when it votes good; nulls and the rest are silence."""
    n = F.nullif(F.col("n_words"), F.lit(0))
    share = lambda c, of=n: F.col(c) / of
    lines, chars = F.nullif(F.col("n_lines"), F.lit(0)), F.nullif(F.col("word_chars"), F.lit(0))
    return {
        "word_length": ((share("word_chars") < 2) | (share("word_chars") > 13), share("word_chars").between(3, 10)),
        "symbols": (share("n_symbols") > 0.25, share("n_symbols") < 0.05),
        "capitals": (share("n_capitals", chars) > 0.35, share("n_capitals", chars) < 0.15),
        "shouting": (share("n_shouts") > 0.15, share("n_shouts") < 0.03),
        "sentences": (share("n_stops") < 0.01, share("n_stops").between(0.03, 0.35)),
        "repeated_lines": (share("n_dup_lines", lines) > 0.5, (F.col("n_lines") >= 2) & (F.col("n_dup_lines") == 0)),
        "repeated_words": (share("n_repeat_words") > 0.35, share("n_repeat_words") < 0.15),
        "variety": ((F.col("n_words") >= 50) & (share("n_distinct") < 0.15), share("n_distinct") > 0.25),
    }


def with_votes(counted: DataFrame) -> DataFrame:
    """Adds ``votes``: one of 1, -1 and 0 for each rule, in their order."""
    vote = [F.when(bad, BAD).when(good, GOOD).otherwise(SILENT) for bad, good in rules().values()]
    return counted.withColumn("votes", F.array(*[v.cast("int") for v in vote]))


@dataclass(frozen=True)
class Accuracies:
    """Share of good documents, and how often each rule that speaks is right on good and on bad ones."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def posterior(self, votes: Column) -> Column:
        """Probability of being good given the votes; rules count as independent within either kind."""
        both = list(zip(self.on_good, self.on_bad, strict=True))
        # literal arrays leave the generated code the same in every round
        heard = F.struct(
            F.array(*[F.lit(math.log(g / (1 - b))) for g, b in both]).alias("good"),
            F.array(*[F.lit(math.log((1 - g) / b)) for g, b in both]).alias("bad"),
        )
        weight = F.transform(
            votes,
            lambda v, k: F.when(v == GOOD, F.get(heard["good"], k)).when(v == BAD, F.get(heard["bad"], k)).otherwise(0.0),
        )
        prior = F.get(F.array(F.lit(math.log(self.prior / (1 - self.prior)))), F.lit(0))
        return 1 / (1 + F.exp(-F.aggregate(weight, prior, lambda a, x: a + x)))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> Accuracies:
    """Expectation-maximisation over ``patterns(votes, n)``.

    It starts from the belief that a bad vote makes a bad document nine times likelier, and holds every
    estimate inside (0, 1) by one imagined document of either outcome. Rules that look for unlike faults
    rarely agree, so the accuracy on good documents is held at ``1 - FALSE_ALARMS`` or more; otherwise the
    likeliest split of the patterns may set two faults against each other instead of good against bad.
    """
    k = len(rules())
    start = 0.9 * F.pow(F.lit(0.1), F.size(F.filter("votes", lambda v: v == BAD)))
    found = None
    for _ in range(rounds):
        belief = start if found is None else found.posterior(F.col("votes"))
        weighed = patterns.select((F.col("n") * belief).alias("good"), "n", F.posexplode("votes").alias("rule", "vote"))
        good, bad = F.col("good"), F.col("n") - F.col("good")
        sums = [F.sum(good).alias("good"), F.sum(bad).alias("bad")]
        for name, weight in (("good", good), ("bad", bad)):
            for kind, value in (("yes", GOOD), ("no", BAD)):
                sums.append(F.sum(F.when(F.col("vote") == value, weight).otherwise(0.0)).alias(f"{name}_{kind}"))
        heard = sorted(weighed.groupBy("rule").agg(*sums).collect(), key=lambda r: r["rule"])  # a row for each rule
        if not heard:
            return Accuracies(0.5, (0.5,) * k, (0.5,) * k)
        found = Accuracies(
            (heard[0]["good"] + 1) / (heard[0]["good"] + heard[0]["bad"] + 2),
            tuple(max(1 - FALSE_ALARMS, (r["good_yes"] + 1) / (r["good_yes"] + r["good_no"] + 2)) for r in heard),
            tuple((r["bad_no"] + 1) / (r["bad_yes"] + r["bad_no"] + 2) for r in heard),
        )
    return found


def judged(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the text, with counts, votes, ``base_failed``, ``posterior`` and ``kept``.

    The counts are written once; estimation and verdict read them back.
    """
    counted = written(with_votes(with_counts(docs, text)).drop(text), "votes")
    patterns = written(counted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).coalesce(1), "patterns")
    found = estimate(patterns)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        counted.withColumn("base_failed", base)
        .withColumn("posterior", found.posterior(F.col("votes")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )
