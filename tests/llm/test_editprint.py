"""Fingerprints agree with walks made letter by letter, and the query with plain Python over the whole table."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from obsload.llm import editprint
from obsload.llm.queries import op13_editprint
from obsload.llm.registry import table


def walked(text):
    """The fingerprint by its definition: one letter after the other."""
    steps = editprint.sampled_steps(3 * len(text))[0].tolist()
    bits, digits = editprint.moves(), []
    kind = lambda c: (ord(c) * 0x9E3779B1 % 2**32) >> 24
    for at in range(0, len(text), editprint.BLOCK):
        end, here = min(len(text), at + editprint.BLOCK), at
        base = at // editprint.BLOCK * editprint.WALK
        for j in range(3 * (end - at)):
            if base + j in steps:
                gram = np.zeros(1, np.uint64)
                for k in range(editprint.GRAM):
                    gram = editprint._scrambled(gram + np.uint64(ord(text[here + k]) if here + k < len(text) else 0))
                digits.append("-" if here >= end else "0123456789abcdef"[int(gram[0]) >> 60])
            if here < end:
                here += int(bits[j, kind(text[here])])
    return f"{len(text):x}:" + "".join(digits).rstrip("-")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab é日🙂\n")), max_size=40), max_size=6))
def test_fingerprints_follow_the_walk(texts):
    assert editprint.fingerprints(texts) == [walked(t) for t in texts]


def test_long_texts_follow_the_walk():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdefgh "), n)) for n in (4095, 4096, 4097, 13000, 1)]
    assert editprint.fingerprints(texts) == [walked(t) for t in texts]
    assert editprint._in_chunks(texts * 2) == editprint.fingerprints(texts) * 2


def test_sampled_steps_are_shared_and_stand_for_all():
    long, _ = editprint.sampled_steps(100_000)
    short, _ = editprint.sampled_steps(777)
    assert (np.diff(long) > 0).all() and np.array_equal(long[: len(short)], short)
    whole, weights = editprint.sampled_steps(2**17 - 1)
    assert weights.sum() == 2**17 - 1 and np.array_equal(whole[: len(long)], long)


def test_likeness_falls_with_edits():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("etaoin srhl"), 3000)) for _ in range(50)]
    one = editprint.fingerprints(texts)
    assert (editprint.likeness(one, one) == 1).all()
    means = []
    for k in (1, 20, 200):
        changed = []
        for t in texts:
            letters = list(t)
            for i in rng.integers(0, len(t), k):
                letters[i : i + 1] = rng.choice(list("xyz"), rng.integers(0, 3)).tolist()
            changed.append("".join(letters))
        means.append(editprint.likeness(one, editprint.fingerprints(changed)).mean())
    assert means[0] > 0.85 and means[0] > means[1] > means[2]
    half = editprint.fingerprints([editprint.edited(a, b) for a, b in zip(texts, texts[1:] + texts[:1], strict=True)])
    assert 0.4 < editprint.likeness(one, half).min() and editprint.likeness(one, half).max() < 0.65
    assert editprint.likeness(one, one[1:] + one[:1]).max() < 0.1


def test_likeness_of_odd_fingerprints():
    empty, letter, other, long = editprint.fingerprints(["", "a", "b", "a" * 9000])
    pairs = [(empty, empty), (empty, letter), (letter, empty), (letter, letter), (letter, other), (long, long), (empty, long)]
    found = editprint.likeness(*zip(*pairs, strict=True)).tolist()
    assert found == [1, 0, 0, 1, 0, 1, 0] and empty == "0:"
    assert editprint.likeness([], []).tolist() == [] and editprint.fingerprints([]) == []


def expected(rows):
    """Results by id for rows in order."""
    out = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        a, b = text or "", following or ""
        half = len(a) // 2
        new = a[: len(a) - half] + b[:half]
        prints = editprint.fingerprints([a, new, b])
        near = editprint.likeness([prints[0]] * 2, prints[1:])
        out.append((doc_id, len(a), hashlib.sha256(new.encode()).hexdigest(), *prints[:2], *near.tolist()))
    return out


def result(df):
    return [tuple(r[c] for c in ["doc_id", *editprint.RESULTS]) for r in df.collect()]


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = sorted((r["doc_id"], r["text"]) for r in table(spark, folder, "documents").collect())
    found = sorted(result(op13_editprint(spark, folder)))
    assert found == sorted(expected(rows))
    assert np.mean([r[5] for r in found]) > 0.35 > 0.1 > np.mean([r[6] for r in found])


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_meet_at_their_ends(spark, parts):
    rows = [(i * 3, f"text number {i} " * (i % 11)) for i in range(60)]
    docs = spark.createDataFrame([(*r, "x") for r in rows[::-1]], "doc_id long, text string, part string")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert sorted(result(editprint.with_next(docs))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_nulls_repeats_single_and_no_rows(spark):
    schema = "doc_id string, text string"
    one = spark.createDataFrame([("a", "some text")], schema)
    assert result(editprint.with_next(one)) == expected([("a", "some text")])
    assert result(editprint.with_next(one.limit(0))) == []
    rows = [(None, "first"), ("a", None), ("b", "twice the same"), ("b", "twice the same"), ("c", "")]
    assert sorted(result(editprint.with_next(spark.createDataFrame(rows, schema))), key=repr) == sorted(expected(rows), key=repr)


def test_fingerprint_column(spark):
    docs = spark.createDataFrame([(1, "a b", "old"), (2, None, None)], "doc_id long, text string, fingerprint string")
    out = editprint.with_fingerprint(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["fingerprint"] for r in out.collect()} == {1: walked("a b"), 2: "0:"}
