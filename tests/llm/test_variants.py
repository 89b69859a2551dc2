"""Words, near words and forms agree with plain Python over every pair."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from obsload.llm import variants
from obsload.llm.queries import op12_variants
from obsload.llm.registry import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def around(word, letters):
    gone = {word[:i] + word[i + 1 :] for i in range(len(word))}
    put = {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    swapped = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return (gone | put | swapped) - {word}


def expected(docs):
    n = counted(docs)
    letters = sorted({c for w in n for c in w})
    near = {w: [v for v in around(w, letters) if v in n] for w in n}
    form = {}
    for w, some in near.items():
        top = min(some, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def result(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").collect()]
    found = result(op12_variants(spark, folder))
    assert found == expected(docs) and any(r[1] for r in found) and len(found) > 500


def made_documents():
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abceéÿ"), rng.integers(6, 11))) for _ in range(60)]
    docs = []
    for i in range(400):
        words = [base[min(59, rng.geometric(0.1) - 1)] for _ in range(30)]
        docs.append((i, " ".join(w[:3] + "x" + w[3:] if rng.random() < 0.05 else w for w in words)))
    return docs


@pytest.mark.parametrize("tile, chunk", [(2048, 512), (5, 3)])
def test_tiles_and_chunks_change_nothing(spark, monkeypatch, tile, chunk):
    monkeypatch.setattr(variants, "TILE", tile)
    monkeypatch.setattr(variants, "CHUNK", chunk)
    docs = made_documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert result(variants.variants(df)) == expected(docs)


def test_chains_are_followed_to_the_end(spark):
    words = {"aaaaaaaaa": 2, "aaaaaaaab": 20, "aaaaaaabb": 200, "aaaaaabbb": 2000, "zzzzzzzz": 3}
    df = spark.createDataFrame([("aaaaaaaaa", "aaaaaaaab"), ("aaaaaaaab", "aaaaaaabb"), ("aaaaaaabb", "aaaaaabbb")], "word string, form string")
    assert {r["word"]: r["root"] for r in variants.roots(df).collect()} == dict.fromkeys(list(words)[:3], "aaaaaabbb")
    counts = spark.createDataFrame(list(words.items()), "word string, n long")
    found = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in variants.near_words(counts).collect()}
    assert found["aaaaaaaab"] == (2, "aaaaaaabb", 200) and "zzzzzzzz" not in found


def test_odd_texts(spark):
    long = "q" * 5000
    rows = [
        (1, None, "x"), (2, "", "y"), (None, f"{long} {long} {long}w {long}w", None), (3, "ABCDEFG abcdefg ÀBCDEFG àbcdefg", "z"),
        (3, "ABCDEFG abcdefg ÀBCDEFG àbcdefg", "z"), (4, "abcdefg1abcdefg_abcdefgh abcdefgh abcdef abcdef", "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    assert result(variants.variants(docs)) == expected([r[:2] for r in rows])
    assert result(variants.variants(docs.limit(0))) == []
    assert result(variants.variants(docs.where("doc_id = 1"))) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=9), min_size=2, max_size=12, unique=True), st.integers(0, 80))
def test_edits_of_pairs(words, padding):
    words = [w + "z" * padding for w in words]  # beyond LONG the pairs are verified one by one
    a, b = np.array([(i, j) for i, u in enumerate(words) for j, v in enumerate(words) if 0 <= len(v) - len(u) <= 1]).T
    near, same = variants.edits(words, a, b)
    for i, j, hit, start in zip(a, b, near, same, strict=True):
        u, v = words[i], words[j]
        one = u != v and (sum(x != y for x, y in zip(u, v, strict=True)) == 1 if len(u) == len(v) else any(v[:k] + v[k + 1 :] == u for k in range(len(v))))
        assert hit == one == variants.one_edit(u, v)[0]
        assert start == variants.one_edit(u, v)[1]
