"""Stand-ins: nothing of the originals left, formats, gender, script, coreference and distinctness."""

import re

import pytest
from pyspark.sql import functions as F

from obsload.llm import surrogates
from obsload.llm.queries import op9_surrogates

FOLDER = "/root/testdata/sf0.001"


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0


@pytest.fixture(scope="module")
def texts(spark):
    rows = [
        (1, "Write to tom.b@mail7.example.com, TOM.B@MAIL7.EXAMPLE.COM or jo@x.example.org."),
        (2, "Cards 4111 1111 1111 1111, 4111111111111111 and 5500-0000-0000-0004."),
        (3, "Hosts 10.20.30.40 and 233.1.2.3!! Call +1 (743) 555-3824 or 123-45-6789."),
        (4, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###'),
        (5, "Mrs Karen Walsh met Mr. Walsh, Anna Krause and ANNA KRAUSE. Госпожа Мария Орлова."),
        (6, "Nothing to see at 12:30, in 2024, on page 7 of 10."),
        (7, None),
        (8, ""),
        (None, "Mrs Karen Walsh"),
        (1, "tom.b@mail7.example.com"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("kind", F.lit("k"))
    out = surrogates.with_surrogates(docs)
    assert out.columns == docs.columns
    assert surrogates.with_surrogates(docs.limit(0)).count() == 0
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    return got


def test_addresses(texts):
    (a,) = re.findall(r"to (\S+), (\S+) or (\S+)\.$", next(t for t in texts[1] if t.startswith("Write")))
    assert a[0].upper() == a[1] and a[0] in texts[1] and a[0] != a[2]
    assert re.fullmatch(r"[a-z]{3}\.[a-z]@[a-z]{4}\d\.[a-z]{7}\.com", a[0]) and "tom" not in a[0]


def test_numbers(texts):
    a, b, c = re.search(r"Cards (.+), (\d+) and (.+)\.", texts[2][0]).groups()
    assert a.replace(" ", "") == b != "4111111111111111" and luhn(b) and luhn(c.replace("-", ""))
    assert re.fullmatch(r"\d{4}( \d{4}){3}", a) and re.fullmatch(r"\d{4}(-\d{4}){3}", c)
    hosts = re.findall(r"(?:\d{1,3}\.){3}\d{1,3}", texts[3][0])
    assert len(set(hosts)) == 2 and all(0 < int(x) < 256 for h in hosts for x in h.split("."))
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{2}-\d{4}\.$", texts[3][0])
    assert "555-3824" not in texts[3][0] and "123-45-6789" not in texts[3][0]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"###', texts[4][0]) and "24be6443" not in texts[4][0]


def test_names(texts):
    woman, surname, man, one, two, other, shouted, russian, russian_last = re.fullmatch(
        r"Mrs (\S+) (\S+) met Mr\. (\S+), ((\S+) (\S+)) and (.+)\. Госпожа (\S+) (\S+)\.", texts[5][0]
    ).groups()
    names = {g: set(n.split()) for g, n in surrogates.GIVEN.items()}
    assert set(woman.split("-")) <= names["f"] and surname == man != "Walsh" and set(two.split("-")) <= names["f"]
    assert shouted == one.upper() and other != surname
    assert set(russian.split("-")) <= names["cf"] and re.fullmatch("[а-яА-Я]+", russian_last)
    assert texts[None][0] == f"Mrs {woman} {surname}"


def test_others_stay(texts):
    assert texts[6] == ["Nothing to see at 12:30, in 2024, on page 7 of 10."]
    assert texts[7] == [None] and texts[8] == [""]


def test_collisions_move_on(spark):
    """More women than single given names: all keep a name of their own, none an original's."""
    firsts = surrogates.GIVEN["f"].split()
    docs = spark.createDataFrame([(i, f"Mrs {n} Walsh") for i, n in enumerate(firsts)], "doc_id long, text string")
    later = surrogates.beyond_first(docs)
    assert later.count() > 0
    found = [r["text"].split(" ")[1] for r in surrogates.with_surrogates(docs).collect()]
    assert len(set(found)) == len(firsts) and not set(found) & set(firsts)


def test_query_leaves_no_original_and_no_change_elsewhere(spark):
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    pattern = re.compile(r"[\w.]+@[\w.]+\w|\b\d{16}\b|\b(?:\d{1,3}\.){3}\d{1,3}\b|\b[0-9a-f]{40}\b|\+1 \(\d{3}\) \d{3}-\d{4}")
    hit = 0
    rows = op9_surrogates(spark, FOLDER).collect()
    assert len(rows) == len(before)
    for r in rows:
        old = before[r["doc_id"]]
        found = pattern.findall(old)
        hit += len(found)
        assert r["n_entities"] >= len(found)
        assert not any(x in r["text"] for x in found)
        if not r["n_entities"]:
            assert r["text"] == old
    assert hit > 5


def test_numbers_of_any_grouping_long_secrets_and_addresses_of_six_bytes(spark):
    numbers = [
        "06 12 34 56 78", "+33 6 12 34 56 78", "030 1234567", "+49 30 1234567", "+34 912 34 56 78", "+49 (30) 123-4567", "0612345678",
        "2001:db8::1", "fe80::1ff:fe23:4567:890a", "2001:0db8:85a3:0000:0000:8a2e:0370:7334",
    ]
    long = "aB3" + "x7Yz" * 150
    clean = [
        "On 01-02-2021 and 01.02.2021 12:30, page 0.1234567890 of 10", "std::vec a::b 12:30:45", "order 00123 and 1,012,345,678 seen",
        "x" * 3000,
    ]
    rows = [(i, f"Say {t}, please") for i, t in enumerate([*numbers, long])] + [(100 + i, t) for i, t in enumerate(clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["text"] for r in surrogates.with_surrogates(docs).collect()}
    shape = lambda t: re.sub("[0-9a-f]", "9", t.lower())
    for i, t in enumerate(numbers):
        assert t not in got[i] and got[i].startswith("Say ") and got[i].endswith(", please"), t
        assert shape(got[i][4:-8]) == shape(t)
    made = got[len(numbers)][4:-8]
    # no stretch of the original is left, its end included
    assert len(made) == len(long) and all(long[k : k + 12] not in made for k in range(0, len(long) - 12, 12)) and made[-8:] != long[-8:]
    assert [got[100 + i] for i in range(len(clean))] == clean
