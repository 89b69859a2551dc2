"""Personal data replaced by keyed surrogates of the same type and format.

One pattern finds all kinds of entity. Each is reduced to a canonical form (digits of a card whatever its
spacing, lower case of an address, the parts of a name), and a keyed digest of type and form picks the
stand-in: digits for digits, letters of the same case for letters, octets in range for an address of the
network, a valid check digit where the original had one, given names of the same gender and script, made-up
surnames of the same script. The same entity gets the same stand-in in all documents, whatever its spelling.

Stand-ins are checked over the distinct entities of all documents, a table far smaller than the texts: two
entities must not share one, and none may equal an original. What collides moves on to its next attempt,
until nothing collides. Only the few entities beyond attempt zero travel to the documents that hold them;
all other replacements are column expressions over the row. No Python runs on rows.

Odd input: a null text stays null, an empty one empty, and texts without an entity stay as they are. Rows
repeated or without id are replaced alike. Very long texts are searched whole; of entities that collide the first in order
of hash keeps its stand-in. An empty table gives an empty one. Extra columns pass untouched, but for the one named to
hold the count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsload.functions.binding import let
from obsload.llm.names import free
from obsload.workspace import small_enough, written

KEY = "surrogates"
ROUNDS = 40

# fixed values: given names by gender and script, and forms of address
GIVEN = {
    "f": "Anna Maria Laura Julia Sophie Claire Elena Emma Lucie Carmen Helen Alice Clara Nina Paula Ines Marta Irene "
    "Ruth Sarah Mary Linda Karen Susan Greta Heidi Monique Camille Isabel Rosa Teresa Lucia Ursula Petra Birgit",
    "m": "Peter Thomas Daniel Martin Paul David Simon Victor Felix Hugo Oscar Robert Henri Louis Pierre Antoine Carlos "
    "Miguel Javier Pablo Diego Hans Karl Otto Stefan Jürgen James John William George Edward Frank Bruno Jean Manuel",
    "cf": "Анна Мария Елена Ольга Ирина Наталья Светлана Татьяна Людмила Вера Надежда Юлия",
    "cm": "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Павел Виктор Юрий Борис",
}
ADDRESS = {
    "f": "Mrs Ms Miss Madame Mme Frau Señora Sra Doña Г-жа Госпожа",
    "m": "Mr Monsieur Herr Señor Sr Don Г-н Господин",
    "n": "Dr Prof Professor",
}
SYLLABLES = "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo"
CYRILLIC_SYLLABLES = "ба бе бо ва ве во га го да де до ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то"



def _by_first_letter(words: list[str]) -> str:
    """An alternation that looks at the first letter once, not once for each word."""
    ends: dict[str, list[str]] = {}
    for w in dict.fromkeys(words):
        ends.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(ends.items())) + ")"


_GIVEN = _by_first_letter([x for names in GIVEN.values() for n in names.split() for x in (n, n.upper())])
_ADDRESS = _by_first_letter([n for names in ADDRESS.values() for n in names.split()])
_NAME = r"\p{Lu}\p{L}{1,40}+(?:-\p{Lu}\p{L}{1,40}+)?"
_WORD = r"(?=\p{Lu})(?<![\p{L}\p{N}_])"
#: kinds in the order in which they are tried at a place
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{24,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9+])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4})?(?![0-9])"
    # by the number of digits, however they are grouped: international, in pairs, area code and number
    r"|(?<![0-9])\+[0-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9])|(?<![0-9.,+-])(?![0-9]{2}[ .-][0-9]{2}[ .-][0-9]{4})"
    r"0[1-9](?:[ .-]?[0-9]{2}){4}(?![0-9])"
    r"|(?<![0-9.,+-])0[1-9][0-9]{1,3}[ /-]?[0-9]{5,8}(?![0-9])",
    "name": rf"{_WORD}(?:{_ADDRESS}\.? {_NAME}(?: {_NAME})?|{_GIVEN} {_NAME})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: what every entity holds; a text without it is not searched further
SIGN = rf"[0-9@]|{_WORD}(?:{_ADDRESS}|{_GIVEN})\.? "


def _pick(words: str, number: Column) -> Column:
    listed = words.split()
    return F.get(F.array(*map(F.lit, listed)), F.pmod(number, F.lit(len(listed))))


def _one_of(words: str) -> Column:
    return F.array(*map(F.lit, words.split()))


def entities(text: Column) -> Column:
    """All entities of a text in order; each kind holds a digit, an at sign or a known name."""
    return F.when(text.rlike(SIGN), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(entity: Column) -> Column:
    out = F.when(entity.rlike(f"^(?:{PATTERNS['email']})$"), "email")
    for kind in list(PATTERNS)[1:]:
        out = out.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    return out.otherwise("secret")


def _name_parts(entity: Column) -> Column:
    """Parts of a name as ``(kind, form, original)``; a form of address is its own stand-in."""
    words = F.split(entity, " ")

    def parts(w: Column) -> Column:
        first = F.regexp_replace(F.get(w, F.lit(0)), r"\.$", "")
        address = {g: F.array_contains(_one_of(ADDRESS[g]), first) for g in ADDRESS}
        addressed = address["f"] | address["m"] | address["n"]
        given_at = F.when(addressed & (F.size(w) == 3), 1).when(~addressed, 0).otherwise(-1)
        given = F.get(w, F.greatest(given_at, F.lit(0)))
        female = address["f"] | F.array_contains(_one_of(f"{GIVEN['f']} {GIVEN['cf']}".upper()), F.upper(given))
        script = F.when(F.get(w, F.size(w) - 1).rlike(r"\p{IsCyrillic}"), "c").otherwise("")
        gender = F.when(female & ~address["m"], "f").otherwise("m")

        def part(x: Column, i: Column) -> Column:
            kind = (
                F.when((i == 0) & addressed, "address")
                .when(i == given_at, F.concat(F.lit("given_"), script, gender))
                .otherwise(F.concat(F.lit("surname_"), script))
            )
            return F.struct(kind.alias("kind"), F.lower(x).alias("form"), x.alias("original"))

        return F.transform(w, part)

    return let(words, parts)


def parts_of(entity: Column) -> Column:
    """The parts of an entity that get stand-ins: ``array<struct<kind, form, original>>``."""

    def of(e: Column) -> Column:
        kind = kind_of(e)
        form = (
            F.when(kind == "email", F.lower(e))
            .when(kind.isin("card", "phone", "ssn"), F.regexp_replace(e, "[^0-9]", ""))
            .when(kind == "iban", F.regexp_replace(e, " ", ""))
            .otherwise(e)
        )
        whole = F.array(F.struct(kind.alias("kind"), form.alias("form"), e.alias("original")))
        return F.when(kind == "name", _name_parts(e)).otherwise(whole)

    return let(entity, of)


def _bytes(*parts: Column) -> Column:
    """64 numbers under 256 of the keyed digest of the parts."""
    digest = F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(str(half)), *parts), 256) for half in (0, 1)])
    return let(
        digest,
        lambda d: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substr(d, 2 * i + 1, F.lit(2)), 16, 10).cast("int")),
    )


def _letters(form: Column, numbers: Column, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """Each digit by a digit and each letter by a letter of its case; other characters stay."""

    def one(c: Column, i: Column) -> Column:
        n = F.get(numbers, F.pmod(i, F.lit(64))) + F.pmod(F.floor(i / 64), F.lit(7)).cast("int")
        letter = F.substr(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))
        return (
            F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string"))
            .when(c.rlike("[A-Z]"), F.upper(letter))
            .when(c.rlike("[a-z]"), letter)
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(form, ""), one), "")


def _check_sum(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled, modulo ten."""

    def weighed(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(F.pmod(i, F.lit(2)) == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.pmod(F.aggregate(F.transform(F.split(F.reverse(digits), ""), weighed), F.lit(0), lambda a, x: a + x), F.lit(10))


def stand_in(kind: Column, form: Column, attempt: Column, key: str = KEY) -> Column:
    """Canonical form of the stand-in for an entity part."""

    def made(numbers: Column) -> Column:
        at = lambda i: F.get(numbers, F.lit(i))
        plain = _letters(form, numbers)
        last = F.right(form, F.lit(1))
        head = F.concat(F.left(form, F.lit(1)), F.substr(plain, F.lit(2), F.length(form) - 2))
        checked = F.concat(head, F.pmod(-_check_sum(F.concat(head, F.lit("0"))), F.lit(10)).cast("string"))
        card = F.when(_check_sum(form) == 0, checked).otherwise(F.concat(head, F.substr(plain, F.length(form), F.lit(1))))
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (1 + F.pmod(F.get(numbers, i), F.lit(254))).cast("string")), ".")
        top = F.regexp_extract(form, r"(\.[a-z0-9-]+)$", 1)
        email = F.concat(F.substr(plain, F.lit(1), F.length(form) - F.length(top)), top)
        iban = F.concat(F.left(form, F.lit(2)), F.substr(plain, F.lit(3), F.length(form)))
        hexes = F.when(form.rlike("^[0-9a-f]+$"), _letters(form, numbers, "abcdef")).otherwise(plain)
        # a further attempt joins one more given name, or adds a syllable
        def joined(words: str, upto: Column, first: int, by: str) -> Column:
            number = lambda i: F.get(numbers, F.pmod(i + first, F.lit(64)))
            return F.array_join(F.transform(F.sequence(F.lit(0), upto), lambda i: _pick(words, number(i))), by)

        given = {g: joined(names, attempt, 0, "-") for g, names in GIVEN.items()}
        surname = {s: joined(said, attempt + 2, 8, "") for s, said in (("", SYLLABLES), ("c", CYRILLIC_SYLLABLES))}
        out = F.when(kind == "card", card).when(kind == "ip", octets).when(kind == "email", email).when(kind == "iban", iban)
        out = out.when(kind == "ip6", _letters(F.lower(form), numbers, "abcdef")).when(kind == "secret", hexes).when(kind == "address", form)
        for g, name in given.items():
            out = out.when(kind == f"given_{g}", F.lower(name))
        for s, name in surname.items():
            out = out.when(kind == f"surname_{s}", name)
        # the first digit of a number of the telephone may be a country's
        phone = F.concat(F.left(form, F.lit(1)), F.substr(plain, F.lit(2), F.length(form)))
        return out.when(kind == "phone", phone).otherwise(plain)

    return let(_bytes(F.lit(key), kind, form, attempt.cast("string")), made)


def dressed(kind: Column, original: Column, stand: Column) -> Column:
    """A canonical stand-in in the format of the original: its punctuation and spacing, or its case."""

    def spaced(pattern: str) -> Column:
        def one(c: Column, i: Column) -> Column:
            nth = F.length(F.regexp_replace(F.substr(original, F.lit(1), i + 1), f"[^{pattern}]", ""))
            return F.when(c.rlike(f"[{pattern}]"), F.substr(stand, nth, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.split(original, ""), one), "")

    named = F.when((original == F.upper(original)) & (F.length(original) > 1), F.upper(stand)).otherwise(
        F.array_join(F.transform(F.split(stand, "-"), lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2), F.length(x)))), "-")
    )
    return (
        F.when(kind == "address", original)
        .when(kind.startswith("given_") | kind.startswith("surname_"), named)
        .when(kind.isin("card", "phone", "ssn"), spaced("0-9"))
        .when(kind == "iban", spaced("A-Z0-9"))
        .when((kind == "email") & (original == F.upper(original)), F.upper(stand))
        .otherwise(stand)
    )


def beyond_first(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``(kind, form, attempt)`` of the entity parts of all texts that need a later attempt than the first.

    Parts are distinct here, so groups are as small as accidents are. Stand-ins that have been given stay.
    """
    found = docs.select(F.explode(entities(F.col(text).cast("string"))).alias("entity"))
    # equal entities meet before they are taken apart
    split = found.distinct().select(F.explode(parts_of(F.col("entity"))).alias("p"))
    parts = written(split.where("p.kind != 'address'").select("p.kind", "p.form").distinct(), "entities")
    open_ = parts.withColumn("attempt", F.lit(0))
    given = later = None
    for _ in range(ROUNDS):
        tried = open_.withColumn("stand", stand_in(F.col("kind"), F.col("form"), F.col("attempt"), key))
        same = tried.groupBy("kind", "stand").agg(F.min(F.struct(F.xxhash64("form"), "form"))["form"].alias("form"))
        same = same.join(parts.select("kind", F.col("form").alias("stand")), ["kind", "stand"], "left_anti")
        if given is not None:
            same = same.join(given.select("kind", "stand"), ["kind", "stand"], "left_anti")
        settled = written(same.join(open_, ["kind", "form"]), "settled")
        given = settled if given is None else given.unionByName(settled)
        open_ = written(open_.join(settled, ["kind", "form"], "left_anti").withColumn("attempt", F.col("attempt") + 1), "open")
        moved = settled.where("attempt > 0").select("kind", "form", "attempt")
        later = moved if later is None else later.unionByName(moved)
        if open_.isEmpty():
            return later
    raise RuntimeError("a kind of entity has fewer stand-ins than the documents have entities of it")


def _replaced(text: Column, attempts: Column, key: str) -> Column:
    """``struct<text, n>``: a text with stand-ins and how many entities it held.

    ``attempts`` maps ``kind`` and ``form`` of parts to their attempt, zero if absent.
    """

    def one(part: Column) -> Column:
        attempt = F.coalesce(F.try_element_at(attempts, F.concat_ws("\x1f", part["kind"], part["form"])), F.lit(0))
        return dressed(part["kind"], part["original"], stand_in(part["kind"], part["form"], attempt, key))

    def woven(found: Column) -> Column:
        stands = F.transform(found, lambda e: F.array_join(F.transform(parts_of(e), one), " "))
        both = F.zip_with(F.split(text, ANY, -1), stands, lambda b, s: F.concat(b, F.coalesce(s, F.lit(""))))
        out = F.when(F.size(found) > 0, F.array_join(both, "")).otherwise(text)
        return F.struct(out.alias("text"), F.size(found).cast("long").alias("n"))

    return let(entities(text), woven)


def with_surrogates(docs: DataFrame, text: str = "text", key: str = KEY, count: str | None = None) -> DataFrame:
    """``docs`` with personal data in the text column replaced; rows and other columns stay as they are.

    ``count`` names a column to add, with the number of entities found.
    """
    said = F.col(text).cast("string")
    row_key, tries, replaced = free(docs, "_row_key", "_attempts", "_replaced")
    later = written(beyond_first(docs, text, key), "later")
    attempts = F.lit(None).cast("map<string,int>")
    rows = docs
    if not later.isEmpty():
        found = docs.select(
            F.xxhash64(said).alias("row_key"), F.explode(entities(said)).alias("entity")
        )
        parts = found.distinct().select("row_key", F.explode(parts_of(F.col("entity"))).alias("p"))
        hit = parts.select("row_key", "p.kind", "p.form").distinct().join(later, ["kind", "form"])
        entry = F.struct(F.concat_ws("\x1f", "kind", "form"), "attempt")
        per_text = hit.groupBy(F.col("row_key").alias(row_key)).agg(F.map_from_entries(F.collect_set(entry)).alias(tries))
        per_text = written(per_text, "attempts")
        if small_enough(per_text, 100_000, 16 << 20):
            per_text = F.broadcast(per_text)
        rows, attempts = docs.join(per_text, F.xxhash64(said) == F.col(row_key), "left"), F.col(tries)
    out = rows.withColumn(replaced, _replaced(said, attempts, key))
    columns = [F.col(f"{replaced}.text").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c != count]
    return out.select(*columns, *([F.col(f"{replaced}.n").alias(count)] if count else []))
