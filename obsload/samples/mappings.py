"""Value mapping, vocabulary rules, suggestions, and the algebra and validation of mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsload.model.dictionary import Field
from obsload.operators import mapping as map_ops
from obsload.operators import metadata as meta
from obsload.operators import vocabulary as vocab_ops
from obsload.operators.listing import orphans
from obsload.samples.registry import case, query, table, text

PRIORITY = Field("priority", "t", 1, "integer", vocab="PRIO")
SEGMENT = Field("segment", "t", 2, "integer", vocab="SEG")

# vocabularies as the tables hold them: priorities of orders and segments of customers
_TERMS_SQL = """SELECT 'PRIO' AS vocab, substr(o_orderpriority, 1, 1) AS code,
  o_orderpriority AS label, 10 * CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS id,
  o_orderpriority = '5-LOW' AS is_default FROM (SELECT DISTINCT o_orderpriority FROM orders)
UNION ALL SELECT 'SEG', substr(c_mktsegment, 1, 3), c_mktsegment,
  100 + length(c_mktsegment), c_mktsegment = 'HOUSEHOLD' FROM (SELECT DISTINCT c_mktsegment FROM customer)"""


def terms(spark, folder):
    priorities = table(spark, folder, "orders").select("o_orderpriority").distinct()
    digit = F.substring("o_orderpriority", 1, 1)
    first = priorities.select(
        F.lit("PRIO").alias("vocab"),
        digit.alias("code"),
        F.col("o_orderpriority").alias("label"),
        (digit.cast("int") * 10).alias("id"),
        (F.col("o_orderpriority") == "5-LOW").alias("is_default"),
    )
    segments = table(spark, folder, "customer").select("c_mktsegment").distinct()
    second = segments.select(
        F.lit("SEG").alias("vocab"),
        F.substring("c_mktsegment", 1, 3).alias("code"),
        F.col("c_mktsegment").alias("label"),
        (F.char_length("c_mktsegment") + 100).alias("id"),
        (F.col("c_mktsegment") == "HOUSEHOLD").alias("is_default"),
    )
    return first.unionByName(second)


CONTENT = {
    "PRIO": {"1-URGENT": "1", "2-HIGH": "2", "3-MEDIUM": "3", "": "4", "4-NOT SPECIFIED": "Z"},
    "SEG": {"HOUSEHOLD": "HOU", "MACHINERY": "MAC", "BUILDING": "BUI"},
}
_CONTENT_SQL = ", ".join(
    f"('{v}', '{value}', '{code}')" for v, codes in CONTENT.items() for value, code in codes.items()
)
_MAPPED = f"""WITH terms AS ({_TERMS_SQL}), m(vocab, value, code) AS (VALUES {_CONTENT_SQL}),
vt AS (SELECT m.vocab, m.value, t.id FROM m JOIN terms t ON t.vocab = m.vocab AND t.code = m.code)"""


@query(
    "value_mapping",
    f"""{_MAPPED} SELECT o_orderkey, CAST(id AS VARCHAR) AS term,
  CASE WHEN id IS NULL THEN 'INVALID_NOMENCLATURE' END AS code
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE o_orderpriority END AS v FROM orders)
LEFT JOIN vt ON vt.vocab = 'PRIO' AND vt.value = v""",
)
def value_mapping(spark, folder):
    key = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        key, F.when(key % 6 != 0, F.col("o_orderpriority")).alias("src_priority")
    )
    mapped = vocab_ops.map_values(rows, [PRIORITY], CONTENT, terms(spark, folder), key)
    check = vocab_ops.unknown_value_checks([PRIORITY], str)[0]
    return mapped.select(
        key, text("priority").alias("term"), F.when(check.condition, check.code).alias("code")
    )


@query(
    "value_mapping_join",
    f"""{_MAPPED} SELECT o_orderkey, CAST(id AS VARCHAR) AS term
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE o_orderpriority END AS v FROM orders)
LEFT JOIN vt ON vt.vocab = 'PRIO' AND vt.value = v""",
)
def value_mapping_join(spark, folder):
    """The same mapping through the keyed look-up used for vocabularies of any size."""
    key = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        key, F.when(key % 6 != 0, F.col("o_orderpriority")).alias("src_priority")
    )
    known = vocab_ops.value_terms(vocab_ops.mapping_rows(spark, CONTENT), terms(spark, folder))
    mapped = vocab_ops.mapped_by_join(rows, PRIORITY, known, key)
    return mapped.select(key, text("priority").alias("term"))


@query(
    "value_mapping_repeated_code",
    f"""{_MAPPED} SELECT way, o_orderkey, CAST(id AS VARCHAR) AS term
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE o_orderpriority END AS v FROM orders)
CROSS JOIN (SELECT unnest(['broadcast', 'keyed']) AS way) LEFT JOIN vt ON vt.vocab = 'PRIO' AND vt.value = v""",
)
def value_mapping_repeated_code(spark, folder):
    """A second term on every code: the lowest counts, no row doubles, whichever way the join goes."""
    key = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        key, F.when(key % 6 != 0, F.col("o_orderpriority")).alias("src_priority")
    )
    twice = terms(spark, folder)
    twice = twice.unionByName(twice.withColumn("id", F.col("id") + 1))

    def mapped(way: str, limit: int):
        found = vocab_ops.map_values(rows, [PRIORITY], CONTENT, twice, key, broadcast_rows=limit)
        return found.select(F.lit(way).alias("way"), key, text("priority").alias("term"))

    return mapped("broadcast", 1000).unionByName(mapped("keyed", 0))


@query(
    "mapping_defaults",
    f"""{_MAPPED}, c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS v
  FROM customer), d AS (SELECT id FROM terms WHERE vocab = 'SEG' AND is_default)
SELECT c_custkey, CAST(coalesce(vt.id, CASE WHEN v = '' THEN (SELECT id FROM d) END) AS VARCHAR) AS term,
  CAST(vt.id AS VARCHAR) AS without_default,
  (SELECT CAST(id AS VARCHAR) FROM terms WHERE vocab = 'PRIO' AND is_default) AS unmapped,
  vt.id IS NULL AND v <> '' AS unknown
FROM c LEFT JOIN vt ON vt.vocab = 'SEG' AND vt.value = v""",
)
def mapping_defaults(spark, folder):
    key = F.col("c_custkey")
    vocabulary = terms(spark, folder)
    rows = table(spark, folder, "customer").select(
        key, F.when(key % 5 != 0, F.col("c_mktsegment")).alias("src_segment")
    )
    mapped = vocab_ops.map_values(rows, [SEGMENT], CONTENT, vocabulary, key)
    defaults = vocab_ops.default_terms(vocabulary, ["PRIO", "SEG"])
    kept = mapped.withColumn("without_default", text("segment"))
    filled = vocab_ops.fill_defaults(kept, [PRIORITY, SEGMENT], {"segment"}, defaults, True)
    return filled.select(
        key,
        text("segment").alias("term"),
        "without_default",
        text("priority").alias("unmapped"),
        F.col("segment").isNull().alias("unknown"),
    )


@query(
    "paired_fields",
    """WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS st,
  CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN NULL ELSE 'x' END AS p1,
  CASE WHEN o_orderkey % 4 = 0 THEN 'y' END AS p2 FROM orders)
SELECT o_orderkey, coalesce((st = 1 AND NOT (coalesce(p1, '') <> '' OR coalesce(p2, '') <> ''))
  OR (st <> 1 AND (coalesce(p1, '') <> '' OR coalesce(p2, '') <> '')), false) AS wrong FROM o""",
)
def paired_fields(spark, folder):
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2)
    rows = table(spark, folder, "orders").select(
        key,
        status.alias("st"),
        case(key, 3, "", None, "x").alias("p1"),
        F.when(key % 4 == 0, "y").alias("p2"),
    )
    wrong = vocab_ops.proof_disagrees(F.col("st"), 1, ["p1", "p2"])
    return rows.select(key, F.coalesce(wrong, F.lit(False)).alias("wrong"))


@query(
    "conditional_mandatory",
    """SELECT o_orderkey,
  o_orderpriority = '1-URGENT' AND coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'ref'
    WHEN o_orderkey % 3 = 0 THEN '' END, '') = '' AS no_reference,
  o_orderstatus <> 'P' AS blurred FROM orders""",
)
def conditional_mandatory(spark, folder):
    key = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        key,
        F.substring("o_orderpriority", 1, 1).cast("int").alias("source_status"),
        F.when(key % 2 == 0, "ref").when(key % 3 == 0, "").alias("reference"),
        F.when(F.col("o_orderstatus") != "P", 1).alias("blurring"),
    )
    bare = vocab_ops.unreferenced_literature(F.col("source_status"), 1, F.col("reference"))
    return rows.select(
        key, bare.alias("no_reference"), F.col("blurring").isNotNull().alias("blurred")
    )


@query(
    "distinct_values",
    """SELECT 'priority' AS field, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE o_orderpriority END AS value,
  count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY 2""",
)
def distinct_values(spark, folder):
    rows = table(spark, folder, "orders").withColumn(
        "p", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority"))
    )
    return map_ops.distinct_values(rows, {"priority": "p", "status": "o_orderstatus"})


@query(
    "term_order",
    """WITH v AS (SELECT r_name AS vocab, CASE WHEN n_nationkey % 4 = 3 THEN 'X' || n_nationkey
  ELSE CAST(n_nationkey AS VARCHAR) END AS code FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT vocab, string_agg(code, ',' ORDER BY coalesce(TRY_CAST(code AS INTEGER), 2147483647), code) AS codes
FROM v GROUP BY vocab""",
)
def term_order(spark, folder):
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    key = F.col("n_nationkey")
    vocabulary = nations.select(
        F.col("r_name").alias("vocab"),
        F.when(key % 4 == 3, F.concat(F.lit("X"), text("n_nationkey"))).otherwise(text("n_nationkey")).alias("code"),
        F.col("n_name").alias("label"),
        key.alias("id"),
    )
    ordered = map_ops.terms_in_order(vocabulary)
    return ordered.select(
        "vocab", F.array_join(F.transform("terms", lambda t: t["code"]), ",").alias("codes")
    )


# values met in customer rows; terms known to suppliers of the same nation
_VALUES_SQL = """vals AS (SELECT DISTINCT c_mktsegment AS vocab, n_name AS value
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
vocabulary AS (SELECT DISTINCT p.c_mktsegment AS vocab, 'C' || n_nationkey AS code, n_name AS label
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN (SELECT DISTINCT c_mktsegment FROM customer) p ON length(p.c_mktsegment) % 3 <> n_nationkey % 3)"""


def met_values(spark, folder):
    nation = table(spark, folder, "nation")
    customer = table(spark, folder, "customer")
    values = (
        customer.select("c_mktsegment", "c_nationkey").distinct()
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_mktsegment").alias("vocab"), F.col("n_name").alias("value"))
    )
    segments = customer.select("c_mktsegment").distinct()
    # every residue but the segment's own, so the join stays an equi-join
    residues = segments.select(
        "c_mktsegment",
        F.explode(
            F.filter(F.sequence(F.lit(0), F.lit(2)), lambda r: r != F.char_length("c_mktsegment") % 3)
        ).alias("residue"),
    )
    supplied = (
        table(spark, folder, "supplier").select("s_nationkey").distinct()
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .withColumn("residue", F.col("n_nationkey") % 3)
    )
    vocabulary = supplied.join(residues, "residue").select(
        F.col("c_mktsegment").alias("vocab"),
        F.concat(F.lit("C"), text("n_nationkey")).alias("code"),
        F.col("n_name").alias("label"),
    )
    return values, vocabulary


@query(
    "mapping_suggest",
    f"""WITH {_VALUES_SQL} SELECT vals.vocab, vals.value, min(code) AS code FROM vals
LEFT JOIN vocabulary v ON v.vocab = vals.vocab AND v.label = vals.value GROUP BY ALL""",
)
def mapping_suggest(spark, folder):
    return map_ops.suggest_by_label(*met_values(spark, folder))


_TEMPLATE_SQL = """template AS (SELECT DISTINCT c_mktsegment AS vocab, n_name AS value,
  'C' || (n_nationkey * 2) % 25 AS code FROM customer JOIN nation ON c_nationkey = n_nationkey
  WHERE n_nationkey % 5 <> 0)"""


def stored_template(spark, folder):
    pairs = (
        table(spark, folder, "customer").select("c_mktsegment", "c_nationkey").distinct()
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .where("n_nationkey % 5 <> 0")
    )
    return pairs.select(
        F.col("c_mktsegment").alias("vocab"),
        F.col("n_name").alias("value"),
        F.concat(F.lit("C"), text((F.col("n_nationkey") * 2) % 25)).alias("code"),
    )


@query(
    "mapping_template",
    f"""WITH {_VALUES_SQL}, {_TEMPLATE_SQL},
ok AS (SELECT * FROM template t WHERE EXISTS (SELECT 1 FROM vocabulary v
  WHERE v.vocab = t.vocab AND v.code = t.code))
SELECT vals.vocab, vals.value, ok.code FROM vals
LEFT JOIN ok ON ok.vocab = vals.vocab AND ok.value = vals.value""",
)
def mapping_template(spark, folder):
    values, vocabulary = met_values(spark, folder)
    return map_ops.suggest_by_template(values, stored_template(spark, folder), vocabulary)


_ROWS_SQL = """SELECT DISTINCT c_custkey % 50 AS id_mapping, c_mktsegment AS vocab,
  n_name AS value, 'C' || n_nationkey AS code FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def mapping_rows(spark, folder):
    return (
        table(spark, folder, "customer")
        .select((F.col("c_custkey") % 50).alias("id_mapping"), "c_mktsegment", "c_nationkey")
        .distinct()
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "id_mapping",
            F.col("c_mktsegment").alias("vocab"),
            F.col("n_name").alias("value"),
            F.concat(F.lit("C"), text("n_nationkey")).alias("code"),
        )
    )


def flat_pairs(mapping):
    """A two-level map as sorted ``vocab/value=code`` text."""
    pairs = F.flatten(
        F.transform(
            F.map_entries(mapping),
            lambda e: F.transform(
                F.map_entries(e["value"]), lambda p: F.concat(e["key"], F.lit("/"), p["key"], F.lit("="), p["value"])
            ),
        )
    )
    return F.array_join(F.array_sort(pairs), ";")


@query(
    "mapping_pivot",
    f"""SELECT id_mapping, string_agg(vocab || '/' || value || '=' || code, ';'
  ORDER BY vocab || '/' || value || '=' || code) AS pairs FROM ({_ROWS_SQL}) GROUP BY 1""",
)
def mapping_pivot(spark, folder):
    pivoted = map_ops.pivot_rows(mapping_rows(spark, folder))
    return pivoted.select("id_mapping", flat_pairs("mapping").alias("pairs"))


@query(
    "mapping_merge",
    f"""WITH r AS ({_ROWS_SQL}),
base AS (SELECT * FROM r WHERE substr(code, 2)::INT % 3 <> 0),
top AS (SELECT id_mapping, vocab, value, code || 'n' AS code FROM r WHERE substr(code, 2)::INT % 2 = 0),
merged AS (SELECT id_mapping, vocab, value, coalesce(t.code, b.code) AS code
  FROM base b FULL JOIN top t USING (id_mapping, vocab, value))
SELECT id_mapping, string_agg(vocab || '/' || value || '=' || code, ';'
  ORDER BY vocab || '/' || value || '=' || code) AS pairs
FROM merged WHERE id_mapping IN (SELECT id_mapping FROM base)
  AND id_mapping IN (SELECT id_mapping FROM top) GROUP BY 1""",
)
def mapping_merge(spark, folder):
    rows = mapping_rows(spark, folder)
    number = F.substring("code", 2, 9).cast("int")
    base = map_ops.pivot_rows(rows.where(number % 3 != 0)).withColumnRenamed("mapping", "base")
    top = map_ops.pivot_rows(
        rows.where(number % 2 == 0).withColumn("code", F.concat("code", F.lit("n")))
    ).withColumnRenamed("mapping", "top")
    both = base.join(top, "id_mapping")
    merged = map_ops.overlay_nested(F.col("base"), F.col("top"))
    return both.select("id_mapping", flat_pairs(merged).alias("pairs"))


@query(
    "mapping_key_removal",
    f"""SELECT id_mapping, string_agg(vocab || '/' || value || '=' || code, ';'
  ORDER BY vocab || '/' || value || '=' || code) AS pairs
FROM ({_ROWS_SQL}) WHERE vocab <> 'BUILDING' GROUP BY 1""",
)
def mapping_key_removal(spark, folder):
    pivoted = map_ops.pivot_rows(mapping_rows(spark, folder))
    left = pivoted.withColumn("mapping", map_ops.without_key(F.col("mapping"), "BUILDING"))
    return left.where(F.size("mapping") > 0).select("id_mapping", flat_pairs("mapping").alias("pairs"))


@query(
    "mapping_explode",
    f"SELECT id_mapping AS id_load, vocab, value, code FROM ({_ROWS_SQL})",
)
def mapping_explode(spark, folder):
    """Mappings kept as JSON, listed again one value per row."""
    pivoted = map_ops.pivot_rows(mapping_rows(spark, folder))
    stored = pivoted.select(F.col("id_mapping").alias("id_load"), F.to_json("mapping").alias("mapping"))
    return vocab_ops.exploded_mappings(stored)


@query(
    "default_mapping",
    f"""WITH t AS ({_TERMS_SQL}) SELECT vocab, label AS value, code, 'label' AS kind FROM t WHERE vocab = 'SEG'
UNION ALL SELECT vocab, code, code, 'code' FROM t WHERE vocab = 'SEG'""",
)
def default_mapping(spark, folder):
    vocabulary = terms(spark, folder)
    parts = [
        map_ops.default_value_mapping(vocabulary, ["SEG"], by).withColumn("kind", F.lit(by))
        for by in ("label", "code")
    ]
    return parts[0].unionByName(parts[1])


# mapping templates: part types name the fields, brands the mappings
_FIELD_ROWS_SQL = """SELECT DISTINCT p_brand AS id_mapping, 'f' || p_size AS target,
  CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 7 = 0 THEN 'true' WHEN p_size % 11 = 0 THEN 'false'
  ELSE 'col' || p_size END AS source, p_size % 7 = 0 OR p_size % 11 = 0 AS generated FROM part"""


def field_rows(spark, folder):
    size = F.col("p_size")
    source = (
        F.when(size % 5 == 0, "").when(size % 7 == 0, "true").when(size % 11 == 0, "false")
        .otherwise(F.concat(F.lit("col"), text("p_size")))
    )
    rows = table(spark, folder, "part").select("p_brand", "p_size").distinct()
    made = rows.select(
        F.col("p_brand").alias("id_mapping"),
        F.concat(F.lit("f"), text("p_size")).alias("target"),
        source.alias("source"),
    )
    fields = table(spark, folder, "part").select("p_size").distinct().select(
        F.concat(F.lit("f"), text("p_size")).alias("field"),
        ((size % 7 == 0) | (size % 11 == 0)).alias("generated"),
        (size % 13 == 0).alias("mandatory"),
        F.lit(False).alias("multi"),
        (size % 9 != 0).alias("display"),
        size.alias("order_field"),
        F.concat(F.lit("t"), text(size % 4)).alias("theme"),
        F.when(size % 3 == 0, F.concat(F.lit("V"), text(size % 5))).alias("vocab"),
    )
    return made, fields


@query(
    "field_rows_to_map",
    f"""WITH r AS ({_FIELD_ROWS_SQL}),
p AS (SELECT id_mapping, '"' || target || '":"' || source || '"' AS item, 0 AS part FROM r
  WHERE NOT generated AND source <> ''
UNION ALL SELECT id_mapping, '"' || target || '":' || CASE WHEN source = 'true' THEN 'true' ELSE 'false' END, 1
  FROM r WHERE generated)
SELECT id_mapping, '{{' || string_agg(item, ',' ORDER BY part, item) || '}}' AS mapping
FROM p GROUP BY 1 HAVING count(*) FILTER (part = 0) > 0""",
)
def field_rows_to_map(spark, folder):
    return map_ops.field_rows_to_map(*field_rows(spark, folder))


@query(
    "field_mapping_issues",
    f"""WITH r AS ({_FIELD_ROWS_SQL}),
f AS (SELECT DISTINCT 'f' || p_size AS field, p_size, p_size % 13 = 0 AS mandatory,
  p_size % 7 = 0 OR p_size % 11 = 0 AS generated FROM part WHERE p_size % 9 <> 0),
k AS (SELECT id_mapping, CASE WHEN substr(target, 2)::INT % 8 = 1 THEN 'zz' || target ELSE target END AS key,
  target FROM r)
SELECT id_mapping, key, 'unknown key' AS fault FROM k WHERE key NOT IN (SELECT field FROM f)
UNION ALL SELECT k.id_mapping, k.key, 'wrong type' FROM k JOIN f ON f.field = k.key WHERE f.generated
UNION ALL SELECT m.id_mapping, f.field, 'missing key' FROM (SELECT DISTINCT id_mapping FROM k) m, f
  WHERE f.mandatory AND NOT EXISTS (SELECT 1 FROM k WHERE k.id_mapping = m.id_mapping AND k.key = f.field)""",
)
def field_mapping_issues(spark, folder):
    rows, fields = field_rows(spark, folder)
    number = F.substring("target", 2, 9).cast("int")
    named = rows.withColumn(
        "key", F.when(number % 8 == 1, F.concat(F.lit("zz"), F.col("target"))).otherwise(F.col("target"))
    )
    # every value is text here, so generated fields have the wrong type
    mappings = named.groupBy("id_mapping").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "source")))).alias("values")
    )
    return meta.field_mapping_issues(mappings, fields)


@query(
    "content_mapping_issues",
    f"""WITH {_VALUES_SQL}, e AS ({_ROWS_SQL})
SELECT id_mapping, vocab, value, code, 'unknown vocabulary' AS fault FROM e WHERE vocab = 'MACHINERY'
UNION ALL SELECT id_mapping, e.vocab, value, e.code, 'unknown code' FROM e WHERE vocab <> 'MACHINERY'
  AND NOT EXISTS (SELECT 1 FROM vocabulary v WHERE v.vocab = e.vocab AND v.code = e.code)""",
)
def content_mapping_issues(spark, folder):
    _, vocabulary = met_values(spark, folder)
    used = ["HOUSEHOLD", "FURNITURE", "BUILDING", "AUTOMOBILE"]
    return meta.content_mapping_issues(mapping_rows(spark, folder), vocabulary, used)


@query(
    "repeated_labels",
    """SELECT p_type AS type, p_name AS label, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1""",
)
def repeated_labels(spark, folder):
    mappings = table(spark, folder, "part").select(
        F.col("p_type").alias("type"), F.col("p_name").alias("label")
    )
    return meta.repeated_labels(mappings)


@query(
    "position_mapping",
    """SELECT p_partkey, (p_partkey % 2 = 0) = (p_partkey % 3 = 0) AND (p_partkey % 5 = 0
  OR p_partkey % 2 = 0 OR p_partkey % 7 = 0) AS ok FROM part""",
)
def position_mapping(spark, folder):
    key = F.col("p_partkey")
    names = ["longitude", "latitude", "WKT", "codemaille"]
    entries = F.array_compact(
        F.array(
            *[
                F.when(key % n == 0, F.struct(F.lit(name).alias("k"), F.lit("c").alias("v")))
                for name, n in zip(names, (2, 3, 5, 7), strict=True)
            ]
        )
    )
    rows = table(spark, folder, "part").select(key, F.map_from_entries(entries).alias("m"))
    return rows.select(key, meta.position_mapping_ok(F.col("m")).alias("ok"))


@query(
    "inconsistent_terms",
    """WITH f AS (SELECT DISTINCT 'f' || p_size AS target, CASE WHEN p_size % 3 = 0
  THEN 'V' || p_size % 5 END AS vocab FROM part),
v AS (SELECT 'V' || n_regionkey AS vocab, n_nationkey AS id FROM nation)
SELECT p_partkey, 'f' || p_size AS target, p_partkey % 25 AS id FROM part
WHERE NOT EXISTS (SELECT 1 FROM f JOIN v USING (vocab) WHERE f.target = 'f' || p_size AND v.id = p_partkey % 25)""",
)
def inconsistent_terms(spark, folder):
    _, fields = field_rows(spark, folder)
    vocabulary = table(spark, folder, "nation").select(
        F.concat(F.lit("V"), text("n_regionkey")).alias("vocab"), F.col("n_nationkey").cast("long").alias("id")
    )
    rows = table(spark, folder, "part").select(
        "p_partkey", F.concat(F.lit("f"), text("p_size")).alias("target"), (F.col("p_partkey") % 25).alias("id")
    )
    return meta.inconsistent_terms(rows, fields, vocabulary)


@query(
    "orphan_mappings",
    "SELECT c_custkey AS id_mapping FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)",
)
def orphan_mappings(spark, folder):
    children = table(spark, folder, "orders").where("o_orderkey % 3 = 0").select(
        F.col("o_custkey").alias("id_mapping")
    )
    return orphans(table(spark, folder, "customer").select(F.col("c_custkey").alias("id_mapping")), children)


# files: brands with the columns found in them; template: targets of the dictionary above
_FILES_SQL = """files AS (SELECT DISTINCT p_brand AS id_file, 'col' || p_size AS col FROM part),
f AS (SELECT DISTINCT p_size, 'f' || p_size AS target, p_size % 7 = 0 OR p_size % 11 = 0 AS generated
  FROM part WHERE p_size % 9 <> 0),
filled AS (SELECT id_file, target, string_agg(col, ',' ORDER BY col) AS sources FROM files JOIN f
  ON NOT generated AND (col = 'col' || p_size OR col = 'col' || (p_size + 1)) GROUP BY ALL
UNION ALL SELECT id_file, target, 'true' FROM (SELECT DISTINCT id_file FROM files), f WHERE generated)"""


def files_and_template(spark, folder):
    _, fields = field_rows(spark, folder)
    files = (
        table(spark, folder, "part")
        .groupBy(F.col("p_brand").alias("id_file"))
        .agg(F.collect_set(F.concat(F.lit("col"), text("p_size"))).alias("columns"))
    )
    size = F.col("order_field")
    both = F.array(F.concat(F.lit("col"), text(size)), F.concat(F.lit("col"), text(size + 1)))
    template = fields.select(
        F.col("field").alias("target"),
        F.when(F.col("generated"), F.array(F.lit("true"))).otherwise(both).alias("sources"),
    )
    return template, files, fields


@query("mapping_autofill", f"WITH {_FILES_SQL} SELECT * FROM filled")
def mapping_autofill(spark, folder):
    filled = map_ops.autofill(*files_and_template(spark, folder))
    return filled.select("id_file", "target", F.array_join("sources", ",").alias("sources"))


_TARGETS = [f"f{n}" for n in range(1, 51)]


@query(
    "mapping_coverage",
    f"""WITH {_FILES_SQL},
used AS (SELECT DISTINCT id_file, unnest(string_split(sources, ',')) AS col FROM filled),
t AS (SELECT 'f' || unnest(range(1, 51)) AS target)
SELECT i.id_file,
  (SELECT string_agg(target, ',' ORDER BY target) FROM filled x WHERE x.id_file = i.id_file) AS mapped_targets,
  (SELECT string_agg(target, ',' ORDER BY target) FROM t WHERE target NOT IN
    (SELECT target FROM filled x WHERE x.id_file = i.id_file)) AS unmapped_targets,
  (SELECT string_agg(col, ',' ORDER BY col) FROM files y WHERE y.id_file = i.id_file AND col IN
    (SELECT col FROM used u WHERE u.id_file = i.id_file)) AS mapped_sources,
  coalesce((SELECT string_agg(col, ',' ORDER BY col) FROM files y WHERE y.id_file = i.id_file AND col NOT IN
    (SELECT col FROM used u WHERE u.id_file = i.id_file)), '') AS unmapped_sources
FROM (SELECT DISTINCT id_file FROM files) i""",
)
def mapping_coverage(spark, folder):
    template, files, fields = files_and_template(spark, folder)
    covered = map_ops.coverage(map_ops.autofill(template, files, fields), files, _TARGETS)
    return covered.select(
        "id_file",
        *[
            F.array_join(c, ",").alias(c)
            for c in ("mapped_targets", "unmapped_targets", "mapped_sources", "unmapped_sources")
        ],
    )


@query(
    "field_catalogue",
    """SELECT r_name AS theme, r_regionkey AS order_theme,
  string_agg(n_name, ',' ORDER BY n_nationkey) AS fields
FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey % 6 <> 0 GROUP BY ALL""",
)
def field_catalogue(spark, folder):
    key = F.col("n_nationkey")
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    fields = nations.select(
        F.col("r_name").alias("theme"),
        key.alias("order_field"),
        F.col("n_name").alias("field"),
        F.lit(False).alias("mandatory"),
        F.lit(False).alias("generated"),
        F.lit(False).alias("multi"),
        (key % 6 != 0).alias("display"),
    )
    themes = table(spark, folder, "region").select(
        F.col("r_name").alias("theme"), F.col("r_regionkey").alias("order_theme")
    )
    nested = meta.field_catalogue(fields, themes)
    names = F.array_join(F.transform("fields", lambda f: f["field"]), ",")
    return nested.select("theme", "order_theme", names.alias("fields"))


@query(
    "vocabulary_catalogue",
    f"""WITH t AS ({_TERMS_SQL}) SELECT vocab, string_agg(code || '=' || label, ';' ORDER BY code) AS terms
FROM t GROUP BY vocab""",
)
def vocabulary_catalogue(spark, folder):
    fields = table(spark, folder, "region").select(
        case(F.col("r_regionkey"), 3, "PRIO", "SEG", None).alias("vocab")
    )
    listed = meta.vocabulary_catalogue(fields, terms(spark, folder))
    pairs = F.transform(F.map_entries("terms"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return listed.select("vocab", F.array_join(F.array_sort(pairs), ";").alias("terms"))
