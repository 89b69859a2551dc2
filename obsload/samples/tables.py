"""Appending to and retracting from the target, statistics, listings and visibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsload.operators import listing, stats
from obsload.samples.registry import case, query, table, text
from obsload.sinks import tables as sink


def observations(spark, folder):
    """Line items as checked observations: returned ones are invalid."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_suppkey") % 5).alias("id_source"),
        F.col("l_partkey").alias("cd_nom"),
        (F.col("l_returnflag") != "R").alias("valid"),
    )


@query(
    "commit_stats",
    """SELECT l_suppkey % 5 AS id_source, count(*) AS import_count, count(DISTINCT l_partkey) AS taxa_count
FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1""",
)
def commit_stats(spark, folder):
    target = observations(spark, folder).where("valid")
    counted = stats.import_counts(target)
    return counted.select("id_source", F.col("import_count").cast("long").alias("import_count"), "taxa_count")


@query(
    "validity_counts",
    """SELECT l_suppkey % 5 AS id_source, count(*) FILTER (l_returnflag <> 'R') AS n_valid_data,
  count(*) FILTER (l_returnflag = 'R') AS n_invalid_data FROM lineitem GROUP BY 1""",
)
def validity_counts(spark, folder):
    return stats.validity_counts(observations(spark, folder), ["id_source"])


@query(
    "taxa_distribution",
    """SELECT p_brand AS "group", count(*) AS count FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE l_returnflag <> 'R' AND l_suppkey % 5 = 2 GROUP BY p_brand""",
)
def taxa_distribution(spark, folder):
    taxa = table(spark, folder, "part").select(
        F.col("p_partkey").alias("cd_nom"), F.col("p_brand").alias("regne")
    )
    target = observations(spark, folder).where("valid")
    return stats.taxa_distribution(target, taxa, "regne", 2)


@query(
    "preview",
    """SELECT o_orderkey + 1 AS line_no, o_orderpriority, o_custkey FROM orders
WHERE o_orderstatus <> 'P' ORDER BY o_orderkey LIMIT 100""",
)
def preview(spark, folder):
    rows = table(spark, folder, "orders").select(
        (F.col("o_orderkey") + 1).alias("line_no"),
        "o_orderpriority",
        "o_custkey",
        (F.col("o_orderstatus") != "P").alias("valid"),
    )
    return stats.preview(rows, ["o_orderpriority", "o_custkey"])


_TARGET_SQL = """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE o_orderkey % 7 END AS id_source,
  o_orderstatus AS v FROM orders"""


def target_rows(spark, folder):
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("k"), F.when(key % 7 != 6, key % 7).alias("id_source"), F.col("o_orderstatus").alias("v")
    )


@query("retract", f"SELECT * FROM ({_TARGET_SQL}) WHERE id_source IS DISTINCT FROM 3")
def retract(spark, folder):
    return sink.retract(target_rows(spark, folder), 3)


@query(
    "reload",
    f"""WITH t AS ({_TARGET_SQL}), fresh AS (SELECT c_custkey AS k, c_custkey % 2 AS id_source,
  c_mktsegment AS v FROM customer)
SELECT * FROM t WHERE coalesce(id_source, -1) NOT IN (SELECT id_source FROM fresh)
UNION ALL SELECT * FROM fresh""",
)
def reload(spark, folder):
    fresh = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("k"), (F.col("c_custkey") % 2).alias("id_source"), F.col("c_mktsegment").alias("v")
    )
    return sink.reload(target_rows(spark, folder), fresh)


@query(
    "append_rows",
    """SELECT o_orderkey AS cd_nom, o_orderpriority AS nom_cite, CAST(NULL AS INTEGER) AS depth_min,
  CAST(NULL AS VARCHAR) AS reference_biblio, 9 AS id_source, 4 AS id_module, 5 AS id_dataset,
  'I' AS last_action FROM orders WHERE o_orderstatus <> 'P'""",
)
def append_rows(spark, folder):
    import datetime as dt

    from obsload.model.loads import Load, Settings

    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("cd_nom"),
        F.col("o_orderpriority").alias("nom_cite"),
        F.col("o_custkey").alias("depth_min"),
        (F.col("o_orderstatus") != "P").alias("valid"),
    )
    load = Load(1, (), {"cd_nom": "a", "nom_cite": "b"}, id_dataset=5, id_source=9, id_module=4)
    fresh = sink.appended_rows(rows, load, Settings(as_of=dt.date(2024, 1, 1)))
    made = ["cd_nom", "nom_cite", "depth_min", "reference_biblio"]
    return fresh.select(*made, "id_source", "id_module", "id_dataset", "last_action")


@query(
    "two_mappings_target",
    """SELECT o_orderkey AS cd_nom, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS nom_cite,
  CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END AS depth_min, 20 + o_orderkey % 2 AS id_source
FROM orders""",
)
def two_mappings_target(spark, folder):
    """Two loads that map other fields, committed to one table and read back."""
    import datetime as dt

    from obsload.model.loads import Load, Settings
    from obsload.plans.load import commit
    from obsload.workspace import work_path

    path = work_path(spark, "two-mappings")
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("int").alias("cd_nom"),
        F.col("o_orderpriority").alias("nom_cite"),
        F.col("o_custkey").cast("int").alias("depth_min"),
        F.lit(True).alias("valid"),
    )
    for half, other in ((0, "nom_cite"), (1, "depth_min")):
        load = Load(half, (), {"cd_nom": "a", other: "b"}, id_source=20 + half)
        commit(rows.where(F.col("cd_nom") % 2 == half), load, Settings(as_of=dt.date(2024, 1, 1)), path)
    return spark.read.parquet(path).select("cd_nom", "nom_cite", "depth_min", "id_source")


@query(
    "invalid_export",
    "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey % 10 = 3",
)
def invalid_export(spark, folder):
    source = table(spark, folder, "orders").withColumns(
        {"id_load": F.lit(1), "line_no": F.col("o_orderkey") + 1}
    )
    rows = source.select("id_load", "line_no", (F.col("o_orderkey") % 10 != 3).alias("valid"))
    return sink.invalid_records(source, rows, ["o_orderkey", "o_orderpriority", "o_totalprice"])


@query(
    "load_reset",
    """SELECT o_orderkey, o_orderkey % 5 + 1 AS step,
  CASE WHEN o_orderkey % 5 + 1 <= 3 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS source_count,
  o_orderkey % 5 + 1 > 3 AS loaded, o_orderkey % 5 + 1 > 4 AS processed,
  CASE WHEN o_orderkey % 5 + 1 <= 5 THEN NULL ELSE o_orderstatus END AS id_source FROM orders""",
)
def load_reset(spark, folder):
    loads = table(spark, folder, "orders").select(
        "o_orderkey",
        (F.col("o_orderkey") % 5 + 1).alias("step"),
        text("o_custkey").alias("source_count"),
        F.lit(True).alias("loaded"),
        F.lit(True).alias("processed"),
        F.col("o_orderstatus").alias("id_source"),
    )
    return sink.reset_loads(loads, F.col("step"))


@query(
    "load_counters",
    """WITH l AS (SELECT s_suppkey AS id_load, s_suppkey % 7 AS id_source FROM supplier),
c AS (SELECT l_suppkey % 5 AS id_source, count(*) AS n, count(DISTINCT l_partkey) AS t
  FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT id_load, CAST(n AS VARCHAR) AS import_count, CAST(t AS VARCHAR) AS taxa_count,
  CASE WHEN n IS NOT NULL THEN '2024-01-01' END AS date_end_import FROM l LEFT JOIN c USING (id_source)""",
)
def load_counters(spark, folder):
    loads = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id_load"), (F.col("s_suppkey") % 7).alias("id_source")
    )
    done = stats.with_load_counters(loads, observations(spark, folder).where("valid"), F.lit("2024-01-01"))
    return done.select(
        "id_load",
        text("import_count").alias("import_count"),
        text("taxa_count").alias("taxa_count"),
        "date_end_import",
    )


# orders as loads, nations as data sets, customers as authors of the loads of their orders
_LOADS_SQL = """loads AS (SELECT o_orderkey AS id_load, o_custkey % 30 AS id_dataset,
  'file_' || o_orderkey || CASE WHEN o_orderkey % 9 = 0 THEN '_Nation' ELSE '' END || '.csv' AS full_file_name,
  CAST(o_totalprice * 100 AS BIGINT) AS source_count, o_custkey FROM orders),
datasets AS (SELECT n_nationkey AS id_dataset, n_name AS dataset_name FROM nation),
authors AS (SELECT o_orderkey AS id_load, c_custkey AS id_role, c_nationkey AS id_organisation,
  c_name AS full_name FROM orders JOIN customer ON c_custkey = o_custkey OR c_custkey = (o_custkey + 1) % 1500)"""


def listing_tables(spark, folder):
    key = F.col("o_orderkey")
    orders = table(spark, folder, "orders")
    name = F.concat(
        F.lit("file_"), text(key), F.when(key % 9 == 0, "_Nation").otherwise(""), F.lit(".csv")
    )
    loads = orders.select(
        key.alias("id_load"),
        (F.col("o_custkey") % 30).alias("id_dataset"),
        name.alias("full_file_name"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("source_count"),
    )
    datasets = table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("long").alias("id_dataset"), F.col("n_name").alias("dataset_name")
    )
    roles = orders.select(
        key.alias("id_load"),
        F.explode(F.array(F.col("o_custkey"), (F.col("o_custkey") + 1) % 1500)).alias("c_custkey"),
    ).distinct()
    authors = roles.join(table(spark, folder, "customer"), "c_custkey").select(
        "id_load",
        F.col("c_custkey").alias("id_role"),
        F.col("c_nationkey").alias("id_organisation"),
        F.col("c_name").alias("full_name"),
    )
    return loads, datasets, authors


@query(
    "load_listing",
    f"""WITH {_LOADS_SQL}, a AS (SELECT id_load, string_agg(DISTINCT full_name, '; ' ORDER BY full_name) AS authors_name
  FROM authors GROUP BY 1)
SELECT id_load, full_file_name, dataset_name, authors_name FROM loads LEFT JOIN datasets USING (id_dataset)
LEFT JOIN a USING (id_load) ORDER BY dataset_name DESC NULLS FIRST, id_load LIMIT 15 OFFSET 30""",
)
def load_listing(spark, folder):
    loads, datasets, authors = listing_tables(spark, folder)
    named = listing.with_authors(loads, datasets, authors)
    return listing.page(named, "dataset_name", True, 3).select(
        "id_load", "full_file_name", "dataset_name", "authors_name"
    )


@query(
    "load_search",
    f"""WITH {_LOADS_SQL} SELECT id_load FROM loads LEFT JOIN datasets USING (id_dataset)
WHERE contains(lower(full_file_name), '_nation') OR contains(lower(dataset_name), '_nation') OR
  contains(full_file_name, '0012') OR id_load IN (SELECT id_load FROM authors WHERE contains(full_name, '0012'))""",
)
def load_search(spark, folder):
    loads, datasets, authors = listing_tables(spark, folder)
    joined = loads.join(datasets, "id_dataset", "left")
    by_name = listing.search(joined, authors, "_NATION")
    by_author = listing.search(joined, authors, "0012")
    return by_name.select("id_load").unionByName(by_author.select("id_load")).distinct()


@query(
    "load_total",
    f"WITH {_LOADS_SQL} SELECT count(*) AS count FROM loads WHERE full_file_name LIKE '%Nation%'",
)
def load_total(spark, folder):
    loads, _, authors = listing_tables(spark, folder)
    found = listing.search(loads.withColumn("dataset_name", F.lit(None).cast("string")), authors, "nation.")
    return listing.total(found)


@query(
    "visibility",
    f"""WITH {_LOADS_SQL} SELECT id_load, 1 AS scope FROM loads WHERE id_load IN
  (SELECT id_load FROM authors WHERE id_role = 42)
UNION ALL SELECT id_load, 2 FROM loads WHERE id_load IN
  (SELECT id_load FROM authors WHERE id_role = 42 OR id_organisation = 7)
UNION ALL SELECT id_load, 3 FROM loads""",
)
def visibility(spark, folder):
    loads, _, authors = listing_tables(spark, folder)
    parts = [
        listing.visible_loads(loads, authors, 42, 7, scope).select("id_load", F.lit(scope).alias("scope"))
        for scope in (listing.NONE, listing.OWN, listing.ORGANISATION, listing.ALL)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "mapping_visibility",
    """WITH m AS (SELECT p_partkey AS id_mapping, p_size % 3 <> 0 AS active, p_size % 5 = 0 AS public,
  CASE WHEN p_partkey % 2 = 0 THEN 'FIELD' ELSE 'CONTENT' END AS type FROM part),
o AS (SELECT l_partkey AS id_mapping, l_suppkey AS id_role, l_linenumber AS id_organisation FROM lineitem)
SELECT id_mapping FROM m WHERE active AND type = 'FIELD' AND (public OR id_mapping IN
  (SELECT id_mapping FROM o WHERE id_role = 3 OR id_organisation = 1))""",
)
def mapping_visibility(spark, folder):
    key = F.col("p_partkey")
    mappings = table(spark, folder, "part").select(
        key.alias("id_mapping"),
        (F.col("p_size") % 3 != 0).alias("active"),
        (F.col("p_size") % 5 == 0).alias("public"),
        case(key, 2, "FIELD", "CONTENT").alias("type"),
    )
    owners = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("id_mapping"),
        F.col("l_suppkey").alias("id_role"),
        F.col("l_linenumber").alias("id_organisation"),
    )
    return listing.visible_mappings(mappings, owners, 3, 1, listing.ORGANISATION, "FIELD").select("id_mapping")
