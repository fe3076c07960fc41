"""Set operations over collections, audits, identifiers and the public export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as T
from ..operators import export as E
from ..operators import relational as R
from ..sources.tables import table
from .catalog import query


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: RE2 has no lookbehind; the e-mail pattern's borders are written out for it.
_SENSITIVE = " OR ".join(f"regexp_matches(t, {_sql(p)})" for p in (r"(?i)(?:^|[^\w.+-])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}(?:$|[^\w.-])", T.ABSOLUTE_PATH, T.SECRET, T.PRIVATE_KEY))


@query("SELECT lang FROM documents WHERE lang IS NOT NULL UNION SELECT 'und' FROM pages UNION SELECT role FROM conversations")
def union_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return t("documents").where("lang is not null").select("lang").distinct().unionByName(t("pages").select(F.lit("und").alias("lang")).distinct()).unionByName(t("conversations").select(F.col("role").alias("lang")).distinct()).distinct()


@query(f"WITH d AS (SELECT doc_id, text AS t FROM documents) SELECT doc_id FROM d WHERE {_SENSITIVE}")
def sensitive_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(T.sensitive(F.col("text"))).select("doc_id")


@query(r"""
    WITH b AS (SELECT trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS t FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS t FROM documents),
    g AS (SELECT DISTINCT hash(substr(t, i::INT, 60)) AS h FROM (SELECT t, unnest(range(1, length(t) - 58)) AS i FROM b WHERE length(t) >= 60)),
    e AS (SELECT doc_id, t, unnest(range(1, length(t) - 58)) AS i FROM d WHERE length(t) >= 60)
    SELECT DISTINCT doc_id FROM e WHERE hash(substr(t, i::INT, 60)) IN (SELECT h FROM g)
    UNION SELECT doc_id FROM d WHERE t <> '' AND t IN (SELECT t FROM b)""")
def overlap_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda n, key: table(spark, sf_dir, n).select(F.col(key).alias("id"), "text")
    return E.overlapping(named("documents", "doc_id"), named("benchmark", "item_id")).select(F.col("id").alias("doc_id"))


@query("SELECT c_custkey, 'ent_' || substr(sha256('public-v1' || chr(0) || 'entity' || chr(0) || c_custkey), 1, 32) AS public_id, 'node-' || substr(sha256(c_custkey || chr(0) || c_name), 1, 16) AS opaque_id FROM customer")
def public_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", I.public_id("entity", F.col("c_custkey")).alias("public_id"), I.opaque_id("node", F.col("c_custkey"), F.col("c_name")).alias("opaque_id"))


@query("""SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS fingerprint, 'n-' || substr(sha256(n_nationkey || chr(31) || n_name), 1, 24) AS stable_id FROM nation""")
def fingerprint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", I.fingerprint(F.col("n_name"), F.col("n_regionkey")).alias("fingerprint"), I.stable_id("n", F.col("n_nationkey").cast("string"), F.col("n_name")).alias("stable_id"))


@query("""
    SELECT 'order without customer' AS check, count(*) AS value FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'item without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'label without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'order without item', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'repeated document', count(*) FROM (SELECT 1 FROM documents GROUP BY doc_id HAVING count(*) > 1)
    UNION ALL SELECT 'repeated text', count(*) FROM (SELECT 1 FROM documents GROUP BY text HAVING count(*) > 1)
    UNION ALL SELECT 'discount out of range', count(*) FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 0.1
    UNION ALL SELECT 'empty event properties', count(*) FROM events WHERE json_extract_string(props, '$.k') IS NULL
    UNION ALL SELECT 'length mismatch', count(*) FROM documents WHERE n_chars <> length(text)
    UNION ALL SELECT 'part without offer', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)""")
def invariant_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return R.checks(
        ("order without customer", R.orphans(t("orders"), "o_custkey", t("customer"), "c_custkey")),
        ("item without order", R.orphans(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey")),
        ("label without document", R.orphans(t("labels"), "doc_id", t("documents"), "doc_id")),
        ("order without item", R.orphans(t("orders"), "o_orderkey", t("lineitem"), "l_orderkey")),
        ("repeated document", R.duplicates(t("documents"), "doc_id")),
        ("repeated text", R.duplicates(t("documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("h")), "h")),
        ("discount out of range", t("lineitem").where(~F.col("l_discount").between(0, 0.1))),
        ("empty event properties", t("events").where(F.get_json_object("props", "$.k").isNull())),
        ("length mismatch", t("documents").where(F.col("n_chars") != F.length("text"))),
        ("part without offer", R.orphans(t("part"), "p_partkey", t("lineitem"), "l_partkey")),
    )


_CUSTOMERS = "SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN 'accepted' ELSE 'draft' END AS status, c_name || ' ' || c_mktsegment AS text FROM customer"


@query(f"""
    WITH RECURSIVE c AS ({_CUSTOMERS}), safe AS (SELECT * FROM c WHERE status = 'accepted'), ref AS (SELECT c_custkey AS id, (c_custkey * 31 + 7) % 1600 AS needs FROM customer WHERE c_mktsegment = 'BUILDING'),
    gone AS (SELECT r.id FROM ref r WHERE r.needs NOT IN (SELECT id FROM safe) UNION SELECT r.id FROM ref r JOIN gone g ON r.needs = g.id)
    SELECT 'ent_' || substr(sha256('public-v1' || chr(0) || 'entity' || chr(0) || id), 1, 32) AS public_id, text FROM safe WHERE id NOT IN (SELECT id FROM gone)""")
def export_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    entities = customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, "accepted").otherwise("draft").alias("status"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"))
    references = customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.pmod(F.col("c_custkey") * 31 + 7, F.lit(1600)).alias("needs"))
    return E.public_entities(entities, references)


@query(f"""
    WITH d AS (SELECT CASE WHEN l.quality = 1 THEN 'accepted' ELSE 'draft' END AS status, coalesce(text, '') AS t FROM documents LEFT JOIN labels l USING (doc_id))
    SELECT CASE WHEN status <> 'accepted' THEN 'not-accepted' WHEN trim(t) = '' THEN 'empty' WHEN {_SENSITIVE} THEN 'sensitive' ELSE 'none' END AS reason, count(*) AS n FROM d GROUP BY 1""")
def quarantine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").withColumn("status", F.when(F.col("quality") == 1, "accepted").otherwise("draft"))
    return E.quarantine(rows).groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT doc_id, greatest(1, ceil(greatest((length(text) - na) / 2.5 + na * 1.25, strlen(text) / 2.5)))::BIGINT AS tokens
    FROM (SELECT doc_id, text, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS na FROM documents)""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("""
    SELECT source, count(DISTINCT lang) AS languages, count(*) AS n, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents GROUP BY source""")
def collection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_distinct("lang").alias("languages"), F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))


_PUBLIC = "'ent_' || substr(sha256('public-v1' || chr(0) || 'entity' || chr(0) || {0}), 1, 32)"


@query(f"""
    WITH RECURSIVE c AS ({_CUSTOMERS}), safe AS (SELECT * FROM c WHERE status = 'accepted'), ref AS (SELECT c_custkey AS id, (c_custkey * 31 + 7) % 1600 AS needs FROM customer WHERE c_mktsegment = 'BUILDING'),
    gone AS (SELECT r.id FROM ref r WHERE r.needs NOT IN (SELECT id FROM safe) UNION SELECT r.id FROM ref r JOIN gone g ON r.needs = g.id),
    kept AS (SELECT id FROM safe WHERE id NOT IN (SELECT id FROM gone)),
    e AS (SELECT DISTINCT o_custkey AS src, (o_custkey * 7 + 1) % 1500 AS dst FROM orders),
    v AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS place, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS kind FROM orders)
    SELECT 'entities' AS part, {_PUBLIC.format('id')} AS id, text AS value FROM safe WHERE id IN (FROM kept)
    UNION ALL SELECT 'edges', {_PUBLIC.format('src')}, {_PUBLIC.format('dst')} FROM e WHERE src IN (FROM kept) AND dst IN (FROM kept)
    UNION ALL SELECT 'events', {_PUBLIC.format('id')}, place || ':' || kind FROM v WHERE kind IS NOT NULL AND id IN (FROM kept)
    UNION ALL SELECT DISTINCT 'citations', {_PUBLIC.format('id')}, CASE WHEN id % 2 = 0 THEN 'book/' || id ELSE 'locator_' || substr(sha256('../' || id), 1, 24) END FROM kept""")
def public_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables of an export together: customers are entities, their orders events, and half their citations name places."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    entities = customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, "accepted").otherwise("draft").alias("status"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"))
    references = customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.pmod(F.col("c_custkey") * 31 + 7, F.lit(1600)).alias("needs"))
    edges = orders.select(F.col("o_custkey").alias("src"), F.pmod(F.col("o_custkey") * 7 + 1, F.lit(1500)).alias("dst")).distinct()
    events = orders.select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("kind"))
    locator = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("book/"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("../"), F.col("c_custkey").cast("string")))
    tables = E.public_tables(entities, references, edges, events, customer.select(F.col("c_custkey").alias("id"), locator.alias("locator")))
    rows = {"entities": ("public_id", F.col("text")), "edges": ("source", F.col("target")), "events": ("entity", F.concat_ws(":", "place", "kind")), "citations": ("entity", F.col("locator"))}
    out = None
    for name, (key, value) in rows.items():
        part = tables[name].select(F.lit(name).alias("part"), F.col(key).alias("id"), value.alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
