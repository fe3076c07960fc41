"""Graph queries: parts and suppliers are nodes, line items edges; turns of conversations are lineages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.tables import table
from .catalog import query

_EDGES = "SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem"


@query(f"""
    WITH RECURSIVE e AS ({_EDGES}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    b AS (SELECT 's1' AS id, 0 AS depth UNION SELECT u.dst, b.depth + 1 FROM b JOIN u ON u.src = b.id WHERE b.depth < 3)
    SELECT id, min(depth) AS depth FROM b GROUP BY id""")
def bfs_depth_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    edges = items.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()
    return G.neighbourhood(edges, spark.createDataFrame([("s1",)], "id string"), 3)


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    r AS (SELECT DISTINCT src AS id, src AS reach FROM u UNION SELECT r.id, u.dst FROM r JOIN u ON u.src = r.reach)
    SELECT id, min(reach) AS component FROM r GROUP BY id""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst")).distinct()
    return G.components(edges, edges.select(F.explode(F.array("src", "dst")).alias("id")))


@query("""
    WITH RECURSIVE e AS (SELECT conv_id * 1000 + turn AS src, conv_id * 1000 + turn - 1 AS dst FROM conversations WHERE turn > 0),
    c AS (SELECT conv_id * 1000 + max(turn) AS id FROM conversations GROUP BY conv_id UNION SELECT dst FROM c JOIN e ON src = id)
    SELECT id FROM c""")
def recursive_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    node = F.col("conv_id") * 1000 + F.col("turn")
    edges = turns.where("turn > 0").select(node.alias("src"), (node - 1).alias("dst"))
    return G.closure(edges, turns.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(node.alias("id")))


@query("""
    SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS relation, l_linestatus AS status, max(l_discount) AS confidence, bool_or(l_tax > 0.04) AS materialized,
           string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS bases, count(*) AS records
    FROM lineitem GROUP BY ALL""")
def edge_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("status"), F.col("l_discount").alias("confidence"), (F.col("l_tax") > 0.04).alias("materialized"), F.col("l_linenumber").cast("string").alias("basis"))
    return G.bundles(claims)


@query("""
    WITH e AS (SELECT c_nationkey AS src, (c_custkey % 25)::INT AS dst FROM customer)
    SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e WHERE dst <> src) GROUP BY id""")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("src"), F.pmod("c_custkey", F.lit(25)).cast("int").alias("dst")))


_REFERENCES = "SELECT c_custkey AS id, (c_custkey * 31 + 7) % 1600 AS needs FROM customer WHERE c_mktsegment = 'BUILDING'"


@query(f"""
    WITH RECURSIVE ent AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0), ref AS ({_REFERENCES}),
    gone AS (SELECT r.id FROM ref r WHERE NOT EXISTS (SELECT 1 FROM ent WHERE ent.id = r.needs) UNION SELECT r.id FROM ref r JOIN gone g ON r.needs = g.id)
    SELECT id FROM ent WHERE id NOT IN (SELECT id FROM gone)""")
def closure_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    references = customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.pmod(F.col("c_custkey") * 31 + 7, F.lit(1600)).alias("needs"))
    return G.closed_under_references(customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id")), references)


@query("""
    WITH t AS (SELECT o_orderkey AS id, o_custkey AS target, o_orderkey + 1 AS source FROM orders WHERE o_orderstatus = 'F'),
    tt AS (SELECT key, arg_min(source, id) AS s FROM (SELECT id AS key, id, source FROM t UNION ALL SELECT target, id, source FROM t WHERE target <> id) GROUP BY key),
    m AS (SELECT p_partkey AS key, min(p_size) AS s FROM part GROUP BY 1),
    c AS (SELECT key, arg_min(subject, (subject <> key)::INT * 1000000 + subject) AS s FROM (SELECT l_suppkey AS subject, unnest(list_distinct([l_suppkey, l_partkey, l_orderkey])) AS key FROM lineitem) GROUP BY key)
    SELECT c_custkey AS id, coalesce(tt.s, m.s, c.s, c_custkey)::BIGINT AS subject FROM customer LEFT JOIN tt ON tt.key = c_custkey LEFT JOIN m ON m.key = c_custkey LEFT JOIN c ON c.key = c_custkey""")
def canonical_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders are translations, parts meanings, line items grounded claims."""
    t = lambda n: table(spark, sf_dir, n)
    translations = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("target"), (F.col("o_orderkey") + 1).alias("source"))
    meanings = t("part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("term"))
    claims = t("lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst"))
    return G.canonical_subject(t("customer").select(F.col("c_custkey").alias("id")), translations, meanings, claims)


@query("SELECT l_linestatus, count(*) FILTER (l_suppkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)) AS dangling, count(*) AS edges FROM lineitem GROUP BY 1")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose target no snapshot of nodes has, by status."""
    nodes = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_suppkey"), F.lit(True).alias("there"))
    return table(spark, sf_dir, "lineitem").join(nodes, "l_suppkey", "left").groupBy("l_linestatus").agg(F.count_if(F.col("there").isNull()).alias("dangling"), F.count(F.lit(1)).alias("edges"))


@query("""
    WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_linestatus = 'F' AND l_tax > 0.02)
    SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e WHERE dst <> src) GROUP BY id""")
def live_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees over accepted, materialized edges alone."""
    edges = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F' and l_tax > 0.02")
    return G.degrees(edges.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query()
def bounded_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    subject = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    node = lambda c: F.concat(F.lit("n"), F.pmod(c, F.lit(40)).cast("string"))
    claims = items.select(subject.alias("subject"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("claim_id"), F.when(F.col("l_linenumber") == 1, subject).otherwise(node(F.col("l_partkey"))).alias("src"), node(F.col("l_orderkey")).alias("dst"), F.col("l_returnflag").alias("relation"))
    return G.subgraph(claims)
