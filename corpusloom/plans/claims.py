"""Authority over claims: line items stand for supports of part-supplier claims, orders for claims on a customer's slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import authority as A
from ..sources.tables import table
from .catalog import query

_BASIS = "CASE l_returnflag WHEN 'R' THEN 'reviewed' WHEN 'A' THEN 'book' ELSE 'model' END"
_RANK = "CASE basis WHEN 'reviewed' THEN 0 WHEN 'book' THEN 1 WHEN 'model' THEN 2 ELSE 3 END"


def _supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    basis = F.when(F.col("l_returnflag") == "R", "reviewed").when(F.col("l_returnflag") == "A", "book").otherwise("model")
    return items.select(
        F.col("l_partkey").alias("assertion_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("support_id"), F.when(F.col("l_linestatus") == "F", "accepted").otherwise("retired").alias("status"),
        basis.alias("basis"), F.col("l_discount").alias("confidence"), F.col("l_linenumber").cast("string").alias("properties"), F.array(F.col("l_suppkey").cast("string")).alias("evidence"),
    )


@query(f"""
    WITH s AS (SELECT l_partkey AS assertion_id, l_orderkey * 10 + l_linenumber AS support_id, l_linestatus = 'F' AS live, {_BASIS} AS basis, l_discount AS confidence,
               l_linenumber::VARCHAR AS properties, l_suppkey::VARCHAR AS evidence FROM lineitem),
    b AS (SELECT assertion_id, basis, properties FROM s WHERE live QUALIFY row_number() OVER (PARTITION BY assertion_id ORDER BY {_RANK}, confidence DESC, support_id) = 1),
    c AS (SELECT assertion_id, max(confidence) AS confidence, string_agg(DISTINCT evidence, ',' ORDER BY evidence) AS evidence FROM s WHERE live GROUP BY 1),
    e AS (SELECT DISTINCT assertion_id FROM s)
    SELECT p_partkey AS assertion_id, CASE WHEN b.basis IS NOT NULL THEN 'accept' WHEN e.assertion_id IS NOT NULL THEN 'archive' ELSE 'skip' END AS action,
           b.basis, b.properties, coalesce(c.confidence, -1) AS confidence, coalesce(c.evidence, '') AS evidence
    FROM part LEFT JOIN b ON b.assertion_id = p_partkey LEFT JOIN c ON c.assertion_id = p_partkey LEFT JOIN e ON e.assertion_id = p_partkey""")
def authority_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("assertion_id"))
    out = A.reduced(parts, _supports(spark, sf_dir))
    return out.select("assertion_id", "action", "basis", "properties", F.coalesce("confidence", F.lit(-1.0)).alias("confidence"), F.coalesce(F.array_join("evidence", ","), F.lit("")).alias("evidence"))


@query(f"""
    WITH c AS (SELECT l_partkey, l_suppkey, l_orderkey * 10 + l_linenumber AS claim_id, {_BASIS} AS basis, l_discount AS confidence, l_linenumber AS revision, l_shipdate AS updated_at FROM lineitem)
    SELECT l_partkey, l_suppkey, claim_id, confidence FROM c
    QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {_RANK}, confidence DESC, revision DESC, updated_at DESC, claim_id DESC) = 1""")
def edge_authority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    basis = F.when(F.col("l_returnflag") == "R", "reviewed").when(F.col("l_returnflag") == "A", "book").otherwise("model")
    claims = items.select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), basis.alias("basis"), F.col("l_discount").alias("confidence"), F.col("l_linenumber").alias("revision"), F.col("l_shipdate").alias("updated_at"))
    return A.strongest_edges(claims, "l_partkey", "l_suppkey")


@query("""
    WITH c AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS owner, o_orderkey AS assertion_id FROM orders),
    d AS (SELECT o_orderkey AS assertion_id FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority <> '5-LOW')
    SELECT owner, assertion_id, 'accepted' AS status FROM c WHERE owner <> 'a' UNION ALL SELECT owner, assertion_id, 'retired' FROM c WHERE owner = 'a' AND assertion_id NOT IN (FROM d)
    UNION ALL SELECT 'a', assertion_id, 'accepted' FROM d""")
def owner_scope_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a current claim, by its status; owner a now wants those not open and not of low priority."""
    orders = table(spark, sf_dir, "orders")
    current = orders.select(F.when(F.col("o_orderstatus") == "F", "a").otherwise("b").alias("owner"), F.col("o_orderkey").alias("assertion_id"), F.lit("accepted").alias("status"))
    desired = orders.where("o_orderstatus <> 'O' and o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("assertion_id"))
    return A.replace_scope(current, desired, "a")


@query("""
    WITH i AS (SELECT o_custkey AS slot, CASE WHEN o_orderstatus = 'F' THEN 'book' ELSE 'model' END AS basis, o_orderpriority AS target FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
    p AS (SELECT o_orderkey AS proposal_id, o_custkey AS slot, CASE WHEN o_totalprice > 150000 THEN 'exclusive' ELSE 'set-member' END AS mode,
                 CASE WHEN o_orderstatus = 'F' THEN 'book' ELSE 'model' END AS basis, o_orderpriority AS target FROM orders)
    SELECT proposal_id, slot, CASE WHEN mode <> 'exclusive' THEN 'coexist' WHEN p.target = i.target THEN CASE WHEN p.basis = i.basis THEN 'noop' WHEN p.basis = 'book' THEN 'update' ELSE 'keep' END
        WHEN i.basis = 'book' THEN CASE WHEN p.basis = 'book' THEN 'conflict' ELSE 'keep' END WHEN p.basis = 'book' THEN 'supersede' ELSE 'pending' END AS decision
    FROM p JOIN i USING (slot)""")
def slot_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("basis", F.when(F.col("o_orderstatus") == "F", "book").otherwise("model"))
    incumbents = orders.groupBy(F.col("o_custkey").alias("slot")).agg(F.min(F.struct("o_orderkey", "basis", "o_orderpriority")).alias("m")).select("slot", "m.basis", F.col("m.o_orderpriority").alias("target"))
    proposals = orders.select(
        F.col("o_orderkey").alias("proposal_id"), F.col("o_custkey").alias("slot"), F.when(F.col("o_totalprice") > 150000, A.EXCLUSIVE).otherwise(A.MEMBER).alias("mode"), "basis", F.col("o_orderpriority").alias("target"),
        F.lit("v1").alias("prompt_version"), F.lit("").alias("evidence"), F.array().cast("array<struct<prompt_version: string, evidence: string>>").alias("earlier"),
    )
    return A.slot_decisions(proposals, incumbents)


@query("""
    SELECT event_id, CASE WHEN event_type = 'view' AND row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) > 1 THEN 'superseded'
        WHEN event_type = 'view' THEN 'accepted' ELSE 'candidate' END AS validation_state FROM events""")
def supersede_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("artifact_id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "view", "accepted").otherwise("candidate").alias("validation_state"))
    return A.superseded(events, "user_id").select(F.col("artifact_id").alias("event_id"), "validation_state")


@query("SELECT p_name || p_brand || p_size AS alias, min(p_partkey) AS canonical FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1")
def unique_alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.unique_aliases(table(spark, sf_dir, "part").select(F.concat("p_name", "p_brand", F.col("p_size").cast("string")).alias("alias"), F.col("p_partkey").alias("canonical")))


@query()
def span_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the parts of each document's words; a group is one word of one document. Each word is decided once."""
    from ..functions.text import words

    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(words(F.coalesce("text", F.lit(""))))).alias("w")).distinct()
    parts = found.select("w").distinct().select("w", F.posexplode(A.pieces_of(F.col("w"))).alias("n", "part"))
    spans = parts.select(F.col("w").alias("group"), F.col("n").cast("long").alias("span_id"), (F.position(F.col("part"), F.col("w")) - 1).alias("start"), "part")
    spans = spans.select("group", "span_id", "start", (F.col("start") + F.length("part")).alias("end"), (F.pmod(F.xxhash64("part"), F.lit(100)) / 100).alias("confidence"), F.col("part").alias("identity"))
    chosen = A.greedy_spans(spans).withColumnRenamed("group", "w")
    return found.join(chosen, "w").select(F.concat_ws(":", "doc_id", "w").alias("group"), "span_id", "chosen")


@query("""
    WITH w AS (SELECT DISTINCT p_brand AS w FROM part), n AS (SELECT w, length(w) AS n, unnest(range(1, 9)) AS k FROM w),
    a AS (SELECT w, substr(w, 1, k) AS p FROM n WHERE k <= n UNION SELECT w, substr(w, n - k + 1, k) FROM n WHERE k <= n
          UNION SELECT w, substr(w, i::INT, k::INT) FROM (SELECT w, n, k, unnest(range(1, n - k + 2)) AS i FROM n WHERE k BETWEEN 3 AND 8 AND k <= n))
    SELECT w, count(*) AS parts FROM a GROUP BY w""")
def component_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("w")).distinct().select("w", F.size(A.pieces_of(F.col("w"))).cast("long").alias("parts"))
