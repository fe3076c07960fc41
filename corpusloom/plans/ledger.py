"""Changes of state. Orders stand for cards and jobs, line items for claims and supports, events for logs and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..sources.tables import table
from .catalog import query

_CARD = "CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'candidate' ELSE 'archived' END"


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "candidate").otherwise("archived")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("card_id"), F.col("o_orderpriority").alias("mode"), F.col("o_custkey").alias("branch"), F.col("o_orderdate").alias("created_at"), status.alias("status"))


@query(f"""SELECT o_orderkey AS card_id, CASE WHEN o_orderstatus = 'F' AND row_number() OVER (PARTITION BY o_orderpriority, o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) > 1 THEN 'superseded' ELSE {_CARD} END AS status FROM orders""")
def supersede_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.supersede_older(_cards(spark, sf_dir), "mode", "branch").select("card_id", "status")


@query(f"""SELECT o_orderkey AS card_id, CASE WHEN o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') THEN 'archived' ELSE {_CARD} END AS status FROM orders""")
def archive_absent_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    branches = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("branch"))
    return L.archive_absent(_cards(spark, sf_dir), branches, "branch").select("card_id", "status")


_PLACE = "((('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT - 12345 + 4294967296) % 4294967296)"


@query(f"""SELECT o_orderkey AS card_id, o_orderpriority AS mode FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'
    ORDER BY o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 250000), {_PLACE}, o_orderkey LIMIT 1""")
def random_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_orderkey").alias("card_id"))
    return L.random_accepted(_cards(spark, sf_dir), "2-HIGH", recent, 12345).select("card_id", "mode")


@query(f"""
    WITH gone AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'),
    runs AS (SELECT l_partkey AS run_id, l_orderkey AS card_id FROM lineitem),
    arts AS (SELECT l_suppkey AS artifact_id, l_partkey AS run_id FROM lineitem WHERE l_returnflag = 'R'),
    gr AS (SELECT run_id FROM runs GROUP BY 1 HAVING bool_and(card_id IN (SELECT id FROM gone))),
    ga AS (SELECT artifact_id FROM arts GROUP BY 1 HAVING bool_and(run_id IN (SELECT run_id FROM gr)))
    SELECT 'card' AS level, id::VARCHAR AS id FROM gone UNION ALL SELECT 'run', run_id::VARCHAR FROM gr UNION ALL SELECT 'artifact', artifact_id::VARCHAR FROM ga""")
def purge_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return L.purge(_cards(spark, sf_dir), items.select(F.col("l_partkey").alias("run_id"), F.col("l_orderkey").alias("card_id")), items.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("artifact_id"), F.col("l_partkey").alias("run_id")))


_SEAL = """sha256('{"event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '"}')"""


@query(f"""
    WITH log AS (SELECT user_id AS claim_id, max(event_id) AS seq, arg_max({_SEAL}, event_id) AS sealed FROM events WHERE event_type IN ('view', 'click') GROUP BY 1),
    prop AS (SELECT user_id AS claim_id, arg_max(event_type, event_id) AS event_type, arg_max(props, event_id) AS props FROM events GROUP BY 1)
    SELECT claim_id, coalesce(seq, 0) + 1 AS seq, event_type, props, {_SEAL} AS seal FROM prop LEFT JOIN log USING (claim_id) WHERE sealed IS DISTINCT FROM {_SEAL}""")
def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event is proposed; what was logged are views and clicks, so a last view or click is a replay."""
    events = table(spark, sf_dir, "events")
    from ..functions.identity import fingerprint

    log = events.where("event_type in ('view', 'click')").select(F.col("user_id").alias("claim_id"), F.col("event_id").alias("seq"), fingerprint("event_type", "props").alias("seal"))
    last = events.groupBy(F.col("user_id").alias("claim_id")).agg(F.max(F.struct("event_id", "event_type", "props")).alias("e")).select("claim_id", "e.event_type", "e.props")
    return L.decisions_to_log(log, last, "event_type", "props")


@query("""WITH c AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O') SELECT max(o_orderkey) AS revision, max(o_orderkey) + (n > 0)::BIGINT AS next_revision FROM orders, c GROUP BY n""")
def graph_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("revision"), F.count_if(F.col("o_orderstatus") == "O").alias("changes"))
    return found.select("revision", L.next_revision(F.col("revision"), F.col("changes")).alias("next_revision"))


_BASIS = "CASE l_returnflag WHEN 'R' THEN 'reviewed' WHEN 'A' THEN 'book' ELSE 'model' END"


@query(f"""
    WITH s AS (SELECT coalesce(target, l_partkey) AS assertion_id, l_suppkey AS owner, l_orderkey * 10 + l_linenumber AS support_id, {_BASIS} AS basis, l_discount AS confidence, l_orderkey, l_linestatus
               FROM lineitem LEFT JOIN (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand, p_size) AS target FROM part) ON p_partkey = l_partkey)
    SELECT assertion_id, owner, arg_min(support_id, ({{'r': list_position(['reviewed', 'book', 'model'], basis), 'c': -confidence, 's': support_id}})) AS support_id,
           arg_min(basis, ({{'r': list_position(['reviewed', 'book', 'model'], basis), 'c': -confidence, 's': support_id}})) AS basis, max(confidence) AS confidence,
           array_to_string(list_sort(list(DISTINCT l_orderkey::VARCHAR)), ',') AS evidence, CASE WHEN bool_or(l_linestatus = 'F') THEN 'accepted' ELSE 'retired' END AS status
    FROM s GROUP BY 1, 2""")
def merge_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of equal name, brand and size are merged into the smallest; line items are their supports."""
    from pyspark.sql import Window

    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), F.min("p_partkey").over(Window.partitionBy("p_name", "p_brand", "p_size")).alias("target_id")).where("source_id <> target_id")
    basis = F.when(F.col("l_returnflag") == "R", "reviewed").when(F.col("l_returnflag") == "A", "book").otherwise("model")
    supports = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("assertion_id"), F.col("l_suppkey").alias("owner"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("support_id"), basis.alias("basis"), F.col("l_discount").alias("confidence"),
        F.array(F.col("l_orderkey").cast("string")).alias("evidence"), F.when(F.col("l_linestatus") == "F", "accepted").otherwise("retired").alias("status"),
    )
    return L.merged_supports(supports, parts).withColumn("evidence", F.array_join("evidence", ","))


@query("SELECT user_id AS assertion_id, bool_and(regexp_matches(event_type, '^(view|click|signup)$') OR regexp_matches(event_type, '^err')) AS automatic FROM events GROUP BY 1")
def automatic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.automatic_only(table(spark, sf_dir, "events").select(F.col("user_id").alias("assertion_id"), F.col("event_type").alias("kind")), "^(view|click|signup)$", "^err")


@query("""
    WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_orderkey AS record_id, l_partkey AS key, l_linestatus FROM lineitem),
    cur AS (SELECT DISTINCT l_orderkey AS record_id, l_partkey AS key FROM lineitem WHERE l_returnflag = 'N'),
    evi AS (SELECT l_orderkey * 10 + l_linenumber AS claim_id, CASE WHEN l_quantity > 40 THEN l_orderkey + 1 ELSE l_orderkey END AS other FROM lineitem)
    SELECT DISTINCT claim_id FROM c WHERE l_linestatus = 'F' AND (record_id, key) NOT IN (FROM cur) AND claim_id NOT IN (SELECT c.claim_id FROM c JOIN evi USING (claim_id) WHERE other <> record_id)""")
def stale_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("claim_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    claims = items.select("claim_id", F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("key"), F.when(F.col("l_linestatus") == "F", "accepted").otherwise("retired").alias("status"))
    current = items.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("key"))
    evidence = items.select("claim_id", F.when(F.col("l_quantity") > 40, F.col("l_orderkey") + 1).otherwise(F.col("l_orderkey")).alias("record_id"))
    return L.stale_of_record(claims, current, evidence)


@query("""
    SELECT DISTINCT l_partkey AS source_id, l_suppkey AS target_id, l_returnflag AS relation FROM lineitem
    WHERE l_linestatus = 'O' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size % 10 <> 0) AND l_suppkey IN (SELECT p_partkey FROM part WHERE p_size % 10 <> 0)
    EXCEPT SELECT l_partkey, l_suppkey, l_returnflag FROM lineitem WHERE l_linestatus = 'F'""")
def restore_missing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), F.col("l_returnflag").alias("relation"), F.col("l_orderkey").alias("evidence_id"), F.when(F.col("l_linestatus") == "F", "accepted").otherwise("open").alias("status"))
    records = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("evidence_id"))
    entities = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.when(F.col("p_size") % 10 == 0, "archived").otherwise("accepted").alias("status"))
    return L.missing_links(items.where("status = 'open'"), items, records, entities)


_RESOLVED = """
    edges AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, l_partkey AS source_id, l_suppkey AS target_id FROM lineitem WHERE l_returnflag = 'R'),
    tr AS (SELECT o_orderkey AS translation_id, CASE WHEN o_orderstatus = 'F' THEN o_orderkey * 10 + 1 END AS edge_id, o_custkey AS subject_id, o_custkey % 100 AS target_id FROM orders),
    e2 AS (SELECT source_id, target_id, min(edge_id) AS endpoint FROM edges GROUP BY 1, 2 HAVING count(DISTINCT edge_id) = 1),
    e1 AS (SELECT source_id, min(edge_id) AS topology FROM edges GROUP BY 1 HAVING count(DISTINCT edge_id) = 1),
    resolved AS (SELECT translation_id, coalesce(x.edge_id, endpoint, topology) AS edge_id, CASE WHEN x.edge_id IS NOT NULL THEN 'explicit' WHEN endpoint IS NOT NULL THEN 'endpoint' WHEN topology IS NOT NULL THEN 'topology' ELSE 'unresolved' END AS how
        FROM tr LEFT JOIN (SELECT DISTINCT edge_id FROM edges) x ON x.edge_id = tr.edge_id LEFT JOIN e2 ON e2.source_id = subject_id AND e2.target_id = tr.target_id LEFT JOIN e1 ON e1.source_id = subject_id)"""


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"))
    translations = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("translation_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") * 10 + 1).alias("edge_id"), F.col("o_custkey").alias("subject_id"), (F.col("o_custkey") % 100).alias("target_id"))
    return L.resolved_edges(translations, edges), edges


@query(f"WITH {_RESOLVED} SELECT * FROM resolved")
def translation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)[0]


@query(f"""WITH {_RESOLVED},
    held AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS edge_id FROM lineitem WHERE l_linestatus = 'F'),
    s AS (SELECT count(*) AS a, count(*) FILTER (edge_id IN (FROM held)) AS b FROM edges),
    r AS (SELECT count(*) AS n, count(*) FILTER (how = 'explicit') AS x, count(*) FILTER (how = 'endpoint') AS e, count(*) FILTER (how = 'topology') AS t, count(*) FILTER (how = 'unresolved') AS u,
                 count(*) FILTER (how <> 'unresolved' AND edge_id NOT IN (FROM held)) AS w, count(DISTINCT edge_id) AS named FROM resolved)
    SELECT unnest(['edges', 'edges_with_evidence', 'edges_without_evidence']) AS counter, unnest([a, b, a - b]) AS value FROM s
    UNION ALL SELECT unnest(['translations', 'resolved_explicit', 'resolved_endpoint', 'resolved_topology', 'unresolved', 'to_write', 'edges_named']), unnest([n, x, e, t, u, w, named]) FROM r""")
def backfill_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved, edges = _resolved(spark, sf_dir)
    return L.backfill_report(resolved, edges, table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id")))


@query("""
    WITH a AS (SELECT user_id AS subject_id, event_type AS language, arg_max(props, event_id) AS text FROM events GROUP BY 1, 2),
    s AS (SELECT c_custkey AS subject_id, lang AS language, '{"k": ' || (c_custkey % 100) || '}' AS stored FROM customer, (VALUES ('view'), ('click')) v(lang))
    SELECT subject_id, language, text, CASE WHEN subject_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) THEN 'skip' WHEN stored IS NULL THEN 'insert' WHEN stored = text THEN 'keep' ELSE 'update' END AS action
    FROM a LEFT JOIN s USING (subject_id, language)""")
def reconcile_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject_id"), F.col("event_type").alias("language"), F.col("event_id").alias("created_at"), F.col("event_id").alias("artifact_id"), F.col("props").alias("text"))
    customers = table(spark, sf_dir, "customer")
    accepted = customers.select(F.col("c_custkey").alias("subject_id"), F.explode(F.array(F.lit("view"), F.lit("click"))).alias("language"), F.concat(F.lit('{"k": '), (F.col("c_custkey") % 100).cast("string"), F.lit("}")).alias("text"))
    return L.reconciliation(artifacts, accepted, customers.select(F.col("c_custkey").alias("entity_id"), F.when(F.col("c_acctbal") < 0, "archived").otherwise("accepted").alias("status")))


_REPAIR = """
    old AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS claim_id, l_partkey AS subject_id, l_suppkey AS target_id, l_discount FROM lineitem WHERE l_linestatus = 'O'),
    cur AS (SELECT DISTINCT l_partkey AS subject_id, l_suppkey AS target_id FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 48),
    one AS (SELECT subject_id, min(target_id) AS new FROM cur GROUP BY 1 HAVING count(*) = 1),
    plan AS (SELECT claim_id, CASE WHEN cur.subject_id IS NOT NULL THEN 'retain' WHEN new IS NOT NULL THEN 'repoint' WHEN cited THEN 'preserve' ELSE 'archive' END AS action, CASE WHEN cur.subject_id IS NULL AND new IS NOT NULL THEN new ELSE old.target_id END AS target_id
        FROM (SELECT *, bool_or(l_discount > 0.05) OVER (PARTITION BY claim_id) AS cited FROM old) old LEFT JOIN cur ON cur.subject_id = old.subject_id AND cur.target_id = old.target_id LEFT JOIN one ON one.subject_id = old.subject_id)"""


def _repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("claim_id"), F.col("l_partkey").alias("subject_id"), F.col("l_suppkey").alias("target_id"), "l_linestatus", "l_quantity", "l_discount")
    old = items.where("l_linestatus = 'O'")
    return L.repair_plan(old.select("claim_id", "subject_id", "target_id"), items.where("l_linestatus = 'F' and l_quantity > 48"), old.where("l_discount > 0.05"))


@query(f"WITH {_REPAIR} SELECT * FROM plan")
def legacy_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repair(spark, sf_dir)


@query(f"""WITH {_REPAIR} SELECT action, count(*) AS actions, sum(('0x' || substr(sha256(claim_id || chr(31) || action || chr(31) || target_id), 1, 15))::HUGEINT)::VARCHAR AS seal FROM plan GROUP BY 1""")
def repair_plan_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sealed_plan(_repair(spark, sf_dir), "claim_id", "action", "target_id")


@query("SELECT p_partkey AS entity_id, first_value(p_partkey) OVER (PARTITION BY p_brand, p_type, p_name ORDER BY (p_size < 25) DESC, p_retailprice DESC, p_partkey) AS survivor_id FROM part")
def alias_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return L.alias_survivors(parts.select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("language"), F.col("p_type").alias("kind"), F.col("p_name").alias("base"), (F.col("p_size") < 25).alias("is_canonical"), F.col("p_retailprice").alias("quality")))


@query("SELECT o_custkey AS slot, count(*) AS winners FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) > 1")
def contested_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.contested_slots(_cards(spark, sf_dir).withColumnRenamed("branch", "slot"))


_NOW = "TIMESTAMP '1998-06-01'"


@query(f"""SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'P' AND o_orderdate <= {_NOW} THEN CASE WHEN o_custkey % 3 < 2 THEN 'queued' ELSE 'failed' END WHEN o_orderstatus = 'P' THEN 'running' ELSE 'queued' END AS status,
    NOT (o_orderstatus = 'P' AND o_orderdate <= {_NOW}) AS leased FROM orders""")
def lease_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("queued").alias("status"), F.col("o_orderdate").alias("lease_until"), (F.col("o_custkey") % 3).alias("attempts"), F.lit(2).alias("max_attempts"))
    return L.leases(jobs, F.expr(_NOW)).select("job_id", "status", F.col("lease_until").isNotNull().alias("leased"))


@query("""WITH m AS (SELECT user_id AS key, max(ts) AS since FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT user_id AS key, count(*) AS done, count(*) >= 10 AS due FROM events LEFT JOIN m ON key = user_id WHERE event_type <> 'signup' AND (since IS NULL OR ts > since) GROUP BY 1""")
def count_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), "event_type")
    return L.due_by_count(events.where("event_type <> 'signup'"), events.where("event_type = 'signup'"), 10)


@query("""
    WITH d AS (SELECT o_orderkey AS key, sha256('{"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS desired FROM orders WHERE o_orderstatus <> 'P'),
    a AS (SELECT o_orderkey AS key, sha256('{"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"F"}') AS applied FROM orders WHERE o_orderpriority <> '1-URGENT')
    SELECT key, desired, applied, CASE WHEN applied IS NULL THEN 'new' WHEN desired IS NULL THEN 'gone' ELSE 'changed' END AS state FROM d FULL JOIN a USING (key) WHERE desired IS DISTINCT FROM applied""")
def stale_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.identity import fingerprint

    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "key")
    applied = orders.where("o_orderpriority <> '1-URGENT'").select("key", "o_orderpriority", F.lit("F").alias("o_orderstatus")).select("key", fingerprint("o_orderpriority", "o_orderstatus").alias("fingerprint"))
    return L.stale_by_fingerprint(orders.where("o_orderstatus <> 'P'"), applied, "o_orderpriority", "o_orderstatus")


@query("""
    WITH o AS (SELECT c_custkey AS key, CASE WHEN c_acctbal >= 5000 THEN '' ELSE c_mktsegment END AS issues FROM customer),
    k AS (SELECT c_custkey AS key, CASE WHEN c_acctbal > 8000 THEN 'healthy' ELSE 'pending' END AS was, c_nationkey % 8 AS tried, CASE WHEN c_nationkey < 5 THEN 'BUILDING' ELSE c_mktsegment END AS had FROM customer WHERE c_nationkey <> 7),
    b AS (SELECT *, was IS NULL OR issues IS DISTINCT FROM had OR was = 'healthy' AS fresh FROM o LEFT JOIN k USING (key))
    SELECT key, CASE WHEN issues = '' THEN 'healthy' WHEN fresh THEN 'pending' WHEN tried >= 5 THEN 'exhausted' ELSE was END AS status, CASE WHEN issues = '' OR fresh THEN 0 ELSE tried END::BIGINT AS attempts, issues FROM b""")
def language_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "key")
    observed = customers.select("key", F.when(F.col("c_acctbal") >= 5000, "").otherwise(F.col("c_mktsegment")).alias("issues"))
    known = customers.where("c_nationkey <> 7").select("key", F.when(F.col("c_acctbal") > 8000, "healthy").otherwise("pending").alias("status"), (F.col("c_nationkey") % 8).alias("attempts"), F.when(F.col("c_nationkey") < 5, "BUILDING").otherwise(F.col("c_mktsegment")).alias("issues"))
    return L.health(observed, known)


@query(f"SELECT o_orderkey AS key, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= {_NOW} ORDER BY o_orderpriority, o_custkey % 4, o_orderdate, o_orderkey LIMIT 1")
def due_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    repairs = orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"), F.col("o_orderdate").alias("due_at"), (F.col("o_custkey") % 4).alias("attempts"), F.col("o_orderdate").alias("observed_at"))
    return L.due_repair(repairs, F.expr(_NOW)).select("key", "priority")


@query("""
    SELECT o_orderkey AS job_id, row_number() OVER (ORDER BY (o_custkey, o_orderpriority) NOT IN (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'), o_orderpriority, o_orderdate, o_orderkey) AS place
    FROM orders WHERE o_orderstatus = 'O' QUALIFY place <= 25""")
def publication_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 jobs of the queue, which is what a claim looks at."""
    from pyspark.sql import Window

    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("subject_key"), F.col("o_orderpriority").alias("prompt_version"), F.lit("").alias("fingerprint"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"), "o_orderstatus")
    first = L.by_affinity(jobs.where("o_orderstatus = 'O'"), jobs.where("o_orderstatus = 'F'")).limit(25)
    begun = jobs.where("o_orderstatus = 'F'").select("subject_key", "prompt_version").distinct().withColumn("b", F.lit(0))
    placed = first.join(begun, ["subject_key", "prompt_version"], "left")
    return placed.select("job_id", F.row_number().over(Window.orderBy(F.coalesce("b", F.lit(1)), "priority", "created_at", "job_id")).cast("bigint").alias("place"))


@query("""
    WITH j AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'complete' END AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
    SELECT job_id FROM j JOIN lineitem ON l_orderkey = job_id WHERE status = 'failed' GROUP BY 1 HAVING bool_and(regexp_matches(l_returnflag, '^[AN]$'))""")
def recoverable_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("subject_key"), F.col("o_orderpriority").alias("job_type"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("complete").alias("status"))
    return L.recoverable(jobs, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("message")), "^[AN]$")


@query("""
    WITH w AS (SELECT DISTINCT p_name AS s FROM part), l(language) AS (VALUES ('de'), ('fr'))
    SELECT s || '/' || stage || ':' AS job_key, s AS subject_key, stage, '' AS language, needs FROM w, LATERAL (VALUES ('meaning', ''), ('components', s || '/meaning:'), ('compose-word-card', s || '/components:,' || s || '/pronunciation:de,' || s || '/pronunciation:fr')) v(stage, needs)
    UNION ALL SELECT s || '/' || stage || ':' || language, s, stage, language, CASE stage WHEN 'translation' THEN s || '/meaning:' ELSE s || '/translation:' || language END FROM w, l, (VALUES ('translation'), ('pronunciation')) v(stage)""")
def word_job_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.word_plan(table(spark, sf_dir, "part").select(F.col("p_name").alias("subject_key")).distinct(), ["de", "fr"])
