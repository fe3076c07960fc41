"""Joins, aggregations, windows and set operations in the roles they play over entities, claims and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.tables import table
from .catalog import query


@query("""
    SELECT o_orderkey, coalesce(nullif(c_name, ''), '') AS label, coalesce(nullif(n_name, ''), nullif(r_name, ''), '') AS place, r_name
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def entity_star_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    star = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return star.select("o_orderkey", R.first_text(F.col("c_name")).alias("label"), R.first_text(F.col("n_name"), F.col("r_name")).alias("place"), "r_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(done, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query("""
    SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
       OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < 0)""")
def exists_or_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    owing = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"))
    either = customer.join(urgent, "c_custkey", "left_semi").unionByName(customer.join(owing, "c_nationkey", "left_semi").select("c_custkey", "c_nationkey"))
    return either.select("c_custkey").distinct()


@query("""
    SELECT n_nationkey, count(*) AS n FROM nation JOIN (
        SELECT c_custkey AS k, c_nationkey AS a, (c_custkey % 25)::INT AS b FROM customer) e ON n_nationkey IN (a, b) GROUP BY n_nationkey""")
def in_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("a"), F.pmod("c_custkey", F.lit(25)).cast("int").alias("b"))
    ends = R.endpoints(edges, "a", "b").select(F.col("endpoint").alias("n_nationkey"))
    return ends.join(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey").groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"))


_BAND_SIGNATURE = "regexp_replace(regexp_replace(lower(p_type), '[^a-z]', '', 'g'), '[ckq]$', 'k')"


@query(f"""
    WITH p AS (SELECT p_partkey, p_name, p_size, {_BAND_SIGNATURE} AS sig, p_brand FROM part),
    m AS (SELECT a.p_partkey AS a_key, b.p_partkey AS b_key, levenshtein(a.p_name, b.p_name) AS distance, abs(a.p_size - b.p_size) AS gap
          FROM p a JOIN p b ON a.sig = b.sig AND a.p_brand = b.p_brand AND abs(a.p_size - b.p_size) <= 8 AND a.p_partkey <> b.p_partkey)
    SELECT a_key, b_key, distance::INT AS distance, gap FROM m QUALIFY row_number() OVER (PARTITION BY a_key ORDER BY distance, gap, b_key) = 1""")
def band_join_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest of the same signature within eight pages; copies and equal names are found by sorting, the rest meets by key and page band."""
    from ..functions.text import family_signature

    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand", family_signature(F.col("p_type")).alias("sig"))
    return R.nearest_texts(part, "p_partkey", "p_name", "p_size", ["sig", "p_brand"], 8)


@query("""
    SELECT e.event_id, n_name FROM events e JOIN nation ON n_nationkey = try_cast(json_extract_string(props, '$.k') AS INT)
    WHERE json_valid(props)""")
def json_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("n_nationkey"))
    return events.join(table(spark, sf_dir, "nation"), "n_nationkey").select("event_id", "n_name")


@query("SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "ts", "event_id")


@query("SELECT * FROM (SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS event_order, value FROM events) WHERE value >= 50")
def event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered before invalid rows are dropped."""
    return R.ordered(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_order").select("event_id", "user_id", "event_order", "value").where("value >= 50")


@query("SELECT conv_id, turn, (lead(turn, 1, 1000) OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS section_end FROM conversations")
def section_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.lead("turn", 1, 1000).over(w) - 1).alias("section_end"))


@query("""
    WITH m AS (SELECT conv_id, max(turn) AS top FROM conversations GROUP BY conv_id)
    SELECT event_id, user_id, coalesce(top, -1) + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal FROM events LEFT JOIN m ON conv_id = user_id""")
def next_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("user_id")).agg(F.max("turn").alias("top"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").join(top, "user_id", "left").select("event_id", "user_id", (F.coalesce("top", F.lit(-1)) + F.row_number().over(w)).alias("ordinal"))


@query("SELECT conv_id, turn FROM conversations WHERE role IS DISTINCT FROM 'system' QUALIFY role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn)")
def consecutive_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").where(~F.col("role").eqNullSafe("system")).withColumn("before", F.lag("role").over(w))
    return rows.where(~F.col("role").eqNullSafe(F.col("before"))).select("conv_id", "turn")


@query("SELECT text_hash, n FROM (SELECT sha256(text) AS text_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)")
def having_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duplicates(table(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("text_hash")), "text_hash")


@query("SELECT coalesce(sum(n - 1), 0)::BIGINT AS extra FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def nested_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duplicates(table(spark, sf_dir, "documents"), "text").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))


@query("""
    SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS open_max,
           count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) AS of_debtors FROM orders GROUP BY 1""")
def conditional_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    debtors = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("owes"))
    rows = table(spark, sf_dir, "orders").join(debtors, "o_custkey", "left")
    return rows.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("open_max"), F.count("owes").alias("of_debtors"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def distinct_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array_sort(F.collect_set("event_type"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(kinds.alias("k")).select("user_id", F.array_join("k", ",").alias("kinds"), F.size("k").cast("long").alias("n"))


@query("""
    WITH l AS (SELECT DISTINCT l_suppkey AS k, l_returnflag AS v FROM lineitem WHERE l_quantity < 25),
    r AS (SELECT DISTINCT l_suppkey AS k, l_returnflag AS v FROM lineitem WHERE l_quantity > 49)
    SELECT coalesce(l.k, r.k) AS l_suppkey, count(*) FILTER (r.k IS NULL) AS only_left, count(*) FILTER (l.k IS NULL) AS only_right
    FROM l FULL JOIN r ON l.k = r.k AND l.v = r.v GROUP BY 1 HAVING count(*) FILTER (r.k IS NULL OR l.k IS NULL) > 0""")
def set_mismatch_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return R.set_mismatch(items.where("l_quantity < 25"), items.where("l_quantity > 49"), "l_suppkey", "l_returnflag")


@query("""
    SELECT 'left' AS side, o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
    UNION ALL SELECT 'right', o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def set_difference_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return R.difference(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), ["o_custkey"])


@query("SELECT event_type, grouping(event_type) = 1 AS is_total, count(*) AS n, count(*) FILTER (value > 50) AS high FROM events GROUP BY GROUPING SETS ((), (event_type))")
def grouped_and_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.totals_and_groups(table(spark, sf_dir, "events"), "event_type", F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("high"))


@query("""
    SELECT source, count(*) AS total, count(l.doc_id) AS accepted, greatest(0, count(*) - count(l.doc_id)) AS remaining, count(*) = count(l.doc_id) AS complete
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = d.doc_id GROUP BY source""")
def coverage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(1).alias("ok")).distinct()
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(good, "doc_id", "left")
    n = rows.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count("ok").alias("accepted"))
    return n.select("source", "total", "accepted", F.greatest(F.lit(0), F.col("total") - F.col("accepted")).alias("remaining"), (F.col("total") == F.col("accepted")).alias("complete"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.after_key(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 500, 50)


@query("""
    SELECT user_id, event_id, row_number() OVER w::INT AS place, count(*) OVER (PARTITION BY user_id) > 8 AS more FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id) QUALIFY row_number() OVER w <= 8""".replace("row_number() OVER w::INT", "(row_number() OVER w)::INT"))
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_of_each(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.asc("event_id")], 8).select("user_id", "event_id", "place", "more")


@query("""
    SELECT e.event_id, coalesce(o.o_orderkey, -1) AS context_id FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') e
    ASOF LEFT JOIN (SELECT user_id AS u, event_id AS o_orderkey, ts AS t FROM events WHERE event_type = 'signup') o ON e.user_id = o.u AND e.ts >= o.t""")
def as_of_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    facts = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    contexts = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("t"), F.col("event_id").alias("o_orderkey"))
    return R.as_of(facts, contexts, ["user_id"], "ts", "t").select("event_id", F.coalesce("o_orderkey", F.lit(-1)).alias("context_id"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, 'X', 0.0 FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT -1, 'N', 1.0")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changes = orders.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice"))
    new = spark.createDataFrame([(-1, "N", 1.0)], "o_orderkey bigint, o_orderstatus string, o_totalprice double")
    return R.upsert(orders, changes.unionByName(new), ["o_orderkey"])


@query("""
    SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM lineitem GROUP BY l_partkey""")
def grouped_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count(F.lit(1)).alias("n"))


@query("""
    SELECT a.o_orderkey, b.o_orderkey AS other FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority
        AND a.o_orderstatus = 'F' AND b.o_orderstatus = 'O' WHERE a.o_orderdate <= b.o_orderdate""")
def self_join_same_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    side = lambda status, key, day: orders.where(F.col("o_orderstatus") == status).select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias(key), F.col("o_orderdate").alias(day))
    return side("F", "o_orderkey", "a").join(side("O", "other", "b"), ["o_custkey", "o_orderpriority"]).where("a <= b").select("o_orderkey", "other")


@query("""
    SELECT l_orderkey, l_linenumber FROM lineitem l JOIN part p ON l_partkey = p_partkey
    WHERE l_extendedprice <> round(l_quantity * p_retailprice, 2) OR l_discount > 0.08""")
def inequality_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.where((F.col("l_extendedprice") != F.round(F.col("l_quantity") * F.col("p_retailprice"), 2)) | (F.col("l_discount") > 0.08)).select("l_orderkey", "l_linenumber")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(nullif(p_name, ''), nullif(s_name, ''), '') AS label, coalesce(n.n_name, m.n_name) AS place, r_name AS region, c_mktsegment AS segment, o_orderpriority AS priority
    FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0
    LEFT JOIN nation n ON n.n_nationkey = c_nationkey LEFT JOIN nation m ON m.n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = coalesce(n.n_regionkey, m.n_regionkey)""")
def typed_star_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven typed tables around each line item; the first text among them that is not empty names it."""
    t = lambda n: table(spark, sf_dir, n)
    nation = lambda key, name: t("nation").select(F.col("n_nationkey").alias(key), F.col("n_name").alias(f"{name}_place"), F.col("n_regionkey").alias(f"{name}_region"))
    star = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t("part"), F.col("p_partkey") == F.col("l_partkey"), "left").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    star = star.join(t("customer").where("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey"), "left").join(nation("c_nationkey", "c"), "c_nationkey", "left").join(nation("s_nationkey", "s"), "s_nationkey", "left")
    star = star.withColumn("r_regionkey", F.coalesce("c_region", "s_region")).join(t("region"), "r_regionkey", "left")
    return star.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.first_text(F.col("p_name"), F.col("s_name")).alias("label"), F.coalesce("c_place", "s_place").alias("place"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"))


@query("""
    SELECT o_custkey % 25 AS owner, count(*) AS actions, sum(('0x' || substr(sha256(o_orderkey || chr(31) || o_orderstatus), 1, 15))::HUGEINT)::VARCHAR AS seal FROM orders GROUP BY 1""")
def scope_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-free hash of every owner's scope, which changes with any claim in it or its status."""
    from ..operators.ledger import sealed_plan

    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("action"), "o_orderkey", "o_orderstatus")
    return sealed_plan(rows, "o_orderkey", "o_orderstatus").withColumnRenamed("action", "owner")


@query("SELECT p_name, p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2")
def keep_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keep_first(table(spark, sf_dir, "part"), ["p_name", "p_brand"], ["p_partkey"]).select("p_name", "p_brand", "p_partkey")


@query("SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT DISTINCT o_orderkey, 'order' FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)")
def insert_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders go in beside customers unless their number is taken; each asks twice."""
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"))
    return R.insert_ignore(current, rows.unionByName(rows), ["id"])


@query("""
    WITH s AS (SELECT l_orderkey, l_linenumber AS a, l_linenumber + (l_quantity::INT % 4) AS b, l_partkey, l_suppkey FROM lineitem)
    SELECT x.l_orderkey, count(*) AS pairs FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND (x.a, x.l_partkey, x.l_suppkey) < (y.a, y.l_partkey, y.l_suppkey) AND x.a < y.b AND y.a < x.b GROUP BY 1""")
def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an order's spans that share a place; an order has a few lines, so its pairs are few."""
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("a"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 4).alias("b"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("k"))
    other = spans.select("l_orderkey", F.col("a").alias("c"), F.col("b").alias("d"), F.col("k").alias("m"))
    pairs = spans.join(other, "l_orderkey").where((F.col("k") < F.col("m")) & R.overlaps(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    return pairs.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pairs"))


@query("""
    WITH l AS (SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"region":' || CASE WHEN n_regionkey > 2 THEN 'null' ELSE n_regionkey::VARCHAR END || '}' AS line, row_number() OVER (ORDER BY CASE WHEN n_regionkey > 2 THEN NULL ELSE n_regionkey END NULLS FIRST, n_name) AS place FROM nation)
    SELECT line, place FROM l""")
def canonical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the fixed order of their export, nulls first, as compact JSON with sorted keys."""
    from ..sources.sinks import canonical_json

    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") <= 2, F.col("n_regionkey")).alias("region"))
    lines = canonical_json(rows, "region", "n_name")
    return lines.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("bigint"))  # a row a nation
