"""Words and parts: names of parts are the words, their halves the parts; orders, items and documents stand for the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import wordparts as W
from ..sources.tables import table
from .catalog import query

_WORDS = "SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_size FROM part"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.substring_index("p_name", " ", 1).alias("a"), F.substring_index("p_name", " ", -1).alias("b"), "p_size")


_SPANS = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")


@query(f"""WITH w AS ({_WORDS}) SELECT p_partkey, '0-2,' || length(a) || '-' || (length(a) + length(b)) AS aligned, '1' AS unmatched, '3' AS whole, CASE WHEN length(a) > 2 THEN '2-' || length(a) ELSE '' END AS gaps FROM w""")
def part_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.concat("a", "b")
    found = W.coverage(word, F.array(F.substring("a", 1, 2), F.lit("qq"), F.col("b"), word))
    rows = _words(spark, sf_dir).select("p_partkey", found.alias("c"))
    text = lambda name: F.array_join(F.col(f"c.{name}").cast("array<string>"), ",").alias(name)
    return rows.select("p_partkey", _SPANS(F.col("c.aligned")).alias("aligned"), text("unmatched"), text("whole"), _SPANS(F.col("c.gaps")).alias("gaps"))


@query(f"""WITH w AS ({_WORDS}) SELECT p_partkey, substr(a, 1, 2) || ':false' || CASE WHEN length(a) > 2 THEN ',' || substr(a, 3) || ':true' ELSE '' END || ',' || b || ':false' AS parts, 0 AS gaps FROM w""")
def part_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two letters and the second half are proposed; the rest of the first half is known from before, whole words are not."""
    word = F.concat("a", "b")
    found = W.merged_parts(word, F.array(F.substring("a", 1, 2), F.col("b")), F.array(F.col("b"), word, F.substring("a", 3, 99), F.substring("a", 3, 99)))
    rows = _words(spark, sf_dir).select("p_partkey", found.alias("c"))
    shown = F.array_join(F.transform("c.parts", lambda p: F.concat_ws(":", p["surface"], p["previous"].cast("string"))), ",")
    return rows.select("p_partkey", shown.alias("parts"), F.size("c.gaps").alias("gaps"))


_BASIS = "CASE l_returnflag WHEN 'R' THEN 'reviewed' WHEN 'A' THEN 'book' ELSE 'model' END"


@query("""
    WITH c AS (SELECT l_orderkey AS term, l_linenumber AS s, l_suppkey % 3 AS form, l_returnflag, l_discount, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY term, s, form ORDER BY list_position(['R', 'A', 'N'], l_returnflag), l_discount DESC, id DESC) AS nth FROM c)
    SELECT term, s AS start, form, max(id) FILTER (nth = 1) AS component_id, coalesce(array_to_string(list_sort(list(DISTINCT id) FILTER (nth > 1)), ','), '') AS aliases FROM r GROUP BY 1, 2, 3""")
def components_by_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis = F.when(F.col("l_returnflag") == "R", "reviewed").when(F.col("l_returnflag") == "A", "book").otherwise("model")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("term"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"), (F.col("l_suppkey") % 3).alias("form"), basis.alias("basis"),
        F.col("l_discount").alias("confidence"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("component_id"),
    )
    return W.merged_by_span(rows).select("term", "start", "form", "component_id", F.array_join("aliases", ",").alias("aliases"))


@query("""
    WITH r AS (SELECT coalesce(source, '-') AS term, coalesce(lang, '-') AS corpus, doc_id // 4 AS entry, substr(text, 1, 400) AS excerpt, coalesce(quality = 0, false) AS required, coalesce(toxic, 2) AS rank FROM documents LEFT JOIN labels USING (doc_id)),
    o AS (SELECT term, corpus, entry, arg_max(excerpt, {'n': length(excerpt), 'e': excerpt}) AS excerpt, bool_or(required) AS required, min(rank) AS rank FROM r WHERE excerpt IS NOT NULL GROUP BY 1, 2, 3),
    p AS (SELECT *, row_number() OVER w AS place, sum(length(excerpt)) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM o WINDOW w AS (PARTITION BY term ORDER BY required DESC, rank, length(excerpt) DESC, corpus, entry))
    SELECT term, corpus, entry, md5(excerpt) AS excerpt, place FROM p WHERE place <= 8 AND used <= 2400""")
def evidence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    rows = table(spark, sf_dir, "documents").where("text is not null").join(labels, "doc_id", "left").select(
        F.coalesce("source", F.lit("-")).alias("term"), F.coalesce("lang", F.lit("-")).alias("corpus"), F.floor(F.col("doc_id") / 4).alias("entry"), F.substring("text", 1, 400).alias("excerpt"),
        F.coalesce(F.col("quality") == 0, F.lit(False)).alias("required"), F.coalesce("toxic", F.lit(2)).alias("rank"),
    )
    return W.packed_evidence(rows).withColumn("excerpt", F.md5(F.col("excerpt").cast("binary"))).withColumn("place", F.col("place").cast("bigint"))


@query("""SELECT o_orderkey, sha256('{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS fingerprint FROM orders""")
def context_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", W.context_fingerprint({"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}).alias("fingerprint"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN true WHEN o_orderstatus = 'P' THEN e > 0 AND e % 2 = 0 WHEN o_orderstatus = 'O' THEN false ELSE o_orderpriority = '1-URGENT' OR e > 0 AND e % 4 = 0 END AS due FROM (SELECT *, o_custkey % 9 AS e FROM orders)""")
def structure_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, status = F.col("o_orderpriority") == "5-LOW", F.col("o_orderstatus")
    scope = F.when(low & (status == "F"), None).when(low, "complete").when(status == "P", "partial").otherwise("complete")
    due = W.review_due(scope, F.when(low, 0).otherwise(2), status != "O", F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey") % 9)
    return table(spark, sf_dir, "orders").select("o_orderkey", due.alias("due"))


@query("""
    SELECT c_custkey AS component_id, CASE WHEN c_nationkey = 3 AND c_acctbal > 0 THEN 'new' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'old' WHEN c_acctbal > 0 THEN 'new' ELSE '' END AS steps,
           CASE WHEN c_acctbal > 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'history-found' WHEN c_nationkey <> 3 AND c_custkey IN (SELECT o_custkey FROM orders) THEN 'tried' ELSE 'open' END AS status, c_nationkey = 3 AND c_acctbal > 0 AS revised FROM customer""")
def origin_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are branches with new steps if they have means, and old ones if an order was finished; nation 3 is visited."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("component_id")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("done"))
    none = F.array().cast("array<string>")
    previous = orders.select("component_id", F.when(F.col("done"), F.array(F.lit("old"))).otherwise(none).alias("steps"), F.lit("tried").alias("status"))
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("component_id"), "c_nationkey", F.when(F.col("c_acctbal") > 0, F.array(F.lit("new"))).otherwise(none).alias("steps"), F.lit("open").alias("status"))
    focus = F.when(F.col("c_nationkey") == 3, F.col("component_id"))
    visited = W.merged_paths(current, previous, focus)
    return visited.select("component_id", F.array_join("steps", ",").alias("steps"), "status", F.coalesce("revised", F.lit(False)).alias("revised"))


@query("""SELECT event_id AS claim_id FROM events e WHERE event_type = 'view' AND value > 20 AND (user_id, event_id % 7) NOT IN (SELECT user_id, event_id % 7 FROM events WHERE event_type = 'purchase')""")
def obsolete_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    ends = [F.col("user_id").alias("source_id"), (F.col("event_id") % 7).alias("target_id")]
    claims = events.select(F.col("event_id").alias("claim_id"), *ends, F.lit("accepted").alias("status"), F.when(F.col("value") > 20, "model").otherwise("book").alias("basis"), F.to_json(F.struct(F.col("event_type").alias("producer"))).alias("properties"))
    return W.obsolete_transitions(claims, events.where("event_type = 'purchase'").select(*ends), "view")


@query("""
    WITH x AS (SELECT doc_id, list_filter([CASE WHEN text IS NULL OR trim(text) = '' THEN 'missing-text' END, CASE WHEN lang IS NULL THEN 'missing-language' END, CASE WHEN length(text) < 100 THEN 'thin' END], lambda i: i IS NOT NULL) AS i FROM documents)
    SELECT doc_id, array_to_string(i, ',') AS issues, CASE WHEN list_contains(i, 'missing-text') THEN 10 WHEN list_contains(i, 'missing-language') THEN 20 WHEN list_contains(i, 'thin') THEN 30 END AS priority FROM x""")
def health_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rules = {"missing-text": (10, text.isNull() | (F.trim(text) == "")), "missing-language": (20, F.col("lang").isNull()), "thin": (30, F.length(text) < 100)}
    return table(spark, sf_dir, "documents").select("doc_id", W.issues(rules).alias("i")).select("doc_id", "i.issues", "i.priority")


@query("SELECT event_id, event_type = 'view' AND value > 10 OR event_type = 'click' AND value > 20 AS eligible FROM events")
def live_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views show two joined nodes if their value is over 10; clicks three, of which one hangs loose unless it is over 20."""
    value, kind = F.col("value"), F.col("event_type")
    two = F.when(value > 10, '{"live": true, "nodes": ["a", "b"], "edges": [["a", "b"]]}').otherwise('{"live": true, "nodes": ["a"], "edges": []}')
    three = F.when(value > 20, '{"live": true, "nodes": ["a", "b", "c"], "edges": [["a", "b"], ["c", "a", "x"]]}').otherwise('{"live": true, "nodes": ["a", "b", "c"], "edges": [["a", "b"]]}')
    payload = F.when(kind == "view", two).when(kind == "click", three).when(kind == "error", "{").otherwise('{"live": false, "nodes": ["a", "b"], "edges": [["a", "b"]]}')
    return table(spark, sf_dir, "events").select("event_id", W.live_eligible(payload).alias("eligible"))


@query("""
    WITH a AS (SELECT s_suppkey AS alias, s_nationkey AS canonical FROM supplier WHERE s_acctbal > 0)
    SELECT l_orderkey AS projection, string_agg(canonical::VARCHAR, ',' ORDER BY l_linenumber, canonical) AS ids FROM lineitem LEFT JOIN a ON alias = l_suppkey GROUP BY 1 HAVING bool_and(canonical IS NOT NULL)""")
def resolved_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("projection"), F.col("l_linenumber").alias("place"), F.col("l_suppkey").alias("alias"))
    aliases = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("alias"), F.col("s_nationkey").alias("canonical"))
    return W.resolved_projections(parts, aliases).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


_DERIVED = """
    t AS (SELECT p_brand AS source, p_partkey AS place, CASE WHEN p_size > 45 THEN ' N/A ' WHEN p_size > 40 THEN p_brand ELSE upper(p_name) END AS term, p_size FROM part),
    f AS (SELECT *, lower(trim(term)) AS key FROM t WHERE lower(trim(term)) <> lower(source) AND lower(trim(term)) NOT IN ('n/a', 'red widget')),
    d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY source, key ORDER BY place) = 1)"""


@query(f"WITH {_DERIVED} SELECT source, trim(term) AS term, row_number() OVER (PARTITION BY source ORDER BY place) AS n FROM d QUALIFY n <= 32")
def derivative_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    term = F.when(size > 45, " N/A ").when(size > 40, F.col("p_brand")).otherwise(F.upper("p_name"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("place"), term.alias("term"), F.array(F.lit("red widget")).alias("excluded"))
    return W.derivatives(rows).select("source", "term", F.col("place").cast("bigint").alias("n"))


@query("SELECT p_brand AS source, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_size <= 10 OR split_part(p_name, ' ', 1) = 'red' OR split_part(p_name, ' ', 2) IN ('ring', 'bolt') QUALIFY n <= 24")
def view_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.when(F.col("p_size") <= 10, F.array().cast("array<string>")).otherwise(F.split("p_name", " "))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), "p_partkey", F.col("p_partkey").alias("place"), parts.alias("parts"))
    halves = W.derivatives_for_view(rows, F.array(F.lit("red"), F.lit("ring"), F.lit("bolt")))
    return halves.select("source", "p_partkey", F.col("n").cast("bigint").alias("n"))


@query("""
    WITH c AS (SELECT l_orderkey AS word, l_linenumber AS ordinal, l_suppkey AS surface, count(DISTINCT l_returnflag) AS roles, min(l_returnflag) AS role FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2, 3)
    SELECT l_orderkey AS word, l_linenumber AS ordinal, l_suppkey AS surface, CASE WHEN roles = 1 THEN role END AS role, coalesce(roles, 0) > 1 AS conflict FROM lineitem LEFT JOIN c ON word = l_orderkey AND ordinal = l_linenumber AND surface = l_suppkey""")
def cited_component_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("word"), F.col("l_linenumber").alias("ordinal"), F.col("l_suppkey").alias("surface"), F.col("l_returnflag").alias("role"), "l_linestatus")
    return W.cited_roles(items.select("word", "ordinal", "surface"), items.where("l_linestatus = 'F'"))


@query("""
    WITH m AS (SELECT DISTINCT l_partkey AS subject, 's' || l_suppkey AS term FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000))
    SELECT subject, array_to_string(list_sort(list(term))[1:16], ',') AS missing, count(*) AS n, count(*) > 16 AS truncated FROM m GROUP BY 1""")
def related_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string")).alias("term")
    related = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("subject"), name("l_suppkey"))
    return W.completeness(related, table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(name("s_suppkey"))).withColumn("missing", F.array_join("missing", ","))


_PLACE = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::INT"


@query(f"""
    WITH n AS (SELECT l_partkey AS card, {_PLACE} AS place, l_suppkey % 5 AS id, l_returnflag, l_orderkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY {_PLACE}) <= 18)
    SELECT card, place, CASE WHEN nth > 1 THEN id || '-' || nth ELSE id::VARCHAR END AS node_id, CASE WHEN l_returnflag = 'A' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') THEN 'model' WHEN l_returnflag = 'A' THEN 'book' ELSE 'model' END AS basis
    FROM (SELECT *, row_number() OVER (PARTITION BY card, id ORDER BY place) AS nth FROM n)""")
def card_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("card"), place.alias("place"), (F.col("l_suppkey") % 5).cast("string").alias("id"), F.when(F.col("l_returnflag") == "A", "book").otherwise("model").alias("basis"), F.col("l_orderkey").alias("evidence_id"))
    return W.normalized_nodes(nodes, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("evidence_id")))


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place, len(string_split(text, chr(10))) AS n FROM documents),
    h AS (SELECT doc_id, regexp_extract(line, '^([A-Z][a-z]+)[.]', 1) AS term, place, n FROM l WHERE regexp_matches(line, '^([A-Z][a-z]+)[.]'))
    SELECT doc_id, term, place::INT AS first_line, (coalesce(lead(place) OVER (PARTITION BY doc_id ORDER BY place), n) - 1)::INT AS last_line FROM h""")
def term_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin with a one-word sentence head a clause."""
    lines = F.split("text", "\n")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.size(lines).alias("n_lines"), F.posexplode(lines).alias("place", "line"))
    return W.clauses(rows, "^([A-Z][a-z]+)[.]")


_NEXT = "SELECT c_custkey AS id, (c_custkey * 7 + 3) % 997 AS target FROM customer UNION SELECT c_custkey, (c_custkey * 5 + 1) % 991 FROM customer WHERE c_acctbal > 5000"


@query(f"""
    WITH RECURSIVE s AS ({_NEXT}), r AS (SELECT c_custkey AS root, c_custkey AS id, 0 AS hop FROM customer WHERE c_nationkey = 3 UNION SELECT root, s.target, hop + 1 FROM r JOIN s USING (id) WHERE hop < 3),
    f AS (SELECT root, id, min(hop) AS hop FROM r GROUP BY 1, 2)
    SELECT * FROM f WHERE hop > 0 QUALIFY row_number() OVER (PARTITION BY root ORDER BY hop, id) <= 6""")
def followed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    steps = customers.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7 + 3).alias("t")).select("id", F.pmod("t", F.lit(997)).alias("target"))
    more = customers.where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"), F.pmod(F.col("c_custkey") * 5 + 1, F.lit(991)).alias("target"))
    return W.followed(steps.unionByName(more), customers.where("c_nationkey = 3").select(F.col("c_custkey").alias("id")))


@query("""
    WITH RECURSIVE n AS (SELECT DISTINCT l_orderkey AS graph, l_suppkey AS id FROM lineitem), e AS (SELECT DISTINCT l_orderkey AS graph, l_suppkey AS a, l_suppkey - (l_suppkey % 10) AS b FROM lineitem),
    u AS (SELECT graph, a AS x, b AS y FROM e WHERE (graph, b) IN (SELECT graph, id FROM n) UNION SELECT graph, b, a FROM e WHERE (graph, b) IN (SELECT graph, id FROM n)),
    s AS (SELECT graph, min(id) AS id FROM n GROUP BY 1), r AS (SELECT graph, id FROM s UNION SELECT r.graph, y FROM r JOIN u ON u.graph = r.graph AND x = id)
    SELECT n.graph, count(DISTINCT n.id) = count(DISTINCT r.id) AS connected FROM n LEFT JOIN r USING (graph) GROUP BY 1""")
def connected_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of an order are its nodes; each hangs on the first of its ten, if that is there."""
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph"), F.col("l_suppkey").alias("id")).distinct()
    edges = nodes.select("graph", F.col("id").alias("src"), (F.col("id") - F.col("id") % 10).alias("dst"))
    return W.connected(nodes, edges.join(nodes.withColumnRenamed("id", "dst"), ["graph", "dst"], "left_semi"))


@query("""
    WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < 1000 THEN (c_custkey * 3 + 1) % 1700 ELSE c_custkey // 2 END AS parent FROM customer),
    g AS (SELECT 0::BIGINT AS id UNION SELECT n.id FROM g JOIN n ON n.parent = g.id AND n.id <> n.parent)
    SELECT id, CASE WHEN id = 0 THEN NULL WHEN id IN (SELECT id FROM g) THEN parent ELSE 0 END AS parent FROM n""")
def ancestry_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    parent = F.when(F.col("c_acctbal") < 1000, F.pmod(key * 3 + 1, F.lit(1700))).otherwise(F.floor(key / 2))
    return W.rooted(table(spark, sf_dir, "customer").select(key.alias("id"), parent.alias("parent")), 0)


@query("""
    WITH n AS (SELECT l_suppkey AS id, min({'p': l_orderkey * 10 + l_linenumber, 'l': l_returnflag}) AS m FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
    e AS (SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS relation, min(l_orderkey * 10 + l_linenumber) AS place FROM lineitem GROUP BY 1, 2, 3)
    SELECT src, dst, relation, place FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def deduplicated_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("place", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    nodes = items.where("l_linestatus = 'F'").select(F.col("l_suppkey").alias("id"), "place")
    edges = items.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation"), "place")
    return G.deduplicated(nodes, edges)[1].select("src", "dst", "relation", "place")
