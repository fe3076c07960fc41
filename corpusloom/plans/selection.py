"""Lookups, gates and balance over the test tables; parts, orders, events and pages stand for the collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import selection as S
from ..sources.tables import table
from .catalog import query


@query("SELECT p_partkey, p_type FROM part WHERE p_name = 'red widget' AND p_size > 5 ORDER BY length(p_type) DESC, p_size, p_partkey LIMIT 12")
def exact_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.length("p_type").desc(), "p_size", "p_partkey"]
    return S.exact(table(spark, sf_dir, "part"), ["p_name"], "red widget", order, 12, F.col("p_size") > 5).select("p_partkey", "p_type")


@query("SELECT p_partkey FROM part WHERE p_name = 'small ring' OR p_type = 'small ring' ORDER BY p_size < 25 DESC, p_partkey LIMIT 20")
def form_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.exact(table(spark, sf_dir, "part"), ["p_name", "p_type"], "small ring", [(F.col("p_size") < 25).desc(), "p_partkey"], 20).select("p_partkey")


@query("SELECT DISTINCT p_name AS headword, p_type AS translation FROM part WHERE p_brand = 'Brand#2' ORDER BY 1, 2 LIMIT 8")
def bilingual_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("headword"), F.col("p_type").alias("translation")).distinct()
    return S.exact(pairs, ["p_brand"], "Brand#2", ["headword", "translation"], 8).select("headword", "translation")


@query("SELECT p_partkey FROM part WHERE translate(p_brand, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = 'brand#7'")
def nocase_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(S.ascii_key(F.col("p_brand")) == S.ascii_key(F.lit("BRAND#7"))).select("p_partkey")


@query("SELECT unnest([4, 1, 3, 1]) AS n_nationkey, unnest(range(4)) AS place, unnest(['NATION_4', 'NATION_1', 'NATION_3', 'NATION_1']) AS n_name")
def ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.in_order_of(table(spark, sf_dir, "nation"), "n_nationkey", [4, 1, 3, 1]).select("n_nationkey", F.col("place").cast("bigint").alias("place"), "n_name")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN (props->>'k')::INT < 10 THEN 0 ELSE 1 END WHEN event_type = 'signup' THEN 0 ELSE 1 END AS eligible FROM events""")
def rotation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events show graphs, of one node if k is under 10; signups have damaged JSON."""
    k = F.get_json_object("props", "$.k").cast("int")
    graph = F.concat(F.lit('{"projection": 2, "nodes": ['), F.when(k < 10, "1").otherwise("1, 2"), F.lit('], "edges": []}'))
    payload = F.when(F.col("event_type") == "error", graph).when(F.col("event_type") == "signup", F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", S.rotation_eligible(payload, F.col("event_type"), "error").alias("eligible"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE (l_returnflag = 'R' OR l_returnflag = 'A' AND l_linestatus = 'O') AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def live_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    relation = F.when(F.col("l_returnflag") == "R", "has-component").when(F.col("l_returnflag") == "A", "shares-component").otherwise("renders-as")
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), "l_linenumber", "l_partkey", "l_suppkey", relation.alias("relation"), F.when(F.col("l_linestatus") == "O", "partial").otherwise("complete").alias("scope"))
    supports = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("retired").alias("status"))
    return S.live_components(claims, supports).select(F.col("claim_id").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT p_partkey FROM part WHERE (p_name, p_brand, p_type, p_size) IN (SELECT p_name, p_brand, p_type, p_size FROM part WHERE p_retailprice < 905) OR starts_with(p_type, 'ECO') OR starts_with(p_type, 'PRO')""")
def semantic_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return S.bound_or_intended(parts, parts.where("p_retailprice < 905"), ["p_name", "p_brand", "p_type", "p_size"], "p_type", ["ECO", "PRO"]).select("p_partkey")


@query("SELECT page_id FROM pages WHERE url IS NULL OR NOT (starts_with(url, 'http://') OR starts_with(url, 'https://m.'))")
def external_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(S.begins_with_none(F.col("url"), ["http://", "https://m."])).select("page_id")


@query(r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' END, CASE WHEN length(text) < 40 THEN 'short' END, CASE WHEN lang IS NULL THEN 'language' END, CASE WHEN regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') THEN 'private key' END], lambda x: x IS NOT NULL), ',') AS violations FROM documents""")
def publication_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rules = {"empty": text.isNull() | (F.trim(text) == ""), "short": F.length(text) < 40, "language": F.col("lang").isNull(), "private key": text.rlike(T.PRIVATE_KEY)}
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(S.violations(rules), ",").alias("violations"))


_NODE = "SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'term' ELSE 'meaning' END AS kind FROM part"


@query(f"""
    WITH n AS (SELECT id FROM ({_NODE}) WHERE kind = 'term'),
    e AS (SELECT l_partkey AS source, l_suppkey AS target FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_partkey IN (FROM n) AND l_suppkey IN (FROM n))
    SELECT id, (SELECT count(*) FROM e) AS edges FROM n WHERE id IN (SELECT source FROM e UNION SELECT target FROM e)""")
def filtered_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, "term").otherwise("meaning").alias("kind"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("basis"))
    kept, links = S.filtered_graph(nodes, edges, ["term"], ["R", "A"])
    return kept.select("id").crossJoin(F.broadcast(links.agg(F.count(F.lit(1)).alias("edges"))))  # one row


@query("""
    WITH ids AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0)
    SELECT * FROM (SELECT o_custkey AS id, 'orders.o_custkey' AS place, count(*) AS "references" FROM orders GROUP BY 1 UNION ALL SELECT l_suppkey, 'lineitem.l_suppkey', count(*) FROM lineitem GROUP BY 1 UNION ALL SELECT l_partkey, 'lineitem.l_partkey', count(*) FROM lineitem GROUP BY 1)
    WHERE id IN (FROM ids)""")
def reference_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"orders": (table(spark, sf_dir, "orders"), ["o_custkey"]), "lineitem": (table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"])}
    return S.reference_counts(tables, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")))


@query("""SELECT 'export' AS scope, id FROM (SELECT c_custkey::VARCHAR AS id FROM customer UNION SELECT s_suppkey::VARCHAR FROM supplier UNION SELECT l_partkey::VARCHAR FROM lineitem UNION SELECT o_orderpriority FROM orders UNION SELECT n_name FROM nation UNION SELECT event_type FROM events)""")
def ownership_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name, column: table(spark, sf_dir, name).select(column)
    return S.owned("export", of("customer", "c_custkey"), of("supplier", "s_suppkey"), of("lineitem", "l_partkey"), of("orders", "o_orderpriority"), of("nation", "n_name"), of("events", "event_type"))


@query("""
    WITH c AS (SELECT o_orderpriority AS mode, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    k AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-NEVER']) AS mode, unnest(range(6)) AS i)
    SELECT mode, coalesce(n, 0) AS n, row_number() OVER (ORDER BY coalesce(n, 0), (i - 3 + 6) % 6) AS place FROM k LEFT JOIN c USING (mode)""")
def mode_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("mode")).agg(F.count(F.lit(1)).alias("n"))
    out = S.by_balance(counts, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER"], 3)
    return out.withColumn("place", F.col("place").cast("bigint"))


@query("""SELECT o_orderpriority AS mode FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F') < count(*) ORDER BY count(*) FILTER (o_orderstatus = 'F') / count(*), 1 LIMIT 1""")
def least_complete_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    progress = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("mode")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count(F.lit(1)).alias("total"))
    return S.least_complete(progress.withColumn("place", F.col("mode"))).select("mode")


_FRONTIER = """
    known AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 49),
    f AS (SELECT l_suppkey AS id, l_partkey AS neighbour, l_returnflag AS family, l_discount AS confidence FROM lineitem WHERE l_partkey IN (FROM known) AND l_suppkey NOT IN (FROM known) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)),
    ranked AS (SELECT id, count(DISTINCT neighbour) AS links, count(DISTINCT family) AS families, max(confidence) AS best, min(neighbour) AS nearest FROM f GROUP BY 1)"""


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    edges = items.select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("family"), F.col("l_discount").alias("confidence"))
    known = items.where("l_quantity > 49").select(F.col("l_partkey").alias("id")).distinct()
    return S.frontier(edges, known, table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("id")))


@query(f"WITH {_FRONTIER} SELECT * FROM ranked")
def graph_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frontier(spark, sf_dir)


@query(f"WITH {_FRONTIER}, m AS (SELECT *, CASE WHEN best >= 0.1 THEN 'meaning' WHEN best >= 0.09 THEN 'origin' ELSE 'component' END AS family FROM ranked WHERE families = (SELECT max(families) FROM ranked)) SELECT id FROM m ORDER BY list_position(['component', 'meaning', 'origin'], family), nearest, id LIMIT 1")
def frontier_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.when(F.col("best") >= 0.1, "meaning").when(F.col("best") >= 0.09, "origin").otherwise("component")
    rows = _frontier(spark, sf_dir).select("id", F.col("families").alias("covered"), family.alias("family"), F.col("nearest").alias("place"))
    return S.next_of_frontier(rows, 5, ["meaning", "origin", "component"]).select("id")


@query("""
    WITH d AS (SELECT DISTINCT c_mktsegment || '/' || c_nationkey AS collection, md5(c_custkey::VARCHAR) AS h FROM customer),
    g AS (SELECT collection, list_sort(list(h))[1:16] AS members, count(*) AS n FROM d GROUP BY 1)
    SELECT collection, array_to_string(members, ',') AS members, n, n > 16 AS members_cut, (SELECT count(*) FROM g) > 64 AS groups_cut FROM g ORDER BY collection LIMIT 64""")
def capped_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("collection"), F.md5(F.col("c_custkey").cast("string").cast("binary")).alias("h"))
    return S.capped_rollup(rows, "collection", "h").withColumn("members", F.array_join("members", ","))


@query("""
    WITH w AS (SELECT o_custkey AS subject, o_orderpriority AS input, min(o_orderdate) AS due FROM orders GROUP BY 1, 2),
    d AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'),
    l AS (SELECT subject, array_to_string(list_sort(list(DISTINCT input)), ',') AS missing, min(due) AS since FROM w WHERE (subject, input) NOT IN (FROM d) GROUP BY 1)
    SELECT c_custkey AS subject, missing IS NULL AS complete, coalesce(missing, '') AS missing, since FROM customer LEFT JOIN l ON subject = c_custkey""")
def completion_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    wanted = orders.select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("input"), F.col("o_orderdate").alias("due"))
    done = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("input"))
    return S.completion(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject")), wanted, done).withColumn("missing", F.array_join("missing", ","))


@query("""SELECT DISTINCT s_name AS left_word, c_name AS right_word, s_nationkey AS ili FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE s_acctbal > 5000 AND c_acctbal > 9000""")
def sense_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers of a nation share a sense; only those with means speak here."""
    left = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_name").alias("word"), F.col("s_nationkey").alias("ili"))
    return S.senses_aligned(left, table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_name").alias("word"), F.col("c_nationkey").alias("ili"))).select("left_word", "right_word", "ili")


@query("""
    WITH r AS (SELECT unnest(['en', 'de', 'fr-ca']) AS tag, unnest(['English', 'German', 'Canadian French']) AS profile),
    t AS (SELECT doc_id, lower(coalesce(lang, 'xx') || CASE WHEN source IS NULL THEN '' ELSE '-CA' END) AS tag FROM documents)
    SELECT doc_id, coalesce(a.profile, b.profile, 'ad-hoc:' || t.tag) AS profile FROM t LEFT JOIN r a ON a.tag = t.tag LEFT JOIN r b ON b.tag = split_part(t.tag, '-', 1)""")
def language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame([("en", "English"), ("de", "German"), ("fr-ca", "Canadian French")], "tag string, profile string")
    tag = F.concat(F.coalesce("lang", F.lit("xx")), F.when(F.col("source").isNull(), "").otherwise("-CA"))
    return S.language_profile(table(spark, sf_dir, "documents").select("doc_id", tag.alias("t")), registry, "t").select("doc_id", "profile")


@query("""
    WITH f AS (SELECT p_partkey AS form_id, p_brand AS form, string_split(p_name, ' ') AS gloss FROM part),
    l AS (SELECT DISTINCT p_brand AS form, CASE WHEN p_size > 40 THEN 'root' ELSE 'affix' END AS kind, string_split(p_name, ' ')[1:1] AS said FROM part WHERE p_size > 37),
    s AS (SELECT form_id, kind, CASE WHEN len(list_filter(gloss, lambda g: NOT list_contains(said, g))) = 0 THEN 0.99 WHEN len(list_filter(said, lambda g: NOT list_contains(gloss, g))) = 0 THEN 0.95 END AS score FROM f JOIN l USING (form)),
    t AS (SELECT form_id, count(DISTINCT kind) AS kinds, min(kind) AS kind, max(score)::DOUBLE AS score FROM s WHERE score IS NOT NULL GROUP BY 1)
    SELECT form_id, CASE WHEN kinds = 1 THEN 'declared' WHEN kinds > 1 THEN 'ambiguous' ELSE 'unknown' END AS state, CASE WHEN kinds = 1 THEN kind END AS kind, CASE WHEN kinds = 1 THEN score END AS score FROM f LEFT JOIN t USING (form_id)""")
def declaration_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are glosses of two words; declarations, of one, fit with 0.95 at most."""
    parts = table(spark, sf_dir, "part")
    forms = parts.select(F.col("p_partkey").alias("form_id"), F.col("p_brand").alias("form"), F.split("p_name", " ").alias("gloss"))
    lexicon = parts.where("p_size > 37").select(F.col("p_brand").alias("form"), F.when(F.col("p_size") > 40, "root").otherwise("affix").alias("kind"), F.slice(F.split("p_name", " "), 1, 1).alias("gloss")).distinct()
    return S.declared(forms, lexicon)


@query("""
    WITH d AS (SELECT p_partkey AS id, count(l_orderkey) AS n, count(*) FILTER (l_linestatus = 'F') AS live, count(*) FILTER (l_returnflag = 'N') AS model FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1),
    c AS (SELECT id, CASE WHEN n = 0 THEN 'isolate' WHEN live = 0 THEN 'retired only' WHEN model = n THEN 'model only' WHEN n > 32 THEN 'hub' WHEN live = n THEN 'all live' ELSE 'mixed' END AS category FROM d)
    SELECT category, count(*) AS n, array_to_string(list_sort(list(id))[1:3], ',') AS examples FROM c GROUP BY 1""")
def isolate_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("live"), F.count_if(F.col("l_returnflag") == "N").alias("model"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).join(items, "id", "left").na.fill(0)
    cascade = {"isolate": F.col("n") == 0, "retired only": F.col("live") == 0, "model only": F.col("model") == F.col("n"), "hub": F.col("n") > 32, "all live": F.col("live") == F.col("n")}
    return S.first_category(rows, "id", cascade, 3, "mixed").withColumn("examples", F.array_join("examples", ","))


@query("""
    WITH s AS (SELECT l_partkey AS id, list_sort(list(DISTINCT l_suppkey)) AS e FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    t AS (SELECT l_partkey AS id, list_sort(list(DISTINCT l_suppkey)) AS e FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 25 GROUP BY 1)
    SELECT id, array_to_string(s.e, ',') AS evidence FROM s JOIN t USING (id) WHERE s.e = t.e""")
def formula_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("evidence_id"), "l_returnflag", "l_linestatus", "l_quantity")
    return S.agreeing_evidence(items.where("l_returnflag = 'R'"), items.where("l_linestatus = 'F' and l_quantity > 25")).withColumn("evidence", F.array_join("evidence", ","))


@query(r"""SELECT p.page_id FROM pages p WHERE contains(regexp_replace(trim(lower(html)), '\s+', ' ', 'g'), 'track') AND contains(regexp_replace(trim(lower(html)), '\s+', ' ', 'g'), regexp_extract(url, '/([a-z]{2})/', 1)) AND regexp_extract(url, '/([a-z]{2})/', 1) <> ''""")
def history_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").withColumn("a", F.lit(" Track ")).withColumn("b", F.regexp_extract("url", "/([a-z]{2})/", 1))
    return S.both_named(rows, "html", "a", "b").select("page_id")


@query("SELECT DISTINCT l_partkey AS entry FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'R'")
def published_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("card_id")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("corpus"), F.col("l_partkey").alias("entry"))).alias("evidence"))
    cards = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("card_id"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("open").alias("status")).join(items, "card_id")
    return S.published_ids(cards, "evidence", "R")


@query("""SELECT p_name || '/' || p_brand AS key, count(*) AS pairs, min(o_orderkey) AS first_order FROM part JOIN orders ON p_name || '/' || p_brand = CASE o_orderpriority WHEN '1-URGENT' THEN 'red widget' WHEN '2-HIGH' THEN 'small ring' ELSE 'blue bolt' END || '/Brand#' || (o_custkey % 25 + 1) GROUP BY 1""")
def computed_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key put together on one side, and one that follows from a case on the other."""
    parts = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_name", "p_brand").alias("key"))
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "red widget").when(F.col("o_orderpriority") == "2-HIGH", "small ring").otherwise("blue bolt")
    orders = table(spark, sf_dir, "orders").select(F.concat(name, F.lit("/Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("key"), "o_orderkey")
    return parts.join(orders, "key").groupBy("key").agg(F.count(F.lit(1)).alias("pairs"), F.min("o_orderkey").alias("first_order"))


@query("""SELECT a.l_orderkey, a.l_partkey, a.l_suppkey, a.l_linenumber, count(*) AS n FROM lineitem a JOIN (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') b
    ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber = b.l_linenumber GROUP BY ALL""")
def composite_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    items = table(spark, sf_dir, "lineitem")
    return items.join(items.where("l_returnflag = 'R'").select(*keys).distinct(), keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, user_id, extract(hour FROM ts)::INT AS hour, count(*) AS n, min(value) AS least FROM events GROUP BY 1, 2, 3")
def multi_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"))
