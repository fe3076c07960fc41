"""Policies, views, lanes and audits over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import policies as P
from ..sources.tables import table
from .catalog import query

_FOUND = "SELECT '{0}' AS corpus, p_partkey AS entry, row_number() OVER (ORDER BY {1}) AS place FROM part WHERE {2} ORDER BY place LIMIT {3}"


def _retriever(spark: SparkSession, sf_dir: str, corpus: str, fits, order: list) -> P.Retriever:
    from pyspark.sql import Window

    def find(query: str, most: int) -> DataFrame:
        rows = table(spark, sf_dir, "part").where(fits(query)).orderBy(*order).limit(most)
        return rows.select(F.lit(corpus).alias("corpus"), F.col("p_partkey").alias("entry"), F.row_number().over(Window.orderBy(*order)).alias("place"), F.concat_ws(" ", "p_name", "p_type").alias("excerpt"))

    return find


@query(f"""
    WITH a AS ({_FOUND.format('names', 'p_size DESC, p_partkey', "starts_with(p_name, 'red')", 4)}), b AS ({_FOUND.format('names', 'p_retailprice, p_partkey', "contains(p_name, 'red')", 2)}),
    u AS (SELECT *, 'words' AS branch, 0 AS b FROM a UNION ALL SELECT *, 'morphology', 1 FROM b),
    o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY corpus, entry ORDER BY b, place) = 1)
    SELECT corpus, entry, branch, row_number() OVER (ORDER BY b, place, corpus, entry) AS place FROM o QUALIFY row_number() OVER (ORDER BY b, place, corpus, entry) <= 5""")
def retrieval_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways into one collection, so that some entries are found by both."""
    words = _retriever(spark, sf_dir, "names", lambda q: F.col("p_name").startswith(q), [F.desc("p_size"), "p_partkey"])
    parts = _retriever(spark, sf_dir, "names", lambda q: F.col("p_name").contains(q), ["p_retailprice", "p_partkey"])
    return P.by_policy("word", {"words": words, "morphology": parts}, "red", 5).withColumn("place", F.col("place").cast("bigint"))


@query("""
    WITH f AS (SELECT unnest(['red widget', 'small ring', 'blue bolt']) AS q, unnest([0, 1, 2]) AS asked),
    r AS (SELECT 'names' AS corpus, p_partkey AS entry, asked, row_number() OVER (PARTITION BY asked ORDER BY p_partkey) AS place, p_size FROM f JOIN part ON p_name = q),
    u AS (SELECT * FROM r WHERE place <= 6)
    SELECT corpus, entry, asked, row_number() OVER (ORDER BY asked, place, corpus, entry) AS place FROM u QUALIFY row_number() OVER (ORDER BY asked, place, corpus, entry) <= 6""")
def connected_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    find = _retriever(spark, sf_dir, "names", lambda q: F.col("p_name") == q, ["p_partkey"])
    return P.connected_evidence("red widget", ["small ring", "red widget", "blue bolt", "new gear"], find).withColumn("place", F.col("place").cast("bigint"))


@query("""
    WITH d AS (SELECT id, count(*) AS degree FROM (SELECT l_partkey AS id FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem WHERE l_suppkey <> l_partkey) GROUP BY 1)
    SELECT p_partkey AS entity_id, p_name AS label, coalesce(degree, 0) AS degree FROM part LEFT JOIN d ON id = p_partkey WHERE p_size % 10 <> 0 AND p_type IN ('ECONOMY', 'PROMO') AND starts_with(lower(p_name), 're') ORDER BY degree DESC, lower(p_name), p_partkey LIMIT 15""")
def view_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of two types are affixes, the others roots and words."""
    kind = F.when(F.col("p_type") == "ECONOMY", "prefix").when(F.col("p_type") == "PROMO", "suffix").otherwise("term")
    entities = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("label"), kind.alias("kind"), F.when(F.col("p_size") % 10 == 0, "archived").otherwise("accepted").alias("status"))
    return P.entities_by_view(entities, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")), " Re", "affix", 15)


_ALIAS = "SELECT p_partkey AS alias, min(p_partkey) OVER (PARTITION BY p_name, p_type) AS canonical FROM part"


@query(f"""
    WITH RECURSIVE a AS ({_ALIAS}), e AS (SELECT DISTINCT coalesce(x.canonical, l_partkey) AS src, coalesce(y.canonical, l_suppkey) AS dst FROM lineitem LEFT JOIN a x ON x.alias = l_partkey LEFT JOIN a y ON y.alias = l_suppkey WHERE l_quantity > 45),
    p AS (SELECT * FROM e WHERE src <> dst), u AS (SELECT src, dst FROM p UNION SELECT dst, src FROM p),
    b AS (SELECT 7::BIGINT AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM b JOIN u ON src = id WHERE depth < 2),
    n AS (SELECT id, min(depth) AS depth FROM b GROUP BY 1 ORDER BY depth, id LIMIT 40)
    SELECT src, dst FROM p WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def view_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong edges alone; parts of equal name and type are one node. The view shows 40 nodes at most."""
    from pyspark.sql import Window

    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("alias"), F.min("p_partkey").over(Window.partitionBy("p_name", "p_type")).alias("canonical"))
    edges = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return P.view_subgraph(edges, parts, spark.createDataFrame([(7,)], "id bigint"), 2, 40)


@query("""SELECT p_partkey, CASE WHEN p_size > 45 THEN 'context' WHEN p_type = 'ECONOMY' THEN 'word' WHEN p_type = 'PROMO' THEN 'part' WHEN p_type = 'STANDARD' THEN 'language' ELSE 'other' END AS category FROM part""")
def node_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_type") == "ECONOMY", "term").when(F.col("p_type") == "PROMO", "suffix").when(F.col("p_type") == "STANDARD", "translation").otherwise("unknown kind")
    return table(spark, sf_dir, "part").select("p_partkey", P.categories(kind, F.col("p_size") > 45).alias("category"))


@query("""SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '3-MEDIUM' ORDER BY o_custkey % 5 <> 0, o_totalprice < 100000, o_orderdate, o_orderkey LIMIT 1""")
def history_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("lane"), F.when(F.col("o_custkey") % 5 == 0, "term:x").otherwise("card:x").alias("subject_key"), (F.col("o_totalprice") < 100000).alias("priority"), F.col("o_orderdate").alias("created_at"), "o_orderstatus")
    return P.of_lane(jobs.where("o_orderstatus = 'O'"), "3-MEDIUM", 10**9, jobs.where("o_orderstatus = 'P'")).select("job_id")


@query(r"""SELECT doc_id FROM documents WHERE CASE lang WHEN 'en' THEN regexp_matches(text, '[Ll]icense') WHEN 'fr' THEN regexp_matches(text, 'Licensed') ELSE false END AND list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), CASE lang WHEN 'en' THEN 'the' ELSE 'apache' END)""")
def eligible_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("mode"), "text", F.when(F.col("lang") == "en", "The").otherwise("Apache").alias("headword"))
    return P.eligible_sources(rows, {"en": "[Ll]icense", "fr": "Licensed"}).select("doc_id")


@query("""
    WITH a AS (SELECT s_nationkey AS subject, s_suppkey % 7 AS form, s_suppkey AS id FROM supplier WHERE s_acctbal > 0),
    o AS (SELECT subject, form, min(id) AS own FROM a GROUP BY 1, 2 HAVING count(*) = 1), g AS (SELECT form, min(id) AS general FROM a GROUP BY 1 HAVING count(*) = 1)
    SELECT c_custkey, coalesce(own, general) AS component_id FROM customer LEFT JOIN o ON o.subject = c_nationkey AND o.form = c_custkey % 7 LEFT JOIN g ON g.form = c_custkey % 7""")
def canonical_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("subject"), (F.col("s_suppkey") % 7).alias("form"), F.lit("root").alias("kind"), F.col("s_suppkey").alias("component_id"))
    parts = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("subject"), (F.col("c_custkey") % 7).alias("form"), F.lit("root").alias("kind"))
    return P.canonical_parts(parts, accepted).select("c_custkey", "component_id")


@query("""
    SELECT o_orderkey AS card_id, CASE WHEN o_orderstatus = 'P' THEN 'no-draft' WHEN o_orderpriority = '1-URGENT' THEN 'damaged' WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'no-record' ELSE 'sound' END AS state FROM orders""")
def pseudocard_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    payload = F.concat(F.lit('{"record_id": "'), F.col("o_custkey").cast("string"), F.lit('", "parts": ['), F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise("1"), F.lit("]}"))
    drafts = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("card_id"), payload.alias("payload"))
    return P.pseudocards(orders.select(F.col("o_orderkey").alias("card_id")), drafts, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("record_id")))


@query("SELECT l_suppkey AS component, count(*) AS members, bool_and(l_suppkey % 2 = l_partkey % 2) AS same_form_only, count(*) FILTER (l_linestatus = 'O') AS history, count(*) FILTER (l_returnflag = 'N') AS proposals FROM lineitem GROUP BY 1")
def component_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis = F.when(F.col("l_returnflag") == "N", "model").otherwise("book")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("component"), (F.col("l_suppkey") % 2).alias("form"), (F.col("l_partkey") % 2).alias("member_form"), F.when(F.col("l_linestatus") == "O", "history").otherwise("word").alias("kind"), basis.alias("basis"))
    return P.component_integrity(rows)


@query("""SELECT DISTINCT l_orderkey || '-' || l_linenumber AS claim_id FROM lineitem JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_suppkey WHERE a.p_name = b.p_name""")
def definition_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("claim_id"), F.col("l_partkey").alias("component_id"), F.col("l_suppkey").alias("meaning_id"))
    parts = table(spark, sf_dir, "part")
    return P.equal_definitions(claims, parts.select(F.col("p_partkey").alias("component_id"), F.upper("p_name").alias("text")), parts.select(F.col("p_partkey").alias("meaning_id"), F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   "))).alias("text")))


@query("SELECT DISTINCT l_suppkey AS evidence_id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def context_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct evidence of some entities that is there."""
    wanted = table(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"))
    known = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("evidence_id"))
    return table(spark, sf_dir, "lineitem").join(wanted, "l_partkey", "left_semi").select(F.col("l_suppkey").alias("evidence_id")).distinct().join(known, "evidence_id", "left_semi")


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{00AD}\x00]', '', 'g'), '\r\n?|\f', chr(10), 'g'), '(\p{Ll})-[ \t]*\n[ \t]*(\p{Ll})', '\1\2', 'g'), '\s+([,.;:!?%)\]])', '\1', 'g'), '([(\[])\s+', '\1', 'g'), '\s+', ' ', 'g'))) AS shown
    FROM documents WHERE NOT contains(text, '\') AND NOT regexp_matches(text, '[_^]\{')""")
def display_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without TeX, as they would be shown."""
    rows = table(spark, sf_dir, "documents").where(~F.col("text").contains("\\") & ~F.col("text").rlike(r"[_^]\{"))
    return rows.select("doc_id", F.md5(T.display_text(F.col("text")).cast("binary")).alias("shown"))


@query("""
    SELECT 'accepted claim without order' AS check, count(*) AS value FROM lineitem WHERE l_linestatus = 'F' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'claim and edge differ', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'N')
    UNION ALL SELECT 'slot with two winners', count(*) FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1)
    UNION ALL SELECT 'repeated claim', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey HAVING count(*) > 1)
    UNION ALL SELECT 'endpoint not accepted', count(*) FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size % 10 = 0)
    UNION ALL SELECT 'model claim with confidence', count(*) FROM lineitem WHERE l_returnflag = 'N' AND l_discount > 0.09
    UNION ALL SELECT 'loop', count(*) FROM lineitem WHERE l_partkey = l_suppkey
    UNION ALL SELECT 'customer of no nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
    UNION ALL SELECT 'nation of no region', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)
    UNION ALL SELECT 'turn without role', count(*) FROM conversations WHERE role IS NULL
    UNION ALL SELECT 'page without address', count(*) FROM pages WHERE url IS NULL
    UNION ALL SELECT 'label out of range', count(*) FROM labels WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)""")
def finalisation_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold before a migration counts as done, as rows of a check and how often it fails."""
    from ..operators import relational as R

    t = lambda n: table(spark, sf_dir, n)
    items = t("lineitem")
    pairs = lambda df: df.select("l_partkey", "l_suppkey").distinct()
    claims, edges = pairs(items.where("l_linestatus = 'F'")), pairs(items.where("l_returnflag <> 'N'"))
    archived = t("part").where("p_size % 10 = 0").select(F.col("p_partkey").alias("l_partkey"))
    return R.checks(
        ("accepted claim without order", R.orphans(items.where("l_linestatus = 'F'"), "l_orderkey", t("orders"), "o_orderkey")),
        ("claim and edge differ", claims.join(edges, ["l_partkey", "l_suppkey"], "left_anti")),
        ("slot with two winners", R.duplicates(t("orders").where("o_orderstatus = 'F'"), "o_custkey", "o_orderpriority")),
        ("repeated claim", R.duplicates(items, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")),
        ("endpoint not accepted", items.join(archived, "l_partkey", "left_semi")),
        ("model claim with confidence", items.where("l_returnflag = 'N' and l_discount > 0.09")),
        ("loop", items.where("l_partkey = l_suppkey")),
        ("customer of no nation", R.orphans(t("customer"), "c_nationkey", t("nation"), "n_nationkey")),
        ("nation of no region", R.orphans(t("nation"), "n_regionkey", t("region"), "r_regionkey")),
        ("turn without role", t("conversations").where("role is null")),
        ("page without address", t("pages").where("url is null")),
        ("label out of range", t("labels").where("quality not in (0, 1) or toxic not in (0, 1)")),
    )


@query("""
    WITH d AS (SELECT doc_id AS card_id, coalesce(lang, '') AS mode, coalesce(source, '') AS branch, list_filter([CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' END, CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN quality = 0 THEN 'poor' END], lambda x: x IS NOT NULL) AS v FROM documents LEFT JOIN labels USING (doc_id))
    SELECT card_id, CASE WHEN len(v) > 0 THEN 'rejected' WHEN row_number() OVER (PARTITION BY mode, branch, len(v) = 0 ORDER BY card_id DESC) > 1 THEN 'superseded' ELSE 'accepted' END AS status, array_to_string(v, ',') AS violations FROM d""")
def card_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as drafts: what passes the gate is published, and stands in for older cards of its language and source."""
    text = F.col("text")
    drafts = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("doc_id").alias("card_id"), F.col("doc_id").alias("created_at"), F.coalesce("lang", F.lit("")).alias("mode"), F.coalesce("source", F.lit("")).alias("branch"), "text", "quality")
    rules = {"empty": text.isNull() | (F.trim(text) == ""), "short": F.length(text) < 200, "poor": F.col("quality") == 0}
    return P.published(drafts, rules, "mode", "branch").withColumn("violations", F.array_join("violations", ","))
