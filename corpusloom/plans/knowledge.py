"""Questions to the claim graph. Parts stand for terms, suppliers for meanings, customers for translations; line items claim
that they belong together, and orders are the records that such a claim rests on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import knowledge as K
from ..sources.tables import table
from .catalog import query

_BASIS = "CASE l_returnflag WHEN 'R' THEN 'reviewed' WHEN 'A' THEN 'book' ELSE 'model' END"
_RELATION = "CASE l_linenumber % 3 WHEN 0 THEN 'has-meaning' WHEN 1 THEN 'has-translation' ELSE 'renders-as' END"
_LANGUAGE = "CASE {0} % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'und' END"

#: The graph, its gates and canonical subjects, for every query here.
GRAPH_SQL = f"""
    WITH ent AS (
        SELECT 't' || p_partkey AS entity_id, 'term' AS kind, CASE WHEN p_size % 10 = 0 THEN 'archived' ELSE 'accepted' END AS status, p_name || ' ' || p_brand AS label, {_LANGUAGE.format('p_size')} AS language FROM part
        UNION ALL SELECT 'm' || s_suppkey, 'meaning', CASE WHEN s_nationkey % 12 = 0 THEN 'archived' ELSE 'accepted' END, s_name, 'en' FROM supplier
        UNION ALL SELECT 'x' || c_custkey, 'translation', CASE WHEN c_acctbal < 0 THEN 'archived' ELSE 'accepted' END, c_mktsegment || ' ' || c_custkey, {_LANGUAGE.format('c_nationkey')} FROM customer),
    clm AS (
        SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS claim_id, 't' || l_partkey AS subject_id, {_RELATION} AS relation,
               CASE WHEN l_linenumber % 3 = 2 THEN 'm' || l_suppkey ELSE 't' || l_partkey END AS source_id,
               CASE WHEN l_linenumber % 3 = 0 THEN 'm' || l_suppkey ELSE 'x' || o_custkey END AS target_id,
               {_BASIS} AS basis, l_discount AS confidence, CASE l_linestatus WHEN 'F' THEN 'accepted' ELSE 'retired' END AS status, l_orderkey
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    evi AS (SELECT claim_id, 'e' || (l_orderkey + i) AS evidence_id FROM clm, (VALUES (0), (1)) AS v(i)),
    rec AS (SELECT 'e' || o_orderkey AS evidence_id, o_orderpriority AS excerpt FROM orders WHERE o_orderstatus <> 'P'),
    ok AS (SELECT entity_id FROM ent WHERE status = 'accepted'),
    acc AS (SELECT * FROM clm WHERE status = 'accepted' AND subject_id IN (FROM ok) AND source_id IN (FROM ok) AND target_id IN (FROM ok)),
    res AS (SELECT DISTINCT claim_id, evidence_id FROM evi WHERE evidence_id IN (SELECT evidence_id FROM rec)),
    gr AS (SELECT * FROM acc WHERE basis <> 'model' AND claim_id IN (SELECT claim_id FROM res)),
    best AS (SELECT target_id, subject_id FROM gr QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY confidence DESC, subject_id) = 1),
    can AS (SELECT e.entity_id, CASE WHEN kind = 'term' THEN e.entity_id ELSE coalesce(b.subject_id, e.entity_id) END AS subject_id FROM ent e LEFT JOIN best b ON b.target_id = e.entity_id WHERE e.status = 'accepted')"""


def graph(spark: SparkSession, sf_dir: str) -> K.Graph:
    read = lambda name: table(spark, sf_dir, name)
    text = lambda mark, name: F.concat(F.lit(mark), F.col(name).cast("string"))
    language = lambda name: F.when(F.col(name) % 3 == 0, "en").when(F.col(name) % 3 == 1, "de").otherwise("und")
    status = lambda gone: F.when(gone, "archived").otherwise("accepted").alias("status")
    entities = read("part").select(text("t", "p_partkey").alias("entity_id"), F.lit("term").alias("kind"), status(F.col("p_size") % 10 == 0), F.concat_ws(" ", "p_name", "p_brand").alias("label"), language("p_size").alias("language"))
    entities = entities.unionByName(read("supplier").select(text("m", "s_suppkey").alias("entity_id"), F.lit("meaning").alias("kind"), status(F.col("s_nationkey") % 12 == 0), F.col("s_name").alias("label"), F.lit("en").alias("language")))
    entities = entities.unionByName(read("customer").select(text("x", "c_custkey").alias("entity_id"), F.lit("translation").alias("kind"), status(F.col("c_acctbal") < 0), F.concat_ws(" ", "c_mktsegment", F.col("c_custkey").cast("string")).alias("label"), language("c_nationkey").alias("language")))
    items = read("lineitem").join(read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    kind = F.col("l_linenumber") % 3
    claims = items.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("claim_id"), text("t", "l_partkey").alias("subject_id"),
        F.when(kind == 2, text("m", "l_suppkey")).otherwise(text("t", "l_partkey")).alias("source_id"), F.when(kind == 0, text("m", "l_suppkey")).otherwise(text("x", "o_custkey")).alias("target_id"),
        F.when(kind == 0, "has-meaning").when(kind == 1, "has-translation").otherwise("renders-as").alias("relation"),
        F.when(F.col("l_returnflag") == "R", "reviewed").when(F.col("l_returnflag") == "A", "book").otherwise("model").alias("basis"), F.col("l_discount").alias("confidence"), F.when(F.col("l_linestatus") == "F", "accepted").otherwise("retired").alias("status"), "l_orderkey",
    )
    evidence = claims.select("claim_id", F.explode(F.array(F.col("l_orderkey"), F.col("l_orderkey") + 1)).alias("n")).select("claim_id", text("e", "n").alias("evidence_id"))
    records = read("orders").where("o_orderstatus <> 'P'").select(text("e", "o_orderkey").alias("evidence_id"), F.col("o_orderpriority").alias("excerpt"))
    return K.Graph(entities, claims.drop("l_orderkey"), evidence, records)


ASKED, LANGUAGE, LIMIT = "red w", "en", 10
_MATCH = f"CASE WHEN l = '{ASKED}' THEN 0 WHEN starts_with(l, '{ASKED}') THEN 1 ELSE 2 END"
_CANDIDATES = f"""{GRAPH_SQL},
    low AS (SELECT entity_id, kind, language, lower(label) AS l FROM ent WHERE status = 'accepted'),
    hit AS (SELECT *, {_MATCH} AS match_rank, list_position(['term', 'meaning', 'translation'], kind) AS kind_order FROM low WHERE contains(l, '{ASKED}')),
    cut AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY match_rank, kind ORDER BY l, entity_id) <= CASE WHEN match_rank < 2 THEN {4 * LIMIT} ELSE {2 * LIMIT} END),
    placed AS (SELECT cut.*, can.subject_id, row_number() OVER (ORDER BY match_rank, language <> '{LANGUAGE}', kind_order, l, entity_id) AS n FROM cut JOIN can USING (entity_id)),
    first AS (SELECT *, row_number() OVER (ORDER BY n) AS place FROM (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY n) = 1) QUALIFY place <= {LIMIT})"""


def _facts_sql(subjects: str) -> str:
    return f"""
    said AS (SELECT gr.subject_id, relation, target_id, label, language, max(confidence) AS confidence FROM gr JOIN ent ON entity_id = target_id WHERE gr.subject_id IN (SELECT subject_id FROM {subjects}) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY subject_id, relation ORDER BY language <> '{LANGUAGE}', confidence DESC, label, target_id) AS place FROM said),
    fact AS (SELECT subject_id, relation, string_agg(label, '|' ORDER BY place) FILTER (place <= 8) AS labels, max(place) > 8 AS truncated FROM ranked GROUP BY 1, 2)"""


@query(f"{GRAPH_SQL} SELECT claim_id, relation, basis FROM acc")
def accepted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.accepted_claims(graph(spark, sf_dir)).select("claim_id", "relation", "basis")


@query(f"{GRAPH_SQL} SELECT claim_id, relation, basis FROM gr")
def grounded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.grounded_claims(graph(spark, sf_dir)).select("claim_id", "relation", "basis")


@query(f"""{GRAPH_SQL} SELECT DISTINCT claim_id, entity_id AS "end" FROM clm JOIN ent ON entity_id IN (subject_id, source_id, target_id) WHERE clm.status = 'accepted' AND ent.status <> 'accepted'""")
def claims_with_unaccepted_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.claims_with_unaccepted_ends(graph(spark, sf_dir))


@query(f"{GRAPH_SQL} SELECT * FROM can")
def grounded_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.canonical_subjects(graph(spark, sf_dir))


@query(f"{_CANDIDATES} SELECT place, subject_id, entity_id, match_rank FROM first")
def search_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.candidates(graph(spark, sf_dir), ASKED, LANGUAGE, LIMIT)


@query(f"{GRAPH_SQL}, {_facts_sql('can')} SELECT * FROM fact")
def term_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    found = K.facts(g, K.canonical_subjects(g), LANGUAGE)
    return found.withColumn("labels", F.array_join("labels", "|"))


@query(f"""{_CANDIDATES},
    named AS (SELECT * FROM clm WHERE subject_id IN (SELECT subject_id FROM first)),
    held AS (SELECT claim_id, list_sort(list(DISTINCT evidence_id)) AS ids FROM res JOIN named USING (claim_id) WHERE basis <> 'model' GROUP BY 1)
    SELECT n.claim_id, s.label AS subject, relation, t.label AS target, basis, n.status, n.claim_id IN (SELECT claim_id FROM gr) AS grounded,
           coalesce(array_to_string(ids[1:8], ','), '') AS evidence, coalesce(len(ids), 0)::BIGINT AS evidence_count
    FROM named n LEFT JOIN held USING (claim_id) LEFT JOIN ent s ON s.entity_id = subject_id LEFT JOIN ent t ON t.entity_id = target_id""")
def claim_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    own = g.claims.join(K.candidates(g, ASKED, LANGUAGE, LIMIT).select("subject_id"), "subject_id", "left_semi")
    return K.trace(g, own).withColumn("evidence", F.array_join("evidence", ","))


@query(f"""{_CANDIDATES}, {_facts_sql('first')},
    told AS (SELECT subject_id, string_agg(relation || '=' || labels, ';' ORDER BY relation || '=' || labels) AS facts FROM fact GROUP BY 1),
    own AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY confidence DESC, claim_id) AS nth FROM gr WHERE subject_id IN (SELECT subject_id FROM first)),
    behind AS (SELECT subject_id, count(DISTINCT evidence_id) AS evidence, count(DISTINCT claim_id) AS claims FROM own JOIN res USING (claim_id) WHERE nth <= 32 GROUP BY 1),
    more AS (SELECT subject_id, max(nth) > 32 AS truncated FROM own GROUP BY 1),
    out AS (SELECT place, subject_id, label, coalesce(facts, '') AS facts, coalesce(claims, 0) AS claims, coalesce(evidence, 0) AS evidence, coalesce(truncated, false) AS truncated
            FROM first LEFT JOIN ent ON ent.entity_id = subject_id LEFT JOIN told USING (subject_id) LEFT JOIN behind USING (subject_id) LEFT JOIN more USING (subject_id))
    SELECT *, sha256(subject_id || chr(31) || facts || chr(31) || claims || chr(31) || evidence) AS fingerprint FROM out""")
def private_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.answer(graph(spark, sf_dir), ASKED, LANGUAGE, LIMIT).withColumn("facts", F.array_join("facts", ";"))


@query(f"""{GRAPH_SQL},
    both_ways AS (SELECT source_id AS subject_id, 'out' AS direction, relation, target_id AS other_id, claim_id FROM acc WHERE source_id <> target_id UNION ALL SELECT target_id, 'in', relation, source_id, claim_id FROM acc WHERE source_id <> target_id)
    SELECT subject_id, direction, relation, other_id, count(DISTINCT b.claim_id) AS claims, least(count(DISTINCT evidence_id), 80) AS evidence
    FROM both_ways b LEFT JOIN res USING (claim_id) WHERE subject_id IN (SELECT entity_id FROM ent WHERE kind = 'meaning') GROUP BY ALL""")
def node_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return K.neighbours_both_ways(g, g.entities.where("kind = 'meaning'").select(F.col("entity_id").alias("subject_id")))


@query(f"""{GRAPH_SQL},
    mine AS (SELECT DISTINCT 't' || l_partkey AS subject_id, 'e' || (l_orderkey + 2) AS evidence_id FROM lineitem WHERE l_returnflag = 'R'),
    theirs AS (SELECT DISTINCT subject_id, evidence_id FROM clm JOIN evi USING (claim_id))
    SELECT * FROM (SELECT * FROM mine QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY evidence_id) <= 40)
    UNION SELECT * FROM (SELECT * FROM theirs QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY evidence_id) <= 40)""")
def evidence_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    mine = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("t"), "l_partkey").alias("entity_id"), F.concat(F.lit("e"), (F.col("l_orderkey") + 2).cast("string")).alias("evidence_id"))
    return K.evidence_bridge(g, mine, g.entities.select(F.col("entity_id").alias("subject_id")))


@query(f"{GRAPH_SQL} SELECT 'node' AS kind, entity_id AS id, kind || '|' || language || '|' || label AS payload FROM ent WHERE status = 'accepted' UNION ALL SELECT 'edge', claim_id, source_id || '|' || relation || '|' || target_id || '|' || basis FROM acc")
def graph_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.snapshot(graph(spark, sf_dir))


_FIELDS = f"""{GRAPH_SQL},
    tr AS (SELECT entity_id AS target_id, language, label FROM ent WHERE status = 'accepted' AND kind = 'translation'),
    renders AS (SELECT source_id AS mid, target_id, language, label, confidence FROM gr JOIN tr USING (target_id) WHERE relation = 'renders-as'
                QUALIFY row_number() OVER (PARTITION BY source_id, language ORDER BY confidence DESC, label, target_id) = 1),
    every_way AS (SELECT source_id AS subject_id, target_id, language, label, confidence, 1 AS hops FROM gr JOIN tr USING (target_id) WHERE relation = 'has-translation'
                  UNION ALL SELECT m.source_id, r.target_id, r.language, r.label, r.confidence, 2 FROM (SELECT DISTINCT source_id, target_id FROM gr WHERE relation = 'has-meaning') m JOIN renders r ON r.mid = m.target_id),
    field AS (SELECT subject_id, language, label AS translation, hops FROM every_way QUALIFY row_number() OVER (PARTITION BY subject_id, language ORDER BY hops, confidence DESC, label, target_id) = 1)"""


@query(f"{_FIELDS} SELECT * FROM field")
def language_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.language_fields(graph(spark, sf_dir))


@query(f"""{_FIELDS},
    heard AS (SELECT 't' || user_id AS subject_id, {_LANGUAGE.format('event_id')} AS language, props AS sound, round(value / 100, 4) AS confidence FROM events
              QUALIFY row_number() OVER (PARTITION BY subject_id, language ORDER BY ts DESC, event_id DESC) = 1)
    SELECT subject_id, language, translation, sound AS pronunciation, least(CASE hops WHEN 1 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END, coalesce(confidence, CASE hops WHEN 1 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END)) AS confidence
    FROM field LEFT JOIN heard USING (subject_id, language)""")
def language_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = table(spark, sf_dir, "events")
    language = F.when(F.col("event_id") % 3 == 0, "en").when(F.col("event_id") % 3 == 1, "de").otherwise("und")
    heard = heard.select(F.concat(F.lit("t"), "user_id").alias("subject_id"), language.alias("language"), F.col("props").alias("sound"), F.round(F.col("value") / 100, 4).alias("confidence"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))
    return K.language_atoms(graph(spark, sf_dir), heard)


@query(f"""{GRAPH_SQL},
    mine AS (SELECT 'e' || (l_orderkey + 2) AS evidence_id FROM lineitem WHERE l_returnflag = 'R' AND 't' || l_partkey IN (FROM ok)),
    theirs AS (SELECT evidence_id FROM evi WHERE claim_id IN (SELECT claim_id FROM acc WHERE basis <> 'model')),
    src AS (SELECT 'e' || o_orderkey AS evidence_id, o_orderpriority AS corpus, sha256((o_custkey % 40)::VARCHAR) AS hash FROM orders WHERE o_orderstatus <> 'P'),
    used AS (SELECT * FROM src WHERE evidence_id IN (SELECT evidence_id FROM mine UNION SELECT evidence_id FROM theirs)),
    h AS (SELECT corpus, hash, count(DISTINCT evidence_id) AS n, row_number() OVER (PARTITION BY corpus ORDER BY hash) AS nth FROM used GROUP BY 1, 2),
    c AS (SELECT corpus, sum(n)::BIGINT AS evidence_records, string_agg(hash, ',' ORDER BY hash) FILTER (nth <= 16) AS hashes, max(nth) > 16 AS hashes_cut, row_number() OVER (ORDER BY corpus) AS place FROM h GROUP BY 1)
    SELECT corpus AS collection, evidence_records, hashes, hashes_cut, (SELECT max(place) FROM c) > 3 AS collections_cut, (SELECT count(*) FROM ok) AS entities, (SELECT count(*) FROM gr) AS claims,
           (SELECT string_agg(DISTINCT language, ',' ORDER BY language) FROM ent WHERE status = 'accepted') AS languages, false AS languages_cut FROM c WHERE place <= 3""")
def collection_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    mine = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("t"), "l_partkey").alias("entity_id"), F.concat(F.lit("e"), (F.col("l_orderkey") + 2).cast("string")).alias("evidence_id"))
    digest = F.sha2((F.col("o_custkey") % 40).cast("string").cast("binary"), 256)
    sources = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.concat(F.lit("e"), "o_orderkey").alias("evidence_id"), F.col("o_orderpriority").alias("corpus"), digest.alias("hash"))
    found = K.overview(g, mine, sources, most_collections=3)
    return found.withColumns({"hashes": F.array_join("hashes", ","), "languages": F.array_join("languages", ",")})
