"""Retrieval queries over documents, parts and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search
from ..sources.tables import table
from .catalog import query

#: Words of the queries. They are frequent, rarer and absent in the test collections.
RANKED, ALL_OF, MISSING = "reation verber", "the and of", "zzyzx quux"


def _bm25_sql(tokens: list[str], prefix: bool, every: bool, table_: str, id_: str, columns: dict[str, float], extra: str = "") -> str:
    words = {c: f"regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')" for c in columns}
    hit = (lambda t: f"lambda w: starts_with(w, '{t}')") if prefix else (lambda t: f"lambda w: w = '{t}'")
    tf = ", ".join("(" + " + ".join(f"{float(w)} * len(list_filter(t_{c}, {hit(t)}))" for c, w in columns.items()) + f") AS tf{i}" for i, t in enumerate(tokens))
    k = range(len(tokens))
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len_ / av)) ELSE 0 END" for i in k)
    wanted = (" AND " if every else " OR ").join(f"tf{i} > 0" for i in k)
    return f"""
    WITH w AS (SELECT {id_} AS id, {', '.join(f'{x} AS t_{c}' for c, x in words.items())} FROM {table_}),
    f AS (SELECT id, {' + '.join(f'len(t_{c})' for c in columns)} AS len_, {tf} FROM w),
    g AS (SELECT count(*)::DOUBLE AS n, avg(len_) AS av, {', '.join(f'count(*) FILTER (tf{i} > 0)::DOUBLE AS df{i}' for i in k)} FROM f),
    s AS (SELECT id, round({score}, 6) AS score FROM f, g WHERE {wanted}){extra}"""


@query(_bm25_sql(search.query_tokens(RANKED), True, False, "documents", "doc_id", {"text": 1.0}) + " SELECT id AS doc_id, score FROM s ORDER BY score DESC, id LIMIT 10")
def search_bm25_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.bm25(table(spark, sf_dir, "documents"), "doc_id", {"text": 1.0}, RANKED)
    return found.orderBy(F.desc("score"), "id").limit(10).select(F.col("id").alias("doc_id"), "score")


@query(_bm25_sql(search.query_tokens(ALL_OF), False, True, "documents", "doc_id", {"text": 1.0}) + " SELECT id AS doc_id, score FROM s ORDER BY score DESC, id LIMIT 20")
def search_and_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.bm25(table(spark, sf_dir, "documents"), "doc_id", {"text": 1.0}, ALL_OF, prefix=False, every=True)
    return found.orderBy(F.desc("score"), "id").limit(20).select(F.col("id").alias("doc_id"), "score")


@query(_bm25_sql(["src1", "the"], True, False, "documents", "doc_id", {"source": 8.0, "text": 1.0}) + " SELECT id AS doc_id, score FROM s ORDER BY score DESC, id LIMIT 15")
def search_weighted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.bm25(table(spark, sf_dir, "documents"), "doc_id", {"source": 8.0, "text": 1.0}, "src1 the")
    return found.orderBy(F.desc("score"), "id").limit(15).select(F.col("id").alias("doc_id"), "score")


@query(
    _bm25_sql(["brand"], True, False, "part", "p_partkey", {"p_name": 5.0, "p_brand": 2.0})
    + """, x AS (SELECT p_partkey AS id, CASE WHEN lower(p_brand) = 'brand#11' THEN 0 ELSE 1 END AS stage, 0.0::DOUBLE AS score FROM part
         WHERE lower(p_brand) = 'brand#11' OR lower(p_type) = 'brand#11' ORDER BY stage, id LIMIT 8),
    u AS (SELECT * FROM x UNION ALL (SELECT id, 2, score FROM r2)),
    o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stage) AS k FROM u)
    SELECT id AS p_partkey, stage::INT AS stage, score, row_number() OVER (ORDER BY stage, score DESC, id)::INT AS place FROM o WHERE k = 1 QUALIFY place <= 8""".replace("r2", "(SELECT id, score FROM s ORDER BY score DESC, id LIMIT 24)")
)
def search_hybrid_exact_then_fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.exact_then_ranked(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_type"], {"p_name": 5.0, "p_brand": 2.0}, "Brand#11", 8)
    return found.select(F.col("id").alias("p_partkey"), "stage", "score", "place")


@query("SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'ation th') OR contains(lower(source), 'ation th') ORDER BY doc_id LIMIT 25")
def search_like_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranked = search.bm25(docs, "doc_id", {"text": 1.0}, MISSING).select(F.col("id").alias("doc_id")).join(docs.select("doc_id", "n_chars"), "doc_id")
    fallback = search.contains_any(docs, ["text", "source"], "ation th").select("doc_id", "n_chars")
    return search.with_fallback(ranked, fallback).orderBy("doc_id").limit(25)


@query("""
    SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'cold w' THEN 0 WHEN starts_with(lower(p_name), 'cold w') THEN 1 ELSE 2 END AS match_rank
    FROM part WHERE contains(lower(p_name), 'cold w') OR contains(lower(p_name), 'l_w')""")
def search_escaped_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower("p_name")
    rank = F.when(name == "cold w", 0).when(name.startswith("cold w"), 1).otherwise(2)
    return table(spark, sf_dir, "part").where(name.contains("cold w") | name.contains("l_w")).select("p_partkey", "p_name", rank.alias("match_rank"))


@query(r"""
    WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
    p AS (SELECT doc_id, t, list_min(list_filter([position('ation' IN lower(t)), position('ing' IN lower(t))], lambda x: x > 0)) AS f FROM d),
    s AS (SELECT *, greatest(0, coalesce(f - 1, 0) - 30) AS b FROM p)
    SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE
        (CASE WHEN b > 0 THEN '…' ELSE '' END) || trim(substring(t, b + 1, least(length(t), b + 120) - b)) || (CASE WHEN least(length(t), b + 120) < length(t) THEN '…' ELSE '' END) END AS excerpt
    FROM s""")
def excerpt_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), "ation ing", 120).alias("excerpt"))


_START = "(('0x' || substr(sha256('corpus' || chr(0) || '{seed}'), 1, 16))::UBIGINT::HUGEINT % n)"


@query(f"WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id FROM d WHERE rn = {_START.format(seed='morning')}")
def draw_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return search.draw(docs, ["doc_id"], "Morning ", "corpus", id_col="doc_id").select("doc_id")


@query(f"""
    WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents)
    SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
    ORDER BY ((rn - {_START.format(seed='evening')}) % n + n) % n LIMIT 5""")
def draw_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return search.draw(docs, ["doc_id"], "evening", "corpus", table(spark, sf_dir, "labels"), "doc_id", 5).select("doc_id")


@query()
def draw_unseen_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    ids = search.draw_batch(docs, ["doc_id"], "noon", "corpus", table(spark, sf_dir, "labels"), "doc_id", 4)
    return spark.createDataFrame(list(enumerate(ids)), "place int, doc_id bigint")


@query(r"""
    WITH d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'))) AS term FROM documents)
    SELECT term, count(*) AS df FROM d GROUP BY term HAVING count(*) >= 5""")
def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.words(F.coalesce("text", F.lit(""))))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df >= 5")


@query("""
    WITH n AS (SELECT p_partkey AS id, p_name AS label, p_size AS degree FROM part),
    s AS (SELECT *, CASE WHEN lower(label) = 'widget' THEN 100 WHEN starts_with(lower(label), 'widget') THEN 50 ELSE 0 END
          + CASE WHEN contains(' ' || lower(label) || ' ', ' widget ') THEN 10 ELSE 0 END + 5 AS points FROM n WHERE contains(lower(label), 'widget'))
    SELECT id, label, points FROM s ORDER BY points DESC, degree DESC, lower(label) LIMIT 10""")
def search_node_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_size").alias("degree"))
    return search.name_search(nodes, "widget", 10).select("id", "label", "points")


# from written postings

#: Rows in CJK that stand beside the test table's documents.
HAN = ((-1, "日本語の本 reaux"), (-2, "日本 本日 語"), (-3, "中国語 réaux"), (-4, "本語日本"))
_RUNS = "[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]+"


def _folded_bm25_sql(rows: str, tokens: list[tuple[str, bool]], columns: dict[str, float], every: bool) -> str:
    """BM25 as it is defined: terms of accent-free words and of CJK characters and pairs, weighted before saturation."""
    fold = lambda c: f"replace(lower(strip_accents(coalesce({c}, ''))), 'ß', 'ss')"
    pairs = lambda c: f"flatten(list_transform(regexp_extract_all({fold(c)}, '{_RUNS}'), lambda r: list_concat(list_transform(range(1, length(r) + 1), lambda i: 'u' || r[i]), list_transform(range(1, length(r)), lambda i: 'b' || r[i:i + 1]))))"
    words = {c: f"list_concat(regexp_extract_all({fold(c)}, '[\\p{{L}}\\p{{N}}]+'), {pairs(c)})" for c in columns}
    hit = lambda t, exact: f"lambda w: w = '{t}'" if exact else f"lambda w: starts_with(w, '{t}')"
    tf = ", ".join("(" + " + ".join(f"{float(w)} * len(list_filter(t_{c}, {hit(*token)}))" for c, w in columns.items()) + f") AS tf{i}" for i, token in enumerate(tokens))
    k = range(len(tokens))
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len_ / av)) ELSE 0 END" for i in k)
    wanted = (" AND " if every else " OR ").join(f"tf{i} > 0" for i in k)
    return f"""
    WITH w AS (SELECT id, {', '.join(f'{x} AS t_{c}' for c, x in words.items())} FROM ({rows})),
    f AS (SELECT id, {' + '.join(f'len(t_{c})' for c in columns)} AS len_, {tf} FROM w),
    g AS (SELECT count(*)::DOUBLE AS n, avg(len_) AS av, {', '.join(f'count(*) FILTER (tf{i} > 0)::DOUBLE AS df{i}' for i in k)} FROM f),
    s AS (SELECT id, round({score}, 6) AS score FROM f, g WHERE {wanted})"""


_DOCUMENTS = "SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in HAN) + ") v"


def _with_han(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(spark.createDataFrame(list(HAN), "id bigint, text string"))


def _written(spark: SparkSession, docs: DataFrame, columns: dict[str, float]) -> str:
    from ..sources.sinks import build_index
    from .records import _folder

    folder = _folder(spark, "index")
    build_index(docs, folder, "id", columns)
    return folder


@query(_folded_bm25_sql(_DOCUMENTS, [("reaux", False), ("uber", False)], {"text": 1.0}, False) + " SELECT id, score FROM s ORDER BY score DESC, id LIMIT 25")
def search_written_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accents don't count: réaux and reaux are one term. Scores come from the postings of a written index."""
    from ..sources.sinks import search_index

    return search_index(spark, _written(spark, _with_han(spark, sf_dir), {"text": 1.0}), "Réaux über").orderBy(F.desc("score"), "id").limit(25)


@query(_folded_bm25_sql(_DOCUMENTS, [("b日本", True), ("b本語", True)], {"text": 1.0}, True) + f" SELECT s.id, score FROM s JOIN ({_DOCUMENTS}) d ON d.id = s.id WHERE contains(d.text, '日本語')")
def search_cjk_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both pairs of a run must be there, and the run as it stands; the pairs alone are in one document more."""
    from ..sources.sinks import search_index

    folder = _written(spark, _with_han(spark, sf_dir), {"text": 1.0})
    found = search_index(spark, folder, "日本語", every=True)
    return found.join(search.holds_phrases(spark.read.parquet(f"{folder}/entries"), "text", "日本語").select("id"), "id", "left_semi")


_MORPHOLOGY = "SELECT p_partkey AS id, p_name AS headword, p_type || ' ' || p_brand AS content, p_size AS page FROM part WHERE p_size > 3"


@query(_folded_bm25_sql(_MORPHOLOGY, [("ring", False), ("econ", False)], {"headword": 8.0, "content": 1.0}, False) + f" SELECT s.id, score, page FROM s JOIN ({_MORPHOLOGY}) m ON m.id = s.id ORDER BY score DESC, page, s.id LIMIT 30")
def search_morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headwords weigh eight times their content; records that are nothing but an index (small ones) go before the ranking."""
    from ..sources.sinks import search_index

    rows = table(spark, sf_dir, "part").where("p_size > 3").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("headword"), F.concat_ws(" ", "p_type", "p_brand").alias("content"), F.col("p_size").alias("page"))
    folder = _written(spark, rows, {"headword": 8.0, "content": 1.0})
    return search_index(spark, folder, "ring econ").join(spark.read.parquet(f"{folder}/entries").select("id", "page"), "id").orderBy(F.desc("score"), "page", "id").limit(30)


_SECTIONS = "SELECT doc_id * 1000000 + place AS id, doc_id AS path, place, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents)"


@query(_folded_bm25_sql(_SECTIONS, [("apache", False), ("gnu", False)], {"line": 1.0}, False) + f" SELECT path, place::INT AS place, score FROM s JOIN ({_SECTIONS}) m ON m.id = s.id ORDER BY score DESC, path, place LIMIT 20")
def search_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for sections; ties go by path and line."""
    from ..sources.sinks import search_index

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("place", "line")).withColumn("place", F.col("place") + 1)
    folder = _written(spark, rows.withColumn("id", F.col("path") * 1000000 + F.col("place")), {"line": 1.0})
    found = search_index(spark, folder, "Apache GNU").join(spark.read.parquet(f"{folder}/entries").select("id", "path", "place"), "id")
    return found.orderBy(F.desc("score"), "path", "place").limit(20).select("path", "place", "score")


_WORDS = "SELECT p_partkey AS id, p_name AS headword, p_brand AS display, p_type AS section, p_name || ' in ' || p_type AS body FROM part"


@query(_folded_bm25_sql(_WORDS, [("ring", False), ("promo", False)], {"headword": 8.0, "display": 5.0, "section": 1.0, "body": 2.0}, False) + " SELECT id, score FROM s ORDER BY score DESC, id LIMIT 20")
def search_word_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word entries with their four weighted fields."""
    from ..sources.sinks import search_index

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("headword"), F.col("p_brand").alias("display"), F.col("p_type").alias("section"), F.concat_ws(" in ", "p_name", "p_type").alias("body"))
    return search_index(spark, _written(spark, rows, {"headword": 8.0, "display": 5.0, "section": 1.0, "body": 2.0}), "ring promo").orderBy(F.desc("score"), "id").limit(20)
