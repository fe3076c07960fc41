"""Scalar functions and readers over the test tables; what a reader reads is first written from a table to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import records as J
from ..functions import repair as Z
from ..functions import text as T
from ..sources import readers, sinks
from ..sources.stages import shared_folder
from ..sources.tables import table
from .catalog import query


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def _documents(lines: DataFrame, head: str, between: str, foot: str, folder: str) -> None:
    """A file for each book of (book, line), in which head, lines and foot are one document."""
    text = F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("line")), between), F.lit(foot))
    lines.groupBy("book").agg(text.alias("text")).write.partitionBy("book").text(folder)


@query(r"""SELECT doc_id, trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s+', ' ', 'g')) AS normalized, trim(regexp_replace(nfc_normalize(text), '[\x00-\x1F\s]+', ' ', 'g')) AS clean,
    regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^\p{L}]+', '', 'g') AS letters, array_to_string(regexp_extract_all(replace(lower(strip_accents(text)), 'ß', 'ss'), '[\p{L}\p{N}]+'), ' ') AS tokens FROM documents""")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.normalized(text).alias("normalized"), T.clean_text(text).alias("clean"), T.plain_letters(text).alias("letters"), F.array_join(T.form_tokens(text), " ").alias("tokens"))


_TAG = "replace(coalesce(lang, '') || CASE WHEN n_chars > 2000 THEN '_latn_gb' WHEN n_chars > 500 THEN '-x!' ELSE '' END, '_', '-')"


@query(rf"""
    WITH t AS (SELECT doc_id, text, n_chars, lang, {_TAG} AS tag, string_split({_TAG}, '-') AS p FROM documents)
    SELECT doc_id, CASE WHEN regexp_full_match(tag, '[A-Za-z]{{2,8}}(-[A-Za-z0-9]{{1,8}})*') THEN lower(p[1]) || CASE WHEN len(p) > 1 THEN '-Latn-GB' ELSE '' END ELSE 'und' END AS tag,
           true AS script, least(1::DOUBLE, greatest(0::DOUBLE, n_chars / 4000 - 0.1)) AS score, CASE WHEN n_chars > 1000 THEN n_chars END AS whole,
           CASE WHEN doc_id % 2 = 0 THEN sha256(doc_id::VARCHAR) ELSE '' END AS hash FROM t""")
def tags_and_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.coalesce("lang", F.lit("")), F.when(F.col("n_chars") > 2000, "_latn_gb").when(F.col("n_chars") > 500, "-x!").otherwise(""))
    number = F.when(F.col("n_chars") > 1000, F.col("n_chars").cast("string")).otherwise("none")
    digest = F.when(F.col("doc_id") % 2 == 0, F.upper(I.digest(F.col("doc_id")))).otherwise("no hash")
    return table(spark, sf_dir, "documents").select("doc_id", T.language_tag(raw).alias("tag"), T.script_fits(F.col("text"), F.col("lang")).alias("script"), T.score(F.col("n_chars") / 4000 - 0.1).alias("score"), T.safe_integer(number).alias("whole"), T.source_hash(digest).alias("hash"))


@query(r"""SELECT p_partkey, p_name || ' ' || p_partkey || ' ring ' || p_size AS line, p_partkey < 10000 AS is_index, CASE WHEN p_size > 10 THEN upper(split_part(p_name, ' ', 2)) ELSE p_type END AS head,
    CASE WHEN p_size > 40 THEN 'root' WHEN p_size > 30 THEN 'chat' WHEN p_size > 20 THEN 'knowledge' ELSE 'chat' END AS mode, CASE WHEN p_size > 25 THEN split_part(p_name, ' ', 1) || ',' || split_part(p_name, ' ', 2) ELSE '' END AS targets,
    p_size > 25 AS usable, CASE WHEN p_size > 45 THEN 'placeholder-gloss' WHEN p_size > 40 THEN 'english-gloss-needs-refinement' WHEN p_size > 35 THEN 'damaged-or-structured-gloss' WHEN p_size > 30 THEN 'missing-or-nontext-gloss' ELSE '' END AS issue FROM part""")
def lexical_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, name, key = F.col("p_size"), F.col("p_name"), F.col("p_partkey").cast("string")
    line = F.concat_ws(" ", name, key, F.lit("ring"), size.cast("string"))
    display = F.when(size > 10, F.upper(F.substring_index(name, " ", -1))).otherwise("not one word")
    asked = F.when(size > 40, F.concat(F.lit("root : "), name)).when(size > 30, name).when(size > 20, F.col("p_type")).otherwise(F.concat(name, F.lit("?")))
    see = F.when(size > 25, F.concat(F.lit("See also "), F.replace(name, F.lit(" "), F.lit(" and ")), F.lit("."))).otherwise(name)
    excerpt = F.when(size > 25, F.concat(F.lit("seen "), name)).otherwise(F.concat(F.lit("cf. "), name, F.lit(".")))
    gloss = F.when(size > 45, "N/A").when(size > 40, F.concat(name, F.lit(" 水"))).when(size > 35, F.concat(name, F.lit(" {x}"))).when(size > 30, "  ").otherwise(name)
    return table(spark, sf_dir, "part").select(
        "p_partkey", line.alias("line"), T.index_only(line).alias("is_index"), T.headword(display, F.col("p_type")).alias("head"), T.intent(asked)["mode"].alias("mode"),
        F.array_join(T.cross_references(see), ",").alias("targets"), T.usable_excerpt(excerpt).alias("usable"), T.gloss_issue(gloss).alias("issue"),
    )


@query(r"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN length(t) >= 2 AND (starts_with(w, t) OR ends_with(w, t)) OR length(t) >= 4 AND starts_with(t, w) OR w = t ELSE w = t OR length(t) >= 4 AND (starts_with(w, t) OR starts_with(t, w)) END AS related,
    100 * (p_size > 40)::INT + 35 * (p_size BETWEEN 21 AND 40)::INT + 25 * (p_size <= 20)::INT + 10 * (p_retailprice > 950)::INT AS points
    FROM (SELECT *, split_part(p_name, ' ', 1) AS w, CASE WHEN p_size > 25 THEN substr(split_part(p_name, ' ', 1), 1, 4) ELSE substr(split_part(p_name, ' ', 1), 2) END AS t FROM part)""")
def relatedness_and_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    word = F.substring_index("p_name", " ", 1)
    other = F.when(size > 25, F.substring(word, 1, 4)).otherwise(F.substring(word, 2, 99))
    kind = F.when(size % 2 == 0, "morphology-affix").otherwise("entry")
    source = F.when(size > 40, "other").when(size > 20, "Root book").otherwise("JMdict")
    return table(spark, sf_dir, "part").select("p_partkey", T.related_words(F.upper(word), F.concat(F.lit("-"), other), kind).alias("related"), T.prompt_score(source, size > 40, F.lit(False), F.col("p_retailprice") > 950).cast("int").alias("points"))


@query(r"""SELECT doc_id, CASE WHEN length(t) <= 160 AND NOT contains(t, '..') AND NOT contains(t, '\') AND NOT s THEN t ELSE 'locator_' || substr(sha256(t), 1, 24) END AS locator
    FROM (SELECT page_id AS doc_id, trim(regexp_replace(url || CASE WHEN page_id % 2 = 0 THEN '/../x' ELSE '' END, '\s+', ' ', 'g')) AS t, false AS s FROM pages)""")
def locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat("url", F.when(F.col("page_id") % 2 == 0, "/../x").otherwise(""))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), J.sanitized_locator(url).alias("locator"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'no place' WHEN p_size <= 10 THEN '[local path withheld]' ELSE p_name || '/' || p_partkey || '#p' || p_size END AS locator FROM part""")
def safe_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    given = F.when(size <= 5, "  no   place ").when(size <= 7, "%252Fhome%252Fme").when(size <= 10, "C:\\notes").otherwise(F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string"), F.lit("#p"), size.cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", T.safe_locator(given).alias("locator"))


_BAG = """CASE event_type WHEN 'view' THEN '{"evidence_id": "e' || user_id || '", "evidence_ids": ["e1", 7, "", "e' || event_id % 10 || '"]}' WHEN 'click' THEN '["e1"]' WHEN 'error' THEN '{"evidence_ids": ' ELSE props END"""


def _bag() -> F.Column:
    kind, text = F.col("event_type"), lambda c: c.cast("string")
    named = F.concat(F.lit('{"evidence_id": "e'), text(F.col("user_id")), F.lit('", "evidence_ids": ["e1", 7, "", "e'), text(F.col("event_id") % 10), F.lit('"]}'))
    return F.when(kind == "view", named).when(kind == "click", '["e1"]').when(kind == "error", '{"evidence_ids": ').otherwise(F.col("props"))


@query("""SELECT event_id, event_type NOT IN ('click', 'error') AS is_object, CASE WHEN event_type = 'view' THEN array_to_string(list_sort(list_distinct(['e' || user_id, 'e1', 'e' || event_id % 10])), ',') ELSE '' END AS ids,
    CASE WHEN event_type = 'click' THEN 'e1' END AS strings FROM events""")
def property_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views name evidence in two ways, clicks hold a list, errors damaged JSON, others neither."""
    bag = _bag()
    return table(spark, sf_dir, "events").select("event_id", J.json_object(bag).isNotNull().alias("is_object"), F.array_join(J.evidence_ids(bag, ["evidence_id", "evidence_ids"]), ",").alias("ids"), F.array_join(J.string_set(bag), ",").alias("strings"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'e' || user_id || '|e1||e' || event_id % 10 WHEN 'click' THEN 'e1' ELSE '' END AS flat,
    CASE WHEN event_type IN ('signup', 'purchase') THEN ((json_merge_patch(props, '{"n": {"a": ' || user_id || '}, "k": 1}'))->>'$.n.a') || '/' || ((json_merge_patch(props, '{"n": {"a": ' || user_id || '}, "k": 1}'))->>'$.k') END AS merged FROM events""")
def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    patch = F.concat(F.lit('{"n": {"a": '), F.col("user_id").cast("string"), F.lit('}, "k": 1}'))
    merged = J.merged_json(F.col("props"), patch)
    shown = F.when(F.col("event_type").isin("signup", "purchase"), F.concat_ws("/", F.get_json_object(merged, "$.n.a"), F.get_json_object(merged, "$.k")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(J.flat_strings(_bag()), "|").alias("flat"), shown.alias("merged"))


@query("""SELECT c_custkey, c_nationkey > 4 AND c_acctbal > 0 OR c_nationkey <= 2 AS covered FROM customer""")
def ruby_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Han terms are covered if tokens show all of them and each Han token has a reading; other terms always are."""
    term = F.when(F.col("c_nationkey") <= 2, "plain").otherwise("漢字 かな")
    whole = F.array(F.struct(F.lit("漢字").alias("t"), F.when(F.col("c_acctbal") > 0, "かんじ").otherwise(" ").alias("r")), F.struct(F.lit("かな").alias("t"), F.lit(None).cast("string").alias("r")))
    tokens = F.when(F.col("c_nationkey") > 4, whole).when(F.col("c_nationkey") > 3, F.slice(whole, 1, 1))
    return table(spark, sf_dir, "customer").select("c_custkey", J.ruby_covers(term, tokens).alias("covered"))


@query("""SELECT p_partkey, CASE WHEN p_size > 20 THEN 'span:0:' || length(split_part(p_name, ' ', 1)) ELSE 'ordinal:' || p_size END AS occurrence,
    'term' || chr(31) || 'en' || chr(31) || 'root' || chr(31) || p_name AS node FROM part WHERE length(split_part(p_name, ' ', 1)) > 2""")
def occurrences_and_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.substring_index("p_name", " ", 1)
    term = F.when(F.col("p_size") > 20, F.col("p_name")).otherwise(F.concat(head, head))
    kind = F.when(F.col("p_size") > 20, "prefix").otherwise("root")
    rows = table(spark, sf_dir, "part").where(F.length(head) > 2)
    place = F.when(F.col("p_size") > 20, J.occurrence(term, head, kind, F.col("p_size"))).otherwise(J.occurrence(term, head, kind, F.col("p_size")))
    return rows.select("p_partkey", place.alias("occurrence"), J.node_identity(F.lit("Term "), F.lit("EN"), F.lit("root"), F.upper("p_name")).alias("node"))


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN p_size > 45 WHEN p_size > 20 THEN true ELSE false END AS origin, CASE WHEN p_size > 40 THEN p_size > 45 ELSE true END AS relevant FROM part""")
def origin_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record matches a term it is about, refers to it, or says where it comes from."""
    size, term = F.col("p_size"), F.col("p_name")
    headword = F.when(size > 40, "another").when(size > 20, "third").otherwise(term)
    excerpt = F.when(size > 45, F.concat(F.lit("The word "), term, F.lit(" was borrowed from elsewhere."))).when(size > 40, "nothing to say").when(size > 20, F.concat(F.lit("See "), term, F.lit("."))).otherwise("see other.")
    return table(spark, sf_dir, "part").select("p_partkey", J.origin_matches(term, F.lit("entry"), headword, excerpt).alias("origin"), J.relevant(term, F.lit("entry"), F.lit("words"), headword, excerpt).alias("relevant"))


# readers


@query("""SELECT p_partkey::VARCHAR AS entry_id, p_name AS headword, lower(p_name) AS headword_key, p_brand AS display_headword, lower(p_brand) AS display_key, p_type || chr(10) || 'size ' || p_size AS plain_text, p_size::BIGINT AS page FROM part""")
def word_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a word book in JSON Lines, with byte-order marks and blank lines."""
    paragraphs = F.array(F.struct(F.concat(F.lit(" "), "p_type").alias("text")), F.struct(F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("text")))
    size = F.col("p_size").cast("string")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit(" "), "p_name").alias("headword"), F.col("p_brand").alias("display_headword"), paragraphs.alias("paragraphs"), F.array(size, size, F.lit("x")).alias("source_pages"))
    line = F.concat(F.lit("\ufeff"), F.to_json(F.struct(*rows.columns)))
    folder = _folder(spark, "word-book")
    rows.select(F.explode(F.array(line, F.lit("  "))).alias("line")).write.text(folder)
    return readers.word_entries(spark, folder).select("entry_id", "headword", "headword_key", "display_headword", "display_key", "plain_text", F.col("source_pages")[0].alias("page"))


@query("""SELECT c_custkey::VARCHAR AS item_id, CASE WHEN c_acctbal > 0 THEN 'answer' ELSE 'question' END AS kind, c_custkey::INT AS ordinal, c_name AS source_primary, c_name || ' en' AS en_primary, 'one,two' AS follow_ups FROM customer""")
def card_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda code: F.struct(F.concat_ws(" ", "c_name", F.lit(code)).alias("primary"), F.array(F.lit("two"), F.lit(" ")).alias("follow_ups"))
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_acctbal") > 0, "answer").otherwise("question").alias("kind"), F.col("c_custkey").alias("ordinal"),
        F.struct(F.lit("en").alias("language"), F.col("c_name").alias("primary"), F.array(F.lit("one")).alias("follow_ups")).alias("source"), F.struct(*[side(c).alias(c) for c in ("en", "ja", "zh")]).alias("languages"),
    )
    folder = _folder(spark, "card-book")
    sinks.canonical_json(rows).write.text(folder)
    return readers.card_book(spark, folder).select("item_id", "kind", "ordinal", "source_primary", "en_primary", F.array_join("follow_ups", ",").alias("follow_ups"))


@query("""SELECT s_suppkey::VARCHAR AS record_id, s_name AS headword, lower(s_name) AS headword_key, s_nationkey AS source_page, 'root of ' || s_suppkey AS content FROM supplier WHERE s_acctbal > 0""")
def morphology_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as records; those without means are nothing but index lines."""
    cells = F.when(F.col("s_acctbal") > 0, F.array(F.lit("root  of"), F.col("s_suppkey").cast("string"))).otherwise(F.array(F.lit("alpha 12 beta 7")))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("headword"), cells.alias("cells"), F.col("s_nationkey").cast("string").alias("source_page"))
    folder = _folder(spark, "morphology")
    sinks.canonical_json(rows).write.text(folder)
    return readers.morphology(spark, folder)


@query("""SELECT CASE WHEN s_acctbal > 5000 THEN 'roots' ELSE 'affixes' END AS corpus, CASE WHEN s_acctbal > 5000 THEN 'morphology-root' ELSE 'morphology-affix' END AS kind, s_suppkey::VARCHAR AS record_id, s_name AS headword FROM supplier""")
def morphology_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as two corpora by their means, read together."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("headword"), F.array(F.lit("a part")).alias("cells"), F.lit("1").alias("source_page"), "s_acctbal")
    paths = {"roots": _folder(spark, "roots"), "affixes": _folder(spark, "affixes")}
    for name, part in (("roots", rows.where("s_acctbal > 5000")), ("affixes", rows.where("not s_acctbal > 5000"))):
        sinks.canonical_json(part.drop("s_acctbal")).write.text(paths[name])
    return readers.morphology_corpora(spark, paths).select("corpus", "kind", "record_id", "headword")


@query("""SELECT 'tei:' || substr(sha256(lower(p_name) || chr(0) || lower(p_type)), 1, 20) AS entry_id, p_name AS headword, lower(p_name) AS headword_key, p_type AS translation, lower(p_type) AS translation_key FROM (SELECT DISTINCT p_name, p_type FROM part)""")
def tei_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as TEI entries: names are headwords, types translations; every pair stands there many times."""
    entry = F.concat(F.lit("<entry><form><orth> "), "p_name", F.lit('</orth></form><sense><cit type="trans"><quote>'), "p_type", F.lit('</quote></cit><cit type="example"><quote>no</quote></cit></sense></entry>'))
    folder = _folder(spark, "tei")
    _documents(table(spark, sf_dir, "part").select(F.pmod("p_partkey", F.lit(4)).alias("book"), entry.alias("line")), "<TEI><body>", "", "</body></TEI>", folder)
    return readers.tei_dictionary(spark, folder)


@query("""
    WITH w AS (SELECT n_nationkey::VARCHAR AS entry_id, n_name AS form, 'k' || n_nationkey AS a, 'h' || n_nationkey AS b, n_regionkey FROM nation)
    SELECT entry_id, form, lower(form) AS form_key, a AS reading, n_regionkey = 1 AS common, 'all,first' AS glosses, 'n' AS parts FROM w
    UNION ALL SELECT entry_id, form, lower(form), b, n_regionkey = 1, 'all', 'n' FROM w WHERE n_regionkey <> 2""")
def jmdict_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as words of one written form and two readings; the second fits no form in one region, a sense only the first."""
    none, key = F.array().cast("array<string>"), F.col("n_nationkey").cast("string")
    written = lambda text, scope: F.struct(text.alias("text"), (F.col("n_regionkey") == 1).alias("common"), scope.alias("appliesToKanji"))
    sense = lambda gloss, kana: F.struct(F.array(F.lit("*")).alias("appliesToKanji"), kana.alias("appliesToKana"), F.array(F.lit("n")).alias("partOfSpeech"), F.array(F.struct(F.lit("eng").alias("lang"), F.lit(gloss).alias("text")), F.struct(F.lit("ger").alias("lang"), F.lit("nein").alias("text"))).alias("gloss"))
    a, b = F.concat(F.lit("k"), key), F.concat(F.lit("h"), key)
    word = F.struct(key.alias("id"), F.array(written(F.col("n_name"), none)).alias("kanji"), F.array(written(a, F.array(F.lit("*"))), written(b, F.when(F.col("n_regionkey") == 2, F.array(F.lit("other"))).otherwise(F.array(F.col("n_name"))))).alias("kana"), F.array(sense("all", none), sense("first", F.array(a))).alias("sense"))
    folder = _folder(spark, "jmdict")
    _documents(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("book"), F.to_json(word).alias("line")), '{"words": [', ", ", "]}", folder)
    found = readers.jmdict(spark, folder)
    return found.withColumns({"glosses": F.array_join(F.array_sort("glosses"), ","), "parts": F.array_join("parts", ",")})


@query("""
    SELECT 'n' || n_nationkey || '.md' AS path, unnest(['(document)', n_name, 'End']) AS heading, unnest([0, 1, 2]) AS level, unnest([1, 3, 7]) AS line_start, unnest([2, 6, 8]) AS line_end,
           unnest(['', 'r' || n_regionkey || '=see', 'x=x']) AS links FROM nation""")
def markdown_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as notes with headings, fenced code and links; folders of tools hold a copy that is passed over."""
    folder = _folder(spark, "notes")
    for row in table(spark, sf_dir, "nation").toLocalIterator():  # a file a nation, 25 of them
        text = f"intro\n\n# {row['n_name']}\n```\n# code [[no]]\n``` \n## End ##\n[[x]] \\[[y]]\n".replace("``` \n", f"```  \n[[r{row['n_regionkey']}|see]]\n", 1).replace("# code [[no]]\n", "")
        for place in (f"{folder}/n{row['n_nationkey']}.md", f"{folder}/node_modules/n{row['n_nationkey']}.md"):
            sinks.put_text(spark, place, text)
    sections = readers.markdown_sections(readers.markdown_files(spark, folder))
    links = readers.wiki_links(sections).groupBy("section_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "target", "label"))), ",").alias("links"))
    return sections.join(links, "section_id", "left").select("path", "heading", "level", "line_start", "line_end", F.coalesce("links", F.lit("")).alias("links"))


@query("""SELECT count(*) AS rows, sum(p_size)::BIGINT AS sizes, 3 AS files FROM part""")
def release_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts released as one file of JSON Lines and read back; every listed file is there."""
    folder = _folder(spark, "release")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    sinks.release({"part": (parts, ("p_partkey",))}, folder, "Parts")
    back = spark.read.schema("p_partkey bigint, p_size int").json(f"{folder}/part")
    listed = spark.read.text(f"{folder}/SHA256SUMS").agg(F.count(F.lit(1)).cast("int").alias("files"))  # one row
    return back.agg(F.count(F.lit(1)).alias("rows"), F.sum("p_size").alias("sizes")).crossJoin(F.broadcast(listed))


@query("""SELECT event_id, CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'view' THEN '{"evidence_ids":["a","b"],"k":' || user_id || '}' ELSE '{"k":[' || user_id || ']}' END AS value,
    CASE event_type WHEN 'view' THEN 'evidence-array-repair' WHEN 'click' THEN 'container-repair' WHEN 'error' THEN 'literal-repair' WHEN 'purchase' THEN 'none' END AS how FROM events""")
def recovered_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with loose lists, open containers, Python literals, reasoning and fences around whole ones, and none at all."""
    user = F.col("user_id").cast("string")
    reply = F.when(F.col("event_type") == "view", F.concat(F.lit('Sure: {"evidence_ids": "a", "b", "k": '), user, F.lit("}"))).when(F.col("event_type") == "click", F.concat(F.lit('{"k": ['), user, F.lit(", ")))
    reply = reply.when(F.col("event_type") == "error", F.concat(F.lit("{'k': ["), user, F.lit(",]}"))).when(F.col("event_type") == "purchase", F.concat(F.lit('<think>{"no": 1}</think>```json\n{"k": ['), user, F.lit("]}\n```"))).otherwise(F.lit('<think> {"k": 1}'))
    return table(spark, sf_dir, "events").select("event_id", Z.recovered_json(reply).alias("r")).select("event_id", "r.value", "r.how")


@query("""SELECT p_partkey, CASE WHEN p_size <= 40 THEN '"' || split_part(p_name, ' ', 1) || ',  |' || split_part(p_name, ' ', 2) || '  of|size ' || p_size || '!' END AS parts FROM part""")
def aligned_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases back on a sentence with marks and gaps; large parts skip a word, which is refused."""
    a, b, size = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1), F.col("p_size").cast("string")
    text = F.concat(F.lit('"'), a, F.lit(",  "), b, F.lit("  of"), F.lit("size "), size, F.lit("!"))
    phrases = F.array(a, F.concat(b, F.when(F.col("p_size") > 40, " no").otherwise(" of")), F.concat(F.lit("size "), size))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(Z.aligned_parts(text, phrases), "|").alias("parts"))


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN 'whole' ELSE 'cut' END AS state, true AS fits FROM part""")
def budgeted_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long prompts are cut to their budget, short ones stay as they are."""
    prompt = F.concat(F.lit('Facts: {"name": "'), "p_name", F.lit('", "text": "'), F.when(F.col("p_size") > 25, "short").otherwise(F.repeat(F.lit("long text "), 300)), F.lit('"} end'))
    shown = Z.compacted_prompts(prompt, F.lit(100))
    rows = table(spark, sf_dir, "part").select("p_partkey", prompt.alias("given"), shown.alias("shown"))
    return rows.select("p_partkey", F.when(F.col("shown") == F.col("given"), "whole").otherwise("cut").alias("state"), (T.token_estimate(F.col("shown")) <= 100).alias("fits"))
