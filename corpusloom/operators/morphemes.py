"""From book text to a typed graph: terms and their clauses, components with glosses, their kinds, and the edges they prove.

A record's text is cut at its term heads by one split and searched by one extraction, so parsing is column expressions;
kinds come from what is printed and from a lexicon of declarations that is joined, not shipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import stable_id
from .selection import declared

#: A term stands before its pronunciation in brackets, a component before its gloss in parentheses.
TERM_HEAD = r"([A-Za-z][A-Za-z'’-]{1,48})[*＊•·]{0,5}\s*[\[［]"
COMPONENT = r"([－-]?[A-Za-z][A-Za-z/／〈<>-]{0,34}[－-]?)\s*[（(]\s*[=＝]\s*([A-Za-z][A-Za-z0-9 ,;/.'’\"-]{0,100})\s*[）)]"


def plain(text: Column) -> Column:
    """Text without the TeX that scanning leaves around words."""
    out = F.regexp_replace(text, r"\\(?:operatorname|mathrm|mathbf|boldsymbol|text)\s*\{\s*([^{}]{1,80})\s*\}", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"\\[A-Za-z]+", " "), r"[{}]|\\[()]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def letters(form: Column) -> Column:
    return F.regexp_replace(F.lower(form), "[^a-z]", "")


def term_clauses(records: DataFrame) -> DataFrame:
    """(record_id, clause, term, body): each term head of a record's text, and what stands between it and the next.

    A record without heads whose text holds components is one clause of its headword. records: record_id, headword, content.
    """
    text = records.select("record_id", "headword", plain(F.coalesce("content", F.lit(""))).alias("text"))
    heads = F.regexp_extract_all("text", F.lit(TERM_HEAD), F.lit(1))
    found = text.select("record_id", "headword", "text", heads.alias("heads"), F.split("text", TERM_HEAD, -1).alias("bodies"))
    own = F.array(F.struct(F.trim("headword").alias("term"), F.col("text").alias("body")))
    cut = F.arrays_zip(F.col("heads").alias("term"), F.slice("bodies", 2, F.greatest(F.size("bodies") - 1, F.lit(0))).alias("body"))
    none = F.array().cast("array<struct<term: string, body: string>>")
    clauses = F.when(F.size("heads") > 0, cut).when((F.trim("headword") != "") & F.col("text").rlike(COMPONENT), own).otherwise(none)
    return found.select("record_id", F.posexplode(clauses).alias("clause", "c")).select("record_id", "clause", "c.term", "c.body")


def printed_kind(form: Column) -> Column:
    """The kind that a hyphen on one side shows, else null."""
    first, last = form.rlike("^[－-]"), form.rlike("[－-]$")
    return F.when(first & ~last, "suffix").when(last & ~first, "prefix")


def observations(records: DataFrame) -> DataFrame:
    """(observation_id, record_id, clause, term, ordinal, raw_form, form, gloss, printed): every component of every clause."""
    zipped = F.arrays_zip(F.regexp_extract_all("body", F.lit(COMPONENT), F.lit(1)).alias("raw_form"), F.regexp_extract_all("body", F.lit(COMPONENT), F.lit(2)).alias("gloss"))
    rows = term_clauses(records).select("record_id", "clause", "term", F.posexplode(zipped).alias("ordinal", "c")).select("record_id", "clause", "term", "ordinal", "c.raw_form", "c.gloss")
    rows = rows.withColumn("gloss", F.regexp_replace(F.trim(F.regexp_replace("gloss", r"\s+", " ")), "^[ ,.;]+|[ ,.;]+$", "")).withColumn("form", letters(F.substring_index("raw_form", "/", 1)))
    identity = stable_id("component", F.col("record_id").cast("string"), F.col("clause").cast("string"), F.col("ordinal").cast("string"), "raw_form", "gloss")
    return rows.select(identity.alias("observation_id"), "record_id", "clause", "term", "ordinal", "raw_form", "form", "gloss", printed_kind(F.col("raw_form")).alias("printed"))


def typed(found: DataFrame, lexicon: DataFrame) -> DataFrame:
    """observations()'s rows with kind, confidence and state.

    What is printed decides (0.99) unless declarations of the form say otherwise, which makes it ambiguous; else the
    declarations decide, by declared(). A prefix must begin its term, a suffix end it, anything else stand in it: then the
    observation is materializable, else it is kept as it was seen. lexicon: form, kind, gloss (array of words).
    """
    words = F.filter(F.split(F.lower("gloss"), "[^a-z]+"), lambda w: w != "")
    said = declared(found.select(F.col("observation_id").alias("form_id"), "form", words.alias("gloss")).dropDuplicates(["form_id"]), lexicon)
    both = found.join(said.select(F.col("form_id").alias("observation_id"), F.col("state").alias("declared"), F.col("kind").alias("says"), "score"), "observation_id", "left")
    clash = (F.col("declared") == "ambiguous") | (F.col("printed").isNotNull() & F.col("says").isNotNull() & (F.col("printed") != F.col("says")))
    kind = F.when(F.coalesce(clash, F.lit(False)), "ambiguous").otherwise(F.coalesce("printed", "says", F.lit("ambiguous")))
    sure = F.when(kind == "ambiguous", 0.0).when(F.col("printed").isNotNull(), 0.99).otherwise(F.col("score"))
    word = letters(F.col("term"))
    fits = F.when(kind == "prefix", word.startswith(F.col("form"))).when(kind == "suffix", word.endswith(F.col("form"))).otherwise(word.contains(F.col("form")))
    state = F.when((kind != "ambiguous") & (F.col("form") != "") & fits, "materializable").otherwise("observed")
    return both.select(*found.columns, kind.alias("kind"), sure.alias("confidence"), state.alias("state"))


def typed_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) that materializable observations prove.

    entities: entity_id, kind, form; edges: source, target, ordinal, confidence, observations: a term has a component at the
    first place it was seen, with the best confidence; several records that say the same are one edge.
    """
    sure = rows.where("state = 'materializable'").select(letters(F.col("term")).alias("word"), "form", "kind", "ordinal", "confidence", "observation_id")
    term = F.concat(F.lit("term:"), F.col("word")).alias("source")
    shown = F.when(F.col("kind") == "prefix", F.concat("form", F.lit("-"))).when(F.col("kind") == "suffix", F.concat(F.lit("-"), F.col("form"))).otherwise(F.col("form"))
    part = F.concat_ws(":", "kind", shown).alias("target")
    edges = sure.select(term, part, "ordinal", "confidence", "observation_id").groupBy("source", "target").agg(F.min("ordinal").alias("ordinal"), F.max("confidence").alias("confidence"), F.countDistinct("observation_id").alias("observations"))
    words = sure.select(term.alias("entity_id"), F.lit("term").alias("kind"), F.col("word").alias("form"))
    parts = sure.select(part.alias("entity_id"), "kind", "form")
    return words.unionByName(parts).distinct(), edges
