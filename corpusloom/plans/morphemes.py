"""Book text to a typed graph. Each part is a record: two terms with their components, some of which other parts declare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import morphemes as M
from ..sources.tables import table
from .catalog import query

_HEAD = M.TERM_HEAD.replace("'", "''")
_PART = M.COMPONENT.replace("'", "''")
_CONTENT = """split_part(p_name, ' ', 1) || ' [x] \\mathrm{{' || substr(p_name, 1, 2) || '-}} (= ' || lower(p_type) || ') ' || substr(split_part(p_name, ' ', 1), 3) || 'q (= no) ; ' || split_part(p_name, ' ', 2) || '* [y] ' || substr(split_part(p_name, ' ', 2), 1, 3) || ' (= thing ' || CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END || ') -' || right(p_name, 2) || ' (=end)'"""

_OBSERVED = f"""
    t AS (SELECT p_partkey AS record_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '\\\\(?:operatorname|mathrm|mathbf|boldsymbol|text)\\s*\\{{\\s*([^{{}}]{{1,80}})\\s*\\}}', '\\1', 'g'), '\\\\[A-Za-z]+', ' ', 'g'), '[{{}}]|\\\\[()]', ' ', 'g'), '\\s+', ' ', 'g')) AS t
          FROM (SELECT p_partkey, {_CONTENT.format()} AS c FROM part)),
    c AS (SELECT record_id, unnest(range(len(regexp_extract_all(t, '{_HEAD}', 1)))) AS clause, regexp_extract_all(t, '{_HEAD}', 1) AS heads, regexp_split_to_array(t, '{_HEAD}') AS bodies FROM t),
    b AS (SELECT record_id, clause, heads[clause + 1] AS term, bodies[clause + 2] AS body FROM c),
    o AS (SELECT record_id, clause, term, unnest(range(len(regexp_extract_all(body, '{_PART}', 1)))) AS ordinal, regexp_extract_all(body, '{_PART}', 1) AS f, regexp_extract_all(body, '{_PART}', 2) AS g FROM b),
    seen AS (SELECT record_id, clause, term, ordinal, f[ordinal + 1] AS raw_form, regexp_replace(lower(f[ordinal + 1]), '[^a-z]', '', 'g') AS form, trim(g[ordinal + 1], ' ,.;') AS gloss,
             CASE WHEN f[ordinal + 1] LIKE '-%' THEN 'suffix' WHEN f[ordinal + 1] LIKE '%-' THEN 'prefix' END AS printed FROM o)"""

_TYPED = f"""{_OBSERVED},
    lex AS (SELECT DISTINCT substr(split_part(p_name, ' ', 2), 1, 3) AS form, CASE WHEN p_type = 'PROMO' THEN 'suffix' ELSE 'root' END AS kind, ['thing'] AS said FROM part WHERE p_size > 30),
    fit AS (SELECT record_id, clause, ordinal, kind, CASE WHEN len(list_filter(w, lambda x: NOT list_contains(said, x))) = 0 THEN 0.99 WHEN len(list_filter(said, lambda x: NOT list_contains(w, x))) = 0 THEN 0.95 END AS score
            FROM (SELECT *, list_filter(regexp_split_to_array(lower(gloss), '[^a-z]+'), lambda x: x <> '') AS w FROM seen) s JOIN lex USING (form)),
    top AS (SELECT record_id, clause, ordinal, count(DISTINCT kind) AS kinds, min(kind) AS says, max(score)::DOUBLE AS score FROM fit WHERE score IS NOT NULL GROUP BY 1, 2, 3),
    k AS (SELECT seen.*, CASE WHEN kinds > 1 OR printed <> says AND kinds = 1 THEN 'ambiguous' ELSE coalesce(printed, CASE WHEN kinds = 1 THEN says END, 'ambiguous') END AS kind, score FROM seen LEFT JOIN top USING (record_id, clause, ordinal)),
    typed AS (SELECT *, CASE WHEN kind = 'ambiguous' THEN 0.0 WHEN printed IS NOT NULL THEN 0.99 ELSE score END::DOUBLE AS confidence,
              CASE WHEN kind <> 'ambiguous' AND CASE kind WHEN 'prefix' THEN starts_with(lower(term), form) WHEN 'suffix' THEN ends_with(lower(term), form) ELSE contains(lower(term), form) END THEN 'materializable' ELSE 'observed' END AS state FROM k)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, name = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1), F.col("p_name")
    content = F.concat(
        a, F.lit(" [x] \\mathrm{"), F.substring(name, 1, 2), F.lit("-} (= "), F.lower("p_type"), F.lit(") "), F.substring(a, 3, 99), F.lit("q (= no) ; "), b, F.lit("* [y] "), F.substring(b, 1, 3),
        F.lit(" (= thing "), F.when(F.col("p_size") > 25, "big").otherwise("small"), F.lit(") -"), F.right(name, F.lit(2)), F.lit(" (=end)"),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), name.alias("headword"), content.alias("content"))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.substring(F.substring_index("p_name", " ", -1), 1, 3)
    lexicon = table(spark, sf_dir, "part").where("p_size > 30").select(second.alias("form"), F.when(F.col("p_type") == "PROMO", "suffix").otherwise("root").alias("kind"), F.array(F.lit("thing")).alias("gloss")).distinct()
    return M.typed(M.observations(_records(spark, sf_dir)), lexicon)


@query(f"WITH {_OBSERVED} SELECT record_id, clause::INT AS clause, term, ordinal::INT AS ordinal, raw_form, form, gloss, printed FROM seen")
def component_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.observations(_records(spark, sf_dir)).drop("observation_id")


@query(f"WITH {_TYPED} SELECT record_id, clause::INT AS clause, ordinal::INT AS ordinal, kind, confidence, state FROM typed")
def typed_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).select("record_id", "clause", "ordinal", "kind", "confidence", "state")


@query(f"""WITH {_TYPED},
    e AS (SELECT 'term:' || lower(term) AS source, kind || ':' || CASE kind WHEN 'prefix' THEN form || '-' WHEN 'suffix' THEN '-' || form ELSE form END AS target, ordinal, confidence, record_id, clause FROM typed WHERE state = 'materializable')
    SELECT source, target, min(ordinal)::INT AS ordinal, max(confidence) AS confidence, count(DISTINCT (record_id, clause, ordinal)) AS observations FROM e GROUP BY 1, 2""")
def book_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.typed_graph(_typed(spark, sf_dir))[1]
