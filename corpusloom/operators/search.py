"""Retrieval: postings, column-weighted BM25, exact-then-ranked search, substring fallback, deterministic draws.

A query's tokens are a handful of literals, so prefix and phrase matching are filters on the postings scan, not joins.
Document lengths and average lengths come from the same postings.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.identity import NUL, hash_offset
from ..sources.stages import cut

#: Constants of the ranking function.
K1, B = 1.2, 0.75


def query_tokens(query: str, most: int = 12) -> list[str]:
    return [t.lower() for t in re.findall(r"[^\W_]+", query)][:most]


def postings(docs: DataFrame, id_col: str, columns: dict[str, float]) -> DataFrame:
    """(id, field, term, tf, field_length): one row per term of a field; the weights of fields come in at scoring."""
    out = None
    for name in columns:
        tokens = T.words(F.coalesce(F.col(name), F.lit("")))
        rows = docs.select(F.col(id_col).alias("id"), F.lit(name).alias("field"), F.size(tokens).alias("field_length"), F.explode(tokens).alias("term"))
        rows = rows.groupBy("id", "field", "field_length", "term").agg(F.count(F.lit(1)).alias("tf"))
        out = rows if out is None else out.unionByName(rows)
    return out.select("id", "field", "term", "tf", "field_length")


def _matches(token: str, prefix: bool):
    return (lambda term: term.startswith(token)) if prefix else (lambda term: term == token)


def bm25(docs: DataFrame, id_col: str, columns: dict[str, float], query: str, *, prefix: bool = True, every: bool = False, most: int = 12) -> DataFrame:
    """(id, score) of the documents that hold any of the query's tokens (every: all of them), higher is better.

    A token matches terms that begin with it (prefix) or equal it. Frequencies of a document are weighted by field before
    saturation; the inverse document frequency counts documents in which the token matches, and is never negative.
    Only terms of the query are exploded; lengths are sizes of the token arrays, so nothing but matches is shuffled.
    """
    wanted = query_tokens(query, most)
    if not wanted:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    fields = {name: T.words(F.coalesce(F.col(name), F.lit(""))) for name in columns}
    rows = docs.select(F.col(id_col).alias("id"), *[tokens.alias(f"t{i}") for i, tokens in enumerate(fields.values())])
    length = sum((F.size(f"t{i}") for i in range(1, len(fields))), F.size("t0"))
    counts = []
    for token in wanted:
        weighted = [F.lit(float(w)) * F.size(F.filter(f"t{i}", _matches(token, prefix))) for i, w in enumerate(columns.values())]
        counts.append(sum(weighted[1:], weighted[0]))
    rows = rows.select("id", length.alias("length"), F.array(*counts).alias("tf"))
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(wanted))])
    rows = rows.where(F.exists("tf", lambda f: f > 0) if not every else F.forall("tf", lambda f: f > 0))
    scored = rows.crossJoin(F.broadcast(totals))  # one row
    norm = K1 * (1 - B + B * F.col("length") / F.col("average"))
    parts = []
    for i in range(len(wanted)):
        df, tf = F.col(f"df{i}"), F.col("tf")[i]
        idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - df + 0.5) / (df + 0.5)))
        parts.append(F.when(tf > 0, idf * tf * (K1 + 1) / (tf + norm)).otherwise(F.lit(0.0)))
    return scored.select("id", F.round(sum(parts[1:], parts[0]), 6).alias("score"))


def terms_of(text: Column) -> Column:
    """Terms of a folded text in order: words, and for every run of CJK its characters and pairs besides."""
    runs = F.regexp_extract_all(text, F.lit(T.CJK), F.lit(0))
    return F.concat(T.words(text), F.flatten(F.transform(runs, T.cjk_terms)))


def index_postings(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(term, id, field, tf, length): one row per term of a field; length is that of all fields. Accents and case don't count.

    Documents are read and folded once, whatever the number of fields.
    """
    folded = docs.select(F.col(id_col).alias("id"), *[T.without_accents(F.coalesce(F.col(c), F.lit(""))).alias(f"t{i}") for i, c in enumerate(columns)])
    fields = folded.select("id", *[terms_of(F.col(f"t{i}")).alias(c) for i, c in enumerate(columns)])
    length = sum((F.size(c) for c in columns[1:]), F.size(columns[0]))
    of = lambda field: F.transform(field, lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))
    each = F.concat(*map(of, columns))
    rows = fields.select("id", length.alias("length"), F.explode(each).alias("p")).select("id", "length", "p.field", "p.term")
    return rows.groupBy("term", "id", "field", "length").agg(F.count(F.lit(1)).alias("tf")).select("term", "id", "field", "tf", "length")


def index_stats(docs: DataFrame, postings_: DataFrame) -> DataFrame:
    """(n, average): how many documents there are, those without terms too, and their mean length; one row."""
    total = postings_.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    return docs.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("average"))


def wanted_terms(query: str, most: int = 12) -> list[tuple[str, bool]]:
    """(term, exact) of a query: its folded words, and for runs of CJK their pairs, or the character if there is one."""
    folded = "".join(c for c in unicodedata.normalize("NFKD", query).casefold() if not unicodedata.combining(c))
    out = []
    for word in re.findall(r"[^\W_]+", folded):
        if re.fullmatch(T.CJK, word):
            out += [(f"b{word[i : i + 2]}", True) for i in range(len(word) - 1)] or [(f"u{word}", True)]
        else:
            out.append((word, False))
    return out[:most]


def ranked(postings_: DataFrame, stats: DataFrame, weights: dict[str, float], query: str, *, prefix: bool = True, every: bool = False, most: int = 12) -> DataFrame:
    """(id, score) by bm25()'s formula, from written postings alone: nothing but the query's terms is read.

    Postings are sorted by term, so ranges of terms skip row groups. every: documents must hold all terms of the query.
    """
    wanted = wanted_terms(query, most)
    if not wanted:
        return postings_.select("id", F.lit(0.0).alias("score")).limit(0)
    hits = [(F.col("term") == t) if exact or not prefix else F.col("term").startswith(t) for t, exact in wanted]
    weight = F.lit(0.0)
    for field, w in weights.items():
        weight = F.when(F.col("field") == field, F.lit(float(w))).otherwise(weight)
    rows = postings_.where(reduce(lambda a, b: a | b, hits)).where(F.col("field").isin(*weights))
    rows = rows.groupBy("id").agg(F.first("length").alias("length"), F.array(*[F.sum(F.when(h, weight * F.col("tf")).otherwise(0.0)) for h in hits]).alias("tf"))
    counted = rows.agg(*[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(wanted))]).crossJoin(F.broadcast(stats))  # one row
    rows = rows.where(F.forall("tf", lambda f: f > 0)) if every else rows.where(F.exists("tf", lambda f: f > 0))
    norm = K1 * (1 - B + B * F.col("length") / F.col("average"))
    score = F.lit(0.0)
    for i in range(len(wanted)):
        df, tf = F.col(f"df{i}"), F.col("tf")[i]
        idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - df + 0.5) / (df + 0.5)))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + norm)).otherwise(F.lit(0.0))
    return rows.crossJoin(F.broadcast(counted)).select("id", F.round(score, 6).alias("score"))


def holds_phrases(docs: DataFrame, column: str, query: str) -> DataFrame:
    """docs whose column holds every CJK run of the query as it stands: what pairs found together may still lack."""
    runs = re.findall(T.CJK, unicodedata.normalize("NFKC", query))
    return docs.where(reduce(lambda a, b: a & b, [F.col(column).contains(r) for r in runs], F.lit(True)))


def exact_then_ranked(docs: DataFrame, id_col: str, keys: list[str], columns: dict[str, float], query: str, limit: int = 4) -> DataFrame:
    """(id, stage, score, place): rows whose key equals the query first (by key order), then by BM25; each id once."""
    wanted = query.strip().lower()
    which = F.lit(None).cast("int")
    for i, key in reversed(list(enumerate(keys))):
        which = F.when(F.lower(F.col(key)) == wanted, F.lit(i)).otherwise(which)
    exact = docs.select(F.col(id_col).alias("id"), which.alias("stage"), F.lit(0.0).alias("score")).where("stage is not null").orderBy("stage", "id").limit(limit)
    ranked = bm25(docs, id_col, columns, query).orderBy(F.desc("score"), "id").limit(3 * limit).select("id", F.lit(len(keys)).alias("stage"), "score")
    once = Window.partitionBy("id").orderBy("stage")
    both = exact.unionByName(ranked).withColumn("first", F.row_number().over(once)).where("first = 1").drop("first")
    order = Window.orderBy("stage", F.desc("score"), "id")  # over 4 * limit rows at most
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def contains_any(docs: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows any of whose columns holds the query, lower case; wildcards in the query are ordinary characters."""
    found = F.lit(False)
    for name in columns:
        found = found | F.coalesce(F.lower(F.col(name)).contains(query.lower()), F.lit(False))
    return docs.where(found)


def with_fallback(ranked: DataFrame, fallback: DataFrame) -> DataFrame:
    """ranked, or fallback if ranked has no row; both need the same columns."""
    none = ranked.agg((F.count(F.lit(1)) == 0).alias("none"))
    return ranked.unionByName(fallback.crossJoin(F.broadcast(none)).where("none").drop("none"))


def circular_start(seed: str, corpus: str, n: Column) -> Column:
    """Where a circular scan of n rows begins: a hash of corpus and seed."""
    return hash_offset(F.lit(f"{corpus}{NUL}{seed.strip().lower()}"), n)


def numbered(docs: DataFrame, order: list[str]) -> DataFrame:
    """docs with rn, 0-based by order, without gathering all rows in one task.

    Rows are range-partitioned by order and written, so that both readings see the same partitions; counts of partitions
    are few and give each its start.
    """
    parts = cut(docs.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part").orderBy(*order)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))).select("part", "start")
    placed = parts.withColumn("own", F.row_number().over(own) - 1)
    return placed.join(F.broadcast(starts), "part").withColumn("rn", F.col("start") + F.col("own")).drop("part", "own", "start")  # a row a partition


def draw(docs: DataFrame, order: list[str], seed: str, corpus: str, excluded: DataFrame | None = None, id_col: str = "id", limit: int = 1) -> DataFrame:
    """The first rows of docs from a hashed start on, going round; those in excluded (by id_col) are passed over."""
    rows = numbered(docs, order)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    placed = rows.crossJoin(F.broadcast(n)).withColumn("step", F.pmod(F.col("rn") - circular_start(seed, corpus, F.col("n")), F.col("n")))
    if excluded is not None:
        placed = placed.join(excluded.select(id_col).distinct(), id_col, "left_anti")
    return placed.orderBy("step").limit(limit).drop("rn", "n")


def draw_batch(docs: DataFrame, order: list[str], seed: str, corpus: str, excluded: DataFrame, id_col: str, limit: int) -> list:
    """limit draws, each from its own start `seed:i`, none twice, in one pass over the numbered rows.

    A draw can lose to at most limit - 1 earlier ones, so the first limit rows from each start on decide all; those are
    limit * limit ids at most, whatever the table's size.
    """
    rows = numbered(docs, order).join(excluded.select(id_col).distinct(), id_col, "left_anti").select(id_col, "rn")
    seeds = [seed if limit == 1 else f"{seed}:{i}" for i in range(limit)]
    starts = F.posexplode(F.array(*[circular_start(s, corpus, F.greatest("n", F.lit(1))) for s in seeds]))
    ring = docs.agg(F.count(F.lit(1)).alias("n")).select("n", starts.alias("draw", "start"))  # a row a draw
    step = F.pmod(F.col("rn") - F.col("start"), F.greatest("n", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy("draw").orderBy(step))
    near = rows.crossJoin(F.broadcast(ring)).withColumn("nth", nth).where(F.col("nth") <= limit).select("draw", "nth", id_col).collect()
    chosen: list = []
    for draw_ in range(limit):
        found = next((r[id_col] for r in sorted(near, key=lambda r: (r["draw"], r["nth"])) if r["draw"] == draw_ and r[id_col] not in chosen), None)
        if found is None:
            break
        chosen.append(found)
    return chosen


def name_search(nodes: DataFrame, query: str, limit: int = 20, label: str = "label", degree: str = "degree", id_col: str = "id") -> DataFrame:
    """Nodes whose label holds the query: 100 for equal labels, 50 for ones that begin with it, more for whole words; what is still equal goes by id."""
    low, wanted = F.lower(F.col(label)), query.strip().lower()
    points = F.when(low == wanted, 100).when(low.startswith(wanted), 50).otherwise(0) + F.when(F.concat(F.lit(" "), low, F.lit(" ")).contains(f" {wanted} "), 10).otherwise(0) + 5
    return nodes.where(low.contains(wanted)).withColumn("points", points).orderBy(F.desc("points"), F.desc(degree), F.lower(F.col(label)), id_col).limit(limit)
