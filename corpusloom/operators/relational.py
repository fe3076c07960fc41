"""Relational patterns of the catalogue: keep-first and latest rows, merges, set differences, audits of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def latest(df: DataFrame, keys: list[str], *by: str) -> DataFrame:
    """The last row of each key by the given columns, by one aggregation that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*by, *[c for c in rest if c not in by])).alias("__best"))
    return best.select(*[F.col(c) if c in keys else F.col("__best")[c].alias(c) for c in df.columns])


def ordered(df: DataFrame, keys: list[str], order: list, name: str, start: int = 0) -> DataFrame:
    """Rows numbered from start within each key, before anything is filtered out."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1 + start)


def top_of_each(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key, with place and whether the key had more."""
    w = Window.partitionBy(*keys)
    return df.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("more", F.count(F.lit(1)).over(w) > k).where(F.col("place") <= k)


def after_key(df: DataFrame, key: str, cursor, limit: int) -> DataFrame:
    """One page of a keyset scan."""
    return df.where(F.col(key) > F.lit(cursor)).orderBy(key).limit(limit)


def endpoints(edges: DataFrame, *columns: str) -> DataFrame:
    """Each row once per distinct id among the named columns: the equi-join form of `id IN (a, b)`."""
    return edges.withColumn("endpoint", F.explode(F.array_distinct(F.array(*columns)))).where("endpoint is not null")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """current with the rows of changes put in or over it. A null in changes is a value."""
    kept = current.join(changes.select(*keys), keys, "left_anti")
    return kept.unionByName(changes)


def insert_ignore(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """current and those of rows, the first of each key, whose key it does not have."""
    return current.unionByName(keep_first(rows, keys, [F.lit(0)]).join(current.select(*keys), keys, "left_anti"))


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(side, keys): what is only left or only right, each once."""
    one = lambda a, b, side: a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti").select(F.lit(side).alias("side"), *keys)
    return one(left, right, "left").unionByName(one(right, left, "right"))


def set_mismatch(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose sets of values differ between two tables: rows that only one has, counted by key."""
    marked = left.select(key, value, F.lit(1).alias("side")).unionByName(right.select(key, value, F.lit(2).alias("side"))).distinct()
    sides = marked.groupBy(key, value).agg(F.sum("side").alias("sides"))
    return sides.groupBy(key).agg(F.count_if(F.col("sides") == 1).alias("only_left"), F.count_if(F.col("sides") == 2).alias("only_right")).where("only_left + only_right > 0")


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty, else an empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def checks(*named: tuple[str, DataFrame]) -> DataFrame:
    """(check, value): how many rows each named audit finds; all run as one plan."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("check"), "value") for name, df in named])


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def totals_and_groups(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """Aggregates of every value of key and of all rows (key null, is_total true), from one scan."""
    return df.rollup(key).agg((F.grouping(key) == 1).alias("is_total"), *aggregates)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two spans [start, end) share a place."""
    return (a_start < b_end) & (b_start < a_end)


def as_of(facts: DataFrame, contexts: DataFrame, keys: list[str], at: str, context_at: str) -> DataFrame:
    """Each fact with the latest context of its keys that is not after it; facts without one keep nulls.

    Both sides meet in one sorted pass per key, so no fact is paired with all contexts.
    """
    extra = [c for c in contexts.columns if c not in (*keys, context_at)]
    left = facts.withColumn("__at", F.col(at)).withColumn("__fact", F.lit(1)).withColumn("__ctx", F.lit(None).cast(_struct(contexts, [context_at, *extra])))
    right = contexts.select(*keys, F.col(context_at).alias("__at"), F.lit(0).alias("__fact"), F.struct(context_at, *extra).alias("__ctx"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__at", "__fact").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__ctx", F.last("__ctx", ignorenulls=True).over(w)).where("__fact = 1")
    return found.select(*facts.columns, *[F.col("__ctx")[c].alias(c) for c in (context_at, *extra)])


def nearest_texts(rows: DataFrame, key: str, text: str, size: str, by: list[str], reach: int) -> DataFrame:
    """(a_key, b_key, distance, gap): for every key the nearest other one of equal `by` whose size is at most reach away.

    Nearest by edit distance of the texts (null last), then by gap of the sizes, then by key; keys with no other are left out.
    Equal texts are at distance 0, so another row of the same text and size, or else the nearest size of the same text, is the
    answer; sorting finds both. Only other rows, those without text and those whose key is met twice are compared with their
    group's distinct (text, size), in an equi-join on bands of sizes.
    """
    kind, least, along = [*by, "text", "size"], F.col("least"), Window.partitionBy(*by, "text").orderBy("size")
    rows = rows.select(F.col(key).alias("a_key"), F.col(text).alias("text"), F.col(size).alias("size"), *by).dropna(subset=["a_key", "size", *by])
    rows = rows.withColumn("once", F.count(F.lit(1)).over(Window.partitionBy("a_key")) == 1)
    # the two least keys of each (text, size): all that a row can be answered with
    two = rows.withColumn("place", F.dense_rank().over(Window.partitionBy(*kind).orderBy("a_key"))).where("place <= 2")
    kinds = two.groupBy(*kind).agg(F.min("a_key").alias("least"), F.nullif(F.max("a_key"), F.min("a_key")).alias("second"))
    side = lambda f: F.when(F.abs(F.col("size") - f("size").over(along)) <= reach, F.struct(F.abs(F.col("size") - f("size").over(along)).alias("gap"), f("least").over(along).alias("b_key")))
    beside = kinds.withColumn("beside", F.least(side(F.lag), side(F.lead)))
    other = F.when(least == F.col("a_key"), F.col("second")).otherwise(least)
    copy = F.when(other.isNotNull(), F.struct((F.col("size") - F.col("size")).alias("gap"), other.alias("b_key")))
    met = rows.join(beside, kind, "left").withColumn("m", F.when(F.col("once"), F.coalesce(copy, F.col("beside"))))
    found = met.where("m is not null").select("a_key", "m.b_key", F.lit(0).alias("distance"), "m.gap")

    band = F.floor(F.col("size") / max(reach, 1))
    a = met.where("m is null").select("a_key", F.col("text").alias("a_text"), F.col("size").alias("a_size"), *by, F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    b = kinds.select("least", "second", F.col("text").alias("b_text"), F.col("size").alias("b_size"), *by, band.alias("band"))
    near = a.join(b, [*by, "band"]).withColumns({"gap": F.abs(F.col("a_size") - F.col("b_size")), "b_key": other}).where((F.col("gap") <= reach) & F.col("b_key").isNotNull())
    distance = F.levenshtein("a_text", "b_text")
    best = F.min(F.struct(distance.isNull().alias("none"), distance.alias("distance"), "gap", "b_key"))
    return found.unionByName(near.groupBy("a_key").agg(best.alias("m")).select("a_key", "m.b_key", "m.distance", "m.gap"))


def _struct(df: DataFrame, names: list[str]) -> str:
    return f"struct<{','.join(f'`{n}`:{df.schema[n].dataType.simpleString()}' for n in names)}>"
