"""Which rows count, and which come first: exact lookups, gates, joins on made-up keys, ranks that keep things balanced."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# lookups


def exact(rows: DataFrame, keys: list[str], value: str, order: list, limit: int, usable: Column | None = None) -> DataFrame:
    """Rows any of whose keys is the value, in the given order; what is not usable goes before the limit counts."""
    found = rows.where(reduce(lambda a, b: a | b, [F.col(k) == value for k in keys]))
    return (found if usable is None else found.where(usable)).orderBy(*order).limit(limit)


def ascii_key(text: Column) -> Column:
    """Text by which a column without regard to case compares: A to Z alone fall to lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_order_of(rows: DataFrame, key: str, wanted: list) -> DataFrame:
    """The rows of the wanted keys in the order they were asked for, with their place from 0; keys asked twice come twice."""
    spark = rows.sparkSession
    asked = spark.createDataFrame([(v,) for v in [list(wanted)]], f"w array<{rows.schema[key].dataType.simpleString()}>").select(F.posexplode("w").alias("place", key))
    return rows.join(asked, key)


def validated(query: str, language: str, most: int, limit: int) -> tuple[str, str, int]:
    """The arguments of a question as they are used, or ValueError: 1 to 300 characters, a language tag, 1 to most results."""
    flat = " ".join(query.split())
    if not 1 <= len(flat) <= 300:
        raise ValueError("a query has 1 to 300 characters")
    if not re.fullmatch(r"[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*", language):
        raise ValueError(f"{language!r} is no language tag")
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= most:
        raise ValueError(f"a limit is a whole number from 1 to {most}")
    return flat, language.lower(), limit


# gates


def begins_with_none(text: Column, prefixes: list[str]) -> Column:
    """Whether text begins with none of the prefixes; null text counts as foreign, so it passes."""
    return ~F.coalesce(reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes]), F.lit(False))


def rotation_eligible(payload: Column, mode: Column, graph_mode: str) -> Column:
    """Whether a card may come up again, from its JSON: 0 if that is invalid, 1 in other modes, else unless the graph it
    shows is a versioned one of a single node without edges."""
    parsed = F.try_parse_json(payload)
    count = lambda name: F.coalesce(F.json_array_length(F.get_json_object(payload, f"$.{name}")), F.lit(0))
    lone = F.get_json_object(payload, "$.projection").isNotNull() & (count("nodes") == 1) & (count("edges") == 0)
    return F.when(parsed.isNull(), 0).when(mode != graph_mode, 1).otherwise(F.when(lone, 0).otherwise(1))


def live_components(claims: DataFrame, supports: DataFrame) -> DataFrame:
    """Claims that name a component, or share one of a partial analysis, and have a live support."""
    named = (F.col("relation") == "has-component") | ((F.col("relation") == "shares-component") & (F.col("scope") == "partial"))
    return claims.where(named).join(supports.where("status = 'accepted'").select("claim_id").distinct(), "claim_id", "left_semi")


def bound_or_intended(rows: DataFrame, bindings: DataFrame, keys: list[str], kind: str, intents: list[str]) -> DataFrame:
    """Rows that a binding names by all keys, or whose kind begins with one of the intents; each row once."""
    marked = rows.join(bindings.select(*keys).distinct().withColumn("__bound", F.lit(True)), keys, "left")
    meant = reduce(lambda a, b: a | b, [F.coalesce(F.col(kind).startswith(i), F.lit(False)) for i in intents])
    return marked.where(F.col("__bound").isNotNull() | meant).drop("__bound")


def violations(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, in their order; a rule that is null is not broken."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def filtered_graph(nodes: DataFrame, edges: DataFrame, kinds: list[str] | None = None, bases: list[str] | None = None, focus: DataFrame | None = None, isolated: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes of some kinds (and of a focus), edges of some bases between them, and only nodes with an edge unless isolated ones may stay."""
    kept = nodes if kinds is None else nodes.where(F.col("kind").isin(kinds))
    kept = kept if focus is None else kept.join(focus.select("id").distinct(), "id", "left_semi")
    links = edges if bases is None else edges.where(F.col("basis").isin(bases))
    for end in ("source", "target"):
        links = links.join(kept.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    if not isolated:
        kept = kept.join(links.select(F.explode(F.array("source", "target")).alias("id")).distinct(), "id", "left_semi")
    return kept, links


def reference_counts(tables: dict[str, tuple[DataFrame, list[str]]], ids: DataFrame) -> DataFrame:
    """(id, place, references): how often each id is named in each declared column (table.column) that refers to it."""
    counted = [df.select(F.col(c).alias("id"), F.lit(f"{name}.{c}").alias("place")) for name, (df, columns) in tables.items() for c in columns]
    rows = reduce(DataFrame.unionByName, counted).join(ids.select("id").distinct(), "id", "left_semi")
    return rows.groupBy("id", "place").agg(F.count(F.lit(1)).alias("references"))


def owned(scope: str, *sets: DataFrame) -> DataFrame:
    """(scope, id): all ids that any of the sets names, each once."""
    return reduce(DataFrame.unionAll, [s.select(F.col(s.columns[0]).cast("string").alias("id")) for s in sets]).where("id is not null").distinct().select(F.lit(scope).alias("scope"), "id")


# balance


def by_balance(counts: DataFrame, order: list[str], turn: int) -> DataFrame:
    """(mode, n, place): every mode of the order, the least populated first; ties go round with the turn."""
    spark = counts.sparkSession
    known = spark.createDataFrame([(m, (i - turn) % len(order)) for i, m in enumerate(order)], "mode string, rotated int")  # a row a mode
    filled = known.join(counts, "mode", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.select("mode", "n", F.row_number().over(Window.orderBy("n", "rotated")).alias("place"))


def least_complete(progress: DataFrame) -> DataFrame:
    """The mode whose share of done is the least, by (done, total, place); modes without anything to do are left out."""
    return progress.where("total > 0 and done < total").orderBy(F.col("done") / F.col("total"), "place").limit(1)


def frontier(edges: DataFrame, known: DataFrame, excluded: DataFrame) -> DataFrame:
    """(id, links, families, best, nearest): what borders on the known ids but is neither known nor excluded, best first.

    More families of relations come first, then more known neighbours, the best confidence, the smallest neighbour, the id.
    """
    out = edges.join(known.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"), F.col("source").alias("neighbour"), "family", "confidence")
    out = out.join(known.select("id"), "id", "left_anti").join(excluded.select("id"), "id", "left_anti")
    ranked = out.groupBy("id").agg(F.countDistinct("neighbour").alias("links"), F.countDistinct("family").alias("families"), F.max("confidence").alias("best"), F.min("neighbour").alias("nearest"))
    return ranked.orderBy(F.desc("families"), F.desc("links"), F.desc("best"), "nearest", "id")


def next_of_frontier(candidates: DataFrame, epoch: int, families: list[str]) -> DataFrame:
    """One candidate (id, covered, family, place): those that cover most first; among them families take turns by epoch."""
    most = candidates.agg(F.max("covered").alias("most"))
    turn = F.lit(len(families))
    for i, family in enumerate(families):
        turn = F.when(F.col("family") == family, (i - epoch) % len(families)).otherwise(turn)
    return candidates.crossJoin(F.broadcast(most)).where("covered = most").drop("most").orderBy(turn, "place", "id").limit(1)  # most is one row


def capped_rollup(rows: DataFrame, group: str, member: str, most_groups: int = 64, most_members: int = 16) -> DataFrame:
    """(group, members, n, members_cut, groups_cut): the first groups by name, each with its first distinct members and whether more were there."""
    distinct = rows.select(group, member).where(F.col(group).isNotNull() & F.col(member).isNotNull()).distinct()
    first = distinct.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(member)))
    held = first.groupBy(group).agg(F.array_sort(F.collect_list(F.when(F.col("nth") <= most_members, F.col(member)))).alias("members"), F.count(F.lit(1)).alias("n"))
    kept = held.orderBy(group).limit(most_groups + 1)  # one more tells that there are more
    place = kept.withColumn("place", F.row_number().over(Window.orderBy(group)))
    return place.withColumn("groups_cut", F.count(F.lit(1)).over(Window.partitionBy()) > most_groups).where(F.col("place") <= most_groups).select(group, "members", "n", (F.col("n") > most_members).alias("members_cut"), "groups_cut")


def completion(subjects: DataFrame, wanted: DataFrame, done: DataFrame) -> DataFrame:
    """(subject, complete, missing, since): which of the wanted inputs each subject lacks, and the earliest date one is missed from.

    wanted: subject, input, due; done: subject, input. A subject that wants nothing is complete.
    """
    lacking = wanted.join(done.select("subject", "input").distinct(), ["subject", "input"], "left_anti")
    lacking = lacking.groupBy("subject").agg(F.array_sort(F.collect_set("input")).alias("missing"), F.min("due").alias("since"))
    out = subjects.select("subject").distinct().join(lacking, "subject", "left")
    return out.select("subject", F.col("missing").isNull().alias("complete"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), "since")


def senses_aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_word, right_word, ili): words of two languages whose senses carry the same interlingual index."""
    a = left.where("ili is not null").select("ili", F.col("word").alias("left_word"))
    return a.join(right.where("ili is not null").select("ili", F.col("word").alias("right_word")), "ili").distinct()


def language_profile(rows: DataFrame, registry: DataFrame, tag: str) -> DataFrame:
    """rows with the profile of their language tag: that of the tag itself, else of its primary part, else one made for it."""
    own = registry.select(F.col("tag").alias("__tag"), F.col("profile").alias("__own"))
    main = registry.select(F.col("tag").alias("__main"), F.col("profile").alias("__primary"))
    keyed = rows.withColumn("__tag", F.lower(F.col(tag))).withColumn("__main", F.split(F.lower(F.col(tag)), "-")[0])
    out = keyed.join(own, "__tag", "left").join(main, "__main", "left")
    return out.withColumn("profile", F.coalesce("__own", "__primary", F.concat(F.lit("ad-hoc:"), "__tag"))).drop("__tag", "__main", "__own", "__primary")


def declared(forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(form_id, state, kind, score): what a form with its gloss words is, by declarations of that form.

    A declaration fits if it holds all gloss words (0.99), or is held by them (0.95), 0.99 before 0.95; fitting declarations
    of one kind decide, of several are ambiguous, none is unknown. forms: form_id, form, gloss array; lexicon: form, kind, gloss.
    """
    both = forms.join(lexicon.select("form", "kind", F.col("gloss").alias("said")), "form")
    score = F.when(F.size(F.array_except("gloss", "said")) == 0, 0.99).when(F.size(F.array_except("said", "gloss")) == 0, 0.95)
    fits = both.withColumn("score", score).where("score is not null")
    best = fits.groupBy("form_id").agg(F.max("score").alias("top"))
    top = fits.join(best, "form_id").where("score = top").groupBy("form_id").agg(F.countDistinct("kind").alias("kinds"), F.min("kind").alias("kind"), F.max("score").alias("score"))
    out = forms.select("form_id").join(top, "form_id", "left")
    state = F.when(F.col("kinds") == 1, "declared").when(F.col("kinds") > 1, "ambiguous").otherwise("unknown")
    return out.select("form_id", state.alias("state"), F.when(F.col("kinds") == 1, F.col("kind")).alias("kind"), F.when(F.col("kinds") == 1, F.col("score")).alias("score"))


def first_category(rows: DataFrame, id_col: str, cascade: dict[str, Column], examples: int, other: str = "other") -> DataFrame:
    """(category, n, examples): the first condition that holds for a row is its category; with the smallest ids as examples."""
    category = F.lit(other)
    for name, condition in reversed(list(cascade.items())):
        category = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(category)
    placed = rows.select(F.col(id_col).alias("id"), category.alias("category"))
    nth = F.row_number().over(Window.partitionBy("category").orderBy("id"))
    counts = placed.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    first = placed.withColumn("nth", nth).where(F.col("nth") <= examples).groupBy("category").agg(F.array_sort(F.collect_list("id")).alias("examples"))
    return counts.join(first, "category")


def agreeing_evidence(*sides: DataFrame) -> DataFrame:
    """(id, evidence): ids for which every side has the same, non-empty set of evidence; each side: id, evidence_id."""
    sets = [s.groupBy("id").agg(F.array_sort(F.collect_set("evidence_id")).alias(f"e{i}")) for i, s in enumerate(sides)]
    joined = reduce(lambda a, b: a.join(b, "id"), sets)
    same = reduce(lambda a, b: a & b, [F.col("e0") == F.col(f"e{i}") for i in range(1, len(sides))], F.size("e0") > 0)
    return joined.where(same).select("id", F.col("e0").alias("evidence"))


def both_named(rows: DataFrame, text: str, *labels: str) -> DataFrame:
    """Rows whose text holds every label, all in lower case with white space collapsed; empty labels are held by nothing."""
    flat = lambda c: F.regexp_replace(F.trim(F.lower(F.col(c))), r"\s+", " ")
    return rows.where(reduce(lambda a, b: a & b, [(F.length(flat(c)) > 0) & flat(text).contains(flat(c)) for c in labels]))


def published_ids(cards: DataFrame, evidence: str, corpus: str) -> DataFrame:
    """The distinct entry ids of one corpus that accepted cards cite; evidence: array of (corpus, entry)."""
    return cards.where("status = 'accepted'").select(F.explode(evidence).alias("e")).where(F.col("e.corpus") == corpus).select(F.col("e.entry").alias("entry")).distinct()
