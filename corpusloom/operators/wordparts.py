"""Words and their parts: spans and gaps, evidence for a prompt, reviews that are due, aliases, derivatives, small graphs.

Everything that belongs to one word is a few rows or one short array, so folds over arrays and windows by word do the
work of loops; only steps along references run in rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import fingerprint
from ..sources.stages import cut
from .graph import closure, components
from .ledger import basis_rank

MOST_PARTS = 8


def coverage(word: Column, parts: Column) -> Column:
    """(aligned, unmatched, whole, gaps): where an array of parts stands in its word, in order.

    A part is sought from where the last one ended; aligned are (index, start, end), unmatched the indexes not found,
    whole the indexes of parts that are the whole word, gaps the spans (start, end) that no part covers.
    """
    none, spans = F.array().cast("array<int>"), "array<struct<index: int, start: int, end: int>>"
    start = F.struct(F.lit(0).alias("cursor"), F.array().cast(spans).alias("aligned"), none.alias("unmatched"), none.alias("whole"))
    numbered = F.transform(parts, lambda p, i: F.struct(i.alias("i"), p.alias("p")))

    def step(s: Column, x: Column) -> Column:
        at = F.call_function("locate", x["p"], word, s["cursor"] + 1) - 1
        is_whole, found = x["p"] == word, (F.length(x["p"]) > 0) & (at >= 0) & (x["p"] != word)
        span = F.struct(x["i"].alias("index"), at.cast("int").alias("start"), (at + F.length(x["p"])).cast("int").alias("end"))
        return F.struct(
            F.when(found, (at + F.length(x["p"])).cast("int")).otherwise(s["cursor"]).alias("cursor"),
            F.when(found, F.concat(s["aligned"], F.array(span))).otherwise(s["aligned"]).alias("aligned"),
            F.when(found | is_whole, s["unmatched"]).otherwise(F.concat(s["unmatched"], F.array(x["i"]))).alias("unmatched"),
            F.when(is_whole, F.concat(s["whole"], F.array(x["i"]))).otherwise(s["whole"]).alias("whole"),
        )

    folded = F.aggregate(numbered, start, step)
    return F.transform(F.array(folded), lambda s: F.struct(s["aligned"].alias("aligned"), s["unmatched"].alias("unmatched"), s["whole"].alias("whole"), gaps(word, s["aligned"]).alias("gaps")))[0]


def gaps(word: Column, spans: Column) -> Column:
    """(start, end) of what rising spans (start, end) leave of a word."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(word).cast("int")))
    return F.filter(F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("start"), s.alias("end"))), lambda g: g["start"] < g["end"])


def merged_parts(word: Column, proposed: Column, previous: Column) -> Column:
    """(parts, gaps): proposed parts in order, MOST_PARTS at most, and of the previous ones those that fit into what is left.

    Parts are (start, end, surface, previous). A previous part goes where it first stands in a free stretch; none is made up.
    """
    kinds = "array<struct<start: int, end: int, surface: string, previous: boolean>>"
    own = F.transform(F.slice(coverage(word, proposed)["aligned"], 1, MOST_PARTS), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(word, s["start"] + 1, s["end"] - s["start"]).alias("surface"), F.lit(False).alias("previous")))

    def put(held: Column, part: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.length(word) - F.length(part), F.lit(0)))
        clear = lambda i: F.forall(held, lambda h: (i >= h["end"]) | (i + F.length(part) <= h["start"]))
        fits = F.filter(places, lambda i: (F.substring(word, i + 1, F.length(part)) == part) & clear(i))
        span = F.struct(fits[0].cast("int").alias("start"), (fits[0] + F.length(part)).cast("int").alias("end"), part.alias("surface"), F.lit(True).alias("previous"))
        usable = (F.length(part) > 0) & (part != word) & (F.size(held) < MOST_PARTS) & (F.size(fits) > 0)
        return F.when(usable, F.array_sort(F.concat(held, F.array(span)))).otherwise(held)

    parts = F.aggregate(previous, own.cast(kinds), put)
    return F.transform(F.array(parts), lambda p: F.struct(p.alias("parts"), gaps(word, p).alias("gaps")))[0]


def merged_by_span(components_: DataFrame) -> DataFrame:
    """(term, start, end, form, component_id, aliases): of components with one form at one span the best founded stays.

    Those by basis, then confidence, then the greater id; the ids of the others are its aliases. Other spans don't matter.
    """
    best = Window.partitionBy("term", "start", "end", "form").orderBy(basis_rank(F.col("basis")), F.desc("confidence"), F.desc("component_id"))
    ranked = components_.withColumn("nth", F.row_number().over(best))
    return ranked.groupBy("term", "start", "end", "form").agg(
        F.max(F.when(F.col("nth") == 1, F.col("component_id"))).alias("component_id"), F.array_sort(F.collect_set(F.when(F.col("nth") > 1, F.col("component_id")))).alias("aliases")
    )


def packed_evidence(records: DataFrame, most: int = 8, budget: int = 2400) -> DataFrame:
    """(term, corpus, entry, excerpt, place): the records that go into a term's prompt, in order.

    Of records of one entry the longest excerpt stays. Required ones come first, then by rank, length and entry; they are
    taken in that order while they are no more than `most` and their excerpts together no longer than the budget.
    """
    key = ["term", "corpus", "entry"]
    once = records.groupBy(*key).agg(F.max(F.struct(F.length("excerpt").alias("n"), "excerpt"))["excerpt"].alias("excerpt"), F.bool_or("required").alias("required"), F.min("rank").alias("rank"))
    order = Window.partitionBy("term").orderBy(F.desc("required"), "rank", F.desc(F.length("excerpt")), "corpus", "entry")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = once.withColumn("place", F.row_number().over(order)).withColumn("used", F.sum(F.length("excerpt")).over(running))
    return placed.where((F.col("place") <= most) & (F.col("used") <= budget)).select(*key, "excerpt", "place")


def context_fingerprint(context: dict[str, Column]) -> Column:
    """A hash of the named fields alone, whatever else a context holds."""
    return fingerprint(*[context[name].alias(name) for name in sorted(context)])


def review_due(scope: Column, parts: Column, owned: Column, policy_current: Column, epoch: Column) -> Column:
    """Whether a word's structure is looked at again: at once without one; every second epoch while partial; never where only
    books say it; else at once if the policy changed, or every fourth epoch."""
    every = lambda n: (epoch > 0) & (epoch % n == 0)
    return F.when(scope.isNull() | ((scope != "partial") & (parts == 0)), True).when(scope == "partial", every(2)).when(~owned, False).otherwise(~policy_current | every(4))


def merged_paths(current: DataFrame, previous: DataFrame, focus: Column) -> DataFrame:
    """(component_id, steps, status, revised): paths after a visit: the focused one is new if it has steps, others keep theirs."""
    old = previous.select("component_id", F.col("steps").alias("__steps"), F.col("status").alias("__status"))
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    out = current.join(old, "component_id", "left")
    focused = F.coalesce(F.col("component_id") == focus, F.lit(False))
    revised = focused & has(F.col("steps"))
    steps = F.when(revised, F.col("steps")).when(has(F.col("__steps")), F.col("__steps")).otherwise(F.col("steps"))
    status = F.when(has(steps), "history-found").when(~focused, F.coalesce("__status", "status")).otherwise(F.col("status"))
    return out.select("component_id", steps.alias("steps"), status.alias("status"), revised.alias("revised"))


def obsolete_transitions(claims: DataFrame, current: DataFrame, producer: str) -> DataFrame:
    """claim_id of accepted model claims whose properties name the producer and which its current paths no longer hold."""
    mine = claims.where("status = 'accepted' and basis = 'model'").where(F.get_json_object("properties", "$.producer") == producer)
    return mine.join(current.select("source_id", "target_id").distinct(), ["source_id", "target_id"], "left_anti").select("claim_id")


def issues(rules: dict[str, tuple[int, Column]]) -> Column:
    """(issues, priority) of a row: the names of the rules it breaks, and the most urgent (least) of their priorities, else null."""
    found = F.array_compact(F.array(*[F.when(broken, F.struct(F.lit(p).alias("p"), F.lit(name).alias("name"))) for name, (p, broken) in rules.items()]))
    return F.struct(F.array_join(F.transform(found, lambda x: x["name"]), ",").alias("issues"), F.array_min(F.transform(found, lambda x: x["p"])).alias("priority"))


def live_eligible(payload: Column) -> Column:
    """Whether a live card may come up again: its graph has more than one node, each of them on an edge, and is a live one."""
    nodes = F.from_json(F.get_json_object(payload, "$.nodes"), "array<string>")
    ends = F.flatten(F.transform(F.from_json(F.get_json_object(payload, "$.edges"), "array<array<string>>"), lambda e: F.slice(e, 1, 2)))
    whole = F.size(F.array_except(nodes, F.coalesce(ends, F.array().cast("array<string>")))) == 0
    return F.coalesce((F.get_json_object(payload, "$.live") == "true") & (F.size(nodes) > 1) & whole, F.lit(False))


def resolved_projections(parts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(projection, ids): the canonical ids of each projection's parts by place; a projection with any unresolved part is void."""
    known = aliases.select("alias", "canonical")
    found = parts.join(known, "alias", "left").groupBy("projection").agg(
        F.every(F.col("canonical").isNotNull()).alias("whole"), F.transform(F.array_sort(F.collect_list(F.struct("place", "canonical"))), lambda x: x["canonical"]).alias("ids")
    )
    return found.where("whole").select("projection", "ids")


def derivatives(terms: DataFrame, most: int = 32) -> DataFrame:
    """(source, term, place): the terms derived from each source word that are worth showing, in the order given.

    Of terms alike but for case the first stays; the source itself, its parts and placeholders go. terms: source, place,
    term, excluded (array of keys).
    """
    key = F.lower(F.trim("term"))
    fit = (key != "") & (key != F.lower("source")) & ~F.array_contains("excluded", key) & ~key.rlike("^(?:n/?a|none|unknown|-+)$")
    first = terms.where(fit).withColumn("key", key).withColumn("nth", F.row_number().over(Window.partitionBy("source", "key").orderBy("place"))).where("nth = 1")
    placed = first.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("place")))
    return placed.where(F.col("n") <= most).select("source", F.trim("term").alias("term"), F.col("n").alias("place"))


def derivatives_for_view(terms: DataFrame, shown: Column, most: int = 24) -> DataFrame:
    """Terms that belong to no part, or to one that the view shows; the first of each source by place."""
    fit = terms.where((F.size("parts") == 0) | F.arrays_overlap("parts", shown))
    return fit.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("place"))).where(F.col("n") <= most)


def cited_roles(parts: DataFrame, cited: DataFrame) -> DataFrame:
    """parts with the role that citations give to the same ordinal and surface; two different roles are a conflict, not a choice."""
    roles = cited.groupBy("word", "ordinal", "surface").agg(F.countDistinct("role").alias("roles"), F.min("role").alias("role"))
    out = parts.join(roles, ["word", "ordinal", "surface"], "left")
    return out.select("word", "ordinal", "surface", F.when(F.col("roles") == 1, F.col("role")).alias("role"), (F.coalesce("roles", F.lit(0)) > 1).alias("conflict"))


def completeness(related: DataFrame, done: DataFrame, most: int = 16) -> DataFrame:
    """(subject, missing, n, truncated): related terms of each subject that are not complete yet, by name."""
    lacking = related.select("subject", "term").distinct().join(done.select("term").distinct(), "term", "left_anti")
    first = lacking.withColumn("nth", F.row_number().over(Window.partitionBy("subject").orderBy("term")))
    shown = F.array_sort(F.collect_list(F.when(F.col("nth") <= most, F.col("term"))))
    return first.groupBy("subject").agg(shown.alias("missing"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > most).alias("truncated"))


def normalized_nodes(nodes: DataFrame, evidence: DataFrame, most: int = 18) -> DataFrame:
    """(card, place, node_id, basis): the first nodes of each card; ids that repeat get their number, and book needs evidence."""
    placed = nodes.withColumn("n", F.row_number().over(Window.partitionBy("card").orderBy("place"))).where(F.col("n") <= most)
    again = placed.withColumn("nth", F.row_number().over(Window.partitionBy("card", "id").orderBy("place")))
    held = again.join(evidence.select("evidence_id").distinct().withColumn("__held", F.lit(True)), "evidence_id", "left")
    return held.select(
        "card", "place", F.when(F.col("nth") > 1, F.concat_ws("-", "id", "nth")).otherwise(F.col("id")).alias("node_id"),
        F.when((F.col("basis") == "book") & F.col("__held").isNull(), "model").otherwise(F.col("basis")).alias("basis"),
    )


def clauses(lines: DataFrame, anchor: str) -> DataFrame:
    """(doc_id, term, first_line, last_line): stretches of lines from one anchor to the next; lines: doc_id, place, line, n_lines."""
    heads = lines.where(F.col("line").rlike(anchor)).select("doc_id", "n_lines", "place", F.regexp_extract("line", anchor, 1).alias("term"))
    after = F.lead("place").over(Window.partitionBy("doc_id").orderBy("place"))
    return heads.select("doc_id", "term", F.col("place").alias("first_line"), (F.coalesce(after, F.col("n_lines")) - 1).alias("last_line"))


def followed(references: DataFrame, start: DataFrame, hops: int = 3, most: int = 6) -> DataFrame:
    """(root, id, hop): records that each root's references lead to within some hops, the first ones by hop and id.

    references: id, target; a record is visited once. Each round is written.
    """
    steps = references.select("id", "target").distinct()
    seen = frontier = start.select(F.col("id").alias("root"), "id", F.lit(0).alias("hop")).distinct()
    for hop in range(1, hops + 1):
        reached = frontier.join(steps, "id").select("root", F.col("target").alias("id")).distinct()
        frontier = cut(reached.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    placed = seen.where("hop > 0").withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("hop", "id")))
    return placed.where(F.col("n") <= most).select("root", "id", "hop")


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, connected): whether all nodes of each graph hang together; nodes: graph, id; edges: graph, src, dst."""
    name = lambda c: F.concat_ws("\x1f", F.col("graph").cast("string"), F.col(c).cast("string"))
    ids = nodes.select("graph", name("id").alias("id")).distinct()
    found = components(edges.select(name("src").alias("src"), name("dst").alias("dst")), ids.select("id"))
    return ids.join(found, "id").groupBy("graph").agg((F.countDistinct("component") == 1).alias("connected"))


def rooted(nodes: DataFrame, root) -> DataFrame:
    """(id, parent): a tree of all nodes; one whose chain of parents is broken or goes round hangs on the root itself."""
    links = nodes.where("id <> parent").select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    good = closure(links, nodes.where(F.col("id") == root).select("id")).withColumn("__good", F.lit(True))
    out = nodes.join(good, "id", "left")
    return out.select("id", F.when(F.col("id") == root, F.lit(None)).when(F.col("__good"), F.col("parent")).otherwise(F.lit(root)).alias("parent"))
