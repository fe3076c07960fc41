"""Compositions: what evidence each kind of card is made from, neighbourhoods by view, lanes of work, audits of cards."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import neighbourhood

Retriever = Callable[[str, int], DataFrame]


def retrieved(branches: list[tuple[str, Retriever, int]], query: str, limit: int) -> DataFrame:
    """(corpus, entry, branch, place): what the branches of a policy find for a query, in their order, each entry once.

    A branch is a name, a retriever of (corpus, entry, place) and how many it may give.
    """
    found = [find(query, most).select("corpus", "entry", F.lit(name).alias("branch"), F.lit(i).alias("__branch"), "place") for i, (name, find, most) in enumerate(branches)]
    once = Window.partitionBy("corpus", "entry").orderBy("__branch", "place")
    rows = reduce(DataFrame.unionByName, found).withColumn("nth", F.row_number().over(once)).where("nth = 1")
    placed = rows.withColumn("n", F.row_number().over(Window.orderBy("__branch", "place", "corpus", "entry")))  # of a few dozen rows
    return placed.where(F.col("n") <= limit).select("corpus", "entry", "branch", F.col("n").alias("place"))


#: What each mode retrieves from, and how much of it; the first are asked first.
POLICIES = {
    "word": (("words", 4), ("morphology", 2)), "origin": (("words", 2), ("morphology", 4)), "root": (("morphology", 6),), "affix": (("morphology", 6),),
    "question": (("cards", 1),), "knowledge": (("sections", 4), ("words", 2)),
}


def by_policy(mode: str, sources: dict[str, Retriever], query: str, limit: int = 6) -> DataFrame:
    """retrieved() with the branches of a mode; an unknown mode is an error."""
    if mode not in POLICIES:
        raise ValueError(f"no policy for mode {mode!r}")
    return retrieved([(name, sources[name], most) for name, most in POLICIES[mode]], query, limit)


def connected_evidence(focus: str, related: list[str], find: Retriever, queries: int = 3, records: int = 6) -> DataFrame:
    """Records for a focus and its nearest relatives: each of the first few is asked, usable excerpts alone count, each entry once."""
    asked = [focus, *[r for r in dict.fromkeys(related) if r != focus][: queries - 1]]
    parts = [find(q, records).withColumn("__asked", F.lit(i)) for i, q in enumerate(asked)]
    rows = reduce(DataFrame.unionByName, parts).where(T.usable_excerpt(F.col("excerpt")))
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("corpus", "entry").orderBy("__asked", "place"))).where("nth = 1")
    placed = first.withColumn("n", F.row_number().over(Window.orderBy("__asked", "place", "corpus", "entry")))  # of a few dozen rows
    return placed.where(F.col("n") <= records).select("corpus", "entry", F.col("__asked").alias("asked"), F.col("n").alias("place"))


#: Kinds of entities that each view shows.
VIEWS = {"word": ("term",), "knowledge": ("term",), "origin": ("term",), "root": ("root",), "affix": ("prefix", "suffix")}


def entities_by_view(entities: DataFrame, edges: DataFrame, query: str, view: str, limit: int) -> DataFrame:
    """(entity_id, label, degree) of accepted entities that a view shows and whose label begins with the query, richest first."""
    if view not in VIEWS:
        raise ValueError(f"no view {view!r}")
    degree = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("entity_id")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree"))
    found = entities.where("status = 'accepted'").where(F.col("kind").isin(*VIEWS[view])).where(F.lower("label").startswith(query.strip().lower()))
    return found.join(degree, "entity_id", "left").select("entity_id", "label", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), F.lower("label"), "entity_id").limit(limit)


def view_subgraph(edges: DataFrame, aliases: DataFrame, focus: DataFrame, depth: int, most: int) -> DataFrame:
    """(src, dst): edges among the nearest nodes of a focus, aliases taken for what they stand for; an edge within one falls away.

    Nodes go by depth and id up to `most`; every end of an edge that stays is one of them.
    """
    own = aliases.select("alias", "canonical")
    plain = edges.select("src", "dst")
    for end in ("src", "dst"):
        plain = plain.join(own.withColumnRenamed("alias", end), end, "left").withColumn(end, F.coalesce("canonical", end)).drop("canonical")
    plain = plain.where("src <> dst").distinct()
    ids = neighbourhood(plain, focus, depth).orderBy("depth", "id").limit(most).select("id")
    return plain.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def categories(kind: Column, derived: Column) -> Column:
    """The category of a node for display, by its kind; what a graph only derived is context."""
    out = F.lit("other")
    for name, kinds in (("evidence", ("record", "source")), ("history", ("history", "stage")), ("language", ("translation", "pronunciation")), ("part", ("root", "prefix", "suffix", "morpheme")), ("word", ("term", "meaning"))):
        out = F.when(kind.isin(*kinds), name).otherwise(out)
    return F.when(F.coalesce(derived, F.lit(False)), "context").otherwise(out)


def of_lane(ready: DataFrame, lane: str, quota: int, running: DataFrame) -> DataFrame:
    """The next job of a lane, unless as many of it as its quota run already: terms first, then priority, age and id."""
    busy = running.where(F.col("lane") == lane).agg((F.count(F.lit(1)) >= quota).alias("__full"))  # one row
    return ready.where(F.col("lane") == lane).crossJoin(F.broadcast(busy)).where("not __full").drop("__full").orderBy(F.when(F.col("subject_key").startswith("term:"), 0).otherwise(1), "priority", "created_at", "job_id").limit(1)


def eligible_sources(records: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Records whose text makes the declaration of their mode and holds their headword as a word of its own."""
    says = F.lit(False)
    for mode, pattern in declared.items():
        says = F.when(F.col("mode") == mode, F.col("text").rlike(pattern)).otherwise(says)
    return records.where(F.coalesce(says, F.lit(False)) & F.array_contains(T.words(F.col("text")), F.lower("headword")))


def canonical_parts(parts: DataFrame, accepted: DataFrame) -> DataFrame:
    """parts with the canonical id of the only accepted component of their form and kind, by the subject first, else by any."""
    one = lambda *keys: accepted.groupBy(*keys).agg(F.min("component_id").alias("found"), F.countDistinct("component_id").alias("n")).where("n = 1").drop("n")
    own = one("subject", "form", "kind").withColumnRenamed("found", "own")
    general = one("form", "kind").withColumnRenamed("found", "general")
    return parts.join(own, ["subject", "form", "kind"], "left").join(general, ["form", "kind"], "left").withColumn("component_id", F.coalesce("own", "general")).drop("own", "general")


def pseudocards(cards: DataFrame, drafts: DataFrame, records: DataFrame) -> DataFrame:
    """(card_id, state): what an audit makes of cards: sound, without a draft, without a record, or damaged.

    drafts: card_id, payload; records: record_id; a payload names its record and holds parts.
    """
    held = drafts.select("card_id", F.get_json_object("payload", "$.record_id").alias("record_id"), F.json_array_length(F.get_json_object("payload", "$.parts")).alias("parts"), F.lit(True).alias("drafted"))
    known = records.select(F.col("record_id").cast("string")).distinct().withColumn("known", F.lit(True))
    out = cards.join(held, "card_id", "left").join(known, "record_id", "left")
    state = F.when(F.col("drafted").isNull(), "no-draft").when(F.coalesce("parts", F.lit(0)) == 0, "damaged").when(F.col("known").isNull(), "no-record").otherwise("sound")
    return out.select("card_id", state.alias("state"))


def component_integrity(members: DataFrame) -> DataFrame:
    """(component, members, same_form_only, history, proposals): counts of what hangs on a component, by one pass.

    members: component, form, member_form, kind, basis.
    """
    return members.groupBy("component").agg(
        F.count(F.lit(1)).alias("members"), F.every(F.col("form") == F.col("member_form")).alias("same_form_only"),
        F.count_if(F.col("kind") == "history").alias("history"), F.count_if(F.col("basis") == "model").alias("proposals"),
    )


def equal_definitions(claims: DataFrame, components: DataFrame, meanings: DataFrame) -> DataFrame:
    """claim_id whose component and meaning say the same but for case and white space."""
    both = claims.join(components.select("component_id", F.col("text").alias("a")), "component_id").join(meanings.select("meaning_id", F.col("text").alias("b")), "meaning_id")
    return both.where((T.lower_key(F.col("a")) == T.lower_key(F.col("b"))) & (T.lower_key(F.col("a")) != "")).select("claim_id").distinct()


def drawn_until(fit: Callable[[list], object | None], draw: Callable[[list], object | None], attempts: int = 8, remembered: int = 24, excluded: list | None = None):
    """The first draw that fits, or None: what was drawn in vain is excluded from further draws, the last `remembered` at most."""
    tried = list(excluded or [])
    for _ in range(attempts):
        found = draw(tried[-remembered:])
        if found is None:
            return None
        if fit(found):
            return found
        tried.append(found)
    return None


def published(drafts: DataFrame, rules: dict[str, Column], *branch: str) -> DataFrame:
    """(card_id, status, violations): drafts that break no rule are published, of each branch the latest; the others say why not."""
    from .ledger import supersede_older
    from .selection import violations

    gated = drafts.withColumn("violations", violations(rules))
    gated = gated.withColumn("status", F.when(F.size("violations") == 0, "accepted").otherwise("rejected"))
    return supersede_older(gated, *branch).select("card_id", "status", "violations")
