"""Claims of many owners: merging, reduction to one authoritative fact, slots and their conflicts, spans, supersession."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strength of a basis, strongest first.
BASES = ("reviewed", "book", "model", "derived")


def basis_rank(basis: Column) -> Column:
    """0 for the strongest basis; anything unknown counts as derived."""
    out = F.lit(len(BASES) - 1)
    for rank, name in reversed(list(enumerate(BASES))):
        out = F.when(basis == name, rank).otherwise(out)
    return out


def merged_supports(supports: DataFrame, *keys: str) -> DataFrame:
    """One support per key: strongest basis, greatest confidence, properties of the strongest, all evidence.

    supports: keys, support_id, basis, confidence, properties, evidence array. One aggregation that combines map-side.
    """
    rank = basis_rank(F.col("basis"))
    best = F.min(F.struct(rank.alias("rank"), (-F.col("confidence")).alias("less"), "support_id", "basis", "properties"))
    return supports.groupBy(*keys).agg(best.alias("b"), F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence")).select(*keys, F.col("b.basis").alias("basis"), "confidence", F.col("b.properties").alias("properties"), "evidence")


def reduced(assertions: DataFrame, supports: DataFrame) -> DataFrame:
    """(assertion_id, action, basis, confidence, properties, evidence) of every assertion.

    accept: accepted supports decide; archive: there were supports, none is accepted; skip: never had one.
    supports: assertion_id, support_id, status, basis, confidence, properties, evidence.
    """
    live = merged_supports(supports.where("status = 'accepted'"), "assertion_id")
    ever = supports.select("assertion_id").distinct().withColumn("owned", F.lit(True))
    out = assertions.select("assertion_id").join(live, "assertion_id", "left").join(ever, "assertion_id", "left")
    action = F.when(F.col("basis").isNotNull(), "accept").when(F.col("owned"), "archive").otherwise("skip")
    return out.select("assertion_id", action.alias("action"), "basis", "confidence", "properties", "evidence")


def strongest_edges(claims: DataFrame, *keys: str) -> DataFrame:
    """The claim that speaks for each edge: by basis, confidence, revision, update time, then the greatest id."""
    by = F.struct((-basis_rank(F.col("basis"))).alias("strength"), "confidence", "revision", "updated_at", "claim_id")
    return claims.groupBy(*keys).agg(F.max(by).alias("b")).select(*keys, F.col("b.claim_id").alias("claim_id"), F.col("b.confidence").alias("confidence"))


def replace_scope(current: DataFrame, desired: DataFrame, owner: str) -> DataFrame:
    """All supports after an owner's scope is replaced: desired ones accepted, its others retired, other owners' as they are.

    current: owner, assertion_id, status, ...; desired: assertion_id and the columns it sets.
    """
    own, others = current.where(F.col("owner") == owner), current.where(F.coalesce(F.col("owner") != owner, F.lit(True)))
    gone = own.join(desired.select("assertion_id"), "assertion_id", "left_anti").withColumn("status", F.lit("retired"))
    new = desired.withColumn("owner", F.lit(owner)).withColumn("status", F.lit("accepted"))
    return others.unionByName(gone).unionByName(new.select(*current.columns))


#: How a slot treats several claims.
EXCLUSIVE, MEMBER, FREE = "exclusive", "set-member", "none"


def slot_mode(relation: Column, ordinal: Column) -> Column:
    return F.when((relation == "has-component") & ordinal.isNotNull(), EXCLUSIVE).when(relation == "shares-component", MEMBER).otherwise(FREE)


def slot_decisions(proposals: DataFrame, incumbents: DataFrame) -> DataFrame:
    """What becomes of each proposal for a slot, given the slot's accepted claim.

    proposals: proposal_id, slot, mode, basis, target, prompt_version, evidence, earlier (an array of struct<prompt_version,
    evidence> of earlier pending proposals for the target). incumbents: slot, basis, target (one per slot).
    coexist: the slot takes many; accept: it is free; noop: the same claim; update: a stronger basis for the same; keep: a
    model against a book; conflict: a book against a book; supersede: a book against a model, or a model against a model for
    the second time, with another prompt version and other evidence; pending: a model against a model before that.
    """
    held = incumbents.select("slot", F.col("basis").alias("held_basis"), F.col("target").alias("held_target"))
    rank, held_rank = basis_rank(F.col("basis")), basis_rank(F.col("held_basis"))
    again = F.exists(F.coalesce("earlier", F.array().cast("array<struct<prompt_version: string, evidence: string>>")), lambda e: (e["prompt_version"] != F.col("prompt_version")) & (e["evidence"] != F.col("evidence")))
    cited = lambda c: F.col(c).isin("book", "reviewed")
    decision = (
        F.when(F.col("mode") != EXCLUSIVE, "coexist")
        .when(F.col("held_target").isNull(), "accept")
        .when(F.col("target") == F.col("held_target"), F.when(rank < held_rank, "update").when(rank > held_rank, "keep").otherwise("noop"))
        .when(cited("held_basis"), F.when(cited("basis"), "conflict").otherwise("keep"))
        .when(cited("basis"), "supersede")
        .when(again, "supersede")
        .otherwise("pending")
    )
    return proposals.join(held, "slot", "left").select("proposal_id", "slot", decision.alias("decision"))


def superseded(artifacts: DataFrame, *keys: str) -> DataFrame:
    """artifacts with all but the newest accepted one of each key marked superseded."""
    newest = Window.partitionBy(*keys, "validation_state").orderBy(F.desc("created_at"), F.desc("artifact_id"))
    rank = F.row_number().over(newest)
    return artifacts.withColumn("__rank", rank).withColumn("validation_state", F.when((F.col("validation_state") == "accepted") & (F.col("__rank") > 1), "superseded").otherwise(F.col("validation_state"))).drop("__rank")


def unique_aliases(aliases: DataFrame) -> DataFrame:
    """(alias, canonical) of aliases that stand for exactly one canonical id."""
    return aliases.groupBy("alias").agg(F.count_distinct("canonical").alias("n"), F.min("canonical").alias("canonical")).where("n = 1").drop("n")


def greedy_spans(spans: DataFrame) -> DataFrame:
    """(group, span_id, chosen): per group the longest spans first, then the surest; one that overlaps a chosen one is left.

    Equal spans of equal identity may stand beside each other. spans: group, span_id, start, end, confidence, identity.
    A span goes by what was chosen before it, so a group is one task: a group is one word's spans. Groups come sorted and pass
    through in batches.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = object(), []
        for batch in batches:
            chosen = []
            for group, start, end, identity in zip(*[batch.column(c).to_pylist() for c in ("group", "start", "end", "identity")], strict=True):
                if group != last:
                    last, kept = group, []
                fits = all((start, end, identity) == other or end <= other[0] or other[1] <= start for other in kept)
                chosen.append(fits)
                if fits:
                    kept.append((start, end, identity))
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("span_id"), pa.array(chosen, pa.bool_())], names=["group", "span_id", "chosen"])

    rows = spans.select(F.col("group").cast("string").alias("group"), F.col("span_id").cast("long").alias("span_id"), "start", "end", "confidence", "identity")
    order = ["group", F.expr("start - end"), F.desc_nulls_last("confidence"), F.asc_nulls_last("identity"), "span_id"]
    return rows.repartition("group").sortWithinPartitions(*order).mapInArrow(choose, "group string, span_id bigint, chosen boolean")


def pieces_of(word: Column) -> Column:
    """Candidate parts of a word: starts and ends of 1 to 8 letters, inner stretches of 3 to 8, each once."""
    n = F.length(word)
    widths = F.sequence(F.lit(1), F.least(F.lit(8), n))
    starts = F.transform(widths, lambda w: F.substring(word, F.lit(1), w))
    ends = F.transform(widths, lambda w: F.substring(word, n - w + 1, w))
    inner = F.flatten(F.transform(F.filter(widths, lambda w: w >= 3), lambda w: F.transform(F.sequence(F.lit(1), n - w + 1), lambda i: F.substring(word, i, w))))
    return F.when(n > 0, F.array_distinct(F.concat(starts, ends, inner))).otherwise(F.array().cast("array<string>"))
