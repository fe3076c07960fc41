"""Questions to a graph of claims: which claims count, which entities answer a query, what is known of a subject and why.

A graph is four DataFrames: entities (entity_id, kind, status, label, language), claims (claim_id, subject_id, source_id,
target_id, relation, basis, confidence, status), evidence (claim_id, evidence_id) and records (evidence_id, excerpt).
Endpoints and evidence are gated by semi-joins, so Spark broadcasts or shuffles them as their sizes ask.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import digest


@dataclass(frozen=True)
class Graph:
    entities: DataFrame
    claims: DataFrame
    evidence: DataFrame
    records: DataFrame

    def accepted(self) -> DataFrame:
        """Entities that count."""
        return self.entities.where("status = 'accepted'")


def accepted_claims(graph: Graph) -> DataFrame:
    """Accepted claims whose subject, source and target are all accepted entities."""
    ids = graph.accepted().select("entity_id").distinct()
    claims = graph.claims.where("status = 'accepted'")
    for end in ("subject_id", "source_id", "target_id"):
        claims = claims.join(ids.withColumnRenamed("entity_id", end), end, "left_semi")
    return claims


def resolvable_evidence(graph: Graph) -> DataFrame:
    """(claim_id, evidence_id) whose record is there, each pair once."""
    return graph.evidence.join(graph.records.select("evidence_id").distinct(), "evidence_id", "left_semi").select("claim_id", "evidence_id").distinct()


def grounded_claims(graph: Graph) -> DataFrame:
    """Accepted claims that rest on more than a model and on at least one record that is there."""
    return accepted_claims(graph).where("basis <> 'model'").join(resolvable_evidence(graph).select("claim_id").distinct(), "claim_id", "left_semi")


def claims_with_unaccepted_ends(graph: Graph) -> DataFrame:
    """(claim_id, end): accepted claims and their ends that are known but not accepted; ends are exploded, not or-joined."""
    ends = graph.claims.where("status = 'accepted'").select("claim_id", F.explode(F.array_distinct(F.array("subject_id", "source_id", "target_id"))).alias("end"))
    return ends.join(graph.entities.where("status <> 'accepted'").select(F.col("entity_id").alias("end")).distinct(), "end", "left_semi")


def canonical_subjects(graph: Graph) -> DataFrame:
    """(entity_id, subject_id) of accepted entities: the term that a translation or a meaning is grounded in, else itself.

    Of several claims on an entity the strongest decides: by confidence, then the smallest subject.
    """
    best = Window.partitionBy("target_id").orderBy(F.desc("confidence"), "subject_id")
    claims = grounded_claims(graph).select("target_id", "subject_id", "confidence").withColumn("place", F.row_number().over(best)).where("place = 1")
    found = graph.accepted().join(claims.select(F.col("target_id").alias("entity_id"), "subject_id"), "entity_id", "left")
    return found.select("entity_id", F.when(F.col("kind") == "term", F.col("entity_id")).otherwise(F.coalesce("subject_id", "entity_id")).alias("subject_id"))


#: Order of kinds among candidates that match equally well.
KINDS = ("term", "meaning", "translation")


def candidates(graph: Graph, query: str, language: str, limit: int) -> DataFrame:
    """(place, subject_id, entity_id, match_rank): what a query may mean, best first, each canonical subject once.

    Equal labels come before labels that begin with the query, and those before labels that hold it. Each of these branches
    is cut, by kind, to limit * 4 (equal, beginning) or limit * 2 (holding) rows by label and id before all are sorted; the
    subject of a candidate is taken after that, and the first candidate of a subject stands for it.
    """
    wanted = " ".join(query.lower().split())
    rows = graph.accepted().select("entity_id", "kind", "language", F.lower("label").alias("label"))
    equal, begins = F.col("label") == wanted, F.col("label").startswith(wanted)
    branches = [(0, 4, equal), (1, 4, begins & ~equal), (2, 2, F.col("label").contains(wanted) & ~begins)]
    found = None
    for rank, over, condition in branches:
        for order, kind in enumerate(KINDS):
            part = rows.where(condition & (F.col("kind") == kind)).orderBy("label", "entity_id").limit(limit * over)
            part = part.withColumn("match_rank", F.lit(rank)).withColumn("kind_order", F.lit(order))
            found = part if found is None else found.unionByName(part)
    found = found.join(canonical_subjects(graph), "entity_id")
    key = ["match_rank", F.when(F.col("language") == language, 0).otherwise(1), "kind_order", "label", "entity_id"]
    first = found.withColumn("nth", F.row_number().over(Window.partitionBy("subject_id").orderBy(*key))).where("nth = 1")
    placed = first.withColumn("place", F.row_number().over(Window.orderBy(*key)))  # of a few dozen rows
    return placed.where(F.col("place") <= limit).select("place", "subject_id", "entity_id", "match_rank")


def facts(graph: Graph, subjects: DataFrame, language: str, most: int = 8) -> DataFrame:
    """(subject_id, relation, labels, truncated): what grounded claims say of each subject, most labels for each relation.

    Labels in the wanted language come first, then by confidence, label and id.
    """
    claims = grounded_claims(graph).join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    ends = graph.entities.select(F.col("entity_id").alias("target_id"), "label", "language")
    rows = claims.join(ends, "target_id").groupBy("subject_id", "relation", "target_id", "label", "language").agg(F.max("confidence").alias("confidence"))
    order = Window.partitionBy("subject_id", "relation").orderBy(F.when(F.col("language") == language, 0).otherwise(1), F.desc("confidence"), "label", "target_id")
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most + 1)  # one more tells that there are more
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("place", "label")))), lambda x: x["label"])
    return rows.groupBy("subject_id", "relation").agg(shown.alias("labels"), (F.max("place") > most).alias("truncated"))


def trace(graph: Graph, claims: DataFrame, most: int = 8) -> DataFrame:
    """(claim_id, subject, relation, target, basis, status, grounded, evidence, evidence_count): why each named claim holds.

    Claims of a model show no evidence. Evidence is the first ids, `most` of them, of records that are there.
    """
    named = graph.claims.join(claims.select("claim_id").distinct(), "claim_id", "left_semi")
    kept = resolvable_evidence(graph).join(named.where("basis <> 'model'").select("claim_id"), "claim_id", "left_semi")
    held = kept.groupBy("claim_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("ids"))
    label = lambda name, end: graph.entities.select(F.col("entity_id").alias(end), F.col("label").alias(name))
    out = named.join(held, "claim_id", "left").join(label("subject", "subject_id"), "subject_id", "left").join(label("target", "target_id"), "target_id", "left")
    count = F.coalesce(F.size("ids"), F.lit(0))
    live = grounded_claims(graph).select("claim_id", F.lit(True).alias("live"))
    return out.join(live, "claim_id", "left").select(
        "claim_id", "subject", "relation", "target", "basis", "status", F.coalesce("live", F.lit(False)).alias("grounded"),
        F.coalesce(F.slice("ids", 1, most), F.array().cast("array<string>")).alias("evidence"), F.greatest(count, F.lit(0)).cast("bigint").alias("evidence_count"),
    )


def answer(graph: Graph, query: str, language: str, limit: int = 5, most_claims: int = 32) -> DataFrame:
    """(place, subject_id, label, facts, claims, evidence, truncated, fingerprint): the whole answer to a query.

    Of each candidate's subject: its facts, its strongest grounded claims, the distinct evidence behind those, and a hash
    of all that, by which two answers compare.
    """
    found = candidates(graph, query, language, limit)
    said = facts(graph, found, language)
    said = said.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.concat_ws("=", "relation", F.array_join("labels", "|")))).alias("facts"))
    own = grounded_claims(graph).join(found.select("subject_id"), "subject_id", "left_semi")
    strongest = Window.partitionBy("subject_id").orderBy(F.desc("confidence"), "claim_id")
    own = own.withColumn("place", F.row_number().over(strongest)).where(F.col("place") <= most_claims + 1)
    cut = own.groupBy("subject_id").agg((F.max("place") > most_claims).alias("truncated"))
    own = own.where(F.col("place") <= most_claims)
    behind = own.join(resolvable_evidence(graph), "claim_id").groupBy("subject_id").agg(F.countDistinct("evidence_id").alias("evidence"), F.countDistinct("claim_id").alias("claims"))
    out = found.join(graph.entities.select(F.col("entity_id").alias("subject_id"), "label"), "subject_id", "left")
    for part in (said, behind, cut):
        out = out.join(part, "subject_id", "left")
    out = out.select(
        "place", "subject_id", "label", F.coalesce("facts", F.array().cast("array<string>")).alias("facts"), F.coalesce("claims", F.lit(0)).alias("claims"),
        F.coalesce("evidence", F.lit(0)).alias("evidence"), F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )
    sealed = digest(F.concat_ws("\x1f", "subject_id", F.array_join("facts", ";"), F.col("claims").cast("string"), F.col("evidence").cast("string")))
    return out.withColumn("fingerprint", sealed)


def neighbours_both_ways(graph: Graph, subjects: DataFrame, most: int = 80) -> DataFrame:
    """(subject_id, direction, relation, other_id, claims, evidence): accepted relations of nodes, with evidence up to a limit."""
    claims = accepted_claims(graph).where("source_id <> target_id")
    out = claims.select(F.col("source_id").alias("subject_id"), F.lit("out").alias("direction"), "relation", F.col("target_id").alias("other_id"), "claim_id")
    into = claims.select(F.col("target_id").alias("subject_id"), F.lit("in").alias("direction"), "relation", F.col("source_id").alias("other_id"), "claim_id")
    both = out.unionByName(into).join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    held = both.join(resolvable_evidence(graph), "claim_id", "left").groupBy("subject_id", "direction", "relation", "other_id")
    return held.agg(F.countDistinct("claim_id").alias("claims"), F.least(F.countDistinct("evidence_id"), F.lit(most)).cast("bigint").alias("evidence"))


def evidence_bridge(graph: Graph, entity_evidence: DataFrame, subjects: DataFrame, most: int = 40) -> DataFrame:
    """(subject_id, evidence_id): evidence on the entity itself and on its claims, at most `most` of each by id, each id once."""
    order = Window.partitionBy("subject_id").orderBy("evidence_id")
    first = lambda df: df.distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth")
    mine = entity_evidence.select(F.col("entity_id").alias("subject_id"), "evidence_id").join(subjects, "subject_id", "left_semi")
    claimed = graph.claims.select("claim_id", "subject_id").join(subjects, "subject_id", "left_semi").join(graph.evidence, "claim_id").select("subject_id", "evidence_id")
    return first(mine).unionByName(first(claimed)).dropDuplicates(["subject_id", "evidence_id"])


def snapshot(graph: Graph) -> DataFrame:
    """(kind, id, payload): all accepted entities as nodes and all accepted claims between them as edges, in one table."""
    nodes = graph.accepted().select(F.lit("node").alias("kind"), F.col("entity_id").alias("id"), F.concat_ws("|", "kind", "language", "label").alias("payload"))
    edges = accepted_claims(graph).select(F.lit("edge").alias("kind"), F.col("claim_id").cast("string").alias("id"), F.concat_ws("|", "source_id", "relation", "target_id", "basis").alias("payload"))
    return nodes.unionByName(edges)


def language_fields(graph: Graph) -> DataFrame:
    """(subject_id, language, translation, hops): best translation of each term in each language, over one or two claims.

    A term's meaning may render as a translation of its own. The direct claim wins, then the confidence of the claim that
    names the translation, then label and id. Renderings are reduced to the best of each meaning before terms meet them.
    """
    claims = grounded_claims(graph)
    ends = graph.accepted().where("kind = 'translation'").select(F.col("entity_id").alias("target_id"), "language", "label")

    def best(rows: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("hops", F.desc("confidence"), "label", "target_id")
        return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")

    direct = claims.where("relation = 'has-translation'").join(ends, "target_id").select(F.col("source_id").alias("subject_id"), "target_id", "language", "label", "confidence", F.lit(1).alias("hops"))
    renders = claims.where("relation = 'renders-as'").join(ends, "target_id").select(F.col("source_id").alias("mid"), "target_id", "language", "label", "confidence", F.lit(2).alias("hops"))
    means = claims.where("relation = 'has-meaning'").select(F.col("source_id").alias("subject_id"), F.col("target_id").alias("mid")).distinct()
    over = means.join(best(renders, "mid", "language"), "mid").drop("mid")
    return best(direct.unionByName(over), "subject_id", "language").select("subject_id", "language", F.col("label").alias("translation"), "hops")


def language_atoms(graph: Graph, pronunciations: DataFrame) -> DataFrame:
    """(subject_id, language, translation, pronunciation, confidence): the latest pronunciation of each best translation.

    pronunciations: (subject_id, language, sound, confidence, created_at, id). The confidence of an atom is the lesser of
    its parts'; a translation without pronunciation stays, with its own.
    """
    latest = Window.partitionBy("subject_id", "language").orderBy(F.desc("created_at"), F.desc("id"))
    sounds = pronunciations.withColumn("nth", F.row_number().over(latest)).where("nth = 1").select("subject_id", "language", F.col("sound").alias("pronunciation"), F.col("confidence").alias("heard"))
    terms = language_fields(graph).withColumn("said", F.when(F.col("hops") == 1, F.lit(0.9)).otherwise(F.lit(0.7)))
    return terms.join(sounds, ["subject_id", "language"], "left").select("subject_id", "language", "translation", "pronunciation", F.least("said", F.coalesce("heard", "said")).alias("confidence"))


def overview(graph: Graph, entity_evidence: DataFrame, sources: DataFrame, most_collections: int = 64, most_hashes: int = 16, most_languages: int = 128) -> DataFrame:
    """(collection, evidence_records, hashes, hashes_cut, collections_cut, entities, claims, languages, languages_cut).

    Collections and their records count as far as an accepted entity or a grounded claim rests on them; sources: evidence_id,
    corpus, hash. Numbers of entities, claims and languages are those of the whole graph.
    """
    live = entity_evidence.join(graph.accepted().select("entity_id"), "entity_id", "left_semi").select("evidence_id")
    claimed = graph.evidence.join(accepted_claims(graph).where("basis <> 'model'").select("claim_id"), "claim_id", "left_semi").select("evidence_id")
    used = sources.join(live.unionByName(claimed).distinct(), "evidence_id", "left_semi")
    first = Window.partitionBy("corpus").orderBy("hash")
    by_hash = used.groupBy("corpus", "hash").agg(F.countDistinct("evidence_id").alias("n")).withColumn("nth", F.row_number().over(first))
    held = by_hash.groupBy("corpus").agg(F.sum("n").alias("evidence_records"), F.array_sort(F.collect_list(F.when(F.col("nth") <= most_hashes, F.col("hash")))).alias("hashes"), (F.max("nth") > most_hashes).alias("hashes_cut"))
    shown = held.orderBy("corpus").limit(most_collections + 1).withColumn("place", F.row_number().over(Window.orderBy("corpus")))
    shown = shown.withColumn("collections_cut", F.max("place").over(Window.partitionBy()) > most_collections).where(F.col("place") <= most_collections)
    tongues = graph.accepted().where("language is not null").select("language").distinct().orderBy("language").limit(most_languages + 1)
    tongues = tongues.agg(F.slice(F.array_sort(F.collect_list("language")), 1, most_languages).alias("languages"), (F.count(F.lit(1)) > most_languages).alias("languages_cut"))
    totals = graph.accepted().agg(F.count(F.lit(1)).alias("entities")).crossJoin(grounded_claims(graph).agg(F.count(F.lit(1)).alias("claims"))).crossJoin(tongues)  # one row each
    return shown.crossJoin(F.broadcast(totals)).select(F.col("corpus").alias("collection"), "evidence_records", "hashes", "hashes_cut", "collections_cut", "entities", "claims", "languages", "languages_cut")
