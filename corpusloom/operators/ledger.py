"""Changes of state as queries on snapshots: what supersedes, archives, moves, expires, is due, or must not change again.

Every function takes tables as they are and returns them as they should be, or the rows that change; nothing is updated in
place, so a lost job is simply run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import digest, fingerprint

#: What a claim rests on, the strongest first.
RANK = {"reviewed": 0, "book": 1, "model": 2, "derived": 3}


def basis_rank(basis: Column) -> Column:
    out = F.lit(len(RANK))
    for name, rank in RANK.items():
        out = F.when(basis == name, rank).otherwise(out)
    return out


# cards


def supersede_older(cards: DataFrame, *keys: str) -> DataFrame:
    """cards, but of the accepted ones that agree in keys only the latest (created_at, card_id) stays accepted."""
    latest = cards.where("status = 'accepted'").groupBy(*keys).agg(F.max(F.struct("created_at", "card_id"))["card_id"].alias("__last"))
    older = (F.col("status") == "accepted") & (F.col("card_id") != F.col("__last"))
    return cards.join(latest, list(keys), "left").withColumn("status", F.when(older, "superseded").otherwise(F.col("status"))).select(*cards.columns)


def archive_absent(cards: DataFrame, authoritative: DataFrame, *keys: str) -> DataFrame:
    """cards, but those accepted whose keys an authoritative set lacks are archived."""
    there = authoritative.select(*keys).distinct().withColumn("__there", F.lit(True))
    gone = (F.col("status") == "accepted") & F.col("__there").isNull()
    return cards.join(there, list(keys), "left").withColumn("status", F.when(gone, "archived").otherwise(F.col("status"))).select(*cards.columns)


def random_accepted(cards: DataFrame, mode: str, recent: DataFrame, draw: int) -> DataFrame:
    """The accepted card of a mode at the drawn place, recent ones left out unless nothing else is there; at most one row.

    draw stands for the random number, so that a caller can repeat it. Places go by the hash of the card, and only the
    smallest from the drawn hash on is sought: no rows are numbered.
    """
    pool = cards.where((F.col("status") == "accepted") & (F.col("mode") == mode))
    fresh = pool.join(recent.select("card_id").distinct().withColumn("recent", F.lit(1)), "card_id", "left")
    place = F.pmod(F.conv(F.substring(digest(F.col("card_id")), 1, 8), 16, 10).cast("bigint") - F.lit(draw % 2**32), F.lit(2**32))
    return fresh.orderBy(F.coalesce("recent", F.lit(0)), place, "card_id").limit(1).select(*cards.columns)


def purge(cards: DataFrame, runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(level, id) of what goes with archived cards: the cards, runs all of whose cards go, artifacts all of whose runs go.

    runs: (run_id, card_id); artifacts: (artifact_id, run_id). What another living thing still needs stays.
    """
    gone = cards.where("status = 'archived'").select("card_id").distinct()
    kept_runs = runs.join(gone, "card_id", "left_anti").select("run_id").distinct()
    gone_runs = runs.select("run_id").distinct().join(kept_runs, "run_id", "left_anti")
    kept = artifacts.join(gone_runs, "run_id", "left_anti").select("artifact_id").distinct()
    gone_artifacts = artifacts.select("artifact_id").distinct().join(kept, "artifact_id", "left_anti")
    row = lambda df, level, name: df.select(F.lit(level).alias("level"), F.col(name).cast("string").alias("id"))
    return row(gone_artifacts, "artifact", "artifact_id").unionByName(row(gone_runs, "run", "run_id")).unionByName(row(gone, "card", "card_id"))


# claims


def decisions_to_log(log: DataFrame, proposals: DataFrame, *fields: str) -> DataFrame:
    """(claim_id, seq, fields, seal) of proposals that differ from the last decision logged for their claim; a replay logs nothing.

    log: claim_id, seq, seal; proposals: claim_id and fields, one row a claim.
    """
    last = log.groupBy("claim_id").agg(F.max(F.struct("seq", "seal")).alias("last")).select("claim_id", "last.seq", F.col("last.seal").alias("sealed"))
    sealed = proposals.withColumn("seal", fingerprint(*fields))
    fresh = sealed.join(last, "claim_id", "left").where("sealed is null or sealed <> seal")
    return fresh.select("claim_id", (F.coalesce("seq", F.lit(0)) + 1).cast("bigint").alias("seq"), *fields, "seal")


def next_revision(revision: Column, changes: Column) -> Column:
    """A graph's revision: one more if anything changed."""
    return revision + F.when(changes > 0, 1).otherwise(0)


def merged_supports(supports: DataFrame, merged: DataFrame) -> DataFrame:
    """Supports after assertions were merged (source_id into target_id): one of each (assertion, owner).

    The basis is that of the strongest by rank and confidence, the confidence the highest, the evidence of all together, and
    the status accepted if any was.
    """
    moved = supports.join(merged.select(F.col("source_id").alias("assertion_id"), "target_id"), "assertion_id", "left")
    moved = moved.withColumn("assertion_id", F.coalesce("target_id", "assertion_id"))
    best = F.min(F.struct(basis_rank(F.col("basis")).alias("rank"), (-F.col("confidence")).alias("low"), "support_id", "basis"))
    out = moved.groupBy("assertion_id", "owner").agg(
        best.alias("best"), F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"),
        F.bool_or(F.col("status") == "accepted").alias("live"),
    )
    return out.select("assertion_id", "owner", "best.support_id", "best.basis", "confidence", "evidence", F.when(F.col("live"), "accepted").otherwise("retired").alias("status"))


def automatic_only(events: DataFrame, *patterns: str) -> DataFrame:
    """(assertion_id, automatic): whether every event of an assertion is of an automatic kind; one that is not decides."""
    fits = F.lit(False)
    for pattern in patterns:
        fits = fits | F.coalesce(F.col("kind").rlike(pattern), F.lit(False))
    return events.groupBy("assertion_id").agg(F.every(fits).alias("automatic"))


def stale_of_record(claims: DataFrame, current: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id of accepted claims of a record that its new reading lacks and that no other record supports.

    claims: claim_id, record_id, key, status; current: record_id, key; evidence: claim_id, record_id.
    """
    lost = claims.where("status = 'accepted'").join(current.select("record_id", "key").distinct(), ["record_id", "key"], "left_anti")
    outside = evidence.select("claim_id", F.col("record_id").alias("other")).join(claims.select("claim_id", "record_id"), "claim_id").where("other <> record_id")
    return lost.select("claim_id").distinct().join(outside.select("claim_id"), "claim_id", "left_anti")


def missing_links(proofs: DataFrame, edges: DataFrame, records: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_id, target_id, relation) that records prove between accepted entities and no live edge holds, each once."""
    ids = entities.where("status = 'accepted'").select("entity_id")
    proven = proofs.join(records.select("evidence_id").distinct(), "evidence_id", "left_semi")
    for end in ("source_id", "target_id"):
        proven = proven.join(ids.withColumnRenamed("entity_id", end), end, "left_semi")
    live = edges.where("status = 'accepted'").select("source_id", "target_id", "relation").distinct()
    return proven.select("source_id", "target_id", "relation").distinct().join(live, ["source_id", "target_id", "relation"], "left_anti")


def resolved_edges(translations: DataFrame, edges: DataFrame) -> DataFrame:
    """(translation_id, edge_id, how): the edge a translation belongs to: as it says, by its target, or by its only topology.

    translations: translation_id, edge_id, subject_id, target_id; edges: edge_id, source_id, target_id. A way counts only if
    it leads to one edge; how is explicit, endpoint, topology or unresolved.
    """
    known = edges.select(F.col("edge_id").alias("explicit")).distinct()
    single = lambda *keys: edges.groupBy(*keys).agg(F.min("edge_id").alias("found"), F.countDistinct("edge_id").alias("n")).where("n = 1").drop("n")
    by_end = single("source_id", "target_id").toDF("subject_id", "target_id", "endpoint")
    by_source = single("source_id").toDF("subject_id", "topology")
    out = translations.join(known, F.col("edge_id") == F.col("explicit"), "left").join(by_end, ["subject_id", "target_id"], "left").join(by_source, "subject_id", "left")
    how = F.when(F.col("explicit").isNotNull(), "explicit").when(F.col("endpoint").isNotNull(), "endpoint").when(F.col("topology").isNotNull(), "topology").otherwise("unresolved")
    return out.select("translation_id", F.coalesce("explicit", "endpoint", "topology").alias("edge_id"), how.alias("how"))


def backfill_report(resolved: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """(counter, value): what a backfill of edge evidence would find and do; resolved: resolved_edges()'s rows."""
    held = evidence.select("edge_id").distinct().withColumn("held", F.lit(True))
    state = edges.join(held, "edge_id", "left").agg(F.count(F.lit(1)).alias("edges"), F.count("held").alias("edges_with_evidence"), (F.count(F.lit(1)) - F.count("held")).alias("edges_without_evidence"))
    ways = resolved.join(held, "edge_id", "left").agg(
        F.count(F.lit(1)).alias("translations"), *[F.count_if(F.col("how") == w).alias(f"resolved_{w}" if w != "unresolved" else w) for w in ("explicit", "endpoint", "topology", "unresolved")],
        F.count_if((F.col("how") != "unresolved") & F.col("held").isNull()).alias("to_write"), F.countDistinct("edge_id").alias("edges_named"),
    )
    counters = lambda df: df.select(F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c).cast("bigint"))])).alias("counter", "value"))
    return counters(state).unionByName(counters(ways))


def reconciliation(artifacts: DataFrame, accepted: DataFrame, entities: DataFrame) -> DataFrame:
    """(subject_id, language, text, action): what the latest artifact of each subject and language asks for.

    keep: the accepted text is the same; update: it differs; insert: there is none; skip: the subject isn't accepted.
    """
    newest = artifacts.groupBy("subject_id", "language").agg(F.max(F.struct("created_at", "artifact_id", "text"))["text"].alias("text"))
    live = entities.where("status = 'accepted'").select(F.col("entity_id").alias("subject_id")).distinct().withColumn("live", F.lit(True))
    out = newest.join(live, "subject_id", "left").join(accepted.select("subject_id", "language", F.col("text").alias("stored")), ["subject_id", "language"], "left")
    action = F.when(F.col("live").isNull(), "skip").when(F.col("stored").isNull(), "insert").when(F.col("stored") == F.col("text"), "keep").otherwise("update")
    return out.select("subject_id", "language", "text", action.alias("action"))


def repair_plan(old: DataFrame, current: DataFrame, cited: DataFrame) -> DataFrame:
    """(claim_id, action, target_id): retain an old claim that is current; repoint it where its subject has one other target;
    preserve it where something cites it; else archive it. old, current: (claim_id,) subject_id, target_id."""
    now = current.select("subject_id", "target_id").distinct().withColumn("same", F.lit(True))
    only = current.groupBy("subject_id").agg(F.countDistinct("target_id").alias("n"), F.min("target_id").alias("new")).where("n = 1").drop("n")
    kept = cited.select("claim_id").distinct().withColumn("cited", F.lit(True))
    out = old.join(now, ["subject_id", "target_id"], "left").join(only, "subject_id", "left").join(kept, "claim_id", "left")
    action = F.when(F.col("same").isNotNull(), "retain").when(F.col("new").isNotNull(), "repoint").when(F.col("cited").isNotNull(), "preserve").otherwise("archive")
    return out.select("claim_id", action.alias("action"), F.when(action == "repoint", F.col("new")).otherwise(F.col("target_id")).alias("target_id"))


def sealed_plan(actions: DataFrame, *columns: str) -> DataFrame:
    """(action, actions, seal): how many rows each kind of action has, and an order-free hash of them, to compare plans by.

    A row's SHA-256 counts by its first 15 hex digits, summed exactly, so that no rows are gathered in one task.
    """
    number = F.conv(F.substring(digest(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])), 1, 15), 16, 10).cast("decimal(38,0)")
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("actions"), F.sum(number).cast("string").alias("seal"))


# aliases and slots


def alias_survivors(aliases: DataFrame) -> DataFrame:
    """(entity_id, survivor_id): of records of one language, kind and base form the canonical key survives, then quality, then id."""
    first = Window.partitionBy("language", "kind", "base").orderBy(F.col("is_canonical").desc(), F.desc("quality"), "entity_id")
    return aliases.select("entity_id", F.first("entity_id").over(first).alias("survivor_id"))


def contested_slots(claims: DataFrame) -> DataFrame:
    """(slot, winners): slots with more than one accepted claim, which there must not be."""
    return claims.where("status = 'accepted'").groupBy("slot").agg(F.count(F.lit(1)).alias("winners")).where("winners > 1")


# work


def leases(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs, but running ones whose lease is over are queued again, or failed if no attempt is left."""
    over = (F.col("status") == "running") & (F.col("lease_until") <= now)
    back = F.when(F.col("attempts") < F.col("max_attempts"), "queued").otherwise("failed")
    return jobs.withColumns({"status": F.when(over, back).otherwise(F.col("status")), "lease_until": F.when(~over, F.col("lease_until"))})


def due_by_count(completions: DataFrame, marks: DataFrame, every: int) -> DataFrame:
    """(key, done, due): completions of each key since its last mark, and whether they call for the next periodic task."""
    last = marks.groupBy("key").agg(F.max("at").alias("since"))
    rows = completions.join(last, "key", "left").where("since is null or at > since")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("done")).withColumn("due", F.col("done") >= every)


def stale_by_fingerprint(desired: DataFrame, applied: DataFrame, *fields: str) -> DataFrame:
    """(key, desired, applied, state): keys whose applied fingerprint is not that of what is desired now.

    new: nothing was applied; changed: something else was; gone: nothing is desired any more.
    """
    want = desired.select("key", fingerprint(*fields).alias("desired"))
    both = want.join(applied.select("key", F.col("fingerprint").alias("applied")), "key", "full_outer").where("not desired <=> applied")
    return both.select("key", "desired", "applied", F.when(F.col("applied").isNull(), "new").when(F.col("desired").isNull(), "gone").otherwise("changed").alias("state"))


def health(observed: DataFrame, known: DataFrame, most_attempts: int = 5) -> DataFrame:
    """(key, status, attempts, issues): the state of each observed key. observed: key, issues; known: key, status, attempts, issues.

    No issue is healthy. New or different issues wait for repair with no attempts; the same issues keep state and attempts,
    and are exhausted once those are used up.
    """
    old = known.select("key", F.col("status").alias("was"), F.col("attempts").alias("tried"), F.col("issues").alias("had"))
    both = observed.join(old, "key", "left")
    fresh = F.col("was").isNull() | ~F.col("issues").eqNullSafe(F.col("had")) | (F.col("was") == "healthy")
    status = F.when(F.col("issues") == "", "healthy").when(fresh, "pending").when(F.col("tried") >= most_attempts, "exhausted").otherwise(F.col("was"))
    return both.select("key", status.alias("status"), F.when((F.col("issues") == "") | fresh, 0).otherwise(F.col("tried")).cast("bigint").alias("attempts"), "issues")


def due_repair(repairs: DataFrame, now: Column) -> DataFrame:
    """The one repair that is next: pending and due, by priority, attempts, age and key."""
    return repairs.where(F.col("status") == "pending").where(F.col("due_at") <= now).orderBy("priority", "attempts", "observed_at", "key").limit(1)


def by_affinity(ready: DataFrame, published: DataFrame) -> DataFrame:
    """Ready jobs, those first that finish a publication already begun for their subject, prompt and fingerprint."""
    begun = published.select("subject_key", "prompt_version", "fingerprint").distinct().withColumn("__begun", F.lit(0))
    out = ready.join(begun, ["subject_key", "prompt_version", "fingerprint"], "left")
    return out.orderBy(F.coalesce("__begun", F.lit(1)), "priority", "created_at", "job_id").drop("__begun")


def recoverable(jobs: DataFrame, messages: DataFrame, harmless: str) -> DataFrame:
    """job_id of the latest job of each subject and type that failed with nothing but harmless messages, one at least."""
    latest = jobs.groupBy("subject_key", "job_type").agg(F.max(F.struct("created_at", "job_id", "status")).alias("last")).select("last.*").where("status = 'failed'").select("job_id")
    said = messages.join(latest, "job_id", "left_semi").groupBy("job_id").agg(F.every(F.col("message").rlike(harmless)).alias("fine"))
    return said.where("fine").select("job_id")


#: Stages of preparing a word, what each needs, and whether it is done for every language.
WORD_PLAN = (("meaning", (), False), ("components", ("meaning",), False), ("translation", ("meaning",), True), ("pronunciation", ("translation",), True), ("compose-word-card", ("components", "pronunciation"), False))


def word_plan(words: DataFrame, languages: list[str]) -> DataFrame:
    """(job_key, subject_key, stage, language, needs): the jobs of each word; needs are the job keys it waits for, sorted."""
    rows = []
    for stage, needs, each in WORD_PLAN:
        for language in languages if each else [""]:
            wanted = [f"{n}:{tongue}" for n in needs for own in [next(e for s, _, e in WORD_PLAN if s == n)] for tongue in (([language] if each else languages) if own else [""])]
            rows.append(F.struct(F.lit(stage).alias("stage"), F.lit(language).alias("language"), F.array(*map(F.lit, sorted(wanted))).cast("array<string>").alias("needs")))
    out = words.select("subject_key", F.inline(F.array(*rows)))
    key = lambda part: F.concat(F.col("subject_key"), F.lit("/"), part)
    return out.select(key(F.concat_ws(":", "stage", "language")).alias("job_key"), "subject_key", "stage", "language", F.array_join(F.transform("needs", key), ",").alias("needs"))
