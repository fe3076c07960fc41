"""A queue of jobs over a dependency graph, as queries on snapshots: what is ready, what fails with what, what comes next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import cut

#: Jobs that compose a result from what there is: failed prerequisites don't hold them up.
COMPOSING = ("compose-word-card", "compose-origin-card")
BLOCKED = "blocked by failed prerequisite"


def _composing(job_type: Column) -> Column:
    return job_type.isin(*COMPOSING)


def ready(jobs: DataFrame, needs: DataFrame) -> DataFrame:
    """Queued jobs with attempts left, all of whose prerequisites are complete (or failed, for composing jobs).

    jobs: job_id, job_type, status, attempts, max_attempts, ...; needs: job_id, depends_on.
    """
    state = jobs.select(F.col("job_id").alias("depends_on"), F.col("status").alias("need_status"))
    queued = jobs.where("status = 'queued' and attempts < max_attempts")
    open_ = needs.join(state, "depends_on").where("need_status <> 'complete'")
    holding = open_.join(queued.select("job_id", "job_type"), "job_id").where(~_composing(F.col("job_type")) | (F.col("need_status") != "failed"))
    return queued.join(holding.select("job_id"), "job_id", "left_anti")


def in_order(jobs: DataFrame, preferred: list[str] | None = None) -> DataFrame:
    """Jobs as they are claimed: preferred subjects, terms, priority, age, subject, id."""
    first = [F.when(F.col("subject_key").isin(*preferred), 0).otherwise(1)] if preferred else []
    return jobs.orderBy(*first, F.when(F.col("subject_key").startswith("term:"), 0).otherwise(1), "priority", "created_at", "subject_key", "job_id")


def claim(jobs: DataFrame, needs: DataFrame, preferred: list[str] | None = None) -> DataFrame:
    """jobs after the next one was claimed: running, with an attempt more."""
    chosen = in_order(ready(jobs, needs), preferred).limit(1).select("job_id", F.lit(True).alias("__chosen"))
    out = jobs.join(F.broadcast(chosen), "job_id", "left")  # one row
    return out.withColumn("status", F.when(F.col("__chosen"), "running").otherwise(F.col("status"))).withColumn("attempts", F.when(F.col("__chosen"), F.col("attempts") + 1).otherwise(F.col("attempts"))).drop("__chosen")


def failed_through(jobs: DataFrame, needs: DataFrame) -> DataFrame:
    """(job_id, reason) of queued jobs that can no longer run because something they need, at any distance, failed.

    Composing jobs are not failed, and nothing fails through them.
    """
    queued = jobs.where("status = 'queued'").where(~_composing(F.col("job_type"))).select("job_id")
    frontier = jobs.where("status = 'failed'").select("job_id")
    found = None
    while True:
        hit = needs.join(frontier.select(F.col("job_id").alias("depends_on")), "depends_on", "left_semi").select("job_id").distinct().join(queued, "job_id", "left_semi")
        frontier = cut(hit if found is None else hit.join(found, "job_id", "left_anti"))
        if frontier.isEmpty():
            break
        found = frontier if found is None else cut(found.unionByName(frontier))
    found = frontier if found is None else found
    return found.select("job_id", F.lit(BLOCKED).alias("reason"))


def enqueued(jobs: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """jobs and those of new whose key no job has: asking twice gives the same job."""
    once = new.dropDuplicates(list(key))
    return jobs.unionByName(once.join(jobs.select(*key), list(key), "left_anti").select(*jobs.columns))


def requeued(jobs: DataFrame, ids: list[str]) -> DataFrame:
    """jobs with the failed ones among ids queued again, without attempts."""
    again = F.col("job_id").isin(*ids) & (F.col("status") == "failed")
    return jobs.withColumn("attempts", F.when(again, 0).otherwise(F.col("attempts"))).withColumn("status", F.when(again, "queued").otherwise(F.col("status")))


def recovered(jobs: DataFrame) -> DataFrame:
    """jobs with running ones queued again; the interrupted attempt doesn't count."""
    running = F.col("status") == "running"
    return jobs.withColumn("attempts", F.when(running, F.greatest(F.col("attempts") - 1, F.lit(0))).otherwise(F.col("attempts"))).withColumn("status", F.when(running, "queued").otherwise(F.col("status")))


def alternating(jobs: DataFrame, lane: str, last: str, quota: int) -> DataFrame:
    """Jobs by lane, the lane that was not served last first, quota of each at most."""
    own = Window.partitionBy(lane).orderBy("priority", "created_at", "job_id")
    return jobs.withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= quota).orderBy("turn", F.when(F.col(lane) == last, 1).otherwise(0), lane)


def backoff_hours(attempts: Column, most: int = 168) -> Column:
    """Hours to wait after so many attempts: doubling, a week at most."""
    return F.least(F.lit(most), F.pow(F.lit(2), F.greatest(attempts - 1, F.lit(0)))).cast("int")


def due(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs whose backoff has passed, by priority, attempts and age."""
    wait = F.make_interval(hours=backoff_hours(F.col("attempts")))
    return jobs.where(F.col("updated_at") + wait <= now).orderBy("priority", "attempts", "created_at", "job_id")


def turn(counter: Column, weights: dict[str, int]) -> Column:
    """Whose turn it is in a weighted round: lanes by their weights, over and over."""
    slots = [lane for lane, n in weights.items() for _ in range(n)]
    return F.array(*[F.lit(s) for s in slots])[F.pmod(counter, F.lit(len(slots))).cast("int")]


def rotating(subjects: DataFrame, epoch: int, order: str, size: int = 64, stride: int = 17) -> DataFrame:
    """size subjects from place (epoch * stride) mod n on, going round."""
    from .search import numbered

    n = subjects.agg(F.count(F.lit(1)).alias("__n"))
    rows = numbered(subjects, [order]).crossJoin(F.broadcast(n))
    step = F.pmod(F.col("rn") - F.pmod(F.lit(epoch * stride), F.col("__n")), F.col("__n"))
    return rows.withColumn("step", step).where(F.col("step") < size).drop("rn", "__n")


def cadence(gates: DataFrame, now: Column, hours: Column) -> DataFrame:
    """(gate, due, next_due_at): gates whose time has come, with the next one, which is written before the work is done."""
    due = F.col("next_due_at").isNull() | (F.col("next_due_at") <= now)
    return gates.select("gate", due.alias("due"), F.when(due, now + F.make_interval(hours=hours)).otherwise(F.col("next_due_at")).alias("next_due_at"))


def scanned_page(rows: DataFrame, key: str, cursor, limit: int) -> DataFrame:
    """(key, done): the next rows of a resumable scan, and whether it ends with them; an empty page ends it as well.

    A caller writes the last key as the new cursor, or, once done, when to begin again.
    """
    page = rows.select(key) if cursor is None else rows.where(F.col(key) > F.lit(cursor)).select(key)
    more = page.orderBy(key).limit(limit + 1).withColumn("__n", F.row_number().over(Window.orderBy(key)))
    return more.withColumn("done", F.max("__n").over(Window.partitionBy()) <= limit).where(F.col("__n") <= limit).drop("__n")
