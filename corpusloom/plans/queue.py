"""Work-queue queries: turns of conversations are jobs, each needing the turn before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs as J
from ..sources.tables import table
from .catalog import query

_JOBS = """
    j AS (SELECT conv_id * 1000 + turn AS job_id, CASE WHEN conv_id % 2 = 0 THEN 'term:' ELSE 'text:' END || conv_id AS subject_key,
          CASE WHEN turn % 4 = 3 THEN 'compose-word-card' ELSE 'prepare' END AS job_type,
          CASE WHEN turn = 0 AND conv_id % 5 = 0 THEN 'failed' WHEN turn <= conv_id % 3 THEN 'complete' ELSE 'queued' END AS status,
          (conv_id % 3)::INT AS attempts, 2 AS max_attempts, (turn % 3)::INT AS priority, conv_id AS created_at FROM conversations),
    n AS (SELECT conv_id * 1000 + turn AS job_id, conv_id * 1000 + turn - 1 AS depends_on FROM conversations WHERE turn > 0)"""


def _snapshot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    job = F.col("conv_id") * 1000 + F.col("turn")
    jobs = turns.select(
        job.alias("job_id"), F.concat(F.when(F.col("conv_id") % 2 == 0, "term:").otherwise("text:"), F.col("conv_id").cast("string")).alias("subject_key"), F.when(F.col("turn") % 4 == 3, "compose-word-card").otherwise("prepare").alias("job_type"),
        F.when((F.col("turn") == 0) & (F.col("conv_id") % 5 == 0), "failed").when(F.col("turn") <= F.col("conv_id") % 3, "complete").otherwise("queued").alias("status"),
        (F.col("conv_id") % 3).cast("int").alias("attempts"), F.lit(2).alias("max_attempts"), (F.col("turn") % 3).cast("int").alias("priority"), F.col("conv_id").alias("created_at"),
    )
    return jobs, turns.where("turn > 0").select(job.alias("job_id"), (job - 1).alias("depends_on"))


_READY = """r AS (SELECT * FROM j WHERE status = 'queued' AND attempts < max_attempts AND NOT EXISTS (
        SELECT 1 FROM n JOIN j p ON p.job_id = n.depends_on WHERE n.job_id = j.job_id AND p.status <> 'complete' AND (j.job_type <> 'compose-word-card' OR p.status <> 'failed')))"""


@query(f"WITH {_JOBS}, {_READY} SELECT job_id, job_type, subject_key FROM r")
def ready_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.ready(*_snapshot(spark, sf_dir)).select("job_id", "job_type", "subject_key")


@query(f"WITH {_JOBS}, {_READY} SELECT job_id FROM r ORDER BY (subject_key LIKE 'term:%') DESC, priority, created_at, subject_key, job_id LIMIT 10")
def next_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.in_order(J.ready(*_snapshot(spark, sf_dir))).limit(10).select("job_id")


@query(f"""
    WITH RECURSIVE {_JOBS}, q AS (SELECT job_id FROM j WHERE status = 'queued' AND job_type <> 'compose-word-card'),
    f AS (SELECT job_id FROM j WHERE status = 'failed' UNION SELECT n.job_id FROM f JOIN n ON n.depends_on = f.job_id JOIN q ON q.job_id = n.job_id)
    SELECT f.job_id, 'blocked by failed prerequisite' AS reason FROM f JOIN q ON q.job_id = f.job_id""")
def failure_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.failed_through(*_snapshot(spark, sf_dir))


@query(f"""
    WITH {_JOBS}, t AS (SELECT *, row_number() OVER (PARTITION BY job_type ORDER BY priority, created_at, job_id) AS turn FROM j WHERE status = 'queued')
    SELECT job_id, job_type, turn::INT AS turn FROM t WHERE turn <= 6""")
def alternating_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.alternating(_snapshot(spark, sf_dir)[0].where("status = 'queued'"), "job_type", "prepare", 6).select("job_id", "job_type", "turn")


@query("""
    SELECT o_orderkey, least(168, 2 ** greatest((o_orderkey % 12) - 1, 0))::INT AS hours,
           ['term', 'term', 'term', 'root', 'affix'][(o_orderkey % 5)::INT + 1] AS lane FROM orders""")
def backoff_and_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = J.turn(F.col("o_orderkey"), {"term": 3, "root": 1, "affix": 1})
    return table(spark, sf_dir, "orders").select("o_orderkey", J.backoff_hours(F.col("o_orderkey") % 12).alias("hours"), turn.alias("lane"))


@query("""
    WITH d AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS rn, count(*) OVER () AS n FROM part)
    SELECT p_partkey, ((rn - (9 * 17) % n) % n + n) % n AS step FROM d WHERE ((rn - (9 * 17) % n) % n + n) % n < 64""")
def rotating_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.rotating(table(spark, sf_dir, "part").select("p_partkey"), 9, "p_partkey").select("p_partkey", "step")


@query(f"""WITH {_JOBS} SELECT job_id, status, attempts FROM j UNION ALL SELECT DISTINCT conv_id * 1000 + 999, 'queued', 0 FROM conversations WHERE conv_id * 1000 + 999 NOT IN (SELECT job_id FROM j)""")
def enqueued_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation asks for one more job, each of its turns once; and for its first one, which is there."""
    jobs, _ = _snapshot(spark, sf_dir)
    jobs = jobs.select("job_id", "status", "attempts")
    asked = table(spark, sf_dir, "conversations").select(F.explode(F.array(F.col("conv_id") * 1000 + 999, F.col("conv_id") * 1000)).alias("job_id"), F.lit("queued").alias("status"), F.lit(0).alias("attempts"))
    return J.enqueued(jobs, asked, "job_id")


@query(f"""WITH {_JOBS} SELECT job_id, CASE WHEN job_id IN (0, 5000, 5001) AND status = 'failed' THEN 'queued' ELSE status END AS status, CASE WHEN job_id IN (0, 5000, 5001) AND status = 'failed' THEN 0 ELSE attempts END AS attempts FROM j""")
def requeued_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, _ = _snapshot(spark, sf_dir)
    return J.requeued(jobs, ["0", "5000", "5001"]).select("job_id", "status", "attempts")


@query("""SELECT user_id AS gate, max(ts) <= TIMESTAMP '2024-06-01' AS due, CASE WHEN max(ts) <= TIMESTAMP '2024-06-01' THEN TIMESTAMP '2024-06-01' + INTERVAL (user_id % 5) HOUR ELSE max(ts) END AS next_due_at FROM events GROUP BY 1""")
def cadence_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("gate")).agg(F.max("ts").alias("next_due_at"))
    return J.cadence(gates, F.expr("TIMESTAMP_NTZ '2024-06-01'"), (F.col("gate") % 5).cast("int"))


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderkey > 700) <= 100 AS done FROM orders WHERE o_orderkey > 700 ORDER BY 1 LIMIT 100")
def scanned_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.scanned_page(table(spark, sf_dir, "orders"), "o_orderkey", 700, 100)
