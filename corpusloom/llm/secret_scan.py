"""Secret scans with an incremental blob ledger, in DataFrame functions alone.

Every version of every path is addressed by the SHA-256 of its text. A ledger remembers which (blob, rule, version)
triples were scanned and what they held. An update collapses copies before the shuffle, scans each blob only for the rule
versions the ledger lacks, appends what it found, and joins the ledger's findings back to all paths that hold the blob.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted, scratch_dir, stage


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern; those whose group has under min_length code points are dropped."""

    kind: str
    pattern: str
    group: int
    min_length: int
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base rules, then the rules this method adds. Their order orders spans of equal start.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
ADDED_RULES = (
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
RULES = BASE_RULES + ADDED_RULES

FINDINGS = "blob string, rule string, start bigint, end bigint"
SCANNED = "blob string, rule string"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def unseen(blobs: DataFrame, rules: tuple[Rule, ...], scanned: DataFrame) -> DataFrame:
    """(blob, missing): blobs (each once) that lack rule versions in the ledger's scanned keys, and the keys they lack."""
    every = F.array(*[F.lit(r.key) for r in rules])
    seen = scanned.where(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    left = blobs.join(seen, "blob", "left").select("blob", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("missing"))
    return left.where(F.size("missing") > 0)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, start, end) of every finding; start and end count code points, end is exclusive.

    Splitting at the matches gives the lengths between them, so running sums of both give positions.
    """

    def found(rule: Rule) -> Column:
        text, pattern = F.col("text"), F.lit(rule.pattern)
        lengths = lambda strings: F.transform(strings, lambda s: F.length(s))
        hits = F.arrays_zip(
            lengths(F.split(text, rule.pattern, -1)).alias("gap"),
            lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("hit"),
            lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("value"),
        )
        return F.when(F.array_contains("missing", rule.key) & F.col("text").rlike(rule.pattern), F.struct(F.lit(rule.key).alias("rule"), F.lit(rule.min_length).alias("least"), hits.alias("hits")))

    per_rule = blobs.select("blob", F.explode(F.array_compact(F.array(*[found(r) for r in rules]))).alias("f"))
    parts = per_rule.select("blob", F.col("f.rule").alias("rule"), F.col("f.least").alias("least"), F.posexplode("f.hits").alias("at", "h"))
    so_far = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = parts.where("h.hit is not null").withColumn("end", F.sum(F.col("h.gap").cast("long") + F.col("h.hit")).over(so_far))
    return ends.where("h.value >= least").select("blob", "rule", (F.col("end") - F.col("h.hit")).alias("start"), "end")


def per_blob(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): all spans of a blob in one array of (start, rank, kind, end), by start and then by rule order."""
    kinds = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.struct(F.lit(i).alias("rank"), F.lit(r.kind).alias("kind")))])
    rule = kinds[F.col("rule")]
    span = F.struct("start", rule["rank"].alias("rank"), rule["kind"].alias("kind"), "end")
    return findings.where(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.array_sort(F.collect_set(span)).alias("spans"))


def keyed_versions(versions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    return versions.select(quoted(id_col).alias("path"), text.alias("text"), blob_of(text).alias("blob"))


class BlobLedger:
    """The two ledger tables as Parquet under one folder; each update appends a batch.

    Findings are written before the scanned keys: a job lost between the two scans those blobs again, and the repeated
    findings fall together when they are read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def fresh(cls, spark: SparkSession) -> BlobLedger:
        """An empty ledger in the shared folder, of a name of its own; it goes when the driver's JVM ends."""
        ledger = cls(spark, f"{scratch_dir(spark)}/corpusloom/ledger-{uuid.uuid4().hex}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger.folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        return ledger

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", SCANNED)

    def findings(self) -> DataFrame:
        return self._read("findings", FINDINGS)

    def update(self, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is unseen and append it to the ledger; (path, blob, spans) for every row of versions, in no order.

        A null text is an empty one; empty texts have no spans (an empty array). Repeated rows and copies each get their own
        row. A null id is kept. Other columns of versions, whatever their names, take no part. An empty table gives no rows.
        """
        keyed = keyed_versions(versions, id_col, text_col)
        paths = stage(keyed.select("path", "blob"), "paths")
        spans = self.spans(keyed, paths.select("blob").distinct(), rules)
        return paths.join(spans, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))

    def spans(self, keyed: DataFrame, blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """per_blob() of the given blobs, written, once all they lack is scanned; keyed: rows of (blob, text) that hold them.

        Rows meet the written spans in a join of two plain shuffles, which Spark splits where a blob has very many paths.
        """
        todo = stage(unseen(blobs, rules, self.scanned()), "unseen")
        texts = keyed.groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")
        scan_blobs(texts, rules).write.mode("append").parquet(f"{self.folder}/findings")
        todo.select("blob", F.explode("missing").alias("rule")).write.mode("append").parquet(f"{self.folder}/scanned")
        return stage(per_blob(self.findings().join(blobs, "blob", "left_semi"), rules), "spans")


def scan(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """BlobLedger.update() of a ledger that knows nothing yet."""
    return BlobLedger.fresh(versions.sparkSession).update(versions, id_col, text_col, rules)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """text with every span replaced by [kind]; of overlapping spans the earlier counts, and the later from where it ends."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(done: Column, span: Column) -> Column:
        gap = F.greatest(span["start"] - done["at"], F.lit(0)).cast("int")
        out = F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), gap), F.when(span["end"] > done["at"], F.concat(F.lit("["), span["kind"], F.lit("]"))).otherwise(F.lit("")))
        return F.struct(out.alias("out"), F.greatest(done["at"], span["end"]).alias("at"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda done: F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))))


def redacted(docs: DataFrame, ledger: BlobLedger | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs, all columns as they are, but with every span of every text replaced by its kind in brackets. A null text stays."""
    columns = [f"c{i}" for i in range(len(docs.columns))]  # no name of a column can clash with blob or spans
    text = columns[docs.columns.index(text_col)]
    keyed = docs.toDF(*columns).withColumn("blob", blob_of(F.col(text).cast("string")))
    held = keyed.select("blob", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = (ledger or BlobLedger.fresh(docs.sparkSession)).spans(held, held.select("blob").distinct(), rules)
    joined = keyed.join(found, "blob", "left")
    clean = F.when(F.col("spans").isNull(), F.col(text)).otherwise(redact(F.col(text).cast("string"), F.col("spans")))
    return joined.select(*[(clean if c == text else F.col(c)).alias(name) for c, name in zip(columns, docs.columns, strict=True)])
