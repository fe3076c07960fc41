"""What the operators share: tables, written stages in the shared folder, worker-side caches."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of that very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where it is unset a folder of this machine serves, but only when driver and executors are one process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and lost executors cost nothing before it.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch of rows on its way to Python, so that long texts fill no worker.
BATCH_BYTES = 8 << 20


def in_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose batches of rows for Python have few bytes, however many rows a batch may have."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Free memory that Arrow's pool and malloc keep goes back to the system: workers live on, idle, beside the next stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim:
            trim(0)


def frugal(run):
    """run, a function of Arrow batches, in a worker that gives back what it no longer holds, in the end and as texts pass."""

    def out(batches):
        import pyarrow as pa

        def read():
            seen = 0
            for batch in batches:
                seen += batch.nbytes
                yield batch
                del batch
                if seen > BATCH_BYTES:
                    seen = 0
                    pa.default_memory_pool().release_unused()

        try:
            yield from run(read())
        finally:
            give_back()

    return out


def fitted(sample: DataFrame, fit):
    """What fit makes of the whole sample, a table of bounded size, on one executor: plain containers and numpy arrays.

    The driver gets the result alone, never the sample.
    """
    import pickle

    import pyarrow as pa

    kinds = sample.limit(0).toArrow().schema

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(list(batches), kinds)))], pa.binary())], names=["model"])

    found = sample.coalesce(1).transform(in_batches).mapInArrow(frugal(run), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit(pa.Table.from_batches([], kinds))


def worker_cache() -> dict:
    """A dict that lives as long as the Python process, for models and vocabularies loaded once."""
    return sys.modules.setdefault("_corpusloom_worker", types.ModuleType("_corpusloom_worker")).__dict__


def crc_bucket(column: Column, buckets: int) -> Column:
    """crc32 of the value as text, modulo buckets: the folds of the labelled operators."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(buckets))


def tokenizer_path(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def keep_rows(docs: DataFrame, text_col: str, kept, step: int = 1000) -> DataFrame:
    """The rows of docs, all columns as they are, that kept(texts as bytes) marks; nothing is shuffled, nulls are empty texts."""
    import pyarrow as pa

    at, plain = docs.columns.index(text_col), docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                yield part.filter(pa.array(kept([(x.as_py() or "").encode() for x in part.column(at)])))

    return plain.transform(in_batches).mapInArrow(frugal(run), plain.schema).toDF(*docs.columns)
