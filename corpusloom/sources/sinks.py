"""Sinks: canonical JSON Lines with a logical hash, index builds, releases with manifest and checksums."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import sqlite3
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _filesystem(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def swapped_in(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """write() fills a folder beside path, which then takes path's place; a failed write or move leaves path as it was."""
    name = uuid.uuid4().hex
    fs, new = _filesystem(spark, f"{path.rstrip('/')}.{name}")
    old, aside = _filesystem(spark, path)[1], _filesystem(spark, f"{path.rstrip('/')}.{name}.old")[1]
    try:
        write(str(new))
    except BaseException:
        fs.delete(new, True)
        raise
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        fs.delete(new, True)
        raise OSError(f"could not move {path} aside")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"could not move {new} to {path}")
    fs.delete(aside, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _filesystem(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def canonical_json(df: DataFrame, *order: str) -> DataFrame:
    """(line): each row as compact JSON with sorted keys and nulls kept, in order."""
    names = sorted(df.columns)
    rows = df.orderBy(*[F.col(c).asc_nulls_first() for c in order]) if order else df
    return rows.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("line"))


def logical_hash(df: DataFrame, *order: str) -> str:
    """SHA-256 over the canonical lines in order, streamed to the driver a partition at a time."""
    out = hashlib.sha256()
    for row in canonical_json(df, *order).toLocalIterator():
        out.update(row["line"].encode() + b"\n")
    return out.hexdigest()


def build_index(entries: DataFrame, path: str, id_col: str, columns: dict[str, float]) -> dict:
    """Write entries, their postings sorted by term and the totals under path in one swap; returns the metadata, which is written too."""
    from ..operators.search import index_postings, index_stats

    spark = entries.sparkSession
    digest = entries.select(F.sum(F.xxhash64(*[F.col(c).cast("string") for c in sorted(entries.columns)]).cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n")).first()
    meta = {"rows": digest["n"], "content_hash": str(digest["h"]), "columns": columns, "schema_version": 2}

    def write(folder: str) -> None:
        entries.write.parquet(f"{folder}/entries")
        index_postings(entries, id_col, list(columns)).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{folder}/postings")
        index_stats(entries, spark.read.parquet(f"{folder}/postings")).write.parquet(f"{folder}/stats")
        put_text(spark, f"{folder}/metadata.json", json.dumps(meta, sort_keys=True))

    swapped_in(spark, path, write)
    return meta


@contextlib.contextmanager
def locked(spark: SparkSession, path: str):
    """One builder at a time: a file beside path that only one can create; RuntimeError if another holds it.

    A build that died leaves the file, to be removed by hand once it is sure that it died.
    """
    fs, lock = _filesystem(spark, f"{path.rstrip('/')}.lock")
    try:
        held = fs.createNewFile(lock)
    except Exception as e:  # some file systems refuse instead of saying no
        raise RuntimeError(f"{lock} can't be made") from e
    if not held:
        raise RuntimeError(f"another build holds {lock}")
    try:
        yield
    finally:
        fs.delete(lock, False)


def build_markdown_index(spark: SparkSession, root: str, path: str) -> dict:
    """Index the sections and links of a tree of notes under path, unless the tree is as it was when last indexed.

    One build at a time; the tree is fingerprinted before and after, and one that changed meanwhile, or whose index does not
    hold every section, leaves the old index in place and raises ValueError. Returns the metadata.
    """
    from . import readers

    with locked(spark, path):
        files = readers.markdown_files(spark, root)
        before = readers.tree_fingerprint(files)
        fs, meta_file = _filesystem(spark, f"{path}/tree.json")
        if fs.exists(meta_file):
            known = json.loads("\n".join(r[0] for r in spark.read.text(str(meta_file)).collect()))
            if known["fingerprint"] == before:
                return {**known, "built": False}
        meta = {"fingerprint": before}

        def write(folder: str) -> None:
            sections = readers.markdown_sections(files)
            build_index(sections.select("section_id", "path", "line_start", "heading", "excerpt"), f"{folder}/sections", "section_id", {"heading": 1.0, "excerpt": 1.0})
            readers.wiki_links(sections).write.parquet(f"{folder}/links")
            meta["sections"] = spark.read.parquet(f"{folder}/sections/entries").count()
            if meta["sections"] != sections.count() or readers.tree_fingerprint(readers.markdown_files(spark, root)) != before:
                raise ValueError(f"{root} changed while it was indexed")
            put_text(spark, f"{folder}/tree.json", json.dumps(meta, sort_keys=True))

        swapped_in(spark, path, write)
        return {**meta, "built": True}


def search_index(spark: SparkSession, path: str, query: str, **how) -> DataFrame:
    """(id, score) of a written index, with the weights it was built for."""
    from ..operators.search import ranked

    meta = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/metadata.json").collect()))
    return ranked(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"), meta["columns"], query, **how)


def file_sums(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(SHA-256, path under folder) of every part file, hashed on executors; parts are written small enough to be read whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    base = folder.split("://")[-1].split(":", 1)[-1].rstrip("/")
    rows = files.select(F.sha2("content", 256).alias("sum"), F.substring_index("path", f"{base}/", -1).alias("path")).collect()
    return sorted(((r["sum"], r["path"]) for r in rows), key=lambda r: r[1])


def joined_parts(spark: SparkSession, folder: str, suffix: str) -> tuple[str, str]:
    """One file in place of the part files of folder, in their order: (SHA-256 of what was stored, its name).

    Bytes stream through the driver's JVM a buffer at a time, so neither a part nor the file must fit in memory.
    """
    jvm, buffer = spark.sparkContext._jvm, 1 << 20
    fs, where = _filesystem(spark, folder)
    parts = sorted((f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("part-")), key=lambda p: (int(p.getName().split("-")[1].split(".")[0]), p.getName()))
    name = f"part-00000.{suffix}"
    file = jvm.org.apache.hadoop.fs.Path(where, name)

    def copied(source, out) -> None:
        try:
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, buffer, False)
        finally:
            source.close()

    out = fs.create(file, False)
    try:
        for part in parts:
            copied(fs.open(part), out)
    finally:
        out.close()
    for part in parts:
        fs.delete(part, False)
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    copied(jvm.java.security.DigestInputStream(fs.open(file), digest), jvm.java.io.OutputStream.nullOutputStream())
    return bytes(digest.digest()).hex(), name


def release(tables: dict[str, tuple[DataFrame, tuple[str, ...]]], path: str, title: str, rows_of_a_part: int | None = None) -> dict:
    """Write tables (name: frame and sort keys) as JSON Lines with a manifest, SHA256SUMS of all files and a card, in one swap.

    A table is one file whatever its size, or with rows_of_a_part as many files as that takes, each hashed whole by a task.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    manifest = {"title": title, "tables": {n: {"rows": df.count(), "logical_sha256": logical_hash(df, *order)} for n, (df, order) in sorted(tables.items())}}

    def write(folder: str) -> None:
        sums = []
        for name, (df, order) in sorted(tables.items()):
            canonical_json(df, *order).write.option("maxRecordsPerFile", rows_of_a_part or 0).text(f"{folder}/{name}")
            if rows_of_a_part is None:
                digest, file = joined_parts(spark, f"{folder}/{name}", "jsonl")
                sums.append((digest, f"{name}/{file}"))
        texts = {"manifest.json": json.dumps(manifest, sort_keys=True, indent=1), "README.md": f"# {title}\n\n" + "".join(f"- {n}: {t['rows']} rows\n" for n, t in manifest["tables"].items())}
        for name, text in texts.items():
            put_text(spark, f"{folder}/{name}", text)
        sums = (sums or file_sums(spark, folder)) + [(hashlib.sha256(t.encode()).hexdigest(), n) for n, t in sorted(texts.items())]
        put_text(spark, f"{folder}/SHA256SUMS", "".join(f"{s}  {n}\n" for s, n in sums))

    swapped_in(spark, path, write)
    return manifest


def sqlite_release(tables: dict[str, tuple[DataFrame, str, dict[str, str]]], file: str) -> dict[str, int]:
    """Write tables (name: frame, key column, {column: table it refers to}) into one SQLite file; returns their rows.

    For releases of bounded size: rows stream through the driver a partition at a time into a file beside `file`, which
    takes its place only when foreign keys and the file's integrity hold; else what was there stays and ValueError is raised.
    """
    beside = f"{file}.{uuid.uuid4().hex}"
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    name = lambda n: '"' + n.replace('"', '""') + '"'
    try:
        with contextlib.closing(sqlite3.connect(beside)) as db:
            for table, (df, key, references) in tables.items():
                columns = [f"{name(c)} {kinds.get(t, 'TEXT')}{' PRIMARY KEY' if c == key else ''}" for c, t in df.dtypes]
                columns += [f"FOREIGN KEY ({name(c)}) REFERENCES {name(other)} ({name(tables[other][1])})" for c, other in references.items()]
                db.execute(f"CREATE TABLE {name(table)} ({', '.join(columns)})")
            rows = {}
            for table, (df, _, _) in tables.items():
                plain = df.select(*[F.col(c) if t in kinds else F.col(c).cast("string") for c, t in df.dtypes])
                put = db.executemany(f"INSERT INTO {name(table)} VALUES ({', '.join('?' * len(df.columns))})", (tuple(r) for r in plain.toLocalIterator()))
                rows[table] = max(0, put.rowcount)
            db.commit()
            broken = db.execute("PRAGMA foreign_key_check").fetchall()
            sound = db.execute("PRAGMA integrity_check").fetchone()[0]
        if broken or sound != "ok":
            raise ValueError(f"the release refers to rows that it lacks: {broken[:5]}" if broken else sound)
        os.replace(beside, file)
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.remove(beside)
    return rows


def sqlite_backup(file: str, copy: str) -> None:
    """A consistent copy of a SQLite file that others may be writing to; it takes its place in one move, once it is sound."""
    beside = f"{copy}.{uuid.uuid4().hex}"
    try:
        with contextlib.closing(sqlite3.connect(f"file:{file}?mode=ro", uri=True)) as source, contextlib.closing(sqlite3.connect(beside)) as target:
            source.backup(target, pages=1024)
            if target.execute("PRAGMA quick_check").fetchone()[0] != "ok":
                raise ValueError(f"{file} is damaged")
        os.replace(beside, copy)
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.remove(beside)
