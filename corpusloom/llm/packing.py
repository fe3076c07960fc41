"""Conflict-constrained best-fit packing of texts into sequences of a fixed length.

Texts longer than a sequence fill sequences of their own, and what is left of them is packed with the rest. Within a shard
the pieces go longest first, each to the tightest bin that has room and no conflict: a bin carries bitmaps of the sources
and of the duplicate clusters it holds, and takes neither twice. The search starts at the successor of the piece's length
among the residuals and goes on until a compatible bin is found; if none is, a bin is opened.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, in_batches, quoted
from .token_count import loaded

#: Length of a sequence in tokens, and rows of a shard. Both are parameters; shards grow in number, not in size.
CAPACITY, SHARD_ROWS = 2048, 4096


def measured(docs: DataFrame, tokenizer: str, id_col: str, source_col: str, text_col: str, cluster_col: str | None) -> DataFrame:
    """(doc_id, source, cluster, length): tokens of the whole text, and its duplicate cluster.

    Without a column of clusters, texts of the same words are one, whatever their case and the space between them.
    """
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    cluster = quoted(cluster_col).cast("bigint") if cluster_col else F.lit(None).cast("bigint")
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(source_col).cast("string").alias("source"), cluster.alias("cluster"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        bpe = loaded(tokenizer)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            clusters = batch.column("cluster")
            if cluster_col is None:
                marks = np.fromiter((xxh3_64_intdigest(b" ".join(t.lower().encode().split())) for t in texts), np.uint64, len(texts))
                clusters = pa.array(marks.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), clusters, pa.array(bpe.count_texts(texts), pa.int64())], names=["doc_id", "source", "cluster", "length"])
        bpe.known.clear()  # the worker goes on to other stages

    return rows.transform(in_batches).mapInArrow(frugal(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, cluster bigint, length bigint")


def bit_numbers(values: list) -> list[int]:
    """A bit number for each value that stands twice or more, -1 for the others: those can meet no equal."""
    seen: dict = {}
    for v in values:
        seen[v] = seen.get(v, 0) + 1
    bits: dict = {}
    return [bits.setdefault(v, len(bits)) if v is not None and seen[v] > 1 else -1 for v in values]


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """The bin of each piece and its offset there; pieces are taken in the order given. Nulls conflict with nothing.

    Of equally tight compatible bins the one opened first is taken.
    """
    source_bit, cluster_bit = bit_numbers(sources), bit_numbers(clusters)
    open_bins: dict[int, list[int]] = {}  # residual: bins by number
    residuals: list[int] = []  # that have bins, rising
    held_sources: list[int] = []
    held_clusters: list[int] = []
    bins, offsets = [], []
    for length, source, cluster in zip(lengths, source_bit, cluster_bit, strict=True):
        source_mask, cluster_mask = 1 << source if source >= 0 else 0, 1 << cluster if cluster >= 0 else 0
        found = None
        for residual in residuals[bisect_left(residuals, length) :]:
            for place, number in enumerate(open_bins[residual]):
                if not held_sources[number] & source_mask and not held_clusters[number] & cluster_mask:
                    found = residual, place
                    break
            if found:
                break
        if found:
            residual, place = found
            number = open_bins[residual].pop(place)
            if not open_bins[residual]:
                del open_bins[residual]
                residuals.pop(bisect_left(residuals, residual))
        else:
            residual, number = capacity, len(held_sources)
            held_sources.append(0)
            held_clusters.append(0)
        held_sources[number] |= source_mask
        held_clusters[number] |= cluster_mask
        left = residual - length
        if left not in open_bins:
            open_bins[left] = []
            insort(residuals, left)
        insort(open_bins[left], number)
        bins.append(number)
        offsets.append(capacity - residual)
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", cluster_col: str | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, begin, length, shard, bin, offset): every piece of every row of docs, once.

    A piece is tokens begin to begin + length of its text, as tokenizer (a byte-level BPE .json that executors can open)
    counts them; it lies at offset in bin `bin` of its shard. Full pieces have bins of their own, numbered under 0.
    cluster_col names a column of duplicate clusters, such as ngram_join's component_id; without one, texts of the same
    words are a cluster. Rows of a cluster, or of a source, never share a bin; nulls conflict with nothing. Null and empty
    texts come out with piece 0, length 0 and null bin. Rows that repeat an id are packed each; a null id too. Other columns
    take no part; an empty table gives no rows. Shards are dealt by a hash of id, cluster, source and length.
    """
    rows = measured(docs, tokenizer, id_col, source_col, text_col, cluster_col)
    shards = max(1, math.ceil(docs.count() / shard_rows))
    # copies of one row are spread as well, by where they are read
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "source", "length", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def fill(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        left = pa.array(-(group.column("length").to_numpy() % capacity))
        group = group.append_column("left", left).sort_by([(c, "ascending") for c in ("left", "doc_id", "cluster", "source", "length")])
        ids, words = group.column("doc_id").to_pylist(), group.column("length").to_pylist()
        sources, clusters = group.column("source").to_pylist(), group.column("cluster").to_pylist()
        tails = [i for i, w in enumerate(words) if w % capacity]
        bins, offsets = best_fit([words[i] % capacity for i in tails], [sources[i] for i in tails], [clusters[i] for i in tails], capacity)
        out: list[tuple] = [(ids[i], words[i] // capacity, words[i] - words[i] % capacity, words[i] % capacity, b, o) for i, b, o in zip(tails, bins, offsets, strict=True)]
        own = 0
        for i, w in enumerate(words):
            if not w:
                out.append((ids[i], 0, 0, 0, None, None))
            for piece in range(w // capacity):
                own -= 1
                out.append((ids[i], piece, piece * capacity, capacity, own, 0))
        columns = list(zip(*out, strict=True))
        kinds = [group.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        arrays.insert(4, pa.array([key[0].as_py()] * len(out), pa.int32()))
        return pa.Table.from_arrays(arrays, names=["doc_id", "piece", "begin", "length", "shard", "bin", "offset"])

    return rows.groupBy("shard").applyInArrow(fill, f"doc_id {kind}, piece int, begin bigint, length bigint, shard int, bin bigint, offset bigint")
