"""Public export: sensitive texts and source overlaps are quarantined, references closed, identifiers anonymized."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.identity import public_id
from .graph import closed_under_references


def window_hashes(text: str, n: int) -> np.ndarray:
    """A 64-bit hash of every stretch of n characters, in order; longer stretches grow from shorter ones by doubling."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(points) < n:
        return np.zeros(0, dtype=np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    own, size, out, done = (points + np.uint64(1)) * step, 1, None, 0
    while True:
        if n & size:
            here = own[done:]
            out = here.copy() if out is None else out[: len(here)] * step + here[: len(out)]
            out ^= out >> np.uint64(29)
            done += size
        if done == n:
            return out[: len(points) - n + 1] * step
        own = own[:-size] * (step ^ np.uint64(2 * size)) + own[size:]
        own ^= own >> np.uint64(31)
        size *= 2


def _hash_lists(pick):
    @F.pandas_udf("array<bigint>")
    def lists(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.unique(pick(t or "")).view(np.int64))

    return lists


def overlapping(texts: DataFrame, sources: DataFrame, n: int = 60) -> DataFrame:
    """(id) of texts that equal a source or share n characters with one; texts and sources: id, text, compared in lower case.

    Any shared stretch of n characters shares the least hash of the half stretches inside it, so those few hashes find all
    candidates; only candidates give all their stretches, which then decide. Hashes have 64 bits.
    """
    half = n // 2

    def winnowed(text: str) -> np.ndarray:
        hashes = window_hashes(text, half)
        return np.lib.stride_tricks.sliding_window_view(hashes, n - half + 1).min(axis=1) if len(hashes) > n - half else np.zeros(0, dtype=np.uint64)

    key = T.lower_key(F.coalesce(F.col("text"), F.lit("")))
    few, every = _hash_lists(winnowed), _hash_lists(lambda t: window_hashes(t, n))
    marks = lambda df, how: df.select("id", F.explode(how(key)).alias("gram"))
    candidates = marks(texts, few).join(marks(sources, few).select("gram").distinct(), "gram", "left_semi").select("id").distinct()
    shared = marks(texts.join(candidates, "id", "left_semi"), every).join(marks(sources, every).select("gram").distinct(), "gram", "left_semi").select("id")
    equal = texts.where(key != "").select("id", F.sha2(key.cast("binary"), 256).alias("gram")).join(sources.select(F.sha2(key.cast("binary"), 256).alias("gram")).distinct(), "gram", "left_semi").select("id")
    return shared.unionByName(equal).distinct()


def quarantine(entities: DataFrame, text_col: str = "text") -> DataFrame:
    """entities with a reason: not-accepted, empty, sensitive, or null for those that may go out."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return entities.withColumn("reason", F.when(F.coalesce(F.col("status") != "accepted", F.lit(True)), "not-accepted").when(F.trim(text) == "", "empty").when(T.sensitive(text), "sensitive"))


def public_entities(entities: DataFrame, references: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(public_id, text) of entities (id, status, text) that are safe and whose references (id, needs) are too."""
    safe = quarantine(entities).where("reason is null").drop("reason")
    if sources is not None:
        safe = safe.join(overlapping(safe.select("id", "text"), sources), "id", "left_anti")
    kept = closed_under_references(safe, references)
    return safe.join(kept, "id", "left_semi").select(public_id("entity", F.col("id")).alias("public_id"), T.bounded(F.col("text")).alias("text"))


def public_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """(public_id, source, target) of edges both of whose ends (kept: id) go out."""
    ends = kept.select("id").distinct()
    inside = edges.join(ends.select(F.col("id").alias("src")), "src", "left_semi").join(ends.select(F.col("id").alias("dst")), "dst", "left_semi")
    return inside.select(public_id("edge", F.concat_ws(":", "src", "dst")).alias("public_id"), public_id("entity", F.col("src")).alias("source"), public_id("entity", F.col("dst")).alias("target"))


def public_tables(entities: DataFrame, references: DataFrame, edges: DataFrame, events: DataFrame, citations: DataFrame, sources: DataFrame | None = None) -> dict[str, DataFrame]:
    """What goes out, table by table, under public ids: entities, edges between them, their events in order, and citations.

    entities: id, status, text; references: id, needs; edges: src, dst; events: id, created_at, event_id, kind (null where it
    can't be read); citations: id, locator. Events are numbered before unreadable ones go, so gaps show; locators that give
    something away become hashes. sources are texts that no entity may share 60 characters with.
    """
    from ..functions.records import sanitized_locator

    safe = quarantine(entities).where("reason is null").drop("reason")
    if sources is not None:
        safe = safe.join(overlapping(safe.select("id", "text"), sources), "id", "left_anti")
    kept = closed_under_references(safe, references)
    entity = lambda c: public_id("entity", F.col(c))
    order = F.row_number().over(Window.partitionBy("id").orderBy("created_at", "event_id")) - 1
    numbered = events.withColumn("place", order).where("kind is not null").join(kept, "id", "left_semi")
    cited = citations.join(kept, "id", "left_semi").select(entity("id").alias("entity"), sanitized_locator(F.col("locator")).alias("locator")).distinct()
    return {
        "entities": safe.join(kept, "id", "left_semi").select(entity("id").alias("public_id"), T.bounded(F.col("text")).alias("text")),
        "edges": public_edges(edges, kept), "events": numbered.select(entity("id").alias("entity"), "place", "kind"), "citations": cited,
    }
