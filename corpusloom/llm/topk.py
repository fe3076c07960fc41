"""Exact top-k search by Fagin's threshold algorithm.

Candidates and queries are cut into blocks; every pair of blocks is one cell with its own sorted list of candidates for
each dimension. A query reads its lists from the end where its own component pulls the score up, a depth at a time, scores
whom it meets for the first time, and stops when the sum of what is next in all lists cannot beat its k-th score. The best
of all cells are merged for each query.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted


def threshold_search(candidates: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, step: int = 32, scored: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score) of each query's k best inner products, ties to the smaller id; candidates of its own id are left out.

    query is the row of queries. Rows of candidates must stand by rising id. Values are whole numbers and scores exact:
    in float64 below 2**53, in int64 below 2**63, as Python's numbers beyond, where a score outside a long becomes the
    nearest long after ranking. scored, if given, gets the number of candidates that each query scored.
    """
    n, width = candidates.shape
    rising = np.argsort(candidates, axis=0, kind="stable")
    falling = rising[::-1]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    most = lambda values: max(1, -int(values.min(initial=0)), int(values.max(initial=0)))
    largest = most(candidates) * most(queries) * max(1, width)
    exact = np.float64 if largest < 2**53 else np.int64 if largest < 2**63 else object
    points = candidates.astype(exact)
    low, high = np.take_along_axis(points, rising, axis=0), np.take_along_axis(points, falling, axis=0)
    for row, (query, own) in enumerate(zip(queries.astype(exact), query_ids, strict=True)):
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        unseen = ids != own
        at, best, total = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=exact), 0
        depth, reach = 0, step
        while depth < n:
            end = min(n, depth + reach)
            met = np.zeros(n, dtype=bool)
            met[falling[depth:end, up].ravel()] = True
            met[rising[depth:end, down].ravel()] = True
            if not len(up) + len(down) or end == n:
                met[:] = True  # no list orders them, or all lists are read
            met &= unseen
            unseen &= ~met
            fresh = np.flatnonzero(met)
            total += len(fresh)
            at, best = np.concatenate([at, fresh]), np.concatenate([best, points[fresh] @ query])
            if exact is not object and len(best) > k:  # what can't be among the first is not sorted
                stay = best >= np.partition(best, len(best) - k)[len(best) - k]
                at, best = at[stay], best[stay]
            first = np.lexsort((at, -best))[:k] if exact is not object else np.array(sorted(range(len(at)), key=lambda i: (-best[i], at[i]))[:k], dtype=np.int64)
            at, best = at[first], best[first]
            if not unseen.any():
                break
            limit = high[end, up] @ query[up] + low[end, down] @ query[down]
            if len(best) >= k and min(best) > limit:
                break
            depth, reach = end, reach * 2
        if scored is not None:
            scored.append(total)
        values = best.astype(np.int64) if exact is not object else np.array([min(max(b, -(2**63)), 2**63 - 1) for b in best], dtype=np.int64)
        found.append((np.full(len(at), row), ids[at], values))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, v): v holds floor(scale * x) of each component x as a whole number; rows that take no part are gone."""
    whole = F.transform(quoted(vector_col), lambda x: x.cast("double"))
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(quoted(id_col).cast("bigint").alias("vec_id"), whole.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fit)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, block: int = 4096, query_block: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row whose id is divisible by `every`.

    Null vectors, and those with null or non-finite components, take no part, nor do null ids; vectors without components
    score 0 among themselves. Vectors of other lengths than the query's are no candidates of it, nor are rows of its id.
    Rows that repeat an id are a candidate each; queries that repeat id and vector are asked once, those that repeat the id
    alone each have their ranks. Equal scores rank by the smaller id; a query with fewer candidates gets all. Other columns
    take no part; an empty table gives no rows. Components saturate at the range of a long after scaling, scores too, once
    ranked. `block` and `query_block` are the rows of a cell: candidates travel once to every block of queries.
    """
    rows = usable(vectors, id_col, vector_col, scale).withColumn("width", F.size("v"))
    n = vectors.count()
    blocks, query_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(n / every / query_block))
    key = lambda of: F.pmod(F.xxhash64("vec_id", "v", F.lit(of)), F.lit(of)).cast("int")
    cell = lambda mine, other: F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(mine)
    # copies of one row are spread by where they are read, so that no block grows with a row's copies
    spread = F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    candidates = rows.select("width", "vec_id", "v", spread.alias("c")).select("*", cell("q", query_blocks))
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).select("width", "vec_id", "v", key(query_blocks).alias("q"), cell("c", blocks))

    def search(key: tuple, mine: pa.Table, others: pa.Table) -> pa.Table:
        def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            t = t.combine_chunks()
            ids = t.column("vec_id").to_numpy()
            values = t.column("v").combine_chunks()
            values = values.flatten().to_numpy() if len(ids) else np.zeros(0, dtype=np.int64)
            order = np.argsort(ids, kind="stable")
            return values.reshape(len(ids), key[0].as_py())[order].astype(np.int64), ids[order]

        (points, ids), (asked, own) = matrix(others), matrix(mine)
        row, near, score = threshold_search(points, ids, asked, own, k)
        mark = np.array([int.from_bytes(blake2b(v.tobytes(), digest_size=8).digest(), signed=True) for v in asked], dtype=np.int64) if len(asked) else np.zeros(0, dtype=np.int64)
        return pa.table({"query_id": own[row] if len(row) else row, "mark": mark[row] if len(row) else row, "vec_id": near, "score": score}, schema=pa.schema([(c, pa.int64()) for c in ("query_id", "mark", "vec_id", "score")]))

    by = ("width", "q", "c")
    found = queries.groupBy(*by).cogroup(candidates.groupBy(*by)).applyInArrow(search, "query_id bigint, mark bigint, vec_id bigint, score bigint")
    ranked = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
