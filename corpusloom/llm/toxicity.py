"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The index holds a bounded sample of labelled texts. Its postings are laid out in blocks of examples, each with the largest
weight a term has there; a query bounds every block from its own terms, visits blocks from the best bound down, and stops
when no bound left can reach the k-th neighbour. Neighbours vote by 1 / (distance + EASE); votes of the examples
themselves, each without itself, calibrate them to scores.

Terms are words and the beginnings of longer ones. Every text and every example is normed over all its terms. Only terms that tell the labels apart by a test of significance,
as many as pass it, add to a product: over all terms chance words outweigh the telling ones (README has figures). Document
frequencies of all terms of the examples count all documents; a term that no example has counts as one of none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, frugal, in_batches, keep_rows, quoted, stage

BLOCK, NEIGHBOURS, EASE = 64, 15, 0.05
#: Chance that any term at all without bearing on the label passes as telling.
CHANCE = 0.05
#: ASCII that is neither letter nor digit parts terms; letters fall to lower case. Other bytes stand as they are.
_PARTS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


#: Bytes of a word's beginning, which is a term too: insults are inflected and compounded.
STEM = 6


def terms(text: bytes) -> Counter:
    """How often each term stands in a text: its words, and as ^beginning the first STEM bytes of longer ones."""
    times = Counter(text.lower().translate(_PARTS).split())
    for word, n in [x for x in times.items() if len(x[0]) > STEM]:
        times[b"^" + word[:STEM]] += n
    return times


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, one range after the other, and which range each is of."""
    n = ends - starts
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + np.repeat(starts - (np.cumsum(n) - n), n), of


class Postings:
    """Weights by term and example; a run is what a term has in one block. postings[terms] is dense."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.shape = (n_terms, len(vectors))
        self.blocks = -(-len(vectors) // BLOCK)
        term = np.concatenate([np.zeros(0, dtype=np.int64), *[rows for rows, _ in vectors]])
        example = np.repeat(np.arange(len(vectors)), np.array([len(rows) for rows, _ in vectors], dtype=np.int64))
        order = np.lexsort((example, term))
        term, self.example = term[order], example[order].astype(np.int64)
        self.value = np.concatenate([np.zeros(0), *[values for _, values in vectors]])[order]
        run, self.run_start = np.unique(term * max(1, self.blocks) + self.example // BLOCK, return_index=True)
        self.run_max = np.maximum.reduceat(self.value, self.run_start) if len(run) else np.zeros(0)
        self.run_block = run % max(1, self.blocks)
        self.first_run = np.searchsorted(run // max(1, self.blocks), np.arange(n_terms + 1))
        self.run_start = np.append(self.run_start, len(term))

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        at, of = ranges(self.run_start[self.first_run[rows]], self.run_start[self.first_run[rows + 1]])
        out = np.zeros((len(rows), self.shape[1]))
        out[of, self.example[at]] = self.value[at]
        return out


@dataclass
class Index:
    """vocabulary: term of an example to its number; idf by number, and at the end that of all other terms; row: of a term's
    postings, -1 where it is not telling; weights: the postings; labels, ids and masses of examples; prior: share of label 1
    among all labelled rows; knots, levels: the calibration."""

    vocabulary: dict[bytes, int]
    idf: np.ndarray
    row: np.ndarray
    weights: Postings
    labels: np.ndarray
    ids: list
    masses: np.ndarray
    prior: float
    knots: np.ndarray
    levels: np.ndarray

    def state(self) -> dict:
        """All of it in plain containers, as it travels to executors, which have no copy of this package."""
        return {**self.__dict__, "weights": self.weights.__dict__}

    @classmethod
    def of(cls, state: dict) -> Index:
        weights = Postings.__new__(Postings)
        weights.__dict__.update(state["weights"])
        return cls(**{**state, "weights": weights})

    def vector(self, times: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a text's telling terms and their TF-IDF weights, normed over all terms of the text."""
        number = np.fromiter((self.vocabulary.get(t, -1) for t in times), np.int64, len(times))
        weight = (1 + np.log(np.fromiter(times.values(), np.float64, len(times)))) * self.idf[number]
        row = self.row[number]
        telling = np.flatnonzero(row >= 0)
        return row[telling], weight[telling] / max(np.sqrt(weight @ weight), 1e-300)

    def nearest(self, rows: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest positive cosine, ties to the earlier example: their numbers and cosines."""
        w = self.weights
        if not len(rows) or not w.shape[1]:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        runs, of = ranges(w.first_run[rows], w.first_run[rows + 1])
        bounds = np.bincount(w.run_block[runs], w.run_max[runs] * weights[of], w.blocks)
        order = np.argsort(-bounds, kind="stable")
        place = np.empty(w.blocks, dtype=np.int64)
        place[order] = np.arange(w.blocks)
        place = place[w.run_block[runs]]
        by_place = np.argsort(place, kind="stable")
        runs, scale, place, falling = runs[by_place], weights[of[by_place]], place[by_place], bounds[order]
        best_at, best = np.zeros(0, dtype=np.int64), np.zeros(0)
        at, step = 0, 4
        while at < w.blocks:
            limit = best[k - 1] if len(best) >= k else 0.0
            if falling[at] <= 0 or falling[at] < limit - 1e-12:
                break
            end = min(at + step, int(np.searchsorted(-falling, 1e-12 - limit, side="right")))
            a, b = np.searchsorted(place, (at, end))
            entries, which = ranges(w.run_start[runs[a:b]], w.run_start[runs[a:b] + 1])
            scores = np.round(np.bincount(w.example[entries], w.value[entries] * scale[a:b][which], w.shape[1]), 12)
            if but >= 0:
                scores[but] = 0
            found = np.flatnonzero((scores > 0) & (scores >= limit))
            best_at, best = np.concatenate([best_at, found]), np.concatenate([best, scores[found]])
            first = np.lexsort((best_at, -best))[:k]
            best_at, best = best_at[first], best[first]
            at, step = end, 2 * step
        return best_at, best

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        """The share of label 1 among the neighbours; the masses undo the sample's balance, the prior has one far vote."""
        say = self.masses[at] / (1 - np.minimum(cosine, 1) + EASE)
        far = 1 / (1 + EASE)
        return float((say @ self.labels[at] + far * self.prior) / (say.sum() + far))

    def score(self, votes: np.ndarray) -> np.ndarray:
        return np.interp(votes, self.knots, self.levels) if len(self.knots) else votes


def rising(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function nearest to y by weighted squares, as knots for np.interp; levels stay off 0 and 1."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # mass, mean, least x, largest x
    for i in order:
        pools.append([w[i], y[i], x[i], x[i]])
        while len(pools) > 1 and (pools[-2][1] >= pools[-1][1] or pools[-2][3] == pools[-1][2]):
            a, b = pools[-2], pools.pop()
            pools[-1] = [a[0] + b[0], (a[0] * a[1] + b[0] * b[1]) / (a[0] + b[0]), a[2], b[3]]
    knots = np.array([v for p in pools for v in (p[2], p[3])])
    levels = np.array([(p[0] * p[1] + 0.5) / (p[0] + 1) for p in pools for _ in (0, 1)])
    return knots, levels


def telling(present: np.ndarray, absent: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Whether a term that stands in so many of the n1 examples of label 1, and of the n0 of label 0, passes the test.

    Chi-squared with Yates' correction; its limit allows for the number of terms that are tested.
    """
    n, held = n1 + n0, present + absent
    limit = NormalDist().inv_cdf(1 - CHANCE / max(1, len(held)) / 2) ** 2
    gap = np.maximum(np.abs(present * (n0 - absent) - absent * (n1 - present)) - n / 2, 0)
    return gap**2 * n > limit * held * (n - held) * max(1, n1) * max(1, n0)


def build(texts: list[bytes], labels: np.ndarray, ids: list, vocabulary: list[bytes], df: np.ndarray, n_documents: int, prior: float) -> Index:
    """vocabulary: all terms of texts; df counts each in all n_documents; prior is the share of label 1 among all labelled rows."""
    idf = np.log((1 + n_documents) / (1 + np.append(df, 0))) + 1
    known = {t: i for i, t in enumerate(vocabulary)}
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    counts = np.zeros((2, len(vocabulary)))
    for text, label in zip(texts, labels.tolist(), strict=True):
        counts[label, [known[t] for t in terms(text)]] += 1
    told = np.flatnonzero(telling(counts[1], counts[0], n1, n0))
    row = np.full(len(idf), -1)
    row[told] = np.arange(len(told))
    masses = np.where(labels == 1, prior / max(1, n1), (1 - prior) / max(1, n0)) * len(labels)
    index = Index(known, idf, row, Postings([], 0), labels.astype(np.float64), ids, masses, prior, np.zeros(0), np.zeros(0))
    vectors = [index.vector(terms(t)) for t in texts]
    index.weights = Postings(vectors, len(told))
    votes = np.array([index.vote(*index.nearest(rows, values, but=i)) for i, (rows, values) in enumerate(vectors)])
    if n1 and n0:
        index.knots, index.levels = rising(votes, labels.astype(np.float64), masses)
    return index


def train(docs: DataFrame, labels: DataFrame, learn, most: int = 1500, most_bytes: int = 50_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Index:
    """Build the index from at most `most` labelled texts of each label, the first by a hash of the id.

    learn is a condition on the column doc_id that labelled rows must meet; texts over most_bytes serve as no example. An
    executor builds the index; labels are named as the columns of docs. Null ids, texts and labels teach nothing.
    """
    docs = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    marked = labels.select(quoted(id_col).alias("doc_id"), quoted(label_col).cast("int").alias("label")).where("label in (0, 1)").where(learn)
    n = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    rate = F.lit(0.0)
    for label, count in n.items():
        rate = F.when(F.col("label") == label, F.lit(min(1.0, 1.5 * most / max(1, count)))).otherwise(rate)
    drawn = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate * 1_000_000)
    held = docs.where(F.octet_length("text").between(1, most_bytes)).join(F.broadcast(drawn), "doc_id").withColumn("place", F.xxhash64("doc_id"))
    sample = stage(held.orderBy("label", "place", "doc_id", "text").limit(4 * most), "toxicity-examples")

    def examples(rows: pa.Table) -> list[tuple]:
        rows = sorted(zip(*(rows.column(c).to_pylist() for c in ("label", "place", "doc_id", "text")), strict=True))
        return [r for v in (0, 1) for r in [r for r in rows if r[0] == v][:most]]

    def words(rows: pa.Table) -> list[bytes]:
        return sorted({t for r in examples(rows) for t in terms(r[3].encode())})

    vocabulary = fitted(sample, words)
    df, total = document_frequencies(docs, vocabulary), docs.count()
    prior = n.get(1, 0) / max(1, sum(n.values()))

    def fit(rows: pa.Table) -> dict:
        label, _, ids, text = map(list, zip(*examples(rows), strict=True)) if rows.num_rows else ([], [], [], [])
        return build([t.encode() for t in text], np.array(label, dtype=np.int64), ids, vocabulary, df, total, prior).state()

    return Index.of(fitted(sample, fit))


def document_frequencies(docs: DataFrame, vocabulary: list[bytes]) -> np.ndarray:
    """In how many documents each term of the vocabulary stands, in its order; the vocabulary is that of a bounded sample."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t: i for i, t in enumerate(shared.value)}
        df = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                df[[known[t] for t in terms(x.as_py()) if t in known]] += 1
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(df[there])], names=["number", "df"])

    text = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = text.transform(in_batches).mapInArrow(frugal(count), "number bigint, df bigint").groupBy("number").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(vocabulary), dtype=np.int64)
    out[found["number"].to_numpy()] = found["df"].to_numpy()
    return out


def verdicts(index: Index, texts: list[bytes]) -> tuple[np.ndarray, list]:
    """The score of each text, and its neighbours with their cosines."""
    near = [index.nearest(*index.vector(terms(t))) for t in texts]
    return index.score(np.array([index.vote(*n) for n in near], dtype=np.float64)), near


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, evidence) for every row of docs; evidence holds the neighbours' ids, labels and cosines, nearest first.

    A null, empty or wordless text, or one without a telling term, has no neighbours and scores as the calibrated prior.
    Repeated rows each get their row, null ids stay, other columns take no part, an empty table gives no rows.
    """
    rows = docs.select(quoted(id_col).alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(index.state())
    kind = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.of(shared.value)
        for batch in batches:
            scores, near = verdicts(index, [x.as_py() for x in batch.column(1)])
            evidence = [[{"id": index.ids[a], "label": int(index.labels[a]), "cosine": c} for a, c in zip(at.tolist(), cosine.tolist(), strict=True)] for at, cosine in near]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(evidence, kind)], names=["doc_id", "score", "evidence"])

    return rows.transform(in_batches).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, evidence array<struct<id: bigint, label: int, cosine: double>>")


def keep(docs: DataFrame, index: Index, below: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores below the limit. Null texts are empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(index.state())
    return keep_rows(docs, text_col, lambda texts: verdicts(Index.of(shared.value), texts)[0] < below)
