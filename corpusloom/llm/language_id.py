"""Language identification by a convolutional network over bytes, trained in numpy on labelled text.

Filters of several widths run over the bytes of fixed-length windows, each filter keeps its largest response in a window,
and a softmax turns those into probabilities. A text is cut into as many windows as it needs, and the windows' logarithms,
weighted by their bytes, add up to the text's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fitted, in_batches, quoted

WINDOW, FILTERS, EMBEDDING, WIDTHS = 256, 12, 8, (2, 3, 4)
UNKNOWN = "und"


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, padded with spaces; whose they are; and how many bytes of the text each holds."""
    per_text = np.fromiter((-(-len(t) // WINDOW) for t in texts), np.int64, len(texts))
    joined = b"".join(t + b" " * (n * WINDOW - len(t)) for t, n in zip(texts, per_text.tolist(), strict=True))
    owner = np.repeat(np.arange(len(texts)), per_text)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, WINDOW), owner, np.minimum(WINDOW, lengths[owner] - number * WINDOW)


@dataclass
class Network:
    """embedding: (256, d); filters: for each width (width, d, filters); out: (all filters + 1, languages)."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    out: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda spread, *shape: rng.normal(0, spread, shape).astype(np.float32)
        return cls(languages, draw(0.5, 256, EMBEDDING), [draw(0.4, w, EMBEDDING, FILTERS) for w in WIDTHS], draw(0.1, len(WIDTHS) * FILTERS + 1, len(languages)))

    def responses(self, windows: np.ndarray) -> Iterator[np.ndarray]:
        """For each width the responses at every place: (windows, places, filters). A byte's response is a table row."""
        for filters in self.filters:
            width, places = len(filters), WINDOW - len(filters) + 1
            total = None
            for k in range(width):
                part = (self.embedding @ filters[k])[windows[:, k : k + places]]
                total = part if total is None else total + part
            yield total

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        logits = np.maximum(pooled, 0) @ self.out[:-1] + self.out[-1]
        logits -= logits.max(axis=1, keepdims=True)
        return np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)

    def fit(self, windows: np.ndarray, truth: np.ndarray, weight: np.ndarray, epochs: int = 10, batch: int = 128, rate: float = 0.01, seed: int = 7) -> None:
        """Weighted cross-entropy by Adam; slopes reach only the place where each filter's response was largest."""
        rng, weight = np.random.default_rng(seed), weight.astype(np.float32)
        values = [self.embedding, *self.filters, self.out]
        first, second, steps = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                x, n = windows[pick], len(pick)
                best = [(r.argmax(axis=1), r.max(axis=1)) for r in self.responses(x)]
                pooled = np.concatenate([b for _, b in best], axis=1)
                active = np.maximum(pooled, 0)
                error = self.probabilities(pooled)
                error[np.arange(n), truth[pick]] -= 1
                error *= weight[pick, None] / n
                slopes = [np.zeros_like(v) for v in values]
                slopes[-1][:-1], slopes[-1][-1] = active.T @ error, error.sum(axis=0)
                back = (error @ self.out[:-1].T) * (pooled > 0)
                for w, (place, _) in enumerate(best):
                    own = back[:, w * FILTERS : (w + 1) * FILTERS]
                    for k in range(WIDTHS[w]):
                        seen = x[np.arange(n)[:, None], place + k]
                        slopes[1 + w][k] = np.einsum("nfd,nf->df", self.embedding[seen], own)
                        np.add.at(slopes[0], seen, own[:, :, None] * self.filters[w][k].T[None])
                steps += 1
                for value, slope, m, v in zip(values, slopes, first, second, strict=True):
                    m += 0.1 * (slope - m)
                    v += 0.001 * (slope**2 - v)
                    value -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)


def largest(responses: np.ndarray) -> np.ndarray:
    """The maximum over places of (windows, places, filters); rows of eight places at a time keep the inner loop long."""
    n, places, filters = responses.shape
    whole = places // 8 * 8
    rows = responses[:, :whole].reshape(n, whole // 8, 8 * filters).max(axis=1).reshape(n, 8, filters)
    return np.concatenate([rows, responses[:, whole:]], axis=1).max(axis=1)


class Scorer:
    """A trained network with its filters tabled by pairs of bytes, so that a place costs one or two rows a width."""

    def __init__(self, network: Network):
        self.network, self.tables = network, []
        for filters in network.filters:
            one = [(network.embedding @ f).astype(np.float32) for f in filters]
            self.tables.append([(one[k][:, None, :] + one[k + 1][None, :, :]).reshape(-1, FILTERS) if k + 1 < len(one) else one[k] for k in range(0, len(one), 2)])

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(WIDTHS) * FILTERS), dtype=np.float32)
        for at in range(0, len(windows), 256):
            x = windows[at : at + 256].astype(np.int32)
            pairs = x[:, :-1] * 256 + x[:, 1:]
            for w, tables in enumerate(self.tables):
                places, total = WINDOW - WIDTHS[w] + 1, None
                for k, tabled in enumerate(tables):
                    keys = pairs if len(tabled) > 256 else x
                    part = tabled.take(keys[:, 2 * k : 2 * k + places], axis=0)
                    total = part if total is None else np.add(total, part, out=total)
                out[at : at + 256, w * FILTERS : (w + 1) * FILTERS] = largest(total)
        return out

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each text's language and its probability; a text of no bytes gets the first language and 0."""
        windows, owner, held = windows_of(texts)
        total = np.zeros((len(texts), len(self.network.languages)))
        if len(windows):
            logs = np.log(np.maximum(self.network.probabilities(self.pooled(windows).astype(np.float64)), 1e-12)) * (held[:, None] / WINDOW)
            for language in range(total.shape[1]):
                total[:, language] = np.bincount(owner, logs[:, language], len(texts))
        total -= total.max(axis=1, keepdims=True)
        shares = np.exp(total) / np.exp(total).sum(axis=1, keepdims=True)
        best = shares.argmax(axis=1)
        return best, np.where(np.fromiter(map(len, texts), np.int64, len(texts)) > 0, shares[np.arange(len(texts)), best], 0.0)


def learn_from(rows: list[tuple[str, str]]) -> Network:
    """A network fitted to (language, text) pairs: all windows of each text, and a shortened copy of one for short texts."""
    network = Network.fresh(sorted({name for name, _ in rows}) or [UNKNOWN])
    number = {name: i for i, name in enumerate(network.languages)}
    rng = np.random.default_rng(7)
    texts, truth = [], []
    for name, text in dict.fromkeys(rows):
        raw = text.encode()
        if raw.strip():
            at = int(rng.integers(len(raw)))
            texts += [raw, raw[at : at + int(rng.integers(12, WINDOW))]]
            truth += [number[name]] * 2
    if len(network.languages) > 1:
        windows, owner, _ = windows_of(texts)
        own = np.array(truth)[owner]
        per = np.bincount(own, minlength=len(network.languages))
        network.fit(windows, own, (len(own) / (len(per) * np.maximum(per, 1)))[own])
    return network


def train(docs: DataFrame, learn: Column, most: int = 200, most_bytes: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Scorer:
    """Train on at most `most` documents of every value of lang, the first by a hash of the id, from all windows of their texts.

    learn is a condition on the column doc_id; texts over most_bytes serve as no example, unless a language has only such.
    An executor trains; the driver gets the weights. Null ids, texts and languages teach nothing.
    """
    known = docs.select(quoted(id_col).alias("doc_id"), quoted(lang_col).cast("string").alias("lang"), quoted(text_col).cast("string").alias("text"))
    known = known.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    n = known.groupBy("lang").count().collect()  # a row for each class of the network
    rates = F.create_map(*[F.lit(x) for r in n for x in (r["lang"], min(1.0, 2.0 * most / r["count"]))]) if n else F.lit(None).cast("map<string,double>")
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rates[F.col("lang")] * 1_000_000)
    first = Window.partitionBy("lang").orderBy(F.octet_length("text") > most_bytes, F.xxhash64("doc_id"), "doc_id", "text")
    sample = drawn.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most)
    sample = sample.select("lang", F.when(F.octet_length("text") > most_bytes, F.substring("text", 1, most_bytes // 4)).otherwise(F.col("text")).alias("text"), "place")

    def run(rows: pa.Table) -> dict:
        rows = sorted(zip(*(rows.column(c).to_pylist() for c in ("lang", "place", "text")), strict=True))
        return learn_from([(r[0], r[2]) for r in rows]).__dict__

    return Scorer(Network(**fitted(sample, run)))


def identify(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs, from all windows of the whole text.

    A null text, or one without a letter, is `und` with score 0. Repeated rows each get their row, null ids stay, other
    columns take no part, an empty table gives no rows.
    """
    network = scorer.network

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, scorer = regex.compile(r"\p{L}"), Scorer(network)
        names = np.array([*network.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [x.as_py() for x in part.column(1)]
                blank = np.fromiter((not letter.search(t) for t in texts), bool, len(texts))
                best, score = scorer.predict([b"" if no else t.encode() for t, no in zip(texts, blank, strict=True)])
                named = names[np.where(blank, len(names) - 1, best)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(named, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(quoted(id_col).alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.transform(in_batches).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
