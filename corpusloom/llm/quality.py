"""Quality rules: counts over whole texts, and a linear-chain conditional random field that labels lines.

Each line gets a few binned features. The field's Viterbi path marks every line as content or boilerplate, and a text is
kept if enough of its words stand in content lines. Weights are fitted by gradient ascent on a bounded sample of labelled
texts. Labels say which texts are poor, not which of their lines: in a poor text at least half the words stand in
boilerplate, its lines are hidden labels, and rounds of fitting and labelling find them. Lines of good texts are content.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, in_batches, keep_rows, quoted

SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Base rules: least words, words of a window, most of the words that may stand in repeated windows (percent).
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
CONTENT, BOILERPLATE = 0, 1
#: Decay of the moves. Labels of whole texts overstate how seldom lines change sides, so moves are held small.
STILL = 0.02

_is = lambda members: np.isin(np.arange(256), np.frombuffer(members, dtype=np.uint8))
_starts_char = (np.arange(256) & 0xC0) != 0x80
IS_SPACE = _is(SPACES)
#: Classes of bytes that are counted in every line: code points that are no space, symbols, capitals, digits, full stops, other marks.
CLASSES = np.stack([
    _starts_char & ~IS_SPACE,
    _is(SYMBOLS),
    _is(bytes(range(65, 91))),
    _is(bytes(range(48, 58))),
    _is(b".!?"),
    _is(b"_={}[]()@/\\:;~^+\"'-"),
])

#: Bins of each feature of a line: shares of its characters (or words), and lengths.
BINS = (
    np.array([0.005, 0.03, 0.08, 0.15, 0.3]),  # symbols
    np.array([0.02, 0.06, 0.12, 0.3, 0.6]),  # capitals
    np.array([0.01, 0.05, 0.15, 0.3]),  # digits
    np.array([0.005, 0.015, 0.03, 0.06, 0.12]),  # full stops
    np.array([0.005, 0.02, 0.05, 0.15]),  # other marks
    np.array([2, 5, 10, 20, 60]),  # words
    np.array([2.5, 3.5, 4.5, 6.0, 8.0, 12.0]),  # characters a word
    np.array([1, 2, 4]),  # equal lines before it in the text
    np.array([0.2, 0.4, 0.6, 0.8]),  # words of the line that repeat the word before them
)
WIDTHS = np.array([len(b) + 1 for b in BINS])
OFFSETS = np.concatenate([[0], np.cumsum(WIDTHS)[:-1]])
N_FEATURES = int(WIDTHS.sum())


@dataclass
class Model:
    """weights: (features, labels); moves: (labels, labels); least_content: share of words below which a text goes."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((N_FEATURES, 2)))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    least_content: float = 0.0


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values from each start to the next; a start at the very end sums nothing."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[np.append(starts, len(values))])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words found twice or more in the text, the first time included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    window = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        window = window * np.uint64(0x9E3779B97F4A7C15) + (each[i : i + n] ^ (each[i : i + n] >> np.uint64(29)))
    ordered = np.sort(window)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(window, twice)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[:n] += hit
    edge[WINDOW : WINDOW + n] -= hit
    return int((np.cumsum(edge) > 0).sum())


def measure(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base counts of each text, and of its lines with a word: binned features (lines, kinds), words, and lines per text."""
    n_words, n_repeat, n_dup = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
    per_text = np.zeros(len(texts), dtype=np.int64)
    kept_lines: list[bytes] = []
    line_words, before, again = [], [], []
    for k, text in enumerate(texts):
        words = text.split()
        n_words[k] = len(words)
        n_repeat[k] = repeated_words(words)
        seen: dict[bytes, int] = {}
        for line in text.split(b"\n"):
            own = line.split()
            if own:
                times = seen.get(line, 0)
                seen[line] = times + 1
                kept_lines.append(line)
                line_words.append(len(own))
                before.append(times)
                again.append(sum(map(eq, own, own[1:])) / len(own))
                per_text[k] += 1
        n_dup[k] = per_text[k] - len(seen)
    raw = np.frombuffer(b"".join(kept_lines), dtype=np.uint8)
    starts = np.cumsum([0, *map(len, kept_lines)])[:-1].astype(np.int64)
    counts = np.stack([_sums(c[raw], starts) for c in CLASSES], axis=1) if kept_lines else np.zeros((0, len(CLASSES)), dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), per_text)
    base = {
        "n_words": n_words,
        "word_chars": np.bincount(owner, counts[:, 0], len(texts)).astype(np.int64),
        "n_symbols": np.bincount(owner, counts[:, 1], len(texts)).astype(np.int64),
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
    }
    words = np.array(line_words, dtype=np.int64)
    chars = np.maximum(counts[:, 0], 1)
    values = [*(counts[:, i] / chars for i in range(1, len(CLASSES))), words, chars / np.maximum(words, 1), np.array(before), np.array(again)]
    bins = np.stack([np.digitize(v, b) for v, b in zip(values, BINS, strict=True)], axis=1) + OFFSETS if kept_lines else np.zeros((0, len(BINS)), dtype=np.int64)
    return base, bins, words, per_text


def base_fails(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])


def viterbi(model: Model, bins: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """The best label of every line; all texts advance by one line at a time."""
    score = model.weights[bins].sum(axis=1)
    first = np.cumsum(per_text) - per_text
    back = np.zeros((len(bins), 2), dtype=np.int64)
    order = np.argsort(-per_text, kind="stable")
    longest = int(per_text.max(initial=0))
    alive = np.searchsorted(-per_text[order], -np.arange(longest), side="left")  # texts with more than t lines
    best = np.zeros((len(per_text), 2))
    for t in range(longest):
        at = first[order[: alive[t]]] + t
        if t:
            come = best[: alive[t], :, None] + model.moves
            back[at] = come.argmax(axis=1)
            best[: alive[t]] = come.max(axis=1) + score[at]
        else:
            best[: alive[t]] = score[at]
    label = np.zeros(len(bins), dtype=np.int64)
    now = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        at = first[order[: alive[t]]] + t
        label[at] = now[: alive[t]]
        now[: alive[t]] = back[at, label[at]]
    return label


def marginals(model: Model, bins: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each line's label, and summed over all lines those of each move, by forward and backward passes."""
    score = model.weights[bins].sum(axis=1)
    n, first = len(bins), np.cumsum(per_text) - per_text
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    moves = np.zeros((2, 2))
    order = np.argsort(-per_text, kind="stable")
    longest = int(per_text.max(initial=0))
    alive = np.searchsorted(-per_text[order], -np.arange(longest), side="left")
    for t in range(longest):
        at = first[order[: alive[t]]] + t
        forward[at] = score[at] + (np.logaddexp.reduce(forward[at - 1][:, :, None] + model.moves, axis=1) if t else 0)
    for t in range(longest - 2, -1, -1):
        at = first[order[: alive[t + 1]]] + t
        backward[at] = np.logaddexp.reduce(model.moves + (score[at + 1] + backward[at + 1])[:, None, :], axis=2)
        total = np.logaddexp.reduce(forward[at] + backward[at], axis=1)
        joint = forward[at][:, :, None] + model.moves + (score[at + 1] + backward[at + 1])[:, None, :] - total[:, None, None]
        moves += np.exp(joint).sum(axis=0)
    both = forward + backward
    return np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None]), moves


def content_share(labels: np.ndarray, words: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(per_text)), per_text)
    content = np.bincount(owner, words * (labels == CONTENT), len(per_text))
    return content / np.maximum(np.bincount(owner, words, len(per_text)), 1)


def _poor_lines(given: np.ndarray, path: np.ndarray, words: np.ndarray, per_text: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Labels of all lines: those of good texts are content; in poor ones the path decides, but the lines likeliest to be
    boilerplate are that until they hold half the words."""
    label, first = np.where(np.repeat(good, per_text), CONTENT, path), np.cumsum(per_text) - per_text
    for k in np.flatnonzero(~good & (per_text > 0)):
        own = np.arange(first[k], first[k] + per_text[k])
        order = own[np.argsort(-given[own, BOILERPLATE], kind="stable")]
        held = np.cumsum(words[order]) - words[order]
        label[order[2 * held < words[own].sum()]] = BOILERPLATE
    return label


def _ascend(model: Model, bins: np.ndarray, per_text: np.ndarray, truth: np.ndarray, rounds: int, step: float, decay: float) -> None:
    """Gradient ascent on the mean log-likelihood of the lines' labels."""
    lines = max(1, len(bins))
    onehot = np.eye(2)[truth]
    seen_moves = np.zeros((2, 2))
    inner = np.ones(lines, dtype=bool)
    inner[np.cumsum(per_text)[per_text > 0] - 1] = False
    np.add.at(seen_moves, (truth[:-1][inner[:-1]], truth[1:][inner[:-1]]), 1)
    squares = np.zeros_like(model.weights), np.zeros_like(model.moves)
    for _ in range(rounds):
        given, moved = marginals(model, bins, per_text)
        slope = np.zeros_like(model.weights)
        for kind in range(bins.shape[1]):
            for label in (CONTENT, BOILERPLATE):
                slope[:, label] += np.bincount(bins[:, kind], (onehot - given)[:, label], N_FEATURES)
        steps = slope / lines - decay * model.weights, (seen_moves - moved) / lines - STILL * model.moves
        for value, change, square in zip((model.weights, model.moves), steps, squares, strict=True):
            square += change**2
            value += step * change / (np.sqrt(square) + 1e-8)


def fit(texts: list[bytes], good: np.ndarray, rounds: int = 60, labellings: int = 3, step: float = 0.5, decay: float = 1e-3) -> Model:
    """Fit and label the lines of poor texts in turn, then lean to content until at most 1 in 500 good texts would go.

    Where either label is missing, or no text has a line, the model marks every line as content and keeps all.
    """
    model = Model()
    base, bins, words, per_text = measure(texts)
    if not len(bins) or good.all() or not good.any():
        model.weights[:, CONTENT] = 1.0
        return model
    truth = np.repeat(np.where(good, CONTENT, BOILERPLATE), per_text)
    for _ in range(labellings):
        _ascend(model, bins, per_text, truth, rounds, step, decay)
        truth = _poor_lines(marginals(model, bins, per_text)[0], viterbi(model, bins, per_text), words, per_text, good)
    fair = good & ~base_fails(base)
    model.least_content = 0.5
    for _ in range(40):  # lean to content until at most 1 in 500 good texts would go
        share = content_share(viterbi(model, bins, per_text), words, per_text)
        if (share[fair] < model.least_content).sum() * 500 <= fair.sum():
            break
        model.weights[:, CONTENT] += 0.25 / len(BINS)
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = 1500, most_bytes: int = 50_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most `most` labelled texts of each quality, the first by a hash of the id; texts over most_bytes sit out.

    The drawn labels are broadcast: their number is bounded by `most`, not by the table. An executor fits; the driver gets
    the weights. Null ids, texts and labels teach nothing.
    """
    text = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text")).where(F.octet_length("text").between(1, most_bytes))
    marked = labels.select(quoted(id_col).alias("doc_id"), quoted(label_col).cast("int").alias("good")).where("good in (0, 1)")
    n = {r["good"]: r["count"] for r in marked.groupBy("good").count().collect()}
    rate = F.lit(0.0)
    for good, count in n.items():
        rate = F.when(F.col("good") == good, F.lit(min(1.0, 1.5 * most / max(1, count)))).otherwise(rate)
    drawn = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate * 1_000_000)
    sample = text.join(F.broadcast(drawn), "doc_id").withColumn("place", F.xxhash64("doc_id")).orderBy("good", "place", "doc_id", "text").limit(4 * most)

    def run(rows: pa.Table) -> dict:
        rows = sorted(zip(*(rows.column(c).to_pylist() for c in ("good", "place", "doc_id", "text")), strict=True))
        picked = [r for g in (0, 1) for r in [r for r in rows if r[0] == g][:most]]
        return fit([r[3].encode() for r in picked], np.array([r[0] == 1 for r in picked], dtype=bool)).__dict__

    return Model(**fitted(sample, run))


def verdicts(model: Model, texts: list[bytes]) -> dict[str, np.ndarray]:
    base, bins, words, per_text = measure(texts)
    share = content_share(viterbi(model, bins, per_text), words, per_text)
    failed = base_fails(base)
    return {**base, "base_failed": failed, "content_share": share, "kept": ~failed & (share >= model.least_content)}


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text assess() keeps. Nothing is shuffled."""
    return keep_rows(docs, text_col, lambda texts: verdicts(model, texts)["kept"])


def assess(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, base_failed, content_share and kept of every row of docs.

    Null texts count as empty: zero counts, base_failed, not kept. Lines without a word take no part in the chain; a text is
    labelled whole, however long. Repeated rows each get their row, null ids stay, other columns take no part, an empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                columns = verdicts(model, [x.as_py() for x in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns.values())], names=["doc_id", *columns])

    rows = docs.select(quoted(id_col).alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.transform(in_batches).mapInArrow(run, f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_share double, kept boolean")
