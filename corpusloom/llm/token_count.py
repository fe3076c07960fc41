"""Token counts of byte-level BPE by rank-synchronous merging of arrays.

The distinct pre-tokens of a batch of texts lie end to end in one symbol array. In each round every sequence merges all
occurrences of its own lowest-rank pair at once; a sequence with no pair left is done, and what symbols survive are
counted. Texts then sum the counts of their pre-tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, quoted, worker_cache

#: Fixed value: the published pattern that splits texts before the merges. White space is Unicode's White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NONE = np.int64(1) << 40
#: Characters of text split at a time, and pre-tokens whose counts a worker remembers.
CHUNK_CHARS, REMEMBERED = 2_000_000, 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


class ArrayBpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("type") != "BPE" or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE without a prefix space is known here")
        specials = [t for t in spec.get("added_tokens", [])]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in specials):
            raise ValueError("added tokens with flags are not known here")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(specials, key=lambda t: -len(t["content"])))) if specials else None
        self.split = regex.compile(PATTERN)
        vocab = model["vocab"]
        self.byte_id = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], dtype=np.int64) for i in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self._index(left << 32 | right)
        self.known: dict[str, int] = {}

    def _index(self, keys: np.ndarray) -> None:
        """An open-addressing table from pair to rank, at most a sixteenth full."""
        self.bits = max(8, int(len(keys) * 16).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, -1, dtype=np.int64), np.full(size, NONE, dtype=np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            first = np.zeros(len(left), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.ranks[slot[put]] = keys[left[put]], left[put]
            left, slot = left[~put], (slot[~put] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], NONE)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):  # the slot holds another pair: look at the next
            slot = (slot if len(slot) == len(rest) else slot[rest]) + 1 & (len(self.keys) - 1)
            there, want = self.keys[slot], keys[rest]
            out[rest] = np.where(there == want, self.ranks[slot], NONE)
            more = (there != want) & (there >= 0)
            rest, slot = rest[more], slot[more]
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out, owner = lengths.copy(), np.flatnonzero(lengths > 1)
        lengths = lengths[owner]
        symbols = self.byte_id[np.frombuffer(b"".join([words[i] for i in owner]), dtype=np.uint8)]
        if not len(symbols):
            return out
        ranks = np.append(self.rank(symbols[:-1], symbols[1:]), NONE)
        ranks[np.cumsum(lengths) - 1] = NONE
        while len(owner):
            best = np.minimum.reduceat(ranks, np.cumsum(lengths) - lengths)
            alive = best < NONE
            if not alive.all():
                out[owner[~alive]] = lengths[~alive]
                stay = np.repeat(alive, lengths)
                owner, lengths, best, symbols, ranks = owner[alive], lengths[alive], best[alive], symbols[stay], ranks[stay]
                if not len(owner):
                    break
            at = np.flatnonzero(ranks == np.repeat(best, lengths))
            # of overlapping occurrences (a run of one symbol) every other one merges, from the left
            run = np.append(True, at[1:] != at[:-1] + 1)
            offset = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[offset % 2 == 0]
            sequence_end = np.cumsum(lengths)
            of = np.searchsorted(sequence_end, at, side="right")
            symbols[at] = self.merged[ranks[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            ranks[at] = ranks[at + 1]  # NONE where the pair ended its sequence
            symbols, ranks = symbols[keep], ranks[keep]
            lengths = lengths - np.bincount(of, minlength=len(lengths))
            at = at - np.arange(len(at))
            starts = np.cumsum(lengths) - lengths
            for i in (at[at + 1 < (starts + lengths)[of]], (at - 1)[at > starts[of]]):
                ranks[i] = self.rank(symbols[i], symbols[i + 1])
        return out

    def _pieces(self, text: str) -> tuple[list[str], int]:
        if self.special is None or not self.special.search(text):
            return self.split.findall(text), 0
        parts = self.special.split(text)
        return list(chain.from_iterable(map(self.split.findall, parts))), len(parts) - 1

    def count_texts(self, texts: Iterable[str]) -> list[int]:
        """Tokens of each text, a chunk of texts at a time."""
        out: list[int] = []
        chunk: list[tuple[list[str], int]] = []
        chars = 0

        def flush() -> None:
            new = list(set(chain.from_iterable(words for words, _ in chunk)).difference(self.known))
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = list(set(chain.from_iterable(words for words, _ in chunk)))
            self.known.update(zip(new, self.counts([w.encode() for w in new]).tolist(), strict=True))
            out.extend(sum(map(self.known.__getitem__, words)) + extra for words, extra in chunk)
            chunk.clear()

        for text in texts:
            chunk.append(self._pieces(text))
            chars += len(text)
            if chars > CHUNK_CHARS:
                flush()
                chars = 0
        if chunk:
            flush()
        return out


def loaded(path: str) -> ArrayBpe:
    cache = worker_cache()
    if ("bpe", path) not in cache:
        cache["bpe", path] = ArrayBpe(path)
    return cache["bpe", path]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of docs: UTF-8 bytes and tokens of the whole text.

    tokenizer is the path of a byte-level BPE .json that every executor can open. A null text counts as empty: 0 bytes and
    0 tokens. Repeated rows each get their row, null ids stay, other columns take no part, an empty table gives no rows.
    A text of one unbroken run of letters is one sequence; its rounds cost its length each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in batches:
            text = batch.column(1)
            tokens = bpe.count_texts(x.as_py() for x in text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(text), pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(quoted(id_col).alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.transform(in_batches).mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
