"""SentencePiece encoding and decoding by suffix-array matching.

The distinct space-led units of a batch lie end to end as one text. Its suffixes are sorted as deep as the longest piece,
every piece's occurrences are one range found by binary search, and the ranges become edges sorted by where they end. The
relaxation goes over ends from left to right. A byte-pair model has no path costs: the one encoding that merging would give
is the one whose neighbouring pieces all stand as neighbours when merged by themselves, so each end keeps the only edge that
agrees with the piece kept where that edge starts.
"""

from __future__ import annotations

import codecs
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, quoted, worker_cache

SPACE = "▁"
#: Kinds of pieces and models in the published model format.
NORMAL, UNKNOWN, CONTROL, BYTE, BYTE_PAIR_MODEL = 1, 2, 3, 6, 2
CHUNK_CHARS, REMEMBERED = 3_000_000, 300_000
FREE = np.int64(1) << 40


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield tag >> 3, struct.unpack("<f" if size == 4 else "<d", data[at : at + size])[0]
            at += size


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class PieceCodec:
    def __init__(self, path: str):
        codecs.register_error("corpusloom_each", lambda e: ("�" * (e.end - e.start), e.end))
        with open(path, "rb") as f:
            model = f.read()
        self.pieces: list[str] = []
        scores, kinds = [], []
        trainer, normalizer = {}, {}
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(piece.get(2, 0.0))
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        normal = [i for i, k in enumerate(kinds) if k == NORMAL]
        if trainer.get(3) != BYTE_PAIR_MODEL or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1) or {*kinds} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only byte-pair models with a space put first and no other normalization are known here")
        if any(SPACE in p.lstrip(SPACE) for p in map(self.pieces.__getitem__, normal)):
            raise ValueError("pieces that hold a space after other text")
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for i, k in enumerate(kinds):
            if k == BYTE:
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self.raw_lengths = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        self.raw_starts = np.cumsum(self.raw_lengths) - self.raw_lengths
        self.raw_bytes = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.is_byte = np.array([k == BYTE for k in kinds])
        self._index(normal, scores)
        self._forget()

    def _index(self, normal: list[int], scores: list[float]) -> None:
        """Symbols: all pieces by id, then characters of pieces that are none themselves; their ranks, splits and pairs."""
        symbol = {self.pieces[i]: i for i in normal}
        letters = sorted({c for p in symbol for c in p})
        for k, c in enumerate(c for c in letters if c not in symbol):
            symbol[c] = len(self.pieces) + k
        size = max(symbol.values()) + 1
        order = sorted((i for i in normal if len(self.pieces[i]) > 1), key=lambda i: -scores[i])
        self.rank = np.full(size, -1, dtype=np.int64)
        levels = {v: r for r, v in enumerate(dict.fromkeys(scores[i] for i in order))}
        self.rank[order] = [levels[scores[i]] for i in order]  # pieces of equal score merge from the left
        rank_of = {self.pieces[i]: int(self.rank[i]) for i in order}
        self.left, self.right = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        reached = []
        for piece, i in symbol.items():
            if len(piece) == 1:
                reached.append(i)
                continue
            parts, last = list(piece), None
            while len(parts) > 1:
                best = min(((rank_of[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank_of), default=None)
                if best is None:
                    break
                k = best[1]
                last = parts[k], parts[k + 1]
                parts[k : k + 2] = ["".join(last)]
            if len(parts) == 1:
                self.left[i], self.right[i] = symbol[last[0]], symbol[last[1]]
                reached.append(i)
        pairs = [(symbol[p[:k]], symbol[p[k:]], rank_of[p]) for p in rank_of for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self.size = size
        keys = np.array([a * size + b for a, b, _ in pairs], dtype=np.int64)
        by_key = np.argsort(keys)
        self._table(keys[by_key], np.array([r for *_, r in pairs], dtype=np.int64)[by_key])
        self.code = np.zeros(0x110000, dtype=np.uint16)
        self.code[:] = len(letters) + 1
        for k, c in enumerate(letters):
            self.code[ord(c)] = k + 1
        self.other = len(letters) + 1
        names = {i: p for p, i in symbol.items()}
        self.matched = np.array(sorted(reached), dtype=np.int64)
        self.lengths = np.array([len(names[i]) for i in self.matched], dtype=np.int64)
        self.columns = -(-int(self.lengths.max()) // 4)
        grid = np.zeros((len(self.matched), self.columns * 4), dtype=np.uint64)
        for row, i in enumerate(self.matched):
            grid[row, : len(names[i])] = self.code[[ord(c) for c in names[i]]]
        pad = np.arange(self.columns * 4) >= self.lengths[:, None]
        pack = lambda g: [(g[:, 4 * c] << np.uint64(48)) | (g[:, 4 * c + 1] << np.uint64(32)) | (g[:, 4 * c + 2] << np.uint64(16)) | g[:, 4 * c + 3] for c in range(self.columns)]
        self.first, self.beyond = pack(grid), pack(np.where(pad, np.uint64(0xFFFF), grid))
        self.names = names

    def _table(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing from pair to rank, at most an eighth full."""
        self.bits = int(len(keys) * 8).bit_length()
        self.keys, self.ranks = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, FREE, dtype=np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            first = np.zeros(len(left), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = first & (self.keys[slot] < 0)
            self.keys[slot[put]], self.ranks[slot[put]] = keys[left[put]], ranks[left[put]]
            left, slot = left[~put], (slot[~put] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def joint_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of a and b, FREE if they do not merge."""
        keys = a * self.size + b
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], FREE)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & (len(self.keys) - 1)
            there, want = self.keys[slot], keys[rest]
            out[rest] = np.where(there == want, self.ranks[slot], FREE)
            more = (there != want) & (there >= 0)
            rest, slot = rest[more], slot[more]
        return out

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of a and b ends in a and b.

        The merges of both are undone from the last to the first; it does unless at some point the two symbols at the border
        would merge before the merge undone last. Equal merges go from the left. Symbols under 0 merge with nothing.
        """
        out = np.ones(len(a), dtype=bool)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        a, b, limit = a[at], b[at], np.full(len(at), FREE)
        while len(at):
            wrong = self.joint_rank(a, b) < limit
            out[at[wrong]] = False
            first, second = self.rank[a], self.rank[b]
            go = ~wrong & ((first >= 0) | (second >= 0))
            at, a, b, first, second = at[go], a[go], b[go], first[go], second[go]
            undo = first > second
            limit = np.where(undo, first, second + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return out

    def _bound(self, sorted_keys: list[np.ndarray], probes: list[np.ndarray], after: bool) -> np.ndarray:
        """For each probe how many suffixes stand before it (after: or start with it)."""
        low, high = np.zeros(len(probes[0]), dtype=np.int64), np.full(len(probes[0]), len(sorted_keys[0]), dtype=np.int64)
        for _ in range(len(sorted_keys[0]).bit_length()):
            open_ = low < high
            middle = np.minimum((low + high) >> 1, len(sorted_keys[0]) - 1)
            less, same = np.zeros(len(low), dtype=bool), np.ones(len(low), dtype=bool)
            for column, probe in zip(sorted_keys, probes, strict=True):
                own = column[middle]
                less |= same & (own < probe)
                same &= own == probe
            before = (less | same) if after else less
            low = np.where(open_ & before, middle + 1, low)
            high = np.where(open_ & ~before, middle, high)
        return low

    def _suffix_order(self, packed: np.ndarray, at: np.ndarray, total: int) -> np.ndarray:
        """The order of the suffixes at the given places, as deep as the longest piece: ranks of a depth give those of twice it."""
        depth, keys = 4, packed[at]
        while True:
            order = np.argsort(keys)
            if depth >= 4 * self.columns:
                return order
            ordered = keys[order]
            rank = np.zeros(total + depth, dtype=np.int64)
            rank[at[order]] = np.cumsum(np.append(True, ordered[1:] != ordered[:-1]))
            keys = rank[at] << 32 | rank[np.minimum(at + depth, total)]
            depth *= 2

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after the other, and how many each has."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        begin = np.cumsum(sizes) - sizes + np.arange(len(units))  # one free place after each unit
        place = np.arange(len(points)) + np.repeat(np.arange(len(units)), sizes)
        total = len(points) + len(units)
        code = np.zeros(total + 4 * self.columns, dtype=np.uint64)
        code[place] = self.code[points]
        packed = (code[:-3] << np.uint64(48)) | (code[1:-2] << np.uint64(32)) | (code[2:-1] << np.uint64(16)) | code[3:]
        known = np.flatnonzero((code[:total] > 0) & (code[:total] != self.other))
        suffixes = known[self._suffix_order(packed, known, total)]
        keys = [packed[suffixes + 4 * c] for c in range(self.columns)]
        if len(suffixes):
            low, high = self._bound(keys, self.first, False), self._bound(keys, self.beyond, True)
        else:
            low = high = np.zeros(len(self.matched), dtype=np.int64)
        counts = high - low
        start = suffixes[ranges(low, counts)]
        symbol, span = np.repeat(self.matched, counts), np.repeat(self.lengths, counts)
        strange = np.flatnonzero(code[:total] == self.other)
        start, symbol, span = np.concatenate([start, strange]), np.concatenate([symbol, np.full(len(strange), -1)]), np.concatenate([span, np.ones(len(strange), dtype=np.int64)])
        from_begin = np.zeros(total, dtype=np.int64)
        from_begin[place] = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        end = from_begin[start] + span
        order = np.argsort(end, kind="stable")
        start, symbol, end, span = start[order], symbol[order], end[order], span[order]
        steps = np.searchsorted(end, np.arange(1, int(end[-1]) + 2 if len(end) else 1))
        kept, came = np.full(total + 1, -2, dtype=np.int64), np.zeros(total + 1, dtype=np.int64)
        leads = from_begin[start] == 0
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            before = np.where(leads[a:b], -1, kept[start[a:b]])
            good = a + np.flatnonzero(self.agree(before, symbol[a:b]) & (leads[a:b] | (before > -2)))
            kept[start[good] + span[good]] = symbol[good]
            came[start[good] + span[good]] = start[good]
        # walk back from the ends of all units at once
        at, unit = begin + sizes, np.arange(len(units))
        walked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            go = at > begin[unit]
            at, unit = at[go], unit[go]
            if not len(at):
                break
            walked.append((unit, kept[at], came[at]))
            at = came[at]
        if not walked:
            return np.zeros(0, dtype=np.int64), np.zeros(len(units), dtype=np.int64)
        unit, symbol, at = (np.concatenate(c) for c in zip(*reversed(walked), strict=True))
        order = np.argsort(at, kind="stable")
        unit, symbol, at = unit[order], symbol[order], at[order]
        ids, per = symbol.copy(), np.ones(len(symbol), dtype=np.int64)
        spelled = np.flatnonzero((symbol < 0) | (symbol >= len(self.pieces)))
        if len(spelled):  # characters without a piece become their bytes
            point_at = np.zeros(total, dtype=np.int64)
            point_at[place] = points
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in point_at[at[spelled]].tolist()]
            per[spelled] = np.fromiter(map(len, raw), np.int64, len(raw))
            out = np.repeat(ids, per)
            ends = np.cumsum(per)
            out[ranges(ends[spelled] - per[spelled], per[spelled])] = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
            ids = out
        return ids, np.bincount(unit, per, len(units)).astype(np.int64)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.counts = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _learn(self, units: list[str]) -> None:
        ids, counts = self.encode_units(units)
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])

    @staticmethod
    def units(text: str) -> list[str]:
        """Units of a text with a space put first: a run of spaces and what follows; no piece crosses their borders."""
        if not text:
            return []
        words = text.replace(SPACE, " ").split(" ")
        if "" not in words:
            return [SPACE + w for w in words]
        out, spaces = [], 0
        for w in words:
            spaces += 1
            if w:
                out.append(SPACE * spaces + w)
                spaces = 0
        return [*out, SPACE * spaces] if spaces else out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        all_ids, per_text, at = [], [], 0
        while at < len(texts):
            chunk, chars = [], 0
            while at < len(texts) and (not chunk or chars + len(texts[at]) <= CHUNK_CHARS):
                chunk.append(self.units(texts[at]))
                chars += len(texts[at])
                at += 1
            joined = [u for units in chunk for u in units]
            new = list(set(joined).difference(self.known))
            if len(self.known) + len(new) > REMEMBERED:
                self._forget()
                new = list(set(joined))
            if new:
                self._learn(new)
            number = np.fromiter(map(self.known.__getitem__, joined), np.int64, len(joined))
            counts = self.counts[number]
            all_ids.append(self.flat[ranges(self.starts[number], counts)])
            owner = np.repeat(np.arange(len(chunk)), [len(u) for u in chunk])
            per_text.append(np.bincount(owner, counts, len(chunk)).astype(np.int64))
        empty = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        return (np.concatenate(all_ids), np.concatenate(per_text)) if texts else empty

    def decode(self, ids: np.ndarray, per_text: np.ndarray) -> list[bytes]:
        """The texts of ids as UTF-8; the space put first goes, and bytes that are no UTF-8 become U+FFFD each."""
        lengths = self.raw_lengths[ids]
        raw = self.raw_bytes[ranges(self.raw_starts[ids], lengths)].tobytes()
        ends = np.cumsum(per_text)
        edge = np.concatenate([[0], np.cumsum(lengths)])
        spelled = np.concatenate([[0], np.cumsum(self.is_byte[ids])])
        out = []
        for a, b in zip((ends - per_text).tolist(), ends.tolist(), strict=True):
            text = raw[edge[a] : edge[b]]
            text = text[1:] if text[:1] == b" " else text
            out.append(text.decode("utf-8", "corpusloom_each").encode() if spelled[b] > spelled[a] else text)
        return out


def loaded(path: str) -> PieceCodec:
    cache = worker_cache()
    if ("pieces", path) not in cache:
        cache["pieces", path] = PieceCodec(path)
    return cache["pieces", path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for every row of docs: the piece ids of the whole text, without begin or end.

    model is a path that every executor can open. Null and empty texts have no ids. Repeated rows each get their row, null
    ids stay, other columns take no part, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, per = codec.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    rows = docs.select(quoted(id_col).alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.transform(in_batches).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) for every row of encoded; null arrays and null or unknown ids inside them stand for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lists = part.column(1)
                per = np.diff(lists.offsets.to_numpy())
                texts = codec.decode(lists.flatten().to_numpy().astype(np.int64), per)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.decode() for t in texts], pa.string())], names=["doc_id", "text"])

    known = F.filter(F.coalesce(quoted(ids_col), F.array().cast("array<int>")), lambda i: (i >= 0) & (i < F.lit(len(loaded(model).pieces))))
    rows = encoded.select(quoted(id_col).alias("doc_id"), known.cast("array<int>").alias("ids"))
    return rows.transform(in_batches).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digests(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode()'s rows: of the ids as little-endian int32, and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(model)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ends = part.column(1).offsets.to_numpy()
                ids = part.column(1).flatten().to_numpy().astype("<i4")
                texts = codec.decode(ids, np.diff(ends))
                raw, ends = ids.tobytes(), (ends - ends[0]).tolist()
                own = [sha(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(own, pa.string()), pa.array(map(sha, texts), pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").transform(in_batches).mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
