"""N-gram Jaccard join by grouped prefixes.

1. A sketch of fixed size counts every distinct shingle of every text; its counts order all shingles, rare before frequent.
   Any order gives the same links, a good one gives few candidates.
2. Each text becomes its size, the fingerprint of its shingle set, its prefix (as many of its first shingles as any partner
   must share one of) and a parity map of all its shingles. Equal sets are one class; classes of equal prefix and size are
   one group.
3. Groups that share a prefix shingle meet in that shingle's bucket; groups expand to their classes there. Buckets of few
   classes give all their pairs. In large ones every class first meets the bucket's leader, then some probes, and in the end
   every class of another component, so that pairs already connected are never listed and none is missed.
4. The parity maps of a pair differ in no more places than its sets do, which rules out nearly all false pairs before any
   text travels; the others are verified on the shingle sets of whole texts. Links become components by alternating stars.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, in_batches, quoted, stage

#: Classes of a bucket that all meet, probes of a larger one in a round, rounds of probes, spokes verified beside one hub.
ALL_PAIRS, PROBES, PROBE_ROUNDS, CHUNK = 12, 6, 1, 48
#: Cells of a table that travel together, links that one union-find takes at a time, salts over which a bucket's rows are dealt.
PART, LINKS, SALTS = 1 << 16, 1 << 18, 16

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result hangs on every bit of h."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: bytes, n: int) -> np.ndarray:
    """The distinct n-word shingles of a text as sorted 64-bit hashes; all words as one if there are fewer, none without words.

    A-Z fall to lower case; words part at space, tab, line ends, vertical tab and form feed.
    """
    from xxhash import xxh3_64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    each = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(n, len(words))
    total = np.full(len(each) - span + 1, span, dtype=np.uint64)
    for i in range(span):
        total = mixed(total * _K[1] + each[i : len(each) - span + 1 + i]) + _K[0]
    total.sort()
    return total if len(total) < 2 else total[np.append(True, total[1:] != total[:-1])]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(quoted(id_col).cast("bigint").alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


_PARTS = "part int, data binary"


def _sent(part: int, cells: np.ndarray) -> pa.RecordBatch:
    import zstandard

    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zstandard.compress(cells.tobytes(), 1)], pa.binary())], names=["part", "data"])


def _in_parts(table: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    for part in range(len(table) // size):
        piece = table[part * size : (part + 1) * size]
        if piece.any():
            yield _sent(part, piece)


def _together(sent: DataFrame, cells: int, size: int, combine, finish) -> bytes:
    """The tables of bytes that tasks sent in parts, as one; over two exchanges, so that no task reads more than a share.

    combine puts two parts together, in uint32; finish makes a part's final bytes.
    """

    def add(finished: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    raw = zstandard.decompress(data.as_py())
                    found = np.frombuffer(raw, dtype=np.uint8 if len(raw) == size else np.uint32).astype(np.uint32)
                    sums[part] = combine(sums[part], found) if part in sums else found
            for part, table in sums.items():
                yield _sent(part, finish(table) if finished else table)

        return run

    import zstandard

    salted = sent.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    once = salted.repartition(F.col("part"), F.col("salt")).select("part", "data").transform(in_batches).mapInArrow(frugal(add(False)), _PARTS)
    out = None
    for row in once.repartition(F.col("part")).transform(in_batches).mapInArrow(frugal(add(True)), _PARTS).collect():
        piece = zstandard.decompress(bytes(row["data"]))
        if out is None:
            out = bytearray(cells // size * len(piece))
        out[row["part"] * len(piece) : (row["part"] + 1) * len(piece)] = piece
    return bytes(out) if out is not None else b""


def _level(counts: np.ndarray) -> np.ndarray:
    """Binary logarithms of counts up to 2**15, two to a byte."""
    level = np.minimum(15, np.log2(np.maximum(counts, 1))).astype(np.uint8)
    return level[0::2] << 4 | level[1::2]


def frequency_levels(texts: DataFrame, n: int, bits: int) -> bytes:
    """Four bits for each of 2**bits hash ranges: the logarithm of how many distinct shingles of all texts fall there.

    A task counts to 255 in a cell, which is far beyond rare; tasks are summed without a limit.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.uint8)

        def put(cells: list[np.ndarray]) -> None:
            at, times = np.unique(np.concatenate(cells), return_counts=True)
            counts[at] = np.minimum(255, counts[at] + times)

        own, held = [], 0
        for batch in batches:
            for x in batch.column(0):
                own.append((shingles(x.as_py(), n) >> np.uint64(64 - bits)).astype(np.int64))
                held += len(own[-1])
                if held > 1 << 18:
                    put(own)
                    own, held = [], 0
        if own:
            put(own)
        yield from _in_parts(counts, PART)

    return _together(texts.select("text").transform(in_batches).mapInArrow(frugal(count), _PARTS), 1 << bits, PART, np.add, _level)


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(keys.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


class Sieve:
    """A bitmap of 2**bits hash places in which every key of a column has its place: what it lacks is surely no key.

    Sixteen places a key, up to 2**26 in all (8 MB); beyond that the more keys, the more others pass too. It only spares shuffles.
    """

    def __init__(self, keys: DataFrame):
        self.bits = bits = min(26, max(19, math.ceil(math.log2(max(1, keys.count()))) + 4))
        size = PART // 8

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(1 << bits, dtype=np.uint8)
            for batch in batches:
                table[_places(batch.column(0).to_numpy(), bits)] = 1
            yield from _in_parts(np.packbits(table), size)

        found = _together(keys.transform(in_batches).mapInArrow(frugal(mark), _PARTS), 1 << (bits - 3), size, np.bitwise_or, lambda t: t.astype(np.uint8))
        self.shared = keys.sparkSession.sparkContext.broadcast(found or bytes(1 << (bits - 3)))

    def passes(self, keys: np.ndarray) -> np.ndarray:
        place = _places(keys, self.bits)
        return (np.frombuffer(self.shared.value, dtype=np.uint8)[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


def fingerprint(size: int, values: np.ndarray) -> np.ndarray:
    """128 bits of a set of so many shingles, or of its prefix, as two numbers."""
    return np.frombuffer(hashlib.blake2b(values.tobytes(), digest_size=16, salt=size.to_bytes(8, "little")).digest(), dtype=np.int64)


def parity_map(values: np.ndarray) -> bytes:
    """A bit for each residue of a set's hashes, set where an odd number of them falls; as many bits as the next power of two."""
    bits = 1 << max(6, (len(values) - 1).bit_length())
    return np.packbits((np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Two sets differ in so many members at least. The longer map is folded: halves of a residue's map add up by parity."""
    if len(a) < len(b):
        a, b = b, a
    x, width = int.from_bytes(a), 8 * len(a)
    while width > 8 * len(b):
        width //= 2
        x = x >> width ^ x & (1 << width) - 1
    return (x ^ int.from_bytes(b)).bit_count()


def prefixes(texts: DataFrame, n: int, percent: int, levels: bytes, bits: int) -> DataFrame:
    """(doc_id, size, f1, f2, g1, g2, prefix, parity, text_hash): set size, fingerprints of the set and of prefix with size, and more."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)  # 2**(bits - 1) bytes at most, whatever the corpus
    names = ["doc_id", "text_hash", "size", "f1", "f2", "g1", "g2", "prefix", "parity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            sizes, marks, own, maps = [], [], [], []
            for x in batch.column(2):
                values = shingles(x.as_py(), n)
                size = len(values)
                cell = (values >> np.uint64(64 - bits)).astype(np.int64)
                rank = level[cell >> 1] >> (4 - 4 * (cell & 1)).astype(np.uint8) & 15 if size else cell
                first = values[np.argsort(rank, kind="stable")[: size + 1 - -(-percent * size // 100)]] if size else values
                sizes.append(size)
                marks.append(np.concatenate([fingerprint(size, values), fingerprint(size, first)]))
                own.append(first.view(np.int64))
                maps.append(parity_map(values))
            marks = np.stack(marks) if marks else np.zeros((0, 4), dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum([len(p) for p in own])]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own) if own else np.zeros(0, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *(pa.array(marks[:, i].copy()) for i in range(4)), prefix, pa.array(maps, pa.binary())], names=names)

    return texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").transform(in_batches).mapInArrow(frugal(run), "doc_id bigint, text_hash bigint, size bigint, f1 bigint, f2 bigint, g1 bigint, g2 bigint, prefix array<bigint>, parity binary")


def buckets(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, cls, size, at): classes that may have partners, in the buckets where they meet them.

    A bucket is a prefix shingle that stands in several groups, or a group of several classes. at is the shingle's place.
    """
    groups = stage(rows.groupBy("g1", "g2").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix")), "groups")
    shared = stage(groups.select(F.explode("prefix").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "shared")
    sieve = Sieve(shared)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            token, per = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(per)), per)
            at = np.arange(len(token)) - np.repeat(np.cumsum(per) - per, per)
            keep = sieve.passes(token)
            columns = [batch.column(0).take(pa.array(row[keep])), batch.column(1).take(pa.array(row[keep])), pa.array(token[keep]), pa.array(at[keep].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["g1", "g2", "bucket", "at"])

    postings = groups.select("g1", "g2", "prefix").transform(in_batches).mapInArrow(frugal(post), "g1 bigint, g2 bigint, bucket bigint, at int")
    meeting = postings.join(shared, "bucket")
    expanded = meeting.join(classes, ["g1", "g2"]).select("bucket", "cls", "size", "at")
    several = classes.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g1", "g2")
    within = classes.join(several, ["g1", "g2"]).select((F.col("g1").bitwiseXOR(F.col("g2"))).alias("bucket"), "cls", "size", F.lit(0).alias("at"))
    return expanded.unionByName(within)


def may_link(percent: int):
    """What sizes and the places of the shared shingle allow: overlap needed, and overlap that is left at most."""
    a, b = F.col("a_size"), F.col("b_size")
    needed = F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))
    left = F.least(a - F.col("a_at"), b - F.col("b_at"))
    return (F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)) & (left >= needed)


def possible(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The (hub, spoke) that sizes and parity maps leave possible; maps: (cls, size, parity), each class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            keep = [(a + b - least_difference(x, y)) * (100 + percent) >= 2 * percent * (a + b) for a, x, b, y in rows]
            yield batch.select(["hub", "spoke"]).filter(pa.array(keep, pa.bool_()))

    of = lambda name: maps.select(F.col("cls").alias(name), F.col("size").alias(f"{name}_size"), F.col("parity").alias(f"{name}_map"))
    held = pairs.join(of("hub"), "hub").join(of("spoke"), "spoke").select("hub", "spoke", "hub_size", "hub_map", "spoke_size", "spoke_map")
    return held.transform(in_batches).mapInArrow(frugal(run), "hub bigint, spoke bigint")


def linked(pairs: DataFrame, maps: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) of the given pairs (hub, spoke), written, whose shingle sets are similar enough; maps: (cls, least, f1), each once.

    A class is read from a text of its least id; where that id has several texts, its fingerprint tells which. A hub's text
    goes once to every CHUNK of its spokes.
    """
    chunks = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    dealt = pairs.join(chunks, "hub").select("hub", "spoke", F.pmod(F.xxhash64("spoke"), F.col("chunks")).cast("int").alias("chunk"))
    hubs = dealt.select("hub", "chunk").distinct().select(F.col("hub").alias("cls"), "hub", "chunk", F.lit(True).alias("is_hub"))
    needed = dealt.select(F.col("spoke").alias("cls"), "hub", "chunk", F.lit(False).alias("is_hub")).unionByName(hubs)
    needed = stage(needed.join(maps.select("cls", "least", "f1"), "cls"), "needed")
    sieve = Sieve(needed.select("least").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sieve.passes(batch.column(0).to_numpy())))

    found = texts.where("doc_id is not null").select(F.col("doc_id").alias("least"), "text").transform(in_batches).mapInArrow(frugal(run), "least bigint, text binary").dropDuplicates(["least", "text"])

    def verify(key: tuple, rows: pa.Table) -> pa.Table:
        sets: dict[bool, dict[int, np.ndarray]] = {True: {}, False: {}}
        for cls, f1, is_hub, text in zip(*(rows.column(c).to_pylist() for c in ("cls", "f1", "is_hub", "text")), strict=True):
            values = shingles(text, n)
            if fingerprint(len(values), values)[0] == f1:
                sets[is_hub][cls] = values
        found: list[int] = []
        for mine in sets[True].values():
            for cls, other in sets[False].items():
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    found.append(cls)
        return pa.table({"a": pa.array([key[0].as_py()] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return found.join(needed, "least").groupBy("hub", "chunk").applyInArrow(verify, "a bigint, b bigint")


def numbered(classes: DataFrame) -> tuple[DataFrame, bool]:
    """classes with a number cls each: its least id, or, for all but one class of an id with several texts, one beyond 2**62;
    and whether all numbers are least ids."""
    if classes.groupBy("least").count().where("count > 1").isEmpty():
        return classes.withColumn("cls", F.col("least")), True
    place = F.row_number().over(Window.partitionBy("least").orderBy("f1", "f2"))
    beyond = F.lit(1 << 62) + F.xxhash64("f1", "f2").bitwiseAND(F.lit((1 << 62) - 1))
    return stage(classes.withColumn("cls", F.when(place == 1, F.col("least")).otherwise(beyond)), "numbered"), False


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task's links connect, as links to the least of each component; at most LINKS links are held at a time."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up] = parent.setdefault(up, up)
        return x

    def stars() -> pa.RecordBatch:
        nodes = [x for x in parent if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        if len(parent) > LINKS:
            yield stars()
            parent.clear()
    yield stars()


def components(links: DataFrame) -> DataFrame:
    """(cls, component): the smallest class that links reach, for every class in links (columns a and b).

    Tasks contract their own links first; then alternating large and small stars. Every round is written, and a round that
    changes nothing is the last.
    """
    edges = stage(links.select("a", "b").transform(in_batches).mapInArrow(frugal(_contracted), "a bigint, b bigint").toDF("u", "v").distinct(), "edges")
    state = lambda: edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now, before = state(), None
    while now != before:
        # large: every neighbour above u goes to the least of u's neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        # small: every neighbour below u, and u, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u")
        small = small.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
        edges = stage(small.distinct(), "edges")
        now, before = state(), now
    return edges.select(F.col("u").alias("cls"), F.col("v").alias("component"))


def _totalled(rows: DataFrame, **totals) -> DataFrame:
    """rows (bucket, cls, ...) with a salt by cls and totals over their bucket; a bucket's rows never meet in one task.

    totals: name=(aggregate, how partial ones add up). Partial totals by bucket and salt are few to a bucket; they learn the
    whole totals and bring them to the rows of their salt.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)))
    partial = salted.groupBy("bucket", "salt").agg(*[once.alias(name) for name, (once, _) in totals.items()])
    whole = partial.groupBy("bucket").agg(*[again(F.col(name)).alias(name) for name, (_, again) in totals.items()])
    return salted.join(partial.select("bucket", "salt").join(whole, "bucket"), ["bucket", "salt"])


def _connected(met: DataFrame, maps: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """components()'s rows for all links. met: buckets()' rows, written. Only classes that may have a partner are read again."""
    counted = _totalled(met, n=(F.count(F.lit(1)), F.sum), leader=(F.min(F.struct("cls", "size", "at")), F.min))
    side = lambda df, s, *more: df.select("bucket", *[F.col(c).alias(f"{s}_{c}") for c in ("cls", "size", "at", *more)])
    pair = lambda df: df.where(may_link(percent)).select(F.col("a_cls").alias("hub"), F.col("b_cls").alias("spoke"))

    def found(pairs: DataFrame) -> DataFrame:
        left = stage(possible(pairs, maps, percent), "possible")
        return left.toDF("a", "b") if left.isEmpty() else stage(linked(left, maps, texts, n, percent), "links")

    few = stage(counted.where(F.col("n") <= ALL_PAIRS).select("bucket", "cls", "size", "at"), "few")
    close = side(few, "a").join(side(few, "b"), "bucket").where(F.col("a_cls") < F.col("b_cls"))
    large = stage(counted.where(F.col("n") > ALL_PAIRS).select("bucket", "cls", "size", "at", "leader"), "large-buckets")
    star = side(large.where("cls <> leader.cls"), "b", "leader").select("*", *[F.col(f"b_leader.{c}").alias(f"a_{c}") for c in ("cls", "size", "at")])
    tried = stage(pair(close).unionByName(pair(star)).distinct(), "pairs")
    named = components(found(tried))
    for step in range(PROBE_ROUNDS + 1):
        # buckets of one component hold no pair that could still matter
        inside = large.select("bucket", "cls", "size", "at").join(named, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        open_ = _totalled(inside, low=(F.min("component"), F.min), high=(F.max("component"), F.max), n=(F.count(F.lit(1)), F.sum))
        large = stage(open_.where("low < high").select("bucket", "salt", "cls", "size", "at", "component", "n"), "large-buckets")
        if large.isEmpty():
            break
        last = step == PROBE_ROUNDS
        probes = large if last else large.where(F.pmod(F.xxhash64("cls", F.lit(step)), F.col("n")) < PROBES)
        # merged, not broadcast: what Spark knows is the size of the file, not of the rows that salts make of it
        probes = side(probes, "a", "component").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        meet = side(large, "b", "component", "salt").withColumnRenamed("b_salt", "salt").join(probes, ["bucket", "salt"]).where("a_component <> b_component")
        meet = pair(meet.where("a_cls < b_cls") if last else meet).select(F.least("hub", "spoke").alias("hub"), F.greatest("hub", "spoke").alias("spoke")).distinct()
        fresh = stage(meet.join(tried.select(F.least("hub", "spoke").alias("hub"), F.greatest("hub", "spoke").alias("spoke")), ["hub", "spoke"], "left_anti"), "pairs")
        tried = tried.unionByName(fresh)
        new = found(fresh)
        if not new.isEmpty():
            named = components(named.select(F.col("cls").alias("a"), F.col("component").alias("b")).unionByName(new))
    return named


def join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash) for every row of docs; text_hash is xxhash64 of the text's bytes.

    Two texts link if 100 * shared shingles >= percent * shingles of either; component_id is the smallest id that links
    reach. A null, empty or wordless text has no shingles and is its own component, as is a row of null id (component null).
    Rows that repeat an id and text are of one class; where an id has several texts, each row goes by its own. Other columns
    take no part; an empty table gives no rows. Hashes of 64 bits stand for shingles, of 128 for sets.
    """
    texts = _texts(docs, id_col, text_col)
    if bits is None:  # about a cell a shingle, from 2**16 to 2**25 of them (16 MB)
        letters = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(25, max(16, math.ceil(math.log2(1 + letters / 6))))
    marked = stage(prefixes(texts, n, percent, frequency_levels(texts, n, bits), bits), "prefixes")
    rows = marked.where("size > 0 and doc_id is not null")
    classes, plain = numbered(stage(rows.groupBy("f1", "f2").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("g1", "g2", "size", "parity")]), "classes"))
    met = stage(buckets(rows, classes), "buckets")
    named = _connected(met, classes.select("cls", "least", "f1", "size", "parity"), texts, n, percent)
    named = classes.select("cls", "least", "f1", "f2").join(named, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    if not plain:  # a component's least number may stand for an id that isn't its least
        lowest = stage(named.groupBy("component").agg(F.min("least").alias("lowest")), "lowest")
        named = named.join(lowest, "component").withColumn("component", F.col("lowest"))
    named = named.select("f1", "f2", "component")
    out = marked.select("doc_id", "text_hash", "size", "f1", "f2").join(named, ["f1", "f2"], "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when((F.col("size") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash")


def representatives(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, but one document of each group of linked texts: that of the smallest id.

    Goes by id and text: where an id has several texts, each stays or goes by its own group. Of rows that repeat an id and
    text the first by their other columns stays. Rows of null id, and texts without shingles, are in no group and stay.
    """
    found = stage(join(docs, n, percent, id_col, text_col).where("doc_id is not null"), "found")
    columns = [f"c{i}" for i in range(len(docs.columns))]
    key = docs.toDF(*columns).withColumn("doc_id", F.col(columns[docs.columns.index(id_col)]).cast("bigint"))
    key = key.withColumn("text_hash", F.xxhash64(F.coalesce(F.col(columns[docs.columns.index(text_col)]).cast("string"), F.lit("")).cast("binary")))
    gone = found.where("doc_id <> component_id").select("doc_id", "text_hash").distinct()
    again = stage(found.where("doc_id = component_id and n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"), "again")
    left = key.join(gone, ["doc_id", "text_hash"], "left_anti")
    if not again.isEmpty():
        order = Window.partitionBy("doc_id", "text_hash").orderBy(*[F.col(c).cast("string") for c in columns])
        first = left.join(again, ["doc_id", "text_hash"], "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
        left = left.join(again, ["doc_id", "text_hash"], "left_anti").unionByName(first)
    return left.select(*columns).toDF(*docs.columns)
