"""Candidate groups for similarity joins: items that share a key meet in the group of the smallest of them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import beside, components, discard, materialise

#: Entries that a task holds before it sends them, entries that meet in a task, and rows of a batch that it returns.
HELD, PART_ENTRIES, ROWS = 1 << 18, 600_000, 1 << 16
#: Bits of the filter over the items that have candidates: for each item, and at most (32 MB).
ITEM_BITS, FILTER_BITS = 16, 1 << 28
SLICES = 64
#: Items of a group that are verified together, and their bytes; and when all of a group are held against each other.
BLOCK, BLOCK_BYTES, WIDE_BLOCK = 128, 4 << 20, 512
#: Items whose 64-bit names clash, at most; some 10^10 items have a handful.
CLASHES = 100_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


def digests(items: Iterable[bytes]) -> np.ndarray:
    """(items, 2) int64: the 128 bits of a real digest of each, so that no two different items of any corpus have the same."""
    return np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in items), np.int64).reshape(-1, 2)


class Names:
    """The 64 bits by which an item is known: the first half of its digest, or the second where two items have the first in common."""

    def __init__(self, clashing: Iterable[int] = (), bits: int = 64):
        self.clashing, self.keep = np.sort(np.array(list(clashing), np.int64)), np.int64(-1 if bits == 64 else (1 << bits) - 1)

    def first(self, found: np.ndarray) -> np.ndarray:
        return found[:, 0] & self.keep

    def of(self, found: np.ndarray) -> np.ndarray:
        first = self.first(found)
        return np.where(np.isin(first, self.clashing), found[:, 1], first) if len(self.clashing) else first


def settled_names(table: DataFrame, bits: int) -> tuple[Names, DataFrame]:
    """Names without clashes for the items of ``table`` (name, the first half; name2, the second), and ``table`` with them as ``name``."""
    odd = table.groupBy("name").agg(F.min("name2").alias("low"), F.max("name2").alias("high")).where("low <> high").select("name").limit(CLASHES + 1).collect()
    if len(odd) > CLASHES:
        raise RuntimeError("too many items' names clash")
    clashing = [r["name"] for r in odd]
    if clashing:
        table = table.withColumn("name", F.when(F.col("name").isin(clashing), F.col("name2")).otherwise(F.col("name")))
    return Names(clashing, bits), table


def parts_for(spark: SparkSession, entries: int) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // PART_ENTRIES))


def _cut(part: np.ndarray, cols: list[np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
    """The parts that occur, and each column's values of each, packed."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
    pairs = list(zip(cut[:-1], cut[1:], strict=True))
    return part[cut[:-1]], [pa.array([v[a:b].tobytes() for a, b in pairs], pa.binary()) for v in (x[order] for x in cols)]


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which ``keys`` are in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def candidate_groups(rows: DataFrame, entries: Callable[[], Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, ...]]]], n_entries: int, hot: np.ndarray, weigh: Callable[[np.ndarray, np.ndarray | None], np.ndarray], percent: int | None = None, shared: int = 1) -> DataFrame:
    """(kind, a, b, n, need): kind 0, item b of n bytes belongs to the group that item a leads; kind 3, hot key a has item b of n bytes.

    ``entries()`` makes a task's function from a batch of ``rows`` to arrays of keys (uint64) and the items (int64) that have them; there
    are some ``n_entries``. The inverted index goes through the shuffle in packed pieces, each the entries of many items for one part of
    the keys; there are as many parts as hold a bounded number of entries. The items of a key join the group of the smallest, so a key
    with n items costs n rows, and any two items that share a key are in one group. The entries of the ``hot`` keys (sorted) are dealt by
    item too, and ``leads`` brings them together. ``weigh`` tells bytes of an item from arrays of keys and sizes.
    With ``percent``, entries have a third array, the items' sizes (int32). An item can then only be linked with one of at least that part
    of its size, so a key's items are cut into groups where the next smaller size is below that. With ``shared`` as well, groups of two
    are rows of kind 2 instead: a and b share n of their keys (here), and are to share ``shared``, or the least overlap if that is less.
    """
    parts = parts_for(rows.sparkSession, n_entries)
    names = ["keys", "items", "sizes"][: 3 if percent else 2]
    known = rows.sparkSession.sparkContext.broadcast(hot)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, arrays, held = entries(), [], 0

        def sent() -> pa.RecordBatch:
            cols = [np.concatenate(x) for x in zip(*arrays, strict=True)]
            salted = _among(cols[0], known.value)
            part = cols[0] % U(parts)
            part[salted] = mix(cols[0][salted] ^ mix(cols[1][salted].view(U))) % U(parts)
            part, packed = _cut(part.astype(np.int64) * 2 + salted, cols)
            return pa.RecordBatch.from_arrays([pa.array((part >> 1).astype(np.int32)), pa.array((part & 1).astype(bool)), *packed], names=["part", "salted", *names])

        for batch in batches:
            for some in make(batch):
                arrays.append(some)
                held += len(some[0])
                if held >= HELD:
                    yield sent()
                    arrays, held = [], 0
        if held:
            yield sent()

    def gathered(held: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Each key's items once, by key, size and item; keys with one item only are left out unless salted."""
        k, x, *n = (np.concatenate(v) for v in held)
        order = np.lexsort((x, *n, k))
        k, x, n = k[order], x[order], [v[order].astype(np.int64) for v in n]
        new = np.r_[True, (k[1:] != k[:-1]) | (x[1:] != x[:-1])]
        return k[new], x[new], [v[new] for v in n]

    def plain(held: list[list[np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
        k, x, *n = (np.concatenate(v) for v in held)
        order = np.argsort(k, kind="stable")  # most keys occur once, and go before items are sorted
        k = k[order]
        same = k[1:] == k[:-1]
        keep = np.r_[same, False] | np.r_[False, same]
        if not keep.any():
            return
        k, x, n = gathered([[k[keep]], [x[order][keep]], *([v[order][keep]] for v in n)])
        apart = k[1:] != k[:-1]
        if percent:
            apart |= 100 * n[0][:-1] < percent * n[0][1:]
        head = np.flatnonzero(np.r_[True, apart])
        size = np.diff(np.r_[head, len(k)])
        lead = np.repeat(np.minimum.reduceat(x, head), size)
        least = 1
        if percent and shared > 1:
            at = head[size == 2]
            need = np.minimum(shared, -(-percent * np.maximum(n[0][at], n[0][at + 1]) // 100)) if len(at) else at
            two, count = np.unique(np.stack([np.minimum(x[at], x[at + 1]), np.maximum(x[at], x[at + 1]), need], 1), axis=0, return_counts=True)
            yield 2, np.column_stack([two[:, :2], count, two[:, 2]])
            least = 2
        take = np.repeat(size > least, size)
        yield 0, _with_none(np.unique(np.stack([lead[take], x[take], weigh(k[take], n[0][take] if percent else None)], 1), axis=0))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[list]] = {s: [[] for _ in names] for s in (False, True)}
        for batch in batches:
            for i, kind in enumerate((U, np.int64, np.int32)[: len(names)]):
                for s, v in zip(batch.column(1).to_pylist(), batch.column(i + 2), strict=True):
                    held[s][i].append(np.frombuffer(v.as_py(), kind))
        found = [*plain(held[False])] if held[False][0] else []
        if held[True][0]:
            k, x, n = gathered(held[True])
            found.append((3, _with_none(np.stack([k.view(np.int64), x, weigh(k, n[0] if percent else None)], 1))))
        for kind, out in found:
            for i in range(0, len(out), ROWS):
                some = out[i : i + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), *[pa.array(some[:, j]) for j in range(4)]], names=["kind", "a", "b", "n", "need"])

    packed = rows.mapInArrow(post, ", ".join(["part int", "salted boolean", *(f"{x} binary" for x in names)]))
    return packed.repartitionById(parts, "part").mapInArrow(meet, "kind int, a long, b long, n long, need long")


def _with_none(rows: np.ndarray) -> np.ndarray:
    return np.column_stack([rows, np.zeros(len(rows), np.int64)])


def leads(found: DataFrame) -> DataFrame:
    """(lead, name, bytes) of candidate groups (a written table), those of two that share enough keys included, and those of hot keys."""
    groups = found.where("kind = 0").select(F.col("a").alias("lead"), F.col("b").alias("name"), F.col("n").alias("bytes"))
    twos = found.where("kind = 2").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need")).where("n >= need")
    out = groups.union(twos.select(F.col("a").alias("lead"), F.explode(F.array("a", "b")).alias("name"), F.lit(0).cast("long")))
    hot = found.where("kind = 3")
    first = materialise(hot.groupBy("a").agg(F.min("b").alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1").select("a", "lead"), "hot-leads")
    out = out.union(hot.join(beside(first), "a").select("lead", F.col("b").alias("name"), F.col("n").alias("bytes")))
    return out.groupBy("lead", "name").agg(F.max("bytes").alias("bytes"))


def counted_keys(rows: DataFrame, n_entries: int, more: int) -> DataFrame:
    """(key, n): the keys that more than ``more`` different items have; ``rows`` (name, keys) has each item's keys, packed.

    What a task holds of a key beyond ``more`` items it sends as one number, so a key that a third of all items have costs a few rows a
    task. Items are told apart by 32 bits; two rows of an item are one, but where a task has sent a number for it.
    """
    parts = parts_for(rows.sparkSession, n_entries)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def sent() -> pa.RecordBatch:
            k, x = (np.concatenate(v) for v in zip(*held, strict=True))
            order = np.lexsort((x, k))
            k, x = k[order], x[order]
            new = np.r_[True, (k[1:] != k[:-1]) | (x[1:] != x[:-1])]
            k, x = k[new], x[new]
            head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[head, len(k)])
            many = size > more
            few = np.repeat(~many, size)
            light, (lk, lx) = _cut((k[few] % U(parts)).astype(np.int32), [k[few], x[few]])
            heavy, (hk, hn) = _cut((k[head][many] % U(parts)).astype(np.int32), [k[head][many], size[many].astype(np.int32)])
            return pa.RecordBatch.from_arrays([pa.array(np.r_[light, heavy].astype(np.int32)), pa.array(np.repeat([False, True], [len(light), len(heavy)])), pa.concat_arrays([lk, hk]), pa.concat_arrays([lx, hn])], names=["part", "sums", "keys", "items"])

        for batch in batches:
            for name, keys in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = np.frombuffer(keys.as_py(), U)
                held.append((keys, np.full(len(keys), name & 0x7FFFFFFF, np.int32)))
                n += len(keys)
                if n >= HELD:
                    yield sent()
                    held, n = [], 0
        if n:
            yield sent()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, tuple[list, list]] = {s: ([np.zeros(0, U)], [np.zeros(0, np.int32)]) for s in (False, True)}
        for batch in batches:
            for s, k, x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                held[s][0].append(np.frombuffer(k, U))
                held[s][1].append(np.frombuffer(x, np.int32))
        k, x = (np.concatenate(v) for v in held[False])
        order = np.lexsort((x, k))
        k, x = k[order], x[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1])
        k = np.r_[k[new], np.concatenate(held[True][0])]
        keys, at = np.unique(k, return_inverse=True)
        n = np.bincount(at, np.r_[np.ones(int(new.sum())), np.concatenate(held[True][1])], len(keys)).astype(np.int64)
        keys, n = keys[n > more].view(np.int64), n[n > more]
        for i in range(0, len(keys), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + ROWS]), pa.array(n[i : i + ROWS])], names=["key", "n"])

    packed = rows.select("name", "keys").mapInArrow(post, "part int, sums boolean, keys binary, items binary")
    return packed.repartitionById(parts, "part").mapInArrow(meet, "key long, n long")


def hottest(counted: DataFrame, most: int) -> np.ndarray:
    """The most frequent keys of ``counted`` (key, n), sorted: all whose n has at least some size, and no more than ``most``."""
    level = F.floor(F.log2("n") * 16)
    least, total = None, 0
    for r in counted.groupBy(level.alias("level")).count().orderBy(F.col("level").desc()).collect():  # a thousand rows at most
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    if least is None:
        return np.zeros(0, U)

    def packed(rows: pa.Table) -> pa.Table:
        return pa.table({"keys": pa.array([rows.column("key").to_numpy().tobytes()], pa.binary())})

    rows = counted.where(level >= least).select(F.pmod("key", F.lit(SLICES)).alias("slice"), "key")
    got = rows.groupBy("slice").applyInArrow(packed, "keys binary").collect()  # at most ``most`` numbers
    return np.sort(np.concatenate([np.frombuffer(r["keys"], U) for r in got]))


class Filter:
    """A filter of bounded size over the numbers in a written table: what it lacks is not among them. It only spares work; joins decide."""

    def __init__(self, names: DataFrame):
        self.size = size = min(FILTER_BITS, max(1 << 16, 1 << (names.count() * ITEM_BITS).bit_length()))
        width = size // SLICES

        def slice_of(rows: pa.Table) -> pa.Table:
            bits = np.zeros(width, bool)
            bits[rows.column("bit").to_numpy() % width] = True
            return pa.table({"slice": pa.array([rows.column("slice")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

        bit = F.pmod(names.columns[0], F.lit(size)).alias("bit")
        slices = names.select(bit).distinct().withColumn("slice", F.floor(F.col("bit") / width)).groupBy("slice").applyInArrow(slice_of, "slice long, bits binary")
        packed = np.zeros((SLICES, width // 8), np.uint8)
        for r in slices.collect():
            packed[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
        self.bits = names.sparkSession.sparkContext.broadcast(packed.ravel())

    def may_hold(self, names: np.ndarray) -> np.ndarray:
        bit = names % np.int64(self.size)
        return (self.bits.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)


def blocks_met(members: DataFrame, bodies: DataFrame, links: Callable[[list[int], list], list[tuple[int, int]]]) -> DataFrame:
    """(a, b) links that ``links`` finds within each block; ``members`` is (lead, block, name), ``bodies`` (name, body), a name maybe
    several times. Each task goes through its blocks one by one."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, found = None, [], []
        held: list = []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            bodies_ = batch.column(3)
            for i, (lead, block, name) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if (lead, block) != key:
                    found += links(names, held) if len(names) > 1 else []
                    key, names, held = (lead, block), [], []
                if not names or names[-1] != name:
                    names.append(name)
                    held.append(bodies_[i].as_py())
            if found:
                yield told()
                found = []
        found += links(names, held) if len(names) > 1 else []
        if found:
            yield told()

    once = bodies.groupBy("name").agg(F.first("body").alias("body"))
    met = members.join(once, "name").select("lead", "block", "name", "body")
    return met.repartition("lead", "block").sortWithinPartitions("lead", "block", "name").mapInArrow(verify, "a long, b long")


def connected(groups: DataFrame, verified: Callable[[DataFrame], DataFrame], tag: str) -> DataFrame:
    """(node, root) of all items that links connect to others; ``groups`` is (lead, name, bytes), ``verified`` turns (lead, block, name)
    into links.

    Groups of more than BLOCK items, or BLOCK_BYTES, are cut into blocks, and each block also holds the group's leader. What isn't
    connected with the leader after that is then held against every block, again in pieces of bounded size. So all pairs of a group that
    aren't connected otherwise meet, whatever its size, and a group of n that are alike costs n. Which groups are large is joined to
    their members by a table of the large groups only, so that a large group is no task of its own.
    """
    enough = lambda items, size: F.greatest(F.ceil(F.col(items) / BLOCK), F.ceil(F.col(size) / BLOCK_BYTES)).cast("int")
    sizes = groups.groupBy("lead").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("all"))
    large = materialise(sizes.select("lead", enough("m", "all").alias("many"), F.greatest(F.ceil(F.col("m") / WIDE_BLOCK), F.ceil(F.col("all") / BLOCK_BYTES)).cast("int").alias("wide")).where("many > 1"), f"{tag}-large")
    groups = materialise(groups.join(beside(large), "lead", "left").select("lead", "name", "bytes", F.coalesce("many", F.lit(1)).alias("many"), "wide"), f"{tag}-members")
    spot = lambda salt, n: F.pmod(F.xxhash64("name", F.lit(salt)), F.col(n)).cast("int")
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    members = groups.select("lead", "name", F.explode(F.when((F.col("name") == F.col("lead")) & (F.col("many") > 1), up_to("many")).otherwise(F.array(spot(0, "many")))).alias("block"))
    links = materialise(verified(members), f"{tag}-links")
    if not large.isEmpty():
        roots = beside(components(links))
        named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        placed = groups.where("many > 1").join(named("name"), "name", "left").join(named("lead"), "lead", "left")
        placed = materialise(placed.withColumn("odd", F.coalesce("name_root", "name") != F.coalesce("lead_root", "lead")).select("lead", "name", "bytes", "wide", "odd"), f"{tag}-placed")
        odd = placed.where("odd").groupBy("lead").agg(F.count(F.lit(1)).alias("n_odd"), F.sum("bytes").alias("all_odd"))
        odd = materialise(odd.select("lead", F.greatest(F.ceil(F.col("n_odd") / WIDE_BLOCK), F.ceil(F.col("all_odd") / BLOCK_BYTES)).cast("int").alias("chunks")), f"{tag}-odd")
        if not odd.isEmpty():
            # block b of the group with chunk c of the odd ones is number b * chunks + c
            placed = placed.join(beside(odd), "lead")
            as_member = placed.select("lead", "name", F.explode(F.transform(up_to("chunks"), lambda c: spot(1, "wide") * F.col("chunks") + c)).alias("block"))
            as_odd = placed.where("odd").select("lead", "name", F.explode(F.transform(up_to("wide"), lambda b: b * F.col("chunks") + spot(2, "chunks"))).alias("block"))
            links = links.union(materialise(verified(as_member.union(as_odd).distinct()), f"{tag}-more-links"))
    out = components(links)
    discard(groups)
    return out
