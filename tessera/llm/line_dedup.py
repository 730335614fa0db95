"""Line deduplication by a segment-partition edit join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import beside, discard, fresh, materialise, small_batches, table
from tessera.llm.grouping import HELD, U, Filter, Names, blocks_met, candidate_groups, connected, digests, hottest, leads, mix, settled_names

#: Lines at most so many edits (of code points) apart are near-equal.
EDITS = 2
#: Code points of a line that near-equal ones are sought for; shorter ones repeat exactly or not at all.
SHORTEST = 24
#: Code points taken at once.
CHUNK = 1 << 18
#: Bins of the character histograms that bound the distance before it is computed.
BINS = 64
#: A key that more different lines than this have among those that a task holds is hot; at most so many keys are (32 MB).
HOT, HOT_KEYS = 8, 4_000_000
BLANK = " \t\n\v\f\r"


def shifts(i: int, longer: int, edits: int) -> range:
    """Where segment i of a line can lie in one that is ``longer`` by so many, if no earlier segment of it is found in place: edits left
    of it move it by no more than there can be, and so do those right of it."""
    return range(max(-i, longer - (edits - i)), min(i, longer + (edits - i)) + 1)


class Lines:
    """The lines of many texts as one array of code points with running sums, from which the hash of any piece is read off.

    These hashes only bring lines together, which are then verified; what a line is known by is its digest.
    """

    def __init__(self, seed: int = 9):
        rng = np.random.Generator(np.random.Philox(seed))
        self.salt = U(int(rng.integers(1, 1 << 62)))
        self.base = U(int(rng.integers(1 << 60, 1 << 63))) | U(1)
        self.inverse = U(pow(int(self.base), -1, 1 << 64))
        self.up = self.down = np.ones(1, U)

    def take(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The lines of ``texts`` that are long enough, where each starts, and its size."""
        flat = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        ends = np.flatnonzero(flat == 10)
        starts = np.r_[0, ends[:-1] + 1]
        size = ends - starts
        n = len(flat) + 1
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.r_[U(1), np.full((1 << n.bit_length()) - 1, b)]) for b in (self.base, self.inverse))
        self.sums = np.r_[U(0), np.cumsum(mix(flat.astype(U) + self.salt) * self.up[: len(flat)])]
        long = size >= SHORTEST
        return [x for t in texts for x in t.split("\n") if len(x) >= SHORTEST], starts[long], size[long]

    def hash(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.down[start] + size.astype(U))

    def keys(self, start: np.ndarray, size: np.ndarray, edits: int) -> Iterator[np.ndarray]:
        """Keys of every line: its own segments, and its pieces that can be a segment of a line as long or shorter by up to ``edits``.
        The last six bits of a key are the number of bits of the length."""
        k = edits + 1
        for longer in range(edits + 1):
            other = size - longer
            small, extra = other // k, other % k
            bits = np.frexp(other.astype(float))[1].astype(U)
            for i in range(k):
                n = small + (i >= k - extra)
                at = i * small + np.maximum(0, i - (k - extra))
                for s in shifts(i, longer, edits):
                    place = np.clip(at + s, 0, size - n)
                    yield mix(self.hash(start + place, n) + other.astype(U) * U(0x9E3779B97F4A7C15) + U(i)) & ~U(63) | bits


def key_bytes(keys: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Bytes of a line that has such a key, at most twice as many."""
    return np.int64(1) << np.minimum(keys & U(63), U(40)).astype(np.int64)


def texts_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """Where each piece of the batch begins, and its texts, nulls as empty."""
    at, held, size = 0, [], 0
    for i, t in enumerate(batch.column(column).to_pylist()):
        held.append(t or "")
        size += len(held[-1])
        if size >= CHUNK:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def within(x: str, y: str, edits: int) -> bool:
    """Whether at most ``edits`` insertions, deletions and replacements turn x into y.

    Bit-parallel in a band: after each character of y, bit d of state e says that e edits lead to diagonal d - ``edits``.
    """
    if abs(len(x) - len(y)) > edits:
        return False
    a = 0
    while a < min(len(x), len(y)) and x[a] == y[a]:
        a += 1
    b = 0
    while b < min(len(x), len(y)) - a and x[-1 - b] == y[-1 - b]:
        b += 1
    x, y = x[a : len(x) - b], y[a : len(y) - b]
    if not x or not y:
        return max(len(x), len(y)) <= edits
    band = 2 * edits + 1
    full = (1 << band) - 1
    states = [1 << edits]
    for _ in range(edits):
        states.append((states[-1] | states[-1] << 1) & full)
    for j, c in enumerate(y):
        match = 0
        for d in range(band):
            i = j + d - edits
            if 0 <= i < len(x) and x[i] == c:
                match |= 1 << d
        new = [states[0] & match]
        for e in range(1, edits + 1):
            new.append((states[e] & match | states[e - 1] | states[e - 1] >> 1 | new[e - 1] << 1) & full)
        states = new
        if not any(states):
            return False
    return bool(states[edits] >> (len(x) - len(y) + edits) & 1)


def near_lines(names: list[int], lines: list[str], edits: int = EDITS) -> list[tuple[int, int]]:
    """Links that connect all lines of a block that near-equal ones connect. A line is held against those as long, and not yet connected
    with it, whose character counts don't show that the distance is larger."""
    order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
    names, lines = [names[i] for i in order], [lines[i] for i in order]
    size = np.array([len(t) for t in lines])
    flat = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32) % BINS
    counts = np.bincount(np.repeat(np.arange(len(lines)), size) * BINS + flat, minlength=len(lines) * BINS).reshape(-1, BINS).astype(np.int32)
    root = np.arange(len(lines))
    found = []
    for q in range(len(lines) - 1):
        end = int(np.searchsorted(size, size[q] + edits, "right"))
        rest = np.flatnonzero(root[q + 1 : end] != root[q]) + q + 1
        if not len(rest):
            continue
        off = np.abs(counts[rest] - counts[q]).sum(1)
        # a replacement changes two counts, an insertion one
        for x in rest[off <= 2 * edits - (size[rest] - size[q])]:
            if root[x] != root[q] and within(lines[q], lines[x], edits):
                found.append((names[q], names[x]))
                root[root == root[x]] = root[q]
    return found


class New:
    """Tells which names a task hasn't met lately."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, names: np.ndarray) -> np.ndarray:
        out = []
        for i, x in enumerate(names.tolist()):
            if x not in self.seen:
                if len(self.seen) > 1 << 20:
                    self.seen.clear()
                self.seen.add(x)
                out.append(i)
        return np.array(out, np.int64)


def line_table(rows: DataFrame, edits: int, bits: int) -> DataFrame:
    """(kind, name, name2, doc_id, tie, number): kind 0, every line of ``rows`` (doc_id, tie, text) that isn't blank, with both halves of
    its digest; kind 1, name is a hot key and name2 how many lines of a task have it; kind 2, name is a number of entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, called, new = Lines(), Names(bits=bits), New()
        held: list[np.ndarray] = []
        n_held = 0

        def noted(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n_held
            if n_held >= HELD or last and n_held:
                keys, n = np.unique(np.concatenate(held), return_counts=True)
                keys, n = np.r_[keys[n > HOT].view(np.int64), n_held], np.r_[n[n > HOT], 0].astype(np.int64)
                kind = np.ones(len(keys), np.int32)
                kind[-1] = 2
                none = pa.nulls(len(keys), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(keys), pa.array(n), none, none, pa.nulls(len(keys), pa.int32())], names=["kind", "name", "name2", "doc_id", "tie", "number"])
                held, n_held = [], 0

        for batch in batches:
            for at, texts in texts_of(batch, 2):
                split = [t.split("\n") for t in texts]
                solid = [(i, j, x) for i, xs in enumerate(split) for j, x in enumerate(xs) if x.strip(BLANK)]
                found = digests(x.encode() for _, _, x in solid)
                who = pa.array([i + at for i, _, _ in solid], pa.int64())
                first = called.first(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(solid), np.int32)), pa.array(first), pa.array(found[:, 1]), batch.column(0).take(who), batch.column(1).take(who), pa.array([j for _, j, _ in solid], pa.int32())], names=["kind", "name", "name2", "doc_id", "tie", "number"])
                long, start, size = lines.take(texts)
                fresh_ = new(called.first(digests(x.encode() for x in long)))
                for keys in lines.keys(start[fresh_], size[fresh_], edits):
                    held.append(keys)
                    n_held += len(keys)
                yield from noted(False)
        yield from noted(True)

    return rows.mapInArrow(run, "kind int, name long, name2 long, doc_id long, tie long, number int")


def near_classes(rows: DataFrame, edits: int, names: Names, hot: np.ndarray, n_entries: int) -> DataFrame:
    """(node, root) of all different lines that have a near-equal one."""

    def entries():
        lines, new = Lines(), New()

        def make(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for _, texts in texts_of(batch, 2):
                long, start, size = lines.take(texts)
                called = names.of(digests(x.encode() for x in long))
                fresh_ = new(called)
                for k in lines.keys(start[fresh_], size[fresh_], edits):
                    yield k, called[fresh_]

        return make

    found = materialise(candidate_groups(rows, entries, n_entries, hot, key_bytes), "lines-found")
    groups = materialise(leads(found), "lines-groups")
    discard(found)
    wanted = Filter(groups.select("name"))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = New()
        for batch in batches:
            for _, texts in texts_of(batch, 2):
                long = [x for t in texts for x in t.split("\n") if len(x) >= SHORTEST]
                called = names.of(digests(x.encode() for x in long))
                take = np.flatnonzero(wanted.may_hold(called))
                take = take[new(called[take])]
                yield pa.RecordBatch.from_arrays([pa.array(called[take]), pa.array([long[i] for i in take], pa.string())], names=["name", "body"])

    held = rows.mapInArrow(bodies, "name long, body string")
    return connected(groups, lambda members: blocks_met(members, held, lambda n, b: near_lines(n, b, edits)), "lines")


def removals(rows: DataFrame, edits: int = EDITS, name_bits: int = 64) -> DataFrame:
    """(doc_id, tie, numbers): the lines that go from each row of ``rows`` (doc_id, tie, text); rows that keep all have none."""
    told = materialise(line_table(rows, edits, name_bits), "lines")
    n_entries = told.where("kind = 2").agg(F.coalesce(F.sum("name"), F.lit(0))).first()[0]
    hot = hottest(told.where("kind = 1").groupBy(F.col("name").alias("key")).agg(F.sum("name2").alias("n")), HOT_KEYS)
    names, lines = settled_names(told.where("kind = 0").select("name", "name2", "doc_id", "tie", "number"), name_bits)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "number")
    roots = beside(near_classes(rows, edits, names, hot, n_entries))
    each = lines.groupBy("name").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    each = materialise(each.join(roots, F.col("name") == F.col("node"), "left").where("n > 1 or root is not null").select("name", "first", "root"), "lines-repeated")
    firsts = materialise(each.where("root is not null").groupBy("root").agg(F.min("first").alias("first_of_all")), "lines-firsts")
    keep = materialise(each.join(beside(firsts), "root", "left").select("name", F.coalesce("first_of_all", "first").alias("keep")), "lines-keep")
    gone = lines.join(beside(keep), "name").where(place != F.col("keep"))
    gone = materialise(gone.groupBy("doc_id", "tie").agg(F.collect_set("number").alias("numbers")), "lines-gone")
    discard(told, each, firsts, keep)
    return gone


def deduplicate_lines(docs: DataFrame, edits: int = EDITS, name_bits: int = 64) -> DataFrame:
    """``docs`` with each near-equal line kept once in the corpus, and two last columns, ``n_lines`` and ``n_removed``, with underscores in
    front where such a column is there already.

    Lines end with a line feed; blank ones (of ASCII white space only) take no part. Lines at most ``edits`` edits apart, directly or
    through others, are one class; of fewer than SHORTEST code points, equal ones are. A class's first line, by doc_id (null last), then
    by the text's hash and the number in the text, stays and all others go, within a text as well. What a text keeps stays in order. A
    text that loses nothing is returned as it was, null included; one that loses all lines becomes empty. Of rows that repeat both doc_id
    and text one keeps what is kept, and the others lose all lines but blank ones. Other columns pass through.

    Any two near-equal lines share a segment: cut into ``edits`` + 1 segments, one survives. Lines whose pieces can be such a segment, by
    length and place, meet and are verified. A line that is repeated, however often, is one entry; lines are known by 128-bit digests.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n_lines, n_removed, doc, tie, gone_, nth = fresh(docs.columns, "n_lines", "n_removed", "doc", "tie", "gone", "nth")
    keyed = docs.withColumn(tie, F.xxhash64("text"))
    rows = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(tie).alias("tie"), "text")
    gone = removals(rows, edits, name_bits)

    @F.arrow_udf("string")
    def without(text: pa.Array, numbers: pa.Array, later: pa.Array) -> pa.Array:
        out = []
        for t, drop, all_of_it in zip(text.to_pylist(), numbers.to_pylist(), later.to_pylist(), strict=True):
            if t is not None and all_of_it:
                t = "\n".join(x for x in t.split("\n") if not x.strip(BLANK))
            elif drop:
                drop = set(drop)
                t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)
            out.append(t)
        return pa.array(out, pa.string())

    again = materialise(rows.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "tie"), "lines-again")
    as_key = lambda x: x.select(F.col("doc_id").alias(doc), F.col("tie").alias(f"{tie}_"), *x.columns[2:])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & F.col(tie).eqNullSafe(F.col(f"{tie}_"))
    parts = [keyed.withColumn(nth, F.lit(1))]
    if not again.isEmpty():
        once = keyed.join(beside(as_key(again)), same, "left_anti").withColumn(nth, F.lit(1))
        repeated = materialise(keyed.join(beside(as_key(again)), same, "left_semi").withColumn(nth, F.monotonically_increasing_id()), "lines-repeats")
        first = materialise(repeated.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.col(tie).alias("tie")).agg(F.min(nth).alias(gone_)), "lines-repeats-first")
        repeated = repeated.join(beside(as_key(first)), same).withColumn(nth, F.when(F.col(nth) == F.col(gone_), 1).otherwise(2)).drop(doc, f"{tie}_", gone_)
        parts = [once, repeated.select(*once.columns)]
    both = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    both = both.join(as_key(gone).withColumnRenamed("numbers", gone_), same, "left")
    count = F.when(F.octet_length("text") > 0, F.regexp_count("text", F.lit("\n")) + 1).otherwise(0).cast("long")
    left = F.when(F.col(nth) > 1, F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))).otherwise(F.coalesce(F.size(gone_), F.lit(0)))
    both = both.withColumns({n_lines: count, n_removed: F.coalesce(left, F.lit(0)).cast("long")})
    return both.withColumn("text", without("text", gone_, F.col(nth) > 1)).drop(doc, tie, f"{tie}_", gone_, nth)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = deduplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
