"""Exact deduplication by a log-structured merge index over digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, beside, discard, fresh, materialise, table
from tessera.llm.grouping import Filter

#: Distinct digests that a memtable holds before it is flushed; bounds a task's memory.
MEMTABLE = 200_000
#: Runs that one compaction merges.
FAN_IN = 16
#: Digests of a range, on average; ranges up to which they are that small; and digests of a range at most.
RANGE_DIGESTS, RANGES, MOST_DIGESTS = 20_000, 1024, 2_000_000
#: Bits of a run's filter for each digest in it.
FILTER_BITS = 10
RUN = "range int, run long, n long, digests binary, nones binary, ids binary, uids binary, counts binary, filter binary"
#: The columns of a run's entries: digest, whether its doc_id is null, doc_id, number of the row, rows.
Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _probes(heads: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for probe in (heads, heads >> np.uint64(17) ^ heads << np.uint64(31)):
        yield (probe % np.uint64(size)).astype(np.int64)


def _filter(heads: np.ndarray) -> np.ndarray:
    """A two-probe Bloom filter over the digests' first 8 bytes."""
    bits = np.zeros(max(64, len(heads) * FILTER_BITS), dtype=bool)
    for at in _probes(heads, len(bits)):
        bits[at] = True
    return np.packbits(bits)


def _maybe(packed: bytes, n: int, heads: np.ndarray) -> np.ndarray:
    bits, found = np.frombuffer(packed, np.uint8), np.ones(len(heads), dtype=bool)
    for at in _probes(heads, max(64, n * FILTER_BITS)):
        found &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return found


def _heads(keys: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(keys).view(np.uint8).reshape(len(keys), keys.dtype.itemsize)[:, :-1]
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : min(8, raw.shape[1])] = raw[:, :8]
    return out.view(">u8").ravel().astype(np.uint64)


def _keys(raw: np.ndarray) -> np.ndarray:
    """Byte rows as fixed-width numpy strings. A zero byte at the end would be cut in comparison, so each key gets a closing one byte."""
    out = np.ones((len(raw), raw.shape[1] + 1), np.uint8)
    out[:, :-1] = raw
    return out.view(f"S{raw.shape[1] + 1}").ravel()


def _fold(parts: list[Entries]) -> Entries:
    """Sorted distinct digests, with the smallest (null last, doc_id, row) and the sum of counts of each."""
    keys, none, ids, uids, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((uids, ids, none, keys))
    keys, none, ids, uids, counts = (x[order] for x in (keys, none, ids, uids, counts))
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], none[first], ids[first], uids[first], np.add.reduceat(counts, first) if len(first) else counts


def _pack(run: int, part: np.ndarray, entries: Entries) -> pa.RecordBatch:
    """A sorted run as a row for each range of digests."""
    heads = _heads(entries[0])
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    cols: list[list] = [[] for _ in range(9)]
    for a, b in zip(cuts, np.r_[cuts[1:], len(part)], strict=True):
        for col, v in zip(cols, (int(part[a]), run, b - a, *(x[a:b].tobytes() for x in entries), _filter(heads[a:b]).tobytes()), strict=True):
            col.append(v)
    kinds = (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RUN.split(", ")])


def _unpack(row: dict, width: int) -> Entries:
    kinds = (f"S{width + 1}", bool, np.int64, np.int64, np.int64)
    return tuple(np.frombuffer(row[c], k) for c, k in zip(("digests", "nones", "ids", "uids", "counts"), kinds, strict=True))


def build_runs(rows: DataFrame, width: int, ranges: int, memtable: int = MEMTABLE) -> DataFrame:
    """Level-0 runs of ``rows`` (digest binary of ``width`` bytes, doc_id, uid): memtables flushed as sorted runs with their filters.

    A memtable folds equal digests as they come, so a group of copies, however large, is one entry of each run. A run has the smallest
    uid of its entries as its number.
    """

    def flushed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Entries] = []
        n = 0

        def sent() -> pa.RecordBatch:
            entries = held[0]
            return _pack(int(entries[3].min()), (_heads(entries[0]) >> np.uint64(40)).astype(np.int64) * ranges >> 24, entries)

        for batch in batches:
            if not batch.num_rows:
                continue
            data, ids = batch.column(0).cast(pa.binary()), batch.column(1)
            ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
            keys = np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, width)
            none = ids.is_null().to_numpy(zero_copy_only=False)
            held.append(_fold([(_keys(keys), none, ids.fill_null(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(), np.ones(len(ids), np.int64))]))
            n += len(held[-1][0])
            if n >= memtable:
                held = [_fold(held)]
                n = len(held[0][0])
            if n >= memtable:
                yield sent()
                held, n = [], 0
        if held:
            held = [_fold(held)]
            yield sent()

    return rows.select("digest", F.col("doc_id").cast("long"), "uid").mapInArrow(flushed, RUN)


def merge(rows: list[dict], width: int) -> Entries:
    """One run of several: of each digest the smallest identifier stays, and counts add up. Digests that no other run's filter may hold
    are copied as they are; only the others are merged."""
    runs = [_unpack(r, width) for r in rows]
    alone, shared = [], []
    for i, entries in enumerate(runs):
        heads, hit = _heads(entries[0]), np.zeros(len(entries[0]), dtype=bool)
        for j, r in enumerate(rows):
            if j != i and not hit.all():
                rest = np.flatnonzero(~hit)
                hit[rest] = _maybe(r["filter"], r["n"], heads[rest])
        alone.append(tuple(x[~hit] for x in entries))
        shared.append(tuple(x[hit] for x in entries))
    both = [np.concatenate(x) for x in zip(*alone, _fold(shared), strict=True)]
    order = np.argsort(both[0], kind="stable")
    return tuple(x[order] for x in both)


def compact(runs: DataFrame, width: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merges the runs (a written table) level by level, ``fan_in`` at a time, until each range has one: a table of runs.

    A level is one shuffle of the index. As many levels are gone through as the range with most runs needs.
    """
    while True:
        most = runs.groupBy("range").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        if most <= 1:
            return runs
        last = most <= fan_in

        def merged(table_: pa.Table) -> pa.Table:
            rows = table_.to_pylist()
            entries = merge(rows, width)
            return pa.Table.from_batches([_pack(min(r["run"] for r in rows), np.full(len(entries[0]), rows[0]["range"]), entries)])

        group = F.lit(0) if last else F.pmod(F.xxhash64("run"), F.lit(-(-most // (fan_in // 2 or 1))))
        before, runs = runs, materialise(runs.withColumn("group", group).groupBy("range", "group").applyInArrow(lambda t: merged(t.drop_columns(["group"])), RUN), "lsm-level")
        discard(before)


def entries_of(runs: DataFrame, width: int, least: int = 1) -> DataFrame:
    """(digest, keep_id, keep_uid, group_size) of the entries of ``runs`` that at least ``least`` rows have."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, none, ids, uids, counts = (x[_unpack(row, width)[4] >= least] for x in _unpack(row, width))
                raw = np.ascontiguousarray(keys).view(np.uint8).reshape(len(keys), width + 1)[:, :-1]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in raw], pa.binary()), pa.array(ids, mask=none), pa.array(uids), pa.array(counts)], names=["digest", "keep_id", "keep_uid", "group_size"])

    return runs.mapInArrow(told, "digest binary, keep_id long, keep_uid long, group_size long")


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def deduplicate(docs: DataFrame, digest_bytes: int = 32, memtable: int = MEMTABLE, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after each run of ASCII white space became one space; null counts as empty, so null, "" and nothing but
    them form a group. The row with the smallest doc_id, an integer of any width, stays; a null doc_id comes after all others, and of
    rows that repeat the smallest doc_id one stays.

    Digests and numbers only go through the index. Then the texts that a filter says may have a copy are gathered, each once for a task,
    and compared byte by byte; where texts of a digest differ, its rows are grouped by their whole text instead. ``digest_bytes`` cuts
    the index digest (tests use few bytes, to make digests clash).
    """
    narrow = docs.select("doc_id", F.xxhash64("text").alias("raw"), F.sha2(normalised().cast("binary"), 256).alias("text_sha256"))
    narrow = narrow.withColumn("uid", F.monotonically_increasing_id()).withColumn("digest", F.substring(F.unhex("text_sha256"), 1, digest_bytes))
    narrow = materialise(narrow, "lsm-rows")
    n = narrow.count()
    ranges = max(1, min(-(-n // RANGE_DIGESTS), RANGES), -(-n // MOST_DIGESTS))
    runs = compact(materialise(build_runs(narrow, digest_bytes, ranges, memtable), "lsm-level"), digest_bytes, fan_in)
    hits = materialise(entries_of(runs, digest_bytes, 2), "lsm-hits")
    discard(runs)
    told = narrow.join(beside(hits), "digest", "left")
    raws = materialise(told.where("keep_uid is not null").select("raw").distinct(), "lsm-raws")
    seen = Filter(raws)

    @F.arrow_udf("boolean")
    def may_repeat(raw: pa.Array) -> pa.Array:
        return pa.array(seen.may_hold(raw.to_numpy()))

    bodies = docs.withColumn(raw_ := fresh(docs.columns, "raw")[0], F.xxhash64("text")).where(may_repeat(raw_)).select("doc_id", normalised().alias("body"))
    bodies = bodies.withColumn("digest", F.substring(F.sha2(F.col("body").cast("binary"), 256), 1, 2 * digest_bytes)).withColumn("digest", F.unhex("digest"))
    # one row for each different text
    texts = bodies.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("rows"))
    clashing = materialise(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "lsm-clashing")
    alone = (F.col("keep_uid").isNull()).alias("alone")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    ended = told.select("digest", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.when(alone, True).otherwise(F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256")
    if clashing.isEmpty():
        return ended.select(columns)
    # digests clashed: the rows of such a digest form groups by their text
    odd = materialise(bodies.join(beside(clashing), "digest", "left_semi").withColumn("uid", F.monotonically_increasing_id()), "lsm-odd")
    first = odd.groupBy("digest", "body").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("k"), F.count(F.lit(1)).alias("group_size"))
    odd = odd.join(first, ["digest", "body"]).select("doc_id", F.col("k.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("k.uid")).alias("kept"), F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"))
    return ended.join(beside(clashing), "digest", "left_anti").select(columns).union(odd.select(F.col("doc_id"), F.col("keep_id"), "group_size", "kept", "text_sha256"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""
