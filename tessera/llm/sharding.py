"""Reproducible shuffling into shards: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh, numbered, table, utf8

ROUNDS = 6
MASK = (1 << 31) - 1


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [int(k) for k in np.random.Generator(np.random.Philox(seed)).integers(1, MASK, rounds)]


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = ((x + key) & MASK) * 0x2C1B3C6D & MASK
    x = (x ^ (x >> 15)) * 0x297A2D39 & MASK
    return (x ^ (x >> 13)) * 0x5BD1E995 & MASK ^ (x >> 9)


def permute(row_no: np.ndarray, n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """The place of each row number in a fixed random order of 0 to n - 1 (or, inverted, the row number at each place).

    A balanced Feistel network permutes the least 4^h at or above n; numbers that land at or above n walk on along their cycle until
    they fall below it. Fewer than four steps are needed on average, and only numbers still outside take the next one.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, keys = (1 << half) - 1, round_keys(seed)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & low
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, k) & low), left
            else:
                left, right = right, left ^ (_mix(right, k) & low)
        return left << half | right

    out = once(np.asarray(row_no, dtype=np.int64))
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = once(out[far])
    return out


def shard(rows: DataFrame, order: list[str], shards: int = 16, seed: int = 0) -> DataFrame:
    """``rows`` with row_no (by ``order``), place, shard and slot as last columns; where ``rows`` has such a name, the new one has
    underscores in front.

    place = permutation(row_no), shard = place mod shards, slot = place div shards: anyone who knows n and the seed can compute where a
    row lies, and which row lies anywhere, without a table. Shard sizes differ by one row at most and slots have no gaps.
    Pass narrow rows: they are sorted by range once and written to the shared folder. Nulls in ``order`` come first; rows that tie in
    all columns get consecutive numbers; an empty table stays empty.
    """
    plain = [f"c{k}" for k in range(len(rows.columns))]
    counted, n = numbered(rows.toDF(*plain), [plain[rows.columns.index(c)] for c in order], "sharding")

    @F.pandas_udf(T.LongType())
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    put = counted.select(*plain, "row_no", place("row_no").alias("place"))
    put = put.withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("slot", F.floor(F.col("place") / shards).cast("long"))
    return put.toDF(*rows.columns, *fresh(rows.columns, "row_no", "place", "shard", "slot"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law ``rows``; a null text has the CRC of no bytes."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(utf8("text")).alias("text_crc32"))
    put = shard(rows, ["doc_id", "text_crc32", "size"])
    return put.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
