"""What the corpus operators share: tables, shared storage, global numbers and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which separates words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A written table of narrow rows is broadcast up to so many of them, some 10 MB.
BROADCAST_ROWS = 200_000
#: Rows, and bytes, that a Python worker gets at once; long texts fill a batch before it has all its rows.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted`` names, each with as many underscores in front as make it differ from those ``taken`` (in any case) and each other."""
    known, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in known:
            name = f"_{name}"
        known.add(name.lower())
        out.append(name)
    return out


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Has ``values`` hold in the session for a while, and puts back what was there."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def batch_settings(spark: SparkSession) -> dict[str, str]:
    """What has whole texts go to Python in batches of at most BATCH_ROWS rows and some BATCH_BYTES bytes; smaller plain numbers stay."""
    out = {}
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            out[key] = str(most)
    return out


def small_batches(spark: SparkSession) -> None:
    """Sets ``batch_settings`` in the session and leaves them: for frames whose Python runs after the operator has returned."""
    for k, v in batch_settings(spark).items():
        spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's checkpoint folder, or one made here if none is set and all run in one
    process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


#: Where each written table lies.
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: lineage ends here, and a lost executor costs no recomputation.

    The shuffles behind it are not needed any more and go at once. Python gets whole texts in small batches meanwhile.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with settings(spark, batch_settings(spark) | {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``materialise`` that nothing reads any more."""
    for df in tables:
        if path := _written.pop(df, None):
            _delete(df.sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Removes every intermediate table of this application. Call it when all results have been written: they read from these tables."""
    _delete(spark, _own_dir(spark))


def beside(df: DataFrame) -> DataFrame:
    """``df``, a written table of narrow rows with each key once, for a join: broadcast if its count allows, else by sort and merge, where
    Spark splits a hot key of the other side."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def utf8(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def numbered(df: DataFrame, order: list[str], tag: str = "numbered") -> tuple[DataFrame, int]:
    """Adds ``row_no``, 0 to n - 1 in the order of ``order``, without a window over all rows; returns the frame and n.

    The rows are dealt by range, sorted inside each partition and written with their place there. Each partition's start is a running
    sum over one row per partition, so what is broadcast is bounded by the number of partitions. Rows that tie in every column are
    interchangeable; they are spread by their place in the input, so that many equal rows don't meet in one partition. ``df`` has no
    column ``row_no``.
    """
    spark = df.sparkSession
    tie, at, part_, n_, start = fresh(df.columns, "_tie", "_at", "_part", "_n", "_start")
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in order]
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys, F.col(tie)).sortWithinPartitions(*keys, tie).drop(tie)
    placed = materialise(dealt.withColumn(at, F.monotonically_increasing_id()), tag)
    part, place = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias(part_)).agg(F.count(F.lit(1)).alias(n_)).collect()  # a row for each partition
    starts, n = [], 0
    for p, size in sorted((r[part_], r[n_]) for r in sizes):
        starts.append((p, n))
        n += size
    offsets = spark.createDataFrame(starts, f"{part_} long, {start} long")
    out = placed.withColumn(part_, part).join(F.broadcast(offsets), part_)
    return out.withColumn("row_no", F.col(start) + place).drop(part_, start, at), n


def edge_state(u: str, v: str) -> list[Column]:
    """Aggregates that tell one set of edges from another, whatever their number: a count and an exclusive or can't overflow."""
    return [F.count(F.lit(1)), F.bit_xor(F.xxhash64(u, v)), F.bit_xor(F.xxhash64(v, u, F.lit(1)))]


def components(edges: DataFrame, nodes_tag: str = "components", max_rounds: int = 40) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b long): (node, root), root being the smallest node of the component.

    Alternating large-star and small-star rounds; each is two grouped aggregations over narrow rows. Neighbour lists are not collected:
    a star needs the minimum of a node's neighbours only, joined back to the edges. Up to BROADCAST_ROWS edges these minima are broadcast;
    beyond, they are written and joined by sort and merge, so that Spark splits a star's centre. Rounds stop when the edge set no longer
    changes; a round's tables go when the next has been written.
    """
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), nodes_tag)
    now = tuple(e.agg(*edge_state("u", "v")).first())
    for _ in range(max_rounds):
        small = now[0] <= BROADCAST_ROWS
        kept: list[DataFrame] = [] if small else [e]

        def written(df: DataFrame) -> DataFrame:
            if not small:
                kept.append(df := materialise(df, nodes_tag))
            return df

        minima = lambda df: F.broadcast(df) if small else written(df).hint("merge")
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = minima(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = minima(large.groupBy("u").agg(F.min("v").alias("m")))
        star = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        before, e = e, materialise(star, nodes_tag)
        discard(before, *kept)
        seen, now = now, tuple(e.agg(*edge_state("u", "v")).first())
        if now == seen:
            break
    else:
        raise RuntimeError("components: the rounds ran out before the edges settled")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = materialise(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()), nodes_tag)
    discard(e)
    return out
