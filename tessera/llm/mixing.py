"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import WORD, materialise, numbered, table

#: Epochs: no source is taken more often than this.
MAX_EPOCHS = 3
#: Source weights, repeated in the order of the sources' names.
WEIGHTS = (1, 2, 3)
#: Rows that one bucket of a source holds on average when the last bucket taken is put in order.
BUCKET_ROWS = 20_000


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw_key(doc_id: str = "doc_id", seed: int = 0):
    """A seeded 60-bit number of a document; the order in which fractional repetitions are drawn."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def water_level(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> float | None:
    """The level L at which min(L * weight, max_epochs * size), summed over ``sources`` (size, weight), gives all sizes.

    Starts without caps; sources above their cap are clamped and the excess goes to the others in proportion to weight, until none is
    above. Each round is one aggregation; only two sums come to the driver. None if there is nothing to share.
    """
    total = sources.agg(F.sum("source_size")).first()[0]
    if not total:
        return None
    level = None
    cap = F.col("source_size") * F.lit(max_epochs)
    while True:
        above = F.lit(False) if level is None else F.lit(level) * F.col("weight") > cap
        row = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("capped"), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("open")
        ).first()
        if not row["open"]:
            return level
        found = (total - row["capped"]) / row["open"]
        if found == level:
            return level
        level = found


def targets(narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_docs, weight, target) of ``narrow`` (source, size); sources by code point, null last."""
    sums = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked, _ = numbered(sums.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "sources")
    weighed = ranked.drop("_null").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("row_no") % len(weights) + 1).cast("int")))
    level = water_level(weighed, max_epochs)
    target = F.lit(0.0) if level is None else F.least(F.lit(level) * F.col("weight"), (F.col("source_size") * max_epochs).cast("double"))
    return weighed.withColumn("target", target.cast("double")).drop("row_no")


def plan(narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """How each source is drawn, from ``narrow`` (doc_id, source, size, key): one row per source.

    ``whole`` repetitions of every document, and one more of the documents whose (key, doc_id) is at most ``last``, the longest run in
    that order that fits in the fraction, and of ``fill``, the one document after the run that comes closest to filling the gap left.
    Only the bucket of keys in which the run ends is put in order, so no source, however large, is sorted in one task.
    """
    src = targets(narrow, weights, max_epochs)
    src = src.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    src = materialise(src.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")), "mix-sources")
    n = src.agg(F.coalesce(F.max("n_docs"), F.lit(0))).first()[0]
    bits = min(40, max(8, (n // bucket_rows).bit_length()))
    bucket = F.shiftright("key", 60 - bits).alias("bucket")
    by_source = Window.partitionBy("source")
    fits = (
        narrow.groupBy("source", bucket).agg(F.sum("size").alias("b_size"))
        .withColumn("before", F.sum("b_size").over(by_source.orderBy("bucket")) - F.col("b_size"))
        .join(src.select(F.col("source").alias("s"), "part"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .where("before <= part").groupBy("source").agg(F.max_by(F.struct("bucket", "before", "part"), "bucket").alias("x"))
        .select("source", "x.*")
    )
    fits = materialise(fits, "mix-buckets")
    edge = fits.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "part")
    inside = narrow.withColumn("bucket", bucket).join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    keyed = inside.groupBy("source", "key", "doc_id").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("part").alias("part"))
    run = keyed.withColumn("upto", F.col("before") + F.sum("size").over(by_source.orderBy("key", F.col("doc_id").asc_nulls_first())))
    order = F.struct("key", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("doc_id"))
    last = run.where("upto <= part").groupBy("source").agg(F.max(order).alias("last"), F.max("upto").alias("upto"))
    ends = (
        fits.select("source", "bucket", "before", "part").withColumnRenamed("source", "s")
        .join(last, F.col("s").eqNullSafe(F.col("source")), "left").drop("source")
        .select("s", "part", F.col("bucket").alias("b"), "last", F.coalesce("upto", "before").alias("got"))
    )
    ends = materialise(ends, "mix-ends")
    # where no document of the edge bucket fits, every key of the buckets before it does
    after = F.when(F.col("last").isNull(), F.shiftright("key", 60 - bits) >= F.col("b")).otherwise(order > F.col("last"))
    gap = F.col("part") - F.col("got")
    rest = narrow.groupBy("source", "key", "doc_id").agg(F.sum("size").alias("size"))
    near = (
        rest.join(ends, F.col("source").eqNullSafe(F.col("s"))).where(after & (F.col("size") > 0) & (F.abs(F.col("size") - gap) < gap))
        .groupBy("s").agg(F.min(F.struct(F.abs(F.col("size") - gap).alias("off"), "key", order["doc_id"].alias("doc_id"))).alias("f"))
        .select(F.col("s").alias("fs"), F.struct("f.key", "f.doc_id").alias("fill"))
    )
    drawn = ends.join(near, F.col("s").eqNullSafe(F.col("fs")), "left").drop("fs", "part", "got")
    drawn = drawn.withColumn("last", F.coalesce("last", F.struct((F.shiftleft(F.col("b"), 60 - bits) - 1).alias("key"), F.lit((1 << 63) - 1).alias("doc_id"))))
    return materialise(src.join(drawn, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "b", "n_docs"), "mix-plan")


def with_copies(keyed: DataFrame, drawn: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``keyed`` (source, doc_id, key and any more columns) with its source's plan and ``copies``, how often the mix takes it: never more
    than ``max_epochs`` times, a row without words included."""
    order = F.struct("key", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("doc_id"))
    more = (F.coalesce(order <= F.col("_last"), F.lit(False)) | F.coalesce(order == F.col("_fill"), F.lit(False))).cast("long")
    src = drawn.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("whole").alias("_whole"), F.col("last").alias("_last"), F.col("fill").alias("_fill"))
    return keyed.join(src, F.col("source").eqNullSafe(F.col("_s"))).withColumn("copies", F.least(F.col("_whole") + more, F.lit(max_epochs).cast("long")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """The mixed corpus: each row of ``docs`` (doc_id, source, text) as often as the mix takes it, with its own columns.

    The text is read twice and never shuffled unless the table of sources is too large to broadcast. A null source is a source of its
    own, last in order; null and empty texts have size 0 and are taken like others,
    by their place in the order, and a source without words once. Rows that repeat a doc_id within
    a source are taken alike. An empty table gives an empty one. Columns of any other name pass through.
    """
    narrow = materialise(docs.select("doc_id", "source", word_count().alias("size"), draw_key(seed=seed).alias("key")), "mix-narrow")
    drawn = plan(narrow, weights, max_epochs)
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], "doc_id", "source").withColumn("key", draw_key(seed=seed))
    out = with_copies(held, drawn, max_epochs).where("copies > 0").withColumn("_rep", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = materialise(docs.select("doc_id", "source", word_count().alias("size"), draw_key().alias("key")), "mix-narrow")
    out = with_copies(narrow, plan(narrow))
    return out.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('0:' || doc_id::VARCHAR), 1, 15))::BIGINT AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
lv AS (
  SELECT 0 AS i, (SELECT sum(source_size) FROM s)::DOUBLE / (SELECT sum(weight) FROM s) AS l
  UNION ALL
  SELECT i + 1, ((SELECT sum(source_size) FROM s) - (SELECT coalesce(sum(3 * source_size), 0) FROM s WHERE lv.l * weight > 3 * source_size))::DOUBLE
               / (SELECT sum(weight) FROM s WHERE NOT (lv.l * weight > 3 * source_size))
  FROM lv WHERE i < 60),
t AS (
  SELECT *, least((SELECT l FROM lv ORDER BY i DESC LIMIT 1) * weight, (3 * source_size)::DOUBLE) AS target FROM s),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
p AS (SELECT *, target - whole * source_size AS part FROM w),
r AS (
  SELECT d.doc_id, d.size, d.k, p.source, p.source_size, p.target, p.whole, p.part,
         sum(d.size) OVER (PARTITION BY p.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
g AS (SELECT source, coalesce(max(CASE WHEN upto <= part THEN upto END), 0) AS got FROM r GROUP BY source),
x AS (SELECT r.*, part - got AS gap, got FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source),
y AS (
  SELECT *, row_number() OVER (PARTITION BY source, upto > part AND size > 0 AND abs(size - gap) < gap ORDER BY abs(size - gap), k, doc_id) AS n FROM x)
SELECT doc_id, size, source_size, target,
       (whole + CASE WHEN upto <= part OR (size > 0 AND abs(size - gap) < gap AND n = 1) THEN 1 ELSE 0 END) * size AS taken
FROM y
"""
