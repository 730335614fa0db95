"""How quality filters interact: every order of five filters, told from a histogram of which filters each document fails."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import SPACE, table

#: The filters' letters; letter k is bit k of a mask. E, the repeat of an earlier text, is last: it is no property of a text alone.
LETTERS = "ABCDE"
#: Filter A fails texts of fewer words, B those with a smaller share of distinct words, C those with a larger share of capitals, both in percent.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
BLANKS = " \t\n\x0b\f\r"
SIGNS = r"[#$%&*|]"
#: What is counted of each mask.
COUNTS = ("n", "good", "toxic")


def failures(text: Column) -> Column:
    """Bits of the filters A to D that ``text`` fails."""
    inner = F.btrim(text, F.lit(BLANKS))
    words = F.split(inner, SPACE)
    n = F.size(words) - (inner == "").cast("int")  # of no words the split is one empty string
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = (n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(SIGNS))
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(failed)), F.lit(0))


def judged(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, part, mask, n, good, toxic) of rows with a doc_id, equal ones together, and (part, mask, n, good, toxic) of those
    without. Masks have bits A to D; good and toxic are n where the document's labels say so, else 0.

    Only these narrow rows are shuffled. Rows without doc_id, which no label knows and no order, are added up by part and mask before
    they would meet in one partition; the scan for them skips row groups that have none.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), failures(text).alias("mask"))
    named, nameless = rows.where("doc_id IS NOT NULL"), rows.where("doc_id IS NULL")
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    met = named.join(said, F.col("doc_id") == F.col("of"), "left").groupBy("doc_id", "digest", "part", "mask")
    zero = F.lit(0).cast("long")
    together = met.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("q"), zero).alias("good"), F.coalesce(F.sum("t"), zero).alias("toxic"))
    alone = nameless.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), zero.alias("good"), zero.alias("toxic"))
    return together, alone


def histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): at most 32 rows a part, bit E included.

    Copies of a text are added up in each task before they are shuffled, by text, part and mask; the row with the smallest doc_id goes
    along, since it alone passes E. So a text that a third of all rows share is a few rows a task.
    """
    named, nameless = judged(docs, labels)
    cells = named.groupBy("digest", "part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS], F.min(F.struct("doc_id", *COUNTS)).alias("first"))
    one = cells.withColumn("is_first", F.col("first.doc_id") == F.min("first.doc_id").over(Window.partitionBy("digest")))
    kept = lambda c: F.when(F.col("is_first"), F.col(f"first.{c}")).otherwise(0)
    split = one.select("part", F.inline(F.array(
        F.struct(F.col("mask"), *[kept(c).alias(c) for c in COUNTS]),
        F.struct((F.col("mask") + 16).alias("mask"), *[(F.col(c) - kept(c)).alias(c) for c in COUNTS]),
    )))
    whole = split.unionByName(nameless)
    return whole.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS])


def mask_of(letters: Column) -> Column:
    """Bits of the filters that ``letters`` name."""
    return sum(((F.instr(letters, x) > 0).cast("int") * (1 << k) for k, x in enumerate(LETTERS)), F.lit(0))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (language; '' for null), filter_order (all 120) and step (1 to 5): kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley, as counts of documents.

    ``docs`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic; other columns are not read. A null text is an empty one. Rows
    that share a doc_id are each a document; equal texts under the same doc_id are not earlier than each other. A row without doc_id is
    earlier or later than none and has no labels. A document with several labels is good, or toxic, if one of them says so. Of no
    documents there are no parts, hence no rows.
    """
    cells = histogram(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))  # 32 at most
    orders = F.lit([("".join(p)) for p in permutations(LETTERS)])
    steps = cells.select("part", "cells", F.explode(orders).alias("filter_order")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    steps = steps.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    steps = steps.select("*", mask_of(F.col("letter")).alias("bit"), mask_of(F.substring("filter_order", F.lit(1), F.col("step") - 1)).alias("earlier"))

    def counted(c: str, chosen) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, x: s + F.when(chosen(x["mask"]), x[c]).otherwise(0))

    bit, earlier = F.col("bit"), F.col("earlier")
    fails, gone = (lambda m: m.bitwiseAND(bit) != 0), (lambda m: m.bitwiseAND(earlier) != 0)
    here = lambda m: fails(m) & ~gone(m)
    out = steps.select(
        "part", "filter_order", "step", "letter",
        counted("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        counted("n", here).alias("removed"),
        counted("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        counted("n", lambda m: m == bit).alias("unique_fails"),
        counted("good", here).alias("good_lost"),
        counted("toxic", here).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (doc_id > first)::INT AS mask
  FROM w LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
  WHERE a.c <> b.c AND a.c <> c.c AND a.c <> d.c AND a.c <> e.c AND b.c <> c.c AND b.c <> d.c AND b.c <> e.c AND c.c <> d.c AND c.c <> e.c AND d.c <> e.c),
s AS (
  SELECT filter_order, step::INT AS step, filter_order[step] AS letter, 1 << (ascii(filter_order[step]) - 65) AS bit,
    list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65)))::INT AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
r AS (
  SELECT part, filter_order, step, letter, coalesce(before, 0) AS before, bit,
    sum(CASE WHEN mask & (bit | coalesce(before, 0)) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM h, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM r
"""
