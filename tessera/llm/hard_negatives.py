"""Hard negatives by K-means inverted lists: the best rows of other labels whose score lies in a window below a positive's.

Exact: a list's centroid and radius bound every score in it (Cauchy-Schwarz: q.x <= q.c + |q| r), so an anchor leaves out only lists that
can't matter: those outside all its windows, and those whose bound is strictly below the worst score it holds already.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import beside, discard, materialise, table

#: Components are floor(256 x); those beyond 2 ** 24 either way are held there, so that scores fit a long.
SCALE, MOST = 256, 1 << 24
#: Every so many ids a label is moved on by one, among so many labels; every so many ids a row is an anchor.
MOVED, LABELS, ANCHORS = 7, 10, 50
#: Positives of an anchor, negatives of a positive, and the window of a negative's score in percent of the positive's.
POSITIVES, NEGATIVES, WINDOW = 5, 3, (50, 95)
#: Lists have some so many rows; there are from 8 to so many of them. Centroids are fitted on so many rows at most, in so many rounds.
LIST_ROWS, MOST_LISTS, SAMPLE_ROWS, FIT_ROUNDS = 512, 1024, 20_000, 8
#: Rows of a list, and anchors, that meet in one task's group; longer lists and more anchors are cut by hash.
CHUNK_ROWS, SLICE_ANCHORS, AT_ONCE = 8192, 4096, 256
#: An anchor visits its lists in order of their bounds: up to these ranks, then as many more as are left, with its worst score known anew.
VISITS = (2, 16)

LOWEST, HIGHEST = -(1 << 62), 1 << 62
SEEKING = "row long, vec_id long, label long, v binary, low array<long>, high array<long>"
HITS = "row long, slot int, found long, score long"


def prepared(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, v): the rows that take part, with whole components, and labels as the contract moves them."""
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != math.inf))
    whole = F.transform(x, lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(SCALE * c.cast("double")))).cast("int"))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % MOVED == 0, (label + 1) % LABELS).otherwise(label)
    kept = vectors.where(label.isNotNull() & x.isNotNull() & sound)
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), whole.alias("v"))


def padded(lists: list[list[int]], dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim), np.int32)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The first of the nearest centres of each row, a few rows at a time."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *[(half - x[i : i + 2048] @ centres.T).argmin(1) for i in range(0, len(x), 2048)]])


def fit(sample: np.ndarray, k: int, rounds: int = FIT_ROUNDS, seed: int = 0) -> np.ndarray:
    """At most ``k`` centres of the sample's rows: Lloyd's rounds from distinct rows; a centre that no row is nearest to stays where it is."""
    distinct = np.unique(sample, axis=0).astype(float)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    x = sample.astype(float)
    for _ in range(rounds):
        at = nearest(x, centres)
        size = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def listed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Each row with the list it is in, its distance from that list's centroid, and its components as 4-byte numbers."""
    dim = centres.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = padded(b.column("v").to_pylist(), dim)
            at = nearest(x.astype(float), centres)
            away = np.sqrt(((x - centres[at]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column("row"), b.column("vec_id"), b.column("label"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(away)], ["list", "row", "vec_id", "label", "v", "away"])

    return rows.mapInArrow(assign, "list int, row long, vec_id long, label long, v binary, away double")


def vectors_of(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dim)


def visits(seeking: DataFrame, centres: np.ndarray, radii: np.ndarray, first: int, last: int) -> DataFrame:
    """A row for each anchor and each list, of those from rank ``first`` to ``last`` by upper bound, that may hold something for it.

    ``low`` and ``high`` are an anchor's windows: the scores between which a row is still of use to it.
    """
    dim = centres.shape[1]
    size = np.sqrt((centres**2).sum(1))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                b = batch.slice(i, 1024)
                q = vectors_of(b.column("v"), dim).astype(float)
                norm = np.sqrt((q**2).sum(1))[:, None]
                middle, spread = q @ centres.T, norm * radii
                slack = 1e-9 * (norm * size + spread) + 1e-6  # rounding never hides a row
                upper, lower = middle + spread + slack, middle - spread - slack
                use = np.zeros(upper.shape, bool)
                for j, (low, high) in enumerate(zip(b.column("low").to_pylist(), b.column("high").to_pylist(), strict=True)):
                    for lo, hi in zip(low, high, strict=True):
                        use[j] |= (upper[j] >= lo) & (lower[j] <= hi)
                rank = np.empty(upper.shape, np.int64)
                np.put_along_axis(rank, np.argsort(-upper, axis=1, kind="stable"), np.arange(len(centres))[None, :], 1)
                who, where = np.nonzero(use & (rank >= first) & (rank < last))
                out = b.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(where.astype(np.int32))], [*out.schema.names, "list"])

    return seeking.mapInArrow(route, f"{SEEKING}, list int")


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, exact: in doubles where sums stay below 2 ** 53, else in longs."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return q.astype(np.int64) @ x.T.astype(np.int64)


def best(anchors: pa.Table, rows: pa.Table, dim: int, same: bool, k: int) -> pa.Table:
    """The first ``k`` rows in each window of each anchor: by score, ties by smaller vec_id, rows without one last."""
    rows = rows.sort_by([("vec_id", "ascending")])  # nulls are last
    x, label, number, ids = vectors_of(rows["v"], dim), rows["label"].to_numpy(), rows["row"].to_numpy(), rows["vec_id"].combine_chunks()
    who, slot, at, value = [], [], [], []
    for i in range(0, anchors.num_rows if rows.num_rows else 0, AT_ONCE):
        part = anchors.slice(i, AT_ONCE)
        s = scores(vectors_of(part["v"], dim), x)
        fits = (part["label"].to_numpy()[:, None] == label) == same
        fits &= part["row"].to_numpy()[:, None] != number
        low, high = part["low"].to_pylist(), part["high"].to_pylist()
        for w in range(max(map(len, low))):
            lo = np.array([y[w] if w < len(y) else HIGHEST for y in low])[:, None]
            hi = np.array([y[w] if w < len(y) else LOWEST for y in high])[:, None]
            held = np.where(fits & (s >= lo) & (s <= hi), s, LOWEST)
            for _ in range(min(k, held.shape[1])):
                top = held.argmax(1)  # the first of the largest
                found = held[np.arange(len(top)), top]
                there = np.flatnonzero(found > LOWEST)
                if not len(there):
                    break
                who.append(part["row"].to_numpy()[there])
                slot.append(np.full(len(there), w, np.int32))
                at.append(top[there])
                value.append(found[there])
                held[there, top[there]] = LOWEST
    flat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    return pa.table({"row": flat(who, np.int64), "slot": flat(slot, np.int32), "found": ids.take(pa.array(flat(at, np.int64))), "score": flat(value, np.int64)})


def narrowed(seeking: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Windows from the worst score up where an anchor holds ``k`` hits already; a row that ties with it is still of use."""
    full = hits.groupBy("row", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")).where(F.col("n") == k)
    known = full.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "worst"))).alias("worst"))  # a window's number to its worst score
    raised = F.transform("low", lambda lo, i: F.coalesce(F.greatest(lo, F.col("worst")[i]), lo))
    return seeking.join(known, "row", "left").withColumn("low", F.when(F.col("worst").isNull(), F.col("low")).otherwise(raised)).drop("worst")


def search(seeking: DataFrame, lists: DataFrame, index: tuple[np.ndarray, np.ndarray, list[int]], same: bool, k: int, anchors: int) -> DataFrame:
    """(row, slot, found, score, rank): the first ``k`` rows of ``lists`` with the same label, or another, in each window of each anchor.

    ``index``: centroids, radii, and into how many chunks each list is cut. Chunks of a list meet slices of the anchors that visit it, so
    a group holds some CHUNK_ROWS rows and SLICE_ANCHORS anchors, whatever the list, the label or the number of copies.
    """
    centres, radii, chunks = index
    dim, slices, hits = centres.shape[1], max(1, -(-anchors // SLICE_ANCHORS)), None
    cut = lambda parts: F.pmod(F.xxhash64("row"), parts).cast("int")
    parts = F.element_at(F.lit(chunks), F.col("list") + 1)
    first_k = F.row_number().over(Window.partitionBy("row", "slot").orderBy(F.desc("score"), F.asc_nulls_last("found")))
    ends = [e for e in VISITS if e < len(centres)] + [len(centres)]
    for first, last in zip([0, *ends], ends):
        useful = seeking if hits is None else narrowed(seeking, hits, k)
        asked = materialise(visits(useful, centres, radii, first, last).withColumn("slice", cut(F.lit(slices))), "negatives-visits")
        wanted = materialise(asked.select("list", "slice").distinct(), "negatives-lists")  # a row for each list and slice at most
        met = lists.join(beside(wanted), "list").withColumn("chunk", cut(parts))
        keys = ["list", "slice", "chunk"]
        left = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), parts - 1)))
        new = left.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(lambda a, b: best(a, b, dim, same, k), HITS)
        all_hits = new if hits is None else new.unionByName(hits.select(*new.columns))
        before, hits = hits, materialise(all_hits.withColumn("rank", first_k).where(F.col("rank") <= k), "negatives-hits")
        discard(asked, wanted, *([] if before is None else [before]))
    return hits


def percent(part: int, score: str, rounding: int) -> Column:
    """``part`` percent of a ``score`` of 0 or more, plus ``rounding`` hundredths, cut to a whole number without leaving whole numbers."""
    return F.expr(f"{part} * ({score} div 100) + ({part} * ({score} % 100) + {rounding}) div 100")


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(vectors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``vectors`` (vec_id, embedding, label).

    Rows with a null label, a null vector or a component that is null or not finite take no part; vectors of different length are filled up
    with zeros. Rows that share a vec_id are rows of their own: each can be the other's positive, and each anchor among them has its
    results. A row without vec_id is no anchor, and last among ties. Without anchors, or positives, or rows in a window there is nothing
    to return. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = materialise(prepared(vectors), "negatives-rows")
    is_anchor = F.col("vec_id") % ANCHORS == 0
    n, dim, anchors = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count(F.when(is_anchor, 1))).first()
    if not anchors:
        return spark.createDataFrame([], RESULT)
    dim = max(dim, 1)
    k = max(8, min(MOST_LISTS, -(-n // LIST_ROWS)))
    drawn = rows.where(F.pmod(F.xxhash64("row", "vec_id"), F.lit(n)) < SAMPLE_ROWS).select("v")
    sample = padded([r["v"] for r in drawn.collect()], dim)  # some SAMPLE_ROWS rows
    centres = fit(sample, k)
    lists = materialise(listed(rows, centres), "negatives-lists")
    discard(rows)
    radii, chunks = np.zeros(len(centres)), [1] * len(centres)
    for r in lists.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect():  # a row for each list
        radii[r["list"]], chunks[r["list"]] = r["radius"], -(-r["n"] // CHUNK_ROWS)
    index = (centres, radii, chunks)
    lists = lists.drop("away")
    asking = lists.where(is_anchor).drop("list")
    whole = asking.withColumn("low", F.array(F.lit(LOWEST + 1))).withColumn("high", F.array(F.lit(HIGHEST)))
    near = search(whole, lists, index, True, POSITIVES, anchors)
    at = {"slot": F.col("rank") - 1, "low": percent(WINDOW[0], "score", 99), "high": percent(WINDOW[1], "score", 0)}
    open_ = near.where("score >= 0").select("row", F.col("found").alias("positive_id"), F.col("score").alias("positive_score"), *[c.alias(k) for k, c in at.items()])  # below 0 a window is empty
    each = open_.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("slot", "low", "high"))).alias("w"))  # POSITIVES at most
    bounds = asking.join(each, "row").withColumn("low", F.col("w.low")).withColumn("high", F.col("w.high")).drop("w")
    far = search(bounds.select("row", "vec_id", "label", "v", "low", "high"), lists, index, False, NEGATIVES, anchors)
    ids = asking.select("row", F.col("vec_id").alias("anchor_id"))
    found = far.select("row", "slot", "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(open_, ["row", "slot"]).join(ids, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other)::INT AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
