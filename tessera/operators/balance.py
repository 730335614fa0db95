"""Worker scores, assignment strategies and expert placement.

Scores and one-shot choices are column expressions and aggregates over a table of workers (worker_id, score, queue, assigned, healthy).
Assigning shard after shard depends on what was assigned before; that is a fold over the shards in one group, on worker-sized state.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Base scores of backends, weights of the score's parts, seconds until a silent worker counts as gone, smoothing.
BASE_SCORE = {"dense": 0.5, "mmap": 0.3, "cuda": 0.8, "opengl": 0.6, "opencl": 0.7}
OPS_WEIGHT, MEMORY_WEIGHT, OPS_SCALE = 0.3, 0.3, 1000.0
QUEUE_WEIGHT, QUEUE_SCALE, BUSY_WEIGHT = 0.2, 100.0, 0.2
TIMEOUT_S, ALPHA = 30, 0.3
GONE = ("FAILED", "OFFLINE")


def capacity_score(backend: Column, ops: Column, available: Column, total: Column, queue: Column, busy: Column) -> Column:
    """0 to 1: the backend's base, by throughput and free memory, less for queued work and use."""
    base = F.create_map(*[F.lit(x) for kv in BASE_SCORE.items() for x in kv])[backend]
    part = OPS_WEIGHT * F.least(F.lit(1.0), ops / OPS_SCALE) + MEMORY_WEIGHT * (available / total)
    score = base * part * (1.0 - QUEUE_WEIGHT * F.least(F.lit(1.0), queue / QUEUE_SCALE)) * (1.0 - BUSY_WEIGHT * busy)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def alive(status: Column, last_seen: Column, now: Column, timeout_s: float = TIMEOUT_S) -> Column:
    return ~status.isin(*GONE) & (now - last_seen < timeout_s)


def by_capacity(workers: DataFrame) -> DataFrame:
    """The healthy worker with the largest score, the first of several."""
    return workers.where("healthy").agg(F.max_by("worker_id", F.struct("score", -F.col("worker_id"))).alias("worker_id"))


def by_connections(workers: DataFrame) -> DataFrame:
    load = 0.6 * F.col("queue") + 0.4 * F.col("assigned")
    return workers.where("healthy").agg(F.min_by("worker_id", F.struct(load, "worker_id")).alias("worker_id"))


def by_turn(shards: DataFrame, workers: DataFrame, shard: str = "shard_id") -> DataFrame:
    """(shard_id, worker_id): shards, numbered from 0, over the healthy workers in turn. The workers are a table of known small size."""
    healthy = workers.where("healthy").select("worker_id", (F.row_number().over(Window.orderBy("worker_id")) - 1).alias("_n"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_of"))
    of = healthy.agg(F.max("_of").alias("_of"))
    return shards.crossJoin(F.broadcast(of)).withColumn("_n", F.pmod(F.col(shard), F.col("_of")).cast("int")).join(F.broadcast(healthy.drop("_of")), "_n").select(shard, "worker_id")


def shard_number(shard: str = "shard_id", seed: int = 0) -> Column:
    """A 60-bit number of a shard, from a digest of its name."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(shard).cast("string"))), 1, 15), 16, 10).cast("long")


def by_hash(shards: DataFrame, workers: DataFrame, shard: str = "shard_id") -> DataFrame:
    """(shard_id, worker_id): a healthy worker by the shard's number."""
    listed = workers.where("healthy").agg(F.array_sort(F.collect_list("worker_id")).alias("_w"))  # workers are few
    return shards.crossJoin(F.broadcast(listed)).select(shard, F.element_at("_w", F.pmod(shard_number(shard), F.size("_w")).cast("int") + 1).alias("worker_id"))


def by_two_choices(shards: DataFrame, workers: DataFrame, seed: int = 42, shard: str = "shard_id") -> DataFrame:
    """Of two different healthy workers that the shard's numbers name, the one with less load for its score."""
    norm = F.when(F.col("score") > 0, (F.col("queue") + F.col("assigned")) / F.col("score")).otherwise(F.col("queue") + F.col("assigned"))
    listed = workers.where("healthy").agg(F.array_sort(F.collect_list(F.struct("worker_id", norm.alias("load")))).alias("w"))  # workers are few
    n = F.size("w")
    first = F.pmod(shard_number(shard, seed), n).cast("int")
    second = F.when(n > 1, F.pmod(first + 1 + F.pmod(shard_number(shard, seed + 1), F.greatest(n - 1, F.lit(1))).cast("int"), n)).otherwise(first)
    a, b = F.element_at("w", first + 1), F.element_at("w", second + 1)
    return shards.crossJoin(F.broadcast(listed)).select(shard, F.when(a["load"] <= b["load"], a["worker_id"]).otherwise(b["worker_id"]).alias("worker_id"))


def by_prediction(workers: DataFrame, predicted: DataFrame) -> DataFrame:
    """The least (predicted load + assigned) for the score; ``predicted`` is (worker_id, load)."""
    load = F.coalesce("load", F.lit(0.0)) + F.col("assigned")
    norm = F.when(F.col("score") > 0, load / F.col("score")).otherwise(load)
    return workers.where("healthy").join(predicted, "worker_id", "left").agg(F.min_by("worker_id", F.struct(norm, "worker_id")).alias("worker_id"))


def by_fairness(workers: DataFrame) -> DataFrame:
    """The worker whose taking one more shard leaves the largest load for the score least.

    The largest load of the others is the largest of all, or the second if it is the worker's own; so two values do for all pairs.
    """
    w = workers.where("healthy").withColumn("load", (F.col("queue") + F.col("assigned")) / F.col("score"))
    tops = w.agg(F.max_by("worker_id", F.struct("load", "worker_id")).alias("_top"), F.slice(F.reverse(F.array_sort(F.collect_list("load"))), 1, 2).alias("_t"))
    others = F.when(F.col("worker_id") == F.col("_top"), F.get("_t", F.lit(1))).otherwise(F.get("_t", F.lit(0)))
    worst = F.greatest((F.col("queue") + F.col("assigned") + 1) / F.col("score"), others)
    return w.crossJoin(F.broadcast(tops)).agg(F.min_by("worker_id", F.struct(worst, "worker_id")).alias("worker_id"))


def smoothed_load(beats: DataFrame, alpha: float = ALPHA, slices: int = 256) -> DataFrame:
    """(worker_id, load): queue plus 100 times the missing score, smoothed over each worker's beats (worker_id, at, queue, score) in time;
    a value of 0 starts anew.

    Time is cut into slices. A slice turns the load before it into ``keep`` times that plus ``add``, or into ``anew`` if it was 0: loads
    aren't negative, so one above 0 stays above. So only what slices do is brought together for each worker.
    """
    now = F.col("queue") + (1.0 - F.col("score")) * 100.0
    ends = beats.agg(F.min("at").alias("_low"), F.max("at").alias("_high"))
    width = F.greatest(F.ceil((F.col("_high") - F.col("_low") + 1) / slices), F.lit(1))
    cut = beats.crossJoin(F.broadcast(ends)).withColumn("slice", F.floor((F.col("at") - F.col("_low")) / width))
    xs = cut.groupBy("worker_id", "slice").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", now.alias("x")))), lambda s: s["x"]).alias("xs"))
    blend = lambda p, x: alpha * x + (1 - alpha) * p
    done = xs.select(
        "worker_id", "slice", F.pow(F.lit(1 - alpha), F.size("xs")).alias("keep"), F.aggregate("xs", F.lit(0.0), blend).alias("add"),
        F.aggregate("xs", F.lit(0.0), lambda p, x: F.when(p == 0, x).otherwise(blend(p, x))).alias("anew"),
    )
    by_time = done.groupBy("worker_id").agg(F.array_sort(F.collect_list(F.struct("slice", "keep", "add", "anew"))).alias("s"))
    return by_time.select("worker_id", F.aggregate("s", F.lit(0.0), lambda p, s: F.when(p == 0, s["anew"]).otherwise(s["keep"] * p + s["add"])).alias("load"))


Strategy = Callable[[pd.DataFrame, int], int]


def _least(load: Callable[[pd.DataFrame], pd.Series]) -> Strategy:
    return lambda w, shard: int(w["worker_id"].iloc[int(load(w).to_numpy().argmin())])


#: Strategies for assigning shard after shard: from the healthy workers, in order, and the shard, to a worker. Callers may add their own.
STRATEGIES: dict[str, Strategy] = {
    "capacity": _least(lambda w: -w["score"]),
    "connections": _least(lambda w: 0.6 * w["queue"] + 0.4 * w["assigned"]),
    "turn": lambda w, shard: int(w["worker_id"].iloc[int(w["assigned"].sum()) % len(w)]),
    "hash": lambda w, shard: int(w["worker_id"].iloc[(shard * 0x9E3779B1 & 0xFFFFFFFF) * len(w) >> 32]),
    "prediction": _least(lambda w: (w.get("load", 0.0) + w["assigned"]) / w["score"].where(w["score"] > 0, 1.0)),
}


def assign(requests: DataFrame, workers: DataFrame, strategy: str | Strategy = "connections") -> DataFrame:
    """(at, shard_id, worker_id) for ``requests`` (at, shard_id, failed): a shard stays with its worker until that one has failed.

    ``failed`` names a worker that fails just before the request, or is null. The state is one row for each worker and shard asked for;
    requests are control events, a few for each shard, and are folded in order of ``at``.
    """
    choose = STRATEGIES[strategy] if isinstance(strategy, str) else strategy
    first = workers.select(F.lit(0).alias("_g"), F.to_json(F.struct("*")).alias("w")).groupBy("_g").agg(F.collect_list("w").alias("ws"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        import json

        w = pd.DataFrame([json.loads(x) for x in pdf["ws"].iloc[0]]).sort_values("worker_id").reset_index(drop=True)
        held: dict[int, int] = {}
        out = []
        for r in pdf.sort_values(["at", "shard_id"]).itertuples():
            if not pd.isna(r.failed):
                w.loc[w["worker_id"] == int(r.failed), "healthy"] = False
            able = w[w["healthy"]]
            got = held.get(r.shard_id)
            if got is None or got not in set(able["worker_id"]):
                got = choose(able, int(r.shard_id)) if len(able) else -1
                if got >= 0:
                    held[r.shard_id] = got
                    w.loc[w["worker_id"] == got, "assigned"] += 1
            out.append((r.at, r.shard_id, got))
        return pd.DataFrame(out, columns=["at", "shard_id", "worker_id"])

    return requests.withColumn("_g", F.lit(0)).join(F.broadcast(first), "_g").groupBy("_g").applyInPandas(fold, "at long, shard_id long, worker_id long")


def place_experts(loads: list[tuple[int, float]], workers: list[int], redundant: int = 0) -> list[tuple[int, int, float]]:
    """(expert, worker, load): largest expert first, each to the worker with least load, the lowest of several.

    The ``redundant`` largest get a second worker among those that don't have them yet, which counts half their load; load is the
    expert's load over its number of workers.
    """
    order = sorted(loads, key=lambda x: (-x[1], x[0]))
    heap = [(0.0, w) for w in workers]
    heapq.heapify(heap)
    has: dict[int, list[int]] = {}
    total = dict.fromkeys(workers, 0.0)
    for e, load in order:
        _, w = heapq.heappop(heap)
        has[e] = [w]
        total[w] += load
        heapq.heappush(heap, (total[w], w))
    for e, load in order[:redundant]:
        free = [w for w in workers if w not in has[e]]
        if free:
            w = min(free, key=lambda w: (total[w], w))
            has[e].append(w)
            total[w] += load / 2
    return [(e, w, load / len(has[e])) for e, load in order for w in has[e]]


def balance_experts(experts: DataFrame, workers: int, nodes: int = 1, group_size: int = 0, redundant: int = 0) -> DataFrame:
    """(expert_id, worker_id, load) for ``experts`` (expert_id from 0, load).

    With groups that divide the experts and nodes that divide the workers, whole groups go to nodes in order, and each node places its
    own; otherwise all workers are one node. Nodes are independent groups of a Pandas fold, each of a node's experts only.
    """
    n = experts.count()
    split = group_size > 0 and n % group_size == 0 and workers % nodes == 0
    of, each = (nodes, workers // nodes) if split else (1, workers)
    per_node = max(1, n // group_size // nodes) if split else 1
    node = F.least(F.floor(F.floor(F.col("expert_id") / group_size) / per_node), F.lit(of - 1)) if split else F.lit(0)

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        mine = list(range(int(key[0]) * each, (int(key[0]) + 1) * each))
        rows = place_experts(list(zip(pdf["expert_id"].tolist(), pdf["load"].tolist(), strict=True)), mine, redundant)
        return pd.DataFrame(rows, columns=["expert_id", "worker_id", "load"])

    return experts.select("expert_id", F.col("load").cast("double").alias("load"), node.cast("int").alias("node")).groupBy("node").applyInPandas(place, "expert_id long, worker_id long, load double")


def worker_loads(placed: DataFrame) -> DataFrame:
    return placed.groupBy("worker_id").agg(F.count(F.lit(1)).alias("experts"), F.sum("load").alias("load"))
