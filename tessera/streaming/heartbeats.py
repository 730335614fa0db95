"""Worker heartbeats as streams: silent workers, smoothed load, and windowed statistics with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.balance import ALPHA, TIMEOUT_S


def gaps(beats: DataFrame, worker: str = "worker_id", at: str = "ts", timeout_s: int = TIMEOUT_S) -> DataFrame:
    """(worker, first, last, beats): spans of beats with no gap of the timeout or more; on a stream, needs a watermark on ``at``.

    A span that has ended is a worker that went silent at ``last``.
    """
    span = F.session_window(at, f"{timeout_s} seconds")
    return beats.groupBy(worker, span.alias("span")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("beats")).drop("span")


def windowed(events: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: str = "event_type", value: str = "value") -> DataFrame:
    """(start, by, n, total): tumbling windows; rows later than the watermark are left out on a stream."""
    w = F.window(at, width)
    return events.withWatermark(at, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def monitor(beats: DataFrame, timeout_s: int = TIMEOUT_S, alpha: float = ALPHA) -> DataFrame:
    """(worker_id, load, alive): the smoothed load after each batch of beats (worker_id, at, load), and a last row when a worker is silent.

    A stateful stream: each worker's state is one number, and its timeout runs in processing time.
    """

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (load,) = state.get
            state.remove()
            yield pd.DataFrame({"worker_id": [key[0]], "load": [load], "alive": [False]})
            return
        load = state.get[0] if state.exists else 0.0
        for x in pd.concat(list(rows)).sort_values("at")["load"]:
            load = float(x) if load == 0 else alpha * float(x) + (1 - alpha) * load
        state.update((load,))
        state.setTimeoutDuration(timeout_s * 1000)
        yield pd.DataFrame({"worker_id": [key[0]], "load": [load], "alive": [True]})

    return beats.groupBy("worker_id").applyInPandasWithState(update, "worker_id long, load double, alive boolean", "load double", "append", GroupStateTimeout.ProcessingTimeTimeout)
