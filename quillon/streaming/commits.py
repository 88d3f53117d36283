"""Commits as a stream: late and repeated events, counts by window, last state of each file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def distinct_commits(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each commit once, however often it is announced within the delay; ``ts`` is event time."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["oid"])


def activity(stream: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Changes by window, author and status."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "author", "status").agg(F.count("*").alias("changes"))


def last_state(stream: DataFrame) -> DataFrame:
    """(path, oid, ts, changes): the newest commit of each file and its number of changes so far."""

    def update(key, batches, state):
        oid, ts, n = state.get if state.exists else (None, pd.Timestamp.min.value // 1000, 0)
        for rows in batches:
            n += len(rows)
            micros = rows["ts"].astype("int64") // (1000 if str(rows["ts"].dtype).endswith("ns]") or "ns" in str(rows["ts"].dtype) else 1)
            best = max(zip(micros, rows["oid"], strict=True))
            if (best[0], best[1]) > (ts, oid or ""):
                ts, oid = int(best[0]), best[1]
        state.update((oid, ts, n))
        yield pd.DataFrame({"path": [key[0]], "oid": [oid], "ts_us": [ts], "changes": [n]})

    return stream.groupBy("path").applyInPandasWithState(update, "path string, oid string, ts_us long, changes long", "oid string, ts_us long, changes long", "update", GroupStateTimeout.NoTimeout)
