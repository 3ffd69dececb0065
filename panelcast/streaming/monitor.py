"""Streaming extensions: windowed event counts and an online CUSUM. The batch engine doesn't need them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count, severity and channels of each territory and window; messages later than late are dropped."""
    stamped = events.withColumn("published", F.col("published").cast("timestamp")).withWatermark("published", late)
    return stamped.groupBy(F.window("published", size), "territory_id").agg(F.count("*").alias("n"), F.sum("severity").alias("severity"), F.approx_count_distinct("channel").alias("channels"))


def online_cusum(scores: DataFrame, k: float = 0.5, h: float = 4.0) -> DataFrame:
    """key, at, score of a stream of key, at (long), z: CUSUM that restarts after exceeding h, its two sums kept as state."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(parts)).sort_values("at")
        out = []
        for at, z in zip(rows["at"], rows["z"], strict=True):
            if pd.isna(z):
                out.append((key[0], at, None))
                continue
            up, down = max(0.0, up + z - k), max(0.0, down - z - k)
            out.append((key[0], at, max(up, down)))
            if max(up, down) > h:
                up = down = 0.0
        state.update((up, down))
        yield pd.DataFrame(out, columns=["key", "at", "score"])

    return scores.groupBy("key").applyInPandasWithState(run, "key string, at long, score double", "up double, down double", "append", "NoTimeout")
