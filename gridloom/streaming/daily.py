"""Streaming forms of the daily series: watermarked daily means, and trailing means over a carried tail of days."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_stats(stream: DataFrame, ts: str, value: str, by: str, delay: str = "2 hours") -> DataFrame:
    """Mean, largest and number of values a day and key; a day is final when the watermark passes its end."""
    days = stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w"), by)
    return days.agg(F.avg(value).alias("mean"), F.max(value).alias("largest"), F.count(value).alias("n")).select(F.to_date("w.start").alias("date"), by, "mean", "largest", "n")


def trailing_mean(days: DataFrame, key: str, window: int) -> DataFrame:
    """key, date, value and ma: the mean of the last ``window`` days' values up to this one, across micro-batches.

    Each key's state holds the tail of at most window - 1 days. Days have to arrive in order for each key; within a
    batch they are sorted.
    """

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail = list(state.get[0]) if state.exists else []
        rows = pd.concat([*batches]).sort_values("date")
        means = []
        for v in rows["value"]:
            tail = [*tail, float(v)][-window:]
            means.append(sum(tail) / len(tail))
        state.update((tail[-(window - 1) :] if window > 1 else [],))
        yield pd.DataFrame({key: [keys[0]] * len(rows), "date": rows["date"], "value": rows["value"], "ma": means})

    kind = days.schema[key].dataType.simpleString()
    return days.select(key, "date", "value").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, date date, value double, ma double", "tail array<double>", "append", GroupStateTimeout.NoTimeout)
