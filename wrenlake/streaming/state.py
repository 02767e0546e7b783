"""Streaming forms: windows with a watermark, duplicates within one, running maxima by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_counts(events: DataFrame, time: str, kind: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, kind, n, total) of windows; on a stream rows more than ``late`` behind are dropped."""
    df = events.withWatermark(time, late) if events.isStreaming else events
    out = df.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), kind, "n", "total")


def first_of_each(events: DataFrame, keys: list[str], time: str, late: str = "2 days") -> DataFrame:
    """One row a key among those that arrive within ``late`` of each other; a batch keeps the earliest."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    from wrenlake.operators.relational import first_per_key

    rest = [F.col(c) for c in events.columns if c not in keys and c != time]
    return first_per_key(events, keys, [F.col(time), *rest])


def growing_reads(reads: DataFrame, key: str, time: str, size: str) -> DataFrame:
    """(key, time, size): reads that are longer than every earlier one of their key, by a stream's state.

    State is one number a key; rows of one micro-batch are taken in the order of their time.
    """
    schema = f"{key} string, {time} timestamp, {size} long"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else -1
        rows = pd.concat(list(batches)).sort_values([time, size])
        keep = []
        for t, n in zip(rows[time], rows[size]):
            if n is not None and n > best:
                best = int(n)
                keep.append((k[0], t, best))
        state.update((best,))
        yield pd.DataFrame(keep, columns=[key, time, size])

    one = reads.select(F.col(key).cast("string").alias(key), time, F.col(size).cast("long").alias(size))
    return one.groupBy(key).applyInPandasWithState(step, schema, "best long", "append", GroupStateTimeout.NoTimeout)
