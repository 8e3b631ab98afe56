"""Structured Streaming forms: running usage, fixed-window rate limits, first-seen rows, server-sent events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """ts as a timestamp with a watermark (NTZ timestamps cannot carry one)."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def running_usage(stream: DataFrame, client: str, latency: str, failed: F.Column) -> DataFrame:
    """Counters of each client; for output modes update and complete."""
    ms = F.greatest(F.coalesce(F.col(latency), F.lit(0.0)), F.lit(0.0))
    return stream.groupBy(client).agg(F.count("*").alias("requests"), F.count_if(failed).alias("failed"), F.round(F.sum(ms), 2).alias("total_latency_ms"))


def first_seen(stream: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """The first row of each key within the watermark; state is dropped after it."""
    return timed(stream, ts, late).dropDuplicatesWithinWatermark(key)


def rate_limited(stream: DataFrame, client: str, route: str, ts: str, window_s: int, limit: int, late: str = "1 hour", buckets: int = 64) -> DataFrame:
    """client, route, ts, admitted, retry_after. State is the admitted count of each window, which event time evicts.

    A late row counts in its own window (it does not reset a newer one). The clients and routes of a window are dealt to
    `buckets`: one state and one call of Python stand for all of a bucket, whose new rows are held at once."""
    rows = timed(stream, ts, late).withColumn("__start", F.unix_timestamp(ts) - F.unix_timestamp(ts) % window_s)
    rows = rows.withColumn("__key", F.to_json(F.struct(client, route))).withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(buckets)))

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = json.loads(state.get[0]) if state.exists else {}
        start = int(key[1])
        pdf = pd.concat(list(frames), ignore_index=True).sort_values(ts, kind="stable")
        own = pdf["__key"]
        before = own.map(used).fillna(0).to_numpy("int64")
        admitted = (limit <= 0) | (before + pdf.groupby("__key", sort=False).cumcount().to_numpy() < limit)
        for k, n in own[admitted].value_counts().items():
            used[k] = used.get(k, 0) + int(n)
        elapsed = pdf[ts].to_numpy("datetime64[s]").astype("int64") - start
        wait = pd.Series(np.maximum(window_s - elapsed, 1), index=pdf.index, dtype="Int64").mask(admitted)
        yield pd.DataFrame({client: pdf[client], route: pdf[route], ts: pdf[ts], "admitted": admitted, "retry_after": wait})
        state.update((json.dumps(used),))
        end = (start + window_s) * 1000
        state.setTimeoutTimestamp(max(end, int(state.getCurrentWatermarkMs()) + 1))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"{client} {kinds[client]}, {route} {kinds[route]}, {ts} timestamp, admitted boolean, retry_after long"
    return rows.groupBy("__bucket", "__start").applyInPandasWithState(decide, schema, "used string", "append", GroupStateTimeout.EventTimeTimeout)


def sse_events(frames: DataFrame, value: str = "value") -> DataFrame:
    """event and data of server-sent events: a frame a row, data lines joined by line ends."""
    lines = F.split(F.replace(F.col(value), F.lit("\r\n"), F.lit("\n")), "\n")
    of = lambda name: F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(name + ":"))), lambda x: F.regexp_replace(x, rf"^{name}: ?", ""))
    return frames.select(F.coalesce(F.try_element_at(of("event"), F.lit(-1)), F.lit("message")).alias("event"), F.array_join(of("data"), "\n").alias("data"))
