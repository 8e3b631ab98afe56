"""Usage accounting and fixed-window rate limits over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counters(latency: str, failed: F.Column, tokens: dict[str, str] | None = None, flags: dict[str, F.Column] | None = None) -> list[F.Column]:
    """Aggregates of an event table: requests, sums of token columns, numbers of events with a flag, failures, latency sum.

    Negative and missing numbers count 0."""
    least = lambda c, zero: F.greatest(F.coalesce(F.col(c), F.lit(zero)), F.lit(zero))
    out = [F.count("*").alias("requests")]
    out += [F.sum(least(c, 0)).alias(name) for name, c in (tokens or {}).items()]
    out += [F.count_if(c).alias(name) for name, c in (flags or {}).items()]
    return [*out, F.count_if(failed).alias("failed"), F.round(F.sum(least(latency, 0.0)), 2).alias("total_latency_ms")]


def usage(events: DataFrame, client: str, latency: str, failed: F.Column, **more) -> DataFrame:
    """The counters of each client and the average latency."""
    out = events.groupBy(client).agg(*counters(latency, failed, **more))
    return out.withColumn("average_latency_ms", F.round(F.col("total_latency_ms") / F.col("requests"), 2))


def rate_limit(events: DataFrame, client: str, route: str, ts: str, order: str, window_s: int, limit: int, overrides: DataFrame | None = None) -> DataFrame:
    """admitted and retry_after (s) of each call: the first `limit` of a client and route in a window are admitted.

    overrides (client, limit) replace the default; a limit of 0 or less admits all. Windows are event-time
    ones, so late rows count in their own window."""
    at = F.unix_timestamp(F.col(ts).cast("timestamp"))
    rows = events.withColumn("window_start", at - at % window_s).withColumn("__elapsed", at % window_s)
    own = F.lit(limit)
    if overrides is not None:
        rows = rows.join(overrides.select(F.col("client").alias(client), F.col("limit").alias("__limit")), client, "left")
        own = F.coalesce("__limit", F.lit(limit))
    calls = F.row_number().over(Window.partitionBy(client, route, "window_start").orderBy(ts, order))
    rows = rows.withColumn("admitted", (own <= 0) | (calls <= own))
    return rows.withColumn("retry_after", F.when(~F.col("admitted"), F.greatest(F.lit(1), window_s - F.col("__elapsed"))))


def credentials(calls: DataFrame, keys: DataFrame) -> DataFrame:
    """calls (client, key) with `valid`: the key's SHA-256 equals the client's stored one."""
    return calls.join(keys.select("client", F.lower("key_hash").alias("__hash")), "client", "left").withColumn("valid", F.coalesce(F.sha2("key", 256) == F.col("__hash"), F.lit(False))).drop("__hash")
