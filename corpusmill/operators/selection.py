"""Which rows stay: exact deduplication, samples, caps, splits, overlap checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def keep_first(df: DataFrame, key: Column, order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order (a total one).

    A minimum by key, so rows are combined before the exchange; a key that is most of the table is no
    hot partition. Null keys are a key."""
    columns = df.columns
    rows = df.select(key.alias("__key"), F.struct(*[t.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("__order"), F.struct(*columns).alias("__row"))
    return rows.groupBy("__key").agg(F.min_by("__row", "__order").alias("__row")).select("__row.*")


def duplicate_keys(df: DataFrame, key: Column) -> DataFrame:
    """Keys that occur more than once, with their number; empty for a valid curated set."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def cap(df: DataFrame, group: str, limit: int, seed: str = "42", key: list[str] | None = None) -> DataFrame:
    """At most `limit` rows of each group, by hash rank (limits are pushed below the exchange)."""
    order = Window.partitionBy(group).orderBy(t.rank_hash(group, *(key or df.columns), seed=seed), *(key or []))
    return df.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= limit).drop("__rank")


def hash_sample(df: DataFrame, n: int, key: list[str]) -> DataFrame:
    return df.orderBy(t.rank_hash(*key), *key).limit(n)


def page(df: DataFrame, order: list[str], number: int, size: int = 80) -> DataFrame:
    """Page `number` (from 0) of the rows in a total order; only the pages up to it are sorted out."""
    return df.orderBy(*order).limit((number + 1) * size).offset(number * size)


def round_robin(df: DataFrame, group: str, n: int, key: list[str]) -> DataFrame:
    """n rows dealt in turn from the groups in name order, hash order within a group."""
    order = Window.partitionBy(group).orderBy(t.rank_hash(*key), *key)
    turn = df.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= n)
    return turn.orderBy("turn", group).limit(n)


def train_dev(df: DataFrame, group: str, order: str, n_train: int, n_dev: int) -> DataFrame:
    """The first n_train rows of each group as train, the next n_dev as dev."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    out = df.withColumn("__rank", rank).where(F.col("__rank") <= n_train + n_dev)
    return out.withColumn("split", F.when(F.col("__rank") <= n_train, "train").otherwise("dev")).drop("__rank")


def grouped_split(df: DataFrame, key: Column, dev_share: float, seed: str = "42", slices: int = 1024) -> DataFrame:
    """All rows with one key on one side. Keys come in hash order; dev takes them until it has round(rows x dev_share) rows.

    The order is cut into slices of the hash space: only the rows of each slice (a bounded table) are summed up in one
    task, keys within a slice by themselves. A lone key is train."""
    keyed = df.withColumn("__key", t.sha(F.concat(F.lit(seed + "|"), key)))
    place = F.coalesce(F.conv(F.substring("__key", 1, 15), 16, 10).cast("long"), F.lit(0))
    keys = keyed.groupBy("__key").agg(F.count("*").alias("n")).withColumn("place", place).withColumn("slice", F.shiftright("place", 60 - (slices - 1).bit_length()))
    of_slice = keys.groupBy("slice").agg(F.sum("n").alias("n"), F.count("*").alias("keys"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    starts = of_slice.select(
        "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.bround(F.sum("n").over(everything) * dev_share).alias("target"), F.sum("keys").over(everything).alias("all_keys")
    )
    inside = Window.partitionBy("slice").orderBy("place", "__key").rowsBetween(Window.unboundedPreceding, -1)
    taken = keys.join(F.broadcast(starts), "slice").withColumn("taken", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    sides = taken.select("__key", F.when((F.col("taken") < F.col("target")) & (F.col("all_keys") > 1), "dev").otherwise("train").alias("split"))
    return keyed.join(sides, keyed["__key"].eqNullSafe(sides["__key"])).drop("__key")


def overlap(left: DataFrame, right: DataFrame, key_left: Column, key_right: Column) -> DataFrame:
    """Keys that occur on both sides."""
    return left.select(key_left.alias("key")).intersect(right.select(key_right.alias("key")))


def distribution(df: DataFrame, field: Column, missing: str = "<missing>") -> DataFrame:
    name = F.coalesce(F.nullif(F.trim(field), F.lit("")), F.lit(missing))
    return df.groupBy(name.alias("value")).agg(F.count("*").alias("n"))


def quality(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """Rows with 8 to 50,000 characters in the first text, 1 to 50,000 in the second, and different texts."""
    n, m = F.length(t.clean(first)), F.length(t.clean(second))
    return df.where(n.between(8, 50_000) & m.between(1, 50_000) & (t.norm(first) != t.norm(second)))


def funnel(df: DataFrame, dataset: str, first: str, second: str, order: str, limit: int) -> DataFrame:
    """Rows of each dataset left after quality, deduplication, the cap, and deduplication across datasets (datasets in name order).

    Texts become a hash in the scan; then one row for each dataset and hash is all that moves."""
    good = F.length(t.clean(first)).between(8, 50_000) & F.length(t.clean(second)).between(1, 50_000) & (t.norm(first) != t.norm(second))
    key = F.when(good, t.sha(F.concat_ws("\n", t.norm(first), t.norm(second))))
    slim = df.select(F.col(dataset).alias("d"), F.col(order).alias("o"), key.alias("k")).groupBy("d", "k").agg(F.count("*").alias("n"), F.min("o").alias("o"))
    some = F.col("k").isNotNull()
    out = slim.groupBy("d").agg(F.sum("n").alias("source_rows"), F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("quality_rows"), F.count("k").alias("unique_rows"))
    rank = F.row_number().over(Window.partitionBy("d").orderBy(t.rank_hash("d", "o", seed="42"), "o"))
    capped = slim.where(some).withColumn("rank", rank).where(F.col("rank") <= limit)
    one = capped.groupBy("k").agg(F.min_by("d", F.struct("d", "o")).alias("d"), F.collect_list("d").alias("ds"))
    left = one.select(F.explode("ds").alias("of"), "d").groupBy(F.col("of").alias("d")).agg(F.count("*").alias("capped_rows"))
    chosen = one.groupBy("d").agg(F.count("*").alias("selected_rows"))
    return out.join(left, "d", "left").join(chosen, "d", "left").withColumnRenamed("d", dataset).na.fill(0)
