"""Byte-limited shards by extendible hashing, in DataFrame functions only.

A document's key is hashed to 60 bits. The directory is a binary tree of hash prefixes: a bucket of
more than `limit` bytes is split on its next bit, others are left whole, so a document's shard is
the shortest prefix of its hash whose documents fit the limit. Sizes are summed over fine cells
of the hash space and rolled up to all their prefixes at once; only cells that are still too large
are opened again with more bits, so rows of finished shards are not read further.

A bucket of one document is never split: a document over the limit is a shard of its own, marked
over_limit. So are rows that repeat one key exactly, which no bit can part. Nulls: a null key is a
key like others, a null text has no bytes. An empty table has no shards. Texts are only measured, however long;
other columns of docs may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, unused

HASH_BITS = 60
#: A directory of at most so many cells (each under 50 bytes) is broadcast; a larger one is joined by shuffle.
BROADCAST_CELLS = 100_000


def hash_of(id_col: str) -> F.Column:
    """The first 60 bits of the md5 of the key as text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(hash_col: str, bits: int | F.Column) -> F.Column:
    return F.expr(f"shiftright({hash_col}, {HASH_BITS} - {bits})")


def extendible_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", spare_bits: int = 4) -> DataFrame:
    """doc_id, n_bytes, shard_id (the prefix in bits behind a b), depth, shard_bytes, over_limit of every row."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), hash_of(id_col).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(HASH_BITS, spare_bits + max(0, math.ceil(math.log2(max(1, total) / limit))))
    done, least, open_rows, cells_of = [], 0, rows, []
    while True:
        fine = open_rows.groupBy(prefix("h", bits).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        up = fine.select("cell", "b", "n", F.explode(F.sequence(F.lit(least), F.lit(bits))).alias("depth"))
        up = up.withColumn("p", F.expr(f"shiftright(cell, {bits} - depth)"))
        sizes = up.groupBy("depth", "p").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("n"))
        last = bits >= HASH_BITS
        fits = sizes.where((F.col("shard_bytes") <= limit) | (F.col("n") == 1) | (F.lit(last) & (F.col("depth") == bits)))
        leaf = up.select("cell", "depth", "p").join(fits.select("depth", "p", "shard_bytes"), ["depth", "p"])
        leaf = leaf.groupBy("cell").agg(F.min(F.struct("depth", "p", "shard_bytes")).alias("leaf"))
        directory = materialise(fine.select("cell").join(leaf, "cell", "left").select("cell", "leaf.*"))
        counts = directory.agg(F.count("*"), F.count("depth")).first()
        placed = _look_up(open_rows, directory.where("depth IS NOT NULL"), bits, counts[1])
        done.append(placed)
        if counts[0] == counts[1]:
            break
        rest = directory.where("depth IS NULL").select("cell")
        open_rows = _look_up(open_rows, rest, bits, counts[0] - counts[1]).select("doc_id", "h", "n_bytes")
        least, bits = bits + 1, min(HASH_BITS, bits + 8)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    shard = F.concat(F.lit("b"), F.expr("lpad(bin(p), depth, '0')"))
    return out.select("doc_id", "n_bytes", shard.alias("shard_id"), F.col("depth").cast("int").alias("depth"), "shard_bytes", (F.col("shard_bytes") > limit).alias("over_limit"))


def _look_up(rows: DataFrame, directory: DataFrame, bits: int, cells: int) -> DataFrame:
    keyed = rows.withColumn("cell", prefix("h", bits))
    return keyed.join(F.broadcast(directory) if cells <= BROADCAST_CELLS else directory, "cell")


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """All columns of docs, a folder of Parquet files for each shard; rows of one id (repeated, or null) share a shard.

    A shard over the limit (rows that repeat one id) is written by as many tasks as its rows come from."""
    key, over = unused([*docs.columns, "shard_id"], "shard_key", "over_limit")
    shards = extendible_shards(docs, limit, id_col, text_col).select(F.col("doc_id").alias(key), "shard_id", F.col("over_limit").alias(over)).distinct()
    rows = docs.join(shards, docs[id_col].cast("long").eqNullSafe(F.col(key))).drop(key)
    part = F.when(F.col(over), F.spark_partition_id()).otherwise(-1)
    rows.repartition("shard_id", part).drop(over).write.partitionBy("shard_id").parquet(path)
