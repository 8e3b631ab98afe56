"""Shared pieces of the training-data operators: tables, work space, Arrow streams."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.work import clear_work, work_dir  # noqa: F401

#: Entries that each of the two generations of a worker's word cache may hold.
CACHE_ENTRIES = 400_000


class WordCache:
    """A bounded map from words to what was worked out for them: when the young generation is full
    it becomes the old one, and what is used from the old one returns to the young."""

    def __init__(self, entries: int = CACHE_ENTRIES) -> None:
        self.entries, self.young, self.old = entries, {}, {}

    def absent(self, words: set[str]) -> list[str]:
        """Those of words that are in neither generation; the others are young afterwards."""
        if len(self.young) > self.entries:
            self.young, self.old = {}, self.young
        young, old, out = self.young, self.old, []
        for w in words.difference(young):
            if w in old:
                young[w] = old[w]
            else:
                out.append(w)
        return out


#: What a Python worker keeps from task to task (models and their word caches), by kind and parameters.
_KEPT: dict = {}


def give_back() -> None:
    """What was freed goes back to the system, where the C library can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def kept(key: tuple, make):
    """make(), once in each Python worker for each key; only the last is kept, so stages don't add up in memory."""
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files once it is written; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most in what runs inside: the JVM and the worker hold each batch whole, so long texts need small ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(before) < 1 else min(int(before), rows)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Bits of a filter of keys for each key, and at most (8 MB).
KEY_BITS, MOST_BITS = 16, 1 << 26


def key_filter(keys: DataFrame, names: tuple[str, str, str] = ("rid", "tk", "key_bits")) -> tuple[DataFrame, Column]:
    """A table of one row, to be broadcast, and whether rows pass it: all whose key is in keys (two columns), and few others.

    names: the rows' columns of the key, and the table's column.
    Texts that don't pass need not be dealt out. Beyond MOST_BITS / KEY_BITS keys more of the others pass, which costs time only."""
    spark = keys.sparkSession
    size = 1 << min(max(16, (KEY_BITS * keys.count()).bit_length()), MOST_BITS.bit_length() - 1)
    places = lambda *key: [h.bitwiseAND(F.lit(size - 1)) for h in (F.xxhash64(*key), F.shiftrightunsigned(F.xxhash64(*key), 32))]
    word, bit = lambda p: F.shiftright(p, 6).cast("int"), lambda p: p.bitwiseAND(F.lit(63)).cast("int")
    set_bits = keys.select(F.explode(F.array(*places(*keys.columns))).alias("p")).groupBy(word(F.col("p")).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("p")))).alias("b"))
    got = set_bits.toArrow()
    words = np.zeros(size >> 6, np.int64)
    words[got.column("w").to_numpy()] = got.column("b").to_numpy()
    table = spark.createDataFrame(pa.table({names[2]: pa.array([words], pa.list_(pa.int64()))}))
    hit = [F.getbit(F.get(names[2], word(p)), bit(p)) == 1 for p in places(*names[:2])]
    return F.broadcast(table), hit[0] & hit[1]


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each made longer until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(col: str) -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, mod modulus; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % modulus


def sample_ids(labels: DataFrame, id_col: str, class_col: str, per_class: int) -> DataFrame:
    """s_id, s_class: at most per_class ids of each class, in the order of their hashes; ids and classes of any type.

    All classes are ranked at once, first in 64 parts of each by hash, so that a large class is no hot group."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(class_col).isNotNull()).select(F.col(id_col).alias("s_id"), F.col(class_col).alias("s_class"))
    rows = rows.withColumn("h", F.xxhash64("s_id"))
    for part in (["s_class", F.pmod("h", F.lit(64))], ["s_class"]):
        rank = F.row_number().over(Window.partitionBy(*part).orderBy("h", "s_id"))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= per_class).drop("rank")
    return materialise(rows.select("s_id", "s_class").distinct())


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the runs of equal keys in a sorted Arrow stream, over batch borders."""
    open_parts: list[pa.RecordBatch] = []
    open_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i in range(1, len(values) + 1):
            if i < len(values) and values[i] == values[start]:
                continue
            if open_parts and open_key != values[start]:
                yield pa.Table.from_batches(open_parts)
                open_parts = []
            open_parts.append(batch.slice(start, i - start))
            open_key = values[start]
            start = i
    if open_parts:
        yield pa.Table.from_batches(open_parts)


def texts(column: pa.Array) -> list[str]:
    return [t if t is not None else "" for t in column.to_pylist()]


#: Characters that are read at once (some 60 to 100 bytes of arrays each).
SLICE_CHARS = 1 << 19


def text_slices(batches: Iterable[pa.RecordBatch], at: int, rows: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with the texts of column `at`: so many rows and SLICE_CHARS characters at most, or one longer text."""
    for whole in batches:
        for lo in range(0, whole.num_rows, rows):
            b = whole.slice(lo, rows)
            part = texts(b.column(at))
            begin = size = 0
            for i, t in enumerate(part):
                if i > begin and size + len(t) > SLICE_CHARS:
                    yield b.slice(begin, i - begin), part[begin:i]
                    begin, size = i, 0
                size += len(t)
            yield b.slice(begin), part[begin:]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (np.unique hashes integers, which takes many times as long as sorting them)."""
    out = np.sort(values)
    if len(out) < 2:
        return out
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


MIX1, MIX2, BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """64 bits mixed so that each depends on all."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


#: Which code points a test takes, by the test's name.
_SIGNS: dict[str, np.ndarray] = {}


def signs_where(name: str, test: Callable[[str], bool]) -> np.ndarray:
    """For each code point, whether the test named so takes it; worked out once in each process."""
    if name not in _SIGNS:
        _SIGNS[name] = np.fromiter((test(chr(i)) for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _SIGNS[name]


def word_signs() -> np.ndarray:
    """The signs that the re module's \\w takes."""
    return signs_where("words", lambda c: c.isalnum() or c == "_")


def letter_signs() -> np.ndarray:
    """Letters (Unicode category L)."""
    return signs_where("letters", str.isalpha)


def lowered(text: str) -> str:
    """Lower case with as many characters as the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@dataclass
class Runs:
    """Words (runs of signs) of texts: all code points, where words start and their sizes, and each text's first character and last word's end."""

    codes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    offsets: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, rows: list[str], signs: np.ndarray) -> Runs:
        codes = np.frombuffer("\n".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.zeros(len(codes) + 2, np.int8)
        inside[1:-1] = signs[codes]
        edge = np.diff(inside)
        starts = np.flatnonzero(edge == 1)
        text_ends = np.cumsum([len(t) + 1 for t in rows], dtype=np.int64) if rows else np.zeros(0, np.int64)
        offsets = np.concatenate(([0], text_ends[:-1])) if rows else text_ends
        return cls(codes, starts, np.flatnonzero(edge == -1) - starts, offsets, np.searchsorted(starts, text_ends))

    def spread(self) -> tuple[np.ndarray, np.ndarray]:
        """The code points of all words in turn, and each one's place in its word."""
        place = np.arange(int(self.sizes.sum())) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        return self.codes[place + np.repeat(self.starts, self.sizes)], place

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        own, place = self.spread()
        power = np.full(int(self.sizes.max()), BASE)
        power[0] = 1
        sums = np.add.reduceat((own.astype(np.uint64) + np.uint64(1)) * np.cumprod(power)[place], np.cumsum(self.sizes) - self.sizes)
        return mix(sums + self.sizes.astype(np.uint64) * MIX1)


def word_hashes(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of \\w in lower case) of all texts, one after the other, and where each text ends."""
    runs = Runs.of([t.lower() for t in rows], word_signs())
    return runs.hashes(), runs.ends
