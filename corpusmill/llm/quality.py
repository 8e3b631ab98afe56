"""Quality rules: base measures of each text, and lines that many documents of a host share.

Lines are normalised (lower case, digits to 0, other marks and white space to one blank) and hashed.
For each host (the source column) the distinct documents of a line are counted; documents are told apart by id and
text, so copies under other ids count and a row repeated with id and text does not. Lines of any length in more than
`max_share` of a host's documents are removed, where that limit is `least_documents` at least and `max_documents` at
most; a document that keeps less than `least_kept` of its words is rejected. `cleaned` gives the texts that are left.
A document is kept if the base rules pass too. The key that lines are counted by holds host and line, so a
host is no hot group, and a line that all documents share is combined before it is exchanged.

Words are runs of characters other than blank and U+0009 to U+000D. Nulls: a null text has no words (`cleaned` leaves it
null), a null host is a host of its own, rows with a null id are told apart by their texts. An empty table gives an empty
result. A text of any length is measured whole, by one task. Columns of docs may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of, texts, unused

SYMBOLS = "#*$%&|<>"
WINDOW = 3
LINE_NOISE = re.compile(r"[\W_]+")
DIGITS = re.compile(r"\d")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which occurs twice or more in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
    base = len(number)
    pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
    keys = pairs[:-1] * base + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(n - WINDOW + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(WINDOW):
        covered[k : n - WINDOW + 1 + k] |= twice
    return int(covered.sum())


def line_key(line: str) -> int:
    plain = LINE_NOISE.sub(" ", DIGITS.sub("0", line.lower())).strip()
    return xxhash.xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass")) - (1 << 63)


def measures(text: str) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and hash and words of each distinct line with a word."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = 0
    sizes: dict[int, int] = {}
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if not n:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        key = line_key(line)
        sizes[key] = sizes.get(key, 0) + n
    return len(words), chars, symbols, dup, repeated_words(words), list(sizes), list(sizes.values())


ROW = "doc_id long, host string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line array<long>, line_words array<int>"


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ROW.split(", ")]
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                cols = list(zip(*map(measures, texts(b.column(3))), strict=True))
                arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(cols[5], pa.list_(pa.int64())), pa.array(cols[6], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *arrays], names)

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.xxhash64(text_of(text_col)).alias("text_key"), text_of(text_col).alias("text")
    )
    return rows.mapInArrow(run, ROW)


def boilerplate(rows: DataFrame, max_documents: int, max_share: float, least_documents: int) -> DataFrame:
    """doc_key, line, words: the lines to remove from each document of a host; rows: measured, with doc_key."""
    lines = rows.select("host", "doc_key", F.explode(F.arrays_zip("line", "line_words")).alias("l"))
    # The key holds the host, so that no host is a group; one row for each line of each document.
    lines = lines.groupBy(F.xxhash64("host", "l.line").alias("key"), "doc_key").agg(F.first("host").alias("host"), F.first("l.line").alias("line"), F.max("l.line_words").alias("words"))
    lines = materialise(lines)
    documents_of = rows.select("host", "doc_key").distinct().groupBy("host").agg(F.count("*").alias("n_documents"))
    limit = F.least(F.lit(max_documents), F.greatest(F.lit(least_documents), F.col("n_documents") * max_share))
    counts = lines.groupBy("key").agg(F.count("*").alias("count"), F.first("host").alias("host")).where(F.col("count") > min(least_documents, max_documents))
    common = counts.alias("c").join(documents_of.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))).where(F.col("count") > limit)
    return lines.join(materialise(common.select("key")), "key").select("doc_key", "line", "words")


def _doc_key(doc_id: F.Column, host: F.Column, text_key: F.Column) -> F.Column:
    return F.xxhash64(host, text_key, doc_id)


def hosted(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    rows = measured(docs, id_col, text_col, host_col)
    return materialise(rows.withColumn("doc_key", _doc_key(F.col("doc_id"), F.col("host"), F.col("text_key"))))


def cleaned(
    docs: DataFrame, max_documents: int = 50, max_share: float = 0.05, least_documents: int = 3, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """docs without the lines that quality_rules counts as removed; a null text stays null."""
    removed = boilerplate(hosted(docs, id_col, text_col, host_col), max_documents, max_share, least_documents)
    key, lines = unused(docs.columns, "doc_key", "removed_lines")
    lists = removed.groupBy(F.col("doc_key").alias(key)).agg(F.collect_set("line").alias(lines))
    own = _doc_key(F.col(id_col).cast("long"), F.col(host_col).cast("string"), F.xxhash64(text_of(text_col)))
    rows = docs.withColumn(key, own).join(lists, key, "left")
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, lines in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                drop = set(lines or ())
                out.append("\n".join(x for x in text.split("\n") if not x.split() or line_key(x) not in drop) if text and drop else text)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, pa.string()), *b.columns[at + 1 : len(names)]], names)

    return rows.select(*names, lines).mapInArrow(run, docs.schema)


def quality_rules(
    docs: DataFrame, max_documents: int = 50, max_share: float = 0.05, least_documents: int = 3, least_kept: float = 0.3, least_words: int = 50, most_repeated: int = 50,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_words of every row."""
    rows = hosted(docs, id_col, text_col, host_col)
    lines = boilerplate(rows, max_documents, max_share, least_documents)
    removed = materialise(lines.groupBy("doc_key").agg(F.sum("words").alias("removed_words")))
    out = rows.drop("line", "line_words").join(removed, "doc_key", "left")
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words") >= least_kept * F.col("n_words")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & left).alias("kept"), "removed_words"
    )
