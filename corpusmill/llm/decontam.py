"""Benchmark decontamination by templates, so that re-parameterised questions are caught too.

Texts become templates: numbers, units of measure and names (capitalised words; neighbours form one) turn
into typed placeholders, other words are lower-cased, marks go. A capital that begins a sentence may be a
name or not, so texts and items are read both ways: with such words as words, and with every capital as a
name wherever it stands. A third reading has lower-cased words and literal numbers only: copies in other
case, short items and those of numbers mostly are found by it, if all of the item is there.

1. The windows of `window` template words of all items are written as a table of hashes, with the values
   of their slots.
2. One pass over the documents writes their windows in the same way, but only those that a bit filter of the
   items' hashes lets pass (of FILTER_SLOTS places, the one thing that is broadcast, so bounded at any size).
   Equal texts are combined before they are exchanged.
3. Both tables are joined by hash: a shuffle join, unless Spark's own size check finds the items' side small.
4. For each text and item, hits along one diagonal (document position less item position, within `slip`
   words) are an occurrence if they cover at least `coverage` of the item's windows and the slots are
   consistent: wherever the item repeats a value, the document repeats one value too. An occurrence with
   the item's own values is `exact`, one with others `template`. The best of all readings is reported.

An item of fewer than `window` words is one window of its own length (at least `least` words, or
LITERAL_LEAST of the literal reading). Template windows with more placeholders than words say too little and
are left out. Whole texts are read.

Nulls and empty texts match nothing; items without enough words match nothing. An item repeated with id
and text counts as one; repeated rows, and rows with a null id, are each reported. An empty benchmark leaves all
documents; an empty table stays empty. A very long text is read at once; what is kept of it are its hits.
Columns of docs may have any names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, Runs, batches_of, by_group, give_back, kept, lowered, materialise, mix, signs_where, text_slices, unused

UNITS = sorted(
    "mm cm m km mi inch inches ft feet yd yards mile miles g mg kg lb lbs oz ton tons l ml litre litres liter liters gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros pound pounds cent cents percent degree degrees celsius fahrenheit mph kmh "
    "w kw kwh v volt volts amp amps j joule joules kcal cal hz khz mhz ghz kb mb gb tb meter meters metre metres gram grams".split()
)
NUMBER, UNIT, NAME = 1, 2, 3
#: Readings: capitals that begin a sentence as words, all capitals as names, no placeholders at all.
WORDS, NAMES, LITERAL = READINGS = 0, 1, 2
#: Items of fewer tokens (one or two) would be found in most texts.
LITERAL_LEAST = 3
#: Places of the bit filter; a hash takes two.
FILTER_BITS = 23
FILTER_SLOTS = 1 << FILTER_BITS
#: Rows of an Arrow batch with texts.
TEXT_ROWS = 500


@dataclass
class Reading:
    """Template codes of texts one after the other, the text of each, and the values of numbers and names (else 0)."""

    codes: np.ndarray
    text: np.ndarray
    values: np.ndarray


def _marks() -> np.ndarray:
    return signs_where("sentence marks", lambda c: c in ".!?\n")


def read(rows: list[str]) -> list[Reading]:
    """All texts in each reading. Tokens are runs of letters, numbers (digits, also with . , : between them) and marks that end sentences."""
    codes = np.frombuffer("\n".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.frombuffer("\n".join(map(lowered, rows)).encode("utf-32-le", "surrogatepass"), np.uint32)
    digit = signs_where("digits", str.isdecimal)[codes]
    letter = signs_where("letters and numerals", lambda c: c.isalnum() and not c.isdecimal())[codes]
    inner = np.isin(codes, (46, 44, 58))
    inner[1:-1] &= digit[:-2] & digit[2:]
    if len(inner):
        inner[[0, -1]] = False
    kind = letter + 2 * (digit | inner)
    kind[_marks()[codes] & ~inner] = 3
    starts = np.flatnonzero((kind > 0) & ((kind == 3) | (np.diff(kind, prepend=0) != 0)))
    edge = np.append(np.diff(kind) != 0, True) | (kind == 3)
    sizes = np.flatnonzero((kind > 0) & edge) + 1 - starts
    ends = np.cumsum([len(t) + 1 for t in rows], dtype=np.int64)
    of = np.searchsorted(ends, starts, side="right")
    mark, number = kind[starts] == 3, kind[starts] == 2
    begins = np.concatenate(([True], mark[:-1]))[: len(mark)] | (np.diff(of, prepend=-1) > 0)
    said = ~mark
    hashed = lambda signs: (Runs(signs, starts, sizes, ends, ends).hashes() >> np.uint64(2)).astype(np.int64) | 4
    plain, exact = hashed(low), hashed(codes)
    known = words_hash(UNITS)
    unit = ~number & np.isin(plain, known)
    capital = signs_where("capitals", str.isupper)[codes[starts]] & ~number & ~unit & said
    out = []
    for name in (capital & ~begins, capital):
        inside = np.zeros(len(name), bool)
        inside[1:] = name[1:] & name[:-1] & (of[1:] == of[:-1])
        keep = said & ~inside
        template = np.where(name, NAME, np.where(number, NUMBER, np.where(unit, UNIT, plain)))
        # A name's value is that of its words in turn.
        group = np.flatnonzero(keep[said])
        place = np.arange(int(said.sum())) - np.repeat(group, np.diff(group, append=int(said.sum())))
        parts = mix(exact[said].astype(np.uint64) + place.astype(np.uint64) * BASE)
        values = (np.add.reduceat(parts, group) >> np.uint64(2)).astype(np.int64) if len(group) else np.zeros(0, np.int64)
        template = template[keep]
        out.append(Reading(template, of[keep], np.where((template == NUMBER) | (template == NAME), values, 0)))
    return [*out, Reading(plain[said], of[said], np.zeros(int(said.sum()), np.int64))]


def words_hash(words: list[str]) -> np.ndarray:
    runs = Runs.of(words, signs_where("letters and numerals", lambda c: c.isalnum() and not c.isdecimal()))
    return (runs.hashes() >> np.uint64(2)).astype(np.int64) | 4


def windows(r: Reading, size: int, reading: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs of `size` codes of one text, without those of more placeholders than words."""
    n = len(r.codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # Mixed, so that the small codes of placeholders can't turn one reading's beginning into another's.
    h = np.repeat(mix(np.array([len(READINGS) * size + reading + 1], np.uint64)), n)
    for k in range(size):
        h = (h ^ r.codes[k : k + n].astype(np.uint64)) * BASE
        h ^= h >> np.uint64(29)
    slots = np.concatenate(([0], np.cumsum(r.codes <= NAME)))
    good = (2 * (slots[size:] - slots[:-size]) <= size) & (r.text[:n] == r.text[size - 1 :])
    at = np.flatnonzero(good)
    return at, h[at]


def probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a hash in the filter."""
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64), (h & np.uint64(FILTER_SLOTS - 1)).astype(np.int64)


def _slot_lists(r: Reading, at: np.ndarray, size: int) -> pa.Array:
    return pa.array(list(r.values[at[:, None] + np.arange(size)]), pa.list_(pa.int64()))


WINDOWS = "key long, item_id long, reading int, size int, total int, hash long, pos int, wanted array<long>"


def item_windows(benchmark: DataFrame, window: int, least: int, item_col: str, text_col: str) -> DataFrame:
    """WINDOWS: a row for each window of each distinct item; total: its number of windows in the reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in WINDOWS.split(", ")]
        for b in batches:
            for key, item, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for reading, r in enumerate(read([text])):
                    size = min(window, len(r.codes))
                    if size < (LITERAL_LEAST if reading == LITERAL else least):
                        continue
                    at, h = windows(r, size, reading)
                    same = lambda v, kind: pa.array([v] * len(at), kind)  # noqa: B023, E731
                    columns = [same(key, pa.int64()), same(item, pa.int64()), same(reading, pa.int32()), same(size, pa.int32()), same(len(at), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(h.view(np.int64)), pa.array(at.astype(np.int32)), _slot_lists(r, at, size)], names)

    items = benchmark.where(F.length(text_col) > 0).select(F.xxhash64(item_col, text_col).alias("key"), F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return materialise(items.dropDuplicates(["key"]).mapInArrow(run, WINDOWS))


def window_hits(batches: Iterator[pa.RecordBatch], table: np.ndarray, sizes: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """tk, hash, at, given of the windows of sizes (reading, words) that the filter lets pass, from batches of tk and text, whose memory follows text_slices."""
    for b, part in text_slices(batches, 1, TEXT_ROWS):
        keys, readings = b.column(0).to_numpy(), read(part)
        for reading, size in sizes:
            r = readings[reading]
            at, h = windows(r, size, reading)
            first, second = probes(h)
            hit = np.flatnonzero(table[first])
            hit = hit[table[second[hit]]]
            if len(hit):
                at, of = at[hit], r.text[at[hit]]
                begin = np.searchsorted(r.text, of)
                columns = [pa.array(keys[of]), pa.array(h[hit].view(np.int64)), pa.array((at - begin).astype(np.int32)), _slot_lists(r, at, size)]
                yield pa.RecordBatch.from_arrays(columns, ["tk", "hash", "at", "given"])


def document_hits(docs: DataFrame, items: DataFrame, text_col: str) -> DataFrame:
    """tk (hash of the text), hash, at, given: windows of the documents that the filter of the items' windows lets pass."""
    both = F.array(F.shiftrightunsigned("hash", 64 - FILTER_BITS), F.col("hash").bitwiseAND(FILTER_SLOTS - 1))
    places = items.select(F.explode(both).alias("place")).distinct().toArrow().column(0).to_numpy()  # FILTER_SLOTS at most
    bits = np.zeros(FILTER_SLOTS, bool)
    bits[places] = True
    sizes = [(r[0], r[1]) for r in items.select("reading", "size").distinct().collect()]  # a few for each reading
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("leaks",), dict)  # what other stages have kept goes
        yield from window_hits(batches, np.unpackbits(sent.value).view(bool), sizes)
        give_back()

    rows = docs.where(F.length(text_col) > 0).select(F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text"))
    hits = rows.mapInArrow(run, "tk long, hash long, at int, given array<long>") if sizes else rows.selectExpr("tk", "0L AS hash", "0 AS at", "array(0L) AS given").where("false")
    # Copies of a text have the same hits; they are one before the join.
    return hits.groupBy("tk", "hash", "at").agg(F.first("given").alias("given"))


def occurrence(reading: int, at: np.ndarray, pos: np.ndarray, given: list, wanted: list, total: int, coverage: float, slip: int) -> tuple | None:
    """kind, coverage, slots, changed slots of the best occurrence of an item in a text in one reading."""
    share_least = 1.0 if reading == LITERAL else coverage
    order = np.lexsort((pos, at - pos))
    at, pos = at[order], pos[order]
    diagonal = at - pos
    first = np.flatnonzero(np.diff(diagonal, prepend=diagonal[0] - 1))
    last = np.searchsorted(diagonal, diagonal[first] + slip, side="right")
    best = None
    for lo, hi in zip(first.tolist(), last.tolist(), strict=True):
        if hi - lo < share_least * total or (best and hi - lo < best[1] * total):
            continue
        share = len(set(pos[lo:hi].tolist())) / total
        if share < share_least or (best and share < best[1]):
            continue
        pairs: dict[int, tuple[int, int]] = {}
        for i in range(lo, hi):
            for k, (w, g) in enumerate(zip(wanted[order[i]], given[order[i]], strict=True)):
                if w:  # of several places the one on the first diagonal counts
                    pairs.setdefault(int(pos[i]) + k, (w, g))
        seen: dict[int, set[int]] = defaultdict(set)
        for w, g in pairs.values():
            seen[w].add(g)
        if any(len(g) > 1 for g in seen.values()):
            continue
        changed = sum(w != g for w, g in pairs.values())
        if best is None or (share, -changed) > (best[1], -best[3]):
            best = ("template" if changed else "exact", share, len(pairs), changed)
    return best


FOUND = "tk long, item_id long, kind string, coverage double, slots int, changed_slots int"


def found_items(docs: DataFrame, benchmark: DataFrame, text_col: str, coverage: float, slip: int, window: int, least: int, item_col: str, item_text_col: str) -> DataFrame:
    """FOUND: the items that occur in each different text, by its hash."""
    items = item_windows(benchmark, window, least, item_col, item_text_col)
    joined = document_hits(docs, items, text_col).join(items, "hash")
    partitions = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = joined.select("tk", "key", "item_id", "reading", "total", "at", "pos", "given", "wanted").repartition(partitions, "tk", "key").sortWithinPartitions("tk", "key", "reading")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FOUND.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
        out: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        for t in by_group(batches, ["tk", "key"]):
            best = None
            readings = t.column("reading").to_numpy()
            for reading in sorted(set(readings.tolist())):
                part = t.filter(pa.array(readings == reading))
                at, pos = part.column("at").to_numpy(), part.column("pos").to_numpy()
                total = part.column("total")[0].as_py()
                if len(set(pos.tolist())) < (1.0 if reading == LITERAL else coverage) * total:
                    continue
                got = occurrence(reading, at, pos, part.column("given").to_pylist(), part.column("wanted").to_pylist(), total, coverage, slip)
                if got and (best is None or (got[1], -got[3]) > (best[1], -best[3])):
                    best = got
            if best:
                out.append((t.column("tk")[0].as_py(), t.column("item_id")[0].as_py(), *best))
            if len(out) >= 1000:
                yield pack()
                out.clear()
        if out:
            yield pack()

    with batches_of(docs.sparkSession, TEXT_ROWS):
        return materialise(dealt.mapInArrow(check, FOUND))


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = 0.5, slip: int = 3, window: int = 8, least: int = 5,
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, kind, coverage, slots, changed_slots: a row for each document and item that occurs in it."""
    found = found_items(docs, benchmark, text_col, coverage, slip, window, least, item_col, item_text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tk"))
    return rows.join(found, "tk").drop("tk")


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", coverage: float = 0.5, slip: int = 3, window: int = 8, least: int = 5, item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The rows of docs in which no benchmark item occurs."""
    found = found_items(docs, benchmark, text_col, coverage, slip, window, least, item_col, item_text_col)
    (tk,) = unused(docs.columns, "text_hash")
    return docs.withColumn(tk, F.xxhash64(text_col)).join(found.select(F.col("tk").alias(tk)).distinct(), tk, "left_anti").select(*docs.columns)
