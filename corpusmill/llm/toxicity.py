"""Toxicity by two class-conditional Kneser-Ney bigram models, for toxic and for ordinary text.

All counts are Kneser-Ney continuation counts (distinct words before an expression), so a text with many
copies counts once. Those of the classes come from every labelled row, the shared ones (distinct words
before a word, uniform at their end) from every document. Words of a class are discounted by DISCOUNT, and
what is taken goes to the shared distribution; pairs are discounted by one context, so that a pair seen
behind one word only backs off wholly, and what is taken goes to the class's word counts.
One of n contexts in labelled rows keeps the share (n / `cutoff`) squared, 1 at most, of its own log
ratio, and the rest backs off (a pair to its word, a word to the shared distribution, which says nothing
about a class), so that chance occurrences say little.

A text is compared in windows of some expressions: a window's log-likelihood ratio is divided by its
length, and so is the whole text's. A logistic curve over the best window and the whole, fitted on
sampled documents that were not counted, gives the score. The window's length is the one of `windows` whose
curve, fitted on half of that sample, does best on the other half; held-out rows have no part in it.

Counting: each task packs its distinct pairs, sorted by buckets of the hash space, with the contexts of
labelled ones; buckets are merged by tasks of their own, whose number follows the corpus. A word's
pairs are spread over 16 buckets or more by the word before, so no word is a hot group. Words, and so contexts, go by
28-bit hashes; contexts are counted exactly.

The model that workers hold is bounded at any size of the corpus: a table of WORD_SLOTS words and one of
PAIR_SLOTS pairs. Where there are more, WAYS of those that share a slot stay, those of most contexts, and the others are
in a table in the shared folder. A pass over the texts then leaves open the words whose ratio asks of that table; what can be said without them
is said, and only the numbers of the open words and of those that share a window with them are dealt to groups, each of
which gets the counts it needs before its texts' words. So every count has its part in a score at any size, and no text is dealt out.
Only the curve is fitted on a bounded sample: two fifths of per_class labelled toxic documents and three times
as many ordinary ones, by hash order of their ids; all other labelled rows are counted.

Null and empty texts, and those without a word, score 0. Unlabelled rows and null labels teach no class; without
documents of both classes every score is 0. Repeated rows count once and each get their score; empty tables give
empty results; texts of any length are read whole. Columns of docs may have any names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, by_group, distinct, fold, give_back, kept, key_filter, materialise, mix, sample_ids, shuffles_dropped, text_of, text_slices, unused, word_hashes

DISCOUNT = 0.75
BITS = 28
#: Rows of the model's tables at most, and how many of them share a slot where there are more.
WORD_SLOTS, PAIR_SLOTS, WAYS = 1 << 20, 1 << 21, 4
#: Characters that the words of a group stand for, and bits at most of the filter of the expressions that have no place (8 MB).
GROUP_CHARS, MOST_BITS = 12_000_000, 1 << 26
#: Words of text that a task packs at once, and that a bucket stands for.
PACK_WORDS, BUCKET_WORDS = 3_000_000, 2_000_000
#: Rows of an Arrow batch with texts.
TEXT_ROWS = 1000
#: Labelled ids are broadcast up to this number; more of them are joined by shuffle.
BROADCAST_LABELS = 2_000_000
COUNTS = ["t", "o", "pooled", "ht", "ho", "ft", "fo"]
#: Marks the word before a run of open words (0 at a text's beginning), which stands in front of it.
FRONT = 1 << BITS
#: Characters of a word with what parts it from the next, about.
WORD_CHARS = 8


def numbers_of(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (28 bits of hash, above 0, which stands before the first word) of texts, one after the other, and where each text ends."""
    hashes, ends = word_hashes(rows)
    return np.maximum(hashes & np.uint64((1 << BITS) - 1), 1).astype(np.int64), ends


def _before(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number before each one in its text, 0 at the text's beginning."""
    out = np.zeros(len(ids), np.int64)
    out[1:] = ids[:-1]
    starts = ends[:-1]
    out[starts[starts < len(ids)]] = 0
    return out


# --- packed pairs: 4 bits of the word before, the word, the other bits of the word before


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (((before & 15) << (2 * BITS - 4)) | (word << (BITS - 4)) | (before >> 4)).astype(np.uint64)


def split_key(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = key.astype(np.int64)
    return ((k & ((1 << (BITS - 4)) - 1)) << 4) | (k >> (2 * BITS - 4)), (k >> (BITS - 4)) & ((1 << BITS) - 1)


def _shrunk(values: np.ndarray) -> bytes:
    """Numbers by bytes of like weight, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _grown(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


#: A context and the class that has it.
MARK_BITS, MARK = np.uint64(BITS + 1), np.uint64((1 << (BITS + 1)) - 1)
PACKED = "bucket long, n_pairs long, pairs binary, n_contexts long, places binary, contexts binary"


def packed(key: np.ndarray, context: np.ndarray, label: np.ndarray, shift: int) -> Iterator[tuple]:
    """Rows of PACKED: each bucket's distinct keys, and the distinct contexts of those with a label (1 or 2)."""
    own = distinct(key)
    hit = np.flatnonzero(label)
    hit = hit[np.argsort(key[hit])]  # places of sorted keys are found faster
    place = np.searchsorted(own, key[hit]).astype(np.uint64)
    marks = (context[hit].astype(np.int64) << 1 | (label[hit] == 2)).astype(np.uint64)
    seen = distinct((place << MARK_BITS) | marks)
    place, marks = (seen >> MARK_BITS).astype(np.int64), (seen & MARK).astype(np.uint32)
    bucket = own >> np.uint64(shift)
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(own)]
    sides = np.searchsorted(place, cuts)
    for lo, hi, a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), sides[:-1].tolist(), sides[1:].tolist(), strict=True):
        base = bucket[lo] << np.uint64(shift)
        steps = np.diff(own[lo:hi], prepend=base)
        places = np.diff(place[a:b], prepend=lo).astype(np.uint32)
        yield int(bucket[lo]), hi - lo, _shrunk(steps), b - a, _shrunk(places), _shrunk(marks[a:b])


def unpacked(t: pa.Table, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All distinct keys of a bucket, and how many contexts each has in toxic and in ordinary rows."""
    base = np.uint64(t.column("bucket")[0].as_py()) << np.uint64(shift)
    keys, places, marks = [], [], []
    for r in t.to_pylist():
        keys.append(np.cumsum(_grown(r["pairs"], r["n_pairs"], np.uint64), dtype=np.uint64) + base)
        places.append(np.cumsum(_grown(r["places"], r["n_contexts"], np.uint32), dtype=np.int64))
        marks.append(_grown(r["contexts"], r["n_contexts"], np.uint32))
    own = distinct(np.concatenate(keys))
    seen = [(np.searchsorted(own, k)[p].astype(np.uint64) << MARK_BITS) | m for k, p, m in zip(keys, places, marks, strict=True)]
    seen = distinct(np.concatenate(seen))
    place, toxic = (seen >> MARK_BITS).astype(np.int64), (seen & np.uint64(1)).astype(bool)
    count = lambda at: np.bincount(at, minlength=len(own))
    return own, count(place[toxic]), count(place[~toxic])


def expression_counts(rows: DataFrame) -> DataFrame:
    """kind (0: words, 1: pairs), key and COUNTS over all rows of s_label (2 toxic, 1 ordinary, else null) and s_text.

    t, o, pooled: distinct words before the word in toxic, ordinary and all rows (of pairs: contexts before the pair);
    ht, ho, ft, fo: contexts and number of the different pairs that the word begins. Pairs that no class has behind two words
    are not rows: their discount takes all there is of them, and Model.ratios gives them no share, so they would change nothing."""
    chars = rows.agg(F.sum(F.length("s_text"))).first()[0] or 0
    shift = 2 * BITS - max(4, math.ceil(math.log2(max(1, chars / 6 / BUCKET_WORDS))))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PACKED.split(", ")]
        held: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            parts = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            for row in packed(*parts, shift):
                yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))])

        kept(("toxicity",), dict)
        for b, part in text_slices(batches, 1, TEXT_ROWS):
            ids, ends = numbers_of(part)
            label = np.repeat(b.column(0).fill_null(0).to_numpy(), np.diff(ends, prepend=0)).astype(np.int8)
            before = _before(ids, ends)
            held.append((pair_key(before, ids), _before(before, ends).astype(np.int32), label))
            if sum(len(h[0]) for h in held) > PACK_WORDS:
                yield from out()
        if held and any(len(h[0]) for h in held):
            yield from out()
        give_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("toxicity",), dict)
        for t in by_group(batches, ["bucket"]):
            own, toxic, ordinary = unpacked(t, shift)
            before, word = split_key(own)
            by, at = np.unique(word, return_inverse=True)
            n = lambda of, weights, size: np.bincount(of, weights, size).astype(np.int64)
            none = [np.zeros(len(by), np.int64)] * 4
            yield _count_rows(0, by, [n(at, toxic > 0, len(by)), n(at, ordinary > 0, len(by)), n(at, None, len(by)), *none])
            seen = np.flatnonzero((toxic + ordinary > 0) & (before > 0))
            before, word, toxic, ordinary = before[seen], word[seen], toxic[seen], ordinary[seen]
            by, at = np.unique(before, return_inverse=True)
            none = [np.zeros(len(by), np.int64)] * 3
            yield _count_rows(0, by, [*none, n(at, toxic, len(by)), n(at, ordinary, len(by)), n(at, toxic > 0, len(by)), n(at, ordinary > 0, len(by))])
            some = np.flatnonzero(np.maximum(toxic, ordinary) > 1)
            none = [np.zeros(len(some), np.int64)] * 5
            yield _count_rows(1, (before[some] << BITS) | word[some], [toxic[some], ordinary[some], *none])
        give_back()

    blobs = rows.select(F.col("s_label").cast("int"), "s_text").mapInArrow(gather, PACKED)
    dealt = blobs.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "bucket").sortWithinPartitions("bucket")
    counted = dealt.mapInArrow(merge, "kind int, key long, " + ", ".join(f"{c} long" for c in COUNTS))
    with batches_of(rows.sparkSession, TEXT_ROWS), shuffles_dropped(rows.sparkSession):
        return materialise(counted.groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in COUNTS]))


def _count_rows(kind: int, keys: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), *map(pa.array, (keys, *columns))], ["kind", "key", *COUNTS])


def _looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of asked keys in a table sorted by its keys (zeros for those it hasn't), and which it hasn't."""
    out, absent = np.zeros((len(asked), values.shape[1]), np.float32), np.ones(len(asked), bool)
    if len(keys) and len(asked):
        order = np.argsort(asked)  # places of sorted keys are found faster
        own = asked[order]
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == own)
        out[order[hit]] = values[at[hit]]
        absent[order[hit]] = False
    return out, absent


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether sorted keys have each value."""
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _bit_places(keys: np.ndarray, size: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def _key_bits(keys: DataFrame) -> np.ndarray:
    """A filter of keys as bits: all that are in the table pass, and few others (more of them where MOST_BITS are too few)."""
    size = 1 << min(max(16, (16 * keys.count()).bit_length()), MOST_BITS.bit_length() - 1)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                place = distinct(_bit_places(b.column(0).to_numpy(), size))
                starts = np.flatnonzero(np.diff(place >> 6, prepend=-1))
                value = np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), starts)
                yield pa.RecordBatch.from_arrays([pa.array(place[starts] >> 6), pa.array(value.view(np.int64))], ["w", "b"])

    got = keys.select("key").mapInArrow(bits, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(size >> 6, np.uint64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


class Slots:
    """A bounded table from keys to counts: all of them, or, of more than size keys, the WAYS of each slot with most contexts (then the largest).

    The others are in `more`, a table in the shared folder that only the driver knows (None if there are none); `bits` is a filter of their keys."""

    def __init__(self, counts: DataFrame, columns: list[str], size: int) -> None:
        self.more = self.bits = None
        if counts.count() > size:
            slot = F.pmod(F.xxhash64("key"), F.lit(max(1, size // WAYS))).cast("int")
            order = Window.partitionBy("slot").orderBy(F.desc(F.col("t") + F.col("o") + F.col("ht") + F.col("ho")), F.desc("key"))
            with shuffles_dropped(counts.sparkSession):
                ranked = materialise(counts.withColumn("slot", slot).withColumn("rank", F.row_number().over(order)))
            self.more = ranked.where(F.col("rank") > WAYS).drop("slot", "rank")
            self.bits = _key_bits(self.more)
            counts = ranked.where(F.col("rank") <= WAYS)
        got = counts.select("key", *[F.col(c).cast("float").alias(c) for c in columns]).toArrow()
        keys = got.column("key").to_numpy()
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = np.column_stack([got.column(c).to_numpy()[order] for c in columns])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"more": None}

    def rows(self, keys: np.ndarray, more: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The counts of keys; zeros for those that neither the table nor more (sorted keys, counts) has."""
        out, absent = _looked_up(self.keys, self.values, keys)
        if more is not None and absent.any():
            out[absent] = _looked_up(*more, keys[absent])[0]
        return out

    def elsewhere(self, keys: np.ndarray) -> np.ndarray:
        """Those of distinct keys that may be in `more`."""
        if self.bits is None or not len(keys):
            return keys[:0]
        keys = keys[_looked_up(self.keys, self.values[:, :0], keys)[1]]
        place = _bit_places(keys, len(self.bits) << 6)
        return keys[(self.bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1]


class Model:
    """Log-likelihood ratios (toxic over ordinary) of expressions from the count tables."""

    def __init__(self, counts: DataFrame, cutoff: int) -> None:
        words = counts.where("kind = 0")
        sums = words.agg(F.sum("t"), F.sum("o"), F.count_if(F.col("t") > 0), F.count_if(F.col("o") > 0), F.sum("pooled"), F.count("*")).first()
        totals = np.array([x or 0 for x in sums], float)
        self.total, self.pooled, self.n = np.maximum(totals[:2], 1), totals[4], totals[5]
        self.rest = (DISCOUNT * totals[2:4] / self.total).clip(1e-4, 1)
        self.words = Slots(words.where("t + o + ht + ho > 0"), COUNTS, WORD_SLOTS)  # the others have no ratio of their own
        self.pairs = Slots(counts.where("kind = 1"), ["t", "o"], PAIR_SLOTS)
        self.cutoff, self.curve, self.window, self.name = cutoff, np.zeros(3), 1, uuid.uuid4().hex

    def more(self) -> DataFrame | None:
        """kind, key and COUNTS of the expressions that have no place in the tables."""
        parts = [t.more.select(F.lit(kind).alias("kind"), "key", *COUNTS) for kind, t in enumerate((self.words, self.pairs)) if t.more is not None]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def elsewhere(self, ids: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Keys of words and of pairs that texts ask of `more`."""
        before = _before(ids, ends)
        return [self.words.elsewhere(distinct(ids)), self.pairs.elsewhere(distinct((before << BITS | ids)[before > 0]))]

    def asks(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the ratio of each word takes a count that may be in `more`."""
        words, pairs = self.elsewhere(ids, ends)
        before = _before(ids, ends)
        return _among(ids, words) | _among(before, words) | (_among(before << BITS | ids, pairs) & (before > 0))

    def share(self, n: np.ndarray) -> np.ndarray:
        return np.minimum(n / self.cutoff, 1) ** 2

    def ratios(self, ids: np.ndarray, ends: np.ndarray, more: list | None = None) -> np.ndarray:
        """The ratio of each word; more: what of `more` the texts ask for, of words and of pairs, each as sorted keys and counts."""
        more_words, more_pairs = more or (None, None)
        each, at = np.unique(ids, return_inverse=True)
        table = self.words.rows(each, more_words).astype(float)
        counts, pooled, begun, followers = table[:, :2], table[:, 2], table[:, 3:5], table[:, 5:7]
        shared = (pooled + 0.5) / (self.pooled + 0.5 * (self.n + 1))
        one = np.maximum(counts - DISCOUNT, 0) / self.total + self.rest * shared[:, None]
        single = np.log(one[:, 0] / one[:, 1])
        history = np.maximum(begun, 1)
        back = np.where(begun > 0, np.clip(followers / history, 0.05, 1), 1.0)
        backoff = np.log(back[:, 0] / back[:, 1]) * self.share(begun.sum(1))
        own = self.share(counts.sum(1))
        out = own[at] * single[at]
        before = _before(ids, ends)
        inner = np.flatnonzero(before)
        b, a = at[inner], at[inner - 1]
        out[inner] += own[b] * backoff[a]
        pair = self.pairs.rows((before[inner] << BITS) | ids[inner], more_pairs).astype(float)
        # Of one context nothing is left behind the discount: such a pair says what its word does.
        seen = np.flatnonzero(pair.max(1, initial=0) > 1)
        a, b, pair, inner = a[seen], b[seen], pair[seen], inner[seen]
        two = np.maximum(pair - 1, 0) / history[a] + back[a] * one[b]
        share = self.share(pair.sum(1))
        out[inner] = share * np.log(two[:, 0] / two[:, 1]) + (1 - share) * out[inner]
        return out

    def scores(self, best: np.ndarray, whole: np.ndarray) -> np.ndarray:
        z = self.curve[0] + self.curve[1] * best + self.curve[2] * whole
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge; columns are scaled inside."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-6, 1e-2, 1e-2])
        step = np.linalg.solve(h, z.T @ (y - p) - np.array([0, 1e-2, 1e-2]) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w / np.concatenate(([1.0], scale))


def log_loss(curve: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    z = np.clip(curve[0] + x @ curve[1:], -30, 30)
    return float(np.mean(np.logaddexp(0, z) - y * z))


def _sums(ratios: np.ndarray, ends: np.ndarray, windows: list[int], asks: np.ndarray | None = None) -> np.ndarray:
    """For each run of words the sum of its ratios, then the best ratio per word of each length of window without a word that asks; -inf if there is none."""
    sizes = np.diff(ends, prepend=0)
    out = np.full((len(ends), 1 + len(windows)), -np.inf)
    sums = np.concatenate(([0.0], np.cumsum(ratios)))
    out[:, 0] = sums[ends] - sums[ends - sizes]
    some = np.flatnonzero(sizes)
    starts = (ends - sizes)[some]
    at, end_of, start_of = np.arange(len(ratios)), np.repeat(ends, sizes), np.repeat(ends - sizes, sizes)
    asked = None if asks is None else np.concatenate(([0], np.cumsum(asks)))
    for c, w in enumerate(windows if len(some) else [], 1):
        last = np.minimum(at + w, end_of)
        value = sums[last] - sums[at]
        value[(at + w > end_of) & (at != start_of)] = -np.inf
        if asked is not None:
            value[asked[last] > asked[at]] = -np.inf
        out[some, c] = np.maximum.reduceat(value, starts) / w
    return out


def partial_features(model: Model, rows: list[str], windows: list[int]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """For each text its number of words, _sums without the words left open, and those: runs of numbers (4 bytes each), in front of each its FRONT.

    Open are the words that ask of `more` and all that share a window with one, so each window lies in a run or has no word that asks."""
    ids, ends = numbers_of(rows)
    sizes = np.diff(ends, prepend=0)
    ratios = model.ratios(ids, ends)
    asks = model.asks(ids, ends)
    hit = np.flatnonzero(asks)
    if not len(hit):
        return sizes, _sums(ratios, ends, windows), [b""] * len(rows)
    begin, reach = np.repeat(ends - sizes, sizes), max(windows)
    lo, hi = np.maximum(hit - reach + 1, begin[hit]), np.minimum(hit + reach, np.repeat(ends, sizes)[hit])
    inside = np.cumsum(np.bincount(lo, minlength=len(ids) + 1) - np.bincount(hi, minlength=len(ids) + 1))[:-1] > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (begin[1:] == np.arange(1, len(ids)))
    own, first = np.flatnonzero(inside), np.flatnonzero(first)
    numbers = np.insert(ids[own], np.searchsorted(own, first), _before(ids, ends)[first] | FRONT).astype(np.int32)
    cuts = [0, *(np.searchsorted(own, ends) + np.searchsorted(first, ends)).tolist()]
    out = _sums(np.where(inside, 0.0, ratios), ends, [])
    out = np.column_stack([out, _sums(ratios, ends, windows, asks)[:, 1:]])
    return sizes, out, [numbers[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]


def _open_words(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the open words of some texts with those in front, where each run begins and ends, and the text it is of."""
    numbers = np.frombuffer(b"".join(rows), np.int32).astype(np.int64)
    first = np.flatnonzero(numbers >= FRONT)
    ends = np.append(first[1:], len(numbers))[: len(first)]
    return numbers & (FRONT - 1), first, ends, np.searchsorted(np.cumsum([len(r) // 4 for r in rows]), first, side="right")


def with_open(model: Model, sums: np.ndarray, rows: list[bytes], windows: list[int], more: list | None) -> np.ndarray:
    """The sums of texts, with the words that partial_features left open."""
    numbers, first, ends, of = _open_words(rows)
    if not len(first):
        return sums
    own = _sums(np.delete(model.ratios(numbers, ends, more), first), ends - np.arange(1, len(ends) + 1), windows)
    out = sums.copy()
    out[:, 0] += np.bincount(of, own[:, 0], len(rows))
    np.maximum.at(out[:, 1:], of, own[:, 1:])
    return out


def features(sizes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """For each text the whole's ratio per word, then the best ratio per word of each length of window; NaN without words."""
    out = np.column_stack([sums[:, 0] / np.maximum(sizes, 1), sums[:, 1:]])
    out[sizes == 0] = np.nan
    return out


def train(
    docs: DataFrame, labels: DataFrame, per_class: int = 3000, cutoff: int = 8, windows: tuple[int, ...] = (1, 2, 4, 8),
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows=None,
) -> Model | None:
    """A model from all labelled rows, its curve from at most per_class of a class; None without documents of both classes."""
    spark = docs.sparkSession
    labelled = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    labelled = labelled if train_rows is None else labelled.where(train_rows)
    of = lambda c, n: sample_ids(labelled.where(F.col(label_col) == c), id_col, label_col, n)
    part = F.pmod(F.xxhash64(F.lit("part"), "s_id"), F.lit(5))
    ids = of(1, per_class).unionByName(of(0, 3 * per_class)).groupBy("s_id").agg(F.max("s_class").cast("int").alias("s_class")).where(part >= 3)
    ids = materialise(ids)
    own = docs.select(F.col(id_col).alias("s_id"), text_of(text_col).alias("s_text"))
    counted = labelled.groupBy(F.col(id_col).alias("s_id")).agg((1 + F.max(F.col(label_col))).cast("int").alias("s_label"))
    counted = materialise(counted.join(F.broadcast(ids.select("s_id")), "s_id", "left_anti"))
    marked = own.join(F.broadcast(counted) if counted.count() <= BROADCAST_LABELS else counted, "s_id", "left")
    model = Model(expression_counts(marked), cutoff)
    half = F.pmod(F.xxhash64(F.lit("half"), "s_id"), F.lit(2)).cast("int")
    rows = own.join(F.broadcast(ids), "s_id").select(F.col("s_class").cast("int").alias("y"), half.alias("half"), "s_text")
    measured = lambda model, x: pa.array(list(x), pa.list_(pa.float64()))
    with batches_of(spark, TEXT_ROWS):
        got = _with_texts(rows, model, ["y", "half"], "s_text", list(windows), measured, T.StructField("x", T.ArrayType(T.DoubleType()))).toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(len(got), 1 + len(windows))
    y, second = got.column("y").to_numpy().astype(float), got.column("half").to_numpy() == 1
    whole = ~np.isnan(x[:, 0])
    x, y, second = x[whole], y[whole], second[whole]
    if not len(y) or len(set(y)) < 2 or not len(model.words.keys):
        return None
    pick = lambda c: x[:, [c, 0]]
    at = 1
    if min(len(set(y[second])), len(set(y[~second]))) == 2:
        loss = [log_loss(fit_curve(pick(c)[~second], y[~second]), pick(c)[second], y[second]) for c in range(1, 1 + len(windows))]
        at = 1 + int(np.argmin(loss))
    model.window, model.curve = windows[at - 1], fit_curve(pick(at), y)
    return model


#: Scores from here on are called toxic.
THRESHOLD = 0.7


def _with_texts(docs: DataFrame, model: Model, names: list[str], text_col: str, windows: list[int], make: Callable, field: T.StructField) -> DataFrame:
    """The columns in names and what make(model, features) gives for the texts of some rows."""
    (text,) = unused([*names, field.name], "text_scored")
    rows = docs.select(*names) if text_col in names else docs.select(*names, F.col(text_col).alias(text))
    at, own = rows.columns.index(text_col if text_col in names else text), [*names, field.name]
    schema = T.StructType([*rows.select(*names).schema.fields, field])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    made = lambda columns, sizes, sums: pa.RecordBatch.from_arrays([*columns, make(sent.value, features(sizes, sums))], own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("toxicity",), dict)
        for b, part in text_slices(batches, at, TEXT_ROWS):
            yield made(b.columns[: len(names)], *partial_features(sent.value, part, windows)[:2])
        give_back()

    more = model.more()
    if more is None:
        return rows.mapInArrow(run, schema)

    # What texts leave open and what that asks of the shared folder meet in groups.
    left = ["s_size", "s_sums", "s_open"]

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("toxicity",), dict)
        for b, part in text_slices(batches, 1, TEXT_ROWS):
            sizes, sums, words = partial_features(sent.value, part, windows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes.astype(np.int64)), pa.array(list(sums), pa.list_(pa.float64())), pa.array(words, pa.binary())], ["s_row", *left])
        give_back()

    row = T.StructField("s_row", rows.select(F.struct(*names).alias("r")).schema["r"].dataType)
    kinds = [T.StructField(c, k) for c, k in zip(left, (T.LongType(), T.ArrayType(T.DoubleType()), T.BinaryType()), strict=True)]
    with batches_of(docs.sparkSession, TEXT_ROWS):
        partial = materialise(rows.select(F.struct(*names).alias("s_row"), F.col(rows.columns[at]).alias("s_text")).mapInArrow(leave, T.StructType([row, *kinds])))
    size = F.octet_length("s_open")
    groups = max(1, math.ceil((partial.agg(F.sum(size)).first()[0] or 0) / 4 * WORD_CHARS / GROUP_CHARS))
    hashed = [f"s_row.`{c}`" for c, kind in rows.select(*names).dtypes if "map<" not in kind and "variant" not in kind]
    opened = partial.where(size > 0).withColumn("s_group", F.pmod(F.xxhash64("s_open", *hashed), F.lit(groups)).cast("int"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield made(b.column(0).flatten(), *_sized(b, 1))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("toxicity",), dict)
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXT_ROWS):
                b = whole.slice(lo, TEXT_ROWS)
                place, words = b.column(0).to_numpy(), np.array([*b.column(1).to_pylist(), None], object)[:-1]
                for g in np.unique(place).tolist():
                    numbers, _, ends, _ = _open_words(words[place == g].tolist())
                    for kind, keys in enumerate(sent.value.elsewhere(numbers, ends)):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), g, np.int32)), pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys)], ["s_group", "kind", "key"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("toxicity",), dict)
        now, counts, got = None, [], []
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXT_ROWS):
                b = whole.slice(lo, TEXT_ROWS)
                place, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
                cuts = np.flatnonzero(np.diff(place) | np.diff(kind)) + 1
                for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)], strict=True):
                    if place[i] != now:
                        now, counts, got = place[i], [[], []], None
                    part = b.slice(i, j - i)
                    if kind[i] < 2:
                        counts[kind[i]].append(part.select(["key", *COUNTS]))
                        continue
                    if got is None:
                        got = [_sorted_counts(c, names_) for c, names_ in zip(counts, (COUNTS, ["t", "o"]), strict=True)]
                        counts = [[], []]
                    sizes, sums = _sized(part, part.num_columns - 3)
                    words = part.column(part.num_columns - 1).to_pylist()
                    yield made(part.column(part.num_columns - 4).flatten(), sizes, with_open(sent.value, sums, words, windows, got))
        give_back()

    asked = opened.select("s_group", "s_open").mapInArrow(ask, "s_group int, kind int, key long").distinct()
    found = asked.join(more, ["kind", "key"]).select("s_group", "kind", "key", *COUNTS, *[F.lit(None).cast(f.dataType).alias(f.name) for f in (row, *kinds)])
    none = [F.lit(None).cast("long").alias(c) for c in ("key", *COUNTS)]
    both = found.unionByName(opened.select("s_group", F.lit(2).alias("kind"), *none, "s_row", *left))
    partitions = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = both.repartition(partitions, "s_group").sortWithinPartitions("s_group", "kind").mapInArrow(answered, schema)
    return partial.where(size == 0).select("s_row", *left[:2]).mapInArrow(finish, schema).union(met)


def _sized(b: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words and sums of texts, from the columns at `at`."""
    return b.column(at).to_numpy(), np.array(b.column(at + 1).to_pylist(), float)


def _sorted_counts(parts: list[pa.RecordBatch], columns: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
    if not parts:
        return None
    t = pa.Table.from_batches(parts)
    keys = t.column("key").to_numpy()
    order = np.argsort(keys)
    return keys[order], np.column_stack([t.column(c).to_numpy()[order].astype(np.float32) for c in columns])


def score(docs: DataFrame, model: Model | None, text_col: str = "text", carry: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """The columns in carry (all by default) and the score of every row (its column's name grows by _ where docs has it)."""
    names = docs.columns if carry is None else carry
    (out,) = unused(names, score_col)
    if model is None:
        return docs.select(*names, F.lit(0.0).alias(out))

    def scores(model: Model, got: np.ndarray) -> pa.Array:
        return pa.array(np.where(np.isnan(got[:, 0]), 0.0, model.scores(got[:, 1], got[:, 0])), pa.float64())

    return _with_texts(docs, model, names, text_col, [model.window], scores, T.StructField(out, T.DoubleType()))


def without_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold."""
    with batches_of(docs.sparkSession, TEXT_ROWS):
        if model is None or model.more() is None:
            scored = score(docs, model, text_col)
            return materialise(scored.where(F.col(scored.columns[-1]) < THRESHOLD).select(*docs.columns))
        # Scores go by the text, so toxic texts are known by 128 bits of hash, and no other is dealt out to be scored. Rows that the filter of toxic
        # texts doesn't let pass stay where they are; the others that score below are few and have a filter of their own, so toxic texts aren't dealt out either.
        *keys, bits, bits_2 = unused(docs.columns, "text_hash", "text_hash_2", "key_bits", "key_bits_2")
        hashes = [F.xxhash64(text_col), F.xxhash64(F.lit(1), text_col)]
        out = score(docs.select(*[h.alias(k) for h, k in zip(hashes, keys, strict=True)], F.col(text_col).alias("s_text")), model, "s_text", keys)
        verdicts = materialise(out.groupBy(*keys).agg(F.max(F.col(out.columns[-1]) >= THRESHOLD).alias("gone")))
        table, passes = key_filter(verdicts.where("gone").select(*keys), (*keys, bits))
        spared = materialise(verdicts.where("NOT gone").join(table, passes).select(*keys))
        table_2, passes_2 = key_filter(spared, (*keys, bits_2))
        rows = docs.withColumns(dict(zip(keys, hashes, strict=True)))
        asked = materialise(rows.join(table, passes).join(table_2, passes_2).drop(bits, bits_2))  # else Spark has the semi join, and so a shuffle, before the filters
        return materialise(rows.join(table, ~passes).select(*docs.columns).unionByName(asked.join(spared, keys, "left_semi").select(*docs.columns)))


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: the model learns only from rows that aren't held out (fold 1 of 3)."""
    model = train(docs, labels, train_rows=fold("doc_id", 3) != 1)
    with batches_of(docs.sparkSession, TEXT_ROWS):
        out = materialise(score(docs.select("doc_id", "text"), model, carry=["doc_id"]))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
