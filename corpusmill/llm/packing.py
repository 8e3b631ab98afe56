"""Packing of documents into fixed-length token sequences along a Hilbert curve.

Each document's token ids are counted into a hashed vector, which a fixed random matrix projects to
DIMS dimensions; the Hilbert index of the quantised point orders the documents, so neighbours on the
curve have similar words. Documents are range-sorted by that key (ties, such as copies, by a hash of
id and text) and laid end to end: a sequence is the next `length` tokens of this one stream, so only
the last sequence of the whole output has padding. Documents are cut where a sequence ends.

The ranges' token totals (one number a range, whose count is bounded) give each range its place in
the stream; the rest is done by the ranges on their own, one after another in memory-bounded
batches. Texts are tokenized once: ids go to the shared work folder, in two bytes each where the
vocabulary allows.

Nulls count as the empty text, which has the end id alone; a null id stays null. Repeated rows are
packed as often as they occur. An empty table gives no pieces. A very long text is encoded whole by one task and cut
into pieces one after the other. Of docs only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Runs, batches_of, give_back, kept, materialise, text_of, texts

DIMS, BITS, VECTOR = 4, 8, 512
#: Different words whose ids a worker keeps.
MOST_WORDS = 800_000
#: Rows of an Arrow batch with texts.
TEXT_ROWS = 512


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows; values of `bits` bits), by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class WordTokenizer:
    """Ids of whole texts by a tokenizers file whose pre-tokenizer drops white space.

    White space always parts tokens, and so does the place between a letter and a full stop or comma;
    what lies between such places is encoded once and cached. Texts are lower-cased before if the
    tokenizer does so and composition (NFC) can't tell the difference."""

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        probe = self.encode_many(["a b", "a", "b", "A", "a."])
        if probe[0] != probe[1] + probe[2] or probe[4][:1] != probe[1]:
            raise ValueError("this tokenizer keeps white space; words cannot be encoded apart")
        self.lowers = probe[1] == probe[3]
        size = self.tokenizer.get_vocab_size()
        self.wide = size > 65_536
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        #: Tokens that end a word; a word of letters has one of them, its last.
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.letter = np.zeros(256, bool)
        self.letter[[*range(65, 91), *range(97, 123)]] = True
        self.white = np.zeros(256, bool)
        self.white[[9, 10, 11, 12, 13, 32]] = True
        self.forget()

    def forget(self) -> None:
        """No words are known: `row` numbers them by hash, `pool` holds their ids one after the other."""
        self.row: dict[int, int] = {}
        self.pool, self.first, self.size = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_many(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def prepared(self, text: str) -> bytes:
        if self.lowers:
            low = text.lower()
            if low.isascii() or ("Σ" not in text and "İ" not in text and is_normalized("NFC", text) and is_normalized("NFC", low)):
                text = low
        return text.encode("utf-8", "replace")

    def learn(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w.isalpha() or w.decode().isalpha()]
        for lo in range(0, len(plain), 1024):
            part = plain[lo : lo + 1024]
            ids = np.array(self.tokenizer.encode(b" ".join([words[i] for i in part]).decode(), add_special_tokens=False).ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                for i, a, b in zip(part, [0, *cuts.tolist()], cuts.tolist(), strict=False):
                    out[i] = ids[a:b]
        others = [i for i, ids in enumerate(out) if ids is None]
        for lo in range(0, len(others), 4096):
            part = others[lo : lo + 4096]
            for i, ids in zip(part, self.encode_many([words[i].decode() for i in part]), strict=True):
                out[i] = np.array(ids, self.dtype)
        return out

    def encode(self, rows: list[str], end: int) -> list[np.ndarray]:
        """The ids of each text, with the end id.

        Words are runs of bytes without white space in all texts together; each different one is looked up once, by a
        64-bit hash, and the ids are put together in arrays."""
        texts_ = [self.prepared(t) for t in rows]
        data = np.frombuffer(b"\n".join(texts_), np.uint8)
        at = np.flatnonzero(((data[1:] == 46) | (data[1:] == 44)) & self.letter[data[:-1]]) + 1
        ends = np.cumsum([len(t) + 1 for t in texts_])
        data, ends = np.insert(data, at, 32), ends + np.searchsorted(at, ends)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~self.white[data]
        edge = np.diff(inside)
        starts = np.flatnonzero(edge == 1)
        words = Runs(data, starts, np.flatnonzero(edge == -1) - starts, ends, ends)
        keys, place, number = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.row) > MOST_WORDS:
            self.forget()
        rowed = np.fromiter(map(self.row.get, keys.tolist(), repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(rowed < 0)
        if len(new):
            begin = starts[place[new]]
            stop = begin + words.sizes[place[new]]
            raw = data.tobytes()
            ids = self.learn([raw[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)])
            rowed[new] = np.arange(len(self.row), len(self.row) + len(new))
            self.row.update(zip(keys[new].tolist(), rowed[new].tolist(), strict=True))
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self.first = np.concatenate((self.first, len(self.pool) + np.cumsum(size) - size))
            self.size, self.pool = np.concatenate((self.size, size)), np.concatenate((self.pool, *ids))
        size = self.size[rowed][number]
        out = self.pool[np.repeat(self.first[rowed][number] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        cuts = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(starts, ends)]
        return np.split(np.insert(out, cuts, end), (cuts + np.arange(1, len(cuts) + 1))[:-1])


def _projection() -> np.ndarray:
    return np.random.default_rng(20240501).standard_normal((VECTOR, DIMS))


def curve_key(ids: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The quantised point of one document: damped counts of hashed ids, unit length, projected."""
    slots = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - VECTOR.bit_length() + 1)
    counts = np.sqrt(np.bincount(slots, minlength=VECTOR))
    point = (counts / np.sqrt((counts * counts).sum())) @ matrix
    return (1 / (1 + np.exp(-1.7 * point)) * ((1 << BITS) - 1)).astype(np.int64)


def encoded(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, place (long: curve key, then hash of id and text), n_tokens, wide, ids (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, matrix = kept(("pack", tokenizer_file), lambda: WordTokenizer(tokenizer_file)), _projection()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                arrays = tok.encode(texts(b.column(2)), end_id)
                key = hilbert_index(np.stack([curve_key(a, matrix) for a in arrays]), BITS)
                place = (key << 31) | b.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(place), pa.array([len(a) for a in arrays], pa.int64()), pa.array([tok.wide] * len(arrays)), pa.array([a.tobytes() for a in arrays], pa.binary())],
                    ["doc_id", "place", "n_tokens", "wide", "ids"],
                )
        give_back()

    tie = F.xxhash64(F.col(id_col), F.col(text_col)).bitwiseAND(F.lit((1 << 31) - 1))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), tie.alias("tie"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, place long, n_tokens long, wide boolean, ids binary")


def _bucket(cuts: list[int]) -> F.Column:
    """Number of cuts that are not above place: among every 128th cut first, then in that stretch."""
    if not cuts:
        return F.lit(0)
    edges = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    coarse = F.array(*map(F.lit, cuts[::128])).cast("array<bigint>")
    base = 128 * (F.size(F.filter(coarse, lambda c: c <= F.col("place"))) - 1)
    return F.when(base < 0, 0).otherwise(base + F.size(F.filter(F.slice(edges, base + 1, 128), lambda c: c <= F.col("place")))).cast("int")


def pack(
    docs: DataFrame, tokenizer_file: str, end_id: int = 2, length: int = 4096, id_col: str = "doc_id", text_col: str = "text", range_tokens: int = 3_000_000, with_ids: bool = True
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (array) if asked for.

    range_tokens: about how many tokens one task lays out (at most 20,000 ranges are made; larger ones stream through
    their tasks in the same memory)."""
    with batches_of(docs.sparkSession, TEXT_ROWS):
        table = materialise(encoded(docs, tokenizer_file, end_id, id_col, text_col))
    total = table.agg(F.sum("n_tokens"), F.count("*")).first()
    ranges = int(min(20_000, max(1, -(-(total[0] or 0) // range_tokens))))
    cuts: list[int] = []
    if ranges > 1:
        asked = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(table.select(F.percentile_approx("place", asked, 10 * ranges)).first()[0]))
    table = table.withColumn("bucket", _bucket(cuts))
    sums = dict(table.groupBy("bucket").agg(F.sum("n_tokens")).collect())
    first: dict[int, int] = {}
    at = 0
    for k in sorted(sums):
        first[k] = at
        at += sums[k]

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, at = None, 0
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc, n, wide, ids, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if b != bucket:
                    bucket, at = b, first[b]
                values = np.frombuffer(ids, "<u4" if wide else "<u2").astype("<u4")
                start = 0
                while start < n:
                    size = min(n - start, length - at % length)
                    piece = values[start : start + size]
                    for c, v in zip(cols, (doc, start, size, zlib.crc32(piece.tobytes()), n, at // length, at % length, piece), strict=True):
                        c.append(v)
                    start += size
                    at += size
                if len(cols[0]) >= 1000:
                    yield _pieces(cols, with_ids)
                    cols = [[] for _ in range(8)]
            if cols[0]:
                yield _pieces(cols, with_ids)

    dealt = table.repartition(max(1, len(sums)), "bucket").sortWithinPartitions("bucket", "place", "doc_id")
    return dealt.select("doc_id", "n_tokens", "wide", "ids", "bucket").mapInArrow(
        lay, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    )


def _pieces(cols: list[list], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    arrays: list = [pa.array(c, pa.int64()) for c in cols[:7]]
    if with_ids:
        ends = np.cumsum([0, *map(len, cols[7])]).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cols[7]).astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names)
