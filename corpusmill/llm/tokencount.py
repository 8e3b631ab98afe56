"""Token counts by heap-and-linked-list byte-pair merging.

The vocabulary is a SentencePiece BPE model with byte fallback. A text becomes one symbol per
character behind a leading word mark; the adjacent pair whose joined piece has the lowest rank is
merged again and again, ties going to the leftmost. The count is the number of initial symbols
less the merges, where a character without a piece counts as its UTF-8 bytes. No ids are made.

No piece holds a word mark after another character and none holds a character outside the
vocabulary's alphabet (both are checked when the model is read), so merges never cross such places:
the text is cut there, and the counts of the resulting units are cached.

When the model is read, texts with what a model may treat on its own (runs of blanks, other white space, marks, characters
outside the alphabet, special strings, compatibility forms) are counted by the library too; a model whose normaliser or
user-defined pieces give other counts is refused.

Nulls count as empty; an empty text has no tokens. Repeated rows give repeated results, an empty table an empty one.
Of docs only the id and the text are read, so other columns may have any names. Long texts are counted whole;
units of over 64 characters are not cached.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, kept, text_of, texts

MARK = "▁"
PROBES = ["", " ", "a", " a", "Hello  world ", "x\ty\r\n z", "é e\u0301 ﬁ ½ 中文 \U0001f600", "<s></s> <unk> <0x41>", "▁▁ a▁b", "1234567 3.14, (a)", "aaaaaaaaaaaaaaaaaaaaaaaa", "\u00a0\u200b\ufeff"]


class MergeCounter:
    """Counts tokens of whole texts with the merge ranks of one model."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.rank: dict[str, float] = {}
        alphabet: set[str] = set()
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i)
            self.rank[piece] = -model.get_score(i)
            if len(piece) == 1:
                alphabet.add(piece)
        for piece in self.rank:
            if not alphabet.issuperset(piece) or (MARK in piece.lstrip(MARK)):
                raise ValueError(f"pieces of this model can join across units: {piece!r}")
        self.alphabet = alphabet
        inside = "".join(re.escape(c) for c in sorted(alphabet - {MARK}))
        self.unit = re.compile(f"{MARK}*[{inside}]+|{MARK}+|[^{inside}{MARK}]+")
        self.cache = WordCache()
        for text in PROBES:
            if self.count(text) != len(model.encode(text)):
                raise ValueError(f"this model treats {text!r} in a way of its own")

    def merged(self, symbols: str) -> int:
        """Symbols left of one unit when no pair can be merged any more."""
        n = len(symbols)
        if n < 2:
            return n
        rank = self.rank
        piece: list[str] = list(symbols)
        left = list(range(-1, n - 1))
        right = [*range(1, n), -1]
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(symbols[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, size = heapq.heappop(heap)
            j = right[i] if piece[i] else -1
            if j < 0 or len(piece[i]) + len(piece[j]) != size:
                continue  # one of the two has been merged since
            piece[i] += piece[j]
            piece[j] = ""
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
            merges += 1
            h = left[i]
            if h >= 0 and (r := rank.get(piece[h] + piece[i])) is not None:
                heapq.heappush(heap, (r, h, len(piece[h]) + len(piece[i])))
            if k >= 0 and (r := rank.get(piece[i] + piece[k])) is not None:
                heapq.heappush(heap, (r, i, len(piece[i]) + len(piece[k])))
        return n - merges

    def unit_count(self, unit: str) -> int:
        if unit[-1] in self.alphabet:
            return self.merged(unit)
        return len(unit.encode("utf-8"))

    def counts(self, rows: list[str]) -> list[int]:
        units = [self.unit.findall(MARK + text.replace(" ", MARK)) if text else [] for text in rows]
        absent = self.cache.absent(set().union(*units))
        known = self.cache.young
        for unit in absent:
            known[unit] = self.unit_count(unit)
        out = [sum([known[u] for u in words]) for words in units]
        for unit in absent:
            if len(unit) > 64:
                del known[unit]
        return out

    def count(self, text: str) -> int:
        return self.counts([text])[0]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(("count", model_file), lambda: MergeCounter(model_file))
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                counts = pa.array(counter.counts(texts(b.column(2))), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), counts], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), text_of(text_col).alias("text")
    )
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
