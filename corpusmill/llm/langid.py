"""Language spans of mixed-language text: script ranges, per-word scores, and a Viterbi path.

Training counts character 1- to 3-grams of words in a bounded sample (per_language documents of
each language, by hash order of their ids) and keeps smoothed log-probabilities in hashed tables. Every word
of the sample counts, of any length; counts are summed by slot before they come to the driver.
A word's script leaves only the languages that use this script in training (all of them where
none does); a word's scores are its n-grams' summed log-probabilities, and a Viterbi path over the
words labels each with one language, every change of language costing `switch`. A text's language
is the one with the most letters along the path; its score is that share of the letters, times how sure the
path's scores are of it against the next best language over the same words.

Texts that are null, empty or have no letter (Unicode category L) are `und` with score 0. Words without letters
belong to no span. With no labelled text at all every text is `und`; an empty table gives an empty result. Ties go to
the language first by name. Repeated rows each get their result; texts of any length are read whole, several
thousand words or one long text at a time. Columns of docs may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Runs, fold, letter_signs, lowered, sample_ids, text_of, texts

SLOTS, ORDER = 1 << 15, 3
#: First code points of script ranges (Unicode blocks) and their names; a range ends where the next begins.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0B80, "tamil"), (0x0E00, "thai"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0x20000, "han"),
]
STARTS = np.array([a for a, _ in SCRIPTS])


def words_of(rows: list[str]) -> Runs:
    return Runs.of([lowered(t) for t in rows], letter_signs())


def scripts_of(words: Runs) -> np.ndarray:
    """The script of each word, that of its first letter."""
    return np.array([name for _, name in SCRIPTS])[np.searchsorted(STARTS, words.codes[words.starts], side="right") - 1]


def gram_slots(words: Runs) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1 to 3 the hashed n-grams of all words with their borders, and where each word's begin."""
    letters, place = words.spread()
    sizes = words.sizes + 2
    first = np.cumsum(sizes) - sizes
    codes = np.full(int(sizes.sum()), ord("$"), np.uint32)
    codes[first] = ord("^")
    codes[np.repeat(first + 1, words.sizes) + place] = letters
    left = np.repeat(first + sizes, sizes) - np.arange(len(codes))  # characters from here to the word's end
    key = codes.astype(np.uint64)
    for n in range(1, ORDER + 1):
        if n > 1:
            key = key[:-1] * np.uint64(1_000_003) + codes[n - 1 :]
        own = (left > 1) & (left < np.repeat(sizes, sizes)) if n == 1 else left[: len(key)] >= n
        taken = sizes - 2 if n == 1 else sizes - n + 1
        yield ((key[own] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64), np.cumsum(taken) - taken


class Model:
    """Per-language log-probabilities of hashed n-grams, and each script's languages."""

    def __init__(self, slots: list[tuple[str, int, int]], scripts: list[tuple[str, str, int]]) -> None:
        """slots: language, slot, occurrences of its n-grams; scripts: language, script, words in it."""
        self.langs = sorted({lang for lang, _, _ in slots})
        at = {lang: i for i, lang in enumerate(self.langs)}
        table = np.full((SLOTS, len(self.langs)), 0.5)
        seen: dict[str, np.ndarray] = {}
        for lang, slot, n in slots:
            table[slot, at[lang]] += n
        for lang, script, n in scripts:
            seen.setdefault(script, np.zeros(len(self.langs)))[at[lang]] += n
        # A language uses a script that makes up a hundredth of its words at least.
        total = sum(seen.values(), np.zeros(len(self.langs)))
        self.scripts = {s: v >= 0.01 * np.maximum(total, 1) for s, v in seen.items()}
        self.scripts = {s: v if v.any() else np.ones(len(v), bool) for s, v in self.scripts.items()}
        self.logp = np.log(table / table.sum(0)).astype(np.float32)

    def word_scores(self, words: Runs) -> np.ndarray:
        """A row of scores for each word, 0 for its best language."""
        out = np.zeros((len(words.starts), len(self.langs)), np.float32)
        for slots, starts in gram_slots(words):
            out += np.add.reduceat(self.logp[slots], starts)
        names = scripts_of(words)
        for script, allowed in self.scripts.items():
            if not allowed.all():
                own = np.flatnonzero(names == script)
                out[np.ix_(own, np.flatnonzero(~allowed))] = out[own].min(1, keepdims=True) - 50
        return out - out.max(1, keepdims=True)


def spans(scores: np.ndarray, switch: float) -> np.ndarray:
    """Viterbi labels of several texts at once; scores: texts x words x languages, zero beyond a text's words.

    A change of language costs the same from any language, so a step needs only the best state."""
    n, steps, k = scores.shape
    best = scores[:, 0].copy()
    kind = np.uint8 if k <= 256 else np.uint16
    came = np.zeros((steps, n, k), kind)
    stay = np.arange(k, dtype=kind)
    for t in range(1, steps):
        top = best.argmax(1)
        jump = best[np.arange(n), top][:, None] - switch
        change = jump > best
        came[t] = np.where(change, top[:, None], stay)
        best = np.where(change, jump, best) + scores[:, t]
    label = np.empty((n, steps), kind)
    state = best.argmax(1)
    rows = np.arange(n)
    for t in range(steps - 1, -1, -1):
        label[:, t] = state
        state = came[t, rows, state]
    return label


#: Distinct words that are scored at once, and scores (words times languages) of texts that are labelled at once.
WORD_BATCH, BLOCK_SCORES = 65_536, 4_000_000


def label(model: Model, rows: list[str], switch: float) -> list[tuple[list[tuple[int, int, int]], str, float]]:
    """For each text its spans (first character, end, language number), language and score."""
    out: list = [([], "und", 0.0)] * len(rows)
    words = words_of(rows)
    if not model.langs or not len(words.starts):
        return out
    _, first, number = np.unique(words.hashes(), return_index=True, return_inverse=True)
    # The scores of each distinct word; row 0 (all zeros) stands beyond a text's words.
    table = [np.zeros((1, len(model.langs)), np.float32)]
    for i in range(0, len(first), WORD_BATCH):
        own = first[i : i + WORD_BATCH]
        table.append(model.word_scores(Runs(words.codes, words.starts[own], words.sizes[own], words.offsets, words.ends)))
    scores = np.concatenate(table)
    counts = np.diff(words.ends, prepend=0)
    begins = words.ends - counts
    order = np.argsort(counts, kind="stable")
    order = order[counts[order] > 0]
    at, k = 0, len(model.langs)
    while at < len(order):
        # Texts of like length together, so that little of the block is empty.
        end = at + 1
        while end < len(order) and end - at < 256 and int(counts[order[end]]) * (end + 1 - at) * k <= BLOCK_SCORES:
            end += 1
        own = order[at:end]
        steps = int(counts[own[-1]])
        inside = np.arange(steps) < counts[own][:, None]
        place = np.where(inside, np.arange(steps) + begins[own][:, None], 0)
        block = scores[np.where(inside, number[place] + 1, 0)]
        labels = spans(block, switch)
        for r, i in enumerate(own.tolist()):
            n, lo = int(counts[i]), int(begins[i])
            starts = words.starts[lo : lo + n] - words.offsets[i]
            out[i] = summary(model, starts, words.sizes[lo : lo + n], labels[r, :n], block[r, :n])
        at = end
    return out


def summary(model: Model, starts: np.ndarray, sizes: np.ndarray, path: np.ndarray, scores: np.ndarray) -> tuple:
    letters = np.bincount(path, sizes, len(model.langs))
    lang = int(letters.argmax())
    own = scores[path == lang].sum(0)
    rivals = np.delete(own, lang)
    margin = float(own[lang] - rivals.max()) if len(rivals) else 30.0
    sure = 1 / (1 + np.exp(-min(max(margin, -30), 30)))
    cut = np.flatnonzero(path[1:] != path[:-1]) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(path)] - 1
    found = list(zip(starts[first].tolist(), (starts[last] + sizes[last]).tolist(), path[first].tolist(), strict=True))
    return found, model.langs[lang], float(letters[lang] / letters.sum() * sure)


def train(docs: DataFrame, per_language: int = 500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows=None) -> Model:
    """A model from at most per_language labelled documents of each language, of as many languages as there are."""
    labelled = docs if train_rows is None else docs.where(train_rows)
    ids = sample_ids(labelled.where(F.col(text_col).isNotNull()), id_col, lang_col, per_language)
    own = docs.select(F.col(id_col).alias("s_id"), F.col(lang_col).alias("s_class"), text_of(text_col).alias("s_text"))
    rows = own.join(ids, ["s_id", "s_class"]).select(F.col("s_class").cast("string").alias("lang"), "s_text")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[str, np.ndarray] = {}
        scripts: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of([text])
                if lang not in slots:
                    slots[lang] = np.zeros(SLOTS, np.int64)
                for found, _ in gram_slots(words):
                    slots[lang] += np.bincount(found, minlength=SLOTS)
                for script, n in zip(*np.unique(scripts_of(words), return_counts=True), strict=True):
                    scripts[lang, str(script)] += int(n)
        out = [(lang, int(i), None, int(t[i])) for lang, t in slots.items() for i in np.flatnonzero(t)]
        out += [(lang, None, script, n) for (lang, script), n in scripts.items()]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        kinds = pa.string(), pa.int32(), pa.string(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["lang", "slot", "script", "n"])

    # What comes to the driver is bounded by the slots and scripts of each language.
    partial = rows.mapInArrow(sums, "lang string, slot int, script string, n long")
    got = partial.groupBy("lang", "slot", "script").agg(F.sum("n").alias("n")).collect()
    return Model([(r[0], r[1], r[3]) for r in got if r[1] is not None], [(r[0], r[2], r[3]) for r in got if r[1] is None])


def identify(docs: DataFrame, model: Model, switch: float = 8.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans (array of start, end, lang) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = sent.value.langs
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                got = label(sent.value, texts(b.column(1)), switch)
                found = [[{"start": a, "end": e, "lang": langs[i]} for a, e, i in s] for s, _, _ in got]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.float64()), pa.array(found, pa.list_(span))],
                    ["doc_id", "lang_pred", "score", "spans"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def identify_held_out(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans: the model learns only from rows that aren't held out (fold 2 of 4)."""
    model = train(docs, train_rows=fold("doc_id", 4) != 2)
    out = identify(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "spans")
