"""N-gram Jaccard join: links between documents whose sets of word 5-grams have a similarity of 0.8 or more.

1. Each document's words (lower case) give the set of its hashed n-grams; documents with equal sets
   are one class. A text of fewer than n words has one n-gram, its words. MinHash values in bands
   name the candidate buckets of a class.
2. Buckets of two or more classes join each class to the bucket's least class; connected components
   of these star edges hold every candidate pair. A star has one edge a member, not all pairs.
3. A component is cut into blocks of `block` classes (more in large components, up to 16 times as many, so that a class
   meets few blocks; less where texts are long, by `block_grams`), and each pair of blocks is one unit of work.
   A unit gets signatures of 16 bits a value, no texts. For all its pairs MinHash values are compared `step` at a time;
   a pair is dropped as soon as the posterior probability (uniform prior) that its similarity reaches the
   threshold is below `tolerance`. The unit names the classes that have a pair left.
4. Only their texts are fetched (a bit filter of their keys keeps the others where they are), once for each unit that names them, and the pairs that are left are verified exactly
   on the n-gram sets, a strip of rows at a time. A unit returns, for each of its classes, the number of linked
   documents and texts and a label of its linked part; no pairs leave the unit. Labels of components with several
   blocks are joined.

Every candidate pair of a component is compared, whatever its size; nothing is capped. The banding
misses a pair at similarity 0.8 with probability (1 - 0.8^rows)^bands = 6e-5 at the defaults,
and that only if no third text connects the two.

Null and wordless texts have no n-grams: each is a class of its own with no links. Null ids and repeated
rows are allowed: copies are counted by rows; the smallest (id, text hash) stands for a class, and rows that repeat
it are one before its text is fetched. An empty table gives an empty result. A very long text is one set of n-grams, held
by one task at a time with those of its unit. Columns of docs may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, batches_of, by_group, distinct, give_back, kept, key_filter, materialise, mix, text_of, texts, unused, word_hashes

#: Characters that are hashed at once (some 60 bytes of arrays each), and rows of an Arrow batch with texts.
SLICE, TEXT_ROWS = 1 << 20, 500


class Shingler:
    def __init__(self, n: int, hashes: int) -> None:
        self.n = n
        rng = np.random.default_rng(20240607)
        self.factor = (rng.integers(0, 1 << 31, hashes, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.mask = rng.integers(0, 1 << 32, hashes, dtype=np.uint32)

    def sets(self, rows: list[str]) -> list[np.ndarray]:
        """Sorted distinct n-gram hashes of each text; empty without words. Memory follows SLICE and the longest text."""
        out, lo, size = [], 0, 0
        for hi, t in enumerate(rows):
            if hi > lo and size + len(t) > SLICE:
                out += self._sets(rows[lo:hi])
                lo, size = hi, 0
            size += len(t)
        return out + self._sets(rows[lo:])

    def _sets(self, rows: list[str]) -> list[np.ndarray]:
        words, ends = word_hashes(rows)
        rolled = np.full(len(words), self.n, np.uint64)
        # The hash of the n words from each place on; what crosses a text's end is cut off below.
        for k in range(min(self.n, len(words))):
            rolled[: len(words) - k] = rolled[: len(words) - k] * BASE + mix(words[k:] + np.uint64(k))
        rolled = mix(rolled)
        out, start = [], 0
        for end in ends.tolist():
            if end - start >= self.n:
                out.append(distinct(rolled[start : end - self.n + 1]))
            else:
                h = np.full(min(1, end - start), end - start, np.uint64)
                for k in range(end - start):
                    h = h * BASE + mix(words[start + k : start + k + 1] + np.uint64(k))
                out.append(mix(h))
            start = end
        return out

    def signature(self, grams: np.ndarray) -> np.ndarray:
        """MinHash values (32 bits) of a set."""
        low = (grams >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.factor), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(low), 256):
            out = np.minimum(out, ((low[i : i + 256, None] ^ self.mask) * self.factor).min(0))
        return out


def least_matches(step: int, hashes: int, threshold: float, tolerance: float) -> list[int]:
    """For each number of values compared, the least matches with which a pair stays.

    With a uniform prior the posterior after m of k matches is Beta(m+1, k-m+1), whose tail above the
    threshold t is P(Binomial(k+1, t) <= m)."""
    out = []
    for k in range(step, hashes + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out.append(m)
    return out


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def classes_of(docs: DataFrame, n: int, hashes: int, id_col: str, text_col: str) -> DataFrame:
    """rid, tk, class (long; null without words), n_grams and sig (16 bits of each MinHash value) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = kept(("grams", n, hashes), lambda: Shingler(n, hashes))
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXT_ROWS):
                b = whole.slice(lo, TEXT_ROWS)
                keys, counts, signatures = [], [], []
                for grams in tool.sets(texts(b.column(2))):
                    some = len(grams) > 0
                    keys.append(int(_signed(np.array([xxhash.xxh3_64_intdigest(grams.tobytes())], np.uint64))[0]) if some else None)
                    counts.append(len(grams))
                    # The low bits: the high ones of a minimum are nearly always 0.
                    signatures.append(tool.signature(grams).astype("<u2").tobytes() if some else None)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64()), pa.array(counts, pa.int32()), pa.array(signatures, pa.binary())], ["rid", "tk", "class", "n_grams", "sig"])
        give_back()

    own = docs.select(*_row_key(id_col, text_col), text_of(text_col).alias("text"))
    return own.mapInArrow(run, "rid long, tk long, class long, n_grams int, sig binary")


def _row_key(id_col: str, text_col: str) -> list:
    tk = F.xxhash64(text_of(text_col))
    return [F.coalesce(F.col(id_col).cast("long"), tk).alias("rid"), tk.alias("tk")]


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's label) of the nodes of the edges (a, b).

    Each round points every node at its least neighbour, shortens the pointers once and contracts the
    edges; stars are done after one round. All tables are in the shared folder."""
    spark = edges.sparkSession
    edges = materialise(edges.where("a <> b").distinct())
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        to = materialise(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")))
        nxt = to.select(F.col("node").alias("to"), F.col("to").alias("root"))
        to = materialise(to.join(nxt, "to").select("node", "root"))
        rounds.append(to)
        a, b = to.select(F.col("node").alias("a"), F.col("root").alias("ra")), to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = materialise(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not rounds:
        return spark.createDataFrame([], "node long, root long")
    out = rounds[0]
    for more in rounds[1:]:
        step = more.select(F.col("node").alias("root"), F.col("root").alias("further"))
        out = out.join(step, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    return materialise(out) if len(rounds) > 1 else out


#: Rows of a block that are compared at once with all of another.
STRIP = 256


def candidates(values: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float, step: int, least: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs between left and right (None: within left) that stay after all values, a strip of left at a time."""
    other = left if right is None else right
    for lo in range(0, len(left), STRIP):
        own = left[lo : lo + STRIP]
        same = np.zeros((len(own), len(other)), np.uint8)
        for k in range(step):
            same += values[own, k][:, None] == values[other, k][None, :]
        keep = same >= least[0]
        if right is None:
            keep &= np.arange(lo, lo + len(own))[:, None] < np.arange(len(other))[None, :]
        keep &= np.minimum(sizes[own][:, None], sizes[other]) >= (threshold - 1e-9) * np.maximum(sizes[own][:, None], sizes[other])
        ia, ib = np.nonzero(keep)
        matches = same[ia, ib].astype(np.int32)
        ia, ib = own[ia], other[ib]
        for at in range(1, len(least)):
            part = slice(at * step, (at + 1) * step)
            for i in range(0, len(ia), 100_000):
                matches[i : i + 100_000] += (values[ia[i : i + 100_000], part] == values[ib[i : i + 100_000], part]).sum(1)
            stay = matches >= least[at]
            ia, ib, matches = ia[stay], ib[stay], matches[stay]
        if len(ia):
            yield ia, ib


class Verifier:
    """Exact similarities of the sets of one unit."""

    def __init__(self, sets: list[np.ndarray], threshold: float) -> None:
        self.sizes, self.threshold = np.array([len(s) for s in sets]), threshold
        _, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.ends = np.concatenate(([0], np.cumsum(self.sizes)))
        self.flag = np.zeros(int(self.flat.max()) + 2, np.int32)

    def linked(self, ia: np.ndarray, ib: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs whose similarity is the threshold or more."""
        order = np.argsort(ia, kind="stable")
        ia, ib = ia[order], ib[order]
        common = np.zeros(len(ia), np.int64)
        cuts = np.flatnonzero(np.diff(ia)) + 1
        for lo, hi in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(ia)].tolist(), strict=True):
            own = self.flat[self.ends[ia[lo]] : self.ends[ia[lo] + 1]]
            self.flag[own] = 1
            part = ib[lo:hi]
            grams = np.concatenate([self.flat[self.ends[j] : self.ends[j + 1]] for j in part.tolist()])
            common[lo:hi] = np.add.reduceat(self.flag[grams], np.concatenate(([0], np.cumsum(self.sizes[part])[:-1])))
            self.flag[own] = 0
        good = common >= (self.threshold - 1e-9) * (self.sizes[ia] + self.sizes[ib] - common)
        return ia[good], ib[good]


def label_parts(label: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """For each of n things the least index it is connected to, by pairs and by the labels that are known."""
    own = np.arange(len(label))
    ia, ib = np.concatenate((ia, own)), np.concatenate((ib, label))
    label = label.copy()
    while True:
        before = label.copy()
        low = np.minimum(label[ia], label[ib])
        np.minimum.at(label, ia, low)
        np.minimum.at(label, ib, low)
        label = label[label]
        if (label == before).all():
            return label


def ngram_jaccard_join(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 6, step: int = 16, tolerance: float = 1e-6, block: int = 256, block_grams: int = 1_000_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """rid, tk (row key: id, or text hash for a null id; text hash), class_id, copy_of, n_copies, n_links, n_texts, chosen.

    class_id: least id of the documents connected by links; copy_of: least id with the same n-gram set;
    n_links: documents linked to the row (its copies too), n_texts: different texts among them;
    chosen: the row stands for its class (rows repeated with id and text are all chosen)."""
    spark = docs.sparkSession
    with batches_of(spark, TEXT_ROWS):
        rows_ = materialise(classes_of(docs, n, bands * rows, id_col, text_col))
    facts = [F.min(F.struct("rid", "tk")).alias("rep"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("sig").alias("sig")]
    members = materialise(rows_.where("class IS NOT NULL").groupBy("class").agg(*facts))

    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("sig", 2 * rows * i + 1, F.lit(2 * rows))))
    buckets = members.select("class", F.explode(band).alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("class").alias("hub"), F.count("*").alias("m")).where("m > 1").select("bucket", "hub")
    edges = buckets.join(materialise(hubs).hint("merge"), "bucket").where("class <> hub").select(F.col("class").alias("a"), F.col("hub").alias("b"))
    parts = materialise(components(edges))

    active = parts.withColumnRenamed("node", "class").join(members.select("class", "rep", "copies", "n_grams", "sig"), "class")
    active = materialise(active.select("class", "root", "copies", "n_grams", "sig", F.col("rep.rid").alias("rid"), F.col("rep.tk").alias("tk")))
    most = F.least(F.greatest(F.col("n") / 8, F.lit(block)), F.lit(16 * block))
    sizes = active.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_grams").alias("g"))
    sizes = materialise(sizes.select("root", F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("g") / block_grams)).cast("int").alias("blocks")))
    cut = active.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    units = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    deal = lambda df: df.repartition(partitions, "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "class")
    least = least_matches(step, bands * rows, threshold, tolerance)

    def pairs_of(t: pa.Table, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own, grams = t.column("own").to_numpy(), t.column("n_grams").to_numpy().astype(np.int64)
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        return candidates(values, grams, np.flatnonzero(own == lo), None if lo == hi else np.flatnonzero(own == hi), threshold, step, least)

    values_of = lambda t: np.stack([np.frombuffer(x, "<u2") for x in t.column("sig").to_pylist()])
    unit_names = ["root", "lo", "hi", "class"]

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for t in by_group(batches, ["root", "lo", "hi"]):
            alive = np.zeros(t.num_rows, bool)
            for ia, ib in pairs_of(t, values_of(t)) if t.num_rows > 1 else ():
                alive[ia] = alive[ib] = True
            if alive.any():
                held.append(t.select(unit_names).filter(pa.array(alive)))
            if sum(x.num_rows for x in held) > 5000:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    alive = materialise(deal(units.select(*unit_names, "own", "n_grams", "sig")).mapInArrow(prune, "root long, lo int, hi int, class long"))

    table, passes = key_filter(alive.select("class").distinct().join(members.select("class", "rep.rid", "rep.tk"), "class").select("rid", "tk"))
    # Written without a shuffle: of all texts only these are dealt out afterwards.
    source = docs.select(*_row_key(id_col, text_col), text_of(text_col).alias("text"))
    source = materialise(source.join(table, passes).drop("key_bits"))
    repeated = materialise(rows_.groupBy("rid", "tk").agg(F.count("*").alias("times")).where("times > 1").select("rid", "tk"))
    if not repeated.isEmpty():
        once = source.join(repeated, ["rid", "tk"], "left_semi").groupBy("rid", "tk").agg(F.first("text").alias("text"))
        source = source.join(repeated, ["rid", "tk"], "left_anti").unionByName(once)
    wanted = alive.join(cut.select("class", "own", "copies", "n_grams", "sig", "rid", "tk"), "class")
    dealt = deal(source.join(wanted.hint("merge"), ["rid", "tk"]).select(*unit_names, "own", "copies", "n_grams", "sig", "text"))

    def in_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The batches with n-gram sets in place of their texts, so that no unit holds its texts."""
        tool = kept(("grams", n, bands * rows), lambda: Shingler(n, bands * rows))
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXT_ROWS):
                b = whole.slice(lo, TEXT_ROWS)
                grams = [s.tobytes() for s in tool.sets(texts(b.column(b.num_columns - 1)))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(grams, pa.large_binary())], [*b.schema.names[:-1], "grams"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names = ["class", "root", "links", "texts", "part"]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*held, strict=True)], names)
        for t in by_group(in_sets(batches), ["root", "lo", "hi"]):
            cls, copies = t.column("class").to_numpy(), t.column("copies").to_numpy()
            size = len(cls)
            links, near, label = np.zeros(size), np.zeros(size, np.int64), np.arange(size)
            exact = Verifier([np.frombuffer(s, np.uint64) for s in t.column("grams").to_pylist()], threshold)
            for strip in pairs_of(t, values_of(t)):
                ia, ib = exact.linked(*strip)
                links += np.bincount(ia, copies[ib], size) + np.bincount(ib, copies[ia], size)
                near += np.bincount(ia, minlength=size) + np.bincount(ib, minlength=size)
                label = label_parts(label, ia, ib)
            some = near > 0
            root = np.full(size, t.column("root")[0].as_py(), np.int64)
            held.append((cls[some], root[some], links[some].astype(np.int64), near[some], cls[label][some]))
            if sum(len(h[0]) for h in held) > 5000:
                yield pack()
                held = []
        if held:
            yield pack()
        give_back()

    with batches_of(spark, TEXT_ROWS):
        found = materialise(dealt.mapInArrow(compare, "class long, root long, links long, texts long, part long"))
    # A component of one block has its labels already; labels of several blocks are joined.
    split = found.groupBy("class").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"), F.min("part").alias("part"), F.max("part").alias("part2"))
    many = found.join(sizes.where("blocks > 1"), "root", "left_semi")
    joined = components(many.select(F.col("class").alias("a"), F.col("part").alias("b")).where("a <> b"))
    linked = materialise(split.select("class", "links", "texts", "part").join(joined.withColumnRenamed("node", "class"), "class", "left"))
    linked = linked.select("class", "links", "texts", F.coalesce("root", "part").alias("group"))
    table = members.select("class", "rep", "copies").join(linked, "class", "left").withColumn("group", F.coalesce("group", "class"))
    best = materialise(table.where("links IS NOT NULL").groupBy("group").agg(F.min("rep").alias("best")))
    table = table.join(best, "group", "left").withColumn("best", F.coalesce("best", "rep"))
    table = materialise(table.select("class", "rep", "copies", "best", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts")))

    out = rows_.select("rid", "tk", "class").join(table, "class", "left")
    one = F.lit(1).cast("long")
    return out.select(
        "rid", "tk", F.coalesce("best.rid", "rid").alias("class_id"), F.coalesce("rep.rid", "rid").alias("copy_of"), F.coalesce("copies", one).alias("n_copies"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", one) - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"),
        F.coalesce((F.col("best.rid") == F.col("rid")) & (F.col("best.tk") == F.col("tk")), F.lit(True)).alias("chosen"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stand for their class; of rows repeated with id and text one stays."""
    found = materialise(ngram_jaccard_join(docs, id_col=id_col, text_col=text_col, **options))
    keys = materialise(found.groupBy("rid", "tk").agg(F.first("chosen").alias("chosen"), F.count("*").alias("times"), F.max("n_links").alias("n_links")))
    columns = docs.columns
    rid, tk, bits = unused(columns, "row_id", "text_hash", "key_bits")
    rows = docs.withColumns(dict(zip((rid, tk), _row_key(id_col, text_col), strict=True)))
    # Only rows that go, or that are one of several, are dealt out; the others stay where they are.
    table, passes = key_filter(keys.where("NOT chosen OR times > 1 AND n_links > 0").select("rid", "tk"), (rid, tk, bits))
    asked = materialise(rows.join(table, passes).drop(bits))
    own = keys.where("chosen").toDF(rid, tk, "chosen", "times", "n_links")
    out = rows.join(table, ~passes).select(*columns)
    out = out.unionByName(asked.join(own.where("times = 1 OR n_links = 0").select(rid, tk), [rid, tk], "left_semi").select(*columns))
    again = own.where("times > 1 AND n_links > 0").select(rid, tk)
    if not again.isEmpty():
        whole = F.min_by(F.struct(*columns), F.hash(*columns)).alias("row")
        out = out.unionByName(asked.join(again, [rid, tk], "left_semi").groupBy(rid, tk).agg(whole).select("row.*"))
    return out
