"""Operators of the training-data subpackage against brute force, on small tables with edge cases."""

import itertools
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

os.environ["TOKENIZERS_PARALLELISM"] = "false"
P = pytest.importorskip("public_tokenizers")

from corpusmill.llm import common, decontam, langid, ngram_join, packing, pii, quality, sharding, tokencount, toxicity, warc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tk string, map int, score double"


def edge_rows():
    """Nulls, empties, repeated rows, near copies and a long text; extra columns whose names operators use themselves."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(25)]
    texts += [None, "", "   ", "x", "x y", texts[0], texts[0], " ".join(texts[1].split()[:-1]), "ünïcode Straße ﬁ 中文 " * 5, " ".join(word() for _ in range(6000))]
    rows = [(i, s, "en", "s1", 0, "a", 1, 0.5) for i, s in enumerate(texts)]
    return rows + [rows[2], rows[2], (None, "null id", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def test_token_counts_match_the_library(docs):
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in tokencount.count_tokens(docs, model).collect())
    assert got == sorted((r[0] or -1, len((r[1] or "").encode()), len(lib.encode(r[1] or ""))) for r in edge_rows())


def test_packing_is_gapless_and_exact(docs):
    from tokenizers import Tokenizer

    name = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(name)
    pieces = packing.pack(docs, name, length=64, range_tokens=500).collect()
    want = sorted((r[0] or -1, len(lib.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in edge_rows())
    assert sorted((p["doc_id"] or -1, p["doc_tokens"]) for p in pieces if p["start"] == 0) == want
    assert sum(p["length"] for p in pieces) == sum(n for _, n in want)
    # The ids of each document, piece by piece, are the library's (rows repeated with id and text have the same ones).
    ids_of = {(r[0], r[1]): lib.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in edge_rows()}
    by_doc = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        by_doc.setdefault(p["doc_id"], []).append((p["start"], p["ids"]))
    for doc, parts in by_doc.items():
        own = sorted(x for (i, _), ids in ids_of.items() if i == doc for x in [ids])
        joined = [x for _, ids in parts for x in ids]
        assert joined == own[0] * (len(joined) // len(own[0])), doc
    at = 0
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["sequence_id"] * 64 + p["offset"] == at
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"]
        at += p["length"]


def test_hilbert_neighbours_differ_by_one_step():
    grid = np.array(np.meshgrid(*[range(4)] * 3)).reshape(3, -1).T
    path = grid[np.argsort(packing.hilbert_index(grid, 2))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_word_hashes_part_texts_as_the_re_module_does():
    rows = [r[1] or "" for r in edge_rows()] + ["İstanbul ΣΑΣ x²½ a_b ٣ 你好 \U0001d54f", "\ud800 a", "", "a" * 3000]
    hashes, ends = common.word_hashes(rows)
    want = [re.findall(r"\w+", t.lower()) for t in rows]
    assert np.diff(ends, prepend=0).tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    assert [len(a) for a in common.word_hashes([])] == [0, 0]


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute_links(rows, threshold=0.8):
    """For each row (rid, text): class_id, copy_of, n_copies, n_links, n_texts, from all pairs of different sets."""
    sets = [frozenset(shingles(t)) for _, t in rows]
    groups: dict = {}
    for i, x in enumerate(sets):
        groups.setdefault(x or i, []).append(i)
    keys = [k for k in groups if not isinstance(k, int)]
    holders: dict = {}
    for k in keys:
        for g in k:
            holders.setdefault(g, []).append(k)
    common = Counter()
    for ks in holders.values():
        common.update(frozenset(p) for p in itertools.combinations(ks, 2))
    links: dict = {k: [] for k in keys}
    for pair, n in common.items():
        x, y = pair
        if n >= (threshold - 1e-9) * (len(x) + len(y) - n):
            links[x].append(y)
            links[y].append(x)
    root: dict = {}
    for k in keys:
        todo, seen = [k], {k}
        while todo and k not in root:
            for other in links[todo.pop()]:
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        least = min(rows[i][0] for x in seen for i in groups[x])
        for x in seen:
            root.setdefault(x, least)
    out = []
    for i, x in enumerate(sets):
        own = groups[x] if x else [i]
        out.append((root[x] if x else rows[i][0], min(rows[j][0] for j in own), len(own), len(own) - 1 + sum(len(groups[y]) for y in links.get(x, [])), len(links.get(x, []))))
    return out


def got_links(found):
    return sorted((r["rid"], r["class_id"], r["copy_of"], r["n_copies"], r["n_links"], r["n_texts"]) for r in found.collect())


def near_copies(seed, groups, size):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(20, 90))]
        for _ in range(size):
            yield " ".join(word() if rng.random() < 0.012 else w for w in base)


def test_jaccard_links_match_brute_force(spark, docs):
    """Row by row, with many blocks, and with a strip and units smaller than a group; rows of known ids."""
    rows = [(r[0], r[1]) for r in edge_rows() if r[0] is not None] + [(1000 + i, t) for i, t in enumerate(near_copies(11, 4, 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((i, *w) for (i, _), w in zip(rows, brute_links(rows)))
    for options in ({}, {"block": 2}, {"block": 7, "block_grams": 500}):
        assert got_links(ngram_join.ngram_jaccard_join(df, **options)) == want
    assert ngram_join.ngram_jaccard_join(docs).count() == len(edge_rows())
    clash = docs.withColumn("row_id", F.lit("x")).withColumn("text_hash", F.lit(None).cast("string"))
    kept = ngram_join.one_of_each(clash, block=2)
    assert kept.columns == clash.columns
    assert kept.where("doc_id = 0").count() == 1 and kept.where("doc_id in (30, 31)").count() == 0
    assert ngram_join.ngram_jaccard_join(docs.where("false")).count() == 0


def test_jaccard_join_of_a_test_table_matches_brute_force(spark):
    """All links and classes of sf0.01: no pair at or above the threshold is missed there."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted((i, *w) for (i, _), w in zip(rows, brute_links(rows)))
    assert got_links(ngram_join.ngram_jaccard_join(docs)) == want


def test_rows_repeated_many_times_are_fetched_once(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(1, base)] * 300 + [(2, base + " more")] + [(None, base + " other")] * 50
    got = {(r["rid"] if r["rid"] in (1, 2) else 0, r["n_copies"], r["n_links"], r["n_texts"]) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 300, 350, 2), (2, 1, 350, 2), (0, 50, 350, 2)}


def test_pruning_bound_keeps_what_can_reach_the_threshold():
    least = ngram_join.least_matches(16, 192, 0.8, 1e-6)
    assert all(m < 0.8 * 16 * (i + 1) for i, m in enumerate(least)) and least[-1] > 0.5 * 192


def test_sets_of_long_texts_take_bounded_memory():
    """The arrays of a slice, not those of all texts of a unit; the sets are those of each text alone."""
    import tracemalloc

    rng = random.Random(5)
    rows = [" ".join(f"w{rng.randrange(5000)}" for _ in range(10_000)) for _ in range(100)]
    tool = ngram_join.Shingler(5, 192)
    tool.sets(["warm up"])
    tracemalloc.start()
    got = tool.sets(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 130e6
    assert all((a == tool.sets([t])[0]).all() for a, t in zip(got[::25], rows[::25], strict=True))
    assert [len(s) for s in tool.sets(["", *rows[:2], "a b"])] == [0, len(got[0]), len(got[1]), 1] and tool.sets([]) == []


def test_batches_of_few_words_have_sets():
    """Fewer words in a whole batch than an n-gram has."""
    tool = ngram_join.Shingler(5, 192)
    for rows in (["a"], ["a b"], ["a b c"], ["a", "", "b"], ["a b c d"], ["", ""]):
        long = tool.sets([*rows, "one two three four five six"])[:-1]
        assert [x.tolist() for x in tool.sets(rows)] == [x.tolist() for x in long]


def test_texts_that_no_pair_needs_are_not_dealt_out(spark, monkeypatch):
    """Of 400 texts two are fetched; the key filter lets all of its keys pass and few others."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(400)]
    rows.append((400, rows[7][1] + " more"))
    kept, plain = [], ngram_join.materialise
    monkeypatch.setattr(ngram_join, "materialise", lambda df: kept.append(plain(df)) or kept[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ngram_join.one_of_each(df).count() == 400
    fetched = [{r[0] for r in k.collect()} for k in kept if "text" in k.columns]
    assert len(fetched) == 2 and {7, 400} <= fetched[0] and {400} <= fetched[1] and max(map(len, fetched)) < 20
    assert ngram_join.one_of_each(df.where("doc_id < 400")).count() == 400
    keys = spark.range(0, 50_000, 5).selectExpr("id AS rid", "-id AS tk")
    table, passes = ngram_join.key_filter(keys)
    got = spark.range(50_000).selectExpr("id AS rid", "-id AS tk").join(table, passes)
    assert got.where("rid % 5 = 0").count() == 10_000 and got.count() < 12_000


def test_batches_with_texts_are_small(spark, monkeypatch):
    """The rows of a batch are bounded while texts go to the workers, and the setting is put back."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, plain = spark.conf.get(name), ngram_join.materialise
    monkeypatch.setattr(ngram_join, "materialise", lambda df: seen.append((df.columns, spark.conf.get(name))) or plain(df))
    ngram_join.ngram_jaccard_join(spark.createDataFrame([(1, "a b c"), (2, "a b c d")], "doc_id long, text string")).count()
    assert [n for c, n in seen if c[:2] == ["rid", "tk"] and c[-1] == "sig" or c == ["class", "root", "links", "texts", "part"]] == ["500", "500"]
    assert spark.conf.get(name) == before


def test_surrogates_are_consistent_and_distinct(spark):
    rows = [(i, f"mail ann.{i % 7}@host{i % 3}.example.org or +1 ({200 + i % 5}) 555-0100, Mr. John Baker {i % 4}") for i in range(40)]
    df = spark.createDataFrame([*rows, (99, None), (98, "nothing here"), rows[0]], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.replace_entities(df, "k", count_col="n").collect()}
    assert out[99] is None and out[98] == "nothing here" and len(out) == 42
    mails = {}
    for i, s in rows:
        old, new = re.search(r"\S+@\S+", s)[0], re.search(r"\S+@\S+", out[i])[0]
        assert old != new and mails.setdefault(old, new) == new
        assert "John" not in out[i] and "Baker" not in out[i] and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}, Mr\. \w+ \w+", out[i])
    assert len(set(mails.values())) == len(mails)


def test_surrogates_of_short_and_foreign_addresses_end(spark):
    """All one-letter local parts, other scripts, and parts without a letter: each gets another surrogate."""
    found = [f"{c}@x.org" for c in "abcdefghijklmnopqrstuvwxyz"] + ["用户@例え.jp", "김@한국.kr", "_@-.de", "%@abc.de", "ß@ÿ.fr", "משה@a.il"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(found)], "doc_id long, text string")
    new = [r["text"] for r in pii.replace_entities(df, "k").orderBy("doc_id").collect()]
    assert len(set(new)) == len(found) and not set(new) & set(found)
    assert not {s.split("@")[0] for s in new} & {s.split("@")[0] for s in found}
    assert re.fullmatch("[\u4e00-\u9fff]{2}@[\u4e00-\u9fff][\u3040-\u309f]\\.jp", new[26])
    assert all(a.rsplit(".", 1)[1] == b.rsplit(".", 1)[1] for a, b in zip(new, found, strict=True))


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10


def mod97(code):
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def test_forms_of_entities(spark):
    """What is found, and in what form it is replaced; what only looks like an entity stays."""
    found = {
        "+15551234567": r"\+\d{11}", "06 12 34 56 78": r"\d\d( \d\d){4}", "+33 6 12 34 56 78": r"\+\d\d \d( \d\d){4}", "555-123-4567": r"\d{3}-\d{3}-\d{4}", "(030) 1234567": r"\(\d{3}\) \d{7}",
        "3782 822463 10005": r"\d{4} \d{6} \d{5}", "378282246310005": r"\d{15}", "4111-1111-1111-1111": r"4\d{3}(-\d{4}){3}", "2001:db8::ff00:42:8329": r"[0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]{2}:[0-9a-f]{4}",
        "DE89 3704 0044 0532 0130 00": r"DE\d\d( \d{4}){4} \d\d", "GB82WEST12345698765432": r"GB\d\d[A-Z]{4}\d{14}", "ghp_" + "a1B2" * 9: r"ghp_([a-z]\d[A-Z]\d){9}", "10.1.2.3": r"\d+(\.\d+){3}", "123-45-6789": r"\d{3}-\d{2}-\d{4}",
    }
    stay = ["10 000 000", "1999-2000 1500", "4111 1111 1111 1112", "DE88 3704 0044 0532 0130 00", "12:30:45", "1234567890123456", "3.14159 26535", "v1.2.3"]
    rows = [(i, f"x {s} y") for i, s in enumerate([*found, *stay])] + [(99, None), (98, "")]
    out = {r["doc_id"]: r["text"] for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, (old, form) in enumerate(found.items()):
        new = out[i][2:-2]
        assert re.fullmatch(form, new) and new != old, (old, new)
        digits = re.sub(r"\D", "", new)
        assert len(digits) not in (15, 16) or old[0] not in "34" or luhn(digits) == 0
        assert old[:2] not in ("DE", "GB") or mod97(new.replace(" ", "")) == 1
    assert [out[len(found) + i][2:-2] for i in range(len(stay))] == stay and out[99] is None and out[98] == ""


def test_names_alone_follow_their_full_form(spark):
    rows = [(1, "Dr. Baker came. Baker said so; Bakers did not."), (2, "Mary May saw it in may. May left, Mary stayed."), (3, "Baker alone"), (4, "Herr Jürgen Über-Maß ging, Über-Maß blieb. Frau Jürgen kam.")]
    clash = "doc_id long, text string, found int, text_hash string, replacements int, bare_names string, n_found long"
    df = spark.createDataFrame([(*r, 7, "t", 8, "b", 9) for r in rows], clash)
    got = pii.replace_entities(df, "k", count_col="n")
    assert got.columns == [*df.columns, "n"] and all(tuple(r)[2:7] == (7, "t", 8, "b", 9) for r in got.collect())
    out = {r["doc_id"]: r["text"] for r in got.collect()}
    new = re.fullmatch(r"Dr\. (\w+) came\. (\w+) said so; Bakers did not\.", out[1])
    assert new and new[1] == new[2] != "Baker"
    given, may, alone, again = re.fullmatch(r"(\w+) (\w+) saw it in may\. (\w+) left, (\w+) stayed\.", out[2]).groups()
    assert given == again != "Mary" and may != "May" and alone == "May"  # the text has the word in lower case
    assert out[3] == "Baker alone" and "Über-Maß" not in out[4] and "Jürgen" not in out[4]


def test_surrogates_of_a_full_space_end(spark):
    """All numbers of a format are in the corpus: they swap places, each with another."""
    parts = spark.range(1000).select(F.lit("phone").alias("ptype"), F.lpad(F.col("id").cast("string"), 3, "0").alias("norm"))
    got = pii.surrogates(parts, "k", rounds=2).collect()
    assert len(got) == 1000 == len({r["surrogate"] for r in got}) and all(r["norm"] != r["surrogate"] and len(r["surrogate"]) == 3 for r in got)


def test_surrogates_on_the_test_table_match_brute_force(spark):
    """Over whole texts of sf0.001: the same places change as a search by the regex module finds, one surrogate for one entity, none shared."""
    import regex

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    old, new = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (docs, pii.replace_entities(docs, "k")))
    entity, seen = regex.compile(pii.ENTITY), {}
    changed = 0
    for i, text in old.items():
        if text is None:
            assert new[i] is None
            continue
        at, out = 0, new[i]
        pattern = ""
        for m in entity.finditer(text):
            card = regex.fullmatch(pii.KINDS["card"], m[0])
            keep = card and luhn(re.sub(r"\D", "", m[0]))
            pattern += regex.escape(text[at : m.start()]) + (regex.escape(m[0]) if keep else "(.+?)")
            at = m.end()
        match = regex.fullmatch(pattern + regex.escape(text[at:]), out, regex.S)
        assert match, i
        wanted = [m[0] for m in entity.finditer(text) if not (regex.fullmatch(pii.KINDS["card"], m[0]) and luhn(re.sub(r"\D", "", m[0])))]
        for a, b in zip(wanted, match.groups(), strict=True):
            assert a != b and seen.setdefault(a, b) == b
            changed += 1
    assert changed > 10 and len(set(seen.values())) == len(seen)


def test_shards_are_written_whole(spark, tmp_path):
    rows = [(i, "x" * 30, "a") for i in range(40)] + [(7, "y" * 50, str(i)) for i in range(20)] + [(None, None, "n"), (None, "z", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard_key string").repartition(5)
    sharding.write_shards(df, str(tmp_path / "s"), 200)
    got = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, got.select("doc_id", "text", "shard_key").collect())) == sorted(map(str, df.collect()))
    sizes = {r["shard_id"]: (r["n"], r["ids"]) for r in got.groupBy("shard_id").agg(F.sum(F.length("text")).alias("n"), F.count_distinct("doc_id").alias("ids")).collect()}
    assert all(n is None or n <= 200 or ids == 1 for n, ids in sizes.values())


def test_shards_fit_and_hold_all_rows(spark, docs):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    rows = sharding.extendible_shards(df, 400, spare_bits=1).collect()
    sums = {}
    for r in rows:
        sums[r["shard_id"]] = sums.get(r["shard_id"], 0) + r["n_bytes"]
    assert len(rows) == 500 and max(sums.values()) <= 400 and all(sums[r["shard_id"]] == r["shard_bytes"] for r in rows)
    names = set(sums)
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    assert sharding.extendible_shards(docs, 1000).count() == len(edge_rows())


def test_templates_catch_new_numbers_but_not_inconsistent_ones(spark):
    item = "A train leaves with 12 apples and 5 pears while another one carries 12 apples more than before"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    rows = [(1, "x " + item + " y"), (2, item.replace("12", "31").replace("5", "8")), (3, item.replace("12", "31", 1)), (4, "an apple a day keeps many things away from all of us here"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["kind"] for r in decontam.leaks(docs, bench).collect()}
    assert got == {1: "exact", 2: "template"}
    assert sorted(r["doc_id"] for r in decontam.without_leaks(docs, bench).collect()) == [3, 4, 5]
    clash = docs.select("*", F.lit("x").alias("tk"), F.lit("y").alias("text_hash"), F.lit(1).alias("hash"), F.lit(2).alias("item_id"))
    kept = decontam.without_leaks(clash, bench)
    assert kept.columns == clash.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]
    again = docs.unionByName(docs.where("doc_id = 1")).unionByName(spark.createDataFrame([(None, item)], docs.schema))
    assert sorted(str(r["doc_id"]) for r in decontam.leaks(again, bench.unionByName(bench)).collect()) == ["1", "1", "2", "None"]
    long_ = spark.createDataFrame([(9, "word " * 200_000 + item + " word" * 1000 + (" " + item) * 500)], docs.schema)
    assert [(r["item_id"], r["kind"]) for r in decontam.leaks(long_, bench).collect()] == [(1, "exact")]
    assert decontam.leaks(docs.where("false"), bench).count() == 0 and decontam.without_leaks(docs, bench.where("false")).count() == 5


def brute_templates(text, reading):
    """Codes and values by the re module, one token at a time."""
    out, names, begins = [], [], True
    for token in re.findall(r"[^\W\d_]+|\d+(?:[.,:]\d+)*|[.!?\n]", text):
        if token in ".!?\n":
            begins, names = True, []
            continue
        low = token.lower()
        unit = low in decontam.UNITS
        number = token[0].isdecimal()
        name = token[0].isupper() and not unit and (reading == 1 or not begins)
        if reading == 2:
            out.append((low, None))
        elif name and names:
            names.append(token)
            out[-1] = ("<name>", " ".join(names))
        else:
            out.append(("<name>", token) if name else ("<number>", token) if number else ("<unit>", None) if unit else (low, None))
        names = (names or [token]) if name else []
        begins = False
    return out


def brute_leaks(text, item, coverage=0.5, slip=3):
    best = None
    for reading in (0, 1, 2):
        t, m = brute_templates(text, reading), brute_templates(item, reading)
        size = min(8, len(m))
        if size < (3 if reading == 2 else 5):
            continue
        own = lambda r, i: tuple(c for c, _ in r[i : i + size])  # noqa: B023, E731
        good = [i for i in range(len(m) - size + 1) if 2 * sum(c in ("<name>", "<number>", "<unit>") for c in own(m, i)) <= size]
        hits = [(j, i) for i in good for j in range(len(t) - size + 1) if own(t, j) == own(m, i)]
        for d in {j - i for j, i in hits}:
            near = [(j, i) for j, i in hits if d <= j - i <= d + slip]
            share = len({i for _, i in near}) / len(good)
            pairs = {}
            for j, i in sorted(near, key=lambda x: (x[0] - x[1], x[1])):
                for k in range(size):
                    if m[i + k][1]:
                        pairs.setdefault(i + k, (m[i + k][1], t[j + k][1]))
            given = {}
            for w, g in pairs.values():
                given.setdefault(w, set()).add(g)
            if share >= (1 if reading == 2 else coverage) and all(len(g) == 1 for g in given.values()):
                changed = sum(w != g for w, g in pairs.values())
                best = max(best or (0, -99), (share, -changed))
    return best and (round(best[0], 9), -best[1])


def test_windows_of_many_texts_take_bounded_memory():
    """An Arrow batch of long texts is read in slices, and its windows are those of each text."""
    import tracemalloc

    rng = random.Random(2)
    word = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    rows = [" ".join(rng.choice(word) for _ in range(600)) for _ in range(500)] + ["", "one"]
    batch = decontam.pa.RecordBatch.from_arrays([decontam.pa.array(range(len(rows))), decontam.pa.array(rows)], ["tk", "text"])
    table = np.zeros(decontam.FILTER_SLOTS, bool)
    for r in decontam.read(rows[490:]):
        for place in decontam.probes(decontam.windows(r, 8, 0)[1]):
            table[place] = True
    tracemalloc.start()
    got = [(x["tk"], x["at"]) for b in decontam.window_hits(iter([batch]), table, [(0, 8)]) for x in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and {(k, at) for k in range(490, 500) for at in range(593)} <= set(got) and len(got) < 8000


def test_leaks_match_brute_force(spark):
    rng = random.Random(8)
    words = "the a Bob Anna Lee has 3 4 12.5 km apples pears. gives then He she? buys more of it days 7:30 Zoë ½".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [say(rng.randint(2, 22)) for _ in range(25)]
    docs = []
    for _ in range(60):
        parts = [say(rng.randint(0, 12))]
        for item in rng.sample(items, 2):
            tokens = [rng.choice(words) if rng.random() < 0.06 else w for w in item.split()]
            parts += [" ".join(tokens), say(rng.randint(0, 9))]
        docs.append(" ".join(parts))
    d, b = (spark.createDataFrame(list(enumerate(x)), f"{n} long, text string") for x, n in ((docs, "doc_id"), (items, "item_id")))
    got = {(r["doc_id"], r["item_id"]): (round(r["coverage"], 9), r["changed_slots"]) for r in decontam.leaks(d, b).collect()}
    want = {(i, j): x for i, t in enumerate(docs) for j, m in enumerate(items) if (x := brute_leaks(t, m))}
    assert got == want and 60 < len(want) < 400


def test_warc_round_trip(spark):
    rows = [(3, "http://a/\n1", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://b", None), (5, "http://c", ""), (None, "http://d", "z" * 5000), (9, "u", "z" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.write_read(pages).collect()
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got}
    assert kinds["1"] == ("response", None, len("<p>é</p>".encode())) and kinds["3"][:2] == ("revisit", "1")
    assert kinds["5"][:2] == ("revisit", "2") and kinds[None][:2] == ("revisit", "9") and len(got) == 6
    assert {r["payload"].decode() for r in got if r["record_type"] == "response"} == {"<p>é</p>", "", "z" * 5000}


def test_warc_ties_have_one_response(spark):
    rows = [(1, "b", "x"), (1, "a", "x"), (1, "a", "x"), (2, "a", "x"), (None, "c", "x"), (None, "c", "only"), (None, "c", "only"), (5, None, "y"), (5, "u", "y"), (7, "u", "alone")]
    got = warc.write_read(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and len({r["record_id"] for r in got}) == len(rows)
    kinds = sorted((r["page_id"] or "-", r["target_uri"] or "-", r["record_type"], r["refers_to"] or "-", r["payload_bytes"]) for r in got)
    assert kinds == [
        ("-", "c", "response", "-", 4), ("-", "c", "response", "-", 4), ("-", "c", "revisit", "1", 1), ("1", "a", "response", "-", 1), ("1", "a", "revisit", "1", 1), ("1", "b", "revisit", "1", 1),
        ("2", "a", "revisit", "1", 1), ("5", "-", "response", "-", 1), ("5", "u", "revisit", "5", 1), ("7", "u", "response", "-", 5),
    ]
    assert warc.write_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_filters_and_payloads_are_decided_by_headers(spark, tmp_path):
    """Filters are taken over; records that they leave out, and payloads not asked for, are not inflated."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    rng = random.Random(9)
    long_ = "".join(rng.choice("abcdefgh \n") for _ in range(300_000))
    rows = [(i, f"http://h/{i}", long_ if i == 3 else f"<p>{i % 2}</p>") for i in range(6)]
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)), path)
    read = warc.read_warc(spark, path)
    plan = read.where("record_type = 'response' AND page_id IN ('1', '3', '9')")
    assert sorted(r["page_id"] for r in plan.collect()) == ["1", "3"] and plan.where("payload_bytes > 100").count() == 1
    assert {r["payload"] for r in warc.read_warc(spark, path, payload=False).collect()} == {None}
    reader = warc.WarcReader({"path": path, "payload": "false"})
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("page_id",), ("0", "3")), GreaterThan(("payload_bytes",), 5)]))
    assert [type(f) for f in left] == [GreaterThan]
    [file] = [f for f in (tmp_path / "w").iterdir() if f.name.endswith(".warc.gz")]
    data = bytearray(file.read_bytes())
    data[len(data) // 2 : len(data) // 2 + 2000] = bytes(2000)  # inside the long payload
    file.write_bytes(data)
    [part] = reader.partitions()
    assert [x for b in reader.read(part) for x in b.column("page_id").to_pylist()] == ["0", "3"]
    whole = warc.WarcReader({"path": path})
    with pytest.raises(Exception, match="."):
        list(whole.read(part))
    skips = warc.WarcReader({"path": path})
    list(skips.pushFilters([EqualTo(("page_id",), "4")]))
    assert [x for b in skips.read(part) for x in b.column("page_id").to_pylist()] == ["4"]


def test_foreign_archives_are_read(spark, tmp_path):
    import gzip

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody\r\n\r\nmore"
    one = lambda kind, block, kind_of=b"application/http; msgtype=response": b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nwarc-target-uri: http://x\r\nContent-Type: " + kind_of + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    records = [one(b"warcinfo", b"a: b\r\n", b"application/warc-fields"), one(b"response", http), one(b"resource", b"z" * 70_000, b"text/plain")]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "_hidden.warc").write_bytes(b"no")
    for payload in (True, False):
        got = sorted((r["file"][-7:], r["record_type"], r["payload_bytes"], r["payload"]) for r in warc.read_warc(spark, f"file://{tmp_path}", payload).collect())
        want = [("warcinfo", 6, b"a: b\r\n"), ("response", 12, b"body\r\n\r\nmore"), ("resource", 70_000, b"z" * 70_000)]
        assert got == sorted((f, k, n, p if payload else None) for f in ("/a.warc", "warc.gz") for k, n, p in want)


def test_quality_measures_match_brute_force():
    for text in [r[1] or "" for r in edge_rows()] + ["a b c a b c d\na b\n\na b\n# $ x", "a a a a a"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times = Counter(grams)
        hit = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        got = quality.measures(text)
        assert got[:3] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text))
        assert got[4] == len(hit) and got[3] == len(lines) - len(set(lines))


def test_line_rule_matches_brute_force(spark):
    """Distinct documents (id and text) of each normalised line and host, over rows with copies, repeats and nulls."""
    rng = random.Random(10)
    lines = [f"line {chr(97 + i)} of words" for i in range(14)] + ["Menu", "page 12", "page 7", "", "  "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6))), rng.choice(["h", "g", None])) for i in range(120)]
    rows += [(200 + i, rows[0][1], "h") for i in range(6)] + [rows[1], rows[1], (None, "Menu\nx", "g"), (None, "Menu\nx", "g"), (300, None, "h"), (301, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    norm = lambda x: re.sub(r"[\W_]+", " ", re.sub(r"\d", "0", x.lower())).strip()
    distinct = {(i, t or "", h) for i, t, h in rows}
    seen, hosts = {}, Counter(h for _, _, h in distinct)
    for i, t, h in distinct:
        for line in {norm(x) for x in t.split("\n") if x.split()}:
            seen[h, line] = seen.get((h, line), 0) + 1
    limit = {h: min(20, max(3, 0.2 * n)) for h, n in hosts.items()}
    drop = {k for k, n in seen.items() if n > limit[k[0]]}
    want = []
    for i, t, h in rows:
        gone = sum(len(x.split()) for x in (t or "").split("\n") if x.split() and (h, norm(x)) in drop)
        n = len((t or "").split())
        want.append((str(i), gone, n >= 1 and n - gone >= 0.3 * n, t and "\n".join(x for x in t.split("\n") if not x.split() or (h, norm(x)) not in drop)))
    options = {"max_documents": 20, "max_share": 0.2, "least_documents": 3}
    got = quality.quality_rules(df, least_words=1, most_repeated=1000, **options).collect()
    assert sorted((str(r["doc_id"]), r["removed_words"], r["kept"]) for r in got) == sorted(w[:3] for w in want) and 0 < len(drop) < len(seen)
    left = quality.cleaned(df.withColumn("doc_key", F.lit("x")), **options).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in left) == sorted((w[0], str(w[3])) for w in want)


def test_common_lines_are_removed(spark):
    body = lambda i: "\n".join(f"own line number {chr(97 + i)}x {chr(97 + k)} beta gamma" for k in range(12))
    rows = [(i, body(i) + "\nshared words that many documents carry here", "h") for i in range(9)]
    rows += [(100 + i, "shared words that many documents carry here\n" * 9 + f"q{i} w e r t y", "h") for i in range(3)]
    df = spark.createDataFrame([*rows, (200, None, None)], "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in quality.quality_rules(df, max_documents=5, most_repeated=1000).collect()}
    assert all(out[i]["kept"] and out[i]["removed_words"] == 7 for i in range(9)) and not any(out[100 + i]["kept"] for i in range(3)) and out[200]["base_failed"]


def test_languages_and_toxicity_learn(spark):
    en, de = "the house of this water and when they went".split(), "das haus ist für uns nicht ganz schön und".split()
    rng = random.Random(1)
    make = lambda ws, n=40: " ".join(rng.choice(ws) for _ in range(n))
    rows = [(i, make(en if i % 2 else de) + (" vile" * 3 if i % 5 == 0 else ""), "en" if i % 2 else "de") for i in range(300)] + [(900, None, None), (901, "123", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in langid.identify_held_out(df.unionByName(spark.createDataFrame([(902, "² ½ Ⅷ 4", "en")], df.schema))).collect()}
    assert out[902]["lang_pred"] == "und" and out[900]["lang_pred"] == "und" == out[901]["lang_pred"] and all(out[i]["lang_pred"] == r[2] for i, r in enumerate(rows[:300]))
    mixed = spark.createDataFrame([(1, make(en) + " " + make(de))], "doc_id long, text string")
    model = langid.train(df)
    spans = langid.identify(mixed, model).first()["spans"]
    text = mixed.first()["text"]
    assert [s["lang"] for s in spans] == ["en", "de"] and spans[0]["start"] == 0 and spans[1]["end"] == len(text) and text[spans[1]["start"] - 1] == " "
    (found, _, _), (none, lang, score) = langid.label(model, ["İ 12 das haus!", "² ½"], 8.0)
    assert found[0][0] == 0 and found[-1][1] == 13 and (none, lang, score) == ([], "und", 0.0)
    scores = np.random.default_rng(1).normal(size=(3, 9, 3)).astype(np.float32)
    for one, path in zip(scores, langid.spans(scores, 0.7)):
        cost = lambda p: sum(one[i, x] for i, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))
        assert cost(path.tolist()) > max(map(cost, itertools.product(range(3), repeat=9))) - 1e-5
    labels = df.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic")).where("doc_id < 300")
    scored = {r["doc_id"]: r for r in toxicity.score_held_out(df, labels).collect()}
    assert all(scored[i]["predicted"] == int(i % 5 == 0) for i in range(300)) and scored[900]["score"] == 0.0


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert packing.pack(none, P.path("word_bpe_49k.json")).count() == 0
    assert ngram_join.one_of_each(none).count() == 0
    assert pii.replace_entities(none, "k").count() == 0
    assert sharding.extendible_shards(none, 10).count() == 0
    assert quality.quality_rules(none).count() == 0 and quality.cleaned(none).count() == 0
    assert tokencount.count_tokens(none, P.path("piece_bpe_32k.model")).count() == 0
    assert langid.identify_held_out(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_held_out(docs, labels).count() == len(edge_rows())
    assert decontam.leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_toxicity_counts_all_labelled_rows(spark):
    """A word of labelled rows outside the curve's sample, and of few contexts, is in the counts; shared counts are over all documents."""
    rows = [(i, f"plain words here n{i % 40} stay " + ("vile" if i % 2 else "fine")) for i in range(400)] + [(1000, "other rows bring fine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.where("doc_id < 400").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.train(docs, labels, per_class=10)
    words = ["n0", "n39", "fine", "bring"]
    t, o, pooled = model.words.rows(toxicity.numbers_of(words)[0])[:, :3].T
    assert (o[0], t[1], o[2], t[2], pooled[2]) == (1, 1, 1, 0, 2) and (t[3], o[3]) == (0, 0)
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((out[i] >= toxicity.THRESHOLD) == bool(i % 2) for i in range(400))


def test_expression_counts_match_brute_force(spark, monkeypatch):
    """Distinct words before words and pairs, of each class and of all rows, over many packs and buckets."""
    monkeypatch.setattr(toxicity, "PACK_WORDS", 500)
    monkeypatch.setattr(toxicity, "BUCKET_WORDS", 20)
    rng = random.Random(7)
    rows = [([None, 1, 2][i % 3], " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 60)))) for i in range(150)]
    got = toxicity.expression_counts(spark.createDataFrame([*rows, rows[1], (2, None)], "s_label int, s_text string")).collect()
    number = dict(zip("abcdefghij", toxicity.numbers_of(list("abcdefghij"))[0].tolist()))
    before, contexts = {}, {}
    for label, text in rows:
        w = [0, 0, *[number[c] for c in text.split()]]
        for z, a, b in zip(w, w[1:], w[2:]):
            before.setdefault(b, [set(), set(), set()])[2].add(a)
            if label:
                before[b][2 - label].add(a)
                contexts.setdefault((a, b), [set(), set()])[2 - label].add(z)
    want = {(0, b): [*map(len, v), 0, 0, 0, 0] for b, v in before.items()}
    for (a, b), v in contexts.items():
        t, o = map(len, v)
        if a:
            for i, n in enumerate((t, o, t > 0, o > 0), 3):
                want[0, a][i] += n
            if max(t, o) > 1:
                want[1, (a << toxicity.BITS) | b] = [t, o, 0, 0, 0, 0, 0]
    assert {(r["kind"], r["key"]): [r[c] for c in toxicity.COUNTS] for r in got} == want


def test_slots_keep_the_expression_of_most_contexts(spark):
    table = spark.range(1, 101).select(F.col("id").alias("key"), F.col("id").alias("t"), *[F.lit(0).alias(c) for c in toxicity.COUNTS[1:]])
    slots = toxicity.Slots(table, ["t"], 4)
    assert slots.rows(np.array([100, 97, 96])).ravel().tolist() == [100, 97, 0] and len(slots.keys) == toxicity.WAYS


def test_contexts_are_counted_exactly():
    """More contexts of one pair than 15 bits tell apart."""
    n = 40_000
    key, context = np.full(2 * n, 7, np.uint64), np.tile(np.arange(n, dtype=np.int32) * 5, 2)
    rows = [dict(zip([x.split()[0] for x in toxicity.PACKED.split(", ")], r)) for r in toxicity.packed(key, context, np.repeat([2, 1], n).astype(np.int8), 52)]
    own, toxic, ordinary = toxicity.unpacked(toxicity.pa.Table.from_pylist(rows), 52)
    assert (own.tolist(), toxic.tolist(), ordinary.tolist()) == ([7], [n], [n])


def toxic_corpus(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4))) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)) + (" vile scum" if i % 4 == 0 else "")) for i in range(300)] + [(900, None), (901, ""), (1, "again words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", F.create_map(F.lit("a"), "doc_id"))
    return docs, docs.where("doc_id < 300").select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")).distinct()


def test_toxicity_without_places_scores_alike(spark, monkeypatch):
    """Expressions that the bounded tables have no place for have their part in the curve and in all scores."""
    docs, labels = toxic_corpus(spark)
    runs = []
    for words, pairs in ((1 << 20, 1 << 21), (16, 8)):
        monkeypatch.setattr(toxicity, "WORD_SLOTS", words)
        monkeypatch.setattr(toxicity, "PAIR_SLOTS", pairs)
        monkeypatch.setattr(toxicity, "GROUP_CHARS", 4000)
        model = toxicity.train(docs, labels)
        assert len(model.words.keys) > 16 if words > 16 else len(model.words.keys) <= 16 and len(model.pairs.keys) <= 8
        runs.append((model.curve.tolist(), sorted((r["doc_id"], r["text"] or "", r["m"]["a"], r["score"]) for r in toxicity.score(docs, model).collect())))
    assert len(runs[1][1]) == 303 and np.allclose(runs[0][0], runs[1][0], atol=1e-6)
    assert [r[:3] for r in runs[0][1]] == [r[:3] for r in runs[1][1]]
    assert np.allclose([r[3] for r in runs[0][1]], [r[3] for r in runs[1][1]], atol=1e-6)


def test_texts_are_not_dealt_out_to_be_scored(spark, monkeypatch):
    """Only the words that ask of the shared folder meet its counts; toxic rows go as they score."""
    docs, labels = toxic_corpus(spark)
    monkeypatch.setattr(toxicity, "WORD_SLOTS", 16)
    monkeypatch.setattr(toxicity, "PAIR_SLOTS", 8)
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model, carry=["doc_id"])
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "text" not in plan
    want = sorted(r["doc_id"] for r in scored.collect() if r["score"] < toxicity.THRESHOLD)
    assert 200 < len(want) < 303 and sorted(r["doc_id"] for r in toxicity.without_toxic(docs, model).collect()) == want


@pytest.mark.parametrize("filter_bits", [1 << 26, 64])
def test_texts_stay_where_they_are_when_toxic_rows_go(spark, monkeypatch, filter_bits):
    """Of neither the toxic texts nor the others more than a few are shuffled; with filters that let all rows pass the same rows go."""
    docs, labels = toxic_corpus(spark)
    rng = random.Random(4)
    signs = [(i, "".join(rng.choice("#*$%&|<>+=-/!?") for _ in range(12_000))) for i in range(300)]
    docs = docs.join(spark.createDataFrame(signs, "doc_id long, signs string"), "doc_id", "left").select("doc_id", F.concat_ws(" ", "text", "signs").alias("text"), "m", F.lit(1).alias("key_bits"))
    docs = common.materialise(docs.union(docs.where("doc_id IN (4, 5)")))
    monkeypatch.setattr(toxicity, "WORD_SLOTS", 16)
    monkeypatch.setattr(toxicity, "PAIR_SLOTS", 8)
    monkeypatch.setattr(common, "MOST_BITS", filter_bits)
    model = toxicity.train(docs, labels)
    want = sorted(r["doc_id"] for r in toxicity.score(docs, model, carry=["doc_id"]).collect() if r["score"] < toxicity.THRESHOLD)
    assert 200 < len(want) < 305 and want.count(5) == 2 and 4 not in want
    name, context = "spark.sql.autoBroadcastJoinThreshold", spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        return sum(x.totalShuffleWrite() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(context.statusStore().executorList(False)))

    before, begun = spark.conf.get(name), shuffled()
    spark.conf.set(name, "-1")
    try:
        got = toxicity.without_toxic(docs, model)
    finally:
        spark.conf.set(name, before)
    texts_mb = docs.agg(F.sum(F.length("text"))).first()[0] / 1e6
    moved_mb = (shuffled() - begun) / 1e6
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == want
    assert texts_mb > 3 and (moved_mb < texts_mb / 10 or filter_bits == 64), moved_mb


def test_sums_with_open_words_match_brute_force():
    """Wherever words ask for counts, sums and best windows are those of the ratios of all words."""

    class Some:
        def ratios(self, ids, ends, more=None):
            out = np.sin(ids * 1.7 + toxicity._before(ids, ends) * 0.3)
            return out if more else np.where(self.asks(ids, ends), 1e3, out)

        def asks(self, ids, ends):
            return (ids + toxicity._before(ids, ends)) % self.every == 0

    rng, windows, model = random.Random(8), [1, 2, 4, 8], Some()
    rows = [" ".join(rng.choice("abcdefghijklmnopq") for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 40]))) for _ in range(120)]
    for model.every in (1, 2, 7, 23, 10**9):
        sizes, sums, left = toxicity.partial_features(model, rows, windows)
        assert any(left) == (model.every < 10**9) and sizes.tolist() == [len(t.split()) for t in rows]
        got = toxicity.features(sizes, toxicity.with_open(model, sums, left, windows, [None, None]))
        for text, x in zip(rows, got, strict=True):
            ids, ends = toxicity.numbers_of([text])
            r = model.ratios(ids, ends, [None, None]).tolist()
            want = [sum(r) / len(r), *[max(sum(r[i : i + w]) for i in range(max(1, len(r) - w + 1))) / w for w in windows]] if r else [np.nan] * 5
            assert np.allclose(x, want, equal_nan=True)


def test_pairs_behind_one_word_change_no_ratio(spark):
    """The counts leave out the pairs that no class has behind two words: with them all ratios are the same."""
    docs, labels = toxic_corpus(spark)
    model = toxicity.train(docs, labels)
    ids, ends = toxicity.numbers_of([r["text"] or "" for r in docs.collect()])
    before = model.ratios(ids, ends)
    every = np.unique((ids[:-1] << toxicity.BITS) | ids[1:])
    left_out = every[~np.isin(every, model.pairs.keys)]
    assert len(left_out) > 1000
    more = (None, (left_out, np.tile(np.float32([[1, 1], [0, 1], [1, 0]]), (len(left_out), 1))[: len(left_out)]))
    assert np.array_equal(before, model.ratios(ids, ends, more))


def test_languages_learn_from_every_word(spark):
    """Words past the hundred thousandth and words of more than 40 letters count, whatever the language's name."""
    rng = random.Random(5)
    some = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(9)) for _ in range(n))
    rows = [(i, some("abcdefghij", 5200), "aa") for i in range(20)] + [(100, some("klmnop", 300), "zz"), (101, "ไทย" * 20, "th")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "th", "zz"] and model.scripts["thai"].tolist() == [False, True, False]
    assert model.word_scores(langid.words_of(["klmno ไทย"])).argmax(1).tolist() == [2, 1]


def test_templates_catch_new_names_at_sentence_starts(spark):
    item = "Alice has 12 apples. Bob has 5 apples. Alice gives Bob 3 apples. How many apples does Alice have now?"
    new = "Carol has 31 apples. Dave has 8 apples. Carol gives Dave 4 apples. How many apples does Carol have now?"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, new), (2, "Look: " + item), (3, new.replace("does Carol", "does Dave"))]
    got = {r["doc_id"]: r["kind"] for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: "template", 2: "exact"}


def test_short_numeric_and_recased_items_are_found(spark):
    items = ["What is the capital of France?", "Name this flower", "12 + 7 = 19, 19 + 8 = 27", "When Anna Schmidt met Otto Braun in Wien they spoke about Franz Kafka and Max Brod all night"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(0, "Question: What is the capital of France?"), (1, "so (name this flower) now"), (2, "sum 12 + 7 = 19, 19 + 8 = 27."), (3, items[3].lower()), (4, "x " + items[3].upper()), (5, "12 + 7 = 19, 19 + 9 = 28, the capital of Spain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontam.leaks(docs, bench).collect()}
    assert got == {(i, min(i, 3), "exact") for i in range(5)}


def test_short_lines_of_small_hosts_are_removed(spark):
    rows = [(i, f"Menu\nown words {chr(97 + i)}x stay\nAll rights reserved here today", "small" if i < 20 else None) for i in range(24)]
    df = spark.createDataFrame([*rows, (99, None, None)], "doc_id long, text string, source string")
    out = {r["doc_id"]: r["removed_words"] for r in quality.quality_rules(df).collect()}
    assert all(out[i] == 6 for i in range(24)) and out[99] == 0
    left = {r["doc_id"]: r["text"] for r in quality.cleaned(df).collect()}
    assert left == {i: f"own words {chr(97 + i)}x stay" for i in range(24)} | {99: None}
