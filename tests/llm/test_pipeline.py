"""The corpus pipeline over small tables with nulls, repeated rows, copies, leaks and personal data."""

import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

os.environ["TOKENIZERS_PARALLELISM"] = "false"
P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "A train leaves with 12 apples and 5 pears while another one carries 12 apples more than before"


def make_tables(spark, folder, docs, labels, items):
    frames = {"documents": (docs, DOCS), "labels": (labels, "doc_id long, quality int, toxic int"), "benchmark": (items, "item_id long, text string")}
    for name, (rows, kind) in frames.items():
        spark.createDataFrame(rows, kind).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def corpus():
    """Documents with what each stage is to find, and the ids that are to stay."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    text = lambda n=40: " ".join(rng.choice(words) for _ in range(n))
    row = lambda i, t: (i, t, "en", "s", len(t or ""))
    docs = [row(i, text() + (" vile scum vile" if i % 5 == 0 else "")) for i in range(400)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(400)] + [(None, None, None), (9999, 0, 1)]
    base = text(90)
    extra = {1000: base, 1001: base, 1002: base + " end", 1003: text(20) + " " + ITEM.replace("12", "31").replace("5", "8") + " " + text(20), 1004: text() + " mail ann@host.example.org", 1005: None, 1006: "", 1007: text(3000)}
    docs += [row(i, t) for i, t in extra.items()] + [row(1004, extra[1004]), row(None, None), (2000, None, None, None, None)]
    stay = {i for i in range(400) if i % 5} | {1000, 1004, 1005, 1006, 1007, 2000, None}
    return docs, labels, [(1, ITEM), (2, None)], stay


def test_stages_find_their_own(spark, tmp_path):
    docs, labels, items, stay = corpus()
    folder = make_tables(spark, tmp_path, docs, labels, items)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "pii", "packing"]
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, rows, folder)
        assert out.columns == rows.columns
        out.write.parquet(f"{tmp_path}/stage{i}")
        rows = spark.read.parquet(f"{tmp_path}/stage{i}")
        left[name] = [r["doc_id"] for r in rows.collect()]
    gone = lambda a, b: set(left[a] if a else [r[0] for r in docs]) - set(left[b])
    assert gone(None, "toxicity") == {i for i in range(400) if i % 5 == 0}
    assert gone("toxicity", "ngram_jaccard") == {1001, 1002} and gone("ngram_jaccard", "decontamination") == {1003} and gone("decontamination", "pii") == set()
    assert set(left["pii"]) == stay and left["pii"].count(1004) == 1  # of a repeated row one stays
    mails = {r["text"].split()[-1] for r in rows.where("doc_id = 1004").collect()}
    assert len(mails) == 1 and mails != {"ann@host.example.org"}


def test_run_packs_what_is_left(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, labels, items, stay = corpus()
    got = corpus_pipeline.run(spark, make_tables(spark, tmp_path, docs, labels, items)).collect()
    assert {r["doc_id"] for r in got} == stay
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    at = 0
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["sequence_id"] * 4096 + r["offset"] == at and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r["ids"])) == r["ids_crc32"]
        at += r["length"]
    long_ = sorted((r["start"], r["ids"]) for r in got if r["doc_id"] == 1007)
    assert [x for _, ids in long_ for x in ids] == library.encode(dict((d[0], d[1]) for d in docs)[1007], add_special_tokens=False).ids + [2]


def test_empty_tables_pass_through(spark, tmp_path):
    folder = make_tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    docs, labels, _, _ = corpus()
    some = make_tables(spark, tmp_path / "b", docs[:20], [], [])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, some).collect()} == {r[0] for r in docs[:20]}
    assert spark.read.parquet(f"{some}/documents.parquet").where(F.col("text").isNull()).count() == 0


def test_near_duplicates_of_few_words(spark, tmp_path):
    """Two or three words in a whole table; of two equal texts one stays."""
    for texts, want in ((["a b c"], {0}), (["a b"], {0}), (["a", None, "b", "a"], {0, 1, 2})):
        rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS).coalesce(1)
        assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, rows, str(tmp_path)).collect()} == want
