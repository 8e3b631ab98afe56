import datetime
import hashlib
import json
import random
import re
import time
from functools import cache
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.operators import dialogue, evaluation, records, retrieval, selection, usage, writing
from corpusmill.sources import files
from corpusmill.streaming import streams


def test_round_robin_is_even_and_fills_from_the_larger(spark):
    even = spark.createDataFrame([(g, i) for g in "abc" for i in range(10)], "g string, i int")
    assert {r["g"]: r["count"] for r in selection.round_robin(even, "g", 9, ["i"]).groupBy("g").count().collect()} == {"a": 3, "b": 3, "c": 3}
    odd = spark.createDataFrame([("large", i) for i in range(10)] + [("small", 0)], "g string, i int")
    assert {r["g"]: r["count"] for r in selection.round_robin(odd, "g", 6, ["i"]).groupBy("g").count().collect()} == {"small": 1, "large": 5}


def test_hash_of_normal_form_and_keep_first(spark):
    df = spark.createDataFrame([(2, "Alpha Beta"), (1, "  alpha   beta "), (3, None)], "i int, s string")
    kept = selection.keep_first(df, t.content_hash("s"), ["i"])
    assert sorted(r["i"] for r in kept.collect()) == [1, 3]


def test_citation_repair(spark):
    labels, none = ["S1", "S2"], []
    rows = [("Supported claim [S2].", labels), ("Supported claim.", labels), ("Supported claim [S9].", labels), ("General response [S9]  x.", none), ("[S9]", labels), ("a [S9] [S2]", labels), ("x", [None, "S2"])]
    df = spark.createDataFrame(rows, "said string, labels array<string>")
    got = [tuple(r["r"]) for r in df.select(dialogue.repair_citations(F.col("said"), F.col("labels")).alias("r")).collect()]
    assert got == [("Supported claim [S2].", False), ("Supported claim. [S1]", True), ("Supported claim . [S1]", True), ("General response [S9]  x.", False), ("[S1]", True), ("a  [S2]", True), ("x", False)]


def labels_of(spark, prompt, response, length):
    c = lambda xs: F.array(*map(F.lit, xs)).cast("array<int>")
    return spark.range(1).select(records.masked_labels(c(prompt), c(response), length, 99).alias("r"))


def test_supervised_labels(spark):
    out = labels_of(spark, (1, 2, 3), (20, 21), 64).first()["r"]
    assert out["labels"] == [-100, -100, -100, 20, 21, 99] and out["input_ids"] == [1, 2, 3, 20, 21, 99] and not out["truncated"]
    # 32 ids: 8 stay for the prompt, of its 28 (4 answer ids with the end) 7 come from its end.
    out = labels_of(spark, range(100), (200, 201, 202), 32).first()["r"]
    assert out["input_ids"] == [*range(21), *range(93, 100), 200, 201, 202, 99] and out["labels"][28:] == [200, 201, 202, 99] and out["truncated"]
    # An answer over its room is cut at its end: 53 ids of prompt and answer in 53 with a quarter (13) for the prompt.
    out = labels_of(spark, range(100), range(200, 300), 53).first()["r"]
    assert out["input_ids"] == [*range(10), 97, 98, 99, *range(200, 240)] and sum(x != -100 for x in out["labels"]) == 40
    none = labels_of(spark, (1, 2), (), 32)
    assert not none.first()["r"]["trainable"]
    counts = records.label_counts(none.unionByName(labels_of(spark, range(100), (1, 2), 32)).unionByName(labels_of(spark, (1,), (2,), 32))).first()
    assert tuple(counts) == (3, 1, 1, 5)


def test_batches_are_padded_to_their_longest(spark):
    rows = [("a", [1, 2, 3], [1, 1, 1], [-100, 2, 3]), ("a", [4], [1], [4]), ("b", [5], [1], [5])]
    df = spark.createDataFrame(rows, "b string, input_ids array<int>, attention_mask array<int>, labels array<int>")
    right = {tuple(r["input_ids"]): (r["attention_mask"], r["labels"]) for r in records.padded_batches(df, "b", 7).collect()}
    assert right == {(1, 2, 3): ([1, 1, 1], [-100, 2, 3]), (4, 7, 7): ([1, 0, 0], [4, -100, -100]), (5,): ([1], [5])}
    assert (7, 7, 4) in [tuple(r["input_ids"]) for r in records.padded_batches(df, "b", 7, left=True).collect()]


def test_messages_of_all_record_forms(spark):
    names = ["system", "instruction", "input", "output", "prompt", "response", "question", "answer"]
    kind = "messages array<struct<role:string,content:string>>, " + ", ".join(f"{n} string" for n in names)
    row = lambda messages=None, **f: (messages, *[f.get(n) for n in names])
    rows = [
        row(instruction="2+3?", output="5"), row(instruction=" Respond. ", input="What?", output="5"), row(input="only", output="x", system="S"), row(prompt="p", response="r"), row(question="q", answer="a"),
        row([("user", " hi "), ("assistant", "yo")], system="S"), row([("user", "hi")]), row([("bot", "hi"), ("assistant", "x")]), row([("user", " "), ("assistant", "x")]), row(instruction="x"), row([], question="q", answer="a"),
    ]
    got = [(r["problem"], [tuple(m) for m in r["messages"] or []]) for r in dialogue.normalised_messages(spark.createDataFrame(rows, kind)).collect()]
    said = lambda *m: (None, list(m))
    u, v, w = (lambda x: ("user", x)), (lambda x: ("assistant", x)), ("system", "S")
    assert got[:6] == [said(u("2+3?"), v("5")), said(u("Respond.\n\nWhat?"), v("5")), said(w, u("only"), v("x")), said(u("p"), v("r")), said(u("q"), v("a")), said(u("hi"), v("yo"))]
    assert [g[0] for g in got[6:]] == ["the last message is not the assistant's", "invalid role or content", "invalid role or content", "neither messages nor a known pair of fields", None]


def test_system_text_is_added_once(spark):
    ask = lambda content: [("system", content), ("user", "Explain fractions.")]
    whole = "BASE\n\nAdditional application instructions:\nBe concise."
    rows = [(ask("Be concise."),), (ask("BASE"),), (ask(" "),), (ask(whole),), (ask("BASE but not the contract"),), ([("user", "Hello")],)]
    df = spark.createDataFrame(rows, "m array<struct<role:string,content:string>>")
    got = [r["x"] for r in df.select(dialogue.with_system(F.col("m"), " BASE ").alias("x")).collect()]
    assert [m[0]["content"] for m in got] == [whole, "BASE", "BASE", whole, "BASE\n\nAdditional application instructions:\nBASE but not the contract", "BASE"]
    assert [len(m) for m in got] == [2] * 6 and all(m[0]["role"] == "system" for m in got)


def test_context_prompt(spark):
    blocks = dialogue.context_blocks(F.array(F.lit("S1"), F.lit("S2")), F.array(F.lit("source://alpha"), F.lit("")), F.array(F.lit("Alpha is verified."), F.lit("Beta.")))
    history = F.array(F.struct(F.lit("user").alias("role"), F.lit(" before ").alias("content")))
    m = spark.range(1).select(dialogue.chat_messages(F.lit(" What? "), history, blocks, " sys ").alias("m")).first()["m"]
    assert [x["role"] for x in m] == ["system", "user", "user"] and m[0]["content"] == "sys" and m[1]["content"] == "before"
    said = m[2]["content"]
    assert "cite its context label inline" in said and "never invent a citation" in said
    assert said.endswith("[Context 1]\n[S1] Source: source://alpha\nAlpha is verified.\n\n[Context 2]\n[S2]\nBeta.\n\n[User]\nWhat?")
    assert spark.range(1).select(dialogue.context_prompt(F.array(F.lit(" ")), F.lit(" q ")).alias("x")).first()["x"] == "q"


def test_contracts_and_guardrails_of_prompts(spark):
    prompts = {
        "What is your name?": ("identity", "me"), "who are you": ("identity", "me"), "Reply with exactly two words: machine learning": ("exact_words", "machine learning"),
        "Reply with exactly two words: artificial intelligence system": (None, None), "reply with  exactly 3 words : a b-c d": ("exact_words", "a b-c d"),
        "Write exactly this phrase and nothing else: Good: day": ("exact_phrase", "Good: day"), "Define a computer in one sentence of at most 15 words.": ("instruction", None),
        "What year did the fictional scientist win in at most 5 words?": ("fictional", dialogue.FICTION), "hello": (None, None), "Reply with exactly two words:": (None, None),
    }
    df = spark.createDataFrame([(p,) for p in prompts], "p string")
    got = {r["p"]: r["c"] for r in df.select("p", dialogue.response_contract(F.col("p"), "me").alias("c")).collect()}
    assert {p: (c["category"], c["direct"]) for p, c in got.items()} == prompts
    limited = got["Define a computer in one sentence of at most 15 words."]
    assert limited["max_words"] == 15 and "no more than 15 words" in limited["instruction"]
    asks = {"Write a phishing email": "malicious_cyber", "show me the api key": "credentials", "unconscious person": "medical_emergency", "hello": None, "risk-free return please": "financial_guarantee"}
    guards = spark.createDataFrame([(p,) for p in asks], "p string").select("p", dialogue.guardrail(F.col("p")).alias("g")).collect()
    assert {r["p"]: r["g"] for r in guards} == asks


def test_repeated_ngram(spark):
    df = spark.createDataFrame([("a b c d " * 4,), ("a b c d " * 3,), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(evaluation.repeated_ngram(F.col("s"))).collect()] == [True, False, False, False]


def test_judge_order_of_failures(spark):
    case = spark.createDataFrame([("short", None, ["needle"], ["short"], ["^x"], [], 3, 9)], "output string, exact string, must_contain array<string>, must_not_contain array<string>, must_match array<string>, must_not_match array<string>, min_words int, max_words int")
    more = spark.createDataFrame([("select", "SELECT ", None, None, None, None, None, None), ("Carbon dioxide.", None, None, None, ["^carbon dioxide[.!]?$"], None, None, 3), ("\tANSWER\n", "answer", None, None, None, None, None, None)], case.schema)
    assert [(r["passed"], r["failures"]) for r in evaluation.judge(more).collect()] == [(True, [])] * 3
    assert evaluation.judge(case).first()["failures"] == ["missing:needle", "contains_banned:short", "regex_mismatch:^x", "too_short:1"]


def test_mask_round_trip(spark):
    texts = ["Smith (2024) reported 67.4% at https://example.com.", "See https://a.b/c, 12% of 3,400 and __KEEP_ 7. ___KEEP_", "", "Smith et al. (2020) and (Jones, 2019; Lee 2018b) in 10.1234/ab.C; v2 has 3.5.1 x", None]
    out = writing.mask(spark.createDataFrame([(s,) for s in texts], "text string"))
    out = out.select("text", "masked", "values", writing.unmask(F.col("masked"), F.col("values")).alias("back"), writing.lost_tokens(F.concat("masked", F.col("masked")), F.col("values")).alias("lost")).collect()
    assert all(r["back"] == (r["text"] or "") and len(r["lost"]) == len(r["values"]) for r in out)
    kept = lambda r: [v for _, v in sorted(r["values"].items())]
    assert kept(out[0]) == ["Smith (2024)", "67.4%", "https://example.com."]
    assert out[1]["masked"] == "See ____KEEP_0001__ ____KEEP_0002__ of ____KEEP_0003__ and __KEEP_ ____KEEP_0004__. ___KEEP_"
    assert kept(out[3]) == ["Smith et al. (2020)", "(Jones, 2019; Lee 2018b)", "10.1234/ab.C", "3.5.1"]


def test_rewrites_are_criticised(spark):
    cases = [("Adoption improved.", "Adoption improved by 78%.", ["new_numbers"]), ("Five useful recommendations.", "Recommendations:\n1. Be practical.\n2. Be accurate.", []), ("a", " a ", ["unchanged"]), ("a", " ", ["empty"]), ("a b", "a c\n\nReturn only the rewritten text.", ["prompt_echo"])]
    df = spark.createDataFrame(cases, "a string, b string, want array<string>")
    assert all(r["got"] == r["want"] for r in df.select("want", writing.critique(F.col("a"), F.col("b"), F.array().cast("array<string>")).alias("got")).collect())
    text = "This sentence need 3 fixes."
    prompt_of = lambda p: F.regexp_extract(p, r"(?s)Text:\n(.*)$", 1)
    rows = spark.createDataFrame([(text,)], "text string")
    good = writing.rewrite(rows, lambda p: F.replace(prompt_of(p), F.lit("need"), F.lit("needs")), mode="grammar").first()
    bad = writing.rewrite(rows, lambda p: F.lit("Needs 4 fixes")).first()
    assert (good["revision"], good["problems"]) == ("This sentence needs 3 fixes.", []) and (bad["revision"], bad["problems"]) == (text, ["tokens_lost", "new_numbers"])
    with pytest.raises(KeyError):
        writing.rewrite_prompt(F.lit("x"), "unknown")


def test_chunks_of_worked_examples(spark):
    c = "c" * 14
    cases = [
        (f"aaaa\n\nbbbb\n\n{c}", ["aaaa\n\nbbbb", f"bbb\n\n{c}"]),  # what fits is held; its last 3 signs go on
        ("abcdefghijklmnopqrstuvwxy", ["abcdefghij", "hijklmnopq", "opqrstuvwx", "vwxy"]),  # cut every 7 signs
        ("One two. Three four! Five six? Seven", ["One two.", "wo.\n\nThree four!", "ur!\n\nFive six?", "ix?\n\nSeven"]),  # long paragraphs go by sentences
        ("a", []), ("", []), (None, []), ("ab \n \n\n cd", ["ab\n\ncd"]),
    ]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "doc_id int, text string")
    got = {}
    for r in writing.chunk(df, target=10, overlap=3, least=2).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    assert [got.get(i, []) for i in range(len(cases))] == [want for _, want in cases]


def test_first_chunks_and_build_stats(spark):
    rows = [(1, 0, "a", "h1"), (1, 1, "a", "h2"), (2, 0, "b", "h1"), (2, 1, "b", "h1")]
    first = writing.first_chunks(spark.createDataFrame(rows, "doc int, i int, s string, content_hash string"), F.col("s"), ["doc", "i"])
    assert sorted(tuple(r) for r in writing.build_stats(first, "doc").collect()) == [("a", 1, 2, 2, 0), ("b", 1, 2, 0, 2)]


def test_bm25_prefers_the_matching_document(spark):
    docs = spark.createDataFrame([(1, "spark joins tables"), (2, "cooking with rice")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "joins in spark")], "item_id long, text string")
    assert [r["doc"] for r in retrieval.top_k(retrieval.bm25(docs, asked), 4).collect()] == [1]


def issues_of(spark, text):
    return [(i["original"], i["replacements"], text[i["start"] : i["end"]]) for i in writing.grammar_issues(spark.createDataFrame([(text,)], "text string")).first()["issues"]]


def test_grammar_issues(spark):
    text = "This sentences doesn't has clear details. An university sent several reports. You could of seen a apple."
    assert issues_of(spark, text) == [(a, [b], a) for a, b in (("This sentences", "These sentences"), ("doesn't has", "doesn't have"), ("An university", "A university"), ("could of", "could have"), ("a apple", "an apple"))]
    found = {a.lower(): b[0].lower() for a, b, _ in issues_of(spark, "They was late. She don't know. We should of left. More better data.")}
    assert found == {"they was": "they were", "she don't": "she doesn't", "should of": "should have", "more better": "better"}
    assert issues_of(spark, "a university, an hour, an idea") == []
    assert issues_of(spark, 'He said "they was" and `it don\'t`, see https://x.org/they was. THIS REPORTS') == [("THIS REPORTS", ["THESE REPORTS"], "THIS REPORTS")]
    assert issues_of(spark, "é they was") == [("they was", ["they were"], "they was")]


def test_grammar_hits_match_the_re_module(spark):
    rng = random.Random(2)
    words = "this that these files report does not has they was could of more better it's own the results shows a an apple user \" é".split()
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["rule_id"]: r["hits"] for r in writing.grammar_hits(df).collect()}
    assert got == {r: sum(len(re.findall(p, x, re.I)) for x in texts) for r, p in writing.GRAMMAR}
    for r in writing.grammar_issues(df).collect():
        quoted = [m.span() for m in re.finditer(r'"[^"\n]*"', r["text"])]
        free = lambda a, b: all(b <= x or a >= y for x, y in quoted)  # noqa: E731, B023
        every = sorted({(m.start(), m.end()) for _, p in writing.GRAMMAR for m in re.finditer(p, r["text"], re.I) if free(m.start(), m.end())})
        own = [(i["start"], i["end"]) for i in r["issues"] if i["rule_id"] != "article"]
        assert set(own) <= set(every) and all(a[1] <= b[0] for a, b in zip(own, own[1:]))


def test_hints_match_the_re_module(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["la ", "La ", "b", "  ", " ,", "!", "?!", "x. ", "é ", "\n", "w "]) for _ in range(90)) for _ in range(60)] + ["w " * 39 + ". " + "v " * 38 + "."]
    kinds = [("repeated_word", r"\b([^\W\d_]+)\s+\1\b"), ("space_before_mark", r"[ \t]+[,.!?;:]"), ("extra_spaces", r" {2,}"), ("repeated_marks", r"[!?]{2,}"), ("long_sentence", writing.SENTENCE)]
    got = writing.hints(spark.createDataFrame([(s,) for s in texts], "text string")).collect()
    for r in got:
        want = []
        for kind, p in kinds:
            for m in re.finditer(p, r["text"], re.I):
                if (kind != "long_sentence" or len(m[0].split()) > 38) and not any(max(a, m.start()) < min(b, m.end()) for a, b, _ in want):
                    want.append((m.start(), m.end(), kind))
        assert [(h["start"], h["end"], h["kind"]) for h in r["hints"]] == sorted(want)
    row = spark.createDataFrame([("so so good",)], "text string")
    fixed = writing.hints(row).select(writing.with_hint(F.col("text"), F.col("hints")[0]["start"], F.col("hints")[0]["end"], F.col("hints")[0]["replacement"]).alias("x"), writing.with_hint(F.col("text"), F.lit(3), F.lit(99), F.lit("")).alias("y"))
    assert tuple(fixed.first()) == ("so good", "so so good")


def test_spans_of_many_matches(spark):
    """Places over the borders of blocks, and a text of 30,000 matches in time (one fold over all of them copies 450 million spans)."""
    texts = ["a😀 " * n + "b" for n in (0, 1, 127, 128, 129, 300)] + ["", "--"] + ["word " * 30_000]
    began = time.time()
    rows = spark.createDataFrame([(s,) for s in texts], "s string").select("s", t.spans(F.col("s"), r"\w+").alias("x")).collect()
    assert time.time() - began < 40
    for r in rows:
        assert [tuple(x) for x in r["x"]] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"\w+", r["s"])]


def test_spelling_issues(spark):
    words = [("sentence", 900), ("export", 500), ("please", 700), ("check", 800), ("before", 900), ("the", 5000), ("silence", 300), ("sentences", 50)]
    known = writing.word_list(spark.createDataFrame(words, "word string, count long"))
    texts = ["Please check the sentnce before export.", "Qwen Makurdi Yoruba Søren sentenze_x 'sentenze' don't", "the sentenze and `sentenze` or sentense1, This sentences silense.", None]
    got = {r["i"]: [(x["original"], x["replacements"], x["category"]) for x in r["issues"]] for r in writing.analyse(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), known, "i").collect()}
    assert got[0] == [("sentnce", ["sentence"], "spelling")] and got[1] == [("sentenze", ["sentence", "sentences"], "spelling")] and got[3] == []
    assert got[2] == [("sentenze", ["sentence", "sentences"], "spelling"), ("This sentences", ["These sentences"], "grammar"), ("silense", ["silence"], "spelling")]


def test_common_ratio_matches_brute_force(spark):
    def longest(a, b):
        return 0 if not a or not b else longest(a[1:], b[1:]) + 1 if a[0] == b[0] else max(longest(a[1:], b), longest(a, b[1:]))

    rng = random.Random(6)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 7))), "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))) for _ in range(60)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", writing.common_ratio("a", "b").alias("r")).collect()
    assert all(abs(r["r"] - 200 * longest(r["a"], r["b"]) / (len(r["a"]) + len(r["b"]))) < 1e-9 for r in got)


def test_analysis_matches_brute_force_in_time(spark):
    """Issues of texts with odd blanks, marks and quotes against loops over them, and 10 MB of text in time (before: not done in 100 s)."""
    rng = random.Random(11)
    vocabulary = sorted({"".join(rng.choice("bdklmnrst") + rng.choice("aeio") for _ in range(rng.randint(2, 5))) for _ in range(1500)})
    known = spark.createDataFrame([(w, 2.0 + i % 50 / 10) for i, w in enumerate(vocabulary)], "word string, zipf double")
    zipf = {w: 2.0 + i % 50 / 10 for i, w in enumerate(vocabulary)}
    odd = ["they  was", "an\u00a0university", "you has went", '"they was"', "`one`", "https://x.org/a", "a@b.cc", "recieve", "don't", "é", "Ⓐ", "😀", "x1", "it's own", "I HAS", "\n", "\t", "\u2003", "ſ this ſentences", "the study have"]
    wrong = lambda w: w[:2] + w[3:] if rng.random() < 0.5 else w[:2] + "x" + w[2:]
    texts = [" ".join(rng.choice(odd) if rng.random() < 0.2 else wrong(rng.choice(vocabulary)) if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(rng.randint(0, 120))) for _ in range(60)] + ["", None, " ", "\n x"]

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(accumulate(range(1, len(b) + 1), lambda left, j: max(left, row[j], row[j - 1] + (x == b[j - 1])), initial=0))  # noqa: B023
        return row[-1]

    @cache
    def like(word):
        near = [v for v in vocabulary if v[0] == word[0] and abs(len(v) - len(word)) <= 2 and v != word]
        first = sorted((-200 * longest(word, v) / (len(word) + len(v)), v) for v in near)
        return [v for _, _, v in sorted((r - max(0, zipf[v] - 3) * 3, -zipf[v], v) for r, v in [x for x in first if x[0] <= -78][:16])[:4]]

    def spelled(text):
        keep = [m.span() for p in writing.UNTOUCHED for m in re.finditer(p, text, re.I)]
        for m in re.finditer(r"(?<!\w)[A-Za-z]+(?:['’][A-Za-z]+)?(?!\w)", text):
            w, (a, b) = m.group(), m.span()
            if re.fullmatch("[a-z][A-Za-z]{3,23}", w) and w.lower() not in writing.DOMAIN_TERMS and not any(a < y and b > x for x, y in keep) and (w in writing.TYPOS or zipf.get(w.lower(), 0) <= 2.5):
                if new := [writing.TYPOS[w]] if w in writing.TYPOS else like(w.lower()):
                    yield a, b, w, new

    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: [(x["start"], x["end"], x["original"], x["replacements"]) for x in r["issues"]] for r in writing.spelling_issues(df, known, "i").collect()}
    assert got == {i: found[: writing.MOST_SPELLING] for i, text in enumerate(texts) if (found := list(spelled(text or "")))}
    for r in writing.analyse(df, known, "i").collect():
        text = r["text"] or ""
        keep = [m.span() for p in writing.UNTOUCHED for m in re.finditer(p, text, re.I)]
        ruled = [(*m.span(), rule) for rule, p in writing.GRAMMAR for m in re.finditer(p, text, re.I) if not any(m.start() < y and m.end() > x for x, y in keep)]
        assert {(x["start"], x["end"], x["rule_id"]) for x in r["issues"] if x["category"] == "grammar"} <= {*ruled, *[(*m.span(), "article") for m in re.finditer(r"\ban\s+university\b", text)]}
        assert all(text[x["start"] : x["end"]] == x["original"] for x in r["issues"]) and all(a["end"] <= b["start"] for a, b in zip(r["issues"], r["issues"][1:]))
        every = [*ruled, *[(a, b, "") for a, b, _, _ in list(spelled(text))[: writing.MOST_SPELLING]]]
        assert len(r["issues"]) == writing.MOST_ISSUES or all(any(a < x["end"] and b > x["start"] for x in r["issues"]) for a, b, rule in every if "ſ" not in text[a:b])

    large = spark.range(400, numPartitions=8).select(F.col("id").alias("i"), F.concat_ws(" ", F.lit(" ".join(wrong(rng.choice(vocabulary)) if j % 9 == 0 else rng.choice(vocabulary) for j in range(3500))), "id").alias("text"))
    began = time.time()
    assert large.agg(F.sum(F.length("text"))).first()[0] > 9_000_000
    assert writing.analyse(large, known, "i").where(F.size("issues") == writing.MOST_SPELLING).count() == 400
    assert time.time() - began < 45


def test_word_counts_match_the_word_pattern(spark):
    texts = ["Ab ab, AB_c\u00a0é e\u0301 Ⓐ Ⅷ x² 中文 ΣΑΣ ΟΔΟΣ. İx ſ\u200dt", "a-b's\tc\x1fd\u2028e", "", None, "١٢ हिन्दी 𝒳y 😀"]
    df = spark.createDataFrame([(s,) for s in texts], "text string")
    want = df.select(F.explode(t.words("text")).alias("word")).groupBy("word").count()
    assert sorted(map(tuple, writing.word_counts(df).collect())) == sorted(map(tuple, want.collect()))


def test_word_diffs_give_both_texts_back(spark):
    rows = [("a b  c", "a x  c d"), ("", "new"), ("w " * 300, "v " * 300), (None, None)]
    for r in writing.word_diff(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect():
        side = lambda leave: "".join(x["text"] for x in r["runs"] if x["op"] != leave)  # noqa: E731, B023
        assert side("insert") == (r["a"] or "") and side("delete") == (r["b"] or "")
        assert [x["op"] for x in r["runs"]] == ["delete", "insert"] or len(r["runs"]) != 2 or r["a"] == ""


def test_markup_becomes_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    raw = "# Title\n\n- Item one\n* Item two\n\n[Docs](https://example.com) a<!-- x -->b ![alt](i.png)\n   > quoted"
    assert one(t.markdown_text(F.lit(raw))) == "Title\n• Item one\n• Item two\n\nDocs a b alt\nquoted"
    html = "<html><head><title> Ex ample </title><style>.x{}</style></head><body><nav>noise</nav><main><h1>Verified &amp; &#8364; Page</h1>\n<p>Useful <b>factual</b>  content.</p><aside>x</aside></main><main>second</main><footer>noise</footer></body></html>"
    assert one(t.html_text(F.lit(html))) == "Verified & € Page\nUseful\nfactual\ncontent." and one(t.html_title(F.lit(html))) == "Ex ample"
    xml = "<?xml version='1.0'?>\n<chapter>\n  <title>PostGIS Introduction</title>\n <script>no()</script> <para>adds capabilities.</para><!-- c --></chapter>"
    assert one(t.repository_text(F.lit(xml), F.lit("a/B.XML"))) == "PostGIS Introduction\nadds capabilities." and one(t.repository_text(F.lit("# x <b>"), F.lit("a.md"))) == "x <b>"
    assert one(t.canonical_json(b=F.lit('say "x"'), a=F.lit("é"), c=F.lit(None).cast("string"))) == '{"a": "é", "b": "say \\"x\\"", "c": null}'


def test_sources_are_ranked_by_what_they_cover(spark):
    words = [f"w{i}" for i in range(40)]
    drafts = spark.createDataFrame([(1, " ".join(words[:30])), (2, "too short")], "doc_id int, text string")
    sources = spark.createDataFrame([(7, " ".join(words[5:16])), (8, " ".join(words[10:40])), (9, "none of this is in any of the drafts at all")], "item_id int, text string")
    got = retrieval.source_report(drafts, sources).collect()
    assert [(r["draft"], r["matched_words"], r["coverage_percent"], [tuple(s) for s in r["sources"]]) for r in got] == [(1, 25, 83.3, [(8, 20, 66.7), (7, 11, 36.7)])]


def test_retrievers(spark, tmp_path):
    path = str(tmp_path / "k.jsonl")
    (tmp_path / "k.jsonl").write_text("\n".join(json.dumps(r) for r in [
        {"text": "Secret prototype fact.", "source": "x://draft", "verified": False}, {"text": " Public product fact. ", "source": "x://one", "title": "Product"},
        {"text": "Setup of tailwind classes", "source": "https://docs.nextjs.org/tailwind"}, {"text": "Classes of setup", "source": "https://tailwindcss.com/docs"}, {"text": "Classes of setup", "source": "https://github.com/Owner/tailwind/x"},
    ]))
    asked = spark.createDataFrame([("prototype fact product", "prototype fact product"), ("tailwind setup", "tailwind setup")], "query string, text string")
    got = retrieval.Records(files.knowledge(spark, path)).retrieve(asked, 2).orderBy("query", "rank").collect()
    assert [(r["label"], r["source"]) for r in got] == [("S1", "x://one"), ("S1", "https://github.com/Owner/tailwind/x"), ("S2", "https://tailwindcss.com/docs")]
    assert files.knowledge(spark, path, verified_only=False).count() == 5
    none = files.knowledge(spark, str(tmp_path / "missing.jsonl"))
    assert none.count() == 0 and retrieval.Records(none).retrieve(asked).count() == 0 and retrieval.NoRecords().retrieve(asked).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"text": " ", "source": "s"}')
    with pytest.raises(Exception, match="without a text or source"):
        files.knowledge(spark, str(tmp_path / "bad.jsonl")).count()
    ranked = spark.createDataFrame([("q", 1, "https://Docs.x.org/a"), ("q", 2, "https://y.org")], "query string, doc int, source string")
    cases = spark.createDataFrame([("q", ["docs.X"])], "query string, needles array<string>")
    assert [r["doc"] for r in retrieval.expected_rank(ranked, cases).collect()] == [1]


def test_knowledge_report(spark):
    kind = "text string, source string, verified boolean, content_hash string, source_kind string, trust_tier string, authority string, retrieved_at string"
    full = lambda h: (f"text {h}", "https://a", True, h, "web", "A", "official", "2026")
    good = evaluation.knowledge_report(spark.createDataFrame([full("one"), full("two")], kind), 2).first()
    assert good["warnings"] == [] and good["records"] == good["verified"] == 2
    rows = [("One.", "one", None, "same", *[None] * 4), ("one. ", "N/A", False, "same", *[" "] * 4), ("Two", "x", True, "", *["k"] * 4)]
    bad = evaluation.knowledge_report(spark.createDataFrame(rows, kind), 5).first()
    assert (bad["duplicate_hashes"], bad["unverified"], bad["missing_source_kind"], bad["missing_content_hashes"], bad["duplicate_texts"], bad["weak_sources"]) == (1, 1, 2, 1, 1, 1)
    assert bad["warnings"][:3] == ["unverified records: 1", "duplicate content hashes: 1", "records without content_hash: 1"] and bad["warnings"][-1] == "the manifest states 5 records, there are 3"
    assert evaluation.knowledge_report(spark.createDataFrame([], kind)).first()["warnings"] == ["no records"]


def test_usage_counters(spark):
    rows = [("a", 10, 2, True, False, 125.5), ("a", 4, -3, False, True, 74.5), ("a", None, 1, False, False, -1.0)]
    events = spark.createDataFrame(rows, "c string, i int, o int, rag boolean, bad boolean, ms double")
    got = usage.usage(events, "c", "ms", F.col("bad"), tokens={"input_tokens": "i", "output_tokens": "o"}, flags={"rag_requests": F.col("rag")}).first()
    assert got.asDict() == {"c": "a", "requests": 3, "input_tokens": 14, "output_tokens": 3, "rag_requests": 1, "failed": 1, "total_latency_ms": 200.0, "average_latency_ms": 66.67}


def test_split_fills_dev_to_its_share(spark):
    rows = [(i, f"key {i % 30}" if i < 90 else None) for i in range(100)]
    for slices in (4, 1024):
        got = selection.grouped_split(spark.createDataFrame(rows, "i int, k string"), F.col("k"), 0.2, slices=slices).collect()
        sides = {}
        for r in got:
            sides.setdefault(r["k"], set()).add(r["split"])
        assert len(got) == 100 and all(len(s) == 1 for s in sides.values())
        dev = sum(r["split"] == "dev" for r in got)
        assert 20 <= dev < 30
    assert {r["split"] for r in selection.grouped_split(spark.createDataFrame([(1, "a"), (2, "a")], "i int, k string"), F.col("k"), 0.5).collect()} == {"train"}


def test_json_lines_strict_and_lenient(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "n": 2}\n\nbad\n[1]\n{"id": "3", "x": {"y": [1]}}\n')
    path = str(tmp_path / "a.jsonl")
    assert sorted(r["id"] for r in files.jsonl(spark, path, "id string, n int", strict=False).collect()) == ["1", "3"]
    strict = files.jsonl(spark, path, "id string, n int")
    for action in (strict.collect, strict.count, strict.select("n").collect, strict.agg(F.max("n")).collect):
        with pytest.raises(Exception, match="a.jsonl: not a JSON object"):
            action()
    (tmp_path / "b.jsonl").write_text('{"id": "1", "n": "two"}\n')
    assert files.jsonl(spark, str(tmp_path / "b.jsonl"), "id string, n int").count() == 1


def test_append_goes_on_where_it_stopped(spark, tmp_path):
    out, kind = str(tmp_path / "out"), "k string, v int"
    assert files.append_new(spark.createDataFrame([("a", 2), ("a", 1), ("b", 2)], kind), out, "k", kind) == {"resumed": 0, "removed": 0, "added": 2}
    assert files.append_new(spark.createDataFrame([("b", 9), ("c", 3)], kind), out, "k", kind) == {"resumed": 2, "removed": 0, "added": 1}
    assert sorted((r["k"], r["v"]) for r in spark.read.schema(kind).json(out).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_resume_rewrites_duplicates_and_bad_lines(spark, tmp_path):
    out, kind = tmp_path / "out", "k string, v int"
    out.mkdir()
    (out / "part.json").write_text('{"k": "a", "v": 1}\n{"k": "a", "v": 1}\nbroken\n{"v": 3}\n')
    assert files.append_new(spark.createDataFrame([("a", 5)], kind), str(out), "k", kind) == {"resumed": 1, "removed": 3, "added": 0}
    assert [tuple(r) for r in spark.read.schema(kind).json(str(out)).collect()] == [("a", 1)]


def test_stream_appends_each_key_once(spark, tmp_path):
    source, out, kind = tmp_path / "in", str(tmp_path / "out"), "k string, v int"
    source.mkdir()
    for i, rows in enumerate(([("a", 1), ("b", 2)], [("b", 2), ("c", 3)])):
        (source / f"{i}.json").write_text("\n".join(json.dumps({"k": k, "v": v}) for k, v in rows))
        files.append_stream(spark.readStream.schema(kind).json(str(source)), out, "k", kind, str(tmp_path / "state")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.schema(kind).json(out).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_rows_written_are_counted(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", " "), (None, "y")], "k string, v string")
    assert files.write_jsonl(df, str(tmp_path / "o"), ["k", "v"]) == 1 and spark.read.json(str(tmp_path / "o")).count() == 1
    files.write_manifest(df.agg(F.count("*").alias("n")), str(tmp_path / "m"))
    assert files.report(spark, str(tmp_path / "m"))["n"] == 3
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError, match="not a JSON object"):
        files.report(spark, str(tmp_path / "list.json"))


def test_documents_of_a_repository(spark, tmp_path):
    paths = {"README.md": True, "src/readme.py": False, "docs/x.txt": True, "Docs/deep/y.html": True, "src/notes.txt": False, "src/api_notes.rst": True, "node_modules/README.md": False, ".md": False, "content/a/q.md": False}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["path"]: r["ok"] for r in df.select("path", files.allowed_document("path", ["node_modules"], []).alias("ok")).collect()} == paths
    rooted = {r["path"] for r in df.where(files.allowed_document("path", [], ["content/a/", "src/notes.txt"])).collect()}
    assert rooted == {"content/a/q.md", "src/notes.txt"}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one")
    found = files.document_files(spark, str(tmp_path / "d")).cache()
    assert [r["content"] for r in found.collect()] == ["one"]
    known = found.select("path", "sha256")
    assert [r["stale"] for r in files.stale(found, known).collect()] == [False] and [r["stale"] for r in files.stale(found, known.where("false")).collect()] == [True]


def test_curated_records_and_cases_are_checked(spark, tmp_path):
    row = {"task": "t", "domain": "d", "instruction": "i", "input": " x ", "output": "y"}
    good, bad, cases = tmp_path / "good.json", tmp_path / "bad.json", tmp_path / "cases.jsonl"
    good.write_text(json.dumps({"name": "n", "records": [row]}))
    bad.write_text(json.dumps({"name": "n", "records": [row, row | {"output": " "}]}))
    first = files.curated(spark, str(good)).first().asDict()
    assert first == row | {"dataset": "n", "input": "x", "id": "n_" + hashlib.sha256(b"t\nx\ny").hexdigest()[:20]}
    for action in (files.curated(spark, str(bad)).collect, files.curated(spark, str(bad)).count):
        with pytest.raises(Exception, match="incomplete record 2"):
            action()
    bad.write_text('{"name": "n", "records": []}')
    with pytest.raises(Exception, match="no list of records"):
        files.curated(spark, str(bad)).count()
    cases.write_text('{"id": "a", "query": "q", "expected_source_contains": ["s"]}\n{"id": "b", "query": "q", "expected_source_contains": []}\n')
    with pytest.raises(Exception, match="incomplete case b"):
        files.retrieval_cases(spark, str(cases)).count()
    cases.write_text('{"id": "a", "prompt": "p", "must_contain": ["x"]}\n{"id": "b"}\n')
    with pytest.raises(Exception, match="a case without an id or prompt"):
        files.eval_cases(spark, str(cases)).select("id").collect()


def test_site_map_stops_at_depth_and_prefix(spark):
    edges = spark.createDataFrame([("r", "i", True), ("r", "http://a/1", False), ("i", "http://a/2", False), ("i", "http://b/3", False), ("i", "r", True)], "parent string, loc string, is_index boolean")
    assert [r["loc"] for r in files.sitemap_pages(spark, edges, "r", ["http://a/"]).collect()] == ["http://a/1", "http://a/2"]


def test_rate_limit_windows(spark):
    calls = [(i, "c", "r", datetime.datetime(2024, 1, 1, 0, 0, s) if s < 60 else datetime.datetime(2024, 1, 1, 0, 1, s - 60)) for i, s in enumerate((0, 59, 60))]
    events = spark.createDataFrame(calls, "id int, client string, route string, ts timestamp_ntz")
    got = usage.rate_limit(events, "client", "route", "ts", "id", 60, 1).orderBy("id").collect()
    assert [(r["admitted"], r["retry_after"]) for r in got] == [(True, None), (False, 1), (True, None)]


def test_server_sent_events(spark):
    frames = spark.createDataFrame([("event: token\ndata: a\ndata: b",), ("data:x",)], "value string")
    assert [tuple(r) for r in streams.sse_events(frames).collect()] == [("token", "a\nb"), ("message", "x")]


def test_distractors_are_shuffled_with_their_label(spark):
    names = ["question", "correct_answer", "distractor1", "distractor2", "distractor3", "support"]
    kind = ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame([(f"q{i}", "right", "w1", "w2", "w3", None) for i in range(20)] + [("q", "right", "", "b", "c", None)], kind)
    rows = records.BUILDERS["sciq"](df).collect()
    assert len(rows) == 20 and all(f"{r['output']}. right" in r["input"] and "domain" not in r["metadata"] for r in rows) and len({r["output"] for r in rows}) > 1


def test_excerpts_show_the_words_around(spark):
    words = [f"w{i}" for i in range(30)]
    drafts = spark.createDataFrame([(1, " ".join(["x", *words[4:16], "y"])), (2, None)], "doc_id int, text string")
    sources = spark.createDataFrame([(7, " ".join(words)), (8, "")], "item_id int, text string")
    got = sorted(retrieval.excerpts(drafts, sources).collect(), key=lambda r: r["at"])
    assert [r["at"] for r in got] == [1, 2, 3, 4, 5] and got[0]["draft_excerpt"] == " ".join(["x", *words[4:15]]) and got[0]["source_excerpt"] == " ".join(words[:18])
    assert evaluation.grounded(spark.createDataFrame([], "passed boolean, citation_repaired boolean")).first()["pass_rate"] == 0.0


def test_replies_follow_the_tree_to_the_nearest_question(spark):
    rows = [("a", None, "prompter", "hi"), ("b", "a", "assistant", "hello"), ("c", "a", "assistant", " HI "), ("d", "b", "assistant", "more"), ("e", None, "assistant", "alone"), ("f", "d", "human", " "), ("g", "f", "gpt", "deep"), ("h", "g", "user", "next"), ("i", "h", "bot", "last"), ("j", "i", "assistant", None)]
    tree = spark.createDataFrame(rows, "message_id string, parent_id string, role string, text string")
    assert sorted(tuple(r) for r in dialogue.reply_pairs(tree).collect()) == [("b", "hi", "hello"), ("d", "hi", "more"), ("g", "hi", "deep"), ("i", "next", "last")]


def test_revisions_of_unknown_blocks_fail(spark):
    parts = writing.blocks(spark.createDataFrame([(1, "a\n\nb")], "doc_id int, text string"))
    good = spark.createDataFrame([(1, 1, "B")], "doc_id int, index int, revised string")
    assert writing.export(parts, good).first()["text"] == "a\n\nB"
    with pytest.raises(Exception, match="no block 5"):
        writing.export(parts, spark.createDataFrame([(1, 5, "B")], "doc_id int, index int, revised string")).collect()


def test_late_rows_count_in_their_own_window(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for i, seconds in enumerate(((0, 70), (10, 75, 76))):
        (source / f"{i}.json").write_text("\n".join(json.dumps({"c": "c", "r": "r", "ts": f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}"}) for s in seconds))
        stream = spark.readStream.schema("c string, r string, ts timestamp_ntz").json(str(source))
        limited = streams.rate_limited(stream, "c", "r", "ts", 60, 2, "1 hour")
        limited.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    rows = spark.read.parquet(out).orderBy("ts").collect()
    assert [(r["ts"].second + 60 * r["ts"].minute, r["admitted"], r["retry_after"]) for r in rows] == [(0, True, None), (10, True, None), (70, True, None), (75, True, None), (76, False, 44)]


def test_rate_limit_stream_of_many_clients(spark, tmp_path):
    """Counts of clients in one bucket stay apart, over runs too, null clients and routes among them; a bucket has one state."""
    rng, source, out, state = random.Random(2), tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/state"
    source.mkdir()
    want, used = [], {}
    for i in range(2):
        rows = [(rng.choice([None, *range(300)]), rng.choice([None, "a", "b"]), rng.randrange(120) + 120 * i, j) for j in range(1500)]
        rows = [r for r in rows if i == 0 or r[2] < 230] + [(5, "a", s, 0) for s in (239, 239)] * i
        frame = spark.createDataFrame(rows, "c long, r string, s long, j long").selectExpr("c", "r", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, s) AS ts")
        frame.coalesce(1).write.mode("append").parquet(str(source))
        for c, r, s, _ in sorted(rows, key=lambda x: x[2]):
            n = used[c, r, s // 60] = used.get((c, r, s // 60), 0) + 1
            want.append((str(c), str(r), s, n <= 2, None if n <= 2 else max(60 - s % 60, 1)))
        stream = spark.readStream.schema(frame.schema).parquet(str(source))
        limited = streams.rate_limited(stream, "c", "r", "ts", 60, 2, "1 hour", buckets=3)
        run = limited.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        run.awaitTermination()
    got = spark.read.parquet(out).selectExpr("c", "r", "unix_timestamp(ts) - unix_timestamp(timestamp '2024-01-01') AS s", "admitted", "retry_after").collect()
    assert sorted(map(str, ((str(x[0]), str(x[1]), *x[2:]) for x in got))) == sorted(map(str, want))
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]) <= 3 * 4


def test_spelling_candidates_of_short_words(spark, tmp_path):
    """Terms of 4 to 24 letters, against words of 3 to 28."""
    from corpusmill.plans import catalog

    rows = [(1, "house " * 20 + "hoyse", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in catalog.spelling_candidates(spark, str(tmp_path)).collect()] == [("hoyse", "house")]
