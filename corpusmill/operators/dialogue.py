"""Conversations: turn pairs, carried questions, fingerprints, prompts, citations, contracts, guardrails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def parent_pairs(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Assistant messages with the user message just before: an equi-join of the table with itself."""
    child = messages.where(F.col(role) == "assistant").select(conv, turn, F.col(text).alias("output"))
    parent = messages.where(F.col(role).isin("user", "prompter", "human")).select(conv, (F.col(turn) + 1).alias(turn), F.col(text).alias("input"))
    return child.join(parent, [conv, turn]).where(t.norm("input") != t.norm("output"))


ASKS, ANSWERS = ["user", "prompter", "human"], ["assistant", "bot", "gpt"]


def reply_pairs(messages: DataFrame, message: str = "message_id", parent: str = "parent_id", role: str = "role", text: str = "text") -> DataFrame:
    """message_id, input, output: answers in a tree with the nearest question above them; blank messages are passed by.

    Each round of the recursion takes what was asked one level down, until the next question."""
    spark = messages.sparkSession
    said = messages.select(F.col(message).alias("id"), F.col(parent).alias("parent"), F.col(role).alias("role"), t.strip(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    said = said.withColumn("asks", F.col("role").isin(ASKS) & (F.col("text") != ""))
    said.createOrReplaceTempView("__tree_messages")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")
    walked = spark.sql(
        """WITH RECURSIVE walk(id, asked) AS (
             SELECT id, text FROM __tree_messages WHERE asks UNION ALL
             SELECT m.id, w.asked FROM walk w JOIN __tree_messages m ON m.parent = w.id WHERE NOT m.asks)
           SELECT id, asked FROM walk"""
    )
    answers = said.where(F.col("role").isin(ANSWERS) & (F.col("text") != "")).join(walked, "id")
    return answers.where(t.norm("asked") != t.norm("text")).select(F.col("id").alias("message_id"), F.col("asked").alias("input"), F.col("text").alias("output"))


def carried_pairs(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Assistant messages with the nearest user message before them in the conversation."""
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col(role) == "user", F.col(text)), ignorenulls=True).over(before)
    out = messages.withColumn("input", asked).where((F.col(role) == "assistant") & F.col("input").isNotNull())
    return out.select(conv, turn, "input", F.col(text).alias("output")).where(t.norm("input") != t.norm("output"))


def chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation with its ordered messages."""
    turns = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return messages.groupBy(conv).agg(turns.alias("messages"))


def fingerprint(messages: Column) -> Column:
    lines = F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), t.strip(m["content"])))
    return t.sha(F.array_join(lines, "\n"))


def latest_user(messages: Column) -> Column:
    asked = F.filter(messages, lambda m: (m["role"] == "user") & (t.strip(m["content"]) != ""))
    return F.try_element_at(asked, F.lit(-1))["content"]


def dataset_stats(chat: DataFrame) -> DataFrame:
    """records, duplicates (by fingerprint), and messages of each role."""
    of = lambda role: F.size(F.filter("messages", lambda m: m["role"] == role))
    roles = [F.sum(of(r)).alias(f"{r}_messages") for r in ("system", "user", "assistant")]
    return chat.agg(F.count("*").alias("records"), (F.count("*") - F.count_distinct(fingerprint(F.col("messages")))).alias("duplicates"), *roles)


MESSAGES = "array<struct<role:string,content:string>>"


def _said(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def normalised_messages(df: DataFrame) -> DataFrame:
    """`messages` and `problem` (null where there is none) of records in any of the known forms.

    A list of messages stands as it is (stripped) if its roles and contents are valid and an assistant has the last word.
    Otherwise an output with an instruction, an input or both, a prompt with a response, or a question with an answer, in this
    order, behind the system text if there is one."""
    of = {c: t.strip(F.coalesce(F.col(c), F.lit(""))) for c in ("system", "instruction", "input", "output", "prompt", "response", "question", "answer")}
    given = F.transform("messages", lambda m: F.struct(t.strip(F.coalesce(m["role"], F.lit(""))).alias("role"), t.strip(F.coalesce(m["content"], F.lit(""))).alias("content")))
    valid = F.forall(given, lambda m: m["role"].isin("system", "user", "assistant") & (m["content"] != ""))
    last = F.try_element_at(given, F.lit(-1))["role"] == "assistant"
    both = F.array_join(F.filter(F.array(of["instruction"], of["input"]), lambda x: x != ""), "\n\n")
    forms = [(both, of["output"]), (of["prompt"], of["response"]), (of["question"], of["answer"])]
    made = F.lit(None).cast(MESSAGES)
    for asked, answer in reversed(forms):
        made = F.when((asked != "") & (answer != ""), F.array(_said("user", asked), _said("assistant", answer)).cast(MESSAGES)).otherwise(made)
    head = F.when(of["system"] != "", F.array(_said("system", of["system"])).cast(MESSAGES)).otherwise(F.array().cast(MESSAGES))
    listed = F.coalesce(F.size("messages"), F.lit(0)) > 0
    problem = (
        F.when(listed & ~valid, "invalid role or content").when(listed & ~last, "the last message is not the assistant's")
        .when(~listed & made.isNull(), "neither messages nor a known pair of fields")
    )
    body = F.when(listed, given.cast(MESSAGES)).otherwise(F.concat(head, made))
    return df.withColumn("problem", problem).withColumn("messages", F.when(F.col("problem").isNull(), body))


def repair_citations(text: Column, labels: Column) -> Column:
    """struct(text, repaired): labels [Sn] that no source has go, and without any left the first source's label is added.

    labels: those of the sources, in order (null where one has none). Without labels the text stays as it is."""
    valid = F.filter(labels, lambda x: x.isNotNull() & (x != ""))
    found = F.regexp_extract_all(text, F.lit(r"\[(S\d+)\]"), F.lit(1))
    unknown = F.array_except(found, valid)
    kept = t.strip(F.aggregate(unknown, text, lambda s, x: F.replace(s, F.concat(F.lit("["), x, F.lit("]")), F.lit(""))))
    first = F.try_element_at(labels, F.lit(1))
    add = (F.size(F.array_intersect(found, valid)) == 0) & (F.coalesce(first, F.lit("")) != "")
    whole = F.when(add, F.concat_ws(" ", F.nullif(kept, F.lit("")), F.concat(F.lit("["), first, F.lit("]")))).otherwise(kept)
    none = F.coalesce(F.size(valid), F.lit(0)) < 1
    return F.struct(F.when(none, text).otherwise(whole).alias("text"), (~none & ((F.size(unknown) > 0) | add)).alias("repaired"))


# What a prompt with retrieved context says before it.
CONTEXT_RULES = (
    "Use the following retrieved context when relevant. Do not invent facts that are not present in it. "
    "When you make a factual claim supported by retrieved context, cite its context label inline, for example [S1]. "
    "Use only citation labels actually provided below; never invent a citation. "
    "If the retrieved context does not support the answer, say that clearly."
)


def context_blocks(labels: Column, sources: Column, texts: Column) -> Column:
    """A block for each retrieved text: its label and source on a line, then the text."""
    heads = F.zip_with(labels, sources, lambda a, s: F.concat(F.lit("["), a, F.lit("]"), F.when(F.coalesce(s, F.lit("")) != "", F.concat(F.lit(" Source: "), s)).otherwise(F.lit(""))))
    return F.zip_with(heads, texts, lambda h, x: F.concat(h, F.lit("\n"), x))


def context_prompt(chunks: Column, question: Column) -> Column:
    """The question behind the rules and the numbered blocks of context; alone if no block has text."""
    some = F.filter(F.transform(chunks, t.strip), lambda c: c != "")
    blocks = F.array_join(F.transform(some, lambda c, i: F.concat(F.lit("[Context "), (i + 1).cast("string"), F.lit("]\n"), c)), "\n\n")
    return F.when(F.size(some) > 0, F.concat(F.lit(CONTEXT_RULES + "\n\n"), blocks, F.lit("\n\n[User]\n"), t.strip(question))).otherwise(t.strip(question))


def chat_messages(question: Column, history: Column, chunks: Column, system: str = "") -> Column:
    """Messages of one turn: the system's, those of the history (stripped), and the question with its context."""
    head = F.array(*[_said("system", F.lit(s)) for s in [system.strip()] if s]).cast(MESSAGES)
    before = F.transform(history, lambda m: F.struct(m["role"].alias("role"), t.strip(m["content"]).alias("content"))).cast(MESSAGES)
    return F.concat(head, before, F.array(_said("user", context_prompt(chunks, question))).cast(MESSAGES))


# The line between the base instructions and those of an application.
ADDED = "\n\nAdditional application instructions:\n"


def with_system(messages: Column, base: str) -> Column:
    """Messages that begin with the base instructions; a system message's own ones follow them, once."""
    base = base.strip()
    first = F.try_element_at(messages, F.lit(1))
    has = F.coalesce(first["role"] == "system", F.lit(False))
    own = t.strip(F.coalesce(first["content"], F.lit("")))
    said = F.when(~has | own.isin("", base), F.lit(base)).when(F.startswith(own, F.lit(base + ADDED)), first["content"]).otherwise(F.concat(F.lit(base + ADDED), own))
    return F.concat(F.array(_said("system", said)).cast(MESSAGES), F.when(has, F.slice(messages, 2, 1_000_000)).otherwise(messages).cast(MESSAGES))


# What prompts say that fix their answer, and what is answered.
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
WHO = ["what is your name", "what's your name", "who are you"]
EXACT_WORDS, EXACT_PHRASE = "reply with exactly {n} words", "write exactly this phrase and nothing else"
AT_MOST = ["at most", "no more than"]
FICTION = "The subject is fictional, so there is no real-world fact to report."
LIMIT = "Hard output constraint: answer in no more than {n} words. Count carefully before responding."


def response_contract(prompt: Column, identity: str = "I am an AI assistant.") -> Column:
    """struct(category, direct, instruction, max_words) for prompts that fix their answer; null fields otherwise.

    What stands before the first colon decides whether the rest is to be said as it is; identity: the answer to who is asked."""
    text = t.clean(prompt)
    low = F.lower(text)
    colon = F.instr(text, ":")
    head = F.split(F.lower(F.rtrim(F.substring(text, F.lit(1), colon - 1))), " ")
    rest = F.when(colon > 0, F.nullif(F.ltrim(F.substr(text, colon + 1)), F.lit("")))
    said = F.try_element_at(head, F.lit(1 + EXACT_WORDS.split().index("{n}")))
    counted = F.array_join(head, " ") == F.replace(F.lit(EXACT_WORDS), F.lit("{n}"), said)
    named = F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), said).cast("int")
    number = F.coalesce(F.when(said.rlike("^[0-9]+$"), said.try_cast("int")), F.nullif(named, F.lit(0)))
    limit = F.nullif(F.regexp_extract(low, rf"(?:{'|'.join(AT_MOST)}) (\d+) words", 1), F.lit(""))
    rules = [
        ("identity", F.regexp_replace(low, r"\?$", "").isin(WHO), F.lit(identity)),
        ("exact_words", counted & rest.isNotNull() & (number == t.count_words(rest, r"(?U)[\w'-]+")), rest),
        ("exact_phrase", (F.array_join(head, " ") == EXACT_PHRASE) & rest.isNotNull(), rest),
        ("fictional", low.rlike(r"\bfictional\b"), F.lit(FICTION)),
        ("instruction", limit.isNotNull(), F.lit(None).cast("string")),
    ]
    category, direct = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, holds, answer in reversed(rules):
        holds = F.coalesce(holds, F.lit(False))
        category, direct = F.when(holds, name).otherwise(category), F.when(holds, answer).otherwise(direct)
    only = category == "instruction"
    instruction = F.when(only, F.replace(F.lit(LIMIT), F.lit("{n}"), limit.try_cast("int").cast("string")))
    return F.struct(category.alias("category"), direct.alias("direct"), instruction.alias("instruction"), F.when(only, limit.try_cast("int")).alias("max_words"))


# Guardrail rules in their order; a text falls under the first whose patterns it all matches.
GUARDRAILS = [
    ("malicious_cyber", [r"\b(phishing|ransomware|malware|keylogger|credential stealer|password stealer|infostealer)\b", r"\b(create|build|write|deploy|send|spread|steal|encrypt|infect|step[- ]?by[- ]?step|instructions?|designed to)\b"]),
    ("credentials", [r"\b(password|passcode|one[- ]?time password|otp|2fa code|api key|secret key)\b", r"\b(tell|give|show|reveal|find|obtain|steal|extract|recover)\b"]),
    ("private_information", [r"\b(exact home address|private (?:phone|mobile) number|personal (?:phone|mobile) number)\b"]),
    ("medical_emergency", [r"(severe chest pain.*(?:trouble|difficulty).*breath|(?:trouble|difficulty).*breath.*severe chest pain|unconscious|severe bleeding|cannot breathe|can't breathe)"]),
    ("medical_uncertainty", [r"(diagnos(?:e|is).*(?:with certainty|for certain|definitely)|(?:tell me|say) exactly what illness)"]),
    ("financial_guarantee", [r"(guarantee.*(?:investment|return|profit)|(?:definitely|guaranteed).*double.*money|risk[- ]?free.*return)"]),
    ("legal_certainty", [r"((?:with certainty|guarantee|definitely).*(?:legally safe|legal outcome)|(?:legally safe|legal outcome).*(?:with certainty|guarantee|definitely))"]),
    ("future_certainty", [r"((?:exactly|definitely|for certain).*(?:will happen|will occur).*(?:tomorrow|next week|next month|in the future)|(?:what|which).*(?:will happen|will occur) tomorrow.*(?:exactly|for certain))"]),
    ("unverified_claim", [r"(present .* as (?:a )?verified .*fact|state .* as (?:a )?verified .*fact|pretend .* is (?:a )?verified .*fact)"]),
    ("source_verification", [r"\b(?:nobel[- ]winning|award[- ]winning) study by\b"]),
]


def guardrail(text: Column) -> Column:
    """The first guardrail category of a text, or null."""
    prompt = t.clean(text)
    out = F.lit(None).cast("string")
    for category, patterns in reversed(GUARDRAILS):
        hit = F.lit(True)
        for p in patterns:
            hit = hit & prompt.rlike(f"(?i){p}")
        out = F.when(hit, category).otherwise(out)
    return out
