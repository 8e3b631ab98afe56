"""Training records: canonical projections, choices, labels for supervised loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import selection


def record(df: DataFrame, dataset: Column, task: Column, first: Column, second: Column, instruction: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """id, dataset, task, domain, instruction, input, output, metadata; domain comes out of the metadata."""
    meta = metadata if metadata is not None else F.create_map().cast("map<string,string>")
    a, b = t.clean(first), t.clean(second)
    domain = F.coalesce(F.try_element_at(meta, F.lit("domain")), F.lit("general"))
    return df.select(
        t.record_id(dataset, a, b).alias("id"), dataset.alias("dataset"), task.alias("task"), domain.alias("domain"), t.clean(instruction if instruction is not None else F.lit("")).alias("instruction"),
        a.alias("input"), b.alias("output"), F.map_filter(meta, lambda k, _: k != "domain").alias("metadata"),
    )


def choices(question: Column, labels: Column, texts: Column) -> Column:
    """The question and a line for each label with its text, as far as both go."""
    n = F.least(F.size(labels), F.size(texts))
    lines = F.zip_with(F.slice(labels, 1, n), F.slice(texts, 1, n), lambda a, b: F.concat(a, F.lit(". "), b))
    return F.concat_ws("\n", question, F.array_join(lines, "\n"))


def shuffled(question: Column, texts: Column) -> Column:
    """Choices in an order that only the question and they decide."""
    keyed = F.array_sort(F.transform(texts, lambda x: F.struct(t.sha(F.concat_ws("\x01", question, x)).alias("h"), x.alias("x"))))
    return F.transform(keyed, lambda k: k["x"])


def answer_label(options: Column, answer: Column) -> Column:
    at = F.array_position(options, answer).cast("int")
    return F.when(at > 0, F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), at, F.lit(1)))


def context(titles: Column, sentences: Column) -> Column:
    n = F.least(F.size(titles), F.size(sentences))
    return F.array_join(F.zip_with(F.slice(titles, 1, n), F.slice(sentences, 1, n), lambda a, s: F.concat(a, F.lit(": "), F.array_join(s, " "))), "\n")


def masked_labels(prompt: Column, response: Column, length: int, eos: int) -> Column:
    """struct(input_ids, attention_mask, labels, truncated, trainable) of a prompt and its response in `length` ids; prompt labels are -100.

    A quarter of the length (8 to 64 ids) stays for the prompt, the response is cut at its end to the rest. A prompt over
    its room loses its middle: a quarter of the room, 2 to 16 ids, goes to its end, all else to its beginning."""
    whole = F.when(F.size(response) > 0, F.concat(response, F.array(F.lit(eos)))).otherwise(response)
    answer = F.slice(whole, 1, length - min(64, max(8, length // 4)))
    room = length - F.size(answer)
    tail = F.least(F.lit(16), F.greatest(F.lit(2), F.floor(room / 4).cast("int")))
    middle_cut = F.concat(F.slice(prompt, F.lit(1), F.greatest(room - tail, F.lit(0))), F.slice(prompt, F.greatest(F.size(prompt) - tail, F.lit(0)) + 1, tail))
    cut = F.when(F.size(prompt) > room, middle_cut).otherwise(prompt)
    ids = F.concat(cut, answer)
    return F.struct(
        ids.alias("input_ids"), F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"), F.concat(F.array_repeat(F.lit(-100), F.size(cut)), answer).alias("labels"),
        (F.size(prompt) + F.size(whole) > length).alias("truncated"), (F.size(answer) > 0).alias("trainable"),
    )


def label_counts(examples: DataFrame, example: str = "r") -> DataFrame:
    """One row: examples, skipped (without a response), truncated (of the others), and ids that are learned."""
    r = F.col(example)
    learned = F.size(F.filter(r["labels"], lambda x: x != -100))
    return examples.agg(
        F.count("*").alias("examples"), F.count_if(~r["trainable"]).alias("skipped"), F.count_if(r["trainable"] & r["truncated"]).alias("truncated"),
        F.coalesce(F.sum(learned), F.lit(0)).alias("learned_ids"),
    )


def padded(array: Column, length: Column | int, value: int, left: bool = False) -> Column:
    n = F.lit(length) if isinstance(length, int) else length
    more = F.array_repeat(F.lit(value), (n - F.size(array)).cast("int"))
    return F.concat(more, array) if left else F.concat(array, more)


def padded_batches(examples: DataFrame, batch: str, pad_id: int, left: bool = False) -> DataFrame:
    """Examples whose input_ids, attention_mask and labels are as long as the longest of their batch (padding: pad_id, 0, -100)."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    fill = {"input_ids": pad_id, "attention_mask": 0, "labels": -100}
    rows = examples.withColumn("__longest", longest)
    return rows.withColumns({c: padded(F.col(c), F.col("__longest"), v, left) for c, v in fill.items()}).drop("__longest")


def with_curated(train: DataFrame, curated: DataFrame) -> DataFrame:
    """Training rows of public and curated sets; columns that one lacks are null there."""
    return train.unionByName(curated, allowMissingColumns=True)


# Task, instruction and domain of the records of each source.
SOURCES = {
    "gsm8k": ("math_reasoning", "Solve the mathematics problem accurately.", "mathematics"),
    "arc": ("science_mcq", "Choose the correct answer. Reply with the option label only.", "science"),
    "sciq": ("science_mcq", "Choose the correct answer. Reply with the option label only.", "science"),
    "openbookqa": ("science_reasoning_mcq", "Choose the correct answer. Reply with the option label only.", "science"),
    "hotpotqa": ("multi_hop_qa", "Answer the question accurately using the supplied context.", "general_knowledge"),
    "openmathinstruct2": ("math_reasoning", "Solve the mathematics problem accurately and show useful reasoning.", "mathematics"),
}
LABELS = "ABCD"


def filled(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (t.clean(c) != "")
    return out


def _of_source(df: DataFrame, source: str, first: Column, second: Column, dataset: str | None = None, **more: Column) -> DataFrame:
    task, instruction, domain = SOURCES[source]
    meta = {"domain": F.lit(domain), **{k: v.cast("string") for k, v in more.items()}}
    pairs = [x for k, v in meta.items() for x in (F.lit(k), v)]
    return record(df, F.lit(dataset or source), F.lit(task), first, second, F.lit(instruction), F.create_map(*pairs))


def _questions(df: DataFrame, question: str, answer: str, limit: int) -> DataFrame:
    """At most `limit` rows by hash rank, the first of each question."""
    rows = df.where(filled(question, answer))
    once = selection.keep_first(rows, t.norm(question), [t.rank_hash(question, answer)])
    return selection.hash_sample(once, limit, [question, answer])


def plain_answers(df: DataFrame) -> DataFrame:
    """question, answer."""
    return _of_source(df, "gsm8k", F.col("question"), F.col("answer"))


def listed_choices(df: DataFrame, source: str = "arc", question: str = "question", dataset: str | None = None) -> DataFrame:
    """id, question, choices (label, text: arrays), answerKey; rows without an answer go."""
    asked = choices(F.coalesce(F.col(question), F.lit("")), F.col("choices.label"), F.col("choices.text"))
    return _of_source(df.where(filled("answerKey")), source, asked, F.col("answerKey"), dataset, source_id=F.col("id"))


def distractor_choices(df: DataFrame) -> DataFrame:
    """question, correct_answer, distractor1 to 3, support: the four in an order that only they and the question decide."""
    names = ["correct_answer", "distractor1", "distractor2", "distractor3"]
    rows = df.where(filled("question", *names)).withColumn("__options", shuffled(t.clean("question"), F.array(*map(t.clean, names))))
    asked = choices(t.clean("question"), F.array(*map(F.lit, LABELS)), F.col("__options"))
    return _of_source(rows, "sciq", asked, answer_label(F.col("__options"), t.clean("correct_answer")), support=t.clean("support"), usage_restriction=F.lit("noncommercial"))


def open_book(df: DataFrame) -> DataFrame:
    """id, question_stem, choices, answerKey."""
    return listed_choices(df, "openbookqa", "question_stem")


def passages(df: DataFrame, limit: int = 25_000) -> DataFrame:
    """id, question, answer, context (title, sentences: arrays), level, type; each question once."""
    body = context(F.col("context.title"), F.col("context.sentences"))
    asked = F.concat(F.lit("Question: "), t.clean("question"), F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit("\n\nContext:\n"), body)).otherwise(F.lit("")))
    return _of_source(_questions(df, "question", "answer", limit), "hotpotqa", asked, F.col("answer"), source_id=F.col("id"), level=F.col("level"), question_type=F.col("type"))


def solutions(df: DataFrame, limit: int = 40_000) -> DataFrame:
    """problem, generated_solution, problem_source, expected_answer; each problem once."""
    rows = _questions(df, "problem", "generated_solution", limit)
    return _of_source(rows, "openmathinstruct2", F.col("problem"), F.col("generated_solution"), problem_source=F.col("problem_source"), expected_answer=t.clean("expected_answer"))


#: What makes records of a source's rows.
BUILDERS = {
    "gsm8k": plain_answers,
    "arc_easy": lambda df: listed_choices(df, dataset="arc_easy"),
    "arc_challenge": lambda df: listed_choices(df, dataset="arc_challenge"),
    "sciq": distractor_choices,
    "openbookqa": open_book,
    "hotpotqa": passages,
    "openmathinstruct2": solutions,
}
