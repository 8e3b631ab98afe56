"""Judging model output, comparing reports, promotion gates, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def repeated_ngram(text: Column, n: int = 4, threshold: int = 4) -> Column:
    """True where one run of n words occurs `threshold` times or more."""
    # In sorted order an n-gram occurs `threshold` times where it equals the one threshold - 1 places on.
    far = lambda g: F.zip_with(g, F.slice(g, threshold, 1_000_000_000), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.exists(t.let(F.array_sort(t.ngrams(t.words(text), n)), far), lambda x: x)


def judge(df: DataFrame, output: str = "output") -> DataFrame:
    """passed and failures (in fixed order) of outputs against their cases' rules; exact and listed texts in any case."""
    out, low = F.col(output), F.lower(t.strip(output))
    empty = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(F.col(c), empty)
    words = t.count_words(out)
    named = lambda name, items: F.transform(items, lambda x: F.concat(F.lit(name + ":"), x))
    one = lambda condition, text: F.when(F.coalesce(condition, F.lit(False)), F.array(text)).otherwise(empty)
    failures = F.concat(
        one(low != F.lower(t.strip("exact")), F.lit("exact_mismatch")),
        named("missing", F.filter(listed("must_contain"), lambda x: ~F.contains(low, F.lower(x)))),
        named("contains_banned", F.filter(listed("must_not_contain"), lambda x: F.contains(low, F.lower(x)))),
        named("regex_mismatch", F.filter(listed("must_match"), lambda p: ~F.rlike(out, F.concat(F.lit("(?im)"), p)))),
        named("forbidden_regex", F.filter(listed("must_not_match"), lambda p: F.rlike(out, F.concat(F.lit("(?im)"), p)))),
        one(words > F.col("max_words"), F.concat(F.lit("too_long:"), words.cast("string"))),
        one(words < F.col("min_words"), F.concat(F.lit("too_short:"), words.cast("string"))),
        one(repeated_ngram(out), F.lit("ngram_repetition")),
    )
    return df.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def category_scores(results: DataFrame, category: str = "category", passed: str = "passed") -> DataFrame:
    """total, passed and score of each category and over all (category <all>)."""
    out = results.rollup(category).agg(F.grouping(category).alias("g"), F.count("*").alias("total"), F.sum(F.col(passed).cast("int")).alias("passed"))
    name = F.when(F.col("g") == 1, "<all>").otherwise(F.col(category))
    return out.select(name.alias("category"), "total", "passed", F.round(F.col("passed") / F.col("total"), 6).alias("score"))


def compare(baseline: DataFrame, candidate: DataFrame, id_col: str, passed: str = "passed") -> DataFrame:
    """id and status of the cases in both reports; unmatched ones are shown as only_baseline or only_candidate."""
    a = baseline.select(F.col(id_col).alias("id"), F.col(passed).alias("before"))
    b = candidate.select(F.col(id_col).alias("id"), F.col(passed).alias("after"))
    status = (
        F.when(F.col("after").isNull(), "only_baseline").when(F.col("before").isNull(), "only_candidate")
        .when(F.col("before") & ~F.col("after"), "regression").when(~F.col("before") & F.col("after"), "improvement").otherwise("unchanged")
    )
    return a.join(b, "id", "full").withColumn("status", status)


def gate(report: DataFrame, least_score: float, most_regressions: int = 0, least_delta: float = 0.0) -> DataFrame:
    """promoted and reasons from a row with candidate_score, score_delta and regressions."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("candidate_score") < least_score, "score_below_minimum"),
            F.when(F.col("regressions") > most_regressions, "too_many_regressions"),
            F.when(F.col("score_delta") < least_delta, "score_delta_too_small"),
        )
    )
    return report.withColumn("reasons", reasons).withColumn("promoted", F.size("reasons") == 0)


def summary(compared: DataFrame) -> DataFrame:
    """One row: scores of the whole reports, delta, regressions, improvements, unchanged."""
    score = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    n = lambda s: F.count_if(F.col("status") == s)
    out = compared.agg(score("before").alias("baseline_score"), score("after").alias("candidate_score"), n("regression").alias("regressions"), n("improvement").alias("improvements"), n("unchanged").alias("unchanged"))
    return out.withColumn("score_delta", F.round(F.col("candidate_score") - F.col("baseline_score"), 6))


def release(capability: DataFrame, safety: DataFrame) -> DataFrame:
    """Both gates in one row; reasons with the gate's name in front."""
    rows = capability.withColumn("gate", F.lit("capability")).unionByName(safety.withColumn("gate", F.lit("safety")), allowMissingColumns=True)
    reason = F.transform("reasons", lambda r: F.concat(F.col("gate"), F.lit(":"), r))
    return rows.agg(F.bool_and("promoted").alias("approved"), F.array_join(F.array_sort(F.flatten(F.collect_list(reason))), ",").alias("reasons"))


def audit(records: DataFrame, groups: dict[str, str], required: list[str], text: str = "text") -> DataFrame:
    """section, value, n: records of each group value, missing metadata, duplicate texts, and the total.

    groups: name of a section to its column. Missing values count as unknown. The table is read once for all that needs no
    text, and once for the duplicates."""
    absent = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    fact = lambda section, value, n: F.struct(F.lit(section).alias("section"), value.alias("value"), n.alias("n"))
    facts = [fact("records", F.lit(""), F.lit(1))]
    facts += [fact(name, F.when(absent(c), "unknown").otherwise(F.trim(F.col(c).cast("string"))), F.lit(1)) for name, c in groups.items()]
    facts += [fact(f"missing_{c}", F.lit(""), absent(c).cast("int")) for c in required]
    out = records.select(F.explode(F.array(*facts)).alias("f")).groupBy("f.section", "f.value").agg(F.sum("f.n").alias("n"))
    dup = records.groupBy(t.content_hash(text).alias("h")).agg((F.count("*") - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("n"))
    return out.unionByName(dup.select(F.lit("duplicates").alias("section"), F.lit("").alias("value"), "n"))


# What a knowledge record should tell of its source, and what sources tell nothing.
RECOMMENDED, WEAK_SOURCES = ["source_kind", "trust_tier", "authority", "retrieved_at"], ["unknown", "none", "n/a"]


def knowledge_report(records: DataFrame, expected: int | None = None, text: str = "text", recommended: list[str] | None = None) -> DataFrame:
    """One row: records, verified, unverified, duplicate_hashes, missing_content_hashes, missing_<field>, duplicate_texts, weak_sources, warnings.

    records: with verified (null: true), content_hash, source, text and the recommended fields; expected: the number that a manifest states."""
    fields = RECOMMENDED if recommended is None else recommended
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    ok = F.coalesce(F.col("verified"), F.lit(True))
    counts = records.agg(
        F.count("*").alias("records"), F.count_if(ok).alias("verified"), F.count_if(~ok).alias("unverified"), F.count_if(blank("content_hash")).alias("missing_content_hashes"),
        *[F.count_if(blank(c)).alias(f"missing_{c}") for c in fields], F.count_if(F.lower(F.trim("source")).isin(WEAK_SOURCES)).alias("weak_sources"),
    )
    more = lambda rows, key, name: rows.groupBy(key.alias("k")).agg((F.count("*") - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias(name))
    hashes = more(records.where(~blank("content_hash")), F.trim("content_hash"), "duplicate_hashes")
    texts = more(records, t.norm(text), "duplicate_texts")
    said = lambda c, words: F.when(F.col(c) > 0, F.concat(F.lit(words + ": "), F.col(c).cast("string")))
    warnings = [
        F.when(F.col("records") == 0, "no records"), said("unverified", "unverified records"), said("duplicate_hashes", "duplicate content hashes"),
        said("missing_content_hashes", "records without content_hash"), *[said(f"missing_{c}", f"records without {c}") for c in sorted(fields)],
        said("duplicate_texts", "duplicate texts"), said("weak_sources", "weak provenance"),
    ]
    if expected is not None:
        warnings.append(F.when(F.col("records") != expected, F.concat(F.lit(f"the manifest states {expected} records, there are "), F.col("records").cast("string"))))
    return counts.crossJoin(hashes).crossJoin(texts).withColumn("warnings", F.array_compact(F.array(*warnings)))


def grounded(results: DataFrame, passed: str = "passed", repaired: str = "citation_repaired") -> DataFrame:
    """One row: cases, passed, pass_rate, citation_repaired, native_citation_rate; without cases the rates are 0."""
    out = results.agg(F.count("*").alias("cases"), F.count_if(F.col(passed)).alias("passed"), F.count_if(F.col(repaired)).alias("citation_repaired"))
    rate = lambda n: F.when(F.col("cases") == 0, 0.0).otherwise(F.round(n / F.col("cases"), 4))
    return out.withColumn("pass_rate", rate(F.col("passed"))).withColumn("native_citation_rate", rate(F.col("cases") - F.col("citation_repaired")))


def detector_rates(results: DataFrame, kind: str, hit: Column) -> DataFrame:
    """kind, examples, hits, rate: on valid samples the rate is that of false alarms, on planted mistakes the recall."""
    out = results.groupBy(kind).agg(F.count("*").alias("examples"), F.count_if(hit).alias("hits"))
    return out.withColumn("rate", F.round(F.col("hits") / F.col("examples"), 4))
