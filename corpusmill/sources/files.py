"""File sources and sinks: JSON lines, knowledge, reports, document folders, site maps, manifests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..operators import selection
from . import work


def require(df: DataFrame, good: Column, message: Column) -> DataFrame:
    """df, failing with the message where `good` is not true; a filter, so no selection of columns leaves it out."""
    return df.where(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Objects of a JSON-lines path; blank lines are skipped. Strict: a bad line or non-object fails with its file and text; else it is dropped."""
    kind = T.StructType.fromDDL(schema)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(t.strip("value") != "")
    # Any object is a map of strings; what is malformed or no object gives null.
    is_object = F.from_json("value", "map<string,string>").isNotNull()
    message = F.concat(F.col("file"), F.lit(": not a JSON object: "), F.substring("value", 1, 200))
    lines = require(lines, is_object, message) if strict else lines.where(is_object)
    return lines.select(F.from_json("value", kind).alias("r")).select("r.*")


def knowledge(spark: SparkSession, path: str, verified_only: bool = True) -> DataFrame:
    """text, source, title, verified, repository, authority of a knowledge file, stripped; a missing path has no records.

    Records without a text or source fail. `verified` is true where it isn't given; unverified ones go if so asked."""
    names = ["text", "source", "title", "repository", "authority"]
    kind = ", ".join(f"{n} string" for n in names) + ", verified boolean"
    if not work.exists(spark, path):
        return spark.createDataFrame([], "text string, source string, title string, repository string, authority string, verified boolean")
    rows = jsonl(spark, path, kind).select(*[F.nullif(t.strip(n), F.lit("")).alias(n) for n in names], F.coalesce("verified", F.lit(True)).alias("verified"))
    rows = require(rows, F.col("text").isNotNull() & F.col("source").isNotNull(), F.lit(f"{path}: a record without a text or source"))
    return rows.where("verified") if verified_only else rows


def curated(spark: SparkSession, path: str) -> DataFrame:
    """id, dataset, task, domain, instruction, input, output of the `records` of a JSON object; one with a blank field, or none at all, fails."""
    names = ["task", "domain", "instruction", "input", "output"]
    kind = "name string, records array<struct<" + ",".join(f"{n}:string" for n in names) + ">>"
    whole = spark.read.schema(kind).option("multiLine", "true").json(path)
    whole = require(whole, F.size(F.coalesce("records", F.array())) > 0, F.lit(f"{path}: no list of records"))
    rows = whole.select(t.strip("name").alias("dataset"), F.posexplode("records").alias("index", "r"))
    rows = rows.select("dataset", "index", *[t.strip(F.coalesce(F.col(f"r.{n}"), F.lit(""))).alias(n) for n in names])
    filled = F.lit(True)
    for n in names:
        filled = filled & (F.col(n) != "")
    rows = require(rows, filled, F.concat(F.lit(f"{path}: incomplete record "), (F.col("index") + 1).cast("string")))
    return rows.select(t.curated_id("dataset", "task", "input", "output").alias("id"), "dataset", *names)


def retrieval_cases(spark: SparkSession, path: str) -> DataFrame:
    """id, query, expected_source_contains of a JSON-lines path; a case without a query or expectations fails."""
    rows = jsonl(spark, path, "id string, query string, expected_source_contains array<string>")
    good = (t.strip(F.coalesce("query", F.lit(""))) != "") & (F.coalesce(F.size("expected_source_contains"), F.lit(0)) > 0)
    return require(rows, good, F.concat(F.lit(f"{path}: incomplete case "), F.coalesce("id", F.lit("without an id"))))


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON-lines path for the judge; one without an id or prompt fails."""
    lists = ", ".join(f"{n} array<string>" for n in ("must_contain", "must_not_contain", "must_match", "must_not_match"))
    rows = jsonl(spark, path, f"id string, category string, prompt string, exact string, {lists}, min_words int, max_words int")
    return require(rows, F.col("id").isNotNull() & F.col("prompt").isNotNull(), F.lit(f"{path}: a case without an id or prompt"))


def report(spark: SparkSession, path: str) -> dict:
    """The one JSON object of a report or manifest: configuration of the driver, not data."""
    value = json.loads("".join(r[0] for r in spark.read.option("wholetext", "true").text(path).collect()))
    if not isinstance(value, dict):
        raise ValueError(f"{path}: not a JSON object")
    return value


def listed(sources: DataFrame, order: str, prefix: str | None = None, column: str = "url", limit: int | None = None) -> DataFrame:
    """The first `limit` sources of a registry in its order, with a prefix if one is given."""
    rows = sources if prefix is None else sources.where(F.startswith(F.col(column), F.lit(prefix)))
    return rows.orderBy(order) if limit is None else rows.orderBy(order).limit(limit)


def write_manifest(stats: DataFrame, path: str) -> None:
    """The one row of stats as a JSON file, the time of writing with it."""
    stats.limit(1).withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")).coalesce(1).write.mode("overwrite").json(path)


def write_jsonl(df: DataFrame, path: str, required: list[str], mode: str = "error") -> int:
    """Write the rows whose required columns are not blank; how many they are is observed on the way."""
    for c in required:
        df = df.where(t.strip(F.coalesce(F.col(c), F.lit(""))) != "")
    return _written(df, path, mode)


def _written(df: DataFrame, path: str, mode: str) -> int:
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return seen.get["n"]


def append_new(df: DataFrame, path: str, key: str, schema: str) -> dict[str, int]:
    """Append the rows whose key the output does not hold yet, so a stopped build can go on; returns resumed, removed and added.

    An output that holds bad lines, rows without a key, or a key twice is written anew first. The first row
    of a key by all its columns stays."""
    spark, resumed, removed = df.sparkSession, 0, 0
    columns = T.StructType.fromDDL(schema).fieldNames()
    once = lambda rows: selection.keep_first(rows.where(F.col(key).isNotNull()), F.col(key), [F.to_json(F.struct(*columns))])
    if work.exists(spark, path):
        lines = spark.read.text(path).where(t.strip("value") != "").count()
        kept = once(jsonl(spark, path, schema, strict=False))
        resumed = kept.count()
        removed = lines - resumed
        if removed:
            anew = f"{path.rstrip('/')}.canonical"
            kept.write.mode("overwrite").json(anew)
            work.replace(spark, anew, path)
        df = df.join(jsonl(spark, path, schema, strict=False).select(key), key, "left_anti").select(*columns)
    return {"resumed": resumed, "removed": removed, "added": _written(once(df), path, "append")}


def append_stream(stream: DataFrame, path: str, key: str, schema: str, checkpoint: str):
    """A started query that appends what a stream brings, each key once, and stops when all that is there was read."""
    write = stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, key, schema))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def document_files(spark: SparkSession, path: str, most_bytes: int = 1_500_000) -> DataFrame:
    """path, content (text), sha256 of the files under a folder, up to a size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= most_bytes)
    return files.select("path", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("sha256"))


def stale(files: DataFrame, known: DataFrame) -> DataFrame:
    """path and `stale` of files (path, sha256): whether what is known of a path (path, sha256) is missing or another hash."""
    have = known.select("path", F.col("sha256").alias("__known"))
    return files.join(have, "path", "left").select("path", (~F.col("__known").eqNullSafe(F.col("sha256"))).alias("stale"))


# What counts as documentation in a repository.
TEXT_EXTENSIONS = ["md", "mdx", "markdown", "txt", "rst", "xml", "html"]
DOC_WORDS = ["readme", "spec", "requirement", "roadmap", "architecture", "api", "decision", "policy", "guide"]


def allowed_document(path: str, excluded: list[str], roots: list[str]) -> Column:
    """True for text files outside excluded folders that lie under a root; without roots, under a folder `docs` or with a documentation word in the name."""
    c = F.col(path)
    parts = F.split(c, "/")
    name, folders = F.lower(F.element_at(parts, -1)), F.transform(parts, F.lower)
    out = ~F.arrays_overlap(parts, F.array(*map(F.lit, excluded)).cast("array<string>"))
    out = out & F.coalesce(F.regexp_extract(name, r".\.([^.]+)$", 1).isin(TEXT_EXTENSIONS), F.lit(False))
    if roots:
        clean = [r.rstrip("/") for r in roots]
        under = [(c == r) | F.startswith(c, F.lit(r + "/")) for r in clean]
        return out & F.array_contains(F.array(*under), True)
    return out & (F.array_contains(folders, "docs") | name.rlike("|".join(DOC_WORDS)))


def sitemap_pages(spark: SparkSession, edges: DataFrame, root: str, prefixes: list[str], depth: int = 3, limit: int = 1000) -> DataFrame:
    """loc of the pages that a site map reaches through at most `depth` indexes; edges: parent, loc, is_index."""
    edges.createOrReplaceTempView("__sitemap_edges")
    found = spark.sql(
        f"""WITH RECURSIVE walk(loc, is_index, depth) AS (
              SELECT :root, true, 0 UNION ALL
              SELECT e.loc, e.is_index, w.depth + 1 FROM walk w JOIN __sitemap_edges e ON e.parent = w.loc WHERE w.is_index AND w.depth < {depth + 1})
            SELECT DISTINCT loc FROM walk WHERE NOT is_index""",
        args={"root": root},
    )
    allowed = F.lit(not prefixes)
    for p in prefixes:
        allowed = allowed | F.startswith(F.col("loc"), F.lit(p))
    return found.where(allowed).orderBy("loc").limit(limit)
