"""Registered queries of the reference operators over the test tables, each with an independent SQL form where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import dialogue, evaluation, records, retrieval, selection, usage, writing
from ..sources import files, work
from ..streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Pieces of SQL that several forms share.
S_CLEAN = r"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"
S_NORM = f"lower({S_CLEAN})"
S_STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
CLEAN, NORM = S_CLEAN.format(c="text"), S_NORM.format(c="text")
TOKENS = "regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9][a-z0-9_''-]*')"
RANK = "sha256(concat_ws(chr(1), {seed}, {cols}))"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


# --- text functions


@query(f"SELECT doc_id, {CLEAN} AS cleaned, {NORM} AS normalised, sha256({NORM}) AS content_hash FROM documents")
def normal_forms(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", t.clean("text").alias("cleaned"), t.norm("text").alias("normalised"), t.content_hash("text").alias("content_hash"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM documents""")
def line_keeping_form(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", t.keep_lines("text").alias("body"))


@query(f"""SELECT doc_id, 'docs_' || substr(sha256(concat_ws(chr(10), 'docs', lower({CLEAN}), lower(source))), 1, 20) AS id,
  'chat_' || substr(sha256(text || chr(8214) || source), 1, 16) AS short_id FROM documents""")
def stable_ids(spark, sf_dir):
    short = F.concat(F.lit("chat_"), F.substring(t.sha(F.concat("text", F.lit("‖"), "source")), 1, 16))
    return documents(spark, sf_dir).select("doc_id", t.record_id(F.lit("docs"), t.clean("text"), "source").alias("id"), short.alias("short_id"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS eval_words, len(regexp_extract_all(text, '[\p{L}\p{N}_''-]+')) AS contract_words, len(regexp_extract_all(text, '\S+')) AS blank_words FROM documents""")
def word_counts(spark, sf_dir):
    n = lambda p: t.count_words("text", p).cast("long")
    return documents(spark, sf_dir).select("doc_id", n(t.WORD).alias("eval_words"), n(r"(?U)[\w'-]+").alias("contract_words"), n(r"\S+").alias("blank_words"))


@query(f"SELECT doc_id, len({TOKENS.format(c='text')}) AS n_tokens, array_to_string({TOKENS.format(c='text')}[1:8], ' ') AS first_tokens FROM documents")
def search_tokens(spark, sf_dir):
    tokens = t.tokens("text")
    return documents(spark, sf_dir).select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.array_join(F.slice(tokens, 1, 8), " ").alias("first_tokens"))


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents),
e AS (SELECT *, len(regexp_extract_all(s, '[\p{L}\p{N}_''-]+')) AS n, regexp_extract(s, '^(?:[^\p{L}\p{N}_]*[\p{L}\p{N}_''-]+){20}') AS h FROM d),
f AS (SELECT *, regexp_replace(h, '[ ,;:-]+$', '') AS c FROM e)
SELECT doc_id, CASE WHEN n <= 20 THEN s WHEN regexp_matches(c, '[.!?]$') THEN c ELSE c || '.' END AS short FROM f""")
def first_twenty_words(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", t.first_words("text", 20).alias("short"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title,
CASE WHEN lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) = 'github.com' THEN lower(regexp_extract(url, '://[^/?#]*/([^/?#]+/[^/?#]+)', 1))
ELSE lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) END AS identity FROM pages""")
def page_identity(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", t.html_title("html").alias("title"), t.identity("url").alias("identity"))


#: Text between tags on lines of its own, and the first main, article or body without what isn't content.
S_GONE = r"regexp_replace({c}, '(?is)<{t}\b.*?(?:</{t}\s*>|\z)', ' ', 'g')"
S_LINES = r"regexp_replace(regexp_replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"


def _without(c: str, *tags: str) -> str:
    for tag in tags:
        c = S_GONE.format(c=c, t=tag)
    return c


def _pages_sql() -> str:
    """Common table expressions up to pt (page_id, title, identity, body)."""
    plain = _without("html", "script", "style", "noscript", "svg", "canvas", "form")
    root = "h"
    for tag in ("body", "article", "main"):
        root = rf"CASE WHEN regexp_matches(h, '(?i)<{tag}\b[^>]*>') THEN regexp_extract(h, '(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|\z)', 1) ELSE {root} END"
    char = "x"
    for entity, sign in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
        char = f"replace({char}, '{entity}', {sign})"
    strip = r"regexp_replace({c}, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g')"
    piece = strip.format(c=char)
    host = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
    return rf"""pa AS (SELECT page_id, url, html, regexp_replace({plain}, '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages), pb AS (SELECT page_id, url, html, {root} AS h FROM pa),
    pc AS (SELECT page_id, url, html, list_filter(list_transform(regexp_split_to_array({_without("h", "nav", "footer", "header", "aside")}, '<[^>]+>'), lambda x: {piece}), lambda x: x <> '') AS ps FROM pb),
    pt AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title,
    CASE WHEN {host} = 'github.com' THEN lower(regexp_extract(url, '://[^/?#]*/([^/?#]+/[^/?#]+)', 1)) ELSE {host} END AS identity, {strip.format(c=S_LINES.format(c="array_to_string(ps, chr(10))"))} AS body FROM pc)"""


@query(f"WITH {_pages_sql()} SELECT page_id, body FROM pt")
def page_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", t.html_text("html").alias("body"))


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://blog.') OR starts_with(url, 'http://')")
def url_allowlist(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return pages.where(F.exists(F.array(F.lit("https://blog."), F.lit("http://")), lambda p: F.startswith(F.col("url"), p)))


@query(r"""WITH d AS (SELECT doc_id, '# Title' || chr(10) || '<!-- x -->- ' || text || ' [link](http://a.b) ![i](c.png)' || chr(10) || '  > quoted' AS m FROM documents),
e AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '(?s)<!--.*?-->', ' ', 'g'), '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '(?m)^#{1,6}\s*', '', 'g'), '(?m)^\s*[-*+]\s+', '• ', 'g'), '(?m)^\s*>\s?', '', 'g') AS m FROM d)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM e""")
def markdown_bodies(spark, sf_dir):
    made = F.concat(F.lit("# Title\n<!-- x -->- "), F.col("text"), F.lit(" [link](http://a.b) ![i](c.png)\n  > quoted"))
    return documents(spark, sf_dir).select("doc_id", t.markdown_text(made).alias("body"))


# --- selection


@query(f"SELECT doc_id, sha256({NORM}) AS content_hash FROM documents QUALIFY row_number() OVER (PARTITION BY sha256({NORM}) ORDER BY doc_id) = 1")
def normalized_exact_dedup(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", t.content_hash("text").alias("content_hash"))
    return selection.keep_first(rows, F.col("content_hash"), ["doc_id"])


@query(f"SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, sha256({NORM} || chr(10) || lang) ORDER BY doc_id) = 1")
def dedup_in_source(spark, sf_dir):
    key = F.struct("source", t.sha(F.concat_ws("\n", t.norm("text"), "lang")))
    return selection.keep_first(documents(spark, sf_dir), key, ["doc_id"]).select("source", "doc_id")


@query(f"SELECT sha256({NORM}) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_inputs(spark, sf_dir):
    return selection.duplicate_keys(documents(spark, sf_dir), t.content_hash("text"))


@query(f"SELECT doc_id FROM documents WHERE length({CLEAN}) BETWEEN 8 AND 50000 AND length({S_CLEAN.format(c='source')}) BETWEEN 1 AND 50000 AND {NORM} <> {S_NORM.format(c='source')}")
def quality_filter(spark, sf_dir):
    return selection.quality(documents(spark, sf_dir), F.col("text"), F.col("source")).select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src2')")
def license_screen(spark, sf_dir):
    return documents(spark, sf_dir).where(~F.col("source").isin("src1", "src2")).select("doc_id", "source")


@query("SELECT coalesce(nullif(trim(lang), ''), '<missing>') AS value, count(*) AS n FROM documents GROUP BY 1")
def lang_distribution(spark, sf_dir):
    return selection.distribution(documents(spark, sf_dir), F.col("lang"))


@query(f"""WITH d AS (SELECT doc_id, source, {NORM} AS a, {S_NORM.format(c='lang')} AS b, length({CLEAN}) AS n, length({S_CLEAN.format(c='lang')}) AS m FROM documents),
q AS (SELECT *, sha256(concat_ws(chr(10), a, b)) AS k FROM d WHERE n BETWEEN 8 AND 50000 AND m BETWEEN 1 AND 50000 AND a <> b),
u AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY source, k ORDER BY doc_id) = 1),
c AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256(concat_ws(chr(1), '42', source, CAST(doc_id AS VARCHAR))), doc_id) <= 30),
x AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY source, doc_id) = 1)
SELECT source, (SELECT count(*) FROM d WHERE d.source = s.source) AS source_rows, (SELECT count(*) FROM q WHERE q.source = s.source) AS quality_rows, (SELECT count(*) FROM u WHERE u.source = s.source) AS unique_rows,
(SELECT count(*) FROM c WHERE c.source = s.source) AS capped_rows, (SELECT count(*) FROM x WHERE x.source = s.source) AS selected_rows FROM (SELECT DISTINCT source FROM documents) s""")
def finalize_funnel(spark, sf_dir):
    return selection.funnel(documents(spark, sf_dir), "source", "text", "lang", "doc_id", 30)


SPLIT = f"""keyed AS (SELECT doc_id, source, sha256('42|' || {NORM}) AS k FROM documents),
sides AS (SELECT k, CASE WHEN coalesce(sum(count(*)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < (SELECT round_even(count(*) * 0.1, 0) FROM keyed) AND (SELECT count(DISTINCT k) FROM keyed) > 1
THEN 'dev' ELSE 'train' END AS split FROM keyed GROUP BY k), parts AS (SELECT doc_id, source, k, split FROM keyed JOIN sides USING (k))"""


@query(f"WITH {SPLIT} SELECT coalesce(source, '_global') AS source, count(*) AS total, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'dev') AS dev FROM parts GROUP BY ROLLUP (source)")
def grouped_split_stats(spark, sf_dir):
    split = selection.grouped_split(documents(spark, sf_dir).select("doc_id", "source", t.norm("text").alias("key")), F.col("key"), 0.1)
    counts = split.rollup("source").agg(F.count("*").alias("total"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "dev").alias("dev"))
    return counts.withColumn("source", F.coalesce("source", F.lit("_global")))


@query(f"WITH {SPLIT} SELECT count(*) AS straddling FROM (SELECT k FROM parts GROUP BY 1 HAVING count(DISTINCT split) > 1)")
def split_overlap(spark, sf_dir):
    split = selection.grouped_split(documents(spark, sf_dir).select("doc_id", t.norm("text").alias("key")), F.col("key"), 0.1)
    both = selection.overlap(split.where("split = 'dev'"), split.where("split = 'train'"), t.sha(F.col("key")), t.sha(F.col("key")))
    return both.agg(F.count("*").alias("straddling"))


@query("SELECT doc_id, lang, turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat_ws(chr(1), '', CAST(doc_id AS VARCHAR))), doc_id) AS turn FROM documents) ORDER BY turn, lang LIMIT 60")
def balanced_round_robin(spark, sf_dir):
    return selection.round_robin(documents(spark, sf_dir).select("doc_id", "lang"), "lang", 60, ["doc_id"]).withColumn("turn", F.col("turn").cast("long"))


@query("SELECT doc_id FROM documents ORDER BY sha256(concat_ws(chr(1), '', CAST(doc_id AS VARCHAR))), doc_id LIMIT 100")
def hash_sample(spark, sf_dir):
    return selection.hash_sample(documents(spark, sf_dir).select("doc_id"), 100, ["doc_id"])


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 80 OFFSET 80")
def second_page(spark, sf_dir):
    return selection.page(documents(spark, sf_dir).select("doc_id", "source"), ["doc_id"], 1)


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256(concat_ws(chr(1), '42', source, CAST(doc_id AS VARCHAR))), doc_id) <= 25")
def cap_per_source(spark, sf_dir):
    return selection.cap(documents(spark, sf_dir).select("doc_id", "source"), "source", 25, key=["doc_id"])


@query("SELECT doc_id, source, CASE WHEN r <= 20 THEN 'train' ELSE 'dev' END AS split FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 25")
def take_train_dev(spark, sf_dir):
    return selection.train_dev(documents(spark, sf_dir).select("doc_id", "source"), "source", "doc_id", 20, 5)


@query(f"SELECT doc_id, item_id FROM (SELECT doc_id, {NORM} AS k FROM documents) d JOIN (SELECT item_id, {NORM} AS k FROM benchmark) b USING (k)")
def benchmark_leakage_exact(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select("item_id", t.norm("text").alias("k"))
    return documents(spark, sf_dir).select("doc_id", t.norm("text").alias("k")).join(items, "k").select("doc_id", "item_id")


@query("SELECT DISTINCT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'ing')")
def outline_search(spark, sf_dir):
    return writing.outline_search(documents(spark, sf_dir), "The ing").select("doc_id")


@query("SELECT source, count(*) AS n FROM (SELECT source FROM documents UNION ALL SELECT 'bench' FROM benchmark) GROUP BY 1")
def union_counts(spark, sf_dir):
    bench = read(spark, sf_dir, "benchmark").select(F.lit("bench").alias("source"))
    return documents(spark, sf_dir).select("source").unionByName(bench).groupBy("source").agg(F.count("*").alias("n"))


# --- retrieval

BM25 = f"""q AS (SELECT item_id AS query, list_distinct({TOKENS.format(c='text')}) AS ts FROM benchmark), qt AS (SELECT query, len(ts) AS n_terms, unnest(ts) AS term FROM q),
d AS (SELECT doc_id AS doc, {TOKENS.format(c='text')} AS ts FROM documents), st AS (SELECT count(*) AS n, greatest(avg(len(ts)), 1.0) AS avgdl FROM d),
p AS (SELECT doc, len(ts) AS dl, unnest(ts) AS term FROM d), tf AS (SELECT doc, dl, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT query, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) + 2.0 / n_terms), 6) AS score
FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc)"""


@query(f"WITH {BM25} SELECT query, doc, round(score, 4) AS score, rank, 'S' || rank AS label FROM r WHERE rank <= 4")
def bm25_topk(spark, sf_dir):
    scores = retrieval.bm25(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))
    return retrieval.top_k(scores, 4).select("query", "doc", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"), "label")


@query(f"""WITH {BM25}, rel AS (SELECT item_id AS query, doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
f AS (SELECT rel.query, min(rank) AS rank FROM rel LEFT JOIN (SELECT * FROM r WHERE rank <= 5) k USING (query, doc) GROUP BY 1)
SELECT count(*) AS cases, round(avg(coalesce(CAST(rank <= 1 AS INT), 0)), 4) AS hit_at_1, round(avg(coalesce(CAST(rank <= 3 AS INT), 0)), 4) AS hit_at_3, round(avg(coalesce(CAST(rank <= 5 AS INT), 0)), 4) AS hit_at_5, round(avg(coalesce(1.0 / rank, 0)), 4) AS mrr FROM f""")
def retrieval_metrics(spark, sf_dir):
    docs, items = documents(spark, sf_dir), read(spark, sf_dir, "benchmark")
    ranked = retrieval.top_k(retrieval.bm25(docs, items), 5)
    # Passages are searched only in documents that share all 8-word runs of the passage: an equi-join first.
    runs = retrieval.coverage(docs, items, 8).where("matched_words >= 8").select(F.col("draft").alias("doc_id"), F.col("source").alias("item_id"))
    found = runs.join(docs.select("doc_id", F.col("text").alias("body")), "doc_id").join(items.select("item_id", "text"), "item_id").where(F.contains("body", "text"))
    return retrieval.retrieval_metrics(ranked, found.select(F.col("item_id").alias("query"), F.col("doc_id").alias("doc")))


BM25_PAGES = f"""{_pages_sql()}, q AS (SELECT item_id AS query, list_distinct({TOKENS.format(c='text')}) AS ts FROM benchmark), qt AS (SELECT query, len(ts) AS n_terms, unnest(ts) AS term FROM q),
d AS (SELECT page_id AS doc, identity, {TOKENS.format(c='title')} AS tt, {TOKENS.format(c="title || ' ' || body")} AS ts FROM pt), st AS (SELECT count(*) AS n, greatest(avg(len(ts)), 1.0) AS avgdl FROM d),
p AS (SELECT doc, len(ts) AS dl, unnest(ts) AS term FROM d), tf AS (SELECT doc, dl, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT query, n_terms, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf, avgdl FROM qt LEFT JOIN df USING (term), st),
parts AS (SELECT query, doc, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) + 2.0 / n_terms AS part FROM w JOIN tf USING (term)
UNION ALL SELECT query, doc, 1.75 * idf FROM w JOIN (SELECT doc, unnest(list_distinct(tt)) AS term FROM d) USING (term)
UNION ALL SELECT query, doc, 6 + idf FROM w JOIN d ON length(term) >= 5 AND contains(identity, term)),
sc AS (SELECT query, doc, round(sum(part), 6) AS score FROM parts GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc WHERE score > 0)"""


@query(f"WITH {BM25_PAGES} SELECT query, doc, round(score, 3) AS score, rank, 'S' || rank AS label FROM r WHERE rank <= 4")
def bm25_pages(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", t.html_title("html").alias("title"), t.html_text("html").alias("body"), t.identity("url").alias("identity"))
    ranked = retrieval.top_k(retrieval.bm25(pages, read(spark, sf_dir, "benchmark"), doc_id="page_id", doc_text="body", title="title", identity="identity"), 4)
    return ranked.select("query", "doc", F.round("score", 3).alias("score"), F.col("rank").cast("long").alias("rank"), "label")


FOLDED = r"regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\p{L}\p{N}_'']+')"


@query(f"""WITH d AS (SELECT doc_id AS draft, {FOLDED} AS w FROM documents), g AS (SELECT draft, len(w) AS draft_words, unnest(range(1, len(w) - 6)) AS pos, w FROM d WHERE len(w) >= 8),
gg AS (SELECT draft, draft_words, pos, array_to_string(w[pos:pos + 7], ' ') AS gram FROM g),
s AS (SELECT item_id AS source, {FOLDED} AS w FROM benchmark), sg AS (SELECT source, unnest(range(1, len(w) - 6)) AS pos, w FROM s WHERE len(w) >= 8), sgg AS (SELECT DISTINCT source, array_to_string(w[pos:pos + 7], ' ') AS gram FROM sg),
c AS (SELECT DISTINCT draft, draft_words, source, unnest(range(pos, pos + 8)) AS word FROM gg JOIN sgg USING (gram))
SELECT draft, source, draft_words, count(*) AS matched_words, round(100.0 * count(*) / draft_words, 1) AS coverage_percent FROM c GROUP BY 1, 2, 3""")
def shingle_coverage(spark, sf_dir):
    return retrieval.coverage(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))


@query(f"""WITH d AS (SELECT doc_id AS draft, {FOLDED} AS w FROM documents), g AS (SELECT draft, len(w) AS draft_words, unnest(range(1, len(w) - 6)) AS pos, w FROM d WHERE len(w) >= 8),
gg AS (SELECT draft, draft_words, pos, array_to_string(w[pos:pos + 7], ' ') AS gram FROM g),
s AS (SELECT item_id AS source, {FOLDED} AS w FROM benchmark), sg AS (SELECT source, unnest(range(1, len(w) - 6)) AS pos, w FROM s WHERE len(w) >= 8), sgg AS (SELECT DISTINCT source, array_to_string(w[pos:pos + 7], ' ') AS gram FROM sg),
c AS (SELECT DISTINCT draft, draft_words, source, unnest(range(pos, pos + 8)) AS word FROM gg JOIN sgg USING (gram)),
e AS (SELECT draft, source, count(*) AS n FROM c GROUP BY 1, 2), o AS (SELECT draft, draft_words, count(DISTINCT word) AS matched_words FROM c GROUP BY 1, 2)
SELECT o.draft, o.draft_words, o.matched_words, round(100.0 * o.matched_words / o.draft_words, 1) AS coverage_percent, string_agg(e.source || ':' || e.n, ',' ORDER BY e.n DESC, e.source) AS sources FROM o JOIN e USING (draft) GROUP BY 1, 2, 3, 4""")
def source_reports(spark, sf_dir):
    rows = retrieval.source_report(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))
    return rows.withColumn("sources", F.array_join(F.transform("sources", lambda x: F.concat_ws(":", x["source"], x["matched_words"])), ","))


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), g AS (SELECT doc_id, unnest(range(1, len(w) - 2)) AS i, w FROM d WHERE len(w) >= 4),
c AS (SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS gram, count(*) AS n FROM g GROUP BY ALL)
SELECT doc_id, doc_id IN (SELECT doc_id FROM c WHERE n >= 4) AS repeated FROM documents""")
def repeated_ngram_flag(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", evaluation.repeated_ngram(F.col("text")).alias("repeated"))


@query(f"""WITH d AS (SELECT doc_id AS draft, {FOLDED} AS w FROM documents), g AS (SELECT draft, unnest(range(1, len(w) - 6)) AS pos, w FROM d WHERE len(w) >= 8), gg AS (SELECT draft, pos, array_to_string(w[pos:pos + 7], ' ') AS gram FROM g),
s AS (SELECT item_id AS source, {FOLDED} AS w FROM benchmark), sg AS (SELECT source, unnest(range(1, len(w) - 6)) AS pos, w FROM s WHERE len(w) >= 8), sgg AS (SELECT source, array_to_string(w[pos:pos + 7], ' ') AS gram, min(pos) AS place FROM sg GROUP BY 1, 2),
r AS (SELECT draft, source, pos, place FROM gg JOIN sgg USING (gram) QUALIFY row_number() OVER (PARTITION BY draft, source ORDER BY pos) <= 5)
SELECT draft, source, CAST(pos - 1 AS INT) AS at, array_to_string(d.w[greatest(pos - 3, 1):pos + 10], ' ') AS draft_excerpt, array_to_string(s.w[greatest(place - 6, 1):place + 13], ' ') AS source_excerpt FROM r JOIN d USING (draft) JOIN s USING (source)""")
def matching_excerpts(spark, sf_dir):
    return retrieval.excerpts(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))


# --- conversations


@query(f"SELECT c.conv_id, c.turn, p.text AS input, c.text AS output FROM conversations c JOIN conversations p ON c.conv_id = p.conv_id AND c.turn = p.turn + 1 WHERE c.role = 'assistant' AND p.role IN ('user', 'prompter', 'human') AND {S_NORM.format(c='p.text')} <> {S_NORM.format(c='c.text')}")
def conversation_pairs(spark, sf_dir):
    return dialogue.parent_pairs(read(spark, sf_dir, "conversations"))


@query(f"""SELECT conv_id, turn, input, text AS output FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS input FROM conversations)
WHERE role = 'assistant' AND input IS NOT NULL AND {S_NORM.format(c='input')} <> {NORM}""")
def carry_forward_pairs(spark, sf_dir):
    return dialogue.carried_pairs(read(spark, sf_dir, "conversations"))


@query(f"""SELECT conv_id || '-' || turn AS message_id, {S_STRIP.format(c='input')} AS input, {S_STRIP.format(c='text')} AS output FROM (SELECT *, last_value(CASE WHEN role IN ('user', 'prompter', 'human') AND {CLEAN} <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS input FROM conversations)
WHERE role IN ('assistant', 'bot', 'gpt') AND input IS NOT NULL AND {CLEAN} <> '' AND {S_NORM.format(c='input')} <> {NORM}""")
def message_tree_pairs(spark, sf_dir):
    place = lambda turn: F.concat_ws("-", "conv_id", turn)
    said = read(spark, sf_dir, "conversations").select(place(F.col("turn")).alias("message_id"), place(F.col("turn") - 1).alias("parent_id"), "role", "text")
    return dialogue.reply_pairs(said)


@query(f"""SELECT conv_id, CASE WHEN bool_or(role NOT IN ('system', 'user', 'assistant') OR {CLEAN} = '') THEN 'invalid role or content' WHEN max_by(role, turn) <> 'assistant' THEN 'the last message is not the assistant''s' END AS problem,
CASE WHEN NOT bool_or(role NOT IN ('system', 'user', 'assistant') OR {CLEAN} = '') AND max_by(role, turn) = 'assistant' THEN count(*) END AS n_messages FROM conversations GROUP BY 1""")
def message_problems(spark, sf_dir):
    chat = dialogue.chats(read(spark, sf_dir, "conversations"))
    for c in ("system", "instruction", "input", "output", "prompt", "response", "question", "answer"):
        chat = chat.withColumn(c, F.lit(None).cast("string"))
    return dialogue.normalised_messages(chat).select("conv_id", "problem", F.nullif(F.size(F.coalesce("messages", F.array())).cast("long"), F.lit(0)).alias("n_messages"))


CHAT = r"(SELECT conv_id, sha256(string_agg(role || ':' || regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) ORDER BY turn)) AS fp FROM conversations GROUP BY 1)"


@query(f"SELECT conv_id, fp FROM {CHAT}")
def message_fingerprints(spark, sf_dir):
    return dialogue.chats(read(spark, sf_dir, "conversations")).select("conv_id", dialogue.fingerprint(F.col("messages")).alias("fp"))


@query(f"""SELECT count(*) AS records, count(*) - count(DISTINCT fp) AS duplicates, (SELECT count(*) FROM conversations WHERE role = 'system') AS system_messages,
(SELECT count(*) FROM conversations WHERE role = 'user') AS user_messages, (SELECT count(*) FROM conversations WHERE role = 'assistant') AS assistant_messages FROM {CHAT}""")
def message_fingerprint_stats(spark, sf_dir):
    return dialogue.dataset_stats(dialogue.chats(read(spark, sf_dir, "conversations")))


@query("SELECT conv_id, max_by(text, turn) FILTER (WHERE role = 'user' AND trim(text) <> '') AS latest FROM conversations GROUP BY 1")
def latest_user_turn(spark, sf_dir):
    return dialogue.chats(read(spark, sf_dir, "conversations")).select("conv_id", dialogue.latest_user(F.col("messages")).alias("latest"))


def _guard_sql() -> str:
    case = "CASE"
    for name, patterns in dialogue.GUARDRAILS:
        case += " WHEN " + " AND ".join("regexp_matches(p, '(?i)" + p.replace("'", "''") + "')" for p in patterns) + f" THEN '{name}'"
    return f"SELECT conv_id, turn, {case} END AS category FROM (SELECT conv_id, turn, {CLEAN} AS p FROM conversations)"


@query(_guard_sql())
def guardrail_classify(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", dialogue.guardrail(F.col("text")).alias("category"))


NUMBERS = "[" + ", ".join(f"'{w}'" for w in dialogue.NUMBER_WORDS) + "]"


@query(rf"""WITH p AS (SELECT conv_id, turn, {CLEAN} AS p FROM conversations), x AS (SELECT *, regexp_extract(p, '(?is)^reply with exactly ([a-z]+|\d+) words ?: ?(.+)$', 1) AS n, regexp_extract(p, '(?is)^reply with exactly ([a-z]+|\d+) words ?: ?(.+)$', 2) AS said,
regexp_extract(p, '(?is)^write exactly this phrase and nothing else ?: ?(.+)$', 1) AS phrase, regexp_extract(p, '(?i)(?:at most|no more than) (\d+) words', 1) AS most FROM p),
c AS (SELECT *, CASE WHEN regexp_full_match(lower(p), '(what is your name|what''s your name|who are you)\??') THEN 'identity'
WHEN n <> '' AND coalesce(try_cast(n AS INT), list_position({NUMBERS}, lower(n))) = len(regexp_extract_all(said, '[\p{{L}}\p{{N}}_''-]+')) THEN 'exact_words' WHEN phrase <> '' THEN 'exact_phrase'
WHEN regexp_matches(p, '(?i)\bfictional\b') THEN 'fictional' WHEN most <> '' THEN 'instruction' END AS category FROM x)
SELECT conv_id, turn, category, CASE category WHEN 'identity' THEN 'I am an AI assistant.' WHEN 'exact_words' THEN said WHEN 'exact_phrase' THEN phrase WHEN 'fictional' THEN '{dialogue.FICTION}' END AS direct,
CASE category WHEN 'instruction' THEN replace('{dialogue.LIMIT}', '{{n}}', CAST(CAST(most AS INT) AS VARCHAR)) END AS instruction, CASE category WHEN 'instruction' THEN CAST(most AS INT) END AS max_words FROM c""")
def response_contracts(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", dialogue.response_contract(F.col("text")).alias("c")).select("conv_id", "turn", "c.*")


@query(f"""SELECT conv_id, turn, CASE WHEN turn % 4 IN (1, 2) THEN {S_STRIP.format(c="text || ' [S' || (turn % 4) || ']'")} ELSE {S_STRIP.format(c='text')} || ' [S1]' END AS repaired_text, turn % 4 NOT IN (1, 2) AS repaired FROM conversations""")
def citation_repair(spark, sf_dir):
    said = F.concat(F.col("text"), F.lit(" [S"), (F.col("turn") % 4).cast("string"), F.lit("]"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", dialogue.repair_citations(said, F.array(F.lit("S1"), F.lit("S2"))).alias("r"))
    return rows.select("conv_id", "turn", F.col("r.text").alias("repaired_text"), "r.repaired")


@query(f"""SELECT conv_id, '{dialogue.CONTEXT_RULES}' || chr(10) || chr(10) || string_agg('[Context ' || i || ']' || chr(10) || said, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || '[User]' || chr(10) || 'why?' AS prompt
FROM (SELECT conv_id, turn, {S_STRIP.format(c='text')} AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) GROUP BY 1""")
def context_prompts(spark, sf_dir):
    chat = dialogue.chats(read(spark, sf_dir, "conversations"))
    return chat.select("conv_id", dialogue.context_prompt(F.transform("messages", lambda m: m["content"]), F.lit(" why? ")).alias("prompt"))


@query(f"""SELECT conv_id, CAST(count(*) + max(CASE WHEN turn = t0 AND role = 'system' THEN 0 ELSE 1 END * CASE WHEN turn = t0 THEN 1 ELSE 0 END) AS INT) AS n_messages,
max(CASE WHEN turn = t0 THEN CASE WHEN role = 'system' AND said NOT IN ('', 'Be brief.') THEN 'Be brief.' || chr(10) || chr(10) || 'Additional application instructions:' || chr(10) || said ELSE 'Be brief.' END END) AS system
FROM (SELECT *, {S_STRIP.format(c='text')} AS said, min(turn) OVER (PARTITION BY conv_id) AS t0 FROM conversations) GROUP BY 1""")
def system_messages(spark, sf_dir):
    chat = dialogue.chats(read(spark, sf_dir, "conversations"))
    plain = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    merged = chat.select("conv_id", dialogue.with_system(plain, "Be brief.").alias("m"))
    return merged.select("conv_id", F.size("m").alias("n_messages"), F.col("m")[0]["content"].alias("system"))


@query(f"SELECT conv_id, CAST(len(c) AS INT) AS cited, CAST(len(list_filter(c, lambda x: x NOT IN ('the', 'and', 'der', 'de'))) AS INT) AS unknown FROM (SELECT conv_id, list_distinct(flatten(list({TOKENS.format(c='text')}))) AS c FROM conversations GROUP BY 1)")
def citation_sets(spark, sf_dir):
    cited = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_set(t.tokens("text")))).alias("c"))
    known = F.array(*map(F.lit, ("the", "and", "der", "de")))
    return cited.select("conv_id", F.size("c").alias("cited"), F.size(F.array_except("c", known)).alias("unknown"))


@query("""SELECT conv_id, '[' || string_agg('{"key":"' || turn || '","value":"' || role || '"}', ',' ORDER BY CAST(turn AS VARCHAR)) || ']' AS snapshot FROM conversations GROUP BY 1""")
def revision_snapshots(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), "role"))).alias("m"))
    return said.select("conv_id", writing.snapshot(F.col("m")).alias("snapshot"))


# --- evaluation, audits


def _raters(spark, sf_dir):
    """Two reports: quality labels, and the length of all documents; documents without a label are in the second only."""
    long_ = documents(spark, sf_dir).select("doc_id", (F.col("n_chars") >= 1000).alias("passed"))
    return read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("passed")), long_


COMPARED = """(SELECT coalesce(a.doc_id, b.doc_id) AS id, a.passed AS before, b.passed AS after, CASE WHEN b.passed IS NULL THEN 'only_baseline' WHEN a.passed IS NULL THEN 'only_candidate' WHEN a.passed AND NOT b.passed THEN 'regression' WHEN NOT a.passed AND b.passed THEN 'improvement' ELSE 'unchanged' END AS status
FROM (SELECT doc_id, quality = 1 AS passed FROM labels) a FULL JOIN (SELECT doc_id, n_chars >= 1000 AS passed FROM documents) b ON a.doc_id = b.doc_id)"""
SUMMARY = f"""(SELECT round(avg(CAST(before AS INT)), 6) AS baseline_score, round(avg(CAST(after AS INT)), 6) AS candidate_score, round(round(avg(CAST(after AS INT)), 6) - round(avg(CAST(before AS INT)), 6), 6) AS score_delta,
count(*) FILTER (WHERE status = 'regression') AS regressions, count(*) FILTER (WHERE status = 'improvement') AS improvements, count(*) FILTER (WHERE status = 'unchanged') AS unchanged FROM {COMPARED})"""


@query(f"SELECT * FROM {COMPARED}")
def rater_compare(spark, sf_dir):
    return evaluation.compare(*_raters(spark, sf_dir), "doc_id")


@query(f"SELECT * FROM {SUMMARY}")
def rater_summary(spark, sf_dir):
    return evaluation.summary(evaluation.compare(*_raters(spark, sf_dir), "doc_id"))


@query("SELECT coalesce(lang, '<all>') AS category, count(*) AS total, CAST(sum(quality) AS BIGINT) AS passed, round(sum(quality) / count(*), 6) AS score FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def category_scores(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    return evaluation.category_scores(rows, "lang", "quality")


GATE = "list_filter([CASE WHEN candidate_score < 0.8 THEN 'score_below_minimum' END, CASE WHEN regressions > 0 THEN 'too_many_regressions' END, CASE WHEN score_delta < 0 THEN 'score_delta_too_small' END], lambda x: x IS NOT NULL)"


@query(f"SELECT *, array_to_string({GATE}, ',') AS reasons, len({GATE}) = 0 AS promoted FROM {SUMMARY}")
def promotion_gate(spark, sf_dir):
    report = evaluation.summary(evaluation.compare(*_raters(spark, sf_dir), "doc_id"))
    return evaluation.gate(report, 0.8).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""SELECT bool_and(len(r) = 0) AS approved, array_to_string(list_sort(flatten(list(list_transform(r, lambda x: g || ':' || x)))), ',') AS reasons
FROM (SELECT 'capability' AS g, {GATE} AS r FROM {SUMMARY} UNION ALL SELECT 'safety', {GATE.replace('0.8', '0.99')} FROM {SUMMARY})""")
def release_gate(spark, sf_dir):
    report = evaluation.summary(evaluation.compare(*_raters(spark, sf_dir), "doc_id"))
    return evaluation.release(evaluation.gate(report, 0.8), evaluation.gate(report, 0.99))


@query(f"""SELECT 'records' AS section, '' AS value, count(*) AS n FROM documents UNION ALL SELECT 'lang', coalesce(nullif(trim(lang), ''), 'unknown'), count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'source', coalesce(nullif(trim(source), ''), 'unknown'), count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'missing_lang', '', count(*) FILTER (WHERE coalesce(trim(lang), '') = '') FROM documents
UNION ALL SELECT 'missing_source', '', count(*) FILTER (WHERE coalesce(trim(source), '') = '') FROM documents UNION ALL SELECT 'duplicates', '', count(*) - count(DISTINCT sha256({NORM})) FROM documents""")
def knowledge_audit(spark, sf_dir):
    return evaluation.audit(documents(spark, sf_dir), {"lang": "lang", "source": "source"}, ["lang", "source"])


REPORTED = f"""(SELECT doc_id, text, lang, n_chars, source, coalesce(quality, 1) = 1 AS verified, CASE WHEN n_chars >= 200 THEN sha256({NORM}) ELSE ' ' END AS content_hash FROM documents LEFT JOIN labels USING (doc_id))"""


@query(f"""WITH c AS (SELECT count(*) AS records, count(*) FILTER (WHERE verified) AS verified, count(*) FILTER (WHERE NOT verified) AS unverified, count(*) FILTER (WHERE trim(content_hash) = '') AS missing_content_hashes, count(*) FILTER (WHERE coalesce(trim(lang), '') = '') AS missing_lang,
count(*) FILTER (WHERE lower(trim(source)) IN ('unknown', 'none', 'n/a')) AS weak_sources, count(*) FILTER (WHERE trim(content_hash) <> '') - count(DISTINCT CASE WHEN trim(content_hash) <> '' THEN content_hash END) AS duplicate_hashes, count(*) - count(DISTINCT {NORM}) AS duplicate_texts FROM {REPORTED})
SELECT *, array_to_string(list_filter([CASE WHEN records = 0 THEN 'no records' END, CASE WHEN unverified > 0 THEN 'unverified records: ' || unverified END, CASE WHEN duplicate_hashes > 0 THEN 'duplicate content hashes: ' || duplicate_hashes END,
CASE WHEN missing_content_hashes > 0 THEN 'records without content_hash: ' || missing_content_hashes END, CASE WHEN missing_lang > 0 THEN 'records without lang: ' || missing_lang END, CASE WHEN duplicate_texts > 0 THEN 'duplicate texts: ' || duplicate_texts END,
CASE WHEN weak_sources > 0 THEN 'weak provenance: ' || weak_sources END, CASE WHEN records <> 7 THEN 'the manifest states 7 records, there are ' || records END], lambda x: x IS NOT NULL), '|') AS warnings FROM c""")
def knowledge_reports(spark, sf_dir):
    rows = documents(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id", "left").withColumn("verified", F.coalesce(F.col("quality"), F.lit(1)) == 1)
    rows = rows.withColumn("content_hash", F.when(F.col("n_chars") >= 200, t.content_hash("text")).otherwise(" "))
    return evaluation.knowledge_report(rows, 7, recommended=["lang"]).withColumn("warnings", F.array_join("warnings", "|"))


@query(f"SELECT sha256({S_STRIP.format(c='text')}) AS text_hash, source, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE {CLEAN} <> '' AND coalesce(quality, 1) = 1 GROUP BY 1, 2")
def knowledge_records(spark, sf_dir):
    """Written as JSON lines, then scanned: records with a text, verified ones only."""
    rows = documents(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id", "left").select("text", "source", (F.coalesce(F.col("quality"), F.lit(1)) == 1).alias("verified"))
    path = work.work_dir(spark)
    files.write_jsonl(rows, path, ["text", "source"])
    return files.knowledge(spark, path).groupBy(t.sha(F.col("text")).alias("text_hash"), "source").agg(F.count("*").alias("n"))


@query(r"""WITH g AS (SELECT doc_id, unnest(range(1, len(w) - 2)) AS i, w FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents) WHERE len(w) >= 4),
rep AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS gram, count(*) AS n FROM g GROUP BY ALL) WHERE n >= 4),
f AS (SELECT doc_id, list_filter(['exact_mismatch', CASE WHEN NOT contains(lower(text), 'the') THEN 'missing:the' END, CASE WHEN contains(lower(text), 'idiot') THEN 'contains_banned:idiot' END, CASE WHEN NOT regexp_matches(text, '(?im)^[A-Z]') THEN 'regex_mismatch:^[A-Z]' END,
CASE WHEN regexp_matches(text, '(?im)@mail') THEN 'forbidden_regex:@mail' END, CASE WHEN n > 2000 THEN 'too_long:' || n END, CASE WHEN n < 10 THEN 'too_short:' || n END, CASE WHEN doc_id IN (SELECT doc_id FROM rep) THEN 'ngram_repetition' END], lambda x: x IS NOT NULL) AS f
FROM (SELECT doc_id, text, source, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS n FROM documents))
SELECT doc_id, len(f) = 0 AS passed, array_to_string(f, '|') AS failures FROM f""")
def judged_outputs(spark, sf_dir):
    cases = documents(spark, sf_dir).select(
        "doc_id", F.col("text").alias("output"), F.col("source").alias("exact"), F.array(F.lit("the")).alias("must_contain"), F.array(F.lit("idiot")).alias("must_not_contain"),
        F.array(F.lit("^[A-Z]")).alias("must_match"), F.array(F.lit("@mail")).alias("must_not_match"), F.lit(10).alias("min_words"), F.lit(2000).alias("max_words"),
    )
    return evaluation.judge(cases).select("doc_id", "passed", F.array_join("failures", "|").alias("failures"))


@query("SELECT count(*) AS cases, count(*) FILTER (WHERE quality = 1) AS passed, count(*) FILTER (WHERE toxic = 1) AS citation_repaired, round(count(*) FILTER (WHERE quality = 1) / count(*), 4) AS pass_rate, round((count(*) - count(*) FILTER (WHERE toxic = 1)) / count(*), 4) AS native_citation_rate FROM labels")
def grounded_summary(spark, sf_dir):
    return evaluation.grounded(read(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("passed"), (F.col("toxic") == 1).alias("citation_repaired")))


MISTAKES = " OR ".join("regexp_matches(text, '(?i)" + p.replace("'", "''") + "')" for _, p in writing.GRAMMAR)


@query(f"SELECT role, count(*) AS examples, count(*) FILTER (WHERE {MISTAKES}) AS hits, round(count(*) FILTER (WHERE {MISTAKES}) / count(*), 4) AS rate FROM conversations GROUP BY 1")
def detector_rates(spark, sf_dir):
    """How often any grammar rule finds something, by role."""
    found = F.lit(False)
    for _, p in writing.GRAMMAR:
        found = found | F.col("text").rlike(f"(?i){p}")
    return evaluation.detector_rates(read(spark, sf_dir, "conversations"), "role", found)


# --- usage


@query(r"""SELECT user_id, count(*) AS requests, CAST(sum(greatest(coalesce(CAST(regexp_extract(props, '(-?\d+)', 1) AS BIGINT), 0), 0)) AS BIGINT) AS input_tokens, count(*) FILTER (WHERE event_type = 'view') AS rag_requests, count(*) FILTER (WHERE event_type = 'signup') AS guardrail_intercepts,
count(*) FILTER (WHERE event_type = 'click') AS citation_repairs, count(*) FILTER (WHERE event_type = 'error') AS failed, round(sum(greatest(coalesce(value, 0), 0)), 2) AS total_latency_ms, round(round(sum(greatest(coalesce(value, 0), 0)), 2) / count(*), 2) AS average_latency_ms FROM events GROUP BY 1""")
def usage_rollup(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("tokens", F.regexp_extract("props", r"(-?\d+)", 1).cast("long"))
    flags = {name: F.col("event_type") == kind for name, kind in (("rag_requests", "view"), ("guardrail_intercepts", "signup"), ("citation_repairs", "click"))}
    return usage.usage(events, "user_id", "value", F.col("event_type") == "error", tokens={"input_tokens": "tokens"}, flags=flags)


LIMITS = """SELECT event_id, n <= {limit} AS admitted, CASE WHEN n > {limit} THEN greatest(1, 86400 - floor(epoch(ts))::BIGINT % 86400) END AS retry_after
FROM (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events)"""


@query(LIMITS.format(limit=1))
def rate_limit_decisions(spark, sf_dir):
    return usage.rate_limit(read(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id", 86_400, 1).select("event_id", "admitted", "retry_after")


@query(LIMITS.format(limit="CASE WHEN user_id % 10 = 0 THEN 2 ELSE 1 END"))
def rate_limit_overrides(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    special = events.where("user_id % 10 = 0").select(F.col("user_id").alias("client"), F.lit(2).alias("limit")).distinct()
    return usage.rate_limit(events, "user_id", "event_type", "ts", "event_id", 86_400, 1, special).select("event_id", "admitted", "retry_after")


@query("SELECT user_id % 50 AS client, CAST(user_id AS VARCHAR) AS key, sha256(CAST(user_id AS VARCHAR)) = sha256(CAST(user_id % 50 AS VARCHAR)) AS valid FROM (SELECT DISTINCT user_id FROM events)")
def credential_checks(spark, sf_dir):
    calls = read(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("client"), F.col("user_id").cast("string").alias("key")).distinct()
    keys = calls.select("client").distinct().withColumn("key_hash", F.upper(F.sha2(F.col("client").cast("string"), 256)))
    return usage.credentials(calls, keys)


# --- writing


@query()
def writing_hints(spark, sf_dir):
    return writing.hints(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.explode("hints").alias("h")).select("doc_id", "h.*")


@query("SELECT doc_id, " + " + ".join("CAST(contains(lower(text), '" + p.replace("'", "''") + "') AS INT)" for p in writing.PHRASES) + " AS n_phrases FROM documents")
def phrase_flags(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(writing.phrase_flags(F.col("text"))).alias("n_phrases"))


@query(" UNION ALL ".join(f"SELECT '{r}' AS rule_id, CAST(coalesce(sum(len(regexp_extract_all(text, '(?i)" + p.replace("'", "''") + "'))), 0) AS BIGINT) AS hits FROM documents" for r, p in writing.GRAMMAR))
def grammar_rule_hits(spark, sf_dir):
    return writing.grammar_hits(documents(spark, sf_dir))


@query()
def grammar_issues(spark, sf_dir):
    rows = writing.grammar_issues(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.explode("issues").alias("i")).select("doc_id", "i.*")
    return rows.withColumn("replacements", F.array_join("replacements", "|"))


def _word_counts(spark, sf_dir):
    return writing.word_counts(documents(spark, sf_dir))


@query()
def analysed_writing(spark, sf_dir):
    rows = writing.analyse(documents(spark, sf_dir).select("doc_id", "text"), writing.word_list(_word_counts(spark, sf_dir)), "doc_id")
    return rows.select("doc_id", F.explode("issues").alias("i")).select("doc_id", "i.*").withColumn("replacements", F.array_join("replacements", "|"))


@query()
def mask_protected(spark, sf_dir):
    masked = writing.mask(documents(spark, sf_dir).select("doc_id", "text"))
    return masked.select("doc_id", "masked", F.size("values").alias("n_values"), (writing.unmask(F.col("masked"), F.col("values")) == F.col("text")).alias("restored"))


@query()
def chunk_documents(spark, sf_dir):
    return writing.chunk(documents(spark, sf_dir))


@query(r"""SELECT doc_id, CAST(i - 1 AS INT) AS index, block FROM (SELECT doc_id, unnest(b) AS block, generate_subscripts(b, 1) AS i FROM (SELECT doc_id, list_filter(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '') AS b FROM documents))""")
def document_blocks(spark, sf_dir):
    return writing.blocks(documents(spark, sf_dir))


@query(f"""WITH b AS (SELECT doc_id, source, unnest(p) AS block, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, source, list_filter(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10) || chr(10)), lambda x: {S_STRIP.format(c='x')} <> '') AS p FROM documents)),
r AS (SELECT *, row_number() OVER (PARTITION BY sha256({S_NORM.format(c='block')}) ORDER BY doc_id, i) AS n FROM b)
SELECT source AS kind, count(DISTINCT doc_id) AS documents, count(*) AS chunks, count(*) FILTER (WHERE n = 1) AS chunks_written, count(*) FILTER (WHERE n > 1) AS duplicates_skipped FROM r GROUP BY 1""")
def corpus_build_stats(spark, sf_dir):
    docs = documents(spark, sf_dir)
    parts = writing.blocks(docs).withColumn("content_hash", t.content_hash("block")).join(docs.select("doc_id", "source"), "doc_id")
    return writing.build_stats(writing.first_chunks(parts, F.col("source"), ["doc_id", "index"]), "doc_id")


@query(r"""SELECT doc_id, array_to_string(list_prepend('revised', b[2:]), chr(10) || chr(10)) AS text FROM (SELECT doc_id, list_filter(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '') AS b FROM documents) WHERE len(b) > 0""")
def exported_revisions(spark, sf_dir):
    parts = writing.blocks(documents(spark, sf_dir))
    return writing.export(parts, parts.where("index = 0").select("doc_id", "index", F.lit("revised").alias("revised")))


@query()
def spelling_candidates(spark, sf_dir):
    words = _word_counts(spark, sf_dir)
    found = writing.candidates(words.where("count <= 1").select("word"), writing.word_list(words.where("count >= 20")))
    return found.withColumn("replacements", F.array_join("replacements", "|"))


@query()
def word_diffs(spark, sf_dir):
    pairs = dialogue.parent_pairs(read(spark, sf_dir, "conversations"))
    return writing.word_diff(pairs, "input", "output").select("conv_id", "turn", F.size("runs").alias("n_runs"), F.to_json("runs").alias("runs"))


@query(rf"""WITH r AS (SELECT doc_id, source, text, text || ' ' || source AS said FROM documents), b AS (SELECT *, regexp_replace(replace(said, source, ''), '(?m)^\s{{0,8}}\p{{Nd}}{{1,2}}[.)]\s+', '', 'g') AS bare, list_transform(string_split(said, chr(10)), lambda x: lower({S_STRIP.format(c='x')})) AS lines FROM r)
SELECT doc_id, array_to_string(list_filter([CASE WHEN list_has_any(lines, {[e.lower() for e in writing.ECHOES]}) THEN 'prompt_echo' END, CASE WHEN length(said) - length(replace(said, source, '')) <> length(source) THEN 'tokens_lost' END,
CASE WHEN regexp_matches(bare, '\p{{Nd}}') THEN 'new_numbers' END], lambda x: x IS NOT NULL), ',') AS issues FROM b""")
def rewrite_critiques(spark, sf_dir):
    said = F.concat_ws(" ", "text", "source")
    return documents(spark, sf_dir).select("doc_id", F.array_join(writing.critique(F.col("text"), said, F.array("source")), ",").alias("issues"))


# --- records


@query(f"SELECT doc_id, 'docs_' || substr(sha256(concat_ws(chr(10), 'docs', lower({CLEAN}), lower({S_CLEAN.format(c='source')}))), 1, 20) AS id, lang AS domain, length({CLEAN}) AS n_input FROM documents")
def canonical_records(spark, sf_dir):
    docs = documents(spark, sf_dir)
    meta = F.create_map(F.lit("domain"), F.col("lang"), F.lit("doc_id"), F.col("doc_id").cast("string"))
    out = records.record(docs, F.lit("docs"), F.lit("text"), F.col("text"), F.col("source"), metadata=meta)
    return out.select(F.col("metadata")["doc_id"].cast("long").alias("doc_id"), "id", "domain", F.length("input").alias("n_input"))


@query("SELECT item_id, 'Pick' || chr(10) || 'A. ' || text || chr(10) || 'B. ' || text || ' two' AS question FROM benchmark")
def choice_lines(spark, sf_dir):
    labels, texts = F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.array(F.col("text"), F.concat(F.col("text"), F.lit(" two")))
    return read(spark, sf_dir, "benchmark").select("item_id", records.choices(F.lit("Pick"), labels, texts).alias("question"))


@query("""WITH b AS (SELECT item_id, text, unnest([text, text || ' two', text || ' three']) AS x FROM benchmark), o AS (SELECT item_id, text, list(x ORDER BY sha256(concat_ws(chr(1), text, x)), x) AS xs FROM b GROUP BY 1, 2)
SELECT item_id, array_to_string(xs, '|') AS options, substr('ABC', list_position(xs, text), 1) AS answer FROM o""")
def shuffled_choices(spark, sf_dir):
    texts = F.array(F.col("text"), F.concat(F.col("text"), F.lit(" two")), F.concat(F.col("text"), F.lit(" three")))
    rows = read(spark, sf_dir, "benchmark").withColumn("o", records.shuffled(F.col("text"), texts))
    return rows.select("item_id", F.array_join("o", "|").alias("options"), records.answer_label(F.col("o"), F.col("text")).alias("answer"))


S_LABELS = r"""e AS (SELECT doc_id, w, least(len(w), 247) AS p FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents)),
l AS (SELECT doc_id, w, p, list_transform(CASE WHEN len(w) > 247 THEN list_concat(w[1:231], w[len(w) - 15:]) ELSE w END, lambda x: length(x)) AS ids FROM e)"""


def _examples(spark, sf_dir):
    """Each word of a text is the id of its length; eight ids answer."""
    prompt = F.transform(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), F.length)
    return documents(spark, sf_dir).select("doc_id", "source", records.masked_labels(prompt, F.sequence(F.lit(1), F.lit(8)), 256, 0).alias("r"))


@query(f"WITH {S_LABELS} SELECT doc_id, CAST(p + 9 AS INT) AS n_ids, CAST(p AS INT) AS n_masked, CAST(coalesce(list_sum(ids), 0) + 36 AS BIGINT) AS id_sum, CAST(coalesce(ids[-1], -1) AS INT) AS last_prompt_id, len(w) > 247 AS truncated FROM l")
def supervised_labels(spark, sf_dir):
    masked = F.size(F.filter("r.labels", lambda x: x == -100))
    total = F.aggregate("r.input_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    last = F.coalesce(F.get("r.input_ids", masked - 1), F.lit(-1))
    return _examples(spark, sf_dir).select("doc_id", F.size("r.input_ids").alias("n_ids"), masked.alias("n_masked"), total.alias("id_sum"), last.alias("last_prompt_id"), "r.truncated")


@query(f"WITH {S_LABELS} SELECT count(*) AS examples, 0 AS skipped, count(*) FILTER (WHERE len(w) > 247) AS truncated, count(*) * 9 AS learned_ids FROM l")
def supervised_counts(spark, sf_dir):
    return records.label_counts(_examples(spark, sf_dir)).withColumn("skipped", F.col("skipped").cast("int"))


@query(f"WITH {S_LABELS} SELECT l.doc_id, CAST(max(p + 9) OVER (PARTITION BY source) AS INT) AS n_ids, CAST(p + 9 AS INT) AS n_real FROM l JOIN documents USING (doc_id)")
def padded_examples(spark, sf_dir):
    rows = records.padded_batches(_examples(spark, sf_dir).select("doc_id", "source", "r.*"), "source", 0)
    return rows.select("doc_id", F.size("input_ids").alias("n_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"))


def _built(dataset: str, question: str, answer: str, task: str, domain: str, rows: str = "benchmark") -> str:
    a, b = S_CLEAN.format(c=question), S_CLEAN.format(c=answer)
    return f"SELECT '{dataset}_' || substr(sha256(concat_ws(chr(10), '{dataset}', lower({a}), lower({b}))), 1, 20) AS id, '{dataset}' AS dataset, '{task}' AS task, '{domain}' AS domain, {a} AS input, {b} AS output FROM {rows}"


ONCE = "(SELECT DISTINCT ON (lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) text FROM benchmark)"


@query(
    " UNION ALL ".join([
        _built("gsm8k", "text", "text || ' one'", "math_reasoning", "mathematics"),
        _built("arc_easy", "text || ' A. ' || text || ' B. ' || text || ' two'", "'B'", "science_mcq", "science"),
        _built("arc_challenge", "text || ' A. ' || text || ' B. ' || text || ' two'", "'B'", "science_mcq", "science"),
        _built("openbookqa", "text || ' A. ' || text || ' B. ' || text || ' two'", "'B'", "science_reasoning_mcq", "science"),
        _built("hotpotqa", "'Question: ' || text || ' Context: T: ' || text || ' ' || text || ' two'", "text || ' one'", "multi_hop_qa", "general_knowledge", ONCE),
        _built("openmathinstruct2", "text", "text || ' one'", "math_reasoning", "mathematics", ONCE),
    ])
)
def built_records(spark, sf_dir):
    own = F.col("text")
    plus = lambda word: F.concat(own, F.lit(f" {word}"))
    listed = F.struct(F.array(F.lit("A"), F.lit("B")).alias("label"), F.array(own, plus("two")).alias("text"))
    blank = {c: F.lit("") for c in ("problem_source", "expected_answer", "level", "type")}
    said = {"question": own, "question_stem": own, "problem": own, "choices": listed, "answerKey": F.lit("B"), "answer": plus("one"), "generated_solution": plus("one")}
    context = F.struct(F.array(F.lit("T")).alias("title"), F.array(F.array(own, plus("two"))).alias("sentences"))
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), *[c.alias(n) for n, c in (said | blank).items()], context.alias("context"))
    made = [records.BUILDERS[n](rows) for n in ("gsm8k", "arc_easy", "arc_challenge", "openbookqa", "hotpotqa", "openmathinstruct2")]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out.select("id", "dataset", "task", "domain", "input", "output")


# --- streams, run once over what is there


def _drain(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What a stream over the events table has written to files when all that is there was read.

    Complete results replace the files with each batch; others are appended."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out, state = work.work_dir(spark), work.work_dir(spark)
    result = make(stream)
    write = result.writeStream.option("checkpointLocation", state).trigger(availableNow=True).outputMode(mode)
    if mode == "complete":
        q = write.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    else:
        q = write.format("parquet").start(out)
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


@query("SELECT user_id, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS failed, round(sum(greatest(coalesce(value, 0), 0)), 2) AS total_latency_ms FROM events GROUP BY 1")
def usage_stream(spark, sf_dir):
    return _drain(spark, sf_dir, lambda s: streams.running_usage(s, "user_id", "value", F.col("event_type") == "error"), "complete")


@query("SELECT event_type, user_id, CAST(count(*) AS BIGINT) AS admitted FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events) WHERE n <= 1 GROUP BY 1, 2")
def rate_limit_stream(spark, sf_dir):
    out = _drain(spark, sf_dir, lambda s: streams.rate_limited(s, "user_id", "event_type", "ts", 86_400, 1, "1 day"), "append")
    return out.where("admitted").groupBy("event_type", "user_id").agg(F.count("*").alias("admitted"))


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def first_seen_stream(spark, sf_dir):
    return _drain(spark, sf_dir, lambda s: streams.first_seen(s, ["user_id", "event_type"], "ts", "36500 days").select("user_id", "event_type"), "append")
