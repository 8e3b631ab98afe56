"""Column functions on text: normal forms, hashes, words, n-grams, markup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z0-9][A-Za-z0-9_'-]*"
WORD = r"(?U)\w+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends (not blanks only)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def clean(c: Column | str) -> Column:
    """Null to empty, runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " "))


def norm(c: Column | str) -> Column:
    return F.lower(clean(c))


def keep_lines(c: Column | str) -> Column:
    """Line ends to LF, blanks and tabs collapsed, at most one empty line, stripped."""
    out = F.regexp_replace(F.coalesce(col(c), F.lit("")), "\r\n?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(out)


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def content_hash(c: Column | str) -> Column:
    return sha(norm(c))


def record_id(prefix: Column | str, first: Column | str, second: Column | str, size: int = 20) -> Column:
    """prefix_ and the first hex digits of the hash of prefix, first and second in lower case, on lines."""
    body = F.concat_ws("\n", col(prefix), F.lower(col(first)), F.lower(col(second)))
    return F.concat(col(prefix), F.lit("_"), F.substring(sha(body), 1, size))


def pair_id(prefix: str, first: Column | str, second: Column | str, size: int = 16) -> Column:
    """prefix_ and the first hex digits of the hash of two texts with a double bar between them, as they are."""
    return F.concat(F.lit(prefix + "_"), F.substring(sha(F.concat(col(first), F.lit("‖"), col(second))), 1, size))


def curated_id(dataset: Column | str, task: Column | str, first: Column | str, second: Column | str, size: int = 20) -> Column:
    """dataset_ and the first hex digits of the hash of task and the normal forms of two texts, on lines."""
    return F.concat(col(dataset), F.lit("_"), F.substring(sha(F.concat_ws("\n", col(task), norm(first), norm(second))), 1, size))


def canonical_json(**fields: Column | str) -> Column:
    """JSON of text fields with sorted keys and blanks behind commas and colons, as many hash recipes want it."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(col(c).cast("string"))), r"^\[|\]$", "")
    parts = [F.concat(F.lit(f'"{k}": '), F.coalesce(quoted(fields[k]), F.lit("null"))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


#: Matches that one fold of spans lays out.
SPAN_BLOCK = 128


def spans(c: Column, pattern: str) -> Column:
    """start, end (from 0) and original of all matches of a pattern that matches no empty text, in turn.

    A fold copies what it has for each match, so matches are laid out in blocks of SPAN_BLOCK, each from 0, and the blocks one behind the other."""
    own = "array<struct<start:int,end:int,original:string>>"
    kind, kinds = f"struct<at:int,found:{own}>", f"struct<at:int,found:array<{own}>>"
    found, between = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
    pairs = F.filter(F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("skip"), m.alias("m"))), lambda x: x["m"].isNotNull())
    empty = lambda k: F.struct(F.lit(0).alias("at"), F.array().alias("found")).cast(k)
    span = lambda start, end, original: F.struct(start.alias("start"), end.alias("end"), original.alias("original"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["skip"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(span(start, end, x["m"]))).alias("found")).cast(kind)

    def behind(acc: Column, block: Column) -> Column:
        moved = F.transform(block["found"], lambda s: span(s["start"] + acc["at"], s["end"] + acc["at"], s["original"]))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["found"], F.array(moved)).alias("found")).cast(kinds)

    def laid(p: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1)), F.lit(SPAN_BLOCK))
        blocks = F.transform(starts, lambda i: F.aggregate(F.slice(p, i, F.lit(SPAN_BLOCK)), empty(kind), step))
        return F.flatten(F.aggregate(blocks, empty(kinds), behind)["found"])

    return F.when(c.rlike(pattern), let(pairs, laid)).otherwise(F.array().cast(own))


def rank_hash(*columns: Column | str, seed: str = "") -> Column:
    """A reproducible random rank of a row: a hash of the seed and its columns."""
    parts = [F.coalesce(col(c).cast("string"), F.lit("")) for c in columns]
    return sha(F.concat_ws("\x01", F.lit(seed), *parts))


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(TOKEN), F.lit(0))


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(WORD), F.lit(0))


def folded_words(c: Column | str) -> Column:
    """Words with apostrophes, case folded (lower case, sharp s as ss)."""
    low = F.replace(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("ß"), F.lit("ss"))
    return F.regexp_extract_all(low, F.lit(r"(?U)[\w']+"), F.lit(0))


def count_words(c: Column | str, pattern: str = WORD) -> Column:
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(pattern))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, also where body uses it inside higher-order functions."""
    return F.transform(F.array(value), body)[0]


def ngrams(array: Column, n: int) -> Column:
    """All runs of n entries, joined by blanks; none where there are fewer."""

    def runs(a: Column) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.size(a) - n), lambda i: F.array_join(F.slice(a, i + 1, n), " "))
        return F.when(F.size(a) >= n, some).otherwise(F.array().cast("array<string>"))

    return let(array, runs)


# Marks of Markdown and what stands in their place, in turn.
MARKDOWN = [
    (r"(?s)<!--.*?-->", " "),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"(?mdU)^#{1,6}\s*", ""),
    (r"(?mdU)^\s*[-*+]\s+", "• "),
    (r"(?mdU)^\s*>\s?", ""),
]


def markdown_text(c: Column | str) -> Column:
    """Markdown without comments, link targets, heading marks and quotes; images as their text, bullets as a dot."""
    return keep_lines(reduce(lambda out, mark: F.regexp_replace(out, *mark), MARKDOWN, col(c)))


ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def unescaped(c: Column) -> Column:
    """Text with character references by their names or numbers replaced."""
    pattern = r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))

    def sign(m: Column) -> Column:
        digits = F.regexp_extract(m, "([0-9a-fA-F]+);", 1)
        number = F.when(F.lower(F.substring(m, 3, 1)) == "x", F.conv(digits, 16, 16)).otherwise(F.conv(digits, 10, 16))
        return F.decode(F.unhex(F.lpad(number, 8, "0")), "UTF-32")

    by_number = F.array_join(F.zip_with(F.split(c, pattern, -1), F.transform(found, sign), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = F.when(F.contains(c, F.lit("&#")), by_number).otherwise(c)
    return reduce(lambda text, e: F.replace(text, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), out)


def without_elements(c: Column, *names: str) -> Column:
    return F.regexp_replace(c, rf"(?is)<({'|'.join(names)})\b.*?(?:</\1\s*>|\z)", " ")


def node_texts(markup: Column) -> Column:
    """The text between tags, each piece stripped and on a line of its own."""
    pieces = F.transform(F.split(markup, r"<[^>]+>", -1), lambda p: strip(unescaped(p)))
    return keep_lines(F.array_join(F.filter(pieces, lambda p: p != ""), "\n"))


def markup_text(c: Column | str) -> Column:
    """The text of an XML or HTML document without scripts, styles and comments."""
    out = F.regexp_replace(without_elements(F.coalesce(col(c), F.lit("")), "script", "style"), r"(?s)<!--.*?-->|<\?.*?\?>", " ")
    return node_texts(out)


def repository_text(c: Column | str, path: Column | str) -> Column:
    """The text of a repository's file: markup by its tags, other files as Markdown."""
    return F.when(F.lower(col(path)).rlike(r"\.(xml|html)$"), markup_text(c)).otherwise(markdown_text(c))


def html_title(c: Column | str) -> Column:
    return clean(F.regexp_extract(col(c), r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(c: Column | str) -> Column:
    """The text of the first main, article or else body, without scripts, forms and page furniture; a line for each piece."""
    out = without_elements(col(c), "script", "style", "noscript", "svg", "canvas", "form")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    root = out
    for name in ("body", "article", "main"):
        root = F.when(out.rlike(rf"(?i)<{name}\b[^>]*>"), F.regexp_extract(out, rf"(?is)<{name}\b[^>]*>(.*?)(?:</{name}\s*>|\z)", 1)).otherwise(root)
    return node_texts(without_elements(root, "nav", "footer", "header", "aside"))


def identity(url: Column | str, repository: Column | None = None) -> Column:
    """The repository if it is given, owner/name for code hosts, else the host; lower case."""
    host = F.lower(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    path = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+/[^/?#]+)", 1)
    own = F.when((host == "github.com") & (path != ""), F.lower(path)).otherwise(host)
    return F.coalesce(F.lower(repository), own) if repository is not None else own


def first_words(c: Column | str, n: int) -> Column:
    """At most n words; if words are cut, without marks at the end but a full stop."""
    text = strip(c)
    head = F.regexp_extract(text, rf"(?U)^(?:[^\w]*[\w'-]+){{{n}}}", 0)
    cut = F.regexp_replace(head, r"[ ,;:-]+$", "")
    ended = F.when(cut.rlike(r"[.!?]$"), cut).otherwise(F.concat(cut, F.lit(".")))
    return F.when(count_words(text, r"(?U)[\w'-]+") > n, ended).otherwise(text)
