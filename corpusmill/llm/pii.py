"""Surrogates for personal data and secrets, in DataFrame functions only.

Detected kinds: e-mail addresses, phone numbers (with a country code, an area code in brackets, three groups, or
pairs), IPv4 and IPv6 addresses, payment cards (of the known networks, with a right check digit), US social security
numbers, IBANs (with right check digits), access keys of known forms, hexadecimal secrets, and names (a title or
a known given name before capitalised words; Latin, Cyrillic and Greek). What has the form of a card, an IBAN or a phone but
not its check digits or number of digits stays as it is. An entity is brought to a normal form (case, separators, country
code of phones), and its surrogate comes from a keyed hash of kind and normal form: so one entity gets one surrogate
in every document and spelling, rendered in the format found (digits poured into the same separators, same case).
Given names are replaced by names of the same gender and script, surnames by names of the same script; cards and
IBANs get right check digits; local part and domain of an address are entities of their own. Within a document that
names somebody the parts of the name are also replaced where they stand alone (unless the text has the same
word in lower case).

Surrogates are checked over all entities of a kind: where two would share one, or one is itself an entity of the corpus,
all but the first are hashed again with the next attempt, ROUNDS times at most. Names and the parts of addresses
grow with their attempts, so that short ones, of which the corpus may hold all, find theirs. What is left then (numbers of
a format whose space the corpus nearly fills) swaps places: each takes another's normal form, in keyed order.

Documents without entities pass unchanged. Others are joined by a hash of their text with their own
map of replacements, so copies, null ids and repeated rows need no key. A null text stays null, empty tables stay empty,
columns of docs may have any names. Texts of any length are read whole, by one task each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, unused

# Given names by script and gender, and titles by gender.
GIVEN = {
    ("latin", "f"): "mary patricia jennifer linda elizabeth susan jessica sarah karen margaret emma olivia sophie claire camille juliette petra ursula heike sabine carmen lucia marta pilar".split(),
    ("latin", "m"): "james robert john michael david william richard thomas charles daniel henry oliver pierre jacques philippe olivier hans jürgen wolfgang dieter carlos jorge miguel javier".split(),
    ("cyrillic", "f"): "анна мария елена ольга татьяна наталья ирина светлана екатерина юлия".split(),
    ("cyrillic", "m"): "иван александр сергей дмитрий алексей андрей михаил николай владимир павел".split(),
    ("greek", "f"): "μαρία ελένη αικατερίνη βασιλική σοφία αγγελική".split(),
    ("greek", "m"): "γιώργος δημήτρης κώστας νίκος γιάννης παναγιώτης".split(),
}
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа"], "u": ["Dr", "Prof"]}
CONSONANTS = {"latin": "bdfgklmnprstvz", "cyrillic": "бвгдзклмнпрст", "greek": "βγδζκλμνπρστ"}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αεηιο"}
#: Letters of other scripts: the pattern that names the script, and the letters that stand in for its own.
OTHER_SCRIPTS = [
    (r"\p{IsHan}", "".join(chr(0x4E00 + i) for i in range(64))),
    (r"\p{IsHangul}", "".join(chr(0xAC00 + 28 * i) for i in range(64))),
    (r"\p{IsHiragana}", "".join(chr(0x304B + i) for i in range(72))),
    (r"\p{IsKatakana}", "".join(chr(0x30AB + i) for i in range(72))),
    (r"\p{IsArabic}", "".join(chr(0x0628 + i) for i in range(19))),
    (r"\p{IsHebrew}", "".join(chr(0x05D0 + i) for i in range(27))),
    (r"\p{IsDevanagari}", "".join(chr(0x0915 + i) for i in range(37))),
    (r"\p{IsThai}", "".join(chr(0x0E01 + i) for i in range(46))),
]
LETTERS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâäçèéêëìíîïñòóôöùúûü", "абвгдежзиклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω"]

WORD = r"\p{Lu}[\p{L}'’]+(?:-\p{Lu}?[\p{L}'’]+)*"
_GIVEN = "|".join(n[0].upper() + n[1:] for names in GIVEN.values() for n in names)
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kinds in the order in which they are tried, and their patterns.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,5}",
    "key": r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|AIza[0-9A-Za-z_-]{35}|xox[abprs]-[0-9A-Za-z-]{10,72}|sk_(?:live|test)_[0-9A-Za-z]{16,64})(?![A-Za-z0-9_-])",
    "hex": r"(?<![A-Za-z0-9])(?=[a-f]*\d)(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?![\d.]*\d)",
    "card": r"(?<![\d-])(?:(?:4\d{3}|5[1-5]\d{2}|2[2-7]\d{2}|6\d{3})(?:[ -]?\d{4}){3}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\p{L}\d])(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\) ?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{1,4}){2,5}|\d{3}([ .-])\d{3}\1\d{4}|0\d(?:[ .-]?\d{2}){4}|0\d{2,4}[ /-]\d{6,8})(?![\p{L}\d])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?:(?:{_TITLE})\.? {WORD}(?: {WORD})?|(?:{_GIVEN}) (?:\p{{Lu}}\. )?{WORD})",
}
ENTITY = "|".join(f"(?:{p})" for p in KINDS.values())
#: What a text with an entity has at least; most texts are passed by after this.
CUE = rf"[@0-9]|(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?:{_TITLE}|{_GIVEN})\.? "


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(col: str) -> Column:
    found = F.regexp_extract_all(F.col(col), F.lit(ENTITY), F.lit(0))
    return F.when(F.col(col).rlike(CUE), found).otherwise(F.array().cast("array<string>"))


def valid(match: Column) -> Column:
    """False for what only looks like a card, an IBAN or a phone number."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    is_a = lambda kind: match.rlike(f"^(?:{KINDS[kind]})$")
    double = lambda c, i: F.when(i % 2 == 1, F.when(2 * c.cast("int") > 9, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))).otherwise(c.cast("int"))
    luhn = F.aggregate(F.transform(F.reverse(F.split(digits, "")), double), F.lit(0), lambda a, x: a + x)
    code = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(code, 5, 100), F.substring(code, 1, 4))
    number = F.array_join(F.transform(F.split(turned, ""), lambda c: F.when(c.between("0", "9"), c).otherwise((F.ascii(c) - 55).cast("string"))), "")
    rest = F.aggregate(F.split(number, ""), F.lit(0), lambda a, c: (10 * a + c.cast("int")) % 97)
    return F.when(is_a("iban"), rest == 1).when(is_a("card"), luhn % 10 == 0).when(is_a("phone"), F.length(digits).between(7, 15)).otherwise(F.lit(True))


def _kind(col: str) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(list(KINDS.items())[:-1]):
        out = F.when(F.col(col).rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _parts(found: DataFrame) -> DataFrame:
    """match, kind, pos, part, ptype, norm: the entities that a match consists of; ptype 'keep' stays as it is."""
    split = F.when(F.col("kind") == "email", F.split("match", "@")).when(F.col("kind") == "name", F.split("match", " ")).otherwise(F.array("match"))
    rows = found.withColumn("parts", split).withColumn("n", F.size("parts"))
    rows = rows.select("match", "kind", "n", F.expr("regexp_replace(parts[0], '[.]', '')").alias("head"), F.posexplode("parts").alias("pos", "part"))
    low = F.lower("part")
    script = F.when(F.col("part").rlike(r"\p{IsCyrillic}"), "cyrillic").when(F.col("part").rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    known = F.lit(None).cast("string")
    for (_, gender), names in GIVEN.items():
        known = F.when(low.isin(names), gender).otherwise(known)
    titled = F.col("head").isin([t for ts in TITLES.values() for t in ts])
    of_title = F.lit("f")
    for gender in ("m", "u"):
        of_title = F.when(F.col("head").isin(TITLES[gender]), "m" if gender == "u" else gender).otherwise(of_title)
    keep = (titled & (F.col("pos") == 0)) | F.col("part").rlike(r"^\p{Lu}\.$")
    last = F.col("pos") == F.col("n") - 1
    name_type = F.when(keep, "keep").when(last, F.concat(F.lit("surname:"), script)).otherwise(F.concat(F.lit("given:"), F.coalesce(known, of_title), F.lit(":"), script))
    ptype = F.when(F.col("kind") == "email", F.when(F.col("pos") == 0, "local").otherwise("domain")).when(F.col("kind") == "name", name_type).otherwise(F.col("kind"))
    digits = F.regexp_replace("part", r"\D", "")
    norm = F.when(F.col("kind").isin("card", "ssn"), digits).when(F.col("kind") == "phone", F.expr("right(regexp_replace(part, '[^0-9]', ''), 10)"))
    norm = norm.when(F.col("kind") == "iban", F.regexp_replace("part", " ", "")).when(F.col("kind").isin("key", "hex", "ip"), F.col("part")).otherwise(low)
    return rows.select("match", "kind", "pos", "part", ptype.alias("ptype"), norm.alias("norm"))


def _byte(i: str) -> str:
    """Number i (SQL) of the entity's stream of hashed bytes."""
    return f"cast(conv(substr(stream, 1 + 2 * pmod({i}, 128), 2), 16, 10) as int)"


def _letters(of: str) -> str:
    """Each digit and letter of `of` (SQL) replaced by a hashed one of its alphabet or script (of the Latin one where
    neither is known); other characters stay."""
    case = "CASE WHEN c BETWEEN '0' AND '9' THEN cast(pmod({v}, 10) as string)"
    for alphabet in LETTERS:
        case += f" WHEN contains({_text(alphabet)}, c) THEN substr({_text(alphabet)}, 1 + pmod({{v}}, {len(alphabet)}), 1)"
    for script, alphabet in OTHER_SCRIPTS:
        case += f" WHEN c RLIKE {_text(script)} THEN substr({_text(alphabet)}, 1 + pmod({{v}}, {len(alphabet)}), 1)"
    case += f" WHEN c RLIKE {_text('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')} THEN substr({_text(LETTERS[0])}, 1 + pmod({{v}}, 26), 1)"
    return f"array_join(transform(split({of}, ''), (c, i) -> {case.replace('{v}', _byte('i'))} ELSE c END), '')"


def _longer(of: str) -> str:
    """`of` (SQL) with one letter more every second attempt: short parts have few surrogates of their own length."""
    return f"concat({of}, repeat('a', attempt div 2))"


def _surrogate() -> str:
    """SQL of the surrogate of (ptype, norm, attempt) from `stream`, in normal form."""
    cases = []
    for script in CONSONANTS:
        c, v = CONSONANTS[script], VOWELS[script]
        syllable = f"concat(substr('{c}', 1 + pmod({_byte('2 * i')}, {len(c)}), 1), substr('{v}', 1 + pmod({_byte('2 * i + 1')}, {len(v)}), 1))"
        cases.append(f"WHEN ptype = 'surname:{script}' THEN concat(array_join(transform(sequence(0, 2 + attempt div 2), i -> {syllable}), ''), '{c[5]}')")
        for gender in "fm":
            pool = GIVEN[script, gender]
            array = ", ".join(_text(n) for n in pool)
            pick = f"element_at(array({array}), 1 + pmod({_byte('i')}, {len(pool)}))"
            cases.append(f"WHEN ptype = 'given:{gender}:{script}' THEN array_join(transform(sequence(0, attempt div 2), i -> {pick}), '-')")
    octets = f"array_join(transform(sequence(0, 3), i -> cast(1 + pmod({_byte('i')}, 254) as string)), '.')"
    card = f"concat(left(norm, 1), substr({_letters('norm')}, 2, length(norm) - 2))"
    double = "if(pmod(i, 2) = 0, if(2 * cast(c as int) > 9, 2 * cast(c as int) - 9, 2 * cast(c as int)), cast(c as int))"
    check = f"pmod(10 - pmod(aggregate(transform(reverse(split(card, '')), (c, i) -> {double}), 0, (a, x) -> a + x), 10), 10)"
    # A code's check digits follow from what comes after them, read as a number (A is 10), the country behind it.
    number = "array_join(transform(split(concat(body, left(norm, 2), '00'), ''), c -> if(c BETWEEN '0' AND '9', c, cast(ascii(c) - 55 as string))), '')"
    checked = f"concat(left(norm, 2), lpad(cast(98 - aggregate(split({number}, ''), 0, (a, c) -> pmod(10 * a + cast(c as int), 97)) as string), 2, '0'), body)"
    iban = f"element_at(transform(array({_letters('substr(norm, 5)')}), body -> {checked}), 1)"
    ip6 = f"array_join(transform(split(norm, ''), (c, i) -> if(c = ':', c, substr('123456789abcdef', 1 + pmod({_byte('i')}, 15), 1))), '')"
    cases += [
        f"WHEN ptype = 'ip' THEN {octets}",
        "WHEN ptype = 'hex' THEN left(stream, length(norm))",
        f"WHEN ptype = 'ip6' THEN {ip6}",
        f"WHEN ptype = 'key' THEN concat(left(norm, 4), {_letters('substr(norm, 5)')})",
        f"WHEN ptype = 'iban' THEN {iban}",
        f"WHEN ptype = 'local' THEN {_letters(_longer('norm'))}",
        f"WHEN ptype = 'domain' THEN concat({_letters(_longer('substring_index(norm, chr(46), size(split(norm, chr(92) || chr(46))) - 1)'))}, '.', substring_index(norm, '.', -1))",
    ]
    plain = f"CASE {' '.join(cases)} ELSE {_letters('norm')} END"
    # A card's last digit follows from the others.
    return f"CASE WHEN ptype = 'card' THEN element_at(transform(array({card}), card -> concat(card, {check})), 1) ELSE {plain} END"


def _render() -> str:
    """SQL that gives the surrogate the form in which the part was found."""
    digit = "regexp_replace(part, '[^0-9]', '')"
    before = "length(regexp_replace(left(part, i + 1), '[^0-9]', ''))"
    place = f"{before} - (length({digit}) - length(surrogate))"
    poured = f"array_join(transform(split(part, ''), (c, i) -> if(c BETWEEN '0' AND '9' AND {place} > 0, substr(surrogate, {place}, 1), c)), '')"
    no_blank = "length(regexp_replace(left(part, i + 1), ' ', ''))"
    spaced = f"array_join(transform(split(part, ''), (c, i) -> if(c = ' ', c, substr(surrogate, {no_blank}, 1))), '')"
    name = "array_join(transform(split(surrogate, '-'), s -> concat(upper(left(s, 1)), substr(s, 2))), '-')"
    upper = "part = upper(part) AND part <> lower(part)"
    return (
        f"CASE WHEN ptype = 'keep' THEN part WHEN ptype IN ('card', 'ssn', 'phone') THEN {poured} WHEN ptype = 'iban' THEN {spaced} "
        f"WHEN ptype IN ('key', 'hex', 'ip') THEN surrogate WHEN {upper} THEN upper(surrogate) "
        f"WHEN ptype RLIKE '^(given|surname)' THEN {name} ELSE surrogate END"
    )


#: Attempts to find a surrogate that is neither taken nor an entity of the corpus.
ROUNDS = 12


def surrogates(parts: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """ptype, norm, surrogate: distinct within a ptype, and none of them a norm of that ptype (but those that swap places at the end)."""
    norms = materialise(parts.where("ptype <> 'keep'").select("ptype", "norm").distinct())
    taken = norms.select("ptype", F.col("norm").alias("surrogate"))
    todo, done, last = norms, [], None
    for attempt in range(rounds):
        base = F.concat_ws("|", F.lit(key), "ptype", "norm", F.lit(str(attempt)))
        stream = F.concat(F.sha2(base, 512), F.sha2(F.concat(base, F.lit("|more")), 512))
        tried = todo.withColumn("attempt", F.lit(attempt)).withColumn("stream", stream).select("ptype", "norm", F.expr(_surrogate()).alias("surrogate"))
        last = materialise(tried)
        first = last.groupBy("ptype", "surrogate").agg(F.min("norm").alias("norm")).select("ptype", "norm", "surrogate")
        for before in (taken, *[d.select("ptype", "surrogate") for d in done]):
            first = first.join(before, ["ptype", "surrogate"], "left_anti")
        done.append(materialise(first))
        todo = materialise(todo.join(done[-1], ["ptype", "norm"], "left_anti"))
        if todo.isEmpty():
            break
    else:
        # Groups of many numbers of one length, none of them in the surrogates above: each takes the next one's place.
        groups = 1 + todo.count() // 100_000
        place = [F.col("ptype"), F.length("norm"), F.pmod(F.xxhash64("norm"), F.lit(groups))]
        order = F.sha2(F.concat_ws("|", F.lit(key), F.lit("swap"), "ptype", "norm"), 256)
        ring = Window.partitionBy(*place).orderBy(order, "norm")
        nxt = F.coalesce(F.lead("norm").over(ring), F.first("norm").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        swapped = todo.withColumn("next", nxt).join(last, ["ptype", "norm"])
        done.append(materialise(swapped.select("ptype", "norm", F.when(F.col("next") != F.col("norm"), F.col("next")).otherwise(F.col("surrogate")).alias("surrogate"))))
    return reduce(DataFrame.unionByName, done)


def _alone(word: Column) -> Column:
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])"), word, F.lit(r"(?![\p{L}\p{N}])"))


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with the entities of text_col replaced, and their number in count_col if it is given."""
    columns = docs.columns
    m, n, tk, news, names = unused([*columns, count_col or ""], "found", "n_found", "text_hash", "replacements", "bare_names")
    rows = docs.withColumn(m, matches(text_col)).withColumn(n, F.coalesce(F.size(F.filter(m, valid)), F.lit(0)))
    # Each distinct entity of a text once; hashes of texts part what a popular entity gathers.
    found = rows.where(F.col(n) > 0).select(F.xxhash64(text_col).alias("tk"), F.explode(F.array_distinct(F.filter(m, valid))).alias("match")).distinct()
    found = materialise(found)
    parts = materialise(_parts(found.select("match").distinct().withColumn("kind", _kind("match"))))
    parts_with = parts.join(surrogates(parts, key), ["ptype", "norm"], "left")
    rendered = parts_with.select("match", "kind", "pos", "part", "ptype", F.expr(_render()).alias("new"))
    whole = F.expr("array_join(transform(array_sort(collect_list(struct(pos, new))), x -> x.new), if(first(kind) = 'email', '@', ' '))")
    # What of a name may stand alone; longer parts first, so that none is replaced inside another.
    alone = F.when((F.col("kind") == "name") & (F.col("ptype") != "keep") & (F.length("part") > 1), F.struct((-F.length("part")).alias("size"), "part", "new"))
    table = materialise(rendered.groupBy("match").agg(whole.alias("new"), F.collect_list(alone).alias("bare")))
    lists = found.join(table, "match").groupBy("tk").agg(
        F.map_from_entries(F.collect_list(F.struct("match", "new"))).alias("map"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("bare")))).alias("bare")
    )
    lists = materialise(lists)
    changed = rows.where(F.col(n) > 0).withColumn(tk, F.xxhash64(text_col)).join(lists.toDF(tk, news, names), tk)
    own = F.filter(names, lambda x: ~F.rlike(F.col(text_col), _alone(F.lower(x["part"]))))
    between = F.split(text_col, ENTITY, -1)
    piece = lambda s: F.aggregate(F.col(names), s, lambda t, x: F.regexp_replace(t, _alone(x["part"]), x["new"]))
    said = F.zip_with(between, m, lambda s, e: F.concat(piece(s), F.coalesce(F.element_at(news, e), e, F.lit(""))))
    changed = changed.withColumn(names, own)
    counted = [F.col(n).alias(count_col)] if count_col else []
    changed = changed.select(*[F.array_join(said, "").alias(c) if c == text_col else F.col(c) for c in columns], *counted)
    same = rows.where(F.col(n) == 0).select(*columns, *counted)
    return same.unionByName(changed)
