"""Personal data: e-mail addresses, IP addresses, card and phone numbers, and identifiers found by
bootstrapped contextual extraction. DataFrame functions only.

Base matches seed the bootstrap. Every occurrence of a seed or of another identifier-like string (a
run of ASCII letters, digits and ._@%+- of at least six characters with a digit; a chain of digit groups
with single blanks, dots, hyphens or brackets between; a string with '@') has lexical patterns: the word
before, the two words before, and the words on both sides. Patterns and strings are a
bipartite graph; words reach back 80 code points and ahead 40 at most, so a longer word counts by that
part. It is scored in turns: a pattern scores, for a kind, the share of its distinct strings
that are of this kind (seeds count 1, others their confidence) if they weigh at least `support`; a
string's confidence is 1 minus the product over its patterns of 1 minus their scores; this goes on
until nothing is new. Strings that begin at one place are one string of a pattern, the longest, but all
get a confidence. Strings that reach `confidence` are found in all texts, within another only that. Graph, patterns and confidences stay in tables.

The regular expressions begin where no earlier start could have matched and use possessive
repetition where nothing can be given back, so a search is linear in the text and needs no stack; the
matches are the leftmost non-overlapping ones of the plain forms beside them.

Null texts count as empty: no spans. Spans are in code points, end exclusive. Null and repeated ids
are rows like others (spans are joined by a digest of the text). Other columns are ignored by find()
and kept by redact().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard, free_name

KINDS = ("email", "ip", "card", "phone")
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ ; \G: the previous match may end inside a local part
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: [0-9]([\x20-]?[0-9])+ of 14 to 19 digits: a whole chain of digits, single blanks or hyphens between
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
#: \+[0-9][\x20().0-9-]+[0-9]
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Other identifier-like strings.
OTHER = r"(?<![A-Za-z0-9._@%+-])(?=[A-Za-z._@%+-]*+[0-9])[A-Za-z0-9+][A-Za-z0-9._@%+-]{4,}[A-Za-z0-9]"
#: Groups of digits with one of `blank . - ( )` between, or a bracket with one of the others, from + or ( on.
CHAIN = r"(?<![A-Za-z0-9._@%+-])\+?+\(?+[0-9]++(?:(?:\)[\x20.-]?+|[\x20.-]\(?+|\()[0-9]++(?![A-Za-z_@%+]))++"
#: A name at a host, with dots or without, or only @name.
AT = r"(?<![A-Za-z0-9._@%+-])[A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
SPAN = "struct<start:int,kind:int,end:int,value:string>"


def matches(text: Column, pattern: str, kind: int, gate: Column) -> Column:
    """Spans of the leftmost non-overlapping matches, from what lies between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc.at + x.gap
        end = begin + F.char_length(x.value)
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x.value.alias("value"))
        return F.struct(end.alias("at"), F.concat(acc.spans, F.array(span)).alias("spans"))

    return F.when(gate, F.aggregate(pairs, start, step, lambda acc: acc.spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _octet(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.char_length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


def base_spans(text: Column) -> Column:
    """Base matches that pass their checks, by start, then kind."""
    digits = lambda s: F.regexp_replace(s.value, "[^0-9]", "")
    email = matches(text, EMAIL, 0, F.contains(text, F.lit("@")))
    ip = F.filter(matches(text, IP, 1, F.rlike(text, F.lit(IP))), lambda s: F.forall(F.split(s.value, r"\."), _octet))
    card = F.filter(matches(text, CARD, 2, F.rlike(text, F.lit(CARD))), lambda s: F.call_function("luhn_check", digits(s)))
    phone = F.filter(matches(text, PHONE, 3, F.contains(text, F.lit("+"))), lambda s: F.char_length(digits(s)).between(10, 15))
    return F.array_sort(F.concat(email, ip, card, phone))


def _word_before(left: Column, n: int) -> Column:
    return F.lower(F.regexp_extract(left, r"(\S+\s+){%d}\S*$" % n, 0))


def _occurrence(text: Column, s: Column) -> Column:
    """A span with its patterns."""
    left = F.substring(text, F.greatest(s.start - 79, F.lit(1)), F.least(s.start, F.lit(80)))
    right = F.regexp_extract(F.substring(text, s.end + 1, F.lit(40)), r"^\S*\s*\S*", 0)
    one, two = _word_before(left, 1), _word_before(left, 2)
    keep = lambda tag, c, full: F.when(full, F.concat(F.lit(tag), c))
    patterns = F.filter(F.array(keep("1 ", one, one != ""), keep("2 ", two, two != ""), keep("b ", F.concat(one, F.lit("\n"), F.lower(right)), (one != "") & (F.trim(right) != ""))), lambda p: p.isNotNull())
    return F.struct(s.kind.alias("kind"), s.value.alias("value"), s.start.alias("start"), s.end.alias("end"), patterns.alias("patterns"))


def _blanked(text: Column, spans: Column) -> Column:
    """text with line ends in place of the spans, as long as it was."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, acc.at + 1, F.greatest(s.start - acc.at, F.lit(0))), F.repeat(F.lit("\n"), F.greatest(s.end - F.greatest(acc.at, s.start), F.lit(0))))
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.concat(acc.out, F.array(piece)).alias("out"))

    made = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc.out, ""), F.substring(text, acc.at + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, made).otherwise(text)


def with_base(docs: DataFrame, text_col: str, base: str = "base", key: str = "key", seen: str = "seen") -> DataFrame:
    """docs with the base spans, a digest of the text, and the occurrences of seeds (kind 0 to 3) and others
    (-1; -2 if a longer one begins at the same place), under names that docs does not have."""
    text, rest, others = (free_name(docs, x) for x in ("pii_text", "pii_rest", "pii_others"))
    rows = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = rows.withColumn(base, base_spans(F.col(text)))
    free = lambda s: ~F.exists(base, lambda b: (s.start < b.end) & (b.start < s.end))
    rows = rows.withColumn(rest, _blanked(F.col(text), F.col(base)))
    runs = matches(F.col(text), OTHER, -1, F.rlike(text, F.lit("[0-9]")))
    chains = F.filter(matches(F.col(rest), CHAIN, -1, F.rlike(rest, F.lit(CHAIN))), lambda s: F.char_length(s.value) >= 6)
    names = matches(F.col(rest), AT, -1, F.contains(rest, F.lit("@")))
    rows = rows.withColumn(others, F.array_sort(F.filter(F.concat(runs, chains, names), free)))
    after = lambda i: F.get(others, i + 1)
    rows = rows.withColumn(others, F.filter(others, lambda s, i: ~F.coalesce((s.start == after(i).start) & (s.end == after(i).end), F.lit(False))))
    kind = lambda s, i: F.when(F.coalesce(s.start == after(i).start, F.lit(False)), -2).otherwise(-1)
    rows = rows.withColumn(others, F.transform(others, lambda s, i: F.struct(s.start.alias("start"), kind(s, i).alias("kind"), s.end.alias("end"), s.value.alias("value"))))
    found = F.transform(F.concat(base, others), lambda s: _occurrence(F.col(text), s))
    return rows.withColumn(key, F.md5(text)).withColumn(seen, found).select(*docs.columns, base, key, seen)


def discover(found: DataFrame, support: float = 8, precision: float = 0.8, confidence: float = 0.8) -> DataFrame | None:
    """found: a table of with_base(). (value, kind, confidence) of strings that are no seeds; None if
    no pattern is good enough."""
    seen = found.where(F.size("seen") > 0).select(F.explode("seen").alias("s")).select("s.kind", "s.value", F.explode("s.patterns").alias("pattern"))
    edges = cut(seen.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pii-edges")
    weights = [F.when(F.col("kind") == k, 1.0).otherwise(0.0) for k in range(len(KINDS))]
    one = F.when(F.col("kind") > -2, 1).otherwise(0).alias("one")
    rated = edges.select("pattern", one, *(w.alias(f"w{k}") for k, w in enumerate(weights)))
    states = set()
    while True:
        total = rated.groupBy("pattern").agg(F.sum("one").alias("n"), *(F.sum(f"w{k}").alias(f"w{k}") for k in range(len(KINDS))))
        kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"w{k}").alias("w")) for k in range(len(KINDS))))
        good = total.select("pattern", "n", F.explode(kinds).alias("k")).where(f"k.w >= {support} AND k.w / n >= {precision}").select("pattern", F.col("k.kind").alias("as"), (F.col("k.w") / F.col("n")).alias("score"))
        good = cut(good, "pii-patterns")
        if good.isEmpty():
            return None
        told = edges.where("kind < 0").join(good, "pattern").groupBy("value", "as").agg((1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))).alias("confidence"))
        best = told.groupBy("value").agg(F.max(F.struct("confidence", -F.col("as"))).alias("b")).select("value", (-F.col("b.col2")).alias("as"), "b.confidence")
        known = cut(best, "pii-strings")
        discard(good)
        reached = F.count_if(F.col("confidence") >= confidence)
        state = tuple(known.agg(F.count("*"), reached, F.round(F.avg("confidence"), 4)).first())
        if not state[0]:
            return None
        if state in states:  # no string is new
            break
        states.add(state)
        more = edges.join(known, "value", "left")
        rated = more.select("pattern", one, *((w + F.when((F.col("kind") == -1) & (F.col("as") == k), F.col("confidence")).otherwise(0.0)).alias(f"w{k}") for k, w in enumerate(weights)))
    return known.where(F.col("confidence") >= confidence).select("value", F.col("as").alias("kind"), "confidence")


def added_spans(found: DataFrame, strings: DataFrame) -> DataFrame:
    """(key, added): the spans of discovered strings by the digest of the text."""
    others = found.select("key", F.explode(F.filter("seen", lambda s: s.kind < 0)).alias("s")).select("key", "s.value", "s.start", "s.end").distinct()
    hits = others.join(strings.select("value", "kind"), "value")
    spans = F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "kind", "end", "value")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def widest(acc: Column, s: Column) -> Column:
        span = F.array(F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"), s.value.alias("value")))
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.when(s.end > acc.at, F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    return hits.groupBy("key").agg(spans.alias("all")).select("key", F.aggregate("all", none, widest, lambda acc: acc.spans).alias("added"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bootstrap: float) -> DataFrame:
    """One row (id_col, base, spans) per row of docs: arrays of (start, kind, end, value) by start, then
    kind, an index of KINDS. spans is base and what the bootstrap adds."""
    found = cut(with_base(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").drop("text"), "pii")
    strings = discover(found, **bootstrap)
    rows = found.select(F.col("id").alias(id_col), "key", "base")
    if strings is None:
        return rows.select(id_col, "base", F.col("base").alias("spans"))
    rows = rows.join(added_spans(found, strings), "key", "left")
    return rows.select(id_col, "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")))).alias("spans"))


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == KINDS.index(kind))).cast("bigint")


def masked(text: Column, spans: Column) -> Column:
    """text with [KIND] in place of each span; of overlapping spans the first gives the name."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, acc.at + 1, s.start - acc.at), F.element_at(names, s.kind + 1))
        out = F.when(s.start >= acc.at, F.concat(acc.out, F.array(piece))).otherwise(acc.out)
        return F.struct(F.greatest(acc.at, s.end).alias("at"), out.alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc.out, ""), F.substring(text, acc.at + 1, F.char_length(text))))


def redact(docs: DataFrame, text_col: str = "text", **bootstrap: float) -> DataFrame:
    """docs, all rows and columns, with personal data in text_col masked (null texts stay null). Texts are
    searched once: rows and their spans are a table until the patterns are known."""
    base, key, seen, added = (free_name(docs, x) for x in ("base_spans", "text_key", "seen_spans", "added_spans"))
    rows = cut(with_base(docs, text_col, base, key, seen), "pii")
    found = rows.select(F.col(key).alias("key"), F.col(seen).alias("seen"))
    strings = discover(found, **bootstrap)
    spans = F.col(base)
    if strings is not None:
        more = added_spans(found, strings).select(F.col("key").alias(key), F.col("added").alias(added))
        rows = rows.join(more, key, "left")
        spans = F.array_sort(F.concat(base, F.coalesce(added, F.array().cast(f"array<{SPAN}>"))))
    return rows.withColumn(text_col, F.when(F.size(spans) > 0, masked(F.col(text_col), spans)).otherwise(F.col(text_col))).select(*docs.columns)
