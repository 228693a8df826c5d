"""License scans: sparse TF-IDF cosine to license templates, then inheritance by path.

Templates are headers (sentences by which a license is named or granted) and whole license texts, the
files of license_texts/. A text is cut into statements (lines, and sentences within lines); those with
two different header words or more are compared with every sentence of the headers. A text of which
half of the words or more are words of the license texts is compared with each of these as a whole.
Vectors are word counts times ln((N + 1) / (df + 1)) + 1, df over all N documents; words that no
template has count in a vector's length as words met nowhere. A document's own license is that of the
license text it matches best at or above `whole_threshold`, else the best match of any statement at or
above the threshold. It is a licence file if it matches a whole text, or if half of its statements or
more match headers of its license. A document without a license of its own inherits from the nearest directory above it that has a licence
file, found by joining the ancestors of its directory; of several licence files in a directory the
most frequent license counts.

Null texts and paths count as empty (above an empty path is only the root, ''). Null and repeated ids
are rows like others; ties go to the first license by name. Other columns are ignored. What is
broadcast is as large as the templates.
"""

from __future__ import annotations

import math
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut

#: Statements by which licenses are named or granted.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "You may not use this file except in compliance with the License"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under the BSD 3-Clause License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "You can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "Proprietary": ["All rights reserved", "Proprietary and confidential"],
}


@lru_cache(maxsize=1)
def license_texts() -> dict[str, str]:
    """The whole texts in license_texts/, by license."""
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}


WORD = "[a-z0-9]+"
PARTS = "[.!?]+[ \t\r]+|[.!?]*[\n]"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def template_words(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """(license, sentence, word, tf)."""
    rows = [(k, i, s) for k, sentences in sorted(templates.items()) for i, s in enumerate(sentences)]
    made = spark.createDataFrame(rows, "license string, sentence int, text string")
    return made.select("license", "sentence", F.explode(words(F.col("text"))).alias("word")).groupBy("license", "sentence", "word").agg(F.count("*").alias("tf"))


def frequencies(docs: DataFrame, text_col: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """The number of documents, and that of those which have each template word."""
    seen = F.array_distinct(F.filter(words(F.col(text_col).cast("string")), lambda w: w.isin(vocabulary)))
    df = docs.select(F.explode(seen).alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()  # at most the vocabulary
    return docs.count(), {r.word: r.df for r in df}


def statements(docs: DataFrame, id_col: str, text_col: str, path: Column, idf: dict[str, float], nowhere: float, threshold: float, file_words: list[str]) -> DataFrame:
    """(row, id, path, n_statements, whole, found), whole: all words of the texts of which half or more
    are file_words, else null; found: the statements that can reach the threshold as (n,
    words), n counting all words and words being those of templates, repeats included. As a table.

    A cosine is at most the length of a statement's template words against its whole length, and that is
    at most the sum of their weights: what stays below by this bound is left out here."""
    weight = F.create_map(*(F.lit(x) for pair in sorted(idf.items()) for x in pair))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.monotonically_increasing_id().alias("row"), F.filter(F.transform(F.split(text, PARTS), words), lambda w: F.size(w) > 0).alias("said"))
    known = F.transform("said", lambda w: F.struct(F.size(w).alias("n"), F.filter(w, lambda x: x.isin(sorted(idf))).alias("words")))
    total = lambda s: F.aggregate(s.words, F.lit(0.0), lambda a, x: a + F.element_at(weight, x))
    least = (1 - 1e-9) * threshold * threshold / (1 - threshold * threshold) * nowhere * nowhere
    found = F.filter(F.filter(known, lambda s: F.size(F.array_distinct(s.words)) > 1), lambda s: total(s) * total(s) >= (s.n - F.size(s.words)) * least)
    common = F.aggregate("said", F.lit(0), lambda a, w: a + F.size(F.filter(w, lambda x: x.isin(file_words))))
    all_ = F.aggregate("said", F.lit(0), lambda a, w: a + F.size(w))
    whole = F.when((F.size("said") > 0) & (2 * common >= all_), F.flatten("said"))
    return cut(rows.select("row", "id", "path", F.size("said").alias("n_statements"), whole.alias("whole"), found.alias("found")), "statements")


def own_licenses(lines: DataFrame, model: DataFrame, idf: dict[str, float], nowhere: float, threshold: float) -> DataFrame:
    """(row, own, cosine, is_file) of the documents with a license of their own."""
    weights = cut(lines.sparkSession.createDataFrame(sorted(idf.items()), "word string, idf double"), "idf")
    unit = model.join(F.broadcast(weights), "word").withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("license", "sentence")))
    unit = unit.select("license", "sentence", "word", (F.col("w") / length).alias("unit"))
    said = lines.select("row", "n_statements", F.posexplode("found").alias("at", "s")).select("row", "n_statements", "at", "s.n", F.explode("s.words").alias("word"))
    said = said.groupBy("row", "n_statements", "at", "n", "word").agg(F.count("*").alias("tf")).join(F.broadcast(weights), "word").withColumn("w", F.col("tf") * F.col("idf"))
    whole = said.groupBy("row", "n_statements", "at", "n").agg(F.collect_list(F.struct("word", "tf", "w")).alias("v"))  # a statement's words
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.w * x.w) + (F.col("n") - F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x.tf)) * nowhere * nowhere
    whole = whole.select("row", "n_statements", "at", F.sqrt(square).alias("length"), F.explode("v").alias("x")).select("row", "n_statements", "at", "length", "x.word", "x.w")
    match = whole.join(F.broadcast(unit), "word").groupBy("row", "n_statements", "at", "license", "sentence").agg(F.round(F.sum(F.col("w") * F.col("unit")) / F.first("length"), 9).alias("cosine"))
    match = match.where(F.col("cosine") >= threshold).groupBy("row", "n_statements", "license").agg(F.max("cosine").alias("cosine"), F.count_distinct("at").alias("held"))
    best = match.groupBy("row", "n_statements").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license", "held")).alias("b"))
    return best.select("row", F.col("b.license").alias("own"), (-F.col("b.c")).alias("cosine"), (2 * F.col("b.held") >= F.col("n_statements")).alias("is_file"))


def whole_matches(docs: DataFrame, texts: DataFrame, idf: dict[str, float], nowhere: float, threshold: float) -> DataFrame:
    """(row, whole, cosine): the license text that each of docs (row, said: its words) matches best."""
    weights = F.broadcast(cut(docs.sparkSession.createDataFrame(sorted(idf.items()), "word string, idf double"), "idf"))
    unit = texts.join(weights, "word").withColumn("w", F.col("tf") * F.col("idf"))
    unit = unit.select("license", "word", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("license")))).alias("unit"))
    said = docs.select("row", F.explode("said").alias("word")).groupBy("row", "word").agg(F.count("*").alias("tf"))
    said = cut(said.join(weights, "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(nowhere))), "said")
    length = said.groupBy("row").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    match = said.join(F.broadcast(unit), "word").groupBy("row", "license").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    match = match.join(length, "row").select("row", "license", F.round(F.col("dot") / F.col("length"), 9).alias("cosine")).where(F.col("cosine") >= threshold)
    return match.groupBy("row").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b")).select("row", F.col("b.license").alias("whole"), (-F.col("b.c")).alias("cosine"))


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, texts: dict[str, str] | None = None, threshold: float = 0.6, whole_threshold: float = 0.8) -> DataFrame:
    """One row (id_col, path, license, cosine, origin, inherited_from) per row of docs; origin is own,
    file, inherited or none."""
    spark = docs.sparkSession
    model = cut(template_words(spark, templates or TEMPLATES), "templates")
    files = cut(template_words(spark, {k: [t] for k, t in (license_texts() if texts is None else texts).items()}), "texts")
    vocabulary, file_words = ([r.word for r in m.select("word").distinct().orderBy("word").collect()] for m in (model, files))
    n_docs, df = frequencies(docs, text_col, sorted({*vocabulary, *file_words}))
    nowhere = math.log(n_docs + 1.0) + 1.0
    weight = lambda w: math.log((n_docs + 1.0) / (df.get(w, 0) + 1.0)) + 1.0
    idf = {w: weight(w) for w in vocabulary}
    lines = statements(docs, id_col, text_col, path, idf, nowhere, threshold, file_words)
    parts = own_licenses(lines, model, idf, nowhere, threshold)
    whole = whole_matches(lines.where("whole IS NOT NULL").select("row", F.col("whole").alias("said")), files, {w: weight(w) for w in file_words}, nowhere, whole_threshold)
    own = parts.join(whole.withColumnRenamed("cosine", "whole_cosine"), "row", "full").select("row", F.coalesce("whole", "own").alias("own"), F.coalesce("whole_cosine", "cosine").alias("cosine"), (F.col("whole").isNotNull() | F.coalesce("is_file", F.lit(False))).alias("is_file"))
    scanned = cut(lines.select("row", "id", "path").join(own, "row", "left").withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")), "licenses")
    files = scanned.where("is_file").groupBy("dir", "own").agg(F.count("*").alias("n"))
    licensed = files.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "own")).alias("m")).select("dir", F.col("m.own").alias("license"))
    above = scanned.where("own IS NULL").select("dir").distinct().withColumn("parts", F.expr("CASE WHEN dir = '' THEN array() ELSE split(dir, '/') END"))
    above = above.select("dir", F.explode(F.expr("transform(sequence(0, size(parts)), i -> struct(i AS depth, array_join(slice(parts, 1, i), '/') AS up))")).alias("a"))
    nearest = above.select("dir", "a.depth", "a.up").join(licensed.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "license")).alias("near"))
    named = scanned.join(cut(nearest, "nearest"), "dir", "left")  # a row a directory: a full directory skews one side only, which Spark splits
    origin = F.when(F.col("is_file"), "file").when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return named.select(F.col("id").alias(id_col), "path", F.coalesce("own", "near.license").alias("license"), "cosine", origin.alias("origin"), F.when(F.col("own").isNull(), F.col("near.up")).alias("inherited_from"))


def oracle_sql(threshold: float = 0.6, whole_threshold: float = 0.8) -> str:
    """DuckDB SQL of scan() over documents with the paths of the registered query."""
    texts = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in license_texts().items())
    values = ", ".join(f"('{k}', {i}, '{s}')" for k, sentences in sorted(TEMPLATES.items()) for i, s in enumerate(sentences))
    return f"""
WITH t(license, sentence, text) AS (VALUES {values}),
tw AS (SELECT license, sentence, word, count(*) AS tf FROM (SELECT license, sentence, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM t) GROUP BY ALL),
ft(license, text) AS (VALUES {texts}),
fw AS (SELECT license, word, count(*) AS tf FROM (SELECT license, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM ft) GROUP BY ALL),
vocab AS (SELECT DISTINCT word FROM tw), fvocab AS (SELECT DISTINCT word FROM fw), every AS (SELECT word FROM vocab UNION SELECT word FROM fvocab),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') || '/' || coalesce(lang, '') || CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN '/' || doc_id // 256 ELSE '/' || doc_id // 256 || '/' || doc_id // 32 END AS dir, coalesce(text, '') AS text FROM documents),
df AS (SELECT word, count(DISTINCT rid) AS df FROM (SELECT rid, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM d) JOIN every USING (word) GROUP BY word),
n AS (SELECT count(*) AS n FROM d),
idf AS (SELECT word, ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 AS idf FROM vocab LEFT JOIN df USING (word), n),
fidf AS (SELECT word, ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 AS idf FROM fvocab LEFT JOIN df USING (word), n),
unit AS (SELECT license, sentence, word, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY license, sentence)) AS unit FROM tw JOIN idf USING (word)),
s AS (SELECT rid, pos, said FROM (SELECT rid, unnest(range(1, len(p) + 1)) AS pos, unnest(p) AS said FROM (SELECT rid, string_split_regex(text, '{PARTS.replace(chr(10), chr(92) + "n").replace(chr(9), chr(92) + "t").replace(chr(13), chr(92) + "r")}') AS p FROM d)) WHERE regexp_matches(lower(said), '{WORD}')),
tot AS (SELECT rid, count(*) AS n_statements FROM s GROUP BY rid),
w AS (SELECT rid, pos, word, count(*) AS tf FROM (SELECT rid, pos, unnest(regexp_extract_all(lower(said), '{WORD}')) AS word FROM s) GROUP BY ALL),
cand AS (SELECT rid, pos FROM w JOIN vocab USING (word) GROUP BY ALL HAVING count(*) > 1),
len AS (SELECT rid, pos, sqrt(sum(CASE WHEN idf IS NULL THEN tf * (ln(n + 1.0) + 1.0) * (ln(n + 1.0) + 1.0) ELSE tf * idf * tf * idf END)) AS length FROM w JOIN cand USING (rid, pos) LEFT JOIN idf USING (word), n GROUP BY ALL),
match AS (SELECT rid, pos, license, sentence, round(sum(tf * idf * unit) / any_value(length), 9) AS cosine FROM w JOIN len USING (rid, pos) JOIN idf USING (word) JOIN unit USING (word) GROUP BY ALL),
best AS (SELECT rid, license, max(cosine) AS cosine, count(DISTINCT pos) AS held FROM match WHERE cosine >= {threshold} GROUP BY ALL),
dw AS (SELECT rid, word, count(*) AS tf FROM (SELECT rid, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM d) GROUP BY ALL),
half AS (SELECT rid FROM dw LEFT JOIN (SELECT word, 1 AS known FROM fvocab) USING (word) GROUP BY rid HAVING 2 * sum(CASE WHEN known = 1 THEN tf ELSE 0 END) >= sum(tf)),
weighed AS (SELECT rid, word, tf * coalesce(idf, ln(n + 1.0) + 1.0) AS w FROM dw JOIN half USING (rid) LEFT JOIN fidf USING (word), n),
funit AS (SELECT license, word, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY license)) AS unit FROM fw JOIN fidf USING (word)),
flen AS (SELECT rid, sqrt(sum(w * w)) AS length FROM weighed GROUP BY rid),
fmatch AS (SELECT rid, license, round(sum(w * unit) / any_value(length), 9) AS cosine FROM weighed JOIN flen USING (rid) JOIN funit USING (word) GROUP BY ALL),
whole AS (SELECT rid, license AS whole, cosine AS whole_cosine FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY cosine DESC, license) AS k FROM fmatch WHERE cosine >= {whole_threshold}) WHERE k = 1),
part AS (SELECT rid, license AS own, cosine, 2 * held >= n_statements AS is_file FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY cosine DESC, license) AS k FROM best) JOIN tot USING (rid) WHERE k = 1),
own AS (SELECT rid, coalesce(whole, own) AS own, coalesce(whole_cosine, cosine) AS cosine, whole IS NOT NULL OR coalesce(is_file, false) AS is_file FROM part FULL JOIN whole USING (rid)),
files AS (SELECT dir, own, count(*) AS n FROM d JOIN own USING (rid) WHERE is_file GROUP BY ALL),
of_dir AS (SELECT dir, own AS license FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY n DESC, own) AS k FROM files) WHERE k = 1),
ups AS (SELECT dir, array_to_string(string_split(dir, '/')[1:depth], '/') AS up, depth FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS depth FROM (SELECT DISTINCT dir FROM d))),
near AS (SELECT ups.dir, arg_max(license, depth) AS license, arg_max(up, depth) AS up FROM ups JOIN of_dir ON of_dir.dir = up GROUP BY ups.dir)
SELECT doc_id, coalesce(own, license) AS license, round(cosine, 6) AS cosine,
  CASE WHEN is_file THEN 'file' WHEN own IS NOT NULL THEN 'own' WHEN license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own IS NULL THEN up END AS inherited_from
FROM d LEFT JOIN own USING (rid) LEFT JOIN near USING (dir)
"""
