"""Fixtures with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import random

from pyspark.sql import Row

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def awkward(extra: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = ["the", "of", "to", "Stone", "river", "Été", "42", "x-y", "naïve", "日本"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(1, 80)), "en", f"s{i % 3}", 1) for i in range(extra)]
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, " \t\n ", "en", "s", 3), (None, "alone with no id here", "en", "s", 9), (None, None, None, None, None)]
    rows += [(2000, rows[0][1], "en", "s", 1), (2001, rows[0][1], "en", "s", 1), (2001, rows[0][1], "en", "s", 1)]  # copies and a repeated row
    rows += [(3000, text(30_000), "en", "s", 1), (3001, "word", "de", "s", 4)]
    return rows


def documents(spark, rows=None, clash: bool = False):
    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
    if clash:
        for c in ("fp", "row", "id", "key", "h", "n_words", "score", "ids", "part", "shard", "cell", "base", "spans", "decoded", "path"):
            df = df.withColumn(c, df.n_chars)
    return df


def jaccard(a, b, width=5):
    """Similarity of two texts' sets of width-word shingles, from the shingles themselves."""

    def whole(text):
        w = (text or "").encode().lower().split()
        return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    x, y = whole(a), whole(b)
    return len(x & y) / len(x | y) if x or y else 1.0


__all__ = ["Row", "awkward", "documents", "jaccard"]
