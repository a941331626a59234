"""Tables of planted cases for the tests of this folder."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
    + [T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def make_docs(spark, rows, **more):
    """A documents table out of (doc_id, text); ``more`` are constant extra columns."""
    from pyspark.sql import functions as F

    data = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(data, DOCS)
    return df.withColumns({name: F.lit(value) for name, value in more.items()})


def corpus(seed=5, n=60, words=80):
    """Documents with exact and near copies, shared passages, short, empty and missing texts, and ties."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = text(40)
    rows = [(i, text(rng.randint(5, words))) for i in range(n)]
    for i in range(n, n + 12):
        rows.append((i, rows[rng.randrange(n)][1]))
    for i in range(n + 12, n + 30):
        copy = rows[rng.randrange(n)][1].split(" ")
        copy[rng.randrange(len(copy))] = "changed"
        rows.append((i, " ".join(copy)))
    for i in range(n + 30, n + 45):
        rows.append((i, f"{text(10)}\n{shared}\t{text(8)}"))
    last = n + 45
    rows += [(last, ""), (last + 1, None), (last + 2, "  \n "), (last + 3, "a"), (last + 4, "a b c"), (last + 5, "A b C")]
    rows += [rows[3], rows[3], (None, rows[4][1]), (None, None), (last + 6, "aaaa " * 60), (last + 7, "é" * 200)]
    rng.shuffle(rows)
    return rows
