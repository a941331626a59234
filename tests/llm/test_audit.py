"""The filter audit against one pass over all rows for every order."""

import re
from collections import defaultdict
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from cohortia.llm.audit import audit, mask_cells
from cohortia.llm.queries import REGISTRY, SQL

SCHEMA = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """One dict of metrics per (part, order, step), by applying each filter to the rows left."""
    marked = []
    for i, text, lang in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = set()
        if len(words) < 100:
            fails.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows):
            fails.add("E")
        good = any(j == i and q == 1 for j, q, _ in labels) and i is not None
        toxic = any(j == i and t == 1 for j, _, t in labels) and i is not None
        marked.append((lang or "", fails, good, toxic))
    out = {}
    shapley = defaultdict(int)
    for part in {m[0] for m in marked}:
        own = [m for m in marked if m[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [m for m in left if letter in m[1]]
                left = [m for m in left if letter not in m[1]]
                failing = [m for m in own if letter in m[1]]
                alone = sum(m[1] == {letter} for m in own)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), alone, sum(m[2] for m in gone), sum(m[3] for m in gone)]
                shapley[part, letter] += len(gone)
    return sorted((p, o, s, *m, shapley[p, o[s - 1]]) for (p, o, s), m in out.items())


def planted():
    long = " ".join(f"w{n}" for n in range(120))
    rows = [(1, long, "en"), (2, long, "en"), (3, long, "de"), (4, long, None), (0, long, None)]
    rows += [(5, None, "en"), (6, "", "en"), (7, " \t\x0b ", "en"), (8, "few words", "de"), (9, "a b " * 200, "de")]
    rows += [(10, "SHOUT " * 30, "fr"), (11, "SHOUT " * 30 + "#", "fr"), (12, long + " 5 %", "fr"), (13, long + "|" + "A" * 90, "")]
    rows += [(14, "É" * 50 + "AAAAA", "fr"), (15, "é" * 50 + "AAAAAA", "fr"), (16, "w x\x1cy " * 99 + "z", "en")]
    rows += [(2, long, "en"), (2, long, "en"), (None, long, "en"), (None, "few words", None), (20, "x" * 300_000 + " $", "fr")]
    rows += [(21, " ".join(f"u{n % 80}" for n in range(100)), "en"), (22, " ".join(f"u{n % 79}" for n in range(100)), "en")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, 1), (9, 1, None), (11, 1, 1), (None, 1, 1), (99, 1, 1), (15, 0, 0), (8, 1, 1)]
    return rows, labels


def test_every_order_and_step(spark):
    rows, labels = planted()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"part": F.lit("x"), "mask": F.lit(3), "id": F.lit(None), "cells": F.lit("y")})
    found = audit(docs, spark.createDataFrame(labels, LABELS).withColumn("id", F.lit(1)))
    got = sorted(tuple(r) for r in found.collect())
    assert got == brute(rows, labels)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_zero_steps_are_there(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{n}" for n in range(120)), "en")], SCHEMA)
    found = audit(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(found) == 600 and {r["filter_order"] for r in found} == {"".join(o) for o in permutations("ABCDE")}
    assert all(r["kept"] == 1 and not any(r[3:][1:]) for r in found)


def test_nothing_from_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert audit(empty, spark.createDataFrame([], LABELS)).count() == 0
    assert mask_cells(empty, spark.createDataFrame([], LABELS)).count() == 0


def test_many_parts(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("few").alias("text"), F.concat(F.lit("p"), "id").alias("lang"))
    found = audit(docs, spark.createDataFrame([], LABELS))
    assert found.count() == 4000 * 600


def test_query_equals_sql(spark, folder):
    found = REGISTRY["op13_filter_audit"](spark, folder)
    connection = duckdb.connect()
    for name in ("documents", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    answer = connection.execute(f"SELECT {', '.join(found.columns)} FROM ({SQL['op13_filter_audit']})").fetchall()
    assert sorted(tuple(r) for r in found.collect()) == sorted(answer)
