"""How filters interact: what each removes at each place of every order of them.

Every row gets a mask, one bit for each filter it fails.  Rows are counted once per part, mask and
label, so what follows works on at most 2^filters cells a part, whatever the number of rows.  A
recursive query grows prefixes of orders by one unused letter at a time and carries the bits applied
so far; each level joins the cells of the parts and emits the metrics of its step.  A full order reads
its steps from its own prefixes.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, stored, whole_text

# Words stand between these characters.
GAPS = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """What a text fails by itself: A few words, B repeated words, C capitals, D signs."""
    # Removing the empty strings at both ends leaves the words.
    words = F.filter(F.split(text, GAPS), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 100,
        "B": F.lit(100) * distinct < F.lit(80) * n,
        "C": F.lit(100) * capitals.cast("long") > F.lit(10) * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, part: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``part`` and its cells: an array of (mask, rows, good, toxic).

    The bit of the n-th filter in a mask is 2^n, E the fifth: an equal text stands under a smaller id,
    anywhere in the table.  A missing text is empty, a missing part the empty string; a row without an
    id has no smaller one, nor is it anyone's.  A repeated id in ``labels`` is good or toxic if any of
    its rows says so; ids without labels are neither.
    """
    text = F.col("text")
    given = docs.select(col(id_col).cast("long").alias("id"), F.coalesce(col(part).cast("string"), F.lit("")).alias("part"), whole_text(text_col).alias("text"))
    bits = [F.when(fails, F.lit(1 << n)).otherwise(F.lit(0)) for n, fails in enumerate(text_filters(text).values())]
    # 256 bits stand for the text.
    rows = given.select("id", "part", sum(bits[1:], bits[0]).alias("own"), F.unhex(F.sha2(text, 256)).alias("print"))
    known = labels.where(col(id_col).isNotNull()).groupBy(col(id_col).cast("long").alias("id")).agg(
        F.max(F.coalesce(col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
    )
    # The hint keeps a side that grows with the corpus from being broadcast.
    marked = rows.hint("merge").join(known, "id", "left").fillna(0, ["good", "toxic"])
    kind = ["print", "part", "own", "good", "toxic"]
    # Rows are counted by id first, then the ids of a text collapse before the shuffle, however many there are.
    each = marked.groupBy("id", *kind).agg(F.count(F.lit(1)).alias("n"))
    texts = each.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
    )
    # One row per part and label of a text: its smallest id decides which of them are no copies.
    least = F.min("first.id").over(Window.partitionBy("print"))
    fresh = F.col("nameless") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    split = F.explode(F.array(
        F.struct(F.col("own").alias("mask"), F.col("fresh").alias("rows")),
        F.struct((F.col("own") + F.lit(1 << len(bits))).alias("mask"), (F.col("n") - F.col("fresh")).alias("rows")),
    ))
    cells = texts.withColumn("least", least).withColumn("fresh", fresh).select("part", "good", "toxic", split.alias("cell"))
    cells = cells.select("part", "good", "toxic", "cell.*").where(F.col("rows") > 0)
    counted = cells.groupBy("part", "mask").agg(
        F.sum("rows").alias("rows"),
        F.sum(F.col("rows") * F.col("good")).alias("good"),
        F.sum(F.col("rows") * F.col("toxic")).alias("toxic"),
    )
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", "rows", "good", "toxic")).alias("cells"))


def order_metrics(cells: DataFrame, letters: str) -> DataFrame:
    """``part``, ``filter_order``, ``step`` and the metrics of every step of every order of ``letters``.

    ``cells`` has one row a part.  Parts without rows do not occur; without parts there are no rows.
    ``LIMIT ALL`` lifts the bound on recursive rows, so any number of parts is enumerated.
    """
    spark = cells.sparkSession
    bits = spark.createDataFrame([(letter, 1 << n) for n, letter in enumerate(letters)], "letter string, bit int")
    cells = stored(cells, "cells")
    total = lambda field, where: f"aggregate(filter(c.cells, x -> {where}), 0L, (s, x) -> s + x.{field})"
    here = "(x.mask & l.bit) <> 0 AND (x.mask & p.applied) = 0"
    prefixes = spark.sql(
        f"""
        WITH RECURSIVE prefixes(part, prefix, letter, applied, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
          SELECT part, '', '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {{cells}}
          UNION ALL
          SELECT p.part, p.prefix || l.letter, l.letter, p.applied | l.bit, p.step + 1,
                 {total("rows", "(x.mask & (p.applied | l.bit)) = 0")},
                 {total("rows", here)},
                 {total("rows", "(x.mask & l.bit) <> 0 AND (x.mask & p.applied) <> 0")},
                 {total("rows", "x.mask = l.bit")},
                 {total("good", here)},
                 {total("toxic", here)}
          FROM prefixes p
          JOIN {{bits}} l ON (p.applied & l.bit) = 0
          JOIN {{cells}} c ON p.part = c.part
        )
        SELECT * FROM prefixes WHERE step > 0 LIMIT ALL
        """,
        cells=cells,
        bits=F.broadcast(bits),
    )
    prefixes = stored(prefixes, "prefixes")
    # A prefix stands at the start of as many orders as its unused letters have.
    times = F.element_at(F.array(*[F.lit(factorial(len(letters) - n)) for n in range(1, len(letters) + 1)]), F.col("step"))
    shapley = prefixes.groupBy("part", "letter").agg(F.sum(F.col("removed") * times).cast("long").alias("shapley"))
    orders = prefixes.where(F.col("step") == len(letters)).select("part", F.col("prefix").alias("filter_order"))
    steps = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    steps = steps.withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    return (
        steps.join(prefixes, ["part", "prefix", "step"])
        .join(shapley, ["part", "letter"])
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The metrics of every step of every order of the five filters A to E, for each part of ``docs``.

    A: under 100 words; B: 100 times the distinct words under 80 times the words; C: 100 times the
    characters A-Z over 10 times the characters; D: one of ``#$%&*|``; E: an equal text under a smaller
    id.  Per part, order and step: ``kept`` rows after the step, ``removed`` by it, ``redundant`` (failing
    its filter, removed earlier), ``unique_fails`` (failing its filter alone), ``good_lost`` and
    ``toxic_lost`` (removed here, with quality or toxic 1), ``shapley`` (what its filter removes in all
    orders together).

    A missing text is empty (it fails A alone, and E after the first), a missing part is ''.  Rows that
    share an id count each, are no copies of each other and share its labels; a row without an id fails
    E never and has no labels.  Ids only in ``labels`` and other columns are ignored.  Without rows there
    is no part and no result.
    """
    return order_metrics(mask_cells(docs, labels, part, id_col, text_col), "ABCDE")
