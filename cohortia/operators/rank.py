"""Row numbers and running totals whose windows stay small on any data.

A window needs all rows of its group in one task.  The operators here never open a
window over an unbounded group: they count first, run totals over the counts, and
number rows only inside blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import col, join_null_safe
from ..session import cut_lineage

HOT_ROWS = 1_000_000
HOT_SHARE = 100_000
BLOCK_IDS = 1 << 20


def hot_groups(df: DataFrame, by: Sequence[str], rows: int = HOT_ROWS) -> DataFrame:
    """Groups too large for one window.

    A hot group holds more than 1/100,000 of all rows, so there are fewer than 100,000
    of them whatever the data: this table is safe to broadcast.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    total = sizes.agg(F.sum("__n").alias("__total")).scalar()
    return sizes.where((F.col("__n") > rows) & (F.col("__n") * HOT_SHARE > total)).select(*by)


def numbered(
    df: DataFrame, by: Sequence[str], order: str, tie: str, name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``row_number`` within ``by``, ordered by ``order`` (missing last) and then ``tie``.

    ``tie`` is a unique whole number, ``order`` has a bounded number of values per group
    (a calendar day).  Ordinary groups use a plain window.  Hot groups are numbered in
    blocks of at most 2^20 consecutive ids of one day, shifted by the rows before the block.
    """
    by = list(by)
    hot = F.broadcast(hot_groups(df, by, hot_rows))
    plain = join_null_safe(df, hot, by, "left_anti").withColumn(
        name, F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last(), tie))
    )

    block = [*by, order, "__block"]
    large = join_null_safe(df, hot, by, "left_semi").withColumn(
        "__block", F.floor(F.col(tie) / BLOCK_IDS).cast("bigint")
    )
    blocks = large.groupBy(*block).agg(F.count(F.lit(1)).alias("__n"))
    days = blocks.groupBy(*by, order).agg(F.sum("__n").alias("__day_n"))
    days = days.select(
        *by, order, _before("__day_n", Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last()), "__day_before")
    )
    blocks = blocks.select(
        *block, _before("__n", Window.partitionBy(*by, order).orderBy("__block"), "__block_before")
    )
    offsets = join_null_safe(blocks, days, [*by, order]).select(
        *block, (F.col("__block_before") + F.col("__day_before")).alias("__before")
    )
    inside = large.withColumn("__rank", F.row_number().over(Window.partitionBy(*block).orderBy(tie)))
    shifted = join_null_safe(inside, offsets, block).withColumn(name, F.col("__rank") + F.col("__before"))
    return plain.withColumn(name, F.col(name).cast("bigint")).unionByName(
        shifted.select(*df.columns, F.col(name).cast("bigint").alias(name))
    )


def _before(value: str, window, name: str) -> Column:
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias(name)


def score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score; everything about ranks follows from it.

    Rows whose label or score is missing take no part.  A label other than 0/1 is an error.
    """
    usable = df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return usable.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def in_range_parts(df: DataFrame, order: Sequence[str], parts: int | None = None, name: str = "bucket") -> DataFrame:
    """``df`` sorted into range partitions, with the number of each row's partition.

    The number rises with ``order``, and rows that are equal in it share one.  The table is written once,
    so everything that reads it sees the same cut; the driver learns nothing about it.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(parts, *[col(c) for c in order]).withColumn(name, F.spark_partition_id()))


def with_buckets(counts: DataFrame, parts: int | None = None) -> DataFrame:
    """Add a ``bucket`` that rises with the score: the range partition, of all groups together."""
    return in_range_parts(counts, ["score"], parts)


def numbered_in_parts(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """``row_number`` within ``by`` in the order of ``order`` (missing first), for groups of any size.

    Rows are numbered inside range partitions; the rows of a group before a partition are added.  Rows of
    a group must differ in ``order``.
    """
    by, order = list(by), list(order)
    placed = in_range_parts(df, [*by, *order], parts, "__part")
    keys = [*by, "__part"]
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    # One row per group and partition.
    group = Window.partitionBy(*by).orderBy("__part") if by else Window.partitionBy(F.lit(0)).orderBy("__part")
    before = sizes.select(*keys, _before("__n", group, "__before"))
    inside = placed.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return join_null_safe(inside, before, keys).withColumn(name, F.col("__at") + F.col("__before")).select(*[col(c) for c in df.columns], name)


def running_counts(bucketed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group and distinct score: counts up to and including it, group totals, previous score.

    A prefix sum on two levels: bucket totals, one row per group and bucket, carry the running count
    across buckets; inside a bucket a window over its distinct scores finishes the job.
    """
    by = list(by)
    keys = [*by, "bucket"]
    totals = bucketed.groupBy(*keys).agg(
        F.sum("pos").alias("b_pos"), F.sum("neg").alias("b_neg"), F.max(F.struct("score", "pos")).alias("b_last")
    )
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ordered = group.orderBy("bucket")
    totals = totals.select(
        *keys,
        _before("b_pos", ordered, "pos_before"),
        _before("b_neg", ordered, "neg_before"),
        F.lag("b_last").over(ordered).alias("last_before"),
        F.sum("b_pos").over(group).alias("n_pos"),
        F.sum("b_neg").over(group).alias("n_neg"),
    )
    inside = Window.partitionBy(*keys).orderBy("score")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = bucketed.select(
        *keys,
        "score",
        "pos",
        "neg",
        F.sum("pos").over(upto).alias("cum_pos"),
        F.sum("neg").over(upto).alias("cum_neg"),
        F.lag("score").over(inside).alias("prev_score"),
        F.lag("pos").over(inside).alias("prev_pos"),
    )
    return join_null_safe(local, totals, keys).select(
        *by,
        "score",
        "pos",
        "neg",
        (F.col("cum_pos") + F.col("pos_before")).alias("cum_pos"),
        (F.col("cum_neg") + F.col("neg_before")).alias("cum_neg"),
        F.coalesce("prev_score", "last_before.score").alias("prev_score"),
        F.coalesce("prev_pos", "last_before.pos").alias("prev_pos"),
        "n_pos",
        "n_neg",
    )
