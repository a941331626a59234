"""Stratified bootstrap interval of the AUC, exact for any number of distinct scores.

Resampling n cases of a class is a multinomial draw over its distinct scores, and a multinomial draw
splits: first how many cases fall in each part of the scores, then, part by part, which scores in it.  The
distinct scores of a group stand in buckets of bounded size, and a tree over the buckets carries the draws
down, level by level: a node meets the weights of its children by a join and hands each child its
counts per replicate.  No row holds more than a node's children, a bucket's scores or a block of replicates, each
node draws with its own seed, and the sums of the buckets are the AUC.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .rank import in_range_parts, score_counts

REPLICATES = 1000
REPLICATE_BLOCK = 100
BUCKET_SCORES = 20_000
FANOUT = 256
NODE = "group_key bigint, node bigint, first_rep int, n_pos array<bigint>, n_neg array<bigint>, above array<bigint>"


def _draw(rng: np.random.Generator, n: int, weights: np.ndarray) -> np.ndarray:
    total = weights.sum()
    return rng.multinomial(n, weights / total) if n and total else np.zeros(len(weights), dtype=np.int64)


def _node_draws(row, seed: int, level: int):
    """Cases of each class that every replicate of the block draws from the row's parts, and positives above it."""
    pos, neg = np.asarray(row.pos, np.int64), np.asarray(row.neg, np.int64)
    for i in range(len(row.n_pos)):
        own = np.random.default_rng([seed, row.group_key % (1 << 63), row.first_rep + i, level, row.node])
        yield _draw(own, int(row.n_pos[i]), pos), _draw(own, int(row.n_neg[i]), neg), int(row.above[i])


def _children(row, seed: int, level: int) -> Iterator[tuple]:
    """The counts of each child of a node, per replicate of the block."""
    draws = list(_node_draws(row, seed, level))
    pos, neg = np.array([d[0] for d in draws]), np.array([d[1] for d in draws])
    above = np.array([d[2] for d in draws])[:, None] + pos[:, ::-1].cumsum(axis=1)[:, ::-1] - pos
    for at, child in enumerate(row.child):
        yield row.group_key, int(child), row.first_rep, pos[:, at], neg[:, at], above[:, at]


def _concordance(row, seed: int, level: int) -> Iterator[tuple[int, int, float]]:
    """Pairs each replicate wins in one bucket: within it, and against the positives above."""
    for i, (pos, neg, above) in enumerate(_node_draws(row, seed, level)):
        higher = above + int(pos.sum()) - np.cumsum(pos)
        yield row.group_key, row.first_rep + i, float(np.dot(neg, higher + pos / 2.0))


def _numbered_buckets(counts: DataFrame, bucket_scores: int) -> DataFrame:
    """Distinct scores with the number of their bucket within the group, from 0, rising with the score."""
    placed = in_range_parts(counts, ["score"], name="part")
    at = F.row_number().over(Window.partitionBy("group_key", "part").orderBy("score")) - 1
    chunked = placed.withColumn("chunk", F.floor(at / F.lit(bucket_scores)))
    # One row per group and range partition.
    sizes = chunked.groupBy("group_key", "part").agg((F.max("chunk") + 1).alias("chunks"))
    earlier = Window.partitionBy("group_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("group_key", "part", F.coalesce(F.sum("chunks").over(earlier), F.lit(0)).alias("before"))
    return chunked.join(before, ["group_key", "part"]).withColumn("bucket", (F.col("chunk") + F.col("before")).cast("bigint"))


def auc_replicates(
    df: DataFrame,
    label: str = "y",
    score: str = "p",
    by: Sequence[str] = ("split",),
    reps: int = REPLICATES,
    seed: int = 7204,
    bucket_scores: int = BUCKET_SCORES,
    fanout: int = FANOUT,
) -> DataFrame:
    """AUC (direction '<') of every replicate and group; a group with one class has none."""
    spark, by = df.sparkSession, list(by)
    counts = score_counts(df, label, score, by).withColumn("group_key", F.xxhash64(F.lit(0), *by))
    shape = counts.groupBy(*by, "group_key").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")).where("n_pos > 0 AND n_neg > 0")
    # One row per bucket, holding its distinct scores in order; its weight is known from them.
    cells = F.sort_array(F.collect_list(F.struct("score", "pos", "neg")))
    buckets = cut_lineage(
        _numbered_buckets(counts, bucket_scores)
        .groupBy("group_key", F.col("bucket").alias("node"))
        .agg(cells.alias("cells"), F.sum("pos").alias("w_pos"), F.sum("neg").alias("w_neg"))
        .select("group_key", "node", F.col("cells.pos").alias("pos"), F.col("cells.neg").alias("neg"), "w_pos", "w_neg")
    )
    last, depth = buckets.agg(F.max("node")).first()[0] or 0, 0
    while fanout**depth <= last:
        depth += 1

    starts = F.sequence(F.lit(0), F.lit(reps - 1), F.lit(REPLICATE_BLOCK))
    blocks = F.transform(
        starts, lambda s: F.struct(s.alias("first_rep"), F.least(F.lit(REPLICATE_BLOCK), F.lit(reps) - s).alias("reps"))
    )
    every = lambda n: F.transform(F.sequence(F.lit(1), F.col("reps")), lambda _: n.cast("bigint"))
    drawn = shape.select("group_key", "n_pos", "n_neg", F.inline(blocks)).select(
        "group_key", F.lit(0).cast("bigint").alias("node"), "first_rep",
        every(F.col("n_pos")).alias("n_pos"), every(F.col("n_neg")).alias("n_neg"), every(F.lit(0)).alias("above"),
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def dealt(nodes: DataFrame, parts: DataFrame) -> DataFrame:
        return nodes.join(parts, ["group_key", "node"]).repartition(tasks, "group_key", "node", "first_rep")

    def each(of, columns: list[str], level: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for row in rows.itertuples(index=False):
                    yield pd.DataFrame(list(of(row, seed, level)), columns=columns)

        return run

    for level in range(depth):
        child = F.floor(F.col("node") / F.lit(fanout ** (depth - level - 1))).cast("bigint")
        weights = buckets.groupBy("group_key", child.alias("child")).agg(F.sum("w_pos").alias("pos"), F.sum("w_neg").alias("neg"))
        family = F.sort_array(F.collect_list(F.struct("child", "pos", "neg"))).alias("family")
        parts = weights.groupBy("group_key", F.floor(F.col("child") / F.lit(fanout)).cast("bigint").alias("node")).agg(family)
        parts = parts.select("group_key", "node", *[F.col(f"family.{name}").alias(name) for name in ("child", "pos", "neg")])
        columns = ["group_key", "node", "first_rep", "n_pos", "n_neg", "above"]
        drawn = dealt(drawn, parts).mapInPandas(each(_children, columns, level), NODE)
    work = dealt(drawn, buckets.select("group_key", "node", "pos", "neg"))
    wins = work.mapInPandas(each(_concordance, ["group_key", "rep", "wins"], depth), "group_key bigint, rep bigint, wins double")
    areas = wins.groupBy("group_key", "rep").agg(F.sum("wins").alias("wins"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return areas.join(shape, "group_key").select(*by, "rep", (F.col("wins") / pairs).alias("auc"))


def auc_ci(
    df: DataFrame,
    label: str = "y",
    score: str = "p",
    by: Sequence[str] = ("split",),
    reps: int = REPLICATES,
    seed: int = 7204,
) -> DataFrame:
    """Percentile interval of the AUC over the replicates."""
    replicates = auc_replicates(df, label, score, by, reps, seed)
    return replicates.groupBy(*by).agg(
        F.percentile("auc", 0.025).alias("ci_lower"),
        F.percentile("auc", 0.5).alias("ci_median"),
        F.percentile("auc", 0.975).alias("ci_upper"),
    )
