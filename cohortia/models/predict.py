"""Scoring rows with trees."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import col
from .binning import matrix
from .ship import received, shipped


@dataclass
class RawTree:
    """A tree on feature values: node position to (feature index, cut, default left, value, cover)."""

    feature: np.ndarray
    cut: np.ndarray
    default_left: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    depth: int


def collect_trees(trees: DataFrame, features: Sequence[str], model_id: int = 0) -> list[RawTree]:
    """The trees of one model on the driver: model metadata, of a size set by depth and rounds."""
    place = {name: i for i, name in enumerate(features)}
    grouped: dict[int, list] = {}
    for row in trees.where(F.col("model_id") == model_id).collect():
        grouped.setdefault(row["tree"], []).append(row)
    found = []
    for t in sorted(grouped):
        size = max(row["node"] for row in grouped[t]) + 1
        tree = RawTree(
            np.full(size, -1, np.int32), np.zeros(size), np.zeros(size, bool), np.zeros(size), np.zeros(size), 0
        )
        for row in grouped[t]:
            node = row["node"]
            tree.cover[node] = row["cover"]
            if row["feature"] is None:
                tree.value[node] = row["value"]
            else:
                tree.feature[node], tree.cut[node] = place[row["feature"]], row["split_value"]
                tree.default_left[node] = row["default_left"]
                tree.depth = max(tree.depth, node.bit_length())
        found.append(tree)
    return found


def tree_values(values: np.ndarray, tree: RawTree) -> np.ndarray:
    node = np.ones(len(values), np.int64)
    rows = np.arange(len(values))
    for _ in range(tree.depth):
        feature = tree.feature[node]
        x = values[rows, np.maximum(feature, 0)]
        left = np.where(np.isnan(x), tree.default_left[node], x < tree.cut[node])
        node = np.where(feature >= 0, 2 * node + 1 - left, node)
    return tree.value[node]


def predict(
    df: DataFrame,
    trees: DataFrame,
    features: Sequence[str],
    model_id: int = 0,
    base_score: float = 0.5,
    keep: Sequence[str] | None = None,
    name: str = "p",
) -> DataFrame:
    """Probability per row, beside the columns of ``keep`` (all by default)."""
    features = list(features)
    keep = list(df.columns if keep is None else keep)
    shared = shipped(df.sparkSession, collect_trees(trees, features, model_id))
    start = math.log(base_score / (1 - base_score))
    inputs = [f"__x{i}" for i in range(len(features))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = received(shared)
        for batch in batches:
            values = matrix(batch, inputs)
            margin = np.full(batch.num_rows, start)
            for tree in forest:
                margin += tree_values(values, tree)
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(1.0 / (1.0 + np.exp(-margin)))], names=[*plain_names(keep), "p"]
            )

    schema = T.StructType([*plain_fields(df, keep), T.StructField("p", T.DoubleType())])
    return plain_source(df, keep, features, inputs).mapInArrow(score, schema).toDF(*keep, name)


def plain_names(keep: Sequence[str]) -> list[str]:
    """Stand-ins for kept column names, which may hold dots."""
    return [f"__k{i}" for i in range(len(keep))]


def plain_fields(df: DataFrame, keep: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(plain, df.schema[c].dataType) for c, plain in zip(keep, plain_names(keep), strict=True)]


def plain_source(df: DataFrame, keep: Sequence[str], features: Sequence[str], inputs: Sequence[str]) -> DataFrame:
    """Kept columns and features as doubles under stand-in names."""
    return df.select(
        *[col(c).alias(plain) for c, plain in zip(keep, plain_names(keep), strict=True)],
        *[col(f).cast("double").alias(x) for f, x in zip(features, inputs, strict=True)],
    )
