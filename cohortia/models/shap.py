"""Per-row attributions of a tree model (path-dependent Shapley values)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import col
from ..session import cut_lineage
from .binning import matrix
from .predict import RawTree, collect_trees, plain_fields, plain_names, plain_source
from .ship import received, shipped

ROWS_AT_ONCE = 65_536


def leaf_paths(tree: RawTree) -> Iterator[tuple[int, list[tuple[int, bool]]]]:
    """Each leaf with its path: (inner node, whether the path turns left there)."""
    waiting = [(1, [])]
    while waiting:
        node, path = waiting.pop()
        if tree.feature[node] < 0:
            yield node, path
        else:
            waiting += [(2 * node, [*path, (node, True)]), (2 * node + 1, [*path, (node, False)])]


def expected_margin(forest: Sequence[RawTree], base_score: float) -> float:
    """Mean margin over the training cover; what attributions add up from."""
    total = math.log(base_score / (1 - base_score))
    for tree in forest:
        total += sum(tree.value[leaf] * tree.cover[leaf] / tree.cover[1] for leaf, _ in leaf_paths(tree) if tree.cover[1])
    return total


def path_shares(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Shapley weight of each path feature, per pattern of satisfied features.

    A leaf pays its value to a coalition as the product of ``one`` over members and ``zero`` over
    the others.  Each feature's polynomial over the other features counts coalitions by size.
    """
    patterns, m = one.shape
    by_size = np.zeros((patterns, m, m))
    by_size[:, :, 0] = 1.0
    for k in range(m):
        grown = by_size * zero[k]
        grown[:, :, 1:] += by_size[:, :, :-1] * one[:, k, None, None]
        grown[:, k, :] = by_size[:, k, :]
        by_size = grown
    weight = np.array([math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)])
    return (one - zero) * (by_size @ weight)


def attributions(values: np.ndarray, forest: Sequence[RawTree]) -> np.ndarray:
    """One attribution per row and feature; with the expected margin they sum to the row's margin."""
    phi = np.zeros(values.shape)
    for tree in forest:
        inner = np.flatnonzero(tree.feature >= 0)
        x = values[:, tree.feature[inner]]
        goes_left = np.where(np.isnan(x), tree.default_left[inner], x < tree.cut[inner])
        place = {int(node): i for i, node in enumerate(inner)}
        for leaf, path in leaf_paths(tree):
            if not path:
                continue
            names = list(dict.fromkeys(int(tree.feature[node]) for node, _ in path))
            zero = np.ones(len(names))
            meets = np.ones((len(values), len(names)), bool)
            for node, left in path:
                j = names.index(int(tree.feature[node]))
                child = 2 * node if left else 2 * node + 1
                zero[j] *= tree.cover[child] / tree.cover[node]
                meets[:, j] &= goes_left[:, place[node]] == left
            code = meets @ (1 << np.arange(len(names), dtype=np.int64))
            seen, at = np.unique(code, return_inverse=True)
            pattern = ((seen[:, None] >> np.arange(len(names))) & 1).astype(np.float64)
            phi[:, names] += tree.value[leaf] * path_shares(zero, pattern)[at]
    return phi


def shap_wide(
    df: DataFrame, trees: DataFrame, features: Sequence[str], keep: Sequence[str] = ("row_id",), model_id: int = 0
) -> DataFrame:
    """Attributions and feature values of each row as two arrays in feature order."""
    features, keep = list(features), list(keep)
    shared = shipped(df.sparkSession, collect_trees(trees, features, model_id))
    inputs = [f"__x{i}" for i in range(len(features))]

    def lists(values: np.ndarray) -> pa.Array:
        flat = pa.array(values.ravel(), mask=np.isnan(values.ravel()))
        return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * len(features), flat)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS_AT_ONCE:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = received(shared)
        for table in gathered(batches):
            for batch in table.combine_chunks().to_batches():
                values = matrix(batch, inputs)
                kept = [batch.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*kept, lists(attributions(values, forest)), lists(values)], names=[*plain_names(keep), "phi", "x"]
                )

    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([*plain_fields(df, keep), T.StructField("phi", doubles), T.StructField("x", doubles)])
    return plain_source(df, keep, features, inputs).mapInArrow(explain, schema).toDF(*keep, "phi", "x")


def long_form(wide: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per row and feature: variable, attribution, feature value, beside the kept columns."""
    keep = [name for name in wide.columns if name not in ("phi", "x")]
    names = F.array(*[F.lit(name) for name in features])
    cells = F.arrays_zip(names.alias("variable"), F.col("phi").alias("value"), F.col("x").alias("rfvalue"))
    return wide.select(*[col(c) for c in keep], F.inline(cells)).toDF(*keep, "variable", "value", "rfvalue")


def shap_long(
    df: DataFrame, trees: DataFrame, features: Sequence[str], keep: Sequence[str] = ("row_id",), model_id: int = 0
) -> DataFrame:
    """Attributions in long form.

    Columns a later step groups or filters by are best kept here: they then need no join with a
    table that has one row per row and feature.
    """
    return long_form(shap_wide(df, trees, features, keep, model_id), features)


def shap_scaled(wide: DataFrame, features: Sequence[str]) -> DataFrame:
    """Long form with the feature value scaled to 0..1 within its variable, and the variable's mean |attribution|.

    The arrays are written once; ranges and means come from them, and so do the long rows.
    """
    held = cut_lineage(wide)
    spread = long_form(held.select("phi", "x"), features).groupBy("variable").agg(
        F.min("rfvalue").alias("__low"), F.max("rfvalue").alias("__high"), F.avg(F.abs("value")).alias("mean_value")
    )
    # One row per feature.
    joined = long_form(held, features).join(F.broadcast(spread), "variable")
    scaled = F.try_divide(F.col("rfvalue") - F.col("__low"), F.col("__high") - F.col("__low"))
    return joined.withColumn("stdfvalue", scaled).drop("__low", "__high")


def margin_gap(wide: DataFrame, expected: float, score: str = "p") -> DataFrame:
    """Largest distance between a row's margin and its attributions plus the expected margin."""
    margin = F.log(F.col(score) / (1 - F.col(score)))
    total = F.aggregate("phi", F.lit(expected), lambda sum_, value: sum_ + value)
    return wide.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(margin - total)).alias("max_gap"))
