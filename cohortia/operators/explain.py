"""Ranking of per-row attributions kept in long form (row_id, variable, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP_N = 10


def mean_abs_shap(shap: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute attribution per variable, missing values skipped."""
    return shap.groupBy(*by, "variable").agg(F.avg(F.abs("value")).alias("mean_abs_shap"))


def top_variables(shap: DataFrame, n: int = TOP_N) -> DataFrame:
    """The n variables with the largest mean, with their rank; ties by name."""
    ordered = mean_abs_shap(shap).orderBy(F.desc("mean_abs_shap"), "variable").limit(n)
    return ordered.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_shap"), "variable")).cast("bigint")
    )


def top_shap_long(shap: DataFrame, n: int = TOP_N) -> DataFrame:
    """Attributions of the top variables with the variable's rank."""
    # n rows.
    return shap.join(F.broadcast(top_variables(shap, n).select("variable", "rank")), "variable")


def attach_group(shap: DataFrame, groups: DataFrame, on: str = "row_id", group: str = "treatment_group") -> DataFrame:
    """Attributions with the row's group; rows without one are left out.

    Both tables grow with the rows, and the long one is larger than the file sizes behind it tell, so
    neither may go through the driver as a broadcast.
    """
    return shap.join(groups.where(F.col(group).isNotNull()).select(on, group).hint("merge"), on)


def drop_prefix(shap: DataFrame, prefix: str) -> DataFrame:
    """Leave out variables encoded from one column."""
    return shap.where(~F.col("variable").startswith(prefix))


def top_n_per_group(df: DataFrame, by: str, order: str, n: int = TOP_N, tie: str = "variable") -> DataFrame:
    """The n rows with the largest ``order`` in each group; the rank filter also runs before the shuffle."""
    window = Window.partitionBy(by).orderBy(F.desc(order), tie)
    return df.withColumn("rank", F.row_number().over(window).cast("bigint")).where(F.col("rank") <= n)


def rank_by_group(labelled: DataFrame, group: str = "treatment_group", n: int = TOP_N) -> DataFrame:
    """Top variables within each group of attributions that carry their row's group.

    Columns encoded from the group itself are not ranked; rows without a group are left out.
    """
    known = drop_prefix(labelled, f"{group}.").where(F.col(group).isNotNull())
    return top_n_per_group(mean_abs_shap(known, [group]), group, "mean_abs_shap", n)


def top_by_group(
    shap: DataFrame, groups: DataFrame, group: str = "treatment_group", n: int = TOP_N, on: str = "row_id"
) -> DataFrame:
    """As ``rank_by_group`` for attributions whose groups are in another table."""
    return rank_by_group(attach_group(drop_prefix(shap, f"{group}."), groups, on, group), group, n)
