"""Evaluation of scored rows at fixed thresholds, all splits at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bootstrap import auc_ci
from .metrics import auc_of, class_metrics, ranked_scores, roc_of, youden_threshold


def cells_at(ranked: DataFrame, thresholds: Mapping[str, float | Column], by: Sequence[str]) -> DataFrame:
    """Confusion cells per group and named threshold, from the counts per distinct score."""
    sums = []
    for name, threshold in thresholds.items():
        above = F.col("score") > threshold
        cell = F.struct(
            F.lit(name).alias("at"),
            F.max(F.lit(threshold) if not isinstance(threshold, Column) else threshold).alias("threshold"),
            F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(above, 0).otherwise(F.col("pos"))).alias("fn"),
            F.sum(F.when(above, 0).otherwise(F.col("neg"))).alias("tn"),
        )
        sums.append(cell)
    return ranked.groupBy(*by).agg(F.array(*sums).alias("cells")).select(*by, F.inline("cells"))


def train_threshold(ranked: DataFrame, by: str = "split", fitted_on: str = "train") -> Column:
    """The Youden threshold of the training rows, as a scalar subquery."""
    roc = roc_of(ranked.where(F.col(by) == fitted_on), [by])
    return youden_threshold(roc, [by]).select("threshold").scalar()


def evaluate(
    scored: DataFrame,
    label: str = "y",
    score: str = "p",
    by: str = "split",
    fitted_on: str = "train",
    reps: int | None = None,
    seed: int = 7204,
) -> DataFrame:
    """Metrics per split at 0.5 and at the training threshold, with AUC and, given ``reps``, its interval.

    Everything but the interval follows from one table of counts per distinct score.
    """
    ranked = ranked_scores(scored, label, score, [by])
    thresholds = {"fixed": 0.5, "trained": train_threshold(ranked, by, fitted_on)}
    table = class_metrics(cells_at(ranked, thresholds, [by]))
    areas = auc_of(ranked, [by]).select(by, "auc")
    # One row per split.
    table = table.join(F.broadcast(areas), by)
    if reps:
        interval = auc_ci(scored, label, score, [by], reps, seed).select(by, "ci_lower", "ci_upper")
        table = table.join(F.broadcast(interval), by, "left")
    return table


def summary_rows(evaluation: DataFrame, by: str = "split") -> DataFrame:
    """The annotations of a ROC figure as text: AUC, interval, F1 of both classes, operating point."""

    def three(value: Column) -> Column:
        return F.when(value.isNotNull(), F.format_string("%.3f", value))

    shown = evaluation.where("at = 'trained'")
    area = three(F.col("auc"))
    if "ci_lower" in evaluation.columns:
        area = F.concat(area, F.lit(" ("), three(F.col("ci_lower")), F.lit(" to "), three(F.col("ci_upper")), F.lit(")"))
    return shown.select(
        by,
        area.alias("auc"),
        three(F.col("f1")).alias("f1_positive"),
        three(F.col("f1_neg")).alias("f1_negative"),
        three(F.col("threshold")).alias("threshold"),
        three(F.col("sensitivity")).alias("tpr"),
        three(1 - F.col("specificity")).alias("fpr"),
    )
