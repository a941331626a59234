"""Confusion cells, class metrics, ROC, AUC and thresholds, per group throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import running_counts, score_counts, with_buckets

DIRECTIONS = ("auto", "<", ">")
WIDE = "decimal(38,0)"


def classify(df: DataFrame, threshold: float | Column, score: str = "p", name: str = "pred") -> DataFrame:
    """1 where the score is strictly above the threshold."""
    return df.withColumn(name, (F.col(score) > threshold).cast("bigint"))


def confusion(df: DataFrame, label: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """All four cells per group, zero cells included."""
    truth, found = F.col(label), F.col(pred)
    return df.groupBy(*by).agg(
        F.count_if((truth == 1) & (found == 1)).alias("tp"),
        F.count_if((truth == 0) & (found == 1)).alias("fp"),
        F.count_if((truth == 1) & (found == 0)).alias("fn"),
        F.count_if((truth == 0) & (found == 0)).alias("tn"),
    )


def class_metrics(cells: DataFrame) -> DataFrame:
    """Metrics of the four cells; a ratio without cases is NULL."""
    tp, fp, fn, tn = (F.col(name).cast("double") for name in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    ppv, npv = F.try_divide(tp, tp + fp), F.try_divide(tn, tn + fn)
    accuracy = F.try_divide(tp + tn, n)
    chance = F.try_divide((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    return cells.withColumns(
        {
            "sensitivity": sens,
            "specificity": spec,
            "ppv": ppv,
            "npv": npv,
            "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
            "f1_neg": F.try_divide(2 * tn, 2 * tn + fp + fn),
            "balanced_accuracy": (sens + spec) / 2,
            "accuracy": accuracy,
            "kappa": F.try_divide(accuracy - chance, 1 - chance),
            "prevalence": F.try_divide(tp + fn, n),
            "detection_rate": F.try_divide(tp, n),
            "detection_prevalence": F.try_divide(tp + fp, n),
        }
    )


def ranked_scores(df: DataFrame, label: str = "y", score: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Running class counts per distinct score; input of the AUC, ROC and bootstrap operators."""
    return running_counts(with_buckets(score_counts(df, label, score, by)), by)


def _middle(cumulative: str, total: str) -> Column:
    """Median of a class from its running counts: mean of the two middle scores."""
    low = F.min(F.when(F.col(cumulative) >= F.expr(f"({total} + 1) div 2"), F.col("score")))
    high = F.min(F.when(F.col(cumulative) >= F.expr(f"{total} div 2 + 1"), F.col("score")))
    return (low + high) / 2


def auc_of(ranked: DataFrame, by: Sequence[str] = (), direction: str = "auto") -> DataFrame:
    """AUC with ties counted half.

    Direction '<' takes cases to score higher, '>' lower; 'auto' decides by the class medians.
    A group with one class has no AUC.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    above = F.col("n_pos") - F.col("cum_pos")
    twice = F.col("neg").cast("decimal(18,0)") * (2 * above + F.col("pos")).cast("decimal(19,0)")
    summed = ranked.groupBy(*by).agg(
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
        F.sum(twice.cast(WIDE)).cast("double").alias("__wins"),
        _middle("cum_pos", "n_pos").alias("__case_median"),
        _middle("cum_neg", "n_neg").alias("__control_median"),
    )
    pairs = 2.0 * F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    up = F.try_divide(F.col("__wins"), pairs)
    higher = {"<": F.lit(True), ">": F.lit(False), "auto": F.col("__control_median") <= F.col("__case_median")}
    return summed.select(
        *by,
        "n_pos",
        "n_neg",
        F.when(higher[direction], "<").when(~higher[direction], ">").alias("direction"),
        F.when(higher[direction], up).otherwise(1 - up).alias("auc"),
    )


def auc(
    df: DataFrame, label: str = "y", score: str = "p", by: Sequence[str] = (), direction: str = "auto"
) -> DataFrame:
    return auc_of(ranked_scores(df, label, score, by), by, direction)


def roc_of(ranked: DataFrame, by: Sequence[str] = (), direction: str = "<") -> DataFrame:
    """ROC points: a cut below, between and above the distinct scores of each group.

    Carries the integer counts beside the rates so that later steps compare exactly.
    """
    if direction not in ("<", ">"):
        raise ValueError("a ROC curve needs the direction '<' or '>'")
    infinity = float("inf")
    inner = ranked.select(
        *by,
        F.coalesce((F.col("prev_score") + F.col("score")) / 2, F.lit(-infinity)).alias("threshold"),
        (F.col("cum_pos") - F.col("pos")).alias("pos_below"),
        (F.col("cum_neg") - F.col("neg")).alias("neg_below"),
        "n_pos",
        "n_neg",
    )
    last = ranked.groupBy(*by).agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    last = last.select(
        *by,
        F.lit(infinity).alias("threshold"),
        F.col("n_pos").alias("pos_below"),
        F.col("n_neg").alias("neg_below"),
        "n_pos",
        "n_neg",
    )
    points = inner.unionByName(last)
    if direction == "<":
        tp, fp = F.col("n_pos") - F.col("pos_below"), F.col("n_neg") - F.col("neg_below")
    else:
        tp, fp = F.col("pos_below"), F.col("neg_below")
    return points.select(
        *by,
        "threshold",
        tp.alias("tp"),
        fp.alias("fp"),
        "n_pos",
        "n_neg",
        F.try_divide(tp.cast("double"), F.col("n_pos").cast("double")).alias("tpr"),
        F.try_divide(fp.cast("double"), F.col("n_neg").cast("double")).alias("fpr"),
    )


def roc_points(
    df: DataFrame, label: str = "y", score: str = "p", by: Sequence[str] = (), direction: str = "<"
) -> DataFrame:
    return roc_of(ranked_scores(df, label, score, by), by, direction)


def _youden() -> Column:
    """sens + spec - 1 times n_pos * n_neg, as an exact whole number."""
    hit = F.col("tp").cast("decimal(18,0)") * F.col("n_neg").cast("decimal(18,0)")
    miss = F.col("fp").cast("decimal(18,0)") * F.col("n_pos").cast("decimal(18,0)")
    return (hit - miss).cast(WIDE)


def youden_threshold(roc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Smallest cut with the largest sens + spec - 1, with its rates and the number of ties."""
    scored = roc.withColumn("__j", _youden())
    best = scored.groupBy(*by).agg(
        F.max(F.struct(F.col("__j"), (-F.col("threshold")).alias("__minus"), "tpr", "fpr")).alias("__best")
    )
    ties = scored.groupBy(*by, "__j").agg(F.count(F.lit(1)).alias("n_best"))
    top = ties.groupBy(*by).agg(F.max(F.struct("__j", "n_best")).alias("__top"))
    joined = best.join(top, list(by)) if by else best.withColumn("__top", top.select("__top").scalar())
    return joined.select(
        *by,
        (-F.col("__best.__minus")).alias("threshold"),
        F.col("__best.tpr").alias("tpr"),
        F.col("__best.fpr").alias("fpr"),
        F.col("__top.n_best").alias("n_best"),
    )


def youden_ties(roc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every cut that attains the largest sens + spec - 1."""
    scored = roc.withColumn("__j", _youden())
    best = scored.groupBy(*by).agg(F.max("__j").alias("__j"))
    return scored.join(F.broadcast(best), [*by, "__j"]).drop("__j")


def nearest_point(roc: DataFrame, column: str, value: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """ROC point nearest to ``value`` in one column, the first by threshold on ties."""
    value = value if isinstance(value, Column) else F.lit(value)
    gap = F.abs(F.col(column) - value)
    chosen = roc.groupBy(*by).agg(
        F.min(F.struct(gap.alias("__gap"), "threshold", "tp", "fp", "n_pos", "n_neg", "tpr", "fpr")).alias("__near")
    )
    return chosen.select(*by, "__near.*").drop("__gap")


def exact_point(roc: DataFrame, threshold: float | Column) -> DataFrame:
    """ROC points whose cut is the threshold itself."""
    return roc.where(F.col("threshold") == threshold)


def operating_points(
    roc: DataFrame, threshold: float | Column, by: Sequence[str] = ("split",), fitted_on: str = "train"
) -> DataFrame:
    """TPR and FPR per group at a threshold: exact where it was fitted, nearest elsewhere."""
    at = exact_point(roc.where(F.col(by[0]) == fitted_on), threshold)
    near = nearest_point(roc.where(F.col(by[0]) != fitted_on), "threshold", threshold, by)
    columns = [*by, "threshold", "tpr", "fpr"]
    return at.select(*columns).unionByName(near.select(*columns))


def subgroup_metrics(
    df: DataFrame,
    threshold: float | Column,
    group: str,
    label: str = "y",
    score: str = "p",
    by: Sequence[str] = (),
) -> DataFrame:
    """Size, AUC and class metrics per subgroup at one threshold; rows without a group are left out.

    Labels, scores and cells all follow from the counts per distinct score, so the rows are
    shuffled once, after partial aggregation.
    """
    keys = [*by, group]
    counts = with_buckets(score_counts(df.where(F.col(group).isNotNull()), label, score, keys))
    return subgroup_metrics_of(counts, threshold, keys)


def subgroup_metrics_of(counts: DataFrame, threshold: float | Column, keys: Sequence[str]) -> DataFrame:
    """The same from the bucketed counts of each subgroup, which may be read for other tables too."""
    keys = list(keys)
    above = F.col("score") > threshold
    cells = counts.groupBy(*keys).agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(above, 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(above, 0).otherwise(F.col("neg"))).alias("tn"),
    )
    areas = auc_of(running_counts(counts, keys), keys).select(*keys, "auc")
    return (
        class_metrics(cells)
        .join(areas, keys)
        .select(
            *keys,
            (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"),
            "auc",
            "sensitivity",
            "specificity",
            "ppv",
            "npv",
            "balanced_accuracy",
        )
    )


def pooled(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Running counts over coarser groups, from bucketed counts of finer ones."""
    by = list(by)
    summed = counts.groupBy(*by, "bucket", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return running_counts(summed, by)


def sensitivity_subset(df: DataFrame, column: str = "CDAI0", above: float = 10.0) -> DataFrame:
    """Rows whose baseline score is known and above the limit."""
    return df.where((F.col(column) > above) & ~F.isnan(column))
