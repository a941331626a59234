"""The registered queries: each runs operators over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import col
from ..models.boost import fit_boost
from ..models.params import DEFAULT_PARAMS, DEFAULT_ROUNDS, BoostParams, param_grid
from ..models.predict import collect_trees, predict
from ..models.shap import expected_margin, margin_gap, shap_long, shap_scaled, shap_wide
from ..models.tune import best_params, tune
from ..operators import correction as corr
from ..operators import eligibility as elig
from ..operators import encode, explain, metrics, profile, report, split, visits
from ..operators.bootstrap import REPLICATES, auc_ci
from ..operators.evaluate import evaluate, summary_rows
from ..operators.rank import score_counts, with_buckets
from ..session import cut_lineage, stored
from ..sources.fixtures import (
    CATEGORICAL,
    CUTOFF_SITE,
    DRUG_GROUPS,
    EXCLUDED_SITES,
    EXTRACTION_OVERRIDES,
    HOLD_OUT,
    INTRODUCTION_YEARS,
    NUMERIC,
    Views,
)

REGISTRY: dict[str, Callable[[Views], DataFrame]] = {}
GIVEN_THRESHOLD = 0.5
# Floating results are shown with six digits, but for values that often end in an exact half there and
# that both engines compute by the same few operations.
UNROUNDED = {"bmi_recalc"}


def query(make: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    REGISTRY[make.__name__] = make
    return make


def shown(df: DataFrame, rounded: bool = True) -> DataFrame:
    """Dates as text, whole numbers and flags as bigint: types both engines print alike."""
    columns = []
    for field in df.schema.fields:
        value = col(field.name)
        if isinstance(field.dataType, T.DateType):
            value = value.cast("string")
        elif isinstance(field.dataType, (T.IntegralType, T.BooleanType)):
            value = value.cast("bigint")
        elif isinstance(field.dataType, T.DoubleType) and rounded:
            value = F.round(value, 6)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return shown(REGISTRY[name](Views(spark, folder)), name not in UNROUNDED)


# --- visits and outcome


@query
def visit_order(v: Views) -> DataFrame:
    return visits.visit_order(v.raw_visits()).select("visit_id", "ID", "ttt_course", "visit_order")


@query
def followup_window_visits(v: Views) -> DataFrame:
    return visits.window_visits(v.visits()).select("visit_id", "ID", "ttt_course", "Visit_date", "CDAI")


@query
def early_visits(v: Views) -> DataFrame:
    return visits.early_visits(v.visits()).select("visit_id", "ID", "ttt_course", "Visit_date", "CDAI")


@query
def outcome_by_course(v: Views) -> DataFrame:
    return visits.outcome_in_window(v.visits())


@query
def remission_groups(v: Views) -> DataFrame:
    return visits.remission_groups(v.visits())


@query
def remission_group_counts(v: Views) -> DataFrame:
    return visits.remission_groups(v.visits()).groupBy("remission_group").agg(F.count(F.lit(1)).alias("n"))


@query
def baseline_with_outcome(v: Views) -> DataFrame:
    rows = visits.attach_outcome(v.baseline(), visits.outcome_in_window(v.visits()), null_keys=False)
    return rows.select("ID", "ttt_course", "Code", "ttt_startDate", "CDAI0", "CDAI24_10")


@query
def outcome_rate_by_site(v: Views) -> DataFrame:
    rows = visits.attach_outcome(v.baseline(), visits.outcome_in_window(v.visits()), null_keys=False)
    return report.freq_table(rows, "CDAI24_10", ["Code"])


# --- correction and duplicates


@query
def apply_correction(v: Views) -> DataFrame:
    fixed = corr.apply_correction(v.baseline(), v.correction(), keep_original=True)
    return fixed.select("visit_id", "HAQ0", "HAQ0_original")


@query
def correction_count(v: Views) -> DataFrame:
    fixed = corr.apply_correction(v.baseline(), v.correction(), keep_original=True)
    return corr.correction_count(fixed, "NATION_3")


@query
def duplicate_pairs(v: Views) -> DataFrame:
    return corr.pair_audit(v.correction())


@query
def dedup_baseline(v: Views) -> DataFrame:
    return corr.dedup_baseline(v.baseline(), v.correction()).select("visit_id", "ID_original")


# --- covariates and exclusions


def _with_extraction(v: Views) -> DataFrame:
    return elig.override_by_site(v.baseline(), "extraction_date_calc", "extraction_date", EXTRACTION_OVERRIDES)


@query
def site_extraction_override(v: Views) -> DataFrame:
    rows = elig.site_cutoff_filter(_with_extraction(v), CUTOFF_SITE, "ttt_startDate", "extraction_date_calc")
    return rows.select("visit_id", "Code", "extraction_date_calc")


@query
def treatment_duration(v: Views) -> DataFrame:
    return elig.treatment_duration(_with_extraction(v)).select("visit_id", "treatment_duration_calc")


@query
def bmi_recalc(v: Views) -> DataFrame:
    return elig.bmi(v.baseline()).select("visit_id", "BMI_recalc")


@query
def after_intro_flag(v: Views) -> DataFrame:
    rows = elig.after_introduction(v.baseline(), INTRODUCTION_YEARS, name="after_intro")
    return rows.select("visit_id", "Code", "year", "after_intro")


@query
def exclude_sites(v: Views) -> DataFrame:
    return elig.exclude_values(v.baseline(), "Code", EXCLUDED_SITES).select("visit_id", "Code")


@query
def treatment_groups(v: Views) -> DataFrame:
    labelled = elig.map_groups(v.baseline(drugs=True), DRUG_GROUPS)
    flags = [f"treatment_{group}" for group in DRUG_GROUPS]
    return elig.keep_groups(labelled, list(DRUG_GROUPS)).select("visit_id", "treatment_group", *flags)


@query
def treatment_groups_untrimmed(v: Views) -> DataFrame:
    labelled = elig.map_groups(v.baseline(drugs=True), DRUG_GROUPS, trim=False, flags=False)
    return labelled.groupBy("treatment_group").agg(F.count(F.lit(1)).alias("n"))


@query
def cohort_flow(v: Views) -> DataFrame:
    outcome = visits.outcome_in_window(v.visits()).select(*visits.COURSE, "has_remission_cdai")
    rows = elig.override_by_site(
        v.baseline(drugs=True), "extraction_date_calc", "extraction_date", EXTRACTION_OVERRIDES
    )
    rows = elig.map_groups(rows, DRUG_GROUPS, flags=False).join(outcome, list(visits.COURSE), "left")
    steps = {
        "outcome known": F.col("has_remission_cdai").isNotNull(),
        "starts by the site cutoff": ~elig.is_in(F.col("Code"), [CUTOFF_SITE])
        | (F.col("ttt_startDate") <= F.col("extraction_date_calc")),
        "disease": F.col("disease") == "ra",
        "site not excluded": elig.not_in(F.col("Code"), EXCLUDED_SITES),
        "drug group known": F.col("treatment_group").isNotNull(),
    }
    return elig.cohort_flow(rows, steps)


# --- profiling and encoding


def _features(v: Views) -> DataFrame:
    """The feature table, written once, for queries that read it more than once."""
    return cut_lineage(v.features())


@query
def cardinality_profile(v: Views) -> DataFrame:
    return profile.profile_cardinality(_features(v))


@query
def prune_columns(v: Views) -> DataFrame:
    return profile.prune_columns(profile.drop_types(v.features()))


@query
def fill_missing_level(v: Views) -> DataFrame:
    return encode.fill_missing_level(v.features(), CATEGORICAL).select("row_id", *CATEGORICAL)


@query
def level_table(v: Views) -> DataFrame:
    return profile.level_table(encode.fill_missing_level(v.features(), CATEGORICAL), CATEGORICAL)


@query
def one_hot(v: Views) -> DataFrame:
    filled = encode.fill_missing_level(_features(v), CATEGORICAL).select("row_id", *CATEGORICAL)
    return encode.one_hot(filled, CATEGORICAL)


@query
def ordinal_encode(v: Views) -> DataFrame:
    columns = ["four", "ten_null", "segment", "treatment_group"]
    return encode.ordinal_encode(encode.cast_bools(_features(v)), columns).select("row_id", "every_third", *columns)


@query
def nan_to_null(v: Views) -> DataFrame:
    return encode.nan_to_null(v.features()).select("row_id", "price", "HAQ0", "CDAI0")


@query
def null_counts(v: Views) -> DataFrame:
    return profile.null_counts(v.features())


@query
def distinct_sites(v: Views) -> DataFrame:
    return profile.distinct_values(v.baseline(), "Code")


@query
def binary_target(v: Views) -> DataFrame:
    return encode.binary_target(v.features(), "CDAI_response").select("row_id", "CDAI_response")


@query
def feature_matrix(v: Views) -> DataFrame:
    names = ["HAQ0", "CDAI0", "Weight", "Height", "price", "four"]
    matrix = encode.assemble(encode.nan_to_null(v.features()), names)
    return matrix.select("row_id", *[F.get("features", F.lit(i)).alias(f"x{i}") for i in range(len(names))])


@query
def aligned_features(v: Views) -> DataFrame:
    features = _features(v)
    encoded = encode.ordinal_encode(features, ["segment"]).select("row_id", F.col("segment").alias("segment_code"))
    return encode.align(features.select("row_id", "segment"), encoded)


@query
def aligned_row_counts(v: Views) -> DataFrame:
    features = _features(v)
    return encode.unmatched_rows(features.select("row_id"), encode.nan_to_null(features).select("row_id"))


@query
def feature_subset_top(v: Views) -> DataFrame:
    filled = encode.fill_missing_level(_features(v), ["segment", "p_type"])
    encoded = encode.one_hot(filled, ["segment", "p_type"])
    return encode.feature_subset(encoded, ["HAQ0", "CDAI0", "segment", "Pain"], ["row_id", "CDAI_response"])


@query
def near_zero_variance(v: Views) -> DataFrame:
    return profile.near_zero_var(_features(v), [*NUMERIC, "constant", "all_null", "priority"])


# --- split and reports


@query
def site_split_counts(v: Views) -> DataFrame:
    return split.site_split_counts(v.features(), HOLD_OUT)


@query
def stratified_split(v: Views) -> DataFrame:
    return v.scored().select("row_id", "y", "split")


@query
def stratified_folds(v: Views) -> DataFrame:
    return split.stratified_folds(v.orders_with_site().select("row_id", "y"), "y", "row_id", "7204", 5)


@query
def outcome_freq_by_split(v: Views) -> DataFrame:
    return report.freq_table(v.split_features(), "CDAI_response", ["split"])


@query
def baseline_flag_freq(v: Views) -> DataFrame:
    flagged = report.flag_at_most(v.scored(), "CDAI0", 2.8, "baseline_remission")
    return report.freq_table(flagged, "baseline_remission", ["split"])


@query
def missingness_by_split(v: Views) -> DataFrame:
    return report.missingness(v.split_features(), [*NUMERIC, *CATEGORICAL, "all_null"])


@query
def table_one_continuous(v: Views) -> DataFrame:
    table = report.table_one_continuous(v.split_features(), ["HAQ0", "CDAI0", "Weight", "Height", "price", "eleven"])
    return table.drop("p_value").withColumns({name: F.round(name, 4) for name in ("mean", "sd")})


@query
def table_one_categorical(v: Views) -> DataFrame:
    return report.table_one_categorical(v.split_features(), [*CATEGORICAL, "four"]).drop("p_value")


@query
def table_one_p_values(v: Views) -> DataFrame:
    rows = cut_lineage(v.split_features())
    means = report.table_one_continuous(rows, ["HAQ0", "CDAI0", "Weight"]).select("variable", "p_value")
    levels = report.table_one_categorical(rows, CATEGORICAL).select("variable", "p_value")
    return means.unionByName(levels).distinct()


# --- metrics on a given score


@query
def confusion_by_split(v: Views) -> DataFrame:
    return metrics.confusion(metrics.classify(v.scored(), GIVEN_THRESHOLD), by=["split"])


@query
def class_metrics_by_split(v: Views) -> DataFrame:
    return metrics.class_metrics(metrics.confusion(metrics.classify(v.scored(), GIVEN_THRESHOLD), by=["split"]))


@query
def auc_by_split(v: Views) -> DataFrame:
    return metrics.auc(v.scored(), by=["split"])


@query
def roc_points(v: Views) -> DataFrame:
    return metrics.roc_points(v.scored(), by=["split"])


def _train_threshold(roc: DataFrame):
    return metrics.youden_threshold(roc.where("split = 'train'"), ["split"]).select("threshold").scalar()


@query
def youden_threshold(v: Views) -> DataFrame:
    return metrics.youden_threshold(metrics.roc_points(v.scored(), by=["split"]), ["split"])


@query
def operating_point(v: Views) -> DataFrame:
    roc = metrics.roc_points(v.scored(), by=["split"])
    return metrics.operating_points(roc, _train_threshold(roc))


@query
def binarised_roc(v: Views) -> DataFrame:
    scored = v.scored()
    threshold = _train_threshold(metrics.roc_points(scored, by=["split"]))
    labelled = metrics.classify(scored, threshold)
    return metrics.roc_points(labelled, score="pred", by=["split"])


@query
def binarised_operating_point(v: Views) -> DataFrame:
    """The point of the binarised curve whose FPR is nearest to the one at the training threshold."""
    scored = v.scored()
    roc = metrics.roc_points(scored, by=["split"])
    threshold = _train_threshold(roc)
    points = metrics.operating_points(roc, threshold).select("split", F.col("fpr").alias("wanted"))
    labelled = metrics.roc_points(metrics.classify(scored, threshold), score="pred", by=["split"])
    # One row per split.
    near = metrics.nearest_point(labelled.join(F.broadcast(points), "split"), "fpr", F.col("wanted"), ["split"])
    return near.select("split", "threshold", "tpr", "fpr")


@query
def subgroup_metrics(v: Views) -> DataFrame:
    """Per group at the training threshold; in one group the label has a single class.

    Threshold, cells and areas all come from one table of counts.
    """
    beyond = F.col("split") != "train"
    one_class = F.when(beyond & (F.col("grp") == "5-LOW"), F.lit(0)).otherwise(F.col("y")).cast("bigint")
    counts = with_buckets(score_counts(v.scored().withColumn("y", one_class), "y", "p", ["split", "grp"]))
    roc = metrics.roc_of(metrics.pooled(counts.where(~beyond), ["split"]), ["split"])
    return metrics.subgroup_metrics_of(counts.where(beyond & F.col("grp").isNotNull()), _train_threshold(roc), ["split", "grp"])


@query
def sensitivity_subset_metrics(v: Views) -> DataFrame:
    scored = v.scored()
    threshold = _train_threshold(metrics.roc_points(scored, by=["split"]))
    rows = metrics.sensitivity_subset(scored).where("split <> 'train'")
    cells = metrics.class_metrics(metrics.confusion(metrics.classify(rows, threshold), by=["split"]))
    areas = metrics.auc(rows, by=["split"]).select("split", "auc")
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return cells.join(areas, "split").select("split", n.alias("n"), "auc", "tp", "fp", "fn", "tn", "f1", "f1_neg")


@query
def auc_bootstrap_ci(v: Views) -> DataFrame:
    return auc_ci(v.scored())


# --- attributions given in long form


@query
def shap_mean_abs(v: Views) -> DataFrame:
    return explain.mean_abs_shap(v.shap_given())


@query
def shap_top10(v: Views) -> DataFrame:
    return explain.top_variables(v.shap_given())


@query
def shap_top10_long(v: Views) -> DataFrame:
    return explain.top_shap_long(v.shap_given())


@query
def shap_top10_by_group(v: Views) -> DataFrame:
    return explain.top_by_group(v.shap_given(), v.row_groups())


# --- evaluation bundle on a given score


@query
def evaluation_bundle(v: Views) -> DataFrame:
    return evaluate(v.scored())


@query
def evaluation_summary(v: Views) -> DataFrame:
    return summary_rows(evaluate(v.scored()))


@query
def evaluation_with_interval(v: Views) -> DataFrame:
    return summary_rows(evaluate(v.scored(), reps=REPLICATES))


# --- trained models

MODEL_FEATURES = [
    "CDAI0",
    "k7",
    "month",
    "price",
    "Weight",
    "treatment_group.1-URGENT",
    "treatment_group.2-HIGH",
    "treatment_group.3-MEDIUM",
    "treatment_group.4-NOT SPECIFIED",
    "treatment_group.5-LOW",
]
SMALL_MODEL = BoostParams(eta=0.3, max_depth=3, colsample_bytree=0.8, subsample=0.8)
SMALL_ROUNDS = 4


def _training(v: Views) -> DataFrame:
    """Training table, written once: edges, rows, scores and attributions all read it."""
    return stored(v.training())


def _small_trees(rows: DataFrame) -> DataFrame:
    return fit_boost(rows.where("split = 'train'"), MODEL_FEATURES, "y", "row_id", SMALL_MODEL, SMALL_ROUNDS)


@query
def boost_root_split(v: Views) -> DataFrame:
    stump = BoostParams(eta=0.3, max_depth=1)
    trees = fit_boost(_training(v).where("split = 'train'"), MODEL_FEATURES, "y", "row_id", stump, 1)
    return trees.drop("model_id", "tree")


@query
def stump_attributions(v: Views) -> DataFrame:
    """Scores and attributions of the one-split model, simple enough to restate in SQL."""
    rows = _training(v)
    stump = BoostParams(eta=0.3, max_depth=1)
    trees = cut_lineage(fit_boost(rows.where("split = 'train'"), MODEL_FEATURES, "y", "row_id", stump, 1))
    scored = predict(rows, trees, MODEL_FEATURES)
    long = shap_long(scored, trees, MODEL_FEATURES, keep=["row_id", "p"])
    return long.drop("rfvalue")


@query
def boost_trees(v: Views) -> DataFrame:
    return _small_trees(_training(v))


@query
def boost_full_trees(v: Views) -> DataFrame:
    """The model at its full size: 150 rounds of depth 9."""
    rows = _training(v).where("split = 'train'")
    return fit_boost(rows, MODEL_FEATURES, "y", "row_id", DEFAULT_PARAMS, DEFAULT_ROUNDS)


@query
def boost_predict(v: Views) -> DataFrame:
    rows = _training(v)
    return predict(rows, _small_trees(rows), MODEL_FEATURES, keep=["row_id", "split", "y"])


@query
def boost_evaluation(v: Views) -> DataFrame:
    rows = _training(v)
    return evaluate(predict(rows, _small_trees(rows), MODEL_FEATURES, keep=["row_id", "split", "y"]))


@query
def tune_best(v: Views) -> DataFrame:
    grid = param_grid(
        eta=[0.1, 0.3],
        max_depth=[2, 3],
        gamma=[0.0],
        colsample_bytree=[0.8],
        min_child_weight=[1.0],
        subsample=[0.8],
        nrounds=[2, 4],
    )
    rows = _training(v).where("split = 'train'")
    return best_params(tune(rows, MODEL_FEATURES, "y", "row_id", grid, folds=3, early_stop=2))


@query
def shap_long_model(v: Views) -> DataFrame:
    rows = _training(v)
    return shap_scaled(shap_wide(rows, _small_trees(rows), MODEL_FEATURES, keep=["row_id"]), MODEL_FEATURES)


@query
def shap_adds_up(v: Views) -> DataFrame:
    rows = _training(v)
    trees = _small_trees(rows)
    expected = expected_margin(collect_trees(trees, MODEL_FEATURES), SMALL_MODEL.base_score)
    scored = predict(rows, trees, MODEL_FEATURES)
    gap = margin_gap(shap_wide(scored, trees, MODEL_FEATURES, keep=["row_id", "p"]), expected)
    return gap.select("n_rows", (F.col("max_gap") < 1e-6).cast("bigint").alias("adds_up"))


@query
def shap_high_score_mean(v: Views) -> DataFrame:
    rows = _training(v)
    shap = shap_long(metrics.sensitivity_subset(rows).where("split = 'train'"), _small_trees(rows), MODEL_FEATURES)
    return explain.mean_abs_shap(shap)


@query
def shap_model_top_by_group(v: Views) -> DataFrame:
    rows = _training(v)
    kept = ["row_id", "treatment_group"]
    shap = shap_long(rows.where("split = 'train'"), _small_trees(rows), MODEL_FEATURES, keep=kept)
    return explain.rank_by_group(shap)
