"""The whole analysis as one composition of operators: cohort, model, explanation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import col
from ..models.boost import fit_boost
from ..models.params import (
    CV_FOLDS,
    DEFAULT_PARAMS,
    DEFAULT_ROUNDS,
    EARLY_STOPPING,
    GRID,
    INITIAL_PARAMS,
    INITIAL_ROUNDS,
    BoostParams,
    param_grid,
)
from ..models.predict import predict
from ..models.shap import long_form, shap_long, shap_wide
from ..models.tune import chosen_params, tune
from ..operators import correction as corr
from ..operators import eligibility as elig
from ..operators import checks, encode, explain, metrics, profile, report, split, visits
from ..operators.evaluate import evaluate, summary_rows, train_threshold
from ..session import bucketed, cut_lineage
from ..sources.tables import ExportConfig, append_metrics, export, save_model

# Sites, dates, years and drugs of the registry study.
EXTERNAL_SITES = ["CH"]
EXCLUDED_SITES = ["DE", "SP", "TR", "UK"]
EXTRACTION_OVERRIDES = {"IT": "2023-12-01", "NO": "2021-01-01"}
CUTOFF_SITE = "NO"
INTRODUCTION_YEARS = {
    "AU": 2017, "CA": 2014, "CH": 2013, "CZ": 2018, "DE": 2017, "FI": 2017, "GR": 2018, "IL": 2014, "IT": 2014,
    "NO": 2017, "PT": 2017, "RO": 2017, "RU": 2013, "SI": 2017, "SP": 2017, "TR": 2014, "UK": 2017,
}
DRUG_GROUPS = {
    "TNFi": ["adalimumab", "certolizumab", "etanercept", "golimumab", "infliximab", "atnf"],
    "JAKi": ["baricitinib", "filgotinib", "tofacitinib", "upadacitinib"],
    "IL6": ["sarilumab ", "tocilizumab"],
    "ABA": ["abatacept"],
    "RITX": ["rituximab"],
}

CORRECTED_SITE = "CH"
VISIT_COLUMNS = ["ID", "ttt_course", "visit_id", "Visit_date", "ttt_startDate", "CDAI"]
BASELINE_COLUMNS = [
    "ID", "ttt_course", "ID_original", "Visit_date", "Code", "disease", "year", "generic_name", "ttt_startDate",
    "ttt_stopDate", "lostFUDate", "extraction_date", "Weight", "Height", "HAQ0", "CDAI0",
]

TARGET = "CDAI_response"
GROUP = "treatment_group"
SCORE = "CDAI0"


@dataclass(frozen=True)
class StudySettings:
    row_id: str = "row_id"
    external_sites: Sequence[str] = tuple(EXTERNAL_SITES)
    excluded_sites: Sequence[str] = tuple(EXCLUDED_SITES)
    extraction_overrides: Mapping[str, str] = field(default_factory=lambda: EXTRACTION_OVERRIDES)
    cutoff_site: str = CUTOFF_SITE
    introduction_years: Mapping[str, int] = field(default_factory=lambda: INTRODUCTION_YEARS)
    drug_groups: Mapping[str, Sequence[str]] = field(default_factory=lambda: DRUG_GROUPS)
    encoded_columns: Sequence[str] = tuple(encode.ENCODED_COLUMNS)
    excluded_columns: Sequence[str] = tuple(profile.EXCLUDED_COLUMNS)
    base_variables: Sequence[str] | None = None
    include_baseline_flag: bool = False
    run_tuning: bool = True
    grid: Mapping[str, Sequence] = field(default_factory=lambda: GRID)
    folds: int = CV_FOLDS
    early_stop: int = EARLY_STOPPING
    initial: tuple[BoostParams, int] = (INITIAL_PARAMS, INITIAL_ROUNDS)
    default: tuple[BoostParams, int] = (DEFAULT_PARAMS, DEFAULT_ROUNDS)
    replicates: int = 1000
    seed: int = 7202
    corrected_site: str = CORRECTED_SITE
    output: ExportConfig = field(default_factory=ExportConfig)


def build_cohort(
    visit_table: DataFrame, baseline: DataFrame, correction: DataFrame | None, settings: StudySettings
) -> tuple[DataFrame, DataFrame]:
    """Corrected, de-duplicated baseline rows with outcome and covariates; and the cohort flow."""
    rows = corr.apply_correction(corr.dedup_baseline(baseline, correction), correction)
    outcome = visits.outcome_in_window(visit_table).select(
        *visits.COURSE, F.col("has_remission_cdai").alias("CDAI24_10")
    )
    rows = rows.join(outcome, list(visits.COURSE), "left")
    rows = elig.override_by_site(rows, "extraction_date_calc", "extraction_date", settings.extraction_overrides)
    rows = elig.bmi(elig.treatment_duration(rows))
    rows = elig.after_introduction(rows, settings.introduction_years)
    rows = elig.map_groups(rows, settings.drug_groups)
    at_cutoff_site = elig.is_in(F.col("Code"), [settings.cutoff_site])
    steps = {
        "outcome known": F.col("CDAI24_10").isNotNull(),
        "starts by the site cutoff": ~at_cutoff_site | (F.col("ttt_startDate") <= F.col("extraction_date_calc")),
        "disease": F.col("disease") == "ra",
        "site not excluded": elig.not_in(F.col("Code"), settings.excluded_sites),
        "drug group known": F.col(GROUP).isNotNull(),
    }
    kept = F.lit(True)
    for condition in steps.values():
        kept = kept & condition
    cohort = encode.binary_target(rows.where(kept).withColumn(TARGET, F.col("CDAI24_10")), TARGET)
    return cohort, elig.cohort_flow(rows, steps)


def prepare(cohort: DataFrame, settings: StudySettings) -> tuple[DataFrame, DataFrame]:
    """Readable rows and encoded rows, both with their split, aligned by row id.

    The cohort is written once to the checkpoint folder: profiling, levels, split and both
    tables all read it again.  Both tables are bucketed by row id, so joins of them need no exchange, and their
    rows are counted and compared in the passes that write them.
    """
    keys = [settings.row_id, "Code", TARGET]
    excluded = [name for name in settings.excluded_columns if name not in keys]
    readable = cut_lineage(profile.prune_columns(profile.drop_types(cohort), excluded))
    hold_out = split.HoldOut("Code", settings.external_sites)
    facts = checks.row_facts([settings.row_id, "split"])
    by_row = partial(bucketed, key=settings.row_id)
    seen = checks.watch(split.assign_split(readable, TARGET, settings.row_id, str(settings.seed), hold_out), facts, by_row)
    readable = seen.table

    one_hot = [name for name in settings.encoded_columns if name in readable.columns]
    kinds = profile.classify_columns(readable.drop(*keys, "split", *one_hot))
    logical = {f.name for f in readable.schema.fields if isinstance(f.dataType, T.BooleanType)}
    ordinal = [name for name, kind in kinds.items() if kind == "categorical" and name not in logical]
    filled = encode.cast_bools(encode.fill_missing_level(readable, one_hot))
    levels = encode.collect_levels(filled, [*one_hot, *ordinal])
    single = [name for name in one_hot if len(levels[name]) < 2]
    encoded = encode.one_hot(encode.ordinal_encode(filled, ordinal, levels), one_hot, levels).drop(*single)
    finished = checks.watch(encode.nan_to_null(encoded), facts, by_row)
    checks.same_rows(seen, finished)
    return readable, finished.table


def candidates(encoded: DataFrame, settings: StudySettings) -> list[str]:
    """Columns that may be features: all, or those of the reduced set."""
    keys = {settings.row_id, "Code", TARGET, "split"}
    names = [name for name in encoded.columns if name not in keys]
    return names if settings.base_variables is None else encode.expand_features(names, settings.base_variables)


def feature_names(encoded: DataFrame, settings: StudySettings) -> list[str]:
    """Model features, near-constant ones on the training rows left out."""
    names = candidates(encoded, settings)
    dropped = set(profile.near_zero_names(encoded.where("split = 'train'"), names))
    return [name for name in names if name not in dropped]


def audit(
    visit_table: DataFrame, baseline: DataFrame, correction: DataFrame | None, cohort: DataFrame, settings: StudySettings
) -> dict[str, DataFrame]:
    """What the steps before the model changed or left out."""
    labels = visits.remission_groups(visit_table)
    tables = {
        "remission_groups": labels,
        "remission_group_counts": labels.groupBy("remission_group").agg(F.count(F.lit(1)).alias("n")),
        "rows_without_site": split.unassigned_rows(cohort, "Code"),
    }
    if correction is not None:
        corrected = corr.apply_correction(corr.dedup_baseline(baseline, correction), correction, keep_original=True)
        tables["correction_count"] = corr.correction_count(corrected, settings.corrected_site)
        tables["correction_pairs"] = corr.pair_audit(correction)
    return tables


def curves(scored: DataFrame, threshold) -> dict[str, DataFrame]:
    """ROC curves per split, of the scores and of the labels at the training threshold, with their points."""
    roc = metrics.roc_points(scored, TARGET, by=["split"])
    points = metrics.operating_points(roc, threshold)
    binarised = metrics.roc_points(metrics.classify(scored, threshold), TARGET, score="pred", by=["split"])
    # One row per split.
    wanted = F.broadcast(points.select("split", F.col("fpr").alias("wanted")))
    nearest = metrics.nearest_point(binarised.join(wanted, "split"), "fpr", F.col("wanted"), ["split"])
    return {"roc": roc, "operating_points": points, "binarised_roc": binarised, "binarised_point": nearest}


def write_results(results: Mapping[str, DataFrame], params: BoostParams, rounds: int, settings: StudySettings) -> None:
    """Everything the output settings allow: tables, metrics of the run, the model."""
    for name, found in results.items():
        export(found, name, settings.output)
    for stage in ("initial_evaluation", "evaluation", "sensitivity", "subgroups"):
        append_metrics(stage, results[stage], settings.output)
    save_model(results["trees"], {**asdict(params), "nrounds": rounds}, f"{settings.output.folder}/model", settings.output)


def run_study(
    visit_table: DataFrame, baseline: DataFrame, correction: DataFrame | None, settings: StudySettings
) -> dict[str, DataFrame]:
    """All result tables of the study; written too as far as ``settings.output`` allows."""
    encode.require_columns(visit_table, VISIT_COLUMNS)
    encode.require_columns(baseline, [settings.row_id, *BASELINE_COLUMNS])
    cohort, flow = build_cohort(visit_table, baseline, correction, settings)
    readable, encoded = prepare(cohort, settings)
    if settings.include_baseline_flag:
        encoded = report.flag_at_most(encoded, SCORE, visits.REMISSION, "baseline_remission")
    row_id = settings.row_id
    features = feature_names(encoded, settings)
    flagged = report.flag_at_most(readable, SCORE, visits.REMISSION, "baseline_remission")
    described = [c for c in readable.columns if c not in (row_id, "split")]
    kinds = profile.classify_columns(readable.select(*[col(c) for c in described]))
    results = {
        "cohort_flow": flow,
        **audit(visit_table, baseline, correction, cohort, settings),
        "cardinality": profile.profile_cardinality(readable),
        "levels": profile.level_table(readable, [c for c in described if kinds[c] == "categorical"]),
        "near_zero_variance": profile.near_zero_var(encoded.where("split = 'train'"), candidates(encoded, settings)),
        "outcome": report.freq_table(readable, TARGET, ["split"]),
        "baseline_remission": report.freq_table(flagged, "baseline_remission", ["split"]),
        "missingness": report.missingness(readable, described),
        "table_one_continuous": report.table_one_continuous(readable, [c for c in described if kinds[c] == "continuous"]),
        "table_one_categorical": report.table_one_categorical(
            readable, [c for c in described if kinds[c] == "categorical"]
        ),
    }

    train = encoded.where("split = 'train'")
    keep = [row_id, TARGET, "split"]
    first_trees = fit_boost(train, features, TARGET, row_id, *settings.initial, settings.seed)
    first = predict(train, first_trees, features, keep=keep)
    results["initial_evaluation"] = evaluate(first, TARGET)
    first_shap = shap_long(train, first_trees, features, keep=[row_id])
    results["initial_shap_top"] = explain.top_variables(first_shap)

    params, rounds = settings.default
    if settings.run_tuning:
        results["tuning"] = tune(
            train, features, TARGET, row_id, param_grid(**settings.grid), settings.folds, settings.early_stop
        )
        params, rounds = chosen_params(results["tuning"])
    trees = fit_boost(train, features, TARGET, row_id, params, rounds, settings.seed)
    # One scored frame with the readable group and baseline score serves all later tables.  Rows meet their
    # facts before they are scored, while both tables still lie in buckets by row id.
    facts = readable.select(row_id, GROUP, F.col(SCORE).alias("baseline_score"))
    scored = predict(encode.align(encoded, facts, row_id), trees, features, base_score=params.base_score, keep=[*keep, GROUP, "baseline_score"])
    scored = cut_lineage(scored.withColumnRenamed("baseline_score", SCORE))
    threshold = train_threshold(metrics.ranked_scores(scored, TARGET, by=["split"]))
    results |= curves(scored, threshold)
    results["trees"] = trees
    results["scored"] = scored
    results["evaluation"] = evaluate(scored, TARGET, reps=settings.replicates)
    results["summary"] = summary_rows(results["evaluation"])

    beyond = scored.where("split <> 'train'")
    results["sensitivity"] = metrics.class_metrics(
        metrics.confusion(metrics.classify(metrics.sensitivity_subset(beyond, SCORE), threshold), TARGET, by=["split"])
    ).join(metrics.auc(metrics.sensitivity_subset(beyond, SCORE), TARGET, by=["split"]).select("split", "auc"), "split")
    results["subgroups"] = metrics.subgroup_metrics(beyond, threshold, GROUP, TARGET, by=["split"])

    # Attributions are kept as one array per row, with the group and score later steps ask for.
    labelled = encode.align(train, facts, row_id)
    wide = cut_lineage(shap_wide(labelled, trees, features, keep=[row_id, GROUP, "baseline_score"]))
    shap = long_form(wide, features)
    results["shap_top"] = explain.top_variables(shap)
    results["shap_subset"] = metrics.sensitivity_subset(shap, "baseline_score")
    results["shap_high_score"] = explain.mean_abs_shap(metrics.sensitivity_subset(shap, "baseline_score"))
    results["shap_top_by_group"] = explain.rank_by_group(shap, GROUP)
    write_results(results, params, rounds, settings)
    return results
