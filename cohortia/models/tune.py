"""Cross-validated grid search with early stopping.

Grid points that differ in the number of rounds alone are prefixes of one fit, and all folds of
several fits are grown in one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import auc_of
from ..operators.rank import running_counts, with_buckets
from ..operators.split import stratified_folds
from ..session import cut_lineage
from .binning import MAX_BINS, bin_edges
from .boost import REFRESH_ROUNDS, Boosting, Fit
from .params import CV_FOLDS, EARLY_STOPPING, BoostParams

HISTOGRAM_BYTES = 256 << 20
# Each model keeps one margin of eight bytes per row.
MOST_MODELS = 120
RESULT_SCHEMA = (
    "grid_id bigint, eta double, max_depth bigint, gamma double, colsample_bytree double, min_child_weight double, "
    "subsample double, nrounds bigint, rounds_run bigint, best_round bigint, test_auc_mean double"
)


@dataclass
class Candidate:
    """One distinct fit and the mean held-out AUC of each of its rounds."""

    params: BoostParams
    rounds: int
    history: list[float] = field(default_factory=list)
    stopped: bool = False

    def best(self, rounds: int) -> tuple[int, float]:
        """Best round among the first ``rounds``, the first on ties."""
        seen = self.history[:rounds]
        top = max(seen)
        return seen.index(top) + 1, top

    def extend(self, values: Sequence[float], patience: int | None) -> None:
        """Add the next rounds; without ``patience`` a fit never stops early."""
        for value in values:
            if self.stopped or len(self.history) >= self.rounds:
                return
            self.history.append(value)
            self.stopped = bool(patience) and len(self.history) - self.best(len(self.history))[0] >= patience


def _settings(point: dict) -> BoostParams:
    return BoostParams(**{k: v for k, v in point.items() if k not in ("grid_id", "nrounds")})


def _pack_size(params: Sequence[BoostParams], features: int, folds: int, max_bins: int) -> int:
    """Fits whose histograms at the deepest level, and margins, fit into memory together."""
    deepest = max(p.max_depth for p in params)
    per_fit = folds * (1 << (deepest - 1)) * features * (max_bins + 1) * 2 * 8
    return max(1, min(HISTOGRAM_BYTES // per_fit, MOST_MODELS // folds))


def tune(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    row_id: str,
    grid: Sequence[dict],
    folds: int = CV_FOLDS,
    early_stop: int | None = EARLY_STOPPING,
    seed: int = 7204,
    max_bins: int = MAX_BINS,
) -> DataFrame:
    """Held-out AUC of every grid point: its best round and the rounds it ran.

    A fit stops once ``early_stop`` rounds brought nothing better; ``None`` runs all rounds.
    """
    if early_stop is not None and early_stop < 1:
        raise ValueError("early_stop must be at least 1, or None for all rounds")
    features = list(features)
    rows = df.where(F.col(label).isNotNull()).select(row_id, label, *[F.col(f"`{name}`") for name in features])
    folded = cut_lineage(stratified_folds(rows, label, row_id, str(seed), folds, "__fold"))
    edges = bin_edges(folded, features, label, max_bins)

    candidates: dict[BoostParams, Candidate] = {}
    for point in grid:
        params = _settings(point)
        known = candidates.setdefault(params, Candidate(params, 0))
        known.rounds = max(known.rounds, point["nrounds"])
    waiting = sorted(candidates.values(), key=lambda c: c.params.max_depth)
    while waiting:
        # Fits come in order of depth; a pack ends where the next one would make it too large.
        size = 1
        while size < len(waiting) and size < _pack_size([c.params for c in waiting[: size + 1]], len(features), folds, max_bins):
            size += 1
        pack, waiting = waiting[:size], waiting[size:]
        _grow_pack(pack, folded, features, label, row_id, folds, early_stop, seed, max_bins, edges)

    results = []
    for point in grid:
        candidate = candidates[_settings(point)]
        best_round, best = candidate.best(point["nrounds"])
        ran = min(point["nrounds"], len(candidate.history))
        shown = [point["grid_id"], *[getattr(candidate.params, n) for n in (
            "eta", "max_depth", "gamma", "colsample_bytree", "min_child_weight", "subsample"
        )]]
        results.append((*shown, point["nrounds"], ran, best_round, best))
    return df.sparkSession.createDataFrame(results, RESULT_SCHEMA)


def _grow_pack(pack, folded, features, label, row_id, folds, early_stop, seed, max_bins, edges) -> None:
    fits = [Fit(i * folds + k, c.params, k) for i, c in enumerate(pack) for k in range(folds)]
    step_rounds = early_stop or REFRESH_ROUNDS
    job = Boosting(
        folded, features, label, row_id, fits, seed, "__fold", max_bins, refresh=step_rounds, edges=edges
    )
    try:
        while any(job.active):
            left = max(c.rounds - len(c.history) for c in pack if not c.stopped)
            step = min(step_rounds, left)
            job.run(step)
            means = _round_means(job, folds)
            for i, candidate in enumerate(pack):
                if not candidate.stopped and len(candidate.history) < candidate.rounds:
                    candidate.extend([means[i, r] for r in sorted(r for j, r in means if j == i)], early_stop)
                if candidate.stopped or len(candidate.history) >= candidate.rounds:
                    job.active[i * folds : (i + 1) * folds] = [False] * folds
            if any(job.active):
                job.fold_in()
    finally:
        job.close()


def _round_means(job: Boosting, folds: int) -> dict[tuple[int, int], float]:
    """Mean held-out AUC per fit and round: one small row each."""
    keys = ["model", "round"]
    areas = auc_of(running_counts(with_buckets(job.held_out_counts()), keys), keys, "<")
    fit = F.floor(F.col("model") / folds).cast("int").alias("fit")
    rows = areas.groupBy(fit, "round").agg(F.sort_array(F.collect_list("auc")).alias("aucs")).collect()
    if any(len(row["aucs"]) < folds for row in rows):
        raise ValueError("every fold needs rows of both classes")
    return {(row["fit"], row["round"]): sum(row["aucs"]) / folds for row in rows}


def best_params(results: DataFrame) -> DataFrame:
    """The grid point with the highest mean AUC, the first on ties."""
    return results.orderBy(F.desc("test_auc_mean"), "grid_id").limit(1)


def chosen_params(results: DataFrame) -> tuple[BoostParams, int]:
    """Settings and rounds of the best grid point, for the final fit."""
    row = best_params(results).drop("rounds_run", "best_round", "test_auc_mean").first().asDict()
    rounds = row["nrounds"]
    return _settings(row), rounds
