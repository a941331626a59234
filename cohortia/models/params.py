"""Boosting settings."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class BoostParams:
    """Second-order boosting of logistic loss.

    The gain of a split is GL^2/(HL+lambda) + GR^2/(HR+lambda) - G^2/(H+lambda), without the
    factor one half; a split needs a gain of at least ``gamma``.  Scores start at ``base_score``.
    """

    eta: float = 0.3
    max_depth: int = 6
    gamma: float = 0.0
    colsample_bytree: float = 1.0
    min_child_weight: float = 1.0
    subsample: float = 1.0
    reg_lambda: float = 1.0
    base_score: float = 0.5

    def row(self) -> dict:
        return asdict(self)


# The first fit, and the fit used when tuning is off.
INITIAL_PARAMS = BoostParams(eta=0.01, max_depth=6, subsample=0.7, colsample_bytree=0.7)
INITIAL_ROUNDS = 100
DEFAULT_PARAMS = BoostParams(
    eta=0.05, max_depth=9, gamma=0.0, colsample_bytree=0.5, min_child_weight=5.0, subsample=1.0
)
DEFAULT_ROUNDS = 150

# The tuning grid, first name varying fastest.
GRID = {
    "eta": [0.01, 0.05, 0.1],
    "max_depth": [3, 6, 9],
    "gamma": [0.0, 0.1, 0.2],
    "colsample_bytree": [0.5, 0.8],
    "min_child_weight": [1.0, 3.0, 5.0],
    "subsample": [0.6, 0.8, 1.0],
    "nrounds": [50, 100, 150],
}
CV_FOLDS = 5
EARLY_STOPPING = 10


def param_grid(**lists: Sequence) -> list[dict]:
    """Every combination of the given values, numbered from 1, the first name varying fastest."""
    names = list(lists)
    combinations = itertools.product(*[lists[name] for name in reversed(names)])
    return [
        {"grid_id": i, **dict(zip(names, reversed(values), strict=True))} for i, values in enumerate(combinations, 1)
    ]
