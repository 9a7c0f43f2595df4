"""What a table looks like: feature roles, value constraints and default settings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FeatureSpec:
    """Column roles. ``features`` keeps the order in which they are reported."""

    key: str
    features: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    target: str | None = None

    @property
    def numeric(self) -> tuple[str, ...]:
        return tuple(f for f in self.features if f not in self.categorical)

    @property
    def columns(self) -> tuple[str, ...]:
        return self.features + ((self.target,) if self.target else ())


@dataclass(frozen=True)
class Constraint:
    """Accepted values of one request field; a bound left out is not checked."""

    field: str
    ge: float | None = None
    gt: float | None = None
    le: float | None = None
    integer: bool = False


# The columns of the housing data and the ranges a request may hold.
HOUSING = FeatureSpec(
    key="row_id",
    features=(
        "CRIM", "ZN", "INDUS", "CHAS", "NOX", "RM", "AGE",
        "DIS", "RAD", "TAX", "PTRATIO", "B", "LSTAT",
    ),
    categorical=("CHAS",),
    target="MEDV",
)

HOUSING_CONSTRAINTS = (
    Constraint("CRIM", ge=0),
    Constraint("ZN", ge=0, le=100),
    Constraint("INDUS", ge=0, le=100),
    Constraint("CHAS", ge=0, le=1, integer=True),
    Constraint("NOX", ge=0, le=1),
    Constraint("RM", ge=1, le=15),
    Constraint("AGE", ge=0, le=100),
    Constraint("DIS", gt=0),
    Constraint("RAD", ge=1, le=24, integer=True),
    Constraint("TAX", ge=0),
    Constraint("PTRATIO", ge=0),
    Constraint("B", ge=0, le=400),
    Constraint("LSTAT", ge=0, le=100),
)

# Settings and thresholds.
TEST_SIZE = 0.2
SEED = 42
CV_SPLITS = 5
OVERFIT_R2_GAP = 0.1
OVERFIT_RMSE_GAP = 0.15
TOLERANCE = 0.10
BATCH_MAX_ITEMS = 100
CURRENCY = "$"
PRICE_MULTIPLIER = 1000.0
ALIASES = ("champion", "challenger")
CHAMPION_WEIGHT = 0.5

# Upper bounds of the monitoring histograms.
REQUEST_SECONDS_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
PREDICTION_SECONDS_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5)
PREDICTION_VALUE_BUCKETS = (5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0, 45.0, 50.0)

# Hyperparameters a run may be configured with.
HYPERPARAMETER_BOUNDS = (
    # model, parameter, integer, low, high
    ("random_forest", "n_estimators", True, 10, 500),
    ("random_forest", "max_depth", True, 1, 50),
    ("random_forest", "min_samples_split", True, 2, 20),
    ("random_forest", "min_samples_leaf", True, 1, 10),
    ("gradient_boost", "n_estimators", True, 10, 500),
    ("gradient_boost", "learning_rate", False, 0.01, 1.0),
    ("gradient_boost", "max_depth", True, 1, 20),
    ("gradient_boost", "min_samples_split", True, 2, 20),
    ("xgboost", "n_estimators", True, 10, 500),
    ("xgboost", "learning_rate", False, 0.01, 1.0),
    ("xgboost", "max_depth", True, 1, 20),
    ("xgboost", "subsample", False, 0.5, 1.0),
)
