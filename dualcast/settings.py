"""Fixed defaults and the per-family parameters of the routing study."""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values ---------------------------------------------------------------------
SEED = 20260714
TARGET = 0.70
SENSITIVITY_TARGETS = (0.50, 0.90)
SPLITS = ("base_train", "router_train", "calibration", "test")
SPLIT_PERCENT = (60, 15, 10, 15)
MIN_LENGTH = 200
WINDOWS = {"daily": (7, 14, 28, 56), "hourly": (24, 48, 168), "10_minutes": (144, 288)}
RIDGE_ALPHAS = (1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0, 1000.0, 10000.0)
TREE_GRID = {
    "num_leaves": (15, 31),
    "learning_rate": (0.03, 0.05),
    "n_estimators": (300, 600),
    "feature_fraction": (0.8, 1.0),
}
TEMPERATURES = (0.02, 0.05, 0.10, 0.20, 0.50)
RESIDUAL_LAGS = (1, 4, 8, 16)
C_GRID = (0.01, 0.1, 1.0, 10.0)
BASELINE_C_GRID = (1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0, 1000.0)
FOREST_GRID = {"max_depth": (4, 8), "min_samples_leaf": (5, 20), "max_features": ("sqrt", 0.8)}
FOREST_TREES = 200
NEIGHBOURS = (5, 11, 21)
WEIGHT_ALPHAS = (0.0, 0.5, 1.0, 2.0)
WEIGHT_CAP = 5.0
ETAS = (0.001, 0.005, 0.01, 0.05)
BIAS_LIMIT = 0.5
TOLERANCE = 0.02
SAMPLE_CAP = 100_000
BOOTSTRAP_REPETITIONS = 10_000
CONFIDENCE = 0.95
FAMILYWISE_ALPHA = 0.05
MARGIN = 0.01
PROBABILITY_FLOOR = 1e-8
SMALL_SCALE = 1e-12
FOLDS = 3
# ---------------------------------------------------------------------------------------

KEYS = ("dataset_id", "series_id")
SPLIT_ORDER = {name: position for position, name in enumerate(SPLITS)}


@dataclass(frozen=True)
class Family:
    """Semantics that differ between dataset families; every operator takes them as arguments."""

    dataset_id: str
    step: str  # "hour" or "day"
    season: int
    long_context: int
    windows: tuple[int, ...]
    fold_unit: int
    fold_cap: int
    fold_reserve: int
    router_unit: int
    router_cap: int
    router_reserve: int
    rolling: int
    calendar: tuple[str, ...]


HOURLY = Family(
    "hourly_events", "hour", 24, 168, WINDOWS["hourly"],
    24, 168, 24, 12, 168, 24, 48, ("hour_of_day", "day_of_week"),
)
SUPPLIERS = Family(
    "daily_suppliers", "day", 7, 28, WINDOWS["daily"],
    7, 56, 7, 7, 56, 14, 56, ("day_of_week",),
)
DAILY = Family(
    "daily_orders", "day", 7, 28, WINDOWS["daily"],
    7, 56, 7, 7, 56, 14, 56, ("day_of_week",),
)
