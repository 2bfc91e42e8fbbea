"""All tunables of a run, in two frozen dataclasses."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

# The column names accepted for a role (first match wins), the
# lags of the feature panel and the column names of the integer export.
STORE_CANDIDATES = ("internal_store_id", "store_id", "pdv", "pdv_id")
PRODUCT_CANDIDATES = ("internal_product_id", "product_id", "produto", "sku")
STORE_MASTER_COLUMN = "pdv"
PRODUCT_MASTER_COLUMN = "produto"
LAGS = (1, 2, 3, 4, 8, 12, 52)
EXPORT_COLUMNS = ("pdv", "produto", "semana", "quantidade")

# Canonical names used between reading and writing.
STORE = "store_id"
PRODUCT = "product_id"
PAIR = [STORE, PRODUCT]

FEATURES = (
    "discount_mean",
    "discount_max",
    "trans_count",
    "qty_4w_sum",
    "qty_12w_mean",
    "store_week_total",
    "product_global_week",
    "time_idx",
    *(f"qty_lag_{k}" for k in LAGS),
)

# A table is broadcast by hint only when a parameter or a count proves that it
# has at most this many rows; above it the planner picks a shuffled join.
BROADCAST_MAX_ROWS = 1_000_000


# Settings that change how a run is laid out and not what it results in.
LAYOUT = ("products_per_block", "chunks_per_commit", "fit_parallelism", "train_rows_per_block", "write_dense", "write_full", "write_csv")


@dataclass(frozen=True)
class ForecastConfig:
    # Defaults that decide results.
    horizons: tuple[int, ...] = (1, 2, 3, 4, 5)
    store_chunk_size: int = 200
    product_sample_rate: float = 0.20
    extinct_weeks: int = 12
    recent_weeks: int = 4
    # The pairs whose labelled rows models learn from: at most top_pairs, fewer if pairs x weeks
    # would exceed max_panel_rows. All pairs that still sell are scored, whatever these are.
    top_pairs: int = 50_000
    max_panel_rows: int = 4_000_000
    min_capped_pairs: int = 1_000
    boost_rounds: int = 500
    early_stop_rounds: int = 30
    learning_rate: float = 0.05
    num_leaves: int = 31
    min_leaf_rows: int = 20
    min_train_rows: int = 1
    seed: int = 42

    # Choices where more than one reading is useful.
    week_anchor: str = "tuesday"  # or "monday"
    clip_base: bool = False
    missing_model: str = "base"  # or "zero"
    strict_split: bool = False
    use_model: bool = True
    # Tried in this order on text that is no ISO date.
    date_formats: tuple[str, ...] = ("yyyyMMdd", "M/d/yyyy", "MMM d, yyyy")

    # Rows that the bounds of the features' bins are read from, chosen by a hash of their keys.
    bin_sample_rows: int = 200_000

    # Physical layout only (``LAYOUT``); no effect on results.
    products_per_block: int = 20_000
    chunks_per_commit: int = 64
    fit_parallelism: int = 5
    # A block of training rows is held by one task: 31 bytes a row and horizon.
    train_rows_per_block: int = 1_000_000
    # The chunked table of every cell; without it a run holds products' values and the pairs that differ.
    write_dense: bool = False
    write_full: bool = False
    write_csv: bool = False

    def __post_init__(self) -> None:
        if self.week_anchor not in ("tuesday", "monday"):
            raise ValueError(f"week_anchor must be 'tuesday' or 'monday', got {self.week_anchor!r}")
        if self.missing_model not in ("zero", "base"):
            raise ValueError(f"missing_model must be 'zero' or 'base', got {self.missing_model!r}")
        if self.horizons != tuple(range(1, len(self.horizons) + 1)):
            raise ValueError("horizons must count up from 1 without gaps")
        if self.recent_weeks < 1:
            raise ValueError("recent_weeks must be at least 1")

    def fingerprint(self, *extra: str) -> str:
        """Short hash of what decides a run's results: the settings but for ``LAYOUT``, and the inputs."""
        settings = {k: v for k, v in asdict(self).items() if k not in LAYOUT}
        payload = json.dumps([settings, *extra], sort_keys=True)
        return hashlib.sha256(payload.encode()).hexdigest()[:16]


@dataclass(frozen=True)
class ExportConfig:
    # Defaults that decide results.
    size_cap_mb: float | None = None  # a cap drops the last chunks
    head_rows: int | None = None  # no head copy
    row_group_rows: int = 32_768
    prefer_brotli: bool = False

    # Output above this size is split over several files.
    target_file_bytes: int = 512 * 1024 * 1024
