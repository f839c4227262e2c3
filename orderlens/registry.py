"""The pre-registered family of studies and the constants that every run shares."""

from __future__ import annotations

# Fixed values.
MASTER_SEED = 20120621
FDR_ALPHA = 0.05
PLACEBO_ALPHA = 0.05
CI_LEVEL = 0.95
RECON_CELL_TOLERANCE = 0
RECON_SUBMIT_INVARIANT_TARGET = 1.0
RECON_RELIABLE_DEPTH = 5
GOLDEN_RTOL = 1e-8
RECOVERY_CI_COVERAGE_MIN = 0.90
HORIZON_GRID_EVENTS = (1, 5, 10, 20, 50, 100, 200)
CV_N_FOLDS = 5
CV_EMBARGO_EVENTS = max(HORIZON_GRID_EVENTS)
BOOTSTRAP_BLOCK_EVENTS = 100
BOOTSTRAP_N_RESAMPLES = 2000
FAMILY_ID = "study_family"


#: The registered tests, fixed before data is seen: name, metric, horizon in events (or lag in trades).
FAMILY: tuple[tuple[str, str, int | None], ...] = (
    ("ofi_contemporaneous", "coef", None),
    *((f"ofi_forward_h{h}", "coef", h) for h in HORIZON_GRID_EVENTS),
    ("queue_imbalance_next_move", "AUC", None),
    *((f"sign_autocorr_lag{h}", "autocorr", h) for h in HORIZON_GRID_EVENTS),
    ("impact_curve", "coef", None),
)

# The public sample's files.
TICKERS, SESSION, LEVELS, PRICE_UNITS = ("AAPL", "AMZN", "GOOG", "INTC", "MSFT"), "2012-06-21", 10, 10_000
