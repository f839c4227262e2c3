"""The five registered studies over a table of primitives, the pooled family, and its tables.

Primitives (``features.primitives``) hold all symbols in one table. A pooled regression lags straight across
the seams of symbols and folds, in the order of symbols, folds and buckets, as the published figures do.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import registry as R
from ..functions.book import critical, normal_p
from ..schema import EstimationResult, known, results_frame
from ..series import BETWEEN, by_session
from . import estimators as E
from .buckets import binned, bucketed, with_changes
from .fdr import BenjaminiHochbergController
from .folds import PurgedWalkForwardSplitter, audit_fold
from .resample import auc_ci, block_bootstrap_ci

MIN_TRAIN, MIN_TEST, MIN_BIN = 10, 2, 5


@by_session
def pairs_contemporaneous(rows: DataFrame, bucket: int = 50) -> DataFrame:
    """symbol, bucket, x (imbalance of a bucket), y (mid change of the same bucket), row."""
    b = with_changes(bucketed(rows, bucket, ("ofi",), ("mid",)))
    known_pairs = b.filter(F.col("change").isNotNull()).select("symbol", "bucket", F.col("ofi").alias("x"), F.col("change").alias("y"))
    return E.global_rows(known_pairs, ("symbol",), "bucket")


def r_squared(pairs) -> float:
    """Squared correlation of two columns."""
    x, y = pairs[:, 0] - pairs[:, 0].mean(), pairs[:, 1] - pairs[:, 1].mean()
    bottom = (x @ x) * (y @ y)
    return float((x @ y) ** 2 / bottom) if bottom > 0 else float("nan")


@by_session
def ofi_contemporaneous(rows: DataFrame, bucket: int = 50, lags: int = 10, n_resamples: int = R.BOOTSTRAP_N_RESAMPLES) -> tuple[EstimationResult, EstimationResult]:
    """Slope of the mid change on the imbalance of the same bucket, and R2 with a block-bootstrap interval."""
    pairs = pairs_contemporaneous(rows, bucket).persist()
    slope = E.ols_hac(pairs, "y", "x", name="ofi_contemporaneous", lags=lags)
    r = known(pairs.agg(F.corr("x", "y").alias("r")).first()["r"])
    r2 = block_bootstrap_ci(pairs, ["x", "y"], r_squared, name="ofi_contemporaneous_r2", metric="R2", n_resamples=n_resamples)
    pairs.unpersist()
    r2 = replace(r2, point=None if r is None else r * r)
    return replace(slope, extra={**slope.extra, "n_obs": slope.n_obs, "r2": r2.point, "r2_ci": (r2.ci_low, r2.ci_high)}), r2


@by_session
def pairs_forward(rows: DataFrame, horizon: int) -> DataFrame:
    """symbol, row_in_symbol, x (imbalance of a bucket), y (mid change of the next), both known."""
    b = with_changes(bucketed(rows, horizon, ("ofi",), ("mid",)))
    pairs = b.filter(F.col("next_change").isNotNull()).select("symbol", "bucket", F.col("ofi").alias("x"), F.col("next_change").alias("y"))
    return pairs.withColumn("in_symbol", F.row_number().over(Window.partitionBy("symbol").orderBy("bucket")) - 1)


@by_session
def out_of_sample(pairs: DataFrame, horizon: int) -> DataFrame | None:
    """The rows of the held-out blocks, fold by fold, numbered across symbols; None if no fold is usable."""
    spark = pairs.sparkSession
    embargo = max(1, -(-R.CV_EMBARGO_EVENTS // horizon))
    splitter, rows = PurgedWalkForwardSplitter(), []
    for s, n in pairs.groupBy("symbol").count().collect():
        for f in splitter.split(n, label_horizon=1, embargo=embargo):
            if found := audit_fold(f, 1, embargo):
                raise AssertionError(f"leakage in {s} at horizon {horizon}: {found}")
            if f.n_train >= MIN_TRAIN and f.n_test >= MIN_TEST:
                rows.append((s, f.fold, f.test_lo, f.test_hi))
    if not rows:
        return None
    bounds = spark.createDataFrame(rows, "symbol string, fold int, lo long, hi long")
    held = pairs.join(bounds, "symbol").filter((F.col("in_symbol") >= F.col("lo")) & (F.col("in_symbol") < F.col("hi")))
    return E.global_rows(held.select("symbol", "fold", "bucket", "x", "y"), ("symbol", "fold"), "bucket")


@by_session
def ofi_forward(rows: DataFrame, horizons: Sequence[int] = R.HORIZON_GRID_EVENTS) -> list[EstimationResult]:
    """Out-of-sample slope of the next bucket's mid change on this one's imbalance, a test for each horizon."""
    out = []
    for h in horizons:
        held = out_of_sample(pairs_forward(rows, h), h)
        if held is None:
            continue
        held = held.persist()
        slope = E.ols_hac(held, "y", "x", name=f"ofi_forward_h{h}", lags=min(2 * h, 50))
        ic = E.information_coefficient(held, "x", "y", name=f"ofi_forward_ic_h{h}", method="spearman")
        held.unpersist()
        out.append(replace(slope, extra={**slope.extra, "horizon": h, "n_obs": slope.n_obs, "oos": True, "oos_ic": ic.point, "oos_ic_ci": (ic.ci_low, ic.ci_high)}))
    return out


@by_session
def pairs_queue(rows: DataFrame, bucket: int = 20) -> DataFrame:
    """symbol, bucket, score (imbalance at a close), label (1: the next bucket's mid rises), row; no move, no row."""
    b = with_changes(bucketed(rows, bucket, (), ("mid", "queue_imbalance")))
    moved = b.filter(F.col("queue_imbalance_close").isNotNull() & (F.col("next_change") != 0))
    pairs = moved.select("symbol", "bucket", F.col("queue_imbalance_close").alias("score"), (F.col("next_change") > 0).cast("int").alias("label"))
    return E.global_rows(pairs, ("symbol",), "bucket")


@by_session
def queue_imbalance(rows: DataFrame, bucket: int = 20, n_resamples: int = R.BOOTSTRAP_N_RESAMPLES) -> EstimationResult:
    """AUC of queue imbalance for the sign of the next move, with a stationary block bootstrap."""
    pairs = pairs_queue(rows, bucket).persist()
    out = auc_ci(pairs, "score", "label", name="queue_imbalance_next_move", n_resamples=n_resamples, block=R.BOOTSTRAP_BLOCK_EVENTS)
    pairs.unpersist()
    return replace(out, extra={**out.extra, "n_obs": out.n_obs})


@by_session
def sign_series(rows: DataFrame, least: int = max(R.HORIZON_GRID_EVENTS) + 10) -> DataFrame:
    """symbol, row, sign of the trades of known sign, of symbols with more than ``least`` of them."""
    signs = rows.filter(F.col("tick_sign").isNotNull()).select("symbol", "seq", F.col("tick_sign").alias("sign"))
    signs = signs.withColumn("row", F.row_number().over(Window.partitionBy("symbol").orderBy("seq")) - 1)
    enough = signs.groupBy("symbol").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > least)
    return signs.join(enough, "symbol").select("symbol", "row", "sign")


def weighted_acf(per_symbol: DataFrame) -> DataFrame:
    """lag, point, se, n_obs, n_symbols: symbols combined by their trade counts."""
    total = F.sum("n")
    return per_symbol.groupBy("lag").agg(
        (F.sum(F.col("n") * F.col("r")) / total).alias("point"), (F.sqrt(F.sum(F.col("n") * F.col("n") * F.col("se") * F.col("se"))) / total).alias("se"),
        total.alias("n_obs"), F.count(F.lit(1)).alias("n_symbols"),
    )


@by_session
def sign_autocorrelation(rows: DataFrame, lags: Sequence[int] = R.HORIZON_GRID_EVENTS) -> list[EstimationResult]:
    """Autocorrelation of trade signs at each lag, within symbols, combined by trade counts."""
    per_symbol = E.bartlett(E.acf(sign_series(rows, max(lags) + 10), "sign", max(lags))).filter(F.col("lag").isin(*lags))
    z, out = critical(R.CI_LEVEL), []
    for r in weighted_acf(per_symbol).orderBy("lag").collect():
        point, se = known(r["point"]), known(r["se"])
        p = normal_p(point / se) if point is not None and se else None
        low, high = (None, None) if point is None or se is None else (point - z * se, point + z * se)
        out.append(EstimationResult(f"sign_autocorr_lag{r['lag']}", "autocorr", point, low, high, r["n_obs"], se, p, R.CI_LEVEL, "bartlett_per_symbol_weighted", extra={"lag": r["lag"], "n_obs": r["n_obs"], "n_symbols": r["n_symbols"]}))
    return out


@by_session
def pairs_impact(rows: DataFrame, bucket: int = 20) -> DataFrame:
    """symbol, bucket, volume (absolute signed volume, not 0), move (absolute mid change, zeros stay)."""
    b = with_changes(bucketed(rows, bucket, ("signed_size",), ("mid",)))
    known_pairs = b.filter(F.col("change").isNotNull() & (F.col("signed_size") != 0))
    return known_pairs.select("symbol", "bucket", F.abs("signed_size").alias("volume"), F.abs("change").alias("move"))


def impact_points(rows: DataFrame, bucket: int = 20, n_bins: int = 20) -> DataFrame:
    """row, x, y: logs of mean volume and mean move of quantile bins of volume."""
    bins = binned(pairs_impact(rows, bucket), "volume", "move", n_bins, MIN_BIN).filter((F.col("x_mean") > 0) & (F.col("y_mean") > 0))
    return bins.select((F.row_number().over(Window.orderBy("bin")) - 1).alias("row"), F.ln("x_mean").alias("x"), F.ln("y_mean").alias("y"))


@by_session
def impact_curve(rows: DataFrame, bucket: int = 20, n_bins: int = 20) -> EstimationResult:
    """Exponent of mean absolute mid change in absolute signed volume."""
    points = impact_points(rows, bucket, n_bins).persist()
    n = pairs_impact(rows, bucket).count()
    out = E.ols_hac(points, "y", "x", name="impact_curve", lags=2)
    bins = points.count()
    points.unpersist()
    return replace(out, extra={**out.extra, "n_obs": n, "n_bins": bins})


@by_session
def linearity(rows: DataFrame, bucket: int = 50, n_bins: int = 20) -> DataFrame:
    """ofi_mean, ret_mean, ret_se, n of equal-count bins of imbalance."""
    bins = binned(pairs_contemporaneous(rows, bucket), "x", "y", n_bins)
    return bins.select(F.col("x_mean").alias("ofi_mean"), F.col("y_mean").alias("ret_mean"), F.col("y_se").alias("ret_se"), "n")


@by_session
def linear_fit(rows: DataFrame, bucket: int = 50) -> DataFrame:
    """slope, intercept, r2, n, bucket of the contemporaneous fit."""
    pairs = pairs_contemporaneous(rows, bucket)
    return pairs.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.count(F.lit(1)).alias("n"), F.lit(bucket).alias("bucket"))


@by_session
def run_family(rows: DataFrame, n_resamples: int = R.BOOTSTRAP_N_RESAMPLES, horizons: Sequence[int] = R.HORIZON_GRID_EVENTS) -> list[EstimationResult]:
    """All registered tests, controlled as one family."""
    rows = rows.persist()
    slope, _ = ofi_contemporaneous(rows, n_resamples=n_resamples)
    results = [slope, *ofi_forward(rows, horizons), queue_imbalance(rows, n_resamples=n_resamples), *sign_autocorrelation(rows, horizons), impact_curve(rows)]
    rows.unpersist()
    return BenjaminiHochbergController(rows.sparkSession).control(results)


def family_table(results: Sequence[EstimationResult], spark: SparkSession) -> DataFrame:
    """name, metric, point, ci_low, ci_high, p_raw, p_adj, rejected, n_obs, horizon."""
    made = results_frame(spark, results)
    horizon = F.coalesce(F.try_element_at("extra", F.lit("horizon")), F.try_element_at("extra", F.lit("lag"))).cast("double")
    return made.select("name", "metric", "point", "ci_low", "ci_high", F.col("p_value_raw").alias("p_raw"), F.col("p_value_adj").alias("p_adj"), "rejected", F.coalesce(F.try_element_at("extra", F.lit("n_obs")).cast("long"), "n_obs").alias("n_obs"), horizon.alias("horizon"))


@by_session
def robustness(rows: DataFrame, symbols: Sequence[str] | None = None, n_resamples: int = R.BOOTSTRAP_N_RESAMPLES) -> list[tuple]:
    """(ticker, ofi_R2, ofi_R2_lo, ofi_R2_hi, ofi_slope, qi_auc, qi_auc_lo, qi_auc_hi) of each symbol alone; of every symbol by default."""
    rows, out = rows.persist(), []
    for s in sorted(r["symbol"] for r in rows.select("symbol").distinct().collect()) if symbols is None else symbols:
        own = rows.filter(F.col("symbol") == s)
        slope, r2 = ofi_contemporaneous(own, n_resamples=n_resamples)
        q = queue_imbalance(own, n_resamples=n_resamples)
        out.append((s.replace(BETWEEN, " "), r2.point, r2.ci_low, r2.ci_high, slope.point, q.point, q.ci_low, q.ci_high))
    rows.unpersist()
    return out


def horizon_profile(family: DataFrame, prefix: str = "ofi_forward_h") -> DataFrame:
    """The tests of one study by horizon: name, horizon, point, ci_low, ci_high."""
    own = family.filter(F.col("name").startswith(prefix))
    return own.select("name", F.regexp_extract("name", r"(\d+)$", 1).cast("int").alias("horizon"), "point", "ci_low", "ci_high").orderBy("horizon")
