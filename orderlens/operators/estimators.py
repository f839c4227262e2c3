"""Effect sizes with honest errors.

Data is reduced in the JVM: centred cross-products in one aggregation, lagged residual products in one
window pass over chunks of rows (each with copies of the few rows before it, so a long series is many
tasks). The driver sees k x k sums and does the algebra.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.book import critical, normal_p
from ..registry import CI_LEVEL
from ..schema import EstimationResult, known

#: Rows in a window partition of a lagged pass.
CHUNK = 200_000
#: Parts that distinct values are dealt to for ranks.
RANK_PARTS = 64


def global_rows(rows: DataFrame, groups: tuple[str, ...], order: str) -> DataFrame:
    """Adds 0-based ``row`` in the order of groups, then ``order``; only the table of group sizes is seen whole."""
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__shift", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*groups).orderBy(order)) - 1
    return rows.withColumn("__in", inside).join(sizes, list(groups)).withColumn("row", F.col("__in") + F.col("__shift")).drop("__in", "__shift")


def chunked(rows: DataFrame, back: int, chunk: int, row: str = "row") -> DataFrame:
    """Rows with ``chunk`` and ``own``; the last ``back`` rows of a chunk also as copies in the next, not own."""
    home = F.floor(F.col(row) / chunk)
    reach = F.floor((F.col(row) + back) / chunk)
    out = rows.withColumn("__home", home).withColumn("chunk", F.explode(F.sequence(home, reach)))
    return out.withColumn("own", F.col("chunk") == F.col("__home")).drop("__home")


def _sums(rows: DataFrame, columns: dict[str, Column]) -> dict[str, float]:
    found = rows.agg(*[F.sum(c).alias(k) for k, c in columns.items()]).first()
    return {k: float(found[k] or 0.0) for k in columns}


def ols_hac(
    rows: DataFrame, y: str, x: str | list[str], *, name: str, lags: int, row: str = "row", coef_index: int | None = None,
    add_const: bool = True, ci_level: float = CI_LEVEL, chunk: int = CHUNK,
) -> EstimationResult:
    """Least squares with Bartlett-weighted autocovariances of the scores up to ``lags`` rows; no small-sample factor.

    ``row`` numbers the rows without gaps in the order in which lags count. Regressors are centred where there is
    a constant, which changes nothing but rounding.
    """
    xs = [x] if isinstance(x, str) else list(x)
    k = len(xs)
    base = rows.select(F.col(row).alias("row"), F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(xs)])
    means = base.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), *[F.avg(f"x{i}").alias(f"x{i}") for i in range(k)]).first()
    n = means["n"]
    mean_y = float(means["y"] or 0.0)
    shift = np.array([float(means[f"x{i}"] or 0.0) for i in range(k)]) if add_const else np.zeros(k)
    xc = [F.col(f"x{i}") - F.lit(float(shift[i])) for i in range(k)]
    yc = F.col("y") - F.lit(mean_y if add_const else 0.0)
    wanted = {f"{i},{j}": xc[i] * xc[j] for i in range(k) for j in range(i, k)} | {f"y{i}": xc[i] * yc for i in range(k)}
    wanted |= {"yy": (F.col("y") - F.lit(mean_y)) * (F.col("y") - F.lit(mean_y))}
    sums = _sums(base, wanted)
    total_squares = sums["yy"]
    xx = np.array([[sums[f"{min(i, j)},{max(i, j)}"] for j in range(k)] for i in range(k)])
    slope = np.linalg.solve(xx, np.array([sums[f"y{i}"] for i in range(k)]))
    # scores: residual times (constant,) centred regressors
    residual = yc
    for b, c in zip(slope, xc, strict=True):
        residual = residual - F.lit(float(b)) * c
    parts = ([F.lit(1.0)] if add_const else []) + xc
    m = len(parts)
    scored = base.select("row", residual.alias("u"), *[(residual * c).alias(f"z{i}") for i, c in enumerate(parts)])
    if lags:
        w = Window.partitionBy("chunk").orderBy("row")
        held = chunked(scored, lags, chunk)
        for i in range(m):
            past = [F.coalesce(F.lag(f"z{i}", lag).over(w), F.lit(0.0)) * (1.0 - lag / (lags + 1.0)) for lag in range(1, lags + 1)]
            total = past[0]
            for p in past[1:]:
                total = total + p
            held = held.withColumn(f"v{i}", total)
        scored = held.filter("own")
    products = {f"z{i},{j}": F.col(f"z{i}") * F.col(f"z{j}") for i in range(m) for j in range(m)}
    if lags:
        products |= {f"v{i},{j}": F.col(f"z{i}") * F.col(f"v{j}") for i in range(m) for j in range(m)}
    sums = _sums(scored, products | {"uu": F.col("u") * F.col("u")})
    meat = np.array([[sums[f"z{i},{j}"] + (sums[f"v{i},{j}"] + sums[f"v{j},{i}"] if lags else 0.0) for j in range(m)] for i in range(m)])
    bread = np.zeros((m, m))
    bread[m - k :, m - k :] = np.linalg.inv(xx)
    beta = slope
    if add_const:
        bread[0, 0] = 1.0 / n
        # back to regressors as they are: the constant takes up the shift
        back = np.eye(m)
        back[0, 1:] = -shift
        beta = np.concatenate([[mean_y - float(shift @ slope)], slope])
        cov = back @ (bread @ meat @ bread) @ back.T
    else:
        cov = bread @ meat @ bread
    se = np.sqrt(np.diag(cov))
    i = coef_index if coef_index is not None else (1 if add_const else 0)
    z = critical(ci_level)
    p = [normal_p(b / s) if s > 0 else None for b, s in zip(beta, se, strict=True)]
    r2 = 1.0 - sums["uu"] / total_squares if total_squares > 0 else None
    return EstimationResult(
        name, "coef", float(beta[i]), float(beta[i] - z * se[i]), float(beta[i] + z * se[i]), n, float(se[i]), p[i], ci_level, "hac",
        extra={"coef": beta.tolist(), "bse": se.tolist(), "p_value_raw": p, "ci_low": (beta - z * se).tolist(), "ci_high": (beta + z * se).tolist(), "r2": r2, "lags": lags, "coef_index": i},
    )


class OLSHACEstimator:
    """Least squares as an estimator of column x on column y."""

    def __init__(self, lags: int, coef_index: int | None = None, add_const: bool = True, ci_level: float = CI_LEVEL) -> None:
        self.lags, self.coef_index, self.add_const, self.ci_level = lags, coef_index, add_const, ci_level

    def estimate(self, rows: DataFrame, x: str | list[str], y: str, name: str) -> EstimationResult:
        return ols_hac(rows, y, x, name=name, lags=self.lags, coef_index=self.coef_index, add_const=self.add_const, ci_level=self.ci_level)


def logit_coef(rows: DataFrame, y: str, x: str | list[str], *, name: str, coef_index: int | None = None, add_const: bool = True, ci_level: float = CI_LEVEL) -> EstimationResult:
    """Maximum-likelihood logit with Wald errors, by iteratively reweighted least squares in the JVM."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    xs = [x] if isinstance(x, str) else list(x)
    odd = rows.filter(~F.col(y).isin(0, 1) | F.col(y).isNull()).limit(1).count()
    if odd or rows.select(y).distinct().count() < 2:
        raise ValueError("logit needs labels 0 and 1, both present")
    data = VectorAssembler(inputCols=xs, outputCol="__x").transform(rows.select(F.col(y).cast("double").alias("__y"), *[F.col(c).cast("double").alias(c) for c in xs]))
    model = GeneralizedLinearRegression(family="binomial", link="logit", regParam=0.0, tol=1e-12, maxIter=100, fitIntercept=add_const, featuresCol="__x", labelCol="__y").fit(data)
    beta, se = list(model.coefficients), list(model.summary.coefficientStandardErrors)
    if add_const:  # the summary has the constant last
        beta, se = [model.intercept, *beta], [se[-1], *se[:-1]]
    z, i = critical(ci_level), coef_index if coef_index is not None else (1 if add_const else 0)
    p = [normal_p(b / s) for b, s in zip(beta, se, strict=True)]
    return EstimationResult(
        name, "coef", float(beta[i]), float(beta[i] - z * se[i]), float(beta[i] + z * se[i]), data.count(), float(se[i]), p[i], ci_level, "wald",
        extra={"coef": [float(b) for b in beta], "bse": [float(s) for s in se], "p_value_raw": p},
    )


class LogitEstimator:
    """Logit as an estimator of column x on column y."""

    def __init__(self, coef_index: int | None = None, add_const: bool = True, ci_level: float = CI_LEVEL) -> None:
        self.coef_index, self.add_const, self.ci_level = coef_index, add_const, ci_level

    def estimate(self, rows: DataFrame, x: str | list[str], y: str, name: str) -> EstimationResult:
        return logit_coef(rows, y, x, name=name, coef_index=self.coef_index, add_const=self.add_const, ci_level=self.ci_level)


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_tail(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    value = 1.0
    for i in range(2000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + step * d or tiny)
        c = 1.0 + step / (c or tiny) or tiny
        value *= c * d
        if abs(1.0 - c * d) < 1e-16:
            break
    return front * (value - 1.0)


def t_p(t: float, df: float) -> float:
    """Two-sided Student-t p-value."""
    return beta_tail(df / 2, 0.5, df / (df + t * t))


def average_ranks(rows: DataFrame, column: str, to: str) -> DataFrame:
    """Adds ranks with ties averaged, from the counts of distinct values: rows are never in one window."""
    counts = rows.groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    part = F.col("__part")
    # parts of even size by bounds that are values, so that a part is the same whenever it is computed
    bounds = sorted(set(counts.select(F.col("__v").cast("double").alias("v")).approxQuantile("v", [i / RANK_PARTS for i in range(1, RANK_PARTS)], 0.25 / RANK_PARTS)))
    below = F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("__v")) if bounds else F.array()
    spread = counts.withColumn("__part", F.size(below))
    inside = Window.partitionBy(part).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    spread = spread.withColumn("__upto", F.sum("__c").over(inside))
    totals = spread.groupBy(part).agg(F.sum("__c").alias("__t"))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(part, F.coalesce(F.sum("__t").over(ahead), F.lit(0)).alias("__shift"))
    ranks = spread.join(totals, "__part").select("__v", (F.col("__upto") + F.col("__shift") - (F.col("__c") - 1) / 2.0).alias(to))
    return rows.join(ranks, rows[column] == ranks["__v"]).drop("__v")


def information_coefficient(rows: DataFrame, pred: str, outcome: str, *, name: str, method: str = "pearson", ci_level: float = CI_LEVEL) -> EstimationResult:
    """Linear or rank correlation with a Fisher interval (unknown for under 4 rows or a perfect correlation)."""
    if method not in ("pearson", "spearman"):
        raise ValueError(f"method must be pearson or spearman, not {method!r}")
    a, b = pred, outcome
    if method == "spearman":
        rows = average_ranks(average_ranks(rows.select(pred, outcome), pred, "__rp"), outcome, "__ro")
        a, b = "__rp", "__ro"
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("r")).first()
    n, r = found["n"], known(found["r"])
    low = high = p = None
    if r is not None:
        r = max(-1.0, min(1.0, r))
        if n > 2:
            p = 0.0 if abs(r) == 1 else t_p(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
        if n > 3 and abs(r) < 1:
            half = critical(ci_level) / math.sqrt(n - 3)
            low, high = math.tanh(math.atanh(r) - half), math.tanh(math.atanh(r) + half)
    return EstimationResult(name, "IC", r, low, high, n, None, p, ci_level, "fisher_z", extra={"method": method})


def auc(rows: DataFrame, score: str, label: str) -> float | None:
    """Area under the ROC curve, ties averaged: from the ranks of the positives (NULL without both classes)."""
    ranked = average_ranks(rows.select(F.col(score).alias("s"), F.col(label).cast("int").alias("l")), "s", "__r")
    found = ranked.agg(F.sum(F.when(F.col("l") == 1, F.col("__r"))).alias("r"), F.sum("l").alias("p"), F.count(F.lit(1)).alias("n")).first()
    p = found["p"] or 0
    q = (found["n"] or 0) - p
    return None if not p or not q else (found["r"] - p * (p + 1) / 2.0) / (p * q)


def acf(rows: DataFrame, x: str, lags: int, by: str = "symbol", row: str = "row", chunk: int = CHUNK) -> DataFrame:
    """by, lag, r, n for lags 1 .. ``lags``: biased autocorrelations (divided by the full sum of squares).

    The series is demeaned; lagged products come from one pass over chunks with copies of the rows before.
    A constant series has NULLs.
    """
    if lags < 1:
        raise ValueError(f"lags must be at least 1, not {lags}")
    means = rows.groupBy(by).agg(F.avg(x).alias("__m"), F.count(F.lit(1)).alias("n"))
    base = rows.select(by, row, x).join(means, by).select(by, F.col(row).alias("row"), (F.col(x) - F.col("__m")).alias("a"), "n")
    w = Window.partitionBy(by, "chunk").orderBy("row")
    held = chunked(base, lags, max(chunk, lags + 1))
    past = F.collect_list("a").over(w.rowsBetween(-lags, -1))
    held = held.withColumn("past", past).filter("own")
    # position from the end of the list of earlier values is the lag
    pairs = held.select(by, "n", "a", F.posexplode_outer(F.reverse("past")).alias("lag", "b"))
    squares = base.groupBy(by).agg(F.sum(F.col("a") * F.col("a")).alias("ss"))
    sums = pairs.filter("lag is not null").groupBy(by, "n", "lag").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    return sums.join(squares, by).select(by, (F.col("lag") + 1).alias("lag"), (F.col("s") / F.nullif("ss", F.lit(0.0))).alias("r"), "n")


def bartlett(correlations: DataFrame, by: str = "symbol", ci_level: float = CI_LEVEL) -> DataFrame:
    """Adds se, ci_low, ci_high from a running sum of the squares of shorter lags (NULL where n <= lag + 1)."""
    shorter = Window.partitionBy(by).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    se = F.sqrt((1.0 + 2.0 * F.coalesce(F.sum(F.col("r") * F.col("r")).over(shorter), F.lit(0.0))) / F.col("n"))
    out = correlations.withColumn("se", F.when((F.col("n") > F.col("lag") + 1) & F.col("r").isNotNull(), se))
    z = critical(ci_level)
    return out.withColumn("ci_low", F.col("r") - z * F.col("se")).withColumn("ci_high", F.col("r") + z * F.col("se"))


def autocorrelation(rows: DataFrame, x: str, lag: int, row: str = "row") -> float | None:
    """Autocorrelation of one series at one lag."""
    found = acf(rows.withColumn("__by", F.lit(0)), x, lag, by="__by", row=row).filter(F.col("lag") == lag).first()
    return known(found["r"]) if found else None


def autocorr_bartlett_ci(rows: DataFrame, x: str, lag: int, *, name: str, row: str = "row", ci_level: float = CI_LEVEL) -> EstimationResult:
    """Autocorrelation of one series at one lag with its Bartlett interval."""
    found = bartlett(acf(rows.withColumn("__by", F.lit(0)), x, lag, by="__by", row=row), by="__by", ci_level=ci_level).filter(F.col("lag") == lag).first()
    n = found["n"] if found else rows.count()
    r = known(found["r"]) if found else None
    if r is None or found["se"] is None:
        return EstimationResult(name, "autocorr", r, None, None, n, ci_level=ci_level, ci_method="bartlett")
    p = normal_p(r / found["se"]) if found["se"] > 0 else None
    return EstimationResult(name, "autocorr", r, found["ci_low"], found["ci_high"], n, found["se"], p, ci_level, "bartlett", extra={"lag": lag})
