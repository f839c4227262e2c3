"""Hand-computed cases, closed-form references, and statistical gates of the order-flow engine."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens import registry as R
from orderlens import schema as S
from orderlens.functions import book as B
from orderlens.operators import book as K
from orderlens.operators import buckets, estimators, fdr, features, folds, gate, resample, studies
from orderlens.plans import queries
from orderlens.simulate import OrderFlowSimulator, SimConfig, simulate, stream
from orderlens.sources import files
from orderlens.streaming.replay import Ladder, run_stream, streaming_replay

NA, NB = S.NO_ASK, S.NO_BID


def book(spark, rows, symbol="S"):
    """Rows of interleaved level columns."""
    levels = len(rows[0]) // 4
    return spark.createDataFrame([(symbol, i, *r) for i, r in enumerate(rows)], "symbol string, seq long, " + ", ".join(f"{c} long" for c in S.book_columns(levels)))


def events(spark, rows, symbol="S"):
    """Rows of (code, id, size, price, side)."""
    return S.events_frame(spark, [(float(i), *r) for i, r in enumerate(rows)], symbol)


def column(df, c, order="seq"):
    return [r[c] for r in df.orderBy(order).select(c).collect()]


def near(got, want, tol=1e-12):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None) and (g is None or abs(g - w) <= tol), (got, want)


def series(spark, **columns):
    names = list(columns)
    rows = [tuple(None if x is None else float(x) for x in r) for r in zip(*columns.values(), strict=True)]
    return spark.createDataFrame([(i, "S", *r) for i, r in enumerate(rows)], "row long, symbol string, " + ", ".join(f"{n} double" for n in names))


# --- rows and checks

def test_rows(spark):
    for size, side in ((1, 0), (-1, 1)):
        with pytest.raises(ValueError, match="row 0"):
            events(spark, [(1, 1, size, 1, side)])
    states = S.book_frame(spark, [(110, 5, 100, 3, NA, 0, 99, 4), (NA, 0, 1, 1, NA, 0, NB, 0)])
    assert states.columns == ["symbol", "seq", *S.book_columns(2)] and column(states.withColumn("mid", B.mid()), "mid") == [105.0, None]
    assert S.book_columns(1) == ["ask_px_1", "ask_sz_1", "bid_px_1", "bid_sz_1"] and len(S.book_columns(10)) == 40
    with pytest.raises(ValueError):
        S.book_columns(0)


@pytest.mark.parametrize("bad", [dict(horizon=-1), dict(horizon=3, unit="days")])
def test_spec_rules(bad):
    with pytest.raises(ValueError):
        S.column_spec("x", "", **bad)


def test_result_rules(spark):
    with pytest.raises(ValueError):
        S.EstimationResult("x", "coef", 1.0, 2.0, 1.0, 3)
    with pytest.raises(ValueError):
        S.EstimationResult("x", "coef", 1.0, 1.0, 2.0, 3, ci_level=1.0)
    assert S.results_frame(spark, [S.EstimationResult("x", "coef", None, None, None, 0, extra={"a": 1})]).first()["extra"] == {"a": "1"}


def test_validation(spark):
    good = events(spark, [(1, 1, 10, 100, 1), (6, 2, 5, 110, -1)])
    assert S.validate_events(good) is good
    for change in ({"direction": 0}, {"size": -1}):
        for c, v in change.items():
            with pytest.raises(ValueError, match=c):
                S.validate_events(good.withColumn(c, F.lit(v)))
    with pytest.raises(ValueError, match="time"):
        S.validate_events(good.withColumn("time_s", -F.col("time_s")))
    with pytest.raises(ValueError, match="missing"):
        S.validate_events(good.drop("price"))


# --- files

def test_files_keep_row_order(spark, tmp_path):
    n = 5000
    name = lambda kind: str(tmp_path / f"AAPL_2012-06-21_34200000_57600000_{kind}_2.csv")
    with open(name("message"), "w") as f:
        f.writelines(f"{34200 + i // 3},{1 + i % 4},{i},{i % 7},{1000 + i},{1 if i % 2 else -1},extra\n" for i in range(n))
    with open(name("orderbook"), "w") as f:
        f.writelines(f"{2000 + i},{i},{1000 - i},{i},{3000 + i},1,{500 - i},2\n" for i in range(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        msg, ob = files.read_messages(spark, name("message")), files.read_orderbook(spark, name("orderbook"), 1)
        assert msg.rdd.getNumPartitions() >= 1 and ob.columns == ["symbol", "session", "seq", *S.book_columns(1)]
        rows = files.aligned(msg, ob).select("symbol", "session", "seq", "order_id", "ask_sz_1", "time_s").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == n and all(r["symbol"] == "AAPL" and r["session"] == "2012-06-21" and r["seq"] == r["order_id"] == r["ask_sz_1"] for r in rows)
    with pytest.raises(ValueError, match="differ"):
        files.aligned(msg.filter("seq > 0"), ob)
    with pytest.raises(ValueError):
        files.read_orderbook(spark, name("orderbook"), 0)
    files.to_lake(msg, str(tmp_path / "lake"))
    assert spark.read.parquet(str(tmp_path / "lake")).filter("symbol = 'AAPL'").count() == n
    files.write_table(ob.limit(3), str(tmp_path / "out"))
    assert files.read_table(spark, str(tmp_path / "out")).count() == 3


# --- features

ROWS = [(110, 20, 100, 10), (110, 20, 101, 15), (109, 8, 100, 5)]


def test_features_by_hand(spark):
    e = events(spark, [(4, 1, 1, 105, 1), (4, 1, 1, 106, 1), (4, 1, 1, 104, 1)])
    for chunk in (None, 2):
        out = features.PointInTimeFeatureEngine((1, 2, 5), rv_window=2).compute(e, book(spark, ROWS), chunk)
        r1, r2 = math.log(105.5 / 105), math.log(104.5 / 105.5)
        near(column(out, "mid"), [105, 105.5, 104.5])
        near(column(out, "ofi"), [None, 15, -23])
        near(column(out, "queue_imbalance"), [-10 / 30, -5 / 35, -3 / 13])
        near(column(out, "spread"), [10, 9, 9])
        near(column(out, "rv_2"), [None, None, math.sqrt(r1 * r1 + r2 * r2)])
        near(column(out, "fwd_ret_1"), [r1, r2, None])
        near(column(out, "fwd_ret_2"), [math.log(104.5 / 105), None, None])
        near(column(out, "fwd_ret_5"), [None] * 3)
        near(column(out, "tick_sign"), [None, 1, -1])
        assert folds.future_columns(out) == []


def test_empty_sides(spark):
    b = book(spark, [ROWS[0], (NA, 0, 101, 15), ROWS[2], (NA, 0, NB, 0)])
    near(column(b.select("seq", B.ofi(B.rows_of()).alias("x")), "x"), [None] * 4)
    near(column(b.select("seq", B.queue_imbalance().alias("x")), "x"), [-1 / 3, 1.0, -3 / 13, None])
    near(column(b.select("seq", B.spread().alias("x")), "x"), [10, None, 9, None])
    deep = book(spark, [(110, 20, 100, 10, 111, 5, 99, 7)])
    assert deep.select(B.depth(deep.columns).alias("d")).first()["d"] == 42


def test_tick_rule(spark):
    prices, sides = [100, 101, 101, 100, 99], [1, -1, -1, 1, -1]
    e = events(spark, [(4, 1, 1, p, d) for p, d in zip(prices, sides, strict=True)])
    for chunk in (None, 1, 2, 3):
        near(column(features.tick_signs(e, chunk), "tick_sign"), [None, 1, 1, -1, -1])
    assert features.tick_accuracy(e).first()["accuracy"] == 0.75
    mixed = events(spark, [(4, 1, 1, 100, 1), (1, 2, 1, 100, 1), (4, 1, 1, 101, 1)])
    near(column(features.tick_signs(mixed), "tick_sign"), [None, None, 1])
    assert features.tick_accuracy(events(spark, [(1, 1, 1, 1, 1)])).first()["accuracy"] is None


def test_truncation_changes_no_feature(spark):
    e, _ = stream(SimConfig(), 60, 3)
    msg = OrderFlowSimulator(spark).generate(60, 3)
    b = K.replay(msg, 1)
    engine = features.PointInTimeFeatureEngine((1, 5), rv_window=5)
    whole, cut = engine.compute(msg, b), engine.compute(msg.filter("seq < 40"), b.filter("seq < 40"))
    names = [s.name for s in engine.specs() if not S.is_label(s)]
    for c in names:
        near(column(whole.filter("seq < 40"), c), column(cut, c))
    assert column(cut, "fwd_ret_5")[-5:] == [None] * 5 and len(e["size"]) == 60
    with pytest.raises(ValueError):
        features.PointInTimeFeatureEngine(rv_window=0)
    with pytest.raises(ValueError):
        engine.compute(msg, b.drop("ask_px_1"))


def test_scalar_functions(spark):
    row = spark.range(1).select(B.round_tick(F.lit(250.0), 100).alias("a"), B.round_tick(F.lit(350.0), 100).alias("b"), B.logistic(F.lit(0.0)).alias("c")).first()
    assert tuple(row) == (200, 400, 0.5)
    assert abs(B.critical(0.95) - 1.959963984540054) < 1e-12 and abs(B.normal_p(1.959963984540054) - 0.05) < 1e-12 and B.normal_p(38.0) > 0


# --- buckets

def test_buckets_by_hand(spark):
    df = lambda **c: series(spark, **c).withColumnRenamed("row", "seq")
    near(column(buckets.bucketed(df(x=[1, 2, None, 4, 5, 6]), 3, ("x",)), "x", "bucket"), [3, 15])
    near(column(buckets.bucketed(df(x=range(5)), 3, ("x",)), "x", "bucket"), [3])
    b = buckets.with_changes(buckets.bucketed(df(mid=range(100, 106)), 2, (), ("mid",)))
    near(column(b, "change", "bucket"), [None, math.log(103 / 101), math.log(105 / 103)])
    b = buckets.with_changes(buckets.bucketed(df(mid=[1, 2, 3, None, 5, 6]), 2, (), ("mid",)))
    near(column(b, "change", "bucket"), [None, None, None])


def test_quantile_bins_match_numpy(spark):
    x = np.random.default_rng(0).integers(0, 30, 400).astype(float)
    edges = np.unique(np.quantile(x, np.linspace(0, 1, 11)))
    rows = series(spark, x=x, y=x * 2)
    assert np.allclose(buckets.quantile_edges(rows, "x", 10), edges)
    want = np.clip(np.digitize(x, edges[1:-1]), 0, len(edges) - 2)
    got = buckets.binned(rows, "x", "y", 10).orderBy("bin").collect()
    assert [r["n"] for r in got] == [int((want == r["bin"]).sum()) for r in got]
    assert all(abs(r["x_mean"] - x[want == r["bin"]].mean()) < 1e-9 for r in got)


# --- estimators

def hac_reference(x, y, lags):
    X = np.column_stack([np.ones(len(y)), x])
    inv = np.linalg.inv(X.T @ X)
    beta = inv @ X.T @ y
    z = X * (y - X @ beta)[:, None]
    meat = z.T @ z
    for k in range(1, lags + 1):
        g = z[k:].T @ z[:-k]
        meat = meat + (1 - k / (lags + 1)) * (g + g.T)
    return beta, np.sqrt(np.diag(inv @ meat @ inv))


@pytest.mark.parametrize("lags", [0, 1, 4, 10])
def test_ols_hac(spark, lags):
    rng = np.random.default_rng(7)
    x1, x2, e = rng.normal(size=250) + 50, rng.normal(size=250), rng.normal(size=250)
    for t in range(1, 250):
        e[t] += 0.6 * e[t - 1]
    y = 1.5 + 2 * x1 - 0.7 * x2 + e
    rows = series(spark, y=y, x1=x1, x2=x2)
    beta, se = hac_reference(np.column_stack([x1, x2]), y, lags)
    for chunk in (1000, 37):
        r = estimators.ols_hac(rows, "y", ["x1", "x2"], name="t", lags=lags, chunk=chunk)
        assert np.allclose(r.extra["coef"], beta, rtol=1e-8) and np.allclose(r.extra["bse"], se, rtol=1e-8)
        assert r.point == r.extra["coef"][1] and r.ci_low < r.point < r.ci_high
    plain = estimators.OLSHACEstimator(0, add_const=False).estimate(rows, "x1", "y", "t")
    assert abs(plain.point - float(x1 @ y / (x1 @ x1))) < 1e-10


def test_logit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + 1.2 * x)))).astype(float)
    X, b = np.column_stack([np.ones(400), x]), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-X @ b))
        H = X.T @ (X * (p * (1 - p))[:, None])
        b = b + np.linalg.solve(H, X.T @ (y - p))
    r = estimators.logit_coef(series(spark, y=y, x=x), "y", "x", name="l")
    assert np.allclose(r.extra["coef"], b, rtol=1e-8) and np.allclose(r.extra["bse"], np.sqrt(np.diag(np.linalg.inv(H))), rtol=1e-6)
    with pytest.raises(ValueError):
        estimators.logit_coef(series(spark, y=y + 1, x=x), "y", "x", name="l")


def test_information_coefficient(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.normal(size=200), 1)
    o = p**3 + rng.normal(size=200)
    ranks = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    for method, a, b in (("pearson", p, o), ("spearman", ranks(p), ranks(o))):
        r = estimators.information_coefficient(series(spark, p=p, o=o), "p", "o", name="ic", method=method)
        want = np.corrcoef(a, b)[0, 1]
        assert abs(r.point - want) < 1e-12
        assert abs(r.ci_low - math.tanh(math.atanh(want) - B.critical(0.95) / math.sqrt(197))) < 1e-12 and 0 <= r.p_value_raw < 1
    few = estimators.information_coefficient(series(spark, p=[1, 2, 3], o=[1, 3, 2]), "p", "o", name="ic")
    assert few.ci_low is None
    with pytest.raises(ValueError):
        estimators.information_coefficient(series(spark, p=[1], o=[1]), "p", "o", name="ic", method="kendall")


@pytest.mark.parametrize("t,df,p", [(2.0, 10, 0.07338803), (0.5, 3, 1 - 2 / math.pi * (math.atan(0.5 / 3**0.5) + 0.5 / 3**0.5 / (1 + 0.25 / 3))), (12.706204736, 1, 0.05), (1.0, 1, 0.5)])
def test_student_tail(t, df, p):
    assert abs(estimators.t_p(t, df) - p) < 1e-7


def test_auc(spark):
    rng = np.random.default_rng(3)
    s, y = np.round(rng.normal(size=300), 1), (rng.random(300) < 0.4).astype(int)
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    rows = series(spark, s=s + y * 0.3, y=y)
    assert abs(estimators.auc(series(spark, s=s, y=y), "s", "y") - want) < 1e-12
    assert estimators.auc(series(spark, s=s, y=y * 0), "s", "y") is None
    a = resample.auc_ci(rows, "s", "y", name="a", n_resamples=100, block=20)
    b = resample.auc_ci(rows.repartition(7), "s", "y", name="a", n_resamples=100, block=20)
    assert (a.point, a.ci_low, a.ci_high, a.p_value_raw) == (b.point, b.ci_low, b.ci_high, b.p_value_raw) and a.ci_low <= a.point <= a.ci_high
    rare = resample.auc_ci(series(spark, s=range(30), y=[1] + [0] * 29), "s", "y", name="r", n_resamples=200)
    assert rare.extra["n_resamples_effective"] < 200
    with pytest.raises(ValueError):
        resample.auc_ci(series(spark, s=s, y=y + 1), "s", "y", name="a")


def test_acf_and_bartlett(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=1500)
    for t in range(1, 1500):
        x[t] += 0.6 * x[t - 1]
    a = x - x.mean()
    want = [float(a[k:] @ a[:-k] / (a @ a)) for k in range(1, 11)]
    for chunk in (200_000, 100):
        got = estimators.bartlett(estimators.acf(series(spark, x=x), "x", 10, chunk=chunk)).orderBy("lag").collect()
        assert np.allclose([r["r"] for r in got], want, atol=1e-12)
        assert abs(got[4]["se"] - math.sqrt((1 + 2 * sum(r * r for r in want[:4])) / 1500)) < 1e-12
    assert estimators.autocorr_bartlett_ci(series(spark, x=[2.0] * 9), "x", 1, name="c").point is None
    with pytest.raises(ValueError):
        estimators.acf(series(spark, x=x), "x", 0)


def test_block_indexes():
    rng = np.random.default_rng(5)
    for n, block in ((100, 7), (10, 30)):
        c, s = resample.circular_index(n, block, rng), resample.stationary_index(n, block, rng)
        assert len(c) == len(s) == n and c.min() >= 0 and s.max() < n
    steps = np.diff(resample.stationary_index(100_000, 50, rng)) % 100_000 == 1
    assert abs(1 / (1 - steps.mean()) - 50) < 3


def test_block_bootstrap(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=400)
    r = resample.block_bootstrap_ci(series(spark, x=x), "x", np.mean, name="m", metric="mean", block=5, n_resamples=300, method="circular")
    assert r.ci_low < x.mean() < r.ci_high and abs(r.std_error - x.std() / 20) < 0.02
    with pytest.raises(ValueError):
        resample.block_bootstrap_ci(series(spark, x=x), "x", np.mean, name="m", method="moving")


# --- folds and leakage

def parts(fold):
    train = [*range(fold.train_end), *range(fold.train_from, fold.n)]
    return train, list(range(fold.test_lo, fold.test_hi))


def test_folds_by_hand():
    walk = [parts(f) for f in folds.PurgedWalkForwardSplitter(5).split(10, 1, 1)]
    assert walk == [([0], [2, 3]), ([0, 1, 2], [4, 5]), (list(range(5)), [6, 7]), (list(range(7)), [8, 9])]
    purged = [parts(f) for f in folds.PurgedWalkForwardSplitter(5, "purged_kfold").split(10, 1, 1)]
    assert purged == [(list(range(3, 10)), [0, 1]), ([0, *range(5, 10)], [2, 3]), ([0, 1, 2, 7, 8, 9], [4, 5]), ([0, 1, 2, 3, 4, 9], [6, 7]), (list(range(7)), [8, 9])]
    first = folds.PurgedWalkForwardSplitter(5).split(50, 1, 5)[0]
    assert parts(first) == ([0, 1, 2, 3, 4], list(range(10, 20)))
    assert len(folds.PurgedWalkForwardSplitter(5, "purged_kfold").split(3, 1, 0)) == 2
    for bad in (lambda: folds.PurgedWalkForwardSplitter(1), lambda: folds.PurgedWalkForwardSplitter(5, "x"), lambda: folds.PurgedWalkForwardSplitter().split(0), lambda: folds.PurgedWalkForwardSplitter().split(5, -1)):
        with pytest.raises(ValueError):
            bad()
    assert all(not folds.audit_fold(f, 1, 5) for m in folds.MODES for f in folds.PurgedWalkForwardSplitter(5, m).split(200, 1, 5))


@pytest.mark.parametrize("train,test,h,e,want", [
    ({0, 4, 8}, range(10, 15), 5, 0, {"label_overlap": 1}), ({5}, (10, 11), 5, 0, {"label_overlap": 1}), ({0, 5, 9}, range(10, 15), 0, 3, {"embargo_breach": 1}),
    ({8, 9, 15, 16}, range(10, 15), 0, 3, {"embargo_breach": 4}), ({6, 18}, range(10, 15), 0, 3, {}), ({0}, range(10, 15), 0, 0, {}),
])
def test_leaks_by_hand(spark, train, test, h, e, want):
    rows = spark.createDataFrame([(0, i, "train") for i in train] + [(0, i, "test") for i in test], "fold int, row long, part string")
    assert {r["kind"]: r["count"] for r in folds.audit(spark, rows, h, e).collect()} == want


def test_leaks_of_each_symbol(spark):
    lines = [("A", 0, 9, "train"), ("A", 0, 10, "test"), ("A", 0, 11, "test"), ("B", 0, 9, "train"), ("B", 0, 8, "train"), ("B", 0, 50, "test")]
    lines += [("C", 1, 3, "train"), ("C", 1, 4, "test")]
    found = folds.audit(spark, spark.createDataFrame(lines, "symbol string, fold int, row long, part string"), 1, 2).collect()
    assert {(r["symbol"], r["fold"], r["kind"], r["count"]) for r in found} == {("A", 0, "label_overlap", 1), ("A", 0, "embargo_breach", 1), ("C", 1, "label_overlap", 1), ("C", 1, "embargo_breach", 1)}


def test_audit_queries_cover_every_symbol(spark):
    for name in ("label_overlap", "embargo_breach"):
        found = queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        assert {r["symbol"] for r in found} == {f"S{i}" for i in range(5)}


def test_future_features(spark):
    specs = [S.column_spec("a", "", looks_ahead=3), S.column_spec("b", "", horizon=10, looks_ahead=10), S.column_spec("c", "")]
    assert folds.future_features(specs) == ["a"] and not S.is_causal(specs[0]) and S.is_causal(specs[2])


def test_members_are_apart(spark):
    bounds = folds.PurgedWalkForwardSplitter(4, "purged_kfold").bounds(spark, {"S": 100, "T": 0}, 2, 3)
    rows = folds.members(spark.range(100).select(F.lit("S").alias("symbol"), F.col("id").alias("row")), bounds)
    assert rows.groupBy("fold", "row").count().filter("count > 1").count() == 0 and rows.filter("part = 'test'").count() == 100


# --- false discoveries

def bh_reference(p, alpha):
    order = sorted(range(len(p)), key=lambda i: p[i])
    m, adj, cut = len(p), [0.0] * len(p), 0
    low = 1.0
    for k in range(m, 0, -1):
        low = min(low, p[order[k - 1]] * m / k)
        adj[order[k - 1]] = low
        if not cut and p[order[k - 1]] <= k / m * alpha:
            cut = k
    return [i in order[:cut] for i in range(m)], adj


VECTORS = [[0.03], [1, 1, 1, 1], [0.01, 0.01, 0.04, 0.04, 0.2, 0.2], [1e-6, 1e-5, 1e-4] + [0.7] * 30, [0.51, 0.62, 0.73, 0.84, 0.95], [1e-8, 1e-7, 1e-6, 1e-5], [0.001, 0.008, 0.039, 0.041, 0.9, 0.5, 0.2, 0.75], [0.05, 0.05, 0.05]]


@pytest.mark.parametrize("alpha", [0.01, 0.05, 0.1, 0.2])
def test_bh(spark, alpha):
    rows = [(f, i, float(p)) for f, v in enumerate(VECTORS) for i, p in enumerate(v)]
    got = fdr.benjamini_hochberg(spark.createDataFrame(rows, "family int, name int, p_raw double"), family="family", alpha=alpha).collect()
    for f, v in enumerate(VECTORS):
        rejected, adj = bh_reference(v, alpha)
        own = sorted((r for r in got if r["family"] == f), key=lambda r: r["name"])
        assert [r["rejected"] for r in own] == rejected and np.allclose([r["p_adj"] for r in own], adj, rtol=1e-12)


def test_bh_leaves_unknowns_out(spark):
    r = lambda p: S.EstimationResult("x", "coef", 0.0, None, None, 1, p_value_raw=p)
    done = fdr.close_family(spark, {"a": [r(0.01), r(None)], "b": [r(0.04)]})
    assert [x.rejected for x in done["a"]] == [True, None] and done["b"][0].p_value_adj == 0.04 and done["a"][0].p_value_adj == 0.02
    assert fdr.BenjaminiHochbergController(spark).control([]) == []


# --- replay

def touch(spark, rows, levels=1):
    return K.replay(events(spark, rows), levels).orderBy(F.desc("seq")).first()[2:]


@pytest.mark.parametrize("rows,want", [
    ([(1, 1, 10, 100, 1)], (NA, 0, 100, 10)), ([(1, 1, 10, 100, 1), (1, 2, 15, 100, 1)], (NA, 0, 100, 25)), ([(1, 1, 10, 100, 1), (2, 1, 4, 100, 1)], (NA, 0, 100, 6)),
    ([(1, 1, 10, 100, 1), (1, 2, 15, 100, 1), (2, 1, 4, 100, 1)], (NA, 0, 100, 21)), ([(1, 1, 10, 100, 1), (3, 1, 10, 100, 1)], (NA, 0, NB, 0)),
    ([(1, 1, 20, 110, -1), (4, 1, 8, 110, -1)], (110, 12, NB, 0)), ([(1, 1, 20, 110, -1), (4, 1, 20, 110, -1)], (NA, 0, NB, 0)),
    ([(1, 1, 10, 100, 1), (5, 0, 3, 100, 1), (7, 0, 0, 0, 1)], (NA, 0, 100, 10)), ([(1, 1, 10, 100, 1), (3, 9, 1, 100, 1), (4, 9, 1, 100, 1)], (NA, 0, 100, 10)),
    ([(1, 1, 10, 100, 1), (2, 1, 999, 100, 1)], (NA, 0, NB, 0)), ([(1, 1, 10, 100, 1), (1, 1, 5, 99, 1)], (NA, 0, 100, 10)),
])
def test_replay_by_hand(spark, rows, want):
    assert touch(spark, rows) == want


def test_replay_levels(spark):
    rows = [(1, 1, 5, 110, -1), (1, 2, 5, 112, -1), (1, 3, 5, 100, 1), (1, 4, 5, 98, 1)]
    assert touch(spark, rows, 2) == (110, 5, 100, 5, 112, 5, 98, 5)
    assert touch(spark, rows[:1] + rows[2:3], 3)[4:] == (NA, 0, NB, 0) * 2


def random_flow(n, seed):
    rng = np.random.default_rng(seed)
    return [(int(rng.choice([1, 1, 1, 2, 3, 4, 5, 7])), int(rng.integers(1, 15)), int(rng.integers(1, 30)), 1000 + int(rng.integers(-4, 5)), int(rng.choice([-1, 1]))) for _ in range(n)]


def test_replay_matches_the_ladder_in_batch_and_stream(spark):
    flow = {s: random_flow(300, i) for i, s in enumerate("AB")}
    e = events(spark, flow["A"], "A").unionByName(events(spark, flow["B"], "B"))
    want = {}
    for s, rows in flow.items():
        ladder = Ladder({}, {})
        for i, (c, o, z, p, d) in enumerate(rows):
            ladder.apply(c, o, z, p, d)
            want[s, i] = tuple(ladder.top(3))
    for bin_rows in (256, 16):
        assert {tuple(r[:2]): tuple(r[2:]) for r in K.replay(e, 3, bin_rows).collect()} == want
    assert {tuple(r[:2]): tuple(r[2:]) for r in run_stream(e, lambda x: streaming_replay(x, 3), rows=120).collect()} == want


def test_level_replay_matches_a_dictionary(spark):
    flow = random_flow(300, 9)
    e = events(spark, flow)
    shown = [(1002, 7, 998, 5, 1003, 9, 997, 4)] * 300
    sizes = {(-1, 1002): 7, (1, 998): 5, (-1, 1003): 9, (1, 997): 4}
    want = [shown[0]]
    for c, _, z, p, d in flow[1:]:
        if c == 1:
            sizes[d, p] = sizes.get((d, p), 0) + z
        elif c in (2, 3, 4) and (d, p) in sizes:
            sizes[d, p] -= z
            if sizes[d, p] <= 0:
                del sizes[d, p]
        want.append(tuple(Ladder({}, sizes).top(2)))
    got = K.seeded_replay(e, book(spark, shown), 2).orderBy("seq").collect()
    assert [tuple(r[2:]) for r in got] == want


def test_differential_by_hand(spark):
    a = [(110, 5, 100, 5, 111, 5, 99, 5)] * 2
    off = [a[0], (110, 6, 100, 5, 111, 5, 99, 5)]
    r = K.differential(book(spark, off), book(spark, a), 2).first()
    assert (r["row_match_rate"], r["cell_match_rate"], r["level_1_match_rate"], r["level_2_match_rate"]) == (0.5, 15 / 16, 0.5, 1.0)
    assert K.mismatches(book(spark, off), book(spark, a), 2).first()["seq"] == 1
    with pytest.raises(ValueError):
        K.differential(book(spark, a[:1]), book(spark, a), 2)
    with pytest.raises(ValueError):
        K.differential(book(spark, a).drop("ask_sz_2"), book(spark, a), 2)
    none = book(spark, a).limit(0)
    assert K.differential(none, none, 2).first()["row_match_rate"] is None


def test_transition_invariant(spark):
    rows = [(1, 1, 5, 100, 1), (1, 2, 3, 100, 1), (4, 1, 2, 100, 1), (1, 3, 1, 99, 1)]
    good = [(NA, 0, 100, 5), (NA, 0, 100, 8), (NA, 0, 100, 6), (NA, 0, 100, 6)]
    r = K.transition_invariant(events(spark, rows), book(spark, good), 1).first()
    assert (r["checked"], r["violations"]) == (2, 0)
    bad = [*good[:2], (NA, 0, 100, 7), good[3]]
    assert K.transition_invariant(events(spark, rows), book(spark, bad), 1).first()["violations"] == 1
    shown = K.outside_window(events(spark, rows), book(spark, good), 1)
    assert column(shown, "in_window") == [True, True, True, False]


# --- simulator and gates

def test_simulator(spark):
    sim = OrderFlowSimulator(spark, SimConfig(beta=1e-3, sigma=0.0))
    t = sim.generate_with_truth(500, 4)
    assert t.filter("fwd_ret_1 is not null").filter(F.abs(F.col("fwd_ret_1") - 1e-3 * F.col("driver")) > 1e-12).count() == 0
    assert t.filter("fwd_ret_1 is null").count() == 1
    S.validate_events(sim.generate(500, 4))
    a, b = simulate(spark, 100, [1, 2]), simulate(spark, 100, [2, 1])
    assert a.exceptAll(b).count() == 0 and a.filter("seed = 1").drop("seed").exceptAll(a.filter("seed = 2").drop("seed")).count() > 0
    with pytest.raises(ValueError):
        sim.generate(1, 0)


def test_recovery(spark):
    curve = {r["beta"]: r for r in gate.recovery_curve(gate.recover(spark, n_events=3000, seeds=range(1, 31))).collect()}
    for beta, r in curve.items():
        assert r["ci_coverage"] >= 0.85 and (beta == 0 or abs(r["mean_estimate"] / beta - 1) < 0.05)
    assert curve[0.0]["reject_rate"] <= 0.15 and curve[6e-4]["reject_rate"] >= 0.9


# --- studies

def synthetic(spark, n=6000, symbols=("A", "B")):
    frames = []
    for k, s in enumerate(symbols):
        rng = np.random.default_rng(k)
        ofi = rng.normal(size=n) * 100
        log_mid = np.cumsum(1e-6 * np.concatenate([[0], ofi[:-1]]) + rng.normal(size=n) * 1e-5) + 10
        sign = rng.choice([-1.0, 1.0], n)
        qi = np.tanh(np.concatenate([np.diff(log_mid), [0]]) * 5e3)
        frames += [(s, i, float(math.exp(m)), float(o), float(g * 10), float(g), float(q)) for i, (m, o, g, q) in enumerate(zip(log_mid, ofi, sign, qi, strict=True))]
    return spark.createDataFrame(frames, "symbol string, seq long, mid double, ofi double, signed_size double, tick_sign double, queue_imbalance double")


def test_study_family(spark):
    results = studies.run_family(synthetic(spark).cache(), n_resamples=50)
    assert len(results) == len(R.FAMILY) == 17 and all(r.family_id and r.rejected is not None for r in results)
    by = {r.name: r for r in results}
    assert by["ofi_contemporaneous"].point > 0 and by["ofi_contemporaneous"].rejected
    assert by["ofi_forward_h1"].extra["oos"] and by["ofi_forward_h1"].point > 0
    assert all(abs(by[f"sign_autocorr_lag{k}"].point) < 0.1 for k in R.HORIZON_GRID_EVENTS)
    table = studies.family_table(results, spark)
    assert table.columns == files.FAMILY_CSV.fieldNames() and studies.horizon_profile(table).count() == 7


def test_forward_study_uses_held_out_blocks(spark):
    rows = synthetic(spark, 1000, ("A",))
    held = studies.out_of_sample(studies.pairs_forward(rows, 5), 5)
    n = studies.pairs_forward(rows, 5).count()
    edges = np.linspace(0, n, 6).astype(int)
    want = sum(int(b - a) for a, b in zip(edges, edges[1:], strict=False) if a - 40 >= 10)
    assert held.count() == want and sorted(r["row"] for r in held.collect()) == list(range(want))


def test_linearity_and_robustness(spark):
    rows = synthetic(spark, 2000, ("A",)).cache()
    assert studies.linearity(rows, 20, 10).count() == 10
    fit = studies.linear_fit(rows, 20).first()
    slope, r2 = studies.ofi_contemporaneous(rows, 20, n_resamples=20)
    assert abs(fit["slope"] / slope.point - 1) < 1e-9 and abs(fit["r2"] - r2.point) < 1e-9
    assert len(studies.robustness(rows, ["A"], n_resamples=20)[0]) == 8


def test_robustness_covers_every_symbol(spark, monkeypatch):
    assert [r[0] for r in studies.robustness(synthetic(spark, 1500, ("B", "A", "C")), n_resamples=5)] == ["A", "B", "C"]
    seen = []
    monkeypatch.setattr(studies, "block_bootstrap_ci", lambda *a, f=studies.block_bootstrap_ci, **k: seen.append(k["n_resamples"]) or f(*a, **k | {"n_resamples": 5}))
    monkeypatch.setattr(studies, "auc_ci", lambda *a, f=studies.auc_ci, **k: seen.append(k["n_resamples"]) or f(*a, **k | {"n_resamples": 5}))
    rows = queries.QUERIES["robustness"](spark, "/root/testdata/sf0.01").collect()
    assert [r["ticker"] for r in rows] == [f"S{i}" for i in range(5)] and set(seen) == {R.BOOTSTRAP_N_RESAMPLES}


def test_family_query_is_the_registered_family(spark):
    rows = {r["name"]: r for r in queries.QUERIES["family"](spark, "/root/testdata/sf0.1").collect()}
    want = {f"{kind}{h}" for kind in ("ofi_forward_h", "sign_autocorr_lag") for h in R.HORIZON_GRID_EVENTS}
    assert want < set(rows) and len(rows) == len(R.FAMILY)
    ps = [r["p_raw"] for r in rows.values()]
    assert all(abs(r["p_adj"] - adj) < 1e-12 for r, adj in zip(rows.values(), bh_reference(ps, R.FDR_ALPHA)[1], strict=True))


def test_every_registered_horizon_has_queries():
    assert {f"ofi_forward_h{h}" for h in R.HORIZON_GRID_EVENTS} < set(queries.QUERIES) and all(f"fwd_ret_{h}" in queries.ORACLES["feature_frame_grid"] for h in R.HORIZON_GRID_EVENTS)


def test_recovery_query_has_all_seeds(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.gate, "recover", lambda spark, *a, f=gate.recover, **k: seen.append((a, k)) or f(spark, *a, **k | {"n_events": 500}))
    curve = queries.QUERIES["recovery"](spark, "").collect()
    assert seen == [((), {})] and {r["beta"]: r["n_seeds"] for r in curve} == dict.fromkeys(gate.BETAS, gate.N_SEEDS)


# --- sessions, strict files, extension points

def test_two_sessions_are_two_series(spark, tmp_path):
    days = ["2012-06-21", "2012-06-22"]
    for k, day in enumerate(days):
        name = lambda kind: str(tmp_path / f"AAPL_{day}_34200000_57600000_{kind}_1.csv")  # noqa: B023, E731
        with open(name("message"), "w") as f:
            f.writelines(f"{34200 + i},{1 if i < 2 else 4},{1 + i % 2},{5 if i < 2 else 2},{110 - 10 * (i % 2) + k},{1 if i % 2 else -1}\n" for i in range(4))
        with open(name("orderbook"), "w") as f:
            f.writelines(f"{110 + k},{5 + i},{100 + k},{3 + i}\n" for i in range(4))
    msg, ob = files.read_messages(spark, str(tmp_path / "*_message_1.csv")), files.read_orderbook(spark, str(tmp_path / "*_orderbook_1.csv"), 1)
    assert files.aligned(msg, ob).count() == 8
    msg, ob = (spark.createDataFrame(x.collect(), x.schema).coalesce(1) for x in (msg, ob))
    single = {day: tuple(x.filter(F.col("session") == day).drop("session") for x in (msg, ob)) for day in days}
    engine = features.PointInTimeFeatureEngine((1,), rv_window=2)
    operators = {
        "primitives": lambda e, b: features.primitives(e, b), "features": engine.compute, "signs": lambda e, b: features.tick_signs(e),
        "replay": lambda e, b: K.replay(e, 1), "seeded": lambda e, b: K.seeded_replay(e, b, 1), "match": lambda e, b: K.seeded_match(e, b, 1),
        "invariant": lambda e, b: K.transition_invariant(e, b, 1), "buckets": lambda e, b: buckets.bucketed(features.primitives(e, b), 2, ("ofi",), ("mid",)),
    }
    for name, f in operators.items():
        got = f(msg, ob)
        for day, (e, b) in single.items():
            alone = f(e, b)
            own = got.filter(F.col("session") == day).select(*alone.columns)
            assert sorted(map(str, own.collect())) == sorted(map(str, alone.collect())) != [], name
    streamed = run_stream(msg, lambda x: streaming_replay(x, 1))
    assert sorted(map(str, streamed.collect())) == sorted(map(str, K.replay(msg, 1).select(*streamed.columns).collect()))
    assert K.differential(K.replay(msg, 1), K.replay(msg, 1), 1).first()["n_rows"] == 8
    assert S.event_faults(msg.withColumn("time_s", F.when(F.col("session") == days[1], F.col("time_s") - 9999).otherwise(F.col("time_s")))).first()["bad_time"] == 0
    with pytest.raises(ValueError, match="session"):
        features.primitives(msg, ob.drop("session"))


@pytest.mark.parametrize("line", ["34201,x,2,3,100,1", "34201,1,2,abc,100,1", "34201,1,2,,100,1", "34201,1,2,3"])
def test_malformed_messages_raise(spark, tmp_path, line):
    path = tmp_path / "A_2012-06-21_1_2_message_1.csv"
    path.write_text(f"34200,1,1,5,100,1\n{line}\n")
    with pytest.raises(Exception, match="not a|unknown value"):
        files.read_messages(spark, str(path)).collect()


@pytest.mark.parametrize("line", ["110,5,x,3", "110,,100,3", "110,5"])
def test_malformed_books_raise(spark, tmp_path, line):
    path = tmp_path / "A_2012-06-21_1_2_orderbook_1.csv"
    path.write_text(f"110,5,100,3\n{line}\n")
    with pytest.raises(Exception, match="not a"):
        files.read_orderbook(spark, str(path), 1).collect()


def test_parts_have_the_protocols(spark):
    from orderlens import protocols as P

    assert isinstance(features.PointInTimeFeatureEngine((1,)), P.Features) and isinstance(OrderFlowSimulator(spark), P.Simulator)
    assert isinstance(estimators.OLSHACEstimator(2), P.Estimator) and isinstance(estimators.LogitEstimator(), P.Estimator)
    assert isinstance(folds.PurgedWalkForwardSplitter(), P.Splitter) and isinstance(fdr.BenjaminiHochbergController(spark), P.Controller)
    assert isinstance(K.replay, P.Replayer) and not isinstance(object(), P.Features)
