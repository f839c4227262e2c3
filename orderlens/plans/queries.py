"""Registered queries over the derived order flow, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry as R
from ..functions import book as B
from ..operators import book as K
from ..operators import estimators as E
from ..operators import fdr, folds, gate, studies
from ..operators import resample as Z
from ..operators.buckets import bucketed, with_changes
from ..operators.features import PointInTimeFeatureEngine, primitives, tick_accuracy, tick_signs
from ..schema import NO_ASK, NO_BID, book_columns, event_faults, results_frame
from ..simulate import simulate
from ..streaming.replay import run_stream, streaming_replay
from .flow import FLOW_SQL, KEYED_SQL, SESSION_KEY, TOUCH_SQL, order_flow, touch_book

Query = Callable[[SparkSession, str], DataFrame]

#: Rows of a bucket, horizons and lags that the small tables have rows for; levels of replayed books. The rest of the
#: registered horizons are in ``feature_frame_grid``, ``ofi_forward_h50`` and so on, and the family.
BUCKET, HORIZONS, LAGS, LEVELS = 10, (1, 5, 10, 20), (1, 5, 10, 20, 50), 3
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def prims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return primitives(order_flow(spark, sf_dir), touch_book(spark, sf_dir))


# --- scans and checks

FLOW = f"with {FLOW_SQL} "
BOTH = f"with {FLOW_SQL}, {TOUCH_SQL} "
MID = f"case when ask_px_1 <> {NO_ASK} and bid_px_1 <> {NO_BID} then (ask_px_1 + bid_px_1) / 2.0::double end"
PRESENT = f"(ask_px_1 <> {NO_ASK} and bid_px_1 <> {NO_BID})"


@query(FLOW + "select symbol, seq, time_s, event_type, order_id, size, price, direction from flow")
def event_scan(spark, sf_dir):
    return order_flow(spark, sf_dir)


@query(FLOW + """, f as (select *, coalesce(time_s < lag(time_s) over (partition by symbol order by seq), false) as falls from flow)
select count(*) filter (time_s is null or event_type is null or order_id is null or size is null or price is null or direction is null) as bad_null, count(*) filter (direction not in (-1, 1)) as bad_direction, count(*) filter (size < 0) as bad_size, count(*) filter (falls) as bad_time, count(*) as n_rows from f""")
def event_validation(spark, sf_dir):
    return event_faults(order_flow(spark, sf_dir))


@query(FLOW + "select symbol, event_type, count(*) as n, cast(sum(size) as bigint) as total_size, min(price) as low, max(price) as high from flow where event_type in (4, 5) group by 1, 2")
def executions(spark, sf_dir):
    rows = order_flow(spark, sf_dir).filter(B.is_execution())
    return rows.groupBy("symbol", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total_size"), F.min("price").alias("low"), F.max("price").alias("high"))


# --- row features

@query(f"with {KEYED_SQL}, {TOUCH_SQL} " + f"""select symbol, seq, {MID} as mid, round((bid_sz_1 - ask_sz_1) / nullif(bid_sz_1 + ask_sz_1, 0), 9) as queue_imbalance,
  case when {PRESENT} then cast(ask_px_1 - bid_px_1 as double) end as spread, cast(ask_sz_1 + bid_sz_1 as double) as depth from touch""")
def touch_features(spark, sf_dir):
    book = touch_book(spark, sf_dir)
    return rounded(book.select("symbol", "seq", B.mid().alias("mid"), B.queue_imbalance().alias("queue_imbalance"), B.spread().alias("spread"), B.depth(book.columns).alias("depth")))


@query(FLOW + "select symbol, seq, cast(case when event_type in (4, 5) then -cast(direction as bigint) * size else 0 end as double) as signed_size, cast(-direction as int) as trade_sign from flow")
def signed_size(spark, sf_dir):
    return order_flow(spark, sf_dir).select("symbol", "seq", B.signed_size().alias("signed_size"), B.trade_sign().alias("trade_sign"))


OFI_SQL = f"""steps as (select *, {PRESENT} as ok, lag({PRESENT}) over w as ok0, lag(bid_px_1) over w as b0, lag(bid_sz_1) over w as q0, lag(ask_px_1) over w as a0, lag(ask_sz_1) over w as r0
    from touch window w as (partition by symbol order by seq)),
ofis as (select symbol, seq, case when ok and ok0 then cast((case when bid_px_1 >= b0 then bid_sz_1 else 0 end) - (case when bid_px_1 <= b0 then q0 else 0 end)
    - (case when ask_px_1 <= a0 then ask_sz_1 else 0 end) + (case when ask_px_1 >= a0 then r0 else 0 end) as double) end as ofi, {MID} as mid,
    (bid_sz_1 - ask_sz_1) / nullif(bid_sz_1 + ask_sz_1, 0) as queue_imbalance from steps)"""


@query(f"with {KEYED_SQL}, {TOUCH_SQL}, {OFI_SQL} select symbol, seq, ofi from ofis")
def ofi_increment(spark, sf_dir):
    return touch_book(spark, sf_dir).select("symbol", "seq", B.ofi(B.rows_of()).alias("ofi"))


TICK_SQL = """moves as (select *, sign(price - lag(price) over (partition by symbol order by seq)) as move from flow where event_type in (4, 5)),
ticks as (select symbol, seq, direction, cast(last_value(nullif(move, 0) ignore nulls) over (partition by symbol order by seq rows unbounded preceding) as double) as tick_sign from moves)"""


@query(FLOW + f", {TICK_SQL} select f.symbol, f.seq, t.tick_sign from flow f left join ticks t on f.symbol = t.symbol and f.seq = t.seq")
def tick_sign(spark, sf_dir):
    return tick_signs(order_flow(spark, sf_dir)).select("symbol", "seq", "tick_sign")


@query(ORACLES["tick_sign"])
def tick_sign_chunked(spark, sf_dir):
    return tick_signs(order_flow(spark, sf_dir), chunk=100).select("symbol", "seq", "tick_sign")


@query(FLOW + f""", {TICK_SQL} select symbol, count(*) filter (tick_sign is not null) as n_graded,
  round(avg(case when tick_sign is not null then cast(tick_sign = -direction as int) end), 9) as accuracy from ticks group by symbol""")
def tick_rule_accuracy(spark, sf_dir):
    return rounded(tick_accuracy(order_flow(spark, sf_dir)))


RV = 20


def feature_sql(horizons: Sequence[int]) -> str:
    return BOTH + f""", {OFI_SQL}, {TICK_SQL},
logs as (select symbol, seq, ln({MID}) as lm, {MID} as mid, case when {PRESENT} then cast(ask_px_1 - bid_px_1 as double) end as spread, cast(ask_sz_1 + bid_sz_1 as double) as depth from touch),
rets as (select *, lm - lag(lm) over (partition by symbol order by seq) as r from logs),
feats as (select *, case when count(r) over t = {RV} then sqrt(sum(r * r) over t) end as rv, {", ".join(f"lead(lm, {h}) over w - lm as fwd_ret_{h}" for h in horizons)} from rets
  window w as (partition by symbol order by seq), t as (partition by symbol order by seq rows between {RV - 1} preceding and current row))
select f.symbol, f.seq, f.mid, o.ofi, round(o.queue_imbalance, 9) as queue_imbalance, t.tick_sign, f.depth, f.spread, round(rv, 9) as rv_{RV}, {", ".join(f"round(fwd_ret_{h}, 9) as fwd_ret_{h}" for h in horizons)}
from feats f join ofis o on f.symbol = o.symbol and f.seq = o.seq left join ticks t on f.symbol = t.symbol and f.seq = t.seq"""


FEATURE_SQL = feature_sql(HORIZONS)


@query(FEATURE_SQL)
def feature_frame(spark, sf_dir):
    return rounded(PointInTimeFeatureEngine(HORIZONS, RV).compute(order_flow(spark, sf_dir), touch_book(spark, sf_dir)))


@query(FEATURE_SQL)
def feature_frame_chunked(spark, sf_dir):
    return rounded(PointInTimeFeatureEngine(HORIZONS, RV).compute(order_flow(spark, sf_dir), touch_book(spark, sf_dir), chunk=128))


@query(feature_sql(R.HORIZON_GRID_EVENTS))
def feature_frame_grid(spark, sf_dir):
    """All registered horizons."""
    return rounded(PointInTimeFeatureEngine(R.HORIZON_GRID_EVENTS, RV).compute(order_flow(spark, sf_dir), touch_book(spark, sf_dir)))


# --- buckets and bins

PRIMS_SQL = BOTH + f""", {OFI_SQL}, signed as (select symbol, seq, cast(case when event_type in (4, 5) then -cast(direction as bigint) * size else 0 end as double) as signed_size from flow)"""


def buckets_sql(b: int, name: str = "buckets") -> str:
    return f"""{name}_all as (select o.symbol, o.seq // {b} as bucket, count(*) as n, sum(coalesce(ofi, 0)) as ofi, sum(signed_size) as signed_size, max_by(ln(mid), o.seq) filter (o.seq % {b} = {b - 1} and mid is not null) as lc,
  max_by(queue_imbalance, o.seq) filter (o.seq % {b} = {b - 1}) as qi from ofis o join signed s on o.symbol = s.symbol and o.seq = s.seq group by 1, 2),
{name}_full as (select * from {name}_all where n = {b}),
{name} as (select *, lc - lag(lc) over w as change, lead(lc) over w - lc as next_change from {name}_full window w as (partition by symbol order by bucket))"""


@query(PRIMS_SQL + f", {buckets_sql(BUCKET)} select symbol, bucket, ofi, signed_size, round(change, 12) as change, round(next_change, 12) as next_change from buckets")
def bucket_changes(spark, sf_dir):
    b = with_changes(bucketed(prims(spark, sf_dir), BUCKET, ("ofi", "signed_size"), ("mid",)))
    return rounded(b.select("symbol", "bucket", "ofi", "signed_size", "change", "next_change"), 12)


@query(PRIMS_SQL + f""", {buckets_sql(BUCKET)}, p as (select abs(signed_size) as v, abs(change) as m from buckets where change is not null and signed_size <> 0),
e as (select list_sort(list_distinct(quantile_cont(v, [{", ".join(f"{i / 10}" for i in range(11))}]))) as edges from p),
b as (select v, m, least(len(list_filter(edges[2:-2], lambda x: x <= v)), len(edges) - 2) as bin from p, e)
select cast(bin as int) as bin, round(avg(v), 9) as x_mean, round(avg(m), 12) as y_mean, round(stddev_samp(m) / sqrt(count(*)), 12) as y_se, count(*) as n from b group by 1 having count(*) >= 5""")
def impact_bins(spark, sf_dir):
    bins = studies.binned(studies.pairs_impact(prims(spark, sf_dir), BUCKET), "volume", "move", 10, studies.MIN_BIN)
    return bins.select(F.col("bin").cast("int").alias("bin"), F.round("x_mean", 9).alias("x_mean"), F.round("y_mean", 12).alias("y_mean"), F.round("y_se", 12).alias("y_se"), "n")


@query(PRIMS_SQL + f""", {buckets_sql(BUCKET)}, p as (select ofi as v, change as m from buckets where change is not null),
e as (select list_sort(list_distinct(quantile_cont(v, [{", ".join(f"{i / 20}" for i in range(21))}]))) as edges from p),
b as (select v, m, least(len(list_filter(edges[2:-2], lambda x: x <= v)), len(edges) - 2) as bin from p, e)
select round(avg(v), 9) as ofi_mean, round(avg(m), 12) as ret_mean, round(stddev_samp(m) / sqrt(count(*)), 12) as ret_se, count(*) as n from b group by bin""")
def linearity_bins(spark, sf_dir):
    t = studies.linearity(prims(spark, sf_dir), BUCKET)
    return t.select(F.round("ofi_mean", 9).alias("ofi_mean"), F.round("ret_mean", 12).alias("ret_mean"), F.round("ret_se", 12).alias("ret_se"), "n")


@query(PRIMS_SQL + f""", {buckets_sql(BUCKET)} select round(regr_slope(change, ofi) * 1e6, 9) as slope, round(regr_intercept(change, ofi) * 1e6, 9) as intercept, round(regr_r2(change, ofi), 9) as r2, count(*) as n,
  {BUCKET} as bucket from buckets where change is not null""")
def linear_fit(spark, sf_dir):
    t = studies.linear_fit(prims(spark, sf_dir), BUCKET)
    return t.select(F.round(F.col("slope") * 1e6, 9).alias("slope"), F.round(F.col("intercept") * 1e6, 9).alias("intercept"), F.round("r2", 9).alias("r2"), "n", "bucket")


# --- estimators

def hac_sql(pairs: str, lags: int) -> str:
    """Slope and its error for a table of row, x, y: centred sums, and lagged products of scores."""
    return f"""m as (select avg(x) as mx, avg(y) as my, count(*) as n from {pairs}),
c as (select row, x - mx as x, y - my as y from {pairs}, m), s as (select sum(x * x) as xx, sum(x * y) / sum(x * x) as b, sum(y * y) as yy from c),
z as (select row, x * (y - b * x) as z, (y - b * x) * (y - b * x) as uu from c, s),
l as (select z, uu, {" + ".join(f"coalesce(lag(z, {k}) over w, 0) * {1 - k / (lags + 1)!r}::double" for k in range(1, lags + 1))} as v from z window w as (order by row)),
g as (select sum(z * z) + 2 * sum(z * v) as meat, sum(uu) as uu from l),
fit as (select b as slope, sqrt(meat) / xx as se, 1 - uu / yy as r2, n from s, g, m)"""


def estimate_row(spark: SparkSession, results) -> DataFrame:
    """name, slope and error in millionths, r2, n_obs of regressions."""
    rows = [(r.name, r.point * 1e6, r.std_error * 1e6, r.extra["r2"], int(r.n_obs)) for r in results]
    return rounded(spark.createDataFrame(rows, "name string, slope double, se double, r2 double, n_obs long"), 9)


def fit_sql(name: str, table: str = "fit") -> str:
    return f"select '{name}' as name, round(slope * 1e6, 9) as slope, round(se * 1e6, 9) as se, round(r2, 9) as r2, n as n_obs from {table}"


@query(PRIMS_SQL + f", {buckets_sql(BUCKET)}, pairs as (select row_number() over (order by symbol, bucket) - 1 as row, ofi as x, change as y from buckets where change is not null), {hac_sql('pairs', 10)} {fit_sql('ofi_contemporaneous')}")
def ofi_contemporaneous_hac(spark, sf_dir):
    pairs = studies.pairs_contemporaneous(prims(spark, sf_dir), BUCKET)
    return estimate_row(spark, [E.ols_hac(pairs, "y", "x", name="ofi_contemporaneous", lags=10, chunk=500)])


def forward_sql(h: int) -> str:
    embargo = max(1, -(-R.CV_EMBARGO_EVENTS // h))
    return PRIMS_SQL + f""", {buckets_sql(h)}, known as (select symbol, bucket, ofi as x, next_change as y, row_number() over (partition by symbol order by bucket) - 1 as i, count(*) over (partition by symbol) as n from buckets where next_change is not null),
cut as (select symbol, n, fold, fold * n // {R.CV_N_FOLDS} as lo, (fold + 1) * n // {R.CV_N_FOLDS} as hi from (select distinct symbol, n from known), range({R.CV_N_FOLDS}) t(fold)),
ok as (select * from cut where greatest(0, lo - {embargo}) >= {studies.MIN_TRAIN} and hi - lo >= {studies.MIN_TEST}),
pairs as (select row_number() over (order by k.symbol, fold, bucket) - 1 as row, x, y from known k join ok on k.symbol = ok.symbol and i >= lo and i < hi), {hac_sql('pairs', min(2 * h, 50))} {fit_sql(f'ofi_forward_h{h}')}"""


def _forward(h: int) -> Query:
    def run(spark, sf_dir):
        return estimate_row(spark, studies.ofi_forward(prims(spark, sf_dir), [h]))

    run.__name__ = f"ofi_forward_h{h}"
    # a table without a usable fold at a long horizon has no row
    return query(forward_sql(h) + ("" if h in HORIZONS else " where n > 0"))(run)


for _h in R.HORIZON_GRID_EVENTS:
    _forward(_h)


CORR_SQL = "0.5 * ln((1 + r) / (1 - r))"


def ic_sql(r: str, pairs: str) -> str:
    half = "1.959963984540054::double / sqrt(n - 3)"
    tanh = lambda x: f"((exp(2 * ({x})) - 1) / (exp(2 * ({x})) + 1))"
    return f"ic as (select {r} as r, count(*) as n from {pairs}) select round(r, 9) as point, round({tanh(f'{CORR_SQL} - {half}')}, 9) as ci_low, round({tanh(f'{CORR_SQL} + {half}')}, 9) as ci_high, n as n_obs from ic"


def ic_row(spark, r):
    return rounded(spark.createDataFrame([(r.point, r.ci_low, r.ci_high, int(r.n_obs))], "point double, ci_low double, ci_high double, n_obs long"))


@query(PRIMS_SQL + f", {buckets_sql(BUCKET)}, {ic_sql('corr(ofi, change)', '(select ofi, change from buckets where change is not null)')}")
def pearson_ic(spark, sf_dir):
    return ic_row(spark, E.information_coefficient(studies.pairs_contemporaneous(prims(spark, sf_dir), BUCKET), "x", "y", name="ic"))


@query(PRIMS_SQL + f""", {buckets_sql(BUCKET)}, ranked as (select rank() over (order by ofi) + (count(*) over (partition by ofi) - 1) / 2.0::double as a, rank() over (order by change) + (count(*) over (partition by change) - 1) / 2.0::double as b
  from buckets where change is not null), {ic_sql('corr(a, b)', 'ranked')}""")
def spearman_ic(spark, sf_dir):
    return ic_row(spark, E.information_coefficient(studies.pairs_contemporaneous(prims(spark, sf_dir), BUCKET), "x", "y", name="ic", method="spearman"))


@query(PRIMS_SQL + f""", {buckets_sql(BUCKET)}, q as (select qi, cast(next_change > 0 as int) as l from buckets where qi is not null and next_change <> 0),
r as (select l, rank() over (order by qi) + (count(*) over (partition by qi) - 1) / 2.0::double as k from q)
select round((sum(k * l) - sum(l) * (sum(l) + 1) / 2.0::double) / (sum(l) * (count(*) - sum(l))), 9) as auc, cast(sum(l) as bigint) as ups, count(*) as n_obs from r""")
def queue_auc(spark, sf_dir):
    pairs = studies.pairs_queue(prims(spark, sf_dir), BUCKET)
    point = E.auc(pairs, "score", "label")
    return pairs.agg(F.round(F.lit(point), 9).alias("auc"), F.sum("label").cast("long").alias("ups"), F.count(F.lit(1)).alias("n_obs"))


@query("""select round((sum(k * l) - sum(l) * (sum(l) + 1) / 2.0::double) / (sum(l) * (count(*) - sum(l))), 9) as auc, count(*) as n_obs
from (select quality as l, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0::double as k from labels join documents using (doc_id))""")
def quality_auc(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars"), "doc_id")
    return rows.agg(F.round(F.lit(E.auc(rows, "n_chars", "quality")), 9).alias("auc"), F.count(F.lit(1)).alias("n_obs"))


LEAST_SIGNS = max(LAGS) + 10
ACF_SQL = FLOW + f""", {TICK_SQL}, known as (select symbol, seq, tick_sign as x, count(*) over (partition by symbol) as n, avg(tick_sign) over (partition by symbol) as m from ticks where tick_sign is not null),
dev as (select symbol, n, x - m as a, row_number() over (partition by symbol order by seq) as i from known where n > {LEAST_SIGNS}),
pairs as (select d.symbol, d.n, e.i - d.i as lag, sum(d.a * e.a) as s from dev d join dev e on d.symbol = e.symbol and e.i > d.i and e.i - d.i <= {max(LAGS)} group by 1, 2, 3),
acf as (select p.symbol, lag, s / ss as r, n from pairs p join (select symbol, sum(a * a) as ss from dev group by 1) using (symbol)),
bart as (select *, case when n > lag + 1 then sqrt((1 + 2 * coalesce(sum(r * r) over (partition by symbol order by lag rows between unbounded preceding and 1 preceding), 0)) / n) end as se from acf)"""


@query(ACF_SQL + " select symbol, cast(lag as int) as lag, round(r, 9) as r, n, round(se, 9) as se, round(r - 1.959963984540054::double * se, 9) as ci_low, round(r + 1.959963984540054::double * se, 9) as ci_high from bart")
def sign_acf(spark, sf_dir):
    signs = studies.sign_series(prims(spark, sf_dir), LEAST_SIGNS)
    return rounded(E.bartlett(E.acf(signs, "sign", max(LAGS), chunk=200)).withColumn("lag", F.col("lag").cast("int")))


@query(ACF_SQL + f""" select cast(lag as int) as lag, round(sum(n * r) / sum(n), 9) as point, round(sqrt(sum(n * n * se * se)) / sum(n), 9) as se, cast(sum(n) as bigint) as n_obs, count(*) as n_symbols
from bart where lag in ({", ".join(map(str, LAGS))}) group by 1""")
def sign_acf_weighted(spark, sf_dir):
    signs = studies.sign_series(prims(spark, sf_dir), LEAST_SIGNS)
    per_symbol = E.bartlett(E.acf(signs, "sign", max(LAGS))).filter(F.col("lag").isin(*LAGS))
    return rounded(studies.weighted_acf(per_symbol).withColumn("lag", F.col("lag").cast("int")))


# --- folds and leakage

def folds_sql(mode: str) -> str:
    gap = max(FOLD_H, FOLD_E)
    after = "n" if mode == "walkforward" else f"least(n, hi + {gap})"
    return FLOW + f""", c as (select symbol, count(*) as n from flow group by 1), cut as (select symbol, n, fold, fold * n // 5 as lo, (fold + 1) * n // 5 as hi from c, range(5) t(fold)),
b as (select symbol, cast(fold as int) as fold, n, lo as test_lo, hi as test_hi, greatest(0, lo - {gap}) as train_end, {after} as train_from from cut where hi > lo), bounds as (select * from b where train_end + n - train_from > 0)"""


FOLD_H, FOLD_E = 5, 20


def _bounds(spark, sf_dir, mode):
    counts = {r["symbol"]: r["count"] for r in order_flow(spark, sf_dir).groupBy("symbol").count().collect()}
    return folds.PurgedWalkForwardSplitter(5, mode).bounds(spark, counts, FOLD_H, FOLD_E)


@query(folds_sql("walkforward") + " select * from bounds")
def fold_bounds_walkforward(spark, sf_dir):
    return _bounds(spark, sf_dir, "walkforward")


@query(folds_sql("purged_kfold") + " select * from bounds")
def fold_bounds_purged(spark, sf_dir):
    return _bounds(spark, sf_dir, "purged_kfold")


def _parts(spark, sf_dir):
    rows = order_flow(spark, sf_dir).select("symbol", F.col("seq").alias("row"))
    return folds.members(rows, _bounds(spark, sf_dir, "purged_kfold"))


PARTS_SQL = folds_sql("purged_kfold") + """, parts as (select f.symbol, f.seq as row, b.fold, case when f.seq >= test_lo and f.seq < test_hi then 'test' else 'train' end as part
  from flow f join bounds b on f.symbol = b.symbol and (f.seq >= test_lo and f.seq < test_hi or f.seq < train_end or f.seq >= train_from))"""


@query(PARTS_SQL + " select symbol, fold, part, count(*) as n, min(row) as first_row, max(row) as last_row from parts group by 1, 2, 3")
def fold_assignment(spark, sf_dir):
    return _parts(spark, sf_dir).groupBy("symbol", "fold", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))


def leak_sql(condition: str) -> str:
    return PARTS_SQL + f""", blocks as (select symbol, fold, min(row) as lo, max(row) as hi from parts where part = 'test' group by 1, 2)
select p.symbol, p.fold, count(*) as n from parts p join blocks b on p.symbol = b.symbol and p.fold = b.fold where part = 'train' and ({condition}) group by 1, 2"""


def _leaks(spark, sf_dir, label_horizon, embargo, kind):
    """symbol, fold, n of a kind of finding, for every symbol."""
    return folds.audit(spark, _parts(spark, sf_dir), label_horizon, embargo).filter(F.col("kind") == kind).select("symbol", "fold", F.col("count").alias("n"))


@query(leak_sql("row + 40 >= lo and row <= hi"))
def label_overlap(spark, sf_dir):
    return _leaks(spark, sf_dir, 40, 0, "label_overlap")


@query(leak_sql("(row >= lo - 30 and row < lo) or (row > hi and row <= hi + 30)"))
def embargo_breach(spark, sf_dir):
    return _leaks(spark, sf_dir, 0, 30, "embargo_breach")


# --- false discoveries

P_SQL = "p as (select event_type as family, user_id as name, case when count(*) % 7 = 0 then null else (sum(event_id) * 7919 % 100003) / 100003.0::double * (case when user_id % 3 = 0 then 0.001 else 1 end) end as p_raw from events group by 1, 2)"


@query(f"""with {P_SQL}, r as (select *, row_number() over (partition by family order by p_raw, name) as k, count(*) over (partition by family) as m from p where p_raw is not null),
l as (select *, coalesce(max(case when p_raw <= k / m::double * 0.05 then k end) over (partition by family), 0) as last, least(1, min(p_raw * m / k) over (partition by family order by k desc)) as p_adj from r)
select p.family, p.name, round(p.p_raw, 12) as p_raw, round(l.p_adj, 12) as p_adj, l.k <= l.last as rejected from p left join l on p.family = l.family and p.name = l.name""")
def bh_adjust(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    p = (F.sum("event_id") * 7919 % 100003) / F.lit(100003.0) * F.when(F.col("user_id") % 3 == 0, 0.001).otherwise(1.0)
    tests = e.groupBy(F.col("event_type").alias("family"), "user_id").agg(F.when(F.count(F.lit(1)) % 7 != 0, p).alias("p_raw")).withColumnRenamed("user_id", "name")
    return rounded(fdr.benjamini_hochberg(tests, family="family").select("family", "name", "p_raw", "p_adj", "rejected"), 12)


# --- replay

REPLAY_SQL = FLOW + """, g as (select *, count(*) filter (event_type = 1) over (partition by symbol, order_id order by seq rows unbounded preceding) as gen from flow where event_type between 1 and 4),
o as (select symbol, seq, order_id, gen, first_value(price) over w as price, cast(first_value(direction) over w as int) as side,
  case when max(cast(event_type = 3 as int)) over w = 1 then 0 else greatest(0, first_value(size) over w - sum(case when event_type in (2, 4) then size else 0 end) over w) end as rest
  from g where gen > 0 window w as (partition by symbol, order_id, gen order by seq rows unbounded preceding)),
d as (select symbol, seq, side, price, rest - coalesce(lag(rest) over (partition by symbol, order_id, gen order by seq), 0) as delta from o),
v as (select symbol, side, price, seq as since, lead(seq) over w as until, sum(delta) over (partition by symbol, side, price order by seq rows unbounded preceding) as size from d window w as (partition by symbol, side, price order by seq))"""


def snapshot_sql(levels: int, name: str = "snap") -> str:
    columns = ", ".join(
        f"cast(coalesce(max(l.{'price' if w == 'px' else 'size'}) filter (l.side = {-1 if s == 'ask' else 1} and l.k = {i}), {(NO_ASK if s == 'ask' else NO_BID) if w == 'px' else 0}) as bigint) as {s}_{w}_{i}"
        for i in range(1, levels + 1) for s in ("ask", "bid") for w in ("px", "sz")
    )
    return f"""live as (select f.symbol, f.seq, v.side, v.price, v.size, row_number() over (partition by f.symbol, f.seq, v.side order by -v.side * v.price) as k
  from flow f join v on f.symbol = v.symbol and v.since <= f.seq and (v.until is null or f.seq < v.until) where v.size > 0),
{name} as (select f.symbol, f.seq, {columns} from flow f left join live l on f.symbol = l.symbol and f.seq = l.seq group by 1, 2)"""


@query(REPLAY_SQL + f", {snapshot_sql(LEVELS)} select * from snap")
def book_replay(spark, sf_dir):
    return K.replay(order_flow(spark, sf_dir), LEVELS)


@query(REPLAY_SQL + f", {snapshot_sql(LEVELS)} select * from snap")
def book_replay_stream(spark, sf_dir):
    return run_stream(order_flow(spark, sf_dir), lambda events: streaming_replay(events, LEVELS))


SEEDED_SQL = REPLAY_SQL.replace("v as (", "v0 as (") + f""", {snapshot_sql(LEVELS, "ref").replace("join v on", "join v0 v on").replace("live as", "live0 as").replace("join live l", "join live0 l")},
seed as (select symbol, seq, u.side, u.price, u.size from ref, unnest([{", ".join(f"{{'side': {-1 if s == 'ask' else 1}, 'price': {s}_px_{i}, 'size': {s}_sz_{i}}}" for i in range(1, LEVELS + 1) for s in ("ask", "bid"))}]) t(u) where seq = 0 and u.size > 0),
ld as (select symbol, seq, side, price, size as delta from seed union all select symbol, seq, cast(direction as int), price, case when event_type = 1 then size else -size end from flow where event_type between 1 and 4 and seq > 0),
run as (select symbol, side, price, seq, sum(delta) over (partition by symbol, side, price order by seq rows unbounded preceding) as c from ld),
v as (select symbol, side, price, seq as since, lead(seq) over w as until, c - least(0, min(c) over (partition by symbol, side, price order by seq rows unbounded preceding)) as size from run window w as (partition by symbol, side, price order by seq)),
{snapshot_sql(LEVELS)}"""


@query(SEEDED_SQL + " select * from snap")
def book_level_replay(spark, sf_dir):
    events = order_flow(spark, sf_dir)
    return K.seeded_replay(events, K.replay(events, LEVELS), LEVELS)


def _same_sql(levels, sides=("ask", "bid")) -> str:
    return " and ".join(f"a.{s}_{w}_{i} = b.{s}_{w}_{i}" for i in levels for s in sides for w in ("px", "sz"))


@query(SEEDED_SQL + f""" select count(*) as n_rows, round(avg(cast({_same_sql(range(1, LEVELS + 1))} as int)), 9) as row_match_rate,
  round(avg(({" + ".join(f"cast(a.{c} = b.{c} as int)" for c in book_columns(LEVELS))}) / {4.0 * LEVELS}::double), 9) as cell_match_rate,
  {", ".join(f"round(avg(cast({_same_sql(range(i, i + 1))} as int)), 9) as level_{i}_match_rate" for i in range(1, LEVELS + 1))} from snap a join ref b on a.symbol = b.symbol and a.seq = b.seq""")
def book_differential(spark, sf_dir):
    events = order_flow(spark, sf_dir)
    whole = K.replay(events, LEVELS)
    return rounded(K.differential(K.seeded_replay(events, whole, LEVELS), whole, LEVELS))


@query(SEEDED_SQL + f""", j as (select a.symbol, a.seq, a.seq = 0 or ({_same_sql(range(1, 2))}) as t, a.seq = 0 or ({_same_sql(range(1, LEVELS + 1))}) as d from snap a join ref b on a.symbol = b.symbol and a.seq = b.seq)
select symbol, count(*) as n_rows, round(avg(cast(t as int)), 9) as touch_match, round(avg(cast(d as int)), 9) as depth_match, coalesce(min(seq) filter (not d), count(*)) as exact_prefix from j group by 1""")
def seeded_match(spark, sf_dir):
    events = order_flow(spark, sf_dir)
    return rounded(K.seeded_match(events, K.replay(events, LEVELS), LEVELS))


def _size_at_sql(prefix: str) -> str:
    side = lambda s: "coalesce(" + ", ".join(f"case when {prefix}{s}_px_{i} = price then {prefix}{s}_sz_{i} end" for i in range(1, LEVELS + 1)) + ")"
    return f"case when direction > 0 then {side('bid')} else {side('ask')} end"


@query(REPLAY_SQL + f""", {snapshot_sql(LEVELS)}, w as (select f.symbol, f.event_type, f.size, f.price, f.direction, s.*, {", ".join(f"lag({c}) over (partition by f.symbol order by f.seq) as was_{c}" for c in book_columns(LEVELS))}
  from flow f join (select symbol as sy, seq as sq, {", ".join(book_columns(LEVELS))} from snap) s on f.symbol = s.sy and f.seq = s.sq),
x as (select symbol, ({_size_at_sql("")}) - ({_size_at_sql("was_")}) as change, case when event_type = 1 then size else -size end as due from w where event_type between 1 and 4)
select symbol, count(change) as checked, count(*) filter (change <> due) as violations from x group by 1""")
def transition_invariant(spark, sf_dir):
    events = order_flow(spark, sf_dir)
    return K.transition_invariant(events, K.replay(events, LEVELS), LEVELS)


# --- sessions: numbering, windows and joins within a symbol's session

def by_session_sql(sql: str, columns: str) -> str:
    """The SQL with sessions in the key, which its last select parts again."""
    return f"select split_part(symbol, '|', 1) as symbol, split_part(symbol, '|', 2) as session, {columns} from ({sql.replace(*SESSION_KEY)})"


@query(by_session_sql(PRIMS_SQL + f""", {TICK_SQL} select o.symbol, o.seq, o.mid, o.ofi, s.signed_size, t.tick_sign, round(o.queue_imbalance, 9) as queue_imbalance
from ofis o join signed s on o.symbol = s.symbol and o.seq = s.seq left join ticks t on o.symbol = t.symbol and o.seq = t.seq""", "seq, mid, ofi, signed_size, tick_sign, queue_imbalance"))
def session_primitives(spark, sf_dir):
    return rounded(primitives(order_flow(spark, sf_dir, True), touch_book(spark, sf_dir, True)))


@query(by_session_sql(REPLAY_SQL + f", {snapshot_sql(LEVELS)} select * from snap", "seq, " + ", ".join(book_columns(LEVELS))))
def session_book_replay(spark, sf_dir):
    return K.replay(order_flow(spark, sf_dir, True), LEVELS)


@query(by_session_sql(PRIMS_SQL + f", {buckets_sql(BUCKET)} select symbol, bucket, ofi, round(change, 12) as change from buckets", "bucket, ofi, change"))
def session_buckets(spark, sf_dir):
    b = with_changes(bucketed(primitives(order_flow(spark, sf_dir, True), touch_book(spark, sf_dir, True)), BUCKET, ("ofi",), ("mid",)))
    return rounded(b.select("symbol", "session", "bucket", "ofi", "change"), 12)


# --- the gate against a shown book: the touch book, which no replay made

def gate_sql() -> str:
    one = book_columns(1)
    size = "case when direction > 0 then case when {0}bid_px_1 = price then {0}bid_sz_1 end else case when {0}ask_px_1 = price then {0}ask_sz_1 end end"
    same = " and ".join(f"a.{c} = t.{c}" for c in one)
    alone = snapshot_sql(1, "alone").replace("join v on", "join v0 v on").replace("live as", "live0 as").replace("join live l", "join live0 l")
    return BOTH + REPLAY_SQL[len(FLOW) :].replace("v as (", "v0 as (") + f""", {alone},
seed as (select symbol, seq, -1 as side, ask_px_1 as price, ask_sz_1 as size from touch where seq = 0 and ask_sz_1 > 0 and ask_px_1 <> {NO_ASK}
  union all select symbol, seq, 1, bid_px_1, bid_sz_1 from touch where seq = 0 and bid_sz_1 > 0 and bid_px_1 <> {NO_BID}),
ld as (select symbol, seq, side, price, size as delta from seed union all select symbol, seq, cast(direction as int), price, case when event_type = 1 then size else -size end from flow where event_type between 1 and 4 and seq > 0),
run as (select symbol, side, price, seq, sum(delta) over (partition by symbol, side, price order by seq rows unbounded preceding) as c from ld),
v as (select symbol, side, price, seq as since, lead(seq) over w as until, c - least(0, min(c) over (partition by symbol, side, price order by seq rows unbounded preceding)) as size from run window w as (partition by symbol, side, price order by seq)),
{snapshot_sql(1)},
w as (select f.event_type, f.size, f.price, f.direction, t.*, {", ".join(f"lag({c}) over (partition by t.symbol order by t.seq) as was_{c}" for c in one)} from flow f join touch t on f.symbol = t.symbol and f.seq = t.seq),
x as (select symbol, ({size.format("")}) - ({size.format("was_")}) as change, case when event_type = 1 then size else -size end as due from w where event_type between 1 and 4),
i as (select symbol, count(change) as checked, count(*) filter (change <> due) as violations from x group by 1),
j as (select t.symbol, t.seq, t.seq = 0 or ({same}) as hit from touch t join snap a on a.symbol = t.symbol and a.seq = t.seq),
k as (select symbol, count(*) as n_rows, round(avg(cast(hit as int)), 9) as touch_match, round(avg(cast(hit as int)), 9) as depth_match, coalesce(min(seq) filter (not hit), count(*)) as exact_prefix from j group by 1),
m as (select t.symbol, round(avg(cast({same} as int)), 9) as message_only_row_match, round(avg(({" + ".join(f"cast(a.{c} = t.{c} as int)" for c in one)}) / 4.0::double), 9) as message_only_cell_match
  from touch t join alone a on a.symbol = t.symbol and a.seq = t.seq group by 1)
select k.symbol, coalesce(checked, 0) as checked, coalesce(violations, 0) as violations, n_rows, touch_match, depth_match, exact_prefix, message_only_row_match, message_only_cell_match
from k join m on k.symbol = m.symbol left join i on k.symbol = i.symbol"""


@query(gate_sql())
def reconstruction_gate(spark, sf_dir):
    return rounded(gate.reconstruct(order_flow(spark, sf_dir), touch_book(spark, sf_dir), 1))


@query(PRIMS_SQL + f""", {buckets_sql(BUCKET)}, p as (select abs(signed_size) as v, abs(change) as m from buckets where change is not null and signed_size <> 0),
e as (select list_sort(list_distinct(quantile_cont(v, [{", ".join(f"{i / 10}" for i in range(11))}]))) as edges from p),
b as (select v, m, least(len(list_filter(edges[2:-2], lambda x: x <= v)), len(edges) - 2) as bin from p, e),
pts as (select row_number() over (order by bin) - 1 as row, ln(avg(v)) as x, ln(avg(m)) as y from b group by bin having count(*) >= {studies.MIN_BIN} and avg(v) > 0 and avg(m) > 0), {hac_sql("pts", 2)}
select 'impact_curve' as name, round(slope, 9) as exponent, round(se, 9) as se, round(r2, 9) as r2, n as n_bins, (select count(*) from p) as n_obs from fit""")
def impact_exponent(spark, sf_dir):
    r = studies.impact_curve(prims(spark, sf_dir), BUCKET, 10)
    rows = [(r.name, r.point, r.std_error, r.extra["r2"], int(r.extra["n_bins"]), int(r.extra["n_obs"]))]
    return rounded(spark.createDataFrame(rows, "name string, exponent double, se double, r2 double, n_bins long, n_obs long"))


# --- what SQL can't express

@query()
def family(spark, sf_dir):
    """The registered family; a horizon without a usable fold, or lags without a symbol of enough trades, have no row."""
    return studies.family_table(studies.run_family(prims(spark, sf_dir)), spark)


@query()
def queue_auc_bootstrap(spark, sf_dir):
    pairs = studies.pairs_queue(prims(spark, sf_dir), BUCKET)
    return results_frame(spark, [Z.auc_ci(pairs, "score", "label", name="queue_auc", n_resamples=200, block=50)])


@query()
def r2_bootstrap(spark, sf_dir):
    return results_frame(spark, [studies.ofi_contemporaneous(prims(spark, sf_dir), BUCKET, n_resamples=200)[1]])


@query()
def quality_logit(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.col("n_chars") / 1000).alias("kchars")), "doc_id")
    return results_frame(spark, [E.logit_coef(rows, "quality", "kchars", name="quality_logit")])


@query()
def robustness(spark, sf_dir):
    rows = studies.robustness(prims(spark, sf_dir))
    return spark.createDataFrame(rows, "ticker string, ofi_R2 double, ofi_R2_lo double, ofi_R2_hi double, ofi_slope double, qi_auc double, qi_auc_lo double, qi_auc_hi double")


@query()
def simulated_flow(spark, sf_dir):
    return simulate(spark, 2000, [1, 2], [0.0, 3e-4])


@query()
def recovery(spark, sf_dir):
    return gate.recovery_curve(gate.recover(spark))
