"""Book replay in windows, snapshots by an interval join, and comparisons of books.

Order-keyed replay: a submit opens a generation of its order id; within a generation, the running sum of
reductions gives what remains, and its changes are summed by price level. Resubmitting a live id begins a
generation and leaves the old size on its level. Windows are keyed by order and by price level, so they are many small
partitions; only the final join with rows is by symbol, in bins of ``seq``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import book as B
from ..schema import NO_ASK, NO_BID, REDUCTIONS, book_columns
from ..series import by_session

#: Rows of a bin of the interval join.
BIN = 256


@by_session
def order_deltas(events: DataFrame) -> DataFrame:
    """symbol, seq, side, price, delta: what each event adds to a level, by order id.

    Codes other than 1 to 4 and ids that were never submitted change nothing; a reduction takes at most what is left.
    """
    rows = events.filter(F.col("event_type").isin(1, *REDUCTIONS))
    per_id = Window.partitionBy("symbol", "order_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("gen", F.count_if(F.col("event_type") == 1).over(per_id)).filter("gen > 0")
    life = Window.partitionBy("symbol", "order_id", "gen").orderBy("seq")
    so_far = life.rowsBetween(Window.unboundedPreceding, 0)
    taken = F.sum(F.when(F.col("event_type").isin(2, 4), F.col("size")).otherwise(0)).over(so_far)
    gone = F.max((F.col("event_type") == 3).cast("int")).over(so_far) == 1
    rows = rows.select(
        "symbol", "seq", "order_id", "gen", F.first("price").over(so_far).alias("price"), F.first("direction").over(so_far).cast("int").alias("side"),
        F.when(gone, F.lit(0)).otherwise(F.greatest(F.lit(0), F.first("size").over(so_far) - taken)).alias("left"),
    )
    return rows.select("symbol", "seq", "side", "price", (F.col("left") - F.coalesce(F.lag("left").over(life), F.lit(0))).alias("delta"))


@by_session
def level_deltas(events: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """symbol, seq, side, price, delta by the message's own price and side; ``seed`` has levels at the start (seq -1 or 0)."""
    signed = F.when(F.col("event_type") == 1, F.col("size")).otherwise(-F.col("size"))
    rows = events.filter(F.col("event_type").isin(1, *REDUCTIONS)).select("symbol", "seq", F.col("direction").cast("int").alias("side"), "price", signed.alias("delta"))
    return rows if seed is None else rows.unionByName(seed.select("symbol", "seq", "side", "price", F.col("size").alias("delta")))


@by_session
def level_sizes(deltas: DataFrame, clamped: bool = False) -> DataFrame:
    """symbol, side, price, seq, until, size: the sizes of levels over [seq, until); ``until`` NULL for the last.

    ``clamped``: a reduction beyond the size leaves 0, as a running sum less its lowest value below 0.
    """
    level = Window.partitionBy("symbol", "side", "price").orderBy("seq")
    rows = deltas.groupBy("symbol", "side", "price", "seq").agg(F.sum("delta").alias("delta"))
    run = F.sum("delta").over(level.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("run", run)
    if clamped:
        low = F.min("run").over(level.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("run", F.col("run") - F.least(F.lit(0), low))
    return rows.select("symbol", "side", "price", "seq", F.lead("seq").over(level).alias("until"), F.col("run").alias("size"))


@by_session
def snapshots(rows: DataFrame, sizes: DataFrame, levels: int, bin_rows: int = BIN) -> DataFrame:
    """symbol, seq and the best ``levels`` of each side after every row of ``rows``, empty ones as sentinels.

    Level intervals are copied to each bin of rows that they overlap and meet the rows there by an equi-join
    on the bin, in place of a join by range over a whole symbol.
    """
    names = book_columns(levels)
    points = rows.select("symbol", "seq").withColumn("bin", F.floor(F.col("seq") / bin_rows))
    last = points.groupBy("symbol").agg(F.max("bin").alias("last"))
    live = sizes.filter("size > 0").join(last, "symbol")
    begin = F.floor(F.greatest(F.col("seq"), F.lit(0)) / bin_rows)
    end = F.coalesce(F.floor((F.col("until") - 1) / bin_rows), F.col("last"))
    live = live.filter(begin <= F.col("last")).withColumn("bin", F.explode(F.sequence(begin, F.least(end, F.col("last")))))
    live = live.select("symbol", "bin", F.col("seq").alias("since"), "until", "side", "price", "size")
    met = points.join(live, ["symbol", "bin"]).filter((F.col("since") <= F.col("seq")) & (F.col("until").isNull() | (F.col("seq") < F.col("until"))))
    # the best levels of a side: asks by rising price, bids by falling price
    key = F.col("side") * F.col("price")
    best = met.groupBy("symbol", "seq").agg(
        F.slice(F.sort_array(F.collect_list(F.when(F.col("side") < 0, F.struct((-key).alias("k"), "price", "size")))), 1, levels).alias("asks"),
        F.slice(F.sort_array(F.collect_list(F.when(F.col("side") > 0, F.struct((-key).alias("k"), "price", "size")))), 1, levels).alias("bids"),
    )
    out = points.join(best, ["symbol", "seq"], "left")
    columns = []
    for c in names:
        side, what, i = c.split("_")
        level = F.get(F.col(f"{side}s"), int(i) - 1)
        empty = 0 if what == "sz" else NO_ASK if side == "ask" else NO_BID
        columns.append(F.coalesce(level["price" if what == "px" else "size"], F.lit(empty)).cast("long").alias(c))
    return out.select("symbol", "seq", *columns)


@by_session
def replay(events: DataFrame, levels: int, bin_rows: int = BIN) -> DataFrame:
    """The book after every event, from the events alone, by order id."""
    if levels < 1:
        raise ValueError(f"levels must be at least 1, not {levels}")
    return snapshots(events, level_sizes(order_deltas(events)), levels, bin_rows)


@by_session
def seed_levels(book: DataFrame, levels: int) -> DataFrame:
    """symbol, seq, side, price, size of the levels shown in each symbol's first row."""
    first = book.filter("seq = 0")
    rows = [F.struct(F.lit(sign).alias("side"), F.col(f"{side}_px_{i}").alias("price"), F.col(f"{side}_sz_{i}").alias("size")) for i in range(1, levels + 1) for side, sign in (("ask", -1), ("bid", 1))]
    return first.select("symbol", "seq", F.explode(F.array(*rows)).alias("l")).select("symbol", "seq", "l.*").filter(~F.col("price").isin(NO_ASK, NO_BID) & (F.col("size") > 0))


@by_session
def seeded_replay(events: DataFrame, book: DataFrame, levels: int, seed_depth: int | None = None, bin_rows: int = BIN) -> DataFrame:
    """The book by price level from the first row's levels on; the first row is that row itself."""
    deltas = level_deltas(events.filter("seq > 0"), seed_levels(book, seed_depth or levels))
    return snapshots(events, level_sizes(deltas, clamped=True), levels, bin_rows)


@by_session
def both(a: DataFrame, b: DataFrame, levels: int) -> DataFrame:
    """Rows of two books side by side, theirs as ref_*; a ValueError if columns or rows differ."""
    names = book_columns(levels)
    for label, df in (("reconstructed", a), ("reference", b)):
        missing = [c for c in names if c not in df.columns]
        if missing:
            raise ValueError(f"the {label} book lacks {missing}")
    joined = a.select("symbol", "seq", *names, F.lit(1).alias("__a")).join(b.select("symbol", "seq", *[F.col(c).alias(f"ref_{c}") for c in names], F.lit(1).alias("__b")), ["symbol", "seq"], "full")
    off = joined.agg(F.count_if(F.col("__a").isNull() | F.col("__b").isNull()).alias("n")).first()["n"]
    if off:
        raise ValueError(f"{off} rows are in one book only")
    return joined.drop("__a", "__b")


def _same(levels: range, sides: tuple[str, ...] = ("ask", "bid")) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{s}_{w}_{i}") == F.col(f"ref_{s}_{w}_{i}") for i in levels for s in sides for w in ("px", "sz")])


@by_session
def differential(a: DataFrame, b: DataFrame, levels: int) -> DataFrame:
    """One row: n_rows, row_match_rate, cell_match_rate, level_i_match_rate; rates are NULL without rows."""
    rate = lambda c: F.avg(c.cast("double"))
    cells = reduce(lambda x, y: x + y, [(F.col(c) == F.col(f"ref_{c}")).cast("int") for c in book_columns(levels)])
    return both(a, b, levels).agg(
        F.count(F.lit(1)).alias("n_rows"), rate(_same(range(1, levels + 1))).alias("row_match_rate"), F.avg(cells / (4.0 * levels)).alias("cell_match_rate"),
        *[rate(_same(range(i, i + 1))).alias(f"level_{i}_match_rate") for i in range(1, levels + 1)],
    )


@by_session
def mismatches(a: DataFrame, b: DataFrame, levels: int, n: int = 5) -> DataFrame:
    """The first rows that differ, with both sides."""
    names = book_columns(levels)
    rows = both(a, b, levels).filter(~_same(range(1, levels + 1)))
    return rows.select("symbol", "seq", F.struct(*names).alias("reconstructed"), F.struct(*[F.col(f"ref_{c}").alias(c) for c in names]).alias("reference")).orderBy("symbol", "seq").limit(n)


@by_session
def transition_invariant(events: DataFrame, book: DataFrame, levels: int) -> DataFrame:
    """symbol, checked, violations: submits add and reductions take their size where the price shows before and after."""
    names = book_columns(levels)
    w = B.rows_of("symbol")
    rows = events.select("symbol", "seq", "event_type", "size", "price", "direction").join(book.select("symbol", "seq", *names), ["symbol", "seq"])
    rows = rows.select("*", *[F.lag(c).over(w).alias(f"was_{c}") for c in names])
    now = F.when(F.col("direction") > 0, B.size_at("bid", F.col("price"), levels)).otherwise(B.size_at("ask", F.col("price"), levels))
    of = lambda c: F.col(f"was_{c}")
    was = F.when(F.col("direction") > 0, B.size_at("bid", F.col("price"), levels, of)).otherwise(B.size_at("ask", F.col("price"), levels, of))
    rows = rows.filter(F.col("event_type").isin(1, *REDUCTIONS)).select("symbol", (now - was).alias("change"), F.when(F.col("event_type") == 1, F.col("size")).otherwise(-F.col("size")).alias("due"))
    found = rows.filter("change is not null").groupBy("symbol").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("change") != F.col("due")).alias("violations"))
    return events.select("symbol").distinct().join(found, "symbol", "left").select("symbol", F.coalesce("checked", F.lit(0)).alias("checked"), F.coalesce("violations", F.lit(0)).alias("violations"))


@by_session
def seeded_match(events: DataFrame, book: DataFrame, levels: int, reliable: int = 5, bin_rows: int = BIN) -> DataFrame:
    """symbol, n_rows, touch_match, depth_match, exact_prefix of the seeded replay (the first row matches by construction)."""
    depth = min(levels, reliable)
    joined = both(seeded_replay(events, book, levels, bin_rows=bin_rows), book, levels)
    start = F.col("seq") == 0
    touch, deep, whole = (start | _same(range(1, 2)), start | _same(range(1, depth + 1)), start | _same(range(1, levels + 1)))
    return joined.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(touch.cast("double")).alias("touch_match"), F.avg(deep.cast("double")).alias("depth_match"),
        F.coalesce(F.min(F.when(~whole, F.col("seq"))), F.count(F.lit(1))).alias("exact_prefix"),
    )


@by_session
def outside_window(events: DataFrame, book: DataFrame, levels: int) -> DataFrame:
    """Events with ``in_window``: whether the price lies within the prices shown on its side."""
    def shown(side: str, empty: int) -> Column:
        return F.array_compact(F.array(*[F.nullif(F.col(f"{side}_px_{i}"), F.lit(empty)) for i in range(1, levels + 1)]))

    rows = events.join(book.select("symbol", "seq", *book_columns(levels)), ["symbol", "seq"])
    prices = F.when(F.col("direction") > 0, shown("bid", NO_BID)).otherwise(shown("ask", NO_ASK))
    return rows.withColumn("in_window", F.coalesce(F.col("price").between(F.array_min(prices), F.array_max(prices)), F.lit(False))).select(*events.columns, "in_window")
