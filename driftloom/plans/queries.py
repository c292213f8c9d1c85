"""Queries over the star-schema tables, one for each operator that they can show, with SQL where it can say the same.

Floats are rounded to six decimals on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import fold, panel as P, resample as R, series as W, spread as X, trades as M
from driftloom.plans.sql import query as sql
from driftloom.sources import market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CAPITAL = 10_000.0
RULES = fold.Rules(1.0, 0.0, 2.0)
GRID = [fold.Rules(float(a), 0.0, float(a + 1)) for a in range(1, 6)]
GRID_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{a}/0/{a + 1}', {a}.0, {a + 1}.0)" for a in range(1, 6)) + ") g(param, entry, stop)"


def register(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def r6(*columns: str) -> list:
    """Rounded columns; -0.0 becomes 0.0."""
    return [(F.round(c, 6) + 0.0).alias(c) for c in columns]


def s6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


def r4(*columns: str) -> list:
    """For columns of the size of prices."""
    return [(F.round(c, 4) + 0.0).alias(c) for c in columns]


def s4(*columns: str) -> str:
    return ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in columns)


def panel(spark: SparkSession, d: str) -> DataFrame:
    return market.daily_panel(spark, d)


def signals(spark: SparkSession, d: str) -> DataFrame:
    return X.signals(P.pair_frame(panel(spark, d)), 60)


def deals(spark: SparkSession, d: str, rules: list | None = None) -> DataFrame:
    return fold.strategy_trades(signals(spark, d), rules or [RULES])


def ledger(spark: SparkSession, d: str, rules: list | None = None) -> DataFrame:
    return M.with_pnl(deals(spark, d, rules), CAPITAL, 0.001)


# ---- bars ----


@register("ohlcv_resample", sql("""SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS bar, arg_min(price, struct_pack(a := ts, b := id)) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, struct_pack(a := ts, b := id)) AS close, sum(amount) AS volume FROM ticks GROUP BY 1, 2"""))
def ohlcv_resample(spark, d):
    return R.ohlcv(market.event_ticks(spark, d), "4 hours")


@register("tick_resample", sql("""SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS bar, arg_max(price, struct_pack(a := ts, b := id)) AS price, sum(amount) AS amount,
    arg_max(side, struct_pack(a := ts, b := id)) AS side FROM ticks GROUP BY 1, 2"""))
def tick_resample(spark, d):
    return R.tick_bars(market.event_ticks(spark, d), "1 hour")


@register("book_resample", sql("SELECT symbol, time_bucket(INTERVAL '1 minute', ts) AS bar, " + ", ".join(f"round(arg_max({c}, struct_pack(a := ts, b := id)), 6) AS {c}" for c in ("bid", "ask", "bid_amount", "ask_amount")) + " FROM book GROUP BY 1, 2"))
def book_resample(spark, d):
    return R.book_bars(market.event_book(spark, d)).select("symbol", "bar", *r6("bid", "ask", "bid_amount", "ask_amount"))


MULTI = (("15 minutes", "15 minutes"), ("30 minutes", "30 minutes"), ("1 hour", "1 hour"), ("4 hours", "4 hours"), ("1 day", "1 day"))


@register("multi_freq", sql(" UNION ALL ".join(f"""SELECT '{a}' AS width, g.symbol, g.bar, o.price FROM (SELECT symbol, unnest(generate_series(min(time_bucket(INTERVAL '{b}', ts)), max(time_bucket(INTERVAL '{b}', ts)),
    INTERVAL '{b}')) AS bar FROM ticks GROUP BY 1) g LEFT JOIN (SELECT symbol, time_bucket(INTERVAL '{b}', ts) AS bar, arg_max(price, struct_pack(a := ts, b := id)) AS price FROM ticks GROUP BY 1, 2) o
    ON o.symbol = g.symbol AND o.bar = g.bar""" for a, b in MULTI)))
def multi_freq(spark, d):
    return R.last_prices(market.event_ticks(spark, d), [a for a, _ in MULTI])


@register("avg_daily_volume", sql("""SELECT symbol, round(sum(v) / (date_diff('day', min(day), max(day)) + 1), 6) AS mean_value FROM (SELECT symbol, CAST(ts AS DATE) AS day, sum(price * amount) AS v FROM ticks GROUP BY 1, 2) GROUP BY 1"""))
def avg_daily_volume(spark, d):
    return R.mean_daily_value(market.event_ticks(spark, d)).select("symbol", *r6("mean_value"))


@register("price_holds", sql(" UNION ALL ".join(f"""SELECT symbol, CAST(count(*) FILTER (price = p) AS BIGINT) AS held, count(*) AS bars, '{w}' AS width FROM (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY bar) AS p FROM
    (SELECT symbol, time_bucket(INTERVAL '{w}', ts) AS bar, arg_max(price, struct_pack(a := ts, b := id)) AS price FROM ticks GROUP BY 1, 2)) GROUP BY 1""" for w in ("1 minute", "3 minutes", "5 minutes", "30 minutes"))))
def price_holds(spark, d):
    return R.holds(market.event_ticks(spark, d), ["1 minute", "3 minutes", "5 minutes", "30 minutes"])


# ---- panels and pairs ----


@register("panel_align", sql("SELECT ts, symbol, price, volume FROM whole"))
def panel_align(spark, d):
    return P.aligned(panel(spark, d))


@register("common_start", sql("SELECT ts, symbol, price, volume FROM panel WHERE ts >= (SELECT max(f) FROM (SELECT min(ts) AS f FROM panel GROUP BY symbol))"))
def common_start(spark, d):
    return P.from_common_start(panel(spark, d))


@register("wide_panel", sql("SELECT ts, max(price) FILTER (symbol = 'AF') AS AF, max(price) FILTER (symbol = 'NF') AS NF, max(price) FILTER (symbol = 'RF') AS RF FROM panel GROUP BY ts"))
def wide_panel(spark, d):
    return P.wide(panel(spark, d), ["AF", "NF", "RF"])


@register("pair_frame", sql("SELECT pair, sym1, sym2, ts, s1, s2 FROM pairs"))
def pair_frame(spark, d):
    return P.pair_frame(panel(spark, d))


@register("unordered_pairs", sql("SELECT DISTINCT sym1, sym2 FROM (SELECT a.symbol AS sym1, b.symbol AS sym2 FROM panel a, panel b WHERE a.symbol < b.symbol)"))
def unordered_pairs(spark, d):
    return P.unordered_pairs(panel(spark, d).select("symbol").distinct())


@register("cross_pairs", sql("SELECT sym1, sym2 FROM (SELECT DISTINCT symbol AS sym1 FROM panel WHERE symbol < 'N') a, (SELECT DISTINCT symbol AS sym2 FROM panel WHERE symbol >= 'N') c"))
def cross_pairs(spark, d):
    symbols = panel(spark, d).select("symbol").distinct()
    return P.cross_pairs(symbols.where("symbol < 'N'"), symbols.where("symbol >= 'N'"))


@register("mismatch", sql("""SELECT x.symbol, x.bar FROM (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS bar, max(price) AS high, min(price) AS low FROM ticks GROUP BY 1, 2) x
    JOIN (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS bar, max(price) AS high, min(price) AS low FROM ticks WHERE id % 3 <> 0 GROUP BY 1, 2) y ON x.symbol = y.symbol AND x.bar = y.bar
    WHERE x.high <> y.high OR x.low <> y.low"""))
def mismatch(spark, d):
    ticks = market.event_ticks(spark, d)
    return P.mismatches(R.ohlcv(ticks, "1 hour"), R.ohlcv(ticks.where("id % 3 <> 0"), "1 hour"), ["symbol", "bar"], ["high", "low"]).select("symbol", "bar")


@register("range_slice", sql("SELECT ts, symbol, price FROM panel WHERE ts BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-06-30 23:59:59.999999'"))
def range_slice(spark, d):
    return P.time_range(panel(spark, d), "1996-03-01", "1996-06-30").select("ts", "symbol", "price")


SPLITS = {"train": ("1995-01-01", "1998-01-01"), "validate": ("1998-01-01", "1999-01-01"), "test": ("1999-01-01", "2002-01-01")}


@register("split_label", sql("""SELECT ts, symbol, price, CASE WHEN ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1998-01-01' THEN 'train' WHEN ts >= TIMESTAMP '1998-01-01' AND ts < TIMESTAMP '1999-01-01' THEN 'validate'
    WHEN ts >= TIMESTAMP '1999-01-01' AND ts < TIMESTAMP '2002-01-01' THEN 'test' END AS split FROM panel"""))
def split_label(spark, d):
    return P.split_label(panel(spark, d).select("ts", "symbol", "price"), SPLITS)


@register("positional_slice", sql("SELECT ts, symbol, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM panel) WHERE i >= 10 AND i < 40"))
def positional_slice(spark, d):
    return P.positions(panel(spark, d).select("ts", "symbol", "price"), 10, 40, ["symbol"])


@register("null_counts", sql("""SELECT 'beta' AS "column", CAST(count(*) FILTER (beta IS NULL) AS BIGINT) AS nulls FROM sig UNION ALL SELECT 'z', CAST(count(*) FILTER (z IS NULL) AS BIGINT) FROM sig"""))
def null_counts(spark, d):
    return P.null_counts(signals(spark, d), ["beta", "z"])


@register("unchanged_rows", sql("""SELECT ts FROM (SELECT ts, coalesce(p = lag(p) OVER (PARTITION BY symbol ORDER BY ts), false) AS same FROM (SELECT ts, symbol, round(price / 100000) AS p FROM panel)) GROUP BY ts HAVING bool_and(same)"""))
def unchanged_rows(spark, d):
    return P.unchanged(panel(spark, d).withColumn("price", F.round(F.col("price") / 100000)))


@register("category_split", sql("SELECT ts, symbol, price, CASE WHEN symbol LIKE 'A%' THEN 'returned' WHEN symbol LIKE 'N%' THEN 'none' ELSE 'Unknown' END AS category FROM panel"))
def category_split(spark, d):
    mapping = spark.createDataFrame([("AF", "returned"), ("AO", "returned"), ("NF", "none"), ("NO", "none")], "symbol string, category string")
    return P.categories(panel(spark, d).select("ts", "symbol", "price"), mapping)


@register("union_strategies", sql("SELECT symbol, ts, price, 'events' AS strategy FROM (SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, price FROM opanel) UNION ALL SELECT symbol, ts, price, 'lines' FROM panel"))
def union_strategies(spark, d):
    return market.order_panel(spark, d).withColumn("strategy", F.lit("events")).unionByName(panel(spark, d).select("ts", "symbol", "price", F.lit("lines").alias("strategy")))


@register("intersect_times", sql("SELECT ts FROM panel INTERSECT SELECT ts FROM opanel"))
def intersect_times(spark, d):
    return panel(spark, d).select("ts").intersect(market.order_panel(spark, d).select("ts"))


@register("except_times", sql("SELECT ts FROM panel EXCEPT SELECT ts FROM opanel"))
def except_times(spark, d):
    return panel(spark, d).select("ts").subtract(market.order_panel(spark, d).select("ts"))


@register("panel_merge", sql("SELECT p.ts, p.symbol AS left_symbol, o.symbol AS right_symbol, p.price AS left_price, o.price AS right_price FROM panel p JOIN opanel o ON p.ts = o.ts"))
def panel_merge(spark, d):
    left = panel(spark, d).select("ts", F.col("symbol").alias("left_symbol"), F.col("price").alias("left_price"))
    return left.join(market.order_panel(spark, d).select("ts", F.col("symbol").alias("right_symbol"), F.col("price").alias("right_price")), "ts")


@register("complete_symbols", sql("SELECT symbol FROM panel WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1996-02-01' GROUP BY symbol HAVING count(DISTINCT ts) = 31"))
def complete_symbols(spark, d):
    files = panel(spark, d).select("symbol", F.to_date("ts").alias("day"))
    return market.complete_symbols(files, market.calendar(spark, "1996-01-01", "1996-01-31"))


# ---- series ----


@register("log_returns", sql(f"SELECT ts, symbol, {s6('ret')} FROM rets"))
def log_returns(spark, d):
    return W.log_returns(panel(spark, d)).select("ts", "symbol", *r6("ret"))


@register("std_returns", sql(f"SELECT ts, symbol, {s6('std_ret')} FROM (SELECT *, (ret - avg(ret) OVER w) / nullif(stddev_samp(ret) OVER w, 0) AS std_ret FROM rets WINDOW w AS (PARTITION BY symbol))"))
def std_returns(spark, d):
    return W.standardised(W.log_returns(panel(spark, d))).select("ts", "symbol", *r6("std_ret"))


def correlations(spark, d):
    from driftloom.operators.discovery import correlations as corr

    return corr(W.log_returns(panel(spark, d)), "ret")


@register("corr_matrix", sql(f"SELECT sym1, sym2, {s6('corr')} FROM corrs"))
def corr_matrix(spark, d):
    return correlations(spark, d).select("sym1", "sym2", *r6("corr"))


@register("high_corr_pairs", sql("SELECT sym1, sym2, round(corr, 6) + 0.0 AS corr FROM corrs WHERE sym1 < sym2 AND abs(corr) >= 0.02"))
def high_corr_pairs(spark, d):
    from driftloom.operators.discovery import high_correlation

    return high_correlation(correlations(spark, d), 0.02).select("sym1", "sym2", *r6("corr"))


@register("rolling_beta", sql(f"SELECT pair, ts, {s6('beta')}, {s4('alpha', 'spread')} FROM spreads"))
def rolling_beta(spark, d):
    return X.with_spread(P.pair_frame(panel(spark, d)), 60).select("pair", "ts", *r6("beta"), *r4("alpha", "spread"))


@register("rolling_zscore", sql(f"SELECT pair, ts, {s6('z')} FROM sig"))
def rolling_zscore(spark, d):
    return signals(spark, d).select("pair", "ts", *r6("z"))


@register("static_beta", sql(f"SELECT pair, {s6('beta')}, {s4('alpha')} FROM (SELECT pair, regr_slope(s1, s2) AS beta, regr_intercept(s1, s2) AS alpha FROM pairs GROUP BY 1)"))
def static_beta(spark, d):
    return X.with_spread(P.pair_frame(panel(spark, d)), None).groupBy("pair").agg(F.first("beta").alias("beta"), F.first("alpha").alias("alpha")).select("pair", *r6("beta"), *r4("alpha"))


@register("global_zscore", sql(f"SELECT pair, ts, {s6('z')} FROM (SELECT pair, ts, (spread - avg(spread) OVER w) / nullif(stddev_samp(spread) OVER w, 0) AS z FROM spreads WINDOW w AS (PARTITION BY pair))"))
def global_zscore(spark, d):
    return X.with_zscore(X.with_spread(P.pair_frame(panel(spark, d)), 60), None).select("pair", "ts", *r6("z"))


@register("expected_profit", sql(f"SELECT pair, ts, {s6('expected_profit')} FROM (SELECT pair, ts, z_std / nullif(s1 + abs(beta) * s2, 0) * 100 AS expected_profit FROM sig)"))
def expected_profit(spark, d):
    return X.expected_profit(signals(spark, d)).select("pair", "ts", *r6("expected_profit"))


@register("tumbling_ols", sql(f"SELECT pair, window_id, {s6('beta')}, {s4('alpha')} FROM (SELECT pair, window_id, regr_slope(s1, s2) AS beta, regr_intercept(s1, s2) AS alpha FROM windowed GROUP BY 1, 2)"))
def tumbling_ols(spark, d):
    rows = P.tumbling(P.pair_frame(panel(spark, d)), ["pair"], 100)
    return X.window_fits(rows, ["pair", "window_id"]).groupBy("pair", "window_id").agg(F.first("beta").alias("beta"), F.first("alpha").alias("alpha")).select("pair", "window_id", *r6("beta"), *r4("alpha"))


@register("beta_returns_mad", sql(f"SELECT pair, {s6('beta_returns_std', 'beta_returns_mad')} FROM brets"))
def beta_returns_mad(spark, d):
    return M.beta_returns(signals(spark, d)).select("pair", *r6("beta_returns_std", "beta_returns_mad"))


@register("beta_volatility", sql("""SELECT pair, ts, round(CASE WHEN count(beta) OVER w = 60 THEN stddev_samp(beta) OVER w END, 6) + 0.0 AS beta_std FROM sig WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"""))
def beta_volatility(spark, d):
    return W.rolling_std(signals(spark, d), "beta", 60, ["pair"], "beta_std").select("pair", "ts", *r6("beta_std"))


@register("moving_average", sql("SELECT symbol, ts, round(avg(price) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) + 0.0 AS ma, round(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts), 6) + 0.0 AS d FROM panel"))
def moving_average(spark, d):
    return W.difference(W.moving_average(panel(spark, d), "price", 10, ["symbol"], "ma"), "price", ["symbol"], "d").select("symbol", "ts", *r6("ma", "d"))


@register("smoothed_volume", sql("""SELECT symbol, ts, round(s, 4) + 0.0 AS s FROM (SELECT symbol, ts, s FROM (SELECT symbol, ts, list(x) OVER w AS xs FROM (SELECT symbol, CAST(date_trunc('month', ts) AS TIMESTAMP) AS ts, sum(volume) AS x FROM panel GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY symbol ORDER BY ts)), LATERAL (SELECT list_reduce(xs, lambda a, x: 0.9 * a + 0.1 * x) AS s))"""))
def smoothed_volume(spark, d):
    monthly = panel(spark, d).groupBy("symbol", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("ts")).agg(F.sum("volume").alias("x"))
    return W.smoothed(monthly, "x", ["symbol"], "s").select("symbol", "ts", (F.round("s", 4) + 0.0).alias("s"))


@register("record_counts", sql("""SELECT symbol, CAST(count(*) FILTER (price > h) AS BIGINT) AS highs, CAST(count(*) FILTER (price < l) AS BIGINT) AS lows FROM (SELECT symbol, price, max(price) OVER w AS h, min(price) OVER w AS l FROM panel
    WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY 1"""))
def record_counts(spark, d):
    return W.record_counts(panel(spark, d), "price", ["symbol"])


# ---- strategy ----


@register("positions", sql("SELECT pair, ts, CAST(pos AS INTEGER) AS position FROM held"))
def positions(spark, d):
    return fold.strategy_bars(signals(spark, d), RULES).select("pair", "ts", "position")


TRADE = ("entry_s1", "entry_s2", "entry_z", "entry_beta", "exit_s1", "exit_s2", "exit_z", "n1", "n2", "pnl1", "pnl2", "fees", "pnl")


@register("trades", sql(f"SELECT pair, trade_no, CAST(position AS INTEGER) AS position, entry_ts, exit_ts, exit_type, {s6(*TRADE)} FROM ledger"))
def trades(spark, d):
    return ledger(spark, d).select("pair", "trade_no", "position", "entry_ts", "exit_ts", "exit_type", *r6(*TRADE))


METRICS = ("total_return", "sharpe", "win_rate", "mean_duration", "mean_beta", "mean_drift", "median_drift", "mean_s1_return", "mean_s2_return", "max_drawdown", "beta_returns_std", "beta_returns_mad")
METRICS_SQL = f"""SELECT pair, trades, {s6(*METRICS)} FROM (SELECT param, pair, sum(pnl) / 100 AS total_return, avg(pnl / 10000) / nullif(stddev_pop(pnl / 10000), 0) AS sharpe, count(*) AS trades,
    100.0 * count(*) FILTER (pnl > 0) / nullif(count(*) FILTER (pnl <> 0), 0) AS win_rate, avg(date_diff('microsecond', entry_ts, exit_ts) / 6e7) AS mean_duration, avg(entry_beta) AS mean_beta,
    avg(drift) AS mean_drift, median(drift) AS median_drift, avg(position * (exit_s1 - entry_s1) / entry_s1) * 100 AS mean_s1_return,
    avg(CASE WHEN entry_beta > 0 THEN -position ELSE position END * (exit_s2 - entry_s2) / entry_s2) * 100 AS mean_s2_return FROM ledger GROUP BY 1, 2) JOIN downs USING (param, pair) LEFT JOIN brets USING (pair)"""


@register("key_metrics", sql(METRICS_SQL))
def key_metrics(spark, d):
    return M.key_metrics(ledger(spark, d), signals(spark, d), CAPITAL).select("pair", "trades", *r6(*METRICS))


@register("threshold_sweep", sql("SELECT param, pair, count(*) AS trades, round(sum(pnl) / 100, 6) + 0.0 AS total_return FROM ledger GROUP BY 1, 2", grid=GRID_SQL))
def threshold_sweep(spark, d):
    from driftloom.operators.sweeps import threshold_sweep as sweep

    return sweep(signals(spark, d), GRID, CAPITAL, 0.001).select("param", "pair", "trades", *r6("total_return"))


COSTS = (0.0, 0.0002, 0.0005, 0.001, 0.002)


@register("cost_sweep", sql("SELECT pair, c.tx_cost, round(sum(pnl1 + pnl2 - fees / 0.001 * c.tx_cost) / 100, 6) + 0.0 AS total_return FROM ledger CROSS JOIN (SELECT unnest([" + ", ".join(f"{c:.4f}::DOUBLE" for c in COSTS) + "]) AS tx_cost) c GROUP BY 1, 2"))
def cost_sweep(spark, d):
    from driftloom.operators.sweeps import cost_sweep as sweep

    return sweep(deals(spark, d), list(COSTS), CAPITAL).select("pair", "tx_cost", *r6("total_return"))


@register("drawdown", sql(f"SELECT pair, {s6('max_drawdown', 'max_drawdown_money', 'profit_drawdown')} FROM downs"))
def drawdown(spark, d):
    return M.max_drawdowns(ledger(spark, d), CAPITAL).select("pair", *r6("max_drawdown", "max_drawdown_money", "profit_drawdown"))


@register("sortino", sql("SELECT pair, round(avg(pnl / 10000) / nullif(stddev_pop(CASE WHEN pnl < 0 THEN pnl / 10000 END), 0), 6) + 0.0 AS sortino FROM ledger GROUP BY 1"))
def sortino(spark, d):
    return ledger(spark, d).groupBy("pair").agg(M.sortino(F.col("pnl"), CAPITAL).alias("sortino")).select("pair", *r6("sortino"))


@register("densified_sharpe", sql("SELECT pair, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(365.0), 6) + 0.0 AS annual_sharpe FROM (SELECT s.pair, coalesce(l.p, 0) / 10000 AS r FROM sig s LEFT JOIN (SELECT pair, exit_ts, sum(pnl) AS p FROM ledger GROUP BY 1, 2) l ON l.pair = s.pair AND l.exit_ts = s.ts) GROUP BY 1"))
def densified_sharpe(spark, d):
    return M.annual_sharpe(ledger(spark, d), signals(spark, d), CAPITAL, 1).select("pair", *r6("annual_sharpe"))


@register("asof_equity", sql("SELECT pair, ts, round(coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY pair ORDER BY ts), 0), 4) + 0.0 AS cum_pnl FROM (SELECT s.pair, s.ts, l.c FROM sig s LEFT JOIN (SELECT pair, exit_ts, sum(pnl) OVER (PARTITION BY pair ORDER BY trade_no) AS c FROM ledger) l ON l.pair = s.pair AND l.exit_ts = s.ts)"))
def asof_equity(spark, d):
    events = M.cumulative_pnl(ledger(spark, d)).select("pair", F.col("exit_ts").alias("ts"), "cum_pnl")
    return M.as_of(signals(spark, d), events, "cum_pnl", ["pair"]).select("pair", "ts", *r4("cum_pnl"))


@register("mabd", sql("SELECT pair, trade_no, round(drift, 4) + 0.0 AS drift FROM drifts"))
def mabd(spark, d):
    inside = M.bars_inside(deals(spark, d), signals(spark, d))
    change = F.abs(F.try_divide(F.col("entry_beta") - F.col("bar_beta"), F.col("entry_beta")))
    return inside.groupBy("pair", "trade_no").agg((F.avg(change) * 100).alias("drift")).select("pair", "trade_no", *r4("drift"))


@register("beta_range", sql("SELECT t.pair, t.trade_no, round(stddev_pop(y.beta), 6) + 0.0 AS beta_std, round(max(y.beta) - min(y.beta), 6) + 0.0 AS beta_range FROM trades t JOIN b y ON y.pair = t.pair AND y.rn BETWEEN t.rn0 AND t.rn1 GROUP BY 1, 2"))
def beta_range(spark, d):
    return deals(spark, d).select("pair", "trade_no", *r6("beta_std", "beta_range"))


@register("mabd_buckets", sql("SELECT pair, CAST(floor(drift / 10) * 10 AS BIGINT) AS bucket, count(*) AS trades, CAST(count(*) FILTER (pnl > 0) AS BIGINT) AS wins, CAST(count(*) FILTER (pnl < 0) AS BIGINT) AS losses, round(count(*) FILTER (pnl < 0) / count(*), 6) + 0.0 AS p_loss FROM ledger WHERE drift IS NOT NULL GROUP BY 1, 2"))
def mabd_buckets(spark, d):
    return M.drift_buckets(ledger(spark, d), keys=["pair"]).select("pair", "bucket", "trades", "wins", "losses", *r6("p_loss"))


@register("drift_histogram", sql("SELECT p.pair, CAST(g.b AS BIGINT) AS bucket, CAST(count(l.drift) AS BIGINT) AS n FROM (SELECT DISTINCT pair FROM ledger) p CROSS JOIN (SELECT unnest(range(10)) AS b) g LEFT JOIN ledger l ON l.pair = p.pair AND floor(l.drift / 10) = g.b GROUP BY 1, 2"))
def drift_histogram(spark, d):
    return M.histogram(ledger(spark, d), "drift", 10, 10, ["pair"]).select("pair", "bucket", F.col("n").cast("long").alias("n"))


@register("bucket_means", sql("SELECT CAST(ceil(drift / 10) AS BIGINT) AS bucket, round(avg(pnl), 6) + 0.0 AS mean, count(*) AS n FROM ledger WHERE drift IS NOT NULL GROUP BY 1"))
def bucket_means(spark, d):
    return M.bucket_means(ledger(spark, d).where("drift is not null"), "drift", "pnl", 10).select("bucket", *r6("mean"), "n")


@register("mann_whitney_u", sql("""SELECT u, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round((u - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM (SELECT sum(CASE WHEN pos = 1 THEN rk END) - sum(pos) * (sum(pos) + 1) / 2 AS u, sum(pos) AS n1,
    count(*) - sum(pos) AS n2, (SELECT sum(c * c * c - c) FROM (SELECT count(*)::DOUBLE AS c FROM ledger GROUP BY round(pnl, 4))) AS ties FROM (SELECT CASE WHEN position > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pos, rank() OVER (ORDER BY round(pnl, 4)) + (count(*) OVER (PARTITION BY round(pnl, 4)) - 1) / 2 AS rk FROM ledger))"""))
def mann_whitney_u(spark, d):
    rows = ledger(spark, d).select(F.round("pnl", 4).alias("v"), F.when(F.col("position") > 0, "long").otherwise("short").alias("g"))
    return M.mann_whitney(rows, "v", "g", "long").select("u", "n1", "n2", F.round("z", 6).alias("z"))


@register("contingency", sql("SELECT pair, CASE WHEN entry_beta > 0 THEN 1 ELSE -1 END AS beta_sign, CASE WHEN pnl > 0 THEN 1 ELSE -1 END AS pnl_sign, count(*) AS n FROM ledger GROUP BY 1, 2, 3"))
def contingency(spark, d):
    return M.contingency(ledger(spark, d), ["pair"])


@register("linreg", sql(f"SELECT pair, {s6('slope', 'intercept', 'r')}, n FROM (SELECT pair, regr_slope(pnl, drift) AS slope, regr_intercept(pnl, drift) AS intercept, corr(pnl, drift) AS r, count(*) AS n FROM ledger WHERE drift IS NOT NULL GROUP BY 1)"))
def linreg(spark, d):
    return M.regression(ledger(spark, d), "pnl", "drift", ["pair"]).select("pair", *r6("slope", "intercept", "r"), "n")


@register("counters", sql("SELECT pair, CAST(count(*) FILTER (pnl < 0 AND position > 0) AS BIGINT) AS long_losses, CAST(count(*) FILTER (pnl < 0 AND position < 0) AS BIGINT) AS short_losses, CAST(count(*) FILTER (pnl1 > 0 AND pnl2 > 0) AS BIGINT) AS both_legs_won FROM ledger GROUP BY 1"))
def counters(spark, d):
    return M.counters(ledger(spark, d), ["pair"])


@register("exposure_losses", sql("SELECT pair, CAST(count(*) FILTER (pnl < 0) AS BIGINT) AS losses, CAST(count(*) FILTER (pnl < 0 AND CASE WHEN m < 1 THEN pnl1 < 0 ELSE pnl2 < 0 END) AS BIGINT) AS exposed_losses FROM (SELECT *, avg(entry_beta) OVER (PARTITION BY pair) AS m FROM ledger) GROUP BY 1"))
def exposure_losses(spark, d):
    return M.exposure_losses(ledger(spark, d), ["pair"])


@register("asymmetry", sql("SELECT pair, trade_no, round(greatest(m1, m2) / least(m1, m2), 3) AS asymmetry, CASE WHEN m1 >= m2 THEN 's1' ELSE 's2' END AS bigger_leg FROM (SELECT pair, trade_no, CASE WHEN x1 = 0 THEN 0.0001 ELSE x1 END AS m1, CASE WHEN x2 = 0 THEN 0.0001 ELSE x2 END AS m2 FROM (SELECT *, abs(exit_s1 - entry_s1) AS x1, abs(entry_beta) * abs(exit_s2 - entry_s2) AS x2 FROM ledger))"))
def asymmetry(spark, d):
    return M.asymmetry(ledger(spark, d)).select("pair", "trade_no", F.round("asymmetry", 3).alias("asymmetry"), "bigger_leg")


@register("leg_shares", sql(f"SELECT pair, {s6('s1_share', 's2_share')} FROM (SELECT pair, sum(pnl1) / nullif(sum(pnl1 + pnl2), 0) * 100 AS s1_share, sum(pnl2) / nullif(sum(pnl1 + pnl2), 0) * 100 AS s2_share FROM ledger GROUP BY 1)"))
def leg_shares(spark, d):
    return M.leg_shares(ledger(spark, d), ["pair"]).select("pair", *r6("s1_share", "s2_share"))


@register("mean_reversion", sql("SELECT pair, round((avg(abs((exit_s1 - entry_s1) / entry_s1)) * 100 + avg(abs((exit_s2 - entry_s2) / entry_s2)) * 100) / 2, 6) + 0.0 AS mean_reversion FROM ledger GROUP BY 1"))
def mean_reversion(spark, d):
    return M.mean_reversion(ledger(spark, d), ["pair"]).select("pair", *r6("mean_reversion"))


@register("win_loss_means", sql("SELECT pair, round(avg(pnl) FILTER (pnl > 0), 6) AS mean_win, round(avg(pnl) FILTER (pnl < 0), 6) AS mean_loss, CAST(count(*) FILTER (pnl > 0) AS BIGINT) AS wins, CAST(count(*) FILTER (pnl < 0) AS BIGINT) AS losses, CAST(count(*) FILTER (pnl <= 0 AND pnl + fees > 0) AS BIGINT) AS lost_to_cost, arg_min(trade_no, pnl) AS worst_trade FROM ledger GROUP BY 1"))
def win_loss_means(spark, d):
    return M.win_loss_means(ledger(spark, d), ["pair"]).select("pair", *r6("mean_win", "mean_loss"), "wins", "losses", "lost_to_cost", "worst_trade")


@register("exit_rates", sql("SELECT pair, count(*) AS trades, round(count(*) FILTER (exit_type = 'win') / count(*), 6) AS win_rate, round(count(*) FILTER (exit_type = 'loss') / count(*), 6) AS loss_rate, round(count(*) FILTER (exit_type = 'forced_exit') / count(*), 6) AS forced_exit_rate FROM trades GROUP BY 1"))
def exit_rates(spark, d):
    return M.exit_rates(deals(spark, d), ["pair"]).select("pair", "trades", *r6("win_rate", "loss_rate", "forced_exit_rate"))


FEATURES = ["drift", "entry_beta", "beta_std", "beta_range"]


@register("beta_exit_change", sql(f"SELECT pair, {s6('slope', 'intercept', 'r')}, n FROM (SELECT pair, regr_slope(abs(pnl / 10000), x) AS slope, regr_intercept(abs(pnl / 10000), x) AS intercept, corr(abs(pnl / 10000), x) AS r, count(*) AS n FROM (SELECT *, abs(exit_beta - entry_beta) AS x FROM ledger) GROUP BY 1)"))
def beta_exit_change(spark, d):
    rows = ledger(spark, d).withColumn("x", F.abs(F.col("exit_beta") - F.col("entry_beta"))).withColumn("y", F.abs(F.col("pnl") / CAPITAL))
    return M.regression(rows, "y", "x", ["pair"]).select("pair", *r6("slope", "intercept", "r"), "n")


HELD_BETA = "SELECT t.pair, t.trade_no, stddev_pop(y.beta) AS beta_std, max(y.beta) - min(y.beta) AS beta_range FROM trades t JOIN b y ON y.pair = t.pair AND y.rn BETWEEN t.rn0 AND t.rn1 GROUP BY 1, 2"


@register("feature_corr", sql(" UNION ALL ".join(f"SELECT pair, '{c}' AS feature, round(corr({c}, pnl), 6) + 0.0 AS corr FROM ledger JOIN ({HELD_BETA}) USING (pair, trade_no) GROUP BY 1" for c in FEATURES)))
def feature_corr(spark, d):
    return M.feature_correlations(ledger(spark, d), FEATURES, "pnl", ["pair"]).select("pair", "feature", *r6("corr"))


@register("sigma_profit", sql("SELECT pair, trade_no, round(entry_std / nullif(entry_s1 + entry_beta * entry_s2, 0), 6) + 0.0 AS sigma_profit FROM trades"))
def sigma_profit(spark, d):
    return deals(spark, d).withColumn("sigma_profit", F.try_divide(F.col("entry_std"), F.col("entry_s1") + F.col("entry_beta") * F.col("entry_s2"))).select("pair", "trade_no", *r6("sigma_profit"))


@register("mtm_pnl", sql("SELECT pair, ts, round(coalesce(lag(pos) OVER w * ((s1 - lag(s1) OVER w) - lag(beta) OVER w * (s2 - lag(s2) OVER w)), 0), 6) + 0.0 AS bar_pnl FROM held WINDOW w AS (PARTITION BY pair ORDER BY ts)"))
def mtm_pnl(spark, d):
    return X.mark_to_market(fold.strategy_bars(signals(spark, d), RULES)).select("pair", "ts", *r6("bar_pnl"))


@register("slippage", sql(f"SELECT symbol, {s6('mid', 'quoted_spread', 'ask_slippage', 'bid_slippage', 'ask_liquidity', 'bid_liquidity')} FROM (SELECT symbol, avg((ask + bid) / 2) AS mid, avg((ask - bid) / nullif(bid, 0) * 100) AS quoted_spread, avg((ask - (ask + bid) / 2) / nullif((ask + bid) / 2, 0) * 100) AS ask_slippage, avg(((ask + bid) / 2 - bid) / nullif((ask + bid) / 2, 0) * 100) AS bid_slippage, avg(ask * ask_amount) AS ask_liquidity, avg(bid * bid_amount) AS bid_liquidity FROM book GROUP BY 1)"))
def slippage(spark, d):
    names = ("mid", "quoted_spread", "ask_slippage", "bid_slippage", "ask_liquidity", "bid_liquidity")
    return M.mid_and_spread(market.event_book(spark, d)).groupBy("symbol").agg(*[F.avg(c).alias(c) for c in names]).select("symbol", *r6(*names))


@register("freq_share", sql("SELECT symbol, count(*) AS n, round(count(*) / (SELECT count(*) FROM ticks), 6) AS share FROM ticks GROUP BY 1"))
def freq_share(spark, d):
    return M.frequency(market.event_ticks(spark, d), "symbol").select("symbol", "n", *r6("share"))


@register("topk_pairs", sql("SELECT pair, round(beta_returns_mad, 6) + 0.0 AS beta_returns_mad FROM brets ORDER BY 2, 1 LIMIT 10"))
def topk_pairs(spark, d):
    return M.beta_returns(signals(spark, d)).select("pair", *r6("beta_returns_mad")).orderBy("beta_returns_mad", "pair").limit(10)


# ---- cycles ----


@register("cycles", sql("SELECT pair, CAST(cycle_id AS BIGINT) AS cycle_id, ts, round(z, 6) + 0.0 AS z FROM cbars"))
def cycles(spark, d):
    return fold.with_cycles(signals(spark, d)).where("cycle_id is not null").select("pair", "cycle_id", "ts", *r6("z"))


@register("cycle_features", sql(f"SELECT pair, CAST(cycle_id AS BIGINT) AS cycle_id, {s6('mean', 'std', 'n', 'low', 'high')} FROM (SELECT pair, cycle_id, avg(z) AS mean, stddev_samp(z) AS std, (count(*) - avg(count(*)) OVER w) / nullif(stddev_pop(count(*)) OVER w, 0) AS n, (min(z) - avg(min(z)) OVER w) / nullif(stddev_pop(min(z)) OVER w, 0) AS low, (max(z) - avg(max(z)) OVER w) / nullif(stddev_pop(max(z)) OVER w, 0) AS high FROM cbars GROUP BY pair, cycle_id WINDOW w AS (PARTITION BY pair))"))
def cycle_features(spark, d):
    from driftloom.operators.agent import cycle_features as features

    return features(fold.with_cycles(signals(spark, d))).select("pair", "cycle_id", *r6("mean", "std", "n", "low", "high"))


THRESHOLDS = [fold.Rules(float(a), 0.0, float(a + 1)) for a in range(1, 10)]
REWARD_GRID = "SELECT * FROM (VALUES " + ", ".join(f"('{a}/0/{a + 1}', {a}.0, {a + 1}.0)" for a in range(1, 10)) + ") g(param, entry, stop)"
#: The fold restarts in each cycle, so its bars are numbered by cycle; z_std and prices come along by time.
CYCLE_BARS = "SELECT g.param, g.entry, g.stop, c.pair || '#' || c.cycle_id AS pair, c.ts, c.z, s.s1, s.s2, s.beta, s.z_std, row_number() OVER (PARTITION BY g.param, c.pair, c.cycle_id ORDER BY c.ts) AS rn FROM cbars c JOIN sig s ON s.pair = c.pair AND s.ts = c.ts CROSS JOIN grid g"


def cycle_bars(spark: SparkSession, d: str) -> DataFrame:
    return fold.with_cycles(signals(spark, d))


@register("reward_table", sql("SELECT split_part(k.pair, '#', 1) AS pair, CAST(split_part(k.pair, '#', 2) AS BIGINT) AS cycle_id, k.param, CASE coalesce(exit_type, 'none') WHEN 'win' THEN 1.0::DOUBLE WHEN 'forced_exit' THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS reward, coalesce(exit_type, 'none') AS exit_type FROM (SELECT DISTINCT param, pair FROM b) k LEFT JOIN trades t ON t.param = k.param AND t.pair = k.pair AND t.trade_no = 1", grid=REWARD_GRID, b=CYCLE_BARS))
def reward_table(spark, d):
    from driftloom.operators.agent import reward_table as rewards

    return rewards(cycle_bars(spark, d), THRESHOLDS).select("pair", "cycle_id", "param", "reward", "exit_type")


@register("best_thresholds", sql("SELECT split_part(k.pair, '#', 1) AS pair, CAST(split_part(k.pair, '#', 2) AS BIGINT) AS cycle_id, max(CASE WHEN t.exit_type = 'win' THEN k.param END) AS best FROM (SELECT DISTINCT param, pair FROM b) k LEFT JOIN trades t ON t.param = k.param AND t.pair = k.pair AND t.trade_no = 1 GROUP BY 1, 2", grid=REWARD_GRID, b=CYCLE_BARS))
def best_thresholds(spark, d):
    from driftloom.operators.agent import best_rules, reward_table as rewards

    return best_rules(rewards(cycle_bars(spark, d), THRESHOLDS), THRESHOLDS)


BEST = "SELECT k.pair, max(CASE WHEN t.exit_type = 'win' THEN k.param END) AS param FROM (SELECT DISTINCT param, pair FROM b) k LEFT JOIN trades t ON t.param = k.param AND t.pair = k.pair AND t.trade_no = 1 GROUP BY 1"


@register("oracle_equity", sql(f"""SELECT pair, cycle_id, param, round(profit, 4) + 0.0 AS profit, round(sum(profit) OVER (PARTITION BY pair ORDER BY cycle_id), 4) + 0.0 AS cum_profit FROM (SELECT split_part(k.pair, '#', 1) AS pair,
    CAST(split_part(k.pair, '#', 2) AS BIGINT) AS cycle_id, k.param, l.pnl1 + l.pnl2 AS profit FROM ({BEST}) k JOIN legs l ON l.pair = k.pair AND l.param = k.param AND l.trade_no = 1) WHERE cycle_id > 1""", grid=REWARD_GRID, b=CYCLE_BARS))
def oracle_equity(spark, d):
    from driftloom.operators.agent import best_rules, oracle_curve, reward_table as rewards

    table = rewards(cycle_bars(spark, d), THRESHOLDS)
    return oracle_curve(table, best_rules(table, THRESHOLDS)).select("pair", "cycle_id", "param", *r4("profit", "cum_profit"))


@register("strategy_comparison", sql("SELECT r.param, r.pair, total_return, r.trades, wins, losses, max_drawdown, CAST(coalesce(c.n, 0) - r.trades AS BIGINT) AS missed FROM (SELECT param, pair, round(sum(pnl) / 100, 6) + 0.0 AS total_return, count(*) AS trades, CAST(count(*) FILTER (pnl > 0) AS BIGINT) AS wins, CAST(count(*) FILTER (pnl < 0) AS BIGINT) AS losses FROM ledger GROUP BY 1, 2) r JOIN (SELECT param, pair, round(max_drawdown, 6) + 0.0 AS max_drawdown FROM downs) d USING (param, pair) LEFT JOIN (SELECT pair, count(DISTINCT cycle_id) AS n FROM cbars GROUP BY 1) c ON c.pair = r.pair", grid=GRID_SQL))
def strategy_comparison(spark, d):
    from driftloom.operators.sweeps import strategy_comparison as compare

    rows = compare(ledger(spark, d, GRID), signals(spark, d), cycle_bars(spark, d), CAPITAL, 1)
    return rows.select("param", "pair", *r6("total_return"), "trades", "wins", "losses", *r6("max_drawdown"), "missed")


@register("cost_matrix", sql("SELECT param, " + ", ".join(f"round(sum(pnl1 + pnl2 - fees / 0.001 * {c:.4f}::DOUBLE) / 100, 4) + 0.0 AS \"{c:.4f}\"" for c in COSTS) + " FROM ledger GROUP BY 1", grid=GRID_SQL))
def cost_matrix(spark, d):
    from driftloom.operators.sweeps import cost_matrix as matrix

    return matrix(deals(spark, d, GRID), list(COSTS), CAPITAL).select("param", *[(F.round(F.col(f"`{c:.4f}`"), 4) + 0.0).alias(f"{c:.4f}") for c in COSTS])


@register("beta_mismatch", sql("SELECT pair, trade_no, round(max(m), 4) + 0.0 AS max_mismatch, round(avg(m), 4) + 0.0 AS mean_mismatch FROM (SELECT t.pair, t.trade_no, abs(t.entry_beta - (y.s1 - p.s1) / CASE WHEN y.s2 = p.s2 THEN 1 ELSE y.s2 - p.s2 END) AS m FROM trades t JOIN b y ON y.pair = t.pair AND y.rn > t.rn0 AND y.rn <= t.rn1 JOIN b p ON p.pair = y.pair AND p.rn = y.rn - 1) GROUP BY 1, 2"))
def beta_mismatch(spark, d):
    return deals(spark, d).where("max_mismatch is not null").select("pair", "trade_no", *r4("max_mismatch", "mean_mismatch"))


@register("z_histogram", sql("SELECT pair, CAST(least(greatest(floor(z / 0.1::DOUBLE), -50), 49) AS BIGINT) AS bin, count(*) AS n FROM sig WHERE z IS NOT NULL GROUP BY 1, 2"))
def z_histogram(spark, d):
    from driftloom.operators.sweeps import report_tables

    return report_tables(signals(spark, d), ledger(spark, d), CAPITAL)["z_histogram"].select("pair", "bin", "n")


@register("clipped_trades", sql("SELECT pair, trade_no FROM trades WHERE exit_ts >= TIMESTAMP '1997-01-01' AND entry_ts <= TIMESTAMP '1997-03-01'"))
def clipped_trades(spark, d):
    from driftloom.operators.sweeps import clipped_trades as clip

    return clip(deals(spark, d), "1997-01-01", "1997-03-01").select("pair", "trade_no")


@register("rolling_leg_volatility", sql("SELECT pair, ts, round(CASE WHEN count(s1) OVER w = 60 THEN stddev_samp(s1) OVER w END, 4) + 0.0 AS v1, round(CASE WHEN count(s2) OVER w = 60 THEN stddev_samp(s2) OVER w END, 4) + 0.0 AS v2 FROM pairs WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"))
def rolling_leg_volatility(spark, d):
    rows = P.pair_frame(panel(spark, d))
    return W.rolling_std(W.rolling_std(rows, "s1", 60, ["pair"], "v1"), "s2", 60, ["pair"], "v2").select("pair", "ts", *r4("v1", "v2"))


@register("book_pair", sql("SELECT bar, l.bid AS bid1, r.bid AS bid2 FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS bar, round(arg_max(bid, struct_pack(a := ts, b := id)), 6) AS bid FROM book WHERE symbol = 'click' GROUP BY 1) l JOIN (SELECT time_bucket(INTERVAL '1 hour', ts) AS bar, round(arg_max(bid, struct_pack(a := ts, b := id)), 6) AS bid FROM book WHERE symbol = 'view' GROUP BY 1) r USING (bar)"))
def book_pair(spark, d):
    bars = R.book_bars(market.event_book(spark, d), "1 hour")
    a, b = (bars.where(F.col("symbol") == s).select("bar", *r6("bid")).withColumnRenamed("bid", n) for s, n in (("click", "bid1"), ("view", "bid2")))
    return a.join(b, "bar")


# ---- tests, graphs and learning: checked against plain numpy in the tests ----


@register("cointegration")
def cointegration(spark, d):
    from driftloom.operators.discovery import cointegration as test

    return test(P.pair_frame(panel(spark, d))).select("pair", *r6("t", "pvalue"), "lags")


@register("cointegrated_windows")
def cointegrated_windows(spark, d):
    from driftloom.operators.discovery import cointegrated_windows as test

    return test(P.tumbling(P.pair_frame(panel(spark, d)), ["pair"], 400)).select("pair", "windows", "passed", *r6("mean_p", "pass_fraction"))


RESID = "SELECT p.pair, p.ts, p.s1 - f.a - f.b * p.s2 AS e FROM pairs p JOIN (SELECT pair, regr_slope(s1, s2) AS b, regr_intercept(s1, s2) AS a FROM pairs GROUP BY 1) f ON f.pair = p.pair"


@register("white_noise", sql(f"""SELECT pair, round(q, 4) + 0.0 AS q, q <= 3.841458820694124 AS white FROM (SELECT pair, n * (n + 2) * power(r, 2) / (n - 1) AS q FROM (SELECT pair, count(*) AS n, sum((e - m) * (p - m)) / sum(power(e - m, 2)) AS r FROM
    (SELECT *, avg(e) OVER (PARTITION BY pair) AS m, lag(e) OVER (PARTITION BY pair ORDER BY ts) AS p FROM ({RESID})) GROUP BY 1))"""))
def white_noise(spark, d):
    from driftloom.operators.discovery import residuals, white_noise as test

    return test(residuals(P.pair_frame(panel(spark, d)))).select("pair", *r4("q"), "white")


#: MacKinnon's response surfaces for two series with a constant, at n - 1 values (fixed values).
CRIT = ", ".join(f"round({a} + ({b}) / (n - 1) + ({c}) / power(n - 1, 2), 6) AS {name}" for name, a, b, c in (("crit1", -3.89644, -10.9519, -22.527), ("crit5", -3.33613, -6.1101, -6.823), ("crit10", -3.04445, -4.2412, -2.720)))
EG = "SELECT {keys}, max(n) AS n, sum(d * p) / sum(p * p) / sqrt((sum(d * d) - power(sum(d * p), 2) / sum(p * p)) / (count(d) - 1) / sum(p * p)) AS t FROM (SELECT *, e - p AS d FROM (SELECT *, lag(e) OVER (PARTITION BY {keys} ORDER BY ts) AS p, count(*) OVER (PARTITION BY {keys}) AS n FROM ({resid})) WHERE p IS NOT NULL) GROUP BY {keys}"


@register("cointegration_fixed", sql(f"SELECT pair, round(t, 6) + 0.0 AS t, {CRIT}, 0 AS lags FROM ({EG.format(keys='pair', resid=RESID)})"))
def cointegration_fixed(spark, d):
    from driftloom.operators.discovery import cointegration as test

    return test(P.pair_frame(panel(spark, d)), ["pair"], 0, None).select("pair", *r6("t", "crit1", "crit5", "crit10"), "lags")


RESID_400 = "SELECT w.pair, w.window_id, w.ts, w.s1 - f.a - f.b * w.s2 AS e FROM ws w JOIN (SELECT pair, window_id, regr_slope(s1, s2) AS b, regr_intercept(s1, s2) AS a FROM ws GROUP BY 1, 2) f USING (pair, window_id)"
WINDOWS_400 = "SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY pair ORDER BY ts) - 1) // 400 AS window_id, count(*) OVER (PARTITION BY pair) AS n0 FROM pairs) WHERE window_id < n0 // 400"


def five_percent() -> float:
    """The statistic at which the p-value of two series with a constant is 5 percent."""
    from driftloom.functions.unitroot import mackinnon_p

    low, high = -10.0, 0.0
    for _ in range(80):
        low, high = ((low + high) / 2, high) if mackinnon_p((low + high) / 2, "c", 2) < 0.05 else (low, (low + high) / 2)
    return low


@register("cointegrated_windows_fixed", sql(f"SELECT pair, count(*) AS windows, CAST(count(*) FILTER (t < {five_percent()!r}) AS BIGINT) AS passed, round(count(*) FILTER (t < {five_percent()!r}) / count(*), 6) AS pass_fraction FROM ({EG.format(keys='pair, window_id', resid=RESID_400.replace('ws ', f'({WINDOWS_400}) '))}) GROUP BY 1"))
def cointegrated_windows_fixed(spark, d):
    from driftloom.operators.discovery import cointegrated_windows as test

    return test(P.tumbling(P.pair_frame(panel(spark, d)), ["pair"], 400), min_pass=0.0, most=0, rule=None).select("pair", "windows", "passed", *r6("pass_fraction"))


KPSS_SUMS = " + ".join(f"2 * {1 - k / 5} * sum(e * e{k})" for k in range(1, 5))


@register("stationarity_fixed", sql(f"""SELECT symbol, round(r * sqrt((n - 3) / (1 - r * r)), 6) + 0.0 AS adf, round(kpss, 6) AS kpss FROM (SELECT symbol, count(*) AS n, corr(price - p, p) AS r, sum(power(s, 2)) / power(count(*), 2) / ((sum(e * e) + {KPSS_SUMS}) / count(*)) AS kpss FROM
    (SELECT *, sum(e) OVER w AS s, {', '.join(f'lag(e, {k}) OVER w AS e{k}' for k in range(1, 5))} FROM (SELECT symbol, ts, price, lag(price) OVER (PARTITION BY symbol ORDER BY ts) AS p, price - avg(price) OVER (PARTITION BY symbol) AS e FROM panel) WINDOW w AS (PARTITION BY symbol ORDER BY ts)) GROUP BY 1)"""))
def stationarity_fixed(spark, d):
    from driftloom.operators.discovery import stationarity as test

    return test(panel(spark, d), ["symbol"], "price", 0, 4).select("symbol", *r6("adf", "kpss"))


LAGGED = "SELECT symbol, ts, x, lag(x) OVER w AS x1, lag(x, 2) OVER w AS x2, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT symbol, ts, ret - avg(ret) OVER (PARTITION BY symbol) AS x FROM rets) WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


@register("autocorrelations", sql(f"""SELECT symbol, round(r1, 6) + 0.0 AS r1, round(r2, 6) + 0.0 AS r2, round(r2 + 1.959963984540054 * sqrt((1 + 2 * r1 * r1) / n), 6) + 0.0 AS high2, round((r2 - r1 * r1) / (1 - r1 * r1), 6) + 0.0 AS partial2, round(b1, 6) + 0.0 AS burg1,
    round(n * (n + 2) * (r1 * r1 / (n - 1) + r2 * r2 / (n - 2)), 4) + 0.0 AS q, round(c0 * (1 - r1 * r1) * (1 - power((r2 - r1 * r1) / (1 - r1 * r1), 2)), 6) + 0.0 AS sigma2
    FROM (SELECT symbol, count(*) AS n, sum(x * x) / count(*) AS c0, sum(x * x1) / sum(x * x) AS r1, sum(x * x2) / sum(x * x) AS r2, 2 * sum(x * x1) / (sum(x * x) FILTER (i > 1) + sum(x * x) FILTER (i < n)) AS b1 FROM ({LAGGED}) GROUP BY 1)"""))
def autocorrelations(spark, d):
    from driftloom.operators.discovery import autocorrelations as test

    found = test(W.log_returns(panel(spark, d)), ["symbol"], "ret", 2)
    wide = found.select("symbol", "q", "sigma2", F.col("r")[0].alias("r1"), F.col("r")[1].alias("r2"), F.col("high")[1].alias("high2"), F.col("partial")[1].alias("partial2"), F.col("burg")[0].alias("burg1"))
    return wide.select("symbol", *r6("r1", "r2", "high2", "partial2", "burg1", "sigma2"), *r4("q"))


def partial_f(y: str, own: str, other: str) -> str:
    r = f"((corr({y}, {other}) - corr({y}, {own}) * corr({own}, {other})) / sqrt((1 - power(corr({y}, {own}), 2)) * (1 - power(corr({own}, {other}), 2))))"
    return f"round(power({r}, 2) / (1 - power({r}, 2)) * (count({own}) - 3), 4) + 0.0"


@register("pair_tests", sql(f"""SELECT pair, round(max(c0), 6) + 0.0 AS ccf0, round(sum((s1 - m1) * (p2 - m2)) / (count(*) - 1) / max(sd), 6) + 0.0 AS ccf1, {partial_f('CASE WHEN p1 IS NOT NULL THEN s1 END', 'p1', 'p2')} AS f12, {partial_f('CASE WHEN p1 IS NOT NULL THEN s2 END', 'p2', 'p1')} AS f21
    FROM (SELECT pair, s1, s2, lag(s1) OVER w AS p1, lag(s2) OVER w AS p2, avg(s1) OVER v AS m1, avg(s2) OVER v AS m2, stddev_pop(s1) OVER v * stddev_pop(s2) OVER v AS sd, corr(s1, s2) OVER v AS c0 FROM pairs WINDOW w AS (PARTITION BY pair ORDER BY ts), v AS (PARTITION BY pair)) GROUP BY 1"""))
def pair_tests(spark, d):
    from driftloom.operators.discovery import pair_tests as test

    return test(P.pair_frame(panel(spark, d))).select("pair", F.col("ccf")[0].alias("ccf0"), F.col("ccf")[1].alias("ccf1"), "f12", "f21").select("pair", *r6("ccf0", "ccf1"), *r4("f12", "f21"))


@register("breaks", sql("""SELECT symbol, round(sum(price * price) FILTER (i > n - round(n / 3)) / sum(price * price) FILTER (i <= round(n / 3)), 6) AS ratio, round(count(*) FILTER (price > h OR price < l) / sqrt(count(*)), 6) AS extremes FROM
    (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS n, max(price) OVER w AS h, min(price) OVER w AS l FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY 1"""))
def breaks(spark, d):
    from driftloom.operators.discovery import breaks as test

    return test(panel(spark, d), ["symbol"], "price").select("symbol", *r6("ratio", "extremes"))


@register("price_difference", sql("SELECT symbol, ts, round(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts), 6) + 0.0 AS d FROM panel"))
def price_difference(spark, d):
    return W.difference(panel(spark, d), "price", ["symbol"], "d").select("symbol", "ts", *r6("d"))


@register("cumulative_returns", sql("SELECT symbol, ts, round(sum(ret) OVER (PARTITION BY symbol ORDER BY ts), 6) + 0.0 AS c FROM rets"))
def cumulative_returns(spark, d):
    return W.cumulative(W.log_returns(panel(spark, d)), "ret", ["symbol"], "c").select("symbol", "ts", *r6("c"))


@register("plain_positions", sql("SELECT pair, ts, CAST(pos AS INTEGER) AS position FROM held", grid="SELECT * FROM (VALUES ('plain', 1.0, 1e300)) g(param, entry, stop)"))
def plain_positions(spark, d):
    return fold.strategy_bars(signals(spark, d), fold.Rules(1.0, 0.0, float("inf"))).select("pair", "ts", "position")


#: The order-book variant: flat on the first bar, entries beyond the stop too, a lock only after a stop.
BOOK_STATE = """SELECT DISTINCT param, pair, CAST(0 AS BIGINT) AS rn, 0 AS pos, 0 AS lck FROM b UNION ALL
    SELECT b.param, b.pair, b.rn, CASE WHEN b.z IS NULL OR b.rn = 1 THEN st.pos WHEN st.pos <> 0 THEN CASE WHEN -st.pos * b.z <= 0 OR -st.pos * b.z >= b.stop THEN 0 ELSE st.pos END
      WHEN st.lck <> 0 THEN 0 WHEN b.z >= b.entry THEN -1 WHEN b.z <= -b.entry THEN 1 ELSE 0 END,
    CASE WHEN b.z IS NULL OR b.rn = 1 THEN st.lck WHEN st.pos <> 0 THEN CASE WHEN -st.pos * b.z <= 0 THEN 0 WHEN -st.pos * b.z >= b.stop THEN st.pos ELSE 0 END
      WHEN st.lck <> 0 AND st.lck * b.z < 0 THEN st.lck ELSE 0 END FROM st JOIN b ON b.param = st.param AND b.pair = st.pair AND b.rn = st.rn + 1"""


@register("book_positions", sql("SELECT pair, ts, CAST(pos AS INTEGER) AS position FROM held", st=BOOK_STATE))
def book_positions(spark, d):
    return fold.strategy_bars(signals(spark, d), fold.Rules(1.0, 0.0, 2.0, book=True)).select("pair", "ts", "position")


@register("legacy_rewards", sql("SELECT pair, trade_no, CAST(CASE exit_type WHEN 'win' THEN 1000 WHEN 'loss' THEN -500 ELSE 0 END AS INTEGER) AS reward FROM trades"))
def legacy_rewards(spark, d):
    from driftloom.operators.agent import legacy_reward

    return legacy_reward(deals(spark, d)).select("pair", "trade_no", "reward")


@register("episodes", sql("SELECT pair, ts, CAST(k AS BIGINT) AS episode, CASE WHEN i - k * 50 < 100 THEN 'formation' ELSE 'trading' END AS phase FROM (SELECT pair, ts, row_number() OVER (PARTITION BY pair ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY pair) AS n FROM pairs) CROSS JOIN (SELECT unnest(range(1000)) AS k) WHERE k < (n - 100) // 50 AND i >= k * 50 AND i < k * 50 + 150"))
def episodes(spark, d):
    return fold.episodes(P.pair_frame(panel(spark, d)), 100, 50).select("pair", "ts", F.col("episode").cast("long").alias("episode"), "phase")


RECENT = "SELECT *, avg(spread) OVER w AS m, coalesce(nullif(stddev_samp(spread) OVER w, 0), 1e-8) AS s FROM b WINDOW w AS (PARTITION BY pair ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@register("risk_sized", sql(f"""SELECT pair, trade_no, CAST(position AS INTEGER) AS position, round(size, 6) + 0.0 AS size, stopped, round(CASE WHEN stopped THEN -100.0::DOUBLE ELSE last END, 4) + 0.0 AS pnl FROM (SELECT t.pair, t.trade_no, t.position, 100 / e.s AS size,
    bool_or(y.rn > t.rn0 AND t.position * (y.spread - (e.m - t.position * 2 * e.s)) <= 0) AS stopped, arg_max(t.position * 100 / e.s * (y.spread - e.spread), y.rn) AS last
    FROM trades t JOIN ({RECENT}) e ON e.pair = t.pair AND e.rn = t.rn0 JOIN b y ON y.pair = t.pair AND y.rn BETWEEN t.rn0 AND t.rn1 GROUP BY 1, 2, 3, 4)"""))
def risk_sized(spark, d):
    return M.risk_sized(fold.strategy_bars(signals(spark, d), RULES), 100.0).select("pair", "trade_no", "position", *r6("size"), "stopped", *r4("pnl"))


SHAPES = "SELECT pair, cycle_id, avg(power((z - m) / s, 3)) AS skew, avg(power((z - m) / s, 4)) - 3 AS kurt FROM (SELECT *, avg(z) OVER w AS m, nullif(stddev_pop(z) OVER w, 0) AS s FROM cbars WINDOW w AS (PARTITION BY pair, cycle_id)) GROUP BY 1, 2"


@register("cycle_shapes", sql(f"SELECT pair, CAST(cycle_id AS BIGINT) AS cycle_id, round((skew - avg(skew) OVER w) / nullif(stddev_pop(skew) OVER w, 0), 6) + 0.0 AS skew, round((kurt - avg(kurt) OVER w) / nullif(stddev_pop(kurt) OVER w, 0), 6) + 0.0 AS kurt FROM ({SHAPES}) WINDOW w AS (PARTITION BY pair)"))
def cycle_shapes(spark, d):
    from driftloom.operators.agent import cycle_features as features

    return features(cycle_bars(spark, d)).select("pair", "cycle_id", *r6("skew", "kurt"))


@register("price_files", sql("SELECT ts, symbol, price FROM panel"))
def price_files(spark, d):
    """Written as a wide CSV file and read back."""
    from driftloom.sources.sinks import scratch_dir, write_csv

    rows, path = panel(spark, d), scratch_dir(spark)
    symbols = sorted(r.symbol for r in rows.select("symbol").distinct().collect())  # the file's columns
    write_csv(P.wide(rows, symbols), path)
    return market.price_csv(spark, path, symbols)


@register("tick_files", sql("SELECT ts, symbol, side, price, amount, CAST(id AS VARCHAR) AS id FROM ticks"))
def tick_files(spark, d):
    """Written as compressed CSV files and read back."""
    from driftloom.sources.sinks import scratch_dir, write_csv

    rows, path = market.event_ticks(spark, d), scratch_dir(spark)
    stamp = F.unix_micros(F.col("ts").cast("timestamp"))
    write_csv(rows.select(F.lit("x").alias("exchange"), "symbol", stamp.alias("timestamp"), stamp.alias("local_timestamp"), F.col("id").cast("string").alias("id"), "side", "price", "amount"), path, compression="gzip")
    return market.trades_csv(spark, f"{path}/*.csv.gz").drop("file")


@register("stationarity")
def stationarity(spark, d):
    from driftloom.operators.discovery import stationarity as test

    return test(panel(spark, d), ["symbol"], "price").select("symbol", *r6("adf", "adf_p"), "adf_lags", *r6("kpss", "kpss_p"))


def hourly_returns(spark: SparkSession, d: str) -> DataFrame:
    bars = R.tick_bars(market.event_ticks(spark, d, groups=12), "4 hours").select(F.col("bar").alias("ts"), "symbol", "price")
    return W.standardised(W.log_returns(P.aligned(bars)))


@register("communities")
def communities(spark, d):
    from driftloom.operators.graph import communities as find

    return find(hourly_returns(spark, d))


@register("spectral_communities")
def spectral_communities(spark, d):
    from driftloom.operators.graph import communities as find

    return find(hourly_returns(spark, d), method="spectral")


EDGES = "SELECT sym1, sym2, corr AS w, CASE WHEN sym1 < 'N' THEN 'a' ELSE 'b' END AS c1, CASE WHEN sym2 < 'N' THEN 'a' ELSE 'b' END AS c2 FROM corrs"


def edges_and_labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = correlations(spark, d).withColumnRenamed("corr", "w")
    return edges, panel(spark, d).select("symbol").distinct().withColumn("community", F.when(F.col("symbol") < "N", "a").otherwise("b"))


@register("aggregate_graph", sql(f"SELECT c1, c2, round(sum(w), 6) + 0.0 AS w FROM ({EDGES}) GROUP BY 1, 2"))
def aggregate_graph(spark, d):
    from driftloom.operators.graph import aggregate_graph as aggregate

    return aggregate(*edges_and_labels(spark, d)).select("c1", "c2", *r6("w"))


@register("graph_modularity", sql(f"SELECT round(sum(CASE WHEN c1 = c2 THEN w END) / sum(w), 6) AS modularity FROM ({EDGES}) WHERE sym1 <= sym2"))
def graph_modularity(spark, d):
    from driftloom.operators.graph import graph_modularity as share

    return share(*edges_and_labels(spark, d)).select(*r6("modularity"))


@register("mp_density", "SELECT round(l, 6) AS lambda, round(4.0 / (2 * pi() * l) * sqrt(greatest((2.25 - l) * (l - 0.25), 0)), 6) AS density FROM (SELECT 0.25::DOUBLE + i * 0.02::DOUBLE AS l FROM range(101) t(i))")
def mp_density(spark, d):
    from driftloom.operators.graph import noise_density

    return noise_density(spark, 4.0).select(*r6("lambda", "density"))


@register("agent_choices")
def agent_choices(spark, d):
    from driftloom.operators import agent

    bars = cycle_bars(spark, d)
    return agent.learn_and_choose(agent.cycle_features(bars), agent.reward_table(bars, THRESHOLDS), THRESHOLDS)
