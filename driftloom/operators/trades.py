"""Profit and loss of trades, and metrics over trades and bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.operators.series import drawdown, mad, pct_change, ratio

KEYS = ["pair", "param"]


def with_pnl(trades: DataFrame, capital: float, cost: float | None = None) -> DataFrame:
    """Adds the ledger: money in each leg by the hedge ratio at entry, four fees, gross and net profit.  The capital is the same
    for each trade.  With ``cost`` None the column tx_cost holds the rate."""
    size = F.abs("entry_beta")
    rate = F.col("tx_cost") if cost is None else F.lit(float(cost))
    rows = trades.withColumn("n1", F.lit(float(capital)) / (1 + size)).withColumn("n2", size * F.lit(float(capital)) / (1 + size))
    rows = rows.withColumn("shares1", ratio(F.col("n1"), F.col("entry_s1"))).withColumn("shares2", ratio(F.col("n2"), F.col("entry_s2")))
    second = F.when(F.col("entry_beta") > 0, -F.col("position")).otherwise(F.col("position"))
    rows = rows.withColumn("pnl1", F.col("position") * F.col("shares1") * (F.col("exit_s1") - F.col("entry_s1")))
    rows = rows.withColumn("pnl2", second * F.col("shares2") * (F.col("exit_s2") - F.col("entry_s2")))
    turned = F.col("shares1") * (F.col("entry_s1") + F.col("exit_s1")) + F.col("shares2") * (F.col("entry_s2") + F.col("exit_s2"))
    rows = rows.withColumn("fees", rate * turned)
    return rows.withColumn("pnl", F.col("pnl1") + F.col("pnl2") - F.col("fees"))


def cumulative_pnl(ledger: DataFrame, keys: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(keys or KEYS)).orderBy("trade_no").rowsBetween(Window.unboundedPreceding, 0)
    return ledger.withColumn("cum_pnl", F.sum("pnl").over(w))


def counters(ledger: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Losing longs and shorts, and trades on which both legs won."""
    lost = F.col("pnl") < 0
    return ledger.groupBy(*(keys or KEYS)).agg(
        F.count_if(lost & (F.col("position") > 0)).alias("long_losses"), F.count_if(lost & (F.col("position") < 0)).alias("short_losses"),
        F.count_if((F.col("pnl1") > 0) & (F.col("pnl2") > 0)).alias("both_legs_won"),
    )


def sharpe(profit, capital: float, free: float = 0.0):
    r = profit / capital
    return ratio(F.avg(r) - free, F.stddev_pop(r))


def sortino(profit, capital: float, free: float = 0.0):
    r = profit / capital
    return ratio(F.avg(r) - free, F.stddev_pop(F.when(r < 0, r)))


def win_rate(profit):
    """Winners among trades that made or lost money, in percent."""
    return ratio(F.count_if(profit > 0), F.count_if(profit != 0)) * 100


def annual_sharpe(ledger: DataFrame, bars: DataFrame, capital: float, bars_per_day: int = 288, keys: list[str] | None = None, on: list[str] | None = None) -> DataFrame:
    """Sharpe ratio over all bars, a bar's return being that of the trades which end on it (else 0), by sample deviation and
    the square root of the bars in a year."""
    on = on or ["pair"]
    params = ledger.select(*(keys or KEYS)).distinct()
    ends = ledger.groupBy(*(keys or KEYS), F.col("exit_ts").alias("ts")).agg(F.sum("pnl").alias("pnl"))
    dense = bars.select(*on, "ts").join(params, on).join(ends, [*(keys or KEYS), "ts"], "left").withColumn("r", F.coalesce("pnl", F.lit(0.0)) / capital)
    return dense.groupBy(*(keys or KEYS)).agg((ratio(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.lit(365.0 * bars_per_day))).alias("annual_sharpe"))


def max_drawdowns(ledger: DataFrame, capital: float, keys: list[str] | None = None) -> DataFrame:
    """In percent of the peak value, in money, and in percent of the peak profit."""
    keys = keys or KEYS
    rows = drawdown(ledger, "pnl", keys, capital, order="trade_no")
    rows = rows.withColumn("profit", F.col("value") - capital).withColumn("profit_peak", F.col("peak") - capital)
    return rows.groupBy(*keys).agg(
        (F.abs(F.min("drawdown")) * 100).alias("max_drawdown"), F.max(F.col("peak") - F.col("value")).alias("max_drawdown_money"),
        F.min(ratio(F.col("profit") - F.col("profit_peak"), F.col("profit_peak")) * 100).alias("profit_drawdown"),
    )


def beta_returns(bars: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Deviation and median absolute deviation of the hedge ratio's relative changes, in percent."""
    keys = keys or ["pair"]
    moves = pct_change(bars.where("beta is not null"), "beta", keys, "beta_return").where("beta_return is not null")
    return moves.groupBy(*keys).agg((F.stddev_samp("beta_return") * 100).alias("beta_returns_std")).join(mad("beta_return", keys, moves, "m"), keys).select(*keys, "beta_returns_std", (F.col("m") * 100).alias("beta_returns_mad"))


def key_metrics(ledger: DataFrame, bars: DataFrame, capital: float, keys: list[str] | None = None) -> DataFrame:
    """The summary row of each pair and parameter set.  Trades without a drift are left out of its mean and median."""
    keys = keys or KEYS
    minutes = (F.unix_micros(F.col("exit_ts").cast("timestamp")) - F.unix_micros(F.col("entry_ts").cast("timestamp"))) / 6e7
    side2 = F.when(F.col("entry_beta") > 0, -F.col("position")).otherwise(F.col("position"))
    rows = ledger.groupBy(*keys).agg(
        (F.sum("pnl") / capital * 100).alias("total_return"), sharpe(F.col("pnl"), capital).alias("sharpe"), F.count("*").alias("trades"),
        win_rate(F.col("pnl")).alias("win_rate"), F.avg(minutes).alias("mean_duration"), F.avg("entry_beta").alias("mean_beta"),
        F.avg("drift").alias("mean_drift"), F.median("drift").alias("median_drift"),
        F.avg(F.col("position") * ratio(F.col("exit_s1") - F.col("entry_s1"), F.col("entry_s1")) * 100).alias("mean_s1_return"),
        F.avg(side2 * ratio(F.col("exit_s2") - F.col("entry_s2"), F.col("entry_s2")) * 100).alias("mean_s2_return"),
    )
    return rows.join(max_drawdowns(ledger, capital, keys).select(*keys, "max_drawdown"), keys).join(beta_returns(bars), ["pair"], "left")


def bars_inside(trades: DataFrame, bars: DataFrame, *, with_entry: bool = False) -> DataFrame:
    """The interval join: each trade with its pair's bars after its entry (or from it) up to its exit."""
    b = bars.select("pair", F.col("ts").alias("bar_ts"), F.col("beta").alias("bar_beta"), F.col("s1").alias("bar_s1"), F.col("s2").alias("bar_s2"))
    low = F.col("bar_ts") >= F.col("entry_ts") if with_entry else F.col("bar_ts") > F.col("entry_ts")
    return trades.join(b, "pair").where(low & (F.col("bar_ts") <= F.col("exit_ts")))


def drift_buckets(ledger: DataFrame, width: int = 10, keys: list[str] | None = None) -> DataFrame:
    """Trades, winners, losers and share of losers by drift in [lo, lo + width)."""
    rows = ledger.where("drift is not null").withColumn("bucket", (F.floor(F.col("drift") / width) * width).cast("long"))
    won, lost = F.count_if(F.col("pnl") > 0), F.count_if(F.col("pnl") < 0)
    return rows.groupBy(*(keys or KEYS), "bucket").agg(F.count("*").alias("trades"), won.alias("wins"), lost.alias("losses"), ratio(lost, F.count("*")).alias("p_loss"))


def histogram(df: DataFrame, column: str, width: float, buckets: int, keys: list[str]) -> DataFrame:
    """Counts in [i width, (i + 1) width) for i below ``buckets``, zeros included."""
    at = F.floor(F.col(column) / width).cast("long")
    found = df.where((at >= 0) & (at < buckets)).groupBy(*keys, at.alias("bucket")).agg(F.count("*").alias("n"))
    grid = df.select(*keys).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    return grid.join(found, [*keys, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def bucket_means(df: DataFrame, column: str, value: str, width: float, keys: list[str] | None = None) -> DataFrame:
    """Means of ``value`` over right-closed buckets ((i - 1) width, i width]."""
    at = F.ceil(F.col(column) / width).cast("long").alias("bucket")
    return df.groupBy(*(keys or []), at).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def exposure_losses(ledger: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Losing trades, and those in which the leg with the more money (the first if the mean hedge ratio is below 1) moved
    against its position."""
    keys = keys or KEYS
    mean = F.avg("entry_beta").over(Window.partitionBy(*keys))
    against = F.when(F.col("mean_beta") < 1, F.col("pnl1") < 0).otherwise(F.col("pnl2") < 0)
    rows = ledger.withColumn("mean_beta", mean)
    return rows.groupBy(*keys).agg(F.count_if(F.col("pnl") < 0).alias("losses"), F.count_if((F.col("pnl") < 0) & against).alias("exposed_losses"))


def asymmetry(ledger: DataFrame) -> DataFrame:
    """Adds asymmetry: the larger over the smaller of |move of s1| and |beta x move of s2|, zeros as 0.0001, and bigger_leg."""
    m1 = F.abs(F.col("exit_s1") - F.col("entry_s1"))
    m2 = F.abs("entry_beta") * F.abs(F.col("exit_s2") - F.col("entry_s2"))
    m1, m2 = (F.when(m == 0, F.lit(0.0001)).otherwise(m) for m in (m1, m2))
    return ledger.withColumn("asymmetry", F.greatest(m1, m2) / F.least(m1, m2)).withColumn("bigger_leg", F.when(m1 >= m2, "s1").otherwise("s2"))


def contingency(ledger: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Trades by sign of the hedge ratio and of the profit (0 counts as negative)."""
    sign = lambda c: F.when(F.col(c) > 0, 1).otherwise(-1)
    return ledger.groupBy(*(keys or KEYS), sign("entry_beta").alias("beta_sign"), sign("pnl").alias("pnl_sign")).agg(F.count("*").alias("n"))


def leg_shares(ledger: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each leg's part of the gross profit, in percent."""
    total = F.sum(F.col("pnl1") + F.col("pnl2"))
    return ledger.groupBy(*(keys or KEYS)).agg((ratio(F.sum("pnl1"), total) * 100).alias("s1_share"), (ratio(F.sum("pnl2"), total) * 100).alias("s2_share"))


def mean_reversion(ledger: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean over both legs of the mean |percent move| between entry and exit."""
    move = lambda leg: F.avg(F.abs(ratio(F.col(f"exit_{leg}") - F.col(f"entry_{leg}"), F.col(f"entry_{leg}"))) * 100)
    return ledger.groupBy(*(keys or KEYS)).agg(F.coalesce((move("s1") + move("s2")) / 2, F.lit(0.0)).alias("mean_reversion"))


def win_loss_means(ledger: DataFrame, keys: list[str] | None = None) -> DataFrame:
    p = F.col("pnl")
    return ledger.groupBy(*(keys or KEYS)).agg(
        F.avg(F.when(p > 0, p)).alias("mean_win"), F.avg(F.when(p < 0, p)).alias("mean_loss"), F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"),
        F.count_if((p <= 0) & (p + F.col("fees") > 0)).alias("lost_to_cost"), F.max_by("trade_no", F.struct(-p, -F.col("trade_no"))).alias("worst_trade"),
    )


def regression(df: DataFrame, y: str, x: str, keys: list[str]) -> DataFrame:
    """slope, intercept, r, n, stderr and t of the slope."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"), F.count("*").alias("n")
    )
    free = F.col("n") - 2
    t = ratio(F.col("r") * F.sqrt(F.greatest(free, F.lit(0))), F.sqrt(F.greatest(1 - F.col("r") * F.col("r"), F.lit(0.0))))
    return rows.withColumn("t", t).withColumn("stderr", ratio(F.col("slope"), F.col("t")))


def feature_correlations(ledger: DataFrame, features: list[str], target: str, keys: list[str]) -> DataFrame:
    """(feature, corr) of each feature with the target, by keys."""
    wide = ledger.groupBy(*keys).agg(*[F.corr(f, target).alias(f) for f in features])
    return wide.unpivot(keys, features, "feature", "corr")


def exit_rates(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Shares of the exit types."""
    share = lambda kind: ratio(F.count_if(F.col("exit_type") == kind), F.count("*")).alias(f"{kind}_rate")
    return trades.groupBy(*(keys or KEYS)).agg(F.count("*").alias("trades"), share("win"), share("loss"), share("forced_exit"))


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Counts of the values of a column with few of them, and shares of the total."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("__all"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("__all")).alias("share"))  # one row


def sums_below(counts: DataFrame, value: str, amount: str, alias: str, pieces: int = 256) -> DataFrame:
    """Adds the sum of ``amount`` over all rows with a smaller ``value``.  Rows are cut into ``pieces`` by approximate quantiles,
    which need not be exact: a running sum in each piece and the pieces' totals (at most ``pieces`` rows) give the whole."""
    marks = counts.agg(F.percentile_approx(value, [i / pieces for i in range(1, pieces)], 10_000)).first()[0] or []
    rows = counts.withColumn("__piece", F.size(F.filter(F.array(*map(F.lit, sorted(set(marks)))), lambda m: m < F.col(value))) if marks else F.lit(0))
    totals = sorted((r[0], r[1]) for r in rows.groupBy("__piece").agg(F.sum(amount)).collect())  # at most ``pieces`` rows
    before, seen = [], 0
    for piece, n in totals:
        before += [F.lit(piece), F.lit(seen)]
        seen += n
    w = Window.partitionBy("__piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(amount).over(w), F.lit(0))
    start = F.create_map(*before)[F.col("__piece")] if before else F.lit(0)
    return rows.withColumn("__own", own).withColumn(alias, F.col("__own") + start).drop("__piece", "__own")


def mann_whitney(df: DataFrame, value: str, group: str, first: str) -> DataFrame:
    """U of the rows whose ``group`` is ``first`` against the others, z (tie correction, continuity 0.5) and both sizes, for
    the alternative "greater".  Values are counted first, so ranks come from sums over distinct values."""
    own = F.count_if(F.col(group) == first)
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"), own.alias("c1"))
    ranked = sums_below(counts, value, "c", "below")
    sums = ranked.agg(
        F.sum(F.col("c1") * (F.col("below") + (F.col("c") + 1) / 2)).alias("r1"), F.sum("c1").alias("n1"), F.sum(F.col("c") - F.col("c1")).alias("n2"),
        F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"),
    )
    n = F.col("n1") + F.col("n2")
    sums = sums.withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - ratio(F.col("ties").cast("double"), (n * (n - 1)).cast("double"))))
    return sums.select("u", "n1", "n2", ratio(F.col("u") - F.col("n1") * F.col("n2") / 2 - 0.5, sd).alias("z"))


def risk_sized(bars: DataFrame, risk: float, entry: float = 1.0, stop: float = 2.0, window: int = 20, keys: list[str] | None = None) -> DataFrame:
    """(pair, trade_no, position, size, stopped, pnl): trades sized so that a move from the entry level to the stop level costs
    ``risk``; levels come from mean and deviation of the last ``window`` spreads at entry.  A spread at the stop level ends
    the trade at -risk."""
    keys = keys or ["pair"]
    recent = Window.partitionBy(*keys).orderBy("ts").rowsBetween(1 - window, 0)
    rows = bars.withColumn("__m", F.avg("spread").over(recent)).withColumn("__s", F.stddev_samp("spread").over(recent))
    rows = rows.withColumn("__s", F.when(F.col("__s") == 0, F.lit(1e-8)).otherwise(F.col("__s"))).where("trade_no is not null")
    trade = Window.partitionBy(*keys, "trade_no").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c, name in (("spread", "__spread0"), ("__m", "__m0"), ("__s", "__s0"), ("position", "__side"), ("ts", "__ts0")):
        rows = rows.withColumn(name, F.first(c).over(trade))
    level = F.col("__m0") - F.col("__side") * stop * F.col("__s0")
    size = F.lit(risk) / (abs(stop - entry) * F.col("__s0"))
    rows = rows.withColumn("size", size).withColumn("__profit", F.col("__side") * size * (F.col("spread") - F.col("__spread0")))
    rows = rows.withColumn("__hit", (F.col("ts") > F.col("__ts0")) & (F.col("__side") * (F.col("spread") - level) <= 0))
    found = rows.groupBy(*keys, "trade_no").agg(F.first("__side").alias("position"), F.first("size").alias("size"), F.bool_or("__hit").alias("stopped"), F.max_by("__profit", "ts").alias("__last"))
    return found.select(*keys, "trade_no", "position", "size", "stopped", F.when(F.col("stopped"), F.lit(-float(risk))).otherwise(F.col("__last")).alias("pnl"))


def mid_and_spread(book: DataFrame) -> DataFrame:
    """Adds mid, quoted spread in percent of the bid, money at ask and bid, and slippage of each side against mid in percent."""
    rows = book.withColumn("mid", (F.col("ask") + F.col("bid")) / 2).withColumn("quoted_spread", ratio(F.col("ask") - F.col("bid"), F.col("bid")) * 100)
    rows = rows.withColumn("ask_liquidity", F.col("ask") * F.col("ask_amount")).withColumn("bid_liquidity", F.col("bid") * F.col("bid_amount"))
    return rows.withColumn("ask_slippage", ratio(F.col("ask") - F.col("mid"), F.col("mid")) * 100).withColumn("bid_slippage", ratio(F.col("mid") - F.col("bid"), F.col("mid")) * 100)


def as_of(bars: DataFrame, events: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Each bar with the latest event's value at or before it, 0 before the first: a union and one window, no range join."""
    both = bars.select(*keys, "ts", F.lit(1).alias("__bar"), F.lit(None).cast("double").alias(value)).unionByName(events.select(*keys, "ts", F.lit(0).alias("__bar"), F.col(value)))
    w = Window.partitionBy(*keys).orderBy("ts", "__bar").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(0.0))).where("__bar = 1").drop("__bar")
