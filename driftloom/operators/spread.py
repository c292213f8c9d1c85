"""Hedge ratio, spread and z-score of pairs, as window aggregates over the rows before the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.operators.series import by, ratio


def with_spread(pairs: DataFrame, window: int | None, keys: list[str] | None = None) -> DataFrame:
    """Adds beta, alpha, spread: least squares of s1 on s2 over the ``window`` rows before this one (of all rows if None).
    Null during warm-up and where s2 does not vary."""
    keys = keys or ["pair"]
    w = by(keys).rowsBetween(-window, -1) if window else Window.partitionBy(*keys)
    enough = F.count("*").over(w) == window if window else F.lit(True)
    rows = pairs.withColumn("beta", F.when(enough, F.regr_slope("s1", "s2").over(w))).withColumn("alpha", F.when(enough, F.regr_intercept("s1", "s2").over(w)))
    return rows.withColumn("spread", F.col("s1") - F.col("alpha") - F.col("beta") * F.col("s2"))


def with_zscore(spreads: DataFrame, window: int | None, keys: list[str] | None = None) -> DataFrame:
    """Adds z_mean, z_std, z: against mean and sample deviation of the ``window`` spreads before this one (of all if None)."""
    keys = keys or ["pair"]
    w = by(keys).rowsBetween(-window, -1) if window else Window.partitionBy(*keys)
    enough = F.count("spread").over(w) == window if window else F.lit(True)
    rows = spreads.withColumn("z_mean", F.when(enough, F.avg("spread").over(w))).withColumn("z_std", F.when(enough, F.stddev_samp("spread").over(w)))
    return rows.withColumn("z", ratio(F.col("spread") - F.col("z_mean"), F.col("z_std")))


def signals(pairs: DataFrame, window: int, keys: list[str] | None = None) -> DataFrame:
    """Spread and z-score; both windows and a grouped fold by the same keys share one exchange."""
    return with_zscore(with_spread(pairs, window, keys), window, keys)


def expected_profit(signals_: DataFrame) -> DataFrame:
    """Adds expected_profit: the spread's deviation as percentage of the money in both legs."""
    return signals_.withColumn("expected_profit", ratio(F.col("z_std"), F.col("s1") + F.abs("beta") * F.col("s2")) * 100)


def window_fits(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds alpha, beta and spread of one least-squares fit for each key (a pair's window)."""
    return with_spread(windows, None, keys)


def mark_to_market(bars: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds bar_pnl: last position times the change of the spread at the last hedge ratio."""
    w = by(keys or ["pair"])
    change = (F.col("s1") - F.lag("s1").over(w)) - F.lag("beta").over(w) * (F.col("s2") - F.lag("s2").over(w))
    return bars.withColumn("bar_pnl", F.coalesce(F.lag("position").over(w) * change, F.lit(0.0)))
