"""Window functions over one symbol or pair: returns, volatilities, smoothing, drawdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(keys: list[str], order: str = "ts"):
    return Window.partitionBy(*keys).orderBy(order)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def log_returns(panel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds ret; each symbol's first row goes."""
    last = F.lag("price").over(by(keys or ["symbol"]))
    return panel.withColumn("ret", F.ln(ratio(F.col("price"), last))).where("ret is not null")


def standardised(returns: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds std_ret: (ret - mean) / sample deviation over the whole symbol."""
    w = Window.partitionBy(*(keys or ["symbol"]))
    return returns.withColumn("std_ret", ratio(F.col("ret") - F.avg("ret").over(w), F.stddev_samp("ret").over(w)))


def pct_change(df: DataFrame, column: str, keys: list[str], alias: str) -> DataFrame:
    return df.withColumn(alias, ratio(F.col(column), F.lag(column).over(by(keys))) - 1)


def difference(df: DataFrame, column: str, keys: list[str], alias: str) -> DataFrame:
    return df.withColumn(alias, F.col(column) - F.lag(column).over(by(keys)))


def rolling_std(df: DataFrame, column: str, size: int, keys: list[str], alias: str) -> DataFrame:
    """Sample deviation of the last ``size`` values, this one included; null before there are so many."""
    w = by(keys).rowsBetween(1 - size, 0)
    return df.withColumn(alias, F.when(F.count(column).over(w) == size, F.stddev_samp(column).over(w)))


def moving_average(df: DataFrame, column: str, size: int, keys: list[str], alias: str) -> DataFrame:
    """Mean of the last ``size`` values or as many as there are."""
    return df.withColumn(alias, F.avg(column).over(by(keys).rowsBetween(1 - size, 0)))


def smoothed(df: DataFrame, column: str, keys: list[str], alias: str, factor: float = 0.9, order: str = "ts") -> DataFrame:
    """s = factor s + (1 - factor) x, started with the first value; for short series: a key's values meet in one array."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(column).alias("x"))))
    step = f"aggregate(slice(v, 1, i), cast(null as double), (s, r) -> if(s is null, r.x, {factor} * s + {1 - factor} * r.x))"
    arrays = df.groupBy(*keys).agg(rows.alias("v"))
    return arrays.select(*keys, F.posexplode("v").alias("i0", "r"), "v").withColumn("i", F.col("i0") + 1).select(*keys, F.col(f"r.{order}").alias(order), F.col("r.x").alias(column), F.expr(step).alias(alias))


def cumulative(df: DataFrame, column: str, keys: list[str], alias: str, order: str = "ts") -> DataFrame:
    return df.withColumn(alias, F.sum(column).over(by(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def drawdown(df: DataFrame, profit: str, keys: list[str], capital: float, order: str = "ts", include_initial: bool = False) -> DataFrame:
    """Adds value (capital + running profit), peak and drawdown (value - peak) / peak.  The capital itself is no peak unless
    ``include_initial``."""
    w = by(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("value", F.lit(float(capital)) + F.sum(profit).over(w))
    peak = F.max("value").over(w)
    rows = rows.withColumn("peak", F.greatest(peak, F.lit(float(capital))) if include_initial else peak)
    return rows.withColumn("drawdown", ratio(F.col("value") - F.col("peak"), F.col("peak")))


def record_counts(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """How often a value exceeds all earlier ones, or falls below them."""
    w = by(keys).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("high", F.max(column).over(w)).withColumn("low", F.min(column).over(w))
    return rows.groupBy(*keys).agg(F.count_if(F.col(column) > F.col("high")).alias("highs"), F.count_if(F.col(column) < F.col("low")).alias("lows"))


def mad(column: str, keys: list[str], df: DataFrame, alias: str = "mad") -> DataFrame:
    """Median absolute deviation from the median, by key."""
    centre = df.groupBy(*keys).agg(F.median(column).alias("__m"))
    return df.join(centre, keys).groupBy(*keys).agg(F.median(F.abs(F.col(column) - F.col("__m"))).alias(alias))
