"""Time bars.  Ties at one time are broken by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bar(width: str):
    return F.window("ts", width)["start"].alias("bar")


def last_of(column: str, alias: str | None = None):
    """The latest non-null value."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.struct("ts", "id"))).alias(alias or column)


def ohlcv(ticks: DataFrame, width: str) -> DataFrame:
    order = F.struct("ts", "id")
    return ticks.groupBy("symbol", bar(width)).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("amount").alias("volume"),
    ).where("open is not null")


def tick_bars(ticks: DataFrame, width: str) -> DataFrame:
    return ticks.groupBy("symbol", bar(width)).agg(last_of("price"), F.sum("amount").alias("amount"), last_of("side")).where("price is not null and side is not null")


def book_bars(book: DataFrame, width: str = "1 minute") -> DataFrame:
    fields = ("bid", "ask", "bid_amount", "ask_amount")
    return book.groupBy("symbol", bar(width)).agg(*[last_of(c) for c in fields]).na.drop("any", subset=list(fields))


def last_prices(ticks: DataFrame, widths: list[str]) -> DataFrame:
    """(width, symbol, bar, price) for each width, bars without a tick as nulls: from each symbol's first to its last bar.
    The bars of the finest width that divides the others feed them, so ticks are grouped once."""
    finest = ticks.groupBy("symbol", bar(widths[0])).agg(last_of("price"))
    out = None
    for w in widths:
        step = F.expr(f"interval {w}")
        own = finest.withColumn("ts", F.col("bar")).groupBy("symbol", F.window("ts", w)["start"].alias("bar")).agg(F.max_by("price", "ts").alias("price"))
        range_ = own.groupBy("symbol").agg(F.min("bar").alias("a"), F.max("bar").alias("b"))
        grid = range_.select("symbol", F.explode(F.sequence("a", "b", step)).alias("bar"))
        part = grid.join(own, ["symbol", "bar"], "left").select(F.lit(w).alias("width"), "symbol", "bar", "price")
        out = part if out is None else out.unionByName(part)
    return out


def mean_daily_value(ticks: DataFrame) -> DataFrame:
    """Mean over the calendar days from first to last of the sum of price x amount; days without ticks count as 0."""
    days = F.datediff(F.max("day"), F.min("day")) + 1
    daily = ticks.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum(F.col("price") * F.col("amount")).alias("value"))
    return daily.groupBy("symbol").agg((F.sum("value") / days).alias("mean_value"))


def holds(ticks: DataFrame, widths: list[str]) -> DataFrame:
    """(symbol, width, held, bars): bars whose price equals the last bar's."""
    out = None
    for w in widths:
        bars = ticks.groupBy("symbol", bar(w)).agg(last_of("price"))
        before = F.lag("price").over(Window.partitionBy("symbol").orderBy("bar"))
        part = bars.withColumn("same", F.col("price") == before).groupBy("symbol").agg(F.count_if("same").alias("held"), F.count("*").alias("bars")).withColumn("width", F.lit(w))
        out = part if out is None else out.unionByName(part)
    return out
