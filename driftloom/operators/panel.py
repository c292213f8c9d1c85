"""Panels (ts, symbol, price): alignment, pairs, slices, splits, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aligned(panel: DataFrame) -> DataFrame:
    """Rows at times at which every symbol has a price: the inner join of any number of symbols as one count."""
    total = panel.agg(F.countDistinct("symbol").alias("__symbols"))
    per_ts = F.count("symbol").over(Window.partitionBy("ts"))
    rows = panel.where("price is not null").withColumn("__here", per_ts)
    return rows.crossJoin(F.broadcast(total)).where("__here = __symbols").drop("__here", "__symbols")  # one row


def from_common_start(panel: DataFrame) -> DataFrame:
    """Rows from the latest of the symbols' first times on."""
    starts = panel.groupBy("symbol").agg(F.min("ts").alias("first")).agg(F.max("first").alias("__start"))
    return panel.crossJoin(F.broadcast(starts)).where("ts >= __start").drop("__start")  # one row


def wide(panel: DataFrame, symbols: list[str], value: str = "price") -> DataFrame:
    return panel.groupBy("ts").pivot("symbol", symbols).agg(F.first(value))


def with_order(panel: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """Adds symbol_ord: the place in ``symbols``, or the alphabetical order (then as the name itself, no ranking needed)."""
    if symbols is None:
        return panel.withColumn("symbol_ord", F.col("symbol"))
    table = F.create_map(*[F.lit(x) for i, s in enumerate(symbols) for x in (s, i)])
    return panel.withColumn("symbol_ord", table[F.col("symbol")])


def pair_frame(panel: DataFrame, pairs: DataFrame | None = None, symbols: list[str] | None = None) -> DataFrame:
    """(pair, sym1, sym2, ts, s1, s2) for every unordered pair in symbol order, or for the rows (sym1, sym2) of ``pairs``.
    One equi-join on ts; the first symbol is the dependent leg."""
    if pairs is not None:
        listed = pairs.select("sym1", "sym2").distinct()
        left = panel.select("ts", F.col("symbol").alias("sym1"), F.col("price").alias("s1")).join(listed, "sym1")
        right = panel.select("ts", F.col("symbol").alias("sym2"), F.col("price").alias("s2"))
        joined = left.join(right, ["ts", "sym2"])
    else:
        rows = with_order(panel, symbols)
        left = rows.select("ts", F.col("symbol").alias("sym1"), F.col("price").alias("s1"), F.col("symbol_ord").alias("o1"))
        right = rows.select("ts", F.col("symbol").alias("sym2"), F.col("price").alias("s2"), F.col("symbol_ord").alias("o2"))
        joined = left.join(right, "ts").where("o1 < o2")
    return joined.select(F.concat_ws(" ~ ", "sym1", "sym2").alias("pair"), "sym1", "sym2", "ts", "s1", "s2")


def unordered_pairs(symbols: DataFrame) -> DataFrame:
    a, b = symbols.select(F.col("symbol").alias("sym1")), symbols.select(F.col("symbol").alias("sym2"))
    return a.join(b, F.col("sym1") < F.col("sym2"))


def cross_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every symbol of one community with every one of the other: lists of symbols, not of rows."""
    return left.select(F.col("symbol").alias("sym1")).crossJoin(right.select(F.col("symbol").alias("sym2")))


def merged(left: DataFrame, right: DataFrame, on: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """Inner join whose other columns get suffixes where both sides have them."""
    both = set(left.columns) & set(right.columns) - set(on)
    a = left.select(*on, *[F.col(c).alias(c + suffixes[0] if c in both else c) for c in left.columns if c not in on])
    b = right.select(*on, *[F.col(c).alias(c + suffixes[1] if c in both else c) for c in right.columns if c not in on])
    return a.join(b, on)


def mismatches(left: DataFrame, right: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Joined rows in which any of ``columns`` differs; a missing value equals nothing, itself included."""
    rows = merged(left, right, on, ("_left", "_right"))
    differs = [~F.coalesce(F.col(f"{c}_left") == F.col(f"{c}_right"), F.lit(False)) for c in columns]
    return rows.where(reduce(Column.__or__, differs))


def time_range(df: DataFrame, first: str, last: str, column: str = "ts") -> DataFrame:
    """Both ends included; a bare date at the end covers its day."""
    end = F.lit(last).cast("timestamp_ntz")
    if len(last) == 10:
        return df.where((F.col(column) >= F.lit(first).cast("timestamp_ntz")) & (F.col(column) < end + F.expr("interval 1 day")))
    return df.where(F.col(column).between(F.lit(first).cast("timestamp_ntz"), end))


def split_label(df: DataFrame, bounds: dict[str, tuple[str, str]], column: str = "ts") -> DataFrame:
    """Adds split: the first name whose range [from, to) holds the time; null outside all."""
    label = F.lit(None).cast("string")
    for name, (a, b) in reversed(bounds.items()):
        label = F.when((F.col(column) >= F.lit(a).cast("timestamp_ntz")) & (F.col(column) < F.lit(b).cast("timestamp_ntz")), F.lit(name)).otherwise(label)
    return df.withColumn("split", label)


def positions(df: DataFrame, first: int, last: int, keys: list[str], order: str = "ts") -> DataFrame:
    """Rows first to last - 1 of each key, from 0."""
    rows = df.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    return rows.where((F.col("__row") >= first) & (F.col("__row") < last)).drop("__row")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls) rows."""
    counted = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    return counted.unpivot([], columns, "column", "nulls")


def unchanged(panel: DataFrame) -> DataFrame:
    """Times at which no symbol's price differs from its last one."""
    last = F.lag("price").over(Window.partitionBy("symbol").orderBy("ts"))
    return panel.withColumn("__same", last.isNotNull() & (F.col("price") == last)).groupBy("ts").agg(F.bool_and("__same").alias("same")).where("same").select("ts")


def categories(panel: DataFrame, mapping: DataFrame, default: str = "Unknown") -> DataFrame:
    """Adds category from (symbol, category) rows."""
    return panel.join(mapping, "symbol", "left").withColumn("category", F.coalesce("category", F.lit(default)))


def tumbling(df: DataFrame, keys: list[str], size: int, order: str = "ts") -> DataFrame:
    """Adds window_id for whole windows of ``size`` rows; the remainder goes."""
    by = Window.partitionBy(*keys)
    rows = df.withColumn("__row", F.row_number().over(by.orderBy(order)) - 1).withColumn("__n", F.count("*").over(by))
    rows = rows.withColumn("window_id", F.expr(f"__row div {size}").cast("long"))
    return rows.where(F.col("window_id") < F.expr(f"__n div {size}")).drop("__row", "__n")
