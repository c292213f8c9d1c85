"""Readers of market files and adapters from the star-schema tables."""

from __future__ import annotations

import csv
import json
import time
import urllib.parse
import urllib.request

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from driftloom import schema as S


def price_csv(spark: SparkSession, path: str, symbols: list[str]) -> DataFrame:
    """A wide price file (timestamp, then a column for each symbol) as a long panel."""
    wide = spark.read.csv(path, header=True, schema="ts timestamp_ntz, " + ", ".join(f"`{s}` double" for s in symbols))
    return wide.unpivot("ts", symbols, "symbol", "price").where("price is not null")


def trades_csv(spark: SparkSession, pattern: str) -> DataFrame:
    """Tick files (also gzip, also a glob): (ts, symbol, side, price, amount, id, file)."""
    raw = spark.read.csv(pattern, header=True, schema=S.TRADE)
    return raw.select(F.timestamp_micros("timestamp").cast("timestamp_ntz").alias("ts"), "symbol", "side", "price", "amount", "id", F.input_file_name().alias("file"))


def klines(spark: SparkSession, path: str) -> DataFrame:
    """Headerless kline files, the symbol from the file's name.  Rows without any value go; a file whose times exceed 1e13 is
    in microseconds."""
    raw = spark.read.csv(path, schema=S.KLINE, mode="PERMISSIVE").withColumn("file", F.input_file_name())
    raw = raw.na.drop("all", subset=list(S.KLINE_COLUMNS))
    micro = F.max("open_time").over(Window.partitionBy("file")) > F.lit(10**13)
    unit = F.when(micro, F.lit(1000)).otherwise(F.lit(1))
    base = F.regexp_extract("file", r"([^/]+?)(?:-\d{4}-\d{2}-\d{2})?\.csv(?:\.gz)?$", 1)
    return raw.select(
        F.timestamp_millis(F.floor(F.col("open_time") / unit)).cast("timestamp_ntz").alias("ts"),
        base.alias("symbol"), "open", "high", "low", "close", "volume",
        F.timestamp_millis(F.floor(F.col("close_time") / unit)).cast("timestamp_ntz").alias("close_ts"), "quote_volume", "trades",
    )


def symbol_of_file(column: str = "file"):
    """"…/BTCUSDT_2024_1m.csv" -> "BTC/USDT_2024_1m"."""
    return F.regexp_replace(F.regexp_extract(column, r"([^/]+)\.csv$", 1), r"^([A-Z0-9]+?)USDT", "$1/USDT")


def closing_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Long panel of closing prices from a folder of files with ``Open Time`` and ``Close``, each by its own header; files
    without them give nothing."""
    lines = spark.read.text(folder, pathGlobFilter="*.csv").select(F.col("_metadata.file_path").alias("file"), "value")
    heads = lines.where(F.col("value").contains("Open Time") & F.col("value").contains("Close")).groupBy("file").agg(F.first("value").alias("head")).collect()  # a row for each file
    files: dict[str, list[str]] = {}
    for r in heads:
        files.setdefault(r.head, []).append(urllib.parse.unquote(r.file))
    out = spark.createDataFrame([], S.PANEL)
    for head, paths in sorted(files.items()):
        names = next(csv.reader([head]))
        if not {"Open Time", "Close"} <= set(names):
            continue
        raw = spark.read.csv(paths, header=True, schema=T.StructType([T.StructField(n, T.StringType()) for n in names]))
        rows = raw.select(F.expr("try_to_timestamp(`Open Time`)").cast("timestamp_ntz").alias("ts"), symbol_of_file("_metadata.file_path").alias("symbol"), F.expr("try_cast(`Close` as double)").alias("price"))
        out = out.unionByName(rows.where("ts is not null and price is not null"))
    return out


def book_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, schema=S.BOOK)
    return raw.select(
        F.col("local_timestamp").alias("ts"), F.col("`asks[0].price`").alias("ask"), F.col("`asks[0].amount`").alias("ask_amount"),
        F.col("`bids[0].price`").alias("bid"), F.col("`bids[0].amount`").alias("bid_amount"),
    )


def frame_of(spark: SparkSession, data: str | DataFrame, schema: str | None = None) -> DataFrame:
    """A DataFrame as it is, or the CSV or Parquet file at a path."""
    if isinstance(data, DataFrame):
        return data
    if not isinstance(data, str):
        raise ValueError("a path or a DataFrame is needed")
    return spark.read.parquet(data) if data.rstrip("/").endswith(".parquet") else spark.read.csv(data, header=True, schema=schema, inferSchema=schema is None)


def listed_by_sector(spark: SparkSession, exchange_info: str, sectors: DataFrame, quote: str = "USDT") -> DataFrame:
    """(sector, coin) of the coins that the exchange lists against ``quote``; ``exchange_info`` is the JSON response."""
    row = spark.createDataFrame([(exchange_info,)], "body string")
    symbols = row.select(F.explode(F.from_json("body", "symbols array<struct<symbol:string,status:string>>")["symbols"]).alias("s"))
    return sectors.join(symbols.select(F.col("s.symbol").alias("listed")), F.concat("coin", F.lit(quote)) == F.col("listed"), "left_semi")


def complete_symbols(files: DataFrame, days: DataFrame) -> DataFrame:
    """Symbols (symbol, day rows) that have every day of ``days``: all or nothing."""
    wanted = days.select("day").distinct()
    found = files.select("symbol", "day").distinct().join(wanted, "day", "left_semi").groupBy("symbol").agg(F.count("*").alias("n"))
    return found.crossJoin(F.broadcast(wanted.agg(F.count("*").alias("all_days")))).where("n = all_days").select("symbol")  # one row


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 day)) as day")


def file_names(spark: SparkSession, symbol: str, interval: str, first: str, last: str) -> DataFrame:
    return calendar(spark, first, last).select(F.format_string(f"{symbol}-{interval}-%s.zip", F.date_format("day", "yyyy-MM-dd")).alias("file"))


def synthetic_pair(spark: SparkSession, n: int = 720, alpha: float = 5.0, beta: float = 1.5, phi: float = 0.8, seed: int = 42) -> DataFrame:
    """Cointegrated test data: s2 = alpha + beta s1 + AR(1) noise, s1 a random walk."""
    rng = np.random.default_rng(seed)
    s1 = 100 + rng.normal(size=n).cumsum()
    noise = np.zeros(n)
    for t in range(1, n):
        noise[t] = phi * noise[t - 1] + rng.normal()
    s2 = alpha + beta * s1 + noise
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(s1, s2, strict=True))]
    return spark.createDataFrame(rows, "row long, s1 double, s2 double")


class KlineSource(DataSource):
    """``spark.read.format("klines_rest")``: a REST endpoint that returns kline arrays.  Options: url, symbols (comma-separated),
    interval, limit (rows a page), start (milliseconds: pages follow until one isn't full), retries (3).  A request that fails
    every time fails the query: no symbol is left out silently."""

    @classmethod
    def name(cls) -> str:
        return "klines_rest"

    def schema(self) -> str:
        return "symbol string, " + S.OHLCV

    def reader(self, schema) -> DataSourceReader:
        return KlineReader(self.options)


class KlineReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s.strip()) for s in self.options["symbols"].split(",")]

    def read(self, partition: InputPartition):
        from datetime import datetime, timezone

        limit, start = int(self.options.get("limit", "365")), self.options.get("start")
        query = {"symbol": partition.value, "interval": self.options.get("interval", "1d"), "limit": str(limit)}
        while True:
            rows = self.page(query | ({"startTime": str(start)} if start is not None else {}))
            for r in rows:
                ts = datetime.fromtimestamp(int(r[0]) / 1000, timezone.utc).replace(tzinfo=None)
                yield (partition.value, ts, *(float(x) for x in r[1:6]))
            if start is None or len(rows) < limit:
                return
            start = int(rows[-1][0]) + 1

    def page(self, query: dict[str, str]) -> list:
        tries = int(self.options.get("retries", "3"))
        for k in range(tries):
            try:
                with urllib.request.urlopen(f"{self.options['url']}?{urllib.parse.urlencode(query)}", timeout=30) as answer:
                    return json.load(answer)
            except (OSError, ValueError):
                if k == tries - 1:
                    raise
                time.sleep(0.5 * 2**k)
        return []


# ---- adapters from the star-schema tables ----


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(spark: SparkSession, sf_dir: str, *, groups: int = 0) -> DataFrame:
    """events as ticks: (ts, symbol, price, amount, id, side); with ``groups`` the symbol is u0, u1, ... by user."""
    symbol = F.concat(F.lit("u"), F.pmod("user_id", F.lit(groups)).cast("string")) if groups else F.col("event_type")
    amount = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(1.0))
    return table(spark, sf_dir, "events").select("ts", symbol.alias("symbol"), F.col("value").alias("price"), amount.alias("amount"), F.col("event_id").alias("id"), F.when(F.pmod("event_id", F.lit(2)) == 0, "buy").otherwise("sell").alias("side"))


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a daily panel: symbol = flag and status, price = mean extended price (8 decimals), volume = quantity."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), F.concat("l_returnflag", "l_linestatus").alias("symbol"))
    return rows.agg(F.round(F.avg("l_extendedprice"), 8).alias("price"), F.sum("l_quantity").cast("double").alias("volume"))


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a daily panel: symbol = priority, price = mean total price (8 decimals)."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_orderpriority").alias("symbol"))
    return rows.agg(F.round(F.avg("o_totalprice"), 8).alias("price"))


def event_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a first-level book: bid = value, ask = value + (1 + id mod 5) cents, amounts from the id."""
    return table(spark, sf_dir, "events").select(
        "ts", F.col("event_type").alias("symbol"), F.col("event_id").alias("id"), F.col("value").alias("bid"),
        (F.col("value") + (1 + F.pmod("event_id", F.lit(5))) / 100).alias("ask"),
        (1.0 + F.pmod("event_id", F.lit(7))).alias("bid_amount"), (1.0 + F.pmod("event_id", F.lit(3))).alias("ask_amount"),
    )
