"""Column layouts.  Symbols are data: panels are long, and wide only at the edges."""

from __future__ import annotations

from pathlib import Path

KLINE_COLUMNS = (
    "open_time", "open", "high", "low", "close", "volume", "close_time",
    "quote_volume", "trades", "taker_base_volume", "taker_quote_volume", "ignored",
)
KLINE = "open_time bigint, open double, high double, low double, close double, volume double, close_time bigint, quote_volume double, trades bigint, taker_base_volume double, taker_quote_volume double, ignored string"
TRADE = "exchange string, symbol string, timestamp bigint, local_timestamp bigint, id string, side string, price double, amount double"
BOOK = "local_timestamp timestamp_ntz, `asks[0].price` double, `asks[0].amount` double, `bids[0].price` double, `bids[0].amount` double"
OHLCV = "ts timestamp_ntz, open double, high double, low double, close double, volume double"
PANEL = "ts timestamp_ntz, symbol string, price double"

#: Display names of the key-metrics row (fixed values that reports show).
DISPLAY = {
    "pair": "Pair",
    "total_return": "Total return (%)",
    "sharpe": "Sharpe ratio",
    "max_drawdown": "Max drawdown (%)",
    "trades": "Number of trades",
    "win_rate": "Non-stop loss win rate (%)",
    "mean_duration": "Mean trade duration/Reversion speed from threshold (mins)",
    "mean_beta": "Average entry beta",
    "mean_drift": "Mean Absolute Percent Delta Beta (%)",
    "median_drift": "Median Absolute Percent Delta Beta (%)",
    "beta_returns_std": "Beta series returns std (%)",
    "beta_returns_mad": "Beta series returns MAD (%)",
    "mean_s1_return": "Average S1 trade return (%)",
    "mean_s2_return": "Average S2 trade return (%)",
}


class Folders:
    """Where results and inputs lie, under one root."""

    def __init__(self, root: str = "."):
        self.root = root

    def results(self, *parts: str) -> str:
        return str(Path(self.root, "results", *parts)) if "://" not in self.root else "/".join([self.root, "results", *parts])

    def dataset(self, *parts: str) -> str:
        return str(Path(self.root, "dataset", *parts)) if "://" not in self.root else "/".join([self.root, "dataset", *parts])
