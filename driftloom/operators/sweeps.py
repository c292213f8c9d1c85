"""Parameter sweeps: the fold runs once for each pair, costs are applied to its trades."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.operators import fold
from driftloom.operators import trades as M


def threshold_sweep(signals: DataFrame, rules: list[fold.Rules], capital: float, cost: float = 0.0) -> DataFrame:
    """(param, pair, trades, total_return in percent, win_rate, max_drawdown)."""
    ledger = M.with_pnl(fold.strategy_trades(signals, rules), capital, cost)
    rows = ledger.groupBy(*M.KEYS).agg(F.count("*").alias("trades"), (F.sum("pnl") / capital * 100).alias("total_return"), M.win_rate(F.col("pnl")).alias("win_rate"))
    return rows.join(M.max_drawdowns(ledger, capital).select(*M.KEYS, "max_drawdown"), M.KEYS)


def cost_sweep(trades: DataFrame, costs: list[float], capital: float) -> DataFrame:
    """(pair, param, tx_cost, trades, total_return) for each fee rate."""
    rates = F.explode(F.array(*map(F.lit, costs)))
    ledger = M.with_pnl(trades.withColumn("tx_cost", rates), capital, None)
    return ledger.groupBy(*M.KEYS, "tx_cost").agg(F.count("*").alias("trades"), (F.sum("pnl") / capital * 100).alias("total_return"))


def cost_matrix(trades: DataFrame, costs: list[float], capital: float) -> DataFrame:
    """A row for each parameter set, a column for each cost, summed over pairs."""
    swept = cost_sweep(trades, costs, capital).withColumn("at", F.format_number("tx_cost", 4))
    return swept.groupBy("param").pivot("at", [f"{c:.4f}" for c in costs]).agg(F.sum("total_return"))


def backtest(pairs: DataFrame, *, window: int = 288, entry: float = 3.0, exit: float = 0.0, stop: float = 100.0, capital: float = 10_000.0, cost: float = 0.0) -> DataFrame:
    """Pair frames to key metrics, every pair in one job."""
    from driftloom.operators.spread import signals as signals_of

    signals = signals_of(pairs, window)
    ledger = M.with_pnl(fold.strategy_trades(signals, [fold.Rules(entry, exit, stop)]), capital, cost)
    return M.key_metrics(ledger, signals, capital)


def strategy_comparison(ledger: DataFrame, signals: DataFrame, cycles: DataFrame, capital: float, bars_per_day: int = 288) -> DataFrame:
    """A row for each pair and strategy (param): return, annual Sharpe ratio, drawdown, trades, wins, losses, and cycles
    without a trade."""
    rows = ledger.groupBy(*M.KEYS).agg((F.sum("pnl") / capital * 100).alias("total_return"), F.count("*").alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"), F.count_if(F.col("pnl") < 0).alias("losses"))
    rows = rows.join(M.annual_sharpe(ledger, signals, capital, bars_per_day), M.KEYS).join(M.max_drawdowns(ledger, capital).select(*M.KEYS, "max_drawdown"), M.KEYS)
    count = cycles.where("cycle_id is not null").groupBy("pair").agg(F.countDistinct("cycle_id").alias("cycles"))
    return rows.join(count, "pair", "left").withColumn("missed", F.coalesce("cycles", F.lit(0)) - F.col("trades"))


def report_tables(signals: DataFrame, ledger: DataFrame, capital: float, bins: int = 50) -> dict[str, DataFrame]:
    """What a report shows: z-score and trade-return histograms over [-bins/10, bins/10) and the equity curve."""
    def bars(df: DataFrame, column, width: float) -> DataFrame:
        at = F.least(F.greatest(F.floor(column / width), F.lit(-bins)), F.lit(bins - 1)).cast("long").alias("bin")
        return df.where(column.isNotNull()).groupBy("pair", at).agg(F.count("*").alias("n")).withColumn("low", F.col("bin") * width)

    return {
        "z_histogram": bars(signals, F.col("z"), 0.1),
        "return_histogram": bars(ledger, F.col("pnl") / capital * 100, 0.1),
        "equity": M.cumulative_pnl(ledger).select(*M.KEYS, "trade_no", "exit_ts", "pnl", "cum_pnl"),
    }


def clipped_trades(ledger: DataFrame, first: str, last: str) -> DataFrame:
    """Trades that touch a window of time, for plots."""
    return ledger.where((F.col("exit_ts") >= F.lit(first).cast("timestamp_ntz")) & (F.col("entry_ts") <= F.lit(last).cast("timestamp_ntz")))


def random_search(space: dict[str, tuple], trials: int, seed: int = 0) -> list[dict]:
    """Seeded trials: a pair of floats is a logarithmic range, a list is a choice."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trials):
        out.append({k: v[rng.integers(len(v))] if isinstance(v, list) else float(np.exp(rng.uniform(np.log(v[0]), np.log(v[1])))) for k, v in space.items()})
    return out
