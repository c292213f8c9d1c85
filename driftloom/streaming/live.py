"""Streaming forms: bars with a watermark, and the threshold strategy as a stateful fold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.operators.fold import Rules, run_rules


def live_bars(ticks: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """OHLCV bars of a stream of ticks (ts, symbol, price, amount, id); a bar is emitted once the watermark has passed it."""
    order = F.struct("ts", "id")
    rows = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy("symbol", F.window("ts", width)).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("amount").alias("volume")
    ).select("symbol", F.col("window.start").alias("bar"), "open", "high", "low", "close", "volume")


def live_positions(signals: DataFrame, rules: Rules) -> DataFrame:
    """Positions for a stream of (pair, ts, z), bars of a pair arriving in time order across batches.  The state of a pair is
    (side, lock); a batch is folded from there with the same rules as the batch operator."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        side, lock = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        held, side, lock = continued(rows["z"].to_numpy(dtype=float), rules, side, lock)
        state.update((side, lock))
        yield pd.DataFrame({"pair": key[0], "ts": rows["ts"], "position": held})

    return signals.groupBy("pair").applyInPandasWithState(step, "pair string, ts timestamp, position int", "side int, lock int", "append", "NoTimeout")


def continued(z: np.ndarray, rules: Rules, side: int, lock: int) -> tuple[np.ndarray, int, int]:
    """run_rules from a given state, with the state at the end.  The state is set up by bars that lead to it: a lock by a
    z beyond the stop on the other side's sign, an open side by an entry."""
    level = rules.stop if np.isfinite(rules.stop) else rules.entry
    lead = [-side * (rules.entry + level) / 2 if level > rules.entry else -side * rules.entry] if side else [-lock * level] if lock else []
    held, deals = run_rules(np.array([*lead, *z]), rules)
    side = int(held[-1]) if len(held) else side
    if side:
        return held[len(lead) :], side, 0
    probe = run_rules(np.array([*lead, *z, rules.entry]), rules)[0], run_rules(np.array([*lead, *z, -rules.entry]), rules)[0]
    return held[len(lead) :], 0, 1 if probe[1][-1] == 0 else -1 if probe[0][-1] == 0 else 0
