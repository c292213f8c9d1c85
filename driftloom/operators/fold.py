"""Sequential operators: the threshold strategy and z-score cycles, as folds over one pair's bars at a time.

A fold runs once for each pair and takes all parameter sets of a sweep, so bars are neither copied nor shuffled again for a
sweep.  It gives either bars (the strategy's state on each) or trades, which suffice for all metrics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rules:
    """``book``: the order-book variant (flat on the first bar; a lock is set by a stop only, clears at ``exit`` on the far
    side, and its bar stays flat).  An infinite ``stop`` gives the plain two-state machine."""

    entry: float = 1.0
    exit: float = 0.0
    stop: float = 2.0
    book: bool = False
    name: str = ""

    @property
    def label(self) -> str:
        return self.name or f"{self.entry:g}/{self.exit:g}/{self.stop:g}"


@dataclass
class Deal:
    """A trade by bar numbers."""

    side: int
    opened: int
    closed: int = -1
    outcome: str = ""


def run_rules(z: np.ndarray, rules: Rules) -> tuple[np.ndarray, list[Deal]]:
    """Positions (after the bar's action) and trades.  A missing z holds the position.

    ``away`` is how far the spread still stands on the side on which the trade was opened; a lock remembers the side of the
    stopped trade (or the opposite of a z that was beyond the stop while flat) until z reaches the other side of zero."""
    side = lock = 0
    held = np.zeros(len(z), dtype=np.int32)
    deals: list[Deal] = []
    for i, v in enumerate(z.tolist()):
        if v != v or (rules.book and i == 0):
            held[i] = side
            continue
        if lock and not rules.book and lock * v >= 0:
            lock = 0
        if side:
            away = -side * v
            if away <= rules.exit:
                deals[-1].closed, deals[-1].outcome = i, "win"
                side = lock = 0
            elif away >= rules.stop:
                deals[-1].closed, deals[-1].outcome = i, "loss"
                side, lock = 0, side
        elif lock:
            if rules.book and lock * v >= rules.exit:
                lock = 0
        elif abs(v) >= rules.stop and not rules.book:
            lock = -1 if v > 0 else 1
        elif abs(v) >= rules.entry:
            side = -1 if v > 0 else 1
            deals.append(Deal(side, i))
        held[i] = side
    if side:
        deals[-1].closed, deals[-1].outcome = len(z) - 1, "forced_exit"
    return held, deals


def cycle_ids(z: np.ndarray, threshold: float = 1.0, tolerance: float = 0.1) -> np.ndarray:
    """0 outside, else the number of the cycle: from |z| >= threshold to the first z on or beyond zero, both included.  Bars
    before the first |z| <= tolerance (if there is one) are skipped, an unfinished cycle is dropped."""
    out = np.zeros(len(z), dtype=np.int64)
    near = np.flatnonzero(np.abs(z) <= tolerance)
    start, sign, number = -1, 0, 0
    for i in range(int(near[0]) if near.size else 0, len(z)):
        v = z[i]
        if sign == 0:
            if abs(v) >= threshold:
                start, sign = i, 1 if v > 0 else -1
        elif sign * v <= 0:
            number += 1
            out[start : i + 1] = number
            sign = 0
    return out


def crossings(z: np.ndarray, entry: float, stop: float, release: float = 0.1) -> list[tuple[int, int, float, int, float, str]]:
    """The interpolated variant: (side, entry bar, entry share, exit bar, exit share, outcome).  Entries are crossings of the
    entry level, exits crossings of zero (win) or of the stop (loss), at the share of the bar at which the straight line
    from the last bar meets the level; an entry bar that also crosses the stop closes at once.  After a loss no trade
    opens until |z| <= release.  An open trade closes at the last bar."""
    out: list[tuple[int, int, float, int, float, str]] = []
    side, opened, share, lock = 0, 0, 0.0, False
    for i in range(1, len(z)):
        a, b = z[i - 1], z[i]
        if np.isnan(a) or np.isnan(b):
            continue
        if side == 0:
            if lock:
                lock = abs(b) > release
                continue
            for s in (-1, 1):  # -1: z rises through the entry level
                if -s * a < entry <= -s * b:
                    side, opened, share = s, i, (entry + s * a) / (-s * (b - a))
                    if -s * b >= stop:
                        out.append((s, i, share, i, (stop + s * a) / (-s * (b - a)), "loss"))
                        side, lock = 0, True
                    break
        elif side * b >= 0:
            out.append((side, opened, share, i, min(1.0, a / (a - b)) if a != b else 1.0, "win"))
            side = 0
        elif -side * b >= stop:
            out.append((side, opened, share, i, (stop + side * a) / (-side * (b - a)) if -side * a < stop else 0.0, "loss"))
            side, lock = 0, True
    if side:
        out.append((side, opened, share, len(z) - 1, 1.0, "forced_exit"))
    return out


def interpolated(values: np.ndarray, bar: int, share: float) -> float:
    return float(values[bar - 1] + share * (values[bar] - values[bar - 1]))


BAR_FIELDS = [T.StructField("position", T.IntegerType()), T.StructField("trade_no", T.LongType()), T.StructField("event", T.StringType())]


def strategy_bars(signals: DataFrame, rules: Rules, keys: list[str] | None = None) -> DataFrame:
    """The bars with position, trade_no (from entry to exit bar, both included) and event: entry, win, loss, forced_exit; a
    trade that is opened on the last bar has the event ``entry`` there."""
    keys = keys or ["pair"]
    schema = T.StructType([*signals.schema.fields, *BAR_FIELDS])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", kind="stable", ignore_index=True)
        held, deals = run_rules(rows["z"].to_numpy(dtype=float), rules)
        number, event = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), None, dtype=object)
        for k, d in enumerate(deals, 1):
            number[d.opened : d.closed + 1] = k
            event[d.closed] = d.outcome
            event[d.opened] = "entry"
        return rows.assign(position=held, trade_no=pd.array(np.where(number > 0, number, -1), dtype="Int64"), event=event).assign(trade_no=lambda r: r["trade_no"].mask(r["trade_no"] < 0))

    return signals.groupBy(*keys).applyInPandas(run, schema)


TRADE_FIELDS = (
    "param string, trade_no long, position int, entry_ts timestamp_ntz, entry_s1 double, entry_s2 double, entry_z double, entry_beta double, entry_std double, "
    "exit_ts timestamp_ntz, exit_s1 double, exit_s2 double, exit_z double, exit_beta double, exit_type string, bars long, "
    "drift double, beta_std double, beta_range double, max_mismatch double, mean_mismatch double"
)
PRICES = ("s1_ask", "s1_bid", "s2_ask", "s2_bid")


def strategy_trades(signals: DataFrame, rules: list[Rules], keys: list[str] | None = None, segment: str | None = None) -> DataFrame:
    """A row for each trade and parameter set.  With ``segment`` (a column, null outside all) each segment is run by itself.
    With ask and bid columns, trades are filled across the spread.  drift: mean |percent change of beta since entry| over the
    bars after the entry up to the exit; beta_std and beta_range include the entry bar; mismatch compares beta with the
    ratio of the legs' moves inside the trade."""
    keys = keys or ["pair"]
    book = all(c in signals.columns for c in PRICES)
    head = T.StructType([signals.schema[k] for k in keys] + ([T.StructField(segment, signals.schema[segment].dataType)] if segment else []))
    body = T.StructType.fromDDL(TRADE_FIELDS)
    schema = T.StructType([*head.fields, *body.fields])
    needed = dict.fromkeys([*keys, "ts", "s1", "s2", "z", "beta", "z_std", *(PRICES if book else ()), *([segment] if segment else [])])

    def fill(leg: str, buy: bool) -> str:
        return f"{leg}_{'ask' if buy else 'bid'}" if book else leg

    def trades_of(rows: pd.DataFrame, first: list) -> Iterator[list]:
        z, beta = rows["z"].to_numpy(dtype=float), rows["beta"].to_numpy(dtype=float)
        col = {c: rows[c].to_numpy() for c in rows.columns}
        for r in rules:
            for k, d in enumerate(run_rules(z, r)[1], 1):
                a, b, up = d.opened, d.closed, d.side > 0
                inside, held = beta[a + 1 : b + 1], beta[a : b + 1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    drift = np.abs((beta[a] - inside) / beta[a]).mean() * 100 if inside.size and beta[a] else None
                    d1, d2 = np.diff(col["s1"][a : b + 1]), np.diff(col["s2"][a : b + 1])
                    gap = np.abs(beta[a] - d1 / np.where(d2 == 0, 1, d2))
                yield [
                    *first, r.label, k, d.side, col["ts"][a], col[fill("s1", up)][a], col[fill("s2", not up)][a], z[a], beta[a], col["z_std"][a],
                    col["ts"][b], col[fill("s1", not up)][b], col[fill("s2", up)][b], z[b], beta[b], d.outcome, b - a,
                    drift, held.std(), held.max() - held.min(), gap.max() if gap.size else None, gap.mean() if gap.size else None,
                ]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", kind="stable", ignore_index=True)
        first = [rows[k].iloc[0] for k in keys]
        parts = rows.dropna(subset=[segment]).groupby(segment, sort=True) if segment else [(None, rows)]
        found = [t for s, part in parts for t in trades_of(part.reset_index(drop=True), [*first, s] if segment else first)]
        out = pd.DataFrame(found, columns=schema.names)
        for name in ("drift", "max_mismatch", "mean_mismatch"):
            out[name] = out[name].astype("Float64")
        return out

    return signals.select(*needed).groupBy(*keys).applyInPandas(run, schema)


def with_cycles(signals: DataFrame, threshold: float = 1.0, tolerance: float = 0.1, keys: list[str] | None = None) -> DataFrame:
    """Bars with a z and their cycle_id (null outside cycles)."""
    keys = keys or ["pair"]
    schema = T.StructType([*signals.schema.fields, T.StructField("cycle_id", T.LongType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", kind="stable", ignore_index=True)
        ids = cycle_ids(rows["z"].to_numpy(dtype=float), threshold, tolerance)
        return rows.assign(cycle_id=pd.array(ids, dtype="Int64")).assign(cycle_id=lambda r: r["cycle_id"].mask(r["cycle_id"] == 0))

    return signals.where("z is not null").groupBy(*keys).applyInPandas(run, schema)


def crossing_trades(signals: DataFrame, entry: float, stop: float, keys: list[str] | None = None) -> DataFrame:
    """Trades of the interpolated variant: times of the bars, prices and z at the crossings."""
    keys = keys or ["pair"]
    fields = "trade_no long, position int, entry_ts timestamp_ntz, entry_s1 double, entry_s2 double, entry_z double, entry_beta double, exit_ts timestamp_ntz, exit_s1 double, exit_s2 double, exit_z double, exit_type string"
    schema = T.StructType([*(signals.schema[k] for k in keys), *T.StructType.fromDDL(fields).fields])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", kind="stable", ignore_index=True)
        z, s1, s2 = (rows[c].to_numpy(dtype=float) for c in ("z", "s1", "s2"))
        out = []
        for k, (side, a, x, b, y, outcome) in enumerate(crossings(z, entry, stop), 1):
            out.append([*(rows[c].iloc[0] for c in keys), k, side, rows["ts"][a], interpolated(s1, a, x), interpolated(s2, a, x), interpolated(z, a, x), rows["beta"][a],
                        rows["ts"][b], interpolated(s1, b, y), interpolated(s2, b, y), interpolated(z, b, y), outcome])
        return pd.DataFrame(out, columns=schema.names)

    return signals.groupBy(*keys).applyInPandas(run, schema)


def episodes(bars: DataFrame, history: int = 100, trading: int = 50, keys: list[str] | None = None) -> DataFrame:
    """Fixed episodes: adds episode (from 0) and phase; episode k forms on ``history`` bars and trades on the next
    ``trading``, and moves on by ``trading``; (n - history) // trading of them.  Bars are repeated where episodes overlap."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    by = Window.partitionBy(*(keys or ["pair"]))
    rows = bars.withColumn("__i", F.row_number().over(by.orderBy("ts")) - 1).withColumn("__n", F.count("*").over(by))
    first = F.greatest(F.lit(0), F.floor((F.col("__i") - (history + trading)) / trading) + 1)
    last = F.least(F.floor(F.col("__i") / trading), F.floor((F.col("__n") - history) / trading) - 1)
    rows = rows.where(first <= last).withColumn("episode", F.explode(F.sequence(first, last)))
    at = F.col("__i") - F.col("episode") * trading
    return rows.withColumn("phase", F.when(at < history, "formation").otherwise("trading")).drop("__i", "__n")
