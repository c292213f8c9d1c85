"""Threshold agent: cycle features, reward table, a small Q-network in numpy, evaluation.

Every (cycle, thresholds) reward is computed once, in parallel, by the fold; training only looks rewards up."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.operators import fold
from driftloom.operators import trades as M
from driftloom.operators.series import ratio

FEATURES = ("mean", "std", "n", "low", "high", "skew", "kurt")


def cycle_features(cycles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Seven features of each cycle: mean and deviation of z; length, least, greatest, skewness and excess kurtosis, each
    standardised over all cycles of the pair (population deviation)."""
    keys = keys or ["pair"]
    rows = cycles.where("cycle_id is not null").groupBy(*keys, "cycle_id").agg(
        F.avg("z").alias("mean"), F.stddev_samp("z").alias("std"), F.count("*").cast("double").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"),
        F.skewness("z").alias("skew"), F.kurtosis("z").alias("kurt"),
    )
    w = Window.partitionBy(*keys)
    for c in FEATURES[2:]:
        rows = rows.withColumn(c, ratio(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w)))
    return rows


def legacy_reward(ledger: DataFrame) -> DataFrame:
    """1000 for a win, -500 for a loss, 0 else."""
    return ledger.withColumn("reward", F.when(F.col("exit_type") == "win", 1000).when(F.col("exit_type") == "loss", -500).otherwise(0))


def reward_table(cycles: DataFrame, rules: list[fold.Rules], capital: float = 10_000.0, cost: float = 0.0) -> DataFrame:
    """(pair, cycle_id, param, reward, profit): each cycle's first trade under each rule; 1 for a win, -1 for a loss or no
    trade, 0 for a forced exit."""
    first = M.with_pnl(fold.strategy_trades(cycles, rules, segment="cycle_id").where("trade_no = 1"), capital, cost)
    reward = F.when(F.col("exit_type") == "win", 1.0).when(F.col("exit_type") == "loss", -1.0).otherwise(0.0)
    listed = F.explode(F.array(*[F.lit(r.label) for r in rules]))
    grid = cycles.where("cycle_id is not null").select("pair", "cycle_id").distinct().withColumn("param", listed)
    done = first.select("pair", "cycle_id", "param", reward.alias("reward"), F.col("pnl").alias("profit"), "exit_type")
    joined = grid.join(done, ["pair", "cycle_id", "param"], "left")
    return joined.select("pair", "cycle_id", "param", F.coalesce("reward", F.lit(-1.0)).alias("reward"), F.coalesce("profit", F.lit(0.0)).alias("profit"), F.coalesce("exit_type", F.lit("none")).alias("exit_type"))


def best_rules(rewards: DataFrame, rules: list[fold.Rules]) -> DataFrame:
    """(pair, cycle_id, best): the last rule in order whose trade wins, null if none does."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.label, i)])
    return rewards.groupBy("pair", "cycle_id").agg(F.max_by("param", F.when(F.col("reward") > 0, order[F.col("param")])).alias("best"))


def oracle_curve(rewards: DataFrame, best: DataFrame) -> DataFrame:
    """Running profit of trading each cycle but the first with its own best rule."""
    rows = rewards.join(best.where("best is not null"), ["pair", "cycle_id"]).where("param = best and cycle_id > 1")
    w = Window.partitionBy("pair").orderBy("cycle_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("pair", "cycle_id", "param", "profit", F.sum("profit").over(w).alias("cum_profit"))


def confusion(chosen: DataFrame, best: DataFrame) -> DataFrame:
    """Counts of (chosen, best) over the cycles that were lost."""
    return chosen.where("reward < 0").join(best, ["pair", "cycle_id"]).groupBy("param", "best").agg(F.count("*").alias("n"))


class Net:
    """Three layers with rectifiers; weights as a list of arrays."""

    def __init__(self, inputs: int, outputs: int, hidden: int = 64, seed: int = 0):
        rng = np.random.default_rng(seed)
        sizes = [(inputs, hidden), (hidden, hidden), (hidden, outputs)]
        self.weights = [w for a, b in sizes for w in (rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a))]

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Activations of each layer, the outputs last."""
        out = [x]
        for k in range(0, len(self.weights), 2):
            y = out[-1] @ self.weights[k] + self.weights[k + 1]
            out.append(np.maximum(y, 0) if k < len(self.weights) - 2 else y)
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1]

    def gradients(self, acts: list[np.ndarray], error: np.ndarray) -> list[np.ndarray]:
        grads: list[np.ndarray] = []
        for k in range(len(self.weights) - 2, -1, -2):
            x = acts[k // 2]
            grads = [x.T @ error, error.sum(axis=0), *grads]
            if k:
                error = (error @ self.weights[k].T) * (x > 0)
        return grads


class Replay:
    """The latest ``capacity`` transitions; samples without replacement."""

    def __init__(self, capacity: int, inputs: int, seed: int = 0):
        self.rows = np.zeros((capacity, 2 * inputs + 3), dtype=np.float32)
        self.inputs, self.pushed, self.rng = inputs, 0, np.random.default_rng(seed)

    def __len__(self) -> int:
        return min(self.pushed, len(self.rows))

    def push(self, state, action: int, reward: float, following, done: bool) -> None:
        self.rows[self.pushed % len(self.rows)] = [*state, action, reward, *following, done]
        self.pushed += 1

    def sample(self, n: int) -> tuple[np.ndarray, ...]:
        r, k = self.rows[self.rng.choice(len(self), n, replace=False)], self.inputs
        return r[:, :k], r[:, k].astype(int), r[:, k + 1], r[:, k + 2 : 2 * k + 2], r[:, -1]


@dataclass
class Environment:
    """States are the features of cycle k, rewards those of cycle k + 1."""

    features: np.ndarray
    rewards: np.ndarray  # cycle x action
    profits: np.ndarray

    @staticmethod
    def of(features: DataFrame, rewards: DataFrame, rules: list[fold.Rules], pair: str, limit: int = 200_000) -> Environment:
        """Collects one pair's cycles, at most ``limit``."""
        f = features.where(F.col("pair") == pair).orderBy("cycle_id").limit(limit + 1).toPandas()
        if len(f) > limit:
            raise ValueError("too many cycles for one learner")
        r = rewards.where(F.col("pair") == pair).toPandas()
        table = lambda c: r.pivot(index="cycle_id", columns="param", values=c).reindex(f["cycle_id"])[[x.label for x in rules]].to_numpy(dtype=float)
        return Environment(np.nan_to_num(f[list(FEATURES)].to_numpy(dtype=float)), table("reward"), table("profit"))

    @property
    def steps(self) -> int:
        return max(0, len(self.features) - 1)

    def step(self, k: int, action: int) -> tuple[np.ndarray, float, bool]:
        """(next state, reward, done)."""
        done = k + 1 >= self.steps
        return np.zeros(self.features.shape[1]) if done else self.features[k + 1], float(self.rewards[k + 1, action]), done


@dataclass
class Settings:
    epochs: int = 10
    batch: int = 32
    gamma: float = 0.99
    rate: float = 0.001
    epsilon: tuple[float, float, float] = (1.0, 0.01, 0.995)  # first, least, factor for each epoch
    capacity: int = 1000
    hidden: int = 64
    tau: float = 0.01
    seed: int = 0


@dataclass
class Learned:
    net: Net
    history: list[dict] = field(default_factory=list)


def train(env: Environment, validation: Environment | None = None, settings: Settings | None = None) -> Learned:
    """Q-learning: epsilon-greedy choice, Huber loss, Adam, a target network that follows softly.  Keeps the weights of the
    best validation epoch where there is a validation set."""
    s = settings or Settings()
    inputs, actions = env.features.shape[1], env.rewards.shape[1]
    net, target = Net(inputs, actions, s.hidden, s.seed), Net(inputs, actions, s.hidden, s.seed)
    replay, rng = Replay(s.capacity, inputs, s.seed), np.random.default_rng(s.seed + 1)
    m, v, t = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights], 0
    epsilon, best, kept, history = s.epsilon[0], -np.inf, None, []
    for epoch in range(s.epochs):
        total = 0.0
        for k in range(env.steps):
            state = env.features[k]
            action = int(rng.integers(actions)) if rng.random() < epsilon else int(net(state[None])[0].argmax())
            following, reward, done = env.step(k, action)
            replay.push(state, action, reward, following, done)
            total += reward
            if len(replay) < s.batch:
                continue
            x, a, r, y, d = replay.sample(s.batch)
            wanted = r + s.gamma * (1 - d) * target(y).max(axis=1)
            acts = net.forward(x)
            rows = np.arange(s.batch)
            error = np.zeros_like(acts[-1])
            error[rows, a] = np.clip(acts[-1][rows, a] - wanted, -1, 1) / s.batch
            t += 1
            for i, g in enumerate(net.gradients(acts, error)):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                net.weights[i] = net.weights[i] - s.rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
            target.weights = [s.tau * a + (1 - s.tau) * b for a, b in zip(net.weights, target.weights, strict=True)]
        epsilon = max(s.epsilon[1], epsilon * s.epsilon[2])
        row = {"epoch": epoch, "train_reward": total / max(1, env.steps)}
        if validation is not None:
            row["validation_reward"] = score = evaluate(validation, net)["average_reward"]
            if score > best:
                best, kept = score, [w.copy() for w in net.weights]
        history.append(row)
    if kept is not None:
        net.weights = kept
    return Learned(net, history)


def evaluate(env: Environment, net: Net) -> dict:
    """Greedy choices and what they earn."""
    k = np.arange(env.steps)
    actions = net(env.features[:-1]).argmax(axis=1) if env.steps else np.zeros(0, dtype=int)
    rewards, profits = env.rewards[k + 1, actions], env.profits[k + 1, actions]
    return {"average_reward": float(rewards.mean()) if env.steps else 0.0, "total_profit": float(profits.sum()), "actions": actions, "rewards": rewards, "profits": profits, "win_rate": float((rewards > 0).mean()) if env.steps else 0.0}


def choose(features: DataFrame, net: Net, rules: list[fold.Rules]) -> DataFrame:
    """Greedy rule for the cycle after each cycle: (pair, cycle_id, param), in Arrow batches."""
    import pandas as pd

    weights, labels = net.weights, [r.label for r in rules]

    def run(batches):
        own = Net(len(FEATURES), len(labels))
        own.weights = weights
        for rows in batches:
            q = own(np.nan_to_num(rows[list(FEATURES)].to_numpy(dtype=float)))
            yield pd.DataFrame({"pair": rows["pair"], "cycle_id": rows["cycle_id"] + 1, "param": [labels[i] for i in q.argmax(axis=1)] if len(q) else []})

    return features.mapInPandas(run, "pair string, cycle_id long, param string")


def learn_and_choose(features: DataFrame, rewards: DataFrame, rules: list[fold.Rules], settings: Settings | None = None) -> DataFrame:
    """A learner for each pair, each in its own grouped task; its greedy rule for the cycle after each cycle: (pair, cycle_id, param)."""
    import pandas as pd

    labels, names = [r.label for r in rules], list(FEATURES)
    by_label = F.map_from_entries(F.collect_list(F.struct("param", F.struct("reward", "profit"))))
    table = rewards.groupBy("pair", "cycle_id").agg(by_label.alias("of"))
    got = [F.array(*[F.col("of")[x][c] for x in labels]).alias(c) for c in ("reward", "profit")]
    rows = features.join(table, ["pair", "cycle_id"]).select("pair", "cycle_id", *names, *got)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("cycle_id")
        x = np.nan_to_num(f[names].to_numpy(dtype=float))
        env = Environment(x, np.array(f["reward"].tolist(), dtype=float), np.array(f["profit"].tolist(), dtype=float))
        actions = train(env, settings=settings).net(x).argmax(axis=1)
        return pd.DataFrame({"pair": f["pair"], "cycle_id": f["cycle_id"] + 1, "param": [labels[i] for i in actions]})

    return rows.groupBy("pair").applyInPandas(run, "pair string, cycle_id long, param string")


def tune(env: Environment, validation: Environment, trials: int = 10, epochs: int = 5, seed: int = 0) -> tuple[Settings, list[dict]]:
    """Seeded random search over six settings; the best average validation reward wins."""
    from driftloom.operators.sweeps import random_search

    space = {"rate": (1e-4, 1e-2), "gamma": [0.9, 0.95, 0.99], "batch": [16, 32, 64], "hidden": [32, 64, 128], "tau": (1e-3, 1e-1), "decay": [0.98, 0.99, 0.995]}
    log, best = [], None
    for i, t in enumerate(random_search(space, trials, seed)):
        s = Settings(epochs, int(t["batch"]), float(t["gamma"]), float(t["rate"]), (1.0, 0.01, float(t["decay"])), 1000, int(t["hidden"]), float(t["tau"]), seed + i)
        score = evaluate(validation, train(env, settings=s).net)["average_reward"]
        log.append({**t, "score": score})
        if best is None or score > best[0]:
            best = (score, s)
    return best[1], log


def save(net: Net, spark, path: str) -> None:
    """Weights as Parquet: layer, shape, values."""
    rows = [(i, list(w.shape), [float(x) for x in w.ravel()]) for i, w in enumerate(net.weights)]
    spark.createDataFrame(rows, "layer int, shape array<int>, weights array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> Net:
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r.layer)  # six rows
    net = Net(1, 1)
    net.weights = [np.array(r.weights).reshape(r.shape) for r in rows]
    return net
