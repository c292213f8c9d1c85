"""Operators that no query shows, and properties."""

import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import agent, discovery, fold, graph, series, spread, sweeps
from driftloom.operators import panel as P
from driftloom.operators import trades as M
from driftloom.sources import market

TRADE = "pair string, param string, trade_no long, position int, entry_beta double, entry_s1 double, entry_s2 double, exit_s1 double, exit_s2 double"


def test_ledger(spark):
    rows = spark.createDataFrame([("p", "x", 1, 1, 0.5, 100.0, 50.0, 110.0, 55.0), ("p", "x", 2, 1, -0.5, 100.0, 50.0, 110.0, 55.0)], TRADE)
    first, second = M.with_pnl(rows, 10_000, 0.001).orderBy("trade_no").collect()
    assert first.pnl == pytest.approx(312.3333333) and first.fees == pytest.approx(21) and second.pnl == pytest.approx(979)


@pytest.fixture(scope="module")
def signals(spark):
    rng = np.random.default_rng(1)
    rows = []
    for p in ("a ~ b", "c ~ d"):
        s2 = 100 + rng.normal(size=500).cumsum()
        s1 = 20 + 1.2 * s2 + np.convolve(rng.normal(size=500), 0.8 ** np.arange(20))[:500]
        rows += [(p, i, float(a), float(b)) for i, (a, b) in enumerate(zip(s1, s2, strict=True))]
    frame = spark.createDataFrame(rows, "pair string, i int, s1 double, s2 double")
    frame = frame.withColumn("ts", F.timestamp_seconds(F.col("i") * 300).cast("timestamp_ntz")).drop("i")
    return spread.signals(frame, 30).cache()


def test_warm_up(signals):
    first = signals.where("z is not null").groupBy("pair").agg(F.min("ts").alias("t")).collect()
    assert all(r.t.hour * 60 + r.t.minute == 60 * 5 for r in first)  # twice the window


def test_ledger_properties(signals):
    deals = fold.strategy_trades(signals, [fold.Rules()])
    cheap, dear = (M.cumulative_pnl(M.with_pnl(deals, 10_000, c)).orderBy("pair", "trade_no").toPandas() for c in (0.0, 0.01))
    assert (cheap["pnl"] >= dear["pnl"]).all()
    for _, g in cheap.groupby("pair"):
        assert g["cum_pnl"].iloc[-1] == pytest.approx(g["pnl"].sum()) and (g["entry_ts"].to_numpy()[1:] > g["exit_ts"].to_numpy()[:-1]).all()


def test_zero_length_drift_is_null(spark):
    rows = spark.createDataFrame([("p", 0, 1.3, 10.0, 10.0, 1.0, 1.0)], "pair string, i int, z double, s1 double, s2 double, beta double, z_std double")
    (deal,) = fold.strategy_trades(rows.withColumn("ts", F.timestamp_seconds("i").cast("timestamp_ntz")), [fold.Rules()]).collect()
    assert deal.exit_type == "forced_exit" and deal.drift is None and deal.bars == 0


def test_sweep_equals_single_runs(signals):
    rules = [fold.Rules(1, 0, 2), fold.Rules(2, 0, 3)]
    both = {(r.param, r.pair): r.total_return for r in sweeps.threshold_sweep(signals, rules, 1e4).collect()}
    for r in rules:
        for row in sweeps.threshold_sweep(signals, [r], 1e4).collect():
            assert both[row.param, row.pair] == pytest.approx(row.total_return)


def test_book_fills_cross_the_spread(signals):
    book = signals.withColumns({"s1_ask": F.col("s1") + 1, "s1_bid": F.col("s1") - 1, "s2_ask": F.col("s2") + 1, "s2_bid": F.col("s2") - 1})
    plain = M.with_pnl(fold.strategy_trades(signals, [fold.Rules(book=True)]), 1e4, 0).agg(F.sum("pnl")).first()[0]
    assert M.with_pnl(fold.strategy_trades(book, [fold.Rules(book=True)]), 1e4, 0).agg(F.sum("pnl")).first()[0] < plain
    assert fold.crossing_trades(signals, 1.0, 3.0).count() > 0


def test_episodes(signals):
    rows = fold.episodes(signals.select("pair", "ts"), 100, 50).groupBy("pair", "episode", "phase").count().collect()
    assert {r["episode"] for r in rows} == set(range(8)) and all(r["count"] == (100 if r["phase"] == "formation" else 50) for r in rows)


def test_backtest_report_and_comparison(signals):
    m = sweeps.backtest(signals.select("pair", "ts", "s1", "s2"), window=30, entry=1.0, stop=2.0)
    assert m.count() == 2
    ledger = M.with_pnl(fold.strategy_trades(signals, [fold.Rules()]), 1e4, 0)
    assert all(t.count() > 0 for t in sweeps.report_tables(signals, ledger, 1e4).values())
    assert sweeps.strategy_comparison(ledger, signals, fold.with_cycles(signals), 1e4).count() == 2


def test_agent(spark, signals, tmp_path):
    rules = [fold.Rules(float(a), 0.0, float(a + 1)) for a in range(1, 4)]
    cycles = fold.with_cycles(signals)
    features, rewards = agent.cycle_features(cycles).cache(), agent.reward_table(cycles, rewards_rules := rules).cache()
    one = {(r.cycle_id, r.param): r.reward for r in rewards.where("pair = 'a ~ b'").collect()}
    bars = cycles.where("pair = 'a ~ b' and cycle_id is not null").orderBy("ts").toPandas()
    for k, part in bars.groupby("cycle_id"):
        for r in rewards_rules:
            deals = fold.run_rules(part["z"].to_numpy(), r)[1]
            expected = -1.0 if not deals else {"win": 1.0, "loss": -1.0, "forced_exit": 0.0}[deals[0].outcome]
            assert one[k, r.label] == expected
    env = agent.Environment.of(features, rewards, rules, "a ~ b")
    learned = agent.train(env, env, agent.Settings(epochs=4, batch=8, seed=3))
    again = agent.train(env, env, agent.Settings(epochs=4, batch=8, seed=3))
    assert all(np.array_equal(a, b) for a, b in zip(learned.net.weights, again.net.weights, strict=True)) and len(learned.history) == 4
    agent.save(learned.net, spark, f"{tmp_path}/net")
    x = env.features[:3]
    assert np.allclose(agent.load(spark, f"{tmp_path}/net")(x), learned.net(x))
    chosen = agent.choose(features, learned.net, rules)
    assert chosen.count() == features.count()
    best = agent.best_rules(rewards, rules)
    assert agent.confusion(chosen.join(rewards, ["pair", "cycle_id", "param"]), best).count() >= 0
    assert agent.oracle_curve(rewards, best).count() > 0
    assert agent.tune(env, env, trials=2, epochs=1)[0].batch in (16, 32, 64)
    assert {r.reward for r in agent.legacy_reward(rewards).select("reward").distinct().collect()} <= {1000, -500, 0}


def test_agent_choices_cover_all_pairs_and_rules(spark, signals, monkeypatch):
    """The query gives each pair the choices of its own learner, with all rules and the default settings."""
    from driftloom.plans import queries

    cycles = fold.with_cycles(signals)
    monkeypatch.setattr(queries, "cycle_bars", lambda spark, d: cycles)
    got = {(r.pair, r.cycle_id): r.param for r in queries.agent_choices(spark, "").collect()}
    features, rewards = agent.cycle_features(cycles).cache(), agent.reward_table(cycles, queries.THRESHOLDS).cache()
    expected = {}
    for pair in ("a ~ b", "c ~ d"):
        learned = agent.train(agent.Environment.of(features, rewards, queries.THRESHOLDS, pair))
        expected |= {(r.pair, r.cycle_id): r.param for r in agent.choose(features.where(F.col("pair") == pair), learned.net, queries.THRESHOLDS).collect()}
    assert len(queries.THRESHOLDS) == 9 and {p for p, _ in got} == {"a ~ b", "c ~ d"} and got == expected


def test_q_network_gradient():
    net, x = agent.Net(3, 2, 5, seed=1), np.random.default_rng(0).normal(size=(4, 3))
    error = np.ones((4, 2))
    grads = net.gradients(net.forward(x), error)
    for i, w in enumerate(net.weights):
        at = tuple(0 for _ in w.shape)
        w[at] += 1e-6
        up = net(x).sum()
        w[at] -= 2e-6
        down = net(x).sum()
        w[at] += 1e-6
        assert grads[i][at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_replay():
    r = agent.Replay(3, 1)
    for i in range(5):
        r.push([i], i, i, [i + 1], False)
    assert len(r) == 3 and set(r.sample(3)[0].ravel()) == {2, 3, 4}


def planted(seed=0, groups=3, size=5, times=800):
    rng = np.random.default_rng(seed)
    market_, common = rng.normal(size=(times, 1)), rng.normal(size=(times, groups))
    return np.concatenate([0.6 * market_ + common[:, [g]] + 0.7 * rng.normal(size=(times, size)) for g in range(groups)], axis=1)


def test_communities_of_a_planted_partition():
    x = planted()
    corr = np.corrcoef(x, rowvar=False)
    m = graph.denoised(corr, len(x))
    truth = np.repeat(np.arange(3), 5)
    for labels in (graph.louvain(m, corr, 3), graph.recursive_bisection(m, corr)):
        assert len(labels) == 15 and graph.modularity(m, labels, corr) >= graph.modularity(m, np.arange(15), corr)
    labels = graph.louvain(m, corr, 3)
    assert all(len(set(labels[truth == g])) == 1 for g in range(3)) and labels.max() == 2
    assert graph.canonical(labels, [f"s{i:02}" for i in range(15)])[0] == ("Community 1", "s00")
    assert 0 < graph.top_share(corr) < 100 and np.allclose(np.diag(graph.without_market(corr)), 1)
    total = graph.norm(corr)
    before = graph.modularity(m, truth, corr)
    moved = truth.copy()
    moved[0] = 1
    assert graph.move_gain(truth, 0, 1, m, total) == pytest.approx(graph.modularity(m, moved, corr) - before)


def test_shuffled_edges(spark):
    x = planted(times=120, groups=1)
    rows = [(i, f"s{j}", float(x[i, j])) for i in range(120) for j in range(5)]
    panel = spark.createDataFrame(rows, "i int, symbol string, std_ret double").withColumn("ts", F.timestamp_seconds("i").cast("timestamp_ntz"))
    found = graph.shuffled_edges(panel, [f"s{j}" for j in range(5)], 8).toPandas()
    assert len(found) == 8 and (found["low"] > 0).all() and (found["high"] < 2.2).all()
    assert graph.correlation_matrix(panel).values.shape == (5, 5)


def test_discovery(spark, signals):
    tests = {r.pair: r for r in discovery.cointegration(signals, ["pair"]).collect()}
    assert all(0 <= r.pvalue <= 1 for r in tests.values()) and tests["a ~ b"].pvalue < 0.05
    assert {r.white for r in discovery.white_noise(signals.select("pair", "ts", F.col("s1").alias("residual"))).collect()} == {False}
    panel = signals.where("pair = 'a ~ b'").select("ts", F.lit("x").alias("symbol"), F.col("s1").alias("price")).unionByName(signals.where("pair = 'a ~ b'").select("ts", F.lit("y").alias("symbol"), F.col("s2").alias("price")))
    groups = spark.createDataFrame([("x", "1"), ("y", "1")], "symbol string, community string")
    assert discovery.community_scan(panel, groups).count() == 1
    apart = spark.createDataFrame([("x", "1"), ("y", "2")], "symbol string, community string")
    assert discovery.cross_scan(panel, apart, "1", "2").count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "BTCUSDT-2024-01-01.csv").write_text("\n".join(f"{1704067200000 + 60000 * i},1,2,0.5,1.5,10,{1704067259999 + 60000 * i},5,3,1,1,0" for i in range(3)))
    (tmp_path / "ETHUSDT-2024-01-01.csv").write_text("\n".join(f"{(1704067200000 + 60000 * i) * 1000},1,2,0.5,1.5,10,{(1704067259999 + 60000 * i) * 1000},5,3,1,1,0" for i in range(3)))
    rows = market.klines(spark, f"{tmp_path}/*.csv").orderBy("symbol", "ts").collect()
    assert [r.symbol for r in rows] == ["BTCUSDT"] * 3 + ["ETHUSDT"] * 3 and len({r.ts for r in rows}) == 3 and rows[0].ts.year == 2024
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write("exchange,symbol,timestamp,local_timestamp,id,side,price,amount\nx,BTC,1704067200000000,1,7,buy,10.5,2\n")
    (tick,) = market.trades_csv(spark, f"{tmp_path}/*.csv.gz").collect()
    assert tick.price == 10.5 and tick.file.endswith("t.csv.gz")
    (tmp_path / "wide.csv").write_text("ts,A,B\n2024-01-01 00:00:00,1,2\n2024-01-01 00:05:00,3,\n")
    assert market.price_csv(spark, f"{tmp_path}/wide.csv", ["A", "B"]).count() == 3
    folder = tmp_path / "folder"
    folder.mkdir()
    (folder / "BTCUSDT_2024_1m.csv").write_text("Open Time,Close\n2024-01-01 00:00:00,5\nbad,6\n")
    (folder / "ETHUSDT_2024_1m.csv").write_text("Open Time,Open\n2024-01-01 00:00:00,5\n")
    (folder / "XRPUSDT_2024_1m.csv").write_text("Close,Open Time\n7,2024-01-01 00:00:00\n")
    (folder / "empty.csv").write_text("")
    rows = market.closing_prices(spark, str(folder)).collect()  # each file by its own header
    assert sorted((r.symbol, r.price) for r in rows) == [("BTC/USDT_2024_1m", 5.0), ("XRP/USDT_2024_1m", 7.0)]
    (tmp_path / "book.csv").write_text("local_timestamp,asks[0].price,asks[0].amount,bids[0].price,bids[0].amount\n2024-01-01 00:00:00,2,1,1,3\n")
    assert M.mid_and_spread(market.book_csv(spark, f"{tmp_path}/book.csv")).first().mid == 1.5
    with pytest.raises(ValueError):
        market.frame_of(spark, 3)


def test_listing_and_calendar(spark):
    info = json.dumps({"symbols": [{"symbol": "BTCUSDT", "status": "TRADING"}]})
    sectors = spark.createDataFrame([("a", "BTC"), ("b", "XYZ")], "sector string, coin string")
    assert [r.sector for r in market.listed_by_sector(spark, info, sectors).collect()] == ["a"]
    assert market.file_names(spark, "BTCUSDT", "1m", "2024-02-27", "2024-03-01").count() == 4
    assert market.synthetic_pair(spark, 50).count() == 50


def test_rest_source(spark):
    """Pages follow one another; a request that fails once is repeated, one that always fails is an error."""
    failed = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            query = dict(x.split("=") for x in self.path.partition("?")[2].split("&"))
            first = not failed and failed.append(1) is None
            good = query["symbol"] == "BTC" and not first
            self.send_response(200 if good else 500)
            self.end_headers()
            if good:
                start = int(query.get("startTime", 0))
                times = [t for t in range(1704067200000, 1704067200000 + 5 * 60000, 60000) if t >= start][: int(query["limit"])]
                self.wfile.write(json.dumps([[t, "1", "2", "0.5", "1.5", "10", 0] for t in times]).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(market.KlineSource)
    reader = spark.read.format("klines_rest").option("url", f"http://127.0.0.1:{server.server_port}/").option("limit", "2")
    rows = reader.option("symbols", "BTC").option("start", "1704067200000").load().collect()
    assert len({r.ts for r in rows}) == len(rows) == 5 and {r.close for r in rows} == {1.5}
    with pytest.raises(Exception, match="500"):
        reader.option("symbols", "BTC,BAD").option("retries", "1").load().collect()
    server.shutdown()


def test_mismatch_of_missing_values(spark):
    a = spark.createDataFrame([(1, None), (2, 1.0), (3, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, None), (2, 1.0), (3, 3.0)], "k int, v double")
    assert {r.k for r in P.mismatches(a, b, ["k"], ["v"]).collect()} == {1, 3}


def test_zero_division_is_null(spark):
    rows = spark.createDataFrame([("a", i, 5.0, 3.0) for i in range(5)], "pair string, i int, s1 double, s2 double").withColumn("ts", F.timestamp_seconds("i").cast("timestamp_ntz"))
    assert spread.signals(rows, 2).where("beta is not null or z is not null").count() == 0
    assert series.pct_change(rows.withColumn("s1", F.lit(0.0)), "s1", ["pair"], "r").where("r is not null").count() == 0


def test_mann_whitney(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 20, 40), rng.integers(3, 25, 30)
    rows = [("x", float(v)) for v in x] + [("y", float(v)) for v in y]
    got = M.mann_whitney(spark.createDataFrame(rows, "g string, v double"), "v", "g", "x").first()
    assert got.u == sum((a > b) + 0.5 * (a == b) for a in x for b in y) and (got.n1, got.n2) == (40, 30)


def test_sums_below_in_pieces(spark):
    rows = [(float(v), 1 + v % 3) for v in range(500)]
    got = {r.v: r.below for r in M.sums_below(spark.createDataFrame(rows, "v double, c long"), "v", "c", "below", pieces=7).collect()}
    assert all(got[v] == sum(c for x, c in rows if x < v) for v, _ in rows)


def test_risk_sized(spark):
    spreads = [0.0, 1.0, -1.0, 0.5, -0.5, 3.0, 4.0, 2.0, 30.0, 0.0]
    rows = [("p", i, s, -1 if 5 <= i < 9 else 0, 1 if 5 <= i <= 9 else None) for i, s in enumerate(spreads)]
    bars = spark.createDataFrame(rows, "pair string, i int, spread double, position int, trade_no long").withColumn("ts", F.timestamp_seconds("i").cast("timestamp_ntz"))
    (r,) = M.risk_sized(bars, 100.0, window=6).collect()
    assert r.size == pytest.approx(100 / np.std(spreads[:6], ddof=1)) and r.stopped and r.pnl == -100
    (r,) = M.risk_sized(bars.where("i < 8 and i <> 6"), 100.0, window=6).collect()
    assert not r.stopped and r.pnl == pytest.approx(r.size * (3.0 - 2.0))


def test_sinks(spark, tmp_path):
    from driftloom.sources.sinks import write_csv, write_panel

    df = spark.createDataFrame([("p", 1.0)], "pair string, sharpe double")
    write_csv(df, f"{tmp_path}/out", compression="gzip", display=True)
    write_csv(df, f"{tmp_path}/out", compression="gzip", display=True, mode="append")
    assert spark.read.csv(f"{tmp_path}/out", header=True).columns == ["Pair", "Sharpe ratio"] and spark.read.csv(f"{tmp_path}/out", header=True).count() == 2
    write_panel(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "symbol string, price double"), f"{tmp_path}/panel")
    assert spark.read.parquet(f"{tmp_path}/panel").where("symbol = 'a'").count() == 1


def test_live_bars(spark, tmp_path):
    from driftloom.operators.resample import ohlcv
    from driftloom.streaming.live import live_bars, live_positions

    rows = spark.createDataFrame([(i, "s", float(i % 7), 1.0, i) for i in range(200)], "t int, symbol string, price double, amount double, id int")
    rows = rows.withColumn("ts", F.timestamp_seconds(F.col("t") * 20)).drop("t")
    rows.write.parquet(f"{tmp_path}/ticks")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/ticks").schema).parquet(f"{tmp_path}/ticks")
    q = live_bars(stream, "5 minutes").writeStream.format("memory").queryName("bars").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.bar, r.open, r.high, r.low, r.close, r.volume)
    assert sorted(map(key, spark.table("bars").collect())) == sorted(map(key, ohlcv(rows, "5 minutes").collect()))
    z = [0, 1.2, 2.5, 1.2, 0.5, 0, 1.2]
    spark.createDataFrame([("p", i, float(v)) for i, v in enumerate(z)], "pair string, t int, z double").select("pair", F.timestamp_seconds("t").alias("ts"), "z").coalesce(1).write.parquet(f"{tmp_path}/z")
    stream = spark.readStream.schema("pair string, ts timestamp, z double").parquet(f"{tmp_path}/z")
    q = live_positions(stream, fold.Rules()).writeStream.format("memory").queryName("positions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.position for r in spark.table("positions").orderBy("ts").collect()] == [0, -1, 0, 0, 0, 0, -1]
