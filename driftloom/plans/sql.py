"""The same queries as SQL for another engine: common table expressions by name, put together in order of need."""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "panel": """SELECT CAST(l_shipdate AS TIMESTAMP) AS ts, l_returnflag || l_linestatus AS symbol, round(avg(l_extendedprice), 8) AS price,
        CAST(sum(l_quantity) AS DOUBLE) AS volume FROM lineitem GROUP BY 1, 2""",
    "opanel": "SELECT CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderpriority AS symbol, round(avg(o_totalprice), 8) AS price FROM orders GROUP BY 1, 2",
    "ticks": """SELECT ts, event_type AS symbol, value AS price, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 1.0) AS amount, event_id AS id,
        CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side FROM events""",
    "book": """SELECT ts, event_type AS symbol, event_id AS id, value AS bid, value + (1 + event_id % 5) / 100 AS ask, 1.0::DOUBLE + event_id % 7 AS bid_amount,
        1.0::DOUBLE + event_id % 3 AS ask_amount FROM events""",
    "whole": "SELECT * FROM (SELECT *, count(symbol) OVER (PARTITION BY ts) AS c FROM panel) WHERE c = (SELECT count(DISTINCT symbol) FROM panel)",
    "pairs": "SELECT u.symbol || ' ~ ' || v.symbol AS pair, u.symbol AS sym1, v.symbol AS sym2, u.ts, u.price AS s1, v.price AS s2 FROM panel u JOIN panel v ON u.ts = v.ts AND u.symbol < v.symbol",
    "fits": """SELECT *, CASE WHEN count(*) OVER w = 60 THEN regr_slope(s1, s2) OVER w END AS beta, CASE WHEN count(*) OVER w = 60 THEN regr_intercept(s1, s2) OVER w END AS alpha
        FROM pairs WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""",
    "spreads": "SELECT *, s1 - alpha - beta * s2 AS spread FROM fits",
    "moments": """SELECT *, CASE WHEN count(spread) OVER w = 60 THEN avg(spread) OVER w END AS z_mean, CASE WHEN count(spread) OVER w = 60 THEN stddev_samp(spread) OVER w END AS z_std
        FROM spreads WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""",
    "sig": "SELECT *, (spread - z_mean) / nullif(z_std, 0) AS z FROM moments",
    "grid": "SELECT * FROM (VALUES ('1/0/2', 1.0, 2.0)) g(param, entry, stop)",
    "b": "SELECT g.param, g.entry, g.stop, s.*, row_number() OVER (PARTITION BY g.param, pair ORDER BY ts) AS rn FROM sig s CROSS JOIN grid g",
    "st": """SELECT DISTINCT param, pair, CAST(0 AS BIGINT) AS rn, 0 AS pos, 0 AS lck FROM b UNION ALL
        SELECT param, pair, rn, CASE WHEN z IS NULL THEN pos WHEN pos = 0 THEN CASE WHEN l1 <> 0 OR abs(z) >= stop THEN 0 WHEN z >= entry THEN -1 WHEN z <= -entry THEN 1 ELSE 0 END
          WHEN -pos * z <= 0 OR -pos * z >= stop THEN 0 ELSE pos END,
        CASE WHEN z IS NULL THEN lck WHEN pos = 0 THEN CASE WHEN l1 <> 0 THEN l1 WHEN abs(z) >= stop THEN CASE WHEN z > 0 THEN -1 ELSE 1 END ELSE 0 END
          WHEN -pos * z <= 0 THEN 0 WHEN -pos * z >= stop THEN pos ELSE 0 END
        FROM (SELECT b.*, st.pos, st.lck, CASE WHEN st.lck <> 0 AND b.z IS NOT NULL AND st.lck * b.z >= 0 THEN 0 ELSE st.lck END AS l1
          FROM st JOIN b ON b.param = st.param AND b.pair = st.pair AND b.rn = st.rn + 1)""",
    "held": """SELECT b.*, st.pos, lag(st.pos, 1, 0) OVER (PARTITION BY b.param, b.pair ORDER BY b.rn) AS prev, max(b.rn) OVER (PARTITION BY b.param, b.pair) AS last_rn
        FROM b JOIN st ON b.param = st.param AND b.pair = st.pair AND b.rn = st.rn""",
    "numbered": "SELECT *, CAST(sum(CASE WHEN prev = 0 AND pos <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY param, pair ORDER BY rn) AS BIGINT) AS tno FROM held",
    "closed": "SELECT param, pair, tno, min(rn) AS rn1 FROM numbered WHERE pos = 0 AND prev <> 0 GROUP BY 1, 2, 3",
    "opened": """SELECT n.param, n.pair, n.tno AS trade_no, n.pos AS position, n.rn AS rn0, coalesce(c.rn1, n.last_rn) AS rn1, c.rn1 IS NULL AS forced, n.ts AS entry_ts, n.s1 AS entry_s1, n.s2 AS entry_s2,
        n.z AS entry_z, n.beta AS entry_beta, n.z_std AS entry_std FROM numbered n LEFT JOIN closed c ON c.param = n.param AND c.pair = n.pair AND c.tno = n.tno WHERE n.prev = 0 AND n.pos <> 0""",
    "trades": """SELECT o.*, x.ts AS exit_ts, x.s1 AS exit_s1, x.s2 AS exit_s2, x.z AS exit_z, x.beta AS exit_beta,
        CASE WHEN forced THEN 'forced_exit' WHEN -o.position * x.z <= 0 THEN 'win' ELSE 'loss' END AS exit_type FROM opened o JOIN b x ON x.param = o.param AND x.pair = o.pair AND x.rn = o.rn1""",
    "drifts": """SELECT t.param, t.pair, t.trade_no, avg(abs((t.entry_beta - y.beta) / nullif(t.entry_beta, 0))) * 100 AS drift
        FROM trades t JOIN b y ON y.param = t.param AND y.pair = t.pair AND y.rn > t.rn0 AND y.rn <= t.rn1 GROUP BY 1, 2, 3""",
    "sized": "SELECT t.*, d.drift, 10000.0 / (1 + abs(entry_beta)) AS n1, abs(entry_beta) * 10000.0 / (1 + abs(entry_beta)) AS n2 FROM trades t LEFT JOIN drifts d USING (param, pair, trade_no)",
    "legs": """SELECT *, position * n1 / entry_s1 * (exit_s1 - entry_s1) AS pnl1, CASE WHEN entry_beta > 0 THEN -position ELSE position END * n2 / entry_s2 * (exit_s2 - entry_s2) AS pnl2,
        0.001 * (n1 / entry_s1 * (entry_s1 + exit_s1) + n2 / entry_s2 * (entry_s2 + exit_s2)) AS fees FROM sized""",
    "ledger": "SELECT *, pnl1 + pnl2 - fees AS pnl FROM legs",
    "curve": "SELECT *, 10000 + sum(pnl) OVER (PARTITION BY param, pair ORDER BY trade_no) AS val FROM ledger",
    "peaks": "SELECT *, max(val) OVER (PARTITION BY param, pair ORDER BY trade_no) AS peak FROM curve",
    "downs": "SELECT param, pair, abs(min((val - peak) / peak)) * 100 AS max_drawdown, max(peak - val) AS max_drawdown_money, min((val - peak) / nullif(peak - 10000, 0)) * 100 AS profit_drawdown FROM peaks GROUP BY 1, 2",
    "moves": "SELECT * FROM (SELECT pair, ts, beta / nullif(lag(beta) OVER (PARTITION BY pair ORDER BY ts), 0) - 1 AS r FROM sig WHERE beta IS NOT NULL) WHERE r IS NOT NULL",
    "brets": "SELECT pair, stddev_samp(r) * 100 AS beta_returns_std, mad(r) * 100 AS beta_returns_mad FROM moves GROUP BY 1",
    "rets": "SELECT * FROM (SELECT ts, symbol, price, ln(price / nullif(lag(price) OVER (PARTITION BY symbol ORDER BY ts), 0)) AS ret FROM panel) WHERE ret IS NOT NULL",
    "corrs": "SELECT u.symbol AS sym1, v.symbol AS sym2, corr(u.ret, v.ret) AS corr FROM rets u JOIN rets v ON u.ts = v.ts GROUP BY 1, 2",
    "windowed": """SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY pair ORDER BY ts) - 1) // 100 AS window_id, count(*) OVER (PARTITION BY pair) AS n FROM pairs) WHERE window_id < n // 100""",
    "zrows": "SELECT pair, ts, z, s1, s2, beta, row_number() OVER (PARTITION BY pair ORDER BY ts) AS rn FROM sig WHERE z IS NOT NULL",
    "zfirst": "SELECT pair, coalesce(min(CASE WHEN abs(z) <= 0.1 THEN rn END), 1) AS rn0 FROM zrows GROUP BY 1",
    "zb": "SELECT z.pair, z.ts, z.z, z.rn - f.rn0 + 1 AS rn FROM zrows z JOIN zfirst f ON f.pair = z.pair WHERE z.rn >= f.rn0",
    "cst": """SELECT DISTINCT pair, CAST(0 AS BIGINT) AS rn, 0 AS sgn, 0 AS started, 0 AS ended FROM zb UNION ALL
        SELECT y.pair, y.rn, CASE WHEN c.sgn = 0 THEN CASE WHEN z >= 1 THEN 1 WHEN z <= -1 THEN -1 ELSE 0 END WHEN c.sgn * z <= 0 THEN 0 ELSE c.sgn END,
        CASE WHEN c.sgn = 0 AND abs(z) >= 1 THEN 1 ELSE 0 END, CASE WHEN c.sgn <> 0 AND c.sgn * z <= 0 THEN 1 ELSE 0 END FROM cst c JOIN zb y ON y.pair = c.pair AND y.rn = c.rn + 1""",
    "cends": "SELECT pair, rn AS rn1, row_number() OVER (PARTITION BY pair ORDER BY rn) AS cycle_id FROM cst WHERE ended = 1",
    "cstarts": "SELECT pair, rn AS rn0, row_number() OVER (PARTITION BY pair ORDER BY rn) AS cycle_id FROM cst WHERE started = 1",
    "cbars": "SELECT s.pair, s.cycle_id, z.ts, z.z, z.rn FROM cstarts s JOIN cends e USING (pair, cycle_id) JOIN zb z ON z.pair = s.pair AND z.rn BETWEEN s.rn0 AND e.rn1",
}
RECURSIVE = ("st", "cst")


def needs(text: str) -> list[str]:
    found = set(re.findall(r"\b[a-z_0-9]+\b", text))
    return [n for n in CTES if n in found]


def query(select: str, **replaced: str) -> str:
    """``select`` with the expressions that it needs before it; ``replaced`` gives some of them another text."""
    ctes, order = CTES | replaced, []

    def visit(text: str) -> None:
        for n in needs(re.sub(r"'[^']*'", "", text)):
            if n not in order and n not in open_:
                open_.append(n)
                visit(ctes[n])
                order.append(n)

    open_: list[str] = []
    visit(select)
    head = "WITH RECURSIVE " if set(order) & set(RECURSIVE) else "WITH "
    return head + ", ".join(f"{n} AS ({ctes[n]})" for n in order) + " " + select if order else select
