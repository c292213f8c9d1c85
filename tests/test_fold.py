"""Hand-built cases, and the fold against a literal reading of the rules."""

import math
import random

import numpy as np
import pytest

from driftloom.operators.fold import Rules, crossings, cycle_ids, run_rules
from driftloom.streaming.live import continued

N = math.nan
CASES = [
    ("long win", [0, -1.2, -0.5, 0.1], [0, 1, 1, 0], ["win"]),
    ("short win at equality", [0, 1, 0], [0, -1, 0], ["win"]),
    ("stop then locked", [0, 1.2, 2.5, 1.2, 0.5, 0, 1.2], [0, -1, 0, 0, 0, 0, -1], ["loss", "forced_exit"]),
    ("same-bar unlock and re-entry", [1.2, 2.5, -1.1], [-1, 0, 1], ["loss", "forced_exit"]),
    ("flat beyond stop locks", [2.4, 1.5, -0.2, 1.1], [0, 0, 0, -1], ["forced_exit"]),
    ("unlock and re-lock on one bar", [2.4, -2.1, -1.5, 0], [0, 0, 0, 0], []),
    ("null holds", [-1.2, N, -0.8, 0], [1, 1, 1, 0], ["win"]),
    ("leading nulls", [N, N, 1.3], [0, 0, -1], ["forced_exit"]),
    ("no re-entry on exit bar", [1.2, -1.5, -1.5], [-1, 0, 1], ["win", "forced_exit"]),
    ("equal to stop while flat", [2.0, 1.0, -1.0], [0, 0, 1], ["forced_exit"]),
    ("win before stop", [-1.0, 3.0], [1, 0], ["win"]),
    ("empty", [], [], []),
]


@pytest.mark.parametrize("name,z,held,exits", CASES, ids=[c[0] for c in CASES])
def test_cases(name, z, held, exits):
    got, deals = run_rules(np.array(z, dtype=float), Rules())
    assert got.tolist() == held and [d.outcome for d in deals] == exits


def literal(z, entry, leave, stop):
    """The rules in the order in which they are stated, with no shared algebra."""
    pos, lock, side, out = 0, False, 0, []
    for v in z:
        if math.isnan(v):
            out.append(pos)
            continue
        if lock and ((side == 1 and v >= 0) or (side == -1 and v <= 0)):
            lock, side = False, 0
        if pos == 0:
            if lock:
                pass
            elif v >= stop:
                lock, side = True, -1
            elif v <= -stop:
                lock, side = True, 1
            elif v >= entry:
                pos = -1
            elif v <= -entry:
                pos = 1
        elif pos == 1:
            if v >= -leave:
                pos = 0
            elif v <= -stop:
                pos, lock, side = 0, True, 1
        elif v <= leave:
            pos = 0
        elif v >= stop:
            pos, lock, side = 0, True, -1
        out.append(pos)
    return out


def walk(seed, n=400):
    rng = random.Random(seed)
    z, out = 0.0, []
    for _ in range(n):
        z = 0.9 * z + rng.gauss(0, 0.7)
        out.append(N if rng.random() < 0.05 else round(z, 1))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_against_literal(seed):
    z = walk(seed)
    for rules in (Rules(), Rules(1, 0.5, 3), Rules(2, 0, math.inf), Rules(1.5, 0.2, 1.5)):
        held, deals = run_rules(np.array(z), rules)
        assert held.tolist() == literal(z, rules.entry, rules.exit, rules.stop)
        spans = [(d.opened, d.closed) for d in deals]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)) and all(a <= b for a, b in spans)


@pytest.mark.parametrize("seed", range(10))
def test_state_carries_over_batches(seed):
    z, rng = walk(seed), random.Random(seed)
    whole = run_rules(np.array(z), Rules())[0].tolist()
    side = lock = 0
    out, at = [], 0
    while at < len(z):
        n = rng.randint(1, 15)
        held, side, lock = continued(np.array(z[at : at + n]), Rules(), side, lock)
        out += held.tolist()
        at += n
    assert out == whole


def test_book_variant():
    held, _ = run_rules(np.array([-1.5, -1.5, -2.5, -1.2, 0.1, -1.2]), Rules(1, 0, 2, book=True))
    assert held.tolist() == [0, 1, 0, 0, 0, 1]  # the lock's last bar stays flat


def test_cycles():
    z = np.array([0, 1.2, 0.4, -1.3, -1.4, -0.2, 0])
    assert cycle_ids(z).tolist() == [0, 1, 1, 1, 2, 2, 2]
    assert cycle_ids(np.array([1.5, -0.5, 1.2])).tolist() == [1, 1, 0]  # nothing is near zero; the tail is dropped
    assert cycle_ids(np.array([1.5, 0.05, 1.2, 0.5])).tolist() == [0, 0, 0, 0]
    for seed in range(20):
        z = np.nan_to_num(np.array(walk(seed)))
        ids = cycle_ids(z)
        for k in range(1, ids.max() + 1):
            own = z[ids == k]
            assert abs(own[0]) >= 1 and own[0] * own[-1] <= 0 and (own[:-1] * own[0] > 0).all()


def test_crossings():
    (trade,) = crossings(np.array([0.5, 1.5, 0.5, -0.5]), 1.0, 2.0)
    assert trade[:4] == (-1, 1, 0.5, 3) and trade[4] == 0.5 and trade[5] == "win"
    loss = crossings(np.array([0.0, 3.0, 1.5, 1.5]), 1.0, 2.0)
    assert loss == [(-1, 1, 1 / 3, 1, 2 / 3, "loss")]
