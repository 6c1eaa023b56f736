"""Checked and revised decisions, week after week in plain Python; the losing-streak rule."""

import datetime as dt
import random

import pytest

from weekloom.config import BacktestConfig
from weekloom.operators import portfolio
from weekloom.plans import backtest, decisions

MONDAY = dt.date(2024, 1, 1)
NAMES = ["a", "b", "c", "d", "e"]
BETA = {"a": "very_high", "b": "low", "c": "very_high", "d": "very_high", "e": "medium"}
CLUSTER = {"a": "k", "b": "k", "c": "m", "d": "unknown", "e": "unknown"}


def tables(spark, seed, weeks=18):
    rng = random.Random(seed)
    prices, decided = [], []
    level = dict.fromkeys(NAMES, 100.0)
    for k in range(weeks):
        ws = MONDAY + dt.timedelta(weeks=k)
        for n in NAMES:
            level[n] *= 1 + rng.choice([-0.06, -0.03, 0.02, 0.04]) + rng.random() / 100
            prices.append((n, n, ws + dt.timedelta(days=2), level[n]))
        if rng.random() < 0.85:
            for n in rng.sample(NAMES, rng.randint(0, 5)):
                decided.append((ws, n, rng.choice(["buy", "buy", "buy", "hold", "sell"]), rng.choice([0.0, 0.1, 0.2, 0.3, 0.45])))
    p = spark.createDataFrame(prices, "industry string, code string, d date, close double")
    d = spark.createDataFrame(decided, "ws date, industry string, action string, weight double")
    t = spark.createDataFrame([("L", n, n, BETA[n], CLUSTER[n]) for n in NAMES], "large_cat string, small_cat string, index_name string, beta string, correlation_cluster string")
    return p, d, t, prices, decided


def violations(rows, held, pnl):
    """{rule: subjects} of one week's decisions."""
    out: dict = {}
    buys = [(n, w) for n, a, w in rows if a == "buy"]
    if heavy := [n for n, w in buys if w > 0.3]:
        out["max_weight"] = heavy
    if sum(w for _, w in buys) > 1:
        out["max_total"] = sum(w for _, w in buys)
    if pnl < 0 and (new := [n for n, w in buys if w != 0 and BETA[n] == "very_high" and n not in held]):
        out["beta"] = new
    groups: dict = {}
    for n, w in buys:
        if w >= 0.15:
            groups.setdefault(CLUSTER[n], []).append(n)
    if twins := {c for c, m in groups.items() if c != "unknown" and len(m) > 1}:
        out["mirror"] = twins
    return out


def revised(rows, bad):
    out = []
    top = {c: min(((-w, n) for n, a, w in rows if a == "buy" and w >= 0.15 and CLUSTER[n] == c))[1] for c in bad.get("mirror", ())}
    for n, a, w in rows:
        if "max_weight" in bad:
            w = min(w, 0.3) if a == "buy" else w
        elif "max_total" in bad:
            w = w * 0.99 / bad["max_total"] if a == "buy" else w
        elif "mirror" in bad:
            w = 0.1 if a == "buy" and w >= 0.15 and CLUSTER[n] in top and top[CLUSTER[n]] != n else w
        elif a == "buy" and n in bad["beta"]:
            a, w = "hold", 0.0
        out.append((n, a, w))
    return out


def slow_walk(prices, decided):
    weeks = sorted({d - dt.timedelta(days=d.weekday()) for _, _, d, _ in prices})
    close = {(n, d - dt.timedelta(days=d.weekday())): c for n, _, d, c in prices}
    held, pnl, log, accepted = {}, 0.0, {}, {}
    for k, ws in enumerate(weeks):
        r = sum(w * (close[n, ws] / close[n, weeks[k - 1]] - 1) for n, w in held.items()) if k else 0.0
        rows = [(n, a, w) for s, n, a, w in decided if s == ws]
        if rows:
            for attempt in (1, 2, 3):
                bad = violations(rows, held, pnl)
                if not bad or attempt == 3:
                    break
                rows = revised(rows, bad)
            log[ws] = attempt, bool(bad)
            accepted[ws] = sorted(rows)
            total = max(1.0, sum(w for _, a, w in rows if a in ("buy", "hold") and w > 0))
            held = {n: w / total for n, a, w in rows if a in ("buy", "hold") and w / total > 0.001}
        pnl = r
    return log, accepted


@pytest.mark.parametrize("seed", [1, 5])
def test_walked_against_plain_weeks(spark, seed):
    p, d, t, prices, decided = tables(spark, seed)
    got, log = decisions.walked(p, decisions.RuleProvider(d, t), t)
    want_log, want = slow_walk(prices, decided)
    assert {r.ws: (r.attempts, r.forced) for r in log.collect()} == want_log
    found: dict = {}
    for r in got.collect():
        found.setdefault(r.ws, []).append((r.industry, r.action, round(r.weight, 9)))
    assert {k: sorted(v) for k, v in found.items()} == {k: [(n, a, round(w, 9)) for n, a, w in v] for k, v in want.items()}
    assert {a for a, _ in want_log.values()} == {1, 2, 3}


def test_provider_that_gives_up(spark):
    p, d, t, _, decided = tables(spark, 3)

    class Nothing(decisions.RuleProvider):
        def revise(self, rejected, broken, routes):
            return rejected.where("false")

    weeks = d.select("ws").distinct()
    none = spark.createDataFrame([], "ws date, industry string")
    pnl = spark.createDataFrame([], "ws date, r double")
    got, log = decisions.checked(d, Nothing(d, t), t, none, pnl)
    bad = {ws for ws in {r[0] for r in decided} if violations([r[1:] for r in decided if r[0] == ws], {}, 0.0)}
    rows = {r.ws: r for r in log.collect()}
    assert set(rows) == {r.ws for r in weeks.collect()} and all(rows[ws].attempts == 2 and not rows[ws].forced and rows[ws].route in ("trader", "researcher") for ws in bad)
    assert all(rows[ws].attempts == 1 and rows[ws].route == "end" for ws in set(rows) - bad)
    assert {r.ws for r in got.collect()} == set(rows) - bad
    empty, log = decisions.checked(d.where("false"), decisions.RuleProvider(d, t), t, none, pnl)
    assert empty.count() == 0 and log.count() == 0


def test_losing_runs_and_cut(spark):
    rs = [0.1, -0.1, -0.2, -0.3, 0.0, -0.1, None, -0.1, -0.1, 0.2]
    weekly = spark.createDataFrame([(MONDAY + dt.timedelta(weeks=k), r) for k, r in enumerate(rs)], "ws date, r double").repartition(3)
    assert [r.losing for r in portfolio.losing_runs(weekly).orderBy("ws").collect()] == [0, 0, 1, 2, 3, 0, 1, 0, 1, 2]
    p, d, _, _, _ = tables(spark, 8, 60)
    cfg = BacktestConfig()
    plain = backtest.run(p, d, cfg).select("ws", "weekly_return", "invested_weight").collect()
    weekly = spark.createDataFrame([(r.ws, r.weekly_return) for r in plain], "ws date, r double")
    cut = backtest.run(p, portfolio.cut_after_losses(d, weekly), cfg).select("ws", "weekly_return", "invested_weight").collect()
    losing = {r.ws: r.losing for r in portfolio.losing_runs(weekly).collect()}
    deciding = sorted({r.ws for r in d.collect()})
    plain_by, hit = {r.ws: r for r in plain}, 0
    for r in cut:
        source = max((w for w in deciding if w < r.ws), default=None)
        factor = 0.8 if source is not None and losing.get(source, 0) >= 2 else 1.0
        hit += factor < 1
        assert abs(r.invested_weight - factor * plain_by[r.ws].invested_weight) < 1e-12 and abs(r.weekly_return - factor * plain_by[r.ws].weekly_return) < 1e-12
    assert hit
