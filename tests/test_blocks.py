"""Blocked folds, sums and ranks against plain loops over whole series."""

import datetime as dt
import random

import numpy as np
import pytest

from volpanel import params as P
from volpanel.operators import blocks as B
from volpanel.operators import condor as Co
from volpanel.operators import series as S
from volpanel.operators import state as St

PHASES = ["BALANCED_MARKET", "DOWNSIDE_TAIL_RICH", "UNKNOWN", "FRAGMENTED_TRANSITION", *P.ACUTE_PHASES, *P.IMMEDIATE_PHASES]


def days(n, first=dt.date(2001, 1, 1)):
    return [first + dt.timedelta(days=i) for i in range(n)]


def machine_rows(n, seed):
    rng = random.Random(seed)
    rows, raw = [], PHASES[0]
    for d in days(n):
        raw = rng.choice(PHASES) if rng.random() < 0.5 else raw
        rows.append((d, raw, "OK" if rng.random() < 0.95 else "PARTIAL", rng.choice([True, False, None]), rng.choice([None, 50.0, 80.0])))
    return rows


def plain_machine(rows):
    state, out = (None, None, 0), []
    for _, raw, status, acute, shock in rows:
        state = St._advance(raw, status, acute, shock, *state)
        out.append(state)
    return out


def test_phase_machine_by_blocks_equals_the_fold(spark):
    series = {u: machine_rows(400, n) for n, u in enumerate("abc")}
    rows = [(u, *r) for u, s in series.items() for r in s]
    df = spark.createDataFrame(rows, "universe_id string, session_date date, raw_phase string, data_status string, hard_acute boolean, shock double")
    for span in (1, 7, 64, 1000):
        got = St.publish_phases(df, span=span).orderBy("universe_id", "session_date").collect()
        assert [(r.primary_phase, r.candidate_phase, r.candidate_streak) for r in got] == [x for s in series.values() for x in plain_machine(s)]


def test_a_million_sessions_run_in_many_tasks(spark):
    n, span = 1_000_000, 25_000
    base = spark.range(0, n, 1, 16).selectExpr(
        "'u' AS universe_id", "date_add(DATE'0001-01-01', int(id)) AS session_date",
        f"element_at(array({', '.join(repr(p) for p in PHASES)}), int(pmod(xxhash64(id div 3), {len(PHASES)})) + 1) AS raw_phase",
        "if(pmod(xxhash64(id, 1), 50) = 0, 'PARTIAL', 'OK') AS data_status", "pmod(xxhash64(id, 2), 3) = 0 AS hard_acute",
        "double(pmod(xxhash64(id, 3), 100)) AS shock", "pmod(xxhash64(id, 4), 5) / 4D AS unit",
    )
    pdf = base.toPandas().sort_values("session_date")
    expected = plain_machine(pdf[["session_date", "raw_phase", "data_status", "hard_acute", "shock"]].itertuples(index=False))
    got = St.publish_phases(base, span=span).toPandas().sort_values("session_date")
    assert list(got["primary_phase"]) == [e[0] for e in expected] and list(got["candidate_streak"]) == [e[2] for e in expected]
    level = before = 0.0
    path = []
    for unit in pdf["unit"]:
        if unit <= level or before >= unit:
            level = unit
        path.append(level)
        before = unit
    out = St.confirm_increases(base, "unit", "c", keys=[], order="session_date", span=span).toPandas().sort_values("session_date")
    assert list(out["c"]) == path


def test_confirmed_units_by_blocks_equal_the_fold(spark):
    rng = random.Random(3)
    rows = [(k, d, rng.choice([None, float("nan"), 0.0, 0.25, 0.5, 1.0])) for k in ("a", None) for d in days(300)]
    df = spark.createDataFrame(rows, "k string, d date, u double")
    expected = {}
    for k in ("a", None):
        level = before = 0.0
        for _, d, u in (r for r in rows if r[0] == k):
            u = 0.0 if u is None or u != u else u
            if u <= level or before >= u:
                level = u
            expected[k, d] = level
            before = u
    for span in (1, 5, 90, 5000):
        out = St.confirm_increases(df, "u", "c", keys=["k"], order="d", span=span).collect()
        assert {(r.k, r.d): r.c for r in out} == expected
    assert "Python" not in St.confirm_increases(df, "u", "c", keys=["k"], order="d")._jdf.queryExecution().toString()


def test_ewma_by_blocks_equals_the_recursion(spark):
    rng = np.random.default_rng(6)
    series = {}
    for k in ("a", "b", "c"):
        x = rng.normal(size=500) * 0.02
        x[rng.choice(500, {"a": 0, "b": 3, "c": 60}[k], replace=False)] = np.nan
        series[k] = x
    rows = [(k, d, float(v)) for k, x in series.items() for d, v in zip(days(500), x)]
    df = spark.createDataFrame(rows, "k string, d date, x double")
    expected = {}
    for k, x in series.items():
        level, seen = None, []
        for d, v in zip(days(500), x):
            if not np.isfinite(v):
                level, seen = None, []
            elif level is not None:
                level = 0.94 * level + 0.06 * v * v
            else:
                seen.append(v)
                level = float(np.var(seen, ddof=1)) if len(seen) == 20 else None
            expected[k, d] = level
    for span in (3, 20, 37, 4000):
        got = {(r.k, r.d): r.v for r in S.ewma_variance(df, "x", "v", keys=["k"], order="d", warmup=20, span=span).collect()}
        assert got.keys() == expected.keys()
        for at, v in expected.items():
            assert got[at] == (None if v is None else pytest.approx(v, rel=1e-12)), (span, at)


def test_ranks_with_ties_over_ranges(spark):
    rng = random.Random(8)
    rows = [(k, float(rng.choice([0, 0, 0, 1, 2, 3, rng.random()])) if rng.random() < 0.9 else None) for k in ("a", "b") for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, x double")
    for parts in (None, 1, 7):
        got = {(r.k, r.x): r.rank for r in B.value_ranks(df, ["k"], "x", "rank", parts=parts).collect()}
        for k in ("a", "b"):
            own = sorted(x for q, x in rows if q == k and x is not None)
            assert {x: r for (q, x), r in got.items() if q == k} == {x: np.mean([i + 1 for i, y in enumerate(own) if y == x]) for x in own}
    placed = B.value_ranks(df, ["k"], "x", "rank", parts=7)._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(k#" in placed and "_block" in placed


def test_positions_and_running_counts(spark):
    rng = random.Random(1)
    all_days = days(900)
    rows = [(k, d) for k in ("a", "b") for d in rng.sample(all_days, 500)]
    df = spark.createDataFrame(rows, "k string, d date")
    got = {(r.k, r.d): r.p for r in B.positions(df, ["k"], "d", "p", span=11).collect()}
    assert got == {(k, d): i for k in ("a", "b") for i, d in enumerate(sorted(d for q, d in rows if q == k))}
    listed = [(rng.choice("CP"), a, a + dt.timedelta(days=rng.randint(0, 400))) for a in rng.sample(all_days, 300)]
    contracts = spark.createDataFrame(listed, "call_put string, list_date date, maturity_date date")
    sessions = spark.createDataFrame([(d,) for d in all_days[::3]], "session_date date")
    live = {r.session_date: r.active for r in Co.active_counts(contracts, sessions).collect()}
    assert live == {d: sum(a <= d <= b for _, a, b in listed) for d in all_days[::3]}


def test_empty_series(spark):
    df = spark.createDataFrame([], "k string, d date, x double")
    assert S.ewma_variance(df, "x", "v", keys=["k"], order="d").count() == 0
    assert St.confirm_increases(df, "x", "c", keys=["k"], order="d").count() == 0
    assert B.value_ranks(df, ["k"], "x", "r").count() == 0
