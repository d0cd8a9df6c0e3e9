import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from volpanel import params as P
from volpanel.functions.num import add
from volpanel.operators import audit as A
from volpanel.operators import calendar as C
from volpanel.operators import condor as Co
from volpanel.operators import metrics as Me
from volpanel.operators import timing as Ti
from volpanel.sources import sinks as K

SIGNAL = (
    "global_status string, phase string, local_status string, insurance_compensation string, direction string, vrp_ewma94 double, "
    "pressure_score double, index_pressure double, shock double, down_tail double, persistence double, hard_acute boolean"
)
CALM = dict(global_status="OK", phase="CALM_POSITIVE_VRP", local_status="OK", insurance_compensation="RICH", direction="STABLE", vrp_ewma94=0.02,
            pressure_score=20.0, index_pressure=20.0, shock=20.0, down_tail=20.0, persistence=20.0, hard_acute=False)


@pytest.mark.parametrize(
    "change, unit, reason",
    [
        ({}, 1.0, "PHASE_MAP"),
        ({"global_status": "PARTIAL"}, 0.0, "GLOBAL_NOT_OK"),
        ({"pressure_score": 72.0}, 0.25, "PHASE_MAP+GLOBAL_PRESSURE_CAP"),
        ({"insurance_compensation": "NORMAL"}, 0.5, "PHASE_MAP+NORMAL_COMP_CAP"),
        ({"insurance_compensation": "THIN"}, 0.0, "COMPENSATION_THIN"),
        ({"vrp_ewma94": None}, 0.0, "VRP_NOT_POSITIVE"),
        ({"down_tail": 86.0}, 0.0, "ACUTE_CAP_ZERO"),
        ({"phase": "BROAD_PRESSURE"}, 0.0, "PHASE_BROAD_PRESSURE"),
        ({"shock": 65.0}, 0.25, "PHASE_MAP+CSI300_PRESSURE_CAP"),
    ],
)
def test_risk_units(spark, change, unit, reason):
    row = {**CALM, **change}
    df = spark.createDataFrame([tuple(row[c.strip().split(" ")[0]] for c in SIGNAL.split(","))], SIGNAL)
    got = df.select(F.expr(Co.risk_unit()).alias("u")).first().u
    assert (got.unit, got.reason) == (unit, reason)


def test_adverse_fills(spark):
    rows = [(s, f) for s in ("SELL", "BUY") for f in P.FILLS]
    df = add(spark.createDataFrame(rows, "side string, scenario string"), {"p": Co.fill_price("side", "scenario", "0.1D", "0.09D", "0.11D", "0.0001D")})
    got = {(r.side, r.scenario): r.p for r in df.collect()}
    assert got["SELL", "VWAP_2TICK"] == pytest.approx(0.0998) and got["BUY", "VWAP_2TICK"] == pytest.approx(0.1002)
    assert got["SELL", "BAR_EXTREME"] == 0.09 and got["BUY", "BAR_EXTREME"] == 0.11
    assert got["BUY", "VWAP_RANGE_25"] == pytest.approx(0.105)


def condor_inputs(spark):
    days = [dt.date(2025, 1, 2), dt.date(2025, 1, 3)]
    expiry = dt.date(2025, 2, 7)
    sessions = spark.createDataFrame([(d, 4.0) for d in days], "session_date date, spot_0935 double")
    strikes = [3.4, 3.5, 3.6, 3.7, 3.8, 4.2, 4.3, 4.4, 4.5, 4.6]
    rows = [(f"{k}{x}", k, x, dt.date(2024, 12, 1), expiry, 0.0001) for k in "CP" for x in strikes]
    contracts = spark.createDataFrame(rows, "code string, call_put string, exercise_price double, list_date date, maturity_date date, min_price_chg double")
    surface = spark.createDataFrame([(days[0], expiry, 30.0)], "session_date date, expiry date, atm_iv double")
    return days, sessions, contracts, surface


def test_condor_uses_only_the_lagged_surface(spark):
    days, sessions, contracts, surface = condor_inputs(spark)
    candidates, rejects = Co.select_condors(sessions, contracts, surface)
    c = candidates.collect()
    assert len(c) == 1 and c[0].session_date == days[1] and c[0].signal_session_date == days[0]
    assert abs(c[0].net_delta) <= 0.10
    assert c[0].long_put_strike < c[0].short_put_strike < 4.0 < c[0].short_call_strike < c[0].long_call_strike
    assert [r.reason for r in rejects.collect()] == ["NO_LAGGED_SURFACE_OR_SPOT"]
    late = surface.withColumn("session_date", F.lit(days[1]))
    assert [r.reason for r in Co.select_condors(sessions, contracts, late)[1].orderBy("session_date").collect()][1] == "NO_PRIOR_EXPIRY_IV"


def test_sizing_and_first_failed_leg(spark):
    days, sessions, contracts, surface = condor_inputs(spark)
    candidates = Co.select_condors(sessions, contracts, surface)[0]
    c = candidates.first()
    price = {"short_put": 0.06, "long_put": 0.02, "short_call": 0.06, "long_call": 0.02}
    rows = [(days[1], c[f"{leg}_code"], "OPEN_AM", 5, 1000, p, p * 1.02, p * 0.98) for leg, p in price.items()]
    schema = "session_date date, code string, fill_window string, positive_minutes int, volume int, vwap double, high double, low double"
    calendar = spark.createDataFrame([(days[1], 0.5, 0.0)], "session_date date, static_unit double, dynamic_unit double")
    sized = Co.entry_sizing(candidates, spark.createDataFrame(rows, schema), calendar).toPandas()
    assert len(sized) == 11 and set(sized.strategy) == {"SV_STATIC"}
    r = sized[(sized.fill_scenario == "VWAP_2TICK") & (sized.fee_scenario == "BROKER_PLUS_2") & (sized.risk_budget == 0.08)].iloc[0]
    credit = 10_000 * (0.0598 * 2 - 0.0202 * 2)
    loss = max(c.short_put_strike - c.long_put_strike, c.long_call_strike - c.short_call_strike) * 10_000 - credit
    assert r.credit == pytest.approx(credit) and r.max_loss == pytest.approx(loss)
    assert r.quantity == min(int(1e6 * 0.08 * 0.5 // loss), int(1e6 * 0.35 // loss), 50)
    assert r.open_fee == pytest.approx(r.quantity * (3.2 + 8))
    thin = [row[:4] + (10,) + row[5:] if row[1] == c.long_put_code else row for row in rows]
    bad = Co.entry_sizing(candidates, spark.createDataFrame(thin, schema), calendar).toPandas()
    assert set(bad.rejection) == {"OPEN_AM_long_put_LIQUIDITY"} and bad.quantity.isna().all()


def timing_inputs(spark, units=None, phases=None, marks_at=None):
    days = list(pd.bdate_range("2025-01-02", periods=15).date)
    units, phases = units or [0.25] * 15, phases or ["BALANCED_MARKET"] * 15
    rows = [(d, dt.date(2024, 12, 31), 4.0, "OK", "OK", p, "RICH", 0.02, u, u, "PHASE_MAP") for d, u, p in zip(days, units, phases)]
    calendar = spark.createDataFrame(rows, "session_date date, signal_session_date date, etf_mark double, global_status string, local_status string, phase string, "
                                     "insurance_compensation string, vrp_ewma94 double, dynamic_unit double, raw_dynamic_unit double, risk_reason string")
    legs = dict(short_put=("SP", 3.9), long_put=("LP", 3.8), short_call=("SC", 4.1), long_call=("LC", 4.2))
    candidate = {"session_date": days[0], "expiry": dt.date(2025, 1, 24)}
    for n, (code, strike) in legs.items():
        candidate |= {f"{n}_code": code, f"{n}_strike": strike}
    candidates = spark.createDataFrame(pd.DataFrame([candidate]))
    marks = spark.createDataFrame([(d, c, v, None) for i, d in enumerate(days) for c, v in marks_at(i).items()], "session_date date, code string, settle double, close double")
    return days, calendar, candidates, marks


ENTRY = {"SP": 0.03, "LP": 0.02, "SC": 0.03, "LC": 0.02}
LATER = {"SP": 0.02, "LP": 0.015, "SC": 0.02, "LC": 0.015}
LOSS = {"SP": 0.05, "LP": 0.02, "SC": 0.04, "LC": 0.02}


def test_opportunity_panel(spark):
    _, calendar, candidates, marks = timing_inputs(spark, marks_at=lambda i: ENTRY if i == 0 else LATER)
    panel = Ti.opportunity_panel(calendar, candidates, marks).toPandas()
    assert set(panel.horizon) == {"H5", "H10", "TO_7DTE"} and set(panel.state_category) == {"ALLOW"}
    for column, expected in (("entry_credit", 200.0), ("defined_max_loss", 800.0), ("pnl_per_combo", 100.0), ("return_on_max_loss", 0.125), ("path_mark_coverage", 1.0)):
        assert panel[column].to_numpy(float) == pytest.approx([expected] * 3)
    assert panel.max_adverse_excursion.to_numpy(float) == pytest.approx([0.0] * 3)


def test_missing_leg_removes_the_outcome(spark):
    def marks(i):
        return ENTRY if i == 0 else {k: v for k, v in LATER.items() if not (i == 5 and k == "LC")}

    _, calendar, candidates, m = timing_inputs(spark, marks_at=marks)
    panel = Ti.opportunity_panel(calendar, candidates, m).toPandas().set_index("horizon")
    assert set(panel.index) == {"H10", "TO_7DTE"} and panel.loc["H10", "path_mark_coverage"] == pytest.approx(10 / 11)


def test_state_exit_against_a_fixed_exit(spark):
    phases = ["BALANCED_MARKET"] * 3 + ["BROAD_PRESSURE"] * 12
    args = timing_inputs(spark, [0.25] * 3 + [0.0] * 12, phases, lambda i: ENTRY if i == 0 else LATER if i <= 3 else LOSS)[1:]
    out = Ti.state_exits(*args).toPandas().set_index("mode")
    assert out.loc["STATIC_KNOWN_UNIVERSE", "exit_reason"] == "DTE_7" and out.loc["STATIC_KNOWN_UNIVERSE", "pnl_per_combo"] == pytest.approx(-300.0)
    assert out.loc["KNOWN_BLOCK_EXIT", "exit_reason"] == "STATE_KNOWN_BLOCK" and out.loc["KNOWN_BLOCK_EXIT", "pnl_per_combo"] == pytest.approx(100.0)


def summary_panel(spark):
    outcomes = [-0.50, -0.40, 0.10, 0.20, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30]
    expiries = [dt.date(2025, m, d) for m, d in ((2, 28), (3, 28), (4, 25), (5, 23), (6, 27)) for _ in range(2)]
    rows = [
        (h, dt.date(2025, 1, 2) + dt.timedelta(days=i), expiries[i], "ALLOW" if i < 4 else "KNOWN_BLOCK", 0.25 if i < 4 else 0.0, "BALANCED_MARKET", x, x, "CALL")
        for h in ("H5", "H10", "TO_7DTE") for i, x in enumerate(outcomes)
    ]
    return outcomes, expiries, spark.createDataFrame(
        rows, "horizon string, session_date date, expiry date, state_category string, risk_unit double, phase string, return_on_max_loss double, max_adverse_excursion double, loss_side string")


def test_timing_summary(spark):
    outcomes, expiries, panel = summary_panel(spark)
    r = Ti.conclusion(panel).first()
    assert r.conclusion == "IN_SAMPLE_TIMING_NOT_SUPPORTED" and r.allow_minus_block_mean == pytest.approx(-0.325)
    assert (r.bad_opportunity_days, r.blocked_bad_opportunity_days, r.block_capture_rate) == (1, 0, 0.0)
    assert r.worst_allowed_expiry == dt.date(2025, 2, 28)
    assert r.allow_minus_block_without_worst_expiry == pytest.approx(0.15 - 0.175)


def test_cluster_bootstrap_follows_the_seed(spark):
    outcomes, expiries, panel = summary_panel(spark)
    got = Ti.cluster_bootstrap(panel, draws=200).filter("horizon = 'H5'").first()
    pdf = pd.DataFrame({"e": expiries, "r": outcomes, "a": [i < 4 for i in range(10)]})
    groups = [g for _, g in pdf.groupby("e")]
    rng, deltas = np.random.default_rng(20260821), []
    for _ in range(200):
        s = pd.concat([groups[i] for i in rng.integers(0, 5, size=5)])
        if s.a.any() and (~s.a).any():
            deltas.append(s.r[s.a].mean() - s.r[~s.a].mean())
    assert got.draws == len(deltas)
    assert (got.ci_lower, got.ci_upper) == pytest.approx(tuple(np.quantile(deltas, [0.025, 0.975])))


def test_spearman_with_ties(spark):
    x, y = [1.0, 1.0, 2.0, 3.0, 3.0, 5.0], [2.0, 1.0, 2.0, 5.0, 4.0, 4.0]
    df = spark.createDataFrame([("k", a, b) for a, b in zip(x, y)], "k string, x double, y double")
    expected = np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
    assert Ti.spearman(df, ["k"], "x", "y").first().rho == pytest.approx(expected)
    assert Ti.spearman(df.withColumn("x", F.lit(1.0)), ["k"], "x", "y").first().rho is None


def test_stress_panel_needs_the_previous_surface(spark):
    days = list(pd.bdate_range("2025-01-02", periods=25).date)
    expiry = dt.date(2025, 2, 7)
    rows = [(d, 4.0 * 1.001**i, "OK", "OK", "BALANCED_MARKET", "RICH", 0.02, 0.25) for i, d in enumerate(days)]
    calendar = spark.createDataFrame(rows, "session_date date, etf_mark double, global_status string, local_status string, phase string, insurance_compensation string, vrp_ewma94 double, dynamic_unit double")
    contracts = spark.createDataFrame([(k, dt.date(2024, 12, 1), expiry) for k in "CP"], "call_put string, list_date date, maturity_date date")
    surface = spark.createDataFrame([(days[0], expiry, 20.0)], "session_date date, expiry date, atm_iv double")
    panel = Ti.stress_panel(calendar, contracts, surface).toPandas()
    assert set(panel.horizon) == {"H5", "H10", "H20"} and set(panel.session_date) == {days[1]} and set(panel.lagged_atm_iv) == {0.20}
    h5 = panel.set_index("horizon").loc["H5"]
    assert h5.maximum_up_move == pytest.approx(5 * np.log(1.001)) and h5.maximum_down_move == 0.0 and h5.future_realized_vol == pytest.approx(0.0, abs=1e-9)


def test_path_metrics(spark):
    nav = [1_000_000.0, 1_010_000.0, 990_000.0, 1_005_000.0, 980_000.0, 1_020_000.0]
    rows = [("S", "F", 2.0, 0.08, dt.date(2024, 6, 17) + dt.timedelta(days=i), v, v / nav[max(i - 1, 0)] - 1, 0.5, float(i % 2), float(i)) for i, v in enumerate(nav)]
    df = spark.createDataFrame(rows, "strategy string, fill_scenario string, broker_fee_per_contract double, risk_budget double, session_date date, nav double, "
                               "daily_return double, risk_unit double, position_quantity double, fees_cumulative double")
    m = Me.path_metrics(df).first()
    r = pd.Series([row[6] for row in rows])
    assert m.max_drawdown == pytest.approx(980 / 1010 - 1) and m.max_drawdown_date == dt.date(2024, 6, 21)
    assert m.annualized_volatility == pytest.approx(r.std() * 252**0.5) and m.expected_shortfall_95 == pytest.approx(r[r <= r.quantile(0.05)].mean())
    assert m.worst_20_session_return is None and m.cagr == pytest.approx(1.02 ** (365.2425 / 5) - 1) and m.fees == 5.0
    later = Me.path_metrics(Me.rebase(df, "2024-06-19")).first()
    assert later.sessions == 4 and later.fees == 3.0 and later.total_return == pytest.approx(1020 / 990 - 1)


@pytest.mark.parametrize("price", [4.0, 3.937, 0.05, 250.0, 9_000.0, 20_000.0])
def test_benchmark_lots(spark, price):
    df = spark.createDataFrame([(dt.date(2024, 1, 2), price, price, price * 1.1), (dt.date(2024, 1, 3), price, price, price * 1.2)],
                               "session_date date, entry_vwap double, etf_mark double, tr_mark double")
    shares = int(1e6 / (price + 0.002) // 100) * 100
    while shares and shares * (price + 0.002) + max(5.0, shares * (price + 0.002) * 0.0003) > 1e6:
        shares -= 100
    out = Me.buy_and_hold(df).orderBy("session_date").collect()
    assert out[0].position_quantity == shares
    cost = shares * (price + 0.002)
    assert out[0].nav == pytest.approx(1e6 - cost - max(5.0, cost * 0.0003) + cost * price / (price + 0.002))


def test_era_boundaries(spark):
    days = ["2015-02-09", "2019-12-22", "2019-12-23", "2022-09-19", "2023-06-04", "2023-06-05", "2014-01-01"]
    df = spark.createDataFrame([(i, dt.date.fromisoformat(d)) for i, d in enumerate(days)], "i int, d date")
    got = [r.e for r in add(df, {"e": A.coverage_regime("d")}).orderBy("i").collect()]
    assert got == ["ERA_A_50_ONLY", "ERA_A_50_ONLY", "ERA_B_50_300", "ERA_C_50_300_500", "ERA_C_50_300_500", "ERA_D_FOUR_CARRIERS", None]


def test_audit_keeps_unlisted_rows(spark):
    days = [dt.date(2023, 6, 2), dt.date(2023, 6, 5)]
    rows = [(d, m.carrier, "VALID", "TOTAL_VARIANCE_INTERPOLATION", 20.0) for d in days for m in P.DEFAULT_UNIVERSE.members if not (d == days[0] and m.segment == "tech")]
    surfaces = spark.createDataFrame(rows, "session_date date, carrier_id string, surface_status string, iv30_method string, iv30_mf double")
    features = surfaces.selectExpr("session_date", "carrier_id", "0.03D AS rv_forecast30", "0.01D AS vrp_ewma94", "0.5D AS vrp_percentile", "'NORMAL' AS insurance_compensation")
    states = spark.createDataFrame([(days[1], "OK", "BALANCED_MARKET", 50.0, 50.0, 50.0, 50.0, 0.0, 50.0, False)],
                                   "session_date date, data_status string, primary_phase string, pressure_score double, shock double, down_tail double, up_tail double, breadth double, repair double, hard_acute boolean")
    listings = spark.createDataFrame([(m.carrier, days[1] if m.segment == "tech" else days[0]) for m in P.DEFAULT_UNIVERSE.members], "carrier_id string, listing_date date")
    calendar = C.session_calendar(surfaces.select("session_date"))
    out = A.business_audit(surfaces, features, states, listings, calendar).toPandas().set_index(["session_date", "carrier_id"])
    row = out.loc[(days[0], "STAR50_588000")]
    assert row.data_status == "NOT_LISTED" and pd.isna(row.listing_age_sessions) and row.available_carrier_count == 3
    assert out.loc[(days[1], "STAR50_588000")].listing_age_sessions == 1 and out.loc[(days[1], "STAR50_588000")].data_status == "VALID"
    assert out.loc[(days[1], "SSE50_510050")].q_minus_p_variance_30_annualized == pytest.approx(0.01)


def test_reconcile_and_fingerprint(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", None), (3, "z", 2.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", 1.0 + 1e-12), (2, "y", None), (4, "z", 2.0)], "k int, s string, v double")
    got = {r.k: r.reconciled for r in A.reconcile(a, b, ["k"], ["s"], ["v"]).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}
    one = K.fingerprint(a).first()
    assert one == K.fingerprint(a.orderBy(F.desc("k")).repartition(3)).first()
    assert one.content_hash != K.fingerprint(a.unionByName(a)).first().content_hash
