import datetime as dt

import numpy as np
import pandas as pd
import pytest

from volpanel import params as P
from volpanel.operators import features as X
from volpanel.operators import market as M
from volpanel.operators import series as S
from volpanel.operators import state as St


def series_frame(spark, n=900, seed=3, entities=("a", "b")):
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2015-01-01", periods=n)
    frames = []
    for e in entities:
        x = np.round(rng.normal(size=n), 2)
        x[rng.random(n) < 0.05] = np.nan
        frames.append(pd.DataFrame({"e": e, "d": days.date, "x": x}))
    pdf = pd.concat(frames)
    return pdf, spark.createDataFrame(pdf.astype({"x": object}).where(pdf.notna(), None), "e string, d date, x double")


def direct_midrank(x, reference, minimum):
    out = np.full(len(x), np.nan)
    for i, v in enumerate(x):
        past = x[max(0, i - reference) : i]
        past = past[~np.isnan(past)]
        if not np.isnan(v) and len(past) >= minimum:
            out[i] = (np.sum(past < v) + 0.5 * np.sum(past == v)) / len(past)
    return out


@pytest.mark.parametrize("block", [100, 2048])
def test_midrank_is_the_same_in_any_block_size(spark, block):
    pdf, df = series_frame(spark)
    out = S.midrank_percentiles(df, {"p": ("x", 1)}, keys=["e"], order="d", reference=90, minimum_valid=40, block=block)
    got = out.toPandas().sort_values(["e", "d"])
    assert len(got) == len(pdf)
    for e, g in pdf.groupby("e"):
        np.testing.assert_allclose(got[got.e == e].p.to_numpy(float), direct_midrank(g.x.to_numpy(), 90, 40))


def test_later_rows_never_move_earlier_percentiles(spark):
    _, df = series_frame(spark, entities=("a",))
    cut = dt.date(2017, 1, 2)
    changed = df.selectExpr("e", "d", f"CASE WHEN d > DATE'{cut}' THEN x * -3 ELSE x END AS x")
    kw = dict(keys=["e"], order="d", reference=90, minimum_valid=40)
    a, b = (S.midrank_percentiles(f, {"p": ("x", 1)}, **kw).filter(f"d <= DATE'{cut}'").orderBy("d").toPandas() for f in (df, changed))
    pd.testing.assert_frame_equal(a, b)


def test_ewma_restarts_after_a_gap(spark):
    x = np.linspace(-0.02, 0.03, 30).tolist() + [None] + np.linspace(0.01, -0.02, 12).tolist()
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "e string, d date, x double")
    got = [r.v for r in S.ewma_variance(df, "x", "v", keys=["e"], order="d", warmup=10).orderBy("d").collect()]
    assert got[8] is None and got[9] == pytest.approx(np.var(x[:10], ddof=1))
    assert got[10] == pytest.approx(0.94 * got[9] + 0.06 * x[10] ** 2)
    assert all(v is None for v in got[30:40]) and got[40] == pytest.approx(np.var(x[31:41], ddof=1))


def test_vol_of_vol_needs_twenty_valid_in_the_span(spark):
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i % 7) if i % 5 == 0 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "e string, d date, x double")
    out = S.vol_of_vol(df, "x", "v", "s", keys=["e"], order="d", max_span=96).orderBy("d").collect()
    assert out[95].v == pytest.approx(np.std([float(i % 7) for i in range(0, 96, 5)], ddof=1) * 252**0.5) and out[95].s == 96
    assert S.vol_of_vol(df, "x", "v", "s", keys=["e"], order="d", max_span=80).filter("v IS NOT NULL").count() == 0


def test_compounded_return_handles_total_loss(spark):
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), r) for i, r in enumerate([0.1, -1.0, 0.2, 0.1, -0.1, 0.3])]
    df = S.add(spark.createDataFrame(rows, "e string, d date, r double"), {"c": S.compounded_return("r", S.by(["e"], "d"), 3)})
    got = [r.c for r in df.orderBy("d").collect()]
    assert got[:2] == [None, None] and got[2] == -1.0 and got[5] == pytest.approx(1.1 * 0.9 * 1.3 - 1)


def feature_panel(spark, sessions=270):
    days = pd.bdate_range("2024-01-02", periods=sessions)
    rows = []
    for n, m in enumerate(P.DEFAULT_UNIVERSE.members):
        for i, d in enumerate(days):
            row = {p: 0.5 for p in P.PERCENTILES if p != "p_vrp"}
            row |= {"session_date": d.date(), "carrier_id": m.carrier, "economic_index_id": m.index, "surface_status": "VALID", "issues": "",
                    "d5_fvol_30_90": float(((n + 1) * (i + 1)) % 37 - n * 4), "etf_return_5d": 0.0, "vrp_ewma94": 0.01, "vrp_percentile": 0.5}
            rows.append(row)
    pdf = pd.DataFrame(rows)
    return pdf, spark.createDataFrame(pdf)


def test_percentile_of_the_aggregate(spark):
    pdf, df = feature_panel(spark)
    out = M.build_market_score_history(df, reference_sessions=252, minimum_valid=252).orderBy("session_date").toPandas()
    aggregate = pdf.assign(w=pdf.economic_index_id.map(P.DEFAULT_UNIVERSE.weight) * pdf.d5_fvol_30_90).groupby("session_date").w.sum()
    expected = direct_midrank(aggregate.to_numpy(), 252, 252)
    assert out.aggregate_d5_fvol30_90_percentile.notna().sum() == 18
    np.testing.assert_allclose(out.aggregate_d5_fvol30_90_percentile.to_numpy(float), expected)
    assert set(out.data_status) == {"OK"} and out.pressure_score.notna().all()


def test_unknown_stays_unknown(spark):
    _, df = feature_panel(spark, 12)
    broken = S.add(df, {"p_d1_log_iv30": "CASE WHEN economic_index_id = 'SSE50' THEN NULL ELSE p_d1_log_iv30 END"})
    m = M.aggregate_sessions(M.score_indices(broken)).first()
    assert m.data_status == "PARTIAL" and m.confidence == "LOW"
    assert m.pressure_score is None and m.shock is None and m.large_jump is None
    o = St.add_state_ontology(M.build_market_score_history(broken, minimum_valid=5)).first()
    assert o.raw_phase == "UNKNOWN" and o.level_answer == "UNKNOWN"


def test_incomplete_universe_is_dropped(spark):
    _, df = feature_panel(spark, 6)
    first = df.agg({"session_date": "min"}).first()[0]
    part = df.filter(f"NOT (session_date = DATE'{first}' AND economic_index_id = 'STAR50')")
    assert M.aggregate_sessions(M.score_indices(part)).count() == 5


def history(spark, phases, acute=None, shock=None, status=None):
    rows = [
        ("u", dt.date(2024, 1, 1) + dt.timedelta(days=i), p, (status or {}).get(i, "OK"), (acute or {}).get(i, False), (shock or {}).get(i, 50.0))
        for i, p in enumerate(phases)
    ]
    return spark.createDataFrame(rows, "universe_id string, session_date date, raw_phase string, data_status string, hard_acute boolean, shock double")


def published(spark, *args, **kw):
    out = St.apply_phase_hysteresis(history(spark, *args, **kw), config_hash="c").orderBy("session_date").collect()
    for a, b in zip(out, out[1:]):
        assert b.previous_checkpoint_hash == a.checkpoint_hash
    assert out[0].previous_checkpoint_hash is None
    return [r.primary_phase for r in out]


def test_hysteresis(spark):
    calm, tail = "BALANCED_MARKET", "DOWNSIDE_TAIL_RICH"
    assert published(spark, [calm, tail, calm, tail, tail]) == [calm, calm, calm, calm, tail]
    assert published(spark, [calm, "REPAIR_IN_PROGRESS"]) == [calm, "REPAIR_IN_PROGRESS"]
    acute = "LOCALIZED_ACUTE_STRESS"
    assert published(spark, [acute, calm, calm, calm], shock={1: 80.0}) == [acute, acute, acute, calm]
    assert published(spark, [calm, tail, tail], status={1: "PARTIAL"}) == [calm, "UNKNOWN", tail]


def test_confirmed_increases(spark):
    raw = [0.5, 0.5, 1.0, 1.0, 0.25, 0.75, 0.75, 0.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(raw)], "k string, i int, u double")
    out = St.confirm_increases(df, "u", "c", keys=["k"], order="i").orderBy("i").collect()
    assert [r.c for r in out] == [0.0, 0.5, 0.5, 1.0, 0.25, 0.25, 0.75, 0.0]


def test_compensation_bands(spark):
    df = spark.createDataFrame([(None,), (0.34,), (0.35,), (0.75,)], "p double")
    assert [r[0] for r in df.selectExpr(X.compensation("p")).collect()] == ["UNKNOWN", "THIN", "NORMAL", "RICH"]
