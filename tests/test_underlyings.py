"""Tables of several underlyings give each of them what it gets alone; draws and fits can be proven."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_events_models import SMALL, ledger_frame
from test_research import ENTRY, LATER, LOSS, condor_inputs, summary_panel, timing_inputs

from volpanel.functions.num import add
from volpanel.operators import bootstrap as Bo
from volpanel.operators import condor as Co
from volpanel.operators import metrics as Me
from volpanel.operators import models as Mo
from volpanel.operators import timing as Ti

U = Co.UNDERLYING


def both(tables):
    """One table of two underlyings from those of each."""
    named = [t.withColumn(U, F.lit(name)) for name, t in tables.items()]
    return named[0].unionByName(named[1])


def alone(out, name):
    return sorted(map(str, out.filter(f"{U} = '{name}'").drop(U).collect()))


def recode(df, name, columns):
    return df.withColumns({c: F.concat(F.lit(f"{name}-"), F.col(c)) for c in columns})


def test_candidates_of_two_underlyings_do_not_mix(spark):
    _, sessions, contracts, surface = condor_inputs(spark)
    other = {
        "sessions": sessions.withColumn("spot_0935", F.lit(4.05)), "contracts": contracts.filter("exercise_price <> 4.3"), "surface": add(surface, {"atm_iv": "atm_iv + 4"}),
    }
    parts = {"a": (sessions, recode(contracts, "a", ["code"]), surface), "b": (other["sessions"], recode(other["contracts"], "b", ["code"]), other["surface"])}
    candidates, rejects = Co.select_condors(*(both({n: p[i] for n, p in parts.items()}) for i in range(3)))
    for name, part in parts.items():
        own = Co.select_condors(*part)
        columns = [c for c in candidates.columns if c != U]
        assert alone(candidates.select(U, *columns), name) == sorted(map(str, own[0].select(*columns).collect()))
        assert alone(rejects.select(U, "session_date", "reason"), name) == sorted(map(str, own[1].select("session_date", "reason").collect()))


def test_panels_of_two_underlyings_do_not_mix(spark):
    a = timing_inputs(spark, marks_at=lambda i: ENTRY if i == 0 else LATER)[1:]
    phases = ["BALANCED_MARKET"] * 3 + ["BROAD_PRESSURE"] * 12
    b = timing_inputs(spark, [0.25] * 3 + [0.0] * 12, phases, lambda i: ENTRY if i == 0 else LATER if i <= 3 else LOSS)[1:]
    b = (b[0].filter("session_date <> DATE'2025-01-08'"), *b[1:])  # another calendar
    codes = [f"{leg}_code" for leg in ("short_put", "long_put", "short_call", "long_call")]
    parts = {n: (c, recode(k, n, codes), recode(m, n, ["code"])) for n, (c, k, m) in {"a": a, "b": b}.items()}
    tables = [both({n: p[i] for n, p in parts.items()}) for i in range(2)]
    marks = parts["a"][2].unionByName(parts["b"][2])
    for build in (Ti.opportunity_panel, Ti.state_exits):
        out = build(*tables, marks)
        columns = [c for c in out.columns if c != U]
        for name, part in parts.items():
            assert alone(out.select(U, *columns), name) == sorted(map(str, build(*part).select(*columns).collect()))


def test_summaries_of_two_underlyings_do_not_mix(spark):
    _, _, panel = summary_panel(spark)
    worse = add(panel, {"return_on_max_loss": "-return_on_max_loss"})
    table = both({"a": panel, "b": worse})
    for build in (Ti.group_statistics, Ti.tail_capture, Ti.count_maps, Ti.mean_differences, Ti.conclusion, lambda p: Ti.cluster_bootstrap(p, draws=50)):
        out = build(table)
        columns = [c for c in out.columns if c != U]
        for name, part in (("a", panel), ("b", worse)):
            assert alone(out.select(U, *columns), name) == sorted(map(str, build(part).select(*columns).collect()))


def test_units_and_ledgers_follow_their_own_underlying(spark):
    days = list(pd.bdate_range("2025-01-02", periods=12).date)
    rows = [(n, d, 100.0 + i * k, 100.0 + i * k, 100.0) for n, k in (("a", 1), ("b", -2)) for i, d in enumerate(days)]
    spot = spark.createDataFrame(rows, f"{U} string, session_date date, etf_mark double, tr_mark double, entry_vwap double")
    held = Me.path_metrics(Me.buy_and_hold(spot))
    got = {r[U]: r.total_return for r in held.collect()}
    assert got["a"] > 0 > got["b"]
    for name in ("a", "b"):
        own = Me.path_metrics(Me.buy_and_hold(spot.filter(f"{U} = '{name}'").drop(U))).first()
        assert own.total_return == pytest.approx(got[name])


def test_counted_picks_are_spread_and_repeatable(spark):
    sizes = spark.createDataFrame([("k", 37, 20, 7)], "k string, n long, slots long, seed long")
    picks = [r.picks for r in Bo.counted(sizes, ["k"], 3000).orderBy("replicate").collect()]
    flat = np.array(picks).reshape(-1)
    counts = np.bincount(flat, minlength=37)
    assert flat.min() == 0 and flat.max() == 36 and ((counts - len(flat) / 37) ** 2 / (len(flat) / 37)).sum() < 80
    assert abs(np.corrcoef(flat[:-1], flat[1:])[0, 1]) < 0.02 and len({tuple(p) for p in picks}) == 3000
    other = [r.picks for r in Bo.counted(sizes.withColumn("seed", F.lit(8)), ["k"], 50).orderBy("replicate").collect()]
    assert other != picks[:50]


def test_certificates_prove_the_fits_and_notice_wrong_ones(spark):
    ledger = ledger_frame(spark, n=180, horizon=5, seed=5).filter("event_id = 'fast_repair_5d'")
    oof = Mo.out_of_fold_scores(ledger, SMALL)
    proof = Mo.logistic_certificates(ledger, oof, SMALL).toPandas()
    assert len(proof) == oof.count() > 20
    assert proof.gradient.max() < 1e-6 and proof.score_residual.abs().max() < 1e-9
    wrong = add(oof, {"model_weights": "transform(model_weights, w -> w + 0.01D)"})
    assert Mo.logistic_certificates(ledger, wrong, SMALL).toPandas().gradient.min() > 1e-4
    calibrated = Mo.sequential_calibration(oof, SMALL)
    curves = Mo.calibration_certificates(oof, calibrated).toPandas()
    assert len(curves) == calibrated.filter("calibration_success").count() > 0
    assert curves.intercept_gradient.max() < 1e-8 and curves.slope_gradient.max() < 1e-8
    assert Mo.fit_logistic(np.full((3, 1), np.nan), np.array([0.0, 1.0, 0.0]), 1.0) is None


def test_fits_do_not_depend_on_the_blocks(spark):
    ledger = ledger_frame(spark, n=150, horizon=5, seed=6).filter("event_id = 'fast_repair_5d'")
    ids = [{r.prediction_position: r.model_artifact_id for r in Mo.out_of_fold_scores(ledger, replace(SMALL, block=b)).collect()} for b in (7, 64)]
    assert ids[0] == ids[1] and len(ids[0]) > 20
