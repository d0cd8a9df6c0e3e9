import datetime as dt

import numpy as np
import pandas as pd
import pytest

from volpanel import params as P
from volpanel.operators import calendar as C
from volpanel.operators import events as E
from volpanel.operators import models as Mo

SMALL = P.ModelParams(minimum_training=60, maximum_training=100, minimum_positive=5, minimum_negative=5, base_rate_rows=80,
                      calibration_rows=50, calibration_minimum_class=5, block=16)


def state_frame(spark, drop=(11,), n=35):
    days = list(pd.bdate_range("2026-01-05", periods=n).date)
    fields = {f for e in P.EVENTS for f in e.predictors}
    rows = []
    for i, d in enumerate(days):
        if i in drop:
            continue
        row = {f: 0.5 for f in fields}
        row |= {"universe_id": "u", "session_date": d, "data_status": "OK", "primary_phase": "BALANCED_MARKET", "shock": 50.0, "persistence": 50.0,
                "pressure_score": 50.0, "broad_confirmed": False, "cross_market_iv_jump": False, "repair_confirmed": False, "repair_answer": "INACTIVE"}
        rows.append(row)
    calendar = C.session_calendar(spark.createDataFrame([(d,) for d in days], "session_date date"))
    return days, spark.createDataFrame(pd.DataFrame(rows)), calendar


def test_missing_session_censors_the_label(spark):
    days, state, calendar = state_frame(spark)
    ledger = E.build_target_ledger(state, calendar).filter("event_id = 'cross_market_iv_jump_1d'").toPandas().set_index("prediction_date")
    assert ledger.loc[days[10], "event_status"] == "ELIGIBLE" and ledger.loc[days[10], "label_status"] == "CENSORED"
    assert pd.isna(ledger.loc[days[10], "label"])
    assert ledger.loc[days[9], "label_status"] == "OBSERVED_0"
    assert ledger.loc[days[34], "label_status"] == "CENSORED"
    assert ledger.loc[days[9], "outcome_available_at"] == pd.Timestamp(f"{days[11]} 09:00:00")


def test_forward_as_of_and_age(spark):
    days = [dt.date(2023, 6, 2), dt.date(2023, 6, 5), dt.date(2023, 6, 6)]
    cal = C.session_calendar(spark.createDataFrame([(d,) for d in days], "session_date date"))
    first = {r.day: r.first_session for r in C.first_session_from(cal).collect()}
    assert first[dt.date(2023, 6, 3)] == days[1] and first[days[1]] == days[1]
    rows = spark.createDataFrame([(d, dt.date(2023, 6, 3)) for d in days], "session_date date, listing date")
    ages = {r.session_date: r.listing_age_sessions for r in C.listing_age(rows, cal, "listing").collect()}
    assert ages == {days[0]: None, days[1]: 1, days[2]: 2}
    rows = spark.createDataFrame([(d, dt.date(2019, 1, 2)) for d in days], "session_date date, listing date")
    ages = {r.session_date: r.listing_age_sessions for r in C.listing_age(rows, cal, "listing").collect()}
    assert ages == {days[0]: 1, days[1]: 2, days[2]: 3}  # years before the calendar: its first session counts as the listing


def ledger_frame(spark, n=254, every=4, horizon=1, seed=None):
    rng = np.random.default_rng(seed)
    rows = []
    for e in P.EVENTS:
        for p in range(n):
            x = [float(v) for v in (rng.random(6) if seed is not None else [0.5] * 6)]
            label = int(p % every == 0) if seed is None else int(rng.random() < 1 / (1 + np.exp(-(3 * x[0] - 2))))
            rows.append(("u", dt.date(2020, 1, 1) + dt.timedelta(days=p), p, e.event_id, horizon, "ELIGIBLE", p + horizon,
                         f"OBSERVED_{label}", label, dt.date(2020, 1, 1) + dt.timedelta(days=p + horizon), x))
    return spark.createDataFrame(
        rows, "universe_id string, prediction_date date, prediction_position long, event_id string, horizon int, event_status string, "
        "target_end_position long, label_status string, label int, target_window_end_session date, predictors array<double>")


def test_base_rate(spark):
    r = E.base_rates(ledger_frame(spark)).filter("prediction_position = 252 AND event_id = 'cross_market_iv_jump_1d'").first()
    assert (r.base_rate_sample_size, r.base_rate_positive_count) == (252, 63)
    assert r.base_rate == pytest.approx((63 + 1) / (252 + 2))
    j = Mo.judgments(ledger_frame(spark)).filter("prediction_position = 252").toPandas()
    assert set(j.model_status) == {"BASE_RATE_ONLY"} and set(j.probability_kind) == {"HISTORICAL_REFERENCE"}


def test_window_of_latest_labels(spark):
    r = E.base_rates(ledger_frame(spark), minimum_samples=10, maximum_samples=30).filter("event_id = 'fast_repair_5d'").toPandas().set_index("prediction_position")
    for p in (5, 30, 31, 100, 253):
        past = [int(i % 4 == 0) for i in range(p)][-30:]
        assert (r.loc[p, "base_rate_sample_size"], r.loc[p, "base_rate_positive_count"]) == (len(past), sum(past))


def test_logistic_optimum():
    rng = np.random.default_rng(0)
    x, y = rng.random((200, 3)), (rng.random(200) < 0.4).astype(float)
    b = Mo.fit_logistic(x, y, 1.0)
    design = np.column_stack([x, np.ones(200)])
    gradient = design.T @ (1 / (1 + np.exp(-design @ b)) - y) + np.r_[b[:-1], 0]
    assert np.abs(gradient).max() < 1e-8


def test_platt_slope_never_negative():
    rng = np.random.default_rng(1)
    z = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.5 * z - 0.3)))).astype(float)
    a, b = Mo.fit_platt(z, y)
    p = 1 / (1 + np.exp(-(a * z + b)))
    assert a > 0 and abs(np.mean((p - y) * z) + 2e-6 * a) < 1e-8 and abs(np.mean(p - y) + 2e-6 * b) < 1e-8
    assert Mo.fit_platt(z, 1 - y)[0] == 0.0


def test_walk_forward_equals_a_plain_loop(spark):
    ledger = ledger_frame(spark, n=180, horizon=5, seed=5).filter("event_id = 'fast_repair_5d'")
    rows = ledger.orderBy("prediction_position").collect()
    x = np.array([r.predictors for r in rows])
    y = np.array([r.label for r in rows], dtype=float)
    expected = {}
    for t in range(180):
        stop = t - 5 + 1
        start = max(0, stop - SMALL.maximum_training)
        n = stop - start
        if n < 60 or min(y[start:stop].sum(), n - y[start:stop].sum()) < 5:
            continue
        b = Mo.fit_logistic(x[start:stop], y[start:stop], 1.0)
        recent = y[max(start, stop - 80) : stop]
        expected[t] = (x[t] @ b[:-1] + b[-1], (recent.sum() + 1) / (len(recent) + 2), n)
    oof = Mo.out_of_fold_scores(ledger, SMALL)
    got = {r.prediction_position: r for r in oof.collect()}
    assert set(got) == set(expected)
    for t, (score, base, n) in expected.items():
        assert got[t].decision_score == pytest.approx(score, abs=1e-8)
        assert got[t].base_rate_at_prediction == pytest.approx(base) and got[t].training_sample_size == n

    calibrated = {r.prediction_position: r for r in Mo.sequential_calibration(oof, SMALL).collect()}
    order = sorted(expected)
    for t in order:
        prior = [q for q in order if q < t and q + 5 <= t][-50:]
        row = calibrated[t]
        assert row.calibration_sample_size == len(prior)
        hits = int(y[prior].sum())
        if len(prior) == 50 and min(hits, 50 - hits) >= 5:
            a, b = Mo.fit_platt(np.array([expected[q][0] for q in prior]), y[prior])
            assert row.platt_a == pytest.approx(a, abs=1e-6)
            assert row.calibrated_probability == pytest.approx(1 / (1 + np.exp(-(a * expected[t][0] + b))), abs=1e-6)
        else:
            assert not row.calibration_success and row.calibrated_probability is None

    metrics = Mo.acceptance_metrics(Mo.sequential_calibration(oof, SMALL), SMALL).toPandas().set_index("event_id")
    assert metrics.loc["cross_market_iv_jump_1d", "reason"] == "INSUFFICIENT_CALIBRATED_OOF" and not metrics.loc["cross_market_iv_jump_1d", "accepted"]
    forced = Mo.acceptance_metrics(Mo.sequential_calibration(oof, SMALL), SMALL).filter("event_id = 'fast_repair_5d'").selectExpr("universe_id", "event_id", "true AS accepted", "brier_skill", "ece")
    now = Mo.fit_current(ledger, oof, forced, SMALL).first()
    stop = 179 - 5 + 1
    b = Mo.fit_logistic(x[stop - 100 : stop], y[stop - 100 : stop], 1.0)
    prior = [q for q in order if q < 179 and q + 5 <= 179][-50:]
    a, c = Mo.fit_platt(np.array([expected[q][0] for q in prior]), y[prior])
    assert now.probability == pytest.approx(1 / (1 + np.exp(-(a * (x[179] @ b[:-1] + b[-1]) + c))), abs=1e-6)


def test_bootstrap_follows_the_seeded_draws(spark):
    rng = np.random.default_rng(9)
    y = (rng.random(252) < 0.3).astype(int)
    p, base = np.clip(0.3 + 0.3 * (y - 0.3) + rng.normal(0, 0.1, 252), 0.01, 0.99), np.full(252, 0.3)
    event = P.EVENTS[1]
    rows = [("u", event.event_id, i, int(y[i]), float(p[i]), 0.3) for i in range(252)]
    df = spark.createDataFrame(rows, "universe_id string, event_id string, prediction_position int, label int, p double, b double")
    got = Mo.block_bootstrap(df, "p", "b", replicates=40).first()
    generator, starts, skills = np.random.default_rng(event.seed), np.arange(252 - event.horizon + 1), []
    for _ in range(40):
        picked = []
        while len(picked) < 252:
            s = int(generator.choice(starts))
            picked.extend(range(s, s + event.horizon))
        i = np.array(picked[:252])
        skills.append(1 - np.mean((p[i] - y[i]) ** 2) / np.mean((base[i] - y[i]) ** 2))
    assert (got.skill_lower, got.skill_upper) == pytest.approx(tuple(np.quantile(skills, [0.05, 0.95])))


def test_outlook_prefers_the_largest_uplift(spark):
    rows = [("u", dt.date(2024, 1, 2), e.event_id, "ELIGIBLE", "CALIBRATED_MODEL", 0.05 * i) for i, e in enumerate(P.EVENTS)]
    judged = spark.createDataFrame(rows, "universe_id string, session_date date, event_id string, event_status string, model_status string, uplift double")
    state = spark.createDataFrame([("u", dt.date(2024, 1, 2), "OK")], "universe_id string, session_date date, data_status string")
    assert Mo.outlook(judged, state).first().outlook_answer == "fast_repair_5d"
    weak = judged.withColumn("uplift", judged.uplift / 10)
    assert Mo.outlook(weak, state).first().outlook_answer == "NO_STRONG_EDGE"
