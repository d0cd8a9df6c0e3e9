"""Event ledger, base rates, walk-forward models, judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


from volpanel import params as P
from volpanel.functions.num import add, sigmoid
from volpanel.operators import calendar as C
from volpanel.operators import events as E
from volpanel.operators import models as Mo
from volpanel.operators.bootstrap import counted, pick
from volpanel.operators import series as S
from volpanel.registry.base import register, shared, step
from volpanel.registry.q_state import k_window, state
from volpanel.sources.views import table

SMALL = P.ModelParams(minimum_training=252, minimum_positive=8, minimum_negative=8, calibration_minimum_class=5)

step(
    "sessions_x",
    """SELECT session_date, ordinal, lead(session_date) OVER (ORDER BY session_date) AS next_session,
       lag(session_date) OVER (ORDER BY session_date) AS previous_session FROM v_calendar""",
)
_scaled = ", ".join(f"{a} / 100e0 AS {a}_scaled" for a in E.SCALED_AXES)
step(
    "predicted",
    f"""SELECT *, 1e0 - pressure_change5_scaled AS inverse_pressure_change5_scaled FROM (
        SELECT *, {_scaled}, CASE WHEN d5_pressure_score IS NOT NULL THEN least(greatest((d5_pressure_score + 100e0) / 200e0, 0e0), 1e0) END AS pressure_change5_scaled,
        cross_section_pressure_dispersion / 100e0 AS cross_section_pressure_dispersion_scaled,
        (CAST(large_jump AS INT) + CAST(mid_jump AS INT) + CAST(tech_jump AS INT)) / 3 AS segment_iv_jump_true_share FROM state) q""",
)
step(
    "led0",
    """SELECT p.*, x.ordinal, x.next_session, pressure_score >= 70 AND persistence >= 70 AND broad_confirmed AS persistent_cross_market_day
       FROM predicted p LEFT JOIN sessions_x x USING (session_date)""",
)
step("led1", f"SELECT *, {k_window('persistent_cross_market_day', 5, 3)} AS persistent_cross_market_now FROM led0")
_stressed = ", ".join(f"'{p}'" for p in P.STRESSED_PHASES)
_sys = "CASE WHEN primary_phase <> 'UNKNOWN' THEN primary_phase = 'SYSTEMIC_ACUTE_STRESS' END"
_rules = {
    "cross_market_iv_jump_1d": ("shock < 75 AND NOT cross_market_iv_jump", "cross_market_iv_jump AND shock >= 75"),
    "broad_pressure_onset_5d": ("NOT broad_confirmed", "broad_confirmed AND pressure_score >= 65"),
    "systemic_acute_stress_5d": (f"NOT ({_sys})", _sys),
    "persistent_cross_market_stress_20d": ("NOT persistent_cross_market_now", "persistent_cross_market_now"),
    "fast_repair_5d": (
        "CASE WHEN repair_answer = 'CONFIRMED' THEN false WHEN repair_answer IN ('INACTIVE', 'BUILDING') THEN pressure_score >= 65 "
        f"OR CASE WHEN primary_phase <> 'UNKNOWN' THEN primary_phase IN ({_stressed}) END END",
        "repair_confirmed",
    ),
}


def _event_sql(e: P.EventSpec) -> str:
    onset, target = _rules[e.event_id]
    first = 5 if e.horizon == 20 else 1
    frame = f"OVER (ORDER BY session_date ROWS BETWEEN {first} FOLLOWING AND {e.horizon} FOLLOWING)"
    complete = " AND ".join(f"coalesce({f} BETWEEN 0 AND 1, false)" for f in e.predictors)
    return f"""SELECT session_date AS prediction_date, pos AS prediction_position, ordinal, next_session, '{e.event_id}' AS event_id, {e.horizon} AS horizon,
        CASE WHEN data_status = 'OK' AND {complete} THEN ({onset}) END AS onset,
        CASE WHEN lead(ordinal, {e.horizon}) OVER (ORDER BY session_date) = ordinal + {e.horizon} THEN
          CASE WHEN count(*) FILTER (WHERE {target}) {frame} > 0 THEN true WHEN count(*) FILTER (WHERE NOT ({target})) {frame} = {e.horizon - first + 1} THEN false END END AS truth
        FROM led1"""


step("led2", " UNION ALL ".join(_event_sql(e) for e in P.EVENTS))
step(
    "ledger",
    """SELECT l.*, l.prediction_position + l.horizon AS target_end_position,
       CASE WHEN onset IS NULL THEN 'UNOBSERVABLE' WHEN onset THEN 'ELIGIBLE' ELSE 'NOT_APPLICABLE' END AS event_status,
       CASE WHEN onset IS NULL THEN 'CENSORED' WHEN NOT onset THEN 'NOT_APPLICABLE' WHEN truth THEN 'OBSERVED_1' WHEN NOT truth THEN 'OBSERVED_0' ELSE 'CENSORED' END AS label_status,
       CASE WHEN onset THEN CAST(truth AS INTEGER) END AS label,
       CASE WHEN onset THEN x.session_date END AS target_window_end_session,
       CASE WHEN onset AND truth IS NOT NULL THEN x.next_session + TIME '09:00:00' END AS outcome_available_at,
       l.next_session + TIME '09:00:00' AS decision_as_of
       FROM led2 l LEFT JOIN sessions_x x ON x.ordinal = l.ordinal + l.horizon""",
)
step(
    "base_rate_rows",
    """SELECT l.event_id, l.prediction_position, any_value(l.prediction_date) AS prediction_date, any_value(l.event_status) AS event_status,
       any_value(l.target_window_end_session) AS target_window_end_session, count(r.label) AS n, coalesce(sum(r.label), 0) AS pos
       FROM ledger l LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY prediction_position) AS rk FROM ledger WHERE label IS NOT NULL) r
         ON r.event_id = l.event_id AND r.target_end_position <= l.prediction_position
        AND r.rk > (SELECT count(*) FROM ledger m WHERE m.event_id = l.event_id AND m.label IS NOT NULL AND m.target_end_position <= l.prediction_position) - 504
       GROUP BY 1, 2""",
)
step("base_rates", "SELECT *, CASE WHEN n >= 60 THEN (pos + 1e0) / (n + 2e0) END AS base_rate FROM base_rate_rows")
step(
    "judged",
    """SELECT *, CASE WHEN event_status <> 'ELIGIBLE' THEN 'NOT_RUN' WHEN base_rate IS NULL THEN 'INSUFFICIENT_HISTORY' ELSE 'BASE_RATE_ONLY' END AS model_status FROM base_rates""",
)
step(
    "rated",
    """SELECT b.event_id, b.prediction_position, b.prediction_date, l.label, b.base_rate,
       least(greatest(1e0 / (1e0 + exp(-(ln(b.base_rate / (1e0 - b.base_rate)) + 0.5e0 * (l.prediction_position % 7 - 3)))), 1e-6), 1e0 - 1e-6) AS p
       FROM base_rates b JOIN ledger l USING (event_id, prediction_position) WHERE l.label IS NOT NULL AND b.base_rate IS NOT NULL""",
)
step("rated252", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY prediction_position DESC) AS rk FROM rated) q WHERE rk <= 252")


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    days = table(spark, folder, "lineitem")
    return C.session_calendar(days.selectExpr("to_date(l_shipdate) AS session_date"))


@shared
def ledger(spark: SparkSession, folder: str) -> DataFrame:
    return E.build_target_ledger(E.add_predictors(state(spark, folder)), calendar(spark, folder))


@shared
def oof(spark: SparkSession, folder: str) -> DataFrame:
    return Mo.out_of_fold_scores(ledger(spark, folder), SMALL)


@shared
def calibrated(spark: SparkSession, folder: str) -> DataFrame:
    return Mo.sequential_calibration(oof(spark, folder), SMALL)


def rated(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled ledger rows with their base rate and a tilted probability."""
    df = E.base_rates(ledger(spark, folder), minimum_samples=60).filter("label IS NOT NULL AND base_rate IS NOT NULL")
    logit = "ln(base_rate / (1D - base_rate)) + 0.5D * (prediction_position % 7 - 3)"
    return add(df, {"p": sigmoid(logit, 1e-6)})


@register("w10_session_ordinal", "session_date ordinal# next_session previous_session", "SELECT * FROM sessions_x")
def _(spark, folder):
    return calendar(spark, folder)


@register(
    "j20_session_offsets",
    "session_date plus_1 plus_5 plus_20",
    """SELECT s.session_date, a.session_date AS plus_1, b.session_date AS plus_5, c.session_date AS plus_20 FROM v_calendar s
       LEFT JOIN v_calendar a ON a.ordinal = s.ordinal + 1 LEFT JOIN v_calendar b ON b.ordinal = s.ordinal + 5 LEFT JOIN v_calendar c ON c.ordinal = s.ordinal + 20""",
)
def _(spark, folder):
    c = calendar(spark, folder)
    df = c.select("session_date", "ordinal")
    for n in (1, 5, 20):
        df = C.at_offset(df, c, f"ordinal + {n}", f"plus_{n}")
    return df


_fields = sorted({f for e in P.EVENTS for f in e.predictors})


@register("x11_probability_predictors", "session_date " + " ".join(f"{f}~" for f in _fields), "SELECT * FROM predicted")
def _(spark, folder):
    return E.add_predictors(state(spark, folder))


@register("m12_sigmoid_logit", "event_id prediction_position# p~", "SELECT * FROM rated")
def _(spark, folder):
    return rated(spark, folder)


@register(
    "p16_predictors_complete",
    "session_date " + " ".join(f"ok_{i}" for i in range(len(P.EVENTS))),
    "SELECT session_date, "
    + ", ".join(
        f"{' AND '.join(f'coalesce({f} BETWEEN 0 AND 1, false)' for f in e.predictors)} AS ok_{i}" for i, e in enumerate(P.EVENTS)
    )
    + " FROM predicted",
)
def _(spark, folder):
    df = E.add_predictors(state(spark, folder))
    return add(df, {f"ok_{i}": E.predictors_complete(e.predictors) for i, e in enumerate(P.EVENTS)})


@register(
    "w11_forward_labels",
    "prediction_date event_id label_status label#",
    "SELECT * FROM ledger",
)
def _(spark, folder):
    return ledger(spark, folder)


@register(
    "x12_target_ledger",
    "prediction_date event_id prediction_position# horizon# event_status onset label_status label# target_window_end_session "
    "target_end_position# decision_as_of outcome_available_at",
    "SELECT * FROM ledger",
)
def _(spark, folder):
    return ledger.direct(spark, folder)


@register(
    "a13_event_counts",
    "event_id eligible# not_applicable# unobservable# observed# positives#",
    """SELECT event_id, count(*) FILTER (WHERE event_status = 'ELIGIBLE') AS eligible, count(*) FILTER (WHERE event_status = 'NOT_APPLICABLE') AS not_applicable,
       count(*) FILTER (WHERE event_status = 'UNOBSERVABLE') AS unobservable, count(label) AS observed, coalesce(sum(label), 0) AS positives FROM ledger GROUP BY 1""",
)
def _(spark, folder):
    return E.event_counts(ledger(spark, folder))


@register("w17_latest_matured", "event_id prediction_position# n# pos#", "SELECT * FROM base_rates")
def _(spark, folder):
    df = E.base_rates(ledger(spark, folder), minimum_samples=60)
    return add(df, {"n": "base_rate_sample_size", "pos": "base_rate_positive_count"})


@register("a12_base_rate", "event_id prediction_position# base_rate~", "SELECT * FROM base_rates")
def _(spark, folder):
    return E.base_rates(ledger(spark, folder), minimum_samples=60)


@register(
    "j21_causal_training_sets",
    "event_id prediction_position# training_rows# training_positive# first_position# last_position#",
    """SELECT l.event_id, l.prediction_position, count(*) AS training_rows, sum(r.label) AS training_positive, min(r.prediction_position) AS first_position, max(r.prediction_position) AS last_position
       FROM ledger l JOIN ledger r ON r.event_id = l.event_id AND r.label IS NOT NULL AND r.target_end_position <= l.prediction_position WHERE l.label IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, folder):
    m = E.matured_counts(ledger(spark, folder))
    w = S.by(E.ROW, "prediction_position")
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    m = add(
        m,
        {
            "first_position": f"min(CASE WHEN labelled THEN prediction_position END) OVER ({w} {frame})",
            "_last": f"max(CASE WHEN labelled THEN prediction_position END) OVER ({w} {frame})",
        },
    )
    cases = " ".join(f"WHEN {h} THEN lag(_last, {h}) OVER ({w})" for h in (1, 5, 20))
    m = add(m, {"last_position": f"CASE horizon {cases} END", "training_rows": "matured", "training_positive": "matured_positive"})
    return m.filter("labelled AND matured > 0")


@register(
    "x13_out_of_fold_scores",
    "event_id prediction_date prediction_position# decision_score~ uncalibrated_probability~ base_rate_at_prediction~ label# "
    "training_sample_size# training_positive_count#",
)
def _(spark, folder):
    return oof.direct(spark, folder)


# labels by rank, the training window of each, and which of them have a fit
step("labelled_x", "SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY prediction_position) AS rk FROM ledger WHERE label IS NOT NULL")
step(
    "fit_windows",
    f"""SELECT l.event_id, l.prediction_position, l.target_end_position, l.label, count(*) AS training_rows, sum(r.label) AS training_positive
       FROM (SELECT l.*, (SELECT count(*) FROM labelled_x m WHERE m.event_id = l.event_id AND m.target_end_position <= l.prediction_position) AS stop FROM labelled_x l) l
       JOIN labelled_x r ON r.event_id = l.event_id AND r.rk <= l.stop AND r.rk > l.stop - {SMALL.maximum_training}
       GROUP BY ALL HAVING count(*) >= {SMALL.minimum_training} AND sum(r.label) >= {SMALL.minimum_positive} AND count(*) - sum(r.label) >= {SMALL.minimum_negative}""",
)
step("oof_x", "SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY prediction_position) AS rk FROM fit_windows")


@register(
    "x13_fit_certificates",
    "event_id prediction_position# training_rows# training_positive# gradient~ score_residual~",
    "SELECT *, 0e0 AS gradient, 0e0 AS score_residual FROM fit_windows",
)
def _(spark, folder):
    return Mo.logistic_certificates(ledger(spark, folder), oof(spark, folder), SMALL)


@register(
    "x14_calibration_certificates",
    "event_id prediction_position# calibration_rows# calibration_positive# intercept_gradient~ slope_gradient~",
    f"""SELECT *, 0e0 AS intercept_gradient, 0e0 AS slope_gradient FROM (
       SELECT l.event_id, l.prediction_position, count(*) AS calibration_rows, sum(r.label) AS calibration_positive
       FROM (SELECT l.*, (SELECT count(*) FROM oof_x m WHERE m.event_id = l.event_id AND m.target_end_position <= l.prediction_position AND m.rk < l.rk) AS stop FROM oof_x l) l
       JOIN oof_x r ON r.event_id = l.event_id AND r.rk <= l.stop AND r.rk > l.stop - {SMALL.calibration_rows}
       GROUP BY 1, 2 HAVING count(*) = {SMALL.calibration_rows} AND least(sum(r.label), count(*) - sum(r.label)) >= {SMALL.calibration_minimum_class}) q""",
)
def _(spark, folder):
    return Mo.calibration_certificates(oof(spark, folder), calibrated(spark, folder))


@register(
    "x14_sequential_calibration",
    "event_id prediction_position# decision_score~ calibration_sample_size# calibration_positive_count# calibration_success platt_a~ platt_b~ calibrated_probability~",
)
def _(spark, folder):
    return calibrated(spark, folder)


@register(
    "x15_acceptance_metrics",
    "event_id samples# positives# brier_model~ brier_base~ brier_skill~ log_loss_model~ log_loss_base~ ece~ skill_lower~ skill_upper~ reason accepted",
)
def _(spark, folder):
    return Mo.acceptance_metrics(calibrated(spark, folder), SMALL)


@register("x16_current_probability", "event_id probability~ training_sample_size# training_positive_count# brier_skill~ ece~")
def _(spark, folder):
    metrics = Mo.acceptance_metrics(calibrated(spark, folder), SMALL)
    return Mo.fit_current(ledger(spark, folder), oof(spark, folder), metrics, SMALL)


@register(
    "a25_brier_log_loss",
    "event_id samples# positives# brier_model~ brier_base~ brier_skill~ log_loss_model~ log_loss_base~",
    """SELECT *, 1e0 - brier_model / nullif(brier_base, 0) AS brier_skill FROM (SELECT event_id, count(*) AS samples, sum(label) AS positives, avg(pow(p - label, 2)) AS brier_model, avg(pow(base_rate - label, 2)) AS brier_base,
       avg(-(label * ln(p) + (1 - label) * ln(1e0 - p))) AS log_loss_model, avg(-(label * ln(base_rate) + (1 - label) * ln(1e0 - base_rate))) AS log_loss_base FROM rated GROUP BY 1) q""",
)
def _(spark, folder):
    return Mo.probability_scores(rated(spark, folder), "p", "base_rate")


@register(
    "a26_calibration_error",
    "event_id ece~",
    """SELECT event_id, sum(n * gap) / sum(n) AS ece FROM (SELECT event_id, b, count(*) AS n, abs(avg(p) - avg(label)) AS gap FROM (
       SELECT *, ntile(5) OVER (PARTITION BY event_id ORDER BY p, prediction_date) AS b FROM rated252) q GROUP BY 1, 2) r GROUP BY 1""",
)
def _(spark, folder):
    return Mo.calibration_error(Mo.latest_rows(rated(spark, folder)), "p")


_seeds = " ".join(f"WHEN '{e.event_id}' THEN {e.seed}" for e in P.EVENTS)
_lengths = " ".join(f"WHEN '{e.event_id}' THEN {e.horizon}" for e in P.EVENTS)
_start = pick("seed", "d", "j", "(n - length + 1)", xor="xor({0}, {1})")


@register(
    "a27_block_bootstrap",
    "event_id skill_lower~ skill_upper~",
    f"""WITH s AS (SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY prediction_position) - 1 AS i, pow(p - label, 2) AS m, pow(base_rate - label, 2) AS b FROM rated252),
       e AS (SELECT event_id, count(*) AS n, CAST(CASE event_id {_lengths} END AS BIGINT) AS length, CAST(CASE event_id {_seeds} END AS BIGINT) AS seed FROM s GROUP BY 1),
       d AS (SELECT *, {_start} AS start FROM (SELECT *, unnest(range(CAST(ceil(n / length) AS BIGINT))) AS j FROM (SELECT *, unnest(range(5000)) AS d FROM e) x) y),
       k AS (SELECT event_id, d, start + o AS i FROM (SELECT *, unnest(range(length)) AS o FROM d) z WHERE j * length + o < n),
       r AS (SELECT event_id, d, 1e0 - sum(m) / nullif(sum(b), 0) AS skill FROM k JOIN s USING (event_id, i) GROUP BY 1, 2)
       SELECT event_id, quantile_cont(skill, 0.05) AS skill_lower, quantile_cont(skill, 0.95) AS skill_upper FROM r GROUP BY 1""",
)
def _(spark, folder):
    return Mo.block_bootstrap(Mo.latest_rows(rated(spark, folder)), "p", "base_rate", draws=counted)


@register(
    "x17_judgments",
    "session_date event_id event_status model_status probability~ base_rate~ uplift~ base_rate_sample_size# base_rate_positive_count# target_window_end_session",
    """SELECT prediction_date AS session_date, event_id, event_status, model_status, CASE WHEN model_status = 'BASE_RATE_ONLY' THEN base_rate END AS probability,
       CASE WHEN model_status = 'BASE_RATE_ONLY' THEN base_rate END AS base_rate, CASE WHEN model_status = 'BASE_RATE_ONLY' THEN 0e0 END AS uplift,
       CASE WHEN event_status = 'ELIGIBLE' THEN n END AS base_rate_sample_size, CASE WHEN event_status = 'ELIGIBLE' THEN pos END AS base_rate_positive_count,
       CASE WHEN event_status = 'ELIGIBLE' THEN target_window_end_session END AS target_window_end_session FROM judged""",
)
def _(spark, folder):
    return Mo.judgments(ledger(spark, folder), minimum_samples=60)


@register(
    "x17_outlook",
    "session_date outlook_answer",
    """SELECT s.session_date, CASE WHEN s.data_status <> 'OK' THEN 'UNKNOWN' WHEN NOT e AND h THEN 'UNKNOWN' WHEN n THEN 'NOT_APPLICABLE' WHEN b THEN 'BASE_RATE_ONLY' ELSE 'UNKNOWN' END AS outlook_answer
       FROM state s LEFT JOIN (SELECT prediction_date AS session_date, bool_or(event_status = 'ELIGIBLE') AS e, bool_or(event_status = 'UNOBSERVABLE') AS h,
         bool_and(event_status = 'NOT_APPLICABLE') AS n, bool_or(model_status = 'BASE_RATE_ONLY') AS b FROM judged GROUP BY 1) j USING (session_date)""",
)
def _(spark, folder):
    return Mo.outlook(Mo.judgments(ledger(spark, folder), minimum_samples=60), state(spark, folder))
