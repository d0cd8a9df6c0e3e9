"""Signals, condor selection, sizing, opportunity, stress and state-exit panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel import params as P
from volpanel.functions.num import add
from volpanel.operators import condor as Co
from volpanel.operators import timing as Ti
from volpanel.operators.bootstrap import counted, pick
from volpanel.registry.base import register, shared, step
from volpanel.registry.q_events import calendar
from volpanel.registry.q_series import feature_history
from volpanel.registry.q_state import scored, state
from volpanel.registry.q_surface import duck_cdf
from volpanel.sources.views import view

_units = " ".join(f"WHEN '{p}' THEN {u!r}e0" for p, u in P.PHASE_UNITS.items())
_near = "(coalesce(index_pressure, 0) >= 70 OR coalesce(shock, 0) >= 65 OR coalesce(down_tail, 0) >= 75 OR coalesce(persistence, 0) >= 75)"
_market = "(coalesce(direction, 'UNKNOWN') = 'RISING' OR coalesce(pressure_score, 0) >= 70)"
step(
    "sig0",
    """SELECT s.*, st.session_date AS signal_session_date, st.data_status AS global_status, st.primary_phase AS phase, st.pressure_level, st.direction, st.pressure_score, st.hard_acute,
         f.insurance_compensation, f.vrp_ewma94, ix.data_status AS local_status, ix.index_pressure, ix.shock, ix.down_tail, ix.persistence
       FROM v_spot s
       LEFT JOIN (SELECT x.next_session AS d, t.* FROM state t JOIN sessions_x x USING (session_date)) st ON st.d = s.session_date
       LEFT JOIN (SELECT x.next_session AS d, t.* FROM scored t JOIN sessions_x x USING (session_date)) ix ON ix.d = s.session_date AND ix.economic_index_id = s.economic_index_id
       LEFT JOIN (SELECT x.next_session AS d, t.* FROM features t JOIN sessions_x x USING (session_date)) f ON f.d = s.session_date AND f.economic_index_id = s.economic_index_id""",
)
step("sig1", f"SELECT *, CASE phase {_units} ELSE 0e0 END AS unit0, row_number() OVER (PARTITION BY economic_index_id ORDER BY session_date) AS rn FROM sig0")
step(
    "sig2",
    f"""SELECT *, CASE WHEN coalesce(global_status, 'UNKNOWN') <> 'OK' THEN 'GLOBAL_NOT_OK' WHEN unit0 <= 0 THEN 'PHASE_' || coalesce(phase, 'UNKNOWN')
         WHEN coalesce(local_status, 'UNKNOWN') <> 'OK' THEN economic_index_id || '_NOT_OK' WHEN insurance_compensation IN ('THIN', 'UNKNOWN') THEN 'COMPENSATION_' || insurance_compensation
         WHEN vrp_ewma94 IS NULL OR vrp_ewma94 <= 0 THEN 'VRP_NOT_POSITIVE'
         WHEN coalesce(hard_acute, false) OR coalesce(pressure_score, 0) >= 85 OR coalesce(index_pressure, 0) >= 85 OR coalesce(shock, 0) >= 85 OR coalesce(down_tail, 0) >= 85 OR coalesce(persistence, 0) >= 85 THEN 'ACUTE_CAP_ZERO' END AS stop,
         CASE WHEN insurance_compensation = 'NORMAL' THEN 1 ELSE 0 END AS c1, CASE WHEN {_market} THEN 1 ELSE 0 END AS c2, CASE WHEN {_near} THEN 1 ELSE 0 END AS c3 FROM sig1""",
)
step(
    "sig3",
    """SELECT *, CASE WHEN stop IS NOT NULL THEN 0e0 ELSE least(unit0, CASE WHEN c1 = 1 THEN 0.5e0 ELSE 1e0 END, CASE WHEN c2 = 1 OR c3 = 1 THEN 0.25e0 ELSE 1e0 END) END AS raw_dynamic_unit,
         coalesce(stop, 'PHASE_MAP' || CASE WHEN c1 = 1 THEN '+NORMAL_COMP_CAP' ELSE '' END || CASE WHEN c2 = 1 THEN '+GLOBAL_PRESSURE_CAP' ELSE '' END || CASE WHEN c3 = 1 THEN '+' || economic_index_id || '_PRESSURE_CAP' ELSE '' END) AS risk_reason FROM sig2""",
)
step(
    "unit_fold",
    """SELECT economic_index_id, CAST(0 AS BIGINT) AS rn, 0e0 AS level, 0e0 AS before FROM (SELECT DISTINCT economic_index_id FROM sig3) u UNION ALL
       SELECT s.economic_index_id, s.rn, CASE WHEN s.raw_dynamic_unit <= f.level OR f.before >= s.raw_dynamic_unit THEN s.raw_dynamic_unit ELSE f.level END, s.raw_dynamic_unit
       FROM unit_fold f JOIN sig3 s ON s.rn = f.rn + 1 AND s.economic_index_id = f.economic_index_id""",
    recursive=True,
)
step(
    "signals",
    """SELECT s.* REPLACE (coalesce(phase, 'UNKNOWN') AS phase, coalesce(global_status, 'UNKNOWN') AS global_status, coalesce(local_status, 'UNKNOWN') AS local_status),
       f.level AS dynamic_unit, lag(s.session_date) OVER (PARTITION BY economic_index_id ORDER BY s.session_date) AS previous,
       CASE WHEN NOT (coalesce(global_status, 'UNKNOWN') = 'OK' AND coalesce(local_status, 'UNKNOWN') = 'OK' AND coalesce(phase, 'UNKNOWN') <> 'UNKNOWN' AND coalesce(insurance_compensation, 'UNKNOWN') <> 'UNKNOWN' AND vrp_ewma94 IS NOT NULL)
            THEN 'ABSTAIN_DATA' WHEN f.level > 0 THEN 'ALLOW' ELSE 'KNOWN_BLOCK' END AS state_category
       FROM sig3 s JOIN unit_fold f USING (economic_index_id, rn)""",
)
step(
    "near0",
    """SELECT l.*, s.session_date, s.previous, s.spot_0935, date_diff('day', s.session_date, l.maturity_date) AS dte FROM v_listed l
       JOIN (SELECT *, lag(session_date) OVER (PARTITION BY economic_index_id ORDER BY session_date) AS previous FROM v_spot) s
         ON s.economic_index_id = l.economic_index_id AND s.session_date >= l.list_date AND date_diff('day', s.session_date, l.maturity_date) BETWEEN 25 AND 45""",
)
step(
    "near",
    """SELECT n.*, v.atm_iv / 100e0 AS sigma FROM near0 n JOIN (SELECT economic_index_id, session_date, arg_min(maturity_date, (abs(dte - 35), dte)) AS best FROM near0 GROUP BY 1, 2) b
         ON b.economic_index_id = n.economic_index_id AND b.session_date = n.session_date AND b.best = n.maturity_date
       LEFT JOIN v_expiry_iv v ON v.economic_index_id = n.economic_index_id AND v.session_date = n.previous AND v.expiry = n.maturity_date AND v.atm_iv / 100e0 BETWEEN 0.01 AND 3""",
)
step(
    "legs0",
    f"""SELECT *, CASE call_put WHEN 'C' THEN n1 ELSE n1 - 1e0 END AS delta, row_number() OVER (PARTITION BY economic_index_id, session_date, call_put ORDER BY exercise_price) AS up,
          row_number() OVER (PARTITION BY economic_index_id, session_date, call_put ORDER BY exercise_price DESC) AS down
        FROM (SELECT *, {duck_cdf('d1')} AS n1 FROM (SELECT *, (ln(spot_0935 / exercise_price) + 0.5e0 * sigma * sigma * (dte / 365.2425e0)) / (sigma * sqrt(dte / 365.2425e0)) AS d1 FROM near) a) b""",
)
step(
    "shorts",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY economic_index_id, session_date, call_put ORDER BY abs(abs(delta) - 0.2e0), exercise_price) AS pick FROM legs0
       WHERE abs(delta) BETWEEN 0.15 AND 0.25 AND ((call_put = 'C' AND exercise_price > spot_0935) OR (call_put = 'P' AND exercise_price < spot_0935))) q WHERE pick = 1""",
)
step(
    "picked",
    """SELECT s.economic_index_id, s.session_date, s.call_put, s.code, s.exercise_price AS strike, s.delta, w.code AS wing_code, w.exercise_price AS wing_strike, w.delta AS wing_delta
       FROM shorts s LEFT JOIN legs0 w ON w.economic_index_id = s.economic_index_id AND w.session_date = s.session_date AND w.call_put = s.call_put AND CASE s.call_put WHEN 'C' THEN w.up = s.up + 2 ELSE w.down = s.down + 2 END""",
)
step(
    "selection",
    """SELECT *, CASE WHEN previous IS NULL OR spot_0935 IS NULL THEN 'NO_LAGGED_SURFACE_OR_SPOT' WHEN active = 0 THEN 'NO_STANDARD_CONTRACT' WHEN expiry IS NULL THEN 'NO_25_45_DTE'
         WHEN sigma IS NULL THEN 'NO_PRIOR_EXPIRY_IV' WHEN short_call_code IS NULL OR short_put_code IS NULL THEN 'NO_15_25_DELTA_SHORT'
         WHEN long_call_code IS NULL OR long_put_code IS NULL THEN 'FEWER_THAN_TWO_WING_STRIKES' WHEN abs(net_delta) > 0.1 THEN 'NET_DELTA_GT_0_10' END AS reason
       FROM (SELECT d.economic_index_id, d.session_date, d.previous, d.spot_0935, (SELECT count(*) FROM v_listed l WHERE l.economic_index_id = d.economic_index_id AND d.session_date BETWEEN l.list_date AND l.maturity_date) AS active,
               n.expiry, n.dte, n.sigma, c.code AS short_call_code, c.strike AS short_call_strike, c.wing_code AS long_call_code, c.wing_strike AS long_call_strike,
               p.code AS short_put_code, p.strike AS short_put_strike, p.wing_code AS long_put_code, p.wing_strike AS long_put_strike,
               -c.delta + c.wing_delta - p.delta + p.wing_delta AS net_delta, c.delta AS short_call_delta, p.delta AS short_put_delta
             FROM (SELECT economic_index_id, session_date, spot_0935, lag(session_date) OVER (PARTITION BY economic_index_id ORDER BY session_date) AS previous FROM v_spot) d
             LEFT JOIN (SELECT economic_index_id, session_date, max(maturity_date) AS expiry, max(dte) AS dte, max(sigma) AS sigma FROM near GROUP BY 1, 2) n USING (economic_index_id, session_date)
             LEFT JOIN (SELECT * FROM picked WHERE call_put = 'C') c USING (economic_index_id, session_date) LEFT JOIN (SELECT * FROM picked WHERE call_put = 'P') p USING (economic_index_id, session_date)) q""",
)
step("condors", "SELECT * FROM selection WHERE reason IS NULL")
step(
    "windows_x",
    """SELECT session_date, code, 'OPEN_AM' AS fill_window, positive_minutes, volume, CASE WHEN volume % 29 = 0 THEN mark * 1.2e0 ELSE mark END AS vwap, mark * 1.02e0 AS high, mark * 0.98e0 AS low FROM v_marks""",
)
_legs_sql = " UNION ALL ".join(
    f"SELECT economic_index_id, session_date, {i} AS n, '{leg}' AS leg, {leg}_code AS code, {leg}_strike AS strike FROM condors" for i, leg in enumerate(P.LEGS)
)
step("leg_rows", _legs_sql)
step(
    "leg_checks",
    """SELECT l.*, w.vwap, w.high, w.low, w.volume, CASE WHEN w.code IS NULL THEN 'NO_BAR' WHEN w.positive_minutes < 2 OR w.volume < 20 THEN 'LIQUIDITY'
         WHEN w.vwap NOT BETWEEN w.low - 0.0001e0 AND w.high + 0.0001e0 THEN 'VWAP_RANGE' END AS issue
       FROM leg_rows l LEFT JOIN windows_x w USING (session_date, code)""",
)
step(
    "leg_gate",
    """SELECT economic_index_id, session_date, 'OPEN_AM_' || arg_min(leg || '_' || issue, n) FILTER (WHERE issue IS NOT NULL) AS leg_issue, CAST(min(floor(volume * 0.05e0)) AS BIGINT) AS capacity
       FROM leg_checks GROUP BY 1, 2""",
)
_scen = " UNION ALL ".join(
    [f"SELECT '{f}' AS fill_scenario, '{n}' AS fee_scenario, {c!r}e0 AS broker_fee, 0.08e0 AS risk_budget" for f in P.FILLS for n, c in P.FEES.items()]
    + [f"SELECT 'VWAP_2TICK', 'BROKER_PLUS_2', 2e0, {b!r}e0" for b in (0.05, 0.12)]
)
step("scenarios_x", _scen)


def _fill(buy: bool) -> str:
    s, x = ("+", "high") if buy else ("-", "low")
    return (
        f"CASE fill_scenario WHEN 'VWAP_2TICK' THEN greatest(0.0001e0, vwap {s} 0.0002e0) "
        f"WHEN 'VWAP_RANGE_25' THEN greatest(0.0001e0, vwap {s} greatest(0.0002e0, 0.25e0 * greatest(high - low, 0e0))) ELSE greatest(0.0001e0, {x}) END"
    )


step(
    "leg_fills",
    f"SELECT l.economic_index_id, l.session_date, l.leg, x.*, CASE WHEN l.leg LIKE 'long%' THEN {_fill(True)} ELSE {_fill(False)} END AS fill FROM leg_checks l, scenarios_x x",
)
step(
    "combo_fills",
    """SELECT f.economic_index_id, f.session_date, f.fill_scenario, f.fee_scenario, f.broker_fee, f.risk_budget, any_value(g.leg_issue) AS leg_issue, any_value(g.capacity) AS capacity,
         CASE WHEN any_value(g.leg_issue) IS NULL THEN 10000e0 * sum(CASE WHEN f.leg LIKE 'short%' THEN f.fill ELSE -f.fill END) END AS credit
       FROM leg_fills f JOIN leg_gate g USING (economic_index_id, session_date) GROUP BY ALL""",
)
step(
    "sized",
    """SELECT *, CASE WHEN leg_issue IS NULL THEN greatest(0, least(CAST(floor(1e6 * risk_budget * unit / max_loss) AS BIGINT), CAST(floor(1e6 * 0.35e0 / max_loss) AS BIGINT), capacity)) END AS quantity
       FROM (SELECT c.*, s.strategy, s.unit, CASE WHEN credit IS NOT NULL THEN greatest(greatest(short_put_strike - long_put_strike, long_call_strike - short_call_strike) * 10000e0 - credit, 1e0) END AS max_loss
             FROM combo_fills c JOIN condors k USING (economic_index_id, session_date)
             JOIN (SELECT economic_index_id, session_date, 'SV_STATIC' AS strategy, 0.5e0 AS unit FROM signals UNION ALL SELECT economic_index_id, session_date, 'SV_DYNAMIC', dynamic_unit FROM signals) s USING (economic_index_id, session_date) WHERE s.unit > 0) q""",
)
step("marks_x", "SELECT session_date, code, coalesce(settle, close) AS mark FROM v_marks WHERE coalesce(settle, close) >= 0")
step("sig_days", "SELECT *, row_number() OVER (PARTITION BY economic_index_id ORDER BY session_date) - 1 AS ordinal FROM signals")
step(
    "paths",
    """SELECT c.economic_index_id, c.session_date, c.expiry, c.short_put_strike, c.long_put_strike, c.short_call_strike, c.long_call_strike, e.ordinal AS o0, e.state_category, e.phase, e.dynamic_unit, p.session_date AS path_date, p.ordinal AS o, p.etf_mark AS path_spot, p.state_category AS path_category,
         sp.mark AS sp, lp.mark AS lp, sc.mark AS sc, lc.mark AS lc, 10000e0 * (sp.mark + sc.mark - lp.mark - lc.mark) AS combo
       FROM condors c JOIN sig_days e USING (economic_index_id, session_date) JOIN sig_days p ON p.economic_index_id = c.economic_index_id AND p.session_date BETWEEN c.session_date AND c.expiry
       LEFT JOIN marks_x sp ON sp.session_date = p.session_date AND sp.code = c.short_put_code LEFT JOIN marks_x lp ON lp.session_date = p.session_date AND lp.code = c.long_put_code
       LEFT JOIN marks_x sc ON sc.session_date = p.session_date AND sc.code = c.short_call_code LEFT JOIN marks_x lc ON lc.session_date = p.session_date AND lc.code = c.long_call_code""",
)
step(
    "exits_x",
    """SELECT c.economic_index_id, c.session_date, 'H5' AS horizon, e.ordinal + 5 AS xo FROM condors c JOIN sig_days e USING (economic_index_id, session_date)
       UNION ALL SELECT c.economic_index_id, c.session_date, 'H10', e.ordinal + 10 FROM condors c JOIN sig_days e USING (economic_index_id, session_date)
       UNION ALL SELECT c.economic_index_id, c.session_date, 'TO_7DTE', min(d.ordinal) FROM condors c JOIN sig_days d ON d.economic_index_id = c.economic_index_id AND d.session_date BETWEEN c.expiry - 7 AND c.expiry GROUP BY 1, 2""",
)
step(
    "opps0",
    """SELECT i.*, x.horizon, x.xo, u.path_date AS exit_date, u.combo AS exit_debit, i.combo AS entry_credit,
         greatest(i.short_put_strike - i.long_put_strike, i.long_call_strike - i.short_call_strike) * 10000e0 AS width,
         10000e0 * (i.sp - u.sp + u.lp - i.lp) AS put_side_pnl, 10000e0 * (i.sc - u.sc + u.lc - i.lc) AS call_side_pnl
       FROM paths i JOIN exits_x x USING (economic_index_id, session_date) JOIN paths u ON u.economic_index_id = i.economic_index_id AND u.session_date = i.session_date AND u.o = x.xo WHERE i.o = i.o0 AND i.combo IS NOT NULL AND u.combo IS NOT NULL""",
)
step(
    "opps",
    """SELECT o.economic_index_id, o.session_date, o.horizon, o.expiry, o.exit_date, o.state_category, o.phase, o.dynamic_unit AS risk_unit, o.entry_credit, o.width, o.exit_debit, o.put_side_pnl, o.call_side_pnl,
         greatest(o.width - o.entry_credit, 1e0) AS defined_max_loss, o.entry_credit - o.exit_debit AS pnl_per_combo, o.xo - o.o0 AS holding_sessions,
         (o.entry_credit - o.exit_debit) / greatest(o.width - o.entry_credit, 1e0) AS return_on_max_loss,
         CASE WHEN o.call_side_pnl < o.put_side_pnl THEN 'CALL' ELSE 'PUT' END AS loss_side,
         min((o.entry_credit - p.combo) / greatest(o.width - o.entry_credit, 1e0)) AS max_adverse_excursion, arg_min(p.path_date, (-p.combo, p.o)) FILTER (WHERE p.combo IS NOT NULL) AS mae_date,
         count(p.combo) / any_value(o.xo - o.o0 + 1) AS path_mark_coverage, min(p.path_spot) AS path_spot_min, max(p.path_spot) AS path_spot_max,
         coalesce(min(p.path_spot) < any_value(o.short_put_strike), false) AS put_short_breached, coalesce(max(p.path_spot) > any_value(o.short_call_strike), false) AS call_short_breached
       FROM opps0 o JOIN paths p ON p.economic_index_id = o.economic_index_id AND p.session_date = o.session_date AND p.o BETWEEN o.o0 AND o.xo WHERE o.entry_credit > 0 AND o.entry_credit < o.width
       GROUP BY ALL""",
)
_h = " UNION ALL ".join(
    f"""SELECT economic_index_id, session_date, previous, etf_mark, state_category, phase, dynamic_unit, {h} AS h, lead(session_date, {h}) OVER w AS e, stddev_samp(r) OVER (PARTITION BY economic_index_id ORDER BY session_date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) * sqrt(252e0) AS rv,
        greatest(ln(max(etf_mark) OVER (PARTITION BY economic_index_id ORDER BY session_date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)) - ln(etf_mark), 0e0) AS hi, least(ln(min(etf_mark) OVER (PARTITION BY economic_index_id ORDER BY session_date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)) - ln(etf_mark), 0e0) AS lo,
        count(etf_mark) OVER (PARTITION BY economic_index_id ORDER BY session_date ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING) AS n
        FROM (SELECT *, ln(etf_mark / lag(etf_mark) OVER (PARTITION BY economic_index_id ORDER BY session_date)) AS r FROM signals) s WINDOW w AS (PARTITION BY economic_index_id ORDER BY session_date)"""
    for h in (5, 10, 20)
)
step("ahead_x", _h)
step(
    "stress",
    """SELECT a.economic_index_id, a.session_date, a.e AS future_end_date, n.expiry, 'H' || a.h AS horizon, a.state_category, a.phase, a.dynamic_unit AS risk_unit, v.atm_iv / 100e0 AS lagged_atm_iv, a.rv AS future_realized_vol,
         a.rv / (v.atm_iv / 100e0) AS realized_to_implied, v.atm_iv / 100e0 * sqrt(a.h / 252e0) AS expected_move, greatest(a.hi, -a.lo) / (v.atm_iv / 100e0 * sqrt(a.h / 252e0)) AS normalized_max_move, a.hi AS maximum_up_move, a.lo AS maximum_down_move
       FROM ahead_x a JOIN (SELECT economic_index_id, session_date, max(maturity_date) AS expiry FROM near GROUP BY 1, 2) n USING (economic_index_id, session_date)
       JOIN v_expiry_iv v ON v.economic_index_id = a.economic_index_id AND v.session_date = a.previous AND v.expiry = n.expiry AND v.atm_iv / 100e0 BETWEEN 0.01 AND 3 WHERE a.n = a.h + 1""",
)
step(
    "exit_rows",
    """SELECT m.mode, p.economic_index_id, p.session_date, i.combo AS entry_credit, p.expiry, p.state_category, p.phase, p.dynamic_unit, p.path_date, p.o, p.combo, p.path_category,
         CASE WHEN m.mode = 'KNOWN_BLOCK_EXIT' AND p.path_category = 'KNOWN_BLOCK' THEN 'STATE_KNOWN_BLOCK' WHEN m.mode = 'ALL_ZERO_EXIT' AND p.path_category <> 'ALLOW' THEN 'STATE_' || p.path_category
              WHEN date_diff('day', p.path_date, p.expiry) <= 7 THEN 'DTE_7' END AS exit_reason,
         greatest(p.short_put_strike - p.long_put_strike, p.long_call_strike - p.short_call_strike) * 10000e0 AS width
       FROM paths p JOIN paths i ON i.economic_index_id = p.economic_index_id AND i.session_date = p.session_date AND i.o = i.o0
       JOIN (SELECT unnest(['STATIC_KNOWN_UNIVERSE', 'KNOWN_BLOCK_EXIT', 'ALL_ZERO_EXIT']) AS mode) m
         ON CASE m.mode WHEN 'STATIC_KNOWN_UNIVERSE' THEN p.state_category <> 'ABSTAIN_DATA' ELSE p.state_category = 'ALLOW' END
       WHERE p.o > p.o0 AND p.combo IS NOT NULL AND i.combo IS NOT NULL""",
)
step(
    "state_exit_ledger",
    """SELECT economic_index_id, mode, session_date AS entry_date, path_date AS exit_date, expiry, state_category AS entry_state_category, exit_reason, path_category AS exit_state_category, date_diff('day', session_date, path_date) AS holding_calendar_days,
         entry_credit, combo AS exit_debit, greatest(width - entry_credit, 1e0) AS defined_max_loss, entry_credit - combo AS pnl_per_combo, (entry_credit - combo) / greatest(width - entry_credit, 1e0) AS return_on_max_loss
       FROM (SELECT *, row_number() OVER (PARTITION BY mode, economic_index_id, session_date ORDER BY o) AS rn FROM exit_rows WHERE exit_reason IS NOT NULL) q WHERE rn = 1 AND entry_credit > 0 AND entry_credit < width""",
)


DAY = [Co.UNDERLYING, "session_date"]


def dated(df: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Add the session at whose opening a row may first be used."""
    nxt = calendar(spark, folder).selectExpr("session_date", "next_session AS decision_date")
    return df.join(nxt, "session_date").filter("decision_date IS NOT NULL")


@shared
def signals(spark: SparkSession, folder: str) -> DataFrame:
    return Co.signal_calendar(
        view(spark, folder, "spot"),
        dated(state(spark, folder), spark, folder),
        dated(feature_history(spark, folder), spark, folder),
        dated(scored(spark, folder), spark, folder),
    )


def selection(spark, folder):
    return Co.select_condors(view(spark, folder, "spot"), view(spark, folder, "listed"), view(spark, folder, "expiry_iv"))


@shared
def condors(spark: SparkSession, folder: str) -> DataFrame:
    return selection(spark, folder)[0]


def windows(spark: SparkSession, folder: str) -> DataFrame:
    return add(
        view(spark, folder, "marks"),
        {
            "fill_window": "'OPEN_AM'",
            "vwap": "CASE WHEN volume % 29 = 0 THEN mark * 1.2D ELSE mark END",
            "high": "mark * 1.02D",
            "low": "mark * 0.98D",
        },
    )


def selected_marks(spark, folder) -> DataFrame:
    return view(spark, folder, "marks").join(Co.leg_codes(condors(spark, folder)), "code", "left_semi")


@shared
def opportunities(spark: SparkSession, folder: str) -> DataFrame:
    return Ti.opportunity_panel(signals(spark, folder), condors(spark, folder), selected_marks(spark, folder))


@shared
def stress(spark: SparkSession, folder: str) -> DataFrame:
    return Ti.stress_panel(signals(spark, folder), view(spark, folder, "listed"), view(spark, folder, "expiry_iv"))


@shared
def exits(spark: SparkSession, folder: str) -> DataFrame:
    return Ti.state_exits(signals(spark, folder), condors(spark, folder), selected_marks(spark, folder))


@register("p18_risk_units", "economic_index_id session_date raw_dynamic_unit~ risk_reason", "SELECT * FROM signals")
def _(spark, folder):
    return signals(spark, folder)


@register("f03_confirmed_units", "economic_index_id session_date raw_dynamic_unit~ dynamic_unit~", "SELECT * FROM signals")
def _(spark, folder):
    return signals(spark, folder)


@register(
    "j08_decision_date_join",
    "economic_index_id session_date signal_session_date global_status local_status phase insurance_compensation vrp_ewma94~ pressure_score~",
    "SELECT * FROM signals",
)
def _(spark, folder):
    return signals(spark, folder)


@register(
    "x22_signal_calendar",
    "economic_index_id session_date signal_session_date global_status local_status phase direction pressure_score~ index_pressure~ raw_dynamic_unit~ risk_reason dynamic_unit~",
    "SELECT * FROM signals",
)
def _(spark, folder):
    return signals.direct(spark, folder)


@register("p17_timing_category", "economic_index_id session_date state_category", "SELECT * FROM signals")
def _(spark, folder):
    return add(signals(spark, folder), {"state_category": Co.timing_category()})


@register("t01_expiry_nearest_35", "economic_index_id session_date maturity_date dte#", "SELECT DISTINCT economic_index_id, session_date, maturity_date, dte FROM near")
def _(spark, folder):
    days = view(spark, folder, "spot").select(*DAY)
    rows = Co.in_tenor(view(spark, folder, "listed")).join(days, DAY, "left_semi")
    return Co.nearest_expiry(rows).select(*DAY, "maturity_date", "dte").distinct()


@register(
    "p03_validity_counts",
    "economic_index_id session_date active#",
    "SELECT s.economic_index_id, s.session_date, count(l.code) AS active FROM v_spot s LEFT JOIN v_listed l ON l.economic_index_id = s.economic_index_id AND s.session_date BETWEEN l.list_date AND l.maturity_date GROUP BY 1, 2",
)
def _(spark, folder):
    return Co.active_counts(view(spark, folder, "listed"), view(spark, folder, "spot").select(*DAY))


@register("j11_lagged_surface", "economic_index_id session_date previous expiry sigma~", "SELECT DISTINCT economic_index_id, session_date, previous, maturity_date AS expiry, sigma FROM near WHERE sigma IS NOT NULL")
def _(spark, folder):
    days = Co.ordered_sessions(view(spark, folder, "spot").select(*DAY))
    near = Co.nearest_expiry(Co.in_tenor(view(spark, folder, "listed"))).select(*DAY, "maturity_date").distinct()
    vols = Co.lagged_vol(view(spark, folder, "expiry_iv"))
    out = near.join(days, DAY).join(vols, [Co.UNDERLYING, "previous", "maturity_date"])
    return out.withColumnRenamed("maturity_date", "expiry")


@register(
    "t02_nearest_delta_strike",
    "economic_index_id session_date short_call_code short_call_strike~ short_call_delta~ short_put_code short_put_strike~ short_put_delta~",
    "SELECT * FROM condors",
)
def _(spark, folder):
    return condors(spark, folder)


@register("w18_second_wing", "economic_index_id session_date long_call_code long_call_strike~ long_put_code long_put_strike~", "SELECT * FROM condors")
def _(spark, folder):
    return condors(spark, folder)


@register(
    "x19_condor_candidates",
    "economic_index_id session_date expiry dte# net_delta~ short_put_code long_put_code short_call_code long_call_code",
    "SELECT * FROM condors",
)
def _(spark, folder):
    return selection(spark, folder)[0]


@register(
    "x19_selection_rejects",
    "economic_index_id session_date reason value~",
    "SELECT economic_index_id, session_date, reason, CASE WHEN reason = 'NET_DELTA_GT_0_10' THEN net_delta END AS value FROM selection WHERE reason IS NOT NULL",
)
def _(spark, folder):
    return selection(spark, folder)[1]


@register("u04_distinct_leg_codes", "code", "SELECT DISTINCT code FROM leg_rows")
def _(spark, folder):
    return Co.leg_codes(condors(spark, folder))


@register(
    "j10_selected_codes",
    "session_date rows#",
    "SELECT session_date, count(*) AS rows FROM v_marks WHERE code IN (SELECT code FROM leg_rows) GROUP BY 1",
)
def _(spark, folder):
    return selected_marks(spark, folder).groupBy("session_date").agg(F.expr("count(1) AS rows"))


@register(
    "s06_daily_marks",
    "session_date code mark~",
    "SELECT * FROM marks_x WHERE code IN (SELECT code FROM leg_rows)",
)
def _(spark, folder):
    return Ti.usable_marks(selected_marks(spark, folder))


@register("j12_four_leg_gate", "economic_index_id session_date leg_issue capacity#", "SELECT * FROM leg_gate")
def _(spark, folder):
    return Co.leg_bars(condors(spark, folder), windows(spark, folder))


_size_cols = "economic_index_id session_date strategy fill_scenario fee_scenario risk_budget~"


@register(
    "m06_fill_credit_loss",
    f"{_size_cols} credit~ max_loss~",
    "SELECT * FROM sized",
)
def _(spark, folder):
    return Co.entry_sizing(condors(spark, folder), windows(spark, folder), signals(spark, folder))


@register("j23_scenario_expansion", "fill_scenario fee_scenario risk_budget~ strategy rows#", "SELECT fill_scenario, fee_scenario, risk_budget, strategy, count(*) AS rows FROM sized GROUP BY ALL")
def _(spark, folder):
    s = Co.entry_sizing(condors(spark, folder), windows(spark, folder), signals(spark, folder))
    return s.groupBy("fill_scenario", "fee_scenario", "risk_budget", "strategy").agg(F.expr("count(1) AS rows"))


@register(
    "x20_entry_sizing",
    f"{_size_cols} unit~ quantity# rejection open_fee~",
    """SELECT *, CASE WHEN leg_issue IS NOT NULL THEN leg_issue WHEN credit <= 0 OR quantity <= 0 THEN 'NONPOSITIVE_CREDIT_OR_ZERO_SIZE' END AS rejection,
       quantity * (2 * 1.6e0 + 4 * broker_fee) AS open_fee FROM sized""",
)
def _(spark, folder):
    return Co.entry_sizing(condors(spark, folder), windows(spark, folder), signals(spark, folder))


@register(
    "j13_four_leg_marks",
    "economic_index_id session_date path_date combo~",
    "SELECT economic_index_id, session_date, path_date, combo FROM paths WHERE combo IS NOT NULL",
)
def _(spark, folder):
    return Ti.marked_paths(signals(spark, folder), condors(spark, folder), selected_marks(spark, folder)).filter("combo IS NOT NULL")


@register("j16_path_days", "economic_index_id session_date first_day last_day days#", "SELECT economic_index_id, session_date, min(path_date) AS first_day, max(path_date) AS last_day, count(*) AS days FROM paths GROUP BY 1, 2")
def _(spark, folder):
    p = Ti.marked_paths(signals(spark, folder), condors(spark, folder), selected_marks(spark, folder))
    return p.groupBy(*DAY).agg(
        F.expr("min(path_date) AS first_day"), F.expr("max(path_date) AS last_day"), F.expr("count(1) AS days")
    )


@register(
    "j14_forward_horizons",
    "economic_index_id session_date horizon exit_date",
    "SELECT economic_index_id, session_date, horizon, exit_date FROM opps WHERE horizon <> 'TO_7DTE'",
)
def _(spark, folder):
    return opportunities(spark, folder).filter("horizon <> 'TO_7DTE'")


@register("j15_forward_as_of", "economic_index_id session_date exit_date", "SELECT economic_index_id, session_date, exit_date FROM opps WHERE horizon = 'TO_7DTE'")
def _(spark, folder):
    return opportunities(spark, folder).filter("horizon = 'TO_7DTE'")


@register(
    "w19_path_extrema",
    "economic_index_id session_date horizon max_adverse_excursion~ mae_date path_mark_coverage~ path_spot_min~ path_spot_max~ put_short_breached call_short_breached",
    "SELECT * FROM opps",
)
def _(spark, folder):
    return opportunities(spark, folder)


_opp_cols = (
    "economic_index_id session_date horizon expiry exit_date state_category phase risk_unit~ entry_credit~ defined_max_loss~ holding_sessions# exit_debit~ pnl_per_combo~ "
    "return_on_max_loss~ put_side_pnl~ call_side_pnl~ loss_side max_adverse_excursion~ mae_date"
)


@register("x24_opportunity_panel", _opp_cols, "SELECT * FROM opps")
def _(spark, folder):
    return opportunities.direct(spark, folder)


@register(
    "x25_market_stress_panel",
    "economic_index_id session_date future_end_date expiry horizon state_category phase risk_unit~ lagged_atm_iv~ future_realized_vol~ realized_to_implied~ expected_move~ "
    "normalized_max_move~ maximum_up_move~ maximum_down_move~",
    "SELECT * FROM stress",
)
def _(spark, folder):
    return stress.direct(spark, folder)


@register(
    "w20_forward_realised",
    "economic_index_id session_date horizon future_realized_vol~ maximum_up_move~ maximum_down_move~",
    "SELECT * FROM stress",
)
def _(spark, folder):
    return stress(spark, folder)


@register(
    "x27_state_exits",
    "economic_index_id mode entry_date exit_date expiry entry_state_category exit_reason exit_state_category holding_calendar_days# entry_credit~ exit_debit~ defined_max_loss~ pnl_per_combo~ return_on_max_loss~",
    "SELECT * FROM state_exit_ledger",
)
def _(spark, folder):
    return exits.direct(spark, folder)


_stat = """count(*) AS n, avg(return_on_max_loss) AS mean_return_on_max_loss, median(return_on_max_loss) AS median_return_on_max_loss, avg(CAST(return_on_max_loss > 0 AS INT)) AS win_rate,
  avg(max_adverse_excursion) AS mean_max_adverse_excursion, min(return_on_max_loss) AS worst_return_on_max_loss"""


@register(
    "a14_group_statistics",
    "economic_index_id horizon group_kind group_value n# mean_return_on_max_loss~ median_return_on_max_loss~ win_rate~ mean_max_adverse_excursion~ worst_return_on_max_loss~",
    f"""SELECT economic_index_id, horizon, 'category' AS group_kind, state_category AS group_value, {_stat} FROM opps GROUP BY ALL
        UNION ALL SELECT economic_index_id, horizon, 'risk_unit', CAST(risk_unit AS VARCHAR), {_stat} FROM opps WHERE state_category <> 'ABSTAIN_DATA' GROUP BY ALL
        UNION ALL SELECT economic_index_id, horizon, 'phase', phase, {_stat} FROM opps WHERE state_category <> 'ABSTAIN_DATA' GROUP BY ALL""",
)
def _(spark, folder):
    return Ti.group_statistics(opportunities(spark, folder))


step("known_opps", "SELECT o.*, t.threshold, o.return_on_max_loss <= t.threshold AS bad FROM opps o JOIN (SELECT economic_index_id, horizon, quantile_cont(return_on_max_loss, 0.1) AS threshold FROM opps WHERE state_category <> 'ABSTAIN_DATA' GROUP BY 1, 2) t USING (economic_index_id, horizon) WHERE state_category <> 'ABSTAIN_DATA'")
step(
    "tail_x",
    """SELECT *, block_capture_rate / nullif(baseline_block_rate, 0) AS capture_lift FROM (SELECT economic_index_id, horizon, any_value(threshold) AS threshold, count(*) FILTER (WHERE bad) AS bad_opportunity_days,
       count(*) FILTER (WHERE bad AND state_category = 'KNOWN_BLOCK') AS blocked_bad_opportunity_days, count(*) FILTER (WHERE bad AND state_category = 'ALLOW') AS allowed_bad_opportunity_days,
       count(*) FILTER (WHERE bad AND state_category = 'KNOWN_BLOCK') / count(*) FILTER (WHERE bad) AS block_capture_rate, count(*) FILTER (WHERE state_category = 'KNOWN_BLOCK') / count(*) AS baseline_block_rate,
       count(DISTINCT expiry) FILTER (WHERE bad) AS bad_expiry_clusters, count(*) FILTER (WHERE bad AND state_category = 'ALLOW') / greatest(count(*) FILTER (WHERE state_category = 'ALLOW'), 1) AS allowed_bad_rate,
       count(*) FILTER (WHERE bad AND state_category = 'KNOWN_BLOCK') / greatest(count(*) FILTER (WHERE state_category = 'KNOWN_BLOCK'), 1) AS blocked_bad_rate FROM known_opps GROUP BY 1, 2) q""",
)
step("per_expiry", "SELECT economic_index_id, horizon, expiry, avg(return_on_max_loss) FILTER (WHERE state_category = 'ALLOW') AS a, avg(return_on_max_loss) FILTER (WHERE state_category = 'KNOWN_BLOCK') AS b FROM known_opps GROUP BY 1, 2, 3")
step(
    "differences_x",
    """SELECT k.economic_index_id, k.horizon, avg(return_on_max_loss) FILTER (WHERE state_category = 'ALLOW') - avg(return_on_max_loss) FILTER (WHERE state_category = 'KNOWN_BLOCK') AS allow_minus_block_mean,
       any_value(e.bal) AS expiry_balanced_allow_minus_block_mean, any_value(e.w) AS worst_allowed_expiry,
       avg(return_on_max_loss) FILTER (WHERE state_category = 'ALLOW' AND (e.w IS NULL OR expiry <> e.w)) - avg(return_on_max_loss) FILTER (WHERE state_category = 'KNOWN_BLOCK' AND (e.w IS NULL OR expiry <> e.w)) AS allow_minus_block_without_worst_expiry
       FROM known_opps k JOIN (SELECT economic_index_id, horizon, avg(a) - avg(b) AS bal, arg_min(expiry, (a, expiry)) FILTER (WHERE a IS NOT NULL) AS w FROM per_expiry GROUP BY 1, 2) e USING (economic_index_id, horizon) GROUP BY 1, 2""",
)


@register(
    "a15_tail_capture",
    "economic_index_id horizon threshold~ bad_opportunity_days# blocked_bad_opportunity_days# allowed_bad_opportunity_days# block_capture_rate~ baseline_block_rate~ capture_lift~ bad_expiry_clusters# allowed_bad_rate~ blocked_bad_rate~",
    "SELECT * FROM tail_x",
)
def _(spark, folder):
    return Ti.tail_capture(opportunities(spark, folder))


@register(
    "a16_count_maps",
    "economic_index_id horizon kind value n#",
    """SELECT economic_index_id, horizon, 'loss_side' AS kind, loss_side AS value, count(*) AS n FROM known_opps WHERE bad GROUP BY ALL
       UNION ALL SELECT economic_index_id, horizon, 'phase', phase, count(*) FROM known_opps WHERE bad GROUP BY ALL
       UNION ALL SELECT economic_index_id, horizon, 'expiry', CAST(expiry AS VARCHAR), count(*) FROM known_opps WHERE bad GROUP BY ALL""",
)
def _(spark, folder):
    return Ti.count_maps(opportunities(spark, folder)).selectExpr("*", "explode(counts) AS (value, n)")


@register(
    "a17_mean_differences",
    "economic_index_id horizon allow_minus_block_mean~ expiry_balanced_allow_minus_block_mean~ worst_allowed_expiry allow_minus_block_without_worst_expiry~",
    "SELECT * FROM differences_x",
)
def _(spark, folder):
    return Ti.mean_differences(opportunities(spark, folder))


_drawn = pick("20260821", "d", "j", "n", xor="xor({0}, {1})")


@register(
    "a28_cluster_bootstrap",
    "economic_index_id horizon clusters# draws# ci_lower~ ci_upper~ probability_allow_better~",
    f"""WITH c AS (SELECT economic_index_id, horizon, expiry, row_number() OVER (PARTITION BY economic_index_id, horizon ORDER BY expiry) - 1 AS i, count(*) OVER (PARTITION BY economic_index_id, horizon) AS n,
         coalesce(sum(return_on_max_loss) FILTER (WHERE state_category = 'ALLOW'), 0) AS sa, count(*) FILTER (WHERE state_category = 'ALLOW') AS ca,
         coalesce(sum(return_on_max_loss) FILTER (WHERE state_category = 'KNOWN_BLOCK'), 0) AS sb, count(*) FILTER (WHERE state_category = 'KNOWN_BLOCK') AS cb FROM known_opps GROUP BY 1, 2, 3),
       h AS (SELECT economic_index_id, horizon, any_value(n) AS n FROM c GROUP BY 1, 2 HAVING any_value(n) >= 2 AND sum(ca) > 0 AND sum(cb) > 0),
       p AS (SELECT economic_index_id, horizon, d, {_drawn} AS i FROM (SELECT *, unnest(range(n)) AS j FROM (SELECT *, unnest(range(2000)) AS d FROM h) a) b),
       t AS (SELECT economic_index_id, horizon, d, sum(sa) / sum(ca) - sum(sb) / sum(cb) AS delta FROM p JOIN c USING (economic_index_id, horizon, i) GROUP BY 1, 2, 3 HAVING sum(ca) > 0 AND sum(cb) > 0)
       SELECT q.economic_index_id, q.horizon, clusters, coalesce(draws, 0) AS draws, ci_lower, ci_upper, probability_allow_better
       FROM (SELECT economic_index_id, horizon, count(*) AS clusters FROM c GROUP BY 1, 2) q LEFT JOIN (SELECT economic_index_id, horizon, count(*) AS draws, quantile_cont(delta, 0.025) AS ci_lower,
         quantile_cont(delta, 0.975) AS ci_upper, avg(CAST(delta > 0 AS INT)) AS probability_allow_better FROM t GROUP BY 1, 2) r USING (economic_index_id, horizon)""",
)
def _(spark, folder):
    return Ti.cluster_bootstrap(opportunities(spark, folder), table=counted)


step(
    "rho_x",
    """SELECT economic_index_id, horizon, count(*) AS n, CASE WHEN count(*) >= 3 AND count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN corr(rx, ry) END AS rho FROM (
       SELECT economic_index_id, horizon, risk_unit AS x, return_on_max_loss AS y, rank() OVER (PARTITION BY economic_index_id, horizon ORDER BY risk_unit) + (count(*) OVER (PARTITION BY economic_index_id, horizon, risk_unit) - 1) / 2 AS rx,
              rank() OVER (PARTITION BY economic_index_id, horizon ORDER BY return_on_max_loss) + (count(*) OVER (PARTITION BY economic_index_id, horizon, return_on_max_loss) - 1) / 2 AS ry FROM known_opps) q GROUP BY 1, 2""",
)


@register(
    "a29_spearman",
    "economic_index_id horizon n# rho~",
    "SELECT * FROM rho_x",
)
def _(spark, folder):
    return Ti.spearman(opportunities(spark, folder).filter(Ti.KNOWN), [Co.UNDERLYING, "horizon"], "risk_unit", "return_on_max_loss")


@register(
    "t05_worst_opportunities",
    "economic_index_id session_date expiry return_on_max_loss~ state_category loss_side",
    "SELECT * FROM known_opps WHERE horizon = 'TO_7DTE' ORDER BY return_on_max_loss, session_date, economic_index_id LIMIT 20",
)
def _(spark, folder):
    return Ti.worst_opportunities(opportunities(spark, folder))


@register(
    "x26_timing_summary",
    "economic_index_id horizon opportunities# known_opportunities# allowed_opportunities# blocked_opportunities# expiry_clusters# allow_minus_block_mean~ "
    "expiry_balanced_allow_minus_block_mean~ worst_allowed_expiry allow_minus_block_without_worst_expiry~ threshold~ bad_opportunity_days# "
    "block_capture_rate~ baseline_block_rate~ capture_lift~ bad_expiry_clusters# risk_unit_rank_correlation~ conclusion",
    """SELECT *, CASE WHEN allow_minus_block_mean < 0 AND capture_lift < 1 THEN 'IN_SAMPLE_TIMING_NOT_SUPPORTED' WHEN allow_minus_block_mean > 0 AND capture_lift > 1 THEN 'IN_SAMPLE_TIMING_SUPPORTED'
       ELSE 'IN_SAMPLE_TIMING_INCONCLUSIVE' END AS conclusion FROM (
       SELECT economic_index_id, horizon, count(*) AS opportunities, count(*) FILTER (WHERE state_category <> 'ABSTAIN_DATA') AS known_opportunities, count(*) FILTER (WHERE state_category = 'ALLOW') AS allowed_opportunities,
         count(*) FILTER (WHERE state_category = 'KNOWN_BLOCK') AS blocked_opportunities, count(DISTINCT expiry) FILTER (WHERE state_category <> 'ABSTAIN_DATA') AS expiry_clusters FROM opps GROUP BY 1, 2) c
       LEFT JOIN differences_x USING (economic_index_id, horizon) LEFT JOIN tail_x USING (economic_index_id, horizon)
       LEFT JOIN (SELECT economic_index_id, horizon, rho AS risk_unit_rank_correlation FROM rho_x) r USING (economic_index_id, horizon)""",
)
def _(spark, folder):
    return Ti.timing_summary(opportunities(spark, folder))



step("known_stress", "SELECT s.*, t.threshold, s.realized_to_implied >= t.threshold AS bad FROM stress s JOIN (SELECT economic_index_id, horizon, quantile_cont(realized_to_implied, 0.9) AS threshold FROM stress WHERE state_category <> 'ABSTAIN_DATA' GROUP BY 1, 2) t USING (economic_index_id, horizon) WHERE state_category <> 'ABSTAIN_DATA'")


@register(
    "a18_stress_statistics",
    "economic_index_id horizon state_category n# mean_realized_to_implied~ median_realized_to_implied~ mean_normalized_max_move~ expected_move_breach_rate~ threshold~ known_days# tail_days# blocked_tail_days# block_capture_rate~ capture_lift~ allow_minus_block_realized_to_implied~",
    """SELECT * FROM (SELECT economic_index_id, horizon, state_category, count(*) AS n, avg(realized_to_implied) AS mean_realized_to_implied, median(realized_to_implied) AS median_realized_to_implied,
       avg(normalized_max_move) AS mean_normalized_max_move, avg(CAST(normalized_max_move >= 1 AS INT)) AS expected_move_breach_rate FROM stress GROUP BY 1, 2, 3) g
       LEFT JOIN (SELECT economic_index_id, horizon, any_value(threshold) AS threshold, count(*) AS known_days, count(*) FILTER (WHERE bad) AS tail_days, count(*) FILTER (WHERE bad AND state_category = 'KNOWN_BLOCK') AS blocked_tail_days,
         count(*) FILTER (WHERE bad AND state_category = 'KNOWN_BLOCK') / count(*) FILTER (WHERE bad) AS block_capture_rate,
         (count(*) FILTER (WHERE bad AND state_category = 'KNOWN_BLOCK') / count(*) FILTER (WHERE bad)) / nullif(count(*) FILTER (WHERE state_category = 'KNOWN_BLOCK') / count(*), 0) AS capture_lift,
         avg(realized_to_implied) FILTER (WHERE state_category = 'ALLOW') - avg(realized_to_implied) FILTER (WHERE state_category = 'KNOWN_BLOCK') AS allow_minus_block_realized_to_implied
         FROM known_stress GROUP BY 1, 2) t USING (economic_index_id, horizon)""",
)
def _(spark, folder):
    return Ti.stress_summary(stress(spark, folder))


@register(
    "a24_state_path_summary",
    "economic_index_id mode closed_cycles# total_pnl~4 sum_defined_max_loss~4 pnl_over_sum_defined_max_loss~ mean_return_on_max_loss~ median_return_on_max_loss~ win_rate~ worst_return_on_max_loss~ average_holding_calendar_days~",
    """SELECT *, total_pnl / sum_defined_max_loss AS pnl_over_sum_defined_max_loss FROM (SELECT economic_index_id, mode, count(*) AS closed_cycles, sum(pnl_per_combo) AS total_pnl, sum(defined_max_loss) AS sum_defined_max_loss,
       avg(return_on_max_loss) AS mean_return_on_max_loss, median(return_on_max_loss) AS median_return_on_max_loss, avg(CAST(pnl_per_combo > 0 AS INT)) AS win_rate, min(return_on_max_loss) AS worst_return_on_max_loss,
       avg(holding_calendar_days) AS average_holding_calendar_days FROM state_exit_ledger GROUP BY 1, 2) q""",
)
def _(spark, folder):
    return Ti.state_path_summary(exits(spark, folder))


@register(
    "j17_matched_exits",
    "economic_index_id mode matched_cycles# state_exit_total_pnl~4 fixed_to_7dte_total_pnl~4 state_exit_minus_fixed_pnl~4 state_exit_pnl_over_loss~ fixed_pnl_over_loss~ state_exit_worst_return~ fixed_worst_return~",
    """SELECT *, state_exit_total_pnl - fixed_to_7dte_total_pnl AS state_exit_minus_fixed_pnl, state_exit_total_pnl / risk AS state_exit_pnl_over_loss, fixed_to_7dte_total_pnl / risk AS fixed_pnl_over_loss FROM (
       SELECT l.economic_index_id, l.mode, count(*) AS matched_cycles, sum(l.pnl_per_combo) AS state_exit_total_pnl, sum(o.pnl_per_combo) AS fixed_to_7dte_total_pnl, sum(l.defined_max_loss) AS risk,
              min(l.return_on_max_loss) AS state_exit_worst_return, min(o.return_on_max_loss) AS fixed_worst_return
       FROM state_exit_ledger l JOIN opps o ON o.economic_index_id = l.economic_index_id AND o.session_date = l.entry_date AND o.horizon = 'TO_7DTE' WHERE l.mode <> 'STATIC_KNOWN_UNIVERSE' GROUP BY 1, 2) q""",
)
def _(spark, folder):
    return Ti.matched_exits(exits(spark, folder), opportunities(spark, folder))
