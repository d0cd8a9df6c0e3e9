"""Risk-unit signals, iron-condor selection, entry gate and sizing.

Tables may hold several underlyings: if they have the column ``economic_index_id``, it is part of every key, and
sessions, expiries, strikes and units of one underlying never meet those of another. Without it they hold one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel import params as P
from volpanel.functions.black import with_forward_delta
from volpanel.functions.num import add
from volpanel.operators import blocks as B
from volpanel.operators import series as S
from volpanel.operators import state as St

DTE_LOW, DTE_HIGH, DTE_TARGET = 25, 45, 35
DELTA_LOW, DELTA_HIGH, DELTA_TARGET = 0.15, 0.25, 0.20
NET_DELTA_CAP = 0.10
DAYS_PER_YEAR = 365.2425


UNDERLYING = "economic_index_id"


def own(df: DataFrame) -> list[str]:
    """The key of the underlying, if the table has one."""
    return [UNDERLYING] if UNDERLYING in df.columns else []


# ---- signals --------------------------------------------------------------------


def risk_unit(local_label: str = "'CSI300'") -> str:
    """struct(unit, reason): phase map, hard gates, then caps, all from prior-session state.

    ``local_label`` is the SQL of the underlying's name in reasons.
    """
    units = ", ".join(f"'{p}', {u!r}D" for p, u in P.PHASE_UNITS.items())
    unit = f"coalesce(map({units})[coalesce(phase, 'UNKNOWN')], 0D)"
    zero = "coalesce({0}, 0D)".format
    local = ", ".join(zero(c) for c in ("index_pressure", "shock", "down_tail", "persistence"))
    normal = "insurance_compensation = 'NORMAL'"
    market = f"(coalesce(direction, 'UNKNOWN') = 'RISING' OR {zero('pressure_score')} >= 70)"
    near = (
        f"({zero('index_pressure')} >= 70 OR {zero('shock')} >= 65 OR {zero('down_tail')} >= 75 OR {zero('persistence')} >= 75)"
    )
    capped = f"least({unit}, if({normal}, 0.5D, 1D), if({market}, 0.25D, 1D), if({near}, 0.25D, 1D))"
    reasons = (
        f"concat_ws('+', 'PHASE_MAP', if({normal}, 'NORMAL_COMP_CAP', NULL), if({market}, 'GLOBAL_PRESSURE_CAP', NULL), "
        f"if({near}, concat({local_label}, '_PRESSURE_CAP'), NULL))"
    )

    def stop(reason: str) -> str:
        return f"struct(0D AS unit, {reason} AS reason)"

    return (
        f"CASE WHEN coalesce(global_status, 'UNKNOWN') <> 'OK' THEN {stop(chr(39) + 'GLOBAL_NOT_OK' + chr(39))} "
        f"WHEN {unit} <= 0 THEN {stop('concat(' + chr(39) + 'PHASE_' + chr(39) + ', coalesce(phase, ' + chr(39) + 'UNKNOWN' + chr(39) + '))')} "
        f"WHEN coalesce(local_status, 'UNKNOWN') <> 'OK' THEN {stop(f'concat({local_label}, {chr(39)}_NOT_OK{chr(39)})')} "
        "WHEN insurance_compensation IN ('THIN', 'UNKNOWN') THEN "
        "struct(0D AS unit, concat('COMPENSATION_', insurance_compensation) AS reason) "
        "WHEN NOT coalesce(vrp_ewma94 > 0, false) THEN struct(0D AS unit, 'VRP_NOT_POSITIVE' AS reason) "
        f"WHEN coalesce(hard_acute, false) OR {zero('pressure_score')} >= 85 OR greatest({local}) >= 85 THEN "
        "struct(0D AS unit, 'ACUTE_CAP_ZERO' AS reason) "
        f"ELSE struct({capped} AS unit, {reasons} AS reason) END"
    )


def with_risk_units(df: DataFrame, order: str = "session_date", *, local_label: str = "'CSI300'") -> DataFrame:
    df = add(df, {"_u": risk_unit(UNDERLYING if own(df) else local_label)})
    df = add(df, {"raw_dynamic_unit": "_u.unit", "risk_reason": "_u.reason", "static_unit": "0.5D"}).drop("_u")
    return St.confirm_increases(df, "raw_dynamic_unit", "dynamic_unit", keys=own(df), order=order)


def _per_decision_date(df: DataFrame, columns: list[str]) -> DataFrame:
    """Last row per decision date (and underlying)."""
    packed = f"max_by(struct({', '.join(columns)}), session_date) AS _row"
    keys = [*own(df), "decision_date"]
    return df.groupBy(*keys).agg(F.expr(packed)).select(*keys, "_row.*")


def signal_calendar(
    sessions: DataFrame, states: DataFrame, features: DataFrame, index_states: DataFrame, *, local_index: str = "CSI300"
) -> DataFrame:
    """Sessions with the state decided on the evening before, and risk units.

    ``states``, ``features`` and ``index_states`` carry ``decision_date``, the
    session at whose opening they may first be used. Sessions without an
    underlying are those of ``local_index``.
    """
    st = states.selectExpr(
        "decision_date", "session_date", "session_date AS signal_session_date", "data_status AS global_status",
        "primary_phase AS phase", "pressure_level", "direction", "pressure_score", "hard_acute",
    )
    st = _per_decision_date(
        st, ["signal_session_date", "global_status", "phase", "pressure_level", "direction", "pressure_score", "hard_acute"]
    )
    if not own(sessions):
        mine = f"{UNDERLYING} = '{local_index}'"
        features, index_states = (t.filter(mine).drop(UNDERLYING) for t in (features, index_states))
    ft = _per_decision_date(features, ["insurance_compensation", "vrp_ewma94"])
    ix = index_states.withColumnRenamed("data_status", "local_status")
    ix = _per_decision_date(ix, ["local_status", "index_pressure", "shock", "down_tail", "persistence"])
    df = add(sessions, {"decision_date": "session_date"})
    for part in (st, ft, ix):
        df = df.join(part, [*own(part), "decision_date"], "left")
    df = with_risk_units(df.drop("decision_date"), local_label=f"'{local_index}'")
    return add(df, {c: f"coalesce({c}, 'UNKNOWN')" for c in ("phase", "global_status", "local_status")})


def timing_category() -> str:
    complete = (
        "coalesce(global_status, 'UNKNOWN') = 'OK' AND coalesce(local_status, 'UNKNOWN') = 'OK' "
        "AND coalesce(phase, 'UNKNOWN') <> 'UNKNOWN' AND coalesce(insurance_compensation, '') NOT IN ('', 'UNKNOWN') "
        "AND vrp_ewma94 IS NOT NULL"
    )
    return (
        f"CASE WHEN NOT ({complete}) THEN 'ABSTAIN_DATA' WHEN coalesce(dynamic_unit, 0D) > 0 THEN 'ALLOW' ELSE 'KNOWN_BLOCK' END"
    )


# ---- selection ------------------------------------------------------------------


def ordered_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions with their predecessor in the list (one row per trading day)."""
    return add(sessions, {"previous": f"lag(session_date) OVER ({S.by(own(sessions), 'session_date')})"})


def in_tenor(contracts: DataFrame) -> DataFrame:
    """Each contract on the days it is listed and 25 to 45 days from expiry.

    The expansion is at most 21 days per contract, which turns the interval
    join with the sessions into an equi-join.
    """
    start = f"greatest(list_date, date_sub(maturity_date, {DTE_HIGH}))"
    end = f"date_sub(maturity_date, {DTE_LOW})"
    days = contracts.filter(f"call_put IN ('C', 'P') AND {start} <= {end}")
    days = add(days, {"session_date": f"explode(sequence({start}, {end}))"})
    return add(days, {"dte": "datediff(maturity_date, session_date)"})


def nearest_expiry(rows: DataFrame) -> DataFrame:
    """Keep the rows of each session's expiry nearest 35 days (shorter on a tie)."""
    best = f"min(struct(abs(dte - {DTE_TARGET}) AS gap, dte, maturity_date)) OVER (PARTITION BY {', '.join([*own(rows), 'session_date'])})"
    return add(rows, {"_best": best}).filter("maturity_date = _best.maturity_date").drop("_best")


def active_counts(contracts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Number of listed contracts on each session, from daily openings and closings."""
    usable = contracts.filter("call_put IN ('C', 'P')")
    keys = own(sessions)
    moves = (
        usable.groupBy(*keys, F.expr("list_date AS day")).agg(F.expr("count(1) AS move"))
        .unionByName(usable.groupBy(*keys, F.expr("date_add(maturity_date, 1) AS day")).agg(F.expr("-count(1) AS move")))
        .withColumn("session_date", F.expr("CAST(NULL AS DATE)"))
        .unionByName(sessions.selectExpr(*keys, "session_date AS day", "0L AS move", "session_date"))
    )
    # openings and closings of a day come before its session row
    days = moves.groupBy(*keys, "day").agg(F.expr("sum(move) AS move"), F.expr("any_value(session_date, true) AS session_date"))
    live = B.running_sums(add(days, {"_block": B.block_of(days, "day")}), keys, "day", {"active": "move"})
    return live.filter("session_date IS NOT NULL").select(*keys, "session_date", "active")


def lagged_vol(surface: DataFrame) -> DataFrame:
    """Usable at-the-money vol by the session it was observed on and expiry."""
    return surface.filter("atm_iv / 100D BETWEEN 0.01D AND 3D").selectExpr(
        *own(surface), "session_date AS previous", "expiry AS maturity_date", "atm_iv / 100D AS sigma"
    )


def select_condors(
    sessions: DataFrame, contracts: DataFrame, surface: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """One four-leg candidate per session (of each underlying), or the first reason there is none."""
    keys = own(sessions)
    day = [*keys, "session_date"]
    days = ordered_sessions(sessions.select(*day, "spot_0935"))
    chain = nearest_expiry(in_tenor(contracts)).join(days, day)
    chain = chain.join(lagged_vol(surface), [*keys, "previous", "maturity_date"], "left")
    chain = add(chain, {"_t": f"greatest(dte, 1) / {DAYS_PER_YEAR}D"})
    chain = with_forward_delta(chain, kind="call_put", forward="spot_0935", strike="exercise_price", sigma="sigma", t="_t")
    tick = "CASE WHEN coalesce(min_price_chg, 0D) = 0 THEN 0.0001D ELSE min_price_chg END"
    chain = add(chain, {"_leg": f"struct(code, exercise_price AS strike, delta, {tick} AS tick)"})
    outward = "CASE call_put WHEN 'C' THEN exercise_price ELSE -exercise_price END"
    over = f"PARTITION BY {', '.join(day)}, call_put ORDER BY {outward}, code"
    chain = add(chain, {"_wing": f"lead(_leg, 2) OVER ({over})"})

    def short(kind: str, side: str) -> str:
        ok = (
            f"call_put = '{kind}' AND exercise_price {side} spot_0935 AND abs(delta) BETWEEN {DELTA_LOW}D AND {DELTA_HIGH}D"
        )
        pick = f"struct(abs(abs(delta) - {DELTA_TARGET}D) AS gap, exercise_price AS strike, code AS id, _leg AS leg, _wing AS wing)"
        return f"min(CASE WHEN {ok} THEN {pick} END)"

    picked = chain.groupBy(*day).agg(
        F.expr("max(maturity_date) AS expiry"),
        F.expr("max(dte) AS dte"),
        F.expr("max(sigma) AS lagged_atm_iv"),
        F.expr(f"{short('C', '>')} AS _sc"),
        F.expr(f"{short('P', '<')} AS _sp"),
    )
    out = days.join(active_counts(contracts, sessions.select(*day)), day, "left")
    out = out.join(picked, day, "left")
    net = "(-_sc.leg.delta + _sc.wing.delta - _sp.leg.delta + _sp.wing.delta)"
    out = add(
        out,
        {
            "net_delta": net,
            "reason": "CASE WHEN previous IS NULL OR NOT coalesce(spot_0935 > 0, false) THEN 'NO_LAGGED_SURFACE_OR_SPOT' "
            "WHEN active = 0 THEN 'NO_STANDARD_CONTRACT' WHEN expiry IS NULL THEN 'NO_25_45_DTE' "
            "WHEN lagged_atm_iv IS NULL THEN 'NO_PRIOR_EXPIRY_IV' "
            "WHEN _sc IS NULL OR _sp IS NULL THEN 'NO_15_25_DELTA_SHORT' "
            "WHEN _sc.wing IS NULL OR _sp.wing IS NULL THEN 'FEWER_THAN_TWO_WING_STRIKES' "
            f"WHEN abs({net}) > {NET_DELTA_CAP}D THEN 'NET_DELTA_GT_0_10' END",
        },
    )
    legs = {"short_put": "_sp.leg", "long_put": "_sp.wing", "short_call": "_sc.leg", "long_call": "_sc.wing"}
    candidates = out.filter("reason IS NULL").selectExpr(
        *day, "previous AS signal_session_date", "spot_0935", "expiry", "dte", "lagged_atm_iv", "net_delta",
        *[f"{source}.{f} AS {leg}_{f}" for leg, source in legs.items() for f in ("code", "strike", "delta", "tick")],
    )
    rejects = out.filter("reason IS NOT NULL").selectExpr(
        *day, "'SELECTION' AS stage", "reason", "CASE WHEN reason = 'NET_DELTA_GT_0_10' THEN net_delta END AS value"
    )
    return candidates, rejects


def leg_codes(candidates: DataFrame) -> DataFrame:
    codes = ", ".join(f"{leg}_code" for leg in P.LEGS)
    return candidates.selectExpr(f"explode(array({codes})) AS code").distinct()


# ---- fills and sizing -----------------------------------------------------------


def fill_price(side: str, scenario: str, vwap: str, low: str, high: str, tick: str) -> str:
    """Adverse fill of a leg under a scenario column."""
    buy = f"{side} = 'BUY'"
    edge = f"(2D * {tick})"
    wide = f"greatest({edge}, 0.25D * greatest({high} - {low}, 0D))"

    def shifted(by: str) -> str:
        return f"greatest({tick}, if({buy}, {vwap} + {by}, {vwap} - {by}))"

    return (
        f"(CASE {scenario} WHEN 'VWAP_2TICK' THEN {shifted(edge)} WHEN 'VWAP_RANGE_25' THEN {shifted(wide)} "
        f"WHEN 'BAR_EXTREME' THEN greatest({tick}, if({buy}, {high}, {low})) END)"
    )


def max_loss(credit: str) -> str:
    width = "greatest(short_put_strike - long_put_strike, long_call_strike - short_call_strike)"
    return f"greatest({width} * {P.MULTIPLIER}D - {credit}, 1D)"


def fees(quantity: str, action: str, broker: str) -> str:
    return f"({quantity} * (if({action} = 'OPEN', 2, 4) * 1.6D + 4 * {broker}))"


def scenario_grid() -> str:
    """Fill, fee and risk-budget scenarios as one array literal."""
    rows = [(f, n, c, P.RISK_BUDGET) for f in P.FILLS for n, c in P.FEES.items()]
    rows += [("VWAP_2TICK", "BROKER_PLUS_2", 2.0, b) for b in P.RISK_BUDGETS if b != P.RISK_BUDGET]
    items = ", ".join(
        f"named_struct('fill_scenario', '{f}', 'fee_scenario', '{n}', 'broker_fee', {c!r}D, 'risk_budget', {b!r}D)"
        for f, n, c, b in rows
    )
    return f"array({items})"


def leg_bars(candidates: DataFrame, windows: DataFrame, *, window: str = "OPEN_AM") -> DataFrame:
    """Bars of the four legs of each candidate with the first failed leg check."""
    legs = ", ".join(
        f"named_struct('n', {i}, 'leg', '{leg}', 'code', {leg}_code, 'tick', {leg}_tick)" for i, leg in enumerate(P.LEGS)
    )
    strikes = [f"{leg}_strike" for leg in P.LEGS]
    day = [*own(candidates), "session_date"]
    rows = candidates.selectExpr(*day, *strikes, f"explode(array({legs})) AS l").select(*day, *strikes, "l.*")
    bars = windows.filter(f"fill_window = '{window}'").select(
        "session_date", "code", "positive_minutes", "volume", "vwap", "high", "low"
    )
    rows = rows.join(bars.withColumn("_bar", F.lit(True)), ["session_date", "code"], "left")
    issue = (
        "CASE WHEN _bar IS NULL THEN 'NO_BAR' "
        "WHEN coalesce(positive_minutes, 0) < 2 OR coalesce(volume, 0) < 20 THEN 'LIQUIDITY' "
        "WHEN NOT coalesce(vwap BETWEEN low - tick AND high + tick, false) THEN 'VWAP_RANGE' END"
    )
    rows = add(rows, {"_issue": issue})
    return rows.groupBy(*day).agg(
        F.expr(f"min(CASE WHEN _issue IS NOT NULL THEN struct(n, concat('{window}_', leg, '_', _issue) AS text) END).text AS leg_issue"),
        F.expr(f"bigint(min(floor(volume * {P.PARTICIPATION}D))) AS capacity"),
        *[F.expr(f"any_value({s}) AS {s}") for s in strikes],
        *[
            F.expr(f"max(CASE WHEN leg = '{leg}' THEN struct(vwap, low, high, tick) END) AS _{leg}") for leg in P.LEGS
        ],
    )


def entry_sizing(
    candidates: DataFrame, windows: DataFrame, calendar: DataFrame, *, nav: float = P.INITIAL_CAPITAL
) -> DataFrame:
    """Pre-trade table per candidate, strategy and scenario: fills, credit, size, rejection."""
    day = [*own(candidates), "session_date"]
    df = leg_bars(candidates, windows).join(calendar.select(*day, "static_unit", "dynamic_unit"), day)
    strategies = "array(struct('SV_STATIC' AS strategy, static_unit AS unit), struct('SV_DYNAMIC' AS strategy, dynamic_unit AS unit))"
    df = add(df, {"_s": f"explode({strategies})"})
    df = add(df, {"_x": f"explode({scenario_grid()})"}).select("*", "_s.*", "_x.*").drop("_s", "_x").filter("unit > 0")
    prices = {
        leg: fill_price(
            "'BUY'" if leg.startswith("long") else "'SELL'", "fill_scenario", *[f"_{leg}.{f}" for f in ("vwap", "low", "high", "tick")]
        )
        for leg in P.LEGS
    }
    df = add(df, {f"{leg}_price": f"CASE WHEN leg_issue IS NULL THEN {e} END" for leg, e in prices.items()})
    df = add(df, {"credit": f"{P.MULTIPLIER}D * (short_put_price + short_call_price - long_put_price - long_call_price)"})
    df = add(df, {"max_loss": f"CASE WHEN credit IS NOT NULL THEN {max_loss('credit')} END"})
    size = (
        f"greatest(0L, least(bigint(floor({nav}D * risk_budget * unit / max_loss)), "
        f"bigint(floor({nav}D * {P.MARGIN_CAP}D / max_loss)), capacity))"
    )
    df = add(df, {"quantity": f"CASE WHEN leg_issue IS NULL THEN {size} END"})
    df = add(
        df,
        {
            "rejection": "CASE WHEN leg_issue IS NOT NULL THEN leg_issue "
            "WHEN credit <= 0 OR quantity <= 0 THEN 'NONPOSITIVE_CREDIT_OR_ZERO_SIZE' END",
            "open_fee": fees("quantity", "'OPEN'", "broker_fee"),
        },
    )
    return df.drop(*[f"_{leg}" for leg in P.LEGS])
