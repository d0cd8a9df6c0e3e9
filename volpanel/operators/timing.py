"""Opportunity, stress and state-exit panels and their summaries.

Tables may hold several underlyings; see ``condor``. Summaries then have one row (or set of rows) for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel import params as P
from volpanel.functions.num import add
from volpanel.operators import blocks as B
from volpanel.operators import bootstrap as Bo
from volpanel.operators import calendar as C
from volpanel.operators import condor as Co
from volpanel.operators import series as S

STATE_COLUMNS = (
    "global_status local_status phase insurance_compensation vrp_ewma94 dynamic_unit raw_dynamic_unit risk_reason "
    "signal_session_date etf_mark"
).split()


def usable_marks(marks: DataFrame) -> DataFrame:
    """Settlement, else close; finite and not negative."""
    value = "coalesce(CASE WHEN NOT isnan(settle) THEN settle END, CASE WHEN NOT isnan(close) THEN close END)"
    out = marks.selectExpr("session_date", "code", f"{value} AS mark")
    return out.filter("mark >= 0 AND mark < double('Infinity')")


def marked_paths(calendar: DataFrame, candidates: DataFrame, marks: DataFrame) -> DataFrame:
    """Every candidate on every session from entry to expiry, with its combo mark.

    Days from entry to expiry are bounded by the 45-day tenor, so the interval
    join is an explode followed by equi-joins on the day and on (day, code).
    """
    keys = Co.own(candidates)
    day_keys = [*keys, "session_date"]
    days = C.session_calendar(calendar, keys)
    state = [c for c in STATE_COLUMNS if c in calendar.columns]
    dims = calendar.select(*day_keys, *state).join(days.select(*day_keys, "ordinal"), day_keys)
    dims = add(dims, {"state_category": Co.timing_category()})
    legs = [f"{leg}_{f}" for leg in P.LEGS for f in ("code", "strike")]
    entry = candidates.select(*day_keys, "expiry", *legs).join(dims, day_keys)
    entry = entry.withColumnRenamed("ordinal", "entry_ordinal").withColumnRenamed("etf_mark", "spot_entry")
    path = add(entry, {"path_date": "explode(sequence(session_date, expiry))"})
    day = dims.selectExpr(
        *keys, "session_date AS path_date", "ordinal AS path_ordinal", "etf_mark AS path_spot", "state_category AS path_category"
    )
    path = path.join(day, [*keys, "path_date"])
    codes = ", ".join(f"struct('{leg}' AS leg, {leg}_code AS code)" for leg in P.LEGS)
    carried = [c for c in path.columns if c not in (*day_keys, "path_date")]
    rows = path.selectExpr(*day_keys, "path_date", f"struct({', '.join(carried)}) AS c", f"explode(array({codes})) AS l")
    rows = rows.selectExpr(*day_keys, "path_date", "c", "l.leg", "l.code")
    priced = rows.join(
        usable_marks(marks).withColumnRenamed("session_date", "path_date"), ["path_date", "code"], "left"
    )
    out = priced.groupBy(*day_keys, "path_date").agg(
        F.expr("any_value(c) AS c"), *[F.expr(f"max(CASE WHEN leg = '{leg}' THEN mark END) AS {leg}") for leg in P.LEGS]
    )
    out = out.select(*day_keys, "path_date", "c.*", *P.LEGS)
    return add(out, {"combo": f"{P.MULTIPLIER}D * (short_put + short_call - long_put - long_call)"})


def _entry_terms(df: DataFrame) -> DataFrame:
    """Credit and defined loss; keeps openings with 0 < credit < width."""
    width = "greatest(short_put_strike - long_put_strike, long_call_strike - short_call_strike)"
    df = df.filter(f"entry_credit > 0 AND entry_credit < {width} * {P.MULTIPLIER}D")
    return add(df, {"defined_max_loss": Co.max_loss("entry_credit")})


def opportunity_panel(calendar: DataFrame, candidates: DataFrame, marks: DataFrame) -> DataFrame:
    """Outcome of every selectable candidate held 5 or 10 sessions, or to a week before expiry."""
    keys = Co.own(candidates)
    day_keys = [*keys, "session_date"]
    days = C.session_calendar(calendar, keys)
    exits = candidates.select(*day_keys, "expiry").join(days.select(*day_keys, "ordinal"), day_keys)
    week = C.first_session_from(days, keys).selectExpr(
        *keys, "day AS _week", "first_session AS _week_session", "first_ordinal AS _week_ordinal"
    )
    exits = add(exits, {"_week": "date_sub(expiry, 7)"}).join(week, [*keys, "_week"], "left")
    plan = (
        "array_compact(array(struct('H5' AS horizon, ordinal + 5 AS o), struct('H10' AS horizon, ordinal + 10 AS o), "
        f"CASE WHEN _week_session <= expiry THEN struct('{P.PRIMARY_HORIZON}' AS horizon, _week_ordinal AS o) END))"
    )
    exits = exits.selectExpr(*day_keys, f"{plan} AS exits")
    path = marked_paths(calendar, candidates, marks).join(exits, day_keys)
    reach = path.withColumn("x", F.expr("explode(filter(exits, e -> path_ordinal <= e.o))")).drop("exits")
    reach = add(reach, {"horizon": "x.horizon", "_exit": "x.o"})
    packed = f"struct({', '.join(P.LEGS)}, combo, path_date, path_ordinal)"
    base = [
        "signal_session_date", "expiry", "state_category", "phase", "dynamic_unit", "raw_dynamic_unit", "risk_reason",
        "global_status", "local_status", "insurance_compensation", "spot_entry", "entry_ordinal",
        *[f"{leg}_{f}" for leg in P.LEGS for f in ("code", "strike")],
    ]
    base = [b for b in base if b in reach.columns]
    whole = "combo IS NOT NULL"
    out = reach.groupBy(*day_keys, "horizon").agg(
        *[F.expr(f"any_value({b}) AS {b}") for b in base],
        F.expr("any_value(_exit) AS _exit"),
        F.expr(f"max(CASE WHEN path_ordinal = entry_ordinal AND {whole} THEN {packed} END) AS _in"),
        F.expr(f"max(CASE WHEN path_ordinal = _exit AND {whole} THEN {packed} END) AS _out"),
        # The first highest combo mark is the first worst return.
        F.expr(f"min(CASE WHEN {whole} THEN struct(-combo AS m, path_ordinal, path_date) END) AS _worst"),
        F.expr(f"count_if({whole}) AS _marked"),
        F.expr("min(path_spot) AS path_spot_min"),
        F.expr("max(path_spot) AS path_spot_max"),
    )
    out = out.filter("_in IS NOT NULL AND _out IS NOT NULL")
    out = _entry_terms(add(out, {"entry_credit": "_in.combo"}))
    m = f"{P.MULTIPLIER}D"
    out = add(
        out,
        {
            "exit_date": "_out.path_date",
            "holding_sessions": "_exit - entry_ordinal",
            "exit_debit": "_out.combo",
            "pnl_per_combo": "entry_credit - _out.combo",
            "put_side_pnl": f"{m} * (_in.short_put - _out.short_put + _out.long_put - _in.long_put)",
            "call_side_pnl": f"{m} * (_in.short_call - _out.short_call + _out.long_call - _in.long_call)",
            "max_adverse_excursion": "(entry_credit + _worst.m) / defined_max_loss",
            "mae_date": "_worst.path_date",
            "path_mark_coverage": "_marked / (_exit - entry_ordinal + 1)",
            "put_short_breached": "coalesce(path_spot_min < short_put_strike, false)",
            "call_short_breached": "coalesce(path_spot_max > short_call_strike, false)",
            "dte": "datediff(expiry, session_date)",
            "credit_to_max_loss": "entry_credit / defined_max_loss",
            "risk_unit": "coalesce(dynamic_unit, 0D)",
        },
    )
    return add(
        out,
        {
            "return_on_max_loss": "pnl_per_combo / defined_max_loss",
            "loss_side": "if(call_side_pnl < put_side_pnl, 'CALL', 'PUT')",
        },
    ).drop("_in", "_out", "_worst", "_marked", "_exit", "entry_ordinal", "dynamic_unit").withColumnsRenamed(
        {"raw_dynamic_unit": "raw_risk_unit"}
    )


def stress_panel(calendar: DataFrame, contracts: DataFrame, surface: DataFrame) -> DataFrame:
    """Realised volatility and moves after each session against the lagged implied vol."""
    keys = Co.own(calendar)
    day_keys = [*keys, "session_date"]
    days = Co.ordered_sessions(calendar)
    over = S.by(keys, "session_date")
    days = add(
        days,
        {
            "state_category": Co.timing_category(),
            "_r": f"CASE WHEN etf_mark > 0 AND lag(etf_mark) OVER ({over}) > 0 THEN ln(etf_mark / lag(etf_mark) OVER ({over})) END",
            "_good": "coalesce(etf_mark > 0 AND etf_mark < double('Infinity'), false)",
            "_l": "CASE WHEN etf_mark > 0 THEN ln(etf_mark) END",
        },
    )
    horizons = (5, 10, 20)
    columns: dict[str, str] = {}
    for h in horizons:
        ahead = f"OVER ({over} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
        columns[f"_ok{h}"] = f"count_if(_good) OVER ({over} ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING) = {h + 1}"
        columns[f"_sd{h}"] = f"stddev_samp(_r) {ahead} * sqrt(252D)"
        columns[f"_hi{h}"] = f"greatest(max(_l) {ahead} - _l, 0D)"
        columns[f"_lo{h}"] = f"least(min(_l) {ahead} - _l, 0D)"
        columns[f"_end{h}"] = f"lead(session_date, {h}) OVER ({over})"
    days = add(days, columns)
    picked = Co.nearest_expiry(Co.in_tenor(contracts)).groupBy(*day_keys).agg(F.expr("max(maturity_date) AS maturity_date"))
    lagged = Co.lagged_vol(surface).withColumnRenamed("sigma", "lagged_atm_iv")
    df = days.join(picked, day_keys).join(lagged, [*keys, "previous", "maturity_date"])
    rows = ", ".join(
        f"CASE WHEN _ok{h} THEN named_struct('h', {h}, 'rv', _sd{h}, 'hi', _hi{h}, 'lo', _lo{h}, 'e', _end{h}) END" for h in horizons
    )
    df = add(df, {"x": f"explode(array_compact(array({rows})))"})
    df = add(df, {"expected_move": "lagged_atm_iv * sqrt(x.h / 252D)"})
    return df.selectExpr(
        *day_keys,
        "x.e AS future_end_date",
        "maturity_date AS expiry",
        "concat('H', x.h) AS horizon",
        "state_category",
        "coalesce(phase, 'UNKNOWN') AS phase",
        "coalesce(dynamic_unit, 0D) AS risk_unit",
        "lagged_atm_iv",
        "x.rv AS future_realized_vol",
        "x.rv / lagged_atm_iv AS realized_to_implied",
        "expected_move",
        "greatest(x.hi, -x.lo) / expected_move AS normalized_max_move",
        "x.hi AS maximum_up_move",
        "x.lo AS maximum_down_move",
    )


MODES = ("STATIC_KNOWN_UNIVERSE", "KNOWN_BLOCK_EXIT", "ALL_ZERO_EXIT")


def state_exits(calendar: DataFrame, candidates: DataFrame, marks: DataFrame) -> DataFrame:
    """First marked day after entry on which a candidate's exit rule holds, per rule."""
    keys = Co.own(candidates)
    day_keys = [*keys, "session_date"]
    path = add(
        marked_paths(calendar, candidates, marks),
        {"_in": f"max(CASE WHEN path_ordinal = entry_ordinal THEN combo END) OVER (PARTITION BY {', '.join(day_keys)})"},
    )
    week = "CASE WHEN datediff(expiry, path_date) <= 7 THEN 'DTE_7' END"
    block = f"CASE WHEN path_category = 'KNOWN_BLOCK' THEN 'STATE_KNOWN_BLOCK' ELSE {week} END"
    zero = f"CASE WHEN path_category <> 'ALLOW' THEN concat('STATE_', path_category) ELSE {week} END"
    modes = (
        f"array(struct('{MODES[0]}' AS mode, state_category <> 'ABSTAIN_DATA' AS enter, {week} AS exit_reason), "
        f"struct('{MODES[1]}' AS mode, state_category = 'ALLOW' AS enter, {block} AS exit_reason), "
        f"struct('{MODES[2]}' AS mode, state_category = 'ALLOW' AS enter, {zero} AS exit_reason))"
    )
    later = path.filter("path_ordinal > entry_ordinal AND combo IS NOT NULL AND _in IS NOT NULL")
    later = add(later, {"m": f"explode({modes})"}).filter("m.enter AND m.exit_reason IS NOT NULL")
    first = later.groupBy(*day_keys, F.expr("m.mode AS mode")).agg(
        F.expr("min(struct(path_ordinal, path_date, combo, m.exit_reason AS exit_reason, path_category)) AS x"),
        *[
            F.expr(f"any_value({c}) AS {c}")
            for c in ("expiry", "state_category", "phase", "dynamic_unit", *[f"{leg}_strike" for leg in P.LEGS])
        ],
        F.expr("any_value(_in) AS entry_credit"),
    )
    out = _entry_terms(first)
    return out.selectExpr(
        *keys,
        "mode",
        "session_date AS entry_date",
        "x.path_date AS exit_date",
        "expiry",
        "state_category AS entry_state_category",
        "phase AS entry_phase",
        "coalesce(dynamic_unit, 0D) AS entry_risk_unit",
        "x.path_category AS exit_state_category",
        "x.exit_reason AS exit_reason",
        "datediff(x.path_date, session_date) AS holding_calendar_days",
        "entry_credit",
        "x.combo AS exit_debit",
        "defined_max_loss",
        "entry_credit - x.combo AS pnl_per_combo",
        "(entry_credit - x.combo) / defined_max_loss AS return_on_max_loss",
    )


# ---- summaries ------------------------------------------------------------------

KNOWN = "state_category <> 'ABSTAIN_DATA'"
GROUP_STATS = (
    "count(1) AS n",
    "avg(return_on_max_loss) AS mean_return_on_max_loss",
    "median(return_on_max_loss) AS median_return_on_max_loss",
    "avg(CASE WHEN return_on_max_loss > 0 THEN 1D ELSE 0D END) AS win_rate",
    "avg(max_adverse_excursion) AS mean_max_adverse_excursion",
    "min(return_on_max_loss) AS worst_return_on_max_loss",
)
STRESS_STATS = (
    "count(1) AS n",
    "avg(realized_to_implied) AS mean_realized_to_implied",
    "median(realized_to_implied) AS median_realized_to_implied",
    "avg(normalized_max_move) AS mean_normalized_max_move",
    "avg(CASE WHEN normalized_max_move >= 1 THEN 1D ELSE 0D END) AS expected_move_breach_rate",
)


def grouped(df: DataFrame, keys: list[str], stats: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(s) for s in stats])


def group_statistics(panel: DataFrame) -> DataFrame:
    """Outcome statistics by category, risk unit and phase, in one long table and one pass over the panel."""
    groups = (
        "array_compact(array(struct('category' AS group_kind, state_category AS group_value), "
        f"CASE WHEN {KNOWN} THEN struct('risk_unit' AS group_kind, string(risk_unit) AS group_value) END, "
        f"CASE WHEN {KNOWN} THEN struct('phase' AS group_kind, phase AS group_value) END))"
    )
    rows = add(panel, {"_g": f"explode({groups})"})
    rows = add(rows, {"group_kind": "_g.group_kind", "group_value": "_g.group_value"})
    return grouped(rows, [*Co.own(panel), "horizon", "group_kind", "group_value"], GROUP_STATS)


def _tail(panel: DataFrame, value: str, quantile: float, worse: str) -> DataFrame:
    """Known rows beyond a quantile of their horizon, flagged."""
    known = panel.filter(KNOWN)
    keys = [*Co.own(panel), "horizon"]
    cut = known.groupBy(*keys).agg(F.expr(f"percentile({value}, {quantile}) AS threshold"))
    return add(known.join(cut, keys), {"bad": f"{value} {worse} threshold"})


def tail_capture(panel: DataFrame) -> DataFrame:
    """How many of the worst tenth of outcomes the blocking state caught."""
    df = _tail(panel, "return_on_max_loss", 0.10, "<=")
    block, allow = "state_category = 'KNOWN_BLOCK'", "state_category = 'ALLOW'"
    out = df.groupBy(*Co.own(panel), "horizon").agg(
        F.expr("any_value(threshold) AS threshold"),
        F.expr("count_if(bad) AS bad_opportunity_days"),
        F.expr(f"count_if(bad AND {block}) AS blocked_bad_opportunity_days"),
        F.expr(f"count_if(bad AND {allow}) AS allowed_bad_opportunity_days"),
        F.expr(f"count_if({block}) AS _blocked"),
        F.expr(f"count_if({allow}) AS _allowed"),
        F.expr("count(1) AS _n"),
        F.expr("count(DISTINCT CASE WHEN bad THEN expiry END) AS bad_expiry_clusters"),
    )
    out = add(
        out,
        {
            "block_capture_rate": "try_divide(double(blocked_bad_opportunity_days), bad_opportunity_days)",
            "baseline_block_rate": "_blocked / _n",
            "allowed_bad_rate": "allowed_bad_opportunity_days / greatest(_allowed, 1)",
            "blocked_bad_rate": "blocked_bad_opportunity_days / greatest(_blocked, 1)",
        },
    )
    return add(out, {"capture_lift": "try_divide(block_capture_rate, baseline_block_rate)"}).drop("_blocked", "_allowed", "_n")


def count_maps(panel: DataFrame) -> DataFrame:
    """Counts of the bad tail by loss side, phase and expiry."""
    bad = _tail(panel, "return_on_max_loss", 0.10, "<=").filter("bad")
    pairs = "explode(array(struct('loss_side' AS kind, loss_side AS value), struct('phase' AS kind, phase AS value), struct('expiry' AS kind, string(expiry) AS value))) AS p"
    keys = [*Co.own(panel), "horizon"]
    counts = bad.selectExpr(*keys, pairs).groupBy(*keys, F.expr("p.kind AS kind"), F.expr("p.value AS value")).count()
    # One entry per distinct label: sides, phases and expiries are short lists.
    return counts.groupBy(*keys, "kind").agg(
        F.expr("map_from_entries(array_sort(collect_list(struct(value, count)))) AS counts")
    )


def mean_differences(panel: DataFrame) -> DataFrame:
    """ALLOW minus KNOWN_BLOCK: plain, expiry-balanced, and without the worst ALLOW expiry."""
    known = panel.filter(KNOWN)
    keys = [*Co.own(panel), "horizon"]
    per = known.groupBy(*keys, "expiry").agg(
        *[
            F.expr(f"{f}(CASE WHEN state_category = '{c}' THEN return_on_max_loss END) AS {f}_{n}")
            for c, n in (("ALLOW", "a"), ("KNOWN_BLOCK", "b"))
            for f in ("sum", "count")
        ]
    )
    per = add(per, {"_ma": "CASE WHEN count_a > 0 THEN sum_a / count_a END", "_mb": "CASE WHEN count_b > 0 THEN sum_b / count_b END"})
    worst = "min(CASE WHEN _ma IS NOT NULL THEN struct(_ma, expiry, sum_a AS s, count_a AS c, sum_b AS sb, count_b AS cb) END)"
    out = per.groupBy(*keys).agg(
        F.expr("sum(sum_a) AS sa"), F.expr("sum(count_a) AS ca"), F.expr("sum(sum_b) AS sb"), F.expr("sum(count_b) AS cb"),
        F.expr("avg(_ma) - avg(_mb) AS expiry_balanced_allow_minus_block_mean"), F.expr(f"{worst} AS w"),
    )
    rest_a = "try_divide(sa - coalesce(w.s, 0D), double(ca - w.c))"
    rest_b = "try_divide(coalesce(sb, 0D) - coalesce(w.sb, 0D), double(cb - w.cb))"
    return out.selectExpr(
        *keys,
        "try_divide(sa, double(ca)) - try_divide(sb, double(cb)) AS allow_minus_block_mean",
        "expiry_balanced_allow_minus_block_mean",
        "w.expiry AS worst_allowed_expiry",
        f"{rest_a} - {rest_b} AS allow_minus_block_without_worst_expiry",
    )


def cluster_bootstrap(panel: DataFrame, *, draws: int = 2000, seed: int = 20260821, table: Bo.Draws = Bo.seeded) -> DataFrame:
    """Expiry-cluster bootstrap of ALLOW minus KNOWN_BLOCK, seeded.

    Clusters are reduced to sums and counts first, so a horizon is one row with an entry per expiry (a dozen a year),
    and a replicate adds up the entries it has drawn.
    """
    keys = [*Co.own(panel), "horizon"]
    per = panel.filter(KNOWN).groupBy(*keys, "expiry").agg(
        *[
            F.expr(f"double(coalesce({f}(CASE WHEN state_category = '{c}' THEN return_on_max_loss END), 0)) AS {f}_{n}")
            for c, n in (("ALLOW", "a"), ("KNOWN_BLOCK", "b"))
            for f in ("sum", "count")
        ]
    )
    held = per.groupBy(*keys).agg(
        F.expr("count(1) AS n"), F.expr("sort_array(collect_list(struct(expiry, sum_a, count_a, sum_b, count_b))) AS c"),
        F.expr("sum(count_a) > 0 AND sum(count_b) > 0 AND count(1) >= 2 AS _both"),
    )
    held = add(held, {"slots": "n", "seed": f"{seed}L"})
    drawn = table(held.filter("_both").select(*keys, "n", "slots", "seed"), keys, draws).join(held.select(*keys, "c"), keys)
    drawn = add(drawn, {f"_{v}": Bo.total(f"c[int(i)].{v}") for v in ("sum_a", "count_a", "sum_b", "count_b")})
    drawn = add(drawn.filter("_count_a > 0 AND _count_b > 0"), {"delta": "_sum_a / _count_a - _sum_b / _count_b"})
    found = drawn.groupBy(*keys).agg(
        F.expr("int(count(1)) AS draws"), F.expr("percentile(delta, 0.025) AS ci_lower"), F.expr("percentile(delta, 0.975) AS ci_upper"),
        F.expr("avg(int(delta > 0)) AS probability_allow_better"),
    )
    out = held.selectExpr(*keys, "int(n) AS clusters").join(found, keys, "left")
    return add(out, {"draws": "coalesce(draws, 0)"})


def spearman(df: DataFrame, keys: list[str], x: str, y: str, out: str = "rho") -> DataFrame:
    """Rank correlation with average ranks; NULL under 3 rows or without variation.

    Values are first reduced to counts per distinct value, so ties cost one row;
    running sums over ranges of values give each its average rank.
    """
    rows = df.filter(f"{x} IS NOT NULL AND {y} IS NOT NULL").selectExpr(*keys, f"double({x}) AS x", f"double({y}) AS y")
    ranked = rows.join(B.value_ranks(rows, keys, "x", "_rank_x"), [*keys, "x"]).join(B.value_ranks(rows, keys, "y", "_rank_y"), [*keys, "y"])
    stats = ranked.groupBy(*keys).agg(
        F.expr("count(1) AS n"), F.expr("min(x) < max(x) AND min(y) < max(y) AS _vary"), F.expr("try_divide(covar_pop(_rank_x, _rank_y), stddev_pop(_rank_x) * stddev_pop(_rank_y)) AS _rho")
    )
    return stats.selectExpr(*keys, "n", f"CASE WHEN n >= 3 AND _vary THEN _rho END AS {out}")


def timing_summary(panel: DataFrame) -> DataFrame:
    """The whole summary, one row per horizon: counts, mean differences, tail capture, rank correlation, conclusion."""
    keys = [*Co.own(panel), "horizon"]
    counts = panel.groupBy(*keys).agg(
        F.expr("count(1) AS opportunities"),
        F.expr(f"count_if({KNOWN}) AS known_opportunities"),
        F.expr("count_if(state_category = 'ALLOW') AS allowed_opportunities"),
        F.expr("count_if(state_category = 'KNOWN_BLOCK') AS blocked_opportunities"),
        F.expr(f"count(DISTINCT CASE WHEN {KNOWN} THEN expiry END) AS expiry_clusters"),
    )
    rho = spearman(panel.filter(KNOWN), keys, "risk_unit", "return_on_max_loss", "risk_unit_rank_correlation").drop("n")
    out = counts
    for part in (mean_differences(panel), tail_capture(panel), rho):
        out = out.join(part, keys, "left")
    d, lift = "allow_minus_block_mean", "capture_lift"
    return add(
        out,
        {
            "conclusion": f"CASE WHEN {d} < 0 AND {lift} < 1 THEN 'IN_SAMPLE_TIMING_NOT_SUPPORTED' "
            f"WHEN {d} > 0 AND {lift} > 1 THEN 'IN_SAMPLE_TIMING_SUPPORTED' ELSE 'IN_SAMPLE_TIMING_INCONCLUSIVE' END"
        },
    )


def conclusion(panel: DataFrame) -> DataFrame:
    """The summary of the primary horizon."""
    return timing_summary(panel.filter(f"horizon = '{P.PRIMARY_HORIZON}'"))


def worst_opportunities(panel: DataFrame, rows: int = 20) -> DataFrame:
    known = panel.filter(f"horizon = '{P.PRIMARY_HORIZON}' AND {KNOWN}")
    return known.orderBy("return_on_max_loss", "session_date", *Co.own(panel)).limit(rows)


def stress_summary(panel: DataFrame) -> DataFrame:
    """Category statistics, tail capture and the ALLOW minus KNOWN_BLOCK ratio per horizon."""
    keys = [*Co.own(panel), "horizon"]
    cats = grouped(panel, [*keys, "state_category"], STRESS_STATS)
    tail = _tail(panel, "realized_to_implied", 0.90, ">=").groupBy(*keys).agg(
        F.expr("any_value(threshold) AS threshold"),
        F.expr("count(1) AS known_days"),
        F.expr("count_if(bad) AS tail_days"),
        F.expr("count_if(bad AND state_category = 'KNOWN_BLOCK') AS blocked_tail_days"),
        F.expr("count_if(state_category = 'KNOWN_BLOCK') / count(1) AS baseline_block_rate"),
        F.expr(
            "avg(CASE WHEN state_category = 'ALLOW' THEN realized_to_implied END) "
            "- avg(CASE WHEN state_category = 'KNOWN_BLOCK' THEN realized_to_implied END) AS allow_minus_block_realized_to_implied"
        ),
    )
    tail = add(tail, {"block_capture_rate": "blocked_tail_days / tail_days"})
    tail = add(tail, {"capture_lift": "try_divide(block_capture_rate, baseline_block_rate)"})
    return cats.join(tail, keys, "left")


def state_path_summary(ledger: DataFrame) -> DataFrame:
    out = ledger.groupBy(*Co.own(ledger), "mode").agg(
        F.expr("count(1) AS closed_cycles"),
        F.expr("sum(pnl_per_combo) AS total_pnl"),
        F.expr("sum(defined_max_loss) AS sum_defined_max_loss"),
        F.expr("avg(return_on_max_loss) AS mean_return_on_max_loss"),
        F.expr("median(return_on_max_loss) AS median_return_on_max_loss"),
        F.expr("avg(CASE WHEN pnl_per_combo > 0 THEN 1D ELSE 0D END) AS win_rate"),
        F.expr("min(return_on_max_loss) AS worst_return_on_max_loss"),
        F.expr("avg(holding_calendar_days) AS average_holding_calendar_days"),
    )
    return add(out, {"pnl_over_sum_defined_max_loss": "try_divide(total_pnl, sum_defined_max_loss)"})


def matched_exits(ledger: DataFrame, panel: DataFrame) -> DataFrame:
    """State exit against the fixed exit of the same entry."""
    keys = Co.own(ledger)
    fixed = panel.filter(f"horizon = '{P.PRIMARY_HORIZON}'").selectExpr(
        *keys, "session_date AS entry_date", "pnl_per_combo AS fixed_pnl", "return_on_max_loss AS fixed_return"
    )
    out = ledger.filter(f"mode <> '{MODES[0]}'").join(fixed, [*keys, "entry_date"]).groupBy(*keys, "mode").agg(
        F.expr("count(1) AS matched_cycles"),
        F.expr("sum(pnl_per_combo) AS state_exit_total_pnl"),
        F.expr("sum(fixed_pnl) AS fixed_to_7dte_total_pnl"),
        F.expr("sum(defined_max_loss) AS _risk"),
        F.expr("min(return_on_max_loss) AS state_exit_worst_return"),
        F.expr("min(fixed_return) AS fixed_worst_return"),
    )
    return add(
        out,
        {
            "state_exit_minus_fixed_pnl": "state_exit_total_pnl - fixed_to_7dte_total_pnl",
            "state_exit_pnl_over_loss": "try_divide(state_exit_total_pnl, _risk)",
            "fixed_pnl_over_loss": "try_divide(fixed_to_7dte_total_pnl, _risk)",
        },
    ).drop("_risk")
