"""Ledger metrics on a NAV ledger derived from the daily panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from volpanel.functions.num import add
from volpanel.operators import metrics as Me
from volpanel.operators import series as S
from volpanel.registry.base import register, shared, step
from volpanel.registry.q_condor import exits
from volpanel.sources.views import view

COMMON = "1998-01-02"
_RET = "0.09731234567891e0 * (iv30_mf - 19e0) / 1000e0 - CASE WHEN n % 13 = 0 THEN 0.01e0 ELSE 0e0 END + 1.70123456789e-7 * dayofyear(session_date) * n"
_scenarios = (
    "('SV_STATIC', 'VWAP_2TICK', 2e0, 0.08e0, 1e0), ('SV_DYNAMIC', 'VWAP_2TICK', 2e0, 0.08e0, 0.8e0), "
    "('SV_STATIC', 'VWAP_2TICK', 2e0, 0.05e0, 0.7e0), ('SV_DYNAMIC', 'VWAP_2TICK', 2e0, 0.05e0, 0.6e0), "
    "('SV_STATIC', 'BAR_EXTREME', 5e0, 0.08e0, 1.1e0), ('SV_DYNAMIC', 'BAR_EXTREME', 5e0, 0.08e0, 0.9e0)"
)
# A ledger in the shape the metrics read: one NAV path per strategy and scenario.
step(
    "nav_ledger",
    f"""SELECT economic_index_id, session_date, strategy, fill_scenario, broker_fee_per_contract, risk_budget, 1e6 * exp(sum(ln(1e0 + r)) OVER w) AS nav, r AS daily_return,
         CASE WHEN n % 4 = 0 THEN 0e0 ELSE 0.5e0 END AS risk_unit, CAST(n % 4 AS DOUBLE) AS position_quantity, 1e0 * count(*) OVER w AS fees_cumulative
       FROM (SELECT p.economic_index_id, p.session_date, p.n, s.*, s.k * ({_RET}) AS r FROM v_panel p, (VALUES {_scenarios}) s(strategy, fill_scenario, broker_fee_per_contract, risk_budget, k)) q
       WINDOW w AS (PARTITION BY economic_index_id, strategy, fill_scenario, broker_fee_per_contract, risk_budget ORDER BY session_date)""",
)
_path = "economic_index_id, strategy, fill_scenario, broker_fee_per_contract, risk_budget"
step(
    "rebased",
    f"""SELECT *, coalesce(nav / lag(nav) OVER w - 1e0, 0e0) AS daily_return FROM (
        SELECT session_date, {_path}, risk_unit, position_quantity, 1e6 * nav / first_value(nav) OVER v AS nav, fees_cumulative - first_value(fees_cumulative) OVER v AS fees_cumulative
        FROM nav_ledger WHERE session_date >= DATE '{COMMON}' WINDOW v AS (PARTITION BY {_path} ORDER BY session_date)) q WINDOW w AS (PARTITION BY {_path} ORDER BY session_date)""",
)


def _columns_sql(source: str) -> str:
    return f"""SELECT *, nav / max(nav) OVER (PARTITION BY {_path} ORDER BY session_date) - 1e0 AS drawdown,
        CASE WHEN count(*) OVER w20 = 20 THEN product(1e0 + daily_return) OVER w20 - 1e0 END AS rolling_20, quantile_cont(daily_return, 0.05) OVER (PARTITION BY {_path}) AS cut
        FROM {source} WINDOW w20 AS (PARTITION BY {_path} ORDER BY session_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""


def _metrics_sql(source: str, period: str) -> str:
    return f"""SELECT '{period}' AS period, {_path}, min(session_date) AS start, max(session_date) AS "end", count(*) AS sessions, arg_max(nav, session_date) AS ending_value,
        arg_max(nav, session_date) / 1e6 - 1e0 AS total_return, pow(arg_max(nav, session_date) / 1e6, 365.2425e0 / date_diff('day', min(session_date), max(session_date))) - 1e0 AS cagr,
        stddev_samp(daily_return) * sqrt(252e0) AS annualized_volatility, avg(daily_return) / stddev_samp(daily_return) * sqrt(252e0) AS sharpe_zero_cash_rate,
        min(drawdown) AS max_drawdown, arg_min(session_date, (drawdown, session_date)) AS max_drawdown_date, min(daily_return) AS worst_session_return, min(rolling_20) AS worst_20_session_return,
        avg(daily_return) FILTER (WHERE daily_return <= cut) AS expected_shortfall_95, avg(CAST(daily_return > 0 AS INT)) AS positive_session_rate, avg(risk_unit) AS average_risk_unit,
        avg(CAST(position_quantity > 0 AS INT)) AS invested_session_rate, arg_max(fees_cumulative, session_date) AS fees
        FROM {source} GROUP BY ALL"""


step("path_full", _columns_sql("nav_ledger"))
step("path_common", _columns_sql("rebased"))
step("metrics_full", _metrics_sql("path_full", "full_period"))
step("metrics_common", _metrics_sql("path_common", "common_period"))


@shared
def ledger(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scenarios.split("), (")
    structs = []
    for row in rows:
        s, f, b, r, k = (x.strip(" ()") for x in row.split(","))
        structs.append(
            f"named_struct('strategy', {s}, 'fill_scenario', {f}, 'broker_fee_per_contract', double({b}), 'risk_budget', double({r}), 'k', double({k}))"
        )
    p = view(spark, folder, "panel")
    df = p.selectExpr("economic_index_id", "session_date", "n", "iv30_mf", f"explode(array({', '.join(structs)})) AS s").select(
        "economic_index_id", "session_date", "n", "iv30_mf", "s.*"
    )
    df = add(df, {"daily_return": f"k * ({_RET})"})
    w = S.by(["economic_index_id", *Me.PATH], "session_date")
    return add(
        df,
        {
            "nav": f"1e6 * exp(sum(ln(1D + daily_return)) OVER ({w}))",
            "risk_unit": "CASE WHEN n % 4 = 0 THEN 0D ELSE 0.5D END",
            "position_quantity": "double(n % 4)",
            "fees_cumulative": f"double(count(1) OVER ({w}))",
        },
    ).drop("n", "iv30_mf", "k")


_p = "economic_index_id strategy fill_scenario broker_fee_per_contract~ risk_budget~"


@register("w08_drawdown", f"session_date {_p} drawdown~", "SELECT * FROM path_full")
def _(spark, folder):
    return Me.path_columns(ledger(spark, folder))


@register("w09_compounded_20", f"session_date {_p} rolling_20~", "SELECT * FROM path_full")
def _(spark, folder):
    return Me.path_columns(ledger(spark, folder))


@register("w13_percent_change", f"session_date {_p} daily_return~", "SELECT * FROM rebased")
def _(spark, folder):
    return Me.rebase(ledger(spark, folder), COMMON)


_m = (
    f"period {_p} start end sessions# ending_value~3 total_return~ cagr~ annualized_volatility~ sharpe_zero_cash_rate~ max_drawdown~ max_drawdown_date "
    "worst_session_return~ worst_20_session_return~ expected_shortfall_95~ positive_session_rate~ average_risk_unit~ invested_session_rate~ fees~"
).replace("start end", "first_session last_session")
_rename = 'SELECT *, start AS first_session, "end" AS last_session FROM '


@register("a19_path_metrics", _m, _rename + "metrics_full")
def _(spark, folder):
    m = add(Me.path_metrics(ledger(spark, folder)), {"period": "'full_period'"})
    return m.withColumnsRenamed({"start": "first_session", "end": "last_session"})


@register("a20_rebased_metrics", _m, _rename + "metrics_common")
def _(spark, folder):
    m = add(Me.path_metrics(Me.rebase(ledger(spark, folder), COMMON)), {"period": "'common_period'"})
    return m.withColumnsRenamed({"start": "first_session", "end": "last_session"})


@register(
    "a21_yearly_returns",
    "economic_index_id year# SV_STATIC~ SV_DYNAMIC~",
    """SELECT economic_index_id, year, max(r) FILTER (WHERE strategy = 'SV_STATIC') AS SV_STATIC, max(r) FILTER (WHERE strategy = 'SV_DYNAMIC') AS SV_DYNAMIC FROM (
       SELECT economic_index_id, year(session_date) AS year, strategy, product(1e0 + daily_return) - 1e0 AS r FROM nav_ledger WHERE fill_scenario = 'VWAP_2TICK' AND risk_budget = 0.08e0 GROUP BY 1, 2, 3) q GROUP BY 1, 2""",
)
def _(spark, folder):
    primary = ledger(spark, folder).filter("fill_scenario = 'VWAP_2TICK' AND risk_budget = 0.08D")
    return Me.yearly_returns(primary, ["SV_STATIC", "SV_DYNAMIC"])


_sides = ", ".join(
    f"max({m}) FILTER (WHERE strategy = '{s}') AS {p}_{m}"
    for s, p in (("SV_STATIC", "static"), ("SV_DYNAMIC", "dynamic"))
    for m in ("ending_value", "total_return", "max_drawdown")
)
_side_cols = " ".join(f"{p}_{m}~3" for p in ("static", "dynamic") for m in ("ending_value", "total_return", "max_drawdown"))


@register(
    "a22_sensitivity",
    f"economic_index_id fill_scenario broker_fee_per_contract~ risk_budget~ {_side_cols}",
    f"SELECT economic_index_id, fill_scenario, broker_fee_per_contract, risk_budget, {_sides} FROM metrics_full GROUP BY 1, 2, 3, 4",
)
def _(spark, folder):
    m = Me.path_metrics(ledger(spark, folder))
    return Me.sensitivity(
        m, ["economic_index_id", "fill_scenario", "broker_fee_per_contract", "risk_budget"], {"SV_STATIC": "static", "SV_DYNAMIC": "dynamic"}
    )


_window = "CASE exit_reason WHEN 'DTE_7' THEN 'EXPIRY_INTRINSIC_SETTLEMENT' ELSE 'EXIT_PM1' END"


@register(
    "a23_execution_diagnostics",
    "economic_index_id strategy exit_fill_rows# contracts_closed# expiry_settlement_rows# expiry_settlement_contracts# realized_pnl~3 fees~3",
    f"""SELECT economic_index_id, mode AS strategy, count(*) AS exit_fill_rows, sum(holding_calendar_days) AS contracts_closed, count(*) FILTER (WHERE exit_reason = 'DTE_7') AS expiry_settlement_rows,
        coalesce(sum(holding_calendar_days) FILTER (WHERE exit_reason = 'DTE_7'), 0) AS expiry_settlement_contracts, sum(pnl_per_combo) AS realized_pnl, sum(holding_calendar_days * 3.2e0) AS fees
        FROM state_exit_ledger GROUP BY 1, 2""",
)
def _(spark, folder):
    trades = exits(spark, folder).selectExpr(
        "economic_index_id", "mode AS strategy", "holding_calendar_days AS quantity", f"{_window} AS exit_window", "pnl_per_combo AS realized_pnl",
        "holding_calendar_days * 3.2D AS fees",
    )
    return Me.execution_diagnostics(trades)


step(
    "benchmark",
    """SELECT *, coalesce(nav / lag(nav) OVER (PARTITION BY economic_index_id ORDER BY session_date) - 1e0, nav / 1e6 - 1e0) AS daily_return FROM (
       SELECT s.economic_index_id, s.session_date, 1e6 - f.shares * f.p - greatest(5e0, f.shares * f.p * 0.0003e0) + f.shares * f.p * s.tr_mark / (f.p * f.tr / f.em) AS nav, f.shares AS position_quantity, greatest(5e0, f.shares * f.p * 0.0003e0) AS fees_cumulative
       FROM v_spot s JOIN (SELECT economic_index_id, max(k) * 100 AS shares, any_value(p) AS p, any_value(tr_mark) AS tr, any_value(etf_mark) AS em FROM (
         SELECT *, entry_vwap + 0.002e0 AS p, unnest(range(0, CAST(floor(1e6 / (entry_vwap + 0.002e0) / 100) AS BIGINT) + 1)) AS k FROM (SELECT * FROM v_spot WHERE tr_mark > 0 QUALIFY row_number() OVER (PARTITION BY economic_index_id ORDER BY session_date) = 1) a) b
         WHERE k * 100 * p + greatest(5e0, k * 100 * p * 0.0003e0) <= 1e6 GROUP BY 1) f USING (economic_index_id) WHERE s.tr_mark > 0) q""",
)


@register("x21_buy_and_hold", "economic_index_id session_date nav~3 daily_return~ position_quantity~ fees_cumulative~", "SELECT * FROM benchmark")
def _(spark, folder):
    return Me.buy_and_hold(view(spark, folder, "spot"))


@register("x23_ledger_report", _m, f"{_rename} (SELECT * FROM metrics_full UNION ALL SELECT * FROM metrics_common) u")
def _(spark, folder):
    return Me.period_metrics(ledger(spark, folder), COMMON).withColumnsRenamed({"start": "first_session", "end": "last_session"})
