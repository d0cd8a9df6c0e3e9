"""Ledger metrics: path statistics, sub-periods, yearly returns, sensitivities, benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel import params as P
from volpanel.functions.num import add
from volpanel.operators import series as S
from volpanel.operators.condor import own

# A path is one strategy under one scenario (and underlying, if there is one): a row per trading day, so its
# windows are bounded by the calendar.
PATH = ["strategy", "fill_scenario", "broker_fee_per_contract", "risk_budget"]


def paths(ledger: DataFrame) -> list[str]:
    return [*own(ledger), *PATH]


def buy_and_hold(calendar: DataFrame, *, capital: float = P.INITIAL_CAPITAL) -> DataFrame:
    """NAV of buying whole lots at the first valid session and holding.

    Lots are the largest multiple of 100 whose cost plus commission fits the
    capital; the commission has a floor, so the fit is solved for both regimes.
    """
    valid = calendar.filter("tr_mark > 0")
    first = "struct(entry_vwap, etf_mark, tr_mark)"
    over = S.by(own(calendar), "session_date")
    df = add(valid, {"_f": f"first_value({first}) OVER ({over})", "_n": f"row_number() OVER ({over})"})
    df = add(df, {"_p": "_f.entry_vwap + 0.002D"})
    lots = (
        f"greatest(0D, floor(least(floor({capital}D / _p / 100D), "
        f"greatest(floor(({capital}D - 5D) / _p / 100D) * int(floor(({capital}D - 5D) / _p / 100D) * 100 * _p * 0.0003D <= 5D), "
        f"floor({capital}D / (1.0003D * _p) / 100D)))))"
    )
    df = add(df, {"_shares": f"{lots} * 100D"})
    df = add(df, {"_cost": "_shares * _p"})
    df = add(df, {"_fee": "greatest(5D, _cost * 0.0003D)"})
    df = add(df, {"nav": f"({capital}D - _cost - _fee) + _cost * tr_mark / (_p * (_f.tr_mark / _f.etf_mark))"})
    df = add(df, {"daily_return": S.percent_change("nav", over, f"nav / {capital}D - 1D")})
    return add(
        df,
        {
            "strategy": "'ETF_BH'",
            "fill_scenario": "'VWAP_2TICK'",
            "broker_fee_per_contract": "2D",
            "risk_budget": f"{P.RISK_BUDGET}D",
            "position_quantity": "_shares",
            "risk_unit": "1D",
            "action": "'BUY_AND_HOLD'",
            "fees_cumulative": "_fee",
        },
    ).drop("_f", "_n", "_p", "_shares", "_cost", "_fee")


def rebase(ledger: DataFrame, start: str, *, capital: float = P.INITIAL_CAPITAL) -> DataFrame:
    """Ledger from a date on, with NAV, returns and fees restarted there."""
    w = S.by(paths(ledger), "session_date")
    df = ledger.filter(f"session_date >= DATE'{start}'")
    df = add(
        df,
        {
            "nav": f"{capital}D * nav / first_value(nav) OVER ({w})",
            "fees_cumulative": f"fees_cumulative - first_value(fees_cumulative) OVER ({w})",
        },
    )
    return add(df, {"daily_return": S.percent_change("nav", w)})


def path_columns(ledger: DataFrame) -> DataFrame:
    w = S.by(paths(ledger), "session_date")
    df = add(ledger, {"daily_return": "coalesce(daily_return, 0D)"})
    return add(df, {"drawdown": S.drawdown("nav", w), "rolling_20": S.compounded_return("daily_return", w, 20)})


def path_metrics(ledger: DataFrame, *, capital: float = P.INITIAL_CAPITAL) -> DataFrame:
    """Return, risk and drawdown statistics of every path."""
    df = path_columns(ledger)
    path = paths(ledger)
    cut = df.groupBy(*path).agg(F.expr("percentile(daily_return, 0.05) AS _cut"))
    out = df.join(cut, path).groupBy(*path).agg(
        F.expr("min(session_date) AS start"),
        F.expr("max(session_date) AS end"),
        F.expr("count(1) AS sessions"),
        F.expr("max_by(nav, session_date) AS ending_value"),
        F.expr("avg(daily_return) AS _mean"),
        F.expr("coalesce(stddev_samp(daily_return), 0D) AS _std"),
        F.expr("min(struct(drawdown, session_date)) AS _dd"),
        F.expr("min(daily_return) AS worst_session_return"),
        F.expr("min(rolling_20) AS worst_20_session_return"),
        F.expr("avg(CASE WHEN daily_return <= _cut THEN daily_return END) AS expected_shortfall_95"),
        F.expr("avg(CASE WHEN daily_return > 0 THEN 1D ELSE 0D END) AS positive_session_rate"),
        F.expr("avg(risk_unit) AS average_risk_unit"),
        F.expr("avg(CASE WHEN position_quantity > 0 THEN 1D ELSE 0D END) AS invested_session_rate"),
        F.expr("max_by(fees_cumulative, session_date) AS fees"),
    )
    out = add(out, {"_years": "greatest(datediff(end, start) / 365.2425D, 1D / 365.2425D)"})
    return add(
        out,
        {
            "total_return": f"ending_value / {capital}D - 1D",
            "cagr": f"pow(ending_value / {capital}D, 1D / _years) - 1D",
            "annualized_volatility": "_std * sqrt(252D)",
            "sharpe_zero_cash_rate": "CASE WHEN _std > 0 THEN _mean / _std * sqrt(252D) END",
            "max_drawdown": "_dd.drawdown",
            "max_drawdown_date": "_dd.session_date",
        },
    ).drop("_mean", "_std", "_dd", "_years")


def period_metrics(ledger: DataFrame, common_start: str = P.COMMON_START) -> DataFrame:
    full = add(path_metrics(ledger), {"period": "'full_period'"})
    common = add(path_metrics(rebase(ledger, common_start)), {"period": "'common_period'"})
    return full.unionByName(common)


def yearly_returns(ledger: DataFrame, strategies: list[str]) -> DataFrame:
    """Compounded return per year, one column per strategy."""
    rows = add(ledger, {"year": "year(session_date)", "_g": "1D + coalesce(daily_return, 0D)"})
    return rows.groupBy(*own(ledger), "year").pivot("strategy", strategies).agg(F.product("_g") - 1.0)


def sensitivity(metrics: DataFrame, keys: list[str], strategies: dict[str, str]) -> DataFrame:
    """Ending value, return and drawdown per scenario, strategies side by side."""
    aggregates = [
        F.expr(f"max(CASE WHEN strategy = '{s}' THEN {m} END) AS {prefix}_{m}")
        for s, prefix in strategies.items()
        for m in ("ending_value", "total_return", "max_drawdown")
    ]
    return metrics.groupBy(*keys).agg(*aggregates)


def execution_diagnostics(trades: DataFrame) -> DataFrame:
    expiry = "exit_window = 'EXPIRY_INTRINSIC_SETTLEMENT'"
    return trades.groupBy(*own(trades), "strategy").agg(
        F.expr("count(1) AS exit_fill_rows"),
        F.expr("sum(quantity) AS contracts_closed"),
        F.expr(f"count_if({expiry}) AS expiry_settlement_rows"),
        F.expr(f"coalesce(sum(CASE WHEN {expiry} THEN quantity END), 0) AS expiry_settlement_contracts"),
        F.expr("sum(realized_pnl) AS realized_pnl"),
        F.expr("sum(fees) AS fees"),
    )
