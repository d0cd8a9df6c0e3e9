"""Scans of the option-market sources: bars, contract master, marks, windows.

Every function takes DataFrames so the caller chooses the layout; ``scan`` is
the plain parquet reader with schema merging. Filters are on typed columns
(DATE, code) so they reach the parquet reader.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel import params as P
from volpanel.functions.num import add, compact_date, open_range, ratio

WINDOWS = {
    "OPEN_AM": ("09:36:00", "09:45:00"),
    "EXIT_PM1": ("13:31:00", "13:40:00"),
    "EXIT_PM2": ("14:46:00", "14:55:00"),
}


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet files whose schemas may differ, reading only the named columns."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df.select(*columns) if columns else df


def _dimension(universe: P.Universe) -> str:
    """Option code to (carrier, index, underlying) as a map literal of fixed size."""
    return "map(" + ", ".join(
        f"'{m.option_code}', named_struct('carrier_id', '{m.carrier}', 'economic_index_id', '{m.index}', 'underlying_symbol', '{m.underlying}')"
        for m in universe.members
    ) + ")"


def contract_master(contracts: DataFrame, universe: P.Universe = P.DEFAULT_UNIVERSE) -> DataFrame:
    """Whitelisted contracts with typed dates, unit fallback and the standard flag."""
    codes = ", ".join(f"'{m.option_code}'" for m in universe.members)
    rows = add(contracts.filter(f"opt_code IN ({codes})"), {"_d": f"{_dimension(universe)}[opt_code]"})
    return rows.selectExpr(
        "code AS contract_id",
        "opt_code AS option_underlying_code",
        "call_put AS option_type",
        "try_cast(exercise_price AS DOUBLE) AS strike",
        f"{compact_date('maturity_date')} AS expiry",
        "coalesce(per_unit, opt_multiplier) AS contract_unit",
        "symbol",
        f"{compact_date('list_date')} AS list_date",
        f"{compact_date('delist_date')} AS delist_date",
        "coalesce(per_unit = 10000 AND opt_multiplier = 10000 AND symbol NOT LIKE '%A%', false) AS is_standard",
        "_d.carrier_id",
        "_d.economic_index_id",
        "_d.underlying_symbol",
    )


def standard_contracts(contracts: DataFrame, option_code: str) -> DataFrame:
    """Unadjusted contracts of one underlying with every required field present."""
    unit = f"{P.MULTIPLIER}D"
    rows = contracts.filter(
        f"opt_code = '{option_code}' AND per_unit = {unit} AND opt_multiplier = {unit} AND NOT contains(symbol, 'A')"
    )
    return rows.selectExpr(
        "code",
        "call_put",
        "try_cast(exercise_price AS DOUBLE) AS exercise_price",
        f"{compact_date('list_date')} AS list_date",
        f"{compact_date('maturity_date')} AS maturity_date",
        f"{compact_date('delist_date')} AS delist_date",
        "try_cast(min_price_chg AS DOUBLE) AS min_price_chg",
    ).dropna(subset=["code", "call_put", "exercise_price", "list_date", "maturity_date"])


def fixed_bar(minutes: DataFrame, *, clock: str = "14:56:00", start: str | None = None, end: str | None = None) -> DataFrame:
    return minutes.filter(f"bar_time = '{clock}'").filter(open_range("session_date", start, end))


def option_observations(
    minutes: DataFrame,
    contracts: DataFrame,
    daily: DataFrame,
    *,
    clock: str = "14:56:00",
    start: str | None = None,
    end: str | None = None,
    universe: P.Universe = P.DEFAULT_UNIVERSE,
) -> DataFrame:
    """One bar per contract and session, inside the contract's life, with daily totals.

    Both joins are equi-joins (code; code and day) with the validity range as a
    residual, so Spark may hash, merge or, when a side turns out small, broadcast.
    """
    m = fixed_bar(minutes, clock=clock, start=start, end=end).selectExpr(
        "session_date", "code AS contract_id", "close AS price", "vol AS minute_volume", "oi AS _minute_oi"
    )
    c = contract_master(contracts, universe)
    d = daily.filter(open_range("session_date", start, end)).selectExpr(
        "session_date", "code AS contract_id", "vol AS _dv", "amount AS _da", "oi AS _doi"
    )
    rows = m.join(c, "contract_id").filter("list_date <= session_date AND delist_date >= session_date")
    rows = rows.join(d, ["contract_id", "session_date"], "left")
    rows = add(
        rows,
        {
            "daily_volume": "coalesce(_dv, 0L)",
            "daily_amount": "coalesce(_da, 0L)",
            "open_interest": "coalesce(_doi, _minute_oi, 0L)",
            "evidence_tier": "'RESEARCH_ONLY'",
            "vintage_kind": "'PROVIDER_RECONSTRUCTED'",
        },
    )
    return rows.drop("_dv", "_da", "_doi", "_minute_oi", "list_date", "delist_date", "symbol")


def underlying_marks(bars: DataFrame, daily: DataFrame, *, clock: str = "14:56:00") -> DataFrame:
    """The bar at the decision time (later ones are not known then) times the day's adjustment factor."""
    at = bars.filter(F.col("clock") == clock).groupBy("session_date", "code").agg(F.expr("max_by(close, bar_time) AS etf_mark"))
    joined = at.join(daily.select("session_date", "code", "adj_factor"), ["session_date", "code"])
    return add(joined, {"tr_mark": "etf_mark * adj_factor"})


def opening_anchors(bars: DataFrame, *, anchor: str = "09:35:00", window: tuple[str, str] = ("09:36:00", "09:45:00")) -> DataFrame:
    """Close at the anchor minute, and VWAP / high / low of the window, per code and day.

    All are conditional sums and extremes: one partial-aggregated shuffle.
    """
    inside = f"clock BETWEEN '{window[0]}' AND '{window[1]}'"
    traded = ratio(f"sum(CASE WHEN {inside} THEN amount END)", f"nullif(sum(CASE WHEN {inside} THEN vol END), 0)")
    return bars.groupBy("code", "session_date").agg(
        F.expr(f"max(CASE WHEN clock = '{anchor}' THEN close END) AS spot_0935"),
        F.expr(f"{traded} AS entry_vwap"),
        F.expr(f"max(CASE WHEN {inside} THEN high END) AS entry_high"),
        F.expr(f"min(CASE WHEN {inside} THEN low END) AS entry_low"),
    )


def execution_windows(
    bars: DataFrame, codes: DataFrame | None = None, *, clock: str = "clock", multiplier: float = P.MULTIPLIER
) -> DataFrame:
    """Positive minutes, volume, VWAP and range of each intraday window."""
    name = "CASE " + " ".join(f"WHEN {clock} BETWEEN '{a}' AND '{b}' THEN '{w}'" for w, (a, b) in WINDOWS.items()) + " END"
    rows = add(bars, {"fill_window": name}).filter("fill_window IS NOT NULL")
    if codes is not None:
        rows = rows.join(codes.select("code").distinct(), "code", "left_semi")
    traded = "CASE WHEN vol > 0 THEN {} END".format
    return rows.groupBy("session_date", "code", "fill_window").agg(
        F.expr("count_if(vol > 0) AS positive_minutes"),
        F.expr(f"sum({traded('vol')}) AS volume"),
        F.expr(f"{ratio('sum(' + traded('amount') + ')', 'nullif(sum(' + traded('vol') + '), 0)')} / {multiplier}D AS vwap"),
        F.expr("max(high) AS high"),
        F.expr("min(low) AS low"),
    )


def common_sessions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sessions present in both tables (one row per trading day)."""
    return left.select("session_date").intersect(right.select("session_date"))


def restrict(df: DataFrame, sessions: DataFrame) -> DataFrame:
    return df.join(sessions, "session_date", "left_semi")


def source_summary(master: DataFrame) -> DataFrame:
    return master.groupBy("carrier_id").agg(
        F.expr("count(1) AS contract_rows"),
        F.expr("count_if(is_standard) AS standard_contracts"),
        F.expr("min(list_date) AS first_listing"),
        F.expr("max(expiry) AS last_expiry"),
        F.expr("count(DISTINCT expiry) AS expiries"),
    )


def first_listings(master: DataFrame) -> DataFrame:
    return master.groupBy("carrier_id").agg(F.expr("min(list_date) AS listing_date"))
