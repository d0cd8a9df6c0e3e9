"""Derived option-market tables over the benchmark tables.

The benchmark data holds no options, so each table an operator needs (a daily
index panel, an option chain, contracts, bars, marks) is a view over
``lineitem``, ``orders`` or ``events`` that grows with it. The same definition
serves Spark and the SQL check; the few functions that differ between the two
dialects are spelled by :class:`Dialect`.

Values are kept exact across engines: integer sums first, one division, one
rounding written as round(x * 1eN) / 1eN, which gives the same bits everywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from volpanel.session import stored

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def add_days(self, date: str, days: str) -> str:
        return f"date_add({date}, CAST({days} AS INT))" if self.spark else f"({date} + CAST({days} AS INTEGER))"

    def days_between(self, end: str, start: str) -> str:
        return f"datediff({end}, {start})" if self.spark else f"date_diff('day', {start}, {end})"

    def month_start(self, date: str) -> str:
        return f"trunc({date}, 'MM')" if self.spark else f"CAST(date_trunc('month', {date}) AS DATE)"

    def add_months(self, date: str, months: str) -> str:
        if self.spark:
            return f"add_months({date}, CAST({months} AS INT))"
        return f"CAST({date} + to_months(CAST({months} AS INTEGER)) AS DATE)"

    def clock(self, ts: str) -> str:
        return f"date_format({ts}, 'HH:mm:ss')" if self.spark else f"strftime({ts}, '%H:%M:%S')"

    def moment(self, date: str, clock: str) -> str:
        kind = "TIMESTAMP_NTZ" if self.spark else "TIMESTAMP"
        return f"CAST(concat(CAST({date} AS STRING), ' ', {clock}) AS {kind})"

    def compact(self, date: str) -> str:
        return f"date_format({date}, 'yyyyMMdd')" if self.spark else f"strftime({date}, '%Y%m%d')"

    def each_day(self, start: str, end: str) -> str:
        if self.spark:
            return f"explode(sequence({start}, {end}, interval 1 day))"
        return f"CAST(unnest(generate_series({start}, {end}, INTERVAL 1 DAY)) AS DATE)"

    def each_of(self, values: str) -> str:
        return f"explode(array({values}))" if self.spark else f"unnest([{values}])"


SPARK = Dialect(True)
DUCK = Dialect(False)


def _panel(d: Dialect) -> str:
    return """
    SELECT session_date, economic_index_id,
           CASE economic_index_id WHEN 'SSE50' THEN 'SSE50_510050' WHEN 'CSI300' THEN 'CSI300_510300'
                WHEN 'CSI500' THEN 'CSI500_510500' ELSE 'STAR50_588000' END AS carrier_id,
           n, qty,
           (round((14e0 + disc / n + common) * 1e4) / 1e4) AS iv30_mf,
           (round((14.5e0 + (disc + tax) / (2e0 * n) + 0.85e0 * common) * 1e4) / 1e4) AS iv60_mf,
           (round((15e0 + tax / n + 0.7e0 * common) * 1e4) / 1e4) AS iv90_mf,
           CASE WHEN qty % 97 = 0 THEN NULL ELSE (round((0.1e0 * qty / n - 1e0 + 0.3e0 * common) * 1e4) / 1e4) END AS down_skew25,
           (round((0.4e0 * ln / n - 0.8e0 - 0.1e0 * common) * 1e4) / 1e4) AS up_skew25,
           (round((14e0 + disc / n + common - 0.8e0) * 1e4) / 1e4) AS atm_iv30,
           CASE WHEN n % 5 = 0 THEN 'NEAREST_EXPIRY_PROXY' ELSE 'TOTAL_VARIANCE_INTERPOLATION' END AS iv30_method,
           CASE WHEN n % 7 = 0 THEN 'NEAREST_EXPIRY_PROXY' ELSE 'TOTAL_VARIANCE_INTERPOLATION' END AS iv60_method,
           CASE WHEN ln % 9 = 0 THEN 'NEAREST_EXPIRY_PROXY' ELSE 'TOTAL_VARIANCE_INTERPOLATION' END AS iv90_method,
           'TOTAL_VARIANCE_INTERPOLATION' AS atm_iv30_method,
           CASE WHEN qty % 97 = 0 THEN 'UNAVAILABLE' ELSE 'TOTAL_VARIANCE_INTERPOLATION' END AS iv_25d_put30_method,
           CASE WHEN ln % 13 = 0 THEN 'TOTAL_VARIANCE_INTERPOLATION+NEAREST_DELTA_PROXY'
                ELSE 'TOTAL_VARIANCE_INTERPOLATION' END AS iv_25d_call30_method,
           CASE WHEN qty % 97 = 0 THEN 'DEGRADED' ELSE 'VALID' END AS surface_status,
           concat(CASE WHEN n % 5 = 0 THEN 'IV30_NEAREST_EXPIRY_PROXY' ELSE '' END,
                  CASE WHEN n % 5 = 0 AND qty % 97 = 0 THEN '|' ELSE '' END,
                  CASE WHEN qty % 97 = 0 THEN 'PUT25_30_UNAVAILABLE' ELSE '' END) AS issues,
           (round((3e0 + 0.02e0 * (cents / (qty * 100e0) / 2000e0 - 1e0) - 0.002e0 * common) * 1e6) / 1e6) AS etf_mark,
           (round((1.25e0 * (3e0 + 0.02e0 * (cents / (qty * 100e0) / 2000e0 - 1e0) - 0.002e0 * common)) * 1e6) / 1e6) AS tr_mark
    FROM (SELECT *, CASE dayofyear(session_date) % 23 WHEN 0 THEN 6e0 WHEN 1 THEN 5e0 WHEN 2 THEN 3e0 ELSE 0e0 END
                    + (abs(dayofyear(session_date) % 120 - 60) - 30) / 10e0 AS common
          FROM (SELECT CAST(l_shipdate AS DATE) AS session_date,
                       CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'SSE50' WHEN 'NF' THEN 'CSI300'
                            WHEN 'NO' THEN 'CSI500' WHEN 'AO' THEN 'CSI500' ELSE 'STAR50' END AS economic_index_id,
                       count(*) AS n,
                       sum(CAST(l_quantity AS BIGINT)) AS qty,
                       sum(CAST(round(l_extendedprice * 100e0) AS BIGINT)) AS cents,
                       sum(CAST(round(l_discount * 100e0) AS BIGINT)) AS disc,
                       sum(CAST(round(l_tax * 100e0) AS BIGINT)) AS tax,
                       sum(CAST(l_linenumber AS BIGINT)) AS ln
                FROM {lineitem}
                GROUP BY 1, 2) cells) waved
    """


DAYS = "SELECT DISTINCT CAST(l_shipdate AS DATE) AS session_date FROM {lineitem}"


def _calendar(d: Dialect) -> str:
    return f"""
    SELECT session_date, CAST(row_number() OVER (ORDER BY session_date) - 1 AS BIGINT) AS ordinal
    FROM ({DAYS}) days
    """


def _chain(d: Dialect) -> str:
    session = d.month_start("CAST(l_shipdate AS DATE)")
    return f"""
    SELECT session_date, carrier_id, economic_index_id, contract_id, option_type, strike, expiry,
           contract_unit, contract_unit = 10000 AS is_standard, spot,
           CASE WHEN bad THEN 0e0
                WHEN option_type = 'P' THEN (round((put + noise) * 1e6) / 1e6)
                ELSE (round((put + df * (fwd - strike) + noise) * 1e6) / 1e6) END AS price,
           daily_volume, daily_amount, open_interest
    FROM (SELECT *, (round((df * greatest(strike - fwd, 0e0)
                          + 0.1e0 * sqrt(t) * exp(-4e0 * (strike - fwd) * (strike - fwd) / greatest(4e0 * t, 0.2e0))) * 1e6) / 1e6) AS put
          FROM (SELECT *, spot / df AS fwd
                FROM (SELECT *, (round((exp(-0.018e0 * t)) * 1e8) / 1e8) AS df,
                             {d.add_days("session_date", "days")} AS expiry
                      FROM (SELECT {session} AS session_date,
                                   concat(carrier_code, '') AS carrier_id, index_code AS economic_index_id,
                                   concat('L', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',
                                          CAST(l_partkey AS STRING)) AS contract_id,
                                   CASE WHEN l_linenumber % 2 = 0 THEN 'C' ELSE 'P' END AS option_type,
                                   (round((2.4e0 + 0.05e0 * (l_partkey % 25)) * 1e2) / 1e2) AS strike,
                                   CASE l_suppkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 45 WHEN 2 THEN 75 ELSE 120 END AS days,
                                   (CASE l_suppkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 45 WHEN 2 THEN 75 ELSE 120 END) / 365e0 AS t,
                                   3e0 + 0.01e0 * (month(l_shipdate) - 6) AS spot,
                                   CASE WHEN l_tax >= 0.08e0 THEN 10265 ELSE 10000 END AS contract_unit,
                                   0.0001e0 * (l_linenumber - 4) AS noise,
                                   l_discount >= 0.1e0 AND l_linenumber = 7 AS bad,
                                   CAST(l_quantity AS BIGINT) AS daily_volume,
                                   CAST(round(l_extendedprice) AS BIGINT) AS daily_amount,
                                   CAST(l_orderkey % 1000 AS BIGINT) AS open_interest
                            FROM (SELECT *, CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'SSE50_510050'
                                         WHEN 'NF' THEN 'CSI300_510300' WHEN 'NO' THEN 'CSI500_510500'
                                         WHEN 'AO' THEN 'CSI500_510500' ELSE 'STAR50_588000' END AS carrier_code,
                                         CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'SSE50'
                                         WHEN 'NF' THEN 'CSI300' WHEN 'NO' THEN 'CSI500' WHEN 'AO' THEN 'CSI500' ELSE 'STAR50' END AS index_code
                                  FROM {{lineitem}}) tagged
                           ) base) priced) forwarded) quoted
    """


def _contract_rows(d: Dialect) -> str:
    """Contract master as delivered: compact text dates, one row per order."""
    listed = d.compact("o_orderdate")
    expiry = d.compact(d.add_days("CAST(o_orderdate AS DATE)", "30 + o_orderkey % 60"))
    return f"""
    SELECT o_orderkey AS code,
           CASE o_custkey % 5 WHEN 0 THEN 'OP510050.SH' WHEN 1 THEN 'OP510300.SH' WHEN 2 THEN 'OP510500.SH'
                WHEN 3 THEN 'OP588000.SH' ELSE 'OP588080.SH' END AS opt_code,
           CASE WHEN o_orderkey % 2 = 0 THEN 'C' ELSE 'P' END AS call_put,
           concat(CAST((round((2e0 + 0.05e0 * (o_custkey % 41)) * 1e2) / 1e2) AS STRING),
                  CASE WHEN o_orderkey % 37 = 0 THEN '?' ELSE '' END) AS exercise_price,
           CASE WHEN o_orderkey % 41 = 0 THEN 'n/a' ELSE {expiry} END AS maturity_date,
           CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 10265 ELSE 10000 END AS per_unit,
           CASE WHEN o_orderkey % 7 = 0 THEN 10265 ELSE 10000 END AS opt_multiplier,
           concat(o_orderstatus, CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 11 = 0 THEN 'A' ELSE 'M' END) AS symbol,
           {listed} AS list_date, {expiry} AS delist_date, 0.0001e0 AS min_price_chg
    FROM {{orders}}
    """


def _option_minutes(d: Dialect) -> str:
    return f"""
    SELECT l_orderkey AS code, {d.compact("l_shipdate")} AS date, CAST(l_shipdate AS DATE) AS session_date,
           CASE l_linenumber WHEN 1 THEN '09:35:00' WHEN 2 THEN '09:36:00' WHEN 3 THEN '09:40:00'
                WHEN 4 THEN '13:35:00' WHEN 5 THEN '14:46:00' WHEN 6 THEN '14:50:00' ELSE '14:56:00' END AS bar_time,
           (round((l_extendedprice / l_quantity / 10000e0) * 1e6) / 1e6) AS close,
           (round((l_extendedprice / l_quantity / 10000e0 * 1.01e0) * 1e6) / 1e6) AS high,
           (round((l_extendedprice / l_quantity / 10000e0 * 0.99e0) * 1e6) / 1e6) AS low,
           CAST(l_quantity AS BIGINT) - 1 AS vol,
           CAST(round(l_extendedprice) AS BIGINT) AS amount,
           CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_partkey AS BIGINT) END AS oi
    FROM {{lineitem}}
    """


def _option_daily(d: Dialect) -> str:
    """One record per contract, on its first day: minutes of its later days have none."""
    first = "CAST(min(l_shipdate) AS DATE)"
    return f"""
    SELECT l_orderkey AS code, {d.compact("min(l_shipdate)")} AS date, {first} AS session_date,
           CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS vol,
           CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS amount,
           CAST(CASE WHEN min(l_suppkey) % 4 = 0 THEN NULL ELSE sum(l_suppkey) END AS BIGINT) AS oi,
           CASE WHEN min(l_linenumber) = 2 THEN NULL ELSE (round((min(l_extendedprice / l_quantity) / 10000e0) * 1e6) / 1e6) END AS settle,
           CASE WHEN max(l_linenumber) = 2 THEN NULL ELSE (round((max(l_extendedprice / l_quantity) / 10000e0) * 1e6) / 1e6) END AS close
    FROM {{lineitem}} GROUP BY 1
    """


BAR_MINUTES = (
    "09:35:00 09:36:00 09:40:00 09:45:00 09:46:00 10:30:00 13:31:00 13:40:00 14:46:00 14:55:00 14:56:00 15:00:00"
).split()


def _bars(d: Dialect) -> str:
    """Minute bars: every event belongs to one of the minutes of its day."""
    minute = " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(BAR_MINUTES))
    return f"""
    SELECT code, session_date, {d.moment("session_date", "clock")} AS bar_time, clock, close,
           (round((high * 1.01e0) * 1e4) / 1e4) AS high, (round((low * 0.99e0) * 1e4) / 1e4) AS low, vol, amount
    FROM (SELECT event_type AS code, CAST(ts AS DATE) AS session_date,
                 CASE event_id % {len(BAR_MINUTES)} {minute} END AS clock,
                 max_by(value, event_id) AS close, max(value) AS high, min(value) AS low,
                 CAST(sum(CAST(event_id % 50 AS BIGINT)) AS BIGINT) AS vol,
                 CAST(sum(CAST(round(value * 100e0) AS BIGINT) * CAST(event_id % 50 AS BIGINT)) AS BIGINT) AS amount
          FROM {{events}} GROUP BY 1, 2, 3) minutes
    """


def _bar_daily(d: Dialect) -> str:
    return """
    SELECT event_type AS code, CAST(ts AS DATE) AS session_date, 1e0 + (count(*) % 7) / 100e0 AS adj_factor
    FROM {events} GROUP BY 1, 2
    """


def _listed(d: Dialect) -> str:
    """Standard contracts on a month-end grid, one row per (underlying, expiry, kind, strike)."""
    expiry = d.add_days(d.add_months(d.month_start("CAST(o_orderdate AS DATE)"), "2 + o_orderkey % 2"), "22")
    return f"""
    SELECT concat(economic_index_id, '-', call_put, '-', {d.compact("maturity_date")}, '-', CAST(step AS STRING)) AS code, economic_index_id, call_put,
           (round((2e0 + 0.05e0 * step) * 1e2) / 1e2) AS exercise_price, list_date, maturity_date, 0.0001e0 AS min_price_chg, step
    FROM (SELECT CASE o_custkey % 4 WHEN 0 THEN 'SSE50' WHEN 1 THEN 'CSI300' WHEN 2 THEN 'CSI500' ELSE 'STAR50' END AS economic_index_id,
                 CASE WHEN o_orderkey % 2 = 0 THEN 'C' ELSE 'P' END AS call_put, CAST(o_custkey % 41 AS BIGINT) AS step,
                 {expiry} AS maturity_date, min(CAST(o_orderdate AS DATE)) AS list_date
          FROM {{orders}} GROUP BY 1, 2, 3, 4) grid
    """


def _spot(d: Dialect) -> str:
    """Marks and opening anchors of every underlying per session."""
    return f"""
    SELECT economic_index_id, session_date, etf_mark, tr_mark,
           CASE WHEN n % 9 = 0 THEN NULL ELSE (round((etf_mark * 1.001e0) * 1e6) / 1e6) END AS spot_0935,
           (round((etf_mark * 1.002e0) * 1e6) / 1e6) AS entry_vwap
    FROM ({_panel(d)}) p
    """


def _expiry_iv(d: Dialect) -> str:
    """At-the-money vol (percent) per session for the next four listed expiries."""
    expiry = d.add_days(d.add_months(d.month_start("session_date"), "ahead"), "22")
    return f"""
    SELECT session_date, economic_index_id, {expiry} AS expiry,
           CASE WHEN (n + ahead) % 17 = 0 THEN NULL ELSE iv30_mf + ahead END AS atm_iv
    FROM (SELECT session_date, economic_index_id, n, iv30_mf, {d.each_of("0, 1, 2, 3")} AS ahead
          FROM ({_panel(d)}) p) grid
    """


def _marks(d: Dialect) -> str:
    """Daily settlement and close of every listed contract on every session of its underlying in its life."""
    gap = d.days_between("maturity_date", "m.session_date")
    return f"""
    SELECT session_date, code, mark,
           CASE WHEN pick % 11 = 0 THEN NULL ELSE mark END AS settle,
           CASE WHEN pick % 143 = 0 THEN NULL ELSE mark END AS close,
           pick % 12 AS positive_minutes, (pick * 7) % 400 AS volume
    FROM (SELECT s.session_date, m.code,
                 (round((greatest(CASE WHEN call_put = 'C' THEN s.etf_mark - exercise_price ELSE exercise_price - s.etf_mark END, 0e0)
                       + 0.06e0 * sqrt({gap} + 1e0) / 6e0
                         * exp(-3e0 * abs(exercise_price - s.etf_mark))) * 1e6) / 1e6) AS mark,
                 CAST({gap} * 13 + step * 7 + CASE WHEN call_put = 'C' THEN 3 ELSE 0 END AS BIGINT) AS pick
          FROM (SELECT *, {d.each_day("list_date", "maturity_date")} AS session_date FROM ({_listed(d)}) l) m
          JOIN ({_spot(d)}) s ON s.session_date = m.session_date AND s.economic_index_id = m.economic_index_id) marked
    """


VIEWS: dict[str, Callable[[Dialect], str]] = {
    "panel": _panel,
    "calendar": _calendar,
    "chain": _chain,
    "contract_rows": _contract_rows,
    "option_minutes": _option_minutes,
    "option_daily": _option_daily,
    "bars": _bars,
    "bar_daily": _bar_daily,
    "listed": _listed,
    "spot": _spot,
    "expiry_iv": _expiry_iv,
    "marks": _marks,
}


def duck_view(name: str) -> str:
    text = VIEWS[name](DUCK)
    for table in TABLES:
        text = text.replace("{" + table + "}", table)
    return text.replace("AS STRING", "AS VARCHAR")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Views of which others are made, as small as days or listings: raw rows are reduced to them once per session and folder.
SHARED = ("panel", "listed")
_STORED: dict[tuple[str, str, str], DataFrame] = {}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    text = VIEWS[name](SPARK)
    if name not in SHARED:
        for part in SHARED:
            text = text.replace(VIEWS[part](SPARK), f"SELECT * FROM {{{part}}}")
        text = text.replace(DAYS, "SELECT DISTINCT session_date FROM {panel}")
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STORED:
        used = {t: table(spark, folder, t) for t in TABLES if "{" + t + "}" in text}
        used |= {part: view(spark, folder, part) for part in SHARED if "{" + part + "}" in text}
        found = spark.sql(text, **used)
        if name not in SHARED:
            return found
        # small files share a split, but what is unfolded from these rows is large
        _STORED[key] = stored(found, name).repartition(spark.sparkContext.defaultParallelism)
    return _STORED[key]
