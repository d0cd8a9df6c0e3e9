"""Scans, filters, predicates, joins and set operations on the source tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from volpanel import params as P
from volpanel.functions import num, tri
from volpanel.functions.num import add
from volpanel.operators import calendar as C
from volpanel.operators import quality as Q
from volpanel.registry.base import register, step
from volpanel.registry.q_condor import opportunities, selection, stress
from volpanel.registry.q_events import calendar
from volpanel.registry.q_state import k_of
from volpanel.sources import scans as Sc
from volpanel.sources.views import table, view

U = P.DEFAULT_UNIVERSE
_codes = ", ".join(f"'{m.option_code}'" for m in U.members)
_case = {
    f: "CASE opt_code " + " ".join(f"WHEN '{m.option_code}' THEN '{getattr(m, a)}'" for m in U.members) + " END"
    for f, a in (("carrier_id", "carrier"), ("economic_index_id", "index"), ("underlying_symbol", "underlying"))
}


def _date(c: str) -> str:
    return f"CAST(try_strptime({c}, '%Y%m%d') AS DATE)"


step(
    "master",
    f"""SELECT code AS contract_id, opt_code AS option_underlying_code, call_put AS option_type, TRY_CAST(exercise_price AS DOUBLE) AS strike, {_date('maturity_date')} AS expiry,
        coalesce(per_unit, opt_multiplier) AS contract_unit, symbol, {_date('list_date')} AS list_date, {_date('delist_date')} AS delist_date,
        coalesce(per_unit = 10000 AND opt_multiplier = 10000 AND symbol NOT LIKE '%A%', false) AS is_standard,
        {', '.join(f'{c} AS {f}' for f, c in _case.items())} FROM v_contract_rows WHERE opt_code IN ({_codes})""",
)
step(
    "observations",
    """SELECT m.session_date, m.code AS contract_id, c.option_underlying_code, c.carrier_id, c.option_type, c.strike, c.expiry, c.contract_unit, c.is_standard, m.close AS price, m.vol AS minute_volume,
       coalesce(d.vol, 0) AS daily_volume, coalesce(d.amount, 0) AS daily_amount, coalesce(d.oi, m.oi, 0) AS open_interest
       FROM v_option_minutes m JOIN master c ON c.contract_id = m.code LEFT JOIN v_option_daily d ON d.code = m.code AND d.session_date = m.session_date
       WHERE m.bar_time = '14:56:00' AND c.list_date <= m.session_date AND c.delist_date >= m.session_date""",
)


def observations(spark, folder, **bounds):
    return Sc.option_observations(
        view(spark, folder, "option_minutes"), view(spark, folder, "contract_rows"), view(spark, folder, "option_daily"), **bounds
    )


_obs = "session_date contract_id option_underlying_code carrier_id option_type strike~ expiry contract_unit# is_standard price~ minute_volume# daily_volume# daily_amount# open_interest#"


@register("s01_fixed_bar_scan", _obs, "SELECT * FROM observations WHERE session_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")
def _(spark, folder):
    return observations(spark, folder, start="1996-01-01", end="2000-12-31")


@register("p01_open_ended_bounds", "session_date rows#", "SELECT session_date, count(*) AS rows FROM v_option_minutes WHERE session_date >= DATE '1998-01-01' GROUP BY 1")
def _(spark, folder):
    m = view(spark, folder, "option_minutes").filter(num.open_range("session_date", "1998-01-01", None))
    return m.groupBy("session_date").agg(F.expr("count(1) AS rows"))


@register(
    "p02_time_of_day",
    "code hour# rows#",
    "SELECT code, hour(bar_time) AS hour, count(*) AS rows FROM v_bars WHERE clock BETWEEN '09:30:00' AND '15:00:00' GROUP BY 1, 2",
)
def _(spark, folder):
    b = view(spark, folder, "bars").filter("clock BETWEEN '09:30:00' AND '15:00:00'")
    return b.groupBy("code", F.expr("hour(bar_time) AS hour")).agg(F.expr("count(1) AS rows"))


@register("j01_contract_validity_join", _obs, "SELECT * FROM observations")
def _(spark, folder):
    return observations(spark, folder)


@register("j02_daily_fallback", "session_date contract_id daily_volume# open_interest#", "SELECT * FROM observations")
def _(spark, folder):
    return observations(spark, folder)


_master = "contract_id option_underlying_code option_type strike~ expiry contract_unit# symbol list_date delist_date is_standard carrier_id economic_index_id underlying_symbol"


@register("s02_contract_master", _master, "SELECT * FROM master")
def _(spark, folder):
    return Sc.contract_master(view(spark, folder, "contract_rows"))


@register("p05_code_mapping", "carrier_id economic_index_id underlying_symbol contracts#", "SELECT carrier_id, economic_index_id, underlying_symbol, count(*) AS contracts FROM master GROUP BY 1, 2, 3")
def _(spark, folder):
    m = Sc.contract_master(view(spark, folder, "contract_rows"))
    return m.groupBy("carrier_id", "economic_index_id", "underlying_symbol").agg(F.expr("count(1) AS contracts"))


@register(
    "p08_text_to_date_number",
    "code expiry strike~",
    f"SELECT code, {_date('maturity_date')} AS expiry, TRY_CAST(exercise_price AS DOUBLE) AS strike FROM v_contract_rows",
)
def _(spark, folder):
    return view(spark, folder, "contract_rows").selectExpr(
        "code", f"{num.compact_date('maturity_date')} AS expiry", "try_cast(exercise_price AS DOUBLE) AS strike"
    )


@register(
    "s07_standard_contracts",
    "code call_put exercise_price~ list_date maturity_date",
    f"""SELECT code, call_put, TRY_CAST(exercise_price AS DOUBLE) AS exercise_price, {_date('list_date')} AS list_date, {_date('maturity_date')} AS maturity_date FROM v_contract_rows
        WHERE opt_code = 'OP510300.SH' AND per_unit = 10000 AND opt_multiplier = 10000 AND NOT contains(symbol, 'A') AND TRY_CAST(exercise_price AS DOUBLE) IS NOT NULL AND {_date('maturity_date')} IS NOT NULL""",
)
def _(spark, folder):
    return Sc.standard_contracts(view(spark, folder, "contract_rows"), "OP510300.SH")


step("mark_bar", "SELECT session_date, code, close AS etf_mark FROM v_bars WHERE clock = '14:56:00'")


@register(
    "s03_underlying_marks",
    "session_date code etf_mark~ adj_factor~ tr_mark~",
    "SELECT b.*, d.adj_factor, b.etf_mark * d.adj_factor AS tr_mark FROM mark_bar b JOIN v_bar_daily d USING (session_date, code)",
)
def _(spark, folder):
    return Sc.underlying_marks(view(spark, folder, "bars"), view(spark, folder, "bar_daily"))


@register(
    "j03_adjustment_join",
    "session_date code adj_factor~",
    "SELECT b.session_date, b.code, d.adj_factor FROM mark_bar b JOIN v_bar_daily d USING (session_date, code)",
)
def _(spark, folder):
    return Sc.underlying_marks(view(spark, folder, "bars"), view(spark, folder, "bar_daily"))


@register(
    "s04_opening_anchors",
    "code session_date spot_0935~ entry_vwap~ entry_high~ entry_low~",
    """SELECT code, session_date, max(close) FILTER (WHERE clock = '09:35:00') AS spot_0935,
       sum(amount) FILTER (WHERE clock >= '09:36:00' AND clock <= '09:45:00') / nullif(sum(vol) FILTER (WHERE clock >= '09:36:00' AND clock <= '09:45:00'), 0) AS entry_vwap,
       max(high) FILTER (WHERE clock IN ('09:36:00', '09:40:00', '09:45:00')) AS entry_high, min(low) FILTER (WHERE clock IN ('09:36:00', '09:40:00', '09:45:00')) AS entry_low FROM v_bars GROUP BY 1, 2""",
)
def _(spark, folder):
    return Sc.opening_anchors(view(spark, folder, "bars"))


_win = "CASE WHEN {c} BETWEEN '09:36:00' AND '09:45:00' THEN 'OPEN_AM' WHEN {c} BETWEEN '13:31:00' AND '13:40:00' THEN 'EXIT_PM1' WHEN {c} BETWEEN '14:46:00' AND '14:55:00' THEN 'EXIT_PM2' END"


def _windows_sql(source: str, c: str) -> str:
    return f"""SELECT session_date, code, {_win.format(c=c)} AS fill_window, count(*) FILTER (WHERE vol > 0) AS positive_minutes, sum(vol) FILTER (WHERE vol > 0) AS volume,
        sum(amount) FILTER (WHERE vol > 0) / nullif(sum(vol) FILTER (WHERE vol > 0), 0) / 10000 AS vwap, max(high) AS high, min(low) AS low FROM {source} GROUP BY 1, 2, 3"""


_wcols = "session_date code fill_window positive_minutes# volume# vwap~ high~ low~"


@register("s05_execution_windows", _wcols, f"SELECT * FROM ({_windows_sql('v_option_minutes', 'bar_time')}) q WHERE fill_window IS NOT NULL AND code IN (SELECT contract_id FROM master WHERE is_standard)")
def _(spark, folder):
    standard = Sc.contract_master(view(spark, folder, "contract_rows")).filter("is_standard").selectExpr("contract_id AS code")
    return Sc.execution_windows(view(spark, folder, "option_minutes"), standard, clock="bar_time")


@register("a01_conditional_aggregates", _wcols, f"SELECT * FROM ({_windows_sql('v_bars', 'clock')}) q WHERE fill_window IS NOT NULL")
def _(spark, folder):
    return Sc.execution_windows(view(spark, folder, "bars"))


@register(
    "s09_source_summary",
    "carrier_id contract_rows# standard_contracts# first_listing last_expiry expiries#",
    """SELECT carrier_id, count(*) AS contract_rows, count(*) FILTER (WHERE is_standard) AS standard_contracts, min(list_date) AS first_listing, max(expiry) AS last_expiry, count(DISTINCT expiry) AS expiries FROM master GROUP BY 1""",
)
def _(spark, folder):
    return Sc.source_summary(Sc.contract_master(view(spark, folder, "contract_rows")))


@register("a32_first_listing", "carrier_id listing_date", "SELECT carrier_id, min(list_date) AS listing_date FROM master GROUP BY 1")
def _(spark, folder):
    return Sc.first_listings(Sc.contract_master(view(spark, folder, "contract_rows")))


@register("s08_pruned_reread", "o_orderstatus orders#", "SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY 1")
def _(spark, folder):
    return Sc.scan(spark, f"{folder}/orders.parquet", ["o_orderstatus"]).groupBy("o_orderstatus").agg(F.expr("count(1) AS orders"))


@register(
    "p04_universe_guard",
    "opt_code rows#",
    f"SELECT opt_code, count(*) AS rows FROM v_contract_rows WHERE opt_code IN ({_codes}) AND opt_code <> 'OP588080.SH' GROUP BY 1",
)
def _(spark, folder):
    rows = Q.exclude(view(spark, folder, "contract_rows"), "opt_code", U.excluded_option_codes)
    rows = Q.require_members(rows.filter(f"opt_code IN ({_codes})"), "opt_code", [m.option_code for m in U.members], U.excluded_option_codes)
    return rows.groupBy("opt_code").agg(F.expr("count(1) AS rows"))


@register(
    "j04_common_sessions",
    "source session_date rows#",
    """SELECT 'OPTION' AS source, session_date, count(*) AS rows FROM observations WHERE session_date IN (SELECT session_date FROM v_spot) GROUP BY 2
       UNION ALL SELECT 'UNDERLYING', session_date, count(*) FROM v_spot WHERE session_date IN (SELECT session_date FROM observations) GROUP BY 2""",
)
def _(spark, folder):
    obs, spot = observations(spark, folder), view(spark, folder, "spot")
    common = Sc.common_sessions(obs, spot)
    rows = lambda df, name: Sc.restrict(df, common).groupBy("session_date").agg(F.expr("count(1) AS rows"), F.expr(f"'{name}' AS source"))
    return rows(obs, "OPTION").unionByName(rows(spot, "UNDERLYING"))


@register(
    "u02_session_intersection",
    "session_date",
    "SELECT session_date FROM v_spot INTERSECT SELECT CAST(o_orderdate AS DATE) FROM orders",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").selectExpr("to_date(o_orderdate) AS session_date")
    return Sc.common_sessions(view(spark, folder, "spot"), orders)


@register(
    "u03_missing_sessions",
    "session_date economic_index_id",
    "SELECT session_date, i AS economic_index_id FROM v_calendar, (SELECT unnest(['SSE50', 'CSI300', 'CSI500', 'STAR50']) AS i) u EXCEPT SELECT session_date, economic_index_id FROM v_panel",
)
def _(spark, folder):
    names = ", ".join(f"'{i}'" for i in U.indices)
    grid = add(calendar(spark, folder).select("session_date"), {"economic_index_id": f"explode(array({names}))"})
    return grid.exceptAll(view(spark, folder, "panel").select("session_date", "economic_index_id"))


@register(
    "u05_full_universe_sessions",
    "session_date rows#",
    "SELECT session_date, count(*) AS rows FROM v_panel GROUP BY 1 HAVING count(DISTINCT economic_index_id) = 4",
)
def _(spark, folder):
    rows = Q.full_universe(view(spark, folder, "panel"), ["session_date"], "economic_index_id", U.indices)
    return rows.groupBy("session_date").agg(F.expr("count(1) AS rows"))


@register(
    "u01_union_ledgers",
    "source economic_index_id session_date reason horizon return_on_max_loss~ realized_to_implied~",
    """SELECT 'REJECT' AS source, economic_index_id, session_date, reason, CAST(NULL AS VARCHAR) AS horizon, CAST(NULL AS DOUBLE) AS return_on_max_loss, CAST(NULL AS DOUBLE) AS realized_to_implied FROM selection WHERE reason IS NOT NULL
       UNION ALL SELECT 'OPPORTUNITY', economic_index_id, session_date, NULL, horizon, return_on_max_loss, NULL FROM opps
       UNION ALL SELECT 'STRESS', economic_index_id, session_date, NULL, horizon, NULL, realized_to_implied FROM stress""",
)
def _(spark, folder):
    rejects = add(selection(spark, folder)[1].select("economic_index_id", "session_date", "reason"), {"source": "'REJECT'"})
    wins = add(opportunities(spark, folder).select("economic_index_id", "session_date", "horizon", "return_on_max_loss"), {"source": "'OPPORTUNITY'"})
    moves = add(stress(spark, folder).select("economic_index_id", "session_date", "horizon", "realized_to_implied"), {"source": "'STRESS'"})
    return rejects.unionByName(wins, allowMissingColumns=True).unionByName(moves, allowMissingColumns=True)


@register(
    "j05_marks_one_to_one",
    "session_date carrier_id iv30_mf~ etf_mark~",
    "SELECT p.session_date, p.carrier_id, p.iv30_mf, s.etf_mark FROM v_panel p LEFT JOIN v_spot s ON s.session_date = p.session_date AND s.economic_index_id = p.economic_index_id",
)
def _(spark, folder):
    from volpanel.operators.features import attach_marks

    carriers = ", ".join(f"'{m.index}', '{m.carrier}'" for m in U.members)
    marks = add(view(spark, folder, "spot"), {"carrier_id": f"map({carriers})[economic_index_id]"}).drop("economic_index_id")
    return attach_marks(view(spark, folder, "panel"), marks)


@register(
    "j09_anchor_mark_join",
    "session_date code spot_0935~ etf_mark~ tr_mark~",
    """SELECT b.session_date, b.code, a.spot_0935, b.etf_mark, b.etf_mark * d.adj_factor AS tr_mark FROM mark_bar b JOIN v_bar_daily d USING (session_date, code)
       JOIN (SELECT code, session_date, max(close) FILTER (WHERE clock = '09:35:00') AS spot_0935 FROM v_bars GROUP BY 1, 2) a USING (session_date, code)""",
)
def _(spark, folder):
    bars = view(spark, folder, "bars")
    anchors = Sc.opening_anchors(bars)
    marks = Sc.underlying_marks(bars, view(spark, folder, "bar_daily"))
    key = ["session_date", "code"]
    return Q.require_unique(anchors, key).join(Q.require_unique(marks, key), key)


# ---- three-valued logic and comparisons on rows of the panel --------------------

_preds = {
    "a": "down_skew25 > 1.5",
    "b": "iv30_mf > 20",
    "c": "CASE WHEN n % 3 = 0 THEN NULL ELSE up_skew25 > 0.8 END",
}
step("flags", "SELECT session_date, economic_index_id, down_skew25 > 1.5 AS a, iv30_mf > 20 AS b, CASE WHEN n % 3 = 0 THEN NULL ELSE up_skew25 > 0.8 END AS c FROM v_panel")


def flags(spark, folder):
    return add(view(spark, folder, "panel"), _preds)


@register(
    "p10_three_valued_logic",
    "session_date economic_index_id not_a and_abc or_abc",
    "SELECT session_date, economic_index_id, NOT a AS not_a, a AND b AND c AS and_abc, a OR b OR c AS or_abc FROM flags",
)
def _(spark, folder):
    return add(flags(spark, folder), {"not_a": tri.negate("a"), "and_abc": tri.all_of("a", "b", "c"), "or_abc": tri.any_of("a", "b", "c")})


@register(
    "p11_counting_under_uncertainty",
    "session_date economic_index_id two_of_three one_only known_count#",
    f"""SELECT session_date, economic_index_id, {k_of(['a', 'b', 'c'], 2)} AS two_of_three,
        CASE WHEN {k_of(['a', 'b', 'c'], 2)} THEN false WHEN {k_of(['a', 'b', 'c'], 2)} IS NULL THEN NULL ELSE {k_of(['a', 'b', 'c'], 1)} END AS one_only,
        CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) AS known_count FROM flags""",
)
def _(spark, folder):
    abc = ["a", "b", "c"]
    return add(
        flags(spark, folder),
        {"two_of_three": tri.at_least_k(abc, 2), "one_only": tri.exactly_one(abc), "known_count": tri.count_if_all_known(abc)},
    )


@register(
    "p15_tolerant_compare",
    "session_date economic_index_id same near",
    """SELECT session_date, economic_index_id, coalesce(down_skew25 IS NOT DISTINCT FROM up_skew25 OR abs(down_skew25 - up_skew25) <= greatest(0.5 * greatest(abs(down_skew25), abs(up_skew25)), 0.5), false) AS same,
       coalesce(iv30_mf IS NOT DISTINCT FROM iv90_mf OR abs(iv30_mf - iv90_mf) <= greatest(0.01 * greatest(abs(iv30_mf), abs(iv90_mf)), 0.01), false) AS near FROM v_panel""",
)
def _(spark, folder):
    return add(
        view(spark, folder, "panel"),
        {"same": num.same_number("down_skew25", "up_skew25", 0.5), "near": num.same_number("iv30_mf", "iv90_mf", 0.01)},
    )


_quotes = """SELECT session_date, carrier_id, contract_id, option_type, strike, CAST(expiry AS VARCHAR) AS expiry, price - 0.0001 AS bid, CASE WHEN open_interest = 7 THEN price - 0.0002 ELSE price + 0.0001 END AS ask,
  session_date + TIME '06:56:57' AS event_time, session_date + CASE WHEN open_interest = 11 THEN TIME '07:00:00' ELSE TIME '06:56:58' END AS available_at,
  CASE WHEN open_interest = 13 THEN 'REVISED' ELSE 'AS_TRADED' END AS vintage_kind, CASE WHEN open_interest = 17 THEN '' ELSE 'r1' END AS revision_id, 'research' AS licence_scope FROM v_chain"""
step("quotes_x", _quotes)


@register(
    "p14_quote_gate",
    "session_date accepted accepted_rows# carrier_count# issue_text",
    """SELECT session_date, issue_text = '' AS accepted, CASE WHEN issue_text = '' THEN n ELSE 0 END AS accepted_rows, carrier_count, issue_text FROM (
       SELECT session_date, count(*) AS n, count(DISTINCT carrier_id) AS carrier_count, array_to_string(list_filter([CASE WHEN count(DISTINCT carrier_id) <> 4 THEN 'FOUR_CARRIER_UNIVERSE_INCOMPLETE' END,
         CASE WHEN bool_or(NOT (bid > 0 AND ask >= bid)) THEN 'INVALID_TWO_SIDED_QUOTE' END, CASE WHEN bool_or(available_at > session_date + TIME '06:56:59') THEN 'PIT_AVAILABILITY_FAILED' END,
         CASE WHEN bool_or(vintage_kind NOT IN ('FIRST_RELEASE', 'AS_TRADED')) THEN 'FORMAL_VINTAGE_FAILED' END, CASE WHEN bool_or(revision_id = '') THEN 'CONTRACT_REVISION_MISSING' END], lambda x: x IS NOT NULL), '|') AS issue_text
       FROM quotes_x GROUP BY 1) q""",
)
def _(spark, folder):
    quotes = view(spark, folder, "chain").selectExpr(
        "session_date", "carrier_id", "contract_id", "option_type", "strike", "string(expiry) AS expiry", "price - 0.0001D AS bid",
        "CASE WHEN open_interest = 7 THEN price - 0.0002D ELSE price + 0.0001D END AS ask",
        "to_utc_timestamp(to_timestamp(concat(session_date, ' 14:56:57')), 'Asia/Shanghai') AS event_time",
        "to_utc_timestamp(to_timestamp(concat(session_date, if(open_interest = 11, ' 15:00:00', ' 14:56:58'))), 'Asia/Shanghai') AS available_at",
        "if(open_interest = 13, 'REVISED', 'AS_TRADED') AS vintage_kind", "if(open_interest = 17, '', 'r1') AS revision_id",
        "'research' AS licence_scope",
    )
    out = Q.validate_quotes(quotes, licence_verified=True)
    return add(out, {"carrier_count": "size(carriers)", "issue_text": "concat_ws('|', issues)"})


@register(
    "m07_date_time",
    "session_date carrier_id expiry year_fraction~9 dte# next_session",
    """SELECT DISTINCT c.session_date, c.carrier_id, c.expiry, (date_diff('day', c.session_date, c.expiry) * 86400e0 + 240e0) / (365e0 * 86400e0) AS year_fraction, date_diff('day', c.session_date, c.expiry) AS dte,
       (SELECT min(session_date) FROM v_calendar k WHERE k.session_date > c.session_date) AS next_session FROM v_chain c""",
)
def _(spark, folder):
    keys = view(spark, folder, "chain").select("session_date", "carrier_id", "expiry").distinct()
    keys = add(
        keys,
        {
            "year_fraction": num.year_fraction("session_date", "expiry"),
            "dte": "datediff(expiry, session_date)",
            "day": "date_add(session_date, 1)",
        },
    )
    nxt = C.first_session_from(calendar(spark, folder)).selectExpr("day", "first_session AS next_session")
    return keys.join(nxt, "day", "left")


@register(
    "m01_guarded_maths",
    "session_date economic_index_id log_ratio~ root~ clipped~ floor_iv#",
    """SELECT session_date, economic_index_id, CASE WHEN down_skew25 > 0 AND up_skew25 > 0 THEN ln(down_skew25 / up_skew25) END AS log_ratio, CASE WHEN up_skew25 >= 0 THEN sqrt(up_skew25) END AS root,
       CASE WHEN down_skew25 IS NOT NULL THEN least(greatest(down_skew25, 1e0), 2e0) END AS clipped, floor(iv30_mf) AS floor_iv FROM v_panel""",
)
def _(spark, folder):
    return add(
        view(spark, folder, "panel"),
        {
            "log_ratio": num.log_ratio("down_skew25", "up_skew25"),
            "root": num.known("CASE WHEN up_skew25 >= 0 THEN sqrt(up_skew25) END"),
            "clipped": num.clip("down_skew25", 1.0, 2.0),
            "floor_iv": "floor(iv30_mf)",
        },
    )


@register(
    "m08_strings",
    "session_date economic_index_id prefix proxies evidence_id",
    """SELECT session_date, economic_index_id, substr(iv30_method, 1, 5) AS prefix, iv30_method LIKE '%PROXY%' OR iv60_method LIKE '%PROXY%' AS proxies,
       lower(economic_index_id) || '.' || right(carrier_id, 6) AS evidence_id FROM v_panel""",
)
def _(spark, folder):
    return add(
        view(spark, folder, "panel"),
        {
            "prefix": "substring(iv30_method, 1, 5)",
            "proxies": "contains(iv30_method, 'PROXY') OR contains(iv60_method, 'PROXY')",
            "evidence_id": "concat_ws('.', lower(economic_index_id), right(carrier_id, 6))",
        },
    )


@register(
    "m09_arrays",
    "session_date economic_index_id issue",
    "SELECT DISTINCT session_date, economic_index_id, unnest(string_split(issues, '|')) AS issue FROM v_panel WHERE issues <> ''",
)
def _(spark, folder):
    rows = view(spark, folder, "panel").filter("issues <> ''")
    return add(rows, {"issue": "explode(array_distinct(split(issues, '[|]')))"})
