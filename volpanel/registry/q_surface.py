"""Chain, expiry surfaces, constant tenors, carrier surfaces."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.functions import black as B
from volpanel.functions.num import add
from volpanel.operators import surface as Sf
from volpanel.registry.base import register, shared, step
from volpanel.sources.views import view


def duck_cdf(x: str) -> str:
    """The CDF expression with DuckDB's spelling of double literals."""
    return re.sub(r"(\d(?:\.\d*)?(?:e[+-]?\d+)?)D\b", lambda m: m.group(1) if "e" in m.group(1) else m.group(1) + "e0", B.norm_cdf_text(x))


step("eligible", "SELECT * FROM v_chain WHERE contract_unit > 0 AND option_type IN ('C', 'P')")
step(
    "deduped",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_date, carrier_id, expiry, strike, option_type
         ORDER BY open_interest DESC, daily_volume DESC, contract_id) AS rn FROM eligible WHERE price > 0) d WHERE rn = 1""",
)
step(
    "strikes",
    """SELECT session_date, carrier_id, expiry, strike, any_value(spot) AS spot,
       max(CASE WHEN option_type = 'C' THEN price END) AS call_price, max(CASE WHEN option_type = 'P' THEN price END) AS put_price
       FROM deduped GROUP BY 1, 2, 3, 4""",
)
step(
    "band",
    "SELECT *, call_price - put_price AS diff FROM strikes WHERE call_price > 0 AND put_price > 0 AND strike BETWEEN 0.65e0 * spot AND 1.35e0 * spot",
)
step(
    "slopes",
    """SELECT a.session_date, a.carrier_id, a.expiry, median((b.diff - a.diff) / (b.strike - a.strike)) AS pair_slope, count(*) AS slope_pairs
       FROM band a JOIN band b ON a.session_date = b.session_date AND a.carrier_id = b.carrier_id AND a.expiry = b.expiry AND a.strike < b.strike GROUP BY 1, 2, 3""",
)
step(
    "fit0",
    """SELECT e.session_date, e.carrier_id, e.expiry, e.index_id AS economic_index_id, e.spot, (date_diff('day', e.session_date, e.expiry) * 86400e0 + 240e0) / (365e0 * 86400e0) AS year_fraction,
              coalesce(n.n, 0) AS n, n.forward, s.pair_slope, coalesce(s.slope_pairs, 0) AS slope_pairs, -s.pair_slope AS d
       FROM (SELECT session_date, carrier_id, expiry, any_value(spot) AS spot, any_value(economic_index_id) AS index_id FROM eligible GROUP BY 1, 2, 3) e
       LEFT JOIN slopes s USING (session_date, carrier_id, expiry)
       LEFT JOIN (SELECT b.session_date, b.carrier_id, b.expiry, count(*) AS n, median(b.strike + b.diff / (-s.pair_slope)) AS forward
                  FROM band b LEFT JOIN slopes s USING (session_date, carrier_id, expiry) GROUP BY 1, 2, 3) n USING (session_date, carrier_id, expiry)""",
)
step(
    "fit1",
    """SELECT *, year_fraction * 365e0 AS dte, CASE WHEN n < 5 THEN 'PARITY_PAIR_MISSING' WHEN d IS NULL OR d NOT BETWEEN 0.94e0 AND 1.02e0 THEN 'PARITY_DISCOUNT_INVALID'
              WHEN forward NOT BETWEEN 0.65e0 * spot AND 1.35e0 * spot THEN 'PARITY_FORWARD_INVALID' END AS parity_issue FROM fit0""",
)
step(
    "fit",
    """SELECT session_date, carrier_id, expiry, economic_index_id, spot, year_fraction, dte, parity_issue, pair_slope, slope_pairs,
              CASE WHEN parity_issue IS NULL THEN d END AS discount_factor, CASE WHEN parity_issue IS NULL THEN forward END AS forward,
              CASE WHEN parity_issue IS NULL THEN n ELSE 0 END AS parity_pair_count FROM fit1""",
)
step(
    "k0s",
    """SELECT f.session_date, f.carrier_id, f.expiry, max(s.strike) AS k0 FROM fit f JOIN strikes s USING (session_date, carrier_id, expiry)
       WHERE s.call_price IS NOT NULL AND s.put_price IS NOT NULL AND s.strike <= f.forward GROUP BY 1, 2, 3""",
)
step(
    "strip",
    """SELECT *, coalesce((lead(strike) OVER w - lag(strike) OVER w) / 2e0, lead(strike) OVER w - strike, strike - lag(strike) OVER w) AS delta_k
       FROM (SELECT f.session_date, f.carrier_id, f.expiry, f.year_fraction, f.discount_factor, f.forward, k.k0, s.strike,
                    CASE WHEN s.strike < k.k0 THEN s.put_price WHEN s.strike > k.k0 THEN s.call_price ELSE 0.5e0 * (s.call_price + s.put_price) END AS price,
                    CASE WHEN s.strike < k.k0 THEN 'P' WHEN s.strike > k.k0 THEN 'C' ELSE 'A' END AS side
             FROM fit f JOIN k0s k USING (session_date, carrier_id, expiry) JOIN strikes s USING (session_date, carrier_id, expiry)) q
       WHERE price > 0 WINDOW w AS (PARTITION BY session_date, carrier_id, expiry ORDER BY strike)""",
)
step(
    "mfv",
    """SELECT session_date, carrier_id, expiry, count(*) FILTER (WHERE side = 'P') AS valid_otm_puts, count(*) FILTER (WHERE side = 'C') AS valid_otm_calls,
              count(*) AS valid_total_strikes, any_value(k0) AS k0,
              2e0 / any_value(year_fraction) * sum(delta_k / (strike * strike) * price / discount_factor)
                - 1e0 / any_value(year_fraction) * pow(any_value(forward) / any_value(k0) - 1e0, 2) AS v
       FROM strip GROUP BY 1, 2, 3""",
)
step(
    "quotes",
    """SELECT row_number() OVER (ORDER BY session_date, carrier_id, expiry, strike, option_type) AS id, * FROM (
       SELECT f.session_date, f.carrier_id, f.expiry, f.forward, f.discount_factor, f.year_fraction, d.option_type, d.strike, d.price
       FROM deduped d JOIN fit f USING (session_date, carrier_id, expiry)
       WHERE f.forward IS NOT NULL AND (d.strike >= f.forward OR d.option_type = 'P') AND (d.strike <= f.forward OR d.option_type = 'C')) q
       WHERE price >= discount_factor * greatest(CASE option_type WHEN 'C' THEN forward - strike ELSE strike - forward END, 0e0) - 1e-12
         AND price < discount_factor * CASE option_type WHEN 'C' THEN forward ELSE strike END - 1e-12""",
)
_mid = "((b.lo + b.hi) / 2e0)"
_price = (
    "CASE WHEN option_type = 'C' THEN discount_factor * (forward * n1 - strike * n2) "
    "ELSE discount_factor * (strike * (1e0 - n2) - forward * (1e0 - n1)) END"
)
step(
    "bisect",
    f"""SELECT id, 0 AS i, 0.0001e0 AS lo, 5e0 AS hi FROM quotes
        UNION ALL
        SELECT id, i + 1, CASE WHEN {_price} <= price THEN m ELSE lo END, CASE WHEN {_price} <= price THEN hi ELSE m END
        FROM (SELECT *, {duck_cdf('d1')} AS n1, {duck_cdf('d2')} AS n2
              FROM (SELECT *, d1 - m * sqrt(year_fraction) AS d2
                    FROM (SELECT b.id, b.i, b.lo, b.hi, {_mid} AS m, q.option_type, q.forward, q.strike, q.price, q.year_fraction, q.discount_factor,
                                 (ln(q.forward / q.strike) + 0.5e0 * {_mid} * {_mid} * q.year_fraction) / ({_mid} * sqrt(q.year_fraction)) AS d1
                          FROM bisect b JOIN quotes q ON q.id = b.id WHERE b.i < 54) s1) s2) s3""",
    recursive=True,
)
step(
    "points",
    f"""SELECT *, CASE option_type WHEN 'C' THEN n1 ELSE n1 - 1e0 END AS delta, ln(strike / forward) AS moneyness, year_fraction * sigma * sigma AS total_variance
        FROM (SELECT *, {duck_cdf('d1')} AS n1 FROM (
          SELECT q.*, (b.lo + b.hi) / 2e0 AS sigma, (ln(q.forward / q.strike) + 0.5e0 * pow((b.lo + b.hi) / 2e0, 2) * q.year_fraction) / ((b.lo + b.hi) / 2e0 * sqrt(q.year_fraction)) AS d1
          FROM quotes q JOIN bisect b ON b.id = q.id AND b.i = 54) x) y""",
)
step(
    "brackets",
    """SELECT *, abs(moneyness + w * (nx - moneyness)) AS bx, total_variance + w * (nv - total_variance) AS bv
       FROM (SELECT *, (tgt - delta) / (nd - delta) AS w FROM (
         SELECT *, CASE option_type WHEN 'P' THEN -0.25e0 ELSE 0.25e0 END AS tgt, lead(delta) OVER w AS nd, lead(total_variance) OVER w AS nv, lead(moneyness) OVER w AS nx
         FROM points WINDOW w AS (PARTITION BY session_date, carrier_id, expiry, option_type ORDER BY delta, strike)) a) b
       WHERE nd > delta AND tgt BETWEEN delta AND nd""",
)
step(
    "smile",
    """SELECT p.session_date, p.carrier_id, p.expiry, any_value(year_fraction) AS yf,
         max_by(total_variance, moneyness) FILTER (WHERE moneyness <= 0) AS lv, max(moneyness) FILTER (WHERE moneyness <= 0) AS lx,
         min_by(total_variance, moneyness) FILTER (WHERE moneyness >= 0) AS rv, min(moneyness) FILTER (WHERE moneyness >= 0) AS rx,
         min_by(total_variance, abs(moneyness)) AS av, min(abs(moneyness)) AS ax,
         min_by(total_variance, abs(delta + 0.25e0)) FILTER (WHERE option_type = 'P') AS pv, min(abs(delta + 0.25e0)) FILTER (WHERE option_type = 'P') AS pd,
         min_by(total_variance, abs(delta - 0.25e0)) FILTER (WHERE option_type = 'C') AS cv, min(abs(delta - 0.25e0)) FILTER (WHERE option_type = 'C') AS cd
       FROM points p GROUP BY 1, 2, 3""",
)
step(
    "exact25",
    """SELECT session_date, carrier_id, expiry, min_by(bv, bx) FILTER (WHERE option_type = 'P' AND bv > 0) AS pe, min_by(bv, bx) FILTER (WHERE option_type = 'C' AND bv > 0) AS ce
       FROM brackets GROUP BY 1, 2, 3""",
)
step(
    "smile2",
    """SELECT s.*, CASE WHEN rx = lx THEN lv ELSE lv + (-lx / (rx - lx)) * (rv - lv) END AS ae, e.pe, e.ce
       FROM smile s LEFT JOIN exact25 e USING (session_date, carrier_id, expiry)""",
)
step(
    "expiry_surface",
    """SELECT f.*, m.k0, CASE WHEN f.forward IS NOT NULL AND v.variance_issue IS NULL THEN m.v END AS variance, coalesce(m.valid_otm_puts, 0) AS valid_otm_puts,
         coalesce(m.valid_otm_calls, 0) AS valid_otm_calls, coalesce(m.valid_total_strikes, 0) AS valid_total_strikes, v.variance_issue,
         100e0 * sqrt(a.av / a.yf) AS atm_iv, coalesce(a.am, 'UNAVAILABLE') AS atm_method,
         100e0 * sqrt(a.pv / a.yf) AS iv_25d_put, coalesce(a.pm, 'UNAVAILABLE') AS put25_method,
         100e0 * sqrt(a.cv / a.yf) AS iv_25d_call, coalesce(a.cm, 'UNAVAILABLE') AS call25_method
       FROM fit f LEFT JOIN mfv m USING (session_date, carrier_id, expiry)
       LEFT JOIN (SELECT f.session_date, f.carrier_id, f.expiry, CASE WHEN f.forward IS NULL THEN NULL WHEN m.k0 IS NULL THEN 'PARITY_PAIR_MISSING'
                    WHEN m.valid_otm_puts < 4 OR m.valid_otm_calls < 4 OR m.valid_total_strikes < 9 THEN 'INSUFFICIENT_STRIKES' WHEN m.v <= 0 THEN 'STATIC_ARBITRAGE_VIOLATION' END AS variance_issue
                  FROM fit f LEFT JOIN mfv m USING (session_date, carrier_id, expiry)) v USING (session_date, carrier_id, expiry)
       LEFT JOIN (SELECT session_date, carrier_id, expiry, yf,
                    CASE WHEN ae IS NOT NULL THEN ae WHEN ax <= 0.08e0 THEN av END AS av, CASE WHEN ae IS NOT NULL THEN 'MONEYNESS_INTERPOLATION' WHEN ax <= 0.08e0 THEN 'NEAREST_MONEYNESS_PROXY' ELSE 'UNAVAILABLE' END AS am,
                    CASE WHEN pe IS NOT NULL THEN pe WHEN pd <= 0.12e0 THEN pv END AS pv, CASE WHEN pe IS NOT NULL THEN 'DELTA_INTERPOLATION' WHEN pd <= 0.12e0 THEN 'NEAREST_DELTA_PROXY' ELSE 'UNAVAILABLE' END AS pm,
                    CASE WHEN ce IS NOT NULL THEN ce WHEN cd <= 0.12e0 THEN cv END AS cv, CASE WHEN ce IS NOT NULL THEN 'DELTA_INTERPOLATION' WHEN cd <= 0.12e0 THEN 'NEAREST_DELTA_PROXY' ELSE 'UNAVAILABLE' END AS cm
                  FROM smile2) a USING (session_date, carrier_id, expiry)""",
)
step(
    "expiry_issues",
    """SELECT *, list_distinct_in_order AS issues FROM (SELECT *, list_filter([parity_issue, variance_issue,
         CASE WHEN forward IS NOT NULL AND atm_iv IS NULL THEN 'ATM_NOT_BRACKETED' END,
         CASE WHEN forward IS NOT NULL AND (iv_25d_put IS NULL OR iv_25d_call IS NULL) THEN 'DELTA_NOT_BRACKETED' END], lambda x: x IS NOT NULL) AS list_distinct_in_order FROM expiry_surface) q""",
)


def _tenor_sql(name: str, var: str, method: str | None, target: int) -> str:
    ok = f"dte > 7 AND {var} > 0"
    out = (
        f"max_by({var}, dte) FILTER (WHERE {ok} AND dte <= {target}) AS {name}_lv, max(year_fraction) FILTER (WHERE {ok} AND dte <= {target}) AS {name}_lt, "
        f"min_by({var}, dte) FILTER (WHERE {ok} AND dte > {target}) AS {name}_hv, min(year_fraction) FILTER (WHERE {ok} AND dte > {target}) AS {name}_ht, "
        f"min_by({var}, abs(dte - {target})) FILTER (WHERE {ok}) AS {name}_nv, min(abs(dte - {target})) FILTER (WHERE {ok}) AS {name}_ng"
    )
    if method:
        out += f", min_by({method}, abs(dte - {target})) FILTER (WHERE {ok}) AS {name}_nm, bool_or({method} = 'NEAREST_DELTA_PROXY') FILTER (WHERE {var} IS NOT NULL) AS {name}_px"
    return out


def _interp_sql(n: str, target: int) -> str:
    t = f"({target}e0 / 365e0)"
    w = f"(({n}_ht - {t}) / ({n}_ht - {n}_lt))"
    return f"(({w} * {n}_lt * {n}_lv + (1e0 - {w}) * {n}_ht * {n}_hv) / {t})"


_smile_fields = {"atm": ("atm_iv", "atm_method", "atm_iv30"), "put": ("iv_25d_put", "put25_method", "iv_25d_put30"), "call": ("iv_25d_call", "call25_method", "iv_25d_call30")}
step(
    "tenor0",
    "SELECT session_date, carrier_id, "
    + ", ".join(_tenor_sql(f"t{d}", "variance", None, d) for d in (30, 60, 90))
    + ", "
    + ", ".join(_tenor_sql(n, f"pow({f} / 100e0, 2)", m, 30) for n, (f, m, _) in _smile_fields.items())
    + " FROM expiry_surface GROUP BY 1, 2",
)
_caps = {30: 18, 60: 35, 90: 45}
step(
    "tenors",
    "SELECT session_date, carrier_id, "
    + ", ".join(
        f"CASE WHEN {_interp_sql(f't{d}', d)} > 0 THEN 100e0 * sqrt({_interp_sql(f't{d}', d)}) WHEN t{d}_ng <= {_caps[d]} THEN 100e0 * sqrt(t{d}_nv) END AS iv{d}_mf, "
        f"CASE WHEN {_interp_sql(f't{d}', d)} > 0 THEN 'TOTAL_VARIANCE_INTERPOLATION' WHEN t{d}_ng <= {_caps[d]} THEN 'NEAREST_EXPIRY_PROXY' ELSE 'UNAVAILABLE' END AS iv{d}_method"
        for d in (30, 60, 90)
    )
    + ", "
    + ", ".join(
        f"CASE WHEN {_interp_sql(n, 30)} > 0 THEN 100e0 * sqrt({_interp_sql(n, 30)}) WHEN {n}_ng <= 18 THEN 100e0 * sqrt({n}_nv) END AS {out}, "
        f"CASE WHEN {_interp_sql(n, 30)} > 0 THEN 'TOTAL_VARIANCE_INTERPOLATION' || CASE WHEN {n}_px THEN '+NEAREST_DELTA_PROXY' ELSE '' END "
        f"WHEN {n}_ng <= 18 THEN 'NEAREST_EXPIRY_PROXY+' || {n}_nm ELSE 'UNAVAILABLE' END AS {out}_method"
        for n, (_, _, out) in _smile_fields.items()
    )
    + " FROM tenor0",
)
step(
    "totals",
    """SELECT session_date, carrier_id, any_value(economic_index_id) AS economic_index_id, count(*) AS input_contracts, count(*) FILTER (WHERE is_standard) AS standard_contracts,
       count(*) FILTER (WHERE contract_unit > 0) AS eligible_contracts, count(*) FILTER (WHERE NOT is_standard) AS adjusted_contracts,
       coalesce(sum(daily_volume) FILTER (WHERE option_type = 'P'), 0) / nullif(sum(daily_volume) FILTER (WHERE option_type = 'C'), 0) AS pcr_volume,
       coalesce(sum(open_interest) FILTER (WHERE option_type = 'P'), 0) / nullif(sum(open_interest) FILTER (WHERE option_type = 'C'), 0) AS pcr_oi,
       coalesce(sum(daily_amount) FILTER (WHERE option_type = 'P'), 0) / nullif(sum(daily_amount) FILTER (WHERE option_type = 'C'), 0) AS pcr_premium
       FROM v_chain GROUP BY 1, 2""",
)
step(
    "carrier0",
    """SELECT *, CASE WHEN raw >= 0 THEN raw END AS fvar_30_90, CASE WHEN raw >= 0 THEN 100e0 * sqrt(raw) END AS fvol_30_90
       FROM (SELECT t.*, n.* EXCLUDE (session_date, carrier_id), (90e0 * pow(iv90_mf / 100e0, 2) - 30e0 * pow(iv30_mf / 100e0, 2)) / 60e0 AS raw
             FROM totals t LEFT JOIN tenors n USING (session_date, carrier_id)) q""",
)
_need = ["iv30_mf", "iv90_mf", "fvol_30_90", "atm_iv30", "iv_25d_put30", "iv_25d_call30"]
_m = {"IV30": "iv30_method", "IV60": "iv60_method", "IV90": "iv90_method", "ATM30": "atm_iv30_method", "PUT25_30": "iv_25d_put30_method", "CALL25_30": "iv_25d_call30_method"}
step(
    "carrier_surface",
    f"""SELECT *, iv_25d_call30 - iv_25d_put30 AS rr25, iv_25d_put30 - atm_iv30 AS down_skew25, iv_25d_call30 - atm_iv30 AS up_skew25,
       (iv_25d_put30 + iv_25d_call30) / 2e0 - atm_iv30 AS bf25, pow(iv30_mf / 100e0, 2) - pow(atm_iv30 / 100e0, 2) AS wing_variance_spread, ln(iv30_mf / iv90_mf) AS term_log_ratio_30_90,
       CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in _need)} THEN 'VALID' WHEN {' OR '.join(f'{c} IS NOT NULL' for c in _need)} THEN 'DEGRADED' ELSE 'INVALID' END AS surface_status,
       list_filter([{', '.join(f"CASE WHEN iv{d}_mf IS NULL THEN 'IV{d}_UNBRACKETED_TENOR' END" for d in (30, 60, 90))},
         CASE WHEN iv30_mf IS NULL OR iv90_mf IS NULL THEN 'UNBRACKETED_TENOR' WHEN raw < 0 THEN 'NEGATIVE_FORWARD_VARIANCE' END,
         {', '.join(f"CASE WHEN {c} IS NULL THEN '{n}_UNAVAILABLE' END" for n, c in (("ATM30", "atm_iv30"), ("PUT25_30", "iv_25d_put30"), ("CALL25_30", "iv_25d_call30")))},
         {', '.join(f"CASE WHEN {m} LIKE '%PROXY%' THEN '{n}_' || {m} END" for n, m in _m.items())}], lambda x: x IS NOT NULL) AS issues
       FROM carrier0""",
)


def chain(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "chain")


def _pairs(spark, folder) -> DataFrame:
    return Sf.paired_strikes(Sf.eligible_contracts(chain(spark, folder)), keep=("economic_index_id", "spot"))


@shared
def fitted(spark: SparkSession, folder: str) -> DataFrame:
    return Sf.model_free_variance(Sf.infer_forward(Sf.expiry_curves(_pairs(spark, folder))))


@shared
def expiry_surfaces(spark: SparkSession, folder: str) -> DataFrame:
    return Sf.build_expiry_surfaces(Sf.eligible_contracts(chain(spark, folder)))


@shared
def carrier_surfaces(spark: SparkSession, folder: str) -> DataFrame:
    return Sf.build_carrier_surfaces(chain(spark, folder), expiry_surfaces(spark, folder))


KEY = "session_date carrier_id expiry"


@register("p06_positive_prices", "session_date rows#", "SELECT session_date, count(*) AS rows FROM v_chain WHERE price > 0 GROUP BY 1")
def _(spark, folder):
    return chain(spark, folder).filter("price > 0 AND price < double('Infinity')").groupBy("session_date").agg(F.expr("count(1) AS rows"))


@register(
    "p07_eligible_contracts",
    "session_date carrier_id input_contracts# standard_contracts# eligible_contracts# adjusted_contracts#",
    "SELECT * FROM totals",
)
def _(spark, folder):
    return Sf.chain_totals(chain(spark, folder))


@register("a02_put_call_ratios", "session_date carrier_id pcr_volume~ pcr_oi~ pcr_premium~", "SELECT * FROM totals")
def _(spark, folder):
    return Sf.chain_totals(chain(spark, folder))


@register(
    "w16_dedupe_contracts",
    f"{KEY} strike~ option_type price~",
    "SELECT * FROM deduped",
)
def _(spark, folder):
    p = _pairs(spark, folder)
    sides = "explode(array(struct('C' AS option_type, call_price AS price), struct('P' AS option_type, put_price AS price))) AS s"
    return p.selectExpr(*Sf.EXPIRY, "strike", sides).select(*Sf.EXPIRY, "strike", "s.*").filter("price IS NOT NULL")


@register(
    "j06_call_put_pairs",
    f"{KEY} strike~ call_price~ put_price~",
    "SELECT * FROM strikes WHERE call_price IS NOT NULL AND put_price IS NOT NULL",
)
def _(spark, folder):
    return _pairs(spark, folder).filter("call_price IS NOT NULL AND put_price IS NOT NULL")


@register(
    "j07_strike_pair_slopes",
    f"{KEY} slope_pairs#",
    "SELECT * FROM fit",
)
def _(spark, folder):
    return fitted(spark, folder)


@register("a03_theil_sen_slope", f"{KEY} pair_slope~", "SELECT * FROM fit")
def _(spark, folder):
    return Sf.infer_forward(Sf.expiry_curves(_pairs(spark, folder)))


@register("a04_forward_discount", f"{KEY} discount_factor~ forward~ parity_pair_count# parity_issue", "SELECT * FROM fit")
def _(spark, folder):
    return fitted(spark, folder)


@register(
    "w12_strike_spacing",
    f"{KEY} strike~ side delta_k~",
    "SELECT * FROM strip",
)
def _(spark, folder):
    rows = fitted(spark, folder).selectExpr(*Sf.EXPIRY, "explode(strip) AS s").select(*Sf.EXPIRY, "s.k", "s.side")
    w = f"PARTITION BY {', '.join(Sf.EXPIRY)} ORDER BY k"
    spacing = (
        f"coalesce((lead(k) OVER ({w}) - lag(k) OVER ({w})) / 2D, lead(k) OVER ({w}) - k, k - lag(k) OVER ({w}))"
    )
    return add(rows.withColumnRenamed("k", "strike").withColumn("k", F.col("strike")), {"delta_k": spacing})


@register(
    "a05_model_free_variance",
    f"{KEY} k0~ variance~ valid_otm_puts# valid_otm_calls# valid_total_strikes# variance_issue",
    "SELECT * FROM expiry_surface",
)
def _(spark, folder):
    return fitted(spark, folder)


_point_cols = f"{KEY} strike~ option_type sigma~ delta~ moneyness~ total_variance~"


@register("m03_implied_volatility", f"{KEY} strike~ option_type sigma~", "SELECT * FROM points")
def _(spark, folder):
    return Sf.smile_points(fitted(spark, folder)).filter("sigma IS NOT NULL")


@register("x02_otm_points", _point_cols, "SELECT * FROM points")
def _(spark, folder):
    return Sf.smile_points(fitted(spark, folder)).filter("sigma IS NOT NULL")


@register(
    "m02_black_delta_bounds",
    f"{KEY} strike~ option_type model_price~ delta~ lower_bound~ upper_bound~",
    f"""SELECT *, {_price} AS model_price, discount_factor * greatest(CASE option_type WHEN 'C' THEN forward - strike ELSE strike - forward END, 0e0) AS lower_bound,
        discount_factor * CASE option_type WHEN 'C' THEN forward ELSE strike END AS upper_bound, CASE option_type WHEN 'C' THEN n1 ELSE n1 - 1e0 END AS delta
        FROM (SELECT *, {duck_cdf('d1')} AS n1, {duck_cdf('d2')} AS n2 FROM (SELECT *, d1 - 0.235e0 * sqrt(year_fraction) AS d2 FROM (
          SELECT f.session_date, f.carrier_id, f.expiry, f.forward, f.discount_factor, f.year_fraction, d.option_type, d.strike,
                 (ln(f.forward / d.strike) + 0.5e0 * 0.235e0 * 0.235e0 * f.year_fraction) / (0.235e0 * sqrt(f.year_fraction)) AS d1
          FROM deduped d JOIN fit f USING (session_date, carrier_id, expiry) WHERE f.forward IS NOT NULL) a) b) c""",
)
def _(spark, folder):
    f = fitted(spark, folder).filter("forward IS NOT NULL")
    sides = (
        "explode(flatten(transform(curve, q -> filter(array(struct('C' AS option_type, q.k AS strike, q.c AS price), "
        "struct('P' AS option_type, q.k AS strike, q.p AS price)), s -> s.price IS NOT NULL)))) AS s"
    )
    rows = f.selectExpr(*Sf.EXPIRY, "forward", "discount_factor", "year_fraction", sides)
    rows = add(rows.select(*Sf.EXPIRY, "forward", "discount_factor", "year_fraction", "s.*"), {"sigma": "0.235D"})
    low, high = B.price_bounds("option_type", "forward", "strike", "discount_factor")
    return add(B.with_forward_delta(B.with_black_price(rows)), {"lower_bound": low, "upper_bound": high})


@register(
    "w14_bracket_interpolation",
    f"{KEY} put25~ call25~",
    "SELECT session_date, carrier_id, expiry, pe AS put25, ce AS call25 FROM exact25 WHERE pe IS NOT NULL OR ce IS NOT NULL",
)
def _(spark, folder):
    e = expiry_surfaces(spark, folder)
    put = "CASE WHEN put25_method = 'DELTA_INTERPOLATION' THEN pow(iv_25d_put / 100D, 2) * year_fraction END AS put25"
    call = "CASE WHEN call25_method = 'DELTA_INTERPOLATION' THEN pow(iv_25d_call / 100D, 2) * year_fraction END AS call25"
    return e.selectExpr(*Sf.EXPIRY, put, call).filter("put25 IS NOT NULL OR call25 IS NOT NULL")


_exp_cols = (
    f"{KEY} dte~ discount_factor~ forward~ parity_pair_count# variance~ atm_iv~ atm_method iv_25d_put~ put25_method "
    "iv_25d_call~ call25_method valid_otm_puts# valid_otm_calls# valid_total_strikes# issues"
)


@register("x01_expiry_surface", _exp_cols.replace(" issues", " issue_text"), "SELECT *, array_to_string(issues, '|') AS issue_text FROM expiry_issues")
def _(spark, folder):
    e = Sf.build_expiry_surfaces(Sf.eligible_contracts(chain(spark, folder)))
    return add(e, {"issue_text": "concat_ws('|', issues)"})


_tenor_cols = (
    "session_date carrier_id iv30_mf~ iv30_method iv60_mf~ iv60_method iv90_mf~ iv90_method atm_iv30~ atm_iv30_method "
    "iv_25d_put30~ iv_25d_put30_method iv_25d_call30~ iv_25d_call30_method"
)


@register("x03_constant_tenors", _tenor_cols, "SELECT * FROM tenors")
def _(spark, folder):
    return Sf.tenor_points(expiry_surfaces(spark, folder))


@register("w15_tenor_brackets", "session_date carrier_id iv30_mf~ iv60_mf~ iv90_mf~", "SELECT * FROM tenors")
def _(spark, folder):
    return Sf.tenor_points(expiry_surfaces(spark, folder))


@register(
    "t03_labelled_fallbacks",
    "session_date carrier_id iv30_method iv60_method iv90_method atm_iv30_method iv_25d_put30_method iv_25d_call30_method",
    "SELECT * FROM tenors",
)
def _(spark, folder):
    return Sf.tenor_points(expiry_surfaces(spark, folder))


@register("m04_forward_variance", "session_date carrier_id fvar_30_90~ fvol_30_90~", "SELECT * FROM carrier0")
def _(spark, folder):
    return carrier_surfaces(spark, folder)


@register(
    "m05_derived_measures",
    "session_date carrier_id rr25~ down_skew25~ up_skew25~ bf25~ wing_variance_spread~ term_log_ratio_30_90~",
    "SELECT * FROM carrier_surface",
)
def _(spark, folder):
    return carrier_surfaces(spark, folder)


@register("p09_surface_status", "session_date carrier_id surface_status", "SELECT * FROM carrier_surface")
def _(spark, folder):
    return carrier_surfaces(spark, folder)


@register(
    "x04_carrier_surface",
    _tenor_cols + " economic_index_id surface_status fvar_30_90~ fvol_30_90~ rr25~ down_skew25~ up_skew25~ bf25~ pcr_volume~ pcr_oi~ input_contracts# issue_text",
    "SELECT *, array_to_string(issues, '|') AS issue_text FROM carrier_surface",
)
def _(spark, folder):
    carriers, _ = Sf.build_surface_history(chain(spark, folder))
    return add(carriers, {"issue_text": "concat_ws('|', issues)"})


@register(
    "x05_issue_ledger",
    "session_date carrier_id expiry issue_id issue_scope resolution_status",
    """SELECT session_date, carrier_id, CAST(NULL AS DATE) AS expiry, unnest(issues) AS issue_id, 'CARRIER_CORE_OR_PROXY' AS issue_scope, 'DISCLOSED' AS resolution_status FROM carrier_surface
       UNION ALL SELECT session_date, carrier_id, expiry, unnest(issues), 'EXPIRY_DIAGNOSTIC', 'DISCLOSED' FROM expiry_issues""",
)
def _(spark, folder):
    return Sf.issue_ledger(carrier_surfaces(spark, folder), expiry_surfaces(spark, folder))


_exact = "'TOTAL_VARIANCE_INTERPOLATION'"


@register(
    "a06_coverage",
    "carrier_id year# sessions# valid_surface_share~ iv30_bracket_share~ iv30_reference_share~ iv90_bracket_share~ iv90_reference_share~ "
    "put25_bracket_share~ put25_reference_share~ call25_bracket_share~ call25_reference_share~ proxy_surface_share~",
    f"""SELECT carrier_id, year(session_date) AS year, count(*) AS sessions, avg(CAST(surface_status = 'VALID' AS INT)) AS valid_surface_share,
       avg(CAST(iv30_method = {_exact} AS INT)) AS iv30_bracket_share, avg(CAST(iv30_mf IS NOT NULL AS INT)) AS iv30_reference_share,
       avg(CAST(iv90_method = {_exact} AS INT)) AS iv90_bracket_share, avg(CAST(iv90_mf IS NOT NULL AS INT)) AS iv90_reference_share,
       avg(CAST(iv_25d_put30_method = {_exact} AS INT)) AS put25_bracket_share, avg(CAST(iv_25d_put30 IS NOT NULL AS INT)) AS put25_reference_share,
       avg(CAST(iv_25d_call30_method = {_exact} AS INT)) AS call25_bracket_share, avg(CAST(iv_25d_call30 IS NOT NULL AS INT)) AS call25_reference_share,
       avg(CAST(iv30_method LIKE '%PROXY%' OR iv90_method LIKE '%PROXY%' OR iv_25d_put30_method LIKE '%PROXY%' OR iv_25d_call30_method LIKE '%PROXY%' AS INT)) AS proxy_surface_share
       FROM carrier_surface GROUP BY 1, 2""",
)
def _(spark, folder):
    return Sf.coverage_table(carrier_surfaces(spark, folder))
