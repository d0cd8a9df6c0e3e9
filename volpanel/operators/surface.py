"""Option chain to implied-volatility surfaces.

Shuffles: two on (session, carrier, expiry, strike) that remove duplicate
contracts (the highest open interest by a hash aggregate, then ``min_by`` over
the contracts that have it, so no task sorts all rows it reads), one on (session, carrier,
expiry), one on (session, carrier). After the first, a group holds one row per
listed strike, so later groups are bounded by the strike grid, not by the rows
quoted at a strike.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volpanel import params as P
from volpanel.functions.black import implied_volatility, with_forward_delta
from volpanel.functions.num import add, forward_variance, forward_variance_issue, ratio, year_fraction
from volpanel.functions.slopes import median_slope
from volpanel.session import stored

CARRIER = ["session_date", "carrier_id"]
EXPIRY = [*CARRIER, "expiry"]
DEFAULT = P.SurfaceParams()


def eligible_contracts(chain: DataFrame, params: P.SurfaceParams = DEFAULT) -> DataFrame:
    if params.include_adjusted:
        return chain.filter("contract_unit > 0 AND option_type IN ('C', 'P')")
    return chain.filter("coalesce(is_standard, false)")


def paired_strikes(chain: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per strike with its call and put price.

    Of several contracts on one strike and side the most held wins, then the
    most traded, then the lowest id. A ``min_by`` with an id sorts its input, so
    it only gets the most held contracts (or all of a strike without prices).
    """
    rank = "struct(-coalesce(open_interest, 0), -coalesce(daily_volume, 0), contract_id)"
    usable = "price > 0 AND price < double('Infinity')"
    strike = [*EXPIRY, "strike"]
    sides = (("C", "call_price"), ("P", "put_price"))
    held = "coalesce(open_interest, 0)"
    top = chain.groupBy(*strike).agg(*[F.expr(f"max(CASE WHEN option_type = '{k}' AND {usable} THEN {held} END) AS _top_{k}") for k, _ in sides])
    top = stored(top, "top").selectExpr(*[f"{c} AS _{c}" for c in strike], "_top_C", "_top_P")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in strike])
    leads = " OR ".join(f"(option_type = '{k}' AND {usable} AND {held} = _top_{k})" for k, _ in sides)
    chain = chain.join(top, same).filter(f"coalesce({leads}, false) OR (_top_C IS NULL AND _top_P IS NULL)")
    return chain.groupBy(*strike).agg(
        *[
            F.expr(
                f"min_by(CASE WHEN option_type = '{k}' AND {usable} THEN price END, "
                f"CASE WHEN option_type = '{k}' AND {usable} THEN {rank} END) AS {n}"
            )
            for k, n in sides
        ],
        *[F.expr(f"any_value({c}) AS {c}") for c in keep],
    )


@F.pandas_udf(
    T.StructType([T.StructField("slope", T.DoubleType()), T.StructField("pairs", T.LongType())])
)
def theil_sen(strikes: pd.Series, values: pd.Series) -> pd.DataFrame:
    """Median of the pairwise slopes of each row's strike curve (distinct strikes)."""
    slopes, counts = [], []
    for x, y in zip(strikes, values):
        slope, pairs = median_slope(np.asarray(x, dtype=float), np.asarray(y, dtype=float))
        slopes.append(slope)
        counts.append(pairs)
    return pd.DataFrame({"slope": pd.Series(slopes, dtype=object), "pairs": counts})


def expiry_curves(pairs: DataFrame) -> DataFrame:
    """One row per expiry holding its strike curve in strike order."""
    kept = [c for c in pairs.columns if c not in (*EXPIRY, "strike", "call_price", "put_price")]
    return pairs.groupBy(*EXPIRY).agg(
        F.expr("array_sort(collect_list(struct(strike AS k, call_price AS c, put_price AS p))) AS curve"),
        *[F.expr(f"any_value({c}) AS {c}") for c in kept],
    )


def infer_forward(curves: DataFrame, params: P.SurfaceParams = DEFAULT) -> DataFrame:
    """Discount and forward from put-call parity, or the reason there is none."""
    low, high = params.forward_spot_bounds
    d_low, d_high = params.discount_bounds
    both = f"filter(curve, q -> q.c > 0 AND q.p > 0 AND q.k >= {low}D * spot AND q.k <= {high}D * spot)"
    df = add(curves, {"year_fraction": year_fraction("session_date", "expiry")})
    df = add(df, {"dte": "year_fraction * 365D", "_pairs": both})
    fit = theil_sen(F.expr("transform(_pairs, q -> q.k)"), F.expr("transform(_pairs, q -> q.c - q.p)"))
    df = df.withColumn("_fit", fit)
    df = add(df, {"parity_pair_count": "bigint(size(_pairs))", "pair_slope": "_fit.slope", "slope_pairs": "_fit.pairs",
                  "_d": "-_fit.slope"})
    df = add(df, {"_f": "array_sort(transform(_pairs, q -> q.k + (q.c - q.p) / _d))", "_n": "size(_pairs)"})
    middle = "(element_at(_f, int(_n div 2) + 1) + element_at(_f, int((_n + 1) div 2))) / 2D"
    df = add(df, {"_forward": f"CASE WHEN _n > 0 AND _d <> 0 THEN {middle} END"})
    issue = (
        "CASE WHEN year_fraction <= 0 THEN 'EXPIRED_CONTRACT' "
        "WHEN NOT coalesce(spot > 0, false) THEN 'ETF_MARK_MISSING' "
        f"WHEN _n < {params.minimum_pairs} THEN 'PARITY_PAIR_MISSING' "
        f"WHEN NOT coalesce(_d BETWEEN {d_low}D AND {d_high}D, false) THEN 'PARITY_DISCOUNT_INVALID' "
        f"WHEN NOT coalesce(_forward BETWEEN {low}D * spot AND {high}D * spot, false) THEN 'PARITY_FORWARD_INVALID' END"
    )
    df = add(df, {"parity_issue": issue})
    good = "parity_issue IS NULL"
    return add(
        df,
        {
            "discount_factor": f"CASE WHEN {good} THEN _d END",
            "forward": f"CASE WHEN {good} THEN _forward END",
            "parity_pair_count": f"CASE WHEN {good} THEN parity_pair_count ELSE 0L END",
        },
    ).drop("_pairs", "_fit", "_d", "_f", "_n", "_forward")


def model_free_variance(curves: DataFrame, params: P.SurfaceParams = DEFAULT) -> DataFrame:
    """Variance from the out-of-the-money strip around K0, with its count gates."""
    df = add(curves, {"k0": "array_max(transform(filter(curve, q -> q.c IS NOT NULL AND q.p IS NOT NULL AND q.k <= forward), q -> q.k))"})
    price = (
        "CASE WHEN q.k < k0 THEN q.p WHEN q.k > k0 THEN q.c "
        "WHEN q.c > 0 AND q.p > 0 THEN 0.5D * (q.c + q.p) END"
    )
    side = "CASE WHEN q.k < k0 THEN 'P' WHEN q.k > k0 THEN 'C' ELSE 'A' END"
    df = add(df, {"strip": f"filter(transform(curve, q -> struct(q.k AS k, {price} AS price, {side} AS side)), x -> k0 IS NOT NULL AND x.price > 0)"})
    none = "k0 IS NULL"
    df = add(
        df,
        {
            "valid_otm_puts": f"CASE WHEN {none} THEN 0L ELSE bigint(size(filter(strip, x -> x.side = 'P'))) END",
            "valid_otm_calls": f"CASE WHEN {none} THEN 0L ELSE bigint(size(filter(strip, x -> x.side = 'C'))) END",
            "valid_total_strikes": f"CASE WHEN {none} THEN 0L ELSE bigint(size(strip)) END",
        },
    )
    gap = (
        "(CASE WHEN i = 0 THEN strip[1].k - strip[0].k "
        "WHEN i = size(strip) - 1 THEN strip[i].k - strip[i - 1].k ELSE (strip[i + 1].k - strip[i - 1].k) / 2D END)"
    )
    terms = f"transform(strip, (x, i) -> {gap} / (x.k * x.k) * x.price / discount_factor)"
    enough = (
        f"valid_otm_puts >= {params.minimum_otm_puts} AND valid_otm_calls >= {params.minimum_otm_calls} "
        f"AND valid_total_strikes >= {params.minimum_total_strikes}"
    )
    raw = (
        f"(2D / year_fraction) * aggregate({terms}, 0D, (a, x) -> a + x) "
        "- (1D / year_fraction) * pow(forward / k0 - 1D, 2)"
    )
    df = add(df, {"_v": f"CASE WHEN {enough} THEN {raw} END"})
    issue = (
        f"CASE WHEN forward IS NULL THEN NULL WHEN {none} THEN 'PARITY_PAIR_MISSING' "
        f"WHEN NOT ({enough}) THEN 'INSUFFICIENT_STRIKES' "
        "WHEN NOT coalesce(_v > 0 AND _v < double('Infinity'), false) THEN 'STATIC_ARBITRAGE_VIOLATION' END"
    )
    df = add(df, {"variance_issue": issue})
    return add(df, {"variance": "CASE WHEN forward IS NOT NULL AND variance_issue IS NULL THEN _v END"}).drop("_v")


def smile_points(curves: DataFrame, params: P.SurfaceParams = DEFAULT) -> DataFrame:
    """Out-of-the-money quotes with implied vol, log-moneyness and forward delta."""
    sides = (
        "filter(array("
        "named_struct('option_type', 'C', 'strike', q.k, 'price', q.c), "
        "named_struct('option_type', 'P', 'strike', q.k, 'price', q.p)), "
        "s -> s.price > 0 AND (s.strike >= forward OR s.option_type = 'P') AND (s.strike <= forward OR s.option_type = 'C'))"
    )
    carried = [c for c in curves.columns if c not in (*EXPIRY, "curve", "strip")]
    # An expiry without a forward keeps one empty row, so no join has to bring it back.
    rows = curves.selectExpr(
        *EXPIRY,
        f"struct({', '.join(carried)}) AS fit",
        f"explode_outer(flatten(transform(curve, q -> {sides}))) AS s",
    )
    rows = rows.selectExpr(
        *EXPIRY, "fit", "s.*", "fit.forward", "fit.discount_factor", "fit.year_fraction"
    )
    sigma = implied_volatility("option_type", "price", "forward", "strike", "year_fraction", "discount_factor")
    points = with_forward_delta(rows.withColumn("sigma", sigma))
    return add(
        points,
        {
            "moneyness": "CASE WHEN sigma IS NOT NULL THEN ln(strike / forward) END",
            "total_variance": "year_fraction * sigma * sigma",
        },
    )


def smile_measures(points: DataFrame, params: P.SurfaceParams = DEFAULT) -> DataFrame:
    """At-the-money and 25-delta vols per expiry, interpolated or nearest, labelled."""
    over = f"PARTITION BY {', '.join(EXPIRY)}, option_type, _has ORDER BY delta, strike"
    df = add(points, {"_has": "sigma IS NOT NULL"})
    df = add(df, {"_next": f"lead(struct(delta AS d, total_variance AS v, moneyness AS x)) OVER ({over})"})
    target = "(CASE option_type WHEN 'P' THEN -0.25D ELSE 0.25D END)"
    weight = f"(({target} - delta) / (_next.d - delta))"
    df = add(
        df,
        {
            "_bracket": f"CASE WHEN _next.d > delta AND {target} BETWEEN delta AND _next.d THEN "
            f"struct(abs(moneyness + {weight} * (_next.x - moneyness)) AS x, delta AS d, total_variance + {weight} * (_next.v - total_variance) AS v) END",
            "_far": f"abs(delta - {target})",
            "_atm": "abs(moneyness)",
        },
    )
    df = add(df, {"_bracket": "CASE WHEN _bracket.v > 0 THEN _bracket END"})

    def side(k: str, name: str) -> list[str]:
        mine = f"option_type = '{k}'"
        return [
            f"min(CASE WHEN {mine} THEN _bracket END).v AS {name}_exact",
            f"min(CASE WHEN {mine} AND _has THEN struct(_far, strike, total_variance AS v) END) AS {name}_near",
        ]

    measures = [
        "max(CASE WHEN moneyness <= 0 THEN struct(moneyness AS x, -int(option_type = 'P'), total_variance AS v) END) AS left_point",
        "min(CASE WHEN moneyness >= 0 THEN struct(moneyness AS x, int(option_type = 'P'), total_variance AS v) END) AS right_point",
        "min(CASE WHEN _has THEN struct(_atm, strike, total_variance AS v) END) AS atm_near",
        *side("P", "put"),
        *side("C", "call"),
        "any_value(fit) AS fit",
    ]
    out = df.groupBy(*EXPIRY).agg(*[F.expr(m) for m in measures])
    w = "(-left_point.x / (right_point.x - left_point.x))"
    out = add(
        out,
        {
            "atm_exact": "CASE WHEN right_point.x = left_point.x THEN left_point.v "
            f"ELSE left_point.v + {w} * (right_point.v - left_point.v) END",
        },
    )

    def resolve(name: str, cap: float, near: str, exact_label: str, near_label: str) -> dict[str, str]:
        usable = f"{name}_near.{near} <= {cap}D"
        value = f"CASE WHEN {name}_exact IS NOT NULL THEN {name}_exact WHEN {usable} THEN {name}_near.v END"
        label = (
            f"CASE WHEN {name}_exact IS NOT NULL THEN '{exact_label}' WHEN {usable} THEN '{near_label}' "
            "ELSE 'UNAVAILABLE' END"
        )
        return {f"_{name}_v": value, f"_{name}_m": label}

    out = add(
        out,
        {
            **resolve("atm", params.nearest_atm_log_moneyness, "_atm", "MONEYNESS_INTERPOLATION", "NEAREST_MONEYNESS_PROXY"),
            **resolve("put", params.nearest_delta_max_distance, "_far", "DELTA_INTERPOLATION", "NEAREST_DELTA_PROXY"),
            **resolve("call", params.nearest_delta_max_distance, "_far", "DELTA_INTERPOLATION", "NEAREST_DELTA_PROXY"),
        },
    )

    def vol(name: str) -> str:
        return f"CASE WHEN _{name}_v > 0 THEN 100D * sqrt(_{name}_v / fit.year_fraction) END"

    return out.selectExpr(
        *EXPIRY,
        "fit.*",
        f"{vol('atm')} AS atm_iv",
        "_atm_m AS atm_method",
        f"{vol('put')} AS iv_25d_put",
        "_put_m AS put25_method",
        f"{vol('call')} AS iv_25d_call",
        "_call_m AS call25_method",
    )


def build_expiry_surfaces(chain: DataFrame, params: P.SurfaceParams = DEFAULT) -> DataFrame:
    """Surface row per (session, carrier, expiry) of an eligible chain with ``spot``."""
    curves = expiry_curves(paired_strikes(chain, keep=("economic_index_id", "spot")))
    fitted = model_free_variance(infer_forward(curves, params), params)
    out = smile_measures(smile_points(fitted, params), params)
    issues = (
        "array_distinct(array_compact(array(parity_issue, variance_issue, "
        "CASE WHEN forward IS NOT NULL AND atm_iv IS NULL THEN 'ATM_NOT_BRACKETED' END, "
        "CASE WHEN forward IS NOT NULL AND (iv_25d_put IS NULL OR iv_25d_call IS NULL) THEN 'DELTA_NOT_BRACKETED' END)))"
    )
    return add(out, {"issues": issues, "evidence_tier": "'RESEARCH_ONLY'",
                     "methodology_version": f"'{params.methodology_version}'"})


def _tenor(name: str, variance: str, target: int, minimum: float) -> list[str]:
    """Aggregates that bracket a tenor: last expiry up to it, first beyond, nearest."""
    ok = f"dte > {minimum}D AND {variance} > 0"
    point = f"struct(year_fraction AS t, {variance} AS v, expiry AS e)"
    return [
        f"max(CASE WHEN {ok} AND dte <= {target} THEN {point} END) AS {name}_lo",
        f"min(CASE WHEN {ok} AND dte > {target} THEN {point} END) AS {name}_hi",
        f"min(CASE WHEN {ok} THEN struct(abs(dte - {target}) AS gap, dte AS dte, {variance} AS v, expiry AS e) END) AS {name}_near",
    ]


def _interpolated(name: str, target: int) -> str:
    t = f"({target}D / 365D)"
    w = f"(({name}_hi.t - {t}) / ({name}_hi.t - {name}_lo.t))"
    total = f"({w} * {name}_lo.t * {name}_lo.v + (1D - {w}) * {name}_hi.t * {name}_hi.v)"
    return f"CASE WHEN {name}_hi.t > {name}_lo.t AND {total} / {t} > 0 THEN {total} / {t} END"


def tenor_points(expiries: DataFrame, params: P.SurfaceParams = DEFAULT) -> DataFrame:
    """Constant-tenor vols and smile per (session, carrier) with proxy labels."""
    smile = {"atm": ("atm_iv", "atm_method"), "put": ("iv_25d_put", "put25_method"), "call": ("iv_25d_call", "call25_method")}
    aggregates: list[str] = []
    for days, _ in params.tenor_proxy_days:
        aggregates += _tenor(f"t{days}", "variance", days, params.minimum_expiry_days)
    target = params.smile_target_days
    for name, (field, method) in smile.items():
        aggregates += _tenor(name, f"pow({field} / 100D, 2)", target, params.minimum_expiry_days)
        aggregates.append(
            f"min(CASE WHEN dte > {params.minimum_expiry_days}D AND {field} IS NOT NULL THEN "
            f"struct(abs(dte - {target}) AS gap, dte AS dte, {field} AS v, {method} AS m) END) AS {name}_pick"
        )
        aggregates.append(f"bool_or({field} IS NOT NULL AND {method} = 'NEAREST_DELTA_PROXY') AS {name}_proxy")
    df = expiries.groupBy(*CARRIER).agg(*[F.expr(a) for a in aggregates])
    columns: dict[str, str] = {}
    for days, _ in params.tenor_proxy_days:
        columns[f"_v{days}"] = _interpolated(f"t{days}", days)
    for name in smile:
        columns[f"_v{name}"] = _interpolated(name, target)
    df = add(df, columns)
    out: list[str] = list(CARRIER)
    for days, cap in params.tenor_proxy_days:
        n, v = f"t{days}", f"_v{days}"
        near = f"{n}_near.gap <= {cap}"
        out += [
            f"CASE WHEN {v} IS NOT NULL THEN 100D * sqrt({v}) WHEN {near} THEN 100D * sqrt({n}_near.v) END AS iv{days}_mf",
            f"CASE WHEN {v} IS NOT NULL THEN 'TOTAL_VARIANCE_INTERPOLATION' WHEN {near} THEN 'NEAREST_EXPIRY_PROXY' "
            f"ELSE 'UNAVAILABLE' END AS iv{days}_method",
            f"CASE WHEN {v} IS NULL THEN CASE WHEN {n}_lo IS NULL OR {n}_hi IS NULL THEN 'UNBRACKETED_TENOR' "
            f"ELSE 'STATIC_ARBITRAGE_VIOLATION' END END AS iv{days}_issue",
            f"{n}_lo.e AS iv{days}_lower_expiry",
            f"CASE WHEN {n}_lo IS NOT NULL THEN {n}_hi.e END AS iv{days}_upper_expiry",
        ]
    published = {"atm": "atm_iv30", "put": "iv_25d_put30", "call": "iv_25d_call30"}
    for name, column in published.items():
        v, near = f"_v{name}", f"{name}_pick.gap <= {params.smile_proxy_days}"
        out += [
            f"CASE WHEN {v} IS NOT NULL THEN 100D * sqrt({v}) WHEN {near} THEN {name}_pick.v END AS {column}",
            f"CASE WHEN {v} IS NOT NULL THEN concat('TOTAL_VARIANCE_INTERPOLATION', if({name}_proxy, '+NEAREST_DELTA_PROXY', '')) "
            f"WHEN {near} THEN concat('NEAREST_EXPIRY_PROXY+', {name}_pick.m) ELSE 'UNAVAILABLE' END AS {column}_method",
        ]
    return df.selectExpr(*out)


def chain_totals(chain: DataFrame, params: P.SurfaceParams = DEFAULT) -> DataFrame:
    """Contract counts and put/call ratios per (session, carrier)."""
    usable = "contract_unit > 0 AND option_type IN ('C', 'P')" if params.include_adjusted else "coalesce(is_standard, false)"
    sums = [
        f"sum(CASE WHEN {usable} AND option_type = '{k}' THEN {c} ELSE 0 END) AS {n}_{k}"
        for n, c in (("volume", "daily_volume"), ("oi", "open_interest"), ("premium", "daily_amount"))
        for k in "PC"
    ]
    counts = {
        "input_contracts": "count(1)",
        "standard_contracts": "count_if(is_standard)",
        "eligible_contracts": f"count_if({usable})",
        "adjusted_contracts": f"count_if(({usable}) AND NOT coalesce(is_standard, false))",
    }
    # the index is a key first: an aggregate that keeps a text sorts its input
    totals = chain.groupBy(*CARRIER, "economic_index_id").agg(*[F.expr(f"{x} AS {n}") for n, x in counts.items()], *[F.expr(s) for s in sums])
    added = [c for c in totals.columns if c not in (*CARRIER, "economic_index_id")]
    totals = totals.groupBy(*CARRIER).agg(
        F.expr("any_value(economic_index_id) AS economic_index_id"), *[F.expr(f"sum({c}) AS {c}") for c in added]
    )
    return totals.selectExpr(
        *CARRIER,
        "economic_index_id",
        "input_contracts",
        "standard_contracts",
        "eligible_contracts",
        "adjusted_contracts",
        *[
            f"CASE WHEN {n}_C <> 0 THEN {ratio(f'{n}_P', f'{n}_C')} END AS pcr_{n}"
            for n in ("volume", "oi", "premium")
        ],
    )


def derived_measures(df: DataFrame) -> DataFrame:
    put, call, atm = "iv_25d_put30", "iv_25d_call30", "atm_iv30"
    df = add(
        df,
        {
            "fvar_30_90": forward_variance("iv30_mf", "iv90_mf"),
            "_fvar_issue": forward_variance_issue("iv30_mf", "iv90_mf"),
            "rr25": f"{call} - {put}",
            "down_skew25": f"{put} - {atm}",
            "up_skew25": f"{call} - {atm}",
            "bf25": f"({put} + {call}) / 2D - {atm}",
            "wing_variance_spread": f"pow(iv30_mf / 100D, 2) - pow({atm} / 100D, 2)",
            "term_log_ratio_30_90": "ln(iv30_mf / iv90_mf)",
        },
    )
    return add(df, {"fvol_30_90": "100D * sqrt(fvar_30_90)"})


def build_carrier_surfaces(chain: DataFrame, expiries: DataFrame, params: P.SurfaceParams = DEFAULT) -> DataFrame:
    df = chain_totals(chain, params).join(tenor_points(expiries, params), CARRIER, "left")
    methods = {
        "IV30": "iv30_method",
        "IV60": "iv60_method",
        "IV90": "iv90_method",
        "ATM30": "atm_iv30_method",
        "PUT25_30": "iv_25d_put30_method",
        "CALL25_30": "iv_25d_call30_method",
    }
    df = derived_measures(add(df, {m: f"coalesce({m}, 'UNAVAILABLE')" for m in methods.values()}))
    parts = [
        f"CASE WHEN iv{d}_mf IS NULL THEN concat('IV{d}_', coalesce(iv{d}_issue, 'UNBRACKETED_TENOR')) END"
        for d, _ in params.tenor_proxy_days
    ]
    parts.append("_fvar_issue")
    parts += [
        f"CASE WHEN {c} IS NULL THEN '{n}_UNAVAILABLE' END"
        for n, c in (("ATM30", "atm_iv30"), ("PUT25_30", "iv_25d_put30"), ("CALL25_30", "iv_25d_call30"))
    ]
    parts += [f"CASE WHEN contains({m}, 'PROXY') THEN concat('{n}_', {m}) END" for n, m in methods.items()]
    needed = ["iv30_mf", "iv90_mf", "fvol_30_90", "atm_iv30", "iv_25d_put30", "iv_25d_call30"]
    every = " AND ".join(f"{c} IS NOT NULL" for c in needed)
    some = " OR ".join(f"{c} IS NOT NULL" for c in needed)
    return add(
        df,
        {
            "surface_status": f"CASE WHEN {every} THEN 'VALID' WHEN {some} THEN 'DEGRADED' "
            "WHEN input_contracts > 0 THEN 'INVALID' ELSE 'UNKNOWN' END",
            "issues": f"array_distinct(array_compact(array({', '.join(parts)})))",
            "evidence_tier": "'RESEARCH_ONLY'",
            "methodology_version": f"'{params.methodology_version}'",
        },
    ).drop("_fvar_issue", *[f"iv{d}_issue" for d, _ in params.tenor_proxy_days])


def build_surface_history(
    chain: DataFrame, marks: DataFrame | None = None, params: P.SurfaceParams = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """Carrier and expiry surfaces; only sessions with an underlying mark are built."""
    if marks is not None:
        spots = marks.selectExpr(*CARRIER, "etf_mark AS spot")
        chain = chain.drop("spot").join(spots, CARRIER, "inner")
    expiries = build_expiry_surfaces(eligible_contracts(chain, params), params)
    return build_carrier_surfaces(chain, expiries, params), expiries


def issue_ledger(carriers: DataFrame, expiries: DataFrame) -> DataFrame:
    """One row per disclosed issue of both surface tables."""
    shape = ["session_date", "carrier_id", "expiry", "explode(issues) AS issue_id"]
    core = carriers.selectExpr(*CARRIER, "CAST(NULL AS DATE) AS expiry", shape[3], "'CARRIER_CORE_OR_PROXY' AS issue_scope")
    detail = expiries.selectExpr(*shape, "'EXPIRY_DIAGNOSTIC' AS issue_scope")
    return core.unionByName(detail).withColumn("resolution_status", F.lit("DISCLOSED"))


def coverage_table(surfaces: DataFrame) -> DataFrame:
    """Shares of valid, bracketed, referenced and proxy surfaces per carrier and year."""
    exact = "TOTAL_VARIANCE_INTERPOLATION"

    def share(predicate: str, name: str) -> str:
        return f"avg(CASE WHEN {predicate} THEN 1D ELSE 0D END) AS {name}"

    proxies = " OR ".join(
        f"contains(coalesce({m}, ''), 'PROXY')"
        for m in ("iv30_method", "iv90_method", "iv_25d_put30_method", "iv_25d_call30_method")
    )
    aggregates = [
        "count(1) AS sessions",
        share("surface_status = 'VALID'", "valid_surface_share"),
        share(f"iv30_method = '{exact}'", "iv30_bracket_share"),
        share("iv30_mf IS NOT NULL", "iv30_reference_share"),
        share(f"iv90_method = '{exact}'", "iv90_bracket_share"),
        share("iv90_mf IS NOT NULL", "iv90_reference_share"),
        share(f"iv_25d_put30_method = '{exact}'", "put25_bracket_share"),
        share("iv_25d_put30 IS NOT NULL", "put25_reference_share"),
        share(f"iv_25d_call30_method = '{exact}'", "call25_bracket_share"),
        share("iv_25d_call30 IS NOT NULL", "call25_reference_share"),
        share(proxies, "proxy_surface_share"),
    ]
    out = surfaces.groupBy("carrier_id", F.expr("year(session_date) AS year")).agg(*[F.expr(a) for a in aggregates])
    return add(
        out,
        {
            "formal_two_sided_quote_share": "double(NULL)",
            "relative_spread_median": "double(NULL)",
            "relative_spread_p95": "double(NULL)",
            "price_kind": "'MINUTE_CLOSE_NOT_BID_ASK'",
        },
    )
