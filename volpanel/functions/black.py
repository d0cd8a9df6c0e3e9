"""Black-76 pricing as columns, and implied volatility as a vectorised Arrow UDF.

Spark SQL has no error function, so the normal CDF is Cody's rational
approximation of erfc (three regions), accurate to double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Coefficients of Cody (1969), "Rational Chebyshev approximations
# for the error function", highest power first as used in the Horner forms.
ERF_NUM = (
    1.85777706184603153e-1,
    3.16112374387056560e0,
    1.13864154151050156e2,
    3.77485237685302021e2,
    3.20937758913846947e3,
)
ERF_DEN = (
    1.0,
    2.36012909523441209e1,
    2.44024637934444173e2,
    1.28261652607737228e3,
    2.84423683343917062e3,
)
MID_NUM = (
    2.15311535474403846e-8,
    5.64188496988670089e-1,
    8.88314979438837594e0,
    6.61191906371416295e1,
    2.98635138197400131e2,
    8.81952221241769090e2,
    1.71204761263407058e3,
    2.05107837782607147e3,
    1.23033935479799725e3,
)
MID_DEN = (
    1.0,
    1.57449261107098347e1,
    1.17693950891312499e2,
    5.37181101862009858e2,
    1.62138957456669019e3,
    3.29079923573345963e3,
    4.36261909014324716e3,
    3.43936767414372164e3,
    1.23033935480374942e3,
)
TAIL_NUM = (
    1.63153871373020978e-2,
    3.05326634961232344e-1,
    3.60344899949804439e-1,
    1.25781726111229246e-1,
    1.60837851487422766e-2,
    6.58749161529837803e-4,
)
TAIL_DEN = (
    1.0,
    2.56852019228982242e0,
    1.87295284992346047e0,
    5.27905102951428412e-1,
    6.05183413124413191e-2,
    2.33520497626869185e-3,
)
INV_SQRT_PI = 5.6418958354775628695e-1


def _horner(coefficients, x):
    total = coefficients[0]
    for c in coefficients[1:]:
        total = total * x + c
    return total


def _horner_text(coefficients, x: str) -> str:
    text = repr(float(coefficients[0])) + "D"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {float(c)!r}D)"
    return text


def norm_cdf_text(x: str) -> str:
    """Standard normal CDF of a double column named ``x``, as a Spark SQL expression."""
    u = f"(abs({x}) / sqrt(2D))"
    square = f"({u} * {u})"
    inverse = f"(1D / {square})"
    near = f"(1D - {u} * {_horner_text(ERF_NUM, square)} / {_horner_text(ERF_DEN, square)})"
    middle = f"(exp(-{square}) * {_horner_text(MID_NUM, u)} / {_horner_text(MID_DEN, u)})"
    far = (
        f"(exp(-{square}) / {u} * ({INV_SQRT_PI!r}D - {inverse} * "
        f"{_horner_text(TAIL_NUM, inverse)} / {_horner_text(TAIL_DEN, inverse)}))"
    )
    erfc = f"(CASE WHEN {u} <= 0.46875D THEN {near} WHEN {u} <= 4D THEN {middle} ELSE {far} END)"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0D THEN 1D - 0.5D * {erfc} ELSE 0.5D * {erfc} END)"


def d1_text(forward: str, strike: str, sigma: str, t: str) -> str:
    return (
        f"(CASE WHEN {forward} > 0 AND {strike} > 0 AND {sigma} > 0 AND {t} > 0 THEN "
        f"(ln({forward} / {strike}) + 0.5D * {sigma} * {sigma} * {t}) / ({sigma} * sqrt({t})) END)"
    )


def price_bounds(kind: str, forward: str, strike: str, discount: str) -> tuple[str, str]:
    """Lowest and highest price without arbitrage."""
    lower = (
        f"(CASE {kind} WHEN 'C' THEN {discount} * greatest({forward} - {strike}, 0D) "
        f"WHEN 'P' THEN {discount} * greatest({strike} - {forward}, 0D) END)"
    )
    upper = f"(CASE {kind} WHEN 'C' THEN {discount} * {forward} WHEN 'P' THEN {discount} * {strike} END)"
    return lower, upper


def with_forward_delta(
    df: DataFrame, out: str = "delta", *, kind="option_type", forward="forward", strike="strike",
    sigma="sigma", t="year_fraction"
) -> DataFrame:
    """Forward delta; d1 gets its own column first so it is computed once."""
    df = df.withColumn("_d1", F.expr(d1_text(forward, strike, sigma, t)))
    df = df.withColumn("_n1", F.expr(norm_cdf_text("_d1")))
    return df.withColumn(out, F.expr(f"CASE {kind} WHEN 'C' THEN _n1 WHEN 'P' THEN _n1 - 1D END")).drop("_d1", "_n1")


def with_black_price(
    df: DataFrame, out: str = "model_price", *, kind="option_type", forward="forward", strike="strike",
    sigma="sigma", t="year_fraction", discount="discount_factor"
) -> DataFrame:
    """Black price of every row."""
    df = df.withColumn("_d1", F.expr(d1_text(forward, strike, sigma, t)))
    df = df.withColumn("_d2", F.expr(f"_d1 - {sigma} * sqrt({t})"))
    df = df.withColumns({"_n1": F.expr(norm_cdf_text("_d1")), "_n2": F.expr(norm_cdf_text("_d2"))})
    call = f"{discount} * ({forward} * _n1 - {strike} * _n2)"
    put = f"{discount} * ({strike} * (1D - _n2) - {forward} * (1D - _n1))"
    return df.withColumn(out, F.expr(f"CASE {kind} WHEN 'C' THEN {call} WHEN 'P' THEN {put} END")).drop(
        "_d1", "_d2", "_n1", "_n2"
    )


# ---- numpy side: used inside Arrow UDFs ------------------------------------


def cdf_array(x: np.ndarray) -> np.ndarray:
    u = np.abs(x) / math.sqrt(2.0)
    square = u * u
    near = u <= 0.46875
    far = u > 4.0
    safe = np.where(far, u, 5.0)
    inverse = 1.0 / (safe * safe)
    decay = np.exp(-square)
    erfc = np.where(
        near,
        1.0 - u * _horner(ERF_NUM, square) / _horner(ERF_DEN, square),
        decay * _horner(MID_NUM, u) / _horner(MID_DEN, u),
    )
    tail = decay / safe * (INV_SQRT_PI - inverse * _horner(TAIL_NUM, inverse) / _horner(TAIL_DEN, inverse))
    erfc = np.where(far, tail, erfc)
    return np.where(x > 0, 1.0 - 0.5 * erfc, 0.5 * erfc)


def price_array(is_call, forward, strike, sigma, t, discount) -> np.ndarray:
    width = sigma * np.sqrt(t)
    first = np.log(forward / strike) / width + 0.5 * width
    sign = np.where(is_call, 1.0, -1.0)
    return discount * sign * (forward * cdf_array(sign * first) - strike * cdf_array(sign * (first - width)))


def implied_sigma_array(is_call, price, forward, strike, t, discount, low=1e-4, high=5.0) -> np.ndarray:
    """Root of price(sigma) on [low, high]: Newton steps kept inside a shrinking bracket."""
    sign = np.where(is_call, 1.0, -1.0)
    floor = discount * np.maximum(sign * (forward - strike), 0.0)
    ceiling = discount * np.where(is_call, forward, strike)
    with np.errstate(all="ignore"):
        ok = np.isfinite(price) & np.isfinite(forward * strike * t * discount)
        ok &= (forward > 0) & (strike > 0) & (t > 0) & (discount > 0)
        ok &= (price >= floor - 1e-12) & (price < ceiling - 1e-12)
    result = np.full(len(price), np.nan)
    rows = np.flatnonzero(ok)
    if not len(rows):
        return result
    is_call, price, forward, strike, t, discount = (
        np.asarray(a)[rows] for a in (is_call, price, forward, strike, t, discount)
    )
    at_low = price_array(is_call, forward, strike, np.full(len(rows), low), t, discount) - price
    at_high = price_array(is_call, forward, strike, np.full(len(rows), high), t, discount) - price
    bracketed = at_low * at_high <= 0
    lo, hi = np.full(len(rows), low), np.full(len(rows), high)
    sigma = np.full(len(rows), 0.3)
    root_t = np.sqrt(t)
    for _ in range(100):
        gap = price_array(is_call, forward, strike, sigma, t, discount) - price
        lo = np.where(gap <= 0, sigma, lo)
        hi = np.where(gap >= 0, sigma, hi)
        first = np.log(forward / strike) / (sigma * root_t) + 0.5 * sigma * root_t
        vega = discount * forward * np.exp(-0.5 * first * first) / math.sqrt(2 * math.pi) * root_t
        with np.errstate(all="ignore"):
            step = sigma - gap / vega
        inside = np.isfinite(step) & (step > lo) & (step < hi)
        following = np.where(inside, step, 0.5 * (lo + hi))
        moved = np.abs(following - sigma)
        sigma = following
        if np.all((moved <= 1e-15 * sigma + 1e-16) | (hi - lo <= 1e-15)):
            break
    sigma = np.where(at_low == 0, low, np.where(at_high == 0, high, sigma))
    result[rows] = np.where(bracketed, sigma, np.nan)
    return result


@F.pandas_udf(T.DoubleType())
def implied_volatility(
    kind: pd.Series, price: pd.Series, forward: pd.Series, strike: pd.Series, t: pd.Series, discount: pd.Series
) -> pd.Series:
    """Implied volatility of each row, NULL outside the no-arbitrage bounds."""
    values = implied_sigma_array(
        (kind == "C").to_numpy(), *(s.to_numpy(dtype=float) for s in (price, forward, strike, t, discount))
    )
    valid_kind = kind.isin(["C", "P"]).to_numpy()
    return pd.Series(values).where(valid_kind & np.isfinite(values), None)
