"""Guarded numeric, date and string expressions, as SQL text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def add(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """withColumns for expression text."""
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def known(value: str) -> str:
    """NaN and infinities become NULL (in Spark ``NaN > 1`` is true)."""
    return f"(CASE WHEN abs(double({value})) < double('Infinity') THEN double({value}) END)"


def clean_numbers(df: DataFrame) -> DataFrame:
    """Apply :func:`known` to every floating column, once, right after a scan."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.selectExpr(*[f"{known(f'`{c}`')} AS `{c}`" if c in floats else f"`{c}`" for c in df.columns])


def ratio(numerator: str, denominator: str) -> str:
    return f"try_divide(double({numerator}), double({denominator}))"


def log_ratio(current: str, earlier: str) -> str:
    """ln(current / earlier), NULL unless both are positive."""
    return f"(CASE WHEN {current} > 0 AND {earlier} > 0 THEN ln({current} / {earlier}) END)"


def clip(value: str, low: float, high: float) -> str:
    return f"(CASE WHEN ({value}) IS NOT NULL THEN least(greatest({value}, {low!r}D), {high!r}D) END)"


def sigmoid(value: str, margin: float = 0.0) -> str:
    p = f"(1D / (1D + exp(-({value}))))"
    return clip(p, margin, 1.0 - margin) if margin else p


def same_number(left: str, right: str, tolerance: float = 1e-10) -> str:
    """Equal within a relative-or-absolute tolerance; NULL equals only NULL."""
    bound = f"greatest({tolerance!r}D * greatest(abs({left}), abs({right})), {tolerance!r}D)"
    return f"coalesce({left} <=> {right} OR abs({left} - {right}) <= {bound}, false)"


def forward_variance(iv30: str, iv90: str) -> str:
    """Variance between day 30 and day 90 implied by two percent vols; NULL if negative."""
    t30, t90 = "(30D / 365D)", "(90D / 365D)"
    raw = f"({t90} * pow({iv90} / 100D, 2) - {t30} * pow({iv30} / 100D, 2)) / ({t90} - {t30})"
    return f"(CASE WHEN {iv30} > 0 AND {iv90} > 0 AND {raw} >= 0 THEN {raw} END)"


def forward_variance_issue(iv30: str, iv90: str) -> str:
    return (
        f"(CASE WHEN NOT coalesce({iv30} > 0 AND {iv90} > 0, false) THEN 'UNBRACKETED_TENOR' "
        f"WHEN {forward_variance(iv30, iv90)} IS NULL THEN 'NEGATIVE_FORWARD_VARIANCE' END)"
    )


def compact_date(value: str) -> str:
    """yyyyMMdd text or number to DATE, NULL when it does not parse."""
    return f"to_date(try_to_timestamp(string({value}), 'yyyyMMdd'))"


def year_fraction(session: str, expiry: str) -> str:
    """ACT/365F from the 14:56 bar of the session to 15:00 on expiry day."""
    return f"((datediff({expiry}, {session}) * 86400D + 240D) / (365D * 86400D))"


def open_range(column: str, start: str | None, end: str | None) -> str:
    """Inclusive date bounds where either end may be open."""
    parts = [f"{column} >= DATE'{start}'"] if start is not None else []
    parts += [f"{column} <= DATE'{end}'"] if end is not None else []
    return " AND ".join(parts) or "true"


def weighted(parts) -> str:
    """Fixed-weight sum of (expression, weight); NULL as soon as one part is."""
    return "(" + " + ".join(f"{w!r}D * {c}" for c, w in parts) + ")"


def issue_count(issues: str) -> str:
    return f"size(filter(split(coalesce({issues}, ''), '[|]'), x -> x <> ''))"
