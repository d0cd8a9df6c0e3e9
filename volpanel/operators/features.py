"""Daily feature history of each index: changes, variance premium, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame

from volpanel import params as P
from volpanel.functions.num import add, clean_numbers
from volpanel.operators import series as S
from volpanel.operators.quality import require_columns, require_unique

KEYS = ["economic_index_id"]
ORDER = "session_date"

REQUIRED = (
    "session_date carrier_id economic_index_id surface_status iv30_mf iv90_mf fvol_30_90 "
    "term_log_ratio_30_90 down_skew25 up_skew25"
).split()


def attach_marks(surfaces: DataFrame, marks: DataFrame) -> DataFrame:
    """Left join on (session, carrier); both sides must be unique on that key."""
    key = ["session_date", "carrier_id"]
    right = require_unique(marks.select(*key, "etf_mark", "tr_mark"), key)
    return require_unique(surfaces.drop("etf_mark", "tr_mark"), key).join(right, key, "left")


W = S.by(KEYS, ORDER)


def add_returns(df: DataFrame) -> DataFrame:
    return add(
        df,
        {"etf_return_1d": S.log_return("tr_mark", W, 1), "etf_return_5d": S.log_return("tr_mark", W, 5)},
    )


def add_iv_changes(df: DataFrame, *, vov_max_span: int = P.VOV_SPAN_SESSIONS) -> DataFrame:
    df = add(
        df,
        {
            "d1_log_iv30": S.log_return("iv30_mf", W, 1),
            "d5_log_iv30": S.log_return("iv30_mf", W, 5),
            "d5_down_skew25": S.difference("down_skew25", W),
            "d5_up_skew25": S.difference("up_skew25", W),
            "d5_fvol_30_90": S.difference("fvol_30_90", W),
        },
    )
    df = S.vol_of_vol(
        df,
        "d1_log_iv30",
        "iv_vol_of_vol20",
        "iv_vov_observation_span_sessions",
        keys=KEYS,
        order=ORDER,
        max_span=vov_max_span,
    )
    return add(df, {"d5_iv_vol_of_vol20": S.difference("iv_vol_of_vol20", W)})


def add_variance_premium(df: DataFrame) -> DataFrame:
    df = S.ewma_variance(df, "etf_return_1d", "ewma_variance", keys=KEYS, order=ORDER)
    forecast = f"{P.SESSIONS_PER_YEAR}D * ewma_variance"
    return add(
        df,
        {
            "rv_forecast30": forecast,
            "vrp_ewma94": f"CASE WHEN iv30_mf > 0 THEN pow(iv30_mf / 100D, 2) - {forecast} END",
        },
    )


def compensation(percentile: str) -> str:
    return (
        f"(CASE WHEN {percentile} IS NULL THEN 'UNKNOWN' WHEN {percentile} < 0.35D THEN 'THIN' "
        f"WHEN {percentile} >= 0.75D THEN 'RICH' ELSE 'NORMAL' END)"
    )


def build_index_feature_history(
    surfaces: DataFrame,
    marks: DataFrame,
    *,
    reference_sessions: int = P.REFERENCE_SESSIONS,
    minimum_valid: int = P.MINIMUM_VALID,
    vov_max_span: int = P.VOV_SPAN_SESSIONS,
) -> DataFrame:
    require_columns(surfaces, REQUIRED)
    df = attach_marks(clean_numbers(surfaces), clean_numbers(marks))
    df = add_variance_premium(add_iv_changes(add_returns(df), vov_max_span=vov_max_span))
    df = S.midrank_percentiles(
        df,
        P.PERCENTILES,
        keys=KEYS,
        order=ORDER,
        reference=reference_sessions,
        minimum_valid=minimum_valid,
    )
    return add(
        df,
        {
            "vrp_percentile": "p_vrp",
            "insurance_compensation": compensation("p_vrp"),
            "front_event_premium": "double(NULL)",
        },
    )
