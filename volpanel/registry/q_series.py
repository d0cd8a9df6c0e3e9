"""Daily series: returns, changes, dispersion, variance premium, percentiles, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from volpanel import params as P
from volpanel.functions.num import add, forward_variance
from volpanel.operators import features as X
from volpanel.operators import series as S
from volpanel.registry.base import register, shared, step
from volpanel.sources.views import view

KEY = ["economic_index_id"]


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Index panel with the term-structure columns a carrier surface carries."""
    p = add(view(spark, folder, "panel"), {"fvar_30_90": forward_variance("iv30_mf", "iv90_mf")})
    return add(
        p,
        {
            "fvol_30_90": "100D * sqrt(fvar_30_90)",
            "term_log_ratio_30_90": "ln(iv30_mf / iv90_mf)",
            "iv_25d_put30": "atm_iv30 + down_skew25",
            "iv_25d_call30": "atm_iv30 + up_skew25",
        },
    )


step(
    "panel",
    """
    SELECT *, CASE WHEN raw_var >= 0 THEN raw_var END AS fvar_30_90,
           CASE WHEN raw_var >= 0 THEN 100e0 * sqrt(raw_var) END AS fvol_30_90,
           ln(iv30_mf / iv90_mf) AS term_log_ratio_30_90,
           atm_iv30 + down_skew25 AS iv_25d_put30, atm_iv30 + up_skew25 AS iv_25d_call30
    FROM (SELECT *, (90e0/365e0 * pow(iv90_mf/100e0, 2) - 30e0/365e0 * pow(iv30_mf/100e0, 2)) / (90e0/365e0 - 30e0/365e0) AS raw_var
          FROM v_panel) s
    """,
)
step(
    "changes",
    """
    SELECT *, ln(tr_mark / lag(tr_mark, 1) OVER w) AS etf_return_1d, ln(tr_mark / lag(tr_mark, 5) OVER w) AS etf_return_5d,
           ln(iv30_mf / lag(iv30_mf, 1) OVER w) AS d1_log_iv30, ln(iv30_mf / lag(iv30_mf, 5) OVER w) AS d5_log_iv30,
           down_skew25 - lag(down_skew25, 5) OVER w AS d5_down_skew25, up_skew25 - lag(up_skew25, 5) OVER w AS d5_up_skew25,
           fvol_30_90 - lag(fvol_30_90, 5) OVER w AS d5_fvol_30_90,
           row_number() OVER w - 1 AS pos
    FROM panel WINDOW w AS (PARTITION BY economic_index_id ORDER BY session_date)
    """,
)
step(
    "vov",
    """
    SELECT c.*, CASE WHEN d1_log_iv30 IS NOT NULL AND len(recent) >= 20
                     THEN list_aggregate(list_transform(recent[-20:], lambda q: q.x), 'stddev_samp') * sqrt(252e0) END AS iv_vol_of_vol20,
           CASE WHEN d1_log_iv30 IS NOT NULL AND len(recent) >= 20 THEN pos - (recent[-20]).p + 1 END AS iv_vov_observation_span_sessions
    FROM (SELECT *, list_filter(list({'p': pos, 'x': d1_log_iv30}) OVER (PARTITION BY economic_index_id ORDER BY session_date
                     ROWS BETWEEN 79 PRECEDING AND CURRENT ROW), lambda q: q.x IS NOT NULL) AS recent FROM changes) c
    """,
)
step(
    "ewma_start",
    """
    SELECT economic_index_id, session_date, etf_return_1d, seg,
           row_number() OVER (PARTITION BY economic_index_id, seg ORDER BY session_date) AS k
    FROM (SELECT economic_index_id, session_date, etf_return_1d,
                 sum(CASE WHEN etf_return_1d IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY economic_index_id ORDER BY session_date) AS seg
          FROM changes) s WHERE etf_return_1d IS NOT NULL
    """,
)
step(
    "ewma",
    """
    SELECT economic_index_id, session_date,
           CASE WHEN k >= 252 THEN pow(0.94e0, k - 252) * (v0 + 0.06e0 * sum(CASE WHEN k > 252 THEN pow(0.94e0, -(k - 252)) * etf_return_1d * etf_return_1d ELSE 0e0 END)
                OVER (PARTITION BY economic_index_id, seg ORDER BY k)) END AS ewma_variance
    FROM (SELECT *, var_samp(CASE WHEN k <= 252 THEN etf_return_1d END) OVER (PARTITION BY economic_index_id, seg) AS v0 FROM ewma_start) s
    """,
)
step(
    "premium",
    """
    SELECT v.*, v.iv_vol_of_vol20 - lag(v.iv_vol_of_vol20, 5) OVER (PARTITION BY v.economic_index_id ORDER BY v.session_date) AS d5_iv_vol_of_vol20,
           e.ewma_variance, 252e0 * e.ewma_variance AS rv_forecast30,
           pow(iv30_mf / 100e0, 2) - 252e0 * e.ewma_variance AS vrp_ewma94
    FROM vov v LEFT JOIN ewma e USING (economic_index_id, session_date)
    """,
)
_rank = ", ".join(
    f"CASE WHEN any_value(c.{src}) IS NOT NULL AND count(r.{src}) >= 126 THEN "
    f"(count(*) FILTER (WHERE {'' if sign > 0 else '-'}r.{src} < {'' if sign > 0 else '-'}c.{src}) + "
    f"0.5e0 * count(*) FILTER (WHERE r.{src} = c.{src})) / count(r.{src}) END AS {out}"
    for out, (src, sign) in P.PERCENTILES.items()
)
step(
    "ranks",
    f"""
    SELECT c.economic_index_id, c.session_date, {_rank}
    FROM premium c JOIN premium r ON r.economic_index_id = c.economic_index_id AND r.pos BETWEEN c.pos - 504 AND c.pos - 1
    GROUP BY 1, 2
    """,
)
step(
    "features",
    """
    SELECT p.*, r.* EXCLUDE (economic_index_id, session_date), r.p_vrp AS vrp_percentile,
           CASE WHEN r.p_vrp IS NULL THEN 'UNKNOWN' WHEN r.p_vrp < 0.35 THEN 'THIN' WHEN r.p_vrp >= 0.75 THEN 'RICH' ELSE 'NORMAL' END AS insurance_compensation
    FROM premium p LEFT JOIN ranks r USING (economic_index_id, session_date)
    """,
)


@register("w01_log_returns", "session_date economic_index_id etf_return_1d~ etf_return_5d~", "SELECT * FROM changes")
def _(spark, folder):
    return X.add_returns(panel(spark, folder))


@register(
    "w02_differences",
    "session_date economic_index_id d5_down_skew25~ d5_up_skew25~ d5_fvol_30_90~ d1_log_iv30~ d5_log_iv30~",
    "SELECT * FROM changes",
)
def _(spark, folder):
    return X.add_iv_changes(panel(spark, folder))


@register(
    "w04_vol_of_vol",
    "session_date economic_index_id iv_vol_of_vol20~ iv_vov_observation_span_sessions#",
    "SELECT * FROM vov",
)
def _(spark, folder):
    return X.add_iv_changes(panel(spark, folder))


@register("w05_ewma_premium", "session_date economic_index_id ewma_variance~9 rv_forecast30~ vrp_ewma94~", "SELECT * FROM premium")
def _(spark, folder):
    return X.add_variance_premium(X.add_returns(panel(spark, folder)))


@shared
def feature_history(spark: SparkSession, folder: str) -> DataFrame:
    p = panel(spark, folder)
    marks = view(spark, folder, "panel").select("session_date", "carrier_id", "etf_mark", "tr_mark")
    return X.build_index_feature_history(p, marks, minimum_valid=P.RESEARCH_MINIMUM_VALID)


@register(
    "w03_midrank_percentile",
    "session_date economic_index_id p_iv30~ p_iv90~ p_down_skew25~",
    """SELECT c.economic_index_id, c.session_date,
              CASE WHEN count(r.iv30_mf) >= 252 THEN (count(*) FILTER (WHERE r.iv30_mf < c.iv30_mf) + 0.5e0 * count(*) FILTER (WHERE r.iv30_mf = c.iv30_mf)) / count(r.iv30_mf) END AS p_iv30,
              CASE WHEN count(r.iv90_mf) >= 252 THEN (count(*) FILTER (WHERE r.iv90_mf < c.iv90_mf) + 0.5e0 * count(*) FILTER (WHERE r.iv90_mf = c.iv90_mf)) / count(r.iv90_mf) END AS p_iv90,
              CASE WHEN any_value(c.down_skew25) IS NOT NULL AND count(r.down_skew25) >= 252 THEN (count(*) FILTER (WHERE r.down_skew25 < c.down_skew25) + 0.5e0 * count(*) FILTER (WHERE r.down_skew25 = c.down_skew25)) / count(r.down_skew25) END AS p_down_skew25
       FROM changes c LEFT JOIN changes r ON r.economic_index_id = c.economic_index_id AND r.pos BETWEEN c.pos - 504 AND c.pos - 1
       GROUP BY 1, 2""",
)
def _(spark, folder):
    wanted = {k: P.PERCENTILES[k] for k in ("p_iv30", "p_iv90", "p_down_skew25")}
    slim = panel(spark, folder).select("session_date", "economic_index_id", "iv30_mf", "iv90_mf", "down_skew25")
    return S.midrank_percentiles(slim, wanted)


@register(
    "x06_index_feature_history",
    "session_date economic_index_id carrier_id etf_mark~ etf_return_1d~ etf_return_5d~ iv_vol_of_vol20~ d5_iv_vol_of_vol20~ "
    "rv_forecast30~ vrp_ewma94~ insurance_compensation " + " ".join(f"{p}~" for p in P.PERCENTILES),
    "SELECT * FROM features",
)
def _(spark, folder):
    return feature_history.direct(spark, folder)
