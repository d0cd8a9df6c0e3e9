"""Event ledger: predictors, onsets, forward labels, base rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel import params as P
from volpanel.functions import tri
from volpanel.functions.num import add, clip
from volpanel.operators import series as S
from volpanel.operators.market import UNIVERSE

ROW = [UNIVERSE, "event_id"]
OBSERVED = "event_status = 'ELIGIBLE' AND label IS NOT NULL"
SCALED_AXES = ("insurance_level", "shock", "down_tail", "persistence", "breadth", "repair")


def add_predictors(state: DataFrame) -> DataFrame:
    segments = P.DEFAULT_UNIVERSE.segments
    df = add(
        state,
        {
            **{f"{a}_scaled": f"{a} / 100D" for a in SCALED_AXES},
            "pressure_change5_scaled": clip("(d5_pressure_score + 100D) / 200D", 0.0, 1.0),
            "cross_section_pressure_dispersion_scaled": "cross_section_pressure_dispersion / 100D",
            "segment_iv_jump_true_share": tri.count_if_all_known([f"{s}_jump" for s in segments])
            + f" / {len(segments)}",
        },
    )
    return add(df, {"inverse_pressure_change5_scaled": "1D - pressure_change5_scaled"})


def predictors_complete(fields: tuple[str, ...]) -> str:
    return f"forall(array({', '.join(fields)}), x -> coalesce(x BETWEEN 0 AND 1, false))"


def _phase_is(phases: tuple[str, ...]) -> str:
    names = ", ".join(f"'{p}'" for p in phases)
    return f"CASE WHEN primary_phase <> 'UNKNOWN' THEN primary_phase IN ({names}) END"


def _rules() -> dict[str, tuple[str, str]]:
    """event -> (onset predicate, target predicate of one session)."""
    systemic = _phase_is(("SYSTEMIC_ACUTE_STRESS",))
    repair_onset = (
        "CASE WHEN repair_answer = 'CONFIRMED' THEN false "
        f"WHEN repair_answer IN ('INACTIVE', 'BUILDING') THEN pressure_score >= 65 OR ({_phase_is(P.STRESSED_PHASES)}) END"
    )
    return {
        "cross_market_iv_jump_1d": ("shock < 75 AND NOT cross_market_iv_jump", "cross_market_iv_jump AND shock >= 75"),
        "broad_pressure_onset_5d": ("NOT broad_confirmed", "broad_confirmed AND pressure_score >= 65"),
        "systemic_acute_stress_5d": (tri.negate(systemic), systemic),
        "persistent_cross_market_stress_20d": ("NOT persistent_cross_market_now", "persistent_cross_market_now"),
        "fast_repair_5d": (repair_onset, "repair_confirmed"),
    }


def _label(target: str, over: str, first: int, last: int) -> str:
    frame = f"OVER ({over} ROWS BETWEEN {first} FOLLOWING AND {last} FOLLOWING)"
    return (
        f"(CASE WHEN count_if({target}) {frame} > 0 THEN true "
        f"WHEN count_if(NOT ({target})) {frame} = {last - first + 1} THEN false END)"
    )


def build_target_ledger(state: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row per (universe, session, event).

    Labels look at the next H rows of the state history but only count when
    those rows are exactly the next H sessions of the calendar; anything else
    is CENSORED. The sustained-stress event needs 3 of 5 inside its window, so
    its label reads the rolling 3-of-5 column from row 5 on.
    """
    w = S.by([UNIVERSE], "session_date")
    ordinals = calendar.selectExpr("session_date", "ordinal", "next_session")
    df = state.join(ordinals, "session_date", "left")
    day = "pressure_score >= 70 AND persistence >= 70 AND broad_confirmed"
    df = add(df, {"persistent_cross_market_day": day, "prediction_position": S.position(w)})
    df = add(df, {"persistent_cross_market_now": tri.at_least_k_in_window("persistent_cross_market_day", w, 5, 3)})
    rules = _rules()
    df = add(df, {f"_t{i}": rules[e.event_id][1] for i, e in enumerate(P.EVENTS)})
    windows: dict[str, str] = {}
    for i, e in enumerate(P.EVENTS):
        first = 5 if e.event_id == "persistent_cross_market_stress_20d" else 1
        windows[f"_truth{i}"] = _label(f"_t{i}", w, first, e.horizon)
        windows[f"_whole{i}"] = f"coalesce(lead(ordinal, {e.horizon}) OVER ({w}) = ordinal + {e.horizon}, false)"
    df = add(df, windows)
    events = ", ".join(
        f"named_struct('event_id', '{e.event_id}', 'horizon', {e.horizon}, "
        f"'observable', data_status = 'OK' AND {predictors_complete(e.predictors)}, 'onset', {rules[e.event_id][0]}, "
        f"'truth', CASE WHEN _whole{i} THEN _truth{i} END, 'predictors', array({', '.join(e.predictors)}))"
        for i, e in enumerate(P.EVENTS)
    )
    long = df.selectExpr(
        UNIVERSE, "session_date", "prediction_position", "ordinal", "next_session", f"explode(array({events})) AS e"
    ).select(UNIVERSE, "session_date", "prediction_position", "ordinal", "next_session", "e.*")
    long = add(long, {"onset": "CASE WHEN observable THEN onset END", "_end": "ordinal + horizon"})
    long = add(
        long,
        {
            "event_status": "CASE WHEN onset IS NULL THEN 'UNOBSERVABLE' WHEN NOT onset THEN 'NOT_APPLICABLE' ELSE 'ELIGIBLE' END",
            "target_end_position": "prediction_position + horizon",
        },
    )
    long = add(
        long,
        {
            "label_status": "CASE WHEN event_status = 'NOT_APPLICABLE' THEN 'NOT_APPLICABLE' "
            "WHEN event_status = 'ELIGIBLE' AND truth THEN 'OBSERVED_1' "
            "WHEN event_status = 'ELIGIBLE' AND NOT truth THEN 'OBSERVED_0' ELSE 'CENSORED' END",
            "label": "CASE WHEN event_status = 'ELIGIBLE' THEN int(truth) END",
        },
    )
    ends = calendar.selectExpr("ordinal AS _end", "session_date AS _end_session", "next_session AS _after_end")
    long = long.join(ends, "_end", "left")
    return long.selectExpr(
        UNIVERSE,
        "session_date AS prediction_date",
        "prediction_position",
        "to_timestamp_ntz(concat(next_session, ' 09:00:00')) AS decision_as_of",
        "event_id",
        "horizon",
        "event_status",
        "onset",
        "CASE WHEN event_status = 'ELIGIBLE' THEN _end_session END AS target_window_end_session",
        "target_end_position",
        "label_status",
        "label",
        "CASE WHEN label IS NOT NULL THEN to_timestamp_ntz(concat(_after_end, ' 09:00:00')) END AS outcome_available_at",
        "'RESEARCH_ONLY' AS evidence_tier",
        "predictors",
    )


def matured_counts(ledger: DataFrame) -> DataFrame:
    """Running counts of labels, and how many had matured at each position.

    Positions are dense, so "target end not after now" is a lag by the horizon.
    """
    w = S.by(ROW, "prediction_position")
    run = f"OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    df = add(
        ledger,
        {
            "labelled": OBSERVED,
            "label_rank": f"count_if({OBSERVED}) {run}",
            "label_sum": f"coalesce(sum(CASE WHEN {OBSERVED} THEN label END) {run}, 0L)",
        },
    )
    horizons = sorted({e.horizon for e in P.EVENTS})

    def lagged(c: str) -> str:
        cases = " ".join(f"WHEN {h} THEN lag({c}, {h}, 0L) OVER ({w})" for h in horizons)
        return f"CASE horizon {cases} END"

    return add(df, {"matured": lagged("label_rank"), "matured_positive": lagged("label_sum")})


def base_rates(
    ledger: DataFrame, *, minimum_samples: int = 252, maximum_samples: int = 504
) -> DataFrame:
    """Laplace rate of the latest matured labels as of every position.

    A window of the latest N labels is the difference of two running sums; the
    earlier one is found by an equi-join on the label rank.
    """
    df = matured_counts(ledger)
    earlier = df.filter("labelled").selectExpr(*ROW, "label_rank AS _rank", "label_sum AS _before")
    df = add(df, {"_rank": f"matured - {maximum_samples}"}).join(earlier, [*ROW, "_rank"], "left")
    df = add(
        df,
        {
            "base_rate_sample_size": f"least(matured, {maximum_samples}L)",
            "base_rate_positive_count": "matured_positive - coalesce(_before, 0L)",
        },
    )
    rate = "(base_rate_positive_count + 1D) / (base_rate_sample_size + 2D)"
    return add(
        df, {"base_rate": f"CASE WHEN base_rate_sample_size >= {minimum_samples} THEN {rate} END"}
    ).drop("_rank", "_before", "matured", "matured_positive", "label_rank", "label_sum", "labelled")


def event_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(*ROW).agg(
        F.expr("count_if(event_status = 'ELIGIBLE') AS eligible"),
        F.expr("count_if(event_status = 'NOT_APPLICABLE') AS not_applicable"),
        F.expr("count_if(event_status = 'UNOBSERVABLE') AS unobservable"),
        F.expr("count_if(label_status IN ('OBSERVED_0', 'OBSERVED_1')) AS observed"),
        F.expr("coalesce(sum(label), 0) AS positives"),
    )
