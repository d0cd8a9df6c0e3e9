"""Market state: predicates over time, answers, ordered raw phase, hysteresis."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volpanel import params as P
from volpanel.functions import tri
from volpanel.functions.num import add
from volpanel.operators import blocks as B
from volpanel.operators import series as S
from volpanel.operators.market import UNIVERSE
from volpanel.session import durable

ANSWERS = ("level", "shock", "tail", "term", "breadth", "repair")


def bands(value: str, cuts: list[tuple[float, str]], top: str) -> str:
    """Label by ascending upper bounds (exclusive); NULL is UNKNOWN."""
    steps = " ".join(f"WHEN {value} < {bound} THEN '{label}'" for bound, label in cuts)
    return f"(CASE WHEN {value} IS NULL THEN '{tri.UNKNOWN}' {steps} ELSE '{top}' END)"


def level_answer(value: str) -> str:
    return bands(value, [(35, "CHEAP"), (60, "NORMAL"), (85, "RICH")], "EXTREME")


def pressure_level(value: str) -> str:
    return bands(value, [(35, "LOW"), (55, "WATCH"), (70, "ELEVATED"), (85, "HIGH")], "EXTREME")


def direction(change: str) -> str:
    return (
        f"(CASE WHEN {change} IS NULL THEN 'UNKNOWN' WHEN {change} >= 7.5D THEN 'RISING' "
        f"WHEN {change} <= -7.5D THEN 'FALLING' ELSE 'STABLE' END)"
    )


def shock_answer(value: str, hard_acute: str) -> str:
    return (
        f"(CASE WHEN {value} IS NULL THEN 'UNKNOWN' WHEN {value} < 40 THEN 'CALM' WHEN {value} < 65 THEN 'BUILDING' "
        f"WHEN {hard_acute} THEN 'ACUTE' WHEN NOT {hard_acute} THEN 'HIGH' ELSE 'UNKNOWN' END)"
    )


def tail_answer(down: str, up: str) -> str:
    return (
        f"(CASE WHEN {down} IS NULL OR {up} IS NULL THEN 'UNKNOWN' WHEN {down} < 60 AND {up} < 60 THEN 'NEUTRAL' "
        f"WHEN {down} >= 75 AND {up} >= 75 AND abs({down} - {up}) < 15 THEN 'TWO_SIDED_EVENT' "
        f"WHEN {down} >= 60 AND {down} - {up} >= 15 THEN 'DOWNSIDE_PRICED' "
        f"WHEN {up} >= 60 AND {up} - {down} >= 15 THEN 'UPSIDE_PRICED' ELSE 'MIXED' END)"
    )


def term_answer() -> str:
    diffusing = tri.all_of(
        "persistence >= 55", "aggregate_d5_fvol30_90 > 0", "aggregate_d5_fvol30_90_percentile >= 0.7D"
    )
    ordered = tri.choose(
        [
            ("PERSISTENT", "persistent_now"),
            ("DIFFUSING", diffusing),
            ("FRONT_LOCALIZED", "shock >= 65 AND persistence < 50"),
            ("NORMAL", "persistence < 55 AND shock < 65"),
        ],
        "MIXED",
    )
    return f"CASE WHEN persistence IS NULL OR shock IS NULL THEN 'UNKNOWN' ELSE {ordered} END"


COUNTED = "stressed_segment_count IS NOT NULL AND stressed_index_count IS NOT NULL"


def _if_counted(predicate: str) -> str:
    return f"CASE WHEN {COUNTED} THEN {predicate} END"


def fragmented() -> str:
    return tri.any_of(
        "cross_section_pressure_dispersion >= 50 AND NOT broad_confirmed",
        "axis_gap_any AND NOT broad_confirmed",
        _if_counted("stressed_segment_count = 0 AND stressed_index_count >= 2"),
    )


def breadth_answer() -> str:
    none = "stressed_index_count = 0 AND stressed_segment_count = 0 AND NOT fragmented_now"
    return tri.choose(
        [
            ("NONE", _if_counted(none)),
            ("ISOLATED", _if_counted("stressed_index_count = 1 AND stressed_segment_count = 0")),
            ("BLUE_CHIP_LOCALIZED", "large_stressed AND NOT mid_stressed AND NOT tech_stressed"),
            (
                "LOCAL_STYLE",
                tri.all_of("NOT large_stressed", tri.exactly_one(["mid_stressed", "tech_stressed"])),
            ),
            ("SYSTEMIC", "systemic_confirmed"),
            ("BROAD", "broad_confirmed AND NOT systemic_confirmed"),
            ("FRAGMENTED", "NOT broad_confirmed AND fragmented_now"),
        ],
        tri.UNKNOWN,
    )


def repair_answer() -> str:
    return (
        "CASE WHEN repair IS NULL THEN 'UNKNOWN' WHEN repair < 60 OR coalesce(NOT recent_stress, false) THEN 'INACTIVE' "
        "WHEN recent_stress IS NULL THEN 'UNKNOWN' WHEN repair_confirmed THEN 'CONFIRMED' "
        "WHEN NOT repair_confirmed THEN 'BUILDING' ELSE 'UNKNOWN' END"
    )


def raw_phase() -> str:
    """Eleven ordered branches; the first that is true names the phase."""
    systemic = tri.all_of("hard_acute", "_breadth = 'SYSTEMIC'", "all_segment_iv_jump")
    calm = (
        "CASE WHEN aggregate_vrp_value IS NULL THEN false "
        "ELSE pressure_score < 35 AND shock < 40 AND aggregate_vrp_value > 0 END"
    )
    return tri.choose(
        [
            ("SYSTEMIC_ACUTE_STRESS", systemic),
            ("LOCALIZED_ACUTE_STRESS", f"hard_acute AND NOT {systemic}"),
            ("REPAIR_IN_PROGRESS", "_repair = 'CONFIRMED' AND NOT hard_acute"),
            ("BROAD_PERSISTENT_PRESSURE", "persistent_now AND broad_confirmed"),
            ("BROAD_PRESSURE", "broad_confirmed AND pressure_score >= 65"),
            ("LOCAL_STYLE_PRESSURE", "_breadth = 'LOCAL_STYLE' AND pressure_score >= 55"),
            ("BLUE_CHIP_PRESSURE", "_breadth = 'BLUE_CHIP_LOCALIZED' AND pressure_score >= 55"),
            ("DOWNSIDE_TAIL_RICH", "down_tail >= 75 AND shock < 65 AND NOT broad_confirmed"),
            (
                "UPSIDE_CONVEXITY_PRICED",
                "_tail = 'UPSIDE_PRICED' AND up_tail >= 75 AND aggregate_etf_return_5d > 0",
            ),
            ("FRAGMENTED_TRANSITION", "_breadth = 'FRAGMENTED'"),
            ("CALM_POSITIVE_VRP", calm),
        ],
        "BALANCED_MARKET",
    )


def add_predicates(market: DataFrame) -> DataFrame:
    """Three-valued predicates that look back over the session history."""
    w = S.by([UNIVERSE], "session_date")
    df = add(
        market,
        {
            "persistent_day": "persistence >= 75 AND pressure_score >= 65",
            "hard_acute": "shock >= 85 AND cross_market_iv_jump AND (down_tail >= 75 OR broad_confirmed)",
        },
    )
    df = add(df, {"stress_day": "pressure_score >= 70 OR hard_acute"})
    df = add(
        df,
        {
            "persistent_now": tri.at_least_k_in_window("persistent_day", w, 5, 3),
            "recent_stress": tri.at_least_k_in_window("stress_day", w, 10, 1),
            "_repair_before": S.lag("repair", w),
            "_pressure_before": S.lag("pressure_score", w),
            "_breadth_before": S.lag("breadth", w),
        },
    )
    confirmed = tri.all_of(
        "recent_stress",
        "repair >= 70",
        "_repair_before >= 70",
        "pressure_score < _pressure_before",
        "breadth <= _breadth_before",
        "NOT hard_acute",
    )
    return add(df, {"repair_confirmed": confirmed}).drop("_repair_before", "_pressure_before", "_breadth_before")


def add_state_ontology(market: DataFrame) -> DataFrame:
    df = add(add_predicates(market), {"fragmented_now": fragmented()})
    df = add(
        df,
        {
            "_level": level_answer("insurance_level"),
            "_shock": shock_answer("shock", "hard_acute"),
            "_tail": tail_answer("down_tail", "up_tail"),
            "_term": term_answer(),
            "_breadth": breadth_answer(),
            "_repair": repair_answer(),
        },
    )

    def if_usable(value: str) -> str:
        return f"CASE WHEN data_status = 'OK' AND pressure_score IS NOT NULL THEN {value} ELSE 'UNKNOWN' END"

    return add(
        df,
        {
            "raw_phase": if_usable(raw_phase()),
            "pressure_level": if_usable(pressure_level("pressure_score")),
            "direction": if_usable(direction("d5_pressure_score")),
            **{f"{a}_answer": if_usable(f"_{a}") for a in ANSWERS},
        },
    ).drop(*[f"_{a}" for a in ANSWERS])


# ---- phase hysteresis ---------------------------------------------------------


def _advance(raw: str, status: str, acute: bool | None, shock: float | None, published: str | None,
             candidate: str | None, streak: int) -> tuple[str, str | None, int]:
    """Next (published, candidate, streak) of one series."""
    if status != "OK" or raw == tri.UNKNOWN:
        return tri.UNKNOWN, None, 0
    if published is None or published == tri.UNKNOWN:
        return raw, None, 0
    leaving_acute = published in P.ACUTE_PHASES
    at_once = raw in (P.ACUTE_PHASES if leaving_acute else P.IMMEDIATE_PHASES)
    if at_once or (raw == published and not leaving_acute):
        return raw, None, 0
    if leaving_acute and not (acute is False and shock is not None and shock < 75):
        return published, None, 0
    streak = streak + 1 if candidate == raw else 1
    return (raw, None, 0) if streak >= 2 else (published, raw, streak)


PUBLISHED = T.StructType(
    [
        T.StructField("primary_phase", T.StringType()),
        T.StructField("candidate_phase", T.StringType()),
        T.StructField("candidate_streak", T.IntegerType()),
    ]
)
#: Stands for a published phase that a block of sessions never names; the block keeps it or replaces it.
KEPT = "\0kept"


def _days(pdf: pd.DataFrame) -> list[tuple]:
    none = lambda x: None if x is None or pd.isna(x) else x
    return [
        (raw, status, None if none(acute) is None else bool(acute), None if none(shock) is None else float(shock))
        for raw, status, acute, shock in zip(pdf["raw_phase"], pdf["data_status"], pdf["hard_acute"], pdf["shock"])
    ]


def phase_table(pdf: pd.DataFrame) -> list[list]:
    """Of a block of sessions: (published, candidate) at its start -> (published, candidate, streak) at its end.

    Phases that the block does not name all act alike, so they are one row (``KEPT``); so do candidates that it does
    not name, which are as good as none. Paths that have met go on as one.
    """
    days = _days(pdf)
    named = sorted({raw for raw, *_ in days if raw is not None})
    published = dict.fromkeys([tri.UNKNOWN, KEPT, *P.ACUTE_PHASES, *named])
    now = {(p, c): (p, c, 0 if c is None else 1) for p in published for c in (None, *named)}
    for day in days:
        step = {state: _advance(*day, *state) for state in set(now.values())}
        now = {begin: step[state] for begin, state in now.items()}
    return [[*begin, *end] for begin, end in now.items()]


def enter_phase(state: list, table: list[list]) -> list:
    """(published, candidate, streak) after a block with this table."""
    published, candidate, _ = state
    ends = {(p, c): end for p, c, *end in table}
    known = published or tri.UNKNOWN
    p = known if (known, None) in ends else KEPT
    c = candidate if (p, candidate) in ends else None
    after, candidate, streak = ends[p, c]
    return [known if after == KEPT else after, candidate, streak]


def _published(pdf: pd.DataFrame, state: list) -> pd.DataFrame:
    rows = []
    for day in _days(pdf):
        state = _advance(*day, *state)
        rows.append(state)
    return pd.DataFrame(rows, columns=PUBLISHED.names, dtype=object)


def checkpoint_hash(payload: dict) -> str:
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return "sha256:" + hashlib.sha256(text.encode("utf-8")).hexdigest()


def checkpoint_chain(states: DataFrame, *, config_hash: str) -> DataFrame:
    """(universe, session, previous hash, hash): a hash over each session's published state and the hash before it.

    A chain of hashes can only be followed from its beginning, so a universe is one task; no more than the date and
    three values of a session go there.
    """
    states = states.select(UNIVERSE, "session_date", *PUBLISHED.names)
    hashes = [T.StructField(c, T.StringType()) for c in ("previous_checkpoint_hash", "checkpoint_hash")]

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session_date", kind="stable")
        links: list[str | None] = [None]
        for day, published, candidate, streak in zip(*(pdf[c] for c in ("session_date", *PUBLISHED.names))):
            links.append(
                checkpoint_hash(
                    {
                        "session_date": pd.Timestamp(day).date().isoformat(),
                        "published_phase": published,
                        "candidate_phase": candidate,
                        "candidate_streak": int(streak),
                        "state_version": P.STATE_VERSION,
                        "config_hash": config_hash,
                        "previous_checkpoint_hash": links[-1],
                    }
                )
            )
        out = pdf[[UNIVERSE, "session_date"]]
        return out.assign(previous_checkpoint_hash=links[:-1], checkpoint_hash=links[1:])

    schema = T.StructType([states.schema[UNIVERSE], states.schema["session_date"], *hashes])
    return states.groupBy(UNIVERSE).applyInPandas(chain, schema)


def publish_phases(history: DataFrame, *, span: int = B.SPAN) -> DataFrame:
    """(universe, session, published phase, candidate, streak): a finite-state machine whose blocks of sessions run at
    the same time."""
    return B.fold_rows(
        history, ["raw_phase", "data_status", "hard_acute", "shock"], PUBLISHED, keys=[UNIVERSE], order="session_date",
        start=[None, None, 0], table=phase_table, enter=enter_phase, fill=_published, span=span,
    )


def apply_phase_hysteresis(history: DataFrame, *, config_hash: str, span: int = B.SPAN) -> DataFrame:
    """Published phase with a two-session confirmation, and a hash chain over it."""
    states = durable(publish_phases(history, span=span))
    both = B.joined(states, checkpoint_chain(states, config_hash=config_hash), [UNIVERSE, "session_date"])
    return B.joined(history, both, [UNIVERSE, "session_date"])


def confirm_increases(df: DataFrame, raw: str, out: str, *, keys: list[str], order: str, span: int = B.SPAN) -> DataFrame:
    """Cuts apply at once; a raise needs two consecutive sessions at or above it.

    A unit that is not above the one before it holds whatever the level was (a reset); any other one lowers the level
    to itself at most. So the level is the least unit since the last reset, inside a block and across blocks alike.
    Null units count as 0. Windows hold one block, or one row for each block.
    """
    by = ", ".join(keys)
    own = f"{by + ', ' if by else ''}_block"
    series = f"PARTITION BY {by} " if by else ""
    unit = f"CASE WHEN isnan(double({raw})) THEN 0D ELSE coalesce(double({raw}), 0D) END"
    rows = add(df.select(*keys, order, raw), {"_block": B.block_of(df, order, span), "_u": unit})
    rows = add(rows, {"_again": f"int(coalesce(lag(_u) OVER (PARTITION BY {own} ORDER BY {order}) >= _u, false))"})
    rows = add(rows, {"_reset": f"sum(_again) OVER (PARTITION BY {own} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"})
    rows = add(rows, {"_low": f"min(_u) OVER (PARTITION BY {own}, _reset ORDER BY {order} ROWS UNBOUNDED PRECEDING)"})
    last = "max_by(struct(_u AS u, _low AS low, _reset > 0 AS fixed), " + order + ")"
    ends = rows.groupBy(*keys, "_block").agg(F.expr(f"{last} AS _e"), F.expr(f"min_by(_u, {order}) AS _first"))
    ends = add(ends, {"_from": f"coalesce(lag(_e.u) OVER ({series}ORDER BY _block), 0D) >= _first"})
    ends = add(ends, {"_g": f"sum(int(_e.fixed OR _from)) OVER ({series}ORDER BY _block ROWS UNBOUNDED PRECEDING)"})
    low = f"min(_e.low) OVER (PARTITION BY {by + ', ' if by else ''}_g ORDER BY _block ROWS UNBOUNDED PRECEDING)"
    ends = add(ends, {"_after": f"CASE WHEN _g = 0 THEN least(0D, {low}) ELSE {low} END"})
    ends = add(ends, {"_level": f"coalesce(lag(_after) OVER ({series}ORDER BY _block), 0D)"})
    met = B.joined(rows, ends.select(*keys, "_block", "_from", "_level"), [*keys, "_block"])
    level = "CASE WHEN _reset > 0 OR _from THEN _low ELSE least(_level, _low) END"
    return B.joined(df, add(met, {out: level}).select(*keys, order, out), [*keys, order])
