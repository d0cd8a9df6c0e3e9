"""Cross-section of the indices: axes, segments, breadth, market scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel import params as P
from volpanel.functions import tri
from volpanel.functions.num import add, issue_count, weighted
from volpanel.operators import series as S

UNIVERSE = "universe_id"
AXIS_NAMES = [*P.AXES, "index_pressure"]
MARKET_AXES = list(P.AXES)
RAW_AGGREGATES = {
    "aggregate_d5_fvol30_90": "d5_fvol_30_90",
    "aggregate_etf_return_5d": "etf_return_5d",
    "aggregate_vrp_value": "vrp_ewma94",
    "aggregate_vrp_percentile": "vrp_percentile",
    "aggregate_iv_vol_of_vol_percentile": "p_iv_vol_of_vol20",
}


def score_indices(features: DataFrame) -> DataFrame:
    """Seven axes and a status for every index row."""
    df = add(features, {name: f"100D * {weighted(parts)}" for name, parts in P.AXES.items()})
    df = add(df, {"index_pressure": weighted(P.INDEX_PRESSURE)})
    known = [f"{a} IS NOT NULL" for a in AXIS_NAMES]
    status = (
        f"CASE WHEN surface_status = 'VALID' AND {tri.all_of(*known)} THEN 'OK' "
        f"WHEN coalesce(surface_status, 'UNKNOWN') <> 'UNKNOWN' OR {tri.any_of(*known)} THEN 'PARTIAL' "
        "ELSE 'UNKNOWN' END"
    )
    return add(df, {"data_status": status})


def aggregate_sessions(scored: DataFrame, universe: P.Universe = P.DEFAULT_UNIVERSE) -> DataFrame:
    """One row per (universe, session) whose members are exactly the universe.

    The members are gathered by one aggregate (a struct per member), so the
    universe check, the pivot and all market measures share a single shuffle.
    """
    extra = {UNIVERSE: "'DEFAULT'", "issues": "''"}
    scored = add(scored, {c: e for c, e in extra.items() if c not in scored.columns})
    fields = [*AXIS_NAMES, "data_status", "issues", "p_d1_log_iv30", *dict.fromkeys(RAW_AGGREGATES.values())]
    slot = {i: f"_m{n}" for n, i in enumerate(universe.indices)}
    names = ", ".join(f"'{i}'" for i in universe.indices)
    member = ", ".join(fields)
    gathered = scored.groupBy(UNIVERSE, "session_date").agg(
        *[
            F.expr(f"first(CASE WHEN economic_index_id = '{i}' THEN struct({member}) END, true) AS {s}")
            for i, s in slot.items()
        ],
        F.expr(f"bool_or(coalesce(economic_index_id NOT IN ({names}), true)) AS _foreign"),
    )
    gathered = gathered.filter(tri.all_of("NOT _foreign", *[f"{s} IS NOT NULL" for s in slot.values()]))

    def across(name: str) -> str:
        return weighted([(f"{slot[m.index]}.{name}", m.weight) for m in universe.members])

    def segment(name: str, s: str) -> str:
        return weighted(
            [(f"{slot[m.index]}.{name}", m.segment_share) for m in universe.members if m.segment == s]
        )

    n_members, n_segments = len(universe.members), len(universe.segments)
    every = list(slot.values())
    ok = "(" + " + ".join(f"int({s}.data_status = 'OK')" for s in every) + ")"
    axes4 = ("index_pressure", "shock", "down_tail", "persistence")
    index_stressed = {i: tri.stressed(*[f"{s}.{a}" for a in axes4]) for i, s in slot.items()}
    pressures = ", ".join(f"{s}.index_pressure" for s in every)
    columns = {
        "data_status": f"CASE WHEN {ok} = {n_members} THEN 'OK' WHEN {ok} > 0 THEN 'PARTIAL' ELSE 'UNKNOWN' END",
        "_degraded": tri.any_of(*[f"{issue_count(f'{s}.issues')} > 0" for s in every]),
        "stressed_index_count": tri.count_if_all_known(list(index_stressed.values())),
        "index_stressed": "map(" + ", ".join(f"'{i}', {p}" for i, p in index_stressed.items()) + ")",
        "axis_gap_any": tri.any_of(*[f"abs({s}.shock - {s}.down_tail) >= 50" for s in every]),
        "cross_section_pressure_dispersion": (
            f"CASE WHEN {tri.all_of(*[f'{s}.index_pressure IS NOT NULL' for s in every])} "
            f"THEN greatest({pressures}) - least({pressures}) END"
        ),
        "economic_indices": "map(" + ", ".join(
            f"'{m.index}', named_struct('source_carrier', '{m.carrier}', 'data_status', {slot[m.index]}.data_status, "
            + ", ".join(f"'{a}', {slot[m.index]}.{a}" for a in AXIS_NAMES)
            + f", 'issues', coalesce({slot[m.index]}.issues, ''))"
            for m in universe.members
        ) + ")",
        **{f"{s}_stressed": tri.stressed(*[segment(a, s) for a in axes4]) for s in universe.segments},
        **{f"{s}_jump_score": segment("p_d1_log_iv30", s) for s in universe.segments},
        **{f"_{a}": across(a) for a in MARKET_AXES},
        **{out: across(source) for out, source in RAW_AGGREGATES.items()},
    }
    df = add(gathered, columns)
    stressed = [f"{s}_stressed" for s in universe.segments]
    df = add(
        df,
        {
            "stressed_segment_count": tri.count_if_all_known(stressed),
            "broad_confirmed": tri.at_least_k(stressed, 2),
            "systemic_confirmed": tri.at_least_k(stressed, 3),
            **{f"{s}_jump": f"{s}_jump_score >= {P.SEGMENT_JUMP_PERCENTILE}D" for s in universe.segments},
        },
    )
    jumps = [f"{s}_jump" for s in universe.segments]
    share = weighted([(f"int({s}_stressed)", w) for s, w in universe.segment_weights])
    df = add(
        df,
        {
            "_breadth": f"100D * stressed_segment_count / {n_segments}",
            "weighted_breadth_score": f"100D * {share}",
            "nominal_index_breadth": f"stressed_index_count / {n_members}",
            "cross_market_iv_jump": tri.at_least_k(jumps, 2),
            "all_segment_iv_jump": tri.at_least_k(jumps, 3),
            "evidence_tier": "'RESEARCH_ONLY'",
            "confidence": (
                "CASE WHEN data_status = 'OK' THEN if(_degraded, 'DEGRADED', 'FULL') "
                "WHEN data_status = 'PARTIAL' THEN 'LOW' ELSE 'NONE' END"
            ),
        },
    )
    df = add(df, {"_pressure": weighted([(f"_{a}", w) for a, w in P.MARKET_PRESSURE])})
    published = "data_status = 'OK' AND _pressure IS NOT NULL"
    df = add(
        df,
        {
            "pressure_score": f"CASE WHEN {published} THEN _pressure END",
            **{a: f"CASE WHEN {published} THEN _{a} END" for a in [*MARKET_AXES, "breadth"]},
        },
    )
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def build_market_score_history(
    features: DataFrame,
    universe: P.Universe = P.DEFAULT_UNIVERSE,
    *,
    reference_sessions: int = P.REFERENCE_SESSIONS,
    minimum_valid: int = P.MINIMUM_VALID,
) -> DataFrame:
    market = aggregate_sessions(score_indices(features), universe)
    change = S.difference("pressure_score", S.by([UNIVERSE], "session_date"))
    return S.midrank_percentiles(
        add(market, {"d5_pressure_score": change}),
        {"aggregate_d5_fvol30_90_percentile": ("aggregate_d5_fvol30_90", 1)},
        keys=[UNIVERSE],
        reference=reference_sessions,
        minimum_valid=minimum_valid,
    )
