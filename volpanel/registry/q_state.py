"""Cross-section, market scores, ontology, phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from volpanel import params as P
from volpanel.functions import tri
from volpanel.functions.num import add
from volpanel.operators import market as M
from volpanel.operators import state as St
from volpanel.registry.base import register, shared, step
from volpanel.registry.q_series import feature_history

U = P.DEFAULT_UNIVERSE
CONFIG = "sha256:config"


def k_of(names: list[str], k: int) -> str:
    t = " + ".join(f"CAST(coalesce({n}, false) AS INTEGER)" for n in names)
    u = " + ".join(f"CAST({n} IS NULL AS INTEGER)" for n in names)
    return f"(CASE WHEN {t} >= {k} THEN true WHEN {t} + {u} < {k} THEN false END)"


def branches(pairs: list[tuple[str, str]], default: str) -> str:
    text = "CASE "
    for name, cond in pairs:
        text += f"WHEN ({cond}) THEN '{name}' WHEN ({cond}) IS NULL THEN 'UNKNOWN' "
    return text + f"ELSE '{default}' END"


def _sum(parts) -> str:
    return " + ".join(f"{w!r}e0 * {c}" for c, w in parts)


step(
    "axes",
    "SELECT *, "
    + ", ".join(f"100e0 * ({_sum(parts)}) AS {a}" for a, parts in P.AXES.items())
    + " FROM features",
)
step("axes2", f"SELECT *, {_sum(P.INDEX_PRESSURE)} AS index_pressure FROM axes")
_all = " AND ".join(f"{a} IS NOT NULL" for a in M.AXIS_NAMES)
_any = " OR ".join(f"{a} IS NOT NULL" for a in M.AXIS_NAMES)
step(
    "scored",
    f"""SELECT *, CASE WHEN surface_status = 'VALID' AND {_all} THEN 'OK'
               WHEN coalesce(surface_status, 'UNKNOWN') <> 'UNKNOWN' OR {_any} THEN 'PARTIAL' ELSE 'UNKNOWN' END AS data_status FROM axes2""",
)
_fields = [*M.AXIS_NAMES, "p_d1_log_iv30", *dict.fromkeys(M.RAW_AGGREGATES.values())]
_pivot = ", ".join(
    f"max(CASE WHEN economic_index_id = '{i}' THEN {f} END) AS {f}_{n}" for f in _fields for n, i in enumerate(U.indices)
)
step(
    "pivoted",
    f"""SELECT session_date, {_pivot}, count(*) FILTER (WHERE data_status = 'OK') AS ok_count,
               count(*) FILTER (WHERE issues <> '') AS issue_rows
        FROM scored GROUP BY session_date HAVING count(*) = 4 AND count(DISTINCT economic_index_id) = 4""",
)


def _cross(f: str) -> str:
    return " + ".join(f"{m.weight!r}e0 * {f}_{n}" for n, m in enumerate(U.members))


def _seg(f: str, s: str) -> str:
    return " + ".join(f"{m.segment_share!r}e0 * {f}_{n}" for n, m in enumerate(U.members) if m.segment == s)


def _stress(get) -> str:
    return (
        f"(({get('index_pressure')}) >= 65 AND (({get('shock')}) >= 65 OR ({get('down_tail')}) >= 70 "
        f"OR ({get('persistence')}) >= 65))"
    )


_segcols = ", ".join(
    f"{_stress(lambda f, s=s: _seg(f, s))} AS {s}_stressed, {_seg('p_d1_log_iv30', s)} AS {s}_jump_score" for s in U.segments
)
_idxcols = ", ".join(f"{_stress(lambda f, n=n: f'{f}_{n}')} AS stressed_{n}" for n in range(4))
step(
    "crossed",
    f"""SELECT *, CASE WHEN ok_count = 4 THEN 'OK' WHEN ok_count > 0 THEN 'PARTIAL' ELSE 'UNKNOWN' END AS data_status,
        {_segcols}, {_idxcols},
        ({' OR '.join(f'abs(shock_{n} - down_tail_{n}) >= 50' for n in range(4))}) AS axis_gap_any,
        CASE WHEN {' AND '.join(f'index_pressure_{n} IS NOT NULL' for n in range(4))}
             THEN greatest({', '.join(f'index_pressure_{n}' for n in range(4))}) - least({', '.join(f'index_pressure_{n}' for n in range(4))}) END AS cross_section_pressure_dispersion,
        {', '.join(f'{_cross(a)} AS raw_{a}' for a in M.MARKET_AXES)},
        {', '.join(f'{_cross(src)} AS {out}' for out, src in M.RAW_AGGREGATES.items())}
        FROM pivoted""",
)
_segs = [f"{s}_stressed" for s in U.segments]
step(
    "breadth_table",
    f"""SELECT *, {' + '.join(f'CAST({s} AS INTEGER)' for s in _segs)} AS stressed_segment_count,
        {' + '.join(f'CAST(stressed_{n} AS INTEGER)' for n in range(4))} AS stressed_index_count,
        {k_of(_segs, 2)} AS broad_confirmed, {k_of(_segs, 3)} AS systemic_confirmed,
        {', '.join(f'{s}_jump_score >= 0.9e0 AS {s}_jump' for s in U.segments)}
        FROM crossed""",
)
_jumps = [f"{s}_jump" for s in U.segments]
step(
    "market0",
    f"""SELECT *, 100e0 * stressed_segment_count / 3 AS raw_breadth, {k_of(_jumps, 2)} AS cross_market_iv_jump,
        {k_of(_jumps, 3)} AS all_segment_iv_jump, stressed_index_count / 4 AS nominal_index_breadth,
        100e0 * (0.4e0 * CAST(large_stressed AS INTEGER) + 0.3e0 * CAST(mid_stressed AS INTEGER) + 0.3e0 * CAST(tech_stressed AS INTEGER)) AS weighted_breadth_score,
        CASE WHEN data_status = 'OK' THEN CASE WHEN issue_rows > 0 THEN 'DEGRADED' ELSE 'FULL' END
             WHEN data_status = 'PARTIAL' THEN 'LOW' ELSE 'NONE' END AS confidence
        FROM breadth_table""",
)
_mp = " + ".join(f"{w!r}e0 * raw_{a}" for a, w in P.MARKET_PRESSURE)
_ok = f"data_status = 'OK' AND ({_mp}) IS NOT NULL"
step(
    "market1",
    f"""SELECT *, CASE WHEN {_ok} THEN {_mp} END AS pressure_score,
        {', '.join(f'CASE WHEN {_ok} THEN raw_{a} END AS {a}' for a in [*M.MARKET_AXES, 'breadth'])},
        row_number() OVER (ORDER BY session_date) - 1 AS pos FROM market0""",
)
step(
    "market",
    """SELECT m.*, m.pressure_score - lag(m.pressure_score, 5) OVER (ORDER BY m.session_date) AS d5_pressure_score, k.pct AS aggregate_d5_fvol30_90_percentile
       FROM market1 m LEFT JOIN (
         SELECT c.session_date, CASE WHEN any_value(c.aggregate_d5_fvol30_90) IS NOT NULL AND count(r.aggregate_d5_fvol30_90) >= 126 THEN
                (count(*) FILTER (WHERE r.aggregate_d5_fvol30_90 < c.aggregate_d5_fvol30_90)
                 + 0.5e0 * count(*) FILTER (WHERE r.aggregate_d5_fvol30_90 = c.aggregate_d5_fvol30_90)) / count(r.aggregate_d5_fvol30_90) END AS pct
         FROM market1 c JOIN market1 r ON r.pos BETWEEN c.pos - 504 AND c.pos - 1 GROUP BY 1) k USING (session_date)""",
)
step(
    "pred1",
    """SELECT *, persistence >= 75 AND pressure_score >= 65 AS persistent_day,
       shock >= 85 AND cross_market_iv_jump AND (down_tail >= 75 OR broad_confirmed) AS hard_acute FROM market""",
)
step("pred2", "SELECT *, pressure_score >= 70 OR hard_acute AS stress_day FROM pred1")


def k_window(name: str, width: int, k: int) -> str:
    over = f"OVER (ORDER BY session_date ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    t = f"count(*) FILTER (WHERE {name}) {over}"
    f = f"count(*) FILTER (WHERE NOT {name}) {over}"
    return f"(CASE WHEN {t} >= {k} THEN true WHEN {width} - {f} < {k} THEN false END)"


step(
    "pred3",
    f"""SELECT *, {k_window('persistent_day', 5, 3)} AS persistent_now, {k_window('stress_day', 10, 1)} AS recent_stress,
        lag(repair) OVER (ORDER BY session_date) AS prior_repair, lag(pressure_score) OVER (ORDER BY session_date) AS prior_pressure,
        lag(breadth) OVER (ORDER BY session_date) AS prior_breadth FROM pred2""",
)
step(
    "pred4",
    """SELECT *, recent_stress AND repair >= 70 AND prior_repair >= 70 AND pressure_score < prior_pressure AND breadth <= prior_breadth AND NOT hard_acute AS repair_confirmed,
       (cross_section_pressure_dispersion >= 50 AND NOT broad_confirmed) OR (axis_gap_any AND NOT broad_confirmed)
       OR CASE WHEN stressed_segment_count IS NOT NULL AND stressed_index_count IS NOT NULL THEN stressed_segment_count = 0 AND stressed_index_count >= 2 END AS fragmented_now
       FROM pred3""",
)
_counted = "stressed_segment_count IS NOT NULL AND stressed_index_count IS NOT NULL"
_one = (
    "CASE WHEN coalesce(mid_stressed, false) AND coalesce(tech_stressed, false) THEN false "
    "WHEN mid_stressed IS NULL AND coalesce(tech_stressed, true) THEN NULL "
    "WHEN tech_stressed IS NULL AND coalesce(mid_stressed, true) THEN NULL "
    "WHEN mid_stressed IS NULL OR tech_stressed IS NULL THEN NULL ELSE mid_stressed OR tech_stressed END"
)
_breadth = branches(
    [
        ("NONE", f"CASE WHEN {_counted} THEN stressed_index_count = 0 AND stressed_segment_count = 0 AND NOT fragmented_now END"),
        ("ISOLATED", f"CASE WHEN {_counted} THEN stressed_index_count = 1 AND stressed_segment_count = 0 END"),
        ("BLUE_CHIP_LOCALIZED", "large_stressed AND NOT mid_stressed AND NOT tech_stressed"),
        ("LOCAL_STYLE", f"NOT large_stressed AND ({_one})"),
        ("SYSTEMIC", "systemic_confirmed"),
        ("BROAD", "broad_confirmed AND NOT systemic_confirmed"),
        ("FRAGMENTED", "NOT broad_confirmed AND fragmented_now"),
    ],
    "UNKNOWN",
)
_term = branches(
    [
        ("PERSISTENT", "persistent_now"),
        ("DIFFUSING", "persistence >= 55 AND aggregate_d5_fvol30_90 > 0 AND aggregate_d5_fvol30_90_percentile >= 0.7e0"),
        ("FRONT_LOCALIZED", "shock >= 65 AND persistence < 50"),
        ("NORMAL", "persistence < 55 AND shock < 65"),
    ],
    "MIXED",
)
_usable = "data_status = 'OK' AND pressure_score IS NOT NULL"
step(
    "answers0",
    f"""SELECT *,
      CASE WHEN insurance_level IS NULL THEN 'UNKNOWN' WHEN insurance_level < 35 THEN 'CHEAP' WHEN insurance_level < 60 THEN 'NORMAL' WHEN insurance_level < 85 THEN 'RICH' ELSE 'EXTREME' END AS a_level,
      CASE WHEN shock IS NULL THEN 'UNKNOWN' WHEN shock < 40 THEN 'CALM' WHEN shock < 65 THEN 'BUILDING' WHEN hard_acute THEN 'ACUTE' WHEN NOT hard_acute THEN 'HIGH' ELSE 'UNKNOWN' END AS a_shock,
      CASE WHEN down_tail IS NULL OR up_tail IS NULL THEN 'UNKNOWN' WHEN down_tail < 60 AND up_tail < 60 THEN 'NEUTRAL'
           WHEN down_tail >= 75 AND up_tail >= 75 AND abs(down_tail - up_tail) < 15 THEN 'TWO_SIDED_EVENT'
           WHEN down_tail >= 60 AND down_tail - up_tail >= 15 THEN 'DOWNSIDE_PRICED' WHEN up_tail >= 60 AND up_tail - down_tail >= 15 THEN 'UPSIDE_PRICED' ELSE 'MIXED' END AS a_tail,
      CASE WHEN persistence IS NULL OR shock IS NULL THEN 'UNKNOWN' ELSE {_term} END AS a_term,
      {_breadth} AS a_breadth,
      CASE WHEN repair IS NULL THEN 'UNKNOWN' WHEN repair < 60 OR (recent_stress IS NOT NULL AND NOT recent_stress) THEN 'INACTIVE' WHEN recent_stress IS NULL THEN 'UNKNOWN'
           WHEN repair_confirmed THEN 'CONFIRMED' WHEN NOT repair_confirmed THEN 'BUILDING' ELSE 'UNKNOWN' END AS a_repair
      FROM pred4""",
)
_sys = "hard_acute AND a_breadth = 'SYSTEMIC' AND all_segment_iv_jump"
_phase = branches(
    [
        ("SYSTEMIC_ACUTE_STRESS", _sys),
        ("LOCALIZED_ACUTE_STRESS", f"hard_acute AND NOT ({_sys})"),
        ("REPAIR_IN_PROGRESS", "a_repair = 'CONFIRMED' AND NOT hard_acute"),
        ("BROAD_PERSISTENT_PRESSURE", "persistent_now AND broad_confirmed"),
        ("BROAD_PRESSURE", "broad_confirmed AND pressure_score >= 65"),
        ("LOCAL_STYLE_PRESSURE", "a_breadth = 'LOCAL_STYLE' AND pressure_score >= 55"),
        ("BLUE_CHIP_PRESSURE", "a_breadth = 'BLUE_CHIP_LOCALIZED' AND pressure_score >= 55"),
        ("DOWNSIDE_TAIL_RICH", "down_tail >= 75 AND shock < 65 AND NOT broad_confirmed"),
        ("UPSIDE_CONVEXITY_PRICED", "a_tail = 'UPSIDE_PRICED' AND up_tail >= 75 AND aggregate_etf_return_5d > 0"),
        ("FRAGMENTED_TRANSITION", "a_breadth = 'FRAGMENTED'"),
        ("CALM_POSITIVE_VRP", "CASE WHEN aggregate_vrp_value IS NULL THEN false ELSE pressure_score < 35 AND shock < 40 AND aggregate_vrp_value > 0 END"),
    ],
    "BALANCED_MARKET",
)
step(
    "ontology",
    f"""SELECT * EXCLUDE (pos), CASE WHEN {_usable} THEN {_phase} ELSE 'UNKNOWN' END AS raw_phase,
      CASE WHEN NOT ({_usable}) THEN 'UNKNOWN' WHEN pressure_score < 35 THEN 'LOW' WHEN pressure_score < 55 THEN 'WATCH' WHEN pressure_score < 70 THEN 'ELEVATED' WHEN pressure_score < 85 THEN 'HIGH' ELSE 'EXTREME' END AS pressure_level,
      CASE WHEN NOT ({_usable}) OR d5_pressure_score IS NULL THEN 'UNKNOWN' WHEN d5_pressure_score >= 7.5 THEN 'RISING' WHEN d5_pressure_score <= -7.5 THEN 'FALLING' ELSE 'STABLE' END AS direction,
      {', '.join(f"CASE WHEN {_usable} THEN a_{a} ELSE 'UNKNOWN' END AS {a}_answer" for a in St.ANSWERS)},
      pos FROM answers0""",
)
_imm = ", ".join(f"'{p}'" for p in P.IMMEDIATE_PHASES)
_acu = ", ".join(f"'{p}'" for p in P.ACUTE_PHASES)
# One row per position: the state after it, folded from the state before it.
_next = f"""CASE WHEN o.data_status <> 'OK' OR o.raw_phase = 'UNKNOWN' THEN {{'p': 'UNKNOWN', 'c': NULL::VARCHAR, 's': 0}}
  WHEN f.st.p IS NULL OR f.st.p = 'UNKNOWN' THEN {{'p': o.raw_phase, 'c': NULL::VARCHAR, 's': 0}}
  WHEN f.st.p IN ({_acu}) THEN CASE
    WHEN o.raw_phase IN ({_acu}) THEN {{'p': o.raw_phase, 'c': NULL::VARCHAR, 's': 0}}
    WHEN o.hard_acute = false AND o.shock < 75 THEN CASE WHEN f.st.c = o.raw_phase AND f.st.s + 1 >= 2 THEN {{'p': o.raw_phase, 'c': NULL::VARCHAR, 's': 0}}
         ELSE {{'p': f.st.p, 'c': o.raw_phase, 's': 1}} END
    ELSE {{'p': f.st.p, 'c': NULL::VARCHAR, 's': 0}} END
  WHEN o.raw_phase IN ({_imm}) OR o.raw_phase = f.st.p THEN {{'p': o.raw_phase, 'c': NULL::VARCHAR, 's': 0}}
  WHEN f.st.c = o.raw_phase AND f.st.s + 1 >= 2 THEN {{'p': o.raw_phase, 'c': NULL::VARCHAR, 's': 0}}
  ELSE {{'p': f.st.p, 'c': o.raw_phase, 's': 1}} END"""
step(
    "phase_fold",
    f"""SELECT CAST(-1 AS BIGINT) AS pos, {{'p': NULL::VARCHAR, 'c': NULL::VARCHAR, 's': 0}} AS st, NULL::VARCHAR AS prev_hash, NULL::VARCHAR AS hash
        UNION ALL
        SELECT pos, st, prev_hash, 'sha256:' || sha256('{{"candidate_phase":' || coalesce('"' || st.c || '"', 'null') || ',"candidate_streak":' || st.s ||
             ',"config_hash":"{CONFIG}","previous_checkpoint_hash":' || coalesce('"' || prev_hash || '"', 'null') || ',"published_phase":"' || st.p ||
             '","session_date":"' || strftime(session_date, '%Y-%m-%d') || '","state_version":"{P.STATE_VERSION}"}}') AS hash
        FROM (SELECT o.pos, o.session_date, {_next} AS st, f.hash AS prev_hash FROM phase_fold f JOIN ontology o ON o.pos = f.pos + 1) n""",
    recursive=True,
)
step(
    "state",
    """SELECT o.*, f.st.p AS primary_phase, f.st.c AS candidate_phase, f.st.s AS candidate_streak, f.prev_hash AS previous_checkpoint_hash, f.hash AS checkpoint_hash
       FROM ontology o JOIN phase_fold f USING (pos)""",
)


@shared
def scored(spark: SparkSession, folder: str) -> DataFrame:
    return M.score_indices(feature_history(spark, folder))


@shared
def market(spark: SparkSession, folder: str) -> DataFrame:
    return M.build_market_score_history(feature_history(spark, folder), minimum_valid=P.RESEARCH_MINIMUM_VALID)


@shared
def state(spark: SparkSession, folder: str) -> DataFrame:
    return St.apply_phase_hysteresis(St.add_state_ontology(market(spark, folder)), config_hash=CONFIG)


_axis_cols = " ".join(f"{a}~" for a in M.AXIS_NAMES)


@register("x07_index_scores", f"session_date economic_index_id data_status {_axis_cols}", "SELECT * FROM scored")
def _(spark, folder):
    return scored(spark, folder)


@register(
    "a07_weighted_axes",
    "session_date " + " ".join(f"{a}~" for a in [*M.MARKET_AXES, *M.RAW_AGGREGATES]),
    "SELECT * FROM market1",
)
def _(spark, folder):
    return M.aggregate_sessions(scored(spark, folder))


@register(
    "a08_segment_values",
    "session_date large_jump_score~ mid_jump_score~ tech_jump_score~ large_jump mid_jump tech_jump",
    "SELECT * FROM breadth_table",
)
def _(spark, folder):
    return M.aggregate_sessions(scored(spark, folder))


@register(
    "a09_breadth",
    "session_date large_stressed mid_stressed tech_stressed stressed_segment_count# stressed_index_count# broad_confirmed "
    "systemic_confirmed breadth~ weighted_breadth_score~ nominal_index_breadth~",
    "SELECT * FROM market1",
)
def _(spark, folder):
    return M.aggregate_sessions(scored(spark, folder))


@register("a10_dispersion", "session_date cross_section_pressure_dispersion~", "SELECT * FROM market1")
def _(spark, folder):
    return M.aggregate_sessions(scored(spark, folder))


@register(
    "p13_stressed_predicate",
    "session_date economic_index_id stressed",
    "SELECT session_date, economic_index_id, index_pressure >= 65 AND (shock >= 65 OR down_tail >= 70 OR persistence >= 65) AS stressed FROM scored",
)
def _(spark, folder):
    return add(scored(spark, folder), {"stressed": tri.stressed("index_pressure", "shock", "down_tail", "persistence")})


_market_cols = (
    "session_date data_status confidence pressure_score~ d5_pressure_score~ breadth~ cross_market_iv_jump all_segment_iv_jump "
    "aggregate_d5_fvol30_90_percentile~ " + " ".join(f"{a}~" for a in M.MARKET_AXES)
)


@register("a11_market_session", _market_cols, "SELECT * FROM market")
def _(spark, folder):
    return market(spark, folder)


@register(
    "x08_market_score_history",
    _market_cols + " cross_section_pressure_dispersion~ aggregate_vrp_value~ aggregate_vrp_percentile~",
    "SELECT * FROM market",
)
def _(spark, folder):
    return market(spark, folder)


@register(
    "w06_k_of_n_window",
    "session_date persistent_day persistent_now stress_day recent_stress",
    "SELECT * FROM pred4",
)
def _(spark, folder):
    return St.add_predicates(market(spark, folder))


@register("w07_prior_row_repair", "session_date repair~ recent_stress hard_acute repair_confirmed", "SELECT * FROM pred4")
def _(spark, folder):
    return St.add_predicates(market(spark, folder))


_answers = " ".join(f"{a}_answer" for a in St.ANSWERS)


@register("p12_priority_answers", "session_date term_answer breadth_answer raw_phase", "SELECT * FROM ontology")
def _(spark, folder):
    return St.add_state_ontology(market(spark, folder))


@register(
    "p19_enum_thresholds",
    "session_date level_answer shock_answer tail_answer pressure_level direction",
    "SELECT * FROM ontology",
)
def _(spark, folder):
    return St.add_state_ontology(market(spark, folder))


@register(
    "x09_state_ontology",
    f"session_date {_answers} pressure_level direction fragmented_now persistent_now hard_acute repair_confirmed raw_phase",
    "SELECT * FROM ontology",
)
def _(spark, folder):
    return St.add_state_ontology(market(spark, folder))


@register(
    "f01_phase_hysteresis",
    "session_date raw_phase primary_phase candidate_phase candidate_streak#",
    "SELECT * FROM state",
)
def _(spark, folder):
    return state(spark, folder)


@register("f02_checkpoint_chain", "session_date previous_checkpoint_hash checkpoint_hash", "SELECT * FROM state")
def _(spark, folder):
    return state(spark, folder)


@register("x10_published_phase", "session_date raw_phase primary_phase pressure_level direction", "SELECT * FROM state")
def _(spark, folder):
    return state(spark, folder)
