"""Parameters with their default values.

Everything in this module is a fixed value that results depend on.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- universe -------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    index: str
    carrier: str
    underlying: str
    option_code: str
    weight: float
    segment: str
    segment_share: float


@dataclass(frozen=True)
class Universe:
    """The indices whose cross-section makes one market, in their canonical order."""

    members: tuple[Member, ...]
    segment_weights: tuple[tuple[str, float], ...]
    excluded_option_codes: tuple[str, ...] = ()
    excluded_carriers: tuple[str, ...] = ()

    @property
    def indices(self) -> list[str]:
        return [m.index for m in self.members]

    @property
    def carriers(self) -> list[str]:
        return [m.carrier for m in self.members]

    @property
    def segments(self) -> list[str]:
        return [name for name, _ in self.segment_weights]

    def weight(self, index: str) -> float:
        return next(m.weight for m in self.members if m.index == index)


DEFAULT_UNIVERSE = Universe(
    members=(
        Member("SSE50", "SSE50_510050", "510050.SH", "OP510050.SH", 0.20, "large", 0.5),
        Member("CSI300", "CSI300_510300", "510300.SH", "OP510300.SH", 0.20, "large", 0.5),
        Member("CSI500", "CSI500_510500", "510500.SH", "OP510500.SH", 0.30, "mid", 1.0),
        Member("STAR50", "STAR50_588000", "588000.SH", "OP588000.SH", 0.30, "tech", 1.0),
    ),
    segment_weights=(("large", 0.40), ("mid", 0.30), ("tech", 0.30)),
    excluded_option_codes=("OP588080.SH",),
    excluded_carriers=("STAR50_588080",),
)

# ---- surface --------------------------------------------------------------


@dataclass(frozen=True)
class SurfaceParams:
    minimum_total_strikes: int = 9
    minimum_otm_puts: int = 4
    minimum_otm_calls: int = 4
    minimum_pairs: int = 5
    discount_bounds: tuple[float, float] = (0.94, 1.02)
    forward_spot_bounds: tuple[float, float] = (0.65, 1.35)
    nearest_delta_max_distance: float = 0.12
    nearest_atm_log_moneyness: float = 0.08
    minimum_expiry_days: float = 7.0
    tenor_proxy_days: tuple[tuple[int, int], ...] = ((30, 18), (60, 35), (90, 45))
    smile_target_days: int = 30
    smile_proxy_days: int = 18
    include_adjusted: bool = True
    sigma_bounds: tuple[float, float] = (1e-4, 5.0)
    methodology_version: str = "RESEARCH_MINUTE_CLOSE_V2"


# ---- features and scores --------------------------------------------------

REFERENCE_SESSIONS = 504
MINIMUM_VALID = 252
RESEARCH_MINIMUM_VALID = 126
VOV_SPAN_SESSIONS = 80
VOV_COUNT = 20
EWMA_DECAY = 0.94
EWMA_WARMUP = 252
SESSIONS_PER_YEAR = 252.0

# percentile column -> (source column, sign)
PERCENTILES: dict[str, tuple[str, int]] = {
    "p_iv30": ("iv30_mf", 1),
    "p_d1_log_iv30": ("d1_log_iv30", 1),
    "p_d5_log_iv30": ("d5_log_iv30", 1),
    "p_iv_vol_of_vol20": ("iv_vol_of_vol20", 1),
    "p_neg_etf_return_1d": ("etf_return_1d", -1),
    "p_down_skew25": ("down_skew25", 1),
    "p_d5_down_skew25": ("d5_down_skew25", 1),
    "p_up_skew25": ("up_skew25", 1),
    "p_d5_up_skew25": ("d5_up_skew25", 1),
    "p_fvol_30_90": ("fvol_30_90", 1),
    "p_iv90": ("iv90_mf", 1),
    "p_d5_fvol_30_90": ("d5_fvol_30_90", 1),
    "p_term_log_ratio_30_90": ("term_log_ratio_30_90", 1),
    "p_neg_d5_log_iv30": ("d5_log_iv30", -1),
    "p_neg_d5_down_skew25": ("d5_down_skew25", -1),
    "p_neg_d5_fvol_30_90": ("d5_fvol_30_90", -1),
    "p_etf_return_5d": ("etf_return_5d", 1),
    "p_neg_d5_iv_vol_of_vol20": ("d5_iv_vol_of_vol20", -1),
    "p_vrp": ("vrp_ewma94", 1),
}

# axis -> ((percentile column, weight), ...); an axis is 100 x the weighted sum
AXES: dict[str, tuple[tuple[str, float], ...]] = {
    "insurance_level": (("p_iv30", 1.0),),
    "shock": (
        ("p_d1_log_iv30", 0.35),
        ("p_d5_log_iv30", 0.25),
        ("p_iv_vol_of_vol20", 0.20),
        ("p_neg_etf_return_1d", 0.20),
    ),
    "down_tail": (("p_down_skew25", 0.65), ("p_d5_down_skew25", 0.35)),
    "up_tail": (("p_up_skew25", 0.65), ("p_d5_up_skew25", 0.35)),
    "persistence": (
        ("p_fvol_30_90", 0.40),
        ("p_iv90", 0.25),
        ("p_d5_fvol_30_90", 0.20),
        ("p_term_log_ratio_30_90", 0.15),
    ),
    "repair": (
        ("p_neg_d5_log_iv30", 0.30),
        ("p_neg_d5_down_skew25", 0.25),
        ("p_neg_d5_fvol_30_90", 0.20),
        ("p_etf_return_5d", 0.15),
        ("p_neg_d5_iv_vol_of_vol20", 0.10),
    ),
}
INDEX_PRESSURE = (("insurance_level", 0.20), ("shock", 0.30), ("down_tail", 0.25), ("persistence", 0.25))
MARKET_PRESSURE = (
    ("insurance_level", 0.20),
    ("shock", 0.25),
    ("down_tail", 0.20),
    ("persistence", 0.15),
    ("breadth", 0.20),
)
SEGMENT_JUMP_PERCENTILE = 0.90

# ---- state ----------------------------------------------------------------

ACUTE_PHASES = ("SYSTEMIC_ACUTE_STRESS", "LOCALIZED_ACUTE_STRESS")
IMMEDIATE_PHASES = (
    "SYSTEMIC_ACUTE_STRESS",
    "LOCALIZED_ACUTE_STRESS",
    "REPAIR_IN_PROGRESS",
    "BROAD_PERSISTENT_PRESSURE",
)
STRESSED_PHASES = (
    "SYSTEMIC_ACUTE_STRESS",
    "LOCALIZED_ACUTE_STRESS",
    "BROAD_PERSISTENT_PRESSURE",
    "BROAD_PRESSURE",
    "LOCAL_STYLE_PRESSURE",
    "BLUE_CHIP_PRESSURE",
)
STATE_VERSION = "1.0.0"

# ---- events ---------------------------------------------------------------


@dataclass(frozen=True)
class EventSpec:
    event_id: str
    horizon: int
    seed: int
    predictors: tuple[str, ...]


EVENTS: tuple[EventSpec, ...] = (
    EventSpec(
        "cross_market_iv_jump_1d",
        1,
        1101,
        (
            "insurance_level_scaled",
            "shock_scaled",
            "down_tail_scaled",
            "breadth_scaled",
            "aggregate_iv_vol_of_vol_percentile",
            "pressure_change5_scaled",
        ),
    ),
    EventSpec(
        "broad_pressure_onset_5d",
        5,
        1102,
        (
            "shock_scaled",
            "breadth_scaled",
            "persistence_scaled",
            "down_tail_scaled",
            "cross_section_pressure_dispersion_scaled",
            "pressure_change5_scaled",
        ),
    ),
    EventSpec(
        "systemic_acute_stress_5d",
        5,
        1103,
        (
            "shock_scaled",
            "down_tail_scaled",
            "breadth_scaled",
            "segment_iv_jump_true_share",
            "persistence_scaled",
            "pressure_change5_scaled",
        ),
    ),
    EventSpec(
        "persistent_cross_market_stress_20d",
        20,
        1104,
        (
            "insurance_level_scaled",
            "persistence_scaled",
            "breadth_scaled",
            "down_tail_scaled",
            "aggregate_vrp_percentile",
            "pressure_change5_scaled",
        ),
    ),
    EventSpec(
        "fast_repair_5d",
        5,
        1105,
        (
            "repair_scaled",
            "inverse_pressure_change5_scaled",
            "shock_scaled",
            "persistence_scaled",
            "breadth_scaled",
            "down_tail_scaled",
        ),
    ),
)


@dataclass(frozen=True)
class ModelParams:
    minimum_training: int = 504
    maximum_training: int = 1260
    minimum_positive: int = 25
    minimum_negative: int = 25
    inverse_penalty: float = 1.0
    base_rate_rows: int = 504
    calibration_rows: int = 252
    calibration_minimum_class: int = 20
    block: int = 64


# ---- short-volatility research -------------------------------------------

INITIAL_CAPITAL = 1_000_000.0
MULTIPLIER = 10_000.0
RISK_BUDGET = 0.08
MARGIN_CAP = 0.35
PARTICIPATION = 0.05
COMMON_START = "2024-06-17"
LEGS = ("short_put", "long_put", "short_call", "long_call")
FILLS = ("VWAP_2TICK", "VWAP_RANGE_25", "BAR_EXTREME")
FEES: dict[str, float] = {"OFFICIAL_MINIMUM": 0.0, "BROKER_PLUS_2": 2.0, "BROKER_PLUS_5": 5.0}
RISK_BUDGETS = (0.05, 0.08, 0.12)
PHASE_UNITS: dict[str, float] = {
    "CALM_POSITIVE_VRP": 1.0,
    "BALANCED_MARKET": 0.75,
    "REPAIR_IN_PROGRESS": 0.5,
    "DOWNSIDE_TAIL_RICH": 0.25,
    "UPSIDE_CONVEXITY_PRICED": 0.25,
    "FRAGMENTED_TRANSITION": 0.25,
    "LOCAL_STYLE_PRESSURE": 0.25,
    "BLUE_CHIP_PRESSURE": 0.0,
    "BROAD_PRESSURE": 0.0,
    "BROAD_PERSISTENT_PRESSURE": 0.0,
    "LOCALIZED_ACUTE_STRESS": 0.0,
    "SYSTEMIC_ACUTE_STRESS": 0.0,
    "UNKNOWN": 0.0,
}
PRIMARY_HORIZON = "TO_7DTE"
STATE_CATEGORIES = ("ALLOW", "KNOWN_BLOCK", "ABSTAIN_DATA")

# ---- audit ----------------------------------------------------------------

# (regime, first session, last session or None)
ERAS: tuple[tuple[str, str, str | None], ...] = (
    ("ERA_A_50_ONLY", "2015-02-09", "2019-12-22"),
    ("ERA_B_50_300", "2019-12-23", "2022-09-18"),
    ("ERA_C_50_300_500", "2022-09-19", "2023-06-04"),
    ("ERA_D_FOUR_CARRIERS", "2023-06-05", None),
)

QUOTE_COLUMNS = (
    "session_date",
    "carrier_id",
    "contract_id",
    "option_type",
    "strike",
    "expiry",
    "bid",
    "ask",
    "event_time",
    "available_at",
    "vintage_kind",
    "revision_id",
    "licence_scope",
)
QUOTE_VINTAGES = ("FIRST_RELEASE", "AS_TRADED")
