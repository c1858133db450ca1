"""Thresholds of the engine in one place.  The values are part of the query semantics (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # map matching
    max_match_distance_m: float = 25.0
    max_bearing_delta_deg: float = 45.0
    switch_margin_m: float = 8.0
    endpoint_snap_m: float = 0.0
    max_accuracy_m: float = 30.0
    prefilter_pad_deg: float = 0.0005
    tangent_window_m: float = 10.0
    disconnect_penalty_m: float = 6.0
    anchor_max_gap_s: float = 15.0
    min_derive_m: float = 6.0
    stitch_window_s: float = 45.0
    bbox_pad_deg: float = 0.005
    # model
    bucket_m: float = 15.0
    min_span_m: float = 25.0
    min_coverage: float = 0.7
    min_anchor_points: int = 10
    max_anchor_m: float = 60.0
    # cleaning
    max_grade_pct: float = 100.0
    min_step_m: float = 1.0
    ema_alpha: float = 0.485
    ema_pad: int = 24
    causal_alpha: float = 0.3
    max_mps: float = 20.0
    min_chord_m: float = 2.0
    # slopes and drawing
    slope_window: int = 2
    max_slope_pct: float = 25.0
    offset_m: float = 4.0
    # passes
    corridor_m: float = 25.0
    retrace_m: float = 15.0
    min_pass_m: float = 25.0
    max_pass_gap_s: float = 45.0
    # evaluation
    min_revisit_gap_s: float = 300.0
    min_elevation_m: float = 1000.0
    max_bad_share: float = 0.15
    # paths
    path_snap_m: float = 5.0
    max_turn_deg: float = 60.0
    max_no_data_m: float = 150.0
    max_path_m: float = 5000.0
    max_connect_m: float = 2000.0
    no_data_cost: float = 2.0
    heading_span_m: float = 15.0
    near_drawn_deg: float = 0.0025
    branch_stub_m: float = 30.0
    # network
    min_segment_m: float = 8.0
    max_segment_m: float = 150.0
    frontage_offset_m: float = 20.0
    frontage_tangent_deg: float = 20.0
    frontage_step_m: float = 5.0
    min_frontage: float = 0.6
    min_best_street: float = 0.4
    link_prefilter_deg: float = 0.0004
    # client
    steepest_window_m: float = 100.0
    steepest_max_estimated: float = 0.25
    named_min_m: float = 20.0
    flip_chunk_m: float = 1800.0
    min_saveable_extent_m: float = 75.0


DEFAULT = EngineConfig()

EARTH_RADIUS_M = 6_371_008.8
M_PER_DEG_LAT = 111_320.0
FRONTAGE_M_PER_DEG_LAT = 111_132.0
EARTH_CIRCUMFERENCE_M = 40_075_016.686

#: Upper slope of each band in percent (the last has none) and its colour.  Fixed values.
SLOPE_BANDS = (
    (-8.0, "#7c3aed"),
    (-3.0, "#2563eb"),
    (0.0, "#22c55e"),
    (3.0, "#eab308"),
    (6.0, "#f97316"),
    (9.0, "#dc2626"),
    (12.0, "#881337"),
    (None, "#450a0a"),
)
NO_DATA_COLOR = "#6b7280"
SEA_LEVEL_HPA = 1013.25
USABLE_HPA = (300.0, 1100.0)
