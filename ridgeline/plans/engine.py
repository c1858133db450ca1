"""The engine's front: each step returns DataFrames, so that plans stay visible and compose."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.config import DEFAULT, EngineConfig
from ridgeline.functions.geo import boxes_overlap
from ridgeline.operators import match as X
from ridgeline.operators import model as M
from ridgeline.operators import paths as P
from ridgeline.operators import relational as R
from ridgeline.operators import windows as W


@dataclass
class Engine:
    """segments: id, osm_way_id, kind, street_name, start_node_id, end_node_id, piece_index, canonical_segment_id, line, lon0, lat0, lon1, lat1, length_m, bearing_deg."""

    spark: SparkSession
    segments: DataFrame
    config: EngineConfig = DEFAULT

    def ingest(self, stored: DataFrame, new: DataFrame) -> DataFrame:
        return R.insert_new(stored, new, ["session_id", "recorded_at"])

    def usable(self, sessions: DataFrame, samples: DataFrame) -> DataFrame:
        good = R.session_verdicts(sessions, samples, self.config).where("usable").select("session_id")
        return samples.join(good, "session_id", "left_semi")

    def process(self, samples: DataFrame, dem: DataFrame | None = None) -> dict[str, DataFrame]:
        return X.process_sessions(samples, self.segments.where("canonical_segment_id IS NULL"), dem, self.config)

    def rebuild(self, sessions: DataFrame, samples: DataFrame, dem: DataFrame | None = None) -> dict[str, DataFrame]:
        """The whole model from the usable rides; the order of rides doesn't matter."""
        return self.process(self.usable(sessions, samples), dem)

    def viewport(self, box: tuple[float, float, float, float], model: DataFrame, coverage: DataFrame, passes: DataFrame | None = None) -> DataFrame:
        near = self.segments.where(F.col("canonical_segment_id").isNull() & boxes_overlap(F.least("lon0", "lon1"), F.least("lat0", "lat1"), F.greatest("lon0", "lon1"), F.greatest("lat0", "lat1"), box))
        lines = R.with_data(near, model).select(F.col("id").alias("segment_id"), "length_m")
        keep = lambda t: t.join(lines.select("segment_id"), "segment_id", "left_semi")
        return M.viewport(lines, keep(model), keep(coverage), keep(passes) if passes is not None else None)

    def extents(self, model: DataFrame, coverage: DataFrame) -> DataFrame:
        return M.extents(model, coverage, self.segments.select(F.col("id").alias("segment_id"), "length_m"))

    def paths(self, requests: DataFrame, model: DataFrame, coverage: DataFrame, runs: DataFrame) -> DataFrame:
        """Paths grown from requests (area, path_id, segment_id, direction, at_m).

        Requests of an area see the segments with a data-bearing way near them; `segments` needs an `area` column."""
        lines = self.segments.where("canonical_segment_id IS NULL")
        ends = X.end_neighbours(lines, self.config.path_snap_m)
        areas = lines.select(F.col("id").alias("segment_id"), "area")
        moves = W.transitions(runs).join(areas, "segment_id")
        return P.grow_all(requests, lines.select("area", "id", "line", "length_m", "street_name"), ends.join(areas, "segment_id"), self.extents(model, coverage).select("segment_id", "direction", "from_m", "to_m").join(areas, "segment_id"), moves, self.config)
