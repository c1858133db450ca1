"""Terrain heights: a stored table, and a pluggable provider for positions that it lacks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators import network as N
from ridgeline.operators.model import LINE

KEY = [*LINE, "distance_m"]
BATCH = 100


def missing(positions: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct positions (segment_id, direction, distance_m) that the table lacks."""
    return positions.select(*KEY).distinct().join(stored.select(*KEY), KEY, "left_anti")


def points(positions: DataFrame, segments: DataFrame) -> DataFrame:
    """Longitude and latitude of positions, by the share of their segment's length (id, line, length_m)."""
    m = F.when(F.col("direction") == "forward", F.col("distance_m")).otherwise(F.col("length_m") - F.col("distance_m"))
    rows = positions.join(segments.select(F.col("id").alias("segment_id"), "line", "length_m"), "segment_id").select(*KEY, "line", F.greatest(F.lit(0.0), F.least(F.lit(1.0), m / F.col("length_m"))).alias("share"))

    def run(batches):
        for pdf in batches:
            lines = [np.array([list(p) for p in x], dtype=float) for x in pdf.line]
            at = [N.line_metres(x) for x in lines]
            got = [N.point_at(x, a, s * a[-1]) for x, a, s in zip(lines, at, pdf.share, strict=True)]
            yield pdf[KEY].assign(lon=[p[0] for p in got], lat=[p[1] for p in got])

    return rows.mapInPandas(run, "segment_id long, direction string, distance_m int, lon double, lat double")


def ensure(positions: DataFrame, stored: DataFrame, segments: DataFrame, provider: Callable[[list[tuple[float, float]]], list[float | None]] | None = None) -> DataFrame:
    """The table with what the provider knows of the missing positions (lon, lat in batches of BATCH; null: unknown).

    A provider that fails leaves its batch out: those positions stay unknown.  Without a provider, the table as it is."""
    if provider is None:
        return stored
    wanted = points(missing(positions, stored), segments)

    def run(batches):
        for pdf in batches:
            out = []
            for a in range(0, len(pdf), BATCH):
                part = pdf.iloc[a : a + BATCH]
                try:
                    heights = provider(list(zip(part.lon, part.lat, strict=True)))
                except OSError:
                    continue
                out.append(part[KEY].assign(dem_m=pd.Series(heights, index=part.index, dtype=float)))
            found = pd.concat(out) if out else pdf[KEY].iloc[:0].assign(dem_m=pd.Series(dtype=float))
            yield found[np.isfinite(found.dem_m)]

    return stored.select(*KEY, "dem_m").unionByName(wanted.mapInPandas(run, "segment_id long, direction string, distance_m int, dem_m double"))
