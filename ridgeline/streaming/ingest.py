"""Streams of fixes: idempotent ingest, live pass buckets, per-ride state, and the incremental model.

Batch recomputation stays the source of truth; the streaming forms give the same rows once their input is complete.
Watermarks bound the state: a fix later than the watermark is stored by the batch ingest, but not merged live.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ridgeline.functions import scalar as S
from ridgeline.operators.model import merge_model


def read_chunks(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Uploaded chunks: each new file of a folder once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_chunks(samples: DataFrame, path: str, rows: int = 125) -> None:
    """Files of at most `rows` fixes, as a client uploads them."""
    samples.write.mode("append").option("maxRecordsPerFile", rows).parquet(path)


def deduplicated(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A fix that is sent again (same session and time) is dropped, within the watermark."""
    return stream.withWatermark("recorded_at", delay).dropDuplicatesWithinWatermark(["session_id", "recorded_at"])


def ride_windows(stream: DataFrame, gap: str = "45 seconds", delay: str = "1 hour") -> DataFrame:
    """Fixes, first and last time of each coarse run of a session (fixes closer than the gap)."""
    return stream.withWatermark("recorded_at", delay).groupBy("session_id", F.session_window("recorded_at", gap).alias("w")).agg(F.count("*").alias("fixes"), F.avg("elevation_m").alias("mean_m")).select("session_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "fixes", "mean_m")


def live_buckets(fixes: DataFrame, delay: str = "1 hour", every: str = "1 hour") -> DataFrame:
    """Mean height by line, bucket and hour of matched fixes (segment_id, direction, along_m, elevation_m, recorded_at)."""
    return fixes.withWatermark("recorded_at", delay).groupBy(F.window("recorded_at", every).alias("w"), "segment_id", "direction", S.bucket(F.col("along_m")).alias("distance_m")).agg(F.avg("elevation_m").alias("elevation_m"), F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "segment_id", "direction", "distance_m", "elevation_m", "n")


def merge_into(spark: SparkSession, model_path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: folds a batch of pass buckets into the stored model.

    Each batch writes version <id> from the newest version before it, so a batch that runs again after a failure writes
    the same version again: no pass counts twice."""
    jvm = spark.sparkContext._jvm

    def versions(before: int) -> int | None:
        folder = jvm.org.apache.hadoop.fs.Path(model_path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return None
        found = [int(s.getPath().getName()[8:]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((v for v in found if v < before), default=None)

    def merge(batch: DataFrame, batch_id: int) -> None:
        last = versions(batch_id)
        old = spark.read.parquet(f"{model_path}/version={last}") if last is not None else spark.createDataFrame([], "segment_id long, direction string, distance_m int, elevation_m double, sample_count long")
        merge_model(old, batch).write.mode("overwrite").parquet(f"{model_path}/version={batch_id}")

    return merge


def run_available(query_writer) -> StreamingQuery:
    """Starts a stream over what is there now and waits for its end."""
    query = query_writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


MODE_OUT = "session_id long, at_s double, mode string"
MODE_STATE = "mode string, switched_s double, heading double"


def turn_modes(stream: DataFrame, turn_deg: float = 20.0, cooldown_s: float = 5.0, delay: str = "1 hour") -> DataFrame:
    """When each ride's sampling switches between cruise and turn: a turn of `turn_deg` between fixes enters turn mode,
    `cooldown_s` without one leaves it, and switches are `cooldown_s` apart at least.

    State is three values a session, dropped once the watermark is an hour past its last fix.  Fixes: session_id,
    recorded_at, heading_deg."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mode, switched, heading = state.get if state.exists else ("cruise", float("-inf"), float("nan"))
        out, last = [], 0.0
        for frame in frames:
            for r in frame.sort_values("at_s").itertuples(index=False):
                last = max(last, r.at_s)
                if pd.isna(r.heading_deg):
                    continue
                turned = abs((r.heading_deg - heading + 540) % 360 - 180) if not pd.isna(heading) else 0.0
                heading = r.heading_deg
                wanted = "turn" if turned >= turn_deg else "cruise"
                if wanted != mode and r.at_s - switched >= cooldown_s:
                    mode, switched = wanted, r.at_s
                    out.append((key[0], r.at_s, mode))
        state.update((mode, switched, heading))
        state.setTimeoutTimestamp(max(int(last * 1000) + 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session_id", "at_s", "mode"])

    rows = stream.withWatermark("recorded_at", delay).select("session_id", "recorded_at", (S.micros(F.col("recorded_at")) / 1e6).alias("at_s"), "heading_deg")
    return rows.groupBy("session_id").applyInPandasWithState(run, MODE_OUT, MODE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def health_verdict(path, registered, hz, used_share, repaired):
    """State of a barometer as a column; the first rule that holds decides."""
    silent = F.coalesce(hz <= 0, F.lit(False))
    return (
        F.when(path.isNull() | (path == "none"), "absent").when(path == "sensors", "fallback").when(~registered, "offline")
        .when(used_share.isNull(), F.when(silent, "silent").otherwise("good"))
        .when((used_share == 0) | silent, "silent").when(F.coalesce(repaired > 0, F.lit(False)), "degraded").when(used_share < 0.8, "patchy").when(F.coalesce(hz < 2.5, F.lit(False)), "slow").otherwise("good")
    )


def session_outcome(ended, samples, matches):
    """What ending a session does: nothing again (done), delete an empty one, or process it; and whether it may be deleted."""
    return F.when(ended, "done").when(samples == 0, "deleted").otherwise("processed"), matches == 0


