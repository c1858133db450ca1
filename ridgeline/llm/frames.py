"""What the operators of this subpackage share: session settings, checkpoints and streams of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a slice of rows that a worker handles at once, about; a longer row stands alone.
SLICE_BYTES = 4 << 20
#: Rows (of a few numbers each) of a side that is broadcast in joined(); rows of a key beyond which it is dealt over salts.
BROADCAST_ROWS = 300_000
HOT_ROWS = 50_000
PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Give this package to the executors once per application, for clusters on which it isn't installed."""
    context = spark.sparkContext
    if getattr(context, "_ridgeline_shipped", False):
        return
    folder = tempfile.mkdtemp()
    with zipfile.ZipFile(target := os.path.join(folder, f"{PACKAGE.name}.zip"), "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    context.addPyFile(target)
    context._ridgeline_shipped = True


def _checkpoints(spark: SparkSession) -> str:
    """The shared checkpoint folder: the one that the session names in spark.checkpoint.dir; one of our own is set only where that is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "ridgeline-checkpoints"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the shared checkpoint folder, so that a lost executor costs no lineage."""
    _checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df` computed once and written as Parquet to the shared checkpoint folder.

    A checkpoint keeps the size that was estimated for its plan, the product of both sides for a join; in a loop that joins
    what the round before gave with itself, the estimate gets twice as many digits each round, until the planner is busy
    with them alone.  Files have their own size."""
    path = f"{_checkpoints(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(many: DataFrame, one: DataFrame, on: str, how: str = "inner", *, small: bool = True) -> DataFrame:
    """many.join(one, on, how) where `one` has a key once at most and `many` may have a key in any share of its rows.

    `one` is broadcast if it has BROADCAST_ROWS at most (small=False: never, for wide rows).  Otherwise the rows of a key
    that `many` has more than HOT_ROWS times are dealt over salts by a hash of the row, and the row of `one` is repeated
    for each salt.  Both frames are read more than once: give saved ones, or plain columns of a table."""
    if small and one.count() <= BROADCAST_ROWS:
        return many.join(F.broadcast(one), on, how)
    hot = many.groupBy(on).agg(F.count("*").alias("_salts")).where(F.col("_salts") > HOT_ROWS).select(on, F.ceil(F.col("_salts") / HOT_ROWS).cast("long").alias("_salts"))
    hot = saved(hot.where(F.col(on).isNotNull()))
    if not hot.limit(1).count():
        return many.join(one, on, how)
    hot = F.broadcast(hot)  # a row for HOT_ROWS rows of `many` at most
    salts = F.coalesce("_salts", F.lit(1))
    dealt = many.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*many.columns), salts)).drop("_salts")
    copied = one.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_salts")
    return dealt.join(copied, [on, "_salt"], how).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups of rows sorted by the integer columns `keys`, with the groups' n + 1 bounds."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield _bounds(held, keys)
            held = []
        cut = _last_start(batch, keys)
        if cut:
            held.append(batch.slice(0, cut))
            yield _bounds(held, keys)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _bounds(held, keys)


def _last_start(batch: pa.RecordBatch, keys: list[str]) -> int:
    n, cut = batch.num_rows, 0
    for k in keys:
        x = batch.column(k).to_numpy(zero_copy_only=False)
        if len(change := np.flatnonzero(x[1:] != x[:-1])):
            cut = max(cut, int(change[-1]) + 1)
    return cut if cut < n else 0


def _bounds(held: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches(held).combine_chunks()
    new = np.zeros(t.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        x = t.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return t, np.concatenate((np.flatnonzero(new), [t.num_rows]))


def binary(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls, and its offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    kind = np.int32 if pa.types.is_binary(column.type) else np.int64
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), o


def to_binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary column whose value i is the bytes of data[bounds[i]:bounds[i+1]]."""
    raw = np.ascontiguousarray(data)
    offsets = (bounds * raw.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def release_memory() -> None:
    """Gives memory that Arrow's pool and the allocator hold unused back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow() with the package at the executors' hands, in slices of about SLICE_BYTES; the workers' memory is released after each."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def released() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = max(1, min(batch.num_rows, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
                for a in range(0, batch.num_rows, rows):
                    yield batch.slice(a, rows)
                    release_memory()

        yield from f(released())
        release_memory()

    return df.mapInArrow(run, schema)
