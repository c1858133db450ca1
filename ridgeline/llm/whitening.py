"""Embedding whitening: principal components of integer vectors, scaled to unit variance.

An entry c becomes the integer floor(256 * c).  The fit list is each distinct vector once; its size n and the sums S of
each dimension are exact, so n * x - S is an exactly centred row in whole numbers.  Their Gramian comes from MLlib's
RowMatrix, which adds up upper triangles in the tasks; divided by n (and by n twice more, for the rows are n times too
long) it is the covariance, which the driver decomposes: a matrix of dimension by dimension, whatever the rows.  The
projection travels to the tasks, which whiten every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.frames import map_arrow, saved, ship

STEPS = 256
#: An eigenvalue of less than this share of the trace is rounding, not variance.
LEAST_SHARE = 1e-12
_LONG = 2**63 - 1
_EXACT = 2**53


@dataclass(frozen=True)
class Whitening:
    """What rows are whitened by.  `values` and `vectors` (a column each) are by falling eigenvalue; unit vectors, largest entry positive."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def scaled(self) -> np.ndarray:
        """Columns that project n * x - S to unit variance; NaN for a component without variance."""
        alive = self.values > LEAST_SHARE * self.trace
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(alive, self.vectors / (self.n * np.sqrt(np.where(alive, self.values, 1.0))), np.nan)

    def explained(self) -> np.ndarray:
        return np.maximum(self.values, 0) / self.trace if self.trace > 0 else np.zeros(len(self.values))


def integers(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id long, x array<long>): rows whose vector is there and holds finite entries only.

    Entries beyond the range of a long stop at its ends.  Vectors shorter than the longest one get zeros at their end."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))  # NaN isn't less; null for a null vector
    rows = rows.where(F.coalesce(finite, F.lit(False)))
    x = rows.select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(STEPS)))).alias("x"))
    least, most = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    return x if least == most else x.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("x"))))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, of equally long lists, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _safe(x: np.ndarray, most: int) -> np.ndarray:
    """x as int64 where results up to `most` fit, as whole numbers of any size otherwise."""
    return x if most <= _LONG else x.astype(object)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def column_sums(vectors: DataFrame, col: str = "x") -> tuple[int, list[int]]:
    """Rows and exact sums of each dimension; a task hands on a row a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                own = _safe(x, _largest(x) * len(x)).sum(axis=0).astype(object)
                n, sums = n + len(x), own if sums is None else sums + own
        if sums is not None:
            out = [(d, Decimal(int(s)), n) for d, s in enumerate(sums)] or [(-1, Decimal(0), n)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.decimal128(38, 0)), pa.array([o[2] for o in out], pa.int64())], names=["d", "s", "n"])

    parts = map_arrow(vectors.select(col), run, "d int, s decimal(38,0), n long").groupBy("d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("d").collect()
    return (int(parts[0].n) if parts else 0), [int(r.s) for r in parts if r.d >= 0]


def centred(n: int, sums: list[int], col: str = "x") -> Column:
    """The row n * x - S as doubles, from whole numbers."""
    s = F.array(*[F.lit(Decimal(v)).cast("decimal(38,0)") for v in sums])
    wide = F.transform(col, lambda e, i: (e.cast("decimal(20,0)") * F.lit(Decimal(n)).cast("decimal(17,0)") - F.element_at(s, i + 1)).cast("double"))
    if max(map(abs, sums), default=0) >= _EXACT // 2:
        return wide
    t = F.array(*[F.lit(v).cast("long") for v in sums])
    plain = F.transform(col, lambda e, i: (e * F.lit(n).cast("long") - F.element_at(t, i + 1)).cast("double"))
    return F.when(F.forall(col, lambda e: (e > F.lit(-(_EXACT // (2 * n)))) & (e < F.lit(_EXACT // (2 * n)))), plain).otherwise(wide)


def fit_whitening(vectors: DataFrame, components: int, col: str = "x") -> Whitening | None:
    """The whitening of a list of vectors of one length (as they are: give distinct ones); None for an empty list or vectors of no entries."""
    n, sums = column_sums(vectors, col)
    if not n or not sums:
        return None
    rows = MLUtils.convertVectorColumnsFromML(vectors.select(array_to_vector(centred(n, sums, col)).alias("row")), "row")
    gramian = RowMatrix(rows, n, len(sums)).computeGramianMatrix().toArray() / n / n / n
    values, columns = np.linalg.eigh(gramian)
    values, columns = values[::-1], columns[:, ::-1]
    columns = columns * np.where(columns[np.abs(columns).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
    return Whitening(n, tuple(sums), values[:components], columns[:, :components], float(np.trace(gramian)))


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    sums = np.array(model.sums, dtype=object)
    most = _largest(x) * model.n + max(map(abs, model.sums))
    y = _safe(x, most) * model.n - (sums if most > _LONG else sums.astype(np.int64))
    return _safe(y, _largest(y) ** 2 * y.shape[1])


def _projected(y: np.ndarray, scaled: np.ndarray) -> np.ndarray:
    return y.astype(np.float64) @ np.nan_to_num(scaled) + np.where(np.isnan(scaled[0]), np.nan, 0.0)


def identity_error(vectors: DataFrame, model: Whitening, col: str = "x") -> float:
    """The largest entry of the covariance of the whitened list minus the identity, over components with variance; 0 without any."""
    context = vectors.sparkSession.sparkContext
    shared = context.broadcast(model)
    alive = int((~np.isnan(model.scaled()[0])).sum())
    if not alive:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled = shared.value.scaled()[:, :alive]
        total = np.zeros((alive, alive))
        for batch in batches:
            if batch.num_rows:
                z = _projected(_centred(_matrix(batch.column(0)), shared.value), scaled)
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(alive * alive), pa.int32()), pa.array(total.ravel())], names=["cell", "s"])

    cells = map_arrow(vectors.select(col), run, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).orderBy("cell").collect()
    return float(np.abs(np.array([r.s for r in cells]).reshape(alive, alive) / model.n - np.eye(alive)).max())


def whiten(embeddings: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Whitening | None, float]:
    """(vec_id, deviation, distance, whitened array<double>) of every row with a finite vector, the fit, and its identity error.

    deviation is the sum of (n * x - S) ** 2 over dimensions, null beyond the range of a long; distance its square root
    over n, as a double.  A component without variance has a whitened value of null.  Repeated vectors count once in the
    fit and have a row each; null and repeated ids stay.  An empty table gives no rows and no fit, and so do vectors of no
    entries.  Other columns are left out."""
    spark = embeddings.sparkSession
    schema = "vec_id long, deviation long, distance double, whitened array<double>"
    rows = integers(embeddings, id_col, vector_col)
    distinct = saved(rows.select("x").distinct())
    model = fit_whitening(distinct, components)
    if model is None:
        return spark.createDataFrame([], schema), None, 0.0
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        scaled = model.scaled()
        for frame in frames:
            if not len(frame):
                continue
            y = _centred(np.vstack(frame["x"].to_numpy()), model)
            squares = (y * y).sum(axis=1)
            whitened = _projected(y, scaled)
            yield pd.DataFrame({
                "vec_id": frame["vec_id"].astype("Int64"),
                "deviation": pd.array([int(s) if s <= _LONG else None for s in squares], dtype="Int64"),
                "distance": np.sqrt(squares.astype(np.float64)) / model.n,
                "whitened": [[None if np.isnan(v) else float(v) for v in w] for w in whitened],
            })

    return rows.mapInPandas(run, schema), model, identity_error(distinct, model)


def op12_embedding_whitening(embeddings: DataFrame) -> DataFrame:
    """Per remaining row and component up to 4: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows, model, error = whiten(embeddings)
    if model is None:
        return rows.select("vec_id", F.lit(1).alias("component"), F.lit(0).cast("long").alias("n"), "deviation", F.col("distance").alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    explained = F.array(*[F.lit(float(v)) for v in model.explained()])
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
