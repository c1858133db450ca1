"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of WIDTH bytes run over overlapping chunks of CHUNK bytes that cover the whole
document; each filter's response is rectified and max-pooled over its chunk.  The mean and the maximum over the chunks
go through one logistic unit.  The network is trained on the driver, by Adam, from TRAIN_ROWS documents of each label at
most: from all chunks of each, or of a very long one from TRAIN_CHUNKS chunks at even distances over the whole text.
Scoring always covers every byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.frames import map_arrow, to_binary
from ridgeline.llm.labelled import held_out, sample
from ridgeline.llm.wordhash import chunks, utf8_parts

CHUNK, OVERLAP = 512, 64
EMBED, WIDTH, STRIDE, FILTERS = 6, 8, 2, 16
#: The sample that the network learns from: documents of each label, and chunks of each of these, at most.
TRAIN_ROWS, TRAIN_CHUNKS, EPOCHS = 600, 147, 12


def chunk_starts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and first byte of each chunk; every document has one at least."""
    n = np.diff(offsets)
    k = np.maximum(1, -(-(n - OVERLAP) // (CHUNK - OVERLAP)))
    doc = np.repeat(np.arange(len(n)), k)
    return doc, offsets[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)) * (CHUNK - OVERLAP)


def chunk_bytes(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The chunks as rows; bytes beyond the document are 0."""
    at = start[:, None] + np.arange(CHUNK)
    inside = at < offsets[1:][doc][:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8)


class ByteNet:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBED)),
            "w": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)),
            "b": np.zeros(FILTERS),
            "out": r.normal(0, 0.1, 2 * FILTERS),
            "bias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def pool(self, rows: np.ndarray, with_places: bool = False):
        """Max-pooled responses of each chunk, and where they were."""
        x = self.p["embed"][rows].reshape(len(rows), CHUNK * EMBED)
        places = (CHUNK - WIDTH) // STRIDE + 1
        s = x.strides
        win = np.lib.stride_tricks.as_strided(x, (len(rows), places, WIDTH * EMBED), (s[0], STRIDE * EMBED * s[1], s[1]))
        y = win.reshape(-1, WIDTH * EMBED) @ self.p["w"]
        y = y.reshape(len(rows), places, FILTERS)
        if not with_places:
            return np.maximum(y.max(axis=1) + self.p["b"], 0)
        at = y.argmax(axis=1)
        return np.maximum(np.take_along_axis(y, at[:, None], axis=1)[:, 0] + self.p["b"], 0), at

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each document."""
        doc, start = chunk_starts(offsets)
        pooled = np.concatenate([self.pool(chunk_bytes(data, offsets, doc[i : i + 128], start[i : i + 128])) for i in range(0, len(doc), 128)])
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        n = np.diff(np.concatenate((first, [len(doc)])))[:, None]
        v = np.concatenate((np.add.reduceat(pooled, first, axis=0) / n, np.maximum.reduceat(pooled, first, axis=0)), axis=1)
        return 1 / (1 + np.exp(-np.clip((v @ self.p["out"] + self.p["bias"]).astype(np.float64), -30, 30)))

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> ByteNet:
        """Adam on the logistic loss, labels weighed alike; docs: chunks (rows) of each document."""
        r = np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / max((labels == 1).mean(), 1e-9), 0.5 / max((labels == 0).mean(), 1e-9))
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(docs))
            for i in range(0, len(order), 32):
                batch = order[i : i + 32]
                rows = np.concatenate([docs[j] for j in batch])
                n = np.array([len(docs[j]) for j in batch])
                of = np.repeat(np.arange(len(batch)), n)
                first = np.cumsum(n) - n
                parts = [self.pool(rows[k : k + 256], True) for k in range(0, len(rows), 256)]
                pooled, at = (np.concatenate([x[c] for x in parts]) for c in (0, 1))
                mean, most = np.add.reduceat(pooled, first, axis=0) / n[:, None], np.maximum.reduceat(pooled, first, axis=0)
                u = np.concatenate((mean, most), axis=1)
                prob = 1 / (1 + np.exp(-np.clip(u @ self.p["out"] + self.p["bias"], -30, 30)))
                d = ((prob - labels[batch]) * weight[batch] / len(batch)).astype(np.float32)
                du = d[:, None] * self.p["out"]
                is_most = pooled == most[of]
                dp = (du[of, :FILTERS] / n[of][:, None] + du[of, FILTERS:] * is_most) * (pooled > 0)
                byte_at = at[:, :, None] * STRIDE + np.arange(WIDTH)
                seen = rows[np.arange(len(rows))[:, None, None], byte_at]
                win = self.p["embed"][seen].reshape(len(rows), FILTERS, WIDTH * EMBED)
                back = np.zeros_like(self.p["embed"])
                np.add.at(back, seen.reshape(-1), (dp[:, :, None] * self.p["w"].T[None]).reshape(-1, EMBED))
                grad = {"out": u.T @ d, "bias": np.array([d.sum()]), "b": dp.sum(axis=0), "w": np.einsum("cf,cfk->kf", dp, win), "embed": back}
                t += 1
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> ByteNet | None:
    """A network learnt from rows that aren't held out; none where a label is missing altogether.

    Of rows that repeat an id, the least text is learnt from.  Texts are cut into chunks in the tasks."""
    ids = {i: y for y in (0, 1) for i in sample(labels, label_col, y, rows, id_col)}
    if len(set(ids.values())) < 2:
        return None
    spark = docs.sparkSession
    wanted = spark.createDataFrame(sorted(ids.items()), "doc_id long, y int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_parts(batch.column(2))
            doc, start = chunk_starts(offsets)
            n = np.bincount(doc, minlength=batch.num_rows)
            of = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            kept = np.minimum(n, TRAIN_CHUNKS)[doc]  # chunk i of n is taken where i * kept / n passes a whole number
            picked = np.flatnonzero((of * kept) // n[doc] != ((of - 1) * kept) // n[doc])
            rows = chunk_bytes(data, offsets, doc[picked], start[picked])
            ends = np.concatenate(([0], np.cumsum(np.bincount(doc[picked], minlength=batch.num_rows)))) * CHUNK
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), to_binary(rows.reshape(-1), ends)], names=["doc_id", "y", "chunks"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    few = own.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = sorted((r.doc_id, r.y, bytes(r.chunks)) for r in map_arrow(few, run, "doc_id long, y int, chunks binary").collect())
    if len({y for _, y, _ in got}) < 2:
        return None
    rows = [np.frombuffer(c, dtype=np.uint8).reshape(-1, CHUNK) for _, _, c in got]
    return ByteNet().fit(rows, np.array([y for _, y, _ in got], dtype=np.float32))


def quality_scores(docs: DataFrame, model: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (0.5 without a model); a null text scores as an empty one.  Null and repeated ids keep their rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if net is not None:
                data, offsets = utf8_parts(batch.column(2))
                for a, b in chunks(offsets, 1 << 19):
                    score[a:b] = net.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["doc_id", "held_out", "score"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, held_out boolean, score double")


def op6_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score (higher: quality 1 likelier), predicted (1 from 0.3)."""
    return quality_scores(docs, fit(docs, labels)).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
