"""Toxicity by non-negative positive-unlabelled learning.

A text becomes the set of its words (lower case) and of the words' first few bytes, so that forms of one stem count alike.  The classifier is logistic over VOCABULARY of them that tell confirmed
toxic texts from the unlabelled ones best, trained in numpy from POSITIVES confirmed toxic texts and UNLABELLED texts
of any kind at most, of those with TRAIN_BYTES bytes at most (labels 0 aren't used, but for the class prior).  The risk is p R+(positives) + max(0,
R-(unlabelled) - p R-(positives)), with the class prior p; where the second part falls below 0, the step goes up it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.decontam import _BREAK
from ridgeline.llm.frames import binary, map_arrow, to_binary
from ridgeline.llm.labelled import held_out, lowest, sample, share
from ridgeline.llm.wordhash import chunks, folded_sums, mix, utf8_parts, word_hashes

#: The sample that the classifier learns from: rows of each kind, and different features of each, at most.
POSITIVES, UNLABELLED, TRAIN_FEATURES = 1_500, 4_000, 1 << 14
VOCABULARY = 512
STEMS = (4, 5, 6, 7)
#: The last bits of a feature: 0 for a word, else 8 less the bytes of the stem.
_KIND = np.uint64(7)
PRIOR = 0.1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words and of the words' first STEMS bytes, and the text of each."""
    words, starts, ends, begin = word_hashes(data, offsets, _BREAK)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(begin))
    if not len(words):
        return words, of
    sums, inverse = folded_sums(data)
    parts, owners = [words & ~_KIND], [of]
    for k in STEMS:
        long = np.flatnonzero(ends - starts > k)
        at = starts[long]
        parts.append(mix((sums[at + k] - sums[at]) * inverse[at] + np.uint64(k)) & ~_KIND | np.uint64(8 - k))
        owners.append(of[long])
    return np.concatenate(parts), np.concatenate(owners)


def feature_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For chunks of rows a..b: a, b, the rows' sorted distinct features on end, and bounds."""
    data, offsets = utf8_parts(column)
    for a, b in chunks(offsets):
        x, of = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        order = np.lexsort((x, of))
        x, of = x[order], of[order]
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x[1:] != x[:-1]) | (of[1:] != of[:-1])
        yield a, b, x[new], np.concatenate(([0], np.cumsum(np.bincount(of[new], minlength=b - a))))


class WordModel:
    """Sorted hashes of the words and stems that count, their weights and a bias."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias = words, weights, bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        z = np.full(n, self.bias)
        if len(self.words) and len(data):
            sieve = np.zeros(1 << 16, dtype=bool)
            sieve[(self.words & np.uint64(0xFFFF)).astype(np.int64)] = True
            x, of = features(data, offsets)
            maybe = np.flatnonzero(sieve[(x & np.uint64(0xFFFF)).astype(np.int64)])
            x, of = x[maybe], of[maybe]
            i = np.minimum(np.searchsorted(self.words, x), len(self.words) - 1)
            hit = self.words[i] == x
            pair = np.unique(of[hit] * len(self.words) + i[hit])
            z += np.bincount(pair // len(self.words), weights=self.weights[pair % len(self.words)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def choose_words(positive: list[np.ndarray], other: list[np.ndarray], size: int, prior: float) -> np.ndarray:
    """Features of three texts or more that tell toxic texts from the others, for or against; the largest G statistics first."""
    p, pn = np.unique(np.concatenate(positive), return_counts=True)
    u, un = np.unique(np.concatenate(other), return_counts=True) if other else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    both = np.union1d(p, u)
    a, b = np.zeros(len(both)), np.zeros(len(both))
    a[np.searchsorted(both, p)] = pn
    b[np.searchsorted(both, u)] = un
    n, m = len(positive), max(len(other), 1)
    rate = (a + b) / (n + m)

    def part(k: np.ndarray, rows: int, r: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(rows * r, 1e-9)), 0)

    g = 2 * (part(a, n, rate) + part(n - a, n, 1 - rate) + part(b, m, rate) + part(m - b, m, 1 - rate))
    usable = (a + b >= 3) & (g > 2 * np.log(max(len(both), 2)))
    pick = np.flatnonzero(usable)[np.argsort(-g[usable], kind="stable")]
    # of features that the same positives have, the one that is rarest elsewhere, or else the longest
    same = np.zeros(len(pick), dtype=np.uint64)
    order = np.argsort(both[pick])
    names = both[pick][order]
    for i, s in enumerate(positive):
        if len(names):
            at = np.minimum(np.searchsorted(names, s), len(names) - 1)
            same[order[at[names[at] == s]]] += mix(np.array([i + 1], dtype=np.uint64))[0]
    best: dict[int, tuple] = {}
    for rank, (k, i) in enumerate(zip(same.tolist(), pick.tolist(), strict=True)):
        mine = (b[i], int(both[i] & _KIND), rank, i)
        best[k] = min(best.get(k, mine), mine)
    return np.sort(both[[v[3] for v in sorted(best.values(), key=lambda v: v[2])[:size]]])


def without_copies(sets: list[np.ndarray], sketch: int = 16) -> list[np.ndarray]:
    """The sets but those of whose `sketch` smallest features an earlier set has half, so that copies don't count as evidence."""
    kept, holders = [], {}
    for s in sets:
        own = s[:sketch].tolist()
        seen: dict[int, int] = {}
        for x in own:
            for k in holders.get(x, ()):
                seen[k] = seen.get(k, 0) + 1
        if own and max(seen.values(), default=0) * 2 >= len(own):
            continue
        for x in own:
            holders.setdefault(x, []).append(len(kept))
        kept.append(s)
    return kept


def nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, rounds: int = 600, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic classifier of least non-negative risk, by Adam over all rows."""
    d = xp.shape[1]
    w = np.zeros(d + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    xp, xu = np.hstack((xp, np.ones((len(xp), 1)))), np.hstack((xu, np.ones((len(xu), 1))))
    for t in range(1, rounds + 1):
        zp, zu = xp @ w, xu @ w
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad_rest = xu.T @ su / len(xu) - prior * (xp.T @ sp) / len(xp)
        grad = prior * (xp.T @ (sp - 1)) / len(xp) + grad_rest if rest >= 0 else -grad_rest
        grad[:-1] += penalty * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", prior: float | None = None) -> WordModel | None:
    """A model learnt from confirmed toxic rows and unlabelled ones, none of them held out; none without a toxic row.

    Of rows that repeat an id, the least text is learnt from.
    The prior is that of the labels which aren't held out (kept within 0.01 and 0.5), PRIOR where they hold only toxic rows."""
    toxic = sample(labels, label_col, 1, POSITIVES, id_col)
    if not toxic:
        return None
    spark = docs.sparkSession
    if prior is None:
        prior = share(labels, label_col, id_col)
        prior = PRIOR if prior is None or prior == 1 else min(max(prior, 0.01), 0.5)
    ids = lowest(docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).cast("long").alias("doc_id")), UNLABELLED, 1)
    wanted = spark.createDataFrame([(i, 1) for i in toxic] + [(i, 0) for i in sorted(set(ids))], "doc_id long, y int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words, bounds in feature_sets(batch.column(1)):
                few = np.minimum(np.diff(bounds), TRAIN_FEATURES)
                words = words[np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds)) < TRAIN_FEATURES]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), to_binary(words, np.concatenate(([0], np.cumsum(few))))], names=["y", "words"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    few = own.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text")
    rows = sorted(((r.y, bytes(r.words)) for r in map_arrow(few, run, "y int, words binary").collect()))
    sets = {y: without_copies([np.frombuffer(w, dtype=np.uint64) for k, w in rows if k == y]) for y in (0, 1)}
    if not sets[1] or not sets[0]:
        return None
    words = choose_words(sets[1], sets[0], VOCABULARY, prior)

    def matrix(rows: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(rows), len(words)))
        for i, r in enumerate(rows):
            x[i, np.searchsorted(words, np.intersect1d(r, words, assume_unique=True))] = 1
        return x

    w, b = nnpu(matrix(sets[1]), matrix(sets[0]), prior)
    return WordModel(words, w, b)


def toxicity_scores(docs: DataFrame, model: WordModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (0 without a model); a null text scores as an empty one.  Null and repeated ids keep their rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            score = np.zeros(batch.num_rows)
            if own is not None:
                data, offsets = utf8_parts(batch.column(2))
                for a, b in chunks(offsets):
                    score[a:b] = own.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["doc_id", "held_out", "score"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, held_out boolean, score double")


def op7_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score (higher: toxic likelier), predicted (1 from 0.5)."""
    return toxicity_scores(docs, fit(docs, labels)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
