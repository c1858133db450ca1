"""Language identification by hierarchical discrimination.

A text becomes the normalised square roots of its hashed byte-trigram counts (the whole text, A-Z folded).  One-versus-
one linear support vector machines first choose the language family, then, within the family, the language.  They are
trained on the driver with numpy from TRAIN_PER_LANG texts of each language at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.frames import crc_mod, map_arrow
from ridgeline.llm.wordhash import chunks, utf8_parts

DIMS = 2048
#: Texts of a language that the machines learn from, at most.
TRAIN_PER_LANG = 600
#: Languages that are learnt, at most.
LANGUAGES = 48
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32

#: ISO 639-1 codes by family; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "indo-aryan": "hi ur bn pa gu mr ne si",
    "turkic": "tr az kk uz",
    "semitic": "ar he mt am",
    "sinitic": "zh",
}
FAMILY_OF = {code: f for f, codes in FAMILIES.items() for code in codes.split()}


def has_letter(text: str | None) -> bool:
    """Whether a character of the text is a letter (general category L; numbers like ½ or Ⅷ are none)."""
    return bool(text) and any(map(str.isalpha, text))


def family(lang: str) -> str:
    return FAMILY_OF.get(re.split(r"[-_]", lang.lower())[0], lang)


def trigrams(column: pa.Array, dims: int = DIMS) -> Iterator[np.ndarray]:
    """Rows of normalised square roots of the hashed trigram counts, for chunks of the column."""
    data, offsets = utf8_parts(column)
    for a, b in chunks(offsets, 1 << 19, 256):
        x = _FOLD[data[offsets[a] : offsets[b]]]
        m = b - a
        out = np.zeros((m, dims), dtype=np.float32)
        if len(x) > 2:
            h = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            h = (h >> np.uint32(32 - int(dims).bit_length() + 1)).astype(np.int64)
            of = np.repeat(np.arange(m), np.diff(offsets[a : b + 1]))
            inside = of[:-2] == of[2:]
            counts = np.bincount((of[:-2] * dims + h)[inside], minlength=m * dims).reshape(m, dims)
            out = np.sqrt(counts.astype(np.float32))
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        yield out


def linear_svm(x: np.ndarray, y: np.ndarray, rounds: int = 150, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the squared hinge loss (classes weighed alike) with an L2 penalty, by Adam."""
    n, d = x.shape
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = np.zeros(d + 1, dtype=np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        slack = np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))
        g = -2 * weight * slack * y
        grad = np.concatenate((x.T @ g + penalty * w[:-1], [g.sum()])).astype(np.float32)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


class Hierarchy:
    """One-versus-one machines between families, and between the languages of each family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        lang = np.array(langs, dtype=object)
        fam = np.array([family(s) for s in langs], dtype=object)
        self.families = sorted(set(fam))
        self.members = {f: [s for s in self.langs if family(s) == f] for f in self.families}
        self.machines: dict[tuple[str, str], tuple[np.ndarray, float]] = {}
        for of, names in [(fam, self.families), *((lang, m) for m in self.members.values())]:
            for p, q in combinations(names, 2):
                rows = (of == p) | (of == q)
                self.machines[p, q] = linear_svm(x[rows], np.where(of[rows] == p, 1.0, -1.0).astype(np.float32))

    def _vote(self, x: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Winner of each row (index in names) and its mean confidence against the others."""
        n, k = len(x), len(names)
        if k == 1:
            return np.zeros(n, np.int64), np.ones(n)
        wins, sure = np.zeros((n, k)), np.zeros((n, k))
        for (i, p), (j, q) in combinations(enumerate(names), 2):
            w, b = self.machines[p, q]
            margin = x @ w + b
            c = 1 / (1 + np.exp(-np.clip(3 * margin, -30, 30)))
            wins[:, i] += margin >= 0
            wins[:, j] += margin < 0
            sure[:, i] += c
            sure[:, j] += 1 - c
        best = np.argmax(wins + 0.5 * sure / k, axis=1)
        return best, sure[np.arange(n), best] / (k - 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fam, sure = self._vote(x, self.families)
        out, score = np.empty(len(x), dtype=object), sure.copy()
        for i, f in enumerate(self.families):
            if len(rows := np.flatnonzero(fam == i)):
                best, inner = self._vote(x[rows], self.members[f])
                out[rows] = np.array(self.members[f], dtype=object)[best]
                score[rows] *= inner
        return out, score


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_PER_LANG) -> Hierarchy | None:
    """A hierarchy learnt from rows with `learn`, a language and a letter: per_lang of each language at most, chosen by a hash of the text; equal texts and repeated rows count once.

    At most LANGUAGES languages are learnt, those of the most rows: so rows, machines and the driver's memory are bounded
    whatever stands in the column."""
    pool = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r.lang: r.n for r in pool.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    pool = pool.where(F.col(lang_col).isin(*counts))
    # a first draw near the bound for each language; what is over is dropped on the driver
    odds = F.create_map(*[x for s, n in sorted(counts.items()) for x in (F.lit(s), F.lit(min(1.0, 1.2 * per_lang / n + 20 / n)))])
    own = pool.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    draw = own.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003.0 < odds[F.col("lang")]).dropDuplicates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = pa.array([has_letter(t) for t in batch.column(1).to_pylist()], pa.bool_())
            batch = batch.filter(has)
            if batch.num_rows:
                x = np.concatenate(list(trigrams(batch.column(1))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["lang", "x"])

    rows = map_arrow(draw, run, "lang string, x binary").collect()
    rows = sorted((r.lang, bytes(r.x)) for r in rows)
    kept, seen = [], dict.fromkeys(counts, 0)
    for r in sorted(rows, key=lambda r: hash_key(r[1])):
        if seen[r[0]] < per_lang:
            seen[r[0]] += 1
            kept.append(r)
    if not kept:
        return None
    x = np.stack([np.frombuffer(r[1], dtype=np.float16).astype(np.float32) for r in kept])
    return Hierarchy(x, [r[0] for r in kept])


def hash_key(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(raw)


def detect(docs: DataFrame, model: Hierarchy | None, text_col: str = "text", *, lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """All rows and columns of `docs` (but the text's type) with the language and a score from 0 to 1.

    `und` with score 0 where the text is null or has no letter, or nothing could be learnt."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hierarchy = shared.value
        for batch in batches:
            texts = batch.column(place)
            n = batch.num_rows
            lang, score = np.full(n, "und", dtype=object), np.zeros(n)
            if hierarchy is not None and n:
                got = [hierarchy.predict(x) for x in trigrams(texts)]
                lang, score = np.concatenate([g[0] for g in got]), np.clip(np.concatenate([g[1] for g in got]), 0, 1)
                for i, t in enumerate(texts.to_pylist()):
                    if not has_letter(t):
                        lang[i], score[i] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score.astype(np.float64))], names=[*batch.schema.names, lang_as, score_as])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType())])
    return map_arrow(docs, run, schema)


def op4_language_id(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out (crc32 of the id as text is 2 modulo 4; false for a null id), lang_pred, score."""
    rest = F.coalesce(crc_mod(F.col("doc_id"), 4), F.lit(-1))
    model = fit(docs, rest != 2)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (rest == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return detect(own, model).drop("text")
