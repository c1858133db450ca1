"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut after line feeds, after sentence ends with a space, and after words whose hash is 0 modulo CUT (so that a
passage without marks is cut too); every piece has a 64-bit digest of its bytes, and the r-th repetition of a piece a
digest of its own.  A sketch has cells of (count, sum of digests, sum of check digests) in three parts; each digest
goes to one cell of each part.  The difference of two sketches holds only what differs; cells with one digest are
peeled until none is left, which recovers the differing digests of both sides.  When peeling stops early, the texts
are sketched again with twice the cells.  All pairs of a batch are subtracted and peeled together.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.frames import map_arrow, partitions
from ridgeline.llm.wordhash import byte_sums, mix, utf8_parts, word_hashes

#: Cells of each of the three parts of a stored fingerprint, and of a first attempt.
PART = 8
CUT = 16
_CHECK = np.uint64(0xC2B2_AE3D_27D4_EB4F)
_SALT = np.arange(1, 4, dtype=np.uint64) * np.uint64(0xD6E8_FEB8_6659_FD93)
_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 46, 63]] = True


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the pieces of the texts data[offsets[i]:offsets[i+1]], repetitions told apart, and n + 1 bounds."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, dtype=np.int64)
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:] = data == 10
    cut[2:] |= (data[1:] == 32) & _STOP[data[:-1]]
    hashes, starts, _, _ = word_hashes(data, offsets)
    chosen = starts[1:][hashes[:-1] % np.uint64(CUT) == 0]
    cut[chosen] = True
    cut[offsets[:-1]] = True
    cut[len(data)] = True
    at = np.flatnonzero(cut)
    begin, end = at[:-1], at[1:]
    sums, inverse = byte_sums(data)
    digest = mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    bounds = np.searchsorted(begin, offsets)
    of = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((digest, of))
    d, o = digest[order], of[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (o[1:] != o[:-1])
    rank = np.arange(len(d)) - np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
    return mix(d + rank.astype(np.uint64) * np.uint64(0x9E37_79B9_7F4A_7C15)), bounds


def text_pieces(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8_parts(column)
    digests, bounds, a, n, total = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0, len(offsets) - 1, 0
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + (1 << 20), side="right")) - 1))
        d, own = pieces(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        digests.append(d)
        bounds.append(own[1:] + total)
        total, a = total + len(d), b
    return np.concatenate(digests), np.concatenate(bounds)


class Sketches:
    """Sketches of many texts side by side; text i has 3 * part[i] cells from base[i]."""

    def __init__(self, part: np.ndarray):
        self.part = part.astype(np.int64)
        self.base = np.concatenate(([0], np.cumsum(3 * self.part)))
        cells = int(self.base[-1])
        self.count, self.key, self.check = np.zeros(cells, np.int64), np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)

    def add(self, digests: np.ndarray, of: np.ndarray, sign: np.ndarray | int = 1) -> None:
        """Adds (or with sign -1 takes away) digests to the sketches `of`."""
        sign = np.broadcast_to(np.asarray(sign, dtype=np.int64), digests.shape)
        value, check = digests * sign.view(np.uint64) if sign.flags.c_contiguous else digests * sign.astype(np.int64).view(np.uint64), mix(digests ^ _CHECK) * sign.astype(np.int64).view(np.uint64)
        for j in range(3):
            spot = mix(digests + _SALT[j]) % self.part[of].astype(np.uint64)
            cell = self.base[of] + j * self.part[of] + spot.astype(np.int64)
            np.add.at(self.count, cell, sign)
            np.add.at(self.key, cell, value)
            np.add.at(self.check, cell, check)

    def minus(self, other: Sketches) -> Sketches:
        """What is left when the sketches of `other`, which are of the same sizes, are taken away from these."""
        out = Sketches(self.part)
        out.count, out.key, out.check = self.count - other.count, self.key - other.key, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests recovered, the sketch and the sign of each, and for each sketch whether nothing is left."""
        owner = np.repeat(np.arange(len(self.part)), 3 * self.part)
        got_d, got_o, got_s = [], [], []
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            sign = self.count[look]
            d = self.key[look] * sign.view(np.uint64)
            ok = mix(d ^ _CHECK) * sign.view(np.uint64) == self.check[look]
            pure, d, sign = look[ok], d[ok], sign[ok]
            if not len(pure):
                break
            o = owner[pure]
            order = np.lexsort((d, o))
            first = np.ones(len(order), dtype=bool)
            first[1:] = (d[order][1:] != d[order][:-1]) | (o[order][1:] != o[order][:-1])
            keep = order[first]
            d, o, sign = d[keep], o[keep], sign[keep]
            self.add(d, o, -sign)
            got_d.append(d)
            got_o.append(o)
            got_s.append(sign)
            look = np.flatnonzero(np.abs(self.count) == 1)
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        done = np.ones(len(self.part), dtype=bool)
        done[owner[left]] = False
        empty = np.zeros(0, np.int64)
        return (np.concatenate(got_d), np.concatenate(got_o), np.concatenate(got_s), done) if got_d else (np.zeros(0, np.uint64), empty, empty, done)


def sketched(digests: np.ndarray, bounds: np.ndarray, part: int = PART) -> Sketches:
    """The stored sketches of texts, of 3 * part cells each."""
    n = len(bounds) - 1
    s = Sketches(np.full(n, part))
    s.add(digests, np.repeat(np.arange(n), np.diff(bounds)))
    return s


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], stored: Sketches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of texts (digests and bounds of each side): how many digests only the first, and only the second has; and the attempts it took.

    `stored` is what the stored sketches of the first leave when those of the second are taken away.  Where peeling it
    fails, both texts are sketched again for as many digests as may differ, and with doubled cells until nothing is left."""
    n = len(a[1]) - 1
    only_a, only_b, tries = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    todo = np.arange(n)
    size = stored.part.copy()
    while len(todo):
        if not tries[todo[0]]:
            s = stored
        else:
            s = Sketches(size[todo])
            for (digests, bounds), sign in ((a, 1), (b, -1)):
                m = bounds[todo + 1] - bounds[todo]
                of = np.repeat(np.arange(len(todo)), m)
                at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(bounds[todo], m)
                s.add(digests[at], of, sign)
        _, of, sign, done = s.peel()
        tries[todo] += 1
        plus, minus = np.bincount(of[sign > 0], minlength=len(todo)), np.bincount(of[sign < 0], minlength=len(todo))
        only_a[todo[done]], only_b[todo[done]] = plus[done], minus[done]
        todo = todo[~done]
        most = (a[1][todo + 1] - a[1][todo]) + (b[1][todo + 1] - b[1][todo])
        size[todo] = np.where(tries[todo] == 1, np.maximum(2 * size[todo], most * 3 // 5 + 4), 2 * size[todo])
    return only_a, only_b, tries


def fingerprints(s: Sketches, bounds: np.ndarray) -> list[str]:
    """Each text's stored sketch with its number of pieces, as base64 text."""
    n = len(bounds) - 1
    cells = np.concatenate((s.count.reshape(n, -1).view(np.uint64), s.key.reshape(n, -1), s.check.reshape(n, -1), np.diff(bounds).reshape(n, 1).astype(np.uint64)), axis=1)
    return [base64.b64encode(row.tobytes()).decode() for row in cells]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], stored_a: Sketches, stored_b: Sketches) -> np.ndarray:
    """Shared pieces over all pieces of both, for each pair; 1 for two empty texts."""
    only_a, only_b, _ = differences(a, b, stored_a.minus(stored_b))
    shared = np.diff(a[1]) - only_a
    every = shared + only_a + only_b
    return np.where(every > 0, shared / np.maximum(every, 1), 1.0)


def with_next(docs: DataFrame, f, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """f(ids, texts, next texts) -> record batch, over all rows in order of id, each with the text of the row after it (the first after the last).

    Rows are dealt into ranges of ids, and an id that fills ranges of its own (null, or repeated) into ranges of a hash of
    the text; each range also gets the first row of the range after it, so the order needs one shuffle and no task gets
    more than its range.  Null ids come last; rows of the same id follow each other in order of that hash.  Only rows
    that repeat both id and text can't be parted."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("k")).withColumn("h", F.xxhash64("text"))
    n = 4 * partitions(spark)
    cuts = docs.select(F.percentile_approx(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)), [i / n for i in range(1, n)], 100 * n).alias("q")).first()[0] or []
    cuts, times = np.unique(np.array(cuts, dtype=np.int64), return_counts=True)
    base = np.concatenate(([0], np.cumsum(times)))

    def ranges(k: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The range of each row: an id that is r cuts at once has r ranges, of equal stretches of the hash."""
        i = np.searchsorted(cuts, k, side="right")
        out = base[i]
        if len(cuts):
            at = np.maximum(i - 1, 0)
            own = np.flatnonzero((i > 0) & (cuts[at] == k) & (times[at] > 1))
            r = times[at[own]]
            share = (h[own].astype(np.float64) + 2.0**63) / 2.0**64
            out[own] += np.minimum((share * r).astype(np.int64), r - 1) - (r - 1)
        return out.astype(np.int32)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranges(batch.column(0).to_numpy(), batch.column(1).to_numpy()))], names=["k", "h", "part"])

    firsts = map_arrow(rows.select("k", "h"), dealt, "k long, h long, part int").groupBy("part").agg(F.min(F.struct("k", "h")).alias("m")).collect()
    firsts = sorted((r.part, r.m.k, r.m.h) for r in firsts)
    heads = {(k, h): firsts[i - 1][0] for i, (_, k, h) in enumerate(firsts)}  # the first row of a range -> the range before it

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.array(sorted({h for _, h in heads}), dtype=np.int64)
        for batch in batches:
            k, h = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            copy = np.array([i for i in np.flatnonzero(np.isin(h, head)) if (int(k[i]), int(h[i])) in heads], dtype=np.int64)
            take = pa.array(np.concatenate((np.arange(len(k)), copy)))
            part = np.concatenate((ranges(k, h), np.array([heads[int(k[i]), int(h[i])] for i in copy], dtype=np.int32)))
            guest = np.concatenate((np.zeros(len(k), bool), np.ones(len(copy), bool)))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(guest), *[batch.column(c).take(take) for c in range(4)]], names=["part", "guest", "doc_id", "text", "k", "h"])

    spread = map_arrow(rows, placed, "part int, guest boolean, doc_id long, text string, k long, h long")
    spread = spread.repartition(partitions(spark), "part").sortWithinPartitions("part", "guest", "k", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, without its next one yet
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                b = batch.slice(a, 512)
                part, guest, ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
                if held is not None:
                    part, guest, ids, texts = [held[0], *part], [held[1], *guest], [held[2], *ids], [held[3], *texts]
                own = [i for i in range(len(ids) - 1) if not guest[i] and part[i] == part[i + 1]]
                if own:
                    yield f([ids[i] for i in own], [texts[i] for i in own], [texts[i + 1] for i in own])
                held = (part[-1], guest[-1], ids[-1], texts[-1])

    return map_arrow(spread, run, schema)


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by as many first ones of the next."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _fingerprint_rows(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    changed = [edited(t, x) for t, x in zip(texts, following, strict=True)]
    own, new, after = (text_pieces(pa.array(x, pa.large_string())) for x in (texts, changed, following))
    s_own, s_new, s_after = (sketched(*x) for x in (own, new, after))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]), pa.array(fingerprints(s_own, own[1])), pa.array(fingerprints(s_new, new[1])), pa.array(likeness(own, new, s_own, s_new)), pa.array(likeness(own, after, s_own, s_after))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """Per row: doc_id, n_pieces and fingerprint; a null text counts as empty.  Rows with null or repeated ids keep their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, bounds = text_pieces(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(fingerprints(sketched(d, bounds, part), bounds), pa.string())], names=["doc_id", "n_pieces", "fingerprint"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, n_pieces long, fingerprint string")


def op8_document_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return with_next(docs, _fingerprint_rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
