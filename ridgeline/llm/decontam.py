"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by document: each shard (a map batch) stores, for every term, the sorted positions at which its
documents have it, and where its documents begin.  It is written to the shared checkpoint folder.  A search sends the
test items to all shards, one block of bounded size after another.  A shard looks only at windows whose leading term
(the rarest among the items) it has; for each it takes the list of the term that is rarest in it, shifts it by the
term's offset and intersects it with the other lists in order of rarity; what remains are the exact occurrences.
Proximity matches need the rarest terms of an item within a few words of each other, in any order.  Terms are 64-bit
hashes of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.frames import binary, map_arrow, saved, to_binary
from ridgeline.llm.wordhash import mix, utf8_parts, word_hashes

#: Bytes other than 0-9, A-Z, a-z and those of non-ASCII characters part the words.
_BREAK = np.ones(256, dtype=bool)
_BREAK[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _BREAK[_a:_b] = False

#: Words of test items in a block; one block is broadcast at a time.
BLOCK_WORDS = 2_000_000
#: Words within which the required terms of an item are a proximity match, in the registered query.
SLOP = 16
#: Bytes of text in a shard, about; a longer text has a shard of its own.
SHARD_BYTES = 4 << 20


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts, and each text's first word (n + 1 values)."""
    data, offsets = utf8_parts(column)
    words, first = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    total, a, n = 0, 0, len(offsets) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + (1 << 20), side="right")) - 1))
        w, _, _, begin = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], _BREAK)
        words.append(w)
        first.append(begin[1:] + total)
        total, a = total + len(w), b
    return np.concatenate(words), np.concatenate(first)


class Items:
    """A block of test items: their terms in a row, the distinct windows by where they begin in it, and the items of each window."""

    def __init__(self, ids: list[int | None], column: pa.Array, width: int):
        words, first = _terms(column)
        self.ids = np.array([0 if i is None else i for i in ids], dtype=np.int64)
        self.none = np.array([i is None for i in ids], dtype=bool)
        self.terms, number, count = np.unique(words, return_inverse=True, return_counts=True)
        self.first = first
        self.row = number.astype(np.int32)
        length = np.diff(first)
        #: length -> first places of the distinct windows, their leading terms, and the (window, item) pairs sorted by window
        self.windows = {}
        for m in np.unique(np.minimum(length[length > 0], width)).tolist():
            of = np.flatnonzero((length == m) if m < width else (length >= width))
            n = length[of] - m + 1
            at = np.repeat(first[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            name = np.zeros(len(at), dtype=np.uint64)
            lead = self.row[at].copy()
            for k in range(m):
                own = self.row[at + k]
                name = mix(name * np.uint64(0x9E37_79B9_7F4A_7C15) + words[at + k])
                lead = np.where(count[own] < count[lead], own, lead)
            _, chosen, inverse = np.unique(name, return_index=True, return_inverse=True)
            pair = np.unique(np.stack((inverse.reshape(-1), np.repeat(of, n))), axis=1)
            self.windows[m] = (at[chosen], lead[chosen], pair)


class Shard:
    """Positional postings of one shard."""

    def __init__(self, terms: np.ndarray, bounds: np.ndarray, positions: np.ndarray, starts: np.ndarray):
        self.terms, self.bounds, self.positions, self.starts = terms, bounds, positions, starts

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """Index in this shard of each of the sorted `terms`; -1 for one that it doesn't have."""
        if not len(self.terms):
            return np.full(len(terms), -1, dtype=np.int64)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[i] == terms, i, -1)

    def keyed(self) -> np.ndarray:
        """All postings as term number * 2**33 + position, ascending."""
        return (np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.bounds)) << 33) + self.positions

    def phrases(self, row: np.ndarray, begin: np.ndarray, lead: np.ndarray, m: int, number: np.ndarray, keyed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word's position) of every occurrence, within one document, of the windows row[begin:begin + m]."""
        live = np.flatnonzero(number[lead] >= 0)
        own = number[row[begin[live][:, None] + np.arange(m)]]
        size = np.where(own >= 0, self.bounds[own + 1] - self.bounds[own], 0)
        whole = size.min(axis=1, initial=1) > 0
        live, own, size = live[whole], own[whole], size[whole]
        if not len(live):
            return live, live
        order = np.argsort(size, axis=1, kind="stable")
        rare = np.take_along_axis(own, order, axis=1)
        n = self.bounds[rare[:, 0] + 1] - self.bounds[rare[:, 0]]
        which = np.repeat(np.arange(len(live)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = self.positions[self.bounds[rare[which, 0]] + inner] - order[which, 0]
        for k in range(1, m):
            want = (rare[which, k] << 33) + at + order[which, k]
            i = np.minimum(np.searchsorted(keyed, want), len(keyed) - 1)
            ok = keyed[i] == want
            which, at = which[ok], at[ok]
            if not len(which):
                break
        doc = np.searchsorted(self.starts, at, side="right")
        ok = (at >= 0) & (doc == np.searchsorted(self.starts, at + m - 1, side="right"))
        return live[which[ok]], at[ok]

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the first of the shard's term numbers that have all others within `slop` words in their document."""
        if not len(terms) or (terms < 0).any():
            return np.zeros(0, dtype=np.int64)
        at = self.positions[self.bounds[terms[0]] : self.bounds[terms[0] + 1]]
        doc = np.searchsorted(self.starts, at, side="right")
        lo, hi = np.maximum(at - slop, self.starts[doc - 1]), np.minimum(at + slop, self.starts[doc] - 1)
        ok = np.ones(len(at), dtype=bool)
        for t in terms[1:]:
            p = self.positions[self.bounds[t] : self.bounds[t + 1]]
            i = np.minimum(np.searchsorted(p, lo), len(p) - 1)
            ok &= (p[i] >= lo) & (p[i] <= hi)
        return at[ok]


_INDEX = "shard long, doc_ids binary, none binary, starts binary, terms binary, bounds binary, positions binary"
_PACKED = ("<i8", "<i1", "<i8", "<u8", "<i8", "<u4")


def positional_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of the index of all terms, stored: shard, doc_ids, none (1 where the id is null), starts, terms, bounds, positions (packed arrays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 40
        for batch in batches:
            _, offsets = utf8_parts(batch.column(1))
            a, n = 0, batch.num_rows
            while a < n:
                b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + SHARD_BYTES, side="right")) - 1))
                words, first = _terms(batch.column(1).slice(a, b - a))
                at = np.argsort(words, kind="stable")
                words = words[at]
                new = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1]))) if len(words) else np.zeros(0, np.int64)
                ids = batch.column(0).slice(a, b - a)
                packed = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(ids.is_null()).astype(np.int8), first, words[new], np.concatenate((new, [len(words)])).astype(np.int64), at.astype(np.uint32)]
                yield pa.RecordBatch.from_arrays([pa.array([shard]), *[to_binary(x, np.array([0, len(x)])) for x in packed]], names=["shard", "doc_ids", "none", "starts", "terms", "bounds", "positions"])
                a, shard = b, shard + 1

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return saved(map_arrow(texts, run, _INDEX))


def item_blocks(items: DataFrame, id_col: str, text_col: str, width: int) -> Iterator[Items]:
    """The items in blocks of about BLOCK_WORDS words; the driver holds one at a time."""
    ids, texts, size = [], [], 0
    for r in items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t or "") // 4
        if size >= BLOCK_WORDS:
            yield Items(ids, pa.array(texts, pa.string()), width)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, pa.array(texts, pa.string()), width)


def corpus_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the sorted `terms` occurs in all documents of an index, combined before the shuffle."""
    every = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(every.value), dtype=np.int64)
        for batch in batches if len(every.value) else ():
            for own, bounds in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, size = np.frombuffer(own, dtype="<u8"), np.diff(np.frombuffer(bounds, dtype="<i8"))
                i = np.minimum(np.searchsorted(every.value, own), len(n) - 1)
                known = every.value[i] == own
                n[i[known]] += size[known]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["term", "n"])

    total = map_arrow(index.select("terms", "bounds"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms), dtype=np.int64)
    out[total.column("term").to_numpy()] = total.column("n").to_numpy()
    return out


def required_terms(block: Items, counts: np.ndarray, near_terms: int) -> list[np.ndarray]:
    """For each item, the numbers of the `near_terms` of its terms that are rarest in the corpus (of equally rare ones, those that the item has first), of those that occur in it; none where fewer occur than it takes, or the item has no id."""
    out = []
    for i in range(len(block.ids)):
        mine, at = np.unique(block.row[block.first[i] : block.first[i + 1]], return_index=True)
        mine = mine[np.argsort(at, kind="stable")]
        some = mine[counts[mine] > 0]
        some = some[np.argsort(counts[some], kind="stable")[:near_terms]]
        out.append(some if len(some) == min(near_terms, len(mine)) and not block.none[i] else some[:0])
    return out


def _search(raw: list[np.ndarray], block: Items, required: list[np.ndarray] | None, slop: int | None) -> list[np.ndarray]:
    """Of a shard: the starts and ends of the hit stretches, (document, item) of windows that occur, and (document, item, place) of proximity matches, flat."""
    _, _, starts, own, bounds, positions = raw
    shard = Shard(own, bounds, positions.astype(np.int64), starts)
    keyed, number = shard.keyed(), shard.numbers(block.terms)
    begins, ends, got, close = [], [], [np.zeros((2, 0), np.int64)], [np.zeros((3, 0), np.int64)]
    for m, (begin, lead, pair) in block.windows.items():
        w, at = shard.phrases(block.row, begin, lead, m, number, keyed)
        begins.append(at)
        ends.append(at + m)
        lo, hi = np.searchsorted(pair[0], w), np.searchsorted(pair[0], w, side="right")
        n = hi - lo
        item = pair[1][np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        d = np.repeat(np.searchsorted(starts, at, side="right") - 1, n)[~block.none[item]]
        got.append(np.unique(np.stack((d, block.ids[item[~block.none[item]]])), axis=1))
    for i, mine in enumerate(required or ()):
        at = shard.near(number[mine], slop)
        close.append(np.stack((np.searchsorted(starts, at, side="right") - 1, np.full(len(at), block.ids[i]), at)))
    none = np.zeros(0, np.int64)
    return [np.concatenate(begins) if begins else none, np.concatenate(ends) if ends else none, np.concatenate(got, axis=1), np.concatenate(close, axis=1)]


def contamination(docs: DataFrame, items: DataFrame, *, width: int = 13, slop: int | None = None, near_terms: int = 4, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted distinct item ids with an occurring window), hits (start, end of the hit stretches, in words) and near (item_id, at), which is empty without `slop`.

    A window is `width` consecutive words of an item, or all words of a shorter one.  A null or wordless text has no
    words and no hits; an item without words is left out; one with a null id counts in n_hit and hits, but can't be
    named; items that repeat an id count once.  Documents with null or repeated ids keep their rows.  Extra columns are
    left out.

    A proximity match of an item is a place in a document where the rarest of its required terms (see required_terms)
    has all the others within `slop` words; terms are ranked by their counts in all documents, so a match doesn't depend
    on how the documents are dealt.

    Items come in blocks of BLOCK_WORDS words.  One block is the rule; where there are more, each is broadcast and
    searched for on its own, and what a shard holds of them is put together by the shard's number."""
    context = docs.sparkSession.sparkContext
    index = positional_index(docs, id_col, text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    near_kind = pa.list_(pa.struct([("item_id", pa.int64()), ("at", pa.int64())]))
    schema = "doc_id long, n_words long, n_hit long, items array<long>, hits array<struct<start:long,end:long>>, near array<struct<item_id:long,at:long>>"

    def read(batch: pa.RecordBatch, row: int) -> list[np.ndarray]:
        return [np.frombuffer(batch.column(c + 1)[row].as_py(), dtype=t) for c, t in enumerate(_PACKED)]

    def prepared(block: Items):
        required = required_terms(block, corpus_counts(index, block.terms), near_terms) if slop is not None else None
        return context.broadcast((block, required))

    def direct(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    raw = read(batch, row)
                    yield _per_document(raw, [_search(raw, *shared.value, slop)] if shared else [], kind, near_kind)

        return map_arrow(index, run, schema)

    blocks = item_blocks(items, item_id_col, item_text_col, width)
    block, following = next(blocks, None), next(blocks, None)
    if following is None:
        return direct(prepared(block) if block is not None else None)

    def partial(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    found = _search(read(batch, row), *shared.value, slop)
                    if any(x.size for x in found):
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in found]], names=["shard", "begins", "ends", "got", "close"])

        found = saved(map_arrow(index, run, "shard long, begins binary, ends binary, got binary, close binary"))
        shared.unpersist()
        return found

    parts = partial(prepared(block))
    while following is not None:
        parts = parts.union(partial(prepared(following)))
        following = next(blocks, None)
    parts = parts.groupBy("shard").agg(F.collect_list(F.struct("begins", "ends", "got", "close")).alias("found"))  # one for each block at most

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = [[np.frombuffer(x[c], dtype=np.int64).reshape(shape) for c, shape in (("begins", -1), ("ends", -1), ("got", (2, -1)), ("close", (3, -1)))] for x in batch.column(7)[row].as_py() or ()]
                yield _per_document(read(batch, row), found, kind, near_kind)

    return map_arrow(index.join(parts, "shard", "left"), whole, schema)


def _per_document(raw: list[np.ndarray], found: list[list[np.ndarray]], kind, near_kind) -> pa.RecordBatch:
    ids, none, starts = raw[:3]
    hit, got, close = [(x[0], x[1]) for x in found], [x[2] for x in found], [x[3] for x in found]
    n = len(ids)
    total = int(starts[-1]) if len(starts) else 0
    depth = np.zeros(total + 1, dtype=np.int32)
    for a, b in hit:
        np.add.at(depth, a, 1)
        np.add.at(depth, b, -1)
    inside = np.cumsum(depth)[:total] > 0
    sums = np.concatenate(([0], np.cumsum(inside)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[starts[:-1][starts[:-1] < total]] = inside[starts[:-1][starts[:-1] < total]]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = starts[1:][starts[1:] > 0] - 1
    last[ends] = inside[ends]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    cut = np.searchsorted(a, starts)
    base = starts[np.searchsorted(starts, a, side="right") - 1] if len(a) else a
    pairs = np.unique(np.concatenate(got, axis=1), axis=1) if got else np.zeros((2, 0), np.int64)
    near = np.concatenate(close, axis=1) if close else np.zeros((3, 0), np.int64)
    near = near[:, np.lexsort((near[2], near[1], near[0]))]
    item_cut, near_cut = np.searchsorted(pairs[0], np.arange(n + 1)), np.searchsorted(near[0], np.arange(n + 1))
    hits = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.StructArray.from_arrays([pa.array(a - base), pa.array(b - base)], fields=list(kind.value_type)))
    items = pa.ListArray.from_arrays(pa.array(item_cut.astype(np.int32)), pa.array(pairs[1]))
    nears = pa.ListArray.from_arrays(pa.array(near_cut.astype(np.int32)), pa.StructArray.from_arrays([pa.array(near[1]), pa.array(near[2] - starts[near[0]])], fields=list(near_kind.value_type)))
    return pa.RecordBatch.from_arrays([pa.array(ids, mask=none.astype(bool)), pa.array(np.diff(starts)), pa.array(sums[starts[1:]] - sums[starts[:-1]]), items, hits, nears], names=["doc_id", "n_words", "n_hit", "items", "hits", "near"])


def op9_benchmark_decontamination(docs: DataFrame, items: DataFrame, slop: int | None = SLOP) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, by windows of 13 words; n_near and near_items, the proximity matches within `slop` words and the items that they are of (0 and empty without `slop`)."""
    found = contamination(docs, items, width=13, slop=slop)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    near = F.array_join(F.array_sort(F.array_distinct(F.col("near.item_id"))).cast("array<string>"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"), F.size("near").cast("long").alias("n_near"), near.alias("near_items"))


def op9_benchmark_proximity(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: doc_id, n_near, n_near_items, near_items: the proximity matches within SLOP words, and the items that they are of, by id."""
    found = contamination(docs, items, width=13, slop=SLOP)
    ids = F.array_sort(F.array_distinct(F.col("near.item_id")))
    return found.select("doc_id", F.size("near").cast("long").alias("n_near"), F.size(ids).cast("long").alias("n_near_items"), F.array_join(ids.cast("array<string>"), ",").alias("near_items"))


def sha256_of_ids(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


#: The same rows from plain strings; the words of a text in order, windows as joined words.
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT m FROM bw
), dw AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, lens WHERE len(w) >= m)
), hit AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m
), pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM hit) GROUP BY doc_id
), tw AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d WHERE len(w) > 0
), ti AS (
  SELECT item_id, word, min(p) AS p FROM (SELECT item_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM b WHERE len(w) > 0 AND item_id IS NOT NULL) GROUP BY item_id, word
), tr AS (
  SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY n, p) AS r, count(*) OVER (PARTITION BY item_id) AS known
  FROM ti JOIN (SELECT word, count(*) AS n FROM tw GROUP BY word) USING (word)
), tq AS (
  SELECT item_id, word, r, least(4, total) AS take FROM tr JOIN (SELECT item_id, count(*) AS total FROM ti GROUP BY item_id) USING (item_id) WHERE r <= 4 AND known >= least(4, total)
), nr AS (
  SELECT a.item_id, x.doc_id, x.p FROM tq a JOIN tw x ON a.word = x.word JOIN tq o ON o.item_id = a.item_id JOIN tw y ON y.word = o.word AND y.doc_id = x.doc_id AND y.p BETWEEN x.p - 16 AND x.p + 16
  WHERE a.r = 1 GROUP BY a.item_id, x.doc_id, x.p, a.take HAVING count(DISTINCT o.word) = a.take
), nd AS (
  SELECT doc_id, sum(c) AS n_near, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS near_items FROM (SELECT doc_id, item_id, count(*) AS c FROM nr GROUP BY doc_id, item_id) GROUP BY doc_id
), its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, coalesce(near_items, '') AS near_items
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nd USING (doc_id)
"""
