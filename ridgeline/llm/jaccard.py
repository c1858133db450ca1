"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures and exact sorted-array intersection.

1. Every text becomes its sorted set of 64-bit shingle hashes.  Texts with equal sets form one class; a class has a
   digest, a size and a signature: a parity bitmap of SIGNATURE_BITS bits a shingle (a power of two of 64 bits at least).
2. Prefix filter: two sets that reach the threshold share a shingle among the first size - ceil(3/4 size) + 1 of both,
   in any order common to all sets.  The order here puts the most frequent shingles last (found in a pass over all
   texts; a table of HOT_KEPT at most, which affects only the speed), and then goes by hash.
3. Postings travel in packed blocks of byte columns, one row per map batch and bucket: 40 bits of the shingle, the class,
   its size to within 0.04 % and the place in the prefix, 16 bytes in all.  Shingles that agree in these bits and the
   bucket share a list, which adds candidates and loses none.  At the first shingle that two sets share, no more than
   what follows it can be shared too, so members without a partner of fitting size and place leave their list.
   A first round verifies stars: every member with the centre of its list and size band, and of a member's centres only
   the one that it shares the most lists with; it joins most of what belongs together.
   Lists of two have no tile: the rest of their pairs, as far as their ends are then of different components, goes
   through the bit bound and the exact intersection like the pairs of tiles.
4. A list of three or more whose members are then still of different components is cut into tiles by size band and block.  In a tile,
   every pair of different components has its overlap bounded from above by the bit counts of the signatures; pairs
   that pass are intersected exactly.  A pair that meets in several lists is left to the first of them, as far as the
   few list names that travel with each member tell.  So no pair that reaches the threshold is lost, and pairs that are connected
   anyway cost nothing.  Pairs never come from a cross join, and a frequent shingle's list is dealt out over blocks.

In both rounds the texts of a pair meet at one of the two, their owner; owners of many pairs are dealt over slots.
Two different shingles share a 64-bit hash with a chance of about n**2 / 2**65 for n distinct shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.components import connected
from ridgeline.llm.frames import binary, joined, map_arrow, partitions, release_memory, saved, to_binary, whole_groups
from ridgeline.llm.wordhash import mix, shingle_sets

#: Frequent shingles that the common order knows of, at most (16 bytes each).  Only the speed depends on it.
HOT_KEPT = 1 << 19
#: A shingle of so many classes counts as frequent.
HOT_FROM = 48
#: One class in so many (by its digest) reports all its shingles, so that those spread thinly over tasks are counted too.
SAMPLED = 512
#: Bits of a signature for each shingle, at least: the wider, the fewer pairs below the threshold pass the bound.
SIGNATURE_BITS = 2
#: Of the lists that a class is in, so many travel with it to its tiles, for a pair to be looked at in one tile only.
FIRST_LISTS = 4
#: Members of a block of a long list.
BLOCK = 1024
#: Pairs of an owner in one slot.
SLOT = 1024
#: Bytes of postings for a bucket.
BUCKET_BYTES = 6 << 20
#: Texts to be compared whose ids are broadcast; beyond, they are picked by a shuffled join.
BROADCAST_IDS = 1_000_000

#: Bytes of a posting: 5 of the shingle, 8 of the class, 2 of its size, 1 of the place.
_POSTING_BYTES = 16
_TOKEN = np.uint64((1 << 40) - 1)
#: Sizes are kept as log2 in steps of 1 / _STEPS, places as parts of the size in steps of 1 / _PLACES; both rounded down.
_STEPS = 2048
_PLACES = 1020
#: Room for the rounding of sizes.
_ROOM = 1.001


def _digests(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set: the order-free sum of its mixed hashes, mixed with its size."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat.copy()), dtype=np.uint64)))
    n = np.diff(bounds).astype(np.uint64)
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + n * np.uint64(0x9E37_79B9_7F4A_7C15)).view(np.int64)


def _widths(n: np.ndarray) -> np.ndarray:
    """64-bit words of the signature of a set of n: a power of two with at least SIGNATURE_BITS * n bits."""
    return (1 << np.maximum(np.ceil(np.log2(SIGNATURE_BITS * np.maximum(n, 1))).astype(np.int64) - 6, 0)).astype(np.int64)


def _signature(hashes: np.ndarray, words: int) -> np.ndarray:
    bits = np.bincount((hashes & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def _fold(sig: np.ndarray, words: int) -> np.ndarray:
    """Signatures (rows) at a smaller width: the parity of a bit is that of the bits that meet in it."""
    while sig.shape[1] > words:
        half = sig.shape[1] // 2
        sig = sig[:, :half] ^ sig[:, half:]
    return sig


def _reported(tokens: np.ndarray, counts: np.ndarray, kind: int) -> pa.RecordBatch:
    m = len(tokens)
    return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int8)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(counts), pa.array(tokens.view(np.int64)), pa.nulls(m, pa.binary())], names=["kind", "doc_id", "mark", "n", "key", "bits"])


def _often(sets: list[np.ndarray]) -> pa.RecordBatch:
    """Kind 1: shingles that three or more of the sets have."""
    every = np.concatenate(sets)
    every.sort()
    starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    counts = np.diff(np.concatenate((starts, [len(every)])))
    often = counts >= 3
    return _reported(every[starts[often]], counts[often], 1)


def _scan(width: int):
    """Kind 0: a document's digest, size and signature.  Kind 1: a shingle that is frequent in a batch, and in how many of
    its classes.  Kind 2: a shingle of a sampled class, n being the class's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        fresh, held = [], 0
        for batch in batches:
            ids, marks = batch.column(0), batch.column(2)
            for a, b, flat, at in shingle_sets(batch.column(1), width):
                n = np.diff(at)
                key = _digests(flat, at)
                words = np.where(n > 0, _widths(n), 0)
                sig = [_signature(flat[at[i] : at[i + 1]], int(words[i])) if n[i] else np.zeros(0, np.uint64) for i in range(b - a)]
                flat_sig = np.concatenate(sig) if sig else np.zeros(0, np.uint64)
                chosen = mix(key.view(np.uint64) + np.uint64(77)) % np.uint64(SAMPLED) == 0
                for i in np.flatnonzero(n):
                    if (k := int(key[i])) not in seen:
                        seen.add(k)
                        s = flat[at[i] : at[i + 1]]
                        fresh.append(s)
                        held += int(n[i])
                        if chosen[i]:
                            yield _reported(s, np.full(len(s), k, np.int64), 2)
                if held >= 2_000_000:
                    yield _often(fresh)
                    fresh, held = [], 0
                m = b - a
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int8)), ids.slice(a, m).cast(pa.int64()), marks.slice(a, m), pa.array(n.astype(np.int64)), pa.array(key), to_binary(flat_sig, np.concatenate(([0], np.cumsum(words))))], names=["kind", "doc_id", "mark", "n", "key", "bits"])
        if fresh:
            yield _often(fresh)

    return run


def _packed(token: np.ndarray, key: np.ndarray, size: np.ndarray, place: np.ndarray) -> bytes:
    """Postings sorted by shingle as byte columns: the high bytes of neighbours are alike and compress."""
    low = token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    return b"".join((np.ascontiguousarray(low.T).tobytes(), key.astype("<i8").tobytes(), size.astype("<u2").tobytes(), place.astype(np.uint8).tobytes()))


def _unpacked(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    m = len(raw) // _POSTING_BYTES
    token = np.zeros((m, 8), dtype=np.uint8)
    token[:, :5] = raw[: 5 * m].reshape(5, m).T
    return token.view("<u8")[:, 0], np.frombuffer(raw[5 * m : 13 * m].tobytes(), "<i8"), np.frombuffer(raw[13 * m : 15 * m].tobytes(), "<u2"), raw[15 * m :]


def _postings(width: int, num: int, den: int, buckets: int, hot_b):
    """Packed postings of the prefixes, a row for each batch and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, spread = hot_b.value
        sieve = np.zeros(1 << 20, dtype=bool)
        sieve[(hot & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        seen: set[int] = set()
        parts: list[tuple[np.ndarray, int, int]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            length = np.array([len(x[0]) for x in parts])
            token = np.concatenate([x[0] for x in parts])
            key = np.repeat(np.array([x[1] for x in parts], dtype=np.int64), length)
            n = np.array([x[2] for x in parts])
            rank = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
            place = np.minimum(_PLACES * rank // np.repeat(n, length), 255)
            size = np.repeat(np.floor(np.log2(n) * _STEPS).astype(np.int64), length)
            parts.clear()
            salt = np.zeros(len(token), dtype=np.uint64)
            if len(hot):
                i = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                many = (hot[i] == token) & (spread[i] > 1)
                salt[many] = (mix(key[many].view(np.uint64)) % spread[i[many]].astype(np.uint64)) + np.uint64(1)
            where = (mix((token & _TOKEN) + salt * np.uint64(0x9E37_79B9_7F4A_7C15)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((token & _TOKEN, where))
            got, first = np.unique(where[order], return_index=True)
            cut = np.concatenate((first, [len(token)]))
            rows = [_packed(token[o], key[o], size[o], place[o]) for o in (order[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True))]
            return pa.RecordBatch.from_arrays([pa.array(got.astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "block"])

        for batch in batches:
            for a, b, flat, at in shingle_sets(batch.column(0), width):
                n, key = np.diff(at), _digests(flat, at)
                late = sieve[(flat & np.uint64((1 << 20) - 1)).astype(np.int64)] if len(hot) else np.zeros(len(flat), bool)
                maybe = np.flatnonzero(late)
                if len(maybe):
                    late[maybe] = hot[np.minimum(np.searchsorted(hot, flat[maybe]), len(hot) - 1)] == flat[maybe]
                for i in range(b - a):
                    if not n[i] or (k := int(key[i])) in seen:
                        continue
                    seen.add(k)
                    s, l = flat[at[i] : at[i + 1]], late[at[i] : at[i + 1]]
                    take = int(n[i]) - -(-num * int(n[i]) // den) + 1
                    first = s[~l][:take] if l.any() else s[:take]
                    if len(first) < take:
                        first = np.concatenate((first, s[l][: take - len(first)]))
                    parts.append((first, k, int(n[i])))
                    held += take
                if held >= 600_000:
                    yield flush()
                    held = 0
        if parts:
            yield flush()

    return run


def _partnered(n: np.ndarray, up: np.ndarray, of: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Members that may have a partner in their list; every list is sorted by n, `of` and `start` tell a member's list and its begin.

    x and y may be partners if neither is larger than the other's `up`."""
    wide = 4.0 * float(up.max(initial=1.0)) + 16.0
    base = of * wide
    beyond = np.searchsorted(base + n, base + up, side="right")
    most = np.maximum.accumulate(base + up) - base
    here = np.arange(len(n))
    own = up >= n
    before = (here > start) & (most[np.maximum(here - 1, 0)] >= n)
    shorter = (beyond > start) & (most[np.maximum(beyond - 1, 0)] >= n)
    return np.where(own, before | (beyond > here + 1), shorter)


def _lists(num: int, den: int, hot_b):
    """Of a bucket: kind 0, pairs (owner, other) to verify first, kind 3 those of lists of two, n being the number of lists; kind 1, members of lists of three or more; kind 2, the first member of a size band of a salted list, n being the band."""

    def run(group: pa.Table) -> pa.Table:
        hot, spread = hot_b.value
        salted_tokens = np.sort(hot[spread > 1] & _TOKEN)
        data, offsets = binary(group.column("block"))
        blocks = [_unpacked(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        token, key, code, place = (np.concatenate([x[c] for x in blocks]) for c in range(4))
        del blocks, data
        order = np.lexsort((place, key, code, token))
        token, key, code, place = token[order], key[order], code[order].astype(np.int64), place[order]
        fresh = np.ones(len(token), dtype=bool)
        fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key, code, place = token[fresh], key[fresh], code[fresh], place[fresh]

        def spans(token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate((starts, [len(token)]))).astype(np.int64)
            salted = np.zeros(len(starts), dtype=bool)
            if len(salted_tokens) and len(starts):
                salted = salted_tokens[np.minimum(np.searchsorted(salted_tokens, token[starts]), len(salted_tokens) - 1)] == token[starts]
            return starts, size, salted

        starts, size, salted = spans(token)
        keep = np.repeat((size >= 2) | salted, size)
        token, key, code, place = token[keep], key[keep], code[keep], place[keep]
        starts, size, salted = spans(token)
        of = np.repeat(np.arange(len(size)), size)
        n = np.exp2(code / _STEPS)
        up = n * ((1 - place / _PLACES) * (num + den) / num - 1) * _ROOM
        keep = salted[of] | _partnered(n, up, of, starts[of]) if len(n) else np.zeros(0, bool)
        token, key, code, n, up = token[keep], key[keep], code[keep], n[keep], up[keep]
        starts, size, salted = spans(token)
        of = np.repeat(np.arange(len(size)), size)
        band = code // _band_steps(num, den)
        # the centre of a list and band is the member that comes first in an order which all lists share
        turn = np.lexsort((mix(key.view(np.uint64) + np.uint64(5)), band, of))
        lead = np.ones(len(key), dtype=bool)
        lead[1:] = (of[1:] != of[:-1]) | (band[1:] != band[:-1])
        centre = np.maximum.accumulate(np.where(lead, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
        # stars, and the centres of neighbouring bands
        x = np.flatnonzero(~lead)
        y = np.flatnonzero(lead)
        y = y[1:][of[y[1:]] == of[y[:-1]]] if len(y) else y
        a, b = turn[np.concatenate((centre[x], centre[y - 1]))], turn[np.concatenate((x, y))]
        near = (n[a] <= up[b]) & (n[b] <= up[a])
        a, b = a[near], b[near]
        two = (size == 2) & ~salted
        pair, shared = np.unique(np.stack((np.where(two[of[a]], 3, 0), key[a], key[b])), axis=1, return_counts=True) if len(a) else (np.zeros((3, 0), np.int64), np.zeros(0, np.int64))
        # lists of three or more, by their members or, where salted, by their shingle
        digest = np.add.reduceat(mix(key.view(np.uint64) + np.uint64(1)), starts) if len(size) else np.zeros(0, np.uint64)
        name = np.where(salted, token[starts] if len(size) else digest, mix(digest + size.astype(np.uint64))).view(np.int64)
        _, once = np.unique(name, return_index=True)
        only = np.zeros(len(size), dtype=bool)
        only[once] = True
        wide = (((size >= 3) & only) | salted)[of]
        first = turn[np.flatnonzero(lead & salted[of])]
        banded = mix(name[of][first].view(np.uint64) + band[first].astype(np.uint64)).view(np.int64)
        out = [(pair[0].astype(np.int8), pair[1], pair[2], shared.astype(np.int32))]
        out.append((np.ones(int(wide.sum()), np.int8), name[of][wide], key[wide], band[wide].astype(np.int32)))
        out.append((np.full(len(first), 2, np.int8), banded, key[first], band[first].astype(np.int32)))
        found = pa.table([np.concatenate([x[c] for x in out]) for c in range(4)], names=["kind", "a", "b", "n"])
        del token, key, n, up, of, out
        release_memory()
        return found

    return run


def _band_steps(num: int, den: int) -> int:
    """Width of a size band in steps of the size's code: sizes of a pair that reaches the threshold are in one band or in neighbouring ones."""
    return int(np.ceil(np.log2(den / num) * _STEPS)) + 2


def _may(na: np.ndarray, nb: np.ndarray, differ: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes whose signatures differ in so many bits may reach the threshold: the overlap is (na + nb - differ) / 2 at most."""
    s = na + nb
    return (s - differ) * den >= num * (s + differ)


def _bounded(num: int, den: int):
    """Pairs that the bit counts of their signatures let pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            (da, oa), (db, ob) = binary(batch.column("bits_a")), binary(batch.column("bits_b"))
            ok = np.zeros(batch.num_rows, dtype=bool)
            la, lb = np.diff(oa) // 8, np.diff(ob) // 8
            for wa, wb in set(zip(la.tolist(), lb.tolist(), strict=True)):
                i = np.flatnonzero((la == wa) & (lb == wb))
                x = da[oa[i][:, None] + np.arange(8 * wa)].view(np.uint64)
                y = db[ob[i][:, None] + np.arange(8 * wb)].view(np.uint64)
                w = min(wa, wb)
                ok[i] = _may(na[i], nb[i], np.bitwise_count(_fold(x, w) ^ _fold(y, w)).sum(axis=1, dtype=np.int64), num, den)
            ok &= (den * na >= num * nb) & (den * nb >= num * na)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])

    return run


def _tiles(num: int, den: int):
    """Pairs of different components in each tile that the bit counts let pass.

    A tile has the members of one list, size band and two blocks; `guest` marks those of the band below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["list", "band", "lo", "hi"]):
            key, n, comp, block, guest, lo, hi = (t.column(c).to_numpy() for c in ("key", "n", "comp", "block", "guest", "lo", "hi"))
            data, offsets = binary(t.column("bits"))
            words = np.diff(offsets) // 8
            few = t.column("few").combine_chunks().values.to_numpy().reshape(-1, FIRST_LISTS)
            name = t.column("list").to_numpy()
            got: list[np.ndarray] = []
            for g in range(len(at) - 1):
                i = np.arange(at[g], at[g + 1])
                if len(i) < 2 or (comp[i] == comp[i[0]]).all() or guest[i].all():
                    continue
                w = int(words[i].min())
                sig = np.empty((len(i), w), dtype=np.uint64)
                for v in np.unique(words[i]):
                    j = np.flatnonzero(words[i] == v)
                    sig[j] = _fold(data[offsets[i[j]][:, None] + np.arange(8 * v)].view(np.uint64), w)
                home = np.flatnonzero(~guest[i])
                step = max(1, (1 << 22) // (len(i) * w))
                for h in range(0, len(home), step):
                    x = home[h : h + step]
                    differ = np.bitwise_count(sig[x][:, None, :] ^ sig[None, :, :]).sum(axis=2, dtype=np.int64)
                    nx, ny = n[i[x]][:, None], n[i][None, :]
                    ok = _may(nx, ny, differ, num, den) & (comp[i[x]][:, None] != comp[i][None, :]) & (den * nx >= num * ny) & (den * ny >= num * nx)
                    if lo[at[g]] != hi[at[g]]:
                        ok &= block[i[x]][:, None] != block[i][None, :]
                    r, c = np.nonzero(ok)
                    if len(r):
                        fx, fy = few[i[x[r]]], few[i[c]]
                        earlier = ((fx[:, :, None] == fy[:, None, :]) & (fx < name[at[g]])[:, :, None]).any(axis=(1, 2))
                        r, c = r[~earlier], c[~earlier]
                    if len(r):
                        p, q = key[i[x[r]]], key[i[c]]
                        got.append(np.unique(np.stack((np.minimum(p, q), np.maximum(p, q))), axis=1))
            if got:
                pair = np.unique(np.concatenate(got, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    return run


def _exact(width: int, num: int, den: int):
    """Pairs (owner, other) whose sorted arrays reach the threshold.

    Rows come sorted by owner and slot, the owner's own text first.  Rows that repeat an id may differ in their texts: the
    digest tells which of them the class has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_owner, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            owner, slot, other, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("owner", "slot", "other", "key"))
            ok = np.zeros(batch.num_rows, dtype=bool)
            for a, b, flat, at in shingle_sets(batch.column("text"), width):
                digest = _digests(flat, at)
                for i in np.flatnonzero(digest == key[a:b]):
                    s, where = flat[at[i] : at[i + 1]], (owner[a + i], slot[a + i])
                    if not other[a + i]:
                        at_owner, mine = where, s.copy()
                    elif where == at_owner and len(s):
                        x, y = (s, mine) if len(s) < len(mine) else (mine, s)
                        both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                        ok[a + i] = den * both >= num * (len(x) + len(y) - both)
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("owner").filter(mask), batch.column("key").filter(mask)], names=["a", "b"])

    return run


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, threshold: tuple[int, int] = (3, 4), complete: bool = False) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, n_shingles, class_id, component) and verified links (a, b) between class ids.

    Links: pairs of classes whose Jaccard similarity is at least threshold[0] / threshold[1].  With `complete`, all of
    them; without, enough of them to connect whatever is connected (pairs that are connected anyway aren't looked at).
    A document without words, or with a null text, has n_shingles 0 and class and component null.  Repeated rows, and
    rows with a null id, keep their rows.  Extra columns are left out.  An empty table gives empty tables."""
    num, den = threshold
    spark = docs.sparkSession
    part = partitions(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    scan = saved(map_arrow(texts, _scan(width), "kind byte, doc_id long, mark long, n long, key long, bits binary"))
    rows = scan.where("kind = 0").select("doc_id", "mark", "n", "key", "bits")
    near = scan.where("kind = 1").select("key", "n").groupBy("key").agg(F.sum("n").alias("n"))
    thin = scan.where("kind = 2").select("key", "n").distinct().groupBy("key").agg((F.count("*") * SAMPLED).alias("n")).where(F.col("n") >= 4 * SAMPLED)
    often = near.union(thin).groupBy("key").agg(F.max("n").alias("n")).where(F.col("n") >= HOT_FROM).orderBy(F.desc("n"), "key").limit(HOT_KEPT).collect()
    hot = np.array([r.key for r in often], dtype=np.int64).view(np.uint64)
    order = np.argsort(hot)
    spread = np.maximum(1, -(-np.array([r.n for r in often], dtype=np.int64) // (4 * BLOCK)))
    hot_b = spark.sparkContext.broadcast((hot[order], spread[order]))
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * part, int(total * (den - num) / den * _POSTING_BYTES / BUCKET_BYTES))
    classes = rows.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("who"), F.first("bits").alias("bits"))
    classes = saved(classes.select("key", "n", F.col("who.doc_id").alias("rep"), F.col("who.mark").alias("mark"), "bits"))

    blocks = map_arrow(texts.select("text"), _postings(width, num, den, buckets, hot_b), "bucket int, block binary")
    found = saved(blocks.groupBy("bucket").applyInArrow(_lists(num, den, hot_b), "kind byte, a long, b long, n int"))

    sig = classes.select("key", "n", "bits")

    def signed(pairs: DataFrame) -> DataFrame:
        one = joined(saved(pairs), sig.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a")), "a", small=False)
        return one.join(sig.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b")), "b")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (owner, other) that reach the threshold: one shuffle of the texts that take part."""
        pairs = saved(pairs)
        many = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > SLOT).select("a", F.ceil(F.col("n") / SLOT).cast("long").alias("slots"))
        dealt = pairs.join(F.broadcast(many), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("slots", F.lit(1))).alias("slot"))
        sends = dealt.select(F.col("b").alias("key"), F.col("a").alias("owner"), "slot", F.lit(True).alias("other"))
        sends = sends.union(dealt.select(F.col("a").alias("key"), F.col("a").alias("owner"), "slot", F.lit(False)).distinct())
        sends = saved(sends.join(classes.select("key", "rep", F.col("mark").alias("rep_mark")), "key"))
        to = F.broadcast(sends) if sends.count() <= BROADCAST_IDS else sends
        sent = texts.join(to, texts.doc_id.eqNullSafe(to.rep) & (texts.mark == to.rep_mark)).select("owner", "slot", "other", "key", "text")
        sent = sent.repartition(part, "owner", "slot").sortWithinPartitions("owner", "slot", "other")
        return saved(map_arrow(sent, _exact(width, num, den), "a long, b long"))

    heads = found.where("kind = 2").select("a", "b", "n")
    chief = heads.groupBy("a").agg(F.min("b").alias("chief"))
    stars = joined(heads, chief, "a").where("b <> chief").select(F.col("chief").alias("a"), "b")
    shared = saved(found.where("kind IN (0, 3)").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("kind").alias("kind")))
    first = saved(shared.groupBy("b").agg(F.max(F.struct("n", "a")).alias("most")).select(F.col("most.a").alias("a"), "b").union(stars).distinct())
    links = verified(map_arrow(signed(first), _bounded(num, den), "a long, b long"))

    members = found.where("kind = 1").select(F.col("a").alias("list"), F.col("b").alias("key"), F.col("n").alias("home")).dropDuplicates(["list", "key"])
    twos = shared.where("kind = 3").select("a", "b").join(first, ["a", "b"], "left_anti")
    if complete:
        labels = None
        members = members.withColumn("comp", F.col("key"))
    else:
        labels = connected(links)
        twos = joined(saved(twos), labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
        twos = joined(saved(twos), labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
        members = joined(saved(members), labels.select(F.col("node").alias("key"), "label"), "key", "left").select("list", "key", "home", F.coalesce("label", "key").alias("comp"))
    members = saved(members)
    mixed = members.groupBy("list").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("list")
    members = saved(joined(members, saved(mixed), "list"))
    # the largest size band of a list tells into how many blocks its bands are cut
    cut = members.groupBy("list", "home").agg(F.count("*").alias("n")).groupBy("list").agg(F.max("n").alias("n")).where(F.col("n") > BLOCK).select("list", F.ceil(F.col("n") / BLOCK).cast("long").alias("cut"))
    tiles = joined(members, saved(cut), "list", "left").withColumn("blocks", F.coalesce("cut", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    tiles = tiles.withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.col("home") + F.col("shift")).withColumn("guest", F.col("shift") == 1)
    useful = tiles.groupBy("list", "band").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.min("guest").alias("bare")).where(~F.col("bare") & (F.col("least") != F.col("most"))).select("list", "band")
    pad = F.array_repeat(F.lit(2**63 - 1), FIRST_LISTS)
    few = members.groupBy("key").agg(F.slice(F.concat(F.array_sort(F.collect_set("list")), pad), 1, FIRST_LISTS).alias("few"))
    tiles = tiles.join(useful, ["list", "band"]).join(sig, "key").join(few, "key")
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    tiles = tiles.select("list", "band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "key", "n", "comp", "block", "guest", "bits", "few")
    tiles = tiles.repartition(part, "list", "band", "lo", "hi").sortWithinPartitions("list", "band", "lo", "hi")
    more = map_arrow(tiles, _tiles(num, den), "a long, b long").union(map_arrow(signed(twos), _bounded(num, den), "a long, b long").select(F.least("a", "b"), F.greatest("a", "b")))
    more = verified(more.distinct())

    links = links.union(more).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if complete:
        labels = connected(links)
    elif more.limit(1).count():
        labels = connected(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
    rep = classes.select("key", "rep")
    within = saved(joined(rep, labels.select(F.col("node").alias("key"), "label"), "key"))
    named = joined(within, within.groupBy("label").agg(F.min("rep").alias("component")), "label").select("key", "component")
    named = saved(joined(rep, named, "key", "left").select("key", F.col("rep").alias("class_id"), F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("component")).alias("component")))
    own = rows.select("doc_id", "n", "key")
    result = joined(own.where("n > 0"), named, "key").select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component")
    none = F.lit(None).cast("long")
    result = result.unionByName(own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), none.alias("class_id"), none.alias("component")))
    links = links.join(rep.select(F.col("key").alias("a"), F.col("rep").alias("x")), "a").join(rep.select(F.col("key").alias("b"), F.col("rep").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return result, links


def op1_ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included), class_id (the smallest doc_id with the same set).

    A document without shingles is linked with nothing: component_id is its own doc_id, class_id null.  In a component
    whose ids are all null, component_id is null."""
    members, _ = jaccard_join(docs)
    return members.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "class_id")


#: The same rows from plain strings: sets of joined words, overlaps by an equality join of shingles, components by the smallest id that links reach.
OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS digest FROM s GROUP BY doc_id
), c AS (SELECT doc_id, n, digest, min(doc_id) OVER (PARTITION BY digest, n) AS class_id FROM n
), cs AS (SELECT s.doc_id, g, n FROM s JOIN c ON s.doc_id = c.doc_id AND c.doc_id = c.class_id
), l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM cs a JOIN cs b ON a.g = b.g AND a.doc_id < b.doc_id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (SELECT x AS node, x AS seen FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.seen = e.x
), m AS (SELECT node, min(seen) AS low FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, CASE WHEN c.n IS NULL THEN d.doc_id ELSE least(coalesce(m.low, c.class_id), c.class_id) END AS component_id, c.class_id
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN m ON m.node = c.class_id
"""
