"""Secret scans: fixed patterns, and values in a credential context judged by their guess cost.

The cost of a value is the least sum, over all ways to cut it into segments, of the bits to guess each segment: a
common word (by its rank, with its spelling), a date, a repeated character or group, a walk over the keyboard, or
brute force by character class; each further segment costs one bit.  Words are those that guessers try first, then the
most frequent words of the texts themselves (see fit_words()).  It is found by dynamic programming over the places where
segments begin, from the end of the value to its start, so that all values with one end are costed at once and the time
grows with the length of the text.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator, Mapping
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.frames import map_arrow, saved

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "guess")
#: An added value costs so many bits at least, and in the weaker contexts has so many characters.
MIN_BITS = 42.0
MIN_CHARS = 8

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|credentials?|auth(?:orization)?|bearer|token|(?:private|access|api|account|client)[_ -]?(?:key|secret|token))"
#: A name, prefixed or not, with an explicit sign after it: what follows is a value, whole in its quotes or up to white space.
EXPLICIT = re.compile(_NAMES + r"\b[\"']?\x20*(?:=>|:=|[:=])\x20*(?=[^\s:=])", re.ASCII | re.IGNORECASE)
#: A value in quotes, or what begins one without.
VALUE = re.compile(r"\"((?:[^\"\\\n]|\\.)++)\"|'((?:[^'\\\n]|\\.)++)'|`([^`\n]++)`|[\"'`]?(?=\S)")
_SPACE = re.compile(r"\s|\Z")
#: The password of an address that names its host.
LOGIN = re.compile(r"://[^\s:/@]*:([^\s/?#]+)@", re.ASCII)
#: Weaker contexts, whose values count only with a digit and two classes of characters.
CONTEXT = re.compile(rf"(?:\b{_NAMES}\b[\"']?\x20+(?:is\x20+)?[\"'`]?|://[^\s:/@]+:)([^\s\"'`,;<>|@]{{8,}})", re.ASCII | re.IGNORECASE)
_CLOSING = ".,:;!?)]}>\"'`"
_HINTS = ("pass", "pwd", "secret", "credential", "auth", "bearer", "token", "key", "://")

#: Words of the texts that follow WORDS in rank: those that make one in DICTIONARY of all words at least, and stand in more than one text.
DICTIONARY = 20_000
#: A quoted value that reads as a sentence (of five parts or more, most are words with a vowel) costs so many bits a character at least.
SENTENCE_BITS, SENTENCE_PARTS = 6.0, 5
_PART = re.compile(r"(?=[^aeiouyAEIOUY]*[aeiouyAEIOUY\u00C0-\uFFFF])[^\W\d_]+[.,;:!?]*")
#: A word of running text: lower case as a whole, between white space and marks.
_PLAIN = re.compile(r"(?<![^\s\"'(])[a-z]{3,16}(?![^\s.,;:!?)\"'])", re.ASCII)

#: Words by how early a guesser tries them.
WORDS = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login secret token test example changeme default "
    "iloveyou sunshine princess football baseball shadow superman batman trustno1 hello freedom whatever starwars "
    "user root guest system service account server public private access key api client database backup temp demo sample "
    "summer winter spring autumn january february march april may june july august september october november december "
    "monday tuesday friday sunday love money house green blue black white happy lucky power internet computer network "
    "the and for you with this that from have your value none null true false string placeholder insert here"
).split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST = 16
_LEET = str.maketrans("@4301!57$", "aaeoiists")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_KEYS = {c: (x + r * 0.5, r) for r, row in enumerate(_ROWS) for x, c in enumerate(row)}
_NEXT = {(a, b) for a, (x, r) in _KEYS.items() for b, (y, s) in _KEYS.items() if a != b and abs(x - y) <= 1 and abs(r - s) <= 1}
_YMD = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])", re.ASCII)
_DMY = re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d", re.ASCII)
_YEAR = re.compile(r"(?:19|20)\d\d", re.ASCII)
_SEGMENT = 1.0


#: A walk: its first key, and each further step.  A repeat: how often, beside its first period of at most PERIODS characters.
_START, _STEP, _TIMES = math.log2(47), 1.6, 5.0
PERIODS = 8
_DAY, _YEAR_BITS = math.log2(365 * 120), math.log2(120)


def _char_bits(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return math.log2(26)
    return math.log2(33)


def fit_words(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Ranks of WORDS and, after them, of the words of all texts that make one in DICTIONARY of them or more and stand in two texts or more, the most frequent first.

    The share is the same in a small table and in a large one of the same kind.  Tasks count the words of all their texts
    and hand on each count once; the driver gets DICTIONARY words at most.  Null and empty texts have no words; ties go by
    the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        texts: Counter[str] = Counter()

        def counts() -> pa.RecordBatch:
            # the row without a word has the sum of all
            return pa.RecordBatch.from_arrays([pa.array([None, *seen], pa.string()), pa.array([seen.total(), *seen.values()], pa.int64()), pa.array([2, *(texts[w] for w in seen)], pa.int64())], names=["word", "n", "texts"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    found = _PLAIN.findall(text)
                    seen.update(found)
                    texts.update(set(found))
            if len(seen) > 500_000:
                yield counts()
                seen.clear()
                texts.clear()
        yield counts()

    counts = map_arrow(docs.select(F.col(text_col).cast("string").alias("text")), run, "word string, n long, texts long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    counts = saved(counts.where("texts >= 2").drop("texts"))
    every = next((r.n for r in counts.where(F.col("word").isNull()).collect()), 0)
    ranks = dict(RANK)
    for r in counts.where(F.col("word").isNotNull() & (F.col("n") * DICTIONARY >= every)).orderBy(F.desc("n"), "word").limit(DICTIONARY).collect():
        ranks.setdefault(r.word, len(ranks) + 1)
    return ranks


#: What a character is, as the bits of a number: a digit, an ASCII letter, a letter, an upper-case one, a lower-case one.
_DIGIT, _ASCII, _ALPHA, _UPPER, _LOWER = 1, 2, 4, 8, 16


class _Cached(dict):
    """What a function of one character gives, kept by character."""

    def __init__(self, f):
        super().__init__()
        self.f = f

    def __missing__(self, c: str):
        out = self[c] = self.f(c)
        return out


_CLASS = _Cached(lambda c: _DIGIT * c.isdigit() + _ASCII * ("a" <= c <= "z" or "A" <= c <= "Z") + _ALPHA * c.isalpha() + _UPPER * c.isupper() + _LOWER * c.islower())
_FOLD = _Cached(lambda c: c.lower() if len(c.lower()) == 1 else c)
_BITS = tuple(math.log2(10) if k & _DIGIT else math.log2(26) if k & _ASCII else math.log2(33) for k in range(32))
_MIXED_BITS = tuple(b + bool(k & _ALPHA) for k, b in enumerate(_BITS))
_BESIDE = np.zeros((128, 128), dtype=bool)
for _a, _b in _NEXT:
    _BESIDE[ord(_a), ord(_b)] = True
_DATES = ((_YMD, _DAY), (_DMY, _DAY), (_YEAR, _YEAR_BITS))
_IS_UPPER, _IS_LOWER = (bytes(bool(k & x) for k in range(256)) for x in (_UPPER, _LOWER))
#: Values longer than this are looked through with arrays.
SHORT = 64
_NO_WORD = (-1, 0, 0.0)
_PERIODS_OF = tuple(tuple(p for p in range(1, PERIODS + 1) if k >> (p - 1) & 1) for k in range(1 << PERIODS))


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _run_lengths(flags: np.ndarray) -> np.ndarray:
    """At each place, how many flags in a row are set from there on."""
    n = len(flags)
    at = np.arange(n, dtype=np.int32)
    stop = np.minimum.accumulate(np.where(flags, np.int32(n), at)[::-1])[::-1]
    return stop - at


def _runs_of_long(value: str, lower: str) -> tuple[bytes, bytes]:
    """At each place, whether three keys or more follow each other, and the periods (as bits) of repeats that begin there."""
    n = len(value)
    codes, keys = _codes(value), np.minimum(_codes(lower), 127)
    walks = np.zeros(n, dtype=bool)
    walks[: n - 1] = _run_lengths(_BESIDE[keys[:-1], keys[1:]]) >= 2
    repeats = np.zeros(n, dtype=np.uint8)
    for p in range(1, min(PERIODS, n - 1) + 1):
        repeats[: n - p] |= (_run_lengths(codes[p:] == codes[:-p]) >= max(2, p)).astype(np.uint8) << np.uint8(p - 1)
    return walks.tobytes(), repeats.tobytes()


def _runs_of_short(value: str, lower: str) -> tuple[bytes, bytes]:
    """The same without the start-up of arrays."""
    n = len(value)
    beside = [(x, y) in _NEXT for x, y in zip(lower, lower[1:], strict=False)]
    walks = bytes([x and y for x, y in zip(beside, beside[1:], strict=False)] + [0] * min(n, 2))
    repeats = bytearray(n)
    for p in range(1, PERIODS + 1):
        run, least = 0, max(2, p)
        for i in range(n - p - 1, -1, -1):
            run = run + 1 if value[i] == value[i + p] else 0
            if run >= least:
                repeats[i] |= 1 << (p - 1)
    return walks, bytes(repeats)


class Guesser:
    """Costs of values for a dictionary of ranks.

    Segments: brute force, the bits of each character (and one for each letter of a value in mixed case); a word of the
    ranks, the bits of its rank (one more if not in lower case, two more with digits or signs for letters); a date or
    year; three keys or more of which each is beside the one before; a group of at most PERIODS characters that comes
    twice or more (a single one three times), in full or cut short at the end."""

    def __init__(self, ranks: Mapping[str, int] = RANK):
        self.ranks = ranks
        self._words = None

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "_words": None}

    def matches(self, s: str) -> Iterator[tuple[int, int, float]]:
        """(start, length, bits of the rank) of the words in `s`, the last start first."""
        if self._words is None:
            self._words = ahocorasick.Automaton()
            for w, r in self.ranks.items():
                if 2 <= len(w) <= LONGEST:
                    self._words.add_word(w[::-1], (len(w), math.log2(r)))
            self._words.make_automaton()
        n = len(s) - 1
        if len(self._words):
            for end, (length, bits) in self._words.iter(s[::-1]):
                yield n - end, length, bits

    def run(self, value: str) -> _Run:
        return _Run(self, value)

    def cost(self, value: str) -> float:
        return _Run(self, value).cost(0)


class _Run:
    """The costs of all values that end where `value` ends and begin within it."""

    def __init__(self, guesser: Guesser, value: str):
        self.guesser, self.value = guesser, value
        self.kinds = bytes(map(_CLASS.__getitem__, value))
        # a value that begins after the last upper-case or the last lower-case letter isn't in mixed case
        self.cut = min(self.kinds.translate(_IS_UPPER).rfind(1), self.kinds.translate(_IS_LOWER).rfind(1))
        self.made: dict[bool, tuple[int, array]] = {}

    def at_most(self, start: int) -> float:
        """What cost(start) is at most, told at a glance: brute force for a short value."""
        return math.inf if len(self.value) - start > SHORT else sum(map(_MIXED_BITS.__getitem__, self.kinds[start:]))

    def cost(self, start: int) -> float:
        """Bits of the cheapest segmentation of value[start:]; 0 for an empty one."""
        if start >= len(self.value):
            return 0.0
        mixed = start <= self.cut
        if mixed not in self.made or start < self.made[mixed][0]:
            self.made[mixed] = (start, self._suffixes(start, mixed))
        first, best = self.made[mixed]
        return best[start - first] - _SEGMENT

    def _suffixes(self, first: int, mixed: bool) -> array:
        """The cost (and a segment's bit) of value[i:] for each i from `first` on, each the least over all segments that may begin there; walks and repeats carry the best place to end from character to character."""
        value, kinds = self.value[first:], self.kinds[first:]
        n = len(value)
        lower = value.lower() if value.isascii() else "".join(map(_FOLD.__getitem__, value))
        plain = lower.translate(_LEET)
        bits = _MIXED_BITS if mixed else _BITS
        upto = array("d", accumulate(map(_BITS.__getitem__, kinds), initial=0.0))
        walks, repeats = _runs_of_long(value, lower) if n > SHORT else _runs_of_short(value, lower)
        words = self.guesser.matches(lower)
        leet = self.guesser.matches(plain) if plain != lower else iter(())
        word, other = next(words, _NO_WORD), next(leet, _NO_WORD)
        best = array("d", bytes(8 * (n + 1)))
        brute = walked = math.inf
        repeated, before = [math.inf] * (PERIODS + 1), 0
        for i in range(n - 1, -1, -1):
            kind = kinds[i]
            low = brute = bits[kind] + min(brute, best[i + 1] + _SEGMENT)
            if walks[i]:
                walked = min(walked, best[i + 3] + _STEP) + _STEP
                low = min(low, walked + _START + _SEGMENT)
            else:
                walked = math.inf
            repeat = repeats[i]
            if repeat:
                for p in _PERIODS_OF[repeat]:
                    last = best[i + p + max(2, p)]
                    if before >> (p - 1) & 1 and repeated[p] < last:
                        last = repeated[p]
                    repeated[p] = last
                    low = min(low, last + _SEGMENT + _TIMES + upto[i + p] - upto[i])
            before = repeat
            if kind & _DIGIT:
                for pattern, cost in _DATES:
                    if m := pattern.match(value, i):
                        low = min(low, best[m.end()] + _SEGMENT + cost)
            while word[0] == i:
                end = i + word[1]
                low = min(low, best[end] + _SEGMENT + word[2] + (value[i:end] != lower[i:end]))
                word = next(words, _NO_WORD)
            while other[0] == i:
                end = i + other[1]
                if plain[i:end] != lower[i:end]:
                    low = min(low, best[end] + _SEGMENT + other[2] + 2 + (value[i:end] != lower[i:end]))
                other = next(leet, _NO_WORD)
            best[i] = low
        return best


GUESSER = Guesser()


def _guesser(ranks: Mapping[str, int] | Guesser) -> Guesser:
    return ranks if isinstance(ranks, Guesser) else GUESSER if ranks is RANK else Guesser(ranks)


def guess_bits(value: str, ranks: Mapping[str, int] | Guesser = GUESSER) -> float:
    """Bits of the cheapest segmentation of the value (see Guesser); 0 for an empty one."""
    return _guesser(ranks).cost(value)


def _classes(value: str) -> int:
    return any(c.isdigit() for c in value) + any("a" <= c <= "z" for c in value) + any("A" <= c <= "Z" for c in value) + any(not c.isalnum() for c in value)


def _reads_as_sentence(value: str) -> bool:
    parts = value.split()
    return len(parts) >= SENTENCE_PARTS and 2 * sum(_PART.fullmatch(p) is not None for p in parts) > len(parts)


def _values(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, is in quotes) of the values in a credential context, by start, longer ones first."""
    values = set()
    run = trimmed = 0  # the end of the characters without white space that are being read, with and without closing marks
    for m in EXPLICIT.finditer(text):
        v = VALUE.match(text, m.end())
        if v is None:
            continue
        if v.lastindex:
            values.add((*v.span(v.lastindex), True))
            continue
        a = v.end()
        if a >= run:
            run = trimmed = _SPACE.search(text, a).start()
            while trimmed > a and text[trimmed - 1] in _CLOSING:
                trimmed -= 1
        if a < trimmed:
            values.add((a, trimmed, False))
    values |= {(*m.span(1), False) for m in LOGIN.finditer(text)}
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".,:;!?)")
        if len(value) >= MIN_CHARS and _classes(value) >= 2 and any(c.isdigit() for c in value):
            values.add((m.start(1), m.start(1) + len(value), False))
    return sorted(values, key=lambda v: (v[0], -v[1]))


def spans(text: str | None, ranks: Mapping[str, int] | Guesser = GUESSER) -> list[tuple[str, int, int, int, int, float | None]]:
    """(kind, start, end, value's start, value's end, bits of the value) by start, then kind; no spans for a null text.

    Base kinds as they match; kind "guess" for a value in a credential context that costs MIN_BITS and that no base value
    or guess before it holds whole.  After an explicit sign, and in an address with a host, the cost alone decides, but
    that a sentence in quotes has to cost SENTENCE_BITS a character; after a name and a space a value also has MIN_CHARS,
    two classes of characters and a digit, and ends at ,;<>|@ or a quote.  Only values in a credential context have bits.
    Values that end at one place are costed together, so that a text takes time in proportion to its length."""
    if not text:
        return []
    guesser = _guesser(ranks)
    found = []
    lower = text.lower()
    if "password" in lower or "passwd" in lower or "secret" in lower or "token" in lower or "api" in lower:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                found.append(("assign", m.start(), m.end(), m.start(2), m.end(2), guesser.cost(m[2])))
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start(), m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end(), m.start(), m.end(), None) for m in HEX.finditer(text)]
    if any(h in lower for h in _HINTS):
        base = sorted((s[3], s[4]) for s in found)
        runs: dict[int, tuple[int, _Run]] = {}  # by their ends: where they begin, and their costs
        end = k = 0
        for a, b, quoted in _values(text):
            while k < len(base) and base[k][1] <= a:
                k += 1
            if b <= end or (k < len(base) and base[k][0] <= a and b <= base[k][1]):
                continue
            if b not in runs:
                runs = {e: r for e, r in runs.items() if e > a} | {b: (a, guesser.run(text[a:b]))}
            first, run = runs[b]
            least = max(MIN_BITS, SENTENCE_BITS * (b - a)) if quoted and _reads_as_sentence(text[a:b]) else MIN_BITS
            if run.at_most(a - first) >= least and (bits := run.cost(a - first)) >= least:
                found.append(("guess", a, b, a, b, bits))
                end = b
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPAN = "array<struct<kind:string,start:long,end:long,value_start:long,value_end:long,bits:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("value_end", pa.int64()), ("bits", pa.float64())]))


def _struct(s: tuple) -> dict:
    return dict(zip(("kind", "start", "end", "value_start", "value_end", "bits"), s, strict=True))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and its secrets (see spans()), positions in code points; one row for every row, null and repeated ids included."""
    shared = docs.sparkSession.sparkContext.broadcast(Guesser(fit_words(docs, text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[_struct(s) for s in spans(t, shared.value)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPAN_TYPE)], names=["doc_id", "secrets"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, f"doc_id long, secrets {_SPAN}")


def redacted(text: str | None, marks: dict[str, str] | None = None, ranks: Mapping[str, int] | Guesser = GUESSER) -> str | None:
    """The text with each secret value (overlapping ones as one) replaced by a mark of its first kind."""
    if not text or not (found := spans(text, ranks)):
        return text
    out, at, last = [], 0, -1
    for kind, _, _, a, b, _ in sorted(found, key=lambda s: (s[3], KINDS.index(s[0]))):
        if a >= last:
            out += [text[at:a], (marks or {}).get(kind, f"[{kind}]")]
            at = last = b
        elif b > last:
            at = last = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows and columns of `docs`, with the secrets in the text replaced; with `length_col`, its code points counted anew where they were given."""
    shared = docs.sparkSession.sparkContext.broadcast(Guesser(fit_words(docs, text_col)))
    place = docs.columns.index(text_col)
    counted = docs.columns.index(length_col) if length_col and length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redacted(t, ranks=shared.value) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            if counted is not None:
                was = columns[counted].to_pylist()
                columns[counted] = pa.array([None if n is None else len(t or "") for n, t in zip(was, texts, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_arrow(docs, run, docs.schema)


def op3_secret_scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans; also n_guess and the bits of its hardest value (null without one)."""
    found = secret_spans(docs)
    named = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(named(F.filter("secrets", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"), named(F.col("secrets")).alias("spans"), F.array_max(F.transform("secrets", lambda s: s["bits"])).alias("max_bits"))
