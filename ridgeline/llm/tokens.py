"""Token counts by a map-side lookup in two tiers, without a shuffle of pre-tokens.

A text of a sentencepiece BPE vocabulary in which the space mark only leads a piece falls into pre-tokens that are
encoded independently: a run of spaces with the word after it, and a line feed (a character outside the vocabulary,
hence a byte token of its own) with the word after it.  Tier one is a broadcast table of frequent pre-tokens and their
lengths; what misses it is encoded once per worker and kept in a bounded cache there.  Frequencies are those of all
texts: each task keeps a bounded summary of counts, and summaries are merged MERGED at a time in rounds over neighbouring
partitions, so no pre-token is shuffled and the driver gets MERGED summaries at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.frames import map_arrow, saved

#: Entries of the frequent table, of the summary that a task hands on, and of the counts that it holds, at most.
TABLE_ENTRIES = 1 << 16
SUMMARY_ENTRIES = 1 << 14
HELD_ENTRIES = 1 << 18
#: Summaries that one task (at the end: the driver) merges.
MERGED = 64
#: Entries of a worker's cache, at most; longer pre-tokens aren't kept.
CACHE_ENTRIES = 1 << 18
CACHED_CHARS = 200
SPACE_MARK = "▁"


class PieceCounter(dict):
    """Pre-token -> number of pieces; encodes what it doesn't have."""

    def __init__(self, model: bytes, frequent: dict[str, int]):
        import sentencepiece

        super().__init__(frequent)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.frequent = frequent
        self.own_line = len(self.processor.encode("\n")) == 2
        self.alone = self._encoded("a")

    def _encoded(self, text: str) -> int:
        return len(self.processor.encode(text, num_threads=1) if not isinstance(text, str) else self.processor.encode(text))

    def __missing__(self, word: str) -> int:
        n = self._encoded(word) - (word[0] == "\n")
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n

    def spaces(self, m: int) -> int:
        """Pieces of a run of m space marks that no word follows."""
        return self._encoded("a" + " " * m) - self.alone

    def split(self, text: str) -> list[str]:
        if SPACE_MARK in text:
            text = text.replace(SPACE_MARK, " ")
        if self.own_line and "\n" in text:
            text = text.replace("\n", " \n")
        return text.split(" ")

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = self.split(text)
        if "" not in words:
            return sum(map(self.__getitem__, words))
        total = gap = 0
        for w in words:
            if not w:
                gap += 1
            elif self.own_line and w[0] == "\n":
                total += (self.spaces(gap) if gap else 0) + self[w]
                gap = 0
            else:
                total += self[" " * gap + w]
                gap = 0
        return total + (self.spaces(gap) if gap else 0)


def splits_at_spaces(model: bytes) -> bool:
    """Whether no piece of the vocabulary has a space mark after another character."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    return not any(SPACE_MARK in p.id_to_piece(i).lstrip(SPACE_MARK) for i in range(p.get_piece_size()))


def _thinned(seen: Counter, most: int) -> Counter:
    return seen if len(seen) <= most else Counter(dict(seen.most_common(most)))


def _summary(seen: Counter) -> pa.RecordBatch:
    top = seen.most_common(SUMMARY_ENTRIES)
    return pa.RecordBatch.from_arrays([pa.array([[w for w, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], names=["words", "counts"])


def frequent_lengths(texts: DataFrame, model: bytes) -> dict[str, int]:
    """The most frequent pre-tokens of all texts, with their lengths.

    A task drops its rarest pre-tokens where it holds more than HELD_ENTRIES, so a count may be too low; no document and
    no partition is left out."""
    shape = "words array<string>, counts array<long>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = PieceCounter(model, {}), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(w for w in counter.split(text) if 0 < len(w) <= CACHED_CHARS)
                if len(seen) > HELD_ENTRIES:
                    seen = _thinned(seen, HELD_ENTRIES // 2)
        if seen:
            yield _summary(seen)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update(dict(zip(words, counts, strict=True)))
                seen = _thinned(seen, HELD_ENTRIES)
        if seen:
            yield _summary(seen)

    summaries = saved(map_arrow(texts, count, shape))
    while (n := summaries.rdd.getNumPartitions()) > MERGED:
        summaries = saved(map_arrow(summaries.coalesce(-(-n // MERGED)), merge, shape))
    every = Counter()
    for r in summaries.collect():
        every.update(dict(zip(r.words, r.counts, strict=True)))
    counter = PieceCounter(model, {})
    return {w: counter[w] for w, _ in every.most_common(TABLE_ENTRIES)}


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit); a null text counts as empty.

    Rows with null or repeated ids stay as they are; extra columns are left out."""
    with open(model_path, "rb") as f:
        model = f.read()
    whole = not splits_at_spaces(model)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((model, {} if whole else frequent_lengths(texts, model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(*shared.value)
        count = counter._encoded if whole else counter.count
        for batch in batches:
            n = [count(t) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(own, run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """token_counts() with the vocabulary of piece_bpe_32k.model and a limit of 4096 tokens."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts(docs, model_path)
