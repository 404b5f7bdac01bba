"""Quality rules: plain counts, then a hashed n-gram log-likelihood ratio.

Words and word pairs, lower-cased in ASCII, are hashed to BUCKETS buckets. Two multinomials over the buckets are
counted: the raw corpus over all documents, the trusted target over all those with label quality
1; both are smoothed by adding SMOOTH of a count to each bucket. A text's value is the sum of
log target / raw over its n-grams, divided by their number. A document is kept if it passes
the base rules and its value is at least THRESHOLD, always, without any draw.

Defined results: a null text is empty; a text without words fails the base rules; without any
trusted document every value is 0 and the base rules decide; null labels are not trusted;
repeated rows each count and each get a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, id_and_bytes, kept, stage, texts_of

BUCKETS = 1 << 15
SMOOTH = 0.5
THRESHOLD = -0.15
#: Trusted ids that are broadcast at once, 8 bytes each; more of them take further passes over the documents.
MAX_TRUSTED = 500_000
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
CACHE_WORDS = 500_000
TAILS = bytes(range(0x80, 0xC0))


class Hashes(dict):
    """A word's hash, kept."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


_HASHES = kept(Hashes())


def grams(words: list[bytes]) -> np.ndarray:
    """Buckets of the words and of the pairs."""
    if len(_HASHES) >= CACHE_WORDS:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    pair ^= pair >> np.uint64(31)
    pair *= np.uint64(0xBF58476D1CE4E5B9)
    return (np.concatenate([h, pair]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of WINDOW words found more than once; exact, by doubling ranks."""
    n = len(words)
    if n <= WINDOW:
        return 0
    first: dict[bytes, int] = {}
    rank = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, n)
    step = 1
    while step < WINDOW:
        pair = rank[:-step] * (rank.max() + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        step *= 2
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def base(text: bytes) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """The words, and the number of words, their characters, symbols, repeated lines and repeated words."""
    words = text.split()
    chars = len(b"".join(words).translate(None, TAILS))
    symbols = len(text.translate(None, NOT_SYMBOLS))
    return words, (len(words), chars, symbols, repeated_lines(text), repeated_words(words))


NOT_SYMBOLS = bytes(b for b in range(256) if b not in b"#*$%&|<>")


def counts(docs: DataFrame, trusted: list[DataFrame]) -> np.ndarray:
    """Two rows of n-gram counts by bucket: the raw corpus and the trusted target. BUCKETS long, whatever the corpus.

    trusted: parts of the trusted ids. The first part's pass counts the raw corpus too, each further one its documents alone.
    """
    return sum(_counted(docs, part, i == 0) for i, part in enumerate(trusted))


def _counted(docs: DataFrame, trusted: DataFrame, raw: bool) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in arrow_rows(batches):
            for text, good in zip(texts_of(b, "text"), b.column("good").to_pylist()):
                n = np.bincount(grams(text.lower().split()), minlength=BUCKETS)
                if raw:
                    total[0] += n
                if good:
                    total[1] += n
        found = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[0][found]), pa.array(total[1][found])], names=["bucket", "raw", "good"])

    marked = docs.join(trusted, "doc_id", "left" if raw else "inner").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    found = marked.mapInArrow(run, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    out = np.zeros((2, BUCKETS), np.int64)
    out[:, found["bucket"].to_numpy(np.int64)] = found[["raw", "good"]].to_numpy(np.int64).T
    return out


def ratios(n: np.ndarray) -> np.ndarray:
    """Log target / raw by bucket; 0 without a target."""
    if not n[1].sum():
        return np.zeros(BUCKETS)
    p = (n + SMOOTH) / (n.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)
    return np.log(p[1]) - np.log(p[0])


def trusted_of(labels: DataFrame) -> list[DataFrame]:
    """All trusted ids, counted and parted by hash so that no part has many more than MAX_TRUSTED; each part is broadcast."""
    ids = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = stage(ids, "trusted")
    parts = max(1, -(-ids.count() // MAX_TRUSTED))
    return [F.broadcast(ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == i).withColumn("good", F.lit(True))) for i in range(parts)]


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept."""
    rows = id_and_bytes(docs, id_col, text_col)
    ratio = ratios(counts(rows, trusted_of(labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches):
            out: list[list] = [[], [], [], [], [], []]
            for text in texts_of(b, "text"):
                words, five = base(text)
                g = grams(text.lower().split())
                for column, value in zip(out, (*five, float(ratio[g].sum() / len(g)) if len(g) else 0.0)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:5]), pa.array(out[5], pa.float64())], names=["doc_id", *FIVE, "llr"])

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in FIVE) + ", llr double")
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


FIVE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
