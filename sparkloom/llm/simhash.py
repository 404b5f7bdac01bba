"""SimHash near-dedup by Golay-code fuzzy hashing.

A fingerprint of 64 bits has segments A (23 bits), B (23) and C (18). The binary Golay code
decodes any 23 bits to one codeword within 3 errors. A segment's keys are the codewords of
itself and of its 23 one-bit neighbours: segments one bit apart share a key. Fingerprints at
most 2 bits apart spread these errors over three segments, so one of six keys is shared:
(A~, B), (A, B~), (B, C), (A, C), and, for an error in A and one in either half of B,
(A~, B low, C), (A~, B high, C), with ~ for a Golay key. Fingerprints that
share a key with another are candidates. Candidates are verified without forming pairs:
two fingerprints are at most 2 bits apart exactly if they share a point at most 1 bit from
both, and a point has at most 65 fingerprints. These links' components are the groups.

Defined results: a null, empty or wordless text has fingerprint 0, linked like any other;
equal fingerprints are one node, however many documents have it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, id_and_bytes, stage, texts_of
from .components import components

SEED = 42
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator of the (23, 12) Golay code.
GENERATOR = 0b110001110101
BITS_A, BITS_B, BITS_C = 23, 23, 18


def fingerprint(text: bytes, size: int = 3) -> int:
    """The SimHash of a text's word shingles, as a signed 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def syndromes(x: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials by the generator."""
    x = x.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        x ^= np.where((x >> bit) & 1, GENERATOR << (bit - 11), 0)
    return x


@cache
def leaders() -> np.ndarray:
    """The error of each of the 2048 syndromes: the code is perfect, so up to 3 errors have all of them."""
    errors = [0]
    for i in range(23):
        errors += [e ^ (1 << i) for e in errors if bin(e).count("1") < 3]
    table = np.zeros(2048, np.int64)
    errors = np.array(errors)
    table[syndromes(errors)] = errors
    return table


@cache
def steps() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome, what leads from a segment to the codewords of it and its one-bit neighbours; and how many there are."""
    units = np.concatenate([[0], 1 << np.arange(23)])
    to = units[None, :] ^ leaders()[np.arange(2048)[:, None] ^ syndromes(units)[None, :]]
    to.sort(axis=1)
    again = np.zeros_like(to, bool)
    again[:, 1:] = to[:, 1:] == to[:, :-1]
    order = np.argsort(again, axis=1, kind="stable")
    return np.take_along_axis(to, order, axis=1), (~again).sum(axis=1)


def golay_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the codeword indices (12 bits) of each segment's keys."""
    s = syndromes(segment)
    to, n = steps()
    row = np.repeat(np.arange(len(segment)), n[s])
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n[s]) - n[s], n[s])
    return row, (segment[row] ^ to[s[row], nth]) >> 11


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of fingerprints; the top 3 bits of a key hold its kind."""
    u = fp.view(np.uint64)
    a, b, c = (u & np.uint64(0x7FFFFF)).astype(np.int64), ((u >> np.uint64(23)) & np.uint64(0x7FFFFF)).astype(np.int64), (u >> np.uint64(46)).astype(np.int64)
    ra, ka = golay_keys(a)
    rb, kb = golay_keys(b)
    own = np.arange(len(fp))
    kinds = [(ra, ka << 23 | b[ra]), (rb, kb << 23 | a[rb]), (own, b << 18 | c), (own, a << 18 | c)]
    low, high = b & 0x7FF, b >> 11
    kinds += [(ra, (ka << 11 | low[ra]) << 18 | c[ra]), (ra, (ka << 12 | high[ra]) << 18 | c[ra])]
    return np.concatenate([r for r, _ in kinds]), np.concatenate([k | i << 60 for i, (_, k) in enumerate(kinds)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([fingerprint(t, size) for t in texts_of(b, "text")], pa.int64())], names=["doc_id", "fp"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def candidates(points: DataFrame) -> DataFrame:
    """The fingerprints that share a key with another; points: distinct (fp)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            row, key = keys(fp)
            yield pd.DataFrame({"key": key, "fp": fp[row]})

    keyed = points.mapInPandas(run, "key long, fp long")
    met = keyed.groupBy("key").count().where("count > 1").select("key")  # a fingerprint has a key once
    return keyed.join(met, "key").select("fp").distinct()


def links(found: DataFrame) -> DataFrame:
    """Edges (a, b) that hold together all fingerprints at most 2 bits apart: at each point, all to the least."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    at = found.withColumn("flip", F.explode(flips)).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    balls = at.groupBy("point").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return balls.select(F.array_min("all").alias("b"), F.explode("all").alias("a")).where("a != b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    marked = stage(fingerprints(docs, id_col, text_col, size), "simhash")
    points = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    found = components(links(candidates(points.select("fp"))))
    rooted = points.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stage(rooted.join(least, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
