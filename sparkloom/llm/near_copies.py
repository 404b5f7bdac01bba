"""Near copies by exact Jaccard similarity of word shingles; op7's Golay-code fuzzy hashing and MinHash bands name the candidates.

A text is the set of its 5-word shingles (ASCII lower case; fewer words are one shingle), as
64-bit hashes. Equal sets are one node. The groups of op7 (3-word fingerprints that links of at most 2 bits
connect) are the first keys. Few copies that differ in a word here and there are that close, so BANDS
more keys of ROWS minima each follow: a pair of similarity 0.8 shares none with probability (1 - 0.8^5)^24 = 7e-5.
A candidate pair is a link if its sets' similarity, counted and not estimated, is at least LEAST.

Sets that share a key are compared in blocks of at most BLOCK sets and BLOCK_BYTES, by products
of the blocks' set-by-shingle matrices, and a block gives only the links that join what was not
connected yet: no row is made of a pair. Rounds come first in which each set stands only in the
largest of its keys; sets that are connected by then need no more comparison, and in the rest of
a key's sets each block that is not wholly of the key's largest component meets all blocks. No group is capped.

Defined results: null, empty and wordless texts are copies of each other; of a group one row stays,
that with the smallest id (a null id only where all are), and of equal ids one row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import arrow_rows, bounded, first_of, id_and_bytes, keep_rows, key_of, let_go, stage, texts_of
from .components import components

SEED, SIZE, LEAST = 42, 5, 0.8
BANDS, ROWS = 24, 5
#: Sets that are compared at once, and their bytes.
BLOCK, BLOCK_BYTES, COLUMNS = 512, 8 << 20, 8192


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes of the word shingles, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    found = map(b" ".join, zip(*(words[i:] for i in range(SIZE)))) if len(words) >= SIZE else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64))


def node(own: np.ndarray) -> int:
    """The name of a set, as a signed 64-bit integer."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
    return made[0] | np.uint64(1), made[1]


def band_keys(own: np.ndarray) -> list[int]:
    """A key for each band."""
    a, b = _permutations()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 4096):
        least = np.minimum(least, (own[None, i : i + 4096] * a + b).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return [int(np.uint64(xxhash.xxh64_intdigest(r.tobytes(), k)).view(np.int64)) for k, r in enumerate(rows)]


def marked(docs: DataFrame) -> DataFrame:
    """(row, doc_id, name, fp, keys, print): the node, band keys and op7's fingerprint of each document; row numbers hold once this is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in arrow_rows(batches):
            texts = texts_of(b, "text")
            sets = list(map(shingles, texts))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("name"), pa.array(map(node, sets), pa.int64()), pa.array(map(band_keys, sets), pa.list_(pa.int64())), pa.array(map(simhash.fingerprint, texts), pa.int64())], names=["row", "doc_id", "name", "fp", "keys", "print"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), key_of(F.col("text")).alias("name"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, name struct<a:long,b:long>, fp long, keys array<long>, print long")


def fuzzy(prints: DataFrame) -> DataFrame:
    """(key, fp): op7's groups, connected by fingerprints at most 2 bits apart, that have several sets; prints: staged, distinct (fp, print)."""
    found = components(simhash.links(simhash.candidates(prints.select(F.col("print").alias("fp")).distinct())))
    found = found.select(F.col("node").alias("print"), F.col("root").alias("_to"))
    of = stage(prints.join(found, "print", "left").select("fp", F.coalesce("_to", "print").alias("of")).distinct(), "fuzzy")
    several = of.groupBy("of").count().where("count > 1").select("of")
    return of.join(several, "of").select(F.xxhash64(F.lit("fuzzy"), "of").alias("key"), "fp")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, own): the wanted shingle sets; wanted: staged (doc_id, fp), a document that has each."""
    ids = bounded(stage(wanted.select("doc_id").distinct(), "sampled"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in arrow_rows(batches):
            sets = [shingles(t) for t in texts_of(b, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(map(node, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "own"])

    few = id_and_bytes(docs)
    few = few.join(ids, few["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    return few.mapInArrow(run, "fp long, own binary").join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])


def alike(sets: list[np.ndarray]) -> np.ndarray:
    """Which sets are similar, as a square matrix."""
    size = np.array([len(s) for s in sets], np.float64)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    met = np.bincount(column) > 1  # a shingle of one set is in no intersection
    keep = met[column]
    row, column = row[keep], (np.cumsum(met) - 1)[column[keep]]
    both = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[row[a:b], column[a:b] - lo] = 1
        both += x @ x.T
    union = size[:, None] + size[None, :] - both
    return np.where(union > 0, both >= LEAST * union - 1e-9, True)


def joining(similar: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Similar pairs of different roots that, with the roots, connect all that the similar pairs connect."""
    step = similar | (root[:, None] == root[None, :])
    left, out = np.ones(len(root), bool), []
    for start in range(len(root)):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            at = todo.pop()
            to = np.flatnonzero(step[at] & left)
            left[to] = False
            out += [(at, int(x)) for x in to if root[at] != root[x]]
            todo += to.tolist()
    return out


def compared(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect the similar sets of each key; members: (key, fp, root)."""
    spread = stage(members.join(sets, "fp").select("key", "fp", "root", "own", F.xxhash64("fp").alias("h"), (F.octet_length("own") + 64).alias("bytes")), "members")
    part = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES))
    roots = spread.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size"))
    top = roots.groupBy("key").agg(F.max(F.struct("n", "root", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    plan = top.select("key", F.col("top.root").alias("most"), part(F.col("n"), F.col("size")).alias("blocks"), part(F.col("top.n"), F.col("top.size")).alias("settled"), F.greatest(F.lit(1), part(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size"))).alias("open"))
    one, big = F.col("blocks") <= 1, F.col("root") == F.col("most")
    block = F.when(one, F.lit(0)).when(big, F.pmod("h", "settled")).otherwise(F.col("settled") + F.pmod("h", "open")).cast("int")
    first = F.when(one, F.lit(0)).otherwise(F.col("settled")).cast("int")  # the first block that meets others
    last = F.when(one, F.lit(0)).otherwise(F.col("settled") + F.col("open") - 1).cast("int")
    dealt = spread.join(plan, "key").select("key", "fp", "root", "own", block.alias("x"), first.alias("lo"), last.alias("hi"))
    up = F.transform(F.sequence(F.greatest("x", "lo"), F.col("hi")), lambda j: F.struct(F.col("x").alias("i"), j.alias("j")))
    down = F.when(F.col("x") > 0, F.transform(F.sequence(F.lit(0), F.col("x") - 1), lambda i: F.struct(i.alias("i"), F.col("x").alias("j"))))
    pairs = F.when(F.col("x") >= F.col("lo"), F.concat(up, F.coalesce(down, F.array().cast("array<struct<i:int,j:int>>")))).otherwise(up)

    def links_of(table: pa.Table) -> pa.Table:
        fp, root = table.column("fp").to_numpy(), table.column("root").to_numpy()
        found = []
        if len(fp) > 1 and (root != root[0]).any():
            found = joining(alike([np.frombuffer(x, np.uint64) for x in table.column("own").to_pylist()]), root)
        return pa.table({"a": pa.array([int(fp[i]) for i, _ in found], pa.int64()), "b": pa.array([int(fp[j]) for _, j in found], pa.int64())})

    each = dealt.withColumn("p", F.explode(pairs)).select("key", "p.i", "p.j", "fp", "root", "own")
    return each.groupBy("key", "i", "j").applyInArrow(links_of, "a long, b long")


def links(keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all similar sets that share a key; keyed: staged, distinct (key, fp)."""
    edges = keyed.sparkSession.createDataFrame([], "a long, b long")
    now, before = stage(keyed.withColumn("root", F.col("fp")), "open"), None
    while True:
        # keys whose sets are one component have nothing to say, and keys of equal sets say the same
        each = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("same")).where("lo != hi")
        left = each.groupBy("n", "same").agg(F.min("key").alias("key")).select("key", "n")
        now = stage(now.join(left, "key").select("key", "fp", "root", "n"), "open")
        rows, points = now.agg(F.count(F.lit(1)), F.countDistinct("fp")).first()
        if not rows:
            return edges
        last = before is not None and (rows <= 2 * points or 2 * rows > before)
        chosen = now
        if not last:
            best = now.groupBy("fp").agg(F.max(F.struct("n", "key")).alias("b")).select("fp", F.col("b.key").alias("key"))
            chosen = now.join(best, ["fp", "key"])
        edges = stage(edges.unionByName(compared(chosen.select("key", "fp", "root"), sets)), "links")
        if last:
            return edges
        roots = components(edges).withColumnRenamed("node", "fp").withColumnRenamed("root", "_to")
        now = stage(now.select("key", "fp").join(roots, "fp", "left").select("key", "fp", F.coalesce("_to", "fp").alias("root")), "open")
        before = rows


def decided(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, name, component_id, kept."""
    rows = stage(marked(docs), "minhash")
    points = stage(rows.groupBy("fp").agg(first_of().alias("first"), F.first("keys").alias("keys")), "sets")
    keyed = points.select("fp", F.explode("keys").alias("key"))
    met = keyed.groupBy("key").count().where("count > 1").select("key")  # a set has a key once
    near = fuzzy(stage(rows.select("fp", "print").distinct(), "prints"))
    keyed = stage(keyed.join(met, "key").select("key", "fp").unionByName(near), "keyed")
    some = stage(points.join(keyed.select("fp").distinct(), "fp", "left_semi").select("first.doc_id", "fp"), "wanted")
    found = components(links(keyed, stage(sets_of(docs, some), "shingles")))
    rooted = stage(points.select("fp", "first").join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    named = stage(rooted.join(least, "root").select("fp", "least"), "named")
    return rows.select("row", "doc_id", "name", "fp").join(named, "fp").select("doc_id", "name", F.col("least.doc_id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("kept"))


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, component_id, the least id of the documents connected by near copies."""
    return decided(docs).select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, that with the smallest id, with its columns."""
    return keep_rows(docs, stage(decided(docs).select("doc_id", "name", "kept"), "decided"))
