"""Exact dedup: a minimal perfect hash over the distinct digests of history.

History (the rows below a cut of the ids) is reduced to distinct digests. They are
dealt over buckets by hash, and each bucket gets a minimal perfect hash: n slots for n
digests, each slot with the full digest, the winner's locator (id and row) and the count. The
other rows' distinct digests look their slot up; equality of all 32 bytes decides.
Members are repeats of history; the rest group among themselves.

Defined results: a null text is empty; a null id is never smallest while its group has
another; one row of a group stays, also where rows share the smallest id or all ids are null;
ids of any size are kept exactly; an empty table gives no rows; columns beside id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import first_of, keep_rows, key_of, stage

#: Digests in a bucket of the index: about a megabyte.
BUCKET_DIGESTS = 20_000
#: A digest's winner: whether it lacks an id, the id (0 without one) and the row.
WINNER = ("none", "winner", "row")
COUNTED = ("bucket", "digest", *WINNER, "n")
INDEX = "bucket int, seeds binary, digests binary, nones binary, winners binary, rows binary, counts binary"
GROUPS = "digest binary, keep_id long, keep_row long, group_size long"
MANY = 64  # displacements tried before a group's slots are taken one by one


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, name, digest): row numbers hold once this is written."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), key_of(F.col(text_col)).alias("name"), F.unhex(F.sha2(normal(F.col(text_col)), 256)).alias("digest"))


def words(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three hashes of each 32-byte digest: the group, the first slot and an odd step."""
    w = np.ascontiguousarray(block).view("<u8")
    return w[:, 1], w[:, 2], w[:, 3] | np.uint64(1)


def place(first: np.ndarray, step: np.ndarray, d: np.ndarray | int, n: int) -> np.ndarray:
    mixed = first + step * np.uint64(d) if np.isscalar(d) else first + step * d
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def build(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements by group, and the slot of each digest; slots are 0 to n - 1, each used once.

    Groups are placed largest first, each by the first displacement that finds free slots; a
    group of one takes a free slot, which it keeps as -1 - slot. A group that finds none among
    its displacements starts the bucket anew with more groups.
    """
    n = len(block)
    m = max(1, n // 3)
    while True:
        group, first, step = words(block)
        group = (group % np.uint64(m)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[order], np.arange(m + 1))
        found = placed(order, bounds, first, step, n)
        if found:
            return found
        m = 2 * m + 1


def placed(order: np.ndarray, bounds: np.ndarray, first: np.ndarray, step: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray] | None:
    sizes = np.diff(bounds)
    seeds, slots, taken = np.zeros(len(sizes), np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    singles = []
    for g in np.argsort(-sizes, kind="stable"):
        k = sizes[g]
        if k == 0:
            break
        who = order[bounds[g] : bounds[g + 1]]
        if k == 1:
            singles.append((g, who[0]))
            continue
        for d in range(MANY * n + 10_000):
            at = place(first[who], step[who], d, n)
            if not taken[at].any() and len(np.unique(at)) == k:
                break
        else:
            return None
        taken[at] = True
        slots[who], seeds[g] = at, d
    for (g, who), at in zip(singles, np.flatnonzero(~taken)):
        slots[who], seeds[g] = at, -1 - at
    return seeds, slots


def find(seeds: np.ndarray, n: int, block: np.ndarray) -> np.ndarray:
    """The only slot where each digest can be."""
    group, first, step = words(block)
    d = seeds[(group % np.uint64(len(seeds))).astype(np.int64)]
    return np.where(d < 0, -1 - d, place(first, step, np.where(d < 0, 0, d).astype(np.uint64), n))


def as_block(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def index_bucket(table: pa.Table) -> pa.Table:
    block = as_block(table.column("digest"))
    seeds, slots = build(block)
    by = np.argsort(slots)
    packed = [np.ascontiguousarray(x[by]).tobytes() for x in (block, *(numbers(table, c) for c in (*WINNER, "n")))]
    return pa.table({"bucket": table.column("bucket").slice(0, 1), **{k: pa.array([x], pa.binary()) for k, x in zip(("seeds", "digests", "nones", "winners", "rows", "counts"), (seeds.tobytes(), *packed))}})


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """history: counted(), distinct digests. One row for each bucket that has digests."""
    return history.withColumn("bucket", bucket(buckets)).select(*COUNTED).groupBy("bucket").applyInArrow(index_bucket, INDEX)


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def look_up(index: pa.Table, batch: pa.Table) -> pa.Table:
    """All groups of a bucket: history's slots with the batch's repeats counted, then the batch's own."""
    stored, held = np.zeros((0, 32), np.uint8), [np.zeros(0, np.int64)] * 4
    if index.num_rows:
        row = index.to_pylist()[0]
        stored = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        held = [np.frombuffer(row[k], np.int64).copy() for k in ("nones", "winners", "rows", "counts")]
    own = [numbers(batch, c) for c in (*WINNER, "n")]
    block, new = as_block(batch.column("digest")), np.ones(batch.num_rows, bool)
    if len(block) and len(stored):
        at = find(np.frombuffer(row["seeds"], np.int64), len(stored), block)
        same = (stored[at] == block).all(axis=1)
        held[3][at[same]] += own[3][same]
        new = ~same
    none, winner, kept_row, n = (np.concatenate([h, o[new]]) for h, o in zip(held, own))
    digest = [x.tobytes() for x in stored] + [x.tobytes() for x in block[new]]
    return pa.table({"digest": pa.array(digest, pa.binary()), "keep_id": pa.array(winner, mask=none.astype(bool)), "keep_row": pa.array(kept_row), "group_size": pa.array(n)})


def counted(marked: DataFrame) -> DataFrame:
    """(digest, none, winner, row, n) of distinct digests."""
    g = marked.groupBy("digest").agg(first_of().alias("w"), F.count(F.lit(1)).alias("n"))
    return g.select("digest", "w.none", F.coalesce("w.doc_id", F.lit(0)).alias("winner"), "w.row", "n")


def groups_of(marked: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) of staged rows (row, doc_id, digest)."""
    low, high, rows = marked.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    cut = (low + high) // 2 + 1 if low is not None else 0
    buckets = max(1, -(-rows // BUCKET_DIGESTS))
    old = F.coalesce(F.col("doc_id") < cut, F.lit(False))
    index = build_index(counted(marked.where(old)), buckets)
    batch = counted(marked.where(~old)).withColumn("bucket", bucket(buckets)).select(*COUNTED)
    return index.groupBy("bucket").cogroup(batch.groupBy("bucket")).applyInArrow(look_up, GROUPS)


def decided(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, name, digest, keep_id, group_size, kept."""
    marked = stage(digests(docs, id_col, text_col), "digests")
    groups = stage(groups_of(marked), "groups")
    return marked.join(groups, "digest").withColumn("kept", F.col("row") == F.col("keep_row"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return decided(docs, id_col, text_col).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group of equal texts, with their columns."""
    return keep_rows(docs, stage(decided(docs).select("doc_id", "name", "kept"), "decided"))
