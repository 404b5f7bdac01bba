"""Packing: shortest-pack-first over the length histogram.

Documents are cut into full pieces of the sequence length, which fill sequences alone, and
a last shorter piece. The histogram of the last pieces' lengths (at most as many entries as
a sequence has tokens) is packed on the driver: lengths are placed longest first, all of a
length at once, each into the packs with least in them that have room, counting packs of
equal content as one pattern with a count. Patterns then join back to the pieces by rank:
the r-th piece of a length goes to the r-th place that the patterns have for that length.

Defined results: a null text is empty and has only its end id; ties within a length go by
rank over hashed buckets of row numbers, so repeated rows and ids are told apart; an empty
table gives no rows; columns beside id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, buckets_for, id_and_bytes, numbered, stage
from .words import encoder

LENGTH = 4096
PIECES = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, end_id: int, limit: int, id_col: str, text_col: str) -> DataFrame:
    """Tokenise, append the end id and cut into pieces of at most limit tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in arrow_rows(batches):
            ids, n = e.flat([(x or b"").decode() for x in b.column("text").to_pylist()], end_id)
            raw = memoryview(ids.astype("<u4")).cast("B")
            cuts = -(-n // limit)
            of = np.repeat(np.arange(len(n)), cuts)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            lo = nth * limit
            length = np.minimum(limit, n[of] - lo)
            at = (np.cumsum(n) - n)[of] + lo
            crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
            of_row = pa.array(of)
            yield pa.RecordBatch.from_arrays([b.column("row").take(of_row), b.column("doc_id").take(of_row), pa.array(lo), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[of])], names=["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return id_and_bytes(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, PIECES)


def shortest_pack_first(histogram: dict[int, int], limit: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(count, [(length, how many in each pack), ...]) patterns; lengths are placed longest first."""
    by_fill: dict[int, dict[tuple[int, ...], int]] = {}

    def add(pack: tuple[int, ...], fill: int, n: int) -> None:
        at = by_fill.setdefault(fill, {})
        at[pack] = at.get(pack, 0) + n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed: list[tuple[tuple[int, ...], int, int]] = []
        for fill in sorted(f for f in by_fill if f + length <= limit):
            packs = by_fill[fill]
            for pack in sorted(packs):
                if not left:
                    break
                each = min((limit - fill) // length, -(-left // packs[pack]))
                used = min(packs[pack], left // each)
                if not used:
                    each, used = left, 1
                packs[pack] -= used
                if not packs[pack]:
                    del packs[pack]
                placed.append(((*pack, *[length] * each), fill + each * length, used))
                left -= used * each
            if not packs:
                del by_fill[fill]
            if not left:
                break
        if left:
            each = limit // length
            if left // each:
                placed.append(((length,) * each, each * length, left // each))
            if left % each:
                placed.append(((length,) * (left % each), left % each * length, 1))
        for pack, fill, n in placed:
            add(pack, fill, n)
    out = []
    for fill in sorted(by_fill, reverse=True):
        for pack, n in sorted(by_fill[fill].items(), reverse=True):
            found = sorted(set(pack), reverse=True)
            out.append((n, [(x, pack.count(x)) for x in found]))
    return out


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> tuple[dict[int, np.ndarray], int]:
    """By length, rows (first rank, copies in a pack, first sequence, offset), ascending; and the number of sequences."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for n, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            table.setdefault(length, []).append((used.get(length, 0), copies, sequence, offset))
            used[length] = used.get(length, 0) + n * copies
            offset += length * copies
        sequence += n
    return {k: np.array(v, np.int64) for k, v in table.items()}, sequence


def pack(docs: DataFrame, path: str, limit: int = LENGTH, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = stage(pieces(docs, path, end_id, limit, id_col, text_col), "pieces").withColumn("uid", F.struct("row", "start"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most limit entries
    histogram = {x: n for x, n in counts.items() if x < limit}
    table, packed = places(shortest_pack_first(histogram, limit))
    table[limit] = np.array([[0, 1, packed, 0]], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank, length = (b.column(c).to_numpy() for c in ("rank", "length"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(rank) else []:
                rows = table[int(length[at[0]])]
                hit = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                nth = rank[at] - hit[:, 0]
                sequence[at] = hit[:, 2] + nth // hit[:, 1]
                offset[at] = hit[:, 3] + nth % hit[:, 1] * length[at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = numbered(cut, ["length"], "uid", "rank", buckets_for(sum(counts.values())))
    return ranked.select(*kept, "rank").mapInArrow(place, ", ".join(f"{c} long" for c in [*kept, "sequence_id", "offset"]))
