"""BPE encoding and decoding; long texts by tree concatenation.

A short text is encoded as a whole. A long one is halved until its blocks are short;
the blocks are encoded in parallel on their own, and then joined pair by pair: a window
around the join is encoded again and grows until it has, on each side, a token that
equals the side's own in place, id and pretoken start. Left of the first such token and
right of the second the sides' tokens hold; between them the window's do.

Why this is exact. A pretoken start is memoryless: what follows depends on the text from
there on only. Within a pretoken, ids are the encoding if every two neighbours are
(each pair encodes to itself), and a shared token on either side makes every pair of the
joined list a pair of some true encoding. The last MARGIN characters of a window are not
trusted, as what follows them may change them (contractions, white space, special tokens).

Defined results: a null text is empty and has no ids; very long texts without any white
space go the same way; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, id_and_bytes, stage
from .words import encoder

#: Characters of a block; texts up to twice that are encoded whole.
BLOCK = 16_384
MARGIN = 32
WINDOW = 256
CODES = "row long, doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Part:
    """Tokens of text[lo:hi]: ids, start and end in the text, and whether a token starts a pretoken."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray, opens: np.ndarray):
        self.ids, self.start, self.end, self.opens = ids, start, end, opens

    @classmethod
    def of(cls, tok, text: str, lo: int, hi: int) -> Part:
        e = tok.encode(text[lo:hi], add_special_tokens=False)
        at = np.array(e.offsets, np.int64).reshape(-1, 2) + lo
        word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        opens = np.ones(len(word), bool)
        opens[1:] = (word[1:] != word[:-1]) | (word[1:] < 0)
        return cls(np.array(e.ids, np.int64), at[:, 0], at[:, 1], opens)

    def cut(self, a: int, b: int) -> Part:
        return Part(self.ids[a:b], self.start[a:b], self.end[a:b], self.opens[a:b])


def joined(parts: list[Part]) -> Part:
    return Part(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("ids", "start", "end", "opens")))


def shared(a: Part, b: Part, lo: int, hi: int) -> list[tuple[int, int]]:
    """Positions in a and b of equal tokens within text[lo:hi], characters whole."""
    inside = lambda p: {(s, e, i, o): k for k, (s, e, i, o) in enumerate(zip(p.start.tolist(), p.end.tolist(), p.ids.tolist(), p.opens.tolist())) if lo <= s and e <= hi}
    own, there = inside(a), inside(b)
    return sorted((own[k], there[k]) for k in own.keys() & there.keys())


def lone(p: Part, k: int) -> bool:
    """No other token of p covers a character of token k: offsets of split characters overlap."""
    return (k == 0 or p.end[k - 1] <= p.start[k]) and (k + 1 == len(p.ids) or p.start[k + 1] >= p.end[k])


def near(p: Part, lo: int, hi: int) -> tuple[int, Part]:
    """The tokens of p that start in text[lo:hi], and the position of the first."""
    a, b = np.searchsorted(p.start, lo), np.searchsorted(p.start, hi)
    return int(a), p.cut(a, b)


def join(tok, text: str, left: Part, right: Part, lo: int, at: int, hi: int) -> Part:
    """Tokens of text[lo:hi] from those of text[lo:at] and text[at:hi]."""
    size = WINDOW
    while True:
        a, b = at - size, at + size
        if a <= lo and b >= hi:
            return Part.of(tok, text, lo, hi)
        a, b = max(a, lo), min(b, hi)
        window = Part.of(tok, text, a, b)
        before = after = None
        i0, own = near(left, a, at)
        if a == lo:
            before = (0, 0)
        else:
            for x, y in shared(own, window, a + MARGIN, at - MARGIN):
                if lone(own, x) and lone(window, y):
                    before = (i0 + x, y)
                    break
        j0, own = near(right, at, b)
        if b == hi:
            after = (len(right.ids), len(window.ids))
        else:
            for x, y in reversed(shared(own, window, at, b - MARGIN)):
                if lone(own, x) and lone(window, y):
                    after = (j0 + x, y)
                    break
        if before and after and before[1] <= after[1]:
            return joined([left.cut(0, before[0]), window.cut(before[1], after[1]), right.cut(after[0], len(right.ids))])
        size *= 2


def halves(n: int, block: int = BLOCK) -> list[tuple[int, int]]:
    """The leaves of the tree over n characters, in order."""

    def split(lo: int, hi: int) -> Iterator[tuple[int, int]]:
        if hi - lo <= block:
            yield lo, hi
        else:
            mid = (lo + hi) // 2
            yield from split(lo, mid)
            yield from split(mid, hi)

    return list(split(0, n))


def concatenated(tok, text: str, leaves: dict[tuple[int, int], Part], block: int = BLOCK) -> Part:
    def whole(lo: int, hi: int) -> Part:
        if hi - lo <= block:
            return leaves[lo, hi]
        mid = (lo + hi) // 2
        return join(tok, text, whole(lo, mid), whole(mid, hi), lo, mid, hi)

    return whole(0, len(text))


def encode_text(tok, text: str, block: int = BLOCK) -> list[int]:
    """The ids of a text by tree concatenation in one process."""
    leaves = {(lo, hi): Part.of(tok, text, lo, hi) for lo, hi in halves(len(text), block)}
    return concatenated(tok, text, leaves, block).ids.tolist()


def digest_columns(path: str, rows: pa.Array, docs: pa.Array, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Counts and hashes of each text's ids (ids one text after another, n of each) and of the text decoded from them."""
    tok = encoder(path).tok
    ends = np.concatenate([[0], np.cumsum(n)])
    decimal = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _decimal(path).take(pa.array(ids)))
    hashes = [hashlib.sha256(x.encode()).hexdigest() for x in pc.binary_join(decimal, ",").to_pylist()]
    lists = [x.tolist() for x in np.split(ids, ends[1:-1])] if len(n) else []
    back = [hashlib.sha256(t.encode()).hexdigest() for t in tok.decode_batch(lists, skip_special_tokens=False)]
    return pa.RecordBatch.from_arrays([rows, docs, pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())], names=["row", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


_NAMES: dict[str, pa.Array] = {}


def _decimal(path: str) -> pa.Array:
    if path not in _NAMES:
        _NAMES[path] = pa.array([str(i) for i in range(encoder(path).size)], pa.string())
    return _NAMES[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    spark = docs.sparkSession
    rows = id_and_bytes(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    long = F.coalesce(F.length(F.col("text").cast("string")) > 2 * block, F.lit(False))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in arrow_rows(batches):
            ids, n = e.flat([(x or b"").decode() for x in b.column("text").to_pylist()])
            yield digest_columns(path, b.column("row"), b.column("doc_id"), ids, n)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches):
            for row, doc, text in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                text = text.decode()
                found = halves(len(text), block)
                yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc, "lo": lo, "hi": hi, "piece": text[lo:hi]} for lo, hi in found], schema=PIECES)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(path).tok
        for b in batches:
            for i in range(0, b.num_rows, 16):
                out = b.slice(i, 16).to_pylist()
                for x in out:
                    p = Part.of(tok, x["piece"], 0, len(x["piece"]))
                    x["tokens"] = np.stack([p.ids, p.start, p.end, p.opens]).astype("<i4").tobytes()
                yield pa.RecordBatch.from_pylist(out, schema=LEAVES)

    def tree(table: pa.Table) -> pa.Table:
        """All blocks of one text, which as a value of a row fits a task."""
        e = encoder(path)
        rows = table.sort_by("lo").to_pylist()
        text = "".join(r["piece"] for r in rows)
        own = {}
        for r in rows:
            ids, start, end, opens = np.frombuffer(r["tokens"], "<i4").reshape(4, -1).astype(np.int64)
            own[r["lo"], r["hi"]] = Part(ids, start + r["lo"], end + r["lo"], opens.astype(bool))
        ids = concatenated(e.tok, text, own, block).ids.astype(e.dtype)
        found = digest_columns(path, pa.array([rows[0]["row"]], pa.int64()), pa.array([rows[0]["doc_id"]], pa.int64()), ids, np.array([len(ids)], np.int64))
        return pa.Table.from_batches([found])

    PIECES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("piece", pa.string())])
    LEAVES = PIECES.append(pa.field("tokens", pa.binary()))
    columns = "row long, doc_id long, lo long, hi long, piece string"
    direct = rows.where(~long).mapInArrow(short, CODES)
    pieces = stage(rows.where(long).mapInArrow(blocks, columns), "blocks")
    split = max(1, spark.conf.get("spark.sql.shuffle.partitions") and int(spark.conf.get("spark.sql.shuffle.partitions")))
    coded = pieces.repartition(split, "row", "lo").mapInArrow(leaves, columns + ", tokens binary")
    trees = coded.groupBy("row").applyInArrow(tree, CODES)
    return direct.unionByName(trees).drop("row")
