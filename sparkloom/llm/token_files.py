"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus (the most frequent id is 0), so that frequent
ids take one byte. A rank takes 1 to 3 bytes; its length less one, two bits, stands apart
in control bytes, four to a byte. A file is a Parquet file of blocks in ascending doc_id
order; a block holds whole documents: their ids and token counts, the control bytes and the
data bytes. Decoding looks up 4 lengths for each control byte and gathers whole arrays.

Rows are dealt by ranges of doc_id; part p of the result precedes part p + 1.

Defined results: a null text is empty (the end id only); a null id comes first and is kept as
null by a validity bit; documents that share an id are neighbours in an order fixed by their tokens;
an empty table gives files without blocks; columns beside id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, id_and_bytes, new_path, stage
from .words import encoder

BLOCK_DOCS = 256
BLOCK = "part int, first long, tokens long, docs int, doc_ids binary, valid binary, lengths binary, control binary, data binary"
BLOCK_ARROW = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("tokens", pa.int64()), ("docs", pa.int32()), *((n, pa.binary()) for n in ("doc_ids", "valid", "lengths", "control", "data"))])
LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.int64)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks below 2^24."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    as_bytes = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return control.astype(np.uint8).tobytes(), as_bytes[np.arange(3) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    low = raw[at]
    low[size > 1] |= raw[at[size > 1] + 1] << 8
    low[size > 2] |= raw[at[size > 2] + 2] << 16
    return low


def binaries(raw: np.ndarray, n: np.ndarray) -> pa.Array:
    """A binary column whose values are the next n[i] items of raw."""
    ends = np.concatenate([[0], np.cumsum(n)]) * raw.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())


def encoded(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, ids, counted): each text's ids and the end id; and, ids null, a row for each task with its counts of all ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        total = np.zeros(e.size, np.int64)
        names = ["doc_id", "ids", "counted"]
        for b in arrow_rows(batches):
            ids, n = e.flat([(x or b"").decode() for x in b.column("text").to_pylist()], end_id)
            total += np.bincount(ids, minlength=e.size)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), binaries(ids, n), pa.nulls(b.num_rows, pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=names)

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, counted binary")


def counts(coded: DataFrame) -> DataFrame:
    """(id, n) of every id that occurs; only the tasks' counts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for raw in b.column("counted").to_pylist():
                n = np.frombuffer(raw, np.int64)
                total = n if total is None else total + n
        if total is not None:
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["id", "n"])

    return coded.where("counted IS NOT NULL").select("counted").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def ranks_of(coded: DataFrame, vocabulary: int) -> np.ndarray:
    """Ids by rank, the most frequent first, ties by id. The list is as long as the vocabulary, whatever the corpus."""
    found = counts(coded).toPandas()
    total = np.zeros(vocabulary, np.int64)
    total[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return np.argsort(-total, kind="stable").astype(np.int64)


def blocks(coded: DataFrame, by_rank: np.ndarray, parts: int, dtype: np.dtype) -> DataFrame:
    """The files' rows. Ranges go by id, then by a hash of the tokens, so that one id does not hold a task together."""
    rank_of = np.zeros(len(by_rank), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    dealt = coded.where("ids IS NOT NULL").select("doc_id", "ids", F.xxhash64("ids").alias("tie"))
    ordered = dealt.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), 0
        for big in batches:
            for lo in range(0, big.num_rows, BLOCK_DOCS):
                b = big.slice(lo, BLOCK_DOCS)
                raw = b.column("ids").to_pylist()
                ids = np.frombuffer(b"".join(raw), dtype)
                lengths = np.array([len(x) // dtype.itemsize for x in raw], np.uint64)
                control, data = pack(rank_of[ids])
                own = b.column("doc_id")
                doc_ids = own.fill_null(0).to_numpy(zero_copy_only=False)
                valid = np.packbits(own.is_valid().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, first, len(ids), len(raw), doc_ids.tobytes(), valid.tobytes(), lengths.tobytes(), control, data), BLOCK_ARROW)], schema=BLOCK_ARROW)
                first += len(ids)

    return ordered.mapInArrow(run, BLOCK)


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> np.ndarray:
    """Write the token files into folder; return the ids by rank, which readers need."""
    spark = docs.sparkSession
    coded = stage(encoded(docs, path, end_id, id_col, text_col), "ids")
    e = encoder(path)
    by_rank = ranks_of(coded, e.size)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks(coded, by_rank, parts, e.dtype).write.option("compression", "zstd").parquet(folder)
    return by_rank


def read_tokens(spark: SparkSession, folder: str, by_rank: np.ndarray) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; start counts the ids before the document in the whole corpus."""
    stored = spark.read.schema(BLOCK).parquet(folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    base = stored.groupBy("part").agg(F.sum("tokens").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("base"))
    plain = by_rank.astype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {k: b.column(k)[i].as_py() for k in b.schema.names}
                lengths = np.frombuffer(row["lengths"], "<u8").astype(np.int64)
                ids = memoryview(plain[unpack(row["control"], row["data"], row["tokens"])]).cast("B")
                ends = np.cumsum(lengths)
                valid = np.unpackbits(np.frombuffer(row["valid"], np.uint8), count=row["docs"]).astype(bool)
                crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for n, e in zip(lengths.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(row["docs"], row["part"], np.int32)), pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=~valid), pa.array(row["first"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spans = stored.mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return spans.join(base, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """Write the documents' token files, read them back, and report each document."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    return read_tokens(spark, folder, write_tokens(docs, path, folder))
