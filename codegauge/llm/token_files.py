"""Token ids in binary files: frequency-ranked, byte-aligned, with separate control bytes.

File: blocks, each followed by one newline byte. A block, little-endian:

    magic  b"CGTB1\\0\\0\\0"
    u64    bytes of the block          u32 documents     u32 size of the rank table
    u64    part (files of lower parts hold smaller doc_ids)      u64 number of the block in its part
    u64    ids in the block
    i64    doc_id of each document, u8 1 where it is null, u32 ids of each document
    u32    the rank table: id of each rank
    u8     control bytes, four ids each, two bits an id: its bytes less one (first id in the lowest bits)
    u8     data bytes: each id's rank in 1 to 4 bytes, lowest first

Ranks follow the ids' counts over the whole corpus, so most ids take one byte. Decoding reads a control byte's
four lengths from a 256-row table and gathers all data bytes of a block at once with numpy.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import BATCH_BYTES, settings
from . import shared, tokens
from .shared import release_memory

MAGIC, END = b"CGTB1\0\0\0", 0
#: A block holds about so many ids: a few MB, which bounds a task's memory.
BLOCK_IDS = 2_000_000
_HEAD = struct.Struct("<8sQIIQQQ")
#: Lengths of the four ids of each control byte.
_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    wide = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), wide[np.arange(4) < size[:, None]].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = _LENGTHS[control].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = data
    return out.view("<u4").reshape(-1)


def encode_block(part: int, number: int, doc_ids: list[int | None], sizes: np.ndarray, flat: np.ndarray, by_rank: np.ndarray) -> bytes:
    """sizes: ids of each document, all of which are flat; by_rank: the id of each rank, over all ids that may occur."""
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = rank[flat]
    top = by_rank[: int(ranks.max()) + 1 if len(ranks) else 0].astype("<u4")
    control, data = encode_ranks(ranks)
    body = b"".join([
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        sizes.astype("<u4").tobytes(), top.tobytes(), control, data,
    ])
    return _HEAD.pack(MAGIC, _HEAD.size + len(body), len(doc_ids), len(top), part, number, len(flat)) + body


def decode_file(raw: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """(part, number of the block, doc_ids, ids of each document, all ids) of each block of a file."""
    at = 0
    while at < len(raw):
        magic, size, docs, table, part, number, n = _HEAD.unpack_from(raw, at)
        if magic != MAGIC or raw[at + size : at + size + 1] != b"\n":
            raise ValueError("not a token file, or cut off")
        p = at + _HEAD.size
        doc_ids = np.frombuffer(raw, "<i8", docs, p)
        nulls = np.frombuffer(raw, np.uint8, docs, p := p + 8 * docs)
        lengths = np.frombuffer(raw, "<u4", docs, p := p + docs)
        by_rank = np.frombuffer(raw, "<u4", table, p := p + 4 * docs)
        control = np.frombuffer(raw, np.uint8, -(-n // 4), p := p + 4 * table)
        data = np.frombuffer(raw, np.uint8, at + size - (p := p + len(control)), p)
        ids = by_rank[decode_ranks(control, data, n)] if n else np.zeros(0, np.uint32)
        yield part, number, [None if z else d for d, z in zip(doc_ids.tolist(), nulls.tolist())], lengths, ids
        at += size + 1


def token_blocks(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(part, number, doc_ids, width, sizes, ids): all whole texts' ids in ascending doc_id order, nulls first, cut into blocks.

    Texts are dealt by ranges of doc_id and tokenised once. A block is closed when it holds BLOCK_IDS ids, which is looked at
    after each megabyte of text; a longer text is in one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, coder = TaskContext.get().partitionId(), 0, tokens.encoder(path)
        width = "<u2" if max(coder.size, end + 1) <= 1 << 16 else "<u4"
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            columns = [pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([width])]
            columns += [pa.array([np.concatenate(x).astype(t).tobytes()], pa.binary()) for x, t in ((sizes, "<u4"), (ids, width))]
            return pa.record_batch(columns, names=["part", "number", "doc_ids", "width", "sizes", "ids"])

        for b in batches:
            own, at = b.column(0).to_pylist(), 0
            while at < len(own):
                lot, size = [], 0
                while at + len(lot) < len(own) and (not lot or size < tokens.SLICE):
                    lot.append(b.column(1)[at + len(lot)].as_py())
                    size += len(lot[-1] or "")
                flat, n = coder.ids_of(lot)
                doc_ids += own[at : at + len(lot)]
                ids.append(np.insert(flat, np.cumsum(n), end))
                sizes.append(n + 1)
                at, held = at + len(lot), held + len(ids[-1])
                if held >= BLOCK_IDS:
                    yield block()
                    doc_ids, ids, sizes, held, number = [], [], [], 0, number + 1
        if doc_ids:
            yield block()
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return shared.written(rows.mapInArrow(run, "part long, number long, doc_ids array<long>, width string, sizes binary, ids binary"), "token-blocks")


def id_counts(blocks: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs in all blocks; a task sends one row an id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for width, ids in zip(b.column(0), b.column(1)):
                n = np.bincount(np.frombuffer(ids.as_py(), width.as_py()), minlength=len(total))
                n[: len(total)] += total
                total = n
        i = np.flatnonzero(total)
        yield pa.record_batch([pa.array(i.astype(np.int64)), pa.array(total[i])], names=["id", "n"])

    return shared.written(blocks.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")), "token-counts")


def write_files(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> None:
    """Writes all whole texts' ids, in ascending doc_id order (nulls first), as token files in the folder.

    The folder is any that Spark writes to: each block is a binary value that the text writer puts out as it
    is, one block a file, under Spark's committer, so a lost executor leaves no half-written file.
    """
    blocks = token_blocks(docs, path or tokens.vocabulary_path(), end)
    counts = id_counts(blocks)
    counted = counts.collect()  # a row for each id of the vocabulary at most
    by_rank = np.array([i for i, _ in sorted(counted, key=lambda r: (-r[1], r[0]))], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                part, number, doc_ids, width, sizes, ids = (b.column(n)[k].as_py() for n in range(6))
                raw = encode_block(part, number, doc_ids, np.frombuffer(sizes, "<u4"), np.frombuffer(ids, width), by_rank)
                yield pa.record_batch([pa.array([raw], pa.binary())], names=["value"])
        release_memory()

    out = blocks.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxBytesPerBatch=str(BATCH_BYTES)):
        out.write.option("maxRecordsPerFile", 1).text(folder)
    shared.drop_written(blocks, counts)


def read_files(spark, folder: str) -> DataFrame:
    """(part, block, nth, doc_id, in_block, n_tokens, ids_crc32) of each document in the folder's files; in_block: ids before it in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                for part, number, doc_ids, lengths, ids in decode_file(raw.as_py()):
                    ends = np.cumsum(lengths.astype(np.int64))
                    flat = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(flat[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                    k = len(doc_ids)
                    yield pa.record_batch(
                        [pa.array([part] * k, pa.int64()), pa.array([number] * k, pa.int64()), pa.array(range(k), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                        names=["part", "block", "nth", "doc_id", "in_block", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("content")
    return files.mapInArrow(run, "part long, block long, nth long, doc_id long, in_block long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """Writes the files and reads them back: doc_id, start, n_tokens, ids_crc32 of each row of docs.

    Null and empty texts are the end id alone. Rows that repeat are documents of their own; among equal doc_ids
    any order may hold. Only doc_id (null allowed) and text are read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    write_files(docs, folder := shared.place(spark, "token-files"), path, end)
    rows = shared.written(read_files(spark, folder), "token-digests")
    blocks = shared.written(rows.groupBy("part", "block").agg(F.sum("n_tokens").alias("n")), "token-block-sizes")
    # One row for each part, that is each partition of the writing job, comes to the driver.
    parts, total = [], 0
    for part, n in blocks.groupBy("part").agg(F.sum("n")).orderBy("part").collect():
        parts.append((part, total))
        total += n
    earlier = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.withColumn("inside", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(spark.createDataFrame(parts, "part long, before long"), "part")
    first = shared.written(first.select("part", "block", (F.col("before") + F.col("inside")).alias("before")), "token-block-starts")
    return rows.join(first, ["part", "block"]).select("doc_id", (F.col("before") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32")
