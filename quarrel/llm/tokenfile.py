"""A binary file of token ids: patched frame-of-reference blocks with a block index and a document index.

A file image, little-endian throughout: magic, counts and section lengths (HEADER); the document table (doc ids with a null mark, token
counts); the block index, for each block of 256 ids its minimum (u4), bit width (u1), exception count (u2) and start in the data section
(u8); exception positions (u1) and values (u4); then the packed blocks. A block stores ids minus its minimum at the width that holds
PERCENTILE of them; ids that do not fit are exceptions, whose slot holds zeros. Any block decodes alone by its start.

write() range-partitions by doc_id, sorts, and writes images of bounded size as rows of a Parquet table in the folder given (Spark's
committer makes each task's files appear once, whatever is retried). read() decodes them back; Image.ids() starts at any id. Null doc_ids
come first; rows that share a doc_id stand next to each other in the order of a hash of their texts, repeated rows as often as they stand
there; null and empty texts hold the end id alone. Extra columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrel.llm.common import shuffle_width
from quarrel.llm.tokens import encoder

MAGIC = b"QTOKPF01"
HEADER = struct.Struct("<8sQQQQ")  # magic, documents, ids, exceptions, bytes of packed blocks
BLOCK = 256
PERCENTILE = 0.92
IMAGE_TOKENS = 1 << 20
IMAGE_SCHEMA = "part int, seq int, first_token long, n_tokens long, image binary"


def encode_image(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The image of documents in order; ids: all their ids joined, uint32."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    if n:
        padded[n:] = ids[-1]
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(1) if blocks else np.empty(0, np.uint32)
    delta = grid - low[:, None]
    bits = np.zeros(delta.shape, np.uint8)
    for k in range(32):
        more = delta >= np.uint32(1 << k)
        if not more.any():
            break
        bits += more
    width = np.partition(bits, int(PERCENTILE * (BLOCK - 1)), axis=1)[:, int(PERCENTILE * (BLOCK - 1))] if blocks else np.empty(0, np.uint8)
    outlier = bits > width[:, None]
    rows, cols = np.nonzero(outlier)
    values = delta[rows, cols]
    delta[outlier] = 0
    size = width.astype(np.int64) * (BLOCK // 8)
    starts = np.concatenate(([0], np.cumsum(size)))[:blocks]
    data = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width):
        if w:
            pick = np.nonzero(width == w)[0]
            rest, packed = delta[pick].astype(np.uint16 if w <= 16 else np.uint32), np.empty((len(pick), int(w), BLOCK // 8), np.uint8)
            for k in range(int(w)):
                packed[:, k] = np.packbits((rest & rest.dtype.type(1 << k)) != 0, axis=1, bitorder="little")
            data[(starts[pick, None] + np.arange(int(w) * (BLOCK // 8))).ravel()] = packed.ravel()
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join((
        HEADER.pack(MAGIC, len(doc_ids), n, len(values), len(data)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), np.asarray(counts).astype("<u8").tobytes(),
        low.astype("<u4").tobytes(), width.astype("u1").tobytes(), outlier.sum(1).astype("<u2").tobytes(), starts.astype("<u8").tobytes(),
        cols.astype("u1").tobytes(), values.astype("<u4").tobytes(), data.tobytes(),
    ))


class Image:
    """The sections of an image; blocks are decoded when asked for."""

    def __init__(self, image: bytes):
        magic, docs, self.n, exceptions, size = HEADER.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEADER.size

        def part(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(image, kind, count, at)
            at += out.nbytes
            return out

        blocks = -(-self.n // BLOCK)
        self.doc_ids, self.known, self.counts = part("<i8", docs), part("u1", docs), part("<u8", docs).astype(np.int64)
        self.low, self.width, n_out, self.starts = part("<u4", blocks), part("u1", blocks), part("<u2", blocks), part("<u8", blocks)
        self.cols, self.values, self.data = part("u1", exceptions), part("<u4", exceptions), part("u1", size)
        self.out_at = np.concatenate(([0], np.cumsum(n_out, dtype=np.int64)))

    def ids(self, start: int = 0, count: int | None = None) -> np.ndarray:
        """count ids from start on (all to the end if None); only the blocks that hold them are read, by the block index."""
        end = self.n if count is None else min(self.n, start + count)
        if start >= end:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, -(-end // BLOCK)
        width, grid = self.width[first:last], np.zeros((last - first, BLOCK), np.uint32)
        for w in np.unique(width):
            if w:
                pick = np.nonzero(width == w)[0]
                raw = self.data[self.starts[first + pick, None].astype(np.int64) + np.arange(int(w) * (BLOCK // 8))]
                planes = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(pick), int(w), BLOCK)
                total = np.zeros((len(pick), BLOCK), np.uint32)
                for k in range(int(w)):
                    total |= planes[:, k].astype(np.uint32) << np.uint32(k)
                grid[pick] = total
        lo, hi = self.out_at[first], self.out_at[last]
        grid[np.repeat(np.arange(last - first), np.diff(self.out_at[first : last + 1])), self.cols[lo:hi]] = self.values[lo:hi]
        flat = (grid + self.low[first:last, None]).reshape(-1)
        return flat[start - first * BLOCK : end - first * BLOCK]


def decode_image(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, token counts, ids) of an image."""
    i = Image(image)
    return [int(d) if k else None for d, k in zip(i.doc_ids, i.known, strict=True)], i.counts, i.ids()


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, words: bool = False) -> None:
    """Write docs(doc_id, text) in ascending doc_id order as a table of images under folder."""
    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shuffle_width(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, end = TaskContext.get().partitionId(), encoder(vocabulary, words), end_id.to_bytes(4, "little")
        doc_ids: list[int | None] = []
        chunks: list[bytes] = []
        held = done = seq = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, done, seq
            ids = np.frombuffer(b"".join(chunks), "<u4")
            image = encode_image(doc_ids, np.array([len(c) >> 2 for c in chunks]), ids)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([done], pa.int64()), pa.array([held], pa.int64()), pa.array([image], pa.binary())], names=["part", "seq", "first_token", "n_tokens", "image"])
            done, seq, held = done + held, seq + 1, 0
            doc_ids.clear()
            chunks.clear()
            return out

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), enc.batch(b.column(1).to_pylist()), strict=True):
                doc_ids.append(doc)
                chunks.append(ids + end)
                held += len(chunks[-1]) >> 2
                if held >= IMAGE_TOKENS:
                    yield flush()
        if doc_ids:
            yield flush()

    ordered.mapInArrow(run, IMAGE_SCHEMA).write.mode("overwrite").option("compression", "none").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian uint32) for every document in a folder of images."""
    return _decoded(spark, folder, "doc_id long, start long, n_tokens long, ids binary", lambda raw: pa.array(raw, pa.binary()))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every document in a folder of images."""
    return _decoded(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda raw: pa.array([zlib.crc32(r) for r in raw], pa.int64()))


def _decoded(spark: SparkSession, folder: str, schema: str, last) -> DataFrame:
    images = spark.read.schema(IMAGE_SCHEMA).parquet(folder)
    # One row per writing task, so at most the width of the shuffle that ordered the documents.
    parts = images.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, image in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids, counts, ids = decode_image(image.as_buffer())
                ends = np.cumsum(counts)
                raw = [ids[e - c : e].astype("<u4").tobytes() for c, e in zip(counts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(first + ends - counts, pa.int64()), pa.array(counts, pa.int64()), last(raw)], names=names)

    return images.join(F.broadcast(bases), "part").select((F.col("base") + F.col("first_token")).alias("first"), "image").mapInArrow(run, schema)
