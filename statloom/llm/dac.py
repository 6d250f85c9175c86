"""Token-id files of directly addressable codes: any token is read without decoding a block."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statloom.llm.common import scratch_path, table, text_slices
from statloom.llm.tokens import encoder

MAGIC = b"DAC1"
_BLOCK = 512  # bits of a continuation bitmap for each entry of its rank directory


def encode(ids: np.ndarray) -> bytes:
    """Ids as levels of 8-bit chunks, low chunk first.

    A level holds the chunks of the ids that reach it; a bitmap marks those
    that go on in the next level, and a directory holds the number of marks
    before every 512 bits. Layout, little-endian: ``DAC1``, levels (u32), ids
    (u64), then for each level its length (u64), chunks, and but for the last
    level bitmap and directory (u32 each).
    """
    parts, current = [], np.asarray(ids, np.uint32)
    while True:
        rest = current >> np.uint32(8)
        more = rest > 0
        parts.append(struct.pack("<Q", len(current)) + (current & np.uint32(255)).astype(np.uint8).tobytes())
        if not more.any():
            break
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), _BLOCK), dtype=np.uint32)
        parts[-1] += bits.tobytes() + (np.cumsum(ones, dtype=np.uint32) - ones).tobytes()
        current = rest[more]
    return MAGIC + struct.pack("<IQ", len(parts), len(ids)) + b"".join(parts)


class Codes:
    """Read access to what :func:`encode` wrote, over the bytes as they are."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        levels, self.n = struct.unpack_from("<IQ", blob, 4)
        at, self.levels = 16, []
        for level in range(levels):
            (n,) = struct.unpack_from("<Q", blob, at)
            at += 8
            chunks = np.frombuffer(blob, np.uint8, n, at)
            at += n
            bits = directory = None
            if level < levels - 1:
                bits = np.frombuffer(blob, np.uint8, (n + 7) // 8, at)
                at += len(bits)
                directory = np.frombuffer(blob, "<u4", (n + _BLOCK - 1) // _BLOCK, at)
                at += 4 * len(directory)
            self.levels.append((chunks, bits, directory))

    def __len__(self) -> int:
        return self.n

    @staticmethod
    def _rank(bits: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Marks before bit i: one directory entry and at most 64 bytes."""
        if i >= len(bits) * 8 or i // _BLOCK >= len(directory):
            first = (len(directory) - 1) * _BLOCK // 8
            return int(directory[-1]) + int(np.bitwise_count(bits[first:]).sum())
        first = i // _BLOCK * (_BLOCK // 8)
        whole = int(np.bitwise_count(bits[first : i // 8]).sum())
        return int(directory[i // _BLOCK]) + whole + (int(bits[i // 8]) & ((1 << i % 8) - 1)).bit_count()

    def __getitem__(self, i: int) -> int:
        """One id, through one rank a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, directory in self.levels:
            value |= int(chunks[i]) << shift
            if bits is None or not bits[i // 8] >> (i % 8) & 1:
                return value
            i, shift = self._rank(bits, directory, i), shift + 8
        return value

    def span(self, a: int, b: int) -> np.ndarray:
        """Ids [a, b): a span of a level continues in a span of the next."""
        out, where = np.zeros(b - a, np.uint32), np.arange(b - a)
        for shift, (chunks, bits, directory) in enumerate(self.levels):
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * shift)
            if bits is None or a == b:
                break
            marks = np.unpackbits(bits[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            a = self._rank(bits, directory, a)
            b, where = a + int(marks.sum()), where[marks]
        return out


SEGMENT = "shard int, segment int, shard_offset long, n_tokens long, doc_ids array<bigint>, doc_offsets array<bigint>, codes binary"


def _segments(path: str | None, end_id: int, segment_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, number, done = encoder(path), TaskContext.get().partitionId(), 0, 0
        ids, docs, offsets, held = [], [], [], 0

        def segment():
            nonlocal number, done, ids, docs, offsets, held
            joined = np.concatenate(ids)
            row = {"shard": shard, "segment": number, "shard_offset": done, "n_tokens": len(joined), "doc_ids": docs, "doc_offsets": offsets, "codes": encode(joined)}
            number, done = number + 1, done + len(joined)
            ids, docs, offsets, held = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("shard_offset", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64())), ("codes", pa.binary())])
        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for texts in text_slices(batch.column(1)):
                for text in texts:
                    tokens = np.append(enc.encode(text), np.uint32(end_id))
                    docs.append(next(names))
                    offsets.append(held)
                    ids.append(tokens)
                    held += len(tokens)
                    if held >= segment_tokens:
                        yield segment()
        if ids:
            yield segment()

    return run


def write_token_file(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    tokenizer: str | None = None,
    segment_tokens: int = 1 << 16,
    partitions: int | None = None,
) -> None:
    """Token ids of whole texts, in ascending order of ``id_col``, under ``path``.

    Documents are range-partitioned by id, so that the files hold them in
    order; each row of a file is a segment of whole documents of about
    ``segment_tokens`` ids, with the documents' places in it. An id that many
    rows share stays in one partition, its rows in order of their text. A null
    text is empty and gives the end id alone; null ids come first; an empty
    table gives an empty file. Other columns are not read.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_segments(tokenizer, end_id, segment_tokens), SEGMENT).write.option("compression", "zstd").parquet(path)


def _documents(batches):
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for row in batch.to_pylist():
            codes, ends = Codes(row["codes"]), [*row["doc_offsets"][1:], row["n_tokens"]]
            spans = list(zip(row["doc_offsets"], ends))
            crc = [zlib.crc32(codes.span(a, b).astype("<u4").tobytes()) for a, b in spans]
            base = row["shard_start"] + row["shard_offset"]
            columns = [row["doc_ids"], [base + a for a, _ in spans], [b - a for a, b in spans], crc]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: its place among all ids, its length and the CRC of its ids.

    Only the sizes of the files (one row each) are summed in order.
    """
    segments = spark.read.parquet(path)
    order = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    sizes = segments.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    starts = sizes.select("shard", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("shard_start"))
    return segments.join(starts, "shard").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Single ids by (doc_id, position), each read in place; positions outside a document give no row."""
    segments = spark.read.parquet(path)
    index = segments.select(
        "shard", "segment", F.explode(F.arrays_zip("doc_ids", "doc_offsets", F.concat(F.slice("doc_offsets", 2, F.size("doc_offsets")), F.array("n_tokens")).alias("ends"))).alias("d")
    ).select("shard", "segment", F.col("d.doc_ids").alias("doc_id"), F.col("d.doc_offsets").alias("a"), F.col("d.ends").alias("b"))
    found = wanted.select("doc_id", "position").join(index, "doc_id").where("position >= 0 AND a + position < b")

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            ids = [Codes(r["codes"])[r["a"] + r["position"]] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64())], ["doc_id", "position", "token_id"])

    codes = segments.select("shard", "segment", "codes")
    return found.join(codes, ["shard", "segment"]).select("doc_id", "position", "a", "codes").mapInArrow(run, "doc_id long, position long, token_id long")


def op9_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_token_file(table(spark, sf_dir, "documents"), path)
    return read_token_file(spark, path)
