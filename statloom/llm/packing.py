"""Sequence packing by minimum bin slack."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import table, text_slices
from statloom.llm.tokens import encoder


def closest_fill(counts: dict[int, int], target: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, whose sum comes closest to ``target`` from below.

    Subset-sum over bitsets: bit s of ``reach`` says that some multiset sums to
    s. A length with c pieces is shifted in by 1, 2, 4, ... and the rest, so
    that every count up to c is covered. The counts are backtracked through the
    bitsets kept after each length.
    """
    limit = (1 << (target + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= target and counts[x]), reverse=True):
        steps.append((length, reach))
        left, part = min(counts[length], target // length), 1
        while left:
            part = min(part, left)
            reach |= (reach << (part * length)) & limit
            left, part = left - part, part * 2
        if reach >> target & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total, n = total - length, n + 1
        if n:
            used[length] = n
    return used


class Packer:
    """Packs the pieces of one task; holds at most about ``pool`` pieces shorter than a window."""

    def __init__(self, capacity: int, pool: int, first_sequence: int):
        self.capacity, self.pool, self.sequence = capacity, pool, first_sequence
        self.pieces: dict[int, list] = defaultdict(list)
        self.count = self.total = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            self._emit([(doc_id, at, ids[at : at + self.capacity], len(ids))])
        if whole < len(ids):
            self._keep((doc_id, whole, ids[whole:], len(ids)))
        if self.count >= self.pool:
            while self.count > self.pool // 2 and self.total >= self.capacity:
                self._window()

    def _keep(self, piece) -> None:
        self.pieces[len(piece[2])].append(piece)
        self.count, self.total = self.count + 1, self.total + len(piece[2])

    def _take(self, length: int):
        piece = self.pieces[length].pop()
        if not self.pieces[length]:
            del self.pieces[length]
        self.count, self.total = self.count - 1, self.total - length
        return piece

    def _window(self) -> None:
        """The longest piece and the multiset that leaves it the least slack; what slack is left is cut from a piece."""
        chosen = [self._take(max(self.pieces))]
        slack = self.capacity - len(chosen[0][2])
        for length, n in closest_fill({x: len(p) for x, p in self.pieces.items()}, slack).items():
            chosen += [self._take(length) for _ in range(n)]
            slack -= n * length
        if slack and self.pieces:
            chosen.append(self._cut(min(self.pieces), slack))
        self._emit(chosen)

    def _cut(self, length: int, head: int):
        doc_id, start, ids, doc_tokens = self._take(length)
        if head < length:
            self._keep((doc_id, start + head, ids[head:], doc_tokens))
        return doc_id, start, ids[:head], doc_tokens

    def close(self) -> None:
        """Windows while they can be full; the tail goes to sequences of powers of two, which need no padding."""
        while self.total >= self.capacity:
            self._window()
        for bit in range(self.total.bit_length() - 1, -1, -1):
            room, chosen = self.total & (1 << bit), []
            while room:
                length = max(self.pieces)
                chosen.append(self._cut(length, min(room, length)))
                room -= len(chosen[-1][2])
            if chosen:
                self._emit(chosen)

    def _emit(self, chosen) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in chosen:
            crc = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
            self.rows.append((doc_id, start, len(ids), crc, doc_tokens, self.sequence, offset, ids))
            offset += len(ids)
        self.sequence += 1


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    tokenizer: str | None = None,
    pool: int = 512,
    with_ids: bool = False,
) -> DataFrame:
    """Sequences of at most ``capacity`` ids from whole texts, one row per piece of a document.

    A document is its ids and ``end_id``. Windows that a document fills alone
    go out at once. Remainders wait in a pool; the longest one and the multiset
    of remaining lengths closest to the capacity (bitset subset-sum, counts
    backtracked) make a window, and a piece is cut where slack remains. At the
    end of a task the tail goes to sequences whose lengths are powers of two.

    Each task packs the documents it reads, in their order, so nothing is
    shuffled and memory holds one batch and the pool. Sequence ids carry the
    partition in their upper bits. A task that runs again packs the same rows
    alike; cut a lineage whose partitions may change before packing it.

    A null or empty text is the end id alone. Rows with null or repeated ids
    are packed like others. An empty table gives no row. Other columns are not
    read. ``with_ids`` adds the ids themselves.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"`{n}` long" for n in NAMES) + ", ids array<bigint>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        packer = Packer(capacity, pool, TaskContext.get().partitionId() << 40)

        def flush():
            columns = list(zip(*packer.rows)) or [[] for _ in range(8)]
            packer.rows = []
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if with_ids:
                arrays.append(pa.array([x.tolist() for x in columns[7]], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, NAMES + ["ids"] * with_ids)

        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for texts in text_slices(batch.column(1)):
                for text in texts:
                    packer.add(next(names), np.append(enc.encode(text), np.uint32(end_id)))
                if packer.rows:
                    yield flush()
        packer.close()
        if packer.rows:
            yield flush()

    return rows.mapInArrow(run, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
