"""Exact deduplication by composable polynomial fingerprints, settled by comparing texts.

The fingerprint of bytes s is the sum of s_i r^i modulo a prime, for three
bases r, with the number of bytes. Pieces of a text are hashed side by side and
combine as H(ab) = H(a) + r^|a| H(b), so that the parts of a huge document can
lie in one row or in many. Texts of equal fingerprint are then compared piece
by piece while they stream past in the order of their fingerprints.

Texts count as equal when they are identical after every run of blanks
(``[\\x20\\x09-\\x0D]+``) has become one space. Defined results: null text counts
as empty, so all such rows are copies of each other; of equal texts the smallest
id stays, a null id after all others, and of rows that repeat id and text one
stays; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import cut, discard, slices, table

#: Products of a byte and a residue, summed over a piece, stay below 2**53, so that a matrix product of doubles is exact.
PRIME, PIECE = (1 << 31) - 1, 1024
BASES = (1_103_515_245, 1_566_083_941, 1_812_433_253)

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def one_space(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts that begin at ``starts``, every run of blanks as one space, and where they begin now."""
    blank = _BLANK[data]
    again = blank.copy()
    again[1:] &= blank[:-1]
    again[starts[starts < len(data)]] = False
    kept = ~again
    before = np.concatenate([[0], np.cumsum(kept)])
    return np.where(blank, np.uint8(0x20), data)[kept], before[starts]


def _powers(base: int, step: int, n: int) -> np.ndarray:
    """base ** (step * 0 .. n - 1) modulo the prime."""
    by, out = pow(base, step, PRIME), np.ones(max(n, 1), np.uint64)
    for i in range(1, n):
        out[i] = int(out[i - 1]) * by % PRIME
    return out


def fingerprints(data: np.ndarray, starts: np.ndarray, bases=BASES, piece: int = PIECE) -> np.ndarray:
    """One row of residues for each text: its pieces are hashed in one product, then shifted by their place and summed."""
    ends = np.append(starts[1:], len(data))
    sizes = ends - starts
    pieces = np.maximum(-(-sizes // piece), 1)
    first = np.concatenate([[0], np.cumsum(pieces)])
    padded = np.zeros(int(first[-1]) * piece, np.uint8)
    padded[np.arange(len(data)) + np.repeat(first[:-1] * piece - starts, sizes)] = data
    out = np.empty((len(starts), len(bases)), np.int64)
    place = np.arange(first[-1]) - np.repeat(first[:-1], pieces)
    inner = np.stack([_powers(b, 1, piece) for b in bases], 1).astype(float)
    hashed = (padded.reshape(-1, piece).astype(float) @ inner).astype(np.uint64) % PRIME
    for i, base in enumerate(bases):
        shifted = hashed[:, i] * _powers(base, piece, int(pieces.max()))[place] % PRIME
        out[:, i] = np.add.reduceat(shifted, first[:-1]) % PRIME
    return out


def combine(left: np.ndarray, left_size: int, right: np.ndarray, bases=BASES) -> np.ndarray:
    """The fingerprint of two texts in a row, of which only fingerprints and the size of the first are known."""
    return np.array([(int(a) + pow(b, left_size, PRIME) * int(c)) % PRIME for a, c, b in zip(left, right, bases)], np.int64)


def _fingerprinted(df: DataFrame, text_col: str, id_col: str, bases, with_text: bool) -> DataFrame:
    """``doc_id``, size and residues of every normalised text, and the text itself where asked for."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sizes = [len(v) for v in batch.column(1).to_pylist()]
            for a, b in slices(sizes):
                parts = batch.column(1).slice(a, b - a).to_pylist()
                starts = np.concatenate([[0], np.cumsum(sizes[a : b - 1])]).astype(np.int64) if b - a > 1 else np.zeros(1, np.int64)
                data, starts = one_space(np.frombuffer(b"".join(parts), np.uint8), starts)
                marks = fingerprints(data, starts, bases)
                ends = np.append(starts[1:], len(data))
                wide = marks[:, 0] << 31 | marks[:, 1] if len(bases) > 1 else marks[:, 0]
                last = marks[:, 2] if len(bases) > 2 else np.zeros_like(wide)
                text = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ends - starts), pa.array(wide), pa.array(last), text], ["doc_id", "n_bytes", "f1", "f2", "norm"])

    out = rows.mapInArrow(run, "doc_id long, n_bytes long, f1 long, f2 long, norm binary")
    return out if with_text else out.select("doc_id", "n_bytes", "f1", "f2", F.sha2("norm", 256).alias("text_sha256"))


MARK = ["n_bytes", "f1", "f2"]


def same_by_pieces(a: bytes, b: bytes, piece: int = 1 << 16) -> bool:
    """Piece by piece, up to the first that differs."""
    return len(a) == len(b) and all(a[i : i + piece] == b[i : i + piece] for i in range(0, len(a), piece))


def _compared(rows: DataFrame) -> DataFrame:
    """One row for each different text that a task meets under a fingerprint, while texts stream past in their order.

    Rows of a fingerprint follow each other, so a task holds one text at a time
    (more only where fingerprints collide). Were they out of order, texts would
    come out more often, and meet again in the next round.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        mark, known = None, []
        for batch in batches:
            out = []
            for key, text in zip(zip(*(batch.column(i).to_pylist() for i in range(3))), batch.column(3)):
                if key != mark:
                    mark, known = key, []
                text = text.as_py()
                if not any(same_by_pieces(text, other) for other in known):
                    known.append(text)
                    out.append((*key, text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], [*MARK, "norm"])

    return rows.select(*MARK, "norm").mapInArrow(run, "n_bytes long, f1 long, f2 long, norm binary")


def _collided(df: DataFrame, text_col: str, id_col: str, groups: DataFrame, bases) -> DataFrame:
    """Fingerprints that more than one text has.

    Each text meets its group's row in a merge join, which brings the texts of a
    fingerprint one after another and lets a large group be split over tasks;
    each task compares them and passes on what differs, so that a group comes
    down to a text a task. What tasks passed on is compared once more.
    """
    texts = _fingerprinted(df, text_col, id_col, bases, True)
    first = cut(_compared(texts.join(groups.hint("merge"), MARK)), "compared")
    again = first.groupBy(*MARK).count().where("count > 1").select(*MARK)
    rest = first.join(again, MARK).repartition(*MARK).sortWithinPartitions(*MARK)
    found = cut(_compared(rest).groupBy(*MARK).count().where("count > 1").select(*MARK), "collided")
    discard(first)
    return found


def copies(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", bases=BASES) -> DataFrame:
    """One row a document: ``doc_id, keep_id, group_size, kept, text_sha256, n_bytes``.

    Groups are counted on fingerprints alone (a few numbers a row, combined
    before the shuffle); only then do texts move, once, to be compared. Texts
    whose fingerprints collide are told apart by the SHA-256 of the whole text.
    """
    marks = cut(_fingerprinted(df, text_col, id_col, bases, False).withColumn("row", F.monotonically_increasing_id()), "marks")
    groups = marks.groupBy(*MARK).count().where("count > 1").select(*MARK)
    hit = _collided(df, text_col, id_col, groups, bases)
    key = [*MARK, "clash"]
    if hit.limit(1).count():
        marks = marks.join(hit.withColumn("hit", F.lit(True)), MARK, "left").withColumn("clash", F.when(F.col("hit"), F.col("text_sha256")).otherwise("")).drop("hit")
    else:
        marks = marks.withColumn("clash", F.lit(""))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    groups = marks.groupBy(*key).agg(F.count("*").alias("group_size"), F.min(order).alias("first"))
    joined = marks.join(groups.hint("merge"), key)
    return joined.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256", "n_bytes")


def drop_copies(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose id stays; ids name rows, so that all rows of a repeated id share its fate. Rows without an id stay."""
    stay = copies(df, text_col, id_col).groupBy(F.col("doc_id").alias("_stays")).agg(F.max("kept").alias("_kept")).where("NOT _kept AND _stays IS NOT NULL").select("_stays")
    return df.join(stay, F.col(id_col).cast("long") == F.col("_stays"), "left_anti")


def op12_polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents")).drop("n_bytes")


OP12_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST)
"""
