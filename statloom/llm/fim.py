"""Fill-in-the-middle transformation of whole texts, cut by a sparse index of checkpoints.

A text is cut between units (lines). While its units are counted, the byte and
the code-point offset of every ``every``-th unit are kept; a cut is found by
binary search among these checkpoints and a scan of at most ``every`` units.
The index is thus a fraction of the text, whatever the number of cuts.

Results for odd rows: a null text is an empty one; an empty text and one that
holds a sentinel come out ``plain``, that is, unchanged, with null lengths; a
null id takes part in the hash as an empty number. Rows are independent, so
repeated rows give repeated results, an empty table an empty one, and extra
columns, whatever their names, are left out of the result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from statloom.llm.common import slices, table

#: Fixed values of the format: prefix, suffix, middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

FORM = [
    T.StructField("n", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("output", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
]


def _characters(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes: those that do not continue one."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


@dataclass
class Checkpoints:
    """Offsets after every ``every``-th line of a UTF-8 text, and how many lines there are."""

    data: bytes
    n: int
    units: list[int]
    bytes_at: list[int]
    chars_at: list[int]

    @classmethod
    def of(cls, data: bytes, every: int = 64, block: int = 1 << 16) -> Checkpoints:
        """Counts block by block, so that no list of all line ends is held."""
        units, bytes_at, chars_at = [0], [0], [0]
        view, n, mark = np.frombuffer(data, np.uint8), 0, 0
        for a in range(0, len(data), block):
            ends = np.flatnonzero(view[a : a + block] == 10)
            for at in ends[(-n - 1) % every :: every] + a + 1:
                chars_at.append(chars_at[-1] + _characters(view[mark:at]))
                mark = int(at)
                bytes_at.append(mark)
                units.append(units[-1] + every)
            n += len(ends)
        return cls(data, n + (bool(data) and data[-1] != 10), units, bytes_at, chars_at)

    def find(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset after ``unit`` lines."""
        i = bisect_right(self.units, unit) - 1
        start = at = self.bytes_at[i]
        for _ in range(unit - self.units[i]):
            at = self.data.find(b"\n", at) + 1 or len(self.data)
        return at, self.chars_at[i] + len(self.data[start:at].decode("utf-8"))


def choices(key: str, seed: int) -> list[int]:
    """The first four groups of eight digits of the hash of seed and key."""
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def fill_in_middle(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", rate: int = 100, spm_rate: int = 50, seed: int = 7, every: int = 64) -> DataFrame:
    """``doc_id, n, form, output, prefix_chars, middle_chars`` of every row.

    ``rate`` percent of the texts are transformed, ``spm_rate`` percent of
    those with the suffix first. The choice depends on id and seed alone.
    """

    def one(key, text: str):
        data = text.encode("utf-8")
        index = Checkpoints.of(data, every)
        h1, h2, h3, h4 = choices("" if key is None else str(key), seed)
        if not data or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
            return index.n, "plain", text, None, None
        low, high = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
        (a, a_chars), (b, b_chars) = index.find(low), index.find(high)
        prefix, middle, suffix = (part.decode("utf-8") for part in (data[:a], data[a:b], data[b:]))
        if h4 % 100 < spm_rate:
            form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        else:
            form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
        return index.n, form, output, a_chars, b_chars - a_chars

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *FORM])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for a, b in slices(sizes):
                ids = batch.column(0).slice(a, b - a)
                made = [one(key, text) for key, text in zip(ids.to_pylist(), batch.column(1).slice(a, b - a).to_pylist())]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(column, field.type) for column, field in zip(zip(*made), list(arrow)[1:])]], schema=arrow)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text that a transformed one was made from, by its sentinels."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed, with hashes of the result and of the text rebuilt from it."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, E'[^\n]*\n|[^\n]+') AS lines,
             ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
k AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
             text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain FROM u),
p AS (SELECT *, coalesce(array_to_string(lines[1:a], ''), '') AS pre, coalesce(array_to_string(lines[a + 1:b], ''), '') AS mid, coalesce(array_to_string(lines[b + 1:n], ''), '') AS suf FROM k)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN NOT plain THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN h4 % 100 < 50 THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
