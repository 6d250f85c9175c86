"""Benchmark decontamination by winnowing."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import append_columns, cut, table

#: Words are runs of 0-9, a-z and all characters beyond ASCII, after lower-casing A-Z.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_BASE = np.uint64(0x9E3779B97F4A7C15)
RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
]


def words(text: str) -> list[str]:
    if not text.isascii():
        return WORD.findall(text.translate(_LOWER))
    return WORD.findall(text.lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x, out = _mixed(ids.astype(np.uint64) + np.uint64(1)), np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _BASE + x[j : j + n]
    return _mixed(out)


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the minimum of every ``window`` consecutive hashes, the leftmost on ties."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, window):
        less = hashes[j : j + n] < best
        best[less] = hashes[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    return np.unique(at)


class BenchmarkIndex:
    """Fingerprints of a block of benchmark items, and the items' words to verify hits against."""

    def __init__(self, items: list[tuple[str, str]], window: int, k: int):
        self.window, self.k, self.names = window, k, [i for i, _ in items]
        self.vocab: dict[str, int] = {}
        parts, owner, by_length = [], [], defaultdict(list)
        at = 0
        for n, (_, text) in enumerate(items):
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            by_length[min(len(ids), window)].append((at, len(ids)))
            parts += [ids, [-1]]
            owner += [n] * (len(ids) + 1)
            at += len(ids) + 1
        self.ids = np.array([x for p in parts for x in p] + [-1] * window, np.int64)
        self.owner = np.array(owner + [0] * window, np.int64)
        #: For each window length: k, the fingerprints in order, and where in ``ids`` each stands.
        self.prints = []
        for length, spans in sorted(by_length.items()):
            if not length:
                continue
            gram = k if length == window else length  # a short item is one window and its own fingerprint
            hashes = gram_hashes(self.ids, gram)
            where = np.unique(np.concatenate([a + winnowed(hashes[a : a + n - gram + 1], length - gram + 1) for a, n in spans]))
            order = np.argsort(hashes[where], kind="stable")
            self.prints.append((length, gram, hashes[where][order], where[order]))

    def hits(self, docs: list[list[str]]):
        """Per document: which words are hit, and the items that hit them."""
        get, w = self.vocab.get, self.window
        gap = [-2] * w  # no window reaches over it
        ids = np.array([x for d in docs for x in (*(get(t, 0) for t in d), *gap)], np.int64)
        starts = np.cumsum([0] + [len(d) + w for d in docs])
        edge, found = np.zeros(len(ids) + 1, np.int64), set()
        for length, gram, hashes, where in self.prints:
            mine = gram_hashes(ids, gram)
            at = winnowed(mine, length - gram + 1)
            at = at[ids[at] > 0]
            lo, hi = np.searchsorted(hashes, mine[at]), np.searchsorted(hashes, mine[at], "right")
            times = hi - lo
            p = np.repeat(at, times)
            q = where[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            same = np.ones(len(p), bool)
            for j in range(gram):
                same &= ids[p + j] == self.ids[q + j]
            p, q = p[same], q[same]
            left, right = np.zeros(len(p), np.int64), np.full(len(p), gram)
            for step in range(length - gram):  # as far as windows that hold the fingerprint reach
                a, b = p - step - 1, q - step - 1
                ok = (left == step) & (a >= 0) & (b >= 0)
                ok[ok] = (ids[a[ok]] == self.ids[b[ok]]) & (ids[a[ok]] > 0)
                left += ok
                more = (right == gram + step) & (ids[p + gram + step] == self.ids[q + gram + step]) & (ids[p + gram + step] > 0)
                right += more
            ok = left + right >= length
            p, q, left, right = p[ok], q[ok], left[ok], right[ok]
            np.add.at(edge, p - left, 1)
            np.add.at(edge, p + right, -1)
            doc = np.searchsorted(starts, p, "right") - 1
            found.update(zip(doc.tolist(), self.owner[q].tolist()))
        return np.cumsum(edge)[:-1] > 0, starts, found


def _runs(mask: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges.reshape(-1, 2).tolist()


def _step(index: BenchmarkIndex):
    def step(texts: list[str | None]) -> list[list]:
        docs = [words(t) if t else [] for t in texts]
        mask, starts, found = index.hits(docs)
        items = defaultdict(set)
        for d, i in found:
            items[d].add(index.names[i])
        own = [mask[a : a + len(d)] for a, d in zip(starts, docs)]
        return [
            [len(d) for d in docs],
            [int(m.sum()) for m in own],
            [sorted(items.get(i, ())) for i in range(len(docs))],
            [_runs(m) if m.any() else [] for m in own],
        ]

    return step


_INDEXED: dict[str, BenchmarkIndex] = {}


def _index(name: str, handle, window: int, k: int) -> BenchmarkIndex:
    """The index of a block, built once a worker; a worker keeps that of its last block only."""
    if name not in _INDEXED:
        _INDEXED.clear()
        _INDEXED[name] = BenchmarkIndex(handle.value, window, k)
    return _INDEXED[name]


def mark_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    k: int = 5,
    block_bytes: int = 64 << 20,
) -> tuple[DataFrame, list[str]]:
    """Words of each document inside any occurrence of ``window`` consecutive words of a benchmark item.

    Every window of ``window - k + 1`` k-grams keeps its least hash, in items
    and documents alike, so any shared run of ``window`` words shares a
    fingerprint. Fingerprints join by value inside the scan of the documents,
    hits are verified and extended word by word: the result is exact. An item
    of fewer words (but not none) is one window with one fingerprint.

    The benchmark is read in blocks of about ``block_bytes`` of text, whose
    size Spark counts first; only one block at a time is sent to the tasks, and
    the documents are never shuffled. With several blocks the spans found so
    far travel with the rows.

    Null or empty texts have no words and no hit. Repeated documents give
    repeated rows; items with equal ids count once; an item with a null id has
    the id ``''``. An empty benchmark hits nothing. Returns the rows with
    ``n_words, n_hit, items`` (sorted), ``hit_spans`` ([start, end) in words)
    appended, and the positional names of the original columns.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text")
    ).where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total // block_bytes) + 1
    out, names = None, []
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        handle = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])

        def make(handle=handle, name=uuid.uuid4().hex):
            return _step(_index(name, handle, window, k))

        if out is None:
            out, names = append_columns(docs, text_col, make, RESULT)
        else:
            before = [f"{f.name}_before" for f in RESULT]
            kept = out.toDF(*names, *before)
            at = names[docs.columns.index(text_col)]
            new, inner = append_columns(kept, at, make, RESULT)
            new = new.withColumnsRenamed(dict(zip(inner, kept.columns)))
            spans = _merged(F.concat("hit_spans_before", "hit_spans"))
            out = new.select(
                *names,
                "n_words",
                F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0]).alias("n_hit"),
                F.array_sort(F.array_union("items_before", "items")).alias("items"),
                spans.alias("hit_spans"),
            )
        if block < blocks - 1:
            out = cut(out, "marked")
    return out, names


def _merged(spans):
    """Union of [start, end) spans, in order."""
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast("array<array<bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)[1] >= x[0]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(acc, -1)[1], x[1]))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without any hit, with their own columns."""
    marked, names = mark_contaminated(docs, benchmark, text_col, **options)
    return marked.where("n_hit = 0").select(*names).toDF(*docs.columns)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked, names = mark_contaminated(docs, table(spark, sf_dir, "benchmark"))
    return marked.select(
        F.col(names[0]).alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM d, (SELECT DISTINCT n FROM bw) AS k, unnest(range(1, len(w) - n + 2)) AS u(i)
), hit AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.gram = bw.gram
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, n)) AS u(j) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
