"""Removal of repeated byte strings over a sparse suffix array, sorted deep-shallow."""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import cut, discard, release, slices, table
from statloom.llm.winnow import _mixed

#: Bytes of a gram that names a sampled suffix: two words of eight.
GRAM = 16
#: Bytes that multikey sorting compares, eight at a time, before blind tries take over.
SHALLOW = 40
_ID_NONE = 2**63 - 1
_HIGH = int(sys.byteorder == "little")


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every w consecutive values, by doubling."""
    span, out = 1, x
    while span * 2 <= w:
        out = op(out[:-span], out[span:])
        span *= 2
    return op(out[: len(out) - (w - span)], out[w - span :]) if span < w else out


def _words(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    out = np.empty(len(x) - 7, np.uint64)
    for k in range(min(8, len(out))):
        n = (len(x) - k) // 8
        out[k::8] = x[k : k + 8 * n].view("<u8")
    return out


def anchors(x: np.ndarray, ends: np.ndarray, length: int, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_anchors`, ``step`` positions at a time, so that a step's arrays stay in a core's cache; a suffix depends on ``length`` bytes on either side."""
    found = []
    for begin in range(0, len(x), step):
        lo, hi = max(begin - length, 0), min(begin + step + length, len(x))
        at, h = _anchors(x[lo:hi], ends[lo:hi] - lo, length)
        own = (at + lo >= begin) & (at + lo < begin + step)
        found.append((at[own] + lo, h[own]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.uint64))


def _anchors(x: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled suffixes of concatenated documents: positions and gram hashes.

    In every string of ``length`` bytes inside a document the grams with the
    least order are taken, so equal strings hold equal grams at equal places.
    The order is half of a gram's product; only grams taken get their whole hash.
    ``ends``: for every byte the end of its document.
    """
    n = len(x)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    words = _words(x)
    h = words[:-8] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += words[8:]
    h *= np.uint64(0xFF51AFD7ED558CCD)
    order = h.view(np.uint32)[_HIGH::2] | np.uint32(1)
    w = length - GRAM + 1
    least = _sliding(order, w, np.minimum)
    least[np.arange(len(least)) + length > ends[: len(least)]] = 0
    pad = np.zeros(w - 1, np.uint32)
    most = _sliding(np.concatenate([pad, least, pad]), w, np.maximum)
    at = np.flatnonzero(most[: len(order)] == order)
    return at, _mixed(h[at]) | np.uint64(1)


def contexts(x: np.ndarray, at: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """For each suffix the bytes that any string holding its gram can reach, and how many on either side are real."""
    left, right = length - GRAM, length
    padded = np.concatenate([np.zeros(left, np.uint8), x, np.zeros(right, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, left + right)[at]
    l, r = np.minimum(at - begins[at], left), np.minimum(ends[at] - at, right)
    cols = np.arange(left + right)
    real = (cols >= (left - l)[:, None]) & (cols < (left + r)[:, None])
    return np.concatenate([np.where(real, out, 0), l[:, None], r[:, None]], axis=1).astype(np.uint8)


class BlindTrie:
    """Orders strings of one length: nodes keep only the position of their branch and the branching bytes."""

    def __init__(self):
        self.root = None

    def insert(self, s: bytes, name: int) -> None:
        if self.root is None:
            self.root = (s, [name])
            return
        node = self.root
        while isinstance(node, list):  # blind: positions between branches are not looked at
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        leaf, names = node
        if leaf == s:
            names.append(name)
            return
        lcp = next(i for i, (a, b) in enumerate(zip(s, leaf)) if a != b)
        parent, node = None, self.root
        while isinstance(node, list) and node[0] < lcp:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == lcp:
            node[1][s[lcp]] = (s, [name])
            return
        branch = [lcp, {leaf[lcp]: node, s[lcp]: (s, [name])}]
        if parent is None:
            self.root = branch
        else:
            parent[1][s[parent[0]]] = branch

    def __iter__(self):
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield from node[1]


def deep_shallow(strings: np.ndarray, real: np.ndarray | None = None, shallow: int = SHALLOW) -> np.ndarray:
    """Order of the rows of a byte matrix.

    Multikey sorting over eight-byte characters: every segment of rows that are
    equal so far is split by its next character, all segments at once. What is
    equal over ``shallow`` bytes goes into a blind trie. Equal rows are ordered
    by ``real``, the number of bytes before their zero padding, so that a row
    precedes those it is a prefix of, zero bytes or not.
    """
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    words = padded.view(">u8").astype(np.uint64)
    order = np.arange(n) if real is None else np.argsort(real, kind="stable")
    if n < 2:
        return order
    segment, live = np.zeros(n, np.int64), np.arange(n)
    for depth in range(min(shallow // 8, words.shape[1])):
        own, old = order[live], segment[live]
        by = np.lexsort((words[own, depth], old))
        own, old = own[by], old[by]
        key = words[own, depth]
        order[live] = own
        first = np.flatnonzero(np.concatenate([[True], (old[1:] != old[:-1]) | (key[1:] != key[:-1])]))
        sizes = np.diff(np.append(first, len(live)))
        segment[live] = np.repeat(live[first], sizes)
        live = live[np.repeat(sizes > 1, sizes)]
        if not len(live):
            return order
    if shallow // 8 >= words.shape[1]:  # rows still together are equal
        return order
    cuts = np.flatnonzero(np.concatenate([[True], segment[live][1:] != segment[live][:-1], [True]]))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        trie, at = BlindTrie(), live[lo:hi]
        for i in order[at].tolist():
            trie.insert(strings[i].tobytes(), i)
        order[at] = list(trie)
    return order


def _common(sorted_rows: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Longest common prefix of each row with the one before, within both rows' real bytes."""
    out = np.zeros(len(sorted_rows), np.int64)
    if len(out) > 1:
        differ = sorted_rows[1:] != sorted_rows[:-1]
        first = np.where(differ.any(1), differ.argmax(1), sorted_rows.shape[1])
        out[1:] = np.minimum(first, np.minimum(real[1:], real[:-1]))
    return out


def earlier(ctx: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each context a bit set over its strings: bit j, the string from j bytes before the gram stands in an earlier document too.

    Suffixes are sorted by what follows the gram's start and by what precedes
    it, backwards; a string of j bytes before and length - j after is shared by
    the rows that stay together in both orders at those depths.
    """
    n, left = len(ctx), length - GRAM
    real_l, real_r = ctx[:, -2].astype(np.int64), ctx[:, -1].astype(np.int64)
    right_of, left_of = ctx[:, left:-2], np.ascontiguousarray(ctx[:, left - 1 :: -1][:, :left]) if left else ctx[:, :0]
    by_r, by_l = deep_shallow(np.ascontiguousarray(right_of), real_r), deep_shallow(left_of, real_l)
    lcp_r, lcp_l = _common(right_of[by_r], real_r[by_r]), _common(left_of[by_l], real_l[by_l])
    mask, rank = np.zeros(n, np.int64), np.empty((2, n), np.int64)
    # how far a row agrees with any other; one that does not reach over a string cannot share it
    reach = np.empty((2, n), np.int64)
    reach[0, by_r], reach[1, by_l] = (np.maximum(x, np.append(x[1:], 0)) for x in (lcp_r, lcp_l))
    for j in range(left + 1):
        ok = np.flatnonzero((reach[0] >= length - j) & (reach[1] >= j))
        if not len(ok):
            continue
        rank[0, by_r] = np.cumsum(lcp_r < length - j)
        rank[1, by_l] = np.cumsum(lcp_l < j)
        key = rank[0, ok] * (n + 1) + rank[1, ok]
        by = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
        least = np.repeat(np.minimum.reduceat(doc[ok][by], starts), np.diff(np.append(starts, len(by))))
        mask[ok[by]] |= (least < doc[ok][by]).astype(np.int64) << j
    return mask


class Slice:
    """Some documents joined, with their sampled suffixes."""

    def __init__(self, texts: list[bytes], length: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends_of = np.cumsum(sizes)
        self.x = np.frombuffer(b"".join(texts), np.uint8)
        small = np.int32 if len(self.x) < 1 << 31 else np.int64
        self.ends, self.begins = np.repeat(self.ends_of.astype(small), sizes), np.repeat((self.ends_of - sizes).astype(small), sizes)
        self.at, self.h = anchors(self.x, self.ends, length)
        self.doc = np.searchsorted(self.ends_of, self.at, "right")
        self.h = self.h.view(np.int64)


def _each(batch: pa.RecordBatch, length: int):
    """Slices of a batch whose first columns are doc_id and text."""
    raw = batch.column(1).cast(pa.binary()).to_pylist()
    for a, b in slices([len(r) for r in raw], 1 << 20):
        yield a, b, Slice(raw[a:b], length)


def _member(s: Slice, lists: list) -> np.ndarray:
    """Which suffixes have a gram in their document's sorted list."""
    keep, cuts = np.zeros(len(s.at), bool), np.searchsorted(s.doc, np.arange(len(lists) + 1))
    for i, own in enumerate(lists):
        if own is not None and cuts[i] < cuts[i + 1]:
            h = s.h[cuts[i] : cuts[i + 1]]
            keep[cuts[i] : cuts[i + 1]] = own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h if len(own) else False
    return keep


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of a column of lists of longs, none of them null, without a Python object for each number."""
    values, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(edges[:-1], edges[1:])]


_COEFFICIENTS = np.random.default_rng(5).integers(0, 2**64, (2, 256), np.uint64) | np.uint64(1)
#: For names of contexts: values of the bytes, and the odd base whose powers weigh them, in two independent ways.
_VALUES = np.random.default_rng(6).integers(0, 2**64, (2, 256), np.uint64) | np.uint64(1)
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


def _powers(base: int, n: int) -> np.ndarray:
    return _first_powers(base)[:n] if n <= 1 << 20 else np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


@lru_cache(maxsize=8)
def _first_powers(base: int) -> np.ndarray:
    """Of as many places as a slice mostly has at most, computed once a worker."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full((1 << 20) - 1, base, np.uint64)]))


def _names(ctx: np.ndarray) -> np.ndarray:
    """128-bit names of strings of one length, as two longs in one row: multilinear hashes of their bytes."""
    wide, width = ctx.astype(np.uint64) + np.uint64(1), ctx.shape[1]
    return np.column_stack([_mixed(wide @ c[:width] + c[-1]) for c in _COEFFICIENTS]).view(np.int64).reshape(-1, 2)


def _brief(ctx: np.ndarray) -> np.ndarray:
    """64-bit hashes of contexts, eight bytes at a time, to tell those of one gram apart."""
    n, width = ctx.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = ctx
    words, out = padded.view(np.uint64), np.zeros(n, np.uint64)
    for i in range(words.shape[1]):
        out = _mixed((out ^ words[:, i]) + _COEFFICIENTS[0, i])
    return out


def _context_names(ctx: np.ndarray, length: int) -> np.ndarray:
    """128-bit names of contexts: their real bytes' values, weighed by powers of their distance to the gram."""
    left, width = length - GRAM, 2 * length - GRAM
    cols, l, r = np.arange(width), ctx[:, -2].astype(np.int64)[:, None], ctx[:, -1].astype(np.int64)[:, None]
    real = (cols >= left - l) & (cols < left + r)
    out = []
    for values, base in zip(_VALUES, _BASES):
        weights = _powers(base, width) * np.uint64(pow(base, -left, 1 << 64))
        out.append(_mixed(np.where(real, values[ctx[:, :width]], np.uint64(0)) @ weights))
    return np.column_stack(out).view(np.int64).reshape(-1, 2)


def _slice_names(s: Slice, at: np.ndarray, length: int) -> np.ndarray:
    """The same names for contexts of a slice, from running sums over its bytes."""
    lo, hi = np.maximum(s.begins[at], at - (length - GRAM)), np.minimum(s.ends[at], at + length)
    out = []
    for values, base in zip(_VALUES, _BASES):
        weighed, sums = values.take(s.x, mode="clip"), np.zeros(len(s.x) + 1, np.uint64)
        weighed *= _powers(base, len(s.x))
        np.cumsum(weighed, out=sums[1:])
        back = _powers(pow(base, -1, 1 << 64), len(s.x))
        out.append(_mixed((sums[hi] - sums[lo]) * back[at]))
    return np.column_stack(out).view(np.int64).reshape(-1, 2)


def _sampled(rows: DataFrame, length: int) -> DataFrame:
    """``(h, doc_id, times)``: the grams of each document's sampled suffixes, each once a document."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, _, s in _each(batch, length):
                order = np.lexsort((s.h, s.doc))
                h, d = s.h[order], s.doc[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.empty(0, bool)
                times = np.diff(np.append(np.flatnonzero(new), len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(ids[a + d[new]]), pa.array(times, pa.int64())], ["h", "doc_id", "times"])

    return rows.mapInArrow(run, "h long, doc_id long, times long")


def _shared_grams(sampled: DataFrame) -> DataFrame:
    """``(h, times)``: the grams of two documents or more, and how often they occur."""
    return cut(sampled.groupBy("h").agg(F.count("*").alias("n"), F.sum("times").alias("times")).where("n > 1").select("h", "times"), "grams")


def _suspects(rows: DataFrame, sampled: DataFrame, shared: DataFrame, hot: int) -> DataFrame:
    """The documents with the sorted lists ``hs`` of grams that they share with others and ``hot`` of those that occur more than ``hot`` times.

    The lists are a table of their own, so that the shuffle of all grams is over before texts move.
    """
    lists = cut(sampled.select("h", "doc_id").join(shared, "h").groupBy("doc_id").agg(F.sort_array(F.collect_set("h")).alias("hs"), F.sort_array(F.collect_set(F.when(F.col("times") > hot, F.col("h")))).alias("hot")), "lists")
    release(rows.sparkSession)
    none = F.array().cast("array<long>")
    joined = rows.join(lists, "doc_id", "left")
    part = cut(joined.select("doc_id", "text", F.coalesce("hs", none).alias("hs"), F.coalesce("hot", none).alias("hot")), "suspects")
    discard(lists)
    return part


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a byte matrix as a binary column."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _contexts(part: DataFrame, length: int) -> DataFrame:
    """``(h, ctx, doc_id)``: contexts of the grams that are not hot with their least document; equal ones of a slice are one row.

    A last byte of ``ctx`` tells whether more than one document of the slice has the context.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            hs = [np.setdiff1d(x, y, True) if len(y) else x for x, y in zip(_lists(batch.column(2)), _lists(batch.column(3)))]
            for a, b, s in _each(batch, length):
                keep = np.flatnonzero(_member(s, hs[a:b]))
                if not len(keep):
                    continue
                name, doc = _slice_names(s, s.at[keep], length), ids[a + s.doc[keep]]
                by = np.lexsort((doc, name[:, 1], name[:, 0]))
                name, doc = name[by], doc[by]
                first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]).any(1)]))
                several = doc[first] != doc[np.append(first[1:], len(doc)) - 1]
                once, least = keep[by[first]], doc[first]
                for i in range(0, len(once), 20_000):
                    own = once[i : i + 20_000]
                    ctx = contexts(s.x, s.at[own], s.begins, s.ends, length)
                    ctx = np.column_stack([ctx, several[i : i + 20_000].astype(np.uint8)])
                    yield pa.RecordBatch.from_arrays([pa.array(s.h[own]), _binary(ctx), pa.array(least[i : i + 20_000])], ["h", "ctx", "doc_id"])

    return part.where(F.size("hs") > 0).mapInArrow(run, "h long, ctx binary, doc_id long")


def _hot_contexts(part: DataFrame, length: int, held: int = 100_000) -> DataFrame:
    """``(ctx, doc_id, n)``: contexts of the hot grams with their least document; equal ones of a task are combined, ``held`` at a time."""

    def flush(seen: dict):
        doc, n = zip(*seen.values())
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(doc, pa.int64()), pa.array(n, pa.int64())], ["ctx", "doc_id", "n"])

    def run(batches):
        seen: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            ids, hs = batch.column(0).to_numpy(), _lists(batch.column(3))
            for a, b, s in _each(batch, length):
                keep = np.flatnonzero(_member(s, hs[a:b]))
                ctx = contexts(s.x, s.at[keep], s.begins, s.ends, length)
                size, raw = ctx.shape[1], ctx.tobytes()
                for i, doc in enumerate(ids[a + s.doc[keep]].tolist()):
                    c = raw[i * size : (i + 1) * size]
                    old = seen.get(c)
                    if old is None:
                        seen[c] = (doc, 1)
                    elif old[0] != doc:
                        seen[c] = (min(old[0], doc), 2)
                if len(seen) >= held:
                    yield flush(seen)
                    seen = {}
        if seen:
            yield flush(seen)

    return part.mapInArrow(run, "ctx binary, doc_id long, n long")


def _judge(length: int, most: int):
    """A task's step from rows ``h, ctx, doc_id`` in the order of ``h`` to ``c1, c2, least, mask``, whole groups of about ``most`` rows at a time."""
    size = 2 * length - GRAM + 2

    def judge(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                t = pa.Table.from_batches(held).combine_chunks()
                whole = pc.index(t["h"], t["h"][-1]).as_py()
                if whole:
                    yield decide(t.slice(0, whole))
                held, rows = t.slice(whole).to_batches(), t.num_rows - whole
        if rows:
            yield decide(pa.Table.from_batches(held))

    def decide(t):
        raw = np.frombuffer(b"".join(t["ctx"].to_pylist()), np.uint8).reshape(-1, size + 1)
        ctx, apart = np.ascontiguousarray(raw[:, :size]), raw[:, size] != 0
        doc, h, brief = t["doc_id"].to_numpy(), t["h"].to_numpy(), _brief(ctx)
        by = np.lexsort((doc, brief, h))
        first = np.flatnonzero(np.concatenate([[True], (h[by][1:] != h[by][:-1]) | (brief[by][1:] != brief[by][:-1])]))
        last = np.append(first[1:], len(by)) - 1
        several = (doc[by][first] != doc[by][last]) | np.logical_or.reduceat(apart[by], first)
        ctx, doc, h = ctx[by[first]], doc[by[first]], h[by[first]]
        edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        times = np.diff(np.append(edges, len(h)))
        mixed = np.flatnonzero(np.repeat(times > 1, times))
        mask = np.zeros(len(doc), np.int64)
        mask[mixed] = earlier(ctx[mixed], doc[mixed], length)
        say = (mask != 0) | several
        name = _context_names(ctx[say], length)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in (name[:, 0], name[:, 1], doc[say], mask[say])], ["c1", "c2", "least", "mask"])

    return judge


def _hot_marks(part: DataFrame, length: int, most: int) -> DataFrame:
    """:func:`_marks` of the hot grams: no task sees all contexts of a gram.

    A string that holds a gram also holds what follows it for about half of the
    remaining bytes, or what precedes it; so contexts meet by these two longer
    keys, where no more than ``most`` have one, two rows for a context. Contexts of more
    frequent keys are combined by string: a batch judges its own first, and only
    strings that it has not seen in an earlier document travel, once for a batch
    and document, so that rows do not grow with the contexts of a string but
    with the batches that hold it.
    """
    left, size = length - GRAM, 2 * length - GRAM + 2
    half = left // 2
    found = _hot_contexts(part.where(F.size("hot") > 0), length)
    found = cut(found.groupBy("ctx").agg(F.min("doc_id").alias("doc_id"), ((F.max("n") > 1) | (F.min("doc_id") != F.max("doc_id"))).alias("several")), "hot")

    def named(batches):
        for batch in batches:
            if batch.num_rows:
                ctx = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, size)
                name = _context_names(ctx, length)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(name[:, 0])), pa.array(np.ascontiguousarray(name[:, 1])), batch.column(1), batch.column(2)], ["c1", "c2", "least", "several"])

    def keys(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ctx, doc = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, size), batch.column(1).to_numpy()
            sides = (ctx[:, -1] >= length - half, slice(left, left + length - half)), (ctx[:, -2] > half, slice(left - half - 1, left + GRAM))
            for before, (real, cols) in enumerate(sides):
                ok = np.flatnonzero(real)
                rows = np.column_stack([ctx[ok], np.zeros(len(ok), np.uint8)])
                columns = [pa.array(np.ascontiguousarray(_names(ctx[ok, cols])[:, before])), _binary(rows), pa.array(doc[ok]), pa.array(np.full(len(ok), bool(before)))]
                yield pa.RecordBatch.from_arrays(columns, ["h", "ctx", "doc_id", "before"])

    def strings(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ctx = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, size + 1)[:, :size]
            doc, before, name = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), _context_names(ctx, length)
            told = earlier(ctx, doc, length)
            for j in range(left + 1):
                ok = np.flatnonzero((ctx[:, -2] >= j) & (ctx[:, -1] >= length - j) & (told >> j & 1 == 0) & (before == (j > half)))
                own = _names(ctx[ok, left - j : left - j + length])
                columns = (own[:, 0], own[:, 1], name[ok, 0], name[ok, 1], doc[ok], np.full(len(ok), 1 << j, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in columns], ["s1", "s2", "c1", "c2", "doc_id", "bit"])
            some = np.flatnonzero(told)
            none = pa.nulls(len(some), pa.int64())
            columns = [none, none, pa.array(np.ascontiguousarray(name[some, 0])), pa.array(np.ascontiguousarray(name[some, 1])), none, pa.array(told[some])]
            yield pa.RecordBatch.from_arrays(columns, ["s1", "s2", "c1", "c2", "doc_id", "bit"])

    keyed = cut(found.mapInArrow(keys, "h long, ctx binary, doc_id long, before boolean"), "keys")
    frequent = cut(keyed.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > most).select("h"), "frequent")
    judged = keyed.join(F.broadcast(frequent), "h", "left_anti").select("h", "ctx", "doc_id").repartition("h").sortWithinPartitions("h")
    judged = judged.mapInArrow(_judge(length, most), "c1 long, c2 long, least long, mask long").select("c1", "c2", F.col("mask").alias("bit"))
    # rows without a string hold what a batch tells of a context by itself
    many = keyed.join(F.broadcast(frequent), "h", "left_semi").select("ctx", "doc_id", "before")
    each = cut(many.mapInArrow(strings, "s1 long, s2 long, c1 long, c2 long, doc_id long, bit long"), "strings")
    firsts = each.where("s1 IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("first"))
    later = each.join(firsts, ["s1", "s2"]).where("first < doc_id").select("c1", "c2", "bit")
    masks = later.unionByName(each.where("s1 IS NULL").select("c1", "c2", "bit")).unionByName(judged).groupBy("c1", "c2").agg(F.bit_or("bit").alias("mask"))
    told = found.mapInArrow(named, "c1 long, c2 long, least long, several boolean").join(masks, ["c1", "c2"], "left")
    return told.where("several OR mask IS NOT NULL").select("c1", "c2", "least", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))


def _marks(part: DataFrame, length: int, most: int = 100_000) -> DataFrame:
    """``(c1, c2, least, mask)`` by context: its least document, and which of its strings stand in an even earlier one.

    The contexts of a gram that is not hot meet in one task and are judged with those of other grams, about ``most`` at a time;
    contexts without any earlier string or second document are left out.
    """
    cold = _contexts(part, length).repartition("h").sortWithinPartitions("h").mapInArrow(_judge(length, most), "c1 long, c2 long, least long, mask long")
    # one after the other, so that the shuffles of both do not lie on disk together
    cold = cut(cold, "cold")
    release(part.sparkSession)
    marks = cut(cold.unionByName(_hot_marks(part, length, most)), "marks")
    discard(cold)
    return marks


def _replies(part: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """The marks of each document's own contexts; mask -1: the whole context stands in an earlier document."""

    def run(batches):
        for batch in batches:
            ids, hs = batch.column(0).to_numpy(), _lists(batch.column(2))
            for a, b, s in _each(batch, length):
                keep = np.flatnonzero(_member(s, hs[a:b]))
                name = _slice_names(s, s.at[keep], length)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in (ids[a + s.doc[keep]], name[:, 0], name[:, 1])], ["doc_id", "c1", "c2"])

    told = part.where(F.size("hs") > 0).mapInArrow(run, "doc_id long, c1 long, c2 long").join(marks, ["c1", "c2"])
    told = told.select("doc_id", "c1", "c2", F.when(F.col("doc_id") > F.col("least"), F.lit(-1).cast("long")).otherwise(F.col("mask")).alias("mask"))
    return told.where("mask != 0").groupBy("doc_id").agg(F.collect_set(F.struct("c1", "c2", "mask")).alias("marks"))


def _looked_up(doc: np.ndarray, name: np.ndarray, of: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The mask of each (document, name) among rows (c1, c2, mask) of documents ``of``; 0 if there is none."""
    n = len(of)
    keys = np.column_stack([np.concatenate([of, doc]), np.concatenate([known[:, :2], name])])
    # a row of what is known precedes those that ask for it
    by = np.lexsort((np.arange(len(keys)) >= n, keys[:, 2], keys[:, 1], keys[:, 0]))
    new = np.concatenate([[True], (keys[by][1:] != keys[by][:-1]).any(1)]) if len(by) else np.empty(0, bool)
    first = by[new][np.cumsum(new) - 1]
    out = np.zeros(len(keys), np.int64)
    out[by] = np.where(first < n, np.append(known[:, 2], 0)[np.minimum(first, n)], 0)
    return out[n:]


def _cleaned(part: DataFrame, replies: DataFrame, length: int) -> DataFrame:
    """Each document with what its marks leave; one without marks is not sampled again."""
    left = length - GRAM

    def run(batches):
        for batch in batches:
            kept = batch.column(1).cast(pa.binary()).to_pylist()
            sizes, removed, spans = np.array([len(t) for t in kept], np.int64), np.zeros(len(kept), np.int64), np.zeros(len(kept), np.int64)
            marked, told = batch.column(3), batch.column(3).values
            edges_of, known = marked.offsets.to_numpy(), np.column_stack([told.field(i).to_numpy(zero_copy_only=False) for i in range(3)])
            times, hs = np.diff(edges_of), _lists(batch.column(2))
            has = np.flatnonzero(times)
            for a, b in slices(sizes[has].tolist(), 1 << 20):
                own = has[a:b]
                s = Slice([kept[i] for i in own], length)
                edge = np.zeros(len(s.x) + 1, np.int64)
                # documents between these have no marks, so that theirs follow each other
                marks = known[edges_of[own[0]] : edges_of[own[-1] + 1]]
                keep = np.flatnonzero(_member(s, [hs[i] for i in own]))
                mask = _looked_up(s.doc[keep], _slice_names(s, s.at[keep], length), np.repeat(np.arange(len(own)), times[own]), marks)
                at = s.at[keep]
                whole = at[mask == -1]
                lo, hi = np.maximum(s.begins[whole], whole - left), np.minimum(s.ends[whole], whole + length)
                real = hi - lo >= length
                np.add.at(edge, lo[real], 1)
                np.add.at(edge, hi[real], -1)
                some = np.flatnonzero(mask > 0)
                for j in range(left + 1):
                    begin = at[some[mask[some] >> j & 1 == 1]] - j
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + length, -1)
                gone = np.cumsum(edge)[:-1] > 0
                for i, lo, hi in zip(own.tolist(), [0, *s.ends_of[:-1].tolist()], s.ends_of.tolist()):
                    mine = gone[lo:hi]
                    removed[i] = mine.sum()
                    spans[i] = (np.diff(np.concatenate([[0], mine.astype(np.int8)])) == 1).sum()
                    kept[i] = s.x[lo:hi][~mine].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes), pa.array(removed), pa.array(spans), pa.array(kept, pa.binary())], ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    schema = "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept binary"
    return part.join(replies, "doc_id", "left").select("doc_id", "text", "hs", "marks").mapInArrow(run, schema)


def dedup_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, hot: int = 10_000) -> DataFrame:
    """Bytes of each document covered by a ``length``-byte string that also starts in a document with a smaller id.

    1. Every string holds at least one sampled suffix (about one in 18 bytes).
       Spark counts the documents of each suffix's gram, combined before the
       shuffle, a document once; only grams of two documents or more go on.
    2. Documents with such grams give the contexts of those suffixes, equal
       ones of a megabyte of text once, with the least id.
    3. The contexts of a gram meet in one task and are sorted there
       deep-shallow; the common prefixes in both orders tell which strings
       stand in earlier documents. Contexts of a gram that occurs more than
       ``hot`` times meet by longer keys instead, and where these are too
       frequent, strings get their least document by a combined aggregate.
    4. Marks go back to the documents, which drop the covered bytes.

    Returns ``doc_id, text, n_bytes, n_removed, n_spans, kept`` (binary). Strings
    are judged on the input. A null text is empty. Rows with equal ids do not
    remove each other's bytes; rows with a null id come after all ids. Texts
    shorter than ``length`` keep all. Ids are whole numbers below 2**63 - 1;
    ``length`` lies between 17 and 78. An empty table gives no row. Other
    columns are not read. Each step ends in a table in the shared folder.
    """
    if not GRAM < length <= GRAM + 62:
        raise ValueError(f"length must lie between {GRAM + 1} and {GRAM + 62}")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_ID_NONE)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sampled = cut(_sampled(rows, length), "sampled")
    shared = _shared_grams(sampled)
    release(docs.sparkSession)
    part = _suspects(rows, sampled, shared, hot)
    discard(shared)
    discard(sampled)
    release(docs.sparkSession)
    marks = _marks(part, length)
    release(docs.sparkSession)
    replies = cut(_replies(part, marks, length), "replies")
    discard(marks)
    release(docs.sparkSession)
    return _cleaned(part, replies, length).withColumn("doc_id", F.nullif("doc_id", F.lit(_ID_NONE)))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_strings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
