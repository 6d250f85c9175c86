"""Near-duplicate documents by BagMinHash signatures of word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import append_columns, cut, discard, release, table
from statloom.llm.components import components
from statloom.llm.tokens import _Cache
from statloom.llm.winnow import _mixed, gram_hashes, words

#: Bits that hold the parities of a bag's elements, for an exact bound on what two bags do not share.
PARITY = 1024
_WORD_HASH = _Cache(lambda w: xxhash.xxh3_64_intdigest(w))


def shingles(text: str | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of a text as hashes, and how often each stands; fewer words are one shingle."""
    found = words(text) if text else []
    ids = np.fromiter(map(_WORD_HASH.__getitem__, found), np.uint64, len(found))
    return np.unique(gram_hashes(ids, max(1, min(k, len(ids)))) if len(ids) else ids, return_counts=True)


def _uniform(seed: np.ndarray) -> np.ndarray:
    """Open (0, 1) from hashes."""
    return ((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """BagMinHash registers (one row a bag): two bags agree in a register with probability their weighted Jaccard.

    Weights are discretised at the integers. The weight axis of an element is
    cut into dyadic intervals [0,1), [1,2), [2,4), [4,8), ...; each has its own
    Poisson process, whose rate is the interval's length and whose points carry
    a register and, by halving the interval down to a unit cell, a weight. A
    bag sees the points whose cell lies below its element's weight, so bags of
    different weights share points. A register keeps the earliest point. Points
    come in order of time and a process stops once it is later than all
    registers of its bag.
    """
    n = len(bags)
    h = np.full((n, m), np.inf)
    sizes = np.array([len(b[0]) for b in bags])
    if not sizes.sum():
        return h
    key = np.concatenate([b[0] for b in bags])
    weight = np.concatenate([b[1] for b in bags]).astype(np.int64)
    bag = np.repeat(np.arange(n), sizes)
    levels = np.ceil(np.log2(weight)).astype(np.int64) + 1
    at = np.repeat(np.arange(len(key)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    begin = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(begin, 1)
    seed = _mixed(key[at] + (level.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    bag, limit, time = bag[at], weight[at], np.zeros(len(at))
    flat = h.reshape(-1)
    while len(seed):
        seed = _mixed(seed + np.uint64(0xD1B54A32D192ED03))
        time = time - np.log(_uniform(seed)) / width
        pick = _mixed(seed ^ np.uint64(0x8CB92BA72F3D8DD7))
        register = (pick >> np.uint64(32)).astype(np.int64) * m >> 32
        cell = begin + ((pick & np.uint64(0xFFFFFFFF)).astype(np.int64) * width >> 32)
        seen = cell < limit
        np.minimum.at(flat, bag[seen] * m + register[seen], time[seen])
        left = np.unique(bag)
        last = np.zeros(n)
        last[left] = h[left].max(1)
        go = time < last[bag]
        seed, time, bag, width, begin, limit = seed[go], time[go], bag[go], width[go], begin[go], limit[go]
    return h


def band_keys(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key a band: the hash of its registers and its number."""
    bits = h[:, : bands * rows].copy().view(np.uint64).reshape(len(h), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), bits.shape[:2]).copy()
    for j in range(rows):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, j])
    return key.view(np.int64)


def sketches(h: np.ndarray) -> np.ndarray:
    """Four bits of each register, sixteen registers a long."""
    bits = np.where(np.isfinite(h), h, 0).view(np.uint64)
    four = np.zeros((len(h), -(-h.shape[1] // 16) * 16), np.uint64)
    four[:, : h.shape[1]] = _mixed(bits) & np.uint64(15)
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return (four.reshape(len(h), -1, 16) << shifts).sum(2, dtype=np.uint64).view(np.int64)


def agreeing(a: Column, b: Column, m: int) -> Column:
    """Registers whose four bits agree in two sketches of ``m`` registers."""
    unlike = F.lit(0)
    for i in range(-(-m // 16)):
        x = a[i].bitwiseXOR(b[i])
        for shift in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        unlike = unlike + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return F.lit(m) - unlike


def least_agreeing(threshold: float, m: int) -> int:
    """Fewer agreeing registers has a pair at ``threshold`` less than once in a million (five standard deviations)."""
    p = threshold + (1 - threshold) / 16
    return int(np.floor(m * p - 5 * np.sqrt(m * p * (1 - p))))


def elements(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A multiset as a set: sorted hashes of each shingle and the number of its occurrence."""
    x, times = bag
    turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.sort(_mixed(np.repeat(x, times) + turn.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))


def parities(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``PARITY`` bits a bag: bit i tells whether an odd number of its elements falls into cell i."""
    each = [elements(b) for b in bags]
    at = np.repeat(np.arange(len(each)) * PARITY, [len(x) for x in each]) + (np.concatenate(each) >> np.uint64(32)).astype(np.int64) % PARITY
    odd = np.bincount(at, minlength=len(each) * PARITY) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(each), PARITY), axis=1).view(np.int64)


def _parted(a: str, b: str, threshold: float) -> Column:
    """Whether two multisets surely overlap by less than ``threshold``: by their sizes, or as more parities differ than elements may.

    Both bounds are exact: every differing parity takes an element that only
    one of the two has.
    """
    n, m = F.col(f"{a}size"), F.col(f"{b}size")
    unlike = F.lit(0)
    for i in range(PARITY // 64):
        unlike = unlike + F.bit_count(F.col(f"{a}parity")[i].bitwiseXOR(F.col(f"{b}parity")[i]))
    return (F.least(n, m) < threshold * F.greatest(n, m)) | (unlike * (1 + threshold) > (1 - threshold) * (n + m) + 1e-6)


def node_of(text: Column) -> Column:
    """Documents of equal text are one node, named by 128 bits of the text's SHA-256; null is empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)), 1, 16)


def _bags(k: int):
    def run(batches):
        for batch in batches:
            for texts_at in range(0, batch.num_rows, 256):
                part = batch.slice(texts_at, 256)
                bags = [elements(shingles(t, k)).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bags, pa.binary())], ["node", "bag"])

    return run


def _overlaps(threshold: float):
    def run(batches):
        last, x = None, None
        for batch in batches:
            keep = []
            for a, y, ta in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(2)):
                if a != last:  # rows of one hub come in a row
                    last, x = a, np.frombuffer(ta.as_py(), np.uint64)
                y = np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return run


def _bagged(bucket: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``(node, bag)`` of the nodes of ``bucket``: the one step in which texts move.

    The join is a merge at every size, as only then does it grow in proportion.
    """
    texts = docs.join(bucket.select("node").hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    return cut(texts.mapInArrow(_bags(k), "node binary, bag binary"), "bags")


def verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Pairs of nodes whose shingle multisets overlap by ``threshold`` at least (intersection over union).

    ``b`` takes its own multiset along to ``a``, where that of ``a`` is there
    but once, so ``a`` should be the hub.
    """
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    mine = cut(bags.join(wanted.hint("merge"), "node", "left_semi"), "wanted")
    both = pairs.join(mine.select(F.col("node").alias("b"), F.col("bag").alias("y")), "b").join(mine.select(F.col("node").alias("a"), F.col("bag").alias("x")), "a")
    links = cut(both.select("a", "b", "x", "y").mapInArrow(_overlaps(threshold), "a binary, b binary"), "links")
    discard(mine)
    return links


def _buckets(signed: DataFrame) -> DataFrame:
    """``(node, shared, weight, size, sketch, parity)`` of the nodes that share a band: their shared bands, and how many nodes those hold in all."""
    told = F.struct("bands", "size", "sketch", "parity")
    nodes = cut(signed.groupBy("node").agg(F.first(told).alias("t")).select("node", "t.*"), "nodes")
    member = nodes.select("node", F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    own = member.join(shared, "band").groupBy("node").agg(F.collect_list("band").alias("shared"), F.sum("n").alias("weight"))
    out = cut(own.join(nodes.drop("bands"), "node"), "buckets")
    discard(nodes)
    return out


def _open_buckets(bucket: DataFrame, links: DataFrame | None) -> DataFrame:
    """Members of the buckets that hold more than one group: ``node, root, weight, size, sketch, parity`` and the array ``shared`` of such buckets."""
    if links is None:
        return bucket.withColumn("root", F.col("node"))
    roots = components(links)
    grouped = cut(bucket.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "grouped")
    discard(roots)
    each = grouped.select("node", "root", F.explode("shared").alias("band"))
    mixed = each.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("band")
    own = each.join(mixed, "band").groupBy("node").agg(F.collect_list("band").alias("shared"))
    out = cut(grouped.drop("shared").join(own, "node"), "open")
    discard(grouped)
    return out


def _hub_pairs(open_: DataFrame, round_: int, hubs: int, threshold: float, m: int, least: int) -> DataFrame:
    """``(a, b)``: each node b with the hub a of its buckets that has the most registers in common with it.

    In the first round a bucket's hub is the node with the most neighbours over
    all its buckets, such as the original of many variants; later any by a hash.
    """
    first = F.xxhash64("node", F.pmod("band", F.lit(hubs)), F.lit(round_)) if round_ else -F.col("weight")
    told = ["node", "root", "size", "sketch", "parity"]
    each = open_.select(F.explode("shared").alias("band"), "weight", *told)
    hub = each.groupBy("band").agg(F.min(F.struct(first.alias("first"), *told)).alias("hub")).select("band", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in told])
    same = agreeing(F.col("sketch"), F.col("hub_sketch"), m)
    held = each.join(hub, "band").where((F.col("root") != F.col("hub_root")) & (same >= least) & ~_parted("", "hub_", threshold))
    best = held.select("node", F.struct(same.alias("same"), "hub_node").alias("h")).groupBy("node").agg(F.max("h").alias("h"))
    return best.select(F.col("h.hub_node").alias("a"), F.col("node").alias("b"))


def _rest_pairs(open_: DataFrame, threshold: float, m: int, least: int) -> DataFrame:
    told = ["node", "root", "size", "sketch", "parity"]
    each = open_.select(F.explode("shared").alias("band"), *told)
    other = each.select("band", *[F.col(c).alias(f"b_{c}") for c in told])
    close = (agreeing(F.col("sketch"), F.col("b_sketch"), m) >= least) & ~_parted("", "b_", threshold)
    return each.join(other, "band").where((F.col("node") < F.col("b_node")) & (F.col("root") != F.col("b_root")) & close).select(F.col("node").alias("a"), F.col("b_node").alias("b")).distinct()


def _linked(bucket: DataFrame, named: DataFrame, k: int, threshold: float, m: int, star_rounds: int, hubs: int) -> DataFrame:
    """Verified links that connect every group."""
    links, least = None, least_agreeing(threshold, m)
    bags = _bagged(bucket, named, k)
    release(named.sparkSession)
    for round_ in range(star_rounds + 1):
        open_ = _open_buckets(bucket, links)
        if links is not None and not open_.limit(1).count():
            discard(open_)
            break
        pairs = cut(_hub_pairs(open_, round_, hubs, threshold, m, least) if round_ < star_rounds else _rest_pairs(open_, threshold, m, least), "pairs")
        found = verified(pairs, bags, threshold)
        discard(pairs)
        if round_:
            discard(open_)
        old, links = links, found if links is None else cut(links.unionByName(found), "links")
        if old is not None:
            discard(old)
            discard(found)
    discard(bags)
    return links


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    threshold: float = 0.8,
    bands: int = 25,
    rows: int = 5,
    star_rounds: int = 3,
    hubs: int = 5,
) -> DataFrame:
    """``(doc_id, node, class_id, class_size)`` for every document; equal class ids are near-duplicates.

    Two texts are linked if a band of their signatures agrees and the multisets
    of their k-word shingles overlap by ``threshold``; classes are the
    connected groups. At similarity 0.8 a pair shares none of 25 bands of 5
    registers once in 20,000.

    Equal texts are one node from the start. Within a bucket (equal band) every
    node is first held against a hub only: the node with the most neighbours,
    in later rounds one by a hash that changes with the round and takes ``hubs``
    turns over the bands; of its hubs the one with the most agreeing registers
    is verified. What joins a hub's group needs no further pair in it. After
    ``star_rounds`` rounds all pairs of a bucket whose ends still lie in
    different groups are compared, so no link between groups is lost, while a
    group of n like texts costs about n pairs. A pair is refused before its
    multisets travel if their sizes or the parities of their elements rule out
    ``threshold`` (exact bounds), or if so few registers agree as happens less
    than once in a million at ``threshold``.

    A null text is empty; texts without words are near-duplicates of equal
    texts only. Texts of fewer words than ``k`` are one shingle. The class id is
    the least document id in it (null if it has none); rows that repeat are
    members of one class. An empty table gives no row. Other columns are not
    read.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("node", node_of(F.col("text")))

    m = bands * rows

    def make():
        def step(texts):
            bags = [shingles(t, k) for t in texts]
            h = signatures(bags, m)
            keys, some = band_keys(h, bands, rows), np.isfinite(h[:, 0])
            sizes = [int(times.sum()) for _, times in bags]
            return [[x.tolist() if ok else [] for x, ok in zip(keys, some)], sizes, sketches(h).tolist(), parities(bags).tolist()]

        return step

    longs = T.ArrayType(T.LongType())
    fields = [T.StructField("bands", longs), T.StructField("size", T.LongType()), T.StructField("sketch", longs), T.StructField("parity", longs)]
    signed, at = append_columns(named, "text", make, fields)
    signed = cut(signed.select(F.col(at[0]).alias("doc_id"), F.col(at[2]).alias("node"), *[f.name for f in fields]), "signed")
    bucket = _buckets(signed)
    release(docs.sparkSession)
    links = _linked(bucket, named, k, threshold, m, star_rounds, hubs)
    discard(bucket)
    roots = components(links)
    discard(links)
    rooted = signed.select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rooted.join(classes, "root").select("doc_id", "node", "class_id", "class_size")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class stays, that with the least id; of rows that repeat it one."""
    found = near_duplicates(docs, id_col, text_col, **options)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    best = found.groupBy(F.col("class_id"), F.when(F.col("class_id").isNull(), F.col("node")).alias("lone")).agg(F.min(first).alias("w"))
    winner = best.select(F.col("w.doc_id").alias("w_id"), F.col("w.node").alias("w_node"))
    same = found.join(winner, (found["node"] == F.col("w_node")) & found["doc_id"].eqNullSafe(F.col("w_id")))
    counted = same.groupBy("w_node", "w_id").agg(F.count("*").alias("w_n"))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    text, key = names[docs.columns.index(text_col)], names[docs.columns.index(id_col)]
    rows = rows.withColumn("_node", node_of(F.col(text)))
    kept = rows.join(counted, (F.col("_node") == F.col("w_node")) & F.col(key).cast("long").eqNullSafe(F.col("w_id")))
    once = kept.where("w_n = 1").select(*names)
    many = kept.where("w_n > 1").dropDuplicates(["_node", "w_id"]).select(*names)
    return once.unionByName(many).toDF(*docs.columns)


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
