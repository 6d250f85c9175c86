"""Merkle manifest of a dataset, built and verified in supersteps over an RDD of runs.

Each row is a leaf; the leaves of a source, in order of id, make a tree of runs
of 16, and the roots of the sources, in order of source, make one more tree. A
run of nodes is a vertex. Upward, a complete run hashes its nodes and sends the
digest to the run above, until a tree has one node left; downward, a run sends
each of its nodes' runs the path of siblings from there to the root, so that
leaves can be verified where they lie. A superstep moves one message a node,
keyed by (tree, run), so that a source of any size is spread evenly; each ends
in a table in the shared folder.

Defined results: leaves of a source that share an id are ordered by their
digest, a null id comes first, a null source is a source of its own and comes
first; null fields are hashed as ``-``; repeated rows are leaves each; an empty
table has no leaves and no root; other columns are not part of a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statloom.llm.common import cut, table

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = "tree long, run long, n long, nodes array<binary>"


def leaf_digest(fields: Iterable[Column]) -> Column:
    """SHA-256 of the fields in a row, each with its length in bytes, ``-`` where it is null."""

    def coded(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[coded(c) for c in fields]), 256)


def node_digest(nodes: Sequence[bytes]) -> bytes:
    """SHA-256 of digests in a row, as hex text."""
    return hashlib.sha256("".join(bytes(x).hex() for x in nodes).encode()).digest()


def placed(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``place`` (from 0, in ``order`` within ``by``) and ``n`` (rows of ``by``); no task sees a whole group.

    Rows are range partitioned and written in order; a group's rows in a
    partition follow each other there, so only one row for each group and
    partition is summed up.
    """
    names = [f"_k{i}" for i in range(len(by))]
    spread = df.withColumns({"_row": F.monotonically_increasing_id(), "_one": F.lit(1), **{k: F.col(c) for k, c in zip(names, by)}})
    spread = spread.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (*names, *order, "_row")]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in (*names, *order, "_row")])
    rows = cut(spread.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "ordered")
    keys = [*names, "_one"]
    runs = rows.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_m"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(*keys, "_part", "_first", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_start"), F.sum("_m").over(W.partitionBy(*keys)).alias("n"))
    on = [rows[k].eqNullSafe(runs[k]) for k in keys] + [rows["_part"] == runs["_part"]]
    joined = rows.join(runs, on).withColumn("place", F.col("_start") + rows["_row"] - F.col("_first"))
    return joined.select(*[rows[c] for c in df.columns], "place", "n")


def _run_digest(n: int, nodes: Sequence[bytes]) -> bytes:
    """A tree of one node is that node."""
    return bytes(nodes[0]) if n == 1 else node_digest(nodes)


def _parts(spark: SparkSession, level: int) -> int:
    """Each level has a sixteenth of the vertices of the one below."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) >> 2 * level)


def climb(spark: SparkSession, lowest: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Upward supersteps: runs of every level, and ``(tree, digest)`` of the trees that end at that level.

    A run's message goes to ``(tree, run // 16)``: nodes of the tree at that
    level, the place there, the digest; 16 at most meet at a key.
    """

    def gathered(item):
        (tree, run), got = item
        got = sorted(got, key=lambda m: m[1])
        return tree, run, got[0][0], [bytearray(m[2]) for m in got]

    levels, roots = [lowest], []
    while True:
        done = levels[-1].select("tree", "run", "n", "nodes").rdd.map(lambda r: (r[0], r[1], r[2], _run_digest(r[2], r[3])))
        ended = done.filter(lambda x: x[2] <= FAN).map(lambda x: (x[0], bytearray(x[3])))
        roots.append(cut(spark.createDataFrame(ended, "tree long, digest binary", verifySchema=False), "roots"))
        upward = done.filter(lambda x: x[2] > FAN).map(lambda x: ((x[0], x[1] // FAN), (-(-x[2] // FAN), x[1] % FAN, x[3])))
        level = cut(spark.createDataFrame(upward.groupByKey(_parts(spark, len(levels))).map(gathered), RUN, verifySchema=False), "runs")
        if not level.limit(1).count():
            return levels, roots
        levels.append(level)


def _below(item) -> list:
    """What a run sends to the runs of its nodes: where they are in it, its digests, and its own path."""
    (_, run), (n, nodes, root, path) = item
    own = [] if n == 1 else [nodes]
    return [(run * FAN + i, (root, [(i, x) for x in own] + path)) for i in range(len(nodes))]


def descend(spark: SparkSession, levels: list[DataFrame], tops: list, value):
    """Downward supersteps: ``((tree, run), (value of the run, root, path))`` for the lowest runs.

    ``tops[i]``, an RDD of ``(tree, (root, path))``, starts the trees that end
    at level i. A path has for each level up to the root of all the place of
    the node in its run and all digests of that run.
    """
    sent = None
    for i in range(len(levels) - 1, -1, -1):
        make = value if i == 0 else (lambda r: [bytes(x) for x in r["nodes"]])
        own = levels[i].rdd.map(lambda r, make=make: ((r["tree"], r["run"]), (r["n"], make(r))))
        arrived = tops[i].map(lambda x: ((x[0], 0), x[1]))
        met = own.join(arrived if sent is None else arrived.union(sent), _parts(spark, i))
        if i == 0:
            return met.mapValues(lambda x: (*x[0], *x[1]))
        sent = met.map(lambda x: (x[0], (*x[1][0], *x[1][1]))).flatMap(lambda item: [((item[0][0], run), message) for run, message in _below(item)])


def fold(digest: bytes, path: Iterable[tuple[int, list[bytes]]]) -> bytes:
    """The root that a digest and its siblings lead to."""
    for place, nodes in path:
        digest = node_digest([*nodes[:place], digest, *nodes[place + 1 :]])
    return digest


@dataclass
class Manifest:
    """Runs of all sources' trees by level, those of the tree over sources, and the root of all (none without rows)."""

    leaves: DataFrame
    levels: list[DataFrame]
    roots: list[DataFrame]
    top: list[DataFrame]
    root: bytes | None

    def nodes(self) -> DataFrame:
        """``part, level, tree, run, n, nodes``: what is to be stored beside the dataset."""
        tables = [("source", i, x) for i, x in enumerate(self.levels)] + [("top", i, x) for i, x in enumerate(self.top)]
        return reduce(DataFrame.unionByName, [x.select(F.lit(part).alias("part"), F.lit(i).alias("level"), "tree", "run", "n", "nodes") for part, i, x in tables])

    def verify(self) -> DataFrame:
        """Each leaf's path of siblings, and whether its ``claim``, folded along that path, leads to the root.

        ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.
        """
        spark, root = self.leaves.sparkSession, self.root
        schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        if root is None:
            return spark.createDataFrame([], schema)
        ends = [x.rdd.map(lambda r: (r["tree"], bytes(r["digest"]))) for x in self.roots]
        first = [spark.sparkContext.parallelize([(0, (root, []))] if i == len(self.top) - 1 else [], 1) for i in range(len(self.top))]
        # a source's root is a leaf of the tree over sources; its run there tells it the rest of the way
        over = descend(spark, self.top, first, lambda r: [bytes(x) for x in r["nodes"]])
        paths = over.flatMap(lambda x: [(tree, message[1]) for tree, message in _below((x[0], (x[1][0], x[1][1], x[1][2], x[1][3])))])
        tops = [x.join(paths, _parts(spark, 1)) for x in ends]

        def rows(item):
            n, leaves, subroot, path = item[1]
            nodes = [x[1] for x in leaves]
            for i, (doc_id, leaf, claim) in enumerate(leaves):
                way = ([] if n == 1 else [(i, nodes)]) + path
                siblings = [x for place, run in way for j, x in enumerate(run) if j != place]
                folded = fold(claim, way)
                yield doc_id, leaf.hex(), subroot.hex(), root.hex(), node_digest(siblings).hex(), folded.hex(), folded == root

        found = descend(spark, self.levels, tops, lambda r: [(x["doc_id"], bytes(x["leaf"]), bytes(x["claim"])) for x in r["leaves"]])
        return spark.createDataFrame(found.flatMap(rows), schema, verifySchema=False)


def manifest(df: DataFrame, fields: Sequence[str] = FIELDS, source: str = "source", order: str = "doc_id", claim: Column | None = None) -> Manifest:
    """Leaves from ``fields`` of every row, and all runs above them.

    ``claim`` is the digest (hex) to hold against the manifest later; the leaf's
    own if not given. Texts are hashed where they are read and do not move.
    """
    spark, leaf = df.sparkSession, leaf_digest([F.col(c) for c in fields])
    leaves = df.select(F.col(source).cast("string").alias("source"), F.col(order).cast("long").alias("doc_id"), F.unhex(leaf).alias("leaf"), F.unhex(leaf if claim is None else claim).alias("claim"))
    ordered = placed(leaves, ["source"], ["doc_id", "leaf"])
    trees = placed(ordered.where("place = 0").select("source"), [], ["source"]).select(F.col("source").alias("_source"), F.col("place").alias("tree"))
    numbered = ordered.join(trees, ordered["source"].eqNullSafe(trees["_source"]))
    run = numbered.groupBy("tree", F.floor(F.col("place") / FAN).alias("run"), "n").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id", "leaf", "claim"))).alias("leaves"))
    lowest = cut(run.withColumn("nodes", F.transform("leaves", lambda x: x["leaf"])), "leaf-runs")
    levels, roots = climb(spark, lowest)
    subroots = reduce(DataFrame.unionByName, roots)
    sources = F.lit(trees.count())
    over = subroots.groupBy(F.lit(0).cast("long").alias("tree"), F.floor(F.col("tree") / FAN).alias("run"), sources.alias("n")).agg(F.sort_array(F.collect_list(F.struct(F.col("tree").alias("place"), "digest"))).alias("at"))
    top, ends = climb(spark, cut(over.select("tree", "run", "n", F.transform("at", lambda x: x["digest"]).alias("nodes")), "source-runs"))
    root = next((bytes(r["digest"]) for r in reduce(DataFrame.unionByName, ends).collect()), None)  # one row
    return Manifest(lowest, levels, roots, top, root)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest; a fifth of the texts are tampered with after it was made."""
    docs = table(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = leaf_digest([*[F.col(c) for c in FIELDS[:-1]], F.translate("text", upper, upper.lower())])
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, changed).otherwise(leaf_digest([F.col(c) for c in FIELDS]))
    return manifest(docs, claim=claim).verify()


def _sql(levels: int = 8, top_levels: int = 4) -> str:
    """The same, level by level: trees of up to 16 ** levels leaves."""

    def climb(name: str, n: int) -> str:
        out = ""
        for i in range(1, n + 1):
            out += f""",
{name}r{i} AS (SELECT tree, place // 16 AS run, list(d ORDER BY place) AS nodes, max(max(place)) OVER (PARTITION BY tree) > 0 AS many FROM {name}{i - 1} GROUP BY tree, place // 16),
{name}{i} AS (SELECT tree, run AS place, CASE WHEN many THEN sha256(array_to_string(nodes, '')) ELSE nodes[1] END AS d FROM {name}r{i})"""
        return out

    def walk(name: str, before: str, place: str, tree: str, n: int) -> tuple[str, str]:
        out = ""
        for i in range(1, n + 1):
            at, run = f"({place} // {16 ** (i - 1)}) % 16", f"{place} // {16**i}"
            left, right = f"coalesce(array_to_string(r.nodes[1:{at}], ''), '')", f"coalesce(array_to_string(r.nodes[{at} + 2:], ''), '')"
            out += f""",
{name}p{i} AS (SELECT b.* EXCLUDE (proof, c), proof || CASE WHEN many THEN {left} || {right} ELSE '' END AS proof, CASE WHEN many THEN sha256({left} || c || {right}) ELSE c END AS c
  FROM {before} b JOIN {name}r{i} r ON r.tree = {tree} AND r.run = {run})"""
            before = f"{name}p{i}"
        return out, before

    coded = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(coded(c) for c in FIELDS[:-1])
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
    up, end = walk("s", "l", "b.place", "b.tree", levels)
    over, last = walk("t", "w", "b.tree", "0", top_levels)
    return f"""
WITH h AS (SELECT doc_id, source, sha256({head} || {coded("text")}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {coded(lower)}) END AS tampered FROM documents),
l AS (SELECT doc_id, leaf, coalesce(tampered, leaf) AS c, '' AS proof, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM h),
s0 AS (SELECT tree, place, leaf AS d FROM l){climb("s", levels)},
t0 AS (SELECT 0 AS tree, tree AS place, d FROM s{levels}){climb("t", top_levels)}{up},
w AS (SELECT e.*, s.d AS subroot FROM {end} e JOIN s{levels} s USING (tree)){over}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, c AS folded_root, c = d AS verified FROM {last}, (SELECT d FROM t{top_levels})
"""


OP11_SQL = _sql()
