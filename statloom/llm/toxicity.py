"""Toxicity classifier with a counterfactual penalty on identity terms."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import append_columns, held_out, table

#: Interchangeable names of groups; a sentence must score alike under any of a row.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Model:
    """A weight for each word of the vocabulary, counted once a text, and an intercept."""

    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept, self.words = weights, intercept, re.compile(WORD)

    def logits(self, texts: list[str | None]) -> list[float]:
        known, find = self.weights, self.words.findall
        return [self.intercept + sum(known[w] for w in known.keys() & set(find(t.lower()))) if t else self.intercept for t in texts]


def fit(x: list[np.ndarray], y: np.ndarray, swaps: list[tuple[int, int, int]], size: int, l2: float, penalty: float, steps: int = 300):
    """Logistic regression on sets of words, by Adam.

    Loss: mean log loss + l2/2 |w|^2 (l2 here a row) + penalty * mean over the swaps of the
    squared change of a text's score when word a of it becomes word b. Where the text has b
    already, the set of its words only loses a.
    """
    rows = np.repeat(np.arange(len(x)), [len(r) for r in x])
    cols = np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64)
    a, b = (np.array([s[i] for s in swaps], np.int64) for i in (1, 2))
    gained = np.array([j not in x[i] for i, _, j in swaps], float)
    w, c = np.zeros(size), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(np.bincount(rows, w[cols], len(x)) + c)))
        g = (p - y) / len(y)
        grad = np.bincount(cols, g[rows], size) + l2 * w
        if len(swaps):
            change = 2 * penalty * (gained * w[b] - w[a]) / len(swaps)
            grad += np.bincount(b, gained * change, size) - np.bincount(a, change, size)
        full = np.append(grad, g.sum())
        m, v = 0.9 * m + 0.1 * full, 0.99 * v + 0.01 * full**2
        move = 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, c = w - move[:-1], c - move[-1]
    return w, c


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    identity_terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
    sample_rows: int = 20_000,
    min_docs: int = 3,
    min_g: float = 10.83,
    l2: float = 0.03,
    penalty: float = 10.0,
    seed: int = 7,
) -> Model:
    """Fit on a bounded sample: about ``sample_rows`` labelled texts, chosen by a hash of the id.

    Spark counts how often each word stands in sampled texts of either label
    and keeps every word of ``min_docs`` texts that tells enough about it (G statistic
    of ``min_g`` at least: one in a thousand by chance), and all identity terms. The texts come to the fit as sets of those words.
    A sampled text with an identity term gives, for each other term of its
    group, a counterfactual text whose change of score is penalised.

    An id with several labels counts as toxic if one of them says so, and one
    with several texts gives the least of them; null labels, ids and texts
    teach nothing. Without both labels every text gets
    the share of label 1, or 0 where nothing is labelled.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    n = marks.count()
    rate = min(1.0, sample_rows / max(n, 1))
    marks = marks.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < rate * (1 << 20))
    rows = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("text")).join(marks, "id").where("text IS NOT NULL")
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    found = rows.select("y", F.array_distinct(F.regexp_extract_all("text", F.lit(f"({WORD})"))).alias("words"))
    size = {r["y"]: r["n"] for r in found.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = size.get(1, 0), sum(v for k, v in size.items() if k != 1)
    if not pos or not neg:
        return Model({}, 40.0 if pos else -40.0)
    k1, k0 = F.sum(F.col("y")).cast("double"), F.sum(1 - F.col("y")).cast("double")

    def part(k, of, expected):
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0) + F.when(of - k > 0, (of - k) * F.log((of - k) / (of - expected))).otherwise(0.0)

    stats = found.select("y", F.explode("words").alias("word")).groupBy("word").agg(k1.alias("k1"), k0.alias("k0")).where(F.col("k1") + F.col("k0") >= min_docs)
    share = (F.col("k1") + F.col("k0")) / (pos + neg)
    both = stats.where(share < 1).withColumn("g", part(F.col("k1"), F.lit(pos), pos * share) + part(F.col("k0"), F.lit(neg), neg * share))
    chosen = [r["word"] for r in both.where(F.col("g") * 2 >= min_g).orderBy(F.desc("g"), "word").collect()]
    terms = [t for group in identity_terms for t in group]
    index = {w: i for i, w in enumerate(dict.fromkeys([*chosen, *terms]))}
    handle = docs.sparkSession.sparkContext.broadcast(set(index))

    def known(batches):
        wanted = handle.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                own = [[w for w in r if w in wanted] for r in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.list_(pa.string()))], ["y", "words"])

    sample = found.select("y", "words").mapInArrow(known, "y int, words array<string>").toArrow()
    x = [np.array(sorted(index[w] for w in r), np.int64) for r in sample["words"].to_pylist()]
    y = np.array(sample["y"].to_pylist(), float)
    groups = {index[t]: [index[o] for o in group if o != t] for group in identity_terms for t in group}
    swaps = [(i, a, b) for i, r in enumerate(x) for a in r.tolist() if a in groups for b in groups[a]]
    w, c = fit(x, y, swaps, len(index), l2 / len(x), penalty)
    return Model({t: float(w[i]) for t, i in index.items() if w[i]}, float(c))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """Appends ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to whole texts, without moving rows.

    Null, empty and wordless texts get the intercept's score. Other columns
    come back under the positional names returned second.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        logits = handle.value.logits
        return lambda texts: [[1 / (1 + float(np.exp(-max(min(z, 40.0), -40.0)))) for z in logits(texts)]]

    scored, names = append_columns(docs, text_col, make, [T.StructField("score", T.DoubleType())])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), names


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that the classifier, learned outside the held-out fold, does not reject."""
    model = train(docs.where(~held_out(F.col(id_col))), labels, id_col, text_col, **options)
    scored, names = score(docs, model, text_col)
    return scored.where("predicted = 0").select(*names).toDF(*docs.columns)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    scored, names = score(docs, model)
    return scored.select(F.col(names[0]).alias("doc_id"), held_out(F.col(names[0])).alias("held_out"), "score", "predicted")
