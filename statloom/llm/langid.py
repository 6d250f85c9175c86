"""Language identification by prediction by partial matching (PPM, escape method C)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import append_columns, held_out, slices, table, text_slices

#: Longest context, in bytes. A text is read as if that many line ends came before it.
ORDER = 3
_SLICE = 1 << 20


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the texts the byte and its context as one number, and where each text starts."""
    pad = b"\n" * ORDER
    raw = [pad + (t or "").encode() for t in texts]
    x = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    sizes = np.array([len(r) for r in raw])
    codes = np.zeros(len(x), np.uint32)
    for back in range(ORDER, -1, -1):
        codes[ORDER:] = codes[ORDER:] << np.uint32(8) | x[ORDER - back : len(x) - back]
    begins = np.cumsum(sizes) - sizes
    keep = np.ones(len(x), bool)
    for j in range(ORDER):
        keep[begins + j] = False
    return codes[keep], begins - ORDER * np.arange(len(raw))


class Model:
    """Frozen context trees of all languages: code lengths of seen symbols and of escapes, by order."""

    def __init__(self, languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.languages, self.levels = languages, []
        for order in range(ORDER, -1, -1):
            cut = np.uint32((1 << 8 * (order + 1)) - 1)
            symbols, at = np.unique(gram & cut, return_inverse=True)
            counts = np.zeros((len(symbols), len(languages)))
            np.add.at(counts, (at, lang), n)
            contexts, up = np.unique(symbols >> np.uint32(8), return_inverse=True)
            total, kinds = np.zeros((2, len(contexts), len(languages)))
            np.add.at(total, up, counts)
            np.add.at(kinds, up, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                length = np.where(counts > 0, np.log2((total + kinds)[up]) - np.log2(counts), np.inf)
                escape = np.where(total > 0, np.log2(total + kinds) - np.log2(kinds), 0)
            self.levels.append((cut, symbols, length, contexts, escape))

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray):
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram after its context, for each language.

        From the longest context down: an unseen context is passed over, a seen
        one codes the byte or escapes; below order 0 all 256 bytes are alike.
        """
        out = np.zeros((len(gram), len(self.languages)))
        open_ = np.ones(out.shape, bool)
        for cut, symbols, length, contexts, escape in self.levels:
            key = gram & cut
            at, known = self._find(symbols, key)
            here = np.where(known[:, None], length[at], np.inf)
            up, there = self._find(contexts, key >> np.uint32(8))
            down = np.where(there[:, None], escape[up], 0)
            coded = open_ & np.isfinite(here)
            out += np.where(coded, here, np.where(open_, down, 0))
            open_ &= ~coded
        return out + 8.0 * open_

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Exact code length in bits of each whole text under each language."""
        totals = np.zeros((len(texts), len(self.languages)))
        for a, b in slices([len(t or "") for t in texts], _SLICE):
            codes, begins = _grams(texts[a:b])
            if not len(codes):
                continue
            distinct, at = np.unique(codes, return_inverse=True)
            table_ = self.bits(distinct)
            full = np.diff(np.append(begins, len(codes))) > 0
            for j in range(len(self.languages)):
                totals[a:b, j][full] = np.add.reduceat(table_[at, j], begins[full])
        return totals


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_bytes: int = 4 << 20, seed: int = 7, id_col: str = "doc_id") -> Model:
    """Fit on a bounded sample: whole texts of about ``sample_bytes`` bytes a language, chosen by a hash of id and text.

    The id only spreads the copies of one text, so that they are sampled one by one and not all or none.

    Byte counts a language come from all rows. Tasks count the grams of the
    sampled texts, Spark sums them, and the distinct ones (at most the sampled
    bytes) form the model. Rows with a null text or language teach nothing.
    """
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)), F.lit(1 << 20))
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), drawn.alias("drawn")).where(
        "text IS NOT NULL AND lang IS NOT NULL"
    )
    sizes = {r["lang"]: r["size"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.empty(0, int), np.empty(0, np.uint32), np.empty(0))
    rate = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample_bytes / max(sizes[k], 1)))])
    sample = rows.where(F.col("drawn") < rate[F.col("lang")] * (1 << 20))

    def count(batches):
        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for texts in text_slices(batch.column(1)):
                by = {}
                for text in texts:
                    by.setdefault(next(names), []).append(text)
                for name, own in by.items():
                    gram, n = np.unique(_grams(own)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(gram), pa.string()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"]
                    )

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    lang = np.searchsorted(np.array(languages), np.array(found["lang"].to_pylist(), dtype=np.array(languages).dtype))
    return Model(languages, lang, found["gram"].to_numpy().astype(np.uint32), found["n"].to_numpy().astype(float))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """The language whose trees code the whole text in the fewest bits.

    Appends ``lang_pred``, ``score`` (posterior under equal priors, from the
    exact code lengths) and ``bits_per_byte``. A text that is null or has no
    letter is ``und`` with score 0; so is all text when nothing was learned.
    Equal code lengths go to the first language in order. Rows are never
    moved; other columns come back under the positional names returned second.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)
    out = [T.StructField("best", T.StringType()), T.StructField("posterior", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]

    def make():
        trees = handle.value

        def step(texts):
            if not trees.languages:
                return [[None] * len(texts), [0.0] * len(texts), [None] * len(texts)]
            bits = trees.score(texts)
            best = bits.argmin(1)
            least = bits.min(1)
            share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
            size = np.array([max(len((t or "").encode()), 1) for t in texts])
            return [[trees.languages[i] for i in best], share.tolist(), (least / size).tolist()]

        return step

    scored, names = append_columns(docs, text_col, make, out)
    text = F.col(names[docs.columns.index(text_col)])
    known = F.coalesce(text.rlike(r"\p{L}"), F.lit(False)) & F.col("best").isNotNull()
    return scored.select(
        *names,
        F.when(known, F.col("best")).otherwise("und").alias("lang_pred"),
        F.when(known, F.col("posterior")).otherwise(0.0).alias("score"),
        F.when(known, F.col("bits_per_byte")).alias("bits_per_byte"),
    ), names


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    scored, names = predict(docs.select("doc_id", "text"), model)
    return scored.select(
        F.col(names[0]).alias("doc_id"), held_out(F.col(names[0])).alias("held_out"), "lang_pred", "score", "bits_per_byte"
    )
