"""What the operators of this subpackage share: tables, scratch tables, row-wise Arrow steps."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text handled at once inside a task, so that a batch of long documents stays small in memory.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own; on
    a cluster the folder then lies beside the warehouse, which is shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] == "local":
            root = "file://" + tempfile.mkdtemp(prefix="spark-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}-{label}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files any executor can read."""
    return cut_by(df, label)


def cut_by(df: DataFrame, label: str, *by: str) -> DataFrame:
    """:func:`cut` with a folder for each value of ``by``."""
    # shuffle files of earlier steps go once the driver's JVM sees that no frame needs them, so before new ones are made
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let the shuffle files of finished steps go before the next large one.

    The driver's JVM drops them once it sees that no frame needs them; the
    first collection only lets go of what Python held.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut` once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32(doc_id as text) mod 5 is 0; a null id belongs to it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def slices(sizes, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) whose sizes sum to about ``limit`` at most; one row at least."""
    a = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[list[str | None]]:
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for a, b in slices(sizes, limit):
        yield texts.slice(a, b - a).to_pylist()


def append_columns(
    df: DataFrame, text_col: str, fn: Callable[[], Callable[[list[str | None]], list[list]]], out: list[T.StructField]
) -> tuple[DataFrame, list[str]]:
    """Row-wise step in Arrow batches, without a shuffle.

    ``fn()`` is called once in each task and gives a function from a list of
    texts to one list of values for each field of ``out``. Columns of ``df``
    come back under positional names (returned second), so that no name of
    theirs can clash with the new fields.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [f"_c{i}" for i in range(len(df.columns))]
    at = df.columns.index(text_col)
    renamed = df.toDF(*names)
    renamed = renamed.withColumn(names[at], F.col(names[at]).cast("string"))
    schema = T.StructType([*(T.StructField(n, f.dataType, True) for n, f in zip(names, renamed.schema.fields)), *out])
    arrow = to_arrow_schema(T.StructType(out))

    def run(batches):
        step = fn()
        for batch in batches:
            parts = [step(texts) for texts in text_slices(batch.column(at))]
            new = [
                pa.array([x for part in parts for x in part[i]], type=field.type) for i, field in enumerate(arrow)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, *(f.name for f in out)])

    return renamed.mapInArrow(run, schema), names
