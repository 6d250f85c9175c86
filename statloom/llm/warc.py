"""Content-addressed web archive: payload bytes once, exact record headers apart, records by a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import scratch_path, table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 1000,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write one WARC/1.1 record per row of ``pages`` under ``path``.

    ``payloads``: each distinct payload once, under its SHA-256. ``headers``:
    the exact header block of each record and the address of its payload. Of
    records with equal payloads of at least ``min_revisit_bytes`` bytes the one
    with the largest id is a response and the others revisit it; smaller ones
    are responses all.

    The payloads meet by digest in an aggregate, which keeps one copy a digest
    in each task before the shuffle: a payload that a third of the rows hold
    travels once a task. The headers join without payload bytes; Spark may
    split a hot digest there, since nothing above needs its rows together.

    A null payload is an empty one; strings are stored as UTF-8. A null URI
    gives a record without that header; line ends in a URI are
    percent-encoded. Rows with a null id are kept, as responses when no row of
    theirs has an id. Rows that repeat the largest id are responses all. An
    empty table gives an empty archive. Other columns are not read.
    """
    payload = F.col(payload_col)
    if dict(pages.dtypes)[payload_col] != "binary":
        payload = F.encode(payload.cast("string"), "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("long").alias("record_id"),
        F.col(uri_col).cast("string").alias("uri"),
        F.coalesce(payload, F.lit(b"")).alias("payload"),
    ).withColumn("address", F.sha2("payload", 256))
    (
        rows.groupBy("address")
        .agg(F.first("payload").alias("payload"), F.max("record_id").alias("last_id"))
        .write.option("compression", "zstd")
        .parquet(f"{path}/payloads")
    )
    stored = pages.sparkSession.read.parquet(f"{path}/payloads").select("address", "last_id")
    size, sha1 = F.octet_length("payload"), F.sha1("payload")
    records = (
        rows.select("record_id", "uri", "address", size.alias("size"), sha1.alias("sha1"))
        .join(stored, "address")
        .withColumn("revisit", (F.col("size") >= min_revisit_bytes) & (F.coalesce("record_id", F.lit(-(2**63))) < F.col("last_id")))
    )
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c), F.lit(">"))
    when = lambda c: F.when(F.col("revisit"), c)
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.coalesce(urn("record_id"), F.lit("<urn:page:>"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.replace(F.replace("uri", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _line("WARC-Profile", when(F.lit(PROFILE))),
        _line("WARC-Refers-To", when(urn("last_id"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(F.col("revisit"), 0).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
    )
    (
        records.select("address", F.encode(header, "UTF-8").alias("header"))
        .write.option("compression", "zstd")
        .parquet(f"{path}/headers")
    )


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of an archive: fields parsed from the exact header, payload facts taken from the stored bytes.

    Each stored payload must hash to its address again, or the job fails.
    ``with_payload`` adds the payload that the record stands for, also to
    revisits, and ``record``: the record's exact bytes (a revisit has no block).
    """
    payloads = spark.read.parquet(f"{path}/payloads").select(
        "address",
        *(["payload"] if with_payload else []),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.sha2("payload", 256) == F.col("address"), F.sha1("payload"))
        .otherwise(F.raise_error(F.concat(F.lit("stored payload does not match its address "), "address")))
        .alias("payload_digest"),
    )
    text = F.decode("header", "UTF-8")
    field = lambda name, value=r"([^\r\n]*)": F.regexp_extract(text, f"(?:^|\\n){name}: {value}\\r\\n", 1)
    number = lambda name: F.nullif(field(name, "<urn:page:(-?\\d*)>"), F.lit("")).cast("long")
    out = (
        spark.read.parquet(f"{path}/headers")
        .select(
            "address",
            "header",
            number("WARC-Record-ID").alias("record_id"),
            field("WARC-Type").alias("record_type"),
            number("WARC-Refers-To").alias("refers_to"),
            F.nullif(field("WARC-Target-URI"), F.lit("")).alias("uri"),
            field("WARC-Payload-Digest", "sha1:(\\w+)").alias("header_digest"),
        )
        .join(payloads, "address")
    )
    if with_payload:
        end = F.lit(b"\r\n\r\n")
        block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
        out = out.withColumn("record", F.concat("header", block, end))
    return out


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "uri"
    )


OP1_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS body FROM pages
), g AS (
  SELECT body, max(page_id) AS last_id FROM p GROUP BY body
)
SELECT p.page_id,
       octet_length(encode(p.body))::BIGINT AS payload_bytes,
       sha1(p.body) AS payload_digest,
       CASE WHEN octet_length(encode(p.body)) >= 1000 AND p.page_id < g.last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(p.body)) >= 1000 AND p.page_id < g.last_id THEN g.last_id END AS refers_to,
       nullif(p.url, '') AS uri
FROM p JOIN g USING (body)
"""
