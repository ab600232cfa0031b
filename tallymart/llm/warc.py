"""Content-addressed web archives: payload bytes once, record headers apart, records rebuilt by joins.

An archive is two Parquet tables below one folder. ``payloads`` has every distinct payload once, under its SHA-256, with the
SHA-1 that WARC headers carry; ``headers`` has the exact header bytes of every record with the address of its payload. Of
records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the largest id is the response, the others are
revisits that refer to it; smaller payloads are responses always, though they are stored once too.

Equal payloads are reduced within every task before the one shuffle that moves payloads, so a payload that many records share
is no hot key. Reading verifies each stored payload against both digests and fails where one does not match.

Null payloads count as empty. Rows that share the largest id of a payload are all responses; a null id ranks below all others.
An empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_BYTES = 1000
#: WARC-Date where the table has none: pages carry no time, and archives of equal pages should be equal.
DATE = "1970-01-01T00:00:00Z"
PAYLOADS = "digest string, sha1 string, payload binary, owner long"
HEADERS = "header binary, digest string"


def record_uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write the archive of ``pages`` to the new folder ``path``."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    store = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.max("page_id").alias("owner"))
    store.select("digest", F.sha1("payload").alias("sha1"), "payload", "owner").write.parquet(f"{path}/payloads")
    owners = read_payloads(pages.sparkSession, path).select("digest", "sha1", "owner")
    small = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("length")).join(owners, "digest")
    revisit = (F.col("length") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_uri(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", ""))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, line("WARC-Refers-To", record_uri(F.col("owner")))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("length")).cast("string")),
        F.lit("\r\n"),
    )
    small.select(F.encode(header, "UTF-8").alias("header"), "digest").write.parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")


def field(header: Column, name: str) -> Column:
    """Value of a header line; null where there is none."""
    value = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.length(value) > 0, value)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of an archive: page_id, url, record_type, refers_to, payload_digest (SHA-1), payload_bytes, payload (full,
    for revisits too) and header (exact bytes). Payloads are checked against their digests; columns not used are not read."""
    stored = read_payloads(spark, path)
    intact = (F.sha2("payload", 256) == F.col("digest")) & (F.sha1("payload") == F.col("sha1"))
    # The length is null, and reading fails, where a payload differs from its digests.
    length = F.when(intact, F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("long"))
    stored = stored.select("digest", F.col("sha1"), "payload", length.alias("payload_bytes"))
    heads = spark.read.schema(HEADERS).parquet(f"{path}/headers").withColumn("text", F.decode("header", "UTF-8"))
    number = lambda name: F.regexp_extract(field(F.col("text"), name), r"<urn:page:(-?[0-9]+)>", 1)
    as_id = lambda name: F.when(F.length(number(name)) > 0, number(name).cast("long"))
    heads = heads.select(
        "digest", "header", as_id("WARC-Record-ID").alias("page_id"), field(F.col("text"), "WARC-Target-URI").alias("url"), field(F.col("text"), "WARC-Type").alias("record_type"),
        as_id("WARC-Refers-To").alias("refers_to"), F.substring(field(F.col("text"), "WARC-Payload-Digest"), 6, 40).alias("payload_digest"),
    )
    found = heads.join(stored, "digest", "left")
    missing = F.raise_error(F.concat(F.lit("no payload "), F.col("digest"))).cast("long")
    known = F.when(F.col("sha1").eqNullSafe(F.col("payload_digest")), F.col("payload_bytes")).otherwise(missing)
    return found.select("page_id", "url", "record_type", "refers_to", "payload_digest", known.alias("payload_bytes"), "payload", "header")


def record_bytes(records: DataFrame) -> DataFrame:
    """``records`` of :func:`read` with ``record``: the bytes of the WARC record (revisits have an empty block)."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.withColumn("record", F.concat("header", block, F.lit(b"\r\n\r\n")))
