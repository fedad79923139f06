"""Content-addressed WARC archive.

Each payload is stored once, under its SHA-256 digest; the exact header bytes of every record are kept in a table of their
own with the digest of its payload. Original records come back by joining the two. A digest that two payloads of different
length or SHA-1 share stops the writing, and a stored payload is digested again when it is read.

Records are of the types that callers ask for, response and revisit, though a block is a bare payload without an HTTP head; dates
and record ids are made from the row, so that the same pages give the same archive.

Of records with equal payloads of at least min_bytes, the one with the largest page_id is the response and the others are
revisits of it. Rows: a null html is an empty payload; payloads of any length are kept whole; smaller ones are responses
each; rows that repeat the largest page_id are all responses; with null page_ids only, all are responses; null urls give an
empty target; other columns are not read; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table, written

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def write(pages: DataFrame, path: str, min_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes pages(page_id, url, html) as path/payloads (address, payload) and path/records (page_id, address, header)."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), payload.alias("payload"))
    named = raw.select("page_id", "url", "payload", F.sha2("payload", 256).alias("address"), F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("size"))
    # partial aggregation leaves one payload for each address and task, however many copies there are
    kept = named.groupBy("address").agg(F.first("payload").alias("payload"), F.min("sha1").alias("low"), F.max("sha1").alias("high"), F.min("size").alias("short"), F.max("size").alias("long"))
    same = F.assert_true((F.col("low") == F.col("high")) & (F.col("short") == F.col("long")), F.lit("two payloads share a SHA-256 digest"))
    kept.where(same.isNull()).select("address", "payload").write.parquet(f"{path}/payloads")

    thin = named.select("page_id", "url", "address", "sha1", "size")
    owners = thin.where(F.col("size") >= min_bytes).groupBy("address").agg(F.max("page_id").alias("owner"))
    of = thin.join(owners, "address", "left")
    revisit = F.coalesce(F.col("owner") != F.coalesce(F.col("page_id"), F.col("owner") - 1), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("owner"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit(END),
    )
    of.select("page_id", "address", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/records")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(address, payload) as stored, each digested again."""
    kept = spark.read.schema("address string, payload binary").parquet(f"{path}/payloads")
    good = F.assert_true(F.sha2("payload", 256) == F.col("address"), F.lit("a stored payload doesn't match its digest"))
    return kept.where(good.isNull())


def records(spark: SparkSession, path: str) -> DataFrame:
    """Headers, parsed: page_id, address, header, record_type, refers_to, sha1, content_length."""
    text = F.decode("header", "UTF-8")
    get = lambda name, pattern: F.regexp_extract("_text", rf"(?m)^{name}: {pattern}$", 1)
    kept = spark.read.schema("page_id long, address string, header binary").parquet(f"{path}/records").withColumn("_text", text)
    return kept.select(
        "page_id", "address", "header", get("WARC-Type", r"(\w+)").alias("record_type"),
        F.expr("try_cast(nullif(regexp_extract(_text, '(?m)^WARC-Refers-To: <urn:page:(-?[0-9]+)>$', 1), '') as bigint)").alias("refers_to"),
        get("WARC-Payload-Digest", r"sha1:([0-9a-f]+)").alias("sha1"), get("Content-Length", r"(\d+)").cast("long").alias("content_length"),
    )


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, address, record): each original record's exact bytes, header, block and end. A revisit has an empty block, so its
    header alone makes it, and payloads go only to the records that hold them."""
    end = F.lit(f"{END}{END}".encode())
    heads = records(spark, path)
    full = heads.where("record_type <> 'revisit'").join(payloads(spark, path), "address").select("page_id", "address", F.concat("header", "payload", end).alias("record"))
    return full.unionByName(heads.where("record_type = 'revisit'").select("page_id", "address", F.concat("header", end).alias("record")))


def parsed(rebuilt: DataFrame) -> DataFrame:
    """Records read back from their bytes: page_id, address, record_type, refers_to, size and sha1 of the block. One whose length or
    digest isn't what its header says stops the reading."""
    head = F.substring_index(F.decode("record", "UTF-8"), f"{END}{END}", 1)
    cut = rebuilt.select("page_id", "address", "record", head.alias("_text")).withColumn("_at", F.octet_length("_text") + 4)
    # the end is four bytes, too
    block = cut.select("page_id", "address", "_text", F.substring(F.col("record"), F.col("_at") + 1, F.length("record") - F.col("_at") - 4).alias("_block"))
    get = lambda name, pattern: F.regexp_extract("_text", rf"(?m)^{name}: {pattern}\r?$", 1)
    rows = block.select(
        "page_id", "address", get("WARC-Type", r"(\w+)").alias("record_type"), F.expr("try_cast(nullif(regexp_extract(_text, '(?m)^WARC-Refers-To: <urn:page:(-?[0-9]+)>', 1), '') as bigint)").alias("refers_to"),
        F.length("_block").cast("long").alias("size"), F.sha1("_block").alias("sha1"), get("WARC-Payload-Digest", "sha1:([0-9a-f]+)").alias("_sha1"), get("Content-Length", r"(\d+)").cast("long").alias("_size"),
    )
    whole = (F.col("size") == F.col("_size")) & ((F.col("record_type") == "revisit") | (F.col("sha1") == F.col("_sha1")))
    return rows.where(F.assert_true(whole, F.lit("a rebuilt record doesn't match its header")).isNull())


def index(spark: SparkSession, path: str) -> DataFrame:
    """The archive read back record by record: page_id, payload_bytes, payload_digest, record_type, refers_to. All come from rebuilt
    records; a revisit's payload is that of the response with its address, which is looked up by narrow rows."""
    rows = written(parsed(reconstruct(spark, path)), "records")
    full, again = rows.where("record_type <> 'revisit'"), rows.where("record_type = 'revisit'")
    held = full.groupBy("address").agg(F.min("size").alias("size"), F.min("sha1").alias("sha1"))
    every = full.unionByName(again.drop("size", "sha1").join(held, "address").select(*rows.columns))
    return every.select("page_id", F.col("size").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every page archived and read back."""
    path = scratch_path(spark, "archive")
    write(table(spark, sf_dir, "pages"), path)
    return index(spark, path)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, sha256(h) AS address FROM p),
     o AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY address) END AS owner FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM o
"""
