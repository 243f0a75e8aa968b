"""Content-addressed WARC archive: payloads once by verified digest, exact record headers apart, records by joins.

Tables of an archive: ``headers`` (page_id, header: the exact bytes of the record's header with its blank line,
key: the payload's SHA-256) and ``payloads`` (key, payload), a row for each different payload. A record is its
header followed by the payload of its key; a revisit record has a header only. Reading parses the header bytes,
joins the payload, and recomputes both digests; a payload whose SHA-256 isn't its key, or whose SHA-1 isn't the
header's, raises.

Of the records with equal payloads of at least ``REVISIT_BYTES``, that with the greatest page_id is the response
and the others revisit it; smaller payloads are all responses. Null html is an empty payload. A null page_id is
less than any other; rows that share the greatest page_id are all responses. Line breaks in a url are
percent-encoded in its header. Extra columns are ignored.

Payloads that a large part of the pages share are one row in ``payloads``; the least work that finds the
greatest page_id is a partial maximum by key, and the joins on the key are split where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit("\r\n"))


def write_archive(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes the two tables of the archive of all pages and returns them as read back."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    keyed = pages.select("page_id", "url", payload.alias("payload")).select("page_id", "url", "payload", F.sha2("payload", 256).alias("key"))
    payloads = save(keyed.groupBy("key").agg(F.first("payload").alias("payload")), "payloads")
    facts = keyed.select("page_id", "url", "key", F.length("payload").cast("bigint").alias("bytes"), F.sha1("payload").alias("sha1"))
    facts = save(facts, "records")
    last = facts.where(F.col("bytes") >= REVISIT_BYTES).groupBy("key").agg(F.max("page_id").alias("last"))
    rows = facts.join(last, "key", "left")
    revisit = (F.col("bytes") >= REVISIT_BYTES) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _header("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(_header("WARC-Profile", F.lit(PROFILE)), _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("last").cast("string"), F.lit(">"))))).otherwise(""),
        _header("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )
    headers = save(rows.select("page_id", F.encode(header, "utf-8").alias("header"), "key"), "headers")
    return headers, payloads


def records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """page_id, header and payload of every record; the full payload is given for revisits as well."""
    checked = payloads.select("key", "payload", F.assert_true(F.sha2("payload", 256) == F.col("key"), "a payload isn't what its key says").alias("_ok"), F.sha1("payload").alias("sha1"))
    return headers.join(checked, "key").where("_ok is null").drop("_ok")


def warc_bytes(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """page_id and the bytes of its whole WARC record, as they stand in a WARC file."""
    body = F.when(F.col("type") == "revisit", F.encode(F.lit(""), "utf-8")).otherwise(F.col("payload"))
    whole = F.concat("header", body, F.encode(F.lit("\r\n\r\n"), "utf-8"))
    return records(headers, payloads).withColumn("type", _field("WARC-Type")).select("page_id", whole.alias("record"))


def _field(name: str) -> Column:
    return F.regexp_extract(F.decode("header", "utf-8"), rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)


def read_archive(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: from the header's bytes and the payload."""
    # the payload's facts are computed once for each payload, before the join
    facts = payloads.select(
        "key",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        F.when(F.sha2("payload", 256) != F.col("key"), F.raise_error(F.lit("a payload isn't what its key says"))).alias("_key"),
    )
    told = _field("WARC-Payload-Digest")
    wrong = F.raise_error(F.concat(F.lit("digest of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    refers = F.regexp_extract(_field("WARC-Refers-To"), r"^<urn:page:(-?\d+)>$", 1)
    return headers.join(facts, "key").select(
        "page_id",
        "payload_bytes",
        F.when(told == F.concat(F.lit("sha1:"), "payload_digest"), F.coalesce(F.col("_key").cast("string"), F.col("payload_digest"))).otherwise(wrong.cast("string")).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        F.when(refers != "", refers.cast("bigint")).alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest, sha256(html) AS k FROM p),
m AS (SELECT k, max(page_id) AS last FROM f WHERE payload_bytes >= 1000 GROUP BY k)
SELECT f.page_id, f.payload_bytes, f.payload_digest,
       CASE WHEN m.last IS NOT NULL AND f.page_id IS DISTINCT FROM m.last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.page_id IS DISTINCT FROM m.last THEN m.last END AS refers_to
FROM f LEFT JOIN m ON f.k = m.k
"""
