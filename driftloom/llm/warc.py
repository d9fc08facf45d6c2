"""WARC derivatives: metadata and plain-text conversion records for response records.

`responses` turns pages into response records, `derive` turns each response into two records that
refer to it: a `metadata` record with the source's headers and digests as fields, and a
`conversion` record with the plain text. `WARC-Refers-To` holds the response's identifier,
`WARC-Refers-To-Target-URI` and `WARC-Refers-To-Date` its address and date; identifiers of derived
records follow from it, so reruns agree. `write` stores records as files of the text source whose
line end is the record separator: Spark's writer does the work, each record is one line.

Everything is column expressions but the character references of plain text, which are decoded row
by row. One without its semicolon stays as it is, as in the registered SQL. A record is (warc_type,
record_id, refers_to, target_uri, date,
content_type, payload_digest, block_digest, content_length, headers, block).

Null urls give no target line; null or empty pages give empty payloads with records all the same;
repeated rows give equal records; a null id is written as `null`. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

END = "\r\n"
VERSION = "WARC/1.1"
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")
#: Comments, scripts and styles, to the end of the page if they have no end (fixed value).
UNSEEN = r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<(script|style)\b[^>]*>.*?(?:</\1\b[^>]*>|\z)"


def identifier(*parts: Column) -> Column:
    """URN of a name-based UUID: 32 digits of a digest of the parts."""
    d = F.sha2(F.concat_ws("\n", *parts), 256)
    return F.concat(
        F.lit("<urn:uuid:"), F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 4), F.lit("-5"), F.substring(d, 14, 3),
        F.lit("-8"), F.substring(d, 18, 3), F.lit("-"), F.substring(d, 21, 12), F.lit(">"),
    )


def sha256(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


@F.pandas_udf(StringType())
def _decoded(text: pd.Series) -> pd.Series:
    """Decimal, hexadecimal and named references decoded once; a no-break space made so is a space."""
    return text.map(lambda t: _REFERENCE.sub(_character, t) if t and "&" in t else t)


def _character(m: re.Match) -> str:
    char = html.unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0])
    return " " if char == "\xa0" else char


def plain_text(page: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags go, references are decoded."""
    text = F.regexp_replace(page, UNSEEN, " ")
    text = F.regexp_replace(text, r"(?i)</?(a|b|i|em|strong|span|u|small|sub|sup|code)(\s[^>]*)?>", "")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(_decoded(text), r"[ \t\r\n\f\x0B]+", " "))


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _record(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("block_digest", sha256(F.col("block"))).withColumn(
        "content_length", F.octet_length("block").cast("long")
    )
    headers = F.concat(
        F.lit(VERSION + END),
        _line("WARC-Type", F.col("warc_type")),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Refers-To", F.col("refers_to")),
        _line("WARC-Target-URI", F.col("target_uri")),
        _line("WARC-Refers-To-Target-URI", F.when(F.col("refers_to").isNotNull(), F.col("target_uri"))),
        _line("WARC-Refers-To-Date", F.when(F.col("refers_to").isNotNull(), F.col("date"))),
        _line("WARC-Date", F.col("date")),
        _line("WARC-Payload-Digest", F.col("payload_digest")),
        _line("WARC-Block-Digest", F.col("block_digest")),
        _line("Content-Type", F.col("content_type")),
        F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string"), F.lit(END)),
    )
    return rows.withColumn("headers", headers)


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of pages (page_id, url, html); http_headers is the head of the block."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.octet_length(html).cast("string"), F.lit(END + END),
    )
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"),
        name.alias("name"), html.alias("payload"), head.alias("http_headers"),
    )
    return _record(rows.select(
        "page_id", F.lit("response").alias("warc_type"),
        identifier(
            F.lit("response"), F.col("name"), F.coalesce("target_uri", F.lit("")), sha256(F.col("payload"))
        ).alias("record_id"),
        F.lit(None).cast("string").alias("refers_to"), "target_uri", F.lit(date).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        sha256(F.col("payload")).alias("payload_digest"),
        F.concat("http_headers", "payload").alias("block"), "http_headers", "payload",
    ))


def derive(records: DataFrame) -> DataFrame:
    """The metadata and the conversion record of every response record."""
    from_http = F.regexp_replace(F.regexp_replace("http_headers", r"^[^\r\n]*\r\n", ""), r"\r\n\r\n$", END)
    fields = F.concat(
        _line("source-content-type", F.col("content_type")),
        _line("source-content-length", F.col("content_length").cast("string")),
        _line("source-payload-digest", F.col("payload_digest")),
        _line("source-block-digest", F.col("block_digest")),
        F.regexp_replace(from_http, r"(?m)^(?=[^\r\n])", "source-http-"),
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("kind"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("kind"), plain_text(F.col("payload")).alias("block")),
    )
    rows = records.where("warc_type = 'response'").select(
        "page_id", "target_uri", "date", "payload_digest", F.col("record_id").alias("refers_to"), F.explode(made).alias("m")
    )
    return _record(rows.select(
        "page_id", F.col("m.warc_type").alias("warc_type"),
        identifier(F.col("m.warc_type"), F.col("refers_to")).alias("record_id"), "refers_to", "target_uri", "date",
        F.col("m.kind").alias("content_type"), "payload_digest", F.col("m.block").alias("block"),
    ))


def write(records: DataFrame, path: str) -> None:
    """Gzip files of whole records, one or more per partition."""
    whole = F.concat("headers", F.lit(END), "block")
    records.select(whole.alias("value")).write.option("lineSep", END + END).option("compression", "gzip").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of files made by `write`: a record begins where its version line does.

    The separator may also stand inside a block; parts are put together again by content length.
    """
    import pyarrow as pa

    def records(batches):
        for b in batches:
            for raw in b.column("content"):
                yield from _parsed(raw.as_py())

    def _parsed(raw: bytes):
        import gzip
        import io

        file = gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
        while line := file.readline():
            if not line.startswith(b"WARC/"):
                continue
            fields = {}
            while (line := file.readline()) not in (b"\r\n", b"\n", b""):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                fields[name.strip().lower()] = value.strip()
            block = file.read(int(fields.get("content-length", 0)))
            row = [fields.get(k) for k in ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "warc-payload-digest", "warc-block-digest")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], pa.string()) for v in row] + [pa.array([len(block)], pa.int64()), pa.array([block], pa.binary())],
                names=["warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest", "content_length", "block"],
            )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(
        records,
        "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
        "payload_digest string, block_digest string, content_length long, block binary",
    )
