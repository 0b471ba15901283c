"""WARC derivatives: metadata and plain-text conversion records of responses.

A response record has the WARC headers, the HTTP block and digests. For each,
the builder writes a ``metadata`` record (source headers as
application/warc-fields) and a ``conversion`` record (the text of the HTML),
both with ``WARC-Refers-To`` naming the response, the same target and date, and
digests of their own blocks; the source's payload digest and headers stay.
Everything is a projection in the JVM: no shuffle, no Python.

Defined results: a null body is an empty body, a null URL an empty URL; pages
without markup are their own text; unclosed script, style or comment runs to
the end; rows that repeat give records that repeat, with equal ids, as ids are
derived from content; an empty table gives no records; only the named columns
are read, so others cannot clash.
"""

from __future__ import annotations

import gzip
import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _names(*tags: str) -> str:
    """Tag names in any case. Spelt out, as a case-insensitive pattern takes half as long again."""
    return "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in t) for t in tags) + ")"


_HIDDEN = _names("script", "style", "noscript", "template")
_BLOCKS = _names("p", "br", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "article", "section", "header", "footer", "nav", "title", "blockquote", "pre", "hr")
#: (pattern, replacement) in order; all run in linear time.
TEXT_RULES = [
    (rf"(?s)<(?:!--.*?(?:-->|$)|{_HIDDEN}\b[^>]*>.*?(?:</{_HIDDEN}\s*>|$))", ""),
    (rf"</?{_BLOCKS}\b[^>]*>", "\n"),
    (r"</?[a-zA-Z!][^>]*>", ""),
]
#: Named references that decode; the ampersand comes last so that nothing decodes twice.
ENTITIES = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("reg", "®"), ("hellip", "…"), ("mdash", "—"), ("ndash", "–"), ("euro", "€"), ("amp", "&")]
#: Single blanks, most of all, match nothing.
SPACING = [(r"[ \t\f\r]{2,}|[\t\f\r]", " "), (r" ?\n[ \n]*", "\n")]


def plain_text(html: Column) -> Column:
    """Text of an HTML body: markup, scripts and comments out, blocks on lines."""
    out = html
    for pattern, to in TEXT_RULES:
        out = F.regexp_replace(out, pattern, to)
    for name, to in ENTITIES:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(to))
    (blanks, blank), (breaks, line) = SPACING
    # most texts have no such run, and looking for one is cheaper than replacing none
    some = lambda y: F.contains(y, F.lit("  ")) | F.contains(y, F.lit("\t")) | F.contains(y, F.lit("\r")) | F.contains(y, F.lit("\f"))
    out = F.transform(F.array(out), lambda y: F.when(some(y), F.regexp_replace(y, blanks, blank)).otherwise(y))[0]
    out = F.regexp_replace(out, breaks, line)
    return F.trim(out, F.lit(" \n"))


def record_id(*parts: Column) -> Column:
    """A URN that depends only on the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a page table: page id, record id, target, date, HTTP
    headers, body, payload digest. A table of fetched pages has no dates of its
    own, hence the parameter."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    url = F.coalesce(F.col(url_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        F.col(id_col).alias("page_id"),
        record_id(F.lit("response"), key, url, F.sha1(body.cast("binary"))).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("warc_date"),
        http.alias("http_headers"),
        body.alias("body"),
        F.concat(F.lit("sha1:"), F.sha1(body.cast("binary"))).alias("payload_digest"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of ``responses``-shaped rows."""
    fields = F.concat(
        F.lit("source-record: "), F.col("record_id"),
        F.lit("\r\nsource-payload-digest: "), F.col("payload_digest"),
        F.lit("\r\nsource-http-status: "), F.regexp_extract("http_headers", r"^HTTP/[0-9.]+ ([0-9]+)", 1),
        F.lit("\r\nsource-content-type: "), F.regexp_extract("http_headers", r"(?i)content-type: *([^\r\n]*)", 1),
        F.lit("\r\nsource-length: "), F.octet_length("body").cast("string"),
        F.lit("\r\n"),
    )
    source = records.select("*", fields.alias("__fields"), plain_text(F.col("body")).alias("__text"))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("content_type"), F.col("__fields").alias("block")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("__text").alias("block")),
    )
    flat = source.select("page_id", "record_id", "target_uri", "warc_date", "payload_digest", F.explode(kinds).alias("k"))
    return flat.select(
        "page_id",
        F.col("k.kind").alias("warc_type"),
        record_id(F.col("k.kind"), F.col("record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        F.col("k.content_type").alias("content_type"),
        F.octet_length("k.block").cast("bigint").alias("content_length"),
        F.concat(F.lit("sha1:"), F.sha1(F.col("k.block").cast("binary"))).alias("block_digest"),
        F.col("payload_digest").alias("source_payload_digest"),
        F.col("k.block").alias("block"),
    )


def render(records: DataFrame) -> DataFrame:
    """Serialised WARC/1.1 records of ``derivatives``: one ``record`` (binary) a row."""
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("warc_type"),
        F.lit("\r\nWARC-Record-ID: "), F.col("record_id"),
        F.lit("\r\nWARC-Refers-To: "), F.col("refers_to"),
        F.lit("\r\nWARC-Target-URI: "), F.col("target_uri"),
        F.lit("\r\nWARC-Date: "), F.col("warc_date"),
        F.lit("\r\nWARC-Block-Digest: "), F.col("block_digest"),
        F.lit("\r\nContent-Type: "), F.col("content_type"),
        F.lit("\r\nContent-Length: "), F.col("content_length").cast("string"),
        F.lit("\r\n\r\n"),
    )
    return records.select("page_id", "warc_type", F.concat(head, F.col("block"), F.lit("\r\n\r\n")).cast("binary").alias("record"))


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write each partition as one gzip member per record, ``part-NNNNN.warc.gz``
    in a folder that the executors share; returns (file, records) rows when run.
    A file is written whole under a temporary name and then renamed, so a task
    that runs twice leaves one file."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = os.path.join(folder, f"part-{part:05d}.warc.gz")
        temporary = f"{name}.{TaskContext.get().taskAttemptId()}"
        os.makedirs(folder, exist_ok=True)
        n = 0
        with open(temporary, "wb") as f:
            for batch in batches:
                for record in batch.column(0).to_pylist():
                    f.write(gzip.compress(record, 6, mtime=0))
                    n += 1
        os.replace(temporary, name)
        yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})

    return render(records).select("record").mapInArrow(run, "file string, records bigint")


def parse_record(raw: bytes) -> dict[str, str | bytes]:
    """Headers (lower-case names) and ``block`` of one serialised record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    out: dict[str, str | bytes] = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    out["version"] = lines[0]
    out["block"] = rest[: int(re.sub(r"\D", "", str(out["content-length"])))]
    return out
