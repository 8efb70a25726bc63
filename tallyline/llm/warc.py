"""WARC derivatives: responses turned into linked metadata and plain-text conversion records.

Every response gives two records that refer to it by its record id and carry its target, its
date, its source headers and the digest of what they were made from. Records are rows with
their header block and content; written one after another they are a WARC file.
"""

from __future__ import annotations

import html as html_references
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

CRLF = "\r\n"
# Elements whose content is no text of the page; they go with everything up to their own end tag or the page's end.
DROPPED = "script|style|noscript|template"
# What comes first of a title or text field (stays; nothing in it is markup), a comment and a dropped element.
_ASIDE = (
    r"(?is)(<(title|textarea)\b[^>]*>.*?</\2\b[^>]*>)"
    rf"|<!--(?:-?>|.*?(?:--!?>|\z))|<({DROPPED})\b[^>]*>.*?(?:</\3\b[^>]*>|\z)"
)
# A head ends at its end tag, or else before the first text or element that cannot be in one.
_TAG_REST = r"""(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)"""
_HEAD = (
    r"(?is)<head(?=[\s/>])" + _TAG_REST + r"(?:\s++|<title\b[^>]*>.*?</title\b[^>]*>|<(?:meta|link|base|basefont|bgsound)\b" + _TAG_REST
    + r"|<[!?][^>]*+>|</(?!(?:head|body|html|br)\b)[a-z][^>]*+>)*+(?:</head[^>]*>)?"
)
# Elements that end a line.
BREAKING = (
    "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
)
# The references that the SQL twin decodes, the ampersand last; the tables hold no others.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
# Runs of blanks, and single ones that are no space; a single space stays as it is.
_BLANK = r"[ \t\x0B\f\r]{2,}|[\t\x0B\f\r]"


_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][^\t\n\f <&#;]{0,31};?)")


@lru_cache(1 << 16)
def _character(reference: str) -> str:
    """What a reference stands for by the HTML5 table or its number; blanks and line breaks become spaces, as written ones do."""
    if reference.startswith("&#"):
        # More digits than any code point has name none.
        digits = reference[2:].rstrip(";").lstrip("xX0")
        if len(digits) > 8:
            return "\ufffd"
    return re.sub("[\xa0\n\r]", " ", html_references.unescape(reference))


@F.arrow_udf(StringType())
def decoded(texts: pa.Array) -> pa.Array:
    """Texts with all numeric and named character references decoded once."""
    return pa.array([t if t is None or "&" not in t else _REFERENCE.sub(lambda m: _character(m[0]), t) for t in texts.to_pylist()], pa.string())


def plain_text(html: Column) -> Column:
    """The text of a page: comments, scripts and tags go, blocks become lines, references are decoded, blanks collapse."""
    text = F.regexp_replace(html, _ASIDE, "$1 ")
    text = F.regexp_replace(text, _HEAD, " ")
    text = F.regexp_replace(text, r"[\r\n]+", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BREAKING})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[A-Za-z/!?][^>]*>", "")
    text = F.regexp_replace(decoded(text), _BLANK, " ")
    text = F.regexp_replace(text, r" ?\n[ \n]*", "\n")
    return F.trim(text, F.lit(" \n"))


def title_of(html: Column) -> Column:
    """The title as written, blanks collapsed; empty if there is none."""
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1), r"[ \t\x0B\f\r\n]+", " "))


def _uuid(text: Column) -> Column:
    """A record id that depends on ``text`` only, so a repeated run makes the same records."""
    digest = F.sha2(text, 256)
    parts = [digest.substr(1, 8), digest.substr(9, 4), F.concat(F.lit("8"), digest.substr(14, 3)), F.concat(F.lit("a"), digest.substr(18, 3)), digest.substr(21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str) -> DataFrame:
    """Pages (page_id, url, html) as response records: page_id, record_id, target_uri, date, headers, payload and payload_digest."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    page_id = F.col("page_id").cast("long")
    headers = F.concat(
        F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF)
    )
    return pages.select(
        page_id.alias("page_id"),
        _uuid(F.concat_ws("|", F.lit("response"), F.coalesce(page_id.cast("string"), F.lit("")), url, html)).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("date"),
        headers.alias("headers"),
        html.alias("payload"),
        _digest(html).alias("payload_digest"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows per response: its ``conversion`` (plain text) and its ``metadata`` record.

    Columns: page_id, record_type, record_id, refers_to, target_uri, source_digest (of the
    response's payload), block_digest, content_length (bytes), header (the WARC header block)
    and content. The metadata names the response, its conversion and its source headers, title
    and number of links. A null or empty page gives an empty conversion. Repeated responses give
    repeated records; no responses give none; other columns are ignored.
    """
    made = records.select("page_id", "record_id", "target_uri", "date", "headers", "payload_digest", "payload", plain_text(F.col("payload")).alias("text"))
    conversion_id = _uuid(F.concat(F.lit("conversion|"), F.col("record_id")))
    links = F.size(F.regexp_extract_all(F.col("payload"), F.lit(r"(?i)<a\b[^>]*\bhref="), F.lit(0)))
    fields = F.concat(
        F.lit("via: "), F.col("record_id"), F.lit(CRLF + "conversion: "), conversion_id,
        F.lit(CRLF + "title: "), title_of(F.col("payload")), F.lit(CRLF + "outlinks: "), links.cast("string"),
        F.lit(CRLF), F.regexp_replace("headers", r"([^\r\n]+)", "source-header: $1"),
    )

    def record(kind: str, record_id: Column, content: Column, content_type: str) -> Column:
        return F.struct(F.lit(kind).alias("record_type"), record_id.alias("id"), content.alias("content"), F.lit(content_type).alias("content_type"))

    both = F.array(
        record("conversion", conversion_id, F.col("text"), "text/plain; charset=utf-8"),
        record("metadata", _uuid(F.concat(F.lit("metadata|"), F.col("record_id"))), fields, "application/warc-fields"),
    )
    rows = made.select("page_id", "record_id", "target_uri", "date", "payload_digest", F.inline(both))
    length = F.octet_length("content").cast("long")
    header = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.col("record_type"), F.lit(CRLF + "WARC-Record-ID: "), F.col("id"),
        F.lit(CRLF + "WARC-Refers-To: "), F.col("record_id"), F.lit(CRLF + "WARC-Target-URI: "), F.col("target_uri"),
        F.lit(CRLF + "WARC-Date: "), F.col("date"), F.lit(CRLF + "WARC-Source-Payload-Digest: "), F.col("payload_digest"),
        F.lit(CRLF + "WARC-Block-Digest: "), _digest(F.col("content")), F.lit(CRLF + "Content-Type: "), F.col("content_type"),
        F.lit(CRLF + "Content-Length: "), length.cast("string"), F.lit(CRLF + CRLF),
    )
    return rows.select(
        "page_id", "record_type", F.col("id").alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri",
        F.col("payload_digest").alias("source_digest"), _digest(F.col("content")).alias("block_digest"), length.alias("content_length"),
        header.alias("header"), "content",
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Derived records as WARC text files, gzipped per file, each record ended by two line breaks."""
    body = F.concat("header", "content")
    records.select(body.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)
