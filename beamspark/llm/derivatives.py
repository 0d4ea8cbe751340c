"""Derivative records of web responses: linked metadata and plain-text conversion records.

Each response gives two records. The conversion holds the payload as plain text; the metadata holds the response's HTTP
headers as they are, its payload digest, and size and digest of the text. Both name the response they refer to
(identifier, URI, date) and each other. Record identifiers are made from the type, the response's identifier and the
block, so that a second run makes the same ones.

Row by row in DataFrame functions, no shuffle; the references of a page, not its text, go through Python, which knows all of HTML5's
names and the decimal and hexadecimal ones. Null or empty payloads give an empty text. Header lines without a value
(null URI, date or HTTP headers) are left out. A null identifier gives records that refer to nothing. Repeated
rows give their records each; columns named in ``keep`` stay, others don't. An empty table gives no rows.
"""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Named references that the SQL twin replaces; & goes last.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#160;", " "), ("&copy;", "©"),
              ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"),
              ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&"))
REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"  # what html.unescape takes for one
COMMENT = "(?s)<!--.*?-->"
HIDDEN = "(?is)<(script|style|template|noscript)\\b[^>]*>.*?</(script|style|template|noscript)\\s*>"
BLOCK = ("(?i)</?(p|div|h[1-6]|li|ul|ol|tr|td|th|table|br|hr|section|article|main|nav|header|footer|aside|form|title|blockquote|pre|dl|dt|dd|head|body|html|option)"
         "\\b[^>]*>")
TAG = "<[!/?a-zA-Z][^>]*>"
SPACES, LINES, EDGES = "[ \\t\\r\\f\\x{00A0}]+", " ?\\n[ \\n]*", "^[ \\n]+|[ \\n]+$"
CRLF = "\r\n"


@F.arrow_udf(T.ArrayType(T.StringType()))
def decoded(references: pa.Array) -> pa.Array:
    """What each reference stands for; unknown ones stay."""
    return pa.array([None if r is None else [html.unescape(x) for x in r] for r in references.to_pylist()], pa.list_(pa.string()))


def unescaped(text: Column) -> Column:
    """Text with all references replaced, once: what they stand for is not looked at again."""
    found = decoded(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)))
    pieces = F.split(text, REFERENCE)  # one more than references
    return F.array_join(F.zip_with(pieces, found, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")


def plain_text(payload: Column) -> Column:
    """Text of a page: blocks on lines of their own, one space for white space, references replaced."""
    t = F.coalesce(payload, F.lit(""))
    for pattern, by in ((COMMENT, ""), (HIDDEN, ""), (BLOCK, "\n"), (TAG, "")):
        t = F.regexp_replace(t, pattern, by)
    t = unescaped(t)
    for pattern, by in ((SPACES, " "), (LINES, "\n"), (EDGES, "")):
        t = F.regexp_replace(t, pattern, by)
    return t


def urn(*parts: Column) -> Column:
    """Identifier made from the parts: the form of a name-based UUID."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-5"), cut[2], F.lit("-8"), cut[3], F.lit("-"), cut[4])


def line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def responses(pages: DataFrame) -> DataFrame:
    """Response rows of the ``pages`` table, which holds no dates and no headers but the type of its rows."""
    payload = F.coalesce("html", F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"))
    return pages.select("page_id", urn(F.lit("response"), F.col("page_id").cast("string"), F.col("url"), F.sha2(payload, 256)).alias("record_id"),
                        F.col("url").alias("target_uri"), F.lit(None).cast("string").alias("date"), headers.alias("http_headers"), F.col("html").alias("payload"))


def derived(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two records per response: record_type, record_id, refers_to, concurrent_to, header, block, block_digest, source_digest."""
    rows = rows.select(*keep, "record_id", "target_uri", "date", "http_headers",
                       F.concat(F.lit("sha256:"), F.sha2(F.coalesce("payload", F.lit("")), 256)).alias("source_digest"), plain_text(F.col("payload")).alias("text"))
    fields = F.concat_ws(
        CRLF, line("refers-to", F.col("record_id")), line("source-payload-digest", F.col("source_digest")), line("text-length", F.length("text").cast("string")),
        line("text-digest", F.concat(F.lit("sha256:"), F.sha2("text", 256))), line("source-headers", F.replace("http_headers", F.lit(CRLF), F.lit(f"{CRLF}\t"))))
    rows = rows.withColumn("fields", F.concat(fields, F.lit(CRLF)))
    rows = rows.withColumns({"conversion_id": urn(F.lit("conversion"), F.col("record_id"), F.col("text")), "metadata_id": urn(F.lit("metadata"), F.col("record_id"), F.col("fields"))})

    def record(kind: str, own: str, other: str, content: str, block: str) -> Column:
        digest = F.concat(F.lit("sha256:"), F.sha2(block, 256))
        header = F.concat_ws(
            CRLF, F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), line("WARC-Record-ID", F.concat(F.lit("<"), own, F.lit(">"))),
            line("WARC-Refers-To", F.concat(F.lit("<"), "record_id", F.lit(">"))), line("WARC-Refers-To-Target-URI", F.col("target_uri")),
            line("WARC-Refers-To-Date", F.col("date")), line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("target_uri")),
            line("WARC-Concurrent-To", F.concat(F.lit("<"), other, F.lit(">"))), line("WARC-Block-Digest", digest),
            F.lit(f"Content-Type: {content}"), line("Content-Length", F.octet_length(block).cast("string")))
        return F.struct(F.lit(kind).alias("record_type"), F.col(own).alias("record_id"), F.col("record_id").alias("refers_to"), F.col(other).alias("concurrent_to"),
                        F.concat(header, F.lit(CRLF * 2)).alias("header"), F.col(block).alias("block"), digest.alias("block_digest"), F.col("source_digest"))

    both = F.array(record("metadata", "metadata_id", "conversion_id", "application/warc-fields", "fields"),
                   record("conversion", "conversion_id", "metadata_id", "text/plain; charset=utf-8", "text"))
    return rows.select(*keep, F.explode(both).alias("r")).select(*keep, "r.*")


def _sql() -> str:
    text = "coalesce(html, '')"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern, by in ((COMMENT, ""), (HIDDEN, ""), (BLOCK, "\n"), (TAG, "")):
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(by)}, 'g')"
    for name, by in REFERENCES:
        text = f"replace({text}, {quote(name)}, {quote(by)})"
    for pattern, by in ((SPACES, " "), (LINES, "\n"), (EDGES, "")):
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(by)}, 'g')"
    crlf = "chr(13) || chr(10)"
    urn_of = lambda *p: ("(SELECT 'urn:uuid:' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-8' || h[18:20] || '-' || h[21:32] "  # noqa: E731
                         f"FROM (SELECT sha256(concat_ws(chr(10), {', '.join(p)})) AS h))")

    def record(kind: str, own: str, other: str, content: str, block: str) -> str:
        return f"""
SELECT page_id, '{kind}' AS record_type, {own} AS record_id, record_id AS refers_to, {other} AS concurrent_to,
  concat_ws({crlf}, 'WARC/1.1', 'WARC-Type: {kind}', 'WARC-Record-ID: <' || {own} || '>', 'WARC-Refers-To: <' || record_id || '>',
    'WARC-Refers-To-Target-URI: ' || url, 'WARC-Target-URI: ' || url, 'WARC-Concurrent-To: <' || {other} || '>',
    'WARC-Block-Digest: sha256:' || sha256({block}), 'Content-Type: {content}', 'Content-Length: ' || CAST(strlen({block}) AS VARCHAR)) || {crlf} || {crlf} AS header,
  {block} AS block, 'sha256:' || sha256({block}) AS block_digest, source_digest FROM ids"""

    return f"""
WITH source AS (
  SELECT page_id, url, 'sha256:' || sha256(coalesce(html, '')) AS source_digest, strlen(coalesce(html, '')) AS size, {text} AS text,
    {urn_of("'response'", "CAST(page_id AS VARCHAR)", "url", "sha256(coalesce(html, ''))")} AS record_id FROM pages),
described AS (
  SELECT *, concat_ws({crlf}, 'refers-to: ' || record_id, 'source-payload-digest: ' || source_digest, 'text-length: ' || CAST(length(text) AS VARCHAR),
    'text-digest: sha256:' || sha256(text), 'source-headers: HTTP/1.1 200 OK', chr(9) || 'Content-Type: text/html; charset=utf-8',
    chr(9) || 'Content-Length: ' || CAST(size AS VARCHAR)) || {crlf} AS fields FROM source),
ids AS (SELECT *, {urn_of("'conversion'", "record_id", "text")} AS conversion_id, {urn_of("'metadata'", "record_id", "fields")} AS metadata_id FROM described)
{record("metadata", "metadata_id", "conversion_id", "application/warc-fields", "fields")} UNION ALL
{record("conversion", "conversion_id", "metadata_id", "text/plain; charset=utf-8", "text")}
"""


SQL = _sql()
