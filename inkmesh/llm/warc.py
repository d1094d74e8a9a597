"""WARC derivative builder.

From each response record two linked records are made: a ``metadata`` record
(title, links and the headers and digests of its source) and a ``conversion``
record with the plain text. Both refer to the response by WARC-Refers-To; the
conversion is named in the metadata, and the digests of the source are kept.

Records are rows ``type, record_id, target_uri, date, headers, block``:
``headers`` an array of ``(name, value)`` in order, ``block`` binary.
``to_bytes`` renders a record as WARC/1.1; ``read_warc`` reads files of them.

Text. A body in chunks or compressed (gzip, deflate) is undone, in Python and only for
records that say so; what ends early gives what there is, other codings give no text.
Bytes are read by the charset of the Content-Type: Latin-1 and its like as Windows-1252,
all else as UTF-8, with U+FFFD for what is none. Character references are replaced.

Defined results: a null HTML is an empty page, a null URL an empty target. Record
ids follow from the record's type, the page's number and its URL and payload, so a
task that runs again makes the same ids, and exactly repeated pages share theirs.
An empty table gives no records. A response without an empty line is all body. Other
columns go along in a struct, whatever their names. A page is one cell, so up to 2 GB;
:func:`read_warc` reads files record by record, so only a record has to fit.
"""

from __future__ import annotations

import gzip
import html.entities
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.llm.common import let, table

EPOCH = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
#: What ends a run of text in the rendered page.
BLOCK_TAGS = "p|br|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|head|body|html"
#: Named characters of HTML 4 by the standard library's table, common ones first; others stay as they are.
NAMED = {n: html.entities.name2codepoint[n] for n in sorted(html.entities.name2codepoint, key=lambda n: (n not in ("amp", "quot", "nbsp", "lt", "gt", "copy", "middot", "rsquo"), n))} | {"apos": 39}
#: What Windows-1252 has in the places 80 to 9F, which pages that say Latin-1 use as well; five are free.
C1 = "".join(map(chr, range(0x80, 0xA0)))
WINDOWS = "\u20ac\x81\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\x8d\u017d\x8f\x90\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\x9d\u017e\u0178"
#: Names of charsets that are read as Windows-1252.
LATIN = ("windows-1252", "cp1252", "iso-8859-1", "iso8859-1", "iso_8859-1", "latin1", "latin-1", "l1", "us-ascii", "ascii")
RECORD = "type string, record_id string, target_uri string, date string, headers array<struct<name:string,value:string>>, block binary"


def urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return let(h, lambda x: F.concat(F.lit("<urn:uuid:"), F.substring(x, 1, 8), F.lit("-"), F.substring(x, 9, 4), F.lit("-"), F.substring(x, 13, 4), F.lit("-"), F.substring(x, 17, 4), F.lit("-"), F.substring(x, 21, 12), F.lit(">")))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def unescaped(text: Column) -> Column:
    """With character references (``&name;`` of HTML 4, ``&#n;``, ``&#xn;``) replaced, each once; a number that is no character gives U+FFFD."""
    named = F.create_map(*[F.lit(x) for n, c in NAMED.items() for x in (n, " " if n == "nbsp" else chr(c))])

    def char(name: Column) -> Column:
        number = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 8)).try_cast("int")
        sound = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        known = F.translate(F.decode(F.unhex(F.lpad(F.hex(F.when(sound, number).otherwise(0xFFFD)), 8, "0")), "UTF-32"), C1, WINDOWS)
        return F.when(name.startswith("#"), known).otherwise(F.element_at(named, name))

    def part(p: Column) -> Column:
        name = F.regexp_extract(p, r"^(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,8}|[a-zA-Z][a-zA-Z0-9]{1,7});", 1)
        own = let(name, lambda n: F.when(n == "", F.lit(None).cast("string")).otherwise(F.concat(char(n), F.substring(p, F.length(n) + 2, F.length(p)))))
        return F.coalesce(own, F.concat(F.lit("&"), p))

    return let(F.split(text, "&"), lambda ps: F.concat(F.element_at(ps, 1), F.array_join(F.transform(F.slice(ps, F.lit(2), F.size(ps)), part), "")))


def plain_text(page: Column) -> Column:
    """Text between tags; comments, scripts and styles go, block tags end lines, white space is tidied, references are replaced."""
    t = F.regexp_replace(F.coalesce(page, F.lit("")), r"(?s)<(?:!--.*?--|(?i:script)[^>]*>.*?</(?i:script)[^>]*|(?i:style)[^>]*>.*?</(?i:style)[^>]*)>", "")
    t = F.regexp_replace(t, r"[ \t\r\n\f]+", " ")
    t = F.regexp_replace(t, rf"</?(?i:{BLOCK_TAGS})(?:[ /][^>]*)?>", "\n")
    t = unescaped(F.regexp_replace(t, r"<[a-zA-Z/!?][^>]*>", ""))
    return F.btrim(F.regexp_replace(t, r" *\n[ \n]*", "\n"), F.lit(" \n"))


def header(headers: Column, name: str) -> Column:
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def pairs(*named: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in named])


def responses(pages: DataFrame, date: str = EPOCH) -> DataFrame:
    """Response records of ``pages(page_id, url, html)``; ``page_id`` goes along."""
    url, body = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    rows = pages.select("page_id", url.alias("url"), body.alias("body"), F.encode(F.concat(http, body), "UTF-8").alias("block"), digest(F.encode(body, "UTF-8")).alias("payload_digest"))
    record_id = urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("url"), F.col("payload_digest"))
    return rows.select(
        "page_id", F.lit("response").alias("type"), record_id.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        pairs(("Content-Type", F.lit("application/http; msgtype=response")), ("WARC-Payload-Digest", F.col("payload_digest")), ("WARC-Block-Digest", digest(F.col("block")))).alias("headers"),
        "block",
    )


def http_head(block: Column) -> Column:
    """Bytes of the header lines of an HTTP message, without the empty line; none if there is no empty line."""
    text = block.cast("string")
    return let(F.substring_index(text, "\r\n\r\n", 1), lambda h: F.when(F.octet_length(h) < F.octet_length(text), h).otherwise(""))


def http_body(block: Column, head: Column) -> Column:
    """Bytes behind the header lines; without an empty line all is body."""
    return F.when(head == "", block).otherwise(F.substring(block, F.octet_length(head) + 5, F.octet_length(block)))


def decoded(body: Column, head: Column) -> Column:
    """Bytes as text: by the charset of the Content-Type if it is one of ``LATIN``, else as UTF-8, U+FFFD for what is none."""
    charset = F.lower(F.regexp_extract(head, r"(?i)(?:^|\n)content-type:[^\r\n]*?charset *= *[\"']?([^\s;\"',]+)", 1))
    return F.when(charset.isin(*LATIN), F.translate(F.decode(body, "ISO-8859-1"), C1, WINDOWS)).otherwise(F.make_valid_utf8(body.cast("string")))


CODED = r"(?i)(?:^|\n)(?:content-encoding|transfer-encoding):"


def _dechunked(raw: bytes) -> bytes:
    """The chunks up to the last or the end; what does not begin with the size of a chunk is in none."""
    out, at = [], 0
    while size := re.compile(rb"[ \t]*([0-9a-fA-F]{1,15})[^\r\n]*\r?\n").match(raw, at):
        n = int(size[1], 16)
        if not n:
            return b"".join(out)
        out.append(raw[size.end() : size.end() + n])
        at = size.end() + n + len(re.compile(rb"\r?\n?").match(raw, size.end() + n)[0])
    return b"".join(out) if out else raw


def _inflated(raw: bytes, wbits: tuple[int, ...]) -> bytes:
    for w in wbits:
        own, out = zlib.decompressobj(w), b""
        try:
            out = own.decompress(raw)
            return out + own.flush()
        except zlib.error:
            if out:
                return out
    return b""


def _uncoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for head, raw in zip(batch.column("http_head").to_pylist(), batch.column("body").to_pylist(), strict=True):
            named = {n.strip().lower(): v.strip().lower() for n, _, v in (x.partition(":") for x in (head or "").split("\n"))}
            if "chunked" in named.get("transfer-encoding", ""):
                raw = _dechunked(raw)
            for coding in reversed([c.strip() for c in named.get("content-encoding", "").split(",") if c.strip()]):
                if coding in ("gzip", "x-gzip"):
                    raw = _inflated(raw, (31,))
                elif coding == "deflate":
                    raw = _inflated(raw, (15, -15))
                elif coding != "identity":
                    raw = b""
            out.append(raw)
        yield batch.set_column(batch.schema.get_field_index("body"), "body", pa.array(out, pa.binary()))


def bodies(records: DataFrame, coded: bool = True) -> DataFrame:
    """``records`` of responses with ``http_head`` and ``body`` in place of ``block``. ``coded``: chunks and compression are undone, for the records that have any."""
    head = F.make_valid_utf8(http_head(F.col("block")))
    rows = records.withColumn("http_head", head).withColumn("body", http_body(F.col("block"), http_head(F.col("block")))).drop("block")
    if not coded:
        return rows
    is_coded = F.col("http_head").rlike(CODED)
    return rows.where(~is_coded).unionByName(rows.where(is_coded).mapInArrow(_uncoded, rows.schema))


def derive(records: DataFrame, coded: bool = True) -> DataFrame:
    """Metadata and conversion records of the response records; further columns go along. ``coded=False``: no record's body is in chunks or compressed."""
    own = ("type", "record_id", "target_uri", "date", "headers", "block")
    kept = ["kept"]
    records = records.select(F.struct(F.lit(1).alias("_"), *[F.col(c) for c in records.columns if c not in own]).alias("kept"), *own)
    source = bodies(records.where("type = 'response'").select(*kept, "record_id", "target_uri", "date", "headers", "block"), coded)
    source = source.select(*kept, "record_id", "target_uri", "date", "headers", "http_head", decoded(F.col("body"), F.col("http_head")).alias("http_body"))
    source = source.select(*kept, "record_id", "target_uri", "date", "headers", "http_head", plain_text(F.col("http_body")).alias("text"), F.regexp_extract("http_body", r"(?is)<title[^>]*>(.*?)</title", 1).alias("title"), F.array_distinct(F.regexp_extract_all("http_body", F.lit(r"(?i)<a [^>]*href=\"([^\"]*)\""), F.lit(1))).alias("links"))
    payload, block_digest = header(F.col("headers"), "WARC-Payload-Digest"), header(F.col("headers"), "WARC-Block-Digest")
    conversion_id = urn(F.lit("conversion"), F.col("record_id"))
    fields = F.concat(
        F.lit("title: "), F.regexp_replace(F.trim("title"), r"\s+", " "), F.lit(CRLF + "conversion: "), conversion_id,
        F.lit(CRLF + "source-payload-digest: "), F.coalesce(payload, F.lit("")), F.lit(CRLF + "source-block-digest: "), F.coalesce(block_digest, F.lit("")), F.lit(CRLF),
        F.array_join(F.transform(F.filter(F.split("http_head", CRLF), lambda x: x.contains(":")), lambda x: F.concat(F.lit("source-header: "), x, F.lit(CRLF))), ""),
        F.array_join(F.transform("links", lambda x: F.concat(F.lit("outlink: "), x, F.lit(CRLF))), ""),
    )

    def record(kind: str, record_id: Column, content_type: str, text: Column) -> Column:
        block = F.encode(text, "UTF-8")
        named = pairs(("WARC-Refers-To", F.col("record_id")), ("Content-Type", F.lit(content_type)), ("WARC-Block-Digest", digest(block)), ("WARC-Source-Payload-Digest", payload))
        return F.struct(F.lit(kind).alias("type"), record_id.alias("record_id"), "target_uri", "date", named.alias("headers"), block.alias("block"))

    both = F.array(record("metadata", urn(F.lit("metadata"), F.col("record_id")), "application/warc-fields", fields), record("conversion", conversion_id, "text/plain; charset=utf-8", F.col("text")))
    carried = [f"kept.{f}" for f in records.schema["kept"].dataType.names if f != "_"]
    return source.select(*kept, F.explode(both).alias("r")).select(*carried, "r.*")


def to_bytes(records: DataFrame) -> DataFrame:
    """Adds ``bytes``: the record as it stands in a WARC/1.1 file."""
    named = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit(CRLF))), "")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.col("type"), F.lit(CRLF + "WARC-Record-ID: "), F.col("record_id"), F.lit(CRLF + "WARC-Target-URI: "), F.col("target_uri"), F.lit(CRLF + "WARC-Date: "), F.col("date"), F.lit(CRLF), named, F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit(CRLF + CRLF))
    return records.withColumn("bytes", F.concat(F.encode(head, "UTF-8"), F.col("block"), F.encode(F.lit(CRLF + CRLF), "UTF-8")))


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """Records of an open WARC file, plain or gzipped by record, one at a time."""
    start = stream.peek(2)[:2] if hasattr(stream, "peek") else b""
    f = io.BufferedReader(gzip.GzipFile(fileobj=stream)) if start == b"\x1f\x8b" else stream
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        named = []
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            named.append((name.strip(), value.strip()))
        own = {k.lower(): v for k, v in named}
        block = f.read(int(own.get("content-length", 0)))
        rest = [(k, v) for k, v in named if k.lower() not in ("warc-type", "warc-record-id", "warc-target-uri", "warc-date", "content-length")]
        yield own.get("warc-type"), own.get("warc-record-id"), own.get("warc-target-uri"), own.get("warc-date"), rest, block


def read_warc(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """Records of the WARC files under ``path``, one by one, a file for each task at a time.

    ``stream``: a file is opened where the task runs, so it may have any size. Without it
    Spark reads each file into a cell of up to 2 GB, in any store that Spark knows.
    """

    def opened(batch: pa.RecordBatch) -> Iterator[io.BufferedReader]:
        from pyarrow import fs

        for own in batch.column(0).to_pylist():
            if not stream:
                yield io.BufferedReader(io.BytesIO(own))
                continue
            system, name = fs.FileSystem.from_uri(own)
            with system.open_input_file(name) as f:
                yield io.BufferedReader(f)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in opened(batch):
                for record in parse_warc(f):
                    own = [*record[:4], [{"name": k, "value": v} for k, v in record[4]], record[5]]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(own, _RECORD, strict=True)], ["type", "record_id", "target_uri", "date", "headers", "block"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if not stream:
        return files.select("content").mapInArrow(records, RECORD)
    uri = F.regexp_replace("path", "^file:/+", "file:///")
    return files.select(uri.alias("path")).mapInArrow(records, RECORD)


_RECORD = [*[pa.string()] * 4, pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.binary()]


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive(responses(table(spark, sf_dir, "pages").select("page_id", "url", "html")), coded=False)
    h = F.col("headers")
    return made.select(
        "page_id", "type", "record_id", header(h, "WARC-Refers-To").alias("refers_to"), "target_uri", header(h, "Content-Type").alias("content_type"),
        header(h, "WARC-Block-Digest").alias("block_digest"), header(h, "WARC-Source-Payload-Digest").alias("source_payload_digest"),
        F.octet_length("block").cast("long").alias("block_bytes"),
    )


OP5_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, 'sha256:' || sha256(coalesce(html, '')) AS pd FROM pages),
b AS (SELECT *, strlen(html) AS n, md5('response|' || coalesce(page_id::VARCHAR, '') || '|' || url || '|' || pd) AS h FROM p),
q AS (
  SELECT *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS rid,
    'sha256:' || sha256('HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || n || chr(13) || chr(10) || chr(13) || chr(10) || html) AS bd,
    regexp_replace(html, '(?s)<(?:!--.*?--|(?i:script)[^>]*>.*?</(?i:script)[^>]*|(?i:style)[^>]*>.*?</(?i:style)[^>]*)>', '', 'g') AS t1
  FROM b),
r AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(t1, '[ \t\r\n\f]+', ' ', 'g'), '(?i)</?(?:{BLOCK_TAGS})(?:[ /][^>]*)?>', chr(10), 'g'), '<[a-zA-Z/!?][^>]*>', '', 'g') AS t2,
    md5('conversion|' || rid) AS ch, md5('metadata|' || rid) AS mh,
    regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1) AS title,
    regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1) AS ls
  FROM q),
s AS (
  SELECT *, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(t2, '&copy;', chr(169)), '&middot;', chr(183)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), ' *\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS text,
    '<urn:uuid:' || ch[1:8] || '-' || ch[9:12] || '-' || ch[13:16] || '-' || ch[17:20] || '-' || ch[21:32] || '>' AS cid,
    '<urn:uuid:' || mh[1:8] || '-' || mh[9:12] || '-' || mh[13:16] || '-' || mh[17:20] || '-' || mh[21:32] || '>' AS mid,
    (SELECT coalesce(string_agg('outlink: ' || l || chr(13) || chr(10), '' ORDER BY i), '') FROM (SELECT l, min(i) AS i FROM (SELECT unnest(ls) AS l, generate_subscripts(ls, 1) AS i) GROUP BY l)) AS outlinks
  FROM r),
m AS (
  SELECT *, 'title: ' || regexp_replace(trim(title, ' '), '\s+', ' ', 'g') || chr(13) || chr(10) || 'conversion: ' || cid || chr(13) || chr(10) || 'source-payload-digest: ' || pd || chr(13) || chr(10)
    || 'source-block-digest: ' || bd || chr(13) || chr(10) || 'source-header: Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'source-header: Content-Length: ' || n || chr(13) || chr(10) || outlinks AS fields
  FROM s)
SELECT page_id, 'metadata' AS type, mid AS record_id, rid AS refers_to, url AS target_uri, 'application/warc-fields' AS content_type,
       'sha256:' || sha256(fields) AS block_digest, pd AS source_payload_digest, strlen(fields)::BIGINT AS block_bytes FROM m
UNION ALL
SELECT page_id, 'conversion', cid, rid, url, 'text/plain; charset=utf-8', 'sha256:' || sha256(text), pd, strlen(text)::BIGINT FROM m
"""
