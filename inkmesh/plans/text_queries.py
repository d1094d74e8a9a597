"""Queries over notes' heads and blocks, delimited text and HTML. Each has its SQL beside it, if SQL can tell the result."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from inkmesh.functions.blocks import Trace, citation_entries, parse_trace, trace_lines, with_block
from inkmesh.functions.frontmatter import ensure, parse, render
from inkmesh.operators.shared import shared_folder
from inkmesh.plans.graph_queries import WIKI, table, wiki
from inkmesh.sources import delimited, html


def citation_parse(spark, sf_dir):
    """Citation blocks written into texts and read back; the last block of a text counts."""
    w = wiki(spark, sf_dir)
    entry = F.concat(F.lit("raw/["), F.col("title"), F.lit("] notes.md"))
    block = lambda *lines: F.concat_ws("\n", F.lit("<!-- citations:start -->"), F.lit("## Sources"), *lines, F.lit("<!-- citations:end -->"))
    line = lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))
    text = F.concat_ws("\n", F.col("summary"), block(line(F.lit("raw/old.md"))), F.col("text"), block(line(entry), F.lit("no entry"), line(F.col("path"))))
    return w.select("path", F.array_join(citation_entries(text), "|").alias("entries"))


def frontmatter_parse(spark, sf_dir):
    """Heads written for pages, given a further key, and read back."""

    def read(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                text = ensure(render({"kind": r.kind, "summary": r.summary}) + "body", {"updated": "2024-01-02", "kind": "other"})
                data = parse(text).data
                out.append((r.path, data["kind"], data["summary"], data["updated"], parse(text).body))
            yield pd.DataFrame(out, columns=["path", "kind", "summary", "updated", "body"])

    return wiki(spark, sf_dir).select("path", "kind", "summary").mapInPandas(read, "path string, kind string, summary string, updated string, body string")


def trace_roundtrip(spark, sf_dir):
    """Traces written into notes and read back: what differs from what was written."""

    def read(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                t = Trace("B" if len(r.title) % 2 else "A", [r.title, r.path], len(r.summary) % 2 == 0, [(r.title + ", x", 0.25), (r.path, 0.0625)])
                back = parse_trace(with_block(with_block(r.text, "trace", ["- mode: A"]), "trace", trace_lines(t)))
                out.append((r.path, back.mode, back.seeds[0], back.round2, back.top[0][0], back.top[1][1]))
            yield pd.DataFrame(out, columns=["path", "mode", "seed", "round2", "first", "score"])

    return wiki(spark, sf_dir).select("path", "title", "summary", "text").mapInPandas(read, "path string, mode string, seed string, round2 boolean, first string, score double")


def delimited_parse(spark, sf_dir):
    """Customers written as delimited text with quotes, separators and line ends inside, and read back."""
    quoted = F.concat(F.lit('"'), F.replace("c_mktsegment", F.lit("I"), F.lit('""')), F.lit(',\n"'))
    c = table(spark, sf_dir, "customer").withColumn("row", F.concat_ws(",", F.col("c_custkey").cast("string"), quoted, F.col("c_name")))
    files = c.groupBy((F.col("c_custkey") % 7).alias("f")).agg(F.concat_ws("\r\n", F.collect_list("row")).alias("text"))
    return files.select(F.explode(delimited.parse_rows("text", F.lit(","))).alias("r")).select(F.col("r")[0].alias("key"), F.col("r")[1].alias("segment"), F.col("r")[2].alias("name"))


def delimited_files(spark, sf_dir):
    """Documents written as delimited files, line ends inside quotes, and read back in many tasks."""
    d = table(spark, sf_dir, "documents")
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit(',\n""\n"'))
    path = f"{shared_folder(spark)}/delimited-{uuid.uuid4().hex}"
    d.select(F.concat_ws(",", F.col("doc_id").cast("string"), quoted, F.concat(F.coalesce("lang", F.lit("")), F.lit(' "x')))).write.text(path)
    field = lambda k: F.get("fields", F.lit(k))
    return delimited.read(spark, path).select(field(0).alias("key"), field(1).alias("text"), field(2).alias("lang"), F.size("fields").cast("long").alias("n_fields"))


def html_to_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.markdown("html").alias("markdown"))


QUERIES = [
    (citation_parse, f"WITH {WIKI} SELECT path, 'raw/[' || title || '] notes.md|' || path AS entries FROM pg"),
    (frontmatter_parse, f"WITH {WIKI} SELECT path, kind, summary, '2024-01-02' AS updated, 'body' AS body FROM pg"),
    (trace_roundtrip, f"WITH {WIKI} SELECT path, CASE WHEN length(title) % 2 = 1 THEN 'B' ELSE 'A' END AS mode, title AS seed, length(summary) % 2 = 0 AS round2, title || ', x' AS first, 0.0625::DOUBLE AS score FROM pg"),
    (delimited_parse, "SELECT c_custkey::VARCHAR AS key, replace(c_mktsegment, 'I', '\"') || ',' || chr(10) AS segment, c_name AS name FROM customer"),
    (delimited_files, "SELECT doc_id::VARCHAR AS key, coalesce(text, '') || ',' || chr(10) || '\"' || chr(10) AS text, coalesce(lang, '') || ' \"x' AS lang, 3::BIGINT AS n_fields FROM documents"),
    (html_to_markdown, None),
]
