"""Signs that text was badly extracted: starved output, running headers, broken sentences.

Extractions are rows ``doc, page, text``; ``page_count(doc, n)`` may give more pages than
have text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.functions.text import trim, utf16_length

CHARS_A_PAGE, HEADER_PAGES, HEADER_LENGTH, LEAST_LINES, FRAGMENTS = 200, 3, 4, 20, 0.6
#: Fixed value: what ends a finished line.
FINISHED = r"""[.!?:;"'”’)\]]$"""


def lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: trim(x))


def chars_a_page(pages: DataFrame, page_count: DataFrame | None = None) -> DataFrame:
    """``doc, chars, pages, short``."""
    own = pages.groupBy("doc").agg(F.sum(utf16_length(trim(F.col("text")))).alias("chars"), F.count(F.lit(1)).alias("pages"))
    if page_count is not None:
        own = own.join(page_count, "doc", "left").select("doc", "chars", F.greatest("pages", F.coalesce("n", F.lit(0))).alias("pages"))
    return own.withColumn("short", F.col("chars") / F.col("pages") < CHARS_A_PAGE)


def repeated_line_pages(pages: DataFrame) -> DataFrame:
    """``doc, header_pages``: the most pages that share a line."""
    each = pages.select("doc", "page", F.explode(F.array_distinct(lines(F.col("text")))).alias("line")).where(utf16_length(F.col("line")) >= HEADER_LENGTH)
    return each.groupBy("doc", "line").agg(F.count_distinct("page").alias("n")).groupBy("doc").agg(F.max("n").alias("header_pages"))


def fragment_ratio(pages: DataFrame) -> DataFrame:
    """``doc, lines, fragment_ratio``: lines that end unfinished; null for too few lines."""
    own = F.filter(lines(F.col("text")), lambda x: x != "")
    one = pages.select("doc", F.size(own).alias("n"), F.size(F.filter(own, lambda x: ~F.regexp_like(x, F.lit(FINISHED)))).alias("f"))
    sums = one.groupBy("doc").agg(F.sum("n").alias("lines"), F.sum("f").alias("f"))
    return sums.select("doc", "lines", F.when(F.col("lines") >= LEAST_LINES, F.col("f") / F.col("lines")).alias("fragment_ratio"))


def reasons(pages: DataFrame, page_count: DataFrame | None = None) -> DataFrame:
    """``doc, reasons``: why an extraction looks suspect, in a fixed order; empty: it looks clean."""
    one = chars_a_page(pages, page_count).join(repeated_line_pages(pages), "doc", "left").join(fragment_ratio(pages), "doc", "left")
    plural = F.when(F.col("pages") == 1, "").otherwise("s")
    percent = F.floor(F.col("fragment_ratio") * 100 + 0.5).cast("string")
    found = F.array(
        F.when(F.col("short"), F.concat(F.lit("short output for "), F.col("pages").cast("string"), F.lit(" page"), plural)),
        F.when(F.col("header_pages") >= HEADER_PAGES, F.concat(F.lit("repeated line on "), F.col("header_pages").cast("string"), F.lit(" pages"))),
        F.when(F.col("fragment_ratio") > FRAGMENTS, F.concat(F.lit("high sentence-fragment ratio ("), percent, F.lit("%)"))),
    )
    return one.select("doc", F.array_compact(found).alias("reasons"))
