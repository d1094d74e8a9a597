"""Health of the corpus: what to write next, orphans, dangling citations, filed answers, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.functions.text import one_line, utf16_order


def article_candidates(unresolved: DataFrame, pages: DataFrame) -> DataFrame:
    """``unresolved(handle, display, citers)`` counted by the citers' titles: ``display, n_titles, titles``."""
    each = unresolved.select("display", F.explode("citers").alias("path")).join(pages.select("path", "title"), "path")
    return each.groupBy("display").agg(F.count_distinct("title").cast("long").alias("n_titles"), F.array_sort(F.collect_set("title")).alias("titles"))


def dangling_citations(citations: DataFrame, manifest: DataFrame) -> DataFrame:
    """Citations of raw files that nothing records."""
    return citations.where(F.col("source").startswith("raw/")).join(manifest.select(F.col("path").alias("source")), "source", "left_anti").select("page", "source")


def counts(kinds: DataFrame) -> DataFrame:
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def age_days(asked: Column, now: Column) -> Column:
    """Whole days from one timestamp to another, rounded down."""
    return F.floor((F.unix_micros(now) - F.unix_micros(asked)) / F.lit(86_400_000_000)).cast("long")


def age_label(asked: Column, now: Column) -> Column:
    days = age_days(asked, now)
    return F.when(asked.isNull(), "unknown").when(days < 0, "future").when(days == 0, "today").otherwise(F.concat(days.cast("string"), F.when(days == 1, " day").otherwise(" days")))


def index_lines(pages: DataFrame) -> DataFrame:
    """``kind, title, line``: an entry of the index for each page."""
    named = F.when(F.size(F.coalesce("aliases", F.array().cast("array<string>"))) > 0, F.concat(F.lit(" (aliases: "), F.array_join("aliases", ", "), F.lit(")"))).otherwise("")
    about = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(" — "), one_line(F.col("summary")))).otherwise("")
    return pages.select("kind", "title", F.concat(F.lit("- [["), F.col("title"), F.lit("]]"), about, named).alias("line"))


#: Sections of the index in order.
SECTIONS = (("source", "Sources"), ("entity", "Entities"), ("concept", "Concepts"))


def index_sections(pages: DataFrame) -> DataFrame:
    """``kind, body``: the lines of a section in title order."""
    lines = index_lines(pages).select("kind", F.struct(utf16_order(F.col("title")).alias("o"), "line").alias("x"))
    return lines.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body"))


def render_index(pages: DataFrame) -> str:
    own = {r.kind: r.body for r in index_sections(pages).collect()}  # three rows
    return "\n".join(["# Index", *[f"\n## {name}\n\n{own[kind]}" for kind, name in SECTIONS if own.get(kind)]]) + "\n"


def report(candidates: DataFrame, orphan_titles: DataFrame, dangling: DataFrame, answers: DataFrame, kinds: DataFrame) -> DataFrame:
    """``section, pos, line``: the report as rows, to be written in order."""

    def section(n: int, df: DataFrame, line: Column, *order) -> DataFrame:
        return df.select(F.lit(n).alias("section"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).cast("string").alias("pos"), line.alias("line"))

    return (
        section(1, candidates, F.concat(F.lit("- **"), F.col("display"), F.lit("** — wanted by "), F.col("n_titles").cast("string"), F.lit(": "), F.array_join("titles", ", ")), F.lpad((F.lit(10**9) - F.col("n_titles")).cast("string"), 10, "0"), F.col("display"))
        .union(section(2, orphan_titles, F.concat(F.lit("- [["), F.col("title"), F.lit("]]")), F.col("title")))
        .union(section(3, dangling, F.concat(F.lit("- [["), F.col("page"), F.lit("]] cites "), F.col("source")), F.col("page"), F.col("source")))
        .union(section(4, answers, F.concat(F.lit("- "), F.col("path"), F.lit(": "), F.col("age")), F.col("path")))
        .union(section(5, kinds, F.concat(F.lit("- "), F.col("kind"), F.lit(": "), F.col("n").cast("string")), F.col("kind")))
    )
