"""Links inside texts: extraction, name tables, resolution, unresolved targets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.functions.markers import link_outside_column
from inkmesh.functions.text import handle, trim, utf16_order
from inkmesh.operators.shared import kept

LINK = r"\[\[([^\]\n]+)\]\]"


def link_targets(text: Column) -> Column:
    """Distinct targets in order of their first place: what stands before a ``|``, trimmed."""
    found = F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), lambda x: trim(F.substring_index(x, "|", 1)))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def page_part(target: Column) -> Column:
    """Without a heading or block reference."""
    return F.regexp_replace(target, r"(?s)[#^].*$", "")


def is_title_link(target: Column) -> Column:
    """Links that name a page by title: no path under ``raw/``, no heading or block reference."""
    return ~target.startswith("raw/") & ~target.rlike("[#^]")


def first_claimants(claims: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of each key in the given order; empty keys claim nothing.

    A least struct rather than a window: it is combined before the shuffle, so a key that
    very many claim costs no more than another.
    """
    by = [(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)]
    row = F.struct(*[c for c in claims.columns if c != key]).alias("row")
    return claims.where(F.col(key) != "").groupBy(key).agg(F.min(F.struct(*by, row))["row"].alias("row")).select(key, "row.*")


def title_index(pages: DataFrame, nfc: bool = True) -> DataFrame:
    """``handle -> title, path``: titles beat aliases, ties go by title. ``pages(path, title, aliases)``."""
    titles = pages.select("path", "title", handle(F.col("title"), nfc).alias("handle"), F.lit(0).alias("tier"), F.lit(0).alias("pos"))
    aliases = pages.select("path", "title", F.posexplode("aliases").alias("pos", "alias")).select("path", "title", handle(F.col("alias"), nfc).alias("handle"), F.lit(1).alias("tier"), "pos")
    claims = titles.union(aliases.select("path", "title", "handle", "tier", "pos"))
    return first_claimants(claims, "handle", "tier", utf16_order(F.col("title")), utf16_order(F.col("path")), "pos").select("handle", "title", "path")


def targets(texts: DataFrame) -> DataFrame:
    """``texts(path, text)`` -> ``path, pos, target``, one row for each distinct target of a text."""
    return texts.select("path", F.posexplode(link_targets(F.col("text"))).alias("pos", "target"))


def resolve(found: DataFrame, index: DataFrame, nfc: bool = True) -> DataFrame:
    """``targets`` joined with a name table: adds ``handle, title, to`` (null: unresolved)."""
    own = found.withColumn("handle", handle(F.col("target"), nfc))
    return own.join(index.select("handle", "title", F.col("path").alias("to")), "handle", "left")


def unresolved(pages: DataFrame, texts: DataFrame, nfc: bool = True) -> DataFrame:
    """Article candidates: ``handle, display, n_citers, citers``. The display is the least spelling, citers are in path order."""
    wanted = targets(texts).where(is_title_link(F.col("target"))).withColumn("handle", handle(F.col("target"), nfc)).where("handle <> ''")
    missing = wanted.join(title_index(pages, nfc).select("handle"), "handle", "left_anti")
    return missing.groupBy("handle").agg(
        F.min(F.struct(utf16_order(F.col("target")).alias("o"), "target"))["target"].alias("display"),
        F.count_distinct("path").cast("long").alias("n_citers"),
        F.array_sort(F.collect_set("path")).alias("citers"),
    )


def citer_union(existing: DataFrame, new: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """``page, citers``: existing before new, each once, at its first place; only ``live(source)`` if given.

    ``existing`` and ``new``: ``page, pos, source``.
    """
    both = existing.select("page", "source", F.struct(F.lit(0).alias("g"), "pos").alias("at")).union(new.select("page", "source", F.struct(F.lit(1).alias("g"), "pos").alias("at")))
    if live is not None:
        both = both.join(live.select("source").distinct(), "source", "left_semi")
    once = both.groupBy("page", "source").agg(F.min("at").alias("at"))
    return once.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "source"))), lambda x: x["source"]).alias("citers"))


def resolve_labels(labels: DataFrame, nodes: DataFrame, nfc: bool = True) -> DataFrame:
    """``labels(pos, label)`` of a trace with ``path``: an exact node path first, else a title; null: no such node now."""
    exact = nodes.select(F.col("path").alias("label"), F.col("path").alias("exact")).distinct()
    titled = first_claimants(nodes.select("path", handle(F.col("title"), nfc).alias("handle")), "handle", utf16_order(F.col("path"))).withColumnRenamed("path", "titled")
    both = labels.join(exact, "label", "left").withColumn("handle", handle(F.col("label"), nfc)).join(titled, "handle", "left")
    return both.select("pos", "label", F.coalesce("exact", "titled").alias("path"))


# --- links put in place -----------------------------------------------------------------------


def segments(texts: DataFrame) -> DataFrame:
    """``path, n, plain, inner``: texts cut at their links; segment n has the text before a link and what the link holds, the last one no link.

    ``texts(path, text)``; rows of one path are told apart by ``copy``.
    """
    inner = F.regexp_extract_all("text", F.lit(LINK), F.lit(1))
    parts = F.split("text", LINK, -1)
    return texts.select("path", "copy", F.posexplode(F.arrays_zip(parts.alias("plain"), inner.alias("inner"))).alias("n", "s")).select("path", "copy", "n", F.col("s.plain").alias("plain"), F.col("s.inner").alias("inner"))


def _with_links(texts: DataFrame, put: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``texts(path, text)`` with each link as ``put`` has it: it gets ``path, copy, n, inner, target, display`` of links and gives ``path, copy, n, link``.

    A text without links passes as it is, so only those with some are shuffled.
    """
    own = texts.withColumn("has", F.coalesce(F.col("text").rlike(LINK), F.lit(False)))
    linked = kept(own.where("has").drop("has").withColumn("copy", F.monotonically_increasing_id()))
    cut = segments(linked)
    target = trim(F.substring_index("inner", "|", 1))
    display = F.when(F.contains("inner", F.lit("|")), F.expr("substring(inner, instr(inner, '|') + 1)"))
    made = put(cut.where("inner IS NOT NULL").select("path", "copy", "n", "inner", target.alias("target"), display.alias("display")))
    both = cut.drop("path").join(made.select("copy", "n", "link"), ["copy", "n"], "left")
    piece = F.concat("plain", F.when(F.col("inner").isNull(), "").otherwise(F.coalesce("link", F.concat(F.lit("[["), "inner", F.lit("]]")))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", piece.alias("piece")))), lambda x: x["piece"]), "")
    whole = linked.drop("text").join(both.groupBy("copy").agg(text.alias("text")), "copy").drop("copy")
    return own.where("NOT has").drop("has").unionByName(whole.select(*texts.columns))


def rewritten(texts: DataFrame, index: DataFrame, nfc: bool = True) -> DataFrame:
    """``texts(path, text)`` with links by title or alias under the title of their page, what was written as their display.

    ``index``: ``handle, title`` of :func:`title_index`. A link that already is the title stays, as do paths under ``raw/``,
    heading and block references, blank and unknown targets. Other columns stay; null texts too.
    """

    def put(found: DataFrame) -> DataFrame:
        wanted = found.where(is_title_link(F.col("target")) & (F.col("target") != "")).withColumn("handle", handle(F.col("target"), nfc))
        known = wanted.join(index.select("handle", "title"), "handle").where(F.col("display").isNotNull() | (F.col("title") != F.col("target")))
        return known.select("path", "copy", "n", F.concat(F.lit("[["), "title", F.lit("|"), F.coalesce("display", "target"), F.lit("]]")).alias("link"))

    return _with_links(texts, put)


def validated(answers: DataFrame, retrieved: DataFrame, pages: DataFrame, nfc: bool = True) -> DataFrame:
    """``answers(path, text)``, ``path`` naming the answer, in which links outside what was retrieved for it become their display and a marker.

    ``retrieved(path, page, title)``: pages by path and title for each answer; ``pages(path, title, aliases)``: aliases lead to
    their page. References into a page count as the page; those into the answer itself stay.
    """
    by_title = pages.groupBy(handle(F.col("title"), nfc).alias("of")).agg(F.max_by("path", utf16_order(F.col("path"))).alias("page"))
    index = title_index(pages, nfc).select("handle", handle(F.col("title"), nfc).alias("of")).join(by_title, "of").select("handle", "page")
    names = retrieved.select("path", F.explode(F.array("page", "title")).alias("name")).select("path", handle(F.col("name"), nfc).alias("handle")).distinct()
    paths = retrieved.select("path", "page").distinct()

    def put(found: DataFrame) -> DataFrame:
        asked = found.withColumn("page_part", page_part(F.col("target"))).where((F.col("target") != "") & (F.col("page_part") != ""))
        asked = asked.withColumns({"whole": handle(F.col("target"), nfc), "handle": handle(F.col("page_part"), nfc)})
        left = asked.join(names.select("path", F.col("handle").alias("whole")), ["path", "whole"], "left_anti").join(names, ["path", "handle"], "left_anti")
        fine = left.join(index, "handle").join(paths, ["path", "page"], "left_semi").select("copy", "n")
        out = left.join(fine, ["copy", "n"], "left_anti")
        shown = F.when(trim(F.coalesce("display", F.lit(""))) != "", trim(F.col("display"))).otherwise(F.col("target"))
        return out.select("path", "copy", "n", F.concat(shown, F.lit(" "), link_outside_column(F.col("target"))).alias("link"))

    return _with_links(answers, put)
