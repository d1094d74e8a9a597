"""Retrieval: seeds, two rankings, budgeted packing, the follow-up round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmesh.functions.text import handle, token_estimate, trim, truncate_tail, utf16_order
from inkmesh.operators import meetings
from inkmesh.operators.shared import dealt, kept, placed, ranked_in_groups
from inkmesh.operators.substrings import within

TOP_K, BUDGET, SEEDS, KEYWORDS = 12, 40_000, 8, 12


def shuffled(pages: DataFrame) -> DataFrame:
    """``pages`` as a side that joins by a shuffle: what grows with the pages doesn't pass through the driver, however small a part of it looks."""
    return pages.hint("merge")


#: Questions times pages of a task, while there are few tasks.
MADE = 500_000


def _numbered(pages: DataFrame, columns: list[str]) -> DataFrame:
    """``page, path``, and ``columns`` as they are: distinct paths, numbered in their order. A path is one page."""
    first = pages.groupBy("path").agg(F.min(F.struct("path", *columns)).alias("_first"))
    return placed(first.select("_first.*"), [utf16_order(F.col("path"))], "page")


def _names(pages: DataFrame, numbered: DataFrame, nfc: bool) -> tuple[DataFrame, DataFrame]:
    """``name, no`` of each distinct name, and ``page, tier, no`` of what bears it: its title (0) or an alias (1)."""
    parts = [pages.select("path", F.lit(0).alias("tier"), F.col("title").alias("name")), pages.select("path", F.lit(1), F.explode("aliases"))]
    names = parts[0].union(parts[1]).select("path", "tier", handle(F.col("name"), nfc).alias("name")).where("name <> ''").distinct()
    names = kept(_of_page(names, numbered).select("page", "tier", "name"))
    known = kept(names.select("name").distinct().withColumn("no", F.monotonically_increasing_id()))
    return known, names.join(shuffled(known), "name").select("page", "tier", "no")


def _of_page(rows: DataFrame, numbered: DataFrame) -> DataFrame:
    """``rows`` with the number of the page of their path."""
    return rows.join(shuffled(numbered.select("page", F.col("path").alias("_path"))), F.col("path").eqNullSafe(F.col("_path"))).drop("_path")


def _page_rows(numbered: DataFrame, found: DataFrame) -> DataFrame:
    """``numbered`` with the lists of ``found(page, tier, no)``: titles, aliases, words of the summary, of the body."""
    lists = ["titles", "aliases", "summary", "body"]
    by_page = found.groupBy("page").agg(*(F.collect_list(F.when(F.col("tier") == i, F.col("no"))).alias(c) for i, c in enumerate(lists)))
    none = F.array().cast("array<bigint>")
    return numbered.join(shuffled(by_page), "page", "left").withColumns({c: F.coalesce(c, none) for c in lists})


def _asked(*parts: DataFrame) -> DataFrame:
    """A row for each question, for ``meetings.met``: lists of the same question put together, those that no part has are empty."""
    kinds = {"words": "array<struct<no: bigint, times: bigint>>", "named": "array<bigint>", "seeds": "array<bigint>"}
    rows = None
    for part in parts:
        own = part.select("qid", *(F.col(c) if c in part.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()))
        rows = own if rows is None else rows.union(own)
    return rows.groupBy("qid").agg(*(F.flatten(F.collect_list(c)).cast(kind).alias(c) for c, kind in kinds.items()))


def _named(known: DataFrame, questions: DataFrame, nfc: bool) -> DataFrame:
    """``qid, named``: the names inside each question."""
    held = within(known.select(F.col("name").alias("pattern")), questions.select("qid", handle(F.col("question"), nfc).alias("text")), ["qid"])
    return held.join(shuffled(known.withColumnRenamed("name", "pattern")), "pattern").groupBy("qid").agg(F.collect_set("no").alias("named"))


def force_include(pages: DataFrame, questions: DataFrame, nfc: bool = True) -> DataFrame:
    """``qid, path``: pages of which the title or an alias is inside the question, each once. No cap.

    These grow with questions times pages, so they are made where a block of each meet, and not shuffled.
    """
    numbered = _numbered(pages, [])
    known, bearers = _names(pages, numbered, nfc)
    return meetings.met(_asked(_named(known, questions, nfc)), None, _page_rows(numbered, bearers), ["path"], MADE).select("qid", "path")


def valid_seeds(proposed: DataFrame, pages: DataFrame, cap: int = SEEDS) -> DataFrame:
    """``proposed(qid, pos, path)``: those that are pages, each once, the first ``cap``."""
    once = dealt(proposed.select("qid", "pos", "path"), "path").join(pages.select("path").distinct().hint("merge"), "path", "left_semi").groupBy("qid", "path").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("pos", "path"))
    return once.withColumn("r", rank).where(F.col("r") <= cap).select("qid", "pos", "path")


def _lexical(pages: DataFrame, keywords: DataFrame, nfc: bool, columns: list[str], seeds: DataFrame | None = None, questions: DataFrame | None = None, rank: bool = False) -> DataFrame:
    """``qid, path, *columns, score``, and ``rank``: what ``keywords`` score, and the pages that ``questions`` name or ``seeds`` hold."""
    numbered = _numbered(pages, columns)
    known, found = _names(pages, numbered, nfc)
    single = keywords.select("qid", F.explode("keywords").alias("keyword")).select("qid", handle(F.col("keyword"), nfc).alias("pattern")).where("pattern <> ''")
    single = kept(single.groupBy("qid", "pattern").agg(F.count(F.lit(1)).alias("times")))
    words = kept(single.select("pattern").distinct().withColumn("word", F.monotonically_increasing_id()))
    of_word = shuffled(words)
    names = known.select(F.col("no").alias("id"), F.col("name").alias("text"))
    same = words.join(shuffled(known), F.col("pattern") == F.col("name")).select("word", "no", F.lit(True).alias("same"))
    inside = within(words, names, ["id"]).join(of_word, "pattern").select("word", F.col("id").alias("no"), F.lit(False).alias("same"))
    outside = within(known.select(F.col("name").alias("pattern")), words.select("word", F.col("pattern").alias("text")), ["word"]).join(shuffled(known), F.col("pattern") == F.col("name")).select("word", "no", F.lit(False).alias("same"))
    related = words.select("word", F.lit(None).cast("bigint").alias("no"), F.lit(False).alias("same")).union(same).union(inside).union(outside)
    related = related.groupBy("word").agg(F.max(F.when(F.col("same"), F.col("no"))).alias("same"), F.collect_set(F.when(~F.col("same"), F.col("no"))).alias("around"))
    texts = kept(_of_page(pages.select("path", *(handle(F.coalesce(c, F.lit("")), nfc).alias(c) for c in ("summary", "body"))), numbered).select("page", "summary", "body"))
    for tier, c in ((2, "summary"), (3, "body")):
        found = found.union(within(words, texts.select("page", F.col(c).alias("text")), ["page"]).join(of_word, "pattern").select("page", F.lit(tier), "word"))
    parts = [single.join(of_word, "pattern").groupBy("qid").agg(F.collect_list(F.struct(F.col("word").alias("no"), "times")).alias("words"))]
    among = keywords.select("qid").distinct()
    if questions is not None:
        parts.append(_named(known, questions, nfc).join(shuffled(among), "qid", "left_semi"))
    if seeds is not None:
        parts.append(_of_page(seeds.select("qid", "path").distinct().join(shuffled(among), "qid", "left_semi"), numbered).groupBy("qid").agg(F.collect_list("page").alias("seeds")))
    return meetings.met(_asked(*parts), related, _page_rows(numbered, found), ["path", *columns], MADE, rank)


def lexical_scores(pages: DataFrame, keywords: DataFrame, nfc: bool = True, columns: tuple[str, ...] = ("title", "kind")) -> DataFrame:
    """``qid, path, *columns, score``, for ``pages(path, title, kind, aliases, summary, body)`` and ``keywords(qid, keywords array)``; pages of a score of 0 have no row.

    Each distinct keyword has one worth on a page, the best of its tiers; a question sums them, as often
    as it has the keyword. Tiers are lookups: by equal names, and by what is inside what, all as handles. Rows of
    the result grow with questions times pages; they are made where a block of each meet, and not shuffled.
    """
    return _lexical(pages, keywords, nfc, list(columns))


def ranked(scores: DataFrame, limit: int | None = None) -> DataFrame:
    """Adds ``rank``: by falling score, then path, from 1 in each question.

    All rows are ranked by one order of questions, scores and paths, in ranges, so no task holds a question;
    with a ``limit``, each task keeps so many rows of a question before the shuffle.
    """
    order = [F.desc("score"), utf16_order(F.col("path"))]
    if limit is None:
        return ranked_in_groups(scores, ["qid"], order).withColumn("rank", F.col("rank").cast("long"))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= limit).withColumn("rank", F.col("rank").cast("long"))


def mode_a(pages: DataFrame, keywords: DataFrame, seeds: DataFrame | None = None, nfc: bool = True, questions: DataFrame | None = None, columns: tuple[str, ...] = ("title", "kind")) -> DataFrame:
    """The lexical ranking: pages with a score, and those of ``seeds(qid, path)`` or named by ``questions(qid, question)`` that have none, for questions with keywords or without."""
    return _lexical(pages, keywords, nfc, list(columns), seeds, questions, rank=True)


def mode_b(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """``scores(qid, path, score)`` of a walk, over all nodes with raw files."""
    return ranked(scores.select("qid", "path", "score").where("score > 0").join(shuffled(nodes.select("path", "title", "kind")), "path").select("qid", "path", "title", "kind", "score"))


def pack(items: DataFrame, group: str, order: str, text: str, budget: int | Column = BUDGET, cap: int | Column | None = None, truncate_first: bool = True) -> DataFrame:
    """Whole items in order until one does not fit; none is skipped for a later one.

    Costs are never negative, so the running sum tells where to stop. If even the first
    does not fit, ``truncate_first`` cuts its tail. Adds ``cost, used, truncated``. The
    cap counts before the budget does.
    """
    by = Window.partitionBy(group).orderBy(order)
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    rows = items.withColumn("_n", F.row_number().over(by))
    if cap is not None:
        rows = rows.where(F.col("_n") <= cap)
    rows = rows.withColumn("cost", token_estimate(F.col(text))).withColumn("used", F.sum("cost").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("used") <= limit
    if not truncate_first:
        return rows.where(fits).withColumn("truncated", F.lit(False)).drop("_n")
    cut = (F.col("_n") == 1) & ~fits
    return rows.where(fits | cut).withColumn("truncated", cut).drop("_n")


def cut_texts(packed: DataFrame, text: str, budget: int = BUDGET) -> DataFrame:
    """The text of a truncated item cut to the budget; whole items pass without Python."""
    whole = packed.where("NOT truncated")
    return whole.union(packed.where("truncated").withColumn(text, truncate_tail(F.col(text), F.lit(budget))))


def assemble(rank: DataFrame, texts: DataFrame, k: int = TOP_K, budget: int = BUDGET, truncate_first: bool = True) -> DataFrame:
    """The ranked nodes with a readable text that is not blank, the first ``k``, packed."""
    read = rank.join(shuffled(texts.select("path", "text")), "path").where(F.col("text").isNotNull() & (trim(F.col("text")) != ""))
    return pack(read, "qid", "rank", "text", budget, k, truncate_first)


def follow_up(pages: DataFrame, missing: DataFrame, assembled: DataFrame, texts: DataFrame, k: int = TOP_K, budget: int = BUDGET, nfc: bool = True) -> DataFrame:
    """A lexical round over pages not yet assembled, with what was missing as keywords, whole items only, in the room and budget left."""
    spent = assembled.groupBy("qid").agg(F.sum("cost").alias("spent"), F.count(F.lit(1)).alias("taken"))
    scored = lexical_scores(pages, missing, nfc).join(assembled.select("qid", "path"), ["qid", "path"], "left_anti")
    read = ranked(scored).join(shuffled(texts.select("path", "text")), "path").where(F.col("text").isNotNull() & (trim(F.col("text")) != "")).join(spent, "qid", "left")
    return pack(read, "qid", "rank", "text", F.lit(budget) - F.coalesce("spent", F.lit(0)), F.lit(k) - F.coalesce("taken", F.lit(0)), False).drop("spent", "taken")


def peak_normalized(scores: DataFrame, group: str = "qid") -> DataFrame:
    """Adds ``heat``: the score over the group's greatest; rows without a score go."""
    return scores.where("score > 0").withColumn("heat", F.col("score") / F.max("score").over(Window.partitionBy(group)))


def top(scores: DataFrame, group: str, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), utf16_order(F.col("path"))))
    return scores.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= n)


def overlay(nodes: DataFrame, scores: DataFrame, seeds: DataFrame, k: int = TOP_K) -> DataFrame:
    """``qid, path, is_seed, in_topk, heat, lit`` of every node of each question."""
    heat = peak_normalized(scores).select("qid", "path", "heat")
    best = top(scores, "qid", k).select("qid", "path", F.lit(True).alias("in_topk"))
    marks = seeds.select("qid", "path", F.lit(True).alias("is_seed")).distinct()
    every = scores.select("qid", "path").join(nodes.select("path"), "path", "left_semi")
    out = every.join(heat, ["qid", "path"], "left").join(best, ["qid", "path"], "left").join(marks, ["qid", "path"], "left")
    no = F.lit(False)
    return out.select("qid", "path", F.coalesce("is_seed", no).alias("is_seed"), F.coalesce("in_topk", no).alias("in_topk"), F.coalesce("heat", F.lit(0.0)).alias("heat")).withColumn("lit", F.col("is_seed") | F.col("in_topk") | (F.col("heat") > 0))


def matches_filter(title: Column, path: Column, typed: Column) -> Column:
    """What a filter box keeps: the typed text in the title or the path, whatever the case; blank keeps all."""
    t = F.lower(trim(typed))
    return (t == "") | F.contains(F.lower(title), t) | F.contains(F.lower(path), t)


def opacity(lit: Column, overlaid: Column, matching: Column) -> Column:
    """Nodes that an overlay does not light, or a filter does not match, are faint."""
    return F.when((lit | ~overlaid) & matching, 1.0).otherwise(0.15)


def labels(nodes: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` nodes to label, with ``rank``: of ``nodes(path, degree, score, lit)`` the lit ones by score, or all by degree where none is lit. Ties go by path."""
    first = nodes.orderBy(F.desc("lit"), F.desc(F.when(F.col("lit"), F.col("score"))), F.desc("degree"), utf16_order(F.col("path"))).limit(n)  # so n rows from here on
    by_score, any_lit = F.when(F.col("lit"), F.col("score")), F.max("lit").over(Window.partitionBy())
    kept = first.withColumn("any_lit", any_lit).where(~F.col("any_lit") | F.col("lit")).drop("any_lit")
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by_score), F.when(~F.col("lit"), F.negative("degree")), utf16_order(F.col("path")))))


def stops(steps: DataFrame, final: DataFrame) -> DataFrame:
    """``qid, stop, path, score, label``: what a slider over a walk can show: each step kept, and the end where the walk went on beyond them.

    ``steps(qid, iter, path, score)``, ``final(qid, path, score, iterations)``.
    """
    ends = final.select("qid", "iterations").distinct().join(steps.groupBy("qid").agg(F.max("iter").alias("kept")), "qid")
    total, kept = F.col("iterations").cast("string"), F.col("kept")
    shown = steps.join(ends, "qid").select("qid", F.col("iter").alias("stop"), "path", "score", F.concat(F.lit("iteration "), F.col("iter").cast("string"), F.lit(" of "), total).alias("label"))
    gap = F.concat(F.lit("final vector at iteration "), total, F.lit(" (iterations "), (kept + 1).cast("string"), F.lit("–"), (F.col("iterations") - 1).cast("string"), F.lit(" not retained)"))
    last = F.when(F.col("iterations") == kept + 1, F.concat(F.lit("iteration "), total, F.lit(" of "), total)).otherwise(gap)
    more = final.select("qid", "path", "score").join(ends.where("iterations > kept"), "qid").select("qid", (kept + 1).alias("stop"), "path", "score", last.alias("label"))
    return shown.union(more)
