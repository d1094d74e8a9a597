"""Merging inventories into pages: which items name a page there is, and what pages to make.

Items ``(source, pos, title, kind, aliases, summary)`` are taken in order of their
source's path and place. Steps, all on DataFrames:

1. :func:`names` lists the handles that an item may be known by, the surest first.
2. :func:`matched` finds the page there is for an item: the first of its handles that the
   name table knows, else the first that a numbered page ("Name-2") goes back to.
3. What the order of items decides (whose page an item joins, who owns an alias) is told
   by a walk over items that can bear on each other. :func:`clusters` finds these: items
   that share a handle, or a title but for numbers at its end.
4. The walk says for each item its page and the aliases that it brings; :func:`merge`
   folds these: the first mention fixes title and kind, the last summary that is not empty
   wins, citers and aliases stand in order of their first mention.

Defined results: source and place tell items apart. Null aliases are none, a null summary is empty; blank names are passed
over. Items of one name are mentions of one page. Without items only what is queued comes out.
Pages of sources are matched by no item, but hold their titles.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmesh.functions.text import handle, handle_py, sanitize_title, sanitize_title_py, title_stem, trim, trim_py, unique_title_py, utf16_order
from inkmesh.operators.links import first_claimants, title_index
from inkmesh.operators.shared import kept

#: Items up to which one task walks over all of them, rather than one for each cluster.
FEW = 2_000
ITEM = "source string, pos int, title string, kind string, aliases array<string>, summary string"
NEW = "new:"


def _family(title: Column) -> Column:
    """The handle of a title without numbers at its end: pages so named may take each other's names."""
    return F.regexp_replace(handle(title), r"(-\d+)+$", "")


def ordered(items: DataFrame) -> DataFrame:
    """``items`` with ``rank``, a struct that orders them, ``key``, which tells them apart, and distinct trimmed aliases that are not blank."""
    own = F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: trim(F.coalesce(a, F.lit("")))), lambda a: a != "")
    rank = F.struct(utf16_order(F.col("source")).alias("path"), "pos")
    return items.select("source", "pos", "title", "kind", own.alias("aliases"), F.coalesce("summary", F.lit("")).alias("summary"), rank.alias("rank"), F.xxhash64("source", "pos").alias("key")).dropDuplicates(["key"])


def names(items: DataFrame) -> DataFrame:
    """``key, at, handle``: of ``ordered`` items the title as it is, as a file bears it, and cut to a file name's length, then the aliases."""
    title = F.col("title")
    own = items.select("key", F.concat(F.array(trim(title), sanitize_title(title), title_stem(title)), F.col("aliases")).alias("names"))
    return own.select("key", F.posexplode("names").alias("at", "name")).select("key", "at", handle(F.col("name")).alias("handle")).where("handle <> ''")


def numbered_pages(pages: DataFrame, held: DataFrame) -> DataFrame:
    """``handle, path``: pages named with a number since some title holds their name, which no page answers to otherwise. The least number wins, then the path.

    ``held``: handles of all titles.
    """
    table = title_index(pages).select("handle")
    parts = pages.select("path", handle(F.regexp_extract("title", r"(?s)^(.+)-\d+$", 1)).alias("handle"), F.regexp_extract("title", r"-(\d+)$", 1).alias("digits"))
    free = parts.where("handle <> ''").join(held, "handle", "left_semi").join(table, "handle", "left_anti")
    plain = F.ltrim(F.col("digits"), F.lit("0"))
    return first_claimants(free, "handle", F.length(plain), plain, utf16_order(F.col("path"))).select("handle", "path")


def matched(items: DataFrame, pages: DataFrame, held: DataFrame) -> DataFrame:
    """``key, path`` of ``ordered`` items that name one of ``pages``."""
    table = title_index(pages).select("handle", "path", F.lit(0).alias("tier"))
    table = table.union(numbered_pages(pages, held).select("handle", "path", F.lit(1)))
    found = names(items).join(table, "handle")
    return found.groupBy("key").agg(F.min_by("path", F.struct("tier", "at")).alias("path"))


def clusters(items: DataFrame, shared: DataFrame) -> DataFrame:
    """``key, cluster``: the least key that can be reached over handles in common; ``shared``: ``key, handle``. About log n rounds over ids alone."""
    if items.count() <= FEW:
        return items.select("key", F.lit(0).cast("long").alias("cluster"))
    shared = kept(shared.distinct())
    label = kept(items.select("key", F.col("key").alias("cluster")))
    while True:
        by_handle = shared.join(label, "key").groupBy("handle").agg(F.min("cluster").alias("cluster"))
        near = shared.join(by_handle, "handle").groupBy("key").agg(F.min("cluster").alias("cluster"))
        jump = label.select(F.col("key").alias("cluster"), F.col("cluster").alias("far"))
        new = kept(near.join(jump, "cluster", "left").select("key", F.least("cluster", F.coalesce("far", "cluster")).alias("cluster")))
        moved = new.join(label.withColumnRenamed("cluster", "was"), "key").where("cluster <> was").limit(1).count()
        label = kept(label.join(new.withColumnRenamed("cluster", "now"), "key", "left").select("key", F.least("cluster", F.coalesce("now", "cluster")).alias("cluster")))
        if not moved:
            return label


_TOLD = "key long, page string, made string, brings array<string>, later array<struct<rank:struct<path:binary,pos:int>,page:string>>"


class _Walk:
    """Items in order, one for each title and list of aliases: the page each belongs to, the title of a page made for it, the aliases it brings.

    A later item of the same names brings nothing, as all its aliases have an owner by then. Its page is
    that of the first of its handles that a page made here answers to, which may change between
    the two: ``later`` lists these changes by the rank of the item that made them.
    """

    def __init__(self, rows: pd.DataFrame) -> None:
        self.owner = {h: p for pairs in rows["owned"] for h, p in ((x["handle"], x["owner"]) for x in pairs)}
        self.taken = {h for own in rows["taken"] for h in own}
        self.answers: dict[str, str] = {}  # handles that a page made here answers to
        self.called: dict[str, set[str]] = {}  # page: handles it goes by
        self.waiting: dict[str, list[tuple[int, int]]] = {}  # handle: items that may go where it leads, and its place among theirs
        self.at: list[int] = []  # the place of the handle that leads each item now
        self.told: list[list] = []

    def answer(self, handle: str, page: str, rank: dict) -> None:
        if self.answers.get(handle) == page:
            return
        self.answers[handle] = page
        for item, place in self.waiting.get(handle, ()):
            if place <= self.at[item]:
                self.at[item] = place
                self.told[item][4].append({"rank": rank, "page": page})

    def take(self, r) -> None:  # noqa: ANN001
        own: dict[str, str] = {}
        for alias in r.aliases:
            own.setdefault(handle_py(alias), alias)
        made, page, at = None, r.path, -1
        if page is not None:
            self.called.setdefault(page, set(r.page_handles))
            offered = {handle_py(r.title): trim_py(r.title)} | own
        else:
            at, page = next(((k, self.answers[h]) for k, h in enumerate(r.handles) if h in self.answers), (len(r.handles), None))
            offered = own
        item = len(self.told)
        self.told.append([r.key, page, None, [], []])
        self.at.append(at)
        if page is None:
            made = unique_title_py(sanitize_title_py(r.title), self.taken)
            page, h = f"{NEW}{r.key}", handle_py(made)
            self.taken.add(h)
            self.owner[h] = page
            self.called[page] = {h}
            self.answer(h, page, r.rank)
            self.answer(handle_py(r.title), page, r.rank)
            self.at[item] = next((k for k, x in enumerate(r.handles) if x in self.answers), len(r.handles))
        brings = [(h, a) for h, a in offered.items() if h and h not in self.called[page] and self.owner.get(h, page) == page]
        for h, _ in brings:
            self.owner[h] = page
            self.called[page].add(h)
            if page.startswith(NEW):
                self.answer(h, page, r.rank)
        self.told[item][1:4] = page, made, [a for _, a in brings]
        if r.path is None:
            for k, h in enumerate(r.handles):
                self.waiting.setdefault(h, []).append((item, k))


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    walk = _Walk(rows)
    for r in rows.sort_values("rank", key=lambda c: c.map(lambda r: (bytes(r["path"]), r["pos"]))).itertuples():
        walk.take(r)
    return pd.DataFrame(walk.told, columns=["key", "page", "made", "brings", "later"])


def assigned(items: DataFrame, pages: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    """``ordered`` items with ``page`` (a path, or a name of a page to make), ``made`` (its title, at its first mention) and ``brings`` (aliases).

    Items of the same title and aliases go through the walk once, as the first of them: all
    others follow it, so what is walked over grows with the names there are, not with their mentions.
    ``reserved(title)``: titles of this run that no page bears yet.
    """
    matchable = pages.where("kind <> 'source'")
    titles = pages.select("title") if reserved is None else pages.select("title").union(reserved.select("title"))
    held = titles.select(handle(F.col("title")).alias("handle"), _family(F.col("title")).alias("family")).distinct()
    every = items
    items = kept(every.groupBy("title", "aliases").agg(F.min_by("key", "rank").alias("key"), F.min("rank").alias("rank")))
    own = kept(matched(items, matchable, held.select("handle").distinct()))
    handles = kept(names(items))
    # what each item has to know: owners of the names it offers, names taken in its family, what its page goes by
    table = title_index(matchable).select("handle", F.col("path").alias("owner"))
    owners = table
    if reserved is not None:
        owners = owners.union(reserved.select(handle(F.col("title")).alias("handle")).distinct().join(owners, "handle", "left_anti").select("handle", F.lit("reserved")))
    owned = handles.select("key", "handle").distinct().join(owners, "handle").groupBy("key").agg(F.collect_list(F.struct("handle", "owner")).alias("owned"))
    family = items.select("key", _family(title_stem(F.col("title"))).alias("family"))
    taken = family.join(held, "family").groupBy("key").agg(F.collect_set("handle").alias("taken"))
    goes_by = matchable.select("path", F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).select("path", handle(F.col("name")).alias("handle")).groupBy("path").agg(F.collect_set("handle").alias("page_handles"))
    in_order = handles.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "handle"))), lambda x: x["handle"]).alias("handles"))
    # A name that a page there is answers to is decided; a family matters to items that may make a page.
    open_names = handles.select("key", "handle").join(table.select("handle"), "handle", "left_anti").select("key", "handle")
    makers = family.join(own.select("key"), "key", "left_anti").select("key", F.concat(F.lit("\n"), F.col("family")))
    groups = clusters(items, open_names.union(makers))
    rows = items
    for facts in (own, in_order, owned, taken, groups):
        rows = rows.join(facts, "key", "left")
    rows = rows.join(goes_by, "path", "left")
    none = F.array().cast("array<string>")
    walked = rows.select(F.coalesce("cluster", "key").alias("cluster"), "key", "rank", "title", "aliases", "path", F.coalesce("handles", none).alias("handles"), F.coalesce("owned", F.array().cast("array<struct<handle:string,owner:string>>")).alias("owned"), F.coalesce("taken", none).alias("taken"), F.coalesce("page_handles", none).alias("page_handles"))
    told = kept(walked.groupBy("cluster").applyInPandas(lambda pdf: _walk(pdf), _TOLD))
    told = items.select("title", "aliases", F.col("key").alias("first")).join(told.withColumnRenamed("key", "first"), "first")
    told = told.select(F.col("title").alias("_title"), F.col("aliases").alias("_aliases"), "first", "page", "made", "brings", "later")
    out = every.join(told, F.col("title").eqNullSafe(F.col("_title")) & (F.col("aliases") == F.col("_aliases")))
    is_first = F.col("key") == F.col("first")
    passed = F.filter("later", lambda x: x["rank"] < F.col("rank"))
    page = F.when(is_first | (F.size(passed) == 0), F.col("page")).otherwise(F.element_at(passed, -1)["page"])
    return out.withColumns({"page": page, "made": F.when(is_first, F.col("made")), "brings": F.when(is_first, F.col("brings")).otherwise(none)}).drop("_title", "_aliases", "first", "later")


def merge(pages: DataFrame, items: DataFrame, requeued: DataFrame | None = None, reserved: DataFrame | None = None) -> DataFrame:
    """``page, made, kind, aliases, summary, citers, rank``: pages to make (``made``: their title) and to write again (null), in order of ``rank``.

    ``pages(path, title, kind, aliases)``; ``requeued(path)``: pages to write again whatever the items say.
    """
    each = assigned(ordered(items), pages, reserved)
    first = F.struct("rank", "source")
    folded = each.groupBy("page").agg(
        F.min_by("made", "rank").alias("made"), F.min_by("kind", "rank").alias("kind"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.size("brings") > 0, F.struct("rank", "brings")))), lambda x: x["brings"])).alias("aliases"),
        F.max_by("summary", F.when(F.col("summary") != "", F.col("rank"))).alias("summary"),
        F.array_distinct(F.transform(F.sort_array(F.collect_list(first)), lambda x: x["source"])).alias("citers"),
        F.min("rank").alias("rank"),
    )
    folded = folded.withColumns({"summary": F.coalesce("summary", F.lit("")), "kind": F.when(F.col("made").isNotNull(), F.col("kind"))})
    if requeued is None:
        return folded
    none, empty = F.array().cast("array<string>"), F.lit(None).cast("string")
    more = requeued.select("path").distinct().join(pages.select("path"), "path", "left_semi").join(folded.select(F.col("page").alias("path")), "path", "left_anti")
    return folded.unionByName(more.select(F.col("path").alias("page"), empty.alias("made"), empty.alias("kind"), none.alias("aliases"), F.lit("").alias("summary"), none.alias("citers"), F.lit(None).cast(folded.schema["rank"].dataType).alias("rank")))


def numbered(rows: DataFrame) -> DataFrame:
    """``merge`` rows with ``n``, their place: pages to make in order of first mention, then those to write again by path."""
    return rows.withColumn("n", F.row_number().over(Window.orderBy(F.col("made").isNull(), F.when(F.col("made").isNotNull(), F.col("rank")), utf16_order(F.col("page")))))
