"""What changed since the last build: four rules, renames, scope of a cascade."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from inkmesh.functions.text import folders_above, path_key, utf16_order
from inkmesh.operators.shared import kept

PENDING = "cascade-pending"


def diff(found: DataFrame, manifest: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """``path, status, hash, old_hash`` with status new, modified, unchanged or deleted.

    ``found(path, hash[, derivative_ok])``, ``manifest(path, hash)``. A file is modified also
    if its derivative is missing or names another source. What is recorded but not
    found is deleted, unless it is, or lies under, a ``skipped(path)``.
    """
    ok = F.coalesce("derivative_ok", F.lit(True)) if "derivative_ok" in found.columns else F.lit(True)
    own = found.select("path", "hash", ok.alias("ok"), F.lit(True).alias("here"))
    both = own.join(manifest.select("path", F.col("hash").alias("old_hash"), F.lit(True).alias("known")), "path", "full_outer")
    status = (
        F.when(F.col("known").isNull(), "new").when(F.col("here").isNull(), "deleted")
        .when((F.col("hash") != F.col("old_hash")) | ~F.col("ok"), "modified").otherwise("unchanged")
    )
    out = both.select("path", status.alias("status"), "hash", "old_hash")
    if skipped is not None:
        # A path meets what is skipped by itself and by each folder that it lies in: equal keys, however many are skipped.
        at = out.where("status = 'deleted'").select("path", F.explode(F.concat(folders_above(F.col("path")), F.array("path"))).alias("s"))
        hidden = at.join(skipped.select(F.col("path").alias("s")).distinct(), "s", "left_semi").select("path").distinct()
        out = out.join(hidden.withColumn("hidden", F.lit(True)), "path", "left").where("hidden IS NULL OR status <> 'deleted'").drop("hidden")
    return out


#: New paths of one content that choose at a time, so what one task holds has a bound.
TURN = 20_000
#: Pools of old paths: of a folder, of a name, a path itself, and all.
FOLDER, NAME, PATH, ALL = "folder", "name", "path", "all"


def _above(folder: str) -> list[str]:
    """The folders that lie above a folder."""
    parts = folder.split("/") if folder else []
    return ["/".join(parts[:k]) for k in range(len(parts))]


class _Pools:
    """Old paths in order by pool. What is taken is passed over for good, and a pool is told from one that goes on beyond what is here."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.paths, self.cut, self.at, self.taken = {}, set(), {}, set()
        for (kind, key), own in rows.groupby(["kind", "key"], sort=False):
            own = own.sort_values("place")
            self.paths[kind, key] = own.old.tolist()
            if len(own) > own.wanted.iloc[0]:
                self.cut.add((kind, key))

    def first(self, kind: str, key: str) -> str | None:
        """The first free path of a pool. Its last one, where the pool goes on, is not ours to give: ``LookupError``."""
        own, at = self.paths.get((kind, key), ()), self.at.get((kind, key), 0)
        while at < len(own) and own[at] in self.taken:
            at += 1
        self.at[kind, key] = at
        if (kind, key) in self.cut and at >= len(own) - 1:
            raise LookupError
        return own[at] if at < len(own) else None

    def best(self, new: str) -> str | None:
        """In the folder of ``new``, or above it under its name; else above it or elsewhere under its name; else any. Of equals the first."""
        folder, _, name = new.rpartition("/")
        above = _above(folder)
        for asked in (
            [(FOLDER, folder), *((PATH, f"{f}/{name}" if f else name) for f in above)],
            [*((FOLDER, f) for f in above), (NAME, name)],
            [(ALL, "")],
        ):
            found = [p for p in (self.first(*a) for a in asked) if p is not None]
            if found:
                return min(found, key=path_key)
        return None


def _turn(news: pd.DataFrame, olds: pd.DataFrame) -> pd.DataFrame:
    """Each new path in order takes the best old one that is free, up to one that may want what is not here."""
    pools, out = _Pools(olds), []
    for content, new in zip(news.hash, news.new, strict=True):
        try:
            old = pools.best(new)
        except LookupError:
            break
        pools.taken.add(old)
        out.append((content, new, old))
    return pd.DataFrame(out, columns=["hash", "new", "old"])


def rename_pairs(changed: DataFrame, turn: int = TURN) -> DataFrame:
    """``old, new``: new files that have the content of a deleted one, each old path once.

    New paths choose in path order: an old path in their folder, or above it under their name,
    before one that is only above or only of their name, before any other; of equals the first.
    A choice depends on all before it, so ``turn`` new paths of a content choose at a time, from as
    many old ones of each pool that they may want as there are wishes for it. Where others took
    these, the turn ends and the next begins there, so no task holds a whole group of equal files.
    Rows without a content meet none.
    """
    is_new = F.col("status") == "new"
    both = kept(changed.where(F.col("status").isin("new", "deleted")).select(F.when(is_new, F.col("hash")).otherwise(F.col("old_hash")).alias("hash"), "path", is_new.alias("is_new")).where("hash IS NOT NULL"))
    sizes = both.groupBy("hash").agg(F.count(F.when(F.col("is_new"), 1)).alias("n_new"), F.count(F.when(~F.col("is_new"), 1)).alias("n_old")).where("n_new > 0 AND n_old > 0")
    pool = kept(both.join(sizes.select("hash", ((F.col("n_old") == 1) & (F.col("n_new") == 1)).alias("lone")), "hash"))
    # A lone pair needs no choice and stays out of Python.
    of = lambda lone, new, name: pool.where((F.col("lone") == lone) & (F.col("is_new") == new)).select("hash", F.col("path").alias(name))
    olds, news, left = of(False, False, "old"), of(False, True, "new"), pool.where("NOT lone AND is_new").count()
    pairs = [of(True, False, "old").join(of(True, True, "new"), "hash").select("old", "new")]
    while left:
        in_order = Window.partitionBy("hash").orderBy(utf16_order(F.col("new")))
        here = news.withColumn("at", F.row_number().over(in_order)).where(F.col("at") <= turn)
        above, name = folders_above(F.col("new")), F.substring_index("new", "/", -1)
        pool = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
        wishes = F.concat(
            F.transform(above, lambda f: pool(FOLDER, f)),
            F.transform(F.slice(above, 1, F.size(above) - 1), lambda f: pool(PATH, F.when(f == "", name).otherwise(F.concat(f, F.lit("/"), name)))),
            F.array(pool(NAME, name), pool(ALL, F.lit(""))),
        )
        wanted = here.select("hash", F.inline(wishes)).groupBy("hash", "kind", "key").agg(F.count(F.lit(1)).cast("int").alias("wanted"))
        folder = F.regexp_replace("old", "/?[^/]*$", "")
        offers = olds.select("hash", "old", F.inline(F.array(pool(FOLDER, folder), pool(PATH, F.col("old")), pool(NAME, F.substring_index("old", "/", -1)), pool(ALL, F.lit("")))))
        place = F.row_number().over(Window.partitionBy("hash", "kind", "key").orderBy(utf16_order(F.col("old"))))
        # The bound by a number lets Spark drop what lies beyond it before it shuffles.
        offers = offers.join(wanted, ["hash", "kind", "key"]).withColumn("place", place).where((F.col("place") <= turn + 1) & (F.col("place") <= F.col("wanted") + 1))

        def chosen(own: pd.DataFrame, pools: pd.DataFrame) -> pd.DataFrame:
            return _turn(own.sort_values("at"), pools)

        done = kept(here.groupBy("hash").cogroup(offers.select(F.col("hash").alias("content"), "old", "kind", "key", "place", "wanted").groupBy("content")).applyInPandas(chosen, "hash string, new string, old string"))
        pairs.append(done.where("old IS NOT NULL").select("old", "new"))
        left -= done.count()
        if left:  # more than a turn, or wishes beyond what was here
            olds = kept(olds.join(done.select("hash", "old"), ["hash", "old"], "left_anti"))
            news = kept(news.join(done.select("hash", "new"), ["hash", "new"], "left_anti").join(olds.select("hash").distinct(), "hash", "left_semi"))
            left = news.count()
    out = pairs[0]
    for p in pairs[1:]:
        out = out.union(p)
    return out


def cascade_scope(citations: DataFrame, changed: DataFrame, renames: DataFrame) -> DataFrame:
    """``page, fate`` for pages touched by a deletion or change: ``delete`` without a live citer, else ``regenerate``.

    ``citations(page, source)``. A renamed source is live under both its names.
    """
    moved = renames.select(F.col("old").alias("path")).union(renames.select(F.col("new").alias("path")))
    gone = changed.where("status = 'deleted'").select("path").join(moved, "path", "left_anti")
    touched = gone.union(changed.where("status = 'modified'").select("path")).distinct()
    live = changed.where("status <> 'deleted'").select("path").union(moved).distinct()
    affected = citations.join(touched, F.col("source") == F.col("path"), "left_semi").select("page").distinct()
    kept = citations.join(live, F.col("source") == F.col("path"), "left_semi").select("page", F.lit(True).alias("live")).distinct()
    return affected.join(kept, "page", "left").select("page", F.when(F.col("live"), "regenerate").otherwise("delete").alias("fate"))


def repointed(citations: DataFrame, renames: DataFrame) -> DataFrame:
    """Citations with renamed sources under their new names."""
    return citations.join(renames, F.col("source") == F.col("old"), "left").select("page", F.coalesce("new", "source").alias("source"))


def blocked(citations: DataFrame, failed: DataFrame) -> DataFrame:
    """``source, pages``: sources whose record waits since a page that cites them failed."""
    hit = citations.join(failed.select("page").distinct(), "page", "left_semi")
    return hit.groupBy("source").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def next_manifest(manifest: DataFrame, changed: DataFrame, renames: DataFrame, blocked_sources: DataFrame) -> DataFrame:
    """``path, hash`` to record: only sources that are done; a blocked deletion stays as pending."""
    held = blocked_sources.select(F.col("source").alias("path"), F.lit(True).alias("held")).distinct()
    rows = changed.join(renames.select(F.col("old").alias("path"), F.lit(True).alias("moved")), "path", "left").join(held, "path", "left")
    held_c, moved_c = F.coalesce("held", F.lit(False)), F.coalesce("moved", F.lit(False))
    value = (
        F.when(F.col("status").isin("new", "modified"), F.when(held_c, F.col("old_hash")).otherwise(F.col("hash")))
        .when(F.col("status") == "unchanged", F.col("hash")).when(held_c & ~moved_c, PENDING)
    )
    return rows.select("path", value.alias("hash")).where("hash IS NOT NULL")


#: What is counted of a build's changes: a number for each status.
COUNTED = ("new", "modified", "unchanged", "deleted")


def counted(changed: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """``changed`` as it was written, and how many rows it has of each status, counted in the pass that writes it."""
    seen = Observation()
    marks = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in COUNTED]
    out = kept(changed.observe(seen, *marks))
    return out, {s: int(n) for s, n in seen.get.items()}
