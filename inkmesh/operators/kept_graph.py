"""A link graph kept up to date: changed pages alter their own names, links and edges alone.

Four tables in a folder are the state, each cut into buckets by a key:

* ``pages`` with their names and links, by path,
* ``claims`` of names by pages, by name; the first claimant owns it, as in :func:`graph.graph_index`,
* ``links(path, handle)``, by name,
* ``edges(a, b, n)``, by both ends: how many links, of either direction, make the edge.

A change takes the old names and links of the pages away and adds the new ones. A link
counts again where its page changed, or its name has another owner than before: what it
counted for goes, what it counts for now comes, and an edge is there as long as ``n``
is above 0. Only buckets that a change touches are read and written, under a new version;
a small file names the version of each bucket, and its rename makes the change valid as a
whole. A writer that is lost before leaves the state as it was; readers keep the version
they began with. There is one writer at a time: a second one finds its version taken.

Defined results: a null title or text names or links nothing, a null path is no page. Of
several rows of a path in one change the greatest text counts; a path that is written and
removed is written. To remove a page that is not there, or write one as it is, changes no
edge. Other columns are not read. Raw files are pages of ``tier`` 0 with their place in the
manifest as ``seq``: their names beat those of other pages.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.functions.text import handle, utf16_order
from inkmesh.operators.graph import degrees
from inkmesh.operators.links import first_claimants, targets
from inkmesh.operators.shared import kept

BUCKETS = 256
#: Of each table: its columns, and those that give the bucket.
TABLES = {
    "pages": ("path string, claims array<struct<handle: string, tier: int, seq: bigint, pos: int>>, links array<string>", ["path"]),
    "claims": ("path string, handle string, tier int, seq bigint, pos int", ["handle"]),
    "links": ("path string, handle string", ["handle"]),
    "edges": ("a string, b string, n bigint", ["a", "b"]),
}


def claims_of(pages: DataFrame) -> DataFrame:
    """``path, handle, tier, seq, pos`` of the names of ``pages(path, title, aliases, tier, seq)``."""
    names = F.concat(F.array(F.col("title")), F.coalesce("aliases", F.array().cast("array<string>")))
    each = pages.select("path", "tier", "seq", F.posexplode(names).alias("pos", "name"))
    return each.select("path", handle(F.col("name")).alias("handle"), "tier", "seq", "pos").where("handle <> ''")


def links_of(pages: DataFrame) -> DataFrame:
    """``path, handle``, each once, of what the texts name; a target with ``#`` or ``^`` names no node."""
    found = targets(pages.where(F.col("text").isNotNull())).where(~F.col("target").rlike("[#^]"))
    return found.select("path", handle(F.col("target")).alias("handle")).where("handle <> ''").distinct()


def owners(claims: DataFrame, name: str) -> DataFrame:
    """``handle`` and, as ``name``, the path of its first claimant."""
    return first_claimants(claims, "handle", "tier", "seq", utf16_order(F.col("path")), "pos").select("handle", F.col("path").alias(name))


def _edges(links: DataFrame, end: str, sign: int) -> DataFrame:
    """The edges of ``links(path, <end>)``, each link counted ``sign`` times."""
    two = links.where(F.col("path") != F.col(end))
    return two.select(F.least("path", end).alias("a"), F.greatest("path", end).alias("b"), F.lit(sign).cast("long").alias("n"))


class KeptGraph:
    """The state in ``folder``, which all machines share. ``buckets`` holds for a new state."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        state = self._state()
        self.buckets = state["buckets"] if state else buckets

    # --- versions ---------------------------------------------------------------------------

    def _state(self) -> dict | None:
        """The newest whole version: its number and, by table, the version of each bucket that has rows."""
        top = self._path(f"{self.folder}/states")
        done = [s.getPath().getName() for s in self._files.listStatus(top)] if self._files.exists(top) else []
        newest = max((int(n) for n in done if n.isdigit()), default=None)
        if newest is None:
            return None
        return json.loads(self.spark.read.text(f"{self.folder}/states/{newest}", wholetext=True).first()[0])

    def _publish(self, state: dict) -> None:
        number = state["version"]
        draft, place = (self._path(f"{self.folder}/states/{n}") for n in (f"_draft-{number}", number))
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._files.exists(place) or not self._files.rename(draft, place):
            raise RuntimeError(f"version {number} of {self.folder} was written by another")

    def _read(self, state: dict | None, name: str, only: list[int] | None = None) -> DataFrame:
        at = state["tables"].get(name, {}) if state else {}
        wanted = [b for b in at if only is None or int(b) in set(only)]
        if not wanted:
            return self.spark.createDataFrame([], TABLES[name][0])
        return self.spark.read.schema(TABLES[name][0]).parquet(*[f"{self.folder}/{name}/v={at[b]}/bucket={b}" for b in wanted])

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*TABLES[name][1]), F.lit(self.buckets)).cast("int")

    def _touched(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets of a table that the rows lie in: no more numbers than there are buckets."""
        return sorted(r[0] for r in rows.select(self._bucket(name)).distinct().collect())

    def _write(self, state: dict, name: str, rows: DataFrame, touched: list[int]) -> None:
        """The touched buckets of a table are ``rows`` now; one without rows has no version any more."""
        at = state["tables"].setdefault(name, {})
        for b in touched:
            at.pop(str(b), None)
        if not touched:
            return
        where = f"{self.folder}/{name}/v={state['version']}"
        # a name that very many pages link to is cut into several files
        rows.withColumn("bucket", self._bucket(name)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(where)
        for s in self._files.listStatus(self._path(where)):
            kind, _, b = s.getPath().getName().partition("=")
            if kind == "bucket":
                at[b] = state["version"]

    # --- changes ----------------------------------------------------------------------------

    def update(self, written: DataFrame, removed: DataFrame | None = None) -> int:
        """``written(path, title, aliases, text[, tier, seq])`` are pages as they are now, ``removed(path)`` went. Returns the version."""
        old = self._state()
        tables = {k: dict(v) for k, v in old["tables"].items()} if old else {}
        state = {"version": old["version"] + 1 if old else 0, "buckets": self.buckets, "tables": tables}
        given = [F.col(c) if c in written.columns else F.lit(v) for c, v in (("tier", 1), ("seq", 0))]
        rows = written.select("path", "text", "title", "aliases", given[0].cast("int").alias("tier"), given[1].cast("long").alias("seq")).where(F.col("path").isNotNull())
        now = kept(rows.groupBy("path").agg(F.max(F.struct("text", "title", "aliases", "tier", "seq")).alias("row")).select("path", "row.*"))
        changed = now.select("path")
        if removed is not None:
            changed = changed.union(removed.select("path").where(F.col("path").isNotNull()))
        changed = kept(changed.distinct())

        # the pages themselves
        at = self._touched("pages", changed)
        there = self._read(old, "pages", at)
        old_pages = kept(there.join(changed, "path", "left_semi"))
        old_claims = old_pages.select("path", F.inline("claims"))
        old_links = old_pages.select("path", F.explode("links").alias("handle"))
        new_claims, new_links = kept(claims_of(now)), kept(links_of(now))
        names = new_claims.groupBy("path").agg(F.collect_list(F.struct("handle", "tier", "seq", "pos")).alias("claims"))
        links = new_links.groupBy("path").agg(F.collect_list("handle").alias("links"))
        new_pages = now.select("path").join(names, "path", "left").join(links, "path", "left")
        self._write(state, "pages", there.join(changed, "path", "left_anti").unionByName(new_pages), at)

        # names: only one that a changed page claims or claimed can have another owner
        named = kept(old_claims.select("handle").union(new_claims.select("handle")).distinct())
        at = self._touched("claims", named)
        there = self._read(old, "claims", at)
        self._write(state, "claims", there.join(changed, "path", "left_anti").unionByName(new_claims), at)

        # owners, before and after, of these names and of those that changed pages link or linked to
        asked = kept(named.union(old_links.select("handle")).union(new_links.select("handle")).distinct())
        at = self._touched("claims", asked)
        before = owners(self._read(old, "claims", at).join(asked, "handle", "left_semi"), "was")
        after = owners(self._read(state, "claims", at).join(asked, "handle", "left_semi"), "is")
        owned = kept(before.join(after, "handle", "full"))
        moved = owned.where(~F.col("was").eqNullSafe(F.col("is")))

        # links of changed pages, and those of others to names that moved
        linked = old_links.select("handle").union(new_links.select("handle")).distinct()
        others = self._read(old, "links", self._touched("links", moved)).join(changed, "path", "left_anti").join(moved, "handle")
        parts = [
            _edges(old_links.join(owned, "handle"), "was", -1),
            _edges(new_links.join(owned, "handle"), "is", 1),
            _edges(others, "was", -1),
            _edges(others, "is", 1),
        ]
        delta = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
        delta = kept(delta.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n <> 0"))
        at = self._touched("links", linked)
        self._write(state, "links", self._read(old, "links", at).join(changed, "path", "left_anti").unionByName(new_links), at)
        at = self._touched("edges", delta)
        self._write(state, "edges", self._read(old, "edges", at).unionByName(delta).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0"), at)
        self._publish(state)
        return state["version"]

    # --- what is read -----------------------------------------------------------------------

    def version(self) -> int | None:
        state = self._state()
        return state["version"] if state else None

    def edges(self) -> DataFrame:
        """``a, b, n``: ``n`` links make the edge."""
        return self._read(self._state(), "edges")

    def nodes(self) -> DataFrame:
        """``path, degree`` of every page."""
        state = self._state()
        return degrees(self._read(state, "pages"), self._read(state, "edges"))
