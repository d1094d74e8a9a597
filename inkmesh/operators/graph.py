"""The link graph: nodes, distinct undirected edges, degrees, and which ranking it suits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.functions.text import handle, utf16_order
from inkmesh.operators.fingerprints import same_rows
from inkmesh.operators.links import first_claimants, targets

MIN_NODES, MIN_RATIO = 20, 1.5


def distinct_edges(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected pairs, each once with ``a < b``; loops go."""
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``path, degree`` of every node, none left out."""
    counts = symmetric(edges).groupBy(F.col("a").alias("path")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("path").join(counts, "path", "left").select("path", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def mode_of(n_nodes: Column, n_edges: Column) -> Column:
    """B (graph ranking) for 20 nodes and 1.5 edges a node at least, else A (lexical)."""
    return F.when((n_nodes >= MIN_NODES) & (n_edges >= MIN_RATIO * n_nodes), "B").otherwise("A")


def mode(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ones = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).union(edges.select(F.lit(0), F.lit(1)))
    counts = ones.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("edges"))
    return counts.select("nodes", "edges", mode_of(F.col("nodes"), F.col("edges")).alias("mode"))


def graph_index(pages: DataFrame, raw: DataFrame, nfc: bool = True) -> DataFrame:
    """``handle -> path`` for edges. Claims in order: raw files with their manifest paths, then page by page title and aliases.

    ``pages(path, title, aliases)``, ``raw(path, origin, seq)``: the readable file, the
    manifest's path for it, and the manifest's order.
    """
    no = F.lit(None).cast("binary")
    from_raw = raw.select("path", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.col("path").alias("name")), F.struct(F.lit(1).alias("pos"), F.col("origin").alias("name")))).alias("c"), F.lit(0).alias("tier"), F.col("seq").cast("long").alias("seq"), no.alias("o"))
    names = F.concat(F.array(F.col("title")), F.coalesce("aliases", F.array().cast("array<string>")))
    from_pages = pages.select("path", F.explode(F.transform(names, lambda x, i: F.struct(i.alias("pos"), x.alias("name")))).alias("c"), F.lit(1).alias("tier"), F.lit(0).cast("long").alias("seq"), utf16_order(F.col("path")).alias("o"))
    claims = from_raw.union(from_pages).select("path", handle(F.col("c.name"), nfc).alias("handle"), "tier", "seq", "o", F.col("c.pos").alias("pos"))
    return first_claimants(claims, "handle", "tier", "seq", "o", "pos", "path").select("handle", "path")


def build(pages: DataFrame, raw: DataFrame, nfc: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes ``path, title, kind, degree, summary`` and edges ``a, b``.

    ``pages(path, title, kind, aliases, summary, text)``; ``raw(path, origin, seq, text)``, of
    which a null text is an unreadable file: a node without links. A page wins a path
    over a raw file. Links come from whole texts; a target with ``#`` or ``^`` names no node.
    """
    raw_only = raw.join(pages.select("path"), "path", "left_anti")
    nodes = pages.select("path", "title", "kind", "summary").union(raw_only.select("path", F.col("path").alias("title"), F.lit("raw").alias("kind"), F.lit("").alias("summary")).distinct())
    texts = pages.select("path", "text").union(raw_only.select("path", "text"))
    found = targets(texts.where(F.col("text").isNotNull())).where(~F.col("target").rlike("[#^]"))
    edges = distinct_edges(found.withColumn("handle", handle(F.col("target"), nfc)).join(graph_index(pages, raw_only, nfc).withColumnRenamed("path", "to"), "handle"), "path", "to")
    return nodes.join(degrees(nodes, edges), "path").select("path", "title", "kind", "degree", "summary"), edges


def orphans(nodes: DataFrame) -> DataFrame:
    """Pages that no link touches."""
    return nodes.where((F.col("kind") != "raw") & (F.col("degree") == 0))


def same_topology(nodes_a: DataFrame, edges_a: DataFrame, nodes_b: DataFrame, edges_b: DataFrame) -> bool:
    """Equal node paths and equal edges."""
    return same_rows(nodes_a.select("path"), nodes_b.select("path")) and same_rows(edges_a.select("a", "b"), edges_b.select("a", "b"))


def node_radius(degree: Column) -> Column:
    return F.lit(3.0) + F.lit(2.6) * F.log1p(degree)


#: The radius of the disc on which a layout starts, and FNV-1a's start and factor for 32 bits.
SEED_RADIUS = 320.0
FNV_START, FNV_FACTOR = 0x811C9DC5, 0x01000193


def path_hash(path: Column) -> Column:
    """FNV-1a of the UTF-16 units, 32 bits; a null path: null."""
    start, factor, low = (F.lit(x).cast("long") for x in (FNV_START, FNV_FACTOR, 0xFFFFFFFF))

    def of(digits: Column) -> Column:
        places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(4))).when(digits.isNotNull(), F.array().cast("array<int>"))
        units = F.transform(places, lambda i: F.conv(F.substring(digits, i, F.lit(4)), 16, 10).cast("long"))
        return F.aggregate(units, start, lambda h, u: (h.bitwiseXOR(u) * factor).bitwiseAND(low))

    return F.element_at(F.transform(F.array(F.hex(F.encode(path, "UTF-16BE"))), of), 1)


def seed_position(path: Column) -> Column:
    """``x, y`` where a layout puts a node at first, from its path alone: the hash's low half is the angle, its high half the share of the disc's area."""
    def point(h: Column) -> Column:
        angle = h.bitwiseAND(F.lit(0xFFFF).cast("long")) / F.lit(65536.0) * F.lit(2 * math.pi)
        radius = F.sqrt(F.shiftright(h, 16) / F.lit(65536.0)) * F.lit(SEED_RADIUS)
        return F.struct((F.cos(angle) * radius).alias("x"), (F.sin(angle) * radius).alias("y"))

    return F.element_at(F.transform(F.array(path_hash(path)), point), 1)
