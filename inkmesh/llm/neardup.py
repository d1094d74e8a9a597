"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped edges.

1. A document's shingle set is hashed once; the hash's top bits choose a bin, and
   the least hash of each bin is kept. Empty bins borrow from full ones by a fixed
   random order of bins (optimal densification). ``BANDS`` bands of ``ROWS`` bins
   give bucket keys. At a similarity of 0.75 a pair misses all buckets with a
   probability of about 5e-6.
2. Documents of equal sets become one representative, by a pre-aggregated count.
3. In each bucket one representative is the centre of a star: the one that meets most
   others over all its buckets, as what copies were made from does. Only edges from
   the centre are candidates, so a bucket of n gives n - 1 pairs.
4. Candidates are confirmed on the full sets, first one for each member, to its best
   centre, then those that would join two components; confirmed edges give components.
5. What a star can miss: two documents of a bucket that are similar to each other
   but not to its centre. Only buckets whose members are in several components can
   hold such pairs. Those that what is known of the centre does not rule out
   (``open_pairs``) are confirmed, and components formed anew. Nothing is capped.

Defined results: null and empty texts have an empty set and are linked with
nothing, like rows of a null id, whose component is null. Repeated rows are copies
of each other: they have one component, and all that bear its id are kept. An id
with different texts stands for as many documents. Extra columns are not read by
``link``; ``keep_one`` holds them in a struct. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkmesh.llm.common import SIMILARITY_PERCENT, components, dealt_join, durable, narrow, table
from inkmesh.llm.wordhash import frugal, mix, portions, shingle_sets

BINS, BANDS = 128, 32
ROWS = BINS // BANDS
ATTEMPTS = 256


def donors() -> np.ndarray:
    """For each bin the random order in which it asks others to lend their value."""
    at = np.arange(BINS * ATTEMPTS, dtype=np.uint64).reshape(BINS, ATTEMPTS)
    return (mix(at + np.uint64(0x51ED27)) % np.uint64(BINS)).astype(np.int64)


def signatures(sets: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Least hash of each bin, densified, for each of ``sets``: sorted, distinct, not empty."""
    values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    place = np.repeat(np.arange(len(sets)) * BINS, [len(s) for s in sets]) + (values >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    own, full = np.zeros((len(sets), BINS), np.uint64), np.zeros((len(sets), BINS), bool)
    own.ravel()[place[first]], full.ravel()[place[first]] = values[first], True
    out = own.copy()
    row, empty = np.nonzero(~full)
    for k in range(ATTEMPTS):
        lender = order[empty, k]
        lends = full[row, lender]
        out[row[lends], empty[lends]] = own[row[lends], lender[lends]]
        row, empty = row[~lends], empty[~lends]
        if not len(row):
            break
    for r, b in zip(row.tolist(), empty.tolist(), strict=True):  # none of the attempts: the next full bin
        out[r, b] = own[r, (b + 1 + np.argmax(np.roll(full[r], -b - 1))) % BINS]
    return out


_WEIGHTS = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """Bucket keys (n, BANDS) of signatures (n, BINS)."""
    parts = mix(signatures.reshape(-1, BANDS, ROWS)) * _WEIGHTS
    return mix(parts.sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = donors()
    for batch in portions(batches, 1):
        sets = shingle_sets(batch.column(1))
        n = np.array([len(s) for s in sets], np.int64)
        one = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
        two = np.array([mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
        keys, full = np.zeros((len(sets), BANDS), np.int64), np.flatnonzero(n)
        keys[full] = band_keys(signatures([sets[i] for i in full.tolist()], order)).view(np.int64)
        offsets = pa.array(np.arange(0, (len(sets) + 1) * BANDS, BANDS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(one), pa.array(two), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], ["doc_id", "n_shingles", "print1", "print2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of ``(doc_id, node, text)`` whose print is that of the node."""
    for batch in portions(batches, 2):
        sets = shingle_sets(batch.column(2))
        own = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
        right = np.flatnonzero(own == batch.column(1).field(1).to_numpy()).tolist()
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(right, pa.int64())) for k in (0, 1)), pa.array([sets[i].tobytes() for i in right], pa.binary())], ["doc_id", "node", "shingles"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        last, own = None, None
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = x.as_py(), y.as_py()
            if x != last:
                last, own = x, np.frombuffer(x, np.uint64)
            other = np.frombuffer(y, np.uint64)
            at = np.searchsorted(own, other)
            at[at == len(own)] = 0
            shared = int((own[at] == other).sum())
            if 100 * shared >= SIMILARITY_PERCENT * (len(own) + len(other) - shared):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], ["a", "b"])


NODE = "struct<id:bigint,print:bigint>"


def _outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``(centre, node, component, linked, x, y)``: what of the node's set ``y`` the centre's set ``x`` holds, and the rest."""
    for batch in batches:
        inside, sizes, rest = [], [], []
        for x, y in zip(batch.column(4), batch.column(5), strict=True):
            own = np.frombuffer(y.as_py(), np.uint64)
            out = np.setdiff1d(own, np.frombuffer(x.as_py(), np.uint64), assume_unique=True)
            sizes.append(len(own))
            inside.append(len(own) - len(out))
            rest.append(out.view(np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(sizes, pa.int64()), pa.array(inside, pa.int64()), pa.array(rest, pa.list_(pa.int64()))], ["centre", "node", "component", "linked", "n", "inside", "outside"])


def confirm(pairs: DataFrame, sets: DataFrame) -> tuple[DataFrame, int]:
    """The ``pairs(a, b)`` of nodes whose full sets are linked, and their number; ``sets(node, shingles)``. A centre of very many pairs is dealt out."""
    both = dealt_join(durable(pairs), sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), ["a"], ["b"])
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return narrow(durable(both.select("a", "b", "x", "y").mapInArrow(frugal(_confirmed), f"a {NODE}, b {NODE}")))


def labelled(members: DataFrame, label: DataFrame) -> DataFrame:
    """``members`` with the component of their node."""
    return members.join(label.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))


def open_pairs(stars: DataFrame, label: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: pairs that share a bucket, lie in different components, and can be linked for all that their bucket's centre tells.

    Split each set at the centre c of the bucket: inside c, and outside. Two sets share
    inside at most the lesser inside, and outside only shingles that both have. So a
    pair can reach the similarity only if

    * it has a shingle outside c in common, found by an equi-join on the rarer ones, which
      two linked sets cannot lack (prefix filter), and the lesser inside plus the lesser count of outside shingles that any other set of the group
      has suffices; or
    * the lesser inside alone suffices. One of the two is not linked with c, so it is
      much smaller there, and only sets of few sizes can meet that: an equi-join
      on size classes.

    Buckets of a group of copies hold very many pairs of different components that are
    well apart; the first count rules out nearly all of them without looking at a pair.
    """
    others = stars.where("node <> centre")
    mixed = others.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    group = durable(others.join(mixed, "key").select("centre", "node", "component").distinct())
    hub = sets.select(F.col("node").alias("centre"), F.col("shingles").alias("x")).join(label.select(F.col("id").alias("centre"), F.col("component").alias("hub")), "centre", "left")
    both = dealt_join(group, hub, ["centre"], ["node"]).withColumn("linked", F.col("component") == F.coalesce("hub", "centre"))
    both = both.join(sets.select("node", F.col("shingles").alias("y")), "node")
    split = durable(both.select("centre", "node", "component", "linked", "x", "y").mapInArrow(frugal(_outside), f"centre {NODE}, node {NODE}, component {NODE}, linked boolean, n bigint, inside bigint, outside array<bigint>"))
    facts = split.select("centre", "node", "component", "linked", "n", "inside")
    shingle = split.select("centre", "node", F.explode("outside").alias("shingle"))
    several = shingle.groupBy("centre", "shingle").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shingle = shingle.join(several, ["centre", "shingle"])
    own = Window.partitionBy("centre", "node")  # no more than the shingles of a document
    shingle = durable(shingle.withColumns({"common": F.count(F.lit(1)).over(own), "place": F.row_number().over(own.orderBy("c", "shingle"))}))
    p, q = SIMILARITY_PERCENT, 100 + SIMILARITY_PERCENT
    # A set needs so many common shingles outside for any link that two linked ones share one of all but the last so many less one, from rare to common.
    needed = F.greatest(F.ceil(F.col("n") * p / F.lit(100.0)) - F.col("inside"), F.lit(1))
    rows = shingle.join(facts, ["centre", "node"]).where(F.col("place") <= F.col("common") - needed + 1)
    x, y = rows.alias("x"), rows.alias("y")
    apart = (F.col("x.component") != F.col("y.component")) & (F.col("x.node") < F.col("y.node"))
    reach = F.least("x.inside", "y.inside") + F.least("x.common", "y.common")
    by_shingle = x.join(y, (F.col("x.centre") == F.col("y.centre")) & (F.col("x.shingle") == F.col("y.shingle")) & apart & (q * reach >= p * (F.col("x.n") + F.col("y.n"))))

    def size_class(n):
        return F.floor(F.log(n.cast("double")) * 10)

    # q * inside(x) >= p * (n(x) + n(y)) bounds the size of y from above, the similarity itself from below
    least, most = F.ceil(F.col("n") * p / F.lit(100.0)), F.floor(F.col("inside") * q / F.lit(float(p))) - F.col("n")
    small = facts.where("NOT linked").withColumns({"least": least, "most": most}).where("least <= most")
    x = small.withColumn("class", F.explode(F.sequence(size_class(F.col("least")), size_class(F.col("most"))))).alias("x")
    y = facts.withColumn("class", size_class(F.col("n"))).alias("y")
    fits = q * F.least("x.inside", "y.inside") >= p * (F.col("x.n") + F.col("y.n"))
    by_size = x.join(y, (F.col("x.centre") == F.col("y.centre")) & (F.col("x.class") == F.col("y.class")) & (F.col("x.component") != F.col("y.component")) & fits)
    ends = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]
    return by_shingle.select(*ends).union(by_size.select(*ends)).distinct()


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = durable(rows.mapInArrow(frugal(_signed), "doc_id long, n_shingles long, print1 long, print2 long, bands array<long>"))
    prints = ["n_shingles", "print1", "print2"]
    # a node is a distinct set: the least id that has it, with its print
    groups = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*prints).agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    groups = durable(groups)
    member = groups.select(F.explode("bands").alias("key"), "id", "print1")  # a key holds its band
    crowd = member.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = durable(member.join(crowd, "key"))  # members of buckets of two and more
    # What copies were made from meets each of them more often than they meet each other: it makes the best centre.
    met = shared.groupBy("id", "print1").agg(F.sum("n").alias("met"))
    node, rank = F.struct("id", F.col("print1").alias("print")), F.struct("met", F.negative("id").alias("lower"), "print1")
    centre = shared.join(met, ["id", "print1"]).groupBy("key").agg(F.max_by(node, rank).alias("centre"), F.max("met").alias("met"))
    shared = durable(shared.join(centre, "key").select("key", node.alias("node"), "centre", "met"))
    wanted = shared.select("node").distinct().select(F.col("node.id").alias("doc_id"), "node")
    hashed = rows.join(wanted, "doc_id").select("doc_id", "node", "text").mapInArrow(frugal(_sets), f"doc_id long, node {NODE}, shingles binary")
    sets = durable(hashed.dropDuplicates(["doc_id", "node"]).select("node", "shingles"))
    # the best centre of each node, then the other stars, as far as they join components
    best = shared.where("node <> centre").groupBy("node").agg(F.max_by("centre", F.struct("met", "centre")).alias("centre"))
    edges, _ = confirm(best.select(F.col("centre").alias("a"), F.col("node").alias("b")), sets)
    label = components(docs.sparkSession, edges)
    stars = durable(labelled(shared.select("node", "centre", "key"), label))
    hubs = stars.where("node = centre").select("key", F.col("component").alias("hub"))
    other = stars.where("node <> centre").join(hubs, "key").where("component <> hub").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    other = other.join(best.select(F.col("centre").alias("a"), F.col("node").alias("b")), ["a", "b"], "left_anti")
    more, n = confirm(other, sets)
    if n:
        edges = edges.union(more)
        label = components(docs.sparkSession, edges)
        stars = durable(labelled(shared.select("node", "centre", "key"), label))
    more, n = confirm(open_pairs(stars, label, sets), sets)
    if n:
        label = components(docs.sparkSession, edges.union(more))
    groups = groups.select(*prints, node.alias("node"))
    found = groups.join(label.withColumnRenamed("id", "node"), "node", "left").select(*prints, F.coalesce("component.id", "node.id").alias("component_id"))
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return signed.select("doc_id", *prints).join(found, prints, "left").select("doc_id", "n_shingles", linked.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the least of their component, with their columns as they are."""
    out = link(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("row_id"))
    return rows.join(out, F.col("row_id") == F.col("gone"), "left_anti").select("row.*")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
