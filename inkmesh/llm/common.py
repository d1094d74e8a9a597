"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import itertools
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java and RE2 character class.
SPACE = r"\x20\x09-\x0D"
SHINGLE = 5
SIMILARITY_PERCENT = 75
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for a row.

    Catalyst may copy an expression to each place that uses it, also into the
    body of a lambda, where it would run once per element. A lambda variable
    holds the computed value.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Maximal runs of other than ASCII white space; null and empty: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines of the cluster share.

    The cluster names it in ``spark.checkpoint.dir``. A folder of our own is
    set only where none is named, as in tests on one machine.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all machines of the cluster share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="inkmesh-checkpoint-"))
    return context.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that no data frame in use needs.

    Spark does so when the driver's garbage is collected, which on its own happens
    seldom, so the files of a job of many steps would pile up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows and bytes that go to a Python worker at once: texts may be long, and workers share a machine with the JVM.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def durable(df: DataFrame, batch: int = 1000, free: bool = True) -> DataFrame:
    """The rows of ``df`` in the shared folder, with the lineage cut. ``batch``: rows that go to a Python worker at once.

    ``free``: what steps before left is released first. Small steps that follow each other
    closely do without: whole collections seconds apart make the driver's heap grow.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if free:
        release(spark)
    before = {k: spark.conf.get(k, None) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, str(batch) if k.endswith("RecordsPerBatch") else v)
        return df.checkpoint(eager=True)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows up to which a table of narrow rows (some 64 bytes, so 8 MB) is sent to all executors rather than shuffled.
FEW = 125_000


def few_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has ``FEW`` rows at most, by a count made before."""
    return F.broadcast(df) if rows <= FEW else df


#: A key with more rows than this, and than one in ``KEYS`` of all, goes to several tasks.
PIECE, KEYS = 500, 2000


def hot_keys(rows: DataFrame, on: list[str]) -> DataFrame | None:
    """``on, heaps`` for keys that hold too many of ``rows`` for one task: ``KEYS`` at most, as each has over one in ``KEYS`` of all rows."""
    sizes = durable(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PIECE))
    sizes = sizes.coalesce(rows.sparkSession.sparkContext.defaultParallelism)  # one in PIECE of the rows at most
    if not sizes.limit(1).count():
        return None
    piece = max(PIECE, rows.count() // KEYS)
    return sizes.where(F.col("n") > piece).select(*on, F.ceil(F.col("n") / piece).cast("int").alias("heaps"))


def dealt_join(rows: DataFrame, facts: DataFrame, on: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """``rows.join(facts, on, how)`` where ``facts`` has a row for each key: rows of a hot key are dealt out by ``by``, its fact is repeated for each heap."""
    hot = hot_keys(rows, on)
    if hot is None:
        return rows.join(facts, on, how)
    hot = F.broadcast(hot)
    left = rows.join(hot, on, "left").withColumn("heap", F.coalesce(F.pmod(F.xxhash64(*by), F.col("heaps")), F.lit(0))).drop("heaps")
    right = facts.join(hot, on, "left").withColumn("heap", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("heaps"), F.lit(1)) - 1))).drop("heaps")
    return left.join(right, [*on, "heap"], how).drop("heap")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an edge list for a task: rounds are many and their rows narrow. Rounds after which what they left is released.
EDGES, ROUNDS = 100_000, 5


def measured(rows: DataFrame, free: bool = False) -> DataFrame:
    """Narrow ``rows`` in the shared folder like ``durable`` leaves them, with their true size.

    A checkpoint keeps the size that Spark guessed before, for a join the product of both sides. In a loop of joins it
    becomes a number of millions of digits, which the driver computes anew for each plan. Rows in a cache are counted.
    """
    held = rows.persist()
    held.count()
    out = durable(held.select("*"), free=free)
    held.unpersist()
    return out


def narrow(rows: DataFrame) -> tuple[DataFrame, int]:
    """Kept ``rows`` of ids alone, read by as many tasks as they need, and their number."""
    n = rows.count()
    return measured(rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // EDGES)))), n


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(id, component)``.

    Each round gives every node the least label among itself, its neighbours
    and the label of its label (pointer jumping), so a chain of n nodes takes
    about log n rounds. Only ids move; the rounds end when nothing changes.
    The stop test brings one number to the driver.

    A round runs as many tasks as the edges need, by a count made before: the driver
    keeps a record of each task, and here most would hold next to nothing.
    """
    edges, n = narrow(edges)
    tasks = max(spark.sparkContext.defaultParallelism, -(-2 * n // EDGES))
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = measured(edges.where("a <> b").select(F.inline(ends)).distinct().coalesce(tasks), free=True)
    label = measured(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")).coalesce(tasks))
    for k in itertools.count(1):
        near = both.join(label.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "component").coalesce(tasks)
        far = label.alias("l").join(label.alias("r"), F.col("l.component") == F.col("r.id")).select(F.col("l.id"), F.col("r.component")).coalesce(tasks)
        # The label of the label also learns of the least label seen beside it: large stars shrink in one round.
        hook = near.alias("n").join(label.alias("o"), F.col("n.id") == F.col("o.id")).where(F.col("n.component") < F.col("o.component")).select(F.col("o.component").alias("id"), F.col("n.component")).coalesce(tasks)
        was = label.select("id", "component", F.col("component").alias("old"))
        heard = near.union(far).union(hook).withColumn("old", F.lit(None).cast(label.schema["component"].dataType))
        new = measured(was.union(heard).groupBy("id").agg(F.min("component").alias("component"), F.max("old").alias("old")).coalesce(tasks), free=k % ROUNDS == 0)
        changed = new.where("component <> old").limit(1).count()
        label = new.select("id", "component")
        if not changed:
            return label
