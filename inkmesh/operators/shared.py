"""Tables kept in the folder that all machines share, and places in a total order."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
_ROW_BITS = 33


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where none is named and all runs on one machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all machines of the cluster share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="inkmesh-checkpoint-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The rows of ``df`` in the shared folder, with the lineage cut: what follows may read them twice and gets the same rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows that a task sorts at once where many groups are dealt to tasks: some 50 MB of narrow rows.
ROWS = 500_000


def dealt(df: DataFrame, *columns: str, rows: int = ROWS) -> DataFrame:
    """``df`` dealt by ``columns`` to as many tasks as its rows need, by a count made before: what a task holds doesn't grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *columns)


def placed(df: DataFrame, order: list[str | Column], name: str = "place") -> DataFrame:
    """Adds ``name``: the place of each row in the total order, from 0.

    Ranges of the order go to one task each and are numbered there; a range begins where the
    ranges before it end, so no task holds more than its range. Rows equal in all of ``order``
    stand in any order, in one range. The driver sees one number for each range.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    at = f"_{name}_at"
    spread = kept(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, _ROW_BITS)
    sizes = sorted((r.part, r.n) for r in spread.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, end = [], 0
    for p, n in sizes:
        starts.append((p, end))
        end += n
    first, begun = f"{at}_part", f"{at}_start"
    table = df.sparkSession.createDataFrame(starts, f"{first} bigint, {begun} bigint")
    numbered = spread.withColumn(first, part).join(F.broadcast(table), first)  # one row for each range
    return numbered.withColumn(name, F.col(begun) + F.col(at).bitwiseAND((1 << _ROW_BITS) - 1)).drop(at, first, begun)


def ranked_in_groups(df: DataFrame, groups: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """Adds ``name``: the place of each row among those of its group, from 1. A group may be the whole table.

    One total order of groups and ``order`` numbers all rows; a group begins at the least number in it.
    """
    spread = placed(df, [*groups, *order], f"_{name}")
    keys = {g: f"_{name}_{g}" for g in groups}
    first = spread.groupBy(*(F.col(g).alias(k) for g, k in keys.items())).agg(F.min(f"_{name}").alias(f"_{name}_first"))
    same = [F.col(g).eqNullSafe(F.col(k)) for g, k in keys.items()]
    return spread.join(first, same).withColumn(name, (F.col(f"_{name}") - F.col(f"_{name}_first") + 1).cast("int")).drop(f"_{name}", f"_{name}_first", *keys.values())
