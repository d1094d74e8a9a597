"""Whether two tables hold the same rows, as bags: a fingerprint of each first, which one aggregate makes.

A fingerprint is the number of rows, the sum of a 64-bit hash of each and the exclusive or of
another. It does not depend on order or partitions, sums of parts are that of the whole, and it can be
stored beside a table. Tables of different fingerprints differ; of equal ones the rows are compared.
Null is a value of its own, and a row that comes twice counts twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("n", "sum", "xor")


def row_hash(columns: list[str], seed: int) -> Column:
    """A hash of a row in which a null differs from any value, in its place."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def parts(columns: list[str]) -> list[Column]:
    """The aggregates ``n, sum, xor`` of a fingerprint, for a table or for groups of its rows."""
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_hash(columns, 1).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("sum"), F.coalesce(F.bit_xor(row_hash(columns, 2)), F.lit(0)).cast("long").alias("xor")]


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> tuple[int, int, int]:
    """One row of three numbers, whatever the size."""
    r = df.agg(*parts(columns or df.columns)).first()
    return int(r.n), int(r["sum"]), int(r.xor)


def same_rows(a: DataFrame, b: DataFrame, known: tuple[int, int, int] | None = None) -> bool:
    """Equal as bags. ``known``: the stored fingerprint of ``b``, which then is read only where it agrees."""
    columns = a.columns
    if fingerprint(a) != (known or fingerprint(b.select(*columns))):
        return False
    both = a.select("*", F.lit(1).alias("_n")).unionByName(b.select(*columns, F.lit(-1).alias("_n")))
    return not both.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0").limit(1).count()


def same_groups(a: DataFrame, b: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """``group, n_a, n_b, same``: for each group whether both tables have the same bag of ``columns`` there, by fingerprints of groups."""
    own = [d.select(group, *columns).groupBy(group).agg(F.struct(*parts(columns)).alias(side)) for d, side in ((a, "_a"), (b, "_b"))]
    of = F.col(group)
    both = own[0].join(own[1].withColumnRenamed(group, "_of"), of.eqNullSafe(F.col("_of")), "full_outer").withColumn(group, F.coalesce(of, "_of"))
    zero = F.lit(0).cast("long")
    return both.select(group, F.coalesce("_a.n", zero).alias("n_a"), F.coalesce("_b.n", zero).alias("n_b"), F.col("_a").eqNullSafe(F.col("_b")).alias("same"))
