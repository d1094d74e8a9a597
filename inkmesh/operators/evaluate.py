"""Ranking quality: recall, reciprocal rank, means, floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at(ranked: Column, expected: Column, k: int) -> Column:
    """Share of the distinct expected among the first ``k``; nothing expected: 1."""
    want = F.array_distinct(expected)
    return F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(want, F.slice(ranked, 1, k))) / F.size(want))


def reciprocal_rank(ranked: Column, expected: Column) -> Column:
    """1 over the rank of the first hit, however far; none: 0."""
    hits = F.filter(F.transform(ranked, lambda x, i: F.when(F.array_contains(expected, x), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(1 / F.array_min(hits), F.lit(0.0))


def outcomes(queries: DataFrame) -> DataFrame:
    """``queries(ranked, expected, seeded)`` with ``recall5, recall10, rr``."""
    r, e = F.col("ranked"), F.col("expected")
    return queries.withColumns({"recall5": recall_at(r, e, 5), "recall10": recall_at(r, e, 10), "rr": reciprocal_rank(r, e)})


def summary(scored: DataFrame) -> DataFrame:
    """Means overall and over queries that were not seeded; the mean of none is 0."""

    def mean(c: str, only: Column | None = None) -> Column:
        return F.coalesce(F.avg(F.when(only, F.col(c)) if only is not None else F.col(c)), F.lit(0.0))

    names = {"recall5": "recall_at_5", "recall10": "recall_at_10", "rr": "mrr"}
    rank = ~F.col("seeded")
    return scored.agg(
        *[mean(c).alias(n) for c, n in names.items()],
        *[mean(c, rank).alias(f"ranking_{n}") for c, n in names.items()],
        F.count(F.lit(1)).alias("n"), F.count_if(rank).alias("ranking_n"),
    )


def under_floors(measured: DataFrame, floors: dict[str, float], slack: float = 1e-9) -> DataFrame:
    """``metric, value, floor`` of what misses its floor, or whose floor is no finite number."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(f).cast("double").alias("floor")) for m, f in floors.items()]
    each = measured.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    finite = F.col("floor").isNotNull() & ~F.isnan("floor") & (F.abs("floor") < float("inf"))
    return each.where(~finite | (F.col("value") < F.col("floor") - slack))
