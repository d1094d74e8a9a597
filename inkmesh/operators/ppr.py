"""Personalized PageRank, for many questions at once.

``v = alpha * A v + (1 - alpha) * p`` from ``v = p``, with ``p`` even over the valid seeds of a
question. Nodes without edges pass nothing on, so their mass leaves. A walk ends when
the L1 change is under ``eps`` or after ``max_iter`` steps.

Two physical paths give the same scores. A graph of at most ``SMALL_EDGES`` edges is
sent to the tasks (its size is checked first) and each question walks alone in numpy,
in path order, to the same bits each time. A larger one takes a join and a sum per step
over ``(qid, id, score)``, ids in path order, and only rows with a score flow; its edges stay where
they are, and the sum tells the change as well, so a step is one small job that sends nothing through the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.operators.graph import symmetric
from inkmesh.operators.shared import kept, placed

ALPHA, MAX_ITER, EPS, SMALL_EDGES, MAX_SNAPSHOTS = 0.85, 100, 1e-8, 200_000, 100
SCORES = "qid string, path string, score double, iterations int, converged boolean"
STEPS = "qid string, iter int, path string, score double"
#: Pairs of the adjacency for a task, and questions (or their steps) up to which they are sent to every task.
PAIRS, FEW = 100_000, 1000


def walk(n: int, source: np.ndarray, target: np.ndarray, seeds: list[int], alpha: float, max_iter: int, eps: float):
    """Scores after each step over directed pairs sorted by (target, source): yields (vector, change)."""
    degree = np.bincount(source, minlength=n).astype(float)
    p = np.zeros(n)
    p[seeds] = 1 / len(seeds)
    share = alpha / degree[source]
    v = p
    for _ in range(max_iter):
        new = np.bincount(target, v[source] * share, n) + (1 - alpha) * p
        change = float(np.abs(new - v).sum())
        v = new
        yield v, change
        if change < eps:
            return


def _small(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float, max_iter: int, eps: float, snapshots: bool) -> DataFrame:
    import pandas as pd

    paths = sorted((r[0] for r in nodes.collect()), key=lambda s: s.encode("utf-16-be", "surrogatepass"))  # bounded by the check in run()
    at = {p: i for i, p in enumerate(paths)}
    pairs = np.array(sorted((at[b], at[a]) for a, b in (tuple(r) for r in symmetric(edges).collect())), dtype=np.int64).reshape(-1, 2)

    def of(key, pdf):
        qid = key[0]
        own = sorted({at[p] for p in pdf["path"]})
        frames, v, change, k = [], None, None, 0
        for k, (v, change) in enumerate(walk(len(paths), pairs[:, 1], pairs[:, 0], own, alpha, max_iter, eps), 1):  # noqa: B007
            if snapshots and k <= MAX_SNAPSHOTS:
                frames.append(pd.DataFrame({"qid": qid, "iter": k, "path": paths, "score": v}))
        if snapshots:
            return pd.concat(frames)
        return pd.DataFrame({"qid": qid, "path": paths, "score": v, "iterations": k, "converged": change < eps})

    # a question's group is its valid seeds, a handful
    return seeds.select("qid", "path").join(nodes, "path", "left_semi").groupBy("qid").applyInPandas(of, STEPS if snapshots else SCORES)


def step(v: DataFrame, adjacency: DataFrame, p: DataFrame, alpha: float, tasks: int, deterministic: bool = False) -> DataFrame:
    """One step of all walks: ``v(qid, id, score)``, ``adjacency(a, b, degree of a)``, ``p(qid, id, p)``. Gives ``qid, id, score, old``, the score before.

    Sides meet without a broadcast, which would pass through the driver once a step. All are dealt by id to as
    many ``tasks`` as the adjacency by ``a``, so scores meet it where they are and a step moves its flow alone.
    """
    none = F.lit(0.0).alias("old")
    flow = v.where("score > 0").join(adjacency.hint("merge"), F.col("id") == F.col("a")).select("qid", F.col("b").alias("id"), F.col("a").alias("from"), (F.lit(alpha) * F.col("score") / F.col("degree")).alias("x"), none)
    back = p.select("qid", "id", F.lit(-1).cast("long").alias("from"), ((1 - F.lit(alpha)) * F.col("p")).alias("x"), none)
    was = v.select("qid", "id", F.lit(-1).cast("long").alias("from"), F.lit(0.0).alias("x"), F.col("score").alias("old"))
    both = flow.union(back).union(was).repartition(tasks, "id").groupBy("qid", "id")
    if deterministic:
        return both.agg(F.aggregate(F.array_sort(F.collect_list(F.struct("from", "x"))), F.lit(0.0), lambda acc, s: acc + s["x"]).alias("score"), F.sum("old").alias("old"))
    return both.agg(F.sum("x").alias("score"), F.sum("old").alias("old"))


def _crossed(rows: DataFrame, few: DataFrame) -> DataFrame:
    """All pairs of both; ``few`` goes to every task where a count says that it can."""
    return rows.crossJoin(F.broadcast(few) if few.limit(FEW + 1).count() <= FEW else few)


def _large(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float, max_iter: int, eps: float, snapshots: bool, deterministic: bool, every: int = 5) -> DataFrame:
    spark = nodes.sparkSession
    ids = placed(nodes, ["path"], "id")  # in path order
    of = lambda rows, name: rows.join(ids.select(F.col("path").alias(name), F.col("id").alias(f"_{name}")).hint("merge"), name).drop(name).withColumnRenamed(f"_{name}", name)
    own = kept(of(of(edges, "a"), "b"))
    pairs = symmetric(own)
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    tasks = max(spark.sparkContext.defaultParallelism, 2 * own.count() // PAIRS)
    adjacency = kept(pairs.join(degree.hint("merge"), "a")).repartition(tasks, "a").sortWithinPartitions("a").persist()
    valid = seeds.select("qid", "path").distinct().join(ids.hint("merge"), "path").select("qid", "id")
    p = kept(valid.join(valid.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).hint("merge"), "qid").select("qid", "id", (1 / F.col("n")).alias("p")))
    v = held = p.select("qid", "id", F.col("p").alias("score"))
    finished, steps, ends = None, None, None
    for k in range(1, max_iter + 1):
        new = step(v, adjacency, p, alpha, tasks, deterministic)
        # read below and by the next step: kept, and every few steps cut off from what it came from
        new = kept(new) if k % every == 0 or snapshots and k <= MAX_SNAPSHOTS else new.persist()
        change = new.groupBy("qid").agg(F.sum(F.abs(F.col("score") - F.col("old"))).alias("change"))
        ended = change.where((F.col("change") < eps) | F.lit(k == max_iter)).select("qid", (F.col("change") < eps).alias("converged"))
        if snapshots and k <= MAX_SNAPSHOTS:
            part = new.select("qid", F.lit(k).alias("iter"), "id", "score")
            steps = part if steps is None else steps.union(part)
        last, new = new, new.select("qid", "id", "score")
        if ended.limit(1).count():  # kept only where a walk has ended: a job a step otherwise
            ended, new = kept(ended.select("qid", F.lit(k).alias("iterations"), "converged")), kept(new)
            done = new.join(ended.select("qid").hint("merge"), "qid")
            finished, ends = (done, ended) if finished is None else (finished.union(done), ends.union(ended))
            new = new.join(ended.hint("merge"), "qid", "left_anti")
            p = p.join(ended.hint("merge"), "qid", "left_anti")
            if not new.limit(1).count():
                break
        held.unpersist()
        v, held = new, last
    adjacency.unpersist()
    if snapshots:
        frames = ends.select("qid", F.explode(F.sequence(F.lit(1), F.least("iterations", F.lit(MAX_SNAPSHOTS)))).alias("iter"))
        scored = _crossed(ids, frames).join(steps.hint("merge"), ["qid", "iter", "id"], "left")
        return scored.select("qid", "iter", "path", F.coalesce("score", F.lit(0.0)).alias("score"))
    # the result holds every node of every question
    scored = _crossed(ids, ends).join(finished.hint("merge"), ["qid", "id"], "left")
    return scored.select("qid", "path", F.coalesce("score", F.lit(0.0)).alias("score"), "iterations", "converged")


def run(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = ALPHA, max_iter: int = MAX_ITER, eps: float = EPS, snapshots: bool = False, deterministic: bool = False, small_edges: int = SMALL_EDGES) -> DataFrame:
    """``qid, path, score, iterations, converged`` of every node for each question with a valid seed.

    ``nodes(path)``, ``edges(a, b)``, ``seeds(qid, path)``. A question without a valid seed has
    no rows. ``snapshots``: ``qid, iter, path, score`` instead, after each step.
    """
    nodes, edges = kept(nodes.select("path").distinct()), kept(edges.select("a", "b"))
    few = edges.limit(small_edges + 1).count() <= small_edges and nodes.limit(2 * small_edges + 1).count() <= 2 * small_edges
    if few:
        return _small(nodes, edges, seeds, alpha, max_iter, eps, snapshots)
    return _large(nodes, edges, seeds, alpha, max_iter, eps, snapshots, deterministic)
