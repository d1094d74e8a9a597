import random

import numpy as np
import pytest

from inkmesh.operators import ppr


def scores(spark, nodes, edges, seeds, **options):
    n = spark.createDataFrame([(x,) for x in nodes], "path string")
    e = spark.createDataFrame(edges, "a string, b string")
    s = spark.createDataFrame([("q", x) for x in seeds], "qid string, path string")
    rows = ppr.run(n, e, s, **options).collect()
    return {r.path: r.score for r in rows}, {(r.iterations, r.converged) for r in rows}


FIVE = ("abcde", [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c")])


@pytest.mark.parametrize("small", [ppr.SMALL_EDGES, 0])
def test_five_nodes(spark, small):
    got, ends = scores(spark, *FIVE, ["a"], small_edges=small)
    assert got == pytest.approx({"a": 1380 / 3131, "b": 680 / 3131, "c": 680 / 3131, "d": 391 / 3131, "e": 0}, abs=1e-8)
    assert [c for _, c in ends] == [True]


def test_isolated_seed_keeps_its_share(spark):
    got, _ = scores(spark, *FIVE, ["e"])
    assert got["e"] == pytest.approx(0.15) and sum(got.values()) == pytest.approx(0.15)


def test_unknown_seed_gives_nothing(spark):
    assert scores(spark, *FIVE, ["zz"]) == ({}, set())


@pytest.mark.parametrize(("n", "seeds", "steps", "converged"), [(2, [0], 100, False), (4, [0, 1, 2, 3], 22, True), (16, [0], 100, False)])
def test_chains(spark, n, seeds, steps, converged):
    edges = [(f"n{i:02}", f"n{i + 1:02}") for i in range(n - 1)]
    _, ends = scores(spark, [f"n{i:02}" for i in range(n)], edges, [f"n{i:02}" for i in seeds])
    assert ends == {(steps, converged)}


@pytest.mark.parametrize(("n", "steps"), [(3, 24), (5, 53), (7, 73), (9, 87), (11, 96)])
def test_cycles(spark, n, steps):
    edges = [(f"n{i:02}", f"n{(i + 1) % n:02}") for i in range(n)]
    _, ends = scores(spark, [f"n{i:02}" for i in range(n)], edges, ["n00"])
    assert ends == {(steps, True)}


def dense(n, edges, seeds, alpha):
    a = np.zeros((n, n))
    for x, y in edges:
        a[x, y] = a[y, x] = 1
    degree = a.sum(0)
    a = a / np.where(degree, degree, 1)
    p = np.zeros(n)
    p[seeds] = 1 / len(seeds)
    return np.linalg.solve(np.eye(n) - alpha * a, (1 - alpha) * p)


def test_random_graphs_against_a_dense_solve():
    r = random.Random(5)
    for _ in range(250):
        n = r.randint(2, 12)
        density = r.uniform(0.15, 0.65)
        edges = [(x, y) for x in range(n) for y in range(x) if r.random() < density]
        seeds = sorted({i for i in range(n) if r.random() < 0.3} or {0})
        alpha = r.uniform(0.05, 0.95)
        pairs = np.array(sorted([(y, x) for x, y in edges] + edges), dtype=np.int64).reshape(-1, 2)
        v = None
        for v, _ in ppr.walk(n, pairs[:, 1], pairs[:, 0], seeds, alpha, 4000, 1e-12):  # noqa: B007
            pass
        assert np.abs(v - dense(n, edges, seeds, alpha)).max() < 1e-6


def test_order_of_input_does_not_matter(spark):
    nodes, edges = FIVE
    one, _ = scores(spark, nodes, edges, ["a", "d"])
    two, _ = scores(spark, nodes[::-1], [(b, a) for a, b in edges[::-1]], ["d", "a"])
    assert one == two


def test_a_step_sends_nothing_through_the_driver(spark):
    v = spark.createDataFrame([("q", 0, 1.0)], "qid string, id long, score double")
    adjacency = spark.createDataFrame([(0, 1, 1), (1, 0, 1)], "a long, b long, degree long")
    new = ppr.step(v, adjacency, v.withColumnRenamed("score", "p"), 0.5, 2)
    assert {(r.id, r.score, r.old) for r in new.collect()} == {(0, 0.5, 1.0), (1, 0.5, 0.0)}
    assert "Broadcast" not in new._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("deterministic", [False, True])
def test_both_paths_agree_on_questions_that_end_at_different_steps(spark, deterministic):
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "path string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("f", "g")], "a string, b string")
    seeds = spark.createDataFrame([("x", "a"), ("y", "e"), ("z", "f"), ("z", "g"), ("w", "gone")], "qid string, path string")
    for snapshots in (False, True):
        small, large = (sorted(map(tuple, ppr.run(nodes, edges, seeds, snapshots=snapshots, deterministic=deterministic, small_edges=n).collect())) for n in (ppr.SMALL_EDGES, 0))
        assert [[x for x in r if not isinstance(x, float)] for r in small] == [[x for x in r if not isinstance(x, float)] for r in large] and len({r[-2] for r in small}) > 1
        assert [x for r in small for x in r if isinstance(x, float)] == pytest.approx([x for r in large for x in r if isinstance(x, float)], abs=1e-12)
