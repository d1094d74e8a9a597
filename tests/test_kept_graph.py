"""A graph that follows changes equals one built anew."""

import random

import pytest

from inkmesh.operators import graph
from inkmesh.operators.kept_graph import KeptGraph

PAGES = "path string, title string, aliases array<string>, text string"
NO_RAW = "path string, origin string, seq int, text string"


def plainly(pages):
    """Edges with how many links make them, and degrees, of ``path -> (title, aliases, text)``."""
    owner = {}
    for path in sorted(pages):
        title, aliases, _ = pages[path]
        for name in [title, *(aliases or [])]:
            if name:
                owner.setdefault(name.lower(), path)
    edges, degree = {}, dict.fromkeys(pages, 0)
    for path, (_, _, text) in pages.items():
        for name in {x.split("]]")[0].lower() for x in (text or "").split("[[")[1:]}:
            to = owner.get(name)
            if to and to != path:
                key = (min(path, to), max(path, to))
                edges[key] = edges.get(key, 0) + 1
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1
    return edges, degree


def state(kept):
    return {(r.a, r.b): r.n for r in kept.edges().collect()}, {r.path: r.degree for r in kept.nodes().collect()}


def some_page(r):
    names = ["Ant", "Bee", "Cat", "Dog", "Eel", "Fox", "Gnu"]
    text = None if r.random() < 0.1 else " ".join(f"[[{r.choice([str.upper, str.lower])(r.choice(names))}]]" for _ in range(r.randrange(5)))
    return r.choice([*names, None]), r.sample(names, r.randrange(3)) or None, text


def test_equals_a_rebuild_after_random_changes(spark, tmp_path):
    r = random.Random(3)
    kept, pages = KeptGraph(spark, str(tmp_path / "graph"), buckets=3), {}
    for step in range(6):
        written = {f"p{r.randrange(12)}": some_page(r) for _ in range(r.choice([0, 1, 4]) if step else 8)}
        removed = [f"p{r.randrange(14)}" for _ in range(r.choice([0, 1, 2]) if step else 0)]
        for p in removed:
            pages.pop(p, None)
        pages |= written
        rows = spark.createDataFrame([(p, *v) for p, v in written.items()], PAGES)
        assert kept.update(rows, spark.createDataFrame([(p,) for p in removed], "path string")) == step
        assert state(kept) == plainly(pages), step
    anew = graph.build(spark.createDataFrame([(p, t, a, x, "note", "") for p, (t, a, x) in pages.items()], PAGES + ", kind string, summary string"), spark.createDataFrame([], NO_RAW))[1]
    assert {(e.a, e.b) for e in anew.collect()} == set(state(kept)[0])
    assert state(KeptGraph(spark, str(tmp_path / "graph"))) == plainly(pages)


def test_only_buckets_of_a_change_are_written(spark, tmp_path):
    kept = KeptGraph(spark, str(tmp_path / "graph"), buckets=64)
    kept.update(spark.createDataFrame([(f"p{i}", f"T{i}", None, f"[[T{i + 1}]]") for i in range(300)], PAGES))
    kept.update(spark.createDataFrame([("p7", "T7", None, "[[T9]]")], PAGES))
    tables = kept._state()["tables"]
    new = {k: sum(v == 1 for v in t.values()) for k, t in tables.items()}
    assert new == {"pages": 1, "claims": 1, "links": new["links"], "edges": new["edges"]} and new["links"] <= 2 and new["edges"] <= 2
    edges = state(kept)[0]
    assert ("p7", "p8") not in edges and edges["p7", "p9"] == 1 and len(edges) == 299


def test_raw_files_come_first_and_odd_rows(spark, tmp_path):
    kept = KeptGraph(spark, str(tmp_path / "graph"), buckets=2)
    assert kept.version() is None and kept.edges().count() == 0 and kept.nodes().count() == 0
    columns = PAGES + ", tier int, seq long, n long, bucket int, handle string"
    rows = [
        ("wiki/a", "Same", None, "[[raw/x]] [[Same]] [[b]]", 1, 0), ("raw/z", "raw/z", ["raw/x"], None, 0, 1), ("raw/y", "raw/y", ["raw/x", "same"], "", 0, 2),
        (None, "b", None, "[[Same]]", 1, 0), ("wiki/b", "B", ["b"], "[[Same#part]]", 1, 0), ("wiki/b", "B", ["b"], None, 1, 0), ("wiki/c", None, [None, ""], "[[]] [[|x]]", 1, 0),
    ]
    kept.update(spark.createDataFrame([(*x, 5, 6, "q") for x in rows], columns))
    edges, degree = state(kept)
    assert edges == {("raw/z", "wiki/a"): 1, ("raw/y", "wiki/a"): 1, ("wiki/a", "wiki/b"): 1}
    assert degree == {"wiki/a": 3, "raw/z": 1, "raw/y": 1, "wiki/b": 1, "wiki/c": 0}
    kept.update(spark.createDataFrame([], PAGES), spark.createDataFrame([("raw/z",), ("nobody",), (None,)], "path string"))
    assert state(kept)[0] == {("raw/y", "wiki/a"): 2, ("wiki/a", "wiki/b"): 1}


def test_a_lost_writer_changes_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "graph")
    kept = KeptGraph(spark, folder, buckets=2)
    kept.update(spark.createDataFrame([("a", "A", None, "[[B]]"), ("b", "B", None, "")], PAGES))
    before = state(kept)
    change = spark.createDataFrame([("a", "A", None, "")], PAGES)
    with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
        m.setattr(KeptGraph, "_publish", lambda self, new: (_ for _ in ()).throw(OSError("lost")))
        kept.update(change)
    assert state(KeptGraph(spark, folder)) == before
    assert KeptGraph(spark, folder).update(change) == 1 and state(kept)[0] == {}
