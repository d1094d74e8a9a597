"""Patterns in texts by equal keys, and what rests on them, against trying all pairs; places in an order."""

import random

import pytest

from inkmesh.operators import retrieve
from inkmesh.operators.shared import placed, ranked_in_groups
from inkmesh.operators.substrings import within


@pytest.mark.parametrize("seed", [1, 2])
def test_within_against_all_pairs(spark, seed):
    r = random.Random(seed)
    some = lambda most: "".join(r.choice("abÉ\U0001f600 ") for _ in range(r.randrange(most)))
    patterns, texts = [some(14) for _ in range(80)] + ["x" * 300, None], [(i, some(60)) for i in range(60)] + [(60, None), (61, "x" * 299), (62, "x" * 301), (63, "")]
    found = within(spark.createDataFrame([(p,) for p in patterns], "pattern string"), spark.createDataFrame(texts, "i int, text string"), ["i"])
    assert sorted(map(tuple, found.collect())) == sorted((i, p) for i, t in texts for p in {p for p in patterns if p} if p in (t or ""))
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert within(spark.createDataFrame([], "pattern string"), spark.createDataFrame(texts, "i int, text string"), ["i"]).count() == 0


def tier(k, title, aliases, summary, body):
    names = [n for n in [title, *aliases] if n]
    return 10 if title == k else 8 if k in aliases else 4 if any(n in k or k in n for n in names) else 2 if k in summary else 1 if k in body else 0


def test_lexical_scores_and_named_pages_against_all_pairs(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 5)))
    pages = [(f"wiki/{i}.md", word(), "concept", [word() for _ in range(r.randrange(3))], " ".join(word() for _ in range(3)), " ".join(word() for _ in range(9))) for i in range(40)] + [("wiki/n.md", "é", "concept", None, None, None)]
    asked = [(f"q{i}", " ".join(word() for _ in range(2)), [word() for _ in range(r.randrange(4))] + [" "]) for i in range(30)] + [("qé", "É", ["É"])]
    p = spark.createDataFrame(pages, "path string, title string, kind string, aliases array<string>, summary string, body string")
    q = spark.createDataFrame(asked, "qid string, question string, keywords array<string>")
    want = {(i, path): sum(tier(k.lower(), t, a or [], s or "", b or "") for k in ks if k.strip()) for i, _, ks in asked for path, t, _, a, s, b in pages}
    assert {(x.qid, x.path): x.score for x in retrieve.lexical_scores(p, q).collect()} == {k: v for k, v in want.items() if v}
    assert set(map(tuple, retrieve.force_include(p, q).collect())) == {(i, path) for i, text, _ in asked for path, t, _, a, _, _ in pages if any(n in text.lower() for n in [t, *(a or [])] if n)}
    seeds = spark.createDataFrame([("q1", "wiki/n.md"), ("q2", "wiki/0.md"), ("no", "wiki/0.md")], "qid string, path string")
    ranks = retrieve.mode_a(p, q, seeds)
    by = {i: sorted((-v, path) for (j, path), v in want.items() if j == i and (v or (i, path) in {("q1", "wiki/n.md"), ("q2", "wiki/0.md")})) for i, _, _ in asked}
    assert {(x.qid, x["rank"]): (-x.score, x.path) for x in ranks.collect()} == {(i, k + 1): v for i, vs in by.items() for k, v in enumerate(vs)}
    assert "NestedLoop" not in ranks._jdf.queryExecution().toString() and "Cartesian" not in ranks._jdf.queryExecution().toString()


def test_places_in_an_order_and_in_groups(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    assert [x.i for x in placed(df, ["v", "i"]).orderBy("place").collect()] == [i for _, _, i in sorted(rows, key=lambda x: x[1:])]
    got = {(x.g, x.i): x["rank"] for x in ranked_in_groups(df, ["g"], ["v", "i"]).collect()}
    for g in ("a", "b", None):
        assert [got[g, i] for _, _, i in sorted((x for x in rows if x[0] == g), key=lambda x: x[1:])] == list(range(1, 1 + sum(x[0] == g for x in rows)))
    assert placed(df.limit(0), ["v"]).count() == 0
