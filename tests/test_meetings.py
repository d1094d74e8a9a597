"""Questions and pages that meet in blocks: the same rows whatever the sizes of blocks and tiles, and none of them shuffled."""

import random

import pytest

from inkmesh.operators import meetings, retrieve
from tests.test_substrings import tier


@pytest.fixture
def small(monkeypatch):
    for name, value in (("BLOCK", 9), ("CHUNK", 24), ("TILE", 4), ("CELLS", 64), ("ROWS", 5), ("SHORT", 1)):
        monkeypatch.setattr(meetings, name, value)


@pytest.fixture(scope="module")
def asked(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randrange(1, 5)))
    pages = [(f"wiki/{i}.md", word(), "concept", [word() for _ in range(r.randrange(3))], " ".join(word() for _ in range(3)), " ".join(word() for _ in range(9))) for i in range(31)]
    asked = [(f"q{i}", " ".join(word() for _ in range(2)), [word() for _ in range(r.randrange(4))] * r.randrange(1, 4)) for i in range(25)] + [("none", "zzz", []), ("often", "", ["a"] * 4000)]
    want = {(i, p[0]): sum(tier(k, p[1], *p[3:]) for k in ks) for i, _, ks in asked for p in pages}
    forced = {(i, p[0]) for i, text, _ in asked for p in pages if any(n in text for n in [p[1], *p[3]])}
    p = spark.createDataFrame(pages, "path string, title string, kind string, aliases array<string>, summary string, body string")
    return p, spark.createDataFrame(asked, "qid string, question string, keywords array<string>"), want, forced


def after_the_last_join(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan[: plan.index("Join")]


def test_scores_of_blocks(spark, small, asked):
    pages, questions, want, _ = asked
    scores = retrieve.lexical_scores(pages, questions)
    got = scores.collect()
    assert {(x.qid, x.path): x.score for x in got} == {k: v for k, v in want.items() if v} and len(got) == len({(x.qid, x.path) for x in got})
    assert scores.columns == ["qid", "path", "title", "kind", "score"] and {x.kind for x in got} == {"concept"}
    assert not any(x in after_the_last_join(scores) for x in ("Aggregate", "Repartition", "Distinct"))


def test_no_pages_and_no_questions(spark, asked):
    pages, questions, _, _ = asked
    for p, q in ((pages.limit(0), questions), (pages, questions.limit(0)), (pages, questions.where("qid = 'none'"))):
        assert retrieve.lexical_scores(p, q).count() == retrieve.mode_a(p, q, questions=q).count() == 0


def test_ranks_of_blocks(spark, small, asked):
    pages, questions, want, forced = asked
    seeds = spark.createDataFrame([("q1", "wiki/3.md"), ("q2", "gone"), ("unasked", "wiki/1.md"), ("none", "wiki/30.md")], "qid string, path string")
    for ranks, also in ((retrieve.mode_a(pages, questions, questions=questions), forced), (retrieve.mode_a(pages, questions, seeds), {("q1", "wiki/3.md"), ("none", "wiki/30.md")})):
        ordered = {}
        for (i, path), v in want.items():
            if v or (i, path) in also:
                ordered.setdefault(i, []).append((-v, path))
        assert {(x.qid, x["rank"]): (-x.score, x.path) for x in ranks.collect()} == {(i, k): v for i, vs in ordered.items() for k, v in enumerate(sorted(vs), 1)}
        assert ranks.columns == ["qid", "path", "title", "kind", "score", "rank"]
        assert not any(x in after_the_last_join(ranks) for x in ("Aggregate", "Repartition", "Sort", "Window"))


def test_sides_are_not_repeated_for_each_row(spark, monkeypatch):
    """A name of many pages in many questions: tasks, and so the copies of each side, don't grow with its rows."""
    monkeypatch.setattr(retrieve, "MADE", 2)
    pages = spark.createDataFrame([(f"p{i}", "the", [f"a{i}x"]) for i in range(60)], "path string, title string, aliases array<string>")
    asked = spark.createDataFrame([(f"q{i}", f"of the a{i}x") for i in range(50)], "qid string, question string")
    found = retrieve.force_include(pages, asked)
    assert found.count() == found.distinct().count() == 3000
    assert found.rdd.getNumPartitions() <= 5 * 5
