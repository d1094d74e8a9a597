"""Pages that questions name: once each, dealt out by question, and nothing shuffled once rows are made."""

from inkmesh.operators import retrieve


def test_once_each_and_not_shuffled_after_the_join(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "MADE", 3)
    pages = spark.createDataFrame([("p1", "Cat", ["dog", "cat"]), ("p2", "cat", None), ("p3", "dog", ["cat dog", ""]), ("p4", None, ["bird"])], "path string, title string, aliases array<string>")
    asked = spark.createDataFrame([(f"q{i}", "the Cat dog") for i in range(9)] + [("q0", "a bird"), ("none", "fish"), ("null", None)], "qid string, question string")
    found = retrieve.force_include(pages, asked)
    want = [(f"q{i}", p) for i in range(9) for p in ("p1", "p2", "p3")] + [("q0", "p4")]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan[: plan.index("Join")] for x in ("Aggregate", "Repartition", "Distinct"))
