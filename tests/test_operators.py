import pytest
from pyspark.sql import functions as F

from inkmesh.operators import changes, evaluate, graph, links, retrieve, smell
from inkmesh.sources import formats


@pytest.mark.parametrize(("n", "e", "mode"), [(20, 30, "B"), (19, 100, "A"), (20, 29, "A"), (0, 0, "A")])
def test_mode(spark, n, e, mode):
    assert spark.range(1).select(graph.mode_of(F.lit(n), F.lit(e))).first()[0] == mode


def test_pack_stops_at_the_first_misfit(spark):
    items = spark.createDataFrame([("q", i, "x" * n) for i, n in enumerate((40, 400, 4))], "g string, i int, text string")
    assert [r.i for r in retrieve.pack(items, "g", "i", "text", 20).orderBy("i").collect()] == [0]
    cut = retrieve.pack(items, "g", "i", "text", 5).collect()
    assert [(r.i, r.truncated) for r in cut] == [(0, True)]
    assert retrieve.pack(items, "g", "i", "text", 5, truncate_first=False).count() == 0
    assert [r.i for r in retrieve.pack(items, "g", "i", "text", 10**6, 2).orderBy("i").collect()] == [0, 1]


def test_lexical_tiers(spark):
    pages = spark.createDataFrame([("p", "Turing machine", "concept", ["TM", " "], "abstract device", "a tape")], "path string, title string, kind string, aliases array<string>, summary string, body string")
    want = {"turing MACHINE": 10, "tm": 8, "machine": 4, "the turing machine": 4, "device": 2, "tape": 1, "zzz": 0, " ": 0}
    keys = spark.createDataFrame([(k, [k]) for k in want] + [("twice", ["tape", "tape"])], "qid string, keywords array<string>")
    got = {r.qid: r.score for r in retrieve.lexical_scores(pages, keys).collect()}
    assert got == {k: v for k, v in want.items() if v} | {"twice": 2}


def test_two_name_tables_differ(spark):
    pages = spark.createDataFrame([("wiki/1", "One", ["Two"]), ("wiki/2", "Two", [])], "path string, title string, aliases array<string>")
    raw = spark.createDataFrame([], "path string, origin string, seq int")
    assert {r.handle: r.path for r in links.title_index(pages).collect()}["two"] == "wiki/2"
    assert {r.handle: r.path for r in graph.graph_index(pages, raw).collect()}["two"] == "wiki/1"


def test_graph_with_raw_files(spark):
    pages = spark.createDataFrame([("wiki/A.md", "A", "concept", [], "", "[[B]] [[A]] [[raw/x.csv]] [[B#h]]"), ("wiki/B.md", "B", "concept", [], "", "[[a|shown]]")], "path string, title string, kind string, aliases array<string>, summary string, text string")
    raw = spark.createDataFrame([("raw/x.md", "raw/x.csv", 0, "[[B]]"), ("raw/y.md", "raw/y.md", 1, None)], "path string, origin string, seq int, text string")
    nodes, edges = graph.build(pages, raw)
    assert sorted(map(tuple, edges.collect())) == [("raw/x.md", "wiki/A.md"), ("raw/x.md", "wiki/B.md"), ("wiki/A.md", "wiki/B.md")]
    assert {r.path: r.degree for r in nodes.collect()} == {"wiki/A.md": 2, "wiki/B.md": 2, "raw/x.md": 2, "raw/y.md": 0}


def test_renames_choose_the_nearest(spark):
    rows = [("raw/a/x.md", "deleted", None, "h"), ("raw/b/y.md", "deleted", None, "h"), ("raw/c/y.md", "new", "h", None), ("raw/a/z.md", "new", "h", None), ("raw/q.md", "new", "i", None)]
    changed = spark.createDataFrame(rows, "path string, status string, hash string, old_hash string")
    assert sorted(map(tuple, changes.rename_pairs(changed).collect())) == [("raw/a/x.md", "raw/a/z.md"), ("raw/b/y.md", "raw/c/y.md")]


def test_a_skipped_folder_deletes_nothing(spark):
    found = spark.createDataFrame([], "path string, hash string")
    known = spark.createDataFrame([("raw/s/a.md", "1"), ("raw/sx.md", "2")], "path string, hash string")
    skipped = spark.createDataFrame([("raw/s",)], "path string")
    assert [r.path for r in changes.diff(found, known, skipped).collect()] == ["raw/sx.md"]


def test_metrics(spark):
    rows = [(["a", "b", "c"], ["c", "x"], False), (["a"], [], True), ([], ["z"], False)]
    got = evaluate.outcomes(spark.createDataFrame(rows, "ranked array<string>, expected array<string>, seeded boolean"))
    assert [(r.recall5, r.rr) for r in got.collect()] == [(0.5, pytest.approx(1 / 3)), (1.0, 0.0), (0.0, 0.0)]
    s = evaluate.summary(got)
    assert s.first().ranking_n == 2
    assert {r.metric for r in evaluate.under_floors(s, {"recall_at_5": 0.5, "mrr": float("inf"), "recall_at_10": 0.9}).collect()} == {"mrr", "recall_at_10"}
    assert evaluate.summary(got.limit(0)).first().mrr == 0.0


def test_smells(spark):
    pages = [("d", i, "Running head\n" + "\n".join(f"broken line {i} {j}" for j in range(8))) for i in range(3)] + [("e", 0, "A full line." * 40)]
    got = {r.doc: r.reasons for r in smell.reasons(spark.createDataFrame(pages, "doc string, page int, text string")).collect()}
    assert got == {"d": ["short output for 3 pages", "repeated line on 3 pages", "high sentence-fragment ratio (100%)"], "e": []}


def test_repository_files_read_and_not(spark):
    names = ["a.toml", "b.yaml", "c.json", "d.txt", "e.tsx", "out/x.py", "__pycache__/k.py", "npm-shrinkwrap.json", "Gemfile.lock", "composer.lock", "README.rst", "sub/README.rst", ".git/config", "f.sh"]
    df = spark.createDataFrame([(f"raw/r/{n}", bytearray(b"\xff\xfe x" if n == "f.sh" else b"x")) for n in names], "path string, content binary")
    own = formats.repo_files(df, formats.repo_roots(df))
    assert [r.path for r in own.orderBy("seq").collect()] == ["README.rst", "a.toml", "b.yaml", "c.json", "f.sh", "__pycache__/k.py"]
    assert "```bash\n\ufffd\ufffd x\n```" in formats.repo_markdown(own).first().text


def test_repository_as_one_source(spark):
    files = [("raw/r/.git/HEAD", b"x"), ("raw/r/src/b.py", b"bb"), ("raw/r/a.py", b"a```\n"), ("raw/r/docs/z.md", b"z"), ("raw/r/README", b"r"), ("raw/r/node_modules/m.js", b"m"), ("raw/x.md", b"x"), ("raw/r/big.md", b"b" * 200_000)]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    roots = formats.repo_roots(df)
    own = formats.repo_files(df, roots)
    assert [r.path for r in own.orderBy("seq").collect()] == ["README", "docs/z.md", "a.py", "big.md", "src/b.py"]
    text = formats.repo_markdown(own).first().text
    assert text.startswith("# r\n\n## README\n\n```\nr\n```\n\n") and "````python\na```\n````" in text and text.endswith("```\n") and "repo file omitted: big.md — file over 100KB" in text
    found = {r.path: r["format"] for r in formats.discover(df).collect()}
    assert found == {"raw/r": "repo", "raw/x.md": "md"}


def test_stops_of_a_walk(spark):
    steps = spark.createDataFrame([("q", i, "a", i / 10) for i in range(1, 4)] + [("r", 1, "a", 1.0)] + [("s", 1, "a", 1.0)], "qid string, iter int, path string, score double")
    final = spark.createDataFrame([("q", "a", 0.9, 6), ("r", "a", 1.0, 1), ("s", "a", 0.5, 2)], "qid string, path string, score double, iterations int")
    got = sorted((r.qid, r.stop, r.score, r.label) for r in retrieve.stops(steps, final).collect())
    assert got[3] == ("q", 4, 0.9, "final vector at iteration 6 (iterations 4–5 not retained)") and got[0][3] == "iteration 1 of 6"
    assert got[4:] == [("r", 1, 1.0, "iteration 1 of 1"), ("s", 1, 1.0, "iteration 1 of 2"), ("s", 2, 0.5, "iteration 2 of 2")]


def test_tasks_follow_the_rows(spark):
    from inkmesh.operators.shared import dealt

    df = spark.range(1000).select((F.col("id") % 100).alias("k"), "id")
    parts = dealt(df, "k", rows=20).select("k", F.spark_partition_id().alias("p"))
    assert parts.rdd.getNumPartitions() == 50 and parts.distinct().count() == 100 and parts.count() == 1000


def test_a_seed_search_is_dealt_by_its_rows(spark, monkeypatch):
    from inkmesh.operators import shared

    monkeypatch.setattr(shared.dealt, "__kwdefaults__", {"rows": 10})
    proposed = spark.createDataFrame([(f"q{i % 3}", i, f"p{i % 50}") for i in range(400)], "qid string, pos int, path string")
    got = retrieve.valid_seeds(proposed, spark.createDataFrame([(f"p{i}",) for i in range(0, 50, 2)], "path string"), 4)
    assert "40), REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.qid, r.pos, r.path) for r in got.collect()) == sorted((f"q{q}", i, f"p{i % 50}") for q in range(3) for i in [i for i in range(400) if i % 3 == q and i % 2 == 0][:4])


def test_texts_join_by_a_shuffle(spark):
    rank = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b")], "qid string, rank int, path string")
    got = retrieve.assemble(rank, spark.createDataFrame([("a", "x"), ("b", "y")], "path string, text string"))
    assert sorted((r.path, r.text) for r in got.collect()) == [("a", "x"), ("b", "y")]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
