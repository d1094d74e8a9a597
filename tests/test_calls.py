"""Model calls on the executors, sizes of images, evaluation over a small vault."""

import json
import struct

from pyspark.sql import functions as F

from inkmesh.operators import fingerprints, graph, links, retrieve
from inkmesh.plans import evaluation
from inkmesh.plans.provider import CallError, Provider, call_all, inventory_of, seeds_of
from inkmesh.plans.settings import Settings
from inkmesh.sources import html, images, manifest, pdf


def test_calls_cost_their_own_row(spark):
    def make_provider():
        def transport(r):
            if "bad" in r.user:
                raise CallError("refused", 400)
            return json.dumps({"echo": r.user}) if r.json else r.user.upper()

        return Provider(transport)

    work = spark.createDataFrame([("a", "synthesis", "", "hi", False), ("b", "inventory", "", "x", True), ("c", "synthesis", "", "bad", False)], "key string, task string, system string, user string, json boolean")
    got = {r.key: (r.reply, r.error) for r in call_all(work, make_provider).collect()}
    assert got["a"] == ("HI", None) and json.loads(got["b"][0]) == {"echo": "x"} and got["c"][0] is None and "refused" in got["c"][1]


def test_replies_are_read_with_tolerance():
    items = [{"title": " A \n b ", "kind": "entity", "aliases": "x"}, {"title": "", "kind": "entity"}, {"title": "c", "kind": "other"}, 5]
    assert inventory_of({"source_summary": "s\n s", "items": items}) == ("s s", [{"title": "A b", "kind": "entity", "aliases": ["x"], "summary": ""}])
    assert seeds_of({"seeds": ["p", "q", "p", 3], "keywords": [" k ", "k", ""]}, {"p"}, Settings()) == (["p"], ["k"])


def test_columns_over_files(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 7, 9)
    df = spark.createDataFrame([(bytearray(png),), (bytearray(b"x"),), (None,)], "b binary")
    assert [tuple(r[0]) for r in df.select(images.image_size("b")).collect()] == [(7, 9), (None, None), (None, None)]
    assert spark.createDataFrame([("<h1>a</h1>",), (None,)], "h string").select(html.markdown("h")).collect()[0][0] == "# a\n"

    def extractor(raw):
        if raw == b"broken":
            raise ValueError("no text\nlayer")
        return [f"{raw.decode()}   one \n\n\n\n two", ""]

    files = spark.createDataFrame([("a", bytearray(b"p")), ("b", bytearray(b"broken"))], "path string, content binary")
    rows = {r.path: (r.text, r.error) for r in pdf.extract(files, extractor).select("path", pdf.joined(F.col("pages")).alias("text"), "error").collect()}
    assert rows == {"a": ("p one\n\ntwo", None), "b": (None, "no text layer")}
    (tmp_path / "m.json").write_text('{"b": "h", "a": {"hash": "i", "derivative": "d"}}')
    m = manifest.load(spark, str(tmp_path / "m.json"))
    assert json.loads(manifest.render(m)) == {"a": {"hash": "i", "derivative": "d"}, "b": {"hash": "h"}}
    assert manifest.load(spark, str(tmp_path / "none.json")).count() == 0
    manifest.save_table(m, str(tmp_path / "m"))
    assert fingerprints.same_rows(spark.read.parquet(str(tmp_path / "m")), m) and not fingerprints.same_rows(m, m.limit(1))


def test_evaluation_of_both_rankings(spark):
    rows = [("wiki/Alpha.md", "Alpha", "concept", [], "first letter", "[[Beta]]", "[[Beta]]"), ("wiki/Beta.md", "Beta", "concept", ["Second"], "", "[[Gamma]]", "[[Gamma]]"), ("wiki/Gamma.md", "Gamma", "concept", [], "", "", "")]
    pages = spark.createDataFrame(rows, "path string, title string, kind string, aliases array<string>, summary string, text string, body string")
    nodes, edges = graph.build(pages, spark.createDataFrame([], "path string, origin string, seq int, text string"))
    queries = spark.createDataFrame([("1", "what is alpha", ["wiki/Beta.md"]), ("2", "second", ["wiki/Beta.md"])], "qid string, question string, expected array<string>")
    out = evaluation.report(evaluation.run(pages, nodes, edges, queries))
    assert (out["B"]["recall_at_5"], out["B"]["ranking_n"]) == (1.0, 1) and out["B"]["ranking_mrr"] in (0.5, 1.0)
    assert out["A"]["n"] == 2
    assert graph.same_topology(nodes, edges, nodes, edges) and not graph.same_topology(nodes, edges, nodes, edges.limit(1))
    lit = spark.range(1).select(retrieve.opacity(F.lit(False), F.lit(True), F.lit(True)), links.page_part(F.lit("A#b"))).first()
    assert tuple(lit) == (0.15, "A")
