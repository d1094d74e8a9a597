"""Fingerprints of tables, counters taken in passing, folds in order, types by bits, hashes of paths."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkmesh.functions.text import fnv1a
from inkmesh.operators import changes, dataset, graph
from inkmesh.operators.fingerprints import fingerprint, same_groups, same_rows
from inkmesh.operators.folds import folded
from inkmesh.sources import formats


def test_bags_are_equal_by_rows_and_how_often(spark):
    of = lambda rows: spark.createDataFrame(rows, "a string, b string").repartition(3)
    rows = [("x", "y"), ("x", "y"), ("y", None), (None, "y"), (None, None)]
    assert same_rows(of(rows), of(rows[::-1])) and same_rows(of(rows), of(rows), fingerprint(of(rows)))
    for other in (rows[1:], [*rows, rows[0]], [*rows[1:], rows[2]], [*rows[:2], (None, "y"), (None, "y"), (None, None)], [("y", "x"), *rows[1:]]):
        assert not same_rows(of(rows), of(other)) and fingerprint(of(rows)) != fingerprint(of(other))
    assert not same_rows(of(rows), of(rows), (5, 0, 0)) and same_rows(of([]), of([])) and fingerprint(of([])) == (0, 0, 0)
    got = same_groups(of(rows), of([("x", "y"), ("y", None), (None, None), (None, "y"), ("z", "z")]), "a", ["b"]).collect()
    assert {(r.a, r.n_a, r.n_b, r.same) for r in got if r.a} == {("x", 2, 1, False), ("y", 1, 1, True), ("z", 0, 1, False)}


def test_counters_are_of_the_rows_written(spark):
    rows = [(f"p{i}", s, None, None) for i, s in enumerate(["new"] * 5 + ["deleted"] * 2 + ["modified"])]
    out, n = changes.counted(spark.createDataFrame(rows, "path string, status string, hash string, old_hash string"))
    assert n == {"new": 5, "modified": 1, "unchanged": 0, "deleted": 2} and out.count() == 8


def test_a_fold_carries_its_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(g, i, 1) for g in ("a", "b", None) for i in random.Random(2).sample(range(100), 50)]

        def take(state, own):
            out = []
            for n in own["n"]:
                state[0] += n
                out.append(state[0])
            return {"i": own["i"], "total": pa.array(out, pa.int64())}

        df = folded(spark.createDataFrame(rows, "g string, i long, n long").repartition(4), "g", ["i"], lambda: [0], take, None, "i long, total long", ["i", "n"])
        got = {(r.g, r.i): r.total for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in ("a", "b", None):
        assert [got[g, i] for _, i, _ in sorted((r for r in rows if r[0] == g), key=lambda r: r[1])] == list(range(1, 51))


def test_folders_in_order_of_their_names(spark):
    names = ["src/a.py", "src-gen/b.py", "lib/d.py", "lib.v2/c.py", "lib.v2/x/e.py", "lib/z/f.py", "a b/g.py", "a/h.py", "docs/z.md", "docs/src/a.md", "docs/b/a.md", "README.md", "z.py"]
    df = spark.createDataFrame([(f"raw/r/{n}", bytearray(b"x")) for n in [*names, ".git/HEAD"]], "path string, content binary")
    own = formats.repo_files(df, formats.repo_roots(df))
    assert [r.path for r in own.orderBy("seq").collect()] == ["README.md", "docs/z.md", "docs/b/a.md", "docs/src/a.md", "z.py", "a/h.py", "a b/g.py", "lib/d.py", "lib.v2/c.py", "src/a.py", "src-gen/b.py", "lib/z/f.py", "lib.v2/x/e.py"]


def test_many_files_of_one_repository(spark):
    n = 200_000
    files = spark.range(n).select(F.lit("raw/r").alias("repo"), F.format_string("f%06d.py", "id").alias("path"), F.when(F.col("id") % 2 == 0, F.lit(b"12345")).otherwise(F.lit(b"1")).alias("content"), F.col("id").alias("seq"))
    left = formats.retained(files, 4, 1000)
    assert {(r.omitted, r["count"]) for r in left.groupBy("omitted").count().collect()} == {("file over 100KB", n // 2), (None, 1000), ("repo total over 1MB", n // 2 - 1000)}
    assert formats.repo_identity(files).count() == 1


@pytest.mark.parametrize(("cells", "kind"), [(["1", " +2 ", ""], "integer"), (["1", "2.5", ".5e3"], "number"), (["Yes", "FALSE"], "boolean"), (["2020-01-02", "2020-01-02T03:04"], "date"), (["1", "yes"], "string"), ([" ", ""], "empty"), (["2020-01-02", "1"], "string"), (["x"], "string")])
def test_types(spark, cells, kind):
    assert dataset.column_types(spark.createDataFrame([(c,) for c in cells], "c string")).first()["type"] == kind


def test_hashes_of_paths(spark):
    paths = ["", "a", "wiki/é.md", "\U0001f600/x", None, "p" * 300]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", graph.path_hash(F.col("p")).alias("h")).collect()
    assert [(r.p, r.h) for r in got] == [(p, None if p is None else fnv1a(p)) for p in paths]
