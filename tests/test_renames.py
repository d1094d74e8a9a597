"""Renames: the choice by turns against a plain loop that tries all; what is skipped."""

import random

import pytest

from inkmesh.operators import changes


def plainly(olds, news):
    """New paths in order, each trying all old ones that are left."""
    key = lambda p: p.encode("utf-16-be")
    olds, out = sorted(olds, key=key), []
    for n in sorted(news, key=key):
        def score(o, n=n):
            a, b = o.rpartition("/")[0], n.rpartition("/")[0]
            return (2 if a == b else 1 if a == "" or b.startswith(a + "/") else 0) + (o.rpartition("/")[2] == n.rpartition("/")[2])

        if olds:
            best = max(range(len(olds)), key=lambda i: (score(olds[i]), -i))
            out.append((olds.pop(best), n))
    return out


@pytest.mark.parametrize("turn", [1, 3, 20_000])
def test_choice_against_all_pairs(spark, turn):
    r = random.Random(turn)
    folders = ["", "a", "a/b", "a/b/c", "a0", "a-", "ab", "b", "b/é", "b/\U0001f600", "b/Ａ"]
    path = lambda: "/".join(x for x in (r.choice(folders), r.choice("xyzw")) if x)
    rows, want = [], []
    for g in range(200):
        news = sorted({path() for _ in range(r.randrange(1, 25 if turn > 3 else 9))})
        olds = sorted({path() for _ in range(r.randrange(1, 25 if turn > 3 else 9))} - set(news))
        rows += [(p, "new", f"h{g}", None) for p in news] + [(p, "deleted", None, f"h{g}") for p in olds]
        want += plainly(olds, news)
    rows += [("n1", "new", None, None), ("o1", "deleted", None, None)]
    df = spark.createDataFrame(rows, "path string, status string, hash string, old_hash string")
    assert sorted(map(tuple, changes.rename_pairs(df, turn).collect())) == sorted(want)


def test_new_paths_choose(spark):
    rows = [("raw/a/1.txt", "deleted", None, "h"), ("raw/b/1.txt", "deleted", None, "h"), ("raw/b/2.txt", "new", "h", None)]
    df = spark.createDataFrame(rows, "path string, status string, hash string, old_hash string")
    assert list(map(tuple, changes.rename_pairs(df).collect())) == [("raw/b/1.txt", "raw/b/2.txt")]


def test_skipped_folders_hide_what_is_under_them(spark):
    found = spark.createDataFrame([("raw/x", "1")], "path string, hash string")
    known = spark.createDataFrame([(f"raw/{i % 5}/{i}/f", "1") for i in range(3000)] + [("raw/top", "1"), ("raw/0x/f", "1")], "path string, hash string")
    skips = spark.range(100_000).selectExpr("concat('raw/', id % 5, '/', id) AS path").where("path <> 'raw/0/10'")
    out = changes.diff(found, known, skips)
    assert sorted(r.path for r in out.where("status = 'deleted'").collect()) == ["raw/0/10/f", "raw/0x/f", "raw/top"]
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_very_many_equal_files_are_paired_quickly(spark):
    n = 40_000
    rows = [(f"raw/a/{i:06d}", "deleted", None, "h") for i in range(n)] + [(f"raw/b/{i:06d}", "new", "h", None) for i in range(n)]
    df = spark.createDataFrame(rows, "path string, status string, hash string, old_hash string")
    assert {(r.old[-6:], r.new[-6:]) for r in changes.rename_pairs(df).collect()} == {(f"{i:06d}",) * 2 for i in range(n)}
