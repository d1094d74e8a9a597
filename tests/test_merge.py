"""Inventory merge: by hand, and against a plain walk over all items in one loop."""

import random

import pytest
from pyspark.sql import functions as F

from inkmesh.functions.text import handle_py, sanitize_title_py, title_stem_py, unique_title_py
from inkmesh.operators import merge as M

PAGE = "path string, title string, kind string, aliases array<string>"


def run(spark, pages, items, requeued=None, reserved=None):
    frame = lambda rows, schema: None if rows is None else spark.createDataFrame([(r,) for r in rows], schema)
    rows = M.numbered(M.merge(spark.createDataFrame(pages, PAGE), spark.createDataFrame(items, M.ITEM), frame(requeued, "path string"), frame(reserved, "title string"))).orderBy("n").collect()
    new = [(r.made, r.kind, list(r.aliases), r.summary, list(r.citers)) for r in rows if r.made]
    return new, {r.page: (list(r.aliases), r.summary, list(r.citers)) for r in rows if not r.made}


def plainly(pages, items, reserved=()):
    """One loop over all items."""
    order = lambda s: s.encode("utf-16-be")
    able = sorted((p for p in pages if p[2] != "source"), key=lambda p: (order(p[1]), order(p[0])))
    table = {}
    for p in able:
        table.setdefault(handle_py(p[1]), p)
    for p in able:
        for a in p[3]:
            table.setdefault(handle_py(a), p)
    held = {handle_py(p[1]) for p in pages} | {handle_py(r) for r in reserved}
    back = {}
    for p in sorted(able, key=lambda p: (int(p[1].rpartition("-")[2]) if p[1].rpartition("-")[2].isdigit() else 0, order(p[0]))):
        base, dash, n = p[1].rpartition("-")
        if base and n.isdigit() and handle_py(base) in held and handle_py(base) not in table:
            back.setdefault(handle_py(base), p)
    own = {h: p[0] for h, p in table.items()}
    for r in reserved:
        own.setdefault(handle_py(r), "?")
    goes, new, at, again, taken = {p[0]: {handle_py(x) for x in (p[1], *p[3])} for p in pages}, [], {}, {}, set(held)
    for source, _, title, kind, aliases, summary in sorted(items, key=lambda i: (order(i[0]), i[1])):
        names = list({handle_py(a): a.strip() for a in reversed([a for a in aliases or [] if a and a.strip()])}.items())[::-1]
        names = sorted(names, key=lambda x: [handle_py(a) for a in aliases if a].index(x[0]))
        can = [h for h in (handle_py(title), handle_py(sanitize_title_py(title)), handle_py(title_stem_py(title)), *(h for h, _ in names)) if h]
        page = next((t[h] for t in (table, back) for h in can if h in t), None)
        if page is not None:
            entry, me, offer = again.setdefault(page[0], [[], "", []]), page[0], [(handle_py(title), title.strip()), *names]
        else:
            k, offer = next((at[h] for h in can if h in at), None), names
            if k is None:
                k, made = len(new), unique_title_py(sanitize_title_py(title), taken)
                taken.add(handle_py(made))
                new.append([made, kind, [], "", []])
                own[handle_py(made)] = k
                goes[k] = {handle_py(made)}
                at |= {handle_py(made): k, handle_py(title): k}
            entry, me = new[k][2:], k
            entry = [new[k][2], None, new[k][4]]
        for h, a in offer:
            if h and h not in goes[me] and own.get(h, me) == me:
                own[h] = me
                goes[me].add(h)
                entry[0].append(a)
                if isinstance(me, int):
                    at[h] = me
        if source not in entry[2]:
            entry[2].append(source)
        if summary and isinstance(me, int):
            new[me][3] = summary
        elif summary:
            again[me][1] = summary
    return [tuple(n) for n in new], {p: tuple(e) for p, e in again.items()}


def test_by_name_alias_and_number(spark):
    pages = [("wiki/c/PageRank.md", "PageRank", "concept", ["PR"]), ("wiki/s/x.md", "Compiler", "source", []), ("wiki/c/Compiler-10.md", "Compiler-10", "concept", []), ("wiki/c/Compiler-2.md", "Compiler-2", "concept", None)]
    items = [("raw/b.md", 0, "pr", "concept", [], "second"), ("raw/b.md", 1, "Compiler", "concept", None, None), ("raw/a.md", 0, "New", "entity", ["N", "PageRank", " "], "one"), ("raw/a.md", 1, "n", "concept", ["M"], "two")]
    new, again = run(spark, pages, items, requeued=["wiki/s/x.md", "wiki/gone.md"])
    assert new == [("n", "concept", ["M"], "two", ["raw/a.md"])]
    assert again == {"wiki/c/PageRank.md": (["New", "N"], "second", ["raw/a.md", "raw/b.md"]), "wiki/c/Compiler-2.md": (["Compiler"], "", ["raw/b.md"]), "wiki/s/x.md": ([], "", [])}


def test_a_page_is_made_once_and_a_name_has_one_owner(spark):
    items = [("raw/a.md", 0, "Held", "concept", ["H"], "a"), ("raw/a.md", 1, "Other", "entity", ["H", "O"], ""), ("raw/b.md", 0, "h", "entity", ["HH", "Kept"], "b")]
    new, again = run(spark, [("wiki/s/x.md", "Held", "source", [])], items, reserved=["kept"])
    assert new == [("Held-2", "concept", ["H", "O", "HH"], "b", ["raw/a.md", "raw/b.md"])] and again == {}
    assert run(spark, [], []) == ([], {})


@pytest.mark.parametrize(("seed", "few"), [(1, 2000), (2, 0), (3, 0)])
def test_against_a_plain_walk(spark, monkeypatch, seed, few):
    monkeypatch.setattr(M, "FEW", few)
    r = random.Random(seed)
    pool = [f"{c}{d}" for c in "abcdefgh" for d in ("", "-2", "-3", " x", "/y")] + ["A", "É", "e\u0301", "_b", "z" * 230, "z" * 230 + "#"]
    some = lambda k: [r.choice(pool) for _ in range(r.randrange(k))]
    titles = r.sample([p for p in pool if "/" not in p and len(p) < 200], 12)
    pages = [(f"wiki/{i}.md", t, r.choice(["source", "concept", "entity"]), some(3)) for i, t in enumerate(titles)]
    items = [(f"raw/{s}.md", i, r.choice(pool), r.choice(["concept", "entity"]), some(4), r.choice(["", f"sum {s} {i}"])) for s in range(12) for i in range(r.randrange(1, 9))]
    reserved = r.sample(pool[:40], 3)
    assert run(spark, pages, items, reserved=reserved) == plainly(pages, items, reserved)


def test_clusters_are_what_handles_connect(spark, monkeypatch):
    monkeypatch.setattr(M, "FEW", 0)
    shared = spark.createDataFrame([(k, f"h{k}") for k in range(40)] + [(k, f"h{k + 1}") for k in range(40) if k % 10 != 9], "key long, handle string")
    found = M.clusters(spark.range(41).select(F.col("id").alias("key")), shared).collect()
    assert {r.key: r.cluster for r in found} == {k: k // 10 * 10 if k < 40 else 40 for k in range(41)}
