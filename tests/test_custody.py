"""Custody of derivatives, on small folders."""

import pytest

from inkmesh.functions import frontmatter
from inkmesh.plans.custody import Custody, Taken, canonical


@pytest.fixture
def folder(tmp_path):
    def make(files, recorded):
        for path, origin in files.items():
            (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / path).write_text(f"---\nderived-from: {origin}\n---\nof {origin}" if origin else "own")
        return Custody(tmp_path, recorded)

    return make


def test_a_derivative_goes_along(folder):
    c = folder({"raw/a.md": "raw/a.csv"}, {"raw/a.csv": "raw/a.md", "raw/t.txt": None})
    assert c.carry([("raw/a.csv", "raw/new/b.csv", "dataset"), ("raw/t.txt", "raw/u.txt", "txt"), ("raw/x.csv", "raw/y.csv", "dataset")]) == {
        "raw/new/b.csv": ("raw/new/b.md", None), "raw/u.txt": (None, None), "raw/y.csv": (None, "no markdown was recorded for raw/x.csv, so raw/y.csv was extracted again"),
    }
    assert c.origin("raw/new/b.md") == "raw/new/b.csv" and not c.exists("raw/a.md")


def test_it_stays_where_the_place_is_taken_or_already_right(folder):
    c = folder({"raw/a.md": "raw/a.csv", "raw/b.md": None, "raw/d.md": "raw/d.csv"}, {"raw/a.csv": "raw/a.md", "raw/d.csv": "raw/d.md"})
    assert c.carry([("raw/a.csv", "raw/b.csv", "dataset"), ("raw/d.csv", "raw/d.tsv", "dataset")]) == {"raw/b.csv": ("raw/a.md", None), "raw/d.tsv": ("raw/d.md", None)}
    assert (c.origin("raw/a.md"), c.origin("raw/d.md"), c.origin("raw/b.md")) == ("raw/b.csv", "raw/d.tsv", None)


def test_a_place_that_is_left_is_free_for_another_whatever_the_order(folder):
    names = ("c", "b", "a")  # a -> b -> c -> d: the last has to go first
    c = folder({f"raw/{n}.md": f"raw/{n}.csv" for n in names}, {f"raw/{n}.csv": f"raw/{n}.md" for n in names})
    out = c.carry([(f"raw/{n}.csv", f"raw/{chr(ord(n) + 1)}.csv", "dataset") for n in names])
    assert out == {f"raw/{n}.csv": (f"raw/{n}.md", None) for n in "bcd"} and all(c.origin(f"raw/{n}.md") == f"raw/{n}.csv" for n in "bcd")


def test_a_swap_moves_nothing(folder):
    c = folder({"raw/a.md": "raw/a.csv", "raw/b.md": "raw/b.csv"}, {"raw/a.csv": "raw/a.md", "raw/b.csv": "raw/b.md"})
    assert c.carry([("raw/a.csv", "raw/b.csv", "dataset"), ("raw/b.csv", "raw/a.csv", "dataset")]) == {"raw/a.csv": ("raw/b.md", None), "raw/b.csv": ("raw/a.md", None)}
    assert (c.origin("raw/a.md"), c.origin("raw/b.md")) == ("raw/b.csv", "raw/a.csv")


def test_adopted_refused_and_finished(folder, tmp_path):
    c = folder({"raw/n.md": "raw/o.csv", "raw/p.md": "raw/q.csv", "raw/r.md": "raw/else.csv"}, {"raw/o.csv": "raw/o.md", "raw/p.csv": "raw/p.md", "raw/r.csv": "raw/r.md"})
    out = c.carry([("raw/o.csv", "raw/n.csv", "dataset"), ("raw/p.csv", "raw/q.csv", "dataset"), ("raw/r.csv", "raw/s.csv", "dataset")])
    assert out["raw/n.csv"] == ("raw/n.md", None) and c.origin("raw/n.md") == "raw/n.csv"  # moved together with its source
    assert out["raw/q.csv"] == ("raw/q.md", None)  # a run before had renamed it at its place on record
    assert out["raw/s.csv"][0] is None and "could not be carried" in out["raw/s.csv"][1] and c.origin("raw/r.md") == "raw/else.csv"
    (tmp_path / "raw/r.md").write_text("---\nderived-from: >\n  raw/r.csv\n---\n")
    assert "extracted again" in c.carry([("raw/r.csv", "raw/s.csv", "dataset")])["raw/s.csv"][1]


def test_places_and_what_is_left_over(folder):
    c = folder({"raw/a.md": None, "raw/f.md": "raw/a.csv", "raw/b.md": "raw/b.csv", "raw/g.md": "raw/g.csv"}, {"raw/a.csv": "raw/f.md", "raw/b.csv": "raw/b.md", "raw/g.csv": "raw/g.md", "raw/h.csv": "raw/a.md"})
    assert c.place("raw/a.csv", "dataset", "raw/a.csv") == "raw/f.md" and c.place("raw/b.csv", "dataset", "raw/b.csv") == "raw/b.md" and c.place("raw/z.csv", "dataset", "raw/z.csv") == "raw/z.md"
    for path in ("raw/a.pdf", "raw/g.pdf"):
        with pytest.raises(Taken):
            c.place(path, "pdf", path)
    c.superseded("raw/b.csv", "raw/c.csv", "raw/c.md", ["raw/b.md"])
    assert c.exists("raw/b.md")
    c.superseded("raw/b.csv", "raw/c.csv", "raw/c.md", [])
    assert c.sweep(["raw/g.csv", "raw/h.csv", "raw/none.csv"]) == {} and c.removed == ["raw/b.md", "raw/g.md"]
    assert "left raw/a.md alone" in c.reported["raw/h.csv"] and canonical("raw/x.txt", "txt") is None
    assert frontmatter.parse("---\nderived-from: raw/a\n---\n").data == {"derived-from": "raw/a"}
