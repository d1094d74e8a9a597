import datetime as dt
import json
import sys

import pytest
from pyspark import cloudpickle

from inkmesh.functions import blocks, frontmatter
from inkmesh.plans.provider import CallError, Provider, Request, retry_after, without_footer
from inkmesh.plans.settings import Settings
from inkmesh.plans.vault import Busy, Vault
from inkmesh.sources import images

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the transport goes to executors
NOW = dt.datetime(2026, 3, 1, 9, 30, tzinfo=dt.UTC)


def scripted(r: Request) -> str:
    if r.task == "inventory":
        items = [{"title": w, "kind": "concept", "aliases": [w[:3]], "summary": f"about {w}"} for w in sorted({x.strip(".,") for x in r.user.split()}) if w[:1].isupper()]
        return json.dumps({"source_summary": r.user[:30], "items": items})
    if r.task == "page-generation":
        title = r.user.split("\n")[0].removeprefix("Title: ")
        return f"# {title}\n\nProse on {title}, see [[Turing]] and [[Nowhere]]."
    if r.task == "seed-selection":
        return '{"seeds": [], "keywords": ["turing"]}'
    return 'Answer by [[Turing]] and [[Elsewhere]].\n```json\n{"missing_information": ["[[Lovelace]]"]}\n```'


@pytest.fixture
def vault(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.md").write_text("Turing met Church.")
    (raw / "b.txt").write_text("Church wrote Lambda.")
    (raw / "c.csv").write_text("id,name\n1,x\n")
    (raw / "d.docx").write_text("?")
    return Vault(spark, str(tmp_path), Provider(scripted, sleep=lambda s: None), now=lambda: NOW)


def test_build_ask_file_and_health(vault):
    told = []
    first = vault.compile(progress=told.append)
    assert [e["phase"] for e in told] == ["discovering", *["normalizing"] * 3, "inventory", "generating", "writing-index", "writing-manifest"] and not first.noop
    assert first.new == ["raw/a.md", "raw/b.txt", "raw/c.csv"] and not first.failed
    assert "raw/d.docx" in first.skipped
    church = vault.read("wiki/concepts/Church.md")
    assert blocks.citations(church) == ["raw/a.md", "raw/b.txt"]
    assert frontmatter.parse(church).data["kind"] == "concept" and "# Church" not in church
    assert "derived-from" in vault.read("raw/c.md")
    again = vault.compile()
    assert (again.new, again.modified, again.deleted, again.written, again.calls) == ([], [], [], [], 0) and again.noop and again.unchanged == 3

    note = vault.ask("Who was Turing?")
    assert note == "answers/2026-03-01-0930 who-was-turing.md"
    text = vault.read(note)
    assert "[[Turing]]" in text and "link outside retrieved set: Elsewhere" in text and "- **Lovelace**" in text
    seen = vault.inspect("Who was Turing?")
    assert blocks.parse_trace(text).mode == seen["mode"] and "wiki/concepts/Turing.md" in seen["seeds"]

    filed = vault.file_back(note)
    assert filed.startswith("raw/answers/") and vault.read(note) is None and "trace:start" not in vault.read(filed)
    with pytest.raises(ValueError, match="already filed"):
        vault.file_back(filed)
    sections = {r.section for r in vault.health().collect()}
    assert {1, 4, 5} <= sections and "Nowhere" in vault.read("wiki/_health.md")


def test_rename_change_and_deletion(vault, tmp_path):
    vault.compile()
    (tmp_path / "raw/b.txt").rename(tmp_path / "raw/moved.txt")
    (tmp_path / "raw/a.md").unlink()
    preview = vault.preview()
    assert preview["renamed"] == [("raw/b.txt", "raw/moved.txt")] and "wiki/concepts/Turing.md" in preview["delete"]
    assert vault.compile(confirm=lambda p: False).declined
    done = vault.compile(confirm=lambda p: True)
    assert "wiki/concepts/Turing.md" in done.removed
    assert blocks.citations(vault.read("wiki/concepts/Church.md")) == ["raw/moved.txt"]
    assert "raw/a.md" not in vault.read("ingest-manifest.json")
    assert vault.compile().written == []


def test_a_renamed_source_takes_its_derivative_along(vault, tmp_path):
    vault.compile()
    (tmp_path / "raw/c.csv").rename(tmp_path / "raw/e.csv")
    done = vault.compile()
    assert done.renamed == [("raw/c.csv", "raw/e.csv")] and done.calls == 0
    assert "derived-from: raw/e.csv\n" in vault.read("raw/e.md") and vault.read("raw/c.md") is None
    assert json.loads(vault.read("ingest-manifest.json"))["raw/e.csv"]["derivative"] == "raw/e.md"
    again = vault.compile()
    assert (again.new, again.modified, again.deleted, again.renamed, again.written) == ([], [], [], [], [])


def test_images_are_kept_as_assets(vault, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (400).to_bytes(4, "big") * 2 + b"\0" * 6000
    vault.fetch = lambda url: images.Fetched(content_type="image/png", body=png) if "good" in url else images.Fetched(status=404)
    (tmp_path / "raw/p.md").write_text("Pictures ![a](http://x/good.png) and ![b](http://x/bad.png)")
    vault.compile()
    text = vault.read("raw/p.md")
    assert "![a](raw/assets/" in text and "image not fetched: bad.png — fetch failed, HTTP 404" in text
    assert len(list((tmp_path / "raw/assets").iterdir())) == 1
    assert vault.compile().modified == []


def test_a_failed_source_costs_itself_alone(vault):
    def failing(r):
        if r.task == "inventory" and "Lambda" in r.user:
            raise CallError("no", 400)
        return scripted(r)

    vault.provider.transport = failing
    out = vault.compile()
    assert list(out.failed) == ["raw/b.txt"] and "raw/b.txt" not in vault.read("ingest-manifest.json")
    vault.provider.transport = scripted
    assert vault.compile().new == ["raw/b.txt"]


def test_heads_byte_order_marks_and_other_bytes(vault, tmp_path):
    (tmp_path / "raw/bom.md").write_bytes("\ufeff---\ningested: x\n---\nAlpha".encode())
    (tmp_path / "raw/bare.txt").write_bytes("\ufeffBeta \ufffd".encode())
    (tmp_path / "raw/latin.md").write_bytes(b"Gamma \xe9")
    vault.compile()
    assert (tmp_path / "raw/bom.md").read_bytes().decode() == "\ufeff---\nsource-format: md\ningested: x\n---\nAlpha"
    assert (tmp_path / "raw/bare.txt").read_bytes().decode() == "\ufeff---\ningested: '2026-03-01'\nsource-format: txt\n---\nBeta \ufffd"
    assert (tmp_path / "raw/latin.md").read_bytes() == b"Gamma \xe9"
    assert frontmatter.parse("\ufeff---\nkind: x\n---\nb").data == {"kind": "x"} and frontmatter.parse("\ufeff---\nkind: x\n---\nb").body == "b"
    again = vault.compile()
    assert (again.new, again.modified, again.written) == ([], [], [])


def test_a_derivative_whose_place_is_taken_is_not_written(vault, tmp_path):
    vault.compile()
    (tmp_path / "raw/c.md").write_text("---\nderived-from: raw/other.csv\n---\nmine")
    out = vault.compile()
    assert out.modified == ["raw/c.csv"] and "already taken by a derivative of raw/other.csv" in out.failed["raw/c.csv"] and "mine" in vault.read("raw/c.md")
    (tmp_path / "raw/c.md").unlink()
    assert vault.compile().modified == ["raw/c.csv"] and "derived-from: raw/c.csv\n" in vault.read("raw/c.md")


def test_derivatives_of_sources_that_are_gone(vault, tmp_path):
    (tmp_path / "raw/k.csv").write_text("id\n7\n")
    vault.compile()
    (tmp_path / "raw/c.csv").unlink()
    (tmp_path / "raw/k.csv").unlink()
    (tmp_path / "raw/k.md").write_text("my own")
    out = vault.compile()
    assert out.derivatives_removed == ["raw/c.md"] and "left raw/k.md alone" in out.reported["raw/k.csv"] and vault.read("raw/k.md").endswith("my own")


def test_walks_and_their_steps(vault):
    vault.compile()
    seed = "wiki/concepts/Turing.md"
    scores = {r.path: r.score for r in vault.ppr([seed]).collect()}
    assert scores[seed] == max(scores.values())
    steps = vault.ppr([seed], snapshots=True)
    assert "iter" in steps.columns and steps.select("iter").distinct().count() > 3
    assert "snapshots" in vault.inspect("Who was Turing?", snapshots=True)


def test_one_operation_at_a_time(vault):
    with vault.held("compile"), pytest.raises(Busy):
        vault.ask("x")


def outcomes(*steps):
    steps = list(steps)

    def transport(r):
        x = steps.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    return transport


def test_retries():
    waits = []
    p = Provider(outcomes(CallError("busy", 503), CallError("slow down", 429, 7), "ok"), sleep=waits.append, chance=lambda: 1.0)
    assert p.complete(Request("synthesis", "", "")) == "ok" and waits == [1.0, 7] and p.attempts["synthesis"] == 3
    with pytest.raises(CallError, match="giving up after 3 attempts"):
        Provider(outcomes(*[CallError("down", 500)] * 3), sleep=lambda s: None).complete(Request("synthesis", "", ""))
    with pytest.raises(CallError):
        Provider(outcomes(CallError("bad", 401)), sleep=lambda s: None).complete(Request("synthesis", "", ""))
    assert retry_after("0") is None and retry_after("12") == 12 and retry_after("soon") is None


def test_json_replies():
    assert Provider(outcomes('```json\n{"a": 1}\n```')).complete(Request("inventory", "", "", json=True)) == {"a": 1}
    assert Provider(outcomes("x", "[1]")).complete(Request("inventory", "", "", json=True)) == [1]
    with pytest.raises(CallError, match="one repair"):
        Provider(outcomes("x", "y")).complete(Request("inventory", "", "", json=True))
    assert Provider(outcomes(CallError("temperature unsupported", 400), "{}")).complete(Request("inventory", "", "", json=True)) == {}


def test_answer_footer():
    assert without_footer('a\n```json\n{"missing_information": ["x", 3, " "]}\n```\n') == ("a", ["x"])
    assert without_footer("```\ncode\n```\nprose") == ("```\ncode\n```\nprose", [])
    assert without_footer("a\n```\nbroken\n```") == ("a", [])


def test_settings_are_held_to_their_ranges():
    s = Settings(max_retries=99, ppr_alpha=1.0, seeds_cap=0, context_budget_tokens=-1, compile_concurrency=2.9, mode_min_link_ratio=float("nan")).normalized()
    assert (s.max_retries, s.ppr_alpha, s.seeds_cap, s.context_budget_tokens, s.compile_concurrency, s.mode_min_link_ratio) == (10, 0.85, 1, 40_000, 2, 1.5)
