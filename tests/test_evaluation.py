"""The evaluation runner over a vault of files and a file of questions."""

import json
import os

import pytest

from inkmesh.plans import evaluation

QUESTIONS = """
rankingQueries: 1
floors:
  A: {recallAt5: 1.0, recallAt10: 1.0, mrr: 0.2, ranking: {recallAt5: 1.0, recallAt10: 1.0, mrr: 0.1}}
  B: {recallAt5: 0.0, recallAt10: 0.0, mrr: 2.0, ranking: {recallAt5: 0.0, recallAt10: none, mrr: 0.0}}
queries:
  - query: what is Alpha
    expect: [wiki/concepts/Alpha.md]
  - query: who goes with alpha, the beta letter
    expect: [wiki/concepts/Gamma.md]
"""


@pytest.fixture
def vault(tmp_path):
    def page(title, body, aliases=""):
        (tmp_path / "wiki/concepts").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"wiki/concepts/{title}.md").write_text(f"---\nkind: concept\naliases: [{aliases}]\nsummary: on {title}\n---\n{body}")

    page("Alpha", "goes with [[Beta]]")
    page("Beta", "the letter before [[Gamma]]", "second letter")
    page("Gamma", "alpha and beta come first")
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.md").write_text("[[Alpha]]")
    (tmp_path / "ingest-manifest.json").write_text(json.dumps({"raw/a.md": {"hash": "x"}}))
    return str(tmp_path)


def test_floors_and_the_ranking_subset(spark, vault):
    said = []
    out, missed = evaluation.measure(spark, vault, QUESTIONS, said.append)
    assert said[0] == "3 pages, 4 nodes, 3 edges, 2 questions" and out["A"]["n"] == 2 and out["B"]["ranking_n"] == 1
    assert [m.split(" ")[1] for m in missed] == ["mrr", "ranking_recall_at_10"] and all(m.startswith("B: ") for m in missed)
    assert "subset" not in "".join(missed)
    more = evaluation.measure(spark, vault, QUESTIONS.replace("rankingQueries: 1", "rankingQueries: 2").replace("  B:", "  C:"), said.append)[1]
    assert any("2 are recorded" in m for m in more) and "B: no floor" in more
    assert evaluation.main([]) == 2


@pytest.mark.skipif("INKMESH_EVAL_VAULT" not in os.environ, reason="names no vault to measure, nor INKMESH_EVAL_QUERIES")
def test_a_vault_named_by_the_environment(spark):
    with open(os.environ["INKMESH_EVAL_QUERIES"], encoding="utf-8") as f:
        assert evaluation.measure(spark, os.environ["INKMESH_EVAL_VAULT"], f.read())[1] == []
