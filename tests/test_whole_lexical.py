"""Every tier of the lexical score is looked at: bodies too, and names and keywords in any spelling."""

import unicodedata

import pytest

from inkmesh.operators import retrieve
from inkmesh.plans import graph_queries


@pytest.mark.parametrize("query", ["lexical_asked", "mode_a_asked"])
def test_a_word_of_the_body_alone_scores(spark, tmp_path, query):
    page = '<html lang="en"><title>{}</title><a href="/{}">x</a></html>'
    spark.createDataFrame([(1, page.format("One two", "Linked")), (2, page.format("Three four", "other"))], "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(7, 0, "user", "was it linked"), (7, 1, "assistant", "other")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = getattr(graph_queries, query)(spark, str(tmp_path))
    assert [(x.qid, x.path, x.score) for x in found.collect()] == [("7-0", "wiki/1", 1)]


def test_names_and_keywords_in_any_spelling(spark):
    far, near = (unicodedata.normalize(form, "Café") for form in ("NFD", "NFC"))
    pages = spark.createDataFrame([("title", far, ["x"]), ("alias", "x", [far]), ("near", near, [])], "path string, title string, aliases array<string>").selectExpr("*", "'concept' AS kind", "'' AS summary", "'' AS body")
    keys = spark.createDataFrame([("far", [far]), ("near", [near])], "qid string, keywords array<string>")
    got = {(x.qid, x.path): x.score for x in retrieve.lexical_scores(pages, keys).collect()}
    assert got == {(q, p): s for q in ("far", "near") for p, s in (("title", 10), ("alias", 8), ("near", 10))}
