"""Queries that do the whole job, where tables are large enough to tell."""

import os

import duckdb
import pytest

from inkmesh.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "supplier part lineitem documents pages labels".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet/*.parquet'" if os.path.isdir(f"{SF}/{t}.parquet") else f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(spark, duck, name):
    """The rows of a query, which are those of its SQL."""
    df = QUERIES[name](spark, SF)
    got = df.collect()
    found = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, found))
    return got


def test_every_supplier_is_a_question(spark, duck):
    got = rows(spark, duck, "seeds_validated")
    assert len({r.qid for r in got}) == duck.execute("SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey * 2 IN (SELECT p_partkey FROM part)").fetchone()[0] > 20


def test_no_citer_is_lost(spark, duck):
    from inkmesh.plans import data_queries as q

    live = q.changed(spark, SF).where("status <> 'deleted'").select("path")
    cited = q.citations(spark, SF).join(live, q.F.col("source") == live.path, "left_semi").distinct().groupBy("page").count().collect()
    found = {r.page: len(r.citers.split(",")) for r in rows(spark, duck, "citer_union")}
    assert found == {r.page: r["count"] for r in cited} and max(found.values()) > 11


def test_every_page_that_scores_is_ranked(spark, duck):
    got = rows(spark, duck, "mode_a_rank")
    scored = duck.execute("SELECT count(*) FROM part WHERE contains(lower(p_brand), 'brand')").fetchone()[0]
    assert sum(r.qid == "k3" for r in got) == max(r.rank for r in got) == scored > 50


def test_every_good_document_is_expected(spark, duck):
    from inkmesh.plans import data_queries as q

    expected = q.outcomes_of(spark, SF).select(q.F.sum(q.F.size("expected"))).first()[0]
    assert expected == duck.execute("SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE quality = 1").fetchone()[0]
    assert len(rows(spark, duck, "eval_per_query")) == 20
    rows(spark, duck, "eval_recall_mrr"), rows(spark, duck, "eval_floors")


def test_the_walk_has_settled(spark, duck):
    from inkmesh.plans import graph_queries as q

    got = {(r.qid, r.path): r.score for r in rows(spark, duck, "mode_b_rank")}
    more = {(r.qid, r.path): r.score for r in q.mode_b_rank(spark, SF, 2 * q.SETTLED).collect()}
    assert got.keys() == more.keys() and all(abs(got[k] - more[k]) < 1.5e-6 for k in got)
