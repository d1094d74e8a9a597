"""Every registered query on small tables: the columns of its contract, and its SQL in DuckDB where it has any."""

import random

import duckdb
import numpy as np
import pytest
from conftest_llm import prose

import corpus_pipeline
from inkmesh.llm import registry

TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn int, role string, text string",
    "benchmark": "item_id bigint, text string",
}
CONTRACT = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op3_url_filter": "page_id host path rule verdict",
    "op4_decontaminate": "doc_id item_id similarity",
    "op5_warc_derivatives": "page_id type record_id refers_to block_digest",
    "op6_near_dedup": "doc_id n_shingles component_id kept",
    "op7_lm_score": "doc_id n_words log_prob mean_log_prob",
    "op8_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op9_suffix_dedup": "doc_id start_word n_words first_doc_id",
    "op10_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op11_resample": "doc_id n_features weight score rank",
    "op12_align": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13_quality_votes": "doc_id held_out score predicted",
    "quality_ablations": "version without kept_docs gained total",
}


def rows():
    r = random.Random(21)
    items = [(i, prose(r, n, 2000)) for i, n in enumerate((12, 30, 55, 7))] + [(9, None)]
    passage = prose(r, 70, 2000)
    texts = [None, "", "short", "# " * 90, "a\nb\na\nb\n" * 30, *[prose(r, r.randrange(20, 300), 2000) for _ in range(30)]]
    texts += [f"{prose(r, 80, 2000)} {passage} {prose(r, 20, 2000)}" for _ in range(3)] + [f"{passage}\n{prose(r, 60, 2000)} {passage}"]
    texts += [f"{prose(r, 60, 2000)} {t} {prose(r, 60, 2000)}" for _, t in items[:4]] + [texts[10], texts[10].upper(), " ".join(texts[11].split()[1:]), "É " * 60]
    urls = [f"http://{r.choice(['a', 'b.spam'])}.{r.choice(['io', 'net', 'org'])}/{r.choice(['fr', 'en', 'x'])}/{i}?{r.choice('pq')}=1" for i in range(60)]
    urls += [None, "", "no url", "HTTP://sub.Example.Net/en/", "http://example.com/de/1", "http://a.io?b"]
    html = ["<html><title> T &amp; u</title><script>x<y</script><p>one<br>two &copy; &middot; &quot;q&quot;</p><a href=\"/x\">l</a><a href=\"/x\">m</a>", None, "", "plain é", "<!-- c --> &lt;b&gt;\n\n <style>p{}</style><h1>h</h1>"]
    return {
        "documents": [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)],
        "pages": [(i, u, html[i % len(html)]) for i, u in enumerate(urls)],
        "labels": [(i, int("spam" not in (u or "") or r.random() < 0.1), r.randrange(2) if i % 7 == 0 else 0) for i, u in enumerate(urls) if i % 5],
        "conversations": [(c, t, r.choice(["system", "user", "assistant"]), r.choice([None, "", "hi </s>", "[INST] é\n"])) for c in range(12) for t in range(r.randrange(1, 6))],
        "benchmark": items,
    }


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    for name, own in rows().items():
        spark.createDataFrame(own, TABLES[name]).coalesce(2).write.parquet(f"{top}/{name}.parquet")
        spark.createDataFrame([], TABLES[name]).write.parquet(f"{top}/none/{name}.parquet")
    return str(top)


def plain(rows, columns):
    return sorted((tuple(None if v is None or v != v else v for v in (r[c] for c in columns)) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_and_its_sql(spark, folder, name):
    found = registry.QUERIES[name](spark, folder)
    assert set(CONTRACT[name].split()) <= set(found.columns)
    assert registry.QUERIES[name](spark, f"{folder}/none").count() == {"op2_chat_format": 1, "quality_ablations": 0}.get(name, 0)
    got = found.collect()
    if name not in registry.ORACLE_SQL:
        assert len(got) >= len(rows()["documents"])
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(found.columns)
    assert plain(got, found.columns) == plain([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], found.columns) and got


def test_op8_and_op10_keep_their_laws(spark, folder):
    docs = {i: t or "" for i, t, *_ in rows()["documents"]}
    out = registry.QUERIES["op8_sharding"](spark, folder).collect()
    assert {r.doc_id: r["size"] for r in out} == {i: len(t.encode()) + 8 for i, t in docs.items()} and {r.law for r in out} == {"bytes"}
    for s in range(24):
        own = sorted(r["slot"] for r in out if r["shard"] == s)
        assert own == list(range(len(own)))
    packed = registry.QUERIES["op10_best_fit_packing"](spark, folder).collect()
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and {r.doc_id for r in packed} == set(docs)


def test_every_copy_has_the_same_score(spark, folder):
    by = {}
    texts = {i: t for i, t, *_ in rows()["documents"]}
    for r in registry.QUERIES["op7_lm_score"](spark, folder).collect():
        by.setdefault((texts[r.doc_id] or "").lower(), set()).add(r.log_prob)
    assert all(len(v) == 1 for v in by.values()) and np.isfinite([x for v in by.values() for x in v]).all()


def test_pipeline_goes_on_where_it_was(spark, folder, tmp_path, monkeypatch):
    want = sorted(map(tuple, corpus_pipeline.run(spark, folder, str(tmp_path / "w")).drop("sequence_id", "offset").collect()))
    done = []
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, lambda *a, n=n, f=f: done.append(n) or f(*a)) for n, f in corpus_pipeline.STAGES])
    (tmp_path / "w" / "3-decontamination" / "_SUCCESS").unlink()
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder, str(tmp_path / "w")).drop("sequence_id", "offset").collect())) == want and done == ["decontamination"]
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
