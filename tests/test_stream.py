from inkmesh.streaming.incremental import ingest


def test_each_new_file_is_taken_once(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.md").write_text("one")
    ingest(spark, str(folder), str(tmp_path / "table"), str(tmp_path / "checkpoint"))
    (folder / "b.docx").write_text("two")
    ingest(spark, str(folder), str(tmp_path / "table"), str(tmp_path / "checkpoint"))
    rows = {r.path.rpartition("/")[2]: r for r in spark.read.parquet(str(tmp_path / "table")).collect()}
    assert {k: r["format"] for k, r in rows.items()} == {"a.md": "md", "b.docx": None}
    assert len(rows["a.md"].hash) == 64
