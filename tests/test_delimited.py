"""Delimited files read in many tasks, against the parser of a whole file."""

import random

import pytest

from inkmesh.sources import delimited


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "24", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def found(spark, folder):
    rows = delimited.read(spark, str(folder)).collect()
    by_name = {}
    for r in sorted(rows, key=lambda r: (r.path, r.block, r.line)):
        by_name.setdefault(r.path.rsplit("/", 1)[1], []).append(r.fields)
    return by_name


def written(folder, texts):
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode())
    return {name: rows for name, text in texts.items() if (rows := delimited.parse(text, delimited.delimiter_of(name)))}


def test_random_texts_over_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(5)
    texts = {}
    for k in range(60):
        marks = ['"', '"', '""', ",", "\t", "\n", "\r", "a", "é", "long plain words "]
        texts[f"{k:03}.{'tsv' if k % 3 else 'csv'}"] = rng.choice(["", "﻿"]) + "".join(rng.choices(marks, [rng.random() for _ in marks], k=rng.choice([0, 1, 3, 12, 80])))
    assert written(tmp_path, texts) == found(spark, tmp_path)


def test_edges(spark, tmp_path, small_splits):
    texts = {
        "empty.csv": "", "mark.csv": "﻿", "blank.csv": "\n\n", "return.csv": "\r", "returns.csv": "a\n\r\n", "open.csv": 'a\n"never closed, \n\n' + "b\n" * 50,
        "second.csv": "﻿﻿a\n﻿b\n", "both.csv": '"a\n",b\n"c\n\n\nd" e "f\ng,""\r"h\ni"\n', "end.csv": 'x,""', "UPPER.TSV": 'a,b\tc\n"\t\n"\td',
        "wide.csv": "\n".join('"' + "w " * 40 + '""\n""' + str(k) + '",' + str(k) for k in range(60)),
    }
    assert written(tmp_path, texts) == found(spark, tmp_path)


def test_a_file_goes_to_many_tasks(spark, tmp_path):
    text = "".join(f'{k},"a\n""{k}",b\n' for k in range(20_000))
    (tmp_path / "big.csv").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(text) // 12))
    try:
        rows = delimited.read(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.fields for r in sorted(rows, key=lambda r: (r.block, r.line))] == delimited.parse(text, ",")
    assert len({r.block for r in rows}) >= 12
