"""Quality by neighbours: exact sums, the same scores in any batch, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest
from conftest_llm import prose

from inkmesh.llm import votes


def corpus(rng, n):
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        text = prose(rng, rng.randrange(30, 90), 500)
        rows.append((i, " ".join(w + rng.choice(["###", "%%%"]) for w in text.split()) if bad else text))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


DOCS, LABELS = "doc_id bigint, text string", "doc_id bigint, quality int, toxic int"


def test_held_out_rows_and_odd_ones(spark, rng):
    rows, labels = corpus(rng, 240)
    odd = [(1000, None), (1001, ""), (None, "w1 w2"), (5, rows[7][1]), (5, rows[7][1]), (1002, " ".join(f"w{k}###" for k in range(50))), (1003, rows[4][1] * 300)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows + odd], DOCS + ", label string, score double").repartition(3)
    known = spark.createDataFrame(labels + [(7, 1, 0), (7, None, 1), (None, 1, 0), (5000, 0, 0)], LABELS)
    got = votes.classify(docs, known).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "null").encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    assert len([r for r in got if r.doc_id == 5]) == 3 and len({r.score for r in got if r.doc_id == 5}) <= 2  # two of these rows have one text
    own = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 240 and r.doc_id != 5}
    held = [i for i, r in own.items() if r.held_out]
    assert len(held) > 30 and np.mean([own[i].predicted == labels[i][1] for i in held]) > 0.95


def test_a_label_of_the_held_out_fold_changes_nothing(spark, rng):
    rows, labels = corpus(rng, 60)
    docs = spark.createDataFrame(rows, DOCS)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    scores = [sorted(map(tuple, votes.classify(docs, spark.createDataFrame(x, LABELS)).collect())) for x in (labels, turned)]
    assert scores[0] == scores[1] and turned != labels


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [(r.score, r.predicted) for r in votes.classify(docs, none).collect()] == [(0.5, 1)] * 2
    assert votes.classify(docs.limit(0), spark.createDataFrame([(1, 1, 0)], LABELS)).count() == 0


def test_the_sample_is_bounded_and_of_both_classes(spark, rng):
    rows, labels = corpus(rng, 90)
    found = votes.features(spark.createDataFrame(rows + rows[:5], DOCS)).cache()
    chosen = votes.examples(found, spark.createDataFrame(labels, LABELS), 10)
    assert sorted(x[0] for x in chosen) == [0] * 10 + [1000] * 10


@pytest.mark.parametrize("at", [0, 1, 17])
def test_bits_do_not_depend_on_the_batch(rng, at):
    r = np.random.default_rng(2)
    rows = [(np.sort(r.choice(votes.BUCKETS, n, replace=False)).astype("<u2").tobytes(), r.integers(1, 256, n).astype(np.uint8).tobytes()) for n in r.integers(1, 400, 60)]
    voters = votes.Voters([(int(x), *row) for x, row in zip(r.integers(0, 1001, 40), rows, strict=False)], r.random(votes.BUCKETS) + 0.1)
    assert (voters.scores(rows[at : at + 9]) == voters.scores(rows)[at : at + 9]).all()
    cosine = votes.vectors(rows, voters.map)
    assert (cosine == np.rint(cosine)).all() and np.abs(np.linalg.norm(cosine, axis=1) / votes.UNIT - 1).max() < 0.01
