"""Resampling: counts, gains and ranks against a plain version, CRCs that are put together, odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import prose

from inkmesh.llm import resample


def grams(text):
    low = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def plainly(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in texts for f in grams(x)[1]) for texts in ([t for _, t in rows], target))
    every, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (every + 10000) / ((s[b] + 1) * (wanted + 10000))))
    out = []
    for i, text in rows:
        w, f = grams(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=repr)


def test_against_a_plain_version(spark, rng):
    texts = [prose(rng, rng.randrange(5, 60), 90) for _ in range(60)]
    texts += [None, "", "  ,,  ", "É é ÀB1 x-y_z", "A" * 200 + " b", "one", texts[0], texts[0], " ".join(texts) * 3, "nul\x00in side " * 12]
    rows = list(enumerate(texts)) + [(3, texts[1]), (3, texts[1]), (None, texts[2]), (None, texts[3])]
    target = [prose(rng, 30, 40), None, "", "É é"]
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id bigint, text string, score int, buckets string").repartition(5)
    found = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()), key=repr)
    assert got == plainly(rows, target) and sum(r[4] is not None for r in got) == 25 * sum(len(grams(t)[0]) >= 20 for _, t in rows) // 100


def test_without_rows_or_target(spark):
    none, docs = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b " * 20)], "doc_id bigint, text string")
    assert resample.resample(none, docs).count() == 0
    assert [(r.n_features, r["rank"]) for r in resample.resample(docs, none).collect()] == [(79, None)]


def test_crcs_put_together(rng):
    pairs = [(rng.randbytes(rng.randrange(9)), rng.randbytes(rng.choice((0, 1, 5, 62, 63, 64, 300)))) for _ in range(300)]
    got = resample.joined_crc(*(np.array(x) for x in ([zlib.crc32(a) for a, _ in pairs], np.array([zlib.crc32(b) for _, b in pairs], np.uint32), [len(b) for _, b in pairs])))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_suffixes_in_order(rng, depth):
    ids = np.array([rng.randrange(4) for _ in range(200)])
    order, lcp = resample.suffix_order(ids, depth)
    at = lambda i: tuple(np.concatenate([ids, np.zeros(depth, int)])[i : i + depth])
    assert sorted(order.tolist()) == list(range(200)) and [at(i) for i in order] == sorted(at(i) for i in range(200))
    for k in range(1, 200):
        a, b = at(order[k - 1]), at(order[k])
        n = next((j for j in range(depth) if a[j] != b[j] or a[j] == 0), depth)
        assert lcp[k] == n
