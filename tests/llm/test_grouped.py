"""Groups of a portion made at once: ids, links and digests of a hand-made one, and no element by element expressions in the plan."""

import hashlib

import numpy as np
import pyarrow as pa

from inkmesh.llm import align


def test_groups_of_a_portion():
    told = align.Spelling([f"{i}{after}".encode() for i in range(30) for after in ",|;"])
    # two stretches: " ab" + " c", A as 1 (2 bytes), 2 (1), B as 10 (1), 11 (2); then 3 | 12
    flat = [np.array(x, np.int32) for x in ([1, 2, 3], [2, 3, 5], [10, 11, 12], [1, 3, 5], [3, 5])]
    places = pa.ListArray.from_arrays(pa.array([0, 0, 3, 4], pa.int32()), pa.array([0, 1, 0, 1], pa.int32()))
    texts = pa.StructArray.from_arrays([pa.array([7, 8, None], pa.int64()), pa.array([0, 5, 1], pa.int64()), pa.array([0, 5, 1], pa.int64()), places], ["doc_id", "n_a", "n_b", "places"])
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c)) for c in (*flat, texts)]
    rows = align.grouped(pa.RecordBatch.from_arrays(lists, align.COLUMNS), told).to_pylist()
    link = lambda a, b: (a << 32) + b
    first = [link(1, 10), link(1, 11), link(2, 10), link(2, 11)]
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert [tuple(r.values()) for r in rows] == [
        (7, 0, 0, 0, 0, "", []),
        (8, 5, 5, 3, 9, sha("1,2|10,11;3|12;1,2|10,11"), [*first, link(3, 12), *first]),
        (None, 1, 1, 1, 1, sha("3|12"), [link(3, 12)]),
    ]


def test_plan_has_no_lambdas(docs_of):
    plan = align.aligned(docs_of(["a b"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "transform(" not in plan
