"""A window has the same bits in any batch, under each kernel of the matrix library."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

CODE = """
import numpy as np
from inkmesh.llm import lm
r = np.random.default_rng(5)
net = lm.Net(r.integers(1, 50, 400))
net.out[:] = r.standard_normal(net.out.shape) / 3
net.embed *= 3
scorer = lm.Scorer(net)
around, word = r.integers(0, 401, (3000, 2 * lm.SIDE)), r.integers(0, 400, 3000)
whole = scorer.log_probs(around, word)
for begin, end in ((0, 1), (1, 2), (3, 20), (7, 2999), (2047, 2048), (1500, 3000)):
    assert (scorer.log_probs(around[begin:end], word[begin:end]) == whole[begin:end]).all(), (begin, end)
order = r.permutation(3000)
assert (scorer.log_probs(around[order], word[order]) == whole[order]).all() and np.isfinite(whole).all() and (whole < 0).all()
print(whole.sum().hex())
"""


@pytest.mark.parametrize("kernel", ["", "Haswell", "Zen", "SkylakeX", "Sandybridge"])
def test_bits_do_not_depend_on_the_batch(kernel):
    env = os.environ | ({"OPENBLAS_CORETYPE": kernel} if kernel else {}) | {"PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr
