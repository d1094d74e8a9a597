"""Language-model scoring by masked pseudo-likelihood.

Each word of a text is predicted from the two words on either side of it, and the
log-probabilities of all words are summed.

Words. Each word of every document is counted. The most frequent ones, ``HEAD`` at
most, are words of the model; each other word belongs to one of ``TAIL`` groups by its
hash and has an even share of its group, by the number of words counted in it. So a
rare or unseen word never stands for a frequent one. Counts go by 32 bits of hash.

Network. The embeddings of the four words around go through one hidden layer, whose
output gives each word of the model a score of its own. The odds of a word against all
others are those of its share of the corpus, times exp(its score) over the mean of
exp(score) of others, taken over words that are drawn evenly from the counted mass (an
importance-sampled softmax). A network of zeros is the unigram model.

Training, in numpy, is on the windows of all words of all documents. Documents are
dealt by a hash to shards of about ``SHARD`` words, so the number of shards grows with
the corpus and depends on nothing else. Each shard starts alike and makes one pass of
row-wise Adagrad. The shards' tables are averaged row by row, weighted by how often
each shard met the row, block by block in a stream, so that no task holds more than a
block and the driver no more than one network (about 18 MB, a fixed bound).

Defined results: null and empty texts have no words and a score of 0. Rows are scored
one by one, repeated ones and null ids alike; a row that is repeated very often is spread
over shards. Without any words the network stays at its start. Empty tables give empty
results. Of other columns none is read. A text may have 500 million words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.llm.common import durable, table
from inkmesh.llm.wordhash import frugal, hash_distinct, split_words

HEAD, TAIL = 1 << 16, 1 << 16
SIDE, WIDTH, HIDDEN = 2, 16, 15
#: Words drawn against a word in training, and for the mean over others in scoring: as many, since the mean is then like those that training has seen.
DRAWN, SEEN = 128, 128
SHARD, MOST_SHARDS = 1 << 22, 1 << 13
BATCH, POOL, STEP = 8192, 1 << 18, 0.05
#: Rows of a table that are averaged at a time, and how often a task meets a row before it goes to other shards.
BLOCK, TWINS = 512, 16


# --- words ---------------------------------------------------------------------------------


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met = Counter()
    for batch in batches:
        distinct, places, counts = split_words(batch.column(1))
        words = (hash_distinct(distinct) >> np.uint64(32)).astype("<u4")[places]
        ends = np.cumsum(counts)
        raw = [words[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        salts = []
        for doc_id, own in zip(batch.column(0).to_pylist(), raw, strict=True):
            salt = xxhash.xxh3_64_intdigest(own, seed=(doc_id or 0) & 0xFFFFFFFFFFFFFFFF)
            met[salt] += 1
            if met[salt] > TWINS:
                salt = xxhash.xxh3_64_intdigest(f"{TaskContext.get().partitionId()} {met[salt]}".encode(), seed=salt)
            salts.append(salt >> 1)
        if len(met) > 1 << 16:
            met.clear()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(salts, pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "salt", "words"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, salt, words`` of each row: 32-bit hashes of its words in order, four bytes each."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(frugal(_encoded), "doc_id bigint, salt bigint, words binary")


def _hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a column ``words``, and how many each row has."""
    raw = words.to_pylist()
    return np.frombuffer(b"".join(raw), "<u4"), np.array([len(x) // 4 for x in raw], np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def counts() -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int32)), pa.array(n)], ["word", "n"])

    for batch in batches:
        held.append(_hashes(batch.column(0))[0])
        n += len(held[-1])
        if n > 8_000_000:
            yield counts()
            held, n = [], 0
    if n:
        yield counts()


@dataclass
class Words:
    """``head``: sorted hashes of the model's words, their counts in ``counts``, behind these the counts of the groups of all others."""

    head: np.ndarray
    counts: np.ndarray
    distinct: np.ndarray  # words of each group

    def __post_init__(self) -> None:
        self.size = len(self.counts)
        self.log_share = np.zeros(self.size, np.float32)
        self.log_share[len(self.head) :] = -np.log(np.maximum(self.distinct, 1))
        self.first = np.searchsorted(self.head, np.arange((1 << 18) + 1, dtype=np.uint64) << np.uint64(14))
        self.most = int(np.diff(self.first).max())

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = (len(self.head) + hashes % TAIL).astype(np.int32)
        at = self.first[hashes >> 14]
        for k in range(self.most):
            place = np.minimum(at + k, len(self.head) - 1)
            hit = self.head[place] == hashes
            out[hit] = place[hit]
        return out


def count(encoded: DataFrame) -> tuple[Words, int]:
    """The words of a corpus, and how many it has in all. To the driver come ``HEAD + TAIL`` rows at most."""
    counts = durable(encoded.select("words").mapInArrow(frugal(_counted), "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    size = F.floor(F.log2("n") * 16)
    sizes = counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("n")).orderBy(F.desc("size")).collect()  # some hundreds
    least, taken = 1 << 30, 0
    for r in sizes:
        if (taken := taken + r.distinct) > HEAD:
            break
        least = r["size"]
    head = counts.where(size >= least).select("word", "n").toArrow().sort_by("word")
    rest = counts.where(size < least).groupBy(F.pmod("word", F.lit(TAIL)).alias("of")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).toArrow()
    words = np.asarray(head["word"].combine_chunks() if head.num_rows else pa.array([], pa.int32())).astype(np.int32).view(np.uint32)
    order, group = np.argsort(words), np.zeros((2, TAIL), np.int64)
    for k, c in enumerate(("n", "distinct")):
        group[k][np.asarray(rest["of"])] = np.asarray(rest[c])
    return Words(words[order], np.concatenate([np.asarray(head["n"])[order], group[0]]), group[1]), sum(r.n for r in sizes)


# --- network -------------------------------------------------------------------------------


class Net:
    """Tables of rows: ``embed`` (its last row is the end of a text), ``out`` (the last column is the bias), ``dense`` (hidden layer, the last row is the bias).

    ``share``: each word's share of all counted words. The odds of a word against all others are those of its share, times
    exp(its score) over the mean of exp(score) of others. A network of zeros is the unigram model.
    """

    NAMES = ("embed", "out", "dense")

    def __init__(self, counts: np.ndarray, seed: int = 7) -> None:
        n, r = len(counts), np.random.default_rng(seed)
        mass = counts + 0.5
        self.until = np.cumsum(mass) / mass.sum()
        self.share = mass / mass.sum()
        self.embed = r.standard_normal((n + 1, WIDTH), np.float32) * np.float32(0.3)
        self.out = np.zeros((n, HIDDEN + 1), np.float32)
        self.dense = np.concatenate([r.standard_normal((2 * SIDE * WIDTH, HIDDEN), np.float32) / 8, np.zeros((1, HIDDEN), np.float32)]).astype(np.float32)

    def tables(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def others(self, n: int, offset: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
        """Words drawn evenly from the counted mass, and how often each is drawn, ``n`` in all."""
        drawn = np.searchsorted(self.until, (np.arange(n) + offset) / n)
        return np.unique(np.minimum(drawn, len(self.until) - 1), return_counts=True)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        """With a column of ones for the bias of words."""
        return np.concatenate([np.tanh(x @ self.dense[:-1] + self.dense[-1]), np.ones((len(x), 1), np.float32)], 1)


class Scorer:
    """A net that gives a window the same bits wherever it stands in a batch.

    A matrix product may sum in another order for other rows of a batch, by the machine's kernels. So what is
    multiplied are whole numbers, multiples of 1/``GRID`` in magnitude bounded, whose sums are exact in any order.
    """

    #: 65 products of two numbers under 8, and 16 of one under 1 and one under 64, in units of 1 / GRID squared, stay under 2 to the 53.
    GRID, MOST, MOST_OUT = float(1 << 20), 8.0, 64.0

    def __init__(self, net: Net) -> None:
        self.net = net
        self.embed, self.dense, self.out = self._whole(net.embed, self.MOST), self._whole(net.dense, self.MOST), self._whole(net.out, self.MOST_OUT)
        self.drawn, self.times = net.others(SEEN)
        rows = net.out[self.drawn].astype(np.float64)
        rows[:, HIDDEN] += np.log(self.times)
        self.rest = np.ascontiguousarray(self._whole(rows, self.MOST_OUT).T)

    def _whole(self, table: np.ndarray, most: float) -> np.ndarray:
        return np.rint(np.clip(table.astype(np.float64), -most, most) * self.GRID)

    def log_probs(self, around: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Log-probability of each word; ``around``: (n, 2 SIDE) context words. The mean over others is that over ``SEEN`` drawn words."""
        unit = self.GRID * self.GRID
        x = self.embed.take(around, axis=0).reshape(len(around), -1)
        hidden = np.rint(np.tanh((x @ self.dense[:-1] + self.dense[-1] * self.GRID) / unit) * self.GRID)
        hidden = np.concatenate([hidden, np.full((len(x), 1), self.GRID)], 1)
        rest = ((hidden @ self.rest) / unit).astype(np.float32)
        np.exp(rest, out=rest)
        place = np.searchsorted(self.drawn, word)
        own = np.flatnonzero(self.drawn[np.minimum(place, len(self.drawn) - 1)] == word)
        rest[own, place[own]] = 0  # a word is not among the others
        n = np.full(len(word), self.times.sum())
        n[own] -= self.times[place[own]]
        share = self.net.share[word]
        score = np.einsum("ij,ij->i", hidden, self.out.take(word, axis=0)) / unit
        mean = np.where(n > 0, rest.sum(1) / np.maximum(n, 1), 1)
        return -np.log1p((1 - share) / share * mean * np.exp(-score))


def weighed(hidden: np.ndarray, rows: np.ndarray, times: np.ndarray) -> np.ndarray:
    """exp(score) of each drawn word in each window, as often as it is drawn."""
    rows = rows.copy()
    rows[:, HIDDEN] += np.log(times)
    out = hidden @ rows.T
    return np.exp(out, out=out)


def summed(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of stretches of rows, which have an even number of columns: two are added at a time, as one complex number."""
    return np.add.reduceat(rows.view(np.complex64), first, axis=0).view(np.float32)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of equal keys side by side, the distinct keys, and where each begins in that order."""
    both = np.sort(keys.astype(np.int64) << 32 | np.arange(len(keys)))
    word = (both >> 32).astype(np.int32)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    return both & 0xFFFFFFFF, word[first], first


class Trainer:
    """Row-wise Adagrad on a net; ``met``: how often each row of each table was used."""

    def __init__(self, net: Net) -> None:
        self.net, self.rng = net, np.random.default_rng(11)
        self.square = [np.zeros(len(t), np.float32) for t in net.tables()]
        self.met = [np.zeros(len(t), np.float32) for t in net.tables()]

    def _step(self, k: int, rows, grad: np.ndarray, n) -> None:  # noqa: ANN001
        """Up the gradient of the log-likelihood at ``rows`` of table k, met ``n`` times."""
        square = self.square[k][rows] + np.einsum("ij,ij->i", grad, grad) / np.float32(grad.shape[1])
        self.square[k][rows] = square
        grad *= (np.float32(STEP) / np.sqrt(square + np.float32(1e-12)))[:, None]
        self.net.tables()[k][rows] += grad
        self.met[k][rows] += n

    def take(self, around: np.ndarray, word: np.ndarray) -> None:
        """One step: each word against ``DRAWN`` words from the counted mass, which all windows share."""
        net, n = self.net, len(word)
        order, words, first = groups(word)
        around, many = around.take(order, axis=0), np.diff(first, append=n)
        x = net.embed.take(around, axis=0).reshape(n, -1)
        hidden = net.hidden(x)
        own = np.repeat(net.out.take(words, axis=0), many, axis=0)
        drawn, times = net.others(DRAWN, self.rng.random())
        table = net.out[drawn]
        score = np.exp(np.einsum("ij,ij->i", hidden, own))
        rest = weighed(hidden, table, times)
        both, at, there = np.intersect1d(words, drawn, assume_unique=True, return_indices=True)
        for i, j in zip(at.tolist(), there.tolist(), strict=True):
            rest[first[i] : first[i] + many[i], j] = 0  # a word is not drawn against itself
        total = score + rest.sum(1)
        miss = ((total - score) / total)[:, None]
        rest *= (-1 / total)[:, None]
        own *= miss
        own += rest @ table
        back = own[:, :HIDDEN] * (1 - hidden[:, :HIDDEN] ** 2)
        self._step(1, words, summed(hidden * miss, first), many)
        self._step(1, drawn, rest.T @ hidden, times)
        dx = (back @ net.dense[:-1].T).reshape(-1, WIDTH)
        self._step(2, slice(None), np.concatenate([x.T @ back, back.sum(0)[None]]), n)
        order, words, first = groups(around.ravel())
        self._step(0, words, summed(dx.take(order, axis=0), first), np.diff(first, append=len(order)))


def windows(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(around, word) of each place of texts that stand in a row."""
    places = np.arange(len(ids)) + SIDE * (1 + np.repeat(np.arange(len(counts)), counts))
    padded = np.full(len(ids) + SIDE * (len(counts) + 1), end, np.int32)
    padded[places] = ids
    return np.stack([padded[places + k] for k in range(-SIDE, SIDE + 1) if k], 1), ids


def _trained(words: Words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, held, n = Trainer(Net(words.counts)), [], 0

        def train(around: np.ndarray, word: np.ndarray) -> None:
            order = trainer.rng.permutation(len(word))
            for i in range(0, len(word), BATCH):
                trainer.take(around[order[i : i + BATCH]], word[order[i : i + BATCH]])

        for batch in batches:
            hashes, counts = _hashes(batch.column(1))
            held.append(windows(words.ids(hashes), counts, words.size))
            n += len(hashes)
            if n >= POOL:  # pools of one size, however the rows come
                around, word = (np.concatenate(x) for x in zip(*held, strict=True))
                for i in range(0, n - POOL + 1, POOL):
                    train(around[i : i + POOL], word[i : i + POOL])
                held, n = [(around[n // POOL * POOL :].copy(), word[n // POOL * POOL :].copy())], n % POOL
        if n:
            train(*(np.concatenate(x) for x in zip(*held, strict=True)))
        part = TaskContext.get().partitionId()
        for k, (own, met) in enumerate(zip(trainer.net.tables(), trainer.met, strict=True)):
            for block in range(0, len(own), BLOCK):
                rows = np.flatnonzero(met[block : block + BLOCK]).astype(np.int32)
                if len(rows):
                    raw = [x.tobytes() for x in (rows, met[block + rows], own[block + rows])]
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (k, block, part)), *(pa.array([x]) for x in raw)], ["table", "block", "part", "rows", "met", "own"])

    return run


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks that come in order, the mean of each row by how often it was met."""
    held = None

    def done() -> pa.RecordBatch:
        (k, block), weight, total = held
        rows = np.flatnonzero(weight)
        out = (total[rows] / weight[rows, None]).astype(np.float32)
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (k, block)), *(pa.array([x]) for x in (rows.astype(np.int32).tobytes(), out.tobytes()))], ["table", "block", "rows", "own"])

    for batch in batches:
        for k, block, _, rows, met, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is None or held[0] != (k, block):
                if held is not None:
                    yield done()
                held = (k, block), np.zeros(BLOCK), np.zeros((BLOCK, len(own) // len(met)))
            rows, met = np.frombuffer(rows, np.int32), np.frombuffer(met, np.float32).astype(np.float64)
            held[1][rows] += met
            held[2][rows] += np.frombuffer(own, np.float32).reshape(len(rows), -1) * met[:, None]
    if held is not None:
        yield done()


@dataclass
class Model:
    words: Words
    tables: list[np.ndarray]

    def net(self) -> Net:
        out = Net(self.words.counts)
        for name, own in zip(Net.NAMES, self.tables, strict=True):
            setattr(out, name, own)
        return out


def fit(encoded: DataFrame) -> Model:
    """A model of all rows of ``encode(docs)``, which should be durable, as it is read twice."""
    words, total = count(encoded)
    shards = min(MOST_SHARDS, -(-total // SHARD) or 1)
    dealt = encoded.select("salt", "words").repartition(shards, "salt").sortWithinPartitions("salt")
    nets = dealt.mapInArrow(frugal(_trained(words)), "table int, block int, part int, rows binary, met binary, own binary")
    means = nets.repartition("table", "block").sortWithinPartitions("table", "block", "part").mapInArrow(frugal(_mean), "table int, block int, rows binary, own binary")
    net = Net(words.counts)
    for r in durable(means).toLocalIterator():  # one network
        own, rows = net.tables()[r["table"]], np.frombuffer(r["rows"], np.int32) + r["block"]
        own[rows] = np.frombuffer(r["own"], np.float32).reshape(len(rows), -1)
    return Model(words, net.tables())


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.net())
        for batch in batches:
            hashes, counts = _hashes(batch.column(1))
            around, own = windows(model.words.ids(hashes), counts, model.words.size)
            each = np.zeros(len(own) + 1)
            for i in range(0, len(own), BATCH):
                w = own[i : i + BATCH]
                each[i : i + len(w)] = scorer.log_probs(around[i : i + BATCH], w) + model.words.log_share[w]
            ends = np.cumsum(counts)
            total = np.where(counts > 0, np.add.reduceat(each, ends - counts), 0.0) if len(counts) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(total, pa.float64())], ["doc_id", "n_words", "log_prob"])

    return run


def score(encoded: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_words, log_prob, mean_log_prob`` for every row of ``encode(docs)``."""
    # The model travels with the function, in a broadcast of fixed size.
    scored = encoded.select("doc_id", "words").mapInArrow(frugal(_scored(model)), "doc_id bigint, n_words bigint, log_prob double")
    return scored.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).otherwise(0.0))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = durable(encode(table(spark, sf_dir, "documents")), 4000)
    return durable(score(encoded, fit(encoded)))  # scored here, so that texts go to workers in small batches
