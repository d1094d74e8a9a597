"""Quality by the votes of labelled neighbours in a latent-semantic space.

Features. A text's words go without the marks at their end into ``BUCKETS`` by hash; so do
these marks, the shape of each word (capitals, letters, digits, marks), and a few for the
text: its length, its lines, how many words are distinct, how many follow themselves. A feature's weight is
16 (1 + log2 of its count), ``OF_TEXT`` for those of a text, times its inverse document frequency over all documents.

Space. Labelled documents, ``MOST`` of each class at most, make a matrix whose leading right
singular vectors (subspace iteration in numpy) map features to ``WIDTH`` numbers. This fit
alone is on a bounded sample; document frequencies are over all documents, and every
document is mapped and judged.

Votes. The labelled vectors are broadcast (some MB, a fixed bound). Cosines of a block of
documents with all of them are one matrix product; the ``NEIGHBOURS`` nearest vote with the
fourth power of their cosine.

A score is the same in any batch and on any machine with the same fit: maps and vectors are
whole numbers so small that every sum is exact in floating point, in any order. Equal cosines
go by the order of the labelled rows.

Defined results: null and empty texts have the features of their length alone and are scored
by them. Rows are scored one by one, repeated ones alike; ``held_out`` of a null id is that of
the word ``null``. An id labelled several times votes with the mean, and with each row of its
id; null labels are none. A text without a neighbour of a cosine above 0 gets the mean label;
without labels that is 0.5. Empty tables give empty results. A text may be as long as memory
holds; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.llm.common import durable, table
from inkmesh.llm.wordhash import frugal, hash_distinct, portions

BUCKETS, WIDTH, NEIGHBOURS = 1 << 15, 48, 25
#: Labelled documents of each class that are fitted: the bound of the sample.
MOST = 2048
FOLDS, THRESHOLD = 5, 0.3
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Whole numbers up to these stand for a map's entries and for the entries of a vector of length 1.
MAP_SCALE, UNIT = 1 << 15, 1 << 11
#: Weight of the features of a text as a whole.
OF_TEXT = 255
#: Documents whose cosines are taken at a time, and bytes of text whose features are.
BLOCK, PORTION = 512, 4e6
#: Features that are mapped at a time, some 800 bytes each while they are.
ENTRIES = 1 << 16
#: Kinds of features, so that the same string of two kinds is two features; the last are those of a text.
WORD, MARK, SHAPE, LENGTH, DISTINCT, LINES, AGAIN = (np.uint64(k) for k in range(1, 8))


# --- features ------------------------------------------------------------------------------


def _bucket(hashes: np.ndarray, kind: np.uint64) -> np.ndarray:
    x = (hashes ^ (kind << np.uint64(56))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - 15)).astype(np.int64)


def _steps(x: np.ndarray, per_octave: int) -> np.ndarray:
    """Sizes in steps of a fraction of an octave."""
    return np.floor(np.log2(np.maximum(x, 0.5)) * per_octave + 64).astype(np.uint64)


def shapes(words: pa.Array) -> pa.Array:
    """Runs of capitals, letters, digits and other marks as one character each."""
    for pattern, by in (("[A-Z]+", "A"), ("[a-z]+", "a"), ("[0-9]+", "0"), ("[^\\x00-\\x7f]+", "u")):
        words = pc.replace_substring_regex(words, pattern, by)
    return words


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, 1, PORTION):
        texts = pc.fill_null(batch.column(1), "")
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        distinct, places, counts = words.dictionary, np.asarray(words.indices), np.diff(np.asarray(lists.offsets))
        core = pc.utf8_rtrim(distinct, MARKS)
        marks = pa.array([w[len(c) :] for w, c in zip(distinct.to_pylist(), core.to_pylist(), strict=True)], pa.string())
        per_word = [_bucket(hash_distinct(x), kind) for x, kind in ((core, WORD), (marks, MARK), (shapes(distinct), SHAPE))]
        full = [np.asarray(pc.binary_length(x)) > 0 for x in (core, marks, distinct)]
        text = np.repeat(np.arange(len(counts)), counts)
        keys = [(text << 16 | b[places])[f[places]] for b, f in zip(per_word, full, strict=True)]
        # for a text: how many of its words are distinct, how many follow themselves, words and lines
        own = np.unique(text << 32 | places)
        n_distinct = np.bincount(own >> 32, minlength=len(counts))
        again = np.bincount(text[1:][(text[1:] == text[:-1]) & (places[1:] == places[:-1])], minlength=len(counts))
        of_text, n_lines = [], np.asarray(pc.count_substring(texts, "\n"), np.int64) + 1
        for kind, size in ((LENGTH, _steps(counts, 1)), (DISTINCT, _steps((n_distinct + 1) / (counts + 1), 3)), (LINES, _steps((counts + 1) / n_lines, 1)), (AGAIN, _steps((again + 0.02 * counts + 0.1) / (counts + 1), 1))):
            of_text.append(np.arange(len(counts)) << 16 | _bucket(size, kind))
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        weight = np.minimum(np.rint(16 * (1 + np.log2(n))), 255).astype(np.uint8)
        key, weight = np.concatenate([key, *of_text]), np.concatenate([weight, np.full(len(of_text) * len(counts), OF_TEXT, np.uint8)])
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        bucket, ends = (key & 0xFFFF).astype("<u2"), np.searchsorted(key, (np.arange(len(counts)) + 1) << 16)
        begins = np.concatenate([[0], ends[:-1]])
        rows = [[x[b:e].tobytes() for b, e in zip(begins.tolist(), ends.tolist(), strict=True)] for x in (bucket, weight)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, pa.binary()) for r in rows)], ["doc_id", "buckets", "weights"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, buckets, weights`` of each row: its features in order, two bytes each, and their weights, one byte each."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(frugal(_featured), "doc_id bigint, buckets binary, weights binary")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=BUCKETS)
    own = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["bucket", "n"])


def rarity(found: DataFrame) -> np.ndarray:
    """The inverse document frequency of each bucket over all rows of ``features``: ``BUCKETS`` numbers."""
    n = np.zeros(BUCKETS, np.int64)
    for r in found.select("buckets").mapInArrow(_held, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        n[r.bucket] = r.n
    return np.log((found.count() + 1) / (n + 1)) + 0.05


# --- fit -----------------------------------------------------------------------------------


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % folds


def examples(found: DataFrame, labels: DataFrame, most: int = MOST) -> list[tuple]:
    """``label in thousandths, buckets, weights`` of labelled rows outside the fold held out, ``most`` of each class by the least hash of their id."""
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(fold(F.col("doc_id")) != 0)
    own = own.groupBy("doc_id").agg(F.round(F.avg("quality") * 1000).cast("int").alias("label"))
    known = own.join(found.select("doc_id").distinct(), "doc_id")
    chosen = None
    for good in (True, False):
        part = known.where((F.col("label") >= 500) == F.lit(good)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    rows = found.join(F.broadcast(durable(chosen)), "doc_id")  # 2 most rows at most
    rows = rows.groupBy("doc_id", "buckets", "weights").agg(F.first("label").alias("label"))  # equal rows vote once
    return [tuple(r) for r in rows.orderBy(F.xxhash64("doc_id", "buckets"), "doc_id").limit(2 * most).select("label", "buckets", "weights").collect()]


def sparse(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and weights of all rows, and where each row begins."""
    sizes = np.array([len(w) for _, w in rows], np.int64)
    return np.frombuffer(b"".join(b for b, _ in rows), "<u2"), np.frombuffer(b"".join(w for _, w in rows), np.uint8), np.cumsum(sizes) - sizes


def latent_map(rows: list[tuple[bytes, bytes]], idf: np.ndarray, width: int = WIDTH, rounds: int = 6) -> np.ndarray:
    """(BUCKETS, width): the leading right singular vectors of the rows' weights, times each feature's rarity, as whole numbers."""
    bucket, weight, first = sparse(rows)
    sizes = np.diff(np.append(first, len(bucket)))
    value = weight * idf[bucket]
    value /= np.repeat(np.sqrt(np.maximum(np.add.reduceat(value**2, first), 1e-30)), sizes)
    right = np.random.default_rng(3).standard_normal((BUCKETS, width))
    step = ENTRIES

    def times(m: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), m.shape[1]))
        for i in range(0, len(bucket), step):
            part = slice(i, i + step)
            of = np.repeat(np.arange(len(rows)), sizes)[part]
            begin = np.flatnonzero(np.diff(of, prepend=-1))
            out[of[begin]] += np.add.reduceat(m[bucket[part]] * value[part, None], begin, axis=0)
        return out

    order = np.argsort(bucket, kind="stable")
    row_of = np.repeat(np.arange(len(rows)), sizes)[order]

    def back(m: np.ndarray) -> np.ndarray:
        out = np.zeros((BUCKETS, m.shape[1]))
        for i in range(0, len(order), step):
            part = order[i : i + step]
            begin = np.flatnonzero(np.diff(bucket[part].astype(np.int64), prepend=-1))
            out[bucket[part][begin]] += np.add.reduceat(m[row_of[i : i + step]] * value[part, None], begin, axis=0)
        return out

    for _ in range(rounds):
        left, _ = np.linalg.qr(times(right))
        right, _ = np.linalg.qr(back(left))
    own = right * idf[:, None]
    return np.rint(own * (MAP_SCALE / max(np.abs(own).max(), 1e-30))).astype(np.int32)


def vectors(rows: list[tuple[bytes, bytes]], mapped: np.ndarray) -> np.ndarray:
    """Unit vectors of rows, as whole numbers up to ``UNIT`` in magnitude. Every sum is one of whole numbers under 2 to the 53, so exact."""
    bucket, weight, first = sparse(rows)
    out = np.zeros((len(rows), mapped.shape[1]))
    ends, i = np.append(first[1:], len(bucket)), 0
    while i < len(rows):  # each row has the features of its length; a row has BUCKETS at most
        j = max(i + 1, int(np.searchsorted(ends, first[i] + ENTRIES, "right")))
        part = slice(first[i], ends[j - 1])
        out[i:j] = np.add.reduceat(mapped[bucket[part]].astype(np.float64) * weight[part, None], first[i:j] - first[i], axis=0)
        i = j
    most = np.abs(out).max(1, initial=0)
    whole = np.rint(out * ((1 << 20) / np.maximum(most, 1))[:, None])
    norm = np.sqrt((whole * whole).sum(1))
    return np.rint(whole / np.maximum(norm, 1)[:, None] * UNIT).astype(np.float32)


class Voters:
    """What goes to every task: the map of features, vectors of labelled rows, and their labels in thousandths."""

    def __init__(self, rows: list[tuple], idf: np.ndarray, neighbours: int = NEIGHBOURS) -> None:
        self.labels = np.array([r[0] for r in rows], np.int64)
        self.mean = float(self.labels.mean()) / 1000 if rows else 0.5
        own = [r[1:] for r in rows]
        self.map = latent_map(own, idf).astype(np.int32) if rows else np.zeros((BUCKETS, 1), np.int32)
        self.vectors = vectors(own, self.map)
        self.neighbours = min(neighbours, len(rows))

    def scores(self, rows: list[tuple[bytes, bytes]]) -> np.ndarray:
        if not self.neighbours:
            return np.full(len(rows), self.mean)
        cosines = (vectors(rows, self.map) @ self.vectors.T).astype(np.int64)  # whole numbers up to UNIT squared, exact
        n = len(self.labels)
        keys = cosines * n + np.arange(n - 1, -1, -1)  # equal cosines by the order of rows
        nearest = np.partition(keys, n - self.neighbours, axis=1)[:, n - self.neighbours :]
        cosine, place = nearest // n, n - 1 - nearest % n
        vote = (np.maximum(cosine, 0) >> 12) ** 4  # 1,024 at most, so 2 to the 40
        total = vote.sum(1)
        return np.where(total > 0, (vote * self.labels[place]).sum(1) / np.maximum(total * 1000, 1), self.mean)


def _scored(voters: Voters):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), BLOCK):
                part = batch.slice(i, BLOCK)
                rows = list(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(voters.scores(rows))], ["doc_id", "score"])

    return run


def judged(found: DataFrame, voters: Voters, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``features``."""
    scored = found.mapInArrow(_scored(voters), "doc_id bigint, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    found = durable(features(docs))
    return judged(found, Voters(examples(found, labels, most), rarity(found)))


def op13_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
