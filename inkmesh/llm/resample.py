"""Importance resampling towards a target: documents drawn by how their n-grams fit it.

Features of a text are its runs of one and two words. Each falls into one of ``BUCKETS``
by its CRC-32. A bucket's gain says how much commoner it is in the target than in the
corpus, a document weighs the mean gain of its features, and Gumbel noise from its id makes
the highest scores a draw without replacement.

Hashing by suffix arrays. Each portion of a partition becomes word ids, texts parted by an
id of their own. Its suffixes, sorted by their first words, put equal n-grams side by side:
a run of suffixes that share n words with their neighbours (the LCP) is one n-gram. It is
hashed once, from the CRCs of its words, and its bucket is scattered back to all places of
the run. What goes on to counting and scoring are bucket numbers, two bytes for each
feature, so texts are read once.

Ranks come from one range-partitioned order of all scores, numbered range by range.

Defined results: null and empty texts have no features, a weight of 0, and are never drawn
(fewer than 20 words). A null id draws its noise as the word ``null``. Rows are scored and
ranked one by one, repeated ones too: equal scores go by id, rows equal in that as well
stand in any order. Without a benchmark its counts are 0. Empty tables give empty results.
Very long texts are a portion of their own. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.llm.common import LOWER, UPPER, durable, table
from inkmesh.llm.wordhash import frugal, portions, split_words
from inkmesh.operators.shared import placed

BUCKETS, WORDS, LEAST_WORDS, PERCENT = 10_000, 2, 20, 25
#: Bytes of text whose suffixes are sorted together.
PORTION = 8e6

#: Bytes of words as they are, upper case lowered, all others as a space.
_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


# --- CRC-32 of words that are put together -------------------------------------------------


#: Fixed value: the polynomial of CRC-32, its bits reversed.
POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    """What a byte does to the CRC, by the polynomial's rule."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(POLYNOMIAL), out >> 1)
    return out


_CRC = _crc_table()
#: Lengths up to which :data:`_SHIFTS` has what so many bytes more do to each byte of a CRC.
_MOST = 63


def _shifts() -> np.ndarray:
    now = (np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [now]
    for _ in range(_MOST):
        now = (now >> np.uint32(8)) ^ _CRC[now & np.uint32(255)]
        out.append(now)
    return np.stack(out)


_SHIFTS = _shifts()


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of strings put together, from those of their parts and the length of the second."""
    out, left = first.astype(np.uint32), length.astype(np.int64)
    todo = np.flatnonzero(left)
    while len(todo):
        step, c = np.minimum(left[todo], _MOST), out[todo]
        out[todo] = _SHIFTS[step, 0, c & 255] ^ _SHIFTS[step, 1, (c >> 8) & 255] ^ _SHIFTS[step, 2, (c >> 16) & 255] ^ _SHIFTS[step, 3, c >> 24]
        left[todo] -= step
        todo = todo[left[todo] > 0]
    return out ^ second


# --- suffixes ------------------------------------------------------------------------------


def suffix_order(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``ids`` in order of their first ``depth`` ids, and how many ids (``depth`` at most) each shares with the one before it.

    Id 0 parts texts: what follows it is not shared.
    """
    n = len(ids)
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)]).astype(np.int64)
    rank, order, bits, of_id = padded[:n], np.arange(n), n.bit_length(), int(ids.max(initial=0)).bit_length()
    for k in range(depth):
        key = rank if k == 0 else rank << of_id | padded[k : k + n]
        if int(key.max(initial=0)).bit_length() + bits <= 63:
            both = np.sort(key << bits | np.arange(n))
            order, key = both & ((1 << bits) - 1), both >> bits
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        if k < depth - 1:  # dense, so that the next id fits beside it
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.diff(key, prepend=key[:1]) != 0) if n else key
    lcp, same = np.zeros(n, np.int8), np.ones(max(n - 1, 0), bool)
    for k in range(depth):
        a, b = padded[order[1:] + k], padded[order[:-1] + k]
        same = same & (a == b) & (a != 0)
        lcp[1:] += same
    return order, lcp


def gram_buckets(distinct: list[bytes], ids: np.ndarray, n: int = WORDS, buckets: int = BUCKETS) -> list[np.ndarray]:
    """For each length from 1 to ``n`` the bucket of the n-gram at each place of ``ids`` (0: end of a text, else 1 + place in ``distinct``), -1 where it would cross an end."""
    order, lcp = suffix_order(ids, n)
    crcs = np.array([0, *map(zlib.crc32, distinct)], np.uint32)
    sizes = np.array([0, *map(len, distinct)], np.int64)
    padded = np.concatenate([ids, np.zeros(n, ids.dtype)])
    inside, out = np.ones(len(ids), bool), []
    gram = crc = None
    for k in range(n):
        own = padded[order + k]  # the word that each suffix has at this place
        inside &= own != 0
        first = np.flatnonzero((lcp <= k) & inside)  # a run of this length begins where less is shared
        word = own[first]
        if gram is None:
            crc = crcs[word]
        else:
            of = gram[first]
            crc = joined_crc(joined_crc(crc[of], np.uint32(zlib.crc32(b" ")), np.ones(len(of), np.int64)), crcs[word], sizes[word])
        # the run of each suffix, in their order
        begins = np.zeros(len(ids), np.int64)
        begins[first] = 1
        gram = np.cumsum(begins) - 1
        found = np.full(len(ids), -1, np.int32)
        places = order[inside]
        found[places] = (crc % np.uint32(buckets)).astype(np.int32)[gram[inside]]
        out.append(found)
    return out


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, 1, PORTION):
        texts = pc.fill_null(batch.column(1), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = bytes(memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]).translate(_BYTES)
        plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(raw))
        distinct, places, counts = split_words(plain)
        ends = np.cumsum(counts + 1) - 1
        ids = np.zeros(len(places) + len(counts), np.int64)
        inside = np.ones(len(ids), bool)
        inside[ends] = False
        ids[inside] = places + 1
        found = np.stack(gram_buckets(distinct.cast(pa.binary()).to_pylist(), ids), 1)
        of = np.repeat(np.arange(len(counts)), counts + 1)
        has = found >= 0
        flat, n = found[has].astype("<u2").tobytes(), np.bincount(of, has.sum(1), len(counts)).astype(np.int64)
        stops = np.cumsum(n) * 2
        rows = [flat[e - 2 * k : e] for e, k in zip(stops.tolist(), n.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "n_words", "buckets"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, buckets`` of each row: the buckets of its features, two bytes each."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(frugal(_bucketed), "doc_id bigint, n_words bigint, buckets binary")


# --- counts, gains, scores -----------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=BUCKETS)
    own = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["bucket", "n"])


def bucket_counts(found: DataFrame) -> np.ndarray:
    """How many features of all rows each bucket holds: ``BUCKETS`` numbers."""
    out = np.zeros(BUCKETS, np.int64)
    for r in found.select("buckets").mapInArrow(_counted, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket in thousandths, rounded down."""
    every, wanted = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * every / ((s + 1.0) * wanted))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(gain: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            n = np.array([len(x) // 2 for x in raw], np.int64)
            each = np.concatenate([gain[np.frombuffer(b"".join(raw), "<u2")], [0]])
            ends = np.cumsum(n)
            total = np.where(n > 0, np.add.reduceat(each, ends - n), 0) if len(n) else n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def scores(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of each row of ``features``."""
    weighed = found.mapInArrow(_weighed(gain), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    digits = F.substring(F.sha2(F.concat(F.lit("7:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")
    return weighed.withColumn("score", F.col("weight") + noise)


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds ``rank``: of rows with words enough, the best ``percent`` by score; null for all others."""
    enough = F.col("n_words") >= least_words
    n = scored.where(enough).count()
    in_order = placed(scored, [(~enough).alias("few"), F.desc("score"), F.asc("doc_id"), "n_features", "weight"])
    return in_order.withColumn("rank", F.when(F.col("place") < n * percent // 100, F.col("place") + 1)).drop("place")


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for each row of ``docs(doc_id, text)``; ``target(text)``."""
    found = durable(features(docs))
    wanted = features(target.select(F.lit(0).alias("doc_id"), "text"))
    return drawn(durable(scores(found, gains(bucket_counts(found), bucket_counts(wanted)))))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _crc_sql(text: str) -> str:
    """CRC-32 of a string: a fold over its bytes; what a byte does is the exclusive or of what its bits do."""
    byte = "xor(c, b) & 255"
    bits = "0"
    for k in range(8):
        bits = f"xor({bits}, ((({byte}) >> {k}) & 1) * {int(_CRC[1 << k])})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * strlen({text}), 2), lambda i: ('0x' || hex(encode({text}))[i:i + 1])::BIGINT)), lambda c, b: xor(c >> 8, {bits})), 4294967295)"


OP11_SQL = f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
w AS (SELECT r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w, false AS wanted FROM rows
      UNION ALL SELECT NULL, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), true FROM benchmark),
f AS (SELECT r, wanted, unnest(w) AS f FROM w UNION ALL
      SELECT r, wanted, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
n AS (SELECT r, wanted, f, count(*) AS n FROM f GROUP BY ALL),
d AS (SELECT f, {_crc_sql("f")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT f FROM n)),
b AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE NOT wanted), 0)::BIGINT AS s, coalesce(sum(n) FILTER (WHERE wanted), 0)::BIGINT AS t FROM n JOIN d USING (f) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM b) + {BUCKETS}))::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM b) + {BUCKETS}))::DOUBLE))::BIGINT AS gain FROM b),
p AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM n JOIN d USING (f) JOIN g USING (bucket) WHERE NOT wanted GROUP BY r),
q AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
      coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM rows JOIN w USING (r) LEFT JOIN p USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features, weight) AS rank FROM q WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_words::BIGINT AS n_words, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM k) * {PERCENT} // 100 THEN rank END AS rank FROM q LEFT JOIN k USING (r)
"""
