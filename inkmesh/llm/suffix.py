"""Suffix-array dedup over sparse suffixes.

A passage is a run of ``LENGTH`` words (A-Z lower-cased, split at ASCII white space).
Each run is found that a document shares with one of a lesser id, or that its own text
has before, at least ``LENGTH`` words earlier. Steps:

1. A run of ``LENGTH`` words has its least hash of ``GRAM`` words at one place (the
   first, if several); these minimiser places, one in about 22, depend on the words
   alone, so equal runs have theirs at the same offset. Suffixes are kept at them.
2. Suffixes whose first gram occurs in one document only are let go; the rest carry
   the words to their right and left that runs over that place can use.
3. The suffixes are dealt out by first gram, a gram with very many of them to several
   tasks, and sorted there. A suffix shares with no other more words to the right than
   with a neighbour; those that share too few for any run are let go. The others are
   sorted by the words to their left, and neighbours compared again: words in common
   to the left, extended by those to the right. Equal runs of neighbours form a chain,
   of which the least id is kept in view and all others are marked. Runs that would
   need more words on a side than a neighbour shares are let go (not where a gram was
   dealt to several tasks).
   A run that one text holds twice has its minimiser's gram twice there, so texts of
   which no such gram comes again need no look at themselves.
4. What chains cannot tell (equal runs apart in the order, or in two tasks) is
   settled by the chains' least members alone, grouped by the run's hash.

A chain holds constant memory, so a passage in a third of all documents takes no
more than any other.

Defined results: null and empty texts, those under ``LENGTH`` words and rows of a null
id hold no passage. Rows that repeat an id are one document, never copies of each
other. What a text repeats at less than ``LENGTH`` words' distance overlaps with its first
place and is left. Extra columns are not read by
``spans``; ``cut`` holds them in a struct. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.llm.common import dealt_join, durable, release, table
from inkmesh.llm.wordhash import frugal, hash_distinct, mix, portions, runs, split_words, word_list

LENGTH, GRAM = 50, 8
#: Suffixes of one gram that go to one task at least; beyond it, and an even share of all, they are dealt out by id.
HEAP = 200
WINDOW = LENGTH - GRAM + 1  # grams of a run


def minimisers(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, their gram hashes, and the first and last start of the runs that have their minimiser there; ``hashes``: of the words."""
    if len(hashes) < LENGTH:
        none = np.empty(0, np.int64)
        return none, none.view(np.uint64), none, none
    grams = runs(hashes, GRAM)
    # the place in the low bits: the least value also says where, and the first of equals
    bits = np.uint64(max(1, len(grams)).bit_length())
    value = (mix(grams) >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        value = np.minimum(value[:-width], value[width:])
        width *= 2
    rest = WINDOW - width
    if rest:
        value = np.minimum(value[:-rest], value[rest:])
    least = (value & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
    return least[first], grams[least[first]], first, np.concatenate([first[1:], [len(least)]]) - 1


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minimisers' grams of each text, at how many places each is, and the starts of its runs that it has before, clear of them."""
    for batch in portions(batches, 1, 8e6):
        distinct, places, counts = split_words(batch.column(1))
        hashes = hash_distinct(distinct)[places]
        found, sizes, again, end = [], [], [], 0
        for n in counts.tolist():
            end += n
            grams = np.sort(minimisers(hashes[end - n : end])[1])
            first = np.flatnonzero(np.diff(grams, prepend=~grams[:1]))
            found.append(grams[first].view(np.int64))
            sizes.append(np.diff(first, append=len(grams)).astype(np.int32))
            again.append(repeats(places[end - n : end], hashes[end - n : end]) if len(first) < len(grams) else np.empty(0, np.int32))
        lists = []
        for values, kind in ((found, np.int64), (sizes, np.int32), (again, np.int32)):
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.empty(0, kind)]))))
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["key", "grams", "sizes", "again"])


def repeats(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Starts of the runs of a text that stand in it before, at least ``LENGTH`` words earlier; ``words``: a number for each word."""
    every = runs(hashes, LENGTH)
    order = np.argsort(every, kind="stable")
    first = np.flatnonzero(np.diff(every[order], prepend=~every[order[:1]]))
    earliest = np.empty(len(every), np.int64)
    earliest[order] = np.repeat(order[first], np.diff(first, append=len(every)))
    start = np.flatnonzero(np.arange(len(every)) - earliest >= LENGTH)
    return np.array([i for i in start.tolist() if (words[i : i + LENGTH] == words[(k := earliest[i]) : k + LENGTH]).all()], np.int32)


KEY = "struct<id:bigint,text:bigint>"
_SUFFIX = pa.schema([("gram", pa.int64()), ("heap", pa.int32()), ("split", pa.bool_()), ("suffix", pa.binary()), ("id", pa.int64()), ("text", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("before", pa.binary())])
SUFFIX = "gram bigint, heap int, split boolean, suffix binary, id bigint, text bigint, at int, low int, high int, before binary"


def _reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes in order, those that share enough to the right with a neighbour; ``low`` becomes the least offset that this allows."""
    last = None  # the row before: its batch, place, key, suffix, words in common with the one before it

    def reach(row: tuple, common: int) -> int:
        return LENGTH if row[2].column(2)[row[3]].as_py() else max(row[4], common)

    def chosen(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for batch in {id(r[2]): r[2] for r, _ in rows}.values():
            own = [(r[3], low) for r, low in rows if r[2] is batch]
            out = batch.take(pa.array([i for i, _ in own], pa.int64()))
            yield out.set_column(7, "low", pa.array([low for _, low in own], pa.int32()))

    for batch in batches:
        rows = []
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)
        for i, (gram, heap, suffix) in enumerate(keys):
            key = (gram, heap)
            common = _common(last[1], suffix) if last and last[0] == key else 0
            if last:
                rows.append((last, reach(last, common)))
            last = (key, suffix, batch, i, common)
        lows = [(r, max(r[2].column(7)[r[3]].as_py(), LENGTH - most)) for r, most in rows]
        yield from chosen([(r, low) for r, low in lows if low <= r[2].column(8)[r[3]].as_py()])
    if last:
        low = max(last[2].column(7)[last[3]].as_py(), LENGTH - reach(last, 0))
        if low <= last[2].column(8)[last[3]].as_py():
            yield from chosen([(last, low)])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``low`` and ``high``: the least and greatest offset of the place in runs that have it as minimiser."""
    for batch in batches:
        out, size = [], 0
        for key, text, wanted in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            key, words, heaps = key.as_py(), word_list(text.as_py().encode()), {w["gram"]: w["heaps"] for w in wanted.as_py()}
            places, grams, first, last = minimisers(hash_distinct(pa.array(words, pa.binary())))
            for p, gram, low, high in zip(places.tolist(), grams.view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True):
                if n := heaps.get(gram):  # a text may hold a gram at very many places, so the place tells the heap too
                    right = b" ".join(words[p : high + LENGTH]) + b" "
                    left = b"".join([w + b" " for w in words[low:p][::-1]])
                    out.append((gram, (key["id"] + p * 0x9E3779B1 >> 4) % n, n > 1, right, key["id"], key["text"], p, p - high, p - low, left))
                    size += len(right) + len(left)
            if size > 8_000_000:
                yield _batch(out, _SUFFIX)
                out, size = [], 0
        if out:
            yield _batch(out, _SUFFIX)


def _common(a: bytes, b: bytes) -> int:
    """Words in common at the start; each word ends in a space."""
    if a == b:
        return a.count(b" ")
    low, high = 0, min(len(a), len(b))  # a and b agree in the first ``low`` bytes
    while low < high:
        half = (low + high + 1) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half - 1
    return a.count(b" ", 0, low)


class _Suffix:
    __slots__ = ("gram", "split", "right", "id", "text", "at", "low", "high", "left", "words")

    def __init__(self, gram, heap, split, right, doc, text, at, low, high, left) -> None:  # noqa: ANN001
        self.gram, self.split, self.right, self.id, self.text, self.at, self.low, self.high, self.left, self.words = (gram, heap), split, right, doc, text, at, low, high, left, None

    def run_hash(self, offset: int) -> bytes:
        """Of the run in which the place has this offset."""
        if self.words is None:
            self.words = self.left.split()[::-1] + self.right.split()
        start = len(self.words) - self.right.count(b" ") - offset
        return xxhash.xxh3_128_digest(b" ".join(self.words[start : start + LENGTH]))


class _Chain:
    """Equal runs of suffixes that follow each other: the least id and its (text, start)s; ``whole`` while no other suffix can have the run."""

    __slots__ = ("least", "places", "of", "offset", "whole", "named", "_hash")

    def __init__(self, x: _Suffix, offset: int, whole: bool) -> None:
        self.least, self.places, self.of, self.offset, self.whole, self.named, self._hash = x.id, [(x.text, x.at - offset)], x, offset, whole, False, None

    @property
    def hash(self) -> bytes:
        if self._hash is None:
            self._hash = self.of.run_hash(self.offset)
        return self._hash


class _Chains:
    """Walks over suffixes sorted by what is to their left, one at a time; for each offset there is a chain of equal runs.

    Suffixes that share the words of a run to the left of its place stand together. A
    chain that takes up the whole of such a stretch is all there is of its run, and its
    least member needs no more judging.

    Rows out: (id, text, first start, last start, hash, open). An open row is a chain's
    least member: others of the same run may have a lesser one, or marks name its hash.
    """

    def __init__(self) -> None:
        self.chains: dict[int, _Chain] = {}
        self.span = self.least = None  # first and last offset, if there is a chain at each between; no chain's least id is above
        self.rows: list[tuple] = []

    def end(self, offsets: list[int], left: int = -1) -> None:
        for offset in offsets:
            c = self.chains.pop(offset)
            if c.named or not c.whole or left >= offset:
                self.rows += [(c.least, text, start, start, c.hash, True) for text, start in c.places]

    def mark(self, x: _Suffix, low: int, high: int) -> None:
        c = self.chains[high]
        c.named = True
        self.rows.append((x.id, x.text, x.at - high, x.at - low, c.hash, False))

    def take(self, x: _Suffix, right: int, left: int, reach: int) -> None:
        """``right``, ``left``: words in common with the suffix before; ``reach``: the most to the left that it shares with a neighbour."""
        low, high = max(x.low, LENGTH - right), min(x.high, left)
        most = min(x.high, reach)
        if self.span == (low, high) and low == x.low and high == most and x.id > self.least:
            self.mark(x, low, high)  # every run goes on with a greater id
            return
        if self.chains:
            self.end([o for o in self.chains if not low <= o <= high], left)
        start = None
        for offset in range(low, high + 1):
            c = self.chains.get(offset)
            if c is not None and x.id > c.least:
                start = offset if start is None else start
                continue
            if start is not None:
                self.mark(x, start, offset - 1)
                start = None
            if c is None:
                continue
            place = (x.text, x.at - offset)
            if x.id < c.least:
                self.rows += [(c.least, text, at, at, c.hash, False) for text, at in c.places]
                c.least, c.places, c.named = x.id, [place], True
            elif place not in c.places:
                c.places.append(place)
        if start is not None:
            self.mark(x, start, high)
        for offset in range(x.low, most + 1):
            if offset not in self.chains:
                self.chains[offset] = _Chain(x, offset, left < offset and not x.split)
        if self.chains:
            first, last = min(self.chains), max(self.chains)
            self.span = (first, last) if len(self.chains) == last - first + 1 else None
            self.least = max(c.least for c in self.chains.values())
        else:
            self.span = None


_RUNS = pa.schema([("id", pa.int64()), ("text", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("run", pa.binary()), ("open", pa.bool_())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk, held, right, left, common = _Chains(), None, 0, 0, 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = _Suffix(*row)
            together = held is not None and x.gram == held.gram
            common = _common(held.left, x.left) if together else -1
            if held is not None:
                walk.take(held, right, left, LENGTH if held.split else max(left, common))
            right, left, held = _common(held.right, x.right) if together else 0, common, x
        if len(walk.rows) > 20_000:
            yield _batch(walk.rows, _RUNS)
            walk.rows = []
    if held is not None:
        walk.take(held, right, left, LENGTH if held.split else left)
        walk.end(list(walk.chains))
        if walk.rows:
            yield _batch(walk.rows, _RUNS)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key(id, text), spans[(start, n_words, first_id)]`` of documents with runs seen in one of a lesser id, or before in the same text.

    ``key.text`` is a hash that tells apart texts of one id; starts count words from 0;
    ``first_id`` is the least id that has the first run of the span.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text")).alias("key"), F.col(text_col).cast("string").alias("body"))
    places = durable(rows.mapInArrow(frugal(_grams), f"key {KEY}, grams array<bigint>, sizes array<int>, again array<int>").where(F.size("grams") > 0), 4000)
    each = places.select("key", F.explode(F.arrays_zip("grams", "sizes")).alias("g")).select("key", F.col("g.grams").alias("gram"), F.col("g.sizes").alias("size"))
    several = each.groupBy("gram").agg(F.min("key.id").alias("first"), F.max("key.id").alias("last"), F.sum("size").alias("n")).where("first < last")
    several = durable(several.select("gram", "n"))
    total = several.agg(F.sum("n")).first()[0] or 0
    share = max(HEAP, total // int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    several = several.select("gram", F.ceil(F.col("n") / share).cast("int").alias("heaps"))
    wanted = each.join(several, "gram").groupBy("key").agg(F.collect_set(F.struct("gram", "heaps")).alias("grams"))
    found = rows.join(wanted, "key").mapInArrow(frugal(_suffixes), SUFFIX)
    by_right = found.repartition("gram", "heap").sortWithinPartitions("gram", "heap", "suffix")
    # dealt out again, though to the same tasks: what is left is little, and no task has two Python workers at a time
    by_left = by_right.mapInArrow(frugal(_reaching), SUFFIX).repartition("gram", "heap").sortWithinPartitions("gram", "heap", "before", "suffix", "id", "text", "at")
    compared = durable(by_left.mapInArrow(frugal(_compare), "id bigint, text bigint, low int, high int, run binary, open boolean"))
    release(docs.sparkSession)
    # The first holder of a run: a run that very many hold is dealt to several tasks. Repeated rows give the same hits.
    least = compared.where("open").groupBy("run").agg(F.min("id").alias("first_id"))
    hit = dealt_join(compared, least, ["run"], ["id", "text", "low"]).where("id > first_id").select("id", "text", "low", "high", "first_id")
    own = places.select("key.id", "key.text", F.explode("again").alias("low")).select("id", "text", "low", F.col("low").alias("high"), F.col("id").alias("first_id"))
    hit = durable(hit.union(own).distinct())
    per_text = hit.groupBy(F.struct("id", "text").alias("key")).agg(F.sort_array(F.collect_list(F.struct("low", "first_id", "high"))).alias("hits"))

    def merge(acc, x):
        last = F.element_at(acc, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["high"] + LENGTH).alias("end"), last["first_id"].alias("first_id"))
        own = F.struct(x["low"].alias("start"), (x["high"] + LENGTH).alias("end"), x["first_id"].alias("first_id"))
        return F.when((F.size(acc) > 0) & (x["low"] <= F.try_element_at(acc, F.lit(-1))["end"]), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(acc, F.array(own)))

    merged = F.aggregate("hits", F.array().cast("array<struct<start:int,end:int,first_id:bigint>>"), merge)
    return per_text.select("key", F.transform(merged, lambda s: F.struct(s["start"].alias("start"), (s["end"] - s["start"]).alias("n_words"), s["first_id"].alias("first_id"))).alias("spans"))


_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def _cut(texts, all_spans):
    import pandas as pd

    out = []
    for text, found in zip(texts, all_spans, strict=True):
        if text is None or found is None or len(found) == 0:
            out.append(text)
            continue
        raw = text.encode()
        at = [m.span() for m in _WORD.finditer(raw)]
        kept, last = [], 0
        for s in found:
            kept.append(raw[last : at[s["start"]][0]])
            last = at[s["start"] + s["n_words"] - 1][1]
        rest = b"".join([*kept, raw[last:]]).strip(b" \t\n\x0b\x0c\r")
        out.append(rest.decode())
    return pd.Series(out, dtype=object)


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without the repeated passages; a text of which nothing is left goes. Columns stay as they are."""
    found = durable(spans(docs, id_col, text_col)).select(F.col("key.id").alias("span_id"), F.col("key.text").alias("span_text"), "spans")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("row_id"), F.xxhash64(text_col).alias("row_text"))
    both = rows.join(found, (F.col("row_id") == F.col("span_id")) & (F.col("row_text") == F.col("span_text")), "left")
    remove = F.pandas_udf(_cut, "string")
    touched = both.where("spans IS NOT NULL").select("row", remove(F.col(f"row.{text_col}"), "spans").alias("rest")).where("rest <> ''")

    def column(c: str):
        if c == text_col:
            return F.col("rest").alias(c)
        if c == chars_col:
            return F.length("rest").cast(docs.schema[c].dataType).alias(c)
        return F.col(f"row.`{c}`").alias(c)

    return both.where("spans IS NULL").select("row.*").union(touched.select(*[column(c) for c in docs.columns]))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))
    return found.select(F.col("key.id").alias("doc_id"), F.explode("spans").alias("s")).select("doc_id", F.col("s.start").cast("long").alias("start_word"), F.col("s.n_words").cast("long").alias("n_words"), F.col("s.first_id").alias("first_doc_id"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i+49], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM d WHERE len(ws) >= 50)),
f AS (SELECT g, min(doc_id) AS first_id FROM w GROUP BY g),
o AS (SELECT doc_id, g, min(i) AS first_i FROM w GROUP BY doc_id, g),
h AS (SELECT doc_id, i, first_id FROM w JOIN f USING (g) JOIN o USING (doc_id, g) WHERE first_id < doc_id OR first_i <= i - 50),
m AS (SELECT doc_id, i, first_id, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM h),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM m)
SELECT doc_id, min(i) - 1 AS start_word, max(i) - min(i) + 50 AS n_words, arg_min(first_id, i) AS first_doc_id FROM s GROUP BY doc_id, span
"""
