"""Best-fit packing in bounded space.

A document's ids, then ``END``, make its tokens; more than ``LENGTH`` are cut into
pieces of ``LENGTH``, the last one shorter. Pieces arrive one by one and go into the
open bin that they fill best. Open bins are keyed by their free space, and a bitset
with a bit for each free space in use finds the least that suffices in one shift.
A fixed number of bins is open; beyond it the fullest closes. Memory is that of the
open bins, whatever the input.

Each input partition packs its own pieces, so nothing is shuffled for it. The bins
left open at the ends of partitions are then packed again, pieces in order of falling
length, in groups of ``GROUP`` pieces.

Ids come from a public tokenizer whose file is a parameter. It drops white space and
never joins across it, so each distinct word of a batch is encoded once and its ids
are gathered by place, which tests hold against the tokenizer over whole texts.

Defined results: a null text is empty; an empty one has the token ``END`` alone. Rows
are packed one by one, also repeated ones and those of null ids. Empty tables give no
pieces. Other columns are not read.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.llm.common import durable, table
from inkmesh.llm.wordhash import frugal

LENGTH, END, OPEN = 2048, 0, 256
GROUP = 100_000
#: Words whose ids a task keeps, about 150 bytes each.
KEPT_WORDS = 300_000
#: Marks that may follow a word, and words of letters (lower-case but for those beyond ASCII) that need no normalizer: one form, one case.
MARKS, LETTERS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "^[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: How a byte-level vocabulary spells the bytes that are no visible Latin-1 character: those from 256 on, in order.
SPELLING = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
TOKENIZER = "word_bpe_49k.json"
#: Bytes of text whose words are looked up together.
STEP = 4e6


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def joined(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Ids:
    """Ids of texts (UTF-8), each distinct word of a batch looked up once. What a word becomes is kept for the next time."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # For words of lower-case letters in the tokenizer's own spelling: to split and merge is all that is left.
        self.spelt = Tokenizer(self.tokenizer.model)
        self.spelt.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a run
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    @staticmethod
    def of_worker(path: str) -> Ids:
        """That of this process: a worker that runs several tasks reads the tokenizer once."""
        kept = sys.modules.setdefault("_inkmesh_worker", types.ModuleType("_inkmesh_worker")).__dict__
        if ("ids", path) not in kept:
            kept["ids", path] = Ids(path)
        return kept["ids", path]

    def forget(self) -> None:
        """Keeps nothing but no word and the end of a text."""
        self.row = {"": 0, " ": 1}
        self.ids, self.sizes = np.array([END], "<u4"), np.array([0, 1], np.int64)
        self.starts = np.zeros(2, np.int64)

    def _spelt(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters are one run of tokens each, which a last token ends, so they go in lines."""
        own = [w if w.isascii() else w.encode().decode("latin-1").translate(SPELLING) for w in new]
        lines = [" ".join(own[k : k + 100]) for k in range(0, len(own), 100)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.spelt.encode_batch_fast(lines, add_special_tokens=False)])
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)

    def _whole(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        return np.concatenate(encoded), np.array([len(e) for e in encoded], np.int64)

    def _learn(self, new: list[str]) -> None:
        letters = np.asarray(pc.match_substring_regex(pa.array(new, pa.string()), LETTERS))
        parts = [(self.ids, self.sizes)]
        for kind, encode, step in ((letters, self._spelt, 20_000), (~letters, self._whole, 5000)):
            own = [new[i] for i in np.flatnonzero(kind).tolist()]
            for i in range(0, len(own), step):
                words = own[i : i + step]
                ids, sizes = encode(words)
                if len(sizes) != len(words) or sizes.sum() != len(ids):
                    ids, sizes = self._whole(words)
                self.row.update(zip(words, range(len(self.row), len(self.row) + len(words)), strict=True))
                parts.append((ids, sizes))
        self.ids, self.sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _rows(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.row]
        if len(self.row) + len(new) > KEPT_WORDS:
            self.forget()
            new = [w for w in words if w not in self.row]
        if new:
            self._learn(new)
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, ``END`` after each, and how many each text has."""
        texts = pc.fill_null(texts, "")
        # The tokenizer lower-cases, so a word need not be kept in several cases; special tokens are told by case.
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary
        # Marks behind letters are a run of tokens of their own, and many words differ in them alone.
        core = pc.utf8_rtrim(distinct, MARKS)
        letters = pc.match_substring_regex(core, LETTERS)
        n_marks = np.asarray(pc.binary_length(distinct)) - np.asarray(pc.binary_length(core))
        marked = np.flatnonzero(np.asarray(letters) & (n_marks > 0))
        core = pc.if_else(letters, pc.utf8_lower(core), distinct).dictionary_encode()
        marks = [w[-n:] for w, n in zip(distinct.take(pa.array(marked)).to_pylist(), n_marks[marked].tolist(), strict=True)]
        units = core.dictionary.to_pylist()
        rows = self._rows([*units, *set(marks)])  # all at once, as the rows of a call may be forgotten in the next
        parts = np.zeros((len(distinct) + 1, 2), np.int64)
        parts[:-1, 0] = rows[: len(units)][np.asarray(core.indices)]
        parts[marked, 1] = np.fromiter(map(self.row.__getitem__, marks), np.int64, len(marks))
        parts[-1, 0] = self.row[" "]
        flat = parts.ravel()
        own, sizes = joined(self.ids, self.starts[flat], self.sizes[flat]), self.sizes[parts].sum(1)
        # the place of each word, with an end behind each text
        counts = np.diff(np.asarray(lists.offsets))
        places = np.full(len(words) + len(texts), len(distinct), np.int64)
        ends = np.cumsum(counts + 1) - 1
        inside = np.ones(len(places), bool)
        inside[ends] = False
        places[inside] = np.asarray(words.indices)
        n = sizes[places]
        total = np.cumsum(n)[ends] if len(ends) else np.empty(0, np.int64)
        return joined(own, (np.cumsum(sizes) - sizes)[places], n), np.diff(total, prepend=0)


class Packer:
    """Online best fit over at most ``most`` open bins. ``put`` and ``flush`` yield the items of closed bins."""

    def __init__(self, most: int = OPEN, length: int = LENGTH, first: int = 0) -> None:
        self.most, self.length, self.next = most, length, first
        self.bits = 0  # bit f: some open bin has f free
        self.bins: dict[int, list[list]] = {}  # free space: bins, each a list of (item, sequence, offset)
        self.open = 0

    def _take(self, free: int) -> list:
        bins = self.bins[free]
        out = bins.pop()
        if not bins:
            del self.bins[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return out

    def put(self, item, size: int) -> list:
        """Places an item; returns the bin that this closes, if any."""
        suits = self.bits >> size
        if suits:
            free = size + (suits & -suits).bit_length() - 1
            own = self._take(free)
            sequence, offset = own[0][1], self.length - free
        else:
            free, own, sequence, offset = self.length, [], self.next, 0
            self.next += 1
        own.append((item, sequence, offset))
        free -= size
        if not free:
            return own
        self.bins.setdefault(free, []).append(own)
        self.bits |= 1 << free
        self.open += 1
        return self._take((self.bits & -self.bits).bit_length() - 1) if self.open > self.most else []

    def flush(self) -> list:
        out = [x for free in sorted(self.bins) for own in self.bins[free] for x in own]
        self.bins, self.bits, self.open = {}, 0, 0
        return out


COLUMNS = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])


def _table(placed: list, still_open: bool) -> pa.RecordBatch:
    rows = [(*item, sequence, offset, still_open) for item, sequence, offset in placed]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _packs(path: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer = Ids.of_worker(path), Packer(most, first=TaskContext.get().partitionId() << 33)
        for batch in batches:
            done = []
            step = max(1, int(len(batch) * STEP / max(STEP, batch.column(1).nbytes)))
            for i in range(0, len(batch), step):
                part = batch.slice(i, step)
                flat, sizes = ids.of(part.column(1))
                raw, first = memoryview(flat.astype("<u4", copy=False)).cast("B"), 0
                for doc_id, size in zip(part.column(0).to_pylist(), sizes.tolist(), strict=True):
                    for piece, start in enumerate(range(0, size, LENGTH)):
                        length = min(LENGTH, size - start)
                        at = 4 * (first + start)
                        done += packer.put((doc_id, piece, start, length, zlib.crc32(raw[at : at + 4 * length])), length)
                    first += size
            if done:
                yield _table(done, False)
        ids.forget()  # an idle worker's memory is missing elsewhere
        if left := packer.flush():
            yield _table(left, True)

    return run


def _again(first: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(most, first=first + (TaskContext.get().partitionId() << 33))
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                done += packer.put(row[:5], row[3])
            if done:
                yield _table(done, False)
        if left := packer.flush():
            yield _table(left, False)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, open_bins: int = OPEN) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = durable(rows.mapInArrow(frugal(_packs(tokenizer or tokenizer_file(), open_bins)), COLUMNS + ", open boolean"))
    columns = [c for c in first.columns if c != "open"]
    left = first.where("open").select(*columns)
    groups = left.count() // GROUP + 1
    by_size = left.repartition(groups, "sequence_id").sortWithinPartitions(F.desc("length"), "doc_id", "piece", "start", "ids_crc32")
    second = by_size.mapInArrow(frugal(_again(1 << 62, open_bins)), COLUMNS + ", open boolean")
    return first.where("NOT open").select(*columns).unionByName(second.select(*columns))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
