"""Word and shingle hashes in numpy, for the operators that run in Python workers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def let_go() -> None:
    """Gives unused memory back to the machine: Python workers live on between tasks, and what they hold is missing elsewhere."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not with this C library
        pass


def frugal(batches_to_batches):  # noqa: ANN001, ANN201
    """A function over batches that gives its memory back when it is through."""

    def run(batches):  # noqa: ANN001, ANN202
        yield from batches_to_batches(batches)
        let_go()

    return run


def portions(batches: Iterable[pa.RecordBatch], column: int, most: float = 4e6) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, about ``most`` bytes of a column at a time: arrays by word are many times as large as the text."""
    for batch in batches:
        step = max(1, int(len(batch) * most / max(most, batch.column(column).nbytes)))
        for i in range(0, len(batch), step):
            yield batch.slice(i, step)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def word_list(text: bytes | None) -> list[bytes]:
    """Words in order; A-Z lower-cased, split at ASCII white space, as bytes do it."""
    return text.lower().split() if text else []


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; fewer words: none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, size):  # the words' hashes are well spread already
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[j : j + n]
    return mix(out + np.uint64(size))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of strings, the place among them of each word in order, and how many words each text has; null: none.

    A-Z is lower-cased and ASCII white space splits, as in :func:`word_list`, but each distinct word is made once.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten().dictionary_encode()
    places, distinct = np.asarray(words.indices), words.dictionary
    counts = np.diff(np.asarray(lists.offsets))
    blank = pc.index(distinct, "").as_py()  # white space at the ends of a text leaves empty words
    if blank >= 0:
        empty = places == blank
        counts = counts - np.bincount(np.repeat(np.arange(len(counts)), counts), empty, len(counts)).astype(counts.dtype)
        places = places[~empty]
    return distinct, places, counts


#: Random values of each byte in each of 64 places.
_BYTES = mix(np.arange(1, 1 + (64 << 8), dtype=np.uint64))


def hash_distinct(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of strings: the sum of a random value for each byte in its place, mixed with the length."""
    ends = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset : distinct.offset + len(distinct) + 1]
    raw = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(distinct) else np.empty(0, np.uint8)
    sizes = np.diff(ends)
    place = np.arange(len(raw), dtype=np.int32) - np.repeat(ends[:-1] - ends[:1], sizes)
    values = _BYTES[(place & 63) << 8 | raw]
    if sizes.max(initial=0) > 64:
        values *= (2 * (place >> 6) + 1).astype(np.uint64)
    total = np.zeros(len(distinct), np.uint64)
    full = np.flatnonzero(sizes)
    total[full] = np.add.reduceat(values, (ends[:-1] - ends[:1])[full]) if len(full) else 0
    return mix(total + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; fewer words: the whole sequence as one; no words: none."""
    distinct, places, counts = split_words(texts)
    hashes = hash_distinct(distinct)[places]
    every, ends, out = runs(hashes, size), np.cumsum(counts).tolist(), []
    for end, n in zip(ends, counts.tolist(), strict=True):
        own = np.sort(every[end - n : end - size + 1] if n >= size else runs(hashes[end - n : end], n) if n else every[:0])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return out
