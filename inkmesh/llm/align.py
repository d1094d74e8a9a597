"""Alignment of two tokenizers: which tokens of one stand where in the other.

Tokenising. A text is cut before spaces that follow a letter or mark; neither tokenizer
joins across such a place, so each distinct stretch of a batch is encoded once, many in one
call, and its ids are gathered by place.

Bytes at which tokens of both end cut stretches into groups, whose links are all pairs of
tokens in a group; numpy makes them for all distinct stretches of a portion at once, where
the ids are. Spark counts the links of a text by pair over all documents: frequent pairs,
``HEAD`` at most, are sent to every task, so no pair of a large share of the corpus is
shuffled; the others, each in few documents, meet their counts by a join.

Defined results: null and empty texts, and texts that the tokens do not spell byte by byte,
have no tokens: zeros and an empty digest. Rows are aligned one by one, repeated ones and
null ids alike, each a document of its own in the counts. Of pairs with equal counts all are
best. Very long texts are handled whole. Empty tables give empty results. Columns other
than id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.llm.common import durable, release, shared_folder, table
from inkmesh.llm.wordhash import frugal, portions

#: Files of the tokenizers: byte-level BPE, and pieces with byte fallback.
BYTES_FILE, PIECES_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts are sent to every task: a pair and its count take some 50 bytes there.
HEAD = 1 << 19
#: Bytes of text whose stretches are looked up together, and stretches whose ids a task keeps.
PORTION, KEPT = 2e6, 250_000
#: Stretches in one call for pieces, whose cost grows faster than its length.
LINE = 256
SPACE_PIECE = "▁"
#: Characters up to this one are split alike by the fast and the plain encoder; stretches with others go to the plain one.
FAMILIAR = "[^\\x00-\\x{24f}]"
COLUMNS = ["a", "a_ends", "b", "b_ends", "stretch_ends", "texts"]


# --- tokens --------------------------------------------------------------------------------


def byte_of_char() -> dict[str, int]:
    """How a byte-level vocabulary spells bytes: visible Latin-1 as itself, the others in order from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(SPACE_PIECE, " ").encode()


class Spelling:
    """The bytes of each token, gathered by id."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.sizes = np.array([len(t) for t in tokens], np.int32)
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return gathered(self.bytes, self.starts[ids], self.sizes[ids].astype(np.int64))


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Tokens:
    """Both tokenizers, and what became of stretches met so far: ids of either, one after the other."""

    def __init__(self, bytes_file: str, pieces_file: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(bytes_file)
        self.plain.encode_special_tokens = True
        with open(bytes_file, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        char = byte_of_char()
        spelt = {i: bytes(char[c] for c in t) for t, i in vocabulary.items() if all(c in char for c in t)}
        special = {t.content for t in self.plain.get_added_tokens_decoder().values()}
        ranks = {spelt[i]: i for t, i in vocabulary.items() if i in spelt and t not in special}
        self.fast = tiktoken.Encoding("by rank", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_file)
        self.a = Spelling([spelt.get(i, b"") for i in range(max(vocabulary.values()) + 1)])
        every = self.pieces.id_to_piece(list(range(self.pieces.get_piece_size())))
        if any(SPACE_PIECE in p.lstrip(SPACE_PIECE) for p in every):
            raise ValueError("a piece goes on beyond a space, so texts can't be cut there")
        self.b = Spelling([piece_bytes(p) for p in every])
        self.blank = self.pieces.piece_to_id(SPACE_PIECE)
        self.told = Spelling([f"{i}{after}".encode() for i in range(max(len(self.a.sizes), len(self.b.sizes))) for after in ",|;"])
        self.forget()

    @staticmethod
    def of_worker(bytes_file: str, pieces_file: str) -> Tokens:
        """Those of this process: a worker that runs several tasks reads the files once."""
        held = sys.modules.setdefault("_inkmesh_worker", types.ModuleType("_inkmesh_worker")).__dict__
        key = "tokens", bytes_file, pieces_file
        if key not in held:
            held[key] = Tokens(bytes_file, pieces_file)
        return held[key]

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.ids = [np.empty(0, np.int32), np.empty(0, np.int32)]
        self.sizes = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.right = np.empty(0, bool)

    def _pieces(self, text: str) -> list[int]:
        return [self.blank] if text == " " else self.pieces.encode(text[1:])

    def learn(self, new: list[str]) -> None:
        """``new``: stretches, all of which begin with a space."""
        for i in range(0, len(new), 50_000):
            self._learn(new[i : i + 50_000])

    def _learn(self, new: list[str]) -> None:
        texts = pa.array(new, pa.string())
        # What ends in white space would run into the space of the next stretch; what is of other scripts goes to the plain encoder.
        alone = pc.or_(pc.match_substring_regex(texts, "\\s$"), pc.match_substring_regex(texts, FAMILIAR))
        together, lone = texts.filter(pc.invert(alone)), texts.filter(alone).to_pylist()
        line, length = "".join(together.to_pylist()), np.asarray(pc.binary_length(together), np.int64)
        own = [e.ids for e in self.plain.encode_batch_fast(lone, add_special_tokens=False)], [self._pieces(t) for t in lone]
        want = np.frombuffer((line + "".join(lone)).encode(), np.uint8)
        length = np.concatenate([length, np.array([len(t.encode()) for t in lone], np.int64)])
        right = np.ones(len(new), bool)
        lines = ["".join(new_line)[1:] for new_line in (together.slice(i, LINE).to_pylist() for i in range(0, len(together), LINE))]
        pieces = self.pieces.encode([x for x in lines if x], num_threads=1) if all(lines) else [self._pieces(" " + x) for x in lines]
        for k, (spelling, ids) in enumerate(zip((self.a, self.b), (self.fast.encode_ordinary(line), [i for x in pieces for i in x]), strict=True)):
            ids = np.array(ids, np.int32)
            to = np.searchsorted(np.cumsum(spelling.sizes[ids], dtype=np.int64), np.cumsum(length[: len(together)]), "left") + 1
            sizes = np.concatenate([np.diff(to, prepend=0), np.array([len(x) for x in own[k]], np.int64)])
            ids = np.concatenate([ids, np.array([i for x in own[k] for i in x], np.int32)])
            total, to = np.concatenate([[0], np.cumsum(spelling.sizes[ids], dtype=np.int64)]), np.cumsum(sizes)
            begin, at = total[to - sizes], np.cumsum(length) - length
            fits = total[to] - begin == length
            here = np.flatnonzero(fits)  # byte by byte, where the lengths agree
            differs = gathered(spelling.of(ids), begin[here], length[here]) != gathered(want, at[here], length[here])
            fits[here] = np.add.reduceat(differs, np.cumsum(length[here]) - length[here]) == 0 if len(here) else True
            right &= fits
            self.ids[k] = np.concatenate([self.ids[k], ids])
            self.sizes[k] = np.concatenate([self.sizes[k], sizes])
        self.right = np.concatenate([self.right, right])
        self.row.update(zip([*together.to_pylist(), *lone], range(len(self.row), len(self.row) + len(new)), strict=True))


def cut_before(raw: np.ndarray) -> np.ndarray:
    """Where stretches begin: at spaces behind what is no white space. Behind bytes that may end white space beyond ASCII none begins."""
    before, second = np.concatenate([[32], raw[:-1]]), np.concatenate([[32, 32], raw[:-2]])[: len(raw)]
    white = (before == 32) | ((before >= 9) & (before <= 13)) | ((before >= 28) & (before <= 31))
    perhaps = (before >= 128) & np.isin(second, (0xC2, 0x9A, 0x80, 0x81))
    return (raw == 32) & ~white & ~perhaps


def _tokenised(bytes_file: str, pieces_file: str):  # noqa: ANN202
    """A row for each portion of texts: the ids of both tokenizers for its distinct stretches, one stretch after the other, the bytes at
    which ids and stretches end, and ``texts``: ``doc_id``, how many ids it has, and its stretches by their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.of_worker(bytes_file, pieces_file)
        for batch in portions(batches, 1, PORTION):
            texts = pc.binary_join_element_wise(" ", pc.fill_null(batch.column(1), ""), "")
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(texts.buffers()[2], np.uint8)[: offsets[-1]]
            begins = cut_before(raw)
            begins[offsets[:-1]] = True
            starts = np.flatnonzero(begins).astype(np.int32)
            stretches = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, np.int32(offsets[-1])).tobytes()), texts.buffers()[2]).dictionary_encode()
            distinct, places = stretches.dictionary.to_pylist(), np.asarray(stretches.indices)
            new = [s for s in distinct if s not in tokens.row]
            if len(tokens.row) + len(new) > KEPT:
                tokens.forget()
                new = distinct
            tokens.learn(new)
            row = np.fromiter(map(tokens.row.__getitem__, distinct), np.int64, len(distinct))
            first = np.searchsorted(starts, offsets[:-1])  # the first stretch of each text
            n_stretches = np.diff(np.append(first, len(places)))
            good = (np.diff(offsets) > 1) & np.logical_and.reduceat(tokens.right[row[places]], first)
            places, n_stretches = places[np.repeat(good, n_stretches)], np.where(good, n_stretches, 0)
            # Stretches of texts that have none of these are left out.
            used, places = np.unique(places, return_inverse=True)
            row, ends = row[used], np.concatenate([[0], np.cumsum(n_stretches)])
            columns, counts = [], []
            for k, spelling in enumerate((tokens.a, tokens.b)):
                size = tokens.sizes[k]
                ids = gathered(tokens.ids[k], (np.cumsum(size) - size)[row], size[row])
                stops = np.cumsum(spelling.sizes[ids], dtype=np.int64)
                columns += [ids, stops.astype(np.int32)]
                counts.append(np.diff(np.concatenate([[0], np.cumsum(size[row][places])])[ends]))
            columns.append((stops[np.cumsum(size[row]) - 1] if len(row) else stops).astype(np.int32))
            per_text = pa.StructArray.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(places.astype(np.int32)))], ["doc_id", "n_a", "n_b", "places"])
            whole = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c)) for c in (*columns, per_text)]
            yield pa.RecordBatch.from_arrays(whole, COLUMNS)
        tokens.forget()  # an idle worker's memory is missing elsewhere

    return run


# --- groups and links ------------------------------------------------------------------------

GROUPS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<bigint>"
#: What follows an id in the text of a group: another of its side, the other side, the next group.
COMMA, BAR, SEMICOLON = range(3)


def from_zero(sizes: np.ndarray) -> np.ndarray:
    """0, and the sum of ``sizes`` up to each."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def grouped(portion: pa.RecordBatch, told: Spelling) -> pa.RecordBatch:
    """Rows of ``GROUPS`` for the texts of a portion, a row of ``COLUMNS``.

    Tokens of both end where a stretch ends, so groups are made for each distinct stretch, and a text's are those of its stretches, in order.
    """
    a, a_ends, b, b_ends, stops = (np.asarray(portion.column(k).flatten()) for k in range(5))
    texts = portion.column(5).flatten()
    ends_b = np.zeros(int(stops[-1]) + 1 if len(stops) else 1, bool)
    ends_b[b_ends] = True
    cuts = a_ends[ends_b[a_ends]]
    cuts = cuts[np.diff(cuts, prepend=np.int32(-1)) != 0]
    to_a, to_b, to_group = (np.searchsorted(ends, at, "right") for ends, at in ((a_ends, cuts), (b_ends, cuts), (cuts, stops)))
    n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    first_a, first_b, every = to_a - n_a, to_b - n_b, np.arange(len(cuts))
    # all pairs of a group
    pairs = n_a * n_b
    group = np.repeat(every, pairs)
    x, y = np.divmod(np.arange(len(group)) - np.repeat(np.cumsum(pairs) - pairs, pairs), n_b[group])
    links = (a[first_a[group] + x].astype(np.int64) << 32) + b[first_b[group] + y]
    own_links = from_zero(pairs)[np.concatenate([[0], to_group])]
    # ids of a group, its A side first, each with what follows it
    codes = np.empty(len(a) + len(b), np.int64)
    at_a, at_b = np.arange(len(a)) + np.repeat(first_b, n_a), np.arange(len(b)) + np.repeat(to_a, n_b)
    codes[at_a], codes[at_b] = a.astype(np.int64) * 3 + COMMA, b.astype(np.int64) * 3 + COMMA
    codes[at_a[to_a - 1]] += BAR
    codes[at_b[to_b - 1]] += SEMICOLON
    own_told = from_zero(told.sizes[codes])[np.concatenate([[0], (to_a + to_b)[to_group - 1]])]
    spelt = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(own_told.tobytes()), pa.py_buffer(told.of(codes).tobytes())])

    places = np.asarray(texts.field("places").flatten())
    ends = from_zero(np.asarray(texts.field("places").value_lengths()))
    n_links = np.diff(own_links)[places]
    links, link_ends = gathered(links, own_links[places], n_links), from_zero(n_links)[ends]
    n_groups = np.diff(from_zero(np.diff(to_group, prepend=0)[places])[ends])
    whole = memoryview(spelt.take(pa.array(places)).buffers()[2] or b"")
    bounds = from_zero(np.diff(own_told)[places])[ends].tolist()
    digests = [hashlib.sha256(whole[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(bounds, bounds[1:], strict=False)]
    columns = [*(texts.field(c) for c in ("doc_id", "n_a", "n_b")), pa.array(n_groups), pa.array(np.diff(link_ends)), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(link_ends.astype(np.int32)), pa.array(links))]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in GROUPS.split(", ")])


def _aligned(bytes_file: str, pieces_file: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = Tokens.of_worker(bytes_file, pieces_file).told
        for portion in _tokenised(bytes_file, pieces_file)(batches):
            yield grouped(portion, told)

    return run


def aligned(docs: DataFrame, bytes_file: str | None = None, pieces_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``GROUPS`` of each text; ``links``: a number for each link, its A id times 2 to the 32 plus its B id."""
    import public_tokenizers

    files = bytes_file or public_tokenizers.path(BYTES_FILE), pieces_file or public_tokenizers.path(PIECES_FILE)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(frugal(_aligned(*files)), GROUPS)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``link, n, best``: how many rows of ``aligned`` hold each pair, and whether no other pair of its A id is in more."""
    counts = durable(rows.select(F.explode(F.array_distinct("links")).alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("n")))
    of = F.shiftright("link", 32)
    most = counts.groupBy(of.alias("of")).agg(F.max("n").alias("most"))
    return counts.withColumn("of", of).join(most, "of").select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def head_and_tail(counts: DataFrame, most: int = HEAD) -> tuple[DataFrame, DataFrame | None]:
    """Frequent pairs, ``most`` at most, and the rest, whose pairs are each in fewer rows; none if all are frequent."""
    size = F.floor(F.log2("n") * 4)
    sizes = counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("size")).collect()  # some hundreds at most
    least, taken = None, 0
    for r in sizes:
        if (taken := taken + r.pairs) > most:
            return (counts.where(size >= least) if least is not None else counts.limit(0)), counts.where(size < (least if least is not None else sizes[0]["size"] + 1))
        least = r["size"]
    return counts, None


def align(docs: DataFrame, bytes_file: str | None = None, pieces_file: str | None = None, most: int = HEAD) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    release(spark)
    numbered = aligned(docs, bytes_file, pieces_file).withColumn("row", F.monotonically_increasing_id())
    numbered.write.option("compression", "zstd").parquet(path)  # read twice
    rows = spark.read.parquet(path)
    counts = durable(pair_counts(rows))
    head, tail = head_and_tail(counts, most)
    links = rows.select("row", F.explode("links").alias("link"))
    met = links.join(F.broadcast(head), "link", "left" if tail is not None else "inner")
    totals = met.groupBy("row").agg(F.sum("n").alias("count_sum"), F.sum(F.col("best").cast("long")).alias("n_best"))
    if tail is not None:
        lesser = met.where("n IS NULL").groupBy("row", "link").agg(F.count(F.lit(1)).alias("times")).join(tail, "link")
        lesser = lesser.groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("count_sum"), F.sum(F.col("best").cast("long") * F.col("times")).alias("n_best"))
        totals = totals.unionByName(lesser).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = F.lit(0).cast("long")
    return rows.drop("links").join(totals, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
