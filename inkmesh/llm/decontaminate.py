"""Benchmark decontamination: SimHash over item-sized windows.

A window is a run of as many words of a document as a benchmark item has (the
whole document, if that is shorter). Documents and items are lower-cased (A-Z)
and split at ASCII white space; shingles are runs of five words, or the whole
item if that has fewer. Steps:

1. Anchors. A window can only reach the threshold if it holds one of the item's rarest
   shingles (as many as the threshold allows to lack, and one), so an equi-join on these
   finds the items that a text may hold; a shingle that many items share brings none in.
   For those pairs all common shingles (anchors) are placed in the text. A window that
   begins at an anchor holds as many anchors as any other, so windows are made there
   (moved left at the end of the text), and only where the anchor that completes the
   number needed still lies inside: one look for each anchor, whatever the text's length.
2. Each window and item has a 64-bit SimHash of its shingles, weighted by how
   often they occur. The 64 bits are cut into ``RADIUS + 1`` blocks: two
   fingerprints within the radius agree in one block at least, so an equi-join by
   item, block and value finds all of them. A pair counts at the first block
   in which it agrees, so none is emitted twice. Only ids and prints go through it.
3. What lies within the radius is verified: weighted Jaccard similarity of the
   shingles themselves, as text, of 0.75 or more.

The radius is wide since windows of just that similarity differ by about 11 bits
with a deviation of 3; 24 is over four deviations above.

Defined results: null or empty texts and items hold nothing and match nothing.
Rows are judged by their text, so repeated rows or ids are judged alike. Items may
share an id or have none. Of equal matches the one of the least item id, then the first
place, is reported. A very long text is split into words in one task, and its windows
are dealt out ``WINDOWS`` at a time. Empty tables give empty results or clean documents.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkmesh.llm.common import SHINGLE, SIMILARITY_PERCENT, durable, few_or_shuffled, let, lower_ascii, table, words

RADIUS = 24
BITS = 64
#: Windows that a task makes at a time.
WINDOWS = 2000


def blocks(radius: int = RADIUS, bits: int = BITS) -> list[tuple[int, int]]:
    """``radius + 1`` (first bit, width) that cover all bits."""
    n = radius + 1
    edges = [k * bits // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def grams(word_array: Column, size: Column | int) -> Column:
    """All runs of ``size`` words as text; fewer words: none."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(
        F.size(word_array) >= size,
        F.transform(F.sequence(F.lit(1), F.size(word_array) - size + 1), lambda i: F.array_join(F.slice(word_array, i, size), " ")),
    ).otherwise(F.array().cast("array<string>"))


def hashed_grams(word_array: Column, k: int) -> Column:
    """64-bit hashes of all runs of ``k`` words; each word is hashed once."""

    def of(h: Column) -> Column:
        runs = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))
        return F.slice(runs, F.lit(1), F.greatest(F.size(h) - (k - 1), F.lit(0)))

    return let(F.transform(word_array, lambda x: F.xxhash64(x)), of)


def simhash(shingles: Column) -> Column:
    """Bit b is set if more shingles, counted as often as they occur, hash to 1 there than to 0."""
    zero = F.lit(0).cast("long")
    # four counters of 16 bits in a long; the table spreads four bits over them
    spread = F.array(*[F.lit(sum((v >> k & 1) << 16 * k for k in range(4))).cast("long") for v in range(16)])

    def few(hashes: Column) -> Column:
        def counted(start: int) -> Column:
            sums = F.aggregate(hashes, zero, lambda acc, h: acc + F.get(spread, F.shiftrightunsigned(h, start).bitwiseAND(F.lit(15).cast("long")).cast("int")))
            return let(sums, lambda c: _any([F.when(2 * F.shiftrightunsigned(c, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long")) > F.size(hashes), F.lit(_signed(1 << start + k)).cast("long")).otherwise(zero) for k in range(4)]))

        return _any([counted(start) for start in range(0, BITS, 4)])

    def many(hashes: Column) -> Column:
        def bit(b: int) -> Column:
            ones = F.aggregate(hashes, zero, lambda acc, h: acc + F.shiftright(h, b).bitwiseAND(F.lit(1).cast("long")))
            return F.when(2 * ones > F.size(hashes), F.lit(_signed(1 << b)).cast("long")).otherwise(zero)

        return _any([bit(b) for b in range(BITS)])

    return let(F.transform(shingles, lambda s: F.xxhash64(s)), lambda h: F.when(F.size(h) < 1 << 15, few(h)).otherwise(many(h)))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def weighted_similarity(a: Column, b: Column) -> Column:
    """(shared, union) of two arrays of shingles as bags."""

    def count(x: Column, s: Column) -> Column:
        return F.size(F.filter(x, lambda y: y == s))

    def alone(x: Column) -> Column:
        return F.size(F.array_distinct(x)) == F.size(x)

    # where one side has no shingle twice, each common one is shared once
    some = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, s: acc + F.least(count(a, s), count(b, s)))
    shared = F.when(alone(a) | alone(b), F.size(F.array_intersect(a, b))).otherwise(some)
    return let(shared, lambda k: F.struct(k.alias("shared"), (F.size(a) + F.size(b) - k).alias("total")))


def _value(fingerprint: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fingerprint, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """``item, item_id, size, k, item_shingles, grams`` of the items that have words. An item is its id and text: ids may repeat or be missing."""
    w = benchmark.select("item_id", words(lower_ascii(F.col("text"))).alias("item_words")).where(F.size("item_words") > 0)
    k = F.least(F.size("item_words"), F.lit(SHINGLE))
    hashed = F.coalesce(*[F.when(F.col("k") == j, hashed_grams(F.col("item_words"), j)) for j in range(1, SHINGLE + 1)])
    w = w.select("item_id", "item_words", F.size("item_words").alias("size"), k.alias("k"))
    return w.select(F.xxhash64("item_id", F.array_join("item_words", " ")).alias("item"), "item_id", "size", "k", grams(F.col("item_words"), F.col("k")).alias("item_shingles"), hashed.alias("grams")).dropDuplicates(["item"])


def rare_grams(items: DataFrame) -> DataFrame:
    """``item, gram``: of each item's grams, from rare to common, as many as a match may lack and one."""
    each = items.select("item", F.size("grams").alias("n"), F.explode("grams").alias("gram")).groupBy("item", "gram", "n").agg(F.count(F.lit(1)).alias("times"))
    common = each.groupBy("gram").agg(F.count(F.lit(1)).alias("holders"))
    order = Window.partitionBy("item").orderBy("holders", "gram").rowsBetween(Window.unboundedPreceding, -1)  # one item's grams
    before = each.join(common, "gram").withColumn("before", F.coalesce(F.sum("times").over(order), F.lit(0)))
    return before.where(100 * F.col("before") <= (100 - SIMILARITY_PERCENT) * F.col("n")).select("item", "gram")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Windows that verify: ``key, item_id, start, shared, total``; ``key`` is :func:`row_key`."""
    items = durable(benchmark_items(benchmark))
    sizes = sorted(r[0] for r in items.select("k").distinct().collect())  # five numbers at most
    texts = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    split = words(lower_ascii(F.col("text")))

    # 1. anchors. The shingle's hash joins; step 3 compares the words themselves.
    def probes(word_array: Column) -> Column:
        return F.concat(F.array().cast("array<bigint>"), *[hashed_grams(word_array, k) for k in sizes])

    rare = durable(rare_grams(items))
    each = texts.select("key.id", F.col("key.text").alias("hash"), split.alias("words")).select("id", "hash", F.explode(probes(F.col("words"))).alias("gram"))
    found = each.join(few_or_shuffled(rare, rare.count()), "gram").select(F.struct("id", F.col("hash").alias("text")).alias("key"), "item").distinct()
    found = durable(found)
    per_text = few_or_shuffled(found.groupBy("key").agg(F.collect_set("item").alias("items")), found.count())
    chosen = durable(texts.join(per_text, "key").dropDuplicates(["key"]).select("key", "items", split.alias("words")).where(F.size("words") > 0))
    n_items = items.count()
    facts = few_or_shuffled(items.select("item", "size", "k"), n_items)
    placed = chosen.select("key", "words", F.explode("items").alias("item")).join(facts, "item")
    hashed = F.coalesce(*[F.when(F.col("k") == k, hashed_grams(F.col("words"), k)) for k in sizes or [SHINGLE]])
    placed = placed.select("key", "item", "size", "k", F.size("words").alias("n_words"), F.posexplode(hashed).alias("at", "gram"))
    item_grams = items.select("item", F.explode(F.array_distinct("grams")).alias("gram"))
    n_shingles = item_grams.count()
    # A group is the anchors of one item in one text, so no more than the words of that text.
    grouped = placed.join(few_or_shuffled(item_grams, n_shingles), ["item", "gram"]).groupBy("key", "item", "size", "k").agg(F.first("n_words").alias("n_words"), F.array_sort(F.collect_list("at")).alias("ats"))
    last = F.greatest(F.col("n_words") - F.col("size"), F.lit(0))
    n_grams = F.least("n_words", "size") - F.col("k") + 1
    # shared >= 0.75 / 1.75 of both sizes together is needed for a similarity of 0.75
    need = F.ceil((n_grams + F.col("size") - F.col("k") + 1) * F.lit(SIMILARITY_PERCENT) / F.lit(100 + SIMILARITY_PERCENT)).cast("int")
    enough = grouped.select("key", "item", "size", "k", "ats", last.alias("last"), n_grams.alias("n_grams"), need.alias("need"))
    full = F.transform("ats", lambda a, i: F.when(F.get("ats", i + F.col("need") - 1) < F.least(a, F.col("last")) + F.col("n_grams"), F.least(a, F.col("last"))))
    windows = durable(enough.select("key", "item", "size", "k", F.array_distinct(F.array_compact(full)).alias("starts")).where(F.size("starts") > 0))
    # 2. fingerprints within the radius, by multi-index blocks
    at_once = F.transform(F.sequence(F.lit(0), F.floor((F.size("starts") - 1) / WINDOWS)), lambda j: F.slice("starts", (j * WINDOWS + 1).cast("int"), F.lit(WINDOWS)))
    heaps = windows.select("key", "item", "size", "k", F.explode(at_once).alias("starts"))
    tasks = (windows.agg(F.sum(F.size("starts"))).first()[0] or 0) // WINDOWS + 1

    def slices(pairs: DataFrame) -> DataFrame:
        """The shingles of the windows at ``starts``; windows are dealt out by number, as texts differ in it."""
        cut = pairs.join(chosen.select("key", "words"), "key").repartition(tasks, "key", "item", F.get("starts", F.lit(0)))
        run = let(F.col("words"), lambda all_words: F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice(all_words, s + 1, F.col("size")).alias("words"))))
        return cut.select("key", "item", "k", F.explode(run).alias("w")).select("key", "item", F.col("w.start").alias("start"), grams(F.col("w.words"), F.col("k")).alias("shingles"))

    cut_blocks = blocks(radius)

    def indexed(df: DataFrame, name: str) -> DataFrame:
        index = F.array(*[F.struct(F.lit(j).alias("block"), _value(F.col(name), s, w).alias("value")) for j, (s, w) in enumerate(cut_blocks)])
        return df.withColumn("b", F.explode(index)).select("*", "b.block", "b.value").drop("b")

    left = indexed(durable(slices(heaps).select("key", "item", "start", simhash(F.col("shingles")).alias("print"))), "print")
    right = indexed(items.select("item", simhash(F.col("item_shingles")).alias("item_print")), "item_print")
    apart = F.col("print").bitwiseXOR(F.col("item_print"))
    first = F.coalesce(*[F.when(_value(apart, s, w) == 0, F.lit(j)) for j, (s, w) in enumerate(cut_blocks)])
    near = left.join(few_or_shuffled(right, n_items * len(cut_blocks)), ["item", "block", "value"]).where((F.bit_count(apart) <= radius) & (first == F.col("block")))
    # 3. the shingles themselves
    starts = near.groupBy("key", "item", F.floor(F.col("start") / WINDOWS).alias("heap")).agg(F.sort_array(F.collect_list("start")).alias("starts")).drop("heap")
    own = slices(starts.join(facts, "item")).join(few_or_shuffled(items.select("item", "item_id", "item_shingles"), n_shingles), "item")
    both = own.select("key", "item_id", "start", weighted_similarity(F.col("shingles"), F.col("item_shingles")).alias("s"))
    return both.select("key", "item_id", "start", "s.shared", "s.total").where(F.col("shared") * 100 >= F.col("total") * SIMILARITY_PERCENT)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Best window of each pair of a contaminated text and an item: ``key, item_id, start, shared, total``."""
    found = matches(docs, benchmark, id_col, text_col)
    best = F.max_by(F.struct("start", "shared", "total"), F.struct((F.col("shared") / F.col("total")).alias("s"), F.negative("start")))
    return found.groupBy("key", "item_id").agg(best.alias("b")).select("key", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item; their columns as they are."""
    bad = durable(matches(docs, benchmark, id_col, text_col).select("key").distinct())
    bad = few_or_shuffled(bad, bad.count())
    rows = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("row_key"))
    same = F.col("row_key.id").eqNullSafe(F.col("key.id")) & (F.col("row_key.text") == F.col("key.text"))
    return rows.join(bad, same, "left_anti").select("row.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key.id").alias("doc_id"), "item_id", F.round(F.col("shared") / F.col("total"), 6).alias("similarity"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (
  SELECT item_id, ws, len(ws) AS n, least(5, len(ws)) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark)
  WHERE len(ws) > 0),
bg AS (SELECT item_id, n, k, array_to_string(ws[i:i+k-1], ' ') AS g, count(*) AS c FROM (SELECT *, unnest(generate_series(1, n - k + 1)) AS i FROM b) GROUP BY ALL),
dg AS (SELECT doc_id, k, i, array_to_string(ws[i:i+k-1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM b) WHERE len(ws) >= k)),
hit AS (SELECT DISTINCT doc_id, item_id, n, bg.k FROM dg JOIN bg ON bg.g = dg.g AND bg.k = dg.k),
win AS (SELECT h.*, len(ws) AS m, unnest(generate_series(1, greatest(len(ws) - n + 1, 1))) AS s FROM hit h JOIN d USING (doc_id)),
wg AS (SELECT win.doc_id, item_id, win.k, s, n, least(m, n) - win.k + 1 AS size, dg.g, count(*) AS c FROM win JOIN dg ON dg.doc_id = win.doc_id AND dg.k = win.k AND dg.i BETWEEN s AND s + least(m, n) - win.k GROUP BY ALL),
sim AS (SELECT wg.doc_id, wg.item_id, s, any_value(size) + any_value(wg.n - wg.k + 1) AS both_n, sum(least(wg.c, bg.c)) AS shared FROM wg JOIN bg ON bg.item_id = wg.item_id AND bg.g = wg.g GROUP BY ALL)
SELECT doc_id, item_id, round(max(shared / (both_n - shared)::DOUBLE), 6) AS similarity FROM sim GROUP BY doc_id, item_id HAVING 100 * max(shared / (both_n - shared)::DOUBLE) >= 75
"""
