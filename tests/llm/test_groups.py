"""Operators over groups of documents, against brute force; language-model scores; the pipeline."""

import math
import random
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import components, contaminated, prose, repeated, shingles, words
from pyspark.sql import functions as F

from inkmesh.llm import common, decontaminate, lm, neardup, packing, quality, suffix
from inkmesh.llm.wordhash import hash_distinct, shingle_sets, split_words

ITEM = "item_id bigint, text string"


def edited(r, text, n, vocabulary=400):
    w = text.split()
    for _ in range(n):
        i = r.randrange(len(w))
        w[i : i + r.randrange(2)] = [f"e{r.randrange(vocabulary)}"]
    return " ".join(w)


# --- near duplicates -----------------------------------------------------------------------


def near_texts(seed):
    """Copies of some bases with few and many edits (few spare words, so edits meet), chains, cuts, short texts, odd ones."""
    r = random.Random(seed)
    out = []
    for _ in range(6):
        base = prose(r, r.randrange(20, 160), 5000)
        out += [edited(r, base, r.randrange(0, 9), 3) for _ in range(25)]
        chain = base
        for _ in range(8):
            chain = edited(r, chain, 1)
            out.append(chain)
        w = base.split()
        out += [" ".join(w[: int(len(w) * f)]) for f in (0.5, 0.7, 0.8, 0.9)]
    out += ["a b c", "A b C", "a b", "a b c d e", "A B\tc\nd e", "a b c d e f", "", " ", None, None, "w " * 300, "w " * 200]
    out += [out[3], out[3], out[40]]
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "piece"), [(0, common.PIECE), (1, 3), (2, 1)])
def test_near_duplicates_against_all_pairs(docs_of, monkeypatch, seed, piece):
    monkeypatch.setattr(common, "PIECE", piece)
    texts = near_texts(seed)
    docs = docs_of(texts).withColumns({c: F.lit("x") for c in ("node", "key", "component_id", "row")})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.link(docs).collect()}
    want = components(texts)
    assert got == {i: (len(shingles(t)), want[i]) for i, t in enumerate(texts)}
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, c in enumerate(want) if i == c]


def test_near_duplicates_of_odd_ids(docs_of, rng):
    a, b = prose(rng, 60), prose(rng, 60)
    rows = neardup.link(docs_of([a, a, a, b, b, a], [5, 5, None, None, 7, 6])).collect()
    assert Counter((r.doc_id, r.component_id) for r in rows) == {(5, 5): 2, (6, 5): 1, (None, None): 2, (7, 7): 1}
    assert Counter(r.doc_id for r in neardup.keep_one(docs_of([a, a, a, b, b, a], [5, 5, None, None, 7, 6])).collect()) == {5: 2, None: 2, 7: 1}
    assert neardup.link(docs_of([])).count() == 0 and neardup.keep_one(docs_of([])).count() == 0


def test_signatures_agree_as_often_as_sets_do():
    r, order = random.Random(3), neardup.donors()
    for n in (8, 40, 400):
        base = prose(r, n + 4, 10**6)
        other = edited(r, base, max(1, n // 40))
        a, b = shingle_sets(pa.array([base, other]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        both = neardup.signatures([a, b], order)
        assert abs((both[0] == both[1]).mean() - true) < 0.35
        assert (neardup.signatures([b], order)[0] == both[1]).all()


def test_signatures_by_the_plain_rule(rng):
    order, sets = neardup.donors(), shingle_sets(pa.array(["one", prose(rng, 30), prose(rng, 300), prose(rng, 3000)]))
    for own, got in zip(sets, neardup.signatures(sets, order), strict=True):
        least = {}
        for v in own.tolist():
            least[v >> 57] = min(least.get(v >> 57, v), v)
        want = [least[b] if b in least else next((least[x] for x in order[b].tolist() if x in least), None) for b in range(neardup.BINS)]
        assert [g for g, w in zip(got.tolist(), want, strict=True) if w is not None] == [w for w in want if w is not None]


def test_shingle_sets_by_the_plain_rule(rng):
    texts = [None, "", " ", "one", "a b c d", "A b  c d e", "a a a a a a a", prose(rng, 50)]
    sets = shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts] and all((np.diff(s.astype(object)) > 0).all() for s in sets)
    assert shingle_sets(pa.array(texts[4:5]))[0].tolist() == sets[4].tolist()


# --- repeated passages ---------------------------------------------------------------------


def passage_rows(seed):
    r = random.Random(seed)
    passages = [prose(r, n, 3000) for n in (49, 50, 51, 60, 90, 200)]
    rows = []
    for i in range(60):
        parts = [prose(r, r.randrange(0, 40), 3000) for _ in range(3)]
        for _ in range(r.randrange(3)):
            p = r.choice(passages).split()
            a = r.randrange(len(p))
            parts.insert(r.randrange(len(parts)), " ".join(p if r.random() < 0.6 else p[a:]))
        rows.append((i, "\n ".join(parts)))
    base = prose(r, 220, 3000)
    rows += [(100 + i, edited(r, base, r.randrange(4), 3)) for i in range(40)]
    rows += [(200, "z " * 150), (201, "z " * 120), (202, None), (203, ""), (204, " ".join(passages[4].split() * 3)), (10, rows[10][1]), (10, passages[5]), (205, passages[3].upper())]
    return rows


@pytest.mark.parametrize("heap", [suffix.HEAP, 3])
@pytest.mark.parametrize("seed", range(2))
def test_passages_against_all_runs(docs_of, monkeypatch, seed, heap):
    monkeypatch.setattr(suffix, "HEAP", heap)
    monkeypatch.setattr(common, "PIECE", heap)
    rows = passage_rows(seed)
    docs = docs_of([t for _, t in rows], [i for i, _ in rows])
    got = {}
    for r in suffix.spans(docs).select("key.id", "spans").collect():
        for s in r.spans:
            assert s.n_words >= suffix.LENGTH and s.first_id <= r.id
            got.setdefault(r.id, []).append(set(range(s.start, s.start + s.n_words)))
    got = sorted((i, sorted(frozenset().union(*v))) for i, v in got.items() if i != 10)
    want = sorted((i, sorted(w)) for (i, _), w in zip(rows, repeated(rows), strict=True) if w and i != 10)
    assert got == want


def test_passages_are_cut_out(docs_of, rng):
    p = prose(rng, 70, 3000)
    texts = [f"start {p} end", f"É one\n{p}  two \n", p, None, "short", p.upper()]
    docs = docs_of(texts).withColumns({"span_id": F.lit(1), "rest": F.lit("r"), "spans": F.lit(0)})
    out = {r.doc_id: (r.text, r.n_chars) for r in suffix.cut(docs).collect()}
    left = "É one\n  two"
    assert out == {0: (texts[0], len(texts[0])), 1: (left, len(left)), 3: (None, 0), 4: ("short", 5)}
    assert suffix.cut(docs).columns == docs.columns and suffix.cut(docs_of([])).count() == 0


def test_cut_keeps_rows_of_a_null_id_and_repeated_rows(docs_of, rng):
    p = prose(rng, 60, 3000)
    texts = [f"a {p}", f"b {p}", f"b {p}", f"c {p}", None]
    out = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in suffix.cut(docs_of(texts, [1, 2, 2, None, None])).collect())
    assert out == sorted([(1, texts[0]), (2, "b"), (2, "b"), (-1, texts[3]), (-1, "")])


def test_a_passage_repeated_in_its_own_text(docs_of, rng):
    p, q = prose(rng, 60, 3000), prose(rng, 55, 3000)
    texts = [f"{p} x {p} y {p}", "z " * 130, f"{q} {q}", prose(rng, 200, 5000)]
    got = {r.doc_id: r.text for r in suffix.cut(docs_of(texts)).collect()}
    assert got == {0: f"{p} x  y", 1: ("z " * 50).strip(), 2: q, 3: texts[3]}


def test_near_duplicates_of_very_long_texts(docs_of, rng):
    a = prose(rng, 60_000, 50_000)
    got = {r.doc_id: r.component_id for r in neardup.link(docs_of([a, edited(rng, a, 200), "short", prose(rng, 60_000, 50_000)])).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


# --- benchmark passages --------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(2))
def test_contamination_against_all_windows(spark, docs_of, seed):
    r = random.Random(seed)
    items = [(i, prose(r, n, 300)) for i, n in enumerate((12, 15, 24, 37, 57, 57, 8, 5))] + [(20, "tiny one"), (21, None), (22, ""), (23, "solo")]
    items.append((30, " ".join(items[4][1].split()[28:] + items[4][1].split()[:28])))
    texts = [None, "", "tiny one", "a tiny one b", "SOLO", prose(r, 4000, 300)]
    for _ in range(120):
        _, t = r.choice(items[:8])
        own = edited(r, t, r.randrange(0, 4), 300).split()
        cut = own[r.choice([0, 0, 1, 3]) :]
        texts.append(" ".join([prose(r, r.choice([0, 3, 30]), 300), *cut, prose(r, r.choice([0, 3, 30]), 300)]).upper())
    docs = docs_of(texts).withColumns({"key": F.lit("x"), "item_id": F.lit(1), "words": F.lit(2)})
    bench = spark.createDataFrame(items, ITEM)
    want = {(i, x) for i, t in enumerate(texts) for x in contaminated(t, items)}
    found = {(r.id, r.item_id) for r in decontaminate.contaminated(docs, bench).select("key.id", "item_id").collect()}
    assert found == want and len(want) > 30
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == sorted(set(range(len(texts))) - {i for i, _ in want})


def test_contamination_of_odd_rows(spark, docs_of):
    item = "one two three four five six seven eight"
    docs = docs_of([item, item, None, item, "x"], [None, 4, 4, 4, None])
    bench = spark.createDataFrame([(1, item), (2, item)], ITEM)
    assert sorted((r.doc_id, r.text) for r in decontaminate.clean(docs, bench).na.fill(-1, ["doc_id"]).na.fill("").collect()) == [(-1, "x"), (4, "")]
    assert decontaminate.contaminated(docs, bench).count() == 4
    assert decontaminate.clean(docs, bench.limit(0)).count() == 5 and decontaminate.clean(docs_of([]), bench).count() == 0


@pytest.mark.parametrize("item_id", [1, None])
def test_items_of_one_id_are_each_found(spark, docs_of, item_id):
    r = random.Random(3)
    items = [" ".join(f"{n}w{r.randrange(500)}" for _ in range(n)) for n in (20, 60, 120)]
    pad = lambda: " ".join(f"p{r.randrange(10_000)}" for _ in range(200))
    docs = docs_of([f"{pad()} {x} {pad()}" for x in items] + [" ".join([pad(), *items, pad()])])
    bench = spark.createDataFrame([(item_id, x) for x in items], "item_id bigint, text string")
    found = {r.start for r in decontaminate.matches(docs, bench).select("start").collect()}
    assert decontaminate.clean(docs, bench).count() == 0 and {200, 220, 280} <= found


def test_items_of_one_template_and_equal_words(spark, docs_of):
    r = random.Random(8)
    template = "answer the question below with one of the four letters"
    items = [(i, f"{template} {prose(r, n, 300)}") for i, n in enumerate((5, 10, 20, 30, 30))] + [(9, "z " * 40)]
    texts = [template, f"{template} {prose(r, 40, 300)}", *[f"{prose(r, 9, 300)} {t} {template}" for _, t in items[:5]], "z " * 3000, "z " * 30, f"{prose(r, 20, 300)} {'z ' * 39}"]
    want = {(i, x) for i, t in enumerate(texts) for x in contaminated(t, items)}
    bench = spark.createDataFrame(items, ITEM)
    assert {(x.id, x.item_id) for x in decontaminate.contaminated(docs_of(texts), bench).select("key.id", "item_id").collect()} == want
    rare = decontaminate.rare_grams(decontaminate.benchmark_items(bench)).groupBy("gram").count()
    assert rare.agg(F.max("count")).first()[0] < 5  # what all share brings no item in


def test_blocks_find_all_within_the_radius(spark):
    r = random.Random(1)
    cut = decontaminate.blocks()
    assert sum(w for _, w in cut) == 64 and len(cut) == decontaminate.RADIUS + 1
    for _ in range(300):
        apart = sum(1 << b for b in r.sample(range(64), decontaminate.RADIUS))
        assert any((apart >> s) & ((1 << w) - 1) == 0 for s, w in cut)


@pytest.mark.parametrize("n", [1, 30, 40_000])
def test_prints_bit_by_bit(spark, n):
    r = random.Random(n)
    row = spark.createDataFrame([([f"s{r.randrange(n)}" for _ in range(n)],)], "s array<string>").select(decontaminate.simhash(F.col("s")).alias("p"), F.transform("s", lambda x: F.xxhash64(x)).alias("h")).first()
    want = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in row.h) > n)
    assert row.p % (1 << 64) == want


def test_prints_of_similar_windows_are_within_the_radius(spark):
    r = random.Random(2)
    rows = []
    for _ in range(300):
        w = prose(r, r.randrange(20, 58), 10**6).split()
        rows.append((w, [*w[: len(w) - 2], "x", "y"]))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    apart = df.select(F.bit_count(decontaminate.simhash(decontaminate.grams(F.col("a"), 5)).bitwiseXOR(decontaminate.simhash(decontaminate.grams(F.col("b"), 5)))).alias("d"))
    assert max(x.d for x in apart.collect()) <= decontaminate.RADIUS


# --- language model ------------------------------------------------------------------------


def language(r, n):
    """Words whose middle one follows from its neighbours."""
    w = []
    while len(w) < n:
        a = r.randrange(30)
        w += [f"a{a}", f"b{a}", f"c{a}"]
    return " ".join(w[:n])


def small_model(monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 64)
    monkeypatch.setattr(lm, "TAIL", 16)
    monkeypatch.setattr(lm, "BATCH", 128)
    monkeypatch.setattr(lm, "SHARD", 20_000)


def test_model_learns_from_both_sides_and_scores_held_out_text(docs_of, monkeypatch):
    small_model(monkeypatch)
    r = random.Random(4)
    model = lm.fit(lm.encode(docs_of([language(r, 300) for _ in range(150)] + [None, ""])))
    held = [language(r, 300) for _ in range(20)]
    shuffled = [" ".join(random.Random(9).sample(t.split(), 300)) for t in held]
    odd = [None, "", "a1", "a1 b1 c1 " * 5000, " never seen words\n"]
    docs = lm.encode(docs_of([*held, *shuffled, *odd]).withColumns({"words": F.lit("x"), "salt": F.lit(1)}))
    rows = {x.doc_id: x for x in lm.score(docs, model).collect()}
    good, bad = (np.mean([rows[i + k].mean_log_prob for i in range(20)]) for k in (0, 20))
    flat = lm.Model(model.words, lm.Net(model.words.counts).tables())
    base = np.mean([x.mean_log_prob for x in lm.score(lm.encode(docs_of(held)), flat).collect()])
    assert good > base + 0.5 and good > bad + 0.5
    assert [(rows[40 + k].n_words, rows[40 + k].log_prob) for k in (0, 1)] == [(0, 0.0), (0, 0.0)] and rows[43].n_words == 15_000
    assert rows[44].n_words == 3 and rows[44].mean_log_prob < good
    # the sum, term by term, from words and tables alone
    text, words, net = held[0].split(), model.words, model.net()
    ids = [int(words.ids((hash_distinct(pa.array([w])) >> np.uint64(32)).astype(np.uint32))[0]) for w in text]
    share = (words.counts + 0.5) / (words.counts + 0.5).sum()
    drawn = [min(int(np.flatnonzero(np.cumsum(share) >= (k + 0.5) / lm.SEEN)[0]), len(share) - 1) for k in range(lm.SEEN)]
    total = 0.0
    for i, w in enumerate(ids):
        near = [ids[j] if 0 <= j < len(ids) else words.size for j in (i - 2, i - 1, i + 1, i + 2)]
        h = np.append(np.tanh(np.concatenate([net.embed[n] for n in near]).astype(float) @ net.dense[:-1] + net.dense[-1]), 1.0)
        others = np.mean([math.exp(h @ net.out[d]) for d in drawn if d != w])
        own = share[w] * math.exp(h @ net.out[w])
        total += math.log(own / (own + (1 - share[w]) * others)) + words.log_share[w]
    assert rows[0].log_prob == pytest.approx(total, rel=1e-4)


def test_training_is_gradient_ascent():
    """One step of the numpy trainer against numerical gradients of the sampled log-likelihood."""
    r = np.random.default_rng(5)
    counts = r.integers(1, 50, 30)
    around, word = r.integers(0, 31, (40, 4)).astype(np.int32), r.integers(0, 30, 40).astype(np.int32)
    net = lm.Net(counts)
    net.out[:] = r.normal(0, 0.5, net.out.shape)
    before = [t.astype(float).copy() for t in net.tables()]
    trainer = lm.Trainer(net)
    drawn, times = net.others(lm.DRAWN, np.random.default_rng(11).random())

    def likelihood(embed, out, dense):
        total = 0.0
        for near, w in zip(around, word, strict=True):
            h = np.append(np.tanh(np.concatenate([embed[n] for n in near]) @ dense[:-1] + dense[-1]), 1.0)
            rest = sum(t * math.exp(h @ out[d]) for d, t in zip(drawn, times, strict=True) if d != w)
            total += h @ out[w] - math.log(math.exp(h @ out[w]) + rest)
        return total

    def slope(table, *place):
        up, down = ([t.copy() for t in before] for _ in range(2))
        up[table][place] += 1e-5
        down[table][place] -= 1e-5
        return (likelihood(*up) - likelihood(*down)) / 2e-5

    steps = []
    trainer._step = lambda k, rows, grad, n: steps.append((k, rows, grad))
    trainer.take(around, word)
    grads = [np.zeros(t.shape) for t in before]
    for k, rows, grad in steps:
        grads[k][rows] += grad
    for table, place in [(0, (3, 2)), (0, (30, 0)), (1, (5, 1)), (1, (7, lm.HIDDEN)), (1, (int(drawn[0]), 0)), (2, (10, 3)), (2, (64, 2))]:
        assert grads[table][place] == pytest.approx(slope(table, *place), rel=1e-3, abs=1e-4)


def test_every_word_trains_the_model_and_shards_follow_words_alone(spark, docs_of, monkeypatch):
    small_model(monkeypatch)
    r = random.Random(6)
    texts = ["one", "ten words are a short text but each of them", None, *[language(r, 400) for _ in range(120)], *["the same text again and again"] * 300]
    encoded = lm.encode(docs_of(texts, [*range(123), *[None] * 300]))
    n = sum(len(words(t)) for t in texts)
    trained = []
    for parts in ("3", "7"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found, total = lm.count(encoded)
        assert total == n and found.counts.sum() == n and found.distinct.sum() + len(found.head) == len({w for t in texts for w in words(t)})
        trained.append(lm.score(encoded, lm.fit(encoded)).orderBy("doc_id", "n_words").collect())
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert trained[0] == trained[1]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([np.arange(10, dtype="<u4").tobytes()], pa.binary())], ["salt", "words"])
    monkeypatch.setattr(lm.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda _: 0})())
    blocks = list(lm._trained(lm.Words(np.arange(10, dtype=np.uint32), np.ones(26, np.int64), np.ones(16, np.int64)))(iter([batch])))
    assert {b.column(0)[0].as_py(): np.frombuffer(b.column(4)[0].as_py(), np.float32).max() for b in blocks}[2] == 10


def test_words_of_the_model_are_the_most_frequent(docs_of, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 20)
    counts = {f"w{k}": 1 + k * k for k in range(60)}
    found, total = lm.count(lm.encode(docs_of([" ".join(w for w, n in counts.items() for _ in range(n)), None])))
    h = lambda w: int((hash_distinct(pa.array([w])) >> np.uint64(32))[0])
    by = {h(w): n for w, n in counts.items()}
    assert total == sum(counts.values()) and 10 < len(found.head) <= 20
    assert [by[x] for x in found.head.tolist()] == found.counts[: len(found.head)].tolist()
    assert min(by[x] for x in found.head.tolist()) > max(n for x, n in by.items() if x not in set(found.head.tolist()))
    assert found.ids(found.head).tolist() == list(range(len(found.head))) and (found.ids(np.array([h("w1"), 5], np.uint32)) >= len(found.head)).all()


def test_model_of_nothing(docs_of, monkeypatch):
    small_model(monkeypatch)
    model = lm.fit(lm.encode(docs_of([None, ""])))
    assert lm.score(lm.encode(docs_of([])), model).count() == 0 and lm.score(lm.encode(docs_of(["a b"])), model).first().n_words == 2


def test_shards_are_averaged_by_what_they_met():
    rows = [np.array([0, 2], np.int32), np.array([2], np.int32)]
    met, own = [np.array([1, 1], np.float32), np.array([3], np.float32)], [np.full((2, 3), 4, np.float32), np.full((1, 3), 8, np.float32)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in ([0, 0], [2048, 2048], [0, 1], *([a.tobytes() for a in x] for x in (rows, met, own)))], ["table", "block", "part", "rows", "met", "own"])
    (out,) = lm._mean(iter([batch]))
    assert np.frombuffer(out.column(2)[0].as_py(), np.int32).tolist() == [0, 2] and np.frombuffer(out.column(3)[0].as_py(), np.float32).tolist() == [4.0] * 3 + [7.0] * 3


def test_split_words_and_their_hashes(rng):
    texts = [None, "", " \t", " a  B\x0b\x0cc\x1cd ", "É é", "x" * 200, " ".join(rng.choices(["a", "b", "ab", "é"], k=50)), "y" * 65, "\xa0z"]
    distinct, places, counts = split_words(pa.array(texts))
    found = distinct.to_pylist()
    assert counts.tolist() == [len(words(t)) for t in texts] and [found[k] for k in places] == [w.decode() for t in texts for w in words(t)]
    hashes = hash_distinct(distinct)
    alone = {w: int(hash_distinct(pa.array([w]))[0]) for w in found}
    assert hashes.tolist() == [alone[w] for w in found] and len(set(hashes.tolist())) == len(found)
    assert hash_distinct(pa.array(["skip", "a", "b"])[1:]).tolist() == [alone["a"], alone["b"]] and len(hash_distinct(pa.array([], pa.string()))) == 0


# --- pipeline ------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, docs_of, tmp_path):
    import corpus_pipeline

    r = random.Random(6)
    p = prose(r, 80, 3000)
    items = [(i, prose(r, 30, 3000)) for i in range(4)]
    texts = [prose(r, r.randrange(60, 300), 3000) for _ in range(25)]
    texts += [f"{prose(r, 90, 3000)} {p} {prose(r, 90, 3000)}" for _ in range(4)] + [edited(r, texts[0], 2), texts[1], None, "", "short", "# " * 90, texts[2].upper() + " X"]
    texts += [f"{prose(r, 60, 3000)} {t} {prose(r, 5, 3000)}" for _, t in items]
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, ITEM).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        frame.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        seen[name] = frame
    own = dict(enumerate(texts))
    good = {x.doc_id for x in quality.apply_policy(quality.ledger(docs), quality.FULL).where("kept").collect()}
    own = {i: t for i, t in own.items() if i in good}
    assert {x.doc_id for x in seen["quality_rules"].collect()} == set(own)
    ids = sorted(own)
    comp = components([own[i] for i in ids])
    own = {i: own[i] for k, i in enumerate(ids) if comp[k] == k}
    assert {x.doc_id for x in seen["near_dedup"].collect()} == set(own)
    rows = sorted(own.items())
    gone = repeated(rows)
    left = {i: [w for k, w in enumerate(t.encode().split()) if k not in g] for (i, t), g in zip(rows, gone, strict=True)}
    got = {x.doc_id: x.text for x in seen["suffix_dedup"].collect()}
    assert {i: t.encode().split() for i, t in got.items()} == {i: w for i, w in left.items() if w}
    assert sum(bool(g) for g in gone) == 3
    clean = {i: t for i, t in got.items() if not contaminated(t, items)}
    assert {x.doc_id for x in seen["decontamination"].collect()} == set(clean) and len(clean) == len(got) - 4
    for name in ("quality_rules", "near_dedup", "suffix_dedup", "decontamination"):
        assert seen[name].columns == docs.columns
    out = seen["best_fit_packing"].collect()
    assert {x.doc_id for x in out} == set(clean)
    want = dict(zip(clean, packing.Ids(packing.tokenizer_file()).of(pa.array(list(clean.values()), pa.string()))[1].tolist(), strict=True))
    have = Counter()
    for x in out:
        have[x.doc_id] += x.length
    assert have == want
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(out)
    assert words("x") == [b"x"] and "corpus_pipeline" in sys.modules
