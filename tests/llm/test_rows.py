"""Operators that judge rows one by one: quality rules, chats, URLs, WARC, sharding, packing."""

import io
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import prose, words
from pyspark.sql import functions as F

from inkmesh.llm import chat, common, packing, quality, sharding, urls, warc

ODD = [None, "", " \n\t", "a", "a b c a b c a b c", "É é 😀 \x0b x", "x\n\nx\nx \n" * 30, "# $ % & | < > *", "w " * 20_000]


# --- quality -------------------------------------------------------------------------------


def measured(text):
    t = text or ""
    w = t.encode().split()
    w = [x.decode() for x in w]
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_quality_measurements(docs_of, rng):
    texts = ODD + [prose(rng, rng.randrange(200), 6) for _ in range(60)]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.ledger(docs_of(texts)).collect()}
    assert got == {i: measured(t) for i, t in enumerate(texts)}


def test_policies_and_ablations(docs_of, rng):
    entries = quality.ledger(docs_of([*ODD, prose(rng, 100), prose(rng, 100) + " ####" * 20]))
    kept = {p.version: quality.apply_policy(entries, p).where("kept").count() for p in (quality.BASE, quality.FULL)}
    rows = {r.without: r for r in quality.ablations(entries, quality.FULL).collect()}
    assert rows[None].kept_docs == kept[2] and rows[None].gained == 0
    for rule in quality.FULL.rules:
        less = quality.Policy(9, tuple(r for r in quality.FULL.rules if r != rule))
        assert rows[rule].kept_docs == quality.apply_policy(entries, less).where("kept").count() == kept[2] + rows[rule].gained


def test_kept_rows_keep_their_columns(docs_of, rng):
    docs = docs_of([prose(rng, 80), None], [1, None]).withColumns({"row": F.lit(1), "m": F.lit(2), "failed_bits": F.lit(3), "kept": F.lit("x")})
    assert [r.asDict() for r in quality.keep(docs).collect()] == [r.asDict() for r in docs.where("doc_id = 1").collect()]
    assert quality.keep(docs.limit(0)).count() == 0 and quality.ledger(docs.limit(0)).count() == 0


# --- chats ---------------------------------------------------------------------------------


def chats_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_chats_read_back(spark, rng):
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "&lt;", "&amp;", "&lb;", "&", "<", "[", "a", "\n", "é"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "", "<s>[INST]x"]), "".join(rng.choices(bits, k=12))) for c in range(40) for t in range(rng.randrange(1, 7))]
    rows += [(99, 0, None, None), (99, None, "user", ""), (None, 1, "user", "x"), (7, 0, "user", "same"), (7, 0, "user", "same")]
    out = chat.format_chats(chats_of(spark, rows))
    got = {r.conv_id: (r.turns, r.loss) for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c), key=lambda x: (x[:2], x[2].encode(), x[3].encode()))
        assert [tuple(t) for t in got[c][0]] == [x[2:] for x in own]
        assert got[c][1] == "".join(x[3] for x in own if x[2] == "assistant")


@pytest.mark.parametrize(
    ("roles", "valid", "bad"),
    [("ua", True, None), ("sua", True, None), ("uaua", True, None), ("u", False, 1), ("a", False, 0), ("us", False, 1), ("uaa", False, 2), ("usa", False, 1)],
)
def test_turn_order(spark, roles, valid, bad):
    names = {"u": "user", "a": "assistant", "s": "system"}
    r = chat.format_chats(chats_of(spark, [(1, i, names[x], "t") for i, x in enumerate(roles)])).first()
    assert (r.valid, r.bad_turn) == (valid, bad)


def test_no_chats(spark):
    assert chat.format_chats(chats_of(spark, [])).count() == 0


def test_chats_with_clashing_columns_and_long_texts(spark):
    long = "</s>[INST] & é " * 60_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", "a" * 500_000), (2, 0, "assistant", None)]
    chats = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumns({c: F.lit(1) for c in ("t", "turns", "segments", "end", "formatted", "loss")})
    out = {r.conv_id: r for r in chat.format_chats(chats).select("conv_id", "valid", "bad_turn", chat.read_turns(F.col("formatted")).alias("back"), F.length(chat.loss_text(F.col("segments"))).alias("n")).collect()}
    assert [tuple(x) for x in out[1].back] == [("user", long), ("assistant", "a" * 500_000)] and out[1].n == 500_000 and out[1].valid
    assert (out[2].valid, out[2].bad_turn, out[2].n) == (False, 0, 0)
    assert chat.format_chats(chats.limit(0)).count() == 0


# --- URLs ----------------------------------------------------------------------------------


def rule_of(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(h + p, v) for v, h, p in urls.LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))


URLS = [None, "", "nothing", "http://", "HTTP://A.Net", "http://a.net/", "x://example.net/en/a?b#c", "x://sub.example.net/en", "http://example.com/de/1", "http://notexample.com/de/1", "http://a.org/fr/", "http://a.org?fr/", "http://a.b#://net/", "http://É.NET/x\ny?z", "a://b://c.net/"]


def test_listed_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
    none = spark.createDataFrame([], "rule_id bigint, items array<string>, rarest string, confidence double, support double")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, none).collect()}
    assert got == {i: (*rule_of(u)[:3], rule_of(u)[3] or "allow") for i, u in enumerate(URLS)}


def test_mined_rules_against_a_count(spark, rng):
    sites = ["spam.example.io/buy", "blog.example.io/news", "shop.example.io/buy", "spam.example.io/news"]
    rows = [(f"http://{s}/{i}?ref=x", s == sites[0] or rng.random() < 0.05) for i in range(400) for s in [rng.choice(sites)]]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    found = urls.mine_rules(labelled).collect()
    tokens = {u: set(t) for u, t in labelled.select("url", urls.tokens(F.col("url"))).distinct().collect()}
    assert {"h:spam", "p:buy"} in [set(r.items) for r in found]
    for r in found:
        hit = [bad for u, bad in rows if set(r.items) <= tokens[u]]
        assert r.confidence == pytest.approx(sum(hit) / len(hit)) and r.confidence >= urls.MIN_CONFIDENCE
        assert not any(set(o.items) < set(r.items) and o.confidence >= r.confidence for o in found)
    rules = spark.createDataFrame(found, "rule_id bigint, items array<string>, rarest string, confidence double, support double")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)] + [(1000, rows[0][0])], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, rules).collect()}
    assert got == {i: "block" if any(set(r.items) <= tokens[u] for r in found) else "allow" for i, u in pages.collect()}


@pytest.mark.parametrize("wide", [0, 3, urls.WIDE])
def test_all_rules_over_the_thresholds_are_found(spark, wide):
    """Every combination of tokens is counted; those as sure as none inside them are the rules, by FP-growth, level by level, and by both."""
    r = random.Random(wide)
    rows = []
    for _ in range(500):
        parts = [r.choice("abc"), r.choice("de"), r.choice(["f", "g", ""])]
        bad = r.random() < (0.9 if {"a", "e"} <= set(parts) else 0.7 if "f" in parts and "b" in parts else 0.1)
        rows.append((f"http://{parts[0]}.io/{parts[1]}?{parts[2]}=1", bad))
    rows += [(None, True), ("no url", True), (None, None), ("http://a.io/d", None)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    found = {tuple(x.items): (x.confidence, x.support) for x in urls.mine_rules(labelled, wide=wide).collect()}
    tokens = {x.url: x.t for x in labelled.select("url", urls.tokens(F.col("url")).alias("t")).distinct().collect()}
    held, n = {}, 0
    for url, bad in rows:
        n += bool(bad or tokens[url])
        for k in range(1, len(tokens[url]) + 1):
            for own in itertools.combinations(tokens[url], k):
                held.setdefault(own, []).append(bool(bad))
    least = max(math.ceil(urls.MIN_SUPPORT * n), min(urls.MIN_ROWS, n), 1)
    sure = {own: (sum(b) / len(b), sum(b) / n) for own, b in held.items() if sum(b) >= least and sum(b) / len(b) >= urls.MIN_CONFIDENCE}
    want = {own: c for own, c in sure.items() if not any(set(x) < set(own) and y[0] >= c[0] for x, y in sure.items())}
    assert set(found) == set(want) and len(want) > 2 and all(found[k] == pytest.approx(want[k]) for k in want)


def test_signs_deep_in_a_url_are_mined(spark):
    deep = ["http://x.a.b.c.d.io/1?ref=x", "http://a.io/1/b/c/d/e/x?ref=x", "http://a.io/1?k=1&l=2&m=3&n=4&x=5"]
    good = [u.replace("x.a", "a").replace("/x?", "?").replace("&x=5", "") for u in deep]
    labelled = spark.createDataFrame([(u, True) for u in deep for _ in range(10)] + [(u, False) for u in good for _ in range(20)], "url string, bad boolean")
    rules = urls.mine_rules(labelled)
    assert sorted(tuple(r.items) for r in rules.collect()) == [("h:x",), ("p:x",), ("q:x",)]
    pages = spark.createDataFrame(list(enumerate(deep + good)), "page_id bigint, url string")
    assert [r.verdict for r in urls.judge(pages, rules, ()).orderBy("page_id").collect()] == ["block"] * 3 + ["allow"] * 3


def test_long_urls_of_one_template_are_mined(spark):
    chain = [("http://a.io/" + "/".join("abcdefghijklmnopqrstuvwxyz"[:k]) + "?" + "&".join(f"k{'x' * i}=1" for i in range(40)), k > 20) for k in range(1, 27) for _ in range(10)]
    found = urls.mine_rules(spark.createDataFrame(chain, "url string, bad boolean")).collect()
    assert ("p:u",) in [tuple(r.items) for r in found] and all(len(r.items) == 1 for r in found)


def test_one_wide_url_leaves_the_others_to_fp_growth(spark, monkeypatch):
    """Combinations of narrow URLs, of wide ones, and such as only both together hold often enough."""
    seen = []
    listed = urls._listed
    monkeypatch.setattr(urls, "_listed", lambda sets, least: seen.append(sets.count()) or listed(sets, least))
    long = "/".join(f"l{chr(97 + i)}" for i in range(16))
    rows = [(u, bad) for u, bad, n in [
        ("http://a.io/b", True, 30), ("http://a.io/c", False, 40), ("http://d.io/b", False, 40),
        (f"http://e.io/{long}?f=1", True, 6), ("http://e.io/x?f=1", True, 6), ("http://e.io/y", False, 20), ("http://g.io/y?f=1", False, 20),
        (f"http://z.io/{long}", False, 30),
    ] for _ in range(n)]
    found = {tuple(r.items): r.support for r in urls.mine_rules(spark.createDataFrame(rows, "url string, bad boolean")).collect()}
    assert seen and seen[0] > 1
    assert found == {("h:a", "p:b"): pytest.approx(30 / 192), ("h:e", "q:f"): pytest.approx(12 / 192)}


def test_urls_with_clashing_columns_ties_and_great_length(spark):
    rules = spark.createDataFrame([(1, ["p:a"], "p:a", 0.8, 0.1), (2, ["p:b"], "p:b", 0.8, 0.1), (3, ["p:a", "p:c"], "p:c", 0.9, 0.1)], "rule_id bigint, items array<string>, rarest string, confidence double, support double")
    long = "http://x.io/" + "z/" * 100_000 + "b"
    pages = spark.createDataFrame([(1, "http://x.io/a/b"), (2, "http://x.io/c/a"), (3, long), (None, "http://x.io/a"), (4, None)], "page_id bigint, url string").withColumns({c: F.lit("q") for c in ("tokens", "key", "mined", "host", "heap")})
    got = {r.page_id: (r.verdict, r.mined) for r in urls.judge(pages, rules, ()).collect()}
    assert got == {1: ("block", "p:b"), 2: ("block", "p:a p:c"), 3: ("block", "p:b"), None: ("block", "p:a"), 4: ("allow", None)}


def test_a_url_in_very_many_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "PIECE", 10)
    pages = spark.createDataFrame([(i, "http://x.io/a" if i % 3 else f"http://x.io/{i}" if i else None) for i in range(300)], "page_id bigint, url string")
    rules = spark.createDataFrame([(1, ["p:a"], "p:a", 0.8, 0.1)], "rule_id bigint, items array<string>, rarest string, confidence double, support double")
    got = {r.page_id: r.verdict for r in urls.judge(pages, rules, ()).collect()}
    assert got == {i: "block" if i % 3 else "allow" for i in range(300)}


def test_no_labels_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.io/x"), (None, None)], "page_id bigint, url string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rules = urls.mine_rules(urls.labelled_urls(pages, labels))
    assert rules.count() == 0 and urls.judge(pages, rules).count() == 2


# --- WARC ----------------------------------------------------------------------------------

PAGES = [(1, "http://a/", "<html><head><title> T\n&amp; u</title></head><body><script>no</script><p>A <b>b</b></p><!-- c --><a href=\"/x\">l</a><a href=\"/x\">m</a>&lt;p&gt;</body></html>"), (2, None, None), (None, "u", "plain é"), (1, "http://a/", "again")]


def test_derivatives_are_linked_and_readable(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    source = warc.responses(pages)
    made = warc.derive(source)
    by = {(r.page_id, r.target_uri, r.type, warc_header(r, "WARC-Refers-To")): r for r in made.collect()}
    assert len(by) == 8
    ids = {r.record_id for r in source.collect()}
    assert {warc_header(r, "WARC-Refers-To") for r in by.values()} == ids and len(ids) == 4
    first = next(r for r in source.collect() if b"<b>b" in bytes(r.block))
    text = by[1, "http://a/", "conversion", first.record_id]
    assert bytes(text.block).decode() == "T & u\nA b\nlm<p>"
    meta = bytes(by[1, "http://a/", "metadata", first.record_id].block).decode()
    assert f"conversion: {text.record_id}\r\n" in meta and meta.count("outlink: /x") == 1 and warc_header(first, "WARC-Payload-Digest") in meta and "source-header: Content-Type: text/html" in meta
    raw = b"".join(bytes(r.bytes) for r in warc.to_bytes(source.unionByName(made)).collect())
    for blob, name in ((raw, "a.warc"), (raw, "b.warc.gz")):
        import gzip

        (tmp_path / name).write_bytes(gzip.compress(blob) if name.endswith("gz") else blob)
        back = list(warc.parse_warc(io.BufferedReader(io.BytesIO((tmp_path / name).read_bytes()))))
        assert len(back) == 12 and {b[1] for b in back} == ids | {r.record_id for r in by.values()}
    again = warc.read_warc(spark, str(tmp_path / "a.warc"))
    assert sorted(map(str, again.collect())) == sorted(map(str, warc.read_warc(spark, str(tmp_path / "b.warc.gz"), stream=False).collect()))
    assert sorted(bytes(r.block) for r in again.where("type <> 'response'").collect()) == sorted(bytes(r.block) for r in by.values())
    assert warc.derive(again).count() == 8
    odd = warc.derive(again.withColumns({"text": F.lit("x"), "title": F.lit("y"), "r": F.lit(1), "kept": F.lit(2)}))
    assert odd.count() == 8 and {r.text for r in odd.collect()} == {"x"}
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def chunked(raw, size=7):
    return b"".join(b"%x;x=1\r\n%s\r\n" % (len(raw[i : i + size]), raw[i : i + size]) for i in range(0, len(raw), size)) + b"0\r\n\r\n"


def test_bodies_by_charset_and_coding(spark):
    import gzip
    import zlib

    page = "<p>caf\u00e9 \u2019x\u2019</p>"
    utf, win = page.encode(), page.encode("cp1252")
    deflate = zlib.compressobj(wbits=-15)
    raw = deflate.compress(utf) + deflate.flush()
    own = "caf\u00e9 \u2019x\u2019"
    cases = [
        (b"Content-Type: text/html; charset=ISO-8859-1", win, own), (b"content-type: text/html;charset='windows-1252'", win, own), (b"Content-Type: text/html; charset=nonsense", utf, own),
        (b"Content-Type: text/html", b"a\xffb\xc3", "a\ufffdb\ufffd"), (b"Content-Encoding: gzip", gzip.compress(utf), own), (b"Content-Encoding: gzip", gzip.compress(utf * 500)[:60], None),
        (b"Content-Encoding: deflate", zlib.compress(utf), own), (b"Content-Encoding: deflate", raw, own), (b"Transfer-Encoding: chunked", chunked(utf), own), (b"Transfer-Encoding: chunked", utf, own),
        (b"transfer-encoding: chunked\r\nContent-Encoding: gzip\r\nContent-Type: text/html; charset=latin1", chunked(gzip.compress(win)), own), (b"Content-Encoding: br", b"\x8b\x02", ""), (b"Content-Encoding: gzip", b"no gzip", ""),
        (b"X: y", b"", ""),
    ]
    rows = [("response", f"<{i}>", "u", "d", [("WARC-Payload-Digest", "p")], b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body, i) for i, (head, body, _) in enumerate(cases)]
    rows += [("response", "<98>", "u", "d", [], b"no empty line \xe9", 98), ("response", "<99>", "u", "d", [], b"", 99), ("response", None, None, None, None, None, 97), ("request", "<96>", "u", "d", [], b"x", 96)]
    records = spark.createDataFrame(rows, warc.RECORD + ", http_head int")
    made = warc.derive(records).collect()
    got = {r.http_head: bytes(r.block).decode() for r in made if r.type == "conversion" and r.block is not None}
    assert {i: got[i] for i, c in enumerate(cases) if c[2] is not None} == {i: c[2] for i, c in enumerate(cases) if c[2] is not None}
    assert got[98] == "no empty line \ufffd" and got[99] == "" and 96 not in got and len(made) == 2 * (len(cases) + 3)
    assert all(warc_header(r, "WARC-Source-Payload-Digest") == "p" for r in made if r.http_head < 90)


def test_character_references(spark):
    import html as standard

    texts = ["&#8217;x &eacute;", "&amp;copy; &copy", "&#x1F600;&#X41;&#65;", "&nosuch; &;&#; & &&amp;", "&#xD800;&#0;&#99999999;", "&#150;&apos;&quot;&hellip;", "a&lt;b&gt;", "", None, "&amp;" * 2000]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(warc.unescaped(F.col("t")).alias("t")).collect()]
    assert got[4] == "\ufffd" * 3 and got[1] == "&copy; &copy" and got[8] is None
    assert [g for k, g in enumerate(got) if k not in (1, 4, 8)] == [standard.unescape(t) for k, t in enumerate(texts) if k not in (1, 4, 8)]


def warc_header(r, name):
    return next((h["value"] for h in r.headers if h["name"] == name), None)


# --- sharding ------------------------------------------------------------------------------


def test_shards_have_near_equal_bytes_and_gapless_places(docs_of, rng):
    texts = ["x" * int(10 ** rng.uniform(0, 4)) for _ in range(3000)] + [None, "é"]
    docs = docs_of(texts).withColumns({"shard": F.lit("s"), "at": F.lit(1), "slot": F.lit(0)})
    rows = sharding.records(docs)
    size, counts = sharding.slot_sums(rows)
    m = sharding.SlotMap.first(24).rebalanced(size)
    out = sharding.assign(rows, m, counts).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    assert all(r["size"] == len((texts[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in out)
    total = Counter()
    for r in out:
        total[r["shard"]] += r["size"]
    assert max(total.values()) - min(total.values()) <= 0.001 * sum(total.values()) / 24
    for s in range(24):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_maps_are_versioned_and_edits_are_few(spark, tmp_path, rng):
    size = np.array([rng.randrange(1, 1000) for _ in range(512)])
    one = sharding.SlotMap.first(8, 512)
    two = one.rebalanced(size)
    grown = size.copy()
    grown[:5] += 3000
    three = two.rebalanced(grown)
    weights = np.bincount(three.shards, grown, 8)
    assert weights.max() - weights.min() <= 0.01 * weights.mean()
    assert sum(a != b for a, b in zip(two.shards, three.shards, strict=True)) < 128
    for m in (one, two, three):
        m.save(spark, str(tmp_path / "maps"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "maps")) == three and sharding.SlotMap.load(spark, str(tmp_path / "maps"), 2) == two


    with pytest.raises(Exception, match="(?i)already.exists"):
        two.save(spark, str(tmp_path / "maps"))
    two.rows(spark).limit(500).drop("version").write.parquet(str(tmp_path / "maps" / "version=4"))
    with pytest.raises(ValueError, match="not whole"):
        sharding.SlotMap.load(spark, str(tmp_path / "maps"))


def plainly_rebalanced(shards, sizes, n):
    """All moves and swaps of the heaviest and the lightest shard are tried; the one nearest to half the gap is made."""
    shards = list(shards)
    while True:
        weight = [sum(z for s, z in zip(shards, sizes, strict=True) if s == k) for k in range(n)]
        high, low = weight.index(max(weight)), weight.index(min(weight))
        gap, best = weight[high] - weight[low], None
        for i in (i for i, s in enumerate(shards) if s == high):
            for j in (None, *(j for j, s in enumerate(shards) if s == low)):
                moved = sizes[i] - (sizes[j] if j is not None else 0)
                if 0 < moved < gap and (best is None or abs(moved - gap / 2) < best[0]):
                    best = abs(moved - gap / 2), i, j
        if best is None:
            return tuple(shards)
        shards[best[1]] = low
        if best[2] is not None:
            shards[best[2]] = high


def test_shards_by_the_plain_rule(docs_of, rng):
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(200)] + [None, "", "same", "same"]
    docs = docs_of(texts, [*range(200), None, -5, 7, 7])
    rows = sharding.records(docs, n_slots=40)
    size, counts = sharding.slot_sums(rows, 40)
    sizes = [int(z) * 1000 + k for k, z in enumerate(size)]  # no ties
    m = sharding.SlotMap.first(4, 40).rebalanced(np.array(sizes))
    assert m.shards == plainly_rebalanced(sharding.SlotMap.first(4, 40).shards, sizes, 4)
    out, place = sharding.assign(rows, m, counts).collect(), Counter()
    key = lambda r: (r.vslot, r.part, r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"], r["slot"])
    assert len(out) == len(texts)
    for r in sorted(out, key=key):
        assert r["shard"] == m.shards[r.vslot] and r["slot"] == place[r["shard"]]
        place[r["shard"]] += 1


@pytest.mark.parametrize("hot", [7, None])
def test_an_id_in_a_third_of_all_rows_is_dealt_out(spark, tmp_path, docs_of, rng, hot):
    texts = [prose(rng, 30) for _ in range(600)]
    docs_of(texts + ["the same"] * 300, [*range(600), *[hot] * 300]).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = sharding.op8_sharding(spark, str(tmp_path)).collect()
    total = Counter()
    for r in out:
        total[r["shard"]] += r["size"]
    assert len(out) == 900 and set(total) == set(range(24)) and max(total.values()) - min(total.values()) <= 0.05 * sum(total.values()) / 24
    assert sorted((r["shard"], r["slot"]) for r in out) == [(s, k) for s in range(24) for k in range(sum(r["shard"] == s for r in out))]
    assert len({r["shard"] for r in out if r.doc_id == hot}) > 12


def test_no_rows_to_shard(docs_of):
    rows = sharding.records(docs_of([]))
    size, counts = sharding.slot_sums(rows)
    assert sharding.assign(rows, sharding.SlotMap.first(24).rebalanced(size), counts).count() == 0


# --- packing -------------------------------------------------------------------------------


def check_packed(rows, lengths):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= packing.LENGTH
    assert len(by) <= -(-sum(lengths) // packing.LENGTH) * 1.1 + 1


def test_pieces_are_those_of_whole_texts(docs_of, rng):
    from tokenizers import Tokenizer

    bits = ["The", "the", "don't", "É", "é,", "<|endoftext|>", "<|ENDOFTEXT|>", "a|b", "x1.", "12,", "日本", "😀!", "I'LL", " ", "​", "ß:", "İ", "Σ", "-", "e\u0301", "ÀÉx!!&&&", "_a_", "'s", "x'", "\u1e9e", "a\x1fb", "a\xa0b", "ª."]
    texts = [None, "", " ", *[" ".join(rng.choices(bits, k=rng.randrange(60))) for _ in range(120)], prose(rng, 6000)]
    docs = docs_of(texts).withColumns({"open": F.lit(1), "length": F.lit("x")})
    rows = packing.pack(docs).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    want, lengths = {}, []
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        lengths.append(len(ids))
        for k in range(0, len(ids), packing.LENGTH):
            want[i, k // packing.LENGTH] = (k, len(ids[k : k + packing.LENGTH]), zlib.crc32(ids[k : k + packing.LENGTH].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    check_packed(rows, lengths)
    assert packing.pack(docs_of([])).count() == 0


def test_packer_against_a_plain_best_fit(rng):
    sizes = [rng.randrange(1, 101) for _ in range(2000)]
    packer, closed = packing.Packer(7, 100), []
    bins, nxt, done = [], 0, []  # (free, arrival in this free space, items), the plain way
    stamp = 0
    for k, n in enumerate(sizes):
        closed += packer.put(k, n)
        fits = [b for b in bins if b[0] >= n]
        stamp += 1
        if fits:
            best = max((b for b in fits if b[0] == min(x[0] for x in fits)), key=lambda b: b[1])
            bins.remove(best)
        else:
            best = [100, 0, []]
            nxt += 1
        best[2].append(k)
        best[0], best[1] = best[0] - n, stamp
        if best[0] == 0:
            done.append(best[2])
            continue
        bins.append(best)
        if len(bins) > 7:
            full = max((b for b in bins if b[0] == min(x[0] for x in bins)), key=lambda b: b[1])
            bins.remove(full)
            done.append(full[2])
    got = {}
    for item, sequence, _ in [*closed, *packer.flush()]:
        got.setdefault(sequence, []).append(item)
    assert sorted(got.values()) == sorted([*done, *(b[2] for b in bins)]) and len(got) == nxt


def test_words_of_a_worker_are_bounded(monkeypatch, rng):
    monkeypatch.setattr(packing, "KEPT_WORDS", 50)
    ids = packing.Ids(packing.tokenizer_file())
    text = prose(rng, 300)
    parts = [ids.of(pa.array([p]))[0][:-1] for p in (text[:500], text[500:])]  # cut inside a word, so only the start is alike
    whole, sizes = packing.Ids(packing.tokenizer_file()).of(pa.array([text]))
    assert np.concatenate(parts)[:100].tolist() == whole[:100].tolist() and sizes.tolist() == [len(whole)]
    assert len(ids.row) <= 2 + 400


def test_packing_of_repeated_rows_and_null_ids(docs_of):
    rows = packing.pack(docs_of(["a b.", "a b.", "c!?", None], [5, 5, None, None])).collect()
    assert sorted((r.doc_id or -1, r.piece, r.length) for r in rows) == [(-1, 0, 1), (-1, 0, 3), (5, 0, 4), (5, 0, 4)]
    check_packed(rows, [4, 4, 3, 1])
