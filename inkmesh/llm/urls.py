"""URL filters: a list of host and path rules, then mined association rules.

A URL becomes a set of tokens (host labels, path segments, query keys). Labelled URLs
are mined for token combinations that go with bad pages: Spark's FP-growth lists the
combinations that enough bad URLs hold, good URLs that hold them are counted through
the index below, and a rule stays if its confidence and support suffice and no shorter
rule inside it is as sure. Before, tokens that too few bad URLs hold go, and those that
no good URL holds become rules of one token, as no longer rule can be surer.

FP-growth lists every combination, which is a power of 2 of the tokens that are left of
a URL, so it takes the URLs that have ``WIDE`` of them at most. What the wider ones add is
found level by level: sets grow by a token at a time, and only by tokens that let further
good URLs go, as no other can make a set surer, nor any set that contains it. A combination
that enough bad URLs hold is held by its share of the narrow ones or of the wide ones at
least, so each side lists what its share of the support asks for, and all of it is counted
over both.

The rules match by an inverted index: each is filed under its rarest token, so a
URL only meets rules whose rarest token it has, and is then held against all
their tokens.

Defined results: a null URL, or one without ``://``, has empty host and path, no
tokens and the verdict ``allow``. Rows are judged one by one; repeated rows get
equal verdicts. Of rules that fit equally well (same confidence and length) the last in
order of tokens is named. Long URLs are read whole. Without labelled rows no rule is
mined. Empty tables give empty results, other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.llm.common import dealt_join, durable, few_or_shuffled, lower_ascii, table

#: (verdict, host, path prefix): the longest that fits wins.
LISTED = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Labelled URLs that mining takes, about, where there are more: those whose hash is low enough.
MAX_LABELLED = 500_000
#: Tokens of a URL, after pruning, up to which FP-growth lists their combinations.
WIDE = 12
MIN_SUPPORT = 0.005
#: A rule has to be seen in so many labelled URLs at least, however few there are.
MIN_ROWS = 8
MIN_CONFIDENCE = 0.5


def host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(host_col: Column, path_col: Column, rules=LISTED) -> tuple[Column, Column]:
    """The longest rule that fits (host plus path, null: none), and its verdict."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """Sorted distinct tokens; runs of digits count as one sign."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    filled = lambda x: F.array_remove(x, "")
    labels = filled(F.split(host(url), r"\."))
    segments = filled(F.split(F.regexp_replace(lower_ascii(path(url)), "[0-9]+", "0"), "/"))
    keys = filled(F.transform(F.split(lower_ascii(query), "&"), lambda x: F.substring_index(x, "=", 1)))

    def marked(kind: str, values: Column) -> Column:
        return F.transform(values, lambda t: F.concat(F.lit(kind), t))

    return F.array_sort(F.array_distinct(F.concat(marked("h:", labels), marked("p:", segments), marked("q:", keys))))


def _contained(rules: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of a row of ``sets(key, tokens)`` and a rule whose items it contains, through the index by rarest token."""
    index = rules.select(F.col("rarest").alias("token"), "rule_id", "items", "confidence")
    probes = sets.select("key", "tokens", F.explode("tokens").alias("token"))
    return probes.join(index, "token").where(F.size(F.array_except("items", "tokens")) == 0).select("key", "tokens", "rule_id", "items", "confidence")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, wide: int = WIDE) -> DataFrame:
    """``labelled(url, bad boolean)`` -> ``rule_id, items, rarest, confidence, support``."""
    bad = F.coalesce("bad", F.lit(False))
    rows = labelled.select(tokens(F.col("url")).alias("items"), bad.alias("bad")).where(F.col("bad") | (F.size("items") > 0))
    sets = durable(rows.groupBy("items").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).withColumn("id", F.monotonically_increasing_id()))
    n = sets.agg(F.coalesce(F.sum(F.col("bad") + F.col("good")), F.lit(0))).first()[0]
    least = max(math.ceil(min_support * n), min(MIN_ROWS, n), 1)
    each = sets.select("id", "bad", "good", F.explode("items").alias("token"))
    single = durable(each.groupBy("token").agg(F.sum("bad").alias("n_bad"), F.sum("good").alias("n_good")).where(F.col("n_bad") >= least))
    mixed = each.join(single.where("n_good > 0").select("token"), "token")
    left = durable(mixed.groupBy("id", "bad", "good").agg(F.sort_array(F.collect_list("token")).alias("items")))
    several = _several(left, single, least, wide)
    ones = single.select(F.array("token").alias("items"), "n_bad", "n_good")
    found = ones.union(several).select("items", (F.col("n_bad") / (F.col("n_bad") + F.col("n_good"))).alias("confidence"), (F.col("n_bad") / F.lit(max(n, 1))).alias("support")).where(F.col("confidence") >= min_confidence)
    rules = durable(_filed(found, single))
    # a rule is idle if one that asks for fewer tokens is as sure
    inside = _contained(rules, rules.select(F.struct("rule_id", "confidence").alias("key"), F.col("items").alias("tokens")))
    idle = inside.where((F.col("rule_id") != F.col("key.rule_id")) & (F.size("items") < F.size("tokens")) & (F.col("confidence") >= F.col("key.confidence"))).select(F.col("key.rule_id").alias("rule_id")).distinct()
    return rules.join(idle, "rule_id", "left_anti").select("rule_id", "items", "rarest", "confidence", "support")


def _filed(sets: DataFrame, single: DataFrame) -> DataFrame:
    """``sets(items, ...)`` with ``rule_id`` and ``rarest``, the token of theirs that the fewest URLs hold."""
    numbered = sets.withColumn("rule_id", F.xxhash64(F.array_join("items", "\n")))
    freq = single.select("token", (F.col("n_bad") + F.col("n_good")).alias("freq"))
    rarest = numbered.select("rule_id", F.explode("items").alias("token")).join(freq, "token").groupBy("rule_id").agg(F.min(F.struct("freq", "token"))["token"].alias("rarest"))
    return numbered.join(rarest, "rule_id")


def _several(sets: DataFrame, single: DataFrame, least: int, wide: int) -> DataFrame:
    """``items, n_bad, n_good`` of the combinations of two tokens and more that ``least`` bad URLs hold; some that a shorter one makes idle are left out."""
    is_wide = F.size("items") > wide
    n_narrow, n_wide = sets.agg(*[F.coalesce(F.sum(F.when(side, F.col("bad"))), F.lit(0)) for side in (~is_wide, is_wide)]).first()
    if n_narrow + n_wide < least:
        return sets.select("items", F.col("bad").alias("n_bad"), F.col("good").alias("n_good")).limit(0)
    # a set below its share on both sides is below ``least``
    share = [max(-(-least * n // (n_narrow + n_wide)), 1) for n in (n_narrow, n_wide)]
    narrow = _listed(sets.where(~is_wide), share[0])
    if not n_wide:
        return _counted(narrow, sets, single).where(F.col("n_bad") >= least)
    grown = durable(_grown(sets.withColumn("wide", F.when(is_wide, F.col("bad")).otherwise(0)), least, share[1]))
    others = _counted(narrow.join(grown.select("items"), "items", "left_anti"), sets, single)
    return grown.union(others.where(F.col("n_bad") >= least))


def _listed(sets: DataFrame, least: int) -> DataFrame:
    """``items`` of the combinations of two tokens and more that ``least`` bad URLs hold, by FP-growth."""
    baskets = durable(sets.where("bad > 0").select("items", F.explode(F.sequence(F.lit(1), F.col("bad").cast("int"))).alias("_")).select("items"))
    n = baskets.count()
    if n < least:
        return baskets.limit(0)
    frequent = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n).fit(baskets).freqItemsets
    return frequent.where(F.size("items") > 1).select(F.sort_array("items").alias("items"))


def _counted(found: DataFrame, sets: DataFrame, single: DataFrame) -> DataFrame:
    """``found(items)`` with the bad and good URLs that hold them, through the index."""
    filed = durable(_filed(found, single))
    held = _contained(filed.withColumn("confidence", F.lit(0.0)), sets.select(F.struct("id", "bad", "good").alias("key"), F.col("items").alias("tokens")))
    counts = held.groupBy("rule_id").agg(F.sum("key.bad").alias("n_bad"), F.sum("key.good").alias("n_good"))
    return filed.join(counts, "rule_id").select("items", "n_bad", "n_good")


def _grown(sets: DataFrame, least: int, least_wide: int) -> DataFrame:
    """``items, n_bad, n_good`` of those that ``least_wide`` wide bad URLs hold too, but for sets that a shorter one inside makes idle: from tokens, a token more at a time, from two sets that differ in their last."""
    counts = [F.sum("bad").alias("n_bad"), F.sum("good").alias("n_good"), F.sum("wide").alias("n_wide")]
    holders = sets.select("id", "bad", "good", "wide", F.array().cast("array<string>").alias("rest"), F.explode("items").alias("last"))
    level = durable(holders.groupBy("rest", "last").agg(*counts).where(F.col("n_wide") >= least_wide))
    out = level.limit(0)
    while True:
        # what no good URL has is sure already
        held = durable(holders.join(level.where("n_good > 0").select("rest", "last", "n_good"), ["rest", "last"]))
        a, b = held.alias("a"), held.select("id", "rest", F.col("last").alias("next"), F.col("n_good").alias("next_good")).alias("b")
        longer = a.join(b, ["id", "rest"]).where(F.col("last") < F.col("next"))
        holders = longer.select("id", "bad", "good", "wide", F.array_append("rest", F.col("last")).alias("rest"), F.col("next").alias("last"), F.least("n_good", "next_good").alias("before"))
        enough = (F.col("n_bad") >= least) & (F.col("n_wide") >= least_wide) & (F.col("n_good") < F.col("before"))
        level = durable(holders.groupBy("rest", "last").agg(*counts, F.min("before").alias("before")).where(enough).drop("before"))
        if not level.limit(1).count():
            return out.select(F.array_append("rest", F.col("last")).alias("items"), "n_bad", "n_good")
        holders, out = holders.drop("before"), out.union(level)


def matching_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct URLs that contain a rule, with the surest one: ``url, rule_id, items, confidence``."""
    sets = urls.select(F.col(url_col).alias("key")).where(F.col(url_col).isNotNull()).distinct().select("key", tokens(F.col("key")).alias("tokens"))
    best = F.max(F.struct("confidence", F.negative(F.size("items")).alias("shorter"), "items", "rule_id"))
    rules = durable(rules)
    return _contained(few_or_shuffled(rules, rules.count()), sets).groupBy(F.col("key").alias("url")).agg(best.alias("b")).select("url", "b.rule_id", "b.items", "b.confidence")


def judge(pages: DataFrame, rules: DataFrame, listed=LISTED) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined`` for every row of ``pages(page_id, url)``."""
    hits = matching_urls(pages, rules).select("url", F.array_join("items", " ").alias("mined"))
    rows = dealt_join(pages.select("page_id", "url"), hits, ["url"], ["page_id"], "left")
    name, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    return rows.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "mined").select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined"
    )


def labelled_urls(pages: DataFrame, labels: DataFrame, at_most: int = MAX_LABELLED) -> DataFrame:
    """A label holds for the page of its number; bad: of low quality, or toxic."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    rows = pages.select("page_id", "url").join(marks, "page_id").select("url", bad.alias("bad"), F.xxhash64("page_id", "url").alias("h"))
    n = marks.count()  # so no fewer than rows, but for repeated pages
    low = rows if n <= at_most else rows.where(F.pmod("h", F.lit(1 << 32)) < int((1 << 32) * at_most / n))
    return low.select("url", "bad")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, mine_rules(labelled_urls(pages, table(spark, sf_dir, "labels"))))


#: Every combination of tokens of a bad URL is counted; the surest that a page holds decides.
OP3_SQL = r"""
WITH u AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1) AS query FROM pages),
t AS (
  SELECT *, list_sort(list_distinct(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
    list_transform(list_filter(string_split(regexp_replace(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '/'), lambda x: x <> ''), lambda x: 'p:' || x),
    list_transform(list_filter(list_transform(string_split(translate(query, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '&'), lambda x: split_part(x, '=', 1)), lambda x: x <> ''), lambda x: 'q:' || x)))) AS ts FROM u),
l AS (SELECT doc_id, (coalesce(min(quality), 1) = 0 OR coalesce(max(toxic), 0) = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
r AS (SELECT ts, bad FROM t JOIN l ON doc_id = page_id WHERE bad OR len(ts) > 0),
n AS (SELECT count(*) AS n, greatest(ceil(0.005 * count(*)), least(8, count(*)), 1) AS least FROM r),
s AS (SELECT ts, bad, m, list_filter(ts, lambda x, i: (m >> (i - 1)) & 1 = 1) AS items FROM (SELECT ts, bad, unnest(generate_series(1, (1::BIGINT << len(ts)) - 1)) AS m FROM r)),
c AS (SELECT items, count(*) FILTER (bad) / count(*)::DOUBLE AS confidence FROM s GROUP BY items HAVING count(*) FILTER (bad) >= (SELECT least FROM n) AND count(*) FILTER (bad) / count(*)::DOUBLE >= 0.5),
d AS (SELECT DISTINCT url, ts FROM t WHERE url IS NOT NULL),
b AS (SELECT url, items FROM (SELECT url, items, row_number() OVER (PARTITION BY url ORDER BY confidence DESC, len(items), items DESC) AS k FROM d JOIN c ON list_has_all(ts, items)) WHERE k = 1),
v AS (
  SELECT page_id, host, path, array_to_string(items, ' ') AS mined, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM t LEFT JOIN b USING (url))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR mined IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, mined FROM v
"""
