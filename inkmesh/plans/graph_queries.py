"""Queries over names, links and the graph. Each has its SQL beside it.

The driver's tables stand in for a vault: ``pages`` are wiki pages (titled by the
first word of their ``<title>``) and their root-relative ``href``s are links.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkmesh.operators import graph, health, links, ppr, retrieve
from inkmesh.operators.kept_graph import KeptGraph
from inkmesh.operators.shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, title, kind, aliases, summary, text`` from ``pages``."""
    refs = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))
    lang = F.regexp_extract("html", '<html lang="([a-z]*)"', 1)
    kind = F.when(F.col("page_id") % 3 == 0, "source").when(F.col("page_id") % 3 == 1, "entity").otherwise("concept")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("wiki/"), F.col("page_id").cast("string")).alias("path"),
        F.substring_index(title, " ", 1).alias("title"),
        kind.alias("kind"),
        F.array(F.concat(lang, F.lit("-"), F.col("page_id").cast("string")), F.coalesce(F.get(F.split(title, " "), F.lit(1)), F.lit(""))).alias("aliases"),
        title.alias("summary"),
        F.array_join(F.transform(refs, lambda r: F.concat(F.lit("[["), r, F.lit("|go]]"))), " ").alias("text"),
    )


#: The same as SQL. Titles have no outer white space, so a handle is lower case in NFC.
WIKI = """
pg0 AS (SELECT page_id, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS summary, regexp_extract_all(html, 'href="/([^"]*)"', 1) AS refs FROM pages),
pg AS (
  SELECT 'wiki/' || page_id AS path, split_part(summary, ' ', 1) AS title, summary, refs,
         CASE page_id % 3 WHEN 0 THEN 'source' WHEN 1 THEN 'entity' ELSE 'concept' END AS kind,
         regexp_extract(html, '<html lang="([a-z]*)"', 1) || '-' || page_id AS alias1, split_part(summary, ' ', 2) AS alias2
  FROM pg0),
tg AS (SELECT path, target, min(i) AS i FROM (SELECT path, unnest(refs) AS target, generate_subscripts(refs, 1) AS i FROM pg) WHERE target <> '' GROUP BY ALL),
tgt AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS pos, target, nfc_normalize(lower(target)) AS handle FROM tg),
cl AS (SELECT path, title, title AS name, 0 AS tier, 0 AS pos FROM pg UNION ALL SELECT path, title, alias1, 1, 0 FROM pg UNION ALL SELECT path, title, alias2, 1, 1 FROM pg),
ti AS (
  SELECT handle, title, path FROM (
    SELECT nfc_normalize(lower(name)) AS handle, title, path, row_number() OVER (PARTITION BY nfc_normalize(lower(name)) ORDER BY tier, title, path, pos) AS r FROM cl) WHERE r = 1 AND handle <> ''),
gi AS (
  SELECT handle, path FROM (
    SELECT nfc_normalize(lower(name)) AS handle, path, row_number() OVER (PARTITION BY nfc_normalize(lower(name)) ORDER BY path, tier, pos) AS r FROM cl) WHERE r = 1 AND handle <> ''),
ed AS (SELECT DISTINCT least(t.path, g.path) AS a, greatest(t.path, g.path) AS b FROM tgt t JOIN gi g USING (handle) WHERE t.path <> g.path AND NOT regexp_matches(t.target, '[#^]')),
sy AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed),
dg AS (SELECT pg.path, count(sy.a)::BIGINT AS degree FROM pg LEFT JOIN sy ON sy.a = pg.path GROUP BY pg.path)
"""

NO_RAW = "path string, origin string, seq int, text string"


def built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph.build(wiki(spark, sf_dir), spark.createDataFrame([], NO_RAW))


def link_extract(spark, sf_dir):
    return links.targets(wiki(spark, sf_dir)).select("path", F.col("pos").cast("long").alias("pos"), "target")


def handle_table_titles(spark, sf_dir):
    return links.title_index(wiki(spark, sf_dir))


def handle_table_graph(spark, sf_dir):
    return graph.graph_index(wiki(spark, sf_dir), spark.createDataFrame([], NO_RAW))


def link_resolve(spark, sf_dir):
    w = wiki(spark, sf_dir)
    return links.resolve(links.targets(w), links.title_index(w)).select("path", "target", "title", "to")


def gaps_article_candidates(spark, sf_dir):
    w = wiki(spark, sf_dir)
    return links.unresolved(w, w).select("handle", "display", "n_citers", F.array_join("citers", ",").alias("citers"))


def health_candidates_by_title(spark, sf_dir):
    w = wiki(spark, sf_dir)
    return health.article_candidates(links.unresolved(w, w), w).select("display", "n_titles", F.array_join("titles", ",").alias("titles"))


def graph_edges_distinct(spark, sf_dir):
    return built(spark, sf_dir)[1]


def graph_nodes(spark, sf_dir):
    return built(spark, sf_dir)[0]


def graph_mode(spark, sf_dir):
    return graph.mode(*built(spark, sf_dir))


def health_orphans(spark, sf_dir):
    return graph.orphans(built(spark, sf_dir)[0]).select("path", "title")


def health_counts(spark, sf_dir):
    return health.counts(wiki(spark, sf_dir))


def graph_kept(spark, sf_dir):
    """Edges, and how many links make each, of a kept graph after a change: of seven pages one loses its first link, one has another title, one goes, one comes."""
    w = wiki(spark, sf_dir).withColumn("turn", F.substring_index("path", "/", -1).cast("long") % 7)
    kept = KeptGraph(spark, f"{shared_folder(spark)}/graph-kept-{uuid.uuid4().hex}", buckets=16)
    kept.update(w.where("turn <> 5"))
    text = F.when(F.col("turn") == 1, F.regexp_replace("text", r"^\[\[[^\]]*\]\] ?", "")).otherwise(F.col("text"))
    title = F.when(F.col("turn") == 2, F.concat("title", F.lit("2"))).otherwise(F.col("title"))
    kept.update(w.where("turn IN (1, 2, 5)").withColumns({"text": text, "title": title}), w.where("turn = 3"))
    return kept.edges()


#: The same of the state after the change, built anew.
KEPT_SQL = f"""WITH {WIKI},
st AS (SELECT *, substr(path, 6)::BIGINT % 7 AS turn FROM pg),
nw AS (SELECT path, CASE turn WHEN 2 THEN title || '2' ELSE title END AS title, alias1, alias2, CASE turn WHEN 1 THEN refs[2:] ELSE refs END AS refs FROM st WHERE turn <> 3),
ln AS (SELECT DISTINCT path, nfc_normalize(lower(target)) AS handle FROM (SELECT path, unnest(refs) AS target FROM nw) WHERE target <> '' AND NOT regexp_matches(target, '[#^]')),
nm AS (SELECT path, title AS name, 0 AS pos FROM nw UNION ALL SELECT path, alias1, 1 FROM nw UNION ALL SELECT path, alias2, 2 FROM nw),
ow AS (SELECT handle, path FROM (SELECT nfc_normalize(lower(name)) AS handle, path, row_number() OVER (PARTITION BY nfc_normalize(lower(name)) ORDER BY path, pos) AS r FROM nm) WHERE r = 1 AND handle <> '')
SELECT least(ln.path, ow.path) AS a, greatest(ln.path, ow.path) AS b, count(*)::BIGINT AS n FROM ln JOIN ow USING (handle) WHERE ln.path <> ow.path GROUP BY ALL"""


def part_supplier_degree(spark, sf_dir):
    """Degrees over distinct part-supplier pairs: the largest graph of the tables."""
    pairs = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("x"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("y"))
    edges = graph.distinct_edges(pairs, "x", "y")
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path")).union(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))))
    return graph.degrees(nodes, edges)


# --- links put in place -----------------------------------------------------------------------


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, text``: links of each page without and with a display, then one to its title in capitals, to a source, to a place in itself, and a page of another name."""
    w = wiki(spark, sf_dir)
    named = F.when(F.col("title").rlike("^[A-Za-z]+$"), F.upper("title")).otherwise("x")
    return w.select("path", F.concat(F.lit("see "), F.replace("text", F.lit("|go]]"), F.lit("]]")), F.lit(" and "), "text", F.lit(" [["), named, F.lit("]] [[raw/x.md]] [[#top]] end")).alias("text"))


def link_rewrite(spark, sf_dir):
    """Links by title or alias under the title of their page."""
    return links.rewritten(written(spark, sf_dir), links.title_index(wiki(spark, sf_dir)))


def answer_links(spark, sf_dir):
    """Each page as an answer for which the pages of the next four numbers were retrieved: links elsewhere become text and a marker."""
    w = wiki(spark, sf_dir)
    number = F.substring_index("path", "/", -1).cast("long")
    asked = w.select("path", F.explode(F.sequence(number, number + 3)).alias("n"))
    found = asked.join(w.select(F.col("path").alias("page"), "title", number.alias("n")), "n").select("path", "page", "title")
    return links.validated(written(spark, sf_dir), found, w)


LINKED_SQL = """
rf AS (SELECT path, unnest(refs) AS r, generate_subscripts(refs, 1) AS i FROM pg),
nm AS (SELECT path, title, CASE WHEN regexp_full_match(title, '[A-Za-z]+') THEN upper(title) ELSE 'x' END AS named FROM pg)
"""
REWRITE_SQL = f"""WITH {WIKI}, {LINKED_SQL},
a AS (
  SELECT rf.path, i, CASE WHEN r = '' OR starts_with(r, 'raw/') OR regexp_matches(r, '[#^]') OR ti.title IS NULL OR ti.title = r THEN '[[' || r || ']]' ELSE '[[' || ti.title || '|' || r || ']]' END AS bare,
    CASE WHEN r = '' OR starts_with(r, 'raw/') OR regexp_matches(r, '[#^]') OR ti.title IS NULL THEN '[[' || r || '|go]]' ELSE '[[' || ti.title || '|go]]' END AS shown
  FROM rf LEFT JOIN ti ON ti.handle = nfc_normalize(lower(r))),
b AS (SELECT path, string_agg(bare, ' ' ORDER BY i) AS bare, string_agg(shown, ' ' ORDER BY i) AS shown FROM a GROUP BY path)
SELECT nm.path, 'see ' || coalesce(bare, '') || ' and ' || coalesce(shown, '') || ' [[' || CASE WHEN ti.title IS NULL OR ti.title = named THEN named ELSE ti.title || '|' || named END || ']] [[raw/x.md]] [[#top]] end' AS text
FROM nm LEFT JOIN b USING (path) LEFT JOIN ti ON ti.handle = nfc_normalize(lower(named))"""
ANSWER_SQL = f"""WITH {WIKI}, {LINKED_SQL},
rt AS (SELECT p.path, q.path AS page, nfc_normalize(lower(q.title)) AS th FROM pg p JOIN pg q ON split_part(q.path, '/', 2)::BIGINT BETWEEN split_part(p.path, '/', 2)::BIGINT AND split_part(p.path, '/', 2)::BIGINT + 3),
kn AS (SELECT path, th AS h FROM rt UNION SELECT path, page FROM rt),
bt AS (SELECT nfc_normalize(lower(title)) AS th, max(path) AS page FROM pg GROUP BY 1),
ix AS (SELECT handle AS h, bt.page FROM ti JOIN bt ON bt.th = nfc_normalize(lower(ti.title))),
al AS (SELECT path, r, i FROM rf UNION ALL SELECT path, named, 0 FROM nm UNION ALL SELECT path, 'raw/x.md', -1 FROM nm),
pt AS (SELECT path, i, r, nfc_normalize(lower(r)) AS h, nfc_normalize(lower(regexp_replace(r, '[#^].*$', ''))) AS ph FROM al),
ok AS (
  SELECT path, i, r, r = '' OR ph = '' OR EXISTS (SELECT 1 FROM kn WHERE kn.path = pt.path AND kn.h IN (pt.h, pt.ph)) OR EXISTS (SELECT 1 FROM ix JOIN rt ON rt.page = ix.page WHERE ix.h = pt.ph AND rt.path = pt.path) AS keep FROM pt),
pc AS (SELECT path, i, CASE WHEN keep THEN '[[' || r || ']]' ELSE r || ' <!-- link outside retrieved set: ' || r || ' -->' END AS bare, CASE WHEN keep THEN '[[' || r || '|go]]' ELSE 'go <!-- link outside retrieved set: ' || r || ' -->' END AS shown FROM ok)
SELECT path, 'see ' || coalesce(string_agg(bare, ' ' ORDER BY i) FILTER (WHERE i > 0), '') || ' and ' || coalesce(string_agg(shown, ' ' ORDER BY i) FILTER (WHERE i > 0), '') || ' ' || any_value(bare) FILTER (WHERE i = 0) || ' ' || any_value(bare) FILTER (WHERE i = -1) || ' [[#top]] end' AS text
FROM pc GROUP BY path"""


# --- walks over pages and the terms they link -----------------------------------------

#: The operator's most steps; walks end before it where a step changes less than 1e-8 in all.
SETTLED = 100


def term_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    w = wiki(spark, sf_dir)
    pairs = links.targets(w).select("path", F.concat(F.lit("term/"), F.lower("target")).alias("term"))
    edges = graph.distinct_edges(pairs, "path", "term")
    lone = spark.range(1).select(F.lit("raw/alone.md").alias("path"))
    return w.select("path").union(pairs.select("term")).distinct().union(lone), edges


TERMS = WIKI + """,
te AS (SELECT DISTINCT least(path, 'term/' || lower(target)) AS a, greatest(path, 'term/' || lower(target)) AS b FROM tgt),
tn AS (SELECT path FROM pg UNION SELECT 'term/' || lower(target) FROM tgt UNION SELECT 'raw/alone.md'),
ts AS (SELECT a, b FROM te UNION ALL SELECT b, a FROM te),
td AS (SELECT a AS path, count(*) AS d FROM ts GROUP BY a),
tw AS (SELECT ts.a, ts.b, 0.85::DOUBLE / td.d AS w FROM ts JOIN td ON td.path = ts.a)
"""


def walk_sql(seeds: str, steps: int) -> str:
    """Steps of the walk as a recursive query: flow along edges, and the way back for every node."""
    return f""",
se AS ({seeds}),
tp AS (SELECT qid, tn.path, CASE WHEN se.path IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / n END AS p
       FROM (SELECT qid, count(*) AS n FROM se GROUP BY qid) q CROSS JOIN tn LEFT JOIN se USING (qid, path)),
v(i, qid, path, score) AS (
  SELECT 0, qid, path, p FROM tp
  UNION ALL
  SELECT i, qid, path, sum(x) FROM (
    SELECT v.i + 1 AS i, v.qid, tw.b AS path, v.score * tw.w AS x FROM v JOIN tw ON tw.a = v.path WHERE v.i < {steps}
    UNION ALL
    SELECT v.i + 1, v.qid, v.path, 0.15::DOUBLE * tp.p FROM v JOIN tp USING (qid, path) WHERE v.i < {steps}) GROUP BY i, qid, path)
"""


def settled_sql(seeds: str) -> str:
    """The walk to its end: ``it`` has the step at which it is, ``sc`` the scores there, to six decimals."""
    return walk_sql(seeds, SETTLED) + f""",
de AS (SELECT x.qid, x.i, sum(abs(x.score - y.score)) AS delta FROM v x JOIN v y ON y.qid = x.qid AND y.path = x.path AND y.i = x.i - 1 GROUP BY ALL),
it AS (SELECT qid, coalesce(min(i) FILTER (WHERE delta < 1e-8), {SETTLED})::BIGINT AS iterations, bool_or(delta < 1e-8) AS converged FROM de GROUP BY qid),
sc AS (SELECT qid, path, round(score, 6) AS score FROM v JOIN it USING (qid) WHERE v.i = iterations)
"""


SEEDS_ONE = "SELECT 'one' AS qid, 'wiki/1' AS path"
SEEDS_MANY = "SELECT 'many' AS qid, path FROM pg WHERE kind = 'entity' UNION ALL SELECT 'pair', unnest(['wiki/2', 'wiki/5'])"
SEEDS_ALONE = "SELECT 'alone' AS qid, 'raw/alone.md' AS path"


def walks(spark, sf_dir, seeds: DataFrame, **options) -> DataFrame:
    nodes, edges = term_graph(spark, sf_dir)
    return ppr.run(nodes, edges, seeds, **options)


def seeds_one(spark, sf_dir):
    return spark.createDataFrame([("one", "wiki/1"), ("none", "wiki/no-such-page")], "qid string, path string")


def seeds_many(spark, sf_dir):
    pair = spark.createDataFrame([("pair", "wiki/2"), ("pair", "wiki/5"), ("pair", "wiki/5"), ("pair", "gone")], "qid string, path string")
    return wiki(spark, sf_dir).where("kind = 'entity'").select(F.lit("many").alias("qid"), "path").union(pair)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def ppr_single_seed(spark, sf_dir):
    return _rounded(walks(spark, sf_dir, seeds_one(spark, sf_dir)).select("qid", "path", "score"))


def ppr_multi_seed(spark, sf_dir):
    return _rounded(walks(spark, sf_dir, seeds_many(spark, sf_dir)).select("qid", "path", "score"))


def ppr_distributed(spark, sf_dir):
    """The join-and-sum path that large graphs take, on the same walk."""
    return _rounded(walks(spark, sf_dir, seeds_one(spark, sf_dir), small_edges=0).select("qid", "path", "score"))


def ppr_isolated_seed(spark, sf_dir):
    alone = spark.createDataFrame([("alone", "raw/alone.md")], "qid string, path string")
    return _rounded(walks(spark, sf_dir, alone).select("qid", "path", "score"))


def ppr_snapshots(spark, sf_dir):
    return _rounded(walks(spark, sf_dir, seeds_one(spark, sf_dir), snapshots=True)).withColumn("iter", F.col("iter").cast("long"))


def ppr_topk(spark, sf_dir):
    found = _rounded(walks(spark, sf_dir, seeds_many(spark, sf_dir)).select("qid", "path", "score"))
    return retrieve.top(found, "qid", retrieve.TOP_K).select("qid", "path", "score", F.col("rank").cast("long").alias("rank"))


def ppr_converged(spark, sf_dir):
    """To convergence: how many steps, and whether the change fell under the bound."""
    nodes, edges = term_graph(spark, sf_dir)
    return ppr.run(nodes, edges, seeds_many(spark, sf_dir)).groupBy("qid", F.col("iterations").cast("long").alias("iterations"), "converged").agg(F.round(F.sum("score"), 6).alias("mass"), F.count(F.lit(1)).alias("n_nodes"))


CONVERGED_SQL = f"WITH RECURSIVE {TERMS}{settled_sql(SEEDS_MANY)} SELECT qid, iterations, converged, round(sum(score), 6) AS mass, count(*) AS n_nodes FROM it JOIN v USING (qid) WHERE v.i = iterations GROUP BY ALL"


def overlay_heat(spark, sf_dir):
    nodes, _ = term_graph(spark, sf_dir)
    scores = _rounded(walks(spark, sf_dir, seeds_many(spark, sf_dir)).select("qid", "path", "score"))
    return retrieve.overlay(nodes, scores, seeds_many(spark, sf_dir)).withColumn("heat", F.round("heat", 5))


def scrubber_frames(spark, sf_dir):
    """The best three of each step of a walk, with heat scaled to that step."""
    frames = _rounded(walks(spark, sf_dir, seeds_one(spark, sf_dir), snapshots=True)).withColumn("frame", F.col("iter").cast("long"))
    return retrieve.top(retrieve.peak_normalized(frames, "frame"), "frame", 3).select("frame", "path", F.round("heat", 5).alias("heat"), F.col("rank").cast("long").alias("rank"))


def label_choice(spark, sf_dir):
    """Ten labels where nothing is lit: by degree."""
    nodes, _ = built(spark, sf_dir)
    return retrieve.labels(nodes.select("path", "degree", F.lit(0.0).alias("score"), F.lit(False).alias("lit"))).select("path", "degree", F.col("rank").cast("long").alias("rank"))


def label_choice_lit(spark, sf_dir):
    """Ten labels where a walk has lit nodes: lit ones by score."""
    nodes, edges = built(spark, sf_dir)
    asked = retrieve.force_include(wiki(spark, sf_dir), spark.createDataFrame(QUESTIONS[:1], "qid string, question string"))
    scores = _rounded(ppr.run(nodes, edges, asked).select("path", "score"))
    lit = nodes.join(scores, "path", "left").select("path", "degree", F.coalesce("score", F.lit(0.0)).alias("score"), (F.coalesce("score", F.lit(0.0)) > 0).alias("lit"))
    return retrieve.labels(lit).select("path", "score", F.col("rank").cast("long").alias("rank"))


def node_radius(spark, sf_dir):
    return built(spark, sf_dir)[0].select("path", F.round(graph.node_radius(F.col("degree")), 6).alias("radius"))


def layout_seed(spark, sf_dir):
    """Where a layout starts: a point for each node from its path."""
    at = graph.seed_position(F.col("path"))
    return built(spark, sf_dir)[0].select("path", at.alias("p")).select("path", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def trace_labels(spark, sf_dir):
    """Labels of a trace mapped back to nodes: paths, titles in another case, and what is gone."""
    nodes, _ = built(spark, sf_dir)
    labels = wiki(spark, sf_dir).select(F.concat(F.lit("t"), "path").alias("pos"), F.concat(F.lit(" "), "title", F.lit(" ")).alias("label")).union(wiki(spark, sf_dir).select("path", "path")).union(wiki(spark, sf_dir).select(F.concat(F.lit("x"), "path"), F.concat(F.lit("gone "), "path")))
    return links.resolve_labels(labels, nodes)


def filter_box(spark, sf_dir):
    w = wiki(spark, sf_dir)
    return w.where(retrieve.matches_filter(F.col("title"), F.col("path"), F.lit(" TH "))).select("path", "title")


def mention_graph(spark, sf_dir):
    """Each question's seeds and the pages one and two links away, with their distance."""
    w = wiki(spark, sf_dir)
    _, edges = built(spark, sf_dir)
    both = graph.symmetric(edges)
    start = retrieve.force_include(w, spark.createDataFrame(QUESTIONS, "qid string, question string")).select("qid", "path", F.lit(0).alias("distance"))
    one = start.join(both, F.col("path") == F.col("a")).select("qid", F.col("b").alias("path"), (F.col("distance") + 1).alias("distance")).distinct()
    two = one.join(both, F.col("path") == F.col("a")).select("qid", F.col("b").alias("path"), (F.col("distance") + 1).alias("distance")).distinct()
    return start.union(one).union(two).groupBy("qid", "path").agg(F.min("distance").cast("long").alias("distance"))


QUESTIONS = [("q1", "What of the page en-1 and the fr-4?"), ("q2", "de-2 or es-2 or en-2 or fr-2"), ("q3", "nothing here")]


def force_include(spark, sf_dir):
    return retrieve.force_include(wiki(spark, sf_dir), spark.createDataFrame(QUESTIONS, "qid string, question string"))


def asked_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, question, keywords``: every turn of a user in ``conversations``, with its words of four letters or more."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}]+"), lambda w: F.length(w) >= 4)
    return turns.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"), F.coalesce("text", F.lit("")).alias("question"), words.alias("keywords"))


ASKED_SQL = "ask AS (SELECT conv_id || '-' || turn AS qid, coalesce(text, '') AS question FROM conversations WHERE role = 'user')"
WORDS_SQL = """
kw AS (SELECT qid, nfc_normalize(lower(w)) AS kw, count(*) AS times FROM (SELECT qid, unnest(regexp_extract_all(question, '\\pL+')) AS w FROM ask) WHERE length(w) >= 4 GROUP BY ALL),
nn AS (
  SELECT path, nfc_normalize(lower(title)) AS t, [x for x in [nfc_normalize(lower(alias1)), nfc_normalize(lower(alias2))] if x <> ''] AS al, nfc_normalize(lower(summary)) AS s,
    nfc_normalize(lower(array_to_string(list_transform(refs, lambda r: '[[' || r || '|go]]'), ' '))) AS b FROM pg),
wo AS (SELECT kw, path, CASE WHEN t = kw THEN 10 WHEN list_contains(al, kw) THEN 8
    WHEN (t <> '' AND (contains(t, kw) OR contains(kw, t))) OR len([x for x in al if contains(x, kw) OR contains(kw, x)]) > 0 THEN 4 WHEN contains(s, kw) THEN 2 WHEN contains(b, kw) THEN 1 ELSE 0 END AS worth FROM (SELECT DISTINCT kw FROM kw) JOIN nn ON true),
lx AS (SELECT qid, path, sum(worth * times)::BIGINT AS score FROM kw JOIN wo USING (kw) WHERE worth > 0 GROUP BY ALL)
"""


def force_include_asked(spark, sf_dir):
    """Pages that users name, in all their turns."""
    return retrieve.force_include(wiki(spark, sf_dir), asked_questions(spark, sf_dir))


def lexical_asked(spark, sf_dir):
    """The lexical score of every page that a turn's words meet."""
    return retrieve.lexical_scores(wiki(spark, sf_dir).withColumnRenamed("text", "body"), asked_questions(spark, sf_dir), columns=())


def mode_a_asked(spark, sf_dir):
    """The ranking of all of these, pages that a turn names included."""
    w, asked = wiki(spark, sf_dir).withColumnRenamed("text", "body"), asked_questions(spark, sf_dir)
    return retrieve.mode_a(w, asked.where(F.size("keywords") > 0), questions=asked, columns=())


def mode_b_rank(spark, sf_dir, steps: int = SETTLED):
    """Seeds named by a question, a walk from them over the page graph with as many steps as six decimals need to settle, the ranking, the pack."""
    w = wiki(spark, sf_dir)
    nodes, edges = built(spark, sf_dir)
    asked = retrieve.force_include(w, spark.createDataFrame(QUESTIONS, "qid string, question string"))
    scores = _rounded(ppr.run(nodes, edges, asked, max_iter=steps, eps=0.0).select("qid", "path", "score"))
    rank = retrieve.mode_b(nodes, scores)
    return retrieve.assemble(rank, w.select("path", F.concat_ws(" ", "title", "summary", "text").alias("text")), 12, 500).select("qid", "rank", "path", "kind", "score", "cost", "used", "truncated")


QS = "(VALUES ('q1', 'What of the page en-1 and the fr-4?'), ('q2', 'de-2 or es-2 or en-2 or fr-2'), ('q3', 'nothing here')) q(qid, question)"
FORCED = f"SELECT DISTINCT qid, path FROM {QS} JOIN cl ON name <> '' AND contains(nfc_normalize(lower(question)), nfc_normalize(lower(name)))"
MODE_B_SQL = (
    f"WITH RECURSIVE {WIKI}, tn AS (SELECT path FROM pg), tw AS (SELECT sy.a, sy.b, 0.85::DOUBLE / dg.degree AS w FROM sy JOIN dg ON dg.path = sy.a)"
    + walk_sql(FORCED, SETTLED)
    + f""",
sc AS (SELECT qid, path, round(score, 6) AS score FROM v WHERE i = {SETTLED}),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM sc WHERE score > 0),
tx AS (SELECT path, kind, ceil(length(concat_ws(' ', title, summary, list_reduce(list_prepend('', list_transform(refs, lambda r: '[[' || r || '|go]]')), lambda x, y: CASE WHEN x = '' THEN y ELSE x || ' ' || y END))) / 4.0)::BIGINT AS cost FROM pg),
pk AS (SELECT qid, rank, path, kind, score, cost, row_number() OVER w AS n, sum(cost) OVER w AS used FROM rk JOIN tx USING (path) WINDOW w AS (PARTITION BY qid ORDER BY rank))
SELECT qid, rank, path, kind, score, cost, used::BIGINT AS used, used > 500 AS truncated FROM pk WHERE n <= 12 AND (used <= 500 OR n = 1)
"""
)

QUERIES = [
    (link_extract, f"WITH {WIKI} SELECT path, pos, target FROM tgt"),
    (handle_table_titles, f"WITH {WIKI} SELECT handle, title, path FROM ti"),
    (handle_table_graph, f"WITH {WIKI} SELECT handle, path FROM gi"),
    (link_resolve, f'WITH {WIKI} SELECT t.path, t.target, ti.title, ti.path AS "to" FROM tgt t LEFT JOIN ti USING (handle)'),
    (gaps_article_candidates, f"WITH {WIKI} SELECT handle, min(target) AS display, count(DISTINCT path)::BIGINT AS n_citers, string_agg(DISTINCT path, ',' ORDER BY path) AS citers FROM tgt WHERE NOT regexp_matches(target, '[#^]') AND NOT starts_with(target, 'raw/') AND handle NOT IN (SELECT handle FROM ti) GROUP BY handle"),
    (health_candidates_by_title, f"WITH {WIKI}, u AS (SELECT handle, min(target) OVER (PARTITION BY handle) AS display, path FROM tgt WHERE NOT regexp_matches(target, '[#^]') AND NOT starts_with(target, 'raw/') AND handle NOT IN (SELECT handle FROM ti)) SELECT display, count(DISTINCT title)::BIGINT AS n_titles, string_agg(DISTINCT title, ',' ORDER BY title) AS titles FROM u JOIN pg USING (path) GROUP BY display"),
    (graph_edges_distinct, f"WITH {WIKI} SELECT a, b FROM ed"),
    (graph_nodes, f"WITH {WIKI} SELECT path, title, kind, degree, summary FROM pg JOIN dg USING (path)"),
    (graph_mode, f"WITH {WIKI} SELECT (SELECT count(*) FROM pg) AS nodes, (SELECT count(*) FROM ed) AS edges, CASE WHEN (SELECT count(*) FROM pg) >= 20 AND (SELECT count(*) FROM ed) >= 1.5 * (SELECT count(*) FROM pg) THEN 'B' ELSE 'A' END AS mode"),
    (graph_kept, KEPT_SQL),
    (health_orphans, f"WITH {WIKI} SELECT path, title FROM pg JOIN dg USING (path) WHERE degree = 0"),
    (health_counts, f"WITH {WIKI} SELECT kind, count(*) AS n FROM pg GROUP BY kind"),
    (part_supplier_degree, "WITH e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), s AS (SELECT a FROM e UNION ALL SELECT b FROM e), n AS (SELECT 'p' || p_partkey AS path FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier) SELECT path, count(s.a)::BIGINT AS degree FROM n LEFT JOIN s ON s.a = path GROUP BY path"),
    (ppr_single_seed, f"WITH RECURSIVE {TERMS}{settled_sql(SEEDS_ONE)} SELECT qid, path, score FROM sc"),
    (ppr_multi_seed, f"WITH RECURSIVE {TERMS}{settled_sql(SEEDS_MANY)} SELECT qid, path, score FROM sc"),
    (ppr_distributed, f"WITH RECURSIVE {TERMS}{settled_sql(SEEDS_ONE)} SELECT qid, path, score FROM sc"),
    (ppr_isolated_seed, f"WITH RECURSIVE {TERMS}{settled_sql(SEEDS_ALONE)} SELECT qid, path, score FROM sc"),
    (ppr_snapshots, f"WITH RECURSIVE {TERMS}{settled_sql(SEEDS_ONE)} SELECT qid, i::BIGINT AS iter, path, round(score, 6) AS score FROM v JOIN it USING (qid) WHERE i BETWEEN 1 AND iterations"),
    (ppr_topk, f"WITH RECURSIVE {TERMS}{settled_sql(SEEDS_MANY)}, r AS (SELECT qid, path, score FROM sc) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM r WHERE score > 0) WHERE rank <= 12"),
    (ppr_converged, CONVERGED_SQL),
    (overlay_heat, f"WITH RECURSIVE {TERMS}{settled_sql(SEEDS_MANY)}, r AS (SELECT qid, path, score FROM sc), h AS (SELECT qid, r.path, se.path IS NOT NULL AS is_seed, score > 0 AND row_number() OVER (PARTITION BY qid ORDER BY score DESC, r.path) <= 12 AS in_topk, CASE WHEN score > 0 THEN round(score / max(score) OVER (PARTITION BY qid), 5) ELSE 0 END AS heat FROM r LEFT JOIN se USING (qid, path)) SELECT qid, path, is_seed, in_topk, heat, is_seed OR in_topk OR heat > 0 AS lit FROM h"),
    (scrubber_frames, f"WITH RECURSIVE {TERMS}{settled_sql(SEEDS_ONE)}, r AS (SELECT i::BIGINT AS frame, path, round(score, 6) AS score FROM v JOIN it USING (qid) WHERE i BETWEEN 1 AND iterations) SELECT * FROM (SELECT frame, path, round(score / max(score) OVER (PARTITION BY frame), 5) AS heat, row_number() OVER (PARTITION BY frame ORDER BY score DESC, path) AS rank FROM r WHERE score > 0) WHERE rank <= 3"),
    (label_choice, f"WITH {WIKI} SELECT path, degree, row_number() OVER (ORDER BY degree DESC, path) AS rank FROM dg ORDER BY degree DESC, path LIMIT 10"),
    (label_choice_lit, MODE_B_SQL[: MODE_B_SQL.index(",\nsc AS (")].replace(walk_sql(FORCED, SETTLED), settled_sql(FORCED + " AND qid = 'q1'")) + " SELECT path, score, row_number() OVER (ORDER BY score DESC, path) AS rank FROM sc WHERE score > 0 ORDER BY score DESC, path LIMIT 10"),
    (node_radius, f"WITH {WIKI} SELECT path, round(3.0::DOUBLE + 2.6::DOUBLE * ln(degree + 1), 6) AS radius FROM dg"),
    (layout_seed, f"WITH {WIKI}, h AS (SELECT path, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(path, ''), lambda c: unicode(c)::HUGEINT)), lambda a, c: (xor(a, c) * 16777619) % 4294967296)::BIGINT AS h FROM pg), a AS (SELECT path, (h & 65535) / 65536.0::DOUBLE * 2 * pi() AS a, sqrt((h >> 16) / 65536.0::DOUBLE) * 320 AS r FROM h) SELECT path, round(cos(a) * r, 6) AS x, round(sin(a) * r, 6) AS y FROM a"),
    (trace_labels, f"WITH {WIKI}, fc AS (SELECT handle, path FROM (SELECT nfc_normalize(lower(title)) AS handle, path, row_number() OVER (PARTITION BY nfc_normalize(lower(title)) ORDER BY path) AS r FROM pg) WHERE r = 1 AND handle <> '') SELECT 't' || pg.path AS pos, ' ' || title || ' ' AS label, fc.path AS path FROM pg LEFT JOIN fc ON fc.handle = nfc_normalize(lower(title)) UNION ALL SELECT path, path, path FROM pg UNION ALL SELECT 'x' || path, 'gone ' || path, NULL FROM pg"),
    (filter_box, f"WITH {WIKI} SELECT path, title FROM pg WHERE contains(lower(title), 'th') OR contains(lower(path), 'th')"),
    (mention_graph, f"WITH {WIKI}, d0 AS (SELECT qid, path, 0 AS d FROM ({FORCED})), d1 AS (SELECT DISTINCT qid, sy.b AS path, 1 AS d FROM d0 JOIN sy ON sy.a = d0.path), d2 AS (SELECT DISTINCT qid, sy.b AS path, 2 AS d FROM d1 JOIN sy ON sy.a = d1.path) SELECT qid, path, min(d)::BIGINT AS distance FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2) GROUP BY ALL"),
    (force_include, f"WITH {WIKI} {FORCED}"),
    (force_include_asked, f"WITH {WIKI}, {ASKED_SQL} SELECT DISTINCT qid, path FROM ask JOIN cl ON name <> '' AND contains(nfc_normalize(lower(question)), nfc_normalize(lower(name)))"),
    (lexical_asked, f"WITH {WIKI}, {ASKED_SQL}, {WORDS_SQL} SELECT qid, path, score FROM lx"),
    (mode_a_asked, f"WITH {WIKI}, {ASKED_SQL}, {WORDS_SQL}, fi AS (SELECT DISTINCT qid, path FROM ask JOIN cl ON name <> '' AND contains(nfc_normalize(lower(question)), nfc_normalize(lower(name))) WHERE qid IN (SELECT qid FROM kw)), al AS (SELECT qid, path, score FROM lx UNION ALL SELECT qid, path, 0 FROM fi WHERE NOT EXISTS (SELECT 1 FROM lx WHERE lx.qid = fi.qid AND lx.path = fi.path)) SELECT qid, path, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM al"),
    (link_rewrite, REWRITE_SQL),
    (answer_links, ANSWER_SQL),
    (mode_b_rank, MODE_B_SQL),
]
