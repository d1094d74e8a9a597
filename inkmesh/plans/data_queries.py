"""Queries over ranking, packing, changes, data types and quality. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkmesh.functions import text as T
from inkmesh.operators import changes, dataset, evaluate, fingerprints, health, links, merge, retrieve, smell
from inkmesh.operators.shared import dealt, ranked_in_groups
from inkmesh.plans.graph_queries import FORCED, QUESTIONS, WIKI, table, wiki
from inkmesh.sources import formats

# --- ranking and packing ------------------------------------------------------------------


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("wiki/part-"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_name").alias("title"), F.lit("entity").alias("kind"), F.array("p_brand").alias("aliases"), F.col("p_type").alias("summary"), F.concat_ws(" ", F.lit("size"), F.col("p_size").cast("string"), F.lit("price"), F.col("p_retailprice").cast("long").cast("string")).alias("body"))


#: Keywords of each question; one is blank, one repeats.
KEYWORDS = [("k1", ["Brand#12", "STEEL", "  ", "size 7"]), ("k2", ["part 17", "part 17", "PROMO"]), ("k3", ["price 1000", "brass", "brand"])]
KEYWORDS_SQL = "(VALUES " + ", ".join(f"('{q}', {n}, '{k.strip().lower()}')" for q, ks in KEYWORDS for n, k in enumerate(ks) if k.strip()) + ") k(qid, n, kw)"
SCORE_SQL = f"""
pt AS (SELECT 'wiki/part-' || p_partkey AS path, lower(p_name) AS t, lower(p_brand) AS al, lower(p_type) AS s, 'size ' || p_size || ' price ' || trunc(p_retailprice)::BIGINT AS b, p_name AS title FROM part),
lx AS (
  SELECT qid, path, title, sum(CASE WHEN t = kw THEN 10 WHEN al = kw THEN 8
    WHEN contains(t, kw) OR contains(kw, t) OR contains(al, kw) OR contains(kw, al) THEN 4 WHEN contains(s, kw) THEN 2 WHEN contains(b, kw) THEN 1 ELSE 0 END)::BIGINT AS score
  FROM pt CROSS JOIN {KEYWORDS_SQL} GROUP BY ALL)
"""


def keywords(spark):
    return spark.createDataFrame(KEYWORDS, "qid string, keywords array<string>")


def lexical_score(spark, sf_dir):
    return retrieve.lexical_scores(parts(spark, sf_dir), keywords(spark)).where("score > 0").select("qid", "path", "score")


def mode_a_rank(spark, sf_dir):
    """Lexical ranking of every page that scores, with two seeds kept though they score nothing."""
    seeds = spark.createDataFrame([("k1", "wiki/part-1"), ("k2", "wiki/part-2")], "qid string, path string")
    return retrieve.mode_a(parts(spark, sf_dir), keywords(spark), seeds).select("qid", "rank", "path", "title", "score")


def seeds_validated(spark, sf_dir):
    """Proposed seeds that are pages, each once, the first eight; every supplier is a question."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    items = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_suppkey")
    placed = items.withColumn("pos", F.row_number().over(w))  # keys alone are sorted, names made after it
    proposed = placed.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("qid"), "pos", F.concat(F.lit("wiki/part-"), (F.col("l_partkey") * 2).cast("string")).alias("path"))
    return retrieve.valid_seeds(proposed, parts(spark, sf_dir)).select("qid", "path", F.col("pos").cast("long").alias("pos"))


def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return docs.select(F.col("source").alias("qid"), rank.cast("long").alias("rank"), F.concat(F.lit("raw/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text")


COST_SQL = """
dr AS (SELECT source AS qid, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, doc_id, text, CASE WHEN text IS NULL OR trim(text) = '' THEN NULL ELSE ceil((length(text) + length(regexp_replace(text, '[\\x00-\\x{FFFF}]', '', 'g'))) / 4.0)::BIGINT END AS cost FROM documents),
dc AS (SELECT *, row_number() OVER w AS n, sum(cost) OVER w AS used FROM dr WHERE cost IS NOT NULL WINDOW w AS (PARTITION BY qid ORDER BY rank))
"""


def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate("text").alias("tokens"), T.utf16_length(F.col("text")).alias("units"))


def pack_budget(spark, sf_dir):
    packed = retrieve.pack(ranked_documents(spark, sf_dir).where("text IS NOT NULL AND trim(text) <> ''"), "qid", "rank", "text", 6000, 12)
    return packed.select("qid", "rank", "doc_id", "cost", "used", "truncated")


def pack_whole_only(spark, sf_dir):
    packed = retrieve.pack(ranked_documents(spark, sf_dir).where("text IS NOT NULL AND trim(text) <> ''"), "qid", "rank", "text", 700, None, truncate_first=False)
    return packed.select("qid", "rank", "doc_id", "cost", "used")


def pack_truncated_text(spark, sf_dir):
    """First items over the budget with their tails cut: their cost then fits it."""
    packed = retrieve.pack(ranked_documents(spark, sf_dir).where("text IS NOT NULL AND trim(text) <> ''"), "qid", "rank", "text", 300)
    return retrieve.cut_texts(packed, "text", 300).select("qid", "doc_id", "truncated", T.token_estimate(F.col("text")).alias("tokens"), (F.col("text").endswith(T.MARKER)).alias("marked"))


def followup_pack(spark, sf_dir):
    """A second lexical round in the room and budget that the first left."""
    p = parts(spark, sf_dir)
    bodies = p.select("path", F.repeat(F.concat("title", F.lit(". "), "summary", F.lit(". ")), 5).alias("text"))
    first = retrieve.assemble(retrieve.mode_a(p, keywords(spark), spark.createDataFrame([], "qid string, path string")), bodies, 5, 400)
    missing = spark.createDataFrame([("k1", ["tin"]), ("k2", ["brand#3"]), ("k3", ["copper", "economy"])], "qid string, keywords array<string>")
    return retrieve.follow_up(p, missing, first, bodies, 9, 400).select("qid", "rank", "path", "score", "cost", "used")


FOLLOW_SQL = (
    "WITH "
    + SCORE_SQL
    + """,
bd AS (SELECT 'wiki/part-' || p_partkey AS path, ceil(5 * length(p_name || '. ' || p_type || '. ') / 4.0)::BIGINT AS cost FROM part),
r1 AS (SELECT qid, path, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM lx WHERE score > 0),
p1 AS (SELECT qid, path, cost, row_number() OVER w AS n, sum(cost) OVER w AS used FROM r1 JOIN bd USING (path) WINDOW w AS (PARTITION BY qid ORDER BY rank)),
a1 AS (SELECT * FROM p1 WHERE n <= 5 AND (used <= 400 OR n = 1)),
sp AS (SELECT qid, sum(cost) AS spent, count(*) AS taken FROM a1 GROUP BY qid),
l2 AS (SELECT qid, path, sum(CASE WHEN t = kw THEN 10 WHEN al = kw THEN 8 WHEN contains(t, kw) OR contains(kw, t) OR contains(al, kw) OR contains(kw, al) THEN 4 WHEN contains(s, kw) THEN 2 WHEN contains(b, kw) THEN 1 ELSE 0 END)::BIGINT AS score
       FROM pt CROSS JOIN (VALUES ('k1', 'tin'), ('k2', 'brand#3'), ('k3', 'copper'), ('k3', 'economy')) k(qid, kw) GROUP BY ALL),
r2 AS (SELECT l2.qid, l2.path, score, row_number() OVER (PARTITION BY l2.qid ORDER BY score DESC, l2.path) AS rank FROM l2 LEFT JOIN a1 ON a1.qid = l2.qid AND a1.path = l2.path WHERE score > 0 AND a1.path IS NULL),
p2 AS (SELECT qid, rank, path, score, cost, row_number() OVER w AS n, (sum(cost) OVER w)::BIGINT AS used FROM r2 JOIN bd USING (path) WINDOW w AS (PARTITION BY qid ORDER BY rank))
SELECT qid, rank, path, score, cost, used FROM p2 LEFT JOIN sp USING (qid) WHERE n <= 9 - coalesce(taken, 0) AND used <= 400 - coalesce(spent, 0)
"""
)

# --- changes --------------------------------------------------------------------------------


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files now: all documents but one in eleven, some moved to another folder."""
    d = table(spark, sf_dir, "documents").where("doc_id % 11 <> 0")
    folder = F.when(F.col("doc_id") % 7 == 0, "raw/moved/").otherwise(F.concat(F.lit("raw/"), F.col("source"), F.lit("/")))
    return d.select(F.concat(folder, F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), (F.col("doc_id") % 29 != 1).alias("derivative_ok"))


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last build: documents not divisible by 13, of which some had other bytes."""
    d = table(spark, sf_dir, "documents").where("doc_id % 13 <> 0")
    old = F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("old")), 256)).otherwise(F.sha2(F.coalesce("text", F.lit("")), 256))
    return d.select(F.concat(F.lit("raw/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), old.alias("hash"))


def skipped(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("raw/src3",), ("raw/src4/44.txt",)], "path string")


CHANGE_SQL = """
now AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'raw/moved/' ELSE 'raw/' || source || '/' END || doc_id || '.txt' AS path, sha256(coalesce(text, '')) AS hash, doc_id % 29 <> 1 AS ok FROM documents WHERE doc_id % 11 <> 0),
rec AS (SELECT 'raw/' || source || '/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 5 = 0 THEN sha256(coalesce(text, '') || 'old') ELSE sha256(coalesce(text, '')) END AS hash FROM documents WHERE doc_id % 13 <> 0),
df AS (
  SELECT coalesce(now.path, rec.path) AS path, now.hash, rec.hash AS old_hash,
    CASE WHEN rec.path IS NULL THEN 'new' WHEN now.path IS NULL THEN 'deleted' WHEN now.hash <> rec.hash OR NOT ok THEN 'modified' ELSE 'unchanged' END AS status
  FROM now FULL JOIN rec ON now.path = rec.path),
dd AS (SELECT * FROM df WHERE NOT (status = 'deleted' AND (path = 'raw/src4/44.txt' OR starts_with(path, 'raw/src4/44.txt/') OR path = 'raw/src3' OR starts_with(path, 'raw/src3/')))),
lo AS (SELECT old_hash AS h, count(*) AS n FROM dd WHERE status = 'deleted' GROUP BY 1),
ln AS (SELECT hash AS h, count(*) AS n FROM dd WHERE status = 'new' GROUP BY 1)
"""


def changed(spark, sf_dir):
    return changes.diff(discovered(spark, sf_dir), recorded(spark, sf_dir), skipped(spark))


def diff_four_rules(spark, sf_dir):
    return changed(spark, sf_dir)


def change_counters(spark, sf_dir):
    """How many files have each status, as counted while the difference was written."""
    _, n = changes.counted(changed(spark, sf_dir))
    return spark.createDataFrame(sorted(n.items()), "status string, n long")


def manifest_equal(spark, sf_dir):
    """For each folder whether the record equals what is there now, by fingerprints of both."""
    now, was = (d.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "path", "hash") for d in (discovered(spark, sf_dir), recorded(spark, sf_dir)))
    return fingerprints.same_groups(now, was, "folder", ["path", "hash"]).withColumnsRenamed({"n_a": "n_now", "n_b": "n_was"})


def same_topology(spark, sf_dir):
    """For each part whether its suppliers, and how often each, are the same without the seventh lines of orders."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), "l_suppkey", "l_linenumber")
    return fingerprints.same_groups(lines.drop("l_linenumber"), lines.where("l_linenumber < 7").drop("l_linenumber"), "part", ["l_suppkey"])


def rename_pairs(spark, sf_dir):
    return changes.rename_pairs(changed(spark, sf_dir))


def rename_lone_pairs(spark, sf_dir):
    """Renames where one deleted and one new file share a content: no choice is made."""
    c = changed(spark, sf_dir)
    pairs = changes.rename_pairs(c)
    one = c.where("status = 'deleted'").groupBy(F.col("old_hash").alias("h")).count().where("count = 1").select("h").join(c.where("status = 'new'").groupBy(F.col("hash").alias("h")).count().where("count = 1").select("h"), "h")
    lone = c.where("status = 'deleted'").join(one, F.col("old_hash") == F.col("h"), "left_semi").select(F.col("path").alias("old"))
    return pairs.join(lone, "old").select("old", "new")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents cite each page of a supplier's parts."""
    d = table(spark, sf_dir, "documents")
    numbers = F.explode(F.array(F.col("doc_id") % 97, F.col("doc_id") % 101 + 200)).alias("n")
    return d.select(F.concat(F.lit("raw/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source"), numbers).select("source", F.concat(F.lit("wiki/"), F.col("n").cast("string")).alias("page"))


CITE_SQL = "ci AS (SELECT 'raw/' || source || '/' || doc_id || '.txt' AS source, 'wiki/' || unnest([doc_id % 97, doc_id % 101 + 200]) AS page FROM documents)"
#: The new paths of a content in order, each taking the best old one that none before it took.
CHOICE_SQL = """
ol AS (SELECT old_hash AS h, path AS old, regexp_replace(path, '/[^/]*$', '') AS od, regexp_extract(path, '[^/]*$') AS ob FROM dd WHERE status = 'deleted' AND old_hash IN (SELECT h FROM ln)),
nw AS (SELECT hash AS h, path AS new, regexp_replace(path, '/[^/]*$', '') AS nd, regexp_extract(path, '[^/]*$') AS nb, row_number() OVER (PARTITION BY hash ORDER BY path) AS k FROM dd WHERE status = 'new' AND hash IN (SELECT h FROM lo)),
tk(h, k, taken, old, new) AS (
  SELECT DISTINCT h, 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR FROM nw
  UNION ALL
  SELECT h, k, list_append(any_value(taken), arg_min(old, o)), arg_min(old, o), any_value(new) FROM (
    SELECT nw.h, nw.k, tk.taken, ol.old, nw.new, (CASE WHEN ol.old IS NULL THEN '9' WHEN od = nd THEN 3 - 2 - (ob = nb)::INT WHEN starts_with(nd, od || '/') THEN 3 - 1 - (ob = nb)::INT ELSE 3 - (ob = nb)::INT END)::VARCHAR || coalesce(ol.old, '') AS o
    FROM tk JOIN nw ON nw.h = tk.h AND nw.k = tk.k + 1 LEFT JOIN ol ON ol.h = tk.h AND NOT list_contains(tk.taken, ol.old)) GROUP BY h, k)
"""
LONE_SQL = "ren AS (SELECT o.path AS old, n.path AS new FROM dd o JOIN lo ON lo.h = o.old_hash AND lo.n = 1 JOIN ln ON ln.h = o.old_hash AND ln.n = 1 JOIN dd n ON n.hash = o.old_hash AND n.status = 'new' WHERE o.status = 'deleted')"


def cascade_scope(spark, sf_dir):
    return changes.cascade_scope(citations(spark, sf_dir), changed(spark, sf_dir), rename_lone_pairs(spark, sf_dir))


def rename_repoint(spark, sf_dir):
    return changes.repointed(citations(spark, sf_dir), rename_lone_pairs(spark, sf_dir))


def next_manifest(spark, sf_dir):
    """What to record after a run in which pages 3 and 205 failed."""
    failed = spark.createDataFrame([("wiki/3",), ("wiki/205",)], "page string")
    return changes.next_manifest(recorded(spark, sf_dir), changed(spark, sf_dir), rename_lone_pairs(spark, sf_dir), changes.blocked(citations(spark, sf_dir), failed))


def blocked_sources(spark, sf_dir):
    failed = spark.createDataFrame([("wiki/3",), ("wiki/205",)], "page string")
    return changes.blocked(citations(spark, sf_dir), failed).select("source", F.array_join("pages", ",").alias("pages"))


def citer_union(spark, sf_dir):
    """All citers: those recorded at the last build before those discovered now, each once, those still there."""
    c = citations(spark, sf_dir)
    old = c.join(recorded(spark, sf_dir).select(F.col("path").alias("source")).distinct(), "source", "left_semi")
    new = c.join(discovered(spark, sf_dir).select(F.col("path").alias("source")).distinct(), "source", "left_semi")
    old = old.withColumn("pos", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("source"))))
    new = new.withColumn("pos", F.row_number().over(Window.partitionBy("page").orderBy("source")))
    live = changed(spark, sf_dir).where("status <> 'deleted'").select(F.col("path").alias("source"))
    return links.citer_union(old.select("page", "pos", "source"), new.select("page", "pos", "source"), live).select("page", F.array_join("citers", ",").alias("citers"))


def health_dangling(spark, sf_dir):
    return health.dangling_citations(citations(spark, sf_dir), recorded(spark, sf_dir))


def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("hash"))


def repo_identity(spark, sf_dir):
    """One identity for the files of each folder: over their ordered digests."""
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), F.lit(0).alias("seq"))
    return formats.repo_identity(files)


def repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a repository for each source, in folders whose names differ in marks, beside files that are not read."""
    d = table(spark, sf_dir, "documents")
    pick = lambda names, by: F.element_at(F.array(*[F.lit(x) for x in names]), (by % len(names) + 1).cast("int"))
    path = F.concat(F.lit("raw/"), "source", F.lit("/"), pick(FOLDERS, F.col("doc_id") * 7), pick(NAMES, F.col("doc_id")), F.col("doc_id").cast("string"), pick(ENDS, F.col("doc_id") * 3))
    own = d.select(path.alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return own.unionByName(d.select(F.concat(F.lit("raw/"), "source", F.lit("/.git/HEAD")).alias("path"), F.encode(F.lit("x"), "UTF-8").alias("content")).distinct())


FOLDERS = ("", "docs/", "src/", "src-gen/", "lib.v2/", "lib/", "src/a b/", "src/a/", "src-gen/(x)/", "docs/src/", "vendor/", "src/z/z/")
NAMES = ("readme-", "f", "F-", "f.", "z")
ENDS = (".md", ".py", ".c", ".txt")
REPO_SQL = f"""
rf AS (
  SELECT source AS repo, {list(FOLDERS)}[doc_id * 7 % {len(FOLDERS)} + 1] AS dir, {list(NAMES)}[doc_id % {len(NAMES)} + 1] || doc_id || {list(ENDS)}[doc_id * 3 % {len(ENDS)} + 1] AS name, coalesce(text, '') AS t FROM documents),
ro AS (
  SELECT 'raw/' || repo AS repo, dir || name AS path, t, strlen(t) AS n,
    row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN dir = '' AND starts_with(name, 'readme') THEN 0 WHEN starts_with(dir, 'docs/') THEN 1 ELSE 2 END, len(string_split(dir, '/')), string_split(dir, '/'), name) AS place
  FROM rf WHERE NOT starts_with(dir, 'vendor/') AND (NOT name LIKE '%.txt' OR (dir = '' AND starts_with(name, 'readme'))))
"""


def repo_order(spark, sf_dir):
    """The place of each file in the reading order of its repository."""
    files = repository_files(spark, sf_dir)
    own = formats.repo_files(files, formats.repo_roots(files))
    return ranked_in_groups(own.select("repo", "path", "seq"), ["repo"], ["seq"], "place").select("repo", "path", F.col("place").cast("long").alias("place"))


def repo_digest(spark, sf_dir):
    """One identity for each repository, over its files in reading order."""
    files = repository_files(spark, sf_dir)
    return formats.repo_identity(formats.repo_files(files, formats.repo_roots(files)))


def repo_caps(spark, sf_dir):
    """Which files of a repository are left out: over 4,000 bytes, or where 30,000 are retained."""
    files = repository_files(spark, sf_dir)
    return formats.retained(formats.repo_files(files, formats.repo_roots(files)), 4000, 30_000)


CAPS_SQL = f"""WITH RECURSIVE {REPO_SQL},
cp(repo, k, total, path, omitted) AS (
  SELECT DISTINCT repo, 0::BIGINT, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR FROM ro
  UNION ALL
  SELECT ro.repo, ro.place, total + CASE WHEN n > 4000 OR total + n > 30000 THEN 0 ELSE n END, ro.path, CASE WHEN n > 4000 THEN 'file over 100KB' WHEN total + n > 30000 THEN 'repo total over 1MB' END
  FROM cp JOIN ro ON ro.repo = cp.repo AND ro.place = cp.k + 1)
SELECT repo, path, omitted FROM cp WHERE k > 0"""


def readable_path(spark, sf_dir):
    """Where a recorded source is read: its derivative, itself if it is text, else nowhere."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("md", "txt", "pdf", "html", "csv")]), (F.col("doc_id") % 5 + 1).cast("int"))
    m = d.select("doc_id", F.concat(F.lit("raw/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.when(F.col("doc_id") % 9 == 0, changes.PENDING).otherwise("x").alias("hash"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("raw/"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("derivative"))
    return m.select("doc_id", formats.readable_path(F.col("path"), F.col("hash"), F.col("derivative")).alias("readable"))


def format_dispatch(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    names = ("a.md", "b.TXT", "c.html", "d.htm", "e.pdf", "f.csv", "g.tsv", "h.png", "i.JPEG", "j.docx", ".md", "k.tar.gz")
    path = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("doc_id") % len(names) + 1).cast("int"))
    return d.select("doc_id", path.alias("path"), formats.format_of(path).alias("format"))


# --- extraction smells, data types -----------------------------------------------------


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("text"))


LINES_SQL = "ln AS (SELECT source AS doc, doc_id AS page, trim(unnest(string_split(coalesce(text, ''), chr(10))), ' \t\r' || chr(160)) AS line FROM documents)"


def smell_fragment(spark, sf_dir):
    return smell.fragment_ratio(extractions(spark, sf_dir)).select("doc", "lines", F.round("fragment_ratio", 6).alias("fragment_ratio"))


def smell_headers(spark, sf_dir):
    return smell.repeated_line_pages(extractions(spark, sf_dir))


def smell_short(spark, sf_dir):
    return smell.chars_a_page(extractions(spark, sf_dir)).select("doc", "chars", "pages", "short")


def smell_reasons(spark, sf_dir):
    return smell.reasons(extractions(spark, sf_dir)).select("doc", F.array_join("reasons", "; ").alias("reasons"))


TYPED = ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "half", "day", "flag", "nothing", "mixed")


def typed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).cast("decimal(18,2)").alias("o_totalprice"), "o_orderpriority",
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).alias("half"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(F.col("o_orderkey") % 3 == 0, "Yes").otherwise("FALSE").alias("flag"),
        F.lit(" ").alias("nothing"),
        F.when(F.col("o_orderkey") % 5 == 0, "12").otherwise("x").alias("mixed"),
    )


def infer_types(spark, sf_dir):
    return dataset.column_types(typed_columns(spark, sf_dir), list(TYPED)).select(F.col("column"), "type")


INFER_SQL = (
    "WITH t AS (SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, round(o_totalprice, 2)::DECIMAL(18,2)::VARCHAR AS o_totalprice, o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR END AS half, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 3 = 0 THEN 'Yes' ELSE 'FALSE' END AS flag, ' ' AS nothing, CASE WHEN o_orderkey % 5 = 0 THEN '12' ELSE 'x' END AS mixed FROM orders), u AS (UNPIVOT t ON COLUMNS(*) INTO NAME c VALUE v), w AS (SELECT c, nullif(trim(v), '') AS v FROM u) "
    "SELECT c AS \"column\", CASE WHEN count(v) = 0 THEN 'empty' WHEN bool_and(regexp_full_match(v, '[+-]?[0-9]+')) THEN 'integer' WHEN bool_and(regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')) THEN 'number' WHEN bool_and(regexp_full_match(lower(v), 'true|false|yes|no')) THEN 'boolean' WHEN bool_and(regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?')) THEN 'date' ELSE 'string' END AS type FROM w GROUP BY c"
)


def header_detect(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    cells = F.array(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(F.lit("1e3")), F.col("p_type"))
    return p.select("p_partkey", dataset.is_header(cells).alias("header"))


def events_age(spark, sf_dir):
    """How long ago each event was, on a fixed day, as filed answers are aged."""
    now = F.to_timestamp(F.lit("2024-03-01 00:00:00"))
    return table(spark, sf_dir, "events").select("event_id", health.age_label(F.col("ts").cast("timestamp"), now).alias("age"))


# --- inventories merged into pages -----------------------------------------------------------


def nation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each nation, known by its key too, one for each region, and a numbered one beside a source's."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    kind, none = F.lit("entity"), F.array().cast("array<string>")
    own = n.select(F.concat(F.lit("wiki/n-"), F.col("n_nationkey").cast("string")).alias("path"), F.initcap(F.lower("n_name")).alias("title"), kind.alias("kind"), F.array(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string"))).alias("aliases"))
    own = own.union(r.select(F.concat(F.lit("wiki/r-"), F.col("r_regionkey").cast("string")), F.concat(F.lit("Region "), F.col("r_name")), kind, none))
    more = spark.createDataFrame([("wiki/sources/low.md", "5-LOW", "source", []), ("wiki/low-10.md", "5-LOW-10", "concept", []), ("wiki/low-2.md", "5-LOW-2", "concept", [])], "path string, title string, kind string, aliases array<string>")
    return own.union(more)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer is a source: its nation by name or by key, with its segment as an alias; then an order's priority, which has no page."""
    c, n, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "orders")
    source, none = F.concat(F.lit("raw/c"), F.col("c_custkey").cast("string")).alias("source"), F.array().cast("array<string>")
    by_name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.col("n_name"))).otherwise(F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")))
    one = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(source, F.lit(0).alias("pos"), by_name.alias("title"), F.lit("entity").alias("kind"), F.array("c_mktsegment", F.lit(" ")).alias("aliases"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("summary"))
    two = o.select(F.concat(F.lit("raw/c"), F.col("o_custkey").cast("string")).alias("source"), (F.col("o_orderkey") + 1).cast("int").alias("pos"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "F", "concept").otherwise("entity").alias("kind"), none.alias("aliases"), F.col("o_orderstatus").alias("summary"))
    return one.union(two)


def inventory_match(spark, sf_dir):
    """The page that each item names: by title or alias, else by the name that a numbered page goes back to."""
    pages = nation_pages(spark, sf_dir)
    items = merge.ordered(mentions(spark, sf_dir))
    held = pages.select(T.handle(F.col("title")).alias("handle")).distinct()
    return items.join(merge.matched(items, pages.where("kind <> 'source'"), held), "key").select("source", F.col("pos").cast("long").alias("pos"), "path")


def inventory_merge(spark, sf_dir):
    """Pages to make and to write again, with what the items bring to each."""
    made = merge.merge(nation_pages(spark, sf_dir), mentions(spark, sf_dir))
    page = F.when(F.col("made").isNull(), F.col("page")).otherwise(F.concat(F.lit("new:"), F.col("made")))
    return made.select(page.alias("page"), "kind", F.array_join("aliases", ",").alias("aliases"), "summary", F.size("citers").cast("long").alias("n_citers"), F.element_at("citers", 1).alias("first_citer"))


MENTION_SQL = """
np AS (SELECT 'wiki/n-' || n_nationkey AS path, lower(n_name) AS t, 'nation ' || n_nationkey AS al FROM nation),
im AS (
  SELECT 'raw/c' || c_custkey AS source, 0::BIGINT AS pos, CASE WHEN c_custkey % 2 = 0 THEN lower(n_name) ELSE 'nation ' || n_nationkey END AS h, c_mktsegment AS alias, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE 'Nation ' || n_nationkey END AS title, 'entity' AS kind, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS summary
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'raw/c' || o_custkey, o_orderkey + 1, lower(o_orderpriority), NULL, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'concept' ELSE 'entity' END, o_orderstatus FROM orders),
mt AS (SELECT im.*, CASE WHEN h = '5-low' THEN 'wiki/low-2.md' ELSE np.path END AS path FROM im LEFT JOIN np ON h = np.t OR h = np.al),
ow AS (SELECT alias, arg_min(path, (source, pos)) AS path FROM mt WHERE alias IS NOT NULL GROUP BY alias),
of AS (
  SELECT path, title AS a, source, pos, 0 AS k FROM mt WHERE h = '5-low'
  UNION ALL SELECT mt.path, mt.alias, source, pos, 1 FROM mt JOIN ow ON ow.alias = mt.alias AND ow.path = mt.path),
fo AS (SELECT path, a, min((source, pos, k)) AS o FROM of GROUP BY path, a)
"""


# --- evaluation ------------------------------------------------------------------------------


def outcomes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each source: documents by length are the ranking, those of good quality are expected."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    by = d.groupBy("source").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.negative("n_chars").alias("o"), "doc_id"))), lambda x: x["doc_id"]).alias("ranked"),
        F.collect_list(F.when(F.col("quality") == 1, F.col("doc_id"))).alias("expected"),
    )
    return by.withColumn("seeded", F.col("source").endswith("1"))


EVAL_SQL = """
d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r, quality = 1 AS e FROM documents LEFT JOIN labels USING (doc_id)),
o AS (
  SELECT source, source LIKE '%1' AS seeded, count(*) FILTER (WHERE e) AS n,
    CASE WHEN count(*) FILTER (WHERE e) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE e AND r <= 5)::DOUBLE / count(*) FILTER (WHERE e) END AS recall5,
    CASE WHEN count(*) FILTER (WHERE e) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE e AND r <= 10)::DOUBLE / count(*) FILTER (WHERE e) END AS recall10,
    coalesce(1.0::DOUBLE / min(r) FILTER (WHERE e), 0) AS rr
  FROM d GROUP BY source)
"""
MEANS_SQL = "SELECT round(coalesce(avg(recall5), 0), 6) AS recall_at_5, round(coalesce(avg(recall10), 0), 6) AS recall_at_10, round(coalesce(avg(rr), 0), 6) AS mrr, round(coalesce(avg(recall5) FILTER (WHERE NOT seeded), 0), 6) AS ranking_recall_at_5, round(coalesce(avg(recall10) FILTER (WHERE NOT seeded), 0), 6) AS ranking_recall_at_10, round(coalesce(avg(rr) FILTER (WHERE NOT seeded), 0), 6) AS ranking_mrr, count(*) AS n, count(*) FILTER (WHERE NOT seeded) AS ranking_n FROM o"


def eval_per_query(spark, sf_dir):
    return evaluate.outcomes(outcomes_of(spark, sf_dir)).select("source", *[F.round(c, 6).alias(c) for c in ("recall5", "recall10", "rr")])


def eval_recall_mrr(spark, sf_dir):
    out = evaluate.summary(evaluate.outcomes(outcomes_of(spark, sf_dir)))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


def eval_floors(spark, sf_dir):
    measured = evaluate.summary(evaluate.outcomes(outcomes_of(spark, sf_dir)))
    return evaluate.under_floors(measured, {"recall_at_5": 0.99, "recall_at_10": 0.0, "mrr": 0.95, "ranking_mrr": float("nan")}).select("metric", F.round("value", 6).alias("value"))


# --- names -----------------------------------------------------------------------------------


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "url")


def sanitize_title(spark, sf_dir):
    return summaries(spark, sf_dir).select("page_id", T.sanitize_title(F.concat(F.lit(" ._"), F.col("title"), F.lit(" #1?. "))).alias("title"))


def title_stem(spark, sf_dir):
    """Titles repeated beyond the byte limit, with the tag of a cut."""
    return summaries(spark, sf_dir).select("page_id", T.title_stem(F.repeat("title", 6)).alias("stem"))


def slug(spark, sf_dir):
    return summaries(spark, sf_dir).select("page_id", T.slug(F.col("title")).alias("slug"))


def path_parts(spark, sf_dir):
    p = F.regexp_extract("url", "://[^/]*/([^?#]*)", 1)
    return summaries(spark, sf_dir).select("page_id", T.extension(p).alias("ext"), T.stem(p).alias("stem"), T.basename(p).alias("base"), T.is_under(p, F.lit("en")).alias("under_en"))


def index_lines(spark, sf_dir):
    return health.index_lines(wiki(spark, sf_dir)).select("kind", "title", "line")


def index_sections(spark, sf_dir):
    w = wiki(spark, sf_dir).withColumn("title", F.concat("title", F.lit(" "), "path"))
    return health.index_sections(w)


LINE_SQL = "'- [[' || title || ']]' || CASE WHEN summary <> '' THEN ' — ' || trim(summary) ELSE '' END || ' (aliases: ' || alias1 || ', ' || alias2 || ')'"


def eval_force_included(spark, sf_dir):
    """How many pages each question names outright, and the first of them by path."""
    asked = retrieve.force_include(wiki(spark, sf_dir), spark.createDataFrame(QUESTIONS, "qid string, question string"))
    return asked.groupBy("qid").agg(F.count(F.lit(1)).alias("n_seeds"), F.min("path").alias("first"))


QUERIES = [
    (lexical_score, f"WITH {SCORE_SQL} SELECT qid, path, score FROM lx WHERE score > 0"),
    (mode_a_rank, f"WITH {SCORE_SQL}, r AS (SELECT lx.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM lx WHERE score > 0 OR (qid = 'k1' AND path = 'wiki/part-1') OR (qid = 'k2' AND path = 'wiki/part-2')) SELECT qid, rank, path, title, score FROM r"),
    (seeds_validated, "WITH p AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS pos, l_partkey * 2 AS k FROM lineitem), o AS (SELECT 's' || l_suppkey AS qid, 'wiki/part-' || k AS path, min(pos) AS pos FROM p WHERE k IN (SELECT p_partkey FROM part) GROUP BY ALL) SELECT qid, path, pos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos, path) AS r FROM o) WHERE r <= 8"),
    (token_estimate, "SELECT doc_id, ceil((length(text) + length(regexp_replace(text, '[\\x00-\\x{FFFF}]', '', 'g'))) / 4.0)::BIGINT AS tokens, (length(text) + length(regexp_replace(text, '[\\x00-\\x{FFFF}]', '', 'g')))::BIGINT AS units FROM documents"),
    (pack_budget, f"WITH {COST_SQL} SELECT qid, rank, doc_id, cost, used::BIGINT AS used, used > 6000 AS truncated FROM dc WHERE n <= 12 AND (used <= 6000 OR n = 1)"),
    (pack_whole_only, f"WITH {COST_SQL} SELECT qid, rank, doc_id, cost, used::BIGINT AS used FROM dc WHERE used <= 700"),
    (pack_truncated_text, None),
    (followup_pack, FOLLOW_SQL),
    (diff_four_rules, f"WITH {CHANGE_SQL} SELECT path, status, hash, old_hash FROM dd"),
    (rename_pairs, f"WITH RECURSIVE {CHANGE_SQL}, {CHOICE_SQL} SELECT old, new FROM tk WHERE old IS NOT NULL"),
    (change_counters, f"WITH {CHANGE_SQL} SELECT status, count(dd.status)::BIGINT AS n FROM (VALUES ('new'), ('modified'), ('unchanged'), ('deleted')) s(status) LEFT JOIN dd USING (status) GROUP BY status"),
    (manifest_equal, f"WITH {CHANGE_SQL}, o AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS n_now, list((path, hash) ORDER BY path, hash) AS a FROM now GROUP BY 1), r AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS n_was, list((path, hash) ORDER BY path, hash) AS b FROM rec GROUP BY 1) SELECT folder, coalesce(n_now, 0) AS n_now, coalesce(n_was, 0) AS n_was, coalesce(a = b, false) AS same FROM o FULL JOIN r USING (folder)"),
    (same_topology, "WITH a AS (SELECT l_partkey AS part, count(*) AS n, list(l_suppkey ORDER BY l_suppkey) AS s FROM lineitem GROUP BY 1), b AS (SELECT l_partkey AS part, count(*) AS n, list(l_suppkey ORDER BY l_suppkey) AS s FROM lineitem WHERE l_linenumber < 7 GROUP BY 1) SELECT part, a.n AS n_a, coalesce(b.n, 0) AS n_b, coalesce(a.s = b.s, false) AS same FROM a LEFT JOIN b USING (part)"),
    (rename_lone_pairs, f"WITH {CHANGE_SQL}, {LONE_SQL} SELECT old, new FROM ren"),
    (cascade_scope, f"WITH {CHANGE_SQL}, {LONE_SQL}, {CITE_SQL}, mv AS (SELECT old AS path FROM ren UNION ALL SELECT new FROM ren), tc AS (SELECT path FROM dd WHERE status = 'modified' OR (status = 'deleted' AND path NOT IN (SELECT path FROM mv))), lv AS (SELECT path FROM dd WHERE status <> 'deleted' UNION ALL SELECT path FROM mv) SELECT page, CASE WHEN bool_or(source IN (SELECT path FROM lv)) THEN 'regenerate' ELSE 'delete' END AS fate FROM ci GROUP BY page HAVING bool_or(source IN (SELECT path FROM tc))"),
    (rename_repoint, f"WITH {CHANGE_SQL}, {LONE_SQL}, {CITE_SQL} SELECT page, coalesce(new, source) AS source FROM ci LEFT JOIN ren ON source = old"),
    (next_manifest, f"WITH {CHANGE_SQL}, {LONE_SQL}, {CITE_SQL}, hl AS (SELECT DISTINCT source FROM ci WHERE page IN ('wiki/3', 'wiki/205')), v AS (SELECT path, CASE WHEN status IN ('new', 'modified') THEN CASE WHEN path IN (SELECT source FROM hl) THEN old_hash ELSE hash END WHEN status = 'unchanged' THEN hash WHEN path IN (SELECT source FROM hl) AND path NOT IN (SELECT old FROM ren) THEN 'cascade-pending' END AS hash FROM dd) SELECT path, hash FROM v WHERE hash IS NOT NULL"),
    (blocked_sources, f"WITH {CITE_SQL} SELECT source, string_agg(DISTINCT page, ',' ORDER BY page) AS pages FROM ci WHERE page IN ('wiki/3', 'wiki/205') GROUP BY source"),
    (citer_union, f"WITH {CHANGE_SQL}, {CITE_SQL}, b AS (SELECT page, source, 0 AS g, row_number() OVER (PARTITION BY page ORDER BY source DESC) AS p FROM ci WHERE source IN (SELECT path FROM rec) UNION ALL SELECT page, source, 1, row_number() OVER (PARTITION BY page ORDER BY source) FROM ci WHERE source IN (SELECT path FROM now)), c AS (SELECT page, source, min(g * 1000000000 + p) AS o FROM b WHERE source IN (SELECT path FROM dd WHERE status <> 'deleted') GROUP BY ALL) SELECT page, string_agg(source, ',' ORDER BY o) AS citers FROM c GROUP BY page"),
    (health_dangling, f"WITH {CHANGE_SQL}, {CITE_SQL} SELECT page, source FROM ci WHERE starts_with(source, 'raw/') AND source NOT IN (SELECT path FROM rec)"),
    (content_hash, "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents"),
    (repo_identity, "WITH f AS (SELECT source AS repo, 'docs/' || doc_id || '.txt' AS path, coalesce(text, '') AS t FROM documents), d AS (SELECT repo, path, sha256(length(path) || ':' || path || ':' || strlen(t) || ':' || t) AS h FROM f) SELECT repo, sha256(string_agg(h, chr(10) ORDER BY path)) AS identity FROM d GROUP BY repo"),
    (repo_order, f"WITH {REPO_SQL} SELECT repo, path, place FROM ro"),
    (repo_digest, f"WITH {REPO_SQL} SELECT repo, sha256(string_agg(sha256(length(path) || ':' || path || ':' || n || ':' || t), chr(10) ORDER BY place)) AS identity FROM ro GROUP BY repo"),
    (repo_caps, CAPS_SQL),
    (readable_path, "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'raw/' || doc_id || '.md' WHEN doc_id % 5 = 0 THEN 'raw/' || doc_id || '.md' WHEN doc_id % 5 = 1 THEN 'raw/' || doc_id || '.txt' END AS readable FROM documents"),
    (format_dispatch, "WITH p AS (SELECT doc_id, ['a.md', 'b.TXT', 'c.html', 'd.htm', 'e.pdf', 'f.csv', 'g.tsv', 'h.png', 'i.JPEG', 'j.docx', '.md', 'k.tar.gz'][doc_id % 12 + 1] AS path FROM documents) SELECT doc_id, path, CASE lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) WHEN '.md' THEN 'md' WHEN '.txt' THEN 'txt' WHEN '.html' THEN 'html' WHEN '.htm' THEN 'html' WHEN '.pdf' THEN 'pdf' WHEN '.csv' THEN 'dataset' WHEN '.tsv' THEN 'dataset' WHEN '.png' THEN 'image' WHEN '.jpeg' THEN 'image' END AS format FROM p"),
    (smell_fragment, f"WITH {LINES_SQL} SELECT doc, count(*)::BIGINT AS lines, CASE WHEN count(*) >= 20 THEN round(count(*) FILTER (WHERE NOT regexp_matches(line, '[.!?:;\"''”’)\\]]$')) / count(*)::DOUBLE, 6) END AS fragment_ratio FROM ln WHERE line <> '' GROUP BY doc"),
    (smell_headers, f"WITH {LINES_SQL}, n AS (SELECT doc, line, count(DISTINCT page) AS n FROM ln WHERE length(line) >= 4 GROUP BY ALL) SELECT doc, max(n) AS header_pages FROM n GROUP BY doc"),
    (smell_short, "SELECT source AS doc, sum(length(trim(coalesce(text, ''), ' \t\r' || chr(10) || chr(160))))::BIGINT AS chars, count(*) AS pages, sum(length(trim(coalesce(text, ''), ' \t\r' || chr(10) || chr(160)))) / count(*) < 200 AS short FROM documents GROUP BY source"),
    (smell_reasons, f"WITH {LINES_SQL}, fr AS (SELECT doc, CASE WHEN count(*) >= 20 THEN count(*) FILTER (WHERE NOT regexp_matches(line, '[.!?:;\"''”’)\\]]$')) / count(*)::DOUBLE END AS f FROM ln WHERE line <> '' GROUP BY doc), hn AS (SELECT doc, max(n) AS h FROM (SELECT doc, line, count(DISTINCT page) AS n FROM ln WHERE length(line) >= 4 GROUP BY ALL) GROUP BY doc), ch AS (SELECT source AS doc, sum(length(trim(coalesce(text, ''), ' \t\r' || chr(10) || chr(160)))) / count(*) < 200 AS short, count(*) AS p FROM documents GROUP BY source) SELECT doc, concat_ws('; ', CASE WHEN short THEN 'short output for ' || p || ' page' || CASE WHEN p = 1 THEN '' ELSE 's' END END, CASE WHEN h >= 3 THEN 'repeated line on ' || h || ' pages' END, CASE WHEN f > 0.6 THEN 'high sentence-fragment ratio (' || floor(f * 100 + 0.5)::BIGINT || '%)' END) AS reasons FROM ch LEFT JOIN hn USING (doc) LEFT JOIN fr USING (doc)"),
    (infer_types, INFER_SQL),
    (header_detect, "WITH c AS (SELECT p_partkey, [trim(p_name), trim(CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_brand ELSE '1e3' END), trim(p_type)] AS c FROM part) SELECT p_partkey, NOT list_contains(c, '') AND len(list_distinct(list_transform(c, lambda x: lower(x)))) = 3 AND len(list_filter(c, lambda x: regexp_full_match(x, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?'))) = 0 AS header FROM c"),
    (events_age, "WITH a AS (SELECT event_id, floor((epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(ts)) / 86400000000.0)::BIGINT AS d FROM events) SELECT event_id, CASE WHEN d < 0 THEN 'future' WHEN d = 0 THEN 'today' WHEN d = 1 THEN '1 day' ELSE d || ' days' END AS age FROM a"),
    (inventory_match, f"WITH {MENTION_SQL} SELECT source, pos, path FROM mt WHERE path IS NOT NULL"),
    (inventory_merge, f"WITH {MENTION_SQL}, pg AS (SELECT coalesce(path, 'new:' || title) AS page, path IS NULL AS made, * FROM mt) SELECT page, CASE WHEN any_value(made) THEN arg_min(kind, (source, pos)) END AS kind, (SELECT coalesce(string_agg(a, ',' ORDER BY o), '') FROM fo WHERE fo.path = page) AS aliases, coalesce(arg_max(summary, (source, pos)) FILTER (WHERE summary <> ''), '') AS summary, count(DISTINCT source) AS n_citers, arg_min(source, (source, pos)) AS first_citer FROM pg GROUP BY page"),
    (eval_per_query, f"WITH {EVAL_SQL} SELECT source, round(recall5, 6) AS recall5, round(recall10, 6) AS recall10, round(rr, 6) AS rr FROM o"),
    (eval_recall_mrr, f"WITH {EVAL_SQL} {MEANS_SQL}"),
    (eval_floors, f"WITH {EVAL_SQL}, m AS ({MEANS_SQL}) SELECT 'recall_at_5' AS metric, recall_at_5 AS value FROM m WHERE recall_at_5 < 0.99 UNION ALL SELECT 'mrr', mrr FROM m WHERE mrr < 0.95 UNION ALL SELECT 'ranking_mrr', ranking_mrr FROM m"),
    (sanitize_title, "WITH t AS (SELECT page_id, nfc_normalize(' ._' || regexp_extract(html, '<title>([^<]*)</title>', 1) || ' #1?. ') AS t FROM pages), u AS (SELECT page_id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(t, '[\\[\\]#^|\\\\/:?*\"<>\\x00-\\x1f]', '', 'g'), '\\s+', ' ', 'g'), '^[_. ]+', '')), '[. ]+$', '') AS t FROM t) SELECT page_id, CASE WHEN t = '' THEN 'Untitled' ELSE t END AS title FROM u"),
    (title_stem, None),
    (slug, "WITH t AS (SELECT page_id, regexp_replace(regexp_replace(lower(nfc_normalize(regexp_extract(html, '<title>([^<]*)</title>', 1))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS t FROM pages), u AS (SELECT page_id, regexp_replace(t[1:60], '-+$', '') AS t FROM t) SELECT page_id, CASE WHEN t = '' THEN 'answer' ELSE t END AS slug FROM u"),
    (path_parts, "WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS p FROM pages), b AS (SELECT *, string_split(p, '/')[-1] AS b FROM p) SELECT page_id, lower(regexp_extract(p, '[^/](\\.[^./]*)$', 1)) AS ext, CASE WHEN regexp_matches(b, '^.+\\.[^.]*$') THEN regexp_replace(b, '\\.[^.]*$', '') ELSE b END AS stem, b AS base, p = 'en' OR starts_with(p, 'en/') AS under_en FROM b"),
    (index_lines, f"WITH {WIKI} SELECT kind, title, {LINE_SQL} AS line FROM pg"),
    (index_sections, f"WITH {WIKI}, x AS (SELECT kind, title || ' ' || path AS title, summary, alias1, alias2 FROM pg) SELECT kind, string_agg({LINE_SQL}, chr(10) ORDER BY title) AS body FROM x GROUP BY kind"),
    (eval_force_included, f"WITH {WIKI}, f AS ({FORCED}) SELECT qid, count(*) AS n_seeds, min(path) AS first FROM f GROUP BY qid"),
]
