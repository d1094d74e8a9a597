"""Quality rules: a ledger of rule bits, and policies applied to it.

Every rule is evaluated once for a document. Its outcome is a bit of
``failed_bits``, beside the measurements that led to it. A policy is a version
and a mask of rules; whether it keeps a document is one bitwise AND, and what a
policy would keep without one of its rules (an ablation) comes from counts per
bit pattern, of which there are few, so the texts are never read again.

Defined results: a null or empty text has no words, hence fails the rule on
length. Rows are judged one by one: repeated ids or texts each get their own
row. A null id stays null. An empty table gives an empty table. Extra columns
never clash: ``ledger`` reads only the id and the text, and ``keep`` holds the
whole row in one struct while it works.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.llm.common import SPACE, let, table, words

SYMBOLS = "#*$%&|<>"

#: Rule name -> (bit, condition of failure over the measurements). All whole numbers.
RULES = {
    "too_few_words": (0, "n_words < 50"),
    "repeated_words": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words"),
    "duplicate_lines": (3, "100 * n_dup_lines > 50 * n_lines"),
    "capitals": (4, "10 * n_upper > 3 * word_chars"),
    "short_words": (5, "word_chars < 3 * n_words"),
    "long_words": (6, "word_chars > 12 * n_words"),
}


@dataclass(frozen=True)
class Policy:
    """A named set of rules; a document that fails one of them is rejected."""

    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r][0] for r in self.rules)


BASE = Policy(1, ("too_few_words", "repeated_words"))
FULL = Policy(2, tuple(RULES))
POLICIES = {p.version: p for p in (BASE, FULL)}


def repeated_words(word_array: Column, size: int = 3) -> Column:
    """Words that lie in a window of ``size`` words found twice or more.

    Windows are sorted by hash, then by their words, so equal ones are
    neighbours; their positions, in order, each cover up to ``size`` new words.
    Only a text in which some window hash repeats is sorted at all.
    """

    def covered(w: Column) -> Column:
        window = F.transform(w, lambda x, i: F.struct(F.xxhash64(x, *[F.get(w, i + j) for j in range(1, size)]).alias("h"), *[F.get(w, i + j).alias(f"w{j}") for j in range(size)], i.alias("at")))
        window = F.sort_array(F.slice(window, F.lit(1), F.size(w) - (size - 1)))
        keys = ["h", *[f"w{j}" for j in range(size)]]

        def positions(s: Column) -> Column:
            def same(x: Column, y: Column) -> Column:
                out = F.coalesce(x["h"] == y["h"], F.lit(False))
                for k in keys[1:]:
                    out = out & (x[k] == y[k])
                return F.coalesce(out, F.lit(False))

            found = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
            return F.sort_array(F.transform(found, lambda x: x["at"]))

        def total(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(size)), F.lit(size))), F.lit(0).cast("long"), lambda acc, x: acc + x)

        return let(let(window, positions), total)

    def judged(w: Column) -> Column:
        hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, size)])), F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(0)))
        return F.when(let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h)), covered(w)).otherwise(F.lit(0).cast("long"))

    return let(word_array, judged)


def measurements(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(f"[^{SPACE}]")))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    word_counts = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    return {
        "word_counts": word_counts,
        "line_counts": line_counts,
        "word_chars": F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_upper": F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long"),
    }


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the measurements, and ``failed_bits``: bit k is set if rule k fails."""
    raw = docs.select(F.col(id_col), F.struct(*[v.alias(k) for k, v in measurements(F.col(text_col)).items()]).alias("m"))
    return _bits(raw, [F.col(id_col)])


def _bits(raw: DataFrame, carried: list[Column]) -> DataFrame:
    measured = raw.select(
        *carried,
        F.col("m.word_counts.n").alias("n_words"),
        F.col("m.word_chars").alias("word_chars"),
        F.col("m.n_symbols").alias("n_symbols"),
        (F.col("m.line_counts.n") - F.col("m.line_counts.d")).cast("long").alias("n_dup_lines"),
        F.col("m.word_counts.r").alias("n_repeat_words"),
        F.col("m.line_counts.n").cast("long").alias("n_lines"),
        F.col("m.n_upper").alias("n_upper"),
    )
    bits = F.lit(0).cast("long")
    for bit, failed in RULES.values():
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("failed_bits", bits)


def apply_policy(entries: DataFrame, policy: Policy, out: str = "kept") -> DataFrame:
    """Adds boolean ``out``: no rule of the policy failed."""
    return entries.withColumn(out, F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def ablations(entries: DataFrame, *policies: Policy) -> DataFrame:
    """For each rule of each policy, and none: documents kept without that rule.

    Columns: version, without (rule name; null: the whole policy), kept_docs,
    gained (kept only because the rule is left out), total. The ledger is first
    counted by bit pattern, at most 2 to the number of rules rows.
    """
    counts = entries.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = [(p.version, r, p.mask & ~(1 << RULES[r][0]) if r else p.mask, p.mask) for p in policies for r in (None, *p.rules)]
    case = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(r).cast("string").alias("without"), F.lit(m).cast("long").alias("mask"), F.lit(w).cast("long").alias("whole")) for v, r, m, w in cases]))
    each = counts.select("failed_bits", "n", case.alias("c")).select("failed_bits", "n", "c.*")
    passes, whole = (F.col("failed_bits").bitwiseAND(F.col(m)) == 0 for m in ("mask", "whole"))
    return each.groupBy("version", "without").agg(
        F.sum(F.when(passes, F.col("n")).otherwise(0)).alias("kept_docs"),
        F.sum(F.when(passes & ~whole, F.col("n")).otherwise(0)).alias("gained"),
        F.sum("n").alias("total"),
    )


def keep(docs: DataFrame, policy: Policy = FULL, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns alone."""
    raw = docs.select(F.struct("*").alias("row"), F.struct(*[v.alias(k) for k, v in measurements(F.col(text_col)).items()]).alias("m"))
    return apply_policy(_bits(raw, [F.col("row")]), policy).where("kept").select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = apply_policy(ledger(table(spark, sf_dir, "documents")), FULL)
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed_bits").bitwiseAND(F.lit(BASE.mask).cast("long")) != 0).alias("base_failed"),
        "kept", "failed_bits", F.lit(FULL.version).alias("policy_version"),
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy keeps, and would keep without each of its rules."""
    return ablations(ledger(table(spark, sf_dir, "documents")), *POLICIES.values())


_LEDGER_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT k, i, ws[i] AS a, ws[i+1] AS b, ws[i+2] AS c
  FROM (SELECT k, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM win) WHERE n >= 2),
cov AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i+1, i+2]) AS p FROM rep) GROUP BY k),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
         length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper
  FROM w LEFT JOIN cov USING (k)),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_upper > 3 * word_chars THEN 16 ELSE 0 END + CASE WHEN word_chars < 3 * n_words THEN 32 ELSE 0 END
    + CASE WHEN word_chars > 12 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed_bits
  FROM m)
"""
OP1_SQL = _LEDGER_SQL + r"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (failed_bits = 0) AS kept, failed_bits, 2 AS policy_version
FROM b
"""
ABLATIONS_SQL = _LEDGER_SQL + f""", p(version, without, mask, whole) AS (
  VALUES {", ".join(f"({p.version}, {f"'{r}'" if r else 'NULL::VARCHAR'}, {p.mask & ~(1 << RULES[r][0]) if r else p.mask}, {p.mask})" for p in POLICIES.values() for r in (None, *p.rules))})
SELECT version, without, count(*) FILTER (failed_bits & mask = 0)::BIGINT AS kept_docs,
       count(*) FILTER (failed_bits & mask = 0 AND failed_bits & whole <> 0)::BIGINT AS gained, count(*)::BIGINT AS total
FROM b, p GROUP BY version, without
"""
