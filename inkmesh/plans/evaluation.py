"""Ranking quality over a vault: both rankings for a table of questions, without a model.

Seeds are the pages that a question names; keywords are its words of more than two
letters, punctuation kept. All questions are ranked together.

    python -m inkmesh.plans.evaluation VAULT QUERIES

measures a vault against a file of questions, which also holds the floors of each mode and
how many questions the ranking itself must answer; it ends with 1 if one is missed.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.functions.text import utf16_length
from inkmesh.operators import evaluate, ppr, retrieve


def run(pages: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """``mode, qid, ranked, expected, seeded`` with ``recall5, recall10, rr``; ``queries(qid, question, expected)``."""
    seeds = retrieve.force_include(pages, queries)
    keywords = queries.select("qid", F.filter(F.split("question", r"\s+"), lambda w: utf16_length(w) > 2).alias("keywords"))
    a = retrieve.mode_a(pages, keywords, seeds).select(F.lit("A").alias("mode"), "qid", "rank", "path")
    b = retrieve.mode_b(nodes, ppr.run(nodes, edges, seeds)).select(F.lit("B").alias("mode"), "qid", "rank", "path")
    order = a.union(b).groupBy("mode", "qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("ranked"))
    named = seeds.groupBy("qid").agg(F.collect_set("path").alias("seeds"))
    none = F.array().cast("array<string>")
    every = queries.select("qid", "expected", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("mode"))
    rows = every.join(order, ["mode", "qid"], "left").join(named, "qid", "left").select(
        "mode", "qid", F.coalesce("ranked", none).alias("ranked"), "expected", (F.size(F.array_except("expected", F.coalesce("seeds", none))) == 0).alias("seeded")
    )
    return evaluate.outcomes(rows)


def report(scored: DataFrame) -> dict[str, dict]:
    """Means of each mode, over all queries and over those that the ranking itself must answer."""
    return {mode: evaluate.summary(scored.where(F.col("mode") == mode)).first().asDict() for mode in ("A", "B")}


#: Names of measures in a file of questions, those over all and, under ``ranking``, those over what the ranking must answer.
MEASURES = {"recallAt5": "recall_at_5", "recallAt10": "recall_at_10", "mrr": "mrr"}


def questions(text: str) -> tuple[list[tuple[str, str, list[str]]], dict[str, dict[str, float]], int | None]:
    """``(qid, question, expected)`` rows, floors by mode and measure (a floor that is missing or no number is NaN), and the size of the ranking subset of a YAML file."""
    import yaml

    data = yaml.safe_load(text)
    rows = [(f"q{n:04d}", q["query"], list(q["expect"])) for n, q in enumerate(data.get("queries") or [])]
    floors = {}
    for mode, own in (data.get("floors") or {}).items():
        inner = own.get("ranking") or {}
        named = {m: own.get(k) for k, m in MEASURES.items()} | {f"ranking_{m}": inner.get(k) for k, m in MEASURES.items()}
        floors[mode] = {m: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else math.nan for m, v in named.items()}
    return rows, floors, data.get("rankingQueries")


def measure(spark: SparkSession, vault: str, text: str, say: Callable[[str], None] = print) -> tuple[dict[str, dict], list[str]]:
    """Means of each mode for a vault and a file of questions, and what was missed."""
    from inkmesh.operators import graph
    from inkmesh.plans.provider import Provider
    from inkmesh.plans.vault import Vault

    rows, floors, ranking_n = questions(text)
    own = Vault(spark, vault, Provider(lambda r: ""))
    pages = own.pages().persist()
    nodes, edges = (x.persist() for x in graph.build(pages, own.raw()))
    scored = run(pages, nodes, edges, spark.createDataFrame(rows, "qid string, question string, expected array<string>")).persist()
    asked, missed, out = {q: t for q, t, _ in rows}, [], report(scored)
    say(f"{pages.count()} pages, {nodes.count()} nodes, {edges.count()} edges, {len(rows)} questions")
    for mode, means in out.items():
        say(f"mode {mode}")
        for r in scored.where(F.col("mode") == mode).orderBy("qid").collect():  # a row for each question
            say(f"  {r.recall5:.2f}  {r.recall10:.2f}  {r.rr:.3f}  {' ' if r.seeded else '*'}  {asked[r.qid]}")
        say("  " + ", ".join(f"{m} {means[m]:.4f}" for m in (*MEASURES.values(), *(f"ranking_{m}" for m in MEASURES.values()))))
        if ranking_n is not None and means["ranking_n"] != ranking_n:
            missed.append(f"{mode}: the ranking must answer {means['ranking_n']} questions, {ranking_n} are recorded")
        if mode not in floors:
            missed.append(f"{mode}: no floor")
            continue
        under = evaluate.under_floors(spark.createDataFrame([tuple(means.values())], list(means)), floors[mode])
        missed += [f"{mode}: {r.metric} {r.value:.4f} is under {floors[mode][r.metric]:.4f}" for r in under.orderBy("metric").collect()]
    for m in missed:
        say(m)
    return out, missed


def main(arguments: list[str]) -> int:
    if len(arguments) != 2:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("evaluation").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    with open(arguments[1], encoding="utf-8") as f:
        return 1 if measure(spark, arguments[0], f.read())[1] else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
