"""A training corpus from ``documents``: rules, near-dedup, passage dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and
is written as Parquet and read again before the next; all but the last return the
columns of documents, other columns of the same names as those that stages use included.

Defined results: a null or empty text fails the first rule, so it goes. Rows that repeat
an id with the same text are kept together or go together; a null id is near to nothing
and shares no passage, but rules and benchmark hold for it. Of equal near copies the one
of the least id stays, of equal passages the first. Very long texts are handled whole.
An empty table gives no pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from inkmesh.llm import decontaminate, neardup, packing, quality, suffix
from inkmesh.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.cut(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: The last stages go beyond SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages. With a ``folder`` a stage that is whole there is read, not made again, so a lost driver goes on where it was."""
    docs = table(spark, sf_dir, "documents")
    top = folder or f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    names = spark._jvm.org.apache.hadoop.fs
    files = names.Path(top).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, (name, stage) in enumerate(STAGES):
        path = f"{top}/{k}-{name}"
        if not files.exists(names.Path(f"{path}/_SUCCESS")):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
            if k and not folder:  # nothing reads the stage before any more
                files.delete(names.Path(f"{top}/{k - 1}-{STAGES[k - 1][0]}"), True)
        docs = spark.read.parquet(path)
    return docs
