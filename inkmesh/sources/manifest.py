"""The manifest: what was built from which bytes. One JSON object of paths, written at the end of a run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("hash", T.StringType(), False), T.StructField("derivative", T.StringType())])


def parse(text: str | None) -> list[tuple[str, str, str | None]]:
    """Entries in order. A missing or corrupt file is empty; an entry may be a bare hash, as older files have it."""
    try:
        data = json.loads(text or "")
    except ValueError:
        return []
    rows = []
    for path, entry in data.items() if isinstance(data, dict) else ():
        entry = {"hash": entry} if isinstance(entry, str) else entry
        if path != "__proto__" and isinstance(entry, dict) and isinstance(entry.get("hash"), str):
            own = entry.get("derivative")
            rows.append((path, entry["hash"], own if isinstance(own, str) else None))
    return rows


def load(spark: SparkSession, path: str) -> DataFrame:
    """``path, hash, derivative`` of a manifest file; the JSON is parsed on the executors, permissively."""
    import pandas as pd

    def rows(batches):
        for batch in batches:
            for text in batch["value"]:
                if out := parse(text):
                    yield pd.DataFrame(out, columns=["path", "hash", "derivative"])

    try:
        files = spark.read.text(path, wholetext=True)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)
    return files.mapInPandas(rows, SCHEMA)


def render(manifest: DataFrame) -> str:
    """The manifest as JSON with sorted keys. A vault's manifest is one file by contract, so it comes to the driver here alone."""
    rows = sorted(manifest.select("path", "hash", "derivative").collect(), key=lambda r: r.path.encode("utf-16-be", "surrogatepass"))
    return json.dumps({r.path: {"hash": r.hash} | ({"derivative": r.derivative} if r.derivative else {}) for r in rows}, indent=2, ensure_ascii=False) + "\n"


def save_table(manifest: DataFrame, path: str) -> None:
    """The manifest as a Parquet table, for those too large for one JSON file."""
    manifest.select("path", "hash", "derivative").write.mode("overwrite").parquet(path)


def pending(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("hash") == "cascade-pending")
