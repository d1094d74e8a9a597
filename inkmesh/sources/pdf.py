"""PDF text layers. The extractor is a plug-in: bytes to a text per page; none is bundled."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tidy_page(text: Column) -> Column:
    """Spaces single, lines trimmed, three and more line ends two."""
    t = F.regexp_replace(text, r"[ \t ]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"))


def extract(files: DataFrame, extractor: Callable[[bytes], list[str]]) -> DataFrame:
    """``files(path, content)`` -> ``path, pages, error``: a file that fails costs itself alone."""
    @F.pandas_udf("struct<pages:array<string>,error:string>")
    def pages(content: pd.Series) -> pd.DataFrame:
        out = []
        for c in content:
            try:
                out.append((list(extractor(bytes(c))), None))
            except Exception as e:  # noqa: BLE001 - kept as the file's error
                out.append((None, re.sub(r"\s+", " ", str(e))))
        return pd.DataFrame(out, columns=["pages", "error"])

    return files.select("path", pages("content").alias("r")).select("path", "r.pages", "r.error")


def joined(pages: Column) -> Column:
    return F.array_join(F.filter(F.transform(pages, tidy_page), lambda p: p != ""), "\n\n")
