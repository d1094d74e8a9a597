"""One-line HTML comments that say what was left out; their payload can end neither the comment nor the line."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def payload(text: str) -> str:
    flat = re.sub(r"\r\n?|[\n  ]", " ", text)
    return re.sub("--+>", lambda m: "-" * (len(m[0]) - 1) + "›", flat).strip()


def marker(label: str, *parts: str) -> str:
    shown = " — ".join(map(payload, parts))
    return f"<!-- {label}: {shown} -->" if shown else f"<!-- {label} -->"


# The labels and payloads of the comments below.


def image_not_fetched(name: str, why: str) -> str:
    return marker("image not fetched", name, why)


def repo_file_omitted(path: str, why: str) -> str:
    return marker("repo file omitted", path, why)


def columns_omitted(shown: int, total: int) -> str:
    return marker("dataset columns omitted", f"showing {shown} of {total}")


def normalization_suspect(reasons: list[str]) -> str:
    return marker("normalization suspect", "; ".join(reasons))


def source_without_content(sources: list[str]) -> str:
    return marker("source with no content", ", ".join(sources))


def truncated(sources: list[str] = ()) -> str:
    return marker("truncated for context budget", ", ".join(sources))


def link_outside(target: str) -> str:
    return marker("link outside retrieved set", target)


def link_outside_column(target: Column) -> Column:
    """The same as a column."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(target, r"\r\n?|[\n\u2028\u2029]", " "), "-(-+)>", "$1›"))
    return F.concat(F.lit("<!-- link outside retrieved set: "), flat, F.lit(" -->"))
