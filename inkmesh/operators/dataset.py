"""Delimited data: type inference, header test, the descriptor card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.functions.text import trim

MAX_COLUMNS, HEAD_ROWS = 200, 10
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Types from the strictest on, with the pattern all cells that are not blank must fit.
TYPES = (("integer", r"^[+-]?[0-9]+$"), ("number", NUMBER), ("boolean", r"(?i)^(true|false|yes|no)$"), ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"))


def fits(value: Column) -> Column:
    """A bit for each of ``TYPES`` that a cell fits, null for a blank one; an integer is a number too, the others exclude each other."""
    bit = {name: 1 << k for k, (name, _) in enumerate(TYPES)}
    mask = lambda name: bit[name] | (bit["number"] if name == "integer" else 0)

    def of(v: Column) -> Column:
        out = F.when(v == "", None)
        for name, pattern in TYPES:
            out = out.when(F.regexp_like(v, F.lit(pattern)), mask(name))
        return out.otherwise(0)

    return F.element_at(F.transform(F.array(trim(value)), of), 1)


def inferred_type(value: Column) -> Column:
    """An aggregate: the first type that all cells fit; ``empty`` without any, else ``string``. A cell is looked at once."""
    every = F.bit_and(fits(value))
    out = F.when(every.isNull(), "empty")
    for k, (name, _) in enumerate(TYPES):
        out = out.when(every.bitwiseAND(1 << k) != 0, name)
    return out.otherwise("string")


def column_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``pos, column, type`` of the columns read as text, in one pass over the data."""
    columns = columns or df.columns
    one = df.agg(*[inferred_type(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"), F.col(f"c{i}").alias("type")) for i, c in enumerate(columns)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def is_header(cells: Column) -> Column:
    """No blank cells, all different whatever their case, none a number."""
    t = F.transform(cells, lambda x: trim(x))
    return (F.size(t) > 0) & ~F.exists(t, lambda x: x == "") & (F.size(F.array_distinct(F.transform(t, lambda x: F.lower(x)))) == F.size(t)) & ~F.exists(t, lambda x: F.regexp_like(x, F.lit(NUMBER)))


def card(path: str, rows: list[list[str]], types: list[str], n_rows: int, columns: list[str], header: bool) -> str:
    """Markdown of a dataset: counts, schema, first rows. ``rows``: at most ``HEAD_ROWS`` of data."""

    def cell(v: str) -> str:
        return v.replace("|", "\\|").replace("\r\n", " ").replace("\n", " ").strip()

    shown = columns[:MAX_COLUMNS]
    out = [f"# {path.rpartition('/')[2]}", "", "A dataset descriptor. The original file is retained.", ""]
    out += [f"- Rows: {n_rows}", f"- Columns: {len(columns)}", f"- Delimiter: {'tab' if path.lower().endswith('.tsv') else 'comma'}", f"- Header row: {'yes' if header else 'no, columns are positional'}", "", "## Schema", ""]
    if len(shown) < len(columns):
        out += [f"<!-- dataset columns omitted: showing {len(shown)} of {len(columns)} -->", ""]
    out += ["| Column | Type |", "| --- | --- |", *[f"| {cell(c)} | {t} |" for c, t in zip(shown, types, strict=False)], ""]
    out += [f"## First {len(rows)} row{'' if len(rows) == 1 else 's'}", "", f"| {' | '.join(map(cell, shown))} |", f"| {' | '.join('---' for _ in shown)} |"]
    out += [f"| {' | '.join(cell(r[i] if i < len(r) else '') for i in range(len(shown)))} |" for r in rows]
    return "\n".join([*out, "", "## Provenance", "", f"Extracted from `{path}`.", ""])
