"""Delimited text: quotes open at a field's start only, blank lines are rows of one field, rows may be ragged.

``read`` takes files apart into many tasks. Lines are read by the splits of a file. Whether a line begins inside a
quoted field depends on all lines before it, but only by one bit, and what a line does to that bit is known from the
line alone: it keeps, turns or sets it. Such effects are put together within each split, then over the splits of a
file, so every line learns its bit. A row is a line, or the lines from one that begins outside up to the next such one.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from inkmesh.operators import dataset
from inkmesh.operators.shared import kept

MARK = "\ufeff"


def delimiter_of(path: str) -> str:
    return "\t" if path.lower().endswith(".tsv") else ","


def parse(text: str, delimiter: str) -> list[list[str]]:
    """The rows of a whole file."""
    return rows_of(text.removeprefix(MARK), delimiter)


def rows_of(text: str, delimiter: str) -> list[list[str]]:
    """Each token is a quoted stretch at a field's start, a plain stretch, or a mark between fields or rows."""
    token = re.compile(rf'(?P<quoted>"(?:[^"]|"")*(?:"|\Z))|(?P<plain>[^{re.escape(delimiter)}\n\r"]+)|(?P<quote>")|(?P<return>\r)|(?P<end>\n)|(?P<next>{re.escape(delimiter)})')
    rows, row, value, at = [], [], "", 0
    while at < len(text):
        m = token.match(text, at)
        kind, piece = m.lastgroup, m[0]
        if kind == "quoted" and value:  # inside a field a quote is text
            kind, piece = "quote", '"'
        at += len(piece)
        if kind == "quoted":
            closed = len(piece) > 1 and piece.endswith('"') and (len(piece) - len(piece.rstrip('"'))) % 2 == (1 if piece.strip('"') else 0)
            value += piece[1 : -1 if closed else None].replace('""', '"')
        elif kind in ("plain", "quote"):
            value += piece
        elif kind in ("next", "end"):
            row.append(value)
            value = ""
            if kind == "end":
                rows.append(row)
                row = []
    return [*rows, [*row, value]] if value or row else rows


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def parse_rows(text: pd.Series, delimiter: pd.Series) -> pd.Series:
    return pd.Series([[] if t is None else parse(t, d) for t, d in zip(text, delimiter, strict=True)], dtype=object)


# --- files in many tasks ---------------------------------------------------------------------


def _closed(delimiter: str) -> tuple[re.Pattern, re.Pattern]:
    """Lines that end outside of quotes, begun outside and begun inside. Returns, and an empty quoted stretch before one, leave a field at its start."""
    d = re.escape(delimiter)
    field = rf'(?:\r|""(?=\r))*+(?:"(?:[^"]++|"")*+"|(?!"))[^{d}]*+'
    more = rf"(?:{d}{field})*+"
    return re.compile(field + more), re.compile(rf'(?:[^"]++|"")*+"[^{d}]*+{more}')


@F.pandas_udf(StructType().add("outside", BooleanType()).add("inside", BooleanType()))
def _ends_inside(line: pd.Series, delimiter: pd.Series) -> pd.DataFrame:
    """Whether a line ends inside a quoted field, if it begins outside or inside of one. Null, which stands for lines without a quote: as it begins."""
    closed = {d: _closed(d) for d in delimiter.unique()}
    told = [(False, True) if x is None else tuple(p.fullmatch(x) is None for p in closed[d]) for x, d in zip(line, delimiter, strict=True)]
    return pd.DataFrame(told, columns=["outside", "inside"], dtype=bool)


@F.pandas_udf(ArrayType(StringType()))
def _row(text: pd.Series, delimiter: pd.Series) -> pd.Series:
    """The one row of a text; null where a last line without an end holds nothing."""
    return pd.Series([next(iter(rows_of(t, d)), None) for t, d in zip(text, delimiter, strict=True)], dtype=object)


def _begins(rows: DataFrame, groups: list[str], order: str) -> DataFrame:
    """Adds ``if_outside, if_inside``: whether a row begins inside, if the first of its group begins outside or inside.

    ``outside, inside`` say how each row ends. Where both agree the bit is set, where both are reversed it is turned.
    """
    so_far = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    turned = rows.withColumn("_turns", F.sum((F.col("outside") & ~F.col("inside")).cast("int")).over(so_far))
    fixed = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").alias("bit"), F.col("_turns").alias("turns")))
    turned = turned.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(before)).withColumn("_before", F.coalesce(F.max("_turns").over(before), F.lit(0)))
    odd = (F.col("_before") - F.coalesce("_fixed.turns", F.lit(0))) % 2 == 1
    begun = lambda start: F.coalesce("_fixed.bit", F.lit(start)) != odd
    return turned.withColumn("if_outside", begun(False)).withColumn("if_inside", begun(True)).drop("_turns", "_fixed", "_before")


def _if(begun: str | Column, inside: str, outside: str) -> Column:
    return F.when(F.col(begun) if isinstance(begun, str) else begun, F.col(inside)).otherwise(F.col(outside))


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, block, line, fields``: the rows of delimited files, in order of ``block`` and ``line`` within each file.

    ``block`` is where a split begins, ``line`` the number of a row's first line in it. Files are plain UTF-8 (other
    bytes become replacement marks), with tabs where the name ends in ``.tsv``. Empty files have no rows. The result is
    that of ``parse`` on each whole file: a quote never closed takes in the rest of its file, which then is one value,
    so that only files with such a fault need the memory of a task to hold it.
    """
    meta = F.col("_metadata")
    raw = spark.read.option("lineSep", "\n").text(paths).select(
        meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"), F.monotonically_increasing_id().alias("at"),
        (F.octet_length("value") + 1).cast("long").alias("bytes"), F.make_valid_utf8("value").alias("text"))
    raw = raw.withColumn("delimiter", F.when(F.lower("path").endswith(".tsv"), "\t").otherwise(","))
    ends = _ends_inside(F.when(F.contains("text", F.lit('"')), F.col("text")), "delimiter")
    lines = raw.withColumn("ends", ends).select("*", "ends.outside", "ends.inside").drop("ends")
    in_block = Window.partitionBy("path", "block").orderBy("at")
    lines = _begins(lines, ["path", "block"], "at").withColumn("line", F.row_number().over(in_block))
    # A block does to the bit what its last line ends with; a row that goes on into it began at the last line outside before.
    after = F.struct(_if("if_outside", "inside", "outside").alias("outside"), _if("if_inside", "inside", "outside").alias("inside"))
    blocks = lines.groupBy("path", "block").agg(
        F.max_by(after, "line").alias("after"), F.max(F.when(~F.col("if_outside"), F.col("line"))).alias("from_outside"), F.max(F.when(~F.col("if_inside"), F.col("line"))).alias("from_inside"),
        F.sum("bytes").alias("bytes"), F.max("size").alias("size"), F.max("line").alias("lines"))
    blocks = _begins(blocks.select("*", "after.outside", "after.inside"), ["path"], "block")
    whole, earlier = Window.partitionBy("path"), Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = _if("if_outside", "from_inside", "from_outside")
    total = F.sum("bytes").over(whole)
    blocks = kept(blocks.select(
        "path", "block", F.col("if_outside").alias("start"), F.last(F.when(last.isNotNull(), F.struct("block", last.alias("line"))), ignorenulls=True).over(earlier).alias("open"),
        # The last line has an end if all lines with an end each are as long as the file, but for a byte order mark, which is not read.
        F.when((F.col("block") == F.max("block").over(whole)) & (total != F.col("size")) & (total + 3 != F.col("size")), F.col("lines")).alias("endless")))
    known = lines.join(blocks, ["path", "block"]).withColumn("begins", _if("start", "if_inside", "if_outside")).withColumn("goes_on", _if("begins", "inside", "outside"))
    own = F.last(F.when(~F.col("begins"), F.struct("block", "line")), ignorenulls=True).over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    text = F.when(F.col("line") == F.col("endless"), F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    known = kept(known.select("path", "delimiter", "block", "line", "begins", "goes_on", F.coalesce(own, "open").alias("row"), text.alias("text")))
    alone = ~F.col("begins") & ~F.col("goes_on")
    parts = F.sort_array(F.collect_list(F.struct("block", "line", "text")))
    joined = known.where(~alone).groupBy("path", "delimiter", "row").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
    rows = known.where(alone).select("path", "delimiter", "row", "text").unionByName(joined)
    return rows.select("path", "row.block", "row.line", _row("text", "delimiter").alias("fields")).where("fields IS NOT NULL")


def _type(values: list[str]) -> str:
    present = [v.strip() for v in values if v.strip()]
    if not present:
        return "empty"
    return next((name for name, p in dataset.TYPES if all(re.search(p, v) for v in present)), "string")


def describe(text: str, path: str) -> str:
    """The card of a delimited file."""
    rows = parse(text, delimiter_of(path))
    first = [c.strip() for c in rows[0]] if rows else []
    header = bool(first) and all(first) and len({c.lower() for c in first}) == len(first) and not any(re.search(dataset.NUMBER, c) for c in first)
    columns = first if header else [f"c{i + 1}" for i in range(len(first))]
    data = rows[1:] if header else rows
    types = [_type([r[i] if i < len(r) else "" for r in data]) for i in range(min(len(columns), dataset.MAX_COLUMNS))]
    return dataset.card(path, data[: dataset.HEAD_ROWS], types, len(data), columns, header)
