"""Chat formatting: a finite-state machine over roles, and a declarative template.

``TEMPLATE`` says what opens, heads and closes a turn, which roles carry loss,
and which transitions between roles are allowed. ``format_chats`` checks the turn
order, and emits for each conversation an array of segments ``(text, loss)``;
the formatted text is their concatenation. Control strings inside roles and
texts are escaped by entities and unescaped without loss, so the turns can be
read back from the formatted text alone.

Defined results: a null text or role is empty. Turns with equal numbers (also
null ones, which come first) are ordered by role, then text; repeated rows are
repeated turns. A conversation of invalid order is formatted all the same,
``valid`` is false and ``bad_turn`` is the place (from 0) of the first turn the
machine does not allow, or the number of turns if it only ends too early. A null
conversation id is a conversation. No rows: no conversations. Other columns
are not read, whatever their names. A conversation's turns come to one task, since its
text is one, so it has to fit there (2 GB); different conversations are spread by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.llm.common import let, table

TEMPLATE = {
    "open": "<s>[INST]",
    "head_end": "[/INST]",
    "close": "</s>",
    "loss": ("assistant",),
    # escape: (pattern over raw text, entity that replaces the first character, that character)
    "escape": ((r"&((?:amp|lt|lb);)", "&amp;", "&"), (r"<(/?s>)", "&lt;", "<"), (r"\[(/?INST\])", "&lb;", "[")),
    "start": "start",
    "accept": ("answered",),
    "moves": {
        ("start", "system"): "primed",
        ("start", "user"): "asked",
        ("primed", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    },
}


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    for pattern, entity, _ in template["escape"]:
        text = F.regexp_replace(text, pattern, f"{entity}$1")
    return text


def unescape(text: Column, template: dict = TEMPLATE) -> Column:
    for _, entity, raw in reversed(template["escape"]):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def _walk(turns: Column, template: dict) -> Column:
    """State after all turns, and the place of the first one that is not allowed."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in template["moves"].items() for x in (f"{state}\n{role}", to)])

    def step(acc: Column, turn: Column) -> Column:
        to = F.try_element_at(moves, F.concat(acc["state"], F.lit("\n"), turn["role"]))
        bad = F.when(acc["bad"] >= 0, acc["bad"]).when(to.isNull(), acc["n"]).otherwise(F.lit(-1))
        return F.struct(F.coalesce(to, F.lit("failed")).alias("state"), bad.alias("bad"), (acc["n"] + 1).alias("n"))

    return F.aggregate(turns, F.struct(F.lit(template["start"]).alias("state"), F.lit(-1).alias("bad"), F.lit(0).alias("n")), step)


def format_chats(chats: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """``chats(conv_id, turn, role, text)`` -> ``conv_id, segments, formatted, valid, bad_turn``."""
    empty = F.lit("")
    rows = chats.select("conv_id", F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of_turn(t: Column) -> Column:
        head = F.concat(F.lit(template["open"]), escape(t["role"], template), F.lit(template["head_end"]))
        return F.array(
            segment(head, F.lit(False)),
            segment(escape(t["text"], template), t["role"].isin(*template["loss"])),
            segment(F.lit(template["close"]), F.lit(False)),
        )

    both = grouped.select("conv_id", F.flatten(F.transform("turns", of_turn)).alias("segments"), _walk(F.col("turns"), template).alias("end"))
    accepted = F.col("end.state").isin(*template["accept"])
    return both.select(
        "conv_id", "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (accepted & (F.col("end.bad") < 0)).alias("valid"),
        F.when(F.col("end.bad") >= 0, F.col("end.bad")).when(~accepted, F.col("end.n")).alias("bad_turn"),
    )


def read_turns(formatted: Column, template: dict = TEMPLATE) -> Column:
    """Array of ``(role, text)`` read back from the formatted text."""
    parts = F.split(formatted, template["close"])  # the markers hold no regex meta characters but brackets, and close has none
    parts = let(parts, lambda p: F.slice(p, F.lit(1), F.size(p) - 1))

    def parse(part: Column) -> Column:
        head = F.substring_index(part, template["head_end"], 1)
        role = F.substring_index(head, template["open"], -1)
        text = F.substring_index(part, template["head_end"], -1)
        return F.struct(unescape(role, template).alias("role"), unescape(text, template).alias("text"))

    return F.transform(parts, parse)


def loss_text(segments: Column, template: dict = TEMPLATE) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")


#: Conversation -1: control strings inside texts.
CONTROL = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(CONTROL).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("t")).select("conv_id", "t.*")
    done = format_chats(chats.unionByName(extra))
    back = done.select("conv_id", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars", "valid",
    )


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
e AS (
  SELECT *, length(regexp_replace(regexp_replace(regexp_replace(role, '&((?:amp|lt|lb);)', '&amp;\1', 'g'), '<(/?s>)', '&lt;\1', 'g'), '\[(/?INST\])', '&lb;\1', 'g'))
          + length(regexp_replace(regexp_replace(regexp_replace(text, '&((?:amp|lt|lb);)', '&amp;\1', 'g'), '<(/?s>)', '&lt;\1', 'g'), '\[(/?INST\])', '&lb;\1', 'g')) + 20 AS f
  FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(f)::BIGINT AS formatted_chars,
       regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)+') AS valid
FROM e GROUP BY conv_id
"""
