"""Chat formatting: cumulative snapshots of one conversation collapse to the longest before rendering.

Logs often hold a conversation again at every turn. Each turn extends a rolling hash of all turns up to it (the XOR
of a 128-bit hash of place, role and text, so it grows turn by turn without any chain). A conversation whose whole
hash is the hash of a proper prefix of another one is such a snapshot; an anti-join leaves the maximal ones. Of equal
conversations the smallest id stays. What stays is rendered once, in a template with marks around every turn.

Turns are ordered by their number, then role and text, nulls first; repeated rows are turns of their own. A null
role or text is empty. Rows without a conversation id belong to no conversation and give no output. Extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Stored


@dataclass(frozen=True)
class Template:
    """Text around each turn; ``{role}`` stands for the role."""

    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"
    #: Roles whose text a model is trained on.
    trained: tuple[str, ...] = ("assistant",)


def _turns(rows: DataFrame) -> DataFrame:
    """Place and rolling hashes of every turn."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.withColumn("place", F.row_number().over(order))
    own = [F.xxhash64(F.lit(seed), "place", "role", "text") for seed in ("a", "b")]
    placed = placed.withColumn("h1", own[0]).withColumn("h2", own[1])
    so_far = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("h1", F.bit_xor("h1").over(so_far)).withColumn("h2", F.bit_xor("h2").over(so_far))


def maximal(conversations: DataFrame) -> DataFrame:
    """Columns conv_id, n_turns, n_snapshots of the conversations that stay; n_snapshots counts those that went for equal ones."""
    return _maximal(_turns(_rows(conversations))).select("conv_id", "n_turns", "n_equal")


def _rows(conversations: DataFrame) -> DataFrame:
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def _maximal(turns: DataFrame) -> DataFrame:
    last = Window.partitionBy("conv_id")
    ends = turns.select("conv_id", "place", "h1", "h2").withColumn("n_turns", F.max("place").over(last))
    whole = ends.where("place = n_turns").groupBy("n_turns", "h1", "h2")
    whole = whole.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    proper = ends.where("place < n_turns").select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(proper, ["n_turns", "h1", "h2"], "left_anti")


def _rendered(turns: Column, template: Template) -> tuple[Column, Column]:
    """The text, and start:end of each trained turn within it."""

    def head(role: Column) -> Column:
        return F.replace(F.lit(template.before), F.lit("{role}"), role)

    pieces = F.transform(turns, lambda t: F.concat(head(t["role"]), t["text"], F.lit(template.after)))
    start = F.struct(F.array().cast("array<string>").alias("spans"), F.lit(0).alias("at"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(head(t["role"]))
        end = begin + F.length(t["text"])
        span = F.array(F.concat_ws(":", begin, end))
        spans = F.when(t["role"].isin(*template.trained), F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(spans.alias("spans"), (end + len(template.after)).alias("at"))

    return F.array_join(pieces, ""), F.aggregate(turns, start, step, lambda state: F.array_join(state["spans"], ","))


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Columns conv_id, n_turns, n_equal, rendered, trained_spans of every maximal conversation."""
    stored = Stored(conversations.sparkSession, "chats")
    turns = _turns(_rows(conversations))
    kept = stored.keep(_maximal(turns), "kept")
    rows = _rows(conversations).join(kept.select("conv_id", "n_turns", "n_equal"), "conv_id")
    order = F.struct("turn", "role", "text")
    chats = rows.groupBy("conv_id", "n_turns", "n_equal").agg(F.array_sort(F.collect_list(order)).alias("turns"))
    text, spans = _rendered(F.col("turns"), template or Template())
    return chats.select("conv_id", "n_turns", "n_equal", text.alias("rendered"), spans.alias("trained_spans"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all logged conversations."""
    found = format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    counts = [F.col(name).cast("long").alias(name) for name in ("n_turns", "n_equal")]
    return found.select("conv_id", *counts, "rendered", "trained_spans")


ORACLE = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER same AS place, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         '<|im_start|>' || role || chr(10) AS head, head || text || '<|im_end|>' || chr(10) AS piece
  FROM turns WINDOW same AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), grown AS (
  SELECT conv_id, place, n_turns,
         string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER so_far AS prefix,
         CASE WHEN role = 'assistant' THEN (sum(length(piece)) OVER so_far - length(piece) + length(head)) || ':' ||
              (sum(length(piece)) OVER so_far - length(piece) + length(head) + length(text)) END AS span, piece
  FROM placed WINDOW so_far AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)
), kept AS (
  SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_equal FROM grown WHERE place = n_turns GROUP BY prefix
  HAVING prefix NOT IN (SELECT prefix FROM grown WHERE place < n_turns)
)
SELECT conv_id, max(n_turns) AS n_turns, max(n_equal) AS n_equal, string_agg(piece, '' ORDER BY place) AS rendered,
       coalesce(string_agg(span, ',' ORDER BY place), '') AS trained_spans
FROM grown JOIN kept USING (conv_id) GROUP BY conv_id
"""
