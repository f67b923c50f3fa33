"""Preference formatting with DataFrame functions only.

A pair is a chosen and a rejected conversation.  Their longest common prefix of turns is
rendered once, as the prompt; what follows in either is its completion, of which only the
assistant's words count for the loss.

``format_pairs`` gives one row per turn and message, so a conversation of any length stays in
many rows: messages are counted by (pair, turn, role, text) on both sides, the first turn whose
messages differ is a pre-aggregated minimum, and a lookup dealt to several keys brings it back,
so one very long conversation isn't one hot key.  ``assemble`` renders the rows: a row per pair and
piece of PIECE turn numbers, so that an output row is bounded too; all but very long
conversations are one piece.  Masks are run lengths, "skipped:counted" for each message in order.

The query pairs plain conversations, which have no preferences: ranked by their first message (its
MD5 sum) and conv_id, those of ranks 2k and 2k + 1 are chosen and rejected, so conversations
with the same opening meet.  All rows of all conversations take part; the last of an odd number
has an empty partner.

Edge cases: messages that share (pair, turn) are rendered in order of role and text, each as often
as it occurs, and the turn is common if both sides have the same messages; null roles and
texts are compared as equal and rendered as empty; a null turn comes before all others; rows with a
null pair or conversation id belong to no conversation and give nothing; equal conversations are
all prompt, with empty completions; a conversation that the other one continues has an empty
completion; texts may have any length; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import looked_up
from .storage import Stored, read, shuffle_partitions

FIRST_TURN = -(1 << 63)
#: Turn numbers of a piece.
PIECE = 64


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"))


def body(text: Column) -> Column:
    return F.concat(F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def format_pairs(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Rows (pair, part, turn, role, text, copies), part being prompt, chosen or rejected."""
    said = lambda frame, side: frame.filter(F.col(pair).isNotNull()).select(pair, F.coalesce("turn", F.lit(FIRST_TURN)).alias("turn"), "role", "text", F.lit(side).alias("side"))
    return _parted(said(chosen, 0).unionByName(said(rejected, 1)), pair)


def _parted(both: DataFrame, pair: str) -> DataFrame:
    """Rows (pair, turn, role, text, side), side 0 being chosen, to those of ``format_pairs``."""
    count = lambda side: F.count(F.when(F.col("side") == side, 1))
    lined_up = both.groupBy(pair, "turn", "role", "text").agg(count(0).alias("chosen"), count(1).alias("rejected"))
    parted = lined_up.groupBy(pair).agg(F.min(F.when(F.col("chosen") != F.col("rejected"), F.col("turn"))).alias("parts_at"))
    rows = looked_up(lined_up, pair, "turn", parted)
    common = F.col("parts_at").isNull() | (F.col("turn") < F.col("parts_at"))
    one = lambda part: F.struct(F.lit(part).alias("part"), F.col("chosen" if part == "prompt" else part).alias("copies"))
    parts = F.when(common, F.array(one("prompt"))).otherwise(F.array(one("chosen"), one("rejected")))
    return rows.select(pair, "turn", "role", "text", F.explode(F.filter(parts, lambda p: p["copies"] > 0)).alias("p")).select(pair, "p.part", "turn", "role", "text", "p.copies")


def assemble(rows: DataFrame, pair: str = "pair_id") -> DataFrame:
    """One row per pair and piece: prompt, chosen and rejected as text, and the masks of the completions."""

    def joined(part: str) -> list[Column]:
        own = F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("turn", "role", "text", "copies"))))
        repeated = lambda c, r: F.repeat(c, r["copies"].cast("int"))
        text = F.array_join(F.transform(own, lambda r: repeated(F.concat(header(r["role"]), body(r["text"])), r)), "").alias(part)
        head, rest = lambda r: F.length(header(r["role"])), lambda r: F.length(body(r["text"]))
        counted = lambda r: F.coalesce(r["role"] == "assistant", F.lit(False))
        span = lambda r: F.when(counted(r), F.format_string("%d:%d ", head(r), rest(r))).otherwise(F.format_string("%d:0 ", head(r) + rest(r)))
        mask = F.rtrim(F.array_join(F.transform(own, lambda r: repeated(span(r), r)), "")).alias(f"{part}_mask")
        return [text] if part == "prompt" else [text, mask]

    piece = F.floor(F.col("turn") / PIECE).cast("long").alias("piece")
    return rows.groupBy(pair, piece).agg(*(c for part in ("prompt", "chosen", "rejected") for c in joined(part)))


def ranked(conversations: DataFrame) -> DataFrame:
    """(conv_id, pair_id, side): conversations in order of the MD5 sum of their first message and their id, two to a pair.

    They are sorted by ranges and numbered within each; ranges, of which there are as many as shuffle
    partitions, are summed up.  The numbers are written, so they are the same for all who read them."""
    spark = conversations.sparkSession
    first = conversations.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("f"))
    key = F.md5(F.concat(F.coalesce("f.role", F.lit("")), F.lit("\n"), F.coalesce("f.text", F.lit(""))))
    ordered = first.select("conv_id", key.alias("key")).repartitionByRange(shuffle_partitions(spark), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    number = F.monotonically_increasing_id()
    placed = Stored(ordered.select("conv_id", F.shiftright(number, 33).alias("range"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("within")), "preference-ranks").frame
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", before.alias("start"))
    rank = F.col("start") + F.col("within")
    return placed.join(F.broadcast(starts), "range").select("conv_id", F.floor(rank / 2).cast("long").alias("pair_id"), (rank % 2).cast("int").alias("side"))


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").filter("conv_id is not null").select("conv_id", F.coalesce("turn", F.lit(FIRST_TURN)).alias("turn"), "role", "text")
    pairs = ranked(turns)
    ids = pairs.groupBy("pair_id").agg(*(F.max(F.when(F.col("side") == side, F.col("conv_id"))).alias(name) for side, name in enumerate(("chosen_id", "rejected_id"))))
    both = looked_up(turns, "conv_id", "turn", pairs).select("pair_id", "turn", "role", "text", "side")
    return assemble(_parted(both, "pair_id")).join(ids, "pair_id")


OP6_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(turn, {FIRST_TURN}) AS turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), opened AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS k FROM turns
), ranks AS (
  SELECT conv_id, row_number() OVER (ORDER BY md5(coalesce(role, '') || chr(10) || coalesce(text, '')), conv_id) - 1 AS r FROM opened WHERE k = 1
), ids AS (
  SELECT r // 2 AS pair_id, max(conv_id) FILTER (WHERE r % 2 = 0) AS chosen_id, max(conv_id) FILTER (WHERE r % 2 = 1) AS rejected_id FROM ranks GROUP BY 1
), lined_up AS (
  SELECT r // 2 AS pair_id, turn, role, text, count(*) FILTER (WHERE r % 2 = 0) AS c, count(*) FILTER (WHERE r % 2 = 1) AS j FROM turns JOIN ranks USING (conv_id) GROUP BY ALL
), parted AS (
  SELECT pair_id, min(turn) FILTER (WHERE c <> j) AS parts_at FROM lined_up GROUP BY 1
), rendered AS (
  SELECT l.*, coalesce(turn < parts_at, true) AS common, '<|' || coalesce(role, '') || '|>' || chr(10) AS head, coalesce(text, '') || '<|end|>' || chr(10) AS body FROM lined_up l JOIN parted USING (pair_id)
), masked AS (
  SELECT *, CASE WHEN role = 'assistant' THEN length(head) || ':' || length(body) || ' ' ELSE (length(head) + length(body)) || ':0 ' END AS span FROM rendered
), pieces AS (
  SELECT pair_id, floor(turn / {PIECE}.0)::BIGINT AS piece,
    coalesce(string_agg(repeat(head || body, c), '' ORDER BY turn, role, text) FILTER (WHERE common), '') AS prompt,
    coalesce(string_agg(repeat(head || body, c), '' ORDER BY turn, role, text) FILTER (WHERE NOT common), '') AS chosen,
    rtrim(coalesce(string_agg(repeat(span, c), '' ORDER BY turn, role, text) FILTER (WHERE NOT common), '')) AS chosen_mask,
    coalesce(string_agg(repeat(head || body, j), '' ORDER BY turn, role, text) FILTER (WHERE NOT common), '') AS rejected,
    rtrim(coalesce(string_agg(repeat(span, j), '' ORDER BY turn, role, text) FILTER (WHERE NOT common), '')) AS rejected_mask
  FROM masked GROUP BY 1, 2
)
SELECT pieces.*, chosen_id, rejected_id FROM pieces JOIN ids USING (pair_id)
"""
