"""Chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation again each time it grows. A rolling hash names
every prefix of turns; a conversation whose full hash is a proper prefix of a
longer one is a snapshot and goes; of equal conversations the smallest id stays.
What is left is rendered.

Turns are put in order once, in spans of turn numbers, so one very long conversation
is walked by many tasks, and written with a digest each; hashing and comparing move
digests only, and texts meet again for the conversations that stay.

Defined cases: turns order by (turn, role, text), nulls first, so ties and repeated
rows are turns of their own; turns without a number form one span; null role or text
counts as empty but differs from empty in the hash; rows without conv_id form one
conversation with a null id, which is the smallest of equal ones only if no other has
an id; texts of any length are hashed and rendered whole; an empty table gives an
empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.sources.scratch import Workspace

#: Turn numbers of one conversation that a task walks at once.
SPAN = 256


def _ordered(conversations: DataFrame) -> DataFrame:
    """``conv_id, span, n, role, text, d1, d2``: turns with their ordinal in the span and a 128-bit digest."""
    span = F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(2**62)))
    order = W.partitionBy("conv_id", "span").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    fields = [F.col("role"), F.col("role").isNull(), F.col("text"), F.col("text").isNull()]
    digests = [F.xxhash64(F.lit(seed), *fields).alias(name) for name, seed in (("d1", "a"), ("d2", "b"))]
    turns = conversations.select("conv_id", "turn", "role", "text").withColumn("span", span)
    return turns.select("conv_id", "span", F.row_number().over(order).alias("n"), "role", "text", *digests)


def _running(turns: DataFrame, ws: Workspace) -> DataFrame:
    """``conv_id, n, last, h1, h2``: the rolling hash of the turns up to the n-th of a conversation of ``last``."""
    digests = turns.select("conv_id", "span", "n", "d1", "d2")
    upto = W.partitionBy("conv_id").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    sizes = digests.groupBy("conv_id", "span").agg(F.count("*").alias("c"))
    ahead = sizes.select("conv_id", "span", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("ahead"), F.sum("c").over(W.partitionBy("conv_id")).alias("last"))
    placed = _same(digests, ahead).withColumn("n", F.col("n") + F.col("ahead"))
    hashed = [F.xxhash64(F.lit(seed), "n", "d1", "d2").alias(name) for name, seed in (("x1", "a"), ("x2", "b"))]
    so_far = W.partitionBy("conv_id", "span").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    local = placed.select("conv_id", "span", "n", "last", *hashed)
    local = ws.put(local.select("conv_id", "span", "n", "last", *[F.bit_xor(f"x{k}").over(so_far).alias(f"l{k}") for k in (1, 2)]))
    ends = local.groupBy("conv_id", "span").agg(F.max_by(F.struct("l1", "l2"), "n").alias("t"))
    before = ends.select("conv_id", "span", *[F.coalesce(F.bit_xor(f"t.l{k}").over(upto), F.lit(0)).alias(f"p{k}") for k in (1, 2)])
    mixed = [F.col(f"l{k}").bitwiseXOR(F.col(f"p{k}")).alias(f"h{k}") for k in (1, 2)]
    return _same(local, before).select("conv_id", "n", "last", *mixed)


def _same(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on conversation and span; null ids are equal to each other."""
    r = right.withColumnsRenamed({"conv_id": "r_conv", "span": "r_span"})
    on = left["conv_id"].eqNullSafe(r["r_conv"]) & (left["span"] == r["r_span"])
    return left.join(r, on).drop("r_conv", "r_span")


def maximal(conversations: DataFrame) -> DataFrame:
    """Turns of the conversations that no longer or equal one covers: ``conv_id, span, n, role, text, n_collapsed``."""
    ws = Workspace(conversations.sparkSession, "chat")
    turns = ws.put(_ordered(conversations))
    named = ws.put(_running(turns, ws))
    whole = named.where("n = last").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("k_conv"), F.count("*").alias("copies"))
    inner = named.where("n < last").select("n", "h1", "h2").distinct()
    kept = whole.join(inner, ["n", "h1", "h2"], "left_anti").select("k_conv", (F.col("copies") - 1).alias("n_collapsed"))
    out = turns.join(kept, turns["conv_id"].eqNullSafe(kept["k_conv"]))
    return out.select("conv_id", "span", "n", "role", "text", "n_collapsed")


def render_turn(role: Column, text: Column) -> Column:
    """One turn in the common im_start / im_end markup."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row for each maximal conversation: ``conv_id, n_turns, n_copies_collapsed, rendered``."""
    rows = maximal(conversations).withColumn("turn_text", render_turn(F.col("role"), F.col("text")))
    parts = F.array_sort(F.collect_list(F.struct("span", "n", "turn_text")))
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.first("n_collapsed").alias("n_copies_collapsed"),
        F.array_join(F.transform(parts, lambda p: p["turn_text"]), "").alias("rendered"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP6_SQL = """
WITH t AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM conversations
), p AS (
  SELECT conv_id, n, role, text,
         list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS seq,
         count(*) OVER (PARTITION BY conv_id) AS last
  FROM t
), g AS (
  SELECT seq, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE n = last GROUP BY seq
), k AS (
  SELECT g.conv_id, g.copies FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n < p.last AND p.seq = g.seq)
)
SELECT k.conv_id, count(*) AS n_turns, k.copies - 1 AS n_copies_collapsed,
       string_agg('<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10), '' ORDER BY t.n) AS rendered
FROM k JOIN t ON t.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY k.conv_id, k.copies
"""
