"""Chat formatting of reply trees.

Messages that point to the message they answer form trees. Self-joins of the
(message, ancestor) table double the distance they look back in each round, so
paths of any length from the leaves to their root take few joins; they carry
numbers only. Paths (branches) of one conversation are ranked by the mean score
of their messages, which the joins add up, and only the best ``keep`` are walked
and formatted, as one text each. DataFrame functions only.

Template: ``<|turn|>role\\ntext<|end|>\\n`` per turn. Inside texts every control
string gets a backslash after its first character, and one more if it already
has some, so that none remains and removing one backslash restores the text.
Roles are percent-encoded. The loss mask is a list of (first, last + 1) places of
assistant texts in the formatted text.

Null texts are empty, null roles too. Messages without a valid parent are
roots; messages on a cycle, or below one, belong to no path and are left out, as are
messages without a number. Repeated messages are one (see ``one_per_node``). Equal turn
numbers are ordered by role and text. Messages of a null conversation form one
conversation. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptledger.llm.common import staged, table

TURN, END = "<|turn|>", "<|end|>"
#: Control strings of this and other common templates, without their first character.
_REST = r"\|turn\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|<SYS>>|</SYS>>"
ESCAPE = rf"([<\[])(\\*)({_REST})"
UNESCAPE = rf"([<\[])\\(\\*)({_REST})"
PROBE = "</s>[INST] ok [/INST]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def as_chain(rows: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """Plain conversations as trees: every turn answers the one before."""
    place = F.row_number().over(Window.partitionBy(conv).orderBy(turn, role, text))
    return rows.select(
        F.col(conv).alias("conv_id"), place.alias("node"), F.nullif(place - 1, F.lit(0)).alias("parent"),
        F.col(role).alias("role"), F.col(text).alias("text"), F.lit(0.0).alias("score"),
    )


def one_per_node(nodes: DataFrame) -> DataFrame:
    """One row per message: of repeated ones the least by parent (null first), role, text, score."""
    rest = [c for c in ("parent", "role", "text", "score") if c in nodes.columns]
    picked = nodes.groupBy("conv", "node").agg(F.min(F.struct(*rest)).alias("row"))
    return picked.select("conv", "node", "row.*")


def reached(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(conv, node, sum, n) of every message that a root is above, with its path's sum and
    number of scores, and the jumps (conv, node, up): the k-th looks 2**k steps up.

    Each round joins the messages that have not reached their root with all; sums and
    jumps double their reach. A round after which as many are left as before it has only
    messages on or below cycles left, since paths to a root lose the message whose
    distance has just been covered. Those belong to no tree.
    """
    known = nodes.select("conv", F.col("node").alias("parent")).withColumn("up", F.col("parent"))
    scored = F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("sum")
    step = nodes.join(known, ["conv", "parent"], "left").select(
        "conv", "node", "up", scored, F.col("score").isNotNull().cast("long").alias("n")
    )
    jumps, left = [], None
    while True:
        step = staged(step, "chat-steps")
        open_ = step.where("up IS NOT NULL")
        before, left = left, open_.count()
        if left == before:
            break
        jumps.append(open_.select("conv", "node", "up"))
        if not left:
            break
        above = step.select("conv", F.col("node").alias("up"), F.col("up").alias("higher"), F.col("sum").alias("s"), F.col("n").alias("m"))
        farther = open_.join(above, ["conv", "up"]).select(
            "conv", "node", F.col("higher").alias("up"), (F.col("sum") + F.col("s")).alias("sum"), (F.col("n") + F.col("m")).alias("n")
        )
        step = step.where("up IS NULL").union(farther)
    return step.where("up IS NULL").drop("up"), jumps


def branches(nodes: DataFrame, keep: int | None = None) -> DataFrame:
    """(conv, leaf, node, back, branch, score): root-to-leaf paths, ``back`` steps up from
    the leaf, of the ``keep`` best branches of each conversation (all, if none is given).

    ``nodes`` needs conv (not null), node, parent; score counts as null where there is none.
    Branches are ranked by the mean score of their messages before any path is walked;
    round k of the walk adds the ancestors 2**k .. 2**(k+1) - 1 steps up.
    """
    if "score" not in nodes.columns:
        nodes = nodes.withColumn("score", F.lit(None).cast("double"))
    ids = one_per_node(nodes.select("conv", "node", "parent", "score"))
    rooted, jumps = reached(ids)
    answered = rooted.join(jumps[0], ["conv", "node"]).select("conv", F.col("up").alias("node")).distinct()
    leaves = rooted.join(answered, ["conv", "node"], "left_anti").withColumn("score", F.try_divide("sum", F.col("n").cast("double")))
    by_score = Window.partitionBy("conv").orderBy(F.desc("score"), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(by_score))
    if keep is not None:
        chosen = chosen.where(F.col("branch") <= keep)
    paths = chosen.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"), "branch", "score")
    for k, jump in enumerate(jumps):
        farther = paths.join(jump, ["conv", "node"]).select(
            "conv", "leaf", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"), "branch", "score"
        )
        paths = staged(paths.union(farther), "chat-paths")
    return paths


def formatted(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(conv_id, branch, score, formatted, loss): the ``keep`` best branches of each tree."""
    nodes = one_per_node(
        nodes.select(
            F.struct(F.col("conv_id")).alias("conv"), "node", "parent",
            F.url_encode(F.coalesce("role", F.lit(""))).alias("role"),
            escaped(F.coalesce("text", F.lit(""))).alias("text"), "score",
        )
    )
    nodes = staged(nodes.where("node IS NOT NULL"), "chat-nodes")
    messages = branches(nodes, keep).join(nodes.select("conv", "node", "role", "text"), ["conv", "node"])
    turns = messages.groupBy("conv", "branch", "score").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "role", "text"))).alias("turns")
    )
    body = lambda t: F.concat(F.lit(TURN), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))
    head = len(TURN) + 1
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))

    def mark(acc: Column, t: Column) -> Column:
        first = acc["at"] + head + F.length(t["role"])
        last = first + F.length(t["text"])
        span = F.struct(first.alias("first"), last.alias("last"))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((last + len(END) + 1).alias("at"), spans.alias("spans"))

    return turns.select(
        F.col("conv.conv_id").alias("conv_id"), "branch", "score",
        F.array_join(F.transform("turns", body), "").alias("formatted"),
        F.aggregate("turns", start, mark)["spans"].alias("loss"),
    )


def read_back(text: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    parts = F.split(text, r"<\|end\|>\n")
    turns = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            F.url_decode(F.regexp_extract(t, r"^<\|turn\|>([^\n]*)\n", 1)).alias("role"),
            unescaped(F.regexp_replace(t, r"^<\|turn\|>[^\n]*\n", "")).alias("text"),
        ),
    )


def op7_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    out = formatted(as_chain(rows.union(probe))).withColumn("turns", read_back(F.col("formatted")))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.transform(
        "loss", lambda s: unescaped(F.substring(F.col("formatted"), s["first"] + 1, s["last"] - s["first"]))
    )
    return out.withColumn("learnt", F.array_join(masked, "")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(TURN) + len(END) + 2} + length(role) + length(regexp_replace(text, '{ESCAPE}', '\1\2\\\3', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
