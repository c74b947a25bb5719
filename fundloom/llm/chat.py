"""Chat formatting: reply trees to conversations, in Spark's own functions only.

Messages name their parents. Pointers up the tree are doubled by self-joins, which adds up each branch's score and
depth in log2(depth) rounds; the leaves of each conversation are ranked by their branches, and the same pointers are
walked from the longest to the shortest to enumerate the path from the root to each chosen leaf. Each path is
formatted as one conversation.

A turn is written <s>[INST] role [/INST]text</s>. Control strings inside a role or text get a backslash behind their
first character, and such ones with backslashes get one more, which reading takes away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundloom.llm.shared import materialize, saved

BEGIN, ROLE, TEXT, END = "<s>", "[INST] ", " [/INST]", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*/?s>)", r"<\\$1"), r"\[(\\*/?INST\])", r"[\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<\\(\\*/?s>)", "<$1"), r"\[\\(\\*/?INST\])", "[$1")


LEVEL = "conv string, id long, up long, total double, depth long"


def ranked_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """messages (conv string, id, parent, score): (conv, rank, id, depth) of the root-to-leaf paths, those of the best ranks or all.

    A message whose parent is missing is a root; a conversation may have several. Branches are ranked within their
    conversation by the sum of their scores, then by depth, then by the least id of the leaf. A missing score is 0.
    Messages in a circle of replies have no root and are left out.
    """
    nodes = materialize(messages.select("conv", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "messages")
    spark = nodes.sparkSession
    there = nodes.select("conv", F.col("id").alias("parent"), F.lit(True).alias("there"))
    level = nodes.join(there, ["conv", "parent"], "left").select("conv", "id", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"))
    # A table per round holds what the round before left on its way: up is null once a root is reached.
    paths, waiting = [saved(level, "level")], -1
    read = lambda names: spark.read.schema(LEVEL).parquet(*names)
    while True:
        active = read(paths[-1:]).where("up is not null")
        if (now := active.count()) in (0, waiting):
            break
        waiting = now
        # Only what is still on its way is doubled, against the messages of conversations in which something is.
        ended = read(paths).where("up is null").join(active.select("conv").distinct(), "conv", "left_semi")
        high = active.unionByName(ended).select("conv", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        doubled = active.join(high, ["conv", "up"], "left").select(
            "conv", "id", F.col("up2").alias("up"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth")
        )
        paths.append(saved(doubled, "level"))
    found = read(paths).where("up is null").select("conv", "id", "total", "depth")
    leaves = found.join(nodes.select("conv", F.col("parent").alias("id")).distinct(), ["conv", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("total"), F.desc("depth"), "id"))
    chosen = leaves.select("conv", rank.alias("rank"), "id")
    walk = materialize(chosen if best is None else chosen.where(F.col("rank") <= best), "walk")
    for path in reversed(paths):
        up = walk.join(read([path]).where("up is not null").select("conv", "id", "up"), ["conv", "id"], "left")
        walk = materialize(up.select("conv", "rank", F.explode(F.array_compact(F.array("id", "up"))).alias("id")), "walk")
    return walk.join(found.select("conv", "id", "depth"), ["conv", "id"]).select("conv", "rank", "id", "depth")


def format_paths(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """turns (conv, rank, depth, role, text) -> (conv, rank, formatted, mask): one string per path and the spans of the learnt texts in it."""
    head = F.concat(F.lit(BEGIN + ROLE), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    written = turns.select("conv", "rank", "depth", "role", F.concat(head, body, F.lit(END)).alias("turn"), F.length(head).alias("h"), F.length(body).alias("n"))
    start = F.sum(F.length("turn")).over(Window.partitionBy("conv", "rank").orderBy("depth")) - F.length("turn") + F.col("h")
    written = written.select("conv", "rank", "depth", "turn", F.when(F.col("role") == learn, F.struct(start.alias("start"), F.col("n").cast("long").alias("length"))).alias("span"))
    held = written.groupBy("conv", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "turn", "span"))).alias("turns"))
    return held.select("conv", "rank", F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"), F.array_compact(F.transform("turns", lambda x: x["span"])).alias("mask"))


def format_trees(messages: DataFrame, best: int | None = None, learn: str = "assistant") -> DataFrame:
    """messages (conv string, id, parent, score, role, text) -> (conv, rank, formatted, mask): each chosen path as one conversation.

    A null role or text is empty. best: how many branches of a conversation are formatted, from the first rank on; all by default.
    """
    said = messages.select("conv", "id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return format_paths(ranked_paths(messages, best).join(said, ["conv", "id"]), learn)


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    parts = F.filter(F.split(formatted, END), lambda x: x != "")
    field = lambda x, k: unescape(F.regexp_extract(x, r"(?s)^<s>\[INST\] (.*?) \[/INST\](.*)$", k))
    return F.transform(parts, lambda x: F.struct(field(x, 1).alias("role"), field(x, 2).alias("text")))


def learnt(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")


def as_tree(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) as replies, each to the turn before: (conv, id, parent, score, role, text). conv: c and the id, n without one."""
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text"))
    numbered = rows.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), order.cast("long").alias("id"))
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    return numbered.select(conv.alias("conv"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) per conversation of rows (conv_id, turn, role, text, ...).

    Rows by turn, those without one last, and by role and text where turns are equal, so repeated rows are turns of
    their own; each replies to the one before, so a conversation is a tree of one branch. A null text or role is empty;
    rows without conv_id are one conversation. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    out = format_trees(materialize(as_tree(rows.select("conv_id", "turn", "role", "text")), "turns"), best=1)
    out = out.select(F.when(F.col("conv") != "n", F.substring("conv", 2, 2**31 - 1)).cast(rows.schema["conv_id"].dataType).alias("conv_id"), "formatted", "mask")
    read = out.select("conv_id", parse(F.col("formatted")).alias("turns"), learnt(F.col("formatted"), F.col("mask")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(shown, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )
