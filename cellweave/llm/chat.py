"""Chat formatting: reply trees to conversations, by self-joins, in DataFrame functions only.

Nodes name their parent. Ancestors at doubling distances come from self-joins; from each leaf they fill in its path to
the root, so that a path of n turns takes log2(n) joins. A conversation's branches are ranked by their summed score,
and each chosen one is formatted as a string of turns with a mask of what counts for the loss.

Template: <|im_start|>role, a line end, the text, <|im_end|> and a line end, for each turn. In roles and texts the
characters \\ < [ are written \\b \\l \\k (and a line end in a role \\e), so that no control string of this or the
usual templates can stand in them, and reading back is exact.

Defined results: a null text or role is empty; null conversation ids are one conversation; a parent that is missing,
null or not before its node makes the node a root; rows of equal turn follow each other by role and text; equal rows
are turns of their own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import drop, keep

START, END = "<|im_start|>", "<|im_end|>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\k"))
#: Turns whose pieces are joined at once, before the pieces of a path are.
CHUNK = 256


def escape(text: Column, role: bool = False) -> Column:
    for plain, written in (*ESCAPES, *((("\n", "\\e"),) if role else ())):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for plain, written in reversed((*ESCAPES, *((("\n", "\\e"),) if role else ()))):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def linear_nodes(turns: DataFrame) -> DataFrame:
    """conv, conv_id, node, parent, role, text, score of rows (conv_id, turn, role, text): each turn replies to the one
    before. Turns are numbered by runs of CHUNK turn numbers first, so that no task numbers a whole conversation."""
    rows = turns.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("run", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(2**62))))
    counts = rows.groupBy("conv", "run").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rows = rows.join(counts, ["conv", "run"]).withColumn("node", F.col("before") + F.row_number().over(W.partitionBy("conv", "run").orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    return rows.select("conv", "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def root_to_leaf_paths(nodes: DataFrame) -> DataFrame:
    """(conv, leaf, node, steps): the nodes of each leaf's path, steps above the leaf."""
    ids = nodes.select("conv", "node", "parent")
    known = ids.select("conv", F.col("node").alias("parent"))
    up = keep(ids.where("parent < node").join(known, ["conv", "parent"], "left_semi").select("conv", "node", F.col("parent").alias("up")), "up")
    jumps = [up]
    while True:
        last = jumps[-1]
        ahead = last.select("conv", F.col("node").alias("up"), F.col("up").alias("far"))
        far = keep(last.join(ahead, ["conv", "up"]).select("conv", "node", F.col("far").alias("up")), "up")
        if far.isEmpty():
            break
        jumps.append(far)
    leaves = ids.select("conv", "node").join(up.select("conv", F.col("up").alias("node")), ["conv", "node"], "left_anti")
    paths = leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("steps"))
    paths = keep(paths, "paths")
    for k in reversed(range(len(jumps))):  # written each time: the plan would double with every join
        higher = paths.join(jumps[k], ["conv", "node"]).select("conv", "leaf", F.col("up").alias("node"), (F.col("steps") + 2**k).alias("steps"))
        longer = keep(paths.unionByName(higher), "paths")
        drop(paths)
        paths = longer
    drop(*jumps)
    return paths


def format_trees(nodes: DataFrame, branches: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, leaf, rank, formatted, loss_spans) for each chosen branch; branches: how many of the best, None for all.

    loss_spans are the code point offsets in formatted of the texts of loss_role, in order.
    """
    paths = root_to_leaf_paths(nodes)
    # Branches are ranked on ids and scores; texts meet the chosen ones alone.
    scores = paths.join(nodes.select("conv", "node", "score"), ["conv", "node"]).groupBy("conv", "leaf").agg(F.sum("score").alias("total"))
    scores = scores.withColumn("rank", F.row_number().over(W.partitionBy("conv").orderBy(F.desc("total"), "leaf")))
    if branches is not None:
        scores = scores.where(F.col("rank") <= branches)
    head = F.concat(F.lit(START), escape(F.col("role"), role=True), F.lit("\n"))
    body = escape(F.col("text"))
    turn = F.struct((-F.col("steps")).alias("at"), F.concat(head, body, F.lit(END)).alias("piece"), F.char_length(head).alias("head"), F.char_length(body).alias("body"), (F.col("role") == loss_role).alias("loss"))
    rows = paths.join(scores.select("conv", "leaf", "rank"), ["conv", "leaf"]).join(nodes.drop("score"), ["conv", "node"])
    # Pieces of runs of CHUNK turns first, then those of a path.
    runs = rows.groupBy("conv", "leaf", "rank", F.floor(F.col("steps") / CHUNK).alias("run")).agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(turn)).alias("turns"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    walked = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["head"] + t["body"] + len(END)).alias("at"),
            F.when(t["loss"], F.array_append(acc["spans"], F.struct((acc["at"] + t["head"]).alias("start"), (acc["at"] + t["head"] + t["body"]).alias("end")))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    runs = runs.select("conv", "leaf", "rank", "run", "conv_id", F.concat_ws("", F.transform("turns", lambda t: t["piece"])).alias("piece"), walked.alias("walked"))
    whole = runs.groupBy("conv", "leaf", "rank").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct((-F.col("run")).alias("at"), "piece", F.col("walked.at").alias("length"), F.col("walked.spans").alias("spans")))).alias("runs"))
    starts = F.aggregate("runs", F.array(F.lit(0)), lambda acc, r: F.array_append(acc, F.element_at(acc, -1) + r["length"]))
    spans = F.flatten(F.zip_with("runs", starts, lambda r, at: F.transform(F.coalesce(r["spans"], empty), lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end")))))
    return whole.select("conv_id", "leaf", "rank", F.concat_ws("", F.transform("runs", lambda r: r["piece"])).alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.replace(p, F.lit(START), F.lit("")), "\n", 1), role=True).alias("role"),
            unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
        ),
    )


def digests(formatted: DataFrame) -> DataFrame:
    turns = read_back(F.col("formatted"))
    loss = F.concat_ws("", F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))))
    rows = formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_chat_formatting(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), tricky.alias("text"))
    return digests(format_trees(linear_nodes(turns.unionByName(more)), branches=1))


SQL = {
    "op8_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS t,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS l,
  sum(24 + length(role) + length(regexp_replace(role, '[^\\<\[\n]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g'))) AS f
  FROM c GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n AS BIGINT) AS n_turns, sha256(t) AS turns_sha256, CAST(length(l) AS BIGINT) AS loss_chars, sha256(l) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars FROM g"""
}
