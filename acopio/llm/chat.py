"""Operator 8: chat formatting of reply trees, with DataFrame functions only.

Method: messages point at the message they answer.  Self-joins that double their reach
(a node's ancestor 1, 2, 4, ... steps up) list every root-to-leaf path: the number of rounds
is the logarithm of the deepest thread, and a round's rows are those of the paths found.
Branches of a tree are ranked by the sum of their messages' scores (ties: the smaller leaf); then
the chosen ones alone get their texts, and each is formatted, root first, as one conversation.

Template: <|im_start|>ROLE\\nTEXT<|im_end|>\\n a turn.  Inside roles and texts each "<", any
backslashes, "|" gets one more backslash, so no control string is left, and taking one away
restores the text; in roles "%" and new lines are written %25 and %0A.

Defined results: null text, role: empty; a message whose parent is missing is a root; messages
on or below a cycle are on no path; equal turns are ordered by role, then text; null turns
come first; rows with a null conv_id form one conversation; an empty table gives no rows; other columns, whatever
their names, are not looked at.  One conversation is one string
and so one row of one task: it must fit there, whatever the rest of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acopio.llm.shared import Table, written

START, END = "<|im_start|>", "<|im_end|>"
SAID = f"{END}{START}assistant ok"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\|", r"<$1\\|")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\\\|", r"<$1|")


def escape_role(x: Column) -> Column:
    return escape(F.replace(F.replace(x, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(x: Column) -> Column:
    return F.replace(F.replace(unescape(x), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def paths(nodes: DataFrame, tables: list[Table] | None = None) -> DataFrame:
    """Root-to-leaf paths of nodes (node, parent): rows (leaf, node, up), up: steps above the leaf.

    ``nodes`` is read a few times, so it should be a written table; ``tables`` gets the written tables
    that the result reads.
    """
    spark = nodes.sparkSession
    parents = nodes.where(F.col("parent").isNotNull()).select("node", "parent")
    real = parents.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi")
    jumps = written(real.select("node", F.col("parent").alias("above")).where("node <> above"))
    leaves = nodes.select("node").join(jumps.df().select(F.col("above").alias("node")), "node", "left_anti")
    found = [leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))]
    old: list[Table] = []
    reach, total = 1, nodes.count()
    while reach <= total and not jumps.df().isEmpty():
        so_far = found[0]
        for x in found[1:]:
            so_far = so_far.unionByName(x)
        more = written(so_far.join(jumps.df(), "node").select("leaf", F.col("above").alias("node"), (F.col("up") + reach).alias("up")))
        found.append(more.df())
        old.append(more)
        a, b = jumps.df(), jumps.df().select(F.col("node").alias("above"), F.col("above").alias("top"))
        old.append(jumps)
        jumps = written(a.join(b, "above").select("node", F.col("top").alias("above")))
        reach *= 2
    if tables is not None:
        tables += [*old, jumps]
    all_rows = found[0]
    for x in found[1:]:
        all_rows = all_rows.unionByName(x)
    if reach > total and not jumps.df().isEmpty():  # cycles: a path must end in a root
        roots = nodes.join(real.select("node"), "node", "left_anti").select("node")
        all_rows = all_rows.join(all_rows.join(roots, "node", "left_semi").select("leaf").distinct(), "leaf", "left_semi").distinct()
    return all_rows


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Messages (tree, node, parent, role, text, score) to conversations: tree, leaf, formatted and
    loss, the spans (start, length, in characters) of assistants' texts within formatted."""
    table, parts = written(messages), []
    nodes = table.df()
    found = written(paths(nodes.select("node", "parent"), parts))
    for t in parts:
        t.drop()
    steps = found.df()
    if branches:
        # scores alone say which branches stay; only theirs get texts
        scores = steps.join(nodes.select("node", "tree", F.coalesce("score", F.lit(0.0)).alias("score")), "node").groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
        best = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
        steps = steps.join(scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches).select("leaf"), "leaf", "left_semi")
    steps = steps.join(nodes.select("node", "tree", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), "node")
    branch = Window.partitionBy("tree", "leaf")
    above = branch.orderBy(F.desc("up"))
    inner = escape(F.col("text"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turn = steps.withColumns({"head": head, "inner": inner}).withColumn("turn", F.concat("head", "inner", F.lit(END + "\n")))
    turn = turn.withColumn("ends", F.sum(F.char_length("turn")).over(above))
    span = F.struct((F.col("ends") - F.char_length("turn") + F.char_length("head")).cast("long").alias("start"), F.char_length("inner").cast("long").alias("length"))
    rows = turn.groupBy("tree", "leaf").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "turn", F.when(F.col("role") == "assistant", span).alias("span")))).alias("turns"),
    )
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return rows.select("tree", "leaf", F.concat_ws("", F.transform("turns", lambda t: t["turn"])).alias("formatted"), spans.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns in a formatted conversation: array of (role, text)."""
    parts = F.split(formatted, r"<\|im_start\|>")

    def one(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substr(part, F.char_length(role) + 2, F.char_length(part) - F.char_length(role) - 1 - len(END) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(parts, 2, F.size(parts)), one)


def thread(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages, each answering the one before it."""
    key = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    at = F.row_number().over(key)
    name = lambda n: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("?")), F.lit("/"), F.lpad(n.cast("string"), 12, "0"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("at", at)
    return rows.select(F.col("conv_id").alias("tree"), name(F.col("at")).alias("node"), F.when(F.col("at") > 1, name(F.col("at") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op8_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAID).alias("text"))
    made = format_trees(thread(rows.unionByName(extra)))
    hashed = lambda x: F.sha2(x.cast("binary"), 256)
    back = made.withColumn("turns", read_back(F.col("formatted"))).withColumn("lost", F.concat_ws("", F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), hashed(said).alias("turns_sha256"), F.char_length("lost").cast("long").alias("loss_chars"),
        hashed(F.col("lost")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
