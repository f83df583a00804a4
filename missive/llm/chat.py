"""Operator 1: chat formatting of reply trees (native).

A message names its parent; a tree of replies holds one conversation for each
chosen root-to-leaf path. Ancestors are found by iterative self-joins that
double their reach (a table maps every message to its 2**k-th ancestor), so a
path of n turns takes log2(n) joins, whose rows are spread by (tree, message).
The same joins add up scores along the way, leaves are ranked by their path's
score within each tree, and only the chosen leaves' paths are written out.

Template: a turn is ``<s>[INST]role[/INST]text</s>``. Control strings inside a
role or text get one backslash after their first character (and those that
have backslashes there get one more), so no control string is left inside a
turn and the step is undone by taking one backslash off. The loss mask lists,
per turn, the span of code points of its text, of length 0 unless the role is
``assistant``.

Defined cases: a null text or role counts as empty; a null tree id is a tree
of its own; a null or unknown parent, or a message naming itself, is a root; a
ring of replies is cut at its smallest message; rows that repeat a message id
are turns of that message, by role, then text; equal scores prefer the smaller
leaf; no rows give an empty result. Only one conversation's text meets in one
row, which is the output's form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive.session import materialise

LEARNED_ROLE = "assistant"
_OPEN, _HEAD_END, _END = "<s>[INST]", "[/INST]", "</s>"
#: Control strings without their first character, after any backslashes.
_ANGLE, _SQUARE = r"/?s>", r"/?INST\]"


def escape(col: Column) -> Column:
    out = F.regexp_replace(col, rf"<(\\*{_ANGLE})", r"<\\$1")
    return F.regexp_replace(out, rf"\[(\\*{_SQUARE})", r"[\\$1")


def unescape(col: Column) -> Column:
    out = F.regexp_replace(col, rf"<\\(\\*{_ANGLE})", "<$1")
    return F.regexp_replace(out, rf"\[\\(\\*{_SQUARE})", "[$1")


def _jump_tables(nodes: DataFrame) -> list[DataFrame]:
    """Tables k: (tree, node, up = 2**k-th ancestor, score and depth of the nodes before it, low)."""
    base = nodes.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    known = base.select(F.col("tree").alias("__t"), F.col("node").alias("__n"))
    up = F.when(F.col("__n") != F.col("node"), F.col("__n"))
    first = (base.join(known, F.col("tree").eqNullSafe(F.col("__t")) & (F.col("parent") == F.col("__n")), "left")
             .select("tree", "node", up.alias("up"), F.coalesce("score", F.lit(0.0)).alias("score"),
                     F.lit(1).cast("long").alias("depth"), up.alias("low")))
    first = materialise(first, "llm-chat-jump")
    return _double(first)


def _double(first: DataFrame) -> list[DataFrame]:
    size = first.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    tables = [first]
    while not tables[-1].filter("up is not null").isEmpty():
        if 1 << (len(tables) - 1) > size:  # longer than the largest tree: some messages answer in a ring
            ring = tables[-1].filter("up is not null and low = node").select(
                F.col("tree").alias("__t"), F.col("node").alias("__n"))
            cut = (tables[0].join(ring, F.col("tree").eqNullSafe(F.col("__t")) & (F.col("node") == F.col("__n")), "left")
                   .withColumn("up", F.when(F.col("__n").isNull(), F.col("up")))
                   .withColumn("low", F.col("up")).drop("__t", "__n"))
            return _double(materialise(cut, "llm-chat-jump"))
        last = tables[-1]
        far = last.select(F.col("tree").alias("__t"), F.col("node").alias("__n"), F.col("up").alias("__up"),
                          F.col("score").alias("__score"), F.col("depth").alias("__depth"), F.col("low").alias("__low"))
        # only messages that have not reached their root take part; all others are done
        going = last.filter("up is not null")
        step = (going.join(far, F.col("tree").eqNullSafe(F.col("__t")) & (F.col("up") == F.col("__n")))
                .select("tree", "node", F.col("__up").alias("up"), (F.col("score") + F.col("__score")).alias("score"),
                        (F.col("depth") + F.col("__depth")).alias("depth"), F.least("low", "__low").alias("low"))
                .unionByName(last.filter("up is null")))
        tables.append(materialise(step, "llm-chat-jump"))
    return tables


def reply_paths(nodes: DataFrame, paths_per_tree: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, path_score, node, place): the messages of each chosen path, places from 1.

    ``nodes`` has tree, node, parent and score; ``None`` keeps every branch.
    """
    tables = _jump_tables(nodes)
    whole = tables[-1]
    parents = tables[0].filter("up is not null").select(F.col("tree").alias("__t"), F.col("up").alias("__n")).distinct()
    leaves = whole.join(parents, F.col("tree").eqNullSafe(F.col("__t")) & F.col("node").eqNullSafe(F.col("__n")),
                        "left_anti")
    best = Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("node").asc_nulls_last())
    leaves = leaves.withColumn("rank", F.row_number().over(best))
    if paths_per_tree is not None:
        leaves = leaves.filter(F.col("rank") <= paths_per_tree)
    paths = materialise(leaves.select("tree", F.col("node").alias("leaf"), "rank", F.col("score").alias("path_score"),
                                      "node", F.col("depth").alias("place")), "llm-chat-path")
    for k, table in enumerate(tables[:-1]):
        jump = table.filter("up is not null").select(F.col("tree").alias("__t"), F.col("node").alias("__n"), "up")
        above = (paths.join(jump, F.col("tree").eqNullSafe(F.col("__t")) & (F.col("node") == F.col("__n")))
                 .select("tree", "leaf", "rank", "path_score", F.col("up").alias("node"),
                         (F.col("place") - F.lit(1 << k)).alias("place")))
        paths = materialise(paths.unionByName(above), "llm-chat-path")
    return paths


def format_paths(nodes: DataFrame, paths_per_tree: int | None = 1) -> DataFrame:
    """One row per chosen path: tree, leaf, rank, path_score, formatted, spans.

    ``nodes`` has tree, node, parent, score, role and text; ``spans`` holds
    (turn_start, loss_start, loss_len) per turn, in code points of ``formatted``.
    """
    paths = reply_paths(nodes, paths_per_tree)
    role, text = F.coalesce(nodes["role"], F.lit("")), F.coalesce(nodes["text"], F.lit(""))
    said = nodes.select(nodes["tree"].alias("__t"), nodes["node"].alias("__n"), role.alias("role"), text.alias("text"))
    turns = (paths.join(said, F.col("tree").eqNullSafe(F.col("__t")) & F.col("node").eqNullSafe(F.col("__n")))
             .withColumn("head", F.concat(F.lit(_OPEN), escape(F.col("role")), F.lit(_HEAD_END)))
             .withColumn("body", escape(F.col("text")))
             .withColumn("piece", F.concat("head", "body", F.lit(_END))))
    key = ("tree", "leaf", "rank", "path_score")
    run = Window.partitionBy(*key).orderBy("place", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("turn_start", F.coalesce(F.sum(F.length("piece")).over(run), F.lit(0)))
    span = F.struct("turn_start", (F.col("turn_start") + F.length("head")).alias("loss_start"),
                    F.when(F.col("role") == LEARNED_ROLE, F.length("body")).otherwise(F.lit(0)).alias("loss_len"), "piece")
    grouped = turns.groupBy(*key).agg(F.array_sort(F.collect_list(span)).alias("__turns"))
    return grouped.select(
        *key, F.array_join(F.transform("__turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("__turns", lambda t: F.struct(t["turn_start"].alias("turn_start"), t["loss_start"].alias("loss_start"),
                                                  t["loss_len"].alias("loss_len"))).alias("spans"))


def read_back(formatted: Column, spans: Column) -> tuple[Column, Column]:
    """(turns as array of (role, text), text under the loss mask), from the formatted text alone."""
    pieces = F.filter(F.split(formatted, _END, -1), lambda p: p != "")
    head = len(_OPEN)

    def turn(p: Column) -> Column:
        role = F.substring_index(F.substring(p, head + 1, 1 << 30), _HEAD_END, 1)
        text = p.substr(F.instr(p, _HEAD_END) + len(_HEAD_END), F.length(p))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    turns = F.transform(pieces, turn)
    loss = F.zip_with(pieces, spans, lambda p, s: unescape(
        p.substr((s["loss_start"] - s["turn_start"] + 1).cast("int"), s["loss_len"].cast("int"))))
    return turns, F.array_join(loss, "")


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Digests read back from ``format_paths``' output, one row per path."""
    turns, loss = read_back(F.col("formatted"), F.col("spans"))
    out = formatted.select("tree", "leaf", "path_score", "formatted", turns.alias("__turns"), loss.alias("__loss"))
    said = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "tree", "leaf", "path_score", F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"), F.sha2(F.col("__loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def conversation_nodes(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                       text: str = "text") -> DataFrame:
    """Plain conversations as reply trees: each row answers the one before it (by turn, role, text; null turns last)."""
    order = Window.partitionBy("tree").orderBy(F.col("__turn").asc_nulls_last(), "role", "text")
    return (rows.select(rows[conv_id].alias("tree"), rows[turn].alias("__turn"), rows[role].alias("role"),
                        rows[text].alias("text"))
            .withColumn("node", F.row_number().over(order).cast("long"))
            .select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
                    F.lit(0.0).alias("score"), "role", "text"))
