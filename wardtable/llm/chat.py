"""Conversations from reply trees, in DataFrame functions only.

A tree's rows name their parent. Iterative self-joins of each row with the row it points to double
the reach of the pointers, so depth and score of every path from the root are known after as many rounds as
the logarithm of the deepest path has. Leaves are then ranked within their tree by the mean score of their
path, and the rows of the chosen paths are found again by the same pointers, from the longest down.

Format: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In roles and texts a backslash is
doubled and ``<|`` becomes ``<\\|``, so that no text can hold a control string, and every text can be read
back; a line feed in a role becomes ``<|nl|>``. The loss mask has the places of assistant texts.

A parent that is missing from its tree makes a root. Rows whose parents go round in a circle are on
no path. A null text or role is empty, a null tree is a tree of its own. Equal scores: the longer path, then the smaller
leaf. Rows that repeat a node's number count once, the first by role and text. One conversation is one value of
the result, so the task that writes it holds that conversation; nothing else is gathered. Further columns are left out, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardtable.llm.common import col, saved

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


# --- paths ------------------------------------------------------------------


def _reach(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of (tree, node, up) for pointers 1, 2, 4, ... rows up; and depth and sum of scores of every node.

    Each round is written to the shared folder. The node a pointer leads to is unique, so only the side that
    points can hold a hot one. A path can't be longer than there are rows, which ends circles.
    """
    rows = nodes.count()
    state = saved(
        nodes.select(
            "_tree", "_node", F.col("_parent").alias("_up"), F.col("_parent").isNotNull().cast("bigint").alias("_depth"),
            F.col("_score").alias("_sum"),
        ),
        "paths",
    )
    open_, done = state.filter("_up is not null"), state.filter("_up is null")
    levels, reach = [], 1
    while reach <= max(rows, 1) and not open_.isEmpty():
        levels.append(open_.select("_tree", "_node", "_up"))
        other = open_.unionByName(done).select(
            F.col("_tree").alias("_t"), F.col("_node").alias("_n"), F.col("_up").alias("_up2"),
            F.col("_depth").alias("_depth2"), F.col("_sum").alias("_sum2"),
        )
        joined = open_.join(other, (F.col("_tree") == F.col("_t")) & (F.col("_up") == F.col("_n")), "left")
        state = saved(
            joined.select(
                "_tree", "_node", F.col("_up2").alias("_up"),
                (F.col("_depth") + F.coalesce("_depth2", F.lit(0))).alias("_depth"),
                (F.col("_sum") + F.coalesce("_sum2", F.lit(0.0))).alias("_sum"),
            ),
            "paths",
        )
        # Only rows that have not reached a root go on.
        open_, done = state.filter("_up is not null"), done.unionByName(state.filter("_up is null"))
        reach *= 2
    return levels, done.select("_tree", "_node", "_depth", "_sum")


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Rows of the ``branches`` best root-to-leaf paths of each tree: the columns of ``nodes``, ``_leaf``, ``_depth``.

    ``nodes`` has _tree, _node, _parent and _score, without nulls but for _parent of roots.
    """
    levels, known = _reach(nodes)
    parents = nodes.filter("_parent is not null").select("_tree", F.col("_parent").alias("_node")).distinct()
    leaves = known.join(parents, ["_tree", "_node"], "left_anti")
    mean = F.col("_sum") / (F.col("_depth") + 1)
    if branches == 1:
        best = F.min(F.struct((-mean).alias("_m"), (-F.col("_depth")).alias("_d"), "_node")).alias("_best")
        chosen = leaves.groupBy("_tree").agg(best).select("_tree", F.col("_best._node").alias("_leaf"))
    else:
        order = Window.partitionBy("_tree").orderBy(mean.desc(), F.col("_depth").desc(), "_node")
        chosen = leaves.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= branches)
        chosen = chosen.select("_tree", F.col("_node").alias("_leaf"))
    members = chosen.select("_tree", "_leaf", F.col("_leaf").alias("_node"))
    for level in reversed(levels):
        above = members.join(level, ["_tree", "_node"]).select("_tree", "_leaf", F.col("_up").alias("_node"))
        # Written in each round: the plan would double with every level otherwise.
        members = saved(members.unionByName(above), "members")
    return members.join(known.select("_tree", "_node", "_depth"), ["_tree", "_node"]).join(nodes, ["_tree", "_node"])


def prepare(
    df: DataFrame, tree: str, node: str, parent: str | None, role: str, text: str, score: str | None
) -> DataFrame:
    """Nodes for ``best_paths``. Without ``parent`` a tree's rows follow one another by ``node``, ties by role and text.

    Trees are known by a text made of their value, null included.
    """
    rows = df.select(
        F.to_json(F.struct(col(tree).alias("t")), {"ignoreNullFields": "false"}).alias("_tree"),
        col(tree).alias("_value"),
        col(node).alias("_order"),
        (F.lit(None) if parent is None else col(parent)).cast("bigint").alias("_named"),
        F.coalesce(col(role), F.lit("")).alias("_role"),
        F.coalesce(col(text), F.lit("")).alias("_text"),
        (F.lit(0.0) if score is None else F.coalesce(col(score), F.lit(0.0))).cast("double").alias("_score"),
    )
    if parent is None:
        place = F.row_number().over(Window.partitionBy("_tree").orderBy("_order", "_role", "_text")).cast("bigint")
        rows = rows.withColumn("_node", place)
        return rows.withColumn("_parent", F.when(F.col("_node") > 1, F.col("_node") - 1)).drop("_order", "_named")
    rows = rows.filter(F.col("_order").isNotNull()).withColumn("_node", F.col("_order").cast("bigint"))
    first = F.row_number().over(Window.partitionBy("_tree", "_node").orderBy("_role", "_text", "_named"))
    rows = rows.withColumn("_first", first).filter("_first = 1").drop("_first", "_order")
    there = rows.select("_tree", F.col("_node").alias("_named"), F.lit(True).alias("_there"))
    rows = rows.join(there, ["_tree", "_named"], "left")
    return rows.withColumn("_parent", F.when(F.col("_there"), F.col("_named"))).drop("_there", "_named")


# --- the template -----------------------------------------------------------


def format_paths(paths: DataFrame) -> DataFrame:
    """``_value``, ``_leaf``, ``formatted`` and ``loss_spans`` (start, end in code points), a row for each path."""
    shown = escape(F.col("_text"))
    pieces = paths.select(
        "_tree", "_leaf", "_value", "_depth",
        F.concat(F.lit(START), escape_role(F.col("_role")), F.lit("\n")).alias("_head"),
        shown.alias("_shown"),
        (F.col("_role") == "assistant").alias("_learned"),
    ).withColumn("_piece", F.concat("_head", "_shown", F.lit(END + "\n")))
    before = Window.partitionBy("_tree", "_leaf").orderBy("_depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("_piece")).over(before), F.lit(0)) + F.length("_head")
    placed = pieces.withColumn("_start", start.cast("bigint")).select(
        "_tree", "_leaf", "_value",
        F.struct("_depth", "_piece", "_learned", F.col("_start").alias("start"),
                 (F.col("_start") + F.length("_shown")).alias("end")).alias("_turn"),
    )
    whole = placed.groupBy("_tree", "_leaf").agg(
        F.first("_value").alias("_value"), F.sort_array(F.collect_list("_turn")).alias("_turns")
    )
    learned = F.filter("_turns", lambda t: t["_learned"])
    return whole.select(
        "_value", "_leaf",
        F.array_join(F.transform("_turns", lambda t: t["_piece"]), "").alias("formatted"),
        F.transform(learned, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss_spans"),
    )


def format_conversations(
    df: DataFrame,
    tree: str = "conv_id",
    node: str = "turn",
    parent: str | None = None,
    role: str = "role",
    text: str = "text",
    score: str | None = None,
    branches: int = 1,
) -> DataFrame:
    """``tree``, ``leaf``, ``formatted`` and ``loss_spans`` for the best paths of every tree."""
    nodes = saved(prepare(df, tree, node, parent, role, text, score), "nodes")
    done = format_paths(best_paths(nodes, branches))
    return done.select(F.col("_value").alias(tree), F.col("_leaf").alias("leaf"), "formatted", "loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    found = F.filter(F.split(formatted, "<\\|im_start\\|>", -1), lambda x: F.endswith(x, F.lit(END + "\n")))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(head) + 2, F.length(piece) - F.length(head) - 2 - len(END))
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    return F.transform(found, turn)


def read_learned(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
        ),
        "",
    )


def conversation_report(formatted: DataFrame, tree: str = "conv_id") -> DataFrame:
    """What can be read back from formatted conversations, as counts and digests."""
    turns = formatted.withColumn("_turns", read_turns(F.col("formatted"))).withColumn(
        "_learned", read_learned(F.col("formatted"), F.col("loss_spans"))
    )
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        tree,
        F.size("_turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_learned").cast("bigint").alias("loss_chars"),
        F.sha2("_learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
