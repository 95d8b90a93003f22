"""Chat formatting of reply trees, in DataFrame operations only.

Messages point to the message they answer.  Root-to-leaf paths are enumerated by self-joins that
double the distance they bridge: after k joins every message knows its ancestor 2^k above, so a tree
of depth d takes log2(d) joins of narrow rows and no row holds a growing path.  Paths are ranked in
their tree by the mean score of their messages; each chosen path becomes one conversation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabledoc.session import materialise


@dataclass(frozen=True)
class Template:
    """Marks of a turn, and the strings that may not stand in a text.

    A text is escaped with ``~``: ``~`` becomes ``~0`` and the i-th control string ``~i``.  No control
    string has a ``~``, so undoing the replacements in reverse order gives the text back exactly.
    """

    turn: str = "<|turn|>"
    end: str = "<|end|>\n"
    control: tuple[str, ...] = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def escape(self, text: Column) -> Column:
        text = F.replace(text, F.lit("~"), F.lit("~0"))
        for i, mark in enumerate(self.control, 1):
            text = F.replace(text, F.lit(mark), F.lit(f"~{i}"))
        return text

    def unescape(self, text: Column) -> Column:
        for i, mark in reversed(list(enumerate(self.control, 1))):
            text = F.replace(text, F.lit(f"~{i}"), F.lit(mark))
        return F.replace(text, F.lit("~0"), F.lit("~"))

    def escape_role(self, role: Column) -> Column:
        return F.replace(self.escape(role), F.lit("\n"), F.lit("~n"))

    def unescape_role(self, role: Column) -> Column:
        return self.unescape(F.replace(role, F.lit("~n"), F.lit("\n")))


def chain(messages: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """Messages in order as a tree without branches: adds ``node`` (from 1) and ``parent``.

    Ties in the order are broken by role and text, nulls first.  Equal rows are turns of their own.
    """
    at = F.row_number().over(Window.partitionBy(tree).orderBy(order, "role", "text"))
    kept = [c for c in messages.columns if c not in ("node", "parent")]
    numbered = messages.select(*kept, at.cast("long").alias("node"))
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def _tree_key(tree: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("null"))


def paths(nodes: DataFrame, tree: str = "conv_id", score: str | None = None, branches: int = 1) -> DataFrame:
    """The best root-to-leaf paths of every tree: ``_t, leaf, node, above, path_score``.

    ``above`` is the number of messages between the node and the leaf.  A missing parent makes its
    message a root.  ``branches`` paths with the highest mean score are taken per tree, ties to the
    smaller leaf.  ``node`` must be unique in its tree; messages that answer each other in a circle
    raise an error, as they have no root.
    """
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    base = nodes.select(_tree_key(tree).alias("_t"), "node", "parent", value.alias("total"))
    known = base.select("_t", F.col("node").alias("parent"), F.lit(True).alias("known"))
    links = materialise(
        base.join(known, ["_t", "parent"], "left").select(
            "_t", "node", F.when(F.col("known"), F.col("parent")).alias("up"), "total", F.lit(1).cast("long").alias("size")
        ),
        "links",
    )
    most = links.count()
    # a level's active messages know their ancestor 2^k above; the others have reached their root
    active, rooted, jumps = links.where("up is not null"), [links.where("up is null")], []
    while active.limit(1).count():
        if 2 ** len(jumps) > most:
            raise ValueError("messages answer each other in a circle")
        jumps.append(active)
        every = active
        for part in rooted:
            every = every.unionByName(part)
        above = every.select("_t", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("more"), F.col("size").alias("longer"))
        bridged = materialise(
            active.join(above, ["_t", "up"]).select(
                "_t", "node", F.col("up2").alias("up"), (F.col("total") + F.col("more")).alias("total"),
                (F.col("size") + F.col("longer")).alias("size"),
            ),
            "links",
        )
        active = bridged.where("up is not null")
        rooted.append(bridged.where("up is null"))
    whole = rooted[0]
    for part in rooted[1:]:
        whole = whole.unionByName(part)
    answered = links.where("up is not null").select("_t", F.col("up").alias("node")).distinct()
    leaves = whole.join(answered, ["_t", "node"], "left_anti").withColumn("path_score", F.col("total") / F.col("size"))
    rank = F.row_number().over(Window.partitionBy("_t").orderBy(F.desc("path_score"), "node"))
    found = leaves.withColumn("_rank", rank).where(F.col("_rank") <= branches).select(
        "_t", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"), "path_score"
    )
    found = materialise(found, "paths")
    for k, jump in enumerate(jumps):
        hop = jump.select("_t", "node", "up")
        higher = found.join(hop, ["_t", "node"]).select("_t", "leaf", F.col("up").alias("node"), (F.col("above") + 2**k).alias("above"), "path_score")
        found = found.unionByName(materialise(higher, "paths"))
    return found


def format_trees(
    nodes: DataFrame, tree: str = "conv_id", score: str | None = None, branches: int = 1,
    template: Template = Template(), trained: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per chosen path: the tree, ``leaf, path_score, n_turns, formatted, loss_spans``.

    ``nodes`` has ``node, parent, role, text``.  ``loss_spans`` are (start, length) in code points of the
    text of each turn whose role is in ``trained``, in order, so a mask covers what the model should
    learn and none of the marks.  Null roles and texts count as empty, messages with a null tree id are
    one tree, no messages give no rows; other columns are ignored.
    """
    chosen = paths(nodes, tree, score, branches)
    texts = nodes.select(
        _tree_key(tree).alias("_t"), "node", F.col(tree).alias("_tree"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = chosen.join(texts, ["_t", "node"]).select(
        "_t", "_tree", "leaf", "path_score", "above", "role",
        F.concat(F.lit(template.turn), template.escape_role(F.col("role")), F.lit("\n")).alias("head"),
        template.escape(F.col("text")).alias("body"),
    )
    turns = turns.withColumn("turn_text", F.concat("head", "body", F.lit(template.end)))
    so_far = Window.partitionBy("_t", "leaf").orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("turn_text").cast("long")).over(so_far), F.lit(0)))
    span = F.when(
        F.col("role").isin(*trained),
        F.struct((F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")),
    )
    row = F.struct(F.col("at"), F.col("turn_text"), span.alias("span"))
    # a path's turns are one cell of the result, so they meet in one task
    got = turns.groupBy("_t", "leaf").agg(
        F.first("_tree").alias(tree), F.first("path_score").alias("path_score"), F.array_sort(F.collect_list(row)).alias("turns")
    )
    return got.select(
        tree, "leaf", "path_score", F.size("turns").cast("long").alias("n_turns"),
        F.concat_ws("", F.transform("turns", lambda x: x["turn_text"])).alias("formatted"),
        F.array_compact(F.transform("turns", lambda x: x["span"])).alias("loss_spans"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """Turns (role, text) read back from a formatted conversation."""
    split = F.split(formatted, r"\Q" + template.turn + r"\E", -1)
    pieces = F.slice(split, F.lit(2), F.size(split))
    size = len(template.end)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - size)
        return F.struct(template.unescape_role(role).alias("role"), template.unescape(body).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    part = lambda s: template.unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.concat_ws("", F.transform(spans, part))
