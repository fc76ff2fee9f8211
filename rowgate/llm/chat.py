"""Reply trees to chat text: paths by iterated self-joins, ranked branches, a reversible template.

Branches are ranked by scores that the self-joins add up; only the chosen ones are listed message by message.
DataFrame functions only. Messages are (tree, node, parent, role, text); the root has no parent.
The joins carry ids and scores; texts join once, for the chosen paths alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowgate.llm.common import stored

START, MIDDLE, END = "<|turn|>", "<|says|>", "<|end|>"
#: Every control string starts with "<" or "[", so these never occur inside an escaped text.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))


def escape(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    """The inverse of ``escape``: every backslash of an escaped text starts one of its codes."""
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


class Forest:
    """Reply trees: ``tree``, ``node``, ``parent``, ``score`` of ``messages``; a node id is unique in its tree.

    Round k of self-joins turns each node's ancestor 2^k steps up into the one twice as far, with the sum of the scores
    on the way: depth d takes log2(d) rounds. A parent that isn't there makes its child a root. What hangs on a cycle
    reaches no root and has no leaves. A null score counts 0.
    """

    def __init__(self, messages: DataFrame) -> None:
        nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0)).cast("double").alias("score"))
        known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
        first = nodes.join(known, ["tree", "parent"], "left").select(
            "tree", "node", F.when(F.col("known"), F.col("parent")).alias("above"), "score"
        )
        self.first = stored(first)
        most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
        # a step holds the nodes that have an ancestor so far up, and no others
        self.steps = [stored(self.first.filter("above is not null").withColumnRenamed("score", "gain"))]
        while 1 << (len(self.steps) - 1) < most:
            near = self.steps[-1]
            far = near.select("tree", F.col("node").alias("above"), F.col("above").alias("next"), F.col("gain").alias("more"))
            step = near.join(far, ["tree", "above"]).select("tree", "node", F.col("next").alias("above"), (F.col("gain") + F.col("more")).alias("gain"))
            step = stored(step)
            if not step.take(1):
                break
            self.steps.append(step)
        parents = self.steps[0].select("tree", F.col("above").alias("node")).distinct()
        leaves = self.first.select("tree", "node").join(parents, ["tree", "node"], "left_anti")
        if 1 << (len(self.steps) - 1) >= most:  # further up than any tree is large: these turn in a cycle
            leaves = leaves.join(self.steps[-1].select("tree", "node"), ["tree", "node"], "left_anti")
        self.leaves = stored(leaves.withColumnRenamed("node", "leaf"))

    def scores(self) -> DataFrame:
        """``tree``, ``leaf``, ``path_score``, ``length`` of each leaf's path, without listing it: the largest step first."""
        at = self.leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0.0).alias("path_score"), F.lit(1).cast("long").alias("length"))
        for k, step in reversed(list(enumerate(self.steps))):
            at = at.join(step, ["tree", "node"], "left").select(
                "tree",
                "leaf",
                F.coalesce("above", "node").alias("node"),
                (F.col("path_score") + F.coalesce("gain", F.lit(0.0))).alias("path_score"),
                (F.col("length") + F.when(F.col("above").isNotNull(), 1 << k).otherwise(0)).alias("length"),
            )
            at = stored(at) if k % 4 == 0 else at
        root = at.join(self.first.select("tree", "node", "score"), ["tree", "node"])
        return root.select("tree", "leaf", (F.col("path_score") + F.col("score")).alias("path_score"), "length")

    def paths(self, leaves: DataFrame) -> DataFrame:
        """``tree``, ``leaf``, ``node``, ``up`` (steps above the leaf), ``score``: a row for each message above and at ``leaves``.

        Each round adds to a leaf's ancestors those twice as far up, so the rows made are those returned.
        """
        found = stored(leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up")))
        for k, step in enumerate(self.steps):
            higher = found.join(step, ["tree", "node"])
            higher = higher.select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
            found = found.unionByName(stored(higher))
        return found.join(self.first.select("tree", "node", "score"), ["tree", "node"]).select("tree", "leaf", "node", "up", "score")


def branches(messages: DataFrame) -> DataFrame:
    """All root-to-leaf paths of a ``Forest``: ``tree``, ``leaf``, ``node``, ``up``, ``score``."""
    forest = Forest(messages)
    return forest.paths(forest.leaves)


def rank(paths: DataFrame) -> DataFrame:
    """``tree``, ``leaf``, ``path_score``, ``length``, ``branch_rank``: best sum of scores, then longest, then smallest leaf first."""
    leaves = paths.groupBy("tree", "leaf").agg(F.sum("score").alias("path_score"), F.count("*").alias("length"))
    by = Window.partitionBy("tree").orderBy(F.desc("path_score"), F.desc("length"), "leaf")
    return leaves.withColumn("branch_rank", F.row_number().over(by))


def best(scores: DataFrame) -> DataFrame:
    """``tree``, ``leaf`` of the branch that ``rank`` puts first, by an aggregate: no task holds all leaves of a tree."""
    first = F.min(F.struct((-F.col("path_score")).alias("s"), (-F.col("length")).alias("n"), "leaf"))
    return scores.groupBy("tree").agg(first.alias("first")).select("tree", "first.leaf")


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """One conversation for each leaf of ``paths``: ``tree``, ``leaf``, ``formatted``, ``loss_mask``.

    ``formatted`` is the template's text; ``loss_mask`` lists (start, length) in code points of
    the assistant texts in it. Null roles and texts are empty.
    """
    texts = messages.select(
        "tree", "node", escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text")
    )
    frame = len(START) + len(MIDDLE)
    joined = paths.join(texts, ["tree", "node"]).withColumns({"r": F.length("role"), "l": F.length("text")})
    # a turn's place is the length of what comes before it; this window and the lists need one and the same deal
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("r") + F.col("l") + frame + len(END)).over(before), F.lit(0)) + F.col("r") + frame
    turn = F.struct((-F.col("up")).alias("at"), "role", "text", start.cast("int").alias("start"), F.col("l").alias("length"))
    turns = joined.select("tree", "leaf", turn.alias("turn")).groupBy("tree", "leaf").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    rendered = F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit(MIDDLE), t["text"], F.lit(END)))
    own = F.filter("turns", lambda t: t["role"] == "assistant")
    spans = F.transform(own, lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return turns.select("tree", "leaf", F.array_join(rendered, "").alias("formatted"), spans.alias("loss_mask"))


def read_back(formatted: str = "formatted") -> Column:
    """The turns of a formatted conversation: an array of (role, text), unescaped."""
    parts = F.split(F.col(formatted), r"<\|end\|>")
    turns = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring_index(F.substr(t, F.lit(len(START) + 1)), MIDDLE, 1)).alias("role"),
            unescape(F.substring_index(t, MIDDLE, -1)).alias("text"),
        ),
    )


def masked(formatted: str = "formatted", mask: str = "loss_mask") -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(
        F.col(mask), lambda m: unescape(F.substr(F.col(formatted), m["start"] + F.lit(1), m["length"]))
    )


def threads(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations (conv_id, turn, role, text): each turn answers the one before it.

    Ties of a turn go by role, then text; null turns come last. Rows with a null conv_id form one
    conversation of their own.
    """
    by = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", "role", "text")
    missing = F.lit(-(2**63)).cast("long")
    rows = rows.withColumn("tree", F.coalesce(F.col("tree").cast("long"), missing))
    rows = rows.withColumn("node", F.row_number().over(by).cast("long"))
    return rows.select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score")
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Each conversation's best branch in the template, one row a conversation. No rows give no rows."""
    messages = stored(threads(conversations))
    forest = Forest(messages)
    out = format_paths(forest.paths(best(forest.scores())), messages)
    return out.withColumn("tree", F.when(F.col("tree") != -(2**63), F.col("tree")))
