"""Chat formatting: reply trees are cut into root-to-leaf paths, the paths ranked, each chosen one formatted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkeda.llm.shared import keep

#: Template of a turn: OPEN role COLON text CLOSE. A text or role never holds "###" or "</turn>" once escaped.
OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
_NODE = ["tree", "node", "parent", "score", "role", "text"]


def escape(text: Column) -> Column:
    r"""A backslash before every backslash, before ``/`` in ``</turn>`` and before each ``#`` that follows two."""
    return F.regexp_replace(text, r"(\\|(?<=##)#|(?<=<)/(?=turn>))", r"\\$1")


def escape_role(role: Column) -> Column:
    """As ``escape``, for every ``#``, ``/`` and ``:``, so that a role ends at the first bare colon."""
    return F.regexp_replace(role, r"([\\#/:])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def as_chain(turns: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of plain conversations: each turn replies to the one before it.

    Equal turn numbers and repeated rows stay, as turns of their own in the order of (turn, role, text). Null texts and
    roles are empty.
    """
    place = W.partitionBy("tree").orderBy("order", "role", F.xxhash64("text"))
    return turns.select(
        F.col(tree).alias("tree"), F.col(order).alias("order"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("node", F.row_number().over(place).cast("bigint")).select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def _named(nodes: DataFrame) -> DataFrame:
    """``nodes`` with a tree's id in a struct, so that a null id is a tree like any other in the joins."""
    return nodes.withColumn("tree", F.struct(F.col("tree").alias("id")))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every leaf with each node on its way to the root; ``up`` counts steps from the leaf.

    ``nodes`` needs tree, node and parent. A parent that is null, missing or not smaller than the node makes it a root, so
    no cycle can arise. Each round of self-joins doubles the steps known, so a chain of n turns takes log2(n) rounds; the
    rounds move keys only and are cut by checkpoints.
    """
    return _paths(_named(nodes)).withColumn("tree", F.col("tree.id"))


def _paths(nodes: DataFrame) -> DataFrame:
    known = nodes.select("tree", "node", F.when(F.col("parent") < F.col("node"), F.col("parent")).alias("parent"))
    present = known.select("tree", F.col("node").alias("parent")).distinct()
    edges = keep(known.join(present, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("above")))
    inner = edges.select("tree", F.col("above").alias("node")).distinct()
    leaves = known.select("tree", "node").distinct().join(inner, ["tree", "node"], "left_anti")
    reach = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up"))
    jump, steps = edges, 1
    while not jump.isEmpty():
        further = reach.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + steps).alias("up"))
        reach = keep(reach.unionByName(further))
        over = jump.select("tree", F.col("node").alias("above"), F.col("above").alias("top"))
        jump = keep(jump.join(over, ["tree", "above"]).select("tree", "node", F.col("top").alias("above")))
        steps *= 2
    return reach


def ranked_paths(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, node, up, rank): paths with their rank in the tree by mean score (null: 0), ties to the smaller leaf.

    ``branches`` keeps that many paths a tree; None keeps all. Ranks come from one row per path.
    """
    return _ranked(_named(nodes), branches).withColumn("tree", F.col("tree.id"))


def _ranked(nodes: DataFrame, branches: int | None) -> DataFrame:
    way = _paths(nodes)
    scored = way.join(nodes.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("score")), ["tree", "node"])
    leaf = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    rank = leaf.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf"))).drop("score")
    if branches is not None:
        rank = rank.filter(F.col("rank") <= branches)
    return way.join(rank, ["tree", "leaf"])


def format_paths(nodes: DataFrame, branches: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, n_turns, formatted, loss_spans): one conversation per chosen path.

    ``nodes`` has tree, node (unique in its tree), parent, score, role and text; other columns are not read and an empty table
    gives an empty table. ``loss_spans`` lists (start, length), in code points of ``formatted``, of the texts spoken by
    ``loss_role``. A conversation is one row of output and is put together in one task; nothing larger is.
    """
    nodes = _named(nodes.select(*_NODE))
    turns = _ranked(nodes, branches).join(nodes.select(
        "tree", "node", (F.coalesce("role", F.lit("")) == loss_role).alias("loss"),
        F.concat(F.lit(OPEN), escape_role(F.coalesce("role", F.lit(""))), F.lit(COLON)).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body")), ["tree", "node"])
    size = F.length("head") + F.length("body") + len(CLOSE)
    before = F.coalesce(F.sum(size.cast("bigint")).over(
        W.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = turns.select(
        "tree", "leaf", "rank", F.struct(
            (-F.col("up")).alias("at"), F.concat("head", "body", F.lit(CLOSE)).alias("shown"), "loss",
            (before + F.length("head")).alias("start"), F.length("body").cast("bigint").alias("length")).alias("turn"))
    whole = placed.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return whole.select(
        F.col("tree.id").alias("tree"), "leaf", "rank", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"], t["length"])).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as array of (role, text), undoing the template and the escapes."""
    role = r"(?s)^((?:[^\\:]++|\\.)*+): "
    parts = F.filter(F.split(formatted, OPEN, -1), lambda p, i: i > 0)
    return F.transform(parts, lambda p: F.struct(
        unescape(F.regexp_extract(p, role, 1)).alias("role"),
        unescape(F.regexp_replace(F.regexp_replace(p, role, ""), r" </turn>\n$", "")).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, spans in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def digests(conversations: DataFrame) -> DataFrame:
    """Per formatted conversation what its output reads back as: turns, text under the loss mask, length."""
    turns, loss = read_turns(F.col("formatted")), read_loss(F.col("formatted"), F.col("loss_spans"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return conversations.withColumns({"turns": turns, "loss": loss}).select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))
