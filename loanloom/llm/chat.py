"""Conversations from reply trees, in a chat template that can be read back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loanloom.llm.common import fresh, small_batches
from loanloom.operators.lineage import cut_lineage

#: Fixed values of the template.
OPEN, CLOSE, TRAINED_ROLE = "<|im_start|>", "<|im_end|>\n", "assistant"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\+)\|")
_TURN = re.compile(re.escape(OPEN) + r"(.*?)\n(.*?)" + re.escape(CLOSE), re.S)


def escape(text: str) -> str:
    """``<|`` cannot occur in the result: a backslash goes in; one more where some are."""
    return _CONTROL.sub(lambda m: f"<{m[1]}\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1][1:]}|", text)


def _role_in(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_out(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[int]]:
    """The formatted conversation and its loss mask: starts and ends, alternating, of the assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{_role_in(role or '')}\n", escape(text or "")
        if (role or "") == TRAINED_ROLE:
            spans += [at + len(head), at + len(head) + len(body)]
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(_role_out(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def read_loss(formatted: str, spans: list[int]) -> str:
    """All text under the loss mask, unescaped."""
    return "".join(unescape(formatted[a:b]) for a, b in zip(spans[::2], spans[1::2], strict=True))


def chains(turns: DataFrame) -> DataFrame:
    """Conversations by turn as reply trees: ``tree_id, node_id, parent_id, role, text, score``.

    Every row replies to the one before it in the order of turn, role and text (nulls first), so
    repeated turns and rows follow each other. Turns without a conversation id form one
    conversation without id.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    numbered = turns.select(F.col("conv_id").alias("tree_id"), node.alias("node_id"), "role", "text")
    parent = F.when(F.col("node_id") > 1, F.col("node_id") - 1)
    return numbered.select("tree_id", "node_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def tree_paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """``tree_id, branch, leaf_id, path_score, depth, node_id`` of the nodes on the best root-to-leaf paths.

    ``nodes`` has ``tree_id, node_id, parent_id, score``. Self-joins of the table of jumps
    double the distance each round, so a tree of depth d takes about log2(d) rounds and each
    round joins the nodes that have not reached their root: first every node learns its depth and the score of its path,
    then the leaves are ranked within their tree (mean score of the path, then more turns,
    then smaller leaf id; a null score counts as zero), and the chosen leaves gather their
    ancestors over the same jumps. ``branches`` None keeps every leaf. A parent that is not
    in the tree makes its node a root. Node ids have to be unique in a tree; nodes on a cycle
    reach no root and are not part of any path. Null tree ids are one tree.
    """
    key = F.coalesce(F.to_json(F.struct("tree_id")), F.lit("")).alias("tree")
    base = cut_lineage(nodes.select(key, "tree_id", F.col("node_id").alias("node"), F.col("parent_id").alias("parent"),
                                    F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    known = base.select("tree", F.col("node").alias("parent"), F.lit(True).alias("here"))
    jumps = base.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("here"), F.col("parent")).alias("to"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total"))
    jumps = cut_lineage(jumps)
    done, active = jumps.where("to is null"), jumps.where("to is not null")
    tables, before = [active], None
    while (left := active.count()) and left != before:  # an equal number: only cycles are left
        before = left
        ahead = done.unionByName(active).select(
            "tree", F.col("node").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("total").alias("further"))
        doubled = cut_lineage(active.join(ahead, ["tree", "to"]).select(
            "tree", "node", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"),
            (F.col("total") + F.col("further")).alias("total")))
        done, active = done.unionByName(doubled.where("to is null")), doubled.where("to is not null")
        tables.append(active)
    rooted = done.select("tree", "node", F.col("steps").alias("depth"), "total")
    parents = base.select("tree", F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = rooted.join(parents, ["tree", "node"], "left_anti")
    rank = W.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node")
    leaves = leaves.withColumn("branch", F.row_number().over(rank))
    if branches is not None:
        leaves = leaves.where(F.col("branch") <= branches)
    chosen = cut_lineage(leaves.select("tree", "branch", F.col("node").alias("leaf_id"), (F.col("total") / F.col("depth")).alias("path_score"), "node"))
    for table in reversed(tables[:-1]):  # from the farthest jumps to the single steps
        found = chosen.join(table.select("tree", "node", "to"), ["tree", "node"]).select("tree", "branch", "leaf_id", "path_score", F.col("to").alias("node"))
        chosen = cut_lineage(chosen.unionByName(found).distinct())
    names = base.select("tree", "tree_id", "node")
    placed = chosen.join(rooted.select("tree", "node", "depth"), ["tree", "node"]).join(names, ["tree", "node"])
    return placed.select("tree_id", "branch", "leaf_id", "path_score", "depth", F.col("node").alias("node_id"))


def format_conversations(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """``tree_id, branch, leaf_id, path_score, formatted, loss_spans``: each chosen path as one conversation.

    ``nodes`` has ``tree_id, node_id, parent_id, role, text, score``; see ``tree_paths``. Null
    roles and texts are empty. ``loss_spans`` are code point offsets into ``formatted``:
    start and end, alternating, of each assistant text. A path is as long as its conversation,
    and is one row of the result.
    """
    small_batches(nodes.sparkSession, rows=256)
    nodes = cut_lineage(nodes.select("tree_id", "node_id", "parent_id", "role", "text", "score"))
    paths = tree_paths(nodes, branches)
    tree = fresh("tree", paths.columns)
    told = nodes.select(F.col("tree_id").alias(tree), "node_id", "role", "text")
    joined = paths.join(told, paths["tree_id"].eqNullSafe(told[tree]) & (paths["node_id"] == told["node_id"])).select(
        paths["tree_id"], "branch", "leaf_id", "path_score", "depth", "role", "text")
    grouped = joined.groupBy("tree_id", "branch", "leaf_id", "path_score").agg(
        F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    schema = T.StructType([*[grouped.schema[c] for c in ("tree_id", "branch", "leaf_id", "path_score")],
                           T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(T.LongType()))])
    return grouped.mapInArrow(_format, schema)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array([t for t, _ in out], pa.string()), pa.array([s for _, s in out], pa.list_(pa.int64()))],
            names=[*batch.schema.names[:4], "formatted", "loss_spans"])
