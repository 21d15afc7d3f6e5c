"""Prefix trie of conversations by burst tries.

Every conversation is a sequence of turn ids (two 64-bit hashes of role and text). A container
holds the conversations under one trie head. A container with more than ``max_convs``
conversations or ``max_turns`` remaining turns is burst: its head becomes a node, the
conversations that end there are its ends, the others move into child containers keyed by their
next turn id, and this repeats on the children. Bursting is a grouped count per round, so a
hot head (one repeated conversation, a very common first turn) is spread over all tasks.
Containers that are small enough are sorted and swept into nodes inside one task each; the
sweep gives every node its members, children, leaves and saved words. Totals of burst heads
are the sums of what lies below them, summed along the list of burst heads each row carries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loanloom.llm.common import WORD, written

#: A container above either bound is burst by the next turn id.
MAX_CONVS, MAX_TURNS = 2048, 65536

NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, head boolean, k1 long, k2 long, anc array<struct<k1:long,k2:long>>")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """One row per conv_id ``c``: ``conv_id, seq`` (structs ``hi, lo, nw`` in order), rebuilt by the contract.

    Turns are ordered by turn (null first), then role and text; a null role or text is empty.
    The first ``h = crc32(decimal c) % 4`` turns come from conversation ``c - c % 20`` (as many as
    it has; none if it is absent), then come ``c``'s own turns after its first ``h``. Rows with a
    null conv_id belong to no conversation and are left out.
    """
    turns = (conversations.where(F.col("conv_id").isNotNull())
             .select(F.col("conv_id").cast("long").alias("conv_id"), "turn",
                     F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.select("conv_id", F.row_number().over(order).alias("pos"),
                         F.xxhash64("role", "text").alias("hi"), F.xxhash64(F.lit("turn"), "text", "role").alias("lo"),
                         F.regexp_count("text", F.lit(WORD)).cast("long").alias("nw"))
    turns = written(turns, "trie-turns")
    convs = turns.select("conv_id").distinct().select(
        "conv_id", (F.crc32(F.col("conv_id").cast("string")) % 4).alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("b"))
    item = F.struct("pos", "hi", "lo", "nw")
    lead = (turns.where("pos <= 3").join(convs.select(F.col("conv_id").alias("c"), "h", F.col("b").alias("conv_id")), "conv_id")
            .where("pos <= h").groupBy(F.col("c").alias("conv_id")).agg(F.array_sort(F.collect_list(item)).alias("lead")))
    own = (turns.join(convs.select("conv_id", "h"), "conv_id").where("pos > h")
           .groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("own")))
    empty = F.array().cast("array<struct<pos:int,hi:long,lo:long,nw:long>>")
    seq = F.concat(F.coalesce("lead", empty), F.coalesce("own", empty))
    return (convs.select("conv_id").join(lead, "conv_id", "left").join(own, "conv_id", "left")
            .select("conv_id", F.transform(seq, lambda t: F.struct(t["hi"].alias("hi"), t["lo"].alias("lo"), t["nw"].alias("nw"))).alias("seq")))


def prefix_trie(convs: DataFrame, max_convs: int = MAX_CONVS, max_turns: int = MAX_TURNS) -> DataFrame:
    """Nodes of the trie of ``conv_id, seq``: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    The root (depth 0) holds every conversation, turnless ones too; a node's conv_id is its
    smallest member, ``saved_tokens`` sums over its subtree each node's ``(n_convs - 1)`` times
    the words of its last turn, ``ends_sha256`` hashes the comma-joined ascending ids of the
    members that end at it (none: the hash of the empty string). Repeated conversations are
    members each time. No conversations: no rows, not even a root.
    """
    anc_type = "array<struct<k1:long,k2:long>>"
    live = convs.select("conv_id", "seq", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("k1"),
                        F.lit(0).cast("long").alias("k2"), F.array().cast(anc_type).alias("anc"))
    swept, heads, ends = [], [], []
    while True:
        live = written(live, "trie-live")
        sizes = live.groupBy("d", "k1", "k2").agg(
            F.count("*").alias("n"), F.sum(F.size("seq") - F.col("d")).alias("rest"))
        burst = sizes.where((F.col("n") > max_convs) | (F.col("rest") > max_turns)).select("d", "k1", "k2", F.lit(True).alias("burst"))
        tagged = live.join(burst, ["d", "k1", "k2"], "left")
        small = tagged.where(F.col("burst").isNull()).drop("burst")
        swept.append(small.groupBy("d", "k1", "k2").applyInPandas(_sweep, NODES))
        big = tagged.where(F.col("burst")).drop("burst")
        if big.isEmpty():
            break
        big = written(big, "trie-burst")
        at = F.element_at("seq", F.col("d").cast("int") + 1)
        last = F.when(F.col("d") > 0, F.element_at("seq", F.col("d").cast("int"))["nw"]).otherwise(F.lit(0))
        heads.append(big.groupBy("d", "k1", "k2", "anc").agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
            F.count_distinct(F.when(F.size("seq") > F.col("d"), F.struct(at["hi"], at["lo"]))).alias("n_children"),
            F.max(last).alias("nw")))
        ends.append(big.where(F.size("seq") == F.col("d")).select("d", "k1", "k2", "conv_id"))
        moving = big.where(F.size("seq") > F.col("d"))
        live = moving.select(
            "conv_id", "seq", (F.col("d") + 1).alias("d"),
            F.xxhash64("k1", at["hi"], at["lo"]).alias("k1"), F.xxhash64("k2", at["lo"], at["hi"], F.lit(1)).alias("k2"),
            F.concat("anc", F.array(F.struct("k1", "k2"))).alias("anc"))
    return _assembled(convs.sparkSession, swept, heads, ends)


def _assembled(spark, swept: list[DataFrame], heads: list[DataFrame], ends: list[DataFrame]) -> DataFrame:
    nodes = _union(swept)
    if not heads:
        return nodes.select(*_OUT)
    head = _union(heads)
    own_leaf = (F.col("n_children") == 0).cast("long")
    own_saved = (F.col("n_convs") - 1) * F.col("nw")
    # what lies below each burst head: swept container heads carry their whole subtree, burst heads their own part
    below = (nodes.where("head").select(F.explode("anc").alias("a"), "n_leaves", "saved_tokens")
             .unionByName(head.select(F.explode("anc").alias("a"), own_leaf.alias("n_leaves"), own_saved.alias("saved_tokens")))
             .groupBy(F.col("a.k1").alias("k1"), F.col("a.k2").alias("k2"))
             .agg(F.sum("n_leaves").alias("leaves_below"), F.sum("saved_tokens").alias("saved_below")))
    hashed = _hashed(_union(ends))
    empty = hashlib.sha256(b"").hexdigest()
    parents = head.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    heads_out = (head.withColumn("p", F.when(F.size("anc") > 0, F.element_at("anc", -1)))
                 .join(below, ["k1", "k2"], "left").join(hashed, ["k1", "k2"], "left")
                 .join(parents, (F.col("p.k1") == F.col("p1")) & (F.col("p.k2") == F.col("p2")), "left")
                 .select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children",
                         (own_leaf + F.coalesce("leaves_below", F.lit(0))).alias("n_leaves"),
                         (own_saved + F.coalesce("saved_below", F.lit(0))).alias("saved_tokens"),
                         F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")))
    linked = (nodes.withColumn("p", F.when(F.col("head") & (F.size("anc") > 0), F.element_at("anc", -1)))
              .join(parents.withColumnRenamed("parent_conv_id", "up"), (F.col("p.k1") == F.col("p1")) & (F.col("p.k2") == F.col("p2")), "left")
              .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up")))
    return linked.select(*_OUT).unionByName(heads_out.select(*_OUT))


_OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _hashed(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids ending at each burst head, streamed over sorted rows: no group is held whole."""
    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest, sep, out = None, None, b"", []
        for b in batches:
            for k1, k2, c in zip(b["k1"], b["k2"], b["conv_id"]):
                if (k1, k2) != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest, sep = (k1, k2), hashlib.sha256(), b""
                digest.update(sep + str(int(c)).encode())
                sep = b","
            if len(out) > 4096:
                yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
                out = []
        if key is not None:
            out.append((*key, digest.hexdigest()))
        yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
    ordered = ends.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id")
    return ordered.mapInPandas(stream, "k1 long, k2 long, ends_sha256 string")


def _sweep(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one small container: its members sorted by the rest of their turns, then swept."""
    d = int(rows["d"].iloc[0])
    anc = rows["anc"].iloc[0]
    anc = [] if anc is None else [dict(a) for a in anc]
    items = []
    for c, seq in zip(rows["conv_id"], rows["seq"]):
        seq = [] if seq is None else list(seq)
        items.append((tuple((int(t["hi"]), int(t["lo"])) for t in seq[d:]), int(c), [int(t["nw"]) for t in seq]))
    items.sort(key=lambda x: (x[0], x[1]))
    out = []
    # stack entries: depth, first member index, children, leaves below, saved below, words of the last turn
    stack: list[list] = []

    def close(upto: int) -> None:
        depth, start, children, leaves, saved, nw = stack.pop()
        members = items[start:upto]
        ids = [m[1] for m in members]
        ending = sorted(m[1] for m in members if len(m[0]) + d == depth)
        n = len(members)
        own_saved = (n - 1) * nw
        total_leaves = leaves + (1 if children == 0 else 0)
        total_saved = saved + own_saved
        out.append([min(ids), depth, None, n, children, total_leaves, total_saved,
                    hashlib.sha256(",".join(map(str, ending)).encode()).hexdigest(), depth == d, start])
        if stack:
            stack[-1][2] += 1
            stack[-1][3] += total_leaves
            stack[-1][4] += total_saved

    previous: tuple = ()
    for i, (rest, c, words) in enumerate(items):
        if i == 0:
            stack.append([d, 0, 0, 0, 0, words[d - 1] if d > 0 else 0])
            common = 0
        else:
            common = 0
            while common < min(len(rest), len(previous)) and rest[common] == previous[common]:
                common += 1
            while len(stack) - 1 > common:
                close(i)
        for j in range(len(stack) - 1, len(rest)):
            stack.append([d + j + 1, i, 0, 0, 0, words[d + j]])
        previous = rest
    while stack:
        close(len(items))
    # parents inside the container: the nearest shallower node opened at or before a node's first member
    frame = pd.DataFrame(out, columns=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                       "saved_tokens", "ends_sha256", "head", "start"])
    frame = frame.sort_values(["start", "depth"]).reset_index(drop=True)
    path: dict[int, int] = {}
    parents = []
    for conv, depth in zip(frame["conv_id"], frame["depth"]):
        parents.append(path.get(depth - 1) if depth > d else None)
        path[depth] = conv
    frame["parent_conv_id"] = pd.array(parents, dtype="Int64")
    frame["k1"], frame["k2"] = int(rows["k1"].iloc[0]), int(rows["k2"].iloc[0])
    frame["anc"] = [anc] * len(frame)
    return frame.drop(columns="start")
