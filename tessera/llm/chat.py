"""Chat formatting of reply trees.

Messages (tree, node, parent, score, role, text) form trees of replies.  Every path from a
root to a leaf is a possible conversation; the ``top_k`` best branches of each tree are
formatted, each as one conversation with a loss mask on the assistant's texts.

Paths come from iterative self-joins that double their reach: round k joins each node's
2**k-th ancestor with that ancestor's own, so a tree of depth d takes log2(d) rounds over
rows of ids and sums, and never a list of ancestors per node.  Branches are ranked by the
mean score of their messages.  Only the chosen paths are then unrolled, by halving their
segments through the same jump tables.  Text is read once, when the nodes are known.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  Inside roles and texts a
backslash is written ``\\b`` and ``<|`` is written ``<\\p`` (a line end in a role: ``\\n``), so no
control string can stand in them, and ``unescape`` gets the exact text back.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, doc_id_of, key_id, map_batches

START, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(s: str) -> str:
    return s.replace("\\p", "|").replace("\\n", "\n").replace("\\b", "\\")


# ---------------------------------------------------------------- paths

def _roots_resolved(nodes: DataFrame) -> DataFrame:
    """(tree, node, parent, score) with unique nodes; a parent that is not a node of the
    tree, or the node itself, makes a root."""
    one = nodes.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    have = one.select(F.col("tree").alias("t2"), F.col("node").alias("n2"))
    return (one.join(have, (F.col("tree") == F.col("t2")) & (F.col("parent") == F.col("n2")), "left")
            .select("tree", "node", F.when(F.col("n2") != F.col("node"), F.col("n2")).alias("parent"),
                    F.coalesce("score", F.lit(0.0)).cast("double").alias("score")))


def best_paths(nodes: DataFrame, top_k: int = 1) -> DataFrame:
    """(tree, branch, pos, node): the nodes of each tree's top_k branches, root first.

    Ties in the mean score go to the longer branch, then to the smaller leaf.  Nodes on a
    cycle of parents hang on no root and are on no path.
    """
    base = cut(_roots_resolved(nodes))
    n = base.count()
    state = base.select("tree", "node", F.col("parent").alias("anc"), F.col("score").alias("total"),
                        F.lit(1).cast("long").alias("len"))
    jumps, rounds = [], 0
    while True:
        state = cut(state)
        live = state.filter(F.col("anc").isNotNull())
        if (1 << rounds) > 2 * n or live.isEmpty():
            break
        jumps.append(live.select("tree", "node", "anc"))
        up = state.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("anc").alias("anc2"),
                          F.col("total").alias("total2"), F.col("len").alias("len2"))
        far = (live.join(up, (F.col("tree") == F.col("t2")) & (F.col("anc") == F.col("n2")))
               .select("tree", "node", F.col("anc2").alias("anc"), (F.col("total") + F.col("total2")).alias("total"),
                       (F.col("len") + F.col("len2")).alias("len")))
        state = state.filter("anc is null").unionByName(far)        # nodes that reached a root rest
        rounds += 1
    parents = base.filter("parent is not null").select(F.col("tree").alias("t2"), F.col("parent").alias("n2")).distinct()
    leaves = (state.filter("anc is null")
              .join(parents, (F.col("tree") == F.col("t2")) & (F.col("node") == F.col("n2")), "left_anti"))
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("len")), F.desc("len"), "node")
    part = (leaves.withColumn("branch", F.row_number().over(order)).filter(F.col("branch") <= top_k)
            .select("tree", "branch", "node", F.lit(0).cast("long").alias("lo"), F.col("len").alias("hi")))
    # [lo, hi): distances from the leaf that a segment starting at ``node`` covers
    for k in reversed(range(len(jumps))):
        part = cut(part)
        long = part.filter((F.col("hi") - F.col("lo")) > (1 << k))
        j = jumps[k].select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "anc")
        upper = (long.join(j, (F.col("tree") == F.col("t2")) & (F.col("node") == F.col("n2")))
                 .select("tree", "branch", F.col("anc").alias("node"), (F.col("lo") + (1 << k)).alias("lo"), "hi"))
        lower = part.withColumn("hi", F.least(F.col("hi"), F.col("lo") + (1 << k)))
        part = lower.unionByName(upper)
    return part.select("tree", "branch", (-F.col("lo")).alias("pos"), "node")


# ---------------------------------------------------------------- format

def format_turns(turns: DataFrame) -> DataFrame:
    """(tree, branch, pos, role, text) -> one row per (tree, branch): n_turns, formatted,
    loss (start and end of each assistant text, in code points of ``formatted``)."""
    head = F.concat(F.lit(START), escape(F.coalesce("role", F.lit("")), role=True), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    t = turns.select("tree", "branch", "pos", F.concat(head, body, F.lit(END + "\n")).alias("piece"),
                     F.length(head).alias("head"), F.length(body).alias("body"),
                     F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("learn"))
    before = (Window.partitionBy("tree", "branch").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.col("head"))
    span = F.when(F.col("learn"), F.struct(F.col("at").alias("start"), (F.col("at") + F.col("body")).alias("end")))
    return (t.groupBy("tree", "branch")
            .agg(F.count(F.lit(1)).alias("n_turns"),
                 F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("pieces"),
                 F.sort_array(F.collect_list(span)).alias("loss"))
            .select("tree", "branch", "n_turns", F.array_join(F.col("pieces.piece"), "").alias("formatted"), "loss"))


def read_back(formatted: str, spans) -> tuple[list[tuple[str, str]], str]:
    """The (role, text) turns of a formatted conversation and the text under its mask."""
    turns = []
    for piece in formatted.split(START)[1:]:
        role, _, rest = piece.partition("\n")
        turns.append((unescape(role), unescape(rest[:-len(END) - 1])))
    return turns, "".join(unescape(formatted[a:b]) for a, b in spans)


def digests(conversations: DataFrame) -> DataFrame:
    """What ``format_turns`` wrote, read back from it."""
    def run(c):
        out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for text, spans in zip(c["formatted"].to_pylist(), c["loss"].to_pylist()):
            turns, learnt = read_back(text, [(s["start"], s["end"]) for s in spans])
            h = hashlib.sha256()
            for role, said in turns:
                h.update(f"{role}\n{said}\n".encode())
            out["n_turns"].append(len(turns))
            out["turns_sha256"].append(h.hexdigest())
            out["loss_chars"].append(len(learnt))
            out["loss_sha256"].append(hashlib.sha256(learnt.encode()).hexdigest())
            out["formatted_chars"].append(len(text))
        return {"tree": c["tree"], "branch": c["branch"], **{k: pa.array(v) for k, v in out.items()}}
    return map_batches(conversations.select("tree", "branch", "formatted", "loss"), run,
                       "tree long, branch int, n_turns long, turns_sha256 string, loss_chars long, "
                       "loss_sha256 string, formatted_chars long")


def format_trees(messages: DataFrame, tree: str, node: str, parent: str, score: str, role: str = "role",
                 text: str = "text", top_k: int = 1) -> DataFrame:
    """Formats the top_k branches of every reply tree: (tree, branch, n_turns, formatted,
    loss).  ``tree`` and ``node`` are longs; a null tree is a tree of its own, rows with a null
    node are left out.  Of rows that repeat a node, the smallest parent, the largest score
    and the smallest (role, text) hold.  Null roles and texts are empty, texts of any length
    are formatted whole; an empty table gives an empty result; other columns are not read."""
    m = messages.select(key_id(F.col(tree)).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"),
                        F.col(score).alias("score"), F.col(role).alias("role"),
                        F.col(text).alias("text")).filter("node is not null")
    path = best_paths(m.select("tree", "node", "parent", "score"), top_k)
    said = (m.groupBy(F.col("tree").alias("t2"), F.col("node").alias("n2"))
            .agg(F.min(F.struct("role", "text")).alias("m")).select("t2", "n2", "m.role", "m.text"))
    turns = (path.join(said, (F.col("tree") == F.col("t2")) & (F.col("node") == F.col("n2")))
             .select("tree", "branch", "pos", "role", "text"))
    return format_turns(turns)


def as_trees(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees: each turn answers the one before
    (null turn first, ties by role and text), so each conversation is one branch."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return (rows.withColumn("node", F.row_number().over(order).cast("long"))
            .withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
            .withColumn("score", F.lit(0.0)))


def conversations(rows: DataFrame) -> DataFrame:
    """Formats whole conversations: conv_id, n_turns, formatted, loss.  Nulls, long texts and an
    empty table as in ``format_trees``; repeated rows are turns of their own."""
    trees = as_trees(rows.select("conv_id", "turn", "role", "text"))
    out = format_trees(trees, "conv_id", "node", "parent", "score")
    return out
