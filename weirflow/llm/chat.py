"""Chat formatting over reply trees.

Nodes (conv_id, node, parent, role, text, score) form one tree or more for each conversation. Ancestors are found by
iterative self-joins that double the distance each time, so a path of n turns takes log2(n) joins, not n. Each leaf's
rows give its root-to-leaf path; branches of a conversation are ranked by score, and each chosen path is formatted as one
conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialize, require

#: The template's control strings: fixed values of the widely used chat markup.
START, END = "<|im_start|>", "<|im_end|>"
#: In texts, a backslash and the "<|" that begins any control string are escaped; in roles, so is a line feed.
_ESCAPE = re.compile(r"\\|<\|")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|im_start\|>((?:[^\n])*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """No control string is left in what this gives; unescape() takes it back."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else "\\l", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: {"l": "<|", "n": "\n"}.get(m[1], m[1]), text)


def format_turns(turns: list[tuple[str | None, str | None]], train_on: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask: spans of code points [from, to) of the texts of role train_on."""
    out: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        head = f"{START}{escape(role or '').replace(chr(10), chr(92) + 'n')}\n"
        body = escape(text or "")
        if (role or "") == train_on:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that format_turns() was given, NULL as empty."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def linear_tree(turns: DataFrame) -> DataFrame:
    """Nodes of conversations whose rows follow each other by turn: each row replies to the one before.

    Rows of equal turn are ordered by role, then text, NULL first.
    """
    require(turns, "conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    node = F.row_number().over(order).cast("long")
    rows = turns.select("conv_id", node.alias("node"), "role", "text")
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def reply_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Rows (conv_id, branch, depth, role, text): the chosen root-to-leaf paths, branch 1 being the best of its conversation.

    A path's score is the mean of its nodes' scores, NULL as 0; ties go to the smaller leaf. branches=0 keeps all. A node
    whose parent is NULL or missing is a root. Nodes of a conversation are told apart by node; a leaf whose ancestors run
    into a cycle has no root and gives no path. Texts join in at the end only.
    """
    require(nodes, "conv_id", "node", "parent", "role", "text", "score")
    links = materialize(nodes.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "chat-links")
    real = links.select("conv_id", F.col("node").alias("parent"))
    jump = links.where(F.col("parent").isNotNull()).join(_null_safe(real), _same("conv_id", "parent"), "left_semi").select("conv_id", "node", F.col("parent").alias("up"))
    inner = jump.select(F.col("conv_id").alias("c"), F.col("up").alias("n")).distinct()
    leaves = links.join(inner, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")), "left_anti")
    paths = leaves.select("conv_id", F.col("node").alias("leaf"), F.lit(0).cast("long").alias("above"), "node")
    most = links.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step <= most:  # beyond that, only cycles go on
        jump = materialize(jump, "chat-jump")
        if jump.isEmpty():
            break
        hop = jump.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "up")
        on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))
        paths = materialize(paths.unionByName(paths.join(hop, on).select("conv_id", "leaf", (F.col("above") + step).alias("above"), F.col("up").alias("node"))), "chat-paths")
        jump = jump.withColumnRenamed("up", "middle").join(hop, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("middle") == F.col("n"))).select("conv_id", "node", "up")
        step *= 2
    keyed = nodes.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    full = paths.join(keyed, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).drop("c", "n")
    per_path = full.groupBy("conv_id", "leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("above")).alias("depth"), "node", "role", "text"))).alias("turns"), F.avg("score").alias("score"))
    # A path that has run into a cycle repeats nodes; no other does.
    per_path = per_path.where(F.size("turns") == F.size(F.array_distinct(F.transform("turns", lambda t: t["node"]))))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf"))
    ranked = per_path.withColumn("branch", rank)
    return (ranked.where(F.col("branch") <= branches) if branches else ranked).select("conv_id", "branch", "leaf", "score", "turns")


def _null_safe(right: DataFrame) -> DataFrame:
    return right.select(*(F.col(c).alias(f"_{c}") for c in right.columns))


def _same(*names: str):
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(n).eqNullSafe(F.col(f"_{n}"))
    return cond


FORMATTED = "conv_id long, branch int, formatted string, loss array<struct<begin:long,end:long>>"


def format_conversations(nodes: DataFrame, branches: int = 1, train_on: str = "assistant") -> DataFrame:
    """One row for each chosen path: the formatted text and the loss mask's spans, in code points."""
    paths = reply_paths(nodes, branches).select("conv_id", "branch", "turns")

    def rows():
        def each(columns: dict) -> Iterator[tuple]:
            for conv, branch, turns in zip(columns["conv_id"], columns["branch"], columns["turns"], strict=True):
                text, spans = format_turns([(t["role"], t["text"]) for t in turns], train_on)
                yield conv, branch, text, [{"begin": a, "end": b} for a, b in spans]

        return each

    return map_rows(paths, rows, FORMATTED)


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text and its mask say, from these alone."""

    def rows():
        def each(columns: dict) -> Iterator[tuple]:
            for conv, text, spans in zip(columns["conv_id"], columns["formatted"], columns["loss"], strict=True):
                turns = parse(text)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescape(text[s["begin"] : s["end"]]) for s in spans)
                yield conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)

        return each

    return map_rows(formatted, rows, READ_BACK)
