"""Reply trees: root-to-leaf paths by iterative self-joins, branches ranked by score, each chosen path formatted as
one conversation.

Paths are found by pointer doubling: a node's pointer goes to an ancestor, and a self-join with the table replaces it
by that ancestor's own pointer, so the rounds grow with the logarithm of the depth. Every table is keyed by
(tree, node), which no hot tree makes uneven. Leaves are ranked by their path's score; of the chosen ones the paths are
unrolled by the same pointers, backwards, and gathered into one row each, which is the result's own size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: The template: a turn is OPEN, its role, a colon and a line feed, the text, a line feed, CLOSE and a line feed.
OPEN, CLOSE = "### ", "</turn>"
#: Control strings in a text, or what an escape has made of them, get a backslash in front; reading takes one away.
_ESCAPE = re.compile(r"(?m)^(\\*)(### )|(\\*)(</turn>)")
_UNESCAPE = re.compile(r"(?m)^\\(\\*)(### )|\\(\\*)(</turn>)")
_TURN = re.compile(r"### ([^\n]*):\n(.*?)\n</turn>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][1:], text)


def _escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def format_turns(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text, and the spans (code points, end exclusive) that carry loss: the learned role's texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{_escape_role(role)}:\n", escape(text)
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"\n{CLOSE}\n"]
        at += len(head) + len(body) + len(CLOSE) + 2
    return "".join(parts), spans


def read_turns(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation. A close mark stands on a line of its own and no escaped text has one."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((_unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def paths(nodes: DataFrame, top: int | None = 1, scratch: Scratch | None = None) -> DataFrame:
    """tree, leaf, rank, depth, node for the `top` best root-to-leaf paths of each tree (all if None).

    nodes: tree, node, parent (null, or a node that isn't there: a root), score (null: 0). A path's score is the sum
    along it; ties go to the longer path, then the smaller leaf. Repeated (tree, node) rows count once, the smallest
    parent and score standing. Nodes of a cycle hang on no root and are on no path.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "trees")
    base = nodes.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.min(F.coalesce("score", F.lit(0.0))).alias("score"))
    base = scratch.table(base, "nodes")
    there = base.select("tree", F.col("node").alias("parent"), F.lit(True).alias("found"))
    rooted = base.join(there, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("found"), F.col("parent")).alias("up"), F.col("score").alias("total"))
    # up: an ancestor 2**round above, null beyond the root; steps and total: edges and score from the node up to it
    now = scratch.table(rooted.withColumn("steps", F.col("up").isNotNull().cast("long")), "round")
    ups = [now]
    left = now.where("up IS NOT NULL").count()
    while left:
        # nodes whose pointer is past the root are done and only passed on
        far = now.select("tree", F.col("node").alias("up"), F.col("up").alias("far"), F.col("total").alias("far_total"), F.col("steps").alias("far_steps"))
        moved = now.where("up IS NOT NULL").join(far, ["tree", "up"]).select("tree", "node", F.col("far").alias("up"), (F.col("total") + F.col("far_total")).alias("total"), (F.col("steps") + F.col("far_steps")).alias("steps"))
        now = scratch.table(now.where("up IS NULL").select(*moved.columns).unionByName(moved), "round")
        ups.append(now)
        before, left = left, now.where("up IS NOT NULL").count()
        if left == before:  # only cycles are left
            break
    parents = rooted.where("up IS NOT NULL").select("tree", F.col("up").alias("node")).distinct()
    leaves = now.where("up IS NULL").join(parents, ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("steps"), "node"))
    chosen = leaves.withColumn("rank", rank)
    if top is not None:
        chosen = chosen.where(F.col("rank") <= top)
    path = chosen.select("tree", F.col("node").alias("leaf"), "rank", F.col("steps").alias("depth"), "node")
    for k in range(len(ups) - 1, -1, -1):  # every set of nodes gains its ancestors 2**k above
        step = ups[k].where("up IS NOT NULL").select("tree", "node", "up")
        higher = path.join(step, ["tree", "node"]).select("tree", "leaf", "rank", (F.col("depth") - (1 << k)).alias("depth"), F.col("up").alias("node"))
        path = scratch.table(path.unionByName(higher), "path")
    return path


def _formatted(learned: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [format_turns([(t["role"], t["text"]) for t in turns], learned) for turns in batch.column("turns").to_pylist()]
            kept = [batch.column(c) for c in ("tree", "rank")]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*kept, pa.array([t for t, _ in done], pa.string()), spans], ["tree", "rank", "text", "loss_spans"])

    return run


def conversations(nodes: DataFrame, top: int | None = 1, learned: str = "assistant", scratch: Scratch | None = None) -> DataFrame:
    """tree, rank, text, loss_spans: each chosen path of nodes (tree, node, parent, role, text, score) as one
    formatted conversation. Null roles and texts are empty ones; an empty table gives an empty result."""
    scratch = scratch or Scratch(nodes.sparkSession, "trees")
    found = paths(nodes, top, scratch)
    said = nodes.groupBy("tree", "node").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("said"))
    turns = found.join(said, ["tree", "node"]).groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "said"))).alias("turns"))
    flat = turns.select("tree", F.col("rank").cast("long").alias("rank"), F.transform("turns", lambda t: t["said"]).alias("turns"))
    return flat.mapInArrow(_formatted(learned), f"tree {dict(nodes.dtypes)['tree']}, rank long, text string, loss_spans array<struct<start: long, end: long>>")


def chain(rows: DataFrame) -> DataFrame:
    """Conversations of turns as trees without branches: each row answers the one before. Rows of a conversation are
    numbered by turn, then role and text, so that ties and repeated rows keep places of their own. A null conv_id is
    a conversation like any other, and a null turn comes first. Trees are named by text, so that null has a name too:
    digests gives the conv_id back."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.withColumn("node", F.row_number().over(order).cast("long"))
    tree = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("long").cast("string")), F.lit("null"))
    return numbered.select(tree.alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.lit(0.0).alias("score"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
            turns = read_turns(text)
            whole = hashlib.sha256()
            for role, said in turns:
                whole.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            learned = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            rows.append((len(turns), whole.hexdigest(), len(learned), hashlib.sha256(learned.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([batch.column("tree"), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], ["conv_id", *names])


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations of chain say, read back from them; conv_id is null where it was."""
    told = formatted.mapInArrow(_digests, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return told.withColumn("conv_id", F.expr("try_cast(substring(conv_id, 2) AS long)"))
