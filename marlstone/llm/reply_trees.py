"""Chat formatting of reply trees.

Messages form trees by parent. Self-joins that double the distance of a pointer each round give
every message its depth and the sum of scores from the root; branches are ranked by their mean
score; the same pointers, read from the longest down, enumerate the messages of the chosen paths.
A path is named by its leaf. Each is formatted as one conversation, in segments of bounded length,
with the spans of the loss mask. Control strings inside texts are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

START, END = "<|im_start|>", "<|im_end|>"
#: Code points of a segment, about.
SEGMENT = 1 << 20
FORMATTED = "conv_id long, leaf long, first_pos long, text string, turns array<struct<role_start:int,text_start:int,text_end:int,loss:boolean>>"
DIGEST = "conv_id long, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    """No ``<|`` is left: after its ``<`` a backslash is put, one more where backslashes stood already."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def numbered(rows: DataFrame, order: list[str], scratch: common.Scratch, name: str) -> DataFrame:
    """Adds ``node``, 0 and up over all rows in the given order, without one task for all."""
    rows = rows.repartitionByRange(common.parts_for(rows), *order).sortWithinPartitions(*order)
    rows = scratch.cut(rows.withColumn("_m", F.monotonically_increasing_id()), name)
    part = F.shiftright("_m", 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    first = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    return rows.withColumn("_p", part).join(first, "_p").withColumn("node", F.col("_first") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_first")


def chat_tree(conversations: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Messages (conv_id, node, parent, role, text, score) of chats whose turns follow each other.

    Turns that tie are ordered by role and text. The score is 1 for every message.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = scratch.cut(numbered(rows.withColumn("_h", F.xxhash64("text")), ["conv_id", "turn", "role", "_h"], scratch, "sorted"), "numbered")
    before = rows.select((F.col("node") + 1).alias("node"), F.col("conv_id").alias("_conv"))
    linked = rows.join(before.withColumn("_has", F.lit(True)), "node", "left")
    same = F.col("_has").isNotNull() & F.col("_conv").eqNullSafe(F.col("conv_id"))
    return linked.select("conv_id", "node", F.when(same, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def paths(messages: DataFrame, scratch: common.Scratch, most: int | None = 1) -> DataFrame:
    """conv_id, leaf, mean, node, pos: the messages of root-to-leaf paths, pos 0 at the root.

    All paths if ``most`` is None, else the ``most`` best ones of each conversation: those of the greatest mean score, of
    equals the longer one, then the one with the smaller leaf. Rounds: the logarithm of the depth. A
    parent that is no message of the table makes its child a root. Messages on a cycle, or below
    one, reach no root and belong to no path. Nodes are distinct and not null.
    """
    nodes = messages.select("conv_id", "node", "parent", "score")
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("_known"))
    # Roots have no key to join by: all of them would meet in one task.
    replies = nodes.filter("parent is not null").join(known, "parent", "left").select("conv_id", "node", F.when(F.col("_known"), F.col("parent")).alias("up"), "score")
    roots = nodes.filter("parent is null").select("conv_id", "node", F.lit(None).cast("long").alias("up"), "score")
    nodes = scratch.cut(replies.unionByName(roots), "nodes")
    level = nodes.select("node", "up", F.col("score").alias("sum"), F.lit(1).cast("long").alias("steps"))
    done = level.filter("up is null").select("node", "sum", "steps")
    active = level.filter("up is not null")
    jumps, k, left = [], 0, active.count()
    while left:
        jumps.append(active)
        k += 1
        # Those that ended are in ``done``, the others in the level itself.
        target = active.unionByName(done.withColumn("up", F.lit(None).cast("long"))).select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("sum").alias("_sum"), F.col("steps").alias("_steps"))
        joined = scratch.cut(active.join(target, "up").select("node", F.col("_up").alias("up"), (F.col("sum") + F.col("_sum")).alias("sum"), (F.col("steps") + F.col("_steps")).alias("steps")), f"round{k}")
        done = done.unionByName(joined.filter("up is null").select("node", "sum", "steps"))
        active = joined.filter("up is not null")
        # Of those that reach a root some end in each round; if none did, only cycles are left.
        before, left = left, active.count()
        if left == before:
            break
    leaves = nodes.join(nodes.filter("up is not null").select(F.col("up").alias("node")).distinct(), "node", "left_anti").select("conv_id", "node")
    ranked = leaves.join(done, "node").select("conv_id", F.col("node").alias("leaf"), (F.col("sum") / F.col("steps")).alias("mean"), "steps")
    if most is not None:
        best = Window.partitionBy("conv_id").orderBy(F.desc("mean"), F.desc("steps"), "leaf")  # limited on the map side first
        ranked = ranked.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= most).drop("_rank")
    at = scratch.cut(ranked.select("conv_id", "leaf", "mean", F.col("leaf").alias("node"), (F.col("steps") - 1).alias("pos")), "chosen")
    for j in range(len(jumps) - 1, -1, -1):
        up = at.join(jumps[j].select("node", F.col("up").alias("_up")), "node").select("conv_id", "leaf", "mean", F.col("_up").alias("node"), (F.col("pos") - (1 << j)).alias("pos"))
        # Above a fork both paths have the message, each under its own leaf.
        at = scratch.cut(at.unionByName(up), f"path{j}")
        scratch.drop("chosen" if j == len(jumps) - 1 else f"path{j + 1}")
    return at


def format_paths(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """Formatted segments: a path (conv_id, leaf) is its segments in the order of ``first_pos``."""
    rows = chosen.join(messages.select("node", "role", "text"), "node").select("conv_id", "leaf", "pos", "role", "text")
    # Long conversations may be shared out: a range holds neighbouring positions.
    order = ["conv_id", "leaf", "pos"]
    rows = rows.repartitionByRange(common.parts_for(rows), *order).sortWithinPartitions(*order)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, size = None, 0, 0
        text: list[str] = []
        turns: list[dict] = []
        out: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("role_start", pa.int32()), ("text_start", pa.int32()), ("text_end", pa.int32()), ("loss", pa.bool_())]))]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "leaf", "first_pos", "text", "turns"])

        for rows in it:
            for some in common.batches(rows, 4):
                for conv, leaf, pos, role, said in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    if turns and ((conv, leaf) != now or size >= SEGMENT):
                        out.append((*now, first, "".join(text), turns))
                        held += size
                        text, turns, size = [], [], 0
                        if held >= SEGMENT:
                            yield batch()
                            out, held = [], 0
                    if not turns:
                        now, first = (conv, leaf), pos
                    head, body = f"{START}{escape_role(role)}\n", escape(said)
                    turns.append({"role_start": size + len(START), "text_start": size + len(head), "text_end": size + len(head) + len(body), "loss": role == "assistant"})
                    text += [head, body, f"{END}\n"]
                    size += len(head) + len(body) + len(END) + 1
        if turns:
            out.append((*now, first, "".join(text), turns))
        if out:
            yield batch()

    return rows.mapInArrow(run, FORMATTED)


def escape_role(role: str) -> str:
    """A role has one line: line ends become ``\\n`` after backslashes are doubled."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def read_back(formatted: DataFrame) -> DataFrame:
    """DIGEST of the formatted paths: everything comes from their text and its spans.

    A digest of a whole path is taken in order, in one task that streams its segments and holds one
    at a time.
    """
    rows = formatted.repartition(common.parts_for(formatted), "conv_id", "leaf").sortWithinPartitions("conv_id", "leaf", "first_pos")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        out: list[tuple] = []

        def done() -> None:
            if state:
                out.append((*now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])

        for rows in it:
            for some in common.batches(rows, 3):
                for conv, leaf, _, text, turns in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    if state is None or (conv, leaf) != now:
                        done()
                        now, state = (conv, leaf), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    state[4] += len(text)
                    for t in turns:
                        role = unescape_role(text[t["role_start"] : t["text_start"] - 1])
                        said = unescape(text[t["text_start"] : t["text_end"]])
                        state[0] += 1
                        state[1].update(f"{role}\n{said}\n".encode())
                        if t["loss"]:
                            state[2] += len(said)
                            state[3].update(said.encode())
                if len(out) >= 10_000:
                    yield batch()
                    out = []
        done()
        if out:
            yield batch()

    return rows.mapInArrow(run, DIGEST)


def format_trees(messages: DataFrame, scratch: common.Scratch, most: int | None = None) -> DataFrame:
    """FORMATTED segments of the ``most`` best paths (all if None) of each conversation's trees.

    ``messages`` has conv_id, node, parent, role, text and score; null roles and texts are empty. An
    empty table gives no rows; see ``paths`` for ranks, ties, cycles and missing parents.
    """
    messages = messages.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    return scratch.cut(format_paths(messages, paths(messages, scratch, most)), "formatted")


def format_chats(conversations: DataFrame) -> DataFrame:
    """Formats every chat as its path, writes that, and gives digests of what is read back.

    Null texts and roles are empty. Rows that tie in (conv_id, turn) follow by role and text, and
    repeated rows are turns each. A null conv_id is a conversation of its own. An empty table gives
    no rows. Only conv_id, turn, role and text are read; other columns may have any name.
    """
    scratch = common.Scratch(conversations.sparkSession, "chats")
    messages = scratch.cut(chat_tree(conversations, scratch), "messages")
    scratch.drop("sorted", "numbered")
    return read_back(format_trees(messages, scratch)).drop("leaf")
