"""Chat formatting: root-to-leaf paths of reply trees, ranked by score, each chosen path as one conversation.

Messages name the message that they answer. Self-joins double the distance that every message sees towards its root, so a tree of
depth d takes log2(d) of them, and carry the sums by which branches are ranked. The chosen leaves then walk back through the same
tables, the longest jumps first, which gives every message of their paths once. Rows are narrow; texts join the chosen paths
only, and a conversation comes together in one row.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLES = ("assistant",)
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    """No ``<|`` is left: one more backslash stands inside every ``<``, backslashes, ``|``."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), unescape(role))


def render(turns: list[tuple[str, str]], loss_roles: tuple[str, ...] = LOSS_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """The conversation between control strings, and the code points (begin, end) of the texts that carry loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts again, from the formatted conversation alone."""
    return [(unescape_role(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _key(tree: Column, name: Column) -> Column:
    """128 bits for a message of a tree, null trees included."""
    return F.unhex(F.md5(F.to_json(F.struct(tree.cast("string").alias("t"), name.cast("string").alias("i")))))


def _messages(messages: DataFrame, tree: str, name: str, parent: str, role: str, text: str, score: Column) -> DataFrame:
    """(tree, name, key, up, score, content, role, text); a message without an id is known by its content."""
    t, content = F.col(tree), F.xxhash64(F.col(role).isNull(), role, F.col(text).isNull(), text)
    nameless = F.unhex(F.md5(F.to_json(F.struct(t.cast("string").alias("t"), F.col(parent).cast("string").alias("p"), F.col(role).cast("string").alias("r"), F.col(text).alias("x")))))
    key = F.when(F.col(name).isNull(), nameless).otherwise(_key(t, F.col(name)))
    up = F.when(F.col(parent).isNotNull(), _key(t, F.col(parent)))
    return messages.select(t.alias("tree"), F.col(name).cast("string").alias("name"), key.alias("key"), up.alias("up"), F.coalesce(F.nanvl(score.cast("double"), F.lit(0.0)), F.lit(0.0)).alias("score"), content.alias("content"), F.col(role).cast("string").alias("role"), F.col(text).alias("text"))


def _doubled(jump: DataFrame, *sums: str) -> DataFrame:
    """From jumps over 2**k messages to jumps over 2**(k+1): a self-join of those that have not reached their root."""
    ahead = jump.select(F.col("key").alias("up"), F.col("up").alias("next"), *(F.col(s).alias(f"more_{s}") for s in sums))
    live = jump.where("up IS NOT NULL").join(ahead, "up").select("key", F.col("next").alias("up"), *((F.col(s) + F.col(f"more_{s}")).alias(s) for s in sums))
    return live.union(jump.where("up IS NULL").select(*live.columns))


def _without_cycles(links: DataFrame, endless: DataFrame, rounds: int, scratch: Scratch) -> DataFrame:
    """Links in which the smallest message of every cycle is a root."""
    least = scratch.keep(links.join(endless, "key", "left_semi").select("key", "up", F.col("up").alias("least")), "cycle0")
    for k in range(rounds):
        ahead = least.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("least").alias("other"))
        least = scratch.keep(least.join(ahead, "up").select("key", F.col("next").alias("up"), F.least("least", "other").alias("least")), f"cycle{k + 1}")
    roots = least.where(F.col("least") == F.col("key")).select("key", F.lit(True).alias("root"))
    return links.join(roots, "key", "left").withColumn("up", F.when(F.col("root").isNull(), F.col("up"))).drop("root")


def reply_paths(spark: SparkSession, rows: DataFrame, scratch: Scratch, branches: int, rank_by: str) -> DataFrame:
    """(tree, branch, rank, branch_score, pos, key, content): the messages of the best branches of every tree, in order of pos."""
    best = F.max(F.struct("score", "up", "content")).alias("best")
    nodes = scratch.keep(rows.groupBy("key").agg(F.first("tree").alias("tree"), F.first("name").alias("name"), best).select("key", "tree", "name", "best.*"), "nodes")
    there = nodes.select(F.col("key").alias("up"))
    links = nodes.where("up IS NOT NULL").select("key", "up", "score").join(there, "up", "left_semi").select("key", "up", "score")
    links = links.union(nodes.select("key", "up", "score").join(there, "up", "left_anti").select("key", F.lit(None).cast("binary").alias("up"), "score"))
    total = nodes.count()
    while True:
        jumps = [scratch.keep(links.select("key", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("n")), f"jump0-{len(scratch.paths)}")]
        while jumps[-1].where("up IS NOT NULL").limit(1).count() and 1 << (len(jumps) - 1) <= total:
            jumps.append(scratch.keep(_doubled(jumps[-1], "total", "n"), f"jump{len(jumps)}-{len(scratch.paths)}"))
        endless = jumps[-1].where("up IS NOT NULL").select("key")
        if not endless.limit(1).count():
            break
        links = scratch.keep(_without_cycles(links, endless, len(jumps), scratch), f"links-{len(scratch.paths)}")
    leaves = jumps[-1].join(jumps[0].where("up IS NOT NULL").select(F.col("up").alias("key")).distinct(), "key", "left_anti").join(nodes.select("key", "tree", "name"), "key")
    scored = leaves.withColumn("branch_score", F.col("total") if rank_by == "sum" else F.col("total") / F.col("n"))
    order = Window.partitionBy("tree").orderBy(F.col("branch_score").desc(), F.col("n").desc(), "name", "key")
    chosen = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    paths = chosen.select("tree", F.col("key").alias("branch"), "rank", "branch_score", (F.col("n") - 1).alias("pos"), "key")
    for k in range(len(jumps) - 2, -1, -1):
        jump = jumps[k].where("up IS NOT NULL").select("key", "up")
        here, there = F.struct("pos", "key"), F.struct((F.col("pos") - (1 << k)).alias("pos"), F.col("up").alias("key"))
        met = F.explode(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("m")
        paths = paths.join(jump, "key", "left").select("tree", "branch", "rank", "branch_score", met).select("tree", "branch", "rank", "branch_score", "m.*")
    return paths.join(nodes.select("key", "content"), "key")


def format_conversations(
    spark: SparkSession, messages: DataFrame, tree_col: str = "conv_id", id_col: str = "message_id", parent_col: str = "parent_id", role_col: str = "role", text_col: str = "text", score_col: str | None = None, branches: int = 1, rank_by: str = "mean", loss_roles: tuple[str, ...] = LOSS_ROLES
) -> DataFrame:
    """(tree, rank, branch_score, formatted, loss_spans): the ``branches`` best root-to-leaf paths of every tree of messages.

    A branch scores the mean (or ``sum``) of its messages' scores, null and NaN counting 0; ties go to the longer branch, then the
    smaller id of the leaf. A message whose parent is null or not in its tree is a root; of a cycle of replies the message with the
    smallest key (a hash) becomes one. Rows that repeat tree and id are one message, the row of the greatest score; a message
    without an id can have no replies, and rows of one content are one. A null tree is one of its own. Null roles and texts are
    empty. An empty table gives an empty one; other columns are not read.

    Only a conversation's own text is ever in one row. ``branches`` bounds the rows that leave a tree before they are ranked.
    """
    scratch = Scratch(spark, "chat")
    rows = _messages(messages, tree_col, id_col, parent_col, role_col, text_col, F.col(score_col) if score_col else F.lit(0.0))
    paths = scratch.keep(reply_paths(spark, rows.drop("role", "text"), scratch, branches, rank_by), "paths")
    texts = rows.select("key", "content", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.struct("pos", "role", "text")
    whole = paths.join(texts, ["key", "content"]).groupBy("branch", "rank", "branch_score").agg(F.first("tree").alias("tree"), F.array_sort(F.collect_set(turn)).alias("turns")).select("tree", "rank", "branch_score", "turns")

    def run(batches):
        for batch in batches:
            made = [render([(t["role"], t["text"]) for t in turns.as_py()], loss_roles) for turns in batch.column(3)]
            spans = pa.array([[{"begin": a, "end": b} for a, b in s] for _, s in made], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([f for f, _ in made], pa.string()), spans], names=["tree", "rank", "branch_score", "formatted", "loss_spans"])

    shape = f"tree {whole.schema['tree'].dataType.simpleString()}, rank int, branch_score double, formatted string, loss_spans array<struct<begin: bigint, end: bigint>>"
    return whole.mapInArrow(run, shape)


def read_back(formatted: DataFrame) -> DataFrame:
    """(tree, rank, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from ``formatted`` and ``loss_spans`` alone:
    digests of role, newline, text, newline a turn, and of the text under the loss mask, unescaped."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                turns, loss = parse(text), "".join(unescape(text[s["begin"] : s["end"]]) for s in spans)
                out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([o[k] for o in out], t) for k, t in enumerate(kinds))], names=["tree", "rank", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    shape = f"tree {formatted.schema['tree'].dataType.simpleString()}, rank int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("tree", "rank", "formatted", "loss_spans").mapInArrow(run, shape)


def chains(turns: DataFrame, tree_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(tree, message_id, parent_id, role, text): rows of conversations as messages that each answer the one before.

    Rows go by the order column, null first, then by role and text; rows that repeat are turns of their own."""
    order = Window.partitionBy(tree_col).orderBy(order_col, role_col, text_col)
    number = turns.select(F.col(tree_col).alias("tree"), F.row_number().over(order).alias("message_id"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return number.withColumn("parent_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1))
