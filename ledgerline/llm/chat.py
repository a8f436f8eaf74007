"""Chat formatting of reply trees.

Iterative self-joins by pointer doubling enumerate the root-to-leaf paths of
message trees, branches are ranked by their summed score, and each chosen
path is formatted as one conversation with a loss mask.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import stage, table

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: str, line: bool = False) -> str:
    r"""Hide control strings: ``\`` doubles and ``<|`` becomes ``<\|``; with ``line``, line feeds become ``\n``."""
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if line else text


def unescape(text: str, line: bool = False) -> str:
    if "\\" not in text:
        return text
    out, at = [], 0
    while (k := text.find("\\", at)) >= 0:
        out.append(text[at:k])
        c = text[k + 1 : k + 2]
        out.append("\n" if line and c == "n" else c)
        at = k + 2
    return "".join(out) + text[at:]


def format_turns(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, spans under the loss mask in code points) of (role, text) turns."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role, line=True)}\n", escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        turns.append((unescape(formatted[at + len(START) : line], line=True), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """``tree``, ``leaf``, ``branch_rank``, ``pos``, ``node`` of the ``top`` best root-to-leaf paths of each tree.

    ``nodes`` has ``tree`` (string), ``node``, ``parent`` (long) and ``score``
    (double, null: 0). A parent that is null or not there makes a root. A
    branch's score is the sum of its nodes'; ties go to the longer branch, then
    to the smaller leaf. Nodes on or below a cycle have no root and are on
    no path.

    Round k joins each node's 2**k-th ancestor with itself, so paths of n
    nodes take log2(n) self-joins up and as many down; a path's nodes are
    never gathered into one row here.
    """
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    level = stage(
        nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.expr("if(there, parent, null)").alias("anc"), F.lit(1).cast("long").alias("hops"), F.coalesce("score", F.lit(0.0)).alias("total")),
        "chat-up",
    )
    levels, last = [level], level.count().bit_length() + 1
    while len(levels) <= last and level.filter("anc is not null").limit(1).count():
        far = level.select("tree", F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("hops").alias("hops2"), F.col("total").alias("total2"))
        on = level.filter("anc is not null").join(far, ["tree", "anc"]).select("tree", "node", F.col("anc2").alias("anc"), (F.col("hops") + F.col("hops2")).alias("hops"), (F.col("total") + F.col("total2")).alias("total"))
        level = stage(level.filter("anc is null").unionByName(on), "chat-up")
        levels.append(level)
    parents = levels[0].filter("anc is not null").select("tree", F.col("anc").alias("node")).distinct()
    leaves = level.filter("anc is null").join(parents, ["tree", "node"], "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("total"), F.desc("hops"), "node"))
    path = leaves.withColumn("branch_rank", rank).filter(F.col("branch_rank") <= top).select("tree", F.col("node").alias("leaf"), "branch_rank", (F.col("hops") - 1).alias("pos"), "node")
    for k in range(len(levels) - 2, -1, -1):
        up = levels[k].filter("anc is not null").select("tree", "node", "anc")
        path = stage(path, "chat-down")
        path = path.unionByName(path.join(up, ["tree", "node"]).select("tree", "leaf", "branch_rank", (F.col("pos") - (1 << k)).alias("pos"), F.col("anc").alias("node")))
    return path


def format_trees(nodes: DataFrame, top: int = 1, loss_role: str = "assistant") -> DataFrame:
    """``tree``, ``leaf``, ``branch_rank``, ``formatted``, ``loss_spans`` of each chosen path.

    ``nodes`` as for :func:`best_paths`, with ``role`` and ``text`` (null:
    empty). Nulls, empty texts and control strings inside texts and roles
    survive the round trip. One task gathers the turns of one path, which is
    one cell of the result.
    """
    content = nodes.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = best_paths(nodes, top).join(content, ["tree", "node"]).groupBy("tree", "leaf", "branch_rank").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            done = [format_turns([(t["role"], t["text"]) for t in turns], loss_role) for turns in b.column(3).to_pylist()]
            spans = pa.array([[{"start": a, "end": z} for a, z in s] for _, s in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x for x, _ in done], pa.string()), spans], names=["tree", "leaf", "branch_rank", "formatted", "loss_spans"])

    return turns.mapInArrow(run, "tree string, leaf long, branch_rank int, formatted string, loss_spans array<struct<start: long, end: long>>")


def chains(turns: DataFrame) -> DataFrame:
    """Reply trees of linear conversations (conv_id, turn, role, text): each turn replies to the one before.

    Equal turns are ordered by role, then text, and each counts; a null
    conv_id is a conversation of its own; null turns come first.
    """
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    node = F.row_number().over(W.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long")
    return turns.select(tree.alias("tree"), "turn", "role", "text").withColumn("node", node).select("tree", "node", F.expr("if(node > 1, node - 1, null)").alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted text and loss mask say, parsed anew."""
    schema = T.StructType([T.StructField("tree", T.StringType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for tree, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse_turns(text)
                whole, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode())
                for s in spans:
                    said = unescape(text[s["start"] : s["end"]])
                    loss.update(said.encode())
                    chars += len(said)
                rows.append((tree, len(turns), whole.hexdigest(), chars, loss.hexdigest(), len(text)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=schema.names)

    return formatted.select("tree", "formatted", "loss_spans").mapInArrow(run, schema)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = f"{END}{START}assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    nodes = stage(chains(turns.unionByName(probe)), "chat-nodes")
    return read_back(format_trees(nodes)).select(F.expr("cast(nullif(tree, 'null') as bigint)").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
