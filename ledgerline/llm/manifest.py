"""A Merkle manifest of a dataset, and authentication paths by fractal traversal.

Rows are leaves of one tree per ``tree`` value, in order; the trees' roots, in
order, are the leaves of the manifest's own tree. While a tree has several
nodes, every ``ARITY`` consecutive ones (the last run may be shorter, even one
node) become the hash of their digests, concatenated as lowercase hex text.

Leaves get their place by a range shuffle and counts per part. Aligned blocks
of ``ARITY ** LEVELS`` leaves are the tasks' units: one pass hashes each block
to its node, the nodes' trees are built level by level and paths handed down
in joins, and a second pass walks each block with the traversal below and
appends the path from the block's node to the root. Digests alone are
shuffled, never texts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import free, stage, table

ARITY, LEVELS = 8, 3
BLOCK = ARITY**LEVELS
#: Trees up to this number are ranked in one window and broadcast; more are ranked by ranges and joined by shuffles.
FEW = 10_000
PATH = "array<struct<before: string, after: string>>"


def node(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Builder:
    """Nodes of one level from leaves in order, with less than one run kept per level below."""

    def __init__(self, level: int):
        self.runs = [[] for _ in range(level)]

    def push(self, digest: str, at: int = 0) -> str | None:
        """The node that this leaf completes, if any."""
        for run in self.runs[at:]:
            run.append(digest)
            if len(run) < ARITY:
                return None
            digest = node(run)
            run.clear()
        return digest

    def close(self) -> str | None:
        """The last node, whose runs are shorter."""
        done = None
        for k, run in enumerate(self.runs):
            if run:
                digest = node(run)
                run.clear()
                done = self.push(digest, k + 1)
        return done


class Traversal:
    """The authentication paths of a block's leaves, one after the other.

    ``leaf(i)`` gives leaf i of n; the tree is ``levels`` high. Per level the
    subtree (run of siblings) on the present path exists as a whole, and the
    next one to the right, the desired one, is built meanwhile from leaves
    ahead: one leaf for each leaf that is left, so it is there when needed. Kept
    are two runs a level and what the builders hold: ``levels ** 2`` runs, whatever n.
    """

    def __init__(self, leaf, n: int, levels: int):
        self.leaf, self.n, self.levels = leaf, n, levels
        self.exist, self.desired = [[] for _ in range(levels)], [[] for _ in range(levels)]
        self.builders, self.ahead = [Builder(s) for s in range(levels)], [0] * levels
        for s in range(levels):  # the first subtree of every level, then they are built ahead
            self._feed(s, ARITY ** (s + 1))
            self.exist[s], self.desired[s] = self.desired[s], []

    def _feed(self, s: int, leaves: int) -> None:
        end = min(self.n, self.ahead[s] + leaves)
        for i in range(self.ahead[s], end):
            done = self.builders[s].push(self.leaf(i))
            if done is not None:
                self.desired[s].append(done)
        if self.ahead[s] < end == self.n:
            done = self.builders[s].close()
            if done is not None:
                self.desired[s].append(done)
        self.ahead[s] = end

    def root(self) -> str:
        return node(self.exist[-1]) if self.levels else self.leaf(0)

    def paths(self):
        """Per leaf the (digests before, digests after) in its run of each level, upwards; from second leaf on the same list, changed."""
        sides = [("", "")] * self.levels
        for i in range(self.n):
            for s in range(self.levels):
                if i % ARITY**s:
                    break
                if i and i % ARITY ** (s + 1) == 0:
                    self.exist[s], self.desired[s] = self.desired[s], []
                at = i // ARITY**s % ARITY
                sides[s] = "".join(self.exist[s][:at]), "".join(self.exist[s][at + 1 :])
            yield sides
            for s in range(self.levels - 1):  # the top level has no next subtree
                self._feed(s, 1)


def height(n: int) -> int:
    levels = 0
    while ARITY**levels < n:
        levels += 1
    return levels


def placed(rows: DataFrame, by: list[str], order: list[str], tag: str) -> DataFrame:
    """``rows`` with ``_pos``, from 0 within ``by`` in order (nulls first), and ``_n``, the rows of ``by``; staged.

    A range shuffle sorts all rows; a row's place is its place in its part and
    the counts of parts before. Parts are cut by the whole order, so no
    value of ``by`` is one task's.
    """
    spark = rows.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    cut = stage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), tag)
    counts = cut.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # one row a part
    before = F.coalesce(F.sum("_rows").over(w.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = stage(counts.select(*by, "_part", (before - F.col("_first")).alias("_base"), F.sum("_rows").over(w).alias("_n")).drop("_rows"), f"{tag}-bases")
    small = F.broadcast(bases) if bases.count() <= 100_000 else bases  # one row a part and value of ``by`` in it
    out = cut.join(small, [*by, "_part"]).withColumn("_pos", F.col("_at") + F.col("_base")).drop("_part", "_at", "_base")
    out = stage(out, f"{tag}-placed")
    free(spark, cut)
    free(spark, bases)
    return out


def upper_paths(nodes: DataFrame) -> DataFrame:
    """``_t``, ``_p``, ``_path`` (to its tree's root) and ``_root`` of nodes (``_t``, ``_p`` from 0 without gaps, ``_h``, ``_n``: nodes of the tree); staged.

    Level by level every eight neighbours meet in a row; then paths go down the
    same rows. All hot trees are spread, as a run of eight is the group.
    """
    spark, most = nodes.sparkSession, nodes.agg(F.max("_n")).first()[0] or 0
    levels, runs = [stage(nodes.select("_t", "_p", "_h", "_n"), "manifest-nodes")], []
    while most > 1:
        run = levels[-1].filter("_n > 1").groupBy("_t", F.expr(f"_p div {ARITY}").alias("_q")).agg(F.sort_array(F.collect_list(F.struct("_p", "_h"))).alias("_run"), F.max("_n").alias("_n"))
        run = run.select("_t", "_q", F.expr("transform(_run, x -> x._h)").alias("_run"), F.expr(f"(_n + {ARITY - 1}) div {ARITY}").alias("_n"))
        runs.append(stage(run.withColumn("_h", F.sha2(F.array_join("_run", ""), 256)), "manifest-run"))
        levels.append(runs[-1].select("_t", F.col("_q").alias("_p"), "_h", "_n"))
        most = -(-most // ARITY)
    side = F.expr(f"named_struct('before', array_join(slice(_run, 1, _i), ''), 'after', array_join(slice(_run, _i + 2, {ARITY}), ''))")
    paths = None
    for k in reversed(range(len(levels))):
        found = levels[k].filter("_n = 1").select("_t", "_p", F.expr(f"cast(array() as {PATH})").alias("_path"), F.col("_h").alias("_root"))
        if paths is not None:
            each = runs[k].select("_t", "_q", F.posexplode("_run").alias("_i", "_h"), "_run").join(paths.withColumnRenamed("_p", "_q"), ["_t", "_q"])
            found = found.unionByName(each.select("_t", F.expr(f"_q * {ARITY} + _i").alias("_p"), F.concat(F.array(side), "_path").alias("_path"), "_root"))
        above, paths = paths, stage(found, "manifest-paths")
        if above is not None:
            free(spark, above)
    for staged in (levels[0], *runs):
        free(spark, staged)
    return paths


def block_node(leaves: str, n: str) -> Column:
    """The node over a block's leaves, an array; trees of one block end with their root, others' blocks are hashed ``LEVELS`` times."""
    up = f"transform(sequence(0, cast((size(x) - 1) div {ARITY} as int)), i -> sha2(array_join(slice(x, i * {ARITY} + 1, {ARITY}), ''), 256))"
    for _ in range(LEVELS):
        leaves = f"transform(array({leaves}), x -> if(size(x) > 1 or {n} > {BLOCK}, {up}, x))[0]"
    return F.expr(f"{leaves}[0]")


def manifest(rows: DataFrame, tree: Column, order: list[str], leaf: Column, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row: ``tree``, ``leaf`` (hex), ``position`` in its tree, ``subroot``, ``root``, ``path`` and the columns of ``carry``.

    ``path`` has per level, upwards and through the tree of trees, the siblings
    ``before`` and ``after`` (digests one after the other); the leaf between
    them, hashed level by level, gives ``root``. Null trees are one tree, the
    first; other trees follow in the order of their UTF-8 bytes. Null order
    values come first; rows that tie are ordered by leaf, and equal
    leaves at ties are interchangeable, each with its own place. An empty
    table gives an empty result. Other columns are only read by the
    expressions given; ``carry`` must not use the names above.
    """
    spark, carry = rows.sparkSession, carry or {}
    key = F.when(tree.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), tree.cast("string")))
    kept = F.struct(*(c.alias(n) for n, c in carry.items()), F.lit(0).alias("_"))
    first = stage(rows.select(key.alias("_t"), F.struct(*order).alias("_o"), leaf.alias("_h"), kept.alias("_carry"), F.monotonically_increasing_id().alias("_id")), "manifest-leaves")
    leaves = placed(first, ["_t"], ["_o", "_h", "_id"], "manifest").withColumn("_block", F.expr(f"_pos div {BLOCK}"))
    free(spark, first)
    blocks = leaves.groupBy("_t", "_block").agg(F.sort_array(F.collect_list(F.struct("_pos", "_h"))).alias("_x"), F.max("_n").alias("_n"))
    blocks = blocks.select("_t", F.col("_block").alias("_p"), F.expr("transform(_x, x -> x._h)").alias("_x"), "_n").select("_t", "_p", block_node("_x", "_n").alias("_h"), F.expr(f"(_n + {BLOCK - 1}) div {BLOCK}").alias("_n"))
    uppers = upper_paths(blocks)
    trees = stage(uppers.filter("_p = 0").select(F.col("_t").alias("_of"), F.col("_root").alias("_h")), "manifest-trees")  # one row a tree
    if trees.count() <= FEW:
        trees = trees.withColumn("_pos", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("_of")) - 1).withColumn("_n", F.lit(trees.count()).cast("long"))
    else:
        trees = placed(trees, [], ["_of"], "manifest-trees")
    tops = upper_paths(trees.select(F.lit("").alias("_t"), F.col("_pos").cast("long").alias("_p"), "_h", "_n"))
    whole = trees.join(tops, F.col("_pos") == F.col("_p")).select(F.col("_of").alias("_t"), F.col("_path").alias("_top"), F.col("_root").alias("_whole"))
    whole = stage(whole, "manifest-tops")  # one row a tree
    few = F.broadcast(whole) if whole.count() <= FEW else whole
    proofs = uppers.join(few, "_t").select("_t", F.col("_p").alias("_block"), F.concat("_path", "_top").alias("_path"), F.col("_root").alias("_subroot"), "_whole")
    proofs = stage(proofs, "manifest-proofs")  # one row a block
    for staged in (uppers, trees, tops, whole):
        free(spark, staged)
    out = f"tree string, leaf string, position long, subroot string, root string, path {PATH}, _carry {leaves.schema['_carry'].dataType.simpleString()}"

    def walk(group, upper):
        import pyarrow as pa

        group = group.sort_by("_pos")
        hashes, n = group.column("_h").to_pylist(), group.num_rows
        levels = LEVELS if group.column("_n")[0].as_py() > BLOCK else height(n)
        above = [(x["before"], x["after"]) for x in upper.column("_path")[0].as_py()]
        before, after = [], []
        for sides in Traversal(hashes.__getitem__, n, levels).paths():
            for b, a in (*sides, *above):
                before.append(b)
                after.append(a)
        long = levels + len(above)
        side = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
        path = pa.ListArray.from_arrays(pa.array(range(0, n * long + 1, long) if long else [0] * (n + 1), pa.int32()), side)
        same = lambda c: pa.repeat(upper.column(c)[0].cast(pa.string()), n)
        name = group.column("_t")[0].as_py()
        tree = pa.repeat(pa.scalar(name[1:] if name[0] == "1" else None, pa.string()), n)
        return pa.table([tree, group.column("_h").cast(pa.string()), group.column("_pos"), same("_subroot"), same("_whole"), path, group.column("_carry")], names=["tree", "leaf", "position", "subroot", "root", "path", "_carry"])

    pairs = leaves.groupBy("_t", "_block").cogroup(proofs.groupBy("_t", "_block"))
    return pairs.applyInArrow(walk, out).select("tree", "leaf", "position", "subroot", "root", "path", *(F.col("_carry")[n].alias(n) for n in carry))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["before"], acc, x["after"]), 256))


def digest(*values: Column) -> Column:
    """Hash of values: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, digest(*parts, lowered))
    rows = manifest(docs, F.col("lang"), ["doc_id"], digest(*parts, F.col("text")), {"doc_id": F.col("doc_id"), "_tampered": tampered})
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), ""), 256)
    out = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("_tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
