"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Every source's documents form blocks, and every slot of the mix takes one. A
source of weight w (all weights sum to 1) may begin its block j (from 0) at
slot floor(j / w), its release, and has it done by slot ceil((j + 1) / w), its
deadline. Each slot takes, of the released blocks, the one with the earliest
deadline. Blocks are of one slot each and the weights fill every slot, so
earliest-deadline-first meets all deadlines; a block in its window at every
time means that a source is less than one block from its weight in every
beginning of the mix, with any number of sources and at any length.

Weights are whole numbers: the given ones if their decimals allow it within a sum
of 2**40, else rounded to 2**40ths. Releases and deadlines are exact for them; rounding
adds at most t * 2**-41 blocks in t slots. The schedule runs in windows of slots: one pass finds the state at
each window's begin, then windows are scheduled apart from each other.
"""

from __future__ import annotations

import json
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import free, stage, table

#: A source's name that stands for null.
NO_SOURCE = "\u0000null"
#: What all weights sum to, about, as integers.
UNIT = 2**40
#: Slots of a window, and blocks of a source whose slots go into one row.
WINDOW, CHUNK = 1024, 256


def block_of(a: str, j: str) -> str:
    """A source's weight, its block j, and the block's release and deadline; ``total`` is the sum of weights."""
    return f"named_struct('a', {a}, 'j', {j}, 'release', ({j}) * total div {a}, 'deadline', (({j} + 1) * total + {a} - 1) div {a})"


def earliest(state: str, t: str) -> str:
    """The place in ``state`` of the block to take at slot t: of the released ones, that with the earliest deadline (then the first source)."""
    return f"array_min(transform({state}, (x, i) -> if(x.release <= {t}, named_struct('deadline', x.deadline, 'i', i), null))).i"


def taken(state: str, p: str) -> str:
    """The state with the next block of the source at p."""
    return f"transform({state}, (x, i) -> if(i = {p}, {block_of('x.a', '(x.j + 1)')}, x))"


def let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def slots_of(window: str) -> str:
    return f"sequence({window} * {WINDOW}L, {window} * {WINDOW}L + {WINDOW - 1}L)"


def whole_weights(weights: dict) -> dict[str, float]:
    """The weights that count, by name: as whole numbers in the same proportion if their decimals allow it."""
    named = {NO_SOURCE if k is None else str(k): Fraction(str(v)) for k, v in weights.items() if v is not None and math.isfinite(v) and v > 0}
    scale = math.lcm(*(v.denominator for v in named.values()))
    exact = {k: int(v * scale) for k, v in named.items()}
    common = math.gcd(*exact.values())
    return {k: v // common for k, v in exact.items()} if sum(exact.values()) <= UNIT * common else {k: float(v) for k, v in named.items()}


def weighted(counts: DataFrame, weights: dict | None, alpha: float) -> DataFrame:
    """``_src``, ``_n``, ``_a`` (integer weight), ``total`` of the sources that have a weight."""
    if weights is None:
        w = F.pow(F.col("_n").cast("double"), F.lit(float(alpha)))
    else:
        w = F.from_json(F.lit(json.dumps(whole_weights(weights))), "map<string,double>")[F.col("_src")]
    found = counts.withColumn("_w", w).filter("_w > 0")
    whole = found.crossJoin(F.broadcast(found.agg(F.sum("_w").alias("_all"), F.max(F.expr("_w != floor(_w)")).alias("_broken"))))  # one row
    share = f"greatest(1L, cast(round(_w / _all * {UNIT}) as bigint))"
    whole = whole.withColumn("_a", F.expr(f"if(_broken or _all > {UNIT}, {share}, cast(_w as bigint))")).drop("_w", "_all", "_broken")
    return whole.crossJoin(F.broadcast(whole.agg(F.sum("_a").alias("total"))))  # one row


def schedule(sources: DataFrame, block_rows: int, max_blocks: int) -> DataFrame:
    """``_src``, ``_n``, ``_a``, ``_rows`` (of a block), ``_slot``, ``_block`` of the slots up to the last block that is needed, given ``weighted`` sources.

    Blocks have ``block_rows`` rows, or so many times as many that there are about ``max_blocks`` slots at most.
    """
    due = "(((_n + {0} - 1) div {0}) * total + _a - 1) div _a"
    length = sources.withColumn("_due", F.expr(due.format(f"{block_rows}L")))
    one = length.agg(F.max("_due").alias("_due"), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("_src", "_n", "_a"))).alias("_sources"))  # one entry a source
    one = one.filter("size(_sources) > 0").withColumn("_rows", F.expr(f"{block_rows}L * ((_due + {max_blocks}L - 1) div {max_blocks}L)"))
    one = one.withColumn("_end", F.expr(f"array_max(transform(_sources, s -> {due.format('_rows').replace('_n', 's._n').replace('_a', 's._a')}))"))
    one = one.withColumn("_first", F.expr(f"transform(_sources, s -> {block_of('s._a', '0L')})"))
    after = f"aggregate({slots_of('k')}, acc.now, (state, t) -> {let('p', earliest('state', 't'), taken('state', 'p'))})"
    grown = let("now", after, "named_struct('now', now, 'all', concat(acc.all, array(now)))")
    states = f"aggregate(sequence(0L, (_end - 1) div {WINDOW}L), named_struct('now', _first, 'all', array(_first)), (acc, k) -> {grown}).all"
    windows = one.select("total", "_rows", "_sources", F.posexplode(F.expr(states)).alias("_k", "_now")).filter(F.col("_k") * WINDOW < F.col("_end"))
    windows = stage(windows, "mix-windows").repartition("_k")
    took = let("p", earliest("acc.now", "t"), f"named_struct('now', {taken('acc.now', 'p')}, 'out', concat(acc.out, array(named_struct('i', p, 'j', acc.now[p].j))))")
    none = "cast(array() as array<struct<i: int, j: bigint>>)"
    out = f"aggregate({slots_of('_k')}, named_struct('now', _now, 'out', {none}), (acc, t) -> {took}).out"
    slots = windows.select("_k", "_rows", "_sources", F.expr(out).alias("_out")).select("_k", "_rows", "_sources", F.posexplode("_out").alias("_p", "_o"))
    slots = slots.select(F.expr(f"_k * {WINDOW}L + _p").alias("_slot"), F.expr("_o.j").alias("_block"), "_rows", *(F.expr(f"_sources[_o.i].{c}").alias(c) for c in ("_src", "_n", "_a")))
    return stage(slots, "mix-slots")


def mix(docs: DataFrame, weights: dict | None = None, alpha: float = 0.9, source_col: str = "source", id_col: str = "doc_id", block_rows: int = 8, max_blocks: int = 1 << 20, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` in the mix, with ``_source``, ``_epoch``, ``_block``, ``_slot`` and ``_position``.

    ``weights`` gives each source's target weight (sources not named, or with
    a weight that is null, not finite or not positive, stay out); by default a
    source of n rows weighs n ** ``alpha``. The mix is the shortest that holds
    every row of every weighted source at least once: a source that is used up
    before begins another epoch, in the same order. In the first t slots, any
    t, a source of weight w has less than one block more or less than t * w.

    Blocks are ``block_rows`` rows, in order of the id's md5 (equal ones in any
    order); of a mix of over ``max_blocks`` such blocks they are longer by a
    whole factor, so that the schedule stays of about that length. Its work is
    slots times sources; one row a source and the slots are broadcast.

    A null source is a source of its own; repeated rows and null ids each
    count; an empty table gives an empty mix. ``keep`` names the columns to
    carry (all by default); only they are shuffled. A column of ``docs`` named
    like one of this function's (``_source``, ``_n``, ...) is carried as it is
    if ``keep`` leaves it out, else it is an error to have ``_source``,
    ``_epoch``, ``_block``, ``_slot`` or ``_position`` among the columns.
    Within a source, rows are ranked in (source, hash bucket) groups whose
    number grows with the table, so a source with most rows is spread over
    all tasks.
    """
    spark = docs.sparkSession
    names = docs.columns if keep is None else keep
    if clash := {c.lower() for c in names} & {"_source", "_epoch", "_block", "_slot", "_position"}:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    src = F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.struct(*(F.col(c) for c in names)).alias("_row") if names else F.lit(0).alias("_row"), src.alias("_src"), order.alias("_h"))
    ids = docs.select(src.alias("_src"), order.alias("_h"))
    total = docs.count()
    digits = 1  # hex digits of the hash that form a bucket, of about 10,000 rows of the largest source
    while total > 10_000 * 16**digits and digits < 6:
        digits += 1
    bucket = F.substring("_h", 1, digits)
    sizes = stage(ids.groupBy("_src", bucket.alias("_b")).agg(F.count("*").alias("_n")), "mix-sizes")
    slots = schedule(weighted(sizes.groupBy("_src").agg(F.sum("_n").alias("_n")), weights, alpha), block_rows, max_blocks)
    # the mix ends with the last block that a source needs
    length = slots.filter("_block = (_n - 1) div _rows").agg(F.max("_slot").alias("_last"))
    used = slots.crossJoin(F.broadcast(length)).filter("_slot <= _last")  # one row
    by_source = used.groupBy("_src").agg(F.max("_n").alias("_n"), F.max("_rows").alias("_rows"), F.count("*").alias("_blocks"))
    plan = stage(by_source, "mix-plan")  # one row a source
    chunks = used.groupBy(F.col("_src").alias("_of"), F.expr(f"_block div {CHUNK}L").alias("_chunk"))
    chunks = stage(chunks.agg(F.sort_array(F.collect_list(F.struct("_block", "_slot"))).alias("_s")).select("_of", "_chunk", F.expr("transform(_s, x -> x._slot)").alias("_slots")), "mix-chunks")
    free(spark, slots)
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_src").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # over at most 16 ** digits buckets
    base = sizes.select("_src", "_b", before.alias("_before"))
    ranked = rows.withColumn("_b", bucket).withColumn("_r", F.row_number().over(W.partitionBy("_src", "_b").orderBy("_h")))
    place = ranked.join(base, ["_src", "_b"]).join(F.broadcast(plan), "_src")
    placed = place.withColumn("_i", F.col("_before") + F.col("_r") - 1)
    placed = placed.withColumn("_epoch", F.explode(F.expr("sequence(0L, greatest(0L, (_blocks * _rows - _i + _n - 1) div _n - 1))")))
    placed = placed.withColumn("_at", F.expr("_epoch * _n + _i")).withColumn("_block", F.expr("_at div _rows")).withColumn("_c", F.expr(f"_block div {CHUNK}L"))
    placed = placed.join(F.broadcast(chunks), F.expr("_src = _of and _c = _chunk")).withColumn("_slot", F.expr(f"_slots[cast(_block % {CHUNK} as int)]"))
    return placed.select(*(F.col("_row")[c].alias(c) for c in names), F.expr(f"nullif(_src, '{NO_SOURCE}')").alias("_source"), "_epoch", "_block", "_slot", F.expr("_slot * _rows + _at % _rows").alias("_position"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", F.col("_source").alias("source"), F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_position").alias("position"))
