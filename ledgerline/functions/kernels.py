"""Array kernels on vectors: quantization, outliers, smoothing, retention and byte models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.operators.ranks import range_rank
from ledgerline.sources.scratch import fresh, staged


def quantize_groups(x: Column, bits: int, group: int) -> Column:
    """Group-wise asymmetric quantize and dequantize: groups padded with zeros that count in the range, half to even."""
    levels = 2**bits - 1
    padded = lambda g: F.concat(g, F.array_repeat(F.lit(0.0), F.lit(group) - F.size(g)))

    def one(g: Column) -> Column:
        low, high = F.array_min(padded(g)), F.array_max(padded(g))
        scale = F.greatest(high - low, F.lit(1e-8)) / levels
        return F.transform(g, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(float(levels)), F.rint((v - low) / scale))) * scale + low)

    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / group).cast("int") - 1), lambda i: F.slice(x, i * group + 1, F.lit(group)))
    return F.flatten(F.transform(parts, one))


def _dequantized(g: Column, levels: Column) -> Column:
    """Elements (v, m) of one range quantized and dequantized; the masked ones (m) stay and are not in the range."""
    kept = F.transform(F.filter(g, lambda e: ~e["m"]), lambda e: e["v"])
    low, high = F.coalesce(F.array_min(kept), F.lit(0.0)), F.coalesce(F.array_max(kept), F.lit(0.0))
    one = F.array(F.struct(low.alias("low"), (F.greatest(high - low, F.lit(1e-8)) / levels).alias("scale")))  # made once, not for every element
    value = lambda e, r: F.when(e["m"], e["v"]).otherwise(F.greatest(F.lit(0.0), F.least(levels, F.rint((e["v"] - r["low"]) / r["scale"]))) * r["scale"] + r["low"])
    return F.get(F.transform(one, lambda r: F.transform(g, lambda e: value(e, r))), F.lit(0))


def _masked(x: Column, mask: Column | None) -> Column:
    mask = F.transform(x, lambda v: F.lit(False)) if mask is None else mask
    return F.zip_with(x, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m")))


def quantize_masked(x: Column, mask: Column, bits: int, group: int) -> Column:
    """Dequantized vector by groups. Outliers stay and, like padding, are not in the range."""
    pairs, levels = _masked(x, mask), F.lit(float(2**bits - 1))
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / group).cast("int") - 1), lambda i: F.slice(pairs, i * group + 1, F.lit(group)))
    return F.flatten(F.transform(parts, lambda g: _dequantized(g, levels)))


def tail_outliers(x: Column, fraction: float) -> Column:
    """Mask of what lies beyond the vector's order statistics at half of ``fraction`` from either end; short vectors have none."""
    n = F.size(x)
    low = F.greatest(F.lit(1), F.ceil(fraction / 2 * n)).cast("int")
    high = F.least(n, F.greatest(low + 1, F.least(n, F.floor((1 - fraction / 2) * n).cast("int"))))
    none = F.transform(x, lambda v: F.lit(False))
    return none if fraction <= 0 else F.when(n <= 2, none).otherwise(kth_outliers(x, low, high))


def outlier_ranks(values: DataFrame, fraction: float, tensor: str, value: str, *ties: str) -> DataFrame:
    """``outlier``: whether a value is among the round(n * fraction) largest magnitudes of its tensor; ties by position. Ranked by value ranges."""
    ranked = range_rank(values, [tensor], -F.abs(F.col(value)), *ties)
    return ranked.withColumn("outlier", F.col("_rank") <= F.rint(F.col("_all") * fraction)).drop("_rank", "_all")


def kth_outliers(x: Column, low: int | Column, high: int | Column) -> Column:
    """Mask of values below the low-th or above the high-th smallest of the vector."""
    s = F.sort_array(x)
    ends = F.array(F.struct(F.element_at(s, low).alias("a"), F.element_at(s, high).alias("b")))  # found once
    return F.get(F.transform(ends, lambda e: F.transform(x, lambda v: (v < e["a"]) | (v > e["b"]))), F.lit(0))


def packed_bytes(n: Column, bits: int, group: int, outliers: Column | None = None) -> Column:
    """Bits of the values kept, four bytes of scale and zero a group, six bytes an outlier."""
    kept = n if outliers is None else n - outliers
    size = kept * bits / 8 + F.ceil(n / group) * 4
    return size if outliers is None else size + outliers * 6


def window_sum(scores: DataFrame, last: int, *by: str) -> DataFrame:
    """Sum of the last ``last`` query rows per position."""
    top = F.max("q").over(W.partitionBy(*by))
    return scores.withColumn("_top", top).filter(F.col("q") > F.col("_top") - last).groupBy(*by, "pos").agg(F.sum("score").alias("score"))


def smooth(scores: DataFrame, width: int, *by: str, value: str = "score") -> DataFrame:
    """Average pool of odd ``width``; zero padding at the ends counts in the divisor."""
    half = width // 2
    return scores.withColumn("smoothed", F.sum(value).over(W.partitionBy(*by).orderBy("pos").rowsBetween(-half, half)) / width)


def retain(scores: DataFrame, recent: int, top: int, *by: str, value: str = "score") -> DataFrame:
    """The last ``recent`` positions and the ``top`` best of those before; ties to the earlier position."""
    w = W.partitionBy(*by)
    rows = scores.withColumn("_n", F.max("pos").over(w) + 1).withColumn("_recent", F.col("pos") >= F.col("_n") - recent)
    rank = F.row_number().over(W.partitionBy(*by, "_recent").orderBy(F.desc(value), "pos"))
    return rows.withColumn("_r", rank).filter("_recent or _r <= " + str(top)).drop("_n", "_recent", "_r")


def layer_budgets(scores: DataFrame, k: int, group: str, layer: str = "layer", value: str = "score") -> DataFrame:
    """How many of a group's k best scores over all layers lie in each layer, zeros filled in. Ranked by value ranges."""
    ranked = range_rank(scores, [group], -F.col(value), layer, "pos")
    return ranked.groupBy(group, layer).agg(F.count_if(F.col("_rank") <= k).alias("budget"))


def reallocate(scores: DataFrame, base: int, ratio_max: float, group: str, prefix_cap: int | None = None) -> DataFrame:
    """Prefix budgets of the layers: ``base`` a layer in all, dealt by how many of the best base * heads * layers scores lie in each.

    Rows are (group, layer, head, pos, score). A layer gets at most
    ratio_max * base, its prefix's length, and ``prefix_cap`` (models with a
    sliding window). Layers are a few dozen; only their counts meet in one task.
    """
    layers = scores.groupBy(group, "layer").agg(F.countDistinct("head").alias("heads"), F.countDistinct("pos").alias("length"), F.count("*").alias("entries"))
    per = layers.groupBy(group).agg(F.max("heads").alias("heads"), F.count("*").alias("layers"), F.sum("entries").alias("entries"))
    k = F.least(F.lit(base) * F.col("heads") * F.col("layers"), F.col("entries"))
    best = scores.join(F.broadcast(per.select(group, k.alias("_k"))), group)  # one row a group
    won = range_rank(best, [group], -F.col("score"), "layer", "head", "pos").filter(F.col("_rank") <= F.col("_k")).groupBy(group, "layer").agg(F.count("*").alias("weight"))
    hard = int(ratio_max * base) if prefix_cap is None else min(int(ratio_max * base), prefix_cap)
    rows = layers.join(won, [group, "layer"], "left").join(F.broadcast(per.select(group, "layers")), group)
    rows = rows.select(group, F.col("layer").alias("item"), F.coalesce("weight", F.lit(0)).cast("double").alias("weight"), F.least(F.lit(hard), F.col("length")).alias("cap"), (F.lit(base) * F.col("layers")).alias("total"))
    return allocate(rows, group, "total").select(group, F.col("item").alias("layer"), F.col("share").alias("budget"))


def water_fill(total: int, weights: list[float], caps: list[int]) -> list[int]:
    """Whole shares of ``total`` in proportion to weights, none above its cap; what caps leave over is dealt again.

    Leftovers smaller than a share go to the largest fractional claims in
    order; without positive weights the shares are even. A negative weight
    counts as none.
    """
    weights, out = [max(w, 0.0) for w in weights], [0] * len(weights)
    rest = min(total, sum(caps))
    while rest > 0:
        open_ = [i for i in range(len(out)) if out[i] < caps[i]]
        w = sum(weights[i] for i in open_)
        claims = {i: rest * (weights[i] / w if w > 0 else 1 / len(open_)) for i in open_}
        given = {i: min(int(claims[i]), caps[i] - out[i]) for i in open_}
        if not any(given.values()):
            for i in sorted(open_, key=lambda i: -claims[i])[:rest]:
                out[i] += 1
                rest -= 1
            continue
        for i, n in given.items():
            out[i] += n
            rest -= n
    return out


def allocate(rows: DataFrame, group: str, total: str) -> DataFrame:
    """``water_fill`` in every group of rows (group, item, weight, cap, total), as (group, ``item``, ``share``); groups of any number and size.

    All groups go through a round together: weights of open items are summed,
    claims follow from the sums, and what was given is summed again. A round is
    written before the next, and holds only groups with something left to deal.
    Each round fills an item's cap or leaves less than one unit an open item, so they are few.
    A null or negative weight counts as none, a null cap as 0; a null group is a group.
    """
    spark = rows.sparkSession
    column = lambda name, kind: F.greatest(F.coalesce(F.col(name).cast(kind), F.lit(0).cast(kind)), F.lit(0).cast(kind))
    state = rows.select(group, F.col("item").cast("long").alias("item"), column("weight", "double").alias("weight"), column("cap", "long").alias("cap"), column(total, "long").alias("_total"), F.lit(0).cast("long").alias("share"))
    caps = state.groupBy(group).agg(F.least(F.max("_total"), F.sum("cap")).alias("rest"))
    state = _of_group(state, caps, group).drop("_total")
    plain = [group, "item", "weight", "cap", "share", "rest"]
    done, round_ = [], staged(state, fresh(spark, "shares"))
    while True:
        done.append(round_.filter("rest = 0").select(group, "item", "share"))
        left = round_.filter("rest > 0")
        open_ = F.col("share") < F.col("cap")
        sums = left.groupBy(group).agg(F.coalesce(F.sum(F.when(open_, F.col("weight"))), F.lit(0.0)).alias("_w"), F.count_if(open_).alias("_n"))
        claim = F.when(open_, F.col("rest") * F.when(F.col("_w") > 0, F.col("weight") / F.col("_w")).otherwise(1 / F.col("_n")))
        claims = _of_group(left, sums, group).withColumn("_claim", claim)
        given = F.coalesce(F.least(F.floor("_claim"), F.col("cap") - F.col("share")), F.lit(0))
        dealt = staged(claims.withColumn("_given", given).drop("_w", "_n"), fresh(spark, "shares-dealt"))
        took = dealt.groupBy(group).agg(F.sum("_given").alias("_took"))
        after = _of_group(dealt, took, group)
        last = range_rank(after.filter("_took = 0"), [group], -F.coalesce("_claim", F.lit(-1.0)), "item")  # items that are full claim nothing
        done.append(last.select(group, "item", (F.col("share") + ((F.col("_rank") <= F.col("rest")) & F.col("_claim").isNotNull()).cast("long")).alias("share")))
        more = after.filter("_took > 0").withColumn("share", F.col("share") + F.col("_given")).withColumn("rest", F.col("rest") - F.col("_took")).select(*plain)
        if took.filter("_took > 0").isEmpty():
            return reduce(DataFrame.unionByName, done)
        round_ = staged(more, fresh(spark, "shares"))


def _of_group(rows: DataFrame, sums: DataFrame, group: str) -> DataFrame:
    """``rows`` with their group's ``sums``; a null group is a group, and the join's kind is left to the sizes found at run time."""
    return rows.join(sums.withColumnRenamed(group, "_of"), F.col(group).eqNullSafe(F.col("_of"))).drop("_of")


def head_votes(scores: DataFrame, group: str, target: int) -> DataFrame:
    """Positions by votes: each head picks its budget's best positions, a position's votes are the scores of the heads that picked it.

    Rows are (group, head, pos, score, budget). The ``target`` positions with most votes stay; those without votes are still candidates.
    """
    rank = F.row_number().over(W.partitionBy(group, "head").orderBy(F.desc("score"), "pos"))
    votes = scores.withColumn("_r", rank).groupBy(group, "pos").agg(F.sum(F.when(F.col("_r") <= F.col("budget"), F.col("score")).otherwise(0.0)).alias("votes"))
    best = F.row_number().over(W.partitionBy(group).orderBy(F.desc("votes"), "pos"))
    return votes.withColumn("_r", best).filter(F.col("_r") <= target).drop("_r")


def keep_positions(scores: DataFrame, group: str, target: int, window: int) -> DataFrame:
    """Positions that a layer keeps for all heads: the recent ``window`` and, up to ``target``, those before it with most votes.

    Rows are (group, head, pos, score) of key-value heads. A head's budget
    before the window is its part, by the sum of its best scores there, of what
    all heads have in all; its votes are as in ``head_votes``. Groups of at
    most ``target`` positions keep all.
    """
    sizes = scores.groupBy(group).agg((F.max("pos") + 1).alias("_s"), F.countDistinct("head").alias("_h"))  # one row a group
    rows = scores.join(F.broadcast(sizes), group)
    recent, avail = F.least(F.lit(window), F.col("_s")), F.col("_s") - F.least(F.lit(window), F.col("_s"))
    every = rows.filter((F.col("_s") <= target) | (F.col("pos") >= F.col("_s") - recent)).select(group, "pos").distinct()
    before = rows.filter((F.col("_s") > target) & (F.col("pos") < F.col("_s") - recent)).withColumn("_avail", avail).withColumn("_recent", recent)
    before = before.withColumn("_r", F.row_number().over(W.partitionBy(group, "head").orderBy(F.desc("score"), "pos")))
    heads = before.groupBy(group, "head").agg(F.greatest(F.sum(F.when(F.col("_r") <= F.least(F.lit(target), F.col("_avail")), F.col("score"))), F.lit(1e-6)).alias("_c"), F.first("_avail").alias("_a"), F.first("_recent").alias("_n"), F.first("_h").alias("_heads"))
    share = F.col("_c") / F.sum("_c").over(W.partitionBy(group))  # one row a head
    total = F.greatest(F.lit(0), F.lit(target) * F.col("_heads") - F.col("_heads") * F.col("_n"))
    heads = heads.select(group, "head", F.greatest(F.lit(0), F.least(F.col("_a"), F.rint(share * total).cast("int"))).alias("budget"))
    votes = before.join(heads, [group, "head"]).groupBy(group, "pos").agg(F.sum(F.when(F.col("_r") <= F.col("budget"), F.col("score")).otherwise(0.0)).alias("votes"), F.first("_recent").alias("_n"))
    best = F.row_number().over(W.partitionBy(group).orderBy(F.desc("votes"), "pos"))
    return every.unionByName(votes.withColumn("_b", best).filter(F.col("_b") <= target - F.col("_n")).select(group, "pos"))


def value_bits(span: Column, tokens: Column, error: float, attention: Column) -> Column:
    """Bits for a value vector of the given range under an attention-weighted error."""
    step = 2 * F.sqrt(F.lit(12.0) / tokens) * error / F.greatest(attention, F.lit(1e-6))
    return F.least(F.lit(16), F.greatest(F.lit(2), F.ceil(F.log2(span / step + 1)))).cast("int")


def key_bits(span: Column, tokens: Column, error: float, q_norm: Column) -> Column:
    """Bits for a key vector from the query norm; the allowed deviation grows as sqrt(T^3 / (T - 1))."""
    sigma = error * F.sqrt(F.pow(tokens, 3) / (tokens - 1)) / F.greatest(q_norm, F.lit(1e-6))
    return F.least(F.lit(16), F.greatest(F.lit(2), F.ceil(F.log2(span / (2 * F.sqrt(F.lit(3.0)) * sigma) + 1)))).cast("int")


def apply_bits(x: Column, bits: Column, mask: Column | None = None) -> Column:
    """Each vector quantized and dequantized in one range with its own number of bits; masked values stay."""
    return _dequantized(_masked(x, mask), F.pow(F.lit(2.0), bits) - 1)


def effective_bits(average: Column, width: int) -> Column:
    """Stored bits an element, all metadata included: one outlier a vector of ``width`` (16-bit value, 32-bit index), 16-bit scale and zero, a 4-bit width."""
    share = 1.0 / width
    return (1 - share) * average + share * (16 + 32) + (2 * 16 + 4) / width


def effective_bytes(vectors: Column, average: Column, width: int) -> Column:
    return F.when(vectors == 0, 0.0).otherwise(vectors * width * effective_bits(average, width) / 8)


def held_bytes(charged: Column, held: Column, tokens: Column) -> Column:
    """Bytes charged for all tokens, scaled to those that a sliding-window model holds."""
    return charged * held / tokens


def rolling_max(rows: DataFrame, steps: int, *by: str, value: str = "score") -> DataFrame:
    """Element-wise maximum over the last ``steps`` decode steps; positions not there yet count zero."""
    w = W.partitionBy(*by, "pos").orderBy("step").rangeBetween(-(steps - 1), 0)
    return rows.withColumn("rolling", F.greatest(F.max(value).over(w), F.when(F.count("*").over(w) < F.least(F.lit(steps), F.col("step") + 1), 0.0)))


def calibrated(rows: DataFrame, value: str, share: float, floor: float, *by: str) -> DataFrame:
    """The value at sorted index int(n * share), not interpolated, at least ``floor``. Ranked by value ranges."""
    ranked = range_rank(rows.select(*by, value), list(by), F.col(value))
    return ranked.filter(F.col("_rank") - 1 == F.floor(F.col("_all") * share)).select(*by, F.greatest(F.col(value), F.lit(floor)).alias("threshold"))


def head_groups(rows: DataFrame, per: int, *by: str, value: str = "score") -> DataFrame:
    """Mean over the query heads that share a key-value head."""
    return rows.groupBy(*by, F.floor(F.col("head") / per).alias("kv_head")).agg(F.avg(value).alias(value))


def greedy_token(logits: Column, stops: Column, generated: Column, minimum: int) -> Column:
    """Index of the largest logit, the first of equals; stop ids are out until ``minimum`` tokens are there."""
    allowed = F.transform(logits, lambda v, i: F.when((generated < minimum) & F.array_contains(stops, i), F.lit(float("-inf"))).otherwise(v))
    return (F.array_position(allowed, F.array_max(allowed)) - 1).cast("int")


def perplexity(nll: Column, count: Column) -> Column:
    return F.exp(F.sum(nll) / F.sum(count))
