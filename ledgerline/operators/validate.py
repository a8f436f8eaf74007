"""Coverage, agreement and contract checks, and the journal's state machine.

Checks return the offending rows; ``require_none`` turns any into an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def require_none(violations: DataFrame, what: str) -> None:
    first = violations.limit(3).collect()
    if first:
        raise ValueError(f"{what}: {[r.asDict() for r in first]}")


def pivot_join(records: DataFrame, value: str, configurations: list[str], strict: bool = False, order: str | None = None) -> DataFrame:
    """One row per item with a column per configuration. Incomplete items go, or (``strict``) raise.

    Of repeated records the last by ``order`` counts; without an order they raise if ``strict``, and any (the largest) counts otherwise.
    """
    if strict and order is None:
        require_none(repeated_keys(records, "task", "key", "configuration"), "repeated records")
    pick = F.max_by(value, order) if order else F.max(value)
    wide = records.groupBy("task", "key").pivot("configuration", configurations).agg(pick)
    missing = F.lit(False)
    for c in configurations:
        missing = missing | F.col(c).isNull()
    if strict:
        require_none(wide.filter(missing).select("task", "key"), "items without every configuration")
    return wide.filter(~missing)


def incomplete(records: DataFrame, configurations: list[str]) -> DataFrame:
    """Per task how many items lack a configuration, and how many are complete."""
    per = records.filter(F.col("configuration").isin(configurations)).groupBy("task", "key").agg(F.countDistinct("configuration").alias("n"))
    return per.groupBy("task").agg(F.count_if(F.col("n") < len(configurations)).alias("dropped"), F.count_if(F.col("n") == len(configurations)).alias("kept"))


def coverage(records: DataFrame, authority: DataFrame, configurations: list[str]) -> DataFrame:
    """What keeps records from being exactly the authority's keys times the configurations: rows (task, key, configuration, problem).

    ``problem`` is missing, unexpected or repeated. The keys come from the
    authority alone, never from one of the configurations.
    """
    expected = authority.select("task", "key").distinct().withColumn("configuration", F.explode(F.array(*map(F.lit, configurations)))).withColumn("_e", F.lit(True))
    found = records.groupBy("task", "key", "configuration").agg(F.count("*").alias("_n"))
    both = expected.join(found, ["task", "key", "configuration"], "full_outer")
    problem = F.when(F.col("_e").isNull(), "unexpected").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated")
    return both.select("task", "key", "configuration", problem.alias("problem")).filter("problem is not null")


def strict_join(records: DataFrame, authority: DataFrame, value: str, configurations: list[str], shared: tuple[str, ...] = ()) -> DataFrame:
    """The wide table of exactly the authority's items; anything missing, unexpected, repeated or (``shared`` fields) differing among configurations raises."""
    require_none(coverage(records, authority, configurations), "records and the prepared keys differ")
    if shared:
        text = F.to_json(F.struct(*(F.col(f) for f in sorted(shared))), {"ignoreNullFields": "false"})
        require_none(disagreeing(records, text, len(configurations), "task", "key"), f"{', '.join(shared)} differ among configurations")
    return records.groupBy("task", "key").pivot("configuration", configurations).agg(F.first(value))


def pilot_markers(events: DataFrame) -> DataFrame:
    """Events that carry pilot-only fields, at the top or in their method's metadata; a canonical journal has none."""
    marked = F.lit(False)
    if "pilot_profile" in events.columns:
        marked = marked | F.col("pilot_profile").isNotNull()
    if "method_metadata" in events.columns:
        kind = events.schema["method_metadata"].dataType
        for name in ("pilot_profile", "cuda_feasibility"):
            if hasattr(kind, "fieldNames") and name in kind.fieldNames():
                marked = marked | F.col(f"method_metadata.{name}").isNotNull()
            elif not hasattr(kind, "fieldNames"):
                marked = marked | F.get_json_object("method_metadata", f"$.{name}").isNotNull()
    return events.filter(marked)


def canonical(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows in the canonical order: the registry's tasks, then source index, then key. Range-partitioned; unknown tasks raise."""
    known = rows.join(F.broadcast(registry.select("task", "task_ord")), "task", "left")  # one row a task
    place = F.when(F.col("task_ord").isNull(), F.raise_error(F.concat(F.lit("unknown task "), F.col("task"))).cast("int")).otherwise(F.col("task_ord"))
    return known.withColumn("task_ord", place).orderBy("task_ord", "source_index", "key").drop("task_ord")


def lookup(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Each row with what the registry has of its task; a task that it lacks raises before any row is returned."""
    unknown = rows.select("task").distinct().join(F.broadcast(registry), "task", "left_anti")  # one row a task
    require_none(unknown, "tasks that the registry lacks")
    return rows.join(F.broadcast(registry), "task")


def index_violations(index: DataFrame, registry: DataFrame, cap: int) -> DataFrame:
    """What a prepared index breaks, as (``rule``, ``task``, ``n``): a place or an id of a task taken twice, a task whose places are not 0 to its expected count, unknown tasks, and truncation marks that the length before truncation belies.

    ``index``: ``task``, ``source_index``, ``key``, ``original_tokens``, ``token_count``, ``truncated``; ``registry``: ``task``, ``expected``.
    """
    taken = [index.groupBy("task", c).agg(F.count("*").alias("_c")).filter("_c > 1").groupBy("task").agg(F.count("*").alias("n")).withColumn("rule", F.lit(rule)) for c, rule in (("source_index", "repeated place"), ("key", "repeated id"))]
    counts = index.groupBy("task").agg(F.count("*").alias("_c"), F.min("source_index").alias("_low"), F.max("source_index").alias("_high"))
    both = counts.join(F.broadcast(registry.select("task", "expected")), "task", "full")
    whole = (F.col("_c") == F.col("expected")) & (F.col("_low") == 0) & (F.col("_high") == F.col("expected") - 1)
    panel = both.filter(F.col("expected").isNull() | ~F.coalesce(whole, F.lit(False))).select("task", F.coalesce("_c", F.lit(0)).alias("n"), F.when(F.col("expected").isNull(), "unknown task").otherwise("incomplete task").alias("rule"))
    right = (F.col("truncated") == (F.col("original_tokens") > cap)) & (F.col("token_count") == F.least("original_tokens", F.lit(cap)))
    marks = index.filter(~F.coalesce(right, F.lit(False))).groupBy("task").agg(F.count("*").alias("n")).withColumn("rule", F.lit("truncation"))
    return taken[0].unionByName(taken[1]).unionByName(panel).unionByName(marks).select("rule", "task", "n")


def identity_differences(found: dict, expected: dict, path: str = "") -> list[str]:
    """Dotted names of what two provenance documents (manifest, environment, run identity, hashes) do not agree in; empty if all is equal."""
    out = []
    for k in sorted(found.keys() | expected.keys()):
        name, a, b = f"{path}{k}", found.get(k), expected.get(k)
        if isinstance(a, dict) and isinstance(b, dict):
            out += identity_differences(a, b, f"{name}.")
        elif a != b or (k in found) != (k in expected) or type(a) is not type(b):
            out.append(name)
    return out


def require_identity(found: dict, expected: dict, what: str) -> None:
    """Raises where a provenance document is not what is expected; meant to be called before and after the work."""
    if differ := identity_differences(found, expected):
        raise ValueError(f"{what}: {', '.join(differ)} differ")


def last_wins(records: DataFrame, order: str, *by: str) -> DataFrame:
    """The latest of repeated records of a key (any of those that tie); aggregated before the shuffle."""
    rest = [c for c in records.columns if c not in by]
    last = records.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("_last"))
    return last.select(*(F.col(c) if c in by else F.col("_last")[c].alias(c) for c in records.columns))


def unexpected(records: DataFrame, expected: DataFrame, *on: str) -> DataFrame:
    return records.join(expected, list(on), "left_anti")


def missing(records: DataFrame, expected: DataFrame, failed: DataFrame, *on: str) -> DataFrame:
    """Expected keys not there, with ``state``: failed or absent."""
    gone = expected.join(records, list(on), "left_anti")
    return gone.join(failed.select(*on).distinct().withColumn("_f", F.lit(True)), list(on), "left").select(*on, F.when(F.col("_f"), "failed").otherwise("absent").alias("state"))


def disagreeing(records: DataFrame, value: Column, configurations: int, *by: str) -> DataFrame:
    """Keys whose value differs among configurations; a value missing in some only is a difference too."""
    v = F.count(value)
    return records.groupBy(*by).agg(F.countDistinct(value).alias("values"), v.alias("present"), F.count("*").alias("rows")).filter((F.col("values") > 1) | (F.col("present") != F.col("rows")) & (F.col("present") > 0) | (F.col("rows") != configurations))


def field_differences(left: DataFrame, right: DataFrame, on: list[str], fields: list[str]) -> DataFrame:
    """Null-safe comparison of fields: one row per differing key with the names of the differing fields."""
    r = right.select(*on, *(F.col(f).alias(f"_{f}") for f in fields))
    differs = F.filter(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    return left.join(r, on).select(*on, differs.alias("fields")).filter(F.size("fields") > 0)


def _prints(seed: int, names: list[str]) -> Column:
    return F.sum(F.xxhash64(F.lit(seed), *names).cast("decimal(38,0)"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows, as often, in any order: by counts and sums of two 64-bit hashes, one aggregation of either table and no shuffle of rows."""
    if sorted(a.dtypes) != sorted(b.dtypes):
        return False
    names = sorted(a.columns)
    return a.agg(F.count("*"), _prints(1, names), _prints(2, names)).first() == b.agg(F.count("*"), _prints(1, names), _prints(2, names)).first()


def ordered_differences(a: DataFrame, b: DataFrame, place: str, block: int = 4096) -> DataFrame:
    """(``place``, ``problem``) where two tables in order differ: ``changed``, ``missing`` (of ``a`` alone) or ``unexpected``.

    ``place`` numbers the rows (no row has a null place, and none is taken twice). Blocks of places
    are compared by their hashes first, and only rows of blocks that differ are joined, so equal tables cost one aggregation each.
    """
    names = sorted(c for c in a.columns if c != place)
    at = F.floor(F.col(place) / block)
    blocks = lambda t: t.groupBy(at.alias("_block")).agg(F.count("*").alias("n"), _prints(1, [place, *names]).alias("x"), _prints(2, [place, *names]).alias("y"))
    left, right = blocks(a).select("_block", F.struct("n", "x", "y").alias("l")), blocks(b).select("_block", F.struct("n", "x", "y").alias("r"))
    differ = left.join(right, "_block", "full").filter(~F.col("l").eqNullSafe(F.col("r"))).select("_block")
    rows = lambda t, name: t.withColumn("_block", at).join(differ, "_block", "left_semi").select(F.col(place), F.struct(*names).alias(name))
    both = rows(a, "l").join(rows(b, "r"), place, "full")
    problem = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "unexpected").when(~F.col("l").eqNullSafe(F.col("r")), "changed")
    return both.select(F.col(place).alias("place"), problem.alias("problem")).filter("problem is not null")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def value_violations(records: DataFrame, rel: float = 1e-6, absolute: float = 5e-5) -> DataFrame:
    """Rules of one configuration's values: ranges, the ratio's identity within tolerance, and the baseline's ratio of one."""
    ratio = F.col("kv_bytes_fp16") / F.col("kv_bytes")
    near = F.abs(F.col("compression") - ratio) <= F.greatest(rel * F.greatest(F.abs("compression"), F.abs(ratio)), F.lit(absolute))
    rules = {
        "score": finite(F.col("score")) & F.col("score").between(0, 1),
        "bytes": finite(F.col("kv_bytes")) & (F.col("kv_bytes") > 0) & finite(F.col("kv_bytes_fp16")) & (F.col("kv_bytes_fp16") > 0),
        "compression": finite(F.col("compression")) & (F.col("compression") > 0) & near,
        "baseline": (F.col("cfg_ord") != 0) | (F.col("compression") == 1.0),
    }
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return records.withColumn("broken", broken).filter(F.size("broken") > 0)


def panel_violations(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Tasks whose items are not exactly the registry's count with indexes 0..n-1, each once; unknown and absent tasks too."""
    found = items.groupBy("task").agg(F.count("*").alias("n"), F.countDistinct("source_index").alias("distinct"), F.min("source_index").alias("low"), F.max("source_index").alias("high"))
    both = found.join(F.broadcast(registry.select("task", "expected")), "task", "full_outer")  # one row a task
    ok = (F.col("n") == F.col("expected")) & (F.col("distinct") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)
    return both.filter(~F.coalesce(ok, F.lit(False)))


def repeated_keys(rows: DataFrame, *on: str) -> DataFrame:
    return rows.groupBy(*on).agg(F.count("*").alias("n")).filter("n > 1")


def feature_violations(rows: DataFrame, ints: list[str], doubles: list[str], unit: list[str]) -> DataFrame:
    """Rows whose features are out of range: counts not negative, doubles finite and not negative, nullable shares in [0, 1]."""
    ok = F.lit(True)
    for c in ints:
        ok = ok & (F.col(c) >= 0)
    for c in doubles:
        ok = ok & finite(F.col(c).cast("double")) & (F.col(c) >= 0)
    for c in unit:
        ok = ok & (F.col(c).isNull() | F.col(c).between(0, 1))
    return rows.filter(~F.coalesce(ok, F.lit(False)))


def shared_violations(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Records whose metric is not their task's scorer, or that have classes just where they should not; unknown tasks too."""
    known = records.join(F.broadcast(registry.select("task", F.col("scorer").alias("_scorer"))), "task", "left")
    ok = (F.col("metric") == F.col("_scorer")) & (F.col("all_classes").isNotNull() == (F.col("metric") == "classification"))
    return known.filter(~F.coalesce(ok, F.lit(False))).drop("_scorer")


def pilot(rows: DataFrame, tokens: int, new_tokens: int, limit: int | None = None) -> DataFrame:
    """The first rows in canonical order, or the first of the heaviest shape."""
    order = ["task_ord", "source_index", "key"]
    if limit is not None:
        return rows.orderBy(*order).limit(limit)
    return rows.filter((F.col("tokens") >= tokens) & (F.col("max_new_tokens") == new_tokens)).orderBy(*order).limit(1)


def pilot_gate(pilots: DataFrame, configurations: DataFrame, headroom_gib: float = 1.5) -> DataFrame:
    """Configurations without a passed pilot of enough memory headroom."""
    free = F.col("total_bytes") - F.col("non_torch_bytes") - F.col("peak_reserved_bytes")
    passed = pilots.filter((F.col("status") == "completed") & (free >= headroom_gib * 2**30))
    return configurations.join(passed, "configuration", "left_anti")


def journal(events: DataFrame, *key: str, order: list[str] | None = None) -> DataFrame:
    """Per key: attempts, latest status, failures, and whether its history is legal.

    A history is legal if attempts count 1, 2, 3 ... in order and nothing
    follows a completed event.
    """
    w = W.partitionBy(*key).orderBy(*(order or ["attempt"]))
    rows = events.withColumn("_seen", F.row_number().over(w)).withColumn("_next", F.lead("status").over(w))
    bad = (F.col("attempt") != F.col("_seen")) | (F.col("status") == "completed") & F.col("_next").isNotNull()
    return rows.groupBy(*key).agg(F.count("*").alias("attempts"), F.max_by("status", "_seen").alias("latest"), F.count_if(F.col("status") == "failed").alias("failures"), F.count_if(bad).alias("invalid"))


def status_counts(events: DataFrame, *key: str) -> DataFrame:
    """Events per status, and keys with more than one event."""
    per = events.groupBy(*key).agg(F.count_if(F.col("status") == "completed").alias("c"), F.count_if(F.col("status") == "failed").alias("f"), F.count("*").alias("n"))
    return per.agg(F.sum("c").alias("completed"), F.sum("f").alias("failed"), F.count_if(F.col("n") > 1).alias("retried"))


def pending(expected: DataFrame, events: DataFrame, *key: str) -> DataFrame:
    """Keys still to do: expected and not completed; done work is pruned before anything expensive."""
    return expected.join(events.filter("status = 'completed'").select(*key).distinct(), list(key), "left_anti")
