"""Contracts of JSON records, tested on the parsed lines themselves, so that types and absent fields count.

A record is one variant column ``v`` (``parsed``). A field that the record
lacks is a null column, one that holds null is a variant of type VOID: the two
are told apart. An integer is not a boolean and not a number with a fraction.
Every check is one pass over the records; what is broken comes back as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """``lines`` with ``v``, the line as a variant; a line that is blank, no valid JSON or no object raises."""
    v = F.try_parse_json(value)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return lines.withColumn("v", F.when(is_object, v).otherwise(F.raise_error(F.concat(F.lit("no JSON object: "), F.substring(F.coalesce(F.col(value), F.lit("")), 1, 80))).cast("variant")))


def field(name: str) -> Column:
    """A field of the record as a variant; null where the record lacks it."""
    return F.variant_get("v", f"$['{name}']", "variant")


def kind(x: Column) -> Column:
    """A variant's type by name (OBJECT and ARRAY without what they hold); null where there is none."""
    return F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0)


def text_of(x: Column) -> Column:
    """A string's value, else null."""
    return F.when(kind(x) == "STRING", x.cast("string"))


def integer(x: Column, low: int | None = None, high: int | Column | None = None) -> Column:
    """Whether a variant is a whole number within bounds."""
    n = F.when(kind(x) == "BIGINT", x.cast("long"))
    ok = n.isNotNull()
    ok = ok if low is None else ok & (n >= low)
    return F.coalesce(ok if high is None else ok & (n <= high), F.lit(False))


def number(x: Column) -> Column:
    """A finite number's value as a double, else null. JSON has no other numbers; booleans are none."""
    d = F.when(kind(x).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), x.cast("double"))
    return F.when(F.abs(d) < float("inf"), d)


def items(x: Column) -> Column:
    """An array's entries as variants, else null."""
    return F.when(kind(x) == "ARRAY", x.cast("array<variant>"))


def all_of(x: Column, ok) -> Column:
    """Whether a variant is an array with entries, all of which are ``ok``."""
    found = items(x)
    return F.coalesce((F.size(found) > 0) & F.forall(found, ok), F.lit(False))


def broken(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold, in order; a rule without answer does not hold."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())


def reference_ok(x: Column) -> Column:
    return F.coalesce((kind(x) == "STRING") | number(x).isNotNull(), F.lit(False))


def class_ok(x: Column) -> Column:
    return F.coalesce(F.char_length(text_of(x)) > 0, F.lit(False))


#: The seven features' contract: whole numbers from 0, numbers from 0, positive numbers, shares, and a share that may be null.
COUNTS, AMOUNTS, POSITIVE, SHARES, PLACES = ("seq_len_tokens", "seq_len_chars"), ("token_entropy",), ("gzip_ratio",), ("unique_token_ratio", "newline_density"), ("question_position",)


def features_ok(x: Column) -> Column:
    """Whether a variant is an object of exactly the seven features, each of its type and in its range."""
    names = sorted(COUNTS + AMOUNTS + POSITIVE + SHARES + PLACES)
    at = lambda n: F.variant_get(x, f"$.{n}", "variant")
    ok = F.array_sort(F.map_keys(F.when(kind(x) == "OBJECT", x.cast("map<string,variant>")))) == F.array(*map(F.lit, names))
    for n in COUNTS:
        ok = ok & integer(at(n), 0)
    for n in AMOUNTS:
        ok = ok & (number(at(n)) >= 0)
    for n in POSITIVE:
        ok = ok & (number(at(n)) > 0)
    for n in SHARES:
        ok = ok & number(at(n)).between(0, 1)
    for n in PLACES:
        ok = ok & ((kind(at(n)) == "VOID") | number(at(n)).between(0, 1))
    return F.coalesce(ok, F.lit(False))


def shared_violations(records: DataFrame, registry: DataFrame, cap: int, algorithm: str, features: bool = True) -> DataFrame:
    """Records (``parsed``) that break a rule of the fields that all configurations share, with ``broken``, the rules' names.

    ``registry``: one row a task, broadcast: ``task``, ``category``,
    ``scorer``, ``max_new_tokens``. Rules: *task* (known to the registry),
    *model* and *model_id* (strings with text), *place* (``source_index`` from
    0), *metric* (the registry's scorer), *references* (some, each a string or
    finite number), *classes* (some strings for classification tasks, else
    null), *features*, *lengths* (token counts before and after truncation, the
    latter at most ``cap``), *truncation* (longer inputs are marked and of
    exactly ``cap`` tokens, others neither marked nor shorter), *new_tokens* and
    *category* (the registry's; a record may lack the category) and *hash*
    (``token_hash_algorithm``).
    """
    known = registry.select(F.col("task").alias("_task"), F.col("category").alias("_category"), F.col("scorer").alias("_scorer"), F.col("max_new_tokens").alias("_new"))
    rows = records.withColumn("_of", text_of(field("task"))).join(F.broadcast(known), F.col("_of") == F.col("_task"), "left")
    before, after, marked = field("pre_truncation_token_count"), field("post_truncation_token_count"), field("truncated")
    n, m, cut = (F.when(kind(x) == t, x.cast(to)) for x, t, to in ((before, "BIGINT", "long"), (after, "BIGINT", "long"), (marked, "BOOLEAN", "boolean")))
    classes = field("all_classes")
    rules = {
        "task": F.col("_task").isNotNull(),
        "model": F.char_length(text_of(field("model"))) > 0,
        "model_id": F.char_length(text_of(field("model_id"))) > 0,
        "place": integer(field("source_index"), 0),
        "metric": text_of(field("metric")) == F.col("_scorer"),
        "references": all_of(field("references"), reference_ok),
        "classes": F.when(F.col("_scorer") == "classification", all_of(classes, class_ok)).otherwise(classes.isNull() | (kind(classes) == "VOID")),
        "features": features_ok(field("features")) if features else F.lit(True),
        "lengths": integer(before, 1) & integer(after, 1, cap),
        "truncation": F.when(n > cap, cut & (m == cap)).otherwise(~cut & (m == n)),
        "new_tokens": integer(field("max_new_tokens"), 1) & (F.when(kind(field("max_new_tokens")) == "BIGINT", field("max_new_tokens").cast("long")) == F.col("_new")),
        "category": field("category").isNull() | (text_of(field("category")) == F.col("_category")),
        "hash": text_of(field("token_hash_algorithm")) == algorithm,
    }
    return rows.withColumn("broken", broken(rules)).filter(F.size("broken") > 0).select(*records.columns, "broken")


def shared_field_differences(records: DataFrame, on: list[str], required: list[str], optional: list[str] = ()) -> DataFrame:
    """Keys whose shared fields differ among their records: rows (``on``..., ``field``, ``problem``).

    ``missing``: a required field that a record lacks; ``presence``: a field
    that only some of the records have (null counts as there); ``value``: values
    whose JSON differs once objects are in order of their names. Values are
    compared by hash, so a shuffle carries 8 bytes a field and record, aggregated before it.
    """
    names = [*required, *optional]
    cells = F.array(*(F.struct(F.lit(n).alias("field"), F.xxhash64(F.to_json(field(n))).alias("h"), field(n).isNotNull().alias("there")) for n in names))
    rows = records.select(*on, F.explode(cells).alias("c")).select(*on, "c.*")
    low, high = F.min(F.when(F.col("there"), F.col("h"))).alias("_low"), F.max(F.when(F.col("there"), F.col("h"))).alias("_high")
    per = rows.groupBy(*on, "field").agg(F.count("*").alias("_n"), F.count_if("there").alias("_there"), low, high)
    lacks = F.col("_there") < F.col("_n")
    problem = F.when(lacks & F.col("field").isin(list(required)), "missing").when(lacks & (F.col("_there") > 0), "presence").when(F.col("_low") != F.col("_high"), "value")
    return per.select(*on, "field", problem.alias("problem")).filter("problem is not null")


def wide_violations(rows: DataFrame, on: list[str], configurations: list[str], accounting: dict[str, str], rel: float = 1e-6, absolute: float = 5e-5) -> DataFrame:
    """What joined rows (``parsed``, fields named configuration_field) break, as (``on``..., ``configuration``, ``broken``).

    Rules: *fields* (all outputs are there), *prediction* (a string),
    *accounting* (the configuration's own), *tokens* (generated, from 0),
    *score* (0 to 1), *bytes* (positive, and so is the ratio) and *ratio*
    (bytes in 16 bits over bytes, within tolerance).
    """
    outputs = ("prediction", "kv_accounting", "generated_token_count", "score", "kv_bytes", "kv_bytes_fp16", "compression")

    def cell(c: str) -> Column:
        f = {n: field(f"{c}_{n}") for n in outputs}
        score, kept, full, ratio = (number(f[n]) for n in ("score", "kv_bytes", "kv_bytes_fp16", "compression"))
        there = F.lit(True)
        for x in f.values():
            there = there & x.isNotNull()
        rules = {
            "fields": there,
            "prediction": kind(f["prediction"]) == "STRING",
            "accounting": text_of(f["kv_accounting"]) == accounting[c],
            "tokens": integer(f["generated_token_count"], 0),
            "score": score.between(0, 1),
            "bytes": (kept > 0) & (full > 0) & (ratio > 0),
            "ratio": F.when(kept > 0, F.abs(ratio - full / kept) <= F.greatest(rel * F.greatest(F.abs(ratio), F.abs(full / kept)), F.lit(absolute))),
        }
        return F.struct(F.lit(c).alias("configuration"), broken(rules).alias("broken"))

    return rows.select(*on, F.explode(F.array(*map(cell, configurations))).alias("c")).select(*on, "c.*").filter(F.size("broken") > 0)


def registry_violations(tasks: DataFrame, published: DataFrame, excluded: list[str], categories: list[str], scorers: list[str], total: int) -> DataFrame:
    """What a task registry breaks, as (``rule``, ``task``); rules on the registry as a whole have no task.

    ``tasks``: ``task``, ``category``, ``expected``, ``scorer``, ``max_new_tokens``;
    ``published``: ``task``, ``max_new_tokens`` of the full benchmark. The
    registry and the excluded tasks share none and together are all published
    ones, each once; output limits are the published ones, categories and scorers are known, counts
    are positive and sum to ``total``.
    """
    full = published.select("task", F.col("max_new_tokens").alias("_new"), F.lit(True).alias("_published"))
    both = tasks.withColumn("_in", F.lit(True)).join(full, "task", "full_outer")
    inside, out = F.coalesce(F.col("_in"), F.lit(False)), F.col("task").isin(excluded)
    rules = {
        "published": F.coalesce(F.col("_published"), F.lit(False)),
        "covered": inside | out,
        "excluded": ~(inside & out),
        "category": ~inside | F.col("category").isin(categories),
        "scorer": ~inside | F.col("scorer").isin(scorers),
        "expected": ~inside | (F.col("expected") > 0),
        "max_new_tokens": ~inside | F.col("_published").isNull() | (F.col("max_new_tokens") == F.col("_new")),
    }
    each = both.select("task", F.explode(broken(rules)).alias("rule"))
    twice = tasks.groupBy("task").agg(F.count("*").alias("_c")).filter("_c > 1").select("task", F.lit("repeated").alias("rule"))
    whole = tasks.agg(F.coalesce(F.sum("expected"), F.lit(0)).alias("_s")).filter(F.col("_s") != total).select(F.lit(None).cast("string").alias("task"), F.lit("total").alias("rule"))
    return each.unionByName(twice).unionByName(whole).distinct().select("rule", "task")
