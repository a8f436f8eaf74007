"""Prompt features, token truncation and hashes."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerline.functions.text import let


def words(text: Column) -> Column:
    """White-space tokens, the stand-in where no tokenizer is given."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def entropy(items: Column) -> Column:
    """Shannon entropy in bits of an array's values, in one row and in time of its length but for the sort.

    Strings are counted by their 64-bit hashes; runs of equal ones in the sorted array are the counts.
    """
    codes = F.array_sort(F.transform(items, lambda x: F.xxhash64(x)))
    n = F.size(items)
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    ends = lambda p: F.concat(F.slice(p, 2, n), F.array(n))
    bits = lambda p: F.aggregate(F.zip_with(p, ends(p), lambda a, b: (b - a).cast("double")), F.lit(0.0), lambda total, c: total + c * F.log2(c))
    runs = let(codes, starts)
    return F.when(n == 0, 0.0).otherwise(F.log2(n.cast("double")) - let(runs, bits) / n)


@F.pandas_udf(DoubleType())
def gzip_ratio(text: pd.Series) -> pd.Series:
    """Compressed over plain bytes at level 6; an empty text is its header's size over one."""
    return pd.Series([len(gzip.compress(t.encode(), 6, mtime=0)) / max(len(t.encode()), 1) for t in text.fillna("")], dtype=float)


def prompt_features(text: Column, ids: Column, marker: str = "?") -> dict[str, Column]:
    """The features that need no library: counts, entropy, type/token, last marker's place (null if none), line density."""
    n, chars = F.size(ids), F.char_length(text)
    at = F.char_length(text) - F.locate(marker, F.reverse(text))
    return {
        "seq_len_tokens": n.cast("long"), "seq_len_chars": chars.cast("long"), "token_entropy": F.round(entropy(ids), 4),
        "unique_token_ratio": F.round(F.when(n > 0, F.size(F.array_distinct(ids)) / n).otherwise(0.0), 4),
        "question_position": F.when(F.contains(text, F.lit(marker)), F.round(at / chars, 4)),
        "newline_density": F.round(F.when(chars > 0, (chars - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))) / chars).otherwise(0.0), 4),
    }


def middle_truncate(ids: Column, cap: int) -> Column:
    """First and last cap // 2 ids of longer arrays; with an odd cap one id less is kept."""
    side = cap // 2
    return F.when(F.size(ids) > cap, F.concat(F.slice(ids, 1, side), F.slice(ids, F.size(ids) - side + 1, F.lit(side)))).otherwise(ids)


def ids_sha256(ids: Column) -> Column:
    """sha256 of the ids as a little-endian unsigned 32-bit stream."""
    byte = lambda x, k: F.lpad(F.hex(F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255))), 2, "0")
    return F.sha2(F.unhex(F.array_join(F.transform(ids, lambda x: F.concat(*(byte(x.cast("long"), k) for k in range(4)))), "")), 256)


def vector(features: list[Column], null: float = -1.0) -> Column:
    """Features as an array of doubles; null becomes -1 and never drops the row."""
    return F.array(*(F.coalesce(f.cast("double"), F.lit(null)) for f in features))


def fp16_growth_bytes(tokens: Column, bytes_per_token: Column, window: int | None = None) -> Column:
    """Cache bytes after so many tokens; with a sliding window at most window - 1 tokens are held."""
    held = tokens if window is None else F.least(tokens, F.lit(window - 1))
    return F.greatest(held, F.lit(0)) * bytes_per_token


def bytes_per_token(layers: Column, heads: Column, dim: Column) -> Column:
    """Two tensors of two-byte values."""
    return 4 * layers * heads * dim


def compression_ratio(full: Column, kept: Column, strict: bool = True) -> Column:
    """full / kept; of nothing kept 1, or an error if ``strict``."""
    none = F.raise_error(F.lit("kept bytes must be positive")).cast("double") if strict else F.lit(1.0)
    return F.when(kept > 0, full / kept).otherwise(none)


def stop_ids(native: Column, extra: Column, use_extra: Column) -> Column:
    return F.when(use_extra, F.array_union(native, extra)).otherwise(native)


#: Length-only baselines: the features they look at.
LENGTH_ONLY = {"both": ("seq_len_tokens", "seq_len_chars"), "tokens": ("seq_len_tokens",)}


def subset(features: Column, all_names: list[str], names: tuple[str, ...]) -> Column:
    """Those of a feature vector's entries that are named, in that order."""
    return F.array(*(F.element_at(features, all_names.index(n) + 1) for n in names))


def tokenized(prompts, load, prompt: str = "prompt", chat: str = "chat", wrap=None):
    """Adds ``ids``, the prompt's token ids by any tokenizer.

    ``load()`` runs once in each task and gives a function of a text; rows whose
    ``chat`` is true are first put through ``wrap`` (text -> text), and the
    others are not. A null prompt is an empty one.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*prompts.schema, T.StructField("ids", T.ArrayType(T.LongType()))])
    at, flag = prompts.columns.index(prompt), prompts.columns.index(chat) if chat in prompts.columns else None

    def run(batches):
        import pyarrow as pa

        encode = load()
        for b in batches:
            wrapped = b.column(flag).to_pylist() if flag is not None else [False] * b.num_rows
            ids = [list(encode(wrap(t or "") if w and wrap else t or "")) for t, w in zip(b.column(at).to_pylist(), wrapped, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int64()))], names=schema.names)

    return prompts.mapInArrow(run, schema)
