"""Sinks: guarded, atomic writes, canonical JSON, flat CSV exports and manifests."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import platform
import re
import subprocess
import zipfile
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPONENT = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def canonical_json(value) -> str:
    """Sorted keys, no blanks, UTF-8 as it is; NaN and infinities raise."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_column(*columns: str):
    """The same for flat rows: fields in order of their names."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def guard(path: str, protected: list[str]) -> str:
    """The resolved path; raises if it lies in a protected folder, symbolic links followed."""
    real = Path(path).resolve()
    for p in protected:
        if real == Path(p).resolve() or Path(p).resolve() in real.parents:
            raise PermissionError(f"{path} is protected")
    return str(real)


def namespace(root: str, model: str, run: str) -> Path:
    """``<root>/<model>/<run>``; parts must be plain names."""
    for part in (model, run):
        if not COMPONENT.fullmatch(part):
            raise ValueError(f"not a plain name: {part}")
    return Path(root, model, run)


def write_once(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Publish a table where none is; Spark's committer makes it appear as a whole."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false" if fmt == "json" else "true").format(fmt).save(path)


def log_rows(df: DataFrame, path: str) -> None:
    """First-generation log: starts over, rounds scores to 6, ratios to 4 and bytes to 1 digits, leaves null fields out."""
    digits = {"score": 6, "compression": 4, "kv_bytes": 1, "kv_bytes_fp16": 1}
    df.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns)).write.mode("overwrite").json(path)


def atomic_json(value, path: str, overwrite: bool = False) -> str:
    """Write a small document through a temporary file; the hex sha256 of its bytes."""
    data = (canonical_json(value) + "\n").encode()
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    temp = target.with_name(f".{target.name}.{os.getpid()}")
    with temp.open("wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    try:
        if overwrite:
            os.replace(temp, target)
        else:
            os.link(temp, target)
    finally:
        temp.unlink(missing_ok=True)
    return hashlib.sha256(data).hexdigest()


def publish_pair(first, second, first_path: str, second_path: str) -> tuple[str, str]:
    """Both documents or none."""
    a = atomic_json(first, first_path)
    try:
        return a, atomic_json(second, second_path)
    except BaseException:
        Path(first_path).unlink(missing_ok=True)
        raise


def flat(labels: DataFrame, extra: DataFrame, configurations: list[str]) -> DataFrame:
    """The wide row per item: score and ratio of each configuration, then the columns of ``extra`` by key."""
    columns = [F.max(F.when(F.col("configuration") == c, F.col(f))).alias(f"{c}_{f}") for c in configurations for f in ("score", "compression")]
    return labels.groupBy("task", "key").agg(*columns).join(extra, "key")


def wide_export(labels: DataFrame, chosen: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """The published table of items: of each configuration score, ratio and both byte counts (``score_c0``, ``cr_c0``, ...), then the columns of ``chosen`` and ``features`` by key.

    Configurations are those of the labels; they are listed by one small query.
    """
    fields = {"score": "score", "cr": "compression", "kv_bytes": "kv_bytes", "kv_bytes_fp16": "kv_bytes_fp16"}
    names = [r[0] for r in labels.select("configuration").distinct().orderBy("configuration").collect()]
    cells = [F.max(F.when(F.col("configuration") == c, F.col(f))).alias(f"{name}_{c.lower()}") for c in names for name, f in fields.items()]
    wide = labels.groupBy("task", "key").agg(*cells).join(chosen, "key")
    return wide if features is None else wide.join(features, "key", "left")


def canonical_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as canonical JSON text: fields and map keys sorted at every depth, nulls written, NaN and infinities an error.

    The bytes are those of ``canonical_json`` for the same value; maps need text keys, and dates and binaries are to be cast before.
    """
    from pyspark.sql import types as T

    def plain(kind):
        if isinstance(kind, T.StructType):
            parts = {f.name: plain(f.dataType) for f in kind}
            return lambda v: None if v is None else {n: f(v[n]) for n, f in parts.items()}
        if isinstance(kind, T.ArrayType):
            each = plain(kind.elementType)
            return lambda v: None if v is None else [each(x) for x in v]
        if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            value = plain(kind.valueType)
            return lambda v: None if v is None else {k: value(x) for k, x in v}
        if isinstance(kind, T.StringType | T.BooleanType | T.IntegralType | T.DoubleType):
            return lambda v: v
        raise TypeError(f"no JSON form of {kind.simpleString()}")

    write = plain(df.schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([canonical_json(write(r)) for r in b.to_pylist()], pa.string())], names=[name])

    return df.mapInArrow(run, T.StructType([T.StructField(name, T.StringType())]))


def write_csv(df: DataFrame, path: str) -> None:
    """One headed CSV file in column order; for result-sized tables."""
    df.coalesce(1).write.mode("errorifexists").option("header", True).option("lineSep", "\n").csv(path)


def master(parts: dict[str, DataFrame], label: str = "part") -> DataFrame:
    """The tables of a master file under each other, in the order given: ``label`` names the part; columns that a part lacks are null."""
    out = None
    for i, (name, part) in enumerate(parts.items()):
        rows = part.select(F.lit(i).alias("part_ord"), F.lit(name).alias(label), *part.columns)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parts")
    return out


def bundle(files: dict[str, str], path: str) -> None:
    """A deflated ZIP of name -> local file."""
    with zipfile.ZipFile(path, "x", zipfile.ZIP_DEFLATED) as z:
        for name, file in sorted(files.items()):
            z.write(file, name)


def write_tokens(rows: DataFrame, path: str) -> None:
    """Token ids, partitioned by task."""
    rows.write.mode("errorifexists").partitionBy("task").parquet(path)


def write_buckets(rows: DataFrame, name: str, buckets: int, path: str | None = None) -> DataFrame:
    """A table of rows with ``task`` and ``key`` in buckets of these, sorted in them.

    An index and its token ids written with the same number of buckets meet without a shuffle.
    """
    writer = rows.repartition(buckets, "task", "key").write.mode("errorifexists").bucketBy(buckets, "task", "key").sortBy("task", "key").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return rows.sparkSession.table(name)


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A table of already small, collected rows."""
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns), *("| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows)])


def git_state(folder: str = ".") -> dict:
    """Commit and cleanness of the working copy that ``folder`` lies in; nulls where there is none."""

    def git(*what: str) -> str | None:
        try:
            done = subprocess.run(["git", "-C", folder, *what], capture_output=True, text=True, timeout=30, check=False)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return done.stdout.strip() if done.returncode == 0 else None

    changes = git("status", "--porcelain")
    return {"commit": git("rev-parse", "HEAD"), "branch": git("rev-parse", "--abbrev-ref", "HEAD"), "dirty": None if changes is None else bool(changes)}


def package_versions(*names: str) -> dict:
    """Installed version of each package, null where it is not installed."""
    out = {}
    for name in names:
        try:
            out[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            out[name] = None
    return out


def environment(spark: SparkSession, folder: str = ".", packages: tuple[str, ...] = ("pyspark", "pyarrow", "pandas", "numpy")) -> dict:
    """What a run ran on: versions of Spark, Java, Python and packages, platform, and the state of the code in ``folder``."""
    jvm = spark.sparkContext._jvm.System
    return {"spark": spark.version, "java": jvm.getProperty("java.version"), "python": platform.python_version(), "platform": platform.platform(), "packages": package_versions(*packages), "git": git_state(folder)}


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@contextlib.contextmanager
def exclusive(path: str):
    """One holder of the lock file at a time; a second one raises at once."""
    import fcntl

    with open(path, "a") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise RuntimeError(f"{path} is held by another run") from e
        yield


def finalize(tables: dict[str, tuple[DataFrame, DataFrame]], artifacts: dict[str, str], manifest: dict, path: str) -> str:
    """Mark a run complete; the hash of its manifest.

    Every stored table (second) must be its recomputation (first), row for row
    in both directions. The manifest holds the hash of each artifact, a local
    file. A complete manifest is final: the same one again is no error, another
    one, or an artifact changed since, raises.
    """
    from ledgerline.operators.validate import same_rows

    with exclusive(f"{path}.lock"):
        if differ := [name for name, (recomputed, stored) in tables.items() if not same_rows(recomputed, stored)]:
            raise ValueError(f"the stored rows are not those recomputed: {', '.join(differ)}")
        done = manifest | {"status": "complete", "artifacts": {name: file_sha256(file) for name, file in artifacts.items()}}
        if Path(path).exists():
            if json.loads(Path(path).read_text()) != done:
                raise ValueError("another manifest is already complete, or an artifact changed since")
            return file_sha256(path)
        return atomic_json(done, path)
