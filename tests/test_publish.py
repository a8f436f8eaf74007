"""Runs that are created once, and published tables that are whole or named as broken."""

from pathlib import Path

import pytest

from ledgerline.sinks import publish as P

SCHEMA = "k long, name string, kind string"


def rules(spark, path):
    return {r.rule for r in P.published_violations(spark, path, SCHEMA).collect()}


def test_run_is_created_once(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        P.open_run(spark, root, "m", "r1")
    path = P.create_run(spark, root, "m", "r1")
    assert P.open_run(spark, root, "m", "r1") == path == f"{root}/m/r1"
    for again in ("r1", "../r2", ""):
        with pytest.raises((FileExistsError, ValueError)):
            P.create_run(spark, root, "m", again)
    assert P.create_run(spark, root, "m", "r2") != path


def test_published_table_is_read_back_and_never_replaced(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else f"n{i}", "ab"[i % 2]) for i in range(40)], SCHEMA)
    path = str(tmp_path / "t")
    P.publish(rows.unionAll(rows.limit(3)), path, "kind")
    assert rules(spark, path) == set()
    back = P.read_published(spark, path, SCHEMA)
    assert back.count() == 43 and back.exceptAll(rows).count() == 3
    with pytest.raises(FileExistsError):
        P.publish(rows, path)
    assert P.read_published(spark, path, SCHEMA).count() == 43


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "e")
    P.publish(spark.createDataFrame([], SCHEMA), path)
    assert P.read_published(spark, path, SCHEMA).count() == 0


def test_what_is_broken_is_named(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}", "a") for i in range(40)], SCHEMA).repartition(2)
    path = tmp_path / "t"
    P.publish(rows, str(path))
    assert "schema" in {r.rule for r in P.published_violations(spark, str(path), "k long, name string").collect()}
    extra = spark.createDataFrame([(99, "x", "a")], SCHEMA)
    extra.write.mode("append").parquet(str(path / "data"))
    assert rules(spark, str(path)) == {"unexpected", "rows", "content"}
    with pytest.raises(ValueError, match="unexpected"):
        P.read_published(spark, str(path), SCHEMA)

    other = tmp_path / "u"
    P.publish(rows, str(other))
    part = next(Path(other / "data").glob("part-*.parquet"))
    part.write_bytes(part.read_bytes()[:-1] + b"X")
    part.with_name(f".{part.name}.crc").unlink()  # else the local file system refuses to read it
    with pytest.raises(ValueError, match="changed"):
        P.read_published(spark, str(other), SCHEMA)
    part.unlink()
    assert rules(spark, str(other)) == {"missing", "rows", "content"}

    cut = tmp_path / "v"
    rows.write.parquet(str(cut / "data"))
    assert rules(spark, str(cut)) == {"not complete"}
    with pytest.raises(ValueError, match="not complete"):
        P.read_published(spark, str(cut), SCHEMA)
