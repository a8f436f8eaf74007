import json

import pytest

from ledgerline.sinks import export as E
from ledgerline.sources import readers as R
from ledgerline.streaming.journal import append_stream


def test_canonical_json_and_atomic(tmp_path):
    assert E.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    with pytest.raises(ValueError):
        E.canonical_json(float("nan"))
    path = str(tmp_path / "x.json")
    digest = E.atomic_json({"a": 1}, path)
    assert digest == E.file_sha256(path)
    with pytest.raises(FileExistsError):
        E.atomic_json({"a": 2}, path)
    with pytest.raises(FileExistsError):
        E.publish_pair({}, {}, str(tmp_path / "y.json"), path)
    assert not (tmp_path / "y.json").exists()


def test_guard(tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "p")
    with pytest.raises(PermissionError):
        E.guard(str(tmp_path / "link" / "x"), [str(tmp_path / "p")])
    with pytest.raises(ValueError):
        E.namespace("r", "../m", "x")


def test_strict_reader(spark, tmp_path):
    good = tmp_path / "g.jsonl"
    good.write_text('{"task":"a","status":"completed"}\n')
    assert R.read_json_lines(spark, str(good), R.EVENT).first().task == "a"
    for text in ("\n\n", '{"task":\n', "3\n"):
        bad = tmp_path / "b.jsonl"
        bad.write_text('{"task":"a"}\n' + text)
        with pytest.raises(Exception, match="blank line|no valid record"):
            R.read_json_lines(spark, str(bad), R.EVENT).collect()


def test_repair_tail(tmp_path):
    p = tmp_path / "j"
    p.write_text('{"a":1}\n{"b"')
    assert R.repair_tail(str(p)) == 4 and p.read_text() == '{"a":1}\n'
    p.write_text('{"a":1}')
    assert R.repair_tail(str(p)) == -1 and p.read_text() == '{"a":1}\n'


def test_stream_appends_until_completed(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    batches = [[("a", 1, "failed"), ("b", 2, "completed")], [("a", 3, "completed"), ("b", 4, "failed"), ("a", 5, "failed")]]
    for k, rows in enumerate(batches):
        (src / f"{k}.json").write_text("".join(json.dumps({"key": a, "seq": b, "status": c}) + "\n" for a, b, c in rows))
        append_stream(spark.readStream.schema("key string, seq long, status string").json(str(src)), out, cp, "key").awaitTermination()
    got = sorted((r.key, r.seq, r.status, r.attempt) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1, "failed", 1), ("a", 3, "completed", 2), ("b", 2, "completed", 1)]
