"""Places of lines against a sequential reader, and hash chains with one byte changed."""

import hashlib
import json
import random

import pytest

from ledgerline.operators import validate as V
from ledgerline.sources import files as S
from ledgerline.sources import readers as R


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write(folder):
    """Three files: (name, number of the line, place, record) as a sequential reader meets them."""
    rng, seen, place = random.Random(5), [], 0
    for name, n in (("a.jsonl", 150), ("b.jsonl", 1), ("c.jsonl", 90)):
        lines = [{"task": rng.choice("xy"), "k": rng.randrange(20), "v": rng.randrange(10**6), "pad": "é" * rng.choice([0, 3, 900])} for _ in range(n)]
        (folder / name).write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in lines))
        for i, r in enumerate(lines):
            seen.append((name, i, place, r))
            place += 1
    return seen


def test_places_are_those_of_a_sequential_reader(spark, tmp_path, small_splits):
    seen = write(tmp_path)
    lines = S.placed_lines(spark, str(tmp_path))
    got = sorted((r.place, r.file.rpartition("/")[2], r.line, json.loads(r.value)) for r in lines.collect())
    assert got == [(p, f, i, r) for f, i, p, r in seen]
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_last_duplicate_and_steps(spark, tmp_path, small_splits):
    seen = write(tmp_path)
    rows = S.placed_json(spark, str(tmp_path))
    last = {}
    for *_, r in seen:
        last[r["task"], r["k"]] = r["v"]
    assert {(r.task, r.k): r.v for r in S.last_lines(rows, "place", "task", "k").collect()} == last
    assert {(r.task, r.k): r.v for r in V.last_wins(rows, "place", "task", "k").collect()} == last
    want = []
    for task in "xy":
        mine = [r["v"] for *_, r in seen if r["task"] == task]
        step = max(1, len(mine) // 9)
        want += [(task, v) for v in mine[::step][:9]]
    assert sorted((r.task, r.v) for r in R.sample_task(rows, 9, "place", "task").collect()) == sorted(want)


def test_routing_items_are_numbered_by_line(spark, tmp_path, small_splits):
    items = [{"task": "t", "scores": {"C0": i / 100, "C1": 0.5}, "compression": {"C0": 1.0, "C1": 2.0}} for i in range(80)]
    (tmp_path / "m.jsonl").write_text("".join(json.dumps(x) + "\n" for x in items))
    got = {r.key: r.score for r in R.read_routing(spark, str(tmp_path / "{model}.jsonl"), "m").filter("cfg_ord = 0").collect()}
    assert got == {f"t:{i}": i / 100 for i in range(80)}


def test_blank_broken_and_no_lines(spark, tmp_path):
    (tmp_path / "x").write_text('{"a":1}\n\n{"a":2}\n')
    assert [r.line for r in S.placed_lines(spark, str(tmp_path / "x")).orderBy("place").collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="no record in line 1"):
        S.placed_json(spark, str(tmp_path / "x"), "a long").collect()
    (tmp_path / "e").write_text("")
    assert S.placed_lines(spark, str(tmp_path / "e")).count() == 0


def sha(path):
    return hashlib.sha256(path.read_bytes()).hexdigest()


def artifact(folder):
    (folder / "tokens").mkdir()
    tokens, index = [], []
    for t in range(12):
        file = folder / "tokens" / f"task {t}.bin"
        file.write_bytes(bytes(range(200)) * (t + 1))
        index += [{"task": f"t{t}", "key": f"{t}:{i}", "token_file": f"tokens/task {t}.bin"} for i in range(t + 1)]
        tokens.append({"task": f"t{t}", "path": f"tokens/task {t}.bin", "sha256": sha(file), "rows": t + 1})
    (folder / "index.jsonl").write_text("".join(json.dumps(r) + "\n" for r in index))
    seal(folder, {"status": "complete", "records": len(index), "index": {"path": "index.jsonl", "sha256": sha(folder / "index.jsonl"), "rows": len(index)}, "token_files": tokens})


def seal(folder, manifest):
    (folder / "manifest.json").write_text(json.dumps(manifest, indent=1))
    (folder / "status.json").write_text(json.dumps({"status": "complete", "manifest_sha256": sha(folder / "manifest.json")}))


def broken(spark, folder):
    return sorted((r.rule, r.name) for r in S.prepared_violations(spark, str(folder)).collect())


def test_a_whole_chain_is_read(spark, tmp_path):
    artifact(tmp_path)
    assert broken(spark, tmp_path) == []
    assert R.read_prepared(spark, str(tmp_path)).count() == 78


def test_one_changed_byte_is_named(spark, tmp_path):
    artifact(tmp_path)
    file = tmp_path / "tokens" / "task 7.bin"
    data = bytearray(file.read_bytes())
    data[513] ^= 1
    file.write_bytes(bytes(data))
    (tmp_path / "tokens" / "more.bin").write_bytes(b"x")
    (tmp_path / "tokens" / "task 5.bin").write_bytes(b"")
    (tmp_path / "tokens" / "task 3.bin").unlink()
    assert broken(spark, tmp_path) == [("changed", "tokens/task 7.bin"), ("missing", "tokens/task 3.bin"), ("missing", "tokens/task 5.bin"), ("unexpected", "tokens/more.bin")]
    with pytest.raises(ValueError, match="hash chain is broken"):
        R.read_prepared(spark, str(tmp_path))


def test_manifest_rules(spark, tmp_path):
    artifact(tmp_path)
    manifest = json.loads((tmp_path / "manifest.json").read_text())
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))  # the same document in other bytes
    assert broken(spark, tmp_path) == [("changed", "manifest.json")]
    manifest["status"], manifest["records"] = "running", 77
    manifest["token_files"][2]["path"] = "../tokens/task 2.bin"
    seal(tmp_path, manifest)
    assert broken(spark, tmp_path) == [("missing", "../tokens/task 2.bin"), ("not complete", "manifest.json"), ("outside the folder", "../tokens/task 2.bin"), ("row count", "index.jsonl"), ("token file of a task", "tokens/task 2.bin"), ("unexpected", "tokens/task 2.bin")]


def test_task_file_behind_its_hash(spark, tmp_path):
    file = tmp_path / "qa.jsonl"
    rows = [{"_id": str(i), "input": "q", "context": "c", "answers": ["a"], "all_classes": None, "dataset": "qa", "language": "en", "length": i} for i in range(4)]
    file.write_text("".join(json.dumps(r) + "\n" for r in rows))
    assert R.load_task(spark, str(file), "qa", "en", 4, sha(file)).count() == 4
    with pytest.raises(ValueError, match="not the registered file"):
        R.load_task(spark, str(file), "qa", "en", 4, "0" * 64)
    with pytest.raises(ValueError, match="4 rows, 4 ids, 4 invalid"):
        R.load_task(spark, str(file), "other", "en", 4)
