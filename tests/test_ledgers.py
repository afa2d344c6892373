"""Blocks that are processed once, versions that are published whole, files that are sealed."""

import os
import shutil
import signal
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from tracewell.operators.processing import BlockLedger
from tracewell.sources import files, publishing

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def make_squares():  # a function of its own, as workers can't import tests
    def squares(row):
        if row["b"] % 7 == 3:
            raise KeyError(f"block {row['b']} is poisoned")
        return [(n, row["b"] * n) for n in range(row["b"] % 4)]

    return squares


squares = make_squares()


def ledger(spark, folder):
    return BlockLedger(spark, str(folder), "b", "long", "n int, product long")


def everything(led):
    return sorted((r.b, r.status, r.error_type, r.reason, None if r.results is None else tuple(map(tuple, r.results))) for r in led.blocks().collect())


WANT = [(b, "FAILED", "KeyError", f"'block {b} is poisoned'", None) if b % 7 == 3 else (b, "COMPLETE", None, None, tuple((n, b * n) for n in range(b % 4))) for b in range(60)]


def test_runs_go_on_and_receipts_stay(spark, tmp_path):
    blocks = spark.range(60).withColumnRenamed("id", "b")
    led = ledger(spark, tmp_path / "led")
    assert led.blocks().count() == 0 and led.run(blocks.limit(0), squares) == 0
    assert led.run(blocks, squares, waves=5, most=2) == 2
    part = led.blocks().count()
    assert 0 < part < 60
    # A wave that was being written when its run was killed has no marker: it counts for nothing.
    torn = f"{tmp_path}/led/wave-00000007-dead"
    shutil.copytree(f"{tmp_path}/led/{led.waves()[0]}", torn)
    for name in os.listdir(torn):
        if name.endswith("SUCCESS") or name.endswith("SUCCESS.crc"):
            os.remove(f"{torn}/{name}")
    assert led.blocks().count() == part and led.run(blocks, squares, waves=2) == 2
    assert everything(led) == WANT and led.run(blocks, squares) == 0
    assert sorted(map(tuple, led.results().collect())) == sorted((b, n, v) for b, s, _, _, rows in WANT if s == "COMPLETE" for n, v in rows)
    assert led.receipts().where("status = 'FAILED'").count() == 9
    # Two runs that did the same blocks: each counts once.
    shutil.copytree(f"{tmp_path}/led/{led.waves()[0]}", f"{tmp_path}/led/wave-00000099-other")
    assert everything(led) == WANT
    # Told to, a run takes failed blocks again, and a success replaces the receipt.
    assert led.run(blocks, lambda row: [(0, 0)], again=True) == 1
    assert led.receipts().where("status = 'FAILED'").count() == 0 and led.blocks().count() == 60
    with pytest.raises(ValueError):
        led.run(spark.createDataFrame([(None,)], "b long"), squares)


def test_a_killed_run_is_taken_up(spark, tmp_path):
    """A run that the system kills in its second wave; another process goes on."""
    folder = tmp_path / "led"
    code = f"""
import os, sys, time
sys.path[:0] = [{ROOT!r}, {ROOT + "/tests"!r}]
os.environ["PYTHONPATH"] = {ROOT!r} + os.pathsep + {ROOT + "/tests"!r}
from test_ledgers import ledger, squares
from tracewell.session import local_session
def slow(row):
    if os.path.exists({str(tmp_path / "led")!r}) and any(os.path.exists(f"{tmp_path}/led/{{w}}/_SUCCESS") for w in os.listdir({str(tmp_path / "led")!r})):
        time.sleep(0.4)
    return squares(row)
spark = local_session(2, 2, "1g")
ledger(spark, {str(folder)!r}).run(spark.range(60).withColumnRenamed("id", "b"), slow, waves=3)
"""
    run = subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    led, began = ledger(spark, folder), time.time()
    while not led.waves() and run.poll() is None and time.time() - began < 120:
        time.sleep(0.2)
    time.sleep(1.0)
    os.killpg(run.pid, signal.SIGKILL)
    run.wait()
    assert 0 < led.blocks().count() < 60
    led.run(spark.range(60).withColumnRenamed("id", "b"), squares)
    assert everything(led) == WANT


def test_sealed_files(spark, tmp_path):
    path = f"{tmp_path}/a/b.json"
    assert files.seal_json(spark, path, {"z": 1, "a": "é\n\""}) and not files.seal_json(spark, path, {"a": "é\n\"", "z": 1})
    with pytest.raises(files.Refused):
        files.seal_json(spark, path, {"z": 2})
    with pytest.raises(ValueError):
        files.seal_json(spark, f"{tmp_path}/c.json", {"z": float("nan")})
    assert open(path, encoding="utf8").read() == '{\n  "a": "é\\n\\"",\n  "z": 1\n}\n' and [n for n in os.listdir(f"{tmp_path}/a") if "partial" in n] == []
    assert files.qualified(spark, str(tmp_path)).startswith("file:/")


def test_versions_are_published_whole(spark, tmp_path):
    folder = f"{tmp_path}/pub"
    parents = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    children = spark.createDataFrame([(10, 1), (11, 2), (11, 2), (12, None)], "key long, parent long")
    audits = [publishing.unique_key("parents", "id"), publishing.foreign_key("children", "parent", "parents", "id")]
    nothing = spark.createDataFrame([], "id long")
    assert publishing.publish(spark, folder, "v1", {"parents": parents, "children": children, "nothing": nothing}, audits)
    assert not publishing.publish(spark, folder, "v1", {"nothing": nothing, "children": children.orderBy(F.desc("key")).repartition(2), "parents": parents}, audits)
    for other in ({"parents": parents, "children": children.distinct(), "nothing": nothing}, {"parents": parents, "children": children}):
        with pytest.raises(publishing.Refused):
            publishing.publish(spark, folder, "v1", other, audits)
    with pytest.raises(publishing.AuditFailed) as failed:
        publishing.publish(spark, folder, "v2", {"parents": parents.union(parents), "children": children.union(spark.createDataFrame([(13, 9)], children.schema)), "nothing": nothing}, audits)
    assert failed.value.found == {"parents: unique id": 2, "children.parent in parents.id": 1}
    assert publishing.versions(spark, folder) == ["v1"] and len(os.listdir(f"{folder}/attempts")) == 1
    assert {k: t.count() for k, t in publishing.tables(spark, folder, "v1").items()} == {"parents": 2, "children": 4, "nothing": 0}
    assert sorted(map(tuple, publishing.verify(spark, folder, "v1").collect())) == [("children", 4, 4, "OK"), ("nothing", 0, 0, "OK"), ("parents", 2, 2, "OK")]
    attempt = f"{folder}/attempts/{os.listdir(f'{folder}/attempts')[0]}"
    spark.createDataFrame([(10, 1), (11, 2), (11, 1), (12, None)], children.schema).write.mode("overwrite").parquet(f"{attempt}/children")
    shutil.rmtree(f"{attempt}/nothing")
    parents.union(parents).write.mode("overwrite").parquet(f"{attempt}/parents-new")
    shutil.rmtree(f"{attempt}/parents")
    os.rename(f"{attempt}/parents-new", f"{attempt}/parents")
    assert {r.table_name: r.status for r in publishing.verify(spark, folder, "v1").collect()} == {"children": "CONTENT_MISMATCH", "nothing": "MISSING_TABLE", "parents": "ROW_MISMATCH"}
    # An attempt that was killed before its manifest leaves the version unpublished and free.
    parents.write.parquet(f"{folder}/attempts/v3-killed/parents")
    assert publishing.versions(spark, folder) == ["v1"] and publishing.publish(spark, folder, "v3", {"parents": parents}, audits[:1])
