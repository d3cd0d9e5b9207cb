"""Incremental runs: a changed setting, a stream with a restart in the middle, rewrites and write checkpoints."""

import json

from pyspark.sql import functions as F

from marginalia.functions.text import fingerprint
from marginalia.streaming import runs

CONCERNS = {"*": ["model"], "inline": ["hazard"], "api_doc": ["c5_min"]}


def items(spark, settings):
    rows = [(f"f{i}", i, ["inline", "api_doc", "todo"][i % 3]) for i in range(30)]
    return runs.keyed(spark.createDataFrame(rows, "path string, start int, kind string"), settings, CONCERNS, ["path", "start", "kind"])


def test_a_setting_redoes_just_what_it_concerns(spark, tmp_path):
    folder = f"{tmp_path}/ledger"
    old = {"model": "m", "hazard": 0.3, "c5_min": 0.5}
    done = items(spark, old)
    entries = done.select("key", F.lit("ready").alias("state"), F.lit("keep").alias("verdict"), F.lit(1).cast("long").alias("updated_at"))
    runs.append(entries, folder, 0)
    assert runs.pending(done, folder).count() == 0
    kinds = lambda s: {r.kind: r["count"] for r in runs.pending(items(spark, s), folder).groupBy("kind").count().collect()}
    assert kinds(old | {"hazard": 0.4}) == {"inline": 10}
    assert kinds(old | {"c5_min": 0.6}) == {"api_doc": 10}
    assert kinds(old | {"unused": 1}) == {}
    assert kinds(old | {"model": "n"}) == {"inline": 10, "api_doc": 10, "todo": 10}
    assert kinds({"model": "m", "hazard": 0.3}) == {"api_doc": 10}
    # A few keys read their buckets alone.
    few = done.limit(2)
    buckets = [r[0] for r in few.select(runs.bucket(F.col("key"))).distinct().collect()]
    assert 0 < runs.read(spark, folder, buckets).count() < 30
    plan = runs.read(spark, folder, buckets)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1]


def test_stream_restarts_and_rewrites(spark, tmp_path):
    source, folder, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "ledger", "checkpoint"))
    (tmp_path / "in").mkdir()
    entry = lambda key, state, at: json.dumps({"key": key, "state": state, "verdict": "keep", "updated_at": at})
    stream = lambda: runs.append_stream(spark, spark.readStream.schema(runs.SCHEMA).json(source), folder, checkpoint).awaitTermination()
    (tmp_path / "in" / "a.json").write_text("\n".join([entry("a", "ready", 1), entry("b", "error", 1)]))
    stream()
    (tmp_path / "in" / "b.json").write_text("\n".join([entry("b", "ready", 2), entry("a", "error", 0), entry("c", "pending", 2)]))
    stream()  # the restart: the first file isn't read again
    states = lambda: {r.key: r.state for r in runs.latest(runs.read(spark, folder)).collect()}
    assert states() == {"a": "ready", "b": "ready", "c": "pending"} and runs.read(spark, folder).count() == 5
    assert runs.compact(spark, folder) == 1
    assert states() == {"a": "ready", "b": "ready", "c": "pending"} and runs.read(spark, folder).count() == 3
    (tmp_path / "in" / "c.json").write_text(entry("c", "kept", 3))
    stream()
    assert states()["c"] == "kept" and runs._numbers(spark, folder, "batch") == [2]
    # A rewrite that was stopped has no mark of success and doesn't count.
    (tmp_path / "ledger" / "upto=7").mkdir()
    assert states()["c"] == "kept"
    want = spark.createDataFrame([("a",), ("c",), ("d",)], "key string")
    assert [r.key for r in runs.pending(want, folder).collect()] == ["d"]
    assert runs.pending(want, f"{tmp_path}/none").count() == 3


def test_resume_by_hashes(spark):
    h = lambda text: spark.range(1).select(fingerprint(F.lit(text))).first()[0]
    rows = [
        ("done", "s", "applied", h("old"), h("new"), None, 1), ("closed", "s", "prepared", h("old"), h("new"), "new", 1), ("ready", "s", "prepared", h("old"), h("new"), "new", 1),
        ("broken", "s", "prepared", h("old"), h("new"), "other", 1), ("moved", "s", "prepared", h("old"), h("new"), "new", 1), ("ready", "s", "applied", h("x"), h("y"), None, 0), ("else", "t", "applied", h("old"), h("new"), None, 1),
    ]
    writes = spark.createDataFrame(rows, "path string, settings string, state string, before_hash string, after_hash string, after_source string, updated_at long")
    files = spark.createDataFrame([("done", "new"), ("closed", "new"), ("ready", "old"), ("broken", "old"), ("moved", "third"), ("else", "new"), ("first", "old")], "path string, source string")
    got = {r.path: (r.action, r.complete, r.text) for r in runs.resumed(files, writes, "s").collect()}
    assert got == {
        "done": ("skip", False, None), "closed": ("skip", True, None), "ready": ("write", False, "new"), "broken": ("corrupt", False, None),
        "moved": ("redo", False, None), "else": ("redo", False, None), "first": ("redo", False, None),
    }
