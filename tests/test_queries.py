"""Every catalogue query with SQL against DuckDB over the smallest tables."""

import duckdb
import pytest

from marginalia.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(got, df.columns) == plain(found.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_fingerprint_frames_lengths(spark):
    import hashlib
    import struct

    from pyspark.sql import functions as F

    from marginalia.functions.text import fingerprint

    row = spark.sql("SELECT 'aé' AS a, '' AS b").select(fingerprint(F.col("a"), F.col("b"))).first()[0]
    parts = ["aé".encode(), b""]
    assert row == hashlib.sha256(b"".join(struct.pack("<Q", len(p)) + p for p in parts)).hexdigest()


def test_tiers(spark):
    from marginalia.operators.changes import tiers

    items = spark.createDataFrame(
        [("f", 1, 2, 2, "line", "# a", 1, 6), ("f", 2, 9, 9, "line", "# b", 8, 12), ("f", 3, 30, 30, "line", "# c", 29, 33)],
        "path string, item int, start_line int, end_line int, kind string, text string, scope_start int, scope_end int",
    )
    hunks = spark.createDataFrame([("f", 1, 0, 2, 1), ("f", 10, 1, 11, 1)], "path string, old_start int, old_count int, new_start int, new_count int")
    old = spark.createDataFrame([("f", 8, 8, "line", "# b"), ("f", 29, 29, "line", "# c")], "path string, start_line int, end_line int, kind string, text string")
    assert {r.item: r.tier for r in tiers(items, hunks, old).collect()} == {1: "added", 2: "scope_changed", 3: "untouched"}


def test_ledger_runs_once(spark, tmp_path):
    from marginalia.streaming import ledger

    entries = spark.createDataFrame([("a", "error", None, 1), ("a", "ready", "keep", 2), ("b", "error", None, 3)], ledger.SCHEMA)
    items = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "g")], "key string, path string")
    assert {r.key for r in ledger.pending(items, entries).collect()} == {"b", "c"}
    assert ledger.resolved_files(items, entries).count() == 0
    entries.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ledger.SCHEMA).parquet(str(tmp_path / "in"))
    for _ in range(2):
        ledger.append_stream(spark, stream, str(tmp_path / "ledger"), str(tmp_path / "state")).awaitTermination(60)
    assert ledger.read(spark, str(tmp_path / "ledger")).count() == 3


def test_entry_needs_no_session():
    import os
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=top, check=True, timeout=120)
