"""Change sources and interval joins: texts as tools write them, odd ones, and many lines in one file."""

from pyspark.sql import functions as F

from marginalia.operators import changes as C
from marginalia.operators import intervals as IV
from marginalia.sources import diffs as D


def test_diff_headers_and_content(spark):
    text = (
        "warning: noise\n"
        "diff --git a/a b.py b/a b.py\nindex 1..2\n--- a/a b.py\n+++ b/a b.py\n@@ -1,0 +2,3 @@ def x @@ y\n+diff --git a/no b/no\n++++ b/no\n+@@ -1 +1 @@\n@@ -9 +12,0 @@\n--- not a header\n@@ bad @@\n"
        "diff --git a/empty.py b/empty.py\nnew file mode 100644\nindex 0..0\n"
        "diff --git a/x.py b/y.py\nsimilarity index 100%\nrename from x.py\nrename to y.py\n"
        "diff --git a/gone.py b/gone.py\ndeleted file mode 100644\n--- a/gone.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-z"
    )
    rows = spark.createDataFrame([("r", text), ("r2", None), ("r3", ""), ("r4", "no diff at all")], "range string, text string")
    got = {(r.range, r.old, r.new, r.status): ([tuple(h) for h in r.hunks], r.n_invalid) for r in D.parse_diffs(rows).collect()}
    assert got == {
        ("r", "a b.py", "a b.py", "M"): ([(1, 0, 2, 3), (9, 1, 12, 0)], 1),
        ("r", None, "empty.py", "A"): ([], 0),
        ("r", "x.py", "y.py", "R"): ([], 0),
        ("r", "gone.py", "gone.py", "D"): ([(1, 1, 0, 0)], 0),
    }


def test_name_status(spark):
    rows = spark.createDataFrame([(1, "M\0A\0R100\0M\0A\0A\0b c\0"), (2, "D\0x\0"), (3, "\0"), (4, None), (5, "R90\0only\0")], "id int, text string")
    got = sorted((r.id, r.old or "", r.new or "", r.status) for r in D.parse_name_status(rows).collect())
    assert got == [(1, "", "b c", "A"), (1, "A", "A", "M"), (1, "M", "A", "R"), (2, "", "", "invalid"), (5, "", "", "invalid")]


def test_changes_whole_tree_and_counters(spark):
    rows = [
        ("r", None, "a.py", "A", None, None, b"x"), ("r", "b.py", "b.py", "M", [(1, 1, 1, 1)], b"\xff", b"x"), ("r", "c.txt", "c.txt", "M", [(1, 1, 1, 1)], b"x", b"x"),
        ("r", "d.py", "d.py", "M", [], b"x", b"x"), ("r", "e.py", "e.py", "D", [(1, 1, 0, 0)], b"x", None), ("r", None, "f.ts", "A", [(0, 0, 1, 1)], None, b"x"),
        ("r", None, "g.rs", "A", [(0, 0, 1, 1)], None, b"x"), ("q", None, "g.rs", "A", [(0, 0, 1, 1)], None, b"x"), ("r", None, "x/h.py", "A", [(0, 0, 1, 1)], None, b"x"),
    ]
    files = spark.createDataFrame(rows, f"range string, old string, new string, status string, hunks {D.HUNK}, base_content binary, head_content binary")
    recorded = spark.createDataFrame([("r", "g.stderr"), ("r", "g.stderr")], "range string, path string")
    done = D.collect_changes(files, ("python", "rust"), ("x/",), recorded)
    got = {(r.range, r.new): r.outcome for r in done.collect()}
    assert got == {
        ("r", "a.py"): "kept", ("r", "b.py"): "not_utf8", ("r", "c.txt"): "unknown", ("r", "d.py"): "no_hunks", ("r", "f.ts"): "other_language",
        ("r", "g.rs"): "ui_test", ("q", "g.rs"): "kept", ("r", "x/h.py"): "ignored",
    }
    assert done.where("new = 'a.py'").first().hunks[0].new_count == D.ALL_LINES
    kept, seen = D.kept_changes(done)
    assert kept.count() == 2
    assert seen.get == {"other_language": 1, "not_utf8": 1, "kept": 2}
    inside = spark.createDataFrame([("a/b.py",), ("ab/c.py",), ("a",)], "p string")
    assert {r.p for r in inside.where(D.below(F.col("p"), "a/")).collect()} == {"a/b.py", "a"}


def test_blame_carries_commits_over_untimed_lines(spark):
    a, b = "a" * 40, "b" * 40
    text = f"{a} 1 1 2\nauthor-time 5\n\tx\n{b} 2 2\nauthor-time soon\n\ty\nauthor-time 7\n\tz\nauthor-time 9\n\t{a} 1 1\n{a} 1 1\nauthor-time 3\n"
    rows = spark.createDataFrame([("f", text), ("g", None), ("h", "no tab")], "path string, text string")
    got = [(r.line, r.sha, r.author_ts) for r in D.parse_blame(rows).orderBy("line").collect()]
    assert got == [(0, a, 5), (1, None, None), (2, b, 7), (3, "", 9)]


def test_interval_join_keeps_each_pair_once(spark):
    import random

    rng = random.Random(2)
    left = [(rng.choice("fg"), i, lo := rng.randrange(300), lo + rng.randrange(-1, 90)) for i in range(80)] + [(None, 99, 0, 5)]
    right = [(rng.choice("fg"), i, lo := rng.randrange(300), lo + rng.randrange(0, 120)) for i in range(60)]
    want = {(a[1], b[1]) for a in left for b in right if a[0] == b[0] and a[2] <= a[3] and a[2] <= b[3] and b[2] <= a[3]}
    x = spark.createDataFrame(left, "path string, i int, s int, e int")
    y = spark.createDataFrame(right, "path string, j int, lo int, hi int")
    for bucket in (1, 16, 1000):
        got = [(r.i, r.j) for r in IV.interval_join(x, y, ["path"], ("s", "e"), ("lo", "hi"), bucket).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_file_of_a_million_lines_is_many_groups(spark):
    blame = spark.range(1_000_000).select(F.lit("f").alias("path"), F.col("id").alias("line"), F.sha1(F.col("id").cast("string").cast("binary")).alias("sha"), (F.col("id") % 1000).alias("author_ts"))
    items = spark.createDataFrame([("f", 1, 0, 10), ("f", 2, 500_000, 502_000), ("f", 3, 2_000_000, 2_000_001), ("g", 4, 0, 1)], "path string, item int, start_line long, end_line long")
    got = {r.item: r.author_ts for r in IV.latest_author(items, blame).collect()}
    assert got == {1: 10, 2: 999, 3: None, 4: None}
    plan = IV.latest_author(items, blame)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "__bucket" in plan


def test_line_ages(spark):
    day = 86400
    blame = spark.createDataFrame([("f", i, s * 40, t * day) for i, s, t in ((0, "a", 5), (1, "b", 5), (2, "c", 2), (3, "0", 9), (7, "d", 8))], "path string, line int, sha string, author_ts long")
    items = spark.createDataFrame(
        [("f", 1, 0, 1, 2, 2), ("f", 2, 2, 2, 2, 2), ("f", 3, 3, 3, 0, 3), ("f", 4, 5, 6, None, None), ("f", 5, 0, 0, 5, 7), ("f", 6, 0, 0, 5, 6)],
        "path string, item int, start_line int, end_line int, annotated_start int, annotated_end int",
    )
    got = {r.item: tuple(r)[2:] for r in IV.line_ages(items, blame, 9 * day + 5).collect()}
    assert got == {
        1: ("b" * 40, 4, 7, False), 2: ("c" * 40, 7, 7, False), 3: (None, 0, 4, False), 4: (None, None, None, None), 5: ("a" * 40, 4, 1, True), 6: ("a" * 40, 4, None, None),
    }


def test_first_containing(spark):
    items = spark.createDataFrame([("f", 1, 5, "x"), ("f", 1, 9, "y"), ("f", 4, 6, "z")], "path string, s int, e int, name string")
    points = spark.createDataFrame([("f", "p", 5), ("f", "q", 8), ("f", "r", 10), ("g", "s", 1)], "path string, id string, line int")
    got = {r.id: r.found and r.found.name for r in IV.first_containing(points, items.select("path", "s", "e", "name"), ["path"], "line", ("s", "e"), ["id"]).collect()}
    assert got == {"p": "x", "q": "y", "r": None, "s": None}


def test_closure_of_odd_graphs(spark):
    import random

    rng = random.Random(5)
    edges = [("p", f"n{a}", f"n{rng.randrange(40)}") for a in range(40) for _ in range(rng.choice((0, 1, 1, 2)))]
    edges += [("q", "a", "b"), ("q", "b", "c"), ("q", "c", "a"), ("q", "c", "d"), ("q", "d", None), ("q", "s", "s"), ("q", "s", "a"), ("q", "a", "b"), ("q", "a", "d")]
    edges += [("r", f"n{i}", f"n{i + 1}") for i in range(37)] + [(None, "x", "y"), (None, "y", "z")]
    want = {e for e in edges}
    while more := {(p, n, f) for p, n, a in want for q, m, f in edges if p == q and p is not None and a == m} - want:
        want |= more
    got = [tuple(r) for r in C.closure(spark.createDataFrame(edges, "path string, name string, base string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_closure_writes_each_pair_once(spark, monkeypatch):
    import pytest

    written, real = [], C.saved
    monkeypatch.setattr(C, "saved", lambda df, label: (out := real(df, label), written.append(out.count()))[0])
    edges = spark.range(2, 4000).select(F.lit(1).alias("path"), F.col("id").alias("name"), F.expr("id div 2").alias("base"))
    n = C.closure(edges).count()
    assert n == sum(i.bit_length() - 1 for i in range(2, 4000)) and sum(written) == n
    chain = spark.range(9).select(F.lit(1).alias("path"), F.col("id").alias("name"), (F.col("id") + 1).alias("base"))
    assert C.closure(chain, 4).count() == 45
    with pytest.raises(RuntimeError):
        C.closure(chain, 3)
