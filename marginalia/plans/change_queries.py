"""Queries of change sources and interval joins: diffs, path lists and blame texts are built from ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals as IV
from ..sources import diffs as DF
from .queries import BLOCKS, LINES, _items, query, t


def _text(template: str):
    """A text with ``{sql}`` parts."""
    return F.expr("concat(" + ", ".join(f"cast({p[1:-1]} as string)" if p[:1] == "{" else "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'" for p in _parts(template)) + ")")


def _parts(template: str) -> list[str]:
    import re

    return [p for p in re.split(r"(\{[^}]*\})", template) if p]


def diff_texts(docs: DataFrame) -> DataFrame:
    """One diff a document: a changed file whose new lines are the document's, a renamed one, a new one, at times a deleted one."""
    head = _text("diff --git a/src/{doc_id}.py b/src/{doc_id}.py\nindex 1..2 100644\n--- a/src/{doc_id}.py\n+++ b/src/{doc_id}.py\n@@ -{1 + doc_id % 5},{doc_id % 3} +{1 + doc_id % 7},{doc_id % 4} @@ def f\n")
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("+"), x)), "\n")
    more = _text("\n@@ -{20 + doc_id % 5} +{30 + doc_id % 7},2 @@\n-@@ -1 +1 @@\n--- evil\n+++ b/evil\n+diff --git a/x b/x\n@@ -x +y @@\n")
    moved = _text("diff --git a/old/{doc_id}.rs b/new/{doc_id}.rs\nsimilarity index 90%\nrename from old/{doc_id}.rs\nrename to new/{doc_id}.rs\n")
    moved = F.when(F.col("doc_id") % 2 == 0, F.concat(moved, _text("--- a/old/{doc_id}.rs\n+++ b/new/{doc_id}.rs\n@@ -3 +4 @@\n-x\n+y\n"))).otherwise(moved)
    added = _text("diff --git a/web/{doc_id}.ts b/web/{doc_id}.ts\nnew file mode 100644\n--- /dev/null\n+++ b/web/{doc_id}.ts\n@@ -0,0 +1,{doc_id % 4 + 1} @@\n+a\n")
    gone = F.when(F.col("doc_id") % 3 == 0, _text("diff --git a/notes/{doc_id}.md b/notes/{doc_id}.md\ndeleted file mode 100644\n--- a/notes/{doc_id}.md\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n")).otherwise("")
    return docs.select("doc_id", F.concat(head, body, more, moved, added, gone).alias("text"))


DIFFED = """files AS (SELECT doc_id, 'src/' || doc_id || '.py' AS old, 'src/' || doc_id || '.py' AS new, 'M' AS status,
    [(1 + doc_id % 5, doc_id % 3, 1 + doc_id % 7, doc_id % 4), (20 + doc_id % 5, 1, 30 + doc_id % 7, 2)] AS hunks, 1 AS n_invalid FROM documents
  UNION ALL SELECT doc_id, 'old/' || doc_id || '.rs', 'new/' || doc_id || '.rs', 'R', CASE WHEN doc_id % 2 = 0 THEN [(3, 1, 4, 1)] ELSE [] END, 0 FROM documents
  UNION ALL SELECT doc_id, NULL, 'web/' || doc_id || '.ts', 'A', [(0, 0, 1, doc_id % 4 + 1)], 0 FROM documents
  UNION ALL SELECT doc_id, 'notes/' || doc_id || '.md', 'notes/' || doc_id || '.md', 'D', [(1, 1, 0, 0)], 0 FROM documents WHERE doc_id % 3 = 0)"""
_HUNK_TEXT = "array_to_string([h[1] || ',' || h[2] || ' ' || h[3] || ',' || h[4] FOR h IN hunks], ';')"


@query(f"WITH {DIFFED} SELECT doc_id, old, new, status, {_HUNK_TEXT} AS hunks, n_invalid FROM files")
def diff_files(spark, sf):
    """Files, names and hunks read from diffs that hold whole documents."""
    found = DF.parse_diffs(diff_texts(t(spark, sf, "documents")))
    text = F.array_join(F.transform("hunks", lambda h: F.concat_ws(" ", F.concat_ws(",", h["old_start"], h["old_count"]), F.concat_ws(",", h["new_start"], h["new_count"]))), ";")
    return found.withColumn("hunks", text)


@query(f"""WITH {DIFFED} SELECT doc_id % 4 AS range, CASE WHEN new LIKE 'src/1%' THEN 'ignored' WHEN status = 'A' THEN 'other_language' WHEN status = 'R' AND doc_id % 8 = 0 THEN 'ui_test'
    WHEN len(hunks) = 0 THEN 'no_hunks' WHEN doc_id % 5 = 0 THEN 'not_utf8' ELSE 'kept' END AS outcome, count(*) AS n
  FROM files WHERE status <> 'D' GROUP BY ALL""")
def change_outcomes(spark, sf):
    """What becomes of every changed file, by commit range."""
    docs = t(spark, sf, "documents")
    files = DF.parse_diffs(diff_texts(docs)).withColumn("range", F.col("doc_id") % 4)
    content = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("FF")))).otherwise(F.encode("text", "utf-8")).alias("head_content"))
    files = files.join(content, "doc_id").withColumn("base_content", F.when(F.col("status") != "A", F.encode(F.lit("x"), "utf-8")))
    recorded = docs.where(F.col("doc_id") % 8 == 0).select((F.col("doc_id") % 4).alias("range"), F.concat(F.lit("new/"), F.col("doc_id"), F.lit(".stderr")).alias("path"))
    done = DF.collect_changes(files, ("python", "rust"), ("/src/1*.py",), recorded)
    return done.groupBy("range", "outcome").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, NULL AS old, 'n/' || doc_id || '.py' AS new, 'A' AS status FROM documents UNION ALL SELECT doc_id, lang || ' é.py', lang || ' é.py', 'M' FROM documents
  UNION ALL SELECT doc_id, 'A', 'M', 'R' FROM documents WHERE doc_id % 2 = 0""")
def changed_paths(spark, sf):
    """Paths of NUL-separated name-status lists."""
    added = F.concat(F.lit("A\0n/"), F.col("doc_id"), F.lit(".py\0"), F.lit("M\0"), "lang", F.lit(" é.py\0"))
    lists = t(spark, sf, "documents").select("doc_id", F.concat(added, F.when(F.col("doc_id") % 2 == 0, F.lit("R087\0A\0M\0")).otherwise("")).alias("text"))
    return DF.parse_name_status(lists)


_BLAME = """blamed AS (SELECT doc_id, line_no - 1 AS line, CASE WHEN line_no % 5 <> 0 THEN 1700000000 + (doc_id * 131 + line_no * 7919) % 5000000 END AS author_ts,
    CASE WHEN line_no % 6 = 0 THEN repeat('0', 40) ELSE sha1((doc_id * 100 + line_no // 3)::VARCHAR) END AS sha FROM lines)"""
_BLAMED = f"{LINES}, {_BLAME}"


def blame_texts(spark, sf) -> DataFrame:
    """Line-porcelain texts whose contents are the documents' lines; every fifth line has no time."""
    line = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.concat(
            F.when((i + 1) % 6 == 0, F.repeat(F.lit("0"), 40)).otherwise(F.sha1((F.col("doc_id") * 100 + F.floor((i + 1) / 3)).cast("string").cast("binary"))),
            F.lit(" 1 "), i.cast("string"), F.lit("\nauthor N\n"),
            F.when((i + 1) % 5 != 0, F.concat(F.lit("author-time "), (1700000000 + (F.col("doc_id") * 131 + (i + 1) * 7919) % 5000000).cast("string"), F.lit("\n"))).otherwise(""),
            F.lit("filename f\n\t"), x,
        ),
    )
    return t(spark, sf, "documents").select("doc_id", F.concat(F.array_join(line, "\n"), F.lit("\n")).alias("text"))


@query(f"WITH {_BLAMED} SELECT doc_id, line, CASE WHEN author_ts IS NOT NULL THEN sha END AS sha, author_ts FROM blamed")
def blame_lines(spark, sf):
    """Commit and time of every line, read from blame texts."""
    return DF.parse_blame(blame_texts(spark, sf))


_NOW = 1_705_000_000


@query(f"""WITH {BLOCKS}, {_BLAME}, items AS (
    SELECT doc_id AS path, block_no AS item, first_line - 1 AS s, last_line - 1 AS e, CASE WHEN block_no % 4 <> 0 THEN first_line - 1 END AS a, CASE WHEN block_no % 4 <> 0 THEN last_line - 1 + (block_no % 3) * 2 END AS z FROM blocks),
  known AS (SELECT doc_id AS path, line, sha, author_ts FROM blamed WHERE author_ts IS NOT NULL),
  c AS (SELECT path, item, arg_max(sha, (author_ts, line)) AS sha, max(author_ts) AS ts FROM items JOIN known USING (path) WHERE line BETWEEN s AND e GROUP BY ALL),
  k AS (SELECT path, item, max(author_ts) AS ts FROM items JOIN known USING (path) WHERE line BETWEEN a AND z AND (z <= e OR line > e) GROUP BY ALL)
  SELECT path, item, CASE WHEN regexp_matches(sha, '[^0]') THEN sha END AS sha, (CASE WHEN c.ts IS NOT NULL THEN greatest({_NOW} - c.ts, 0) // 86400 END) AS comment_age_days, (CASE WHEN k.ts IS NOT NULL THEN greatest({_NOW} - k.ts, 0) // 86400 END) AS code_age_days,
    (CASE WHEN k.ts IS NOT NULL THEN greatest({_NOW} - k.ts, 0) // 86400 END) < (CASE WHEN c.ts IS NOT NULL THEN greatest({_NOW} - c.ts, 0) // 86400 END) AS code_newer_than_comment FROM items LEFT JOIN c USING (path, item) LEFT JOIN k USING (path, item)""")
def comment_ages(spark, sf):
    """Ages of blocks and of the lines they annotate, from blame texts."""
    start, end, b = F.col("start_line") - 1, F.col("end_line") - 1, F.col("item")
    items = _items(t(spark, sf, "documents")).select("path", "item", start.alias("start_line"), end.alias("end_line"), F.when(b % 4 != 0, start).alias("annotated_start"), F.when(b % 4 != 0, end + (b % 3) * 2).alias("annotated_end"))
    return IV.line_ages(items, DF.parse_blame(blame_texts(spark, sf)).withColumnRenamed("doc_id", "path"), _NOW)


@query(f"""WITH {BLOCKS}, spread AS (SELECT doc_id, block_no, first_line AS s, last_line + block_no % 3 AS e FROM blocks)
  SELECT doc_id, 1 + doc_id % 9 AS line, (SELECT min((s, block_no))[2] FROM spread b WHERE b.doc_id = l.doc_id AND 1 + l.doc_id % 9 BETWEEN s AND e) AS item FROM labels l""")
def gold_parity(spark, sf):
    """For the line of each label the first block that holds it."""
    items = _items(t(spark, sf, "documents")).select(F.col("path").alias("doc_id"), "start_line", (F.col("end_line") + F.col("item") % 3).alias("end_line"), "item")
    points = t(spark, sf, "labels").select("doc_id", (1 + F.col("doc_id") % 9).alias("line"))
    found = IV.first_containing(points, items.select("doc_id", "start_line", "item", "end_line"), ["doc_id"], "line", ("start_line", "end_line"), ["doc_id"])
    return found.select("doc_id", "line", F.col("found.item").alias("item"))
