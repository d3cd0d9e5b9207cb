"""Change sources from texts of version control: name-status lists, zero-context diffs, line-porcelain blame.

Each text is cut into relations within its row: a diff falls apart at its file headers, so that a hunk belongs to the
header in front of it by construction; content lines carry a prefix and can't be taken for headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import language
from .files import is_ignored

#: Lines of a whole file when there is nothing to compare it with.
ALL_LINES = 2**63 - 1
HUNK = "array<struct<old_start:bigint,old_count:bigint,new_start:bigint,new_count:bigint>>"
_ENTRY = r"\G(?:(R)[^\x00]*\x00([^\x00]+)\x00([^\x00]+)|([AM])\x00([^\x00]+))(?:\x00+|$)"
_HUNK_LINE = r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(?=[ \t\r\n]|$)"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def parse_name_status(lists: DataFrame, text: str = "text") -> DataFrame:
    """One row (other columns, old, new, status) for each path of NUL-separated lists of added, modified and renamed files.

    A text with anything else in it gives one row of status ``invalid`` and no path; null and empty texts give none.
    """
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\x00+", "")
    kinds = {k: _all(body, _ENTRY, g) for k, g in {"whole": 0, "renamed": 1, "from": 2, "to": 3, "kind": 4, "path": 5}.items()}
    n = F.aggregate(kinds["whole"], F.lit(0), lambda s, x: s + F.length(x))
    entries = F.transform(
        F.arrays_zip(*[v.alias(k) for k, v in kinds.items()]),
        lambda e: F.when(
            e["renamed"] == "R", F.struct(e["from"].alias("old"), e["to"].alias("new"), F.lit("R").alias("status"))
        ).otherwise(F.struct(F.when(e["kind"] == "M", e["path"]).alias("old"), e["path"].alias("new"), e["kind"].alias("status"))),
    )
    null = F.lit(None).cast("string")
    bad = F.array(F.struct(null.alias("old"), null.alias("new"), F.lit("invalid").alias("status")))
    rest = [c for c in lists.columns if c != text]
    return lists.select(*rest, F.explode(F.when(n == F.length(body), entries).otherwise(bad)).alias("e")).select(*rest, "e.*")


def parse_diffs(diffs: DataFrame, text: str = "text") -> DataFrame:
    """One row (other columns, old, new, status, hunks, n_invalid) for each file of unified diffs without context.

    ``hunks`` are in the order of the text, a count left out is 1. ``status`` is A, M, D or R. Hunk lines that can't
    be read are counted in ``n_invalid`` and left out. Quoted paths stay quoted. Null and empty texts give no rows.
    """
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), r"\ndiff --git ", -1), lambda p: p != "")
    rest = [c for c in diffs.columns if c != text]
    # What stands before the first header belongs to no file.
    files = diffs.select(*rest, F.posexplode(parts).alias("at", "part"), F.startswith(F.coalesce(text, F.lit("")), F.lit("diff --git ")).alias("begins"))
    files = files.where((F.col("at") > 0) | F.col("begins"))
    head = F.substring_index("part", "\n@@ ", 1)
    named = lambda pattern: F.nullif(F.regexp_extract(head, pattern, 1), F.lit(""))
    minus, plus = named(r"(?m)^--- (?:a/)?(.*?)\r?$"), named(r"(?m)^\+\+\+ (?:b/)?(.*?)\r?$")
    came, went = named(r"(?m)^rename from (.*?)\r?$"), named(r"(?m)^rename to (.*?)\r?$")
    # Without paths of their own (an empty file) both names are those of the header, which are equal.
    same = F.nullif(F.regexp_extract(head, r"\Aa/(.+) b/\1(?=\r?(?:\n|$))", 1), F.lit(""))
    new_file, gone = head.rlike(r"(?m)^new file mode "), head.rlike(r"(?m)^deleted file mode ")
    status = F.when(went.isNotNull(), "R").when(new_file | (minus == "/dev/null"), "A").when(gone | (plus == "/dev/null"), "D").otherwise("M")
    files = files.select(*rest, "part", came.alias("came"), went.alias("went"), F.coalesce(minus, same).alias("minus"), F.coalesce(plus, same).alias("plus"), status.alias("status"))
    number = lambda g, start: F.transform(_all(F.col("part"), _HUNK_LINE, g), lambda x: F.when(x == "", 1).otherwise(x.try_cast("bigint")))
    found = F.arrays_zip(*[number(g, 0).alias(k) for g, k in enumerate(("old_start", "old_count", "new_start", "new_count"), 1)])
    hunks = F.filter(found, lambda h: h["old_start"].isNotNull() & h["old_count"].isNotNull() & h["new_start"].isNotNull() & h["new_count"].isNotNull())
    return files.select(
        *rest,
        F.when(F.col("status") == "R", F.col("came")).when(F.col("status") != "A", F.col("minus")).alias("old"),
        F.when(F.col("status") == "R", F.col("went")).when(F.col("status") == "D", F.col("minus")).otherwise(F.col("plus")).alias("new"),
        "status",
        hunks.cast(HUNK).alias("hunks"),
        (F.size(_all(F.col("part"), r"(?m)^@@ ", 0)) - F.size(hunks)).alias("n_invalid"),
    )


def collect_changes(files: DataFrame, languages: tuple[str, ...] | None = None, ignore: tuple[str, ...] = (), snapshots: DataFrame | None = None) -> DataFrame:
    """``files(range, old, new, status, hunks, base_content, head_content)`` with ``lang`` and ``outcome``.

    Outcomes in the order in which they are settled: unknown (no language), ignored, other_language, ui_test (a Rust
    file whose recorded output, a row of ``snapshots(range, path)``, stands beside it), no_hunks, not_utf8, kept.
    Deleted files are left out. Contents are binary; a null base means that there is nothing to compare with, and then
    null hunks mean all lines. One pass: all counters are sums over ``outcome``.
    """
    new = F.col("new")
    rows = files.where("status <> 'D'").withColumn("lang", language(new))
    rows = rows.withColumn("hunks", F.coalesce("hunks", F.array(F.struct(*[F.lit(v).cast("bigint").alias(k) for k, v in {"old_start": 0, "old_count": 0, "new_start": 1, "new_count": ALL_LINES}.items()])).cast(HUNK)))
    recorded = F.lit(False)
    if snapshots is not None:
        stems = snapshots.where(F.col("path").endswith(".stderr")).select("range", F.regexp_replace("path", r"\.stderr$", "").alias("__stem"), F.lit(True).alias("__recorded")).distinct()
        # Only Rust files have a stem to look for; all others keep a null, which joins nothing.
        rows = rows.withColumn("__stem", F.when(F.col("lang") == "rust", F.regexp_replace(new, r"\.rs$", ""))).join(stems, ["range", "__stem"], "left")
        recorded = F.coalesce("__recorded", F.lit(False))
    readable = lambda c: F.coalesce(F.is_valid_utf8(F.col(c)), F.lit(True))
    wanted = F.col("lang").isin(*languages) if languages is not None else F.lit(True)
    outcome = (
        F.when(F.col("lang").isNull(), "unknown").when(is_ignored(new, ignore), "ignored").when(~wanted, "other_language").when(recorded, "ui_test")
        .when(F.size("hunks") == 0, "no_hunks").when(~readable("base_content") | ~readable("head_content") | F.col("head_content").isNull(), "not_utf8").otherwise("kept")
    )
    return rows.withColumn("outcome", outcome).drop("__stem", "__recorded")


def kept_changes(collected: DataFrame, name: str = "changes") -> tuple[DataFrame, Observation]:
    """The kept files, and an observation that holds the counters once any action has read them."""
    seen = Observation(name)
    counters = [F.count_if(F.col("outcome") == o).alias(o) for o in ("other_language", "not_utf8", "kept")]
    return collected.observe(seen, *counters).where("outcome = 'kept'"), seen


def below(path: Column, folder: str) -> Column:
    """Whether a path is the folder or stands below it; the empty folder holds all."""
    folder = folder.strip("/")
    return F.lit(True) if folder in ("", ".") else (path == folder) | F.startswith(path, F.lit(folder + "/"))


def parse_blame(blames: DataFrame, text: str = "text") -> DataFrame:
    """One row (other columns, line, sha, author_ts) for each line of line-porcelain texts; lines count from 0.

    A line's header ends with its content, which a tab begins. A line without a readable time has neither commit nor
    time, and its commit then goes over to the line behind it.
    """
    rest = [c for c in blames.columns if c != text]
    body = F.concat(F.lit("\n"), F.coalesce(text, F.lit("")))
    heads = F.split(body, r"\n\t[^\n]*", -1)  # the last one has no content behind it
    lines = blames.select(*rest, F.posexplode(F.slice(heads, 1, F.size(heads) - 1)).alias("line", "head"))
    last = lambda pattern: F.try_element_at(_all(F.col("head"), pattern, 1), F.lit(-1))
    read = lines.select(*rest, "line", last(r"\n([0-9A-Fa-f]{40}) ").alias("own"), last(r"\nauthor-time ([^\n]*)").try_cast("bigint").alias("author_ts"))
    order = Window.partitionBy(*rest).orderBy("line")
    before = F.coalesce(F.count("author_ts").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = F.last("own", ignorenulls=True).over(Window.partitionBy(*rest, "__run").orderBy("line"))
    known = read.withColumn("__run", before).withColumn("sha", F.coalesce(carried, F.lit("")))
    timed = F.col("author_ts").isNotNull()
    return known.select(*rest, "line", F.when(timed, F.col("sha")).alias("sha"), "author_ts")
