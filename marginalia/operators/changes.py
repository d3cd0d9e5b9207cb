"""Joins of items with change hunks, earlier versions and line authorship.

Every interval join carries an equality on the path, so that it is a hash or sort-merge join with a residual
condition and never a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved


def intersects(lo: Column, hi: Column, start: Column, count: Column) -> Column:
    return (count > 0) & (lo <= start + count - 1) & (hi >= start)


def touches(lo: Column, hi: Column, start: Column, count: Column) -> Column:
    """A pure deletion touches the line on either side of it."""
    return F.when(count > 0, intersects(lo, hi, start, count)).otherwise(intersects(lo, hi, start, F.lit(2)))


def overlap_join(items: DataFrame, hunks: DataFrame, path: str = "path") -> DataFrame:
    """Pairs of ``items(path, start_line, end_line)`` and ``hunks(path, new_start, new_count)`` that overlap."""
    i, h = items.alias("i"), hunks.alias("h")
    on = (F.col(f"i.{path}") == F.col(f"h.{path}")) & intersects(F.col("i.start_line"), F.col("i.end_line"), F.col("h.new_start"), F.col("h.new_count"))
    return i.join(h, on).select("i.*", *[F.col(f"h.{c}") for c in hunks.columns if c != path])


def tiers(items: DataFrame, hunks: DataFrame, old: DataFrame) -> DataFrame:
    """``items`` with tier: added, modified, scope_changed or untouched.

    items(path, item, start_line, end_line, kind, text, scope_start, scope_end) and, if there,
    annotated_start and annotated_end; hunks(path, old_start, old_count, new_start, new_count);
    old(path, start_line, end_line, kind, text). Old blocks are joined with the hunks that cut them first, so
    an item only meets hunks that reach it and what those replaced.
    """
    hunk, key = ["old_start", "old_count", "new_start", "new_count"], ["path", "item"]
    lo, hi, start, count = (F.col(c) for c in ("start_line", "end_line", "new_start", "new_count"))
    if "annotated_start" not in items.columns:
        items = items.withColumn("annotated_start", F.lit(None).cast("int")).withColumn("annotated_end", F.lit(None).cast("int"))
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))

    o = old.select("path", *[F.col(c).alias(f"o_{c}") for c in ("start_line", "end_line", "kind", "text")])
    cut = o.join(hunks.select("path", *hunk).distinct(), "path").where(intersects(F.col("o_start_line"), F.col("o_end_line"), F.col("old_start"), F.col("old_count")))
    touched = touches(F.col("scope_start"), F.col("scope_end"), start, count) | touches(F.col("annotated_start"), F.col("annotated_end"), start, count)
    scoped = F.coalesce(touched, touches(F.col("scope_start"), F.col("scope_end"), start, count), touches(F.col("annotated_start"), F.col("annotated_end"), start, count), F.lit(False))
    met = items.join(hunks.select("path", *hunk).distinct(), "path").withColumn("scoped", scoped).where(touches(lo, hi, start, count) | F.col("scoped"))
    side = met.join(cut.withColumnRenamed("o_kind", "kind"), ["path", "kind", *hunk], "left")
    # A deletion changes a block if the line left before or behind it belongs to its old and its new version.
    before = (F.col("o_start_line") < F.col("old_start")) & intersects(lo, hi, start, F.lit(1))
    behind = (F.col("o_end_line") >= F.col("old_start") + F.col("old_count")) & intersects(lo, hi, start + 1, F.lit(1))
    shift = lambda at, base: F.greatest(F.col(at) - F.col(base), F.lit(0))
    per_hunk = side.groupBy(*key, *hunk, "start_line", "end_line", "scoped").agg(
        flag(F.when(count > 0, intersects(lo, hi, start, count)).otherwise(before | behind)).alias("relevant"),
        flag(F.col("o_text") == F.col("text")).alias("carried"),
        flag(F.col("o_start_line").isNotNull() & (shift("o_start_line", "old_start") == shift("start_line", "new_start"))).alias("in_place"),
    )
    covered = F.when(F.col("relevant"), F.greatest(F.lit(0), F.least("end_line", start + count - 1) - F.greatest("start_line", "new_start") + 1)).otherwise(0)
    per_item = per_hunk.groupBy(*key).agg(
        flag(F.col("relevant") & ~F.col("carried")).alias("changing"), flag(F.col("relevant") & F.col("in_place")).alias("in_place"),
        flag(F.col("scoped")).alias("scoped"), F.sum(covered).alias("covered"), (F.first("end_line") - F.first("start_line") + 1).alias("span"),
    )
    known = old.select("path", "kind", "text", F.lit(True).alias("moved")).distinct()
    moved = items.select(*key, "kind", "text").join(known, ["path", "kind", "text"]).select(*key, "moved")
    modified = (F.col("covered") < F.col("span")) | F.col("moved").isNotNull() | F.col("in_place")
    tier = F.when(F.col("changing"), F.when(modified, "modified").otherwise("added")).when(F.col("scoped"), "scope_changed").otherwise("untouched")
    found = per_item.join(moved, key, "left").select(*key, tier.alias("tier"))
    return items.join(found, key, "left").withColumn("tier", F.coalesce("tier", F.lit("untouched")))


def nearest(left: DataFrame, right: DataFrame, on: list[str], left_id: str, left_at: str, right_at: str) -> DataFrame:
    """For each left row, the right row with equal ``on`` at the least distance, the first of equal ones.

    Both sides are put in one order, in which the last right row before and the first behind are the only ones
    to compare; nothing is paired.
    """
    null = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    rows = left.select(*on, F.col(left_id).alias("id"), F.col(left_at).alias("at"), null(right, right_at).alias("r_at"), F.lit(True).alias("is_left"))
    rows = rows.unionByName(right.select(*on, null(left, left_id).alias("id"), F.col(right_at).alias("at"), F.col(right_at).alias("r_at"), F.lit(False).alias("is_left")))
    up, down = Window.partitionBy(*on).orderBy("at"), Window.partitionBy(*on).orderBy(F.desc("at"))
    seen = rows.withColumn("low", F.last("r_at", ignorenulls=True).over(up)).withColumn("high", F.last("r_at", ignorenulls=True).over(down)).where("is_left")
    low, high = F.col("at") - F.col("low"), F.col("high") - F.col("at")
    at = F.when(F.col("high").isNull() | (low <= high), F.col("low")).otherwise(F.col("high"))
    return seen.select(F.col("id").alias(left_id), at.alias("nearest_at"), F.abs(F.col("at") - at).alias("distance")).where("nearest_at is not null")


def closure(edges: DataFrame, max_rounds: int = 20) -> DataFrame:
    """(path, name, ancestor) over ``edges(path, name, base)``, cycles included once.

    Pairs carry their distance. Round i extends only the pairs at distance 2^i, by all pairs found so far, so a
    pair in a tree is made once, and a chain of length n takes about log2 n rounds. What a round adds is written
    to shared storage beside what was there.
    """
    key = ["path", "name", "ancestor"]
    found = saved(edges.select("path", "name", F.col("base").alias("ancestor"), F.lit(1).alias("n")).distinct(), "closure")
    far, reach, rounds = found, 1, 0
    while not far.isEmpty():
        if rounds == max_rounds:
            raise RuntimeError(f"no closure in {max_rounds} rounds")
        up = found.select("path", F.col("name").alias("at"), "ancestor", (F.col("n") + reach).alias("n"))
        longer = far.select("path", "name", F.col("ancestor").alias("at")).join(up, ["path", "at"]).select(*key, "n")
        least = found.unionByName(longer).groupBy(*key).agg(F.min("n").alias("n"))
        added = saved(least.where(F.col("n") > reach), "closure")
        found, reach, rounds = found.unionByName(added), 2 * reach, rounds + 1
        far = added.where(F.col("n") == reach)
    return found.select(*key)


def quota(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """At most ``n`` rows of each group, in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
