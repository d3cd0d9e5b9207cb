"""Joins of line intervals through fixed buckets of lines.

An interval is dealt out to the buckets it meets, so that the join is an equality on (path, bucket) with the exact
check behind it: a file with millions of lines fills many tasks. A pair that shares several buckets is kept in the
first of them alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 256


def _dealt(rows: DataFrame, lo: str, hi: str, bucket: int) -> DataFrame:
    first, last = (F.floor(F.col(c) / bucket).cast("long") for c in (lo, hi))
    return rows.where(F.col(lo) <= F.col(hi)).withColumn("__bucket", F.explode(F.sequence(first, last)))


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_range: tuple[str, str], right_range: tuple[str, str], bucket: int = BUCKET) -> DataFrame:
    """Pairs of rows with equal ``on`` whose closed ranges overlap; other columns of both must differ in name.

    Rows with a null in ``on`` or in a range, and ranges that end before they begin, meet nothing.
    """
    a, b = _dealt(left, *left_range, bucket), _dealt(right, *right_range, bucket)
    lo, hi = F.greatest(left_range[0], right_range[0]), F.least(left_range[1], right_range[1])
    met = a.join(b, [*on, "__bucket"]).where((lo <= hi) & (F.col("__bucket") == F.floor(lo / bucket)))
    return met.drop("__bucket")


def first_containing(points: DataFrame, items: DataFrame, on: list[str], at: str, item_range: tuple[str, str], key: list[str], bucket: int = BUCKET) -> DataFrame:
    """``points`` with ``found``, the item that holds the point and begins first (a struct of its columns), or null.

    ``key`` names a point; of items that begin together the one with the least columns is first.
    """
    lo, hi = item_range
    fields = [c for c in items.columns if c not in on]
    shaped = items.select(*on, F.struct(F.col(lo), *[F.col(c) for c in fields if c != lo]).alias("__item"), F.col(lo).alias("__lo"), F.col(hi).alias("__hi"))
    sited = points.select(*on, *[k for k in key if k not in on], F.col(at).alias("__at"), F.col(at).alias("__end"))
    met = interval_join(sited, shaped, on, ("__at", "__end"), ("__lo", "__hi"), bucket)
    best = met.groupBy(*[k for k in dict.fromkeys([*on, *key])], "__at").agg(F.min("__item").alias("found"))
    keys = list(dict.fromkeys([*on, *key]))
    return points.join(best.withColumnRenamed("__at", at), [*keys, *([at] if at not in keys else [])], "left")


def line_ages(items: DataFrame, blame: DataFrame, now: int, bucket: int = BUCKET) -> DataFrame:
    """(path, item, sha, comment_age_days, code_age_days, code_newer_than_comment) of every item.

    ``items(path, item, start_line, end_line, annotated_start, annotated_end)``, lines from 0 and inclusive;
    ``blame(path, line, sha, author_ts)``. The newest line counts, the later one of equal times. The comment's own
    lines aren't code, unless the code has no other. Unknown lines leave nulls; ``sha`` is null for lines that
    aren't committed.
    """
    span = lambda role, lo, hi: F.struct(F.lit(role).alias("role"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    roles = items.select("path", "item", "start_line", "end_line", "annotated_start", "annotated_end", F.explode(F.array(span("comment", "start_line", "end_line"), span("code", "annotated_start", "annotated_end"))).alias("r"))
    spans = roles.select("path", "item", "start_line", "end_line", "annotated_start", "annotated_end", "r.*")
    lines = blame.where("author_ts is not null").select("path", F.col("line").alias("at"), F.col("line").alias("till"), "sha", "author_ts")
    met = interval_join(spans, lines, ["path"], ("lo", "hi"), ("at", "till"), bucket)
    own = F.col("at").between(F.col("start_line"), F.col("end_line"))
    only_own = (F.col("annotated_start") >= F.col("start_line")) & (F.col("annotated_end") <= F.col("end_line"))
    newest = lambda cond: F.max(F.when(cond, F.struct("author_ts", "at", "sha")))
    per = met.groupBy("path", "item").agg(newest(F.col("role") == "comment").alias("c"), newest((F.col("role") == "code") & (only_own | ~own)).alias("k"))
    age = lambda c: F.when(F.col(c).isNotNull(), F.floor(F.greatest(F.lit(now) - F.col(c), F.lit(0)) / 86400))
    ages = per.select("path", "item", F.when(F.col("c.sha").rlike("[^0]"), F.col("c.sha")).alias("sha"), age("c.author_ts").alias("comment_age_days"), age("k.author_ts").alias("code_age_days"))
    known = items.select("path", "item").join(ages, ["path", "item"], "left")
    return known.withColumn("code_newer_than_comment", F.col("code_age_days") < F.col("comment_age_days"))


def latest_author(items: DataFrame, blame: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(path, item, sha, author_ts): the newest commit among an item's lines; null if none is known."""
    lines = blame.where("author_ts is not null").select("path", F.col("line").alias("at"), F.col("line").alias("till"), "sha", "author_ts")
    met = interval_join(items.select("path", "item", "start_line", "end_line"), lines, ["path"], ("start_line", "end_line"), ("at", "till"), bucket)
    newest: Column = F.max(F.struct("author_ts", "at", "sha")).alias("n")
    found = met.groupBy("path", "item").agg(newest).select("path", "item", "n.sha", "n.author_ts")
    return items.select("path", "item").join(found, ["path", "item"], "left")
