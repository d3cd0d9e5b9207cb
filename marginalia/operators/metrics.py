"""Evaluation metrics over (gold, system) verdict pairs and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policy import VERDICTS, argmax_first

REMOVE = ("delete", "rename_instead")
REWRITE = ("rewrite_shorter", "fix_wrong_claim")


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("gold").pivot("system", [*VERDICTS, "review"]).count().na.fill(0)


def macro_f1(pairs: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Mean F1 over classes that occur in either column; 0 if none does."""
    classes = F.explode(F.array(*[F.lit(v) for v in VERDICTS]))
    each = pairs.withColumn("cls", classes).groupBy(*by, "cls").agg(
        F.count_if((F.col("gold") == F.col("cls")) & (F.col("system") == F.col("cls"))).alias("tp"),
        F.count_if((F.col("gold") == F.col("cls")) | (F.col("system") == F.col("cls"))).alias("either"),
    )
    # tp + fp + fn is the size of the union, and 2tp + fp + fn that plus tp.
    return each.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("either") > 0, 2 * F.col("tp") / (F.col("either") + F.col("tp")))), F.lit(0.0)).alias("macro_f1"))


def event_flags(pairs: DataFrame) -> DataFrame:
    """Flags of ``pairs(gold, system, hazard, adds, g1_candidate)`` and the weighted cost of each row."""
    g, s = F.col("gold"), F.col("system")
    review, removed = s == "review", s.isin(*REMOVE)
    lost = ~review & F.coalesce("hazard", F.lit(False)) & g.isin("keep", "rewrite_shorter") & removed
    score = lambda c: F.coalesce(F.col(c), F.lit(0.0)) > 0.5
    out = pairs.select(
        "*", review.alias("review"), lost.alias("hazard_lost"), (~lost & removed & ~g.isin(*REMOVE)).alias("wrong_delete"),
        (s.isin(*REWRITE) & (g == "keep")).alias("churn"), ((s == "keep") & (g != "keep")).alias("wrong_keep"),
        (s.isin(*REWRITE) & (score("adds") | score("g1_candidate"))).alias("error_introduced"),
    )
    n = lambda c: F.col(c).cast("int")
    return out.withColumn("cost", 0.5 * n("review") + 10 * n("hazard_lost") + 3 * n("error_introduced") + n("wrong_delete") + n("churn") + 0.3 * n("wrong_keep"))


def summary(flagged: DataFrame) -> DataFrame:
    """Counters, rates and cost in total, by language and by kind, from one pass over grouping sets."""
    ratio = lambda a, b: F.try_divide(a, b)
    n = F.count("*")
    pool = F.count_if(F.coalesce("hazard", F.lit(False)) & F.col("gold").isin("keep", "rewrite_shorter"))
    g = flagged.groupingSets([[], ["language"], ["kind"]], "language", "kind")
    return g.agg(
        n.alias("n"), *[F.count_if(c).alias(c) for c in ("review", "hazard_lost", "wrong_delete", "churn", "wrong_keep", "error_introduced")],
        F.sum("cost").alias("cost"), ratio(F.count_if("hazard_lost"), pool).alias("hazards_lost_rate"), ratio(F.count_if("review"), n).alias("review_rate"),
        ratio(F.count_if((F.col("gold") == F.col("system")) & ~F.col("review")), F.count_if(~F.col("review"))).alias("rest_accuracy"),
    )


def question_stats(rows: DataFrame) -> DataFrame:
    """(question, n, acc, brier) of ``rows(question, gold, dist)``; a gold option that has no probability costs 1 more."""
    r = rows.where(F.col("gold").isNotNull() & (F.size("dist") > 0))
    square = F.aggregate(F.map_entries("dist"), F.lit(0.0), lambda s, e: s + F.pow(e["value"] - (e["key"] == F.col("gold")).cast("int"), 2))
    absent = F.when(F.map_contains_key("dist", F.col("gold")), 0.0).otherwise(1.0)
    return r.groupBy("question").agg(
        F.count("*").alias("n"), F.avg((argmax_first(F.col("dist")) == F.col("gold")).cast("int")).alias("acc"), F.avg(square + absent).alias("brier")
    )


def percentile_index(values: DataFrame, by: list[str], col: str, q: float) -> DataFrame:
    """The value at index min(int(q n), n - 1) of the sorted values, from counts by value."""
    per = values.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("k"))
    whole = per.groupBy(*by).agg(F.sum("k").alias("n"))
    upto = per.withColumn("upto", F.sum("k").over(Window.partitionBy(*by).orderBy(col))).join(whole, by)
    past = upto.where(F.col("upto") > F.least(F.floor(F.col("n") * q), F.col("n") - 1))
    return past.groupBy(*by).agg(F.min(col).alias("value"))


def auc(scores: DataFrame, by: list[str]) -> DataFrame:
    """Area under the curve of ``scores(.., score, positive)`` from counts by score; null without both classes."""
    n = scores.groupBy(*by, "score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = n.withColumn("wins", F.col("p") * (below + F.col("q") / 2))
    return wins.groupBy(*by).agg(F.try_divide(F.sum("wins"), F.sum("p") * F.sum("q")).alias("auc"))


def best_threshold(scores: DataFrame, grid: list[float], cost: Column, tie_first: bool = True) -> DataFrame:
    """(grid_ix, threshold, total) of the cheapest grid point; ``cost`` may use the column threshold.

    The grid is a short parameter list exploded onto each row before a partial sum, so a row's cost is all
    that a grid point sees of it."""
    points = F.posexplode(F.array(*[F.lit(g) for g in grid])).alias("grid_ix", "threshold")
    totals = scores.select("*", points).groupBy("grid_ix", "threshold").agg(F.sum(cost).alias("total"))
    return totals.orderBy("total", F.asc("grid_ix") if tie_first else F.desc("grid_ix")).limit(1)


def reply_scores(rows: DataFrame) -> DataFrame:
    """One row of scores for ``rows(expected, verdict, text)`` of a first-format set: accuracy of deletions, precision and
    recall, and the mean lines and words of what is kept. Empty denominators count as 1; replies with an error
    (a null verdict) don't count."""
    gold, got = F.col("expected") == "DELETE", F.col("verdict") == "delete"
    text = F.regexp_replace("text", r"(?U)\A\s+|\s+\z", "")
    words = F.when(~got & (text != ""), F.size(F.split(text, r"(?U)\s+"))).otherwise(0)
    parts = F.split("text", "\n", -1)
    lines = F.when(~got, F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)).otherwise(0)
    least = lambda c: F.greatest(c, F.lit(1))
    sums = rows.where("verdict is not null").agg(
        F.count("*").alias("n"), F.count_if(gold == got).alias("agree"), F.count_if(gold).alias("gold"), F.count_if(got).alias("got"), F.count_if(gold & got).alias("both"),
        F.coalesce(F.sum(lines), F.lit(0)).alias("lines"), F.coalesce(F.sum(words), F.lit(0)).alias("words"),
    )
    c = F.col
    return sums.select(
        "n", (c("agree") / least(c("n"))).alias("accuracy"), (c("both") / least(c("got"))).alias("precision"), (c("both") / least(c("gold"))).alias("recall"),
        (c("lines") / least(c("n") - c("got"))).alias("kept_lines"), (c("words") / least(c("n") - c("got"))).alias("kept_words"),
    )
