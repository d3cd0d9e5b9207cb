"""Evaluation of rewrite verification: accept rates, per-question reports and the threshold grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics as M
from .tuning import cumulate, dense

# The thresholds that are tried.
GRID_PRESERVES = (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99)
GRID_BELOW = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 1.01)
QUESTIONS = ("preserves", "adds", "g1_candidate")


def accepts(preserves: Column, adds: Column, g1: Column) -> Column:
    """Whether the answers (columns named by QUESTIONS) pass; a missing one doesn't help."""
    p, a, g = (F.coalesce(F.col(q), F.lit(d)) for q, d in zip(QUESTIONS, (0.0, 1.0, 1.0)))
    return (p > preserves) & (a < adds) & (g < g1)


def accept_rates(scored: DataFrame, preserves=GRID_PRESERVES, adds=GRID_BELOW, g1=GRID_BELOW) -> DataFrame:
    """Accepted and all candidates by variant at every point of the three axes (ascending values).

    ``scored(variant, good, preserves, adds, g1_candidate)``: gold candidates count where they are good, false
    accepts are those of ``drop`` and ``invent``, other variants don't count. Each candidate is counted once, in the
    cell of the strictest axis values that accept it; sums along the axes give every point (see tuning.cumulate).
    """
    gold, bad = (F.col("variant") == "gold") & F.col("good"), F.col("variant").isin("drop", "invent")
    p, a, g = (F.coalesce(F.col(q), F.lit(d)) for q, d in zip(QUESTIONS, (0.0, 1.0, 1.0)))
    met = lambda conditions: reduce(lambda x, y: x + y, [c.cast("int") for c in conditions])
    cells = scored.where(gold | bad).select(
        "variant",
        (F.lit(len(preserves)) - met([p > x for x in preserves])).alias("p0"),  # first values accept: counted from the end
        (F.lit(len(adds)) - met([a < x for x in adds])).alias("p1"),
        (F.lit(len(g1)) - met([g < x for x in g1])).alias("p2"),
    )
    kinds = ("gold", "drop", "invent")
    counted = cells.groupBy("p0", "p1", "p2").agg(*[F.count_if(F.col("variant") == v).alias(v) for v in kinds])
    # One place more on each axis holds what no point accepts, so the far corner has the totals.
    shape = [len(preserves) + 1, len(adds) + 1, len(g1) + 1]
    full = dense(scored.sparkSession, {"": shape}, ["p0", "p1", "p2"]).drop("leaf").join(counted, ["p0", "p1", "p2"], "left").na.fill(0, kinds)
    sums = cumulate(full, [], ["p0", "p1", "p2"], kinds)
    corner = reduce(lambda x, y: x & y, [F.col(f"p{i}") == n - 1 for i, n in enumerate(shape)])
    totals = sums.where(corner).select(F.col("gold").alias("gold_total"), (F.col("drop") + F.col("invent")).alias("bad_total"))
    at = lambda values, i: F.get(F.array(*[F.lit(float(v)) for v in values]), i)
    inside = sums.where((F.col("p0") < len(preserves)) & (F.col("p1") < len(adds)) & (F.col("p2") < len(g1)))
    return inside.join(F.broadcast(totals), F.lit(True)).select(
        at(preserves, F.lit(len(preserves) - 1) - F.col("p0")).alias("th_preserves"), at(adds, F.col("p1")).alias("th_adds"), at(g1, F.col("p2")).alias("th_g1"),
        F.col("gold").alias("gold_accepted"), "gold_total", (F.col("drop") + F.col("invent")).alias("bad_accepted"), "bad_total",
        F.col("drop").alias("drop_accepted"), F.col("invent").alias("invent_accepted"),
    )


def tune(rates: DataFrame, most_false: int) -> DataFrame:
    """The thresholds with most gold accepted and at most ``most_false`` false accepts; of equal ones the strictest."""
    key = F.struct("gold_accepted", "th_preserves", (-F.col("th_adds")).alias("a"), (-F.col("th_g1")).alias("g"))
    best = rates.where(F.col("bad_accepted") <= most_false).agg(F.max_by(F.struct(*rates.columns), key).alias("best"))
    return best.where("best is not null").select("best.*")


def question_report(scored: DataFrame) -> DataFrame:
    """(question, n, positives, acc, auc, mean_gold, mean_other) of ``scored(variant, labels, answers)``, both maps."""
    rows = scored.select("variant", "labels", F.explode("answers").alias("question", "p")).select("variant", "question", "p", F.col("labels")[F.col("question")].alias("positive"))
    per = rows.groupBy("question").agg(
        F.count("*").alias("n"), F.count_if("positive").alias("positives"), F.avg(((F.col("p") > 0.5) == F.col("positive")).cast("int")).alias("acc"),
        F.coalesce(F.avg(F.when(F.col("variant") == "gold", F.col("p"))), F.lit(0.0)).alias("mean_gold"),
        F.coalesce(F.avg(F.when(F.col("variant") != "gold", F.col("p"))), F.lit(0.0)).alias("mean_other"),
    )
    return per.join(M.auc(rows.withColumnRenamed("p", "score"), ["question"]), "question")
