"""Toxicity scores from a counterfactual-regularised classifier.

Labelled sentences that name a group are repeated with the name swapped for another; the classifier pays for
every change of score under such swaps, so that a neutral mention of a group doesn't raise it. The names are a
table, built in or the caller's; labelled texts that hold none of them have no swaps, and nothing is penalised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textclf import FitParams, Model, fit, probabilities

#: Interchangeable identity terms, lower case; a parameter of the operator. Written for this library, partial.
IDENTITY_GROUPS = [
    "women men girls boys".split(),
    "woman man girl boy".split(),
    "christian muslim jewish hindu buddhist atheist".split(),
    "christians muslims jews hindus buddhists atheists".split(),
    "black white asian latino".split(),
    "african european american mexican chinese indian".split(),
    "gay straight lesbian bisexual heterosexual homosexual".split(),
    "immigrants refugees foreigners natives".split(),
    "frauen männer mädchen jungen".split(),
    "christen muslime juden hindus".split(),
    "ausländer einwanderer flüchtlinge einheimische".split(),
    "femmes hommes filles garçons".split(),
    "chrétiens musulmans juifs bouddhistes".split(),
    "immigrés réfugiés étrangers".split(),
    "mujeres hombres niñas niños".split(),
    "cristianos musulmanes judíos budistas".split(),
    "inmigrantes refugiados extranjeros".split(),
    "мусульмане христиане евреи буддисты".split(),
    "мигранты беженцы иностранцы".split(),
    "穆斯林 基督徒 犹太人 佛教徒".split(),
]


#: Chosen by ``fold_loss`` on rows outside the held-out fifth.
PARAMS = FitParams(min_z=3.0, l2=1e-4)


def held_out(id_col: str = "doc_id"):
    """True for the fifth of ids that no label is learned from; null ids are never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def load_groups(terms: DataFrame, most: int = 20_000) -> list[list[str]]:
    """Groups of interchangeable terms from ``terms(group, term, source)``, for ``fit_toxicity``.

    Terms are lower-cased; rows without a group, term or source are ignored, and groups of one term. The terms
    go to every task, so more than ``most`` rows are an error.
    """
    rows = terms.where("`group` is not null and term is not null and source is not null")
    rows = rows.select("group", F.lower("term").alias("term")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} identity terms")
    groups: dict = {}
    for r in sorted(rows, key=lambda r: (str(r["group"]), r["term"])):
        groups.setdefault(r["group"], []).append(r["term"])
    return [g for g in groups.values() if len(g) > 1]


def fold_loss(docs: DataFrame, labels: DataFrame, p: FitParams, groups=IDENTITY_GROUPS) -> float:
    """Mean log loss of the rows of four folds, each scored by a fit on the other three, for choosing parameters.

    Folds are the remainders of crc32(doc_id) by 5 that aren't 0, so the held-out fifth takes no part. Copies of
    a text may fall into several folds.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    right = F.when(F.col("toxic") == 1, F.col("score")).otherwise(1 - F.col("score"))
    loss, n = 0.0, 0
    for f in range(1, 5):
        model = fit_toxicity(docs, known.where(fold != f), groups, p)
        own = known.where(fold == f)
        scored = score_toxicity(docs.join(own, "doc_id", "left_semi"), model).join(own, "doc_id")
        got = scored.agg(F.sum(-F.log(F.greatest(F.lit(1e-6), right))).alias("loss"), F.count("*").alias("n")).first()
        loss, n = loss + (got["loss"] or 0.0), n + got["n"]
    return loss / max(1, n)


def fit_toxicity(docs: DataFrame, labels: DataFrame, groups=IDENTITY_GROUPS, p: FitParams = PARAMS) -> Model:
    """Fit on ``labels(doc_id, toxic)`` outside the held-out fifth; ids without documents are ignored.

    Terms to swap are those of ``groups``; with ``mine_swaps`` also what the labelled table shows to be alike.
    """
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").cast("string").alias("label"))
    return fit(docs, known, groups, p)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null and empty texts get the score of no features.

    Where no label was learned every score is 0. Repeated rows and ids, and null ids, are scored row by row;
    other columns are ignored.
    """
    scored = probabilities(docs, model)
    score = F.element_at("p", model.classes.index("1") + 1) if "1" in model.classes else F.lit(0.0)
    rows = scored.select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, groups=IDENTITY_GROUPS, p: FitParams = PARAMS) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, columns unchanged; rows are judged by their own text.

    Without labelled rows nothing can be learned and every row is kept.
    """
    model = fit_toxicity(docs, labels, groups, p)
    if "1" not in model.classes:
        return docs
    at, shared = model.classes.index("1"), docs.sparkSession.sparkContext.broadcast(model)
    kept: dict = {}

    @F.pandas_udf("boolean")
    def clean(texts):
        from .common import space_words

        score = kept.get("score") or kept.setdefault("score", shared.value.scorer())
        return texts.map(lambda t: bool(score(space_words(None if t is None else bytes(t)))[at] < 0.5))

    return docs.where(clean(F.col("text").cast("binary")))
