"""Mixing documents to target domain weights by soft membership.

A classifier fitted on a labelled table gives each document a posterior over domains. Nonnegative rates, one
for each document, are then fitted by distributed projected least squares, so that the expected domain shares
of all tokens match the targets. The rates closest to 1 that do so are max(0, 1 - p.step) for a single step of
one number per domain, found by Newton steps that take the second moments over the documents with a positive
rate only. Each is an aggregation to one row; the rates are an expression over the posteriors, never collected.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .textclf import FitParams, fit, probabilities


@dataclass(frozen=True)
class MixParams:
    #: Newton steps at one weight of closeness to 1; a fit that needs more is an error.
    max_steps: int = 25
    #: Largest distance of an expected share from its target at which the fit stops.
    tolerance: float = 1e-4
    #: Added to the diagonal of the step's metric, as a share of its trace.
    ridge: float = 1e-6


#: Domains differ in thousands of words; the clearest of them suffice. Small labelled tables show fewer: the clearest
#: 300 count in any case.
FIT = FitParams(min_z=8.0, l2=1e-3, least_features=300)


def posteriors(docs: DataFrame, labels: DataFrame, p: FitParams = FIT) -> tuple[DataFrame, list[str]]:
    """((doc_id, n_tokens, p), domains) of every row of ``docs``, from ``labels(doc_id, label)``."""
    model = fit(docs, labels, None, p)
    return probabilities(docs, model), model.classes


def _rate(n_domains: int, steps: list[np.ndarray]) -> Column:
    """Rates after the given steps: each takes the gradient off and projects to nonnegative rates."""
    rate = F.lit(1.0)
    for step in steps:
        down = F.lit(0.0)
        for k in range(n_domains):
            down = down + F.col("p")[k] * F.lit(float(step[k]))
        rate = F.greatest(F.lit(0.0), rate - down)
    return rate


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], p: MixParams = MixParams()) -> tuple[list[np.ndarray], dict]:
    """The step of the fit and a report; ``members(n_tokens, p)`` should be a stored table, it is read often.

    Finds the rates closest to 1 whose shares are within ``tolerance`` of the targets. If it is proven that no
    nonnegative rates reach them, ``met`` is false in the report and the rates are those of the least squared
    distance, to a thousandth, in the metric of the inverse second-moment matrix of the posteriors. A fit that
    ends in neither raises RuntimeError. Targets of absent domains are dropped and the others scaled to sum to
    1; all absent: no step, all rates 1.
    """
    k = len(domains)
    want = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    n = F.col("n_tokens").cast("double")
    held = members.where(n > 0)
    total = held.agg(F.sum(n)).first()[0] or 0.0
    if not total or not want.sum():
        return [], {"shares": {}, "steps": 0, "met": not want.sum()}
    want = want / want.sum()
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def at(step: np.ndarray):
        """Shares, second moments over positive rates, their half squared sum, least p.step and most rates' sum."""
        dot = sum((F.col("p")[i] * F.lit(float(step[i])) for i in range(k)), F.lit(0.0))
        rows = held.select("p", n.alias("n"), dot.alias("dot")).withColumn("rate", F.greatest(F.lit(0.0), 1.0 - F.col("dot")))
        on = F.when(F.col("rate") > 0, F.col("n")).otherwise(0.0)
        x = rows.agg(
            *[F.sum(F.col("n") * F.col("rate") * F.col("p")[i]) for i in range(k)], *[F.sum(on * F.col("p")[i] * F.col("p")[j]) for i, j in upper],
            F.sum(F.col("n") * F.col("rate") * F.col("rate")), F.min("dot"),
        ).first()
        moments = np.zeros((k, k))
        for (i, j), m in zip(upper, x[k:-2]):
            moments[i, j] = moments[j, i] = m / total
        return np.array(x[:k]) / total, moments, 0.5 * x[-2] / total, x[-1]

    step = np.zeros(k)
    shares, moments, half, least = at(step)
    metric = moments + p.ridge * np.trace(moments) * np.eye(k)  # all rates are 1
    taken, near, infeasible, met = 0, 1e-4, False, False
    while near > 1e-14:
        for _ in range(p.max_steps):
            gap = shares - want
            if met := bool(np.abs(gap).max() <= p.tolerance):
                break
            # For any rates, (shares - want).step is at least -want.step less what negative products p.step allow.
            low = -want @ step - max(0.0, -least) * (1 + k * p.tolerance)
            infeasible = infeasible or low > p.tolerance * np.abs(step).sum()
            slope = gap - near * metric @ step
            if np.abs(slope).max() <= 0.01 * p.tolerance * min(1.0, near / 1e-6):
                break
            towards = np.linalg.solve(moments + near * metric, slope)
            value = half + want @ step + 0.5 * near * step @ metric @ step
            size = 1.0
            while True:
                tried = step + size * towards
                found = at(tried)
                if found[2] + want @ tried + 0.5 * near * tried @ metric @ tried <= value - 1e-4 * size * slope @ towards or size < 1e-9:
                    break
                size /= 4
            taken, step = taken + 1, tried
            shares, moments, half, least = found
        else:
            raise RuntimeError(f"the rates did not settle in {p.max_steps} steps: shares {shares.tolist()}, targets {want.tolist()}")
        if met:
            break
        gap = shares - want
        distance = float(np.sqrt(gap @ np.linalg.solve(metric, gap)))
        bound = (-want @ step - max(0.0, -least) * (1 + np.sqrt(k) * distance)) / np.sqrt(step @ metric @ step)
        if infeasible and bound >= 0.999 * distance:
            break
        near /= 10
    else:
        raise RuntimeError(f"the rates reach shares {shares.tolist()} for targets {want.tolist()}, and no optimum is proven")
    return [step], {"shares": dict(zip(domains, shares.tolist())), "targets": dict(zip(domains, want.tolist())), "steps": taken, "met": met}


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], p: MixParams = MixParams(), fit_params: FitParams = FIT) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate, copies) of every row of ``docs``.

    ``domain`` is the likeliest, ``posterior`` maps domains to probabilities, ``rate`` is how often the
    document is to be read, ``copies`` the whole number that a seeded hash of doc_id rounds it to. Targets that
    no rates can reach give the closest ones and a warning. Null and
    empty texts have 0 tokens and the posterior of no features. Rows that repeat an id or have none are
    documents of their own; ties of ``domain`` go to the first by name; other columns are ignored. Without
    labelled rows every rate is 1, ``domain`` is null and ``posterior`` an empty map.
    """
    found, domains = posteriors(docs, labels, fit_params)
    members = saved(found, "posteriors")
    steps, report = fit_rates(members, domains, targets, p) if domains else ([], {"met": True})
    if not report["met"]:
        warnings.warn(f"no rates of these documents reach the targets; the closest are used: {report}", stacklevel=2)
    return with_rates(members, domains, steps)


def with_rates(members: DataFrame, domains: list[str], steps: list[np.ndarray]) -> DataFrame:
    rate = _rate(len(domains), steps)
    names = F.array(*[F.lit(d) for d in domains]).cast("array<string>")
    luck = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit("mix")), F.lit(1_000_000)) / 1_000_000
    return members.select(
        "doc_id", "n_tokens",
        F.try_element_at(names, F.nullif(F.array_position("p", F.array_max("p")), F.lit(0)).cast("int")).alias("domain"),
        F.map_from_arrays(names, "p").alias("posterior"),
        rate.alias("rate"),
    ).withColumn("copies", F.floor(F.col("rate") + luck))
