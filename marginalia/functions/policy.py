"""The threshold policy as column expressions over answers map<question, map<option, probability>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shipped thresholds.
THRESHOLDS = {
    "g1": 0.4, "api_delete": 0.2, "api_rewrite": 0.45, "c5_min": 0.5, "c2_min": 0.5, "rename": 0.5, "hazard": 0.3, "c3_min": 1.0,
    "leak": 0.6, "cap_lines": 1, "margin": 0.0, "use_holistic": False, "verify_preserves": 0.95, "verify_adds": 0.05,
    "verify_g1": 0.3, "stale_g1": 0.5, "rewrite": True, "ai_margin": 0.1,
}
VERDICTS = ("keep", "rewrite_shorter", "delete", "rename_instead", "fix_wrong_claim")
REPLACEABLE = {"no": 1.0, "partly": 0.5, "fully": 0.0}


def load_thresholds(overrides: dict | None = None) -> dict:
    unknown = set(overrides or {}) - set(THRESHOLDS)
    if unknown:
        raise ValueError(f"unknown thresholds: {sorted(unknown)}")
    return THRESHOLDS | (overrides or {})


def prob(answers: Column, question: str, option: str) -> Column:
    """A missing option of an answered question counts 0, a missing question is null."""
    dist = F.try_element_at(answers, F.lit(question))
    return F.when(dist.isNotNull(), F.coalesce(F.try_element_at(dist, F.lit(option)), F.lit(0.0)))


def expectation(dist: Column) -> Column:
    """Sum of option * probability in key order; null for a missing answer or an option that's no integer."""
    entries = F.array_sort(F.map_entries(dist))
    return F.aggregate(entries, F.lit(0.0), lambda s, e: s + e["key"].try_cast("int") * e["value"])


def replaceable_weight(dist: Column) -> Column:
    weight = lambda k: F.when(k == "no", 1.0).when(k == "partly", 0.5).when(k == "fully", 0.0)
    return F.aggregate(F.array_sort(F.map_entries(dist)), F.lit(0.0), lambda s, e: s + weight(e["key"]) * e["value"])


def argmax_first(dist: Column) -> Column:
    """The likeliest option, the first in key order of equal ones."""
    top = F.array_max(F.map_values(dist))
    return F.array_min(F.transform(F.filter(F.map_entries(dist), lambda e: e["value"] == top), lambda e: e["key"]))


def agrees(dist: Column, verdict: Column) -> Column:
    """The set of likeliest options is the verdict alone."""
    top = F.array_max(F.map_values(dist))
    best = F.transform(F.filter(F.map_entries(dist), lambda e: e["value"] == top), lambda e: e["key"])
    return (F.size(best) == 1) & F.array_contains(best, verdict)


def decide(kind: Column, comment: Column, answers: Column, unit: Column | None = None, th: dict | None = None) -> Column:
    """Verdict and the checks made, as struct<verdict, checks array<struct<name, value, threshold, scale>>>.

    Only comparisons that are reached count as checks: they alone can bring a verdict within the margin.
    """
    th = load_thresholds(th)
    q = lambda name: expectation(F.try_element_at(answers, F.lit(name)))
    g1, hazard, leak = (prob(answers, n, "true") for n in ("g1_contradicts", "hazard", "leak"))
    fully = prob(answers, "c9_replaceable", "fully")
    c2, c3, c5, c8 = (q(n) for n in ("c2_info_gain", "c3_rationale", "c5_contract", "c8_durability"))
    w = replaceable_weight(F.try_element_at(answers, F.lit("c9_replaceable")))
    api = (2 * c2 / 3 + 3 * c5 / 3 + 2 * c8 / 3 + 0.5 * w) / 7.5
    check = lambda name, value, t, scale=1.0: F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(float(t)).alias("threshold"), F.lit(float(scale)).alias("scale"))  # noqa: E731,E501
    lines = F.length(comment) - F.length(F.replace(comment, F.lit("\n"), F.lit(""))) + 1
    long = lines > th["cap_lines"]

    k_g1 = check("g1", g1, th["g1"])
    k_api = check("api_quality", api, th["api_delete"])
    k_c5 = check("c5", c5, th["c5_min"], 3)
    k_apr = check("api_quality", api, th["api_rewrite"])
    k_c2 = check("c2", c2, th["c2_min"], 3)
    k_ren = check("rename", fully, th["rename"])
    k_haz = check("hazard", hazard, th["hazard"])
    k_c3 = check("c3", c3, th["c3_min"], 3)
    k_leak = check("leak", leak, th["leak"])

    def out(verdict: str, *checks: Column) -> Column:
        empty = F.array().cast("array<struct<name:string,value:double,threshold:double,scale:double>>")
        return F.struct(F.lit(verdict).alias("verdict"), (F.array(*checks) if checks else empty).alias("checks"))

    need = lambda c, then: F.when(c.isNull(), out("review")).otherwise(then)
    api_tail = F.when(api < th["api_rewrite"], out("rewrite_shorter", k_g1, k_api, k_c5, k_apr)).otherwise(out("keep", k_g1, k_api, k_c5, k_apr))
    api_doc = need(api, F.when(api < th["api_delete"], out("delete", k_g1, k_api)).when(c5 < th["c5_min"], out("delete", k_g1, k_api, k_c5)).otherwise(api_tail))
    safe = need(leak, F.when((leak > th["leak"]) | long, out("rewrite_shorter", k_g1, k_c2, k_ren, k_haz, k_leak)).otherwise(out("keep", k_g1, k_c2, k_ren, k_haz, k_leak)))
    mild = F.when(long, out("rewrite_shorter", k_g1, k_c2, k_ren, k_haz, k_c3)).otherwise(out("keep", k_g1, k_c2, k_ren, k_haz, k_c3))
    low = need(c3, F.when(c3 < th["c3_min"], out("delete", k_g1, k_c2, k_ren, k_haz, k_c3)).otherwise(mild))
    inline = need(c2, F.when(c2 < th["c2_min"], out("delete", k_g1, k_c2)).otherwise(
        need(fully, F.when(fully > th["rename"], out("rename_instead", k_g1, k_c2, k_ren)).otherwise(
            need(hazard, F.when(hazard < th["hazard"], low).otherwise(safe))))))
    made = F.when(kind.isin("todo", "directive"), out("keep")).otherwise(
        need(g1, F.when(g1 > th["g1"], out("fix_wrong_claim", k_g1)).when(kind == "api_doc", api_doc).otherwise(inline)))

    close = F.exists(made["checks"], lambda c: F.abs(c["value"] - c["threshold"]) < F.lit(float(th["margin"])) * c["scale"])
    verdict = F.when(close, "review").otherwise(made["verdict"])
    if th["use_holistic"]:
        dist = F.try_element_at(answers, F.lit("verdict"))
        free = kind.isin("todo", "directive") | dist.isNull() | (verdict == "review")
        verdict = F.when(~free & ~agrees(dist, verdict), "review").otherwise(verdict)
    if unit is not None:
        verdict = F.when(verdict.isin("delete", "rename_instead") & unit.isNotNull(), F.when(long, "rewrite_shorter").otherwise("keep")).otherwise(verdict)
    return F.struct(verdict.alias("verdict"), made["checks"].alias("checks"))


def stale(answers: Column, th: dict | None = None) -> Column:
    limit = load_thresholds(th)["stale_g1"]
    return F.when(F.coalesce(prob(answers, "g1_contradicts", "true") > limit, F.lit(False)), "stale").otherwise("fresh")


def verify(preserves: Column, adds: Column, g1: Column, th: dict | None = None) -> Column:
    """The first reason to reject a rewrite, or null if it is accepted; missing scores reject."""
    t = load_thresholds(th)
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(bad(preserves > t["verify_preserves"]), "drops content")
        .when(bad(adds < t["verify_adds"]), "adds content")
        .when(bad(g1 < t["verify_g1"]), "contradicts the code")
    )


def softmax2(a: Column, b: Column) -> Column:
    """Probability of the second of two logits, shifted by the larger."""
    top = F.greatest(a, b)
    return F.exp(b - top) / (F.exp(a - top) + F.exp(b - top))


def guarded(verdict: Column, comment: Column, unit: Column, th: dict | None = None) -> Column:
    """A deletion or renaming next to a unit that only the comment gives becomes a rewrite, or nothing if it is short."""
    lines = F.length(comment) - F.length(F.replace(comment, F.lit("\n"), F.lit(""))) + 1
    kept = F.when(lines > load_thresholds(th)["cap_lines"], "rewrite_shorter").otherwise("keep")
    return F.when(verdict.isin("delete", "rename_instead") & unit.isNotNull(), kept).otherwise(verdict)


def judge_verdict(one_hot: Column, holistic: Column, kind: Column, comment: Column, answers: Column, unit: Column, th: dict | None = None) -> Column:
    """struct<verdict, checks>: the policy's, or, for judges that name a verdict outright and where there are no answers,
    the judge's own, with no checks; what it names is a review if it is no verdict."""
    made = decide(kind, comment, answers, unit, th)
    named = guarded(F.when(holistic.isin(*VERDICTS), holistic).otherwise("review"), comment, unit, th)
    none = F.array().cast("array<struct<name:string,value:double,threshold:double,scale:double>>")
    bare = F.coalesce(one_hot, F.lit(False)) | (F.size(F.coalesce(answers, F.create_map().cast("map<string,map<string,double>>"))) == 0)
    return F.when(kind.isin("todo", "directive"), F.struct(F.lit("keep").alias("verdict"), none.alias("checks"))).when(bare, F.struct(named.alias("verdict"), none.alias("checks"))).otherwise(made)


def _n_lines(text: Column) -> Column:
    parts = F.split(text, "\n", -1)
    return F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)


def shorter(candidate: Column, original: Column) -> Column:
    """Fewer lines, or as many and fewer characters."""
    a, b = _n_lines(candidate), _n_lines(original)
    return (a < b) | ((a == b) & (F.length(candidate) < F.length(original)))


def rewrite_fault(candidate: Column, unsafe: Column, original: Column, must_be_shorter: Column, preserves: Column, adds: Column, g1: Column, th: dict | None = None) -> Column:
    """Why a generated rewrite is rejected, the first reason that holds, or null; a rejected one never becomes a deletion."""
    return (
        F.when(F.coalesce(candidate, F.lit("")) == "", "generator gave no text").when(unsafe.isNotNull(), unsafe)
        .when(must_be_shorter & ~shorter(candidate, original), "not shorter").otherwise(verify(preserves, adds, g1, th))
    )


def breaks_second_tier(tier: Column, verdict: Column, has_edit: Column) -> Column:
    """Whether an item of the second tier has another verdict than keep or stale, or an edit: a fault of the run."""
    return F.coalesce(tier == "scope_changed", F.lit(False)) & (~F.coalesce(verdict.isin("keep", "stale"), F.lit(False)) | F.coalesce(has_edit, F.lit(False)))
