"""Curation of judged comments: validation of gold rows, mining of pull requests, screening and escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# What a gold row's fields may hold.
ENUMS = {
    "language": ("python", "typescript", "tsx", "javascript", "rust", "yaml"),
    "comment_kind": ("inline", "api_doc", "todo", "directive"),
    "placement": ("before_statement", "trailing", "function_head", "class_head", "module_head"),
}
VERDICTS = ("keep", "rewrite_shorter", "delete", "rename_instead", "fix_wrong_claim")
LABEL_ENUMS = {
    "kind": (
        "rationale", "summary", "contract", "invariant", "warning", "alternatives_rejected", "todo", "directive", "restating", "commented_out_code",
        "journal_or_history", "banner", "cross_reference_leak", "change_narration",
    ),
    "c4_level": ("same_level_narration", "higher_summary", "lower_precision", "mental_model"),
    "c9_replaceable": ("fully", "partly", "no"),
    "verdict": VERDICTS,
}
FLAGS = ("g1_contradicts", "g1_unverifiable", "hazard", "leak")
SCORES = ("c2_info_gain", "c3_rationale", "c8_durability")
STATES = ("confirmed", "contradicted", "unverifiable")
REQUIRED = ("id", "language", "comment_kind", "placement", "comment", "annotated_code", "enclosing_scope", "labels", "claims")
COMMENT_LINE = r"^\+\s*(#|//|/\*|\*)"


def gold_errors(labels: str = "labels") -> Column:
    """The faults of a gold row with the fields REQUIRED, empty if none.

    A null field is missing; a row with a missing field has no other fault. ``claims`` are the states of its claims.
    """
    lab = lambda name: F.col(f"{labels}.{name}")
    sure = lambda c: F.coalesce(c, F.lit(False))
    filled = lambda name: sure(lab(name) != "")
    missing = F.array_compact(F.array(*[F.when(F.col(labels if k == "labels" else k).isNull(), f"missing {k}") for k in REQUIRED]))
    found = [F.when(~sure(F.col(k).isin(*v)), f"{k} not in enum") for k, v in ENUMS.items()]
    found += [F.when(~sure(lab(k).isin(*v)), f"labels.{k} not in enum") for k, v in LABEL_ENUMS.items()]
    found += [F.when(lab(k).isNull(), f"labels.{k} must be bool") for k in FLAGS]
    found += [F.when(~sure(lab(k).between(0, 3)), f"labels.{k} must be int 0-3") for k in SCORES]
    for name, kind in (("c5_contract", "api_doc"), ("c10_actionable", "todo")):
        wanted = sure(F.col("comment_kind") == kind)
        found.append(F.when(wanted & lab(name).isNull(), f"labels.{name} must be set").when(~wanted & lab(name).isNotNull(), f"labels.{name} must be null").when(~lab(name).between(0, 3), f"labels.{name} must be 0-3"))
    needs = sure(lab("verdict").isin("rewrite_shorter", "fix_wrong_claim"))
    found.append(F.when(needs & ~filled("rewrite"), "rewrite required").when(~needs & filled("rewrite"), "rewrite must be null"))
    renames = sure(lab("c9_replaceable") == "fully") | sure(lab("verdict") == "rename_instead")
    found.append(F.when(renames & ~filled("rename_suggestion"), "rename_suggestion required"))
    states = F.col("claims")
    wrong, unknown = (sure(F.array_contains(states, s)) for s in STATES[1:])
    found.append(F.when(F.exists(states, lambda s: ~sure(s.isin(*STATES))), "claim status not in enum"))
    found.append(F.when(~lab("g1_contradicts").eqNullSafe(wrong), "g1_contradicts disagrees with claims"))
    found.append(F.when(~lab("g1_unverifiable").eqNullSafe(unknown & ~wrong), "g1_unverifiable disagrees with claims"))
    found.append(F.when(sure(lab("g1_contradicts")) & ~sure(lab("verdict").isin("fix_wrong_claim", "delete")), "g1_contradicts but kept"))
    found.append(F.when(~F.contains(T.squash(F.col("enclosing_scope")), T.squash(F.col("annotated_code"))), "enclosing_scope lacks annotated_code"))
    return F.when(F.size(missing) > 0, missing).otherwise(F.array_compact(F.array(*found)))


def mine(pulls: DataFrame, repos: DataFrame, details: DataFrame, agents, languages, licenses, files: str, least_stars: int = 50, least_lines: int = 3) -> DataFrame:
    """Merged pull requests of agents with comment lines in permissively licensed repositories, with their number.

    pulls(id, repo_id, agent, merged_at), repos(id, language, license, stars, is_forked), details(pr_id,
    filename, patch). Filters come before the joins, and patches are counted in their row and summed before
    they meet the pull requests.
    """
    known = repos.where(F.col("language").isin(*languages) & F.col("license").isin(*licenses) & (F.col("stars") > least_stars) & ~F.col("is_forked"))
    known = known.select(F.col("id").alias("repo_id"), "language")
    added = F.size(F.filter(F.split("patch", "\n"), lambda x: x.rlike(COMMENT_LINE))).cast("long")
    lines = details.where(F.col("filename").rlike(files) & F.col("patch").isNotNull()).groupBy(F.col("pr_id").alias("id")).agg(F.sum(added).alias("n_lines"))
    merged = pulls.where(F.col("merged_at").isNotNull() & F.col("agent").isin(*agents)).select("id", "repo_id", "agent")
    return merged.join(known, "repo_id").join(lines.where(F.col("n_lines") >= least_lines), "id")


def screened(items: DataFrame, cache: DataFrame, most_tokens: int = 4096) -> DataFrame:
    """``items(key, tier, language, n_tokens, classified)`` with ``path``: untouched, direct, cached, classified or error.

    Untouched items are counted but not judged. Other languages than Python and items of the second tier go
    to the judge directly, as do those too long to classify; ``cache(key)`` holds what was judged before.
    """
    known = cache.select("key").distinct().withColumn("hit", F.lit(True))
    return items.join(known, "key", "left").withColumn(
        "path",
        F.when(F.col("tier") == "untouched", "untouched").when((F.col("language") != "python") | (F.col("tier") == "scope_changed"), "direct")
        .when(F.col("hit"), "cached").when(F.col("n_tokens") > most_tokens, "direct").when(F.col("classified"), "classified").otherwise("error"),
    ).drop("hit")


def gated_out(has_judge: bool = True, tier: str = "tier", mentions: str = "changed_mentions") -> Column:
    """Whether an item of the second tier is kept without a judge: the change touched nothing that the comment says, or
    there is no judge for it. Mentions that aren't known (null) don't gate."""
    untouched = F.coalesce(F.size(F.col(mentions)) == 0, F.lit(False)) & F.col(mentions).isNotNull()
    return F.coalesce(F.col(tier) == "scope_changed", F.lit(False)) & (untouched if has_judge else F.lit(True))


def gated(items: DataFrame, has_judge: bool = True) -> DataFrame:
    """The items that a judge must see."""
    return items.where(~gated_out(has_judge))


def escalated(verdicts: DataFrame, second: DataFrame) -> DataFrame:
    """``verdicts(key, verdict)`` with those under review replaced by what ``second(key, verdict)`` says, if it does."""
    again = second.select("key", F.col("verdict").alias("escalated"))
    open_ = F.col("verdict") == "review"
    return verdicts.join(again, "key", "left").withColumn("verdict", F.when(open_, F.coalesce("escalated", "verdict")).otherwise(F.col("verdict"))).drop("escalated")
