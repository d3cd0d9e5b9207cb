"""Findings as text lines, JSON, SARIF and agent advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an agent is told to do, by verdict.
RECOMMENDATIONS = {
    "review": "Delete or reduce via rewrite",
    "rewrite": "Reduce via rewrite",
    "fix": "Fix via rewrite: it may contradict the code",
    "rename": "Delete after renaming the code so the name says it",
    "stale": "Fix or delete: the code it describes changed",
}
# Checks in words.
SIGNALS = {
    "g1": "P(contradicts the code); fix above",
    "api_quality": "doc comment quality 0-1; delete below",
    "c5": "documents the contract a caller needs, 0-3; delete below",
    "c2": "information the code does not show, 0-3; delete below",
    "rename": "P(a rename could replace it); rename above",
    "hazard": "P(warns about a trap or hazard); keep at or above",
    "c3": "explains why, 0-3; keep at or above",
    "leak": "P(history or process the reader does not need); shorten above",
}


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def body() -> Column:
    """verdict (kind, tier) message; name=v/t, ...; evidence"""
    checks = F.array_join(F.transform("checks", lambda c: F.format_string("%s=%.2f/%.2f", c["name"], c["value"], c["threshold"])), ", ")
    said = F.format_string("%s (%s, %s) %s", "verdict", "kind", F.coalesce("tier", F.lit("")), "message")
    return F.concat_ws("; ", said, F.when(checks != "", checks), F.when(F.col("evidence") != "", F.col("evidence")))


def text_line() -> Column:
    """path:a-b: and the body"""
    return F.concat(F.format_string("%s:%d-%d: ", "path", "start_line", "end_line"), body())


def json_row() -> Column:
    return F.to_json(F.struct("path", "start_line", "end_line", "tier", "kind", "verdict", "checks", "evidence", "message"))


def advice_row() -> Column:
    signal = lambda c: F.struct(_lookup(SIGNALS, c["name"], "score").alias("signal"), (F.round(c["value"] * 100) / 100).alias("value"), c["threshold"].alias("threshold"))  # noqa: E731,E501
    return F.to_json(
        F.struct(
            "path", "start_line", "end_line", _lookup(RECOMMENDATIONS, F.col("verdict"), "Review").alias("recommendation"), "kind", "comment",
            F.transform("checks", signal).alias("signals"), "evidence",
        )
    )


def sarif(findings: DataFrame) -> DataFrame:
    """Result rows of a SARIF 2.1.0 log, each with its rule; rules(findings) lists the rules."""
    level = F.when(F.col("verdict").isin("delete", "reduce", "stale"), "warning").otherwise("note")
    region = F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"))
    location = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.concat(F.lit("comment/"), "verdict").alias("ruleId"), level.alias("level"), F.struct(body().alias("text")).alias("message"),
        F.array(location).alias("locations"), F.struct("kind", "tier", "checks", "evidence").alias("properties"),
    )
    return findings.select("path", "start_line", F.to_json(result).alias("result"))


def rules(findings: DataFrame) -> DataFrame:
    """Sorted distinct rules, at most one for each verdict."""
    return findings.select(F.concat(F.lit("comment/"), "verdict").alias("rule_id")).distinct().orderBy("rule_id")


def sarif_log(findings: DataFrame, tool: str = "marginalia", version: str = "1", most_results: int = 100_000) -> DataFrame:
    """One row with a whole SARIF 2.1.0 log: rules with descriptions, results in order of path and line.

    A log is one document, so it is made in one task; more than ``most_results`` findings are an error, and
    are to be written by ``write_sarif``.
    """
    found = sarif(findings)
    if found.limit(most_results + 1).count() > most_results:
        raise ValueError(f"more than {most_results} findings for one log")
    rows = found.agg(
        F.array_sort(F.collect_set(F.get_json_object("result", "$.ruleId"))).alias("names"),
        F.array_sort(F.collect_list(F.struct("path", "start_line", "result"))).alias("rows"),
    )
    rule = lambda r: F.concat(F.lit('{"id":"'), r, F.lit('","shortDescription":{"text":"Comment verdict: '), F.substring_index(r, "/", -1), F.lit('"}}'))
    head = F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"' + tool + '","version":"' + version + '","rules":[')
    log = F.concat(head, F.array_join(F.transform("names", rule), ","), F.lit("]}},\"results\":["), F.array_join(F.col("rows")["result"], ","), F.lit("]}]}"))
    return rows.select(log.alias("log"))


def write_sarif(findings: DataFrame, path: str) -> None:
    """A folder with the rules and the results as JSON lines, written by all tasks."""
    rules(findings).write.mode("overwrite").json(f"{path}/rules")
    sarif(findings).select("result").write.mode("overwrite").text(f"{path}/results")


def summary_line() -> Column:
    """``path: ...`` with the file's counts (deleted, lines_deleted, reduced, lines_reduced, review, rename, stale), zero
    parts left out; null where nothing was done or found."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    some = lambda c, *text: F.when(F.col(c) > 0, F.concat(*text))
    parts = F.concat_ws(
        ", ",
        some("deleted", n("deleted"), F.lit(" deleted ("), n("lines_deleted"), F.lit(" lines)")), some("reduced", n("reduced"), F.lit(" reduced ("), n("lines_reduced"), F.lit(" lines saved)")),
        some("review", n("review"), F.lit(" to review")), some("rename", n("rename"), F.lit(" rename suggested")), some("stale", n("stale"), F.lit(" stale")),
    )
    return F.when(parts != "", F.concat("path", F.lit(": "), parts))
