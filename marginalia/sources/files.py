"""Source trees, JSON-lines datasets and run files as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language, split_of


def ignore_regex(pattern: str) -> str:
    """One gitignore pattern, without its ``!``, as a regular expression over relative paths."""
    anchored = "/" in pattern.rstrip("/")
    body, folder = pattern.strip("/"), pattern.endswith("/")
    parts = {"**/": "(.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    words = re.findall(r"\*\*/|\*\*|\*|\?|\[!?\]?[^\]]*\]|[^*?\[]+|\[", body)
    out = "".join(parts.get(x) or ("[^" + x[2:] if x[:2] == "[!" else x if len(x) > 2 and x[0] == "[" else re.escape(x)) for x in words)
    return ("^" if anchored else "(^|/)") + out + ("/" if folder else "(/|$)")


def is_ignored(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether the last gitignore pattern that fits a relative path ignores it; ``!`` takes a path in again."""
    out = F.lit(False)
    for p in patterns:
        p = p.strip()
        if p and not p.startswith("#"):
            back = p.startswith("!")
            out = F.when(path.rlike(ignore_regex(p[back:])), F.lit(not back)).otherwise(out)
    return out


def source_files(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, lang, source) of known languages below ``root``; files that aren't UTF-8 are left out.

    Extension and ignore filters stand before the content is decoded; a Rust file whose ``.stderr``
    sibling exists is a recorded compiler output test and is dropped by an anti-join on the stem.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^[^:]*:/*", "/")
    files = files.withColumn("path", rel)
    top = F.lit(re.sub("^[^:]*:/*", "/", root).rstrip("/") + "/")
    relative = F.when(F.startswith("path", top), F.substring("path", F.length(top) + 1, F.length("path"))).otherwise(F.col("path"))
    files = files.where(~is_ignored(relative, ignore))
    stem = F.regexp_replace("path", r"\.(rs|stderr)$", "")
    recorded = files.where(F.col("path").endswith(".stderr")).select(stem.alias("stem")).distinct()
    known = files.withColumn("lang", language(F.col("path"))).where("lang is not null").withColumn("stem", F.when(F.col("lang") == "rust", stem))
    kept = known.join(recorded, "stem", "left_anti")
    return kept.where(F.is_valid_utf8(F.col("content"))).select("path", "lang", F.col("content").cast("string").alias("source"))


LABELS = (
    "struct<verdict:string,hazard:boolean,g1_contradicts:boolean,g1_unverifiable:boolean,leak:boolean,kind:string,c2_info_gain:int,"
    "c3_rationale:int,c4_level:string,c8_durability:int,c9_replaceable:string,c5_contract:int,c10_actionable:int,rewrite:string,rename_suggestion:string>"
)
GOLD = f"id string, source struct<repo:string>, language string, comment_kind string, placement string, comment string, annotated_code string, enclosing_scope string, labels {LABELS}"
COMMENTS = "id string, language string, source string, comment string, context string, output string, why string"
DOCSTRINGS = (
    "id string, kind string, name string, signature string, is_test boolean, in_test_file boolean, body_lines int, body_preview array<string>, "
    "docstring string, output string, why string, source string"
)
RUN = (
    "id string, judge string, answers map<string,map<string,double>>, verdict string, rewrite string, latency_ms double, input_tokens double, raw string, "
    "rewrite_scores struct<adds:double,g1_candidate:double,preserves:double>"
)


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the first comment format; a line that isn't such a row is an error, blank lines are none."""
    return spark.read.schema(COMMENTS).option("mode", "FAILFAST").json(path)


def read_docstrings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCSTRINGS).option("mode", "FAILFAST").json(path)


def is_gold(spark: SparkSession, path: str) -> bool:
    """Whether a JSON-lines file is in the second format: its first row has labels and a comment kind."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1)
    found = first.select(F.get_json_object("value", "$.labels").isNotNull() & F.get_json_object("value", "$.comment_kind").isNotNull()).first()
    return bool(found and found[0])


def read_gold(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Gold rows, of one split (train, dev or test) if given."""
    rows = spark.read.schema(GOLD).option("mode", "FAILFAST").json(path)
    return rows if split is None else rows.where(split_of(F.col("id")) == split)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run files by id: of rows that repeat an id, the last of the last file by name. An id that isn't a plain
    file name is an error when the rows are read."""
    rows = spark.read.schema(RUN).json(path).select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__at"))
    safe = F.when(F.col("id").rlike(r"^[A-Za-z0-9._-]+$"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("unsafe id "), F.coalesce("id", F.lit("null")))))
    columns = [c for c in rows.columns if not c.startswith("__")]
    last = rows.withColumn("id", safe).groupBy("id").agg(F.max_by(F.struct(*columns[1:]), F.struct("__file", "__at")).alias("r"))
    return last.select("id", "r.*")


def write_runs(runs: DataFrame, path: str) -> None:
    """JSON lines, one row for each id; unsafe ids are an error."""
    safe = F.when(F.col("id").rlike(r"^[A-Za-z0-9._-]+$"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("unsafe id "), F.coalesce("id", F.lit("null")))))
    runs.withColumn("id", safe).write.mode("overwrite").json(path)


def read_variants(spark: SparkSession, parts: str, gold: DataFrame) -> DataFrame:
    """Rows of all parts of a multi-part file (a glob), joined with their gold row on ``row_id``."""
    schema = "row_id string, variant string, candidate string, labels map<string,boolean>, answers map<string,double>"
    return spark.read.schema(schema).json(parts).join(gold.select(F.col("id").alias("row_id"), "comment", "annotated_code"), "row_id")


def missing_runs(gold: DataFrame, runs: DataFrame) -> DataFrame:
    return gold.join(runs.select("id"), "id", "left_anti")
