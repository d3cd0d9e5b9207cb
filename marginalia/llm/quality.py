"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps the measurements and one bit for each
failed rule. A policy is a versioned set of rules, so applying another policy, or asking what a rule costs,
reads the ledger's bits and never the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"[#*$%&|<>]"
_SYMBOL_BYTES = b"#*$%&|<>"
_NOT_SYMBOL = bytes(c for c in range(256) if c not in _SYMBOL_BYTES)
_CONTINUATION = bytes(range(0x80, 0xC0))
_NOT_ALPHA = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC0))

#: Measurements in the ledger, all longs.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha", "n_upper", "n_distinct_words",
)


def measure(data: bytes | None) -> tuple[int, ...]:
    """The MEASURES of one whole text; null: all 0."""
    if not data:
        return (0,) * len(MEASURES)
    words = data.split()
    n = len(words)
    word_bytes = sum(map(len, words))
    chars = word_bytes - (len(data) - len(data.translate(None, _CONTINUATION)))
    symbols = len(data.translate(None, _NOT_SYMBOL))
    lines = [x for x in data.split(b"\n") if not x.isspace() and x]
    ids: dict[bytes, int] = {}
    coded = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    letters = data.translate(None, _NOT_ALPHA)
    upper = sum(letters.count(bytes([c])) for c in range(65, 91)) if letters != letters.lower() else 0
    return (n, chars, symbols, len(lines) - len(set(lines)), _repeated(coded, len(ids)), len(lines), len(letters), upper, len(ids))


def _repeated(coded: np.ndarray, kinds: int, width: int = 5) -> int:
    """Words inside windows of ``width`` words that are found twice or more, the first included.

    Windows are named exactly, by sorting pairs of shorter windows' names; the memory is a few arrays of
    the text's length.
    """
    n = len(coded)
    if n <= width:
        return 0
    if kinds == n:
        return 0
    names, known, at = coded, kinds, 1
    while at < width:
        step = min(at, width - at)
        pair = names[:-step] * known + names[step:]  # overlapping where step < at
        _, names = np.unique(pair, return_inverse=True)
        known, at = int(names.max()) + 1, at + step
    twice = np.bincount(names)[names] > 1
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:n]) > 0).sum())


@dataclass(frozen=True)
class Rule:
    """A document fails when ``failed`` is true; it is an expression over MEASURES."""

    name: str
    failed: str


#: The order gives each rule its bit; append only, or stored ledgers change their meaning.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length_low", "word_chars < 2 * n_words"),
    Rule("word_length_high", "word_chars > 12 * n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("few_letters", "2 * n_alpha < word_chars"),
    Rule("shouting", "2 * n_upper > n_alpha"),
    Rule("few_kinds_of_words", "n_words >= 50 and 10 * n_distinct_words < n_words"),
)

#: Policies by version: the rules that reject a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "word_length_low", "word_length_high", "repeated_lines", "few_letters"),
    "v2": ("few_words", "repeated_windows", "symbols", "word_length_low", "word_length_high", "repeated_lines", "few_letters", "shouting", "few_kinds_of_words"),
}


def policy_mask(policy: str, rules=RULES, policies=POLICIES) -> int:
    at = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << at[name] for name in policies[policy])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(id_col, MEASURES, failed): one row for every document row, ``failed`` with one bit for each rule.

    Null and empty texts measure 0 everywhere, and so fail few_words only. Other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            rows = [measure(t) for t in batch.column(1).to_pylist()]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", *MEASURES])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    measured = rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = " | ".join(f"if({r.failed}, {1 << i}L, 0L)" for i, r in enumerate(rules))
    return measured.withColumn("failed", F.expr(bits)).withColumnRenamed("id", id_col)


def passes(policy: str, rules=RULES, policies=POLICIES) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy_mask(policy, rules, policies)).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: str, column: str = "kept", rules=RULES, policies=POLICIES) -> DataFrame:
    return rows.withColumn(column, passes(policy, rules, policies))


def ablations(rows: DataFrame, policies=POLICIES, rules=RULES) -> DataFrame:
    """(policy, rule, n_docs, n_kept, n_failed, n_only, n_kept_without, any_failed) for each rule of each policy.

    Documents are first counted by bit pattern with partial aggregation, so the rest of the work is over at
    most 2^rules patterns, whatever the number of documents. An empty ledger gives no rows.
    """
    patterns = rows.groupBy("failed").agg(F.count("*").alias("n"))
    cases = F.array(
        *[
            F.struct(F.lit(p).alias("policy"), F.lit(r.name).alias("rule"), F.lit(policy_mask(p, rules, policies)).cast("long").alias("mask"), F.lit(1 << i).cast("long").alias("bit"))
            for p in policies
            for i, r in enumerate(rules)
            if r.name in policies[p]
        ]
    )
    each = patterns.select("failed", "n", F.explode(cases).alias("c")).select("failed", "n", "c.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return each.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        total(hit == 0).alias("n_kept"),
        total(hit.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(hit == F.col("bit")).alias("n_only"),
        total(hit.bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
        F.bit_or(hit).alias("any_failed"),
    )
