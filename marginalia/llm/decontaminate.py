"""Benchmark decontamination: a broadcast hash set of test n-grams against all document windows.

The n-grams are broadcast in blocks of at most ``block_ngrams``, so what one task holds is bounded; a
benchmark of one block costs one scan, a larger one is scanned once for each block and the hits of a text
are merged afterwards.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words

#: Most n-grams of one broadcast: about 150 bytes each, 75 MB at most.
BLOCK_NGRAMS = 500_000


def windows(text: bytes | None, n: int) -> list[bytes]:
    """All n-word windows, space-joined; fewer words: the whole text; none: nothing."""
    words = alnum_words(text)
    k = min(n, len(words))
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if k else []


def benchmark_ngrams(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Distinct (ngram, item) of all items; null or wordless items and null ids give none."""

    def run(batches):
        for batch in batches:
            pairs = [
                (g, i)
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for g in set(windows(t, n))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in pairs], pa.binary()), pa.array([i for _, i in pairs], pa.string())],
                names=["ngram", "item"],
            )

    rows = benchmark.where("item_id is not null").select(
        F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")
    )
    return rows.mapInArrow(run, "ngram binary, item string").distinct()


class Matcher:
    """Finds every occurrence of a block's n-grams in a word list."""

    def __init__(self, pairs: list[tuple[bytes, str]]):
        self.items: dict[bytes, list[str]] = defaultdict(list)
        for gram, item in pairs:
            self.items[gram].append(item)
        self.lengths = sorted({g.count(b" ") + 1 for g in self.items})
        self.vocabulary = {w for g in self.items for w in g.split(b" ")}

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged half-open word spans inside any occurrence, and the items that occur."""
        if not self.lengths:
            return [], set()
        known, shortest = self.vocabulary, self.lengths[0]
        spans, found, at, total = [], set(), 0, len(words)
        flags = [w in known for w in words]
        while at < total:
            try:
                at = flags.index(True, at)
            except ValueError:
                break
            try:
                end = flags.index(False, at)
            except ValueError:
                end = total
            if end - at >= shortest:
                for k in self.lengths:
                    for i in range(at, end - k + 1):
                        items = self.items.get(b" ".join(words[i : i + k]))
                        if items:
                            spans.append((i, i + k))
                            found.update(items)
            at = end
        return merge(spans), found


def merge(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _scan(docs: DataFrame, block: list[tuple[bytes, str]], id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        matcher = Matcher(shared.value)
        for batch in batches:
            digests, n_words, spans, items = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = alnum_words(text)
                digests.append(xxhash.xxh3_128_digest(text or b""))
                hit, found = matcher.hits(words)
                n_words.append(len(words))
                spans.append([{"a": a, "b": b} for a, b in hit])
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                names=["id", "digest", "n_words", "spans", "items"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, digest binary, n_words long, spans array<struct<a:int,b:int>>, items array<string>")


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_ngrams: int = BLOCK_NGRAMS,
) -> DataFrame:
    """(id_col, n_words, spans, items) of every document row; spans are merged half-open word ranges.

    Null and wordless documents have no words and no spans. Rows stay rows, null and repeated ids among them,
    however many blocks of n-grams there are: the hits of a row are merged by its id and a digest of its text.
    """
    ngrams = benchmark_ngrams(benchmark, n)
    count = ngrams.count()
    blocks = max(1, -(-count // block_ngrams))
    part = F.pmod(F.xxhash64("ngram", "item"), F.lit(blocks))  # items too: a hot n-gram fills no block
    scans = []
    for b in range(blocks):
        rows = ngrams.where(part == b).collect()  # bounded: about block_ngrams, whatever the benchmark's size
        scans.append(_scan(docs, [(bytes(r[0]), r[1]) for r in rows], id_col, text_col))
    if blocks == 1:
        return scans[0].drop("digest").withColumnRenamed("id", id_col)
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    merged = out.groupBy("id", "digest").agg(
        (F.count("*") / blocks).cast("int").alias("rows"),
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def joined(spans):
        return spans.map(lambda s: [{"a": a, "b": b} for a, b in merge((x["a"], x["b"]) for x in s)])

    each = merged.withColumn("spans", joined("spans")).withColumn("rows", F.explode(F.sequence(F.lit(1), "rows")))
    return each.drop("digest", "rows").withColumnRenamed("id", id_col)


def report(leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of a leak table: counts, items and their checksum."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["b"] - s["a"]).cast("long"))
    return leaks.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def cut_words(text: str | None, spans) -> str | None:
    """The text without the words of the spans and what stands between them; the rest byte for byte."""
    if not text or not spans:
        return text
    data = text.encode()
    marked, word, inside = [], -1, False
    plain = data.translate(_WORD_OR_SPACE)
    for i, c in enumerate(plain):
        if c == 32:
            inside = False
        elif not inside:
            inside, word = True, word + 1
            marked.append(i)
    out, at = [], 0
    for a, b in spans:
        start = marked[a]
        stop = plain.find(b" ", marked[b - 1])
        out.append(data[at:start])
        at = len(data) if stop < 0 else stop
    out.append(data[at:])
    return b"".join(out).decode()


_WORD_OR_SPACE = bytes(c if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, action: str = "drop", n: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``drop``: documents without hits, unchanged. ``cut``: all documents, hit words removed from the text.

    Each row is judged by its own text, also where its id is null or that of other rows.
    """
    if action not in ("drop", "cut"):
        raise ValueError(f"unknown action {action!r}")
    # Spans belong to a text, so rows that repeat an id with another text have hits of their own.
    keyed = docs.withColumn("__key", F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")))
    hit = find_leaks(keyed, benchmark, n, "__key", text_col).where(F.size("spans") > 0)
    hit = hit.select(F.col("__key").alias("__hit"), F.col("spans").alias("__spans")).dropDuplicates(["__hit"])
    same = F.col("__key").eqNullSafe(F.col("__hit"))
    if action == "drop":
        return keyed.join(hit.select("__hit"), same, "left_anti").select(*docs.columns)

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, lambda t, s: cut_words(t, [] if s is None else [(x["a"], x["b"]) for x in s]))

    joined = keyed.join(hit, same, "left")
    return joined.withColumn(text_col, cut(F.col(text_col), F.col("__spans"))).select(*docs.columns)


def items_digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
