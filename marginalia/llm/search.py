"""Ranked lexical search over a document-sharded index with precomputed integer impacts.

Building: tasks cut their documents into shards of bounded size. A shard is one row: its document ids, its terms,
and compressed sparse rows of postings (document place, impact) by term. A posting's impact holds all that depends
on the document, from the corpus totals of one earlier pass; the weight of a term is set when a query is run.

Searching: a bounded block of query items is broadcast; each shard adds weight times impact, term at a time, to a
dense accumulator over its documents. The best k are cut by partition at the k-th score with all its ties, sorted
by (score, id), and merged in the task, so that a task hands on k rows an item; a last window merges the tasks.

Null and wordless texts have no terms, aren't counted and are never found. Rows that repeat a document id are
documents of their own; null document ids come last among equal scores. Rows that repeat an item id are one item
with the terms of all of them. An empty index or no items gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import alnum_words, forget, saved

#: A shard closes at this many documents or postings, whichever comes first; one document never spans two.
SHARD_DOCS, SHARD_POSTINGS = 4096, 262_144
#: Most (item, term) pairs of one broadcast, about 100 bytes each; more items are searched in further blocks.
BLOCK_TERMS = 500_000

_SHARD = "ids array<{kind}>, terms binary, offsets binary, places binary, impacts binary"


@dataclass(frozen=True)
class Impact:
    """impact = scale * tf div (tf_unit * tf + length_unit * m), m = 100 - b + (b * n * N) div L."""

    b: int = 90
    length_unit: int = 8
    tf_unit: int = 1000
    scale: int = 1_000_000_000

    def __post_init__(self):
        if not 0 <= self.b <= 100 or self.scale // self.tf_unit >= 1 << 31:
            raise ValueError("b is a percentage, and impacts (under scale / tf_unit) are kept in 32 bits")

    def of(self, tf: np.ndarray, n: int, n_docs: int, n_terms: int) -> np.ndarray:
        m = 100 - self.b + (self.b * n * n_docs) // n_terms  # whole numbers of any size
        if self.length_unit * m >= 1 << 62:
            return np.array([self.scale * int(x) // (self.tf_unit * int(x) + self.length_unit * m) for x in tf], np.int64)
        return (self.scale * tf) // (self.tf_unit * tf + self.length_unit * m)


@dataclass(frozen=True)
class Index:
    shards: DataFrame
    n_docs: int
    n_terms: int

    def forget(self) -> None:
        """Delete the shards; nothing may search them afterwards."""
        forget(self.shards)


class _Shard:
    """Collects documents, then lays out their postings by term."""

    def __init__(self):
        self.ids, self.codes = [], {}
        self.terms, self.tfs, self.impacts = [], [], []
        self.postings = 0

    def add(self, doc, words: list[bytes], impact: Impact, n_docs: int, n_terms: int) -> None:
        codes = self.codes
        coded = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
        term, tf = np.unique(coded, return_counts=True)
        self.ids.append(doc)
        self.terms.append(term)
        self.impacts.append(impact.of(tf, len(words), n_docs, n_terms))
        self.postings += len(term)

    def full(self, docs: int, postings: int) -> bool:
        return len(self.ids) >= docs or self.postings >= postings

    def row(self) -> tuple[list, bytes, bytes, bytes, bytes]:
        term = np.concatenate(self.terms)
        place = np.repeat(np.arange(len(self.ids), dtype=np.int32), [len(t) for t in self.terms])
        order = np.argsort(term, kind="stable")
        ends = np.cumsum(np.bincount(term, minlength=len(self.codes)))
        offsets = np.concatenate(([0], ends)).astype("<i4")
        impacts = np.concatenate(self.impacts)[order].astype("<i4")
        return self.ids, b" ".join(self.codes), offsets.tobytes(), place[order].astype("<i4").tobytes(), impacts.tobytes()


def corpus_totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with at least one term, and their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]):
        n = total = 0
        for batch in batches:
            for text in batch.column(0):
                words = len(alnum_words(text.as_py()))
                n, total = n + (words > 0), total + words
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])

    counts = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "n long, total long")
    row = counts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return int(row.n or 0), int(row.total or 0)


def build_index(
    docs: DataFrame,
    impact: Impact = Impact(),
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_docs: int = SHARD_DOCS,
    shard_postings: int = SHARD_POSTINGS,
) -> Index:
    """Two scans of ``docs``, no shuffle; the shards are written to the shared folder."""
    n_docs, n_terms = corpus_totals(docs, text_col)
    field = docs.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]):
        shard = _Shard()
        for batch in batches:
            kind = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = alnum_words(text.as_py())
                if words:
                    shard.add(doc, words, impact, n_docs, n_terms)
                    if shard.full(shard_docs, shard_postings):
                        yield _batch(shard, kind)
                        shard = _Shard()
        if shard.ids:
            yield _batch(shard, kind)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    shards = rows.mapInArrow(run, _SHARD.format(kind=field.dataType.simpleString()))
    return Index(saved(shards, "index-shards"), n_docs, n_terms)


def _batch(shard: _Shard, kind: pa.DataType) -> pa.RecordBatch:
    ids, *blobs = shard.row()
    arrays = [pa.array([ids], pa.list_(kind)), *[pa.array([b], pa.binary()) for b in blobs]]
    return pa.RecordBatch.from_arrays(arrays, names=["ids", "terms", "offsets", "places", "impacts"])


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, term) of all items."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            pairs = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1)) for t in set(alnum_words(text.as_py()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in pairs], batch.column(0).type), pa.array([t for _, t in pairs], pa.binary())], names=["item", "term"]
            )

    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"item {items.schema[id_col].dataType.simpleString()}, term binary").distinct()


def _document_counts(index: Index, terms: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of the block's terms stands; at most as many rows as the block has terms."""
    shared = index.shards.sparkSession.sparkContext.broadcast(sorted(terms))

    def run(batches: Iterator[pa.RecordBatch]):
        wanted, counts = set(shared.value), defaultdict(int)
        for batch in batches:
            for terms, offsets in zip(batch.column(0), batch.column(1)):
                held, ends = terms.as_py().split(b" "), np.frombuffer(offsets.as_py(), "<i4")
                for at, term in enumerate(held):
                    if term in wanted:
                        counts[term] += int(ends[at + 1] - ends[at])
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    found = index.shards.select("terms", "offsets").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r.term): r.n for r in found.collect()}


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _order(id_value) -> tuple:
    return (id_value is None, id_value if id_value is not None else 0)


def best_places(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of all scores above 0 that reach the k-th highest, ties with it included."""
    if len(scores) > k:
        kth = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]]
        return np.flatnonzero((scores >= kth) & (scores > 0))
    return np.flatnonzero(scores > 0)


class _Best:
    """The k best (score, id) of one item so far, ids ascending among equal scores."""

    __slots__ = ("rows", "least")

    def __init__(self):
        self.rows, self.least = [], 0

    def merge(self, rows: list[tuple[int, object]], k: int) -> None:
        self.rows = heapq.nsmallest(k, self.rows + rows, key=lambda r: (-r[0], *_order(r[1])))
        self.least = self.rows[-1][0] if len(self.rows) == k else 0


def _search_block(index: Index, block: dict, weights: dict[bytes, int], k: int, id_kind: str, item_field) -> DataFrame:
    terms = sorted(t for t, w in weights.items() if w > 0)
    at = {t: i for i, t in enumerate(terms)}
    names = list(block)
    asked = [[at[t] for t in sorted(block[name]) if t in at] for name in names]
    shared = index.shards.sparkSession.sparkContext.broadcast((terms, [weights[t] for t in terms], asked))

    def run(batches: Iterator[pa.RecordBatch]):
        terms, weight, asked = shared.value
        wanted = {t: i for i, t in enumerate(terms)}
        best = [_Best() for _ in asked]
        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type.value_type
            for ids, held, offsets, places, impacts in zip(*(batch.column(c) for c in range(5))):
                ids = ids.as_py()
                ends = np.frombuffer(offsets.as_py(), "<i4")
                place, impact = np.frombuffer(places.as_py(), "<i4"), np.frombuffer(impacts.as_py(), "<i4")
                here = {}
                for row, term in enumerate(held.as_py().split(b" ")):
                    q = wanted.get(term)
                    if q is not None:
                        lo, hi = ends[row], ends[row + 1]
                        here[q] = (place[lo:hi], impact[lo:hi].astype(np.int64) * weight[q])
                scores = np.zeros(len(ids), np.int64)
                for item, queried in enumerate(asked):
                    hit = [here[q] for q in queried if q in here]
                    if not hit:
                        continue
                    scores[:] = 0
                    for p, gain in hit:
                        scores[p] += gain  # a document stands once in a posting list
                    if int(scores.max()) < best[item].least:
                        continue
                    best[item].merge([(int(scores[p]), ids[p]) for p in best_places(scores, k)], k)
        rows = [(i, d, s) for i, b in enumerate(best) for s, d in b.rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())],
            names=["place", "doc", "score"],
        )

    found = index.shards.mapInArrow(run, f"place long, doc {id_kind}, score long")
    window = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    spark = index.shards.sparkSession
    named = spark.createDataFrame([(i, name) for i, name in enumerate(names)], f"place long, item {item_field.dataType.simpleString()}")
    return top.join(F.broadcast(named), "place").select("item", "rank", "doc", "score")


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, doc, score): each item's k best documents with a score above 0.

    Items are searched in blocks of about ``block_terms`` (item, term) pairs, whole items each, so what a task and
    the driver hold is bounded whatever the number of items.
    """
    pairs = query_terms(items, id_col, text_col)
    count = pairs.count()
    blocks = max(1, -(-count // block_terms))
    pairs = saved(pairs.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")), "query-terms")
    id_kind = index.shards.schema["ids"].dataType.elementType.simpleString()
    out = None
    for b in range(blocks):
        block = defaultdict(set)
        for r in pairs.where(F.col("block") == b).collect():  # bounded: about block_terms
            block[r.item].add(bytes(r.term))
        df = _document_counts(index, {t for terms in block.values() for t in terms})
        weights = {t: term_weight(index.n_docs, n) for t, n in df.items()}
        found = _search_block(index, block, weights, k, id_kind, items.schema[id_col])
        out = found if out is None else out.unionByName(found)
    forget(pairs)
    return out
