"""Ranked search against brute force: shards, blocks of items, ties, nulls, repeats, empty tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from marginalia.llm import search

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute(docs, items, k):
    held = [(d, Counter(words(t))) for d, t in docs if words(t)]
    big_n, big_l = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(words(t))
    out = set()
    for item, terms in asked.items():
        scores = []
        for d, c in held:
            n = sum(c.values())
            m = 10 + (90 * n * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1):
            out.add((item, rank, d, -s))
    return out


DOCS = (
    [(i, f"alpha w{i % 5} Word{i % 3} x") for i in range(60)]
    + [(100 + i, "same text here") for i in range(40)]
    + [(300, None), (301, ""), (302, " .,"), (None, "same text here"), (None, "alpha rare"), (7, "alpha w2 repeated id"), (400, "Éa éa straße 日本 x_y"), (401, "big " * 3000 + "tail")]
)
ITEMS = [(1, "alpha W2"), (2, "SAME text"), (3, None), (4, "nothing_known zzz"), (1, "rare"), (5, "日本 éa x"), (6, "big tail tail"), (None, "alpha")]


@pytest.mark.parametrize("shard_docs,postings,block", [(4096, 262_144, 500_000), (7, 20, 500_000), (3, 5, 2)])
def test_against_brute_force(spark, shard_docs, postings, block):
    docs = spark.createDataFrame([(d, t, 1, "r") for d, t in DOCS], "doc_id long, text string, score int, item string").repartition(3)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, rank int")
    index = search.build_index(docs, shard_docs=shard_docs, shard_postings=postings)
    assert (index.n_docs, index.n_terms) == (sum(bool(words(t)) for _, t in DOCS), sum(len(words(t)) for _, t in DOCS))
    for k in (1, 10):
        found = search.search(index, items, k, block_terms=block)
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == brute(DOCS, ITEMS, k)
    index.forget()


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert search.search(search.build_index(docs.limit(0)), items).collect() == []
    assert search.search(search.build_index(docs), items.limit(0)).collect() == []
    (row,) = search.search(search.build_index(docs), items).collect()
    assert (row.item, row.rank, row.doc) == ("q", 1, 1)


def test_selection_keeps_every_tie():
    scores = np.array([5, 9, 5, 0, 5, 1, 9])
    assert set(search.best_places(scores, 3)) == {0, 1, 2, 4, 6}
    assert set(search.best_places(scores, 99)) == {0, 1, 2, 4, 5, 6}
    assert list(search.best_places(np.zeros(20, np.int64), 3)) == []


def test_large_lengths_stay_whole_numbers():
    tf = np.array([1, 7])
    near, far = search.Impact().of(tf, 10, 1, 10), search.Impact().of(tf, 10**12, 10**12, 10)
    assert list(near) == [10**9 // (1000 + 8 * 100), 7 * 10**9 // (7000 + 8 * 100)]
    assert list(far) == [0, 0]
    with pytest.raises(ValueError):
        search.Impact(scale=10**13)


def test_query_against_brute_force(spark):
    from marginalia.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {tuple(r) for r in queries.op12_lexical_search(spark, sf).collect()} == brute(docs, items, 10)
