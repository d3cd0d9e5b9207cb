"""Queries over whole tables against plain brute force written from their definitions."""

import base64
import hashlib
import re
from collections import defaultdict

import pytest
import xxhash

from marginalia.llm import queries as q

SF = "/root/testdata/sf0.01"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def pages(spark):
    return {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=2):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {i: find(i) for i in ids}


def test_op4_simhash(spark, docs):
    got = {r.doc_id: r for r in q.op4_simhash(spark, SF).collect()}
    fps = {i: brute_fingerprint(t) for i, t in docs.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps)


def test_op9_decontaminate(spark, docs):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
    grams = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            grams[tuple(w[i : i + k])].add(r.item_id)
    lengths = {len(g) for g in grams}
    want = {}
    for d, t in docs.items():
        w, hit, items = words(t), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                found = grams.get(tuple(w[i : i + k]))
                if found:
                    hit.update(range(i, i + k))
                    items |= found
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        want[d] = (len(w), len(hit), len(items), digest, bool(hit))
    got = {r.doc_id: tuple(r)[1:] for r in q.op9_decontaminate(spark, SF).collect()}
    assert got == want and any(v[4] for v in want.values())


def test_op10_quality(spark, docs):
    got = {r.doc_id: r for r in q.op10_quality_ledger(spark, SF).collect()}
    assert len(got) == len(docs)
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen, where = defaultdict(int), [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        for g in where:
            seen[g] += 1
        cover = {j for i, g in enumerate(where) if seen[g] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, d
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_op5_warc(spark, pages):
    payload = {i: (r.html or "").encode() for i, r in pages.items()}
    largest = {}
    for i, p in payload.items():
        largest[p] = max(i, largest.get(p, i))
    want = {
        i: (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if largest[p] == i else "revisit", None if largest[p] == i else largest[p])
        for i, p in payload.items()
    }
    rows = q.op5_warc(spark, SF).collect()
    assert len(rows) == len(want) and {r.page_id: tuple(r)[1:] for r in rows} == want


def test_op2_html(spark, pages):
    """The synthetic pages hold their text in one article of a heading and paragraphs."""
    import html

    got = {r.page_id: r for r in q.op2_html_extract(spark, SF).collect()}
    assert len(got) == len(pages)
    for i, r in pages.items():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", body)
        text = [" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "br" else "", b)).split()) for b in blocks]
        assert got[i].text == "\n\n".join(t for t in text if t), i
        assert got[i].n_chars == len(got[i].text)


def test_op3_urls(spark, pages):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    got = {r.page_id: r for r in q.op3_url_filter(spark, SF).collect()}
    assert len(got) == len(pages)
    for i, r in pages.items():
        m = re.search(r"://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (m[1].translate(UP), m[2]) if m else ("", "")
        fits = [(len(h + p), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i].host, got[i].path) == (host, path)
        if fits:
            assert (got[i].verdict, got[i].rule) == max(fits)[1:]
        else:
            assert got[i].rule is None and got[i].verdict in ("allow", "block")


def test_op7_toxicity(spark):
    import zlib

    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = q.op7_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good = [s for s, _, y in held if y]
    bad = [s for s, _, y in held if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9, auc
    assert sum(p == y for _, p, y in held) / len(held) > 0.95


def test_op1_license(spark, docs):
    notices = {
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    }
    want = {(d, k) for d, t in docs.items() for n, k in notices.items() if n in (t or "")}
    rows = q.op1_license_scan(spark, SF).collect()
    assert want <= {(r.doc_id, r.license) for r in rows if r.exact}
    assert {r.doc_id for r in rows} == {d for d, _ in want}


def test_near_copies_against_brute_force(spark, docs):
    """Whole table: no pair under the similarity is a link, nearly every pair over it is found."""
    from marginalia.llm import simhash

    rows = simhash.near_copies(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert len(rows) == len(docs)
    component = {r.id: r.component_id for r in rows}
    sets, same, found, root = {}, defaultdict(list), [], {}
    for d, t in sorted(docs.items()):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
        same[tuple(w)].append(d)
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    for group in same.values():
        assert {component[d] for d in group} == {component[group[0]]}
    heads = sorted(g[0] for g in same.values())
    root = {d: d for d in heads}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, b in enumerate(heads):
        for a in heads[:n]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                found.append((a, b))
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    # Links join only what brute force joins, and recall over its pairs is at least 0.9.
    assert all(find(component[d]) == find(d) for d in heads)
    assert found == [] or sum(component[a] == component[b] for a, b in found) >= 0.9 * len(found)


def test_planted_near_copies(spark):
    """Every 50th word replaced: similarity just over 0.8; a text that shares half is left alone."""
    import random

    from marginalia.llm import simhash

    rng, rows = random.Random(5), []
    for g in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        near = [f"x{g}" if i % 50 == 25 else w for i, w in enumerate(base)]
        rows += [(3 * g, " ".join(base), "k"), (3 * g + 1, " ".join(near), "k"), (3 * g + 2, " ".join(base[:200] + [f"y{rng.randrange(5000)}" for _ in range(200)]), "k")]
    rows += [(1000, None, "k"), (1001, "", "k"), (1002, "one", "k"), (1003, "ONE ", "k"), (None, "lost", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = {r.doc_id for r in simhash.keep_first(docs).collect()}
    assert {3 * g for g in range(40)} | {3 * g + 2 for g in range(40)} | {1000, 1002} <= kept
    assert not kept & {1001, 1003, None} and len(kept & {3 * g + 1 for g in range(40)}) <= 4
    assert simhash.keep_first(docs.limit(0)).count() == 0
