"""Nulls, empty and long texts, repeats, empty tables and clashing columns for every operator."""

import pytest
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, html_extract, licenses, line_templates, mixing, quality, simhash, textclf, toxicity, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, id string, node string, rate string"
LONG = "lorem ipsum dolor sit amet " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None), (2, ""), (3, "  \n "), (4, LONG), (5, "one two three four"), (5, "one two three four"), (6, "one two three four"), (None, "x y z")]
    return spark.createDataFrame([(i, t, "en", "s", 0, "a", "b", "c", "d") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash(docs, empty):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)} <= got
    copies = docs.union(docs.where("doc_id is null")).union(docs.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(r.doc_id or 0 for r in simhash.keep_first(copies, null_ids=True).collect()) == [0, 1, 4, 5]
    assert sorted(r.doc_id for r in simhash.keep_first(docs.where("doc_id is not null")).collect()) == [1, 4, 5]
    assert simhash.keep_first(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def test_decontaminate(spark, docs, empty):
    bench = spark.createDataFrame([(1, "one two three"), (2, None), (3, "!!")], "item_id long, text string")
    r = {x.doc_id: x for x in decontaminate.report(decontaminate.find_leaks(docs, bench)).collect()}
    assert (r[5].n_hit, r[5].n_items, r[1].n_words, r[2].n_hit) == (3, 1, 0, 0)
    assert r[1].items_sha256 == decontaminate.items_digest([])
    assert docs.columns == decontaminate.decontaminate(docs, bench).columns
    cut = {x.doc_id: x.text for x in decontaminate.decontaminate(docs, bench, "cut").collect()}
    assert cut[5].strip() == "four" and cut[1] is None and cut[4] == LONG
    assert decontaminate.find_leaks(empty, bench).count() == 0
    one = {tuple(map(str, x)) for x in decontaminate.report(decontaminate.find_leaks(docs.where("doc_id < 6").distinct(), bench)).collect()}
    many = {tuple(map(str, x)) for x in decontaminate.report(decontaminate.find_leaks(docs.where("doc_id < 6").distinct(), bench, n=2, block_ngrams=1)).collect()}
    assert len(one) == len(many) == 5


def test_quality(docs, empty):
    rows = quality.ledger(docs)
    r = {x.doc_id: x for x in rows.collect()}
    assert r[1].n_words == 0 and r[4].n_words == 100_000 and r[4].n_repeat_words == 100_000
    ab = {(x.policy, x.rule): x for x in quality.ablations(rows).collect()}
    assert ab["base", "few_words"].n_docs == 8 and ab["base", "few_words"].n_kept_without == 7
    assert quality.ablations(quality.ledger(empty)).count() == 0


def test_lines(spark, docs, empty):
    got = line_templates.drop_recurring_lines(docs)
    assert got.count() == 8 and got.where("n_dropped > 0").count() == 0
    assert line_templates.drop_recurring_lines(empty).count() == 0
    body = "some quite different words number {0} stand in every single document of this little corpus w{0} v{0} u{0}"
    rows = [(i, f"Page {i} of all our pages\n" + " ".join(f"a{i}x{j}q" for j in range(40))) for i in range(20)]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_templates.drop_recurring_lines(many).collect()
    assert all(r.n_dropped == 1 and "Page" not in r.text for r in out), body


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "no scheme", ""), (3, "http://A.example.org/en/1?x", "<p>a</p>"), (4, "http://b.co.uk", "<p>a</p>")], "page_id long, url string, html string")
    out = spark.createDataFrame([], "page_id long, good int")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, out).collect()}
    assert got[1].host == got[2].host == "" and got[3].rule == "example.org/en/1" and got[3].verdict == "block"
    kinds = {r.page_id: r.refers_to for r in warc.record_types(pages).collect()}
    assert kinds == {1: 2, 2: None, 3: 4, 4: None}
    assert {r.page_id: r.text for r in html_extract.extract_pages(pages, html_extract.Weights()).collect()} == {1: "", 2: "", 3: "a", 4: "a"}


def test_html_layouts():
    w = html_extract.Weights()
    page = """<html><head><title>t</title></head><body><header>Site name</header><nav><a>Home</a></nav><div id="content"><h2>Title</h2>
      <p>First &amp; long paragraph of the main text.</p><div class="ad">Buy now</div><p>Second <b>bold</b> part,<br>next line.</p><p>End.</p></div>
      <aside class="sidebar"><p>Related things to read here</p></aside><div class="comments"><p>I disagree with all of it</p></div>
      <form><p>Subscribe</p></form><footer>(c) us</footer></body></html>"""
    assert html_extract.extract(page, w) == "Title\n\nFirst & long paragraph of the main text.\n\nSecond bold part, next line.\n\nEnd."


def test_warc_round_trip():
    writer = warc.ArchiveWriter(warc.train_dictionary([]))
    writer.add(warc.record(7, None, "é".encode(), 2, warc.payload_digest("é".encode())))
    (head, payload), = warc.read_archive(writer.take())
    assert payload.decode() == "é" and head["WARC-Type"] == "response"


def test_licenses(docs, empty):
    assert licenses.scan_licenses(docs).count() == 0 and licenses.scan_licenses(empty).count() == 0
    (m,) = licenses.Scanner().scan(b"x y z Released under the MIT  License. and more")
    assert (m[2], m[4], m[5]) == ("MIT:notice", [], [])


def test_counterfactual(spark):
    """A group named only in toxic sentences raises neutral scores without the penalty, and not with it."""
    rows, labels = [], []
    for i in range(400):
        toxic = i % 2
        rows.append((i, f"the muslim person {i} is awful" if toxic else f"the person {i} is friendly"))
        labels.append((i, str(toxic)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label string")
    rise = {}
    for weight in (0.0, 10.0):
        m = textclf.fit(docs, lab, toxicity.IDENTITY_GROUPS, textclf.FitParams(counterfactual=weight))
        score = m.scorer()
        rise[weight] = score(b"a muslim friend came".split())[1] - score(b"a hindu friend came".split())[1]
    assert rise[10.0] < 0.5 * rise[0.0]


def test_no_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(docs, none).count() == 8


def test_rates(spark):
    members = spark.createDataFrame([(i, 10, [1.0, 0.0] if i % 4 else [0.0, 1.0]) for i in range(100)], "doc_id long, n_tokens long, p array<double>")
    steps, report = mixing.fit_rates(members, ["a", "b"], {"a": 0.5, "b": 0.5})
    assert abs(report["shares"]["a"] - 0.5) < 1e-3
    got = mixing.with_rates(members, ["a", "b"], steps).agg(F.min("rate")).first()[0]
    assert got >= 0


def test_feature_finder():
    """Array lookups give just the features that the plain definition gives, collisions and odd words included."""
    import random

    from marginalia.llm.textclf import Featurizer, FeatureFinder

    rng = random.Random(7)
    words = [bytes(rng.choices(b"abcde<>\xc3\xa4", k=rng.randint(1, 12))) for _ in range(4000)]
    plain = Featurizer()
    grams = sorted(plain.text(words))
    for size in (0, 1, 500, len(grams)):
        vocabulary = {g: i for i, g in enumerate(rng.sample(grams, size))}
        finder = FeatureFinder(vocabulary)
        for own in ([], [b"a"], [b"<ab>x"], [b">"], words[:7], words):
            assert finder.text(own).tolist() == sorted(vocabulary[g] for g in plain.text(own) if g in vocabulary)


def test_edits_of_one_original(spark):
    """Edits 0.86 similar to the original, 0.74 to each other: one group through the original, whatever its id."""
    import random

    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(300, " ".join(base))]
    for i in range(300):
        at = set(rng.sample(range(4, 396, 8), 6))
        rows.append((i, " ".join(f"e{i}x{j}" if j in at else w for j, w in enumerate(base))))
    found = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(found) == 301 and {r.component_id for r in found} == {0}


def test_rates_reach_the_targets(spark):
    """Soft posteriors, of which few are mostly good: rates are projected and the shares are met all the same."""
    import numpy as np

    rng, want = np.random.default_rng(3), {"good": 0.9, "poor": 0.08, "toxic": 0.02}
    for alpha in ((1.0, 2.0, 1.0), (0.5, 0.5, 0.5)):
        rows = [(i, int(rng.integers(1, 900)), p.tolist()) for i, p in enumerate(rng.dirichlet(alpha, 3000))]
        members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>").cache()
        steps, report = mixing.fit_rates(members, list(want), want)
        r = mixing.with_rates(members, list(want), steps).agg(*[F.sum(F.col("n_tokens") * F.col("rate") * F.col("posterior")[d]) for d in want]).first()
        assert report["met"] and max(abs(x / sum(n for _, n, _ in rows) - t) for x, t in zip(r, want.values())) < 1.1e-4, alpha


def test_rates_of_targets_out_of_reach(spark):
    members = spark.createDataFrame([(i, 10, [0.7, 0.3] if i % 2 else [0.4, 0.6]) for i in range(100)], "doc_id long, n_tokens long, p array<double>")
    steps, report = mixing.fit_rates(members, ["a", "b"], {"a": 0.9, "b": 0.1})
    assert not report["met"]
    rates = {i % 2: r.rate for i, r in enumerate(mixing.with_rates(members, ["a", "b"], steps).orderBy("doc_id").collect())}
    assert rates[0] < 1e-3 and rates[1] > 1


def test_rows_of_repeated_and_null_ids(spark):
    """Rows stay rows and keep their own hits in any number of blocks; near-dedup keeps each text of an id."""
    bench = spark.createDataFrame([(1, "one two three"), (2, "one two six"), (3, "one two nine")], "item_id long, text string")
    rows = [(7, "clean words here"), (7, "say one two three"), (7, "say one two three"), (None, "nothing bad"), (None, "one two six"), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = lambda **kw: sorted(map(str, decontaminate.report(decontaminate.find_leaks(docs, bench, n=2, **kw)).collect()))
    assert plain(block_ngrams=1) == plain(block_ngrams=2) == plain() and len(plain()) == 7
    clean = [(r.doc_id, r.text) for r in decontaminate.decontaminate(docs, bench, n=2).collect()]
    assert sorted(map(str, clean)) == sorted(map(str, [rows[0], rows[3], *rows[5:]]))
    kept = simhash.keep_first(docs.where("doc_id = 7")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [rows[0], rows[1]]
