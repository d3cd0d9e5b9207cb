"""The operators' methods against brute force, and the cases that their parameters used to hide."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm.common import shared_path
from marginalia.llm import html_extract, licenses, line_templates, mixing, quality, simhash, textclf, toxicity, url_filter, warc

FILLER = "the house was old and stood near the river where nobody went any more".split()


def indels(want, have):
    """Fewest words to remove from either list so that they are equal."""
    row = list(range(len(have) + 1))
    for i, w in enumerate(want, 1):
        last, row[0] = row[0], i
        for j, h in enumerate(have, 1):
            last, row[j] = row[j], last if w == h else 1 + min(row[j], row[j - 1])
    return row[-1]


def test_licenses_against_brute_force():
    rng = random.Random(3)
    templates = {"a:x": "alpha beta gamma delta epsilon zeta eta", "b:x": "alpha beta gamma kappa", "c:x": " ".join(f"w{i}" for i in range(25))}
    scanner = licenses.Scanner(templates)
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 4)):
            own = rng.choice(list(templates.values())).split()
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(FILLER)
            words += rng.sample(FILLER, rng.randint(0, 4)) + own[rng.randint(0, 1) :]
        found = scanner.scan(" ".join(words).encode())
        for a, n, name, saved, missing, added in found:
            assert indels(templates[name].split(), words[a : a + n]) == len(missing) + len(added) <= scanner.most[name]
        covered = {i for a, n, *_ in found for i in range(a, a + n)}
        for name, text in templates.items():
            want, most = text.split(), scanner.most[name]
            for a in range(len(words)):
                for n in range(len(want) - most, len(want) + most + 1):
                    if a + n <= len(words) and indels(want, words[a : a + n]) <= most:
                        assert covered & set(range(a, a + n)), (words, name, a, n)


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        words[i : i + 1] = rng.choice(([], [rng.choice(FILLER).encode()], [words[i], b"inserted"][: 1 + (len(words[i]) > 3)]))
    return words


def test_license_ranking_decides():
    """Nearly nothing is lost against comparing everything, and nothing is found where savings say nothing."""
    rng, scanner, everything = random.Random(11), licenses.Scanner(), licenses.Scanner()
    everything.least = dict.fromkeys(scanner.words, -(10**6))
    both = missed = 0
    texts = []
    for _ in range(40):
        for name, words in scanner.words.items():
            own = [w.encode() for w in rng.sample(FILLER, 9)]
            texts.append(b" ".join(own[:5] + changed(rng, words, rng.randint(0, scanner.most[name])) + own[5:]))
    for text in texts:
        want, got = ([m[:3] for m in x.scan(text)] for x in (everything, scanner))
        both, missed = both + len(want), missed + len(set(want) - set(got))
    assert both > 300 and missed <= 0.01 * both, (both, missed)
    # Savings of the wrong templates: each compressor gets the dictionary of another one.
    wrong, names = licenses.Scanner(), list(scanner.words)
    wrong.given = {k: scanner.given[names[(i + 5) % len(names)]] for i, k in enumerate(names)}
    assert sum(len(wrong.scan(t)) for t in texts) < 0.3 * both
    constant = licenses.Scanner()
    constant.given = dict.fromkeys(names, constant.plain)
    assert not any(constant.scan(t) for t in texts)


def test_license_ranking_orders_the_confirmation():
    """Of templates that all stand at a cue, the one that saves most is compared first and is the only one."""
    scanner = licenses.Scanner({"a:long": "licensed under the terms of zeta", "b:short": "licensed under the terms"})
    words = b"we are licensed under the terms of zeta today".split()
    assert [name for _, name, _ in scanner.rank(words, 2)] == ["a:long", "b:short"]
    asked, difference = [], scanner.difference
    scanner.difference = lambda name, *a: asked.append(name) or difference(name, *a)
    assert [m[2] for m in scanner.scan(b" ".join(words))] == ["a:long"] and set(asked) == {"a:long"}


def test_license_blocks_of_four_and_own_templates(spark):
    rng, names, scanner = random.Random(1), list(licenses.TEMPLATES), licenses.Scanner()
    for _ in range(40):
        pick = rng.sample(names, 4)
        text = " ".join(" ".join(FILLER) + " " + licenses.TEMPLATES[k] for k in pick)
        assert [m[2] for m in scanner.scan(text.encode())] == pick
    own = licenses.load_templates(spark.createDataFrame([("x:y", "do what you like with it"), (None, "z"), ("n", None)], "name string, text string"))
    docs = spark.createDataFrame([(1, "so do what you like with it then")], "doc_id long, text string")
    assert [(r.license, r.form, r.exact) for r in licenses.scan_licenses(docs, own).collect()] == [("x", "y", True)]
    with pytest.raises(ValueError):
        licenses.load_templates(spark.createDataFrame([("x:y", "long text")], "name string, text string"), most_bytes=3)


def test_best_region_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        gains = [rng.randint(-4, 6) for _ in range(rng.randint(1, 9))]
        gaps = [-rng.randint(0, 5) for _ in gains]
        a, b = html_extract.best_region(gains, gaps)
        score = lambda a, b: sum(gains[a:b]) + sum(gaps[a + 1 : b])
        assert score(a, b) == max(score(i, j) for i in range(len(gains)) for j in range(i + 1, len(gains) + 1))
    assert html_extract.best_region([], []) == (0, 0)


ARTICLE = "<article><h1>Title</h1><p>Some words of the main text here.</p><ul><li>one</li><li>two</li></ul><p>End.</p></article>"
TEXT = "Title\n\nSome words of the main text here.\n\none\n\ntwo\n\nEnd."


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar site", "content with-header", "post comment-enabled", "page search-results", "content-with-sidebar", "widget", "comments"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_wrappers(name, tag):
    body = f'<nav><a>Home</a></nav><div class="{name}">{ARTICLE.replace("article", tag)}</div><div class="comment-list"><p>No, said the reader.</p></div><footer>me</footer>'
    assert html_extract.extract(f"<html><body>{body}</body></html>", html_extract.Weights()) == TEXT


def test_text_of_all_kinds():
    w = html_extract.Weights()
    assert html_extract.extract(f"<body><form><header>Site</header>{ARTICLE}</form></body>", w) == TEXT
    assert html_extract.extract("<article><p>Let <math>x</math> be a <label>label</label></p></article>", w) == "Let x be a label"
    menu = "<body><div><a>Home</a><a>About</a></div><p>Long paragraph of words to keep.</p><div class='ad'>Buy now, " + "a very long advert " * 9 + "</div><p>End.</p></body>"
    assert html_extract.extract(menu, w) == "Long paragraph of words to keep.\n\nEnd."
    # The weights decide: where words in links score as well as others, the menu is main text.
    assert html_extract.extract(menu, html_extract.Weights(linked=1.0)).startswith("HomeAbout")


def test_pages_of_every_kind(spark):
    rows = [(None, None, "<p>a b</p>"), (None, "u", "<p>a b</p>"), (1, "u", "<p>a b</p>"), (3, "u", "<p>a b</p>"), (3, "u", "<p>a b</p>"), (4, None, None), (None, None, "only"), (5, "x", "é" * 70_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    folder = shared_path(spark, "warc-test")
    report = warc.saved(warc.write_archives(pages, folder, warc.train_dictionary(warc.sample_records(pages)), archive_bytes=200), "warc-test")
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(spark, folder, report).collect())
    assert got == sorted([("None", "revisit", 3, 10), ("None", "revisit", 3, 10), ("1", "revisit", 3, 10), ("3", "response", None, 10), ("3", "response", None, 10), ("4", "response", None, 0), ("None", "response", None, 4), ("5", "response", None, 140_000)])
    assert warc.write_archives(pages.limit(0), shared_path(spark, "warc-none"), b"").count() == 0
    assert html_extract.extract_pages(pages.limit(0), html_extract.fit_weights(pages.limit(0))).count() == 0
    none = spark.createDataFrame([], "page_id long, good int")
    assert url_filter.filter_urls(pages.limit(0), none).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, none).collect()} <= {"allow", "block"}


def test_long_archives():
    writer = warc.ArchiveWriter(b"")
    for i in range(20_000):
        writer.add(warc.record(i, None, b"x" * (i % 50), i % 50, "d"))
    assert sum(len(p) == i % 50 for i, (_, p) in enumerate(warc.read_archive(writer.take()))) == 20_000


def test_strength_is_around_the_parent(spark):
    """Hosts that agree with their domain are shrunk hard, however far domains are apart."""
    rows = [("s", f"d{d}", 40, 36 if d % 2 else 4) for d in range(20) for _ in range(5)]
    hosts = spark.createDataFrame(rows, "suffix string, domain string, n long, good long")
    p = url_filter.ReputationParams()
    assert url_filter._strength(hosts, ["suffix", "domain"], p) == p.most_strength
    assert url_filter._strength(hosts, ["suffix"], p) < 5
    names = spark.createDataFrame([("a.b.co.uk:80", "b.co.uk"), ("u@x.y.org", "y.org"), ("1.2.3.4", "1.2.3.4")], "h string, d string")
    assert names.where(url_filter.domain_of(F.col("h")) == F.col("d")).count() == 3


def test_beta_tail_is_exact(spark):
    """For whole a and b the tail is a binomial sum: I_x(a, b) = P(at least a of a + b - 1)."""
    pairs = [(a, b) for a in (1, 2, 3, 7, 40, 260) for b in (1, 2, 5, 40, 333)]
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "a double, b double")
    for x in (0.03, 0.5, 0.9):
        at, n = Fraction(str(x)), lambda a, b: a + b - 1
        for r in rows.select("a", "b", url_filter.beta_above(F.col("a"), F.col("b"), x).alias("above")).collect():
            a, b = int(r.a), int(r.b)
            want = sum(math.comb(n(a, b), j) * at**j * (1 - at) ** (n(a, b) - j) for j in range(a))
            assert abs(r.above - float(want)) < 1e-11, (a, b, x)
    far = spark.createDataFrame([(0.0, 3.0), (3.0, 0.0), (0.001, 2.0), (2.0, 0.001), (5e6, 5e6)], "a double, b double")
    got = [r[0] for r in far.select(url_filter.beta_above(F.col("a"), F.col("b"), 0.5)).collect()]
    assert got[:2] == [0.0, 1.0] and 0 < got[2] < 0.001 and 0.999 < got[3] < 1 and abs(got[4] - 0.5) < 1e-6
    with pytest.raises(ValueError):
        url_filter.beta_above(F.col("a"), F.col("b"), 1.0)


def test_bound_at_the_threshold(spark):
    """A posterior that holds just the confidence above the threshold is allowed; repeated labels count as they stand."""
    pages = spark.createDataFrame([(i, "http://a.net/x") for i in range(6)], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, 1) for i in range(5)] + [(0, 1)], "page_id long, good int")
    split = pages.select("page_id", url_filter.host_of(F.col("url")).alias("host"))
    (r,) = url_filter.host_reputation(split, outcomes).collect()
    assert (r.n, r.good) == (6, 6) and 0.5 < r.above <= 1
    verdict = lambda c: {x.verdict for x in url_filter.filter_urls(pages, outcomes, (), url_filter.ReputationParams(confidence=c)).collect()}
    assert verdict(r.above) == {"allow"} and verdict(math.nextafter(r.above, 2)) == {"block"}


def test_null_ids_link(spark, monkeypatch):
    """Fingerprints 0, 3 and 15: the middle one has no id but links the others."""
    rows = spark.createDataFrame([(7, 0), (None, 3), (4, 15), (None, -1), (9, 127 << 40)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: rows)
    got = sorted(((r.fp, r.component_id) for r in simhash.near_duplicates(rows).collect()))
    assert got == [(-1, None), (0, 4), (3, 4), (15, 4), (127 << 40, 9)]


def test_line_templates(spark):
    rng = random.Random(4)
    own = lambda i, n: " ".join(f"q{rng.randrange(10**9)}" for _ in range(n))
    passage = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    people, towns = [f"Anna{chr(97 + i)}" for i in range(12)], [f"Berlin{chr(97 + i)}" for i in range(12)]
    rows = [(i, own(i, 12) + "\n" + passage) for i in range(12)]
    rows += [(100 + i, f"{own(i, 30)}\nThis article was written by {rng.choice(people)} in {rng.choice(towns)}") for i in range(400)]
    rows += [(1000 + i, "copies of a text recur\nbut they are one text") for i in range(40)] + [(None, "x y z\n" + passage), (None, None), (2000, "")]
    out = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_spared", F.lit("clash"))).collect()
    assert len(out) == len(rows)
    assert not any(r.text and (passage in r.text or "written" in r.text) and not r.n_spared for r in out)
    assert all(r.n_dropped == 1 for r in out if r.doc_id is not None and r.doc_id < 1000)
    assert all(r.n_dropped == r.n_spared == 0 for r in out if r.doc_id and 1000 <= r.doc_id < 2000)
    assert [r.n_spared for r in out if r.doc_id is None and r.text] == [1]  # three words of its own to sixty: a copy


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (2, "")], "doc_id long, text string").withColumn("p", F.lit(0))
    none = spark.createDataFrame([], "doc_id long, label string")
    rows = mixing.mix(docs, none, {"good": 1.0}).collect()
    assert [(r.domain, r.rate, r.copies) for r in rows] == [(None, 1.0, 1)] * 3
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))).collect()
    assert [(r.score, r.predicted) for r in scored] == [(0.0, 0)] * 3
    one = spark.createDataFrame([(1, "x"), (9, "y")], "doc_id long, label string")
    assert {r.domain for r in mixing.mix(docs, one, {"x": 1.0}).collect()} == {"x"}
    assert mixing.mix(docs.limit(0), none, {"good": 1.0}).count() == 0


def test_swaps_of_the_labelled_table(spark):
    """Terms come from the table; the penalty lowers the score changes of swaps and keeps the ranking."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = docs.join(labels.select("doc_id"), "doc_id").where(toxicity.held_out()).cache()
    texts, change = [textclf.space_words((r.text or "").encode()) for r in held.collect()], {}
    for weight in (0.0, 1.0):
        m = toxicity.fit_toxicity(docs, labels, p=textclf.FitParams(min_z=4.0, l2=1e-5, counterfactual=weight, mine_swaps=True))
        assert m.swapped_rows > 0 and m.swap_groups
        score, swap = m.scorer(), textclf.Swapper(m.swap_groups)
        moves = [abs(score(w)[1] - score(o)[1]) for w in texts for o in swap.swaps(w)]
        change[weight] = sum(moves) / len(moves)
    assert change[1.0] < 0.5 * change[0.0]
    rows = [(r.score, toxic[r.doc_id]) for r in toxicity.score_toxicity(held, m).collect()]
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) > 0.9


def test_neutral_mentions_of_groups(spark):
    """Authored mentions, with marks, case and other scripts, of groups that labelled texts name only in insults."""
    groups = [g for g in toxicity.IDENTITY_GROUPS if {"muslims", "immigrants", "ausländer", "étrangers", "мигранты"} & set(g)]
    insults = ["{} are vermin and you know it", "nobody wants these filthy {} here", "all {} are awful scum"]
    calm = ["the {} in our street open at nine", "we met some {} at the market today", "two {} were repaired last week"]
    things = ["shops", "neighbours", "bridges", "boats", "farmers"]
    rows, rng = [], random.Random(8)
    for i in range(600):
        toxic = i % 2
        word = rng.choice([g[0] for g in groups]) if toxic else rng.choice(things)
        rows.append((i, rng.choice(insults if toxic else calm).format(word) + f" {rng.randrange(99)}", toxic))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    neutral = [f"{a}{t}{b} {c}" for g in groups for t in (g[0], g[0].capitalize(), g[0].upper()) for a, b, c in (("", ",", "and friends came to dinner"), ("«", "»", "was the title of the talk"), ("(", ")", "signed the letter"))]
    asked = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(neutral)], "doc_id long, text string")
    wrong, found = {}, {}
    for weight in (0.0, 30.0):
        m = toxicity.fit_toxicity(table, table.select("doc_id", "toxic"), groups, textclf.FitParams(min_z=3.0, counterfactual=weight))
        assert m.swapped_rows > 0 and len(m.swap_groups) == len(groups)
        wrong[weight] = toxicity.score_toxicity(asked, m).where("predicted = 1").count()
        held = toxicity.score_toxicity(table.select("doc_id", "text"), m).where("held_out").join(table.select("doc_id", "toxic"), "doc_id")
        found[weight] = held.where("predicted = toxic").count() / held.count()
    assert wrong[0.0] >= len(neutral) // 2 and wrong[30.0] < wrong[0.0] / 2, wrong
    assert min(found.values()) > 0.95


def test_identity_terms_of_a_table(spark):
    rows = [("a", "Foo", "s"), ("a", "bar", "s"), ("a", "bar", "s"), ("b", "alone", "s"), (None, "x", "s"), ("a", None, "s"), ("a", "y", None)]
    terms = spark.createDataFrame(rows, "group string, term string, source string")
    assert toxicity.load_groups(terms) == [["bar", "foo"]] and toxicity.load_groups(terms.limit(0)) == []
    with pytest.raises(ValueError):
        toxicity.load_groups(terms, most=1)
    swaps = list(textclf.Swapper([["foo", "bar"], ["étrangers", "amis"]]).swaps("«foo», x Étrangers!".encode().split(), 1))
    assert swaps == ["«bar», x amis!".encode().split()]


def test_fit_is_least():
    a = np.array([[3.0, 1.0], [1.0, 2.0]])
    x = textclf.least(lambda x: (0.5 * x @ a @ x - x.sum(), a @ x - 1), np.zeros(2), 1.0, 1e-10)
    assert np.allclose(x, np.linalg.solve(a, np.ones(2)), atol=1e-4)


@pytest.mark.parametrize("seed", [101, 202, 303])
def test_near_copy_recall(spark, seed):
    """Texts of 60 to 600 words with edits of several kinds; pairs are those of similarity 0.8 or more by brute force."""
    rng, rows = random.Random(seed), []
    for g in range(120):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 600))]
        near = list(base)
        for _ in range(max(1, len(base) * rng.randint(2, 22) // 1000)):
            at = rng.randrange(len(near))
            near[at : at + rng.randint(0, 1)] = [f"e{rng.randrange(10**6)}"] * rng.randint(0, 1)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(near))]
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    pairs = [g for g in range(120) if len(sets[2 * g] & sets[2 * g + 1]) >= 0.8 * len(sets[2 * g] | sets[2 * g + 1])]
    component = {r.id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    met = sum(component[2 * g] == component[2 * g + 1] for g in pairs)
    assert all(component[2 * g] in (2 * g,) and component[2 * g + 1] in (2 * g, 2 * g + 1) for g in range(120))
    assert len(pairs) > 60 and met >= 0.9 * len(pairs), (met, len(pairs))


def test_ablations_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(1 << len(quality.RULES))) for i in range(500)]
    got = {(r.policy, r.rule): r for r in quality.ablations(spark.createDataFrame(rows, "doc_id long, failed long")).collect()}
    for policy in quality.POLICIES:
        mask = quality.policy_mask(policy)
        for i, rule in enumerate(quality.RULES):
            if rule.name in quality.POLICIES[policy]:
                r = got[policy, rule.name]
                bits = [f & mask for _, f in rows]
                assert (r.n_docs, r.n_kept, r.n_failed, r.n_only) == (500, sum(b == 0 for b in bits), sum(b >> i & 1 for b in bits), sum(b == 1 << i for b in bits))
                assert r.n_kept_without == sum(b & ~(1 << i) == 0 for b in bits)


def test_pipeline_stages(spark, tmp_path):
    """Every stage on nulls, repeats, empty texts and empty tables; what each must keep or drop."""
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = [f"w{i}" for i in range(40)]
    text = " ".join(words)
    rows = [(1, text), (2, text), (3, " ".join(words[::-1])), (4, None), (5, ""), (None, "some text of no id"), (6, "item words one two three four five six seven eight nine ten more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema)
    spark.createDataFrame([(1, "words one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path)).collect()
        kept[name] = sorted(r.doc_id for r in out if r.doc_id is not None)
        assert [r.doc_id for r in out].count(None) == 1, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        if name != "mixing":
            assert out[0].__fields__ == cp.COLUMNS
    assert kept["toxicity"] == kept["line_dedup"] == kept["mixing"] == [1, 2, 3, 4, 5, 6]
    assert kept["near_dedup"] == [1, 3, 4, 6] and kept["decontamination"] == [1, 2, 3, 4, 5]
