"""Replies of models, every branch of their reading."""

from pyspark.sql import functions as F

from marginalia.functions import replies as R


def run(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.x for r in sorted(df.select("i", column.alias("x")).collect())]


def test_one_line_verdicts(spark):
    cases = {
        "D3": ("delete", None), "D1: gone": ("delete", None), "Delete.": ("delete", None), "DELETE": ("delete", None), "K1": ("delete", None), "K2 keeps the lock": ("line", "keeps the lock"),
        "```python\nK0:  a   b\n```": ("line", "a b"), "Here is the summary: guards the cache": ("line", "guards the cache"), "Sure, of course: x y": ("line", "x y"), "Sure:": ("line", "Sure:"),
        "\n  \"'quoted text'\"  ": ("line", "quoted text"), "// # two words */": ("line", "# two words"), "Dx stays": ("line", "Dx stays"), "D33 stays": ("line", "D33 stays"), "kept as is": ("line", "kept as is"),
        "The one-line summary is long, really: z z": ("line", "z z"), "日本 語": ("line", "日本 語"), "éx": ("line", "éx"),
    }
    got = run(spark, [(k,) for k in cases], "t string", R.one_line_verdict(F.col("t"), 3))
    assert {k: (g.verdict, g.text) for k, g in zip(cases, got)} == cases and all(g.error is None for g in got)
    bad = run(spark, [(None,), ("",), ("```\n```",), ("`",), ("x",), ("...",), ("a b c d e f g",)], "t string", R.one_line_verdict(F.col("t"), 3))
    assert [b.error for b in bad] == ["empty reply"] * 6 + ["reply too long: 7 words (limit 6)"] and all(b.verdict is None for b in bad)


def test_docstring_verdicts(spark):
    long = "\n".join(f"line {i}" for i in range(20))
    cases = [
        ("DELETE", "class", False, "delete", None), ("delete. because\nx", "class", False, "delete", None), ("KEEP", "class", False, "delete", None), ("KEEP Text here.\nMore.  ", "class", False, "text", "Text here.\nMore."),
        ("Here is the rewritten docstring:\n\n```\nKEEP\n'''Body\n\n\n\nend'''\n```", "module", False, "text", "Body\n\nend"), ('"""Plain text."""', "function", False, "text", "Plain text."),
        ("Sure:\nDocstring:\nJust text\r\nmore", "function", False, "text", "Just text\nmore"), (long, "function", True, "text", "line 0\nline 1"), (long, "class", True, "text", long[: long.index("\nline 5")]),
        (long, "class", None, "text", long[: long.index("\nline 15")]), ("keep-- x", "class", False, "text", "x"), ("'\"'", "class", False, "text", '"'), ("KEEP\n\n\n", "class", False, "delete", None), ("a\n\n\nb", "function", True, "text", "a"),
    ]
    got = run(spark, [c[:3] for c in cases], "t string, k string, b boolean", R.doc_verdict(F.col("t"), F.col("k"), F.col("b")))
    assert [(g.verdict, g.text, g.error) for g in got] == [(*c[3:], None) for c in cases]
    bad = run(spark, [(None,), (" \n",), ("```\n```",), ("Sure:\n\n",), ('""""""',)], "t string", R.doc_verdict(F.col("t"), F.lit("class"), F.lit(False)))
    assert [b.error for b in bad] == ["empty reply"] * 5


def test_rewrites(spark):
    cases = [
        ("<think>a\nb</think>\n```\n// first\n//! second\n```", "first\nsecond"), ("/** Doc\n * more\n */", "Doc\nmore"), ("# x */", "x"), ('"`quoted`"', "quoted"), ("DELETE", None), ("  ", None), (None, None),
        ("#no space", "#no space"), ("x</think>", None), ("*\ny", "y"),
    ]
    assert run(spark, [(c[0],) for c in cases], "t string", R.clean_rewrite(F.col("t"))) == [c[1] for c in cases]


def test_labels(spark):
    cases = [
        ('{"verdict": "keep", "hazard": true}', {"verdict": {"keep": 1.0}, "hazard": {"true": 1.0}}),
        ('<think>{"verdict": "delete"}</think> so: {"labels": {"verdict": "keep", "c2": 3, "rewrite": "r", "n": null}}', {"verdict": {"keep": 1.0}, "c2": {"3": 1.0}}),
        ('{"verdict": "a"} then {"verdict": "b"} and {"other": 1}', {"verdict": {"b": 1.0}}),
        ('{"verdict": "a {brace} \\" }", "x": {"y": 1}} tail }', None),
        ('bad { here {"verdict": "ok"}', {"verdict": {"ok": 1.0}}), ('{"verdict": "a", }', None), ('{"verdict": "a"', None), ("none", None), (None, None), ('{"labels": 3, "verdict": "a"}', None),
        ('{"a": {"verdict": "inner"}}', {"verdict": {"inner": 1.0}}),
    ]
    labels = R.parse_labels(F.col("t"))
    got = run(spark, [(c[0],) for c in cases], "t string", R.one_hot(labels))
    want = [c[1] for c in cases]
    want[3] = {"verdict": {'a {brace} " }': 1.0}, "x": {'{"y":1}': 1.0}}
    assert got == want


def test_a_reply_is_worked_out_once(spark):
    df = spark.createDataFrame([("KEEP x", "class", False)], "the_reply string, k string, b boolean")
    t = F.col("the_reply")
    for made in (R.doc_verdict(t, F.col("k"), F.col("b")), R.one_line_verdict(t, 4), R.clean_rewrite(t), R.parse_labels(t)):
        plan = df.select(made.alias("v"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("the_reply#") == 2  # in the projection and in the table below it


def test_queries_work_out_a_verdict_once(spark):
    from marginalia.plans.queries import QUERIES

    plan = QUERIES["docstring_replies"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Here is the docstring") == 1


def test_white_space_of_all_scripts(spark):
    chars = spark.createDataFrame([(chr(i),) for i in range(0x10000) if not 0xD800 <= i < 0xE000], "c string")
    around = F.concat("c", "c", F.lit("a b"), "c")
    assert chars.where(R.trim(around) != F.regexp_replace(around, r"(?U)\A\s+|\s+\z", "")).count() == 0
    assert "".join(sorted(r.c for r in chars.where(R.trim(F.col("c")) == "").collect())) == R.WHITE
