"""Small cases of the operators that tables don't hold."""

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import changes, evidence, findings, structural
from marginalia.sources import files


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_units_and_numbers(spark):
    rows = [("limit 64 KB", "x=1"), ("1小时 or 5 seconds", "y=3"), ("takes 10%", "f(10)"), ("the second item", "a[1]"), ("in ms", "x86")]
    got = [g for (g,) in one(spark, rows, "c string, k string", T.unit_literal(F.col("c"), F.col("k")))]
    assert got == ["unit KB next to literal 1", "unit 小时 next to literal 3", "unit 10% next to literal 10", None, None]
    assert one(spark, [("x86, 3.5 or 7s; say 'a b', \"c\" but don't",)], "c string", T.numbers(F.col("c")), T.quoted(F.col("c"))) == [(["3.5", "7"], ["a b", "c"])]


def test_deletions_next_to_a_block(spark):
    items = spark.createDataFrame(
        [("p", 0, 4, 4, "comment", "# a", 1, 9, None, None), ("q", 0, 4, 4, "comment", "# a", 1, 9, None, None), ("r", 0, 4, 4, "comment", "# a", 4, 4, 6, 7)],
        "path string, item int, start_line int, end_line int, kind string, text string, scope_start int, scope_end int, annotated_start int, annotated_end int",
    )
    old = spark.createDataFrame([("p", 4, 4, "comment", "# a"), ("p", 6, 6, "comment", "# b"), ("q", 4, 6, "comment", "# a more")], "path string, start_line int, end_line int, kind string, text string")
    hunks = spark.createDataFrame([("p", 5, 2, 4, 0), ("q", 5, 2, 4, 0), ("r", 7, 1, 7, 1)], "path string, old_start int, old_count int, new_start int, new_count int")
    assert {r.path: r.tier for r in changes.tiers(items, hunks, old).collect()} == {"p": "scope_changed", "q": "modified", "r": "scope_changed"}


def test_text_evidence(spark):
    source = "# calls `run` and lost_name with 5s and 'red'\ndef run(x): return x + 6"
    stop = source.index("\n")
    items = [(source[:stop], source[stop + 1 :], source, 0, stop, "todo")]
    r = evidence.text_evidence(spark.createDataFrame(items, "comment string, code string, source string, start int, stop int, kind string")).first()
    assert [(m.token, m.resolved) for m in r.mentions] == [("run", True), ("lost_name", False)]
    assert r.unresolved == ["lost_name"] and r.literal_mismatch == ["5s", "red"] and r.todo_tracker is False and not r.signature_echo


def test_changed_mentions(spark):
    rows = [
        ("adds `tax_rate` to 5", "x = taxRate + 5", "x = 6", "x = 6"),
        ("adds `tax_rate`", "x = taxRate", "x  =  taxRate", "x  =  taxRate"),
        ("says \"hi\"", "p('hi')", "p('ho')", "p('ho')"),
    ]
    got = one(spark, rows, "c string, b string, a string, f string", evidence.changed_mentions(F.col("c"), F.col("b"), F.col("a"), F.col("f")))
    assert [g for (g,) in got] == [["tax_rate", "5"], [], ["hi"]]


def test_structural(spark):
    rows = [("#!/bin/sh", "yaml", 0, 0), ("#!/bin/sh", "yaml", 3, 40), ("# -*- coding: utf-8", "python", 1, 9), ("# noqa: E501", "python", 9, 90), ("// noqa", "rust", 9, 90), ("/** doc */", "tsx", 5, 50), ("// SAFETY: x", "rust", 5, 50), ("# plain", "python", 5, 50)]
    place = (F.col("l"), F.col("n"), F.col("o"), F.lit(True), F.lit(False))
    got = one(spark, rows, "c string, l string, n int, o int", structural.is_directive(F.col("c"), *place))
    assert [g for (g,) in got] == [True, False, True, True, False, True, True, False]


def test_sarif_log(spark):
    import json

    rows = [("b.py", 3, 4, "delete", "inline", "added", "say 'why'", [("g1", 0.7, 0.4)], "e"), ("a.py", 1, 1, "rename_instead", "inline", "added", "m", [], "")]
    schema = "path string, start_line int, end_line int, verdict string, kind string, tier string, message string, checks array<struct<name:string,value:double,threshold:double>>, evidence string"
    log = json.loads(findings.sarif_log(spark.createDataFrame(rows, schema)).first().log)
    run = log["runs"][0]
    assert run["tool"]["driver"]["version"] and run["tool"]["driver"]["rules"][1]["shortDescription"]["text"] == "Comment verdict: rename_instead"
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["comment/delete", "comment/rename_instead"]
    assert [r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in run["results"]] == ["a.py", "b.py"]
    assert run["results"][1]["message"]["text"] == "delete (inline, added) say 'why'; g1=0.70/0.40; e" and run["results"][1]["level"] == "warning"


def test_ignore_patterns(spark):
    rows = [("a/x.log",), ("a/keep.log",), ("b/x1.py",), ("b/xa.py",), ("build/y.py",)]
    got = one(spark, rows, "p string", files.is_ignored(F.col("p"), ("*.log", "!keep.log", "b/x[0-9].py", "build/", "# note")))
    assert [g for (g,) in got] == [True, False, True, False, True]


def test_runs_and_gold(spark, tmp_path):
    import json

    (tmp_path / "runs").mkdir()
    (tmp_path / "runs/a.json").write_text(json.dumps({"id": "x", "verdict": "keep"}) + "\n")
    (tmp_path / "runs/b.json").write_text(json.dumps({"id": "x", "verdict": "delete"}) + "\n" + json.dumps({"id": "y", "verdict": "keep"}) + "\n")
    assert {r.id: r.verdict for r in files.read_runs(spark, f"{tmp_path}/runs").collect()} == {"x": "delete", "y": "keep"}
    (tmp_path / "gold.jsonl").write_text("\n" + json.dumps({"id": "x", "comment_kind": "todo", "labels": {"verdict": "keep"}}) + "\n")
    assert files.is_gold(spark, f"{tmp_path}/gold.jsonl") and not files.is_gold(spark, f"{tmp_path}/runs")
    gold = files.read_gold(spark, f"{tmp_path}/gold.jsonl").where("id is not null")
    assert files.missing_runs(gold, files.read_runs(spark, f"{tmp_path}/runs")).count() == 0


def test_comment_kind(spark):
    rows = [("#!/bin/sh", True, False), ("# pragma: x", True, False), ("/** @vitest-environment x */", False, True), ("# NOTE: x", False, False), ("# @todo x", False, False), ("# TODO x", True, True), ("# éTODO", False, False), ("# x", None, None)]
    got = one(spark, rows, "c string, d boolean, a boolean", structural.comment_kind(F.col("c"), F.col("d"), F.col("a")))
    assert [g for (g,) in got] == ["directive", "directive", "directive", "inline", "todo", "api_doc", "inline", "inline"]


def test_gate_keeps_unknown_mentions(spark):
    from marginalia.operators import curation

    rows = [(1, "scope_changed", []), (2, "scope_changed", None), (3, "scope_changed", ["x"]), (4, "added", []), (5, None, [])]
    items = spark.createDataFrame(rows, "id int, tier string, changed_mentions array<string>")
    assert sorted(r.id for r in curation.gated(items).collect()) == [2, 3, 4, 5]
    assert sorted(r.id for r in curation.gated(items, has_judge=False).collect()) == [4, 5]


def test_false_accepts_are_drop_and_invent_only(spark):
    from marginalia.operators import verify

    rows = [("gold", True, 0.99, 0.0, 0.0), ("gold", False, 0.99, 0.0, 0.0), ("other", True, 0.99, 0.0, 0.0), ("drop", True, 0.5, 0.0, None), ("invent", False, 0.97, 0.3, 0.2)]
    rates = verify.accept_rates(spark.createDataFrame(rows, "variant string, good boolean, preserves double, adds double, g1_candidate double"))
    at = rates.where("th_preserves = 0.95 and th_adds = 0.4 and th_g1 = 0.3").first()
    assert (at.gold_accepted, at.gold_total, at.bad_accepted, at.bad_total, at.drop_accepted, at.invent_accepted) == (1, 1, 1, 2, 0, 1)
    loosest = rates.where("th_preserves = 0.0 and th_adds = 1.01 and th_g1 = 1.01").first()
    assert (loosest.bad_accepted, rates.count()) == (2, 4096)
    none = verify.accept_rates(spark.createDataFrame([], "variant string, good boolean, preserves double, adds double, g1_candidate double"))
    assert none.count() == 4096 and none.agg({"gold_total": "max"}).first()[0] == 0


def test_tuning_by_cells_is_the_policy_at_every_point(spark):
    """A small grid against the policy itself, point by point; the given thresholds win ties."""
    import random

    from marginalia.operators import tuning

    rng = random.Random(6)
    half = lambda: rng.choice([0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.9, 0.1])
    rows = []
    for i in range(60):
        yes = lambda: {"true": (p := half()), "false": 1 - p}
        score = lambda: {"0": 1 - (p := half()), "1": p / 2, "3": p / 2}
        answers = {"g1_contradicts": yes(), "hazard": yes(), "leak": yes(), "c2_info_gain": score(), "c3_rationale": score(), "c5_contract": score(), "c8_durability": score(), "c9_replaceable": {"no": 0.6, "fully": half()}}
        for q in list(answers):
            if rng.random() < 0.04:
                del answers[q]
        if rng.random() < 0.5:
            answers["verdict"] = rng.choice([{"keep": 0.5, "delete": 0.5}, {"delete": 1.0}, {"rewrite_shorter": 0.8, "keep": 0.2}])
        rows.append((rng.choice(["inline", "api_doc", "todo", None]), rng.choice(["a", "a\nb"]), answers, rng.choice([None, "u"]), rng.choice(["keep", "delete", "rewrite_shorter", "fix_wrong_claim"]), rng.choice([True, False, None]), half(), None))
    items = spark.createDataFrame(rows, "kind string, comment string, answers map<string,map<string,double>>, unit string, gold string, hazard_label boolean, adds double, g1_candidate double").cache()
    one_value = {a: (v[0],) for a, v in tuning.GRID.items()}
    grid = one_value | {"g1": (0.4, 0.6), "c2_min": (0.5, 1.0), "margin": (0.0, 0.15), "use_holistic": (True, False)}
    costs = {tuple(r)[1:-1]: r.cost for r in tuning.grid_costs(items, None, grid).collect()}
    assert len(costs) == 16
    for point in list(costs)[::3]:
        th = dict(zip(grid, point))
        assert costs[point] == tuning.cost_at(items, th).first().cost, point
    best = tuning.tune(items, None, one_value).first()
    assert best.place == -1 or best.cost < tuning.cost_at(items).first().cost


def test_rewrites_and_second_tier(spark):
    from marginalia.functions import policy as P

    rows = [("a", "ab"), ("a\nb", "abc"), ("ab\n", "a\nb"), ("", "a"), ("éé", "éé"), ("a\n\n", "a\nb")]
    got = one(spark, rows, "c string, o string", P.shorter(F.col("c"), F.col("o")))
    assert [g for (g,) in got] == [True, False, True, True, False, False]
    rows = [("scope_changed", "keep", False), ("scope_changed", "delete", False), ("scope_changed", "stale", True), ("scope_changed", None, None), ("added", "delete", True), (None, "delete", True)]
    got = one(spark, rows, "t string, v string, e boolean", P.breaks_second_tier(F.col("t"), F.col("v"), F.col("e")))
    assert [g for (g,) in got] == [False, True, True, True, False, False]
    rows = [("x", None, "xy", True, 0.99, 0.0, 0.0), ("", None, "xy", True, 0.99, 0.0, 0.0), ("xyz", None, "xy", True, 0.99, 0.0, 0.0), ("xyz", None, "xy", False, 0.99, 0.0, 0.0), ("x", "unsafe", "xy", True, 0.99, 0.0, 0.0), ("x", None, "xy", True, None, 0.0, 0.0)]
    got = one(spark, rows, "c string, u string, o string, m boolean, p double, a double, g double", P.rewrite_fault(*map(F.col, "cuompag")))
    assert [g for (g,) in got] == [None, "generator gave no text", "not shorter", None, "unsafe", "drops content"]


def test_reply_scores_of_nothing(spark):
    from marginalia.operators import metrics

    row = metrics.reply_scores(spark.createDataFrame([], "expected string, verdict string, text string")).first()
    assert tuple(row) == (0, 0, 0, 0, 0, 0)
    rows = [("DELETE", "delete", None), ("x", "text", "a b\n\nc\n"), ("DELETE", "text", "z"), ("x", None, "not counted")]
    row = metrics.reply_scores(spark.createDataFrame(rows, "expected string, verdict string, text string")).first()
    assert tuple(row) == (3, 2 / 3, 1.0, 0.5, 2.0, 2.0)


def test_json_objects_keep_their_order(spark):
    import json

    from marginalia.operators import records as R

    first, second = {"b": R.json_value(F.col("x")), "a": R.json_value(F.lit(None).cast("string"))}, {"a": R.json_value(F.lit(1)), "é": R.json_value(F.array(F.lit(1.5)))}
    (row,) = one(spark, [('q"\n',), ], "x string", R.json_object(first, second), R.json_object(first, second, sort=True))
    assert row == ('{"b":"q\\"\\n","a":null,"é":[1.5]}', '{"a":null,"b":"q\\"\\n","é":[1.5]}') and json.loads(row[0])["b"] == 'q"\n'
    got = one(spark, [("untouched",), (None,), ("scope_changed",), ("added",)], "t string", R.change_record(F.col("t"), F.lit("c"), F.array(F.lit("m"))))
    assert [g and tuple(g) for (g,) in got] == [None, None, (False, False, True, "c", ["m"]), (True, False, False, None, [])]
