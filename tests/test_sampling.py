"""Turns against a sequential replay, agents of ranges, docstring text against a character loop."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import sampling as SA
from marginalia.plans import sampling_queries as Q


def replay(rows, groups, cycle, n):
    """The rule as it is said: one row after the other, repositories in a set."""
    used, taken = set(), []
    for _ in range(200):
        for g in groups:
            if len(taken) < n:
                language = cycle[(len(taken) // len(groups) + groups.index(g)) % len(cycle)]
                for want in (language, None):
                    free = [r for r in rows if r.grp == g and r.repo not in used and (want is None or r.language == want)]
                    if free:
                        used.add(free[0].repo)
                        taken.append((len(taken) + 1, free[0].id))
                        break
    return taken


@pytest.mark.parametrize("n", [7, 30])
def test_turns(spark, n):
    for table in (Q.pulls(spark, "/root/testdata/sf0.001"), Q.pulls(spark, "/root/testdata/sf0.001").where("id % 40 = 1").unionByName(spark.createDataFrame([(None, "2-HIGH", "x", 1), (1, None, None, None)], "id long, grp string, language string, repo long"))):
        rows = table.where("id is not null and grp is not null and language is not null and repo is not null").orderBy(F.xxhash64("id", F.lit(1)), "id").collect()
        got = SA.round_robin(table, Q.GROUPS, Q.CYCLE, n).orderBy("turn").collect()
        assert [(r.turn, r.id) for r in got] == replay(rows, Q.GROUPS, Q.CYCLE, n)
        assert len({r.repo for r in got}) == len(got)
    assert SA.round_robin(table.limit(0), Q.GROUPS, Q.CYCLE, n).count() == 0


def test_agents_and_authorship(spark):
    rows = [("a", i, "late" if i > 200 else ["y", None, "x", "y"][i % 4]) for i in range(1, 260)] + [("b", 1, None)]
    got = {r.range: r.agents for r in SA.agents_in_range(spark.createDataFrame(rows, "range string, position int, agent string")).collect()}
    assert got == {"a": ["x", "y"], "b": []}
    rows = [("added", None, None, ["x", "y"]), ("modified", None, None, []), ("scope_changed", None, None, ["x"]), ("added", False, None, ["x"]), ("added", True, "z", ["x"]), ("added", None, None, None)]
    df = spark.createDataFrame(rows, "t string, b boolean, a string, all array<string>")
    assert [tuple(r.x) for r in df.select(SA.authorship(*map(F.col, ("t", "b", "a", "all"))).alias("x")).collect()] == [(True, "x"), (False, None), (None, None), (False, None), (True, "z"), (None, None)]


def plain_clean(raw):
    out, at = "", 0
    for c in raw:
        if c == "\t":
            out += " " * (8 - at % 8)
            at += 8 - at % 8
        else:
            out += c
            at = 0 if c == "\n" else at + 1
    rows = [x.rstrip("\r") for x in out.split("\n")]
    margins = [len(x.encode()) - len(x.lstrip().encode()) for x in rows[1:] if x.lstrip()]
    rows[0] = rows[0].lstrip()
    if margins:
        rows[1:] = [x.encode()[min(margins) :].decode() for x in rows[1:]]
    while rows and not rows[-1]:
        rows.pop()
    while rows and not rows[0]:
        rows.pop(0)
    return "\n".join(rows)


def test_clean_doc(spark):
    rng = random.Random(12)
    texts = ["", "a", "\n\n  x\n    y\n  \n", "\tx\r\n\ty\r", "x\n \té\n        z", "  a\n\n\n b"]
    texts += ["".join(rng.choice(["\t", " ", "  ", "a", "é", "\n", "\n\t", "\r\n"]) for _ in range(rng.randrange(25))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.x for r in df.select("i", T.clean_doc(F.col("t")).alias("x")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_clean(t), repr(t)
