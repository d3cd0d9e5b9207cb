"""Edits against a plain replay from the back, multi-byte text and overlaps included."""

import random

from pyspark.sql import functions as F

from marginalia.operators import edits as ED


def replay(source, edits):
    data, floor = source.encode(), len(source.encode())
    for _, _, start, end, text in sorted(edits, key=lambda e: -e[2]):
        end = min(end, floor)
        start = min(start, end)
        data = data[:start] + text.encode() + data[end:]
        floor = start
    return data.decode()


def test_application_is_a_replay(spark):
    rng = random.Random(11)
    files, edits, want = [], [], {}
    for i in range(300):
        chars = [rng.choice("aé日😀\n ") for _ in range(rng.randrange(12))]
        borders = [len("".join(chars[:k]).encode()) for k in range(len(chars) + 1)]
        own = []
        for seq in range(rng.randrange(5)):
            a, b = sorted((rng.choice(borders), rng.choice(borders)))
            own.append((i, seq, a, b, rng.choice(["", "x", "éé"])))
        files.append((i, "".join(chars)))
        edits += own
        want[i] = replay("".join(chars), own)
    f = spark.createDataFrame(files, "path int, source string")
    e = spark.createDataFrame(edits, "path int, seq int, start long, end long, replacement string").repartition(5)
    got = {r.path: r for r in ED.apply_edits(f, e).collect()}
    assert {k: r.after for k, r in got.items()} == want and not any(r.set_aside for r in got.values())


def test_faults_are_set_aside(spark):
    f = spark.createDataFrame([("a", "é日"), ("b", "xy"), ("c", None), ("d", "")], "path string, source string")
    rows = [("a", 0, 0, 2, "e"), ("a", 1, 1, 2, ""), ("a", 2, 5, 9, ""), ("a", 3, 2, 1, ""), ("a", 4, None, 1, ""), ("a", 5, 2, 4, ""), ("d", 0, 0, 0, "new"), ("z", 0, 0, 0, "x"), ("c", 0, 0, 0, "x")]
    e = spark.createDataFrame(rows, "path string, seq int, start int, end int, replacement string")
    strict = {r.path: r for r in ED.apply_edits(f, e).collect()}
    assert (strict["a"].after, strict["a"].n_applied) == (None, 0)
    assert sorted(x.reason for x in strict["a"].set_aside) == ["inside_character", "inside_character", "missing", "outside", "reversed"]
    assert (strict["b"].after, strict["d"].after, strict["c"].after) == ("xy", "new", None)
    loose = {r.path: r for r in ED.apply_edits(f, e, strict=False).collect()}
    assert (loose["a"].after, loose["a"].n_applied) == ("e日", 1)


def test_deleted_lines(spark):
    cases = [
        ("x\n  # c\ny\n", "# c", 2, "x\ny\n"), ("x\n# c", "# c", 0, "x"), ("x\r\n# c", "# c", 0, "x"), ("# c", "# c", 0, ""), ("\n# c\n\ny", "# c", 0, "\ny"),
        ("# c\n\ny", "# c", 0, "y"), ("x\n# c\n\ny", "# c", 0, "x\n\ny"), ("é\n \n # c\n\t\nz", "# c", 1, "é\n \nz"), ("a\n# c  \nb", "# c", 0, "a\nb"), ("a\n\n# c\n", "# c", 0, "a\n\n"),
        ("a\n\n# c\n ", "# c", 0, "a\n\n"), ("a\n# c\n# d\nb", "# c\n# d", 0, "a\nb"),
    ]
    rows = [(i, s, len(s[: s.index(c)].encode()), len(s[: s.index(c)].encode()) + len(c.encode()), d) for i, (s, c, d, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "path int, source string, a int, b int, d int")
    cut = df.withColumn("r", ED.line_deletion(*map(F.col, ("source", "a", "b", "d"))))
    done = ED.apply_edits(df, cut.select("path", F.lit(0).alias("seq"), "r.start", "r.end", F.lit("").alias("replacement")))
    assert {r.path: r.after for r in done.collect()} == {i: w for i, (*_, w) in enumerate(cases)}
