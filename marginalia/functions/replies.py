"""Replies of chat models read by column expressions: one-line and docstring verdicts, rewrites, label objects.

White space and word characters are those of all scripts. A null reply reads as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Openings that models put before their answer.
PREAMBLE = r"(?iU)\A(here('s| is)\b|sure\b|certainly\b|the (one[- ]line )?summary( is)?\b)[^:]{0,40}:\s*"
#: A line without content, or one that opens a docstring's reply.
DOC_OPENING = r"(?iU)\A\s*(?:(docstring|here('s| is)\b.*|sure|certainly)\s*:?\s*)?\z"
MARKER = r"(?U)\A(?://+!?|#+|/\*+|\*)(?:\s|\z)"
# Fixed value: the white space of all scripts, what \s matches in Unicode patterns.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Most lines of a rewritten docstring: a test function's, a test module's or class's, any other's.
TEST_FUNCTION_LINES, TEST_LINES, MOST_LINES = 2, 5, 15


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once for a row, however often ``use`` names it.

    Spark works out equal parts of array functions anew wherever they are written; a lambda's variable is bound.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def trim(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def _trim_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def lines(text: Column) -> Column:
    """Lines without their ends; a line end at the end of the text begins no line."""
    cut = lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x)
    return once(F.split(text, "\r?\n", -1), cut)


def unquoted(text: Column, triple: bool) -> Column:
    """Text without the quotes around it, as often as it has some; with ``triple``, three equal quotes go at once."""
    single = r"(?s)\A([\"'`]).*\1\z"
    thrice = r"(?s)\A(?:\"{3}.*\"{3}|'{3}.*'{3})\z"
    inner = lambda s, n: trim(F.substring(s, F.lit(n + 1), F.greatest(F.length(s) - 2 * n, F.lit(0))))

    def strip(s: Column, _: Column) -> Column:
        out = F.when(s.rlike(single), inner(s, 1)).otherwise(s)
        return F.when((F.length(s) >= 6) & s.rlike(thrice), inner(s, 3)).otherwise(out) if triple else out

    rounds = lambda s: F.length(F.regexp_extract(s, r"(?U)\A[\s\"'`]*", 0))  # noqa: E731 each strips one of them at least
    return once(trim(text), lambda s: F.aggregate(F.sequence(F.lit(0), rounds(s)), s, strip))


def clean_reply(raw: Column) -> Column:
    """The first line that holds an answer, without fences, preamble, quotes and comment marks; empty if none is left."""
    kept = F.filter(F.transform(lines(F.coalesce(raw, F.lit(""))), trim), lambda x: (x != "") & ~F.startswith(x, F.lit("```")))
    first = F.coalesce(F.try_element_at(kept, F.lit(1)), F.lit(""))

    def bare(x: Column) -> Column:
        rest = once(trim(F.regexp_replace(x, PREAMBLE, "")), lambda r: F.when(r != "", r).otherwise(x))
        text = F.regexp_replace(unquoted(rest, triple=False), r"(?U)\A[#/*]+\s*", "")
        text = _trim_end(F.regexp_replace(_trim_end(text), r"(?:\*/)+\z", ""))
        return trim(F.regexp_replace(text, r"(?U)\s+", " "))

    junk = lambda x: ~x.rlike(r"[\p{IsAlphabetic}\p{N}]") | (~F.contains(x, F.lit(" ")) & (F.octet_length(x) < 2))
    return once(once(first, bare), lambda x: F.when(junk(x), "").otherwise(x))


def _verdict(verdict: str | None, text: Column | None = None, error: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(F.lit(verdict).cast("string").alias("verdict"), (null if text is None else text).alias("text"), (null if error is None else error).alias("error"))


def one_line_verdict(raw: Column, max_words: int) -> Column:
    """struct<verdict, text, error> of a reply like ``D3`` or ``K1 text``: delete, or line with its text.

    A kept comment without text is deleted. An empty reply, or one of over twice ``max_words`` words, is an error.
    """

    def read(x: Column) -> Column:
        code = F.regexp_replace(F.substring_index(x, " ", 1), r"[:.\-]+\z", "")
        rest = F.when(F.contains(x, F.lit(" ")), trim(F.regexp_replace(x, r"\A[^ ]* ", ""))).otherwise("")
        text = F.when(code.rlike(r"\AK[0-9]\z"), rest).otherwise(x)
        words = F.size(F.split(text, " "))
        long = F.concat(F.lit("reply too long: "), words.cast("string"), F.lit(f" words (limit {2 * max_words})"))
        return (
            F.when(x == "", _verdict(None, error=F.lit("empty reply")))
            .when(code.rlike(r"\AD[0-9]\z") | (F.lower(code) == "delete") | (text == ""), _verdict("delete"))
            .when(words > 2 * max_words, _verdict(None, error=long))
            .otherwise(_verdict("line", text))
        )

    return once(clean_reply(raw), read)


def _without_blank_runs(rows: Column) -> Column:
    """No blank rows at either end, and of several in a row one."""

    def ends(r: Column) -> Column:
        filled = F.filter(F.sequence(F.lit(0), F.size(r)), lambda i: F.coalesce(F.get(r, i) != "", F.lit(False)))
        none = F.array().cast("array<string>")
        return once(filled, lambda i: F.when(F.size(i) == 0, none).otherwise(F.slice(r, F.try_element_at(i, F.lit(1)) + 1, F.try_element_at(i, F.lit(-1)) - F.try_element_at(i, F.lit(1)) + 1)))

    single = lambda r: F.filter(r, lambda line, i: (line != "") | (F.coalesce(F.get(r, i - 1), F.lit("")) != ""))
    return once(once(rows, ends), single)


def max_doc_lines(kind: Column, is_test: Column) -> Column:
    return F.when(is_test, F.when(kind == "function", TEST_FUNCTION_LINES).otherwise(TEST_LINES)).otherwise(MOST_LINES)


def doc_verdict(raw: Column, kind: Column, is_test: Column) -> Column:
    """struct<verdict, text, error> of a reply about a docstring: delete, or text in at most its kind's lines.

    ``DELETE`` as the first word deletes whatever follows, ``KEEP`` is left out of the text; nothing to keep is a
    deletion, an empty reply an error.
    """
    unfenced = F.filter(lines(F.coalesce(raw, F.lit(""))), lambda x: ~x.rlike(r"(?U)\A\s*```"))
    from_line = lambda rows, at: F.array_join(F.slice(rows, F.greatest(at, F.lit(1)).cast("int"), F.size(rows)), "\n")

    def body(rows: Column) -> Column:
        at = F.array_position(F.transform(rows, lambda x: ~x.rlike(DOC_OPENING)), F.lit(True))
        return once(at, lambda i: F.when(i > 0, unquoted(from_line(rows, i), triple=True)).otherwise(""))

    def shorten(text: Column) -> Column:
        clean = _without_blank_runs(F.transform(lines(text), _trim_end))
        capped = _without_blank_runs(F.slice(clean, F.lit(1), max_doc_lines(kind, is_test)))
        return once(capped, lambda r: F.when(F.size(r) == 0, _verdict("delete")).otherwise(_verdict("text", trim(F.array_join(r, "\n")))))

    def read(text: Column, rows: Column, first: Column) -> Column:
        marker = F.lower(F.regexp_replace(F.regexp_extract(first, r"(?U)\A\S*", 0), r"[.:!\-]+\z", ""))
        rest = F.regexp_replace(first, r"(?U)\A\S*\s*", "")
        kept = F.array_join(F.concat(F.array(rest), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))), "\n")
        said = lambda m: shorten(unquoted(F.when(m == "keep", kept).otherwise(text), triple=True))
        return once(marker, lambda m: F.when(F.size(rows) == 0, _verdict(None, error=F.lit("empty reply"))).when(m == "delete", _verdict("delete")).otherwise(said(m)))

    first = lambda rows: trim(F.coalesce(F.try_element_at(rows, F.lit(1)), F.lit("")))
    return once(once(unfenced, body), lambda text: once(lines(text), lambda rows: once(first(rows), lambda f: read(text, rows, f))))


def clean_rewrite(reply: Column) -> Column:
    """A rewritten comment without reasoning, fences and comment marks; null if nothing or ``delete`` is left."""
    rows = F.transform(lines(F.substring_index(F.coalesce(reply, F.lit("")), "</think>", -1)), trim)
    rows = F.filter(rows, lambda x: ~F.startswith(x, F.lit("```")) & (x != "*/"))
    rows = F.transform(rows, lambda x: trim(F.regexp_replace(F.regexp_replace(x, MARKER, ""), r"(?:\*/)+\z", "")))
    text = trim(F.regexp_replace(trim(F.array_join(rows, "\n")), "\\A[\"`]+|[\"`]+\\z", ""))
    return once(text, lambda x: F.when((x != "") & (F.lower(x) != "delete"), x))


def _object_at(text: Column) -> Column:
    """The balanced object that a text begins with, or null: a fold over its characters with depth and quoting state."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(s["quoted"], 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        n = s["n"] + 1
        quote = (c == '"') & ~s["escaped"]
        moved = F.struct(
            depth.alias("depth"), F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), (s["quoted"] & ~s["escaped"] & (c == "\\")).alias("escaped"), n.alias("n"),
            F.when((depth == 0) & (c == "}") & ~s["quoted"], n).otherwise(0).alias("end"),
        )
        return F.when(s["end"] > 0, s).otherwise(moved)

    end = F.aggregate(F.split(text, "", -1), start, step)["end"]
    return F.when(end > 0, F.substring(text, F.lit(1), end))


def parse_labels(reply: Column) -> Column:
    """The last object with a ``verdict``, bare or under ``labels``, as a variant; null if there is none.

    Reasoning between think marks is left out. An object whose ``labels`` is none itself holds no labels.
    """
    text = F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?s)<think>.*?</think>", "")
    box = F.array(text)

    def found(x: Column) -> Column:
        # What stands behind each opening brace, where a verdict still follows.
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.substring(x, i, F.lit(1)) == "{")
        tails = F.filter(F.transform(places, lambda i: F.substring(x, i, F.length(x))), lambda s: F.contains(s, F.lit('"verdict"')))
        objects = F.transform(tails, lambda s: F.try_parse_json(_object_at(s)))
        inner = F.transform(objects, lambda v: F.struct(v.alias("v"), F.try_variant_get(v, "$.labels", "variant").alias("l")))
        is_object = lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
        labels = F.transform(inner, lambda e: F.when(e["l"].isNull(), e["v"]).when(is_object(e["l"]), e["l"]))
        return F.try_element_at(F.filter(labels, lambda v: F.try_variant_get(v, "$.verdict", "variant").isNotNull()), F.lit(-1))

    return F.element_at(F.transform(box, found), 1)


def one_hot(labels: Column) -> Column:
    """map<question, map<option, 1.0>> of a labels variant; nulls and the free texts are left out."""
    entries = F.map_filter(labels.cast("map<string,variant>"), lambda k, v: v.isNotNull() & ~F.is_variant_null(v) & ~k.isin("rewrite", "rename_suggestion"))
    option = lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string")).otherwise(F.to_json(v))
    return F.transform_values(entries, lambda k, v: F.create_map(option(v), F.lit(1.0)))
