"""Evidence about what a comment says: mentions and literals against the code, and what a change touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def text_evidence(items: DataFrame) -> DataFrame:
    """``items(.., comment, code, source, start, stop, kind)`` with the evidence columns.

    ``start`` and ``stop`` are the comment's character offsets in ``source``. mentions: the identifiers named,
    each with whether it occurs in the source outside the comment; unresolved: those that don't;
    literal_mismatch: numbers, with their units, and quoted strings that the code lacks; overlap and
    signature_echo: by tokens; todo_tracker: whether a todo names a ticket, a person or a link, null for other
    kinds; unit_literal: a unit next to the code's number. Everything is one projection, without a shuffle.
    """
    comment, code = F.col("comment"), F.col("code")
    before, behind = F.substring("source", F.lit(1), F.col("start")), F.substring("source", F.col("stop") + 1, F.length("source"))
    key = T.mention_key
    found = F.transform(T.mentions(comment), lambda m: F.struct(m.alias("token"), (F.contains(before, key(m)) | F.contains(behind, key(m))).alias("resolved")))
    numbers = F.filter(F.regexp_extract_all(comment, F.lit(T.NUMBER_UNIT), 1), lambda m: ~F.array_contains(T.numbers(code), F.regexp_extract(m, T.NUMBER, 0)))
    strings = F.filter(T.quoted(comment), lambda q: ~F.contains(code, q))
    words, of_code = T.tokens(comment), T.tokens(code)
    first_line = F.element_at(F.split(code, "\n"), 1)
    return items.withColumns({
        "mentions": found,
        "unresolved": F.transform(F.filter(found, lambda m: ~m["resolved"]), lambda m: m["token"]),
        "literal_mismatch": F.concat(numbers, strings),
        "overlap": T.overlap(words, of_code),
        "signature_echo": (F.col("kind") == "api_doc") & T.signature_echo(words, T.tokens(first_line)),
        "todo_tracker": F.when(F.col("kind") == "todo", T.unicode_rlike(comment, T.TRACKER)),
        "unit_literal": T.unit_literal(comment, code),
    })


def changed_mentions(comment: Column, before: Column, after: Column, after_file: Column) -> Column:
    """What in a comment the change from ``before`` to ``after`` touched, in the comment's order; empty: nothing.

    An identifier counts when it is on a line of ``before`` that the new file has nowhere, white space and
    case styles aside; a number or quoted string when ``before`` had it and ``after`` doesn't.
    """
    squashed = lambda code: F.transform(F.split(code, "\n"), T.squash)
    gone = F.filter(F.array_except(squashed(before), squashed(after_file)), lambda x: x != "")
    names = F.flatten(F.transform(gone, lambda x: F.transform(F.regexp_extract_all(x, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1), T.fold)))
    idents = F.filter(T.mentions(comment), lambda m: F.array_contains(names, T.fold(T.mention_key(m))))
    lost = F.array_except(T.numbers(before), T.numbers(after))
    numbers = F.filter(T.numbers(comment), lambda n: F.array_contains(lost, n))
    strings = F.filter(T.quoted(comment), lambda q: F.contains(before, q) & ~F.contains(after, q))
    return F.array_distinct(F.concat(idents, numbers, strings))
