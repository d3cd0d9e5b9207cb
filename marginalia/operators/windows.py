"""Windows of source lines around an item, and the text shown to a judge under a token budget.

All of it is array functions within a row: nothing is exploded or shuffled, and a window costs what its lines do.
Rows and columns count from 0, columns in bytes; ranges end before their end unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

#: Rows that a scope window holds, and rows on either side of an item at top level.
SCOPE_ROWS, SIDE_ROWS = 80, 40
_BLANK = r"(?U)\A\s*\z"


def _int(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _rows(lines: Column, lo: Column, hi: Column) -> Column:
    """lines[lo:hi], clamped like a slice."""
    return F.slice(lines, F.greatest(lo, F.lit(0)) + 1, F.greatest(F.least(hi, F.size(lines)) - F.greatest(lo, F.lit(0)), F.lit(0)))


def scope_bounds(n_lines: Column, first: Column, last: Column, scope_first: Column, scope_last: Column, code_lo: Column, code_hi: Column) -> Column:
    """struct<lo, hi>: the enclosing scope (``scope_first`` to ``scope_last``, inclusive, null at top level) or 40 rows on
    either side, widened to the attached code and cut to 80 rows around the item's rows ``first`` to ``last``."""
    lo = F.least(F.coalesce(scope_first, F.greatest(first - SIDE_ROWS, F.lit(0))), code_lo)
    hi = F.greatest(F.coalesce(scope_last + 1, F.least(last + SIDE_ROWS + 1, n_lines)), code_hi)
    near = F.greatest(lo, F.least(F.greatest(first - (SIDE_ROWS - 1), F.lit(0)), code_lo))
    end = F.least(hi, near + SCOPE_ROWS)
    short = code_hi > end
    cut = F.struct(F.when(short, F.greatest(code_hi - SCOPE_ROWS, F.lit(0))).otherwise(near).alias("lo"), F.when(short, code_hi).otherwise(end).alias("hi"))
    return F.when(hi - lo > SCOPE_ROWS, cut).otherwise(F.struct(lo.alias("lo"), hi.alias("hi")))


def _head(line: Column, col: Column) -> Column:
    """The bytes before ``col``; the whole line if that is no place between characters."""
    cut = F.substring(F.encode(line, "utf-8"), F.lit(1), col)
    return F.when((col <= F.octet_length(line)) & F.is_valid_utf8(cut), F.decode(cut, "utf-8")).otherwise(line)


def _tail(line: Column, col: Column) -> Column:
    """The bytes from ``col`` on; nothing if that is no place between characters."""
    cut = F.substring(F.encode(line, "utf-8"), col + 1, F.octet_length(line))
    return F.when((col <= F.octet_length(line)) & F.is_valid_utf8(cut), F.decode(cut, "utf-8")).otherwise("")


def rows_without(lines: Column, lo: Column, hi: Column, start_row: Column, start_col: Column, end_row: Column, end_col: Column) -> Column:
    """Rows ``lo`` to ``hi`` without the item; a row that the cut leaves blank goes, all others stay as they are."""
    top = F.greatest(lo, F.lit(0))

    def row(line: Column, i: Column) -> Column:
        at = i + top
        left = F.when(at == start_row, _head(line, start_col)).otherwise("")
        right = F.when(at == end_row, _tail(line, end_col)).otherwise("")
        rest = F.concat(left, right)
        return F.when(~at.between(start_row, end_row), line).when(~rest.rlike(_BLANK), rest)

    return F.array_join(F.array_compact(F.transform(_rows(lines, lo, hi), row)), "\n")


def classifier_context(
    source: Column, start: Column, end: Column, start_row: Column, end_row: Column, scope_first: Column, scope_last: Column, header: Column
) -> Column:
    """The scope's text without the item's bytes ``start`` to ``end``, trimmed.

    A null ``scope_first`` is top level. There and in scopes over 80 rows only the 40 rows on either side stay; if they
    leave out a scope's begin, its ``header`` (null where it has none) comes first.
    """
    lines = F.split(source, "\n", -1)
    n = F.size(lines)
    first = F.coalesce(scope_first, F.lit(0))
    last = F.least(F.coalesce(scope_last, n - 1), n - 1)
    large = scope_first.isNull() | (F.greatest(last - first, F.lit(0)) > SCOPE_ROWS)
    lo = F.when(large, F.greatest(start_row - SIDE_ROWS, first, F.lit(0))).otherwise(first)
    hi = F.when(large, F.least(end_row + SIDE_ROWS, last)).otherwise(last)
    before = F.octet_length(F.array_join(F.slice(lines, F.lit(1), lo), "\n")) + F.when(lo > 0, 1).otherwise(0)
    until = F.octet_length(F.array_join(F.slice(lines, F.lit(1), hi + 1), "\n")) + F.when(hi + 1 < n, 1).otherwise(0)
    data = F.encode(source, "utf-8")
    piece = lambda a, b: F.decode(F.substring(data, a + 1, F.greatest(b - a, F.lit(0))), "utf-8")
    shown = F.when((lo > first) & scope_first.isNotNull() & header.isNotNull(), F.concat(F.regexp_replace(header, r"(?U)\s+\z", ""), F.lit("\n"))).otherwise("")
    return F.regexp_replace(F.concat(shown, piece(before, start), piece(end, until)), r"(?U)\A\s+|\s+\z", "")


_PY_EDGE = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def centre_row(scope: Column, code: Column) -> Column:
    """The scope's row in the middle of the attached code: its first line that isn't blank is looked for; else half way."""
    lines, wanted = T.py_splitlines(scope), T.py_splitlines(code)
    first = F.try_element_at(F.filter(F.transform(wanted, lambda x: F.regexp_replace(x, _PY_EDGE, "")), lambda x: x != ""), F.lit(1))
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, first)), F.lit(True))
    start = F.when(first.isNotNull() & (at > 0), at - 1).otherwise(F.floor(F.size(lines) / 2))
    return start + F.floor(F.size(wanted) / 2)


def window_text(lines: Column, centre: Column, half: Column) -> Column:
    """``half`` rows on either side of the centre, dots where rows are left out."""
    n = F.size(lines)
    lo, hi = F.greatest(centre - half, F.lit(0)), F.least(n, centre + half + 1)
    dots = F.array(F.lit("..."))
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(F.when(lo > 0, dots).otherwise(none), _rows(lines, lo, F.greatest(lo, hi)), F.when(hi < n, dots).otherwise(none)), "\n")


def scope_window(scope: Column, code: Column, half: int | Column) -> Column:
    return window_text(T.py_splitlines(scope), centre_row(scope, code), _int(half))


def fit(head: Column, scope: Column, code: Column, max_tokens: int | Column) -> Column:
    """``head``, then the scope, cut around the code to fit the budget; dots alone if no window does.

    The widest window that fits isn't always found, as its length isn't monotone (dots come and go): the search is the
    reference rule, halving from the number of lines, and of it the last width that fitted. Only lengths are compared
    on the way; the text is made once.
    """
    begin = F.concat(head, F.lit("\n\nenclosing_scope:\n"))
    budget = _int(max_tokens)
    fits = lambda length: F.floor((F.length(begin) + length) / 4) <= budget
    # A struct of what the search needs, so that lines are split once.
    made = F.array(F.struct(T.py_splitlines(scope).alias("lines"), centre_row(scope, code).cast("long").alias("centre")))

    def search(x: Column) -> Column:
        n = F.size(x["lines"])

        def step(s: Column, _: Column) -> Column:
            half = F.floor((s["lo"] + s["hi"]) / 2)
            ok = fits(F.length(window_text(x["lines"], x["centre"], half)))
            state = lambda lo, hi, best: F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), best.cast("long").alias("best"))
            return F.when(s["lo"] > s["hi"], s).when(ok, state(half + 1, s["hi"], half)).otherwise(state(s["lo"], half - 1, s["best"]))

        start = F.struct(F.lit(0).cast("long").alias("lo"), n.cast("long").alias("hi"), F.lit(-1).cast("long").alias("best"))
        rounds = F.sequence(F.lit(1), F.length(F.bin(n)) + 1)  # halvings of n + 1 widths
        best = F.aggregate(rounds, start, step)["best"]
        return F.transform(F.array(best), lambda b: F.when(b < 0, "...").otherwise(window_text(x["lines"], x["centre"], b)))

    cut = F.element_at(F.flatten(F.transform(made, search)), 1)
    return F.concat(begin, F.when(fits(F.length(scope)), scope).otherwise(cut))


def _word(flag: Column) -> Column:
    return F.when(flag, "True").when(~flag, "False").otherwise("None")


#: What the state's first lines show, and the evidence below them in its order.
STATE = ("language", "comment_kind", "placement", "comment", "annotated_code", "symbol_name", "public", "is_test", "annotated_code_before", "enclosing_scope")
STATE_EVIDENCE = ("authored_by_agent", "agent", "comment_age_days", "code_newer_than_comment", "comment_new", "comment_modified", "scope_changed")
_FLAGS = ("authored_by_agent", "code_newer_than_comment", "comment_new", "comment_modified", "scope_changed")


def state_text(max_tokens: int | Column, row=F.col) -> Column:
    """The state of an item from columns named by STATE and STATE_EVIDENCE; null evidence isn't shown."""
    text = lambda c: F.coalesce(row(c).cast("string"), F.lit("None"))
    shown = [F.concat(F.lit(f"{c}: "), _word(row(c)) if c in _FLAGS else row(c).cast("string")) for c in STATE_EVIDENCE]
    evidence = F.concat_ws("\n", *[F.when(row(c).isNotNull(), s) for c, s in zip(STATE_EVIDENCE, shown)])
    parts = [
        F.concat(F.lit("language: "), text("language"), F.lit("  comment_kind: "), text("comment_kind"), F.lit("  placement: "), text("placement")),
        F.concat(F.lit("comment:\n"), row("comment")), F.concat(F.lit("annotated_code:\n"), row("annotated_code")),
        F.concat(F.lit("symbol: "), text("symbol_name"), F.lit("  public: "), _word(row("public")), F.lit("  is_test: "), _word(row("is_test"))),
        F.when(evidence != "", F.concat(F.lit("evidence:\n"), evidence)), F.concat(F.lit("annotated_code_before:\n"), row("annotated_code_before")),
    ]
    return fit(F.concat_ws("\n\n", *parts), row("enclosing_scope"), row("annotated_code"), max_tokens)


def verify_text(original: Column, candidate: Column, code: Column, scope: Column, max_tokens: int | Column) -> Column:
    head = F.concat_ws("\n\n", F.concat(F.lit("original:\n"), original), F.concat(F.lit("candidate:\n"), candidate), F.concat(F.lit("annotated_code:\n"), code))
    return fit(head, scope, code, max_tokens)
