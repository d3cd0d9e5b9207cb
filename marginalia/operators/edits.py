"""Applying byte-range edits to texts, and the ranges that delete whole lines.

Edits of a file are laid in descending order of their starts; each one's end is clamped to the start before it, so
bytes that two edits claim go once. For valid ranges the clamped starts are the starts themselves, and the text is
the pieces that stand between the edits: one pass over its bytes. Offsets are in bytes of UTF-8 and count from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons for setting an edit aside, the first that holds.
REASONS = ("missing", "reversed", "outside", "inside_character")


def _inside_character(data: Column, at: Column) -> Column:
    """Whether the byte at an offset continues a character."""
    return F.hex(F.substring(data, at + 1, F.lit(1))).rlike("^[89AB]")


def edit_fault(data: Column, edit: Column) -> Column:
    """Why an edit can't be applied, or null."""
    start, end = edit["start"], edit["end"]
    return (
        F.when(start.isNull() | end.isNull() | edit["replacement"].isNull(), REASONS[0])
        .when((start > end) | (start < 0), REASONS[1])
        .when(end > F.length(data), REASONS[2])
        .when(_inside_character(data, start) | _inside_character(data, end), REASONS[3])
    )


def applied(data: Column, edits: Column) -> Column:
    """The text after valid ``edits`` (array<struct<start, end, replacement>>, in order of application); binary in and out.

    Of edits with equal starts the later one's replacement stands before the earlier one's.
    """
    # Ascending by start, the later of equal ones first: the reverse of the order of application.
    placed = F.transform(edits, lambda e, i: F.struct(e["start"].cast("long").alias("start"), (-i).alias("turn"), e["end"].cast("long").alias("end"), F.encode(e["replacement"], "utf-8").alias("text")))
    ordered = F.array_sort(placed)
    box = F.array(F.struct(data.alias("data"), ordered.alias("edits"), F.length(data).cast("long").alias("n")))

    def fold(x: Column) -> Column:
        n = F.size(x["edits"])
        stop = lambda i: F.when(i + 1 < n, F.get(x["edits"], i + 1)["start"]).otherwise(x["n"])

        def piece(e: Column, i: Column) -> Column:
            end = F.least(e["end"], stop(i))
            return F.concat(e["text"], F.substring(x["data"], (end + 1).cast("int"), (stop(i) - end).cast("int")))

        lead = F.substring(x["data"], F.lit(1), F.coalesce(F.get(x["edits"], F.lit(0))["start"], x["n"]).cast("int"))
        # Hexadecimal digits join as text; bytes as such can't be joined from an array.
        return F.unhex(F.concat(F.hex(lead), F.array_join(F.transform(x["edits"], lambda e, i: F.hex(piece(e, i))), "")))

    return F.element_at(F.transform(box, fold), 1)


def apply_edits(files: DataFrame, edits: DataFrame, strict: bool = True) -> DataFrame:
    """(path, after, n_applied, set_aside) of every file.

    ``files(path, source)``, ``edits(path, seq, start, end, replacement)``; ``seq`` is the order of edits that begin
    together. Edits that can't be applied are set aside with a reason. ``strict``: a file with such an edit isn't
    changed at all, and ``after`` is null. A null source takes no edits. Edits of unknown files are ignored.
    """
    per = edits.groupBy("path").agg(F.collect_list(F.struct("start", "seq", "end", "replacement")).alias("raw"))
    data = F.encode("source", "utf-8")
    rows = files.join(per, "path", "left").withColumn("raw", F.array_sort(F.coalesce("raw", F.array().cast(per.schema["raw"].dataType))))
    judged = rows.withColumn("judged", F.transform("raw", lambda e: F.struct(e.alias("e"), edit_fault(data, e).alias("reason"))))
    good = F.transform(F.filter("judged", lambda j: j["reason"].isNull()), lambda j: j["e"])
    bad = F.transform(F.filter("judged", lambda j: j["reason"].isNotNull()), lambda j: F.struct(j["e"]["start"].alias("start"), j["e"]["end"].alias("end"), j["reason"].alias("reason")))
    out = judged.select("path", data.alias("data"), good.alias("good"), bad.alias("set_aside"))
    refused = (F.size("set_aside") > 0) if strict else F.lit(False)
    after = F.when(~refused, F.decode(applied(F.col("data"), F.col("good")), "utf-8"))
    return out.select("path", after.alias("after"), F.when(refused | F.col("data").isNull(), 0).otherwise(F.size("good")).alias("n_applied"), "set_aside")


def line_deletion(source: Column, start: Column, end: Column, indent: Column) -> Column:
    """struct<start, end>: the range that deletes an item which has its lines to itself.

    ``start`` and ``end`` are the item's bytes, ``indent`` those before it on its line. The lines go with their ends.
    At the end of a text without a last line end the one before the item goes; elsewhere a blank line behind goes if
    the line before is blank too or there is none.
    """
    data = F.encode(source, "utf-8")
    part = lambda a, b: F.decode(F.substring(data, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")), "utf-8")
    n, newline = F.length(data), F.lit("\n")
    first, last = start - indent, F.greatest(end - 1, start)
    # Offsets are on character borders but for ``last``, behind which only line ends are looked for.
    rest = part(end, n)
    closed = F.when(F.substring(data, (last + 1).cast("int"), F.lit(1)) == F.encode(newline, "utf-8"), last + 1).when(F.contains(rest, newline), end + F.octet_length(F.substring_index(rest, "\n", 1)) + 1)
    before = part(F.lit(0), first)
    ended = F.regexp_extract(before, r"\r?\n\z", 0)
    open_ = F.struct(F.when(first > 0, first - F.octet_length(ended)).otherwise(first).cast("long").alias("start"), n.cast("long").alias("end"))
    above = F.substring_index(F.regexp_replace(before, r"\n\z", ""), "\n", -1)
    blank_above = (first == 0) | above.rlike(r"(?U)\A\s*\z")
    behind = part(closed, n)
    line = F.when(F.contains(behind, newline), F.concat(F.substring_index(behind, "\n", 1), newline)).otherwise(behind)
    blank_behind = (line != "") & line.rlike(r"(?U)\A\s*\z")
    stop = F.when(blank_above & blank_behind, closed + F.octet_length(line)).otherwise(closed)
    return F.when(closed.isNull(), open_).otherwise(F.struct(first.cast("long").alias("start"), stop.cast("long").alias("end")))
