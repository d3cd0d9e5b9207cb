"""Lines, line classes and blocks of consecutive lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line), line_no from 1; null texts have no lines."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("at", "line")).select(
        id_col, (F.col("at") + 1).alias("line_no"), "line"
    )


def line_class(line: Column) -> Column:
    """structural (a license notice), noisy (mostly code or symbols), short or prose."""
    return F.when(T.names_license(line), "structural").when(T.is_code_like(line), "noisy").when(F.length(line) < 40, "short").otherwise("prose")


def islands(rows: DataFrame, by: list[str], order: str, same: list[str]) -> DataFrame:
    """``rows`` with block_no: consecutive rows (order + 1) that agree on ``same`` are one block."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.lag(order).over(w).isNull() | (F.lag(order).over(w) + 1 != F.col(order))
    for c in same:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return rows.withColumn("__new", new.cast("int")).withColumn("block_no", F.sum("__new").over(w)).drop("__new")


def comment_blocks(tokens: DataFrame) -> DataFrame:
    """Blocks of ``tokens(path, start_line, end_line, kind, own_line, indent, doc, text)``: an own-line line
    comment joins the token before it if that is own-line, on the line above, with equal indent and doc flag."""
    w = Window.partitionBy("path").orderBy("start_line", "indent")
    before = lambda c: F.lag(c).over(w)
    joins = (
        (F.col("kind") == "line") & F.col("own_line") & before("own_line") & (before("end_line") + 1 == F.col("start_line"))
        & (before("indent") == F.col("indent")) & (before("doc") == F.col("doc"))
    )
    numbered = tokens.withColumn("__new", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("block_no", F.sum("__new").over(w))
    return numbered.groupBy("path", "block_no").agg(
        F.min("start_line").alias("start_line"),
        F.max("end_line").alias("end_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "text"))), lambda t: t["text"]), "\n").alias("text"),
        F.min("kind").alias("kind"),
    )


def document_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block_no, cls, first_line, last_line, n_lines) of lines of equal class.

    A document is one row, so its lines are classed and its blocks cut within it: nothing is shuffled or sorted.
    """
    classed = docs.where("text is not null").select("doc_id", F.transform(F.split("text", "\n"), line_class).alias("cls"))
    new = lambda i: (i == 0) | (F.get("cls", i) != F.get("cls", i - 1))
    cut = classed.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("cls") - 1), new))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("cls")))
    block = lambda at, i: F.struct(
        (i + 1).cast("long").alias("block_no"), F.get("cls", at).alias("cls"), (at + 1).alias("first_line"), F.get("ends", i).alias("last_line"),
        (F.get("ends", i) - at).cast("long").alias("n_lines"),
    )
    return cut.withColumn("ends", ends).select("doc_id", F.inline(F.transform("starts", block)))
