"""Line dedup with a log-template tree, in DataFrame operations only.

Fixed-depth parsing: a line's leaf is its number of tokens and its leading tokens, tokens with a digit
counting as variable. Within a leaf, tokens that recur at a position are constant and all others generalise
to a variable; constants and variables in order are the line's template. How often a token must recur is
asked at several levels, in texts and in shares of the leaf, so a line has a template of its own and more
general ones; that keeps fields with few or many values variable, however large the leaf. Lines of templates
that recur over ``min_docs`` distinct texts are dropped. Copies of a text count as one, so copies alone make
nothing recur.

Only hashes and positions are shuffled until the last join; line texts move once for each distinct line of
a recurring leaf. Hot lines, leaves and templates meet partially aggregated or in joins that adaptive
execution splits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

VARIABLE = "<*>"


@dataclass(frozen=True)
class TemplateParams:
    leading_tokens: int = 3
    #: Distinct texts over which a template must recur, and a token of a position at the least.
    min_docs: int = 10
    #: Shares of a leaf's lines, in hundredths, that have a constant token: one level of templates for each.
    constant_pcts: tuple[int, ...] = (0, 10, 50)
    #: Least share of constant tokens in a template, in hundredths.
    min_constant_pct: int = 50
    #: Documents with more than this share of tokens in recurring lines, in hundredths, are variants of each
    #: other rather than carriers of boilerplate. They are left whole, with the lines counted in n_spared.
    copy_pct: int = 90


def lines_of(docs: DataFrame, text_col: str, p: TemplateParams) -> DataFrame:
    """(tid, size, pos, n_tok, leaf, line_id, line): each line that isn't empty; the first two name its text."""
    rows = docs.where(F.col(text_col).isNotNull())
    rows = rows.select(*_text_key(text_col), F.posexplode(F.split(text_col, "\n")).alias("pos", "raw")).where("raw <> ''")
    n_tok = F.length("raw") - F.length(F.replace("raw", F.lit(" "))) + 1
    # The leading tokens are masked by themselves, so counting leaves never touches the rest of a line.
    lead = _masked(F.substring_index("raw", " ", p.leading_tokens))
    rows = rows.withColumn("n_tok", n_tok).select("tid", "size", "pos", "n_tok", F.xxhash64("n_tok", lead).alias("leaf"), _masked(F.col("raw")).alias("line"))
    return rows.select("tid", "size", "pos", "n_tok", "leaf", F.xxhash64("leaf", "line").alias("line_id"), "line")


def _text_key(text_col: str):
    return F.xxhash64(text_col).alias("tid"), F.length(text_col).alias("size")


def _masked(text):
    """Tokens with a digit as VARIABLE; most lines have none and skip the slow replacement."""
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, "[^ ]*[0-9][^ ]*", VARIABLE)).otherwise(text)


def recurring_lines(docs: DataFrame, text_col: str = "text", p: TemplateParams = TemplateParams()) -> DataFrame:
    """(tid, size, pos, n_tok) of the lines whose template recurs over ``min_docs`` distinct texts."""
    lines = lines_of(docs, text_col, p)
    # Lines are at least as many as texts; this only spares work, texts are counted exactly below.
    wide = lines.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= p.min_docs).select("leaf")
    wide = saved(wide, "recurring-leaves")  # a table of its own: small ones are broadcast, skewed joins are split
    held = saved(lines.join(wide, "leaf"), "template-lines")

    # Texts for each distinct line, then lines for each token at a position of its leaf.
    text = F.struct("tid", "size")
    distinct = held.groupBy("leaf", "line_id").agg(F.count_distinct(text).alias("docs"), F.first("line").alias("line"))
    distinct = saved(distinct, "distinct-lines")
    tokens = distinct.select("leaf", "line_id", "docs", F.posexplode(F.split("line", " ")).alias("at", "token"))
    tokens = tokens.withColumn("token_id", F.xxhash64("at", "token"))
    often = tokens.where(F.col("token") != VARIABLE).groupBy("leaf", "token_id").agg(F.sum("docs").alias("n"))
    totals = distinct.groupBy("leaf").agg(F.sum("docs").alias("total"))
    share = often.where(F.col("n") >= p.min_docs).join(totals, "leaf").select("leaf", "token_id", (F.col("n") * 100 / F.col("total")).alias("pct"))
    marked = tokens.select("leaf", "line_id", "token_id").join(share, ["leaf", "token_id"], "left")
    levels = [F.col("pct") >= pct for pct in p.constant_pcts]
    template = marked.groupBy("leaf", "line_id").agg(
        F.count("*").alias("n"),
        # Positions are part of token_id, so the exclusive or of hashes names the set of constants.
        *[F.struct(F.count_if(c).alias("n"), F.bit_xor(F.when(c, F.xxhash64("token_id"))).alias("set")).alias(f"c{i}") for i, c in enumerate(levels)],
    )
    ids = [F.when(F.col(f"c{i}.n") * 100 >= F.col("n") * p.min_constant_pct, F.xxhash64("leaf", f"c{i}.n", f"c{i}.set")) for i in range(len(levels))]
    named = template.select("line_id", F.explode(F.array_distinct(F.array_compact(F.array(*ids)))).alias("template"))
    named = saved(named, "line-templates")

    recurring = held.select("line_id", "tid", "size").join(named, "line_id").groupBy("template").agg(F.count_distinct(text).alias("docs"))
    recurring = named.join(recurring.where(F.col("docs") >= p.min_docs), "template").select("line_id").distinct()
    return held.select("tid", "size", "pos", "n_tok", "line_id").join(saved(recurring, "recurring-lines"), "line_id").drop("line_id")


def drop_recurring_lines(
    docs: DataFrame, text_col: str = "text", p: TemplateParams = TemplateParams()
) -> DataFrame:
    """All rows and columns of ``docs``, recurring lines removed from the text, plus n_lines, n_dropped, n_spared.

    Null texts stay null with 0 lines; an empty text is one empty line, and empty lines always stay. Rows are
    judged by their text alone, so null and repeated ids make no difference and copies get equal texts.
    ``n_spared`` counts the recurring lines of a text that is left whole as a variant of others (``copy_pct``).
    Columns of these three names are replaced.
    """
    found = recurring_lines(docs, text_col, p).groupBy("tid", "size").agg(F.collect_set(F.struct("pos", "n_tok")).alias("__found"))
    # Written first, so that the join below is one of two exchanges, of which a skewed side can be split.
    found = saved(found.select(F.col("tid").alias("__tid"), F.col("size").alias("__size"), "__found"), "lines-to-drop")
    tid, size = _text_key(text_col)
    joined = docs.join(found, (tid == F.col("__tid")) & (size == F.col("__size")) & F.col(text_col).isNotNull(), "left")
    lines = F.split(text_col, "\n")
    bare = F.replace(F.replace(F.col(text_col), F.lit(" ")), F.lit("\n"))
    tokens = F.length(text_col) - F.length(bare) + 1
    gone = F.aggregate("__found", F.lit(0), lambda n, x: n + x["n_tok"])
    hit, cut = F.col("__found").isNotNull(), gone * 100 <= tokens * p.copy_pct
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__found")["pos"])
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n")
    n_found = F.size("__found").cast("long")
    out = joined.withColumn("__lines", lines).withColumn("__cut", F.coalesce(hit & cut, F.lit(False)))
    return out.select(
        *[c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped", "n_spared")],
        F.when(F.col("__cut"), kept).otherwise(F.col(text_col)).alias(text_col),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
        F.when(F.col("__cut"), n_found).otherwise(0).alias("n_dropped"),
        F.when(hit & ~F.col("__cut"), n_found).otherwise(0).alias("n_spared"),
    )
