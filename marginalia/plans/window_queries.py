"""Queries of context windows: a document's lines are the source, a line of it the item."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import windows as W
from .queries import query, t

_ITEM = """src AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
item AS (SELECT *, len(l) AS n, doc_id % len(l) AS s, least(doc_id % len(l) + doc_id % 3, len(l) - 1) AS e FROM src)"""


def _source(spark, sf):
    d, n = F.col("doc_id"), F.size("l")
    rows = t(spark, sf, "documents").where("text is not null").select("doc_id", "text", F.split("text", "\n", -1).alias("l"))
    first = (d % n).cast("int")
    return rows.select("*", n.alias("n"), first.alias("s"), F.least(first + (d % 3).cast("int"), n - 1).alias("e"))


_BOUNDS = f"""{_ITEM}, wide AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN s - least(s, doc_id % 90) END AS f, CASE WHEN doc_id % 2 = 0 THEN least(e + doc_id % 70, n - 1) END AS z, s AS alo, least(e + doc_id % 60, n) AS ahi FROM item),
b0 AS (SELECT *, least(coalesce(f, greatest(s - 40, 0)), alo) AS lo0, greatest(coalesce(z + 1, least(e + 41, n)), ahi) AS hi0 FROM wide),
b1 AS (SELECT *, greatest(lo0, least(greatest(s - 39, 0), alo)) AS lo1 FROM b0),
bounds AS (SELECT *, CASE WHEN hi0 - lo0 <= 80 THEN lo0 WHEN ahi > least(hi0, lo1 + 80) THEN greatest(ahi - 80, 0) ELSE lo1 END AS lo, CASE WHEN hi0 - lo0 <= 80 THEN hi0 WHEN ahi > least(hi0, lo1 + 80) THEN ahi ELSE least(hi0, lo1 + 80) END AS hi FROM b1)"""


@query(f"""WITH {_BOUNDS}, kept AS (SELECT doc_id, lo, hi, list_filter(list_transform(range(lo, least(hi, n)), lambda i: CASE WHEN i < s OR i > e THEN l[i + 1] WHEN i = s AND s < e THEN nullif(l[i + 1][1:3], '') ELSE NULL END), lambda x: x IS NOT NULL) AS rows FROM bounds)
  SELECT doc_id, lo, hi, md5(array_to_string(rows, chr(10))) AS window_md5 FROM kept WHERE doc_id IN (SELECT doc_id FROM bounds)""")
def scope_rows(spark, sf):
    """Bounds of each item's scope, and its rows without the item (which begins at the fourth character)."""
    d, n, s, e = (F.col(c) for c in ("doc_id", "n", "s", "e"))
    scoped = d % 2 == 0
    rows = _source(spark, sf).select(
        "*", F.when(scoped, s - F.least(s, d % 90)).alias("f"), F.when(scoped, F.least(e + d % 70, n - 1)).alias("z"), F.least(e + d % 60, n.cast("long")).alias("ahi")
    )
    rows = rows.withColumn("b", W.scope_bounds(n, s, e, F.col("f"), F.col("z"), s, F.col("ahi")))
    head = F.substring(F.get("l", s), 1, 3)  # a cut behind three characters, or the whole line for items of one row
    start = F.when(s < e, F.octet_length(head)).otherwise(0)
    text = W.rows_without(F.col("l"), F.col("b.lo").cast("int"), F.col("b.hi").cast("int"), s, start, e, F.octet_length(F.get("l", e)))
    return rows.select("doc_id", "b.lo", "b.hi", F.md5(F.encode(text, "utf-8")).alias("window_md5"))


@query(f"""WITH {_ITEM}, z AS (SELECT *, CASE WHEN doc_id % 3 > 0 THEN 0 END AS f, CASE WHEN doc_id % 3 > 0 THEN n - 1 - doc_id % 2 * least(1, n - 1 - e) END AS last0 FROM item),
  r AS (SELECT *, f IS NULL OR coalesce(last0, n - 1) > 80 AS large FROM z),
  b AS (SELECT *, CASE WHEN large THEN greatest(s - 40, 0) ELSE 0 END AS lo, CASE WHEN large THEN least(e + 40, coalesce(last0, n - 1)) ELSE last0 END AS hi FROM r),
  p AS (SELECT *, array_to_string(l[lo + 1:s], chr(10)) || CASE WHEN s > lo THEN chr(10) ELSE '' END AS before, CASE WHEN hi > e THEN chr(10) || array_to_string(l[e + 2:hi + 1], chr(10)) ELSE '' END || CASE WHEN hi + 1 < n THEN chr(10) ELSE '' END AS behind FROM b)
  SELECT doc_id, md5(regexp_replace(CASE WHEN lo > 0 AND f IS NOT NULL THEN 'def x():' || chr(10) ELSE '' END || before || behind, '^\\s+|\\s+$', '', 'g')) AS context_md5 FROM p""")
def classifier_contexts(spark, sf):
    """The context of a run of whole lines, scopes of over 80 rows cut."""
    d, n, s, e = (F.col(c) for c in ("doc_id", "n", "s", "e"))
    before = F.array_join(F.slice("l", F.lit(1), s), "\n")
    start = F.octet_length(before) + F.when(s > 0, 1).otherwise(0)
    end = F.octet_length(F.array_join(F.slice("l", F.lit(1), e + 1), "\n"))
    first = F.when(d % 3 > 0, 0)
    last = F.when(d % 3 > 0, n - 1 - (d % 2).cast("int") * F.least(F.lit(1), n - 1 - e))
    text = W.classifier_context(F.col("text"), start, end, s, e, first, last, F.lit("def x():  "))
    return _source(spark, sf).select("doc_id", F.md5(F.encode(text, "utf-8")).alias("context_md5"))


_BUDGET = 120
_SHOWN = "array_to_string(list_concat(CASE WHEN greatest(c - {h}, 0) > 0 THEN ['...'] ELSE [] END, list_concat(l[greatest(c - {h}, 0) + 1:least(n, c + {h} + 1)], CASE WHEN least(n, c + {h} + 1) < n THEN ['...'] ELSE [] END)), chr(10))"
_H = "((lo + hi) // 2)"


@query(f"""WITH RECURSIVE src AS (SELECT doc_id, text, CASE WHEN text LIKE '%' || chr(10) THEN l[:-2] ELSE l END AS l, 'comment:' || chr(10) || lang || chr(10) || chr(10) || 'enclosing_scope:' || chr(10) AS head
    FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)),
  item AS (SELECT *, len(l) AS n, doc_id % greatest(len(l), 1) AS s FROM src),
  found AS (SELECT *, trim(l[s + 1], ' ' || chr(9)) AS first FROM item),
  placed AS (SELECT *, CASE WHEN first <> '' THEN list_position(list_transform(l, lambda x: contains(x, first)), true) - 1 ELSE n // 2 END + CASE WHEN l[s + 1] <> '' THEN 1 ELSE 0 END // 2 AS c FROM found),
  search AS (SELECT doc_id, 0::BIGINT AS lo, n::BIGINT AS hi, -1::BIGINT AS best FROM placed
    UNION ALL SELECT doc_id, CASE WHEN ok THEN h + 1 ELSE lo END, CASE WHEN ok THEN hi ELSE h - 1 END, CASE WHEN ok THEN h ELSE best END
      FROM (SELECT doc_id, lo, hi, best, {_H} AS h, (length(head) + length({_SHOWN.format(h=_H)})) // 4 <= {_BUDGET} AS ok FROM search JOIN placed USING (doc_id) WHERE lo <= hi)),
  ended AS (SELECT doc_id, best FROM search WHERE lo > hi)
  SELECT doc_id, (length(head) + length(text)) // 4 <= {_BUDGET} AS whole,
    md5(head || CASE WHEN (length(head) + length(text)) // 4 <= {_BUDGET} THEN text WHEN best < 0 THEN '...' ELSE {_SHOWN.format(h="best")} END) AS state_md5 FROM ended JOIN placed USING (doc_id)""")
def budget_windows(spark, sf):
    """Documents cut around one of their lines to 120 tokens."""
    rows = t(spark, sf, "documents").where("text is not null").withColumn("l", T.py_splitlines(F.col("text")))
    code = F.coalesce(F.get("l", (F.col("doc_id") % F.greatest(F.size("l"), F.lit(1))).cast("int")), F.lit(""))
    shown = W.fit(F.concat(F.lit("comment:\n"), "lang"), F.col("text"), F.col("code"), _BUDGET)
    made = rows.withColumn("code", code).select("doc_id", "text", "lang", shown.alias("state"))
    whole = F.floor((F.length(F.concat(F.lit("comment:\n"), "lang", F.lit("\n\nenclosing_scope:\n"))) + F.length("text")) / 4) <= _BUDGET
    return made.select("doc_id", F.md5(F.encode("state", "utf-8")).alias("state_md5"), whole.alias("whole"))
