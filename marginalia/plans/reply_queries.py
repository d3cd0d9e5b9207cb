"""Queries of reply parsing: each document's text stands in a reply of one of several shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import replies as R
from .queries import query, t

# The reply's text: the document's language and id, and how many of its characters a reply can hold.
_SAID = "lang || ' ' || doc_id"


@query(f"""WITH r AS (SELECT doc_id, doc_id % 9 AS k, {_SAID} AS said FROM documents)
  SELECT doc_id, CASE WHEN k IN (0, 1, 8) THEN 'delete' WHEN k = 7 THEN NULL ELSE 'line' END AS verdict, CASE WHEN k BETWEEN 2 AND 6 THEN CASE WHEN k = 6 THEN '# ' || said ELSE said END END AS text,
    CASE WHEN k = 7 THEN 'reply too long: 9 words (limit 8)' END AS error FROM r""")
def one_line_replies(spark, sf):
    """Verdicts of one-line replies, fenced, quoted, announced, marked, too long or empty behind their code."""
    said = F.concat_ws(" ", "lang", F.col("doc_id").cast("string"))
    lit = F.lit
    shapes = (
        F.concat(lit("D2 "), said), lit("delete."), F.concat(lit("K1   "), said), F.concat(lit("```\nHere is the summary: "), said, lit("\n```\nmore")), F.concat(lit("\n '\""), said, lit("\"' ")),
        F.concat(lit("K0: "), F.replace(said, lit(" "), lit(" \t ")), lit(" */")), F.concat(lit("// # "), said), F.concat(said, F.repeat(lit(" x"), 7)), lit("K3"),
    )
    rows = t(spark, sf, "documents").select("doc_id", F.element_at(F.array(*shapes), (F.col("doc_id") % 9 + 1).cast("int")).alias("reply"))
    return rows.select("doc_id", R.one_line_verdict(F.col("reply"), 4).alias("v")).select("doc_id", "v.*")


@query("""WITH src AS (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents),
  r AS (SELECT doc_id, lang, list_filter(list_transform(l, lambda x: regexp_replace(x, '[^a-z ]', '', 'g')), lambda x: regexp_matches(x, '^[a-z]')) AS l, doc_id % 3 AS k FROM src),
  c AS (SELECT doc_id, k, list_transform(l, lambda x: rtrim(x))[:CASE WHEN k = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 4 END ELSE 14 END] AS l FROM r)
  SELECT doc_id, CASE WHEN k = 2 THEN 'delete' ELSE 'text' END AS verdict, CASE WHEN k < 2 THEN md5('summary' || CASE WHEN len(l) > 0 THEN chr(10) || array_to_string(l, chr(10)) ELSE '' END) END AS text_md5 FROM c""")
def docstring_replies(spark, sf):
    """Docstring replies whose lines are the documents', kept in the lines that their kind may have."""
    words = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "[^a-z ]", "")), lambda x: x.rlike("^[a-z]"))
    body = F.array_join(F.concat(F.array(F.lit("summary")), F.transform(words, lambda x: F.concat(x, F.lit("  ")))), "\n")
    d, k = F.col("doc_id"), F.col("doc_id") % 3
    reply = F.when(k == 0, F.concat(F.lit("Here is the docstring:\n```\nKEEP\n'''"), body, F.lit("'''\n```"))).when(k == 1, F.concat(F.lit("\n"), body, F.lit("\n\n"))).otherwise(F.concat(F.lit("Delete: \n"), body))
    v = R.doc_verdict(reply, F.when(d % 2 == 0, "function").otherwise("class"), k == 1)
    return t(spark, sf, "documents").where("text is not null").select("doc_id", v.alias("v")).select("doc_id", "v.verdict", F.md5(F.encode("v.text", "utf-8")).alias("text_md5"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 4 = 1 THEN 'last' ELSE lang END AS verdict, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 END::INTEGER AS n_questions FROM documents""")
def label_replies(spark, sf):
    """Label objects behind reasoning, in prose, nested or broken."""
    d = F.concat(F.col("doc_id").cast("string"), F.lit(" } {"))
    shapes = (
        F.concat(F.lit('<think>{"verdict": "no"}</think> {"verdict": "'), "lang", F.lit('", "note": "'), d, F.lit('"} done')),
        F.concat(F.lit('{ see {"verdict": "first", "c2": 1} or '), d, F.lit(' {"labels": {"verdict": "last", "rewrite": "x"}}')),
        F.concat(F.lit('{"labels": {"verdict": "'), "lang", F.lit('", "hazard": true, "c3": 2, "leak": null}}')),
        F.concat(F.lit('{"verdict": "'), "lang", F.lit('"')),
    )
    reply = F.element_at(F.array(*shapes), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = t(spark, sf, "documents").select("doc_id", R.one_hot(R.parse_labels(reply)).alias("h"))
    return rows.select("doc_id", F.element_at(F.map_keys(F.try_element_at("h", F.lit("verdict"))), 1).alias("verdict"), F.when(F.col("h").isNotNull(), F.size("h")).alias("n_questions"))
