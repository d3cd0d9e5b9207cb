"""Queries of reports and rewrites: summary lines, scores of replies, verdicts outright, rewrite faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy as P
from ..operators import findings as FI
from ..operators import metrics as M
from .queries import _answers, query, t

_COUNTS = "doc_id % 2 AS deleted, doc_id % 7 AS lines_deleted, doc_id % 3 AS reduced, doc_id % 11 AS lines_reduced, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS review, 0 AS rename, doc_id % 4 // 3 AS stale"


@query(f"""WITH c AS (SELECT doc_id, 'd/' || doc_id || '.py' AS path, {_COUNTS} FROM documents), p AS (SELECT *, list_filter([CASE WHEN deleted > 0 THEN deleted || ' deleted (' || lines_deleted || ' lines)' END,
    CASE WHEN reduced > 0 THEN reduced || ' reduced (' || lines_reduced || ' lines saved)' END, CASE WHEN review > 0 THEN review || ' to review' END, CASE WHEN stale > 0 THEN stale || ' stale' END], lambda x: x IS NOT NULL) AS parts FROM c)
  SELECT path, CASE WHEN len(parts) > 0 THEN path || ': ' || array_to_string(parts, ', ') END AS line FROM p""")
def summary_lines(spark, sf):
    """A summary line of each document as a file."""
    d = F.col("doc_id")
    rows = t(spark, sf, "documents").select(
        F.concat(F.lit("d/"), d.cast("string"), F.lit(".py")).alias("path"), (d % 2).alias("deleted"), (d % 7).alias("lines_deleted"), (d % 3).alias("reduced"), (d % 11).alias("lines_reduced"),
        F.when(d % 5 == 0, 1).otherwise(0).alias("review"), F.lit(0).alias("rename"), F.floor(d % 4 / 3).alias("stale"),
    )
    return rows.select("path", FI.summary_line().alias("line"))


@query("""WITH r AS (SELECT doc_id % 3 = 0 AS gold, doc_id % 4 = 0 AS got, text FROM documents JOIN labels USING (doc_id) WHERE doc_id % 9 > 0)
  SELECT count(*) AS n, round(count(*) FILTER (gold = got) / count(*), 6) AS accuracy, round(count(*) FILTER (gold AND got) / greatest(count(*) FILTER (got), 1), 6) AS precision, round(count(*) FILTER (gold AND got) / greatest(count(*) FILTER (gold), 1), 6) AS recall,
    round(sum(CASE WHEN NOT got THEN len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN 1 ELSE 0 END ELSE 0 END) / greatest(count(*) FILTER (NOT got), 1), 6) AS kept_lines,
    round(sum(CASE WHEN NOT got THEN len(regexp_extract_all(text, '[^\\s]+')) ELSE 0 END) / greatest(count(*) FILTER (NOT got), 1), 6) AS kept_words FROM r""")
def reply_scores(spark, sf):
    """Labelled documents as replies: accuracy of deletions, and what is kept; every ninth reply is an error."""
    d = F.col("doc_id")
    rows = t(spark, sf, "documents").join(t(spark, sf, "labels").select("doc_id"), "doc_id").select(
        F.when(d % 3 == 0, "DELETE").otherwise("KEEP").alias("expected"), F.when(d % 9 > 0, F.when(d % 4 == 0, "delete").otherwise("text")).alias("verdict"), "text"
    )
    return M.reply_scores(rows).withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "kept_lines", "kept_words")})


@query("""WITH r AS (SELECT doc_id, text, doc_id % 5 AS k, (doc_id * 17 % 100) / 100.0::DOUBLE AS p, (doc_id * 23 % 100) / 1000.0::DOUBLE AS a, (doc_id * 31 % 100) / 100.0::DOUBLE AS g FROM documents)
  SELECT CASE WHEN k = 0 THEN 'generator gave no text' WHEN doc_id % 7 = 0 THEN 'unsafe' WHEN k IN (1, 2) AND k = 2 THEN 'not shorter' WHEN NOT 0.9 + p / 10 > 0.95 THEN 'drops content' WHEN NOT a < 0.05 THEN 'adds content' WHEN NOT g < 0.3 THEN 'contradicts the code' END AS fault,
    count(*) AS n FROM r WHERE length(text) > 1 GROUP BY 1""")
def rewrite_faults(spark, sf):
    """Why rewrites of documents are rejected: empty, unsafe, longer, or not verified."""
    d, k = F.col("doc_id"), F.col("doc_id") % 5
    candidate = F.when(k == 0, "").when(k == 1, F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.concat("text", F.lit("!")))
    p = lambda m, by: (d * m % 100) / by
    fault = P.rewrite_fault(candidate, F.when(d % 7 == 0, "unsafe"), F.col("text"), k.isin(1, 2), 0.9 + p(17, 100.0) / 10, p(23, 1000.0), p(31, 100.0))
    return t(spark, sf, "documents").where(F.length("text") > 1).groupBy(fault.alias("fault")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'keep' WHEN doc_id % 6 = 0 THEN 'review' WHEN doc_id % 4 = 0 THEN CASE WHEN contains(text, chr(10)) THEN 'rewrite_shorter' ELSE 'keep' END ELSE 'delete' END AS verdict FROM documents WHERE doc_id % 3 < 2""")
def outright_verdicts(spark, sf):
    """Verdicts that a judge names outright, past the policy: some are none, some meet a unit literal."""
    d = F.col("doc_id")
    kind = F.when(d % 10 == 0, "todo").otherwise("inline")
    named = F.when(d % 6 == 0, "nonsense").otherwise("delete")
    made = P.judge_verdict(d % 3 == 0, named, kind, F.col("text"), F.create_map().cast("map<string,map<string,double>>"), F.when(d % 4 == 0, "unit"))
    return _answers(spark, sf).where(d % 3 < 2).select("doc_id", made["verdict"].alias("verdict"))


@query("""WITH r AS (SELECT doc_id, lang, ['added', 'modified', 'scope_changed', 'untouched'][doc_id % 4 + 1] AS tier, doc_id % 3 = 0 AS agent FROM documents),
  e AS (SELECT *, '"unresolved":["' || lang || '"]' AS u, '"overlap":' || CASE WHEN agent THEN '0.5' ELSE 'null' END AS o, '"agent":' || CASE WHEN agent THEN '"a\\"b"' ELSE 'null' END AS a,
    '"comment_age_days":' || doc_id AS c FROM r)
  SELECT doc_id, CASE WHEN tier = 'untouched' THEN '{"mentions":[{"token":"t","resolved":true}],' || u || ',"literal_mismatch":[],' || o || ',"signature_echo":false,"todo_tracker":null,' || c || ',"code_age_days":null,"code_newer_than_comment":null,"authored_by_agent":' || agent || ',' || a || ',"unit_literal":null}'
    ELSE '{' || a || ',"authored_by_agent":' || agent || ',"change":{"annotated_code_before":' || CASE WHEN tier = 'scope_changed' THEN '"x = 1"' ELSE 'null' END || ',"changed_mentions":' || CASE WHEN tier = 'scope_changed' THEN '["m"]' ELSE '[]' END
      || ',"comment_modified":' || (tier = 'modified') || ',"comment_new":' || (tier = 'added') || ',"scope_changed":' || (tier = 'scope_changed') || '},"code_age_days":null,"code_newer_than_comment":null,' || c
      || ',"literal_mismatch":[],"mentions":[{"resolved":true,"token":"t"}],' || o || ',"signature_echo":false,"todo_tracker":null,"unit_literal":null,' || u || '}' END AS evidence FROM e""")
def evidence_records(spark, sf):
    """Evidence of documents as items, with the change record of their tier."""
    from ..operators import records as RE

    d, agent = F.col("doc_id"), F.col("doc_id") % 3 == 0
    tier = F.element_at(F.array(*[F.lit(x) for x in ("added", "modified", "scope_changed", "untouched")]), (d % 4 + 1).cast("int"))
    null = F.lit(None)
    rows = t(spark, sf, "documents").select(
        "doc_id", tier.alias("tier"), F.array(F.struct(F.lit("t").alias("token"), F.lit(True).alias("resolved"))).alias("mentions"), F.array("lang").alias("unresolved"),
        F.array().cast("array<string>").alias("literal_mismatch"), F.when(agent, 0.5).alias("overlap"), F.lit(False).alias("signature_echo"), null.cast("boolean").alias("todo_tracker"),
        d.alias("comment_age_days"), null.cast("long").alias("code_age_days"), null.cast("boolean").alias("code_newer_than_comment"), agent.alias("authored_by_agent"), F.when(agent, 'a"b').alias("agent"), null.cast("string").alias("unit_literal"),
    )
    rows = rows.withColumn("change", RE.change_record(F.col("tier"), F.lit("x = 1"), F.array(F.lit("m"))))
    return rows.select("doc_id", RE.evidence_json(change=F.col("change")).alias("evidence"))
