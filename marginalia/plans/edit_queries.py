"""Queries of edit application: documents are the files, arithmetic on their lines gives the edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits as ED
from .queries import query, t


@query("""WITH src AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
  kept AS (SELECT doc_id, len(l) AS n, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: z[2] % 5 <> 2 OR z[2] = len(l)),
    lambda z: CASE WHEN z[2] % 5 = 3 THEN 'é' || (z[2] % 5) ELSE z[1] END), chr(10)) AS after FROM src)
  SELECT doc_id, md5(CASE WHEN doc_id % 50 <> 0 THEN after END) AS after_md5,
    CASE WHEN doc_id % 50 = 0 THEN 0 ELSE len(list_filter(range(1, n + 1), lambda i: (i % 5 = 2 AND i < n) OR i % 5 = 3)) END AS n_applied, CASE WHEN doc_id % 50 = 0 THEN 'reversed' ELSE '' END AS faults FROM kept""")
def edited_documents(spark, sf):
    """Every second of five lines deleted with the one behind it, which is replaced as well: the ranges overlap."""
    docs = t(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.col("text").alias("source"))
    lines = docs.select("path", F.size(F.split("source", "\n", -1)).alias("n"), F.posexplode(F.split("source", "\n", -1)).alias("i", "line"), F.col("source"))
    begin = F.octet_length(F.array_join(F.slice(F.split("source", "\n", -1), F.lit(1), F.col("i")), "\n")) + F.when(F.col("i") > 0, 1).otherwise(0)
    sized = lines.select("path", "n", (F.col("i") + 1).alias("no"), begin.alias("start"), F.octet_length("line").alias("size"), F.octet_length(F.coalesce(F.get(F.split("source", "\n", -1), F.col("i") + 1), F.lit(""))).alias("next"))
    last, no = F.col("no") == F.col("n"), F.col("no")
    end = F.col("start") + F.col("size") + 1
    cut = sized.where((no % 5 == 2) & ~last).select("path", no.alias("seq"), "start", (end + F.col("next")).alias("end"), F.lit("").alias("replacement"))
    put = sized.where(no % 5 == 3).select("path", no.alias("seq"), "start", (F.col("start") + F.col("size")).alias("end"), F.concat(F.lit("é"), (no % 5).cast("string")).alias("replacement"))
    bad = docs.where("path % 50 = 0").select("path", F.lit(0).alias("seq"), F.lit(5).alias("start"), F.lit(3).alias("end"), F.lit("x").alias("replacement"))
    done = ED.apply_edits(docs, cut.unionByName(put).unionByName(bad))
    faults = F.array_join(F.transform("set_aside", lambda x: x["reason"]), ",")
    return done.select(F.col("path").alias("doc_id"), F.md5(F.encode("after", "utf-8")).alias("after_md5"), "n_applied", faults.alias("faults"))
