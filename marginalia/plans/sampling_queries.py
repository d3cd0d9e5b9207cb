"""Queries of sampling in turns, agents of ranges, docstring text and incremental runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sampling as SA
from ..session import shared_path
from ..streaming import runs as RU
from .queries import query, t

GROUPS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CYCLE = ["BUILDING", "MACHINERY", "BUILDING", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"]


def pulls(spark, sf):
    repos = t(spark, sf, "customer").select(F.col("c_custkey").alias("repo"), F.col("c_mktsegment").alias("language"))
    rows = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("repo"))
    return rows.join(repos, "repo").select("id", "grp", "language", "repo")


@query()
def sampled_in_turns(spark, sf):
    """Thirty orders as pull requests, customers as repositories: priorities take turns, segments cycle."""
    return SA.round_robin(pulls(spark, sf), GROUPS, CYCLE, 30)


@query("""WITH c AS (SELECT user_id AS range, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS position, CASE WHEN event_type <> 'view' THEN event_type END AS agent FROM events),
  f AS (SELECT range, agent, min(position) AS first FROM c WHERE position <= 20 GROUP BY ALL)
  SELECT range, array_to_string(list_filter(list(agent ORDER BY first), lambda x: x IS NOT NULL), ',') AS agents FROM f GROUP BY range""")
def range_agents(spark, sf):
    """Kinds of events of a user's latest twenty, in order of first sight; views stand for people."""
    order = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), "event_id")
    agent = F.when(F.col("event_type") != "view", F.col("event_type"))
    commits = t(spark, sf, "events").select(F.col("user_id").alias("range"), F.row_number().over(order).alias("position"), agent.alias("agent"))
    return SA.agents_in_range(commits, 20).select("range", F.array_join("agents", ",").alias("agents"))


@query("""WITH src AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
  kept AS (SELECT doc_id, list_transform(l, lambda x, i: CASE WHEN i = 1 THEN regexp_replace(x, '^\\s+', '') WHEN i % 2 = 0 THEN x ELSE '        ' || x END) AS l FROM src)
  SELECT doc_id, md5(regexp_replace(array_to_string(l, chr(10)), '^\\n+|\\n+$', '', 'g')) AS text_md5 FROM kept""")
def cleaned_docstrings(spark, sf):
    """Documents indented by four spaces and by tabs, as docstrings: the common margin goes."""
    body = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i == 0, F.concat(F.lit("  \t"), x)).when(i % 2 == 1, F.concat(F.lit("    "), F.lit("\t"), x)).otherwise(F.concat(F.lit(" \t    \t"), x)))
    return t(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(F.encode(T.clean_doc(F.array_join(body, "\n")), "utf-8")).alias("text_md5"))


@query("""SELECT ['inline', 'api_doc', 'todo'][doc_id % 3 + 1] AS kind, count(*) AS n FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0 GROUP BY 1""")
def redone_items(spark, sf):
    """What a run redoes after one setting has changed: the kind that it concerns, and every fifth item, which failed."""
    d = F.col("doc_id")
    items = t(spark, sf, "documents").select("doc_id", F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("source_hash"), F.element_at(F.array(*[F.lit(k) for k in ("inline", "api_doc", "todo")]), (d % 3 + 1).cast("int")).alias("kind"))
    concerns = {"*": ["model"], "inline": ["hazard"], "api_doc": ["c5_min"]}
    key = lambda settings: RU.keyed(items, settings, concerns, ["doc_id", "source_hash"])
    done = key({"model": "m", "hazard": 0.3, "c5_min": 0.5})
    folder = shared_path(spark, "ledger")
    RU.append(done.select("key", F.when(d % 5 == 0, "error").otherwise("ready").alias("state"), F.lit("keep").alias("verdict"), F.lit(1).cast("long").alias("updated_at")), folder, 0)
    return RU.pending(key({"model": "m", "hazard": 0.4, "c5_min": 0.5}), folder).groupBy("kind").agg(F.count("*").alias("n"))
