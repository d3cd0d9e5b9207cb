"""The query catalogue: every operator as a Spark job over the test tables, with its DuckDB equivalent.

The reference data of such an engine are source trees and judged comments. Where the tables hold none, a
query works on an analogue: a document stands for a file, its lines for tokens, `labels` for gold verdicts,
and arithmetic on ids for a judge's answers and for change hunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import policy as P
from ..functions import text as T
from ..operators import blocks as B
from ..operators import changes as C
from ..operators import curation as CU
from ..operators import evidence as E
from ..operators import findings as FI
from ..operators import metrics as M
from ..operators import structural as S
from ..operators import verify as V

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


LINES = """lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""
_STARTS = " OR ".join(f"starts_with(s, '{x}')" for x in T.CODE_STARTS)
CODE = f"""(CASE WHEN s = '' THEN false ELSE regexp_matches(s, '[;{{}}]$') OR {_STARTS} OR regexp_matches(s, '=>|->|\\);')
  OR regexp_matches(s, ' = .*\\(') OR length(regexp_replace(s, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) / length(s) > 0.35 END)"""
CLASSED = f"""{LINES}, classed AS (SELECT doc_id, line_no, line, CASE
  WHEN regexp_matches(line, '(?i)(^|[^A-Za-z0-9_])(license|copyright|SPDX)([^A-Za-z0-9_]|$)') THEN 'structural'
  WHEN {CODE} THEN 'noisy' WHEN length(line) < 40 THEN 'short' ELSE 'prose' END AS cls FROM (SELECT *, trim(line) AS s FROM lines))"""
BLOCKS = f"""{CLASSED}, marked AS (SELECT *, CASE WHEN cls IS DISTINCT FROM lag(cls) OVER w THEN 1 ELSE 0 END AS new FROM classed WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS block_no FROM marked),
blocks AS (SELECT doc_id, block_no, any_value(cls) AS cls, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_lines FROM numbered GROUP BY doc_id, block_no)"""


@query(f"WITH {LINES} SELECT doc_id, line_no, length(line) AS n_chars FROM lines")
def doc_lines(spark, sf):
    return B.lines(t(spark, sf, "documents")).select("doc_id", "line_no", F.length("line").alias("n_chars"))


@query(f"WITH {BLOCKS} SELECT * FROM blocks")
def doc_blocks_islands(spark, sf):
    return B.document_blocks(t(spark, sf, "documents"))


@query(f"""WITH {BLOCKS} SELECT source, count(*) AS n_blocks, count(*) FILTER (cls = 'structural') AS n_kept,
  count(*) FILTER (cls = 'noisy') AS n_removable, sum(CASE WHEN cls = 'noisy' THEN greatest(n_lines - 1, 0) ELSE 0 END) AS lines_saved
  FROM blocks JOIN documents USING (doc_id) GROUP BY source""")
def block_counters(spark, sf):
    docs = t(spark, sf, "documents")
    per_doc = B.document_blocks(docs).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("cls") == "structural").alias("k"), F.count_if(F.col("cls") == "noisy").alias("r"),
        F.sum(F.when(F.col("cls") == "noisy", F.greatest(F.col("n_lines") - 1, F.lit(0))).otherwise(0)).alias("s"),
    )
    return docs.select("doc_id", "source").join(per_doc, "doc_id").groupBy("source").agg(
        F.sum("n").alias("n_blocks"), F.sum("k").alias("n_kept"), F.sum("r").alias("n_removable"), F.sum("s").alias("lines_saved")
    )


@query(f"""WITH {BLOCKS} SELECT doc_id, count(*) AS n_blocks, sum(CASE WHEN cls IN ('noisy', 'short') THEN n_lines ELSE 0 END) AS removable
  FROM blocks GROUP BY doc_id ORDER BY removable DESC, doc_id LIMIT 100""")
def topk_removable(spark, sf):
    """Flagship: documents ranked by removable lines; a top-k report."""
    n = F.sum(F.when(F.col("cls").isin("noisy", "short"), F.col("n_lines")).otherwise(0))
    per = B.document_blocks(t(spark, sf, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_blocks"), n.alias("removable"))
    return per.orderBy(F.desc("removable"), "doc_id").limit(100)


@query(f"WITH {CLASSED} SELECT cls, count(*) AS n FROM classed GROUP BY cls")
def structural_license(spark, sf):
    return B.lines(t(spark, sf, "documents")).groupBy(B.line_class(F.col("line")).alias("cls")).agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n FROM (SELECT doc_id, trim(line) AS s FROM lines) WHERE {CODE} GROUP BY doc_id")
def code_like_lines(spark, sf):
    return B.lines(t(spark, sf, "documents")).where(T.is_code_like(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n"))


_RULED = "CASE WHEN line_no % 3 = 0 THEN '  ' || repeat(['-', '=*', '#~_', '+/|', '.'][line_no % 5 + 1], doc_id % 4 + 1) || ' ' ELSE line END"


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n FROM (SELECT doc_id, {_RULED} AS line FROM lines) WHERE regexp_matches(trim(line), '^[-=*#~_+/|.]{{3,}}$') GROUP BY doc_id")
def separator_lines(spark, sf):
    """Separators among the lines of documents, every third of which is made a row of marks."""
    marks = F.element_at(F.array(*[F.lit(x) for x in ("-", "=*", "#~_", "+/|", ".")]), (F.col("line_no") % 5 + 1).cast("int"))
    ruled = F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("  "), F.repeat(marks, (F.col("doc_id") % 4 + 1).cast("int")), F.lit(" "))).otherwise(F.col("line"))
    rows = B.lines(t(spark, sf, "documents")).withColumn("line", ruled)
    return rows.where(T.is_separator(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES} SELECT doc_id, count(*) AS n_lines, sum(len(regexp_extract_all(line, '[^ ]+'))) AS word_count,
  round(sum(len(regexp_extract_all(line, '[^ ]+'))) / count(*), 6) AS words_per_line FROM lines WHERE line <> '' GROUP BY doc_id""")
def prose_stats(spark, sf):
    n = F.size(F.regexp_extract_all("line", F.lit("([^ ]+)"), 1))
    return B.lines(t(spark, sf, "documents")).where(F.col("line") != "").groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.sum(n).alias("word_count"), F.round(F.sum(n) / F.count("*"), 6).alias("words_per_line")
    )


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOK = f"list_filter(list_distinct(list_transform(regexp_extract_all(regexp_replace(replace(text, '_', ' '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z][A-Za-z0-9]*'), lambda w: lower(w))), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))"  # noqa: E501


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOK}) AS token FROM documents) GROUP BY token HAVING count(*) >= 20")
def ident_tokens(spark, sf):
    words = t(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).where("n >= 20")


TURNS = f"""turns AS (SELECT conv_id, turn, text, {_TOK} AS w FROM conversations),
pairs AS (SELECT a.conv_id, a.turn, a.text, b.text AS prev, a.w, b.w AS pw FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)"""


def _item_of(spark, sf):
    """The benchmark item of a document, dealt out over all items."""
    return F.col("doc_id") % t(spark, sf, "benchmark").count()


def _turn_pairs(spark, sf):
    c = t(spark, sf, "conversations").select("conv_id", "turn", "text", T.tokens(F.col("text")).alias("w"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prev"), F.col("w").alias("pw"))
    return c.join(before, ["conv_id", "turn"])


@query(f"""WITH {TURNS} SELECT conv_id, turn, CASE WHEN len(w) > 0 AND len(pw) > 0 THEN round(len(list_intersect(w, pw)) / len(w), 6) END AS overlap,
  len(w) > 0 AND len(list_filter(w, lambda x: NOT list_contains(pw, x))) = 0 AS echo FROM pairs""")
def token_overlap(spark, sf):
    w, p = F.col("w"), F.col("pw")
    return _turn_pairs(spark, sf).select("conv_id", "turn", F.round(T.overlap(w, p), 6).alias("overlap"), T.signature_echo(w, p).alias("echo"))


@query("""SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(text, '\\b[0-9]+(?:\\.[0-9]+)?')),
    lambda x: NOT list_contains(regexp_extract_all(coalesce(b, ''), '\\b[0-9]+(?:\\.[0-9]+)?'), x))) AS n_mismatch
  FROM documents LEFT JOIN (SELECT item_id, text AS b FROM benchmark) ON item_id = doc_id % (SELECT count(*) FROM benchmark) WHERE regexp_matches(text, '[0-9]')""")
def literal_mismatch(spark, sf):
    docs = t(spark, sf, "documents").where(F.col("text").rlike("[0-9]")).withColumn("item_id", _item_of(spark, sf))
    code = t(spark, sf, "benchmark").select("item_id", F.col("text").alias("b"))
    bad = F.array_except(T.numbers(F.col("text")), T.numbers(F.coalesce("b", F.lit(""))))
    return docs.join(code, "item_id", "left").select("doc_id", F.size(bad).alias("n_mismatch"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) AS comment FROM pages""")
def page_comments(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?s)<!--(.*?)-->"), 1)).alias("comment"))


@query("SELECT doc_id, quality FROM documents JOIN labels USING (doc_id)")
def label_inner_join(spark, sf):
    return t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT source, count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY source")
def doc_anti_labels(spark, sf):
    return t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("missing"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def doc_semi_labels(spark, sf):
    return t(spark, sf, "documents").join(t(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'ready' ELSE 'retry' END, 'pending') AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND quality IS NOT NULL"
       .replace("coalesce(CASE WHEN quality = 1 THEN 'ready' ELSE 'retry' END, 'pending')", "CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 THEN 'ready' ELSE 'retry' END"))
def label_left_join_cache(spark, sf):
    known = t(spark, sf, "labels").where("quality is not null").select("doc_id", "quality")
    state = F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 1, "ready").otherwise("retry")
    return t(spark, sf, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", state.alias("state"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def dup_text_dedupe(spark, sf):
    return t(spark, sf, "documents").groupBy(F.md5(F.encode("text", "UTF-8")).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1").drop("h")


HUNKS = "hunks AS (SELECT doc_id, 1 + doc_id % 7 AS new_start, doc_id % 4 AS new_count, 1 + doc_id % 5 AS old_start, doc_id % 3 AS old_count FROM documents)"


def _hunks(docs):
    d = F.col("doc_id")
    return docs.select(d.alias("path"), (1 + d % 7).alias("new_start"), (d % 4).alias("new_count"), (1 + d % 5).alias("old_start"), (d % 3).alias("old_count"))


def _items(docs):
    return B.document_blocks(docs).select(F.col("doc_id").alias("path"), F.col("block_no").alias("item"), F.col("first_line").alias("start_line"), F.col("last_line").alias("end_line"), F.col("cls").alias("kind"))  # noqa: E501


@query(f"""WITH {BLOCKS}, {HUNKS} SELECT b.doc_id AS path, block_no AS item, new_start, new_count FROM blocks b JOIN hunks h ON b.doc_id = h.doc_id
  AND new_count > 0 AND first_line <= new_start + new_count - 1 AND last_line >= new_start""")
def interval_overlap(spark, sf):
    docs = t(spark, sf, "documents")
    return C.overlap_join(_items(docs), _hunks(docs)).select("path", "item", "new_start", "new_count")


@query(f"""WITH {BLOCKS}, {HUNKS}, items AS (
    SELECT doc_id AS path, block_no AS item, first_line AS lo, last_line AS hi, cls AS kind, cls || ':' || block_no AS text, greatest(first_line - 2, 1) AS s_lo, last_line + 2 AS s_hi FROM blocks),
  olds AS (SELECT path, lo AS o_lo, hi AS o_hi, kind AS o_kind, text || CASE WHEN item % 3 = 0 THEN '!' ELSE '' END AS o_text FROM items),
  side AS (SELECT i.*, h.*, o_lo, o_hi, o_kind, o_text, old_count > 0 AND o_lo <= old_start + old_count - 1 AND o_hi >= old_start AS cut
    FROM items i JOIN hunks h ON h.doc_id = i.path LEFT JOIN olds o ON o.path = i.path AND o_kind = kind),
  hunked AS (SELECT path, item, lo, hi, any_value(new_start) AS ns, any_value(new_count) AS nc,
    CASE WHEN any_value(new_count) > 0 THEN lo <= any_value(new_start) + any_value(new_count) - 1 AND hi >= any_value(new_start)
      ELSE coalesce(bool_or(cut AND (o_lo < old_start AND lo <= new_start AND hi >= new_start OR o_hi >= old_start + old_count AND lo <= new_start + 1 AND hi >= new_start + 1)), false) END AS relevant,
    coalesce(bool_or(cut AND o_text = text), false) AS carried, coalesce(bool_or(o_text = text), false) AS moved,
    coalesce(bool_or(cut AND greatest(o_lo - old_start, 0) = greatest(lo - new_start, 0)), false) AS in_place,
    CASE WHEN any_value(new_count) > 0 THEN any_value(s_lo) <= any_value(new_start) + any_value(new_count) - 1 AND any_value(s_hi) >= any_value(new_start)
      ELSE any_value(s_lo) <= any_value(new_start) + 1 AND any_value(s_hi) >= any_value(new_start) END AS scoped
    FROM side GROUP BY path, item, lo, hi)
  SELECT path, item, CASE WHEN relevant AND NOT carried THEN CASE WHEN greatest(0, least(hi, ns + nc - 1) - greatest(lo, ns) + 1) < hi - lo + 1 OR moved OR in_place THEN 'modified' ELSE 'added' END
    WHEN scoped THEN 'scope_changed' ELSE 'untouched' END AS tier FROM hunked""")
def change_tiers(spark, sf):
    """Tiers of blocks against hunks and the blocks of the version before."""
    docs = t(spark, sf, "documents")
    items = _items(docs).withColumn("text", F.concat_ws(":", "kind", "item")).withColumn("scope_start", F.greatest(F.col("start_line") - 2, F.lit(1))).withColumn("scope_end", F.col("end_line") + 2)
    old = items.select("path", "start_line", "end_line", "kind", F.concat("text", F.when(F.col("item") % 3 == 0, "!").otherwise("")).alias("text"))
    return C.tiers(items, _hunks(docs), old).select("path", "item", "tier")


@query("""WITH p AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view')
  SELECT event_id, nearest_at, distance FROM (SELECT event_id, v.us AS nearest_at, abs(p.us - v.us) AS distance,
    row_number() OVER (PARTITION BY event_id ORDER BY abs(p.us - v.us), v.us) AS r FROM p JOIN v USING (user_id)) WHERE r = 1""")
def nearest_match(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    left, right = e.where("event_type = 'purchase'"), e.where("event_type = 'view'")
    return C.nearest(left, right, ["user_id"], "event_id", "us", "us")


@query("SELECT user_id, max(event_id) AS event_id FROM events e WHERE ts = (SELECT max(ts) FROM events x WHERE x.user_id = e.user_id) GROUP BY user_id")
def newest_event(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "m.event_id")


@query("""SELECT user_id, event_type AS state, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_wins_ledger(spark, sf):
    last = F.max(F.struct("ts", "event_id"))
    return t(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("state")).agg(last.alias("m")).select("user_id", "state", "m.event_id")


@query(f"""WITH {LINES} SELECT doc_id, line_no, (SELECT min(n.line_no) FROM lines n WHERE n.doc_id = l.doc_id AND n.line_no > l.line_no AND length(n.line) >= 40) AS next_long FROM lines l""")
def next_nonblank(spark, sf):
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    long = F.when(F.length("line") >= 40, F.col("line_no"))
    return B.lines(t(spark, sf, "documents")).select("doc_id", "line_no", F.first(long, ignorenulls=True).over(w).alias("next_long"))


_DIGITS = "list_transform(string_split(sha1(k), ''), lambda c: strpos('0123456789abcdef', c) - 1)"


@query(f"""SELECT doc_id, CASE WHEN r <= 4 THEN 'train' WHEN r <= 6 THEN 'dev' ELSE 'test' END AS split, s % 5 = 0 AS is_dev
  FROM (SELECT doc_id, (6 * list_sum(d[1:39]) + d[40]) % 10 AS r, list_sum(d) AS s FROM (SELECT doc_id, {_DIGITS} AS d FROM (SELECT doc_id, doc_id::VARCHAR AS k FROM documents)))""")
def split_of(spark, sf):
    k = F.col("doc_id").cast("string")
    return t(spark, sf, "documents").select("doc_id", T.split_of(k).alias("split"), T.is_dev(k).alias("is_dev"))


V5 = "['keep', 'rewrite_shorter', 'delete', 'rename_instead', 'fix_wrong_claim', 'review']"
PAIRS = f"""pairs AS (SELECT doc_id, lang AS language, CASE WHEN doc_id % 2 = 0 THEN 'inline' ELSE 'api_doc' END AS kind,
  {V5}[1 + (doc_id * 7 + quality * 3 + toxic) % 5] AS gold, {V5}[1 + CASE WHEN doc_id % 3 = 0 THEN (doc_id * 11) % 6 ELSE (doc_id * 7 + quality * 3 + toxic) % 5 END] AS system,
  toxic = 1 AS hazard, (doc_id * 13 % 100) / 100.0 AS adds, (doc_id * 29 % 100) / 100.0 AS g1_candidate, (doc_id * 37 % 997)::DOUBLE AS latency_ms
  FROM documents JOIN labels USING (doc_id))"""


def _pairs(spark, sf):
    d = F.col("doc_id")
    names = F.array(*[F.lit(v) for v in (*P.VERDICTS, "review")])
    gold = ((d * 7 + F.col("quality") * 3 + F.col("toxic")) % 5).cast("int")
    system = F.when(d % 3 == 0, (d * 11) % 6).otherwise(gold).cast("int")
    rows = t(spark, sf, "documents").select("doc_id", F.col("lang").alias("language")).join(t(spark, sf, "labels"), "doc_id")
    return rows.select(
        "doc_id", "language", F.when(d % 2 == 0, "inline").otherwise("api_doc").alias("kind"), F.get(names, gold).alias("gold"), F.get(names, system).alias("system"),
        (F.col("toxic") == 1).alias("hazard"), ((d * 13 % 100) / 100.0).alias("adds"), ((d * 29 % 100) / 100.0).alias("g1_candidate"),
        (d * 37 % 997).cast("double").alias("latency_ms"),
    )


@query(f"WITH {PAIRS} SELECT gold, " + ", ".join(f"count(*) FILTER (system = '{v}') AS {v}" for v in (*P.VERDICTS, "review")) + " FROM pairs GROUP BY gold")
def confusion_matrix(spark, sf):
    return M.confusion(_pairs(spark, sf))


@query(f"""WITH {PAIRS}, c AS (SELECT language, cls, count(*) FILTER (gold = cls AND system = cls) AS tp, count(*) FILTER (gold = cls OR system = cls) AS u
  FROM pairs, (SELECT unnest({V5}[1:5]) AS cls) GROUP BY ALL) SELECT language, round(coalesce(avg(CASE WHEN u > 0 THEN 2 * tp / (u + tp) END), 0), 6) AS macro_f1 FROM c GROUP BY language""")
def macro_f1(spark, sf):
    return M.macro_f1(_pairs(spark, sf), ["language"]).withColumn("macro_f1", F.round("macro_f1", 6))


FLAGS = f"""{PAIRS}, f0 AS (SELECT *, system = 'review' AS review, hazard AND gold IN ('keep', 'rewrite_shorter') AND system IN ('delete', 'rename_instead') AS hazard_lost FROM pairs),
f1 AS (SELECT *, NOT hazard_lost AND system IN ('delete', 'rename_instead') AND gold NOT IN ('delete', 'rename_instead') AS wrong_delete,
  system IN ('rewrite_shorter', 'fix_wrong_claim') AND gold = 'keep' AS churn, system = 'keep' AND gold <> 'keep' AS wrong_keep,
  system IN ('rewrite_shorter', 'fix_wrong_claim') AND (adds > 0.5 OR g1_candidate > 0.5) AS error_introduced FROM f0),
flags AS (SELECT *, 0.5 * review::INT + 10 * hazard_lost::INT + 3 * error_introduced::INT + wrong_delete::INT + churn::INT + 0.3 * wrong_keep::INT AS cost FROM f1)"""
_FLAG = ("review", "hazard_lost", "wrong_delete", "churn", "wrong_keep", "error_introduced")


@query(f"WITH {FLAGS} SELECT doc_id, {', '.join(_FLAG)}, round(cost, 3)::DOUBLE AS cost FROM flags")
def event_flags_cost(spark, sf):
    return M.event_flags(_pairs(spark, sf)).select("doc_id", *_FLAG, F.round("cost", 3).alias("cost"))


@query(f"""WITH {FLAGS} SELECT language, kind, count(*) AS n, {', '.join(f'count(*) FILTER ({c}) AS {c}' for c in _FLAG)}, round(sum(cost), 3)::DOUBLE AS cost,
  round(count(*) FILTER (hazard_lost) / nullif(count(*) FILTER (hazard AND gold IN ('keep', 'rewrite_shorter')), 0), 6) AS hazards_lost_rate,
  round(count(*) FILTER (review) / count(*), 6) AS review_rate, round(count(*) FILTER (gold = system AND NOT review) / nullif(count(*) FILTER (NOT review), 0), 6) AS rest_accuracy
  FROM flags GROUP BY GROUPING SETS ((), (language), (kind))""")
def metrics_grouping_sets(spark, sf):
    out = M.summary(M.event_flags(_pairs(spark, sf)))
    return out.withColumns({c: F.round(c, 6) for c in ("hazards_lost_rate", "review_rate", "rest_accuracy")}).withColumn("cost", F.round("cost", 3))


@query(f"""WITH {PAIRS} SELECT round(avg((gold = system)::INT), 6) AS accuracy, round(count(*) FILTER (gold = 'delete' AND system = 'delete') / greatest(count(*) FILTER (system = 'delete'), 1), 6) AS delete_precision,
  round(count(*) FILTER (gold = 'delete' AND system = 'delete') / greatest(count(*) FILTER (gold = 'delete'), 1), 6) AS delete_recall FROM pairs""")
def precision_recall(spark, sf):
    hit = F.count_if((F.col("gold") == "delete") & (F.col("system") == "delete"))
    n = lambda c: F.greatest(F.count_if(F.col(c) == "delete"), F.lit(1))
    return _pairs(spark, sf).agg(F.round(F.avg((F.col("gold") == F.col("system")).cast("int")), 6).alias("accuracy"), F.round(hit / n("system"), 6).alias("delete_precision"), F.round(hit / n("gold"), 6).alias("delete_recall"))


@query(f"""WITH {PAIRS}, r AS (SELECT language, latency_ms, row_number() OVER (PARTITION BY language ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY language) AS n FROM pairs)
  SELECT language, median(latency_ms) AS median_ms, max(latency_ms) FILTER (i = least(floor(n * 0.95), n - 1)) AS p95_ms FROM r GROUP BY language""")
def latency_quantiles(spark, sf):
    p = _pairs(spark, sf)
    p95 = M.percentile_index(p, ["language"], "latency_ms", 0.95).withColumnRenamed("value", "p95_ms")
    return p.groupBy("language").agg(F.median("latency_ms").alias("median_ms")).join(p95, "language")


@query(f"""WITH {PAIRS} SELECT a.language, round(sum(CASE WHEN a.adds > b.adds THEN 1 WHEN a.adds = b.adds THEN 0.5 ELSE 0 END) / count(*), 6)::DOUBLE AS auc
  FROM (SELECT * FROM pairs WHERE hazard) a JOIN (SELECT * FROM pairs WHERE NOT hazard) b USING (language) GROUP BY a.language""")
def auc(spark, sf):
    s = _pairs(spark, sf).select("language", F.col("adds").alias("score"), F.col("hazard").alias("positive"))
    return M.auc(s, ["language"]).where("auc is not null").withColumn("auc", F.round("auc", 6))


def _answers(spark, sf):
    """Deterministic answers: a fixed-point stand-in for a judge."""
    d = F.col("doc_id")
    p = lambda m: (d * m % 100) / 100.0
    yes = lambda m: F.create_map(F.lit("true"), p(m), F.lit("false"), 1 - p(m))
    score = lambda m: F.create_map(F.lit("0"), 1 - p(m), F.lit("3"), p(m))
    rep = F.create_map(F.lit("no"), 1 - p(41), F.lit("fully"), p(41))
    names = {"g1_contradicts": yes(17), "hazard": yes(23), "leak": yes(31), "c2_info_gain": score(37), "c3_rationale": score(43), "c5_contract": score(47), "c8_durability": score(53), "c9_replaceable": rep}
    answers = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), v)])
    return t(spark, sf, "documents").select("doc_id", F.when(d % 2 == 0, "inline").otherwise("api_doc").alias("kind"), "text", answers.alias("answers"))


_P = {m: f"(doc_id * {m} % 100) / 100.0::DOUBLE" for m in (17, 23, 31, 37, 41, 43, 47, 53)}
ANSWERS = f"""a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'inline' ELSE 'api_doc' END AS kind, {_P[17]} AS g1, {_P[23]} AS hz, {_P[31]} AS leak, 3 * {_P[37]} AS c2, 3 * {_P[43]} AS c3,
  3 * {_P[47]} AS c5, 3 * {_P[53]} AS c8, {_P[41]} AS fully, 1 - {_P[41]} AS w, length(text) - length(replace(text, chr(10), '')) + 1 AS n FROM documents)"""


@query(f"""WITH {ANSWERS}, q AS (SELECT *, (2 * c2 / 3 + c5 + 2 * c8 / 3 + 0.5 * w) / 7.5 AS api FROM a) SELECT doc_id, CASE WHEN g1 > 0.4 THEN 'fix_wrong_claim'
  WHEN kind = 'api_doc' THEN CASE WHEN api < 0.2 OR c5 < 0.5 THEN 'delete' WHEN api < 0.45 THEN 'rewrite_shorter' ELSE 'keep' END
  WHEN c2 < 0.5 THEN 'delete' WHEN fully > 0.5 THEN 'rename_instead' WHEN hz < 0.3 AND c3 < 1.0 THEN 'delete'
  WHEN (hz >= 0.3 AND leak > 0.6) OR n > 1 THEN 'rewrite_shorter' ELSE 'keep' END AS verdict FROM q""")
def policy_verdict(spark, sf):
    return _answers(spark, sf).select("doc_id", P.decide(F.col("kind"), F.col("text"), F.col("answers"))["verdict"].alias("verdict"))


@query(f"WITH {ANSWERS} SELECT doc_id, CASE WHEN g1 > 0.5 THEN 'stale' ELSE 'fresh' END AS state FROM a")
def stale_verdict(spark, sf):
    return _answers(spark, sf).select("doc_id", P.stale(F.col("answers")).alias("state"))


@query(f"WITH {ANSWERS} SELECT doc_id, round(c2, 6) AS e, round(w, 6) AS weight, CASE WHEN fully > 0.5 THEN 'fully' WHEN fully = 0.5 THEN 'fully' ELSE 'no' END AS top FROM a")
def expectation(spark, sf):
    a = lambda k: F.col("answers")[k]
    return _answers(spark, sf).select(
        "doc_id", F.round(P.expectation(a("c2_info_gain")), 6).alias("e"), F.round(P.replaceable_weight(a("c9_replaceable")), 6).alias("weight"), P.argmax_first(a("c9_replaceable")).alias("top")
    )


@query(f"""WITH {ANSWERS} SELECT CASE WHEN NOT hz > 0.95 THEN 'drops content' WHEN NOT leak < 0.05 THEN 'adds content' WHEN NOT g1 < 0.3 THEN 'contradicts the code' END AS reason, count(*) AS n FROM a GROUP BY 1""")
def verify_accept(spark, sf):
    p = lambda k: P.prob(F.col("answers"), k, "true")
    return _answers(spark, sf).groupBy(P.verify(p("hazard"), p("leak"), p("g1_contradicts")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {PAIRS} SELECT 'adds' AS question, count(*) AS n, round(avg(((adds > 0.5) = hazard)::INT), 6) AS acc, round(avg(2 * (adds - hazard::INT) ** 2), 6)::DOUBLE AS brier FROM pairs WHERE adds <> 0.5""")
def brier_by_question(spark, sf):
    rows = _pairs(spark, sf).where("adds <> 0.5").select(
        F.lit("adds").alias("question"), F.col("hazard").cast("string").alias("gold"), F.create_map(F.lit("true"), F.col("adds").cast("double"), F.lit("false"), 1 - F.col("adds").cast("double")).alias("dist")
    )
    return M.question_stats(rows).withColumns({c: F.round(c, 6) for c in ("acc", "brier")})


@query(f"""WITH {PAIRS}, g AS (SELECT unnest(range(19)) AS grid_ix), c AS (SELECT grid_ix, round((grid_ix + 1) * 0.05, 2)::DOUBLE AS threshold, sum(CASE WHEN adds > round((grid_ix + 1) * 0.05, 2) AND NOT hazard THEN 1
  WHEN NOT adds > round((grid_ix + 1) * 0.05, 2) AND hazard THEN 10 ELSE 0 END) AS total FROM pairs, g GROUP BY grid_ix) SELECT * FROM c ORDER BY total, grid_ix LIMIT 1""")
def threshold_grid(spark, sf):
    over = F.col("adds") > F.col("threshold")
    cost = F.when(over & ~F.col("hazard"), 1).when(~over & F.col("hazard"), 10).otherwise(0)
    rows = _pairs(spark, sf).withColumn("adds", F.col("adds").cast("double"))
    return M.best_threshold(rows, [round((i + 1) * 0.05, 2) for i in range(19)], cost)


@query("""SELECT doc_id, source, lang, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY md5(doc_id || ':7'), doc_id) AS r FROM documents) WHERE r <= 3""")
def quota_sample(spark, sf):
    order = [F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7")).cast("binary")), F.col("doc_id")]
    return C.quota(t(spark, sf, "documents").select("doc_id", "source", "lang"), ["source", "lang"], order, 3)


def _findings(spark, sf):
    # Exploding an array of one keeps the policy a single expression, evaluated once for each row.
    made = _answers(spark, sf).withColumn("made", F.explode(F.array(P.decide(F.col("kind"), F.col("text"), F.col("answers")))))
    return made.where(F.col("made.verdict") != "keep").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.lit(1).alias("start_line"), (F.col("doc_id") % 9 + 1).alias("end_line"),
        F.lit("added").alias("tier"), "kind", F.col("made.verdict").alias("verdict"), F.col("made.checks").alias("checks"), F.lit("").alias("evidence"),
        F.lit("see the checks").alias("message"), F.col("text").alias("comment"),
    )


_CHECK = {
    k: f"'{n}=' || format('{{:.2f}}', {v}) || '/{t}'"
    for k, n, v, t in (
        ("g1", "g1", "g1", "0.40"), ("cut", "api_quality", "api", "0.20"), ("c5", "c5", "c5", "0.50"), ("short", "api_quality", "api", "0.45"), ("c2", "c2", "c2", "0.50"), ("ren", "rename", "fully", "0.50"),
        ("hz", "hazard", "hz", "0.30"), ("c3", "c3", "c3", "1.00"), ("leak", "leak", "leak", "0.60"),
    )
}
_MADE = {
    "wrong": "g1", "a1": "g1 cut", "a2": "g1 cut c5", "a3": "g1 cut c5 short", "c2": "g1 c2", "ren": "g1 c2 ren", "c3": "g1 c2 ren hz c3", "mild": "g1 c2 ren hz c3", "leak": "g1 c2 ren hz leak",
}
_CHECKS = "CASE leaf " + " ".join(f"WHEN '{k}' THEN {(chr(32) + '|| ' + repeat + ' || ').join(_CHECK[c] for c in v.split())}" for repeat in ("', '",) for k, v in _MADE.items()) + " END"
_LEAVES = f"""{ANSWERS}, q AS (SELECT *, (2 * c2 / 3 + 3 * c5 / 3 + 2 * c8 / 3 + 0.5 * w) / 7.5 AS api FROM a), leaves AS (SELECT *, CASE WHEN g1 > 0.4 THEN 'wrong'
  WHEN kind = 'api_doc' THEN CASE WHEN api < 0.2 THEN 'a1' WHEN c5 < 0.5 THEN 'a2' WHEN api < 0.45 THEN 'a3' END WHEN c2 < 0.5 THEN 'c2' WHEN fully > 0.5 THEN 'ren'
  WHEN hz < 0.3 AND c3 < 1.0 THEN 'c3' WHEN hz >= 0.3 AND (leak > 0.6 OR n > 1) THEN 'leak' WHEN hz < 0.3 AND n > 1 THEN 'mild' END AS leaf FROM q),
found AS (SELECT *, CASE WHEN leaf = 'wrong' THEN 'fix_wrong_claim' WHEN leaf IN ('a1', 'a2', 'c2', 'c3') THEN 'delete' WHEN leaf = 'ren' THEN 'rename_instead' ELSE 'rewrite_shorter' END AS verdict FROM leaves WHERE leaf IS NOT NULL)"""


@query(f"WITH {_LEAVES} SELECT 'doc/' || doc_id AS path, 'doc/' || doc_id || ':1-' || (doc_id % 9 + 1) || ': ' || verdict || ' (' || kind || ', added) see the checks; ' || {_CHECKS} AS line FROM found")
def findings_text(spark, sf):
    return _findings(spark, sf).select("path", FI.text_line().alias("line"))


@query()
def findings_advice(spark, sf):
    return _findings(spark, sf).select("path", FI.advice_row().alias("advice"))


@query()
def findings_sarif(spark, sf):
    return FI.sarif(_findings(spark, sf))


@query(f"WITH {_LEAVES} SELECT DISTINCT 'comment/' || verdict AS rule_id FROM found")
def rule_ids_sorted(spark, sf):
    return FI.rules(_findings(spark, sf))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS name, p_partkey // 2 AS base FROM part WHERE p_partkey > 1), c AS (SELECT name, base AS ancestor FROM e UNION SELECT c.name, e.base FROM c JOIN e ON c.ancestor = e.name)
  SELECT name, ancestor FROM c""")
def base_closure(spark, sf):
    edges = t(spark, sf, "part").where("p_partkey > 1").select(F.lit(1).alias("path"), F.col("p_partkey").alias("name"), F.expr("p_partkey div 2").alias("base"))
    return C.closure(edges).select("name", "ancestor")


@query("""SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source))""")
def category_counters(spark, sf):
    return t(spark, sf, "documents").groupingSets([["lang"], ["source"]], "lang", "source").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT doc_id, ['seconds', 'ms', '小时', '%', 'items'][doc_id % 5 + 1] AS unit FROM documents)
  SELECT doc_id, CASE WHEN unit <> 'items' AND doc_id % 3 > 0 THEN 'unit ' || CASE WHEN unit = '%' THEN doc_id || '%' ELSE unit END || ' next to literal ' || doc_id * 2 END AS guard FROM u""")
def unit_guard(spark, sf):
    """Units in what documents' ids make of a comment, next to the code's number if it has one."""
    d = F.col("doc_id")
    unit = F.element_at(F.array(*[F.lit(x) for x in ("seconds", "ms", "小时", "%", "items")]), (d % 5 + 1).cast("int"))
    code = F.when(d % 3 > 0, F.concat(F.lit("sleep("), d * 2, F.lit(", 7)"))).otherwise(F.lit("sleep(n)"))
    return t(spark, sf, "documents").select("doc_id", T.unit_literal(F.concat(F.lit("wait "), d, F.when(unit == "%", "").otherwise(" "), unit), code).alias("guard"))


@query("""WITH b AS (SELECT doc_id, hex(encode(lang)) AS l, hex(encode(text)) AS x FROM documents),
  n AS (SELECT *, (len(l) // 2)::BIGINT AS a, (len(x) // 2)::BIGINT AS b FROM b)
  SELECT doc_id, sha256(unhex(format('{:02X}{:02X}{:02X}{:02X}00000000', a & 255, (a >> 8) & 255, (a >> 16) & 255, a >> 24) || l || format('{:02X}{:02X}{:02X}{:02X}00000000', b & 255, (b >> 8) & 255, (b >> 16) & 255, b >> 24) || x)) AS key FROM n""")
def fingerprint_keys(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.fingerprint(F.col("lang"), F.col("text")).alias("key"))


def _quote(pattern: str) -> str:
    return pattern.replace("'", "''")


_LANGS = ("python", "javascript", "typescript", "tsx", "yaml", "rust")
_RULES = " OR ".join(
    (f"(lang IN ({', '.join(repr(x) for x in langs)}) AND " if langs else "(") + f"regexp_matches(line, '{_quote(p)}'))" for langs, p in S.RULES
)


@query(f"""WITH {LINES}, placed AS (SELECT doc_id, line_no, line, [{', '.join(repr(x) for x in _LANGS)}][doc_id % 6 + 1] AS lang FROM lines)
  SELECT lang, sum((regexp_matches(line, '{S.TODO}') OR d)::INT)::BIGINT AS n_structural, sum(d::INT)::BIGINT AS n_directive FROM (SELECT *,
    (lang IN ('python', 'yaml') AND line_no = 1 AND starts_with(line, '#!')) OR (lang = 'python' AND line_no <= 2 AND regexp_matches(line, '{_quote(S.CODING)}'))
    OR (lang IN ('javascript', 'typescript', 'tsx') AND regexp_matches(line, '^/\\*[*!]')) OR regexp_matches(line, '{T.LICENSE}') OR {_RULES} AS d FROM placed) GROUP BY lang""")
def structural_lines(spark, sf):
    """Lines of documents as comments of a language: what must stay as a directive, license or todo."""
    rows = B.lines(t(spark, sf, "documents")).withColumn("lang", F.element_at(F.array(*[F.lit(x) for x in _LANGS]), (F.col("doc_id") % 6 + 1).cast("int")))
    place = (F.col("lang"), F.col("line_no") - 1, F.col("line_no") - 1, F.lit(True), F.lit(False))
    return rows.groupBy("lang").agg(
        F.count_if(S.is_structural(F.col("line"), *place)).alias("n_structural"), F.count_if(S.is_directive(F.col("line"), *place)).alias("n_directive")
    )


@query("""WITH i AS (SELECT doc_id, d.text AS comment, coalesce(b.text, '') AS code, doc_id % 2 = 0 AS todo FROM documents d LEFT JOIN benchmark b ON item_id = doc_id % (SELECT count(*) FROM benchmark) WHERE d.text IS NOT NULL)
  SELECT doc_id, len(list_filter(regexp_extract_all(comment, '\\b[0-9]+(?:\\.[0-9]+)?[A-Za-z]*'), lambda m: NOT list_contains(regexp_extract_all(code, '\\b[0-9]+(?:\\.[0-9]+)?'), regexp_extract(m, '[0-9]+(?:\\.[0-9]+)?'))))
    + len(list_filter(regexp_extract_all(comment, '(?:^|[^\\w"''])("[^"\\n]+"|''[^''\\n]+'')', 1), lambda q: NOT contains(code, q[2:-2]))) AS n_mismatch,
    CASE WHEN todo THEN regexp_matches(comment, '@[A-Za-z0-9_]+|\\b[A-Z]{2,}-[0-9]+\\b|#[0-9]+|https?://') END AS todo_tracker FROM i""")
def comment_evidence(spark, sf):
    """Documents as comments on benchmark passages: literals that the passage lacks, and trackers of todos."""
    docs = t(spark, sf, "documents").where("text is not null").withColumn("item_id", _item_of(spark, sf)).withColumnRenamed("text", "comment")
    code = t(spark, sf, "benchmark").select("item_id", F.col("text").alias("code"))
    items = docs.join(code, "item_id", "left").select(
        "doc_id", "comment", F.coalesce("code", F.lit("")).alias("code"), F.lit("").alias("source"), F.lit(0).alias("start"), F.lit(0).alias("stop"),
        F.when(F.col("doc_id") % 2 == 0, "todo").otherwise("inline").alias("kind"),
    )
    return E.text_evidence(items).select("doc_id", F.size("literal_mismatch").alias("n_mismatch"), "todo_tracker")


_SCORED = """scored AS (SELECT doc_id, ['gold', 'drop', 'invent', 'gold', 'other'][doc_id % 5 + 1] AS variant, quality = 1 AS good,
  doc_id * 7 % 100 / 100 AS preserves, CASE WHEN doc_id % 9 > 0 THEN doc_id * 13 % 100 / 100 END AS adds, doc_id * 29 % 100 / 100 AS g1_candidate FROM labels WHERE quality IS NOT NULL)"""
_RATES = f"""{_SCORED}, kept AS (SELECT * FROM scored WHERE (good AND variant = 'gold') OR variant IN ('drop', 'invent')),
grid AS (SELECT * FROM (SELECT unnest({list(V.GRID_PRESERVES)})::DOUBLE AS th_preserves), (SELECT unnest({list(V.GRID_BELOW)})::DOUBLE AS th_adds), (SELECT unnest({list(V.GRID_BELOW)})::DOUBLE AS th_g1)),
rates AS (SELECT th_preserves, th_adds, th_g1, (count(*) FILTER (ok AND variant = 'gold')) AS gold_accepted, (count(*) FILTER (variant = 'gold')) AS gold_total,
  (count(*) FILTER (ok AND variant <> 'gold')) AS bad_accepted, (count(*) FILTER (variant <> 'gold')) AS bad_total,
  (count(*) FILTER (ok AND variant = 'drop')) AS drop_accepted, (count(*) FILTER (ok AND variant = 'invent')) AS invent_accepted
  FROM (SELECT *, coalesce(preserves, 0) > th_preserves AND coalesce(adds, 1) < th_adds AND coalesce(g1_candidate, 1) < th_g1 AS ok FROM kept, grid) GROUP BY ALL)"""


def _scored(spark, sf):
    d = F.col("doc_id")
    variant = F.element_at(F.array(*[F.lit(x) for x in ("gold", "drop", "invent", "gold", "other")]), (d % 5 + 1).cast("int"))
    return t(spark, sf, "labels").where("quality is not null").select(
        "doc_id", variant.alias("variant"), (F.col("quality") == 1).alias("good"), (d * 7 % 100 / 100).alias("preserves"),
        F.when(d % 9 > 0, d * 13 % 100 / 100).alias("adds"), (d * 29 % 100 / 100).alias("g1_candidate"),
    )


@query(f"WITH {_RATES} SELECT * FROM rates")
def verify_rates(spark, sf):
    return V.accept_rates(_scored(spark, sf))


@query(f"WITH {_RATES} SELECT * FROM rates WHERE bad_accepted <= 5 ORDER BY gold_accepted DESC, th_preserves DESC, th_adds, th_g1 LIMIT 1")
def verify_grid(spark, sf):
    return V.tune(V.accept_rates(_scored(spark, sf)), 5)


@query(f"""WITH {_SCORED}, r AS (SELECT variant, unnest(['preserves', 'adds', 'g1_candidate']) AS question, unnest([preserves, adds, g1_candidate]) AS p, good AS positive FROM scored),
  known AS (SELECT * FROM r WHERE p IS NOT NULL),
  a AS (SELECT x.question, sum(CASE WHEN x.p > y.p THEN 1 WHEN x.p = y.p THEN 0.5 ELSE 0 END) / count(*) AS auc FROM known x JOIN known y ON x.question = y.question AND x.positive AND NOT y.positive GROUP BY x.question)
  SELECT question, count(*) AS n, count(*) FILTER (positive) AS positives, round(avg(((p > 0.5) = positive)::INT), 6) AS acc, round(any_value(auc), 6)::DOUBLE AS auc,
    round(coalesce(avg(p) FILTER (variant = 'gold'), 0), 6) AS mean_gold, round(coalesce(avg(p) FILTER (variant <> 'gold'), 0), 6) AS mean_other FROM known JOIN a USING (question) GROUP BY question""")
def verify_questions(spark, sf):
    names = V.QUESTIONS
    both = lambda f: F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[f(n) for n in names]))
    rows = _scored(spark, sf).select("variant", both(lambda n: F.col("good")).alias("labels"), F.map_filter(both(F.col), lambda k, v: v.isNotNull()).alias("answers"))
    report = V.question_report(rows)
    return report.select("question", "n", "positives", *[F.round(c, 6).alias(c) for c in ("acc", "auc", "mean_gold", "mean_other")])


_PULLS = """pulls AS (SELECT o_orderkey AS id, o_custkey AS repo_id, o_orderpriority AS agent, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS merged_at FROM orders),
repos AS (SELECT c_custkey AS id, c_mktsegment AS language, c_nationkey::VARCHAR AS license, c_acctbal AS stars, c_custkey % 5 = 0 AS is_forked FROM customer),
details AS (SELECT l_orderkey AS pr_id, 'f' || l_partkey || CASE WHEN l_linenumber % 3 = 0 THEN '.md' ELSE '.py' END AS filename, repeat('+ # note' || chr(10) || '+x = 1' || chr(10), l_linenumber) AS patch FROM lineitem)"""


@query(f"""WITH {_PULLS}, n AS (SELECT pr_id, sum(len(regexp_extract_all(patch, '(?m)^\\+\\s*(#|//|/\\*|\\*)')))::BIGINT AS n_lines FROM details WHERE regexp_matches(filename, '\\.(py|js)$') GROUP BY pr_id)
  SELECT p.id, repo_id, agent, language, n_lines FROM pulls p JOIN repos r ON r.id = p.repo_id JOIN n ON n.pr_id = p.id
  WHERE merged_at IS NOT NULL AND agent IN ('1-URGENT', '2-HIGH') AND language IN ('BUILDING', 'MACHINERY') AND license IN ('1', '2', '3', '4', '5', '6', '7', '8', '9') AND stars > 50 AND NOT is_forked AND n_lines >= 3""")
def mined_pulls(spark, sf):
    o, c, li = (t(spark, sf, x) for x in ("orders", "customer", "lineitem"))
    pulls = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("repo_id"), F.col("o_orderpriority").alias("agent"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("merged_at"))
    repos = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("language"), F.col("c_nationkey").cast("string").alias("license"), F.col("c_acctbal").alias("stars"), (F.col("c_custkey") % 5 == 0).alias("is_forked"))
    name = F.concat(F.lit("f"), "l_partkey", F.when(F.col("l_linenumber") % 3 == 0, ".md").otherwise(".py"))
    details = li.select(F.col("l_orderkey").alias("pr_id"), name.alias("filename"), F.repeat(F.lit("+ # note\n+x = 1\n"), F.col("l_linenumber")).alias("patch"))
    return CU.mine(pulls, repos, details, ("1-URGENT", "2-HIGH"), ("BUILDING", "MACHINERY"), tuple("123456789"), r"\.(py|js)$")


@query("""WITH i AS (SELECT event_id AS key, CASE event_type WHEN 'click' THEN 'untouched' WHEN 'error' THEN 'scope_changed' ELSE 'added' END AS tier,
    CASE WHEN user_id % 3 > 0 THEN 'python' ELSE 'rust' END AS language, event_id * 37 % 6000 AS n_tokens, event_id % 10 > 0 AS classified FROM events),
  c AS (SELECT event_id AS key FROM events WHERE value > 50)
  SELECT i.key, CASE WHEN tier = 'untouched' THEN 'untouched' WHEN language <> 'python' OR tier = 'scope_changed' THEN 'direct' WHEN c.key IS NOT NULL THEN 'cached'
    WHEN n_tokens > 4096 THEN 'direct' WHEN classified THEN 'classified' ELSE 'error' END AS path FROM i LEFT JOIN c ON i.key = c.key""")
def screening_paths(spark, sf):
    e, key = t(spark, sf, "events"), F.col("event_id")
    items = e.select(
        key.alias("key"), F.when(F.col("event_type") == "click", "untouched").when(F.col("event_type") == "error", "scope_changed").otherwise("added").alias("tier"),
        F.when(F.col("user_id") % 3 > 0, "python").otherwise("rust").alias("language"), (key * 37 % 6000).alias("n_tokens"), (key % 10 > 0).alias("classified"),
    )
    return CU.screened(items, e.where("value > 50").select(key.alias("key"))).select("key", "path")


@query("""SELECT a.event_id AS key, CASE WHEN a.event_type = 'view' THEN coalesce(b.event_type, 'review') ELSE a.event_type END AS verdict
  FROM events a LEFT JOIN events b ON a.event_id = b.event_id AND b.event_id % 2 = 0 AND b.user_id % 2 = 0""")
def escalated_verdicts(spark, sf):
    e = t(spark, sf, "events").select(F.col("event_id").alias("key"), "event_type", "user_id")
    first = e.select("key", F.when(F.col("event_type") == "view", "review").otherwise(F.col("event_type")).alias("verdict"))
    return CU.escalated(first, e.where("key % 2 = 0 and user_id % 2 = 0").select("key", F.col("event_type").alias("verdict")))


_VERDICT = "['keep', 'rewrite_shorter', 'delete', 'rename_instead', 'fix_wrong_claim', 'other'][doc_id % 6 + 1]"


_KINDS = ["rationale", "todo", "banner", "other"]


@query(f"""WITH g AS (SELECT doc_id, {_VERDICT} AS verdict, ['api_doc', 'inline', 'todo', 'pragma'][doc_id % 4 + 1] AS comment_kind, CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 END AS score,
    ['before_statement', 'module_head', 'inside'][doc_id % 3 + 1] AS placement, {_KINDS}[doc_id % 4 + 1] AS kind, CASE WHEN doc_id % 9 > 0 THEN 'mental_model' END AS level, ['fully', 'no', 'maybe'][doc_id % 3 + 1] AS replaceable,
    CASE WHEN doc_id % 11 > 0 THEN doc_id % 2 = 0 END AS leak, CASE WHEN doc_id % 3 = 0 THEN 'r' END AS rewrite, CASE WHEN doc_id % 7 > 2 THEN 'n' END AS rename, doc_id % 2 = 0 AS g1, quality = 0 AS bad, doc_id % 13 = 0 AS absent FROM labels)
  SELECT doc_id, CASE WHEN absent THEN 2 ELSE (comment_kind = 'pragma')::INT + (placement = 'inside')::INT + (verdict = 'other')::INT + (kind = 'other')::INT + (level IS NULL)::INT + (replaceable = 'maybe')::INT + (leak IS NULL)::INT
    + 3 * (NOT coalesce(score BETWEEN 0 AND 3, false))::INT + (CASE WHEN (comment_kind = 'api_doc') <> (score IS NOT NULL) OR score > 3 THEN 1 ELSE 0 END) + (comment_kind = 'todo')::INT
    + ((verdict IN ('rewrite_shorter', 'fix_wrong_claim')) <> (rewrite IS NOT NULL))::INT + ((verdict = 'rename_instead' OR replaceable = 'fully') AND rename IS NULL)::INT
    + (g1 <> bad)::INT + (g1 AND verdict NOT IN ('fix_wrong_claim', 'delete'))::INT END AS n_errors
  FROM g WHERE bad IS NOT NULL""")
def gold_validation(spark, sf):
    """Faults by gold row, rows made of labels and arithmetic on ids."""
    d, pick = F.col("doc_id"), lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.col("doc_id") % len(x) + 1).cast("int"))
    score, null = F.when(d % 5 > 0, (d % 5).cast("int")), F.lit(None)
    labels = F.struct(
        pick("keep", "rewrite_shorter", "delete", "rename_instead", "fix_wrong_claim", "other").alias("verdict"), (d % 2 == 0).alias("g1_contradicts"), F.lit(False).alias("g1_unverifiable"),
        F.lit(True).alias("hazard"), F.when(d % 11 > 0, d % 2 == 0).alias("leak"), pick(*_KINDS).alias("kind"), F.when(d % 9 > 0, "mental_model").alias("c4_level"),
        score.alias("c2_info_gain"), score.alias("c3_rationale"), score.alias("c8_durability"), score.alias("c5_contract"), null.cast("int").alias("c10_actionable"),
        F.when(d % 3 == 0, "r").alias("rewrite"), pick("fully", "no", "maybe").alias("c9_replaceable"), F.when(d % 7 > 2, "n").alias("rename_suggestion"),
    )
    there = d % 13 != 0
    rows = t(spark, sf, "labels").where("quality is not null").select(
        "doc_id", d.cast("string").alias("id"), F.lit("python").alias("language"), pick("api_doc", "inline", "todo", "pragma").alias("comment_kind"), pick("before_statement", "module_head", "inside").alias("placement"),
        F.when(there, "c").alias("comment"), F.when(there, "a  b").alias("annotated_code"), F.lit("x a b y").alias("enclosing_scope"),
        F.array(F.when(F.col("quality") == 0, "contradicted").otherwise("confirmed")).alias("claims"), labels.alias("labels"),
    )
    return rows.select("doc_id", F.size(CU.gold_errors()).alias("n_errors"))


@query("""WITH c AS (SELECT doc_id, doc_id % 8 AS k FROM documents)
  SELECT doc_id, CASE WHEN k = 0 THEN 'directive' WHEN doc_id % 3 = 0 OR k = 1 THEN 'api_doc' WHEN k IN (2, 3) THEN 'todo' WHEN k = 4 OR k = 7 THEN 'directive' ELSE 'inline' END AS kind,
    CASE WHEN doc_id % 3 = 0 THEN ['module', 'class', 'function'][doc_id // 3 % 3 + 1] || '_head' WHEN doc_id % 2 = 0 THEN 'before_statement' ELSE 'trailing' END AS placement FROM c""")
def comment_kinds(spark, sf):
    """Kind and placement of comments that documents' ids make; every third is a docstring."""
    d, k = F.col("doc_id"), F.col("doc_id") % 8
    text = F.element_at(
        F.array(*[F.lit(x) for x in ("/** @jest-environment TODO */", "/** x */", "# TODO x", "// @todo x", "# noqa", "# NOTE x", "# pragmatic TODOS @todos", "# pragma: no cover")]), (k + 1).cast("int")
    )
    docstring = F.when(d % 3 == 0, F.element_at(F.array(F.lit("module"), F.lit("class"), F.lit("function")), (F.floor(d / 3) % 3 + 1).cast("int")))
    directive = S.is_directive(text, F.lit("python"), F.lit(5), F.lit(9), F.startswith(text, F.lit("/*")), F.lit(False))
    documents = docstring.isNotNull() | F.startswith(text, F.lit("/**"))
    return t(spark, sf, "documents").select("doc_id", S.comment_kind(text, directive, documents).alias("kind"), S.placement(d % 2 == 0, docstring).alias("placement"))


@query("""SELECT doc_id, doc_id % 7 = 0 OR (doc_id % 3 = 0 AND doc_id % 2 = 0) OR doc_id % 5 = 0 OR doc_id % 11 = 0 OR regexp_matches(text, '(?i)\\b(license|copyright|spdx)\\b') AS kept FROM documents""")
def kept_docstrings(spark, sf):
    """Documents as docstrings: doctests, readers of __doc__, licenses, kept decorators and bases."""
    d = F.col("doc_id")
    text = F.concat("text", F.when(d % 7 == 0, "\n>>> f()").otherwise(""))
    kind = F.when(d % 3 == 0, "module").otherwise("class")
    source = F.concat(F.lit("x = 1\n"), F.when(d % 2 == 0, "print(__doc__)").otherwise("__docs__"))
    decorators = F.array(F.lit("@other.tools(1)"), F.when(d % 5 == 0, "@a.b.tool(name='x')").otherwise("@mytool"))
    kept = S.keeps_docstring(text, kind, source, decorators, d % 11 == 0, F.array(F.lit("tool"), F.lit("x.y")))
    return t(spark, sf, "documents").select("doc_id", kept.alias("kept"))


@query("""SELECT doc_id % 4 AS tier, count(*) AS n FROM documents WHERE NOT (doc_id % 4 = 0 AND doc_id % 3 = 0) GROUP BY 1""")
def judged_items(spark, sf):
    """Items that pass the gate of the second tier (tier 0 here), whose mentions are empty, filled or unknown."""
    d = F.col("doc_id")
    mentions = F.when(d % 3 == 0, F.array().cast("array<string>")).when(d % 3 == 1, F.array(F.lit("x")))
    items = t(spark, sf, "documents").select("doc_id", F.when(d % 4 == 0, "scope_changed").otherwise("added").alias("tier"), mentions.alias("changed_mentions"))
    return CU.gated(items).groupBy((d % 4).alias("tier")).agg(F.count("*").alias("n"))


from . import change_queries, edit_queries, reply_queries, report_queries, sampling_queries, tuning_queries, window_queries  # noqa: E402,F401  (they register their queries here)
