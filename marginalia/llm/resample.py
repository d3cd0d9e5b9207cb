"""Importance resampling towards a target text, with hashed word n-grams.

Words are exploded with their positions; ``lead()`` over a document's positions sets the following words beside
each word, so every order's n-gram is a concatenation of columns. N-grams are hashed to buckets, counted in the
corpus and in the target, and the log ratio of the two is a bucket's gain. Gains are joined back to the words; a
document's weight is their mean, and Gumbel noise seeded by its id turns weights into a draw without replacement.

Rows that agree in id and text are counted together and dealt out again at the end, so no row id is needed and
copies stay rows. Null texts have no words: weight 0, never drawn as long as ``min_words`` is over 0. An empty
target or corpus gives gains of pure smoothing. Other columns are ignored. Rows with a null id share the noise of
the empty id and come last among equal scores.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Runs of ASCII characters that are no letters or digits stand between words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most buckets whose gains are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_BUCKETS = 1_000_000


@dataclass(frozen=True)
class ResampleParams:
    max_order: int = 1  # n-grams of 1 to this many words
    buckets: int = 10_000
    min_words: int = 20  # shorter documents are never drawn
    percent: int = 10  # of the documents that can be drawn
    seed: str = "2024"
    block: int = 4096  # words of a document that one window group holds


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def lower_ascii(word: Column) -> Column:
    """A-Z alone; a word of ASCII characters takes the fast path."""
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def ngram_positions(rows: DataFrame, keys: Sequence[str], max_order: int, block: int = 4096) -> DataFrame:
    """(keys, first, word, ngram) of every word position and order, from (keys, text); keys name one row each.

    ``first`` is true once for each row of the input, ``word`` is set on n-grams of order 1 alone, so that counting
    them counts rows and words. A row without words gives one row with both n-gram and word null.

    Beyond order 1 a document's positions are windowed in blocks of ``block`` words, each with the words that its
    last n-grams reach into, so a long document is many window groups.
    """
    pos, word = F.posexplode_outer(word_list(F.col("text"))).alias("pos", "raw"), lower_ascii(F.col("raw"))
    words = rows.select(*keys, pos).withColumn("word", word).drop("raw")
    first = F.coalesce(F.col("pos") == 0, F.lit(True)).alias("first")
    if max_order == 1:
        return words.select(*keys, first, "word", F.col("word").alias("ngram"))
    own = F.coalesce(F.floor(F.col("pos") / block), F.lit(0))
    reached = (F.col("pos") % block < max_order - 1) & (F.col("pos") >= block)
    placed = words.withColumn("own", own).withColumn("at", F.explode(F.when(reached, F.array("own", F.col("own") - 1)).otherwise(F.array("own"))))
    window = Window.partitionBy(*keys, "at").orderBy("pos")
    follows = [F.lead("word", k).over(window).alias(f"w{k}") for k in range(1, max_order)]
    beside = placed.select(*keys, "pos", "own", "at", "word", *follows).where("own = at")
    orders = [F.struct(F.col("word").alias("word"), F.col("word").alias("ngram"))]
    for k in range(2, max_order + 1):
        run = [F.col("word"), *[F.col(f"w{i}") for i in range(1, k)]]
        orders.append(F.when(run[-1].isNotNull(), F.struct(F.lit(None).cast("string").alias("word"), F.concat_ws(" ", *run).alias("ngram"))))
    each = beside.select(*keys, first, F.posexplode(F.array_compact(F.array(*orders))).alias("order", "g"))
    return each.select(*keys, (F.col("first") & (F.col("order") == 0)).alias("first"), "g.word", "g.ngram")


def bucket(ngram: Column, buckets: int) -> Column:
    return (F.crc32(ngram) % buckets).cast("int")


def _keyed(docs: DataFrame, id_col: str, text_col: str, max_order: int) -> DataFrame:
    """(id, digest, copies, text); where n-grams reach over rows, rows of equal id and text become one."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
    if max_order == 1:
        return rows.withColumn("copies", F.lit(1).cast("long"))
    return rows.groupBy("id", "digest", "text").agg(F.count("*").alias("copies"))


def bucket_gains(docs: DataFrame, target: DataFrame, params: ResampleParams = ResampleParams(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(bucket, n_docs, n_target, gain) of every bucket that the corpus or the target fills, at most ``buckets`` rows."""

    def counts(rows: DataFrame, name: str) -> DataFrame:
        grams = ngram_positions(rows, ["id", "digest", "copies"], params.max_order, params.block).where("ngram is not null")
        return grams.groupBy(bucket(F.col("ngram"), params.buckets).alias("bucket")).agg(F.sum("copies").alias(name))

    corpus = counts(_keyed(docs, id_col, text_col, params.max_order), "n_docs")
    aims = target.select(F.lit(0).alias("__id"), F.col(target_col).alias("__text"))
    aimed = counts(_keyed(aims, "__id", "__text", params.max_order), "n_target")
    both = saved(corpus.join(aimed, "bucket", "full").na.fill(0), "bucket-counts")
    total = both.agg(F.sum("n_docs").alias("s"), F.sum("n_target").alias("t")).first()
    s, t = (float((x or 0) + params.buckets) for x in (total.s, total.t))
    ratio = ((F.col("n_target") + 1).cast("double") * s) / ((F.col("n_docs") + 1).cast("double") * t)
    return both.withColumn("gain", F.floor(1000 * F.log(ratio)).cast("long"))


def score_documents(docs: DataFrame, gains: DataFrame, params: ResampleParams = ResampleParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, copies, n_words, n_features, weight, score) of every distinct (id, text)."""
    grams = ngram_positions(_keyed(docs, id_col, text_col, params.max_order), ["id", "digest", "copies"], params.max_order, params.block)
    small = gains.select("bucket", "gain")
    small = F.broadcast(small) if params.buckets <= BROADCAST_BUCKETS else small
    joined = grams.withColumn("bucket", bucket(F.col("ngram"), params.buckets)).join(small, "bucket", "left")
    sums = joined.groupBy("id", "digest").agg(
        F.sum(F.when(F.col("first"), F.col("copies")).otherwise(0)).alias("copies"),
        F.sum(F.when(F.col("word").isNotNull(), F.col("copies")).otherwise(0)).alias("words"),
        F.sum(F.when(F.col("ngram").isNotNull(), F.col("copies")).otherwise(0)).alias("features"),
        F.sum(F.col("gain") * F.col("copies")).alias("gain"),
    )
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    weight = F.when(F.col("features") > 0, F.expr("(gain - pmod(gain, features)) div features")).otherwise(0).cast("long")
    return sums.select(
        "id", "digest", "copies",
        F.expr("words div copies").alias("n_words"), F.expr("features div copies").alias("n_features"), weight.alias("weight"),
    ).withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, order: Sequence[Column], label: str, rank: str = "rank") -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... in an order over all rows, which no single task sees.

    Rows are dealt out by ranges of the order and written, so that partitions keep their rows. The sizes of the
    partitions, as many as there are partitions, give each one's offset.
    """
    dealt = saved(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), label)
    before, offsets = 0, []
    for part, n in sorted(dealt.groupBy("__part").count().collect()):
        offsets.append((part, before))
        before += n
    places = rows.sparkSession.createDataFrame(offsets, "__part int, __before long")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    out = dealt.withColumn("__within", within).join(F.broadcast(places), "__part")
    return out.withColumn(rank, F.col("__within") + F.col("__before")).drop("__part", "__before", "__within")


def resample(docs: DataFrame, target: DataFrame, params: ResampleParams = ResampleParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, n_words, n_features, weight, score, rank) of every row; ``rank`` is null where it isn't drawn."""
    gains = bucket_gains(docs, target, params, id_col, text_col)
    scored = saved(score_documents(docs, gains, params, id_col, text_col), "importance")
    run = 10_000  # rows that one row is dealt out to at a time, so that a text repeated everywhere fills many tasks
    runs = scored.withColumn("run", F.explode(F.expr(f"sequence(0L, (copies - 1) div {run})"))).repartition("id", "digest", "run")
    each = runs.withColumn("copy", F.explode(F.expr(f"sequence(run * {run} + 1, least(copies, (run + 1) * {run}))"))).drop("copies", "run")
    able = each.where(F.col("n_words") >= params.min_words)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("digest"), F.col("copy")]
    placed = ranked(able, order, "importance-order")
    n = scored.where(F.col("n_words") >= params.min_words).agg(F.sum("copies")).first()[0] or 0
    rank = F.when(F.col("rank") <= params.percent * n // 100, F.col("rank")).cast("long")
    others = each.where(F.col("n_words") < params.min_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", rank).unionByName(others).drop("copy")


def drawn(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``sample`` (of resample) draws, all columns; of equal rows as many as were drawn."""
    chosen = sample.where("rank is not null").groupBy("id", "digest").agg(F.count("*").alias("__n"))
    keyed = docs.withColumn("__id", F.col(id_col)).withColumn("__digest", F.xxhash64(F.col(text_col)))
    chosen = chosen.withColumnsRenamed({"id": "__cid", "digest": "__cdigest"})
    met = keyed.join(chosen, F.col("__id").eqNullSafe(F.col("__cid")) & (F.col("__digest") == F.col("__cdigest")))
    row = F.monotonically_increasing_id()
    placed = ranked(met.withColumn("__row", row), [F.col("__cid"), F.col("__cdigest"), F.col("__row")], "drawn", "__rank")
    starts = placed.groupBy(F.col("__cid").alias("__sid"), F.col("__cdigest").alias("__sdigest")).agg(F.min("__rank").alias("__start"))
    same = F.col("__cid").eqNullSafe(F.col("__sid")) & (F.col("__cdigest") == F.col("__sdigest"))
    return placed.join(starts, same).where(F.col("__rank") - F.col("__start") < F.col("__n")).select(*docs.columns)
