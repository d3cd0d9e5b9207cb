"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, licenses, line_templates, mixing, pii, quality, resample, search, simhash, toxicity, url_filter, warc
from .common import saved, shared_path, table

#: Target shares of tokens by domain; a document's domain is what `labels` says of it.
TARGETS = {"good": 0.9, "poor": 0.08, "toxic": 0.02}


def domain_labels(labels: DataFrame) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("label"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each license notice in whole ``documents`` texts; texts without one give none."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``; null, empty and wordless html: the empty string."""
    pages = table(spark, sf_dir, "pages")
    found = html_extract.extract_pages(pages, html_extract.fit_weights(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every row of ``pages``; a null url has an empty host and path."""
    labels = table(spark, sf_dir, "labels")
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), good.alias("good"))
    found = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``; null and wordless texts have fingerprint zero."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` written to archives and read back; null html is an empty payload, null ids have records."""
    pages = table(spark, sf_dir, "pages")
    folder = shared_path(spark, "warc")
    dictionary = warc.train_dictionary(warc.sample_records(pages))
    report = saved(warc.write_archives(pages, folder, dictionary), "warc-report")
    found = warc.read_archives(spark, folder, report)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped and spared lines and a digest of what is left, for every row of ``documents``."""
    found = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", "n_spared", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every row of ``documents``; null and empty texts get that of no features, without labels all are 0."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).withColumn("swapped_rows", F.lit(model.swapped_rows))


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain, rate and copies of every row of ``documents``; without labels every rate is 1."""
    found = mixing.mix(table(spark, sf_dir, "documents"), domain_labels(table(spark, sf_dir, "labels")), TARGETS)
    return found.select("doc_id", "n_tokens", "domain", F.round("rate", 6).alias("rate"), "copies")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every row of ``documents``; null and wordless texts have none."""
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(leaks)


def op10_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdicts of every row of ``documents``; null texts measure 0."""
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("base_failed", ~quality.passes("base")).withColumn("kept", quality.passes("v2"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, weight, score and rank of every row of ``documents``, towards ``benchmark``; null texts weigh 0."""
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best ``documents`` of every ``benchmark`` item; items that meet no document give no rows."""
    index = search.build_index(table(spark, sf_dir, "documents"))
    found = search.search(index, table(spark, sf_dir, "benchmark"), 10)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every row of ``documents``: base counts and digest, and all spans; null texts have none."""
    docs = table(spark, sf_dir, "documents")
    return pii.report(pii.find_pii(docs, pii.fit_corpus(docs)))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy costs, from the ledger of all ``documents``."""
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_html_extract, op3_url_filter, op4_simhash, op5_warc, op6_line_templates,
        op7_toxicity, op8_soft_mixing, op9_decontaminate, op10_quality_ledger, op11_importance_resampling,
        op12_lexical_search, op13_pii, quality_ablations,
    )
}
