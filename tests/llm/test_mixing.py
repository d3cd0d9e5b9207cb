"""Mixing on the smallest table that has labels: alive, on its targets, and no way back for toxic text."""

from pyspark.sql import functions as F

from marginalia.llm import mixing, queries

SF = "/root/testdata/sf0.01"


def test_rates_reach_their_targets_on_a_small_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = mixing.mix(docs, queries.domain_labels(labels), queries.TARGETS).cache()
    rows = found.collect()
    assert len(rows) == docs.count() and len({round(r.rate, 6) for r in rows}) > 50 and len({r.domain for r in rows}) == 3
    total = sum(r.n_tokens for r in rows)
    for domain, share in queries.TARGETS.items():
        reached = sum(r.n_tokens * r.rate * r.posterior[domain] for r in rows) / total
        assert abs(reached - share) < 1e-3, (domain, reached)
    query = {r.doc_id: r.rate for r in queries.op8_soft_mixing(spark, SF).collect()}
    assert query == {r.doc_id: round(r.rate, 6) for r in rows}


def test_pipeline_does_not_multiply_toxic_text(spark):
    """What the classifier missed is toxic by its labels; the last stage must not read it more often than the rest."""
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert "toxic" not in corpus_pipeline.TARGETS
    mixed = corpus_pipeline.mix_to_targets(spark, docs, SF)
    toxic = labels.where("toxic = 1").select("doc_id", F.lit(True).alias("toxic"))
    rows = mixed.join(toxic, "doc_id", "left").collect()
    mean = lambda rs: sum(r.rate for r in rs) / len(rs)
    bad, rest = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert len(rows) == docs.count() and len(bad) > 10
    assert {r.domain for r in rows} <= {"good", "poor"}
    assert mean(bad) <= 1.5 * mean(rest) and max(r.copies for r in bad) <= max(r.copies for r in rest)
