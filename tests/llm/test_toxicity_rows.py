"""What the fit takes is bounded in rows, also if one id holds many of them."""

import numpy as np
from pyspark.sql import functions as F

from usagelens.llm import toxicity


def test_sample_is_bounded_in_rows(spark):
    one = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 500).alias("text"))
    many = spark.range(100, 130).select(F.col("id").alias("doc_id"), F.concat(F.lit("fool "), F.col("id")).alias("text"))
    docs = one.unionByName(many)
    labels = docs.select("doc_id", (F.col("doc_id") > 50).cast("int").alias("toxic")).distinct()
    assert toxicity.sample(docs, labels, rows=100).count() == 100
    every = toxicity.sample(docs, labels, rows=600).collect()
    assert len(every) == 530 and sum(r["times"] for r in every) == 3030


def test_times_are_repeated_rows():
    texts, labels, times = [b"a fine day for all", b"you fool you", b"another calm text"], np.array([0.0, 1.0, 0.0]), np.array([3, 2, 1])
    a = toxicity.fit_rows(texts, labels, times=times.astype(float))
    b = toxicity.fit_rows([t for t, n in zip(texts, times, strict=True) for _ in range(n)], np.repeat(labels, times))
    assert np.allclose(toxicity.score_texts(texts, a), toxicity.score_texts(texts, b), atol=1e-3)
