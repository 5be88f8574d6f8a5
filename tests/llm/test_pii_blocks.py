"""Texts with more matches than a block of them."""

from pyspark.sql import functions as F

from kinelake.llm import pii


def test_places_and_context_across_blocks(spark):
    n = [pii.BLOCK - 1, pii.BLOCK, pii.BLOCK + 1, 3 * pii.BLOCK]
    docs = spark.createDataFrame([(i, "ü " + "a@b.c " * k + "mail " + "d@e.f") for i, k in enumerate(n)], "doc_id long, text string")
    got = {r.doc_id: r.pii_spans for r in pii.find_pii(docs).select("doc_id", F.col("pii_spans")).collect()}
    for i, k in enumerate(n):
        want = [(2 + 6 * j, 7 + 6 * j) for j in range(k)] + [(7 + 6 * k, 12 + 6 * k)]
        assert [(s.start, s.end) for s in got[i]] == want
        assert [s.score for s in got[i]] == [80] * k + [95]
