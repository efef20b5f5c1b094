"""Candidates for personal data in texts without digits."""

import brute
from pyspark.sql import functions as F

from postmill.llm import pii


def test_secrets_need_no_digit(spark):
    words = ["token = sk_abcdefghijklmnop", "PassWord:abcdefghij", "api-key='abcdefghijkl'", "secret=abcdefgh", "a token of thanks"]
    rows = [(2 * k + d, w + d * " page 7", "a") for k, w in enumerate(words) for d in (0, 1)]
    found = pii.find(spark.createDataFrame(rows, brute.SCHEMA))
    got = {r["doc_id"]: r["k"] for r in found.select("doc_id", F.col("__loose.kind").alias("k")).collect()}
    for k in range(len(words)):
        assert got[2 * k] == got[2 * k + 1] == (["secret"] if k < 4 else []), words[k]
