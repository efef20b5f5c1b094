"""Other columns pass through the operators, whatever they are called."""

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from postmill.llm import decontaminate, licenses, line_dedup, ngram_join, pii, quality, secrets, sentencepieces, token_counts

NAMES = [
    "a.b", "x`y", "row", "key", "id", "gone", "kept", "__gone", "__id", "__kept", "__base", "__loose", "Contamination", "Pieces",
    "Token_Counts", "Licenses", "Line_Dedup", "PII", "host", "m", "rep", "h1", "n", "bad", "out",
]
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def wide(spark):
    fine = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([*brute.ROWS, (100001, fine, "z"), (100002, fine + " more", "z")], brute.SCHEMA)
    return docs.select("*", *[F.concat(F.lit(f"{name}:"), F.col("doc_id").cast("string")).alias(name) for name in NAMES])


def operators(spark):
    items = spark.createDataFrame(brute.ITEMS, brute.ITEM_SCHEMA)
    return {
        "pieces": lambda docs: sentencepieces.encode(docs, MODEL),
        "line_dedup": lambda docs: line_dedup.drop_repeated_lines(docs, 10, 3),
        "token_counts": lambda docs: token_counts.count_tokens(docs, MODEL),
        "pii": pii.detect,
        "contamination": lambda docs: decontaminate.scan(docs, items),
        "licenses": licenses.scan,
        "secrets": secrets.scan,
        "keep_first": ngram_join.keep_first,
        "keep_good": quality.keep_good,
        "drop_contaminated": lambda docs: decontaminate.drop_contaminated(docs, items),
    }


@pytest.mark.parametrize("name", [
    "pieces", "line_dedup", "token_counts", "pii", "contamination", "licenses", "secrets", "keep_first", "keep_good",
    "drop_contaminated",
])
def test_columns_are_kept(spark, wide, name):
    out = operators(spark)[name](wide)
    own = {name}
    want = [c for c in wide.columns if c.lower() not in own and not (name == "pii" and c == "text")]
    assert [c for c in out.columns if c not in own] == want
    rows = out.collect()
    assert rows
    for r in rows:
        for c in NAMES:
            if c.lower() not in own and r["doc_id"] is not None:
                assert r[c] == f"{c}:{r['doc_id']}"
