"""The pipeline on sample documents against plain Python, stage by stage."""

import brute
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from postmill.llm import oracles, queries
from postmill.session import materialize


def test_pipeline(spark, sf_dir):
    import sentencepiece

    names = [name for name, _ in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        got = docs.collect()
        if name == "quality_rules":
            measured = {i: brute.measures(t) for i, t in rows}
            rows = [(i, t) for i, t in rows if measured[i][0] >= 50 and 100 * measured[i][4] <= 50 * measured[i][0]]
        elif name == "repeated_lines":
            counted = brute.line_dedup(rows)
            assert {r["doc_id"]: brute.sha(r["text"] or "") for r in got} == {i: x[2] for i, x in counted.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in got)
            rows = [(r["doc_id"], r["text"]) for r in got]
        elif name == "near_duplicates":
            component = brute.jaccard(rows, 5, 80)
            rows = [(i, t) for i, t in rows if component[i][1] == i]
        elif name == "contaminated":
            judged = brute.contamination(rows, items)
            rows = [(i, t) for i, t in rows if not judged[i][4]]
        assert {r["doc_id"] for r in got} == {i for i, _ in rows}, name
        if name != names[-1]:
            assert docs.columns == columns
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = dict(rows)
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(text[r["doc_id"]]) and r["round_trip"]
    assert len(got) > 100


def test_every_operator_is_registered():
    numbers = {int(name[2:].split("_")[0]) for name in queries.QUERIES if name.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in queries.QUERIES
    assert oracles.ORACLES.keys() <= queries.QUERIES.keys()


def stages(spark, docs, sf_dir):
    """The rows after each stage."""
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        yield name, docs


def test_pipeline_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, left in stages(spark, docs, sf_dir):
        assert left.collect() == []


def test_pipeline_with_nulls_repeated_ids_and_further_columns(spark, sf_dir):
    words = [" ".join(f"{stem}{k}" for k in range(70)) for stem in ("ab", "cd", "ef", "gh")]
    rows = [
        (1, words[0], None, "s", None, "p"), (2, words[0] + " end", "en", "s", 5, "q"),  # near copies
        (None, words[1], "en", None, 5, "r"), (None, None, None, None, None, None),
        (3, words[2], "en", "s", 5, "t"), (3, words[2], "en", "s", 5, "t"), (3, words[3], "en", "s", 5, "u"),
        (4, "", "en", "s", 0, "v"), (5, "too short", "en", "s", 9, "w"), (6, "x " * 200_000, "en", "s", 9, "y"),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` string"
    docs = spark.createDataFrame(rows, schema).withColumn("row", F.lit(1)).withColumn("gone", F.col("`a.b`"))
    columns = docs.columns
    for name, left in stages(spark, docs, sf_dir):
        if name == "contaminated":
            assert left.columns == columns
            got = sorted((r["doc_id"] or 0, r["text"], r["a.b"], r["gone"], r["n_chars"]) for r in left.collect())
            assert got == sorted([
                (1, words[0], "p", "p", len(words[0])), (0, words[1], "r", "r", len(words[1])),
                (3, words[2], "t", "t", len(words[2])), (3, words[3], "u", "u", len(words[3])),
            ])
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 3, 3] and all(r["round_trip"] for r in left.collect())
