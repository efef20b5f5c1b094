"""One query per operator, over whole tables: (spark, sf_dir) -> DataFrame."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from postmill.llm import (
    conversation_trie, decontaminate, hard_negatives, licenses, line_dedup, ngram_join, pii, quality, secrets, sentencepieces,
    token_counts, token_store, warc,
)
from postmill.llm.text import documents
from postmill.session import new_folder

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op1_token_store(spark, sf_dir):
    folder = new_folder(spark, "tokens")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_store.write_tokens(documents(read(spark, sf_dir, "documents")), vocabulary, 2, folder)
    return token_store.with_crc(token_store.read_tokens(spark, folder, manifest))


@query
def op2_sentencepiece(spark, sf_dir):
    docs = documents(read(spark, sf_dir, "documents"))
    found = sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "doc_id", "pieces.n_pieces", F.crc32("pieces.ids").alias("ids_crc32"),
        F.sha2("pieces.decoded", 256).alias("decoded_sha256"),
        (F.col("pieces.decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


@query
def op3_line_dedup(spark, sf_dir):
    docs = line_dedup.drop_repeated_lines(documents(read(spark, sf_dir, "documents")))
    return docs.select(
        "doc_id", "line_dedup.n_lines", "line_dedup.n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query
def op4_token_counts(spark, sf_dir):
    docs = documents(read(spark, sf_dir, "documents"))
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "token_counts.*")


@query
def op5_ngram_join(spark, sf_dir):
    return ngram_join.components(documents(read(spark, sf_dir, "documents")), width=3, percent=90)


@query
def op6_warc(spark, sf_dir):
    manifest = warc.write_warc(read(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return warc.read_warc(spark, manifest, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound"
    )


@query
def op7_quality_rules(spark, sf_dir):
    return quality.judge(read(spark, sf_dir, "documents")).select(
        "doc_id", *quality.MEASURES, "base_failed", "kept"
    )


@query
def op8_personal_data(spark, sf_dir):
    found = F.col("pii")
    return pii.detect(documents(read(spark, sf_dir, "documents"))).select(
        "doc_id", *[F.size(found["base"][k]).cast("bigint").alias(f"n_{k}") for k in pii.PATTERNS],
        F.sha2(pii.spelled(found["base_spans"]), 256).alias("base_sha256"), pii.spelled(found["spans"]).alias("spans"),
    )


@query
def op9_decontamination(spark, sf_dir):
    docs = documents(read(spark, sf_dir, "documents"))
    found = decontaminate.scan(docs, read(spark, sf_dir, "benchmark")).select("doc_id", "contamination")
    hit = F.col("contamination")
    return found.select(
        "doc_id", hit["n_words"].alias("n_words"), hit["n_hit"].alias("n_hit"),
        F.size(hit["items"]).cast("bigint").alias("n_items"),
        decontaminate.items_digest(hit["items"]).alias("items_sha256"),
        decontaminate.is_contaminated(hit).alias("contaminated"),
    )


@query
def op10_license_scan(spark, sf_dir):
    found = F.col("licenses")
    return licenses.scan(documents(read(spark, sf_dir, "documents"))).select(
        "doc_id", *[found[c].alias(c) for c in ("n_words", "n_base", "first_word", "last_word")],
        *[F.array_join(found[c], ",").alias(c) for c in ("base_labels", "labels")], found["score"].alias("score"),
    )


@query
def op11_conversation_trie(spark, sf_dir):
    turns = conversation_trie.ordered(read(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(*conversation_trie.share_heads(turns)).drop("d1", "d2")


@query
def op12_hard_negatives(spark, sf_dir):
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine(hard_negatives.integers(vectors), F.col("vec_id") % 100 == 0)


@query
def op13_secret_scan(spark, sf_dir):
    found = secrets.scan(documents(read(spark, sf_dir, "documents")))
    base, every = F.col("secrets.base"), F.col("secrets.spans")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.spelled(base), 256).alias("base_sha256"), secrets.spelled(every).alias("spans"),
    )


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
