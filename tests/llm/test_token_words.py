"""Whole texts must get the library's ids, however their words are cut, cased and remembered."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import types as T
from tokenizers import Tokenizer

from postmill.llm import token_store

BPE = public_tokenizers.path("word_bpe_49k.json")
KINDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
ODD = [
    "क़. क़, क़;", "İ. İ. i̇, AÅ. Å! é. é,", "ſ. K. Å. ŉ. ß. ẞ.", "it's. IT'S, don't? x'. 's. 'S!",
    "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext|>. End.", "A.B. a..b ...c d... e.\n f,\t g!", ".", "a.", "#a# b#*$%& &c 1. 2), (x) [y]}",
    "", "  \n ", "THE the The. THE. tHe,",
]


def test_texts_have_the_ids_of_the_library(spark, monkeypatch):
    monkeypatch.setattr(token_store, "KNOWN_UNITS", 50)
    library = Tokenizer.from_file(BPE)
    draw = random.Random(5)
    texts = ODD + ["".join(draw.choice("aBéЖ漢 \n.,#)'’1<|>İ́") for _ in range(draw.randint(0, 60))) for _ in range(800)]
    table = spark.createDataFrame(list(enumerate(texts)), KINDS).repartition(4)
    rows = {r.doc_id: r for r in token_store.encode(table, BPE, 2).collect()}
    for k, text in enumerate(texts):
        want = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert np.frombuffer(rows[k]["ids"], "<u4").tolist() == want, repr(text)
        assert rows[k].n_tokens == len(want)
