"""Operators against plain Python on a fixture with nulls, empty, long, repeated and clashing rows."""

import random
import re
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from postmill.llm import (
    decontaminate, licenses, line_dedup, ngram_join, pii, quality, sentencepieces, token_counts, token_store,
)

BPE, PIECES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def docs(spark):
    return brute.frame(spark)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def texts():
    return {i: t or "" for i, t, _ in brute.ROWS}


def test_quality(docs, empty):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert got.keys() == texts().keys()
    for i, r in got.items():
        m = brute.measures(texts()[i])
        assert tuple(r[c] for c in quality.MEASURES) == m, i
        assert r["base_failed"] == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert not (r["kept"] and r["base_failed"])
    assert quality.judge(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_texts_are_measured_once(docs, monkeypatch):
    kept = sorted(r["doc_id"] for r in quality.judge(docs).where("kept").collect())
    calls, measures = [], quality.measures
    monkeypatch.setattr(quality, "measures", lambda text: calls.append(text) or measures(text))
    assert sorted(r["doc_id"] for r in quality.keep_good(docs).collect()) == kept
    assert len(calls) == 1


def test_hosts_are_shrunk_and_rejected(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(k, good, f"host{k % 20}") for k in range(400)]
    rows += [(1000 + k, "bad", "spam") for k in range(60)] + [(2000, good, "spam")]
    rows += [(3000, "bad", "young")] + [(4000 + k, good, None) for k in range(30)] + [(5000, "bad", None)]
    kept = {r["doc_id"] for r in quality.keep_good(spark.createDataFrame(rows, brute.SCHEMA)).collect()}
    assert 2000 not in kept  # its host fails
    assert kept == set(range(400)) | set(range(4000, 4030))
    young = spark.createDataFrame([*rows, (3001, good, "young")], brute.SCHEMA)
    assert 3001 in {r["doc_id"] for r in quality.keep_good(young).collect()}  # one failure of two isn't enough


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_line_dedup(docs, batches):
    out = line_dedup.drop_repeated_lines(docs, least_chars=10, least_docs=3, batches=batches, fan_in=2)
    assert out.columns == [*docs.columns, "line_dedup"]
    got = {
        r["doc_id"]: (r["line_dedup"]["n_lines"], r["line_dedup"]["n_dropped"], brute.sha(r["text"] or "")) for r in out.collect()
    }
    assert got == brute.line_dedup(brute.ROWS, 10, 3)
    assert sum(x[1] for x in got.values()) > 3


def test_line_dedup_without_ids_and_with_repeated_rows(spark, empty):
    rows = [(1, brute.SAME, "a"), (1, brute.SAME, "a"), (None, brute.SAME, "a"), (2, brute.SAME, "a")]
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, brute.SCHEMA), 10, 2).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out) == [(0, brute.SAME), (1, ""), (1, ""), (2, brute.SAME)]
    assert line_dedup.drop_repeated_lines(empty).count() == 0


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_ngram_join(docs, empty, width, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components(docs, width, percent).collect()}
    assert got == brute.jaccard(brute.ROWS, width, percent)
    assert ngram_join.components(empty, width, percent).count() == 0


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_of_many_near_copies(spark, monkeypatch, width, percent):
    """Groups around the threshold, of several sizes, dealt into many small tiles."""
    monkeypatch.setattr(ngram_join, "ONE_TILE", 8)
    monkeypatch.setattr(ngram_join, "TILE", 8)
    draw = random.Random(5)
    rows = []
    for group in range(6):
        base = [f"g{group}w{k}" for k in range(draw.choice([12, 20, 45, 90, 200]))]
        for _ in range(40):
            words = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 30))):
                at = draw.randrange(len(words))
                action = draw.random()
                if action < 0.5:
                    words[at] = f"e{draw.randrange(10**6)}"
                elif action < 0.75 and len(words) > 1:
                    del words[at]
                else:
                    words.insert(at, f"i{draw.randrange(10**6)}")
            rows.append((len(rows), " ".join(words), "a"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components(spark.createDataFrame(rows, brute.SCHEMA), width, percent).collect()}
    assert got == brute.jaccard(rows, width, percent)
    assert len({c for _, c in got.values()}) > 6


def test_linked_sets_share_a_signature():
    draw = np.random.default_rng(3)
    for percent in (80, 90, 95):
        for size in (5, 9, 10, 18, 19, 20, 37, 150, 400, 900):
            sizes = range(size * percent // 100, size * 100 // percent + 1)
            a = np.unique(draw.integers(0, 2**63, size).astype(np.uint64))
            for other in sizes if len(sizes) < 60 else sizes[::9]:
                both = -(-percent * (size + other) // (100 + percent))
                if both > min(size, other) or other == 0:
                    continue
                b = np.unique(np.append(draw.permutation(a)[:both], draw.integers(0, 2**63, other - both).astype(np.uint64)))
                la, lb = (ngram_join.level_of(len(x), percent) for x in (a, b))
                assert abs(la - lb) <= 1
                sa, sb = (set(ngram_join.both_signatures(ngram_join.Mixed(x), lv, percent).tolist()) for x, lv in ((a, la), (b, lb)))
                assert sa & sb or set(a) == set(b), (percent, size, other)


def test_pii(docs, empty):
    got = {r["doc_id"]: r["pii"] for r in pii.detect(docs).collect()}
    for i, found in got.items():
        want = brute.pii(texts()[i])
        assert [(s["kind"], s["start"], s["end"]) for s in found["base_spans"]] == want, i
        assert {k: len(found["base"][k]) for k in pii.PATTERNS} == {k: sum(x[0] == k for x in want) for k in pii.PATTERNS}
        assert [s for s in found["spans"] if s["kind"] in pii.PATTERNS] == found["base_spans"]
    assert pii.detect(empty).count() == 0


def test_pii_on_random_texts(spark):
    draw = random.Random(4)
    rows = [(k, "".join(draw.choice("0123456789.+-@ ab_c()é𝄞%") for _ in range(draw.randint(0, 60))), "a") for k in range(1500)]
    got = pii.detect(spark.createDataFrame(rows, brute.SCHEMA)).collect()
    assert {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["pii"]["base_spans"]] for r in got} == {
        i: brute.pii(t) for i, t, _ in rows
    }


def test_pii_adds_probable_spans_only(spark):
    draw = random.Random(6)
    hexes = ["".join(draw.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    rows = [(k, f'plain words here token = "{h}" and more', "a") for k, h in enumerate(hexes)]
    rows += [(100 + k, f"call ({draw.randint(201, 989)}) {draw.randint(201, 989)}-{draw.randint(1000, 9999)} now", "a") for k in range(60)]
    rows += [(200 + k, "see page 000-000-0000 of the table, password: something", "a") for k in range(60)]
    got = {r["doc_id"]: r["pii"]["spans"] for r in pii.detect(spark.createDataFrame(rows, brute.SCHEMA)).collect()}
    found = {i: [(s["kind"], rows_text(rows, i)[s["start"] : s["end"]]) for s in spans] for i, spans in got.items()}
    assert sum(("secret", h) in found[k] for k, h in enumerate(hexes)) >= 57
    assert sum(any(kind == "national" for kind, _ in found[100 + k]) for k in range(60)) >= 54
    assert not any(found[200 + k] for k in range(60))


def rows_text(rows, i):
    return next(t for k, t, _ in rows if k == i)


def test_reliabilities_prefer_the_labeler_that_agrees():
    counts = {("k", 1, 1, 1): 50, ("k", 1, 1, -1): 45, ("k", -1, -1, 1): 45, ("k", -1, -1, -1): 50}
    chance, tables = pii.reliabilities(counts)
    assert chance["k", 1, 1, -1] > 0.9 > 0.1 > chance["k", -1, -1, 1]
    assert tables[0][1, 1] > tables[2][1, 1]


@pytest.mark.parametrize("block_words", [3, 100_000])
def test_decontamination(spark, docs, empty, block_words):
    items = spark.createDataFrame(brute.ITEMS, brute.ITEM_SCHEMA)
    out = decontaminate.scan(docs, items, block_words=block_words)
    assert sorted(out.columns) == sorted(docs.columns)
    found = F.col("contamination")
    rows = out.select("doc_id", "text", found, decontaminate.items_digest(found["items"]).alias("d"), decontaminate.is_contaminated(found).alias("c"))
    got = {}
    for r in rows.collect():
        c = r["contamination"]
        got[r["doc_id"]] = (c["n_words"], c["n_hit"], len(c["items"]), r["d"], r["c"])
        assert sum(len(brute.plain_words(r["text"][s["start"] : s["end"]])) for s in c["spans"]) == c["n_hit"]
    assert got == brute.contamination(brute.ROWS, brute.ITEMS)
    assert any(x[4] for x in got.values())
    assert decontaminate.scan(docs, items.limit(0)).where("contamination.n_hit > 0").count() == 0
    assert decontaminate.scan(empty, items).count() == 0
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()}
    assert kept == {i for i, x in got.items() if not x[4]}


def test_licenses(docs, empty):
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs).collect()}
    for i, found in got.items():
        base = (found["n_words"], found["n_base"], found["first_word"], found["last_word"], ",".join(found["base_labels"]))
        assert base == brute.phrases(texts()[i]), i
        assert set(found["base_labels"]) <= set(found["labels"]) and 0 <= found["score"] <= 1
    assert got[17]["labels"] == ["apache", "apache-2.0", "gpl"]
    assert licenses.scan(empty).count() == 0


def test_license_rules():
    assert len(licenses.rules()) >= 200
    for text, label in {
        "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0",
        "CC BY-NC-SA 3.0": "cc-by-nc-sa-3.0",
        "the BSD 3-Clause license": "bsd-3-clause",
        "under the terms of the Mozilla Public License, v. 2.0": "mpl-2.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    }.items():
        assert label in licenses.scan_text(text)["labels"], text
    assert licenses.scan_text("a bsd machine, as is")["labels"] == []


def test_contained_detections_give_way():
    low, high = licenses.Rule("a", "", (), 0, 0.5), licenses.Rule("b", "", (), 3, 0.5)
    d = licenses.Detection
    kept = licenses.resolve([d(0, 5, high), d(1, 4, low), d(4, 9, low), d(4, 8, low), d(0, 5, low)])
    assert kept == [d(0, 5, high), d(4, 9, low)]


def test_token_counts(docs, empty):
    starts, continues = (set(x) for x in token_counts.pieces_of(PIECES))
    longest = max(map(len, starts | continues))

    def greedy(word):
        at = n = 0
        while at < len(word):
            known = continues if at else starts
            end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in known), None)
            if end is None:
                return 1, 1
            at, n = end, n + 1
        return n, 0

    got = {r["doc_id"]: r["token_counts"] for r in token_counts.count_tokens(docs, PIECES).collect()}
    for i, counts in got.items():
        each = [greedy(w) for w in brute.WORDS.findall(texts()[i])]
        assert tuple(counts) == (len(each), sum(n for n, _ in each), sum(u for _, u in each)), i
    assert token_counts.count_tokens(empty, PIECES).count() == 0


def test_sentencepiece(docs, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in sentencepieces.encode(docs, PIECES).collect():
        ids = np.frombuffer(r["pieces"]["ids"], "<u4").tolist()
        assert ids == library.encode(texts()[r["doc_id"]]), r["doc_id"]
        assert r["pieces"]["n_pieces"] == len(ids)
        assert r["pieces"]["decoded"] == texts()[r["doc_id"]].replace("▁", " ")
    assert sentencepieces.encode(empty, PIECES).count() == 0


def test_sentencepiece_on_random_texts():
    import pyarrow as pa
    import sentencepiece

    library, machine = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepieces.pieces(PIECES)
    draw = random.Random(7)
    some = ["".join(draw.choice("aabetnosABC  \né漢☃𝄞0123.,'-") for _ in range(draw.randint(0, 80))) for _ in range(3000)]
    some += [" " * n + "a" + " " * n + "\n" for n in range(40)]
    ids, counts = machine.encode(pa.array(some))
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == library.encode(some)
    assert machine.decode(ids, counts) == some


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    both = docs.unionByName(docs.where("doc_id = 6")).unionByName(docs.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("bigint")))
    manifest = token_store.write_tokens(both, BPE, 2, str(tmp_path / "tokens"), shard_tokens=3000)
    assert manifest.count() > 2
    rows = token_store.read_tokens(spark, str(tmp_path / "tokens"), manifest).orderBy("start").collect()
    ids = [r["doc_id"] for r in rows]
    assert ids == [None, *sorted([*texts(), 6])]
    start = 0
    for r in rows:
        want = np.array([*library.encode(texts().get(r["doc_id"], brute.SAME), add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"]) == (start, len(want)) and r["ids"] == want.tobytes(), r["doc_id"]
        start += len(want)
    crcs = token_store.with_crc(token_store.read_tokens(spark, str(tmp_path / "tokens"), manifest)).orderBy("start").collect()
    assert [r["ids_crc32"] for r in crcs] == [zlib.crc32(r["ids"]) for r in rows]
    assert sum(f.is_file() and "_tmp-" in f.name for f in (tmp_path / "tokens").iterdir()) == manifest.count()
    nothing = token_store.write_tokens(empty, BPE, 2, str(tmp_path / "none"))
    assert token_store.read_tokens(spark, str(tmp_path / "none"), nothing).count() == 0


def test_packing_is_exact():
    draw = np.random.default_rng(1)
    for counts in ([], [0, 0], [1, 0, 5, 4, 3], [7, 1000]):
        counts = np.array(counts, dtype=np.int64)
        ranks = draw.integers(0, 2 ** draw.integers(1, 33, counts.sum()), dtype=np.uint64).astype(np.uint32)
        control, data, sizes = token_store.pack(ranks, counts)
        assert sizes.sum() == len(data) and len(control) == (-(-counts // 4)).sum()
        assert token_store.unpack(control, data, counts).tolist() == ranks.tolist()


def test_words_are_coded_as_in_texts():
    draw = random.Random(2)
    coder = token_store.WordCoder(BPE)
    some = ["".join(draw.choice("aabetnos  \né漢☃𝄞0123.,'-’İÅΣς'sſ|)(") for _ in range(draw.randint(1, 40))) for _ in range(3000)]
    for _ in range(2):
        words = [re.split("[ \t\n\r\x0b\x0c]+", t) for t in some]
        ids, counts = coder.code([w for ws in words for w in ws])
        ends, at = np.cumsum(counts), np.cumsum([len(ws) for ws in words])
        got = [ids[(ends[a - len(ws)] - counts[a - len(ws)]) : ends[a - 1]].tolist() for a, ws in zip(at, words, strict=True)]
        assert got == [e.ids for e in coder.tokenizer.encode_batch(some, add_special_tokens=False)]
