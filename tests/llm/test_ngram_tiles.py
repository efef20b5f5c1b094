"""Members of a component of the n-gram join go to few tiles, in few rounds."""

import random

import brute
import numpy as np
from pyspark.sql import functions as F

from postmill.llm import ngram_join

MEMBERS = "comp bigint, node bigint, label bigint, level int, n_shingles bigint, own binary, next binary, refused array<bigint>"


def test_members_go_to_few_tiles(spark):
    """3,000 sets of nine sizes, each a piece of its own: two tiles, so each goes to two pairs of tiles."""
    rows = [(1, k, k, 10 + k % 9, 100, b"", b"", None) for k in range(3000)]
    got = ngram_join.tiles(spark.createDataFrame(rows, MEMBERS))
    copies = got.groupBy("node").agg(F.count("*").alias("n")).agg(F.min("n"), F.max("n"), F.count("*")).first()
    assert tuple(copies) == (2, 2, 3000)
    # Any two members meet in exactly one pair of tiles.
    tile = got.select(F.struct("cross", "low", "i", "high", "j").alias("t"), "node", "side").where("node < 40").collect()
    met = {}
    for x in tile:
        for y in tile:
            if x["t"] == y["t"] and x["node"] < y["node"] and (x["side"] != y["side"] or x["side"] == 2):
                met[x["node"], y["node"]] = met.get((x["node"], y["node"]), 0) + 1
    assert met == {(a, b): 1 for a in range(40) for b in range(a + 1, 40)}


def test_rounds_end_when_no_guess_is_open(spark, monkeypatch):
    """All linked: one round, as every guess was right. Before, a second one looked for pairs that are left."""
    rounds, tiles = [], ngram_join.tiles
    monkeypatch.setattr(ngram_join, "tiles", lambda members: rounds.append(members.count()) or tiles(members))
    draw, rows = random.Random(3), []
    base = [f"w{k}" for k in range(200)]
    for k in range(60):
        words = list(base)
        words[draw.randrange(len(words))] = f"e{k}"
        rows.append((k, " ".join(words), "a"))
    # A piece whose nearest set is no link, beside it.
    rows += [(100 + k, " ".join([*base[:150], *[f"x{k}y{j}" for j in range(40)]]), "b") for k in range(4)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components(spark.createDataFrame(rows, brute.SCHEMA), 3, 90).collect()}
    assert got == brute.jaccard(rows, 3, 90)
    assert len(rounds) <= 1


def test_wrong_guesses_are_dealt_again(spark, monkeypatch):
    """With bitmaps of few bits, all pairs pass: what a task took for one piece is told apart by later rounds."""
    rounds, tiles = [], ngram_join.tiles
    monkeypatch.setattr(ngram_join, "tiles", lambda members: rounds.append(members.count()) or tiles(members))
    monkeypatch.setattr(ngram_join, "bitmap", lambda of, level, percent: np.zeros(32, dtype=np.uint8).tobytes())
    monkeypatch.setattr(ngram_join, "MORE", 2)
    draw, rows = random.Random(4), []
    base = [f"w{k}" for k in range(60)]
    for k in range(40):
        words = list(base)
        for _ in range(draw.randint(1, 3)):
            words[draw.randrange(len(words))] = f"e{draw.randrange(9)}"
        rows.append((k, " ".join(words), "a"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components(spark.createDataFrame(rows, brute.SCHEMA), 3, 90).collect()}
    assert got == brute.jaccard(rows, 3, 90)
    assert len(rounds) > 1
