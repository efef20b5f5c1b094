"""The n-gram join on rows whose ids are null or repeated, against brute force on row numbers."""

import random
from collections import Counter

import brute
import pytest

from postmill.llm import ngram_join


def near(draw, base: str, changes: int = 1) -> str:
    words = base.split()
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
    return " ".join(words)


def rows_without_ids():
    """Near and exact copies, with and without ids; groups without any id; rows that repeat an id."""
    draw = random.Random(9)
    rows = []
    for group in range(6):
        base = " ".join(f"g{group}w{k}" for k in range(90))
        ids = [None] * 6 if group < 2 else [None, None, None, 10 * group, 10 * group + 1, 10 * group]
        rows += [(i, near(draw, base, draw.choice([0, 0, 1])), "a") for i in ids]
    rows += [(None, brute.SAME, "a"), (None, None, "a"), (None, "", "b"), (7, "", "b"), (7, None, "b")]
    rows += [(20, f"a text of {20} that nothing else is like", "a"), (20, "another text, also with that id", "b")]
    draw.shuffle(rows)
    return rows


def expected(rows, width, percent):
    """(size, row numbers of the component) per row number."""
    found = brute.jaccard([(k, t) for k, (_, t, _) in enumerate(rows)], width, percent)
    members = {}
    for k, (_, low) in found.items():
        members.setdefault(low, []).append(k)
    return found, members


@pytest.mark.parametrize(("width", "percent", "held"), [(3, 80, 100_000), (5, 60, 1)])
def test_near_copies_without_ids(spark, monkeypatch, width, percent, held):
    monkeypatch.setattr(ngram_join, "HELD", held)
    rows = rows_without_ids()
    found, members = expected(rows, width, percent)
    want = Counter()
    for k, (n, low) in found.items():
        ids = [rows[m][0] for m in members[low] if rows[m][0] is not None]
        want[rows[k][0], n, min(ids, default=None)] += 1
    docs = spark.createDataFrame(rows, brute.SCHEMA).repartition(3)
    got = Counter(tuple(r) for r in ngram_join.components(docs, width, percent).collect())
    assert got == want


def test_keep_first_keeps_one_row_of_each_component(spark):
    rows = rows_without_ids()
    found, members = expected(rows, 3, 80)
    docs = brute.frame(spark, rows)
    out = ngram_join.keep_first(docs, 3, 80)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert sum(got.values()) == len(members)
    assert not got - Counter((i, t) for i, t, _ in rows)
    of = {rows[k][1] or "": low for k, (n, low) in found.items() if n}
    assert Counter(of[t] for _, t in got.elements() if t) == Counter(low for low in members if found[low][0])
    for i, t in got.elements():
        if t:
            assert i == min((rows[m][0] for m in members[of[t]] if rows[m][0] is not None), default=None)
