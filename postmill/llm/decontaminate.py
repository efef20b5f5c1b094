"""Benchmark decontamination with an Aho-Corasick automaton over normalised words.

A benchmark item's windows are its runs of `width` consecutive words; a shorter
item is one window. The automaton's symbols are word numbers, so a document is
one sequence of numbers, scanned once, and a match ends at a word. Word numbers
lead back to the character offsets of the original text.

The benchmark is read in blocks of at most `BLOCK_WORDS` words, as its size is
not known in advance: each block has its own automaton, and all documents are
scanned against each. Only a block is ever in memory; documents are never
shuffled.

Defined results: null or empty text has no words and no hits; an item without
words, or without id, is left out; items that repeat an id count once; items
with equal windows are all reported; an empty benchmark hits nothing; other
columns are kept, whatever their names, except the struct `contamination`.
"""

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.text import as_before, beside_text, in_row, plain_words, slices

#: A word of a text as it is, A-Z included, which `plain_words` lower-cases.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Words of benchmark text in one automaton; about 13 nodes of it a word.
BLOCK_WORDS = 100_000
FOUND = "n_words bigint, n_hit bigint, items array<bigint>, spans array<struct<start:bigint,end:bigint>>"


class Windows:
    """Automaton over the windows of some items: [(item_id, text)]."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            found = plain_words(text)
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in found)
            for k in range(max(len(ids) - width, 0) + 1 if ids else 0):
                owners.setdefault(ids[k : k + width], set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, of in owners.items():
            self.automaton.add_word(window, (len(window), sorted(of)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], list[int]]:
        """Merged runs of hit words (first, past the last), and the items hit."""
        if self.empty:
            return [], []
        number = self.numbers.get
        runs: list[list[int]] = []
        items: set[int] = set()
        for last, (length, of) in self.automaton.iter(tuple([number(w, 0) for w in found])):
            items.update(of)
            start, end = last - length + 1, last + 1
            while runs and runs[-1][1] >= start:  # ends never fall, but a longer window may start earlier
                start = min(start, runs.pop()[0])
            runs.append([start, end])
        return [(a, b) for a, b in runs], sorted(items)


def _blocks(items: DataFrame, most_words: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks, drawn partition by partition."""
    block, held = [], 0
    for row in items.toLocalIterator():
        size = len(plain_words(row["text"]))
        if block and held + size > most_words:
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += size
    yield block


def _offsets(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Character offsets of word runs in the text."""
    if not runs:
        return []
    at = np.array([m.span() for m in WORD.finditer(text)])
    return [{"start": int(at[a][0]), "end": int(at[b - 1][1])} for a, b in runs]


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted([*a, *b]):
        if merged and merged[-1][1] >= start:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` with the struct `contamination`: n_words, n_hit, items (ids), spans (character offsets)."""
    return as_before(_scanned(beside_text(docs, "contamination"), benchmark, width, block_words), docs, "contamination")


def _scanned(rows: DataFrame, benchmark: DataFrame, width: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`rows` (row, text) with the struct `contamination`."""
    items = benchmark.select(F.col("item_id").cast("bigint"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    runs_type = "array<struct<start:bigint,end:bigint>>"
    empty = F.struct(
        F.array().cast(runs_type).alias("runs"), F.array().cast("array<bigint>").alias("items")
    )
    scanned = rows.withColumn("contamination", empty)
    blocks = list(_block_files(items, block_words))
    for position, block in enumerate(blocks):
        scanned = _scan_block(scanned, block, width, last=position == len(blocks) - 1)
    return scanned


def _block_files(items: DataFrame, block_words: int):
    spark = items.sparkSession
    for block in _blocks(items, block_words):
        yield spark.sparkContext.broadcast(block)


def _scan_block(docs: DataFrame, block, width: int, last: bool) -> DataFrame:
    partial = T.StructType.fromDDL("runs array<struct<start:bigint,end:bigint>>, items array<bigint>")
    out = T.StructType(
        [f for f in docs.schema.fields if f.name != "contamination"]
        + [T.StructField("contamination", T.StructType.fromDDL(FOUND) if last else partial)]
    )
    where = docs.columns.index("text")
    arrow = _arrow(out.fields[-1].dataType)

    def scan_batches(batches):
        windows = Windows(block.value, width)
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                before = batch.column(batch.num_columns - 1).to_pylist()
                for text, old in zip(batch.column(where).to_pylist(), before, strict=True):
                    found = plain_words(text)
                    runs, items = windows.scan(found)
                    runs = _union(runs, [(r["start"], r["end"]) for r in old["runs"]])
                    items = sorted({*items, *old["items"]})
                    if last:
                        hit = sum(b - a for a, b in runs)
                        rows.append({"n_words": len(found), "n_hit": hit, "items": items, "spans": _offsets(text, runs)})
                    else:
                        rows.append({"runs": [{"start": a, "end": b} for a, b in runs], "items": items})
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(rows, arrow)], names=batch.schema.names
                )

    return docs.mapInArrow(scan_batches, out)


def _arrow(kind: T.DataType):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def is_contaminated(found) -> "F.Column":
    """A twentieth of the words, or more, are hit."""
    return (found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])


def items_digest(items) -> "F.Column":
    """SHA-256 of the ids, sorted as strings, joined by commas."""
    return F.sha2(F.array_join(F.sort_array(F.transform(items, lambda i: i.cast("string"))), ","), 256)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """The rows of `docs` that aren't contaminated."""
    rows = docs.select(in_row(docs), F.col("text").cast("string").alias("text"))
    return _scanned(rows, benchmark, width).where(~is_contaminated(F.col("contamination"))).select("row.*")
