"""Readers of landed payloads. Each takes raw rows with a document number
`doc_ord`, unique within its kind, and gives POSTING rows.

`seq` orders postings by kind, then document, then position. It packs the three
into one long: 3 bits, 36 bits, 24 bits. A number that does not fit fails the
read; it never repeats another `seq`.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds in the order of their postings; boards come last.
RANKS = {kind: rank for rank, kind in enumerate(("adzuna", "markdown", "html", "greenhouse", "lever"))}
DOC_BITS, POSITION_BITS = 36, 24


def _fits(value: Column, bits: int, name: str) -> Column:
    inside = value.cast("bigint").between(0, (1 << bits) - 1)
    message = F.concat(F.lit(f"{name} does not fit {bits} bits: "), F.coalesce(value.cast("string"), F.lit("null")))
    return F.when(inside, value.cast("bigint")).otherwise(F.raise_error(message).cast("bigint"))


def seq(kind: str, doc_ord: Column, position: Column) -> Column:
    packed = (
        F.shiftleft(F.lit(RANKS[kind]).cast("bigint"), DOC_BITS + POSITION_BITS)
        + F.shiftleft(_fits(doc_ord, DOC_BITS, "doc_ord"), POSITION_BITS)
        + _fits(position, POSITION_BITS, "position")
    )
    return packed.alias("seq")
