"""Text pieces that several operators share."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space: space and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes -> bytes: A-Z in lower case; ASCII that is neither letter nor digit as a blank.
WORD_BYTES = bytes(
    c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower()
)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the maximal runs without ASCII white space; null has none."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, r"[\x20\x09-\x0D]+", -1)
    )


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20):
    """Cut a batch so that a slice's texts have at most `most_bytes` (or are one row)."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def quoted(name: str) -> Column:
    """The column with exactly this name, dots and back-quotes included."""
    return F.col(f"`{name.replace('`', '``')}`")


def in_row(docs: DataFrame, *left_out: str) -> Column:
    """Struct `row` of all other columns: inside it no name can clash with those that an operator adds."""
    return F.struct(*[quoted(c) for c in docs.columns if c.lower() not in left_out]).alias("row")


def beside_text(docs: DataFrame, left_out: str) -> DataFrame:
    """`row` (all columns but `text` and `left_out`) and `text`, for Python workers."""
    return docs.select(in_row(docs, "text", left_out), F.col("text").cast("string").alias("text"))


def as_before(found: DataFrame, docs: DataFrame, added: str) -> DataFrame:
    """The columns of `docs` in their order, from `row` and `text`, and `added`."""
    names = [c for c in docs.columns if c.lower() != added]
    return found.select(*[F.col("text").alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in names], added)


def documents(docs: DataFrame) -> DataFrame:
    """The two columns that the digest queries need."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
