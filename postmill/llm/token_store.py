"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank by frequency in the corpus, the most frequent
being 0, so that most take one byte. A rank takes 1 to 4 bytes, little-endian;
two bits a rank say how many, four ranks to a control byte. Control bytes and
data bytes lie apart, and both are decoded by numpy table lookup.

A file is a run of blocks; a block is a header of four little-endian int64
(documents, ranks, control bytes, data bytes), then per document its id, whether
it has one, and its number of ranks, then the control bytes, then the data. Each
document starts a new control byte. The folder holds `ranks.u32` (rank -> id),
the files, and the manifest table that names them.

Steps: tokenize into a table of fixed-width ids, count ids, deal out ranges of
doc_id of about equal token counts, sort each, write one file a range. Only
ranked, coded ids are shuffled. To the driver come counts per id (bounded by
the vocabulary), histograms, and one row per file.

Defined results: null text is empty; rows without id come first; rows that
repeat an id are all written, next to each other, in the order of their ids; an
empty table gives no file and no rows; other columns are ignored.
"""

import os
import posixpath
from functools import lru_cache
from itertools import islice
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.files import filesystem, one_task_each, range_bounds, shard_numbers, temporary_name
from postmill.llm.text import slices
from postmill.session import materialize, new_folder

#: Length of each of the four ranks of a control byte.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.int64)
#: What of four bytes belongs to a rank of a length.
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)
#: Runs of these at a word's end are a unit of their own.
PUNCTUATION = ".,;:!?|)]}#*$%&"
#: Such runs after letters that stay letters in lower case and when composed: cut off by a blank.
WORD_END = r"([A-Za-zß-öø-ÿ])([.,;:!?|)\]}#*$%&]+)([\x20\x09-\x0D]|$)"
#: Units a worker remembers, from task to task, before it forgets them all; some 200 bytes each.
KNOWN_UNITS = 250_000
MANIFEST = "shard int, path string, n_docs bigint, n_tokens bigint, n_bytes bigint"


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, data bytes, and data bytes per document, of documents with `counts` ranks."""
    size = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    quads = -(-counts // 4)
    codes = np.zeros(int(quads.sum()) * 4, dtype=np.uint8)
    codes[_ragged((np.cumsum(quads) - quads) * 4, counts)] = size
    four = codes.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    spelled = np.ascontiguousarray(ranks.astype("<u4")).view(np.uint8).reshape(-1, 4)
    data = spelled[np.arange(4) <= size[:, None]]
    ends = np.concatenate([[0], np.cumsum(size.astype(np.int64) + 1)])
    last = np.cumsum(counts)
    return control, data, ends[last] - ends[last - counts]


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks; inverse of `pack`."""
    quads = -(-counts // 4)
    lengths = LENGTHS[control].reshape(-1)[_ragged((np.cumsum(quads) - quads) * 4, counts)]
    at = np.cumsum(lengths) - lengths
    padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.uint32)
    whole = padded[at] | padded[at + 1] << 8 | padded[at + 2] << 16 | padded[at + 3] << 24
    return whole & MASKS[lengths]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary array of consecutive pieces of `data` with the given numbers of bytes."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


class WordCoder:
    """Ids of words; units that were coded before are looked up.

    A word of letters is one unit of the vocabulary's kind, whose last token is
    marked as a word end; many such words are encoded as one text and told apart
    by the marks. Words of other characters are encoded one by one, as are runs
    of punctuation, which are cut off at the ends of words.
    """

    def __init__(self, path: str, together: int = 256):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.together = Tokenizer.from_file(path), together
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        #: Whether A-Z and a-z have the same ids, so that words may be looked up in lower case.
        self.lowers = len({tuple(self.tokenizer.encode(c, add_special_tokens=False).ids) for c in ("AZ", "aZ", "az")}) == 1
        self.forget()

    def forget(self) -> None:
        self.place = {"": 0}
        self.pool, self.starts = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def find(self, words: list[str]) -> np.ndarray:
        """Places of all words; the ids of place k are `pool[starts[k] : starts[k + 1]]`."""
        if len(self.place) > KNOWN_UNITS:
            self.forget()
        found = list(map(self.place.get, words))
        if None in found:
            self._learn([w for w, k in zip(words, found, strict=True) if k is None])
            found = list(map(self.place.__getitem__, words))
        return np.array(found, dtype=np.int64)

    def code(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, concatenated, and their numbers."""
        return self.gather(self.find(words))

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all places, concatenated, and their numbers."""
        starts = self.starts[places]
        counts = self.starts[places + 1] - starts
        return self.pool[_ragged(starts, counts)], counts

    def add_unit(self, ids: list[int]) -> int:
        """Place of a unit that is no word."""
        name = f" {ids}"  # no word has a space
        if name not in self.place:
            self._add([name], [np.array(ids, dtype=np.uint32)], [np.array([len(ids)])])
        return self.place[name]

    def _add(self, names: list[str], ids: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        first = len(self.place)
        self.place.update(zip(names, range(first, first + len(names)), strict=True))
        self.pool = np.concatenate([self.pool, *ids])
        added = np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))
        self.starts = np.concatenate([self.starts, self.starts[-1] + added])

    def _learn(self, words: list[str]) -> None:
        """Add words that are not known: those of letters, other ones, then those of both."""
        cores = [w.rstrip(PUNCTUATION) for w in words]
        # Letters must stay letters when composed and in lower case, else a mark can join the punctuation.
        plain = [c.isalpha() and (c.isascii() or normalize("NFC", c).lower().isalpha()) for c in cores]
        mixed = [(w, c) for w, c, good in zip(words, cores, plain, strict=True) if good and len(c) < len(w)]
        letters = list(dict.fromkeys(c for c, good in zip(cores, plain, strict=True) if good and c not in self.place))
        alone = dict.fromkeys(w for w, good in zip(words, plain, strict=True) if not good)
        alone.update(dict.fromkeys(t for w, c in mixed if (t := w[len(c) :]) not in self.place))
        others, order, ids, sizes = list(alone), [], [], []
        groups = [letters[k : k + self.together] for k in range(0, len(letters), self.together)]
        for group, found in zip(groups, self._encoded(map(" ".join, groups), 8), strict=True):
            last = np.flatnonzero(self.ends[found])
            if len(last) == len(group):
                ids.append(found)
                sizes.append(np.diff(last, prepend=-1))
                order += group
            else:
                others += group
        found = list(self._encoded(iter(others), 2048))
        self._add(order + others, ids + found, [*sizes, np.fromiter(map(len, found), np.int64, len(found))])
        halves = [self.place[part] for w, c in mixed for part in (c, w[len(c) :])]
        joined, counts = self.gather(np.array(halves, dtype=np.int64))
        self._add([w for w, _ in mixed], [joined], [counts.reshape(-1, 2).sum(axis=1)])

    def _encoded(self, texts, at_once: int):
        """Ids of each text; the library's encodings are large, so few are held at a time."""
        while part := list(islice(texts, at_once)):
            for coded in self.tokenizer.encode_batch_fast(part, add_special_tokens=False):
                yield np.array(coded.ids, dtype=np.uint32)


@lru_cache(1)
def word_coder(path: str) -> WordCoder:
    """One a worker process, whose tasks share the words they have met."""
    return WordCoder(path)


def encode(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids: uint32 little-endian) per row, `end_id` at the end.

    The tokenizer must drop white space between words, as the one of
    `word_bpe_49k.json` does: then a text's ids are those of its words, and each
    distinct word that a worker remembers is encoded once. Punctuation after
    letters is a word of its own, and words are looked up in lower case where
    the tokenizer doesn't tell case apart.
    """

    def encode_batches(batches):
        coder = word_coder(vocabulary)
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                text = batch.column("text").fill_null("")
                # The marks of special tokens count in lower case only.
                if coder.lowers and not pc.any(pc.match_substring(text, "<|")).as_py():
                    text = pc.ascii_lower(text)
                split = pc.ascii_split_whitespace(pc.replace_substring_regex(text, WORD_END, r"\1 \2\3"))
                per_doc = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = split.flatten().dictionary_encode()
                places = coder.find(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
                end = coder.add_unit([end_id])
                # Each document's words and its end, as places of the pool.
                upto = np.cumsum(per_doc + 1)
                units = np.full(int(upto[-1]) if len(upto) else 0, end, dtype=np.int64)
                is_word = np.ones(len(units), dtype=bool)
                is_word[upto - 1] = False
                units[is_word] = places[coded.indices.to_numpy(zero_copy_only=False)]
                tokens, per_unit = coder.gather(units)
                counts = np.diff(np.cumsum(per_unit)[upto - 1], prepend=0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts), _binary(tokens.astype("<u4", copy=False).view(np.uint8), counts * 4)],
                    names=["doc_id", "n_tokens", "ids"],
                )

    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return source.mapInArrow(encode_batches, "doc_id bigint, n_tokens bigint, ids binary")


def id_counts(encoded: DataFrame) -> DataFrame:
    """(id, n) over all documents; counted per task before the shuffle."""

    def count(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            found = np.bincount(_ids(batch))
            total = np.pad(total, (0, max(0, len(found) - len(total))))
            total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    return encoded.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """All ids of the batch's column `ids`."""
    column = batch.column("ids")
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    if ends[0] == ends[-1]:
        return np.zeros(0, dtype="<u4")
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view("<u4")


def _rank(encoded: DataFrame, rank_of: np.ndarray, bounds: list[int]) -> DataFrame:
    """(doc_id, n_tokens, control, data, shard) with the ids replaced by coded ranks."""
    cuts = np.array(bounds, dtype=np.int64)

    def code(batches):
        for batch in batches:
            counts = batch.column("n_tokens").to_numpy().astype(np.int64)
            control, data, sizes = pack(rank_of[_ids(batch)], counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_tokens"), _binary(control, -(-counts // 4)), _binary(data, sizes), pa.array(shard_numbers(batch.column("doc_id"), cuts))],
                names=["doc_id", "n_tokens", "control", "data", "shard"],
            )

    return encoded.mapInArrow(code, "doc_id bigint, n_tokens bigint, control binary, data binary, shard int")


def _write_files(folder: str):
    def write(batches):
        path, store, out = temporary_name(folder), None, None
        shard, n_docs, n_tokens = None, 0, 0
        for batch in batches:
            if out is None:
                store, name = filesystem(path)
                out, shard = store.open_output_stream(name), batch.column("shard")[0].as_py()
            docs, counts = batch.column("doc_id"), batch.column("n_tokens").to_numpy()
            control, data = (b"".join(batch.column(c).to_pylist()) for c in ("control", "data"))
            out.write(np.array([batch.num_rows, counts.sum(), len(control), len(data)], dtype="<i8").tobytes())
            out.write(docs.fill_null(0).to_numpy().astype("<i8").tobytes())
            out.write(docs.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
            out.write(counts.astype("<i8").tobytes())
            out.write(control)
            out.write(data)
            n_docs, n_tokens = n_docs + batch.num_rows, n_tokens + int(counts.sum())
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "path": path, "n_docs": n_docs, "n_tokens": n_tokens, "n_bytes": size}],
                schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), *[(c, pa.int64()) for c in ("n_docs", "n_tokens", "n_bytes")]]),
            )

    return write


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, folder: str, shard_tokens: int = 1 << 24) -> DataFrame:
    """Write the token files of `docs` into `folder`; returns the manifest, one row per file."""
    spark = docs.sparkSession
    path = new_folder(spark, "ids")
    encode(docs, vocabulary, end_id).write.option("compression", "zstd").parquet(path)
    encoded = spark.read.schema("doc_id bigint, n_tokens bigint, ids binary").parquet(path)
    counts = sorted(id_counts(encoded).collect(), key=lambda r: (-r["n"], r["id"]))  # at most the vocabulary
    id_of = np.array([r["id"] for r in counts], dtype="<u4")
    rank_of = np.zeros(int(id_of.max()) + 1 if len(id_of) else 1, dtype=np.uint32)
    rank_of[id_of] = np.arange(len(id_of))
    store, name = filesystem(folder)
    store.create_dir(name, recursive=True)
    with store.open_output_stream(posixpath.join(name, "ranks.u32")) as out:
        out.write(id_of.tobytes())
    weights = encoded.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("key"), F.col("n_tokens").alias("weight"))
    bounds = range_bounds(weights, shard_tokens)
    ranked = _rank(encoded, rank_of, bounds)
    sorted_rows = ranked.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("doc_id", "control", "data")
    return materialize(sorted_rows.mapInArrow(_write_files(folder), MANIFEST), "manifest")


def _read_blocks(path: str):
    """Document ids, validity, counts, control and data bytes of each block."""
    store, name = filesystem(path)
    with store.open_input_stream(name) as source:
        while head := source.read(32):
            n_docs, _, n_control, n_data = np.frombuffer(head, dtype="<i8").tolist()
            ids = np.frombuffer(source.read(8 * n_docs), dtype="<i8")
            valid = np.frombuffer(source.read(n_docs), dtype=np.uint8).astype(bool)
            counts = np.frombuffer(source.read(8 * n_docs), dtype="<i8")
            yield ids, valid, counts, *(np.frombuffer(source.read(n), dtype=np.uint8) for n in (n_control, n_data))


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids: uint32 little-endian) per document, from the files."""
    files, start = [], 0
    for k, row in enumerate(sorted(manifest.select("shard", "path", "n_tokens").collect())):  # a row per file
        files.append((k, row["path"], start))
        start += row["n_tokens"]

    def read(batches):
        store, name = filesystem(folder)
        with store.open_input_stream(posixpath.join(name, "ranks.u32")) as source:
            id_of = np.frombuffer(source.read(), dtype="<u4")
        for batch in batches:
            for row in batch.to_pylist():
                at = row["start"]
                for docs, valid, counts, control, data in _read_blocks(row["path"]):
                    tokens = id_of[unpack(control, data, counts)]
                    before = at + np.cumsum(counts) - counts
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs, mask=~valid), pa.array(before), pa.array(counts), _binary(tokens.view(np.uint8), counts * 4)],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    at += int(counts.sum())

    listed = one_task_each(spark, files, "number int, path string, start bigint")
    return listed.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def with_crc(tokens: DataFrame) -> DataFrame:
    """`ids_crc32` in the place of `ids`: CRC-32 of the ids as little-endian uint32."""
    return tokens.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


