"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and their components.

1. A text becomes its set of shingle hashes. Equal sets are one class.
2. Sizes are cut into levels so that linked sets are in the same level or in
   neighbouring ones. What two linked sets may differ in is bounded per level. The
   hash space is cut into more parts than that, so linked sets are equal in some
   part: each set gives one signature per part. Where that would be more than
   `MOST_PARTS` parts, bands of min-hashes are the signatures instead, so many
   that a linked pair has none in common with a probability below `MISSED`. Sets
   that share a signature are candidates; unlike a single shingle, a part or band
   is hardly ever equal by chance. Components of candidates bound where links can
   be.
3. Each set is first compared exactly with the set that shares most parts with it
   and comes first, which joins most copies of a text at linear cost.
4. In components that are still in several pieces, members are dealt into tiles: into
   a few, whatever their sizes, or, of a large component, by size level, those of the
   largest piece, which need not meet each other, apart. A task compares two tiles by bitmaps: each shingle flips one bit,
   so the set bits of two bitmaps' XOR are at most the shingles in just one of
   the sets, which bounds the overlap from above. Of the pairs that pass, one
   between any two pieces is intersected exactly by sorted arrays; the task takes the two
   for one piece from there on. Where they turn out to be none, the component is
   dealt again, with many more pairs between any two pieces, until all that were
   taken for one are one.

No pair is lost, but for that chance: a pair that is not compared lies in one piece
already, or has no equal part, or too many differing bits. No group is ever in one task: classes
are counted map-side, tiles have a bounded number of members, and joins on hot
keys are plain equi-joins of narrow rows that Spark can split.

Defined results: null text or text without words has an empty set, is linked
with nothing and its own component; a text with fewer words than a shingle is one
shingle; rows that repeat an id keep their own sets, and a component's id is the
smallest doc_id in it; a null id never names a component unless it has no other;
an empty table gives no rows; other columns are ignored.
"""

import math
import operator
from collections import Counter
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.text import BLANKS, quoted, slices
from postmill.operators.components import connected_components
from postmill.session import materialize

#: Members of a component up to which it is one tile, and of a tile of a larger one.
ONE_TILE = 2048
TILE = 2048
#: Tiles up to which a component's members are dealt whatever their sizes; each member goes to as many
#: tasks. In a larger one it goes to one for each tile in its level and the two beside it.
FEW = 4
#: Pairs between two pieces, after the first round, of which the round after takes 16 times as many, and so on.
MORE = 256
#: A task that has, for each member, this share of the pairs between two pieces takes one between any two from there on.
SHARE = 1 / 16
#: Words of the filter of ids: 2 MB, enough for some millions of candidates.
FILTER_WORDS = 1 << 18
#: Differing shingles up to which linked sets are found by equal parts, without fail.
MOST_PARTS = 64
#: Chance that two larger linked sets have no band in common.
MISSED = 1e-16
#: Sets without id that a task remembers, so that it passes on few copies of each.
HELD = 100_000
SETS = (
    "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, level int, signatures array<bigint>,"
    " own binary, next binary"
)
LINKS = "comp bigint, a bigint, b bigint, last boolean"


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """SplitMix64's finalizer, on values shifted by a salt."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def shingle_sets(texts: pa.Array, width: int):
    """The sorted distinct shingle hashes of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = split.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    # Leading and trailing white space leaves empty strings.
    filled = np.array([bool(w) for w in coded.dictionary.to_pylist()], dtype=bool)
    word = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    for end in ends.tolist():
        own = word[start:end]
        start = end
        words = hashes[own[filled[own]]]
        n = len(words) - width + 1
        if n <= 1:
            parts = [words[k : k + 1] for k in range(len(words))]
            n = min(len(words), 1)
        else:
            parts = [words[k : k + n] for k in range(width)]
        shingles = np.zeros(n, dtype=np.uint64)
        for k, part in enumerate(parts):
            shingles = mix(shingles ^ part, k % 64 + 1)
        yield np.unique(shingles)


@lru_cache(100_000)
def level_start(level: int, percent: int) -> int:
    """Smallest size of a level: a linked set is at most 100 / percent times as large, so one level up at most."""
    return 1 if level == 0 else level_start(level - 1, percent) * 100 // percent + 1


@lru_cache(100_000)
def differing(level: int, percent: int) -> int:
    """Most shingles in just one of two linked sets, the larger being of this level."""
    return 2 * (level_start(level + 1, percent) - 1) * (100 - percent) // (100 + percent)


def level_of(size: int, percent: int) -> int:
    level = int(math.log(size) / math.log(100 / percent))
    while level > 0 and level_start(level, percent) > size:
        level -= 1
    while level_start(level + 1, percent) <= size:
        level += 1
    return level


@lru_cache(100_000)
def parts_of(level: int, percent: int) -> tuple[int, int]:
    """Number of parts of the hash space, and how many empty ones may be passed over.

    `spare` parts more than needed: then linked sets agree in `spare` + 1, and a
    set with at most `spare` empty parts needs no signature for those, which many
    unrelated sets would share. The number makes more empty parts rare.
    """
    least, smallest = differing(level, percent) + 1, level_start(max(level - 1, 0), percent)
    for spare in range(least + 1):
        empty = (least + spare) * math.exp(-smallest / (least + spare))
        if spare >= empty + 4 * math.sqrt(empty):
            return least + spare, spare
    return 2 * least, least


@lru_cache(16)
def band_hashes(percent: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Min-hashes in a band, and the factors and offsets of all min-hashes."""
    share = min(percent, 99) / 100
    rows = max(1, round(math.log(0.34) / math.log(share)))
    bands = math.ceil(math.log(MISSED) / math.log(1 - share**rows))
    draw = np.random.default_rng(20)
    factors, offsets = (draw.integers(0, 2**32, (bands * rows, 1), dtype=np.uint32) for _ in range(2))
    return rows, factors | np.uint32(1), offsets


def bands(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the bands of a set's min-hashes."""
    rows, factors, offsets = band_hashes(percent)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 2**32 - 1, dtype=np.uint32)
    for k in range(0, len(short), 4096):
        least = np.minimum(least, (factors * short[k : k + 4096] + offsets).min(axis=1))
    found = np.zeros(len(factors) // rows, dtype=np.uint64)
    for column in least.reshape(-1, rows).T:
        found = mix(found ^ column.astype(np.uint64), 20)
    return mix(found ^ np.arange(len(found), dtype=np.uint64), 21)


class Mixed:
    """A set's shingles with the hashes that signatures and bitmaps of all levels use."""

    def __init__(self, shingles: np.ndarray):
        self.shingles = shingles
        self.mixed, self.parts, self.bits = (mix(shingles, salt) for salt in (12, 14, 17))


def signatures(of: Mixed, level: int, percent: int) -> np.ndarray:
    """Hashes of which a set has one in common with every linked set whose larger one is of this level."""
    most = differing(level, percent)
    if most > MOST_PARTS:
        return bands(of.shingles, percent)
    salt = mix(np.uint64([level]), 11)[0]
    mixed = of.mixed
    if most == 0:
        return np.zeros(0, dtype=np.uint64)
    if most == 1:  # the set, and the set without each of its members
        return mix(np.append(mixed.sum() - mixed, mixed.sum()) ^ salt, 13)
    parts, spare = parts_of(level, percent)
    part = (of.parts % np.uint64(parts)).astype(np.int64)
    sums = np.zeros(parts, dtype=np.uint64)
    np.add.at(sums, part, mixed)
    empty = np.bincount(part, minlength=parts) == 0
    found = mix(mix(np.arange(parts, dtype=np.uint64) ^ salt, 15) ^ sums, 16)
    return found[~empty] if empty.sum() <= spare else found


def both_signatures(of: Mixed, level: int, percent: int) -> np.ndarray:
    """Signatures for a set's own level and the next, where a larger linked set can be."""
    own = signatures(of, level, percent)
    if differing(level, percent) > MOST_PARTS:  # bands are the same for all levels
        return own
    return np.concatenate([own, signatures(of, level + 1, percent)])


def bitmap(of: Mixed, level: int, percent: int) -> bytes:
    """Parities of the numbers of shingles that hash to each bit; the size follows from the level."""
    bits = 1 << max(8, (8 * differing(level, percent)).bit_length())
    at = (of.bits % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def set_hashes(shingles: np.ndarray) -> tuple[int, int]:
    """Two hashes that, with its size, stand for a set."""
    h1, h2 = (mix(shingles, k).sum().view(np.int64) for k in (18, 19))
    return int(h1), int(h2)


def same_set(a: str, b: str) -> Column:
    """Join condition: equal sets and equal `rep`, which can be null."""
    sets = [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in ("h1", "h2", "n_shingles")]
    return reduce(operator.and_, sets, F.col(f"{a}.rep").eqNullSafe(F.col(f"{b}.rep")))


def describe(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row: set size, set hash, level, signatures, bitmaps for its level and the next."""

    def rows(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                out = []
                for s in shingle_sets(batch.column("text"), width):
                    if not len(s):
                        out.append((0, 0, 0, None, None, None, None))
                        continue
                    level = level_of(len(s), percent)
                    of = Mixed(s)
                    found = both_signatures(of, level, percent)
                    h1, h2 = set_hashes(s)
                    own, after = (bitmap(of, k, percent) for k in (level, level + 1))
                    out.append((len(s), h1, h2, level, found.view(np.int64), own, after))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary())
                columns = [pa.array(list(c), t) for c, t in zip(zip(*out), kinds, strict=True)]
                names = ["doc_id", "n_shingles", "h1", "h2", "level", "signatures", "own", "next"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return source.mapInArrow(rows, SETS)


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b, n): class a shares n signatures of which class b < a is the first."""
    rows = classes.select(F.explode("signatures").alias("signature"), "cid")
    first = F.min("cid").over(Window.partitionBy("signature"))
    return (
        rows.select(F.col("cid").alias("a"), first.alias("b")).where("a > b").groupBy("a", "b").agg(F.count("*").alias("n"))
    )


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bloom filter, of at most `FILTER_WORDS` words of 64 bits, of the column `rep`.

    Two bits an id. It only spares documents the shuffle: when it is too small
    for the ids, more documents pass, and the join still decides.
    """
    n = ids.count()
    words = min(FILTER_WORDS, 1 << max(6, (n // 4).bit_length()))
    at = [F.xxhash64(F.lit(k), "rep").bitwiseAND(words * 64 - 1) for k in range(2)]
    bits = ids.select(F.explode(F.array(*at)).alias("at")).select(
        F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit")
    )
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()  # at most `words` rows
    table = np.zeros(words, dtype=np.int64)
    for row in found:
        table[row["word"]] = row["bits"]
    return table.view(np.uint64)


def shingle_table(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(cid, shingles: sorted uint64) of the given classes (cid, h1, h2, n_shingles, rep), from one text each.

    Texts are not shuffled: a filter of the ids decides which become shingles. The
    null id is in the filter if a class has no other; of copies without id a task
    passes on one of `HELD` in a row.
    """
    table = id_filter(classes.select("rep"))

    def rows(batches):
        mask = np.uint64(len(table) * 64 - 1)
        held: set[tuple[int, int]] = set()
        for whole in batches:
            hashes = [whole.column(c).to_numpy().view(np.uint64) & mask for c in ("hash0", "hash1")]
            passed = np.ones(whole.num_rows, dtype=bool)
            for h in hashes:
                passed &= (table[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)
            for batch in slices(whole.filter(pa.array(passed)), "text"):
                out = []
                for rep, s in zip(batch.column("rep").to_pylist(), shingle_sets(batch.column("text"), width), strict=True):
                    h1, h2 = set_hashes(s)
                    if rep is None:
                        if (h1, h2) in held:
                            continue
                        if len(held) == HELD:
                            held.clear()
                        held.add((h1, h2))
                    out.append((rep, h1, h2, len(s), s.tobytes()))
                columns = [pa.array([row[k] for row in out], field.type) for k, field in enumerate(schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    schema = pa.schema({"rep": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "n_shingles": pa.int64(), "shingles": pa.binary()})
    rep = F.col("doc_id").cast("bigint")
    texts = docs.select(
        rep.alias("rep"), F.col("text").cast("string"), *[F.xxhash64(F.lit(k), rep).alias(f"hash{k}") for k in range(2)]
    )
    found = texts.mapInArrow(rows, "rep bigint, h1 bigint, h2 bigint, n_shingles bigint, shingles binary")
    # Rows that repeat an id, or have none, can have other texts, so the set counts too.
    joined = found.alias("f").join(classes.select("cid", "h1", "h2", "n_shingles", "rep").alias("c"), same_set("f", "c"))
    return joined.select("c.cid", "f.shingles").dropDuplicates(["cid"])


def verify(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) by exact intersection."""

    def rows(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"]
            )

    x = shingles.select(F.col("cid").alias("a"), F.col("shingles").alias("x"))
    y = shingles.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(rows, "a bigint, b bigint, linked boolean")


def compare_members(rows: dict[str, np.ndarray], percent: int, most: int) -> list[tuple[int, int, bool]]:
    """For the members of two tiles: pairs that may be linked, `most` between any two pieces.

    After the last one (true) of two pieces no more are looked for, as if they were one.
    """
    pairs: list[tuple[int, int, bool]] = []
    between: Counter[tuple[int, int]] = Counter()
    piece = rows["label"].copy()
    node, size, level, side = (rows[c] for c in ("node", "n_shingles", "level", "side"))
    refused = [frozenset(r) if r is not None else frozenset() for r in rows["refused"]]
    where = {int(k): np.flatnonzero(level == k) for k in np.unique(level)}
    full = SHARE * most * len(node)
    for k, mine in where.items():
        for other, column in ((k, "own"), (k + 1, "next")):
            if other not in where:
                continue
            against = where[other]
            bits = np.stack([np.frombuffer(x, np.uint64) for x in rows["own"][against]])
            for row in mine.tolist():
                apart = np.bitwise_count(bits ^ np.frombuffer(rows[column][row], np.uint64)).sum(axis=1, dtype=np.int64)
                total = size[against] + size[row]
                small = np.minimum(size[against], size[row])
                fit = (apart * (100 + percent) <= total * (100 - percent)) & (100 * small >= percent * (total - small))
                fit &= (side[against] != side[row]) | (side[against] == 2)
                fit &= piece[against] != piece[row]
                if other == k:
                    fit &= against > row
                for hit in against[fit].tolist():
                    if piece[hit] != piece[row] and node[hit] not in refused[row]:
                        of = (min(piece[row], piece[hit]), max(piece[row], piece[hit]))
                        between[of] += 1
                        last = between[of] >= most or len(pairs) >= full
                        pairs.append((max(node[row], node[hit]), min(node[row], node[hit]), last))
                        if last:
                            piece[piece == of[1]] = of[0]
    return pairs


TILE_KEY = ("comp", "cross", "low", "i", "high", "j")
MEMBER = ("side", "node", "label", "level", "n_shingles", "own", "next", "refused")


def likely_pairs(dealt: DataFrame, percent: int, most: int) -> DataFrame:
    """Pairs (comp, a, b, last) of each tile. A partition is sorted by tile, and read with one tile in memory at a time."""

    def compare(batches):
        key, held = None, {c: [] for c in MEMBER}

        def pairs():
            rows = {c: np.array(held[c], dtype=object if c in ("own", "next", "refused") else np.int64) for c in MEMBER[:-1]}
            rows["refused"] = held["refused"]
            found = np.array(compare_members(rows, percent, most), dtype=np.int64).reshape(-1, 3)
            a, b, last = found.T
            columns = [np.full(len(found), key[0], dtype=np.int64), a, b, last.astype(bool)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["comp", "a", "b", "last"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in TILE_KEY), strict=True))
            columns = {c: batch.column(c).to_pylist() for c in MEMBER}
            cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
            for start, end in zip(cuts, cuts[1:]):
                if keys and keys[start] != key:
                    if key is not None:
                        yield pairs()
                    key, held = keys[start], {c: [] for c in MEMBER}
                for c in MEMBER:
                    held[c] += columns[c][start:end]
        if key is not None:
            yield pairs()

    return dealt.mapInArrow(compare, LINKS)


def tiles(members: DataFrame) -> DataFrame:
    """Members with `TILE_KEY`, once for each pair of tiles they are in, and `side` (2: compare with all).

    `members`: (comp, node, label, level, ...), a stored table; `label` names the piece.
    Members of a component of up to `FEW` tiles go to the pairs of their own tile with each,
    whatever their level. In a larger one, members of the largest piece are linked with each other already, so
    they only meet the others, in tiles of their own (`cross`): each is copied once
    per tile of others in its level and the two beside it, which is one tile as long
    as few are left outside. The others also meet each other. Counts per component,
    piece and level decide; they are joined by component, never gathered.
    """
    pieces = members.groupBy("comp", "label").agg(F.count("*").alias("n"))
    largest = pieces.groupBy("comp").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.sum("n").alias("total"))
    known = members.join(largest, "comp").withColumn("main", F.col("label") == F.col("largest"))
    sizes = known.groupBy("comp", "main", "level").agg(F.count("*").alias("n"))
    # There are few levels, whatever the data.
    level_sizes = [
        F.map_from_entries(F.collect_list(F.when(main, F.struct("level", "n")))).alias(name)
        for name, main in (("mains", F.col("main")), ("others", ~F.col("main")))
    ]
    known = known.join(sizes.groupBy("comp").agg(*level_sizes), "comp")

    def dealt(of: str, level):
        return F.ceil(F.coalesce(F.try_element_at(of, level), F.lit(0)) / TILE).cast("int")

    def numbers(count):
        return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    level = F.col("level")
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("main"), dealt("mains", level)).otherwise(dealt("others", level))).cast("int")

    def pair(cross, low, i, high, j, side):
        return F.struct(
            F.lit(cross).alias("cross"), low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"),
            (side if isinstance(side, Column) else F.lit(side)).alias("side"),
        )

    same = F.transform(
        numbers(dealt("others", level)),
        lambda o: pair(0, level, F.least(mine, o), level, F.greatest(mine, o), F.when(o == mine, 2).when(o > mine, 0).otherwise(1)),
    )
    above = F.transform(numbers(dealt("others", level + 1)), lambda o: pair(0, level, mine, level + 1, o, 0))
    below = F.transform(numbers(dealt("others", level - 1)), lambda o: pair(0, level - 1, o, level, mine, 1))

    def to_mains(at):
        return F.transform(numbers(dealt("mains", at)), lambda o: pair(1, level, mine, at, o, 0))

    def to_others(at):
        return F.transform(numbers(dealt("others", at)), lambda o: pair(1, at, o, level, mine, 1))

    beside = [level - 1, level, level + 1]
    few = F.when(F.col("total") <= ONE_TILE, 1).otherwise(F.ceil(F.col("total") / TILE)).cast("int")
    tile, none = F.pmod(F.xxhash64("node"), few).cast("int"), F.lit(-1)
    whole = F.transform(
        numbers(few), lambda o: pair(0, none, F.least(tile, o), none, F.greatest(tile, o), F.when(o == tile, 2).when(o > tile, 0).otherwise(1))
    )
    every = F.when(few <= FEW, whole).when(F.col("main"), F.concat(*map(to_others, beside))).otherwise(
        F.concat(same, above, below, *map(to_mains, beside))
    )
    spread = known.withColumn("pair", F.explode(every))
    return spread.select(
        "comp", *[f"pair.{c}" for c in TILE_KEY[1:]], "pair.side",
        "node", "label", "level", "n_shingles", "own", "next", "refused",
    )


def linked_classes(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, label) of the classes that are linked with others. `classes` has been written."""
    spark = docs.sparkSession
    candidate = materialize(candidates(classes), "candidates")
    comps = materialize(connected_components(candidate.select("a", "b")), "components")
    facts = classes.join(comps.withColumnRenamed("node", "cid"), "cid").withColumnRenamed("label", "comp")
    facts = materialize(facts.drop("signatures"), "facts")
    shingles = materialize(shingle_table(docs, facts, width), "shingles")
    nearest = candidate.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    judged = materialize(verify(nearest, shingles, percent), "judged")
    found, refused = judged.where("linked").select("a", "b"), judged.where("NOT linked").select("a", "b")
    labels, waiting, most = connected_components(found), None, 1
    while True:
        members = facts.withColumnRenamed("cid", "node").join(labels, "node", "left")
        members = members.withColumn("label", F.coalesce("label", "node"))
        if waiting is None:
            waiting = members.groupBy("comp").agg(F.min("label").alias("low"), F.max("label").alias("high"))
            waiting = waiting.where("low <> high").select("comp")
        both = refused.unionByName(refused.select(F.col("b").alias("a"), F.col("a").alias("b")))
        no = both.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("refused"))
        members = materialize(members.join(waiting, "comp", "left_semi").join(no, "node", "left"), "members")
        dealt = tiles(members).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *TILE_KEY)
        compared = likely_pairs(dealt.sortWithinPartitions(*TILE_KEY), percent, most)
        pairs = materialize(compared.groupBy("comp", "a", "b").agg(F.bool_or("last").alias("last")), "pairs")
        if pairs.isEmpty():
            return labels
        judged = materialize(verify(pairs, shingles, percent), "judged")
        # A component is done when all pieces that a task took for one are one.
        guessed = pairs.where("last").join(judged.where("NOT linked"), ["a", "b"])
        if judged.where("linked").isEmpty():  # the pieces are what they were
            waiting = guessed.select("comp").distinct()
        else:
            found = materialize(found.unionByName(judged.where("linked").select("a", "b")), "found")
            labels = materialize(connected_components(found), "labels")
            for c in ("a", "b"):
                own = labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
                guessed = guessed.join(own, c, "left").withColumn(f"label_{c}", F.coalesce(f"label_{c}", c))
            waiting = guessed.where("label_a <> label_b").select("comp").distinct()
        waiting = materialize(waiting, "waiting")
        if waiting.isEmpty():
            return labels
        refused = materialize(refused.unionByName(judged.where("NOT linked").select("a", "b")), "refused")
        most = MORE if most == 1 else 16 * most


def members(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Per row of `docs` (doc_id, n_shingles, component_id), and per component with words
    its first set: (rep, h1, h2, n_shingles), with the smallest doc_id, then the smallest hashes."""
    sets = materialize(describe(docs, width, percent), "sets")
    grouped = sets.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(
        F.min("doc_id").alias("rep"), F.first(F.struct("level", "signatures", "own", "next")).alias("of")
    )
    classes = grouped.select(
        F.monotonically_increasing_id().alias("cid"), "h1", "h2", "n_shingles", "rep", "of.level", "of.signatures", "of.own", "of.next"
    )
    classes = materialize(classes, "classes")
    labels = linked_classes(docs, classes, width, percent).withColumnRenamed("node", "cid")
    joined = classes.select("cid", "h1", "h2", "n_shingles", "rep").join(labels, "cid")
    least = joined.groupBy("label").agg(F.min("rep").alias("component"))
    linked = joined.join(least, "label").select("h1", "h2", "n_shingles", "component")
    apart = classes.join(labels, "cid", "left_anti").select("rep", "h1", "h2", "n_shingles")
    alone = apart.select("h1", "h2", "n_shingles", F.col("rep").alias("component"))
    every = linked.unionByName(alone)
    rows = sets.select("doc_id", "n_shingles", "h1", "h2").join(every, ["h1", "h2", "n_shingles"], "left")
    one = F.struct("rep", "h1", "h2", "n_shingles")
    first = joined.groupBy("label").agg(F.min_by(one, F.struct(F.col("rep").isNull(), one)).alias("of")).select("of.*")
    return rows.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), first.unionByName(apart)


def components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of `docs`.

    Links: 100 * intersection >= percent * union of the sets of `width`-word shingles.
    """
    return members(docs, width, percent)[0]


def with_set(docs: DataFrame, width: int) -> DataFrame:
    """(row: the columns of `docs`, rep, h1, h2, n_shingles) of each row."""

    def rows(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [(*set_hashes(s), len(s)) for s in shingle_sets(batch.column("text"), width)]
                counts = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("rep"), *counts], names=["row", "rep", "h1", "h2", "n_shingles"]
                )

    whole = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("rep"), F.col("text").cast("string").alias("text")
    )
    kinds = [*whole.schema.fields[:2], *[T.StructField(c, T.LongType()) for c in ("h1", "h2", "n_shingles")]]
    return whole.mapInArrow(rows, T.StructType(kinds))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of `docs` per component, and every row without words.

    The row is one with the component's smallest doc_id. A row whose id no other
    has is judged by its id. Rows without id, or whose id others have, are told
    apart by their sets; which of those with equal id and set stays is the one
    with the smallest text.
    """
    rows, first = members(docs, width, percent)
    per_id = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(F.expr("doc_id <> component_id")).alias("gone"))
    judged = materialize(per_id.where("gone OR n > 1 OR doc_id IS NULL"), "judged_ids")
    kept = docs.join(judged.select("doc_id"), "doc_id", "left_anti").where("doc_id IS NOT NULL").select(*map(quoted, docs.columns))
    shared = judged.where("n > 1 OR doc_id IS NULL").select("doc_id")
    if shared.isEmpty():
        return kept
    same = docs.join(shared.where("doc_id IS NOT NULL"), "doc_id", "left_semi").select(*map(quoted, docs.columns))
    same = same.unionByName(docs.where("doc_id IS NULL"))
    bare = F.coalesce(F.btrim(F.col("text").cast("string"), F.lit(BLANKS)), F.lit("")) == ""
    # Copies are reduced map-side before the join.
    one = with_set(same.where(~bare), width).groupBy("rep", "h1", "h2", "n_shingles").agg(F.min_by("row", "row.text").alias("row"))
    chosen = one.alias("o").join(first.alias("f"), same_set("o", "f"), "left_semi").select("row.*")
    return kept.unionByName(same.where(bare)).unionByName(chosen)
