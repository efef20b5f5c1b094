"""Prefix trie of conversations, by digests of blocks of turns.

1. Each turn becomes two hashes of its role and text and a length; texts go no
   further. Places inside a conversation are counted in ranges (`numbered`), so a
   conversation may hold any share of all rows.
2. A conversation is cut into blocks of `BLOCK` turns. The digest of a prefix is
   the exclusive or of its turns' hashes, which contain their places, so digests at
   block borders follow from a running sum over blocks, in segments.
3. Conversations are grouped by block first: blocks that end in equal digests are
   one kind, counted map-side. Where one kind alone follows a prefix, its members
   are those of all turns in it, and its nodes are written straight from it. Only
   where siblings diverge are the kinds (not conversations) taken apart by turn and
   grouped again.
4. Sums over a subtree need no walk. A node is owned by its smallest member, and
   what a member owns is the end of its own path. So a subtree's different nodes
   are what its members own, cut off above its top, and its leaves are the
   members that own a leaf: a second grouping by block gives both.

Nodes are told apart by depth and 128 bits of digest. The hash of the ids that end
in a node is fed from sorted pieces of at most 4,096 ids; a task holds one piece.

Defined results: a null role or text is empty; a null turn comes first; turns
equal in number are ordered by their hashes, and repeated rows are turns of their
own; rows without conv_id belong to no conversation and are left out; texts of any
length become hashes; an empty table gives no node, not even the root; other
columns are ignored.
"""

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.operators.numbering import numbered
from postmill.session import materialize

#: Turns of a block.
BLOCK = 4
#: Blocks whose digests are chained in one task.
SEGMENT = 1024
#: Ids of a piece that is hashed: 2 ** PIECE_BITS.
PIECE_BITS = 12
KEY = ["depth", "d1", "d2"]
TURN = ("turn", "x1", "x2", "chars")


def turn_hashes(role: Column, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), role, text), F.xxhash64(F.lit(2), text, role)


def hashed(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, x1, x2, chars) of each row with a conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    x1, x2 = turn_hashes(role, text)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        x1.alias("x1"), x2.alias("x2"), F.char_length(text).cast("bigint").alias("chars"),
    )


def ordered(conversations: DataFrame) -> DataFrame:
    """`hashed` with `pos`, the place in the conversation from 1. Written."""
    rows = materialize(hashed(conversations), "turns")
    return materialize(numbered(rows, ["turn", "x1", "x2"], ("conv_id",), "pos"), "numbered")


def share_heads(turns: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another: (rebuilt turns, ids). Written.

    `conv_id` takes the first h = crc32(decimal id) % `heads` turns from the
    conversation `conv_id - conv_id % every`, then its own after its first h.
    A conversation's head has less than `heads` turns.
    """
    conv = F.col("conv_id")
    ids = turns.select("conv_id").distinct().select(
        "conv_id", (conv - conv % every).alias("base"), (F.crc32(conv.cast("string").cast("binary")) % heads).cast("int").alias("h")
    )
    first = turns.where((conv % every == 0) & (F.col("pos") < heads))
    given = first.groupBy(conv.alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", *TURN))).alias("given"))
    found = ids.join(given, "base", "left")
    taken = F.when(F.col("given").isNotNull(), F.slice("given", F.lit(1), F.col("h")))
    facts = materialize(found.select("conv_id", "base", "h", taken.alias("head")), "heads")
    front = facts.select("conv_id", F.col("base").alias("origin"), F.explode("head").alias("t")).select("conv_id", "origin", "t.*")
    size = facts.select("conv_id", "h", F.coalesce(F.array_size("head"), F.lit(0)).alias("n"))
    own = turns.join(size, "conv_id").where("pos > h").select(
        "conv_id", F.col("conv_id").alias("origin"), (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), *TURN
    )
    return materialize(front.unionByName(own), "rebuilt"), facts.select("conv_id")


def _chained(turns: DataFrame) -> DataFrame:
    """(conv_id, block, depth, d1, d2, chars, f1, f2, before, turns) per conversation and block.

    `depth`, `d1`, `d2`, `chars`: length, digest and characters of the prefix that ends with the
    block; `f1`, `f2`, `before`: the same of the one before it.
    """
    at = turns.select(
        "conv_id", ((F.col("pos") - 1) / BLOCK).cast("bigint").alias("block"),
        F.struct("pos", F.xxhash64("pos", "x1", "x2").alias("k1"), F.xxhash64("x2", "x1", "pos").alias("k2"), "chars").alias("t"),
    )
    cut = at.groupBy("conv_id", "block").agg(
        F.bit_xor("t.k1").alias("b1"), F.bit_xor("t.k2").alias("b2"), F.sum("t.chars").alias("n"),
        F.sort_array(F.collect_list("t")).alias("turns"),
    )
    cut = materialize(cut.withColumn("segment", F.floor(F.col("block") / SEGMENT)), "blocks")

    def running(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns(
            {
                "f1": F.coalesce(F.bit_xor("b1").over(past), F.lit(0)), "f2": F.coalesce(F.bit_xor("b2").over(past), F.lit(0)),
                "before": F.coalesce(F.sum("n").over(past), F.lit(0)),
            }
        )

    whole = cut.groupBy("conv_id", "segment").agg(F.bit_xor("b1").alias("b1"), F.bit_xor("b2").alias("b2"), F.sum("n").alias("n"))
    long = running(whole, ["conv_id"], "segment").where("segment > 0")
    long = long.select("conv_id", "segment", F.col("f1").alias("s1"), F.col("f2").alias("s2"), F.col("before").alias("sn"))
    inside = running(cut, ["conv_id", "segment"], "block").join(long, ["conv_id", "segment"], "left")
    f1, f2 = (F.col(f"f{k}").bitwiseXOR(F.coalesce(f"s{k}", F.lit(0))) for k in (1, 2))
    before = F.col("before") + F.coalesce("sn", F.lit(0))
    return inside.select(
        "conv_id", "block", (F.col("block") * BLOCK + F.size("turns")).alias("depth"),
        f1.bitwiseXOR(F.col("b1")).alias("d1"), f2.bitwiseXOR(F.col("b2")).alias("d2"), (before + F.col("n")).alias("chars"),
        f1.alias("f1"), f2.alias("f2"), before.alias("before"), "turns",
    )


def _entries() -> Column:
    """The nodes of a block's turns: place, digest, parent's digest, own characters, characters before."""

    def upto(n: Column, start: str, part: str) -> Column:
        return F.aggregate(F.slice("turns", F.lit(1), n), F.col(start), lambda a, t: a.bitwiseXOR(t[part]))

    def entry(i: Column) -> Column:
        chars = F.aggregate(F.slice("turns", F.lit(1), i - 1), F.col("before"), lambda a, t: a + t["chars"])
        return F.struct(
            F.get("turns", i - 1)["pos"].alias("depth"), upto(i, "f1", "k1").alias("d1"), upto(i, "f2", "k2").alias("d2"),
            upto(i - 1, "f1", "k1").alias("p1"), upto(i - 1, "f2", "k2").alias("p2"),
            F.get("turns", i - 1)["chars"].alias("chars"), chars.alias("before"),
        )

    return F.transform(F.sequence(F.lit(1), F.size("turns")), entry)


def _ends(paths: DataFrame) -> DataFrame:
    """Per node in which conversations end: `ends_sha256` of their ids, ascending, joined by commas."""
    piece = F.shiftright("conv_id", PIECE_BITS).alias("piece")
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string"))
    pieces = paths.groupBy(*KEY, piece).agg(F.array_join(ids, ",").alias("ids"))

    def rows(batches):
        key, digest = None, None

        def out():
            names = [*KEY, "ends_sha256"]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, digest.hexdigest())], names=names)

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in KEY), strict=True)
            done: list[tuple] = []
            for now, text in zip(keys, batch.column("ids").to_pylist(), strict=True):
                if now == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256()
                digest.update(text.encode())
            if done:
                columns = [pa.array(list(c)) for c in zip(*done, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*KEY, "ends_sha256"])
        if key is not None:
            yield out()

    dealt = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")
    return dealt.mapInArrow(rows, "depth bigint, d1 bigint, d2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the trie of `turns` (conv_id, pos, x1, x2, chars); `ids` (conv_id) are all conversations.

    Both are stored tables. Columns: conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, d1, d2.
    """
    chained = materialize(_chained(turns), "chained")
    last = chained.groupBy("conv_id").agg(F.max_by(F.struct(*KEY, "chars"), "block").alias("end"))
    end = [F.coalesce(F.col(f"end.{c}"), F.lit(0)).alias(c) for c in (*KEY, "chars")]
    paths = materialize(ids.join(last, "conv_id", "left").select("conv_id", *end), "paths")

    kinds = chained.groupBy(*KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("first"),
        F.first(F.struct("block", "f1", "f2", "before", "turns")).alias("b"),
    )
    kinds = materialize(kinds.select(*KEY, "n_convs", "first", "b.*").withColumn("nodes", _entries()).drop("turns"), "kinds")
    # A prefix that one kind alone follows has that kind as its only entry.
    single = kinds.groupBy("block", "f1", "f2").agg(F.count("*").alias("n"), F.first(F.struct(*KEY)).alias("key"))
    single = single.where("n = 1").select("key.*", F.lit(True).alias("alone"))
    kinds = materialize(kinds.join(single, KEY, "left"), "siblings")

    def by_turn(rows: DataFrame, sums: list[Column], keep: list[str]) -> DataFrame:
        """Rows per kind -> rows per node; only diverging kinds are grouped."""
        names = ["n_convs", "first", "total", "own", "leaves"]
        given = [c for c in names if c in rows.columns]
        flat = rows.select("alone", *given, F.explode("nodes").alias("e")).select("alone", *given, "e.*")
        same = flat.where("alone").select(*KEY, *given, *keep)
        apart = flat.where("alone IS NULL").groupBy(*KEY).agg(*sums, *[F.first(c).alias(c) for c in keep])
        return same.unionByName(apart)

    facts = ["p1", "p2", "chars", "before"]
    nodes = by_turn(kinds, [F.sum("n_convs").alias("n_convs"), F.min("first").alias("first")], facts)
    none = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    root = ids.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("first")).where("n_convs > 0").select(
        *[zero.alias(c) for c in KEY], "n_convs", "first", none.alias("p1"), none.alias("p2"), zero.alias("chars"), zero.alias("before")
    )
    nodes = materialize(nodes.unionByName(root), "nodes")
    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2")
    ).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes, "nodes")

    # What each conversation owns: the end of its path from `start` characters on, and perhaps a leaf.
    owned = nodes.groupBy("first").agg(
        F.sum("chars").alias("own"), F.min("before").alias("start"), F.count_if(F.col("n_children") == 0).alias("leaves")
    )
    members = paths.join(owned, F.col("conv_id") == F.col("first"), "left").select(
        "conv_id", F.col("chars").alias("total"), F.coalesce("own", F.lit(0)).alias("own"),
        F.coalesce("leaves", F.lit(0)).alias("leaves"), "start",
    )
    members = materialize(members, "members")
    sums = [F.sum(c).alias(c) for c in ("total", "own", "leaves")]
    by_kind = chained.select("conv_id", *KEY).join(members, "conv_id").groupBy(*KEY).agg(*sums)
    subtree = by_turn(by_kind.join(kinds.select(*KEY, "alone", "nodes"), KEY), sums, [])
    of_root = members.agg(*sums).where("total IS NOT NULL").select(*[zero.alias(c) for c in KEY], "total", "own", "leaves")
    subtree = subtree.unionByName(of_root)

    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("first").alias("parent_conv_id")
    )
    start = members.select(F.col("conv_id").alias("first"), "start")
    empty = F.lit(hashlib.sha256().hexdigest())
    joined = (
        nodes.join(subtree, KEY).join(_ends(paths), KEY, "left").join(start, "first").join(above, ["depth", "p1", "p2"], "left")
    )
    repeated = F.col("total") - F.col("n_convs") * F.col("before")
    different = F.col("own") + F.col("start") - F.col("before")
    return joined.select(
        F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        (repeated - different).alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"), "d1", "d2",
    )


def with_texts(nodes: DataFrame, turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """`nodes` with the role and text of their last turn (null for the root).

    `turns` as `share_heads` or `ordered` give them; without `origin` a turn is of its own conversation.
    """
    origin = F.col("origin") if "origin" in turns.columns else F.col("conv_id")
    places = turns.select("conv_id", F.col("pos").alias("depth"), origin.alias("o"), "turn", "x1", "x2")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    x1, x2 = turn_hashes(role, text)
    source = conversations.select(
        F.col("conv_id").cast("bigint").alias("o"), F.col("turn").cast("bigint").alias("turn"), x1.alias("x1"), x2.alias("x2"),
        role.alias("role"), text.alias("text"),
    ).dropDuplicates(["o", "turn", "x1", "x2"])
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("o", "turn", "x1", "x2")]
    found = nodes.join(places, ["conv_id", "depth"], "left").alias("n").join(
        source.alias("s"), reduce(lambda a, b: a & b, same), "left"
    )
    return found.select(*[F.col(f"n.{c}") for c in nodes.columns], F.col("s.role"), F.col("s.text"))
