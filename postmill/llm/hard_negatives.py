"""Hard negatives of anchors, by an inverted multi-index with certified stops.

1. Vectors become integers. Two codebooks, one per half of the dimensions, are
   fitted on a sample of at most `SAMPLE` rows (those with the smallest hashes of
   their ids); every row is then assigned to its cell, the pair of nearest codes.
   For each code the largest distance of any of its rows is its radius.
2. Per anchor, a half's score is at most its product with the code plus its norm
   times the radius, and a cell's at most the sum of both halves'. A heap over the
   two sorted lists of half bounds yields cells in descending order of these sums.
3. Cells hold tiles of about `TILE` rows. A round visits the next cells of each
   open anchor: anchors that visit a cell meet its tiles in blocks of about
   `QUERIES`, one small matrix product each, and the best rows of each are merged.
4. An anchor is done when no cell left can change its answer: for positives, when
   the next bound is below the last score found; for a window of negatives, when
   that holds, or the next bound is below the window. Rounds quadruple, up to all
   cells, so every answer is exact whatever the codebooks are worth.

Scores are products of integers, in float64 only where that is exact. A window is
what scores from `low` to `high` percent of its positive.

Defined results: rows with a null id, label or vector, or a component that is null
or not finite, take no part; of rows that repeat an id the least by label and
vector counts; scaled components are held to +-2**26; shorter vectors end in
zeros, an empty one is all zeros; ties go to the smaller id; an empty table, or
one without anchors, gives no rows; other columns are ignored.
"""

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import materialize

SAMPLE = 8192
TILE = 1024
QUERIES = 256
#: Rows that a cell should have, which gives the number of codes, and most codes of a half.
CELL = 256
MOST_CODES = 256
#: Cells of the first round.
FIRST = 16
LARGEST = float(1 << 26)
ROW = "vec_id bigint, label bigint, v array<int>"


def integers(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, v) of the rows of (vec_id, embedding, label) that take part, one per vec_id."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: F.abs(c.cast("double")) < F.lit(math.inf))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite)

    def whole(c: Column) -> Column:
        return F.floor(F.greatest(F.least(F.lit(scale) * c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))).cast("int")

    row = F.struct(F.col("label").cast("bigint").alias("label"), F.transform(x, whole).alias("v"))
    one = rows.groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(F.min(row).alias("row"))
    return one.select("vec_id", "row.label", "row.v")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of integers as rows of a matrix, zeros behind short ones."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim).astype(np.int64)
    out = np.zeros((len(sizes), dim), dtype=np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def codebook(points: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """Centres of `codes` groups of the points, by Lloyd's rounds from the first different points."""
    centres = np.unique(points, axis=0)
    centres = centres[np.random.default_rng(20).permutation(len(centres))[:codes]].astype(np.float64)
    for _ in range(rounds):
        near = nearest(points, centres)[0]
        for k in range(len(centres)):
            mine = points[near == k]
            if len(mine):
                centres[k] = mine.mean(axis=0)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of each point's nearest centre."""
    points = points.astype(np.float64)
    apart = (centres**2).sum(axis=1) - 2 * points @ centres.T
    near = apart.argmin(axis=1)
    return near, np.sqrt(((points - centres[near]) ** 2).sum(axis=1))


@dataclass
class Cells:
    """Codes, radii and occupied cells, all bounded by `MOST_CODES`; goes to the tasks."""

    dim: int
    half: int
    centres: list[np.ndarray]
    radii: list[np.ndarray]
    tiles_of: np.ndarray

    def halves(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return points[..., : self.half], points[..., self.half :]

    def in_order(self, query: np.ndarray):
        """(bound, i, j) of occupied cells, by descending bound of the score of any row in them."""
        parts = self.halves(query.astype(np.float64))
        bounds = [c @ p + np.sqrt(p @ p) * r for c, p, r in zip(self.centres, parts, self.radii, strict=True)]
        first, second = (np.argsort(-b, kind="stable") for b in bounds)
        u, v = bounds[0][first], bounds[1][second]
        heap, seen = [(-(u[0] + v[0]), 0, 0)], {(0, 0)}
        while heap:
            bound, a, b = heapq.heappop(heap)
            if self.tiles_of[first[a], second[b]]:
                # Rounding may have taken something off; scores are whole numbers.
                yield -bound + 1 + abs(bound) * 1e-9, int(first[a]), int(second[b])
            for x, y in ((a + 1, b), (a, b + 1)):
                if x < len(u) and y < len(v) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (-(u[x] + v[y]), x, y))


def placed(rows: DataFrame, cells: Cells) -> DataFrame:
    """`rows` with their codes i and j, and their distances from them."""

    def place(batches):
        for batch in batches:
            parts = cells.halves(matrix(batch.column("v"), cells.dim))
            (i, e1), (j, e2) = (nearest(p, c) for p, c in zip(parts, cells.centres, strict=True))
            columns = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(e1), pa.array(e2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "i", "j", "e1", "e2"])

    return rows.mapInArrow(place, ROW + ", i int, j int, e1 double, e2 double")


def build_index(rows: DataFrame) -> tuple[Cells, DataFrame]:
    """The cells of (vec_id, label, v), a stored table, and the table (i, j, tile, rows) of all rows."""
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim = size["dim"] or 0
    codes = min(MOST_CODES, max(1, round(math.sqrt(size["n"] / CELL))))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    cells = Cells(dim, dim // 2, [], [], np.zeros((0, 0)))
    cells.centres = [codebook(part, codes) for part in cells.halves(matrix(sample, dim))]
    cells.radii = [np.zeros(len(c)) for c in cells.centres]
    cells.tiles_of = np.zeros([len(c) for c in cells.centres], dtype=np.int64)
    table = materialize(placed(rows, cells), "placed")
    for radius, code, apart in zip(cells.radii, ("i", "j"), ("e1", "e2"), strict=True):
        for row in table.groupBy(code).agg(F.max(apart).alias("most")).collect():
            radius[row[code]] = row["most"]
    counts = materialize(table.groupBy("i", "j").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "cells")
    for row in counts.collect():
        cells.tiles_of[row["i"], row["j"]] = row["tiles"]
    tile = F.pmod(F.xxhash64("vec_id"), "tiles").cast("int").alias("tile")
    packed = table.join(counts, ["i", "j"]).groupBy("i", "j", tile).agg(
        F.collect_list(F.struct("vec_id", "label", "v")).alias("rows")
    )
    return cells, materialize(packed, "tiles")


def visiting(cells: Cells, queries: DataFrame, start: int, end: int) -> DataFrame:
    """Per query (query, label, v, goals) and cell from place `start` to `end` of its order a row with each of
    the cell's tiles, and the bound of all cells behind `end` (minus infinity: there are none)."""

    def rows(batches):
        for batch in batches:
            points = matrix(batch.column("v"), cells.dim)
            for k in range(batch.num_rows):
                found, bound = [], -math.inf
                for place, (most, i, j) in enumerate(cells.in_order(points[k])):
                    if place >= end:
                        bound = most
                        break
                    if place >= start:
                        found += [(i, j, t) for t in range(cells.tiles_of[i, j])]
                if not found:
                    continue
                at = pa.array(np.full(len(found), k))
                columns = [pa.array(np.array(c, dtype=np.int32)) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(at) for c in batch.columns), *columns, pa.array(np.full(len(found), bound))],
                    names=[*batch.schema.names, "i", "j", "tile", "bound"],
                )

    schema = "query bigint, label bigint, v array<int>, goals array<bigint>"
    return queries.select("query", "label", "v", "goals").mapInArrow(rows, schema + ", i int, j int, tile int, bound double")


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by descending score, then ascending id."""
    if len(scores) > k:
        last = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= last)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _compared(tiles: DataFrame, dim: int, visits: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """(query, goal, vec_id, score): a tile's first k rows for each visiting query and goal.

    Without goals (goal null): rows of the query's label but itself. Else, for
    each goal, rows of other labels that score from `low` to `high` percent of it.
    """
    blocks = F.pmod(F.xxhash64("query"), F.lit(max(1, -(-visits.select("query").distinct().count() // QUERIES)))).cast("int")
    asked = visits.groupBy("i", "j", "tile", blocks.alias("block")).agg(
        F.collect_list(F.struct("query", "label", "v", "goals")).alias("queries")
    )
    # Merged, as all joins that grow with anchors or rows: visits repeat their vectors, so the files
    # of both sides are a small part of what a broadcast of them would take.
    met = tiles.hint("merge").join(asked.hint("merge"), ["i", "j", "tile"]).select("rows", "queries")

    def rows(batches):
        for whole in batches:
            out: list[tuple] = []
            for at in range(whole.num_rows):
                have, ask = (whole.column(c).slice(at, 1).flatten() for c in ("rows", "queries"))
                ids, labels = (have.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
                table = products(matrix(ask.field("v"), dim), matrix(have.field("v"), dim))
                keys, kinds, goals = (ask.field(c).to_pylist() for c in ("query", "label", "goals"))
                for scores, key, kind, wanted in zip(table, keys, kinds, goals, strict=True):
                    if wanted is None:
                        fit = np.flatnonzero((labels == kind) & (ids != key))
                        chosen = fit[best_of(scores[fit], ids[fit], k)]
                        out += [(key, None, int(ids[c]), int(scores[c])) for c in chosen]
                        continue
                    other = labels != kind
                    for goal in wanted:
                        # In Python's integers the limits can't overflow.
                        least, most = -(-low * goal // 100), high * goal // 100
                        fit = np.flatnonzero(other & (scores >= least) & (scores <= most))
                        chosen = fit[best_of(scores[fit], ids[fit], k)]
                        out += [(key, goal, int(ids[c]), int(scores[c])) for c in chosen]
            names = ["query", "goal", "vec_id", "score"]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)

    return met.mapInArrow(rows, "query bigint, goal bigint, vec_id bigint, score bigint")


def search(index: tuple[Cells, DataFrame], queries: DataFrame, k: int, low: int = 0, high: int = 0) -> DataFrame:
    """(query, goal, vec_id, score, rank): the first k rows per query and goal; see `_compared`.

    `queries`: (query, label, v, goals), a stored table.
    """
    cells, tiles = index
    found, open_ones, start, end = None, queries, 0, FIRST
    while True:
        visits = materialize(visiting(cells, open_ones, start, end), "visits")
        if visits.isEmpty():
            break
        fresh = _compared(tiles, cells.dim, visits, k, low, high)
        every = fresh if found is None else found.select("query", "goal", "vec_id", "score").unionByName(fresh)
        order = Window.partitionBy("query", "goal").orderBy(F.desc("score"), "vec_id")
        found = materialize(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "found")
        bounds = visits.groupBy("query").agg(F.max("bound").alias("bound")).where(F.col("bound") > -math.inf)
        last = found.where(F.col("rank") == k).select("query", "goal", F.col("score").alias("last"))
        left = open_ones.hint("merge").join(bounds, "query").withColumn("goal", F.explode_outer("goals"))
        left = left.alias("l").hint("merge").join(
            last.alias("f"), (F.col("l.query") == F.col("f.query")) & F.col("l.goal").eqNullSafe(F.col("f.goal")), "left"
        )
        # A row still unseen could be among the first k, and in the window.
        needed = F.coalesce(F.col("l.bound") >= F.col("f.last"), F.lit(True))
        needed &= F.coalesce(100 * F.col("l.bound") >= low * F.col("l.goal"), F.lit(True))
        still = left.where(needed).select(F.col("l.query").alias("query")).distinct()
        open_ones = materialize(open_ones.hint("merge").join(still, "query", "left_semi"), "open")
        start, end = end, end * 4
    return found


def mine(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `rows`: (vec_id, label, v) as `integers` gives them; `anchors`: the condition that chooses anchors.
    """
    columns = "query bigint, anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = materialize(rows, "vectors")
    none = F.lit(None).cast("array<bigint>")
    queries = materialize(rows.where(anchors).select(F.col("vec_id").alias("query"), "label", "v", none.alias("goals")), "anchors")
    if queries.isEmpty():
        return rows.sparkSession.createDataFrame([], columns).drop("query")
    index = build_index(rows)
    near = search(index, queries, positives)
    if near is None:
        return rows.sparkSession.createDataFrame([], columns).drop("query")
    near = near.select("query", F.col("vec_id").alias("positive_id"), F.col("score").alias("goal"))
    # No score lies between 80 and 100 percent of a negative one.
    goals = near.where(F.lit(low) * F.col("goal") <= F.lit(high) * F.col("goal"))
    goals = goals.groupBy("query").agg(F.collect_set("goal").alias("goals"))
    asked = materialize(queries.drop("goals").hint("merge").join(goals, "query"), "goals")
    hard = search(index, asked, negatives, low, high)
    if hard is None:
        return rows.sparkSession.createDataFrame([], columns).drop("query")
    return near.hint("merge").join(hard, ["query", "goal"]).select(
        F.col("query").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        F.col("goal").alias("positive_score"), F.col("score").alias("negative_score"),
    )
