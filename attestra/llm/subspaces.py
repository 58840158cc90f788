"""Near-duplicate vectors by a pigeonhole over subspaces.

Unit vectors are rotated and their coordinates dealt to blocks of few dimensions. If two vectors lie within a squared
distance, some block holds at most that block's share of it (the budget). So every block is range-joined on its own: its space
is cut into the cells of a few pivots, and a vector visits the other cells that its budget reaches. What meets in a cell
and keeps within the block's budget is verified with the cosine of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, tabled
from .components import components

# Vectors that the rotation and the pivots are fitted on at most: those of the smallest hash of their id.
SAMPLE_ROWS = 16384
BLOCK_DIMS = 16
# Vectors a cell should hold, and vectors on each side of one comparison, which bounds the memory of a task.
CELL_ROWS = 8192
TILE_ROWS = 8192
LEAST_CELLS = 4
SHARES = 64
# Cells of one distance matrix.
MATRIX_CELLS = 1 << 19
# Widening of every budget against rounding; what it lets in is verified like the rest.
SLACK = 1e-6


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors times powers of two, which changes no cosine, so squares neither vanish nor overflow."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def units(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@dataclass(frozen=True)
class Space:
    """The rotation, the first coordinate of each block, the budgets and the pivots of each block."""
    turn: np.ndarray
    edges: list[int]
    budgets: list[float]
    pivots: list[np.ndarray]

    def blocks(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The blocks of the rotated unit vectors."""
        rotated = units(vectors) @ self.turn
        return [rotated[:, a:b] for a, b in zip(self.edges, self.edges[1:])]

    def cells(self, block: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home cell of every point, and which later cells a partner within the budget may be at home in.

        A point nearer to a pivot than to another lies on its side of the plane between them, so a partner there is at least as far
        away as the plane. Of two points in different cells the one at home in the earlier cell visits the other.
        """
        pivots = self.pivots[block]
        apart = (points ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1) - 2 * points @ pivots.T
        home = apart.argmin(axis=1)
        squares = (pivots ** 2).sum(axis=1)
        between = np.sqrt(np.maximum(0, squares[home][:, None] + squares - 2 * pivots[home] @ pivots.T))
        plane = apart - apart[np.arange(len(points)), home][:, None]
        reach = plane <= 2 * between * (np.sqrt(self.budgets[block]) + SLACK) + SLACK
        return home, reach & (np.arange(len(pivots)) > home[:, None])


def grouped(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of at most k groups of nearby points."""
    centres = np.unique(points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)], axis=0)
    for _ in range(rounds):
        nearest = ((centres ** 2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        sizes = np.bincount(nearest, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(1, sizes)[:, None], centres)
    return centres


def fitted(sample: np.ndarray, least: float, cells: int) -> Space:
    """A space for pairs of cosine `least`: principal axes dealt out so that all blocks get about equal variance.

    Inside a block the axes keep their order. The budget of a block is its share of the sample's squared distances. A block
    in which the sample does not differ gets none and is left out: the others then still add up to the whole distance.
    """
    unit = units(sample)
    _, axes = np.linalg.eigh(np.cov(unit.T).reshape(unit.shape[1], -1)) if len(unit) > 1 else (None, np.eye(unit.shape[1]))
    spread = (unit @ axes).var(axis=0)
    parts = max(1, round(unit.shape[1] / BLOCK_DIMS))
    dealt: list[list[int]] = [[] for _ in range(parts)]
    most = -(-unit.shape[1] // parts)
    for axis in np.argsort(-spread):
        open_ = [p for p in range(parts) if len(dealt[p]) < most]
        dealt[min(open_, key=lambda p: spread[dealt[p]].sum())].append(int(axis))
    floor = 1e-6 * spread.sum()
    dealt = [d for d in dealt if d and spread[d].sum() > floor] or [list(range(unit.shape[1]))]
    edges = np.cumsum([0] + [len(d) for d in dealt]).tolist()
    turn = axes[:, sum(dealt, [])]
    shares = np.array([max(spread[d].sum(), 1e-12) for d in dealt])
    budgets = (2 - 2 * least) * shares / shares.sum() * (1 + SLACK) + SLACK ** 2
    blocks = Space(turn, edges, budgets.tolist(), []).blocks(sample)
    return Space(turn, edges, budgets.tolist(), [grouped(b, cells) for b in blocks])


def sound(vector: Column) -> Column:
    """Whether a vector can be compared: not null or empty, no null or non-finite component, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False)) & F.exists(vector, lambda x: x != 0)


def compared(space: Space, block: int, least: float, left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all links whose first block within its budget is this one, so no block repeats another's link."""
    ours, theirs = space.blocks(left), space.blocks(right)
    lengths = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    squares = [((a ** 2).sum(axis=1), (b ** 2).sum(axis=1)) for a, b in zip(ours, theirs)]

    def within(k: int, i: np.ndarray | slice, j: np.ndarray | slice) -> np.ndarray:
        return squares[k][0][i][:, None] + squares[k][1][j] - 2 * ours[k][i] @ theirs[k][j].T <= space.budgets[k]

    rows = max(1, MATRIX_CELLS // max(1, len(right)))
    for at in range(0, len(left), rows):
        near = within(block, slice(at, at + rows), slice(None))
        if same:
            near &= np.arange(at, at + len(near))[:, None] < np.arange(len(right))
        i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(i):
            continue
        near = near[np.ix_(i, j)]
        for k in range(block):
            near &= ~within(k, i + at, j)
        near &= left[i + at] @ right[j].T >= least * lengths[0][i + at][:, None] * lengths[1][j]
        a, b = np.nonzero(near)
        yield i[a] + at, j[b]


def forest(size: int, found: Iterator[tuple[np.ndarray, np.ndarray]], degrees: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The smallest place of each place's group over the pairs found; adds the other end's weight to every end's degree."""
    label = np.arange(size)
    for i, j in found:
        np.add.at(degrees, i, weights[j])
        np.add.at(degrees, j, weights[i])
        while True:
            one, other = label[i], label[j]
            apart = one != other
            if not apart.any():
                break
            i, j, one, other = i[apart], j[apart], one[apart], other[apart]
            np.minimum.at(label, np.maximum(one, other), np.minimum(one, other))
            while not np.array_equal(label, below := label[label]):
                label = below
    return label


def links(nodes: DataFrame, least: float) -> DataFrame:
    """Columns node, links and root: what one comparison found for a node, the weight it is linked to and a node of its group.

    nodes has the columns node, weight and vector, different vectors of one length. Every row goes to one home and some visited cells
    a block; a cell of many rows is dealt to tiles, and every tile of homes meets every tile of the others there.
    """
    spark = nodes.sparkSession
    small_batches(spark)
    total = nodes.count()
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE_ROWS).select("vector").toPandas()["vector"]
    cells = min(max(LEAST_CELLS, -(-total // CELL_ROWS)), max(1, len(sample) // 8))
    space = fitted(np.array(list(sample), dtype=np.float64), least, cells)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            kept = batch[["node", "weight", "vector"]].reset_index(drop=True)
            blocks = space.blocks(np.array(list(batch["vector"]), dtype=np.float64))
            for block, points in enumerate(blocks):
                home, reach = space.cells(block, points)
                yield kept.assign(block=block, cell=home, home=True)
                row, cell = np.nonzero(reach)
                yield kept.iloc[row].assign(block=block, cell=cell, home=False)

    kind = nodes.schema["vector"].dataType.simpleString()
    schema = f"node long, weight long, vector {kind}, block int, cell int, home boolean"
    placed = nodes.mapInPandas(visit, schema)
    tiles = lambda flag: F.ceil(F.sum(F.when(F.col("home") == flag, 1).otherwise(0)) / TILE_ROWS).cast("int")
    sizes = placed.groupBy("block", "cell").agg(tiles(True).alias("homes"), tiles(False).alias("guests"))
    # one row per cell, of which there are as many as pivots at most
    dealt = placed.join(F.broadcast(sizes), ["block", "cell"])
    own = F.pmod(F.xxhash64("node", F.lit("tile")), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    span = lambda low, high: F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    one = F.lit(1)
    # tiles of homes are numbered from 0; on the right hand, homes come before guests
    left = F.transform(span(F.col("own"), F.col("homes") + F.col("guests") - one), lambda t: F.struct(F.col("own").alias("l"), t.alias("r"), F.lit(True).alias("left")))
    right = F.transform(span(F.lit(0), F.col("own")), lambda t: F.struct(t.alias("l"), F.col("own").alias("r"), F.lit(False).alias("left")))
    guest = F.transform(span(F.lit(0), F.col("homes") - one), lambda t: F.struct(t.alias("l"), (F.col("homes") + F.col("own")).alias("r"), F.lit(False).alias("left")))
    at = F.when(F.col("home"), F.concat(left, F.filter(right, lambda t: t["l"] < t["r"]))).otherwise(guest)
    sent = dealt.withColumn("own", own).withColumn("at", F.explode(at)).select("block", "cell", "at.*", "node", "weight", "vector")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        side = group["left"].to_numpy()
        mine, others = group[side], group[~side]
        same = bool(len(mine)) and int(group["l"].iloc[0]) == int(group["r"].iloc[0])
        others = mine.iloc[:0] if same else others
        if mine.empty or not (same or len(others)):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        both = pd.concat([mine, others])
        node, weight = both["node"].to_numpy(), both["weight"].to_numpy()
        vectors = scaled(np.array(list(both["vector"]), dtype=np.float64))
        first, second = vectors[:len(mine)], vectors[:len(mine)] if same else vectors[len(mine):]
        shift = 0 if same else len(mine)
        degrees = np.zeros(len(node), dtype=np.int64)
        found = ((i, j + shift) for i, j in compared(space, int(group["block"].iloc[0]), least, first, second, same))
        label = forest(len(node), found, degrees, weight)
        linked = np.flatnonzero(degrees)
        return pd.DataFrame({"node": node[linked], "links": degrees[linked], "root": node[label[linked]]})

    return sent.groupBy("block", "cell", "l", "r").applyInPandas(compare, "node long, links long, root long")


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """Columns key, n_links, component_id and kept: one row per row of the table.

    A link joins two rows whose cosine in double precision is `least` or more, whatever else they hold; component_id is the smallest
    key reachable over links, its own included, and kept tells whether that is the row's own. Equal vectors are compared once and
    count as often as they occur, also where a key is repeated. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do vectors of different lengths with each other. A null key names a component only where all
    its keys are null (kept is null there). Other columns are dropped. An empty table gives an empty result.
    """
    raw = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    # equal vectors may be very many: they are counted, and later named, in shares
    salted = raw.where(sound(F.col("vector"))).withColumn("share", F.pmod(F.xxhash64("key", F.lit("share")), F.lit(SHARES)))
    shares = stored(salted.groupBy("vector", "share").agg(F.count(F.lit(1)).alias("weight"), F.min("key").alias("least")))
    nodes = stored(shares.groupBy("vector").agg(F.sum("weight").alias("weight"), F.min("least").alias("least"))
                   .withColumn("node", F.monotonically_increasing_id()))
    dims = [r[0] for r in nodes.groupBy(F.size("vector").alias("d")).count().where("count > 1").orderBy("d").select("d").collect()]
    found = None
    for d in dims:
        part = tabled(links(nodes.where(F.size("vector") == d).select("node", "weight", "vector"), least))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "node long, links long, root long")
    roots = components(found, "node", "root").withColumnRenamed("root", "top")
    degrees = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(degrees, "node", "left").join(roots, "node", "left").withColumn("top", F.coalesce("top", "node"))
    lowest = named.groupBy("top").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "top").select("vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    named = shares.select("vector", "share").join(named, "vector")
    linked = salted.join(named, ["vector", "share"]).select("key", "n_links", "component_id")
    alone = raw.where(~sound(F.col("vector"))).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.unionByName(alone).select(F.col("key").alias(key), "n_links", "component_id", (F.col("key") == F.col("component_id")).alias("kept"))
