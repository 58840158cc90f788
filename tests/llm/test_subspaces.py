"""Near-duplicate vectors: all pairs by brute force, hot groups over many tiles, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import subspaces
from attestra.llm.queries import QUERIES


def brute(rows, least=0.95):
    """Links and smallest reachable key per row, comparing all pairs."""
    out = []
    fit = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    near = [[] for _ in rows]
    scaled = [np.array(v) / max(map(abs, v)) if ok else v for (_, v), ok in zip(rows, fit)]
    for i, a in enumerate(scaled):
        for j, b in enumerate(scaled[:i]):
            if fit[i] and fit[j] and len(a) == len(b) and np.dot(a, b) >= least * np.linalg.norm(a) * np.linalg.norm(b):
                near[i].append(j)
                near[j].append(i)
    for i, (key, _) in enumerate(rows):
        seen, queue = {i}, [i]
        while queue:
            queue += (new := [j for j in near[queue.pop()] if j not in seen])
            seen.update(new)
        keys = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(keys) if keys else None
        out.append((key, len(near[i]), low, None if None in (key, low) else key == low))
    return sorted(out, key=repr)


def vectors(seed, dims=24, groups=12, chain=15):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(groups, dims))
    rows = [c + random.normal(size=dims) * s for c in centres for s in (0.02, 0.1, 0.2, 0.25, 0.3, 0.35) for _ in range(3)]
    a, b = np.linalg.qr(random.normal(size=(dims, 2)))[0].T
    rows += [np.cos(0.3 * k) * a + np.sin(0.3 * k) * b for k in range(chain)]  # neighbours link, others do not
    rows += [random.normal(size=dims) for _ in range(60)]
    rows += [rows[0] * 7, rows[0], rows[0], -rows[0]]
    order = random.permutation(len(rows))
    return [(int(k), [float(x) for x in rows[n]]) for k, n in enumerate(order)]


def answer(df, **kw):
    return sorted((tuple(r) for r in subspaces.near_duplicates(df, **kw).collect()), key=repr)


@pytest.mark.parametrize("tile, cell, matrix", [(8192, 8192, 1 << 19), (7, 40, 30)])
def test_all_pairs(spark, monkeypatch, tile, cell, matrix):
    monkeypatch.setattr(subspaces, "TILE_ROWS", tile)
    monkeypatch.setattr(subspaces, "CELL_ROWS", cell)
    monkeypatch.setattr(subspaces, "MATRIX_CELLS", matrix)
    for seed, dims in ((1, 24), (2, 64)) if tile > 100 else ((3, 40),):
        rows = vectors(seed, dims)
        got = answer(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert got == brute(rows) and sum(r[1] > 0 for r in got) > 50


def test_hot_group_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(subspaces, "TILE_ROWS", 16)
    random = np.random.default_rng(8)
    centre = random.normal(size=32)
    rows = [(k, (centre + 0.05 * random.normal(size=32) if k % 2 else random.normal(size=32)).tolist()) for k in range(160)]
    assert answer(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == brute(rows)


def test_every_link_counts_once():
    """Over all blocks each link is found exactly once, in its first block within the budget."""
    rows = np.array([v for _, v in vectors(5, 48)])
    space = subspaces.fitted(rows, 0.95, 4)
    assert len(space.pivots) == 3
    found = [(int(i), int(j)) for k in range(3) for a, b in subspaces.compared(space, k, 0.95, rows, rows, True) for i, j in zip(a, b)]
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    assert sorted(found) == [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.95, 1)))]
    for k, points in enumerate(space.blocks(rows)):
        home, reach = space.cells(k, points)
        apart = ((points[:, None] - points[None]) ** 2).sum(axis=2)
        for i, j in zip(*np.nonzero(apart <= space.budgets[k])):
            assert home[i] >= home[j] or reach[i, home[j]]


def test_few_directions(spark):
    """Vectors of a plane: blocks in which they do not differ are left out."""
    random = np.random.default_rng(9)
    rows = [(k, [float(x) for x in np.r_[random.normal(size=2), np.zeros(46)]]) for k in range(80)]
    space = subspaces.fitted(np.array([v for _, v in rows]), 0.95, 4)
    assert len(space.budgets) < 3 and abs(sum(space.budgets) - 0.1) < 1e-5
    assert answer(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == brute(rows)


def test_odd_rows(spark):
    one, two = [1.0, 2.0, 3.0], [1.0, 2.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [float("nan")] * 3), (5, [1.0, None, 1.0]), (6, [float("inf"), 1.0, 1.0]), (9, one), (8, one), (8, one), (None, one),
            (None, None), (10, two), (7, two), (11, [5.0]), (12, [1e-300, 2e-300, 3e-300]), (15, [1e300, 2e300, 3e300]), (13, [-0.0, 1.0, 0.0]), (14, [0.0, 1.0, -0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clash = df.select("*", *[F.lit(0).alias(c) for c in ("key", "vector", "node", "weight", "share", "block", "cell", "home", "links", "root", "kept")])
    wanted = brute(rows)
    assert answer(df) == wanted and answer(clash) == wanted
    assert answer(df.limit(0)) == []
    narrow = df.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).where("vec_id in (7, 8, 9, 10)")
    assert answer(narrow) == [(10, 1, 7, False), (7, 1, 7, True), (8, 2, 8, True), (8, 2, 8, True), (9, 2, 8, False)]


def test_query(spark, small):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op11_near_vectors"](spark, small).collect()), key=repr) == brute(rows)
