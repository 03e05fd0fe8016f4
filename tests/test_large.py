"""What larger tables asked of operators: plans and ways that small tables do not show by their results."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import basins, graph, grid, joins, tiles


def test_sampling_sends_no_nodes_through_the_driver(spark):
    points = spark.range(50).select(F.col("id").alias("pid"), (F.col("id") % 9).cast("double").alias("a"), F.lit(4.5).alias("b"))
    cells = spark.range(100).select(F.floor(F.col("id") / 10).alias("i"), (F.col("id") % 10).alias("j"), F.col("id").cast("double").alias("h"))
    out = grid.sample(grid.cubic_nodes(points, "a", "b", 10, 10), cells, "h", ["pid"])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["pid"]: round(r["h"], 6) for r in out.collect()} == {p: p % 9 * 10 + 4.5 for p in range(50)}


def test_nearest_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (700, 6)).astype(np.float32)  # many ties
    v[100:400] = v[0]  # and copies
    rows = [(n, [float(x) for x in r]) for n, r in enumerate(v)] + [(700, None), (701, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (720, None)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = joins.nearest_vectors(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 3)
    want = set()
    for q in range(0, 721, 20):
        far = {n: np.inf if q >= 700 or n >= 700 else float(((v[n].astype(float) - v[q]) ** 2).sum()) for n, _ in rows if n != q}
        want |= {(q, n, r + 1) for r, n in enumerate(sorted(far, key=lambda n: (far[n], n))[:3])}
    assert {(r["q"], r["vec_id"], r["rank"]) for r in got.collect()} == want


def test_guessed_sizes_do_not_grow_in_loops(spark):
    state = graph.settled(spark.range(8).select("id", F.col("id").alias("p")))
    for _ in range(8):
        state = graph.settled(state.join(state.select(F.col("id").alias("p"), F.col("p").alias("q")), "p").select("id", F.col("q").alias("p")))
    guess = state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert len(str(guess)) < 25  # a checkpoint alone has over 1,000 digits here
    assert sorted(map(tuple, state.collect())) == [(n, n) for n in range(8)]


def test_pieces_within_a_radius(spark):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.uniform(-1, 1, (400, 3)), rng.uniform(-0.05, 0.05, (60, 3)) + 3, np.full((40, 3), -2.0)])
    group = [int(g) if g < 3 else None for g in rng.integers(0, 4, len(p))]
    rows = [(n, group[n], *map(float, x)) for n, x in enumerate(p)]
    made = spark.createDataFrame(rows, "id long, g int, x double, y double, z double").repartition(4)
    got = {r["id"]: r["piece"] for r in graph.radius_components(made, "id", "g", ["x", "y", "z"], 0.3).collect()}
    near = ((p[:, None] - p[None]) ** 2).sum(2) <= 0.3 * 0.3
    want = {}
    for n in range(len(p)):
        if n not in want:
            todo, want[n] = [n], n
            while todo:
                at = todo.pop()
                for m in np.flatnonzero(near[at]).tolist():
                    if m not in want and group[m] is not None and group[m] == group[at]:
                        want[m] = n
                        todo.append(m)
    assert got == want


def lowest_levels(h, drain):
    """Filled levels of a grid by a heap over its cells; nan: no cell."""
    level, heap = np.full(h.shape, np.inf), [(h[c], c) for c in map(tuple, np.argwhere(drain).tolist())]
    for v, c in heap:
        level[c] = v
    heapq.heapify(heap)
    while heap:
        v, (i, j) = heapq.heappop(heap)
        for n in [(i + a, j + b) for a, b in grid.D8 if 0 <= i + a < h.shape[0] and 0 <= j + b < h.shape[1]]:
            if h[n] == h[n] and max(v, h[n]) < level[n]:
                level[n] = max(v, h[n])
                heapq.heappush(heap, (level[n], n))
    return np.where(np.isfinite(level), level, h)


@pytest.mark.parametrize("most", [10**9, 0])  # by the driver's heap, and in rounds
def test_floods_meet_over_tiles(spark, most):
    rng = np.random.default_rng(7)
    h = np.round(rng.uniform(0, 9, (29, 21)), 1)
    h[5, :] = h[6:9, 4] = h[20:24, 15] = np.nan  # a wall and gaps
    h[12:20, 3:12] = 2.0  # a plain
    drain = np.zeros(h.shape, bool)
    drain[-1, 3:6] = drain[17, 20] = True
    rows = [(i * 21 + j, i, j, float(h[i, j]), bool(drain[i, j])) for i in range(29) for j in range(21) if h[i, j] == h[i, j]]
    cells = spark.createDataFrame(rows, "cid long, i long, j long, h double, d boolean").repartition(5)
    got = {r["cid"]: r["filled"] for r in tiles.flood(cells, F.col("d"), 8, most).collect()}
    want = lowest_levels(h, drain).ravel()
    assert got == {c: want[c] for c, *_ in rows}
    assert sum(want[c] > v for c, _, _, v, _ in rows) > 100


def test_basins_with_over_a_million_contacts_merge(spark):
    c = spark.range(600 * 600).select(F.col("id").alias("cid"), F.floor(F.col("id") / 600).alias("i"), (F.col("id") % 600).alias("j"), F.col("id").alias("basin"))
    drains = c.select("basin", F.lit(None).cast("long").alias("into"))
    got = basins.merge_undersize(c, drains, 2, 3).groupBy("basin").count().groupBy("count").count().collect()
    sizes = {r[0]: r[1] for r in got}
    assert sum(n * k for n, k in sizes.items()) == 360_000 and max(sizes) <= 3
    # only those stay alone whose neighbours have no room
    assert sizes.get(1, 0) < 10_000
