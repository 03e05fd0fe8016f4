"""Operators that SQL does not express, against brute force."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import rules
from tessella.operators import graph, grid, iterate, raster
from tessella.plans import catalogue
from tessella.plans.registry import cloud
from tessella.plans.stages import Stage, run_stages
from tessella.sources.store import Store, content_hash
from tessella.streaming import series


def heap_flood(h):
    """Filled levels of a grid whose border drains."""
    n, m = h.shape
    out, heap = np.full(h.shape, np.inf), []
    for i in range(n):
        for j in range(m):
            if i in (0, n - 1) or j in (0, m - 1):
                out[i, j] = h[i, j]
                heapq.heappush(heap, (h[i, j], i, j))
    while heap:
        v, i, j = heapq.heappop(heap)
        for a, b in grid.D8:
            x, y = i + a, j + b
            if 0 <= x < n and 0 <= y < m and out[x, y] == np.inf:
                out[x, y] = max(v, h[x, y])
                heapq.heappush(heap, (out[x, y], x, y))
    return out


def test_flood_equals_a_heap(spark, data):
    rows = catalogue.QUERIES["g3_flood"](spark, data).collect()
    h, f = np.zeros(1500), np.zeros(1500)
    for r in rows:
        h[r["cid"]], f[r["cid"]] = r["h"], r["filled"]
    assert np.array_equal(heap_flood(h.reshape(50, 30)), f.reshape(50, 30))
    assert (f > h).sum() > 100


def test_cube_edges(spark, data):
    n = 8
    cells = grid.sphere_cells(spark, n)
    p = np.array([[r["x"], r["y"], r["z"]] for r in cells.orderBy("cid").collect()])
    near = grid.sphere_neighbours(cells, n).where("k % 2 = 0").collect()
    assert len(near) == 6 * n * n * 4
    d = np.array([np.linalg.norm(p[r["cid"]] - p[r["nid"]]) for r in near])
    assert d.max() < 0.3 and d.min() > 0.05  # a neighbour is beside its cell, wherever the edge lies
    pairs = {(r["cid"], r["nid"]) for r in near}
    assert all((b, a) in pairs for a, b in pairs)


def test_strahler(spark):
    edges = spark.createDataFrame([(0, 1, 9), (1, 2, 9), (2, 9, 7), (3, 5, 9), (4, 9, 8)], "id int, a int, b int")
    got = {r["id"]: r["order"] for r in graph.strahler(edges).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 1, 4: 2}
    ring = spark.createDataFrame([(0, 1, 2), (1, 2, 1)], "id int, a int, b int")
    assert {r["order"] for r in graph.strahler(ring).collect()} == {1}


def test_cycles_raise(spark):
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "cid long, down long")
    with pytest.raises(ValueError):
        graph.roots(ring, most=8)


def test_components(spark, data):
    lab = {r["cid"]: r["label"] for r in catalogue.QUERIES["g1_components"](spark, data).collect()}
    mask = {c: divmod(c, 30) for c in lab}
    at = {v: k for k, v in mask.items()}
    seen = {}
    for c in sorted(mask):
        if c in seen:
            continue
        todo, seen[c] = [c], c
        while todo:
            i, j = mask[todo.pop()]
            for a, b in grid.D8:
                o = at.get((i + a, j + b))
                if o is not None and o not in seen:
                    seen[o] = c
                    todo.append(o)
    assert seen == lab


def test_lattice_noise(spark):
    def mix(x, seed):
        m = 2**64 - 1
        z = (x + seed + 0x9E3779B97F4A7C15) & m
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & m
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
        z ^= z >> 31
        return (z >> 11) / 2**53 * 2 - 1

    rows = spark.range(0, 2000, 7).select("id", rules.lattice_noise(F.col("id"), 7).alias("u")).collect()
    assert max(abs(r["u"] - mix(r["id"], 7)) for r in rows) < 1e-12


def test_thermal_conserves(spark, data):
    rows = spark.createDataFrame([(i * 9 + j, i, j, float((i * 7919 + j * 104729) % 1000)) for i in range(9) for j in range(9)], "cid long, i long, j long, h double")
    out = raster.thermal(rows, "h", 0.5, 10.0)
    assert abs(out.agg(F.sum("h")).first()[0] - rows.agg(F.sum("h")).first()[0]) < 1e-6


def test_clusters(spark, data):
    rows = cloud(spark, data).orderBy("vec_id").collect()
    p = np.array([[r["x"], r["y"], r["z"]] for r in rows])
    first = {}
    for n, r in enumerate(rows):
        first.setdefault(r["label"], n)
    centres = p[[first[k] for k in sorted(first)[:8]]]
    for _ in range(6):
        own = (2 - 2 * p @ centres.T).argmin(1)
        sums = np.array([p[own == k].sum(0) for k in range(8)])
        centres = sums / np.linalg.norm(sums, axis=1)[:, None]
    own = (2 - 2 * p @ centres.T).argmin(1)
    got = {r["vec_id"]: r["cluster"] for r in catalogue.QUERIES["c1_clusters"](spark, data).collect()}
    assert [got[r["vec_id"]] for r in rows] == own.tolist()


def test_exclusive_top(spark, data):
    rows = catalogue.QUERIES["k3_exclusive_top"](spark, data).collect()
    at = [divmod(r["cid"], 30) for r in rows]
    assert all((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 >= 100 for n, a in enumerate(at) for b in at[:n])


def test_stages_resume(spark, tmp_path):
    store, ran = Store(spark, str(tmp_path / "w")), []

    def make(name, k):
        def run(s, p):
            ran.append(name)
            return {name: spark.range(p.get(k, 3))}

        return Stage(name, run, [name], [k])

    stages = [make("a", "x"), make("b", "y")]
    assert run_stages(store, stages, {"x": 2}) == ["a", "b"]
    assert run_stages(store, stages, {"x": 2}) == []
    assert run_stages(store, stages, {"x": 2, "y": 5}) == ["b"]
    assert run_stages(store, stages, {"x": 4, "y": 5}) == ["a", "b"]
    with pytest.raises(KeyError):
        run_stages(store, stages, {"z": 1})
    assert store.load("a").count() == 4 and store.has("b") and not store.has("c")


def test_content_hash_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = a.orderBy(F.desc("k")).select("v", "k")
    assert content_hash(a).first() == content_hash(b).first()
    assert content_hash(a).first() != content_hash(a.where("k = 1")).first()


def test_streams(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    out = series.run_once(series.windowed_means(stream), "means", "complete")
    assert out.agg(F.sum("n")).first()[0] == events.count()


def test_empty_grid(spark):
    none = spark.createDataFrame([], "cid long, i long, j long, h double")
    assert grid.steepest(none).count() == 0
    assert raster.near(none, F.col("h") > 0, 1).count() == 0
    assert iterate.fold_changes(none.withColumn("s", F.lit(0.0)).withColumn("d", F.lit(0.0)), "h", "s", "d").count() == 0


def test_greedy_accept_is_the_sequential_walk(spark):
    import numpy as np

    from tessella.operators import selection

    p = np.random.default_rng(3).uniform(size=(300, 3))
    old = np.array([[0.5, 0.5, 0.5]])
    kept: list[int] = []
    for k in range(len(p)):
        others = np.vstack([old, p[kept]])
        if (((others - p[k]) ** 2).sum(axis=1) > 0.15**2).all():
            kept.append(k)
    rows = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "id long, x double, y double, z double")
    there = spark.createDataFrame([tuple(map(float, old[0]))], "x double, y double, z double")
    got = selection.greedy_accept(rows, "id", ["x", "y", "z"], 0.15, there).collect()
    assert sorted(r["id"] for r in got) == kept
    assert selection.greedy_accept(rows.where("id < 0"), "id", ["x", "y", "z"], 0.15).count() == 0


def test_spread_sample_is_even_and_reproducible(spark):
    import numpy as np

    from tessella.operators import selection

    a = np.array([tuple(r) for r in selection.spread_sample(spark, 60, 8, 1).orderBy("id").collect()])
    b = np.array([tuple(r) for r in selection.spread_sample(spark, 60, 8, 1).orderBy("id").collect()])
    assert (a == b).all() and np.allclose((a[:, 1:] ** 2).sum(axis=1), 1)
    one = np.array([tuple(r) for r in selection.spread_sample(spark, 60, 1, 1).orderBy("id").collect()])
    closest = lambda p: (p[:, 1:] @ p[:, 1:].T - 2 * np.eye(60)).max()
    assert closest(a) < closest(one)


def test_ice_spreads_from_the_top_down(spark):
    import numpy as np

    from tessella.operators import ice

    rng = np.random.default_rng(5)
    z, w, icy = rng.uniform(0, 100, (9, 7)), rng.uniform(-1, 1, (9, 7)), rng.uniform(size=(9, 7)) < 0.7
    acc = np.zeros_like(z)
    off = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    for c in np.argsort(-z, axis=None):
        i, j = divmod(int(c), 7)
        acc[i, j] = max(0.0, acc[i, j] + w[i, j])
        low = [(a, b, (z[i, j] - z[a, b]) / (2**0.5 if k % 2 else 1)) for k, (a, b) in ((k, (i + d, j + e)) for k, (d, e) in enumerate(off)) if 0 <= a < 9 and 0 <= b < 7 and z[a, b] < z[i, j]]
        if icy[i, j]:
            for a, b, s in low:
                acc[a, b] += acc[i, j] * s / sum(x[2] for x in low)
    rows = [(i * 7 + j, i, j, float(z[i, j]), float(w[i, j]), bool(icy[i, j])) for i in range(9) for j in range(7)]
    cells = spark.createDataFrame(rows, "cid long, i long, j long, z double, w double, ice boolean")
    got = {r["cid"]: r["acc"] for r in ice.spread(cells).collect()}
    assert np.allclose([got[c] for c in range(63)], acc.ravel())
