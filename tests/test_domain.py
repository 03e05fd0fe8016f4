"""Basins, lines, images and parameters against brute force."""

import dataclasses
import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import basins, graph, jobs, raster, tileflood, windows
from tessella.plans import domain_queries, params
from tessella.sources import images


def masked(spark, m):
    rows = [(i * m.shape[1] + j, i, j) for i, j in zip(*np.nonzero(m))]
    return spark.createDataFrame([tuple(map(int, r)) for r in rows], "cid long, i long, j long")


def test_rings_of_blocks_and_of_a_hole(spark):
    m = np.zeros((8, 8), bool)
    m[1:3, 1:3] = m[3, 3] = True  # a block with a cell at its corner
    m[5:7, 5:7] = True
    r = raster.rings(masked(spark, m), F.lit(True))
    got = windows.ring_area(r, ["ring"], "seq", "x", "y").collect()
    assert sorted(x["area"] for x in got) == [4, 5]
    m = np.zeros((6, 6), bool)
    m[1:5, 1:5] = True
    m[2:4, 2:4] = False
    got = raster.ring_areas(raster.rings(masked(spark, m), F.lit(True))).collect()
    assert sorted(x["area"] for x in got) == [-4, 16]
    assert raster.rings(masked(spark, m).where("cid < 0"), F.lit(True)).count() == 0


def walked_rings(m):
    """Rings of a mask as lists of (x, y, ex, ey), each from its least edge, by walking along the edges."""
    m = np.pad(m, 1)
    steps = [(1, 0), (0, 1), (-1, 0), (0, -1)]
    starts = {}  # (corner, direction) of every edge
    for i, j in zip(*map(lambda a: a.tolist(), np.nonzero(m))):
        for d, (beside, corner) in enumerate((((0, -1), (0, 0)), ((1, 0), (1, 0)), ((0, 1), (1, 1)), ((-1, 0), (0, 1)))):
            if not m[i + beside[0], j + beside[1]]:
                starts[i - 1 + corner[0], j - 1 + corner[1], d] = True
    out = []
    for e in sorted(starts):
        ring, at = [], e
        while starts.get(at):
            starts[at] = False
            x, y, d = at
            ex, ey = x + steps[d][0], y + steps[d][1]
            ring.append((x, y, ex, ey))
            at = next((ex, ey, (d + t) % 4) for t in (-1, 0, 1) if (ex, ey, (d + t) % 4) in starts)
        if ring:
            out.append(ring)
    return out


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_rings_close_over_tiles(spark, one_task):
    m = np.random.default_rng(3).uniform(size=(40, 37)) < 0.7
    rows = raster.rings(masked(spark, m), F.lit(True), 4, one_task).orderBy("ring", "seq").collect()
    got = {}
    for r in rows:
        assert r["seq"] == len(got.setdefault(r["ring"], []))
        got[r["ring"]].append((r["x"], r["y"], r["ex"], r["ey"]))
    want = walked_rings(m)
    assert max(map(len, want)) > 100 and list(got.values()) == want


def thinned(m):
    m = np.pad(m, 1).astype(int)
    while True:
        before = m.sum()
        for odd in (0, 1):
            gone = []
            for i, j in zip(*np.nonzero(m)):
                p = [m[i + a, j + b] for a, b in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
                turns = sum(p[k] == 0 and p[(k + 1) % 8] == 1 for k in range(8))
                sides = (p[0] * p[2] * p[6], p[0] * p[4] * p[6]) if odd else (p[0] * p[2] * p[4], p[2] * p[4] * p[6])
                if 2 <= sum(p) <= 6 and turns == 1 and not any(sides):
                    gone.append((i, j))
            for c in gone:
                m[c] = 0
        if m.sum() == before:
            return m[1:-1, 1:-1].astype(bool)


def test_thinning_is_zhang_and_suens(spark):
    m = np.zeros((14, 16), bool)
    m[2:9, 2:7] = m[5:8, 2:15] = m[9:13, 10:14] = True
    got = {(r["i"], r["j"]) for r in raster.thin(masked(spark, m), F.lit(True)).collect()}
    assert got == set(zip(*map(lambda a: a.tolist(), np.nonzero(thinned(m)))))


def test_thinning_goes_over_tiles(spark):
    rng = np.random.default_rng(11)
    m = rng.uniform(size=(50, 43)) < 0.97  # a nearly full mask over 4 x 4 tiles, 20 layers deep
    m[30:, 20:25] = False
    got = {(r["i"], r["j"]) for r in raster.thin(masked(spark, m), F.lit(True), 14).collect()}
    assert got == set(zip(*map(lambda a: a.tolist(), np.nonzero(thinned(m)))))
    m = np.zeros((20, 20), bool)
    assert raster.thin(masked(spark, m), F.lit(True), 8).count() == 0


def test_flood_with_slope_is_a_heap_flood(spark):
    rng = np.random.default_rng(2)
    h = np.round(rng.uniform(0, 10, (17, 13)), 2)
    level = np.full(h.shape, np.inf)
    level[0, 0], level[16, 5] = h[0, 0], h[16, 5]
    heap = [(h[0, 0], 0, 0), (h[16, 5], 16, 5)]
    while heap:
        v, i, j = heapq.heappop(heap)
        for a in range(max(i - 1, 0), min(i + 2, 17)):
            for b in range(max(j - 1, 0), min(j + 2, 13)):
                if max(h[a, b], v + 0.1) < level[a, b]:
                    level[a, b] = max(h[a, b], v + 0.1)
                    heapq.heappush(heap, (level[a, b], a, b))
    rows = [(i * 13 + j, i, j, float(h[i, j]), (i, j) in ((0, 0), (16, 5))) for i in range(17) for j in range(13)]
    cells = spark.createDataFrame(rows, "cid long, i long, j long, h double, seed boolean")
    got = {r["cid"]: r["level"] for r in basins.flood_with_slope(cells, 0.1, 5).collect()}
    assert np.allclose([got[c] for c in range(221)], level.ravel())
    none = basins.flood_with_slope(cells.where("i < 3").withColumn("seed", F.lit(False)), 0.1, 5)
    assert {r["level"] for r in none.collect()} == {None}


def test_oversize_basins_split_at_half(spark):
    # a line of nine cells draining to 0, and a pair
    links = spark.createDataFrame([(0, 0), *[(k, k - 1) for k in range(1, 9)], (20, 20), (21, 20)], "cid long, down long")
    got = {r["cid"]: r["basin"] for r in basins.split_oversize(links, 4).collect()}
    sizes = [list(got.values()).count(b) for b in set(got.values())]
    assert max(sizes) <= 4 and got[21] == got[20] == 20
    # nine cells: upstream counts 4 and 5 are as close to 4.5, and the lesser cell is cut
    assert got[8] != got[0] and all(got[k] == k or got[k] == got[k - 1] for k in range(1, 9))


def test_small_basins_merge_over_the_longest_border():
    sizes = [(1, 10), (2, 2), (3, 10), (4, 1)]
    contacts = [(1, 2, 3), (2, 3, 5), (3, 4, 1)]
    assert basins.merge_plan(sizes, {}, contacts, 3, 12) == {1: 1, 2: 1, 3: 3, 4: 3}  # 4 goes first, then 3 has no room for 2
    assert basins.merge_plan(sizes, {}, contacts, 3, 10) == {1: 1, 2: 2, 3: 3, 4: 4}  # no room at all
    assert basins.merge_plan(sizes, {}, contacts, 3, 20) == {1: 1, 2: 3, 3: 3, 4: 3}
    # 3 drains to 2 through 5: merging 2 and 3 would drain into itself
    loop = basins.merge_plan([(2, 2), (3, 10), (5, 10), (1, 10)], {3: 5, 5: 2}, [(2, 3, 9), (1, 2, 1), (3, 5, 1), (2, 5, 1)], 3, 20)
    assert loop[2] == 1  # of 1 and 5, whose borders are equal, the least id
    back = basins.merge_plan([(2, 2), (3, 10), (5, 10)], {2: 5, 5: 3}, [(2, 3, 9), (2, 5, 1)], 3, 20)
    assert back[2] == 5
    assert basins.merge_plan([], {}, [], 3, 20) == {}


def test_images_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    for kind, top in ((np.uint16, 65536), (np.uint8, 256)):
        pixels = rng.integers(0, top, (7, 5)).astype(kind)
        assert (images.decode(images.encode(pixels)) == pixels).all()
    cells = spark.createDataFrame([(t, i, j, float(t + i * 10 + j)) for t in (0, 1) for i in range(4) for j in range(3)], "t long, i long, j long, v double")
    back = images.from_images(images.to_images(cells, ["t"], "v"), ["t"]).collect()
    assert sorted(tuple(r) for r in back) == sorted((r["t"], r["i"], r["j"], int(r["v"])) for r in cells.collect())
    (tmp_path / "a.png").write_bytes(images.encode(np.eye(3, dtype=np.uint8)))
    assert images.from_images(images.read_images(spark, str(tmp_path)), ["path"]).agg(F.sum("value")).first()[0] == 3
    with pytest.raises(ValueError):
        images.decode(b"no image")


@dataclasses.dataclass
class Inner:
    rate: float = 1.0


@dataclasses.dataclass
class Outer:
    inner: Inner = dataclasses.field(default_factory=Inner)
    seed: int = 7


def test_parameters_refuse_unknown_keys_and_stale_inputs(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"inner": {"rate": 2.5}}')
    got = params.load(spark, Outer, str(tmp_path / "p.json"))
    assert got == Outer(Inner(2.5), 7)
    with pytest.raises(ValueError, match="inner.rat"):
        params.build(Outer, {"inner": {"rat": 1}})
    shared = str(tmp_path / "shared")
    params.write_shared(spark.range(3), shared, params.stamp(got))
    assert params.read_shared(spark, shared, params.stamp(got)).count() == 3
    with pytest.raises(ValueError):
        params.read_shared(spark, shared, params.stamp(Outer()))


def test_merged_basins_keep_every_cell(spark, data):
    from tessella.plans import catalogue

    got = catalogue.QUERIES["g9_partition"](spark, data).collect()
    assert sum(r["cells"] for r in got) == grid_cells(spark, data)
    assert max(r["cells"] for r in got) <= 40


def grid_cells(spark, data):
    return spark.read.parquet(f"{data}/orders.parquet").count()


def test_chamfer_reaches_all_of_a_large_land(spark):
    m = np.ones((24, 40), bool)  # land, with the sea at one side and a wall of missing cells
    m[2:, 20] = False
    cells = masked(spark, m)
    got = {(r["i"], r["j"]): r["d"] for r in raster.chamfer(cells, F.col("j") == 0).collect()}
    want = {(i, 0): 0 for i in range(24)}
    todo = [(0, c) for c in want]
    while todo:
        d, (i, j) = heapq.heappop(todo)
        if d > want[i, j]:
            continue
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                c, nd = (i + a, j + b), d + (4 if a and b else 3)
                if (a or b) and 0 <= c[0] < 24 and 0 <= c[1] < 40 and m[c] and nd < want.get(c, 1 << 30):
                    want[c] = nd
                    heapq.heappush(todo, (nd, c))
    assert max(want.values()) > 100 and len(want) == m.sum()
    assert got == want


def test_ring_totals_of_a_thick_mask(spark, data):
    got = domain_queries.r14_ring_totals(spark, data).first()
    assert got["area"] > 0.5 * spark.read.parquet(f"{data}/orders.parquet").count()


def slow_flood(h, drain):
    """(order, receiver, level) by scanning a list for the next cell: a cell at the level it is reached at goes
    first, then the lowest, then the one reached first."""
    high, wide = h.shape
    seen, waiting, order = drain.copy(), [], []
    level, receiver = h.copy(), np.full(h.size, -1)
    steps = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    beside = lambda i, j: [(i + a, j + b) for a, b in steps if 0 <= i + a < high and 0 <= j + b < wide]
    turn = 0
    for i in range(high):
        for j in range(wide):
            if drain[i, j] and any(not drain[n] for n in beside(i, j)):
                waiting.append((1, h[i, j], turn, (i, j)))
                turn += 1
    while waiting:
        waiting.sort()
        i, j = waiting.pop(0)[3]
        order.append(i * wide + j)
        for n in beside(i, j):
            if not seen[n]:
                seen[n] = True
                receiver[n[0] * wide + n[1]] = i * wide + j
                level[n] = max(h[n], level[i, j])
                waiting.append((0, 0, turn, n) if h[n] <= level[i, j] else (1, h[n], turn, n))
                turn += 1
    return order, receiver.tolist(), level.ravel().tolist()


def test_flood_order_by_a_list():
    rng = np.random.default_rng(11)
    for trial in range(25):
        h = rng.integers(0, 6, (rng.integers(1, 12), rng.integers(1, 12))).astype(float)
        drain = rng.random(h.shape) < 0.05
        drain[0, :] = drain[-1, :] = drain[:, 0] = drain[:, -1] = True
        order, receiver, code, level = tileflood.flood_order(h, drain)
        want = slow_flood(h, drain)
        assert (order.tolist(), receiver.tolist(), level.tolist()) == want
        for c in range(h.size):
            if receiver[c] >= 0:
                di, dj = tileflood.D8[code[c]]
                assert receiver[c] == c + di * h.shape[1] + dj
            else:
                assert code[c] == 255
        acc = tileflood.gathered(order, receiver, np.ones(h.size))
        assert acc[receiver < 0].sum() == h.size


def test_tile_floods_cover_every_cell(spark):
    rows = [(i * 23 + j, i, j, None if (i, j) == (3, 3) else float((i * 7 + j * 5) % 11)) for i in range(17) for j in range(23) if (i + j) % 31]
    cells = spark.createDataFrame(rows, "cid long, i long, j long, h double")
    out = tileflood.tile_floods(cells, 8).toPandas().set_index("cid")
    assert len(out) == len(rows) and (out["depth"] >= 0).all() and out["acc"].sum() >= len(rows)
    inner = out[out["receiver"].notna()]
    assert (out.loc[inner["receiver"].astype(int), "rank"].to_numpy() < inner["rank"].to_numpy()).all()
    assert tileflood.tile_floods(cells.limit(0), 8).count() == 0


def test_spectral_slope_of_made_noise(spark):
    rng = np.random.default_rng(2)
    n = 64
    k = np.hypot(np.fft.fftfreq(n, 20.0)[:, None], np.fft.fftfreq(n, 20.0)[None, :])
    k[0, 0] = 1
    z = np.real(np.fft.ifft2(k**-1.5 * np.exp(2j * np.pi * rng.random((n, n)))))
    cells = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(n) for j in range(n)] + [(n, 0, 1.0)], "i long, j long, h double")
    got = tileflood.spectral_slopes(cells, n, 20.0, (60.0, 600.0)).collect()
    assert len(got) == 1 and abs(got[0]["beta"] - 3.0) < 0.5 and got[0]["n"] >= 8


def test_spill_levels_in_rounds_are_those_of_the_heap(spark):
    rng = np.random.default_rng(6)
    for trial in range(4):
        n = 40
        pairs = {tuple(sorted(p)): float(w) for p, w in zip(rng.integers(0, n, (90, 2)).tolist(), rng.integers(0, 12, 90)) if p[0] != p[1]}
        pairs |= {(-1, int(d)): float(w) for d, w in zip(rng.integers(0, n, 3), rng.integers(0, 9, 3))}
        rows = [(a, b, w) for (a, b), w in pairs.items()] + [(100, 101, 1.0)]  # no way out
        want = {k: v for k, v in graph.spill_levels(rows, {-1}).items() if k != -1}
        got = graph.spill_levels_in_rounds(spark.createDataFrame(rows, "a long, b long, w double"))
        assert {r["root"]: r["level"] for r in got.collect()} == want


def test_exclusive_top_reads_on_until_enough_stand(spark):
    rows = [(k, k // 30, k % 30, float(1000 - (k // 30 - 5) ** 2 - (k % 30 - 5) ** 2)) for k in range(900)] + [(900, 0, 0, None)]
    df = spark.createDataFrame(rows, "id long, i long, j long, s double")
    want = []
    for k, i, j, s in sorted((r for r in rows if r[3] is not None), key=lambda r: (-r[3], r[0])):
        if len(want) < 6 and all((i - a) ** 2 + (j - b) ** 2 >= 100 for _, a, b in want):
            want.append((k, i, j))
    for block in (7, 50, 2000):
        got = graph.exclusive_top(df, "s", "id", ("i", "j"), 6, 10.0, block)
        assert [(k, *p) for _, k, p in got] == want
    assert len(graph.exclusive_top(df, "s", "id", ("i", "j"), 50, 25.0, 100)) < 5


def test_jobs_one_of_a_kind_at_a_time(spark):
    there = spark.createDataFrame([("bake", "w", "t", "running"), ("bake", "v", "t", "done")], "kind string, world string, title string, state string")
    asked = spark.createDataFrame([(1, "bake", "w", "t"), (2, "bake", "v", "t"), (3, "bake", "v", "t"), (4, "zoom", None, None), (5, "zoom", None, "zoom")], "n int, kind string, world string, title string")
    got = jobs.submitted(there, asked, "n").orderBy("n").collect()
    assert [(r["n"], r["title"], r["state"]) for r in got] == [(2, "t", "queued"), (4, "zoom", "queued")]
