"""Raster operators: filters, distances, diffusion, talus flow, morphology.

One pass of a filter is one scatter-aggregate (or one running window for each axis). Operators of many
passes keep the state narrow and materialise it every few passes, so that plans do not grow.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tiles
from .graph import settled
from .grid import D8, SQRT2, edges, scatter, stencil

#: Passes between two materialisations of the state.
EVERY = 3


def _axis(df: DataFrame, value: str, across: str, along: str, weights: list[float]) -> DataFrame:
    """A symmetric filter along one axis, border values held."""
    half = len(weights) // 2
    w = Window.partitionBy(across).orderBy(along)
    total = F.lit(0.0)
    for o, g in zip(range(-half, half + 1), weights):
        at = F.col(value) if o == 0 else F.lag(value, -o).over(w) if o < 0 else F.lead(value, o).over(w)
        total = total + g * F.coalesce(at, F.col(value))
    return df.withColumn(value, total)


def smooth(cells: DataFrame, value: str, passes: int) -> DataFrame:
    """The separable 1-2-1 filter, any number of times."""
    out = cells
    for p in range(passes):
        out = _axis(_axis(out, value, "j", "i", [0.25, 0.5, 0.25]), value, "i", "j", [0.25, 0.5, 0.25])
        if p % EVERY == EVERY - 1:
            out = settled(out)
    return out


def gaussian(cells: DataFrame, value: str, sigma: float, radius: int) -> DataFrame:
    """Separable Gaussian, normalised over the cells that lie inside the grid."""
    weights = {o: math.exp(-(o * o) / (2 * sigma * sigma)) for o in range(-radius, radius + 1)}
    out = cells
    for across, along in (("j", "i"), ("i", "j")):
        w = Window.partitionBy(across).orderBy(along)
        at = {o: F.col(value) if o == 0 else F.lag(value, -o).over(w) if o < 0 else F.lead(value, o).over(w) for o in weights}
        top, low = F.lit(0.0), F.lit(0.0)
        for o, g in weights.items():
            top = top + F.coalesce(g * at[o], F.lit(0.0))
            low = low + F.when(at[o].isNotNull(), g).otherwise(0.0)
        out = out.withColumn(value, top / low)
    return out


def laplacian(cells: DataFrame, value: str) -> DataFrame:
    """(cid, i, j, value, lap): sum of the differences to the four edge neighbours."""
    wide = stencil(cells, [value], [D8[k] for k in (0, 2, 4, 6)], keep=["cid"])
    lap = F.lit(0.0)
    for k in range(4):
        lap = lap + F.coalesce(F.col(f"{value}_{k}") - F.col(value), F.lit(0.0))
    return wide.select("cid", "i", "j", value, lap.alias("lap"))


def diffuse(cells: DataFrame, value: str, rate: float, steps: int) -> DataFrame:
    """Explicit diffusion steps; stable up to rate 0.25."""
    out = cells.select("cid", "i", "j", value)
    for s in range(steps):
        out = laplacian(out, value).select("cid", "i", "j", (F.col(value) + rate * F.col("lap")).alias(value))
        if s % EVERY == EVERY - 1:
            out = settled(out)
    return out


def chamfer(cells: DataFrame, source: Column) -> DataFrame:
    """(cid, d): 3-4 chamfer distance to the source cells, over the grid's cells; those that no way leads to
    a source from are left out. Rounds go on until one changes nothing: as many as the longest way has cells."""
    far = settled(cells.select("cid", "i", "j", F.when(source, F.lit(0)).alias("d")))
    front = far.where("d is not null")
    while True:
        step = F.explode(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), (F.col("d") + (4 if a and b else 3)).alias("d")) for a, b in D8]))
        near = front.select(step.alias("t")).select("t.*").groupBy("i", "j").agg(F.min("d").alias("nd"))
        nxt = settled(far.join(near, ["i", "j"], "left").select("cid", "i", "j", "d", "nd"))
        front = nxt.where("nd is not null and (d is null or nd < d)").select("cid", "i", "j", F.col("nd").alias("d"))
        if front.isEmpty():
            break
        far = nxt.select("cid", "i", "j", F.least("d", "nd").alias("d"))
    return far.where("d is not null").select("cid", "i", "j", "d")


def near(cells: DataFrame, mask: Column, radius: int) -> DataFrame:
    """Cells within a chessboard distance of the mask: it sends its surroundings, one aggregation."""
    around = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]
    to = F.explode(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a, b in around]))
    hit = cells.where(mask).select(to.alias("t")).select("t.i", "t.j").distinct()
    return cells.join(hit, ["i", "j"], "left_semi")


def _length(k: int) -> float:
    return SQRT2 if k % 2 else 1.0


def cascade(cells: DataFrame, value: str, rate: float, threshold: float) -> DataFrame:
    """Symmetric talus relaxation between neighbours, one pass."""
    wide = stencil(cells, [value], keep=["cid"])
    flow = F.lit(0.0)
    for k in range(8):
        d = F.col(f"{value}_{k}") - F.col(value)
        over = F.abs(d) - threshold * _length(k)
        flow = flow + F.coalesce(F.when(over > 0, F.signum(d) * rate * over / 2 / 8).otherwise(0.0), F.lit(0.0))
    return wide.select("cid", "i", "j", (F.col(value) + flow).alias(value))


def thermal(cells: DataFrame, value: str, rate: float, talus: float) -> DataFrame:
    """Talus flow that conserves mass. Donors offer half of rate times the excess over the talus to each
    neighbour, scaled so that they never give over twice their largest offer; receivers add it up. The
    donors' scales go out with their values, so that a second scatter carries all flow."""
    wide = stencil(cells, [value], keep=["cid"])
    offers = [
        F.coalesce(F.greatest(F.lit(0.0), F.col(value) - F.col(f"{value}_{k}") - talus * _length(k)) * (rate / 2), F.lit(0.0))
        for k in range(8)
    ]
    total = offers[0]
    for o in offers[1:]:
        total = total + o
    scale = F.when(total > 0, F.least(F.lit(1.0), 2 * F.greatest(*offers) / total)).otherwise(0.0)
    given = wide.select("cid", "i", "j", value, scale.alias("_s"), *[o.alias(f"_o{k}") for k, o in enumerate(offers)])
    moves = F.explode(
        F.array(
            F.struct("i", "j", (-F.col("_s") * sum((F.col(f"_o{k}") for k in range(1, 8)), F.col("_o0"))).alias("d"), F.col("cid"), F.col(value).alias("v")),
            *[
                F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), (F.col("_s") * F.col(f"_o{k}")).alias("d"), F.lit(None).cast("long").alias("cid"), F.lit(None).cast("double").alias("v"))
                for k, (a, b) in enumerate(D8)
            ],
        )
    )
    moved = given.select(moves.alias("m")).select("m.*").groupBy("i", "j").agg(F.max("cid").alias("cid"), F.max("v").alias(value), F.sum("d").alias("_d"))
    return moved.where("cid is not null").select("cid", "i", "j", (F.col(value) + F.col("_d")).alias(value))


def peel(cells: DataFrame, mask: Column, rounds: int) -> DataFrame:
    """(cid, i, j, depth) of the mask's cells: 1 + the rounds (so many at most) that a cell outlasts when
    each takes off the cells without all eight neighbours."""
    state = cells.where(mask).select("cid", "i", "j", F.lit(1).alias("depth"))
    for r in range(1, rounds + 1):
        core = scatter(state.where(F.col("depth") == r), ["depth"], D8).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("k") == -1).cast("int")).alias("own"))
        core = core.where("n = 9 and own = 1").select("i", "j", F.lit(1).alias("_in"))
        state = state.join(core, ["i", "j"], "left").select("cid", "i", "j", (F.col("depth") + F.coalesce("_in", F.lit(0))).alias("depth"))
        state = settled(state)
    return state


def mask_components(cells: DataFrame, mask: Column) -> DataFrame:
    """(cid, label) of the 8-connected components of a mask, numbered by their least cell."""
    from .graph import components

    own = settled(cells.where(mask).select("cid", "i", "j"))
    pairs = edges(own, [], D8[:4]).select(F.col("cid").alias("a"), F.col("nid").alias("b"))
    return components(pairs, own)


def smooth_shore(cells: DataFrame, depth: str, lake: Column, reach: float, core: float, sigma: float, radius: int, keep: float) -> DataFrame:
    """(cid, value): a signed depth (below zero: ground over the water) with its shores smoothed. cells: cid, i, j.

    Where depth lies above -reach, what lies within `core` of the water's level is smoothed among such
    cells, and its zero is the new shore; depth and height beyond core stay on top of it, on the side that
    the cell is on then. A lake of which less than the share `keep` would stay water is left as it is, and
    so are all cells at or below -reach.
    """
    c = cells.select("cid", "i", "j", F.col(depth).cast("double").alias("d"), F.coalesce(lake, F.lit(False)).alias("lake"))
    c = c.withColumn("zone", F.col("d") > -reach)
    c = settled(c.withColumn("near", F.least(F.greatest(F.col("d"), F.lit(-core)), F.lit(core))))
    share = gaussian(c.select("cid", "i", "j", F.col("zone").cast("double").alias("v")), "v", sigma, radius).select("cid", F.col("v").alias("w"))
    mean = gaussian(c.select("cid", "i", "j", F.when(F.col("zone"), F.col("near")).otherwise(0.0).alias("v")), "v", sigma, radius)
    smooth = settled(c.where("zone").join(mean.select("cid", "v"), "cid").join(share, "cid").withColumn("e", F.col("v") / F.col("w")))
    label = mask_components(c, F.col("lake"))
    wet = label.join(smooth.select("cid", "e"), "cid", "left").groupBy("label").agg(F.avg((F.coalesce("e", F.lit(-1.0)) > 0).cast("int")).alias("share"))
    left = label.join(wet.where(F.col("share") < keep), "label", "left_semi").select("cid", F.lit(True).alias("left"))
    out = smooth.join(left, "cid", "left").withColumn("e", F.when(F.col("left"), F.col("near")).otherwise(F.col("e")))
    beyond = F.col("d") - F.col("near")
    value = F.col("e") + F.when(F.col("e") > 0, F.greatest(beyond, F.lit(0.0))).otherwise(F.least(beyond, F.lit(0.0)))
    return out.select("cid", value.alias("value")).unionByName(c.where("not zone").select("cid", F.col("d").alias("value")))


def thin(cells: DataFrame, mask: Column, tile: int = tiles.TILE) -> DataFrame:
    """(cid, i, j) of a mask thinned to lines one cell wide (Zhang and Suen): two kinds of sub-iterations
    take off border cells, each judged on the state before it, until neither finds any. A tile takes as many
    sub-iterations at once as its margin is wide, so that rounds are as many as the widest mask has margins."""
    margin = tile // 4 * 2  # even: both kinds take part
    own = settled(cells.where(mask).select("cid", "i", "j"))

    def step(table: pa.Table) -> pa.Table:
        got = tiles.with_margin(table, margin, tile)
        if got is None:
            return table.select(["ta", "tb", "bits", "moved"]).slice(0, 0)
        a, b, m, moved = got
        inner = (slice(margin, margin + tile),) * 2
        new = thinned(m, margin // 2)[inner] if moved else m[inner]
        return tiles.as_row(a, b, new, bool((new != m[inner]).any()))

    state = settled(tiles.packed(own, tile))
    while not state.where("moved").isEmpty():
        state = settled(tiles.surrounded(state).groupBy("ta", "tb").applyInArrow(step, tiles.BITS))
    return own.join(tiles.unpacked(state, tile), ["i", "j"]).select("cid", "i", "j")


def thinned(m: np.ndarray, most: int) -> np.ndarray:
    """A mask after up to `most` iterations of two sub-iterations; what lies beyond is empty."""
    high, wide = m.shape
    p = np.zeros((high + 2, wide + 2), bool)
    p[1:-1, 1:-1] = m
    # neighbours in a ring from the north, clockwise: i is the row
    ring = [p[1 + a : 1 + a + high, 1 + b : 1 + b + wide] for a, b in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
    n, e, s, w = ring[::2]
    for _ in range(most):
        taken = False
        for odd in (False, True):
            around, turns = (np.zeros((high, wide), np.int8) for _ in range(2))
            for k in range(8):
                around += ring[k]
                turns += ~ring[k] & ring[(k + 1) % 8]
            sides = (n & w & (e | s)) if odd else (e & s & (n | w))
            gone = p[1:-1, 1:-1] & (around >= 2) & (around <= 6) & (turns == 1) & ~sides
            p[1:-1, 1:-1] &= ~gone
            taken |= gone.any()
        if not taken:
            break
    return p[1:-1, 1:-1]


#: Segments of rings that one task ties together, whatever tile they begin in.
ONE_TASK = 100_000
#: Tiles of a level, a side, that make one of the next.
COARSER = 8
_SEGMENT = "key long, nxt long, n long, low long, at long"
_TIED = "part long, up long, off long, ring long, ring_at long, ring_n long, " + _SEGMENT


def rings(cells: DataFrame, mask: Column, tile: int = tiles.TILE, one_task: int = ONE_TASK) -> DataFrame:
    """Boundary rings of a mask's cells: ring, seq, x, y, and the next corner ex, ey. Cells' sides without a neighbour of the mask are
    directed edges with the mask on their left in (x = i, y = j); chained end to start, at a pinch to the
    right, so that blocks that touch at a corner are one ring (and holes that do are two). Outer rings have a
    positive area, holes a negative one. A ring is named by its least edge and begins there (i under 2^30 and j
    under 2^31, neither negative). Tiles chain their edges to segments, and coarser tiles the segments that
    leave the finer ones, until all are rings: as many levels as the grid's extent has digits."""

    def chain(table: pa.Table) -> pa.Table:
        got = tiles.with_margin(table, 2, tile)
        return none if got is None else _tile_edges(*got[:3], tile)

    schema = f"{_TIED}, x long, y long, ex long, ey long"
    none = pa.table({c.split()[0]: pa.array([], pa.int64()) for c in schema.split(", ")})
    state = tiles.packed(cells.where(mask).select("i", "j"), tile)
    edge = settled(tiles.surrounded(state).groupBy("ta", "tb").applyInArrow(chain, schema))
    levels, todo = [edge], _open(edge)
    while n := todo.count():
        tile *= COARSER
        x, y = F.shiftright("key", 33), F.shiftright(F.col("key").bitwiseAND((1 << 33) - 1), 2)
        by = (F.lit(0), F.lit(0)) if n <= one_task else (F.floor(x / tile), F.floor(y / tile))
        todo = todo.withColumns({"ta": by[0], "tb": by[1]})
        level = settled(todo.groupBy("ta", "tb").applyInArrow(_tie_segments, _TIED))
        levels.append(level)
        todo = _open(level)
    # from the top down: where a segment begins in its ring, and the ring's least edge, its place and length
    known = None
    for level in levels[::-1]:
        done = level.where("ring is not null").withColumn("from", F.col("off"))
        if known is not None:
            above = known.select(F.col("part").alias("up"), F.col("from").alias("_f"), F.col("ring").alias("_r"), F.col("ring_at").alias("_a"), F.col("ring_n").alias("_n"))
            rest = level.where("ring is null").join(above, "up")
            rest = rest.withColumns({"ring": F.col("_r"), "ring_at": F.col("_a"), "ring_n": F.col("_n"), "from": F.col("off") + F.col("_f")})
            done = done.unionByName(rest.select(*done.columns))
        known = done
    return known.select("ring", F.pmod(F.col("from") - F.col("ring_at"), F.col("ring_n")).alias("seq"), "x", "y", "ex", "ey")


def _open(level: DataFrame) -> DataFrame:
    """The segments that a level's tiles could not close: a row for each, at its first part."""
    return level.where("ring is null and off = 0").select("key", "nxt", "n", "low", "at")


def _tie(key: list, after: list, n: list, low: list, at: list) -> pa.Table:
    """Rows of _TIED: parts (key, the next one's index or -1 - its key, edges, least edge and its place) tied to
    longer segments, or closed to rings. up names the segment by its first part, off is the place in it."""
    size = len(key)
    begins = [True] * size
    for t in after:
        if t >= 0:
            begins[t] = False
    up, off, ring, ring_at, ring_n = ([None] * size for _ in range(5))
    seg: list = [(None,) * 5] * size
    for closed, heads in ((False, [p for p in range(size) if begins[p]]), (True, range(size))):
        for head in heads:
            if up[head] is not None:
                continue
            p, total, least, place, met = head, 0, None, 0, []
            while p >= 0 and up[p] is None:
                up[p], off[p] = key[head], total
                if least is None or low[p] < least:
                    least, place = low[p], total + at[p]
                total += n[p]
                met.append(p)
                p = after[p]
            if closed:
                for q in met:
                    ring[q], ring_at[q], ring_n[q] = least, place, total
            else:
                seg[head] = (key[head], -1 - p, total, least, place)
    columns = [key, up, off, ring, ring_at, ring_n, *zip(*seg)] if size else [[]] * 11
    names = [c.split()[0] for c in _TIED.split(", ")]
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(names, columns)})


def _tie_segments(table: pa.Table) -> pa.Table:
    key, nxt, n, low, at = (table.column(c).to_pylist() for c in ("key", "nxt", "n", "low", "at"))
    where = {k: p for p, k in enumerate(key)}
    return _tie(key, [where.get(t, -1 - t) for t in nxt], n, low, at)


def _tile_edges(a: int, b: int, m: np.ndarray, tile: int) -> pa.Table:
    """A tile's edges as rows of _TIED with their corners; m has a margin of two cells."""
    # side: (neighbour, start corner), counter-clockwise; a side ends where the next one starts
    sides = [((0, -1), (0, 0)), ((1, 0), (1, 0)), ((0, 1), (1, 1)), ((-1, 0), (0, 1))]
    side = np.zeros((4, tile + 4, tile + 4), bool)
    inner = slice(1, tile + 3)
    for k, ((da, db), _) in enumerate(sides):
        side[k, inner, inner] = m[inner, inner] & ~m[1 + da : tile + 3 + da, 1 + db : tile + 3 + db]
    own = np.zeros((tile + 4, tile + 4), bool)
    own[2:-2, 2:-2] = True
    number = np.full(side.shape, -1)
    dirs, i, j = np.nonzero(side & own)
    number[dirs, i, j] = np.arange(len(i))
    start = np.array([s for _, s in sides])
    x, y = i + start[dirs, 0], j + start[dirs, 1]
    ex, ey = i + start[(dirs + 1) % 4, 0], j + start[(dirs + 1) % 4, 1]
    after, nxt, found = np.full(len(i), -1), np.zeros(len(i), np.int64), np.zeros(len(i), bool)
    name = lambda x, y, d: ((x - 2 + a * tile) << 33) + (y - 2 + b * tile) * 4 + d
    for turn in (-1, 0, 1):  # to the right, straight on, to the left
        d = (dirs + turn) % 4
        ci, cj = ex - start[d, 0], ey - start[d, 1]
        here = side[d, ci, cj] & ~found
        after[here] = number[d, ci, cj][here]
        nxt[here] = name(ex, ey, d)[here]
        found |= here
    key = name(x, y, dirs)
    order = np.argsort(key)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.arange(len(key))
    to = np.where(after >= 0, rank[after], -1 - nxt)[order].tolist() if len(key) else []
    keys = key[order].tolist()
    out = _tie(keys, to, [1] * len(keys), keys, [0] * len(keys))
    for c, v, shift in (("x", x, a), ("y", y, b), ("ex", ex, a), ("ey", ey, b)):
        out = out.append_column(c, pa.array(v[order] - 2 + shift * tile))
    return out


def ring_areas(ring_rows: DataFrame) -> DataFrame:
    """(ring, sides, area) of rings' edges: one aggregation with map-side combining, however long a ring is."""
    twice = F.col("x") * F.col("ey") - F.col("ex") * F.col("y")
    return ring_rows.groupBy("ring").agg(F.count(F.lit(1)).alias("sides"), (F.sum(twice) / 2).alias("area"))
