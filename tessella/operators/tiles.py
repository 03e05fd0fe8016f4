"""Grids solved tile by tile in arrays, side by side; tiles meet by their borders.

A mask goes as one row of bits for each tile, so that a tile sees its surroundings by nine small rows. What a
step does to a cell depends on the cells beside it, so a tile with a margin of n cells can take n steps at once.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import DRAIN, spill_levels, spill_levels_in_rounds, settled
from .grid import D8, edges

#: Cells of a tile, a side.
TILE = 256
#: Edges between tiles that the driver's heap takes; more are solved in rounds.
MOST_BETWEEN = 300_000

BITS = "ta long, tb long, bits binary, moved boolean"


def tile_of(c: str, tile: int) -> Column:
    return F.floor(F.col(c) / tile).cast("long")


def packed(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """(ta, tb, bits, moved): a row for each tile that has cells (i, j), with a bit for each of its places."""

    def pack(table: pa.Table) -> pa.Table:
        i, j = (table.column(c).to_numpy() for c in ("i", "j"))
        m = np.zeros((tile, tile), bool)
        m[i % tile, j % tile] = True
        return as_row(int(i[0] // tile), int(j[0] // tile), m, True)

    own = cells.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), tile_of("i", tile).alias("ta"), tile_of("j", tile).alias("tb"))
    return own.groupBy("ta", "tb").applyInArrow(pack, BITS)


def as_row(a: int, b: int, m: np.ndarray, moved: bool) -> pa.Table:
    """A tile's row of bits."""
    return pa.table({"ta": pa.array([a], pa.int64()), "tb": pa.array([b], pa.int64()), "bits": pa.array([np.packbits(m).tobytes()], pa.binary()), "moved": pa.array([moved])})


def surrounded(state: DataFrame) -> DataFrame:
    """Every tile's bits at all nine tiles that it is, or lies beside: da and db tell from where they come."""
    to = F.explode(F.array(*[F.struct((F.col("ta") - a).alias("ta"), (F.col("tb") - b).alias("tb"), F.lit(a).alias("da"), F.lit(b).alias("db")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    return state.select(to.alias("t"), "bits", "moved").select("t.*", "bits", "moved")


def with_margin(table: pa.Table, margin: int, tile: int):
    """(ta, tb, mask with a margin, whether any of the tiles moved) of a tile's rows of `surrounded`; None if it has no cells itself."""
    m = np.zeros((3 * tile, 3 * tile), bool)
    own = False
    for a, b, bits in zip(*(table.column(c).to_pylist() for c in ("da", "db", "bits"))):
        m[(a + 1) * tile : (a + 2) * tile, (b + 1) * tile : (b + 2) * tile] = np.unpackbits(np.frombuffer(bits, np.uint8), count=tile * tile).reshape(tile, tile)
        own |= a == b == 0
    if not own:
        return None
    part = slice(tile - margin, 2 * tile + margin)
    return table.column("ta")[0].as_py(), table.column("tb")[0].as_py(), m[part, part], any(table.column("moved").to_pylist())


def unpacked(state: DataFrame, tile: int = TILE) -> DataFrame:
    """(i, j) of all cells of a state."""

    def unpack(batches):
        for batch in batches:
            for a, b, bits in zip(*(batch.column(c).to_pylist() for c in ("ta", "tb", "bits"))):
                i, j = np.nonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=tile * tile).reshape(tile, tile))
                yield pa.RecordBatch.from_arrays([pa.array(i + a * tile), pa.array(j + b * tile)], names=["i", "j"])

    return state.select("ta", "tb", "bits").mapInArrow(unpack, "i long, j long")


# --- floods --------------------------------------------------------------------------------------


def _catchments(table: pa.Table, tile: int):
    """(place, h, root, contacts a, b, w) of a tile's cells: root is the place each drains to by steepest
    descent within the tile, contacts are the pairs of roots that touch, at the least of their higher cells."""
    i, j, h = (table.column(c).to_numpy() for c in ("i", "j", "h"))
    place = (i % tile) * tile + j % tile
    wide = np.full((tile + 2, tile + 2), np.inf)
    inner = wide[1:-1, 1:-1]
    inner[i % tile, j % tile] = h
    own = np.arange(tile * tile).reshape(tile, tile)
    best, down = np.zeros((tile, tile)), own.copy()
    known = np.isfinite(inner)
    for k, (a, b) in enumerate(D8):
        beside = wide[1 + a : 1 + a + tile, 1 + b : 1 + b + tile]
        with np.errstate(invalid="ignore"):
            fall = np.where(known & np.isfinite(beside), inner - beside, 0.0) / (2**0.5 if k % 2 else 1.0)
        better = fall > best
        best[better], down[better] = fall[better], own[better] + a * tile + b
    root = down.ravel()
    while ((far := root[root]) != root).any():
        root = far
    named = root.reshape(tile, tile)
    us, vs, ws = [], [], []
    for a, b in D8[:4]:
        here = (slice(max(0, -a), tile - max(0, a)), slice(0, tile - b))
        there = (slice(max(0, a), tile + min(0, a)), slice(b, tile))
        touch = known[here] & known[there] & (named[here] != named[there])
        us.append(named[here][touch])
        vs.append(named[there][touch])
        ws.append(np.maximum(inner[here][touch], inner[there][touch]))
    u, v, w = (np.concatenate(c) for c in (us, vs, ws))
    u, v = np.minimum(u, v), np.maximum(u, v)
    order = np.lexsort((w, v, u))
    u, v, w = u[order], v[order], w[order]
    first = np.ones(len(u), bool)
    first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return place, h, root[place], u[first], v[first], w[first]


def ends_between(nodes: int, ends: set, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> list[tuple]:
    """(a, b, w) between `ends` alone, with the same lowest ways as the edges (u, v, w) have: edges are taken
    from the lowest up, and one that ties two groups with ends each becomes an edge between them."""
    part, end = list(range(nodes)), [n if n in ends else -1 for n in range(nodes)]

    def now(n: int) -> int:
        while part[n] != n:
            part[n] = part[part[n]]
            n = part[n]
        return n

    out = []
    order = np.argsort(w, kind="stable")
    for a, b, x in zip(u[order].tolist(), v[order].tolist(), w[order].tolist()):
        a, b = now(a), now(b)
        if a == b:
            continue
        if end[a] >= 0 and end[b] >= 0:
            out.append((end[a], end[b], x))
        elif end[b] >= 0:
            end[a] = end[b]
        part[b] = a
    return out


def _numbered(table: pa.Table, tile: int):
    """A tile's catchments by number: (place, h, number of each cell's, their places, u, v, w), u and v with a
    last number for the way out, to which drains lead at their own height."""
    place, h, root, u, v, w = _catchments(table, tile)
    drain = table.column("drain").to_numpy(zero_copy_only=False).astype(bool)
    names = np.unique(root)
    of = np.searchsorted(names, root)
    u, v = np.searchsorted(names, u), np.searchsorted(names, v)
    out = np.full(int(drain.sum()), len(names))
    return place, h, of, names, np.concatenate([u, of[drain]]), np.concatenate([v, out]), np.concatenate([w, h[drain]])


def flood(cells: DataFrame, drains: Column, tile: int = TILE, most: int = MOST_BETWEEN) -> DataFrame:
    """(cid, h, filled): depressions filled to their spill level; what no way leads out of stays as it is. cells: cid,
    i, j, h; drains: those that water leaves by, at their own height.

    Each tile's catchments make a spill graph, of which edges between those at the tile's border (and the way
    out) are kept. Levels of these come from a heap on the driver for up to `most` edges, else from rounds;
    with them each tile solves its own graph. A cell stands at the higher of itself and its catchment's level.
    """
    all_ = cells.select("cid", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("h").cast("double").alias("h"), F.coalesce(drains, F.lit(False)).alias("drain"))
    all_ = settled(all_.select("*", tile_of("i", tile).alias("ta"), tile_of("j", tile).alias("tb")))
    known = all_.where("h is not null")

    def between(table: pa.Table) -> pa.Table:
        place, h, of, names, u, v, w = _numbered(table, tile)
        cid = np.zeros(tile * tile, np.int64)
        cid[place] = table.column("cid").to_numpy()
        name = np.append(cid[names], DRAIN)
        at, row, col = np.arange(len(place)), place // tile, place % tile
        edge = (row == 0) | (row == tile - 1) | (col == 0) | (col == tile - 1)
        ends = np.unique(of[edge])
        kept = ends_between(len(name), {*ends.tolist(), len(names)}, u, v, w)
        n, m, rim = len(kept), len(ends), at[edge]
        a, b, x = (np.array(c) for c in zip(*kept)) if n else (np.zeros(0, int),) * 3
        i, j = (table.column(c).to_numpy() for c in ("i", "j"))
        some = lambda k, c: pa.concat_arrays([pa.nulls(s, c.type) if s is not None else c for s in k])
        own = pa.array(name[of[rim]])
        return pa.table({
            "kind": pa.array([0] * n + [1] * len(rim), pa.int32()),
            "ta": pa.array(np.full(n + len(rim), table.column("ta")[0].as_py())),
            "tb": pa.array(np.full(n + len(rim), table.column("tb")[0].as_py())),
            "a": pa.concat_arrays([pa.array(name[a], pa.int64()), own]),
            "b": some((None, len(rim)), pa.array(name[b], pa.int64())),
            "w": pa.concat_arrays([pa.array(x, pa.float64()), pa.array(h[rim])]),
            "i": some((n, None), pa.array(i[rim])),
            "j": some((n, None), pa.array(j[rim])),
        })

    rows = settled(known.groupBy("ta", "tb").applyInArrow(between, "kind int, ta long, tb long, a long, b long, w double, i long, j long"))
    inside = rows.where("kind = 0").select("a", "b", "w")
    rim = rows.where("kind = 1").select(F.col("a").alias("root"), "ta", "tb", "i", "j", F.col("w").alias("h"))
    met = edges(rim.withColumn("cid", F.col("root")), ["h", "ta", "tb"], D8[:4], own=["h", "ta", "tb"]).where("ta <> n_ta or tb <> n_tb")
    across = met.select(F.col("cid").alias("a"), F.col("nid").alias("b"), F.greatest("h", "n_h").alias("w"))
    pairs = inside.unionByName(across).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w"))
    pairs = settled(pairs)
    if pairs.count() > most:
        table = spill_levels_in_rounds(pairs)
    else:
        level = spill_levels([tuple(r) for r in pairs.collect()], {DRAIN})
        level.pop(DRAIN)
        made = pa.table({"root": pa.array(list(level), pa.int64()), "level": pa.array(list(level.values()), pa.float64())})
        table = cells.sparkSession.createDataFrame(made)
    given = settled(rim.select("root", "ta", "tb").distinct().join(table, "root").select("root", "ta", "tb", "level"))

    def solve(table: pa.Table, levels: pa.Table) -> pa.Table:
        place, h, of, names, u, v, w = _numbered(table, tile)
        cid = table.column("cid").to_numpy()
        at = np.zeros(tile * tile, np.int64)
        at[place] = cid
        of_name = {c: n for n, c in enumerate(at[names].tolist())}
        near: list[list] = [[] for _ in range(len(names) + 1)]
        for a, b, x in zip(u.tolist(), v.tolist(), w.tolist()):
            near[a].append((x, b))
            near[b].append((x, a))
        level = [float("inf")] * (len(names) + 1)
        heap = [(float("-inf"), len(names))]
        level[-1] = float("-inf")
        for c, x in zip(levels.column("root").to_pylist(), levels.column("level").to_pylist()):
            level[of_name[c]] = x
            heap.append((x, of_name[c]))
        heapq.heapify(heap)
        while heap:
            x, n = heapq.heappop(heap)
            if x > level[n]:
                continue
            for y, m in near[n]:
                if (to := max(x, y)) < level[m]:
                    level[m] = to
                    heapq.heappush(heap, (to, m))
        got = np.array(level)[of]
        return pa.table({"cid": pa.array(cid), "h": pa.array(h), "filled": pa.array(np.where(np.isfinite(got), np.maximum(h, got), h))})

    out = known.groupBy("ta", "tb").cogroup(given.groupBy("ta", "tb")).applyInArrow(solve, "cid long, h double, filled double")
    return out.unionByName(all_.where("h is null").select("cid", "h", F.lit(None).cast("double").alias("filled")))
