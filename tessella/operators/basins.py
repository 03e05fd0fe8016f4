"""Drainage basins held between bounds of size, and floods that leave a slope on every filled cell."""

from __future__ import annotations

import heapq
from array import array
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import accumulate, roots, settled
from .grid import D8, edges


def split_oversize(links: DataFrame, most: int, rounds: int = 64) -> DataFrame:
    """(cid, basin): basins of at most `most` cells. links: cid, down (an outlet points to itself).

    Each round cuts every basin that is too large, all at once, at the cell whose upstream cells come
    closest to half of the basin (the least cell of equals); what drains through it is a new basin.
    A basin is named by its outlet's cell.
    """
    tree, done = settled(links.select("cid", "down")), None
    for _ in range(rounds):
        at = roots(tree).select("cid", F.col("root").alias("basin"))
        sizes = at.groupBy("basin").agg(F.count(F.lit(1)).alias("n"))
        large = settled(sizes.where(F.col("n") > most))
        small = at.join(large, "basin", "left_anti").select("cid", "basin")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done
        # only the cells of basins that are too large go on
        rest = settled(at.join(large, "basin").join(tree, "cid").select("cid", "down", "basin", "n"))
        up = accumulate(rest, rest.select("cid", F.lit(1).alias("w")))
        met = rest.join(up, "cid").where("cid <> basin")
        half = F.struct(F.abs(F.col("acc") - F.col("n") / 2).alias("d"), F.col("cid").alias("cut"))
        cuts = met.groupBy("basin").agg(F.min(half).alias("b")).select(F.col("b.cut").alias("cid"), F.lit(1).alias("_cut"))
        tree = settled(rest.join(cuts, "cid", "left").select("cid", F.when(F.col("_cut").isNotNull(), F.col("cid")).otherwise(F.col("down")).alias("down")))
    raise RuntimeError("basins did not get small enough")


def merge_plan(sizes: Sequence[tuple[int, int]], into: dict[int, int], contacts: Sequence[tuple[int, int, int]], least: int, most: int) -> dict[int, int]:
    """{basin: the basin it becomes part of}. The smallest basin below `least` goes first, into the neighbour
    with the longest border (the least id of equals) with which it stays within `most`; one that has
    none stays. A merge that would let the basin drain into itself through a third one is not made.
    into: the basin that each drains to.

    A union only makes basins larger, so basins are taken size by size: what a size holds is complete when
    its turn comes. Borders and drains keep the names they were given, and are read through the union.
    """
    ids = np.array(sorted(b for b, _ in sizes), np.int64)
    n = dict(sizes)
    drain = np.array([into.get(b, -1) for b in ids.tolist()], np.int64)
    a, b, w = (np.array(c, np.int64) for c in zip(*contacts)) if contacts else (np.zeros(0, np.int64),) * 3
    to = merged(ids, np.array([n[b] for b in ids.tolist()], np.int64), _places(ids, drain, drain >= 0), _places(ids, a), _places(ids, b), w, least, most)
    return dict(zip(ids.tolist(), ids[to].tolist()))


def _places(ids: np.ndarray, of: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Places in ids (ascending), -1 for those not known."""
    at = np.searchsorted(ids, of).astype(np.int32)
    return at if known is None else np.where(known, at, -1).astype(np.int32)


def merged(ids: np.ndarray, n: np.ndarray, into: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, least: int, most: int) -> np.ndarray:
    """The plan on places: basins are numbered in the order of their ids, into is -1 without a drain, a and b are
    the basins in contact. About 20 bytes for each contact and 30 for each basin."""
    count = len(ids)
    order = np.argsort(np.concatenate([a, b]), kind="stable")
    begin = np.searchsorted(np.concatenate([a, b])[order], np.arange(count + 1)).tolist()
    beside, border = np.concatenate([b, a])[order], np.concatenate([w, w]).astype(np.int32)[order]
    del order
    part, size, drain = array("i", range(count)), array("q", n.tolist()), array("i", into.tolist())
    # a basin's parts are a list: each one's next, and the last one of all
    follows, last = array("i", [-1]) * count, array("i", range(count))
    turn: dict[int, list[int]] = {}
    for c in np.flatnonzero(n < least).tolist():
        turn.setdefault(size[c], []).append(c)

    def now(c: int) -> int:
        while part[c] != c:
            part[c] = part[part[c]]
            c = part[c]
        return c

    for m in range(least):
        for small in sorted(turn.pop(m, ())):
            if now(small) != small or size[small] != m:
                continue
            shared = Counter()
            c = small
            while c >= 0:
                held = slice(begin[c], begin[c + 1])
                for o, x in zip(beside[held].tolist(), border[held].tolist()):
                    shared[now(o)] += x
                c = follows[c]
            shared.pop(small, None)
            below = _later(small, drain, now)
            for keep in sorted((o for o in shared if size[o] + m <= most), key=lambda o: (-shared[o], o)):
                if keep not in below and small not in _later(keep, drain, now):
                    break
            else:
                continue
            part[small] = keep
            size[keep] += m
            follows[last[keep]] = small
            last[keep] = last[small]
            if drain[keep] >= 0 and now(drain[keep]) == keep:  # it drained into what it has taken in
                drain[keep] = drain[small]
            if size[keep] < least:
                turn.setdefault(size[keep], []).append(keep)
    return np.array([now(c) for c in range(count)], np.int32)


def _later(b: int, drain: array, now) -> set[int]:
    """What b drains to by way of another."""
    seen: list[int] = []
    met = {b}
    while (b := drain[b]) >= 0:
        b = now(b)
        seen.append(b)
        if b in met:
            break
        met.add(b)
    return set(seen[1:])


def merge_undersize(cells: DataFrame, drains: DataFrame, least: int, most: int) -> DataFrame:
    """(cid, basin) with basins under `least` cells merged. cells: cid, i, j, basin. drains: basin, into. Contacts
    are counted in Spark (2 along an edge, 1 across a corner); the order of merges depends on all before it,
    so the basin graph is merged on the driver, in arrays."""
    cells = settled(cells.select("cid", "i", "j", "basin"))
    met = edges(cells, ["basin"], D8[:4], own=["basin"]).where("basin <> n_basin")
    weight = F.sum(F.when(F.col("k") % 2 == 0, 2).otherwise(1)).cast("int")
    contacts = settled(met.groupBy(F.least("basin", "n_basin").alias("a"), F.greatest("basin", "n_basin").alias("b")).agg(weight.alias("w")))
    sizes = cells.groupBy("basin").agg(F.count(F.lit(1)).alias("n"))
    out = F.when(F.col("into") != F.col("basin"), F.col("into"))
    known = sizes.join(drains.select("basin", out.alias("into")), "basin", "left").select("basin", F.col("n").cast("int").alias("n"), "into").toArrow()
    ids = known.column("basin").to_numpy()
    order = np.argsort(ids)
    ids, n, into = ids[order], known.column("n").to_numpy()[order], known.column("into").fill_null(-1).to_numpy()[order]
    into = _places(ids, into, into >= 0)
    del known, order
    rows = contacts.toArrow()
    a, b = (_places(ids, rows.column(c).to_numpy()) for c in "ab")
    w = rows.column("w").to_numpy()
    del rows
    to = merged(ids, n, into, a, b, w, least, most)
    table = cells.sparkSession.createDataFrame(pa.table({"basin": ids, "_to": ids[to]}))
    return cells.join(table, "basin").select("cid", F.col("_to").alias("basin"))


def flood_with_slope(cells: DataFrame, eps: float, tile: int = 256, most: int = 10_000) -> DataFrame:
    """(cid, level): the least surface at or above h that falls by at least eps a step on the way to a
    seed. cells: cid, i, j, h, seed (flag; a seed keeps h).

    Tiles are solved on their own, each with the levels that its neighbours' border cells have so far,
    until none changes: as many rounds as a way has to cross tiles, not cells. A cell that reaches no seed
    has a null level.
    """
    state = settled(cells.select("cid", "i", "j", "h", "seed", F.when(F.col("seed"), F.col("h")).alias("level")))
    schema = "cid long, i long, j long, h double, seed boolean, level double, moved boolean"

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["own"].to_numpy(dtype=bool)
        at = {(a, b): n for n, (a, b) in enumerate(zip(rows["i"], rows["j"]))}
        h = rows["h"].to_numpy(dtype=float)
        old = rows["level"].astype(float).fillna(np.inf).to_numpy()
        level = old.copy()
        heap = [(v, n) for n, v in enumerate(level) if v < np.inf]
        heapq.heapify(heap)
        keys = list(at)
        while heap:
            v, n = heapq.heappop(heap)
            if v > level[n]:
                continue
            a, b = keys[n]
            for da in (-1, 0, 1):
                for db in (-1, 0, 1):
                    m = at.get((a + da, b + db))
                    if m is not None and own[m]:
                        new = max(h[m], v + eps)
                        if new < level[m]:
                            level[m] = new
                            heapq.heappush(heap, (new, m))
        out = rows.loc[own, ["cid", "i", "j", "h", "seed"]].copy()
        out["level"] = pd.Series(np.where(level[own] == np.inf, None, level[own]), index=out.index, dtype="object").astype(float)
        out["moved"] = level[own] < old[own]
        return out

    near = F.array_distinct(F.flatten(F.array(*[F.array(*[F.struct(F.floor((F.col("i") + a) / tile).alias("a"), F.floor((F.col("j") + b) / tile).alias("b")) for b in (-1, 0, 1)]) for a in (-1, 0, 1)])))
    for _ in range(most):
        sent = state.select("cid", "i", "j", "h", "seed", "level", F.explode(near).alias("t"))
        own = (F.col("t.a") == F.floor(F.col("i") / tile)) & (F.col("t.b") == F.floor(F.col("j") / tile))
        sent = sent.select("cid", "i", "j", "h", "seed", "level", own.alias("own"), F.col("t.a").alias("ta"), F.col("t.b").alias("tb"))
        new = settled(sent.groupBy("ta", "tb").applyInPandas(solve, schema))
        if new.where("moved").isEmpty():
            return new.select("cid", F.when(~F.isnan("level"), F.col("level")).alias("level"))
        state = new.drop("moved")
    raise RuntimeError("the flood did not settle")
