"""Floods in order, tile by tile: the rank in which cells are reached, their receivers, water and spectra.

The order of a flood depends on all before it, so a tile is one ordered pass; tiles are of a bounded size
and are flooded side by side.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import D8

NONE = 255


def flood_order(surface: np.ndarray, drain: np.ndarray):
    """(order, receiver, code, level) of a grid, flat: the cells in the order in which a flood from the drains
    reaches them, the cell that each was reached from (-1 for drains and cells not reached), its D8 code
    from the cell (255 without), and the water level.

    Drains beside other cells come first, by height, then cell. Of the cells at the shore the lowest is
    next, the one that was reached first of equals; but a cell no higher than the level it is reached at
    stands at that level and goes before all of these, in order.
    """
    high, wide = surface.shape
    inner = np.zeros((high + 2, wide + 2), bool)
    inner[1:-1, 1:-1] = True
    h = np.zeros(inner.shape)
    h[1:-1, 1:-1] = surface
    open_ = inner.copy()
    open_[1:-1, 1:-1] &= ~drain
    steps = [di * (wide + 2) + dj for di, dj in D8]
    flat, free = h.ravel(), open_.ravel()
    level, receiver, code = flat.copy(), np.full(flat.size, -1, np.int64), np.full(flat.size, NONE, np.int16)
    shore, level_with = [], deque()
    for cell in np.flatnonzero(inner.ravel() & ~free).tolist():
        if any(free[cell + s] for s in steps):
            shore.append((flat[cell], len(shore), cell))
    reached = len(shore)
    heapq.heapify(shore)
    order = []
    while level_with or shore:
        cell = level_with.popleft() if level_with else heapq.heappop(shore)[2]
        order.append(cell)
        at = level[cell]
        for k, s in enumerate(steps):
            near = cell + s
            if not free[near]:
                continue
            free[near] = False
            receiver[near], code[near] = cell, (k + 4) % 8
            if flat[near] <= at:
                level[near] = at
                level_with.append(near)
            else:
                heapq.heappush(shore, (flat[near], reached, near))
                reached += 1
    place = lambda c: (c // (wide + 2) - 1) * wide + c % (wide + 2) - 1
    cut = lambda x: x.reshape(high + 2, wide + 2)[1:-1, 1:-1].ravel()
    receiver = cut(np.where(receiver >= 0, place(receiver), -1))
    return place(np.array(order, np.int64)), receiver, cut(code), cut(level)


def gathered(order: np.ndarray, receiver: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights summed down the flood's tree: every donor comes after its receiver."""
    acc = weight.astype(float).copy()
    for cell in order[::-1].tolist():
        if receiver[cell] >= 0:
            acc[receiver[cell]] += acc[cell]
    return acc


FLOOD = "cid long, rank long, receiver long, code int, level double, acc double, depth double"


def tile_floods(cells: DataFrame, tile: int, sea: Column | None = None, weight: str | None = None) -> DataFrame:
    """(cid, rank, receiver, code, level, acc, depth) of a flood of each tile x tile square of cells that drains
    to the square's border and to the sea. cells: cid, i, j, h.

    rank counts from 0 in each tile, null for drains that no cell drains to at once; receiver is null for
    drains; code is the D8 code of the way to it (255 without); acc is the weight (or the number of cells)
    that comes through; depth is the water that stands over the cell, 0 on drains. Places without a cell,
    and cells without a height, are drains; the cells get the rank, level and depth of drains.
    """
    rows = cells.select(
        "cid", "i", "j", F.col("h").cast("double").alias("h"), F.coalesce(sea if sea is not None else F.lit(False), F.lit(False)).alias("sea"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), F.floor(F.col("i") / tile).alias("ti"), F.floor(F.col("j") / tile).alias("tj"),
    )

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        i, j = (part[c].to_numpy() - part[c].min() for c in "ij")
        shape = int(i.max()) + 1, int(j.max()) + 1
        at = i * shape[1] + j
        surface, weights, drain = np.zeros(shape), np.zeros(shape), np.ones(shape, bool)
        h = part["h"].to_numpy()
        surface.flat[at], weights.flat[at] = np.nan_to_num(h), np.nan_to_num(part["w"].to_numpy())
        drain.flat[at] = part["sea"].to_numpy() | np.isnan(h)
        drain[0, :] = drain[-1, :] = drain[:, 0] = drain[:, -1] = True
        order, receiver, code, level = flood_order(surface, drain)
        rank = np.full(surface.size, -1, np.int64)
        rank[order] = np.arange(len(order))
        acc = gathered(order, receiver, weights.ravel())
        depth = np.where(drain.ravel(), 0.0, level - surface.ravel())
        cid = np.full(surface.size, -1, np.int64)
        cid[at] = part["cid"].to_numpy()
        to = np.where(receiver >= 0, cid[receiver], -1)
        known = lambda x: pd.array(np.where(x < 0, None, x), dtype="Int64")
        return pd.DataFrame(
            {"cid": part["cid"].to_numpy(), "rank": known(rank[at]), "receiver": known(to[at]), "code": code[at].astype(np.int32),
             "level": level[at], "acc": acc[at], "depth": depth[at]}
        )

    return rows.groupBy("ti", "tj").applyInPandas(solve, FLOOD)


def radial_spectrum(z: np.ndarray, spacing: float, rings: int = 30, least: int = 7):
    """(wave number, mean power) of rings of equal logarithmic width, under a Hann window; rings with fewer
    than `least` samples are left out."""
    n = min(z.shape)
    z = (z - z.mean())[:n, :n]
    taper = np.hanning(n)
    power = np.abs(np.fft.fft2(z * taper[:, None] * taper[None, :])) ** 2
    f = np.fft.fftfreq(n, spacing)
    k = np.hypot(f[:, None], f[None, :])
    edges = np.geomspace(2 / (n * spacing), k.max(), rings)
    ring = np.searchsorted(edges, k.ravel(), "right")
    count = np.bincount(ring, minlength=rings + 1)[1:rings]
    some = count >= least
    mean = lambda x: np.bincount(ring, x.ravel(), minlength=rings + 1)[1:rings][some] / count[some]
    return mean(k), mean(power)


def spectral_slopes(cells: DataFrame, tile: int, spacing: float, waves: Sequence[float]) -> DataFrame:
    """(ti, tj, beta, n) of full tiles: minus the slope of log power against log wave number over the n rings
    with wave lengths in [waves[0], waves[1]]; null with fewer than 4. cells: i, j, h."""
    rows = cells.select(F.floor(F.col("i") / tile).alias("ti"), F.floor(F.col("j") / tile).alias("tj"), "i", "j", F.col("h").cast("double").alias("h"))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) < tile * tile or part["h"].isna().any():
            return pd.DataFrame({c: [] for c in ("ti", "tj", "beta", "n")})
        z = part.sort_values(["i", "j"])["h"].to_numpy().reshape(tile, tile)
        k, p = radial_spectrum(z, spacing)
        use = (1 / k >= waves[0]) & (1 / k <= waves[1]) & (p > 0)
        beta = -np.polyfit(np.log10(k[use]), np.log10(p[use]), 1)[0] if use.sum() >= 4 else None
        return pd.DataFrame({"ti": [part["ti"].iloc[0]], "tj": [part["tj"].iloc[0]], "beta": [beta], "n": [int(use.sum())]})

    return rows.groupBy("ti", "tj").applyInPandas(solve, "ti long, tj long, beta double, n int")
