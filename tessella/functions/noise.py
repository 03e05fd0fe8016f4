"""Noise fields as plain expressions: the lattice value of a node is a keyed hash of its position, so
that no table of lattice values is made, joined or sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import keyed_uniform, smoothstep


def value_noise(i: Column, j: Column, wavelength: float, seed: int) -> Column:
    """[-1, 1): smoothstep interpolation between the nodes of a lattice, `wavelength` cells wide."""
    x, y = i / wavelength, j / wavelength
    a, b = F.floor(x), F.floor(y)
    s, t = smoothstep(x - a), smoothstep(y - b)
    out = F.lit(0.0)
    for p in (0, 1):
        for q in (0, 1):
            out = out + keyed_uniform(seed, a + p, b + q) * (s if p else 1 - s) * (t if q else 1 - t)
    return out * 2 - 1


def octaves(wavelength: float, least: float, gain: float) -> list[tuple[float, float]]:
    """(wavelength, weight) of halved wavelengths, down to the least."""
    out, weight = [], 1.0
    while wavelength >= least:
        out.append((wavelength, weight))
        wavelength, weight = wavelength / 2, weight * gain
    return out


def fbm(i: Column, j: Column, wavelength: float, seed: int, least: float = 2.0, gain: float = 0.5, ridged: bool = False) -> Column:
    """Weighted mean of octaves of value noise; ridged takes (1 - |n|)^2 of each."""
    out, total = F.lit(0.0), 0.0
    for n, (wave, weight) in enumerate(octaves(wavelength, least, gain)):
        v = value_noise(i, j, wave, seed + n)
        if ridged:
            v = (1 - F.abs(v)) * (1 - F.abs(v))
        out, total = out + weight * v, total + weight
    return out / total


def warped(i: Column, j: Column, amount: float, wavelength: float, seed: int) -> tuple[Column, Column]:
    """A position moved by two noise fields."""
    return i + amount * value_noise(i, j, wavelength, seed), j + amount * value_noise(i, j, wavelength, seed + 1)


def normalised(df: DataFrame, value: str) -> DataFrame:
    """df with `value` at a mean of zero and a greatest magnitude of one (all zero stays zero)."""
    stats = df.agg(F.avg(value).alias("_m"), F.max(value).alias("_hi"), F.min(value).alias("_lo"))
    top = F.greatest(F.col("_hi") - F.col("_m"), F.col("_m") - F.col("_lo"))
    shift = F.col(value) - F.col("_m")
    return df.crossJoin(F.broadcast(stats)).withColumn(value, F.when(top > 0, shift / top).otherwise(shift)).drop("_m", "_hi", "_lo")


def gabor(d: Column, along: Column, weight: Column, frequency: float, width: float) -> Column:
    """One oriented kernel: a Gaussian of the distance times a cosine of the offset along the kernel's axis."""
    return weight * F.exp(-d * d / (2 * width * width)) * F.cos(2 * F.pi() * frequency * along)
