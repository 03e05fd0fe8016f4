"""Scalar rules and codecs as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def smoothstep(t: Column) -> Column:
    t = clip(t, 0.0, 1.0)
    return t * t * (3 - 2 * t)


def trapezoid(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """0 up to a, 1 from b to c, 0 from d on."""
    return F.least(clip((x - a) / (b - a), 0.0, 1.0), clip((F.lit(d) - x) / (d - c), 0.0, 1.0))


def quantise16(x: Column, lo: Column, hi: Column, reserve_zero: bool = False) -> Column:
    """x of [lo, hi] as 0 to 65535, or 1 to 65535 with 0 reserved."""
    t = F.when(hi > lo, F.least(F.greatest((x - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    low = 1 if reserve_zero else 0
    return F.floor(t * (65535 - low) + low + 0.5).cast("int")


def dequantise16(code: Column, lo: Column, hi: Column, reserve_zero: bool = False) -> Column:
    low = 1 if reserve_zero else 0
    return lo + (code - low) / float(65535 - low) * (hi - lo)


def encode_log(q: Column, top: float = 12.0) -> Column:
    """log1p as a byte, `top` being 255."""
    return F.floor(clip(F.log1p(F.greatest(q, F.lit(0.0))) / top, 0.0, 1.0) * 255 + 0.5).cast("int")


def decode_log(code: Column, top: float = 12.0) -> Column:
    return F.expm1(code / 255.0 * top)


def temperature(height_m: Column, lat: Column, t_eq: float = 28.0, k_lat: float = 50.0, lapse: float = 6.5) -> Column:
    """Warmth by latitude (radians) and height above the sea."""
    return t_eq - k_lat * F.pow(F.abs(lat) / (math.pi / 2), F.lit(1.5)) - lapse * F.greatest(height_m, F.lit(0.0)) / 1000


def day_mean_sun(lat: Column, declination: float) -> Column:
    """Daily mean insolation at the top of the air, W per square metre."""
    x = -F.tan(lat) * math.tan(declination)
    h0 = F.acos(clip(x, -1.0, 1.0))
    return 1361 / math.pi * (h0 * F.sin(lat) * math.sin(declination) + F.cos(lat) * math.cos(declination) * F.sin(h0))


def zonal_wind(lat_deg: Column, width: float = 10.0, turn: float = 0.3) -> tuple[Column, Column]:
    """Three-cell circulation: (zonal, meridional) directions of unit length scale."""
    a = F.abs(lat_deg)
    z = -1 + 2 * smoothstep((a - (30 - width / 2)) / width) - 2 * smoothstep((a - (60 - width / 2)) / width)
    m = turn * z * F.tanh(lat_deg / width)
    return z / math.hypot(1, turn), m / math.hypot(1, turn)


def latitude_prior(lat_deg: Column, base: float = 0.2, wet: float = 0.8, belt: float = 12.0) -> Column:
    """Wet at the equator and in the middle latitudes, floored."""
    g = lambda c, w: F.exp(-F.pow((F.abs(lat_deg) - c) / w, F.lit(2.0)))
    return F.greatest(base + wet * g(0.0, belt) + wet / 2 * g(50.0, belt), F.lit(base))


def insolation_legendre(lat: Column, s2: float = -0.477) -> Column:
    x = F.sin(lat)
    return 1 + s2 * (3 * x * x - 1) / 2


def pet(temp: Column, lat: Column, t0: float = 5.0, t_eq: float = 28.0) -> Column:
    return F.greatest(temp + t0, F.lit(0.0)) / (t_eq + t0) * insolation_legendre(lat) / (1 + -0.477 * -0.5)


def budyko(aridity: Column) -> Column:
    """Share of the rain that evaporates."""
    a = F.greatest(aridity, F.lit(1e-9))
    return F.sqrt(a * F.tanh(1 / a) * (1 - F.exp(-a)))


#: Codes of the climate classes.
BIOMES = {
    "ice": 1, "tundra": 2, "boreal_forest": 3, "temperate_grassland": 4, "temperate_forest": 5, "temperate_rainforest": 6, "desert": 7,
    "shrubland": 8, "savanna": 9, "tropical_seasonal_forest": 10, "tropical_rainforest": 11,
}
#: Bands of mean temperature (deg C, up to), each with bands of yearly rain (cm, up to).
ANY = float("inf")
BANDS = (
    (-12, ((ANY, "ice"),)),
    (-2, ((ANY, "tundra"),)),
    (5, ((20, "tundra"), (ANY, "boreal_forest"))),
    (13, ((25, "desert"), (60, "temperate_grassland"), (180, "temperate_forest"), (ANY, "temperate_rainforest"))),
    (20, ((25, "desert"), (60, "shrubland"), (180, "temperate_forest"), (ANY, "temperate_rainforest"))),
    (ANY, ((30, "desert"), (100, "savanna"), (220, "tropical_seasonal_forest"), (ANY, "tropical_rainforest"))),
)
#: Fixed values of the seasonal form: the warmth that trees need (deg C) and for which share of the year, the
#: swing of a steppe's year (deg C), the summer's share of rain below which winter is the wet season, and
#: that beyond which rain comes in one season.
GROWING, GROWING_SHARE, STEPPE_SWING, WET_WINTER, ONE_SEASON = 10.0, 1 / 3, 25.0, 1 / 3, 0.75


def banded(x: Column, bands, value) -> Column:
    """value of the first band whose upper bound lies above x (the last band has none)."""
    out = None
    for bound, what in bands[:-1]:
        out = F.when(x < bound, value(what)) if out is None else out.when(x < bound, value(what))
    last = value(bands[-1][1])
    return last if out is None else out.otherwise(last)


def biome(t: Column, p: Column) -> Column:
    """Climate class by mean temperature (deg C) and yearly rain (cm)."""
    return banded(t, BANDS, lambda rain: banded(p, rain, lambda name: F.lit(BIOMES[name])))


def seasonal_biome(t: Column, p: Column, swing: Column, summer: Column | None = None) -> Column:
    """Climate class with the year in it: swing is the warmest month less the coldest, summer the share of
    rain that falls in summer (null or left out: unknown). Cold classes go by the warmest month and by
    how long it is warm; dry temperate land with a continent's year is grassland, with wet winters
    shrubland; tropical forest with one wet season is the seasonal one."""
    swing = F.greatest(swing, F.lit(0.5))
    warmest = t + swing / 2
    warm_share = F.acos(F.least(F.greatest((GROWING - t) * 2 / swing, F.lit(-1.0)), F.lit(1.0))) / F.lit(math.pi)
    summer = F.lit(None).cast("double") if summer is None else summer
    wet_winter = F.coalesce(summer < WET_WINTER, F.lit(False))
    one_season = F.coalesce((summer > ONE_SEASON) | (summer < 1 - ONE_SEASON), F.lit(False))
    code = lambda name: F.lit(BIOMES[name])
    rain = lambda band: dict(BANDS)[band]
    tropical = F.when((p >= 100) & (p < 220) | (p >= 220) & one_season, code("tropical_seasonal_forest")).otherwise(banded(p, rain(ANY), code))
    steppe = (t < 13) | (swing > STEPPE_SWING)
    temperate = (
        F.when((p >= 25) & (p < 100) & wet_winter & (t >= 10), code("shrubland"))
        .when(steppe, banded(p, rain(13), code))
        .otherwise(banded(p, rain(20), code))
    )
    return (
        F.when(warmest < 0, code("ice"))
        .when(warmest < GROWING, code("tundra"))
        .when(warm_share < GROWING_SHARE, banded(p, rain(5), code))
        .when(t >= 20, tropical)
        .otherwise(temperate)
    )


def kilometres(x: Column, radius_km: float) -> Column:
    """Kilometres as radians on a sphere."""
    return x / radius_km


def centimetres_a_year(x: Column, radius_km: float, my_per_step: float) -> Column:
    """cm a year as radians a step: 1 cm a year is 10 km in a million years."""
    return x * 10.0 * my_per_step / radius_km


def steps_of(my: Column, my_per_step: float) -> Column:
    return my / max(my_per_step, 1e-12)


def cell_units(metres: Column, cell_m: float) -> Column:
    return metres / cell_m


def precip_cm(wet: Column, scale: float = 90.0, gamma: float = 1.2, most: float = 400.0) -> Column:
    return F.least(scale * F.pow(wet, F.lit(gamma)), F.lit(most))


def vegetation(p: Column, slope: Column, cliff: float, soil: Column) -> Column:
    return 255 * F.sqrt(F.least(p / 100, F.lit(1.0))) * F.sqrt(1 - F.least(slope / cliff, F.lit(1.0))) * soil


def soil_factor(sediment: Column, full: float = 2.0, floor: float = 0.7) -> Column:
    return floor + (1 - floor) * F.least(sediment / full, F.lit(1.0))


def soil_class(sediment: Column, slope: Column, hardness: Column) -> Column:
    """soil, thin, rock or alluvium; later rules win."""
    thin = sediment < 0.1
    return (
        F.when((sediment >= 0.5) & (slope <= 0.3), "alluvium")
        .when((sediment <= 0) | (thin & (hardness > 0.6)), "rock")
        .when(thin, "thin")
        .otherwise("soil")
    )


def rock(belt: Column, craton: Column, sea: Column, sediment: Column, lake: Column) -> Column:
    """Basement, then what covers it; covers win."""
    base = F.when(belt, "schist").when(craton, "gneiss").when(sea, "basalt").otherwise("granite")
    return F.when(sea & (sediment > 1), "shelf").when(lake, "lake").when(sediment > 2, "alluvium").otherwise(base)


def reach_width(q: Column, q_ref: float, a: float = 4.0, b: float = 0.5, least: float = 1.0) -> Column:
    return F.greatest(F.lit(least), a * F.pow(q / q_ref, F.lit(b)))


def wendland(d: Column, h: float) -> Column:
    t = F.least(d / h, F.lit(1.0))
    return F.pow(1 - t, F.lit(4.0)) * (4 * t + 1)


def wendland_support(sigma: float, knn: int, spacing: float) -> float:
    r2 = knn * spacing**2 / math.pi
    return math.sqrt(14 * sigma**2 * (1 - math.exp(-r2 / (2 * sigma**2))))


def lake_capacity(depth: Column, warmth: Column, slope: Column) -> Column:
    return smoothstep(1 - depth / 8) * smoothstep(warmth / 20) * smoothstep(1 - slope / 0.4)


def scour(flux: Column, full: float, depth: float, sediment: Column) -> tuple[Column, Column]:
    """What ice takes of the sediment, then of the rock."""
    cut = depth * (1 - F.exp(-flux / full))
    loose = F.least(cut, sediment)
    return loose, cut - loose


def density_age(age: Column, young: float = 2.9, old: float = 3.3, scale: float = 60.0) -> Column:
    return young + (old - young) * (1 - F.exp(-age / scale))


def lattice_noise(x: Column, seed: int = 0) -> Column:
    """splitmix64 of a long, as a double in [-1, 1): the same wherever windows overlap. The 64-bit
    products wrap; they are built of decimals, as ANSI longs raise on overflow."""
    two64 = "18446744073709551616"

    def wrap(product: Column) -> Column:
        r = F.pmod(product, F.lit(two64).cast("decimal(38,0)"))
        return F.when(r >= F.lit("9223372036854775808").cast("decimal(38,0)"), r - F.lit(two64).cast("decimal(38,0)")).otherwise(r).cast("long")

    def times(a: Column, m: int) -> Column:
        # split one factor, so that no product leaves 38 digits
        hi, lo = F.shiftrightunsigned(a, 32).cast("decimal(38,0)"), a.bitwiseAND(0xFFFFFFFF).cast("decimal(38,0)")
        m_lo = F.lit(str(m & 0xFFFFFFFF)).cast("decimal(38,0)")
        m_all = F.lit(str(m)).cast("decimal(38,0)")
        high = F.pmod((hi * m_lo).cast("decimal(38,0)"), F.lit("4294967296").cast("decimal(38,0)")) * F.lit("4294967296").cast("decimal(20,0)")
        return wrap(high.cast("decimal(38,0)") + (lo * m_all).cast("decimal(38,0)"))

    z = wrap(x.cast("decimal(38,0)") + F.lit(str((seed + 0x9E3779B97F4A7C15) % 2**64)).cast("decimal(38,0)"))
    z = times(z.bitwiseXOR(F.shiftrightunsigned(z, 30)), 0xBF58476D1CE4E5B9)
    z = times(z.bitwiseXOR(F.shiftrightunsigned(z, 27)), 0x94D049BB133111EB)
    z = z.bitwiseXOR(F.shiftrightunsigned(z, 31))
    return F.shiftrightunsigned(z, 11) / float(2**53) * 2 - 1


def keyed_uniform(seed: int, *keys: Column) -> Column:
    """[0, 1) by the md5 of seed and keys: reproducible, and the same in any engine with md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
