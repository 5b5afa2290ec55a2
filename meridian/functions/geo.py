"""Geometry and formatting as Column functions; coordinates are degrees, distances metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results must equal published ones.
EARTH_M = 6371008.8
M_PER_DEG, M_PER_DEG_LAT = 111320.0, 110540.0
RUNGS_METRIC = (10, 25, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 30000, 50000)
RUNGS_IMPERIAL = (10, 25, 50, 100, 201, 402, 805, 1609, 3219, 8047, 16093, 32187, 80467)
STEP_METRIC, STEP_IMPERIAL = 10000, 16093


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))  # null for null, which least() would skip


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing in (-180, 180]."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))


def normalise_bearing(deg: Column) -> Column:
    return F.pmod(deg, F.lit(360.0))


def angle_delta(start: Column, end: Column) -> Column:
    """Shortest signed angle in (-180, 180]."""
    d = F.pmod(end - start, F.lit(360.0))
    return F.when(d > 180, d - 360).otherwise(d)


def signed_turn(start: Column, end: Column) -> Column:
    """The turn between two bearings in [-180, 180]: both ends stay, so about-turns keep their side."""
    d = end - start
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def damp_angle(start: Column, end: Column, ms: Column, tau: float = 450.0, rate: float = 45.0) -> Column:
    """start moved towards end for ms: exponentially, by at most rate degrees a second; where it is if no time passes."""
    delta, most = angle_delta(start, end), rate * ms / 1000
    step = delta * (1 - F.exp(-ms / tau))
    return F.when((ms <= 0) | (delta == 0), start).otherwise(start + F.when(step > most, most).when(step < -most, -most).otherwise(step))


def damp_point(lon: Column, lat: Column, to_lon: Column, to_lat: Column, ms: Column, tau: float = 350.0) -> Column:
    """Struct (lon, lat) moved exponentially towards another point for ms."""
    a = F.when(ms <= 0, 0.0).otherwise(1 - F.exp(-ms / tau))
    return F.struct((lon + (to_lon - lon) * a).alias("lon"), (lat + (to_lat - lat) * a).alias("lat"))


def turn_kind(delta: Column) -> Column:
    """Null below 18 degrees, then slight, plain, sharp and u-turn from 18, 45, 115 and 150."""
    d, side = F.abs(delta), F.when(delta > 0, "right").otherwise("left")
    return F.when(d >= 150, F.concat(F.lit("uturn-"), side)).when(d >= 115, F.concat(F.lit("sharp-"), side)).when(d >= 45, side).when(d >= 18, F.concat(F.lit("slight-"), side))


def destination(lon: Column, lat: Column, deg: Column, metres: Column) -> Column:
    """Struct (lon, lat) a flat distance away."""
    return F.struct((lon + metres * F.sin(F.radians(deg)) / (M_PER_DEG * F.cos(F.radians(lat)))).alias("lon"), (lat + metres * F.cos(F.radians(deg)) / M_PER_DEG_LAT).alias("lat"))


def project(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Struct (t, lon, lat): the nearest point of a segment on a flat map around its first end."""
    k = F.cos(F.radians(ay)) * M_PER_DEG
    dx, dy, ex, ey = (bx - ax) * k, (by - ay) * M_PER_DEG, (px - ax) * k, (py - ay) * M_PER_DEG
    size = dx * dx + dy * dy
    t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ex * dx + ey * dy) / size)))
    return F.struct(t.alias("t"), (ax + t * (bx - ax)).alias("lon"), (ay + t * (by - ay)).alias("lat"))


def distance_bias(metres: Column) -> Column:
    """Points that a hit loses by its distance; null for null, which least() and greatest() would skip."""
    bias = F.least(F.lit(120.0), metres / 500) + F.least(F.lit(350.0), F.greatest(F.lit(0.0), metres - 200000) / 3000)
    return F.when(metres.isNotNull(), bias)


def in_box(lon: Column, lat: Column, west: float, south: float, east: float, north: float, margin: float = 0.005) -> Column:
    """Inclusive, widened by a margin; a box with west > east crosses the antimeridian."""
    across = (lon >= west - margin) & (lon <= east + margin) if west <= east else (lon >= west - margin) | (lon <= east + margin)
    return (lat >= south - margin) & (lat <= north + margin) & across


def mercator(lon: Column, lat: Column) -> Column:
    """Struct (x, y) in the unit square, y downwards."""
    a = F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat)))
    return F.struct(((lon + 180) / 360).alias("x"), ((1 - F.ln(F.tan(a) + 1 / F.cos(a)) / F.pi()) / 2).alias("y"))


def tile_of(unit: Column, zoom: int) -> Column:
    n = 1 << zoom
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(unit * n))).cast("int")


def hilbert_id(zoom: int, x: Column, y: Column) -> Column:
    """Tile id along the Hilbert curve, counted from zoom 0; one step of the fold for each zoom."""
    zero = F.lit(0).cast("long")
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), zero.alias("d"))

    def step(at: Column, s: Column) -> Column:
        x, y = at["x"], at["y"]
        right, up = (x.bitwiseAND(s) > 0), (y.bitwiseAND(s) > 0)
        d = at["d"] + s * s * F.when(right, F.when(up, 2).otherwise(3)).otherwise(F.when(up, 1).otherwise(0))
        flip = right & ~up
        fx, fy = F.when(flip, s - 1 - x.bitwiseAND(s - 1)).otherwise(x), F.when(flip, s - 1 - y.bitwiseAND(s - 1)).otherwise(y)
        return F.struct(F.when(up, x).otherwise(fy).alias("x"), F.when(up, y).otherwise(fx).alias("y"), d.cast("long").alias("d"))

    halves = F.array(*(F.lit(1 << k).cast("long") for k in range(zoom - 1, -1, -1)))
    return F.aggregate(halves, start, step)["d"] + F.lit(((1 << (2 * zoom)) - 1) // 3).cast("long")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def _snap(x: Column, step: int, metres: Column) -> Column:
    s = half_up(x / step) * step
    return F.when((metres > 0) & (s == 0), step).otherwise(s).cast("long").cast("string")


def _one_digit(x: Column, even: bool) -> Column:
    """x to one digit after the point by its exact binary value (Java rounds the shortest decimal that names it, and so 1.15,
    which is a little less, to 1.2). Exact halves go up, or to the even digit."""
    a, b = 8 * x, 2 * x
    s = a + b
    # what the sum lost, exactly: it tells on which side of a half ten times x lies
    lost = (a - (s - (s - a))) + (b - (s - a))
    half = s - F.floor(s) == 0.5
    tie = F.rint(s) if even else F.ceil(s)
    tenths = F.when(half, F.when(lost > 0, F.ceil(s)).when(lost < 0, F.floor(s)).otherwise(tie)).otherwise(F.rint(s))
    return F.format_string("%.1f", tenths.cast("double") / 10)


def format_distance(m: Column, units: str = "metric", even: bool = False) -> Column:
    """A distance as people read it; even: exact halves of the last of two digits go to the even one, as C prints them."""
    odd = m.isNull() | F.isnan(m) | (F.abs(m) == float("inf"))
    big, unit = (m / 1609.344, " mi") if units == "imperial" else (m / 1000, " km")
    long = F.when(big < 10, F.concat(_one_digit(big, even), F.lit(unit))).otherwise(F.concat(half_up(big).cast("string"), F.lit(unit)))
    if units == "imperial":
        short = F.when(big < 0.1, F.concat(_snap(m * 3.28084, 50, m), F.lit(" ft")))
    else:
        short = F.when(m < 20, F.concat(_snap(m, 5, m), F.lit(" m"))).when(m < 1000, F.concat(_snap(m, 10, m), F.lit(" m")))
    return F.when(odd, "—").otherwise(F.coalesce(short, long))


def format_duration(s: Column) -> Column:
    mins = half_up(s / 60)
    h, m = F.floor(mins / 60), mins % 60
    hours = F.concat(h.cast("string"), F.lit(" hr"))
    text = F.when(h == 0, F.concat(m.cast("string"), F.lit(" min"))).when((h == 1) & (m == 0), hours).otherwise(F.concat(hours, F.lit(" "), m.cast("string"), F.lit(" min")))
    return F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), "—").when(s < 60, "<1 min").otherwise(text)


def announce_band(m: Column, units: str = "metric") -> Column:
    rungs, step = (RUNGS_METRIC, STEP_METRIC) if units == "metric" else (RUNGS_IMPERIAL, STEP_IMPERIAL)
    out = F.when(m <= 0, 0)
    for r in rungs:
        out = out.when(m <= r, r)
    return out.otherwise(F.ceil(m / step) * step).cast("long")


def overlap_share(inner: list[Column], outer: list[Column]) -> Column:
    """The share of inner (west, south, east, north) that outer covers; 0 for boxes without area."""
    wide, high = F.least(inner[2], outer[2]) - F.greatest(inner[0], outer[0]), F.least(inner[3], outer[3]) - F.greatest(inner[1], outer[1])
    w, h = inner[2] - inner[0], inner[3] - inner[1]
    return F.when((w > 0) & (h > 0) & (wide > 0) & (high > 0), wide * high / (w * h)).otherwise(0.0)


def format_bytes(n: Column) -> Column:
    """Sizes as people read them; null, negative and non-finite ones are unknown."""
    mb = 1024.0 * 1024
    x = n.cast("double")
    bad = x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf"))
    large = F.when(x >= 1024 * mb, F.format_string("%.1f GB", x / (1024 * mb))).when(x >= 100 * mb, F.format_string("%d MB", half_up(x / mb).cast("long"))).when(x >= mb, F.format_string("%.1f MB", x / mb))
    small = F.when(x < 1024, F.format_string("%d B", x.cast("long"))).otherwise(F.format_string("%.1f KB", x / 1024))
    return F.when(bad, "unknown size").otherwise(F.coalesce(large, small))
