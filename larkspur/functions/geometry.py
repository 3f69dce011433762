"""Plane geometry: point struct<x,y>; box struct<high,low>; lseg struct<a,b>; line struct<a,b,c>; circle struct<center,radius>;
path struct<points,closed>; polygon array of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import col

EPSILON = 1e-6


def point(x, y) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def _zero(x):
    return F.abs(x) <= EPSILON


def box(a, b) -> Column:
    return F.struct(point(F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])).alias("high"), point(F.least(a["x"], b["x"]), F.least(a["y"], b["y"])).alias("low"))


def lseg(a, b) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def line(a, b, c=None) -> Column:
    """From two points, or the coefficients of ax + by + c = 0."""
    if c is not None:
        return F.struct(*[col(v).cast("double").alias(n) for v, n in ((a, "a"), (b, "b"), (c, "c"))])
    upright = _zero(a["x"] - b["x"])
    m = (a["y"] - b["y"]) / F.nullif(a["x"] - b["x"], F.lit(0.0))
    return F.struct(F.when(upright, F.lit(-1.0)).otherwise(m).alias("a"), F.when(upright, F.lit(0.0)).otherwise(F.lit(-1.0)).alias("b"), F.when(upright, a["x"]).otherwise(a["y"] - m * a["x"]).alias("c"))


def circle(center, radius) -> Column:
    return F.struct(center.alias("center"), col(radius).cast("double").alias("radius"))


def path(points, closed: bool = True) -> Column:
    return F.struct(col(points).alias("points"), F.lit(closed).alias("closed"))


def polygon(points) -> Column:
    return col(points)


def distance(a, b) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def point_segment(p, s) -> Column:
    return distance(p, closest_on_segment(p, s))


def closest_on_segment(p, s) -> Column:
    """The ## operator."""
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    size = dx * dx + dy * dy
    t = F.when(size == 0, F.lit(0.0)).otherwise(((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy) / F.nullif(size, F.lit(0.0)))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return point(s["a"]["x"] + t * dx, s["a"]["y"] + t * dy)


def closest_on_line(p, ln) -> Column:
    n = ln["a"] * ln["a"] + ln["b"] * ln["b"]
    d = (ln["a"] * p["x"] + ln["b"] * p["y"] + ln["c"]) / n
    return point(p["x"] - ln["a"] * d, p["y"] - ln["b"] * d)


def point_line(p, ln) -> Column:
    return F.abs(ln["a"] * p["x"] + ln["b"] * p["y"] + ln["c"]) / F.hypot(ln["a"], ln["b"])


def circle_distance(a, b) -> Column:
    return F.greatest(distance(a["center"], b["center"]) - a["radius"] - b["radius"], F.lit(0.0))


def _corner_sum(points, f) -> Column:
    """The sum of f over consecutive points, the last joined to the first."""
    n = F.size(points)
    pairs = F.transform(points, lambda p, i: f(p, F.get(points, F.pmod(i + 1, n))))
    return F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b)


def polygon_area(points) -> Column:
    return F.abs(_corner_sum(col(points), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def box_area(b) -> Column:
    return width(b) * height(b)


def circle_area(c) -> Column:
    return F.pi() * c["radius"] * c["radius"]


def path_area(p) -> Column:
    return F.when(p["closed"], polygon_area(p["points"]))


def width(b):
    return b["high"]["x"] - b["low"]["x"]


def height(b):
    return b["high"]["y"] - b["low"]["y"]


def diagonal(b):
    return lseg(b["high"], b["low"])


def box_center(b):
    return point((b["high"]["x"] + b["low"]["x"]) / 2, (b["high"]["y"] + b["low"]["y"]) / 2)


def segment_center(s):
    return point((s["a"]["x"] + s["b"]["x"]) / 2, (s["a"]["y"] + s["b"]["y"]) / 2)


def bound_box(a, b):
    return box(point(F.greatest(a["high"]["x"], b["high"]["x"]), F.greatest(a["high"]["y"], b["high"]["y"])), point(F.least(a["low"]["x"], b["low"]["x"]), F.least(a["low"]["y"], b["low"]["y"])))


def segment_length(s):
    return distance(s["a"], s["b"])


def path_length(p):
    points = p["points"]
    steps = F.transform(points, lambda q, i: F.when((i > 0), distance(q, F.get(points, i - 1))).when(p["closed"], distance(q, F.element_at(points, -1))).otherwise(F.lit(0.0)))
    return F.aggregate(steps, F.lit(0.0), lambda a, b: a + b)


def slope(a, b):
    dx = a["x"] - b["x"]
    return F.when(_zero(dx), F.lit(float("inf"))).otherwise((a["y"] - b["y"]) / F.nullif(dx, F.lit(0.0)))


def _direction(s):
    return s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]


def parallel(s, t):
    (a, b), (c, d) = _direction(s), _direction(t)
    return _zero(a * d - b * c)


def perpendicular(s, t):
    (a, b), (c, d) = _direction(s), _direction(t)
    return _zero(a * c + b * d)


def horizontal(s):
    return _zero(s["a"]["y"] - s["b"]["y"])


def vertical(s):
    return _zero(s["a"]["x"] - s["b"]["x"])


def segments_intersect(s, t):
    """The ?# operator, by the sides that the ends lie on."""
    side = lambda p, q, r: F.signum(F.round((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]), 9))
    on = lambda p, q, r: (side(p, q, r) == 0) & r["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & r["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
    a, b, c, d = s["a"], s["b"], t["a"], t["b"]
    return ((side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)) | on(a, b, c) | on(a, b, d) | on(c, d, a) | on(c, d, b)


def boxes_overlap(a, b):
    return (a["low"]["x"] <= b["high"]["x"]) & (b["low"]["x"] <= a["high"]["x"]) & (a["low"]["y"] <= b["high"]["y"]) & (b["low"]["y"] <= a["high"]["y"])


def box_contains(a, b):
    return (a["low"]["x"] <= b["low"]["x"]) & (a["high"]["x"] >= b["high"]["x"]) & (a["low"]["y"] <= b["low"]["y"]) & (a["high"]["y"] >= b["high"]["y"])


def box_has(b, p):
    return p["x"].between(b["low"]["x"], b["high"]["x"]) & p["y"].between(b["low"]["y"], b["high"]["y"])


def circle_has(c, p):
    return distance(c["center"], p) <= c["radius"]


def polygon_has(points, p):
    """Even-odd rule: edges that a ray to the right crosses."""
    crossed = lambda a, b: (((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])).cast("double")
    return F.pmod(_corner_sum(col(points), lambda a, b: F.coalesce(crossed(a, b), F.lit(0.0))).cast("int"), F.lit(2)) == 1


def below(a, b):
    return a["high"]["y"] < b["low"]["y"]


def above(a, b):
    return a["low"]["y"] > b["high"]["y"]


def same(a, b):
    """~= on points."""
    return _zero(a["x"] - b["x"]) & _zero(a["y"] - b["y"])


def area(shape, kind: str = "box"):
    return {"box": box_area, "circle": circle_area, "polygon": polygon_area, "path": path_area}[kind](shape)


def center(shape, kind: str = "box"):
    return {"box": box_center, "circle": lambda c: c["center"], "lseg": segment_center}[kind](shape)


FUNCTIONS = {
    "point": point,
    "box": box,
    "lseg": lseg,
    "line": line,
    "circle": circle,
    "path": path,
    "polygon": polygon,
    "bound_box": bound_box,
    "area": area,
    "center": center,
    "diameter": lambda c: c["radius"] * 2,
    "radius": lambda c: c["radius"],
    "height": height,
    "width": width,
    "diagonal": diagonal,
    "slope": slope,
    "npoints": lambda p: F.size(col(p)),
    "isclosed": lambda p: p["closed"],
    "isopen": lambda p: ~p["closed"],
    "popen": lambda p: p.withField("closed", F.lit(False)),
    "pclose": lambda p: p.withField("closed", F.lit(True)),
    "isparallel": parallel,
    "isperp": perpendicular,
    "ishorizontal": horizontal,
    "isvertical": vertical,
}
