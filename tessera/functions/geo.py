"""Simple-feature geometries: WKT, measures, hulls and DE-9IM relations, with exact arithmetic where a decision hangs on it."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .terms import Val, string

GEOF = "http://www.opengis.net/def/function/geosparql/"
CRS84 = "http://www.opengis.net/def/crs/OGC/1.3/CRS84"
METRE, DEGREE = "http://www.opengis.net/def/uom/OGC/1.0/metre", "http://www.opengis.net/def/uom/OGC/1.0/degree"

Point = tuple


@dataclass
class Geometry:
    """Points, lines and polygons (each an outer ring and holes, closed) of one geometry."""

    kind: str
    points: list[Point] = field(default_factory=list)
    lines: list[list[Point]] = field(default_factory=list)
    polygons: list[list[list[Point]]] = field(default_factory=list)
    crs: str = CRS84

    @property
    def empty(self) -> bool:
        return not (self.points or self.lines or self.polygons)

    @property
    def dimension(self) -> int:
        return 2 if self.polygons else 1 if self.lines else 0 if self.points else -1

    def vertices(self) -> list[Point]:
        return [*self.points, *[p for x in self.lines for p in x], *[p for x in self.polygons for r in x for p in r]]

    def members(self) -> list["Geometry"]:
        return [Geometry("POINT", [p]) for p in self.points] + [Geometry("LINESTRING", lines=[x]) for x in self.lines] + [Geometry("POLYGON", polygons=[x]) for x in self.polygons]


_WKT = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")


def parse_wkt(text: str) -> Geometry:
    """A geometry from WKT with an optional CRS IRI in front."""
    m = re.match(r"\s*<([^>]*)>\s*", text)
    tokens, at = [], m.end() if m else 0
    while text[at:].strip():
        k = _WKT.match(text, at)
        if not k:
            raise ValueError(f"not WKT: {text[:40]!r}")
        tokens.append(k[1].upper())
        at = k.end()
    tokens.append("")
    pos = 0

    def take(want: str | None = None) -> str:
        nonlocal pos
        if want is not None and tokens[pos] != want:
            raise ValueError(f"not WKT: {text[:40]!r}")
        pos += 1
        return tokens[pos - 1]

    def nested(depth: int):
        if tokens[pos] == "EMPTY":
            take()
            return []
        take("(")
        out = []
        while True:
            if depth:
                out.append(nested(depth - 1))
            else:
                bare = tokens[pos] != "("
                if not bare:
                    take()
                p = []
                while tokens[pos] not in (",", ")"):
                    p.append(float(take()))
                out.append(tuple(p))
                if not bare:
                    take(")")
            if tokens[pos] == ",":
                take()
                continue
            take(")")
            return out

    def one() -> Geometry:
        kind = take()
        if tokens[pos] in ("Z", "M", "ZM"):
            take()
        if kind == "GEOMETRYCOLLECTION":
            g = Geometry(kind)
            if tokens[pos] == "EMPTY":
                take()
                return g
            take("(")
            while True:
                x = one()
                g.points += x.points
                g.lines += x.lines
                g.polygons += x.polygons
                if tokens[pos] != ",":
                    break
                take()
            take(")")
            return g
        if kind in ("POINT", "MULTIPOINT"):
            return Geometry(kind, points=nested(0))
        if kind in ("LINESTRING", "MULTILINESTRING"):
            x = nested(kind.startswith("MULTI"))
            return Geometry(kind, lines=x if kind.startswith("MULTI") else [x] if x else [])
        if kind in ("POLYGON", "MULTIPOLYGON"):
            x = nested(2 if kind.startswith("MULTI") else 1)
            return Geometry(kind, polygons=x if kind.startswith("MULTI") else [x] if x else [])
        raise ValueError(f"not a geometry: {kind}")

    g = one()
    g.crs = m[1] if m else CRS84
    return g


def _n(x: float) -> str:
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))


def to_wkt(g: Geometry) -> str:
    def ring(r: list[Point]) -> str:
        return "(" + ", ".join(" ".join(map(_n, p)) for p in r) + ")"

    def polygon(p) -> str:
        return "(" + ", ".join(map(ring, p)) + ")"

    if g.empty:
        return f"{g.kind} EMPTY"
    if g.kind == "POINT":
        return "POINT" + ring(g.points)
    if g.kind == "LINESTRING":
        return "LINESTRING" + ring(g.lines[0])
    if g.kind == "POLYGON":
        return "POLYGON" + polygon(g.polygons[0])
    if g.kind == "MULTIPOINT":
        return "MULTIPOINT(" + ", ".join(ring([p]) for p in g.points) + ")"
    if g.kind == "MULTILINESTRING":
        return "MULTILINESTRING(" + ", ".join(map(ring, g.lines)) + ")"
    if g.kind == "MULTIPOLYGON":
        return "MULTIPOLYGON(" + ", ".join(map(polygon, g.polygons)) + ")"
    return "GEOMETRYCOLLECTION(" + ", ".join(map(to_wkt, g.members())) + ")"


def to_geojson(g: Geometry) -> str:
    name = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon", "GEOMETRYCOLLECTION": "GeometryCollection"}[g.kind]
    if g.kind == "GEOMETRYCOLLECTION":
        return json.dumps({"type": name, "geometries": [json.loads(to_geojson(x)) for x in g.members()]})
    c = g.points or g.lines or g.polygons
    return json.dumps({"type": name, "coordinates": c if g.kind.startswith("MULTI") else (c[0] if c else [])})


# measures
def _cross(o: Point, a: Point, b: Point):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _shoelace(ring: list[Point]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def area(g: Geometry) -> float:
    return float(sum(abs(_shoelace(p[0])) - sum(abs(_shoelace(h)) for h in p[1:]) for p in g.polygons))


def length(g: Geometry) -> float:
    rings = [*g.lines, *[r for p in g.polygons for r in p]]
    return float(sum(math.dist(a[:2], b[:2]) for r in rings for a, b in zip(r, r[1:])))


def envelope(g: Geometry) -> Geometry:
    if g.empty:
        return Geometry("POLYGON")
    xs, ys = [p[0] for p in g.vertices()], [p[1] for p in g.vertices()]
    a, b, c, d = min(xs), min(ys), max(xs), max(ys)
    return Geometry("POLYGON", polygons=[[[(a, b), (c, b), (c, d), (a, d), (a, b)]]])


def centroid(g: Geometry) -> Geometry:
    """Of what has the highest dimension."""
    if g.empty:
        return Geometry("POINT")
    x = y = w = 0.0
    if g.polygons:
        for p in g.polygons:
            for k, r in enumerate(p):
                sign = (1 if k == 0 else -1) * (1 if _shoelace(r) > 0 else -1)
                for a, b in zip(r, r[1:]):
                    c = (a[0] * b[1] - b[0] * a[1]) * sign
                    x, y, w = x + (a[0] + b[0]) * c / 6, y + (a[1] + b[1]) * c / 6, w + c / 2
    if not w and (g.lines or g.polygons):
        x = y = w = 0.0
        for r in [*g.lines, *[r for p in g.polygons for r in p]]:
            for a, b in zip(r, r[1:]):
                d = math.dist(a[:2], b[:2])
                x, y, w = x + (a[0] + b[0]) / 2 * d, y + (a[1] + b[1]) / 2 * d, w + d
    if not w:
        ps = g.vertices()
        x, y, w = sum(p[0] for p in ps), sum(p[1] for p in ps), len(ps)
    return Geometry("POINT", [(x / w, y / w)])


def convex_hull(g: Geometry) -> Geometry:
    ps = sorted({p[:2] for p in g.vertices()})
    if len(ps) < 3:
        return Geometry("POINT", ps) if len(ps) < 2 else Geometry("LINESTRING", lines=[ps])

    def half(points):
        out: list[Point] = []
        for p in points:
            while len(out) > 1 and _cross(*[tuple(map(Fraction, q)) for q in (out[-2], out[-1], p)]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(ps) + half(ps[::-1])
    return Geometry("LINESTRING", lines=[ring]) if len(ring) < 3 else Geometry("POLYGON", polygons=[[[*ring, ring[0]]]])


def boundary(g: Geometry) -> Geometry:
    if g.polygons:
        rings = [r for p in g.polygons for r in p]
        return Geometry("MULTILINESTRING" if len(rings) > 1 else "LINESTRING", lines=rings)
    ends: dict[Point, int] = {}
    for x in g.lines:
        for p in (x[0], x[-1]):
            ends[p] = ends.get(p, 0) + 1
    ps = [p for p, n in ends.items() if n % 2]
    return Geometry("MULTIPOINT", ps)


def _segments(g: Geometry) -> list[tuple[Point, Point]]:
    return [(a[:2], b[:2]) for r in [*g.lines, *[r for p in g.polygons for r in p]] for a, b in zip(r, r[1:]) if a[:2] != b[:2]]


def _to_segment(p: Point, a: Point, b: Point) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.dist(p[:2], (a[0] + t * dx, a[1] + t * dy))


def distance(a: Geometry, b: Geometry) -> float | None:
    if a.empty or b.empty:
        return None
    m = relate(a, b)
    if m[0:2] != "FF" or m[3:5] != "FF":
        return 0.0
    sa, sb = _segments(a), _segments(b)
    best = min((math.dist(p[:2], q[:2]) for p in a.vertices() for q in b.vertices()), default=math.inf)
    for ps, ss in ((a.vertices(), sb), (b.vertices(), sa)):
        for p in ps:
            for s in ss:
                best = min(best, _to_segment(p, *s))
    return best


def buffer_point(p: Point, r: float, quadrant: int = 8) -> Geometry:
    """A circle's polygon."""
    n = quadrant * 4
    ring = [(p[0] + r * math.cos(2 * math.pi * k / n), p[1] + r * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return Geometry("POLYGON", polygons=[[[*ring, ring[0]]]])


def bounding_circle(g: Geometry) -> tuple[Point, float]:
    """The smallest circle around all vertices: (centre, radius), by moving through the points that don't fit."""

    def through(*ps: Point) -> tuple[Point, float]:
        if len(ps) == 1:
            return ps[0], 0.0
        if len(ps) == 2:
            c = ((ps[0][0] + ps[1][0]) / 2, (ps[0][1] + ps[1][1]) / 2)
            return c, math.dist(c, ps[0])
        (ax, ay), (bx, by), (cx, cy) = ps
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if d == 0:
            return max((through(p, q) for p in ps for q in ps if p != q), key=lambda c: c[1])
        ux = ((ax * ax + ay * ay) * (by - cy) + (bx * bx + by * by) * (cy - ay) + (cx * cx + cy * cy) * (ay - by)) / d
        uy = ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by * by) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d
        return (ux, uy), math.dist((ux, uy), ps[0])

    def outside(c, p) -> bool:
        return math.dist(c[0], p) > c[1] * (1 + 1e-12) + 1e-15

    ps = sorted({p[:2] for p in g.vertices()})
    if not ps:
        raise ValueError("an empty geometry has no circle")
    c = through(ps[0])
    for i, p in enumerate(ps):
        if outside(c, p):
            c = through(p)
            for j, q in enumerate(ps[:i]):
                if outside(c, q):
                    c = through(p, q)
                    for s in ps[:j]:
                        if outside(c, s):
                            c = through(p, q, s)
    return c


# relations
def _exact(g: Geometry) -> Geometry:
    e = lambda p: (Fraction(p[0]), Fraction(p[1]))
    return Geometry(g.kind, [e(p) for p in g.points], [[e(p) for p in x] for x in g.lines], [[[e(p) for p in r] for r in x] for x in g.polygons])


def _on(p, a, b) -> bool:
    return _cross(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _in_ring(p, ring) -> str:
    inside = False
    for a, b in zip(ring, ring[1:]):
        if _on(p, a, b):
            return "B"
        if (a[1] > p[1]) != (b[1] > p[1]) and (_cross(a, b, p) > 0) == (b[1] > a[1]):
            inside = not inside
    return "I" if inside else "E"


def locate(p, g: Geometry) -> str:
    """Whether a point lies in the interior, on the boundary or in the exterior."""
    places = set()
    for poly in g.polygons:
        outer = _in_ring(p, poly[0])
        holes = [_in_ring(p, h) for h in poly[1:]]
        places.add("E" if outer == "E" or "I" in holes else "B" if outer == "B" or "B" in holes else "I")
    if "I" in places:
        return "I"
    if "B" in places:
        return "B"
    if any(_on(p, a, b) for x in g.lines for a, b in zip(x, x[1:])):
        return "B" if sum((x[0] == p) + (x[-1] == p) for x in g.lines) % 2 else "I"
    return "I" if p in g.points else "E"


def _crossing(a, b, c, d) -> list:
    """The points that two segments share at which either is to be split."""
    out = [p for p in (c, d) if _on(p, a, b)] + [p for p in (a, b) if _on(p, c, d)]
    if not out:
        r, s = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1])
        k = r[0] * s[1] - r[1] * s[0]
        if k:
            t = ((c[0] - a[0]) * s[1] - (c[1] - a[1]) * s[0]) / k
            u = ((c[0] - a[0]) * r[1] - (c[1] - a[1]) * r[0]) / k
            if 0 <= t <= 1 and 0 <= u <= 1:
                out = [(a[0] + t * r[0], a[1] + t * r[1])]
    return out


def relate(a: Geometry, b: Geometry) -> str:
    """The DE-9IM matrix as nine characters, rows interior, boundary, exterior of a."""
    a, b = _exact(a), _exact(b)
    order = "IBE"
    m = {(x, y): -1 for x in order for y in order}
    m["E", "E"] = 2

    def note(x: str, y: str, d: int) -> None:
        m[x, y] = max(m[x, y], d)

    sa, sb = _segments(a), _segments(b)
    cuts: dict = {}
    for s in sa:
        for o in sb:
            if max(s[0][0], s[1][0]) < min(o[0][0], o[1][0]) or max(o[0][0], o[1][0]) < min(s[0][0], s[1][0]):
                continue
            for p in _crossing(*s, *o):
                cuts.setdefault(s, set()).add(p)
                cuts.setdefault(o, set()).add(p)
                note(locate(p, a), locate(p, b), 0)
    for p in a.vertices():
        note(locate(p, a), locate(p, b), 0)
    for p in b.vertices():
        note(locate(p, a), locate(p, b), 0)

    def middles(segments):
        for s in segments:
            ps = sorted({s[0], s[1], *cuts.get(s, ())}, key=lambda p: (p[0] - s[0][0]) * (s[1][0] - s[0][0]) + (p[1] - s[0][1]) * (s[1][1] - s[0][1]))
            for p, q in zip(ps, ps[1:]):
                yield p, q, ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)

    def side(p, q, g, left: bool) -> str:
        """What lies right beside a piece of linework: a point so close that nothing is in between."""
        mid = ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
        n = (-(q[1] - p[1]), q[0] - p[0]) if left else (q[1] - p[1], -(q[0] - p[0]))
        step = Fraction(1)
        while True:
            x = (mid[0] + n[0] * step, mid[1] + n[1] * step)
            if not any(_crossing(mid, x, *s) not in ([], [mid]) and any(c != mid for c in _crossing(mid, x, *s)) for s in [*sa, *sb]):
                return locate(x, g)
            step /= 4

    for segments in (sa, sb):
        for p, q, mid in middles(segments):
            note(locate(mid, a), locate(mid, b), 1)
            if a.polygons or b.polygons:
                for left in (True, False):
                    x, y = side(p, q, a, left), side(p, q, b, left)
                    note(x if x == "E" or a.polygons else "E", y if y == "E" or b.polygons else "E", 2)
    return "".join("F" if m[x, y] < 0 else str(m[x, y]) for x in order for y in order)


def matches(matrix: str, pattern: str) -> bool:
    return all(p == "*" or p == c or p == "T" and c != "F" for c, p in zip(matrix, pattern.upper()))


# fixed values: the patterns that define the relations, by family
_PATTERNS = {
    "sfEquals": ["TFFFTFFFT"], "sfDisjoint": ["FF*FF****"], "sfIntersects": ["T********", "*T*******", "***T*****", "****T****"], "sfTouches": ["FT*******", "F**T*****", "F***T****"],
    "sfWithin": ["T*F**F***"], "sfContains": ["T*****FF*"],
    "ehEquals": ["TFFFTFFFT"], "ehDisjoint": ["FF*FF****"], "ehMeet": ["FT*******", "F**T*****", "F***T****"], "ehOverlap": ["T*T***T**"], "ehCovers": ["T*TFT*FF*"], "ehCoveredBy": ["TFF*TFT**"],
    "ehInside": ["TFF*FFT**"], "ehContains": ["T*TFF*FF*"],
    "rcc8eq": ["TFFFTFFFT"], "rcc8dc": ["FFTFFTTTT"], "rcc8ec": ["FFTFTTTTT"], "rcc8po": ["TTTTTTTTT"], "rcc8tppi": ["TTTFTTFFT"], "rcc8tpp": ["TFFTTFTTT"], "rcc8ntpp": ["TFFTFFTTT"], "rcc8ntppi": ["TTTFFTFFT"],
}
RELATIONS = [*_PATTERNS, "sfCrosses", "sfOverlaps"]


def holds(name: str, a: Geometry, b: Geometry) -> bool:
    return named(name, relate(a, b), a, b)


def named(name: str, m: str, a: Geometry, b: Geometry) -> bool:
    """Whether a relation holds for geometries with the matrix m."""
    d = (a.dimension, b.dimension)
    if name == "sfEquals" or name == "ehEquals":
        return not a.empty and matches(m, "T*F**FFF*")
    if name == "sfCrosses":
        return matches(m, "0********") if d == (1, 1) else matches(m, "T*T******") if d[0] < d[1] else matches(m, "T*****T**") if d[0] > d[1] else False
    if name == "sfOverlaps":
        return d[0] == d[1] and matches(m, "1*T***T**" if d[0] == 1 else "T*T***T**")
    return any(matches(m, p) for p in _PATTERNS[name])


# columns
#: Answers that a Python worker keeps, by function and texts, and the length of texts up to which it does.
_KEPT: dict[tuple, object] = {}
KEPT, SHORT = 1 << 14, 1 << 10


def kept(label, function, texts: tuple):
    """The function's answer for these texts; short texts that come again are not worked out again."""
    key = (label, texts)
    if key in _KEPT:
        return _KEPT[key]
    try:
        out = function(*texts)
    except (ValueError, ArithmeticError, IndexError):
        out = None
    if sum(map(len, texts)) <= SHORT:
        if len(_KEPT) >= KEPT:
            _KEPT.clear()
        _KEPT[key] = out
    return out


def _udf(function, kind: str, label):
    """A column function of texts; its label tells it from all others."""

    @F.udf(kind, useArrow=True)
    def run(*texts):
        return None if any(x is None for x in texts) else kept(label, function, texts)

    return run


def relation(name: str):
    return _udf(lambda x, y: holds(name, parse_wkt(x), parse_wkt(y)), "boolean", name)


def relations(names: list[str], a: Column, b: Column) -> Column:
    """Whether each of the relations holds, as an array; the matrix is worked out once for all of them."""

    def run(x, y):
        p, q = parse_wkt(x), parse_wkt(y)
        m = relate(p, q)
        return [named(n, m, p, q) for n in names]

    return _udf(run, "array<boolean>", tuple(names))(a, b)


def functions() -> dict:
    """geof: functions by IRI for a registry; arguments are WKT literals."""
    out = {GEOF + n: (lambda f: lambda a, b: Val("bool", f(string(a), string(b))))(relation(n)) for n in RELATIONS}

    def one(name, function, kind):
        f = _udf(lambda x: function(parse_wkt(x)), {"dbl": "double", "int": "bigint", "bool": "boolean"}.get(kind, "string"), name)
        out[GEOF + name] = lambda a: Val(kind, f(string(a)))

    for name, function in (("envelope", envelope), ("centroid", centroid), ("convexHull", convex_hull), ("boundary", boundary)):
        one(name, lambda g, h=function: to_wkt(h(g)), "str")
    for name, function, kind in (
        ("area", area, "dbl"), ("length", length, "dbl"), ("dimension", lambda g: g.dimension, "int"), ("isEmpty", lambda g: g.empty, "bool"), ("geometryType", lambda g: g.kind, "str"),
        ("numGeometries", lambda g: len(g.members()), "int"), ("asGeoJSON", to_geojson, "str"), ("asWKT", to_wkt, "str"), ("getSRID", lambda g: g.crs, "str"),
        ("isSimple", is_simple, "bool"), ("asGML", to_gml, "str"), ("asKML", to_kml, "str"), ("coordinateDimension", lambda g: max(map(len, g.vertices()), default=2), "int"), ("is3D", lambda g: any(len(p) > 2 for p in g.vertices()), "bool"),
    ):
        one(name, function, kind)
    d = _udf(lambda x, y: distance(parse_wkt(x), parse_wkt(y)), "double", "distance")
    out[GEOF + "distance"] = lambda a, b, unit=None: Val("dbl", d(string(a), string(b)))
    r = _udf(lambda x, y, p: matches(relate(parse_wkt(x), parse_wkt(y)), p), "boolean", "relate")
    out[GEOF + "relate"] = lambda a, b, p: Val("bool", r(string(a), string(b), string(p)))
    n = _udf(lambda x, k: to_wkt(parse_wkt(x).members()[int(k) - 1]), "string", "geometryN")
    out[GEOF + "geometryN"] = lambda a, k: Val("str", n(string(a), string(k)))
    return out


def is_simple(g: Geometry) -> bool:
    """No repeated point, and no line that meets itself or another one but at ends."""
    if len({p[:2] for p in g.points}) < len(g.points):
        return False
    e = _exact(g)
    pieces = [(x, k, s) for x, line in enumerate(e.lines) for k, s in enumerate(zip(line, line[1:])) if s[0] != s[1]]
    for i, (x, k, s) in enumerate(pieces):
        for y, j, o in pieces[:i]:
            for p in _crossing(*s, *o):
                neighbours = x == y and abs(k - j) == 1 and p in s and p in o and not (_on(s[0], *o) and _on(s[1], *o))
                ends = all(p in (e.lines[z][0], e.lines[z][-1]) for z in (x, y)) and (x != y or e.lines[x][0] == e.lines[x][-1])
                if not (neighbours or ends):
                    return False
    return True


def to_gml(g: Geometry) -> str:
    def positions(ps: list[Point]) -> str:
        return " ".join(_n(c) for p in ps for c in p[:2])

    def ring(r: list[Point], name: str) -> str:
        return f"<gml:{name}><gml:LinearRing><gml:posList>{positions(r)}</gml:posList></gml:LinearRing></gml:{name}>"

    out = []
    for m in g.members():
        if m.points:
            out.append(f"<gml:Point><gml:pos>{positions(m.points)}</gml:pos></gml:Point>")
        elif m.lines:
            out.append(f"<gml:LineString><gml:posList>{positions(m.lines[0])}</gml:posList></gml:LineString>")
        else:
            out.append(f"<gml:Polygon>{ring(m.polygons[0][0], 'exterior')}{''.join(ring(r, 'interior') for r in m.polygons[0][1:])}</gml:Polygon>")
    return out[0] if len(out) == 1 else "<gml:MultiGeometry>" + "".join(f"<gml:geometryMember>{x}</gml:geometryMember>" for x in out) + "</gml:MultiGeometry>"


def to_kml(g: Geometry) -> str:
    def coordinates(ps: list[Point]) -> str:
        return "<coordinates>" + " ".join(",".join(map(_n, p[:2])) for p in ps) + "</coordinates>"

    out = []
    for m in g.members():
        if m.points:
            out.append(f"<Point>{coordinates(m.points)}</Point>")
        elif m.lines:
            out.append(f"<LineString>{coordinates(m.lines[0])}</LineString>")
        else:
            outer, *inner = [f"<LinearRing>{coordinates(r)}</LinearRing>" for r in m.polygons[0]]
            out.append(f"<Polygon><outerBoundaryIs>{outer}</outerBoundaryIs>{''.join(f'<innerBoundaryIs>{r}</innerBoundaryIs>' for r in inner)}</Polygon>")
    return out[0] if len(out) == 1 else f"<MultiGeometry>{''.join(out)}</MultiGeometry>"


def aggregates() -> dict:
    """geof: aggregates by IRI that need no more than sums and bounds of a group; a text that isn't WKT, or no text, gives null."""

    def sound(x: Column) -> Column:
        b = bounds(x)
        return F.count_if(x.isNotNull() & b["x0"].isNull()) == 0

    def box(a: Val, distinct: bool = False) -> Val:
        x = string(a)
        b = bounds(x)
        parts = [F.min(b["x0"]), F.min(b["y0"]), F.max(b["x1"]), F.max(b["y1"])]
        p, q, r, s = [F.regexp_replace(c.cast("string"), r"\.0$", "") for c in parts]
        corners = [(p, q), (r, q), (r, s), (p, s), (p, q)]
        text = F.concat(F.lit("POLYGON(("), F.concat_ws(", ", *[F.concat_ws(" ", u, v) for u, v in corners]), F.lit("))"))
        return Val("str", F.when(sound(x) & parts[0].isNotNull(), text))

    def centre(a: Val, distinct: bool = False) -> Val:
        x = string(a)
        b = bounds(x)
        points = F.count_if(x.isNotNull() & ~x.rlike(r"(?i)^\s*(<[^>]*>)?\s*POINT")) == 0
        text = F.concat(F.lit("POINT("), F.regexp_replace(F.avg(b["x0"]).cast("string"), r"\.0$", ""), F.lit(" "), F.regexp_replace(F.avg(b["y0"]).cast("string"), r"\.0$", ""), F.lit(")"))
        return Val("str", F.when(points, text))

    return {GEOF + "aggBoundingBox": box, GEOF + "aggCentroid": centre}


GEO = "http://www.opengis.net/ont/geosparql#"


def rewrite_relations(n):
    """A rewrite of one operator: a pattern with a relation as its predicate also matches what the geometries show.

    Asserted and derived pairs are one set. Features lead to their text by geo:hasDefaultGeometry/geo:asWKT, geometries
    by geo:asWKT.
    """
    from ..plans import algebra as A
    from .terms import iri

    if not isinstance(n, A.Bgp):
        return n
    mine = [x for x in n.triples if isinstance(x.p, A.Const) and x.p.term.removeprefix("I" + GEO) in RELATIONS]
    rest = tuple(x for x in n.triples if x not in mine)
    out = A.Bgp(rest) if rest else A.Unit()
    wkt = A.Alt((A.Link(GEO + "asWKT"), A.Seq((A.Link(GEO + "hasDefaultGeometry"), A.Link(GEO + "asWKT")))))
    for k, x in enumerate(mine):
        a, b = A.Var(f"__wa{k}"), A.Var(f"__wb{k}")
        name = x.p.term.removeprefix("I" + GEO)
        derived = A.Filter(A.Join(A.Path(x.s, wkt, a), A.Path(x.o, wkt, b)), A.Call(GEOF + name, (a, b)))
        names = tuple(v.name for v in (x.s, x.o) if isinstance(v, A.Var))
        both = A.Distinct(A.Project(A.Union(A.Bgp((A.Triple(x.s, A.Const(iri(GEO + name)), x.o),)), derived), names))
        out = both if isinstance(out, A.Unit) else A.Join(out, both)
    return out if mine else n


def bounds(wkt: Column) -> Column:
    """STRUCT<x0, y0, x1, y1>, in the JVM: the least and largest of a text's coordinates."""
    numbers = F.transform(F.regexp_extract_all(wkt, F.lit(r"(-?[0-9.]+(?:[eE][-+]?\d+)?)\s+(-?[0-9.]+(?:[eE][-+]?\d+)?)"), F.lit(0)), lambda x: F.transform(F.split(x, r"\s+"), lambda y: y.try_cast("double")))
    x, y = F.transform(numbers, lambda p: p[0]), F.transform(numbers, lambda p: p[1])
    return F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def spatial_join(left: DataFrame, right: DataFrame, a: str, b: str, cell: float, name: str = "sfIntersects") -> DataFrame:
    """Pairs for which a relation that implies common points holds.

    Both sides go to the grid cells that their boxes touch and meet by cell; a pair counts in one cell only. Boxes that
    don't meet are dropped before the exact test.
    """
    if name.lower().endswith(("disjoint", "dc")):
        raise ValueError("disjoint geometries don't meet in a cell")

    def cells(df: DataFrame, column: str, mark: str) -> DataFrame:
        box = F.col(f"_{mark}")
        grid = lambda v: F.floor(v / cell)
        out = df.withColumn(f"_{mark}", bounds(F.col(column))).withColumn("_cx", F.explode(F.sequence(grid(box["x0"]), grid(box["x1"]))))
        return out.withColumn("_cy", F.explode(F.sequence(grid(box["y0"]), grid(box["y1"]))))

    met = cells(left, a, "l").join(cells(right, b, "r"), ["_cx", "_cy"])
    x, y = F.col("_l"), F.col("_r")
    met = met.where((x["x0"] <= y["x1"]) & (y["x0"] <= x["x1"]) & (x["y0"] <= y["y1"]) & (y["y0"] <= x["y1"]))
    first = (F.col("_cx") == F.floor(F.greatest(x["x0"], y["x0"]) / cell)) & (F.col("_cy") == F.floor(F.greatest(x["y0"], y["y0"]) / cell))
    return met.where(first).where(relation(name)(F.col(a), F.col(b))).drop("_cx", "_cy", "_l", "_r")


def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return F.radians(lon) * r, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return F.degrees(x / r), F.degrees(F.atan(F.exp(y / r)) * 2 - F.lit(math.pi / 2))
