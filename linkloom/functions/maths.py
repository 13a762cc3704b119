"""Scalar formulas as columns: weights, costs, radii, layouts, quantisation, geometry, colours."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

GOLDEN_ANGLE = math.pi * (3 - math.sqrt(5))


def spiral(idx: Column, spacing: float = 5.0, exact: bool = False) -> tuple[Column, Column]:
    """Golden-angle spiral. exact: the angle is the decimal product, rounded once; in doubles a number of some millions
    loses enough of it to show in the fourth place of a coordinate."""
    turn = idx.cast("decimal(19,0)") * F.lit(Decimal("2.399963229728653")) if exact else idx * F.lit(2.399963229728653)
    r, a = F.lit(spacing) * F.sqrt(idx), turn.cast("double")
    return r * F.cos(a), r * F.sin(a)


def order_weight(pos: Column) -> Column:
    """Links count less the later they stand."""
    return F.greatest(F.lit(0.1), 1 / (1 + F.lit(0.05) * pos))


def three_places(x: Column) -> Column:
    """To three places, halves to even."""
    return F.bround(x, 3)


def squeezed_weight(w: Column) -> Column:
    return F.least(F.greatest(F.log1p(w), F.lit(0.0)), F.lit(2.0))


def hub_damped(w: Column, degree_a: Column, degree_b: Column) -> Column:
    return w / F.log(F.greatest(degree_a, degree_b, F.lit(math.e)))


def hop_cost(degree: Column) -> Column:
    return 1 + 0.5 * F.log(1 + degree)


def radius_by_degree(degree: Column) -> Column:
    return 0.35 + 0.19 * F.log(1 + degree)


def radius_by_views(views: Column, factor: float = 2.0, least: float = 1.0, most: Column | None = None, scale: float = 1500.0) -> Column:
    """By the logarithm of views; most: the views (a high quantile) that are drawn as large as `scale` views."""
    return factor * F.log1p(views if most is None else views * scale / most) + least


def radius_by_power(views: Column, power: float = 0.25, low: float = 2.0, high: float = 5.0) -> Column:
    return F.least(F.greatest(F.pow(views, power), F.lit(low)), F.lit(high))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def polar(x: Column, y: Column) -> tuple[Column, Column]:
    return F.hypot(x, y), F.atan2(y, x)


def hash_jitter(v: Column) -> tuple[Column, Column]:
    """Angle and radius parts (0 to 1) from a linear congruential hash of a node."""
    h = (low_bits(v) * F.lit(1103515245) + F.lit(12345)).bitwiseAND(0x7FFFFFFF)
    return (h % 100000) / 100000.0, F.floor(h / 100000) / 21475.0


def low_bits(v: Column) -> Column:
    """The 31 bits that a product's low 31 bits depend on, so that no product of a large number overflows."""
    return v.cast("long").bitwiseAND(0x7FFFFFFF)


def unit_hash(v: Column, salt: int) -> Column:
    """A number between 0 and 1 from steps of a linear congruential generator: the same on every machine and partition."""
    m = 0x7FFFFFFF
    h = (low_bits(v) * F.lit(1103515245) + F.lit(12345 + salt * 97531)).bitwiseAND(m)
    h = (h.bitwiseXOR(F.shiftright(h, 15)) * F.lit(1103515245) + F.lit(12345)).bitwiseAND(m)
    h = (h.bitwiseXOR(F.shiftright(h, 13)) * F.lit(69069) + F.lit(1)).bitwiseAND(m)
    return (h + 0.5) / 2147483648.0


def normal_hash(v: Column, salt: int) -> Column:
    """A standard normal number from two of them."""
    return F.sqrt(-2 * F.log(unit_hash(v, salt))) * F.cos(2 * math.pi * unit_hash(v, salt + 1))


def galactic(v: Column, groups: int = 7, parts: int = 12) -> tuple[Column, Column]:
    """Nodes dealt to groups on a wide ring, within one to parts on a ring around it, within one to a golden spiral
    with jitter that grows outward."""
    group, part = v % groups, F.floor(v / groups) % parts
    k = F.floor(F.floor(v / groups) / parts)
    local, r = 2 * math.pi * 0.618033988749895 * k, 0.39 * F.sqrt(k)
    jr, ja = unit_hash(v, 1) * (1.8 + 0.12 * r), unit_hash(v, 2) * 2 * math.pi
    at = lambda f: 850.0 * f(2 * math.pi * group / groups) + 220.0 * f(2 * math.pi * part / parts) + (r + jr * f(ja)) * f(local)
    return at(F.cos), at(F.sin)


#: Directions of the groups in the nebula, in degrees.
DIRECTIONS = (250.0, 320.0, 45.0, 15.0, 135.0, 210.0, 285.0)


def nebula(v: Column, n: int) -> tuple[Column, Column]:
    """n nodes in filaments, three a group, from a focus above the centre; the whole turned by 15 degrees."""
    base = F.element_at(F.array(*map(F.lit, DIRECTIONS)), (v % 7 + 1).cast("int")) * math.pi / 180
    angle = base + (F.floor(v / 7) % 3 - 1) * 0.18 + normal_hash(v, 3) * (0.08 + 0.05 * (v / n))
    r, turn = 1.05 * F.pow(v.cast("double"), 0.45) * (0.7 + 0.6 * unit_hash(v, 5)), 15 * math.pi / 180
    x, y = r * F.cos(angle), r * F.sin(angle)
    return x * math.cos(turn) - y * math.sin(turn), 350.0 + (x * math.sin(turn) + y * math.cos(turn))


def blended(corners: tuple[Column, Column, Column, Column], u: Column | float, v: Column | float) -> Column:
    """Between four layouts of a grid: (left low, right low, left high, right high), u to the right and v upwards."""
    a, b, c, d = corners
    return a * (1 - u) * (1 - v) + b * u * (1 - v) + c * (1 - u) * v + d * u * v


def ring_pull(r: Column, v: Column, most: Column | float, decay: float = 12.0) -> Column:
    """Nodes on the outermost ring drawn inwards to an exponential tail."""
    return F.when(r > 0.94 * most, 0.62 * most - F.log(unit_hash(v, 9)) * decay).otherwise(r)


def quantiser(lo: Column, hi: Column, pad: float = 1e-4) -> tuple[Column, Column]:
    """(low end, scale) of 16-bit numbers over a range that is padded on both sides."""
    wide = hi - lo
    return lo - pad * wide, 65535.0 / (wide + 2 * pad * wide)


def quantised(v: Column, lo: Column, scale: Column) -> Column:
    """To 0..65535, halves to even."""
    return F.least(F.greatest(F.bround((v - lo) * scale), F.lit(0)), F.lit(65535)).cast("long")


def dequantised(q: Column, lo: Column, scale: Column) -> Column:
    return q / scale + lo


def bezier(x0: Column, y0: Column, x1: Column, y1: Column, t: Column, curve: float) -> tuple[Column, Column]:
    """A point of the quadratic curve bowed to one side by a share of the distance, away from the origin."""
    mx, my, dx, dy = (x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0
    side = F.when(mx * -dy + my * dx >= 0, 1.0).otherwise(-1.0)
    cx, cy = mx - dy * curve * side, my + dx * curve * side
    at = lambda a, c, b: (1 - t) * (1 - t) * a + 2 * (1 - t) * t * c + t * t * b
    return at(x0, cx, x1), at(y0, cy, y1)


def rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    """One unsigned number, red in the lowest byte."""
    part = lambda c, k: F.shiftleft(c.cast("long"), k)
    return part(r, 0).bitwiseOR(part(g, 8)).bitwiseOR(part(b, 16)).bitwiseOR(part(a, 24))


def hex_channel(colour: Column, at: int) -> Column:
    """A channel of '#rrggbb': 0 red, 1 green, 2 blue."""
    return F.conv(F.substring(colour, 2 + 2 * at, 2), 16, 10).cast("long")


def dimmed(colour: Column, share: float) -> Column:
    """'#rrggbb' with each channel times a share."""
    part = lambda at: F.lpad(F.lower(F.hex(F.floor(hex_channel(colour, at) * share).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), part(0), part(1), part(2))


def golden_hue(k: Column) -> Column:
    x = k * F.lit(0.6180339887498949)
    return x - F.floor(x)


def to_screen(x: Column, centre: float, zoom: float, size: int) -> Column:
    return (x - centre) * (2.0**zoom) + size / 2


def duration_text(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit(" ms"))).otherwise(F.concat(F.format_string("%.2f", F.floor(ms / 10 + 0.5) / 100), F.lit(" s")))


def unit(v: Column) -> Column:
    """L2-normalised array of double; a zero vector stays."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def views_text(n: Column) -> Column:
    """Counts shown short: with M from a million on, with K from a thousand on."""
    tenths = lambda by: F.format_string("%.1f", F.floor(n / (by / 10) + 0.5) / 10)
    return F.when(n >= 1_000_000, F.concat(tenths(1_000_000), F.lit("M"))).when(n >= 1000, F.concat(tenths(1000), F.lit("K"))).otherwise(n.cast("string"))
