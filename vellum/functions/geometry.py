"""Rectangles, affine maps, function objects, shadings and pixels as Column expressions.

A rectangle is four columns or a struct of l, b, r, t. Function objects follow PDF types 0 (nearest sample), 2, 3 and 4.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(l: Column, b: Column, r: Column, t: Column) -> Column:  # noqa: E741
    return F.struct(l.alias("l"), b.alias("b"), r.alias("r"), t.alias("t"))


def width(a: Column) -> Column:
    return a["r"] - a["l"]


def height(a: Column) -> Column:
    return a["t"] - a["b"]


def empty(a: Column) -> Column:
    return (width(a) <= 0) | (height(a) <= 0)


def intersects(a: Column, b: Column) -> Column:
    """Closed: rectangles that touch intersect."""
    return (a["l"] <= b["r"]) & (a["r"] >= b["l"]) & (a["b"] <= b["t"]) & (a["t"] >= b["b"])


def contains(outer: Column, inner: Column) -> Column:
    return (inner["l"] >= outer["l"]) & (inner["r"] <= outer["r"]) & (inner["b"] >= outer["b"]) & (inner["t"] <= outer["t"])


def union_of(a: Column) -> Column:
    """Aggregate: the smallest rectangle around a group's."""
    return rect(F.min(a["l"]), F.min(a["b"]), F.max(a["r"]), F.max(a["t"]))


def transform_point(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """m: a, b, c, d, e, f."""
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def transform_rect(m: list[Column], a: Column) -> Column:
    corners = [transform_point(m, a[x], a[y]) for x in "lr" for y in "bt"]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def exponential(x: Column, c0: list[float], c1: list[float], n: float) -> list[Column]:
    return [F.lit(a) + F.pow(clamp01(x), F.lit(n)) * F.lit(b - a) for a, b in zip(c0, c1, strict=True)]


def sampled(x: Column, samples: list[float]) -> Column:
    """The nearest sample, half away from zero, without interpolation."""
    at = F.floor(clamp01(x) * (len(samples) - 1) + 0.5).cast("int")
    return F.element_at(F.array(*map(F.lit, samples)), at + 1)


def stitched(x: Column, bounds: list[float], pieces: list[Column]) -> Column:
    """A value equal to a bound belongs to the piece on its left."""
    out = F.when(x <= bounds[0], pieces[0])
    for b, p in zip(bounds[1:], pieces[1:-1], strict=True):
        out = out.when(x <= b, p)
    return out.otherwise(pieces[-1])


def calculator(program: str, *inputs: Column) -> list[Column]:
    """A type 4 program without conditionals, unrolled into expressions: the operand stack holds Columns."""
    stack = list(inputs)
    two = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b, "min": F.least, "max": F.greatest}
    one = {"neg": lambda a: -a, "abs": F.abs, "sqrt": F.sqrt}
    for token in program.replace("{", " ").replace("}", " ").split():
        if token in two:
            b, a = stack.pop(), stack.pop()
            stack.append(two[token](a, b))
        elif token in one:
            stack.append(one[token](stack.pop()))
        elif token == "dup":
            stack.append(stack[-1])
        elif token == "pop":
            stack.pop()
        elif token == "exch":
            stack[-1], stack[-2] = stack[-2], stack[-1]
        else:
            stack.append(F.lit(float(token)))
        if len(stack) > 256:
            raise ValueError("calculator stack")
    return stack


def axial(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float, extend: tuple[bool, bool] = (False, False)) -> Column:
    """The parameter of an axial shading at a point; null outside without extension."""
    dx, dy = x1 - x0, y1 - y0
    t = ((x - x0) * dx + (y - y0) * dy) / F.lit(dx * dx + dy * dy)
    low = F.when(t < 0, F.lit(0.0) if extend[0] else F.lit(None).cast("double"))
    return low.when(t > 1, F.lit(1.0) if extend[1] else F.lit(None).cast("double")).otherwise(t)


def radial(x: Column, y: Column, x0: float, y0: float, r0: float, x1: float, y1: float, r1: float, extend: tuple[bool, bool] = (False, False)) -> Column:
    """The larger of the two parameters whose circles pass through the point; null outside without extension."""
    cx, cy, dr = x1 - x0, y1 - y0, r1 - r0
    px, py = x - x0, y - y0
    a = cx * cx + cy * cy - dr * dr
    half = px * cx + py * cy + F.lit(r0 * dr)
    c = px * px + py * py - F.lit(r0 * r0)
    if abs(a) <= 1e-12:
        t = F.when(F.abs(half) > 5e-13, c / (half * 2))
    else:
        disc = half * half - c * a
        root = F.sqrt(F.greatest(disc, F.lit(0.0)))
        t = F.when(disc >= 0, F.greatest((half - root) / a, (half + root) / a))
    out = F.when((t < 0) & F.lit(not extend[0]), None).when((t > 1) & F.lit(not extend[1]), None)
    return out.otherwise(F.when(t.isNotNull(), clamp01(t)))


def normal_rotation(r: Column) -> Column:
    return F.pmod(r, F.lit(360))


def page_to_device(x: Column, y: Column, rotation: Column, w: Column, h: Column, scale: float) -> tuple[Column, Column]:
    """Pixels of a point of a page of size w by h under its rotation; y grows downwards."""
    r = normal_rotation(rotation)
    dx = F.when(r == 90, y).when(r == 180, w - x).when(r == 270, h - y).otherwise(x)
    dy = F.when(r == 90, x).when(r == 180, y).when(r == 270, w - x).otherwise(h - y)
    return dx * scale, dy * scale


def pixel_size(points: Column, dpi: float, antialias: int = 1) -> Column:
    return F.ceil(points * F.lit(dpi / 72.0 * antialias)).cast("bigint")


def grayscale(r: Column, g: Column, b: Column) -> Column:
    return F.round(r * 0.2126 + g * 0.7152 + b * 0.0722).cast("int")


def keep_aspect(w: Column, h: Column, new_w: Column) -> Column:
    """The height that keeps the aspect at a new width, by integer division, at least 1."""
    return F.greatest(F.lit(1), F.floor(new_w * h / w)).cast("bigint")


def hex_color(s: Column) -> Column:
    """Red, green and blue of six hex digits as shares of 255; a digit that is none counts as 0."""
    clean = F.regexp_replace(s, "[^0-9A-Fa-f]", "0")
    return F.array(*(F.conv(F.substring(clean, k, 2), 16, 10).cast("double") / 255.0 for k in (1, 3, 5)))


def parsed_function(source: Column, x: Column) -> Column:
    """A function given as a dictionary's text, at x: type 2 (exponential) or type 4 (a program in braces after the dictionary); others,
    and what cannot be read, give null."""
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series, at: pd.Series) -> pd.Series:
        known = {t: function_of(t) for t in texts.dropna().unique()}
        return pd.Series([None if t is None or known[t] is None else known[t](float(v)) for t, v in zip(texts, at, strict=True)])

    return run(source, x)


def function_of(text: str):
    from vellum.sources.pdf import PdfError, parse

    try:
        head, end = parse(text.encode("latin-1"), 0)
        low, high = (float(v) for v in head.get("Domain", [0, 1])[:2])
        span = head.get("Range")
        bound = lambda out: [min(max(v, span[2 * k]), span[2 * k + 1]) for k, v in enumerate(out)] if span else out
        held = lambda v: min(max(v, low), high)
        if head.get("FunctionType") == 2:
            a, b, n = head.get("C0", [0.0]), head.get("C1", [1.0]), head["N"]
            return lambda v: bound([float(p + held(v) ** n * (q - p)) for p, q in zip(a, b, strict=True)])
        if head.get("FunctionType") == 4:
            program = text[end:].replace("{", " ").replace("}", " ").split()
            return lambda v: bound([float(r) for r in _program(program, [held(v)])])
    except (PdfError, ValueError, KeyError, TypeError, AttributeError):
        pass
    return None


def _program(program: list[str], stack: list[float]) -> list[float]:
    two = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b, "exp": lambda a, b: a**b}
    one = {"neg": lambda a: -a, "abs": abs, "sqrt": lambda a: a**0.5, "truncate": lambda a: float(int(a)), "floor": lambda a: a // 1, "ceiling": lambda a: -(-a // 1)}
    for word in program:
        if word in two:
            b, a = stack.pop(), stack.pop()
            stack.append(two[word](a, b))
        elif word in one:
            stack.append(one[word](stack.pop()))
        elif word == "dup":
            stack.append(stack[-1])
        elif word == "exch":
            stack[-1], stack[-2] = stack[-2], stack[-1]
        elif word == "pop":
            stack.pop()
        else:
            stack.append(float(word))
    return stack
