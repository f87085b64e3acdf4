"""Drawing commands as strings, built of columns: state, colours, lines, shapes, text, marks, images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.strings import escape_literal

#: how far the control points of a quarter circle lie, as a share of its radius
KAPPA = 0.5522847498


def number(c: Column | float) -> Column:
    """Up to four places, no zeros at the end."""
    c = c if isinstance(c, Column) else F.lit(float(c))
    return F.regexp_replace(c.cast("decimal(18,4)").cast("string"), r"\.?0+$", "")


def command(op: str, *args: Column | float) -> Column:
    return F.concat_ws(" ", *map(number, args), F.lit(op))


def together(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def saved(*parts: Column) -> Column:
    return together(F.lit("q"), *parts, F.lit("Q"))


def fill_color(r, g, b) -> Column:
    return command("rg", r, g, b)


def stroke_color(r, g, b) -> Column:
    return command("RG", r, g, b)


def line_style(width, cap: int = 0, join: int = 0, dash: tuple[float, ...] = ()) -> Column:
    dashes = F.concat(F.lit("["), F.concat_ws(" ", *map(number, dash)), F.lit("] 0 d"))
    return together(command("w", width), F.lit(f"{cap} J"), F.lit(f"{join} j"), *([dashes] if dash else []))


def line(x0, y0, x1, y1) -> Column:
    return together(command("m", x0, y0), command("l", x1, y1), F.lit("S"))


def polygon(points: list[tuple], paint: str = "S") -> Column:
    return together(command("m", *points[0]), *(command("l", *p) for p in points[1:]), F.lit("h"), F.lit(paint))


def rectangle(x, y, width, height, paint: str = "S") -> Column:
    return together(command("re", x, y, width, height), F.lit(paint))


def circle(x, y, r, paint: str = "S") -> Column:
    """Four curves."""
    k = r * KAPPA
    return together(
        command("m", x + r, y), command("c", x + r, y + k, x + k, y + r, x, y + r), command("c", x - k, y + r, x - r, y + k, x - r, y),
        command("c", x - r, y - k, x - k, y - r, x, y - r), command("c", x + k, y - r, x + r, y - k, x + r, y), F.lit(paint),
    )


def text(x, y, size, s: Column, font: str = "F1") -> Column:
    return together(F.lit("BT"), F.concat(F.lit(f"/{font} "), command("Tf", size)), command("Td", x, y), F.concat(escape_literal(s), F.lit(" Tj")), F.lit("ET"))


def marked(tag: str, mcid: Column, *parts: Column) -> Column:
    return together(F.concat(F.lit(f"/{tag} <</MCID "), mcid.cast("string"), F.lit(">> BDC")), *parts, F.lit("EMC"))


def artifact(*parts: Column) -> Column:
    return together(F.lit("/Artifact BMC"), *parts, F.lit("EMC"))


def image(name: str, x, y, width, height) -> Column:
    zero = F.lit(0.0)
    return saved(command("cm", width, zero, zero, height, x, y), F.lit(f"/{name} Do"))
