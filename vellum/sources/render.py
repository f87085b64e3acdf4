"""Pages to bitmaps: paths filled and stroked, clips, images and forms; text is not drawn, for font programs are not read.

A pixel is inked if its centre lies inside. Winding numbers of a whole path come from one cumulative sum over the crossings of its
edges with the pixel rows, so the cost follows the edges' heights and the path's box. ``smooth`` renders larger and averages.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from vellum.sources.content import columnar, operations, times
from vellum.sources.pdf import ERRORS, USUAL, File, Limits, Ref, Stream

CURVE_STEPS = 16
RENDERED = "page_index int, width int, height int, data binary, error string"


def size_of(points: float, dpi: float, smooth: int = 1) -> int:
    return max(1, math.ceil(points * dpi / 72 * smooth))


def mask(edges: list[np.ndarray], width: int, height: int, even_odd: bool) -> tuple[slice, slice, np.ndarray] | None:
    """Which pixels of the path's box are inside. edges: closed polygons in device space, (n, 2) each."""
    if not edges:
        return None
    if len(edges) == 1 and len(edges[0]) == 4:
        (x0, y0), (x1, y1), (x2, y2), (x3, y3) = edges[0].tolist()
        if y0 == y1 and x1 == x2 and y2 == y3 and x3 == x0:  # an upright rectangle: the pixels with their centres in it, all of them
            rows, columns = (slice(min(n, max(0, math.ceil(min(u, v) - 0.5))), max(0, min(n, math.ceil(max(u, v) - 0.5)))) for u, v, n in ((y0, y2, height), (x0, x1, width)))
            high, wide = rows.stop - rows.start, columns.stop - columns.start
            return (rows, columns, np.ones((high, wide), bool)) if high > 0 and wide > 0 else None
    a = np.concatenate(edges)
    b = np.concatenate([np.roll(p, -1, axis=0) for p in edges])
    left, right = max(0, math.floor(a[:, 0].min())), min(width, math.ceil(a[:, 0].max()) + 1)
    top, bottom = max(0, math.floor(a[:, 1].min())), min(height, math.ceil(a[:, 1].max()) + 1)
    if left >= right or top >= bottom:
        return None
    first = np.clip(np.ceil(np.minimum(a[:, 1], b[:, 1]) - 0.5), top, bottom).astype(np.int64)
    last = np.clip(np.ceil(np.maximum(a[:, 1], b[:, 1]) - 0.5), top, bottom).astype(np.int64)
    many = last - first
    own = np.repeat(np.arange(len(a)), many)
    row = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + first[own]
    slope = (b[own, 0] - a[own, 0]) / np.where(b[own, 1] == a[own, 1], 1.0, b[own, 1] - a[own, 1])
    column = np.clip(np.ceil(a[own, 0] + (row + 0.5 - a[own, 1]) * slope - 0.5), left, right).astype(np.int64)
    turn = np.zeros((bottom - top, right - left + 1), np.int32)
    np.add.at(turn, (row - top, column - left), 1 if even_odd else np.where(b[own, 1] > a[own, 1], 1, -1))
    inside = np.cumsum(turn, axis=1)[:, :-1]
    return slice(top, bottom), slice(left, right), (inside % 2 == 1) if even_odd else inside != 0


class Canvas:
    def __init__(self, box: list[float], dpi: float, smooth: int):
        self.width, self.height = size_of(box[2] - box[0], dpi, smooth), size_of(box[3] - box[1], dpi, smooth)
        k = dpi / 72 * smooth
        self.base = [k, 0.0, 0.0, -k, -box[0] * k, box[3] * k]
        self.pixels = np.full((self.height, self.width, 3), 255.0)

    def paint(self, where: tuple | None, clip: np.ndarray | None, color: np.ndarray, alpha: float = 1.0) -> None:
        if where is None:
            return
        rows, columns, inside = where
        if clip is not None:
            inside = inside & clip[rows, columns]
        part = self.pixels[rows, columns]
        if clip is None and alpha == 1 and color.ndim == 1 and inside.all():
            part[:] = color
            return
        part[inside] = part[inside] * (1 - alpha) + (color[inside] if color.ndim == 3 else color) * alpha

    def clipped(self, where: tuple | None, clip: np.ndarray | None) -> np.ndarray:
        out = np.zeros((self.height, self.width), bool)
        if where is not None:
            out[where[0], where[1]] = where[2]
        return out if clip is None else out & clip


def points(path: list[list[tuple[float, float]]], m: list[float]) -> list[np.ndarray]:
    out = []
    for p in path:
        if len(p) > 1:
            xy = np.array(p, float)
            out.append(np.stack([m[0] * xy[:, 0] + m[2] * xy[:, 1] + m[4], m[1] * xy[:, 0] + m[3] * xy[:, 1] + m[5]], axis=1))
    return out


def outline(path: list[np.ndarray], closed: list[bool], width: float) -> list[np.ndarray]:
    """Each segment as a box of the line's width, all turning the same way."""
    out = []
    for p, shut in zip(path, closed, strict=True):
        a, b = (p, np.roll(p, -1, axis=0)) if shut else (p[:-1], p[1:])
        d = b - a
        n = np.hypot(d[:, 0], d[:, 1])
        live = n > 0
        a, b, d = a[live], b[live], d[live] / n[live, None]
        side = np.stack([-d[:, 1], d[:, 0]], axis=1) * width / 2
        out += list(np.stack([a + side, b + side, b - side, a - side], axis=1))
    return out


def color_of(op: str, nums: list[float]) -> np.ndarray | None:
    n = [min(1.0, max(0.0, x)) for x in nums]
    if op in ("g", "G") and n:
        return np.array([n[0]] * 3) * 255
    if op in ("rg", "RG") and len(n) >= 3:
        return np.array(n[:3]) * 255
    if op in ("k", "K") and len(n) >= 4:
        return np.array([(1 - x) * (1 - n[3]) for x in n[:3]]) * 255
    return None


def image_pixels(f: File, s: Stream) -> np.ndarray | None:
    w, h, space = int(f.get(s.head.get("Width", 0))), int(f.get(s.head.get("Height", 0))), f.get(s.head.get("ColorSpace"))
    c = {"DeviceGray": 1, "DeviceRGB": 3}.get(str(space))
    if not c or f.get(s.head.get("BitsPerComponent")) != 8 or not w or not h:
        return None
    data = np.frombuffer(f.decoded(s), np.uint8)
    return None if len(data) < w * h * c else np.broadcast_to(data[: w * h * c].reshape(h, w, c), (h, w, 3))


def draw(f: File, canvas: Canvas, data: bytes, resources, m: list[float], clip: np.ndarray | None, active: frozenset = frozenset(), deep: int = 0) -> None:
    own = x if isinstance(x := f.get(resources), dict) else {}
    objects, states = f.part(own, "XObject"), f.part(own, "ExtGState")
    state = {"m": m, "clip": clip, "fill": np.zeros(3), "stroke": np.zeros(3), "width": 1.0, "ca": 1.0, "CA": 1.0}
    saved: list[dict] = []
    path: list[list[tuple[float, float]]] = []
    closed: list[bool] = []
    pending = ""
    for op, args in operations(data):
        nums = [x for x in args if isinstance(x, float)]
        if op == "q":
            saved.append(dict(state))
        elif op == "Q":
            state = saved.pop() if saved else state
        elif op == "cm" and len(nums) >= 6:
            state["m"] = times(nums[:6], state["m"])
        elif op == "w" and nums:
            state["width"] = nums[0]
        elif op in ("g", "rg", "k", "G", "RG", "K"):
            c = color_of(op, nums)
            if c is not None:
                state["fill" if op.islower() else "stroke"] = c
        elif op == "gs" and args:
            d = f.part(states, str(args[-1])[1:])
            for k in ("ca", "CA"):
                if k in d:
                    state[k] = float(f.get(d[k]))
        elif op == "m" and len(nums) >= 2:
            path.append([(nums[0], nums[1])])
            closed.append(False)
        elif op == "re" and len(nums) >= 4:
            x, y, w, h = nums[:4]
            path.append([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
            closed.append(True)
        elif path and op == "l" and len(nums) >= 2:
            path[-1].append((nums[0], nums[1]))
        elif path and op in ("c", "v", "y") and len(nums) >= (6 if op == "c" else 4):
            p0 = path[-1][-1]
            p1, p2, p3 = (nums[:2], nums[2:4], nums[4:6]) if op == "c" else (p0, nums[:2], nums[2:4]) if op == "v" else (nums[:2], nums[2:4], nums[2:4])
            for t in np.arange(1, CURVE_STEPS + 1) / CURVE_STEPS:
                path[-1].append(tuple(float((1 - t) ** 3 * a + 3 * (1 - t) ** 2 * t * b + 3 * (1 - t) * t * t * c + t**3 * d) for a, b, c, d in zip(p0, p1, p2, p3, strict=True)))
        elif path and op == "h":
            closed[-1] = True
        elif op in ("W", "W*"):
            pending = op
        elif op in ("f", "F", "f*", "B", "B*", "b", "b*", "S", "s", "n"):
            if op in ("b", "b*", "s") and path:
                closed[-1] = True
            shape = points(path, state["m"])
            kept = [c for p, c in zip(path, closed, strict=True) if len(p) > 1]
            if op[0] in "fFBb":
                canvas.paint(mask(shape, canvas.width, canvas.height, op.endswith("*")), state["clip"], state["fill"], state["ca"])
            if op[0] in "SsBb":
                a = state["m"]
                wide = max(1.0, state["width"] * math.sqrt(abs(a[0] * a[3] - a[1] * a[2])))
                canvas.paint(mask(outline(shape, kept, wide), canvas.width, canvas.height, False), state["clip"], state["stroke"], state["CA"])
            if pending:
                state["clip"] = canvas.clipped(mask(shape, canvas.width, canvas.height, pending == "W*"), state["clip"])
            path, closed, pending = [], [], ""
        elif op == "Do" and args and isinstance(args[-1], str):
            ref = objects.get(args[-1][1:])
            s = f.get(ref)
            if isinstance(s, Stream) and s.head.get("Subtype") == "Image":
                paint_image(canvas, image_pixels(f, s), state)
            elif (s := f.form(ref, active, deep)) is not None:
                inner = [float(f.get(x)) for x in f.get(s.head.get("Matrix")) or (1, 0, 0, 1, 0, 0)]
                draw(f, canvas, f.decoded(s), s.head.get("Resources", own), times(inner, state["m"]), state["clip"], active | {ref} if isinstance(ref, Ref) else active, deep + 1)


def paint_image(canvas: Canvas, image: np.ndarray | None, state: dict) -> None:
    """Each pixel takes the nearest of the image, found by undoing the transform."""
    m = state["m"]
    det = m[0] * m[3] - m[1] * m[2]
    where = mask(points([[(0, 0), (1, 0), (1, 1), (0, 1)]], m), canvas.width, canvas.height, False) if image is not None and det else None
    if where is None:
        return
    x, y = np.meshgrid(np.arange(where[1].start, where[1].stop) + 0.5 - m[4], np.arange(where[0].start, where[0].stop) + 0.5 - m[5])
    u, v = (m[3] * x - m[2] * y) / det, (m[0] * y - m[1] * x) / det
    h, w = image.shape[:2]
    color = image[np.clip(((1 - v) * h).astype(np.int64), 0, h - 1), np.clip((u * w).astype(np.int64), 0, w - 1)].astype(float)
    canvas.paint(where, state["clip"], color, state["ca"])


def render_page(f: File, page: dict, dpi: float = 96, smooth: int = 1) -> np.ndarray:
    """RGB pixels, rotated as the page says."""
    canvas = Canvas(page["crop_box"], dpi, smooth)
    draw(f, canvas, page["content"], page["resources"], canvas.base, None)
    p = canvas.pixels
    if smooth > 1:
        h, w = -(-canvas.height // smooth), -(-canvas.width // smooth)
        p = np.pad(p, ((0, h * smooth - canvas.height), (0, w * smooth - canvas.width), (0, 0)), mode="edge").reshape(h, smooth, w, smooth, 3).mean((1, 3))
    p += 0.5  # pixels are not negative, so cutting the fraction off rounds them
    return np.rot90(p.astype(np.uint8), -(page["rotation"] // 90))


def render_pages(files: DataFrame, dpi: float = 96, smooth: int = 1, limits: Limits = USUAL, measures: dict[str, Callable[[np.ndarray], int]] | None = None) -> DataFrame:
    """A row a page: page_index, width, height, data (RGB bytes). measures: whole numbers to be taken from the pixels (height, width, 3)
    where they are drawn; they come instead of the data, so no bitmap leaves its worker."""
    schema = RENDERED if measures is None else RENDERED.replace("data binary", ", ".join(f"{k} bigint" for k in measures))

    def make(data: bytes) -> Iterator[tuple]:
        f = File(data, limits)
        for page in f.pages():
            p = render_page(f, page, dpi, smooth)
            yield page["page_index"], p.shape[1], p.shape[0], *([np.ascontiguousarray(p).tobytes()] if measures is None else [int(m(p)) for m in measures.values()])

    return columnar(files, schema, lambda data: list(make(data)), ERRORS)
