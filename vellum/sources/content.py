"""Page content streams: operators to events, events to positioned text chunks and marked spans.

Sequential by nature, so a page's stream is one row of an Arrow batch. The graphics state has a transform and a rendering of text
state; as in the engine this reproduces, a ``cm`` multiplies on the far side (``standard_cm`` takes the rule of the file format), q
and Q save the graphics state but not the text state, and text moves go by the length of the matrix's basis vectors. Operands are cleared
after every operator. Results leave column by column, some thousand rows at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBER = rb"[+-]?(?:\d+\.?\d*|\.\d+)"
ENDS = rb"(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z)"
#: six numbers with their matrix operator, and strings without escapes or nesting, are read as one
TOKEN = re.compile(
    rb"(?P<six>(?:" + NUMBER + rb"[ \n]+){6}(?:Tm|cm))" + ENDS + rb"|(?P<simple>\([^()\\]*\))|(?P<num>" + NUMBER + rb")" + ENDS
    + rb"|%[^\r\n]*|(?P<name>/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(?P<dict><<|>>)|(?P<hex><[0-9A-Fa-f\x00\t\n\x0c\r ]*>)|(?P<mark>[\[\](])|(?P<op>[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)"
)
#: the same with a matrix and the string shown after it as one
PLACED = re.compile(rb"(?P<shown>(?P<scale>" + rb"[ \n]+".join([NUMBER] * 4) + rb")[ \n]+(?P<x>" + NUMBER + rb")[ \n]+(?P<y>" + NUMBER + rb")[ \n]+Tm[ \n]*\((?P<string>[^()\\]*)\)[ \n]*Tj)" + ENDS + rb"|" + TOKEN.pattern)
ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
MCID = re.compile(r"/MCID\s*(\d+)")
SHOW, PATH = {"Tj", "TJ", "'", '"'}, set("m l c v y h re S s f F f* B B* b b* n W W*".split())


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The literal string whose first byte after the parenthesis is at; where it ends."""
    out, deep = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            n = data[at + 1 : at + 2]
            if m := re.compile(rb"[0-7]{1,3}").match(data, at + 1):
                out.append(int(m[0], 8) & 255)
                at = m.end()
                continue
            if n in b"\r\n" and n:
                at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
                continue
            out += ESCAPE.get(n, n)
            at += 2
            continue
        deep += (c == b"(") - (c == b")")
        at += 1
        if not deep:
            break
        out += c
    return bytes(out), at


def name_text(raw: bytes) -> str:
    return (re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes((int(m[1], 16),)), raw[1:]) if b"#" in raw else raw[1:]).decode("latin-1")


def operations(data: bytes, together: bool = False) -> Iterator[tuple[str, list]]:
    """(operator, operands); strings are bytes, names carry a slash, arrays are lists, dictionaries their source text. together: a Tm
    and the plain string that Tj shows right after it come as one operator, TmTj, with the first four numbers as they are written,
    the other two, and the string."""
    stack: list[list] = [[]]
    n, pattern = len(data), PLACED if together else TOKEN
    tokens = pattern.finditer(data)
    while (m := next(tokens, None)) is not None:
        kind = m.lastgroup
        if kind == "shown":
            scale, x, y, string = m.group("scale", "x", "y", "string")
            if stack == [[]]:
                yield "TmTj", [scale, float(x), float(y), string]
            else:
                yield "Tm", [*stack[0], *map(float, scale.split()), float(x), float(y)]
                yield "Tj", [string]
                stack = [[]]
        elif kind == "six":
            text = m[0]
            yield text[-2:].decode("latin-1"), stack[0] + [float(x) for x in text[:-2].split()]
            stack = [[]]
        elif kind == "simple":
            stack[-1].append(m[0][1:-1])
        elif kind == "num":
            stack[-1].append(float(m[0]))
        elif kind == "op":
            op = m[0].decode("latin-1")
            if op == "BI":
                at = m.end()
                e = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z)").search(data, at)
                yield "BI", [data[at : e.start() if e else n]]
                tokens = pattern.finditer(data, e.end() if e else n)
            else:
                yield op, stack[0]
            stack = [[]]
        elif kind == "name":
            stack[-1].append("/" + name_text(m[0]))
        elif kind == "hex":
            digits = re.sub(rb"\s|\x00", b"", m[0][1:-1])
            stack[-1].append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        elif kind == "dict" and m[0] == b"<<":
            deep, start, at = 1, m.start(), m.end()
            while deep and (d := re.compile(rb"<<|>>").search(data, at)):
                deep += 1 if d[0] == b"<<" else -1
                at = d.end()
            stack[-1].append(data[start:at].decode("latin-1"))
            tokens = pattern.finditer(data, at)
        elif kind == "mark" and m[0] == b"(":
            text, at = literal(data, m.end())
            stack[-1].append(text)
            tokens = pattern.finditer(data, at)
        elif kind == "mark" and m[0] == b"[":
            stack.append([])
        elif kind == "mark" and len(stack) > 1:
            done = stack.pop()
            stack[-1].append(done)


def times(m: list[float], n: list[float]) -> list[float]:
    return [m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5]]


KINDS = {"BT": "begin_text", "ET": "end_text", "Tf": "set_font", "Tm": "set_matrix", "Td": "move_text", "TD": "move_text", "T*": "move_text", "Do": "invoke_object", "sh": "paint_shading", "cm": "transform", "BI": "inline_image", "q": "save", "Q": "restore", "BMC": "begin_marked", "BDC": "begin_marked", "EMC": "end_marked", "w": "line_width", "d": "dash", "RG": "color", "rg": "color", "G": "color", "g": "color", "Tc": "text_state", "Tw": "text_state", "Tz": "text_state", "TL": "text_state", "Tr": "text_state", "Ts": "text_state"}


def shown(op: str, args: list) -> str:
    parts = args[-1] if op == "TJ" and args and isinstance(args[-1], list) else args[-1:]
    return "".join(x.decode("latin-1") for x in parts if isinstance(x, bytes))


def numbers_of(op: str, args: list) -> list[float]:
    """The numbers among the operands; of TJ and d those of the array too, in order."""
    out: list[float] = []
    for x in args:
        if isinstance(x, float):
            out.append(x)
        elif isinstance(x, list) and op in ("TJ", "d"):
            out += [y for y in x if isinstance(y, float)]
    return out


GROUP = re.compile(r"/Group\s*<<.*?/S\s*/Transparency", re.S)


def is_group(args: list, properties: Callable[[str], str] | None = None) -> bool:
    """Whether a marked span's properties (a name is looked up) make it a transparency group."""
    last = args[-1] if args and isinstance(args[-1], str) else ""
    if len(args) > 1 and last.startswith("/") and properties:
        last = properties(last[1:])
    return bool(GROUP.search(last))


STATE = ("ctm", "font", "font_size", "line_width", "line_cap", "line_join", "miter_limit", "fill", "stroke", "rendering_mode")


def events(data: bytes, properties: Callable[[str], str] | None = None, form: Callable[[str], Iterator[tuple]] | None = None, state: dict | None = None, standard_cm: bool = False) -> Iterator[tuple]:
    """(sequence, kind, operator, text, numbers), in the order of the stream; J, j and M set state without an event. A transform's
    numbers are the product so far, colours are held to 0..1. state: a dictionary that holds the graphics and text state at each
    event; form: the events of a named XObject, which follow the one that invokes it (theirs carry sequences of their own)."""
    k = 0
    now = {} if state is None else state
    now.update({"ctm": [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], "font": "", "font_size": 0.0, "line_width": 1.0, "line_cap": 0, "line_join": 0, "miter_limit": 10.0, "fill": [0.0], "stroke": [0.0], "rendering_mode": 0} if "ctm" not in now else {})
    saved: list[dict] = []
    groups: list[bool] = []
    for op, args in operations(data):
        numbers = numbers_of(op, args)
        if op in ("J", "j", "M"):
            if numbers:
                key = {"J": "line_cap", "j": "line_join", "M": "miter_limit"}[op]
                now[key] = numbers[0] if op == "M" else int(numbers[0])
            continue
        kind = "show_text" if op in SHOW else "path" if op in PATH else KINDS.get(op, "unknown")
        text = shown(op, args) if op in SHOW else next((x[1:] for x in args if isinstance(x, str) and x.startswith("/")), "")
        if op == "q":
            saved.append({c: now[c] for c in STATE if c not in ("font", "font_size", "rendering_mode")})
        elif op == "Q" and saved:
            now.update(saved.pop())
        elif op == "cm" and len(numbers) >= 6:
            numbers = now["ctm"] = times(numbers[:6], now["ctm"]) if standard_cm else times(now["ctm"], numbers[:6])
        elif op == "w" and numbers:
            now["line_width"] = numbers[0]
        elif op in ("RG", "rg", "G", "g"):
            numbers = [min(1.0, max(0.0, x)) for x in numbers]
            now["stroke" if op in ("RG", "G") else "fill"] = numbers
        elif op == "Tf" and numbers:
            now["font"], now["font_size"] = text, numbers[-1]
        elif op == "Tr" and numbers:
            now["rendering_mode"] = int(numbers[0])
        elif op in ("BMC", "BDC"):
            groups.append(is_group(args, properties))
            kind = "begin_group" if groups[-1] else kind
        elif op == "EMC" and groups:
            kind = "end_group" if groups.pop() else kind
        if op == "'":
            yield k, "move_text", op, "", []
            k += 1
        yield k, kind, op, text, numbers
        k += 1
        if op == "Do" and form:
            yield from form(text)


def mcid(args: list) -> int | None:
    """The number in a marked span's property dictionary, where it fits an integer."""
    m = MCID.search(args[-1]) if args and isinstance(args[-1], str) and args[-1].startswith("<<") else None
    return int(m[1]) if m and int(m[1]) < 1 << 31 else None


#: the parts of a chunk, in the order of its tuple
FIELDS = ("text", "op", "x0", "x1", "y", "l", "b", "r", "t", "font", "font_size", "rendering_mode", "marked", "mcid")


def chunks(data: bytes, standard_cm: bool = False, **options) -> Iterator[dict]:
    """Text chunks with start, end, box, font size, rendering mode, the open marked spans and the innermost number among them."""
    for c in chunk_tuples(data, standard_cm, **options):
        yield dict(zip(FIELDS, c, strict=True))


UNMOVED = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]


def chunk_tuples(data: bytes, standard_cm: bool = False, invisible: bool = True, ctm: list[float] | None = None, decode: Callable[[str, bytes], str] | None = None, width: Callable[[str, bytes], float | None] | None = None, form: Callable[[str, list[float]], Iterator[tuple]] | None = None, spans: list | None = None) -> Iterator[tuple]:
    """FIELDS of each chunk. decode: the text of a string in a font (Latin-1 without it); width: its width in thousandths of an em
    (half an em a character where that is None); form: the chunks of a named XObject under a transform; spans: gets the marked
    spans as they close, [tag, property, number, depth, text]."""
    ctm, saved = list(ctm or (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)), []
    font, size, tc, tw, tz, tl, tr, ts = "", 0.0, 0.0, 0.0, 100.0, 0.0, 0, 0.0
    lx, ly, pen, sx, sy = 0.0, 0.0, 0.0, 1.0, 1.0
    #: open spans [tag, property, number, depth, text], None for a transparency group
    open_: list[list | None] = []
    marked: list[str] = []
    number: int | None = None

    def reopened() -> None:
        nonlocal marked, number
        live = [x for x in open_ if x is not None]
        marked, number = [x[0] for x in live], next((x[2] for x in reversed(live) if x[2] is not None), None)

    #: the texts and widths of plain strings met so far; words come again
    met: dict[tuple[str, bytes], tuple[str, float | None]] = {}
    for op, args in operations(data, True):
        if op == "TmTj":
            scale, lx, ly, string = args
            pen = lx
            if scale == b"1 0 0 1":
                sx = sy = 1.0
            else:
                nums = [float(x) for x in scale.split()]
                sx, sy = math.hypot(nums[0], nums[1]), math.hypot(nums[2], nums[3])
            if open_ or tc or tw or ctm != UNMOVED or not invisible:
                op, args = "Tj", [string]
            else:
                if (key := (font, string)) not in met:
                    met[key] = decode(font[1:], string) if decode else string.decode("latin-1"), width(font[1:], string) if width else None
                text, w = met[key]
                fs, h = size if size > 0 else 12.0, tz / 100
                wide = max(0.0, (w / 1000 if w is not None else len(text) * 0.5) * fs * sx * h)
                if text:
                    y = ly + ts
                    yield text, "Tj", pen, pen + wide, y, pen, y - 0.2 * fs * sy, pen + wide, y + 0.8 * fs * sy, font, fs, int(tr), marked, number
                pen += wide
                continue
        if op == "Tm":
            nums = [x for x in args if isinstance(x, float)]
            if len(nums) >= 6:
                lx, ly, pen = nums[4], nums[5], nums[4]
                sx, sy = math.hypot(nums[0], nums[1]), math.hypot(nums[2], nums[3])
        elif op in SHOW:
            nums = [x for x in args if isinstance(x, float)]
            if op == "'":
                ly -= tl * sy
                pen = lx
            if op == '"' and len(nums) >= 2:
                tw, tc = nums[0], nums[1]
            fs, h = size if size > 0 else 12.0, tz / 100
            text, kern, units, known = "", 0.0, 0.0, True
            for x in args[-1] if op == "TJ" and args and isinstance(args[-1], list) else args[-1:]:
                if isinstance(x, bytes):
                    text += decode(font[1:], x) if decode else x.decode("latin-1")
                    w = width(font[1:], x) if width else None
                    known = known and w is not None
                    units += w or 0.0
                elif isinstance(x, float):
                    step = -x / 1000 * fs * sx * h
                    kern += step
                    if text and step >= max(0.35, 0.06 * fs * sy) and not text.endswith(" "):
                        text += " "
            glyphs = len(text)
            wide = (units / 1000 if known and width else glyphs * 0.5) * fs * sx * h + kern
            if tc and glyphs > 1:
                wide += (glyphs - 1) * tc * sx * h
            if tw:
                wide += text.count(" ") * tw * sx * h
            wide = max(0.0, wide)
            if text and (invisible or int(tr) != 3):
                for x in open_:
                    if x is not None:
                        x[4] += text
                y, end, a, b, c, d, e, f = ly + ts, pen + wide, *ctm
                low, high = y - 0.2 * fs * sy, y + 0.8 * fs * sy
                xs = (a * pen + c * low + e, a * end + c * low + e, a * pen + c * high + e, a * end + c * high + e)
                ys = (b * pen + d * low + f, b * end + d * low + f, b * pen + d * high + f, b * end + d * high + f)
                yield text, op, a * pen + c * y + e, a * end + c * y + e, b * pen + d * y + f, min(xs), min(ys), max(xs), max(ys), font, fs, int(tr), marked, number
            pen += wide
        elif op == "q":
            saved.append(list(ctm))
        elif op == "Q":
            ctm = saved.pop() if saved else ctm
        elif op == "BT":
            lx, ly, pen, sx, sy = 0.0, 0.0, 0.0, 1.0, 1.0
        elif op in ("BMC", "BDC"):
            tag = next((x[1:] for x in args if isinstance(x, str)), "")
            prop = args[-1] if op == "BDC" and len(args) > 1 and isinstance(args[-1], str) else ""
            open_.append(None if is_group(args) else [tag, prop, mcid(args), sum(x is not None for x in open_), ""])
            reopened()
        elif op == "EMC":
            if open_ and (done := open_.pop()) is not None and spans is not None:
                spans.append(done)
            reopened()
        elif op == "Do":
            if form and args and isinstance(args[-1], str):
                yield from form(args[-1][1:], ctm)
        else:
            nums = [x for x in args if isinstance(x, float)]
            if op == "cm" and len(nums) >= 6:
                ctm = times(nums[:6], ctm) if standard_cm else times(ctm, nums[:6])
            elif op == "Tf" and nums:
                font, size = next((x for x in args if isinstance(x, str)), font), nums[-1]
            elif op in ("Td", "TD") and len(nums) >= 2:
                tl = -nums[1] if op == "TD" else tl
                lx, ly = lx + nums[0] * sx, ly + nums[1] * sy
                pen = lx
            elif op == "T*":
                ly -= tl * sy
                pen = lx
            elif op in ("Tc", "Tw", "Tz", "TL", "Tr", "Ts") and nums:
                tc, tw, tz, tl, tr, ts = (nums[0] if op == o else v for o, v in (("Tc", tc), ("Tw", tw), ("Tz", tz), ("TL", tl), ("Tr", tr), ("Ts", ts)))
    if spans is not None:
        spans += [x for x in reversed(open_) if x is not None]


EVENT = "seq int, kind string, op string, text string, numbers array<double>"
SNAPSHOT = "ctm array<double>, font string, font_size double, line_width double, line_cap int, line_join int, miter_limit double, fill array<double>, stroke array<double>, rendering_mode int"
FLAT = "chunk_index int, text string, op string, x0 double, x1 double, y double, l double, b double, r double, t double, font string, font_size double, rendering_mode int, marked array<string>, mcid int"
SPAN = "seq int, tag string, property string, mcid int, depth int, text string"
ROWS = 8192
#: bytes of binary values that go out together, such as bitmaps and decoded streams
BYTES = 8 << 20


def columnar(df: DataFrame, schema: str, make: Callable[[bytes], Iterator[tuple]], errors: tuple = (), body: str = "content") -> DataFrame:
    """df: key columns and a binary one. The keys with the tuples that make() gives for each row's bytes, some thousand rows or ``BYTES``
    of binary values at a time. errors: exceptions that give one row with null columns and the error as the last instead of what the row had."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = [c for c in df.columns if c != body]
    added = df.sparkSession.createDataFrame([], schema).schema
    target = df.select(*keys).schema
    for f in added:
        target = target.add(f)
    arrow = to_arrow_schema(added)
    heavy = [k for k, f in enumerate(arrow) if pa.types.is_binary(f.type)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            owner: list[int] = []
            held = 0

            def packed() -> pa.RecordBatch:
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)  # noqa: B023
                at = pa.array(owner, pa.int64())  # noqa: B023
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keys), *(pa.array(x, f.type) for x, f in zip(cols, arrow, strict=True))], names=[*keys, *arrow.names])  # noqa: B023

            for i, data in enumerate(batch.column(body)):
                raw = data.as_buffer().to_pybytes() if data.is_valid else b""
                try:
                    made = [(*x, None) for x in make(raw)] if errors else make(raw)
                except errors as e:
                    made = [(*[None] * (len(arrow) - 1), f"{type(e).__name__}: {e}")]
                for x in made:
                    rows.append(x)
                    owner.append(i)
                    for k in heavy:
                        held += len(x[k] or b"")
                    if len(rows) >= ROWS or held >= BYTES:
                        yield packed()
                        rows, owner, held = [], [], 0
            yield packed()

    return df.mapInArrow(run, target)


def boxed(df: DataFrame, keys: list[str], rest: tuple[str, ...] = ()) -> DataFrame:
    """The flat chunk columns with their box as one."""
    names = ["chunk_index", "text", "op", "x0", "x1", "y"]
    return df.select(*keys, *names, F.struct(*"lbrt").alias("bbox"), "font", "font_size", "rendering_mode", "marked", "mcid", *rest)


def content_events(df: DataFrame, state: bool = False, standard_cm: bool = False) -> DataFrame:
    """df: key columns and content (binary). A row an event; state: with the graphics and text state after it."""

    def make(data: bytes) -> Iterator[tuple]:
        now: dict = {}
        for e in events(data, state=now, standard_cm=standard_cm):
            yield (*e, *(now[c] for c in STATE)) if state else e

    return columnar(df, f"{EVENT}, {SNAPSHOT}" if state else EVENT, make)


def content_chunks(df: DataFrame, standard_cm: bool = False) -> DataFrame:
    """df: key columns and content (binary). A row a chunk, in stream order."""
    keys = [c for c in df.columns if c != "content"]
    return boxed(columnar(df, FLAT, lambda data: ((k, *c) for k, c in enumerate(chunk_tuples(data, standard_cm)))), keys)


def content_spans(df: DataFrame) -> DataFrame:
    """df: key columns and content (binary). A row a marked span, in the order they close: tag, property, number, depth, the text within."""

    def make(data: bytes) -> Iterator[tuple]:
        spans: list[list] = []
        for _ in chunk_tuples(data, spans=spans):
            pass
        return ((k, *s) for k, s in enumerate(spans))

    return columnar(df, SPAN, make)
