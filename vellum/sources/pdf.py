"""PDF files as tables: a reader (objects, cross-references, page trees, side tables, recovery) and a writer of object graphs.

A file is one row; ``read_objects``, ``read_pages`` and ``read_chunks`` turn rows of bytes into rows of objects, pages and text chunks. Classic and stream
cross-references, hybrid files, object streams, revisions by /Prev (the first entry met wins), and recovery by scanning for
object headers are covered. A file that cannot be read gives one row with an error instead of failing the job.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.codecs import DECODE, predictor_decode, run_filters
from vellum.plans.paged import NUMBERS, Chunks, Paged, declared, glue, paged, starts
from vellum.sources import cmap, security
from vellum.sources.content import EVENT, FIELDS, FLAT, boxed, chunk_tuples, columnar, events, literal, name_text, operations, times

DELIMITER = rb"\x00\t\n\x0c\r ()<>\[\]{}/%"
ATOM = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*(?:(?P<ref>(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?=[" + DELIMITER + rb"]|\Z))|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<name>/[^" + DELIMITER + rb"]*)|(?P<open><<)|(?P<close>>>)|(?P<hex><[^>]*>)|(?P<mark>[\[\](])|(?P<word>[^" + DELIMITER + rb"]+))")

#: an array of whole numbers alone, such as a font's widths, from after its bracket on
WHOLE_NUMBERS = re.compile(rb"(?:[\t\n\x0c\r ]*+[+-]?\d++(?=[\t\n\x0c\r \]]))++[\t\n\x0c\r ]*+\]")


@dataclass(frozen=True)
class Limits:
    """What a reader bears, and how strict it is. forms: forms within forms, as in the engine this reproduces."""

    depth: int = 256
    pages: int = 1_000_000
    forms: int = 32
    objects: int = 10_000_000
    file_bytes: int = 2 << 30
    stream_bytes: int = 512 << 20
    header_bytes: int = 1024
    tail_bytes: int = 2048
    header_drift: int = 64
    recover: bool = True
    strict: bool = False
    password: bytes = b""


USUAL = Limits()


@dataclass(frozen=True)
class Ref:
    num: int
    gen: int


@dataclass
class Stream:
    head: dict
    raw: bytes


class Name(str):
    pass


class PdfError(ValueError):
    pass


def parse(data: bytes, at: int, deep: int = 0, most: int = USUAL.depth):
    """The object at a position; where it ends."""
    if deep > most:
        raise PdfError("nesting")
    m = ATOM.match(data, at)
    if m is None:
        raise PdfError(f"no object at {at}")
    kind, at = m.lastgroup, m.end()
    if m["ref"]:
        return Ref(int(m[2]), int(m[3])), at
    if kind == "num":
        return (float(m["num"]) if b"." in m["num"] else int(m["num"])), at
    if kind == "name":
        return Name(name_text(m["name"])), at
    if kind == "hex":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", m["hex"])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
    if kind == "mark" and m["mark"] == b"(":
        return literal(data, at)
    if kind == "mark" and m["mark"] == b"[":
        whole = WHOLE_NUMBERS.match(data, at)
        if whole:
            return [int(x) for x in whole[0][:-1].split()], whole.end()
        out = []
        while True:
            e = ATOM.match(data, at)
            if e and e["mark"] == b"]":
                return out, e.end()
            x, at = parse(data, at, deep + 1)
            out.append(x)
    if kind == "open":
        out = {}
        while True:
            e = ATOM.match(data, at)
            if e and e["close"]:
                return out, e.end()
            k, at = parse(data, at, deep + 1)
            if not isinstance(k, Name):
                raise PdfError("dictionary key")
            out[str(k)], at = parse(data, at, deep + 1)
    word = m["word"]
    if word in (b"true", b"false", b"null"):
        return {b"true": True, b"false": False, b"null": None}[word], at
    raise PdfError(f"unexpected {word!r}")


class File:
    def __init__(self, data: bytes, limits: Limits = USUAL):
        self.data, self.xref, self.trailer, self.cache, self.packs, self.limits = data, {}, {}, {}, {}, limits
        self.security: security.Handler | None = None
        if len(data) > limits.file_bytes:
            raise PdfError("file too large")
        m = re.search(rb"%PDF-([\d.]+)", data[: limits.header_bytes])
        if not m:
            raise PdfError("no header")
        self.version = m[1].decode()
        try:
            start = re.findall(rb"startxref\s+(\d+)", data[-limits.tail_bytes :])
            if not start:
                raise PdfError("no startxref")
            self.sections(int(start[-1]))
            self.unlock()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise PdfError("no catalog")
        except (PdfError, ValueError, IndexError, KeyError, zlib.error, RecursionError):
            if not limits.recover or limits.strict:
                raise
            self.cache.clear()
            self.recover()
            self.unlock()

    def unlock(self) -> None:
        ref = self.trailer.get("Encrypt")
        head = self.get(ref)
        if not isinstance(head, dict):
            return
        self.locked = ref.num if isinstance(ref, Ref) else None
        ids = self.get(self.trailer.get("ID"))
        flat = lambda x: {k: flat(v) for k, v in x.items()} if isinstance(x := self.get(x), dict) else x
        handler = security.Handler(flat(head), ids[0] if ids else b"", self.limits.password)
        self.cache.clear()
        self.security = handler

    @property
    def authenticated(self) -> bool:
        return self.security is None or bool(self.security.key)

    def sections(self, at: int) -> None:
        seen = set()
        todo = [at]
        while todo:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(self.data):
                if self.limits.strict:
                    raise PdfError("cross-reference cycle")
                continue
            seen.add(at)
            m = re.compile(rb"\s*xref\s+").match(self.data, at)
            trailer = self.classic(m.end()) if m else self.packed(at)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            todo += [x for x in (trailer.get("XRefStm"), trailer.get("Prev")) if isinstance(x, int)]

    def classic(self, at: int) -> dict:
        head, entry = re.compile(rb"\s*(\d+)\s+(\d+)\s*"), re.compile(rb"\s*(\d{1,10})\s+(\d{1,5})\s+([nf])")
        while m := head.match(self.data, at):
            at, first = m.end(), int(m[1])
            for k in range(int(m[2])):
                e = entry.match(self.data, at)
                if not e:
                    raise PdfError("cross-reference entry")
                at = e.end()
                self.xref.setdefault(first + k, (1 if e[3] == b"n" else 0, int(e[1]), int(e[2])))
        m = re.compile(rb"\s*trailer").match(self.data, at)
        if not m:
            raise PdfError("no trailer")
        return parse(self.data, m.end())[0]

    def packed(self, at: int) -> dict:
        _, stream = self.object_at(at)
        if not isinstance(stream, Stream):
            raise PdfError("no cross-reference stream")
        body, w = self.decoded(stream), [int(x) for x in stream.head["W"]]
        index = stream.head.get("Index") or [0, stream.head["Size"]]
        p = 0
        for first, count in zip(index[::2], index[1::2], strict=True):
            for k in range(count):
                f = []
                for n in w:
                    f.append(int.from_bytes(body[p : p + n], "big"))
                    p += n
                self.xref.setdefault(first + k, (f[0] if w[0] else 1, f[1], f[2]))
        return stream.head

    def recover(self) -> None:
        """Objects by their headers, the first of a number counting; the trailer from any dictionary with a Root, or the catalog."""
        self.xref = {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b", self.data):
            self.xref.setdefault(int(m[1]), (1, m.start(), int(m[2])))
        self.cache.clear()
        for m in re.finditer(rb"trailer", self.data):
            try:
                self.trailer |= parse(self.data, m.end())[0]
            except (PdfError, TypeError):
                continue
        for num in list(self.xref):
            try:
                o = self.get(Ref(num, 0))
            except (PdfError, ValueError, zlib.error):
                continue
            head = o.head if isinstance(o, Stream) else o
            if isinstance(head, dict):
                if head.get("Type") == "ObjStm":
                    for k, (inner, _) in enumerate(self.pack(num)):
                        self.xref.setdefault(inner, (2, num, k))
                if head.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(num, 0)
        if "Root" not in self.trailer:
            raise PdfError("no catalog")

    def object_at(self, at: int):
        m = re.compile(rb"\s*(\d+)\s+(\d+)\s+obj").search(self.data, at, at + 32 + self.limits.header_drift)
        if not m:
            raise PdfError(f"no object header at {at}")
        value, end = parse(self.data, m.end())
        s = re.compile(rb"\s*stream(?:\r\n|\n|\r)").match(self.data, end)
        if s and isinstance(value, dict):
            length = value.get("Length")
            length = self.get(length) if isinstance(length, Ref) else length
            stop = s.end() + length if isinstance(length, int) and re.compile(rb"\s*endstream").match(self.data, s.end() + length) else -1
            if stop < 0:
                e = re.compile(rb"\r?\n?endstream").search(self.data, s.end())
                if not e:
                    raise PdfError("endstream")
                stop = e.start()
            value = Stream(value, self.data[s.end() : stop])
        return int(m[1]), value

    def get(self, x, deep: int = 0):
        """An object, references followed."""
        while isinstance(x, Ref):
            if deep > self.limits.depth:
                raise PdfError("reference cycle")
            deep += 1
            if x.num not in self.cache:
                kind, a, b = self.xref.get(x.num, (0, 0, 0))
                if kind == 1:
                    self.cache[x.num] = self.opened(x.num, b, self.object_at(a)[1])
                elif kind == 2:
                    self.cache[x.num] = dict(self.pack(a)).get(x.num)
                else:
                    self.cache[x.num] = None
            x = self.cache[x.num]
        return x

    def opened(self, num: int, gen: int, x):
        """The object with its strings and stream decrypted (objects of object streams are in the clear)."""
        if self.security is None or not self.security.key or num == self.locked:
            return x
        if isinstance(x, Stream):
            keep = x.head.get("Type") == "XRef"
            return x if keep else Stream(self.opened(num, gen, x.head), self.security.open(num, gen, x.raw))
        if isinstance(x, dict):
            return {k: self.opened(num, gen, v) for k, v in x.items()}
        if isinstance(x, list):
            return [self.opened(num, gen, v) for v in x]
        return self.security.open(num, gen, x) if isinstance(x, bytes) else x

    def pack(self, num: int) -> list:
        if num not in self.packs:
            s = self.get(Ref(num, 0))
            if not isinstance(s, Stream):
                raise PdfError("object stream")
            body = self.decoded(s)
            n, first = int(s.head["N"]), int(s.head["First"])
            head = [int(x) for x in body[:first].split()[: 2 * n]]
            self.packs[num] = [(head[2 * k], parse(body, first + head[2 * k + 1])[0]) for k in range(n)]
        return self.packs[num]

    def decoded(self, s: Stream) -> bytes:
        many = lambda x: x if isinstance(x, list) else [] if x is None else [x]
        filters, parms = many(self.get(s.head.get("Filter"))), many(self.get(s.head.get("DecodeParms")))
        data = s.raw
        for k, f in enumerate(filters):
            data = run_filters(data, [str(f)], DECODE)
            p = self.get(parms[k]) if k < len(parms) else None
            if isinstance(p, dict) and p.get("Predictor", 1) > 1:
                data = predictor_decode(data, p["Predictor"], p.get("Colors", 1), p.get("Columns", 1))
            if len(data) > self.limits.stream_bytes:
                raise PdfError("stream too large")
        return data

    def pages(self) -> Iterator[dict]:
        """Pages in order with inherited boxes and rotation, and their contents joined by newlines (empty if the file is locked)."""
        root = self.get(self.trailer["Root"])
        todo = [(root.get("Pages"), {}, frozenset())]
        n = 0
        while todo:
            ref, inherited, above = todo.pop()
            if ref in above:
                raise PdfError("page tree cycle")
            node = self.get(ref)
            if not isinstance(node, dict):
                continue
            own = inherited | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}
            if node.get("Type") == "Pages" or "Kids" in node:
                todo += [(k, own, above | {ref}) for k in reversed(self.get(node.get("Kids")) or [])]
                continue
            media = [float(self.get(x)) for x in self.get(own.get("MediaBox")) or (0, 0, 612, 792)]
            crop = [float(self.get(x)) for x in self.get(own.get("CropBox")) or media]
            parts = self.get(node.get("Contents"))
            parts = parts if isinstance(parts, list) else [] if parts is None else [parts]
            streams = [self.get(p) for p in parts]
            yield {"page_index": n, "num": ref.num if isinstance(ref, Ref) else None, "media_box": media, "crop_box": crop, "rotation": int(self.get(own.get("Rotate")) or 0) % 360, "content": b"\n".join(self.decoded(s) for s in streams if isinstance(s, Stream)) if self.authenticated else b"", "resources": own.get("Resources"), "node": node}
            n += 1
            if n > self.limits.pages:
                raise PdfError("too many pages")

    def part(self, x, key: str) -> dict:
        x = self.get(x)
        y = self.get((x.head if isinstance(x, Stream) else x).get(key)) if isinstance(x, (dict, Stream)) else None
        return y if isinstance(y, dict) else {}

    def form(self, ref, active: frozenset, deep: int) -> Stream | None:
        """A form that may be entered: not one that is open already, nor too deep."""
        s = self.get(ref)
        if isinstance(ref, Ref) and ref in active or deep >= self.limits.forms or not isinstance(s, Stream) or s.head.get("Subtype") != "Form":
            return None
        return s

    def chunks(self, data: bytes, resources, standard_cm: bool = False, ctm: list[float] | None = None, active: frozenset = frozenset(), deep: int = 0) -> Iterator[tuple]:
        """A stream's chunks with the fonts of its resources, those of its forms where they are invoked."""
        own = x if isinstance(x := self.get(resources), dict) else {}
        fonts, objects, known = self.part(own, "Font"), self.part(own, "XObject"), {}

        def font(name: str) -> tuple:
            if name not in known:
                d = self.part(fonts, name)
                known[name] = (self.decoder(d), self.meter(d))
            return known[name]

        def form(name: str, at: list[float]) -> Iterator[tuple]:
            ref = objects.get(name)
            s = self.form(ref, active, deep)
            if s is None:
                return
            m = [float(self.get(x)) for x in self.get(s.head.get("Matrix")) or (1, 0, 0, 1, 0, 0)]
            inner = s.head["Resources"] if "Resources" in s.head else own
            yield from self.chunks(self.decoded(s), inner, standard_cm, times(m, at), active | {ref} if isinstance(ref, Ref) else active, deep + 1)

        yield from chunk_tuples(data, standard_cm, ctm=ctm, decode=lambda name, raw: font(name)[0](raw), width=lambda name, raw: font(name)[1](raw), form=form)

    def events(self, data: bytes, resources, active: frozenset = frozenset(), deep: int = 0) -> Iterator[tuple]:
        """(scope, sequence in its stream, kind, operator, text, numbers), forms entered where they are invoked; names of marked
        spans' properties are looked up."""
        own = x if isinstance(x := self.get(resources), dict) else {}
        objects, properties = self.part(own, "XObject"), self.part(own, "Properties")

        def named(name: str) -> str:
            return dump(self.flat(properties.get(name))).decode("latin-1")

        def form(name: str) -> Iterator[tuple]:
            ref = objects.get(name)
            s = self.form(ref, active, deep)
            if s is not None:
                yield from self.events(self.decoded(s), s.head["Resources"] if "Resources" in s.head else own, active | {ref} if isinstance(ref, Ref) else active, deep + 1)

        scope = f"Form{deep}" if deep else "Page"
        for e in events(data, properties=named, form=form):
            yield e if isinstance(e[0], str) else (scope, *e)

    def flat(self, x, deep: int = 0):
        """An object with the references in it followed a few levels."""
        x = self.get(x)
        if deep < 4 and isinstance(x, dict):
            return {k: self.flat(v, deep + 1) for k, v in x.items()}
        if deep < 4 and isinstance(x, list):
            return [self.flat(v, deep + 1) for v in x]
        return x

    def decoder(self, font: dict) -> Callable[[bytes], str]:
        """Strings by ToUnicode, else by two-byte codes in composite fonts with an identity encoding, else by the simple map of the
        font's encoding, else a byte a character."""
        s = self.get(font.get("ToUnicode"))
        if isinstance(s, Stream):
            table = cmap.parse(self.decoded(s).decode("latin-1"))
            return lambda raw: cmap.decode_bytes(raw, table)
        encoding = self.get(font.get("Encoding"))
        if font.get("Subtype") == "Type0" and str(encoding).startswith("Identity"):
            return lambda raw: "".join(chr(c) if not 0xD800 <= (c := raw[i] << 8 | raw[i + 1]) < 0xE000 else "\ufffd" for i in range(0, len(raw) - 1, 2))
        base = self.get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else encoding
        codec = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}.get(str(base), "latin-1")
        table = [bytes([c]).decode(codec, "replace") if codec == "latin-1" or c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else "\u2022" for c in range(256)]
        if isinstance(encoding, dict):
            at = 0
            for x in self.get(encoding.get("Differences")) or []:
                if isinstance(x, int):
                    at = x
                elif isinstance(x, Name) and 0 <= at < 256:
                    table[at] = glyph_text(x) or table[at]
                    at += 1
        return lambda raw: "".join([table[c] for c in raw])

    def meter(self, font: dict) -> Callable[[bytes], float | None]:
        """The width of a string in thousandths of an em, from the font's widths; None for a font without any."""
        if font.get("Subtype") == "Type0":
            inner = self.get((self.get(font.get("DescendantFonts")) or [None])[0])
            if not isinstance(inner, dict) or "W" not in inner and "DW" not in inner:
                return lambda raw: None
            wide, usual, w, k = {}, float(self.get(inner.get("DW", 1000))), self.flat(inner.get("W")) or [], 0
            while k + 1 < len(w):
                if isinstance(w[k + 1], list):
                    wide.update(enumerate(map(float, w[k + 1]), w[k]))
                    k += 2
                else:
                    wide.update(dict.fromkeys(range(w[k], min(w[k + 1], 65535) + 1), float(w[k + 2])))
                    k += 3
            return lambda raw: sum(wide.get(raw[i] << 8 | raw[i + 1], usual) for i in range(0, len(raw) - 1, 2))
        widths = self.get(font.get("Widths"))
        if not isinstance(widths, list):
            return lambda raw: None
        first = int(self.get(font.get("FirstChar", 0)))
        table = [1000.0] * 256
        for k, x in enumerate(widths):
            if 0 <= first + k < 256:
                table[first + k] = float(self.get(x))
        return lambda raw: sum([table[c] for c in raw])

    def text(self, x) -> str:
        """A text string: UTF-16 with its mark, UTF-8 with its mark, else a byte a character; a name as it is; else empty."""
        x = self.get(x)
        if isinstance(x, bytes):
            return x[2:].decode("utf-16-be", "replace") if x[:2] == b"\xfe\xff" else x[3:].decode("utf-8", "replace") if x[:3] == b"\xef\xbb\xbf" else x.decode("latin-1")
        return str(x) if isinstance(x, Name) else ""

    @property
    def root(self) -> dict:
        r = self.get(self.trailer.get("Root"))
        return r if isinstance(r, dict) else {}

    def page_numbers(self) -> dict[int, int]:
        return {p["num"]: p["page_index"] for p in self.pages() if p["num"] is not None}

    def destination(self, node: dict, pages: dict[int, int]) -> int | None:
        """The page of an explicit destination, or of the one that a go-to action has; names are not looked up."""
        d = self.get(node.get("Dest"))
        action = self.get(node.get("A"))
        if d is None and isinstance(action, dict) and action.get("S") == "GoTo":
            d = self.get(action.get("D"))
        return pages.get(d[0].num) if isinstance(d, list) and d and isinstance(d[0], Ref) else None

    def outlines(self) -> Iterator[tuple]:
        """(sequence, title, depth, page, open): first children before next ones, each entry once."""
        pages, seen, k = self.page_numbers(), set(), 0
        todo = [(self.part(self.root, "Outlines").get("First"), 0)]
        while todo:
            ref, deep = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or ref in seen:
                continue
            if isinstance(ref, Ref):
                seen.add(ref)
            yield k, self.text(node.get("Title")), deep, self.destination(node, pages), True
            k += 1
            todo += [(node.get("Next"), deep), (node.get("First"), deep + 1)]

    def labels(self) -> list[tuple]:
        """(first page, style, prefix, first number) of the flat label ranges, by page."""
        nums = self.get(self.part(self.root, "PageLabels").get("Nums")) or []
        out = []
        for first, d in zip(nums[::2], nums[1::2], strict=False):
            d = self.get(d)
            if isinstance(first, int) and isinstance(d, dict):
                out.append((first, self.text(d.get("S")) or None, self.text(d.get("P")) or None, int(self.get(d.get("St", 1)))))
        return sorted(out, key=lambda x: x[0])

    def annotations(self) -> Iterator[tuple]:
        """(page, ordinal, object, subtype, rectangle, contents, title, subject, flags, action, appearance, destination page)."""
        pages = self.page_numbers()
        for p in self.pages():
            for k, ref in enumerate(self.get(p["node"].get("Annots")) or []):
                a = self.get(ref)
                if not isinstance(a, dict):
                    continue
                box = [float(self.get(x)) for x in self.get(a.get("Rect")) or (0, 0, 0, 0)]
                action = self.part(a, "A")
                yield p["page_index"], k, ref.num if isinstance(ref, Ref) else None, self.text(a.get("Subtype")), box, self.text(a.get("Contents")), self.text(a.get("T")), self.text(a.get("Subj")), int(self.get(a.get("F", 0))), self.text(action.get("S")) or None, "N" in self.part(a, "AP"), self.destination(a, pages), self.text(action.get("URI"))

    def fields(self) -> Iterator[tuple]:
        """The nodes of the field tree: (object, parent, partial name, type, flags, value, options, widget, page). A node met again is a cycle."""
        pages, seen = {}, set()
        for p in self.pages():
            for ref in self.get(p["node"].get("Annots")) or []:
                if isinstance(ref, Ref):
                    pages.setdefault(ref.num, p["page_index"])
        todo = [(x, None) for x in reversed(self.get(self.part(self.root, "AcroForm").get("Fields")) or [])]
        while todo:
            ref, parent = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or not isinstance(ref, Ref):
                continue
            if ref in seen:
                raise PdfError("field cycle")
            seen.add(ref)
            value, flags = self.get(node.get("V")), self.get(node.get("Ff"))
            options = [self.text(x[-1]) if isinstance(x := self.get(o), list) and x else self.text(o) for o in self.get(node.get("Opt")) or []]
            yield ref.num, parent, self.text(node.get("T")), self.text(node.get("FT")) or None, flags if isinstance(flags, int) else None, None if value is None or isinstance(value, (dict, Stream)) else self.text(value) if isinstance(value, bytes) else dump(value).decode("latin-1").lstrip("/"), options, node.get("Subtype") == "Widget", pages.get(ref.num)
            todo += [(k, ref.num) for k in reversed(self.get(node.get("Kids")) or [])]

    def signatures(self) -> Iterator[tuple]:
        """(field, signed, ranges, contents, filter, sub-filter, name, reason, SHA-256 of the ranges, digest in the contents, status)."""
        for num, _, name, kind, *_ in self.fields():
            if kind != "Sig":
                continue
            v = self.get(self.get(Ref(num, 0)).get("V"))
            if not isinstance(v, dict):
                continue
            ranges = [x for x in self.get(v.get("ByteRange")) or [] if isinstance(x, int)]
            contents = self.get(v.get("Contents")) or b""
            signed = any(contents)
            inside = len(ranges) == 4 and min(ranges) >= 0 and ranges[0] + ranges[1] <= ranges[2] and ranges[2] + ranges[3] <= len(self.data)
            digest = hashlib.sha256(self.data[ranges[0] : ranges[0] + ranges[1]] + self.data[ranges[2] : ranges[2] + ranges[3]]).hexdigest() if inside else None
            stated = message_digest(contents)
            status = "not_signed" if not signed else "out_of_bounds" if not inside else "malformed" if stated is None else "digest_matches" if stated.hex() == digest else "digest_differs"
            yield name, signed, ranges, contents, self.text(v.get("Filter")), self.text(v.get("SubFilter")), self.text(v.get("Name")), self.text(v.get("Reason")), digest, stated, status

    def images(self) -> Iterator[tuple]:
        """(page, ordinal, scope, name, width, height, bits, colour space, filters, box, mask, bytes): image objects and inline images
        where they are painted, those of forms included; bytes as they lie in the file."""

        def walk(data: bytes, resources, ctm: list[float], active: frozenset, deep: int) -> Iterator[tuple]:
            own = x if isinstance(x := self.get(resources), dict) else {}
            objects, saved, m = self.part(own, "XObject"), [], ctm
            for op, args in operations(data):
                if op == "q":
                    saved.append(m)
                elif op == "Q":
                    m = saved.pop() if saved else m
                elif op == "cm" and len(args) >= 6:
                    m = times(m, args[:6])
                elif op == "BI":
                    head, _, raw = args[0].partition(b"ID")
                    d = {INLINE.get(k, k): v for k, v in parse(b"<<" + head + b">>", 0)[0].items()}
                    yield scope(deep), "", d, raw[1:], m
                elif op == "Do" and args and isinstance(args[-1], str):
                    ref = objects.get(args[-1][1:])
                    s = self.get(ref)
                    if isinstance(s, Stream) and s.head.get("Subtype") == "Image":
                        yield scope(deep), args[-1][1:], s.head, s.raw, m
                    elif (s := self.form(ref, active, deep)) is not None:
                        inner = [float(self.get(x)) for x in self.get(s.head.get("Matrix")) or (1, 0, 0, 1, 0, 0)]
                        yield from walk(self.decoded(s), s.head.get("Resources", own), times(inner, m), active | {ref} if isinstance(ref, Ref) else active, deep + 1)

        scope = lambda deep: f"Form{deep}" if deep else "Page"
        for p in self.pages():
            for k, (where, name, d, raw, m) in enumerate(walk(p["content"], p["resources"], [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], frozenset(), 0)):
                filters = self.get(d.get("Filter"))
                filters = [str(self.get(x)) for x in (filters if isinstance(filters, list) else [filters] if filters else [])]
                space = self.get(d.get("ColorSpace"))
                corners = [(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]) for x in (0, 1) for y in (0, 1)]
                box = [f(c[i] for c in corners) for f, i in ((min, 0), (min, 1), (max, 0), (max, 1))]
                yield p["page_index"], k, where, name, int(self.get(d.get("Width", 0))), int(self.get(d.get("Height", 0))), int(self.get(d.get("BitsPerComponent", 1))), str(space[0] if isinstance(space, list) and space else space or ""), filters, box, "SMask" in d, raw

    def fonts(self) -> Iterator[tuple]:
        """(page, resource name, subtype, base font, encoding, embedded, map to Unicode, first code, widths) of each page's fonts."""
        for p in self.pages():
            for name, ref in sorted(self.part(p["resources"], "Font").items()):
                d = self.get(ref)
                if not isinstance(d, dict):
                    continue
                inner = self.get((self.get(d.get("DescendantFonts")) or [None])[0])
                holder = self.part(d, "FontDescriptor") or self.part(inner, "FontDescriptor")
                encoding = self.get(d.get("Encoding"))
                widths = [float(self.get(x)) for x in self.get(d.get("Widths")) or []]
                program = next((k for k in ("FontFile", "FontFile2", "FontFile3") if isinstance(self.get(holder.get(k)), Stream)), None)
                yield p["page_index"], name, self.text(d.get("Subtype")), self.text(d.get("BaseFont")), self.text(encoding.get("BaseEncoding") if isinstance(encoding, dict) else encoding), program, isinstance(self.get(d.get("ToUnicode")), Stream), int(self.get(d.get("FirstChar", 0))), widths

    def files(self) -> Iterator[tuple]:
        """(name, MIME type, relationship, size, bytes) of the embedded files' name tree."""
        todo, seen = [self.part(self.root, "Names").get("EmbeddedFiles")], set()
        while todo:
            ref = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or ref in seen if isinstance(ref, Ref) else not isinstance(node, dict):
                continue
            if isinstance(ref, Ref):
                seen.add(ref)
            todo += list(reversed(self.get(node.get("Kids")) or []))
            names = self.get(node.get("Names")) or []
            for _, spec in zip(names[::2], names[1::2], strict=False):
                d = self.get(spec)
                s = self.get(self.part(d, "EF").get("F")) if isinstance(d, dict) else None
                if isinstance(s, Stream):
                    data = self.decoded(s)
                    yield self.text(d.get("UF")) or self.text(d.get("F")), self.text(s.head.get("Subtype")), self.text(d.get("AFRelationship")) or None, len(data), data

    def xmp(self) -> bytes | None:
        """The metadata stream as it lies in the file, no filter undone."""
        s = self.get(self.root.get("Metadata"))
        return s.raw if isinstance(s, Stream) else None

    def info(self) -> dict[str, str]:
        d = self.get(self.trailer.get("Info")) or {}
        return {k: self.text(v) if isinstance(v := self.get(d.get(k)), bytes) else "" for k in ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")}


def kind_of(x) -> str:
    return next(n for t, n in ((bool, "boolean"), (Name, "name"), (int, "integer"), (float, "real"), (bytes, "string"), (list, "array"), (dict, "dictionary"), (Stream, "stream"), (Ref, "reference"), (type(None), "null")) if isinstance(x, t))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


ERRORS = (PdfError, ValueError, KeyError, TypeError, IndexError, AttributeError, zlib.error, RecursionError)
PAGE = "page_index int, num int, media_box array<double>, crop_box array<double>, rotation int, content binary, error string"
OBJECT = "num int, obj_type string, type_name string, n_bytes bigint, value string, error string"
DOCUMENT = "version string, file_size bigint, xref_count int, page_count int, title string, author string, subject string, keywords string, creator string, producer string, creation_date string, mod_date string, encrypted boolean, permissions int, authenticated boolean, error string"
XREF = "num int, kind string, place bigint, generation int, in_use boolean, error string"
TRAILER = "key string, value string, error string"
OUTLINE = "seq int, title string, depth int, page_index int, is_open boolean, error string"
LABEL = "first_page int, style string, prefix string, start_number int, error string"
ANNOTATION = "page_index int, ordinal int, num int, subtype string, rect array<double>, contents string, title string, subject string, flags int, action string, has_appearance boolean, dest_page int, uri string, error string"
FIELD = "num int, parent int, partial string, ft string, ff int, v string, options array<string>, widget boolean, page_index int, error string"
SIGNATURE = "field string, signed boolean, byte_range array<bigint>, contents binary, filter string, sub_filter string, name string, reason string, digest string, stated_digest binary, status string, error string"
IMAGE = "page_index int, ordinal int, scope string, name string, width int, height int, bits int, color_space string, filters array<string>, box array<double>, has_mask boolean, data binary, error string"
FONT = "page_index int, name string, subtype string, base_font string, encoding string, program string, to_unicode boolean, first_char int, widths array<double>, error string"
EMBEDDED = "name string, mime string, relationship string, n_bytes bigint, data binary, error string"


def reader(schema: str, make: Callable[[File], Iterator[tuple]]) -> Callable[..., DataFrame]:
    """A function from rows of files (key columns and content) to rows of a side table; a file that cannot be read gives its error."""

    def read(files: DataFrame, limits: Limits = USUAL) -> DataFrame:
        return columnar(files, schema, lambda data: list(make(File(data, limits))), ERRORS)

    return read


def _objects(f: File) -> Iterator[tuple]:
    for num in sorted(k for k, e in f.xref.items() if e[0]):
        x = f.get(Ref(num, 0))
        head = x.head if isinstance(x, Stream) else x if isinstance(x, dict) else {}
        yield num, kind_of(x), str(head.get("Type", "")), len(x.raw) if isinstance(x, Stream) else None, dump(x.head if isinstance(x, Stream) else x).decode("latin-1")


def _document(f: File) -> Iterator[tuple]:
    yield f.version, len(f.data), len(f.xref), sum(1 for _ in f.pages()), *f.info().values(), f.security is not None, f.security.permissions if f.security else -1, f.authenticated


def _xref(f: File) -> Iterator[tuple]:
    for num, (kind, a, b) in sorted(f.xref.items()):
        yield num, {0: "free", 1: "uncompressed", 2: "compressed"}.get(kind, "unknown"), a, b, kind != 0


read_pages = reader(PAGE, lambda f: ((p["page_index"], p["num"], p["media_box"], p["crop_box"], p["rotation"], p["content"]) for p in f.pages()))
read_objects = reader(OBJECT, _objects)
read_documents = reader(DOCUMENT, _document)
read_xref = reader(XREF, _xref)
read_trailer = reader(TRAILER, lambda f: ((k, dump(v).decode("latin-1")) for k, v in sorted(f.trailer.items())))
read_outlines = reader(OUTLINE, lambda f: f.outlines())
read_labels = reader(LABEL, lambda f: f.labels())
read_xmp = reader("xmp binary, error string", lambda f: ((x,) for x in [f.xmp()] if x is not None))
read_annotations = reader(ANNOTATION, lambda f: f.annotations())
read_fields = reader(FIELD, lambda f: f.fields())
read_signatures = reader(SIGNATURE, lambda f: f.signatures())
read_images = reader(IMAGE, lambda f: f.images())
read_embedded = reader(EMBEDDED, lambda f: f.files())
read_fonts = reader(FONT, lambda f: f.fonts())
read_events = reader(f"page_index int, scope string, {EVENT}, error string", lambda f: ((p["page_index"], *e) for p in f.pages() for e in f.events(p["content"], p["resources"])))


def read_chunks(files: DataFrame, standard_cm: bool = False, limits: Limits = USUAL) -> DataFrame:
    """A row a chunk of each page, as content_chunks gives them, with the text of forms and the fonts' own decoding and widths."""
    make = lambda f: ((p["page_index"], k, *c) for p in f.pages() for k, c in enumerate(f.chunks(p["content"], p["resources"], standard_cm)))
    keys = [c for c in files.columns if c != "content"]
    return boxed(reader(f"page_index int, {FLAT}, error string", make)(files, limits), [*keys, "page_index"], ("error",))


#: fixed values: keys of inline images and what they stand for
INLINE = {"BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "DP": "DecodeParms", "F": "Filter", "H": "Height", "IM": "ImageMask", "I": "Interpolate", "W": "Width"}
#: fixed values: names of glyphs that are not letters
GLYPHS = {"space": " ", "period": ".", "comma": ",", "hyphen": "-", "colon": ":", "semicolon": ";", "slash": "/", "parenleft": "(", "parenright": ")", "quotesingle": "'", "quotedbl": '"', "exclam": "!", "question": "?", "ampersand": "&", "at": "@", "underscore": "_", "plus": "+", "equal": "=", "asterisk": "*", "percent": "%", "numbersign": "#", "dollar": "$", "bullet": "\u2022", "endash": "\u2013", "emdash": "\u2014", "quoteleft": "\u2018", "quoteright": "\u2019", "quotedblleft": "\u201c", "quotedblright": "\u201d", "fi": "fi", "fl": "fl", "Euro": "\u20ac", "germandbls": "\u00df", "ae": "\u00e6", "AE": "\u00c6", "oslash": "\u00f8", "Oslash": "\u00d8"}
ACCENTS = {"grave": "\u0300", "acute": "\u0301", "circumflex": "\u0302", "tilde": "\u0303", "dieresis": "\u0308", "ring": "\u030a", "cedilla": "\u0327", "caron": "\u030c"}
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def glyph_text(name: str) -> str:
    """The text of a glyph's name: single letters, digits, letters with accents, uniXXXX and uXXXX, a few signs; else empty."""
    name = name.partition(".")[0]
    if len(name) == 1:
        return name
    if name in GLYPHS:
        return GLYPHS[name]
    if name in DIGITS:
        return str(DIGITS.index(name))
    if name[1:] in ACCENTS and name[0].isalpha():
        return unicodedata.normalize("NFC", name[0] + ACCENTS[name[1:]])
    m = re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", name)
    return "" if not m else bytes.fromhex(m[1]).decode("utf-16-be", "replace") if m[1] else chr(int(m[2], 16)) if int(m[2], 16) < 0x110000 else ""


def message_digest(contents: bytes) -> bytes | None:
    """The digest that a CMS value's signed attributes state: an OCTET STRING after the attribute's object identifier."""
    at = contents.find(bytes.fromhex("06092A864886F70D010904"))
    if at < 0 or contents[at + 11 : at + 12] != b"\x31" or contents[at + 13 : at + 14] != b"\x04":
        return None
    n = contents[at + 14]
    return contents[at + 15 : at + 15 + n] if n == 32 and len(contents) >= at + 15 + n else None


def dump(x) -> bytes:
    """An object as it is written in files."""
    if isinstance(x, bool) or x is None:
        return {True: b"true", False: b"false", None: b"null"}[x]
    if isinstance(x, Name):
        return b"/" + (x.encode() if x.isascii() and x.isalnum() else b"".join(bytes([c]) if 33 <= c < 127 and c not in b"#()<>[]{}/%" else b"#%02X" % c for c in x.encode("latin-1", "replace")))
    if isinstance(x, Ref):
        return b"%d %d R" % (x.num, x.gen)
    if isinstance(x, int):
        return b"%d" % x
    if isinstance(x, float):
        return f"{x:.6f}".rstrip("0").encode() + (b"0" if x == int(x) else b"")
    if isinstance(x, str):
        x = x.encode("latin-1") if x.isascii() or all(ord(c) < 256 for c in x) else b"\xfe\xff" + x.encode("utf-16-be")
    if isinstance(x, bytes):
        return escape(x)
    if isinstance(x, list):
        if x and set(map(type, x)) == {int}:
            return b"[" + " ".join(map(str, x)).encode() + b"]"
        return b"[" + b" ".join(map(dump, x)) + b"]"
    if isinstance(x, dict):
        return b"<<" + b" ".join(dump(Name(k)) + b" " + dump(v) for k, v in x.items()) + b">>"
    if isinstance(x, Stream):
        return dump({**x.head, "Length": len(x.raw)}) + b"\nstream\n" + x.raw + b"\nendstream"
    raise PdfError(f"no way to write {type(x).__name__}")


def assemble(objects: dict[int, object], trailer: dict, version: str = "1.7", password: tuple[bytes, bytes] | None = None, permissions: int = -44) -> bytes:
    """A file of numbered objects. password: (user, owner), for RC4 of 128 bits."""
    if password is not None:
        first_id = hashlib.md5(repr(sorted(objects)).encode()).digest()
        owner = security.owner_entry(password[1], password[0], 3, 16)
        key = security.file_key(password[0], owner, permissions, first_id, 3, 16)
        lock = security.Handler.__new__(security.Handler)
        lock.method, lock.key = "V2", key
        seal = lambda n, x: Stream(seal(n, x.head), lock.open(n, 0, x.raw)) if isinstance(x, Stream) else {k: seal(n, v) for k, v in x.items()} if isinstance(x, dict) else [seal(n, v) for v in x] if isinstance(x, list) else lock.open(n, 0, x) if isinstance(x, bytes) else x
        plain = lambda x: x.encode("latin-1", "replace") if isinstance(x, str) and not isinstance(x, Name) else {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list) else Stream(plain(x.head), x.raw) if isinstance(x, Stream) else x
        objects = {n: seal(n, plain(x)) for n, x in objects.items()}
        top = max(objects) + 1
        objects[top] = {"Filter": Name("Standard"), "V": 2, "R": 3, "Length": 128, "P": permissions, "O": owner, "U": security.user_entry(key, first_id, 3) + bytes(16)}
        trailer = {**trailer, "Encrypt": Ref(top, 0), "ID": [first_id, first_id]}
    return _body(f"%PDF-{version}\n".encode(), objects, trailer, 0)


def _body(out: bytes, objects: dict[int, object], trailer: dict, start: int) -> bytes:
    parts, at, offsets = [out], start + len(out), {}
    for num, x in sorted(objects.items()):
        offsets[num] = at
        parts.append(b"%d 0 obj\n" % num + (x if isinstance(x, Raw) else dump(x)) + b"\nendobj\n")
        at += len(parts[-1])
    runs: list[list[int]] = []
    for num in sorted(offsets):
        if runs and runs[-1][-1] == num - 1:
            runs[-1].append(num)
        else:
            runs.append([num])
    table = b"" if start else b"0 1\n0000000000 65535 f \n"
    for run in runs:
        table += b"%d %d\n" % (run[0], len(run)) + b"".join(b"%010d 00000 n \n" % offsets[n] for n in run)
    size = max([int(trailer.get("Size", 0)), *(n + 1 for n in offsets)])
    return b"".join(parts) + b"xref\n" + table + b"trailer\n" + dump({**trailer, "Size": size}) + b"\nstartxref\n%d\n%%%%EOF\n" % at


class Raw(bytes):
    """An object's text as it is to be written."""


def append_revision(data: bytes, changed: dict[int, object]) -> bytes:
    """The file with a revision after it: the changed or new objects, and a cross-reference that points back to the one before."""
    f = File(data)
    start = int(re.findall(rb"startxref\s+(\d+)", data[-f.limits.tail_bytes :])[-1])
    keep = {k: v for k, v in f.trailer.items() if k in ("Root", "Info", "ID", "Size")}
    lead = b"" if data.endswith(b"\n") else b"\n"
    return data + _body(lead, changed, {**keep, "Prev": start}, len(data))


def escape(s: bytes) -> bytes:
    return b"(" + re.sub(rb"([\\()])", rb"\\\1", s).replace(b"\r", rb"\r").replace(b"\n", rb"\n") + b")"


def build(pages: list[bytes], title: str = "", box: tuple[float, float] = (612, 792)) -> bytes:
    """A file of these content streams, one font, and an Info title."""
    kids = " ".join(f"{4 + 2 * k} 0 R" for k in range(len(pages)))
    bodies = [b"<</Type /Catalog /Pages 2 0 R>>", f"<</Type /Pages /Kids [{kids}] /Count {len(pages)} /MediaBox [0 0 {box[0]:g} {box[1]:g}]>>".encode(), b"<</Type /Font /Subtype /Type1 /BaseFont /Helvetica /FirstChar 0 /LastChar 255 /Widths [" + b" 500" * 256 + b"]>>"]
    for k, content in enumerate(pages):
        packed = zlib.compress(content)
        bodies.append(f"<</Type /Page /Parent 2 0 R /Contents {5 + 2 * k} 0 R /Resources <</Font <</F1 3 0 R>>>>>>".encode())
        bodies.append(f"<</Length {len(packed)} /Filter /FlateDecode>>\nstream\n".encode() + packed + b"\nendstream")
    bodies.append(b"<</Title " + escape(title.encode("latin-1", "replace")) + b">>")
    out, offsets = bytearray(b"%PDF-1.7\n"), []
    for k, body in enumerate(bodies):
        offsets.append(len(out))
        out += f"{k + 1} 0 obj\n".encode() + body + b"\nendobj\n"
    at = len(out)
    out += f"xref\n0 {len(bodies) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{o:010d} 00000 n \n".encode() for o in offsets)
    return bytes(out) + f"trailer\n<</Size {len(bodies) + 1} /Root 1 0 R /Info {len(bodies)} 0 R>>\nstartxref\n{at}\n%%EOF\n".encode()


def streams_of(c: Chunks) -> tuple[np.ndarray, pa.Array]:
    """The pages that have chunks, and their content streams as texts: each chunk is shown where it stands."""
    whole = lambda x: pa.array(x.astype(np.int64)).cast(pa.string())
    shown = pc.replace_substring_regex(c.text, r"([\\()])", r"\\\1") if pc.any(pc.match_substring_regex(c.text, r"[\\()]")).as_py() else c.text
    line = pc.binary_join_element_wise("1 0 0 1 ", whole(c.n["x0"]), " ", whole(c.n["y"]), " Tm (", shown, ") Tj", "")
    top = starts(c.page)
    return c.page[top], pc.binary_join_element_wise("BT /F1 10 Tf 120 Tz", glue(line, top, "\n"), "ET", "\n")


def page_streams(chunks: DataFrame | Paged) -> DataFrame:
    """Content streams that show a grid's chunks where they stand: doc_id, page_index, content."""

    def make(c: Chunks) -> list:
        page, body = streams_of(c)
        return [*c.of_pages(page), body]

    streams = paged(chunks).map(make, "body string")
    return streams.select("doc_id", "page_index", F.encode("body", "ISO-8859-1").alias("content"))


def write_pages(chunks: DataFrame | Paged) -> DataFrame:
    """doc_id, content: a file a document that shows its chunks. Where a worker has whole documents their files are made there."""
    if not (isinstance(chunks, Paged) and chunks.whole):
        return write_files(page_streams(chunks))

    def make(c: Chunks) -> list:
        page, body = streams_of(c)
        index = c.keys[1].take(pa.array(page)).to_pylist()
        files: dict[object, dict[int, bytes]] = {}
        for doc, k, x in zip(c.keys[0].take(pa.array(page)).to_pylist(), index, body.to_pylist(), strict=True):
            files.setdefault(doc, {})[k] = x.encode("latin-1")
        built = [build([at.get(k, b"") for k in range(max(at) + 1)], f"document {doc}") for doc, at in files.items()]
        return [pa.array(list(files), c.keys[0].type), pa.array(built, pa.binary())]

    return chunks.map(make, "content binary", f"doc_id {declared(chunks.df, 'doc_id')}")


def paged_chunks(files: DataFrame, standard_cm: bool = False, limits: Limits = USUAL) -> Paged:
    """The chunks of files (doc_id, content) by the page, with the page's media box and rotation; files that cannot be read have none."""
    wanted = ("chunk_index", "x0", "x1", "y", "l", "b", "r", "t", "font_size", "rendering_mode")
    at = [FIELDS.index(k) for k in wanted[1:]]

    def load(batch: pa.RecordBatch) -> Iterator[Chunks]:
        doc, heads, page, text, numbers = [], [], [], [], [[] for _ in wanted]

        def packed() -> Chunks:
            n = [np.array(x, float) for x in numbers]
            keys = [batch.column("doc_id").take(pa.array(doc, pa.int64())), *(pa.array([h[k] for h in heads], t) for k, t in enumerate((pa.int32(), pa.list_(pa.float64()), pa.int32())))]
            return Chunks(keys, np.array(page, np.int64), pa.array(text, pa.string()), {**dict.fromkeys(NUMBERS, np.full(len(text), np.nan)), **dict(zip(wanted, n, strict=True))})

        for i, data in enumerate(batch.column("content")):
            try:
                f = File(data.as_buffer().to_pybytes() if data.is_valid else b"", limits)
                made = [((p["page_index"], p["media_box"], p["rotation"]), list(f.chunks(p["content"], p["resources"], standard_cm))) for p in f.pages()]
            except ERRORS:
                continue
            for head, chunks in made:
                page += [len(heads)] * len(chunks)
                doc.append(i)
                heads.append(head)
                columns = list(zip(*chunks, strict=True)) or [()] * len(FIELDS)
                text += columns[0]
                for own, values in zip(numbers, (range(len(chunks)), *(columns[j] for j in at)), strict=True):
                    own += values
            if len(text) >= 1 << 15:
                yield packed()
                doc, heads, page, text, numbers = [], [], [], [], [[] for _ in wanted]
        yield packed()

    return Paged(files.select("doc_id", "content"), load, f"doc_id {declared(files, 'doc_id')}, page_index int, media_box array<double>, rotation int", whole=True)


def write_files(streams: DataFrame) -> DataFrame:
    """doc_id, content: a file a document from its pages' streams (missing pages are blank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for doc, pages in zip(batch.column("doc_id").to_pylist(), batch.column("p").to_pylist(), strict=True):
                at = {p["page_index"]: bytes(p["content"]) for p in pages}
                files.append(build([at.get(k, b"") for k in range(max(at) + 1)], f"document {doc}"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(files, pa.binary())], names=["doc_id", "content"])

    kind = streams.schema["doc_id"].dataType.simpleString()
    gathered = streams.groupBy("doc_id").agg(F.collect_list(F.struct("page_index", "content")).alias("p"))
    return gathered.mapInArrow(run, f"doc_id {kind}, content binary")
