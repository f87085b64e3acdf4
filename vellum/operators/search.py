"""Search over chunks: literal and regular-expression matches with their chunks and rectangles.

A page's search text runs its chunks together; a newline (a barrier) stands between chunks that are not connected: centres
over ``line_tolerance`` apart, or a gap over ``max_gap``. A match may not hold a barrier unless asked for. Offsets are code points;
rectangles cut a chunk's box in proportion to UTF-8 bytes. Literals are found, and their boxes cut, where the pages are laid out, a block
at a time and in proportion to its text and matches. A regular expression is Java's: pages go to it as rows with their text, the lengths of
the matches and of what lies before each come back to a worker, and places and boxes are made there, in proportion to text and matches too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import geometry
from vellum.functions.strings import remove_diacritics, to_lower
from vellum.plans.paged import PAGE, Chunks, Paged, before, blocks, declared, glue, paged, place, starts

#: a chunk on its way beside its page's text; size: bytes of the text with the barrier before it
PACKED = np.dtype([("chunk_index", "<i4"), ("size", "<i4"), ("start", "<i8"), ("stop", "<i8"), ("l", "<f8"), ("b", "<f8"), ("r", "<f8"), ("t", "<f8")])
#: chunks packed at once, some 7 MB
PACK = 1 << 17


@dataclass(frozen=True)
class Spans:
    """Chunks with what parts them in a page's search text; the texts and places are made a block of pages at a time."""

    chunks: Paged
    line_tolerance: float = 2.0
    max_gap: float = 6.0

    def map(self, make: Callable[..., list[pa.Array]], columns: str) -> DataFrame:
        """make gets what cut gives."""
        line_tolerance, max_gap = self.line_tolerance, self.max_gap
        return self.chunks.map(lambda c: make(*cut(c, line_tolerance, max_gap)), columns)


def cut(c: Chunks, line_tolerance: float, max_gap: float) -> tuple[Chunks, pa.Array, np.ndarray, np.ndarray]:
    """Chunks that are not empty, their texts with the barrier before, and where they start and stop in the page's search text."""
    c = c.where(pc.fill_null(pc.not_equal(c.text, ""), False).to_numpy(zero_copy_only=False))
    n, first = c.n, starts(c.page)
    middle = (n["b"] + n["t"]) / 2
    barrier = (np.abs(before(middle, first) - middle) > line_tolerance) | (n["l"] - before(n["r"], first) > max_gap)
    text = pc.binary_join_element_wise(pa.array(["", "\n"]).take(pa.array(barrier.astype(np.int8))), c.text, "")
    stop = np.cumsum(pc.utf8_length(c.text).to_numpy().astype(np.int64) + barrier)
    at = np.flatnonzero(first)
    stop -= np.repeat(np.append(0, stop)[at], np.diff(np.append(at, len(first))))
    return c, text, stop - pc.utf8_length(c.text).to_numpy(), stop


def spans(chunks: DataFrame | Paged, line_tolerance: float = 2.0, max_gap: float = 6.0) -> Spans:
    """Chunks by the page with the distances that part them."""
    return Spans(paged(chunks), line_tolerance, max_gap)


def search_text(spanned: Spans) -> DataFrame:
    """doc_id, page_index, text."""

    def make(c: Chunks, text: pa.Array, *_) -> list:
        top = starts(c.page)
        return [*c.of_pages(c.page[top]), glue(text, top)]

    return spanned.map(make, "text string")


def literal(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _pieces(pages: DataFrame, pattern: str, *, regex: bool = False, ignore_case: bool = True, ignore_accents: bool = False, across_lines: bool = False, most: int = 0) -> DataFrame:
    """Pages of text that have matches, with the lengths of the matches (_n) and of what lies before each (_g); across_lines and most are left
    to ``_places``."""
    if not pattern:
        raise ValueError("an empty keyword")
    fold = (lambda c: to_lower(c)) if ignore_case else (lambda c: c)
    plain = (lambda c: remove_diacritics(fold(c))) if ignore_accents else fold
    if regex:
        java, hay = ("(?i)" if ignore_case else "") + pattern, F.col("text")
        some, sizes = hay.rlike(java), F.transform(F.regexp_extract_all(hay, F.lit(java), F.lit(0)), lambda m: F.length(m))
    else:
        needle = fold_text(pattern, ignore_case, ignore_accents)
        java, hay = literal(needle), plain(F.col("text"))
        some, sizes = hay.contains(needle), F.array_repeat(F.lit(len(needle)), F.size(F.split(hay, java, -1)) - 1)
    return pages.where(some).withColumns({"_n": sizes, "_g": F.transform(F.split(hay, java, -1), lambda x: F.length(x))})


def _places(batch: pa.RecordBatch, *, across_lines: bool = False, most: int = 0, **_) -> tuple:
    """From pages of text with the lengths of matches and pieces: the page's place, match_no, start, stop and matched."""
    many, pieces = (pc.list_value_length(batch.column(k)).to_numpy().astype(np.int64) for k in ("_n", "_g"))
    size, gap = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in ("_n", "_g"))
    page, own = np.repeat(np.arange(len(many)), many), np.repeat(np.arange(len(many)), pieces)
    # there is a piece after the last match; none comes before a match of no letters at the start
    no = place(own) + (many + 1 - pieces)[own]
    lead, first = np.zeros(len(size), np.int64), np.cumsum(many) - many
    good = no < many[own]
    lead[(first[own] + no)[good]] = gap[good]
    stop = np.cumsum(lead + size)
    stop -= np.append(0, stop)[first][page]
    good = size > 0
    page, start, stop = page[good], (stop - size)[good], stop[good]
    texts, matched = batch.column("text").to_pylist(), np.empty(len(page), object)
    for k, (p, a, b) in enumerate(zip(page.tolist(), start.tolist(), stop.tolist(), strict=True)):
        matched[k] = texts[p][a:b]
    if not across_lines:
        good = np.array(["\n" not in m for m in matched], bool)
        page, start, stop, matched = page[good], start[good], stop[good], matched[good]
    no = place(page)
    if most:
        page, start, stop, matched, no = (x[no < most] for x in (page, start, stop, matched, no))
    return page, no, start, stop, pa.array(matched, pa.string())


def matches(pages: DataFrame | Spans, pattern: str, **options) -> DataFrame:
    """doc_id, page_index, match_no (from 0), start, stop, matched: leftmost, not overlapping. Options: regex, ignore_case, ignore_accents,
    across_lines, and most, at most so many a page (0: all). pages: rows with text, or Spans."""
    if isinstance(pages, Spans) and not options.get("regex"):
        return _literal_matches(pages, literals(pattern, **options))
    rows = (search_text(pages) if isinstance(pages, Spans) else pages).select(*PAGE, "text")

    def make(batch: pa.RecordBatch) -> list:
        page, *found = _places(batch, **options)
        return [*(batch.column(k).take(pa.array(page)) for k in PAGE), *found]

    return _by_block(_pieces(rows, pattern, **options), make, MATCH)


def _by_block(rows: DataFrame, make: Callable[[pa.RecordBatch], list], columns: str, column: str = "text") -> DataFrame:
    """The page and the columns declared, as make gives them for blocks of rows of about a megabyte of a column."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = ", ".join([*(f"{k} {declared(rows, k)}" for k in PAGE), columns])
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, column):
                yield pa.RecordBatch.from_arrays([(x if isinstance(x, pa.Array) else pa.array(x)).cast(f.type) for x, f in zip(make(part), arrow, strict=True)], names=arrow.names)

    return rows.mapInArrow(run, schema)


#: what a match has besides its page
MATCH = "match_no int, start bigint, stop bigint, matched string"


def _literal_matches(pages: Spans, seek: Callable[[pa.Array], tuple], plain: Callable[[pa.Array], pa.Array] = lambda text: text) -> DataFrame:
    """What seek finds in the texts that plain makes of the pages'."""

    def make(c: Chunks, text: pa.Array, *_) -> list:
        top = starts(c.page)
        page, *found = seek(plain(glue(text, top)))
        return [*c.of_pages(c.page[top][page]), *found]

    return pages.map(make, MATCH)


@cache
def letters(case: bool, accents: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each code point: what it is folded to, and whether it is a mark that is taken out. As in translate, the first of equal letters holds."""
    from vellum.functions import strings

    table, mark = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for on, old, new in ((case, strings.LOWER_FROM, strings.LOWER_TO), (accents, strings.ACCENTS_FROM, strings.ACCENTS_TO)):
        if on:
            step = np.arange(0x110000, dtype=np.uint32)
            for a, b in reversed(list(zip(old, new, strict=True))):
                step[ord(a)] = ord(b)
            table = step[table]
    if accents:
        mark[[ord(x) for x in re.findall(f"[{strings.MARKS}]", "".join(map(chr, range(0x10000))))]] = True
    return table, mark


def literals(pattern: str, *, regex: bool = False, ignore_case: bool = True, ignore_accents: bool = False, across_lines: bool = False, most: int = 0) -> Callable[[pa.Array], tuple]:
    """A function from texts to the matches in them: the text's place, match_no, start, stop and matched."""
    if not pattern:
        raise ValueError("an empty keyword")
    needle = fold_text(pattern, ignore_case, ignore_accents)
    gap = next(k for k in range(len(needle) + 1) if chr(k) not in needle)

    def seek(texts: pa.Array) -> tuple:
        whole = "\n".join(texts.to_pylist())
        size = pc.utf8_length(texts).to_numpy().astype(np.int64)
        first = np.cumsum(size + 1) - size - 1
        own, hay = first, np.frombuffer(bytearray(whole.encode("utf-32-le")), np.uint32)
        if ignore_case or ignore_accents:
            table, mark = letters(ignore_case, ignore_accents)
            if ignore_accents and (out := mark[hay]).any():
                own = first - np.append(0, np.cumsum(out))[first]
                hay = hay[~out]
            hay = table[hay]
        hay[own[1:] - 1] = gap  # what is not in the keyword keeps texts apart
        at = np.fromiter((m.start() for m in re.finditer(re.escape(needle), hay.tobytes().decode("utf-32-le"))), np.int64)
        page = np.searchsorted(own, at, side="right") - 1
        start = at - own[page] if len(at) else at
        matched = np.array([whole[k : k + len(needle)] for k in (first[page] + start).tolist()] if len(at) else [], object)
        if not across_lines:
            good = np.array(["\n" not in m for m in matched], bool)
            page, start, matched = page[good], start[good], matched[good]
        no = place(page)
        if most:
            page, start, matched, no = (x[no < most] for x in (page, start, matched, no))
        return page, no, start, start + len(needle), pa.array(matched, pa.string())

    return seek


def fold_text(s: str, case: bool, accents: bool) -> str:
    from vellum.functions import strings

    if case:
        s = s.translate(str.maketrans(strings.LOWER_FROM, strings.LOWER_TO))
    if accents:
        s = s.translate(str.maketrans(strings.ACCENTS_FROM, strings.ACCENTS_TO))
    return s


def boxes(c: Chunks, start: np.ndarray, stop: np.ndarray, page: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, list]:
    """Matches on the page-th page of a block from left to right, in order: which share characters with chunks, and of these the first and last
    chunk, the number of chunks, and the box of the shared parts (l, b, r, t)."""
    top = starts(c.page)
    row = np.cumsum(top) - 1
    base = np.append(0, np.cumsum(stop[np.append(top[1:], True)] + 1))
    from_, to = start + base[row], stop + base[row]
    left, right = left + base[page], right + base[page]
    lo, hi = np.searchsorted(to, left, side="right"), np.searchsorted(from_, right, side="left")
    good = hi > lo
    n = (hi - lo)[good]
    if not len(n):
        return good, [n] * 7
    match, k = np.repeat(np.flatnonzero(good), n), np.repeat(lo[good], n)
    k += place(match)
    total, chars = pc.binary_length(c.text).to_numpy()[k].astype(float), (stop - start)[k]
    a, b = np.maximum(left[match], from_[k]) - from_[k], np.minimum(right[match], to[k]) - from_[k]
    wide = np.flatnonzero(total != chars)  # letters of more than a byte
    if len(wide):
        for cut_at in (a, b):
            cut_at[wide] = [len(x[:m].encode()) for x, m in zip(c.text.take(pa.array(k[wide])).to_pylist(), cut_at[wide].tolist(), strict=True)]
    l, r, at = c.n["l"][k], c.n["r"][k], np.cumsum(n) - n  # noqa: E741
    index = c.n["chunk_index"][k].astype(np.int64)
    box = [np.fmin.reduceat(l + (r - l) * (a / total), at), np.fmin.reduceat(c.n["b"][k], at), np.maximum.reduceat(l + (r - l) * (b / total), at), np.maximum.reduceat(c.n["t"][k], at)]
    return good, [np.minimum.reduceat(index, at), np.maximum.reduceat(index, at), n, *box]


#: what a match has besides its page and itself
PLACED = "first_chunk int, last_chunk int, n_rects bigint, l double, b double, r double, t double"


def find(chunks: DataFrame | Paged, pattern: str, **options) -> DataFrame:
    """Matches with geometry from chunks: the chunks of a page give its text, its matches and their boxes."""
    if options.get("regex"):
        flat = _find_regex(paged(chunks), pattern, **options)
    else:
        seek = literals(pattern, **options)

        def placed(c: Chunks, text: pa.Array, start: np.ndarray, stop: np.ndarray) -> list:
            top = starts(c.page)
            page, no, left, right, matched = seek(glue(text, top))
            good, found = boxes(c, start, stop, page, left, right)
            return [*c.of_pages(c.page[top][page[good]]), no[good], left[good], right[good], matched.filter(pa.array(good)), *found]

        flat = spans(chunks).map(placed, f"{MATCH}, {PLACED}")
    return flat.select(*PAGE, "match_no", "start", "stop", "matched", "first_chunk", "last_chunk", "n_rects", F.struct(*"lbrt").alias("bbox"))


def _find_regex(chunks: Paged, pattern: str, **options) -> DataFrame:
    """Chunks go along with their pages' texts, packed, by Java's matches to a second worker; pages without a match stop before."""

    def pack(c: Chunks, text: pa.Array, start: np.ndarray, stop: np.ndarray) -> list:
        top = starts(c.page)
        rows = np.empty(len(c.page), PACKED)
        for k, x in {"size": pc.binary_length(text).to_numpy(), "start": start, "stop": stop, **{k: c.n[k] for k in ("chunk_index", *"lbrt")}}.items():
            rows[k] = x
        ends = np.append(np.flatnonzero(top), len(rows)) * PACKED.itemsize
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(rows.tobytes())])
        return [*c.of_pages(c.page[top]), glue(text, top), packed]

    def make(batch: pa.RecordBatch) -> list:
        page, no, left, right, matched = _places(batch, **options)
        c, start, stop = unpacked(batch)
        good, found = boxes(c, start, stop, page, left, right)
        return [*(k.take(pa.array(page[good])) for k in c.keys), no[good], left[good], right[good], matched.filter(pa.array(good)), *found]

    pages = Spans(chunks.apart(PACK)).map(pack, "text string, _c binary").select(*PAGE, "text", "_c")
    return _by_block(_pieces(pages, pattern, **options), make, f"{MATCH}, {PLACED}", "_c")


def unpacked(batch: pa.RecordBatch) -> tuple[Chunks, np.ndarray, np.ndarray]:
    """The chunks of pages, and where they start and stop in the texts."""
    packed = batch.column("_c").to_pylist()
    rows = np.frombuffer(b"".join(packed), PACKED)
    page = np.repeat(np.arange(len(packed)), [len(x) // PACKED.itemsize for x in packed])
    ends = np.append(0, np.cumsum(rows["size"], dtype=np.int64)).astype(np.int32)
    text = pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends), pa.py_buffer("".join(batch.column("text").to_pylist()).encode()))
    start, stop = rows["start"].astype(np.int64), rows["stop"].astype(np.int64)
    barrier = start > np.where(starts(page), 0, np.append(0, stop[:-1]))
    text = pc.if_else(pa.array(barrier), pc.utf8_slice_codeunits(text, 1), text)
    return Chunks([batch.column(k) for k in PAGE], page, text, {k: rows[k].astype(float) for k in ("chunk_index", *"lbrt")}), start, stop


def in_region(found: DataFrame, region: Column) -> DataFrame:
    return found.where(geometry.intersects(F.col("bbox"), region))


def first_overall(found: DataFrame, most: int) -> DataFrame:
    """The first matches of each document, in page order."""
    doc = Window.partitionBy("doc_id").orderBy("page_index", "match_no")
    return found.withColumn("_n", F.row_number().over(doc)).where(F.col("_n") <= most).drop("_n")


def search_filter(rows: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows any of whose columns holds the needle, letter case aside."""
    some = F.lit(False)
    for c in columns:
        some = some | to_lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(fold_text(needle, True, False))
    return rows.where(some)


def viewer_find(pages: DataFrame | Spans, pattern: str, start: Column, *, regex: bool = False, ignore_case: bool = True) -> DataFrame:
    """The matches of a viewer that looks from page start on and goes round: turn is how many pages it turns to get to a match. In a
    regular expression a dot takes line ends too; CR LF counts as one. pages: rows with text, or Spans."""
    texts = search_text(pages) if isinstance(pages, Spans) else pages
    if isinstance(pages, Spans) and not regex:
        found = _literal_matches(pages, literals(pattern, ignore_case=ignore_case), lambda text: pc.replace_substring(text, "\r\n", "\n"))
    else:
        plain = texts.withColumn("text", F.regexp_replace("text", "\r\n", "\n"))
        found = matches(plain, f"(?s){pattern}" if regex else pattern, regex=regex, ignore_case=ignore_case, across_lines=regex)
    count = texts.groupBy("doc_id").agg((F.max("page_index") + 1).alias("_n"))
    return found.join(count, "doc_id").withColumn("turn", F.pmod(F.col("page_index") - start, F.col("_n"))).drop("_n")


def index_statistics(pages: DataFrame) -> DataFrame:
    """doc_id, pages, characters and bytes of the search texts: what an index of them would hold."""
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("characters"), F.sum(F.octet_length("text")).alias("bytes"))
