"""Chunks to words, lines, pages and documents; filters on chunks.

Relations are keyed by (doc_id, page_index); chunk_index gives the order within a page. Chunks are rows, or Paged: then they have not
left the worker that laid them out. Lines come from gaps and islands over (y descending, x, chunk_index): a chunk starts a line when
it lies more than the tolerance below its predecessor. Words, lines and texts are made a block of pages at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import geometry
from vellum.plans.paged import PAGE, Chunks, Paged, before, glue, paged, place, starts


def in_region(chunks: DataFrame | Paged, region: Column | tuple[float, float, float, float], contained: bool = False) -> DataFrame | Paged:
    """Chunks whose boxes touch the region, or lie in it. Of Paged chunks the region is numbers (l, b, r, t)."""
    if isinstance(chunks, Paged):
        l, b, r, t = region  # noqa: E741
        if contained:
            return chunks.where(lambda c: (c.n["l"] >= l) & (c.n["r"] <= r) & (c.n["b"] >= b) & (c.n["t"] <= t))
        return chunks.where(lambda c: (c.n["l"] <= r) & (c.n["r"] >= l) & (c.n["b"] <= t) & (c.n["t"] >= b))
    return chunks.where(geometry.contains(region, F.col("bbox")) if contained else geometry.intersects(F.col("bbox"), region))


def visible(chunks: DataFrame | Paged) -> DataFrame | Paged:
    return chunks.where(lambda c: c.n["rendering_mode"] != 3) if isinstance(chunks, Paged) else chunks.where("rendering_mode <> 3")


def of_mode(chunks: DataFrame | Paged, mode: int) -> DataFrame | Paged:
    if not 0 <= mode <= 7:
        raise ValueError("a text rendering mode is between 0 and 7")
    return chunks.where(lambda c: c.n["rendering_mode"] == mode) if isinstance(chunks, Paged) else chunks.where(F.col("rendering_mode") == mode)


def _ordered(c: Chunks, *keys: np.ndarray) -> Chunks:
    """By page, and by keys within it; what is in order already stays where it is."""
    ok, tie = np.zeros(len(c.page) - 1, bool), np.ones(len(c.page) - 1, bool)
    for k in (c.page, *keys):
        ok |= tie & (k[1:] > k[:-1])
        tie &= k[1:] == k[:-1]
    return c if (ok | tie).all() else c.take(np.lexsort((*reversed(keys), c.page)))


def lines_of(c: Chunks, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of each line: its page, number (from 0), y (of its first chunk) and text."""
    c = _ordered(c, -c.n["y"], c.n["x0"], c.n["chunk_index"])
    first, n = starts(c.page), c.n
    new = np.abs(before(n["y"], first) - n["y"]) > tolerance
    size = n["font_size"].astype(float)
    wide = n["x0"] - before(n["x1"], first) > np.fmax(3.0, np.fmin(before(size, first), size) * 0.2)
    shut = pc.fill_null(pc.match_substring_regex(c.text, r"[ \n\r\t]\z"), True).to_numpy(zero_copy_only=False)
    blank = wide & ~new & ~np.append(True, shut[:-1])
    text = pc.fill_null(c.text, "")
    if blank.any():
        text = pc.binary_join_element_wise(pa.array(np.array(["", " "], object)).take(pa.array(blank.astype(np.int8))), text, "")
    line = np.cumsum(new | first)
    order = np.lexsort((n["chunk_index"], n["x0"], line))
    if (order[1:] != order[:-1] + 1).any():
        text, y = text.take(pa.array(order)), n["y"][order]
    else:
        y = n["y"]
    top = starts(line)
    page = c.page[top]
    return page, place(page), y[top], pc.utf8_rtrim(glue(text, top), " ")


def build_lines(chunks: DataFrame | Paged, tolerance: float = 2.0) -> DataFrame:
    """doc_id, page_index, line, y (of its first chunk), text."""

    def make(c: Chunks) -> list:
        page, line, y, text = lines_of(c, tolerance)
        return [*c.of_pages(page), line, y, text]

    return paged(chunks).map(make, "line int, y double, text string")


def page_text(chunks: DataFrame | Paged, tolerance: float = 2.0) -> DataFrame:
    """doc_id, page_index, text: lines from top to bottom."""

    def make(c: Chunks) -> list:
        page, _, _, text = lines_of(c, tolerance)
        top = starts(page)
        return [*c.of_pages(page[top]), pc.utf8_rtrim(glue(text, top, "\n"), " ")]

    return paged(chunks).map(make, "text string")


def simple_text(chunks: DataFrame | Paged) -> DataFrame:
    """doc_id, page_index, text: chunks in their order, nothing between them."""

    def make(c: Chunks) -> list:
        top = starts(c.page)
        return [*c.of_pages(c.page[top]), pc.utf8_rtrim(glue(pc.fill_null(c.text, ""), top), " ")]

    return paged(chunks).map(make, "text string")


def document_text(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, text: pages joined by newlines; a blank page keeps its separator."""
    full = pages.join(texts, list(PAGE), "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return full.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def words(chunks: DataFrame | Paged, gap: float = 3.0) -> DataFrame:
    """doc_id, page_index, word_index, text, bbox, first_chunk, chunk_count. Chunks in their order; a word ends at a blank chunk, a
    gap over the threshold, or a shift over half the height. Boxes are compared with the predecessor's, which equals the word's
    so far while chunks run to the right."""

    def make(c: Chunks) -> list:
        n = c.n
        c = c.where((n["r"] - n["l"] > 0) & (n["t"] - n["b"] > 0))
        n, first = c.n, starts(c.page)
        blank = pc.fill_null(pc.match_substring_regex(c.text, r"\A[ \t\n\x0B\f\r]*\z"), False).to_numpy(zero_copy_only=False)
        last = {k: before(n[k], first) for k in "lbrt"}
        tall = np.fmax(last["t"] - last["b"], n["t"] - n["b"]) * 0.5
        new = first | np.append(True, blank[:-1])[: len(blank)] | (n["l"] - last["r"] > max(gap, 0.0)) | (np.abs(n["b"] - last["b"]) > tall)
        word = np.cumsum(new)[~blank]
        c = c.where(~blank)
        n, top = c.n, starts(word)
        at = np.flatnonzero(top)
        if not len(at):
            return [*c.of_pages(c.page), np.zeros(0, int), c.text, *[np.zeros(0)] * 4, *[np.zeros(0, int)] * 2]
        page = c.page[top]
        box = [f.reduceat(n[k], at) for k, f in (("l", np.fmin), ("b", np.fmin), ("r", np.fmax), ("t", np.fmax))]
        return [*c.of_pages(page), place(page), glue(pc.fill_null(c.text, ""), top), *box, n["chunk_index"][top].astype(np.int64), np.diff(np.append(at, len(word)))]

    flat = paged(chunks).map(make, "word_index int, text string, l double, b double, r double, t double, first_chunk int, chunk_count int")
    return flat.select(*PAGE, "word_index", "text", F.struct(*"lbrt").alias("bbox"), "first_chunk", "chunk_count")
