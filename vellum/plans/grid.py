"""The text grid: plain documents laid out as pages of positioned chunks.

A text's lines go to pages of 40; a line's runs of non-spaces become chunks, six units a character, in a box two units below and
eight above the baseline. All coordinates are small whole numbers. Everything is keyed by (doc_id, page_index). Texts are dealt out
by document once; chunks are columns within a worker (``paged``) until an operator gives its result or a query asks for their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.strings import split_lines
from vellum.plans.paged import Chunks, Paged, blocks, declared, place, starts

LINES, LEFT, TOP, STEP, EM = 40, 36.0, 780.0, 12.0, 6.0
FONT_SIZE = 10.0
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0


def pages(docs: DataFrame) -> DataFrame:
    """doc_id, page_index and media box; blank pages included. One row a page, without a shuffle."""
    count = F.floor((F.size(split_lines(F.coalesce("text", F.lit("")))) - 1) / LINES).cast("int")
    return docs.select("doc_id", F.explode(F.sequence(F.lit(0), count)).alias("page_index"))


def lay_out(doc_id: pa.Array, text: pa.Array, rendering_mode: bool = False) -> Chunks:
    """The chunks of whole documents: all steps run over the columns of a block."""
    text = pc.fill_null(text, "")
    if pc.any(pc.match_substring(text, "\r")).as_py():
        text = pc.replace_substring(pc.replace_substring(text, "\r\n", "\n"), "\r", "\n")
    lines = pc.split_pattern(text, "\n")
    many = np.diff(lines.offsets.to_numpy())
    doc, line_no = np.repeat(np.arange(len(many)), many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    index = line_no // LINES
    first = starts(doc) | starts(index)
    page = np.cumsum(first) - 1
    parts = pc.split_pattern(lines.flatten(), " ")
    off, word = parts.offsets.to_numpy(), parts.flatten()
    line = np.repeat(np.arange(len(doc)), np.diff(off))
    size = pc.utf8_length(word).to_numpy().astype(np.int64)
    end = np.cumsum(size + 1)
    at = end - size - 1 - np.append(0, end)[off[:-1]][line]
    keep = size > 0
    line, at, size = line[keep], at[keep], size[keep]
    x0 = LEFT + EM * at
    row = line_no[line] % LINES
    y = TOP - STEP * row
    mode = np.where(row % 7 == 6, 3, 0) if rendering_mode else np.zeros(len(row), np.int64)
    n = {"chunk_index": place(page[line]), "line_no": line_no[line], "x0": x0, "x1": x0 + EM * size, "y": y, "l": x0, "b": y - 2, "r": x0 + EM * size, "t": y + 8, "font_size": np.full(len(row), FONT_SIZE), "rendering_mode": mode}
    return Chunks([doc_id.take(pa.array(doc[first])), pa.array(index[first], pa.int32())], page[line], word.filter(pa.array(keep)), n)


def paged(docs: DataFrame, rendering_mode: bool = False) -> Paged:
    """The chunks of documents by the page. doc_id is a key: each document is one row.

    rendering_mode: give every seventh line of a page mode 3 (invisible), others mode 0; without it all have mode 0.
    """
    df = docs.select("doc_id", "text").repartition("doc_id")

    def load(batch: pa.RecordBatch) -> Iterator[Chunks]:
        for part in blocks(batch, "text"):
            yield lay_out(part.column("doc_id"), part.column("text"), rendering_mode)

    return Paged(df, load, f"doc_id {declared(df, 'doc_id')}, page_index int", whole=True)


def chunks(docs: DataFrame, rendering_mode: bool = False) -> DataFrame:
    """doc_id, page_index, chunk_index, line_no, text, x0, x1, y, bbox, font_size, rendering_mode: a row a chunk."""
    return paged(docs, rendering_mode).rows()
