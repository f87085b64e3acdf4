"""Chunks by the page: documents, files or gathered rows become columns of chunks within a Python worker, and operators on pages run on
these columns there. What leaves the worker is a result (words, lines, texts, streams), so no relation of chunks is shuffled or sorted.

``Paged`` is a relation that is still to be loaded: a DataFrame and the function that lays its batches out as ``Chunks``, a block of
whole pages at a time. Operators take a Paged or a DataFrame of chunks, which is then gathered by page first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = ("doc_id", "page_index")
#: bytes of text to a block
BLOCK = 1 << 20
#: what every chunk has besides its text: columns of numbers
NUMBERS = ("chunk_index", "line_no", "x0", "x1", "y", "l", "b", "r", "t", "font_size", "rendering_mode")
WHOLE = ("chunk_index", "line_no", "rendering_mode")


@dataclass
class Chunks:
    """keys: columns with a value a page; page: the place of each chunk's page in them, ascending; text and n (columns of numbers): a
    value a chunk, in the order of chunk_index within a page."""

    keys: list[pa.Array]
    page: np.ndarray
    text: pa.Array
    n: dict[str, np.ndarray] = field(default_factory=dict)

    def where(self, good: np.ndarray) -> Chunks:
        return self if good.all() else Chunks(self.keys, self.page[good], self.text.filter(pa.array(good)), {k: v[good] for k, v in self.n.items()})

    def take(self, at: np.ndarray) -> Chunks:
        return Chunks(self.keys, self.page[at], self.text.take(pa.array(at)), {k: v[at] for k, v in self.n.items()})

    def of_pages(self, page: np.ndarray) -> list[pa.Array]:
        return [k.take(pa.array(page)) for k in self.keys]


def starts(group: np.ndarray) -> np.ndarray:
    """Whether an element begins a run of equal values."""
    return np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, bool)


def place(group: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run."""
    at = np.arange(len(group))
    return at - np.maximum.accumulate(np.where(starts(group), at, 0)) if len(group) else at


def before(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The predecessor's value (a run's first element: not a number)."""
    out = np.append(np.nan, values[:-1].astype(float)) if len(values) else values.astype(float)
    out[first] = np.nan
    return out


def lists(values: pa.Array, first: np.ndarray) -> pa.ListArray:
    """A list a run."""
    return pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(first), len(values)), pa.int32()), values)


def glue(texts: pa.Array, first: np.ndarray, between: str = "") -> pa.Array:
    """The texts of each run as one."""
    return texts if first.all() else pc.binary_join(lists(texts, first), between)


@dataclass(frozen=True)
class Paged:
    """whole: the blocks hold whole documents, pages in order. keys: the columns with a value a page, as Spark declares them."""

    df: DataFrame
    load: Callable[[pa.RecordBatch], Iterator[Chunks]]
    keys: str
    whole: bool = False

    def where(self, good: Callable[[Chunks], np.ndarray]) -> Paged:
        load = self.load
        return replace(self, load=lambda batch: (c.where(good(c)) for c in load(batch)))

    def apart(self, most: int) -> Paged:
        """Blocks of at most so many chunks, a page at least."""
        load = self.load

        def parts(batch: pa.RecordBatch) -> Iterator[Chunks]:
            for c in load(batch):
                ends, at = np.append(np.flatnonzero(starts(c.page))[1:], len(c.page)), 0
                while at < len(c.page):
                    k = int(np.searchsorted(ends, at, side="right"))
                    to = int(ends[max(k, int(np.searchsorted(ends, at + most, side="right")) - 1)])
                    yield c.take(np.arange(at, to)) if to - at < len(c.page) else c
                    at = to

        return replace(self, load=parts, whole=False)

    def map(self, make: Callable[[Chunks], list[pa.Array]], columns: str, keys: str | None = None) -> DataFrame:
        """make gives the columns of keys (as they are, or those named instead) and the columns declared, for a block that has chunks."""
        from pyspark.sql.pandas.types import to_arrow_schema

        load, schema = self.load, f"{self.keys if keys is None else keys}, {columns}"
        arrow = to_arrow_schema(self.df.sparkSession.createDataFrame([], schema).schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c in load(batch):
                    if len(c.page):
                        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) and x.type == f.type else x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(make(c), arrow, strict=True)], names=arrow.names)

        return self.df.mapInArrow(run, schema)

    def rows(self) -> DataFrame:
        """A row a chunk."""
        kinds = ", ".join(f"{k} {'int' if k in WHOLE else 'double'}" for k in NUMBERS)
        flat = self.map(lambda c: [*c.of_pages(c.page), c.text, *(c.n[k] for k in NUMBERS)], f"text string, {kinds}")
        own = [x for x in flat.columns if x not in ("text", *NUMBERS)]
        return flat.select(*own, "chunk_index", "line_no", "text", "x0", "x1", "y", F.struct(*"lbrt").alias("bbox"), "font_size", "rendering_mode")


def declared(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def paged(chunks: DataFrame | Paged) -> Paged:
    """Chunks as they are, or rows of them gathered by page; numbers that the rows lack are not numbers here."""
    if isinstance(chunks, Paged):
        return chunks
    has = set(chunks.columns)
    wanted = {"chunk_index": "chunk_index", "text": "text", **{k: k for k in ("line_no", "x0", "x1", "y", "font_size", "rendering_mode") if k in has}, **({k: f"bbox.{k}" for k in "lbrt"} if "bbox" in has else {})}
    row = F.struct(*(F.col(c).cast("string" if k == "text" else "double").alias(k) for k, c in wanted.items()))
    df = chunks.groupBy(*PAGE).agg(F.collect_list(row).alias("p"))

    def load(batch: pa.RecordBatch) -> Iterator[Chunks]:
        """Pages until there are enough chunks, put in order."""
        p = batch.column("p")
        ends = p.offsets.to_numpy()[1:] - p.offsets[0].as_py()
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK // 8, side="right")))
            part = p.slice(at, to - at)
            flat = part.flatten()
            page = np.repeat(np.arange(to - at), pc.list_value_length(part).to_numpy())
            n = {k: pc.struct_field(flat, k).to_numpy(zero_copy_only=False).astype(float) if k in wanted else np.full(len(flat), np.nan) for k in NUMBERS}
            c = Chunks([batch.column(k).slice(at, to - at) for k in PAGE], page, pc.struct_field(flat, "text"), n)
            yield c.take(np.lexsort((n["chunk_index"], page)))
            at = to

    return Paged(df, load, ", ".join(f"{k} {declared(df, k)}" for k in PAGE))


def blocks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about BLOCK bytes of a column, a row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    ends, at = np.cumsum(size, dtype=np.int64), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")))
        yield batch.slice(at, to - at)
        at = to
