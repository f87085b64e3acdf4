"""The readers as a Python data source: ``spark.read.format("vellum_pdf").option("table", "pages").load(path)``.

Options: path (a file, folder or glob that all executors see), table (documents, objects, xref, trailer, pages, events, chunks, outlines,
labels, annotations, fields, signatures, images, embedded, fonts, xmp), password, and the reader's limits by name (depth, pages, forms, objects,
file_bytes, stream_bytes, header_bytes, tail_bytes, header_drift, recover, strict). Files are dealt to partitions by size. Where files
are in a store that only Spark reads, ``pdf.read_files`` and the functions on rows of bytes do the same.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vellum.sources import content, pdf

PARTITION_BYTES = 64 << 20


def _pages(f: pdf.File) -> Iterator[tuple]:
    return ((p["page_index"], p["num"], p["media_box"], p["crop_box"], p["rotation"], p["content"]) for p in f.pages())


TABLES = {
    "documents": (pdf.DOCUMENT, pdf._document), "objects": (pdf.OBJECT, pdf._objects), "xref": (pdf.XREF, pdf._xref), "pages": (pdf.PAGE, _pages),
    "trailer": (pdf.TRAILER, lambda f: ((k, pdf.dump(v).decode("latin-1")) for k, v in sorted(f.trailer.items()))),
    "events": (f"page_index int, scope string, {content.EVENT}, error string", lambda f: ((p["page_index"], *e) for p in f.pages() for e in f.events(p["content"], p["resources"]))),
    "chunks": (f"page_index int, {content.FLAT}, error string", lambda f: ((p["page_index"], k, *c) for p in f.pages() for k, c in enumerate(f.chunks(p["content"], p["resources"])))),
    "outlines": (pdf.OUTLINE, pdf.File.outlines), "labels": (pdf.LABEL, pdf.File.labels), "annotations": (pdf.ANNOTATION, pdf.File.annotations), "fields": (pdf.FIELD, pdf.File.fields),
    "signatures": (pdf.SIGNATURE, pdf.File.signatures), "images": (pdf.IMAGE, pdf.File.images), "embedded": (pdf.EMBEDDED, pdf.File.files), "fonts": (pdf.FONT, pdf.File.fonts),
    "xmp": ("xmp binary, error string", lambda f: ((x,) for x in [f.xmp()] if x is not None)),
}


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str], width: int):
        self.width = width
        self.schema_text, self.make = TABLES[options.get("table", "pages").lower()]
        self.path = options["path"].removeprefix("file://")
        given = {k.lower(): v for k, v in options.items()}
        limits = {}
        for f in fields(pdf.Limits):
            v = given.get(f.name)
            if v is not None:
                limits[f.name] = v.encode() if f.name == "password" else v.lower() == "true" if f.type == "bool" else int(v)
        self.limits = pdf.Limits(**limits)

    def partitions(self) -> list[Files]:
        found = glob.glob(os.path.join(self.path, "**"), recursive=True) if os.path.isdir(self.path) else glob.glob(self.path)
        out, size = [Files([])], 0
        for path in sorted(x for x in found if os.path.isfile(x)):
            if size >= PARTITION_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += os.path.getsize(path)
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, "rb") as f:
                data = f.read()
            try:
                rows = [(path, *x, None) for x in self.make(pdf.File(data, self.limits))]
            except pdf.ERRORS as e:
                rows = [(path, *[None] * (self.width - 2), f"{type(e).__name__}: {e}")]
            yield from rows


class PdfDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vellum_pdf"

    def schema(self) -> str:
        return "path string, " + TABLES[self.options.get("table", "pages").lower()][0]

    def reader(self, schema) -> PdfReader:
        return PdfReader(dict(self.options), len(schema.names))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfDataSource)
