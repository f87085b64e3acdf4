"""Layout, search, pages, edits, forms, audits and files on small fixtures with known results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vellum.functions import geometry as geo
from vellum.operators import edits, forms, layout, search
from vellum.operators import pages as pg
from vellum.sources import content, pdf


def chunks(spark, rows, mode=0):
    schema = "doc_id int, page_index int, chunk_index int, text string, l double, b double, r double, t double"
    df = spark.createDataFrame([(1, 0, i, *x) for i, x in enumerate(rows)], schema)
    return df.select("doc_id", "page_index", "chunk_index", "text", F.col("l").alias("x0"), F.col("r").alias("x1"), (F.col("b") + 2).alias("y"), geo.rect(F.col("l"), F.col("b"), F.col("r"), F.col("t")).alias("bbox"), F.lit(10.0).alias("font_size"), F.lit(mode).alias("rendering_mode"))


SPLIT = [("open", 10.0, 98.0, 30.0, 110.0), ("XL", 31.0, 98.0, 41.0, 110.0), (" unrelated", 50.0, 98.0, 100.0, 110.0)]
INVOICE = [("INV-", 0.0, 95.0, 20.0, 105.0), ("2026", 20.0, 95.0, 45.0, 105.0), ("\n", 0.0, 80.0, 0.0, 80.0), ("Total: 125.50", 0.0, 55.0, 75.0, 65.0)]


def test_match_over_chunks(spark):
    m = search.find(chunks(spark, SPLIT), "OPENxl").collect()
    assert len(m) == 1 and m[0]["matched"] == "openXL" and (m[0]["first_chunk"], m[0]["last_chunk"], m[0]["n_rects"]) == (0, 1, 2)
    assert (m[0]["bbox"]["l"], m[0]["bbox"]["r"]) == (10.0, 41.0)
    low = [SPLIT[0], ("XL", 31.0, 70.0, 41.0, 82.0), SPLIT[2]]
    assert search.find(chunks(spark, low), "openxl").count() == 0


def test_case_and_limits(spark):
    two = [("Hello", 0.0, 98.0, 40.0, 110.0), (" World", 40.0, 98.0, 80.0, 110.0), (" Hello", 100.0, 198.0, 140.0, 210.0)]
    c = chunks(spark, two)
    assert search.find(c, "hello").count() == 2 and search.find(c, "hello", ignore_case=False).count() == 0
    assert search.find(c, "Hello", regex=True, most=1).count() == 1
    assert search.matches(search.search_text(search.spans(chunks(spark, [("aaa", 0.0, 0.0, 9.0, 9.0)]))), "aa").count() == 1
    with pytest.raises(ValueError):
        search.matches(c, "")


def test_regex_and_barriers(spark):
    c = chunks(spark, INVOICE)
    m = search.find(c, r"INV-\d{4}", regex=True).collect()
    assert len(m) == 1 and m[0]["n_rects"] == 2 and m[0]["bbox"]["r"] == 45.0
    assert search.find(c, r"2026\s+Total", regex=True).count() == 0
    assert search.find(c, r"2026\s+Total", regex=True, across_lines=True).count() == 1


def test_accents(spark):
    c = chunks(spark, [("café", 0.0, 0.0, 30.0, 10.0)])
    assert [search.find(c, k, ignore_accents=a).count() for k, a in (("cafe", True), ("cafe", False), ("CAFÉ", False))] == [1, 0, 1]


def test_words(spark):
    c = chunks(spark, [("Hello", 0.0, 0.0, 25.0, 10.0), (" ", 25.0, 0.0, 28.0, 10.0), ("World", 28.0, 0.0, 55.0, 10.0)])
    w = layout.words(c).orderBy("word_index").collect()
    assert [(x["text"], x["bbox"]["l"], x["bbox"]["r"]) for x in w] == [("Hello", 0.0, 25.0), ("World", 28.0, 55.0)]
    assert search.find(c, "hello world").first()["bbox"]["r"] == 55.0


STREAMS = {
    "mixed": b'q BT /F1 12 Tf 1 0 0 1 72 720 Tm [(Hel) -120 (lo)] TJ ( World) Tj T* (Next) \' 0 0 (Quoted) " ET /Im1 Do /Sh1 sh Q',
    "order": b"BT /F1 10 Tf 1 0 0 1 20 100 Tm (World) Tj 1 0 0 1 10 120 Tm (Hello) Tj ET",
    "modes": b"BT /F1 10 Tf 3 Tr (clip) Tj 0 Tr (fill) Tj ET",
    "moved": b"2 0 0 3 100 200 cm BT /F1 10 Tf 1 0 0 1 5 7 Tm (A) Tj ET",
}


def test_content(spark):
    assert "".join(e[3] for e in content.events(STREAMS["mixed"]) if e[1] == "show_text") == "Hello WorldNextQuoted"
    kinds = [e[1] for e in content.events(STREAMS["mixed"])]
    assert [kinds.count(k) for k in ("begin_text", "set_font", "set_matrix", "invoke_object", "paint_shading")] == [1, 1, 1, 1, 1]
    a = next(iter(content.chunks(STREAMS["moved"])))
    assert (a["x0"], a["y"]) == (110.0, 221.0)
    df = spark.createDataFrame([(1, 0, STREAMS["order"]), (2, 0, STREAMS["modes"])], "doc_id int, page_index int, content binary")
    c = content.content_chunks(df)
    texts = {x["doc_id"]: x["text"] for x in layout.page_text(layout.of_mode(c, 0)).collect()}
    assert texts == {1: "Hello\nWorld", 2: "fill"}
    region = geo.rect(F.lit(0.0), F.lit(110.0), F.lit(100.0), F.lit(140.0))
    assert layout.page_text(layout.in_region(c.where("doc_id = 1"), region)).first()["text"] == "Hello"
    with pytest.raises(ValueError):
        layout.of_mode(c, 8)
    nested = b"1 0 0 1 10 0 cm 2 0 0 2 0 0 cm BT 1 0 0 1 0 0 Tm (A) Tj ET"
    assert next(iter(content.chunks(nested)))["x0"] == 20.0 and next(iter(content.chunks(nested, standard_cm=True)))["x0"] == 10.0


def test_files(spark):
    data = pdf.build([b"BT (one) Tj ET", b"BT (two) Tj ET"], "T(1)")
    broken = data.replace(b"startxref", b"startxxxx")
    newer = data + b"8 0 obj\n<</Title (New)>>\nendobj\n"
    at = len(newer)
    newer += f"xref\n8 1\n{len(data):010d} 00000 n \ntrailer\n<</Size 9 /Root 1 0 R /Info 8 0 R /Prev {data.rindex(b'xref', 0, data.rindex(b'startxref'))}>>\nstartxref\n{at}\n%%EOF".encode()
    df = spark.createDataFrame([(1, data), (2, broken), (3, newer), (4, b"not a file"), (5, data[: len(data) // 3]), (6, None)], "doc_id int, content binary")
    docs = {x["doc_id"]: x for x in pdf.read_documents(df).collect()}
    assert docs[1]["title"] == docs[2]["title"].replace("", "") or docs[1]["title"] == "T(1)"
    assert docs[1]["page_count"] == docs[2]["page_count"] == docs[3]["page_count"] == 2 and docs[3]["title"] == "New" and docs[4]["error"] and docs[6]["error"]
    pages = pdf.read_pages(df.where("doc_id = 1")).orderBy("page_index").collect()
    assert [bytes(p["content"]) for p in pages] == [b"BT (one) Tj ET", b"BT (two) Tj ET"] and pages[0]["media_box"] == [0, 0, 612, 792]


def test_object_streams_and_packed_xref(spark):
    import zlib

    inner = b"1 0 2 36 <</Type /Catalog /Pages 2 0 R>>      <</Type /Pages /Kids [4 0 R] /Count 1 /MediaBox [0 0 300 400] /Rotate -90>>"
    first = inner.index(b"<<")
    inner = f"1 0 2 {inner.index(b'<<', first + 2) - first} ".encode().ljust(first) + inner[first:]
    out = bytearray(b"%PDF-1.5\n")
    offs = {}
    packed = zlib.compress(inner)
    for num, body in ((3, f"<</Type /ObjStm /N 2 /First {first} /Filter /FlateDecode /Length {len(packed)}>>\nstream\n".encode() + packed + b"\nendstream"), (4, b"<</Type /Page /Parent 2 0 R>>")):
        offs[num] = len(out)
        out += f"{num} 0 obj\n".encode() + body + b"\nendobj\n"
    at = len(out)
    rows = [(0, 0, 0), (2, 3, 0), (2, 3, 1), (1, offs[3], 0), (1, offs[4], 0), (1, at, 0)]
    table = b"".join(bytes((a,)) + b.to_bytes(2, "big") + bytes((c,)) for a, b, c in rows)
    out += f"5 0 obj\n<</Type /XRef /Size 6 /W [1 2 1] /Root 1 0 R /Length {len(table)}>>\nstream\n".encode() + table + f"\nendstream\nendobj\nstartxref\n{at}\n%%EOF".encode()
    page = pdf.read_pages(spark.createDataFrame([(1, bytes(out))], "doc_id int, content binary")).first()
    assert page["error"] is None and page["media_box"] == [0, 0, 300, 400] and page["rotation"] == 270


def test_pages(spark):
    p = spark.createDataFrame([(1, i) for i in range(4)], "doc_id int, page_index int")
    order = lambda df: [x["page_index"] for x in df.orderBy("new_index").collect()]
    assert order(pg.move(p, 0, 2)) == [1, 2, 0, 3] and order(pg.move(p, 3, 1)) == [0, 3, 1, 2]
    assert order(pg.remove(p, spark.createDataFrame([(1, 1), (1, 1)], p.schema))) == [0, 2, 3]
    assert order(pg.extract(p, spark.createDataFrame([(1, 0, 3), (1, 1, 0)], "doc_id int, ordinal int, page_index int"))) == [3, 0]
    assert order(pg.duplicate(p, spark.createDataFrame([(1, 0, 2)], "doc_id int, ordinal int, page_index int"))) == [0, 1, 2, 3, 2]
    with pytest.raises(Exception, match="permutation"):
        pg.reorder(p, spark.createDataFrame([(1, 0, 1), (1, 1, 1)], "doc_id int, ordinal int, page_index int")).collect()


def test_forms(spark):
    rows = [(1, 0, "A", "10", None), (1, 1, "B", "5", None), (1, 2, "total", None, "total = A + B"), (1, 3, "bad", "7", "bad = A / 0")]
    got = {x["name"]: x for x in forms.calculate(spark.createDataFrame(rows, "doc_id int, ordinal int, name string, value string, script string")).collect()}
    assert got["total"]["value"] == "15" and got["total"]["calculated"] and got["bad"]["value"] == "7" and not got["bad"]["calculated"]


def test_edits(spark):
    text = "Call 555-0100 now or email 555-0101"
    c = chunks(spark, [(text, 0.0, 0.0, 350.0, 10.0)])
    rects = edits.redactions(search.find(c, r"\d{3}-\d{4}", regex=True))
    assert tuple(edits.redaction_counts(rects).first())[1:] == (2, 1)
    masked = edits.mask_text(spark.createDataFrame([(text,)], "text string"), r"\d{3}-\d{4}").first()[0]
    assert masked == "Call ████████ now or email ████████"
    assert edits.remove_annotations(spark.createDataFrame([("Link",), ("/Text",)], "subtype string"), ["Text"]).count() == 1


def test_entry_without_corpus_operators():
    """The entry imports, and has the engine's queries, whether or not the corpus operators are there."""
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"search_literal", "page_text", "pdf_roundtrip"} <= names and set(__spark_entry__.oracle_sql()) <= names
