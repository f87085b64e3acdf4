"""Files written and read: passwords, revisions, recovery, fonts, side tables, the data source, conformance, bitmaps, flowing text."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum import queries
from vellum.functions import bitmaps, codecs, geometry
from vellum.operators import conformance, flow
from vellum.sources import authoring, cmap, content, datasource, pdf, render, security

NAME, REF = pdf.Name, lambda n: pdf.Ref(n, 0)
SMALL = {1: {"Type": NAME("Catalog"), "Pages": REF(2)}, 2: {"Type": NAME("Pages"), "Kids": [REF(3)], "Count": 1}, 3: {"Type": NAME("Page"), "Parent": REF(2), "MediaBox": [0, 0, 100, 100], "Contents": REF(4)}, 4: pdf.Stream({}, b"BT /F1 10 Tf (plain) Tj ET"), 5: {"Title": "tïtle"}}
TRAILER = {"Root": REF(1), "Info": REF(5)}


def texts(f: pdf.File) -> list[str]:
    return [c[0] for p in f.pages() for c in f.chunks(p["content"], p["resources"])]


def test_passwords():
    data = pdf.assemble(SMALL, TRAILER, password=(b"user", b"owner"))
    assert b"plain" not in data
    for password, opens in ((b"user", True), (b"owner", True), (b"", False), (b"other", False)):
        f = pdf.File(data, pdf.Limits(password=password))
        assert f.authenticated == opens and (not opens or (texts(f) == ["plain"] and f.info()["Title"] == "tïtle"))


def test_aes():
    # a block of the published test vector, and many blocks in a chain made by undoing the decryption one block at a time
    key = bytes(range(16))
    assert security.aes_decrypt(key, bytes(16) + bytes.fromhex("69c4e0d86a7b0430d8cdb78070b4c55a")).hex() == "00112233445566778899aabbccddeeff"
    data = bytes(random.Random(1).randrange(256) for _ in range(16 * 9))
    whole = security.aes_decrypt(key, data)
    for k in range(7):
        assert security.aes_decrypt(key, data[16 * k : 16 * k + 32])[:15] == whole[16 * k : 16 * k + 16][:15]


def test_revisions_and_recovery():
    data = pdf.append_revision(pdf.assemble(SMALL, TRAILER), {5: {"Title": "new"}})
    assert pdf.File(data).info()["Title"] == "new"
    cut = pdf.File(data[: data.rindex(b"startxref")] + b"startxref\n9\n%%EOF")
    # recovery takes the first object of a number
    assert cut.info()["Title"] == "tïtle" and texts(cut) == ["plain"]
    with pytest.raises(pdf.ERRORS):
        pdf.File(data[: data.index(b"startxref")], pdf.Limits(recover=False))
    with pytest.raises(pdf.PdfError):
        pdf.File(data, pdf.Limits(file_bytes=10))


def test_font_decoding_and_widths():
    f = pdf.File(pdf.assemble(SMALL, TRAILER))
    font = {"Encoding": {"BaseEncoding": NAME("WinAnsiEncoding"), "Differences": [65, NAME("alpha"), NAME("eacute"), NAME("uni0416"), NAME("seven")]}, "FirstChar": 65, "Widths": [100, 200]}
    assert f.decoder(font)(b"ABCD\x80\x81") == "AéЖ7€•" and f.meter(font)(b"ABC") == 1300
    wide = {"Subtype": NAME("Type0"), "DescendantFonts": [{"W": [3, [500, 600], 10, 12, 70], "DW": 900}]}
    assert f.meter(wide)(bytes([0, 3, 0, 4, 0, 11, 0, 99])) == 500 + 600 + 70 + 900 and f.meter({})(b"x") is None


def test_code_spaces():
    two = cmap.parse("1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0010> <0041> endbfchar")
    assert cmap.decode_bytes(bytes.fromhex("00100041"), two) == "A" and cmap.decode_bytes(b"AB", two) == ""
    mixed = cmap.parse("2 begincodespacerange <00> <80> <8140> <FEFE> endcodespacerange 1 beginbfrange <8140> <8150> <3042> endbfrange")
    assert cmap.decode_bytes(b"a\x81\x41z\x90\x90", mixed) == "aぃz"
    assert not cmap.parse("1 beginbfrange <000000> <FFFFFF> <0041> endbfrange").ranges


def test_content_parts():
    c = list(content.chunks(b"BT /F1 10 Tf [-500 (Hello)] TJ ET"))
    assert c[0]["x1"] == 30 and [e[4] for e in content.events(b"[-500 (Hello) 20] TJ")] == [[-500.0, 20.0]]
    kinds = [e[1] for e in content.events(b"/A <</Group <</S /Transparency>>>> BDC /B BMC EMC EMC")]
    assert kinds == ["begin_group", "begin_marked", "end_marked", "end_group"]
    state: dict = {}
    list(content.events(b"2 J 3 w 1 0 0 1 5 6 cm q 9 w Q /F2 8 Tf 2 Tr", state=state))
    assert (state["line_cap"], state["line_width"], state["ctm"][4:], state["font"], state["rendering_mode"]) == (2, 3.0, [5.0, 6.0], "F2", 2)
    assert [x["text"] for x in content.chunks(b"(a\\)b\\\n(c)) Tj 1 2 3 4 5 6 Tm % x (no) Tj\n<41 42> Tj")] == ["a)b(c)", "AB"]


@pytest.mark.parametrize("colors", [1, 3, 4])
def test_predictors_like_byte_by_byte(colors):
    r = np.random.default_rng(colors)
    columns, rows = 7, 12
    data = r.integers(0, 256, rows * columns * colors, dtype=np.uint8).reshape(rows, -1)
    packed = b""
    for i in range(rows):
        kind = int(r.integers(0, 5))
        cur, above = data[i].astype(int), (data[i - 1] if i else np.zeros(columns * colors, int)).astype(int)
        left = np.concatenate([np.zeros(colors, int), cur[:-colors]])
        corner = np.concatenate([np.zeros(colors, int), above[:-colors]])
        p = left + above - corner
        nearest = np.stack([abs(p - left), abs(p - above), abs(p - corner)]).argmin(0)
        guess = [0 * cur, left, above, (left + above) // 2, np.choose(nearest, [left, above, corner])][kind]
        packed += bytes([kind]) + ((cur - guess) % 256).astype(np.uint8).tobytes()
    assert codecs.predictor_decode(packed, 15, colors, columns) == data.tobytes()
    for n in (data.size, data.size - 2, 1, 0):
        part = data.tobytes()[:n]
        for predictor in (2, 12):
            assert codecs.predictor_decode(codecs.predictor_encode(part, predictor, colors, columns), predictor, colors, columns) == part


def test_bitmaps():
    p = np.arange(2 * 3 * 4, dtype=np.uint8).reshape(2, 3, 4)
    assert (bitmaps.decode_png(bitmaps.encode_png(p)) == p).all() and (bitmaps.decode_png(bitmaps.encode_png(p[:, :, :1])) == p[:, :, :1]).all()
    with pytest.raises(ValueError):
        bitmaps.decode_png(b"no")
    a, b = np.array([0, 64, 255], np.uint8), np.array([255, 128, 100], np.uint8)
    assert bitmaps.blend(a, b, "Screen").tolist() == [255, 160, 255] and bitmaps.blend(a, b, "Difference").tolist() == [255, 64, 155] and bitmaps.blend(a, b, "Normal").tolist() == a.tolist()


def test_data_source(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf.assemble(SMALL, TRAILER, password=(b"u", b"o")))
    (tmp_path / "b.pdf").write_bytes(b"no file")
    datasource.register(spark)
    read = lambda name, **o: spark.read.format("vellum_pdf").options(table=name, **o).load(str(tmp_path)).orderBy("path").collect()
    got = read("documents", password="u")
    assert (got[0]["title"], got[0]["authenticated"], got[0]["error"]) == ("tïtle", True, None) and "no header" in got[1]["error"]
    assert [x["text"] for x in read("chunks", password="o") if x["error"] is None] == ["plain"]
    assert not read("documents")[0]["authenticated"] and "file too large" in read("pages", file_bytes="20")[0]["error"]


def spec(**more):
    return {"pages": [{"content": "/P <</MCID 0>> BDC BT /T0 9 Tf (x) Tj ET EMC", "tabs": "S", "struct_parents": 0}], **more}


def test_conformance_of_one_file(spark):
    tree = [{"role": "Document", "parent": None}, {"role": "H1", "parent": 0}, {"role": "H3", "parent": 0}, {"role": "TD", "parent": 0}, {"role": "Loop", "parent": 0}]
    files = [
        (1, authoring.build_document(spec(elements=tree, roles={"Loop": "Pool", "Pool": "Loop"}, lang="en", marked=True, display_title=True, info={"Title": "T"}, xmp="<x:xmpmeta><rdf:RDF><pdfuaid:part>1</pdfuaid:part><dc:title><rdf:Alt><rdf:li>T</rdf:li></rdf:Alt></dc:title><dc:language><rdf:Bag><rdf:li>en</rdf:li></rdf:Bag></dc:language></rdf:RDF></x:xmpmeta>", fonts=[{"embedded": True, "unicode": True}]))),
        (2, b"broken"),
    ]
    known = conformance.facts(spark.createDataFrame(files, "doc_id int, content binary"))
    got = {(x["code"], x["location"]) for x in conformance.validate(known, "PDF/UA-1").where("severity <> 'info'").collect()}
    assert got == {("PDFUA-HEADING-003", "1"), ("PDFUA-SEMANTIC-002", got and next(x[1] for x in got if x[0] == "PDFUA-SEMANTIC-002")), ("PDFUA-ROLE-002", "Loop"), ("PDFUA-PARENTTREE-016", "page 0")}
    assert known.where("doc_id = 2").first()["error"] and conformance.validate(known, "PDF/UA-1", 2).count() == 2
    assert all(conformance.rules_of(p) for p in conformance.PROFILES) and len({r.code for r in conformance.RULES}) == len(conformance.RULES)


def test_outlines_in_depth():
    rows = [{"title": t, "depth": d, "page": 0} for t, d in (("a", 0), ("b", 1), ("c", 5), ("d", 1), ("e", 0))]
    f = pdf.File(authoring.build_document(spec(outlines=rows)))
    assert [(x[1], x[2], x[3]) for x in f.outlines()] == [("a", 0, 0), ("b", 1, 0), ("c", 2, 0), ("d", 1, 0), ("e", 0, 0)]


def test_signature_covers_the_file():
    data = authoring.build_document(spec(signer="me"))
    status = lambda d: [x[-1] for x in pdf.File(d).signatures()]
    assert status(data) == ["digest_matches"] and status(data.replace(b"(x) Tj", b"(y) Tj").replace(b"1.7", b"1.5")) == ["digest_differs"]
    blank = authoring.build_document(spec(signer="me"))
    at = blank.index(b"/Contents <", blank.index(b"/ByteRange")) + 11
    assert status(blank[:at] + b"0" * 128 + blank[at + 128 :]) == ["not_signed"]


def test_flatten_and_resave(spark):
    box = {"l": 10.0, "b": 10.0, "r": 60.0, "t": 22.0, "page": 0}
    data = authoring.build_document(spec(fields=[{"name": "a.b", "v": "value", "appearance": True, **box}], annotations=[{"subtype": "Text", "contents": "n", **box}]))
    files = spark.createDataFrame([(1, data)], "doc_id int, content binary")
    flat = authoring.flatten(files, others=False)
    assert [x["subtype"] for x in pdf.read_annotations(flat).collect()] == ["Text"] and pdf.read_fields(flat).count() == 0
    assert [x["text"] for x in pdf.read_chunks(flat).collect()] == ["x", "value"]
    again = authoring.resave(flat)
    assert [x["text"] for x in pdf.read_chunks(again).collect()] == ["x", "value"] and pdf.read_objects(again).count() < pdf.read_objects(flat).count()


def test_wrapping(spark):
    df = spark.createDataFrame([(1, "aa bb cc dddddddd e\n\n  f"), (2, None)], "doc_id int, text string")
    got = [(x["doc_id"], x["text"]) for x in flow.flow_paragraphs(df, 5).orderBy("doc_id", "line_no").collect()]
    assert got == [(1, "aa bb"), (1, "cc"), (1, "dddddddd"), (1, "e"), (1, ""), (1, "f"), (2, "")]


def test_functions_that_cannot_be_read(spark):
    df = spark.createDataFrame([("<</FunctionType 0>>",), ("nonsense",), (None,), ("<</FunctionType 2 /N 1>>",)], "s string")
    assert [x[0] for x in df.select(geometry.parsed_function(F.col("s"), F.lit(0.5))).collect()] == [None, None, None, [0.5]]


def test_images_inline_and_in_forms():
    g = authoring.Graph()
    raw = zlib.compress(b"\x10\x20")
    image = g.add(pdf.Stream({"Type": NAME("XObject"), "Subtype": NAME("Image"), "Width": 2, "Height": 1, "BitsPerComponent": 8, "ColorSpace": NAME("DeviceGray"), "Filter": NAME("FlateDecode")}, raw))
    form = g.add(pdf.Stream({"Type": NAME("XObject"), "Subtype": NAME("Form"), "Matrix": [1, 0, 0, 1, 5, 5], "Resources": {"XObject": {"I": image}}}, b"10 0 0 10 0 0 cm /I Do"))
    body = g.add(pdf.Stream({}, b"q 4 0 0 4 1 1 cm BI /W 1 /H 1 /BPC 8 /CS /G ID \x41 EI Q /F Do"))
    page = g.add({"Type": NAME("Page"), "Contents": body, "Resources": {"XObject": {"F": form}}})
    root = g.add({"Type": NAME("Catalog"), "Pages": g.add({"Type": NAME("Pages"), "Kids": [page], "Count": 1})})
    got = list(pdf.File(pdf.assemble(g.objects, {"Root": root})).images())
    assert [(x[2], x[4], x[5], x[9], x[11]) for x in got] == [("Page", 1, 1, [1.0, 1.0, 5.0, 5.0], b"A"), ("Form1", 2, 1, got[1][9], raw)]


def rendered(body: bytes, box=(20, 20), smooth: int = 1) -> np.ndarray:
    f = pdf.File(pdf.build([body], "", box))
    return render.render_page(f, next(f.pages()), 72, smooth)


def test_rendering():
    dark = lambda body, **o: int((rendered(body, **o) < 128).all(axis=2).sum())
    assert rendered(b"", (10.2, 20)).shape == (20, 11, 3) and dark(b"2 3 4 5 re f") == 20
    # the first row is the top of the page
    assert (rendered(b"0 19 1 1 re f")[0, 0] == 0).all() and (rendered(b"1 0 0 rg 0 0 1 1 re f")[19, 0] == [255, 0, 0]).all()
    both = b"2 2 10 10 re 4 4 4 4 re "
    assert dark(both + b"f") == 100 and dark(both + b"f*") == 84
    assert dark(b"2 2 10 10 re 4 8 m 8 8 l 8 4 l 4 4 l h f") == 84  # an inner path the other way round
    assert dark(b"5 5 2 2 re W n 0 0 20 20 re f") == 4 and dark(b"q 5 5 2 2 re W n Q 0 0 3 3 re f") == 9
    assert dark(b"4 w 2 10 m 12 10 l S") == 40 and dark(b"0 w 2 10 m 12 10 l S") == 10
    disc = sum((i - 9.5) ** 2 + (j - 9.5) ** 2 < 64 for i in range(20) for j in range(20))
    assert abs(dark(b"18 10 m 18 14.4 14.4 18 10 18 c 5.6 18 2 14.4 2 10 c 2 5.6 5.6 2 10 2 c 14.4 2 18 5.6 18 10 c f") - disc) <= 4
    assert dark(b"0 1 -1 0 20 0 cm 2 3 4 5 re f") == 20 and dark(b"0 0 5 5 re f 1 g 0 0 3 3 re f") == 16
    half = rendered(b"0 0 1.5 20 re f", smooth=2)
    assert half.shape == (20, 20, 3) and half[5, 0, 0] == 0 and 120 < half[5, 1, 0] < 135


def test_small_tables_give_files_on_all_cores(spark, tmp_path):
    parts = [(k, 7, f"part {k}") for k in range(400)]
    spark.createDataFrame(parts, "p_partkey bigint, p_size int, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    files = queries.audited_files(spark, str(tmp_path))
    # (partition, rows) of the files: one partition held them all before
    held = files.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(x["count"] for x in held) == 400 and len(held) >= 4 * spark.sparkContext.defaultParallelism
    assert max(x["count"] for x in held) < 60


def test_arrays_of_whole_numbers():
    for text, want in ((b"[1 -2 +3]", [1, -2, 3]), (b"[ 1\n2 0 R 3]", [1, pdf.Ref(2, 0), 3]), (b"[1 2.5]", [1, 2.5]), (b"[]", []), (b"[1 [2]3]", [1, [2], 3]), (b"[12/A]", [12, "A"]), (b"[7%x\n8]", [7, 8])):
        assert pdf.parse(text, 0) == (want, len(text))
    assert pdf.dump([1, -2]) == b"[1 -2]" and pdf.dump([True, 1]) == b"[true 1]"


def test_bitmaps_leave_in_small_batches(spark):
    # 20 pages of 1,000 by 1,000 points, 3 MB each: all of them went out in one batch before
    data = pdf.build([b"0 0 10 10 re f"], "", (1000, 1000))
    files = spark.createDataFrame([(k, data) for k in range(20)], "doc_id int, content binary").coalesce(1)

    class Kept:
        columns, sparkSession, select = files.columns, spark, files.select

        def mapInArrow(self, run, schema):
            return run

    run = render.render_pages(Kept(), 72)
    out = list(run([pa.RecordBatch.from_pylist([{"doc_id": k, "content": data} for k in range(20)])]))
    assert sum(b.num_rows for b in out) == 20 and max(b.nbytes for b in out) < 10e6
    inked = render.render_pages(files, 72, measures={"dark": bitmaps.count_dark}).collect()
    assert [(x["page_index"], x["width"], x["dark"], x["error"]) for x in inked] == [(0, 1000, 100, None)] * 20
