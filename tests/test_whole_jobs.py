"""Queries that have to take every row, on small tables with the rows that a cut would lose."""

from __future__ import annotations

import hashlib

import pytest

from vellum import queries
from vellum.operators import edits
from vellum.sources import pdf

TEXTS = ["", "a", "ab", "abc", "abcd", "abcde", "é", "né nö", "x" * 61, "x" * 60 + "y", "0123456789" * 9, "0123456789" * 8 + "012345678!"]


@pytest.fixture(scope="module")
def texts_dir(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.parquet(f"{home}/documents.parquet")
    return str(home)


def test_predictor_takes_partial_rows(spark, texts_dir):
    got = queries.QUERIES["predictor_roundtrip"](spark, texts_dir).collect()
    assert sorted(map(tuple, got)) == list(enumerate(TEXTS))


def test_marked_content_of_every_row(spark, tmp_path):
    parts = [(0, "ECONOMY", "red (x)"), (49, "SMALL", "b\\"), (50, "LARGE", "c"), (12345, "PROMO", "d")]
    spark.createDataFrame(parts, "p_partkey bigint, p_type string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = queries.QUERIES["marked_content"](spark, str(tmp_path)).collect()
    want = [x for k, t, n in parts for x in ((k, t, ["P"], 2 * k), (k, n, ["P", "Span"], 2 * k + 1))]
    assert sorted(map(tuple, got)) == sorted(want)


def test_signature_digest_runs_to_the_end(spark, texts_dir):
    got = dict(map(tuple, queries.QUERIES["signature_digest"](spark, texts_dir).collect()))
    assert got == {k: hashlib.sha256((t[:20] + t[40:]).encode()).hexdigest() for k, t in enumerate(TEXTS)}
    assert len({got[k] for k in (8, 9, 10, 11)}) == 4


def test_reachable_follows_long_chains_and_cycles(spark):
    links = [(1, k, k + 1) for k in range(70)] + [(1, 70, 0), (1, 900, 901), (2, 0, 5)]
    refs = spark.createDataFrame(links, "doc_id int, num bigint, target bigint").coalesce(1)
    got = edits.reachable(spark.createDataFrame([(1, 0)], "doc_id int, num bigint"), refs).collect()
    assert sorted(map(tuple, got)) == [(1, k) for k in range(71)]


def test_forms_and_fonts_of_files(spark):
    stream = lambda head, data: f"<<{head} /Length {len(data)}>>\nstream\n{data}\nendstream"
    bodies = [
        "<</Type /Catalog /Pages 2 0 R>>",
        "<</Type /Pages /Kids [3 0 R] /Count 1 /Resources <</Font <</F1 6 0 R /F2 8 0 R>> /XObject <</X 5 0 R>>>>>>",
        "<</Type /Page /Parent 2 0 R /Contents 4 0 R>>",
        stream("", "BT /F1 10 Tf (\\001\\002) Tj ET q 1 0 0 1 50 60 cm /X Do Q BT /F2 10 Tf <03B103B2> Tj ET"),
        stream("/Type /XObject /Subtype /Form /Matrix [1 0 0 1 5 5]", "BT /F9 10 Tf (in form) Tj ET /X Do"),
        "<</Type /Font /Subtype /Type1 /ToUnicode 7 0 R>>",
        stream("", "2 beginbfchar <01> <0416> <02> <00660069> endbfchar"),
        "<</Type /Font /Subtype /Type0 /Encoding /Identity-H>>",
    ]
    data = "%PDF-1.7\n" + "".join(f"{k + 1} 0 obj\n{b}\nendobj\n" for k, b in enumerate(bodies)) + "trailer\n<</Root 1 0 R>>\n"
    files = spark.createDataFrame([(1, data.encode()), (2, b"no file")], "doc_id int, content binary")
    got = pdf.read_chunks(files).where("doc_id = 1").orderBy("chunk_index").collect()
    assert [x["text"] for x in got] == ["\u0416fi", "in form", "\u03b1\u03b2"] and (got[1]["x0"], got[1]["y"]) == (55.0, 65.0)
    assert pdf.read_chunks(files).where("doc_id = 2").first()["error"]
    assert pdf.read_pages(files).where("doc_id = 1").count() == 1


def test_region_redacted_in_every_document(spark, texts_dir):
    zones = queries.QUERIES["redact_text_rects"](spark, texts_dir).where("l = 100 and b = 600").collect()
    assert sorted(x["doc_id"] for x in zones) == list(range(len(TEXTS)))
    assert {x["doc_id"]: x["redactions"] for x in queries.QUERIES["redaction_counts"](spark, texts_dir).collect()} == dict.fromkeys(range(len(TEXTS)), 1)
