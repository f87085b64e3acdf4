"""Chunks by the page: no relation of chunks is shuffled or sorted, and pages come out as the rows of their chunks give them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vellum import queries
from vellum.operators import edits, layout, search
from vellum.plans import grid
from vellum.sources import pdf

TEXTS = [None, "", " ", "\n" * 90 + "last", "a  b\r\nc\rd", "é ñandú ción", "x" * 3000 + " in the " * 500, "one\n" * 41, "(a\\b) c ", "the and the\n\n the"]
GRID = (
    "extract_words page_text search_literal search_regex search_case_sensitive search_max_matches search_document_counts search_ignore_accents search_across_lines search_regex_global_limit search_region search_from_page "
    "search_statistics highlight_matches redact_text_rects redaction_counts redact_regex_rects pdf_objects pdf_documents pdf_roundtrip content_event_counts build_lines visible_text"
).split()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("paged"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.parquet(f"{home}/documents.parquet")
    return home


@pytest.mark.parametrize("name", GRID)
def test_no_chunk_is_sorted_or_gathered(spark, docs, name):
    plan = queries.QUERIES[name](spark, docs)._jdf.queryExecution().optimizedPlan().toString()
    # windows over chunks and lists of chunks were what was spilled before; the one window left is over matches
    assert "collect_list" not in plan and plan.count("Window [") == (name == "search_regex_global_limit")


def test_pages_as_of_rows(spark, docs):
    d = spark.read.parquet(f"{docs}/documents.parquet")
    rows, pages = grid.chunks(d, True), grid.paged(d, True)
    key = lambda df: sorted(map(repr, df.collect()))
    for make in (layout.words, layout.build_lines, layout.page_text, layout.simple_text, lambda c: layout.page_text(layout.visible(c)), lambda c: search.find(c, "th"), lambda c: search.search_text(search.spans(c)), pdf.page_streams, pdf.write_pages):
        assert key(make(rows)) == key(make(pages)) != []
    r = (100.0, 600.0, 300.0, 700.0)
    assert key(layout.simple_text(layout.in_region(pages, r))) == key(layout.simple_text(layout.in_region(rows, F.expr("named_struct('l', 100D, 'b', 600D, 'r', 300D, 't', 700D)"))))
    assert layout.words(pages.where(lambda c: c.n["l"] < 0)).count() == 0


def test_pages_of_odd_texts(spark, docs):
    got = {(x["doc_id"], x["page_index"]): x["text"] for x in layout.page_text(grid.paged(spark.read.parquet(f"{docs}/documents.parquet"))).collect()}
    assert {k for k in got if k[0] < 4} == {(3, 2)} and got[3, 2] == "last" and got[4, 0] == "a b\nc\nd" and got[7, 1] == "one"
    assert len(got[6, 0].split()) == 1001


def test_blocks_break_between_documents(spark, docs, monkeypatch):
    import pyarrow as pa

    from vellum.plans import paged

    monkeypatch.setattr(paged, "BLOCK", 10)
    batch = pa.RecordBatch.from_pylist([{"text": t} for t in TEXTS])
    parts = list(paged.blocks(batch, "text"))
    assert [t for p in parts for t in p.column("text").to_pylist()] == TEXTS and len(parts) > 5


def test_placed_strings_are_read_as_one():
    from vellum.sources import content

    plain = b"BT /F1 10 Tf 120 Tz 1 0 0 1 36 780 Tm (ab) Tj\n2 0 0 3 -1.5 .5 Tm(c) Tj (d) Tj 7 1 0 0 1 5 6 Tm (e)Tj 1 0 0 1 5 6 Tm (\\(f) Tj ET"
    parted = plain.replace(b"Tm", b"Tm %\n")  # a comment keeps matrix and string apart
    assert [op for op, _ in content.operations(plain, True)] == ["BT", "Tf", "Tz", "TmTj", "TmTj", "Tj", "Tm", "Tj", "Tm", "Tj", "ET"]
    for lead in (b"", b"2 0 0 2 1 1 cm ", b"1 Tc ", b"3 Tw ", b"/P <</MCID 4>> BDC ", b"3 Tr "):
        assert list(content.chunk_tuples(lead + plain)) == list(content.chunk_tuples(lead + parted)) != []
        assert list(content.chunk_tuples(lead + plain, invisible=False)) == list(content.chunk_tuples(lead + parted, invisible=False))
    assert [op for op, _ in content.operations(plain)].count("Tm") == 4


def test_pages_of_files_in_one_pass(spark, docs):
    files = pdf.write_pages(grid.paged(spark.read.parquet(f"{docs}/documents.parquet"))).unionByName(spark.createDataFrame([(99, b"no file")], "doc_id bigint, content binary"))
    got = {(x["doc_id"], x["page_index"]): x for x in layout.page_text(pdf.paged_chunks(files)).collect()}
    old = layout.page_text(pdf.read_chunks(files).where("error is null")).collect()
    assert {k: x["text"] for k, x in got.items()} == {(x["doc_id"], x["page_index"]): x["text"] for x in old} and 99 not in {k[0] for k in got}
    assert all(x["rotation"] == 0 and x["media_box"] == [0, 0, 612, 792] for x in got.values())
    # files were written twice, for pages and for chunks, and joined before
    assert "Join" not in queries.QUERIES["pdf_roundtrip"](spark, docs)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("keyword, options", [("th", {}), ("THE", {"most": 2}), ("The", {"ignore_case": False}), ("ción", {"ignore_accents": True}), ("nandu", {"ignore_accents": True}), ("e\nt", {"across_lines": True}), ("\n", {"across_lines": True}), ("e\nt", {}), ("\x00", {})])
def test_literals_in_pages_as_in_rows(spark, keyword, options):
    odd = [*TEXTS, "the THE\x00the " * 60, "éño ción ción CIÓN 😀the😀ción ñandú", "the\nthe " * 50, "́́the", "\x00\x01\x02"]
    pages = grid.paged(spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string"))
    key = lambda df: sorted(map(repr, df.collect()))
    rows = search.matches(search.search_text(search.spans(pages)), keyword, **options)
    assert key(search.matches(search.spans(pages), keyword, **options)) == key(rows)
    # with rectangles, as a regular expression's are found; a match that holds none of the chunks' letters has none
    fold = search.fold_text(keyword, options.get("ignore_case", True), options.get("ignore_accents", False))
    if keyword == fold and not options.get("ignore_accents") and "most" not in options:
        java = {"regex": True, **options}
        assert key(search.find(pages, keyword, **options)) == key(search.find(pages, search.literal(keyword), **java))
    assert key(search.find(pages, keyword, **options).select(*rows.columns)) == key(rows.where("matched <> '\n'"))


def test_one_long_page_of_matches(spark):
    # each match copied the list of those before, and looked through the page's chunks: 200,000 of them did not end
    pages = grid.paged(spark.createDataFrame([(1, "the " * 200_000)], "doc_id bigint, text string"))
    got = search.find(pages, "THE").agg(F.count("*"), F.sum("match_no"), F.sum("first_chunk"), F.max("stop"), F.max("bbox.r"), F.sum("n_rects")).first()
    n, top = 200_000, 199_999 * 200_000 // 2
    assert tuple(got) == (n, top, top, 3 * n, 36.0 + 6 * (4 * n - 1), n)
    assert search.matches(search.spans(pages), "the").count() == n


def test_literals_stay_in_the_worker(spark, docs):
    for name in ("search_literal", "search_region", "highlight_matches", "redact_text_rects", "search_max_matches", "search_ignore_accents", "search_from_page"):
        assert "lambdafunction" not in queries.QUERIES[name](spark, docs)._jdf.queryExecution().optimizedPlan().toString()


def test_viewer_finds_in_pages_as_in_rows(spark):
    rows = spark.createDataFrame([(1, 0, 0, "the\r\n x the"), (1, 2, 0, "the"), (2, 1, 0, "x\r\nTHE"), (2, 1, 1, "he")], "doc_id bigint, page_index int, chunk_index int, text string")
    pages = search.spans(rows)
    for options in ({}, {"ignore_case": False}, {"regex": True}):
        got = [sorted(map(repr, search.viewer_find(p, "the", F.lit(1), **options).collect())) for p in (pages, search.search_text(pages))]
        assert got[0] == got[1] and len(got[0]) == (3 if "ignore_case" in options else 4)


def test_one_long_page_of_regular_matches(spark):
    # Java's matches were put in place one after the other, each copying the list of those before, and looked through the page's chunks
    pages = grid.paged(spark.createDataFrame([(1, "the " * 200_000)], "doc_id bigint, text string"))
    got = search.find(pages, "TH[e]", regex=True).agg(F.count("*"), F.sum("match_no"), F.sum("first_chunk"), F.max("stop"), F.max("bbox.r"), F.sum("n_rects")).first()
    n, top = 200_000, 199_999 * 200_000 // 2
    assert tuple(got) == (n, top, top, 3 * n, 36.0 + 6 * (4 * n - 1), n)
    assert search.matches(search.spans(pages), "th[e]", regex=True).count() == n


@pytest.mark.parametrize("pattern, want", [("(?=a)|b", [(0, 1, 2, "b"), (1, 2, 3, "b")]), (r"(a)\1", [(0, 4, 6, "aa")]), ("[bc]*", [(0, 1, 4, "bbc")]), ("😀.", [(0, 6, 8, "😀é")]), ("z", [])])
def test_matches_of_odd_expressions(spark, pattern, want):
    # an empty match at the start shifted the others, of which the last was lost; a group's number was off by one
    pages = grid.paged(spark.createDataFrame([(1, "abbcaa😀é"), (2, ""), (3, None)], "doc_id bigint, text string"))
    for found in (search.find(pages, pattern, regex=True), search.matches(search.spans(pages), pattern, regex=True)):
        assert sorted(tuple(x)[2:6] for x in found.collect()) == want


def test_packed_chunks_in_small_blocks(spark, monkeypatch):
    from vellum.plans import paged

    rows = grid.paged(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string"))
    key = lambda df: sorted(map(repr, df.collect()))
    whole = key(search.find(rows, "[a-z]\n[a-zé]|ñ.*", regex=True, across_lines=True))
    monkeypatch.setattr(search, "PACK", 3)
    assert key(search.find(rows, "[a-z]\n[a-zé]|ñ.*", regex=True, across_lines=True)) == whole != []
    c = grid.lay_out(*(paged.pa.array(x) for x in ([1, 2, 3], ["a b c d\n" * 50, "", "x\ny"])))
    assert [len(x.page) for x in paged.Paged(None, lambda _: iter([c]), "").apart(170).load(None)] == [160, 42]
    assert [len(x.page) for x in paged.Paged(None, lambda _: iter([c]), "").apart(1).load(None)] == [160, 40, 2]


def test_redactions_of_one_long_page(spark):
    # the boxes of numbers: each looked through the chunks of its page
    pages = grid.paged(spark.createDataFrame([(1, "call 555-1234 " * 100_000), (2, "555-123")], "doc_id bigint, text string"))
    got = edits.redactions(search.find(pages, "[0-9]{3}-[0-9]{4}", regex=True)).agg(F.count("*"), F.min("rect.l"), F.max("rect.r"), F.sum(F.col("rect.r") - F.col("rect.l"))).first()
    assert tuple(got) == (100_000, 36 + 6 * 5 - 1, 36 + 6 * (14 * 100_000 - 1) + 1, 100_000 * (6 * 8 + 2))


def test_matches_across_lines_of_one_long_page(spark):
    # two blanks part chunks, so each match holds a barrier; each match copied the list of those before
    pages = search.spans(grid.paged(spark.createDataFrame([(1, "x.  Ab " * 100_000)], "doc_id bigint, text string")))
    found = search.matches(pages, "[.]\n[A-Z]", regex=True, ignore_case=False, across_lines=True)
    assert tuple(found.agg(F.count("*"), F.max("match_no"), F.max("start"), F.min("matched"), F.max("matched")).first()) == (100_000, 99_999, 5 * 100_000 - 4, ".\nA", ".\nA")
    assert search.matches(pages, "[.]\n[A-Z]", regex=True, ignore_case=False).count() == 0


def test_first_matches_of_documents_with_long_pages(spark):
    # all matches of a page are found before the first of the document are taken; each copied the list of those before
    pages = search.spans(grid.paged(spark.createDataFrame([(k, ("\n" * 39 if k else "") + "one " * 100_000 + "\none one") for k in range(2)], "doc_id bigint, text string")))
    got = search.first_overall(search.matches(pages, "on[a-z]", regex=True, ignore_case=False), 100_001)
    assert {tuple(r) for r in got.groupBy("doc_id", "page_index").agg(F.count("*"), F.max("stop")).collect()} == {(0, 0, 100_001, 300_004), (1, 0, 100_000, 300_000), (1, 1, 1, 3)}
