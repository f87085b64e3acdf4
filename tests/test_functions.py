"""Text functions, codecs and shaping on values with known results."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import codecs, shaping
from vellum.functions import geometry as geo
from vellum.functions import strings as st


@pytest.mark.parametrize(
    ("build", "value", "expected"),
    [
        (st.count_code_points, "héllo", 6),
        (lambda c: st.truncate(c, 3), "héllo", "hé..."),
        (lambda c: st.truncate(c, 5), "hello world", "hello..."),
        (lambda c: st.truncate(c, 0), "x", "..."),
        (st.to_upper, "café ß ÿ ſ ı", "CAFÉ ß Ÿ S ı"),
        (st.to_lower, "CAFÉ İ", "café ı"),
        (st.split_lines, "a\r\nb\n\nc", ["a", "b", "", "c"]),
        (st.count_words, "hello  world \n foo", 3),
        (st.title_case, "hELLO wORLD", "Hello World"),
        (lambda c: F.size(st.grapheme_clusters(c)), "ábc", 3),
        (st.remove_diacritics, "Ærø ßł", "Aro ßł"),
        (st.is_whitespace, "", True),
        (st.trim_whitespace, "   x　", "x"),
        (st.valid_language_tag, "en-US", True),
        (st.valid_language_tag, "en_US", False),
        (lambda c: st.number_label("lower_alpha", F.lit(27)), "", "aa."),
        (lambda c: st.number_label("upper_roman", F.lit(3999)), "", "MMMCMXCIX."),
        (st.parse_mcid, "<</MCID 7>>", 7),
        (st.parse_mcid, "/MCID 99999999999", None),
        (st.escape_name, "a b#é", "/a#20b#23#C3#A9"),
        (st.escape_literal, "a(b)\\\n\x01é", "(a\\(b\\)\\\\\\n\\001\\303\\251)"),
        (shaping.reorder_bidi, "אב", "בא"),
        (shaping.shape_arabic, "بت", "ﺑﺖ"),
        (lambda c: shaping.word_wrap(c, 5), "aaa bb cc", ["aaa", "bb cc"]),
        (codecs.ascii_hex_decode, "48 656C6C6F7>", bytearray(b"Hellop")),
    ],
)
def test_known_values(spark, build, value, expected):
    got = spark.createDataFrame([(value,)], "v string").select(build(F.col("v")).alias("x")).first()[0]
    assert got == expected


def test_nulls(spark):
    row = spark.createDataFrame([(None,)], "v string").select(*(f(F.col("v")).alias(f"x{i}") for i, f in enumerate((st.to_upper, st.title_case, st.trim_whitespace, lambda c: st.truncate(c, 3), shaping.reorder_bidi)))).first()
    assert set(row) == {None}


def test_codecs_round_trip():
    r = random.Random(2)
    for n in (0, 1, 129, 5000, 40_000):
        for data in (os.urandom(n), bytes(r.choice(b"ab") for _ in range(n)), b"a" * n):
            for name in codecs.ENCODE:
                assert codecs.run_filters(codecs.run_filters(data, [name], codecs.ENCODE), [name], codecs.DECODE) == data
            assert codecs.lzw_decode(codecs.lzw_encode(data, 0, True), 0, True) == data
            for predictor in (1, 2, 12):
                assert codecs.predictor_decode(codecs.predictor_encode(data, predictor, 1, 7), predictor, 1, 7) == data


def test_png_filters():
    rows = bytes([0, 1, 2, 3, 1, 1, 1, 1, 2, 1, 1, 1, 3, 2, 2, 2, 4, 1, 1, 1])
    assert codecs.predictor_decode(rows, 15, 1, 3) == bytes([1, 2, 3, 1, 2, 3, 2, 3, 4, 3, 5, 6, 4, 6, 7])


def test_filter_guard():
    with pytest.raises(ValueError):
        codecs.run_filters(b"x", ["Nope"], codecs.DECODE)


def test_functions_and_shadings(spark):
    x = F.lit(0.5)
    row = spark.range(1).select(
        geo.exponential(x, [0.0], [1.0], 2.0)[0].alias("e"), geo.sampled(F.lit(0.26), [0.0, 1.0, 2.0, 3.0, 4.0]).alias("s"),
        geo.stitched(F.lit(10), [10.0, 20.0], [F.lit("a"), F.lit("b"), F.lit("c")]).alias("p"),
        geo.calculator("{ dup mul neg }", F.lit(3.0))[0].alias("c"), geo.axial(F.lit(-1.0), F.lit(0.0), 0, 0, 10, 0).alias("out"),
        geo.axial(F.lit(-1.0), F.lit(0.0), 0, 0, 10, 0, (True, False)).alias("low"), geo.radial(F.lit(5.0), F.lit(0.0), 0, 0, 0, 0, 0, 10).alias("r"),
        geo.grayscale(F.lit(255), F.lit(255), F.lit(255)).alias("g"),
    ).first()
    assert tuple(row) == (0.25, 1.0, "a", -9.0, None, 0.0, 0.5, 255)
