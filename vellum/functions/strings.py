"""Text functions of a page-document engine as Column expressions.

Case and accent mapping cover ASCII, Latin-1 and Latin Extended-A only and never change the number of code points, so they are
``translate`` calls rather than ``upper``/``lower``. Functions that need a state machine (bidi, Arabic forms, wrapping, NFC) are
in ``vellum.functions.shaping``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _latin() -> list[str]:
    return [chr(c) for c in range(0xC0, 0x180)]


def case_tables() -> tuple[str, str, str, str]:
    """(from, to) for upper-casing and (from, to) for lower-casing.

    Rule: single-character case pairs that both lie in ASCII, Latin-1 and Latin Extended-A. Fixed values beyond the rule: long s
    upper-cases to S; capital dotted I lower-cases to dotless i, which has no upper case.
    """
    up = {chr(c): chr(c - 32) for c in range(97, 123)}
    low = {v: k for k, v in up.items()}
    for c in _latin():
        u = c.upper()
        if len(u) == 1 and u != c and 0xC0 <= ord(u) < 0x180:
            up[c] = u
            low[u] = c
    up["ſ"] = "S"
    low["İ"] = "ı"
    return "".join(up), "".join(up.values()), "".join(low), "".join(low.values())


UPPER_FROM, UPPER_TO, LOWER_FROM, LOWER_TO = case_tables()

#: fixed values: accented letters and the ASCII letter each stands for (others, as sharp s and l with stroke, stay)
ACCENTED = {
    "A": "ÀÁÂÃÄÅĀĂĄǞǺÆ", "a": "àáâãäåāăąǟǻæ", "C": "ÇĆĈĊČ", "c": "çćĉċč", "D": "ĐÐ", "d": "đð",
    "E": "ÈÉÊËĒĔĖĘĚȀȂȄ", "e": "èéêëēĕėęěȁȃȅ", "I": "ÌÍÎÏĨĪĬĮİ", "i": "ìíîïĩīĭįı", "N": "ÑŃŅŇŊ", "n": "ñńņňŋ",
    "O": "ÒÓÔÕÖŌŎŐǪØ", "o": "òóôõöōŏőǫø", "R": "ŔŖŘ", "r": "ŕŗř", "S": "ŚŜŞ", "s": "śŝş", "T": "Þ", "t": "þ",
    "U": "ÙÚÛÜŨŪŬŮŰŲǛ", "u": "ùúûüũūŭůűųǜ", "Y": "ÝŶŸ", "y": "ýÿŷ", "Z": "ŹŻŽ", "z": "źżž",
}
ACCENTS_FROM = "".join(ACCENTED.values())
ACCENTS_TO = "".join(k * len(v) for k, v in ACCENTED.items())

#: combining marks that join a grapheme; those that stay with their base in truncation and are stripped with marks
GRAPHEME_MARKS = "̀-ͯ᪰-᫿᷀-᷿⃐-⃿"
MARKS = GRAPHEME_MARKS + "︀-️‍‌﻿"
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def to_upper(s: Column) -> Column:
    return F.translate(s, UPPER_FROM, UPPER_TO)


def to_lower(s: Column) -> Column:
    return F.translate(s, LOWER_FROM, LOWER_TO)


def strip_marks(s: Column) -> Column:
    return F.regexp_replace(s, f"[{MARKS}]", "")


def remove_diacritics(s: Column) -> Column:
    return F.translate(strip_marks(s), ACCENTS_FROM, ACCENTS_TO)


def count_code_points(s: Column) -> Column:
    return F.char_length(s).cast("bigint")


def count_words(s: Column) -> Column:
    return F.regexp_count(s, F.lit(f"[^{SPACES}]+")).cast("bigint")


def split_lines(s: Column) -> Column:
    return F.split(s, "\r\n|\n|\r", -1)


def is_whitespace(s: Column) -> Column:
    """True also for an empty text."""
    return s.rlike(f"^[{SPACES}]*\\z")


def trim_whitespace(s: Column) -> Column:
    return F.regexp_replace(s, f"^[{SPACES}]+|[{SPACES}]+\\z", "")


def title_case(s: Column) -> Column:
    parts = F.regexp_extract_all(s, F.lit(f"[^{SPACES}]+|[{SPACES}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.concat(to_upper(F.substring(w, 1, 1)), to_lower(w.substr(F.lit(2), F.length(w))))), "")


def truncate(s: Column, n: int, ellipsis: str = "...") -> Column:
    """At most n code points and the ellipsis; a base and its marks are never parted."""
    if n == 0:
        return F.when(s.isNotNull(), F.lit(ellipsis))
    head = F.regexp_replace(F.substring(s, 1, n + 1), f"(?s)(?:[^{MARKS}][{MARKS}]*|[{MARKS}]+)\\z", "")
    return F.when(F.char_length(s) <= n, s).otherwise(F.concat(head, F.lit(ellipsis)))


def grapheme_clusters(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(f"(?s).[{GRAPHEME_MARKS}]*"), F.lit(0))


def valid_language_tag(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z0-9]{1,8}(-[A-Za-z0-9]{1,8})*\z")


def tokens(s: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(s, F.lit("[A-Za-z0-9_]+"), F.lit(0)))


def token_overlap(a: Column, b: Column) -> Column:
    """Share of a's tokens that b has; 1 if neither has any, 0 if one has none."""
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))


#: fixed values: numerals of hundreds, tens and ones; thousands repeat M
NUMERALS = (["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"], ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"])


def roman(n: Column) -> Column:
    digits = [F.element_at(F.array(*map(F.lit, names)), (F.floor(n / place) % 10 + 1).cast("int")) for names, place in zip(NUMERALS, (100, 10, 1), strict=True)]
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), *digits)


def alphabetic(n: Column, most: int = 7) -> Column:
    """Bijective base 26: 1 is A, 27 is AA."""
    state = F.struct(n.cast("bigint").alias("rest"), F.lit("").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        last = acc["rest"] - 1
        more = acc["rest"] > 0
        return F.struct(F.when(more, F.floor(last / 26)).otherwise(F.lit(0)).cast("bigint").alias("rest"), F.when(more, F.concat(F.char(F.lit(65) + last % 26), acc["out"])).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, step, lambda acc: acc["out"])


def number_label(style: str, n: Column) -> Column:
    """style: bullet, decimal, lower_alpha, upper_alpha, lower_roman or upper_roman."""
    if style == "bullet":
        return F.lit("•")
    body = {"decimal": lambda: n.cast("string"), "upper_alpha": lambda: alphabetic(n), "lower_alpha": lambda: F.lower(alphabetic(n)), "upper_roman": lambda: roman(n), "lower_roman": lambda: F.lower(roman(n))}[style]()
    return F.concat(body, F.lit("."))


def parse_mcid(s: Column) -> Column:
    """The number after /MCID, null without one or beyond 32 bits."""
    return F.regexp_extract(s, r"/MCID\s*(\d+)", 1).try_cast("int")


def escape_name(s: Column) -> Column:
    """A PDF name: bytes 33 to 126 other than delimiters and # as they are, the rest as #XX."""
    pairs = F.regexp_extract_all(F.hex(F.encode(s, "UTF-8")), F.lit("(..)"), F.lit(1))
    regular = lambda p: (p >= "21") & (p <= "7E") & ~p.isin("23", "25", "28", "29", "2F", "3C", "3E", "5B", "5D", "7B", "7D")
    return F.concat(F.lit("/"), F.array_join(F.transform(pairs, lambda p: F.when(regular(p), F.decode(F.unhex(p), "UTF-8")).otherwise(F.concat(F.lit("#"), p))), ""))


def escape_literal(s: Column) -> Column:
    """A PDF literal string: backslash and parentheses escaped, control letters named, other bytes outside 32 to 126 in octal."""
    pairs = F.regexp_extract_all(F.hex(F.encode(s, "UTF-8")), F.lit("(..)"), F.lit(1))
    named = {"5C": "\\\\", "28": "\\(", "29": "\\)", "0A": "\\n", "0D": "\\r", "09": "\\t", "08": "\\b", "0C": "\\f"}

    def one(p: Column) -> Column:
        out = F.when(p == "5C", named["5C"])
        for k, v in list(named.items())[1:]:
            out = out.when(p == k, v)
        octal = F.lpad(F.conv(p, 16, 8), 3, "0")
        return out.when((p < "20") | (p > "7E"), F.concat(F.lit("\\"), octal)).otherwise(F.decode(F.unhex(p), "UTF-8"))

    return F.concat(F.lit("("), F.array_join(F.transform(pairs, one), ""), F.lit(")"))


def string_or_name(kind: Column, value: Column) -> Column:
    """A dictionary's entry if it is a string or a name, else empty."""
    return F.when(kind.isin("string", "name"), F.coalesce(value, F.lit(""))).otherwise(F.lit(""))
