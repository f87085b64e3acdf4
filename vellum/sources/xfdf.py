"""Annotations as XFDF text and back, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: the annotation types that have an element
SUBTYPES = ("Text", "Link", "FreeText", "Line", "Square", "Circle", "Polygon", "PolyLine", "Highlight", "Underline", "Squiggly", "StrikeOut", "Stamp", "Ink")


def escaped(s: Column) -> Column:
    out = F.coalesce(s, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def plain(s: Column) -> Column:
    for a, b in (("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def export_xfdf(annotations: DataFrame) -> DataFrame:
    """annotations: doc_id, page_index, ordinal, subtype, rect, contents, title. doc_id, xfdf, exported; other subtypes are left out."""
    mine = annotations.where(F.col("subtype").isin(*SUBTYPES))
    rect = F.concat_ws(",", *(F.col("rect")[k].cast("string") for k in "lbrt"))
    element = F.concat(F.lit("<"), F.lower("subtype"), F.lit(' page="'), F.col("page_index").cast("string"), F.lit('" rect="'), rect, F.lit('" title="'), escaped(F.col("title")), F.lit('"><contents>'), escaped(F.col("contents")), F.lit("</contents></"), F.lower("subtype"), F.lit(">"))
    rows = F.array_sort(F.collect_list(F.struct("page_index", "ordinal", element.alias("e"))))
    head, tail = '<?xml version="1.0" encoding="UTF-8"?>\n<xfdf xmlns="http://ns.adobe.com/xfdf/"><annots>\n', "\n</annots></xfdf>"
    return mine.groupBy("doc_id").agg(rows.alias("r")).select("doc_id", F.concat(F.lit(head), F.array_join(F.transform("r", lambda x: x["e"]), "\n"), F.lit(tail)).alias("xfdf"), F.size("r").alias("exported"))


def import_xfdf(texts: DataFrame) -> DataFrame:
    """texts: doc_id, xfdf. doc_id, ordinal, subtype, page_index, rect, title, contents; each element has the contents inside it."""
    names = "|".join(s.lower() for s in SUBTYPES)
    elements = F.regexp_extract_all("xfdf", F.lit(rf"(?s)(<(?:{names})\s[^>]*>.*?</(?:{names})>)"), F.lit(1))
    rows = texts.select("doc_id", F.posexplode(elements).alias("ordinal", "e"))
    attribute = lambda k: F.regexp_extract("e", rf'\s{k}="([^"]*)"', 1)
    name = F.regexp_extract("e", r"^<(\w+)", 1)
    kind = F.element_at(F.create_map(*(x for s in SUBTYPES for x in (F.lit(s.lower()), F.lit(s)))), name)
    corner = F.split(attribute("rect"), ",")
    box = F.struct(*(corner[k].try_cast("double").alias(c) for k, c in enumerate("lbrt")))
    return rows.select("doc_id", "ordinal", kind.alias("subtype"), attribute("page").try_cast("int").alias("page_index"), box.alias("rect"), plain(attribute("title")).alias("title"), plain(F.regexp_extract("e", r"(?s)<contents>(.*?)</contents>", 1)).alias("contents")).where("rect.l < rect.r and rect.b < rect.t")
