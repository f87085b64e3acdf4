"""Flowing text: paragraphs to lines, columns and pages, nested lists with numbers, tables with repeated headers.

Paragraphs are wrapped within a document's row and lists are numbered by windows over a document, so only tables meet in a shuffle, for the
widths of their columns. All measures are in characters and lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.strings import number_label

STYLES = ("decimal", "lower_alpha", "lower_roman", "upper_alpha", "upper_roman", "bullet")


def wrapped(paragraph: Column, width: int) -> Column:
    """A paragraph's lines: as many words (by blanks) as fit, at least one."""
    words = F.filter(F.split(paragraph, " ", -1), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, w: Column) -> Column:
        fits = F.length(s["now"]) + 1 + F.length(w) <= width
        return F.when(s["now"] == "", F.struct(s["done"].alias("done"), w.alias("now"))).when(fits, F.struct(s["done"].alias("done"), F.concat(s["now"], F.lit(" "), w).alias("now"))).otherwise(F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), w.alias("now")))

    return F.aggregate(words, start, step, lambda s: F.concat(s["done"], F.array(s["now"])))


def flow_paragraphs(docs: DataFrame, width: int = 60, lines: int = 50, columns: int = 1) -> DataFrame:
    """docs: doc_id, text (a paragraph a line). doc_id, line_no, page_index, column, row, text. Without a shuffle."""
    flowed = docs.select("doc_id", F.posexplode(F.flatten(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda p: wrapped(p, width)))).alias("line_no", "text"))
    n = F.col("line_no")
    return flowed.select("doc_id", "line_no", F.floor(n / (lines * columns)).cast("int").alias("page_index"), (F.floor(n / lines) % columns).cast("int").alias("column"), (n % lines).alias("row"), "text")


def headers_and_footers(pages: DataFrame, header: Column, footer: str = "page {} of {}") -> DataFrame:
    """pages: doc_id, page_index. Adds header and footer, the footer with the page's number and how many there are."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    before, middle, after = footer.split("{}")
    return pages.withColumn("header", header).withColumn("footer", F.concat(F.lit(before), (F.col("page_index") + 1).cast("string"), F.lit(middle), n.cast("string"), F.lit(after)))


def number_items(items: DataFrame, depth: int = len(STYLES)) -> DataFrame:
    """items: doc_id, seq, level (from 0). Adds number, counted anew after an item of a lower level, and its label in the level's style."""
    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    # for each level the last item below it so far; an item's own level picks the one that counts
    above = F.array(*(F.coalesce(F.max(F.when(F.col("level") < k, F.col("seq"))).over(order), F.lit(-1)) for k in range(depth)))
    marked = items.withColumn("_list", F.element_at(above, (F.col("level") + 1).cast("int")))
    out = marked.withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "level", "_list").orderBy("seq"))).drop("_list")
    label = F.lit(None).cast("string")
    for k, style in enumerate(STYLES):
        label = F.when(F.col("level") == k, number_label(style, F.col("number"))).otherwise(label)
    return out.withColumn("label", label)


def flow_table(cells: DataFrame, header: list[str], rows: int = 40) -> DataFrame:
    """cells: doc_id, row, and a column of text for each of header. doc_id, page_index, line (0 is the header, on each page), text: cells
    filled up to the widest of their column, parted by " | "."""
    wide = cells.groupBy("doc_id").agg(*(F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(f"_w{k}") for k, c in enumerate(header)))
    numbered = cells.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("row")) - 1)
    body = numbered.select("doc_id", F.floor(F.col("_n") / rows).cast("int").alias("page_index"), (F.col("_n") % rows + 1).alias("line"), *header)
    heads = body.where("line = 1").select("doc_id", "page_index", F.lit(0).alias("line"), *(F.lit(c).alias(c) for c in header))
    full = body.unionByName(heads).join(wide, "doc_id")
    text = F.rtrim(F.concat_ws(" | ", *(F.rpad(F.coalesce(F.col(c), F.lit("")), F.col(f"_w{k}"), F.lit(" ")) for k, c in enumerate(header))))
    return full.select("doc_id", "page_index", "line", text.alias("text"))
