"""Reordering, removing, extracting, splitting, copying and merging pages, as index arithmetic and joins.

Pages are rows (doc_id, page_index, ...). Results carry new_index, dense from 0, and keep page_index as the page's origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _dense(df: DataFrame, *order: str | Column) -> DataFrame:
    return df.withColumn("new_index", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1)


def reorder(pages: DataFrame, order: DataFrame) -> DataFrame:
    """order: doc_id, ordinal, page_index; it must list every page of a document once, or the query fails."""
    size = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    listed = order.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_m"), F.countDistinct("page_index").alias("_d"), F.min("page_index").alias("_a"), F.max("page_index").alias("_b"))
    right = (F.col("_m") == F.col("_n")) & (F.col("_d") == F.col("_n")) & (F.col("_a") == 0) & (F.col("_b") == F.col("_n") - 1)
    checked = size.join(listed, "doc_id").where(F.coalesce(F.assert_true(right, F.lit("not a permutation of the pages")).isNull(), F.lit(True))).select("doc_id")
    return _dense(pages.join(order, ["doc_id", "page_index"]).join(checked, "doc_id", "left_semi"), "ordinal").drop("ordinal")


def move(pages: DataFrame, start: int, to: int) -> DataFrame:
    """Take page start out and put it in at to; documents too short for either are left as they are."""
    i, n = F.col("page_index"), F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    down = F.when(i == start, to).when((i > start) & (i <= to), i - 1).otherwise(i)
    up = F.when(i == start, to).when((i >= to) & (i < start), i + 1).otherwise(i)
    return pages.withColumn("_n", n).withColumn("new_index", F.when(F.col("_n") > max(start, to), down if start <= to else up).otherwise(i).cast("int")).drop("_n")


def remove(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """gone: doc_id, page_index; repeated requests count once. A document may not lose all its pages: it then keeps them."""
    left = pages.join(gone.distinct(), ["doc_id", "page_index"], "left_anti")
    none_left = pages.join(left.select("doc_id").distinct(), "doc_id", "left_anti")
    return _dense(left.unionByName(none_left), "page_index")


def extract(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: doc_id, ordinal, page_index; the given order is kept."""
    return _dense(pages.join(wanted, ["doc_id", "page_index"]), "ordinal").drop("ordinal")


def extract_range(pages: DataFrame, first: int, count: int) -> DataFrame:
    if count <= 0:
        raise ValueError("an empty range")
    return _dense(pages.where((F.col("page_index") >= first) & (F.col("page_index") < first + count)), "page_index")


def split_every(pages: DataFrame, n: int) -> DataFrame:
    """part (from 1) and new_index within the part."""
    return pages.withColumn("part", F.floor(F.col("page_index") / n).cast("int") + 1).withColumn("new_index", (F.col("page_index") % n).cast("int"))


def duplicate(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: doc_id, ordinal, page_index; copies come after the last page, in the order asked for."""
    own = pages.withColumn("_copy", F.lit(0)).withColumn("ordinal", F.col("page_index"))
    copies = pages.join(wanted, ["doc_id", "page_index"]).withColumn("_copy", F.lit(1))
    return _dense(own.unionByName(copies), "_copy", "ordinal").drop("_copy", "ordinal")


def merge(pages: DataFrame, target: Column) -> DataFrame:
    """Documents of one target become one, in the order of their ids: target, new_index, doc_id, page_index. Documents are counted
    first and only their counts are put in order, so a target of many pages is no one task's work (pages are 0 to n - 1)."""
    keyed = pages.withColumn("target", target)
    counts = keyed.groupBy("target", "doc_id").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("target").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    return keyed.join(counts.select("target", "doc_id", before.alias("_before")), ["target", "doc_id"]).withColumn("new_index", (F.col("_before") + F.col("page_index")).cast("int")).drop("_before")


def rename_conflicts(fields: DataFrame) -> DataFrame:
    """fields: target, source (from 1), name. A name that an earlier source has gets the prefix Source<k>., and a number from 2 if that is taken too."""
    seen = F.row_number().over(Window.partitionBy("target", "name").orderBy("source", "ordinal"))
    again = F.row_number().over(Window.partitionBy("target", "name", "source").orderBy("ordinal"))
    ranked = fields.withColumn("_seen", seen).withColumn("_again", again).withColumn("_first", F.min("source").over(Window.partitionBy("target", "name")))
    number = F.when(F.col("_first") == F.col("source"), F.col("_again") - 1).otherwise(F.col("_again"))
    prefixed = F.concat(F.lit("Source"), F.col("source").cast("string"), F.lit("."), F.col("name"))
    return ranked.withColumn("new_name", F.when(F.col("_seen") == 1, F.col("name")).when(number <= 1, prefixed).otherwise(F.concat(prefixed, F.lit("."), number.cast("string")))).drop("_seen", "_again", "_first")


def set_rotation(pages: DataFrame, rotation: Column) -> DataFrame:
    """Rotations are multiples of 90, stored between 0 and 270."""
    return pages.withColumn("rotation", F.when(F.assert_true(rotation % 90 == 0, F.lit("a rotation is a multiple of 90")).isNull(), F.pmod(rotation, F.lit(360))))


def set_box(pages: DataFrame, which: str, box: Column) -> DataFrame:
    return pages.withColumn(which, F.coalesce(box, F.col(which)))


def apply_edits(edits: DataFrame) -> DataFrame:
    """edits: doc_id, page_index, request, content, rotation. One row a page: contents in order, the last rotation given (of one request the largest)."""
    last = F.max(F.when(F.col("rotation").isNotNull(), F.struct("request", "rotation")))["rotation"]
    return edits.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("request", "content"))).alias("_c"), last.alias("rotation")).select("doc_id", "page_index", F.array_join(F.transform("_c", lambda x: x["content"]), "\n").alias("content"), "rotation")


def labels(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """As-of lookup: each page's label from the range (doc_id, first_page, style, prefix, start_number) that starts last at or before it.
    Pages and ranges run in one order by document; the last range met is the page's."""
    from vellum.functions.strings import alphabetic, roman

    rows = pages.select("doc_id", "page_index", F.lit(1).alias("_page"), F.lit(None).cast("struct<first_page:int,style:string,prefix:string,start_number:int>").alias("r"))
    heads = ranges.select("doc_id", F.col("first_page").cast("int").alias("page_index"), F.lit(0).alias("_page"), F.struct(F.col("first_page").cast("int").alias("first_page"), "style", "prefix", F.col("start_number").cast("int").alias("start_number")).alias("r"))
    order = Window.partitionBy("doc_id").orderBy("page_index", "_page").rowsBetween(Window.unboundedPreceding, 0)
    best = rows.unionByName(heads).withColumn("r", F.last("r", ignorenulls=True).over(order)).where("_page = 1 and r is not null")
    n = F.col("page_index") - F.col("r.first_page") + F.col("r.start_number")
    body = F.when(F.col("r.style") == "D", n.cast("string")).when(F.col("r.style") == "R", roman(n)).when(F.col("r.style") == "r", F.lower(roman(n))).when(F.col("r.style") == "A", alphabetic(n)).when(F.col("r.style") == "a", F.lower(alphabetic(n))).otherwise("")
    return best.select("doc_id", "page_index", F.concat(F.coalesce("r.prefix", F.lit("")), body).alias("label"))
