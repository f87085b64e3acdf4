"""Highlight and redaction rectangles, annotation edits, revisions and stream deduplication as tables of edits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import geometry
from vellum.plans.scratch import materialize


def padded(box: Column, sides: float, ends: float) -> Column:
    """sides: left and right; ends: bottom and top."""
    return geometry.rect(box["l"] - sides, box["b"] - ends, box["r"] + sides, box["t"] + ends)


def highlights(found: DataFrame, padding: float = 1.0) -> DataFrame:
    """Highlight annotations of matches, padded at bottom and top."""
    return found.select("doc_id", "page_index", "match_no", F.lit("Highlight").alias("subtype"), padded(F.col("bbox"), 0.0, padding).alias("rect"), F.col("matched").alias("contents"))


def redactions(found: DataFrame, regions: DataFrame | None = None, padding: float = 1.0) -> DataFrame:
    """Rectangles to cover: matches padded on all sides, and regions (doc_id, page_index, rect) as given."""
    out = found.select("doc_id", "page_index", padded(F.col("bbox"), padding, padding).alias("rect"))
    return out if regions is None else out.unionByName(regions.select("doc_id", "page_index", "rect"))


def redaction_counts(rects: DataFrame) -> DataFrame:
    """doc_id, redactions, pages touched."""
    return rects.groupBy("doc_id").agg(F.count(F.lit(1)).alias("redactions"), F.countDistinct("page_index").alias("pages"))


def mask_text(docs: DataFrame, pattern: str, text: str = "text", mark: str = "█") -> DataFrame:
    """Extension: texts with each match of a pattern covered, a mark a character."""
    parts = F.split(F.col(text), pattern, -1)
    found = F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(1))
    masked = F.concat(F.array_join(F.zip_with(parts, F.transform(found, lambda m: F.repeat(F.lit(mark), F.length(m))), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), ""))
    return docs.withColumn(text, masked)


def remove_annotations(annotations: DataFrame, subtypes: list[str] | None = None) -> DataFrame:
    """What is left after removal; no filter removes all. A leading slash in a filter may be left out."""
    if not subtypes:
        return annotations.limit(0)
    return annotations.where(~F.coalesce(F.regexp_replace("subtype", "^/", ""), F.lit("")).isin([s.lstrip("/") for s in subtypes]))


def update_annotations(annotations: DataFrame, subtype: str, contents: str, title: str = "") -> DataFrame:
    """New contents for a subtype's annotations; the title changes only if one is given. changed tells which."""
    mine = F.regexp_replace("subtype", "^/", "") == subtype.lstrip("/")
    out = annotations.withColumn("changed", F.coalesce(mine, F.lit(False)))
    out = out.withColumn("contents", F.when(F.col("changed"), F.lit(contents)).otherwise(F.col("contents")))
    return out.withColumn("title", F.when(F.col("changed") & F.lit(bool(title)), F.lit(title)).otherwise(F.col("title")))


def reply_threads(annotations: DataFrame) -> DataFrame:
    """annotations: doc_id, page_index, ordinal (from 1), in_reply_to (null or an ordinal). Adds the parent's contents."""
    parent = annotations.select("doc_id", "page_index", F.col("ordinal").alias("in_reply_to"), F.col("contents").alias("parent_contents"))
    return annotations.join(parent, ["doc_id", "page_index", "in_reply_to"], "left")


def deduplicate_streams(objects: DataFrame, body: str, number: str, is_stream: Column | None = None) -> DataFrame:
    """keep: the lowest number of the streams with one body; objects that are no streams keep their own. Bodies meet by SHA-256,
    so they are not shuffled."""
    digest = F.sha2(F.col(body), 256)
    stream = F.lit(True) if is_stream is None else is_stream
    lead = objects.where(stream).groupBy(digest.alias("_d")).agg(F.min(number).alias("_keep"))
    out = objects.withColumn("_d", F.when(stream, digest)).join(lead, "_d", "left")
    return out.withColumn("keep", F.coalesce("_keep", number)).drop("_d", "_keep")


def latest(revisions: DataFrame, keys: list[str], revision: list[str]) -> DataFrame:
    """The last revision of each key: an upsert by append."""
    order = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in revision))
    return revisions.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def first_seen(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Cross-reference merge: of each key the entry met first, newest section first; entries marked free count."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return entries.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: rounds that reachable() keeps apart before it writes them as one, so plans stay small on long chains
ROUNDS = 16


def reachable(roots: DataFrame, references: DataFrame) -> DataFrame:
    """Object numbers reachable from the roots (doc_id, num) over references (doc_id, num, target).

    Where nothing refers to two things, references are chains: a round takes what lies twice as far, and a chain of n objects takes
    log(n) rounds. Otherwise breadth first, a round a level. Both go on until a round meets nothing new, so cycles end."""
    references = materialize(references.select("doc_id", "num", "target").distinct(), "references")
    seen = roots.select("doc_id", "num").distinct()
    if references.groupBy("doc_id", "num").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        return _breadth_first(seen, references)
    seen, jump = materialize(seen, "reach"), references
    while True:
        far = seen.join(jump, ["doc_id", "num"]).select("doc_id", F.col("target").alias("num")).distinct()
        new = materialize(far.join(seen, ["doc_id", "num"], "left_anti"), "reach")
        if not new.limit(1).count():
            return seen
        seen = materialize(seen.union(new), "reach")
        further = jump.select("doc_id", F.col("num").alias("target"), F.col("target").alias("end"))
        jump = materialize(jump.join(further, ["doc_id", "target"]).select("doc_id", "num", F.col("end").alias("target")), "references")


def _breadth_first(frontier: DataFrame, references: DataFrame) -> DataFrame:
    frontier = materialize(frontier, "reach")
    rounds = [frontier]
    while True:
        step = frontier.join(references, ["doc_id", "num"]).select("doc_id", F.col("target").alias("num")).distinct()
        seen = reduce(DataFrame.union, rounds)
        frontier = materialize(step.join(seen, ["doc_id", "num"], "left_anti"), "reach")
        if not frontier.limit(1).count():
            return seen
        rounds.append(frontier)
        if len(rounds) > ROUNDS:
            rounds = [materialize(reduce(DataFrame.union, rounds), "reach")]


def renumber(objects: DataFrame) -> DataFrame:
    """Dense numbers from 1 within a document, in the order of the old ones."""
    return objects.withColumn("new_num", F.row_number().over(Window.partitionBy("doc_id").orderBy("num")))
