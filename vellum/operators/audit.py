"""Conformance audits as queries: every rule is a DataFrame of issues; reports count, cut and serialize them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ISSUE = ("doc_id", "code", "severity", "message", "location")


def issues(rows: DataFrame, code: str, severity: str, message: str, location: Column | None = None) -> DataFrame:
    """Offending rows of a rule as issues."""
    return rows.select("doc_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), (F.lit("") if location is None else location.cast("string")).alias("location"))


def all_issues(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def counts(found: DataFrame) -> DataFrame:
    """doc_id, errors, warnings, infos, valid."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return found.groupBy("doc_id").agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos")).withColumn("valid", F.col("errors") == 0)


def first_issues(found: DataFrame, most: int) -> DataFrame:
    """At most so many issues a document, by code and location."""
    order = Window.partitionBy("doc_id").orderBy("code", "location")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def report_json(found: DataFrame) -> DataFrame:
    """One JSON text a document, issues in the order of code and location."""
    rows = F.array_sort(F.collect_list(F.struct("code", "location", "message", "severity")))
    return found.groupBy("doc_id").agg(rows.alias("r")).select("doc_id", F.to_json(F.struct(F.col("doc_id"), F.size("r").alias("count"), F.col("r").alias("issues"))).alias("report"))


def report_text(found: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("code", "location", "severity", "message")))
    line = lambda x: F.concat(F.lit("["), x["severity"], F.lit("] "), x["code"], F.lit(" "), x["location"], F.lit(": "), x["message"])
    return found.groupBy("doc_id").agg(rows.alias("r")).select("doc_id", F.array_join(F.transform("r", line), "\n").alias("report"))


def heading_skips(headings: DataFrame) -> DataFrame:
    """headings: doc_id, seq, level. Where a heading is more than one level below the one before it, or a document does not begin with 1."""
    before = F.coalesce(F.lag("level").over(Window.partitionBy("doc_id").orderBy("seq")), F.lit(0))
    return headings.withColumn("before", before).where(F.col("level") > F.col("before") + 1)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left without a partner: one side of a set difference."""
    return left.join(right, keys, "left_anti")


def both_differences(page: DataFrame, tree: DataFrame, keys: list[str]) -> DataFrame:
    """Marks that only the pages have and marks that only the tree has."""
    return missing(page, tree, keys).select(*keys, F.lit("not in tree").alias("problem")).unionByName(missing(tree, page, keys).select(*keys, F.lit("not on page").alias("problem")))


def not_increasing(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value does not pass the one before it."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(order))
    return rows.withColumn("before", before).where(F.col(value) <= F.col("before"))


def role_cycles(roles: DataFrame, depth: int = 32) -> DataFrame:
    """roles: doc_id, role, target. Roles from which the map does not end within depth steps."""
    step = roles.select("doc_id", "role", F.col("target").alias("at"))
    for _ in range(depth.bit_length()):
        again = step.select("doc_id", F.col("role").alias("at"), F.col("at").alias("next"))
        step = step.join(again, ["doc_id", "at"], "left").select("doc_id", "role", F.coalesce("next", F.lit(None).cast("string")).alias("at")).where("at is not null")
    return step.select("doc_id", "role").distinct()


def regression_gate(baseline: DataFrame, timings: DataFrame, slack: float = 1.10) -> DataFrame:
    """baseline: workload, base; timings: workload, seconds. Workloads that are missing or whose median is over the slack."""
    got = timings.groupBy("workload").agg(F.percentile("seconds", 0.5).alias("median"))
    return baseline.join(got, "workload", "left").where(F.col("median").isNull() | (F.col("median") > F.col("base") * slack))
