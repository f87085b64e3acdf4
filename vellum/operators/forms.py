"""Form fields: hierarchy, flags, options, values, calculation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.plans.scratch import materialize

#: fixed values: one-based bits of the field flags; some bits mean different things for different types
FLAGS = {"read_only": (1, None), "required": (2, None), "no_export": (3, None), "multiline": (13, "Tx"), "password": (14, "Tx"), "no_toggle_to_off": (15, "Btn"), "radio": (16, "Btn"), "push_button": (17, "Btn"), "combo": (18, "Ch"), "edit": (19, "Ch"), "sort": (20, "Ch"), "file_select": (21, "Tx"), "multi_select": (22, "Ch"), "do_not_spell_check": (23, None), "do_not_scroll": (24, "Tx"), "comb": (25, "Tx"), "radios_in_unison": (26, "Btn"), "rich_text": (26, "Tx"), "commit_on_change": (27, "Ch")}


def flag(flags: Column, kind: Column, name: str) -> Column:
    bit, only = FLAGS[name]
    on = flags.bitwiseAND(F.lit(1 << (bit - 1))) != 0
    return on if only is None else on & (kind == only)


def checked(value: Column) -> Column:
    """Whether a value means a checked box."""
    return F.coalesce(F.lower(value).isin("true", "1", "yes", "on", "checked"), F.lit(False))


def hierarchy(nodes: DataFrame, depth: int = 32) -> DataFrame:
    """nodes: doc_id, num, parent, partial, ft, ff, v. Terminal or typed nodes with a name: full dotted name; type, flags and value as inherited.

    Levels are joined from the roots down, all of a level at once, until no node is left; ``depth`` guards against cycles.
    """
    own = nodes.select("doc_id", "num", "parent", "partial", "ft", "ff", "v")
    level = own.where("parent is null").withColumn("name", F.coalesce("partial", F.lit("")))
    out = level
    for _ in range(depth):
        up = level.select("doc_id", F.col("num").alias("parent"), F.col("name").alias("_n"), F.col("ft").alias("_t"), F.col("ff").alias("_f"), F.col("v").alias("_v"))
        level = own.join(up, ["doc_id", "parent"])
        part = F.coalesce("partial", F.lit(""))
        name = F.when(part == "", F.col("_n")).when(F.col("_n") == "", part).otherwise(F.concat_ws(".", "_n", part))
        level = materialize(level.select("doc_id", "num", "parent", "partial", F.coalesce("ft", "_t").alias("ft"), F.coalesce("ff", "_f").alias("ff"), F.coalesce("v", "_v").alias("v"), name.alias("name")), "fields")
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    else:
        raise ValueError("a field tree deeper than the limit, or a cycle")
    inner = own.where("parent is not null").select("doc_id", F.col("parent").alias("num"), F.lit(True).alias("_inner")).distinct()
    return out.join(inner, ["doc_id", "num"], "left").where("name <> '' and (_inner is null or ft is not null)").drop("_inner")


def option_labels(options: Column) -> Column:
    """Options as arrays: one string, or export value and display text; the display text."""
    return F.transform(options, lambda o: F.when(F.size(o) > 1, o[1]).otherwise(o[0]))


def set_values(fields: DataFrame, updates: DataFrame, skip_read_only: bool = True) -> DataFrame:
    """updates: doc_id, name, value. Adds status: set, unchanged, read_only or rejected (push buttons, signatures)."""
    joined = fields.join(updates.withColumnRenamed("value", "_new"), ["doc_id", "name"], "left")
    kind = F.col("ft")
    status = F.when(F.col("_new").isNull(), "unchanged").when(F.coalesce(flag(F.col("ff"), kind, "push_button"), F.lit(False)) | F.coalesce(kind == "Sig", F.lit(False)), "rejected").when(F.coalesce(flag(F.col("ff"), kind, "read_only"), F.lit(False)), "read_only").otherwise("set")
    out = joined.withColumn("status", status)
    if not skip_read_only:
        out = out.where(F.assert_true(~F.col("status").isin("read_only", "rejected"), F.lit("a field cannot be set")).isNull())
    return out.withColumn("v", F.when(F.col("status") == "set", F.col("_new")).otherwise(F.col("v"))).drop("_new")


def page_of_field(fields: DataFrame, widgets: DataFrame) -> DataFrame:
    """widgets: doc_id, num, ordinal, page_index; the first widget with a page gives the field's page."""
    first = widgets.where("page_index is not null").groupBy("doc_id", "num").agg(F.min_by("page_index", "ordinal").alias("page_index"))
    return fields.join(first, ["doc_id", "num"], "left")


class Formula:
    """Sums, products, signs and parentheses over numbers and field names; division by zero gives None."""

    def __init__(self, text: str):
        import re

        self.tokens = re.findall(r"\d+\.?\d*|\.\d+|[A-Za-z_][\w.]*|[-+*/()]|\S", text)
        self.at = 0

    def value(self, fields: dict[str, float]) -> float | None:
        self.at, self.fields = 0, fields
        try:
            out = self.sum()
        except (ValueError, ZeroDivisionError):
            return None
        return out if self.at == len(self.tokens) else None

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def sum(self) -> float:
        out = self.product()
        while self.peek() in ("+", "-"):
            out = out + self.product() if self.take() == "+" else out - self.product()
        return out

    def product(self) -> float:
        out = self.factor()
        while self.peek() in ("*", "/"):
            out = out * self.factor() if self.take() == "*" else out / self.factor()
        return out

    def factor(self) -> float:
        t = self.peek()
        if t in ("+", "-"):
            self.take()
            return self.factor() * (-1 if t == "-" else 1)
        if t == "(":
            self.take()
            out = self.sum()
            if self.peek() != ")":
                raise ValueError("parenthesis")
            self.take()
            return out
        if not t or t in "*/)":
            raise ValueError("operand")
        self.take()
        if t[0].isdigit() or t[0] == ".":
            return float(t)
        if not (t[0].isalpha() or t[0] == "_"):
            raise ValueError(t)
        return self.fields.get(t, 0.0)


def calculate(fields: DataFrame) -> DataFrame:
    """fields: doc_id, ordinal, name, value, script. Scripts (``name = expression``) run in field order, later ones seeing earlier
    results; a result goes to the script's own field. Adds calculated; scripts that cannot be evaluated change nothing."""

    def number(x: str | None) -> float:
        try:
            return float(x) if x is not None else 0.0
        except ValueError:
            return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc in batch.column("f").to_pylist():
                known = {f["name"]: number(f["value"]) for f in doc}
                rows = []
                for f in doc:
                    result = Formula(f["script"].partition("=")[2]).value(known) if f["script"] and "=" in f["script"] else None
                    if result is not None:
                        known[f["name"]] = result
                        text = str(int(result)) if result == int(result) else repr(result)
                    rows.append({**f, "value": f["value"] if result is None else text, "calculated": result is not None})
                out.append(rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.struct([("ordinal", pa.int64()), ("name", pa.string()), ("value", pa.string()), ("script", pa.string()), ("calculated", pa.bool_())])))], names=["doc_id", "f"])

    kind = fields.schema["doc_id"].dataType.simpleString()
    whole = fields.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ordinal").cast("bigint").alias("ordinal"), "name", "value", "script"))).alias("f"))
    done = whole.mapInArrow(run, f"doc_id {kind}, f array<struct<ordinal:bigint,name:string,value:string,script:string,calculated:boolean>>")
    return done.select("doc_id", F.explode("f").alias("x")).select("doc_id", "x.*")
