"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and ``cap`` that give every source its target of words, entropy balancing takes those closest to 1
in the sense of relative entropy, counted in words, and lets the second column (language) move little from the words it
has in the corpus: a quadratic penalty of strength ``hold`` on each language's relative change. The dual is convex, with a multiplier
for each source and for each language; a document's rate is min(cap, exp(source's + language's multiplier)), so documents of one
source are tilted against each other by language. The penalty bounds the languages' multipliers, so there always is a
solution, and sources meet their targets whatever languages they have.

Newton iterations find the multipliers. Documents are first summed into cells (source and language, map-side); an iteration moves
only cells, which Spark holds. Given the languages' multipliers each source's follows exactly (its cells in order of their
tilt, the first ones at the cap), which eliminates the sources' block of the joint Hessian; what is left, its Schur
complement, has a row a language. Only that reaches the driver, which solves it (``MOST_SIDES`` languages at most, else an error;
sources may be any number). Rates are then rounded into copies: a document takes the whole part, and the fraction goes to
the first documents of a hash order until the cell's words are reached. The cut is found from hashed bins (sums of at most 4096
bins a cell), then exactly within the one bin where it falls.

Size is the number of words (runs of characters other than space and U+0009-U+000D), 0 for null texts. A source of size 0 has
target 0. Null is a source or language of its own, ordered last. Repeated rows are taken one by one; documents that agree in every
column are interchangeable. Empty tables give no rows. Reruns agree: the order is a hash of id and text, then the row's. Columns may have any names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.tables import as_row, hashable, written

CAP, HOLD = 3, 0.5
MOST_SIDES = 2000
WORDS = r"[^\x20\x09-\x0D]+"


def row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(F.lit(11), *hashable(docs))


def sizes(docs: DataFrame, id_col: str, text_col: str, source: str, side: str | None) -> DataFrame:
    """doc_id, size, g0 (source), g1 (second column), u (60 bits of order), r (hash of the row)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)), 1, 15), 16, 10).cast("bigint")
    g1 = F.col(side) if side in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"), F.col(source).alias("g0"), g1.alias("g1"), order.alias("u"), row_hash(docs).alias("r"))


def numbered(sources: DataFrame) -> DataFrame:
    """The sources (written) with k, their place from 0 by code point, null last; sorted in ranges, only counts of ranges meet in one task."""
    spread = written(sources.repartitionByRange(F.col("g0").asc_nulls_last()).withColumn("p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = spread.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return spread.join(ranges, "p").withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy(F.col("g0").asc_nulls_last())) - 1 + F.col("ahead")).drop("p", "ahead")


def capped_targets(sources: DataFrame, weight: str = "weight", size: str = "size", cap: float = CAP) -> DataFrame:
    """Adds target: the sources share the sum of all sizes by weight, none above cap times its size, the excess reshared by weight
    until none is above. A round fixes the sources whose share is over their cap; two sums a round come back, sources stay where they are."""
    full, share = F.lit(cap) * F.col(size), F.lit(math.inf)
    level, fixed = None, -1
    while True:
        stopped = F.col(size) * 0 != 0 if level is None else full <= share
        x = sources.agg(F.sum(size).alias("all"), F.sum(F.when(stopped, full).otherwise(0)).alias("full"), F.sum(F.when(stopped, 0.0).otherwise(F.col(weight))).alias("weight"), F.sum(stopped.cast("int")).alias("n")).first()
        if x["all"] is None or x["n"] == fixed or not x["weight"]:
            break
        level, fixed = (float(x["all"]) - float(x["full"])) / float(x["weight"]), x["n"]
        share = F.lit(level) * F.col(weight)
    return sources.withColumn("target", F.least(full, share).cast("double"))


def tilted(cells: DataFrame, b: dict, cap: float) -> DataFrame:
    """cells (g0, g1, k1, n, target) with rate and free, the words that still follow the multipliers: b by k1. A source whose target
    is its cap has all its cells there; else its cells are at the cap as far as their tilt takes them, the others share the rest."""
    tilt = F.element_at(F.create_map(*(F.lit(x) for kv in b.items() for x in kv)), F.col("k1")) if b else F.lit(0.0)
    w = cells.withColumn("e", F.exp(tilt))
    own = Window.partitionBy("g0").orderBy(F.col("e").desc(), "k1")
    upto, whole = own.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("g0")
    left = F.col("target") - F.lit(cap) * F.coalesce(F.sum("n").over(upto), F.lit(0))
    mass = F.sum(F.col("n") * F.col("e")).over(own.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    w = w.withColumn("level", F.when(mass > 0, left / mass))
    # the first cell of the order that stays below the cap with the level it leaves decides the level of all
    w = w.withColumn("level", F.max(F.when(F.col("level") * F.col("e") <= cap, F.struct("e", -F.col("k1"), F.col("level").alias("level")))).over(whole)["level"])
    full = (F.col("target") >= F.lit(cap) * F.sum("n").over(whole) * (1 - 1e-12)) | F.col("level").isNull()
    rate = F.when(F.col("target") <= 0, 0.0).when(full, float(cap)).otherwise(F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), F.col("level") * F.col("e"))))
    w = w.withColumn("rate", rate)
    return w.withColumn("free", F.when((F.col("rate") > 0) & (F.col("rate") < cap), F.col("n") * F.col("rate")).otherwise(0.0)).drop("e", "level")


def multipliers(cells: DataFrame, sides: dict[int, float], cap: float = CAP, hold: float = HOLD, tolerance: float = 1e-11, most: int = 60) -> dict[int, float]:
    """The languages' multipliers by Newton's method on the dual. cells: g0, g1, k1, n, target (of the source); sides: the
    words that each k1 should keep."""
    keys = sorted(sides)
    want = np.array([sides[k] for k in keys], float)
    live, b = want > 0, np.zeros(len(keys))
    at = {k: i for i, k in enumerate(keys)}

    def look(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Schur complement at b."""
        w = tilted(cells, dict(zip(keys, b.tolist(), strict=True)), cap)
        # a source's cells side by side give its part of both sums, the languages' own (j = -1) and those of pairs
        x = w.groupBy("g0").agg(F.collect_list(F.struct("k1", "n", "rate", "free")).alias("x"), F.sum("free").alias("all"))
        entry = lambda i, j, m, f: F.struct(i.alias("i"), j.alias("j"), m.alias("m"), f.alias("f"))
        own = F.transform("x", lambda c: entry(c["k1"], F.lit(-1), c["n"] * c["rate"], c["free"]))
        live_cells = F.filter("x", lambda c: c["free"] > 0)
        cross = F.flatten(F.transform(live_cells, lambda c: F.transform(live_cells, lambda d: entry(c["k1"], d["k1"], c["free"] * d["free"] / F.col("all"), F.lit(0.0)))))
        sums = x.select(F.inline(F.concat(own, cross))).groupBy("i", "j").agg(F.sum("m").alias("m"), F.sum("f").alias("f"))
        mass, hess = np.zeros(len(keys)), np.diag(want / hold)
        for r in sums.collect():
            i = at[r["i"]]
            if r["j"] < 0:
                mass[i] = r["m"]
                hess[i, i] += r["f"]
            else:
                hess[i, at[r["j"]]] -= r["m"]
        return mass - want + want * b / hold, hess

    g, h = look(b)
    for _ in range(most):
        if not live.any() or np.abs(g[live] / want[live]).max() <= tolerance:
            break
        step = np.zeros(len(keys))
        step[live] = np.linalg.solve(h[np.ix_(live, live)], g[live])
        scale = 1.0
        while True:
            g2, h2 = look(b - scale * step)
            # at a kink (a cell reaching the cap) a full step may go too far
            if scale < 1e-3 or np.abs(g2[live] / want[live]).max() < np.abs(g[live] / want[live]).max() * (1 - scale / 4):
                break
            scale /= 2
        if np.abs(scale * step).max() < 1e-13:
            break
        b, g, h = b - scale * step, g2, h2
    return dict(zip(keys, np.round(b, 9).tolist(), strict=True))


def balance(sized: DataFrame, targets: DataFrame, cap: float = CAP, hold: float = HOLD) -> DataFrame:
    """sized: from sizes(). targets: a row a source, with g0, target and what else should be kept. Adds rate, copies and the columns of targets."""
    groups = ["g0", "g1"]
    sums = written(sized.groupBy(*groups).agg(F.sum("size").alias("n")), "cells")
    sides = sums.groupBy("g1").agg(F.sum("n").alias("words")).limit(MOST_SIDES + 1).collect()
    if len(sides) > MOST_SIDES:
        raise ValueError(f"the second column has more than {MOST_SIDES} values")
    sides.sort(key=lambda x: (x["g1"] is None, x["g1"]))
    spark = sized.sparkSession
    keyed = spark.createDataFrame([(x["g1"], k) for k, x in enumerate(sides)], f"g1 {sums.schema['g1'].dataType.simpleString()}, k1 int") if sides else sums.select("g1", F.lit(0).alias("k1"))
    cells = sums.join(keyed, sums["g1"].eqNullSafe(keyed["g1"])).drop(keyed["g1"])
    cells = written(cells.join(targets, cells["g0"].eqNullSafe(targets["g0"])).drop(targets["g0"]), "cells")
    b = multipliers(cells, {k: float(x["words"]) for k, x in enumerate(sides)}, cap, hold)
    cells = tilted(cells, b, cap).withColumn("rate", F.round("rate", 9)).withColumnRenamed("n", "cell_size").drop("free", "k1")
    # copies: the whole part for all, one more for the first of the hash order until the cell's words are reached
    whole = F.floor("rate").cast("int")
    cells = cells.withColumn("whole", whole).withColumn("rest", (F.col("rate") - whole) * F.col("cell_size"))
    binned = sized.withColumn("bin", F.shiftrightunsigned("u", 48).cast("int"))
    bins = binned.groupBy(*groups, "bin").agg(F.sum("size").alias("bin_size"))
    bins = bins.withColumn("before", F.sum("bin_size").over(Window.partitionBy(*groups).orderBy("bin")) - F.col("bin_size"))
    plan = bins.join(cells, same(bins, cells, groups)).drop(*(cells[g] for g in groups))
    plan = plan.withColumn("part", F.when(F.col("before") + F.col("bin_size") <= F.col("rest"), "all").when(F.col("before") < F.col("rest"), "some").otherwise("none"))
    plan = written(plan, "bins")
    dealt = binned.join(plan, same(binned, plan, [*groups, "bin"])).drop(*(plan[g] for g in [*groups, "bin"]))
    even = dealt.where("part <> 'some'").withColumn("more", (F.col("part") == "all").cast("int"))
    order = Window.partitionBy(*groups).orderBy("u", "doc_id", "size", "r")
    some = dealt.where("part = 'some'").withColumn("done", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    some = some.withColumn("more", (F.col("done") + F.col("size") / 2 <= F.col("rest")).cast("int")).drop("done")
    out = even.unionByName(some).withColumn("copies", F.least(F.col("whole") + F.col("more"), F.lit(int(cap))))
    return out.drop("bin", "bin_size", "before", "rest", "whole", "part", "more", "cell_size")


def same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def mix_sources(docs: DataFrame, *, source: str = "source", side: str | None = "lang", id_col: str = "doc_id", text_col: str = "text", weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = CAP, hold: float = HOLD) -> DataFrame:
    """doc_id, g0 (source), g1, u, r, size, source_size, target, rate and copies of every document; weights repeat over the sources by code
    point. side: the column that should keep its shares (None, or a column that is not there: sources alone)."""
    sized = written(sizes(docs, id_col, text_col, source, side), "sizes")
    sources = numbered(sized.groupBy("g0").agg(F.sum("size").alias("size")))
    sources = written(sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int"))), "sources")
    targets = written(capped_targets(sources, cap=cap).select("g0", F.col("size").alias("source_size"), "target"), "targets")
    return balance(sized, targets, cap, hold)


def apply_mix(docs: DataFrame, *, source: str = "source", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, each repeated as often as it is taken (0 to cap times), with their own columns.

    Documents and copies meet by a hash of the whole row. Rows that agree in every column share their copies out among them.
    """
    taken = mix_sources(docs, source=source, id_col=id_col, text_col=text_col, **options)
    taken = taken.groupBy("r").agg(F.min("copies").alias("lo"), F.max("copies").alias("hi"), F.sum("copies").alias("total"), F.count(F.lit(1)).alias("n"))
    # the row travels as one value, so its columns may have any names
    keyed = docs.select(as_row(docs).alias("row"), row_hash(docs).alias("r")).join(taken, "r")
    more = F.row_number().over(Window.partitionBy("r").orderBy("r")) <= F.col("total") - F.col("lo") * F.col("n")
    copies = F.when(more & (F.col("lo") < F.col("hi")), F.col("hi")).otherwise(F.col("lo"))
    return keyed.withColumn("copies", copies).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def digest(mixed: DataFrame) -> DataFrame:
    """What op8 returns."""
    return mixed.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


#: the same optimum by a fixed-step iteration on the languages' multipliers, and the same rounding
ORACLE = rf"""
with recursive d as (select doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::bigint size,
    ('0x' || substr(md5(concat_ws(chr(31), coalesce(doc_id::varchar, ''), coalesce(text, ''))), 1, 15))::bigint u from documents),
s as (select source, n, 1.0::double + (row_number() over (order by source nulls last) - 1) % 3 w from (select source, sum(size)::bigint n from d group by source)),
lv as (select *, (sum(n) over () - coalesce(sum({CAP} * n) over o, 0))::double / (sum(w) over () - coalesce(sum(w) over o, 0)) lev from s window o as (order by n / w, w, n, source rows between unbounded preceding and 1 preceding)),
t as (select source, n source_size, least({CAP} * n, w * (select max(lev) from (select lev, row_number() over (order by n / w, w, n, source) r from lv where lev * w <= {CAP} * n) where r = 1))::double target from lv),
c as (select source, lang, sum(size)::double n from d group by source, lang),
c2 as (select c.source, c.lang, c.n, t.target, t.source_size, sum(c.n) over (partition by c.lang) l, row_number() over (partition by c.source order by c.lang nulls last) o from c join t on c.source is not distinct from t.source),
it as (select 0 i, source, lang, n, target, l, o, 0.0::double b, 0.0::double rate from c2
 union all
 select i + 1, source, lang, n, target, l, o, case when l > 0 then b - (sum(n * rt) over g - l + l * b / {HOLD}) / (sum(case when rt > 0 and rt < {CAP} then n * rt else 0 end) over g + l / {HOLD}) else b end, rt
 from (select *, case when target <= 0 then 0 when target >= {CAP} * sum(n) over p * (1 - 1e-12) or level is null then {CAP} else least({CAP}, greatest(0, level * e)) end rt
  from (select *, max(case when lev * e <= {CAP} then struct_pack(e := e, o := -o, level := lev) end) over (partition by source)['level'] as level
   from (select *, case when sum(n * e) over (partition by source order by e desc, o rows between current row and unbounded following) > 0 then
      (target - {CAP} * coalesce(sum(n) over (partition by source order by e desc, o rows between unbounded preceding and 1 preceding), 0)) / sum(n * e) over (partition by source order by e desc, o rows between current row and unbounded following) end lev
    from (select *, exp(b) e from it where i < 200))) window p as (partition by source)) window g as (partition by lang)),
r as (select source, lang, n, round(rate, 9) rate from it where i = 200),
x as (select d.*, rate, floor(rate)::int whole, (rate - floor(rate)) * n rest, sum(size) over (partition by d.source, d.lang order by u, doc_id, size rows unbounded preceding) - size done
  from d join r on d.source is not distinct from r.source and d.lang is not distinct from r.lang)
select doc_id, size, source_size::bigint source_size, target, (size * least({CAP}, whole + case when done + size / 2.0 <= rest then 1 else 0 end))::bigint taken from x join t on x.source is not distinct from t.source
"""
