"""Sharding by extendible hashing, in DataFrame operations only.

A row's address is 60 hash bits. The directory begins with one bucket; a bucket over the byte limit splits on its next
bit, others stay, until every bucket fits. Splitting is decided on sums, not on rows: rows are first summed into cells of
``STRIDE`` bits (map-side, at most 2**STRIDE cells for a bucket), the cells are rolled up to all prefixes, and each cell takes the
shortest prefix that fits, whose ancestors are exactly the buckets that were too large. Cells that do not fit at that depth are the
oversized buckets of the next round, which reads ``STRIDE`` further bits of their rows alone.

Rows of one address that together pass the limit cannot be told apart by its bits. They are written out once with a number each,
and the splitting goes on with the bits of the number's hash. A bucket of a single row stays whole even if the row is over the limit
(``oversized``). Rows without text weigh 0 bytes; null ids share one address, so they too may be split by number. Empty tables give no
rows. All columns pass through; added columns take free names if theirs are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.tables import free, written

LIMIT_BYTES = 16 << 20
STRIDE, BITS = 15, 60


def address(*columns: str) -> Column:
    """60 bits of an MD5 of the columns' values."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("bigint")


def cell(bits: Column, depth: int) -> Column:
    return F.shiftright(bits, BITS - depth)


def split_round(sums: DataFrame, depth: int, limit: int) -> DataFrame:
    """sums: stem, cell (depth + STRIDE bits), bytes, rows. For each cell its bucket; its depth is null if it must split further."""
    full = depth + STRIDE
    level = sums.withColumn("d", F.explode(F.sequence(F.lit(depth), F.lit(full)))).withColumn("prefix", F.expr(f"shiftright(cell, {full} - d)"))
    buckets = level.groupBy("stem", "d", "prefix").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("n")).where((F.col("b") <= limit) | (F.col("n") == 1))
    # cells times depths are no table to broadcast, small as the cells' files look
    best = level.select("stem", "cell", "d", "prefix").join(buckets.hint("merge"), ["stem", "d", "prefix"]).groupBy("stem", "cell").agg(F.min_by(F.struct("d", "prefix", "b", "n"), "d").alias("s"))
    return sums.select("stem", "cell").join(best, ["stem", "cell"], "left").select("stem", "cell", F.col("s.d").alias("depth"), F.col("s.prefix").alias("prefix"), F.col("s.b").alias("shard_bytes"), F.col("s.n").alias("shard_rows"))


def assign_shards(docs: DataFrame, *, key: tuple[str, ...] = ("doc_id",), text_col: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """The rows with shard (its prefix as a string of bits), depth, shard_bytes, shard_rows and oversized."""
    names = {c: free(c, docs.columns) for c in ("shard", "depth", "shard_bytes", "shard_rows", "oversized")}
    columns = docs.columns
    rest = docs.select(F.struct(*columns).alias("row"), address(*key).alias("bits"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("bytes"), F.lit("").alias("stem"))
    done: list[DataFrame] = []
    numbered = False
    depth = 0
    while True:
        full = depth + STRIDE
        # the rows that are left agree in their first bits with one of the oversized buckets; stem names what came before the number's bits
        # cells are read three times below, so they are written; rows are summed once
        sums = written(rest.groupBy("stem", cell(F.col("bits"), full).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")), "cells")
        plan = written(split_round(sums, depth, limit), "directory")
        # the first directory has at most 2**STRIDE cells, a proven bound; later ones grow with the number of oversized buckets
        side = F.broadcast(plan) if depth == 0 and not numbered else plan
        joined = rest.withColumn("cell", cell(F.col("bits"), full)).join(side, ["stem", "cell"])
        done.append(joined.where("depth is not null").select("row", "stem", "depth", "prefix", "shard_bytes", "shard_rows"))
        if not plan.where("depth is null").limit(1).count():
            break
        rest = joined.where("depth is null").select("row", "bits", "bytes", "stem")
        depth = full
        if full >= BITS:
            rest = written(rest.withColumn("stem", F.concat("stem", F.lpad(F.bin("bits"), BITS, "0"))).withColumn("bits", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 4)), "numbered")
            numbered, depth = True, 0
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    bits = F.when(F.col("depth") > 0, F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))).otherwise(F.lit(""))
    return out.select(
        *(F.col("row")[c].alias(c) for c in columns), F.concat("stem", bits).alias(names["shard"]), (F.length("stem") + F.col("depth")).cast("int").alias(names["depth"]),
        F.col("shard_bytes").alias(names["shard_bytes"]), F.col("shard_rows").alias(names["shard_rows"]), (F.col("shard_bytes") > limit).alias(names["oversized"]),
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """One folder of Parquet a shard; a shard is a task's work, and its limit bounds the task."""
    sharded = assign_shards(docs, **options)
    name = sharded.columns[len(docs.columns)]
    sharded.repartition(name).write.partitionBy(name).parquet(path)


def digest(sharded: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What op2 returns."""
    return sharded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes"), "shard", "depth", "shard_bytes", "shard_rows", "oversized")


ORACLE = f"""
with d as (select doc_id, octet_length(encode(coalesce(text, '')))::bigint b, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint v from documents),
l as (select *, unnest(range(0, {BITS + 1})) d from d),
p as (select *, v >> ({BITS} - d) pre from l),
s as (select d, pre, sum(b)::bigint shard_bytes, count(*)::bigint shard_rows from p group by d, pre having sum(b) <= {LIMIT_BYTES} or count(*) = 1),
f as (select p.*, shard_bytes, shard_rows, row_number() over (partition by doc_id order by p.d) r from p join s on p.d = s.d and p.pre = s.pre)
select doc_id, b n_bytes, case when d = 0 then '' else lpad(bin(pre), d::int, '0') end shard, d::int depth, shard_bytes, shard_rows, shard_bytes > {LIMIT_BYTES} oversized
from f where r = 1
"""
