"""Line deduplication against levelled sorted runs of line hashes.

A ``LineStore`` is a folder of runs. A run is a Parquet table of line-key hashes, bucketed and sorted by them, so a batch
is merge-joined with it where it lies: the runs are never shuffled. A run has as many buckets (a power of two, at least 16) as
its keys need at ``BUCKET_KEYS`` each, a number that its name carries; batches number as many as the text needs at ``BATCH_BYTES``. Each batch of documents is reduced to its distinct keys
(map-side first), anti-joined with every run, and what is new becomes a run of level 0. ``fan_out`` runs of a level are
compacted into one of the next, so a store of n batches holds at most fan_out * log(n) runs.

A line's key is the line with space and U+0009-U+000D stripped at both ends and A-Z lower-cased; keys of fewer than ``least``
code points are never dropped. A key belongs to the smallest id of the first batch that has it; its lines in other documents are dropped,
its lines in that document (however many) stay. Batches are fed in the order of ids, so the first is the smallest of
all. A null id comes last. Documents of one id count as one document. Null and empty texts have one empty line. Empty tables give no
rows; columns other than id and text are not looked at. Keys are compared by 128 bits of hash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.tables import chunks_for, scratch_path, text_bytes, written

LEAST, BATCHES, FAN_OUT, BUCKETS = 10, 4, 2, 16
BUCKET_KEYS, BATCH_BYTES = 4_000_000, 1 << 40
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """A row for each line that may be dropped: r (the document's row), doc (its id, a null one last), pos, h1, h2."""
    lines = docs.select(F.xxhash64(id_col, text_col).alias("r"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("doc"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("pos", "line"))
    keys = lines.select("r", "doc", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least)
    return keys.select("r", "doc", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


class LineStore:
    """Runs of known keys under a shared folder. Names carry level, number and buckets, so a store can be opened again."""

    def __init__(self, spark: SparkSession, path: str, *, fan_out: int = FAN_OUT, buckets: int = BUCKETS, bucket_keys: int = BUCKET_KEYS):
        self.spark, self.path, self.fan_out, self.buckets, self.bucket_keys = spark, path, fan_out, buckets, bucket_keys
        self.tables: dict[str, str] = {}
        self.runs: list[tuple[int, int, int]] = []
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(root)
        for s in self.fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith("run-") and self.fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
                self.runs.append(tuple(map(int, name.split("-")[1:])))
        self.runs.sort(key=lambda x: x[1])

    def folder(self, run: tuple[int, int, int]) -> str:
        return f"{self.path}/run-{run[0]}-{run[1]}-{run[2]}"

    def read(self, run: tuple[int, int, int]) -> DataFrame:
        at = self.folder(run)
        if at not in self.tables:
            name = f"vellum_lines_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {run[2]} BUCKETS LOCATION '{at}'")
            self.tables[at] = name
        return self.spark.table(self.tables[at])

    def write(self, keys: DataFrame, level: int) -> None:
        n = self.buckets
        while n * self.bucket_keys < keys.count():
            n *= 2
        run = (level, max((x for _, x, _ in self.runs), default=-1) + 1, n)
        name = f"vellum_lines_{uuid.uuid4().hex}"
        keys.select("h1", "h2").repartition(n, "h1", "h2").write.bucketBy(n, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", self.folder(run)).saveAsTable(name)
        self.tables[self.folder(run)] = name
        self.runs.append(run)

    def compact(self) -> None:
        level = 0
        while level <= max((x[0] for x in self.runs), default=-1):
            own = [x for x in self.runs if x[0] == level]
            if len(own) >= self.fan_out:
                merged = self.read(own[0])
                for x in own[1:]:
                    merged = merged.unionByName(self.read(x))
                self.write(merged, level + 1)
                for x in own:
                    self.runs.remove(x)
                    self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(self.folder(x))}")
                    self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(x)), True)
            level += 1

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch (as from keyed_lines; read more than once, so written). Its lines to drop: r, pos."""
        firsts = written(lines.groupBy("h1", "h2").agg(F.min("doc").alias("owner"), F.max("doc").alias("other")), "firsts")
        fresh = firsts
        for run in self.runs:
            fresh = fresh.join(self.read(run), ["h1", "h2"], "left_anti")
        fresh = written(fresh, "fresh")
        known = firsts.join(fresh, ["h1", "h2"], "left_anti").select("h1", "h2", F.lit(None).cast("bigint").alias("owner"))
        guilty = known.union(fresh.where("other > owner").select("h1", "h2", "owner"))
        dropped = written(lines.join(guilty, ["h1", "h2"]).where("owner is null or doc > owner").select("r", "pos"), "dropped")
        self.write(fresh, 0)
        self.compact()
        return dropped

    def close(self) -> None:
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, batches: int = 0, store: LineStore | None = None, keep_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_lines, n_dropped, kept_sha256 and, if asked for, kept (the text left). batches: 0 for as many as the text needs."""
    spark = docs.sparkSession
    own = store or LineStore(spark, scratch_path(spark, "lines"))
    if not batches:
        batches = max(BATCHES, chunks_for(text_bytes(docs, text_col)[1], BATCH_BYTES))
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("bigint"), [k / batches for k in range(1, batches)], 10000)).first()[0] if batches > 1 else []
    lines = keyed_lines(docs, id_col, text_col, least)
    batch = sum((F.when(F.col("doc") > c, 1).otherwise(0) for c in sorted(set(cuts or []))), F.lit(0))
    at = scratch_path(spark, "keys")
    lines.withColumn("batch", batch).write.partitionBy("batch").parquet(at)
    all_lines = spark.read.schema(f"{', '.join(f'{n} {t}' for n, t in lines.dtypes)}, batch int").parquet(at)
    dropped = None
    try:
        for k in range(len(set(cuts or [])) + 1):
            gone = own.add(all_lines.where(F.col("batch") == k).drop("batch"))
            dropped = gone if dropped is None else dropped.union(gone)
    finally:
        if store is None:
            own.close()
    # identical rows have equal r and would be listed twice
    gone = dropped.groupBy("r").agg(F.collect_set("pos").alias("gone"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(id_col, text_col).alias("r"))
    marked = texts.join(gone, "r", "left").withColumn("lines", F.when(F.col("gone").isNull(), F.array("text")).otherwise(F.split("text", "\n", -1)))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    full = marked.select("doc_id", n_lines.cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"), kept.alias("kept"))
    return full.select("doc_id", "n_lines", F.greatest("n_dropped", F.lit(0)).alias("n_dropped"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"), *(["kept"] if keep_text else []))


def digest(result: DataFrame) -> DataFrame:
    """What op5 returns."""
    return result.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLE = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select doc_id, unnest(range(1, len(ls) + 1)) pos, unnest(ls) line from d),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
o as (select key, min(doc_id) owner from k where length(key) >= 10 group by key),
j as (select k.*, coalesce(k.doc_id > o.owner, false) gone from k left join o using (key))
select doc_id, count(*)::bigint n_lines, count(*) filter (where gone)::bigint n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) kept_sha256
from j group by doc_id
"""
