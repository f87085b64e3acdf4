"""What the operators share on the Spark side: shared scratch folders, chunk counts, output columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, taken: list[str]) -> str:
    """The name, lengthened until no column has it (letter case aside)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset on one machine (tests), one below the warehouse.
    On a cluster there is no such stand-in: the executors could not see it."""
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        home = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return home.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write df once as Parquet in the shared folder and read it back, so that lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def hashable(docs: DataFrame) -> list[Column]:
    return [docs[f"`{f.name}`"] for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]


def as_row(docs: DataFrame) -> Column:
    """The whole row as one value, so that its columns may have any names."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new folder name in the shared folder; it is deleted when the application ends."""
    path = f"{shared_folder(spark)}/vellum-{what}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def text_bytes(docs: DataFrame, text: str) -> tuple[int, int]:
    """Rows and bytes of text."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def chunks_for(total: int, each: int) -> int:
    """How many chunks of about ``each`` bytes; the number grows with the input, the chunk does not."""
    return max(1, -(-int(total) // each))
