"""Cut lineage in iterative operators: rounds are written to the folder that all executors share and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def materialize(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table below spark.checkpoint.dir, deleted when the application ends. Where that is unset on one machine (tests) it
    goes below the warehouse; on a cluster that is an error, for executors would not share the folder."""
    spark = df.sparkSession
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        home = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_rounds"
    path = f"{home.rstrip('/')}/vellum-{what}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
