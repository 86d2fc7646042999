"""Written tables that cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder in ``spark.checkpoint.dir`` (under /tmp where unset, as in tests) and read again."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints"
    path = f"{base.rstrip('/')}/meanfield/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._meanfield_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes a table made by ``stored`` that no later plan reads."""
    path = getattr(df, "_meanfield_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jpath, True)
