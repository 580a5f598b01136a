"""Tables written between jobs, so that long plans survive lost executors.

Everything goes to the folder named by ``spark.checkpoint.dir``; only a local session that names none gets
a temporary folder of its own.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="sentrine-")
    return _LOCAL[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t_{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sentrine_path = path
    return out


def append(table: DataFrame | None, df: DataFrame) -> DataFrame:
    """A materialized table with the rows of ``df`` added; without a table, a new one."""
    if table is None:
        return materialize(df)
    path = table._sentrine_path
    df.write.mode("append").parquet(path)
    out = df.sparkSession.read.schema(table.schema).parquet(path)
    out._sentrine_path = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def drop(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing later reads."""
    for df in tables:
        path = getattr(df, "_sentrine_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs now rather than when the driver next runs out of heap."""
    gc.collect()
    spark._jvm.System.gc()
