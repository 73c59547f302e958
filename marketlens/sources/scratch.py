"""Intermediate tables in the cluster's shared folder, and their removal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session, which is spark.checkpoint.dir. Only a local session may do without that setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def tables_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie."""
    return f"{scratch_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut of the lineage that outlives executors."""
    path = path or f"{tables_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once no result that reads them is needed any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
