"""Tables written to the cluster's shared folder, to cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has written and not released.
_written: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that spark.checkpoint.dir names, or below one of our own where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="mediaframe-")
        spark.sparkContext.setCheckpointDir(root)
    _written.append(f"{root.rstrip('/')}/mediaframe/{name}-{uuid.uuid4().hex[:12]}")
    return _written[-1]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete the files behind tables made by materialize(), once nothing reads them any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/mediaframe/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def sweep(spark: SparkSession) -> int:
    """Delete what this process has written so far, once no result that reads it is needed; how many folders."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
