"""Tables between jobs, in the folder that the session shares with its executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.  Only a session on this machine alone gets a folder of its own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="docspark-"))
            atexit.register(shutil.rmtree, _own[0].removeprefix("file://"), ignore_errors=True)
        base = _own[0]
    return base.rstrip("/")


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives lost executors, runs what makes `df` once.

    The folder is left for whoever owns spark.checkpoint.dir to clear, as checkpoints are, or for drop_scratch().
    """
    spark = df.sparkSession
    folder = f"{scratch_dir(spark)}/docspark-{uuid.uuid4().hex}"
    _written.append(folder)
    df.write.parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def drop_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this process; results that aren't written yet can't be read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
