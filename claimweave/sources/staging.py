"""Tables that cut lineage, kept in the folder all machines of the cluster share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local master (tests) gets a temporary one; anywhere
    else that is an error, as other machines wouldn't see the folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isEmpty():
            if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="claimweave-"))
            have = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = have.get()
    return folder.rstrip("/")


def _run_folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_folder(spark)}/claimweave/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result survives the loss of any executor and carries real size
    statistics, so later joins are planned from what was written. The table
    stays until ``clean_up``, as any result may be read from it again.
    """
    spark = df.sparkSession
    path = f"{_run_folder(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> bool:
    """Delete what this application has staged; results that aren't written yet can't be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
