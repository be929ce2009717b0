"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The temporary folder of local sessions without a setting, made once.
_LOCAL: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, local sessions (tests) use a temporary folder of this machine and clusters the warehouse,
    which is shared as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            if "base" not in _LOCAL:
                _LOCAL["base"] = "file://" + tempfile.mkdtemp(prefix="lorekeep-")
            base = _LOCAL["base"]
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lorekeep"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; it goes when the driver ends."""
    path = f"{workspace(spark)}/lorekeep-{uuid.uuid4().hex}/{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return f"{fs.makeQualified(hadoop).toString()}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, its lineage cut, safe when executors are lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lorekeep_path = path
    return out
