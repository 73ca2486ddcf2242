"""Reading tables and writing intermediate tables that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read table `name` of a data set: one Parquet file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a private one where that is unset (tests, local mode)."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.conf.get("arborweft.local.checkpoint.dir", None)
    if not own:
        own = tempfile.mkdtemp(prefix="arborweft-")
        spark.conf.set("arborweft.local.checkpoint.dir", own)
    return own


class Scratch:
    """Written tables that cut lineage. Each survives the loss of any executor; `drop` frees the ones a loop no longer needs."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._arborweft_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_arborweft_path", None)
        if path is None:
            return
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame) -> DataFrame:
    """Small scans in more tasks: a scan with fewer partitions than the cluster has cores is dealt out evenly, so that work
    that is heavy on the processor fills all cores. A scan that is large enough already is left as it is, without a shuffle."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
