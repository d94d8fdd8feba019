"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster job brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("attestor")
    conf = CONF | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": "8g"} | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL_WORK: list[str] = []
_OPEN: list[Workspace] = []


def work_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one of our own.

    Without that setting a local session uses a temporary folder of the machine and any other
    session the warehouse, which every executor can reach.
    """
    conf = spark.sparkContext.getConf()
    if root := conf.get("spark.checkpoint.dir"):
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        if not _LOCAL_WORK:
            _LOCAL_WORK.append(tempfile.mkdtemp(prefix="attestor-"))
        return f"file://{_LOCAL_WORK[0]}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_attestor_work"


class Workspace:
    """Tables written once to the shared folder, so that lineage ends there and lost executors cost a reread."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        _OPEN.append(self)

    def new_path(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return it reread."""
        path = self.new_path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._attestor_path = path  # for drop()
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that save() wrote and nothing reads any more."""
        self.delete(df._attestor_path)

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def close(self) -> None:
        """Delete all tables of this workspace; what reads them must be done."""
        self.delete(self.path)
        if self in _OPEN:
            _OPEN.remove(self)


def close_work() -> None:
    """Delete the tables of every workspace that operators have opened so far.

    Operators return DataFrames that still read their tables, so only the caller knows when these are done with: after
    writing a result, or at the end of a job.
    """
    for work in list(_OPEN):
        work.close()
