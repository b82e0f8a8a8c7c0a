"""Session helpers shared by every operator: test tables, the shared checkpoint folder, proven-size broadcasts."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they run; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="termloom-")) / "termloom.zip"  # read by the driver's own file server only
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table read in less than a quarter as many partitions as there are cores (one small file) dealt over all cores;
    any other as it is, since its partitions keep the cores busy without an exchange."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 4 * df._jdf.rdd().getNumPartitions() <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster names one. A local master may do without
    and gets a temporary one; elsewhere its absence is an error, since a folder of one machine would be lost with it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if not current.isDefined():
            sc.setCheckpointDir(named)
        return named
    if not current.isDefined():
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "termloom-checkpoints"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder for a written table below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as parquet and read it back: a checkpoint with statistics and column pruning."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(*actions: Callable[[], object]) -> list:
    """Independent actions at the same time, so that short jobs share the cores."""
    with ThreadPoolExecutor(len(actions)) as pool:
        return [f.result() for f in [pool.submit(a) for a in actions]]


# -- small files beside tables, through the Hadoop file system


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if it is not there."""
    fs, p = hadoop_path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str, exclusive: bool = False) -> bool:
    """Write a small file; with ``exclusive`` only if it is not there yet, and False if it is."""
    from py4j.protocol import Py4JJavaError

    fs, p = hadoop_path(spark, path)
    try:
        out = fs.create(p, not exclusive)
    except Py4JJavaError as e:
        if exclusive and "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


class BucketedTable:
    """A parquet table in a folder, hash-distributed and sorted by ``keys``, with one partition for each batch.

    Joins and aggregations on the keys read it where it lies: only their other side is exchanged, however much has been
    added before. A batch written again replaces itself, so a failed write can be repeated. The folder is all there is:
    any session can open it, with the schema, keys and number of buckets it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], buckets: int) -> None:
        self.spark, self.keys, self.buckets = spark, keys, buckets
        self.name = "termloom_" + hashlib.md5(path.encode()).hexdigest()
        by = ", ".join(keys)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({schema}, batch INT) USING parquet PARTITIONED BY (batch) CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
        self.columns = spark.table(self.name).columns[:-1]

    def write(self, df: DataFrame, batch: int) -> None:
        """The rows of a batch, in as many files as there are buckets."""
        rows = df.select(*self.columns).repartition(self.buckets, *self.keys)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = {batch}) SELECT * FROM {{rows}}", rows=rows)

    def read(self, batches: int) -> DataFrame:
        """The rows of the batches below ``batches``, with their number in ``batch``."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name).where(F.col("batch") < batches)
