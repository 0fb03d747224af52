"""Helpers shared by the training-data operators.

Nothing here looks at data values: the helpers read tables, cut lineage into the
cluster's shared folder and shape Arrow batches for the Python stages.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bounds on what one Arrow batch hands to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20

#: Fixed value: the white space of the contracts, also what bytes.split() splits on.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well as by rows, since rows hold whole texts of any length, unless the session has bounds of its own."""
    own = spark.conf.getAll
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if key not in own:
            spark.conf.set(key, str(most))


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what setCheckpointDir named. Where neither is
    set, a local session gets a temporary folder; on a cluster that would be one machine's, so it is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and (named := context._jsc.sc().getCheckpointDir()).isDefined():
        folder = named.get()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="groundwork-"))
    return _own_folder[0]


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files that no plan refers to any more; else they stay on the executors' disks until the driver happens to collect its garbage."""
    for _ in range(2):  # Python lets go first, a little later the JVM notices
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


class Workspace:
    """Tables written to the shared folder. A written table cuts lineage and survives the loss of executors.

    Tables are dropped one by one as soon as no later step reads them, and all that is left at interpreter exit.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm if self.spark.sparkContext._jsc else None
        if jvm is not None:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def write(self, df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
        """by: a column that gets a folder for each of its (few) values."""
        path = f"{self.root}/{name}"
        rows = df.write.option("compression", codec)
        (rows.partitionBy(by) if by else rows).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts' UTF-8 bytes without decoding; null is the empty text."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of df has, in any case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name
