"""Tables between steps, in the folder that the cluster shares, and batches of rows between the JVM and Python."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch between the JVM and Python. Both sides hold a few at a time, outside the heap.
BATCH_BYTES = 4 << 20

_OWN: list[str] = []
_WRITTEN: list[str] = []


def small_batches(spark: SparkSession) -> None:
    """Rows of text go to Python by bytes, not by the session's 10,000 rows, which may be any size. The setting stays, as results are
    read lazily; one that the session has already lowered is left alone."""
    if 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= BATCH_BYTES:
        return
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is named, a temporary one: in local mode alone, as the executors of a
    cluster don't see the driver's disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="parchmill-"))
    return "file://" + _OWN[0]


def stored(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read again: lineage ends here, and a lost executor costs a read."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/parchmill/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Removes the tables that this driver has stored, and returns their number. Results that weren't written yet can't be read after it."""
    jvm, n = spark.sparkContext._jvm, 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n
