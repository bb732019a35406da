"""Sessions, table reading and the shared scratch folder.

Nothing here keeps data on a machine's own disk: intermediate tables go to the
folder that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast below this many rows ...
BROADCAST_ROWS = 200_000
#: ... and only when its rows have at most this many bytes together.
BROADCAST_BYTES = 32 << 20


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tarnweave")
    base = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the path may be of any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names. Where that is unset, a temporary
    folder is made and set, but only in local mode, where all threads share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-tarnweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/tarnweave/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A lost executor can't lose the rows, and both sides of a later self-join
    read the same ones.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_settled(df: DataFrame) -> None:
    """Delete the files of a settled table that no later step reads."""
    spark = df.sparkSession
    root = scratch_root(spark) + "/tarnweave/"
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tarnweave/" in file and root.split(":", 1)[-1].lstrip("/") in file:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _bytes_of(df: DataFrame, fixed: int) -> Column:
    """Bytes of a row: ``fixed``, the lengths of strings, and nested values by their JSON."""
    total = F.lit(fixed).cast("long")
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total += F.coalesce(F.octet_length(df[field.name]), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total += F.coalesce(2 * F.octet_length(F.to_json(F.struct(df[field.name]))), F.lit(0))
    return total


def broadcast_if_small(df: DataFrame, row_bytes: int = 64, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its rows are few and small enough, else as it is (a shuffle join).

    ``df`` should be settled, as it is read to count rows and measure their
    strings and lists. ``row_bytes`` is a bound on the bytes of the other columns.
    """
    limit = min(rows, BROADCAST_BYTES // row_bytes)
    n, size = df.select(_bytes_of(df, row_bytes).alias("size")).limit(limit + 1).agg(F.count("*"), F.sum("size")).first()
    return F.broadcast(df) if n <= limit and (size or 0) <= BROADCAST_BYTES else df


__all__ = ["BROADCAST_ROWS", "broadcast_if_small", "drop_settled", "local_session", "scratch_path", "scratch_root", "settle", "table"]
