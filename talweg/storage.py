"""Tables, and the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Paths of what this process has staged, in order.
_STAGED: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: `spark.checkpoint.dir`.

    Only a local session (in a test) may leave that unset; it gets a temporary folder.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if not place:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            own = tempfile.mkdtemp(prefix="talweg-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            place = f"file://{own}"
        spark.sparkContext.setCheckpointDir(place)
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return (place or known.get()).rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: its lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete what was staged from number `since` on. Only for a caller whose results are written: frames that read it fail afterwards."""
    jvm = spark.sparkContext._jvm
    for path in _STAGED[since:]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    del _STAGED[since:]


def staged_so_far() -> int:
    return len(_STAGED)

