"""Several tables published at one stroke (S11, S23): a numbered manifest names the paths that belong together, and is put only if no other writer took its number."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

FORMAT = "%08d.manifest"


def _folder(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return jvm, path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def newest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The last manifest's number and content; 0 and {} where nothing is published."""
    _, path, fs = _folder(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    last = max((int(n.split(".")[0]) for n in names if n.endswith(".manifest")), default=0)
    return last, read(spark, root, last) if last else {}


def read(spark: SparkSession, root: str, number: int) -> dict:
    """A version's content."""
    jvm, path, fs = _folder(spark, root)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(path, FORMAT % number))
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, root: str, number: int, content: dict) -> bool:
    """Write manifest `number` whole, or not at all where it exists: false.

    The bytes are written to a name of their own first. On a local file system the final name is a hard link, elsewhere a
    rename that doesn't overwrite: both are one step, so readers never see half a manifest and of two writers one loses.
    """
    jvm, path, fs = _folder(spark, root)
    fs.mkdirs(path)
    own = jvm.org.apache.hadoop.fs.Path(path, f"_{uuid.uuid4().hex}")
    out = fs.create(own, False)
    out.write(bytearray(json.dumps(content, sort_keys=True), "utf-8"))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(path, FORMAT % number)
    try:
        if fs.getUri().getScheme() == "file":
            os.link(own.toUri().getPath(), final.toUri().getPath())
            return True
        # HDFS and what keeps to its contract: false where the target is there.
        return not fs.exists(final) and fs.rename(own, final)
    except FileExistsError:
        return False
    finally:
        fs.delete(own, False)


def commit(spark: SparkSession, root: str, change: Callable[[dict], dict], tries: int = 20) -> int:
    """Publish change(newest content) as the next number. If another writer was first, the change is made anew on top of what they published.

    What `change` names must be written already; a writer that ends before the commit leaves the old version in force.
    """
    for _ in range(tries):
        number, content = newest(spark, root)
        if put_if_absent(spark, root, number + 1, change(content)):
            return number + 1
    raise RuntimeError(f"{tries} writers in turn took the next version of {root}")
