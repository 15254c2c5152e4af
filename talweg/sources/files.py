"""Files in and out: strict scans, provenance, logs, exports and run folders."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import commits

#: A trial's columns, in the order of the header (a fixed format).
SIGNAL_COLUMNS = ("Time", "Ipv", "Vpv", "Vdc", "ia", "ib", "ic", "va", "vb", "vc", "Iabc", "If", "Vabc", "Vf")
SIGNALS = T.StructType([T.StructField(c, T.DoubleType()) for c in SIGNAL_COLUMNS])
#: Names of the trials: healthy and faulty, each at two loads (a fixed list).
TRIALS = tuple(f"F{k}{load}" for k in range(8) for load in "LM")


def trial_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.csv$", 1)


def read_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Every CSV of a folder under one explicit schema; a header or a value that doesn't fit fails the job, as do null, NaN and infinite values."""
    raw = spark.read.schema(SIGNALS).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(folder)
    good = F.lit(True)
    for c in SIGNAL_COLUMNS:
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return raw.withColumn("trial", trial_of(F.input_file_name())).withColumn("_ok", F.when(good, True).otherwise(F.raise_error(F.lit("a signal holds a value that is no number")).cast("boolean"))).where("_ok").drop("_ok")


def unexpected_files(signals: DataFrame, expected: tuple[str, ...] = TRIALS) -> DataFrame:
    """Trials that are missing or that nobody expects: (trial, issue), empty if all is well."""
    spark = signals.sparkSession
    want = spark.createDataFrame([(x,) for x in expected], "trial string")
    have = signals.select("trial").distinct()
    return want.join(have, "trial", "left_anti").withColumn("issue", F.lit("missing")).unionByName(have.join(want, "trial", "left_anti").withColumn("issue", F.lit("unexpected")))


def provenance_issues(spark: SparkSession, folder: str, digests: DataFrame) -> DataFrame:
    """Files whose SHA-256 isn't the one recorded (file, sha256)."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("_now"))
    return digests.join(files, "file", "left").where(~F.col("sha256").eqNullSafe(F.col("_now"))).select("file", F.when(F.col("_now").isNull(), "missing").otherwise("changed").alias("issue"))


def sampling(signals: DataFrame, trial: str, time: str, order: str) -> DataFrame:
    """Points, whether time rises, median step and rate of each trial, and whether 9-11 kHz and 1000 points hold."""
    from pyspark.sql import Window

    step = signals.withColumn("_d", F.col(time) - F.lag(time).over(Window.partitionBy(trial).orderBy(order)))
    out = step.groupBy(trial).agg(F.count(F.lit(1)).alias("n_points"), F.coalesce(F.bool_and(F.col("_d") > 0), F.lit(False)).alias("rising"), F.percentile("_d", 0.5).alias("median_step"))
    rate = F.try_divide(F.lit(1.0), F.col("median_step"))
    return out.withColumn("rate", rate).withColumn("ok", F.col("rising") & (F.col("n_points") >= 1000) & F.coalesce(F.col("rate").between(9000, 11000), F.lit(False)))


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Documents under an explicit schema; what doesn't fit fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines of JSON; malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append lines of JSON."""
    rows.write.mode("append").json(path)


def export(df: DataFrame, path: str, form: str = "csv") -> None:
    """A new folder; an existing one is an error, never overwritten."""
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if form == "csv" else writer.format(form).save(path)


def publish(df: DataFrame, root: str, name: str) -> int:
    """Write a table as the next version below `root`, and return its number. The files are written to a folder of their own; a manifest that no other writer can take makes them the version."""
    return publish_all(df.sparkSession, root, {name: df})


def publish_all(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Several tables (chunks, index, pointer) as one version: readers see all of them or none. Tables of earlier versions that aren't given stay."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{root}/{name}-{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(paths[name])
    return commits.commit(spark, root, lambda now: now | paths)


def run_status(runs: DataFrame, chunks: DataFrame, issues: DataFrame, run: str) -> DataFrame:
    """What is published of each run: failed without vectors, partial with issues, else ready; with its counts."""
    n = chunks.groupBy(run).agg(F.count("vector").alias("n_vectors"))
    k = issues.groupBy(run).agg(F.count(F.lit(1)).alias("n_issues"))
    both = runs.join(n, run, "left").join(k, run, "left").fillna(0, ["n_vectors", "n_issues"])
    return both.withColumn("status", F.when(F.col("n_vectors") == 0, "failed").when(F.col("n_issues") > 0, "partial").otherwise("ready"))


def switch_active(catalog: DataFrame, published: DataFrame, title: str, run: str, number: str) -> DataFrame:
    """The catalog's active run of each title, switched to the newest published run that didn't fail; the old run's chunks leave the index with it."""
    best = published.where("status <> 'failed'").groupBy(title).agg(F.max_by(run, number).alias("_new"))
    return catalog.join(best, title, "full_outer").withColumn("active_run", F.coalesce("_new", "active_run")).drop("_new")


def cached(spark: SparkSession, root: str, parts: dict[str, str], build) -> DataFrame:
    """The table for these parts (hashes of inputs, a version), from the folder named by their digest; built if it isn't there.

    It is written beside its place and moved there when complete, so readers never see a half-written one; if another job
    was first, that one's stays.
    """
    digest = hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()
    jvm = spark.sparkContext._jvm
    home = jvm.org.apache.hadoop.fs.Path(f"{root}/{digest}")
    fs = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(home):
        beside = f"{root}/.{digest}-{uuid.uuid4().hex}"
        build().write.parquet(beside)
        if fs.exists(home) or not fs.rename(jvm.org.apache.hadoop.fs.Path(beside), home):
            fs.delete(jvm.org.apache.hadoop.fs.Path(beside), True)
    return spark.read.parquet(f"{root}/{digest}")


def weights_digest(weights: DataFrame) -> str:
    """A digest of all weights (name, at, value), whatever their order: the sorted row hashes' hash."""
    rows = weights.select(F.sha2(F.concat_ws("|", "name", F.col("at").cast("string"), F.hex(F.col("value").cast("double").cast("string"))), 256).alias("h"))
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256)).first()[0]  # a model's weights


def save_weights(weights: DataFrame, path: str) -> str:
    """A model's weights (name, at, value) as a new folder, with their digest; returns it."""
    digest = weights_digest(weights)
    weights.select("name", "at", F.col("value").cast("double").alias("value")).withColumn("digest", F.lit(digest)).write.mode("errorifexists").parquet(path)
    return digest


def load_weights(spark: SparkSession, path: str, digest: str) -> DataFrame:
    """The weights, after a check that they are those of the digest."""
    got = spark.read.parquet(path)
    if weights_digest(got) != digest:
        raise ValueError("the weights aren't those that were recorded")
    return got.select("name", "at", "value")


#: What the readers expect.
QUESTIONS = "id string, question string, expected array<string>, kind string"
FMECA_ITEMS = "id string, name string, s int, o int, d int, rate double, hours double"
REPAIRS = "`group` string, scenario string, detection double, repair double, source string"


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Reference questions; blank ones or repeated ids are an error."""
    q = spark.read.schema(QUESTIONS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if q.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(F.length(F.trim(F.coalesce("question", F.lit(""))))).alias("l")).where("n > 1 or l = 0 or id is null").limit(1).count():
        raise ValueError("a question is blank or an id repeats")
    return q


def load_items(spark: SparkSession, path: str) -> DataFrame:
    """The FMECA table; notes outside 1 to 10 are an error."""
    t = spark.read.schema(FMECA_ITEMS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if t.where("not coalesce(s between 1 and 10 and o between 1 and 10 and d between 1 and 10, false)").limit(1).count():
        raise ValueError("a note of severity, occurrence or detection is missing or out of range")
    return t


def load_repairs(spark: SparkSession, path: str) -> DataFrame:
    """Repair scenarios; hours below zero are an error."""
    r = spark.read.schema(REPAIRS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if r.where("detection < 0 or repair < 0 or detection is null or repair is null").limit(1).count():
        raise ValueError("repair hours are missing or negative")
    return r


def parameters(given: dict, known: dict[str, tuple]) -> dict:
    """Parameters of an experiment: whole numbers within their range, lists without repeats in order; unknown names are an error.

    known: name -> (default, least, most); a default that is a list asks for a list.
    """
    unknown = set(given) - set(known)
    if unknown:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    out = {}
    for name, (default, least, most) in known.items():
        value = given.get(name, default)
        many = list(dict.fromkeys(value)) if isinstance(default, (list, tuple)) else [value]
        if not many or any(isinstance(x, bool) or not isinstance(x, int) or not least <= x <= most for x in many):
            raise ValueError(f"{name} must be whole, from {least} to {most}")
        out[name] = sorted(many) if isinstance(default, (list, tuple)) else many[0]
    return out


def _legacy(spark: SparkSession, root: str, name: str) -> tuple[int, str] | None:
    """Number and path of the newest complete folder `name-<number>` of a place without manifests."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(root)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for s in fs.listStatus(place) if fs.exists(place) else []:
        got = s.getPath().getName()
        if got.startswith(f"{name}-") and got[len(name) + 1 :].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            found.append((int(got[len(name) + 1 :]), s.getPath().toString()))
    return max(found, default=None)


def newest(spark: SparkSession, root: str, name: str) -> int | None:
    """Number of the newest version that has the table; null if none has."""
    number, content = commits.newest(spark, root)
    old = _legacy(spark, root, name)
    return number if name in content else old[0] if old else None


def current(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table as the newest (or an earlier) version has it; of a place without manifests the newest complete folder."""
    content = commits.newest(spark, root)[1] if version is None else commits.read(spark, root, version)
    old = _legacy(spark, root, name) if version is None and name not in content else None
    path = old[1] if old else content.get(name)
    if path is None:
        raise FileNotFoundError(f"{root} holds no complete {name}")
    return spark.read.parquet(path)


def confirmation_key(row: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of a struct's JSON."""
    return F.substring(F.sha2(F.to_json(row).cast("binary"), 256), 1, 16)


def derived_seed(base: int, *parts: Column) -> Column:
    """Base plus the first eight hex digits of a hash of the parts, modulo a million."""
    return F.lit(base) + F.conv(F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 8), 16, 10).cast("bigint") % 1_000_000
