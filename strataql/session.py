"""Session helpers: local sessions for tests, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session as tests and the bench use it; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or what setCheckpointDir was given.

    Where neither is set, a local session (tests, a laptop) gets a temporary folder; on a cluster
    that is an error, since each executor would write to a disk of its own.
    """
    context = spark.sparkContext
    known = context.getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.strataql.shared.dir", None)
    found = found or known
    if not found:
        found = local_folder(context.master)
        spark.conf.set("spark.strataql.shared.dir", found)
    if known is None:
        context.setCheckpointDir(found)
    return found


def local_folder(master: str) -> str:
    """A temporary folder for a session of one machine; an error for any other."""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="strataql-")


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, label: str, **counts) -> DataFrame:
    """Cut the lineage of df by writing it, compressed, to the shared folder and reading it again.

    The files outlive executors. They go when `release` is called, else when the session ends.
    `counts` are aggregates by name, told while the rows are written; they are found in the result's
    attribute `counts`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    seen = Observation(uuid.uuid4().hex) if counts else None
    observed = df.observe(seen, *[c.alias(n) for n, c in counts.items()]) if seen else df
    observed.write.option("compression", "zstd").parquet(path)
    target, files = _files(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    out.counts = seen.get if seen else {}
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of written frames that nothing reads any more; other frames are left alone."""
    for df in frames:
        path = getattr(df, "written_to", None)
        if path:
            target, files = _files(df.sparkSession, path)
            files.delete(target, True)
            files.cancelDeleteOnExit(target)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for costly work on few or unsplit files.

    Input that already comes in enough partitions, as large data does, stays where it is, and so does
    a plan with a shuffle of its own: asking how many partitions that has would run it.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
