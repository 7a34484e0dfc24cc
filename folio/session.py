"""Session factory and the shared folder that cuts lineage.

Nothing here sets a value a cluster operator would set: ``get_session`` is for tests and the bench, and the
checkpoint folder is taken from ``spark.checkpoint.dir`` wherever that is set.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "folio", cpus: int | None = None, shuffle: int | None = None) -> SparkSession:
    """A local session with UTC time, AQE and Arrow; for tests and the bench."""
    cpus = cpus or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FOLIO_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Spark's own switch to drop the shuffle files of a statement at its end; set only while a shared table is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's own setting, or a private one where it is unset in local mode.

    A folder of one machine would lose data on a cluster, so there an unset ``spark.checkpoint.dir`` is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not conf and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that all its machines share")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="folio-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable ``checkpoint()`` in the shared folder; it survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def write_shared(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back: like ``cut_lineage``, but compressed and by column.

    For wide tables that are read several times for different columns. The files go when the application ends; what
    was shuffled for the table goes as soon as it is written, and does not lie on the disks beside later shuffles.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores before costly work on each row: shuffled only if its scan has fewer splits than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives Python workers this package, wherever they were started; once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="folio-package-"), "folio.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
